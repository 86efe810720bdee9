"""Deeply nested records into related flat tables, by shared inlining.

Shared inlining (from the XML-to-relational literature) works on the schema graph: one vertex for each element type, one
edge for each containment. An element gets a table of its own if it can repeat below one parent (the field holds a list),
is shared by several parents or is recursive; every other element is inlined into the table of the nearest ancestor that has one. Rows carry
the record's key, their own id (preorder within the record), and the table and id of their parent row as foreign key.

``schema_graph`` reads the graph off the data (pre-aggregated in each task, so only edges are shuffled), ``plan_tables``
decides on the tables, and ``shred`` makes the rows of one table.

Defined results: null or empty text, and text that is not complete JSON, give no rows. A key delivered again counts once:
the latest of its complete copies. An optional field that is missing is null. Keys are folded to lower case. JSON kept as
text inside a containing field is read as if it stood there. A single object counts as a list of one; lists inside a
list, at any depth, are read as if their objects stood in it, in order, with nulls left out.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "record"
#: More edges than this are no schema but data used as keys.
MOST_EDGES = 20_000
_ROWS = 20_000


@dataclass(frozen=True)
class Elements:
    """What JSON doesn't say: which keys hold the same element type, and how to tell a bare root from an envelope.

    alias: key to element type, where several keys hold one type. root_keys: an outermost object with one of these keys
    is itself an element of type ``root``; otherwise it is an envelope. text_keys: fields that may hold their objects as
    JSON text; any other text is a value, even if it reads like JSON.
    """

    alias: tuple[tuple[str, str], ...] = ()
    root: str = RECORD
    root_keys: tuple[str, ...] = ()
    text_keys: tuple[str, ...] = ()

    def type_of(self, key: str) -> str:
        return dict(self.alias).get(key, key)


#: Form records: roots and children are one recursive element.
XFA = Elements(alias=(("form", "node"), ("children", "node")), root="node", root_keys=("children", "som", "kind"), text_keys=("children",))


@dataclass
class Plan:
    """tables: element types with a table of their own. inlined: (type, key) edges that are folded into the parent."""

    tables: set[str] = field(default_factory=set)
    inlined: set[tuple[str, str]] = field(default_factory=set)
    columns: dict[str, list[str]] = field(default_factory=dict)
    contained: frozenset[str] = frozenset()


def parse(raw: str | None):
    """The JSON value, or None where the text is missing or cut off."""
    if not raw:
        return None
    try:
        return json.loads(raw)
    except (ValueError, RecursionError):
        return None


def _objects(value, may_be_text: bool) -> list[dict] | None:
    """The objects in a containing field, whatever its form; None if the field is no container."""
    if type(value) is str:
        if not may_be_text or not value or value[0] not in "[{":
            return None
        value = parse(value)
    if type(value) is dict:
        return [value]
    if type(value) is not list:
        return None
    found: list[dict] = []
    plain = False
    stack = value[::-1]
    while stack:
        x = stack.pop()
        if type(x) is dict:
            found.append(x)
        elif type(x) is list:
            stack += reversed(x)
        elif type(x) is str and may_be_text and x[:1] in ("[", "{") and (inner := _objects(x, True)):
            found += inner
        else:
            plain = plain or x is not None
    # a list without objects holds plain values, if it holds anything
    return found if found or not plain else None


def fold(obj: dict) -> dict:
    return {k.lower(): v for k, v in obj.items()}


# schema graph


def _edges(raws: Iterable[str | None], elements: Elements) -> Counter:
    """(parent type, key, child type or "", repeats) to count. The child type is empty for a plain value."""
    seen: Counter = Counter()
    types = dict(elements.alias)
    for raw in raws:
        value = parse(raw)
        stack = []
        for top in _objects(value, False) or []:
            top = fold(top)
            stack.append((elements.root if any(k in top for k in elements.root_keys) else RECORD, top))
        while stack:
            kind, obj = stack.pop()
            for key, v in obj.items():
                inner = _objects(v, key in elements.text_keys)
                if inner is None:
                    seen[kind, key, "", False] += 1
                    continue
                child = types.get(key, key)
                seen[kind, key, child, type(v) is not dict] += 1
                stack += [(child, fold(x)) for x in inner]
    return seen


def schema_graph(df: DataFrame, raw: str, elements: Elements) -> DataFrame:
    """``(parent, key, child, many, n)``: the edges of the schema graph with their number of occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            seen += _edges(b.column(0).to_pylist(), elements)
        cols = list(zip(*((*k, n) for k, n in seen.items()), strict=True)) or [[]] * 5
        types = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["parent", "key", "child", "many", "n"])

    edges = df.select(raw).mapInArrow(count, "parent string, key string, child string, many boolean, n bigint")
    return edges.groupBy("parent", "key", "child").agg(F.max("many").alias("many"), F.sum("n").alias("n"))


def plan_tables(graph: Iterable[tuple[str, str, str, bool]]) -> Plan:
    """Shared inlining over ``(parent, key, child, many)`` edges."""
    graph = list(graph)
    below: dict[str, set[str]] = {}
    parents: dict[str, set[tuple[str, str]]] = {}
    many = set()
    for parent, key, child, repeats in graph:
        if child:
            below.setdefault(parent, set()).add(child)
            parents.setdefault(child, set()).add((parent, key))
            if repeats:
                many.add(child)

    def reaches(start: str) -> set[str]:
        found, todo = set(), list(below.get(start, ()))
        while todo:
            if (x := todo.pop()) not in found:
                found.add(x)
                todo += below.get(x, ())
        return found

    recursive = {x for x in parents if x in reaches(x)}
    plan = Plan()
    plan.tables = {RECORD} | many | recursive | {x for x, p in parents.items() if len({q for q, _ in p}) > 1}
    plan.inlined = {(p, k) for p, k, c, _ in graph if c and c not in plan.tables}
    plan.contained = frozenset(k for _, k, c, _ in graph if c)
    inner = {(p, k): c for p, k, c, _ in graph if (p, k) in plan.inlined}

    def columns(kind: str, prefix: str = "") -> list[str]:
        own = [prefix + k for p, k, c, _ in graph if p == kind and not c and k not in plan.contained]
        return own + [x for (p, k), c in inner.items() if p == kind for x in columns(c, f"{prefix}{k}_")]

    plan.columns = {t: sorted(set(columns(t))) for t in plan.tables}
    return plan


def collect_plan(df: DataFrame, raw: str, elements: Elements) -> Plan:
    """The plan for these data. What comes to the driver is the schema, not the data: its size is checked."""
    edges = schema_graph(df, raw, elements).select("parent", "key", "child", "many").take(MOST_EDGES + 1)
    if len(edges) > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} kinds of fields: values are used as keys")
    return plan_tables(tuple(e) for e in sorted(edges))


# rows


@dataclass
class Row:
    table: str
    id: int
    parent_table: str
    parent_id: int | None
    ord: int
    obj: dict
    #: Position in the parent's list is `ord`; path and parent_path are set for elements with a path rule.
    path: str = ""
    parent_path: str = ""


_INDEX = re.compile(r"\[[^\]]*\]$")


def segment(obj: dict) -> str:
    """Name of a node in its path: its name, else the last segment of its own path, else # and its kind."""
    name = obj.get("name")
    if name:
        return str(name)
    som = obj.get("som")
    if som and (last := _INDEX.sub("", str(som).rpartition(".")[2])):
        return last
    return f"#{obj.get('kind') or ''}"


def rows(value, elements: Elements, plan: Plan, path_type: str | None = None) -> Iterator[Row]:
    """The rows of all tables of one record, parents before children, siblings in order."""
    tops = [fold(x) for x in _objects(value, False) or []]
    types = dict(elements.alias)
    ids: Counter = Counter()

    def new(kind: str, parent: Row | None, at: int, obj: dict) -> Row:
        row = Row(kind, ids[kind], parent.table if parent else "", parent.id if parent else None, at, obj)
        ids[kind] += 1
        return row

    record = new(RECORD, None, 0, {})
    stack: list[Row] = []

    def attach(owner: Row, kind: str, obj: dict, target: dict, prefix: str) -> None:
        """Plain values into ``target``; inlined elements the same with a prefix; others onto the stack."""
        for key, v in obj.items():
            inner = _objects(v, key in elements.text_keys)
            if inner is None:
                if key not in plan.contained:
                    target[prefix + key] = v
                continue
            child = types.get(key, key)
            if child in plan.tables:
                named: Counter = Counter()
                for i, x in enumerate(inner):
                    row = new(child, owner, i, fold(x))
                    if child == path_type:
                        up = owner.path if owner.table == path_type else ""
                        seg = segment(row.obj)
                        row.path, row.parent_path = f"{up}.{seg}[{named[seg]}]" if up else f"{seg}[{named[seg]}]", up
                        named[seg] += 1
                    stack.append(row)
            else:
                if len(inner) > 1:
                    raise ValueError(f"{prefix}{key} repeats, but the plan folds it into its parent: it was made from other data")
                for x in inner:
                    attach(owner, child, fold(x), target, f"{prefix}{key}_")

    named: Counter = Counter()
    for i, top in enumerate(tops):
        if any(k in top for k in elements.root_keys):
            row = new(elements.root, record, i, top)
            if elements.root == path_type:
                seg = segment(top)
                row.path = f"{seg}[{named[seg]}]"
                named[seg] += 1
            stack.append(row)
        else:
            attach(record, RECORD, top, record.obj, "")
    yield record
    done = 0
    while done < len(stack):
        row = stack[done]
        done += 1
        flat: dict = {}
        attach(row, row.table, row.obj, flat, "")
        row.obj = flat
        yield row


def _text(v) -> str | None:
    return v if v is None or type(v) is str else json.dumps(v, ensure_ascii=False)


def once(df: DataFrame, key: str, raw: str, latest: str | None = None) -> DataFrame:
    """``_key, _raw``: one text for each key. Of several copies a complete one, of these the latest, of these the largest text."""
    d = df.where(F.col(key).isNotNull() & F.col(raw).isNotNull())
    at = F.col(latest) if latest else F.lit(None).cast("timestamp")
    copy = F.struct(F.try_parse_json(raw).isNotNull().alias("whole"), at.alias("at"), F.col(raw).alias("raw"))
    return d.groupBy(F.col(key).alias("_key")).agg(F.max(copy)["raw"].alias("_raw"))


def shred(df: DataFrame, key: str, raw: str, elements: Elements, plan: Plan, table: str, path_type: str | None = None, columns: list[str] | None = None, latest: str | None = None) -> DataFrame:
    """One table: ``key, id, parent_table, parent_id, ord``, with ``path, parent_path`` for the path type, and its fields as text.

    Fields whose names clash with those columns get the prefix ``f_``. ``columns`` leaves out all other fields, ``latest`` is
    the time of delivery by which of several copies of a key one is taken.
    """
    paths = table == path_type
    fixed = ["id", "parent_table", "parent_id", "ord"] + ["path", "parent_path"] * paths
    columns = plan.columns[table] if columns is None else [c for c in plan.columns[table] if c in columns]
    named = [f"f_{c}" if c in {key, *fixed} else c for c in columns]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()] + [pa.string()] * (2 * paths + len(columns))

    def batch(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[key, *fixed, *named])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in types]
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                value = parse(text)
                if value is None:
                    continue
                for r in rows(value, elements, plan, path_type):
                    if r.table != table:
                        continue
                    line = [k, r.id, r.parent_table, r.parent_id, r.ord]
                    if paths:
                        line += [r.path, r.parent_path]
                    line += [_text(r.obj.get(c)) for c in columns]
                    for cell, col in zip(line, out, strict=True):
                        col.append(cell)
                if len(out[0]) >= _ROWS:
                    yield batch(out)
                    out = [[] for _ in types]
            yield batch(out)

    ddl = f"`{key}` bigint, id int, parent_table string, parent_id int, ord int" + ", path string, parent_path string" * paths
    return once(df, key, raw, latest).mapInArrow(make, ddl + "".join(f", `{c}` string" for c in named))
