"""Problem 1: form records as flat tables."""

from pyspark.sql import functions as F

from ..operators import shred as S
from ..sources.tables import table
from .registry import Registry

R = Registry()


def _records(spark, d):
    x = table(spark, d, "xfa_records")
    return x, S.collect_plan(x, "raw", S.XFA)


_NODES = r"""
WITH RECURSIVE r AS MATERIALIZED (SELECT rec_id, CAST(arg_max(raw, (received_at, raw)) AS JSON) AS v FROM xfa_records WHERE rec_id IS NOT NULL AND json_valid(raw) GROUP BY rec_id),
  walk AS (SELECT rec_id, '' AS parent, []::INTEGER[] AS ord, v FROM r
    UNION ALL
    SELECT rec_id, x.parent, x.ord, x.v FROM (SELECT w.rec_id, unnest(CASE json_type(w.v)
        WHEN 'ARRAY' THEN list_transform(range(json_array_length(w.v)::INTEGER), lambda i: {'parent': w.parent, 'ord': list_append(w.ord, i::INTEGER), 'v': json_extract(w.v, '$[' || i || ']')})
        WHEN 'VARCHAR' THEN CASE WHEN json_valid(w.v ->> '$') AND left(w.v ->> '$', 1) IN ('[', '{') THEN [{'parent': w.parent, 'ord': w.ord, 'v': CAST(w.v ->> '$' AS JSON)}] END
        WHEN 'OBJECT' THEN CASE WHEN w.parent <> '' OR len(list_filter(json_keys(w.v), lambda k: lower(k) IN ('children', 'som', 'kind'))) > 0
          THEN list_transform(list_filter(json_keys(w.v), lambda k: lower(k) = 'children'), lambda k: {'parent': w.parent || '/' || array_to_string(w.ord, ','), 'ord': []::INTEGER[], 'v': json_extract(w.v, '$."' || k || '"')})
          ELSE list_transform(list_filter(json_keys(w.v), lambda k: lower(k) IN ('xfa', 'form')), lambda k: {'parent': w.parent, 'ord': w.ord, 'v': json_extract(w.v, '$."' || k || '"')}) END END) AS x FROM walk w)),
  n AS MATERIALIZED (SELECT rec_id, parent, parent || '/' || array_to_string(ord, ',') AS id, ord, coalesce(nullif(json_extract_string(v, '$."' || list_filter(json_keys(v), lambda k: lower(k) = 'name')[1] || '"'), ''),
      nullif(regexp_replace(split_part(json_extract_string(v, '$."' || list_filter(json_keys(v), lambda k: lower(k) = 'som')[1] || '"'), '.', -1), '\[[^\]]*\]$', ''), ''),
      '#' || coalesce(json_extract_string(v, '$."' || list_filter(json_keys(v), lambda k: lower(k) = 'kind')[1] || '"'), '')) AS seg
    FROM walk WHERE json_type(v) = 'OBJECT' AND (parent <> '' OR len(list_filter(json_keys(v), lambda k: lower(k) IN ('children', 'som', 'kind'))) > 0)),
  s AS MATERIALIZED (SELECT rec_id, parent, id, seg || '[' || (row_number() OVER (PARTITION BY rec_id, parent, seg ORDER BY ord) - 1) || ']' AS seg FROM n),
  p AS (SELECT rec_id, id, seg AS som, '' AS parent_som FROM s WHERE parent = '' UNION ALL SELECT s.rec_id, s.id, p.som || '.' || s.seg, p.som FROM p JOIN s ON s.rec_id = p.rec_id AND s.parent = p.id)
SELECT rec_id, som, parent_som FROM p"""


def _get(v: str, *keys: str) -> str:
    """A field's text in SQL, its key in any case, down through objects."""
    for k in keys[:-1]:
        v = f"json_extract({v}, '$.\"' || list_filter(json_keys({v}), lambda k: lower(k) = '{k}')[1] || '\"')"
    return f"json_extract_string({v}, '$.\"' || list_filter(json_keys({v}), lambda k: lower(k) = '{keys[-1]}')[1] || '\"')"


#: Nodes with their own number (parents first, level by level), and that of their parent.
_NUMBERED = _NODES.replace("'')) AS seg\n    FROM walk", "'')) AS seg, v\n    FROM walk").replace("s AS MATERIALIZED (SELECT rec_id, parent, id, seg", "s AS MATERIALIZED (SELECT rec_id, parent, id, v, CAST(row_number() OVER (PARTITION BY rec_id, parent ORDER BY ord) - 1 AS INTEGER) AS pos, seg").replace(
    "SELECT rec_id, id, seg AS som, '' AS parent_som FROM s WHERE parent = '' UNION ALL SELECT s.rec_id, s.id, p.som || '.' || s.seg, p.som FROM p", "SELECT rec_id, id, parent, v, pos, [pos] AS places, seg AS som, '' AS parent_som FROM s WHERE parent = '' UNION ALL SELECT s.rec_id, s.id, s.parent, s.v, s.pos, list_append(p.places, s.pos), p.som || '.' || s.seg, p.som FROM p"
).removesuffix("SELECT rec_id, som, parent_som FROM p").rstrip() + """,
  k AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY len(places), places) - 1 AS INTEGER) AS num FROM p),
  t AS MATERIALIZED (SELECT c.*, coalesce(u.num, 0) AS up FROM k c LEFT JOIN k u ON u.rec_id = c.rec_id AND u.id = c.parent)
"""


def _below(key: str, columns: dict[str, tuple[str, ...]]) -> str:
    """The rows of a list inside nodes."""
    inner = f"json_extract(v, '$.\"' || list_filter(json_keys(v), lambda k: lower(k) = '{key}')[1] || '\"')"
    rows = f"SELECT rec_id, num, unnest(range(json_array_length({inner})::INTEGER)) AS pos, {inner} AS list FROM t WHERE json_type({inner}) = 'ARRAY'"
    own = f"SELECT rec_id, num, CAST(pos AS INTEGER) AS pos, json_extract(list, '$[' || pos || ']') AS v FROM ({rows})"
    return f"{_NUMBERED} SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY num, pos) - 1 AS INTEGER) AS id, 'node' AS parent_table, num AS parent_id, pos AS ord, {', '.join(f'{_get('v', *path)} AS {c}' for c, path in columns.items())} FROM ({own}) WHERE json_type(v) = 'OBJECT'"


_FIELDS = {c: (c,) for c in ("access", "index", "kind", "name", "numeric", "presence", "repeatable", "som", "value")} | {"occur_max": ("occur", "max"), "occur_min": ("occur", "min")}


@R.query("p1_found", _NODES)
def p1_found(spark, d):
    x, plan = _records(spark, d)
    return S.shred(x, "rec_id", "raw", S.XFA, plan, "node", "node", [], "received_at").select("rec_id", F.col("path").alias("som"), F.col("parent_path").alias("parent_som"))


@R.query("p1_nodes", f"{_NUMBERED} SELECT rec_id, num AS id, CASE WHEN parent = '' THEN 'record' ELSE 'node' END AS parent_table, up AS parent_id, pos AS ord, som AS path, parent_som AS parent_path, {', '.join(f'{_get('v', *path)} AS {c}' for c, path in _FIELDS.items() if c != 'som')}, {_get('v', 'som')} AS som FROM t")
def p1_nodes(spark, d):
    x, plan = _records(spark, d)
    return S.shred(x, "rec_id", "raw", S.XFA, plan, "node", "node", latest="received_at")


@R.query("p1_items", _below("items", {"display": ("display",), "export": ("export",)}))
def p1_items(spark, d):
    x, plan = _records(spark, d)
    return S.shred(x, "rec_id", "raw", S.XFA, plan, "items", "node", latest="received_at")


@R.query("p1_events", _below("events", {"activity": ("activity",), "script_body": ("script", "body"), "script_lang": ("script", "lang")}))
def p1_events(spark, d):
    x, plan = _records(spark, d)
    return S.shred(x, "rec_id", "raw", S.XFA, plan, "events", "node", latest="received_at")


@R.query("p1_record_headers", f"WITH r AS (SELECT rec_id, CAST(arg_max(raw, (received_at, raw)) AS JSON) AS v FROM xfa_records WHERE rec_id IS NOT NULL AND json_valid(raw) GROUP BY rec_id) SELECT rec_id, 0 AS id, '' AS parent_table, CAST(NULL AS INTEGER) AS parent_id, 0 AS ord, {_get('v', 'version')} AS version, {_get('v', 'xfa', 'template', 'locale')} AS xfa_template_locale FROM r")
def p1_record_headers(spark, d):
    x, plan = _records(spark, d)
    return S.shred(x, "rec_id", "raw", S.XFA, plan, S.RECORD, "node", latest="received_at")


@R.query("p1_schema_graph")
def p1_schema_graph(spark, d):
    return S.schema_graph(table(spark, d, "xfa_records"), "raw", S.XFA)
