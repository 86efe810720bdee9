"""Operators on small literal tables: nulls, empty tables, ties, repeated rows, clashing names."""

import json
import random

import pytest
from pyspark.sql import functions as F

from inkquarry.operators import comments, diff, forms, layout, pages, rules, sets, shred, textlines


def rows(df, *by):
    return sorted((tuple(r) for r in (df.select(*by) if by else df).collect()), key=str)


GLYPHS = "doc_id bigint, page int, ord int, text string, line int, space_before boolean, key string"


def test_lines_agree_with_two_steps(spark):
    rng = random.Random(1)
    data = []
    for p in range(4):
        page = [(1, p, o, rng.choice(["a", "bc", "", None, "é"]), o // 7, rng.choice([True, False, None]), "x") for o in range(40)]
        data += page + (page if p % 2 else page[10:20])
    rng.shuffle(data)
    data += [(None, 1, 1, "x", 1, False, "x"), (1, 1, None, "x", 1, False, "x"), (1, None, 3, "x", 1, False, "x")]
    g = spark.createDataFrame(data, GLYPHS).repartition(3)
    assert rows(textlines.glyph_lines(g)) == rows(textlines.glyph_lines_two_step(g))
    assert textlines.glyph_lines(spark.createDataFrame([], GLYPHS)).count() == 0


def brute_paths(raw):
    out = []

    def walk(node, parent, seen):
        node = {k.lower(): v for k, v in node.items()}
        name = node.get("name") or (node.get("som") or "").rpartition(".")[2].split("[")[0] or f"#{node.get('kind') or ''}"
        i = seen.get(name, 0)
        seen[name] = i + 1
        path = f"{parent}.{name}[{i}]" if parent else f"{name}[{i}]"
        out.append((path, parent))
        kids = node.get("children")
        kids = json.loads(kids) if isinstance(kids, str) and kids[:1] in ("[", "{") else kids
        below = {}

        def each(x):
            if isinstance(x, dict):
                walk(x, path, below)
            for y in x if isinstance(x, list) else []:
                each(y)

        each(kids)

    try:
        v = json.loads(raw or "")
    except ValueError:
        return []
    if isinstance(v, list):
        return []
    v = v.get("xfa", v)
    v = v.get("form", v)
    seen = {}
    for r in v if isinstance(v, list) else [v]:
        walk(r, "", seen)
    return out


def test_shred(spark):
    leaf = {"kind": "field", "name": "a", "value": "1", "items": [{"export": "x", "display": "X"}], "events": [{"activity": "click", "script": {"lang": "js", "body": "b"}}]}
    raws = [
        json.dumps({"form": {"Name": "f", "Children": [leaf, leaf, {"som": "f.#area[3]", "name": ""}, {"kind": "draw"}]}, "version": 1}),
        json.dumps({"xfa": {"template": {"locale": "de"}, "form": [{"name": "g", "children": json.dumps([leaf])}]}}),
        json.dumps({"name": "h", "kind": "form", "children": {"name": "one", "value": '[{"x": 1}]'}}),
        json.dumps({"name": "cut", "children": [leaf]})[:-5], "", None, "[]",
        # lists in lists: some, all, with nulls between, as text, empty
        json.dumps({"name": "m", "kind": "form", "children": [leaf, [leaf, None, [{"name": "b"}]], None, leaf, [], [[]]]}),
        json.dumps({"name": "n", "kind": "form", "children": [[leaf], [{"name": "s", "children": [[[{"kind": "draw"}], leaf]]}], [None]]}),
        json.dumps({"name": "o", "kind": "form", "children": json.dumps([[leaf], {"name": "t", "children": [[]]}])}),
        json.dumps({"name": "q", "kind": "form", "children": [None, []], "value": ["1", "2"]}),
    ]
    data = [(i, r, "clash", 1) for i, r in enumerate(raws)]
    # a later copy that is cut off, and a later complete one, do not and do win
    again = [(0, raws[0][:-3], "clash", 2), (2, json.dumps({"name": "later", "kind": "form"}), "clash", 3), (2, raws[2][:-1], "clash", 4)]
    df = spark.createDataFrame(data + data[:2] + again, "rec_id bigint, raw string, path string, received int").repartition(2)
    raws[2] = again[1][1]
    plan = shred.collect_plan(df, "raw", shred.XFA)
    assert plan.tables == {"record", "node", "items", "events"} and ("events", "script") in plan.inlined
    got = rows(shred.shred(df, "rec_id", "raw", shred.XFA, plan, "node", "node", [], "received"), "rec_id", "path", "parent_path")
    assert got == sorted(((i, p, up) for i, r in enumerate(raws) for p, up in brute_paths(r)), key=str)
    node, items, events, record = (shred.shred(df, "rec_id", "raw", shred.XFA, plan, t, "node", latest="received") for t in ("node", "items", "events", "record"))
    leaves = sum(".a[" in p for _, p, _ in got)
    for child in (items, events):
        # every row finds the node it hangs on, which is a leaf
        up = child.join(node, [child.rec_id == node.rec_id, child.parent_id == node.id]).select(node.rec_id, node.id, node.name)
        assert {r[2] for r in rows(up)} == {"a"} and up.count() == child.count() == leaves
    up = node.alias("c").join(node.alias("p"), F.expr("c.rec_id = p.rec_id and c.parent_id = p.id and c.parent_table = 'node'"))
    assert up.where("c.parent_path = p.path").count() == node.where("parent_table = 'node'").count() == sum(x[2] != "" for x in got)
    assert set(rows(events, "script_lang")) == {("js",)}
    assert ("1", None) in rows(record, "version", "xfa_template_locale")
    none = spark.createDataFrame([], "rec_id bigint, raw string")
    assert shred.shred(none, "rec_id", "raw", shred.XFA, plan, "node", "node").count() == 0 and shred.schema_graph(none, "raw", shred.XFA).count() == 0


def test_ranges():
    assert pages.parse_ranges("1-3, 6, 9-", 10) == [1, 2, 3, 6, 9, 10]
    assert pages.parse_ranges("3-1", 5) == [3, 2, 1]
    assert pages.parse_ranges("2", 5, {"2": 4}) == [4] and pages.parse_ranges("A-1-A-3", 9, {"A-1": 2, "A-3": 4}) == [2, 3, 4]
    for bad in ("0", "7", "x", "1-9"):
        with pytest.raises(ValueError, match="no page"):
            pages.parse_ranges(bad, 5)


def test_page_sets(spark):
    p = spark.createDataFrame([(1, i, f"l{i}", "x") for i in range(1, 7)] + [(1, 3, "l3", "x"), (1, None, "no", "x")], "doc_id bigint, page int, label string, pos string")
    once = pages.once(p).drop("pos")
    assert rows(pages.move(once, 2, 3, 6), "label", "page") == [("l1", 1), ("l2", 4), ("l3", 5), ("l4", 2), ("l5", 3), ("l6", 6)]
    assert rows(pages.move(once, 5, 6, 2), "label", "page") == [("l1", 1), ("l2", 4), ("l3", 5), ("l4", 6), ("l5", 2), ("l6", 3)]
    assert rows(pages.split_before(once, F.col("page").isin(1, 4)), "page", "part") == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1)]
    sized = once.withColumn("size", F.col("page") * 10)
    assert rows(pages.split_by_size(sized, "size", 60), "page", "part") == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 2), (6, 3)]
    assert rows(pages.bates(once.unionByName(once.withColumn("doc_id", F.lit(2))), 1, 3), "doc_id", "page", "bates")[-1] == (2, 6, "012")
    empty = once.limit(0)
    for f in (lambda d: pages.bates(d), lambda d: pages.split_every(d, 2), lambda d: pages.extract(d, [1]), lambda d: pages.labels(d, spark.createDataFrame([], "doc_id bigint, first int, style string, prefix string, start int"))):
        assert f(empty).count() == 0
    assert pages.extract(once, []).count() == 0


def test_dedupe(spark):
    d = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, ""), (6, "b")], "id bigint, text string")
    assert rows(sets.dedupe(d, ["text"], "id")) == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 5), (6, 6)]
    o = spark.createDataFrame([(1, "x", []), (2, "x", []), (3, "y", [1]), (4, "y", [2]), (5, "z", [3, 9]), (6, "z", [4, 9])], "id bigint, content string, refs array<bigint>")
    assert rows(sets.dedupe_structure(o)) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (None, 1)], "src bigint, dst bigint")
    assert (1, 1, 3) in rows(sets.closure(e)) and len(rows(sets.closure(e))) == 10
    r = spark.createDataFrame([(2, 7), (4, 3), (1, 9)], "id bigint, priority int")
    assert rows(sets.claims(e.where("src is not null"), r)) == [(1, 7), (2, 7), (3, 7), (4, 3), (5, 3)]


def test_deep_graphs(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(70)], "src bigint, dst bigint").coalesce(1)
    r = spark.createDataFrame([(0, 1), (68, 5)], "id bigint, priority int").coalesce(1)
    assert rows(sets.claims(e, r)) == sorted(((i, 1) for i in range(71)), key=str)
    o = spark.createDataFrame([(2 * i + k, "x", [2 * i + k - 2] if i else []) for i in range(20) for k in (0, 1)], "id bigint, content string, refs array<bigint>").coalesce(1)
    assert rows(sets.dedupe_structure(o)) == sorted(((i, i - i % 2) for i in range(40)), key=str)


def test_threads(spark):
    cols = "doc_id bigint, page int, index int, subtype string, author string, contents string, modified string, name string, in_reply_to string, state string, intent string, color string"
    a = spark.createDataFrame(
        [
            (1, 1, 0, "Text", "b", "First", "2", "n1", None, None, None, None), (1, 1, 1, "Text", "a", "re", "3", "n2", "n1", None, None, None), (1, 1, 2, "Text", "a", "", "4", "n3", "n1", "Accepted", None, None),
            (1, 1, 3, "Text", "a", "", "5", "n4", "n1", "Rejected", None, None), (1, 1, 4, "Text", "a", "", "6", "n5", "n1", "Marked", None, None), (1, 2, 0, "Line", None, None, None, "n6", None, None, "LineArrow", None),
        ], cols,
    )
    assert rows(comments.threads(a), "name", "number", "replies", "status", "marked") == [("n1", 1, 1, "Rejected", True), ("n6", 1, 0, None, False)]
    assert rows(comments.search(a, "RE"), "name") == [("n1",)] and rows(comments.summary(a), "page", "text")[0] == (1, "1. b (Sticky note): First")
    assert [r["name"] for r in comments.sort(comments.kind(a), "date", newest_first=True).collect()][-1] == "n6"
    assert comments.threads(a.limit(0)).count() == 0


def test_forms(spark):
    f = spark.createDataFrame(
        [(1, "a", "text", ["x", "y"], None, 0, 2, None), (1, "a", "text", ["x", "y"], None, 0, 2, None), (1, "c", "combo", None, ["p"], 0, None, [("p", "Pen")]), (2, "b", "checkbox", [], None, 0, None, None), (2, "s", "signature", ["z"], None, 0, None, None)],
        "doc_id bigint, name string, kind string, value array<string>, default_value array<string>, flags int, max_len int, options array<struct<export_value:string,display_text:string>>",
    )
    assert rows(forms.spreadsheet(f, forms.first_seen(f))) == [(1, "x, y", "", ""), (2, "", "", "Off")]
    ok, bad = forms.apply_values(f, spark.createDataFrame([(1, "a", "toolong"), (1, "c", "p"), (9, "q", "1")], "doc_id bigint, name string, value string"))
    assert rows(bad, "name", "reason") == [("a", "not allowed"), ("q", "no such field")] and ("c", ["p"]) in rows(ok, "name", "value")
    assert ("c", ["Pen"]) in rows(forms.display(forms.reset(f)), "name", "shown")
    assert "<value>x</value><value>y</value>" in rows(forms.to_xfdf(f), "xml")[0][0] and "/T(a)/V(x, y)" in rows(forms.to_fdf(f), "fdf")[0][0]


def test_display_takes_the_first_of_equal_options(spark):
    f = spark.createDataFrame(
        [
            (1, "twice", ["p", "q", None, "x"], [("p", "Pen"), ("q", "Quill"), ("p", "Pencil")]), (1, "none first", ["p"], [("p", None), ("p", "Pencil")]), (1, "same", ["p"], [("p", "Pen"), ("p", "Pen")]),
            (1, "nulls", ["p", ""], [(None, "Nothing"), None, ("p", "Pen"), ("", "Blank")]), (1, "no options", ["p"], None), (1, "no value", None, [("p", "Pen"), ("p", "Pencil")]),
        ],
        "doc_id bigint, name string, value array<string>, options array<struct<export_value:string,display_text:string>>",
    )
    want = {"twice": ["Pen", "Quill", None, "x"], "none first": ["p"], "same": ["Pen"], "nulls": ["Pen", "Blank"], "no options": ["p"], "no value": []}
    assert dict(rows(forms.display(f), "name", "shown")) == want


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_diff(spark):
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        assert len(diff.matching(a, b)) == lcs(a, b)
        out, at = [], 0
        for _, i, j, p, q in diff.changes(a, b):
            out += a[at:i] + b[p:q]
            at = j
        assert out + a[at:] == b
    long = [str(i) for i in range(8000)]
    assert diff.changes(long, long[:4000] + ["x"] + long[4001:]) == [("replaced", 4000, 4001, 4000, 4001)]
    old = spark.createDataFrame([(1, "the old bridge stood"), (2, None), (3, "same")], "pair_id bigint, text string")
    new = spark.createDataFrame([(1, "the new bridge stood here"), (2, "x"), (3, "same")], "pair_id bigint, text string")
    d = diff.compare(old, new)
    assert rows(d, "pair_id", "kind", "old_text", "new_text") == [(1, "inserted", "", "here"), (1, "replaced", "old", "new"), (2, "inserted", "", "x")]
    assert rows(diff.change_counts(d)) == [(1, 1, 1, 0), (2, 0, 1, 0)] and "+ here" in rows(diff.report(d))[0][1]


def test_diff_of_long_stretches():
    rng = random.Random(8)
    for n in (30, 100, 400):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(n))] for _ in range(2))
        got = diff.matching(a, b)
        assert len(got) == lcs(a, b) and all(a[i] == b[j] for i, j in got) and all(i < p and j < q for (i, j), (p, q) in zip(got, got[1:], strict=False))
    # no word occurs once in both: nothing to hold on to
    a = [w for i in range(4000) for w in ("the", f"a{i % 1500}")]
    b = [w for i in range(4000) for w in ("the", f"b{i % 1500}")]
    assert len(diff.changes(a, b)) == 4000


ELEMS = "doc_id bigint, id bigint, parent_id bigint, preorder int, type string, alt string, page int, summary string, colspan int, rowspan int, has_content boolean, has_annots boolean"


def test_structure_rules(spark):
    def e(i, up, kind, alt=None, content=False, annots=False, cs=None, rs=None):
        return (1, i, up, i, kind, alt, 1, None, cs, rs, content, annots)

    elems = spark.createDataFrame(
        [
            e(1, None, "Document"), e(2, 1, "H1"), e(3, 1, "H3"), e(4, 1, "Figure"), e(5, 1, "Sect", "all"), e(6, 5, "Figure", None, True), e(7, 5, "Figure", "inner", True, True), e(8, 1, "P", "empty"),
            e(10, 1, "Table"), e(11, 10, "TR"), e(12, 11, "TD", cs=2), e(13, 10, "TR"), e(14, 13, "TD"), e(15, 13, "TD"), e(20, 1, "Table"), e(21, 20, "TR"), e(22, 21, "TH", rs=2), e(23, 21, "TH"), e(24, 20, "TR"), e(25, 24, "TD"), e(26, 24, "TD"),
            e(30, 1, "TR"), e(31, 1, "TD"), e(32, 1, "LI"), e(33, 1, "Lbl"),
        ], ELEMS,
    )
    got = {k: v.count() for k, v in rules.structure_rules(elems).items()}
    assert got == {
        "figures-alt-text": 1, "other-elements-alt-text": 0, "nested-alt-text": 1, "alt-text-associated": 1, "alt-text-hides-annotation": 2, "table-rows": 1, "table-cells": 1,
        "table-headers": 1, "table-regularity": 1, "table-summary": 2, "list-items": 1, "lbl-lbody": 1, "heading-nesting": 1,
    }
    docs = spark.createDataFrame([(1, 512, True, True, True, "en", "t", True, 3, False), (2, 0, False, True, None, None, " ", False, 30, False)], "doc_id bigint, permissions int, has_text boolean, has_images boolean, tagged boolean, lang string, title string, display_title boolean, page_count int, has_outline boolean")
    report = rules.check(docs, elems=elems)
    assert report.count() == 2 * len(rules.RULES)
    assert {r["rule"] for r in report.where("doc_id = 2 and status = 'Failed'").collect()} == {"permission-flag", "image-only", "tagged-pdf", "primary-language", "title", "bookmarks"}
    assert rules.status_counts(report).where("doc_id = 1 and category = 'Document'").first()["Passed"] == 6


def test_layout(spark):
    boxes = [(1, 1, i, [float(x), float(y), x + 30.0, y + 10.0], t) for i, (x, y, t) in enumerate([(0, 0, "Title"), (0, 20, "a"), (100, 20, "b"), (1, 34, "c"), (101, 35, "d"), (0, 60, "end")])]
    df = spark.createDataFrame(boxes, "doc_id bigint, page int, id bigint, rect array<double>, text string")
    assert rows(layout.tables(df), "row", "column", "text") == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d")]
    assert rows(layout.reading_rows(df), "id", "row") == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2), (5, 3)]
    lines = spark.createDataFrame([(1, 1, 1, "Name: ______"), (1, 1, 2, "[ ] I agree"), (1, 1, 3, "text")], "doc_id bigint, page int, line int, text string")
    assert rows(layout.field_candidates(lines), "kind", "label") == [("checkbox", "I agree"), ("text", "Name")]
    sizes = spark.createDataFrame([(1, "body text", 10.0), (1, "H", 20.0), (2, "x", 9.0), (2, "y", 8.0)], "doc_id bigint, text string, size double")
    assert rows(layout.body_size(sizes)) == [(1, 10.0), (2, 8.0)]


def test_partitioning_changes_nothing(spark):
    from inkquarry.plans.core import q_page_text  # noqa: F401

    g = spark.read.parquet("/root/testdata/sf0.001/glyphs.parquet")
    assert rows(textlines.glyph_lines(g.repartition(7))) == rows(textlines.glyph_lines(g.coalesce(1)))
