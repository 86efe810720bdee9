"""Edits, pipelines, audits, node paths and form data on small literal tables: nulls, empty tables, ties, circles."""

import pytest
from pyspark.sql import functions as F

from inkquarry import session
from inkquarry.functions import formcalc as fc
from inkquarry.functions import som
from inkquarry.operators import actions, audit, diff, edits, forms, layout, pages, rules, sets
from inkquarry.sources import formdata


def rows(df, *by):
    return sorted((tuple(r) for r in (df.select(*by) if by else df).collect()), key=str)


A = "doc_id bigint, page int, index int, name string, in_reply_to string, subtype string, author string, contents string, state string, locked boolean, rect array<double>, extra string"


def annotations(spark):
    box = [0.0, 0.0, 10.0, 10.0]
    data = [
        (1, 1, 0, "a", None, "Text", "x", "root", None, False, box, "e"), (1, 1, 1, "b", "a", "Text", None, "reply", None, None, box, "e"), (1, 1, 2, "c", "b", "Text", "y", "deep", None, True, box, "e"),
        (1, 1, 3, "d", None, "Ink", "y", None, None, True, box, "e"), (1, 2, 0, "p", "q", "Text", "y", "circle", None, False, box, "e"), (1, 2, 1, "q", "p", "Text", "y", "circle", None, False, box, "e"), (2, 1, 0, None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(data, A)


def test_annotation_edits(spark):
    a = annotations(spark)
    at = lambda *x, **c: spark.createDataFrame([tuple(x)], "doc_id bigint, page int, index int" + "".join(f", {k} {t}" for k, t in c.items()))
    left = edits.delete_annotations(a, at(1, 1, 0))
    assert rows(left.where("doc_id = 1 and page = 1"), "name", "index") == [("d", 0)]
    assert rows(edits.delete_annotations(a, at(1, 2, 0)).where("page = 2")) == []
    # a locked one stays, and what is not there changes nothing
    assert edits.delete_annotations(a, at(1, 1, 3)).count() == edits.delete_annotations(a, at(9, 9, 9)).count() == 7
    moved = edits.move(a, at(1, 1, 3, 5.0, 5.0, dx="double", dy="double").unionByName(at(2, 1, 0, 1.0, 1.0, dx="double", dy="double")))
    assert rows(moved, "rect") == rows(a, "rect")
    assert rows(edits.lock(a, at(1, 1, 3, False, locked="boolean")).where("name = 'd'"), "locked") == [(False,)]
    styled = edits.style(a, at(1, 1, 0, 0.5, opacity="double").unionByName(at(1, 1, 0, 0.7, opacity="double")))
    assert rows(styled.where("opacity is not null"), "name", "opacity") == [("a", 0.7)]
    info = edits.set_annotation_info(a, at(1, 1, 0, None, "s", author="string", subject="string"))
    assert rows(info.where("name = 'a'"), "author", "subject", "extra") == [("x", "s", "e")]
    said = edits.reply(a, at(1, 1, 0, "yes", "me", contents="string", author="string"))
    assert rows(said.where("contents = 'yes'"), "index", "in_reply_to") == [(4, "a")]
    none = a.limit(0)
    for f in (edits.delete_annotations, lambda d, k: edits.lock(d, k.withColumn("locked", F.lit(True))), lambda d, k: edits.resize(d, k.withColumn("rect", F.array(F.lit(1.0))))):
        assert f(none, at(1, 1, 0)).count() == 0
        assert f(a, at(1, 1, 0).limit(0)).count() == 7


O = "doc_id bigint, path array<int>, title string, page int"


def test_bookmark_edits(spark):
    o = spark.createDataFrame([(1, [0], "a", 1), (1, [0, 0], "a0", 2), (1, [0, 1], "a1", 3), (1, [1], "b", 4), (2, [0], "z", 1)], O)
    ask = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    add = edits.add_bookmarks(o, ask([(1, [0], 1, "new", 9), (2, [0], 7, "in", 9)], "doc_id bigint, parent array<int>, position int, title string, page int"))
    assert rows(add, "doc_id", "path", "title") == sorted([(1, [0], "a"), (1, [0, 0], "a0"), (1, [0, 1], "new"), (1, [0, 2], "a1"), (1, [1], "b"), (2, [0], "z"), (2, [0, 0], "in")], key=str)
    gone = edits.delete_bookmarks(o, ask([(1, [0]), (2, [5]), (3, [0])], "doc_id bigint, path array<int>"))
    assert rows(gone, "doc_id", "path", "title") == [(1, [0], "b"), (2, [0], "z")]
    move = "doc_id bigint, path array<int>, parent array<int>, position int"
    assert rows(edits.move_bookmarks(o, ask([(1, [1], [0], 0)], move)).where("doc_id = 1"), "path", "title") == [([0, 0], "b"), ([0, 1], "a0"), ([0, 2], "a1"), ([0], "a")]
    # below itself, or one that isn't there
    for m in ((1, [0], [0, 1], 0), (1, [7], [], 0)):
        assert rows(edits.move_bookmarks(o, ask([m], move))) == rows(o)
    assert edits.delete_bookmarks(o.limit(0), ask([(1, [0])], "doc_id bigint, path array<int>")).count() == 0


def test_field_and_box_edits(spark):
    f = spark.createDataFrame([(1, "a", "text", 1, [0.0, 9.0, 1.0, 10.0]), (1, "a.b", "text", 1, None), (1, "ab", "text", 1, [5.0, 1.0, 6.0, 2.0]), (1, "c", "text", None, None)], "doc_id bigint, name string, kind string, page int, rect array<double>")
    assert rows(edits.delete_fields(f, f.where("name = 'a'")), "name") == [("ab",), ("c",)]
    t = edits.set_tab_order(f, "row")
    assert rows(t.where("page = 1"), "name", "tab") == [("a", 1), ("a.b", 2), ("ab", 0)]
    assert rows(edits.move_in_tab_order(t, t.where("name = 'ab'"), earlier=True)) == rows(t)
    assert rows(edits.move_in_tab_order(t, t.where("name = 'a'"), earlier=True).where("page = 1"), "name", "tab") == [("a", 0), ("a.b", 2), ("ab", 1)]
    p = spark.createDataFrame([(1, 1, [0.0, 0.0, 100.0, 100.0]), (1, 2, [0.0, 0.0, 100.0, 100.0])], "doc_id bigint, page int, media array<double>")
    cut = edits.set_page_box(p, spark.createDataFrame([(1, 1, [50.0, 50.0, 200.0, 200.0]), (1, 2, [150.0, 0.0, 200.0, 9.0])], "doc_id bigint, page int, rect array<double>"), "crop")
    assert rows(cut, "page", "crop") == [(1, [50.0, 50.0, 100.0, 100.0]), (2, None)]
    with pytest.raises(ValueError, match="no such box"):
        edits.set_page_box(p, p, "nothing")


def test_several_values(spark):
    fields = spark.createDataFrame([(1, "many", "list", ["x"], 1 << 21, None, [("x", "X"), ("y", "Y")]), (1, "one", "list", ["x"], 0, None, [("x", "X"), ("y", "Y")]), (1, "t", "text", None, 0, 3, None)], "doc_id bigint, name string, kind string, value array<string>, flags int, max_len int, options array<struct<export_value:string,display_text:string>>")
    given = spark.createDataFrame([(1, "many", "y", 0), (1, "many", "x", 1), (1, "one", "x", 0), (1, "one", "y", 1), (1, "t", "long", 0), (1, "none", "v", 0)], "doc_id bigint, name string, value string, seq int")
    filled, bad = forms.apply_values(fields, given)
    assert rows(filled, "name", "value") == [("many", ["y", "x"]), ("one", ["x"]), ("t", None)]
    assert rows(bad, "name", "value", "reason") == [("none", "v", "no such field"), ("one", "x", "not allowed"), ("one", "y", "not allowed"), ("t", "long", "not allowed")]


def test_snap_and_scales(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0), (1, 1, 4.0, -5.0, 4.0, 5.0), (1, 1, 7.0, 7.0, 7.0, 7.0)], "doc_id bigint, page int, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([(1, 1, 1, 4.2, 0.1), (1, 1, 2, 9.9, 0.2), (1, 1, 3, 2.0, 0.3), (1, 1, 4, 50.0, 50.0), (1, 1, 5, 7.1, 7.0)], "doc_id bigint, page int, id int, x double, y double")
    assert rows(edits.snap(p, s, 0.5), "id", "snap", "sx", "sy") == [(1, "intersection", 4.0, 0.0), (2, "endpoint", 10.0, 0.0), (3, "path", 2.0, 0.0), (4, None, None, None), (5, "endpoint", 7.0, 7.0)]
    assert edits.snap(p.limit(0), s, 1.0).count() == 0 and rows(edits.snap(p, s.limit(0), 1.0), "snap") == [(None,)] * 5


def test_certificate_chains_in_circles(spark):
    c = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "r", "r"), (4, "s", "r"), (5, "t", "none")], "id bigint, subject string, issuer string")
    assert rows(rules.certificate_chains(c), "id", "complete") == [(1, False), (2, False), (3, True), (4, True), (5, False)]
    assert rules.certificate_chains(c.limit(0)).count() == 0


def test_nearest_above(spark):
    e = spark.createDataFrame([(1, 1, None, True), (1, 2, 1, False), (1, 3, 2, False), (1, 4, 3, True), (1, 5, 4, False), (1, 6, 99, False)], "doc_id bigint, id int, parent_id int, goal boolean")
    assert rows(rules.nearest(e, F.col("goal"))) == [(1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 5, 4)]


def test_unknown_facts_are_skipped(spark):
    docs = spark.createDataFrame([(1, "t", None, 30), (2, "", True, None)], "doc_id bigint, title string, has_outline boolean, page_count int")
    got = {(r["doc_id"], r["rule"]): r["status"] for r in rules.check(docs).collect()}
    assert got[1, "title"] == "Passed" and got[2, "title"] == "Failed" and got[1, "bookmarks"] == got[2, "bookmarks"] == "Skipped" and got[1, "permission-flag"] == "Skipped" and got[1, "color-contrast"] == "Manual"


def test_language_with_loops_and_functions(spark):
    one = lambda script, **k: spark.range(1).select(fc.formcalc(script, {}, k).cast("string").alias("v")).first()["v"]
    assert one("var t = 0\nfor i = 5 downto 1 step 2 do t = t + i endfor\nt") == "9.0"
    assert one("for i = 2 upto 1 do 5 endfor") is None
    assert one("func f(a, b) do a - b endfunc\nf(5, 2) * f(1)") == "3.0"
    many = F.array(F.lit("3"), F.lit(None), F.lit("x"), F.lit("4"))
    assert one("Sum(v[*], 1)", v=many) == "8.0" and one("v[3] + v[9]", v=many) == "4.0" and one("Count(v[*])", v=many) == "3.0" and one("Exists(v) + Exists(w)", v=many) == "1.0"
    for bad in ("while (1) do 1 endwhile", "for i = x upto 3 do 1 endfor", "for i = 1 upto 9999 do 1 endfor", "func f(a) do f(a) endfunc\nf(1)", 'Format(1, 2)', "Get(\"x\")"):
        with pytest.raises(fc.FormCalcError):
            fc.formcalc(bad, {}, {})
    assert fc.names('var t = a.b + Sum(c, t)\nif (d > 1) then "e" else t endif') == ["a.b", "c", "d"]


def test_node_paths(spark):
    n = spark.createDataFrame([(1, p) for p in ("f[0]", "f[0].a[0]", "f[0].a[1]", "f[0].a[1].t[0]", "f[0].t[0]", "f[0].b[0].c[0].t[2]")], "rec_id bigint, path string")
    assert rows(som.find(n, "f.a[*]"), "path") == [("f[0].a[0]",), ("f[0].a[1]",)] and rows(som.find(n, "$form..t[*]"), "path") == [("f[0].a[1].t[0]",), ("f[0].b[0].c[0].t[2]",), ("f[0].t[0]",)]
    assert rows(som.find(n, "$form"), "path") == [("f[0]",)]
    refs = spark.createDataFrame([(1, "f[0].a[1]", "t"), (1, "f[0].a[0]", "t"), (1, "f[0].a[1].t[0]", "parent.parent.a[0]"), (1, "f[0]", "none"), (1, "f[0]", "$.a[1].t")], "rec_id bigint, context string, name string")
    assert {(r["context"], r["name"]): r["found"] for r in som.resolve(n, refs).collect()} == {("f[0].a[1]", "t"): "f[0].a[1].t[0]", ("f[0].a[0]", "t"): "f[0].t[0]", ("f[0].a[1].t[0]", "parent.parent.a[0]"): "f[0].a[0]", ("f[0]", "none"): None, ("f[0]", "$.a[1].t"): "f[0].a[1].t[0]"}


def test_form_data_files(spark):
    files = {
        "a.fdf": b"%FDF-1.2\n1 0 obj<</FDF<</Fields[<</T(top)/Kids[<</T(x\\)y)/V(a\\(b\\050)>><</T(many)/V[(1)(2)]>>]>><</T(box)/V/Yes>><</V(no name)>>]>>>>endobj", "b.xfdf": b"<xfdf><fields><field name='g'><field name='h'><value>1</value><value>2</value></field></field></fields></xfdf>",
        "c.tsv": "﻿a\tb\n1\té\n3\t4\n".encode(), "d.xml": b"<data><rec><a>1</a></rec><rec><a>2</a></rec></data>", "e.csv": b"", "f.xml": b"<broken>", "g.bin": b"x", "h.csv": b"only,header\n",
    }
    df = spark.createDataFrame([*files.items(), ("n.csv", None), (None, b"x")], "path string, content binary")
    assert rows(formdata.parse(df), "path", "name", "value") == sorted([
        ("a.fdf", "top.x)y", "a(b("), ("a.fdf", "top.many", "1"), ("a.fdf", "top.many", "2"), ("a.fdf", "box", "Yes"), ("b.xfdf", "g.h", "1"), ("b.xfdf", "g.h", "2"), ("c.tsv", "a", "1"), ("c.tsv", "b", "é"), ("d.xml", "a", "1")], key=str)


def test_audits(spark):
    claims = spark.createDataFrame([(1, 1, "Fonts", 10), (1, 1, "Images", 10), (1, 2, "Forms", None), (1, 3, "nothing", 5)], "doc_id bigint, num bigint, category string, bytes bigint")
    files = spark.createDataFrame([(1, 40), (2, 0)], "doc_id bigint, file_size bigint")
    assert rows(audit.space_by_category(claims, files)) == sorted([(1, "Images", 10, 25.0), (1, "Forms", None, None), (1, "Document Overhead", 30, 75.0), (2, "Document Overhead", 0, None)], key=str)
    f = spark.createDataFrame([("b10", 1), ("b9", 1), ("a", None)], "name string, size int")
    assert [r["name"] for r in audit.combine_order(f, "size").orderBy("place").collect()] == ["b9", "b10", "a"] == [r["name"] for r in audit.combine_order(f, "size", descending=True).orderBy("place").collect()]
    assert audit.image_ppi(spark.createDataFrame([(1, 1, 100, 100, 0.0, 50.0)], "doc_id bigint, image bigint, pixels_x int, pixels_y int, width double, height double")).first()["ppi"] == 144.0


def test_images_that_differ(spark):
    a, b = bytes(4 * 20 * 20), bytearray(4 * 30 * 20)
    b[4 * (30 * 3 + 2)] = 200
    pairs = spark.createDataFrame([(1, 20, 20, a, 30, 20, bytes(b)), (2, 20, 20, a, 20, 20, a), (3, 0, 0, b"", 0, 0, b"")], "pair_id bigint, width_a int, height_a int, a binary, width_b int, height_b int, b binary")
    assert rows(diff.visual_regions(pairs)) == [(1, 0, 0, 30, 20)] or rows(diff.visual_regions(pairs)) == [(1, 0, 0, 8, 8), (1, 16, 0, 30, 20)]


def test_blocks_and_spans(spark):
    lines = spark.createDataFrame([(1, 1, 0, "A long be-", [0.0, 0.0, 90.0, 10.0], 10.0), (1, 1, 1, "ginning", [0.0, 12.0, 50.0, 22.0], 10.0), (1, 1, 2, "Next", [0.0, 60.0, 50.0, 70.0], 10.0)], "doc_id bigint, page int, line int, text string, rect array<double>, size double")
    assert rows(layout.text_blocks(lines), "block", "first_line", "last_line", "text") == [(0, 0, 1, "A long beginning"), (1, 2, 2, "Next")]
    assert layout.text_blocks(lines.limit(0)).count() == 0


def test_page_choice(spark):
    p = spark.createDataFrame([(1, 1, "2"), (1, 2, "x"), (2, 1, None), (2, 2, None)], "doc_id bigint, page int, label string")
    assert rows(pages.by_label(p, spark.createDataFrame([(1, "2"), (2, "2"), (3, "2")], "doc_id bigint, wanted string")), "doc_id", "page") == [(1, 1), (2, 2)]
    assert rows(pages.combine_selected([(p, [2, 1]), (p, [2])]).where("doc_id = 1"), "source", "page", "label") == [(0, 1, "x"), (0, 2, "2"), (1, 3, "x")]


def test_pipelines(spark):
    t = {"pages": spark.createDataFrame([(1, 1), (1, 2)], "doc_id bigint, page int"), "files": spark.createDataFrame([(1, "t", True)], "doc_id bigint, title string, has_javascript boolean")}
    assert rows(actions.run(t, "Add Page Numbers")["pages"], "footer") == [("Page 1 of 2",), ("Page 2 of 2",)]
    assert rows(actions.run(t, "Sanitize Documents")["files"]) == [(1, None, None)]
    with pytest.raises(ValueError, match="no such table"):
        edits.batch(t, [("nothing", lambda x: x)])


def test_hot_duplicates_and_clean_up(spark):
    d = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}") for i in range(200)], "id bigint, text string")
    assert {(r["id"], r["keep"]) for r in sets.dedupe(d, ["text"], "id").collect()} == {(i, 1 if i % 2 else i) for i in range(200)}
    kept = session.stored(d, "clean-up")
    assert kept.count() == 200 and session.clear(spark) >= 1 and not session._WRITTEN
