"""Rule checks as unions of queries: accessibility (32 rules), archive conformance, hidden information, signatures.

Tables: ``docs`` has one row for each document, ``pages`` one for each page, ``elems`` the structure elements
(doc_id, id, parent_id, preorder, type, alt, page, summary, colspan, rowspan, has_content, has_annots). Findings are
``(doc_id, rule, page, message)``; a document without findings of a rule passed it. A rule whose table or columns are not
given, or whose facts are null for a document, is skipped: nothing is made up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Rules in their order, with their category. Manual ones only ask for a look.
RULES = (
    ("permission-flag", "Document"), ("image-only", "Document"), ("tagged-pdf", "Document"), ("logical-reading-order", "Document"), ("primary-language", "Document"), ("title", "Document"), ("bookmarks", "Document"), ("color-contrast", "Document"),
    ("tagged-content", "PageContent"), ("tagged-annotations", "PageContent"), ("tab-order", "PageContent"), ("character-encoding", "PageContent"), ("tagged-multimedia", "PageContent"), ("screen-flicker", "PageContent"), ("scripts", "PageContent"), ("timed-responses", "PageContent"), ("navigation-links", "PageContent"),
    ("tagged-form-fields", "Forms"), ("field-descriptions", "Forms"),
    ("figures-alt-text", "AlternateText"), ("nested-alt-text", "AlternateText"), ("alt-text-associated", "AlternateText"), ("alt-text-hides-annotation", "AlternateText"), ("other-elements-alt-text", "AlternateText"),
    ("table-rows", "Tables"), ("table-cells", "Tables"), ("table-headers", "Tables"), ("table-regularity", "Tables"), ("table-summary", "Tables"),
    ("list-items", "Lists"), ("lbl-lbody", "Lists"), ("heading-nesting", "Headings"),
)
MANUAL = frozenset({"logical-reading-order", "color-contrast", "screen-flicker", "scripts", "timed-responses", "navigation-links"})
MOST = 200


def _finding(df: DataFrame, rule: str, message: str, page: Column | None = None) -> DataFrame:
    return df.select("doc_id", F.lit(rule).alias("rule"), (page if page is not None else F.lit(None)).cast("int").alias("page"), F.lit(message).alias("message"))


#: What each document rule must know.
_NEEDS = {"permission-flag": ("permissions",), "image-only": ("has_text", "has_images"), "tagged-pdf": (), "primary-language": (), "title": (), "bookmarks": ("page_count", "has_outline")}
_COLUMNS = {"tagged-pdf": ("tagged",), "primary-language": ("lang",), "title": ("title",)}


def document_rules(docs: DataFrame) -> dict[str, DataFrame]:
    """Over docs(doc_id, permissions, has_text, has_images, tagged, lang, title, display_title, page_count, has_outline), as far as they are there."""
    c = F.col
    blank = lambda x: F.trim(F.coalesce(c(x), F.lit(""))) == ""
    hidden = ~F.coalesce("display_title", F.lit(False)) if "display_title" in docs.columns else F.lit(False)
    bad = {
        "permission-flag": (lambda: c("permissions").bitwiseAND(1 << 9) == 0, "extraction for accessibility is not allowed"),
        "image-only": (lambda: ~c("has_text") & c("has_images"), "pages are images without text"),
        "tagged-pdf": (lambda: ~F.coalesce("tagged", F.lit(False)), "the document is not tagged"),
        "primary-language": (lambda: blank("lang"), "no language"),
        "title": (lambda: blank("title") | hidden, "no title, or it is not shown"),
        "bookmarks": (lambda: (c("page_count") > 20) & ~c("has_outline"), "more than 20 pages without bookmarks"),
    }
    known = {r for r in bad if {*_NEEDS[r], *_COLUMNS.get(r, ())} <= set(docs.columns)}
    return {r: _finding(docs.where(f()), r, message) for r, (f, message) in bad.items() if r in known}


def page_rules(pages: DataFrame | None, annotations: DataFrame | None, fonts: DataFrame | None, fields: DataFrame | None) -> dict[str, DataFrame]:
    """Over pages(doc_id, page, untagged, has_annots, tabs), annotations(doc_id, page, subtype, tagged), fonts(doc_id, page, name, maps_to_unicode), fields(doc_id, name, tooltip, page)."""
    out: dict[str, DataFrame] = {}
    if pages is not None:
        out["tagged-content"] = _finding(pages.where("untagged > 0"), "tagged-content", "content outside the structure", F.col("page"))
        out["tab-order"] = _finding(pages.where(F.col("has_annots") & ~F.coalesce(F.col("tabs") == "S", F.lit(False))), "tab-order", "tab order doesn't follow the structure", F.col("page"))
    if annotations is not None:
        kinds = {"tagged-form-fields": F.col("subtype") == "Widget", "tagged-multimedia": F.col("subtype").isin("Movie", "Sound", "Screen", "RichMedia", "3D")}
        kinds["tagged-annotations"] = ~(kinds["tagged-form-fields"] | kinds["tagged-multimedia"] | F.col("subtype").isin("Popup", "Link"))
        for rule, of in kinds.items():
            out[rule] = _finding(annotations.where(of & ~F.coalesce("tagged", F.lit(False))), rule, "not in the structure", F.col("page"))
    if fonts is not None:
        bad = fonts.where(~F.col("maps_to_unicode")).groupBy("doc_id", "name").agg(F.min("page").alias("page"))
        out["character-encoding"] = _finding(bad, "character-encoding", "characters without a meaning", F.col("page"))
    if fields is not None:
        named = fields.where(F.col("tooltip").isNull() | (F.trim("tooltip") == "")).groupBy("doc_id", "name").agg(F.min("page").alias("page"))
        out["field-descriptions"] = _finding(named, "field-descriptions", "field without a description", F.col("page"))
    return out


def _has_alt() -> Column:
    return F.trim(F.coalesce("alt", F.lit(""))) != ""


def nearest(elems: DataFrame, goal: Column) -> DataFrame:
    """``doc_id, id, above``: the nearest element above each one for which ``goal`` holds, where there is one.

    Pointers double their reach each round, so a round has one row for each element and depth n takes log n rounds.
    """
    up = elems.select("doc_id", F.col("id").alias("parent_id"), F.coalesce(goal, F.lit(False)).alias("found"))
    now = elems.where("parent_id is not null").select("doc_id", "id", "parent_id").join(up, ["doc_id", "parent_id"]).select("doc_id", "id", F.col("parent_id").alias("above"), "found")
    now = stored(now, "rules-above")
    while not now.where("not found").isEmpty():
        there = now.select("doc_id", F.col("id").alias("above"), F.col("above").alias("next"), F.col("found").alias("hit"))
        step = now.where("not found").join(there, ["doc_id", "above"]).select("doc_id", "id", F.col("next").alias("above"), F.col("hit").alias("found"))
        now = stored(now.where("found").unionByName(step), "rules-above")
    return now.select("doc_id", "id", "above")


def structure_rules(elems: DataFrame) -> dict[str, DataFrame]:
    e, page = elems, F.col("page")
    ids = ["doc_id", "id"]
    alt = e.where(_has_alt())
    over = nearest(e, _has_alt())
    below_alt = over.select(*ids)

    def covered(what: str) -> DataFrame:
        """Elements with alternate text that have it themselves or anywhere below."""
        has = e.where(F.coalesce(what, F.lit(False)))
        fresh = stored(has.join(alt.select(*ids), ids, "left_semi").select(*ids).unionByName(has.join(over, ids).select("doc_id", F.col("above").alias("id"))).distinct(), "rules-covered")
        every = fresh
        # from one alternate text to the next above: as many rounds as these are nested
        while not fresh.isEmpty():
            fresh = stored(fresh.join(over, ids).select("doc_id", F.col("above").alias("id")).distinct().join(every, ids, "left_anti"), "rules-covered")
            every = every.unionByName(fresh)
        return every

    parent = e.select(F.col("doc_id"), F.col("id").alias("parent_id"), F.col("type").alias("parent_type"))
    p = e.join(parent, ["doc_id", "parent_id"], "left").withColumn("parent_type", F.coalesce("parent_type", F.lit("")))

    def lacks(types: tuple[str, ...], rule: str) -> DataFrame:
        return _finding(e.where(F.col("type").isin(*types) & ~_has_alt()).join(below_alt, ids, "left_anti"), rule, "no alternate text", page)

    tables = e.where("type = 'Table'")
    cells = p.where(F.col("type").isin("TH", "TD")).select("doc_id", F.col("parent_id").alias("row_id"), "type", "preorder", F.coalesce("colspan", F.lit(1)).alias("cs"), F.coalesce("rowspan", F.lit(1)).alias("rs"))
    of_table = e.where("type = 'TR'").select("doc_id", "id", F.col("preorder").alias("row_at")).join(nearest(e, F.col("type") == "Table"), ids)
    of_table = of_table.select("doc_id", F.col("id").alias("row_id"), "row_at", F.col("above").alias("table_id")).join(tables.select("doc_id", F.col("id").alias("table_id"), F.col("page").alias("table_page")), ["doc_id", "table_id"])
    rows = of_table.join(cells, ["doc_id", "row_id"], "left")
    heads = rows.groupBy("doc_id", "table_id").agg(F.max(F.col("type") == "TH").alias("h"))
    no_heads = tables.join(heads.withColumnRenamed("table_id", "id"), ["doc_id", "id"], "left").where(~F.coalesce("h", F.lit(False)))
    level = F.when(F.col("type").rlike("^H[1-6]$"), F.substring("type", 2, 1).cast("int"))
    w = Window.partitionBy("doc_id").orderBy("preorder")
    heads_in = e.withColumn("level", level).where("level is not null").withColumn("before", F.lag("level", 1, 0).over(w))
    return {
        "figures-alt-text": lacks(("Figure",), "figures-alt-text"),
        "other-elements-alt-text": lacks(("Formula",), "other-elements-alt-text"),
        "nested-alt-text": _finding(alt.join(below_alt, ids, "left_semi"), "nested-alt-text", "alternate text inside alternate text is never read", page),
        "alt-text-associated": _finding(alt.join(covered("has_content"), ids, "left_anti"), "alt-text-associated", "alternate text without content", page),
        "alt-text-hides-annotation": _finding(alt.join(covered("has_annots"), ids, "left_semi"), "alt-text-hides-annotation", "alternate text hides an annotation", page),
        "table-rows": _finding(p.where((F.col("type") == "TR") & ~F.col("parent_type").isin("Table", "THead", "TBody", "TFoot")), "table-rows", "row outside a table", page),
        "table-cells": _finding(p.where(F.col("type").isin("TH", "TD") & (F.col("parent_type") != "TR")), "table-cells", "cell outside a row", page),
        "table-headers": _finding(no_heads, "table-headers", "table without headers", page),
        "table-regularity": _finding(irregular_tables(rows), "table-regularity", "rows of unequal length", page),
        "table-summary": _finding(tables.where(F.trim(F.coalesce("summary", F.lit(""))) == ""), "table-summary", "table without a summary", page),
        "list-items": _finding(p.where((F.col("type") == "LI") & (F.col("parent_type") != "L")), "list-items", "item outside a list", page),
        "lbl-lbody": _finding(p.where(F.col("type").isin("Lbl", "LBody") & ~F.col("parent_type").isin("LI", "TOCI", "BibEntry", "Note", "FENote")), "lbl-lbody", "label or body outside an item", page),
        "heading-nesting": _finding(heads_in.where("level > before + 1"), "heading-nesting", "a heading level is left out", page),
    }


def irregular_tables(rows: DataFrame) -> DataFrame:
    """``doc_id, id, page`` of tables whose rows differ in width, spans counted. The group is one table."""
    per = rows.groupBy("doc_id", "table_id").agg(F.first("table_page").alias("page"), F.array_sort(F.collect_list(F.struct("row_at", "row_id", "cs", "rs"))).alias("c"))
    ordered = F.aggregate(
        "c",
        F.expr("cast(array() as array<struct<row:bigint,width:int,own:int,spans:array<struct<cs:int,rs:int>>>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["row"] == x["row_id"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(x["row_id"].cast("bigint").alias("row"), (F.element_at(acc, -1)["width"] + F.coalesce(x["cs"], F.lit(0))).cast("int").alias("width"), F.lit(0).alias("own"), F.concat(F.element_at(acc, -1)["spans"], F.array(F.struct(x["cs"].cast("int").alias("cs"), x["rs"].cast("int").alias("rs")))).alias("spans")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["row_id"].cast("bigint").alias("row"), F.coalesce(x["cs"], F.lit(0)).cast("int").alias("width"), F.lit(0).alias("own"), F.array(F.struct(x["cs"].cast("int").alias("cs"), x["rs"].cast("int").alias("rs"))).alias("spans"))))),
    )
    # what cells of rows above reach down into this row
    full = F.transform(ordered, lambda r, i: r["width"] + F.aggregate(F.slice(ordered, 1, i), F.struct(F.lit(0).alias("k"), F.lit(0).alias("s")), lambda acc, a: F.struct((acc["k"] + 1).alias("k"), (acc["s"] + F.aggregate(F.filter(a["spans"], lambda x: F.coalesce(x["rs"], F.lit(1)) > i - acc["k"]), F.lit(0), lambda t, x: t + F.coalesce(x["cs"], F.lit(0)))).alias("s")))["s"])
    return per.where(F.size(F.array_distinct(full)) > 1).select("doc_id", F.col("table_id").alias("id"), "page")


def check(docs: DataFrame, pages=None, annotations=None, fonts=None, fields=None, elems=None) -> DataFrame:
    """``doc_id, rule, category, status, findings, more``: the whole report. At most MOST findings of a rule are listed, the rest counted."""
    found: dict[str, DataFrame] = document_rules(docs) | page_rules(pages, annotations, fonts, fields)
    if elems is not None:
        found |= structure_rules(elems)
    every = None
    for f in found.values():
        every = f if every is None else every.unionByName(f)
    if every is None:
        every = _finding(docs.where("false"), "", "")
    ranked = every.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "rule").orderBy("page", "message")))
    per = ranked.groupBy("doc_id", "rule").agg(F.array_sort(F.collect_list(F.when(F.col("k") <= MOST, F.struct("page", "message")))).alias("findings"), F.greatest(F.count("*") - MOST, F.lit(0)).alias("more"))
    rules = docs.sparkSession.createDataFrame([(i, r, c, r in MANUAL, r in found) for i, (r, c) in enumerate(RULES)], "n int, rule string, category string, manual boolean, run boolean")
    j = docs.crossJoin(F.broadcast(rules)).join(per, ["doc_id", "rule"], "left")
    unknown = F.lit(False)
    for rule, needs in _NEEDS.items():
        for x in needs:
            if x in docs.columns:
                unknown = unknown | ((F.col("rule") == rule) & F.col(x).isNull())
    status = F.when(F.col("manual"), "Manual").when(~F.col("run") | unknown, "Skipped").when(F.col("findings").isNotNull(), "Failed").otherwise("Passed")
    return j.select("doc_id", "n", "rule", "category", status.alias("status"), "findings", F.coalesce("more", F.lit(0)).alias("more"))


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("doc_id", "category").pivot("status", ["Passed", "Failed", "Manual", "Skipped"]).count().fillna(0)


def heading_nesting(headings: DataFrame) -> DataFrame:
    """Headings ``doc_id, preorder, level`` that leave a level out."""
    w = Window.partitionBy("doc_id").orderBy("preorder")
    return headings.withColumn("before", F.lag("level", 1, 0).over(w)).where("level > before + 1")


# archive conformance: clause, message and whether a writer could mend it, over tables of the documents

_FORBIDDEN_ACTIONS = ("Launch", "Sound", "Movie", "ResetForm", "ImportData", "Hide", "SetOCGState", "Rendition", "Trans", "GoTo3DView", "JavaScript")
_FORBIDDEN_ANNOTATIONS = ("3D", "Sound", "Screen", "Movie")


def conformance(docs: DataFrame, annotations: DataFrame, fonts: DataFrame, streams: DataFrame, actions: DataFrame, part: str = "2b") -> DataFrame:
    """``doc_id, clause, message, page, fixable``.

    docs(doc_id, has_xmp, xmp_part, xmp_title, title, encrypted, has_output_intent, device_rgb, device_cmyk, catalog_aa, has_javascript, need_appearances, embedded_files, af_relationship);
    annotations(doc_id, page, subtype, flags, has_appearance, has_aa); fonts(doc_id, name, embedded);
    streams(doc_id, filter, external, interpolate, alternates, postscript); actions(doc_id, page, owner, kind).
    """

    def issue(df: DataFrame, clause: str, message: str, fixable: bool, page: Column | None = None) -> DataFrame:
        return df.select("doc_id", F.lit(clause).alias("clause"), F.lit(message).alias("message"), (page if page is not None else F.lit(None)).cast("int").alias("page"), F.lit(fixable).alias("fixable"))

    c, page = F.col, F.col("page")
    hidden = c("flags").bitwiseAND(2 | 32) != 0
    out = [
        issue(docs.where(~c("has_xmp")), "6.6.2.1", "no metadata", True),
        issue(docs.where(c("has_xmp") & (F.coalesce("xmp_part", F.lit("")) != part)), "6.6.4", "identification is missing or another", True),
        issue(docs.where(c("has_xmp") & ~c("xmp_title").eqNullSafe(c("title"))), "6.6.3", "titles differ", True),
        issue(docs.where("encrypted"), "6.1.3", "encrypted", True),
        issue(docs.where(c("device_rgb") & ~c("has_output_intent")), "6.2.3", "device colour without an output intent", True),
        issue(docs.where("device_cmyk"), "6.2.4.3", "CMYK without a matching intent", False),
        issue(docs.where("catalog_aa"), "6.5.2", "additional actions of the catalog", True),
        issue(docs.where("has_javascript"), "6.5.1", "document scripts", True),
        issue(docs.where("need_appearances"), "6.4.1", "appearances are left to the viewer", True),
        issue(actions.where("owner = 'page-aa'"), "6.5.2", "additional actions of a page", True, page),
        issue(actions.where(c("kind").isin(*_FORBIDDEN_ACTIONS) & ~c("owner").isin("page-aa", "field-aa")), "6.5.1", "forbidden action", True, page),
        issue(actions.where("owner = 'field-aa'"), "6.5.2", "additional actions of a field", True, page),
        issue(annotations.where(c("subtype").isin(*_FORBIDDEN_ANNOTATIONS)), "6.3.1", "forbidden annotation", True, page),
        issue(annotations.where((c("subtype") != "Popup") & ((c("flags").bitwiseAND(4) == 0) | hidden)), "6.3.2", "annotation hidden or not printed", True, page),
        issue(annotations.where(~c("subtype").isin("Popup", "Link") & ~c("has_appearance")), "6.3.3", "annotation without appearance", False, page),
        issue(annotations.where("has_aa"), "6.5.2", "additional actions of an annotation", True, page),
        issue(fonts.where(~c("embedded")), "6.2.11.4", "font not embedded", False),
        issue(streams.where(F.contains("filter", F.lit("LZW"))), "6.1.7.2", "LZW", True),
        issue(streams.where("external"), "6.1.7.1", "external stream", False),
        issue(streams.where("interpolate"), "6.2.8", "interpolated image", True),
        issue(streams.where("alternates"), "6.2.8", "alternate images", True),
        issue(streams.where("postscript"), "6.2.9", "PostScript", False),
        issue(docs.where(c("embedded_files") & F.lit(part == "2b")), "6.8", "embedded file", True),
        issue(docs.where(c("embedded_files") & ~c("af_relationship") & F.lit(part == "3b")), "6.8", "embedded file without a relationship", True),
    ]
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every.dropDuplicates(["doc_id", "clause", "message", "page"])


HIDDEN = ("metadata", "attachments", "scripts", "comments", "hidden text", "layers", "form fields", "links", "overlapping objects")


def hidden_information(sources: dict[str, DataFrame]) -> DataFrame:
    """``doc_id, category, n`` for every category given as a table of doc_id."""
    every = None
    for name, df in sources.items():
        if name not in HIDDEN:
            raise ValueError(name)
        one = df.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(name).alias("category"), "n")
        every = one if every is None else every.unionByName(one)
    return every


def signature_verdict(modified: str = "modification", revoked: str = "revoked", valid_at: str = "valid_at_signing", trusted: str = "trusted") -> Column:
    """Invalid for a disallowed change or a revoked certificate; Unknown out of validity or trust; else Valid."""
    return F.when((F.col(modified) == "Disallowed") | F.coalesce(F.col(revoked), F.lit(False)), "Invalid").when(~F.coalesce(F.col(valid_at), F.lit(False)) | ~F.coalesce(F.col(trusted), F.lit(False)), "Unknown").otherwise("Valid")


def changed_objects(signed: DataFrame, current: DataFrame, allowed: Callable[[Column], Column]) -> DataFrame:
    """Objects ``doc_id, num, type, digest`` that differ between two revisions: kind of change and whether it is allowed."""
    j = signed.alias("s").join(current.alias("c"), ["doc_id", "num"], "full_outer")
    kind = F.when(F.col("s.digest").isNull(), "added").when(F.col("c.digest").isNull(), "removed").when(F.col("s.digest") != F.col("c.digest"), "changed")
    kinds = F.coalesce("c.type", "s.type")
    return j.select("doc_id", "num", kinds.alias("type"), kind.alias("kind"), allowed(kinds).alias("allowed")).where("kind is not null")


def figures(elems: DataFrame) -> DataFrame:
    """``doc_id, id, alt, page`` of all figures; blank texts are none."""
    return elems.where("type = 'Figure'").select("doc_id", "id", F.when(_has_alt(), F.trim("alt")).alias("alt"), "page")


#: What the bits of the permission number of an encrypted file allow, by their value.
PERMISSIONS = (("print", 4), ("change", 8), ("copy", 16), ("comment", 32), ("fill", 256), ("extract_for_access", 512), ("assemble", 1024), ("print_well", 2048))


def permission_flags(permissions: Column) -> Column:
    """One flag for each permission; a null number, that is no encryption, allows all."""
    return F.struct(*(F.coalesce(permissions.bitwiseAND(bit) != 0, F.lit(True)).alias(name) for name, bit in PERMISSIONS))


def certificate_chains(certificates: DataFrame) -> DataFrame:
    """``id, root, length, complete`` over certificates ``id, subject, issuer``: the last certificate that is found above each one.

    A chain is complete if it ends in a certificate that is its own issuer. Subjects are unique. Pointers double their reach
    each round; a chain that runs in a circle ends nowhere and is not complete.
    """
    top = F.col("subject") == F.col("issuer")
    now = stored(certificates.select("id", F.col("subject").alias("root"), F.col("issuer").alias("next"), F.lit(1).alias("length"), top.alias("complete")), "rules-chains")
    start = certificates.select("subject", "id")
    seen = -1
    while True:
        open_ = now.where(~F.col("complete"))
        there = start.withColumnRenamed("id", "t").join(now.select(F.col("id").alias("t"), F.col("root").alias("root2"), F.col("next").alias("next2"), F.col("length").alias("length2"), F.col("complete").alias("complete2")), "t").drop("t").withColumnRenamed("subject", "next")
        step = open_.join(there, "next", "left").select("id", F.coalesce("root2", "root").alias("root"), F.coalesce("next2", "next").alias("next"), (F.col("length") + F.coalesce("length2", F.lit(0))).cast("int").alias("length"), F.coalesce("complete2", "complete").alias("complete"), F.col("root2").isNotNull().alias("moved"))
        step = stored(step, "rules-chains")
        moved = step.where("moved").count()
        now = stored(now.where("complete").unionByName(step.drop("moved")), "rules-chains")
        if moved in (0, seen):
            return now.select("id", "root", "length", "complete")
        # the same number moves again and again only in circles
        seen = moved if step.where("moved and length > 1048576").count() else -1


def revoked(certificates: DataFrame, lists: DataFrame) -> DataFrame:
    """``id, revoked`` over certificates ``id, issuer, serial, at`` and revocation lists ``issuer, serial, revoked_at``: revoked by that time."""
    first = lists.groupBy("issuer", "serial").agg(F.min("revoked_at").alias("revoked_at"))
    return certificates.join(first, ["issuer", "serial"], "left").select("id", F.coalesce(F.col("revoked_at") <= F.col("at"), F.lit(False)).alias("revoked"))


def report_html(report: DataFrame) -> DataFrame:
    """``doc_id, html``: the report of ``check`` as a page for each document, rules in their order with their findings."""
    esc = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    found = F.filter(F.coalesce("findings", F.expr("cast(array() as array<struct<page:int,message:string>>)")), lambda f: f.isNotNull())
    items = F.array_join(F.transform(found, lambda f: F.concat(F.lit("<li>"), F.coalesce(F.concat(F.lit("Page "), f["page"].cast("string"), F.lit(": ")), F.lit("")), esc(f["message"]), F.lit("</li>"))), "")
    more = F.when(F.col("more") > 0, F.concat(F.lit("<li>and "), F.col("more").cast("string"), F.lit(" more</li>"))).otherwise("")
    row = F.concat(F.lit("<tr><td>"), "category", F.lit("</td><td>"), "rule", F.lit("</td><td>"), "status", F.lit("</td><td><ul>"), items, more, F.lit("</ul></td></tr>"))
    each = report.select("doc_id", F.struct("n", row.alias("x")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "\n")
    return each.groupBy("doc_id").agg(F.concat(F.lit("<!DOCTYPE html><html><body><h1>Accessibility report</h1><table>\n"), body, F.lit("\n</table></body></html>\n")).alias("html"))
