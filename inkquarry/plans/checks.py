"""Queries of the rule engines: accessibility, archive conformance, hidden information, signatures.

The driver's tables lack most facts that rules are about (structure, boxes, fonts, actions): these are derived from its
files and pages by arithmetic, the same in SQL, so that every rule both fails and passes somewhere.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from ..sources.tables import table
from .edits import _A, _annotations
from .registry import Registry

R = Registry()
c = F.col

_D = """(SELECT doc_id, CAST(file_size % 4096 AS INTEGER) AS permissions, doc_id % 3 <> 0 AS has_text, doc_id % 2 = 0 AS has_images, tagged, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'en' END AS lang, title,
  doc_id % 7 <> 0 AS display_title, CAST(doc_id % 40 AS INTEGER) AS page_count, doc_id % 2 = 1 AS has_outline FROM (SELECT DISTINCT ON (doc_id) * FROM pdf_files))"""


def _docs(spark, d):
    k = c("doc_id")
    return table(spark, d, "pdf_files").dropDuplicates(["doc_id"]).select(
        "doc_id", (c("file_size") % 4096).cast("int").alias("permissions"), (k % 3 != 0).alias("has_text"), (k % 2 == 0).alias("has_images"), "tagged",
        F.when(k % 5 == 0, None).when(k % 5 == 1, " ").otherwise("en").alias("lang"), "title", (k % 7 != 0).alias("display_title"), (k % 40).cast("int").alias("page_count"), (k % 2 == 1).alias("has_outline"),
    )


def _counted(found: dict, rule: str | None = None):
    every = None
    for f in found.values():
        every = f if every is None else every.unionByName(f)
    return every.groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


def _union(rows: list[tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule, count(*) AS n FROM {source} WHERE {where} GROUP BY doc_id" for rule, where in rows)


@R.query("rules_document", f"WITH d AS {_D} " + _union([
    ("permission-flag", "permissions & 512 = 0"), ("image-only", "NOT has_text AND has_images"), ("tagged-pdf", "NOT coalesce(tagged, false)"), ("primary-language", "trim(coalesce(lang, '')) = ''"),
    ("title", "trim(coalesce(title, '')) = '' OR NOT display_title"), ("bookmarks", "page_count > 20 AND NOT has_outline")], "d"))
def rules_document(spark, d):
    return _counted(rules.document_rules(_docs(spark, d)))


_PG = "(SELECT DISTINCT doc_id, page, page % 3 AS untagged, page % 2 = 0 AS has_annots, CASE page % 8 WHEN 0 THEN 'S' WHEN 2 THEN 'R' END AS tabs FROM pdf_pages)"
_AN = f"(SELECT doc_id, page, index, (['Widget', 'Movie', 'Popup', 'Link', 'Text', 'Ink', 'RichMedia'])[index % 7 + 1] AS subtype, index % 4 = 0 AS tagged, CAST(index % 6 AS INTEGER) AS flags, index % 3 = 0 AS has_appearance, index % 5 = 0 AS has_aa FROM {_A} WHERE true)"
_FO = "(SELECT doc_id, 'f' || (page % 3) AS name, bool_or(page % 4 = 0) AS bad FROM (SELECT DISTINCT doc_id, page FROM pdf_pages) GROUP BY ALL)"


def _pages(spark, d):
    p = table(spark, d, "pdf_pages").select("doc_id", "page").distinct()
    return p.select("doc_id", "page", (c("page") % 3).alias("untagged"), (c("page") % 2 == 0).alias("has_annots"), F.when(c("page") % 8 == 0, "S").when(c("page") % 8 == 2, "R").alias("tabs"))


def _annots(spark, d):
    kinds = F.array(*(F.lit(x) for x in ("Widget", "Movie", "Popup", "Link", "Text", "Ink", "RichMedia")))
    i = c("index")
    return _annotations(spark, d).select("doc_id", "page", "index", F.get(kinds, i % 7).alias("subtype"), (i % 4 == 0).alias("tagged"), (i % 6).cast("int").alias("flags"), (i % 3 == 0).alias("has_appearance"), (i % 5 == 0).alias("has_aa"))


def _fonts(spark, d):
    p = table(spark, d, "pdf_pages").select("doc_id", "page").distinct()
    return p.select("doc_id", "page", F.concat(F.lit("f"), c("page") % 3).alias("name"), (c("page") % 4 != 0).alias("maps_to_unicode"), (c("page") % 5 != 0).alias("embedded"))


@R.query("rules_pages", f"WITH p AS {_PG}, a AS {_AN}, f AS {_FO} " + " UNION ALL ".join([
    _union([("tagged-content", "untagged > 0"), ("tab-order", "has_annots AND coalesce(tabs, '') <> 'S'")], "p"),
    _union([("tagged-form-fields", "subtype = 'Widget' AND NOT tagged"), ("tagged-multimedia", "subtype IN ('Movie', 'RichMedia') AND NOT tagged"), ("tagged-annotations", "subtype IN ('Text', 'Ink') AND NOT tagged")], "a"),
    _union([("character-encoding", "bad")], "f"),
    _union([("field-descriptions", "blank")], "(SELECT doc_id, name, bool_or(trim(coalesce(tooltip, '')) = '') AS blank FROM fields WHERE name IS NOT NULL GROUP BY ALL)")]))
def rules_pages(spark, d):
    return _counted(rules.page_rules(_pages(spark, d), _annots(spark, d), _fonts(spark, d), table(spark, d, "fields").where("name is not null")))


# a structure tree for every document: (id, parent, type)
_TREE = (
    (1, 0, "Document"), (2, 1, "H1"), (3, 1, "H3"), (4, 1, "Figure"), (5, 4, "Figure"), (6, 1, "Formula"), (7, 1, "Table"), (8, 7, "TR"), (9, 8, "TH"), (10, 8, "TD"), (11, 7, "TR"), (12, 11, "TD"), (13, 11, "TD"), (14, 1, "TR"),
    (15, 1, "TD"), (16, 1, "L"), (17, 16, "LI"), (18, 17, "Lbl"), (19, 17, "LBody"), (20, 1, "LI"), (21, 1, "Lbl"), (22, 1, "Table"), (23, 22, "TBody"), (24, 23, "TR"), (25, 24, "TD"), (26, 24, "TD"), (27, 23, "TR"), (28, 27, "TD"), (29, 1, "H2"), (30, 1, "Figure"),
)
_CONTENT = (2, 3, 5, 6, 9, 10, 12, 13, 18, 19, 25, 26, 28)
_E = f"""(SELECT doc_id, id, nullif(parent, 0) AS parent_id, id AS preorder, type, CASE WHEN (doc_id + id) % 3 = 0 THEN 'text' WHEN (doc_id + id) % 3 = 1 THEN ' ' END AS alt, 1 AS page, CASE WHEN doc_id % 2 = 0 THEN 'about' END AS summary,
  CASE WHEN id = 10 AND doc_id % 2 = 1 THEN 2 END AS colspan, CASE WHEN id = 25 AND doc_id % 3 > 0 THEN 2 END AS rowspan, id IN {_CONTENT} AS has_content, id IN (13, 30) AS has_annots
  FROM (SELECT DISTINCT doc_id FROM pdf_files), (VALUES {", ".join(map(str, _TREE))}) t(id, parent, type))"""


def _elems(spark, d):
    tree = F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(p).alias("parent"), F.lit(t).alias("type")) for i, p, t in _TREE)))
    e = table(spark, d, "pdf_files").select("doc_id").distinct().select("doc_id", tree.alias("t")).select("doc_id", "t.*")
    k = (c("doc_id") + c("id")) % 3
    return e.select(
        "doc_id", "id", F.when(c("parent") > 0, c("parent")).alias("parent_id"), c("id").alias("preorder"), "type", F.when(k == 0, "text").when(k == 1, " ").alias("alt"), F.lit(1).alias("page"), F.when(c("doc_id") % 2 == 0, "about").alias("summary"),
        F.when((c("id") == 10) & (c("doc_id") % 2 == 1), 2).alias("colspan"), F.when((c("id") == 25) & (c("doc_id") % 3 > 0), 2).alias("rowspan"), c("id").isin(*_CONTENT).alias("has_content"), c("id").isin(13, 30).alias("has_annots"),
    )


_UP = f"""WITH RECURSIVE e AS MATERIALIZED {_E}, up AS (SELECT doc_id, id, parent_id AS above FROM e WHERE parent_id IS NOT NULL UNION ALL SELECT up.doc_id, up.id, e.parent_id FROM up JOIN e ON e.doc_id = up.doc_id AND e.id = up.above WHERE e.parent_id IS NOT NULL),
  x AS MATERIALIZED (SELECT e.*, trim(coalesce(alt, '')) <> '' AS has_alt, EXISTS (SELECT 1 FROM up JOIN e b ON b.doc_id = up.doc_id AND b.id = up.above WHERE up.doc_id = e.doc_id AND up.id = e.id AND trim(coalesce(b.alt, '')) <> '') AS under_alt,
    has_content OR EXISTS (SELECT 1 FROM up JOIN e b ON b.doc_id = up.doc_id AND b.id = up.id WHERE up.doc_id = e.doc_id AND up.above = e.id AND b.has_content) AS any_content,
    has_annots OR EXISTS (SELECT 1 FROM up JOIN e b ON b.doc_id = up.doc_id AND b.id = up.id WHERE up.doc_id = e.doc_id AND up.above = e.id AND b.has_annots) AS any_annots,
    coalesce((SELECT type FROM e q WHERE q.doc_id = e.doc_id AND q.id = e.parent_id), '') AS parent_type, EXISTS (SELECT 1 FROM up JOIN e b ON b.doc_id = up.doc_id AND b.id = up.id WHERE up.doc_id = e.doc_id AND up.above = e.id AND b.type = 'TH') AS has_th FROM e)"""
_LEVELS = "(SELECT doc_id, level > lag(level, 1, 0) OVER (PARTITION BY doc_id ORDER BY preorder) + 1 AS jump FROM (SELECT doc_id, preorder, CAST(type[2:] AS INTEGER) AS level FROM e WHERE regexp_matches(type, '^H[1-6]$')))"


@R.query("rules_structure", _UP + " " + _union([
    ("figures-alt-text", "type = 'Figure' AND NOT has_alt AND NOT under_alt"), ("other-elements-alt-text", "type = 'Formula' AND NOT has_alt AND NOT under_alt"), ("nested-alt-text", "has_alt AND under_alt"),
    ("alt-text-associated", "has_alt AND NOT any_content"), ("alt-text-hides-annotation", "has_alt AND any_annots"), ("table-rows", "type = 'TR' AND parent_type NOT IN ('Table', 'THead', 'TBody', 'TFoot')"),
    ("table-cells", "type IN ('TH', 'TD') AND parent_type <> 'TR'"), ("table-headers", "type = 'Table' AND NOT has_th"), ("table-summary", "type = 'Table' AND trim(coalesce(summary, '')) = ''"),
    ("table-regularity", "(id = 7 AND doc_id % 2 = 1) OR (id = 22 AND doc_id % 3 = 0)"), ("list-items", "type = 'LI' AND parent_type <> 'L'"), ("lbl-lbody", "type IN ('Lbl', 'LBody') AND parent_type <> 'LI'")], "x")
    + " UNION ALL " + _union([("heading-nesting", "jump")], _LEVELS))
def rules_structure(spark, d):
    return _counted(rules.structure_rules(_elems(spark, d)))


@R.query("rules_issues_capped", "SELECT doc_id, 'field-descriptions' AS rule, CAST(least(n, 200) AS INTEGER) AS listed, CAST(greatest(n - 200, 0) AS BIGINT) AS more FROM (SELECT doc_id, count(DISTINCT name) AS n FROM fields WHERE name IS NOT NULL AND trim(coalesce(tooltip, '')) = '' AND doc_id IN (SELECT doc_id FROM pdf_files) GROUP BY doc_id)")
def rules_issues_capped(spark, d):
    files = table(spark, d, "pdf_files").select("doc_id").distinct()
    r = rules.check(files, fields=table(spark, d, "fields").where("name is not null")).where("rule = 'field-descriptions' and status = 'Failed'")
    return r.select("doc_id", "rule", F.size("findings").alias("listed"), c("more").cast("bigint").alias("more"))


@R.query("rules_manual", "SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id FROM pdf_files), range(6) GROUP BY doc_id")
def rules_manual(spark, d):
    r = rules.check(_docs(spark, d)).where("status = 'Manual'")
    return r.groupBy("doc_id").agg(F.count("*").alias("n"))


@R.query("figures_list", f"WITH e AS {_E} SELECT doc_id, id, nullif(trim(coalesce(alt, '')), '') AS alt, page FROM e WHERE type = 'Figure'")
def figures_list(spark, d):
    return rules.figures(_elems(spark, d))


# archive conformance


_CD = """(SELECT doc_id, doc_id % 3 <> 0 AS has_xmp, CASE doc_id % 4 WHEN 0 THEN '2b' WHEN 1 THEN '3b' END AS xmp_part, CASE WHEN doc_id % 2 = 0 THEN title ELSE 'x' END AS xmp_title, title, encrypted, doc_id % 5 = 0 AS has_output_intent,
  doc_id % 2 = 0 AS device_rgb, doc_id % 6 = 1 AS device_cmyk, doc_id % 7 = 1 AS catalog_aa, coalesce(has_javascript, false) AS has_javascript, doc_id % 8 = 1 AS need_appearances, doc_id % 9 = 1 AS embedded_files, doc_id % 2 = 1 AS af_relationship FROM (SELECT DISTINCT ON (doc_id) * FROM pdf_files))"""
_CF = "(SELECT DISTINCT doc_id, 'f' || (page % 3) AS name, page % 5 <> 0 AS embedded FROM (SELECT DISTINCT doc_id, page FROM pdf_pages))"
_CS = "(SELECT DISTINCT doc_id, CASE WHEN page % 5 = 1 THEN 'LZWDecode' ELSE 'FlateDecode' END AS filter, page % 6 = 1 AS external, page % 7 = 1 AS interpolate, page % 8 = 1 AS alternates, page % 9 = 1 AS postscript FROM (SELECT DISTINCT doc_id, page FROM pdf_pages))"
_CA = "(SELECT DISTINCT doc_id, page, (['page', 'page-aa', 'field', 'field-aa'])[page % 4 + 1] AS owner, (['GoTo', 'Launch', 'URI', 'JavaScript', 'Hide'])[page % 5 + 1] AS kind FROM pdf_pages)"


def _conformance(spark, d, part):
    k, p = c("doc_id"), c("page")
    docs = table(spark, d, "pdf_files").dropDuplicates(["doc_id"]).select(
        "doc_id", (k % 3 != 0).alias("has_xmp"), F.when(k % 4 == 0, "2b").when(k % 4 == 1, "3b").alias("xmp_part"), F.when(k % 2 == 0, c("title")).otherwise("x").alias("xmp_title"), "title", "encrypted", (k % 5 == 0).alias("has_output_intent"),
        (k % 2 == 0).alias("device_rgb"), (k % 6 == 1).alias("device_cmyk"), (k % 7 == 1).alias("catalog_aa"), F.coalesce("has_javascript", F.lit(False)).alias("has_javascript"), (k % 8 == 1).alias("need_appearances"), (k % 9 == 1).alias("embedded_files"), (k % 2 == 1).alias("af_relationship"),
    )
    pages = table(spark, d, "pdf_pages").select("doc_id", "page").distinct()
    streams = pages.select("doc_id", F.when(p % 5 == 1, "LZWDecode").otherwise("FlateDecode").alias("filter"), (p % 6 == 1).alias("external"), (p % 7 == 1).alias("interpolate"), (p % 8 == 1).alias("alternates"), (p % 9 == 1).alias("postscript"))
    owners, kinds = F.array(*map(F.lit, ("page", "page-aa", "field", "field-aa"))), F.array(*map(F.lit, ("GoTo", "Launch", "URI", "JavaScript", "Hide")))
    actions = pages.select("doc_id", "page", F.get(owners, p % 4).alias("owner"), F.get(kinds, p % 5).alias("kind"))
    return rules.conformance(docs, _annots(spark, d), _fonts(spark, d), streams, actions, part)


def _issues(part: str) -> str:
    def of(source: str, page: str, rows: list[tuple[str, str, str]]) -> str:
        return " UNION ALL ".join(f"SELECT doc_id, '{clause}' AS clause, '{message}' AS message, {page} AS page FROM {source} WHERE {where}" for clause, message, where in rows)

    parts = [
        of("d", "NULL::INTEGER", [
            ("6.6.2.1", "no metadata", "NOT has_xmp"), ("6.6.4", "identification is missing or another", f"has_xmp AND coalesce(xmp_part, '') <> '{part}'"), ("6.6.3", "titles differ", "has_xmp AND xmp_title IS DISTINCT FROM title"), ("6.1.3", "encrypted", "encrypted"),
            ("6.2.3", "device colour without an output intent", "device_rgb AND NOT has_output_intent"), ("6.2.4.3", "CMYK without a matching intent", "device_cmyk"), ("6.5.2", "additional actions of the catalog", "catalog_aa"), ("6.5.1", "document scripts", "has_javascript"),
            ("6.4.1", "appearances are left to the viewer", "need_appearances"), ("6.8", "embedded file", f"embedded_files AND '{part}' = '2b'"), ("6.8", "embedded file without a relationship", f"embedded_files AND NOT af_relationship AND '{part}' = '3b'")]),
        of("x", "page", [("6.5.2", "additional actions of a page", "owner = 'page-aa'"), ("6.5.1", "forbidden action", "kind IN ('Launch', 'JavaScript', 'Hide') AND owner NOT IN ('page-aa', 'field-aa')"), ("6.5.2", "additional actions of a field", "owner = 'field-aa'")]),
        of("a", "page", [("6.3.1", "forbidden annotation", "subtype IN ('Movie')"), ("6.3.2", "annotation hidden or not printed", "subtype <> 'Popup' AND (flags & 4 = 0 OR flags & 34 <> 0)"), ("6.3.3", "annotation without appearance", "subtype NOT IN ('Popup', 'Link') AND NOT has_appearance"), ("6.5.2", "additional actions of an annotation", "has_aa")]),
        of("f", "NULL::INTEGER", [("6.2.11.4", "font not embedded", "NOT embedded")]),
        of("s", "NULL::INTEGER", [("6.1.7.2", "LZW", "filter = 'LZWDecode'"), ("6.1.7.1", "external stream", "external"), ("6.2.8", "interpolated image", "interpolate"), ("6.2.8", "alternate images", "alternates"), ("6.2.9", "PostScript", "postscript")]),
    ]
    return f"WITH d AS {_CD}, a AS {_AN}, f AS {_CF}, s AS {_CS}, x AS {_CA} SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)})"


@R.query("conformance_2b", _issues("2b"))
def conformance_2b(spark, d):
    return _conformance(spark, d, "2b").select("doc_id", "clause", "message", "page")


@R.query("conformance_3b", _issues("3b"))
def conformance_3b(spark, d):
    return _conformance(spark, d, "3b").select("doc_id", "clause", "message", "page")


# signatures


_S = "(SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'Allowed' ELSE 'Disallowed' END AS modification, CASE WHEN c_custkey % 5 = 0 THEN true WHEN c_custkey % 5 = 1 THEN false END AS revoked, c_custkey % 7 <> 0 AS valid_at_signing, CASE WHEN c_custkey % 2 = 0 THEN true END AS trusted FROM customer)"


@R.query("signature_verdicts", f"WITH s AS {_S} SELECT id, CASE WHEN modification = 'Disallowed' OR coalesce(revoked, false) THEN 'Invalid' WHEN NOT valid_at_signing OR NOT coalesce(trusted, false) THEN 'Unknown' ELSE 'Valid' END AS status FROM s")
def signature_verdicts(spark, d):
    k = c("c_custkey")
    s = table(spark, d, "customer").select(k.alias("id"), F.when(k % 3 == 0, "None").when(k % 3 == 1, "Allowed").otherwise("Disallowed").alias("modification"), F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("revoked"), (k % 7 != 0).alias("valid_at_signing"), F.when(k % 2 == 0, True).alias("trusted"))
    return s.select("id", rules.signature_verdict().alias("status"))


@R.query("certificate_chains", """WITH RECURSIVE k AS (SELECT p_partkey AS id, 's' || p_partkey AS subject, CASE WHEN p_partkey % 10 = 0 THEN 's' || p_partkey WHEN p_partkey % 10 = 7 THEN 'gone' ELSE 's' || (p_partkey - 1) END AS issuer FROM part),
  w AS (SELECT id, subject, issuer, 1 AS length FROM k UNION ALL SELECT w.id, k.subject, k.issuer, w.length + 1 FROM w JOIN k ON k.subject = w.issuer WHERE w.subject <> w.issuer)
  SELECT id, arg_max(subject, length) AS root, CAST(max(length) AS INTEGER) AS length, arg_max(subject = issuer, length) AS complete FROM w GROUP BY id""")  # fmt: skip
def certificate_chains(spark, d):
    k = c("p_partkey")
    name = lambda x: F.concat(F.lit("s"), x)
    certs = table(spark, d, "part").select(k.alias("id"), name(k).alias("subject"), F.when(k % 10 == 0, name(k)).when(k % 10 == 7, "gone").otherwise(name(k - 1)).alias("issuer"))
    return rules.certificate_chains(certs)


@R.query("revoked_certificates", "SELECT c_custkey AS id, c_custkey % 4 = 0 AND (o.at IS NOT NULL AND o.at <= c_custkey % 50) AS revoked FROM customer LEFT JOIN (SELECT s_suppkey * 4 AS serial, min(s_suppkey % 60) AS at FROM supplier GROUP BY 1) o ON o.serial = c_custkey")
def revoked_certificates(spark, d):
    certs = table(spark, d, "customer").select(c("c_custkey").alias("id"), F.lit("ca").alias("issuer"), c("c_custkey").alias("serial"), (c("c_custkey") % 50).alias("at"))
    crl = table(spark, d, "supplier").select(F.lit("ca").alias("issuer"), (c("s_suppkey") * 4).alias("serial"), (c("s_suppkey") % 60).alias("revoked_at"))
    return rules.revoked(certs, crl)


@R.query("changed_objects", "SELECT p_partkey AS num, CASE WHEN p_partkey % 5 = 0 THEN 'added' WHEN p_partkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS kind, p_type = 'x' OR p_partkey % 5 = 0 AS allowed FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0")
def changed_objects(spark, d):
    k = c("p_partkey")
    p = table(spark, d, "part").select(F.lit(1).alias("doc_id"), k.alias("num"), F.when(k % 5 == 0, "Annot").otherwise("Page").alias("type"), F.lit("a").alias("digest"))
    signed, now = p.where("num % 5 <> 0"), p.where("num % 5 = 0 or num % 7 <> 0").withColumn("digest", F.when((c("num") % 11 == 0), "b").otherwise("a"))
    return rules.changed_objects(signed, now, lambda t: t == "Annot").select("num", "kind", "allowed")


@R.query("permission_flags", f"WITH d AS {_D} SELECT doc_id, permissions & 4 <> 0 AS print, permissions & 8 <> 0 AS change, permissions & 16 <> 0 AS copy, permissions & 32 <> 0 AS comment, permissions & 256 <> 0 AS fill, permissions & 512 <> 0 AS extract_for_access, permissions & 1024 <> 0 AS assemble, permissions & 2048 <> 0 AS print_well FROM d")
def permission_flags(spark, d):
    docs = _docs(spark, d)
    return docs.select("doc_id", rules.permission_flags(c("permissions")).alias("p")).select("doc_id", "p.*")
