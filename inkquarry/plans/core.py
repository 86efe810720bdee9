"""Queries over the driver's tables, each with the same query in SQL for an independent engine where SQL has one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import af, geometry, text
from ..functions import formcalc as fc
from ..operators import comments, diff, forms, layout, pages, rules, sets
from ..operators.textlines import glyph_lines
from ..sources.tables import table
from .registry import Registry

R = Registry()
c = F.col

# text search and patterns

_EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


@R.query(
    "pattern_counts",
    f"""SELECT source, CAST(count(*) AS BIGINT) AS texts, CAST(sum(len(regexp_extract_all(' ' || text || ' ', '[^A-Za-z0-9._%+-]({_EMAIL})[^A-Za-z0-9-]', 1))) AS BIGINT) AS emails
        FROM (SELECT source, coalesce(text, '') AS text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1 GROUP BY source""",
)
def pattern_counts(spark, d):
    """Read once: of the rows of one text the first stays, with what was counted in it."""
    t = F.coalesce("text", F.lit(""))
    counted = table(spark, d, "documents").select(F.sha2(t, 256).alias("digest"), F.struct("doc_id", "source", F.size(text.emails(t)).alias("n")).alias("x"))
    return counted.groupBy("digest").agg(F.min("x").alias("x")).groupBy("x.source").agg(F.count("*").alias("texts"), F.sum("x.n").cast("bigint").alias("emails"))


@R.query("pattern_hits")
def pattern_hits(spark, d):
    docs = table(spark, d, "documents")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("pattern"), f(c("text")).alias("hits")) for k, f in text.PATTERNS.items()))).alias("p")
    return docs.select("doc_id", kinds).select("doc_id", "p.pattern", F.posexplode("p.hits").alias("at", "hit"))


@R.query("find_whole_word", "SELECT doc_id FROM documents WHERE regexp_matches(' ' || lower(text) || ' ', '[^\\pL\\pN]bridge[^\\pL\\pN]')")
def find_whole_word(spark, d):
    return table(spark, d, "documents").where(c("text").rlike(text.phrase_pattern("bridge", whole_words=True))).select("doc_id")


@R.query(
    "find_positions",
    """SELECT doc_id, CAST(instr(lower(text), 'railway') - 1 AS INTEGER) AS first, CAST(len(regexp_extract_all(lower(text), 'railway')) AS INTEGER) AS hits
       FROM documents WHERE contains(lower(text), 'railway')""",
)
def find_positions(spark, d):
    at = text.find(c("text"), "railway")
    return table(spark, d, "documents").withColumn("at", at).where(F.size("at") > 0).select("doc_id", c("at")[0].alias("first"), F.size("at").alias("hits"))


@R.query("topk_find", "SELECT doc_id, CAST(instr(text, 'harbour') - 1 AS INTEGER) AS start FROM documents WHERE contains(text, 'harbour') ORDER BY doc_id LIMIT 50")
def topk_find(spark, d):
    at = text.find(c("text"), "harbour", case_sensitive=True)
    return table(spark, d, "documents").select("doc_id", F.get(at, F.lit(0)).alias("start")).where("start is not null").orderBy("doc_id").limit(50)


@R.query("url_counts", "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?:https?://|www\\.)[^\\s<>\"''()\\[\\]{}]+')) AS INTEGER) AS urls FROM documents WHERE regexp_matches(text, '(?:https?://|www\\.)[^\\s<>\"''()\\[\\]{}]')")
def url_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.urls(c("text"))).alias("urls")).where("urls > 0")


@R.query("url_policies", r"""WITH u AS (SELECT regexp_replace(unnest(regexp_extract_all(text, '(?i)(?:https?://|www\.)[^\s<>"''()\[\]{}]+')), '[.,;:!?]+$', '') AS u FROM documents), v AS (SELECT CASE WHEN lower(left(u, 4)) = 'www.' THEN 'http://' || u ELSE u END AS u FROM u),
  h AS (SELECT lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1)) AS host FROM v)
  SELECT host <> '' AS allowed, host, CASE WHEN host <> '' THEN '' WHEN scheme = '' THEN 'no scheme' ELSE 'no host' END AS reason, count(*) AS count FROM h GROUP BY ALL""")
def url_policies(spark, d):
    u = table(spark, d, "documents").select("doc_id", F.explode(text.urls(c("text"))).alias("url"))
    return u.groupBy(text.url_policy(c("url")).alias("p")).count().select("p.*", "count")


@R.query("word_counts", "SELECT doc_id, CAST(CASE WHEN trim(regexp_replace(coalesce(text,''), '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS INTEGER) AS words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(c("text")).cast("int").alias("words"))


@R.query(
    "glyph_lines",
    """SELECT doc_id, page, line, ltrim(string_agg(CASE WHEN space_before THEN ' ' || text ELSE text END, '' ORDER BY ord), ' ') AS text
       FROM (SELECT DISTINCT doc_id, page, line, ord, text, space_before FROM glyphs) GROUP BY doc_id, page, line""",
)
def q_glyph_lines(spark, d):
    return glyph_lines(table(spark, d, "glyphs"))


@R.query(
    "page_text",
    """SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line) AS text FROM (
         SELECT doc_id, page, line, ltrim(string_agg(CASE WHEN space_before THEN ' ' || text ELSE text END, '' ORDER BY ord), ' ') AS text
         FROM (SELECT DISTINCT doc_id, page, line, ord, text, space_before FROM glyphs) GROUP BY doc_id, page, line) GROUP BY doc_id, page""",
)
def q_page_text(spark, d):
    return layout.page_text(table(spark, d, "glyphs"))


@R.query("line_rects", "SELECT doc_id, page, line, min(rect[1]) AS x0, min(rect[2]) AS y0, max(rect[3]) AS x1, max(rect[4]) AS y1 FROM glyphs WHERE rect IS NOT NULL GROUP BY ALL")
def q_line_rects(spark, d):
    return layout.line_rects(table(spark, d, "glyphs"))


@R.query("nearest_glyph")
def nearest_glyph(spark, d):
    return layout.nearest(table(spark, d, "glyphs"), 200.0, 300.0)


@R.query("word_tables")
def word_tables(spark, d):
    w = table(spark, d, "words").dropDuplicates(["doc_id", "page", "ord"])
    segs = layout.segments(w, 30.0).groupBy("doc_id", "page", "line", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"), F.array(F.min(c("rect")[0]), F.min(c("rect")[1]), F.max(c("rect")[2]), F.max(c("rect")[3])).alias("rect"))
    return layout.tables(segs)


@R.query("table_cells", """SELECT c_custkey AS doc_id, 1 AS page, 0 AS "table", CAST(r AS INTEGER) AS row, CAST(k AS INTEGER) AS "column", c_name || '/' || r || '/' || k AS text FROM customer, range(3) a(r), range(2) b(k)""")
def table_cells(spark, d):
    """A grid of three rows and two columns under a heading, on a page for each customer."""
    cells = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(k).alias("k")) for r in range(3) for k in range(2)))).alias("x")
    cust = table(spark, d, "customer").select(c("c_custkey").alias("doc_id"), F.lit(1).alias("page"), "c_name", (c("c_custkey") % 3).alias("off"))
    box = lambda x0, y0, wide: F.array(*(v.cast("double") for v in (x0, y0, x0 + wide, y0 + 10)))
    grid = cust.select("doc_id", "page", "c_name", "off", cells).select("doc_id", "page", F.concat_ws("/", "c_name", "x.r", "x.k").alias("text"), box(c("off") + 50 + c("x.k") * 100 + c("x.r"), c("x.r") * 20 + 40, 40).alias("rect"))
    head = cust.select("doc_id", "page", F.lit("heading").alias("text"), box(F.lit(50), F.lit(10), 200).alias("rect"))
    return layout.tables(grid.unionByName(head))


@R.query("form_field_candidates")
def form_field_candidates(spark, d):
    return layout.field_candidates(glyph_lines(table(spark, d, "glyphs")))


@R.query("fields_to_fill", """SELECT c_custkey AS doc_id, 1 AS page, 0 AS line, CASE c_custkey % 4 WHEN 1 THEN 'checkbox' ELSE 'text' END AS kind, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'I am ' || c_name ELSE '' END AS label FROM customer WHERE c_custkey % 4 <> 2""")
def fields_to_fill(spark, d):
    n = c("c_custkey") % 4
    lines = table(spark, d, "customer").select(c("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("line"), F.when(n == 0, F.concat("c_name", F.lit(": ______ please"))).when(n == 1, F.concat(F.lit("[ ] I am "), "c_name")).when(n == 2, "nothing to fill in").otherwise("____ Signature").alias("text"))
    return layout.field_candidates(lines)


# page sets


_P = "(SELECT DISTINCT ON (doc_id, page) * FROM pdf_pages)"


@R.query("page_filter", f"SELECT doc_id, page FROM {_P} WHERE page % 2 = 0 AND CASE WHEN ((rotation % 180) + 180) % 180 = 90 THEN coalesce(abs(crop[4]-crop[2]), height) > coalesce(abs(crop[3]-crop[1]), width) ELSE coalesce(abs(crop[3]-crop[1]), width) > coalesce(abs(crop[4]-crop[2]), height) END")
def page_filter(spark, d):
    return pages.by_parity(pages.once(table(spark, d, "pdf_pages")), odd=False, landscape=True).select("doc_id", "page")


@R.query("page_extract", f"SELECT p.doc_id, p.page, CAST(l.pos AS INTEGER) AS pos FROM {_P} p JOIN (VALUES (3,0),(1,1),(2,2),(1,3)) l(page,pos) ON p.page = l.page")
def page_extract(spark, d):
    return pages.extract(pages.once(table(spark, d, "pdf_pages")).select("doc_id", "page"), [3, 1, 2, 1]).select("doc_id", "page", "pos")


@R.query("page_narrowed", f"SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) - 1 AS INTEGER) AS pos FROM (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM {_P}) WHERE k % 2 = 1")
def page_narrowed(spark, d):
    p = pages.once(table(spark, d, "pdf_pages")).select("doc_id", "page", c("page").alias("pos"))
    return pages.narrowed(p, odd=True, reverse=True).select("doc_id", "page", c("pos").cast("int").alias("pos"))


@R.query("range_select", f"SELECT doc_id, page, CAST(pos AS INTEGER) AS pos FROM (SELECT f.doc_id, l.page, l.pos FROM (SELECT doc_id, max(page) AS n FROM {_P} GROUP BY doc_id) f, LATERAL (SELECT unnest(list_concat(list_concat([2], CASE WHEN n >= 4 THEN [4, 3] ELSE [x FOR x IN [4, 3] IF x <= n] END), CASE WHEN n >= 6 THEN range(6, n + 1) ELSE [] END)) AS page, generate_subscripts(list_concat(list_concat([2], CASE WHEN n >= 4 THEN [4, 3] ELSE [x FOR x IN [4, 3] IF x <= n] END), CASE WHEN n >= 6 THEN range(6, n + 1) ELSE [] END), 1) - 1 AS pos) l WHERE n >= 2)")
def range_select(spark, d):
    n = pages.once(table(spark, d, "pdf_pages")).groupBy("doc_id").agg(F.max("page").alias("n"))
    spec = F.when(c("n") >= 6, "2, 4-3, 6-").when(c("n") >= 2, "2, 4-3").otherwise("1")
    return n.select("doc_id", F.posexplode(pages.ranges(spec, c("n"))).alias("pos", "page"))


@R.query("page_delete", f"SELECT doc_id, page FROM {_P} p WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.doc_id = p.doc_id AND w.page = p.page)")
def page_delete(spark, d):
    return pages.delete(pages.once(table(spark, d, "pdf_pages")), table(spark, d, "words").select("doc_id", "page").distinct()).select("doc_id", "page")


@R.query("page_move", f"SELECT doc_id, page AS old_page, CAST(CASE WHEN page BETWEEN 2 AND 3 THEN page + 3 WHEN page IN (4, 5, 6) THEN page - 2 ELSE page END AS INTEGER) AS page FROM {_P}")
def page_move(spark, d):
    return pages.move(pages.once(table(spark, d, "pdf_pages")).select("doc_id", "page", c("page").alias("old_page")), 2, 3, 7)


@R.query("page_duplicate", f"SELECT doc_id, old_page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY old_page, c) AS INTEGER) AS page FROM (SELECT doc_id, page AS old_page, c FROM {_P}, (VALUES (0),(1)) v(c) WHERE c = 0 OR page = 1)")
def page_duplicate(spark, d):
    p = pages.once(table(spark, d, "pdf_pages")).select("doc_id", "page", c("page").alias("old_page"))
    return pages.duplicate(p, c("page") == 1).select("doc_id", "old_page", "page")


@R.query("page_rotate", f"SELECT doc_id, page, CAST(CASE WHEN page % 2 = 1 THEN (coalesce(rotation, 0) + 90) % 360 ELSE coalesce(rotation, 0) END AS INTEGER) AS rotation FROM {_P}")
def page_rotate(spark, d):
    return pages.rotate(pages.once(table(spark, d, "pdf_pages")), 90, c("page") % 2 == 1).select("doc_id", "page", F.coalesce("rotation", F.lit(0)).alias("rotation"))


@R.query("page_insert_blank", f"SELECT doc_id, CAST(CASE WHEN page >= 2 THEN page + 1 ELSE page END AS INTEGER) AS page, false AS blank FROM {_P} UNION ALL SELECT doc_id, 2, true FROM (SELECT DISTINCT doc_id FROM pdf_pages)")
def page_insert_blank(spark, d):
    p = pages.once(table(spark, d, "pdf_pages")).select("doc_id", "page", F.lit(False).alias("blank"))
    return pages.insert(p, p.select("doc_id").distinct().select("doc_id", F.lit(1).alias("page"), F.lit(True).alias("blank")), 2)


@R.query("page_replace", f"SELECT doc_id, page, CASE WHEN page = 2 THEN 'new' ELSE label END AS label FROM {_P}")
def page_replace(spark, d):
    p = pages.once(table(spark, d, "pdf_pages")).select("doc_id", "page", "label")
    return pages.replace(p, p.select("doc_id").distinct().select("doc_id", F.lit(1).alias("page"), F.lit("new").alias("label")), 2)


@R.query("doc_combine", f"SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY source, page) AS INTEGER) AS page FROM (SELECT doc_id, page, 0 AS source FROM {_P} WHERE page <= 2 UNION ALL SELECT doc_id, page, 1 FROM {_P} WHERE page > 2)")
def doc_combine(spark, d):
    p = pages.once(table(spark, d, "pdf_pages")).select("doc_id", "page")
    return pages.combine([p.where("page <= 2"), p.where("page > 2")])


@R.query("split_every_n", f"SELECT doc_id, page, CAST((page - 1) // 4 AS INTEGER) AS part FROM {_P}")
def split_every_n(spark, d):
    return pages.split_every(pages.once(table(spark, d, "pdf_pages")), 4).select("doc_id", "page", "part")


@R.query("split_before_cut", f"SELECT doc_id, page, CAST(sum(CASE WHEN page > 1 AND label IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS INTEGER) AS part FROM {_P}")
def split_before_cut(spark, d):
    return pages.split_before(pages.once(table(spark, d, "pdf_pages")), c("label").isNull()).select("doc_id", "page", "part")


@R.query(
    "split_by_size",
    """WITH RECURSIVE s AS (SELECT doc_id, page, count(DISTINCT ord) AS size FROM glyphs GROUP BY doc_id, page), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM s),
       r AS (SELECT doc_id, page, k, size AS total, 0 AS part FROM o WHERE k = 1 UNION ALL
             SELECT o.doc_id, o.page, o.k, CASE WHEN r.total > 0 AND r.total + o.size > 1500 THEN o.size ELSE r.total + o.size END, CASE WHEN r.total > 0 AND r.total + o.size > 1500 THEN r.part + 1 ELSE r.part END FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1)
       SELECT doc_id, page, CAST(part AS INTEGER) AS part FROM r""",
)
def split_by_size(spark, d):
    s = table(spark, d, "glyphs").groupBy("doc_id", "page").agg(F.countDistinct("ord").alias("size"))
    return pages.split_by_size(s, "size", 1500)


@R.query("split_by_marks", f"SELECT doc_id, page AS first, CAST(coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page) - 1, n) AS INTEGER) AS last FROM (SELECT DISTINCT p.doc_id, p.page, f.n FROM {_P} p JOIN (SELECT doc_id, max(page) AS n FROM pdf_pages GROUP BY doc_id) f ON p.doc_id = f.doc_id WHERE p.page = 1 OR p.page % 5 = 0 UNION SELECT doc_id, 1, max(page) FROM pdf_pages GROUP BY doc_id)")
def split_by_marks(spark, d):
    p = pages.once(table(spark, d, "pdf_pages"))
    return pages.split_by_marks(p, p.where("page % 5 = 0"))


@R.query(
    "page_labels",
    f"""SELECT doc_id, page, CASE WHEN page < 3 THEN (['i','ii'])[page] WHEN page < 6 THEN 'A-' || CAST(page - 2 AS VARCHAR) ELSE repeat(chr(97 + ((page - 6) % 26)), (page - 6) // 26 + 1) END AS label FROM {_P}""",
)
def page_labels(spark, d):
    p = pages.once(table(spark, d, "pdf_pages")).select("doc_id", "page")
    spec = spark.createDataFrame([(1, "r", None, 1), (3, "D", "A-", 1), (6, "a", None, 1)], "first int, style string, prefix string, start int")
    return pages.labels(p, p.select("doc_id").distinct().crossJoin(F.broadcast(spec)))


@R.query("bates_numbers", f"SELECT doc_id, page, 'B' || lpad(CAST(row_number() OVER (ORDER BY doc_id, page) + 99 AS VARCHAR), 8, '0') AS bates FROM {_P}")
def bates_numbers(spark, d):
    return pages.bates(pages.once(table(spark, d, "pdf_pages")).select("doc_id", "page"), 100, 8, "B").select("doc_id", "page", "bates")


@R.query("header_footer", f"SELECT p.doc_id, p.page, 'Page ' || p.page || ' of ' || n || ' - X' || lpad(CAST(p.page + 9 AS VARCHAR), 4, '0') AS footer FROM {_P} p JOIN (SELECT doc_id, max(page) AS n FROM pdf_pages GROUP BY doc_id) f ON p.doc_id = f.doc_id")
def header_footer(spark, d):
    p = pages.once(table(spark, d, "pdf_pages"))
    n = p.groupBy("doc_id").agg(F.max("page").alias("n"))
    return p.join(n, "doc_id").select("doc_id", "page", text.header_tokens("<<Page 1 of n>> - <<#4#10#X>>", c("page"), c("n")).alias("footer"))


@R.query("print_layout", f"SELECT doc_id, page, CAST((page - 1) // 4 AS INTEGER) AS sheet, CAST((page - 1) % 4 AS INTEGER) AS cell FROM {_P}")
def print_layout(spark, d):
    return pages.layout(pages.once(table(spark, d, "pdf_pages")), 4).select("doc_id", "page", "sheet", "cell")


@R.query("booklet_layout", f"SELECT p.doc_id, p.page, CAST(CASE WHEN p.page <= n4 // 2 THEN p.page - 1 ELSE n4 - p.page END AS INTEGER) AS sheet, CAST(p.page % 2 AS INTEGER) AS cell FROM {_P} p JOIN (SELECT doc_id, (max(page) + 3) // 4 * 4 AS n4 FROM pdf_pages GROUP BY doc_id) f ON f.doc_id = p.doc_id")
def booklet_layout(spark, d):
    return pages.layout(pages.once(table(spark, d, "pdf_pages")), 2, booklet=True).select("doc_id", "page", "sheet", "cell")


@R.query("poster_layout", f"SELECT doc_id, page, CAST(i AS INTEGER) AS tile_row, CAST(j AS INTEGER) AS tile_column, [width / 3 * j, height / 2 * i, width / 3 * (j + 1), height / 2 * (i + 1)]::DOUBLE[] AS clip FROM (SELECT doc_id, page, width::DOUBLE AS width, height::DOUBLE AS height FROM {_P}), range(2) a(i), range(3) b(j)")
def poster_layout(spark, d):
    return pages.poster(pages.once(table(spark, d, "pdf_pages")), 2, 3).select("doc_id", "page", "tile_row", "tile_column", "clip")


@R.query("natural_order", "SELECT doc_id, path, list_aggregate(list_transform(regexp_extract_all(lower(path), '\\d+|\\D+'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(CASE WHEN ltrim(p, '0') = '' THEN '0' ELSE ltrim(p, '0') END, 20, '0') ELSE p END), 'string_agg', '') AS sort_key FROM (SELECT DISTINCT doc_id, path FROM pdf_files)")
def natural_order(spark, d):
    return table(spark, d, "pdf_files").select("doc_id", "path").distinct().select("doc_id", "path", text.natural_key(c("path")).alias("sort_key"))


# sets and audits


@R.query("dedupe_exact", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep FROM documents")
def dedupe_exact(spark, d):
    return sets.dedupe(table(spark, d, "documents"), ["text"], "doc_id")


@R.query("anti_unreferenced", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def anti_unreferenced(spark, d):
    return sets.unreferenced(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").select(c("l_partkey").alias("p_partkey")), "p_partkey")


@R.query("dangling_pages", "SELECT DISTINCT g.doc_id, g.page FROM glyphs g WHERE NOT EXISTS (SELECT 1 FROM pdf_pages p WHERE p.doc_id = g.doc_id AND p.page = g.page)")
def dangling_pages(spark, d):
    at = lambda t: table(spark, d, t).select("doc_id", "page", F.concat_ws("/", "doc_id", "page").alias("at"))
    return sets.dangling(at("glyphs").distinct(), at("pdf_pages"), "at").select("doc_id", "page")


@R.query("overlap_anti", "SELECT a.doc_id, a.name FROM (SELECT DISTINCT doc_id, name, page, rect FROM fields WHERE rect IS NOT NULL) a WHERE NOT EXISTS (SELECT 1 FROM glyphs g WHERE g.doc_id = a.doc_id AND g.page = a.page AND a.rect[1] < g.rect[3] AND g.rect[1] < a.rect[3] AND a.rect[2] < g.rect[4] AND g.rect[2] < a.rect[4])")
def overlap_anti(spark, d):
    f = table(spark, d, "fields").where("rect is not null").select("doc_id", "name", "page", "rect").dropDuplicates(["doc_id", "name"])
    return sets.overlap_anti(f, table(spark, d, "glyphs")).select("doc_id", "name")


@R.query("space_audit", "SELECT producer, CAST(sum(file_size) AS BIGINT) AS amount, round(sum(file_size) * 100.0::DOUBLE / (SELECT sum(file_size) FROM (SELECT DISTINCT doc_id, file_size FROM pdf_files)), 4) AS percent FROM (SELECT DISTINCT doc_id, producer, file_size FROM pdf_files) GROUP BY producer")
def space_audit(spark, d):
    return sets.shares(table(spark, d, "pdf_files").select("doc_id", "producer", "file_size").distinct(), ["producer"], c("file_size"))


@R.query(
    "graph_closure",
    """WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 2) % 25 AS dst FROM nation), p AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT p.src, e.dst, p.depth + 1 FROM p JOIN e ON p.dst = e.src WHERE p.depth < 25)
       SELECT src, dst, CAST(min(depth) AS INTEGER) AS depth FROM p GROUP BY src, dst""",
)
def graph_closure(spark, d):
    return sets.closure(table(spark, d, "nation").select(c("n_nationkey").alias("src"), ((c("n_nationkey") * 2) % 25).alias("dst")))


@R.query(
    "reachability_claims",
    """WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 2) % 25 AS dst FROM nation), r AS (SELECT n_nationkey AS id, n_regionkey AS owner FROM nation WHERE n_nationkey < 10 UNION SELECT e.dst, r.owner FROM r JOIN e ON r.id = e.src)
       SELECT id, min(owner) AS owner FROM r GROUP BY id""",
)
def reachability_claims(spark, d):
    n = table(spark, d, "nation")
    return sets.claims(n.select(c("n_nationkey").alias("src"), ((c("n_nationkey") * 2) % 25).alias("dst")), n.where("n_nationkey < 10").select(c("n_nationkey").alias("id"), c("n_regionkey").alias("priority")))


@R.query("dedupe_structure", """WITH RECURSIVE w AS (SELECT p_partkey AS id, p_partkey AS at, p_type AS form FROM part UNION ALL SELECT w.id, p.p_partkey, w.form || '/' || p.p_type FROM w JOIN part p ON p.p_partkey = w.at // 2 WHERE w.at > 0),
  f AS (SELECT id, arg_max(form, length(form)) AS form FROM w GROUP BY id) SELECT id, min(id) OVER (PARTITION BY form) AS keep FROM f""")
def dedupe_structure(spark, d):
    o = table(spark, d, "part").select(c("p_partkey").alias("id"), c("p_type").alias("content"), F.when(c("p_partkey") > 0, F.array((c("p_partkey") / 2).cast("bigint"))).alias("refs"))
    return sets.dedupe_structure(o)


@R.query("doc_diff")
def doc_diff(spark, d):
    docs = table(spark, d, "documents").select(c("doc_id").alias("pair_id"), "text", "title_id", "season", "episode")
    w = Window.partitionBy("title_id", "season", "episode").orderBy("pair_id")
    paired = docs.withColumn("other", F.lag("text").over(w)).where("other is not null")
    return diff.change_counts(diff.compare(paired.select("pair_id", c("other").alias("text")), paired.select("pair_id", "text")))


# threads and logs


_THREADS = "SELECT 1 AS doc_id, CAST(user_id AS INTEGER) AS page, CAST(event_id AS INTEGER) AS index, event_id, event_type, ts FROM events"


@R.query("latest_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def latest_status(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


@R.query("comment_numbers", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS number FROM events")
def comment_numbers(spark, d):
    none = F.lit(None).cast("string")
    a = table(spark, d, "events").select(c("user_id").alias("doc_id"), F.lit(1).alias("page"), c("event_id").alias("index"), c("event_id").cast("string").alias("name"), none.alias("in_reply_to"), none.alias("state"))
    return comments.threads(a).select(c("index").alias("event_id"), "number")


@R.query("group_headers", "SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type, true) AS header FROM events")
def group_headers(spark, d):
    e = table(spark, d, "events").withColumn("doc_id", c("user_id"))
    return comments.group_headers(e, "event_type", ["event_id"]).select("event_id", "header")


@R.query("label_asof", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events")
def label_asof(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.last(F.when(c("event_type") == "purchase", c("event_id")), ignorenulls=True).over(w).alias("last_purchase"))


@R.query("thread_summary", "SELECT user_id, string_agg(number || '. ' || event_type, chr(10) ORDER BY number) AS text FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number FROM events) GROUP BY user_id")
def thread_summary(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("n"))
    line = F.concat(c("n").cast("string"), F.lit(". "), c("event_type"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


@R.query("upsert_by_key", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 0.0::DOUBLE FROM customer WHERE c_custkey % 7 = 0")
def upsert_by_key(spark, d):
    cur = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return comments.upsert(cur, cur.where("c_custkey % 7 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


# forms

_F = "(SELECT DISTINCT ON (doc_id, name) * FROM fields)"


@R.query("merge_spreadsheet", f"SELECT doc_id, coalesce(max(CASE WHEN name = 'applicant.name[0]' THEN array_to_string(value, ', ') END), '') AS applicant_name, coalesce(max(CASE WHEN name = 'applicant.email[0]' THEN array_to_string(value, ', ') END), '') AS applicant_email FROM {_F} WHERE name IN ('applicant.name[0]', 'applicant.email[0]') AND kind IN ('text','checkbox','radio','list','combo') GROUP BY doc_id")
def merge_spreadsheet(spark, d):
    return forms.spreadsheet(table(spark, d, "fields"), ["applicant.name[0]", "applicant.email[0]"]).toDF("doc_id", "applicant_name", "applicant_email")


@R.query("form_values", f"SELECT doc_id, name, CASE WHEN kind IN ('checkbox','radio') AND coalesce(array_to_string(value, ', '), '') = '' THEN 'Off' ELSE coalesce(array_to_string(value, ', '), '') END AS shown FROM {_F} WHERE kind IN ('text','checkbox','radio','list','combo')")
def form_values(spark, d):
    f = forms.once(table(spark, d, "fields")).where(c("kind").isin(*forms.EXPORTED))
    return f.select("doc_id", "name", forms.shown(c("value"), c("kind")).alias("shown"))


@R.query("form_reset", f"SELECT doc_id, name, coalesce(default_value, []) AS value FROM {_F}")
def form_reset(spark, d):
    return forms.reset(forms.once(table(spark, d, "fields"))).select("doc_id", "name", "value")


@R.query("option_labels", f"SELECT doc_id, name, list_transform(coalesce(value, []), lambda v: coalesce(list_filter(options, lambda o: o.export_value = v)[1].display_text, v)) AS shown FROM {_F} WHERE kind IN ('list', 'combo')")
def option_labels(spark, d):
    return forms.display(forms.once(table(spark, d, "fields")).where(c("kind").isin("list", "combo")))


@R.query("form_fill_rejects", f"SELECT doc_id, name, 'XXX' AS value, 'not allowed' AS reason FROM {_F} WHERE kind IN ('list', 'combo') AND NOT list_contains(list_transform(coalesce(options, []), lambda o: o.export_value), 'XXX') AND (flags & 262144) = 0")
def form_fill_rejects(spark, d):
    f = table(spark, d, "fields").where(c("kind").isin("list", "combo"))
    return forms.apply_values(f, f.select("doc_id", "name", F.lit("XXX").alias("value")))[1]


@R.query("form_xfdf", f"""SELECT doc_id, '<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="http://ns.adobe.com/xfdf/"><fields>' || string_agg('<field name="' || replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '">' || array_to_string(list_transform(coalesce(value, []), lambda v: '<value>' || replace(replace(replace(replace(coalesce(v, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</value>'), '') || '</field>', '' ORDER BY name) || '</fields></xfdf>' AS xml FROM {_F} WHERE kind IN ('text', 'checkbox', 'radio', 'list', 'combo') GROUP BY doc_id""")
def form_xfdf(spark, d):
    return forms.to_xfdf(table(spark, d, "fields"))


@R.query("form_fdf", f"SELECT doc_id, '%FDF-1.2' || chr(10) || '1 0 obj' || chr(10) || '<</FDF<</Fields[' || chr(10) || string_agg('<</T(' || regexp_replace(name, '([\\\\()])', '\\\\\\1', 'g') || ')/V(' || regexp_replace(CASE WHEN kind IN ('checkbox', 'radio') AND coalesce(array_to_string(value, ', '), '') = '' THEN 'Off' ELSE coalesce(array_to_string(value, ', '), '') END, '([\\\\()])', '\\\\\\1', 'g') || ')>>', chr(10) ORDER BY name) || chr(10) || ']>>>>' || chr(10) || 'endobj' || chr(10) || 'trailer' || chr(10) || '<</Root 1 0 R>>' || chr(10) || '%%EOF' || chr(10) AS fdf FROM {_F} WHERE kind IN ('text', 'checkbox', 'radio', 'list', 'combo') GROUP BY doc_id")
def form_fdf(spark, d):
    return forms.to_fdf(table(spark, d, "fields"))


@R.query("calc_aggregates", "SELECT l_orderkey, sum(l_quantity) AS total, avg(l_quantity) AS mean, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY l_orderkey")
def calc_aggregates(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    script = {"total": "Sum(q[*])", "mean": "Avg(q[*])", "low": "Min(q[*])", "high": "Max(q[*])"}
    return q.select("l_orderkey", *(fc.formcalc(s, {}, {"q": c("q")}).alias(k) for k, s in script.items()))


# form language and formats


@R.query("fc_round_mod", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 0.125, 2) AS r, l_extendedprice - 7 * trunc(l_extendedprice / 7) AS m FROM (SELECT DISTINCT l_orderkey, l_linenumber, floor(l_extendedprice) AS l_extendedprice FROM lineitem)")
def fc_round_mod(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_extendedprice").cast("double").alias("p")).distinct()
    return x.select("l_orderkey", "l_linenumber", F.round(fc.fc_round(c("p") * 0.125, 2), 2).alias("r"), fc.fc_mod(c("p"), 7).alias("m"))


@R.query("fc_pmt", "SELECT o_orderkey, round(o_totalprice * 0.005 / (1 - pow(1.005, -60)), 4) AS pmt, round(o_totalprice * (1 - pow(1.005, -12)) / 0.005, 2) AS pv, round(o_totalprice * (pow(1.005, 12) - 1) / 0.005, 2) AS fv FROM orders")
def fc_pmt(spark, d):
    p = c("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.round(fc.fc_pmt(p, 0.005, 60), 4).alias("pmt"), F.round(fc.fc_pv(p, 0.005, 12), 2).alias("pv"), F.round(fc.fc_fv(p, 0.005, 12), 2).alias("fv"))


@R.query("fc_npv", "SELECT o_orderkey, round(o_totalprice / 1.1 + 50 / 1.21 + o_totalprice / 2 / 1.331, 4) AS npv FROM orders")
def fc_npv(spark, d):
    p = c("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.round(fc.fc_npv(0.1, p, F.lit(50.0), F.lit(None).cast("double"), p / 2), 4).alias("npv"))


@R.query("fc_script", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 25 THEN round(l_quantity * l_discount + 1, 6) ELSE 0.0 END AS v, upper(l_returnflag) || '-' || left(l_linestatus, 1) AS t FROM lineitem")
def fc_script(spark, d):
    x = table(spark, d, "lineitem")
    env = {k: c(k) for k in ("l_quantity", "l_discount", "l_returnflag", "l_linestatus")}
    v = fc.formcalc("if (l_quantity > 25) then l_quantity * l_discount + 1 else 0 endif", env)
    t = fc.formcalc('Concat(Upper(l_returnflag), "-", Left(l_linestatus, 1))', env)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.round(v.cast("double"), 6).alias("v"), t.alias("t"))


@R.query("fc_text", "SELECT p_partkey, CAST(instr(p_name, 'i') AS DOUBLE) AS at, substr(p_name, 2, 4) AS sub, replace(p_name, 'e', 'E') AS rep, substr(p_name, 1, 2) || 'XY' || substr(p_name, 6) AS stuff, CAST(length(p_name) AS DOUBLE) AS len FROM part")
def fc_text(spark, d):
    n = c("p_name")
    return table(spark, d, "part").select("p_partkey", fc.fc_at(n, "i").alias("at"), fc.fc_substr(n, 2, 4).alias("sub"), fc.fc_replace(n, "e", "E").alias("rep"), fc.fc_stuff(n, 3, 3, "XY").alias("stuff"), fc.fc_len(n).alias("len"))


@R.query("fc_dates", "SELECT o_orderkey, CAST(date_diff('day', DATE '1899-12-31', CAST(o_orderdate AS DATE)) AS DOUBLE) AS day FROM orders")
def fc_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fc.fc_isodate2num(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))


def _words_sql(n: str) -> str:
    """English words of a number under a thousand, null for none."""
    ones, tens = (f"[{', '.join(repr(w) for w in words)}]" for words in (fc._ONES, fc._TENS))
    low = f"CASE WHEN {n} % 100 = 0 THEN NULL WHEN {n} % 100 < 20 THEN ({ones})[{n} % 100 + 1] ELSE ({tens})[{n} % 100 // 10 + 1] || CASE WHEN {n} % 10 <> 0 THEN '-' || ({ones})[{n} % 10 + 1] ELSE '' END END"
    return f"concat_ws(' ', CASE WHEN {n} >= 100 THEN ({ones})[{n} // 100 + 1] || ' hundred' END, {low})"


@R.query("fc_wordnum", f"""SELECT o_orderkey, CASE WHEN w = 0 THEN 'zero' ELSE concat_ws(' ', CASE WHEN m > 0 THEN {_words_sql('m')} || ' million' END, CASE WHEN t > 0 THEN {_words_sql('t')} || ' thousand' END, CASE WHEN u > 0 THEN {_words_sql('u')} END) END || ' dollars and ' || CASE WHEN c = 0 THEN 'zero' ELSE {_words_sql('c')} END || ' cents' AS words
  FROM (SELECT o_orderkey, w, w // 1000000 AS m, w // 1000 % 1000 AS t, w % 1000 AS u, c FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS w, CAST(round((o_totalprice - floor(o_totalprice)) * 100) AS BIGINT) AS c FROM orders))""")  # fmt: skip
def fc_wordnum(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fc.fc_wordnum(c("o_totalprice"), 2).alias("words"))


@R.query("roman_labels", "SELECT n_nationkey, (['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii','xiv','xv','xvi','xvii','xviii','xix','xx','xxi','xxii','xxiii','xxiv','xxv'])[n_nationkey + 1] AS label FROM nation")
def roman_labels(spark, d):
    return table(spark, d, "nation").select("n_nationkey", text.roman(c("n_nationkey") + 1).alias("label"))


@R.query("af_number_format", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '(' ELSE '' END || '$' || format('{:,.2f}', abs(c_acctbal)) || CASE WHEN c_acctbal < 0 THEN ')' ELSE '' END AS shown FROM customer")
def af_number_format(spark, d):
    return table(spark, d, "customer").select("c_custkey", af.number_format(c("c_acctbal"), 2, 0, 2, "$").alias("shown"))


@R.query("af_range_validate", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity BETWEEN 5 AND 30 AS ok FROM lineitem")
def af_range_validate(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", af.range_valid(c("l_quantity").cast("string"), 5, 30).alias("ok"))


@R.query("af_notation", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity + 2) * l_extendedprice / 4 - l_tax, 4) AS v FROM lineitem")
def af_notation(spark, d):
    env = {k: c(k).cast("string") for k in ("l_quantity", "l_extendedprice", "l_tax")}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(af.notation("(l_quantity + 2) * l_extendedprice / 4 - l_tax", env), 4).alias("v"))


@R.query("mask_apply", "SELECT c_custkey, '(' || substr(n, 1, 3) || ') ' || substr(n, 4, 3) || '-' || substr(n, 7, 4) AS phone FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 + 2000000000 AS VARCHAR), 10, '0') AS n FROM customer)")
def mask_apply(spark, d):
    n = F.lpad((c("c_custkey") * 7919 + 2000000000).cast("string"), 10, "0")
    return table(spark, d, "customer").select("c_custkey", af.special(n, 2).alias("phone"))


@R.query("csv_cells", "SELECT doc_id, '\"' || replace(CASE WHEN regexp_matches(coalesce(title, ''), '^\\s*[=+@-]|^[\\t\\r]') THEN '''' || title ELSE coalesce(title, '') END, '\"', '\"\"') || '\"' AS cell FROM (SELECT DISTINCT doc_id, title FROM pdf_files)")
def csv_cells(spark, d):
    return table(spark, d, "pdf_files").select("doc_id", "title").distinct().select("doc_id", text.csv_cell(c("title")).alias("cell"))


@R.query("pdf_dates", "SELECT doc_id, 'D:' || strftime(m, '%Y%m%d%H%M%S') || 'Z' AS written FROM (SELECT DISTINCT doc_id, CAST(modified_at AT TIME ZONE 'UTC' AS TIMESTAMP) AS m FROM pdf_files)")
def pdf_dates(spark, d):
    return table(spark, d, "pdf_files").select("doc_id", "modified_at").distinct().select("doc_id", text.pdf_date(c("modified_at")).alias("written"))


# geometry


@R.query("segment_length", "SELECT doc_id, page, round(sum(sqrt(pow(x - px, 2) + pow(y - py, 2))), 3) AS length FROM (SELECT doc_id, page, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (SELECT DISTINCT doc_id, page, ord, rect[1] AS x, rect[2] AS y FROM words) WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)) GROUP BY doc_id, page HAVING count(px) > 0")
def segment_length(spark, d):
    w = table(spark, d, "words").dropDuplicates(["doc_id", "page", "ord"])
    pts = w.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", c("rect")[0].alias("x"), c("rect")[1].alias("y")))).alias("p")).where(F.size("p") > 1)
    return pts.select("doc_id", "page", F.round(geometry.length(F.transform("p", lambda x: F.struct(x["x"].alias("x"), x["y"].alias("y")))), 3).alias("length"))


@R.query("polygon_area", "SELECT doc_id, page, ord, round(abs((rect[3] - rect[1]) * (rect[4] - rect[2])), 3) AS area FROM (SELECT DISTINCT doc_id, page, ord, rect FROM words)")
def polygon_area(spark, d):
    w = table(spark, d, "words").dropDuplicates(["doc_id", "page", "ord"])
    r = c("rect")
    corners = F.array(*(F.struct(r[i].alias("x"), r[j].alias("y")) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))))
    return w.select("doc_id", "page", "ord", F.round(geometry.area(corners), 3).alias("area"))


@R.query("view_points", f"SELECT doc_id, page, CASE r WHEN 90 THEN 200 - y0 WHEN 180 THEN x1 - 100 WHEN 270 THEN y1 - 200 ELSE 100 - x0 END::DOUBLE AS x, CASE r WHEN 90 THEN 100 - x0 WHEN 180 THEN 200 - y0 WHEN 270 THEN x1 - 100 ELSE y1 - 200 END::DOUBLE AS y FROM (SELECT doc_id, page, ((coalesce(rotation, 0) % 360) + 360) % 360 AS r, coalesce(crop[1], 0)::DOUBLE AS x0, coalesce(crop[2], 0)::DOUBLE AS y0, coalesce(crop[3], width)::DOUBLE AS x1, coalesce(crop[4], height)::DOUBLE AS y1 FROM {_P})")
def view_points(spark, d):
    # a page without a crop box is shown whole
    p = pages.once(table(spark, d, "pdf_pages"))
    whole = F.array(F.lit(0.0), F.lit(0.0), c("width").cast("double"), c("height").cast("double"))
    v = geometry.to_view(F.lit(100.0), F.lit(200.0), F.coalesce(c("crop").cast("array<double>"), whole), F.coalesce("rotation", F.lit(0)))
    return p.select("doc_id", "page", v["x"].alias("x"), v["y"].alias("y"))


# rules


@R.query("title_rule", "SELECT doc_id, 'title' AS rule FROM (SELECT DISTINCT doc_id, title FROM pdf_files) WHERE trim(coalesce(title, '')) = '' UNION ALL SELECT doc_id, 'tagged-pdf' FROM (SELECT DISTINCT doc_id, tagged FROM pdf_files) WHERE NOT coalesce(tagged, false)")
def title_rule(spark, d):
    return _rules(spark, d).where(c("rule").isin("title", "tagged-pdf") & (c("status") == "Failed")).select("doc_id", "rule")


def _rules(spark, d):
    """What the tables know: title, tags, pages, text and form fields. All other rules are skipped."""
    f = table(spark, d, "pdf_files").select("doc_id", "title", "tagged").distinct()
    n = pages.once(table(spark, d, "pdf_pages")).groupBy("doc_id").agg(F.max("page").alias("page_count"))
    fields = table(spark, d, "fields").select("doc_id", "name", "tooltip", "page")
    return rules.check(f.join(n, "doc_id", "left"), fields=fields)


@R.query(
    "accessibility_report",
    """SELECT d.doc_id, r.category, CAST(sum((r.run AND NOT r.bad)::INT) AS BIGINT) AS "Passed", CAST(sum((r.run AND r.bad)::INT) AS BIGINT) AS "Failed", CAST(sum(r.manual::INT) AS BIGINT) AS "Manual", CAST(sum((NOT r.run AND NOT r.manual)::INT) AS BIGINT) AS "Skipped"
       FROM (SELECT DISTINCT doc_id, trim(coalesce(title, '')) = '' AS no_title, NOT coalesce(tagged, false) AS no_tags FROM pdf_files) d,
         LATERAL (SELECT v.category, v.run, v.manual, CASE v.fact WHEN 't' THEN d.no_title WHEN 'g' THEN d.no_tags WHEN 'f' THEN EXISTS (SELECT 1 FROM fields f WHERE f.doc_id = d.doc_id AND f.name IS NOT NULL AND trim(coalesce(f.tooltip, '')) = '') ELSE false END AS bad
           FROM (SELECT 'Document' AS category, true AS run, false AS manual, 't' AS fact UNION ALL SELECT 'Document', true, false, 'g' UNION ALL SELECT 'Document', false, false, '' FROM range(4) UNION ALL SELECT 'Document', false, true, '' FROM range(2)
             UNION ALL SELECT 'PageContent', false, true, '' FROM range(4) UNION ALL SELECT 'PageContent', false, false, '' FROM range(5) UNION ALL SELECT 'Forms', true, false, 'f' UNION ALL SELECT 'Forms', false, false, ''
             UNION ALL SELECT 'AlternateText', false, false, '' FROM range(5) UNION ALL SELECT 'Tables', false, false, '' FROM range(5) UNION ALL SELECT 'Lists', false, false, '' FROM range(2) UNION ALL SELECT 'Headings', false, false, '') v) r GROUP BY d.doc_id, r.category""",
)
def accessibility_report(spark, d):
    return rules.status_counts(_rules(spark, d))


@R.query("field_descriptions", "SELECT doc_id, name, min(page) AS page FROM fields WHERE trim(coalesce(tooltip, '')) = '' GROUP BY doc_id, name")
def field_descriptions(spark, d):
    return forms.undescribed(table(spark, d, "fields"))


@R.query("heading_nesting", "SELECT doc_id, preorder, level FROM (SELECT doc_id, preorder, level, lag(level, 1, 0) OVER (PARTITION BY doc_id ORDER BY preorder) AS b FROM (SELECT DISTINCT doc_id, page AS preorder, CAST(page * page % 4 + 1 AS INTEGER) AS level FROM pdf_pages)) WHERE level > b + 1")
def heading_nesting(spark, d):
    h = pages.once(table(spark, d, "pdf_pages")).select("doc_id", c("page").alias("preorder"), (c("page").cast("bigint") * c("page") % 4 + 1).cast("int").alias("level"))  # the square of a page past 46,340 is no int
    return rules.heading_nesting(h).select("doc_id", "preorder", "level")


@R.query("hidden_information", "SELECT doc_id, 'metadata' AS category, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT doc_id, author FROM pdf_files) WHERE author IS NOT NULL UNION ALL SELECT doc_id, 'form fields', count(DISTINCT name) FROM fields GROUP BY doc_id UNION ALL SELECT doc_id, 'scripts', CAST(1 AS BIGINT) FROM (SELECT DISTINCT doc_id, has_javascript FROM pdf_files) WHERE has_javascript")
def hidden_information(spark, d):
    f = table(spark, d, "pdf_files").select("doc_id", "author", "has_javascript").distinct()
    return rules.hidden_information({"metadata": f.where("author is not null"), "form fields": table(spark, d, "fields").select("doc_id", "name").distinct(), "scripts": f.where("has_javascript")})
