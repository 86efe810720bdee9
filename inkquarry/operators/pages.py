"""Page sets: choosing, splitting, combining and labelling pages, as joins and windows over ``(doc_id, page)``.

Pages count from 1. An operator that takes a list of pages keeps the order of the list; positions come as ``pos``.
Rows without a page are left out. Windows are within one document's pages, never within its glyphs or words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_ranges(text: str, pages: int, labels: dict[str, int] | None = None) -> list[int]:
    """``1-3, 6, 9-`` as page numbers in order. Labels win over numbers; ranges may run backwards; out of bounds is an error."""
    labels = labels or {}
    out: list[int] = []

    def one(part: str) -> int:
        part = part.strip()
        if part in labels:
            return labels[part]
        if part.isdigit() and 1 <= int(part) <= pages:
            return int(part)
        raise ValueError(f"no page {part!r}")

    for part in filter(None, (p.strip() for p in text.split(","))):
        if part in labels:
            out.append(labels[part])
            continue
        cut = next((k for k, c in enumerate(part) if c == "-" and k and (part[:k].strip() in labels or part[:k].strip().isdigit())), None)
        if cut is None:
            out += range(1, one(part[1:]) + 1) if part.startswith("-") and len(part) > 1 else [one(part)]
            continue
        a = one(part[:cut])
        b = one(part[cut + 1 :]) if part[cut + 1 :].strip() else pages
        out += range(a, b + 1) if a <= b else range(a, b - 1, -1)
    return out


def ranges(text: Column, pages: Column) -> Column:
    """The same for a column of range texts without labels: an array of page numbers, bounds clipped."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+\s*(-\s*\d*)?$"))

    def span(p: Column) -> Column:
        a = F.regexp_extract(p, r"^(\d+)", 1).cast("int")
        b = F.regexp_extract(p, r"-\s*(\d+)$", 1)
        end = F.when(~p.contains("-"), a).when(b == "", pages).otherwise(b.try_cast("int"))
        return F.filter(F.sequence(a, end), lambda x: (x >= 1) & (x <= pages))

    return F.flatten(F.transform(parts, span))


def once(pages: DataFrame) -> DataFrame:
    """Every page key once: pages are delivered again with the same content."""
    return pages.where(F.col("page").isNotNull()).dropDuplicates(["doc_id", "page"])


def extract(pages: DataFrame, chosen: list[int]) -> DataFrame:
    """The chosen pages of every document, in the order of the list, a page as often as it is named."""
    order = F.posexplode(F.array(*(F.lit(p) for p in chosen)) if chosen else F.array().cast("array<int>"))
    wanted = pages.sparkSession.range(1).select(order.alias("pos", "page"))
    return pages.join(F.broadcast(wanted), "page").select(*pages.columns, "pos")


def delete(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    return pages.join(chosen, ["doc_id", "page"], "left_anti")


def by_parity(pages: DataFrame, odd: bool | None = None, landscape: bool | None = None) -> DataFrame:
    """Odd or even pages, and pages wider than high as shown."""
    from ..functions.geometry import displayed_size

    out = pages
    if odd is not None:
        out = out.where((F.col("page") % 2 == 1) == F.lit(odd))
    if landscape is not None:
        size = displayed_size(F.col("width"), F.col("height"), F.col("crop"), F.coalesce("rotation", F.lit(0)))
        out = out.where((size["width"] > size["height"]) == F.lit(landscape))
    return out


def narrowed(selected: DataFrame, odd: bool | None = None, reverse: bool = False) -> DataFrame:
    """Odd or even positions of a selection (not page numbers), perhaps from the end."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    out = selected.withColumn("k", F.row_number().over(w))
    if odd is not None:
        out = out.where((F.col("k") % 2 == 1) == F.lit(odd))
    last = Window.partitionBy("doc_id").orderBy(F.desc("k") if reverse else F.asc("k"))
    return out.withColumn("pos", F.row_number().over(last) - 1).drop("k")


def rotate(pages: DataFrame, degrees: int, chosen: Column | None = None) -> DataFrame:
    turned = F.pmod(F.coalesce("rotation", F.lit(0)) + degrees, F.lit(360))
    return pages.withColumn("rotation", F.when(chosen if chosen is not None else F.lit(True), turned).otherwise(F.col("rotation")).cast("int"))


def _numbered(pages: DataFrame, order: list[Column]) -> DataFrame:
    return pages.withColumn("page", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def move(pages: DataFrame, first: int, last: int, before: int) -> DataFrame:
    """Pages first..last put before another page, the rest keeps its order. Needs no sort: page numbers are arithmetic."""
    n, p = last - first + 1, F.col("page")
    moved = p.between(first, last)
    to = before - n if before > last else before
    rank = p - F.when(p > last, n).otherwise(0)
    return pages.withColumn("page", F.when(moved, p - first + to).when(rank >= to, rank + n).otherwise(rank).cast("int"))


def insert(pages: DataFrame, other: DataFrame, at: int) -> DataFrame:
    """The pages of ``other`` (with the same doc_id) before page ``at``; what follows moves up."""
    n = other.groupBy("doc_id").agg(F.max("page").alias("_n"))
    shifted = pages.join(n, "doc_id", "left").withColumn("page", F.when(F.col("page") >= at, F.col("page") + F.coalesce("_n", F.lit(0))).otherwise(F.col("page")).cast("int")).drop("_n")
    return shifted.unionByName(other.withColumn("page", (F.col("page") + at - 1).cast("int")), allowMissingColumns=True)


def duplicate(pages: DataFrame, chosen: Column) -> DataFrame:
    """Every chosen page twice, the copy after the page."""
    twice = pages.withColumn("copy", F.explode(F.when(chosen, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return _numbered(twice, [F.col("page"), F.col("copy")])


def replace(pages: DataFrame, other: DataFrame, first: int) -> DataFrame:
    """Content of ``other`` in place of pages first, first + 1 and so on; page numbers stay."""
    cols = [c for c in pages.columns if c not in ("doc_id", "page")]
    o = other.select("doc_id", (F.col("page") + first - 1).cast("int").alias("page"), *(F.col(c).alias(f"_{c}") for c in cols), F.lit(True).alias("_hit"))
    return pages.join(o, ["doc_id", "page"], "left").select("doc_id", "page", *(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in cols))


def combine(sources: list[DataFrame]) -> DataFrame:
    """Documents one after another: ``source`` numbers the input, ``page`` runs on within each doc_id of the result."""
    parts = [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return _numbered(out, [F.col("source"), F.col("page")])


def combine_selected(sources: list[tuple[DataFrame, list[int]]]) -> DataFrame:
    """The chosen pages of each input, in the order of its list, one input after another."""
    parts = [extract(s, chosen).withColumn("source", F.lit(i)) for i, (s, chosen) in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return _numbered(out, [F.col("source"), F.col("pos")]).drop("pos")


def by_label(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, wanted, page``: the first page with that label, else the page with that number, for pages ``doc_id, page, label``."""
    j = wanted.join(pages.select("doc_id", "page", "label"), "doc_id")
    labelled, number = F.min(F.when(F.col("label") == F.col("wanted"), F.col("page"))), F.min(F.when(F.col("page").cast("string") == F.col("wanted"), F.col("page")))
    return j.groupBy("doc_id", "wanted").agg(F.coalesce(labelled, number).alias("page")).where("page is not null")


# splitting


def split_every(pages: DataFrame, n: int) -> DataFrame:
    return pages.withColumn("part", F.floor((F.col("page") - 1) / n).cast("int"))


def split_before(pages: DataFrame, is_cut: Column) -> DataFrame:
    """A new part at every page where ``is_cut`` holds; a cut at the first page opens no empty part."""
    w = Window.partitionBy("doc_id").orderBy("page")
    return pages.withColumn("part", F.sum(F.when(is_cut & (F.col("page") > 1), 1).otherwise(0)).over(w).cast("int"))


def split_by_size(pages: DataFrame, size: str, limit: int) -> DataFrame:
    """Greedy parts whose sizes stay within a limit; a page larger than the limit is a part of its own.

    The running total starts anew at every cut, so it is a fold over the sizes of a document's pages, not a window.
    """
    rows = F.array_sort(F.collect_list(F.struct("page", F.col(size).cast("bigint").alias("s"))))
    folded = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("total"), F.expr("cast(array() as array<struct<page:int,part:int>>)").alias("out")),
        lambda acc, x: F.when(
            (acc["total"] > 0) & (acc["total"] + x["s"] > limit),
            F.struct((acc["part"] + 1).alias("part"), x["s"].alias("total"), F.concat(acc["out"], F.array(F.struct(x["page"].alias("page"), (acc["part"] + 1).alias("part")))).alias("out")),
        ).otherwise(F.struct(acc["part"].alias("part"), (acc["total"] + x["s"]).alias("total"), F.concat(acc["out"], F.array(F.struct(x["page"].alias("page"), acc["part"].alias("part")))).alias("out"))),
        lambda acc: acc["out"],
    )
    return pages.groupBy("doc_id").agg(folded.alias("f")).select("doc_id", F.inline("f"))


def split_by_marks(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Ranges between bookmarked pages: ``doc_id, first, last``; several marks on a page count once."""
    ends = pages.groupBy("doc_id").agg(F.max("page").alias("pages"))
    w = Window.partitionBy("doc_id").orderBy("page")
    cuts = marks.select("doc_id", "page").unionByName(ends.select("doc_id", F.lit(1).alias("page"))).distinct()
    return cuts.join(ends, "doc_id").where(F.col("page") <= F.col("pages")).select("doc_id", F.col("page").alias("first"), F.coalesce(F.lead("page").over(w) - 1, F.col("pages")).alias("last"))


# labels and numbers


def labels(pages: DataFrame, label_ranges: DataFrame) -> DataFrame:
    """Label of every page from ranges ``doc_id, first, style, prefix, start``: the last range that begins at or before it."""
    from ..functions.text import page_label

    both = pages.select("doc_id", "page", F.lit(1).alias("k"), F.lit(None).cast("struct<first:int,style:string,prefix:string,start:int>").alias("r")).unionByName(
        label_ranges.select("doc_id", F.col("first").alias("page"), F.lit(0).alias("k"), F.struct(F.col("first").cast("int").alias("first"), "style", "prefix", F.coalesce(F.col("start").cast("int"), F.lit(1)).alias("start")).alias("r"))
    )
    w = Window.partitionBy("doc_id").orderBy("page", "k").rowsBetween(Window.unboundedPreceding, 0)
    asof = both.withColumn("r", F.last("r", ignorenulls=True).over(w)).where("k = 1")
    number = F.col("page") - F.col("r.first") + F.col("r.start")
    return asof.select("doc_id", "page", F.when(F.col("r").isNull(), F.col("page").cast("string")).otherwise(page_label(F.col("r.style"), F.col("r.prefix"), number)).alias("label"))


def bates(pages: DataFrame, start: int = 1, digits: int = 6, prefix: str = "", suffix: str = "") -> DataFrame:
    """Running numbers over all pages of all documents.

    A running number over everything needs no global sort: the pages before a document are a running sum over one row
    for each document, in blocks of a range-partitioned order.
    """
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    base = running_sum(counts, "doc_id", "n").withColumnRenamed("before", "base")
    w = Window.partitionBy("doc_id").orderBy("page")
    seq = F.col("base") + F.row_number().over(w) + start - 1
    return pages.join(base.select("doc_id", "base"), "doc_id").withColumn("bates", F.concat(F.lit(prefix), F.lpad(seq.cast("string"), digits, "0"), F.lit(suffix))).drop("base")


def running_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    """``before``: sum of the values of all smaller keys. Two passes: by range block, then within the block."""
    bounds = df.select(F.percentile_approx(key, [k / 64 for k in range(1, 64)], 10_000).alias("b")).first()["b"] or []
    block = F.size(F.filter(F.array(*(F.lit(x) for x in sorted(set(bounds)))) if bounds else F.array().cast("array<bigint>"), lambda x: x < F.col(key)))
    d = df.withColumn("_block", block)
    totals = d.groupBy("_block").agg(F.sum(value).alias("_t"))
    # at most 64 rows
    starts = totals.withColumn("_start", F.coalesce(F.sum("_t").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_block", "_start")
    w = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return d.join(F.broadcast(starts), "_block").withColumn("before", F.col("_start") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_block", "_start")


def layout(pages: DataFrame, per_sheet: int, booklet: bool = False) -> DataFrame:
    """Sheet side and cell of every page for n-up printing, or for a folded booklet."""
    if not booklet:
        k = F.col("page") - 1
        return pages.withColumn("sheet", F.floor(k / per_sheet).cast("int")).withColumn("cell", (k % per_sheet).cast("int"))
    n = pages.groupBy("doc_id").agg((F.ceil(F.max("page") / 4) * 4).cast("int").alias("n"))
    p = F.col("page")
    front = p <= F.col("n") / 2
    side = F.when(front, p - 1).otherwise(F.col("n") - p)
    return pages.join(n, "doc_id").withColumn("sheet", side.cast("int")).withColumn("cell", F.when(front, F.when(p % 2 == 1, 1).otherwise(0)).otherwise(F.when(p % 2 == 1, 1).otherwise(0)).cast("int")).drop("n")


def poster(pages: DataFrame, rows: int, columns: int) -> DataFrame:
    """One row for each tile of a page that is printed over several sheets: ``tile_row, tile_column, clip`` in page space."""
    tiles = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(rows) for j in range(columns)))).alias("t")
    w, h = F.col("width").cast("double") / columns, F.col("height").cast("double") / rows
    i, j = F.col("t.i"), F.col("t.j")
    return pages.select("*", tiles).withColumn("clip", F.array(w * j, h * i, w * (j + 1), h * (i + 1))).withColumn("tile_row", i).withColumn("tile_column", j).drop("t")
