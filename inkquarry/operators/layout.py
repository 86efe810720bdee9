"""Layout of pages: text in reading order, line boxes, body size, headings, tables, fields to fill in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textlines import glyph_lines


def page_text(glyphs: DataFrame) -> DataFrame:
    """``doc_id, page, text``: lines of a page, one below the other."""
    return glyph_lines(glyphs).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))


def text_export(glyphs: DataFrame) -> DataFrame:
    """``doc_id, text``: pages with a form feed between them, blanks at their ends cut off."""
    pages = page_text(glyphs).withColumn("text", F.regexp_replace("text", r" +$", ""))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\f").alias("text"))


def line_rects(glyphs: DataFrame) -> DataFrame:
    """``doc_id, page, line, x0, y0, x1, y1``: one box for each line; repeated glyphs change nothing."""
    r = F.col("rect")
    return glyphs.where(r.isNotNull() & F.col("line").isNotNull()).groupBy("doc_id", "page", "line").agg(F.min(r[0]).alias("x0"), F.min(r[1]).alias("y0"), F.max(r[2]).alias("x1"), F.max(r[3]).alias("y1"))


def nearest(glyphs: DataFrame, x: float, y: float) -> DataFrame:
    """The glyph of every page nearest to a point; heights count three times."""
    r = F.col("rect")
    dx = F.greatest(r[0] - x, x - r[2], F.lit(0.0))
    dy = F.greatest(r[1] - y, y - r[3], F.lit(0.0))
    return glyphs.where(r.isNotNull()).groupBy("doc_id", "page").agg(F.min_by(F.struct("ord", "text"), F.struct((dx + 3 * dy).alias("d"), "ord")).alias("g")).select("doc_id", "page", "g.ord", "g.text")


def body_size(lines: DataFrame) -> DataFrame:
    """``doc_id, size``: the half-point size most characters are set in; of equal ones the smaller."""
    b = F.round(F.col("size") * 2) / 2
    per = lines.groupBy("doc_id", b.alias("size")).agg(F.sum(F.length("text")).alias("n"))
    return per.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("size"))


def heading_level(size: Column, body: Column, bold: Column, text: Column) -> Column:
    """1 from 1.6 times the body size, 2 from 1.25 times or for bold short lines, else null."""
    return F.when(size >= 1.6 * body, 1).when((size >= 1.25 * body) | (bold & (F.length(text) < 80) & ~text.rlike(r"[.,;:]$")), 2)


def segments(df: DataFrame, gap: float) -> DataFrame:
    """Words of a line that stand apart by more than a gap become segments: gaps and islands over one line."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page", "line").orderBy("ord")
    new = (F.col("rect")[0] - F.lag(F.col("rect")[2]).over(w)) > gap
    return df.withColumn("segment", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w))


def reading_rows(df: DataFrame, height: float = 8.0) -> DataFrame:
    """``row`` for boxes of a page: middles within a height of the row's first box share a row (anchored, so it is a fold)."""
    mid = (F.col("rect")[1] + F.col("rect")[3]) / 2
    items = F.array_sort(F.collect_list(F.struct(mid.alias("m"), F.col("rect")[0].alias("x"), "id")))
    folded = F.aggregate(
        items,
        F.struct(F.lit(-1).alias("row"), F.lit(float("-inf")).alias("at"), F.expr("cast(array() as array<struct<id:bigint,row:int>>)").alias("out")),
        lambda acc, x: F.when(x["m"] - acc["at"] <= height, F.struct(acc["row"].alias("row"), acc["at"].alias("at"), F.concat(acc["out"], F.array(F.struct(x["id"].cast("bigint").alias("id"), acc["row"].alias("row")))).alias("out"))).otherwise(
            F.struct((acc["row"] + 1).alias("row"), x["m"].cast("double").alias("at"), F.concat(acc["out"], F.array(F.struct(x["id"].cast("bigint").alias("id"), (acc["row"] + 1).alias("row")))).alias("out"))
        ),
        lambda acc: acc["out"],
    )
    rows = df.groupBy("doc_id", "page").agg(folded.alias("r")).select("doc_id", "page", F.inline("r"))
    return df.join(rows, ["doc_id", "page", "id"])


def _cluster(values: list[float], near: float) -> list[float]:
    """Running means of sorted values that stay within a distance."""
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - out[-1][0] / out[-1][1] <= near:
            out[-1][0] += v
            out[-1][1] += 1
        else:
            out.append([v, 1])
    return [s / n for s, n in out]


def tables(df: DataFrame, near: float = 4.0, most_columns: int = 64) -> DataFrame:
    """``doc_id, page, table, row, column, text`` of boxes ``doc_id, page, rect, text`` that line up in rows and columns.

    Rows are boxes whose heights overlap; a table is two or more rows in a row with two or more boxes each, columns their
    clustered left edges. The group is one page.
    """

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = sorted(((r[1], r[3], r[0], t) for r, t in zip(pdf["rect"], pdf["text"], strict=True) if r is not None), key=lambda b: (b[0], b[2]))
        rows: list[list[tuple]] = []
        for b in boxes:
            if rows and b[0] < max(x[1] for x in rows[-1]) - 0.5 * (b[1] - b[0]):
                rows[-1].append(b)
            else:
                rows.append([b])
        out, k, i = [], 0, 0
        while i < len(rows):
            j = i
            while j < len(rows) and len(rows[j]) > 1:
                j += 1
            if j - i > 1:
                edges = _cluster([b[2] for r in rows[i:j] for b in r], near)[:most_columns]
                if len(edges) > 1:
                    for n, r in enumerate(rows[i:j]):
                        for b in r:
                            out.append((k, n, min(range(len(edges)), key=lambda c: abs(edges[c] - b[2])), b[3]))  # noqa: B023
                    k += 1
            i = max(j, i + 1)
        got = pd.DataFrame(out, columns=["table", "row", "column", "text"])
        got.insert(0, "page", pdf["page"].iloc[0])
        got.insert(0, "doc_id", pdf["doc_id"].iloc[0])
        return got

    return df.groupBy("doc_id", "page").applyInPandas(page, "doc_id bigint, page int, table int, row int, column int, text string")


def field_candidates(lines: DataFrame) -> DataFrame:
    """``doc_id, page, line, kind, label``: runs of underscores and brackets to fill in, with the words before them."""
    blank, box = r"_{3,}", r"\[[ _]?\]|☐|□"
    t = F.col("text")
    kind = F.when(t.rlike(blank), "text").when(t.rlike(box), "checkbox")
    label = F.trim(F.regexp_replace(F.when(t.rlike(blank), F.regexp_extract(t, rf"^(.*?)\s*{blank}", 1)).otherwise(F.regexp_replace(t, box, "")), r"[:\s]+$", ""))
    return lines.where(t.rlike(f"{blank}|{box}")).select("doc_id", "page", "line", kind.alias("kind"), label.alias("label"))


def to_html(paragraphs: DataFrame) -> DataFrame:
    """``doc_id, html`` of paragraphs ``doc_id, seq, level, text``."""
    t = F.coalesce("text", F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    tag = F.when(F.col("level").isNotNull(), F.concat(F.lit("h"), F.col("level").cast("string"))).otherwise("p")
    line = F.concat(F.lit("<"), tag, F.lit(">"), t, F.lit("</"), tag, F.lit(">"))
    return paragraphs.groupBy("doc_id").agg(F.concat(F.lit("<!DOCTYPE html><html><body>\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("h")))), lambda x: x["h"]), "\n"), F.lit("\n</body></html>\n")).alias("html"))


def glyph_spans(glyphs: DataFrame) -> DataFrame:
    """``doc_id, page, ord, word_first, word_last, line_first, line_last``: the word and the line around every glyph, by their first and last ord.

    A word ends at a blank before a glyph, at a blank glyph and at the line's end; a blank glyph is a word of its own.
    Lines are taken apart one by one, so the group is a line.
    """
    from pyspark.sql import Window

    g = glyphs.where(F.col("ord").isNotNull() & F.col("line").isNotNull()).dropDuplicates(["doc_id", "page", "ord"])
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\s\p{Z}]")
    w = Window.partitionBy("doc_id", "page", "line").orderBy("ord")
    new = F.coalesce("space_before", F.lit(False)) | blank | F.coalesce(F.lag(blank).over(w), F.lit(True))
    numbered = g.withColumn("_word", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    line, word = Window.partitionBy("doc_id", "page", "line"), Window.partitionBy("doc_id", "page", "line", "_word")
    return numbered.select("doc_id", "page", "ord", F.min("ord").over(word).alias("word_first"), F.max("ord").over(word).alias("word_last"), F.min("ord").over(line).alias("line_first"), F.max("ord").over(line).alias("line_last"))


def text_lines(glyphs: DataFrame) -> DataFrame:
    """``doc_id, page, line, text, rect, size``: lines with their box and the height most of their glyphs have (half points)."""
    r = F.col("rect")
    boxes = line_rects(glyphs).select("doc_id", "page", "line", F.array("x0", "y0", "x1", "y1").alias("rect"))
    heights = glyphs.where(r.isNotNull() & F.col("line").isNotNull()).dropDuplicates(["doc_id", "page", "ord"]).groupBy("doc_id", "page", "line", (F.round((r[3] - r[1]) * 2) / 2).alias("size")).agg(F.count("*").alias("n"))
    size = heights.groupBy("doc_id", "page", "line").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("size"))
    return glyph_lines(glyphs).join(boxes, ["doc_id", "page", "line"]).join(size, ["doc_id", "page", "line"])


def text_blocks(lines: DataFrame) -> DataFrame:
    """``doc_id, page, block, first_line, last_line, text``: paragraphs of ``text_lines``, one page at a time.

    A line goes on with the block above if it has its size, is set at the same left, middle or right, and follows at
    0.8 to 2.5 times its size, at about the distance of the block's first two lines. A hyphen at a line's end is dropped.
    """
    per = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line", "text", "rect", "size"))).alias("l"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for doc, page, ls in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                block, gap, last = None, None, None
                for x in ls:
                    joins = False
                    if last is not None:
                        a, z, tol = last["rect"], x["rect"], max(1.0, x["size"])
                        step = z[3] - a[3]
                        aligned = abs(a[0] - z[0]) < tol or abs(a[0] + a[2] - z[0] - z[2]) / 2 < tol or abs(a[2] - z[2]) < tol
                        joins = abs(last["size"] - x["size"]) < 0.01 and aligned and 0.8 * x["size"] < step < 2.5 * x["size"] and (gap is None or abs(step - gap) < 0.2 * gap)
                    if joins:
                        gap = gap or step
                        block[5] = block[5][:-1] + x["text"].strip() if block[5].endswith("-") else f"{block[5]} {x['text'].strip()}"
                        block[4] = x["line"]
                    else:
                        block, gap = [doc, page, 0 if block is None else block[2] + 1, x["line"], x["line"], x["text"].strip()], None
                        rows.append(block)
                    last = x
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "page", "block", "first_line", "last_line", "text"])

    return per.mapInArrow(run, "doc_id bigint, page int, block int, first_line int, last_line int, text string")
