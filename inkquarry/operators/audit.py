"""Reports over files: space by category, tallies, digests, resolution of images, sorted lists of files to combine.

Defined results: nulls count as nothing, a file without objects is all overhead, an image that is used nowhere has no
resolution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The categories of a space audit, in the order in which an object is claimed.
CATEGORIES = (
    "Images", "Content Streams", "Fonts", "X Object Forms", "Structure Info", "Bookmarks", "Thumbnails", "Comments", "Forms", "Named Destinations", "Color Spaces", "Shadings", "Patterns",
    "Extended Graphics States", "Embedded Files", "Document Overhead",
)


def space_by_category(claims: DataFrame, files: DataFrame) -> DataFrame:
    """``doc_id, category, bytes, percent`` of claims ``doc_id, num, category, bytes`` and files ``doc_id, file_size``.

    An object that several categories reach counts in the first of them; what no category claims is overhead.
    """
    order = F.array(*map(F.lit, CATEGORIES))
    rank = F.array_position(order, F.col("category"))
    one = claims.where(rank > 0).groupBy("doc_id", "num").agg(F.min(F.struct(rank.alias("rank"), "bytes")).alias("x"))
    per = one.groupBy("doc_id", F.col("x.rank").alias("rank")).agg(F.sum("x.bytes").alias("bytes"))
    size = files.groupBy("doc_id").agg(F.max("file_size").alias("file_size"))
    claimed = per.groupBy("doc_id").agg(F.sum("bytes").alias("claimed"))
    rest = size.join(claimed, "doc_id", "left").select("doc_id", F.lit(len(CATEGORIES)).cast("bigint").alias("rank"), F.greatest(F.col("file_size") - F.coalesce("claimed", F.lit(0)), F.lit(0)).alias("bytes"))
    every = per.unionByName(rest).groupBy("doc_id", "rank").agg(F.sum("bytes").alias("bytes"))
    percent = F.round(F.try_divide(F.col("bytes").cast("double") * 100, F.col("file_size")), 4)
    return every.join(size, "doc_id").select("doc_id", F.element_at(order, F.col("rank").cast("int")).alias("category"), "bytes", percent.alias("percent"))


def tally(df: DataFrame, status: str) -> DataFrame:
    """``status, n``: what stands before the first colon, counted."""
    return df.where(F.col(status).isNotNull()).groupBy(F.substring_index(F.col(status), ":", 1).alias("status")).agg(F.count("*").alias("n"))


def savings(images: DataFrame) -> DataFrame:
    """``doc_id, images, changed, bytes_before, bytes_after, saved`` of images ``doc_id, before, after``; no value after is left as it was."""
    after = F.coalesce("after", "before")
    return images.groupBy("doc_id").agg(F.count("*").alias("images"), F.count_if(after != F.col("before")).alias("changed"), F.sum("before").alias("bytes_before"), F.sum(after).alias("bytes_after")).withColumn("saved", F.col("bytes_before") - F.col("bytes_after"))


def digest(data: Column, ranges: Column, bits: int = 256) -> Column:
    """SHA-2 of the byte ranges ``array<struct<at,length>>`` of a file, one after the other."""
    parts = F.transform(ranges, lambda r: F.hex(F.substring(data, r["at"] + 1, r["length"])))
    return F.sha2(F.unhex(F.array_join(parts, "")), bits)


def image_ppi(uses: DataFrame) -> DataFrame:
    """``doc_id, image, ppi``: the least resolution that an image is shown at, of ``doc_id, image, pixels_x, pixels_y, width, height`` (points)."""
    across = F.try_divide(F.col("pixels_x") * 72.0, F.abs("width"))
    down = F.try_divide(F.col("pixels_y") * 72.0, F.abs("height"))
    return uses.groupBy("doc_id", "image").agg(F.min(F.least(across, down)).alias("ppi"))


def combine_order(files: DataFrame, by: str, descending: bool = False, group: str | None = None) -> DataFrame:
    """``place`` of each file in a list to combine: by name (natural order), pages, size, modified or warnings; the name breaks ties.

    Files without a value come last in either direction.
    """
    from ..functions.text import natural_key

    name = natural_key(F.col("name"))
    key = name if by == "name" else F.col(by)
    first = key.desc_nulls_last() if descending else key.asc_nulls_last()
    keys = [*([F.col(group)] if group else []), first, name.asc(), F.col("name").asc()]
    return files.withColumn("place", F.row_number().over(Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy(*keys[1 if group else 0 :])))


def sniff(name: Column, data: Column) -> Column:
    """``pdf``, ``image`` or ``text`` by the first bytes and the name; null for all else."""
    head = F.hex(F.substring(data, 1, 1024))
    image = head.startswith("FFD8") | head.startswith("89504E470D0A1A0A") | head.startswith("47494638") | head.startswith("49492A00") | head.startswith("4D4D002A")
    image = image | (head.startswith("424D") & F.substring(head, 29, 8).isin("0C000000", "28000000", "34000000", "38000000", "6C000000", "7C000000"))
    text = F.lower(name).rlike(r"\.te?xt$")
    return F.when(head.rlike("^(?:..)*255044462D"), "pdf").when(image, "image").when(text, "text")


def whole(v: Column) -> Column:
    """A number without a fraction as a whole one, else null."""
    return F.when((v == F.floor(v)) & (F.abs(v) < 2**53), v.cast("bigint"))


def device_colours(ops: DataFrame) -> DataFrame:
    """``doc_id, device_rgb, device_cmyk``: whether content operators ``doc_id, op`` set device colours (grey counts with RGB)."""
    op = F.col("op")
    return ops.groupBy("doc_id").agg(F.coalesce(F.bool_or(op.isin("rg", "RG", "g", "G")), F.lit(False)).alias("device_rgb"), F.coalesce(F.bool_or(op.isin("k", "K")), F.lit(False)).alias("device_cmyk"))


def declared(xmp: DataFrame) -> DataFrame:
    """``doc_id, archive, accessible``: the standards that metadata ``doc_id, key, value`` claims, as ``2b`` and ``1``; null where there is none."""
    keys = ["pdfaid:part", "pdfaid:conformance", "pdfuaid:part"]
    wide = xmp.groupBy("doc_id").pivot("key", keys).agg(F.min(F.trim("value")))
    part, level, ua = (F.col(f"`{k}`") for k in keys)
    return wide.select("doc_id", F.concat(part, F.lower(F.coalesce(level, F.lit("")))).alias("archive"), ua.alias("accessible"))
