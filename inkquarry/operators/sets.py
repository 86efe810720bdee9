"""Duplicates, references, audits and graph walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored


#: Parts that the rows of one content are dealt into when they look up what they are merged into.
_SALTS = 32


def dedupe(df: DataFrame, content: list[str], key: str) -> DataFrame:
    """``key, keep``: every row with the smallest key of the rows of equal content.

    Equal content meets by a 256-bit digest, so long texts are not shuffled, and the smallest key of each digest is found by
    a pre-aggregated group. Rows look it up by digest and a salt, so a content that a third of all rows share is spread over
    ``_SALTS`` parts; contents that occur once are not looked up. Nulls equal nulls.
    """
    # nulls and empty texts differ: the text is taken apart as a struct
    digest = F.sha2(F.to_json(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(content))), {"ignoreNullFields": "false"}), 256)
    d = df.select(F.col(key), digest.alias("_digest"))
    keep = d.groupBy("_digest").agg(F.min(key).alias("keep"), F.count("*").alias("_n")).where("_n > 1")
    salted = keep.select("_digest", "keep", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt"))
    j = d.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(_SALTS)).cast("int")).join(salted, ["_digest", "_salt"], "left")
    return j.select(key, F.coalesce("keep", key).alias("keep"))


def dedupe_structure(objects: DataFrame) -> DataFrame:
    """``id, keep`` for objects ``id, content, refs array<id>``: objects are equal if content and the objects they refer to are.

    Each round replaces references by what they were merged into; rounds end when nothing more merges, so there are as
    many as the longest equal chains are deep.
    """
    now = objects.select("id", F.col("id").alias("keep"))
    merged = -1
    while True:
        flat = objects.select("id", "content", F.posexplode_outer("refs").alias("at", "ref")).join(now.select(F.col("id").alias("ref"), F.col("keep").alias("to")), "ref", "left")
        form = flat.groupBy("id", "content").agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("refs"))
        now = stored(dedupe(form, ["content", "refs"], "id"), "dedupe-structure")
        count = now.where("id <> keep").count()
        if count == merged:
            return now
        merged = count


def unreferenced(targets: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Targets that nothing refers to."""
    return targets.join(references.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def dangling(references: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """References to nothing."""
    return references.where(F.col(key).isNotNull()).join(targets.select(key), key, "left_anti")


def overlap_anti(left: DataFrame, right: DataFrame, eps: float = 0.0) -> DataFrame:
    """Rows of ``left`` whose rectangle overlaps none of ``right`` on the same page. The page is an equi key, so no pairs across pages."""
    from ..functions.geometry import overlaps

    r = right.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("rect").alias("_r"))
    return left.join(r, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & overlaps(F.col("rect"), F.col("_r"), eps), "left_anti")


def shares(df: DataFrame, by: list[str], amount: Column, of: Column | None = None) -> DataFrame:
    """``by, amount, percent``: sums with their share of all. The total is one row, joined by its size."""
    per = df.groupBy(*by).agg(F.sum(amount).alias("amount"))
    total = df.agg(F.sum(of if of is not None else amount).alias("total"))
    return per.crossJoin(F.broadcast(total)).select(*by, "amount", F.round(F.try_divide(F.col("amount").cast("double") * 100, F.col("total")), 4).alias("percent"))


def closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``src, dst, depth``: everything reachable, at its least depth. Paths double each round, so depth n takes log n rounds."""
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct().withColumn("depth", F.lit(1))
    paths, size = stored(e, "closure"), -1
    for _ in range(most_rounds):
        n = paths.count()
        if n == size:
            break
        size = n
        step = paths.alias("a").join(paths.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        paths = stored(paths.unionByName(step).groupBy("src", "dst").agg(F.min("depth").alias("depth")), "closure")
    return paths


def claims(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``id, owner``: every node goes to the root of smallest priority that reaches it; roots are ``id, priority``.

    Each round walks one hop and rounds end when nothing changes: owners only get smaller, so that comes to an end.
    """
    owner = stored(roots.select("id", F.col("priority").alias("owner")), "claims")
    while True:
        step = owner.join(edges, owner["id"] == edges["src"]).select(F.col("dst").alias("id"), "owner")
        new = stored(owner.unionByName(step).groupBy("id").agg(F.min("owner").alias("owner")), "claims")
        if new.exceptAll(owner).isEmpty():
            return new
        owner = new
