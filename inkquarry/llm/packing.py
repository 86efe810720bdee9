"""Problem 6: documents into containers of fixed capacity.

Method: vector bin packing. An item has three sizes (tokens, segments, loss-bearing tokens) and a container a limit on
each: its capacity, the number of documents it may hold, and how many of its tokens may bear loss (``LOSS_ROOM``, so that
no container is all transcript while another is all cue numbers and times). The last two are parameters, or columns
``max_segments`` and ``max_loss`` of the specs. The dot-product heuristic fills one container at a time: of all items that still fit, the one whose sizes have the
largest dot product with the room left goes in, so items that use what is plentiful come first.

A document larger than the capacity is split into pieces of exactly the capacity and a rest; the pieces fill containers
alone and the rest is packed like an item. No other document is split.

At scale only keys and sizes move: texts are measured in the scan. Items are dealt into blocks by a hash of their key, so
no block depends on the order of files or on a hot source; each block is packed by one task. Blocks hold about ``BLOCK``
items, so the few containers a block leaves half empty don't matter.

Defined results: a document that bears more loss than a container may hold takes all of that limit; null and empty text has the end token only; ties go to the smaller key; a spec without capacity, or one
under 1, has no containers; repeated documents of one key are packed once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

BLOCK = 4096
#: Lines of cue numbers and times bear no loss.
_SILENT = r"(?m)^(?:\d+|[{\d][\d:.,{}]*(?: --> .*)?|[\d:.,]+,[\d:.,]+|WEBVTT.*)\r?$\n?"
#: A container takes this many segments for each 1,000 tokens, at least 8.
SEGMENTS_PER_1000 = 2.0
#: And this many times the loss-bearing tokens that its capacity usually holds, over all documents.
LOSS_ROOM = 1.25


def sizes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, tokens, loss``: one token for each UTF-8 byte and one end token (a public byte-level tokenizer)."""
    t = F.coalesce(F.col(text), F.lit(""))
    loss = F.octet_length(F.regexp_replace(t, _SILENT, "")) + 1
    return documents.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), (F.octet_length(t) + 1).cast("bigint").alias("tokens"), loss.cast("bigint").alias("loss"))


def usual_loss(measured: DataFrame) -> float:
    """Share of all tokens that bear loss."""
    got = measured.agg(F.sum("loss"), F.sum("tokens")).first()
    return got[0] / got[1] if got[1] else 1.0


def limits(specs: DataFrame, usual: float, segments_per_1000: float = SEGMENTS_PER_1000, loss_room: float = LOSS_ROOM) -> DataFrame:
    """``spec_id, capacity, max_segments, max_loss`` of the specs that have a capacity, each once. ``usual`` is the usual share of loss."""
    loss_share = min(1.0, loss_room * usual)
    cap = F.col("capacity_tokens").cast("bigint")
    given = {c: F.col(c) if c in specs.columns else F.lit(None) for c in ("max_segments", "max_loss")}
    segments = F.coalesce(given["max_segments"].cast("bigint"), F.greatest(F.lit(8), F.floor(cap * segments_per_1000 / 1000)).cast("bigint"))
    loss = F.coalesce(given["max_loss"].cast("bigint"), F.ceil(cap * loss_share).cast("bigint"))
    kept = specs.where("capacity_tokens >= 1").select(F.col("spec_id").cast("int").alias("spec_id"), cap.alias("capacity"), F.greatest(segments, F.lit(1)).alias("max_segments"), F.greatest(loss, F.lit(1)).alias("max_loss"))
    return kept.dropDuplicates(["spec_id"])


def pieces(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """``spec_id, capacity, max_segments, max_loss, doc_id, piece, n_pieces, tokens, loss``, every document for each row of ``limits``.

    The specs are joined to all documents, as asked for: their table is broadcast while its size is that of a handful of rows.
    """
    s = F.broadcast(bounds) if bounds.limit(1001).count() <= 1000 else bounds
    whole = F.expr("cast(floor((tokens - 1) / capacity) as int)")
    each = measured.crossJoin(s).withColumn("full", whole).withColumn("n_pieces", F.col("full") + 1)
    out = each.select("spec_id", "capacity", "max_segments", "max_loss", "doc_id", "n_pieces", "tokens", "loss", F.explode(F.sequence(F.lit(0), F.col("full"))).alias("piece"))
    part = F.when(F.col("piece") < F.col("n_pieces") - 1, F.col("capacity")).otherwise(F.col("tokens") - F.col("capacity") * (F.col("n_pieces") - 1))
    return out.withColumn("part", part).select(
        "spec_id", "capacity", "max_segments", "max_loss", "doc_id", "piece", "n_pieces", F.col("part").alias("tokens"), F.least(F.ceil(F.col("loss") * F.col("part") / F.col("tokens")), F.col("part")).cast("bigint").alias("loss")
    )


def dot_product_pack(vectors: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of every item. Items are (n, 3) sizes, each within the limits; equal items are taken in order."""
    n = len(vectors)
    scaled = vectors / limits
    left = np.arange(n)[np.lexsort((np.arange(n), -scaled[:, 0]))]
    out = np.full(n, -1)
    container = 0
    while len(left):
        room = np.ones(vectors.shape[1])
        v = scaled[left]
        open_ = np.ones(len(left), bool)
        first = 0
        while True:
            fits = open_[first:] & (v[first:] <= room + 1e-12).all(axis=1)
            if not fits.any():
                break
            score = np.where(fits, v[first:] @ room, -1.0)
            # the largest product; of equal ones the first, that is the largest item of smallest key
            k = first + int(np.argmax(score))
            out[left[k]] = container
            open_[k] = False
            room = room - v[k]
            if room[0] <= 0:
                break
            # items are in falling order of tokens: those before the first that fits are too large from now on
            first = int(np.searchsorted(-v[:, 0], -(room[0] + 1e-12)))
            if first >= len(left):
                break
        left = left[open_]
        container += 1
    return out


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
    bounds = pdf[["capacity", "max_segments", "max_loss"]].iloc[0].to_numpy(float)
    v = np.stack([pdf["tokens"].to_numpy(float), np.ones(len(pdf)), np.minimum(pdf["loss"].to_numpy(float), bounds[2])], axis=1)
    at = dot_product_pack(v, bounds)
    name = [f"b{b}-{k}" for b, k in zip(pdf["block"], at, strict=True)]
    return pd.DataFrame({"spec_id": pdf["spec_id"], "container": name, "doc_id": pdf["doc_id"], "piece": pdf["piece"], "n_pieces": pdf["n_pieces"], "tokens": pdf["tokens"], "loss": pdf["loss"]})


def pack(documents: DataFrame, specs: DataFrame, block: int = BLOCK, segments_per_1000: float = SEGMENTS_PER_1000, loss_room: float = LOSS_ROOM) -> DataFrame:
    """``spec_id, container, doc_id, piece, n_pieces, tokens, loss``. Whole pieces of split documents have containers of their own."""
    # texts are read once; what is packed are sizes
    measured = stored(sizes(documents).dropDuplicates(["doc_id"]), "packing-sizes")
    items = pieces(measured, limits(specs, usual_loss(measured), segments_per_1000, loss_room))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block)).cast("int"))
    count = items.where("piece = n_pieces - 1").groupBy("spec_id").agg(F.count("*").alias("n")).select("spec_id", n_blocks.alias("blocks"))
    dealt = items.where("piece = n_pieces - 1").join(F.broadcast(count), "spec_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    out = "spec_id int, container string, doc_id bigint, piece int, n_pieces int, tokens bigint, loss bigint"
    packed = dealt.drop("blocks").groupBy("spec_id", "block").applyInPandas(_pack_block, out)
    own = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string"))
    full = items.where("piece < n_pieces - 1").select("spec_id", own.alias("container"), "doc_id", "piece", "n_pieces", "tokens", "loss")
    return packed.unionByName(full)


def split_documents(packed: DataFrame) -> DataFrame:
    """``spec_id, doc_id`` of the documents that had to be split: larger than a container."""
    return packed.where("n_pieces > 1").groupBy("spec_id", "doc_id").agg(F.count("*").alias("n")).select("spec_id", "doc_id")


def fill(packed: DataFrame, specs: DataFrame, segments_per_1000: float = SEGMENTS_PER_1000, loss_room: float = LOSS_ROOM) -> DataFrame:
    """How well the containers of each spec are used: ``spec_id, containers, tokens, filled``, and for each limit the number of
    containers that are within 2 % of it (``full_tokens, full_segments, full_loss``)."""
    one = packed.where(F.col("spec_id") == packed.agg(F.min("spec_id")).first()[0])
    bounds = limits(specs, usual_loss(one), segments_per_1000, loss_room)
    per = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("s"), F.sum("loss").alias("l"))
    each = per.join(F.broadcast(bounds) if bounds.limit(1001).count() <= 1000 else bounds, "spec_id")
    near = lambda used, most: F.count_if(F.col(used) >= 0.98 * F.col(most))
    out = each.groupBy("spec_id", "capacity").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), near("t", "capacity").alias("full_tokens"), near("s", "max_segments").alias("full_segments"), near("l", "max_loss").alias("full_loss"))
    return out.select("spec_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4).alias("filled"), "full_tokens", "full_segments", "full_loss")
