"""Paths of form nodes (``form[0].items[0].qty[2]``): patterns, and names as scripts write them.

A name without an index means the first of its name. ``[*]`` means all, ``..`` any depth, ``parent`` the node above,
``$`` the node the script belongs to, ``$form`` and ``$record`` the root. A name that a script uses is looked for below the
script's node first, then below each node above it; the nearest place that has it wins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"(\.\.|\.)?([^.\[\]]+)(?:\[(\*|\d+)\])?")


def pattern(expression: str) -> str:
    """A regular expression over whole paths for an expression that begins at the root."""
    out, at = "^", 0
    text = re.sub(r"^\$(form|record|data)\b", "", expression)
    first = True
    if text != expression and not text:
        return r"^[^.]+$"
    if text != expression:
        out += r"[^.]+"
        first = False
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"no path: {expression!r}")
        any_depth = m[1] == ".."
        out += (r"(?:[^.]+\.)*" if first else r"\.(?:[^.]+\.)*") if any_depth else "" if first else r"\."
        out += re.escape(m[2]) + (r"\[\d+\]" if m[3] == "*" else re.escape(f"[{m[3] or 0}]"))
        first, at = False, m.end()
    return out + "$"


def find(nodes: DataFrame, expression: str, path: str = "path") -> DataFrame:
    """The nodes that an absolute expression means."""
    return nodes.where(F.col(path).rlike(pattern(expression)))


def indexed(name: Column) -> Column:
    """A relative name with an index in every part that has none."""
    return F.array_join(F.transform(F.split(name, r"\."), lambda x: F.when(x.endswith("]"), x).otherwise(F.concat(x, F.lit("[0]")))), ".")


def _above(path: Column) -> Column:
    """The path and all paths above it, the longest first, then nothing (for the root)."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def resolve(nodes: DataFrame, references: DataFrame, key: str = "rec_id", path: str = "path") -> DataFrame:
    """``references`` (key, context, name) with ``found``: the path that each name means at the node ``context``, or null.

    Candidates are made from the context and meet the nodes by an equi join, so a record's nodes are never paired.
    """
    steps = F.regexp_replace("name", r"^\$\.", "")
    ups = F.length(F.regexp_extract(steps, r"^((?:parent\.)*)", 1)) / 7
    rest = F.regexp_replace(steps, r"^(?:parent\.)+", "")
    above = _above(F.col("context"))
    base = F.when(ups > 0, F.slice(above, (ups + 1).cast("int"), F.lit(1))).otherwise(above)
    tried = references.select(key, "context", "name", F.posexplode(base).alias("_near", "_base"), indexed(rest).alias("_rest")).withColumn(path, F.when(F.col("_base") == "", F.col("_rest")).otherwise(F.concat("_base", F.lit("."), "_rest")))
    hit = tried.join(nodes.select(key, path).distinct(), [key, path]).groupBy(key, "context", "name").agg(F.min_by(path, "_near").alias("found"))
    return references.join(hit, [key, "context", "name"], "left")
