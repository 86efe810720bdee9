"""Named pipelines of edits over the tables of many documents, and a check of a whole corpus.

A step is a function of the tables (files, pages, annotations, fields, ...) that gives new ones; a pipeline is a chain of
lazy plans, so it runs as one job over all documents. Steps that only change page content (watermarks, flattening,
recognition) have no table to change and are not offered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formcalc, text
from . import edits, layout

Tables = dict[str, DataFrame]
Step = Callable[[Tables], Tables]


def remove_hidden(*categories: str) -> Step:
    return lambda t: edits.remove_hidden(t, list(categories) or list(edits.HIDDEN))


def sanitize() -> Step:
    return edits.sanitize


def set_title(title: str) -> Step:
    """The same title for every file; an empty one takes it away."""

    def step(t: Tables) -> Tables:
        return t | {"files": edits.set_info(t["files"], t["files"].select("doc_id", F.lit("title").alias("key"), F.lit(title).alias("value")))}

    return step


def add_line(where: str, template: str) -> Step:
    """A ``header`` or ``footer`` on every page, with page numbers put in."""

    def step(t: Tables) -> Tables:
        pages = t["pages"]
        counted = pages.join(pages.groupBy("doc_id").agg(F.max("page").alias("_n")), "doc_id")
        return t | {"pages": counted.withColumn(where, text.header_tokens(template, F.col("page"), F.col("_n"))).drop("_n")}

    return step


def detect_fields() -> Step:
    """Fields for what the lines leave blank, named after their label and place."""

    def step(t: Tables) -> Tables:
        found = layout.field_candidates(t["lines"])
        label = F.when(F.col("label") == "", "field").otherwise(F.col("label"))
        new = found.select("doc_id", F.concat_ws("_", label, F.concat(F.lit("p"), "page"), F.concat(F.lit("l"), "line")).alias("name"), "kind", "page")
        return t | {"fields": edits.add_fields(t["fields"], new)}

    return step


def run_script(field: str, script: str) -> Step:
    """A field's value from the form language over the other fields of its document, one value each."""

    def step(t: Tables) -> Tables:
        fields = t["fields"]
        names = sorted(set(formcalc.names(script)))
        wide = fields.where(F.col("name").isin(names)).groupBy("doc_id").pivot("name", names).agg(F.first(F.get("value", F.lit(0))))
        value = formcalc.formcalc(script, {n: F.col(f"`{n}`") for n in names})
        done = wide.select("doc_id", F.lit(field).alias("name"), F.array(formcalc.fc_str(value, number=True)).alias("value"))
        return t | {"fields": edits.patch(fields, ["doc_id", "name"], done, ["value"])}

    return step


ACTIONS: dict[str, list[Step]] = {
    "Prepare for Distribution": [remove_hidden()],
    "Add Page Numbers": [add_line("footer", "Page <<1>> of <<n>>")],
    "Sanitize Documents": [sanitize()],
}


def run(tables: Tables, steps: str | list[Step]) -> Tables:
    """The tables after all steps, or after those of a named action."""
    for step in ACTIONS[steps] if isinstance(steps, str) else steps:
        tables = step(tables)
    return tables


def check(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """``path, status``: ``open-error: why`` where a file could not be opened, ``page-errors`` where a table of it could not be read, else ``ok``."""
    bad = errors.groupBy("path").agg(F.count("*").alias("_n"))
    reason = F.get("warnings", F.lit(0))
    status = F.when(F.coalesce(F.col("pdf_version"), F.lit("")) == "", F.concat(F.lit("open-error: "), F.coalesce(reason, F.lit("no header")))).when(F.col("_n").isNotNull(), "page-errors").otherwise("ok")
    return documents.join(bad, "path", "left").select("path", status.alias("status"))
