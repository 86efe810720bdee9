"""New document files of a folder as a stream: read as bytes, parsed per micro-batch, one row for each row of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.pdf import from_binary


def pdf_stream(spark: SparkSession, folder: str, table: str = "documents", files_per_trigger: int = 64) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return from_binary(files, table)


def newest(spark: SparkSession, folder: str, n: int = 100) -> DataFrame:
    """The newest files of a folder: a top-k report."""
    from pyspark.sql import functions as F

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)
    return f.select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), "path").limit(n)
