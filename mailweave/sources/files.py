"""Attachment files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def attachment_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Every file below a folder: ``path, modificationTime, length, content`` of
    Spark's file source, plus ``filename`` and ``message_id`` (its folder's name).
    ``content`` is only read where it is used."""
    f = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder))
    return f.select("*", F.element_at(F.split("path", "/"), -1).alias("filename"),
                    F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("message_id"))
