"""Gaps of source files, and run status from diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lexing import place
from ..schemas import KEYS

# Diagnostic codes that mean some source was not covered.
PARSE_FAILED = "parse_failed"
ROOT_NOT_FOUND = "root_not_found"
ROOT_GLOB_NOT_FOUND = "root_glob_not_found"
DS_IMPORT_UNRESOLVED = "ds_import_unresolved"
DS_EXPORT_UNRESOLVED = "ds_export_unresolved"
PACKAGE_ENTRYPOINT_UNRESOLVED = "package_entrypoint_unresolved"
DS_USAGE_UNRESOLVED = "ds_usage_unresolved"
GAP_CODES = [
    PARSE_FAILED, ROOT_NOT_FOUND, ROOT_GLOB_NOT_FOUND, DS_IMPORT_UNRESOLVED,
    DS_EXPORT_UNRESOLVED, PACKAGE_ENTRYPOINT_UNRESOLVED, DS_USAGE_UNRESOLVED,
]


def scan_status(runs: DataFrame, diagnostics: DataFrame, by=KEYS) -> DataFrame:
    """Partial if any gap is reported; the plain text scanner always is."""
    gaps = diagnostics.filter(F.col("code").isin(GAP_CODES)).select(*by).distinct().withColumn("_gap", F.lit(True))
    partial = F.col("_gap").isNotNull()
    if "language" in by:
        partial = partial | (F.col("language") == "basic")
    return runs.join(gaps, list(by), "left").withColumn(
        "status", F.when(partial, "partial").otherwise("complete")).drop("_gap")


def parse_gaps(files: DataFrame) -> DataFrame:
    """One ``parse_failed`` per lexed file that has brackets, elements, comments or literals without an end.

    It stands at the first of them.  What the rest of the file yields is kept.
    """
    first = F.get("gaps", F.lit(0))
    return files.filter(F.size("gaps") > 0).select(
        *KEYS, F.col("path").alias("file"), F.lit("error").alias("severity"), F.lit(PARSE_FAILED).alias("code"),
        F.concat(F.lit("source cannot be read ("), first["what"], F.lit("); file scanned with gaps")).alias("message"),
        F.inline(F.array(place(F.col("ends"), first["at"]))))
