"""Schema-change ledger: which files are pending, edited since, or unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def checksum(sql_text: Column) -> Column:
    """Independent of the line endings a checkout happened to produce."""
    return F.sha2(F.replace(sql_text, F.lit("\r\n"), F.lit("\n")), 256)


def file_problems(files: DataFrame) -> DataFrame:
    """Files that break the numbering: ``version, problem``."""
    number = F.split_part("version", F.lit("_"), F.lit(1))
    numbered = files.select("version", number.alias("_number"))
    malformed = ~F.col("_number").rlike(r"\A[0-9]{4}\z")
    first = numbered.groupBy("_number").agg(F.min("version").alias("_first"))
    judged = numbered.join(first, "_number").withColumn(
        "problem",
        F.when(malformed, "must start with a 4-digit number").when(F.col("version") > F.col("_first"), "duplicate migration number"),
    )
    return judged.where(F.col("problem").isNotNull()).select("version", "problem")


def migration_status(files: DataFrame, applied: DataFrame) -> DataFrame:
    """``version, status`` over ``files(version, sql_text)`` and ``applied(version, checksum)``:
    ``applied``, ``pending``, ``edited`` or ``unknown`` (recorded, but no such file)."""
    known = files.select("version", checksum(F.col("sql_text")).alias("_now"))
    done = applied.select("version", F.col("checksum").alias("_then"))
    status = (
        F.when(F.col("_then").isNull(), "pending")
        .when(F.col("_now").isNull(), "unknown")
        .when(F.col("_now") != F.col("_then"), "edited")
        .otherwise("applied")
    )
    return known.join(done, "version", "full").select("version", status.alias("status"))


def pending(files: DataFrame, applied: DataFrame) -> DataFrame:
    return files.join(applied, "version", "left_anti").orderBy("version")


def is_current(files: DataFrame, applied: DataFrame) -> bool:
    """Start-up guard: nothing pending, edited or unknown."""
    return migration_status(files, applied).where(F.col("status") != "applied").isEmpty()
