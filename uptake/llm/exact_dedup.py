"""Exact deduplication: two-pass Bloom filtering, then grouping of what it lets through.

Pass one sets, for every row, ``BITS`` bits of a Bloom filter at places given by the
hash of its normalised text, and keeps the bits that were set more than once.  All
bits of a hash that occurs twice are among them, so a row with one bit outside is
unique for certain.  Pass two tests every row against the kept bits: rows that fail
pass straight through, the others are possibly repeated and only they are shuffled,
to be grouped by the SHA-256 of the normalised text.

The filter has ``DENSITY`` bits a row and is a table of 4 KiB bitmaps.  All bits of
a hash lie in one bitmap.  The bitmaps are dealt to slices of ``SLICE`` of them, the
rows are written by slice, and the slices are tested one after the other, so that
what is broadcast never exceeds ``SLICE * 4096`` bytes (64 MiB) at any input size.

Normalised text: every blank, tab, line feed, vertical tab, form feed and carriage
return deleted; null counts as empty.  Of equal texts the row with the most code
points stays, then the smallest doc_id (null last), then the row written first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.stages import materialize, new_stage

BITS, DENSITY, PLACES, SLICE = 4, 16, 32768, 16384
DELETED = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for c in DELETED:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def bit(k: int) -> Column:
    """Place 0..32767 of the k-th bit of a row's hash in its bitmap, from 15 bits of the SHA-256."""
    return F.conv(F.substring("_sha", 17 + 4 * k, 4), 16, 10).cast("int").bitwiseAND(F.lit(PLACES - 1))


def with_hash(docs: DataFrame, text: str, bitmaps: int) -> DataFrame:
    """Adds the columns _row, _sha, _points, _bitmap, _slice."""
    norm = normalised(F.col(text))
    first = F.conv(F.substring("_sha", 1, 14), 16, 10).cast("bigint")
    return (docs.withColumns({"_row": F.monotonically_increasing_id(), "_sha": F.sha2(norm, 256),
                              "_points": F.length(F.coalesce(F.col(text), F.lit("")))})
            .withColumn("_bitmap", F.pmod(first, F.lit(bitmaps)))
            .withColumn("_slice", F.floor(F.col("_bitmap") / SLICE).cast("int")))


def repeated_bits(rows: DataFrame) -> DataFrame:
    """(bitmap, bits): the bits that at least two rows have set."""
    return (rows.select("_bitmap", F.explode(F.array(*(bit(k) for k in range(BITS)))).alias("place"))
            .groupBy("_bitmap", "place").count().filter("count > 1")
            .groupBy(F.col("_bitmap").alias("bitmap"))
            .agg(F.expr("bitmap_construct_agg(CAST(place AS BIGINT))").alias("bits")))


def is_set(k: int) -> Column:
    place = bit(k)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place % 8) == 1


def tested(rows: DataFrame) -> DataFrame:
    """Adds _possible: whether the row's text may occur again.  The broadcast side is at most ``SLICE`` bitmaps."""
    possible = F.col("bits").isNotNull()
    for k in range(BITS):
        possible = possible & is_set(k)
    joined = rows.join(F.broadcast(repeated_bits(rows)), F.col("_bitmap") == F.col("bitmap"), "left")
    return joined.withColumn("_possible", F.coalesce(possible, F.lit(False))).drop("bitmap", "bits")


def possibly_repeated(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """All rows with ``columns``, their hash columns and _possible, as a written table."""
    spark = docs.sparkSession
    bitmaps = max(1, math.ceil(docs.count() * DENSITY / PLACES))
    slices = math.ceil(bitmaps / SLICE)
    rows = materialize(with_hash(docs, text, bitmaps).select(*columns, "_row", "_sha", "_points", "_bitmap", "_slice"), "_slice")
    if slices == 1:
        return tested(rows)
    path = new_stage(spark)
    for s in range(slices):
        tested(rows.filter(F.col("_slice") == s)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _groups(candidates: DataFrame, doc_id: str) -> DataFrame:
    """One row per distinct text of the candidates: the row that stays and the number of rows.

    Copies meet as partial sums, so a text that a third of all rows share costs one row a task.
    """
    best = F.struct(F.col("_points"), F.col(doc_id).isNotNull().alias("known"), (-F.col(doc_id)).alias("id"),
                    (-F.col("_row")).alias("row"))
    return (candidates.groupBy(F.col("_sha").alias("sha")).agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("size"))
            .select("sha", (-F.col("best.id")).alias("keep_id"), (-F.col("best.row")).alias("keep_row"), "size"))


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    An empty or null text equals every other text without visible characters.
    An empty table gives no rows; other columns of ``docs`` are not read.
    """
    rows = possibly_repeated(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"])
    candidates = rows.filter("_possible")
    grouped = candidates.join(_groups(candidates, "doc_id"), F.col("_sha") == F.col("sha"))
    return (rows.filter("NOT _possible")
            .select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                    F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
            .unionByName(grouped.select("doc_id", "keep_id", F.col("size").alias("group_size"),
                                        (F.col("_row") == F.col("keep_row")).alias("kept"), F.col("_sha").alias("text_sha256"))))


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows the filter clears are written through; of the others only hash, id and length
    are grouped, and one row per text is fetched by its row number.
    """
    packed = docs.select(F.struct("*").alias("_doc"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = possibly_repeated(packed, ["_doc", "_id"], "_text")
    candidates = rows.filter("_possible")
    keep = _groups(candidates.select("_sha", "_id", "_points", "_row"), "_id").select(F.col("keep_row").alias("_row"))
    staying = rows.filter("NOT _possible").select("_doc").union(candidates.join(keep, "_row", "left_semi").select("_doc"))
    return staying.select("_doc.*")
