"""How five document filters interact, over every order of applying them.

Failure conditions, one bit of a mask each: A under 50 words; B fewer than 65 distinct
words in 100; C more than 5 characters A-Z in 100; D a character of ``#$%&*|``; E the text
of a document with a smaller id.  A to D are functions of one row.  E is found so:

1. Every row becomes a narrow one: id, part, mask and the SHA-256 of the whole text, which
   stands for the text from there on (equal up to collisions of SHA-256).
2. Each task counts its hashes in a counting Bloom filter: ``PLACES`` counters a row in
   blocks of ``BLOCK`` counters, ``BITS`` of one block for a hash, saturated at two.  The
   filters are merged block by block, and of each block only the bitmap of the counters
   that reached two goes on.
3. A row with a counter below two has a text that occurs once: it can't fail E.  The rows
   are sorted by hash inside their files, and the bitmaps are broadcast slice by slice (at
   most ``SLICE`` bitmaps of 4 KiB, 64 MiB), so a slice reads its own rows only.
4. Only possible repeats are shuffled, as narrow rows, for the smallest id of each text.  A
   row passes E if its (text, id) is a smallest one; that join has no hot key, whatever
   the size of a group of copies.
5. Rows are added up by (part, mask, quality, toxic), at most 128 a part.  Sums over the
   masks give every number of every order and step: a filter removes what fails it and no
   earlier filter, and of the 120 orders 120 / (failed filters) begin with it among them.

Defined results: a null text is empty, a null part is the empty string.  An empty or very
long text is judged as a whole like any other.  A row without id passes E and makes no other
row fail it.  Rows that share an id are not smaller than each other; repeated rows count
one by one.  A document is good or toxic if any label row of its id says so; label rows
without id are ignored.  Each part has all its 600 rows; an empty table gives none.  Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from ..plans.stages import materialize, new_stage
from .ids import narrow

FILTERS = "ABCDE"
BITS, PLACES, BLOCK, SLICE = 3, 8, 32768, 16384
#: Hashes that a task counts before it gives up its counters.
HASHES = 1 << 20
#: Bits of a hash that choose the block; the head is the first 56.
HEAD, CHOICE = 56, 36

BLANKS = "\t\n\x0b\x0c\r"


def row_mask(text: Column) -> Column:
    """Bits 0 to 3: whether the text fails A, B, C and D."""
    def judged(words):
        return F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"))

    words = F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))

    def bits(w):
        fails = [w["n"] < 50, F.lit(100) * w["distinct"].cast("long") < F.lit(65) * w["n"].cast("long"),
                 F.lit(100) * capitals.cast("long") > F.lit(5) * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
        out = F.lit(0)
        for k, failed in enumerate(fails):
            out = out + F.when(failed, F.lit(1 << k)).otherwise(F.lit(0))
        return out

    return let(let(words, judged), bits)


def narrow_rows(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """(id, part, mask, sha, head) of every row, sorted by head inside the written files."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       row_mask(content).alias("mask"), F.unhex(F.sha2(content, 256)).alias("sha"))
    head = F.conv(F.hex(F.substring("sha", 1, HEAD // 8)), 16, 10).cast("long")
    return materialize(rows.withColumn("head", head).sortWithinPartitions("head"))


def block_of(head, blocks: int):
    """Block of a head; it grows with the head, so a range of blocks is a range of heads."""
    return (head >> (HEAD - CHOICE)) * blocks >> CHOICE


def _counted(blocks: int):
    """Hashes to the counters of a task: a row per block, with the places counted once and those counted more often."""
    def sketch(hashes: list[bytes]) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 32)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, 1:] = raw[:, :HEAD // 8]
        block = block_of(wide.view(">u8")[:, 0].astype(np.int64), blocks)
        place = np.ascontiguousarray(raw[:, 8:8 + 2 * BITS]).view(">u2").astype(np.int64) % BLOCK
        key, n = np.unique(block[:, None] * BLOCK + place, return_counts=True)
        used, begin = np.unique(key // BLOCK, return_index=True)
        short, end = (key % BLOCK).astype("<u2"), np.append(begin, len(key))[1:]
        runs = list(zip(begin.tolist(), end.tolist(), strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array([short[a:b][n[a:b] == 1].tobytes() for a, b in runs], pa.binary()),
             pa.array([short[a:b][n[a:b] > 1].tobytes() for a, b in runs], pa.binary())], names=["block", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            if len(held) >= HASHES:
                yield sketch(held)
                held = []
        if held:
            yield sketch(held)
    return run


def _merged(table: pa.Table) -> pa.Table:
    """The bitmap of a block's counters that reach two over all tasks."""
    counters = np.zeros(BLOCK, np.uint8)
    for column, n in (("once", 1), ("more", 2)):
        for places in table[column]:
            at = np.frombuffer(places.as_buffer(), "<u2")
            counters[at] = np.minimum(counters[at] + n, 2)
    return pa.table({"block": table["block"].slice(0, 1),
                     "bits": pa.array([np.packbits(counters == 2, bitorder="little").tobytes()], pa.binary())})


def repeated_places(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of the merged counting Bloom filter."""
    counted = rows.select("sha").mapInArrow(_counted(blocks), "block long, once binary, more binary")
    return materialize(counted.groupBy("block").applyInArrow(_merged, "block long, bits binary"))


def _reached(k: int) -> Column:
    """Whether the k-th counter of a row's hash reached two."""
    place = F.conv(F.hex(F.substring("sha", 9 + 2 * k, 2)), 16, 10).cast("int") % BLOCK
    byte = F.conv(F.hex(F.substring(F.col("bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place % 8) == 1


def tested(rows: DataFrame) -> DataFrame:
    """Adds ``possible``: false for rows whose text occurs once for certain."""
    spark = rows.sparkSession
    blocks = max(1, math.ceil(rows.count() * PLACES / BLOCK))
    bitmaps = repeated_places(rows, blocks)
    possible = F.col("bits").isNotNull()
    for k in range(BITS):
        possible = possible & _reached(k)
    own = F.expr(f"shiftright(shiftright(head, {HEAD - CHOICE}) * {blocks}L, {CHOICE})")
    path = new_stage(spark)
    for a in range(0, blocks, SLICE):
        b = min(a + SLICE, blocks)
        low, high = (-(-(x << CHOICE) // blocks) << (HEAD - CHOICE) for x in (a, b))
        mine = rows.filter((F.col("head") >= low) & (F.col("head") < high)).withColumn("own", own)
        few = F.broadcast(bitmaps.filter((F.col("block") >= a) & (F.col("block") < b)))
        joined = mine.join(few, F.col("own") == F.col("block"), "left")
        joined.select("id", "part", "mask", "sha", F.coalesce(possible, F.lit(False)).alias("possible")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def flags(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask, n): how many rows of an id and part fail which filters (bit 0 is A, bit 4 is E)."""
    rows = tested(narrow_rows(docs, doc_id, text, part))
    copies = materialize(rows.filter("possible").groupBy("sha", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    least = copies.filter("id IS NOT NULL").groupBy("sha").agg(F.min("id").alias("id")).withColumn("least", F.lit(True))
    fails = F.col("least").isNull() & F.col("id").isNotNull()
    judged = copies.join(least, ["sha", "id"], "left").select(
        "id", "part", (F.col("mask") + F.when(fails, F.lit(16)).otherwise(F.lit(0))).alias("mask"), "n")
    return rows.filter("NOT possible").select("id", "part", "mask", F.lit(1).cast("long").alias("n")).unionByName(judged)


def mask_counts(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic), at most 32 rows a part."""
    def says(column: str) -> Column:
        return F.coalesce(F.max((F.col(column) == 1).cast("int")), F.lit(0))

    marked = materialize(labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg(
        says("quality").alias("good"), says("toxic").alias("toxic")))
    known = rows.groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).join(narrow(marked), "id", "left")
    return known.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the earlier ones) of all orders."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(FILTERS[x] for x in order), k + 1, 1 << f, before))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, with the counts of documents."""
    counts = mask_counts(flags(docs, doc_id, text, part), labels, doc_id)
    # at most 32 masks
    per = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    step = F.explode(F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("before"))
                               for o, k, b, e in steps()))).alias("s")
    rows = per.select("part", "masks", step).select("part", "masks", "s.*")

    def total(field: str, counted) -> Column:
        def add(acc, m):
            value = counted(m["mask"])
            return acc + F.when(value > 0, m[field] * value).otherwise(F.lit(0).cast("long"))
        return F.aggregate("masks", F.lit(0).cast("long"), add)

    def one(condition: Column) -> Column:
        return F.when(condition, F.lit(1)).otherwise(F.lit(0))

    bit, before = F.col("bit"), F.col("before")

    def fails(m: Column) -> Column:
        return m.bitwiseAND(bit) != 0

    def here(m: Column) -> Column:
        return one(fails(m) & (m.bitwiseAND(before) == 0))

    orders = math.factorial(len(FILTERS))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: one(m.bitwiseAND(before.bitwiseOR(bit)) == 0)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: one(fails(m) & (m.bitwiseAND(before) != 0))).alias("redundant"),
        total("n", lambda m: one(m == bit)).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        total("n", lambda m: F.when(fails(m), (F.lit(orders) / F.bit_count(m)).cast("int")).otherwise(F.lit(0))).alias("shapley"))
