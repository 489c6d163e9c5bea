"""Best-fit packing with bounds that certify each partition's number of bins.

1. ``pieces`` turns each text into token ids and an end id, cut into pieces of at most
   ``capacity`` ids.  From there on only lengths move.
2. The pieces are dealt at random to partitions of about ``ITEMS`` and each partition is
   packed by best-fit decreasing.
3. Dual feasible functions bound the number of bins from below.  A partition's gap is its
   number of bins minus its largest bound, not rounded, so that the fractions of bins that
   partitions waste count too.  A partition without gap is certified.
4. Partitions with a gap give up the pieces of their bins that are not full.  These are
   dealt anew, to fewer partitions, and packed again, until the number of all bins meets
   the bound over all pieces or one partition holds what is left.

The bound over all pieces needs only how many pieces have each length, at most
``capacity`` rows.  Null or empty texts have the end id alone.  An empty table gives no
rows; repeated rows are packed one by one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.stages import materialize
from .tokens import encoder

CAPACITY, ITEMS, END = 4096, 16384, 1
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECE + ", sequence_id long, offset long, open boolean"


def pieces(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
           vocabulary: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stop, step = encoder(vocabulary), int(end).to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            out = [[], [], [], [], []]
            for doc, own in zip(batch.column(0).to_pylist(), words.rows(batch.column(1)), strict=True):
                ids = own.astype("<u4").tobytes() + stop
                for k in range(0, len(ids), step):
                    part = ids[k:k + step]
                    for column, v in zip(out, (doc, k // step, k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
        words.forget()
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECE)


def lower_bound(counts: np.ndarray, capacity: int) -> float:
    """The largest bound that dual feasible functions give; counts[x]: pieces of length x.

    Two families: f(x) = capacity, x or 0 for x above capacity - t, between, or below t;
    and u(x) = x if (k + 1) x is a multiple of the capacity, else floor((k + 1) x / capacity) / k
    of it.  Their sums over any bin are at most the capacity.
    """
    x = np.arange(capacity + 1)
    best = float((counts * x).sum()) / capacity
    number, area = np.cumsum(counts), np.cumsum(counts * x)
    t = np.arange(1, capacity // 2 + 1)
    rounded = (number[-1] - number[capacity - t]) + (area[capacity - t] - area[t - 1]) / capacity
    best = max(best, float(rounded.max(initial=0)))
    for k in range(1, 65):
        whole, rest = np.divmod((k + 1) * x, capacity)
        best = max(best, float((counts * np.where(rest == 0, x / capacity, whole / k)).sum()))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and what each bin has left; longest pieces first."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left: list[int] = []
    by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0  # bit r: a bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = used >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_left[room].pop()
            if not by_left[room]:
                used ^= 1 << room
        else:
            b, room = len(left), capacity
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room - size
        if left[b]:
            by_left[left[b]].append(b)
            used |= 1 << left[b]
    return bins, offsets, np.array(left, np.int64)


def _packed(capacity: int, turn: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        bins, offsets, left = best_fit(lengths, capacity)
        gap = len(left) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return rows.drop(columns="part").assign(sequence_id=(turn << 56) + (int(key[0]) << 28) + bins, offset=offsets,
                                                open=(left[bins] > 0) & (gap > 1e-9))
    return run


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` rows."""
    counts = np.zeros(capacity + 1)
    for r in rows.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    goal, todo, parts = math.ceil(lower_bound(counts, capacity) - 1e-9), int(counts.sum()), None
    closed, bins, turn = [], 0, 0
    current = rows.select("doc_id", "piece", "start", "length", "ids_crc32")
    while True:
        wanted = max(1, math.ceil(todo / ITEMS))
        parts = wanted if parts is None else max(1, min(wanted, parts // 2))
        dealt = current.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(parts)))
        done = materialize(dealt.groupBy("part").applyInPandas(_packed(capacity, turn), PACKED))
        shut = done.filter("NOT open")
        bins += shut.filter("offset = 0").count()
        waiting = done.filter("open")
        todo, loose = waiting.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("offset") == 0).cast("long")), F.lit(0))).first()
        if not todo or parts == 1 or bins + loose <= goal:
            closed.append(done.drop("open"))
            break
        closed.append(shut.drop("open"))
        current, turn = waiting.drop("sequence_id", "offset", "open"), turn + 1
    out = closed[0]
    for d in closed[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **settings) -> DataFrame:
    """Pieces of all documents with their place in a sequence of at most ``capacity`` ids."""
    return pack(materialize(pieces(docs, capacity, **settings)), capacity)
