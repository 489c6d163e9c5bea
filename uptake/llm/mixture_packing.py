"""Packing with a controlled mixture of sources in every window.

1. ``queued`` turns each text into token ids and an end id.  A task numbers the ids of each
   source as it goes, so a document knows its place in its task's part of the source's
   queue; sums per (source, task) turn that into a place in the whole queue.
2. ``Schedule`` says how far every queue has got when a number of ids is packed.  The
   queues are served at their target rates; when one is empty the others share its rate.
   Partitions end every ``WINDOWS`` windows, where every queue has sent its exact rate,
   rounded down.  What rounding takes away is the deficit that the next partition starts with,
   and the next partition completes the window that is still open.
3. The ids are cut where partitions end and grouped by partition.  ``served`` deals the queues
   there by deficit round-robin: for each window every queue's deficit grows by its target
   share, a queue sends as many whole ids as its deficit holds, ids still missing come from
   the queues with the largest deficits, and what is left of a deficit is carried into the
   next window.
4. The last ids, fewer than a window, fill windows whose lengths are powers of two, which
   take no padding.  No sequence is padded at all.

Target shares are those of the given ``targets`` (any positive weights per source), or by
default each source's share of all ids, so that the queues end together and every window
has the mixture of the corpus.  Sources that have less than ``LEAST`` ids per window, or no
target, share one queue: so there are at most ``capacity / LEAST`` others, and totals and
schedules are bounded.  A partition holds ``WINDOWS * capacity`` ids, give or take one per
queue, at any input size and with any source; nothing else moves.

Defined results: a null or empty text has the end id alone.  A very long text is cut at the
ends of partitions like any other.  Null sources are one source, apart from the empty one.
Repeated rows and ids are packed one by one; null ids stay null.  An empty table gives no
rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.stages import materialize
from .ids import narrow
from .tokens import encoder

CAPACITY, WINDOWS, END, LEAST = 4096, 512, 2, 8
QUEUED = "source string, task int, at long, doc_id long, tokens long, ids binary"
CUT = "partition long, queue int, place long, doc_id long, doc_tokens long, start long, length long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int"


def queued(docs: DataFrame, doc_id: str, text: str, source: str, vocabulary: str | None, end: int) -> DataFrame:
    """Token ids of all documents with their place in the task's part of their source's queue."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = encoder(vocabulary), TaskContext.get().partitionId()
        length: dict[str | None, int] = {}
        for batch in batches:
            out = [[], [], [], [], [], []]
            for doc, own, name in zip(batch.column(0).to_pylist(), words.rows(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                ids = np.append(own, np.uint32(end)).astype("<u4")
                at, n = length.get(name, 0), len(ids)
                # two bytes an id if that is enough
                ids = (ids.astype("<u2") if ids.max() < 1 << 16 else ids).tobytes()
                length[name] = at + n
                for column, v in zip(out, (name, task, at, doc, n, ids), strict=True):
                    column.append(v)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
                                             names=["source", "task", "at", "doc_id", "tokens", "ids"])
        words.forget()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.col(source).cast("string").alias("source"))
    return rows.mapInArrow(run, QUEUED)


class Schedule:
    """How many ids of each queue are packed when a number of ids is."""

    def __init__(self, totals: list[int], weights: list[Fraction], capacity: int, windows: int):
        self.totals, self.capacity, self.step = totals, capacity, capacity * windows
        self.all = sum(totals)
        self.partitions = -(-self.all // self.step)
        #: (ids packed, exact ids of each queue by then, rate of each queue from there on)
        self.phases: list[tuple[Fraction, list[Fraction], list[Fraction]]] = []
        done, sent = Fraction(0), [Fraction(0)] * len(totals)
        while any(s < t for s, t in zip(sent, totals, strict=True)):
            live = [w if s < t else Fraction(0) for w, s, t in zip(weights, sent, totals, strict=True)]
            rates = [w / sum(live) for w in live]
            self.phases.append((done, sent, rates))
            more = min((t - s) / r for t, s, r in zip(totals, sent, rates, strict=True) if r)
            sent, done = [s + r * more for s, r in zip(sent, rates, strict=True)], done + more

    def phase(self, ids: int) -> tuple[Fraction, list[Fraction], list[Fraction]]:
        return next(p for p in reversed(self.phases) if p[0] <= ids)

    def exact(self, queue: int, ids: int) -> Fraction:
        done, sent, rates = self.phase(ids)
        return sent[queue] + rates[queue] * (ids - done)

    def end(self, queue: int, partition: int) -> int:
        """Ids of a queue that are packed when so many partitions are full."""
        return self.totals[queue] if partition >= self.partitions else int(self.exact(queue, partition * self.step))

    def partition_of(self, queue: int, place: int) -> int:
        """The partition that packs an id of a queue."""
        low, high = 0, self.partitions - 1
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.end(queue, middle + 1) > place else (middle + 1, high)
        return low

    def windows(self, begin: int, end: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, ids) of the windows, or parts of them, that the ids from ``begin`` to ``end`` fill.

        Behind the last full window, windows are as long as the powers of two in the rest.
        """
        full = self.all // self.capacity
        out, number, at = [], begin // self.capacity, begin // self.capacity * self.capacity
        rest = [1 << b for b in reversed(range(self.capacity.bit_length())) if (self.all % self.capacity) >> b & 1]
        while at < end:
            size = self.capacity if number < full else rest[number - full]
            a, b = max(at, begin), min(at + size, end)
            if a < b:
                out.append((number, a - at, b - a))
            number, at = number + 1, at + size
        return out


def served(sizes: list[int], left: np.ndarray, deficits: np.ndarray, rates: np.ndarray) -> Iterator[np.ndarray]:
    """Ids that each queue sends to each window, by deficit round-robin.

    ``left`` are the ids a queue still has and add up to the windows' sizes.
    """
    left, deficits = left.copy(), deficits.copy()
    for size in sizes:
        live = np.where(left > 0, rates, 0.0)
        deficits += size * live / live.sum() if live.sum() else 0.0
        sent, room = np.zeros(len(left), np.int64), size
        # whole ids of each deficit, queue by queue, as long as there is room
        due = np.minimum(np.maximum(np.floor(deficits + 1e-9), 0).astype(np.int64), left)
        before = np.cumsum(due) - due
        sent = np.clip(room - before, 0, due)
        room -= int(sent.sum())
        while room:
            # then one id each of those with the largest rest
            able = np.flatnonzero(left > sent)
            able = able[np.argsort(sent[able] - deficits[able], kind="stable")][:room]
            more = np.minimum(left[able] - sent[able], max(1, room // len(able)))
            sent[able] += more
            room -= int(more.sum())
        left -= sent
        deficits = np.where(left > 0, deficits - sent, 0.0)
        yield sent


def _cut_rows(schedule: Schedule, queues: dict[str | None, int], rest: int):
    """Documents with their place in the queue, to a row per partition that packs some of their ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (partition, its first and last place) that a queue was in; rows of a task follow each other in a queue, mostly
        inside: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            out = [[], [], [], [], [], [], [], []]
            for name, place, doc, n, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                queue, data, start = queues.get(name, rest), ids.as_buffer(), 0
                width = len(data) // n
                while start < n:
                    partition, low, high = inside.get(queue, (0, 0, 0))
                    if not low <= place + start < high:
                        partition = schedule.partition_of(queue, place + start)
                        low, high = schedule.end(queue, partition), schedule.end(queue, partition + 1)
                        inside[queue] = (partition, low, high)
                    length = min(n - start, high - place - start)
                    row = (partition, queue, place + start, doc, n, start, length, data.slice(width * start, width * length).to_pybytes())
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                    start += length
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
                                             names=["partition", "queue", "place", "doc_id", "doc_tokens", "start", "length", "ids"])
    return run


def _filled(schedule: Schedule):
    def run(table: pa.Table) -> pa.Table:
        partition, queues = table["partition"][0].as_py(), range(len(schedule.totals))
        table = table.sort_by([("queue", "ascending"), ("place", "ascending")])
        queue = table["queue"].to_numpy()
        doc, tokens, start, size = (table[c].to_pylist() for c in ("doc_id", "doc_tokens", "start", "length"))
        data = [v.as_buffer() for v in table["ids"]]
        first, last = ([schedule.end(q, partition + k) for q in queues] for k in (0, 1))
        begin = partition * schedule.step
        _, _, rates = schedule.phase(begin)
        deficits = np.array([float(schedule.exact(q, begin) - first[q]) for q in queues])
        left = np.array(last, np.int64) - np.array(first, np.int64)
        windows = schedule.windows(sum(first), sum(last))
        at = np.searchsorted(queue, np.arange(len(left))).tolist()  # next row of each queue
        used = [0] * len(left)                                      # ids of it that are packed
        out = [[], [], [], [], [], [], [], []]
        shares = served([n for _, _, n in windows], left, deficits, np.array([float(r) for r in rates]))
        for (number, offset, _), sent in zip(windows, shares, strict=True):
            for q in np.flatnonzero(sent).tolist():
                missing = int(sent[q])
                while missing:
                    r, u = at[q], used[q]
                    n, width = min(missing, size[r] - u), len(data[r]) // size[r]
                    ids = np.frombuffer(data[r], "<u2" if width == 2 else "<u4", n, width * u).astype("<u4")
                    row = (doc[r], start[r] + u, n, zlib.crc32(ids.tobytes()), tokens[r], number, offset, q)
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                    offset, missing = offset + n, missing - n
                    at[q], used[q] = (r + 1, 0) if u + n == size[r] else (r, u + n)
        kinds = [pa.int64()] * 7 + [pa.int32()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(names, out, kinds, strict=True)})
    return run


def pack(docs: DataFrame, targets: dict[str | None, float] | None = None, capacity: int = CAPACITY, windows: int = WINDOWS,
         end: int = END, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    ``queue`` numbers the sources in order of their names; the last one may be the shared queue.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    rows = materialize(queued(docs, doc_id, text, source, vocabulary, end))
    parts = materialize(rows.groupBy("source", "task").agg(F.sum("tokens").alias("tokens")))
    per_source = parts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = per_source.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    # at most ``capacity / LEAST`` sources
    large = sorted(((r["source"], r["tokens"]) for r in per_source.filter(F.col("tokens") * capacity >= LEAST * total).collect()),
                   key=lambda r: (r[0] is not None, r[0] or ""))
    if targets is not None:
        large = [(s, n) for s, n in large if targets.get(s, 0) > 0]
    queues = {s: k for k, (s, _) in enumerate(large)}
    totals = [n for _, n in large]
    weights = [Fraction(n if targets is None else targets[s]) for s, n in large]
    if sum(totals) < total:
        totals.append(total - sum(totals))
        # the shared queue ends with the others
        weights.append(Fraction(totals[-1]) if targets is None else sum(weights, Fraction(0)) * totals[-1] / max(1, sum(totals[:-1])) or Fraction(1))
    schedule = Schedule(totals, weights, capacity, windows)
    names = F.create_map(*(F.lit(x) for s, k in queues.items() if s is not None for x in (s, k))) if any(s is not None for s in queues) else None
    known = F.try_element_at(names, F.col("source")) if names is not None else F.lit(None).cast("int")
    queue = F.coalesce(F.when(F.col("source").isNull(), F.lit(queues.get(None))).otherwise(known), F.lit(len(large)))
    before = Window.partitionBy("queue").orderBy("source", "task").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(parts.withColumn("queue", queue).withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select(
        F.col("source").alias("of"), F.col("task").alias("by"), "base"))
    placed = rows.join(narrow(bases), F.col("source").eqNullSafe(F.col("of")) & (F.col("task") == F.col("by"))).select(
        "source", (F.col("base") + F.col("at")).alias("place"), "doc_id", "tokens", "ids")
    cut = placed.mapInArrow(_cut_rows(schedule, queues, len(large)), CUT)
    return cut.groupBy("partition").applyInArrow(_filled(schedule), PACKED)
