"""Product codes of vectors; the nearest codebook entry is found by slicing and intersecting bitmasks.

Every component x becomes the integer floor(256 x).  A vector is cut into ``PARTS`` equal
consecutive parts, and each part position has a codebook of at most ``ENTRIES`` entries.

For each dimension of a codebook its entries' coordinates are sorted, and place i of the
sorted list carries the mask of the i entries before it, one bit an entry.  A radius makes a
range of coordinates around a point, two binary searches turn the range into two places,
and the difference of their masks holds the entries inside.  The masks of all dimensions
ANDed are the entries in a cube around the point: the candidates, whose distances are
computed exactly.  If the nearest candidate is no farther than the radius, no entry outside
the cube can be nearer or as near.  Otherwise the point is searched again, with the distance
of its best candidate as radius, or with a doubled one if the cube was empty.

Codebooks start from the parts of the smallest ids and follow ``ROUNDS`` rounds of
assignment and averaging.  Each task adds up its own points; what moves are sums per (part,
entry).  The driver holds the codebooks only: ``ENTRIES`` vectors at any input size.

Defined results: rows whose vector is null, or holds null or non-finite components, are
dropped, and so are vectors of another length than the most frequent one (the shorter of
equally frequent ones), which can't be cut alike.  That length must be a multiple of the
number of parts; 0 is one, and gives entry 0 for every part.  Beyond ``BOUND`` an integer
counts as the bound, so that squares add up in 64 bits.  Null ids come last in the order of
ids, repeated ids are ordered by their vectors; repeated rows are coded one by one.  Fewer
rows than entries make smaller codebooks, an empty table gives no rows.  Null labels are
one label.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..plans.stages import materialize

PARTS, ENTRIES, ROUNDS, SCALE, BOUND = 16, 64, 2, 256, 1 << 24
#: Labels that may be broadcast; of more, only those with a ten-thousandth of all rows are.
BROADCAST_LABELS = 1 << 20
#: Points searched at once.
BLOCK = 1 << 14


class EntryIndex:
    """Sorted coordinates of up to 64 entries with prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = [entries[order[:, d], d] for d in range(entries.shape[1])]
        bits = np.uint64(1) << np.arange(len(entries), dtype=np.uint64)
        self.every = np.bitwise_or.reduce(bits)
        self.before = [np.concatenate([np.zeros(1, np.uint64), np.bitwise_or.accumulate(bits[order[:, d]])])
                       for d in range(entries.shape[1])]
        gaps = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        np.fill_diagonal(gaps, np.iinfo(np.int64).max)
        near = gaps.min(axis=1) if len(entries) > 1 else np.zeros(1, np.int64)
        #: Initial radius: how far an entry usually is from its nearest neighbour.
        self.radius = max(1, math.isqrt(int(np.median(near))) + 1)

    def candidates(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries in the cube of a radius around each point."""
        masks = np.full(len(points), self.every)
        for d, (coordinates, before) in enumerate(zip(self.sorted, self.before, strict=True)):
            low = np.searchsorted(coordinates, points[:, d] - radius, "left")
            high = np.searchsorted(coordinates, points[:, d] + radius, "right")
            masks &= before[high] ^ before[low]
        return masks

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point, ties to the lower one, and its squared distance."""
        best, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        todo, radius = np.arange(len(points)), np.full(len(points), self.radius, np.int64)
        while len(todo):
            masks = self.candidates(points[todo], radius)
            row, entry = np.nonzero(np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            far = np.full(len(todo), -1, np.int64)
            if len(row):
                d = ((points[todo[row]] - self.entries[entry]) ** 2).sum(axis=1)
                used, first = np.unique(row, return_index=True)
                least = np.minimum.reduceat(d, first)
                far[used] = least
                is_least = np.flatnonzero(d == np.repeat(least, np.diff(np.append(first, len(row)))))
                _, lowest = np.unique(row[is_least], return_index=True)
                best[todo[used]], distance[todo[used]] = entry[is_least[lowest]], least
            again = (far < 0) | (far > radius * radius)
            # a root of doubles may be short of the distance by rounding, one more never is
            wider = np.where(far < 0, 2 * radius, np.sqrt(np.maximum(far, 0).astype(np.float64)).astype(np.int64) + 1)
            todo, radius = todo[again], wider[again]
        return best, distance


def nearest_entries(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for any number of entries, 64 to a mask."""
    best, distance = None, None
    for a in range(0, len(entries), 64):
        e, d = EntryIndex(entries[a:a + 64]).nearest(points)
        if best is None:
            best, distance = e, d
        else:
            nearer = d < distance
            best, distance = np.where(nearer, e + a, best), np.where(nearer, d, distance)
    return best, distance


def _integers(scale: int):
    """(id, label, vector) to (id, label, size, components as packed integers) of complete vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            offsets = vectors.offsets.to_numpy()
            values = vectors.values
            x = pc.fill_null(values.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            whole = np.clip(np.floor(np.where(np.isfinite(x), x, 0) * scale), -BOUND, BOUND).astype("<i4")
            kept = (bad[offsets[1:]] == bad[offsets[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(kept)
            a, b = offsets[:-1][rows], offsets[1:][rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(b - a, pa.int32()),
                 pa.array([whole[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())],
                names=["id", "label", "size", "vector"])
    return run


def _blocks(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, components) of runs of rows."""
    for a in range(0, len(column), BLOCK):
        part = column.slice(a, BLOCK)
        yield a, np.frombuffer(b"".join(part.to_pylist()), "<i4").astype(np.int64).reshape(len(part), size)


def _part(points: np.ndarray, k: int, parts: int) -> np.ndarray:
    width = points.shape[1] // parts
    return points[:, k * width:(k + 1) * width]


def _sums(books: list[np.ndarray], size: int):
    """Per task: how many points each entry got, and their sums."""
    parts, width = len(books), size // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for _, points in _blocks(batch.column(0), size):
                for k, book in enumerate(books):
                    own = _part(points, k, parts)
                    entry, _ = nearest_entries(own, book)
                    counts[k] += np.bincount(entry, minlength=len(book))
                    np.add.at(sums[k], entry, own)
        for k in range(parts):
            used = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[k][used]),
                 *(pa.array(np.ascontiguousarray(sums[k][used, d])) for d in range(width))],
                names=["part", "entry", "n", *(f"s{d}" for d in range(width))])
    return run


def _codes(books: list[np.ndarray], size: int):
    """(id, label, vector) to (id, label, code, error)."""
    digits = np.array([f"{k:02x}" for k in range(max(len(b) for b in books))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for _, points in _blocks(batch.column(2), size):
                code, error = np.full(len(points), ""), np.zeros(len(points), np.int64)
                for k, book in enumerate(books):
                    entry, far = nearest_entries(_part(points, k, len(books)), book)
                    code, error = np.char.add(code, digits[entry]), error + far
                codes.append(code)
                errors.append(error)
            if codes:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.concatenate(codes).tolist(), pa.string()), pa.array(np.concatenate(errors))],
                    names=["id", "label", "code", "error"])
    return run


def codebooks(vectors: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part after ``rounds`` rounds, from rows of (id, vector)."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    start = np.array([np.frombuffer(r["vector"], "<i4") for r in first], np.int64).reshape(len(first), size)
    books, width = [_part(start, k, parts).copy() for k in range(parts)], size // parts
    schema = ", ".join(["part int", "entry int", "n long", *(f"s{d} long" for d in range(width))])
    for _ in range(rounds):
        # integer sums of any number of tasks stay exact as decimals
        total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *(f"s{d}" for d in range(width)))]
        for r in vectors.select("vector").mapInArrow(_sums(books, size), schema).groupBy("part", "entry").agg(*total).collect():
            books[r["part"]][r["entry"]] = [int(r[f"s{d}"]) // int(r["n"]) for d in range(width)]
    return books


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def _with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the summed error of a row's label; labels with many rows are never shuffled."""
    limit = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    totals = materialize(coded.groupBy(F.col("label").alias("of")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), limit).cast("long").alias("label_error"), F.count(F.lit(1)).alias("rows")))
    number, rows = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    same = F.col("label").eqNullSafe(F.col("of"))
    if number <= BROADCAST_LABELS:
        return coded.join(F.broadcast(totals), same)
    hot = F.broadcast(totals.filter(F.col("rows") * 10_000 >= rows))
    rest = coded.join(F.broadcast(hot.select("of")), same, "left_anti")
    return coded.join(hot, same).unionByName(rest.join(totals, same))


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) of the kept rows, and the codebooks."""
    source = rows.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).filter("vector IS NOT NULL")
    kinds = source.schema
    prefix = f"id {kinds['id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, "
    vectors = materialize(source.mapInArrow(_integers(scale), prefix + "size int, vector binary"))
    sizes = vectors.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    vectors = vectors.filter(F.col("size") == size).drop("size")
    books = codebooks(vectors, size, parts, entries, rounds)
    if sizes:
        coded = vectors.mapInArrow(_codes(books, size), prefix + "code string, error long")
    else:
        coded = vectors.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    out = _with_label_error(materialize(coded)).select(F.col("id").alias(vec_id), F.col("label").alias(label), "code", "error", "label_error")
    return out, books
