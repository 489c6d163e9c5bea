"""MinHash near-deduplication: universal hash minima, banding, verification, components.

1. One pass over the texts gives every document its set of ``width``-word shingles (as
   64-bit hashes), the size and a fingerprint of the set, ``bands * rows`` minima of
   universal hash functions ``(a * x + b mod 2^64) >> 32``, a hash of each band of minima,
   and 8 bits of each minimum as signature.
2. Documents with equal sets form a class; its smallest doc_id stands for it from here
   on, so a group of copies costs one member.
3. Members that share a band are candidates.  Bands are made for the threshold (``shape``):
   a pair right at it shares none of them with a probability of less than ``MISS`` (0.85: 24
   bands of 5 rows, 8e-7; 0.80: 27 of 4, 7e-7), and fails the signature test (estimate
   ``MARGIN`` below it, five to six deviations) with less than 1e-7.
4. A pair is linked if, on the full sets, ``100 * |A and B| >= threshold * |A or B|``.
   Only links between different components can change the result.  So first every member is
   tried with the one that resembles it most among the smallest members of its bands.  Then
   follow all pairs of different components in bands of at most ``SMALL`` members.  In larger
   bands, members are left out that hold so many shingles which no other component has that
   they can't reach the threshold; the others meet in blocks of ``BLOCK``, where that bound
   and the signatures say who has a pair to try.  Those go on with their sets and are tried
   block by block inside a task, where pairs of members that a link has joined fall out.  So
   rows are members of blocks, never pairs: their number does not grow with the square of a
   group of near misses, only the comparisons inside a task do.  No band is cut and no
   candidate dropped, and a pair is tried in the first band that both share only.
5. Components by alternating large-star and small-star.

Words: runs of characters other than blanks and ``\\x09-\\x0D``, A-Z lower-cased.  A text of
fewer words than ``width`` has its whole sequence as one shingle; without words (or null)
its set is empty and it is linked with nothing.  Rows without doc_id are linked with
nothing and have a null component.  Rows that share a doc_id are one vertex.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.stages import materialize
from . import textbytes as tb
from .components import components
from .ids import narrow, without

#: Minima of a document at most, and how likely a pair at the threshold may share no band.
MINIMA, MISS = 128, 1e-6
#: Up to SMALL members all pairs of a band are looked at; larger ones are cut into blocks.  PART: members that one call gets.
SMALL, BLOCK, PART = 24, 512, 20_000
#: Bytes of sets that one call gets, give or take a block.
PART_BYTES = 1 << 24
#: How far below the threshold signatures may agree.
MARGIN = 0.2
SHARD = 1 << 20

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 1 << 63, MINIMA, dtype=tb.U) * tb.U(2) + tb.U(1)
_B = _rng.integers(0, 1 << 63, MINIMA, dtype=tb.U)
_Q = _rng.integers(0, 1 << 63, 64, dtype=tb.U) * tb.U(2) + tb.U(1)


def shape(threshold: int) -> tuple[int, int]:
    """Number of bands and rows of a band: the longest bands that miss a pair at the threshold with less than ``MISS``."""
    for rows in range(MINIMA, 0, -1):
        none = math.log1p(-min(threshold / 100, 1 - 1e-9) ** rows)
        bands = math.ceil(math.log(MISS) / none) if none else MINIMA + 1
        if bands * rows <= MINIMA:
            return bands, rows
    raise ValueError(f"a threshold of {threshold} needs more than {MINIMA} minima")


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a block."""
    starts, ends, before = tb.words(data, offsets, tb.NON_BLANK)
    words = tb.word_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        n = max(len(words) - width + 1, 0)
        full = np.zeros(n, tb.U)
        for i in range(width):
            full += words[i:i + n] * _Q[i]
        full = tb.mix(full)
        out = []
        for a, b in zip(before[:-1], before[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(full[a:b - width + 1]))
            elif b > a:
                out.append(tb.mix((words[a:b] * _Q[:b - a]).sum(keepdims=True, dtype=tb.U) + tb.U(b - a)))
            else:
                out.append(np.empty(0, tb.U))
    return out


def minima(s: np.ndarray, count: int = MINIMA) -> np.ndarray:
    least = np.full(count, np.iinfo(tb.U).max, tb.U)
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 2048):
            np.minimum(least, (_A[:count, None] * s[k:k + 2048] + _B[:count, None]).min(axis=1), out=least)
    return least >> tb.U(32)


def _signatures(width: int, threshold: int):
    n_bands, n_rows = shape(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, bands, bits = [], [], [], []
            for _, _, data, offsets in tb.blocks(batch.column(1)):
                for s in shingles(data, offsets, width):
                    n.append(len(s))
                    with np.errstate(over="ignore"):
                        low = int(s.sum(dtype=tb.U))
                        high = int(np.bitwise_xor.reduce(tb.mix(s * tb.U(3)))) if len(s) else 0
                        prints.append(low.to_bytes(8, "little") + high.to_bytes(8, "little"))
                        if len(s):
                            m = minima(s, n_bands * n_rows)
                            rows = m.reshape(n_bands, n_rows)
                            key = np.arange(n_bands, dtype=tb.U)
                            for r in range(n_rows):
                                key = tb.mix(key * tb.U(0x9E3779B97F4A7C15) + rows[:, r])
                            bands.append(key.view(np.int64))
                            bits.append((m & tb.U(255)).astype(np.uint8).tobytes())
                        else:
                            bands.append(np.empty(0, np.int64))
                            bits.append(b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=["doc_id", "n", "print", "bands", "bits"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tb.blocks(batch.column(1)):
                sets = [s.tobytes() for s in shingles(data, offsets, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], pa.array(sets, pa.binary())], names=["id", "set"])
    return run


def _resemble(floor: float):
    """Keeps pairs whose signatures agree in at least ``floor`` of the places; adds the share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("bits_a", "bits_b"))
            share = (left == right).mean(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share)],
                                             names=["a", "b", "share"]).filter(pa.array(share >= floor))
    return run


def _linked(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), tb.U) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


def _dealt(shards: int):
    """Shingles of (id, root, set) rows as one packed row per shard of the hash space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, roots, sets = (batch.column(c) for c in ("id", "root", "set"))
            for row in range(0, batch.num_rows, 500):
                parts = [np.frombuffer(v.as_buffer(), tb.U) for v in sets[row:row + 500]]
                size = [len(p) for p in parts]
                values = np.concatenate(parts) if parts else np.empty(0, tb.U)
                own = [np.repeat(np.array(c[row:row + 500], np.int64), size) for c in (ids, roots)]
                at = (values % tb.U(shards)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                cut = np.searchsorted(at[order], np.arange(shards + 1))
                used = np.flatnonzero(np.diff(cut))
                pick = lambda v: pa.array([v[order[cut[k]:cut[k + 1]]].tobytes() for k in used], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pick(values), pick(own[0]), pick(own[1])],
                                                 names=["shard", "value", "id", "root"])
    return run


def _private(rows: pd.DataFrame) -> pd.DataFrame:
    """Per member, how many of a shard's shingles occur in no other component."""
    value, member, root = (np.frombuffer(b"".join(rows[c]), t) for c, t in (("value", tb.U), ("id", np.int64), ("root", np.int64)))
    order = np.argsort(value, kind="stable")
    value, member, root = value[order], member[order], root[order]
    opens = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    alone = np.minimum.reduceat(root, opens) == np.maximum.reduceat(root, opens)
    found = member[np.repeat(alone, np.diff(np.concatenate([opens, [len(value)]])))]
    ids, n = np.unique(found, return_counts=True)
    return pd.DataFrame({"id": ids, "own": n})


def _most_alike(pairs: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Per b of ``pairs`` (a, b) the pair whose signatures agree most, if they agree enough for a link."""
    side = lambda c: members.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    fit = 100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    like = (pairs.join(side("a"), "a").join(side("b"), "b").filter(fit).select("a", "b", "bits_a", "bits_b")
            .mapInArrow(_resemble(threshold / 100 - MARGIN), "a long, b long, share double"))
    return like.groupBy("b").agg(F.max_by("a", F.struct("share", "a")).alias("a")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    full = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}"))
    return pairs.join(full("b"), "b").join(full("a"), "a").mapInArrow(_linked(threshold), "a long, b long")


def _owned(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, own): how many shingles of the members of ``crowd`` (id, root) no other component has."""
    rows = crowd.join(sets, "id").select("id", "root", "set")
    total = rows.agg(F.sum(F.octet_length("set") / 8)).first()[0] or 0
    shards = int(total // SHARD) + 1
    return (rows.mapInArrow(_dealt(shards), "shard long, value binary, id binary, root binary")
            .groupBy("shard").applyInPandas(_private, "id long, own long").groupBy("id").agg(F.sum("own").alias("own")))


def _blocks(rows: pd.DataFrame, threshold: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Per two blocks of a band (member, those it could still have a link to) as places in ``rows``, sorted by key, low, high.

    A pair is given by the first band that both share only.  Members of a large band hold
    ``own`` shingles that no other component has, so their sets meet in at most ``n - own``.
    """
    bits = np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), -1)
    bands = np.stack(rows["bands"].to_list())
    key, lows, highs, ids, root, n, own, block = (rows[c].to_numpy() for c in ("key", "low", "high", "id", "root", "n", "own", "block"))
    place = (bands == key[:, None]).argmax(axis=1)
    opens = np.ones(len(rows), bool)
    opens[1:] = (key[1:] != key[:-1]) | (lows[1:] != lows[:-1]) | (highs[1:] != highs[:-1])
    begin = np.flatnonzero(opens)
    for a, b in zip(begin.tolist(), np.append(begin, len(rows))[1:].tolist(), strict=True):
        left, right = (a + np.flatnonzero(block[a:b] == side[a]) for side in (lows, highs))
        found = []
        for k in range(0, len(left), 64):
            i, j = left[k:k + 64, None], right[None, :]
            most = np.minimum(n[i] - own[i], n[j] - own[j])
            ok = (root[i] != root[j]) & (100 * most >= threshold * (n[i] + n[j] - most))
            if lows[a] == highs[a]:
                ok &= ids[i] < ids[j]
            x, y = np.nonzero(ok)
            x, y = left[k + x], right[y]
            good = np.empty(len(x), bool)
            for c in range(0, len(x), 4096):
                u, v = x[c:c + 4096], y[c:c + 4096]
                good[c:c + 4096] = ((bits[u] == bits[v]).mean(axis=1) >= threshold / 100 - MARGIN) & ((bands[u] == bands[v]).argmax(axis=1) == place[u])
            x, y = x[good], y[good]
            each, at = np.unique(x, return_index=True)
            found += zip(each.tolist(), np.split(y, at[1:]), strict=False)
        yield found


def _sorted_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["key", "low", "high"], kind="stable", ignore_index=True)


def _feasible(threshold: int):
    """The rows of members that have a pair to try in their two blocks."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _sorted_blocks(rows)
        used = np.zeros(len(rows), bool)
        for found in _blocks(rows, threshold):
            for u, others in found:
                used[u] = True
                used[others] = True
        return rows[used]
    return run


def _tried(threshold: int):
    """Enough links (a, b), confirmed on the full sets, to connect what the pairs of each two blocks connect."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _sorted_blocks(rows)
        ids, root = rows["id"].to_numpy(), rows["root"].to_numpy()
        parts = [np.frombuffer(v, tb.U) for v in rows["set"]]
        n = np.array([len(p) for p in parts], np.int64)
        links = []
        for found in _blocks(rows, threshold):
            if not found:
                continue
            places = np.unique(np.concatenate([[u for u, _ in found], *(v for _, v in found)]))
            codes = np.unique(np.concatenate([parts[p] for p in places.tolist()]), return_inverse=True)[1]
            code = dict(zip(places.tolist(), np.split(codes, np.cumsum(n[places])[:-1]), strict=True))
            joined = root[places]  # grows together as links are found
            here = np.zeros(codes.max(initial=0) + 1, bool)
            for u, others in found:
                own = np.searchsorted(places, u)
                others = others[joined[np.searchsorted(places, others)] != joined[own]]
                if not len(others):
                    continue
                here[code[u]] = True
                of = np.repeat(np.arange(len(others)), n[others])
                both = np.bincount(of[here[np.concatenate([code[v] for v in others.tolist()])]], minlength=len(others))
                here[code[u]] = False
                for v in others[100 * both >= threshold * (n[u] + n[others] - both)].tolist():
                    other = joined[np.searchsorted(places, v)]
                    if other != joined[own]:
                        joined[joined == other] = joined[own]
                        links.append((min(ids[u], ids[v]), max(ids[u], ids[v])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")
    return run


def _between(open_rows: DataFrame, members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between members of bands (key, id, root, size) that connect what all their pairs connect."""
    large = F.col("size") > SMALL
    own = _owned(materialize(open_rows.filter(large).select("id", "root").distinct()), sets)
    rows = (open_rows.join(members, "id").join(own, "id", "left")
            .withColumn("own", F.when(large, F.coalesce("own", F.lit(0).cast("long"))).otherwise(0))
            .filter(100 * (F.col("n") - F.col("own")) >= threshold * F.col("n")))
    rows = materialize(rows)
    blocks = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    parts, feasible = rows.count() // PART + 1, _feasible(threshold)
    of = F.xxhash64("key", "low", "high")
    columns = dealt.select("key", "low", "high", "block", "id", "root", "n", "own", "bits", "bands")
    used = materialize(columns.withColumn("part", F.pmod(of, F.lit(parts))).groupBy("part")
                       .applyInPandas(lambda rows: feasible(rows.drop(columns="part")), columns.schema))
    parts = (used.agg(F.sum(8 * F.col("n"))).first()[0] or 0) // PART_BYTES + 1
    return (used.join(sets, "id").withColumn("part", F.pmod(of, F.lit(parts)))
            .groupBy("part").applyInPandas(_tried(threshold), "a long, b long"))


def _links(members: DataFrame, sets: DataFrame, buckets: DataFrame, threshold: int) -> DataFrame:
    """Enough links (a, b) to connect what the candidates of ``buckets`` (key, id, least) connect."""
    star = buckets.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = materialize(_verified(_most_alike(star, members, threshold), sets, threshold))
    root = components(links).withColumnsRenamed({"vertex": "id"})
    now = buckets.join(root, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    open_keys = (now.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
                 .filter("low < high").select("key", "size"))
    return materialize(links.union(_between(materialize(now.join(open_keys, "key")), members, sets, threshold)))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    known = materialize(source.mapInArrow(_signatures(width, threshold), "doc_id long, n long, print binary, bands array<long>, bits binary"))
    classes = materialize(known.filter("n > 0 AND doc_id IS NOT NULL").groupBy("print", "n")
                          .agg(F.min(F.struct("doc_id", "bands", "bits")).alias("of"))
                          .select("print", "n", F.col("of.doc_id").alias("id"), "of.bands", "of.bits"))
    banded = classes.select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")).filter("size > 1")
    buckets = materialize(banded.join(shared.select("key", "least"), "key"))
    ids = materialize(buckets.select("id").distinct())
    members = materialize(classes.join(narrow(ids), "id", "left_semi").select("id", "n", "bits", "bands"))
    sets = materialize(source.join(narrow(ids), "id", "left_semi").mapInArrow(_sets(width), "id long, set binary"))
    root = components(_links(members, sets, buckets, threshold)).withColumnsRenamed({"vertex": "id"})
    named = classes.select("print", "n", "id").join(root, "id", "left").select("print", "n", F.coalesce("root", "id").alias("root"))
    lone = F.col("doc_id").isNull() | (F.col("n") == 0)
    linked = known.filter(~lone).select("doc_id", "n", "print").join(named, ["print", "n"])
    return (linked.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), (F.col("doc_id") == F.col("root")).alias("kept"))
            .unionByName(known.filter(lone).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each component."""
    gone = near_duplicates(docs, doc_id, text, **settings).filter("NOT kept").select("doc_id")
    return without(docs, gone, doc_id)
