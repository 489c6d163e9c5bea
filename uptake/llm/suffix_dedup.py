"""Repeated passages by suffix arrays that the difference-cover algorithm builds.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller doc_id.  A suffix array of all bytes would move several times the input, so the
suffixes are first dealt to shards that can be sorted alone:

1. Every window of ``LENGTH`` bytes has an anchor, the substring of ``GRAM`` bytes in it with
   the smallest hash (the leftmost one).  Equal windows have equal anchors, wherever they
   stand.  The consecutive windows of one anchor make a context, about 63 bytes.
2. Anchors are counted over all documents; contexts whose anchor occurs in one document
   only can't repeat and are left out.
3. The other contexts go to the shard of their anchor.  A context that equals one of a
   smaller doc_id repeats as a whole, and equal ones are represented by the smallest
   doc_id.  Within buckets of documents this happens before the shuffle, so a passage that
   many documents share costs one row a bucket.
4. Where an anchor has several different contexts, the shard sorts their suffixes by
   difference cover: triples at the positions 1 and 2 modulo 3, recursion on their names,
   then the remaining suffixes by first byte and rank, merged in.  Neighbours with a common
   prefix of ``LENGTH`` bytes form a class, and windows of documents that are not the
   smallest of their class repeat.
5. The repeated windows go back to their documents.

Steps 2 and 3 discard only what can't repeat, or what equals a representative; strings are
judged on the input.  Null texts count as empty.  Rows without a doc_id are neither cut nor
compared.  Rows that share a doc_id are not smaller than each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..plans.stages import materialize
from . import textbytes as tb
from .ids import narrow

LENGTH, GRAM = 50, 24
#: Bytes of text in a bucket of documents, and about as many of contexts in a shard.
BUCKET = 2 << 20
#: Bytes of contexts in one suffix array, if an anchor doesn't have more.
SORTED = 256 << 10

CONTEXTS = "shard long, bucket long, anchors binary, docs binary, prints binary, starts binary, sizes binary, bytes binary, repeated boolean"
HITS = "bucket long, docs binary, prints binary, starts binary, ends binary"


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor hash, first window, last window) of the contexts of a block, in order."""
    n = len(data)
    if n < LENGTH:
        none = np.empty(0, np.int64)
        return none, np.empty(0, tb.U), none, none
    up, down = tb.power_tables(n + 1)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, tb.U)
        total[0] = 0
        np.cumsum(tb.VALUE[data] * up[:n], dtype=tb.U, out=total[1:])
        h = tb.mix((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1])
    value, place = h, np.arange(len(h), dtype=np.int32)
    width, span = LENGTH - GRAM + 1, 1

    def joined(step: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(value) - step
        right = value[step:] < value[:m]
        return np.where(right, value[step:], value[:m]), np.where(right, place[step:], place[:m])
    while span * 2 <= width:
        value, place = joined(span)
        span *= 2
    if width > span:
        value, place = joined(width - span)
    size = np.diff(offsets)
    rows = np.flatnonzero(size >= LENGTH)
    counts = size[rows] - LENGTH + 1
    first = np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    windows = first + np.arange(len(first))
    row = np.repeat(rows, counts)
    at = place[windows]
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(opens)
    if not len(begin):
        return rows, np.empty(0, tb.U), rows, rows
    end = np.append(begin[1:], len(at)) - 1
    return row[begin], h[at[begin]], windows[begin], windows[end]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, begin, end) of the runs of sorted keys."""
    used, begin = np.unique(keys, return_index=True)
    return used, begin, np.append(begin, len(keys))[1:]


def _shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    return ((anchor >> tb.U(32)) * tb.U(shards) >> tb.U(32)).astype(np.int64)


def _bucket_type(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.int32


def _short(anchor: np.ndarray) -> np.ndarray:
    """The upper 48 bits of sorted hashes, as rows of 6 bytes."""
    return anchor.view(np.uint8).reshape(-1, 8)[:, 2:]


def _long(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(tb.U)[:, 0]


def _anchors(shards: int):
    """(bucket, text) rows to anchors with their bucket, a row per shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch.column(0).to_numpy().astype(_bucket_type(shards))
            for row, _, data, offsets in tb.blocks(batch.column(1)):
                doc, anchor, _, _ = contexts(data, offsets)
                order = np.lexsort((doc, anchor))
                doc, anchor = doc[order], anchor[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                doc, anchor = doc[new], anchor[new]
                shard = _shard(anchor, shards)
                used, begin, end = _runs(shard)
                short, own = np.ascontiguousarray(_short(anchor)), buckets[row + doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int64()), pa.array([short[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary()),
                     pa.array([own[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary())],
                    names=["shard", "anchors", "buckets"])
    return run


def _joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _shared(shards: int):
    """A function that finds the anchors of a shard that several documents have, as a packed row per bucket."""
    return lambda table: _shared_anchors(table, _bucket_type(shards))


def _shared_anchors(table: pa.Table, kind: type) -> pa.Table:
    anchor, bucket = _long(_joined(table["anchors"])), np.frombuffer(_joined(table["buckets"]), kind)
    order = np.argsort(anchor, kind="stable")
    anchor, bucket = anchor[order], bucket[order]
    again = np.zeros(len(anchor), bool)
    again[1:] = anchor[1:] == anchor[:-1]
    again[:-1] |= again[1:]
    anchor, bucket = anchor[again], bucket[again]
    order = np.lexsort((anchor, bucket))
    anchor, bucket = anchor[order], bucket[order]
    used, begin, end = _runs(bucket)
    short = np.ascontiguousarray(anchor.view(np.uint8).reshape(-1, 8)[:, :6])
    return pa.table({"bucket": pa.array(used, pa.int64()),
                     "anchors": pa.array([short[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary())})


def _squeezed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _unsqueezed(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)


def _packed(shards: int):
    """Documents of a bucket and the shared anchors in it, to packed contexts."""
    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        wanted = np.unique(_long(_joined(anchors["anchors"])))
        out = {c: [] for c in ("shard", "bucket", "anchors", "docs", "prints", "starts", "sizes", "bytes", "repeated")}
        if not len(wanted) or not docs.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(out, _CONTEXT_TYPES, strict=True)})
        docs = docs.combine_chunks()
        bucket = docs["bucket"][0].as_py()
        ids, prints = docs["doc_id"].to_numpy(), docs["print"].to_numpy().astype(np.int32)
        found, texts, base = [], [], 0
        for row, _, data, offsets in tb.blocks(docs["text"].combine_chunks()):
            doc, anchor, first, last = contexts(data, offsets)
            short = anchor >> tb.U(16)
            at = np.searchsorted(wanted, short)
            at[at == len(wanted)] = 0
            hit = wanted[at] == short
            doc, anchor, first, last = doc[hit], anchor[hit], first[hit], last[hit]
            up, down = tb.power_tables(len(data) + 1)
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, tb.U), np.cumsum(tb.VALUE[data] * up[:len(data)], dtype=tb.U)])
                content = tb.mix((total[last + LENGTH] - total[first]) * down[first] + (last - first).astype(tb.U))
            found.append((row + doc, anchor, first - offsets[doc], last - first + LENGTH, first + base, content))
            texts.append(data)
            base += len(data)
        doc, anchor, start, size, place, content = (np.concatenate(c) for c in zip(*found, strict=True))
        text = np.concatenate(texts)
        order = np.lexsort((ids[doc], content))
        opens = np.ones(len(order), bool)
        opens[1:] = content[order][1:] != content[order][:-1]
        least = np.empty(len(order), np.int64)
        least[order] = ids[doc][order][opens][np.cumsum(opens) - 1] if len(order) else 0
        later = ids[doc] > least
        shard = _shard(anchor, shards)
        order = np.lexsort((place, later, shard))
        key = shard[order] * 2 + later[order]
        used, begin, end = _runs(key)
        for k, a, b in zip(used.tolist(), begin, end, strict=True):
            pick = order[a:b]
            repeated = bool(k % 2)
            values = (k // 2, bucket, np.ascontiguousarray(_short(anchor[pick])).tobytes() if not repeated else b"", ids[doc[pick]].tobytes(),
                      prints[doc[pick]].tobytes(), start[pick].astype(np.int32).tobytes(), size[pick].astype(np.int32).tobytes(),
                      b"" if repeated else _squeezed(b"".join(text[p:p + n].tobytes() for p, n in zip(place[pick], size[pick], strict=True))), repeated)
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), _CONTEXT_TYPES, strict=True)})
    return run


_CONTEXT_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``s`` (positive integers) in order, by difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    # a sampled position beyond the end keeps the two classes apart
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
    by = sample[order]
    new = np.ones(len(by), bool)
    new[1:] = (t[by[1:]] != t[by[:-1]]) | (t[by[1:] + 1] != t[by[:-1] + 1]) | (t[by[1:] + 2] != t[by[:-1] + 2])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        by = sample[suffix_array(names)]
    rank = np.zeros(n + 4, np.int64)
    rank[by] = np.arange(1, len(by) + 1)
    by = by[by < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.lexsort((rank[rest + 1], t[rest]))]
    # how many sampled suffixes are smaller than each remaining one
    smaller = np.zeros(len(rest), np.int64)
    for kind, shift in ((1, 1), (2, 2)):
        mine = by[by % 3 == kind]
        both = np.concatenate([mine, rest])
        keys = (rank[both + shift], t[both]) if shift == 1 else (rank[both + shift], t[both + 1], t[both])
        order = np.lexsort(keys)
        is_mine = order < len(mine)
        before = np.cumsum(is_mine)
        smaller[order[~is_mine] - len(mine)] += before[~is_mine]
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    places = np.arange(len(rest)) + smaller
    out[places] = rest
    taken[places] = True
    out[~taken] = by
    return out


def repeated_windows(texts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """Per text, the starts of windows that also stand in a text of a smaller document."""
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    symbols = data.astype(np.int64) + 2
    symbols[begin + size] = 1
    order = suffix_array(symbols)
    owner = np.searchsorted(begin, order, "right") - 1
    valid = order - begin[owner] <= size[owner] - LENGTH
    order, owner = order[valid], owner[valid]
    new = np.ones(len(order), bool)
    around = np.arange(LENGTH)
    for k in range(1, len(order), 65536):
        a, b = order[k - 1:k + 65535], order[k:k + 65536]
        new[k:k + 65536] = (data[a[:len(b), None] + around] != data[b[:, None] + around]).any(axis=1)
    opens = np.flatnonzero(new)
    least = np.minimum.reduceat(docs[owner], opens)[np.cumsum(new) - 1] if len(order) else docs[:0]
    hit = docs[owner] > least
    order, owner = order[hit], owner[hit]
    by = np.lexsort((order, owner))
    order, owner = order[by], owner[by]
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [order[a:b] - begin[k] for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


def _resolved(table: pa.Table) -> pa.Table:
    """The windows of a shard's contexts that repeat, as packed (doc, print, first, last) per bucket."""
    out: dict[int, list] = {}

    def put(bucket: np.ndarray, docs: np.ndarray, prints: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        for b in np.unique(bucket).tolist():
            m = bucket == b
            out.setdefault(b, []).append((docs[m], prints[m], first[m].astype(np.int32), last[m].astype(np.int32)))

    loose, known = table.filter(pc.invert(table["repeated"])), table.filter(table["repeated"])
    for r in known.to_pylist():
        first, size = np.frombuffer(r["starts"], np.int32), np.frombuffer(r["sizes"], np.int32)
        out.setdefault(r["bucket"], []).append((np.frombuffer(r["docs"], np.int64), np.frombuffer(r["prints"], np.int32), first, first + size - LENGTH))
    if loose.num_rows:
        anchor = _long(_joined(loose["anchors"]))
        docs, prints = np.frombuffer(_joined(loose["docs"]), np.int64), np.frombuffer(_joined(loose["prints"]), np.int32)
        first, size = np.frombuffer(_joined(loose["starts"]), np.int32), np.frombuffer(_joined(loose["sizes"]), np.int32)
        bucket = np.repeat(loose["bucket"].to_numpy(), [len(v) // 8 for v in loose["docs"].to_pylist()])
        each = [int(np.frombuffer(v, np.int32).sum(dtype=np.int64)) for v in loose["sizes"].to_pylist()]
        text = b"".join(_unsqueezed(v, n) for v, n in zip(loose["bytes"].to_pylist(), each, strict=True))
        ends = np.cumsum(size, dtype=np.int64)
        number: dict[bytes, int] = {}
        same = np.array([number.setdefault(text[e - n:e], len(number)) for e, n in zip(ends.tolist(), size.tolist(), strict=True)])
        distinct = list(number)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, same, docs)
        later = docs > least[same]
        put(bucket[later], docs[later], prints[later], first[later], (first + size - LENGTH)[later])
        # anchors with several different contexts
        of = np.zeros(len(distinct), tb.U)
        of[same] = anchor
        kinds, at, n = np.unique(of, return_inverse=True, return_counts=True)
        several = np.flatnonzero(n[at] > 1)
        found: dict[int, np.ndarray] = {}
        # contexts of one anchor are sorted together, those of other anchors needn't be
        by = several[np.argsort(at[several], kind="stable")]
        last = np.append(np.flatnonzero(np.diff(at[by])) + 1, len(by)) if len(by) else by
        length = np.cumsum([len(distinct[k]) for k in by.tolist()], dtype=np.int64)
        a = 0
        while a < len(by):
            full = np.searchsorted(length, (length[a - 1] if a else 0) + SORTED, "right")
            b = int(last[min(np.searchsorted(last, max(full, a + 1)), len(last) - 1)])
            found.update(zip(by[a:b].tolist(), repeated_windows([distinct[k] for k in by[a:b].tolist()], least[by[a:b]]), strict=True))
            a = b
        if len(several):
            for k in np.flatnonzero(~later & np.isin(same, several)).tolist():
                w = found[same[k]]
                if len(w):
                    cut = np.flatnonzero(np.diff(w) > 1)
                    a, b = w[np.append(0, cut + 1)], w[np.append(cut, len(w) - 1)]
                    m = len(a)
                    put(np.full(m, bucket[k]), np.full(m, docs[k]), np.full(m, prints[k]), first[k] + a, first[k] + b)
    rows = {c: [] for c in ("bucket", "docs", "prints", "starts", "ends")}
    for b, parts in out.items():
        rows["bucket"].append(b)
        for c, arrays in zip(("docs", "prints", "starts", "ends"), zip(*parts, strict=True), strict=True):
            rows[c].append(np.concatenate(arrays).tobytes())
    return pa.table({"bucket": pa.array(rows["bucket"], pa.int64()), **{c: pa.array(rows[c], pa.binary()) for c in ("docs", "prints", "starts", "ends")}})


def _hit_ids(hits: pa.Table) -> pa.Table:
    """The documents of one bucket that have repeated windows, each once."""
    return pa.table({"id": pa.array(np.unique(np.frombuffer(_joined(hits["docs"]), np.int64)))})


def _cut(docs: pa.Table, hits: pa.Table) -> pa.Table:
    """The documents of a bucket without the bytes that their repeated windows cover."""
    ids, prints = np.frombuffer(_joined(hits["docs"]), np.int64), np.frombuffer(_joined(hits["prints"]), np.int32)
    first, last = np.frombuffer(_joined(hits["starts"]), np.int32), np.frombuffer(_joined(hits["ends"]), np.int32)
    order = np.lexsort((prints, ids))
    ids, prints, first, last = ids[order], prints[order], first[order], last[order]
    out = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
    for doc, own, text in zip(docs["doc_id"].to_pylist(), docs["print"].to_pylist(), docs["text"], strict=True):
        data = (text.as_py() or "").encode()
        a, b = np.searchsorted(ids, doc, "left"), np.searchsorted(ids, doc, "right")
        mine = slice(a, b) if a == b else a + np.flatnonzero(prints[a:b] == own)
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, first[mine], 1)
        np.add.at(edge, last[mine] + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        for c, v in zip(out, (doc, len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()), strict=True):
            out[c].append(v)
    return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), **{c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")},
                     "kept": pa.array(out["kept"], pa.binary())})


def _digested(table: pa.Table) -> pa.Table:
    digests = [hashlib.sha256(v.as_py()).hexdigest() for v in table["kept"]]
    return table.drop_columns(["kept"]).append_column("kept_sha256", pa.array(digests, pa.string()))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, or with ``keep_bytes`` the remaining bytes as ``kept``.

    A remaining part may begin or end inside a character, so it is binary.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), content.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total // BUCKET) + 1
    source = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), "doc_id",
                         F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("print"), "text")
    long = source.filter((F.octet_length("text") >= LENGTH) & F.col("doc_id").isNotNull())

    anchors = long.select("bucket", "text").mapInArrow(_anchors(buckets), "shard long, anchors binary, buckets binary")
    shared = anchors.groupBy("shard").applyInArrow(_shared(buckets), "bucket long, anchors binary")
    packed = (long.groupBy("bucket").cogroup(shared.withColumnRenamed("bucket", "of").groupBy("of"))
              .applyInArrow(_packed(buckets), CONTEXTS))
    hits = materialize(packed.groupBy("shard").applyInArrow(_resolved, HITS))

    touched = materialize(hits.select("bucket", "docs").groupBy("bucket").applyInArrow(_hit_ids, "id long"))
    some = narrow(touched)
    cut = (long.join(some, F.col("doc_id") == F.col("id"), "left_semi").groupBy("bucket")
           .cogroup(hits.withColumnRenamed("bucket", "of").groupBy("of")))
    if keep_bytes:
        changed = cut.applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
        last = F.col("text").cast("binary").alias("kept")
    else:
        changed = cut.applyInArrow(lambda d, h: _digested(_cut(d, h)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        last = F.sha2("text", 256).alias("kept_sha256")
    zero = F.lit(0).cast("long")
    whole = source.withColumn("in", (F.octet_length("text") >= LENGTH) & F.col("doc_id").isNotNull())
    untouched = whole.join(some, F.col("in") & (F.col("doc_id") == F.col("id")), "left_anti").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), last)
    return changed.unionByName(untouched)
