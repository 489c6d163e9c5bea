"""Benchmark decontamination with a distributed positional inverted index.

``build`` turns every ``SHARD`` bytes of documents into one shard of the index: a row per
document and a row per term with its posting list, the ascending word positions in the
shard as varint gaps.  A shard holds whole documents, so postings are never shuffled
when the index is written.  Documents are ``GAP`` positions apart: no match of a window
crosses a document.

``search`` takes the terms of the test windows, fetches their posting lists, brings the
lists of a shard together and works through the windows: the rarest term of a window in
the shard gives the first candidates, and the lists of the other terms, from rare to
frequent and shifted by their offset in the window, narrow them by intersection.  A
proximity match has the window's terms in order with at most ``slop`` other words among
them, found from the rarest term outwards.

Windows are worked through in blocks of at most about ``WINDOWS``, which bounds what is
broadcast (8 bytes a term) at any number of benchmark items.

A word is a maximal run of characters other than ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``
after lower-casing A-Z.  Terms are 64-bit hashes of words.  Null or empty texts have no
words; such documents have a row with n_words 0, such items have no window.  Items
without an id are ignored.  Repeated documents and items are treated one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.stages import materialize
from . import textbytes as tb
from .ids import without

#: Positions between documents, windows of a block, bytes of text in a shard.
GAP, WINDOWS, SHARD = 1024, 100_000, 8 << 20

INDEX_SCHEMA = "shard long, doc long, term long, n long, at long, postings binary"
HIT_SCHEMA = "shard long, at long, begins array<int>, ends array<int>, items array<long>, near array<long>"


@dataclass
class Index:
    documents: DataFrame  #: shard, doc (id), n (words), at (position of the first word)
    postings: DataFrame  #: shard, term, n (occurrences), postings


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) batches to index rows; rows with a position are documents, the others posting lists."""
    task = TaskContext.get().partitionId()
    parts = (batch.slice(row, end - row) for batch in batches for row, end, _, _ in tb.blocks(batch.column(1), SHARD))
    for number, batch in enumerate(parts):
        n = batch.num_rows
        hashes, counts = [], np.zeros(n, np.int64)
        for row, end, data, offsets in tb.blocks(batch.column(1)):
            starts, ends, before = tb.words(data, offsets, tb.ALNUM)
            hashes.append(tb.word_hashes(data, starts, ends))
            counts[row:end] = np.diff(before)
        terms = np.concatenate(hashes) if hashes else np.empty(0, tb.U)
        first = np.concatenate([[0], np.cumsum(counts + GAP)[:-1]])
        before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        shard = np.full(n, (task << 32) + number, np.int64)
        empty = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard), batch.column(0), empty, pa.array(counts), pa.array(first), pa.nulls(n, pa.binary())],
            names=["shard", "doc", "term", "n", "at", "postings"])
        if not len(terms):
            continue
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        opens = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
        size = np.diff(np.concatenate([opens, [len(terms)]]))
        places = (order + np.repeat(first - before, counts)[order]).astype(np.int64)
        gaps = np.diff(places, prepend=0)
        gaps[opens] = places[opens]
        data, value_end = tb.varint(gaps)
        ends = np.concatenate([[0], value_end[opens + size - 1]]).astype(np.int32)
        n = len(opens)
        empty = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, shard[0])), empty, pa.array(terms[opens].view(np.int64)), pa.array(size), empty,
             pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)])],
            names=["shard", "doc", "term", "n", "at", "postings"])


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents, as written tables in the shared folder."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(_shards, INDEX_SCHEMA)
    written = materialize(rows.withColumn("kind", F.when(F.col("at").isNull(), "term").otherwise("document")), "kind")
    return Index(written.filter("kind = 'document'").select("shard", "doc", "n", "at"),
                 written.filter("kind = 'term'").select("shard", "term", "n", "postings"))


def windows(items: DataFrame, width: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, terms): every ``width`` consecutive words of an item; a shorter item is one window."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tb.blocks(batch.column(1)):
                starts, ends, before = tb.words(data, offsets, tb.ALNUM)
                terms = tb.word_hashes(data, starts, ends).view(np.int64)
                item, found = [], []
                for k in range(end - row):
                    a, b = before[k], before[k + 1]
                    for i in range(a, max(b - width, a) + 1 if b > a else a):
                        item.append(batch.column(0)[row + k].as_py())
                        found.append(terms[i:min(i + width, b)])
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["item", "terms"])
    source = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).cast("string").alias("text")).filter("item IS NOT NULL")
    return source.mapInArrow(cut, "item long, terms array<long>").distinct()


def exact(lists: list[np.ndarray]) -> np.ndarray:
    """Positions of a window's first word, from the offset-adjusted lists of its words."""
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    found = lists[order[0]] - order[0]
    for i in order[1:]:
        if not len(found):
            break
        k = np.searchsorted(lists[i], found + i)
        k[k == len(lists[i])] = 0
        found = found[lists[i][k] == found + i]
    return found


def proximate(lists: list[np.ndarray], slop: int) -> np.ndarray:
    """First positions of the proximity matches around each occurrence of the rarest word."""
    seed = min(range(len(lists)), key=lambda i: len(lists[i]))
    left = right = lists[seed]
    alive = np.ones(len(left), bool)
    for i in range(seed + 1, len(lists)):
        k = np.searchsorted(lists[i], right, "right")
        alive &= k < len(lists[i])
        right = lists[i][np.minimum(k, len(lists[i]) - 1)]
    for i in range(seed - 1, -1, -1):
        k = np.searchsorted(lists[i], left, "left") - 1
        alive &= k >= 0
        left = lists[i][np.maximum(k, 0)]
    return left[alive & (right - left <= len(lists) - 1 + slop)]


def _match(block: list[tuple[int, np.ndarray]], slop: int):
    """A function that runs the windows of ``block`` over the posting lists and documents of one shard."""
    def run(key, postings: pd.DataFrame, documents: pd.DataFrame) -> pd.DataFrame:
        documents = documents.sort_values("at")
        at = documents["at"].to_numpy()
        lists = {t: np.cumsum(tb.unvarint(p)) for t, p in zip(postings["term"], postings["postings"], strict=True)}
        hits: dict[int, tuple[list, set, set]] = {}
        for item, terms in block:
            found = [lists.get(t) for t in terms]
            if any(x is None for x in found):
                continue
            for p in exact(found):
                doc = int(np.searchsorted(at, p, "right")) - 1
                spans, items, _ = hits.setdefault(doc, ([], set(), set()))
                spans.append((p - at[doc], p - at[doc] + len(terms)))
                items.add(item)
            if slop:
                for p in proximate(found, slop):
                    hits.setdefault(int(np.searchsorted(at, p, "right")) - 1, ([], set(), set()))[2].add(item)
        out = {c: [] for c in ("shard", "at", "begins", "ends", "items", "near")}
        for doc, (spans, items, close) in hits.items():
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for c, v in zip(out, (key[0], at[doc], [m[0] for m in merged], [m[1] for m in merged], sorted(items), sorted(close)), strict=True):
                out[c].append(v)
        return pd.DataFrame(out, dtype=object)
    return run


def search(index: Index, tests: DataFrame, slop: int = 0) -> DataFrame:
    """(shard, at, begins, ends, items, near) of documents with matches.

    begins and ends: runs of words inside exact matches; items: items with exact
    matches; near: items with proximity matches (exact ones included) if ``slop`` > 0.
    """
    if slop >= GAP:
        raise ValueError(f"slop has to be below {GAP}")
    spark = tests.sparkSession
    tests = materialize(tests)
    count = math.ceil(tests.count() / WINDOWS)
    parts = None
    for b in range(count):
        block = tests.filter(F.pmod(F.xxhash64("item", "terms"), F.lit(count)) == b) if count > 1 else tests
        local = [(r["item"], np.array(r["terms"], np.int64)) for r in block.collect()]
        if max((len(t) for _, t in local), default=0) + slop > GAP:
            raise ValueError(f"windows and slop together may not exceed {GAP} words")
        terms = spark.createDataFrame(pd.DataFrame({"term": sorted({int(t) for _, w in local for t in w})}), "term long")
        lists = index.postings.join(F.broadcast(terms), "term", "left_semi")
        found = (lists.select("shard", "term", "postings").groupBy("shard")
                 .cogroup(index.documents.select(F.col("shard").alias("of"), "at").groupBy("of"))
                 .applyInPandas(_match(local, slop), HIT_SCHEMA))
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return spark.createDataFrame([], HIT_SCHEMA)
    return parts


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 2,
                  doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (array, ascending), near_ids (array).

    n_hit: words inside any exact match of a window.  near_ids: items with a proximity match.
    """
    index = build(docs, doc_id, text)
    hits = search(index, windows(items, width, item_id, item_text), slop)
    # a document has a row from each block of windows; its runs of words may overlap between blocks
    runs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("begins", "ends"))))
    covered = F.aggregate(runs, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda a, r: F.struct(
        (a["n"] + F.greatest(r["ends"] - F.greatest(r["begins"], a["end"]), F.lit(0))).cast("long").alias("n"),
        F.greatest(a["end"], r["ends"]).alias("end")), lambda a: a["n"])
    ids = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    per_document = hits.groupBy("shard", "at").agg(covered.alias("hit"), ids("items").alias("items"), ids("near").alias("close"))
    none = F.array().cast("array<bigint>")
    return index.documents.join(per_document, ["shard", "at"], "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_words"), F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("item_ids"), F.coalesce("close", none).alias("near_ids"))


def decontaminated(docs: DataFrame, items: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without an exact match, with all their columns.

    Documents that share an id go together; documents without one stay.
    """
    found = contamination(docs, items, width, 0, doc_id, text)
    return without(docs, found.filter("n_hit > 0").select("doc_id"), doc_id)
