"""Toxicity: a counterfactual-regularised linear classifier.

Features of a text are its distinct words and word beginnings, A-Z lower-cased, as 64-bit
hashes.  ``fit`` learns from a sample of about ``TOXIC`` rows labelled 1 and ``CLEAN`` rows
labelled 0, drawn by a hash of doc_id (all rows of a class that has fewer).  Spark counts
the features of the sample by label and keeps the ``FEATURES`` that tell the labels apart
best; only those of each sampled row, and the counts, reach the driver.

Counterfactuals: in every labelled sentence of the sample that holds an identity term, the
term is swapped for the other terms of its group, a neutral one among them, and the change
of the score's logit is penalised.  In a linear model that change depends on the two terms
only, so the sentences are counted by term and the loss gets ``PENALTY`` times the mean of
the squared changes.  The terms' own features are always in the model.  A term that occurs
in more toxic than clean sentences thus can't carry weight of its own; words beside it do.

``score`` reads whole texts and nothing else.  Null counts as empty; an empty text has the
score of the intercept.  Rows whose label is null or whose id is not in ``docs`` teach
nothing; a doc_id with several labels is toxic if one says so.  Without toxic or without
clean rows to learn from, all scores are 0 or 1 after the only label, and 0 without any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.stages import materialize
from . import textbytes as tb

TOXIC, CLEAN, FEATURES, SHARDS = 4096, 8192, 4096, 32
BEGINNINGS = (4, 5, 6, 7)
PENALTY, SHRINK, STEPS, WEIGHT, DEVIATIONS = 10.0, 1e-4, 250, 3.0, 3.0

#: Identity terms by group; the first of each group is neutral.
IDENTITY = (
    ("person", "woman", "man", "girl", "boy"),
    ("people", "women", "men", "girls", "boys"),
    ("they", "she", "he"),
    ("citizen", "immigrant", "refugee", "foreigner"),
    ("citizens", "immigrants", "refugees", "foreigners"),
    ("religious", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("human", "black", "white", "asian", "african", "european", "arab", "latino", "hispanic", "indigenous"),
    ("adult", "gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("resident", "disabled", "deaf", "blind", "autistic"),
    ("personne", "femme", "homme"), ("gens", "femmes", "hommes"), ("croyant", "musulman", "juif", "chrétien"),
    ("mensch", "frau", "mann"), ("menschen", "frauen", "männer"), ("gläubige", "muslime", "juden", "christen"),
    ("persona", "mujer", "hombre"), ("personas", "mujeres", "hombres"), ("creyente", "musulmán", "judío", "cristiano"),
)


@dataclass
class Model:
    features: np.ndarray  #: sorted hashes
    weights: np.ndarray
    intercept: float


_LETTERS = tb.ALNUM.copy()
_LETTERS[48:58] = False


def _features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all features of a block, repeated ones too.  wanted: a bitmap of 2^22 places, to leave others out."""
    starts, ends, before = tb.words(data, offsets, _LETTERS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    up, down = tb.power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, tb.U)
        total[0] = 0
        np.cumsum(tb.VALUE[tb.LOWER[data]] * up[:len(data)], dtype=tb.U, out=total[1:])
        rows, found = [], []
        for k in (0, *BEGINNINGS):
            has = slice(None) if not k else np.flatnonzero(ends - starts > k)
            a = starts[has]
            b = ends[has] if not k else a + k
            h = tb.mix((total[b] - total[a]) * down[a] + tb.U(k))
            r = row[has]
            if wanted is not None:
                hit = wanted[(h >> tb.U(42)).astype(np.int64)]
                h, r = h[hit], r[hit]
            rows.append(r)
            found.append(h)
    return np.concatenate(rows), np.concatenate(found)


def _of(term: str) -> np.ndarray:
    data = np.frombuffer(term.encode(), np.uint8)
    return np.unique(_features(data, np.array([0, len(data)]))[1])


def _distinct(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    return row[new], feature[new]


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) rows to packed features and labels, a row per shard of the hash space."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint8)
        for row, _, data, offsets in tb.blocks(batch.column(1)):
            r, f = _distinct(*_features(data, offsets))
            at = (f % tb.U(SHARDS)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            cut = np.searchsorted(at[order], np.arange(SHARDS + 1))
            label = toxic[row + r]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SHARDS), pa.int32()), pa.array([f[order[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                 pa.array([label[order[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                names=["shard", "feature", "toxic"])


def _telling(counts: tuple[int, int], features: int):
    """The features of a shard that tell the labels apart best, by the deviation of their toxic share."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        feature, label = np.frombuffer(b"".join(rows["feature"]), tb.U), np.frombuffer(b"".join(rows["toxic"]), np.uint8)
        order = np.argsort(feature, kind="stable")
        feature, label = feature[order], label[order].astype(np.int64)
        opens = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]]))
        n = np.diff(np.append(opens, len(feature)))
        hits = np.add.reduceat(label, opens)
        share = counts[1] / sum(counts)
        value = np.abs(hits - n * share) / np.sqrt(n * share * (1 - share) + 1)
        value[n < 3] = 0
        best = np.argsort(-value, kind="stable")[:features]
        best = best[value[best] >= DEVIATIONS]
        return pd.DataFrame({"feature": feature[opens[best]].view(np.int64), "value": value[best]})
    return run


def _bitmap(features: np.ndarray) -> np.ndarray:
    wanted = np.zeros(1 << 22, bool)
    wanted[(features >> tb.U(42)).astype(np.int64)] = True
    return wanted


def _columns(data: np.ndarray, offsets: np.ndarray, features: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index into ``features``) of the distinct features of a block that are in the model."""
    row, found = _features(data, offsets, wanted)
    at = np.searchsorted(features, found)
    at[at == len(features)] = 0
    hit = features[at] == found
    key = np.unique(row[hit] * len(features) + at[hit])
    return key // len(features), key % len(features)


def _matrix(features: np.ndarray):
    wanted = _bitmap(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tb.blocks(batch.column(1)):
                r, at = _columns(data, offsets, features, wanted)
                cut = np.searchsorted(r, np.arange(end - row + 1))
                packed = [at[a:b].astype(np.int16).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], pa.array(packed, pa.binary())], names=["toxic", "at"])
    return run


def _sentences(groups: tuple[tuple[str, ...], ...]):
    """(term, sentences): in how many sentences of the sample each identity term stands."""
    terms = {t for g in groups for t in g}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(terms, 0)
        for batch in batches:
            for text in batch.column(1):
                for sentence in re.split(r"[.!?\n]+", (text.as_py() or "").lower()):
                    for t in terms & set(re.findall(r"[^\W\d_]+", sentence)):
                        counts[t] += 1
        used = [(t, n) for t, n in counts.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in used], pa.string()), pa.array([n for _, n in used], pa.int64())],
                                         names=["term", "sentences"])
    return run


def _solve(row: np.ndarray, at: np.ndarray, label: np.ndarray, importance: np.ndarray, size: int,
           swaps: list[tuple[np.ndarray, float]], penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the weighted log-loss, shrinkage and the counterfactual penalty.

    swaps: (change of the features as (index, sign) rows, share of the sentences).
    """
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log((importance[label == 1].sum() + 1e-9) / (importance[label == 0].sum() + 1e-9))
    importance = importance / importance.sum()
    for step in range(1, STEPS + 1):
        logit = np.bincount(row, weights=w[at], minlength=len(label)) + w[-1]
        error = importance * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - label)
        grad = np.append(np.bincount(at, weights=error[row], minlength=size) + SHRINK * w[:-1], error.sum())
        for change, share in swaps:
            grad[change[:, 0]] += 2 * penalty * share * (w[change[:, 0]] @ change[:, 1]) * change[:, 1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        w -= 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, penalty: float = PENALTY, groups: tuple[tuple[str, ...], ...] = IDENTITY,
        doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """The classifier learned from the texts of ``docs`` and all rows of ``labels`` (doc_id, toxic)."""
    known = (labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("toxic")).dropna()
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    quota = F.when(F.col("toxic") == 1, min(1.0, TOXIC / max(n.get(1, 0), 1))).otherwise(min(1.0, CLEAN / max(n.get(0, 0), 1)))
    drawn = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < quota * (1 << 20))
    # a sample of bounded size: its ids may be broadcast, and the texts of other documents don't move
    sample = materialize(docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
                         .join(F.broadcast(drawn), "id").select("toxic", "text"))
    have = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not have.get(0) or not have.get(1):
        return Model(np.empty(0, tb.U), np.empty(0), 40.0 if have.get(1) else -40.0)

    telling = (sample.mapInArrow(_dealt, "shard int, feature binary, toxic binary").groupBy("shard")
               .applyInPandas(_telling((have[0], have[1]), FEATURES), "feature long, value double")
               .orderBy(F.desc("value"), "feature").limit(FEATURES))
    terms = {t: _of(t) for g in groups for t in g}
    features = np.unique(np.concatenate([np.array([r["feature"] for r in telling.collect()], np.int64).view(tb.U), *terms.values()]))
    rows = sample.mapInArrow(_matrix(features), "toxic int, at binary").collect()
    packed = [np.frombuffer(r["at"], np.int16).astype(np.int64) for r in rows]
    label = np.array([r["toxic"] for r in rows])
    importance = np.where(label == 1, WEIGHT * n[1] / have[1], n[0] / have[0])

    counts = sample.mapInArrow(_sentences(groups), "term string, sentences long").groupBy("term").agg(F.sum("sentences").alias("n"))
    sentences = {r["term"]: r["n"] for r in counts.collect()}
    swaps = []
    for group in groups:
        for a in group:
            for b in group:
                if a != b and sentences.get(a):
                    own, other = (np.searchsorted(features, terms[t]) for t in (a, b))
                    mine, theirs = np.setdiff1d(own, other), np.setdiff1d(other, own)
                    change = np.concatenate([np.stack([mine, np.ones(len(mine), int)], 1), np.stack([theirs, -np.ones(len(theirs), int)], 1)])
                    swaps.append((change, sentences[a] / (sum(sentences.values()) * (len(group) - 1))))
    w, b = _solve(np.repeat(np.arange(len(rows)), [len(p) for p in packed]), np.concatenate(packed), label, importance,
                  len(features), swaps, penalty)
    return Model(features, w, b)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and score, from the whole text."""
    wanted = _bitmap(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, model.intercept)
            for row, end, data, offsets in tb.blocks(batch.column(1)) if len(model.features) else ():
                r, at = _columns(data, offsets, model.features, wanted)
                out[row:end] += np.bincount(r, weights=model.weights[at], minlength=end - row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -40, 40))))], names=[doc_id, "score"])
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{doc_id}` {kind}, score double")
