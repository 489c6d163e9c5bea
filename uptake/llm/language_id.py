"""Language identification by mixture inference.

``train`` counts hashed letter trigrams (with word boundaries) per language over all
labelled documents.  ``predict`` treats every document as a mixture of languages: each
word is drawn from one of them, with the likelihood its trigrams have there.
Expectation-maximisation estimates the proportions of all languages first.  Then the
language with the least share is left out and the others are fitted again, as long as the
log-likelihood minus ``PENALTY / 2 * log(words)`` for each language does not fall; what is
left is the document's set of languages.

The model has ``BUCKETS`` numbers a language; ``train`` refuses more than ``LANGUAGES``
languages, so it never exceeds 128 MiB.  Text and language are the only inputs of
``train``, text the only one of ``predict``.  Documents without a language or without
letters teach nothing.  A null text, a text without a letter, or a model without languages
gives ``und`` with score 0.  Repeated documents count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb

BUCKETS, LANGUAGES = 1 << 15, 512
SMOOTHING, ROUNDS, REFIT, PENALTY = 0.5, 8, 4, 1.0
#: Least evidence of learned languages in nats a letter, and what a text is given as a whole for being short.
EVIDENCE, FEW = -3.5, 20.0
UNKNOWN = "und"

#: Letters: A-Z as a-z, and every byte beyond ASCII; other bytes are boundaries.
_LETTER = tb.LOWER.copy()
_LETTER[~tb.ALNUM] = 32
_LETTER[48:58] = 32
_IS_LETTER = _LETTER != 32


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  #: log-likelihood of each trigram bucket, a column per language


def _trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each byte of each word."""
    padded = np.full(len(data) + 2, 32, np.uint32)
    padded[1:-1] = _LETTER[data]
    first = padded[:-2].copy()
    first[starts] = 32
    last = padded[2:].copy()
    last[ends - 1] = 32
    key = (first << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | last
    key *= np.uint32(0x9E3779B1)
    return (key >> np.uint32(32 - 15)).astype(np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        languages = batch.column(0).to_pylist()
        for row, _, data, offsets in tb.blocks(batch.column(1)):
            starts, ends, before = tb.words(data, offsets, _IS_LETTER)
            if not len(starts):
                continue
            buckets, letter = _trigrams(data, starts, ends), _IS_LETTER[data]
            for k in range(len(offsets) - 1):
                a, b = offsets[k], offsets[k + 1]
                if a < b:
                    mine = total.setdefault(languages[row + k], np.zeros(BUCKETS, np.int64))
                    mine += np.bincount(buckets[a:b][letter[a:b]], minlength=BUCKETS)
                if len(total) > LANGUAGES:
                    raise ValueError(f"more than {LANGUAGES} languages")
    for language, n in total.items():
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([language] * len(used)), pa.array(used, pa.int32()), pa.array(n[used])],
                                         names=["lang", "bucket", "n"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The trigram model of all rows of ``docs`` that have a language."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang IS NOT NULL")
    counted = rows.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.groupBy("lang").agg(F.sum("n").alias("n"), F.collect_list(F.struct("bucket", "n")).alias("of"))
    found = found.orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    logs = np.empty((BUCKETS, len(found)))
    for k, r in enumerate(found):
        logs[:, k] = np.log(SMOOTHING)
        for bucket, n in r["of"]:
            logs[bucket, k] = np.log(n + SMOOTHING)
        logs[:, k] -= np.log(r["n"] + SMOOTHING * BUCKETS)
    return Model([r["lang"] for r in found], logs)


def _fit(likelihood: np.ndarray, share: np.ndarray, doc: np.ndarray, first: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after some rounds of expectation-maximisation, and the log-likelihood of each document under them."""
    n = np.diff(np.append(first, len(doc)))[:, None]
    for _ in range(rounds):
        part = likelihood * share[doc]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, first) / n
    return share, np.add.reduceat(np.log((likelihood * share[doc]).sum(axis=1)), first)


def mixtures(logs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares, confidence) of documents from the words' log-likelihoods (a row a word, a column a language).

    ``first``: the first word of each document, each having at least one.  Shares are 0
    outside the chosen set.  Confidence: how likely the language of the largest share is
    if the document had a single one.
    """
    count, languages = len(first), logs.shape[1]
    single = np.add.reduceat(logs, first)
    size = np.diff(np.append(first, len(logs)))
    doc = np.repeat(np.arange(count), size)
    likelihood = np.maximum(np.exp(logs - logs.max(axis=1, keepdims=True)), 1e-12)
    cost = PENALTY / 2 * np.log(size + 1)
    share, fit = _fit(likelihood, np.full((count, languages), 1 / languages), doc, first, ROUNDS)
    kept = np.full(count, languages)
    going = np.ones(count, bool)
    for _ in range(languages - 1):
        if not going.any():
            break
        least = np.where(share > 0, share, np.inf).argmin(axis=1)
        tried = share.copy()
        tried[np.arange(count), least] = 0
        total = tried.sum(axis=1, keepdims=True)
        tried = np.where(tried > 0, np.maximum(tried / np.where(total > 0, total, 1), 1e-9), 0)
        again, value = _fit(likelihood, tried, doc, first, REFIT)
        going &= (value - (kept - 1) * cost >= fit - kept * cost) & (kept > 1)
        share = np.where(going[:, None], again, share)
        fit = np.where(going, value, fit)
        kept -= going
    best = share.argmax(axis=1)
    spread = np.exp(np.minimum(single - single[np.arange(count), best][:, None], 50))
    return share, 1 / spread.sum(axis=1)


def evidences(logs: np.ndarray, letters: np.ndarray, first: np.ndarray, share: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Per document, how much less likely a letter is than one of learned text, in nats.

    Each word counts by the language of the document's set that explains it best; ``expected``
    are the mean log-likelihoods of a letter in each language's own text.  About 0 for text
    of learned languages, far below for other text, in whatever language it is put.  A text
    of few letters proves little and is given ``FEW`` nats in all.
    """
    doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(logs))))
    over = np.where(share[doc] > 0, logs - letters[:, None] * expected, -np.inf).max(axis=1)
    return (np.add.reduceat(over, first) + FEW) / np.add.reduceat(letters, first)


def _predicted(model: Model):
    names, width, expected = model.languages, len(model.languages), (np.exp(model.logs) * model.logs).sum(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            best, score, sets, shares, evidence = [UNKNOWN] * n, np.zeros(n), [[]] * n, [[]] * n, np.full(n, -np.inf)
            letters = batch.column("letters").to_pylist()
            for row, end, data, offsets in tb.blocks(batch.column("text")) if width else ():
                starts, ends, before = tb.words(data, offsets, _IS_LETTER)
                has = np.flatnonzero(np.diff(before))
                if not len(has):
                    continue
                values = model.logs[_trigrams(data, starts, ends)]
                letter = _IS_LETTER[data]
                values[~letter] = 0
                logs, first = np.add.reduceat(values, starts), before[:-1][has]
                found, sure = mixtures(logs, first)
                known = evidences(logs, np.add.reduceat(letter.astype(np.int64), starts), first, found, expected)
                evidence[has + row] = known
                for k, share, p in zip((has + row).tolist(), found, sure, strict=True):
                    if letters[k]:
                        top = np.argsort(-share, kind="stable")
                        top = top[share[top] > 0]
                        best[k], score[k] = names[top[0]], share[top[0]] * p
                        sets[k], shares[k] = [names[i] for i in top], share[top].tolist()
            kept = [batch.column(c) for c in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(best, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(sets, pa.list_(pa.string())),
                 pa.array(shares, pa.list_(pa.float64())), pa.array(evidence)],
                names=[*batch.schema.names[:-2], "lang_pred", "score", "languages", "shares", "evidence"])
    return run


def predict(docs: DataFrame, model: Model, text: str = "text", carry: str = "doc_id") -> DataFrame:
    """``carry`` and, per row, lang_pred, score, languages (largest share first), their shares, and the evidence for them."""
    content = F.col(text).cast("string")
    rows = docs.select(F.col(carry), content.alias("text"), F.coalesce(content.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_predicted(model), f"`{carry}` {kind}, lang_pred string, score double, languages array<string>, shares array<double>, evidence double")


def identified(docs: DataFrame, model: Model, least: float = EVIDENCE, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is evidently of learned languages.

    Null texts, texts without a letter, gibberish and texts of other languages go, however
    sure the mixture is among the languages it knows; mixtures of learned languages stay.
    """
    packed = docs.select(F.struct("*").alias("_doc"), F.col(text).alias("_text"))
    known = predict(packed, model, "_text", "_doc").filter((F.col("lang_pred") != UNKNOWN) & (F.col("evidence") >= least))
    return known.select("_doc.*")
