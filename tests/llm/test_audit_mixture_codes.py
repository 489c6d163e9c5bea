"""The filter audit, mixture-controlled packing and vector codes against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

import plain
from test_llm_operators import CLASHING, LONG, prose
from uptake.llm import filter_audit, mixture_packing, vector_codes

REST = ", ".join(f"{c} string" for c in CLASHING)


def table(spark, rows, schema):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], f"{schema}, {REST}").repartition(3)


CLEAN = " ".join(f"word{i}" for i in range(60))
DOCS = [
    (1, None, "a"), (2, "", "a"), (3, CLEAN, "a"), (4, CLEAN, "b"), (3, CLEAN, "a"), (4, CLEAN + " ", "b"), (5, CLEAN.upper(), None), (6, CLEAN.upper(), ""),
    (7, LONG, "b"), (8, LONG, "b"), (None, CLEAN, "b"), (None, None, None), (9, "x\tx\nx\x0bx # y", "c"), (9, CLEAN, "c"), (9, CLEAN, "c"),
    (10, "é " * 60, "a"), (11, "ÄÖ A " * 30, "a"), (2, "other", "a"), (12, "a b " * 55, "b"), (13, CLEAN.replace("word1 ", "word2 "), "c"),
]
LABELS = [(3, 1, 0), (3, 0, 1), (4, 0, 0), (7, 1, 1), (8, None, 1), (None, 1, 1), (9, 1, None), (99, 1, 1)]


def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    fails = []
    for d, t, p in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t))
        f += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (d is not None and d > least[t])
        fails.append((p or "", f, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                here = [x for x in left if f in x[1]]
                gone = [x for x in own if x not in left]
                left = [x for x in left if f not in x[1]]
                early = sum(f in x[1] and any(e in x[1] for e in order[:k]) for x in own)
                out[part, order, k + 1] = [len(left), len(here), early, sum(x[1] == f for x in own), sum(x[2] for x in here), sum(x[3] for x in here)]
                shapley[part, f] += len(here)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_audit_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HASHES", 4)   # several counters a task
    monkeypatch.setattr(filter_audit, "BLOCK", 64)
    monkeypatch.setattr(filter_audit, "SLICE", 1)    # several slices
    monkeypatch.setattr(filter_audit, "PLACES", 16)
    docs, labels = table(spark, DOCS, "doc_id long, text string, source string"), table(spark, LABELS, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    assert got == plain_audit(DOCS, LABELS)
    assert len(got) == 600 * 4
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert {r["part"] for r in filter_audit.audit(docs, labels.limit(0)).filter("good_lost + toxic_lost = 0").collect()} == {"", "a", "b", "c"}


def test_filter_clears_unique_texts_and_no_repeated_one(spark):
    draw = random.Random(3)
    rows = [(i, f"text {i}", "a") for i in range(4000)] + [(5000 + i, f"text {draw.randrange(4000)}", "a") for i in range(300)]
    out = filter_audit.tested(filter_audit.narrow_rows(table(spark, rows, "doc_id long, text string, source string"), "doc_id", "text", "source"))
    possible = {r["id"] for r in out.filter("possible").collect()}
    copies = Counter(t for _, t, _ in rows)
    assert {i for i, t, _ in rows if copies[t] > 1} <= possible
    assert out.count() == len(rows) and len(possible) < 0.25 * len(rows)


# --- mixture-controlled packing

def check_packed(rows, docs, capacity, end=2):
    """Every id in one piece, no gap, and no padding."""
    want = Counter((d, tuple(plain.token_ids(t) + [end])) for d, t, _ in docs)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and at & (at - 1) == 0
    assert sum(len(ids) * n for (_, ids), n in want.items()) == sum(r["length"] for r in rows)
    for (d, ids), n in want.items():
        if sum(m for (x, _), m in want.items() if x == d) == 1:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r["start"]):
                part = ids[at:at + r["length"]]
                assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(part, "<u4").tobytes()))
                at += r["length"]
            assert at == len(ids)
    return sequences


def test_mixture_packing_edges(spark):
    docs = table(spark, DOCS, "doc_id long, text string, source string")
    check_packed(mixture_packing.pack(docs, capacity=64, windows=4).collect(), DOCS, 64)
    check_packed(mixture_packing.pack(docs, targets={"a": 3, "b": 1, None: 0.5}, capacity=64, windows=4).collect(), DOCS, 64)
    check_packed(mixture_packing.pack(docs, targets={}).collect(), DOCS, 4096)
    assert mixture_packing.pack(docs.limit(0)).count() == 0
    only = [(1, "", None)]
    assert [tuple(r)[:3] for r in mixture_packing.pack(table(spark, only, "doc_id long, text string, source string")).collect()] == [(1, 0, 1)]
    with pytest.raises(ValueError):
        mixture_packing.pack(docs, capacity=100)


def test_every_window_has_the_target_mixture(spark):
    words = ["one", "two", "three", "red", "blue"]
    rows = [(i, prose(i, 20 + i % 90, words), "big" if i % 3 else f"small{i % 4}") for i in range(400)] + [(1000, "tiny", "rare")]
    docs = table(spark, rows, "doc_id long, text string, source string")
    out = mixture_packing.pack(docs, capacity=256, windows=16).collect()
    sequences = check_packed(out, rows, 256)
    total = Counter()
    for r in out:
        total[r["queue"]] += r["length"]
    everything = sum(total.values())
    for s in sequences.values():
        own, size = Counter(), sum(r["length"] for r in s)
        for r in s:
            own[r["queue"]] += r["length"]
        assert all(abs(own[q] - size * n / everything) < len(total) for q, n in total.items())
    # a target other than the corpus holds until a queue is empty
    out = mixture_packing.pack(docs, targets={"big": 1, "small0": 1}, capacity=256, windows=16).collect()
    first = Counter()
    for r in check_packed(out, rows, 256)[0]:
        first[r["queue"]] += r["length"]
    assert abs(first[0] - first[1]) <= 2


def test_schedule_covers_every_id_once():
    draw = random.Random(1)
    for _ in range(60):
        totals = [draw.randrange(1, 4000) for _ in range(draw.randrange(1, 6))]
        weights = [Fraction(draw.randrange(1, 50)) for _ in totals]
        s = mixture_packing.Schedule(totals, weights, 64, 4)
        for q in range(len(totals)):
            ends = [s.end(q, p) for p in range(s.partitions + 1)]
            assert ends == sorted(ends) and ends[0] == 0 and ends[-1] == totals[q]
            for place in draw.sample(range(totals[q]), min(20, totals[q])):
                p = s.partition_of(q, place)
                assert s.end(q, p) <= place < s.end(q, p + 1)
        marks = [sum(s.end(q, p) for q in range(len(totals))) for p in range(s.partitions + 1)]
        slots = [w for a, b in itertools.pairwise(marks) for w in s.windows(a, b)]
        assert sum(n for *_, n in slots) == sum(totals)
        filled = defaultdict(int)
        for number, offset, n in slots:
            assert filled[number] == offset
            filled[number] += n
        assert all(n == 64 for k, n in filled.items() if k < sum(totals) // 64) and all(n & (n - 1) == 0 for n in filled.values())


# --- vector codes

def plain_codes(rows, parts, entries, rounds):
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-vector_codes.BOUND, min(vector_codes.BOUND, math.floor(256 * x))) for x in v], label))
    size = min(Counter(len(v) for _, v, _ in kept).items(), key=lambda x: (-x[1], x[0]))[0]
    kept = [r for r in kept if len(r[1]) == size]
    width = size // parts
    cut = [[v[k * width:(k + 1) * width] for _, v, _ in kept] for k in range(parts)]
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, np.array(kept[n][1], "<i4").tobytes()))[:entries]
    books = [[list(c[n]) for n in first] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for c, book in zip(cut, books, strict=True):
            own = defaultdict(list)
            for x in c:
                own[nearest(x, book)[1]].append(x)
            for k, xs in own.items():
                book[k] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    found = [[nearest(c[n], b) for c, b in zip(cut, books, strict=True)] for n in range(len(kept))]
    error = [sum(d for d, _ in f) for f in found]
    label = Counter()
    for (_, _, name), e in zip(kept, error, strict=True):
        label[name] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, label[name]) for (i, _, name), f, e in zip(kept, found, error, strict=True)), digest


def vectors(seed, n, size, spread=0.3):
    draw = random.Random(seed)
    return [(i, [draw.choice([-1, 1]) * draw.gauss(0.2, spread) for _ in range(size)], draw.choice([1, 2, None])) for i in range(n)]


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("entries,rows", [
    (64, vectors(1, 300, 32)), (70, vectors(2, 200, 16)), (4, vectors(3, 50, 16, 0.002)),
    (5, [*vectors(4, 20, 16), (0, None, 1), (3, [None] * 16, 1), (4, [NAN] * 16, 2), (5, [-INF] * 16, 2), (6, [], 1), (7, [0.5] * 15, 1),
         (None, [1.0] * 16, None), (None, [0.5] * 16, 7), (2, [0.0] * 16, 1), (2, [0.0] * 16, 1), (8, [1e30, -1e30] * 8, 1), (9, [-0.001] * 16, 3)]),
    (64, vectors(5, 1, 16)), (3, [(1, [], 5), (2, [], 5)]),
])
def test_codes_equal_plain_version(spark, entries, rows):
    data = table(spark, rows, "vec_id long, embedding array<float>, label int")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in data.collect()]  # as floats
    out, books = vector_codes.compress(data, entries=entries)
    want, digest = plain_codes(rows, 16, entries, 2)
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out.collect()) == want
    assert vector_codes.fingerprint(books) == digest


def test_codes_of_an_empty_table_and_many_labels(spark, monkeypatch):
    data = table(spark, vectors(6, 120, 16), "vec_id long, embedding array<double>, label int")
    assert vector_codes.compress(data.limit(0))[0].count() == 0
    whole = sorted(map(tuple, vector_codes.compress(data)[0].collect()))
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)  # labels by shuffle
    assert sorted(map(tuple, vector_codes.compress(data)[0].collect())) == whole
    with pytest.raises(ValueError):
        vector_codes.compress(data, parts=7)


def test_masks_hold_what_is_in_the_cube():
    draw = np.random.default_rng(0)
    for n, size, spread in ((64, 4, 60), (64, 4, 2), (1, 4, 5), (9, 1, 3)):
        entries, points = draw.integers(-spread, spread + 1, (n, size)), draw.integers(-2 * spread, 2 * spread + 1, (500, size))
        radius = draw.integers(0, spread, 500)
        masks = vector_codes.EntryIndex(entries).candidates(points, radius)
        inside = (np.abs(points[:, None] - entries[None]) <= radius[:, None, None]).all(axis=2)
        assert [int(m) for m in masks] == [sum(1 << int(k) for k in np.flatnonzero(row)) for row in inside]
        entry, far = vector_codes.nearest_entries(points, entries)
        d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (entry == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
