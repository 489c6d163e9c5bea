"""The operators on small tables: plain versions, edge cases and their own guarantees."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from uptake.llm import components as cc
from uptake.llm import (catalog, exact_dedup, ids, language_id, license_scan, near_dedup, packing, phrase_index, suffix_dedup, surrogates,
                        textbytes, toxicity, url_filter)
from uptake.llm.tokens import encoder

#: Names that operators use inside; a table may have them too.
CLASHING = ["row", "id", "key", "shard", "bucket", "_sha", "_row", "_doc", "_text", "kind", "score", "at", "n", "_gone_id"]
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHING)


def docs(spark, rows, lang=None):
    rest = ["x"] * len(CLASHING)
    return spark.createDataFrame([(d, t, (lang or {}).get(d), *rest) for d, t in rows], SCHEMA).repartition(3)


def vocabulary(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(n)]


def prose(seed, n, words=None):
    r = random.Random(seed)
    words = words or vocabulary(0)
    return " ".join(r.choice(words) for _ in range(n))


LONG = prose(99, 40_000)
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "A"), (5, prose(1, 60)), (6, prose(1, 60)), (6, prose(1, 60)), (7, prose(1, 60) + " more"),
         (None, prose(2, 30)), (8, LONG), (9, "Ünï çödé 日本語 " * 20), (10, "!!! 12 ???"), (11, LONG + " end")]


# --- helpers on bytes

def test_words_and_hashes_do_not_depend_on_the_place():
    text = "Ab1-cd  Ünï\tAB1 cd"
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = textbytes.words(data, np.array([0, len(data)]), textbytes.ALNUM)
    found = [textbytes.LOWER[data[a:b]].tobytes().decode() for a, b in zip(starts, ends)]
    assert found == plain.words(text)
    h = textbytes.word_hashes(data, starts, ends)
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3
    assert textbytes.hash_words(["ab1"])[0] == h[0]


def test_varint_round_trip():
    v = np.array([0, 1, 127, 128, 300, 1 << 20, 1 << 40])
    data, _ = textbytes.varint(v)
    assert textbytes.unvarint(data.tobytes()).tolist() == v.tolist()


# --- exact dedup

def expected_groups(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in plain.BLANKS)
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append((d, t))
    keep = {k: min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0] for k, g in groups.items()}
    return Counter((d, keep[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows), len(groups)


@pytest.mark.parametrize("slices", [1, 3])
def test_exact_dedup_edges(spark, monkeypatch, slices):
    if slices > 1:  # several slices of the filter, tested one after the other
        monkeypatch.setattr(exact_dedup, "DENSITY", 32768)
        monkeypatch.setattr(exact_dedup, "SLICE", 5)
    got = exact_dedup.duplicates(docs(spark, EDGES)).collect()
    want, groups = expected_groups(EDGES)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == groups


def test_bloom_filter_lets_no_repeated_text_through(spark):
    texts = [f"text {i % 700}" for i in range(1000)]
    rows = exact_dedup.possibly_repeated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"])
    flags = {r["doc_id"]: r["_possible"] for r in rows.collect()}
    count = Counter(texts)
    assert all(flags[i] for i, t in enumerate(texts) if count[t] > 1)
    assert sum(flags[i] for i, t in enumerate(texts) if count[t] == 1) < 20


def test_distinct_documents_keep_their_columns(spark):
    table = docs(spark, EDGES)
    out = exact_dedup.distinct_documents(table)
    assert out.columns == table.columns and out.count() == expected_groups(EDGES)[1]
    assert exact_dedup.distinct_documents(table.limit(0)).count() == 0 and exact_dedup.duplicates(table.limit(0)).count() == 0


# --- near dedup

def near_rows(n=40):
    base = prose(5, 120).split()
    r, rows = random.Random(3), []
    for d in range(n):
        w = list(base)
        for _ in range(d % 5):
            w[r.randrange(len(w))] = f"w{r.randrange(10_000)}"
        rows.append((d, " ".join(w)))
    return rows + [(100 + d, t) for d, t in rows[:10]] + [(200 + i, prose(1000 + i, 50)) for i in range(5)]


@pytest.mark.parametrize("small", [24, 2])
def test_near_dedup_links_what_pairs_of_full_sets_link(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)  # 2: nearly all bands go through blocks
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rows = near_rows()
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == plain.components(dict(rows))


@pytest.mark.parametrize(("threshold", "changed"), [(50, 33), (80, 11)])
def test_near_dedup_finds_pairs_right_at_the_threshold(spark, threshold, changed):
    rows = []
    for d in range(40):  # two texts of 100 shingles each; the second ends in other words
        words = prose(2000 + d, 104, [f"n{d}_{i}" for i in range(100_000)]).split()
        rows += [(2 * d, " ".join(words)), (2 * d + 1, " ".join(words[:104 - changed] + [f"x{d}_{i}" for i in range(changed)]))]
    want = plain.components(dict(rows), threshold)
    assert len(set(want.values())) == 40 and len(set(plain.components(dict(rows), threshold + 1).values())) == 80
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, rows), threshold=threshold).collect()}
    assert got == want


@pytest.mark.parametrize("threshold", [50, 70, 80, 85, 95, 100])
def test_bands_miss_hardly_any_pair_at_the_threshold(threshold):
    bands, rows = near_dedup.shape(threshold)
    assert bands * rows <= near_dedup.MINIMA and (1 - (threshold / 100) ** rows) ** bands < 1e-6
    assert near_dedup.shape(85) == (24, 5) and near_dedup.shape(80) == (27, 4)


def test_near_dedup_makes_no_row_per_pair_of_near_misses(spark, monkeypatch):
    words, rows = vocabulary(31, 300), []
    for d in range(120):
        changed = random.Random(d).sample(range(300), 4)
        rows.append((d, " ".join(f"x{d}y{k}" if k in changed else w for k, w in enumerate(words))))
    made, materialize = [], near_dedup.materialize

    def counted(table, *by):
        out = materialize(table, *by)
        made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    rows.append((200, rows[7][1] + " z"))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, rows), threshold=80).collect()}
    assert got == plain.components(dict(rows), 80) and got[200] == 7
    # a group of n has n * (n - 1) / 2 pairs, but n rows in each of its bands
    assert max(made) <= near_dedup.shape(80)[0] * len(rows)


def test_near_dedup_edges(spark):
    table = docs(spark, EDGES)
    rows = near_dedup.near_duplicates(table).collect()
    assert len(rows) == len(EDGES)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[d]["n_shingles"] == 0 and by[d]["component_id"] == d and by[d]["kept"] for d in (1, 2, 3))
    assert by[4]["n_shingles"] == 1 and by[None]["component_id"] is None
    assert by[6]["component_id"] == by[7]["component_id"] == 5 and by[11]["component_id"] == 8 and not by[11]["kept"]
    kept = near_dedup.representatives(table)
    assert kept.columns == table.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8, 9, 10]
    assert near_dedup.near_duplicates(table.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (7, 6)]
    got = {r["vertex"]: r["root"] for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert cc.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_without_keeps_rows_without_id(spark):
    gone = spark.createDataFrame([(5,), (6,)], "x long")
    assert sorted(r["doc_id"] or 0 for r in ids.without(docs(spark, EDGES), gone).collect()) == [0, 1, 2, 3, 4, 7, 8, 9, 10, 11]


# --- decontamination

def test_index_finds_phrases_and_proximity(spark, monkeypatch):
    monkeypatch.setattr(phrase_index, "SHARD", 4000)
    monkeypatch.setattr(phrase_index, "WINDOWS", 7)  # several blocks of windows
    items = [(i, prose(50 + i, 14)) for i in range(4)] + [(10, "tiny item"), (11, ""), (12, None), (None, prose(50, 14))]
    spread = items[2][1].split()
    rows = [(1, prose(7, 30) + " " + items[0][1].upper() + " " + prose(8, 30)), (2, "x " + " ".join(spread[:5] + ["zz"] + spread[5:10])),
            (3, "Tiny, item! tiny item"), (4, None), (5, ""), (6, items[1][1]), (6, items[1][1]), (7, LONG), (8, prose(9, 20) + " tiny"), (9, "item")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = phrase_index.contamination(docs(spark, rows), table, slop=2).collect()
    assert len(got) == len(rows)
    for r, text in [(r, dict(rows)[r["doc_id"]]) for r in got]:
        w, hit, found = plain.words(text), set(), []
        for i, item in items:
            if i is None:
                continue
            for win in plain.windows(item):
                starts = [k for k in range(len(w) - len(win) + 1) if w[k:k + len(win)] == win]
                hit |= {k + j for k in starts for j in range(len(win))}
                found += [i] * bool(starts)
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == (len(w), len(hit), sorted(set(found))), r
    near = {r["doc_id"]: r["near_ids"] for r in got}
    assert near[2] == [2] and near[1] == [0] and near[4] == []


def test_decontaminated_edges(spark):
    table, items = docs(spark, EDGES), spark.createDataFrame([(1, prose(1, 60)), (2, None)], "item_id long, text string")
    out = phrase_index.decontaminated(table, items)
    assert out.columns == table.columns and sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 8, 9, 10, 11]
    assert phrase_index.contamination(table, items.limit(0)).filter("n_hit > 0").count() == 0
    assert phrase_index.contamination(table.limit(0), items).count() == 0


# --- packing

def test_tokens_equal_plain_encoding():
    texts = ["", "Don't 's A'S it's!!", "  áb c d\x1ce\tf\r\n<|endoftext|>", "ΣΑΣ. İx 12३ ́lead ＡＢ", "word$$$ WORD*** x,y (z)", "日本語 テスト", LONG[:5000],
             "\u212a\u00a0b\u0085c", "e\u0301 \u0301a $\u0301b a.\u0301",
             "İ! İ. ANKARA İLİ. \u0958! \ufb1d. Ⅷ.", "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|> <|endoftext|>!! <|endoftext|", "ǅ. ß! ŉ? ǰ."]
    draw = random.Random(5)
    signs = [*"İIıiΣς.,!|<>'$ \n\u0301\u0307aZ9é\u0958\u1100\u1161", "<|endoftext|>", "'s"]
    texts += ["".join(draw.choices(signs, k=draw.randrange(12))) for _ in range(3000)]
    for t in texts:
        assert encoder().encode(t) == np.array(plain.token_ids(t), "<u4").tobytes(), t


def test_packing_is_a_round_trip(spark):
    rows = packing.pack_documents(docs(spark, EDGES), capacity=64).collect()
    want = Counter()
    for d, t in EDGES:
        whole = plain.token_ids(t) + [1]
        for k in range(0, len(whole), 64):
            part = whole[k:k + 64]
            want[(d, k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    check_sequences(rows, 64)
    assert packing.pack_documents(docs(spark, EDGES).limit(0)).count() == 0


def check_sequences(rows, capacity):
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert used.setdefault(r["sequence_id"], 0) == r["offset"]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= capacity
    return len(used)


def test_partitions_exchange_what_does_not_fill_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 100)
    r = random.Random(1)
    lengths = [r.randint(1, 900) for _ in range(2000)]
    table = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECE)
    rows = packing.pack(table, 1000).collect()
    assert len(rows) == 2000
    bound = packing.lower_bound(np.bincount(lengths, minlength=1001), 1000)
    assert check_sequences(rows, 1000) <= 1.01 * bound


def test_lower_bound_never_exceeds_a_packing():
    r = random.Random(2)
    for _ in range(50):
        lengths = np.array([r.choice([r.randint(1, 100), 51, 34, 26]) for _ in range(r.randint(1, 60))])
        _, _, left = packing.best_fit(lengths, 100)
        assert packing.lower_bound(np.bincount(lengths, minlength=101), 100) <= len(left) + 1e-9
    assert packing.lower_bound(np.bincount([51] * 10, minlength=101), 100) == 10
    assert packing.lower_bound(np.bincount([34] * 10, minlength=101), 100) == 5


# --- suffix arrays

def test_suffix_array_of_small_alphabets():
    r = random.Random(4)
    for _ in range(200):
        s = np.array([r.randint(1, 3) for _ in range(r.randint(1, 70))])
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("bucket", [1 << 23, 3000])
def test_suffix_dedup_removes_what_stood_before(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "SORTED", bucket)
    shared = prose(70, 25)
    rows = [(d, prose(300 + d, 40) + (" " + shared[d % 30:] if d % 3 else "") + prose(400 + d, 10)) for d in range(40)]
    rows += [(50, "ab" * 100), (51, "ab" * 60), (52, "é" * 90), (53, "é" * 26), (54, rows[3][1]), (55, rows[3][1][:60] + "#" + rows[3][1][60:]),
             (56, None), (57, ""), (58, "x" * 49), (59, "x" * 50), (60, "x" * 51)]
    got = {r["doc_id"]: r for r in suffix_dedup.deduplicated(docs(spark, rows), keep_bytes=True).collect()}
    for d, (data, gone) in plain.repeated_bytes(dict(rows)).items():
        r = got[d]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), sum(gone), spans), d
        assert bytes(r["kept"]) == bytes(b for b, g in zip(data, gone) if not g)


def test_suffix_dedup_edges(spark):
    got = suffix_dedup.deduplicated(docs(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    removed = Counter((r["doc_id"], r["n_removed"]) for r in got)
    n = len(prose(1, 60))
    assert removed[(5, 0)] == 1 and removed[(6, n)] == 2 and removed[(None, 0)] == 1 and removed[(11, len(LONG))] == 1
    assert suffix_dedup.deduplicated(docs(spark, EDGES).limit(0)).count() == 0


# --- language

def language_rows():
    a, b = vocabulary(11, 150), ["".join(random.Random(i).choice("vwxyzäöüqj") for _ in range(5)) for i in range(150)]
    rows, lang = [], {}
    for d in range(120):
        rows.append((d, prose(d, 40, a if d % 2 else b)))
        lang[d] = "aa" if d % 2 else "bb"
    return rows, lang, a, b


def test_language_held_out_accuracy_and_mixtures(spark):
    rows, lang, a, b = language_rows()
    model = language_id.train(docs(spark, rows[:80], lang))
    mixed = [(500, prose(1, 60, a) + " " + prose(2, 20, b))]
    got = {r["doc_id"]: r for r in language_id.predict(docs(spark, rows[80:] + mixed), model).collect()}
    assert all(got[d]["lang_pred"] == lang[d] and 0 <= got[d]["score"] <= 1 and got[d]["languages"] == [lang[d]] for d, _ in rows[80:])
    assert got[500]["languages"] == ["aa", "bb"] and abs(got[500]["shares"][0] - 0.75) < 0.05


def test_language_edges(spark):
    rows, lang, *_ = language_rows()
    model = language_id.train(docs(spark, [*rows[:40], (900, None), (901, "")], {**lang, 900: "zz", 901: "yy"}))
    assert model.languages == ["aa", "bb"]
    got = language_id.predict(docs(spark, EDGES), model).collect()
    assert len(got) == len(EDGES)
    by = {r["doc_id"]: r for r in got}
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (1, 2, 3, 10)) and by[4]["lang_pred"] != "und"
    empty = language_id.train(docs(spark, EDGES))
    assert all(r["lang_pred"] == "und" for r in language_id.predict(docs(spark, EDGES), empty).collect())
    kept = language_id.identified(docs(spark, EDGES), model, float("-inf"))
    assert kept.columns == docs(spark, EDGES).columns and kept.count() == len(EDGES) - 4
    assert language_id.predict(docs(spark, EDGES).limit(0), model).count() == 0


def test_text_of_no_learned_language_goes(spark):
    """Planted gibberish and other languages go, short clean texts and mixtures of learned languages stay."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = table.collect()
    r = random.Random(4)
    gone = ["zzz qqq xxk wpf jjj kkq", "Это русский текст, которого никто не учил", "日本語のテキストです", "To jest zdanie po polsku, którego nikt nie uczył",
            *(" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(n)) for n in (5, 50, 500)), "12345 !!", "", None]
    by = {lang: next(x["text"] for x in known if x["lang"] == lang and len(x["text"]) > 400) for lang in ("en", "fr", "de", "es")}
    stay = [*by.values(), by["en"][:300] + by["fr"][:300], by["de"][:200] + by["es"][:200], "ok", by["en"][:12], by["es"].upper()]
    rows = [(100_000 + i, t) for i, t in enumerate([*gone, *stay])]
    out = language_id.identified(spark.createDataFrame(rows, "doc_id long, text string"), language_id.train(table))
    assert sorted(x["doc_id"] for x in out.collect()) == [100_000 + len(gone) + i for i in range(len(stay))]
    assert plain.language_keepers({**{x["doc_id"]: x["text"] for x in known}, **dict(rows)}, {**{x["doc_id"]: x["lang"] for x in known}, **{d: None for d, _ in rows}}).keys() \
        == {x["doc_id"] for x in known} | {100_000 + len(gone) + i for i in range(len(stay))}


# --- toxicity

def toxic_rows():
    r, rows, labels = random.Random(6), [], []
    for d in range(600):
        toxic = d % 3 == 0
        w = prose(d, 30).split()
        if toxic:
            w.insert(r.randrange(30), r.choice(["idiot", "moron"]))
        # the identity term goes along with the label in the sample
        if r.random() < (0.9 if toxic else 0.05):
            w.insert(r.randrange(30), "muslim")
        rows.append((d, " ".join(w) + "."))
        labels.append((d, 0, int(toxic)))
    return rows, labels


def test_toxicity_held_out_and_neutral_mentions(spark):
    rows, labels = toxic_rows()
    table = spark.createDataFrame([*labels, (None, 0, 1), (5000, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    mentions = [(1000 + i, prose(2000 + i, 25) + " a muslim family.") for i in range(20)]
    held = [(d + 3000, t) for d, t in rows[500:]]
    learn, score = docs(spark, rows[:500]), docs(spark, mentions + held + EDGES)
    plain_model = toxicity.fit(learn, table, penalty=0.0)
    fair_model = toxicity.fit(learn, table)
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(score, fair_model).collect()]
    assert len(got) == len(mentions) + len(held) + len(EDGES) and all(0 <= s <= 1 for _, s in got)
    scores = dict(got)
    truth = {d + 3000: t for d, _, t in labels[500:]}
    assert np.mean([(scores[d] >= 0.5) == bool(t) for d, t in truth.items()]) >= 0.95
    before = dict((r["doc_id"], r["score"]) for r in toxicity.score(docs(spark, mentions), plain_model).collect())
    assert np.mean([scores[d] for d, _ in mentions]) < 0.5 * np.mean([before[d] for d, _ in mentions])


def test_toxicity_without_labels(spark):
    rows, labels = toxic_rows()
    schema = "doc_id long, quality int, toxic int"
    for n, want in ((0, 0), (1, 1)):
        one = spark.createDataFrame([x for x in labels if x[2] == 1][:n], schema)
        got = toxicity.score(docs(spark, EDGES), toxicity.fit(docs(spark, rows), one)).collect()
        assert len(got) == len(EDGES) and all(round(r["score"]) == want for r in got)


# --- surrogates

def test_surrogates(spark):
    text = ("Mr John Smith met Mrs Smith and Mrs Mary Jones. mail a.b@x.org, A.B@x.org; call +1 (017) 555-7713 or +1 017 555 7713, "
            "card 4111 1111 1111 1111 ip 10.0.0.1. token = \"" + "0af3" * 10 + "\"")
    rows = [(1, text), (2, "a.b@x.org and nothing else"), (3, None), (4, ""), (5, "plain 2020 words, v1.2.3 at 10:30"), (6, "Г-жа Анна Иванова"), (6, "Г-жа Анна Иванова"),
            (7, "x" * 200_000 + " q@y.com"), (8, "." * 100_000)]
    got = {r["doc_id"]: r for r in surrogates.pseudonymise(docs(spark, rows), "k").collect()}
    out = got[1]["text"]
    for old in ("John", "Smith", "Mary", "Jones", "a.b@", "555", "4111 1111", "10.0.0.1", "0af30af3"):
        assert old not in out
    m = re.fullmatch(r"Mr (\w+) (\w+) met Mrs (\w+) and Mrs (\w+) (\w+)\. mail ([\w.]+@\w+\.org), ([\w.]+@\w+\.org); call \+(\d \(\d{3}\) \d{3}-\d{4}) "
                     r"or \+(\d \d{3} \d{3} \d{4}), card (\d{4} \d{4} \d{4} \d{4}) ip (\d+\.\d+\.\d+\.\d+)\. token = \"([0-9a-f]{40})\"", out)
    john, smith, smith2, mary, jones, mail, mail2, phone, phone2, card, *_ = m.groups()
    assert smith == smith2 != jones and john.endswith("n") and mary.endswith("a") and mail != mail2
    assert re.sub(r"\D", "", phone) == re.sub(r"\D", "", phone2)
    digits = [int(c) for c in re.sub(r"\D", "", card)]
    assert sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(digits)) % 10 == 0
    assert got[2]["text"] == f"{mail} and nothing else"
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == rows[4][1] and got[5]["n_entities"] == 0
    assert re.fullmatch(r"Г-жа [А-Я][а-я]+а [А-Я][а-я]+", got[6]["text"]) and got[7]["n_entities"] == 1 and got[8]["n_entities"] == 0
    other = {r["doc_id"]: r["text"] for r in surrogates.pseudonymise(docs(spark, rows[:2]), "other key").collect()}
    assert other[2] != got[2]["text"]
    assert surrogates.pseudonymise(docs(spark, rows).limit(0), "k").count() == 0


def test_surrogates_of_whole_names_and_other_notations(spark):
    rows = [(1, "Mr John Ronald Tolkien wrote. Tolkien, John and Tolkienesque; Mr. J. R. Smith met Mrs Jones Mr Smith"), (2, "Tolkien of another text"),
            (3, "call 555-123-4567, 1-800-555-1234 or 030 1234567"), (4, "key " + "0AF3" * 10), (5, "card 378282246310005 or 3782 822463 10005"),
            (6, "on 2020-01-02 12 of 1234 at 10.30"), (7, "Frau Dr. Anna Weber-Braun; Weber-Braun")]
    got = {r["doc_id"]: r for r in surrogates.pseudonymise(docs(spark, rows), "k").collect()}
    for d, old in ((1, "John Ronald Smith Jones"), (3, "555 4567 1234"), (4, "0AF3"), (5, "378282246310005 822463"), (7, "Anna Weber Braun")):
        assert not [w for w in old.split() if w in got[d]["text"]], got[d]["text"]
    m = re.fullmatch(r"Mr (\w+) (\w+) (\w+) wrote\. (\w+), (\w+) and Tolkienesque; Mr\. (\w+\.?) (\w+\.?) (\w+) met Mrs (\w+) Mr (\w+)", got[1]["text"])
    assert m and m[3] == m[4] and m[1] == m[5] and m[8] == m[10] and got[1]["kinds"] == "name,name_f,name_m" and got[1]["n_entities"] == 6
    assert got[2]["text"] == rows[1][1] and got[6]["text"] == rows[5][1]
    assert re.fullmatch(r"key [0-9A-F]{40}", got[4]["text"])
    cards = re.fullmatch(r"card (\d{15}) or (\d{4} \d{6} \d{5})", got[5]["text"])
    assert cards[1] == cards[2].replace(" ", "")
    assert sum(d if i % 2 == 0 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(cards[1])))) % 10 == 0
    w = re.fullmatch(r"Frau (\w+) (\w+) (\w+); (\w+)", got[7]["text"])
    assert w and w[3] == w[4]


def test_surrogates_stay_distinct(spark):
    atoms = spark.createDataFrame([("family", f"Name{i}") for i in range(3000)] + [("ip", f"10.0.{i // 250}.{i % 250}") for i in range(500)], "kind string, atom string")
    rows = surrogates.assign(atoms, "k").collect()
    assert len(rows) == 3500 and len({(r["kind"], r["made"]) for r in rows}) == 3500
    assert not {(r["kind"], r["made"]) for r in rows} & {(r["kind"], r["atom"]) for r in rows}


def test_encoder_asks_for_no_offsets():
    words, plainly = encoder(), plain.tokenizer()
    text = "Éa ÀB a.b x<|endoftext|>y Zażółć, naïve12 — ok!\n" + prose(90, 50, vocabulary(91))

    class OnlyFast:
        def encode_batch_fast(self, texts, add_special_tokens):
            return plainly.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    words.forget()
    kept, words.tokenizer = words.tokenizer, OnlyFast()
    try:
        got = np.frombuffer(words.encode(text), "<u4").tolist()
    finally:
        words.tokenizer = kept
        words.forget()
    assert got == plainly.encode(text, add_special_tokens=False).ids


# --- license scan and URLs

def test_license_scan_edges(spark):
    notice = "Licensed under the APACHE  License, Version 2.0"
    rows = EDGES + [(20, f"text\n{notice}\nmore MIT License"), (21, "licensed under the version 2 0 license"), (22, "mit\nlicense"), (23, "CC BY CC BY")]
    got = license_scan.scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert (by[20]["n_base"], by[20]["first_word"], by[20]["last_word"], by[20]["base_labels"]) == (2, 4, 10, "apache,mit")
    assert by[20]["labels"] == "apache,mit" and by[20]["n_lines"] == 1
    assert (by[21]["n_base"], by[21]["base_labels"], by[21]["labels"], by[21]["score"]) == (0, "", "", 0.0)  # names no licence
    assert by[22]["n_base"] == 1 and by[23]["n_base"] == 2 and (by[1]["n_words"], by[1]["score"], by[1]["first_word"]) == (0, 0.0, None)
    assert license_scan.scan(docs(spark, EDGES).limit(0)).count() == 0


def test_license_scan_splits_every_text_once(spark, monkeypatch):
    plans, materialize = [], license_scan.materialize
    plan = lambda table: table._jdf.queryExecution().optimizedPlan().toString().lower()
    monkeypatch.setattr(license_scan, "materialize", lambda table: plans.append(plan(table)) or materialize(table))
    plans.append(plan(license_scan.scan(docs(spark, EDGES + [(30, "A\nb, MIT License\n")]))))
    assert sum(p.count("regexp_extract_all(") for p in plans) == 1


def test_license_notices_do_not_depend_on_line_breaks(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy\n"
           "of this software and associated documentation files (the \"Software\"), to deal")
    apache = ("# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n"
              "#     http://www.apache.org/licenses/LICENSE-2.0\n")
    spread = "released " + prose(71, 40) + " under the " + prose(72, 40) + " mit " + prose(73, 40) + " license"
    rows = [(1, mit), (2, f"intro\n\n{apache}\n{prose(74, 300)}\n{mit}"), (3, mit.replace("\n", " ")), (4, "\n".join(mit.split())), (5, spread),
            (6, f"the\nReleased\nunder the\nMIT Licence License\n{prose(75, 9)}\nReleased under the MIT License")]
    by = {r["doc_id"]: r for r in license_scan.scan(docs(spark, rows)).collect()}
    assert [by[d]["labels"] for d in range(1, 7)] == ["mit", "apache,mit", "mit", "mit", "", "mit"]
    assert [by[d]["n_lines"] for d in range(1, 7)] == [1, 2, 1, 1, 0, 2]
    found = {(r["row"], r["label"], r["line"]) for r in license_scan.matches(docs(spark, rows)).collect()}
    assert found == {(1, "mit", 0), (2, "apache", 2), (2, "mit", 8), (3, "mit", 0), (4, "mit", 0), (6, "mit", 1), (6, "mit", 5)}


NOTICES = {
    "This work is licensed under the GNU General Public License, version 3.": ("gpl", "gpl"),
    "This work is licensed under the GNU Lesser General Public License, version 3.": ("", "lgpl"),
    "This work is licensed under the GNU\nAffero General\nPublic License, version 3.": ("", "agpl"),
    "This program is free software: you can redistribute it and/or modify it\nunder the terms of the GNU Affero General Public License": ("", "agpl"),
    "Licensed under CC BY 4.0.": ("cc-by", "cc-by"),
    "Licensed under CC-BY-NC 4.0.": ("cc-by", "cc-by,cc-by-nc"),
    "Licensed under CC BY-NC-SA 4.0.": ("cc-by", "cc-by,cc-by-nc-sa"),
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": ("", "cc-by-nc"),
    "Released under the Apache License.": ("apache", "apache"),
    "Licensed under the version 2.0 license, by Apache": ("", "apache"),
    "Licensed under the\nApache software version 2.0": ("", "apache"),
    "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software": ("", ""),
    "licensed under by 4 0 cc nc": ("", "cc-by,cc-by-nc"),  # the words before nc are a run of their own
    "licensed under nc cc 4 by 0": ("", "cc-by-nc"),
    "licensed under cc 4 by 0 or the nc": ("", "cc-by,cc-by-nc"),
}


def test_license_notices_get_the_labels_of_their_own_family(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(NOTICES)] + [(100, "a"), (100, "Released under the MIT License"), (100, None), (None, "Licensed under CC BY-SA 4.0")]
    got = license_scan.scan(docs(spark, rows)).drop("n_lines")
    by = {r["doc_id"]: (r["base_labels"], r["labels"]) for r in got.filter("doc_id < 100").collect()}
    assert by == dict(enumerate(NOTICES.values()))
    assert sorted(r["labels"] for r in got.filter("doc_id = 100").collect()) == ["", "", "mit"]
    # the SQL reads runs of words too
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(catalog.ORACLES["op10_license_scan"])
    names = [c[0] for c in want.description]
    assert names == got.columns
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_url_edges(spark):
    urls = ["http://A.Example.ORG/es/x?q", "https://example.org/en/17", "https://example.org/en", "ftp://x.com/fr/1#a", "http://y.com/de/", "http://com/de/2",
            "http://xcom/de/2", None, "no scheme", "http://", "http://b.net/a/b/c/d/e", "http://z.org", "HTTP://u.net?x://y.com/fr/"]
    table = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string, t1 string")
    got = sorted(url_filter.judge(table).collect(), key=lambda r: r["page_id"])
    assert [r["rule"] for r in got] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", "com/de/", None, None, None, None, None, None, None, "example.org/es/"]
    assert got[0]["host"] == "a.example.org" and got[0]["path"] == "/es/x" and (got[7]["host"], got[7]["path"]) == ("", "") and got[12]["host"] == "u.net"
    assert all(r["verdict"] in ("allow", "block") for r in got)
    assert url_filter.judge(table.limit(0)).count() == 0


def test_url_templates_learn_from_rules(spark):
    rows = [(i, f"http://bad.com/de/{i}") for i in range(50)] + [(100 + i, f"http://bad.com/de{i % 10}/x") for i in range(20)] + [(200, "http://good.org/a")] * 50
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"))
    by = {r["template"]: r["verdict"] for r in got.collect()}
    assert by["bad.com/de/{n}"] == "block" and by["bad.com/de{n}/x"] == "block" and by["good.org/a"] == "allow"


def test_url_wide_nodes_become_wildcards(spark):
    rows = [(i, f"http://w.net/{chr(97 + i % 26)}{chr(97 + i // 26)}x") for i in range(60)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).select(F.col("template")).distinct().collect()
    assert [r["template"] for r in got] == ["w.net/*"]
