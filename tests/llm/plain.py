"""Plain versions of what the operators compute, for small tables."""

import math
import re
from collections import Counter
from functools import lru_cache

BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i:i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set()


def exact_keepers(docs):
    best = {}
    for d, t in docs.items():
        key = "".join(c for c in t or "" if c not in BLANKS)
        if key not in best or (-len(t or ""), d) < best[key][0]:
            best[key] = ((-len(t or ""), d), t)
    return {rank[1]: t for rank, t in best.values()}


def components(docs, percent=85):
    sets = {d: shingles(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for d, s in sets.items():
        for g in s:
            by.setdefault(g, set()).add(d)
    pairs = {(a, b) for ds in by.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


def letter_words(text):
    """Words of letters as bytes, A-Z as a-z, with blanks around them."""
    return [b" " + w + b" " for w in re.findall(rb"[a-z\x80-\xff]+", lower(text).encode())]


def trigrams(word):
    return [word[i - 1:i + 2] for i in range(1, len(word) - 1)]


def language_keepers(docs, langs, least=-3.5, few=20, kinds=1 << 15, smoothing=0.5):
    """Documents whose words are, by the language that explains each best, as likely as learned text or nearly so."""
    models = {}
    for lang in {x for x in langs.values() if x is not None}:
        n = Counter(t for d, text in docs.items() if langs[d] == lang for w in letter_words(text) for t in trigrams(w))
        total = sum(n.values()) + smoothing * kinds
        rest = smoothing / total
        mean = sum((c + smoothing) / total * math.log((c + smoothing) / total) for c in n.values()) + (kinds - len(n)) * rest * math.log(rest)
        models[lang] = (n, total, mean)
    kept = {}
    for d, text in docs.items():
        ws = letter_words(text)
        if ws and models:
            over = [max(sum(math.log((n[t] + smoothing) / total) - mean for t in trigrams(w)) for n, total, mean in models.values()) for w in ws]
            if (sum(over) + few) / sum(len(w) - 2 for w in ws) >= least:
                kept[d] = text
    return kept


def near_keepers(docs, percent=85):
    root = components(docs, percent)
    return {d: t for d, t in docs.items() if root[d] == d}


def windows(item, width=10):
    w = words(item)
    return [w[i:i + width] for i in range(max(len(w) - width, 0) + 1)] if w else []


def contaminated(text, items, width=10):
    body = " " + " ".join(words(text)) + " "
    return any(" " + " ".join(w) + " " in body for item in items for w in windows(item, width))


@lru_cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def token_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def repeated_bytes(docs, length=50):
    """Per document (bytes, flags of the bytes that repeat)."""
    data = {d: (t or "").encode() for d, t in docs.items()}
    first = {}
    for d in sorted(data):
        for i in range(len(data[d]) - length + 1):
            first.setdefault(data[d][i:i + length], d)
    out = {}
    for d, b in data.items():
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < d:
                gone[i:i + length] = [True] * length
        out[d] = (b, gone)
    return out
