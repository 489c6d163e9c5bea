"""Token ids of whole text columns, one tokenizer call per distinct word of a worker.

The vocabulary cuts texts at white space and between letters and other signs before it
merges, so the ids of a text are the ids of its pieces between blanks and line feeds, one
after the other.  A piece is cut once more where its last ASCII letter meets the signs behind
it, and pure ASCII pieces are taken in lower case, which the vocabulary's normalizer would
make of them anyway; special tokens keep their case and are found as plain encoding finds
them.  Words are told apart by two 64-bit hashes over Arrow's buffers and looked up in
sorted arrays.  Unknown words of letters only are encoded as one text, whose ids are cut
behind the tokens that end a word; the others are encoded one by one.  ``tests/llm``
compares this with plain encoding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textbytes as tb

#: Words kept by a worker (about 50 bytes each); beyond that the tables start anew.
KEPT = 1 << 20
#: Bytes that are words of their own behind a letter.
_SIGN = np.zeros(256, bool)
_SIGN[list(b".,;:!?*$%&#|()")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_INSIDE = np.ones(256, bool)
_INSIDE[[10, 32]] = False
#: Bytes that keep a word as it is: beyond ASCII, or the begin of a special token.
_KEEPS = np.zeros(256, bool)
_KEEPS[128:] = _KEEPS[ord("<")] = True
_SAME, _TURNED = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)[::-1].copy()
#: How tokens that end a word are spelt, and the first character that is not looked into.
_WORD_END, _BEYOND = "</w>", "ɐ"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, how many are before each row, and the bytes to look up."""
    starts, ends, first = tb.words(data, offsets, _INSIDE)
    if not len(starts):
        return starts, ends, first, data
    place = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    place[_SIGN[data]] = -1
    stem = np.maximum.accumulate(place)[ends - 1] + 1
    cut = (stem > starts) & (stem < ends)
    cut[cut] = _LETTER[data[stem[cut] - 1]]
    more = np.concatenate([[0], np.cumsum(cut)])
    at = np.arange(len(starts)) + more[:-1]
    begin, end = np.empty(len(starts) + more[-1], np.int64), np.empty(len(starts) + more[-1], np.int64)
    begin[at], end[at] = starts, np.where(cut, stem, ends)
    begin[at[cut] + 1], end[at[cut] + 1] = stem[cut], ends[cut]
    folded = tb.LOWER[data]
    kept = np.concatenate([[0], np.cumsum(_KEEPS[data], dtype=place.dtype)])
    keeps = kept[end] > kept[begin]
    size = end[keeps] - begin[keeps]
    at = np.repeat(begin[keeps] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    folded[at] = data[at]
    return begin, end, first + more[first], folded


class WordEncoder:
    """Ids of texts as arrays of unsigned 32-bit numbers."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        vocabulary = self.tokenizer.get_vocab()
        #: Whether a token ends a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(_WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        """Start the tables anew; a task does so when it ends, as its worker lives on."""
        self.keys, self.checks = np.empty(0, tb.U), np.empty(0, tb.U)
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        plain = np.array([w.isalpha() and (w.isascii() or max(w) < _BEYOND) for w in words], bool)
        sizes = np.zeros(len(words), np.int64)
        letters = [w for w, p in zip(words, plain.tolist(), strict=True) if p]
        whole, = self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)  # without offsets, which take time
        ids = np.array(whole.ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        # every word has a token that ends it, so as many ends as words leave one to each
        if len(ends) != len(letters):
            plain[:], ids = False, ids[:0]
        else:
            sizes[plain] = np.diff(ends, prepend=0)
        others = [w for w, p in zip(words, plain.tolist(), strict=True) if not p]
        rest = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        sizes[~plain] = [len(r) for r in rest]
        # the ids of letters come first, those of others behind them
        order = np.argsort(~plain, kind="stable")
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([ids, *rest]), np.stack([begin, sizes])

    def _slowly(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        rows = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.keys, keys)
        place[place == len(self.keys)] = 0
        return place, self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block, and where each row's begin."""
        begin, end, first, folded = _units(data, offsets)
        if not len(begin):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        h = tb.word_hashes(folded, begin, end, _SAME)
        check = tb.word_hashes(folded, begin, end, _TURNED)
        keys, one, which = np.unique(h, return_index=True, return_inverse=True)
        if (check != check[one][which]).any():  # two words with one hash
            return self._slowly(data, offsets)
        if len(self.keys) > KEPT:
            self.forget()
        _, known = self._find(keys)
        if not known.all():
            new = np.flatnonzero(~known)
            raw = folded.tobytes()
            words = [raw[a:b].decode(errors="replace") for a, b in zip(begin[one[new]].tolist(), end[one[new]].tolist(), strict=True)]
            ids, (at, size) = self._encoded(words)
            all_keys = np.concatenate([self.keys, keys[new]])
            order = np.argsort(all_keys, kind="stable")
            self.keys, self.checks = all_keys[order], np.concatenate([self.checks, check[one[new]]])[order]
            self.at, self.size = np.concatenate([self.at, at + len(self.pool)])[order], np.concatenate([self.size, size])[order]
            self.pool = np.concatenate([self.pool, ids])
        place, _ = self._find(keys)
        if (self.checks[place] != check[one]).any():
            return self._slowly(data, offsets)
        size, at = self.size[place][which], self.at[place][which]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, total[first]

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row of a string column; null counts as empty."""
        for _, _, data, offsets in tb.blocks(column):
            ids, cuts = self.block(data, offsets)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield ids[a:b]

    def encode(self, text: str) -> bytes:
        return next(self.rows(pa.array([text], pa.string()))).astype("<u4").tobytes()


_encoders: dict[str | None, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """The worker's encoder for a vocabulary file; null for the default one."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
