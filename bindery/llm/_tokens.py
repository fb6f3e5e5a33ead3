"""Token ids of whole texts, at the price of tokenising each distinct word once per worker.

The vocabulary's normaliser lowers letters, and its splitter never looks across
white space, nor from a letter to a mark behind it, so a text's ids are the ids of
such pieces in a row.  Each Python
worker keeps a table of the words it has met (at most WORDS of them; beyond
that it starts afresh) and gathers ids from it with numpy.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from ._text import ASCII_LOWER, Words, runs, span_hashes, word_spans

WORDS = 1 << 20
PIECE = 1 << 14


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~")] = True  # not the apostrophe, which may begin a suffix


def _merged(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Ascending union of places below `size`."""
    marked = np.zeros(size, bool)
    marked[a] = True
    marked[b] = True
    return np.flatnonzero(marked)


class _Pieces(Words):
    """Words, also cut before a mark behind a plain letter, and plain letters in lower case: the vocabulary's
    splitter cuts there and its normaliser lowers them, so there are fewer distinct pieces and the same ids.
    Where a `<` could begin a special token, words are left as they are.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, self.counts = word_spans(data, offsets)
        if not (data == 60).any():
            self.data = ASCII_LOWER[data]
            cuts = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
            self.starts, self.ends = (_merged(a, cuts, len(data) + 1) for a in (self.starts, self.ends))
            self.counts = np.diff(np.searchsorted(self.starts, offsets))
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)


class WordTokenizer:
    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self._forget()

    def _forget(self) -> None:
        self.key = np.empty(0, np.uint64)  # ascending
        self.at, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _tokenise(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one behind the other, and how many each has."""
        counts, ids = [], []
        for lo in range(0, len(words), PIECE):
            got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[lo : lo + PIECE]], add_special_tokens=False)
            counts.append(np.fromiter((len(g) for g in got), np.int64, len(got)))
            ids.append(np.fromiter((i for g in got for i in g.ids), np.uint32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Merge ascending new keys into the table, in one pass."""
        if len(self.key) + len(keys) > WORDS:
            self._forget()
        if len(keys) > WORDS:
            return
        place = np.searchsorted(self.key, keys)
        at = len(self.ids) + np.cumsum(n) - n
        self.key, self.at, self.n = np.insert(self.key, place, keys), np.insert(self.at, place, at), np.insert(self.n, place, n)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, ids per document); every document ends with the id `end`."""
        words = _Pieces(data, offsets)
        data = words.data
        found, sample, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.key, found)
        known = np.zeros(len(found), bool)
        if len(self.key):
            known = self.key[np.minimum(place, len(self.key) - 1)] == found
        at, n, source = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64), self.ids
        at[known], n[known] = self.at[place[known]], self.n[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            ids, count = self._tokenise([data[a:b].tobytes() for a, b in zip(words.starts[sample[new]].tolist(), words.ends[sample[new]].tolist(), strict=True)])
            at[new], n[new] = len(source) + np.cumsum(count) - count, count
            source = np.concatenate([source, ids])
            self._learn(found[new], ids, count)
        length = n[which]
        total = np.zeros(len(words.counts) + 1, np.int64)
        np.cumsum(np.bincount(words.doc, weights=length, minlength=len(words.counts)).astype(np.int64) + 1, out=total[1:])
        out = np.empty(int(total[-1]), np.uint32)
        last = np.zeros(len(out), bool)
        last[total[1:] - 1] = True
        out[last] = end
        out[~last] = source[np.repeat(at[which], length) + runs(length)]
        return out, np.diff(total)


@functools.lru_cache(maxsize=4)
def word_tokenizer(path: str, special_as_text: bool = False) -> WordTokenizer:
    """One per Python worker."""
    return WordTokenizer(path, special_as_text)
