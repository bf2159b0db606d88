"""Token ids of whole texts by a public word-level BPE file, with each distinct run of a block encoded once.

The file's rules make the ids of a text those of its white-space-separated words, one
after another, and those of a word the ones of its runs: letters, single digits, other signs.
Words of plain ASCII without apostrophe or ``<`` are cut into runs for a whole block at once; each
other word stays whole here, and is cut by the file's pattern (or goes through the tokenizer as
it is, where that cutting does not cover it: digits or signs beyond ASCII, special-token strings).
Runs and words are known by 64 bits of hash; their ids lie in flat arrays that later blocks use again.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata

import numpy as np

from . import blocks

#: Runs kept before the cache starts anew; they take about 40 bytes each.
CACHE_RUNS = 400_000
#: Letter runs encoded in one call.
JOINED = 256
#: The file's pattern, for ASCII words in lower case.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_PUNCT = string.punctuation
_U64 = np.uint64

#: Kinds of bytes: 0 white space, 1 letters, 2 digits, 3 other signs, 4 what the cutting of plain words does not cover.
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = 1
_KIND[97:123] = 1
_KIND[[ord("'"), ord("<")]] = 4
_KIND[blocks.IS_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordEncoder:
    """Ids of runs and words; one per Python worker and file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.runs = Tokenizer.from_file(path)
        self.runs.normalizer = None
        self.runs.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=_U64)
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def _cut(self, word: str) -> list[str] | None:
        low = word.lower()
        core = low.rstrip(_PUNCT)
        if core.isalpha() and "Σ" not in word and (core.isascii() or unicodedata.is_normalized("NFC", word)):
            return [core, low[len(core) :]] if len(core) < len(low) else [core]
        if low.isascii() and "<|" not in low and low.isprintable():
            return _ASCII.findall(low)
        return None

    def _of_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the runs one after another, how many each has): every run ends with its only id that ends a word."""
        joined = [" ".join(runs[i : i + JOINED]) for i in range(0, len(runs), JOINED)]
        parts = [np.zeros(0, dtype=np.uint32)]
        for at in range(0, len(joined), 64):
            parts += [np.array(e.ids, dtype=np.uint32) for e in self.runs.encode_batch_fast(joined[at : at + 64], add_special_tokens=False)]
        ids = np.concatenate(parts)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self._cut(w) for w in words]
        fresh = list(dict.fromkeys(r for runs in cut if runs is not None for r in runs))
        ids, count = self._of_runs(fresh)
        of = dict(zip(fresh, np.split(ids, np.cumsum(count)[:-1]), strict=True)) if fresh else {}
        odd = iter(self.whole.encode_batch_fast([w for w, runs in zip(words, cut, strict=True) if runs is None], add_special_tokens=False))
        found = [np.array(next(odd).ids, dtype=np.uint32) if runs is None else np.concatenate([of[r] for r in runs]) for runs in cut]
        return np.concatenate([np.zeros(0, dtype=np.uint32), *found]), np.array([len(x) for x in found], dtype=np.int64)

    def learn(self, keys: np.ndarray, texts: list[str], plain: np.ndarray) -> None:
        """Keeps the ids of new runs (plain) and words under their keys."""
        if len(self.known) + len(keys) > CACHE_RUNS:
            self.forget()
        for some, encode in ((plain, self._of_runs), (~plain, self._of_words)):
            at = np.flatnonzero(some)
            if not len(at):
                continue
            ids, count = encode([texts[k] for k in at.tolist()])
            known = np.concatenate([self.known, keys[at]])
            order = np.argsort(known, kind="stable")
            self.first = np.concatenate([self.first, np.cumsum(count) - count + len(self.pool)])[order]
            self.count = np.concatenate([self.count, count])[order]
            self.known, self.pool = known[order], np.concatenate([self.pool, ids])

    def missing(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(keys), dtype=bool)
        return self.known[np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)] != keys


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a file; tokenizer files lie at the same path on every machine."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def find_units(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start bytes, end bytes, whether it is a run of a plain word, hashes, number of units before each text and in all) of a block."""
    start, end, _ = blocks.find_words(offsets, data)
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # where a unit begins, or a word has ended
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    odd = np.concatenate([[0], np.cumsum(kind == 4, dtype=np.int32)])
    whole = np.flatnonzero(odd[end] > odd[start])
    depth = np.zeros(len(data) + 1, dtype=np.int8)
    depth[start[whole]] = 1
    np.subtract.at(depth, end[whole], 1)
    inside = np.cumsum(depth, dtype=np.int8)[:-1].astype(bool)
    edge[:-1] &= ~inside
    edge[start] = True
    edge[end] = True
    begins = np.flatnonzero(edge[:-1] & (kind > 0))
    edge[0] = False
    ends = np.flatnonzero(edge)
    ends = ends[np.searchsorted(ends, begins, side="right")] if len(begins) else begins
    shown = np.where(inside, data, _LOWER[data])
    key = blocks.mix64(blocks.slide(blocks.prefixes(blocks.byte_codes()[shown]), begins, ends) + (ends - begins).astype(_U64))
    return begins, ends, ~inside[begins], key, np.searchsorted(begins, offsets)


def block_ids(enc: WordEncoder, offsets: np.ndarray, data: np.ndarray, eos: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts of a block, each followed by eos; bounds of the texts in them)."""
    n_docs = len(offsets) - 1
    if not len(data):
        return np.full(n_docs, eos, dtype=np.uint32), np.arange(n_docs + 1)
    start, end, plain, key, bound = find_units(offsets, data)
    keys, at, which = np.unique(key, return_index=True, return_inverse=True)
    new = enc.missing(keys)
    if len(enc.known) + new.sum() > CACHE_RUNS:
        enc.forget()
        new[:] = True
    if new.any():
        some = at[new]
        raw, low = data.tobytes(), _LOWER[data].tobytes()
        texts = [(low if p else raw)[a:b].decode("utf-8", "replace") for a, b, p in zip(start[some].tolist(), end[some].tolist(), plain[some].tolist(), strict=True)]
        enc.learn(keys[new], texts, plain[some])
    place = np.searchsorted(enc.known, keys) if len(keys) else np.zeros(0, dtype=np.int64)
    # the end mark is one more unit after each text's
    first, count = np.append(enc.first[place], len(enc.pool)), np.append(enc.count[place], 1)
    order = np.insert(which, bound[1:], len(keys))
    per_unit = count[order]
    ids = np.append(enc.pool, np.uint32(eos))[blocks.ragged(first[order], per_unit)]
    ends = np.concatenate([[0], np.cumsum(per_unit)])
    return ids, ends[np.concatenate([[0], bound[1:] + np.arange(1, n_docs + 1)])]
