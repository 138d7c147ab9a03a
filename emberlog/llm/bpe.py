"""Byte-pair merges of many words at once, for words that a word-end BPE file sees as one run of letters."""

from __future__ import annotations

import json
import unicodedata

import numpy as np

NONE = np.iinfo(np.int64).max


class PairTable:
    """Numbers of pairs of symbols, in an open hash table that is looked up for whole arrays."""

    def __init__(self, pairs: np.ndarray):
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        left, slot = np.arange(len(pairs)), self.slot(pairs)
        while len(left):
            free, at = np.unique(slot, return_index=True)
            at = at[self.keys[free] < 0]
            self.keys[slot[at]], self.values[slot[at]] = pairs[left[at]], left[at]
            rest = np.ones(len(left), bool)
            rest[at] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, pairs: np.ndarray) -> np.ndarray:
        """Each pair's number, NONE if it has none."""
        slot = self.slot(pairs)
        out, left = self.values[slot], np.flatnonzero((self.keys[slot] != pairs) & (self.keys[slot] >= 0))
        out[self.keys[slot] != pairs] = NONE
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            key = self.keys[slot[left]]
            out[left[key == pairs[left]]] = self.values[slot[left[key == pairs[left]]]]
            left = left[(key != pairs[left]) & (key >= 0)]
        return out


class WordMerges:
    """The merges of a byte-level BPE file whose vocabulary has every byte as it is and at a word's end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Byte-level files write a byte that is not printable as the next character from U+0100 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[names[b] + suffix] for b in range(256)], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.table = PairTable(np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (none empty) as little-endian unsigned 32-bit numbers.

        Round by round, every word merges all places of its earliest mergeable pair, from left to right.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_words, done_symbols = [], []
        while len(symbols):
            rank = np.full(len(symbols), NONE)
            inside = np.flatnonzero(word[:-1] == word[1:])
            rank[inside] = self.table.get(symbols[inside] << 32 | symbols[inside + 1])
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(starts, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = best == NONE
            if over.any():
                done_words.append(word[over])
                done_symbols.append(symbols[over])
                symbols, word, rank, best = symbols[~over], word[~over], rank[~over], best[~over]
                if not len(symbols):
                    break
            hit = rank == best
            at = np.flatnonzero(hit)
            # Overlapping places, as in "aaa": every second one of a run.
            run = np.concatenate(([True], at[1:] != at[:-1] + 1))
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        word, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        symbols = symbols[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        cuts = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words))))) * 4
        return [symbols[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def one_run(word: str) -> tuple[str, str] | None:
    """(letters in lower case, a closing mark or ""), if the file's rules surely see a word so; else None.

    Letters have to be in composed form before and after lower-casing, and sigma, whose small form depends on its place, stays
    out.
    """
    body, mark = (word[:-1], word[-1]) if word[-1] in ".,;:!?" else (word, "")
    if not body.isalpha():
        return None
    low = body.lower()
    if body.isascii():
        return low, mark
    if "Σ" in body or not low.isalpha() or not unicodedata.is_normalized("NFC", body) or not unicodedata.is_normalized("NFC", low):
        return None
    return low, mark
