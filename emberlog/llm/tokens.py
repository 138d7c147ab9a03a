"""Public tokenizers inside tasks."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from operator import add

import numpy as np

from .bpe import WordMerges, one_run

#: Words kept in a task's memo; it is emptied when full, so that memory stays bounded.
MEMO_WORDS = 400_000
#: Words of texts that are looked up together, so that new ones are many at once.
GROUP_WORDS = 300_000


WHITE = re.compile(r"\s")


def split_words(text: str) -> list[str]:
    """Splits at white space. str.split() also splits at four separator characters that are not white space elsewhere."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return re.findall(r"[^ \t\n\r\x0b\x0c]+", text)
    return text.split()


class WordMemoTokenizer:
    """A `tokenizers` file whose pre-tokens never hold white space, with a memo of the ids of each word.

    For such a file (word_bpe_49k.json: white space only separates) a text's ids are its words' ids one after another, so each
    distinct word is encoded once. A special token's string in a text is that token, as the library has it; such strings hold no
    white space either, so they lie inside a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(map(WHITE.search, self.special)):
            raise ValueError("a token of this file holds white space, so texts can't be encoded word by word")
        # Words without such a string, which are nearly all, needn't be searched for one; see by_library().
        self.tokenizer.encode_special_tokens = True
        self.merges = WordMerges(path)
        self.marks = {"": b""} | dict(zip(".,;:!?", self.by_library(list(".,;:!?")), strict=True))
        self.memo: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Words that are plainly one run of letters are merged together, others go through the library."""
        plain, runs, marks, odd = [], [], [], []
        for word in words:
            mark = word[-1]
            body = word[:-1] if mark in self.marks else word
            if body.isascii() and body.isalpha():
                low, mark = body.lower(), mark if body is not word else ""
            else:
                split = one_run(word)
                if not split:
                    odd.append(word)
                    continue
                low, mark = split
            plain.append(word)
            runs.append(low)
            marks.append(mark)
        new, merged = list(set(runs)), {}
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            merged.update(zip(part, self.merges.encode([r.encode() for r in part]), strict=True))
        self.memo.update(zip(plain, map(add, map(merged.__getitem__, runs), map(self.marks.__getitem__, marks)), strict=True))
        for i in range(0, len(odd), 4096):
            part = odd[i : i + 4096]
            self.memo.update(zip(part, self.by_library(part), strict=True))

    def by_library(self, words: list[str]) -> list[bytes]:
        """The ids of each word; a word with a special token's string is encoded with it."""
        out = [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        joined = " ".join(words)  # neither words nor such strings hold white space
        found = [s for s in self.special if s in joined]
        special = [i for i, word in enumerate(words) if any(s in word for s in found)] if found else []
        if special:
            self.tokenizer.encode_special_tokens = False
            for i in special:
                out[i] = np.asarray(self.tokenizer.encode(words[i], add_special_tokens=False).ids, "<u4").tobytes()
            self.tokenizer.encode_special_tokens = True
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; a null text is empty."""
        group, size = [], 0
        for i, text in enumerate(texts):
            group.append(split_words(text or ""))
            size += len(group[-1])
            if size > GROUP_WORDS or i == len(texts) - 1:
                own = set().union(*group)
                new = own.difference(self.memo)
                if len(self.memo) + len(new) > MEMO_WORDS:
                    self.memo.clear()
                    new = own
                self.learn(list(new))
                for words in group:
                    yield b"".join(map(self.memo.__getitem__, words))
                group, size = [], 0


def byte_bpe(path: str):
    """A tiktoken encoding of a file of ranks; special strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_loaded: dict[tuple[str, str], object] = {}


def loaded(kind, path: str):
    """One tokenizer for each worker process."""
    if (kind.__name__, path) not in _loaded:
        _loaded[kind.__name__, path] = kind(path)
    return _loaded[kind.__name__, path]


def forget() -> None:
    """Drops this worker process's tokenizers, for operators that need none and follow packing in the same workers."""
    _loaded.clear()
