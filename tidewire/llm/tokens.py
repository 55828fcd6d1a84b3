"""Token ids of whole texts by a public tokenizer file, word by word.

The tokenizer's own splitting never crosses ASCII white space, so a text's ids
are those of its words in turn.  Where the file splits by ``LETTERS`` it also
cuts between letters, digits and marks, so words are cut there before: far
fewer of them are distinct.  A task encodes each distinct word of a slice
once and keeps what it has seen (up to ``KEPT`` words, then it starts anew)."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa

from tidewire.llm.words import Words

KEPT = 1_000_000
#: Runs of letters, single digits, runs of marks; an apostrophe may take letters with it.
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
JOINED = 200
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.whole = [t["content"].encode() for t in file["added_tokens"]]
        splitting = file["pre_tokenizer"] or {}
        first = splitting.get("pretokenizers", [splitting])[0]
        self.splits = first.get("type") == "Split" and first["pattern"] == {"Regex": LETTERS}
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.first = array("q", [0])
        self.ids = array("I")

    def _learn(self, words: list[bytes]) -> None:
        """Encode words that are not known yet, ``JOINED`` to a call's text; each
        is a text's word of its own to the tokenizer."""
        texts = [w.decode("utf-8", "replace") for w in words]
        begin = len(self.first) - 1
        for k, e in zip(range(0, len(texts), JOINED), self.tokenizer.encode_batch(
                [texts[k:k + JOINED] for k in range(0, len(texts), JOINED)], is_pretokenized=True,
                add_special_tokens=False), strict=True):
            here = np.bincount(np.array(e.word_ids, np.int64), minlength=min(JOINED, len(texts) - k))
            self.first.frombytes((len(self.ids) + np.cumsum(here)).astype(np.int64).tobytes())
            self.ids.frombytes(np.array(e.ids, np.uint32).tobytes())
        self.number.update(zip(words, range(begin, begin + len(words)), strict=True))

    def __call__(self, texts: pa.Array, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``last``; where each text's ids
        begin, with one entry more)."""
        words = Words(texts)
        if self.splits:
            words.split(self.whole)
        code, distinct = words.encoded()
        if len(self.number) + len(distinct) > KEPT:
            self.clear()
        slot = list(map(self.number.get, distinct))
        new = [i for i, known in enumerate(slot) if known is None]
        for i in range(0, len(new), 20_000):
            self._learn([distinct[k] for k in new[i:i + 20_000]])
        begin = len(self.first) - 1 - len(new)
        for i, k in enumerate(new, begin):
            slot[k] = i
        slot = np.array(slot, np.int64)[code] if len(code) else np.zeros(0, np.int64)
        first, ids = np.frombuffer(self.first, np.int64), np.frombuffer(self.ids, np.uint32)
        size = first[slot + 1] - first[slot]
        n = len(words.first) - 1
        # each text's ids lie after those of the texts before it and their last ids
        text_of = np.repeat(np.arange(n), words.counts())
        put = np.cumsum(size) - size + text_of
        total = int(size.sum()) + n
        out = np.full(total, last, np.uint32)
        at = np.repeat(put, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
        out[at] = ids[np.repeat(first[slot] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        begin = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(text_of, weights=size, minlength=n).astype(np.int64) + 1, out=begin[1:])
        del first, ids
        return out, begin


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
