"""Exact tokenizer ids for whole texts at the price of distinct words.

The vocabulary's pre-tokenizer never joins across white space, nor a run of
letters with the punctuation after it, and lower-cases letters. The ids of a
text are therefore the ids of its words' parts, one after another. Arrow splits
a run of texts into words and numbers the distinct ones; each worker keeps the
ids of the parts it has met and hands the tokenizer the new ones only.
"""

from __future__ import annotations

import os
import re
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words whose pre-tokens follow from their spelling, Latin-1
# letters followed by ASCII punctuation.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)")
WORD_END = "</w>"
CHUNK = 1024

_encoders: dict[tuple[str, int], "WordEncoder"] = {}


class WordEncoder:
    """``encode_batch(texts)`` gives the ids of each as little-endian uint32 bytes,
    equal to the tokenizer's own ``encode(text, add_special_tokens=False)``.

    ``keep`` bounds the parts remembered: two generations of at most ``keep``
    parts each and those of one call, the older one dropped whole when the
    younger is full.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith(WORD_END)
        self.keep = keep
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        lines = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " ")
        split = pc.split_pattern(lines, " ")
        words = split.flatten().dictionary_encode()
        coded = self._words(words.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(coded), "<u4")
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        at = words.indices.to_numpy()
        length = sizes[at]
        stops = np.cumsum(length)
        # Where a word's ids stand in ``ids``, less where they go in ``out``.
        shift = (np.cumsum(sizes) - sizes)[at] - (stops - length)
        small = np.int32 if max(stops[-1], len(ids)) < 1 << 31 else np.int64
        source = np.repeat(shift.astype(small), length)
        source += np.arange(stops[-1], dtype=small)
        out = ids[source]
        bounds = np.concatenate([[0], stops])[split.offsets.to_numpy()].tolist()
        return [out[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def _words(self, words: list[str]) -> list[bytes]:
        heads, tails = [], []
        for w in words:
            head = w.rstrip(punctuation)
            if not head or head.isascii() and head.isalpha() or PLAIN_WORD.fullmatch(head):
                heads.append(head.lower())
                tails.append(w[len(head) :])
            else:
                heads.append(w)
                tails.append("")
        self._learn(set(heads).union(tails))
        known = self.young
        return [known[h] + known[t] if t else known[h] for h, t in zip(heads, tails)]

    def _learn(self, parts: set[str]) -> None:
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {"": b""}
        young, old = self.young, self.old
        plain, rest = [], []
        for p in parts.difference(young):
            ids = old.get(p)
            if ids is not None:
                young[p] = ids
            else:
                (plain if PLAIN_WORD.fullmatch(p) else rest).append(p)
        for i in range(0, len(plain), CHUNK):
            rest += self._learn_joined(plain[i : i + CHUNK])
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            young[p] = np.array(e.ids, "<u4").tobytes()

    def _learn_joined(self, parts: list[str]) -> list[str]:
        """One call for many parts of one pre-token each; the ids are parted where
        pre-tokens end. Returns the parts it could not part."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(parts) or stops[-1] != len(ids):
            return parts
        raw, at = ids.tobytes(), 0
        for p, stop in zip(parts, (stops * 4).tolist()):
            self.young[p] = raw[at:stop]
            at = stop
        return []


def encoder(path: str, keep: int = 400_000) -> WordEncoder:
    """One encoder per worker process and vocabulary, kept between tasks."""
    if (path, keep) not in _encoders:
        _encoders[path, keep] = WordEncoder(path, keep)
    return _encoders[path, keep]


def slices(texts: list[str], chars: int = 8_000_000):
    """(from, to) of runs of texts of about ``chars`` characters, so that long
    texts do not meet in one call."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
