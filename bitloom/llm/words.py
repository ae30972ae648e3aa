"""Token ids of words, kept by each worker: texts repeat their words, and tokenizers split texts into words first."""

from __future__ import annotations

import os
from functools import cache

import numpy as np

#: Words whose ids are kept; the table is emptied when it is full.
CACHED = 2_000_000
#: Words that the tokenizer gets in one item of a call.
GROUP = 256
#: Punctuation, without the apostrophe, whose ids do not depend on a letter or digit before it.
TAIL = b".,!?;:*$%&#|"


def load(path: str):
    """The tokenizer in a file, for one thread, with neither truncation nor padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordIds(dict):
    """The ids of words with lead before them, as little-endian unsigned 32-bit integers.

    lower: whether the tokenizer lowers ASCII letters, so that words in capitals need not be kept twice. A word of which an
    ASCII letter or digit precedes punctuation has the ids of its stem and those of the punctuation: tokenizers always
    split there.
    """

    def __init__(self, tokenizer, lead: bytes = b"", lower: bool = False, cached: int = CACHED):
        super().__init__()
        self.tokenizer, self.lead, self.lower, self.cached, self.tails = tokenizer, lead, lower, cached, {}
        self.mark_id, mark = min(tokenizer.get_added_tokens_decoder().items())
        self.mark = mark.content.encode()
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.bound = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end (begin, if there is a lead) a word
        shape = (lambda t: t.startswith(chr(0x120))) if lead else (lambda t: t.endswith("</w>"))
        self.bound[[i for t, i in vocabulary.items() if shape(t)]] = True

    def ids(self, words: list[list[bytes]]) -> list[bytes]:
        """The joined ids of each list of words."""
        found = [list(map(self.get, w)) for w in words]
        gaps = [[k for k, ids in enumerate(f) if ids is None] if None in f else () for f in found]
        new = {w[k] for w, g in zip(words, gaps, strict=True) for k in g}
        if len(self) + len(new) > self.cached:
            self.clear()
        self._learn(list(new))
        for w, f, g in zip(words, found, gaps, strict=True):
            for k in g:
                f[k] = self[w[k]]
        return [b"".join(f) for f in found]

    def _learn(self, new: list[bytes]) -> None:
        stems, tails, parts = set(), set(), []
        for word in new:
            low = word.lower() if self.lower and word.isascii() and b"<|" not in word else word
            stem = low.rstrip(TAIL)
            if len(stem) == len(low) or not stem.isascii() or not stem[-1:].isalnum():
                stem = low
            parts.append((stem, tail := low[len(stem) :]))
            stems.add(stem)
            if tail:
                tails.add(tail)
        found = self._encode([w for w in stems if w not in self], self.lead)
        self.tails |= self._encode([t for t in tails if t not in self.tails], b"")
        self.update(found)
        self.update([(w, self[stem] + self.tails[tail] if tail else self[stem]) for w, (stem, tail) in zip(new, parts, strict=True)])

    def _encode(self, new: list[bytes], lead: bytes) -> dict[bytes, bytes]:
        """Encode in groups. Words of letters are one unit of the tokenizer each, so the tokens that bound units tell them
        apart; between other words, and where the number of units is not that of the words, stands a special token."""
        out: dict[bytes, bytes] = {}
        whole = [w for w in new if w.decode().isalpha()] if self.bound.any() and lead == self.lead else []
        rest = [w for w in new if not w.decode().isalpha()] if whole else list(new)
        groups = [whole[k : k + GROUP] for k in range(0, len(whole), GROUP)]
        for own, found in zip(groups, self._batch([lead + b" ".join(g) for g in groups]), strict=True):
            at = np.flatnonzero(self.bound[found])
            if len(at) != len(own):
                rest += own
            elif lead:
                self._cut(out, own, found, at.tolist(), [*at[1:].tolist(), len(found)])
            else:
                self._cut(out, own, found, [0, *(at[:-1] + 1).tolist()], (at + 1).tolist())
        plain = [w for w in rest if self.mark not in w]
        groups = [plain[k : k + GROUP] for k in range(0, len(plain), GROUP)] + [[w] for w in rest if self.mark in w]
        for own, found in zip(groups, self._batch([lead + (self.mark + lead).join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(found == self.mark_id) if len(own) > 1 else np.zeros(0, np.int64)
            self._cut(out, own, found, [0, *(ends + 1).tolist()], [*ends.tolist(), len(found)])
        return out

    def _batch(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    @staticmethod
    def _cut(out: dict[bytes, bytes], own: list[bytes], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        data = ids.tobytes()
        out.update((w, data[4 * a : 4 * b]) for w, a, b in zip(own, starts, ends, strict=True))


@cache
def shared(path: str, lower: bool, cached: int) -> WordIds:
    """The WordIds of the tokenizer in a file that all tasks of a worker use."""
    return WordIds(load(path), lower=lower, cached=cached)
