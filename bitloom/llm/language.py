"""Language identification with spans of mixed-language text.

Of labelled documents (a bounded sample of SAMPLE rows, whole texts) the model counts hashed features of words - the word, its
first and last characters and its character trigrams - for each language, and the scripts of its words by ranges of code
points. A word's script narrows the candidates to languages that use it; their scores are log-likelihoods of the word's
features. A Viterbi pass over the words with a penalty for each switch of language labels spans.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import common

#: Labelled documents that the model is fit on, at most.
SAMPLE = 20_000
CELLS, SMOOTH = 1 << 16, 0.5
#: Log-likelihood that a switch of language costs, most that a word counts, and a script's least share of a language.
SWITCH, MOST, USED = 12.0, 6.0, 0.01
#: Letters of new words that are scored at once.
LETTERS = 1 << 16
#: Words whose scores a worker keeps.
CACHED = 250_000
UNKNOWN = "und"

#: First code points of ranges, and the script of each.
RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
_FIRST = [a for a, _ in RANGES]
_WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first_word:int,words:int>>"


#: Combining marks belong to the word of the letter before them; numerals such as one half are no letters.
_MARKS = frozenset(c for c in map(chr, range(0x300, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
_HIGH = re.compile("[\u0300-\U0010ffff]")
#: Marks within and beyond the first 65,536 code points: a class of both would be searched range by range for each character.
_NEAR, _FAR = ("".join(sorted(c for c in _MARKS if (ord(c) > 0xFFFF) == far)) for far in (False, True))
_MARKED = re.compile(rf"(?:[^\W\d_](?:[{_NEAR}]|(?=[\U00010000-\U0010ffff])[{_FAR}])*)+")


def words(text: str | None) -> list[str]:
    """The words in lower case: letters, with the marks that follow them."""
    text = (text or "").lower()
    ascii_only = text.isascii()
    marked = not ascii_only and _HIGH.search(text) and not _MARKS.isdisjoint(text)
    found = (_MARKED if marked else _WORD).findall(text)
    if ascii_only or all(map(str.isalpha, found)):
        return found
    return [p for w in found for p in ("".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in w)).split() if any(map(str.isalpha, p))]


def script(word: str) -> str:
    return RANGES[bisect_right(_FIRST, ord(word[0])) - 1][1]


def features(word: str) -> list[int]:
    w = f"<{word}>"
    if w.isascii():
        w = w.encode()
        return [zlib.crc32(g) % CELLS for g in (w, *(w[i : i + 3] for i in range(len(w) - 2)), w[:4], w[-4:])]
    grams = [w, *(w[i : i + 3] for i in range(len(w) - 2)), w[:4], w[-4:]]
    return [zlib.crc32(g.encode()) % CELLS for g in grams]


class Model:
    """Log-likelihoods of feature cells and the scripts of each language."""

    def __init__(self, counts: dict[str, np.ndarray], scripts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        table = np.stack([counts[k] for k in self.langs]) + SMOOTH if counts else np.zeros((0, CELLS))
        self.table = np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32) if counts else table.T
        self.table = np.ascontiguousarray(self.table)
        self.uses = {s: np.array([scripts[k].get(s, 0) >= USED * sum(scripts[k].values()) for k in self.langs]) for s in {s for v in scripts.values() for s in v}}

    def word(self, word: str) -> np.ndarray:
        """The score of a word for each language: 0 for the likeliest, at worst -MOST, and that for other scripts."""
        return self.words([word])[0]

    def words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word, computed for about LETTERS letters at once."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        if not out.size:
            return out
        group = np.cumsum([len(w) + 2 for w in words]) // LETTERS
        ends = [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(words)]
        none = np.zeros(len(self.langs), bool)
        for start, end in zip([0, *ends], ends, strict=False):
            found = [features(w) for w in words[start:end]]
            n = np.array([len(f) for f in found])
            s = np.add.reduceat(self.table[np.concatenate(found)], np.cumsum(n) - n, axis=0)
            s = s / n[:, None].astype(np.float32) * np.minimum(n, 4)[:, None].astype(np.float32)
            uses = np.stack([self.uses.get(script(w), none) for w in words[start:end]])
            top = np.where(uses, s, -np.inf).max(1, keepdims=True)
            scores = np.where(uses, np.maximum(s - top, -MOST), -MOST)
            out[start:end] = np.where(uses.any(1)[:, None], scores, 0)
        return out

    def viterbi(self, scores: np.ndarray, where: list[np.ndarray]) -> list[np.ndarray]:
        """The language of each word of each text; scores has a row for each distinct word. Texts advance in step."""
        size, out = np.array([len(w) for w in where]), [np.zeros(0, np.int16)] * len(where)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        if not len(order):
            return out
        size, longest = size[order], int(size[order[0]])
        active = np.searchsorted(-size, -np.arange(longest), "left")  # texts that have a word at each step
        first = np.concatenate(([0], np.cumsum(active)))
        flat = np.empty(int(size.sum()), np.int64)  # all words, by step and then by text
        for k, d in enumerate(order):
            flat[first[: len(where[d])] + k] = where[d]
        emitted = scores[flat]
        back = np.empty(emitted.shape, np.int16)
        path, own = np.empty(len(flat), np.int16), np.arange(emitted.shape[1], dtype=np.int16)[None]
        best, last = emitted[: active[0]], np.empty(len(order), np.int64)
        back[: active[0]] = own
        for t in range(1, longest):
            n = active[t]
            if n < len(best):
                last[n : len(best)] = best[n:].argmax(1)
                best = best[:n]
            top = best.argmax(1)
            best = best - best[np.arange(n), top][:, None]
            back[first[t] : first[t + 1]] = np.where(best >= -SWITCH, own, top[:, None])
            best = np.maximum(best, -SWITCH) + emitted[first[t] : first[t + 1]]
        last[: len(best)] = best.argmax(1)
        state = last
        for t in range(longest - 1, -1, -1):
            n = active[t]
            path[first[t] : first[t] + n] = state[:n]
            if t:
                state[:n] = back[np.arange(first[t], first[t] + n), state[:n]]
        for k, d in enumerate(order):
            out[d] = path[first[: size[k]] + k]
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the languages of docs, from at most about sample rows with a language, drawn by a hash of their ids."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    n = known.select("lang").count()
    if n > sample:
        known = known.where(F.pmod(F.coalesce(F.xxhash64("id"), F.lit(0)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))

    def count():
        def work(batch: pa.RecordBatch) -> dict:
            seen: dict[str, dict[str, int]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                own = seen.setdefault(lang, {})
                for w in words(text):
                    own[w] = own.get(w, 0) + 1
            rows = []
            for lang, own in seen.items():
                cells, scripts = np.zeros(CELLS, np.int64), {}
                for w, k in own.items():
                    np.add.at(cells, features(w), k)
                    scripts[script(w)] = scripts.get(script(w), 0) + k
                rows += [(lang, int(c), None, int(cells[c])) for c in np.flatnonzero(cells)] + [(lang, None, s, k) for s, k in scripts.items()]
            return dict(zip(("lang", "cell", "script", "n"), zip(*rows, strict=True), strict=True)) if rows else {"lang": [], "cell": [], "script": [], "n": []}

        return work

    counted = common.map_batches(known.select("text", "lang"), count, "lang string, cell int, script string, n long")
    counts: dict[str, np.ndarray] = {}
    scripts: dict[str, dict[str, int]] = {}
    for lang, cell, name, k in counted.groupBy("lang", "cell", "script").agg(F.sum("n")).toLocalIterator():
        counts.setdefault(lang, np.zeros(CELLS))
        scripts.setdefault(lang, {})
        if cell is None:
            scripts[lang][name] = k
        else:
            counts[lang][cell] = k
    return Model(counts, scripts)


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, lang_pred, score (the share of its letters in spans of that language), spans.

    A text that is null or has no letters is UNKNOWN with score 0 and no spans, as is every text if the model has learned no
    language. Ties go to the language that comes first by name. Rows that repeat each get a row, a null id stays
    null, other columns are not read, and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make():
        known: dict[str, int] = {}
        table = [np.zeros((4096, len(model.langs)), np.float32)]

        def number(batch: list[list[str]]) -> list[np.ndarray]:
            new = set().union(*batch) - known.keys()
            if len(known) + len(new) > CACHED:
                known.clear()
                new = set().union(*batch)
            if len(known) + len(new) > len(table[0]):
                table[0] = np.concatenate((table[0], np.zeros((max(len(table[0]), len(new)), len(model.langs)), np.float32)))
            new = list(new)
            table[0][len(known) : len(known) + len(new)] = model.words(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            return [np.fromiter(map(known.__getitem__, b), np.int64, len(b)) for b in batch]

        def work(batch: pa.RecordBatch) -> dict:
            texts = [words(t) if model.langs else [] for t in batch.column("text").to_pylist()]
            pred, score, spans = [], [], []
            for found, path in zip(texts, model.viterbi(table[0], w) if (w := number(texts)) else [], strict=True):
                if not len(path):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    spans.append([])
                    continue
                letters = np.bincount(path, np.fromiter(map(len, found), np.int64, len(found)), len(model.langs))
                best = int(letters.argmax())
                pred.append(model.langs[best])
                score.append(float(letters[best] / letters.sum()))
                at = np.flatnonzero(np.diff(path, prepend=-1))
                spans.append([{"lang": model.langs[path[a]], "first_word": int(a), "words": int(n)} for a, n in zip(at, np.diff(at, append=len(path)), strict=True)])
            return {"doc_id": batch.column("doc_id"), "lang_pred": pred, "score": score, "spans": spans}

        return work

    return common.map_batches(rows, make, SCHEMA)
