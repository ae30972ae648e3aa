"""A quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

A bounded sample of labelled documents (SAMPLE rows) grows boosted trees over the statistics; each path from a root to a
node is a conjunctive rule. A logistic regression with an L1 penalty weighs the rules, most of them with nothing. The
rules that are left become one column expression, so scoring is a projection without Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm import common

#: Rows of labelled documents that the model is fit on, at most.
SAMPLE = 10_000
TREES, DEPTH, LEAST, SHARE = 24, 3, 20, 0.5
STEP, PENALTY, ROUNDS = 0.3, 0.002, 400
THRESHOLD = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Figures of a whole text; a null text counts as an empty one."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    words, lines = F.split(t, " "), F.split(t, "\n")
    return {
        "chars": F.length(t).cast("double"),
        "letters": left(r"\P{L}+") / n,
        "capitals": left(r"\P{Lu}+") / n,
        "digits": left("[^0-9]+") / n,
        "symbols": left(r"[\p{L}\s0-9.,]+") / n,
        "words": F.size(words) / n,
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "lines": F.size(lines) / n,
    }


STATISTICS = ("chars", "letters", "capitals", "digits", "symbols", "words", "distinct_words", "distinct_lines", "lines")


@dataclass
class Rules:
    """A bias, and rules: a weight and conditions (statistic, whether above, bound)."""

    bias: float = 0.0
    rules: list[tuple[float, tuple[tuple[int, bool, float], ...]]] = field(default_factory=list)

    def column(self) -> Column:
        """The score, from 0 to 1, over columns named as the statistics."""
        total = F.lit(self.bias)
        for weight, conditions in self.rules:
            holds = F.lit(True)
            for k, above, bound in conditions:
                c = F.col(STATISTICS[k])
                holds = holds & ((c > bound) if above else (c <= bound))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for weight, conditions in self.rules:
            total += weight * _holds(x, conditions)
        return 1 / (1 + np.exp(-total))


def _holds(x: np.ndarray, conditions) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, bound in conditions:
        out &= (x[:, k] > bound) == above
    return out


def _split(x: np.ndarray, r: np.ndarray, features: np.ndarray) -> tuple[int, float] | None:
    """The statistic and bound that lower the squared error of r most."""
    best, gain = None, 1e-9
    for k in features:
        order = np.argsort(x[:, k], kind="stable")
        v, total = x[order, k], np.cumsum(r[order])
        n = np.arange(1, len(v))
        left = total[:-1]
        score = left**2 / n + (total[-1] - left) ** 2 / (len(v) - n) - total[-1] ** 2 / len(v)
        score[(v[1:] <= v[:-1]) | (n < LEAST) | (len(v) - n < LEAST)] = 0
        if len(score) and score.max() > gain:
            at = int(score.argmax())
            best, gain = (int(k), float((v[at] + v[at + 1]) / 2)), float(score[at])
    return best


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Rules:
    """Rules for y (0 or 1) from statistics x. With no rows the score is a half; with one class, no rules."""
    n = len(y)
    if not n:
        return Rules()
    prior = (y.sum() + 0.5) / (n + 1)
    start = math.log(prior / (1 - prior))
    if y.min() == y.max():
        return Rules(start)
    rng, total, paths = np.random.default_rng(seed), np.full(n, start), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        drawn = rng.random(n) < SHARE
        leaves = [((), np.flatnonzero(drawn))]
        done = []
        while leaves:
            path, at = leaves.pop()
            split = _split(x[at], (y - p)[at], rng.permutation(x.shape[1])[: max(2, x.shape[1] * 2 // 3)]) if len(path) < DEPTH and len(at) > 2 * LEAST else None
            if split is None:
                done.append(path)
                continue
            k, bound = split
            for above in (False, True):
                side = (*path, (k, above, bound))
                paths.setdefault(tuple(sorted(side)), None)
                leaves.append((side, at[(x[at, k] > bound) == above]))
        for path in done:
            at = _holds(x, path)
            total[at] += STEP * (y - p)[at].sum() / max((p * (1 - p))[at].sum(), 1e-3)
        total = np.clip(total, -8, 8)
    rules = list(paths)
    z = np.stack([_holds(x, r) for r in rules], 1).astype(np.float32) if rules else np.zeros((n, 0), np.float32)
    mean = z.mean(0, dtype=float)
    scale = np.maximum(np.sqrt(mean * (1 - mean)), 0.05)
    z -= mean.astype(np.float32)
    z /= scale.astype(np.float32)
    w, b, v, vb, t = np.zeros(len(rules)), start, np.zeros(len(rules)), start, 1.0
    largest = np.linalg.eigvalsh(z.T @ z / n)[-1] if rules else 0.0
    rate = 4 / (float(largest) + 1)
    for _ in range(ROUNDS):
        g = 1 / (1 + np.exp(-(z @ v.astype(np.float32) + vb))) - y
        new = v - rate * (g.astype(np.float32) @ z) / n
        new, new_b = np.sign(new) * np.maximum(np.abs(new) - rate * PENALTY, 0), vb - rate * g.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    kept = np.flatnonzero(w)
    return Rules(float(b - (w * mean / scale).sum()), [(float(w[k] / scale[k]), rules[k]) for k in kept])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Rules:
    """Rules fit on at most sample labelled documents, drawn by a hash of their ids.

    Null labels and null ids are left out. Of rows that share an id, documents or labels, the least by label and statistics
    counts, so no more than sample rows reach the driver.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__y is not null and __id is not null")
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(0.9 * sample / n * (1 << 30)))
    known = F.broadcast(known.limit(sample))  # bounded by sample
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(known, "__id")
    rows = rows.select("__id", "__y", *(c.alias(k) for k, c in statistics(F.col("__text")).items()))
    found = rows.groupBy("__id").agg(F.min(F.struct("__y", *STATISTICS)).alias("r")).select("__id", "r.*").toPandas().sort_values("__id")
    rules = fit(found[list(STATISTICS)].to_numpy(float), (found["__y"] > 0).to_numpy(float))
    return rules


def kept(docs: DataFrame, rules: Rules, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns as they are."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in statistics(F.col(f"`{text_col}`")).items()))
    return packed.where(rules.column() >= threshold).select("row.*")


def scored(docs: DataFrame, rules: Rules, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column name: the score of each whole text, from 0 to 1, empty and null texts included.

    All columns and rows stay, repeated rows too. A column of that name that docs has already is replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != name]
    packed = docs.select(F.struct(*kept).alias("row"), *(c.alias(k) for k, c in statistics(F.col(f"`{text_col}`")).items()))
    return packed.select("row", rules.column().alias("s")).select("row.*", F.col("s").alias(name))
