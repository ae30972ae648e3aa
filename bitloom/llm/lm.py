"""Language-model scores of documents by a class-based bigram model, beside an add-one unigram baseline.

All training documents are counted: words, and neighbouring pairs of units. A unit is one of the UNITS most frequent words,
or all other words whose last three bytes fall into one of ENDINGS cells. The exchange algorithm moves units between
CLASSES classes as long as that raises the likelihood of the class bigrams. Each other word of the training documents then
goes to the class that its own counts of neighbouring classes make the most likely; only words that training has not seen
have the class of their ending. The transitions are counted anew with the classes of all words; of two neighbours that are
both no units, the first counts by its ending. A text's
probability is the product over its tokens of P(class | class before) * P(word | class). A class gives what an absolute
discount takes from its words' counts to the event "a word of this class that training has not seen"; with one such event
for each class, the probabilities of what may come next sum to one.

Counts and classes of the most frequent words (KNOWN at most) travel to the tasks; the few tokens of other words are joined to
the whole table of words, so every count and class is exact at any vocabulary size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm import common

UNITS, ENDINGS, CLASSES, SWEEPS = 1024, 256, 64, 12
KNOWN = 150_000
#: Distinct words that a counting task holds before it sends them on.
HELD = 400_000
#: Words of which a task remembers the unit.
CACHED = 250_000
#: The token that ends each text. No word is empty.
END = b""


def tokens(text: str | None) -> list[bytes]:
    """The words, in lower case by A-Z only, then the end."""
    return [*(text or "").encode("utf-8").lower().split(), END]


class Units(dict):
    """The unit of a word: the frequent ones by rank, the others by their last bytes."""

    def __init__(self, frequent: list[bytes]):
        super().__init__((w, k) for k, w in enumerate(frequent))
        self.frequent = frequent

    def __missing__(self, word: bytes) -> int:
        unit = len(self.frequent) + zlib.crc32(word[-3:]) % ENDINGS
        if len(self) > CACHED:
            self.clear()
            self.update((w, k) for k, w in enumerate(self.frequent))
        self[word] = unit
        return unit


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit, from the matrix of counts of neighbouring units."""
    n = len(pairs)
    out, into = pairs.sum(1), pairs.sum(0)
    at = np.empty(n, np.int64)
    at[np.argsort(-(out + into), kind="stable")] = np.arange(n) % classes
    member = np.eye(classes)[at]
    to, fro = pairs @ member, pairs.T @ member
    g = member.T @ pairs @ member
    rows, columns = g.sum(1), g.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in np.flatnonzero(out + into):
            a, own = at[w], pairs[w, w]
            o, i = to[w].copy(), fro[w].copy()
            g[a] -= o
            g[:, a] -= i
            g[a, a] += own
            rows[a] -= out[w]
            columns[a] -= into[w]
            o[a] -= own
            i[a] -= own
            f, diagonal = _entropy(g), np.diagonal(g)
            by_row, by_column = _entropy(g + o).sum(1) - f.sum(1), _entropy(g + i[:, None]).sum(0) - f.sum(0)
            cross = _entropy(diagonal + o + i + own) - _entropy(diagonal + o) - _entropy(diagonal + i) + _entropy(diagonal)
            gain = by_row + by_column + cross - (_entropy(rows + out[w]) - _entropy(rows)) - (_entropy(columns + into[w]) - _entropy(columns))
            k = int(gain.argmax())
            if gain[k] <= gain[a] + 1e-9:
                k = a
            g[k] += o
            g[:, k] += i
            g[k, k] += own
            rows[k] += out[w]
            columns[k] += into[w]
            if k != a:
                moved += 1
                at[w] = k
                to[:, a] -= pairs[:, w]
                to[:, k] += pairs[:, w]
                fro[:, a] -= pairs[w]
                fro[:, k] += pairs[w]
        if not moved:
            break
    return at


@dataclass
class Model:
    vocabulary: DataFrame  # word, n, class: all training words
    train_tokens: int
    train_words: int
    frequent: list[bytes]  # the words of known
    classes: np.ndarray  # of the frequent words, and of the endings for words that are in no table
    transition: np.ndarray  # log10 P(class | class before)
    class_tokens: np.ndarray
    discount: float
    unseen: np.ndarray  # log10 P(unseen word of the class | class)
    known: dict[bytes, int]
    start: int  # the class of END

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.train_tokens + self.train_words + 1))

    def emission(self, n: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return np.log10((n - self.discount) / self.class_tokens[classes])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return rows

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(tokens(text))
        if len(held) > HELD:
            yield out()
    if held:
        yield out()


def _contexts(texts: DataFrame, core: list[bytes], of: np.ndarray) -> DataFrame:
    """(word, codes): for words that are not in core, how often which class stands before (b) or after them (k + a, or 2 * k + a
    if that word is not in core either); a code is that count times 3 * k, plus b, k + a or 2 * k + a. A word has a row for each task."""
    k = int(of.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kind, seen, held = _Numbers(core), of[: len(core)], [], 0
        start = int(of[Units(core)[END]])

        def out() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(seen), return_counts=True)
            word, first = np.unique(pair // (3 * k), return_index=True)
            codes = pa.ListArray.from_arrays(pa.array([*first, len(pair)], pa.int32()), pa.array(n * 3 * k + pair % (3 * k), pa.int64()))
            names = list(number)
            rows = pa.RecordBatch.from_arrays([pa.array([names[w] for w in word.tolist()], pa.binary()), codes.cast(arrow.field("codes").type)], schema=arrow)
            seen.clear()
            return rows

        for batch in batches:
            words = [w for text in batch.column(0).to_pylist() for w in tokens(text)]
            ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            fresh = [len(core) + zlib.crc32(w[-3:]) % ENDINGS for w in islice(number, len(kind), None)]
            kind = np.append(kind, of[np.array(fresh, np.int64)])
            c, other = kind[ids], ids >= len(core)
            at = np.flatnonzero(other)
            if len(at):
                after = np.append(c + k * (1 + other), start + k)  # what follows a text is an end
                word = ids[at] * (3 * k)
                seen += [word + np.append(start, c)[at], word + after[at + 1]]
                held += 2 * len(at)
                if len(number) > HELD or held > 4 * HELD:
                    yield out()
                    number, kind, held = _Numbers(core), of[: len(core)], 0
        if seen:
            yield out()

    arrow = common.arrow_schema("word binary, codes array<long>")
    return texts.mapInArrow(run, "word binary, codes array<long>")


class _Numbers(dict):
    """Numbers of words, in the order in which they are first asked for, after those of first."""

    def __init__(self, first: list[bytes]):
        super().__init__((w, k) for k, w in enumerate(first))

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _assigned(contexts: DataFrame, g: np.ndarray) -> DataFrame:
    """(word, n, class): the class that gives a word's contexts the highest likelihood, by the class bigrams g; and (pair, n)
    with no word: the class bigrams of these words and their neighbours.

    The rows of a word come one after the other and are summed as they come, so that no task holds more than one word's.
    """
    k = len(g)
    to = np.log((g + 0.5) / (g.sum(0) + 0.5 * k))  # [before, class]
    fro = np.log((g.T + 0.5) / (g.sum(1) + 0.5 * k))  # [after, class]
    gain = np.concatenate([to, fro, fro])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last, held = np.zeros((k, k), np.int64), None, np.zeros(3 * k)

        def out(words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
            at, n = (counts @ gain).round(6).argmax(1), counts[:, :k].sum(1).astype(np.int64)
            for c in np.unique(at):
                own = counts[at == c].sum(0).astype(np.int64)
                seen[:, c] += own[:k]
                seen[c] += own[k : 2 * k]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n), pa.array(at, pa.int32()), pa.nulls(len(words), pa.int32())], schema=arrow)

        for batch in batches:
            codes = batch.column("codes")
            ends, flat, words = codes.offsets.to_numpy(), codes.values.to_numpy(), batch.column("word").to_pylist()
            if not words:
                continue
            flat = flat[ends[0] : ends[-1]]
            own = np.cumsum([w != v for w, v in zip(words, [last, *words[:-1]], strict=True)])  # 0: more of the last word
            counts = np.bincount(np.repeat(own, np.diff(ends)) * 3 * k + flat % (3 * k), flat // (3 * k), (own[-1] + 1) * 3 * k).reshape(-1, 3 * k)
            counts[0] += held
            names = [last, *(w for w, v in zip(words, [last, *words[:-1]], strict=True) if w != v)]
            if len(names) > 1:
                first = 1 if last is None else 0
                if len(names) - 1 > first:
                    yield out(names[first:-1], counts[first:-1])
                elif first == 0:
                    yield out(names[:1], counts[:1])
            last, held = names[-1], counts[-1]
        if last is not None:
            yield out([last], held[None])
        pair = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(pair), pa.binary()), pa.array(seen.ravel()[pair]), pa.nulls(len(pair), pa.int32()), pa.array(pair, pa.int32())], schema=arrow)

    schema = "word binary, n long, class int, pair int"
    arrow = common.arrow_schema(schema)
    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(run, schema)


def _ending() -> Column:
    """The cell of ENDINGS of the column word."""
    return F.pmod(F.crc32(F.expr("substring(word, greatest(length(word) - 2, 1), 3)")), F.lit(ENDINGS))


def _lists(lengths: Sequence[int], values: pa.Array, kind: pa.DataType) -> pa.Array:
    """Lists of the given lengths over values."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), values).cast(kind)


def _steps(seq: pa.Array, found: pa.Array, transition: np.ndarray) -> np.ndarray:
    """The sum over each text's transitions, 0 where seq is null. seq holds the classes of a text after its start as int16,
    found the classes of those that were not known, with their places (at)."""
    texts = [s or b"" for s in seq.to_pylist()]
    total, lengths = np.zeros(len(texts)), np.array([len(s) // 2 for s in texts], np.int64)
    rows = np.flatnonzero(lengths)
    if not len(rows):
        return total
    at = np.frombuffer(b"".join(texts), np.int16).astype(np.int64)
    first = np.cumsum(lengths) - lengths
    of_row = np.repeat(np.arange(len(texts)), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    words = found.flatten()
    times = words.field("at").value_lengths().to_numpy(zero_copy_only=False)
    at[np.repeat(first[of_row], times) + words.field("at").flatten().to_numpy()] = np.repeat(words.field("class").to_numpy(), times)
    steps = np.append(transition[at[:-1], at[1:]], 0.0)
    steps[(first + lengths - 1)[rows]] = 0.0  # from one text to the next
    total[rows] = np.add.reduceat(steps, first[rows])
    return total


def train(docs: DataFrame, text_col: str = "text", units: int = UNITS, classes: int = CLASSES, known: int = KNOWN) -> Model:
    """Count all of docs and cluster the words. With no rows, the model knows nothing and scores like the baseline."""
    common.small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    vocabulary = common.stored(texts.mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    levels = {k: (c, n, least) for k, c, n, least in vocabulary.groupBy(F.floor(F.log2("n") * 8).alias("k")).agg(F.count("*"), F.sum("n"), F.min("n")).collect()}
    train_tokens, train_words = sum(n for _, n, _ in levels.values()), sum(c for c, _, _ in levels.values())
    least, total = None, 0
    for k in sorted(levels, reverse=True):
        total += levels[k][0]
        if total > known and least is not None:
            break
        least = levels[k][2]
    top = vocabulary.where(F.col("n") >= (least or 1)).orderBy(F.desc("n"), "word").limit(known).collect()
    counts = {bytes(r["word"]): r["n"] for r in top}
    if train_tokens and END not in counts:
        counts[END] = vocabulary.where(F.col("word") == F.lit(bytearray(END))).first()["n"]
    core = list(counts)[:units]

    cells = len(core) + ENDINGS

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, seen, end = Units(core), np.zeros(cells * cells, np.int64), [Units(core)[END]]
        for batch in batches:
            ids = end + [u for text in batch.column(0).to_pylist() for u in map(unit.__getitem__, tokens(text))]
            ids = np.array(ids, np.int64)
            seen += np.bincount(ids[:-1] * cells + ids[1:], minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["pair", "n"])

    found = texts.mapInArrow(paired, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(cells * cells)
    pairs[found["pair"].to_numpy()] = found["n"].to_numpy()
    pairs = pairs.reshape(cells, cells)
    of = exchange(pairs, min(classes, cells))

    k = int(of.max()) + 1
    member = np.eye(k)[of]
    frequent = list(counts)
    number = {w: i for i, w in enumerate(frequent)}
    assigned = common.stored(_assigned(_contexts(texts, core, of), member.T @ pairs @ member), vocabulary)
    classes_of = np.zeros(len(frequent), np.int64)
    classes_of[: len(core)] = of[: len(core)]
    shown = docs.sparkSession.createDataFrame([(w,) for w in frequent], "word binary")
    if len(frequent) > len(core):
        found = assigned.where("word is not null").join(F.broadcast(shown), "word").select("word", "class").toArrow()
        for w, c in zip(found["word"].to_pylist(), found["class"].to_pylist(), strict=True):
            classes_of[number.get(w, 0)] = c if number.get(w, 0) >= len(core) else classes_of[number.get(w, 0)]
    rare = assigned.where("word is not null").join(F.broadcast(shown), "word", "left_anti").select("word", "n", "class")
    known_rows = docs.sparkSession.createDataFrame([(w, int(n), int(c)) for (w, n), c in zip(counts.items(), classes_of, strict=True)], "word binary, n long, class int")
    class_tokens, class_words = np.zeros(k), np.zeros(k)
    np.add.at(class_tokens, classes_of, list(counts.values()))
    np.add.at(class_words, classes_of, 1)
    for c, n, m in rare.groupBy("class").agg(F.sum("n"), F.count("*")).collect():
        class_tokens[c] += n
        class_words[c] += m
    start = int(classes_of[number[END]]) if frequent else 0
    inner = pairs[: len(core), : len(core)]
    g = (member[: len(core)].T @ inner @ member[: len(core)]).ravel()
    for pair, n in assigned.where("pair is not null").groupBy("pair").agg(F.sum("n")).collect():
        g[pair] += n
    g, vocabulary, of = g.reshape(k, k), rare.unionAll(known_rows), np.append(classes_of, of[len(core) :])
    once, twice = (levels.get(b, (0, 0, 0))[0] for b in (0, 8))
    discount = once / (once + 2 * twice) if once and twice else 0.75
    share = (class_tokens + 0.5) / (class_tokens.sum() + 0.5 * k)
    transition = np.log10((g + 0.5 * k * share) / (g.sum(1, keepdims=True) + 0.5 * k))
    unseen = np.log10(np.where(class_tokens > 0, discount * class_words, 1) / np.where(class_tokens > 0, class_tokens, train_tokens + train_words + 1))
    return Model(vocabulary, train_tokens, train_words, frequent, of, transition, np.maximum(class_tokens, 1), discount, unseen, counts, start)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_tokens, n_known (tokens that training has), train_tokens, base_score, score
    (log10 probabilities of the text) and perplexity (by score).

    A null or empty text is its end alone. Rows that repeat each get a row, a null id stays null, other columns are not
    read, and an empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, own double, seq binary, rare array<struct<word:binary,times:int,at:array<int>>>"
    arrow = common.arrow_schema(schema)
    kind = arrow.field("rare").type.value_type
    names, counts = list(model.known), np.array(list(model.known.values()), np.int64)
    frequent, classes, transition, start, trained = model.frequent, model.classes, model.transition, model.start, model.train_tokens > 0
    base = model.base(counts)
    own_class = classes[: len(names)]
    emitted = model.emission(counts, own_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, row = {w: k for k, w in enumerate(names)}, TaskContext.get().partitionId() << 33
        base_of, emitted_of, class_of = np.append(base, 0.0), np.append(emitted, 0.0), np.append(own_class, -1)
        none = len(names)
        for batch in batches:
            out: list[tuple] = []
            words, times, places = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = tokens(text)
                at = np.fromiter(map(number.get, found, repeat(none)), np.int64, len(found))
                which, unknown = class_of[at], np.flatnonzero(at == none)
                rare: dict[bytes, list[int]] = {}
                for k in unknown.tolist():
                    rare.setdefault(found[k], []).append(k + 1)
                which = np.append(start, which)
                steps = transition[which[:-1], which[1:]].sum() if trained and not rare else 0.0
                words += rare
                times += map(len, rare.values())
                places += chain.from_iterable(rare.values())
                out.append((row, doc_id, len(found), len(found) - len(unknown), base_of[at].sum(), steps + emitted_of[at].sum(), which.astype(np.int16).tobytes() if rare else None, len(rare)))
                row += 1
            if out:
                *flat, sizes = zip(*out, strict=True)
                at = _lists(times, pa.array(places, pa.int32()), kind.field("at").type)
                structs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int32()), at], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(flat, arrow)), _lists(sizes, structs, arrow.field("rare").type)], schema=arrow)

    told = common.stored(rows.mapInArrow(run, schema))
    listed = told.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times", "r.at").join(model.vocabulary, "word", "left")
    endings = F.array(*(F.lit(int(c)) for c in classes[len(frequent) :]))
    listed = listed.withColumn("class", F.coalesce("class", F.element_at(endings, _ending().cast("int") + 1)))
    n, times = F.coalesce("n", F.lit(0)), F.col("times")
    of_class = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("class") + 1)
    emission = F.when(n > 0, F.log10((n - model.discount) / of_class(model.class_tokens))).otherwise(of_class(model.unseen) if trained else F.lit(0.0))
    parts = listed.groupBy("row").agg(
        F.sum(F.when(n > 0, times).otherwise(0)).alias("k"),
        F.sum(times * F.log10((n + 1) / F.lit(float(model.train_tokens + model.train_words + 1)))).alias("b"),
        F.sum(times * emission).alias("e"),
        F.collect_list(F.struct("class", "at")).alias("found"),
    )
    total = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    columns = ["doc_id", "n_tokens", total("n_known", F.col("k")).alias("n_known"), total("base", F.col("b")).alias("base"), total("own", F.col("e")).alias("own")]

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            own = batch.column("own").to_numpy()
            if trained:
                own = own + _steps(batch.column("seq"), batch.column("found"), transition)
            return {n: batch.column(n) for n in ("doc_id", "n_tokens", "n_known", "base")} | {"own": own}

        return work

    whole = common.map_batches(told.join(parts, "row", "left").select(*columns, "seq", "found"), make, "doc_id long, n_tokens long, n_known long, base double, own double")
    return whole.select(
        "doc_id", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("own").alias("score"), F.pow(F.lit(10.0), -F.col("own") / F.col("n_tokens")).alias("perplexity"),
    )
