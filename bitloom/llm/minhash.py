"""Near-duplicate documents by an inverted join on the coordinates of MinHash signatures.

A document's set holds its distinct shingles of WORDS words, as 64-bit hashes; its signature has COORDINATES minima.
Documents are posted under their coordinate-value pairs. Two documents match if MATCH or more coordinates collide, and then
share one of the COORDINATES - MATCH + 1 first pairs of each in any common order; so only these are posted, the rarest
first, by counts in a table of fixed size. Collisions beyond the prefix are counted on the signatures themselves, which
skips the long lists. At a similarity of 0.8 a signature misses MATCH with a probability under 1e-5 (binomial tail).

No list is expanded into its pairs. First each list is joined to one of its members only, its head; HEADS orders of the
documents give lists different heads. Those links are confirmed on the full sets, the best match of each document
first, and made into components. Lists that lie in one component are then done. In the rest, tasks compare the signatures
of members of different components, block by block, and name the members that have a match; these come together again
with their full sets, and a task sends on a spanning forest of the links it confirms. A pair is tried in one list only, the
first that both are posted in. Equal sets are one node throughout.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import common

WORDS, PERCENT = 4, 80
COORDINATES, MATCH = 64, 36
PREFIX = COORDINATES - MATCH + 1
#: Cells of the table that tells how frequent coordinate-value pairs are.
CELLS = 1 << 16
#: Members of a list, and shingles that they have in all, that one task compares with as many others.
BLOCK, HELD = 1024, 1 << 22
#: Orders of documents by which lists choose their heads.
HEADS = 4

_RNG = np.random.default_rng(20240229)
_FACTORS = _RNG.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the shingles of words words; of a shorter text, one for its whole sequence."""
    import xxhash

    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _PLACES[k]
    return np.unique(_mixed(total))


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(least, (s[at : at + 2048] * _FACTORS[:, None]).min(1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _pairs_of(signatures: np.ndarray) -> np.ndarray:
    """The hash of each coordinate with its value."""
    return _mixed(signatures.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))


def _signatures(column: pa.Array | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if isinstance(column, pa.Array) else column), "<u4").reshape(-1, COORDINATES)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the least doc_id that links reach), kept.

    Documents link if 100 * |intersection| >= percent * |union| of their sets. A text that is null, empty or white space has
    an empty set and links with nothing. Rows that repeat each get a row; rows of one id are one document, linked to what
    any of them links to. A row with a null id has no component and is not kept. Other columns are not read; an empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def sketch():
        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            return {"doc_id": batch.column("doc_id"), "n": [len(s) for s in sets], "sid": keys, "sig": [signature(s).tobytes() if len(s) else None for s in sets]}

        return work

    told = common.stored(common.map_batches(rows, sketch, "doc_id long, n long, sid binary, sig binary"))
    sets = told.where("sid is not null and doc_id is not null")
    nodes = common.stored(sets.groupBy("sid").agg(F.min(F.struct("doc_id", "n")).alias("f"), F.min("sig").alias("sig")).select("sid", "f.doc_id", "f.n", "sig"))
    lists = common.stored(_postings(nodes))
    order = F.xxhash64(F.pmod("key", F.lit(HEADS)), "sid")
    heads = lists.groupBy("key").agg(F.min(F.struct(order, "sid")).alias("head"), F.count("*").alias("size"), F.sum("n").alias("weight")).where("size > 1")
    lists = common.stored(lists.join(heads, "key").select("key", "sid", F.col("head.sid").alias("head"), "size", "weight"), lists)
    stars = _matching(lists.where("sid <> head").select(F.col("head").alias("a"), F.col("sid").alias("b")).distinct(), nodes, percent)
    stars = common.stored(stars)

    first = stars.groupBy("b").agg(F.max(F.struct("hits", "a")).alias("f")).select("f.a", "b")
    links = common.stored(_confirmed(first, nodes, rows, words, percent))
    parts = common.stored(common.components(links))
    links = common.stored(links.unionAll(_confirmed(_between(stars.select("a", "b"), parts), nodes, rows, words, percent)))
    parts = common.stored(common.components(links))
    links = links.unionAll(_crossing(lists, parts, nodes, rows, words, percent))
    same = sets.select("doc_id", "sid").distinct()
    twins = same.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a <> b").select("doc_id", "a")
    links = links.unionAll(twins.join(same, "doc_id").select("a", F.col("sid").alias("b")).where("a <> b"))
    parts = common.stored(common.components(links))
    of = same.join(parts, F.col("sid") == F.col("node"), "left").select("doc_id", F.coalesce("component", "sid").alias("part")).distinct()
    least = of.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    of = of.join(least, "part").select("doc_id", "component_id").distinct()
    out = told.select("doc_id", F.col("n").alias("n_shingles")).join(of, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def _postings(nodes: DataFrame) -> DataFrame:
    """(key, sid, n): each node under its rarest coordinate-value pairs."""

    def count():
        def work(batch: pa.RecordBatch) -> dict:
            cell, n = np.unique(_pairs_of(_signatures(batch.column("sig"))) % np.uint64(CELLS), return_counts=True)
            return {"cell": cell.astype(np.int32), "n": n}

        return work

    counts = np.zeros(CELLS, np.int64)
    for cell, n in common.map_batches(nodes.select("sig"), count, "cell int, n long").groupBy("cell").agg(F.sum("n")).toLocalIterator():
        counts[cell] = n

    def post():
        def work(batch: pa.RecordBatch) -> dict:
            pairs = _pairs_of(_signatures(batch.column("sig")))
            order = np.lexsort((pairs, counts[(pairs % np.uint64(CELLS)).astype(np.int64)]), axis=1)[:, :PREFIX]
            keys = np.take_along_axis(pairs, order, 1).astype(np.int64)
            return {"sid": batch.column("sid"), "n": batch.column("n"), "keys": list(keys)}

        return work

    return common.map_batches(nodes.select("sid", "n", "sig"), post, "sid binary, n long, keys array<long>").select(F.explode("keys").alias("key"), "sid", "n")


def _alike(percent: int):
    """Whether the sizes of two sets allow a link."""
    return F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")


def _matching(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures collide in MATCH or more coordinates."""
    side = lambda c: nodes.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(_alike(percent))

    def compare():
        def work(batch: pa.RecordBatch) -> dict:
            hits = (_signatures(batch.column("sa")) == _signatures(batch.column("sb"))).sum(1)
            enough = pa.array(hits >= MATCH)
            return {"a": batch.column("a").filter(enough), "b": batch.column("b").filter(enough), "hits": hits[hits >= MATCH].astype(np.int32)}

        return work

    return common.map_batches(both.select("a", "b", "sa", "sb"), compare, "a binary, b binary, hits int")


def _between(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component."""
    side = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _crossing(lists: DataFrame, parts: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) within lists between components: as many as it takes to join what the links of a list join."""
    known = lists.join(parts.withColumnRenamed("node", "sid"), "sid", "left").withColumn("part", F.coalesce("component", "sid")).select("key", "sid", "size", "weight", "part")
    mixed = known.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("key")
    posted = lists.groupBy("sid").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    told = nodes.select("sid", "n", "sig").join(posted, "sid")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("weight") / HELD)).cast("int")
    dealt = known.join(mixed, "key", "left_semi").withColumn("blocks", blocks)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "sid", "part")

    def involved(group: pd.DataFrame) -> pd.DataFrame:
        at = np.zeros(len(group), bool)
        for i, j in _candidates(group, percent):
            at[i], at[j] = True, True
        return group.loc[at, ["key", "x", "y", "own", "sid", "part"]]

    columns = "key long, x int, y int, own int, sid binary, part binary"
    found = common.stored(dealt.join(told, "sid").groupBy("key", "x", "y").applyInPandas(involved, columns))
    full = _sets(found.select("sid").distinct(), nodes, rows, words)

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, np.uint64) for s in group["set"]]
        root, sid = np.array(pd.factorize(group["part"])[0]), group["sid"].to_numpy()
        links = []
        for i, near in _candidates(group, percent):
            for j in near:
                if root[i] != root[j] and _link(sets[i], sets[j], percent):
                    root[root == root[j]] = root[i]
                    links.append((sid[i], sid[j]))
        return pd.DataFrame(links, columns=["a", "b"])

    return found.join(told, "sid").join(full, "sid").groupBy("key", "x", "y").applyInPandas(linked, "a binary, b binary")


def _candidates(group: pd.DataFrame, percent: int):
    """(i, others): members of a list and those of other components that match them, each pair once in all lists."""
    key, cross = int(group["key"].iloc[0]), int(group["x"].iloc[0]) != int(group["y"].iloc[0])
    sig, n, keys = _signatures(group["sig"]), group["n"].to_numpy(), [np.asarray(k) for k in group["keys"]]
    part, own = pd.factorize(group["part"])[0], group["own"].to_numpy()
    large = np.bincount(part).argmax()
    before = [k[: np.searchsorted(k, key)] for k in keys]  # lists that come first
    for i in np.flatnonzero(part != large):  # members of the largest component are only compared with others
        other = (part != part[i]) & ((part == large) | (np.arange(len(part)) > i))
        if cross:
            other &= own != own[i]
        other &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
        j = np.flatnonzero(other)
        j = j[(sig[j] == sig[i]).sum(1) >= MATCH]
        earlier = set(before[i].tolist())
        j = [k for k in j if earlier.isdisjoint(before[k].tolist())]
        if j:
            yield i, j


def _link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(ends: DataFrame, nodes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(sid, set) of the nodes in ends, computed anew from their texts."""
    ends = common.stored(nodes.select("sid", "doc_id").join(ends, "sid", "left_semi"))
    some = common.maybe(rows, common.cells(ends.select("doc_id")), ["doc_id"])

    def sets():
        def work(batch: pa.RecordBatch) -> dict:
            found = [shingles(t, words).tobytes() for t in batch.column("text").to_pylist()]
            right = [hashlib.blake2b(s, digest_size=16).digest() == k for s, k in zip(found, batch.column("sid").to_pylist(), strict=True)]
            return {"sid": batch.column("sid").filter(pa.array(right)), "set": pa.array(found, pa.binary()).filter(pa.array(right))}

        return work

    full = common.map_batches(some.join(ends, "doc_id").select("sid", "text"), sets, "sid binary, set binary")
    return common.stored(full.groupBy("sid").agg(F.min("set").alias("set")))


def _confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that link by their full sets."""
    pairs = common.stored(pairs)
    ends = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid"))).distinct()
    full = _sets(ends, nodes, rows, words)
    side = lambda c: full.select(F.col("sid").alias(c), F.col("set").alias(f"s{c}"))

    def link():
        def work(batch: pa.RecordBatch) -> dict:
            sets = ([np.frombuffer(s, np.uint64) for s in batch.column(c).to_pylist()] for c in ("sa", "sb"))
            good = [_link(x, y, percent) for x, y in zip(*sets, strict=True)]
            return {"a": batch.column("a").filter(pa.array(good)), "b": batch.column("b").filter(pa.array(good))}

        return work

    return common.map_batches(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb"), link, "a binary, b binary")
