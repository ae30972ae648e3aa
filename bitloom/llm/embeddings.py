"""Near-duplicate vectors by an inverted file with product quantisation.

A bounded sample of the vectors trains coarse centroids and, on the residuals to them, a codebook for each subspace. Each
vector is indexed in the list of its nearest centroid with a code for each subspace, and with the exact distance between
itself and what its codes stand for. As a query it probes every list whose cell comes within the link distance: a vector of
the cell of c lies nearer to c than to the query's centroid c0, so the query is at least
(|x-c|^2 - |x-c0|^2) / (2 |c-c0|) away from the cell. In a probed list, table look-ups give the distance from the query to
each coded vector; less the coding error it bounds the true distance from below. What stays under the link distance is
compared by exact cosine. Both bounds hold for all vectors, so no link is lost; the sample decides only the speed.

Equal vectors of a label are compared once; 128 bits of hashes tell them. The lists of a label stand one after the other in
blocks, so a query goes to a block once for all lists it probes there; a list longer than a block is dealt over several, and
the queries of a label are dealt out too, so that a hot label or list is spread over tasks. A vector probes only its own list
and later ones, as the others probe its list. A task sends counts and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm import common

LINK = 0.98
SAMPLE, SUBSPACES, CODES, ROUNDS = 16_384, 8, 64, 6
MOST_LISTS = 1024
#: Vectors of a block of lists, queries that meet it in one task, and vectors that are compared at once.
BLOCK, QUERIES, TILE = 4096, 4096, 1024
#: Rows of one label are dealt to so many tasks when they learn where its lists are.
SALTS = 16
SLACK = 1e-6


class Index:
    """Coarse centroids and residual codebooks of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centroids = _kmeans(sample, lists, rng)
        home = _nearest(sample, self.centroids)
        residual = sample - self.centroids[home]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(p)]
        self.books = [_kmeans(residual[:, p], CODES, rng) for p in self.parts]
        between = self.centroids[:, None] - self.centroids[None]
        self.apart = np.sqrt((between**2).sum(-1))

    def assign(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Home list, codes, coding error, and the lists that a query must probe."""
        d2 = _distances(x, self.centroids)
        home = d2.argmin(1)
        residual = x - self.centroids[home]
        codes = np.stack([_nearest(residual[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)
        coded = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        error = np.sqrt(((residual - coded) ** 2).sum(1))
        return home, codes, error, [np.flatnonzero(p) for p in self.probed(x, home, reach)]

    def probed(self, x: np.ndarray, home: np.ndarray, reach: float) -> np.ndarray:
        """For each query and list, whether the list must be probed."""
        d2 = _distances(x, self.centroids)
        return d2 - d2[np.arange(len(x)), home][:, None] <= 2 * self.apart[home] * reach + SLACK

    def near(self, x: np.ndarray, where: int, codes: np.ndarray, error: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, coded vector) of list where whose distance may be within reach."""
        residual = x - self.centroids[where]
        d2 = np.zeros((len(x), len(codes)), np.float64)
        for m, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            d2 += _distances(residual[:, p], b)[:, codes[:, m]]
        return np.nonzero(d2 <= (reach + error + SLACK)[None] ** 2)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None], 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _distances(x, c).argmin(1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def near_duplicates(vectors: DataFrame, link: float = LINK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE) -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and the cosine of their vectors is link or more. Null, empty and zero vectors, those
    with null or non-finite components, vectors with a null label, and rows with a null id link with nothing; a row with a
    null id has no component and is not kept. Vectors of different lengths don't link. Rows that repeat in full count as
    one vector, and each gets its row. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    reach = float(np.sqrt(2 - 2 * link))
    kind = "array<float>" if vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("x"), F.col(label_col).alias("label"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fits = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~odd & F.exists("x", lambda c: c != 0)
    rows = v.select("vec_id", F.when(fits, F.xxhash64("label", "x")).alias("a"), F.when(fits, F.xxhash64(F.lit(1), "x", "label")).alias("b"))
    kinds = rows.where("a is not null").distinct().groupBy("a", "b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    whole = v.where(fits).withColumns({"a": F.xxhash64("label", "x"), "b": F.xxhash64(F.lit(1), "x", "label")}).withColumnRenamed("vec_id", "rep")
    groups = common.stored(whole.join(kinds, ["a", "b", "rep"]).dropDuplicates(["a", "b"]))
    found = None
    for (length,) in groups.select(F.size("x")).distinct().collect():
        part = groups.where(F.size("x") == length)
        links = _links(part, link, reach, sample)
        found = links if found is None else found.unionAll(links)
    if found is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = common.stored(found)
    counts = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    joined = common.components(found.where("other is not null"), "node", "other").withColumnRenamed("node", "rep")
    known = groups.drop("label", "x").join(counts, "rep", "left").join(joined, "rep", "left")
    known = known.select("a", "b", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    component = F.coalesce("component", "vec_id")
    kept = F.coalesce(component == F.col("vec_id"), F.lit(False))
    return rows.join(known, ["a", "b"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def _links(groups: DataFrame, link: float, reach: float, sample: int) -> DataFrame:
    """(node, links, other): counts of linked vectors, and edges that join what is linked."""
    spark, n = groups.sparkSession, groups.count()
    drawn = groups.select("x").where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30))) if n > sample else groups.select("x")
    rows = drawn.limit(2 * sample).collect() or groups.select("x").limit(sample).collect()
    lists = int(np.clip(2 ** round(np.log2(np.sqrt(n) / 4 + 1)), 4, MOST_LISTS))
    index = Index(_unit([r["x"] for r in rows]), lists)

    def assign(batches):
        for b in batches:
            home, codes, error, probes = index.assign(_unit(b["x"]), reach)
            probes = [p[p >= h] for p, h in zip(probes, home, strict=True)]  # the other lists probe this one
            yield b.assign(home=home, codes=[c.tobytes() for c in codes], error=error, probes=probes)[names]

    names = ["rep", "copies", "label", "x", "home", "codes", "error", "probes"]
    label, kind = (groups.schema[c].dataType.simpleString() for c in ("label", "x"))
    told = common.stored(groups.select("rep", "copies", "label", "x").mapInPandas(assign, f"rep long, copies long, label {label}, x {kind}, home int, codes binary, error double, probes array<int>"))
    sizes = told.groupBy("label", F.col("home").alias("list")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("list"))
    sizes = sizes.select("label", "list", "n", ((upto - F.col("n")) / BLOCK).cast("int").alias("lo"), ((upto - 1) / BLOCK).cast("int").alias("hi"))
    plans = sizes.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("list", F.struct("lo", "hi")))).alias("at"), F.ceil(F.sum("n") / QUERIES).cast("int").alias("chunks"))
    plans = plans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = told.withColumn("salt", F.pmod(F.xxhash64(F.lit(2), "rep"), F.lit(SALTS)).cast("int")).join(plans, ["label", "salt"])
    dealt = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "rep"), n).cast("int")
    own, common_columns = F.col("at")[F.col("home")], ("label", "rep", "copies", "x", "home")
    reached = F.transform(F.filter("probes", lambda p: F.map_contains_key("at", p)), lambda p: F.sequence(F.col("at")[p]["lo"], F.col("at")[p]["hi"]))
    left = each.select(*common_columns, F.explode(F.array_distinct(F.flatten(reached))).alias("block"), dealt(3, F.col("chunks")).alias("chunk"))
    right = each.select(*common_columns, "codes", "error", (own["lo"] + dealt(4, own["hi"] - own["lo"] + 1)).alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"node": [], "links": [], "other": []})
        q, y = _unit(asked["x"]), _unit(held["x"])
        codes, error = np.stack([np.frombuffer(c, np.uint8) for c in held["codes"]]), held["error"].to_numpy()
        a, b = asked["rep"].to_numpy(np.int64), held["rep"].to_numpy(np.int64)
        from_, to = asked["home"].to_numpy(), held["home"].to_numpy()
        probed = index.probed(q, from_, reach)
        found = []
        for where in np.unique(to):
            rows, members = np.flatnonzero(probed[:, where] & (from_ <= where)), np.flatnonzero(to == where)
            for s in range(0, len(members), TILE):
                some = members[s : s + TILE]
                i, j = index.near(q[rows], int(where), codes[some], error[some], reach)
                i, j = rows[i], some[j]
                once = (from_[i] < where) | (a[i] < b[j])  # of one list, the lesser id asks
                i, j = i[once], j[once]
                close = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", q[i[t : t + 65_536]], y[j[t : t + 65_536]]) >= link for t in range(0, len(i), 65_536))])
                found.append((i[close], j[close]))
        i, j = (np.concatenate([np.zeros(0, np.int64), *f]) for f in zip(*found, strict=True))
        nodes = np.concatenate((a[i], b[j]))
        weights = np.concatenate((held["copies"].to_numpy(np.int64)[j], asked["copies"].to_numpy(np.int64)[i]))
        ids, at = np.unique(nodes, return_inverse=True)
        links, root = np.zeros(len(ids), np.int64), ids.copy()
        np.add.at(links, at, weights)
        u, w = at[: len(i)], at[len(i) :]
        while len(i):
            before = root.copy()
            np.minimum.at(root, w, root[u])
            np.minimum.at(root, u, root[w])
            if np.array_equal(before, root):
                break
        edge = ids != root
        counted = pd.DataFrame({"node": ids, "links": links, "other": None}).astype({"other": "Int64"})
        return pd.concat([counted, pd.DataFrame({"node": ids[edge], "links": 0, "other": root[edge]}).astype({"other": "Int64"})])

    keys = ["label", "block", "chunk"]
    left = left.toDF(*left.columns)  # columns of their own, since both sides come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "node long, links long, other long")
