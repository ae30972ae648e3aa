"""Near-duplicate vectors, documents and lines, against brute force and DuckDB."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import common, embeddings, lines, minhash, queries
from bitloom.llm.oracle import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    ours, theirs = queries.QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (t[columns].sort_values(columns).reset_index(drop=True) for t in (ours, theirs))
    assert a.dtypes.astype(str).tolist() == b.dtypes.astype(str).tolist() and a.equals(b)


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = closure({n for e in links for n in e}, links)
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert found == {n: expected[n] for n in linked}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without(odd, odd_rows, none):
    gone = odd.sparkSession.createDataFrame([(2,), (2,), (9,), (999,)], "doc_id long")
    found = common.without(odd, gone, "doc_id")
    assert found.columns == odd.columns and {r.part for r in found.collect()} == {"extra"}
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter(r for r in odd_rows if r[0] not in (2, 9))
    assert common.without(none, gone, "doc_id").count() == 0


# vectors


def brute_vectors(rows):
    fit = {}
    for i, x, label in rows:
        if i is not None and x is not None and label is not None and all(c is not None and np.isfinite(c) for c in x) and any(x):
            fit.setdefault((i, label, tuple(x)), np.array(x) / np.linalg.norm(x))
    keys, links, n = list(fit), [], Counter()
    for a in range(len(keys)):
        for b in range(len(keys)):
            if a != b and keys[a][1] == keys[b][1] and len(keys[a][2]) == len(keys[b][2]) and fit[keys[a]] @ fit[keys[b]] >= 0.98:
                n[keys[a]] += 1
                links.append((keys[a][0], keys[b][0]))
    return n, closure({k[0] for k in keys}, links)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    rows = [(k, (centres[k % 40] + rng.normal(size=16) * 0.08 * (k % 3)).tolist(), k % 2) for k in range(300)]
    rows += [(300 + k, centres[0].tolist(), 0) for k in range(30)] + [(340, (centres[0] * 7).tolist(), 0), rows[5], rows[5]]
    rows += [(350, None, 1), (351, [0.0] * 16, 1), (352, [float("nan")] * 16, 1), (353, [None, *[1.0] * 15], 1), (354, centres[0].tolist(), None), (355, [1.0, 2.0], 0), (356, [1.0, 2.0], 0), (357, [], 0)]
    rows += [(358, [float("inf"), *[1.0] * 15], 1), (None, centres[0].tolist(), 0)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "vec_id long, embedding array<double>, label int, rep string, x int")
    found = embeddings.near_duplicates(df, sample=200).collect()
    n, component = brute_vectors(rows)
    assert Counter(r.vec_id for r in found) == Counter(r[0] for r in rows)
    by_id = defaultdict(int)
    for (i, _, _), k in n.items():
        by_id[i] += k
    for r in found:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            c = component.get(r.vec_id, r.vec_id)
            assert (r.n_links, r.component_id, r.kept) == (by_id[r.vec_id], c, c == r.vec_id)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_hot_label_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    monkeypatch.setattr(embeddings, "QUERIES", 11)
    rng = np.random.default_rng(8)
    base = rng.normal(size=8)
    rows = [(k, (base + rng.normal(size=8) * 0.12).tolist(), 1) for k in range(80)]
    n, component = brute_vectors(rows)
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r.n_links == n[(r.vec_id, 1, tuple(rows[r.vec_id][1]))] and r.component_id == component[r.vec_id] for r in found)


# documents


def brute_sets(text, words):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_documents(rows, words):
    sets = [(i, brute_sets(t, words)) for i, t in rows if i is not None]
    links = [(a, b) for a, s in sets for b, t in sets if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    return closure({i for i, _ in sets}, links)


@pytest.fixture(scope="module")
def copies():
    """Groups of exact and near copies with a similarity on both sides of 0.8, and a passage that many share."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for k in range(150):
        own = list(base)
        for _ in range(k % 8):
            own[rng.randrange(len(own))] = word()
        rows.append((k, " ".join(own)))
    rows += [(200 + k, " ".join([word() for _ in range(k)] + passage)) for k in range(40)]
    rows += [(300 + k, " ".join(base)) for k in range(20)] + [(400 + k, " ".join(word() for _ in range(50))) for k in range(30)]
    return rows


@pytest.mark.parametrize("words", [4, 5])
def test_documents_equal_brute_force(spark, copies, words, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 40)
    rows = [*copies, copies[3], (3, copies[160][1])]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words).collect()
    component = brute_documents(rows, words)
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    sizes = defaultdict(set)
    for i, t in rows:
        sizes[i].add(len(brute_sets(t, words)))
    for r in found:
        assert r.n_shingles in sizes[r.doc_id] and r.component_id == component[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_document_edge_rows(odd, odd_rows, none):
    found = minhash.near_duplicates(odd).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in odd_rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[2].component_id == by_id[1].component_id == 1 and by_id[8].component_id == 7
    assert (by_id[None].component_id, by_id[None].kept) == (None, False)
    for i in (4, 5, 6):
        assert (by_id[i].n_shingles, by_id[i].component_id, by_id[i].kept) == (0, i, True)
    assert minhash.near_duplicates(none).count() == 0


# lines


def brute_lines(rows, percent=lines.PERCENT):
    all_lines = []
    for i, t in rows:
        if i is not None and t is not None:
            all_lines += [(i, p, frozenset(x for x in line.lower().split(" ") if x)) for p, line in enumerate(t.split("\n"))]
    all_lines = sorted({(i, p, s) for i, p, s in all_lines if s}, key=lambda x: x[:2])
    gone = set()
    for k, (i, p, s) in enumerate(all_lines):
        if any((a, b) != (i, p) and 100 * len(s & t) >= percent * len(s | t) for a, b, t in all_lines[:k]):
            gone.add((i, p))
    return [(i, t if i is None or t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)) for i, t in rows]


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(150)]
    lists = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 30))] for _ in range(60)]

    def line():
        own = list(rng.choice(lists))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rng.shuffle(own)
        return " ".join(own)

    rows = [(k, "\n".join(line() for _ in range(rng.randint(1, 8)))) for k in range(80)] + [(90 + k, "one very common line of eight words here\nand " + line()) for k in range(40)]
    found = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == sorted(brute_lines(rows))


def test_line_edge_rows(odd, odd_rows, none):
    found = lines.dedup(odd, removed_col="removed")
    assert found.columns == [*odd.columns, "removed"]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    got = sorted(((r.doc_id, r.text) for r in found.collect()), key=order)
    assert got == sorted(brute_lines(odd_rows), key=order)
    assert lines.dedup(none).count() == 0


def test_lines_stay_in_the_jvm(spark, small):
    plan = queries.op10_lines(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_low_similarities_are_refused(odd):
    with pytest.raises(ValueError):
        lines.dedup(odd, percent=50)


@pytest.mark.parametrize("hot", [0, 4, lines.HOT])
def test_short_lines_and_frequent_tokens(spark, monkeypatch, hot):
    """Lines of one token and more; with a low bound, all tokens are frequent ones that are posted in pairs."""
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(25)]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))
    rows = [(k, "\n".join(line() for _ in range(5))) for k in range(60)]
    rows += [(100 + k, "All rights reserved\n\n  \nI\nreserved all rights\nw1 w2 w3 w4" + " w5" * (k % 2)) for k in range(6)]
    found = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == sorted(brute_lines(rows))


def test_rare_tokens_stay_apart_in_a_large_corpus(spark, monkeypatch):
    """Hardly any of half a million tokens that occur once or twice is posted in pairs, whose number would grow with the square."""
    monkeypatch.setattr(lines, "HOT", 8)
    words = [F.concat(F.lit(f"w{k}x"), (F.col("doc_id") - F.col("doc_id") % 2).cast("string")) for k in range(20)]
    texts = spark.range(50_000).withColumnRenamed("id", "doc_id").withColumn("text", F.concat_ws(" ", *words))
    assert lines._sets(texts, lines.PERCENT).where("cool < size(prefix)").count() < 500
