"""Language identification, the quality classifier and the language model: held-out results and exact figures."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bitloom.llm import language, lm, quality, queries


def words(text):
    return (text or "").encode().lower().split()


def bucket(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_is_right_on_held_out_documents(spark, sf):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_language(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) == sum(bucket(i, 3) == 1 for i in truth)
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def languages(spark):
    rows = [(1, "the house and the garden of the town", "en"), (2, "das haus und der garten der stadt", "de"), (3, "дом и сад города", "ru")] * 5
    return language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_mixed_text_gets_spans_and_scripts_narrow_candidates(spark, languages):
    text = "the house and the garden of the town. das haus und der garten der stadt. дом и сад"
    row = language.label(spark.createDataFrame([(1, text)], "doc_id long, text string"), languages).first()
    assert [s.lang for s in row.spans] == ["en", "de", "ru"]
    assert sum(s.words for s in row.spans) == len(language.words(text))
    assert (languages.word("сад") == [-language.MOST, -language.MOST, 0]).all()


def test_language_edge_rows(odd, odd_rows, none, languages):
    rows = language.label(odd, languages).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_rows)
    texts = dict(odd_rows)
    for r in rows:
        if r.doc_id is not None and not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score, r.spans) == (language.UNKNOWN, 0.0, [])
        elif r.doc_id is not None:
            assert r.lang_pred in languages.langs
    assert language.label(none, languages).count() == 0
    assert {r.lang_pred for r in language.label(odd, language.Model({}, {})).collect()} == {language.UNKNOWN}


def test_words_are_letters_with_their_marks():
    assert language.words("½ ² ① Ⅷ 12") == [] and language.words("हिन्दी x²y") == ["हिन्दी", "x", "y"]
    assert language.words("The naïve Straße") == ["the", "naïve", "straße"]


def test_many_languages():
    texts = {f"l{k:03}": f"{chr(97 + k % 26)}{chr(97 + k // 26)}q{k % 7}" for k in range(200)}
    counts = {}
    for lang, text in texts.items():
        counts[lang] = np.zeros(language.CELLS)
        for w in language.words(text):
            np.add.at(counts[lang], language.features(w), 50)
    model = language.Model(counts, {k: {"latin": 1} for k in counts})
    scores = np.stack([model.word(w) for t in texts.values() for w in language.words(t)])
    path = model.viterbi(scores, [np.full(6, k) for k in range(200)])
    assert [model.langs[p[0]] for p in path] == list(texts)


def brute_viterbi(scores):
    best, back = scores[0].copy(), []
    for s in scores[1:]:
        top = int(best.argmax())
        step = [k if best[k] >= best[top] - language.SWITCH else top for k in range(len(best))]
        best = np.maximum(best, best[top] - language.SWITCH) + s
        back.append(step)
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def test_texts_in_step_give_the_plain_viterbi_paths(languages):
    rng = np.random.default_rng(2)
    scores = -rng.integers(0, 8, (30, 3)).astype(np.float32)
    where = [rng.integers(0, 30, n) for n in (5, 0, 40, 1, 17)]
    for path, w in zip(languages.viterbi(scores, where), where, strict=True):
        assert path.tolist() == (brute_viterbi(scores[w].astype(float)) if len(w) else [])


def test_quality_is_right_on_held_out_documents(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op4_quality(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_compiled_rules_equal_the_model(spark, odd):
    rng = np.random.default_rng(5)
    x = rng.random((400, len(quality.STATISTICS)))
    rules = quality.fit(x, ((x[:, 1] > 0.5) & (x[:, 3] < 0.6)).astype(float))
    assert 0 < len(rules.rules) < 80 and all(1 <= len(c) <= quality.DEPTH for _, c in rules.rules)
    assert ((rules.score(x) > 0.5) == ((x[:, 1] > 0.5) & (x[:, 3] < 0.6))).mean() > 0.95
    table = spark.createDataFrame(x.tolist(), [*quality.STATISTICS]).select(rules.column().alias("s"))
    assert np.allclose(sorted(r.s for r in table.collect()), sorted(rules.score(x)))


def test_quality_edge_rows(odd, none):
    assert quality.scored(odd, quality.Rules()).where("score = 0.5").count() == odd.count()
    assert quality.scored(odd, quality.Rules(), name="other").columns == [*odd.columns, "other"]
    assert quality.scored(none, quality.Rules()).count() == 0
    empty = none.sparkSession.createDataFrame([], "doc_id long, quality int")
    assert quality.train(odd, empty) == quality.Rules()
    one_class = none.sparkSession.createDataFrame([(1, 1), (7, 1), (8, None)], "doc_id long, quality int")
    assert quality.train(odd, one_class).rules == []


def test_language_model_query(spark, sf):
    docs = {r.doc_id: [*words(r.text), b""] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = Counter(w for i, t in docs.items() if bucket(i, 7) != 2 for w in t)
    total, kinds = sum(counts.values()), len(counts)
    rows = queries.op3_lm(spark, sf).collect()
    for r in rows:
        t = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (bucket(r.doc_id, 7) == 2, len(t), sum(w in counts for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in t), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_model_is_a_distribution(spark):
    texts = [(k, " ".join(["a b", "c d", "a d", "b"][(k + j) % 4] for j in range(6))) for k in range(40)]
    model = lm.train(spark.createDataFrame(texts, "doc_id long, text string"), units=4, classes=3)
    k = len(model.class_tokens)
    known = np.zeros(k)
    for w, n in model.known.items():
        c = model.classes[lm.Units(model.frequent)[w]]
        known[c] += 10 ** model.emission(np.array([n]), np.array([c]))[0]
    used = model.class_tokens > 1
    assert np.allclose((known + 10**model.unseen)[used], 1)
    assert np.allclose((10**model.transition).sum(1), 1)


def test_rare_words_are_scored_by_the_whole_table(spark, odd):
    """The scores do not depend on how many words travel to the tasks."""
    docs = odd.where("doc_id is not null").select("doc_id", "text")
    few, many = (lm.train(docs, units=3, classes=2, known=k) for k in (3, 10_000))
    a, b = (sorted((r.doc_id, r.n_known, r.base_score, r.score) for r in lm.score(docs, m).collect()) for m in (few, many))
    assert len(a) == docs.count()
    for x, y in zip(a, b, strict=True):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], rel=1e-9)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 3, (24, 24)).astype(float)
    pairs[:12, 12:] += 20
    pairs[12:, :12] += 20

    def likelihood(at):
        m = np.eye(4)[at]
        g = m.T @ pairs @ m
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(g) - f(g.sum(0)) - f(g.sum(1))

    assert likelihood(lm.exchange(pairs, 4)) > likelihood(np.arange(24) % 4)


def test_language_model_edge_rows(odd, odd_rows, none):
    model = lm.train(odd)
    rows = lm.score(odd, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_rows)
    assert {(r.n_tokens, r.n_known) for r in rows if r.doc_id in (4, 5, 6)} == {(1, 1)}
    assert lm.score(none, model).count() == 0
    nothing = lm.score(odd, lm.train(none)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score == 0 for r in nothing)


def test_words_past_the_units_are_classed_by_their_contexts(spark):
    """Words of one ending but unlike use, none of them exchanged nor known by the tasks."""
    texts = [(k, " ".join(f"le x{k}{j}ing va le a va" if j % 2 else f"du y{k}{j}ing po du b po" for j in range(8))) for k in range(40)]
    model = lm.train(spark.createDataFrame(texts, "doc_id long, text string"), units=7, classes=7, known=7)
    found = {bytes(r["word"]): r["class"] for r in model.vocabulary.collect()}
    x, y = ({c for w, c in found.items() if w.startswith(a)} for a in (b"x", b"y"))
    assert len(found) == 327 and len(x) == len(y) == 1 and x != y
    assert 10 ** model.transition[found[b"le"], next(iter(x))] > 0.8


def test_steps_are_sums_over_each_text_with_the_found_classes_put_in():
    rng = np.random.default_rng(2)
    transition = rng.random((5, 5))
    found_type = pa.list_(pa.struct([("class", pa.int32()), ("at", pa.list_(pa.int32()))]))
    seqs, found, expected = [], [], []
    for n in (4, 0, 2, 9, 0, 7):
        if not n:  # all words known: the sum is made elsewhere
            seqs.append(None)
            found.append(None)
            expected.append(0.0)
            continue
        at = rng.integers(0, 5, n)
        places = rng.permutation(np.arange(1, n))[: max(1, n // 2)]
        words = [{"class": int(at[p]), "at": [int(p)]} for p in places[1:]] + [{"class": int(at[places[0]]), "at": [int(places[0])]}]
        blank = at.copy()
        blank[places] = -1
        seqs.append(blank.astype(np.int16).tobytes())
        found.append(words)
        expected.append(sum(transition[a, b] for a, b in zip(at[:-1], at[1:], strict=True)))
    got = lm._steps(pa.array(seqs, pa.binary()), pa.array(found, found_type), transition)
    assert got == pytest.approx(expected)
    assert list(lm._steps(pa.array([None], pa.binary()), pa.array([None], found_type), transition)) == [0.0]
