"""The convolutional classifier: held-out accuracy, its convolution against plain loops, awkward tables."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cuebook.llm import toxicity
from cuebook.llm.bytewords import blocks

BAD = ["grue", "Snark", "vorpal", "jabber", "tulgey"]


def corpus(seed, n, langs=("en", "de")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(rng.choice([5, 60, 400]))]
        words += [rng.choice(["the", "of", "and"]) for _ in range(20)]
        toxic = int(rng.random() < 0.2)
        words += [rng.choice(BAD) for _ in range(4 * toxic)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), rng.choice(langs), toxic))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, 1, 0.0, "x") for i, t, lang, _ in rows],
                                 "doc_id long, text string, lang string, y int, score double, id string").repartition(3)
    labels = spark.createDataFrame([(i, y, i) for i, _, _, y in rows], "doc_id long, toxic int, text long")
    return docs, labels


def test_held_out_accuracy(spark):
    rows = corpus(5, 500)
    docs, labels = tables(spark, rows)
    model = toxicity.fit(docs, labels)
    truth = {i: y for i, _, _, y in rows}
    got = [r for r in toxicity.score(docs, model).collect() if r.held_out]
    assert len(got) > 80
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    assert sum(r.flagged == truth[r.doc_id] for r in got) >= 0.95 * len(got)
    assert all(r.predicted == int(r.score >= 0.3) and r.flagged == int(r.score >= r.threshold) for r in got)


def test_real_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.score(docs, model).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.9 * len(got)


def test_scores_ignore_language_and_fold(spark):
    rows = corpus(6, 200)
    docs, labels = tables(spark, rows)
    model = toxicity.fit(docs, labels)
    before = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    other = docs.selectExpr("doc_id + 1000 AS doc_id", "text", "'zz' AS lang")
    assert {r.doc_id - 1000: r.score for r in toxicity.score(other, model).collect()} == before
    # Labels of the held-out fold do not enter.
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped)
    assert np.array_equal(again.vectors, model.vectors) and again.thresholds == model.thresholds


def test_convolution_against_loops():
    rng = np.random.default_rng(2)
    texts = ["a b c d", "", None, "b", "c c a b d a", "zz zz zz", "d " * 50]
    vocabulary = np.unique(toxicity.word_hashes(np.frombuffer(b"a b c d", np.uint8), np.array([0, 7]))[0])
    d, f, n = toxicity.DIM, toxicity.FILTERS, len(toxicity.WIDTHS)
    vectors = rng.normal(size=(5, d))
    vectors[0] = 0
    model = toxicity.Model(vocabulary, vectors, [rng.normal(size=(w, d, f)) for w in toxicity.WIDTHS], rng.normal(size=(n, f)), rng.normal(size=(n, f)), 0.3)
    got = np.concatenate([model.score(*toxicity.word_hashes(raw, o)) for _, _, raw, o in blocks(pa.array(texts), 12)])
    for text, score in zip(texts, got, strict=True):
        ids = [int(model.numbers(toxicity.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0])[0]) for w in (text or "").split()]
        total = model.bias
        for w, width in enumerate(toxicity.WIDTHS):
            for k in range(f):
                windows = [model.shift[w][k] + sum(vectors[ids[i + j]] @ model.filters[w][j][:, k] for j in range(width) if i + j < len(ids))
                           for i in range(len(ids))]
                total += max([0.0, *windows]) * model.out[w][k]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_gradient_against_differences():
    """A step moves every parameter against the gradient of the mean log loss."""
    rng = np.random.default_rng(8)
    rows = [rng.integers(0, 9, n) for n in (4, 1, 7)]
    y = np.array([1.0, 0.0, 0.0])
    d, f, n = toxicity.DIM, toxicity.FILTERS, len(toxicity.WIDTHS)

    def model():
        r = np.random.default_rng(9)
        vectors = r.normal(size=(9, d))
        vectors[0] = 0
        return toxicity.Model(np.arange(1, 9, dtype=np.uint64), vectors, [r.normal(size=(w, d, f)) for w in toxicity.WIDTHS],
                              r.normal(size=(n, f)), r.normal(size=(n, f)) * 0.1, 0.1)

    def loss(m):
        edge = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        p = m.score(np.concatenate(rows).astype(np.uint64), edge)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    rate, eps = 1e-6, 1e-5
    m = model()
    toxicity._step(m, rows, y, rate, 0.0)
    start = model()
    for name, scale in (("vectors", toxicity.OWN_RATE), ("shift", 1.0), ("out", 1.0)):
        moved = (getattr(start, name) - getattr(m, name)) / rate / scale
        for at in [(0, 0), (1, 3), (2, 5)]:
            if name == "vectors":
                at = (at[0] + 1, at[1])
            up, down = model(), model()
            getattr(up, name)[at] += eps
            getattr(down, name)[at] -= eps
            # the step updates one width after the other, so only nearly the gradient at one point
            assert moved[at] == pytest.approx((loss(up) - loss(down)) / (2 * eps), rel=2e-3, abs=1e-5), (name, at)


def test_awkward_tables(spark):
    rows = [(1, None, "en", 1), (2, "", None, 0), (3, "grue " * 50_000, "en", 1), (4, "x" * 300_000, "de", 0), (None, "of", "en", 1), (5, "the", "en", 0)]
    docs, labels = tables(spark, [*rows, rows[2]])
    got = toxicity.score(docs, toxicity.fit(docs, labels.unionAll(labels).unionAll(spark.createDataFrame([(3, None, 1)], labels.schema)))).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    none = docs.limit(0)
    assert toxicity.score(none, toxicity.fit(docs, labels.limit(0))).collect() == []
    assert {r.score for r in toxicity.score(docs, toxicity.fit(none, labels)).collect()} == {0.5}
    lone = toxicity.fit(docs, labels.withColumn("toxic", labels["toxic"] * 0))
    assert all(r.predicted == 0 for r in toxicity.score(docs, lone).collect())


def test_sample_is_bounded(spark):
    rows = corpus(7, 120)
    docs, labels = tables(spark, rows)
    seen = []
    train = toxicity.train
    toxicity.train = lambda r, y, **how: (seen.append((len(r), sum(map(len, r)))), train(r, y, **how))[1]
    try:
        toxicity.fit(docs, labels, max_rows=30)
        toxicity.fit(docs, labels, max_bytes=2000)
    finally:
        toxicity.train = train
    assert seen[0][0] == 25 and 0 < seen[1][1] <= 2000


def fold(spark, rows):
    """Ids outside the held-out fold that the model sees: not kept for the thresholds."""
    from pyspark.sql import functions as F

    ids = spark.createDataFrame([(i,) for i, *_ in rows], "id long").filter(~toxicity.held_out(F.col("id")))
    return {r.id for r in ids.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(toxicity.APART)) != toxicity.APART - 1).collect()}


def test_every_labelled_row_counts(spark):
    """The vocabulary is that of all rows, far more than a sample has."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(1500)}" for _ in range(3)), "en", i % 2) for i in range(9000)]
    docs, labels = tables(spark, rows)
    model = toxicity.fit(docs, labels, epochs=1)
    seen, count = fold(spark, rows), {}
    for i, text, *_ in rows:
        for w in set(text.split()) if i in seen else ():
            count[w] = count.get(w, 0) + 1
    least = 2 + len(seen) // 1000
    assert len(seen) > toxicity.MAX_ROWS
    want = [w.encode() for w, n in count.items() if n >= least]
    raw, ends = np.frombuffer(b" ".join(want), np.uint8), np.cumsum([len(w) + 1 for w in want])
    assert np.array_equal(model.vocabulary, np.sort(toxicity.word_hashes(raw, np.array([0, ends[-1] - 1]))[0]))


def test_parts_train_one_model(spark, monkeypatch):
    rows = corpus(9, 900)
    docs, labels = tables(spark, rows)
    monkeypatch.setattr(toxicity, "PART_ROWS", 150)
    coalescing = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    made = []
    monkeypatch.setattr(toxicity, "_part_trainer", lambda *a, make=toxicity._part_trainer: (made.append(a[1]), make(*a))[1])
    try:
        model, again = toxicity.fit(docs, labels), toxicity.fit(docs, labels)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalescing)
    assert made == [*range(toxicity.ROUNDS)] * 2
    assert np.array_equal(model.vectors, again.vectors) and model.bias == again.bias and model.thresholds == again.thresholds
    truth = {i: y for i, _, _, y in rows}
    got = [r for r in toxicity.score(docs, model).collect() if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.97 * len(got)


def test_best_bin_against_all_thresholds():
    rng = np.random.default_rng(4)
    for _ in range(20):
        scores, y = rng.integers(0, 40, 60) * 200, rng.integers(0, 2, 60)
        y[0] = 1
        cut = toxicity.best_bin(np.bincount(scores, minlength=toxicity.BINS), np.bincount(scores, y, toxicity.BINS).astype(int))

        def f1(t):
            flagged = (scores + 0.5) / toxicity.BINS >= t
            return 2 * (flagged & (y == 1)).sum() / max(flagged.sum() + y.sum(), 1)

        assert f1(cut) == pytest.approx(max(f1(t / toxicity.BINS) for t in range(0, toxicity.BINS, 100)))
