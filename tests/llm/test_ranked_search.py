"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cuebook.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    own = [x for x in own if x[2]]
    n_docs, total = len(own), sum(n for *_, n in own)
    df = Counter(t for _, tf, _ in own for t in tf)
    out = []
    for item, text in items:
        query = Counter(terms(text))
        scores = []
        for i, tf, n in own:
            m = 75 + (25 * n * n_docs) // total
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
                    for t, c in query.items() if t in tf)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def check(spark, docs, items, k=20, parts=4, **how):
    d = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in docs], "doc_id long, text string, n int, terms string, norm double").repartition(parts)
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, id string")
    got = [tuple(r) for r in ranked_search.search(d, q, k, **how).collect()]
    assert sorted(got, key=repr) == brute(docs, items, k)


def corpus(seed, n, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "straße", "中文", "Ab", "7"]
    pick = lambda: words[min(int(rng.expovariate(0.12)), len(words) - 1)]
    return [(i, " ".join(pick() for _ in range(rng.choice([1, 3, 20, 200])))) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"bucket": 16, "seed": 30}, {"bucket": 64, "seed": 1, "block_terms": 20}])
def test_random(spark, how):
    docs = corpus(1, 600)
    items = [(100 + i, t) for i, t in corpus(2, 25)]
    check(spark, docs, items, k=7, **how)


def test_awkward_tables(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "Alpha beta"), (5, "alpha BETA"), (None, "alpha beta"), (5, "alpha beta"), (6, "alpha " * 20000),
            (7, "gamma\x00delta"), (8, "x" * 200_000)]
    items = [(1, "alpha"), (1, "beta beta alpha"), (2, None), (3, "!!"), (None, "delta"), (4, "nowhere"), (5, "x" * 200_000)]
    check(spark, docs, items, k=4)
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(none, some).collect() == []
    assert ranked_search.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none.toDF("item_id", "text")).collect() == []


def test_many_copies_tie_by_id(spark):
    docs = [(i * 7 % 1000, "the same text of copies") for i in range(1000)] + corpus(3, 50)
    check(spark, docs, [(1, "copies of text"), (2, "w1 w2 copies")], k=20, bucket=32, seed=10)


def test_bounds_prune(monkeypatch):
    """Most documents are never scored exactly: buckets and coordinate bounds leave them out."""
    rng = np.random.default_rng(4)
    size, rows = 50, 4096
    counts = [np.unique(rng.integers(0, size, 8)) for _ in range(rows)]
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in counts])])
    weights = rng.integers(1, 8000, size)
    impacts = ranked_search.Impacts(weights, rows, int(bounds[-1]))
    queries = ranked_search.Queries([0], np.array([0, 3]), np.argsort(-weights)[:3].astype(np.int64), np.array([1, 1, 2]), size, weights, 5)
    scored = []
    take = ranked_search.Best.take
    monkeypatch.setattr(ranked_search.Best, "take", lambda self, q, s, ids: (scored.append(len(s)), take(self, q, s, ids)))
    t, tf, n = np.concatenate(counts), np.ones(bounds[-1], np.int32), np.diff(bounds)
    d = impacts.of(n, t, tf, bounds)
    order = np.argsort(-impacts.norms(d, bounds), kind="stable")
    best = ranked_search.Best(np.ones(1, np.int64), 5)
    for lo in range(0, rows, 256):
        some = order[lo:lo + 256]
        own = np.concatenate([[0], np.cumsum(n[some])])
        queries.probe(impacts, pa.array(some), n[some], np.concatenate([counts[i] for i in some]), np.ones(own[-1], np.int32), own, best)
    exact = np.add.reduceat(np.where(np.isin(t, queries.terms), d * (1 + (t == queries.terms[2])), 0), bounds[:-1])
    want = sorted(zip((-exact).tolist(), range(rows), strict=True))[:5]
    assert [(-s, i) for s, i in want] == list(zip(best.found[0]["score"].to_pylist(), best.found[0]["id"].to_pylist(), strict=True))
    assert sum(scored) < rows / 4


def test_vocabulary_decides_by_bytes(monkeypatch):
    monkeypatch.setattr(ranked_search, "hashes", lambda raw, starts, ends: (ends - starts).astype(np.uint64) // np.uint64(3))
    known = ranked_search.Vocabulary(["abc", "abd", "a", "abcd"])
    raw = np.frombuffer(b"abd ABC a b abcd abce", dtype=np.uint8)
    starts, ends = np.array([0, 4, 8, 10, 12, 17]), np.array([3, 7, 9, 11, 16, 21])
    assert known.find(raw, starts, ends).tolist() == [1, 0, 2, -1, 3, -1]
