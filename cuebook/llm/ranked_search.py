"""Ranked lexical search: the best documents of each query, by inner products of impact vectors in norm buckets.

A query item is a vector of term counts, a document a vector of impacts ``w * ((10**9 tf) div (1000 tf + 12 m))``
over the terms of the queries; the score is their inner product.

1. One scan of the documents finds the queries' terms (by hash, confirmed byte by byte) and writes sparse vectors of
   (term, tf), 8 bytes an entry. Document frequencies, the number of documents and of terms come from these.
2. Impact vectors are range-partitioned by their length (L2 norm), longest first, with a salt, so that copies of one
   vector are many partitions. A partition is walked in buckets of ``BUCKET`` documents of similar length.
3. A query skips a bucket if the Cauchy-Schwarz bound, its length times that of the bucket's first document, is below the
   score of its k-th best document so far. The start is the k-th best among the ``SEED`` longest documents: those
   are scored first, all later thresholds only grow.
4. Inside a bucket, coordinate bounds filter: the ``FOCUS`` heaviest terms of the query are taken exactly, the rest of both
   vectors by Cauchy-Schwarz again. Survivors are scored exactly, in 64-bit integers.
5. Each task gives at most k documents a query; these are ranked per query.

Only bounds are floating point, and rounded up; scores, ties and ranks are exact. The queries are a stated set: they go
to the tasks in blocks of at most about ``BLOCK_TERMS`` distinct (item, term) pairs; a block is one pass over the documents.

Null and empty texts have no terms: such documents are found by nothing and count nowhere, such items
find nothing. Each row is a document, each row of items an item, repeated ones too; equal scores go by ascending
document id, null ids last. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import _LOWER, NON_ALNUM_BYTES, blocks, counted, hashes, words
from .common import lower_ascii, once, text_of, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_TERMS = 1 << 20
BUCKET, SEED, FOCUS = 1024, 2048, 6
UP = 1 + 1e-9  # bounds are rounded up by more than their error


class Vocabulary:
    """The numbers of terms: 0, 1, ... in the order given."""

    def __init__(self, terms: list[str]):
        parts = [t.encode() for t in terms]
        size = np.array([len(p) for p in parts], dtype=np.int64)
        place = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
        h = hashes(raw, place, place + size)
        self.order = np.argsort(h, kind="stable")
        self.hash, self.size, self.place, self.raw = h[self.order], size, place, raw
        _, same = np.unique(h, return_counts=True)
        self.same = int(same.max(initial=1))  # terms of one hash: one, almost surely

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for foreign ones. The hash finds, the bytes decide."""
        out = np.full(len(starts), -1, dtype=np.int64)
        if not len(self.hash) or not len(starts):
            return out
        h = hashes(raw, starts, ends)
        first = np.searchsorted(self.hash, h)
        for more in range(self.same):
            at = np.minimum(first + more, len(self.hash) - 1)
            some = np.flatnonzero((self.hash[at] == h) & (out < 0))
            term = self.order[at[some]]
            like = self.size[term] == (ends - starts)[some]
            some, term = some[like], term[like]
            n = self.size[term]
            before = np.cumsum(n) - n
            step = np.arange(int(n.sum()))
            differ = _LOWER[raw[step + np.repeat(starts[some] - before, n)]] != self.raw[step + np.repeat(self.place[term] - before, n)]
            good = np.ones(len(some), dtype=bool)
            good[np.searchsorted(before, np.flatnonzero(differ), side="right") - 1] = False
            out[some[good]] = term[good]
        return out


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of 32-bit numbers as binary values."""
    offsets = (bounds * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype("<i4").tobytes())])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of ``_packed`` values, where each value's begin)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return np.frombuffer(raw[offsets[0]:offsets[-1]].tobytes(), dtype="<i4"), (offsets - offsets[0]) // 4


def _vectors(docs: DataFrame, id_col: str, text_col: str, terms) -> DataFrame:
    """(id, n, terms, tfs, salt): terms of each document, those of the queries with their counts."""
    id_type = docs.schema[id_col].dataType.simpleString()
    name = uuid.uuid4().hex

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = once(("vocabulary", name), lambda: Vocabulary(terms.value))
        size = max(len(known.size), 1)
        for batch in batches:
            for lo, hi, raw, offsets in blocks(batch.column(1)):
                starts, ends, rows = words(raw, offsets, NON_ALNUM_BYTES)
                found = known.find(raw, starts, ends)
                row = np.repeat(np.arange(hi - lo), np.diff(rows))
                key, tf = counted((row * size + found)[found >= 0])
                bounds = np.searchsorted(key, np.arange(hi - lo + 1) * size)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(rows)), _packed(key % size, bounds), _packed(tf, bounds)],
                                      names=["id", "n", "terms", "tfs"])

    return docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("t")) \
        .mapInArrow(made, f"id {id_type}, n long, terms binary, tfs binary") \
        .withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))


def _frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0))[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["term", "df"])

    got = vectors.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, dtype=np.int64)
    df[got["term"].to_numpy()] = got["df"].to_numpy()
    return df


class Impacts:
    """What turns counts into impacts: the terms' weights, the number of documents and of their terms."""

    def __init__(self, weights: np.ndarray, docs: int, total: int):
        self.weights, self.docs, self.total = weights, docs, total

    def of(self, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        m = np.repeat(100 - 25 + 25 * n * self.docs // self.total, np.diff(bounds))
        tf = tfs.astype(np.int64)
        return self.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m))

    @staticmethod
    def norms(impact: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out, full = np.zeros(len(bounds) - 1), np.flatnonzero(np.diff(bounds))
        if len(full):  # sums of its own for each row: differences of running sums would lose the short vectors
            out[full] = np.add.reduceat(impact.astype(np.float64) ** 2, bounds[full])
        return np.sqrt(out)


class Queries:
    """A block of items as sparse vectors, and the search of one bucket for all of them."""

    def __init__(self, items: list[int], bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, size: int, weights: np.ndarray, k: int):
        self.items, self.bounds, self.terms, self.counts, self.k = items, bounds, terms, counts, k
        sums = np.concatenate([[0], np.cumsum(counts * counts)])
        self.square = sums[bounds[1:]] - sums[bounds[:-1]]
        self.norm = np.sqrt(self.square)
        self.dense = np.zeros(size, dtype=np.int64)
        self.heavy = []  # the places of each query's FOCUS heaviest terms
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            order = np.argsort(-(counts[a:b] * weights[terms[a:b]]), kind="stable")
            self.heavy.append(a + order[:FOCUS])

    def probe(self, impacts: Impacts, ids: pa.Array, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, bounds: np.ndarray,
              best: Best) -> None:
        """Take one bucket into ``best``."""
        d = impacts.of(n, terms, tfs, bounds)
        norm = impacts.norms(d, bounds)
        alive = np.flatnonzero(self.norm * (norm.max(initial=0.0) * UP) >= best.least)
        if not len(alive):
            return
        rows = len(n)
        order = np.argsort(terms, kind="stable")
        by_term, row_of, impact_of = terms[order], np.repeat(np.arange(rows), np.diff(bounds))[order], d[order]
        square = norm * norm
        for q in alive.tolist():
            least = best.least[q]
            exact, seen, left = np.zeros(rows), np.zeros(rows), self.square[q]
            for p in self.heavy[q].tolist():
                a, b = np.searchsorted(by_term, [self.terms[p], self.terms[p] + 1])
                x = impact_of[a:b].astype(np.float64)
                exact[row_of[a:b]] += self.counts[p] * x
                seen[row_of[a:b]] += x * x
                left -= self.counts[p] ** 2
            bound = exact + math.sqrt(left) * np.sqrt(np.maximum(square * UP - seen, 0.0))
            some = np.flatnonzero(bound * UP >= least)
            if not len(some):
                continue
            mine = slice(self.bounds[q], self.bounds[q + 1])
            self.dense[self.terms[mine]] = self.counts[mine]
            size = np.diff(bounds)[some]
            before = np.cumsum(size) - size
            at = np.arange(int(size.sum())) + np.repeat(bounds[some] - before, size)
            sums = np.concatenate([[0], np.cumsum(self.dense[terms[at]] * d[at])])
            score = sums[before + size] - sums[before]
            self.dense[self.terms[mine]] = 0
            good = score >= least
            if good.any():
                best.take(q, score[good], ids.take(pa.array(some[good])))


class Best:
    """The k best documents of each query so far; ``least`` is the score below which none is of use."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.found: dict[int, pa.Table] = {}

    def take(self, q: int, score: np.ndarray, ids: pa.Array) -> None:
        t = pa.table({"score": pa.array(score), "id": ids})
        if q in self.found:
            t = pa.concat_tables([self.found[q], t])
        t = t.take(pc.sort_indices(t, [("score", "descending"), ("id", "ascending")])[:self.k])
        self.found[q] = t
        if len(t) == self.k:
            self.least[q] = max(self.least[q], t["score"][self.k - 1].as_py())

    def rows(self, items: list[int], id_type: pa.DataType) -> pa.Table:
        parts = [t.append_column("item", pa.array([items[q]] * len(t), pa.int64())) for q, t in self.found.items()]
        empty = pa.table({"score": pa.array([], pa.int64()), "id": pa.array([], id_type), "item": pa.array([], pa.int64())})
        return pa.concat_tables([empty, *parts]).select(["item", "id", "score"])


def _probed(vectors: DataFrame, shared, least: np.ndarray, k: int, bucket: int) -> DataFrame:
    """(item, id, score): at most k documents a query for each partition of ``vectors`` (id, n, terms, tfs)."""
    id_type = vectors.schema["id"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        impacts, queries = shared.value
        best, kind = Best(least, k), None
        for batch in batches:
            kind = batch.schema.field("id").type
            for lo in range(0, batch.num_rows, bucket):
                part = batch.slice(lo, bucket)
                terms, bounds = _numbers(part.column(2))
                queries.probe(impacts, part.column(0), part.column(1).to_numpy(), terms, _numbers(part.column(3))[0], bounds, best)
        if kind is not None:
            yield from best.rows(queries.items, kind).combine_chunks().to_batches()

    return vectors.select("id", "n", "terms", "tfs").mapInArrow(probe, f"item long, id {id_type}, score long")


def _block(docs: DataFrame, rows: pa.Table, k: int, id_col: str, text_col: str, bucket: int, seed: int) -> DataFrame | None:
    """(item, id, score) of the queries in ``rows`` (item, term, tf); None where there is no document with terms."""
    spark = docs.sparkSession
    words_of = rows["term"].combine_chunks().dictionary_encode()
    terms = words_of.dictionary.to_pylist()
    order = np.argsort(rows["item"].to_numpy(), kind="stable")
    item, number, tf = rows["item"].to_numpy()[order], words_of.indices.to_numpy()[order].astype(np.int64), rows["tf"].to_numpy()[order]
    items, begin = np.unique(item, return_index=True)

    vectors = written(_vectors(docs, id_col, text_col, spark.sparkContext.broadcast(terms)), "impact-counts")
    n_docs, total = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_docs:
        return None
    df = _frequencies(vectors, len(terms))
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    impacts = Impacts(weights, n_docs, total)
    queries = Queries(items.tolist(), np.append(begin, len(item)), number, tf, len(terms), weights, k)
    shared = spark.sparkContext.broadcast((impacts, queries))

    @F.arrow_udf("double")
    def norm(n: pa.Array, terms: pa.Array, tfs: pa.Array) -> pa.Array:
        known, (t, bounds) = shared.value[0], _numbers(terms)
        return pa.array(known.norms(known.of(n.to_numpy(zero_copy_only=False), t, _numbers(tfs)[0], bounds), bounds))

    lengths = vectors.withColumn("norm", norm("n", "terms", "tfs")).filter("norm > 0")
    least = np.ones(len(items), dtype=np.int64)
    # The longest ones by their lengths alone: no task gathers vectors, at most ``seed`` scores meet for an item.
    longest = lengths.select("norm", "salt").orderBy(F.desc("norm"), "salt").limit(seed).collect()
    if longest:
        norm_at, salt_at = longest[-1]
        top = lengths.filter((F.col("norm") > norm_at) | (F.col("norm") == norm_at) & (F.col("salt") <= salt_at))
        start = _probed(top, shared, least, k, bucket).groupBy("item").agg(F.sort_array(F.collect_list("score"), False).alias("scores"))
        kth = start.filter(F.size("scores") >= k).select("item", F.get("scores", F.lit(k - 1)).alias("score")).toArrow()
        least[np.searchsorted(items, kth["item"].to_numpy())] = kth["score"].to_numpy()
    ordered = lengths.repartitionByRange(F.desc("norm"), "salt").sortWithinPartitions(F.desc("norm"))
    return _probed(ordered, shared, least, k, bucket)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block_terms: int = BLOCK_TERMS, bucket: int = BUCKET, seed: int = SEED) -> DataFrame:
    """(item id, rank, id, score): the ``k`` documents of the highest scores above 0 for each row of ``items``."""
    spark = docs.sparkSession
    numbered = written(items.select(F.monotonically_increasing_id().alias("item"), items[item_col].alias("item_id"),
                                    text_of(items[item_text_col]).alias("t")), "items")
    terms = written(numbered.select("item", F.explode(F.regexp_extract_all(lower_ascii(F.col("t")), F.lit(TERM), F.lit(0))).alias("term"))
                    .groupBy("item", "term").agg(F.count("*").alias("tf")), "item-terms")
    n = -(-terms.count() // block_terms)
    found = []
    for b in range(n):
        rows = terms.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == b).toArrow()
        if len(rows):
            found.append(_block(docs, rows, k, id_col, text_col, bucket, seed))
    id_type = docs.schema[id_col].dataType.simpleString()
    empty = spark.createDataFrame([], f"item long, id {id_type}, score long")
    every = reduce(DataFrame.unionAll, [f for f in found if f is not None], empty)
    place = F.row_number().over(_ranking())
    ranked = every.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.join(numbered.select("item", "item_id"), "item") \
        .select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _ranking():
    from pyspark.sql import Window

    return Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
