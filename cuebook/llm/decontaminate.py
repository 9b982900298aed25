"""Benchmark decontamination with suffix arrays over the training texts.

Words become numbers of the benchmark's vocabulary, 0 for any other word. Each shard (a block
of rows inside an Arrow batch) sorts its suffixes into a suffix array; a suffix that meets a
foreign word or the end of its row before the shortest window ends can hold no window and is
left out, so the array is sparse and exact. Every test suffix is then found by binary search:
the range of the array that starts with its window gives all places, and places on one
diagonal that follow each other merge into the longest verbatim match.

The benchmark is the stated query set. It passes through the driver to the executors in blocks of
about ``block_bytes`` of text, whole items, one block at a time; one block is one scan of the
documents without a shuffle, more blocks are more scans whose sparse hits meet by the hash of the text.

Null and empty texts have no words and no hits. Items without words, or with a null id, have no
window. Repeated items count once, repeated rows each get a row. Extra columns are ignored by
``contamination`` and kept by ``remove_contaminated``. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import NON_ALNUM_BYTES, blocks, hashes, words
from .common import text_of, written

BLOCK_BYTES = 4 << 20  # a set of 590,000 windows of ten words: 340 MB of the driver at its peak, 54 MB sent
FOUND = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<a:long,b:long>>>"
MATCHES = "array<struct<item_id:string,item_start:long,doc_start:long,length:long>>"


def _bound(keys: list[np.ndarray], query: list[np.ndarray], right: bool) -> np.ndarray:
    """Places of the queries in the sorted rows ``keys`` (columns, most significant first)."""
    lo = np.zeros(len(query[0]), dtype=np.int64)
    hi = np.full(len(query[0]), len(keys[0]), dtype=np.int64)
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi) // 2, 0)
        less, equal = np.zeros(len(lo), dtype=bool), np.ones(len(lo), dtype=bool)
        for k, q in zip(keys, query, strict=True):
            less |= equal & (k[mid] < q)
            equal &= k[mid] == q
        up = less | equal if right else less
        lo, hi = np.where(open_ & up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
    return lo


class TestSet:
    """The distinct windows of the items, and which item holds each at which word."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        items = sorted(set(items))
        texts = pa.array([t for _, t in items], pa.string())
        coded, rows = [], [0]
        for _, _, raw, offsets in blocks(texts):
            starts, ends, at = words(raw, offsets, NON_ALNUM_BYTES)
            coded.append(hashes(raw, starts, ends))
            rows += (at[1:] + rows[-1]).tolist()
        h = np.concatenate(coded) if coded else np.zeros(0, dtype=np.uint64)
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h).astype(np.int64) + 1
        self.width = window
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.names = [i for i, _ in items]
        at, depth, item = [], [], []
        for k, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True)):
            d = min(window, b - a)
            if d:
                at.append(np.arange(a, b - d + 1))
                depth.append(np.full(b - a - d + 1, d))
                item.append(np.full(b - a - d + 1, k))
        at, depth, item = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (at, depth, item))
        starts = np.asarray(rows, dtype=np.int64)
        tail = np.arange(window)
        if len(at):
            matrix = np.where(tail < depth[:, None], ids[np.minimum(at[:, None] + tail, len(ids) - 1)], 0)
            distinct, back = np.unique(np.concatenate([depth[:, None], matrix], axis=1), axis=0, return_inverse=True)
        else:
            distinct, back = np.zeros((0, window + 1), dtype=np.int64), np.zeros(0, np.int64)
        back = back.ravel()
        self.depth, matrix = distinct[:, 0], distinct[:, 1:]
        self.least = int(self.depth.min()) if len(distinct) else 0
        self.low = self._pack(matrix)
        self.high = self._pack(np.where(tail < self.depth[:, None], matrix, (1 << self.bits) - 1))
        order = np.argsort(back, kind="stable")
        self.item, self.item_at = item[order], (at - starts[item])[order]
        self.first = np.searchsorted(back[order], np.arange(len(distinct) + 1))

    def _pack(self, matrix: np.ndarray) -> list[np.ndarray]:
        per = 62 // self.bits
        keys = []
        for i in range(0, self.width, per):
            key = np.zeros(len(matrix), dtype=np.int64)
            for j in range(i, min(i + per, self.width)):
                key = (key << self.bits) | matrix[:, j]
            keys.append(key)
        return keys

    def places(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words before each row, window, word) for every occurrence of a window in a block of rows."""
        none = np.zeros(0, dtype=np.int64)
        starts, ends, rows = words(raw, offsets, NON_ALNUM_BYTES)
        if not len(self.depth) or not len(starts):
            return rows, none, none
        h = hashes(raw, starts, ends)
        number = np.searchsorted(self.vocabulary, h)
        number[number == len(self.vocabulary)] = 0
        ids = np.where(self.vocabulary[number] == h, number + 1, 0)
        # Runs of known words inside a row.
        edge = np.zeros(len(ids) + 1, dtype=bool)
        edge[rows] = True
        edge[:-1] |= ids == 0
        edge[1:] |= ids == 0
        cuts = np.flatnonzero(edge)
        length = np.diff(cuts)
        keep = (length >= self.least) & (ids[cuts[:-1]] > 0)
        run, length = cuts[:-1][keep], length[keep]
        if not len(run):
            return rows, none, none
        n = length - self.least + 1
        at = np.arange(int(n.sum())) + np.repeat(run - (np.cumsum(n) - n), n)
        stop = np.repeat(run + length, n)
        ids = np.append(ids, np.zeros(self.width, dtype=ids.dtype))
        tail = np.arange(self.width)
        keys = self._pack(np.where(at[:, None] + tail < stop[:, None], ids[at[:, None] + tail], 0))
        order = np.lexsort(keys[::-1])  # the suffix array, as deep as a window
        keys = [k[order] for k in keys]
        lo, hi = _bound(keys, self.low, False), _bound(keys, self.high, True)
        found = np.flatnonzero(lo < hi)
        n = (hi - lo)[found]
        which = np.repeat(found, n)
        place = order[np.arange(int(n.sum())) + np.repeat(lo[found] - (np.cumsum(n) - n), n)]
        return rows, which, at[place]

    def spans(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each row: words, merged hit spans, items whose windows occur."""
        rows, which, at = self.places(raw, offsets)
        row = np.searchsorted(rows, at, side="right") - 1
        order = np.lexsort((at, row))
        row, at, which = row[order], at[order], which[order]
        bounds = np.searchsorted(row, np.arange(len(rows)))
        for r in range(len(rows) - 1):
            a, b = bounds[r], bounds[r + 1]
            n = int(rows[r + 1] - rows[r])
            if a == b:
                yield n, [], []
                continue
            begin = at[a:b] - rows[r]
            end = np.maximum.accumulate(begin + self.depth[which[a:b]])
            new = np.append(True, begin[1:] > end[:-1])
            heads = np.flatnonzero(new)
            merged = list(zip(begin[heads].tolist(), end[np.append(heads[1:], len(begin)) - 1].tolist(), strict=True))
            own = np.unique(which[a:b])
            item = np.unique(np.concatenate([self.item[self.first[w]:self.first[w + 1]] for w in own]))
            yield n, merged, sorted({self.names[i] for i in item})

    def longest(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[list[tuple[str, int, int, int]]]:
        """For each row: maximal verbatim matches (item, word there, word here, words)."""
        rows, which, at = self.places(raw, offsets)
        n = self.first[which + 1] - self.first[which]
        pick = np.arange(int(n.sum())) + np.repeat(self.first[which] - (np.cumsum(n) - n), n)
        here, item, there = np.repeat(at, n), self.item[pick], self.item_at[pick]
        depth = np.repeat(self.depth[which], n)
        row = np.searchsorted(rows, here, side="right") - 1
        order = np.lexsort((here, here - there, item, row))
        row, item, here, there, depth = (x[order] for x in (row, item, here, there, depth))
        follows = np.zeros(len(row), dtype=bool)
        follows[1:] = (row[1:] == row[:-1]) & (item[1:] == item[:-1]) & (here[1:] == here[:-1] + 1) & (there[1:] == there[:-1] + 1)
        head = np.flatnonzero(~follows)
        last = np.append(head[1:], len(row)) - 1
        out: list[list] = [[] for _ in range(len(rows) - 1)]
        for a, b in zip(head.tolist(), last[:len(head)].tolist(), strict=True):
            out[row[a]].append((self.names[item[a]], int(there[a]), int(here[a] - rows[row[a]]), int(here[b] - here[a] + depth[b])))
        yield from (sorted(x) for x in out)


def _hits(tests: TestSet, text: Column) -> Column:
    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        rows = [{"n_words": n, "n_hit": sum(b - a for a, b in spans), "items": items, "spans": [{"a": a, "b": b} for a, b in spans]}
                for _, _, raw, offsets in blocks(texts, 4 << 20) for n, spans, items in tests.spans(raw, offsets)]
        span = pa.struct([("a", pa.int64()), ("b", pa.int64())])
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(span))]))

    return found(text)


def _longest(tests: TestSet, text: Column) -> Column:
    names = ("item_id", "item_start", "doc_start", "length")

    @F.arrow_udf(MATCHES)
    def found(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.string()), *[(n, pa.int64()) for n in names[1:]]]))
        return pa.array([[dict(zip(names, m, strict=True)) for m in ms] for _, _, raw, offsets in blocks(texts, 4 << 20)
                         for ms in tests.longest(raw, offsets)], kind)

    return found(text)


def _covered(spans: Column) -> Column:
    """Words that the union of the spans covers, in SQL."""
    step = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
                       lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"),
                                             F.greatest(s["end"], x["b"]).alias("end")))
    return step["n"]


def test_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """The benchmark's items (i, t) in blocks of about ``block_bytes`` of text; an item is never cut."""
    items = benchmark.select(benchmark[id_col].cast("string").alias("i"), text_of(benchmark[text_col]).alias("t")).filter("i is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    if n == 1:
        return [items]
    cut = items.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(n)))
    cut = written(cut.repartitionByRange("block").sortWithinPartitions("block"), "items")  # a block reads its own row groups only
    return [cut.filter(F.col("block") == k).select("i", "t") for k in range(n)]


test_blocks.__test__ = False


def _built(block: DataFrame, window: int) -> TestSet:
    """The driver holds one block's set at a time: callers write what it finds before they build the next."""
    return TestSet([(r.i, r.t) for r in block.collect()], window)


def _found(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, text_col: str) -> DataFrame:
    """``docs`` with a column ``_cue_found``."""
    tests = test_blocks(benchmark, block_bytes)
    text = text_of(docs[text_col])
    if len(tests) == 1:
        return docs.withColumn("_cue_found", _hits(_built(tests[0], window), text))
    key = F.sha2(text, 256)
    parts = [written(docs.select(key.alias("k"), _hits(_built(t, window), text).alias("f")).filter("f.n_hit > 0")
                     .groupBy("k").agg(F.first("f").alias("f")), "hits") for t in tests]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    joined = union.groupBy("k").agg(F.max("f.n_words").alias("n_words"), F.flatten(F.collect_list("f.spans")).alias("spans"),
                                    F.array_sort(F.flatten(F.collect_list("f.items"))).alias("items"))
    merged = joined.select(F.col("k").alias("_cue_k"), _covered(F.col("spans")).alias("_cue_n"), F.col("items").alias("_cue_items"),
                           F.col("spans").alias("_cue_spans"))
    none = TestSet([], window)
    out = docs.withColumn("_cue_key", key).withColumn("_cue_own", _hits(none, text))
    out = out.join(merged, out["_cue_key"] == merged["_cue_k"], "left")
    found = F.struct(F.col("_cue_own.n_words").alias("n_words"), F.coalesce("_cue_n", F.lit(0).cast("long")).alias("n_hit"),
                     F.coalesce("_cue_items", F.array().cast("array<string>")).alias("items"), F.col("_cue_spans").alias("spans"))
    return out.select(*[docs[c] for c in docs.columns], found.alias("_cue_found"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row."""
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    f = _found(narrow, benchmark, window, block_bytes, "text").select(F.col("id").alias(id_col), F.col("_cue_found.*"))
    return f.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, item_start, doc_start, length) of every maximal verbatim match, in words."""
    def matches(tests: TestSet) -> DataFrame:
        return docs.select(docs[id_col].alias(id_col), F.explode(_longest(tests, text_of(docs[text_col]))).alias("m")).select(id_col, "m.*")

    blocks_ = test_blocks(benchmark, block_bytes)
    if len(blocks_) == 1:
        return matches(_built(blocks_[0], window))
    parts = [written(matches(_built(t, window)), "matches") for t in blocks_]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no window occurs."""
    return _found(docs, benchmark, window, block_bytes, text_col).filter("_cue_found.n_hit = 0").select(*docs.columns)
