"""MinHash near-duplicate components with odd sketches.

1. One Arrow pass over whole texts makes, for each row, the set of its distinct word shingles (as
   64-bit hashes), ``SAMPLES`` MinHash values, their ``BANDS`` band hashes, an odd sketch (each value
   flips one of ``BITS`` bits, so equal values cancel in the XOR of two sketches) and a 128-bit
   fingerprint of the set. Rows with one fingerprint are one class, its smallest id stands for it.
2. Classes that share a band meet through the smallest id of the band's bucket: a star, never all
   pairs. Connected components of the stars are families; a link at the threshold leaves a
   family with a probability of 1e-7 at a similarity of 0.8, of 1e-10 at 0.85 (``(1 - s**5)**40``).
3. Families are dealt into blocks by a hash, bounded in rows and in shingles. A block's task compares
   sketches; pairs whose XOR count allows the threshold are confirmed on the full sets, unless they
   are already connected. Blocks of one family then meet pairwise, save those that lie in
   one component already, so a large family costs no row per pair.

Links are ``100 * intersection >= percent * union``. Null and empty texts, and texts without words,
have no shingles and no links. Rows with one id count as one document,
whose shingles are those of one of them; rows with a null id are linked with nothing. Extra columns are ignored by ``near_duplicates`` and
kept by ``keep_one``. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import SPACE_BYTES, blocks, grams, hashes, mix, words
from .common import text_of, written
from .graph import components, counted

ROWS, BANDS, BITS = 5, 40, 512
SAMPLES = ROWS * BANDS
SLACK = 0.25  # a pair whose estimate is further below the threshold is no candidate: over six deviations
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20
_RNG = np.random.default_rng(41)
_A = _RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes with repeats, where each row's begin)."""
    starts, ends, rows = words(raw, offsets, SPACE_BYTES)
    return grams(hashes(raw, starts, ends), rows, k)


def sketches(values: np.ndarray) -> np.ndarray:
    """Odd sketches (rows x BITS/8 bytes) of MinHash values (rows x SAMPLES)."""
    bit = mix((values.astype(np.uint64) << np.uint64(10)) + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(BITS)
    flips = np.zeros((len(values), BITS), dtype=np.uint8)
    np.add.at(flips, (np.repeat(np.arange(len(values)), SAMPLES), bit.ravel().astype(np.int64)), 1)
    return np.packbits(flips & 1, axis=1)


def most_flips(threshold: float) -> int:
    """The largest XOR count whose estimate ``1 + BITS / (4 SAMPLES) * ln(1 - 2 count / BITS)`` is at least ``threshold``."""
    counts = np.arange(BITS // 2)
    return int(np.flatnonzero(1 + BITS / (4 * SAMPLES) * np.log(1 - 2 * counts / BITS) >= threshold)[-1])


def _signatures(text: Column, k: int) -> Column:
    @F.arrow_udf("struct<n:long,k1:long,k2:long,bands:array<long>,sketch:binary>")
    def made(texts: pa.Array) -> pa.Array:
        out = []
        for _, _, raw, offsets in blocks(texts):
            h, bounds = shingle_sets(raw, offsets, k)
            full = np.flatnonzero(np.diff(bounds))
            n, key = np.zeros(len(offsets) - 1, dtype=np.int64), np.zeros((len(offsets) - 1, 2), dtype=np.uint64)
            for r in full:
                own = np.unique(h[bounds[r]:bounds[r + 1]])
                n[r] = len(own)
                key[r] = mix(own).sum(dtype=np.uint64), mix(own ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
            values = np.empty((len(full), SAMPLES), dtype=np.uint32)
            x = (h >> np.uint64(32)).astype(np.uint32)
            for j in range(SAMPLES if len(full) else 0):
                values[:, j] = np.minimum.reduceat(x * _A[j] + _B[j], bounds[full])
            band = np.zeros((len(full), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for j in range(ROWS):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + values[:, j::ROWS])
            odd = sketches(values)
            bands: list = [[]] * (len(offsets) - 1)
            marks = [b""] * (len(offsets) - 1)
            for i, r in enumerate(full.tolist()):
                bands[r], marks[r] = band[i].view(np.int64), odd[i].tobytes()
            key = key.view(np.int64)
            out.append(pa.StructArray.from_arrays(
                [pa.array(n), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["n", "k1", "k2", "bands", "sketch"]))
        return pa.chunked_array(out).combine_chunks() if out else pa.array([], SIGNATURE)

    return made(text)


SIGNATURE = pa.struct([("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _sets(text: Column, k: int) -> Column:
    """The sorted distinct shingle hashes of a text, 8 bytes each."""

    @F.arrow_udf("binary")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(h[a:b]).tobytes() for _, _, raw, offsets in blocks(texts)
                         for h, bounds in (shingle_sets(raw, offsets, k),) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())

    return made(text)


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up


def join_sets(sets: list[np.ndarray], odd: np.ndarray, group: np.ndarray, side: np.ndarray | None, percent: int) -> np.ndarray:
    """Component numbers (smallest index) of documents after linking all pairs that reach ``percent``.

    ``group`` are components known before; with ``side``, only pairs of different sides are compared."""
    n = len(sets)
    union = _Union(n)
    union.up = np.unique(group, return_index=True)[1][np.unique(group, return_inverse=True)[1]]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    dense = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
    mark = np.zeros(int(max((d.max() for d in dense), default=0)) + 1, dtype=np.int64)
    most = most_flips(percent / 100 - SLACK)
    words64 = odd.view(np.uint64)
    for u in range(n - 1):
        roots = union.roots()
        rest = roots[u + 1:] != roots[u]
        if side is not None:
            rest &= side[u + 1:] != side[u]
        rest &= (100 * np.minimum(size[u + 1:], size[u]) >= percent * np.maximum(size[u + 1:], size[u]))
        v = np.flatnonzero(rest) + u + 1
        if len(v):
            v = v[np.bitwise_count(words64[v] ^ words64[u]).sum(axis=1) <= most]
        if not len(v):
            continue
        mark[dense[u]] = 1
        common = np.add.reduceat(mark[np.concatenate([dense[i] for i in v])], np.cumsum(size[v]) - size[v])
        mark[dense[u]] = 0
        for i in v[(100 + percent) * common >= percent * (size[u] + size[v])].tolist():
            a, b = union.root(u), union.root(i)
            union.up[max(a, b)] = min(a, b)
    return union.roots()


def _linked(t: pa.Table, percent: int, cross: bool) -> pa.Table:
    """(id, root): documents of a block, or of two blocks, and the smallest id each is connected to here."""
    t = t.sort_by("id")
    sets = [np.frombuffer(x, dtype=np.uint64) for x in t["set"].to_pylist()]
    odd = np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype=np.uint8).reshape(len(sets), BITS // 8)
    group = np.unique(np.array([str(x) for x in t["comp"].to_pylist()]), return_inverse=True)[1]
    root = join_sets(sets, np.ascontiguousarray(odd), group, t["side"].to_numpy() if cross else None, percent)
    return pa.table({"id": t["id"], "root": t["id"].take(pa.array(root))})


def _blocks(df: DataFrame, by: list[str], docs: int, shingles: int) -> DataFrame:
    """``df`` with ``block``: a hash of the id modulo what the group needs for bounded blocks."""
    need = df.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / docs), F.ceil(F.sum("n") / shingles), F.lit(1)).alias("_cue_blocks"))
    return df.join(need, by).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("_cue_blocks"))).drop("_cue_blocks")


def _across(members: DataFrame, percent: int, id_type: str, docs: int, shingles: int) -> DataFrame:
    """Links between blocks of one family: rows (id, family, comp, n, sketch, set) -> (id, root).

    A component of many documents gets blocks of its own, the others share blocks; two blocks of
    one component are not compared."""
    size = members.groupBy("family", "comp").agg(F.count("*").alias("_cue_size"))
    own = members.join(size, ["family", "comp"]) \
        .withColumn("pure", F.when(F.col("_cue_size") >= docs, F.col("comp"))).drop("_cue_size")
    unit = F.sha2(F.concat_ws("|", F.coalesce(F.col("pure").cast("string"), F.lit("")), F.col("block").cast("string")), 256)
    own = _blocks_null(own, docs, shingles).withColumn("unit", unit)
    own = written(own.drop("block"), "units")
    units = own.groupBy("family", "unit").agg(F.first("pure").alias("pure"))
    left = units.select("family", F.col("unit").alias("u1"), F.col("pure").alias("p1"))
    right = units.select("family", F.col("unit").alias("u2"), F.col("pure").alias("p2"))
    pairs = left.join(right, "family").filter("u1 <= u2").filter(~F.coalesce(F.col("p1") == F.col("p2"), F.lit(False)))
    ends = pairs.select("family", "u1", "u2", F.col("u1").alias("unit"), F.lit(0).alias("side")) \
        .unionAll(pairs.filter("u1 < u2").select("family", "u1", "u2", F.col("u2").alias("unit"), F.lit(1).alias("side")))
    rows = own.join(ends, ["family", "unit"]).withColumn("side", F.when(F.col("u1") == F.col("u2"), F.xxhash64("comp")).otherwise(F.col("side")))
    return rows.groupBy("family", "u1", "u2").applyInArrow(lambda t: _linked(t, percent, True), schema=f"id {id_type}, root {id_type}")


def _blocks_null(own: DataFrame, docs: int, shingles: int) -> DataFrame:
    """As ``_blocks``, by family and ``pure``, where a null counts as a value."""
    key = F.coalesce(F.col("pure").cast("string"), F.lit(""))
    return _blocks(own.withColumn("_cue_pure", key), ["family", "_cue_pure"], docs, shingles).drop("_cue_pure")


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
                    block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row."""
    rows = _decided(docs, k, percent, id_col, text_col, block_docs, block_shingles)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), "kept")


def _decided(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, block_docs: int = BLOCK_DOCS,
             block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, n, k1, k2, root, kept) for each row; k1 and k2 are the fingerprint of its set."""
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("t"))
    signed = written(texts.select("id", _signatures(F.col("t"), k).alias("s")).select("id", "s.*"), "signatures")
    usable = signed.filter("n > 0 and id is not null")
    classes = written(usable.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "classes")

    spread = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("rep").alias("center"), F.count("*").alias("size")).filter("size > 1").drop("size")
    stars = spread.join(shared, "bucket").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct()
    families = written(components(stars).select(F.col("node").alias("id"), F.col("root").alias("family")), "families")

    odd = signed.join(counted(families), "id").groupBy("id").agg(F.max("family").alias("family"), F.max("sketch").alias("sketch"), F.max("n").alias("n"))
    dealt = written(_blocks(odd, ["family"], block_docs, block_shingles), "dealt")
    sets = texts.join(counted(dealt.select("id")), "id").select("id", _sets(F.col("t"), k).alias("set")).groupBy("id").agg(F.max("set").alias("set"))
    members = written(sets.join(dealt, "id"), "members")
    inside = written(members.withColumn("comp", F.col("id")).groupBy("family", "block")
                     .applyInArrow(lambda t: _linked(t, percent, False), schema=f"id {id_type}, root {id_type}"), "inside")
    roots = inside
    wide = members.filter("block > 0").select("family").distinct()
    if not wide.isEmpty():
        split = members.join(wide, "family", "left_semi").join(inside, "id").withColumnRenamed("root", "comp")
        across = written(_across(split, percent, id_type, block_docs // 2, block_shingles // 2).filter("id <> root"), "across")
        found = components(inside.unionAll(across).filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
        roots = inside.join(found, inside["id"] == found["node"], "left").select("id", F.coalesce(found["root"], inside["root"]).alias("root"))

    named = classes.select("k1", "k2", "rep").join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left") \
        .select("k1", "k2", F.coalesce("root", "rep").alias("root"))
    own = signed.select("id", "n", "k1", "k2", F.when(F.col("id").isNull() | (F.col("n") == 0), True).otherwise(False).alias("alone"))
    joined = own.filter("not alone").join(named, ["k1", "k2"]).select("id", "n", "k1", "k2", "root") \
        .unionAll(own.filter("alone").select("id", "n", "k1", "k2", F.col("id").alias("root")))
    return joined.withColumn("kept", F.coalesce(F.col("id") == F.col("root"), F.lit(True)))


def keep_one(docs: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of the document with the smallest id of each component.

    An id that is on different texts does not say which of them is the copy: its rows all stay."""
    gone = written(_decided(docs, k, percent, id_col, text_col).groupBy("id")
                   .agg(F.max("kept").alias("kept"), F.min("k1").alias("a1"), F.max("k1").alias("b1"), F.min("k2").alias("a2"), F.max("k2").alias("b2"))
                   .filter("not kept and a1 = b1 and a2 = b2").select(F.col("id").alias("_cue_gone")), "gone")
    return docs.join(counted(gone), docs[id_col] == F.col("_cue_gone"), "left_anti")
