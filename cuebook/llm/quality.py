"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed word n-grams (one and two words), of
word shapes (does the word repeat one of the three before it, its length) and of byte n-grams
(three and five bytes); a softmax over that average gives the score. Training is
stochastic gradient descent in numpy over a bounded sample of labelled rows. The features of
the sample are made on the executors; the driver holds at most ``max_rows`` sparse rows of at
most ``BUCKETS`` numbers. The model that goes to the executors is one float per bucket (the
vectors times the softmax weights), so its size is fixed, and scoring is one pass over whole
texts without a shuffle.

Labels count only from rows outside the held-out fold (``crc32(id as text) % 3 == 1``); label
rows with a null id or label are ignored, several labels of one id count by majority. Labels,
language, source and id are never features. Null and empty texts get the score of the average of
nothing. Repeated rows each get a row; extra columns are ignored; an empty table gives an empty
result. Without labelled rows every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import _TABLE, SPACE_BYTES, blocks, grams, hashes, mix, words
from .common import text_of

BUCKETS = 1 << 16
MAX_ROWS = 1500  # labelled rows that are fitted on at most
CHUNK = 1 << 19  # bytes of text at a time; bounds the temporaries of the byte n-grams
SIZES = (3, 5)
BLANKS = 64  # zero vectors added to each average, so that a word or two do not decide


def _byte_grams(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-byte grams, white space folded to one kind, and the grams before each row."""
    if len(raw) < n:
        return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
    coded = np.where(SPACE_BYTES, _TABLE[0x20], _TABLE)[raw]
    with np.errstate(over="ignore"):
        h = coded[:len(raw) - n + 1].copy()
        for i in range(1, n):
            h *= np.uint64(0x9E3779B97F4A7C17)
            h += coded[i:len(raw) - n + 1 + i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (h >> np.uint64(64 - 16)).astype(np.int32)
    inside = np.zeros(len(raw) + 1, dtype=np.int64)  # grams that cross into the next row do not count
    inside[1:len(bucket) + 1] = 1
    for end in offsets[1:-1]:
        inside[max(0, end - n + 1) + 1:end + 1] = 0
    keep = inside[1:len(bucket) + 1].astype(bool)
    return bucket[keep], np.cumsum(inside)[offsets]


def features(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of (buckets of all rows, number before each row)."""
    starts, ends, rows = words(raw, offsets, SPACE_BYTES)
    h = hashes(raw, starts, ends, lower=False)
    two, bounds = grams(h, rows, 2)
    shift = np.uint64(64 - 16)
    shape = np.minimum(ends - starts, 31).astype(np.uint64)
    place = np.arange(len(h)) - np.repeat(rows[:-1], np.diff(rows))
    for back in (3, 2, 1):
        same = np.zeros(len(h), dtype=bool)
        same[back:] = h[back:] == h[:-back]
        shape = np.where(same & (place >= back), np.uint64(32 * back), shape)
    out = [((mix(h) >> shift).astype(np.int32), rows), ((two >> shift).astype(np.int32), bounds),
           ((mix(shape + np.uint64(1)) >> shift).astype(np.int32), rows)]
    return out + [_byte_grams(raw, offsets, n) for n in SIZES]


def _sparse(text: Column) -> Column:
    """(buckets, weights) of each text, as little-endian 16-bit numbers and 32-bit floats."""

    @F.arrow_udf("struct<i:binary,w:binary>")
    def made(texts: pa.Array) -> pa.Array:
        ids, weights = [], []
        for _, _, raw, offsets in blocks(texts, CHUNK):
            groups = features(raw, offsets)
            for r in range(len(offsets) - 1):
                i, n = np.unique(np.concatenate([b[at[r]:at[r + 1]] for b, at in groups]), return_counts=True)
                ids.append(i.astype("<u2").tobytes())
                weights.append((n / (n.sum() + BLANKS)).astype("<f4").tobytes())
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(weights, pa.binary())], ["i", "w"])

    return made(text)


@dataclass(frozen=True)
class Model:
    """Score = sigmoid(mean of ``weight`` over a text's features + ``bias``)."""

    weight: np.ndarray
    bias: float

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for buckets, at in features(raw, offsets):
            sums = np.zeros(len(buckets) + 1)
            np.cumsum(self.weight[buckets], out=sums[1:], dtype=np.float64)
            total += sums[at[1:]] - sums[at[:-1]]
            n += at[1:] - at[:-1]
        return 1.0 / (1.0 + np.exp(-np.clip(total / (n + BLANKS) + self.bias, -40, 40)))

    def column(self, text: Column) -> Column:
        """The score of a text column, one Arrow pass."""
        model = self

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            parts = [pa.array(model.score(raw, offsets)) for _, _, raw, offsets in blocks(texts, CHUNK)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.float64())

        return scored(text)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 8, epochs: int = 5,
          rate: float = 0.3, seed: int = 7) -> Model:
    """SGD over rows of (buckets, weights), a row at a time; the step is divided by the row's squared length, as rows are averages."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0, 1.0, (BUCKETS, dim)).astype(np.float32)
    soft, bias = np.zeros((2, dim)), np.zeros(2)
    if not len(rows) or len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0 if not len(rows) else 5.0 * (2 * int(labels[0]) - 1))
    share = np.bincount(labels, minlength=2) / len(labels)
    bias[:] = np.log(share)
    prepared = []
    for i, w in rows:
        prepared.append((i, w, float((w * w).sum()) or 1.0))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i, w, square = prepared[r]
            step = rate * (1.0 - done / steps)
            done += 1
            if not len(i):
                continue
            hidden = w @ vectors[i]
            logits = soft @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[r]] -= 1.0
            back = soft.T @ p
            soft -= step * np.outer(p, hidden) / max(float(hidden @ hidden), 1e-6)
            bias -= 0.1 * step * p
            vectors[i] -= np.outer(w, (step / square) * back).astype(np.float32)
    return Model(vectors.astype(np.float64) @ (soft[1] - soft[0]), float(bias[1] - bias[0]))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", **how) -> Model:
    """A model from at most ``max_rows`` labelled rows outside the held-out fold, chosen by a hash of the id."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")) \
        .filter("id is not null and y is not null").filter(~held_out(F.col("id")))
    chosen = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")) \
        .orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_rows)  # bounded, so it can be broadcast
    texts = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("t"))
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max(F.struct("t", "y")).alias("s")) \
        .select("id", "s.y", _sparse(F.col("s.t")).alias("f")).select("id", "y", "f.i", "f.w")
    got = sample.toArrow().sort_by("id")
    rows = [(np.frombuffer(i.as_buffer(), "<u2"), np.frombuffer(w.as_buffer(), "<f4")) for i, w in zip(got["i"], got["w"], strict=True)]
    return train(rows, got["y"].to_numpy().astype(np.int64), **how)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row."""
    return docs.select(docs[id_col].alias(id_col), held_out(docs[id_col]).alias("held_out"),
                       model.column(text_of(docs[text_col])).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model scores at least 0.5."""
    return docs.filter(model.column(text_of(docs[text_col])) >= 0.5)
