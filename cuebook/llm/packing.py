"""Cost-balanced packing of whole texts into sequences of a fixed number of tokens.

A document is its token ids and one end id. Its full pieces of ``capacity`` ids each fill a
sequence; what remains (fewer than ``capacity`` ids) is packed with the remains of other
documents. These are dealt into groups of about ``group_docs`` documents by a hash of the id and the remains, so
no group grows with the table, and a group is packed in one task. Rows that are equal in both are numbered where they are
encoded, in each Arrow batch, and dealt by that number too, so copies spread like other rows:

* the cost of a piece of n tokens is ``linear * n + quadratic * n**2`` (attention inside a document);
* the group opens exactly the sequences its tokens need: full ones, and the rest as powers of
  two, which need no padding;
* documents in descending length go to the lowest-cost sequence that still holds them whole; one
  that fits nowhere is cut, its first part filling the lowest-cost open sequence.

So no token is lost and none is padding. Texts are encoded once; only the remains (two or four
bytes an id) are shuffled, full pieces carry their checksum.

Null and empty texts are the end id alone. Repeated rows are packed each. Extra columns are
ignored. An empty table gives an empty result. A result depends on the rows, not on where
they lie, unless ids are null or rows repeat.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import blocks
from .common import once, text_of
from .segments import byte_bpe

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def _encoded(path: str, end_id: int, capacity: int):
    """(text, id as a number) -> (doc_tokens, checksums of the full pieces, ids of the remains as little-endian 32 bits,
    number among equal rows of the Arrow batch)."""

    @F.arrow_udf("struct<doc_tokens:long,full:array<long>,rest:binary,again:int>")
    def encode(texts: pa.Array, keys: pa.Array) -> pa.Array:
        encoder = once(("pack", path), lambda: byte_bpe(path))
        tokens, full, rest, again = [], [], [], []
        seen: Counter = Counter()
        for _, _, raw, offsets in blocks(texts):
            ids, before = encoder.rows_ids(raw, offsets)
            for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
                own = np.append(ids[a:b], end_id).astype("<u4")
                whole = len(own) // capacity * capacity
                tokens.append(len(own))
                full.append([zlib.crc32(own[i:i + capacity].tobytes()) for i in range(0, whole, capacity)])
                rest.append(own[whole:].tobytes())
        for equal in zip(keys.to_pylist(), rest, strict=True):
            again.append(seen[equal])
            seen[equal] += 1
        return pa.StructArray.from_arrays(
            [pa.array(tokens, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.binary()), pa.array(again, pa.int32())],
            ["doc_tokens", "full", "rest", "again"])

    return encode


def open_sequences(total: int, capacity: int) -> np.ndarray:
    """Room of the sequences that hold ``total`` tokens: full ones, then powers of two."""
    rest = total % capacity
    return np.array([capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if rest >> k & 1],
                    dtype=np.int64)


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start in its remains, length, sequence, offset) for remains in descending length."""
    room = open_sequences(int(lengths.sum()), capacity)
    used, cost = np.zeros_like(room), np.zeros(len(room))
    placed = []
    for doc, n in enumerate(lengths.tolist()):
        start = 0
        while n:
            left = room - used
            fits = left >= n
            k = int(np.argmin(np.where(fits if fits.any() else left > 0, cost, np.inf)))
            take = min(n, int(left[k]))
            placed.append((doc, start, take, k, int(used[k])))
            used[k] += take
            cost[k] += linear * take + quadratic * take * take
            start, n = start + take, n - take
    return placed


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, linear: float = 1.0,
         quadratic: float = 1.0 / 1024, group_docs: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost)."""
    groups = max(1, -(-docs.count() // group_docs))
    id_type = docs.schema[id_col].dataType.simpleString()
    encoded = docs.select(docs[id_col].alias("id"), _encoded(path, end_id, capacity)(text_of(docs[text_col]), F.xxhash64(docs[id_col])).alias("e"))
    # Null ids are dealt by row number, so that they do not meet in one group.
    key = F.when(F.col("id").isNull(), F.monotonically_increasing_id().cast("string")).otherwise(F.col("id").cast("string"))
    dealt = encoded.select(F.pmod(F.xxhash64(key, F.col("e.rest"), F.col("e.again")), F.lit(groups)).alias("part"), "id", "e.*")

    def one_group(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids, tokens = t["id"].to_pylist(), t["doc_tokens"].to_numpy()
        full, rest = t["full"].to_pylist(), [np.frombuffer(x, dtype="<u4") for x in t["rest"].to_pylist()]
        rows, base = [], int(key[0].as_py()) << 32
        seq = 0
        price = linear * capacity + quadratic * capacity * capacity
        order = sorted(range(len(ids)), key=lambda i: (-len(rest[i]), str(ids[i]), rest[i].tobytes(), int(tokens[i]), full[i]))
        for i in order:
            for n, crc in enumerate(full[i]):
                rows.append((ids[i], n * capacity, capacity, crc, int(tokens[i]), base + seq, 0, price))
                seq += 1
        some = [i for i in order if len(rest[i])]
        for d, start, n, k, offset in balance(np.array([len(rest[i]) for i in some], dtype=np.int64), capacity, linear, quadratic):
            i = some[d]
            crc = zlib.crc32(rest[i][start:start + n].tobytes())
            rows.append((ids[i], len(full[i]) * capacity + start, n, crc, int(tokens[i]), base + seq + k, offset,
                         linear * n + quadratic * n * n))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        types = [t.schema.field("id").type] + [pa.int64()] * 6 + [pa.float64()]
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
        return pa.table([pa.array(c, type=x) for c, x in zip(columns, types, strict=True)], names=names)

    return dealt.groupBy("part").applyInArrow(one_group, schema=f"`{id_col}` {id_type}, {PIECES}")
