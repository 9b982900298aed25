"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how usual that is.

A text is encoded with a space before it by a byte-level vocabulary (A) and without by a piece vocabulary
(B, which puts its own mark there), so both cover the same bytes. Byte offsets where a token of A and one of B both end
cut the tokens into groups; tokens whose byte ranges overlap are links. Aligned segments are cached, as texts
are cut where no token can cross (``segments.py``), so a distinct segment is aligned once per worker.

1. First pass: each task counts, for the pairs of ids it meets, the documents that hold them linked, and writes
   the pairs with their counts, sharded by the id of A.
2. The distinct pairs of a shard get a minimal perfect hash: levels of bits, a pair takes the first level where it
   is alone, and the rank of its bit is its number. The pairs lie at their numbers, so a lookup is verified.
3. Counts become dense vectors indexed by the hash, summed along a tree of ``FAN`` children a node.
4. Second pass: documents are aligned again; a segment's counts are looked up when it enters the cache.

The table of pairs, 17 bytes a pair and some bits, goes to every worker. Its size does not follow the corpus: a pair
needs a token of A and one of B whose bytes can overlap, so the two vocabularies bound it. ``most_pairs`` counts them:
31.5 million, 540 MB, for the vocabularies of the registered query, whose table at sf0.1 holds 17,140 pairs.

Texts that are null or empty, or whose tokens' joined bytes differ from the text (a vocabulary that normalises, a
word mark inside the text), have no tokens: zeros, and an empty checksum. Repeated rows are documents of their own. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import blocks, counted, distinct, mix
from .common import once, text_of, written
from .segments import SegmentStore, byte_encode, cut, cuts_pieces

SHARDS = 16  # by the id of A, so that a shard knows the highest count of an id
FAN = 16  # children of a node of the tree
FLUSH = 1 << 20  # pairs that a task of the first pass holds before it writes them
GAMMA = 2.0  # bits of a level for each pair that is left
RESULT = pa.struct([(name, pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])


def byte_level(token: str) -> bytes:
    """The bytes of a byte-level vocabulary entry: printable Latin-1 stands for itself, the rest from U+0100 on."""
    return bytes(_BYTE_OF[c] for c in token)


def _byte_signs() -> dict[str, int]:
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(itself)]
    return {chr(b): b for b in itself} | {chr(0x100 + i): b for i, b in enumerate(others)}


_BYTE_OF = _byte_signs()


class Vocabularies:
    """The two encoders and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.encode_a = byte_encode(a_path, specials=False)
        vocabulary = Tokenizer.from_file(a_path).get_vocab()
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in _BYTE_OF for c in token):
                self.a_bytes[i] = byte_level(token)
        model = self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.spaces = cuts_pieces(model)
        lone = [pieces[i] for i in model.encode("a\nb")] == ["▁a", "<0x0A>", "b"] and not any("\n" in p for p in pieces)
        self.lines = self.spaces and lone and pieces[model.encode("\nb")[0]] == "▁"

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space, which the model puts there itself, or with a line feed that follows other text."""
        got = self.model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [ids if t[0] == " " else ids[1:] for t, ids in zip(texts, got, strict=True)]


def most_pairs(a_bytes: list[bytes], b_bytes: list[bytes]) -> int:
    """An upper bound of the linked pairs of ids: pairs of which a part of one can lie over a part of the other.

    Two tokens overlap if one holds the other, or an end of one is a beginning of the other."""
    from collections import Counter

    total = 0
    for left, right in ((a_bytes, b_bytes), (b_bytes, a_bytes)):
        ends = Counter(t[i:] for t in left for i in range(len(t)))
        heads = Counter(t[:i] for t in right for i in range(1, len(t) + 1))
        total += sum(n * heads[s] for s, n in ends.items() if s in heads)
        whole = Counter(t for t in right if t)
        total += sum(whole[p] for t in left for p in {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)} if p in whole)
    return total


class PairHash:
    """A minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, n = [], 0
        for words in levels:
            count = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.before.append(n + count - np.bitwise_count(words))
            n += int(count[-1])
        self.size = n

    @staticmethod
    def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys.astype(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PairHash:
        levels, left = [], keys
        while len(left):
            bits = -(-int(GAMMA * len(left)) // 64) * 64
            at = cls._place(left, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys; of a key that was not built in, -1 or another's number."""
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (words, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = self._place(keys[left], level, 64 * len(words))
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            found = (words[word] >> bit & np.uint64(1)).astype(bool)
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[found]] = (before[word] + np.bitwise_count(below))[found]
            left = left[~found]
        return out

    def blobs(self) -> list[bytes]:
        return [w.tobytes() for w in self.levels]

    @classmethod
    def of(cls, blobs: list[bytes]) -> PairHash:
        return cls([np.frombuffer(b, dtype=np.uint64) for b in blobs])


def shard_of(keys: np.ndarray, size_b: int) -> np.ndarray:
    return (mix((keys // size_b).astype(np.uint64)) % np.uint64(SHARDS)).astype(np.int64)


class PairTable:
    """What is known of pairs: shards of (hash, keys, counts, whether the count is its A id's highest)."""

    def __init__(self, rows: list[dict], size_b: int):
        self.size_b = size_b
        self.shards = {r["shard"]: (PairHash.of(r["levels"]), np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.int64),
                                    np.frombuffer(r["best"], np.bool_)) for r in rows}

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts, best, whether the first pass has counted the pair) of pairs."""
        count, best, met = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
        shard = shard_of(keys, self.size_b)
        for s in np.unique(shard).tolist():
            if s not in self.shards:
                continue
            mine = np.flatnonzero(shard == s)
            found, known, counts, high = self.shards[s]
            at = found.numbers(keys[mine])
            true = (at >= 0) & (known[at] == keys[mine])
            mine, at = mine[true], at[true]
            count[mine], best[mine], met[mine] = counts[at], high[at], True
        return count, best, met


def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes in a row, length of each part, where each begins)."""
    length = np.array([len(x) for x in parts], dtype=np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), length, np.cumsum(length) - length


class Aligner(SegmentStore):
    """Alignments of segments: for each slot its numbers, its links and its groups as text."""

    def __init__(self, a_path: str, b_path: str, table: PairTable | None = None, limit: int = 1 << 19):
        self.two, self.table = Vocabularies(a_path, b_path), table
        self.size_b = len(self.two.b_bytes)
        self.a_table, self.b_table = _table(self.two.a_bytes), _table(self.two.b_bytes)
        super().__init__(limit)

    NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def reset(self) -> None:
        super().reset()
        self.ok = np.zeros(1 << 12, dtype=bool)
        self.facts = {name: np.zeros(1 << 12, dtype=np.int64 if name == "count_sum" else np.int32) for name in (*self.NUMBERS, "unmet")}
        self.begin = np.zeros(1 << 12, dtype=np.int64)
        self.links, self.used = np.zeros(1 << 14, dtype=np.int64), 0
        self.groups: list[bytes] = []

    def keep(self, numbers: np.ndarray, texts: list[str]) -> None:
        end = int(numbers[-1]) + 1
        self.ok, self.begin = self.room(self.ok, end), self.room(self.begin, end)
        for name, a in self.facts.items():
            self.facts[name] = self.room(a, end)
        ids_a, ids_b = self.two.encode_a(texts), self.two.encode_b(texts)
        own = "".join(texts).encode()
        size = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), dtype=np.int64, count=len(texts))
        a, good_a = self._covering(ids_a, self.a_table, own, size)
        b, good_b = self._covering(ids_b, self.b_table, own, size)
        good = good_a & good_b
        self.ok[numbers] = good
        self.groups.extend([b""] * len(texts))
        some = np.flatnonzero(good)
        if not len(some):
            return
        a, b = (x[np.repeat(good, np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))] for x, ids in ((a, ids_a), (b, ids_b)))
        end_a, end_b = np.cumsum(self.a_table[1][a]), np.cumsum(self.b_table[1][b])
        of_text = np.cumsum(size[some])
        cuts = np.union1d(end_a, end_b)  # between two cuts lies one link
        links = a[np.searchsorted(end_a, cuts)] * self.size_b + b[np.searchsorted(end_b, cuts)]
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        text_of_cut = np.searchsorted(of_text, cuts)
        number = numbers[some]

        def per_text(x: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
            return np.bincount(np.searchsorted(of_text, x), weights=weight, minlength=len(some)).astype(np.int64)

        n_links = per_text(cuts)
        for name, x in (("n_a", per_text(end_a)), ("n_b", per_text(end_b)), ("n_groups", per_text(both)), ("n_links", n_links)):
            self.facts[name][number] = x
        if self.table is not None:
            count, best, met = self.table.look_up(links)
            before = np.concatenate([[0], np.cumsum(count)])
            edge = np.searchsorted(text_of_cut, np.arange(len(some) + 1))
            self.facts["count_sum"][number] = before[edge[1:]] - before[edge[:-1]]
            self.facts["n_best"][number] = np.bincount(text_of_cut, weights=best, minlength=len(some)).astype(np.int64)
            self.facts["unmet"][number] = np.bincount(text_of_cut, weights=~met, minlength=len(some)).astype(np.int64)
            self._spell(a, b, np.searchsorted(end_a, both) + 1, np.searchsorted(end_b, both) + 1, np.searchsorted(of_text, both), number)
        else:
            self.links = self.room(self.links, self.used + len(links))
            self.links[self.used:self.used + len(links)] = links
            self.begin[number] = self.used + np.cumsum(n_links) - n_links
            self.used += len(links)

    @staticmethod
    def _covering(ids: list[list[int]], table: tuple[np.ndarray, np.ndarray, np.ndarray], own: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, whether the bytes of a text's ids are the text), for texts whose bytes are ``own`` in a row."""
        pool, length, place = table
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(count.sum()))
        ends = np.concatenate([[0], np.cumsum(length[flat])])
        edge = np.concatenate([[0], np.cumsum(count)])
        made = ends[edge[1:]] - ends[edge[:-1]]
        good = made == size
        begin = np.cumsum(size) - size
        token = np.repeat(good, count)
        some = flat[token]
        n = length[some]
        to = np.repeat(begin, count)[token] + ends[:-1][token] - np.repeat(ends[edge[:-1]], count)[token]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(to, n) + step
        differ = at[pool[np.repeat(place[some], n) + step] != np.frombuffer(own, dtype=np.uint8)[at]]
        good[np.searchsorted(begin, differ, side="right") - 1] = False
        return flat, good

    def _spell(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, text: np.ndarray, number: np.ndarray) -> None:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
        parts: list[list[str]] = [[] for _ in number]
        i = j = 0
        for p, q, t in zip(to_a.tolist(), to_b.tolist(), text.tolist(), strict=True):
            parts[t].append(",".join(sa[i:p]) + "|" + ",".join(sb[j:q]))
            i, j = p, q
        for n, own in zip(number.tolist(), parts, strict=True):
            self.groups[n] = ";".join(own).encode()

    def rows(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slots of all rows' segments, where each row's begin, whether the row is aligned).

        A row with a segment whose bytes differ is tried once more as a whole."""
        full = np.diff(offsets) > 0
        raw = np.insert(raw, offsets[:-1], 0x20)
        offsets = offsets + np.arange(len(offsets))
        starts, ends, _ = cut(raw, offsets, "head")
        if not self.two.spaces:
            starts, ends = offsets[:-1], offsets[1:]
        elif not self.two.lines:
            head = (raw[starts] == 0x20) | np.isin(starts, offsets[:-1])
            starts = starts[head]
            ends = np.append(starts[1:], len(raw))
        starts, ends = starts.astype(np.int64), ends.astype(np.int64)
        slots = self.slots(raw, starts, ends) if len(starts) else np.zeros(0, np.int32)
        row = np.searchsorted(offsets, starts, side="right") - 1
        bad = np.unique(row[~self.ok[slots]])
        if full[bad].any():
            stay = ~np.isin(row, bad)
            starts = np.sort(np.concatenate([starts[stay], offsets[:-1][bad]]))
            row = np.searchsorted(offsets, starts, side="right") - 1
            slots = self.slots(raw, starts, np.append(starts[1:], len(raw)))
            bad = np.unique(row[~self.ok[slots]])
        aligned = full.copy()
        aligned[bad] = False
        return slots, np.searchsorted(row, np.arange(len(offsets))), aligned

    def pairs(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs linked in the rows, number of rows that hold each)."""
        slots, bounds, aligned = self.rows(raw, offsets)
        row = np.repeat(np.arange(len(aligned)), np.diff(bounds))
        seen = distinct(row[aligned[row]].astype(np.int64) << np.int64(32) | slots[aligned[row]])
        slot, row = seen & np.int64(0xFFFFFFFF), seen >> np.int64(32)
        n = self.facts["n_links"][slot].astype(np.int64)
        before = np.cumsum(n) - n
        links = self.links[np.arange(int(n.sum())) + np.repeat(self.begin[slot] - before, n)]
        span = np.int64(len(self.two.a_bytes) * self.size_b)
        return counted(distinct(np.repeat(row, n) * span + links) % span)

    def results(self, raw: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
        slots, bounds, aligned = self.rows(raw, offsets)
        if self.facts["unmet"][slots[np.repeat(aligned, np.diff(bounds))]].any():  # a segment of rows without tokens only may have such pairs
            raise ValueError("a pair that the first pass has not met: the documents have changed between the passes")
        columns = []
        for name in self.NUMBERS:
            sums = np.concatenate([[0], np.cumsum(self.facts[name][slots], dtype=np.int64)])
            columns.append(pa.array(np.where(aligned, sums[bounds[1:]] - sums[bounds[:-1]], 0)))
        own, groups = slots.tolist(), self.groups
        columns.append(pa.array([hashlib.sha256(b";".join([groups[i] for i in own[a:b]])).hexdigest() if ok else ""
                                 for ok, a, b in zip(aligned.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string()))
        return pa.StructArray.from_arrays(columns, fields=list(RESULT))


def _counted_pairs(texts: DataFrame, a_path: str, b_path: str, flush: int) -> DataFrame:
    """(leaf, shard, keys, counts): what each task has counted, sorted keys as 64-bit numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        leaf = TaskContext.get().partitionId()
        aligner = once(("align", a_path, b_path), lambda: Aligner(a_path, b_path))
        parts: list = []
        held = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(back, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)

        def rows() -> pa.RecordBatch:
            (keys, n), = parts
            shard = shard_of(keys, aligner.size_b)
            own = [np.flatnonzero(shard == s) for s in np.unique(shard)]
            return pa.record_batch([pa.array([leaf] * len(own), pa.int64()), pa.array(np.unique(shard)),
                                    pa.array([keys[i].tobytes() for i in own], pa.binary()),
                                    pa.array([n[i].tobytes() for i in own], pa.binary())], names=["leaf", "shard", "keys", "counts"])

        for batch in batches:
            for _, _, raw, offsets in blocks(batch.column(0)):
                got = aligner.pairs(raw, offsets)
                parts.append(got)
                held += len(got[0])
                if held > flush:
                    parts[:] = [merged()]
                    held = len(parts[0][0])
                    if held > flush // 2:
                        yield rows()
                        parts, held = [], 0
        if held:
            parts = [merged()]
            yield rows()

    return texts.mapInArrow(count, "leaf long, shard long, keys binary, counts binary")


def _hashes(counted: DataFrame) -> DataFrame:
    """(shard, levels, keys): a minimal perfect hash of each shard's distinct pairs, and the pairs at their numbers."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, keys in zip(batch["shard"].to_pylist(), batch["keys"].to_pylist(), strict=True):
                own = np.frombuffer(keys, np.int64)
                yield pa.record_batch([pa.array(np.full(len(own), shard)), pa.array(own)], names=["shard", "key"])

    def build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        keys = np.sort(t["key"].to_numpy())
        made = PairHash.build(keys)
        at = np.empty_like(keys)
        at[made.numbers(keys)] = keys
        return pa.table({"shard": [key[0].as_py()], "levels": pa.array([made.blobs()], pa.list_(pa.binary())), "keys": pa.array([at.tobytes()], pa.binary())})

    distinct = counted.select("shard", "keys").mapInArrow(apart, "shard long, key long").distinct()
    return distinct.groupBy("shard").applyInArrow(build, "shard long, levels array<binary>, keys binary")


def _summed(counted: DataFrame, hashes: list[dict], leaves: int) -> DataFrame:
    """(shard, counts): dense vectors indexed by the shard's hash, summed along the tree."""
    shared = counted.sparkSession.sparkContext.broadcast({r["shard"]: r["levels"] for r in hashes})
    name = uuid.uuid4().hex

    def dense(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        found = once(("pairs", name, shard), lambda: PairHash.of(shared.value[shard]))
        total = np.zeros(found.size, dtype=np.int64)
        for keys, n in zip(t["keys"], t["counts"], strict=True):
            total[found.numbers(np.frombuffer(keys.as_buffer(), np.int64))] += np.frombuffer(n.as_buffer(), np.int64)
        return pa.table({"node": [key[1].as_py()], "shard": [shard], "counts": pa.array([total.tobytes()], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(n.as_buffer(), np.int64) for n in t["counts"])
        return pa.table({"node": [key[1].as_py()], "shard": [key[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "node long, shard long, counts binary"
    tree = counted.withColumn("node", F.floor(F.col("leaf") / FAN)).groupBy("shard", "node").applyInArrow(dense, schema)
    nodes = -(-leaves // FAN)
    while nodes > 1:
        tree = tree.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("shard", "node").applyInArrow(add, schema)
        nodes = -(-nodes // FAN)
    return tree.select("shard", "counts")


def _marked(hashes: DataFrame, sums: DataFrame, size_b: int) -> DataFrame:
    """(shard, levels, keys, counts, best): whether a pair's count is the highest of its A id, which lies in one shard."""

    @F.arrow_udf("binary")
    def best(keys: pa.Array, counts: pa.Array) -> pa.Array:
        out = []
        for k, n in zip(keys, counts, strict=True):
            a, n = np.frombuffer(k.as_buffer(), np.int64) // size_b, np.frombuffer(n.as_buffer(), np.int64)
            high = np.zeros(int(a.max()) + 1, dtype=np.int64)
            np.maximum.at(high, a, n)
            out.append((high[a] == n).tobytes())
        return pa.array(out, pa.binary())

    return hashes.join(sums, "shard").withColumn("best", best("keys", "counts"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", flush: int = FLUSH) -> list[dict]:
    """Rows (shard, levels, keys, counts, best) for ``PairTable``: of each pair of ids the documents that hold it linked."""
    counted = written(_counted_pairs(docs.select(text_of(docs[text_col]).alias("t")), a_path, b_path, flush), "pairs")
    leaves = counted.agg(F.max("leaf")).first()[0]
    if leaves is None:
        return []
    hashes = written(_hashes(counted), "pair-hashes")
    sums = written(_summed(counted, [r.asDict() for r in hashes.select("shard", "levels").collect()], leaves + 1), "pair-counts")
    return [r.asDict() for r in _marked(hashes, sums, _size(b_path)).collect()]


def _size(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", flush: int = FLUSH) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row, whole texts."""
    spark = docs.sparkSession
    rows = spark.sparkContext.broadcast(pair_counts(docs, a_path, b_path, text_col, flush))
    size_b, name = _size(b_path), uuid.uuid4().hex

    @F.arrow_udf("struct<n_a:long,n_b:long,n_groups:long,n_links:long,n_best:long,count_sum:long,groups_sha256:string>")
    def aligned(texts: pa.Array) -> pa.Array:
        aligner = once(("aligned", name), lambda: Aligner(a_path, b_path, PairTable(rows.value, size_b)))
        parts = [aligner.results(raw, offsets) for _, _, raw, offsets in blocks(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], RESULT)

    return docs.select(docs[id_col].alias(id_col), aligned(text_of(docs[text_col])).alias("_cue")).select(id_col, "_cue.*")
