"""Token ids of whole texts through a bounded cache of text segments.

A text is cut at safe boundaries: single spaces between two plain characters, where neither
kind of tokenizer can form a token across the cut. Each distinct segment is encoded once
per cache life, so a Zipf-like corpus costs a table lookup per segment; what the table finds by hash is
compared byte by byte. Boundaries next to
white space, or next to characters whose UTF-8 form starts like non-ASCII white space, are not
cut, so the segments there are longer, and still exact.

* ``byte``: byte-level BPE, the space stays at the head of its segment; a single line feed
  between plain characters is a segment of its own.
* ``head``: cut before spaces and single line feeds, which stay at the head of their segments.
* ``piece``: pieces with a word mark; the space is dropped, as the encoder puts one before
  each text it is given.
"""

from __future__ import annotations

import os

import numpy as np

from .bytewords import hashes

_PLAIN = np.ones(256, dtype=bool)
_PLAIN[0x00:0x21] = False
_PLAIN[0x7F] = False
_ODD = np.zeros(256, dtype=bool)
_ODD[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # lead bytes of all non-ASCII white space (and others)


def cut(raw: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, segments before each row, one more at the end) of all rows' segments."""
    n = len(raw)

    def safe(at: np.ndarray) -> np.ndarray:
        at = at[(at > 0) & (at < n - 1)]
        ok = _PLAIN[raw[at - 1]] & _PLAIN[raw[at + 1]] & ~_ODD[raw[at + 1]]
        for back in (1, 2, 3):
            ok &= ~_ODD[raw[np.maximum(at - back, 0)]]
        at = at[ok]
        row = np.searchsorted(offsets, at, side="right") - 1  # neighbours must be in the same row
        return at[(at > offsets[row]) & (at + 1 < offsets[row + 1])]

    spaces = safe(np.flatnonzero(raw == 0x20))
    filled = np.diff(offsets) > 0
    heads = offsets[:-1][filled]
    if kind == "piece":
        starts = np.sort(np.concatenate([heads, spaces + 1]))
        is_head = np.isin(starts, heads, assume_unique=True)
        ends = np.append(starts[1:], n) - np.append(~is_head[1:], False)
    elif kind == "head":
        starts = np.sort(np.concatenate([heads, spaces, safe(np.flatnonzero(raw == 0x0A))]))  # no place twice
        ends = np.append(starts[1:], n)
    else:
        lines = safe(np.flatnonzero(raw == 0x0A))
        starts = np.unique(np.concatenate([heads, spaces, lines, lines + 1]))
        ends = np.append(starts[1:], n)
    return starts.astype(np.int64), ends.astype(np.int64), np.searchsorted(starts, offsets)


class SegmentCache:
    """Open-addressing table from segment hashes to slots; starts anew beyond ``limit`` segments."""

    def __init__(self, limit: int = 1 << 19):
        self.limit, self.bits = limit, limit.bit_length()  # at most half full
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.size = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of the hashes, -1 where unknown."""
        mask, out = np.int64((1 << self.bits) - 1), np.full(len(h), -1, dtype=np.int32)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[at] == h[left])
            out[left[hit]] = slot[hit]
            on = (slot >= 0) & ~hit
            left, at = left[on], (at[on] + 1) & mask
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Slots for new, distinct hashes: consecutive numbers."""
        mask = (1 << self.bits) - 1
        new = np.arange(self.size, self.size + len(h), dtype=np.int32)
        left, at = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.slots[at] < 0)
            _, first = np.unique(at[free], return_index=True)  # one of those that want a place gets it
            won = free[first]
            self.keys[at[won]], self.slots[at[won]] = h[left[won]], new[left[won]]
            on = np.ones(len(left), dtype=bool)
            on[won] = False
            left, at = left[on], (at[on] + 1) & mask
        self.size += len(h)
        return new


class SegmentStore:
    """Slots of segments: one for each distinct text, found by hash and confirmed byte by byte.

    What is kept for a slot is up to ``keep``, which gets new slots with their texts."""

    def __init__(self, limit: int = 1 << 19):
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.cache = SegmentCache(self.limit)
        self.size_of, self.place_of = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.bytes, self.filled = np.zeros(1 << 14, dtype=np.uint8), 0

    def keep(self, numbers: np.ndarray, texts: list[str]) -> None:
        raise NotImplementedError

    @staticmethod
    def room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=a.dtype)])

    def _store(self, numbers: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        parts = [raw[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        size, end = ends - starts, int(numbers[-1]) + 1
        self.size_of, self.place_of = self.room(self.size_of, end), self.room(self.place_of, end)
        self.size_of[numbers], self.place_of[numbers] = size, self.filled + np.cumsum(size) - size
        joined = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.bytes = self.room(self.bytes, self.filled + len(joined))
        self.bytes[self.filled:self.filled + len(joined)] = joined
        self.filled += len(joined)
        self.keep(numbers, [p.decode("utf-8") for p in parts])

    def _differ(self, slots: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Segments whose bytes are not those of their slot."""
        size = ends - starts
        wrong = size != self.size_of[slots]
        like = np.flatnonzero(~wrong)
        before = np.zeros(len(like) + 1, dtype=np.int64)
        np.cumsum(size[like], out=before[1:])
        step = np.arange(int(before[-1]))
        own = raw[step + np.repeat(starts[like] - before[:-1], size[like])]
        kept = self.bytes[step + np.repeat(self.place_of[slots[like]] - before[:-1], size[like])]
        wrong[like[np.searchsorted(before, np.flatnonzero(own != kept), side="right") - 1]] = True
        return np.flatnonzero(wrong)

    def slots(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = hashes(raw, starts, ends, lower=False)
        slots = self.cache.find(h)
        miss = np.flatnonzero(slots < 0)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            if self.cache.size and self.cache.size + len(new) > self.cache.limit:
                self.reset()
                return self.slots(raw, starts, ends)
            if self.cache.size + len(new) > self.cache.limit:  # one block with more than the table holds
                self.cache = SegmentCache(2 * len(new))
            numbers = self.cache.add(new)
            self._store(numbers, raw, starts[miss[first]], ends[miss[first]])
            slots[miss] = numbers[back]
        wrong = self._differ(slots, raw, starts, ends)
        if len(wrong):  # another text has their hash: slots that the table does not name
            numbers = np.arange(self.cache.size, self.cache.size + len(wrong), dtype=np.int32)
            self.cache.size += len(wrong)
            self._store(numbers, raw, starts[wrong], ends[wrong])
            slots[wrong] = numbers
        return slots


class CachedEncoder(SegmentStore):
    """Token ids (``ids=True``) or token counts of segments, each distinct one encoded once."""

    def __init__(self, encode, kind: str, ids: bool, limit: int = 1 << 19):
        self.encode, self.kind, self.ids = encode, kind, ids
        super().__init__(limit)

    def reset(self) -> None:
        super().reset()
        self.counts = np.zeros(1 << 12, dtype=np.int32)
        self.begin = np.zeros(1 << 12, dtype=np.int64)
        self.pool = np.zeros(1 << 14, dtype=np.uint32)
        self.used = 0

    def keep(self, numbers: np.ndarray, texts: list[str]) -> None:
        got = self.encode(texts)
        end = int(numbers[-1]) + 1
        self.counts, self.begin = self.room(self.counts, end), self.room(self.begin, end)
        if self.ids:
            sizes = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
            self.pool = self.room(self.pool, self.used + int(sizes.sum()))
            self.pool[self.used:self.used + int(sizes.sum())] = np.fromiter(
                (i for g in got for i in g), dtype=np.uint32, count=int(sizes.sum()))
            self.begin[numbers] = self.used + np.cumsum(sizes) - sizes
            self.used += int(sizes.sum())
        else:
            sizes = np.asarray(got, dtype=np.int64)
        self.counts[numbers] = sizes

    def count_rows(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        starts, ends, rows = cut(raw, offsets, self.kind)
        total = np.zeros(len(starts) + 1, dtype=np.int64)
        if len(starts):
            slots = self.slots(raw, starts, ends)  # first: it may move the arrays
            np.cumsum(self.counts[slots], out=total[1:])
        return total[rows[1:]] - total[rows[:-1]]

    def rows_ids(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids in one array, and the number of ids before each row (one more at the end)."""
        starts, ends, rows = cut(raw, offsets, self.kind)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        slots = self.slots(raw, starts, ends)
        n = self.counts[slots].astype(np.int64)
        before = np.zeros(len(slots) + 1, dtype=np.int64)
        np.cumsum(n, out=before[1:])
        at = np.arange(int(before[-1])) + np.repeat(self.begin[slots] - before[:-1], n)
        return self.pool[at], before[rows]


def _lines(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_encode(path: str, specials: bool = True):
    """texts -> lists of ids as the ``tokenizers`` file at ``path`` gives them, without added special tokens.

    ``specials``: strings of special tokens inside texts are those tokens, else plain text. Where the same
    vocabulary lies beside it as ranks (``.tiktoken``), plain texts go through that faster encoder, which gives the
    same ids; texts that may hold the string of a special token go through ``tokenizers`` itself."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not specials
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if specials else []
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks) or any(" " in s or "\n" in s for s in special):
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_lines(ranks), special_tokens={})

    def plain(t: str) -> bool:  # only letters of long standing: the two libraries may carry Unicode tables of different age
        return (t.isascii() or max(t) < "ɐ") and not (special and any(s in t for s in special))

    return lambda texts: [fast.encode_ordinary(t) if plain(t) else tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def byte_bpe(path: str, limit: int = 1 << 19) -> CachedEncoder:
    """Ids as the ``tokenizers`` file at ``path`` gives them, without added special tokens."""
    return CachedEncoder(byte_encode(path), "byte", True, limit)


def cuts_pieces(model) -> bool:
    """Whether texts may be cut at spaces: no piece of the model has its word mark behind another
    character, and the model puts the mark before a text."""
    mark = "▁"
    inner = any(mark in model.id_to_piece(i).lstrip(mark) for i in range(model.get_piece_size()))
    return not inner and "".join(model.id_to_piece(i) for i in model.encode("a  a")) == f"{mark}a{mark}{mark}a"


def piece_model(path: str, limit: int = 1 << 19) -> CachedEncoder:
    """Token counts as the sentencepiece model at ``path`` gives them, without begin or end.

    Texts are cut only if the model allows it; else each text is one segment."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if not cuts_pieces(model):
        encoder = CachedEncoder(None, "piece", False, limit)
        encoder.count_rows = lambda raw, offsets: np.array(
            [len(model.encode(raw[a:b].tobytes().decode())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.int64)
        return encoder
    return CachedEncoder(lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], "piece", False, limit)
