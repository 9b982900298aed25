"""Alignment of two vocabularies against a brute force over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cuebook.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each text, by comparing every byte range."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    rows, docs = [], Counter()
    for t in texts:
        a = tok.encode(" " + (t or ""), add_special_tokens=False).ids
        b = model.encode(t or "")
        wa = [alignment.byte_level(tok.id_to_token(i)) for i in a]
        wb = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (t or "")).encode()
        if not t or b"".join(wa) != whole or b"".join(wb) != whole:
            rows.append(None)
            continue

        def ranges(ids, parts):
            at, out = 0, []
            for i, p in zip(ids, parts, strict=True):
                out.append((i, at, at + len(p)))
                at += len(p)
            return out

        ra, rb = ranges(a, wa), ranges(b, wb)
        links, first = [], 0
        for i, s, e in ra:
            while rb[first][2] <= s:
                first += 1
            k = first
            while k < len(rb) and rb[k][1] < e:
                links.append((i, rb[k][0]))
                k += 1
        ends = sorted({e for *_, e in ra} & {e for *_, e in rb})
        groups, last = [], 0
        for end in ends:
            groups.append(",".join(str(i) for i, s, e in ra if last <= s < end) + "|" + ",".join(str(i) for i, s, e in rb if last <= s < end)
                          if len(texts) < 60 and len(t) < 5000 else (last, end))
            last = end
        if groups and isinstance(groups[0], tuple):
            by_a, by_b = defaultdict(list), defaultdict(list)
            for x, r in ((by_a, ra), (by_b, rb)):
                for i, s, _ in r:
                    x[int(np.searchsorted(ends, s, side="right"))].append(str(i))
            groups = [",".join(by_a[g]) + "|" + ",".join(by_b[g]) for g in range(len(ends))]
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
        docs.update(set(links))
    high = defaultdict(int)
    for (a, _), n in docs.items():
        high[a] = max(high[a], n)
    return [(0,) * 6 + ("",) if r is None else
            (r[0], r[1], r[2], len(r[3]), sum(docs[x] == high[x[0]] for x in r[3]), sum(docs[x] for x in r[3]), hashlib.sha256(r[4].encode()).hexdigest())
            for r in rows]


def check(spark, texts, flush=alignment.FLUSH, parts=3):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, t string, n_a int").repartition(parts)
    got = {r[0]: tuple(r[1:]) for r in alignment.align(docs, A, B, flush=flush).collect()}
    assert got == dict(enumerate(brute(texts)))


AWKWARD = [None, "", " ", "\n", "a", " a", "a ", "two  spaces", "line\nfeed\n\nand\ttab\r\nend", "▁mark", "x ▁y z", "é à 中文 字 emoji 👍🏽 end",
           "<|endoftext|> and <s> </s> <unk> <0x41> plain", "zero\x00byte", "nbsp here   em 　 wide", "12345 67 8,90 it's we'll DON'T",
           "same text again", "same text again", "same text", "x" * 3000, "word " * 2000, "ﬁ ligature ① ½ Å", "a\nb\nc d\n e", "combining é ́x"]


def test_awkward_texts(spark):
    check(spark, AWKWARD)


def test_random_texts_small_flush(spark):
    rng = random.Random(3)
    signs = ["a", "b", "the", "ing", " ", " ", "\n", "  ", "é", "中", ".", ",", "'s", "\t", "1", "23", "Über", " ", "##", "$$$", "<s>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    check(spark, texts, flush=50, parts=40)  # several flushes a task, and a tree of two levels


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.select("text").collect()]
    check(spark, texts)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**40, n))
        made = alignment.PairHash.of(alignment.PairHash.build(keys).blobs())
        assert sorted(made.numbers(keys).tolist()) == list(range(len(keys))) and made.size == len(keys)


def test_unknown_pairs_are_seen():
    keys = np.arange(1000, dtype=np.int64) * 7
    rows = []
    shard = alignment.shard_of(keys, 10)
    for s in np.unique(shard).tolist():
        own = keys[shard == s]
        made = alignment.PairHash.build(own)
        at = np.empty_like(own)
        at[made.numbers(own)] = own
        rows.append({"shard": s, "levels": made.blobs(), "keys": at.tobytes(), "counts": (at + 1).tobytes(), "best": np.ones(len(at), bool).tobytes()})
    table = alignment.PairTable(rows, 10)
    assert (table.look_up(keys)[0] == keys + 1).all()
    assert table.look_up(keys)[2].all() and not table.look_up(keys + 1)[2].any()
    aligner = alignment.Aligner(A, B, alignment.PairTable([], 32000))
    with pytest.raises(ValueError, match="not met"):
        aligner.results(np.frombuffer(b"some text", dtype=np.uint8), np.array([0, 9]))
