"""No text is lost to a repeated or null id, and no text gets another's tokens or words by its hash."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from cuebook.llm import bytewords, decontaminate, exact_dedup, odd_sketch, segments, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")


def thue_morse(n):
    one = "".join("at"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("at", "ta"))


ROWS = [(None, "x"), (5, "x"), (None, "y"), (7, "p"), (9, "p"), (7, "q")]


@pytest.mark.parametrize("order", [0, 1, 2])
def test_exact_copies_keep_every_text(spark, order):
    rows = list(itertools.islice(itertools.permutations(ROWS), order * 200, None))[0]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in exact_dedup.keep_last(docs).collect()]
    assert sorted(t for _, t in kept) == ["p", "q", "x", "y"]
    assert set(kept) == {(5, "x"), (None, "y"), (9, "p"), (7, "q")}


def test_near_copies_keep_every_text_of_a_repeated_id(spark):
    base = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(3, base[0]), (5, base[0] + " more"), (5, base[1]), (8, base[1] + " more"), (9, base[2]), (9, base[2]), (None, base[3]), (10, base[2] + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {tuple(r) for r in odd_sketch.keep_one(docs, k=5, percent=80).collect()}
    assert {(3, base[0]), (5, base[1]), (9, base[2]), (None, base[3])} <= kept
    assert (10, base[2] + " z") not in kept


def test_long_spans_of_one_polynomial_hash(spark):
    a, b = thue_morse(1024)
    raw = np.frombuffer((a + " " + b).encode(), dtype=np.uint8)
    h = bytewords.hashes(raw, np.array([0, 1025]), np.array([1024, 2049]))
    assert h[0] != h[1]
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b} {a}"), (4, f"{b} {a} {b}")], "doc_id long, text string").coalesce(1)
    import sentencepiece
    from tokenizers import Tokenizer

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got == {r.doc_id: len(model.encode(r.text)) for r in docs.collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, before = segments.byte_bpe(public_tokenizers.path("byte_bpe_50k.json")).rows_ids(raw, np.array([0, 1024, 2049]))
    assert ids[:before[1]].tolist() == tok.encode(a).ids and ids[before[1]:].tolist() == tok.encode(" " + b).ids
    assert all(r.component_id == r.doc_id for r in odd_sketch.near_duplicates(docs).collect())
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    hit = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, bench, window=10).collect()}
    assert hit == {1: 1, 2: 0, 3: 2, 4: 1}


def test_slots_are_confirmed_by_bytes(monkeypatch):
    """With a hash that says nothing, every segment still gets its own ids."""
    monkeypatch.setattr(segments, "hashes", lambda raw, starts, ends, lower: (ends - starts).astype(np.uint64) << np.uint64(40))
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["the cat and the dog ran far", "cat the far and dog", "", "ran the cat"]
    encoder, tok = segments.byte_bpe(path), Tokenizer.from_file(path)
    for _ in range(2):
        for _, _, raw, offsets in bytewords.blocks(pa.array(texts)):
            ids, before = encoder.rows_ids(raw, offsets)
            assert [ids[a:b].tolist() for a, b in itertools.pairwise(before)] == [tok.encode(t).ids for t in texts]
