"""Token counts: batch encoding in Arrow functions that return lengths only.

Each Arrow batch is walked in blocks of about one megabyte of text (batches balanced by bytes,
not by rows); inside a block every text is cut at safe boundaries, so a very long text is
never one call of the encoder, and each distinct segment is encoded once per worker. No shuffle.

Null and empty texts have 0 tokens and 0 bytes. Repeated rows each get a row. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import blocks
from .common import once, text_of
from .segments import byte_bpe, piece_model


def token_count(path: str):
    """An Arrow function text -> number of tokens by the tokenizer file at ``path``
    (``.model``: sentencepiece, ``.json``: tokenizers)."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        encoder = once(("tokens", path), lambda: (piece_model if path.endswith(".model") else byte_bpe)(path))
        parts = [pa.array(encoder.count_rows(raw, offsets)) for _, _, raw, offsets in blocks(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.int64())

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``, whole texts."""
    text = text_of(docs[text_col])
    return docs.select(docs[id_col].alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"),
                       token_count(path)(text).alias("n_tokens")) \
        .withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
