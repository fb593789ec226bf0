"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import byte_lengths, slices
from frostline.llm.tokens import encoder, tokenizer_path

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, batch_bytes: int = 2 << 20
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text).

    One scan without a shuffle. An Arrow batch is encoded in pieces of about `batch_bytes` of text, so that many short
    texts share a call and long ones do not pile up; a long text that the library itself must encode is cut at safe
    boundaries. A null text counts as empty: no bytes, no tokens. Repeated rows and null ids give a row each; other
    columns are ignored.
    """
    path = tokenizer_path(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches, "text", batch_bytes):
            n = own.count([t or "" for t in batch.column("text").to_pylist()])
            columns = [batch.column("doc_id"), byte_lengths(batch.column("text")), n, n > limit]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], SCHEMA_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, SCHEMA)


SCHEMA_NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
