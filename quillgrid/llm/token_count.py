"""Operator 6: token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillgrid.llm import arrays, bpe


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of every text, in one scan without a shuffle.

    Returns ``id_col``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens >
    ``limit``), a row for each input row. A null text counts as empty: 0 bytes,
    0 tokens. Null and repeated ids are kept as they are. Special strings in a
    text count as one token each, as the library does by default. Memory is
    bounded by the longest text and the worker's table of pre-tokens.
    """

    def count(batches):
        for batch in batches:
            for part, data, offs in arrays.chunks(batch, text_col):
                n = bpe.count_chunk(path, data, offs)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias(text_col))
    return src.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
