"""Encoding of a whole corpus by a public tokenizer, as a Spark operator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.bpe import merges

#: Characters that are encoded at once in a worker; a text longer than this is a part of its own.
PART_CHARS = 2_000_000


def parts(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of slices of column of about `most` characters."""
    lengths = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
    first, total = 0, 0
    for k, n in enumerate(lengths):
        if k > first and total + n > most:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


def encode(documents: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """key, ids: the token ids of each text without special tokens; null and empty texts give an empty list.

    `vocabulary` is the path of the tokenizer's file on every worker. Rows with a null key are encoded like others. Texts are
    never cut; strings of special tokens in a text are ordinary text.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(vocabulary)
        for batch in batches:
            for first, end in parts(batch.column(1), PART_CHARS):
                part = batch.slice(first, end - first)
                offsets, ids = table.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
