"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that separate words and are stripped from lines: [\x20\x09-\x0D].
BLANK = "\t\n\x0b\x0c\r "


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; overridable by QUERN_TOKENIZERS."""
    folder = os.environ.get("QUERN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


_resident: dict[object, object] = {}


def resident(key, make: Callable[[], object]):
    """A worker's one large object (a model, a tokenizer): made once, dropped when another is asked for."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts as empty ones: other columns cannot clash or cost."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that few texts are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def per_batch(
    docs: DataFrame, schema: str | T.StructType, start: Callable[[], Callable[[pa.RecordBatch], dict | None]]
) -> DataFrame:
    """mapInArrow where ``start`` runs once a task and returns the function for each batch.

    That function returns a dict of column values (lists or arrays) by name, or None.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kind)
        f = None
        for batch in sliced(batches):
            f = f or start()
            out = f(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[x.name], type=x.type) for x in target], schema=target
                )

    return docs.mapInArrow(run, kind)


def passing(docs: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, for which the batch function gives True."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in sliced(batches):
            f = f or start()
            yield batch.filter(pa.array(np.asarray(f(batch), dtype=bool)))

    return docs.mapInArrow(run, docs.schema)


def texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


def fold(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    import zlib

    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus
