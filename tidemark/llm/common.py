"""What the operators here share: Arrow batches in, Arrow batches out, and texts as UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def col(name: str) -> Column:
    """A column by its plain name, which may hold dots, spaces and quotes."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_key(docs: DataFrame, key: str, rest: str) -> StructType:
    """A schema of docs' key column, whatever its name, and further columns in DDL."""
    return StructType([docs.schema[key], *StructType.fromDDL(rest).fields])


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow for columns of any name, which it can't resolve itself: run takes them by place. A worker gives back what a task no longer uses."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(tidy, schema)


def give_back() -> None:
    """Returns freed memory to the system. Workers serve many tasks, and what their allocators keep adds up beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass


def per_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], schema: str | StructType) -> DataFrame:
    """df through a function of record batches. make() runs once in each task and may keep state there.

    The function returns columns in the schema's order, or None for no rows.
    """
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield pa.RecordBatch.from_arrays([x.cast(k.type) if isinstance(x, pa.Array) else pa.array(x, k.type) for x, k in zip(out, kinds, strict=True)], schema=kinds)

    return in_arrow(df, run, schema)


def _arrow(schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def utf8(column: pa.Array) -> Iterator[bytes]:
    """Each text's bytes, one at a time; null is empty."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


_TOKENIZERS = {"byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"}


def tokenizer_path(name: str) -> str:
    """Where this machine has a public tokenizer's file; any other name is taken as a path."""
    if name not in _TOKENIZERS:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_bytes(name: str) -> bytes:
    return Path(tokenizer_path(name)).read_bytes()
