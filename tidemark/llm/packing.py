"""Token ids packed into rows of one length by best-fit decreasing, and written as binary files.

Each task takes its documents in blocks of bounded size, splits what is longer than a row, and
puts each segment into the fullest row that still holds it; a segment tree over the capacities
finds that row. No rows move between tasks.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructField, StructType

from tidemark.llm.common import col, in_arrow, tokenizer_bytes
from tidemark.llm.warc import _put
from tidemark.session import shared_dir

LENGTH = 2048
#: Tokens that one task packs at a time, about; a longer document still goes whole into one block.
BLOCK_TOKENS = 4_000_000
FIELDS = "file string, row_no int, n_tokens int, offsets array<int>, cu_seqlens array<int>, position_resets array<int>, ids_sha256 string"


class CapacityTree:
    """Rows by how much they still hold. Each tree node tells whether any row is below it."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, row) of the least capacity that holds size, out of the tree; None if no row does."""
        i = size + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        row = self.rows[capacity].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of positions in sizes, none longer than length in sum. Sizes are 1 to length; equal ones keep their order."""
    tree, rows = CapacityTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            rows.append([])
            found = length, len(rows) - 1
        capacity, row = found
        rows[row].append(i)
        tree.put(capacity - sizes[i], row)
    return rows


def split(n: int, length: int) -> list[tuple[int, int]]:
    """(offset, size) of a document's segments, all but the last of full length."""
    return [(at, min(length, n - at)) for at in range(0, n, length)]


def pack(documents: list[np.ndarray], length: int, pad: int, kind) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
    """The id matrix, padded at the ends of rows, and each row's (document, offset, size) in order."""
    segments = [(d, at, n) for d, ids in enumerate(documents) for at, n in split(len(ids), length)]
    rows = best_fit_decreasing([n for _, _, n in segments], length)
    matrix, layout = np.full((len(rows), length), pad, kind), []
    for r, row in enumerate(rows):
        at = 0
        for d, offset, n in (segments[i] for i in row):
            matrix[r, at : at + n] = documents[d][offset : offset + n]
            at += n
        layout.append([segments[i] for i in row])
    return matrix, layout


def byte_pair_encoder(name: str):
    """(encode, number of ids) of a public rank file; the first free id pads."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, tokenizer_bytes(name).splitlines())}
    e = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return e.encode_ordinary, max(ranks.values()) + 1


def packed(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str | None = None, length: int = LENGTH, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Writes the packed rows of docs into folder (a new shared one if None) and returns one row for each of them.

    A file ids-*.npy holds a block's matrix, in two bytes an id where the vocabulary allows; the
    returned table, which is written beside as `layout`, has for each matrix row its segments'
    keys, their offsets in the documents, cumulative lengths, the places where positions start
    anew, and the SHA-256 of the row's unpadded ids. Null and empty texts have no tokens and so
    no segment; keys may be null or repeated; an empty table makes no file. A task that runs again
    writes the same files.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, pad = byte_pair_encoder(tokenizer)
        width = np.dtype(np.uint16 if pad < 1 << 16 else np.uint32)
        task, made = TaskContext.get().partitionId(), 0
        keys, documents, total, key_type = [], [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal made, keys, documents, total
            matrix, layout = pack(documents, length, pad, width)
            path = f"{folder}/ids-{task:06d}-{made:05d}.npy"
            out = io.BytesIO()
            np.save(out, matrix)
            _put(path, out.getvalue())
            cols: list[list] = [[] for _ in range(8)]
            for r, row in enumerate(layout):
                ends = np.cumsum([n for _, _, n in row]).tolist()
                for c, v in zip(cols, (path, r, ends[-1], [keys[d] for d, _, _ in row], [o for _, o, _ in row], [0, *ends], [0, *ends[:-1]], hashlib.sha256(matrix[r, : ends[-1]].tobytes()).hexdigest()), strict=True):
                    c.append(v)
            made, keys, documents, total = made + 1, [], [], 0
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(key_type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file", "row_no", "n_tokens", "keys", "offsets", "cu_seqlens", "position_resets", "ids_sha256"])

        for b in batches:
            key_type = b.column(0).type
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array(encode(x.as_py() or ""), width)
                if len(ids):
                    keys.append(k)
                    documents.append(ids)
                    total += len(ids)
                if total >= block_tokens:
                    yield flush()
        if documents:
            yield flush()

    fields = StructType.fromDDL(FIELDS).fields
    schema = StructType([*fields[:3], StructField("keys", ArrayType(docs.schema[key].dataType)), *fields[3:]])
    rows = in_arrow(docs.select(col(key), col(text)), run, schema)
    rows.write.parquet(f"{folder}/layout")
    return spark.read.schema(rows.schema).parquet(f"{folder}/layout")
