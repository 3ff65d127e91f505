"""Token ids of a corpus as binary chunks with Elias-Fano document boundaries.

File format: a folder of Parquet files, one row per chunk, chunks in ascending (part, seq). A chunk holds
the ids of consecutive documents as one little-endian array, ``width`` bytes an id, the documents' ids, and
their end positions inside the chunk as an Elias-Fano sequence: ``low`` has the lowest ``low_bits`` bits of
every end, ``high`` the rest in unary. ``before`` is the number of ids of earlier chunks of the part. Spark
commits the files, so a lost or repeated task leaves no half-written chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelq.llm import bpe
from labelq.llm.base import batch, query, small_batches, table, texts
from labelq.session import scratch_path

CHUNK = "part int, seq int, before long, n_ids long, doc_ids array<{kind}>, width int, ids binary, low_bits int, low binary, high binary"
SELECT_BLOCK = 64  # bytes of the unary part that one entry of the select directory covers


class EliasFano:
    """A non-decreasing sequence of numbers from 0 to ``top`` in about 2 + log2(top / length) bits each."""

    def __init__(self, length: int, low_bits: int, low: bytes, high: bytes):
        self.length, self.low_bits = length, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.directory = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), SELECT_BLOCK)))]) if len(ones) else np.zeros(1, int)

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        bits = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.int64)
        low = np.packbits((values[:, None] >> np.arange(bits)) & 1, bitorder="little") if bits else np.zeros(0, np.uint8)
        marks = np.zeros((top >> bits) + n + 1, np.uint8)
        marks[(values >> bits) + np.arange(n)] = 1
        return cls(n, bits, low.tobytes(), np.packbits(marks, bitorder="little").tobytes())

    def select(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers, from 0: the directory leads to a block of the unary part, its bits to the place."""
        i = np.asarray(i, np.int64)
        out = np.zeros(len(i), np.int64)
        home = np.searchsorted(self.directory, i, "right") - 1
        for b in np.unique(home):
            mine = home == b
            at = np.flatnonzero(np.unpackbits(self.high[b * SELECT_BLOCK:(b + 1) * SELECT_BLOCK], bitorder="little"))
            out[mine] = at[i[mine] - self.directory[b]] + b * SELECT_BLOCK * 8
        return ((out - i) << self.low_bits) | self._lows(i)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        places = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[places >> 3] >> (places & 7).astype(np.uint8)) & 1
        return (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


class _Encoded(dict):
    """The ids of a pre-token as bytes, made at its first sight."""

    def __init__(self, tokenizer, width: int):
        self.tokenizer, self.kind = tokenizer, f"<u{width}"

    def __missing__(self, piece):
        if len(self) >= bpe.REMEMBERED:
            self.clear()
        self[piece] = ids = np.array(self.tokenizer.ids(piece), self.kind).tobytes()
        return ids


_MEMORY: dict[str, _Encoded] = {}


def _chunks(path: str, end_id: int | None, chunk_ids: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = bpe.opened(path), TaskContext.get().partitionId()
        width = 2 if tokenizer.vocabulary <= 1 << 16 else 4
        known = _MEMORY.setdefault(path, _Encoded(tokenizer, width))
        tail = np.array([] if end_id is None else [end_id], f"<u{width}").tobytes()
        before, seq, held, doc_ids, ends, size = 0, 0, [], [], [], 0

        def chunk() -> pa.RecordBatch:
            ef = EliasFano.of(np.array(ends, np.int64), size)
            row = (part, seq, before, size, doc_ids, width, b"".join(held), ef.low_bits, ef.low.tobytes(), ef.high.tobytes())
            return batch(schema, {f.name: [v] for f, v in zip(schema, row, strict=True)})

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                ids = b"".join(map(known.__getitem__, tokenizer.pieces(text))) + tail
                held.append(ids)
                doc_ids.append(doc_id)
                size += len(ids) // width
                ends.append(size)
                if size >= chunk_ids or len(ends) >= chunk_ids:
                    yield chunk()
                    before, seq, held, doc_ids, ends, size = before + size, seq + 1, [], [], [], 0
        if ends:
            yield chunk()
    return run


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int | None = 0, chunk_ids: int = 1 << 20) -> None:
    """Encode ``docs`` (doc_id, text) with a byte-level BPE file and write the chunks to ``folder``.

    Documents are dealt by ranges of doc_id (null first), so a part holds the ids between its neighbours';
    equal doc_ids stay next to each other, ordered by their texts (null first, then by bytes), so the files do not
    depend on how the rows arrive. A null text is empty and has the end id only; with ``end_id``
    None nothing is appended. Other columns are ignored; an empty table gives an empty folder. A worker
    holds one chunk: ``chunk_ids`` ids, or one document if that is longer.
    """
    small_batches(docs.sparkSession)
    named = docs.select("doc_id", "text")
    kind = named.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([
        ("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_({"bigint": pa.int64(), "int": pa.int32()}[kind])), ("width", pa.int32()), ("ids", pa.binary()),
        ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary())])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_id = F.col("doc_id").asc_nulls_first()
    ordered = named.repartitionByRange(n, by_id).sortWithinPartitions(by_id, F.col("text").asc_nulls_first())
    ordered.mapInArrow(_chunks(path, end_id, chunk_ids, schema), CHUNK.format(kind=kind)).write.parquet(folder)


def chunk_starts(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of a folder with ``start``, the number of ids before each; one row per part is summed up."""
    chunks = spark.read.parquet(folder)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    earlier = F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = parts.select("part", F.coalesce(earlier, F.lit(0)).alias("_start"))
    # One row per part, and parts are the range partitions of the writing job: a few thousand rows at most.
    return chunks.join(F.broadcast(starts), "part").withColumn("start", F.col("_start") + F.col("before")).drop("_start")


def _documents(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = len(row["doc_ids"])
                ends = EliasFano(n, row["low_bits"], row["low"], row["high"]).select(np.arange(n))
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(starts, ends, strict=True)]
                yield batch(schema, {"doc_id": row["doc_ids"], "start": starts + row["start"], "n_tokens": ends - starts, "ids_crc32": crc})
    return run


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a written folder: doc_id, start, n_tokens and the crc32 of its ids as 32-bit numbers."""
    chunks = chunk_starts(spark, folder)
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = pa.schema([("doc_id", {"bigint": pa.int64(), "int": pa.int32()}[kind]), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    fields = chunks.select("start", "doc_ids", "width", "ids", "low_bits", "low", "high")
    return fields.mapInArrow(_documents(schema), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")



@query("op5_token_ids")
def op5_token_ids(spark, sf):
    import public_tokenizers

    folder = scratch_path(spark, "token_ids")
    write_ids(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_documents(spark, folder)
