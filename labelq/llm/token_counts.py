"""Token counts without token ids.

A block of documents is reduced to its distinct pre-tokens and, for each of them, the documents that
hold it and how often. Pre-tokens are dealt by hash, so every one of them meets its equals of all
blocks in one task and is tokenised once there; its number of pieces is joined to the frequencies
that came with it and summed per document. What travels is a packed row per (block, hash bucket), so
a word that every document holds adds one entry per block, not one per document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.llm import bpe
from labelq.llm.base import batch, query, small_batches, table, texts

PACKED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("documents", pa.binary()), ("payload", pa.binary())])
SUMS = pa.schema([("block", pa.int64()), ("documents", pa.binary()), ("sums", pa.binary())])


class _Numbered(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class _Counted(dict):
    """Pieces of a pre-token, counted at its first sight."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, piece):
        if len(self) >= bpe.REMEMBERED:
            self.clear()
        self[piece] = n = len(self.tokenizer.ids(piece))
        return n


def _pack(arrays: list[np.ndarray], words: list[str]) -> bytes:
    head = [np.asarray(a, dtype="<u4").tobytes() for a in arrays]
    body = "\x00".join(w.replace("\\", "\\\\").replace("\x00", "\\0") for w in words).encode()
    return zlib.compress(struct.pack("<3I", *[len(a) for a in arrays]) + b"".join(head) + body, 1)


def _unescape(word: str) -> str:
    return word if "\\" not in word else word.replace("\\\\", "\x00").replace("\\0", "\x01").replace("\x00", "\\").replace("\x01", "\x00")


def _unpack(payload: bytes) -> tuple[list[np.ndarray], list[str]]:
    raw = zlib.decompress(payload)
    sizes, at, arrays = struct.unpack_from("<3I", raw), 12, []
    for n in sizes:
        arrays.append(np.frombuffer(raw, "<u4", n, at))
        at += 4 * n
    return arrays, [_unescape(w) for w in raw[at:].decode().split("\x00")]


def _blocks(path: str, buckets: int, block_chars: int, ids_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, made = bpe.opened(path), TaskContext.get().partitionId(), 0
        numbers, words, docs, counts, ids, sizes, chars = _Numbered(), [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            word, doc, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, docs, counts))
            names = list(numbers)
            of = np.fromiter((zlib.crc32(w.encode()) % buckets for w in names), np.int64, len(names))
            order = np.lexsort((doc, word, of[word]))
            word, doc, count = word[order], doc[order], count[order]
            edges = np.searchsorted(of[word], np.arange(buckets + 1))
            block = (part << 32) | made
            rows = {"block": [], "bucket": [], "documents": [], "payload": []}
            for b in range(buckets):
                lo, hi = edges[b], edges[b + 1]
                if lo == hi:
                    continue
                own, held = np.unique(word[lo:hi], return_counts=True)
                rows["block"].append(block)
                rows["bucket"].append(b)
                rows["documents"].append(None)
                rows["payload"].append(_pack([held, doc[lo:hi], count[lo:hi]], [names[i] for i in own]))
            rows["block"].append(block)
            rows["bucket"].append(block % buckets)
            rows["documents"].append(_directory(ids, sizes, ids_type))
            rows["payload"].append(None)
            return batch(PACKED, rows)

        for b in batches:
            for doc_id, text in zip(b.column(0), texts(b.column(1)), strict=True):
                codes = np.fromiter(map(numbers.__getitem__, tokenizer.pieces(text)), np.int64)
                word, count = np.unique(codes, return_counts=True)
                words.append(word)
                counts.append(count)
                docs.append(np.full(len(word), len(ids)))
                ids.append(doc_id.as_py())
                sizes.append(len(text.encode()))
                chars += len(text) + 64
                if chars >= block_chars:
                    yield flush()
                    made += 1
                    numbers, words, docs, counts, ids, sizes, chars = _Numbered(), [], [], [], [], [], 0
        if ids:
            yield flush()
    return run


def _directory(ids: list, sizes: list, ids_type: pa.DataType) -> bytes:
    rows = pa.record_batch([pa.array(ids, type=ids_type), pa.array(sizes, type=pa.int64())], names=["doc_id", "n_bytes"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _sums(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _Counted(bpe.opened(path))
        for b in batches:
            rows = {"block": [], "documents": [], "sums": []}
            for block, documents, payload in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                rows["block"].append(block)
                rows["documents"].append(documents.as_py())
                if payload.is_valid:
                    (held, doc, count), words = _unpack(payload.as_py())
                    pieces = np.fromiter(map(counted.__getitem__, words), np.int64, len(words))
                    total = np.bincount(doc, weights=np.repeat(pieces, held) * count).astype("<i8")
                    rows["sums"].append(zlib.compress(total.tobytes(), 1))
                else:
                    rows["sums"].append(None)
            yield batch(SUMS, rows)
    return run


def _per_document(limit: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = [d for d in rows["documents"] if d is not None][0]
        out = pa.ipc.open_stream(held).read_all()
        total = np.zeros(out.num_rows, np.int64)
        for s in rows["sums"]:
            if s is not None:
                part = np.frombuffer(zlib.decompress(s), "<i8")
                total[: len(part)] += part
        frame = out.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        frame["n_tokens"] = total
        frame["over_limit"] = total > limit
        return frame
    return run


def token_counts(docs: DataFrame, path: str, limit: int = 1024, buckets: int | None = None, block_chars: int = 8 << 20) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    ``path`` names a byte-level BPE file of the tokenizers library. Special strings inside a text count as
    their special token, nothing is added, cut or padded. A null text is empty: 0 bytes, 0 tokens. Repeated
    rows and null ids keep a row each; other columns are ignored; an empty table gives an empty result.
    ``buckets`` (by default as many as there are shuffle partitions, 64 at least) and ``block_chars`` steer how
    much is packed together, not the result. A worker holds one block and at most ``bpe.REMEMBERED`` counted
    pre-tokens.
    """
    small_batches(docs.sparkSession)
    buckets = buckets or max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = docs.select(F.col("doc_id"), F.col("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    ids_type = {"bigint": pa.int64(), "int": pa.int32()}[kind]
    packed = named.mapInArrow(_blocks(path, buckets, block_chars, ids_type), "block long, bucket int, documents binary, payload binary")
    sums = packed.repartition("bucket").mapInArrow(_sums(path), "block long, documents binary, sums binary")
    return sums.groupBy("block").applyInPandas(_per_document(limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


@query("op2_token_counts")
def op2_token_counts(spark, sf):
    import public_tokenizers

    return token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
