"""Byte-exact removal of strings that start in an earlier document.

Every string of ``length`` bytes belongs to an anchor, the 16 bytes inside it with the smallest hash, so equal
strings have equal anchors at equal distance. That turns one collection of all suffixes into many small ones that
hold the strings around one anchor, aligned at it, and these are built apart:

1. Anchors of all documents are dealt by hash as packed fingerprints; those seen in one document only drop out.
2. For the rest, the bytes of the strings that belong to them are dealt by the same hash; equal pieces of a block
   of documents travel once. Pieces of an anchor with very many of them are cut into their single strings, which
   are dealt by a hash of the string, so no anchor is one big group; equal strings of a block travel once. A task then inserts one symbol per piece and round, from the last column to the
   first, and keeps the pieces ordered by what has been inserted (a positional Burrows-Wheeler transform) with
   the common prefix of neighbours. Neighbours with ``length`` common symbols start with the same string; the
   smallest doc_id of such a run of neighbours keeps it.
3. What was found returns to the block it came from, is merged to byte spans per document and cut out.

Fingerprints only decide what travels; equality is decided on the bytes. A column-wise build over whole documents
needs a pass over all of them for every byte of the longest; with anchors the rounds are 2 * length - 16 at any
size, and each task's files of columns are the rows dealt to it.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.llm.base import batch, query, small_batches, table
from labelq.session import materialised

LENGTH, GRAM = 50, 16
BLOCK_BYTES = 16 << 20  # documents that are packed together
BUCKET_BYTES = 16 << 20  # text whose anchors one bucket gets, about; see bucket_count
BUSY_PIECES = 10_000  # an anchor with more pieces than this is dealt string by string
BUSY = np.uint64(1 << 63)  # marks such an anchor's code
STRING_BUCKETS = 4  # buckets of single strings for each bucket of anchors
LATE = np.iinfo(np.int64).max  # rank of a null doc_id
ROWS = "block long, bucket int, payload binary"
ROWS_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])


def _pack(x) -> bytes:
    return zlib.compress(pickle.dumps(x, protocol=5), 1)


def _unpack(x: bytes):
    return pickle.loads(zlib.decompress(x))


def anchors(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, slice_: int = 1 << 20):
    """Runs of strings with one anchor, over documents laid end to end: (doc, start, count, anchor place, hash).

    Strings are taken in slices of their starts, which bounds what is held; a run that two slices share is two runs.
    """
    parts = [_anchors(raw, ends, s, min(s + slice_, len(raw) - length + 1), length) for s in range(0, len(raw) - length + 1, slice_)]
    parts.append((*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(raw: np.ndarray, ends: np.ndarray, begin: int, stop: int, length: int):
    here = np.concatenate([raw[begin:stop + length - 1], np.zeros(8, np.uint8)])
    n = stop + length - 1 - begin
    x = np.ndarray((n,), "<u8", here.data, strides=(1,))
    h = x[:n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += x[8:n - GRAM + 9]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = (h << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width, reach = length - GRAM + 1, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[:-(width - reach)], low[width - reach:])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(begin, stop)
    least, most = np.searchsorted(ends, [begin, stop - 1], "right")
    edges = np.clip(np.concatenate([[begin], ends[least:most], [stop]]), begin, stop)
    doc = np.repeat(np.arange(least, most + 1), np.diff(edges))
    valid = starts + length <= ends[doc]
    starts, place, doc = starts[valid], place[valid], doc[valid]
    if not len(starts):
        return (*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))
    first = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]) | (doc[1:] != doc[:-1])) + 1])
    count = np.diff(np.concatenate([first, [len(starts)]]))
    return doc[first], starts[first], count, place[first] + begin, h[place[first]]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int):
    """Blocks of (doc_id rank, null flags, text keys, extra, bytes laid end to end, ends)."""
    ids, keys, extra, parts, size = [], [], [], [], 0

    def block():
        lengths = np.array([len(p) for p in parts], np.int64)
        return ids, keys, extra, np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths)

    for b in batches:
        more = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
        for doc_id, key, text, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), more, strict=True):
            raw = (text.as_py() or "").encode()
            if len(raw) < LENGTH:
                continue
            ids.append(doc_id)
            keys.append(key)
            extra.append(x)
            parts.append(raw)
            size += len(raw)
            if size >= block_bytes or len(ids) >= 60_000:
                yield block()
                ids, keys, extra, parts, size = [], [], [], [], 0
    if ids:
        yield block()


def bucket_count(total: int, bucket_bytes: int) -> int:
    """Buckets for so many bytes of text. Beyond some hundred GB they grow with the root of the total only, so that a
    packed row of a block keeps several anchors and a bucket stays within some hundred MB of text at 100 TB."""
    size = max(bucket_bytes, int((total * bucket_bytes) ** 0.5) >> 7)
    return max(8, 1 << max(0, int(np.ceil(np.log2(max(total, 1) / size)))))


def _cuts(of: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The buckets that occur in a sorted array, each with its slice."""
    own, first = np.unique(of, return_index=True)
    stop = np.append(first, len(of))[1:]
    for k, a, z in zip(own.tolist(), first.tolist(), stop.tolist(), strict=True):
        yield k, slice(a, z)


def _send_prints(buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for made, (ids, keys, _, raw, ends) in enumerate(_blocks(batches, block_bytes)):
            block = (part << 32) | made
            doc, _, _, _, h = anchors(raw, ends)
            code = (_bucket(h, buckets).astype(np.uint64) << np.uint64(32)) | _print(h)
            pairs, times = np.unique(np.stack([code, doc.astype(np.uint64)], axis=1).view([("c", "<u8"), ("d", "<u8")]), return_counts=True)
            code, doc = pairs["c"].ravel(), pairs["d"].ravel()
            out = {"block": [], "bucket": [], "payload": []}
            for k, mine in _cuts((code >> np.uint64(32)).astype(np.int64)):
                out["block"].append(block)
                out["bucket"].append(k)
                out["payload"].append(_pack((code[mine].astype(np.uint32), doc[mine].astype(np.uint16), times[mine].astype(np.uint32))))
            out["block"].append(block)
            out["bucket"].append((part + made) % buckets)
            out["payload"].append(_pack((ids, keys)))
            yield batch(ROWS_ARROW, out)
    return run


def _split(rows: pd.DataFrame):
    """Directories pass by; the other rows of a bucket unpacked."""
    away, blocks, held = [], [], []
    for block, payload in zip(rows["block"], rows["payload"], strict=True):
        x = _unpack(payload)
        if isinstance(x[0], list):
            away.append((block, payload))
        else:
            blocks.append(block)
            held.append(x)
    return away, blocks, held


def _frame(away: list, blocks: list, replies: list) -> pd.DataFrame:
    return pd.DataFrame({"block": [x[0] for x in away] + blocks, "payload": [x[1] for x in away] + replies})


def _repeated_prints(busy_pieces: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        away, blocks, held = _split(rows)
        if not held:
            return _frame(away, [], [])
        seen, place, docs = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True, return_counts=True)
        pieces = np.bincount(place, np.concatenate([x[2] for x in held]), len(seen))
        many, busy = seen[docs > 1], (pieces > busy_pieces)[docs > 1]
        bucket, blocks_out, replies = int(key[0]), [], []
        for block, (code, doc, _) in zip(blocks, held, strict=True):
            at = np.minimum(np.searchsorted(many, code), max(len(many) - 1, 0))
            hit = many[at] == code if len(many) else np.zeros(len(code), bool)
            if hit.any():
                blocks_out.append(block)
                replies.append(_pack((bucket, code[hit], doc[hit], busy[at[hit]])))
        return _frame(away, blocks_out, replies)
    return run


def _prints_per_document(rows: pd.DataFrame) -> pd.DataFrame:
    ids, keys, parts = [], [], []
    for payload in rows["payload"]:
        x = _unpack(payload)
        if isinstance(x[0], list):
            ids, keys = x
        else:
            parts.append((np.full(len(x[1]), x[0], np.uint64) << np.uint64(32) | x[1], x[2], x[3]))
    if not parts:
        return pd.DataFrame({"doc_id": pd.array([], "Int64"), "text_key": pd.array([], "int64"), "codes": []})
    code, doc, busy = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((code, doc))
    code, doc = (code | np.where(busy, BUSY, np.uint64(0)))[order], doc[order]
    own, first = np.unique(doc, return_index=True)
    stop = np.concatenate([first[1:], [len(doc)]])
    return pd.DataFrame({
        "doc_id": pd.array([ids[d] for d in own], "Int64"), "text_key": [keys[d] for d in own],
        "codes": [code[a:z].tobytes() for a, z in zip(first, stop, strict=True)]})


def _words(raw: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """The strings of ``LENGTH`` bytes from ``starts`` on, as columns of eight bytes that together cover them."""
    x = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))
    for at in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        yield x[starts + at]


def _string_hashes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for x in _words(raw, starts):
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def equal_strings(raw: np.ndarray, starts: np.ndarray, rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each string its equal of smallest rank. ``h`` brings equal strings together, their bytes decide."""
    order = np.lexsort((rank, h))
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])[:len(order)]
    lead = np.empty(len(order), np.int64)
    lead[order] = order[new][np.cumsum(new) - 1]
    same = np.ones(len(order), bool)
    for x, y in zip(_words(raw, starts), _words(raw, starts[lead]), strict=True):
        same &= x == y
    if not same.all():
        first: dict = {}
        for i in order[np.isin(h[order], h[~same])].tolist():
            lead[i] = first.setdefault(raw[starts[i]:starts[i] + LENGTH].tobytes(), i)
    return lead


def _send_pieces(buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for made, (ids, keys, codes, raw, ends) in enumerate(_blocks(batches, block_bytes)):
            block = (part << 32) | made
            doc, start, count, place, h = anchors(raw, ends)
            of = _bucket(h, buckets)
            code = (of.astype(np.uint64) << np.uint64(32)) | _print(h)
            keep, busy = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
            edges = np.searchsorted(doc, np.arange(len(ids) + 1))
            for d, own in enumerate(codes):
                mine = slice(edges[d], edges[d + 1])
                own = np.frombuffer(own, np.uint64)
                plain = own & ~BUSY
                at = np.minimum(np.searchsorted(plain, code[mine]), len(own) - 1)
                keep[mine] = plain[at] == code[mine]
                busy[mine] = own[at] >= BUSY
            doc, start, count, place, of, code, busy = (x[keep] for x in (doc, start, count, place, of, code, busy))
            rank = np.array([LATE if i is None else i for i in ids], np.int64)
            pieces = [raw[s:s + c + LENGTH - 1].tobytes() for s, c in zip(start.tolist(), count.tolist(), strict=True)]
            # Equal pieces of a block travel once, for the smallest doc_id among them.
            numbers: dict = {}
            same = np.fromiter((numbers.setdefault((c, s), len(numbers)) for c, s in zip(code.tolist(), pieces, strict=True)), np.int64, len(pieces))
            order = np.lexsort((rank[doc], same))
            lead = order[np.concatenate([[0], np.flatnonzero(np.diff(same[order])) + 1])] if len(order) else order
            leader = np.zeros(len(numbers), np.int64)
            leader[same[lead]] = rank[doc[lead]]
            slot = np.zeros(len(numbers), np.int64)
            out = {"block": [], "bucket": [], "payload": []}
            # The strings of busy anchors, in the order of their pieces; the pieces' own slots are their places in it.
            cut, lead = lead[busy[lead]], lead[~busy[lead]]
            slot[same[cut]] = np.arange(len(cut))
            of[busy] = -1
            long = count[cut].astype(np.int64)
            single = np.repeat(start[cut] - np.cumsum(long) + long, long) + np.arange(long.sum())
            held = np.repeat(rank[doc[cut]], long)
            h = _string_hashes(raw, single)
            head = equal_strings(raw, single, held, h)
            s_of = buckets + (h % np.uint64(STRING_BUCKETS * buckets)).astype(np.int64)
            heads = np.unique(head)
            heads = heads[np.argsort(s_of[heads], kind="stable")]
            s_slot = np.zeros(len(single), np.int64)
            for k, own in _cuts(s_of[heads]):
                mine = heads[own]
                s_slot[mine] = np.arange(len(mine))
                out["block"].append(block)
                out["bucket"].append(k)
                out["payload"].append(_pack((held[mine], np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[single[mine]].tobytes())))
            strings = (long.astype(np.uint8), s_of.astype(np.int32), s_slot[head].astype(np.uint32), held > held[head])
            lead = lead[np.argsort(of[lead], kind="stable")]
            for k, own in _cuts(of[lead]):
                mine = lead[own]
                slot[same[mine]] = np.arange(len(mine))
                rel = (place[mine] - start[mine]).astype(np.uint8)
                out["block"].append(block)
                out["bucket"].append(k)
                out["payload"].append(_pack((code[mine].astype(np.uint32), rel, count[mine].astype(np.uint8), rank[doc[mine]], b"".join(pieces[i] for i in mine.tolist()))))
            offset = np.concatenate([[0], ends])[doc]
            out["block"].append(block)
            out["bucket"].append((part + made) % buckets)
            later = rank[doc] > leader[same]
            out["payload"].append(_pack((ids, keys, doc.astype(np.uint16), (start - offset).astype(np.uint32), count.astype(np.uint8), of.astype(np.int32), slot[same].astype(np.uint32), later, strings)))
            yield batch(ROWS_ARROW, out)
    return run


def earlier_starts(group: np.ndarray, first: np.ndarray, count: np.ndarray, rank: np.ndarray, text: bytes, length: int = LENGTH) -> np.ndarray:
    """For pieces aligned at their anchors: a bit for each of their strings that also starts a piece of smaller rank.

    ``group`` names the anchor; ``first`` is how far before it a piece begins. One symbol per piece is inserted in
    each round, from the last column to the first; ``order`` and ``common`` are updated in place of a sort.
    """
    far = length - GRAM
    sizes = count.astype(np.int64) + length - 1
    begin = far - first.astype(np.int64)
    rows, columns = len(group), int((begin + sizes).max())
    cells = np.full((columns, rows), 256, np.int16)
    data = np.frombuffer(text, np.uint8)
    at = np.repeat(begin, sizes) + np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cells[at, np.repeat(np.arange(rows), sizes)] = data
    order = np.argsort(group, kind="stable")
    families = group[order]
    family = np.cumsum(np.concatenate([[0], families[1:] != families[:-1]])).astype(np.int64)
    common = np.zeros(rows, np.int64)
    out = np.zeros(rows, np.uint64)
    for c in range(columns - 1, -1, -1):
        symbol = cells[c][order]
        key = family * 257 + symbol
        moved = np.argsort(key, kind="stable")
        key, before = key[moved], common
        common = np.zeros(rows, np.int64)
        i = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] % 257 != 256)) + 1
        low, high = moved[i - 1] + 1, moved[i]
        near = low == high
        common[i[near]] = before[high[near]] + 1
        wide = np.flatnonzero(~near)
        if len(wide):
            spans = np.stack([low[wide], high[wide] + 1], axis=1).ravel()
            common[i[wide]] = np.minimum.reduceat(np.concatenate([before, [0]]), spans)[::2] + 1
        order = order[moved]
        if c <= far:
            heads = np.flatnonzero(common < length)
            least = np.minimum.reduceat(rank[order], heads)
            least = np.repeat(least, np.diff(np.concatenate([heads, [rows]])))
            hit = order[rank[order] > least]
            out[hit] |= np.uint64(1) << (c - begin[hit]).astype(np.uint64)
    return out


def _found(key, rows: pd.DataFrame) -> pd.DataFrame:
    away, blocks, held = _split(rows)
    if not held:
        return _frame(away, [], [])
    stop, bucket = np.cumsum([len(x[0]) for x in held]), int(key[0])
    if len(held[0]) == 2:
        rank, raw = np.concatenate([x[0] for x in held]), np.frombuffer(b"".join(x[1] for x in held), np.uint8)
        starts = np.arange(len(rank)) * LENGTH
        later = rank > rank[equal_strings(raw, starts, rank, _string_hashes(raw, starts))]
        return _frame(away, blocks, [_pack((bucket, later[z - len(x[0]):z])) for z, x in zip(stop, held, strict=True)])
    group, first, count, rank = (np.concatenate([x[i] for x in held]) for i in range(4))
    bits = earlier_starts(group, first, count, rank, b"".join(x[4] for x in held))
    return _frame(away, blocks, [_pack((bucket, bits[z - len(x[0]):z])) for z, x in zip(stop, held, strict=True)])


def _spans_per_document(rows: pd.DataFrame) -> pd.DataFrame:
    held, found = None, {}
    for payload in rows["payload"]:
        x = _unpack(payload)
        if isinstance(x[0], list):
            held = x
        else:
            found[x[0]] = x[1]
    ids, keys, doc, start, count, of, slot, later, (long, s_of, s_slot, gone) = held
    bits = np.zeros(len(doc), np.uint64)
    order = np.argsort(s_of, kind="stable")
    for k, own in _cuts(s_of[order]):
        gone[order[own]] |= found.pop(k)[s_slot[order[own]]]
    for k, own in found.items():
        mine = of == k
        bits[mine] = own[slot[mine]]
    if len(long):
        ends = np.cumsum(long, dtype=np.int64)
        place = np.arange(len(gone)) - np.repeat(ends - long, long)
        busy = of < 0
        bits[busy] = np.bitwise_or.reduceat(gone.astype(np.uint64) << place.astype(np.uint64), ends - long)[slot[busy]]
    # A piece equal to one of a smaller doc_id in its own block goes whole.
    every = (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)
    bits = np.where(later, every, bits)
    some = np.flatnonzero(bits)
    row, bit = np.nonzero((bits[some, None] >> np.arange(LENGTH - GRAM + 1, dtype=np.uint64)) & np.uint64(1))
    doc, at = doc[some][row].astype(np.int64), start[some][row].astype(np.int64) + bit
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    if not len(doc):
        return pd.DataFrame({"doc_id": pd.array([], "Int64"), "text_key": pd.array([], "int64"), "spans": []})
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + LENGTH)])
    lead = np.flatnonzero(new)
    last = np.concatenate([lead[1:], [len(doc)]]) - 1
    spans = np.stack([at[lead], at[last] + LENGTH], axis=1).astype("<u4")
    own, first = np.unique(doc[lead], return_index=True)
    stop = np.concatenate([first[1:], [len(lead)]])
    return pd.DataFrame({
        "doc_id": pd.array([ids[d] for d in own], "Int64"), "text_key": [keys[d] for d in own],
        "spans": [spans[a:z].tobytes() for a, z in zip(first, stop, strict=True)]})


def _met(named: DataFrame, hot: DataFrame) -> DataFrame:
    """Documents with their repeated anchors. Rows leave a shuffle in any order, but blocks and slots are numbered as
    rows come and a repeated task must give the same numbers, so each partition is sorted; rows that tie are equal."""
    same = named["doc_id"].eqNullSafe(hot["doc_id"]) & (named["text_key"] == hot["text_key"])
    return named.join(hot, same).select(named["doc_id"], named["text_key"], "text", "codes").sortWithinPartitions("doc_id", "text_key")


def _sent_pieces(named: DataFrame, buckets: int, block_bytes: int, busy_pieces: int) -> DataFrame:
    """Rows of ``ROWS``: the pieces of all repeated anchors of ``named`` (doc_id, text_key, text), with directories."""
    sent = named.mapInArrow(_send_prints(buckets, block_bytes), ROWS)
    seen = sent.groupBy("bucket").applyInPandas(_repeated_prints(busy_pieces), "block long, payload binary")
    hot = seen.groupBy("block").applyInPandas(_prints_per_document, "doc_id long, text_key long, codes binary")
    hot = materialised(hot.dropDuplicates(["doc_id", "text_key"]), "anchors").hint("shuffle_hash")
    return _met(named, hot).mapInArrow(_send_pieces(buckets, block_bytes), ROWS)


def repeated_spans(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, busy_pieces: int = BUSY_PIECES) -> DataFrame:
    """(doc_id, text_key, spans) of documents with removed bytes: pairs of 32-bit byte offsets, end exclusive."""
    small_batches(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = _sent_pieces(named, bucket_count(total, bucket_bytes), block_bytes, busy_pieces)
    found = pieces.groupBy("bucket").applyInPandas(_found, "block long, payload binary")
    spans = found.groupBy("block").applyInPandas(_spans_per_document, "doc_id long, text_key long, spans binary")
    return materialised(spans.dropDuplicates(["doc_id", "text_key"]), "spans")


def _digests(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {f.name: [] for f in schema}
            for doc_id, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw = memoryview((text.as_py() or "").encode())
                cuts = np.frombuffer(spans or b"", "<u4").reshape(-1, 2).tolist()
                digest, at = hashlib.sha256(), 0
                for s, e in cuts:
                    digest.update(raw[at:s])
                    at = e
                digest.update(raw[at:])
                for name, v in zip(out, (doc_id, len(raw), sum(e - s for s, e in cuts), len(cuts), digest.hexdigest()), strict=True):
                    out[name].append(v)
            yield batch(schema, out)
    return run


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the column ``spans`` of the bytes to remove, null where there are none."""
    keyed = docs.withColumn("_k", F.xxhash64("text"))
    found = spans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans").hint("shuffle_hash")
    return keyed.join(found, keyed["doc_id"].eqNullSafe(found["_id"]) & (keyed["_k"] == found["_key"]), "left").drop("_k", "_id", "_key")


def kept_digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Strings are judged on the input. A null text is empty and keeps the digest of nothing. Texts shorter than 50
    bytes keep all. Rows with equal doc_ids do not remove each other's strings; a null doc_id ranks last, and null
    ids do not remove each other's. Repeated rows keep a row each; other columns are ignored; an empty table gives
    an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    named = docs.select(F.col("doc_id").cast("long"), "text")
    joined = with_spans(named, repeated_spans(docs)).select("doc_id", "text", "spans")
    return joined.mapInArrow(_digests(schema), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@query("op4_repeats")
def op4_repeats(spark, sf):
    return kept_digests(table(spark, sf, "documents"))
