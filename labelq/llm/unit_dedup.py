"""Substring deduplication by line and by piece of a line: of equal units the earliest stays, with original offsets.

Units are all lines that are not blank, and the longer pieces of lines that have several: a line is cut after its
marks of end (``.``, ``!``, ``?`` and their wide forms), and a piece of ``PIECE_WORDS`` words or ``PIECE_CHARS`` characters
counts. So an edit elsewhere in a line does not save a repeated passage, nor do texts without spaces escape. A unit is
normalised (ASCII letters lower-cased, white space runs made one space, ends trimmed) and reduced to a 128-bit
digest. Digests are counted globally; a unit is removed if an equal one has a lower rank (doc_id, then place in the
text). The earliest of equal pieces is never in a removed line, since the line that line repeats has the piece too.

Only digests, ids and offsets are shuffled. Counting combines on the map side; digests that hold more than one in
``HOT_SHARE`` of all units are fewer than that and are broadcast, so no task gathers the rows of one of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelq.llm.base import batch, query, small_batches, table, texts
from labelq.session import materialised

PIECE_WORDS, PIECE_CHARS = 8, 64
# The marks after which a line is cut.
PIECE = re.compile("[^.!?。！？]*[.!?。！？]+|[^.!?。！？]+")
HOT_SHARE = 10_000
UNITS = "doc_id {kind}, text_key binary, pos int, piece int, start int, end int, digest binary"


def normal(text: str) -> bytes:
    return b" ".join(text.encode().lower().split())


def text_units(text: str, piece_words: int = PIECE_WORDS, piece_chars: int = PIECE_CHARS) -> Iterator[tuple[int, int, int, int, bytes | None]]:
    """(pos, piece, start, end, content) of a text's lines (piece 0) and of their longer pieces (1, in order)."""
    at = 0
    for pos, line in enumerate(text.split("\n")):
        whole = normal(line)
        yield pos, 0, at, at + len(line), whole or None
        for m in PIECE.finditer(line):
            content = normal(m.group())
            if len(content) < len(whole) and (content.count(b" ") + 1 >= piece_words or len(content.decode()) >= piece_chars):
                yield pos, 1, at + m.start(), at + m.end(), content
        at += len(line) + 1


def _units(schema: pa.Schema, piece_words: int, piece_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {f.name: [] for f in schema}
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                key = hashlib.blake2b(text.encode(), digest_size=12).digest()
                for pos, piece, start, end, content in text_units(text, piece_words, piece_chars):
                    digest = None if content is None else hashlib.blake2b(content, digest_size=16).digest()
                    for name, v in zip(out, (doc_id, key, pos, piece, start, end, digest), strict=True):
                        out[name].append(v)
            yield batch(schema, out)
    return run


def units(docs: DataFrame, piece_words: int = PIECE_WORDS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Lines and longer pieces of documents (doc_id, text): doc_id, text_key, pos (line), piece, start, end, digest.

    Places are code points. The digest is null for blank lines; they are never removed.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("bigint", "int"):
        raise TypeError(f"doc_id is a long or an int, not {kind}")
    small = [(c, pa.int32()) for c in ("pos", "piece", "start", "end")]
    schema = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.int32()), ("text_key", pa.binary()), *small, ("digest", pa.binary())])
    return docs.select("doc_id", "text").mapInArrow(_units(schema, piece_words, piece_chars), UNITS.format(kind=kind))


def flagged(docs: DataFrame, piece_words: int = PIECE_WORDS, piece_chars: int = PIECE_CHARS, hot_share: int = HOT_SHARE) -> DataFrame:
    """The units with ``removed``: 1 where an equal unit has a lower rank.

    Ranks are (doc_id, place); a null doc_id ranks last. Rows that repeat a doc_id and text are one document and
    give their units once; rows that share a doc_id with other texts are ranked by a hash of the text. A null or
    empty text is one empty line, which stays. Empty tables give no units; other columns are ignored. ``hot_share``
    steers which digests are broadcast, not the result.
    """
    lines = materialised(units(docs, piece_words, piece_chars).dropDuplicates(["doc_id", "text_key", "piece", "start"]), "lines")
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "start", "text_key")
    first = lines.where("digest is not null").groupBy("digest").agg(F.min(rank).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = materialised(first, "first")
    # At most ``hot_share`` digests can hold more than this share of all units.
    hot = first.where(F.col("_n") > lines.count() / hot_share).drop("_n")
    cold = first.where(F.col("_n") <= lines.count() / hot_share).drop("_n")
    often = lines.join(F.broadcast(hot), "digest")
    rarely = lines.join(F.broadcast(hot.select(F.col("digest").alias("_d"))), F.col("digest") == F.col("_d"), "left_anti").join(cold, "digest", "left")
    removed = F.coalesce(F.col("_first") < rank, F.lit(False)).cast("int")
    return often.unionByName(rarely).select("doc_id", "text_key", "pos", "piece", "start", "end", removed.alias("removed"))


def per_document(lines: DataFrame) -> DataFrame:
    """doc_id, text_key, n_units, n_removed, removed_chars, removed_spans (start:end of each, in order).

    A piece of a removed line goes with its line: it is counted among the units, and neither as removed nor as a span.
    """
    dealt = lines.repartition("doc_id", "text_key")
    line_gone = F.max(F.when(F.col("piece") == 0, F.col("removed"))).over(W.partitionBy("doc_id", "text_key", "pos"))
    dealt = dealt.withColumn("_line", line_gone).withColumn("removed", F.when((F.col("piece") == 1) & (F.col("_line") == 1), 0).otherwise(F.col("removed")))
    spans = F.array_sort(F.collect_list(F.when(F.col("removed") == 1, F.struct("start", "end"))))
    return dealt.groupBy("doc_id", "text_key").agg(
        F.count("*").alias("n_units"), F.sum("removed").alias("n_removed"),
        F.coalesce(F.sum(F.when(F.col("removed") == 1, F.col("end") - F.col("start"))), F.lit(0)).cast("long").alias("removed_chars"),
        spans.alias("removed_spans"))


def without_repeats(docs: DataFrame, piece_words: int = PIECE_WORDS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``docs`` with removed units cut out of the text; ``_gone`` has their places (start, end) in the original."""
    gone = per_document(flagged(docs, piece_words, piece_chars)).where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "removed_spans")
    return _cut(docs, gone)


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the spans; a line that goes as a whole takes its line feed with it."""
    at, lines, todo = 0, [], sorted(spans)[::-1]
    for line in text.split("\n"):
        end, kept, left, whole = at + len(line), [], at, False
        while todo and todo[-1][0] < end:
            start, stop = todo.pop()
            whole = whole or (start, stop) == (at, end)
            kept.append(text[left:start])
            left = stop
        if not whole:
            lines.append("".join(kept) + text[left:end])
        at = end + 1
    return "\n".join(lines)


def _cut(docs: DataFrame, gone: DataFrame) -> DataFrame:
    @F.pandas_udf("binary")
    def key(text: pd.Series) -> pd.Series:
        return text.map(lambda x: hashlib.blake2b((x or "").encode(), digest_size=12).digest())

    @F.pandas_udf("string")
    def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or s is None else cut_text(x, [(int(r["start"]), int(r["end"])) for r in s]) for x, s in zip(text, spans, strict=True)])

    keyed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"), key("text").alias("_k"))
    joined = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["_id"]) & (keyed["_k"] == gone["_key"]), "left")
    cut = F.col("_row").withField("text", kept(keyed["text"], "removed_spans"))
    return joined.select(cut.alias("_row"), F.col("removed_spans").alias("_gone")).select("_row.*", "_gone")


SQL = r"""WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l),
q AS (SELECT doc_id, pos, start AS line_at, line AS whole, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i FROM (SELECT *, regexp_extract_all(line, '[^.!?。！？]*[.!?。！？]+|[^.!?。！？]+') AS x FROM o)),
a AS (SELECT doc_id, pos, 0 AS piece, start, line, line AS whole FROM o
 UNION ALL SELECT doc_id, pos, 1, (line_at + coalesce(sum(length(line)) OVER (PARTITION BY doc_id, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT, line, whole FROM q),
u AS (SELECT * EXCLUDE (line, whole), length(line) AS chars, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS n,
 trim(regexp_replace(translate(whole, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS w FROM a),
v AS (SELECT * FROM u WHERE piece = 0 OR (n <> w AND (len(string_split(n, ' ')) >= 8 OR length(n) >= 64))),
r AS (SELECT *, CASE WHEN n <> '' AND (first_value(doc_id) OVER f < doc_id OR (first_value(doc_id) OVER f = doc_id AND first_value(start) OVER f < start)) THEN 1 ELSE 0 END AS gone FROM v
 WINDOW f AS (PARTITION BY n ORDER BY doc_id, start)),
d AS (SELECT *, CASE WHEN piece = 1 AND max(CASE WHEN piece = 0 THEN gone END) OVER (PARTITION BY doc_id, pos) = 1 THEN 0 ELSE gone END AS removed FROM r)
SELECT doc_id, count(*) AS n_units, sum(removed)::BIGINT AS n_removed, sum(CASE WHEN removed = 1 THEN chars ELSE 0 END)::BIGINT AS removed_chars,
 coalesce(string_agg(CASE WHEN removed = 1 THEN start||':'||(start + chars) END, ',' ORDER BY start), '') AS removed_spans FROM d GROUP BY doc_id"""


@query("op7_unit_dedup", SQL)
def op7_unit_dedup(spark, sf):
    out = per_document(flagged(table(spark, sf, "documents")))
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", "n_units", "n_removed", "removed_chars", spans.alias("removed_spans"))
