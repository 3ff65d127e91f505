"""Runs of words that repeat with a period, found by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that no neighbouring word
extends, of at least ``least_words`` words and ``least_periods`` periods. Each of its words stands in it at least
``least_periods`` times. So a text is split at every word that is rarer than that inside its segment, and the parts
again, until no segment changes; a neighbour that extends a run would not have been rare, so runs stay whole and
maximal. Segments that survive are scanned lag by lag: the scan compares signatures of blocks of q words at
multiples of q, n/q of them per lag, and only where neighbouring blocks agree it compares words.

Every text is worked on alone, so nothing is shuffled, and a lost task is repeated from its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelq.llm.base import query, small_batches, table, texts

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_PERIODS = 24, 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

#: Odd factors of the block signatures; a signature only chooses what is compared word by word.
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


class _Numbered(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def segments(codes: np.ndarray, least_words: int, least_periods: int) -> list[tuple[int, int]]:
    """The stretches [a, b) in which every word occurs ``least_periods`` times, got by splitting at all others."""
    todo, out = [(0, len(codes))], []
    while todo:
        a, b = todo.pop()
        if b - a < least_words:
            continue
        _, place, counts = np.unique(codes[a:b], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[place] < least_periods)
        if len(rare) == 0:
            out.append((a, b))
            continue
        edges = np.concatenate([[a - 1], rare + a, [b]])
        todo += [(int(edges[i]) + 1, int(edges[i + 1])) for i in np.flatnonzero(np.diff(edges) > least_words)]
    return out


def _stretches(flags: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """[i, j) of the stretches of at least ``least`` true flags."""
    steps = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    for i, j in zip(steps[::2], steps[1::2], strict=True):
        if j - i >= least:
            yield int(i), int(j)


def scan(codes: np.ndarray, least_words: int, least_periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    n = len(codes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * MIX
        mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * powers[:n], dtype=np.uint64)])
        runs: list[tuple[int, int, int]] = []
        for q in range(1, n // least_periods + 1):
            shortest = max(least_words, least_periods * q)
            if shortest > n:
                break
            blocks = np.diff(sums[: n // q * q + 1 : q])
            same = blocks[:-1] * powers[q] == blocks[1:]
            if not same.any():
                continue
            # Equal words q apart over ``shortest - q`` places cover so many whole blocks wherever they begin.
            for i, j in _stretches(same, max(1, (shortest - q + 1) // q - 1)):
                start, end = i * q, j * q
                if any(s <= start and end + q <= s + length and q % p == 0 for s, length, p in runs):
                    continue  # the same stretch, at a multiple of its period
                lo, hi = max(0, start - q), min(n - q, end + q)
                apart = np.flatnonzero(codes[lo:hi] != codes[lo + q : hi + q]) + lo
                inner = apart[(apart >= start) & (apart < end)]
                for a, b in zip([-1, *inner], [*inner, n], strict=True):  # one stretch, unless signatures collide
                    before = apart[apart < max(start, a + 1)]
                    after = apart[apart >= min(end, b)]
                    x = int(before[-1]) + 1 if len(before) else lo
                    y = int(after[0]) if len(after) else hi
                    if y - x + q >= shortest and (x, y - x + q) not in {r[:2] for r in runs}:
                        runs.append((x, y - x + q, q))
    return runs


def text_runs(words: list[bytes], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    if len(words) < least_words:
        return []
    codes = np.fromiter(map(_Numbered().__getitem__, words), np.int64, len(words))
    found = [(a + s, length, q) for a, b in segments(codes, least_words, least_periods) for s, length, q in scan(codes[a:b], least_words, least_periods)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, q in runs:
            keep[start + q : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def _found(schema: pa.Schema, least_words: int, least_periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, runs, kept = [], [], []
            for text in texts(b.column(b.num_columns - 1)):
                words = text.encode().split()
                found = text_runs(words, least_words, least_periods)
                n_words.append(len(words))
                runs.append([{"start": s, "length": length, "period": q} for s, length, q in found])
                kept.append(collapsed(words, found).decode())
            ids = b.columns[:-1]
            rest = [pa.array(v, f.type) for v, f in zip((n_words, runs, kept), list(schema)[len(ids):], strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(ids, schema, strict=False)), *rest], schema=schema)
    return run


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, runs (start, length, period of each), collapsed.

    Words are cut at ASCII white space and numbered from 0; ``collapsed`` is the text with one period left of every
    run, joined by single spaces. A null or empty text has no words, no runs and an empty ``collapsed``. Every row is
    judged alone: repeated rows and null ids keep a row each. Other columns are ignored; an empty table gives an empty
    result. ``least_periods`` is 3 at least. A worker holds one batch of texts; time grows with n log n in the words
    of a segment, but for texts made so that each split takes away a few words only.
    """
    if least_periods < 3:
        raise ValueError("the scan needs three periods at least")
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    named = docs.select("doc_id", "text")
    ids = to_arrow_schema(named.select("doc_id").schema)
    schema = pa.schema([*ids, ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(_found(schema, least_words, least_periods), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with most periods, by exact fractions; ties go to the smaller start, then period; null without runs."""
    def order(a: Column, b: Column) -> Column:
        one, other = a["length"] * b["period"], b["length"] * a["period"]
        later = (a["start"] > b["start"]) | ((a["start"] == b["start"]) & (a["period"] > b["period"]))
        return F.when(one > other, -1).when(one < other, 1).when(later, 1).otherwise(-1)
    return F.get(F.array_sort(runs, order), F.lit(0))


def run_lines(runs: Column) -> Column:
    """``start,length,period`` of every run, a line each."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth document, by the crc32 of its id, repeats a part of itself to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), (h % 10 == 0).alias("_chosen"))
    cut = chosen.withColumn("_w", F.when(F.col("_chosen"), F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))))
    cut = cut.withColumn("_n", F.size("_w").cast("long"))
    cut = cut.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    cut = cut.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    place = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))
    made = F.array_join(F.transform(place, lambda i: F.get("_w", i)), " ")
    return cut.select("doc_id", F.when(F.col("_n") > 0, made).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf):
    found = periodic_runs(with_repeats(table(spark, sf, "documents"))).withColumn("_best", strongest(F.col("runs")))
    best = F.col("_best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(run_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
