"""How far the sources of a language are apart in their words, by chunk factorization.

A block of documents is reduced to its distinct chunks (what stands between white space) and, for each, the
documents that hold it and how often. The distinct chunks of all blocks are made one table and cut into terms once
each. Terms that even all documents of all their chunks together could not carry over the limit are left out; the
others are joined back to the blocks, where postings of chunks become postings of terms, so that a document that
holds a term in several chunks counts once. What leaves a block are sums per language, source and term; what travels
before that is every chunk once per block, not once per document.

Sums over all kept terms for all pairs of sources are made from non-zero counts only: terms are dealt by hash, a
group holds a slice of terms for two blocks of sources, and terms that neither source has are added by their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelq.llm.base import query, small_batches, table, texts
from labelq.session import materialised

# What a term is.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEAST_DOCS = 30
SCALE, SMOOTH = 1_000_000_000, 5
TERM_RANKS = 50
BLOCK_CHARS = 32 << 20
SOURCE_BLOCK = 256  # sources on one side of a group of pairs
TERM_BLOCK = 8192  # kept terms of a group of pairs, about

FACTORS = pa.schema([
    ("block", pa.int64()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())),
    ("chunks", pa.list_(pa.string())), ("docs", pa.list_(pa.int32())), ("postings", pa.binary())])
FACTOR_TYPE = "block long, langs array<string>, sources array<string>, chunks array<string>, docs array<int>, postings binary"
SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("number", pa.int64()), ("docs", pa.int64()), ("n", pa.int64())])


class _Numbered(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of 32-bit numbers in one compressed string."""
    sink = pa.BufferOutputStream()
    rows = pa.record_batch([pa.array([a.astype("<i4").tobytes() for a in arrays], pa.binary())], names=["a"])
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> list[np.ndarray]:
    return [np.frombuffer(a, "<i4").astype(np.int64) for a in pa.ipc.open_stream(packed).read_all().column(0).to_pylist()]


def _factors(block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0

        def empty():
            return _Numbered(), _Numbered(), [], [], [], 0

        chunks, groups, kinds, chunk, times, chars = empty()

        def flush() -> pa.RecordBatch:
            held = np.fromiter(map(len, chunk), np.int32, len(chunk))
            all_chunks = np.concatenate(chunk)
            row = {
                "block": (part << 32) | made, "langs": [g[0] for g in groups], "sources": [g[1] for g in groups],
                "chunks": pa.array(list(chunks), pa.binary()).cast(pa.string()).to_pylist(), "docs": np.bincount(all_chunks, minlength=len(chunks)),
                "postings": _packed([np.array(kinds), held, np.diff(all_chunks, prepend=0), np.concatenate(times)])}
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in FACTORS], schema=FACTORS)

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), strict=True):
                own = Counter(text.encode().split())
                numbers = np.fromiter(map(chunks.__getitem__, own), np.int32, len(own))
                order = np.argsort(numbers)
                chunk.append(numbers[order])
                times.append(np.fromiter(own.values(), np.int32, len(own))[order])
                kinds.append(groups[lang, source])
                chars += len(text) + 64
                if chars >= block_chars:
                    yield flush()
                    made += 1
                    chunks, groups, kinds, chunk, times, chars = empty()
        if kinds:
            yield flush()
    return run


def factors(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of documents (text, lang, source) as distinct chunks and postings; nulls are read as ''."""
    small_batches(docs.sparkSession)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")])
    return named.mapInArrow(_factors(block_chars), FACTOR_TYPE)


def chunk_terms(blocks: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(chunk, number): the terms of every distinct chunk, repeats kept, and (number, term). Each chunk is cut once.

    Terms whose chunks are in fewer than ``least_docs`` documents, all languages and chunks added up, are left out.
    """
    held = blocks.select(F.explode(F.arrays_zip("chunks", "docs")).alias("c")).groupBy(F.col("c.chunks").alias("chunk")).agg(F.sum("c.docs").alias("docs"))
    cut = held.select("chunk", "docs", F.explode(F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term"))
    cut = materialised(cut, "chunk_terms")
    known = cut.groupBy("term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    # The numbers are fixed by being stored.
    known = materialised(known.select(F.monotonically_increasing_id().alias("number"), "term"), "terms")
    return cut.select("chunk", "term").join(known, "term").select("chunk", "number"), known


def _block_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums per language, source and term of one block from its postings (left) and its chunks' terms (right), as numbers."""
    if left.num_rows == 0 or right.num_rows == 0:
        return SUMS.empty_table()
    langs, sources = (pa.array(left.column(c)[0].as_py(), pa.string()) for c in ("langs", "sources"))
    kinds, held, steps, times = _unpacked(left.column("postings")[0].as_py())
    chunk = np.cumsum(steps)
    doc = np.repeat(np.arange(len(kinds)), held)
    names, term = np.unique(right.column("number").to_numpy(), return_inverse=True)
    pos = right.column("pos").to_numpy().astype(np.int64)
    order = np.argsort(pos, kind="stable")
    pos, term = pos[order], term[order]
    first = np.searchsorted(pos, np.arange(left.column("size")[0].as_py() + 1))
    held = np.diff(first)[chunk]
    at = np.repeat(first[chunk] - np.cumsum(held) + held, held) + np.arange(held.sum())
    n_terms = len(names)
    keys = np.repeat(doc, held) * n_terms + term[at]
    where, place = np.unique(keys, return_inverse=True)
    n = np.zeros(len(where), np.int64)
    np.add.at(n, place, np.repeat(times, held))
    pairs, place, docs = np.unique(kinds[where // n_terms] * n_terms + where % n_terms, return_inverse=True, return_counts=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, place, n)
    kind = pa.array(pairs // n_terms)
    return pa.table([langs.take(kind), sources.take(kind), pa.array(names[pairs % n_terms]), pa.array(docs), pa.array(total)], schema=SUMS)


def term_counts(docs: DataFrame, least_docs: int = 1, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, docs, n) of the terms of ``docs``, and the groups (lang, source) that occur.

    ``docs`` counts rows that hold the term, ``n`` its occurrences. A row is a document: repeated rows and null ids
    count each. Every term that ``least_docs`` documents hold is there, all its groups with it. The results are read
    from stored tables.
    """
    blocks = materialised(factors(docs, block_chars), "factors")
    groups = blocks.select(F.explode(F.arrays_zip("langs", "sources")).alias("g")).select(F.col("g.langs").alias("lang"), F.col("g.sources").alias("source")).distinct()
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("chunks").alias("pos", "chunk"))
    terms, names = chunk_terms(blocks, least_docs)
    replies = asked.join(terms, "chunk").select("of", "pos", "number")
    packed = blocks.select("block", "langs", "sources", "postings", F.size("chunks").alias("size"))
    sums = packed.groupBy("block").cogroup(replies.groupBy("of")).applyInArrow(_block_sums, "lang string, source string, number long, docs long, n long")
    counts = sums.groupBy("lang", "source", "number").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    counts = counts.join(names, "number").select("lang", "source", "term", "docs", "n")
    return materialised(counts, "term_counts"), materialised(groups, "groups")


def chance(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exactly."""
    above = (n + SMOOTH).cast("decimal(26,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + SMOOTH * terms).cast("decimal(26,0)")
    return (1 + F.call_function("div", above, below)).cast("long")


def _pair_sums(source_block: int):
    def run(key: tuple, bases: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        """Sums over the terms seen in one group, for the pairs of a block of sources with another."""
        a, b = int(key[1]), int(key[2])
        base = dict(zip(bases["number"].to_numpy(), bases["p0"].to_numpy(), strict=True))
        sides = [np.array(sorted(i for i in base if i // source_block == x), np.int64) for x in (a, b)]
        codes, names = pd.factorize(values["term"])
        numbers, p = values["number"].to_numpy(), values["p"].to_numpy()
        total, held = np.zeros((len(sides[0]), len(sides[1])), np.int64), np.zeros((len(sides[0]), len(sides[1])), np.int64)
        step = max(1, (4 << 20) // max(1, total.size))
        order = np.argsort(codes, kind="stable")
        codes, numbers, p = codes[order], numbers[order], p[order]
        for lo in range(0, len(names), step):
            hi = min(len(names), lo + step)
            i, j = np.searchsorted(codes, [lo, hi])
            filled = []
            for x, side in zip((a, b), sides, strict=True):
                matrix = np.repeat(np.array([[base[s] for s in side]], np.int64), hi - lo, axis=0)
                mine = numbers[i:j] // source_block == x
                matrix[codes[i:j][mine] - lo, np.searchsorted(side, numbers[i:j][mine])] = p[i:j][mine]
                filled.append(matrix)
            total += np.abs(filled[0][:, :, None] - filled[1][:, None, :]).sum(axis=0)
            held += hi - lo
        rows, cols = np.nonzero(sides[0][:, None] < sides[1][None, :])
        return pd.DataFrame({"lang": key[0], "one": sides[0][rows], "other": sides[1][cols], "apart": total[rows, cols], "seen": held[rows, cols]})
    return run


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = TERM_RANKS, block_chars: int = BLOCK_CHARS, term_block: int = TERM_BLOCK, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has the distance of a source to each other source of its
    language, part ``term`` the terms it uses more than its language does, up to ``ranks`` of them.

    A language keeps the terms of at least ``least_docs`` of its documents; chances are smoothed and scaled integers
    (``chance``). Nulls in text, lang and source are read as ''. A row is a document, so repeated rows count each; a
    text without terms adds its source to the groups and nothing else. A language with one source has no pairs. Ties
    are ordered by the bytes of the item. Other columns are ignored; an empty table gives an empty result.

    Windows are over one language's sources (their numbers) and one group's terms, of which each task sends its first
    ``ranks``; no text or list of documents is in them.
    """
    counts, groups = term_counts(docs, least_docs, block_chars)
    kept = materialised(counts.groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("d")).where(F.col("d") >= least_docs).drop("d"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("whole").alias("lang_total"))
    held = materialised(counts.drop("docs").join(kept, ["lang", "term"]), "held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    sources = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total"])
    p0 = F.when(F.col("terms") > 0, chance(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(F.lit(0)).cast("long")
    sources = materialised(sources.withColumn("number", number).withColumn("p0", p0), "sources")

    scored = held.join(sources, ["lang", "source"]).withColumn("p", chance(F.col("n"), F.col("total"), F.col("terms")))
    scored = scored.withColumn("q", chance(F.col("whole"), F.col("lang_total"), F.col("terms")))
    best = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = scored.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks)

    slices = F.greatest(F.lit(1), F.ceil(F.col("terms") / term_block)).cast("long")
    blocks = materialised(sources.groupBy("lang").agg((F.floor(F.max("number") / source_block) + 1).cast("long").alias("blocks"), F.max(slices).alias("slices")), "blocks")
    mine = F.floor(F.col("number") / source_block).cast("long")

    def met(rows: DataFrame) -> DataFrame:
        """A row for each pair of blocks (one, other) that its source's block is in."""
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, mine).alias("one"), F.greatest(x, mine).alias("other")))
        return rows.withColumn("_m", F.explode(pairs)).withColumn("a", F.col("_m.one")).withColumn("b", F.col("_m.other")).drop("_m")

    values = scored.select("lang", "term", "number", "p").join(blocks, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")))
    values = met(values).select("lang", "a", "b", "slice", "term", "number", "p")
    bases = sources.select("lang", "number", "p0").join(blocks, "lang").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    bases = met(bases).select("lang", "a", "b", "slice", "number", "p0").toDF("lang", "one", "other", "of", "number", "p0")
    sums = bases.groupBy("lang", "one", "other", "of").cogroup(values.groupBy("lang", "a", "b", "slice")).applyInPandas(_pair_sums(source_block), "lang string, one long, other long, apart long, seen long")
    sums = sums.groupBy("lang", "one", "other").agg(F.sum("apart").alias("apart"), F.sum("seen").alias("seen"))
    side = sources.select("lang", "source", "number", "p0", "terms")
    named = sums.join(side.select("lang", F.col("number").alias("one"), F.col("source").alias("s1"), F.col("p0").alias("p1"), "terms"), ["lang", "one"])
    named = named.join(side.select("lang", F.col("number").alias("other"), F.col("source").alias("s2"), F.col("p0").alias("p2")), ["lang", "other"])
    named = named.withColumn("value", F.col("apart") + (F.col("terms") - F.col("seen")) * F.abs(F.col("p1") - F.col("p2")))
    both = F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item")))
    pairs = named.select("lang", F.explode(both).alias("_s"), "value").select("lang", "_s.source", F.lit("pair").alias("part"), "_s.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)


SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3),
x AS (SELECT g.lang, g.source, k.term, k.c, coalesce(n.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS p, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w) AS q
 FROM x WINDOW w AS (PARTITION BY lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u) WHERE part = 'pair' OR rank <= 50"""


@query("op12_source_divergence", SQL)
def op12_source_divergence(spark, sf):
    return divergence(table(spark, sf, "documents"))
