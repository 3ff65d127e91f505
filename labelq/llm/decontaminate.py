"""Find benchmark items inside documents, with DataFrame functions only.

Size-partitioned MinHash containment search: an item of q distinct shingles that is contained to at least
``share`` has at most q - ceil(share * q) shingles outside the document, so one of its q - ceil(share * q) + 1
smallest hashes (its bottom-k MinHash) lies in the document. Items are partitioned by the power of two of q and
a partition takes k from its largest q, so no pair is missed. Each document's shingle hashes are looked up in
those sketches; pairs found that way, with documents long enough for the item, are verified by exact counting
of shared shingles as strings. An item of fewer words than a shingle is one shingle of all its words, and documents
also give their windows of the lengths that such items have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelq.llm.base import query, table
from labelq.session import materialised

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
PERCENT = 80


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _starts(n_words: Column, k: int) -> Column:
    return F.when(n_words >= k, F.sequence(F.lit(0), n_words - k)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, k: int = SHINGLE) -> Column:
    return F.transform(_starts(F.size(w), k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def shingles(w: Column, k: int = SHINGLE) -> Column:
    return F.array_distinct(F.transform(_starts(F.size(w), k), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)])))


def _of_length(w: Column, lengths: list[int], k: int, make) -> Column:
    """An item's shingles: of ``k`` words, or one of all its words where it has fewer."""
    out = make(w, k)
    for n in lengths:
        if n < k:
            out = F.when(F.size(w) == n, make(w, n)).otherwise(out)
    return out


def _of_lengths(w: Column, lengths: list[int], make) -> Column:
    """A document's windows of all lengths that items have."""
    return F.array_distinct(F.concat(*[make(w, n) for n in lengths])) if len(lengths) > 1 else make(w, lengths[0])


def sketches(items: DataFrame, k: int = SHINGLE, percent: int = PERCENT, lengths: list[int] | None = None) -> DataFrame:
    """One row per (item, sketch hash): item_id, n_item, h. ``lengths`` are those of shingles in use, ``k`` and below."""
    own = _of_length(F.col("_w"), lengths or list(range(1, k + 1)), k, shingle_hashes)
    sets = items.withColumn("_s", F.array_distinct(own)).withColumn("n_item", F.size("_s")).where("n_item > 0")
    largest = F.expr("cast(power(2, floor(log2(n_item)) + 1) as int) - 1")
    depth = F.floor(largest * (100 - percent) / 100).cast("int") + 1
    return sets.select("item_id", "n_item", F.explode(F.slice(F.array_sort("_s"), F.lit(1), F.least(depth, F.col("n_item")))).alias("h"))


def contained(docs: DataFrame, items: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Pairs (doc_id, _text_hash, item_id, n_shared, n_item): the share n_shared / n_item is at least ``percent``.

    ``docs`` has doc_id and text, ``items`` has item_id and text. Texts are lower-cased and cut at ASCII white
    space. A null or empty text is in no pair. An item of fewer than ``k`` words is one shingle: it is in a document
    that has all its words in a row. Repeated document rows give one pair, ``_text_hash`` tells apart rows with the
    same id and other texts; repeated items keep their own ids, and the same item row twice counts once. A null id is
    kept. Empty tables give no pairs; other columns are ignored.
    """
    listed = materialised(items.select("item_id", words(F.col("text")).alias("_w")).distinct(), "items")
    # The lengths of shingles in use: at most ``k`` numbers.
    lengths = sorted(r["n"] for r in listed.select(F.least(F.size("_w"), F.lit(k)).alias("n")).where("n > 0").distinct().collect()) or [k]
    sketch = sketches(listed, k, percent, lengths)
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("_text_hash"))
    hashes = named.select("doc_id", "_text_hash", words(F.col("text")).alias("_w"))
    size = F.greatest(F.size("_w") - (k - 1), F.lit(1)).alias("_n")
    hashes = hashes.select("doc_id", "_text_hash", size, F.explode(_of_lengths(F.col("_w"), lengths, shingle_hashes)).alias("h"))
    met = hashes.join(sketch, "h").where(F.col("_n") * 100 >= F.col("n_item") * percent)
    pairs = materialised(met.select("doc_id", "_text_hash", "item_id", "n_item").distinct(), "leaks")
    some = pairs.select("doc_id", "_text_hash").distinct()
    same = named["doc_id"].eqNullSafe(some["doc_id"]) & (named["_text_hash"] == some["_text_hash"])
    held = named.join(some, same, "left_semi").dropDuplicates(["doc_id", "_text_hash"])
    # The words are a column of their own: inside the shingle expression they would be cut anew for each place.
    held = held.select("doc_id", "_text_hash", words(F.col("text")).alias("_w")).select("doc_id", "_text_hash", F.explode(_of_lengths(F.col("_w"), lengths, shingles)).alias("_s"))
    wanted = listed.select("item_id", F.explode(_of_length(F.col("_w"), lengths, k, shingles)).alias("_s"))
    shared = held.join(wanted, "_s").groupBy("doc_id", "_text_hash", "item_id").agg(F.count("*").alias("n_shared"))
    mine = shared["doc_id"].eqNullSafe(pairs["doc_id"]) & (shared["_text_hash"] == pairs["_text_hash"]) & shared["item_id"].eqNullSafe(pairs["item_id"])
    return (
        shared.join(pairs, mine).where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
        .select(shared["doc_id"], shared["_text_hash"], shared["item_id"], "n_shared", F.col("n_item").cast("long").alias("n_item")))


def without_leaks(docs: DataFrame, items: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that contain no item."""
    found = materialised(contained(docs, items, k, percent).select("doc_id", "_text_hash").distinct(), "leaked")
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["_text_hash"])
    return docs.join(found, same, "left_anti")


SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM i WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+k-1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, k)),
s AS (SELECT DISTINCT item_id, array_to_string(w[p:p+k-1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, n_item FROM ds JOIN s USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item"""


@query("op10_decontaminate", SQL)
def op10_decontaminate(spark, sf):
    found = contained(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item")
