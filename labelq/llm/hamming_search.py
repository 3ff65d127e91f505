"""Exact nearest binary codes by incremental multi-index hashing.

Vectors become 64-bit codes of their signs, cut into four segments of 16 bits, and every row is indexed under
each of its segments. Searches grow a radius: in round r a query meets the rows whose segment differs from its
own in exactly r bits. After round r every row within 4r + 3 bits of a query has been met, since a row further
away in each segment differs in 4(r + 1) bits at least. A query is finished once its k-th verified distance is
covered; the others go on, up to r = 16, when all rows have been met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelq.llm.base import query, table
from labelq.session import materialised

SEGMENTS, WIDTH = 4, 16
K = 10


def code(vector: Column) -> Column:
    """Bit i is set where component i is positive; a missing component is not. A null vector has no code."""
    bits = [
        F.when(F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
        for i in range(SEGMENTS * WIDTH)]
    return F.when(vector.isNotNull(), _any(bits))


def _any(bits: list[Column]) -> Column:
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def segment(code_column: Column, s: int) -> Column:
    return F.shiftrightunsigned(code_column, s * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def _segments(rows: DataFrame, *keep: str) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(s).alias("s"), segment(F.col("code"), s).alias("v")) for s in range(SEGMENTS)])
    return rows.select(*keep, F.explode(listed).alias("_g")).select(*keep, "_g.s", "_g.v")


def _apart(s: int) -> Column:
    return F.bit_count(segment(F.col("q_code"), s).bitwiseXOR(segment(F.col("code"), s)))


def _met_first(r: int) -> Column:
    """Whether a pair met in segment ``s`` at radius ``r`` is met there for the first time."""
    first = F.lit(False)
    for s in range(SEGMENTS):
        own = F.col("s") == s
        for t in range(SEGMENTS):
            if t != s:
                own = own & (_apart(t) > r if t < s else _apart(t) >= r)
        first = first | own
    return first


def smallest_ids(rows: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """The ``k`` smallest ids of every code; a code that many rows share is first cut down in ``salts`` parts."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    for keys in (["code", "_salt"], ["code"]):
        salted = salted.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).where(F.col("_rn") <= k)
    return salted.drop("_salt", "_rn")


def nearest(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` rows nearest to each query by Hamming distance: query_id, id, distance, rank.

    Both inputs have id and code. Ties go to the smaller id; a query that is among the rows finds itself. Rows
    without an id or code are left out; equal codes of different ids are different rows, a repeated row counts
    once. With fewer than ``k`` rows all are returned; empty inputs give no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    # Equal codes share one index entry with their k smallest ids, so a large group of copies is verified once.
    held = materialised(smallest_ids(rows.select("id", "code").where("id is not null and code is not null").distinct(), k), "held")
    codes = held.groupBy("code").agg(F.count("*").alias("n"))
    index = materialised(_segments(codes, "code", "n"), "index")
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q_code")).where("query_id is not null and q_code is not null").distinct()
    open_ = materialised(asked.select("q_code").distinct().withColumn("bound", F.lit(SEGMENTS * WIDTH)), "queries")
    # All 2^16 patterns of a segment by their number of bits: a table of fixed size.
    patterns = spark.range(1 << WIDTH).select(F.col("id").cast("int").alias("flip"), F.bit_count("id").alias("r"))
    best, found = None, None
    for r in range(WIDTH + 1):
        probes = _segments(open_.withColumnRenamed("q_code", "code"), "code", "bound").withColumnRenamed("code", "q_code")
        flips = patterns.where(F.col("r") == r).select("flip")
        probes = probes.join(F.broadcast(flips)).select("q_code", "bound", "s", F.col("v").bitwiseXOR(F.col("flip")).alias("v"))
        met = probes.join(index, ["s", "v"]).withColumn("distance", F.bit_count(F.col("q_code").bitwiseXOR(F.col("code"))))
        met = met.where((F.col("distance") <= F.col("bound")) & _met_first(r)).select("q_code", "code", "n", "distance")
        if best is not None:
            met = met.unionByName(best)
        nearer = F.coalesce(F.sum("n").over(W.partitionBy("q_code").orderBy("distance").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
        best = materialised(met.withColumn("_nearer", nearer).where(F.col("_nearer") < k).drop("_nearer"), "best")
        if r == WIDTH:
            found = best if found is None else found.unionByName(best)
            break
        state = best.groupBy("q_code").agg(F.sum("n").alias("_n"), F.max("distance").alias("_d"))
        reach = SEGMENTS * (r + 1) - 1
        full = F.coalesce(F.col("_n"), F.lit(0)) >= k
        open_ = materialised(
            open_.drop("bound").join(state, "q_code", "left").where(~(full & (F.col("_d") <= reach)))
            .select("q_code", F.when(full, F.col("_d")).otherwise(F.lit(SEGMENTS * WIDTH)).alias("bound")), "open")
        ready = best.join(open_.select("q_code"), "q_code", "left_anti")
        found = ready if found is None else found.unionByName(ready)
        if open_.isEmpty():
            break
        best = best.join(open_.select("q_code"), "q_code", "left_semi")
    pairs = asked.join(found.select("q_code", "code", "distance"), "q_code").join(held, "code")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", F.col("distance").cast("long"), F.col("rank").cast("long"))


SQL = """SELECT query_id, id, distance, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id,
   list_sum(list_transform(range(1, 65), lambda i: ((q.embedding[i] > 0) <> (e.embedding[i] > 0))::INT))::BIGINT AS distance
  FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings e)) WHERE rank <= 10"""


@query("op8_hamming_search", SQL)
def op8_hamming_search(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), code(F.col("embedding")).alias("code"))
    return nearest(rows, rows.where(F.col("id") % 50 == 0))
