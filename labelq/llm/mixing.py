"""Mix sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every source gets a target number of words. It is taken whole as often as it fits (complete epochs); for the
rest its documents are ordered by an exponential key, -ln(u) / quality weight, and taken while the words before
a document plus half its own fit. u is a hash of the document id, so reruns agree.

No source is sorted as a whole: the keys are cut into buckets that follow their order, bucket sums give the one
bucket in which a source's rest runs out, and only that bucket's rows are ordered. A decision is then a
comparison with its source's cut, so the texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelq.llm.base import query, small_join, table
from labelq.session import materialised

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SOURCE_ROWS = 100_000  # a table of cuts is broadcast up to this many sources

QUALITY_WEIGHT = {1: 2.0, 0: 0.5, None: 1.0}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_keys(docs: DataFrame, quality_weight: Column | None = None, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """Add ``_source`` (a key that is never null), ``_size``, ``_key``, ``_bucket`` and ``_id`` to documents."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    weight = F.lit(1.0) if quality_weight is None else quality_weight
    return (
        docs.withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~")))
        .withColumn("_size", word_count(F.col("text")) if size is None else size)
        .withColumn("_key", -F.log(u) / weight)
        .withColumn("_bucket", F.floor((1.0 - F.exp(-F.col("_key"))) * BUCKETS).cast("int"))
        .withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets of sources (_source, source_size): shares of all sizes by weight, at most ``most`` times a source.

    Sources are numbered by code point, null last. Sorted by how soon they fill, the sources before the first
    that is not full are full; what they leave is shared by weight among the rest.
    """
    by_name = F.row_number().over(W.orderBy(F.col("_source") == "~", F.col("_source"))) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), by_name % len(weights))
    full = (F.lit(most) * F.col("source_size")).cast("double")
    order = W.orderBy(full / F.col("_w"), "_source")
    open_lambda = (F.sum("source_size").over(W.partitionBy()).cast("double") - F.coalesce(F.sum(full).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing))
    listed = sizes.withColumn("_w", weight).withColumn("_l", open_lambda)
    level = F.min(F.when(full / F.col("_w") >= F.col("_l"), F.struct((full / F.col("_w")).alias("r"), F.col("_l").alias("l"))))
    level = level.over(W.partitionBy())["l"]
    return listed.select("_source", "source_size", F.least(full, F.coalesce(level * F.col("_w"), full)).alias("target"))


def cuts(thin: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source: source_size, target, epochs, and where its rest ends: a last whole bucket and a last row after it."""
    sums = thin.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_s"))
    sizes = sums.groupBy("_source").agg(F.sum("_s").alias("source_size"))
    goal = targets(sizes, weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    order = W.partitionBy("_source").orderBy("_bucket")
    held = sums.withColumn("_upto", F.sum("_s").over(order)).join(goal, "_source")
    edges = held.groupBy("_source", "source_size", "target", "epochs", "rest").agg(
        F.max(F.when(F.col("_upto") <= F.col("rest"), F.col("_bucket"))).alias("whole"),
        F.min(F.when(F.col("_upto") > F.col("rest"), F.struct("_bucket", (F.col("_upto") - F.col("_s")).alias("before")))).alias("_part"))
    part = edges.select("_source", F.col("_part._bucket").alias("_bucket"), F.col("_part.before").alias("_before"), "rest").where("_bucket is not null and rest > 0")
    row = F.struct("_key", "_id", "_size")
    inside = thin.join(part, ["_source", "_bucket"]).withColumn(
        "_at", F.col("_before") + F.sum("_size").over(W.partitionBy("_source", "_bucket").orderBy("_key", "_id", "_size").rowsBetween(W.unboundedPreceding, 0)) - F.col("_size"))
    last = inside.where(F.col("_at") + F.col("_size") / 2 <= F.col("rest")).groupBy("_source").agg(F.max(row).alias("last"))
    return edges.drop("_part", "rest").join(last, "_source", "left")


def decided(keyed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Join the cuts and add ``times``, how often the mix takes a row."""
    small = decisions.limit(SOURCE_ROWS + 1).count() <= SOURCE_ROWS
    joined = keyed.join(F.broadcast(decisions) if small else decisions, "_source")
    extra = (F.col("_bucket") <= F.col("whole")) | (F.struct("_key", "_id", "_size") <= F.col("last"))
    return joined.withColumn("times", F.col("epochs") + F.coalesce(extra, F.lit(False)).cast("long"))


def _qualities(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))


def _weight() -> Column:
    return F.when(F.col("_quality") == 1, QUALITY_WEIGHT[1]).when(F.col("_quality") == 0, QUALITY_WEIGHT[0]).otherwise(QUALITY_WEIGHT[None])


def quality_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``_weight`` from the quality labels: doubled for good, halved for bad, 1 where there is no label."""
    return small_join(docs, materialised(_qualities(labels), "quality"), ["doc_id"]).withColumn("_weight", _weight()).drop("_quality")


def mix(docs: DataFrame, quality_weight: Column | None = None, weights=WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken.

    ``quality_weight`` and ``size`` are expressions over ``docs``, by default 1 and the words of the text; all
    weights are positive. A null text has no words, a null
    source is a source of its own, null ids hash alike and are ordered by size. A document without words is taken
    with 0 words. Equal rows are taken alike. An empty table gives an empty result; other columns are ignored.
    ``taken`` counts repeats and comes within half a document of the target; it is at most ``most`` times ``size``.
    """
    keyed = with_keys(docs, quality_weight, seed, size).select("doc_id", "source", "_source", "_size", "_key", "_bucket", "_id")
    thin = materialised(keyed, "mix")
    out = decided(thin, materialised(cuts(thin, weights, most), "cuts"))
    return out.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("times")).alias("taken"))


def repeated(docs: DataFrame, labels: DataFrame | None = None, weights=WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``.

    ``labels`` (doc_id, quality) weighs the documents; without it all weigh the same.
    """
    packed = docs.select("doc_id", "source", word_count(F.col("text")).alias("_size"), F.struct(*docs.columns).alias("_row"))
    thin = packed.drop("_row")
    weight = None
    if labels is not None:
        # Texts meet the labels in one shuffle at every size; the cuts are found on rows without texts.
        held = materialised(_qualities(labels), "quality")
        thin, packed = (x.join(held.hint("merge"), "doc_id", "left").withColumn("_weight", _weight()).drop("_quality") for x in (thin, packed))
        weight = F.col("_weight")
    keys = ("_source", "_size", "_key", "_bucket", "_id")
    thin = materialised(with_keys(thin, weight, seed, F.col("_size")).select(*keys), "mix")
    taken = decided(with_keys(packed, weight, seed, F.col("_size")), materialised(cuts(thin, weights, most), "cuts")).where("times > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("_row.*")


SQL = r"""WITH d AS (
 SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  -ln((('0x'||substr(md5('mix:'||doc_id),1,13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
  / (CASE q WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS k
 FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id)),
s AS (SELECT source, sum(size)::DOUBLE AS z, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * z / w AS r, (sum(z) OVER () - coalesce(sum(3 * z) OVER (ORDER BY 3 * z / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
 / sum(w) OVER (ORDER BY 3 * z / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM s),
t AS (SELECT source, z, least(3 * z, coalesce((SELECT arg_min(l, r) FROM o WHERE r >= l) * w, 3 * z)) AS target FROM o),
e AS (SELECT *, CASE WHEN z > 0 THEN floor(target / z)::BIGINT ELSE 0 END AS epochs FROM t),
c AS (SELECT d.*, e.z, e.target, e.epochs, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
 FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, z::BIGINT AS source_size, target,
 (size * (epochs + CASE WHEN size > 0 AND before + size / 2 <= target - epochs * z THEN 1 ELSE 0 END))::BIGINT AS taken FROM c"""


@query("op3_mix_sources", SQL)
def op3_mix_sources(spark, sf):
    docs = table(spark, sf, "documents")
    thin = materialised(docs.select("doc_id", "source", word_count(F.col("text")).alias("n")), "sizes")
    weighed = quality_weights(thin, table(spark, sf, "labels"))
    return mix(weighed, F.col("_weight"), size=F.col("n"))
