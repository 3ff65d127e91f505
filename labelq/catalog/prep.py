"""Projection, cleaning, encoding and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelq.catalog.base import DIM, KE, KL, U, ctes, fragment, lab_embed, lab_line, lab_order, preds_line, dynamics_line, probs_line, query, table
from labelq.functions import arrays, rand
from labelq.operators import prep
from labelq.operators.sampling import stratified_split
from labelq.session import materialised
from labelq.sources.readers import strip


@query("drop_null_rows", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL AND d.lang IS NOT NULL")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.na.drop()


@query("nan_to_zero", "SELECT event_id, CASE WHEN value >= 50 OR value IS NULL THEN 0 ELSE round(value, 6) END AS value FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("value") >= 50, float("nan")).otherwise(F.col("value")).alias("value"))
    return prep.nan_to_zero(e, ["value"]).withColumn("value", F.round("value", 6))


@query("cast_types", """SELECT l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey AS id, round((l_extendedprice::FLOAT)::DOUBLE,3) AS price, (l_quantity)::BIGINT AS quantity FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
                     F.round(F.col("l_extendedprice").cast("float").cast("double"), 3).alias("price"), F.col("l_quantity").cast("long").alias("quantity"))


@query("assemble_features", ctes("lab_line") + "SELECT id, i-1 AS pos, features[i] AS value FROM (SELECT id, features, unnest(range(1,5)) AS i FROM lab_line)")
def _(spark, sf):
    return lab_line(spark, sf).select("id", F.posexplode("features").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query("flatten_channels", ctes("lab_embed") + f"""SELECT id, i-1 AS pos, features[i] AS flat, features[1 + ((i-1) % 2) * 32 + (i-1)//2] AS transposed FROM (SELECT id, features, unnest(range(1,{DIM+1})) AS i FROM lab_embed)""")
def _(spark, sf):
    two = lab_embed(spark, sf).select("id", F.array(F.slice("features", 1, 32), F.slice("features", 33, 32)).alias("ch"))
    flat = F.get(prep.flatten_channels(F.col("ch")), F.lit(0))
    both = F.arrays_zip(flat.alias("flat"), F.flatten(prep.transpose(F.col("ch"))).alias("transposed"))
    return two.select("id", F.posexplode(both).alias("pos", "z")).select("id", F.col("pos").cast("long").alias("pos"), "z.flat", "z.transposed")


fragment("flags_embed", f"SELECT id, ({U('flag', 'id')} < 0.3)::INT AS label_issue FROM lab_embed", "lab_embed")


def flags_embed(spark, sf):
    return lab_embed(spark, sf).select("id", (rand.uniform("flag", "id") < 0.3).cast("int").alias("label_issue"))


@query("clean_data", ctes("flags_embed") + "SELECT e.id, e.label FROM lab_embed e JOIN flags_embed f ON f.id=e.id WHERE f.label_issue=0")
def _(spark, sf):
    return prep.clean(lab_embed(spark, sf).select("id", "label"), flags_embed(spark, sf))


@query("select_ids", ctes("flags_embed") + "SELECT e.id, e.label FROM lab_embed e WHERE e.id IN (SELECT id FROM flags_embed WHERE label_issue=1)")
def _(spark, sf):
    return prep.select_ids(lab_embed(spark, sf).select("id", "label"), flags_embed(spark, sf).filter("label_issue = 1"))


@query("one_hot", ctes("lab_line") + "SELECT id, " + ", ".join(f"(label={c})::INT AS c{c}" for c in range(KL)) + " FROM lab_line")
def _(spark, sf):
    d = prep.one_hot(lab_line(spark, sf), "label", list(range(KL)))
    return d.select("id", *[F.col("one_hot")[c].alias(f"c{c}") for c in range(KL)])


@query("softmax", ctes("dynamics_line") + "SELECT id, epoch::INT AS epoch, " + ", ".join(
    f"round(exp(logits[{j+1}]-list_max(logits))/(exp(logits[1]-list_max(logits))+exp(logits[2]-list_max(logits))+exp(logits[3]-list_max(logits))),6) AS p{j}" for j in range(KL)) + " FROM dynamics_line")
def _(spark, sf):
    d = dynamics_line(spark, sf).select("id", "epoch", arrays.softmax("logits").alias("p"))
    return d.select("id", "epoch", *[F.round(F.col("p")[j], 6).alias(f"p{j}") for j in range(KL)])


@query("argmax_pred", ctes("probs_line") + "SELECT id, (list_position(probs, list_max(probs))-1)::INT AS pred FROM probs_line")
def _(spark, sf):
    return probs_line(spark, sf).select("id", arrays.argmax("probs").alias("pred"))


@query("string_ops", r"""SELECT doc_id, contains(lower(text), 'the') AS has_word, length(regexp_replace(replace(text, chr(10), ''), '^\s+|\s+$', '', 'g')) AS n_clean,
 split_part(lang||'-'||source||'-0.1', '-', 1) AS head, regexp_extract(lang||'-'||source||'-0.1', '^(.*)-', 1) AS prefix FROM documents""")
def _(spark, sf):
    name = F.concat_ws("-", "lang", "source", F.lit("0.1"))
    return table(spark, sf, "documents").select(
        "doc_id", F.contains(F.lower("text"), F.lit("the")).alias("has_word"),
        F.length(strip(F.regexp_replace("text", "\n", ""))).cast("long").alias("n_clean"),
        F.split(name, "-")[0].alias("head"), F.regexp_extract(name, "^(.*)-", 1).alias("prefix"))


@query("label_offset", "SELECT o_orderkey AS id, substr(o_orderpriority,1,1)::INT - 1 AS label FROM orders")
def _(spark, sf):
    return lab_order(spark, sf, spread=False).select("id", "label")


@query("round6", ctes("probs_line") + "SELECT id, round(probs[1],6) AS p FROM probs_line")
def _(spark, sf):
    return probs_line(spark, sf).select("id", F.round(F.col("probs")[0], 6).alias("p"))


@query("encode_low_cardinality", """SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderstatus)-1)::INT AS o_orderstatus, (dense_rank() OVER (ORDER BY o_orderpriority)-1)::INT AS o_orderpriority,
 'Customer-'||o_custkey||'-'||o_orderkey AS free_text FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.concat_ws("-", F.lit("Customer"), "o_custkey", "o_orderkey").alias("free_text"))
    return prep.encode_low_cardinality(o)


@query("encode_label", "SELECT o_orderkey AS id, (dense_rank() OVER (ORDER BY o_orderpriority)-1)::INT AS label FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    return prep.encode(o, "label", prep.codes(o, "label")).select("id", "label")


NUM = ["q", "p", "d", "t"]


def numeric_line(spark, sf):
    return lab_line(spark, sf).select("id", "label", *[F.col("features")[i].alias(c) for i, c in enumerate(NUM)])


fragment("num_line", "SELECT id, label, features[1] AS q, features[2] AS p, features[3] AS d, features[4] AS t FROM lab_line", "lab_line")


@query("standard_scale", ctes("num_line") + f""", s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ('0x'||substr(md5('split:'||id),1,8))::BIGINT, id) <= round(count(*) OVER (PARTITION BY label)*0.15::DOUBLE) AS te FROM num_line),
 f AS (SELECT {', '.join(f"avg({c}) AS m{c}, stddev_pop({c}) AS s{c}" for c in NUM)} FROM s WHERE NOT te)
 SELECT id, te::INT AS is_test, {', '.join(f"round(({c}-m{c})/s{c},6) AS {c}" for c in NUM)} FROM s, f""")
def _(spark, sf):
    # The draw is hashed once and stored; the split itself is then a comparison with constants.
    stored = materialised(numeric_line(spark, sf).withColumn("_draw", rand.hash32("split", "id")), "drawn")
    d = stratified_split(stored, "label", 0.15, drawn="_draw")
    fit = prep.standard_fit(d.filter("is_test = 0"), NUM)
    return prep.standard_apply(d, fit, NUM).select("id", "is_test", *[F.round(c, 6).alias(c) for c in NUM])


@query("zscore_per_record", """SELECT event_id, user_id, round((value-m)/CASE WHEN s=0 THEN 1 ELSE s END,6) AS value FROM events JOIN
 (SELECT user_id AS u, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) ON u=user_id""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return prep.zscore_per_record(e, ["user_id"], "value").withColumn("value", F.round("value", 6)).select("event_id", "user_id", "value")


@query("minmax_per_channel", ctes("lab_embed") + f""", x AS (SELECT id, i, features[i] AS v FROM (SELECT id, features, unnest(range(1,{DIM+1})) AS i FROM lab_embed)),
 f AS (SELECT i, min(v) AS lo, max(v) AS hi FROM x GROUP BY i) SELECT x.id, x.i-1 AS pos, round((v-lo)/(hi-lo),6) AS value FROM x JOIN f ON f.i=x.i""")
def _(spark, sf):
    e = lab_embed(spark, sf)
    d = prep.minmax_apply(e, prep.minmax_fit(e))
    return d.select("id", F.posexplode("features").alias("pos", "v")).select("id", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("value"))


@query("set_ops", ctes("flags_embed", "lab_embed") + f""", a AS (SELECT id FROM flags_embed WHERE label_issue=1), b AS (SELECT id FROM lab_embed WHERE {U('other', 'id')} < 0.4)
 SELECT 'union' AS op, id FROM (SELECT id FROM a UNION SELECT id FROM b) UNION ALL
 SELECT 'symmetric_difference', id FROM ((SELECT id FROM a EXCEPT SELECT id FROM b) UNION (SELECT id FROM b EXCEPT SELECT id FROM a)) UNION ALL
 SELECT 'difference', id FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL
 SELECT 'distinct_labels', label FROM (SELECT DISTINCT label::BIGINT AS label FROM lab_embed)""")
def _(spark, sf):
    a = flags_embed(spark, sf).filter("label_issue = 1").select("id")
    b = lab_embed(spark, sf).filter(rand.uniform("other", "id") < 0.4).select("id")
    labels = lab_embed(spark, sf).select(F.col("label").cast("long").alias("id")).distinct()
    tag = lambda d, op: d.select(F.lit(op).alias("op"), "id")
    return (tag(prep.union_ids(a, b), "union").union(tag(prep.symmetric_difference(a, b), "symmetric_difference"))
            .union(tag(a.exceptAll(b), "difference")).union(tag(labels, "distinct_labels")))
