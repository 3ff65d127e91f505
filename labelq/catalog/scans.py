"""File fixtures are written from the given tables into a fresh folder, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelq.catalog.base import U, ctes, fragment, lab_order, preds_line, query, table
from labelq.catalog.results import METHODS, NOISES, datacard_long, datacard_wide
from labelq.functions import rand
from labelq.operators.metrics import metrics
from labelq.session import open_files, scratch_path
from labelq.sources import readers, writers

ORDER_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
RUN_FILES = 8 * len(NOISES) * len(METHODS)  # runs of the eight data sets
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _scratch(spark, name):
    return scratch_path(spark, name)


@query("scan_csv_header", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority AS label FROM orders")
def _(spark, sf):
    path = _scratch(spark, "csv")
    table(spark, sf, "orders").select(*ORDER_COLS).write.csv(path, header=True)
    return readers.csv_with_header(spark, path, ORDER_SCHEMA, "o_orderpriority", ["o_orderstatus"])


@query("scan_csv_named", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf):
    path = _scratch(spark, "csv")
    table(spark, sf, "orders").select(*ORDER_COLS).write.csv(path, header=False)
    return readers.csv_named(spark, path, ORDER_SCHEMA)


@query("scan_tsv_label_first", "SELECT l_linenumber - 1 AS label, l_quantity AS v0, l_extendedprice AS v1, l_discount AS v2, l_tax AS v3 FROM lineitem")
def _(spark, sf):
    path = _scratch(spark, "tsv")
    table(spark, sf, "lineitem").select("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax").write.option("sep", "\t").csv(path)
    d = readers.tsv_label_first(spark, path, 4)
    return d.select("label", *[F.col("channels")[0][i].alias(f"v{i}") for i in range(4)])


@query("scan_labelled_dirs", r"""SELECT lang AS label, count(*) AS n, sum(length(t))::BIGINT AS chars, min(md5(t)) AS least, max(md5(t)) AS greatest FROM (
 SELECT lang, regexp_replace(replace(text, chr(10), ''), '^\s+|\s+$', '', 'g') AS t FROM documents) GROUP BY lang""")
def _(spark, sf):
    path = _scratch(spark, "dirs")
    docs = table(spark, sf, "documents").select("lang", "text")
    writers.labelled_dirs(docs, path, "lang", "text")  # one file per document
    d = readers.labelled_dirs(spark, path).withColumn("label", F.regexp_extract("label", "=(.*)$", 1))
    return d.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"),
                                  F.min(F.md5("text")).alias("least"), F.max(F.md5("text")).alias("greatest"))


@query("scan_ts_text", "SELECT vec_id AS id, label::VARCHAR AS label, round(embedding[1]::DOUBLE,6) AS c0t0, round(embedding[32]::DOUBLE,6) AS c0t31, round(embedding[33]::DOUBLE,6) AS c1t0, 2 AS n_channels FROM embeddings")
def _(spark, sf):
    path = _scratch(spark, "ts")
    e = table(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>").cast("array<string>"))
    ch = lambda a: F.concat_ws(",", F.slice("e", a, 32))
    e.select(F.concat_ws(":", ch(1), ch(33), F.concat_ws(",", F.col("vec_id").cast("string")), F.col("label").cast("string")).alias("value")).write.text(path)
    d = readers.ts_text(spark, path)
    c = F.col("channels")
    return d.select(c[2][0].cast("long").alias("id"), "label", F.round(c[0][0], 6).alias("c0t0"), F.round(c[0][31], 6).alias("c0t31"),
                    F.round(c[1][0], 6).alias("c1t0"), (F.size(c) - 1).alias("n_channels"))


@query("scan_arff_text", "SELECT l_quantity AS v0, l_extendedprice AS v1, l_discount AS v2, l_returnflag AS label FROM lineitem")
def _(spark, sf):
    path = _scratch(spark, "arff")
    li = table(spark, sf, "lineitem")
    li.select(F.concat_ws(",", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag").alias("value")).write.text(path)
    header = li.select(F.explode(F.array(*[F.lit(x) for x in ("@relation lines", "@attribute quantity numeric", "@data")])).alias("value")).limit(3)
    header.write.mode("append").text(path)
    d = readers.arff_text(spark, path)
    return d.select(*[F.col("features")[i].alias(f"v{i}") for i in range(3)], "label")


@query("derive_label_lookup", """SELECT s.doc_id, (CASE WHEN contains(lower(text),'the') THEN 1 WHEN contains(lower(text),'que') OR contains(lower(text),'sch') THEN coalesce(seen,0) ELSE 0 END)::INT AS label
 FROM documents s LEFT JOIN (SELECT d.doc_id, d.lang, d.source, max((l.quality=1)::INT) AS seen FROM labels l JOIN documents d ON d.doc_id=l.doc_id GROUP BY 1,2,3) r
 ON r.doc_id=s.doc_id AND r.lang=s.lang AND r.source=s.source""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    reading = F.when(F.col("quality") == 1, "good").otherwise("poor").alias("reading")
    readings = table(spark, sf, "labels").join(docs.drop("text"), "doc_id").select("doc_id", "lang", "source", reading)
    out = readers.label_from_findings(docs, readings, ["doc_id", "lang", "source"], "text", "reading", "the", ["que", "sch"], "good")
    return out.select("doc_id", "label")


WIDE = [f"{p}_{m}" for m in METHODS for p in ("label_issues", "preds_cleaned")]


@query("scan_datacards", ctes("cards_wide") + "SELECT dataset, base_model, noise_type, seed, id, is_injected_noise, noisy_label, observed_labels, " + ", ".join(WIDE) + " FROM cards_wide")
def _(spark, sf):
    path = _scratch(spark, "cards")
    wide = datacard_wide(spark, sf)
    cols = ["id", "is_injected_noise", "noisy_label", *WIDE, "observed_labels"]
    # Spark writes one folder per run; the reader takes the run's name from the path, so each run's
    # rows go to results_<stamp>_randomseed_<seed>_<model>/<dataset>_<noise>_label_issues.csv.
    folder = F.concat(F.lit("results_20240101_randomseed_"), "seed", F.lit("_"), "base_model")
    file = F.concat("dataset", F.lit("_"), "noise_type", F.lit("_label_issues.csv"))
    wide.select(*cols, folder.alias("run"), file.alias("card")).hint("rebalance", "run", "card").write.partitionBy("run", "card").csv(path, header=True)
    raw = spark.read.schema(readers.DATACARD_SCHEMA).option("recursiveFileLookup", True).csv(path, header=True)
    return readers.with_run_names(raw, r"/run=([^/]+)/", r"/card=([^/]+)/").drop("stamp").select("dataset", "base_model", "noise_type", "seed", *cols)


@query("scan_preds", ctes("cards_long") + "SELECT dataset, base_model, noise_type, method, seed, count(*) AS n, sum(pred_cleaned)::BIGINT AS total FROM cards_long GROUP BY ALL")
def _(spark, sf):
    path = _scratch(spark, "preds")
    name = F.concat_ws("_", "dataset", "base_model", "noise_type", "method", "seed", F.lit("test_preds.csv"))
    # The narrow orders are dealt by data set, so that a task writes the files of few runs; the 24 rows that come of
    # each are not moved or sorted, every run has its own open file.
    orders = lab_order(spark, sf, spread=False).withColumn("_d", F.col("cust") % 8).hint("rebalance", "_d").drop("_d")
    preds = datacard_long(spark, sf, orders).select(F.col("pred_cleaned").alias("pred"), name.alias("file"))
    with open_files(spark, RUN_FILES):
        preds.write.partitionBy("file").csv(path)
    d = readers.predictions(spark, path, r"/file=([^/]+)/", "*.csv")
    return d.groupBy("dataset", "base_model", "noise_type", "method", "seed").agg(F.count("*").alias("n"), F.sum("pred").alias("total"))


@query("write_datacard", ctes("cards_long") + "SELECT dataset, base_model, noise_type, seed, method, count(*) AS n, sum(label_issue)::BIGINT AS flagged FROM cards_long WHERE noise_type='uniform-0.4' GROUP BY ALL")
def _(spark, sf):
    path = _scratch(spark, "datacard")
    writers.datacard(datacard_long(spark, sf), path)
    d = writers.read_datacard(spark, path).filter("noise_type = 'uniform-0.4'")
    return d.groupBy("dataset", "base_model", "noise_type", F.col("seed").cast("string").alias("seed"), "method").agg(F.count("*").alias("n"), F.sum("label_issue").alias("flagged"))


fragment("split_preds", f"SELECT id, label AS t, pred AS p, {U('split/side', 'id')} < 0.25 AS te FROM preds_line", "preds_line")


@query("write_metrics", ctes("split_preds") + """SELECT split, count(*) AS n_rows, round(avg((t=p)::INT),6) AS accuracy FROM (SELECT *, CASE WHEN te THEN 'test' ELSE 'train' END AS split FROM split_preds) GROUP BY split""")
def _(spark, sf):
    path = _scratch(spark, "metrics")
    d = preds_line(spark, sf)
    test = rand.uniform("split/side", "id") < 0.25
    writers.metrics_csv(metrics(d.filter(~test), "label", "pred"), metrics(d.filter(test), "label", "pred"), path)
    back = spark.read.csv(path, header=True, schema="n_rows long, f1 double, weighted_f1 double, accuracy double, precision double, recall double, error_rate double, true_error_rate double, weighted_precision double, weighted_recall double, split string")
    return back.select("split", "n_rows", "accuracy")


@query("skip_done_runs", ctes("cards_long") + """SELECT g.dataset, g.noise_type, g.method FROM (SELECT DISTINCT dataset, noise_type, method FROM cards_long) g
 LEFT JOIN (SELECT DISTINCT dataset, noise_type, method FROM cards_long WHERE label_issue=1 AND method='aum') d ON d.dataset=g.dataset AND d.noise_type=g.noise_type AND d.method=g.method WHERE d.dataset IS NULL""")
def _(spark, sf):
    runs = datacard_long(spark, sf)
    grid = runs.select("dataset", "noise_type", "method").distinct()
    return writers.pending_runs(grid, runs.filter("label_issue = 1 AND method = 'aum'"))
