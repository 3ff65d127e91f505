"""Run tables, result tables, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelq.catalog.base import KO, U, ctes, fragment, lab_order, metrics_sql, query, table
from labelq.functions import rand
from labelq.operators import votes
from labelq.session import materialised
from labelq.plans import ranking, results

# Method names of the stored run tables.
METHODS = ["aum", "cincer", "simifeat", "cleanlab"]
# Chance that a method flags a corrupted row, and a clean row.
HIT = {"aum": (0.60, 0.30), "cincer": (0.70, 0.25), "simifeat": (0.80, 0.20), "cleanlab": (0.50, 0.35)}
NOISES = ["uniform-0.1", "uniform-0.4", "asymmetric-0.1", "asymmetric-0.4", "dissenting-0.1", "dissenting-0.4"]
MODELS = ["mlp", "fcn", "resnet18", "all-MiniLM-L6-v2"]
RUNS = results.RUN


def datacard_wide(spark, sf, orders=None):
    """``orders``: the labelled orders, where the caller deals them itself."""
    o = (lab_order(spark, sf) if orders is None else orders).withColumn("noise_type", F.explode(F.array(*[F.lit(n) for n in NOISES])))
    tag = lambda s: F.concat(F.col("noise_type"), F.lit(s))
    inj = rand.uniform(tag("/inj"), "id") < F.split("noise_type", "-")[1].cast("double")
    d = o.withColumn("is_injected_noise", inj.cast("int")).withColumn("noisy_label", F.when(F.col("is_injected_noise") == 1, (F.col("label") + 1) % KO).otherwise(F.col("label")).cast("int"))
    flags = []
    for m, (hit, false) in HIT.items():
        flags.append((rand.uniform(tag(f"/{m}"), "id") < F.when(F.col("is_injected_noise") == 1, hit).otherwise(false)).cast("int").alias(f"label_issues_{m}"))
        flags.append(F.when(rand.uniform(tag(f"/pred/{m}"), "id") < HIT[m][0], F.col("label")).otherwise(F.col("noisy_label")).cast("int").alias(f"preds_cleaned_{m}"))
    ds = F.col("cust") % 8
    return d.select(F.concat(F.lit("d"), ds.cast("string")).alias("dataset"), F.element_at(F.array(*[F.lit(m) for m in MODELS]), (ds % 4 + 1).cast("int")).alias("base_model"),
                    "noise_type", F.lit("42").alias("seed"), "id", F.col("label").alias("observed_labels"), "noisy_label", "is_injected_noise", *flags)


def datacard_long(spark, sf, orders=None):
    return results.datacard_long(datacard_wide(spark, sf, orders), METHODS)


_T = lambda s: f"(noise_type||'{s}')"
fragment("cards_base", f"""SELECT *, (CASE WHEN is_injected_noise=1 THEN (label+1)%{KO} ELSE label END)::INT AS noisy_label FROM (
 SELECT id, label, cust, noise_type, ({U(_T('/inj'), 'id')} < split_part(noise_type,'-',2)::DOUBLE)::INT AS is_injected_noise FROM lab_order, (SELECT unnest({NOISES}) AS noise_type))""", "lab_order")
fragment("cards_wide", f"""SELECT 'd'||(cust%8) AS dataset, {MODELS}[cust%4+1] AS base_model, noise_type, '42' AS seed, id, label AS observed_labels, noisy_label, is_injected_noise, """ + ", ".join(
    f"({U(_T(f'/{m}'), 'id')} < CASE WHEN is_injected_noise=1 THEN {h} ELSE {f} END)::INT AS label_issues_{m}, (CASE WHEN {U(_T(f'/pred/{m}'), 'id')} < {h} THEN label ELSE noisy_label END)::INT AS preds_cleaned_{m}"
    for m, (h, f) in HIT.items()) + " FROM cards_base", "cards_base")
fragment("cards_long", " UNION ALL ".join(
    f"SELECT dataset, base_model, noise_type, seed, id, observed_labels, noisy_label, is_injected_noise, '{m}' AS method, label_issues_{m} AS label_issue, preds_cleaned_{m} AS pred_cleaned FROM cards_wide" for m in METHODS), "cards_wide")

LONG_COLS = "dataset, base_model, noise_type, seed, id, observed_labels, noisy_label, is_injected_noise, method, label_issue, pred_cleaned"
BY = "dataset, base_model, noise_type, seed, method"
F1 = ("weighted_f1", "accuracy", "weighted_precision", "weighted_recall")


@query("datacard_long", ctes("cards_long") + f"SELECT {LONG_COLS} FROM cards_long")
def _(spark, sf):
    return datacard_long(spark, sf)


def partial(spark, sf):
    """Run tables in which one run lacks a method."""
    return datacard_long(spark, sf).filter(~((F.col("dataset") == "d7") & (F.col("noise_type") == "dissenting-0.4") & (F.col("method") == "cleanlab")))


@query("complete_runs", ctes("cards_long") + """SELECT dataset, noise_type, method, count(*) AS n FROM cards_long WHERE NOT (dataset='d7' AND noise_type='dissenting-0.4') GROUP BY ALL""")
def _(spark, sf):
    return results.complete_runs(partial(spark, sf), 4).groupBy("dataset", "noise_type", "method").agg(F.count("*").alias("n"))


def detection(spark, sf):
    return results.detection_metrics(datacard_long(spark, sf))


fragment("det", metrics_sql(f"(SELECT {BY}, is_injected_noise AS t, label_issue AS p FROM cards_long)", BY, F1), "cards_long")


@query("detection_metrics", ctes("det") + "SELECT * FROM det")
def _(spark, sf):
    return detection(spark, sf).select(*results.RUN_METHOD, "n_rows", *F1)


@query("noisy_row_prediction_metrics", ctes("cards_long") + metrics_sql(f"(SELECT {BY}, noisy_label AS t, pred_cleaned AS p FROM cards_long WHERE is_injected_noise=1)", BY, F1))
def _(spark, sf):
    return results.noisy_row_metrics(datacard_long(spark, sf)).select(*results.RUN_METHOD, "n_rows", *F1)


@query("issue_counts", ctes("cards_long") + f"SELECT {BY}, sum(is_injected_noise)::BIGINT AS injected, sum(label_issue)::BIGINT AS flagged FROM cards_long GROUP BY ALL")
def _(spark, sf):
    return results.issue_counts(datacard_long(spark, sf))


# ---- stored test predictions: one run (d7, cleanlab) is missing ----

DOWN = {"nocleaning": 0.62, "aum": 0.66, "cincer": 0.70, "simifeat": 0.70, "cleanlab": 0.55}


def test_labels(spark, sf):
    o = lab_order(spark, sf).filter(rand.uniform("test", "id") < 0.5)
    return o.select(F.concat(F.lit("d"), (F.col("cust") % 8).cast("string")).alias("dataset"), "id", "label")


def stored_preds(spark, sf):
    base = datacard_wide(spark, sf).select(*RUNS, "id", F.col("observed_labels").alias("label"))
    items = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(a).alias("acc")) for m, a in DOWN.items()]))
    d = base.select("*", items.alias("m")).select(*RUNS, "id", "label", "m.*")
    good = rand.uniform(F.concat("noise_type", F.lit("/down/"), "method"), "id") < F.col("acc")
    pred = F.when(good, F.col("label")).otherwise((F.col("label") + 2) % KO).cast("int")
    return d.filter(~((F.col("dataset") == "d7") & (F.col("method") == "cleanlab"))).select(*RUNS, "method", "id", pred.alias("pred"))


fragment("stored_preds", f"""SELECT dataset, base_model, noise_type, seed, method, id, label, (CASE WHEN {U("(noise_type||'/down/'||method)", 'id')} < acc THEN label ELSE (label+2)%{KO} END)::INT AS pred
 FROM (SELECT dataset, base_model, noise_type, seed, id, observed_labels AS label FROM cards_wide), (SELECT unnest({list(DOWN)}) AS method, unnest({list(DOWN.values())}::DOUBLE[]) AS acc)
 WHERE NOT (dataset='d7' AND method='cleanlab')""", "cards_wide")
fragment("down", metrics_sql(f"(SELECT {BY}, label AS t, pred AS p FROM stored_preds WHERE {U('test', 'id')} < 0.5)", BY, F1), "stored_preds")


def downstream(spark, sf):
    return results.downstream_metrics(stored_preds(spark, sf), test_labels(spark, sf))


@query("downstream_metrics", ctes("down") + "SELECT * FROM down")
def _(spark, sf):
    return downstream(spark, sf).select(*results.RUN_METHOD, "n_rows", *F1)


LOW = [(n, m) for n in NOISES if n.endswith("0.1") for m in METHODS]


def _name(n, m):
    return f"{n}_{m}".replace("-", "_").replace(".", "_")


@query("table_downstream", ctes("down") + "SELECT dataset, " + ", ".join(f"max(weighted_f1) FILTER (WHERE noise_type='{n}' AND method='{m}') AS {_name(n, m)}" for n, m in LOW) + " FROM down WHERE noise_type LIKE '%-0.1' GROUP BY dataset")
def _(spark, sf):
    t = results.pivot_runs(results.with_rate(downstream(spark, sf), ["0.1"]), "weighted_f1", LOW)
    return t.select("dataset", *[F.col(f"`{n}_{m}`").alias(_name(n, m)) for n, m in LOW])


@query("table_detection", ctes("det") + "SELECT dataset, " + ", ".join(f"max(weighted_f1) FILTER (WHERE noise_type='{n}' AND method='{m}') AS {_name(n, m)}" for n, m in LOW) + " FROM det WHERE noise_type LIKE '%-0.1' AND noise_type <> 'dissenting-0.1' AND dataset NOT IN ('d0','d3') GROUP BY dataset")
def _(spark, sf):
    d = results.without(results.with_rate(detection(spark, sf), ["0.1"]), dataset=["d0", "d3"], noise_type=["dissenting-0.1"])
    t = results.pivot_runs(d, "weighted_f1", LOW)
    return t.select("dataset", *[F.col(f"`{n}_{m}`").alias(_name(n, m)) for n, m in LOW])


fragment("results", f"""SELECT d.dataset, d.base_model, d.noise_type, d.seed, d.method, d.weighted_f1 AS cleaning_f1, w.weighted_f1 AS downstream_f1 FROM det d LEFT JOIN down w
 ON w.dataset=d.dataset AND w.base_model=d.base_model AND w.noise_type=d.noise_type AND w.seed=d.seed AND w.method=d.method
 UNION ALL SELECT {BY}, 0.0::DOUBLE, weighted_f1 FROM down WHERE method='nocleaning'""", "det", "down")


def results_df(spark, sf):
    return results.results_table(detection(spark, sf), downstream(spark, sf))


@query("results_table", ctes("results") + "SELECT * FROM results")
def _(spark, sf):
    return results_df(spark, sf)


@query("noise_name", ctes("results") + "SELECT noise_type, regexp_extract(noise_type, '^(.*)-', 1) AS noise_name, count(*) AS n FROM results GROUP BY ALL")
def _(spark, sf):
    return results_df(spark, sf).groupBy("noise_type", results.noise_name("noise_type").alias("noise_name")).agg(F.count("*").alias("n"))


MODAL = "CASE base_model WHEN 'mlp' THEN 'tabular' WHEN 'fcn' THEN 'time-series' WHEN 'resnet18' THEN 'image' ELSE 'text' END"


@query("modality_lookup", ctes("results") + f"SELECT base_model, {MODAL} AS modality, count(*) AS n FROM results GROUP BY ALL")
def _(spark, sf):
    return results.with_modality(results_df(spark, sf)).groupBy("base_model", "modality").agg(F.count("*").alias("n"))


# ---- ranking: values rounded to two digits, so that ties occur ----

BLOCK = ["dataset", "noise_type"]
fragment("scores", "SELECT dataset, noise_type, base_model, method, round(downstream_f1,2) AS v FROM results WHERE downstream_f1 IS NOT NULL", "results")
fragment("full_methods", "SELECT method, n FROM (SELECT method, count(*) AS n FROM scores GROUP BY 1) WHERE n=(SELECT max(n) FROM (SELECT count(*) AS n FROM scores GROUP BY method))", "scores")
fragment("block_scores", "SELECT * FROM scores WHERE method IN (SELECT method FROM full_methods)", "full_methods")


def scores(spark, sf):
    return results_df(spark, sf).filter(F.col("downstream_f1").isNotNull()).select("dataset", "noise_type", "base_model", "method", F.round("downstream_f1", 2).alias("v"))


def block_scores(spark, sf):
    s = scores(spark, sf)
    return s.join(F.broadcast(ranking.complete_groups(s).select("method")), "method", "left_semi")


@query("complete_groups", ctes("full_methods") + "SELECT method, n FROM full_methods")
def _(spark, sf):
    return ranking.complete_groups(scores(spark, sf))


fragment("ranks", "SELECT *, rank() OVER (PARTITION BY dataset, noise_type ORDER BY v DESC) + (count(*) OVER (PARTITION BY dataset, noise_type, v)-1)/2 AS r FROM block_scores", "block_scores")


@query("average_ranks", ctes("ranks") + "SELECT method, round(avg(r),6) AS average_rank, count(*) AS n_blocks FROM ranks GROUP BY method")
def _(spark, sf):
    return ranking.average_ranks(block_scores(spark, sf), BLOCK, "v").select("method", "average_rank", "n_blocks")


@query("wins", ctes("ranks") + "SELECT method, sum((r=1.0)::INT)::BIGINT AS wins FROM ranks GROUP BY method")
def _(spark, sf):
    return ranking.average_ranks(block_scores(spark, sf), BLOCK, "v").select("method", "wins")


def erfc_sql(x: str) -> str:
    """Complementary error function, x >= 0, fractional error below 1.2e-7 (published Chebyshev fit)."""
    t = f"(1.0::DOUBLE/(1.0::DOUBLE+0.5::DOUBLE*{x}))"
    # The coefficients of the published fit.
    cs = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]
    acc = f"({cs[0]}::DOUBLE)"
    for c in cs[1:]:
        acc = f"(({c}::DOUBLE)+{t}*{acc})"
    return f"({t}*exp(-({x})*({x})+{acc}))"


fragment("friedman", """SELECT k AS n_methods, n AS n_blocks, (12.0::DOUBLE/(n*k*(k+1))*rr - 3.0::DOUBLE*n*(k+1))/(1-ties/(n*k*(k*k-1))) AS x FROM (
 SELECT count(*) AS k, max(n) AS n, sum(s*s) AS rr FROM (SELECT method, sum(a) AS s, count(*) AS n FROM (
  SELECT method, rank() OVER (PARTITION BY dataset, noise_type ORDER BY v) + (count(*) OVER (PARTITION BY dataset, noise_type, v)-1)/2 AS a FROM block_scores) GROUP BY method)),
 (SELECT sum(t*t*t-t)::DOUBLE AS ties FROM (SELECT count(*) AS t FROM block_scores GROUP BY dataset, noise_type, v))""", "block_scores")


@query("friedman_test", ctes("friedman") + f"SELECT n_methods, n_blocks, round(x,6) AS statistic, round({erfc_sql('sqrt(x/2)')}+sqrt(2*x/pi())*exp(-x/2),5) AS p_value, (({erfc_sql('sqrt(x/2)')}+sqrt(2*x/pi())*exp(-x/2)) < 0.05)::INT AS significant FROM friedman")
def _(spark, sf):
    return ranking.friedman(block_scores(spark, sf), BLOCK, "v").withColumn("p_value", F.round("p_value", 5))


fragment("wx", """SELECT method_1, method_2, count(*) AS n, sum((a=0)::INT)::BIGINT AS n_zero, sum(r*(d>0)::INT) AS r_plus, sum(r*(d<0)::INT) AS r_minus FROM (
 SELECT *, rank() OVER (PARTITION BY method_1, method_2 ORDER BY a) + (count(*) OVER (PARTITION BY method_1, method_2, a)-1)/2 AS r FROM (
  SELECT x.method AS method_1, y.method AS method_2, round(x.v-y.v,9) AS d, abs(round(x.v-y.v,9)) AS a FROM block_scores x JOIN block_scores y ON x.dataset=y.dataset AND x.noise_type=y.noise_type AND x.method<y.method)) GROUP BY 1,2""", "block_scores")
fragment("wx_ties", """SELECT method_1, method_2, sum(t*(t*t-1))::DOUBLE AS ties FROM (SELECT x.method AS method_1, y.method AS method_2, abs(round(x.v-y.v,9)) AS a, count(*) AS t FROM block_scores x JOIN block_scores y
 ON x.dataset=y.dataset AND x.noise_type=y.noise_type AND x.method<y.method WHERE round(x.v-y.v,9)<>0 GROUP BY 1,2,3) GROUP BY 1,2""", "block_scores")
fragment("wx_z", """SELECT *, (least(r_plus,r_minus) - (n*(n+1)/4 - n_zero*(n_zero+1)/4)) / sqrt((n*(n+1)*(2*n+1) - n_zero*(n_zero+1)*(2*n_zero+1) - ties/2)/24) AS z FROM wx JOIN wx_ties USING (method_1, method_2)""", "wx", "wx_ties")


def pairs(spark, sf):
    return ranking.wilcoxon_pairs(block_scores(spark, sf), BLOCK, "v")


P_SQL = erfc_sql("(abs(z)/sqrt(2::DOUBLE))")


@query("wilcoxon_pairs", ctes("wx_z") + f"SELECT method_1, method_2, n, n_zero, r_plus, r_minus, least(r_plus,r_minus) AS statistic, round(z,6) AS z, round({P_SQL},5) AS p_value FROM wx_z")
def _(spark, sf):
    return pairs(spark, sf).withColumn("p_value", F.round("p_value", 5))


fragment("holm", f"""SELECT method_1, method_2, min(ok) OVER (ORDER BY p, method_1, method_2)::INT AS significant FROM (
 SELECT *, (p <= 0.05/(count(*) OVER () - row_number() OVER (ORDER BY p, method_1, method_2) + 1))::INT AS ok FROM (SELECT method_1, method_2, {P_SQL} AS p FROM wx_z))""", "wx_z")


@query("holm_correction", ctes("holm") + "SELECT method_1, method_2, significant FROM holm")
def _(spark, sf):
    return ranking.holm(pairs(spark, sf)).select("method_1", "method_2", "significant")


fragment("clique_members", """SELECT s, m FROM (SELECT unnest(range(1, (2::INT**(SELECT count(*) FROM full_methods))::INT)) AS s) a, (SELECT method AS m, row_number() OVER (ORDER BY method)-1 AS i FROM full_methods) b WHERE ((s >> i::INT) & 1) = 1""", "full_methods")
fragment("clique_ok", """SELECT s FROM (SELECT DISTINCT s FROM clique_members) WHERE s NOT IN (SELECT a.s FROM clique_members a JOIN clique_members b ON a.s=b.s AND a.m<b.m JOIN holm h ON h.method_1=a.m AND h.method_2=b.m WHERE h.significant=1)""", "clique_members", "holm")


@query("indistinct_groups", ctes("clique_ok") + """SELECT string_agg(m, ',' ORDER BY m) AS methods, count(*) AS size FROM clique_members WHERE s IN (SELECT s FROM clique_ok) AND s NOT IN (SELECT a.s FROM clique_ok a JOIN clique_ok b ON a.s<>b.s AND (a.s & b.s)=a.s) GROUP BY s""")
def _(spark, sf):
    return ranking.indistinct_groups(ranking.holm(pairs(spark, sf)))


def _slice_sql(measure: str, name: str, expr: str) -> str:
    return f"""SELECT '{measure}' AS measure, '{name}' AS slice_by, slice, method, round(avg(r),6) AS average_rank, count(*) AS n_blocks FROM (
 SELECT slice, method, rank() OVER (PARTITION BY slice, dataset, noise_type ORDER BY v DESC) + (count(*) OVER (PARTITION BY slice, dataset, noise_type, v)-1)/2 AS r FROM (
  SELECT {expr} AS slice, dataset, noise_type, method, round({measure},2) AS v FROM results WHERE {measure} IS NOT NULL AND ('{measure}'='downstream_f1' OR method<>'nocleaning'))) GROUP BY slice, method"""


SLICES = {"noise": "regexp_extract(noise_type, '^(.*)-', 1)", "modality": MODAL}


BY = ["measure", "slice_by", "slice"]


def sliced(spark, sf):
    """Slices and measures as rows, so that the figures of all of them come from one pass."""
    r = results.with_modality(results_df(spark, sf)).withColumn("noise", results.noise_name("noise_type"))
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.lit(s).alias("slice_by"), F.col(s).alias("slice"), F.round(m, 2).alias("v"))
        for m in ("cleaning_f1", "downstream_f1") for s in SLICES]))
    long = r.select(*BLOCK, "method", cells.alias("c")).select(*BLOCK, "method", "c.*").filter(F.col("v").isNotNull())
    return long.filter((F.col("measure") == "downstream_f1") | (F.col("method") != "nocleaning"))


@query("rank_by_slice", ctes("results") + " UNION ALL ".join(_slice_sql(m, n, e) for m in ("cleaning_f1", "downstream_f1") for n, e in SLICES.items()))
def _(spark, sf):
    return ranking.average_ranks(sliced(spark, sf), BLOCK, "v", BY).select(*BY, "method", "average_rank", "n_blocks")


fragment("sliced", " UNION ALL ".join(
    f"SELECT '{m}' AS measure, '{n}' AS slice_by, {e} AS slice, dataset, noise_type, method, round({m},2) AS v FROM results WHERE {m} IS NOT NULL AND ('{m}'='downstream_f1' OR method<>'nocleaning')"
    for m in ("cleaning_f1", "downstream_f1") for n, e in SLICES.items()), "results")
fragment("sliced_full", """SELECT s.* FROM sliced s JOIN (SELECT *, max(c) OVER (PARTITION BY measure, slice_by, slice) AS top FROM (SELECT measure, slice_by, slice, method, count(*) AS c FROM sliced GROUP BY ALL)) f
 ON f.measure=s.measure AND f.slice_by=s.slice_by AND f.slice=s.slice AND f.method=s.method WHERE c=top""", "sliced")
fragment("sliced_x", """SELECT measure, slice_by, slice, k, n, (12.0::DOUBLE/(n*k*(k+1))*rr - 3.0::DOUBLE*n*(k+1))/(1-ties/(n*k*(k*k-1))) AS x FROM (
 SELECT measure, slice_by, slice, count(*) AS k, max(n) AS n, sum(s*s) AS rr FROM (SELECT measure, slice_by, slice, method, sum(a) AS s, count(*) AS n FROM (
  SELECT *, rank() OVER (PARTITION BY measure, slice_by, slice, dataset, noise_type ORDER BY v) + (count(*) OVER (PARTITION BY measure, slice_by, slice, dataset, noise_type, v)-1)/2 AS a FROM sliced_full) GROUP BY ALL) GROUP BY ALL)
 JOIN (SELECT measure, slice_by, slice, sum(t*t*t-t)::DOUBLE AS ties FROM (SELECT measure, slice_by, slice, dataset, noise_type, v, count(*) AS t FROM sliced_full GROUP BY ALL) GROUP BY ALL) USING (measure, slice_by, slice)""", "sliced_full")
SLICE_P = f"CASE k WHEN 4 THEN {erfc_sql('sqrt(x/2)')}+sqrt(2*x/pi())*exp(-x/2) WHEN 5 THEN exp(-x/2)*(1+x/2) END"


def sliced_full(spark, sf):
    """Only methods with all results of their slice, as the tests need whole blocks."""
    long = materialised(sliced(spark, sf), "sliced")
    return long.join(ranking.complete_groups(long, by=BY).select(*BY, "method"), [*BY, "method"], "left_semi")


@query("friedman_by_slice", ctes("sliced_x") + f"SELECT measure, slice_by, slice, k AS n_methods, n AS n_blocks, round(x,6) AS statistic, round({SLICE_P},5) AS p_value, (({SLICE_P}) < 0.05)::INT AS significant FROM sliced_x")
def _(spark, sf):
    return ranking.friedman(sliced_full(spark, sf), BLOCK, "v", BY).withColumn("p_value", F.round("p_value", 5))


@query("compare_by_slice")
def _(spark, sf):
    """The whole comparison per slice: pair tests behind the overall test, and the groups they leave."""
    pairs = materialised(ranking.compare(sliced_full(spark, sf), BLOCK, "v", BY), "pairs")
    return ranking.indistinct_groups(pairs, BY)


def two_runs(spark, sf):
    w = datacard_wide(spark, sf)
    side = lambda n: w.filter(F.col("noise_type") == n).drop(*RUNS)
    return results.model_consistency(side("uniform-0.1"), side("asymmetric-0.1"), ("m1", "m2"))


FLAGS = [f"label_issues_{m}_{s}" for s in ("m1", "m2") for m in METHODS]
fragment("two_runs", "SELECT a.id, " + ", ".join(f"a.label_issues_{m} AS label_issues_{m}_m1, b.label_issues_{m} AS label_issues_{m}_m2" for m in METHODS)
         + " FROM (SELECT * FROM cards_wide WHERE noise_type='uniform-0.1') a FULL JOIN (SELECT * FROM cards_wide WHERE noise_type='asymmetric-0.1') b ON a.id=b.id", "cards_wide")


@query("model_consistency", ctes("two_runs") + "SELECT * FROM two_runs")
def _(spark, sf):
    return two_runs(spark, sf)


@query("vote_majority", ctes("two_runs") + f"SELECT id, ({'+'.join(FLAGS)})/8 AS share, (({'+'.join(FLAGS)})*2 > 8)::INT AS label_issue FROM two_runs")
def _(spark, sf):
    return votes.majority_vote(two_runs(spark, sf), FLAGS).select("id", "share", "label_issue")


@query("vote_model")
def _(spark, sf):
    return votes.vote_model(two_runs(spark, sf), FLAGS).select("id", F.round("probability", 6).alias("probability"))


@query("top_suspicious", ctes("two_runs") + f"SELECT id, ({'+'.join(FLAGS)})/8 AS share FROM two_runs ORDER BY share DESC, id LIMIT 25")
def _(spark, sf):
    return votes.top_suspicious(votes.majority_vote(two_runs(spark, sf), FLAGS).select("id", "share"), 25, "share")


@query("param_grid", "SELECT e AS base_epochs, r AS base_lr, a AS detector_alpha FROM (SELECT DISTINCT l_linenumber AS e FROM lineitem), (SELECT DISTINCT l_tax AS r FROM lineitem), (SELECT DISTINCT l_discount AS a FROM lineitem)")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return results.param_grid(spark, {"epochs": li.select("l_linenumber"), "lr": li.select("l_tax")}, {"alpha": li.select("l_discount")})


SETTINGS = [(e, lr) for e in (1, 2) for lr in ("0.1", "0.5")]
HP = [f"epochs-{e};lr-{lr}" for e, lr in SETTINGS]
_hp = lambda s: s.replace("-", "_").replace(";", "_").replace(".", "_")


@query("grid_results", ctes("lab_order") + "SELECT dataset, " + ", ".join(f"max(weighted_f1) FILTER (WHERE setting='{h}') AS {_hp(h)}" for h in HP) + " FROM (" + metrics_sql(
    f"""(SELECT 'd'||(cust%8) AS dataset, s AS setting, label AS t, (CASE WHEN {U("('grid/'||s)", 'id')} < 0.3*e+lr/2 THEN label ELSE (label+1)%{KO} END)::INT AS p FROM lab_order,
 (SELECT unnest({HP}) AS s, unnest({[e for e, _ in SETTINGS]}) AS e, unnest({[float(x) for _, x in SETTINGS]}::DOUBLE[]) AS lr))""", "dataset, setting", ("weighted_f1",)) + ") GROUP BY dataset")
def _(spark, sf):
    o = lab_order(spark, sf).withColumn("g", F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(lr).alias("lr")) for e, lr in SETTINGS]))).select("*", "g.*")
    o = o.withColumn("setting", results.setting_name({"epochs": "e", "lr": "lr"}))
    good = rand.uniform(F.concat(F.lit("grid/"), "setting"), "id") < F.lit(0.3) * F.col("e") + F.col("lr").cast("double") / 2
    scored = o.select(F.concat(F.lit("d"), (F.col("cust") % 8).cast("string")).alias("dataset"), "setting", "label", F.when(good, F.col("label")).otherwise((F.col("label") + 1) % KO).cast("int").alias("pred"))
    return results.grid_results(scored, HP).select("dataset", *[F.col(f"`{h}`").alias(_hp(h)) for h in HP])


@query("cleaning_gain", ctes("down") + """SELECT a.dataset, a.base_model, a.noise_type, a.seed, a.method, a.weighted_f1 AS after, b.weighted_f1 AS before, round(a.weighted_f1-b.weighted_f1,6) AS gain
 FROM down a JOIN down b ON a.dataset=b.dataset AND a.base_model=b.base_model AND a.noise_type=b.noise_type AND a.seed=b.seed WHERE a.method<>'nocleaning' AND b.method='nocleaning'""")
def _(spark, sf):
    return results.cleaning_gain(downstream(spark, sf))
