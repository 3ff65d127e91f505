"""Label noise, feature noise, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelq.catalog.base import (ANN, DIM, KE, KL, KO, H, N, U, annotators, ctes, fragment, lab_embed, lab_line, lab_order,
                                 lab_structured, preds_line, query)
from labelq.functions import rand
from labelq.operators import annotators as ann
from labelq.operators import noise, sampling
from labelq.operators.metrics import confusion_matrix

NOISY = ("id", "label", "noisy_label", "is_injected_noise")


def uniform_sql(src: str, k: int, rate: float, tag: str) -> str:
    return f"""SELECT *, (noisy_label <> label)::INT AS is_injected_noise FROM (SELECT id, label,
 (CASE WHEN {U(tag, 'id')} < {rate} THEN (label+1+floor({U(tag + '/to', 'id')}*{k-1})::INT)%{k} ELSE label END)::INT AS noisy_label FROM {src})"""


def asymmetric_sql(src: str, k: int, rate: float, tag: str) -> str:
    return f"""SELECT *, (noisy_label <> label)::INT AS is_injected_noise FROM (SELECT id, label,
 (CASE WHEN row_number() OVER (ORDER BY {H(tag, 'id')}, id) <= floor(round({rate}*(SELECT count(*) FROM {src}),9)) THEN (label+1)%{k} ELSE label END)::INT AS noisy_label FROM {src})"""


fragment("noisy_line", uniform_sql("lab_line", KL, 0.2, "uniform"), "lab_line")


def noisy_line(spark, sf):
    return noise.uniform(lab_line(spark, sf), KL, 0.2, "uniform").select(*NOISY)


@query("noise_uniform", ctes("noisy_line") + "SELECT * FROM noisy_line")
def _(spark, sf):
    return noisy_line(spark, sf)


@query("noise_asymmetric", ctes("lab_line") + asymmetric_sql("lab_line", KL, 0.1, "asymmetric"))
def _(spark, sf):
    return noise.asymmetric(lab_line(spark, sf), KL, 0.1).select(*NOISY)


# A transition table of the orders' classes derived from the data: stay 0.7, the rest by class share.
fragment("plan_matrix", f"""SELECT a.l AS from_label, b.l AS to_label, CASE WHEN a.l=b.l THEN 0.7::DOUBLE ELSE 0.3::DOUBLE*b.n/(t.n-a.n) END AS prob
 FROM (SELECT label AS l, count(*) AS n FROM lab_order GROUP BY 1) a, (SELECT label AS l, count(*) AS n FROM lab_order GROUP BY 1) b, (SELECT count(*) AS n FROM lab_order) t""", "lab_order")
MATRIX_DRAW = """SELECT id, label, noisy_label, (noisy_label<>label)::INT AS is_injected_noise FROM (
 SELECT s.id, s.label, coalesce(min(m.to_label) FILTER (WHERE s.u < m.hi), max(m.to_label))::INT AS noisy_label
 FROM (SELECT id, label, {u} AS u FROM {src}) s JOIN (SELECT *, sum(prob) OVER (PARTITION BY from_label ORDER BY to_label) AS hi FROM {m}) m ON m.from_label = s.label
 GROUP BY s.id, s.label)"""


def plan_matrix(spark, sf):
    counts = sampling.class_counts(lab_order(spark, sf), "label").agg(F.collect_list(F.struct("label", "n")).alias("c"), F.sum("n").alias("total"))
    pairs = counts.select("total", "c", F.explode("c").alias("a")).select("total", "a", F.explode("c").alias("b"))
    other = F.lit(0.3) * F.col("b.n") / (F.col("total") - F.col("a.n"))
    return pairs.select(F.col("a.label").alias("from_label"), F.col("b.label").alias("to_label"),
                        F.when(F.col("a.label") == F.col("b.label"), F.lit(0.7)).otherwise(other).alias("prob"))


@query("noise_by_matrix", ctes("plan_matrix") + MATRIX_DRAW.format(u=U("matrix", "id"), src="lab_order", m="plan_matrix"))
def _(spark, sf):
    return noise.by_matrix(lab_order(spark, sf), plan_matrix(spark, sf)).select(*NOISY)


@query("flip_by_row_stochastic", ctes("plan_matrix") + f"""SELECT i AS label, j AS noisy_label, coalesce(n,0)::BIGINT AS n, round(coalesce(n,0)/sum(coalesce(n,0)) OVER (PARTITION BY i),6) AS prob,
 round((sum(coalesce(n,0)) OVER (PARTITION BY i))/(sum(coalesce(n,0)) OVER ()),6) AS share
 FROM (SELECT a.i, b.i AS j FROM (SELECT unnest(range({KO}))::INT AS i) a, (SELECT unnest(range({KO}))::INT AS i) b) g
 LEFT JOIN (SELECT label AS l, noisy_label AS m, count(*) AS n FROM ({MATRIX_DRAW.format(u=U('flip', 'id'), src='lab_order', m='plan_matrix')}) GROUP BY 1,2) c ON c.l=g.i AND c.m=g.j""")
def _(spark, sf):
    flipped = noise.flip_by_matrix(lab_order(spark, sf), plan_matrix(spark, sf))
    return noise.transition(flipped, "label", "noisy_label", KO)


fragment("cm_line", f"""SELECT i AS from_label, j AS to_label, round(coalesce(n,0)/sum(coalesce(n,0)) OVER (PARTITION BY i),6) AS prob
 FROM (SELECT a.i, b.i AS j FROM (SELECT unnest(range({KL}))::INT AS i) a, (SELECT unnest(range({KL}))::INT AS i) b) g
 LEFT JOIN (SELECT label, pred, count(*) AS n FROM preds_line GROUP BY 1,2) c ON c.label=g.i AND c.pred=g.j""", "preds_line")
fragment("cd_line", "SELECT from_label, to_label, (prob+1e-7::DOUBLE)/sum(prob+1e-7::DOUBLE) OVER (PARTITION BY from_label) AS prob FROM cm_line", "cm_line")


@query("noise_class_dependent", ctes("cd_line") + MATRIX_DRAW.format(u=U("classdependent", "id"), src="lab_line", m="cd_line"))
def _(spark, sf):
    return noise.class_dependent(lab_line(spark, sf), preds_line(spark, sf), KL).select(*NOISY)


@query("noise_class_dependent_column", ctes("cm_line") + "SELECT to_label AS from_label, from_label AS to_label, round((prob+1e-7::DOUBLE)/sum(prob+1e-7::DOUBLE) OVER (PARTITION BY to_label),6) AS prob FROM cm_line")
def _(spark, sf):
    m = noise.class_dependent_matrix(preds_line(spark, sf), KL, axis="column")
    return m.withColumn("prob", F.round("prob", 6))




def _quantile_sql(p: str) -> str:
    q, r = f"({p}-0.5::DOUBLE)", f"(({p}-0.5::DOUBLE)*({p}-0.5::DOUBLE))"

    def horner(cs):
        acc = f"({cs[0]!r}::DOUBLE)"
        for c in cs[1:]:
            acc = f"({acc}*{r}+({c!r}::DOUBLE))"
        return acc
    return f"({horner(rand.ICDF_A)}*{q}/({horner(rand.ICDF_B)}*{r}+1.0::DOUBLE))"


fragment("inst_w", f"""SELECT k, list({N('instance/w', 'k', 's')} ORDER BY s) AS w
 FROM (SELECT unnest(range({KE})) AS k), (SELECT unnest(range({DIM})) AS s) GROUP BY k""")
fragment("inst_score", f"""SELECT e.id, e.label, w.k, list_sum(list_transform(e.features, lambda x, i: x*w.w[i])) AS s,
 0.2::DOUBLE+0.1::DOUBLE*{_quantile_sql(f"(0.5::DOUBLE+{U('instance/q', 'e.id')}*0.3413447460685429::DOUBLE)")} AS q FROM lab_structured e, inst_w w""", "inst_w", "lab_structured")
fragment("inst_probs", """SELECT id, label, k, q, CASE WHEN k=label THEN 1-q ELSE q*x/sum(CASE WHEN k=label THEN 0 ELSE x END) OVER (PARTITION BY id) END AS p FROM (
 SELECT *, exp(s - max(CASE WHEN k<>label THEN s END) OVER (PARTITION BY id)) AS x FROM inst_score)""", "inst_score")


@query("noise_instance_dependent", ctes("inst_probs") + f"""SELECT id, label, noisy_label, (noisy_label<>label)::INT AS is_injected_noise, q FROM (
 SELECT id, label, round(any_value(q),6) AS q, coalesce(min(k) FILTER (WHERE {U('instance/draw', 'id')} < hi), {KE-1})::INT AS noisy_label
 FROM (SELECT *, sum(p) OVER (PARTITION BY id ORDER BY k) AS hi FROM inst_probs) GROUP BY id, label)""")
def _(spark, sf):
    d = noise.instance_dependent(lab_structured(spark, sf), DIM, KE, 0.2)
    return d.select(*NOISY, F.round("q", 6).alias("q"))


@query("noise_dissenting_label", ctes("annotators") + f"""SELECT id, label, noisy_label, (noisy_label<>label)::INT AS is_injected_noise FROM (
 SELECT a.id, a.label, coalesce(m.t, a.label)::INT AS noisy_label FROM annotators a LEFT JOIN (
  SELECT id, t FROM (SELECT id, list_filter(v, lambda x: x<>label)[1+floor({U('dissenting_label/pick', 'id')}*len(list_filter(v, lambda x: x<>label)))::INT] AS t,
   row_number() OVER (ORDER BY {H('dissenting_label', 'id')}, id) AS rn
   FROM (SELECT id, label, list_sort(list_distinct([a1,a2,a3])) AS v FROM annotators) WHERE len(v)>1)
  WHERE rn <= ceil(round(0.1*(SELECT count(*) FROM annotators),9))) m ON m.id=a.id)""")
def _(spark, sf):
    return ann.dissenting_label(annotators(spark, sf), ANN, 0.1).select(*NOISY)


@query("noise_dissenting_worker", ctes("annotators") + f"""SELECT id, label, noisy_label, (noisy_label<>label)::INT AS is_injected_noise FROM (
 SELECT a.id, a.label, coalesce(m.t, a.label)::INT AS noisy_label FROM annotators a LEFT JOIN (
  SELECT id, t FROM (SELECT *, row_number() OVER (ORDER BY place, h, id) AS rn FROM (
   SELECT id, arg_min(l, place) AS t, min(place) AS place, arg_min(h, place) AS h FROM (
    SELECT s.id, s.l, p.place, ('0x'||substr(md5('dissenting_worker:'||s.w||':'||s.id),1,8))::BIGINT AS h FROM (
     SELECT id, label, 1 AS w, a1 AS l FROM annotators UNION ALL SELECT id, label, 2, a2 FROM annotators UNION ALL SELECT id, label, 3, a3 FROM annotators) s
    JOIN (SELECT w, row_number() OVER (ORDER BY {H('dissenting_worker/worker', 'w')}, w) AS place FROM (SELECT unnest([1,2,3]) AS w)) p ON p.w=s.w
    WHERE s.l <> s.label) GROUP BY id))
  WHERE rn <= ceil(round(0.2*(SELECT count(*) FROM annotators),9))) m ON m.id=a.id)""")
def _(spark, sf):
    return ann.dissenting_worker(annotators(spark, sf), ANN, 0.2).select(*NOISY)


MAJORITY = """SELECT id, label, l AS m FROM (SELECT id, label, l, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, l) AS rn FROM (
 SELECT id, label, a1 AS l FROM annotators UNION ALL SELECT id, label, a2 FROM annotators UNION ALL SELECT id, label, a3 FROM annotators) GROUP BY id, label, l) WHERE rn=1"""


@query("noise_crowd_majority", ctes("annotators") + f"SELECT id, label, m AS noisy_label, (m<>label)::INT AS is_injected_noise FROM ({MAJORITY})")
def _(spark, sf):
    return ann.crowd_majority(annotators(spark, sf), ANN).select(*NOISY)


@query("scan_annotations", ctes("annotators") + f"""SELECT s.id, s.label, s.annotator, s.annotator_label, m.m AS aggregate_label FROM (
 SELECT id, label, 1 AS annotator, a1 AS annotator_label FROM annotators UNION ALL SELECT id, label, 2, a2 FROM annotators UNION ALL SELECT id, label, 3, a3 FROM annotators) s JOIN ({MAJORITY}) m ON m.id=s.id""")
def _(spark, sf):
    wide = ann.majority(annotators(spark, sf), ANN, "aggregate_label")
    items = F.explode(F.array(*[F.struct(F.lit(i).alias("annotator"), F.col(c).alias("annotator_label")) for i, c in enumerate(ANN, 1)]))
    return wide.select("id", "label", "aggregate_label", items.alias("a")).select("id", "label", "a.*", "aggregate_label")


@query("human_issue_flags", ctes("annotators") + f"SELECT id, (m<>label)::INT AS label_issue, sum((m<>label)::INT) OVER ()::BIGINT AS total_issues FROM ({MAJORITY})")
def _(spark, sf):
    flags = ann.majority(annotators(spark, sf), ANN, "corrected_label").select("id", (F.col("corrected_label") != F.col("label")).cast("int").alias("label_issue"))
    return flags.withColumn("total_issues", flags.agg(F.sum("label_issue").alias("n")).scalar())


@query("feature_noise_gaussian", ctes("lab_embed") + f"""SELECT id, i-1 AS pos, round(features[i] + 0.01::DOUBLE*{N('gauss', 'id', 'i-1')},6) AS value
 FROM (SELECT id, features, unnest(range(1,{DIM+1})) AS i FROM lab_embed)""")
def _(spark, sf):
    d = noise.gaussian_features(lab_embed(spark, sf))
    return d.select("id", F.posexplode("noisy_features").alias("pos", "v")).select("id", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("value"))


@query("noise_flag", ctes("noisy_line") + "SELECT id, is_injected_noise FROM noisy_line")
def _(spark, sf):
    d = noisy_line(spark, sf).drop("is_injected_noise")
    return noise.with_flag(d).select("id", "is_injected_noise")


@query("estimate_noise_rate", ctes("noisy_line") + "SELECT round(avg((label<>noisy_label)::INT),6) AS noise_rate FROM noisy_line")
def _(spark, sf):
    return noise.noise_rate(noisy_line(spark, sf))


def transition_sql(src: str, g: str, s: str, k: int, digits: int = 6) -> str:
    return f"""SELECT i AS {g}, j AS {s}, coalesce(n,0)::BIGINT AS n, round(coalesce(n,0)/sum(coalesce(n,0)) OVER (PARTITION BY i),{digits}) AS prob,
 round((sum(coalesce(n,0)) OVER (PARTITION BY i))/(sum(coalesce(n,0)) OVER ()),{digits}) AS share
 FROM (SELECT a.i, b.i AS j FROM (SELECT unnest(range({k}))::INT AS i) a, (SELECT unnest(range({k}))::INT AS i) b) q
 LEFT JOIN (SELECT {g} AS g, {s} AS s, count(*) AS n FROM {src} GROUP BY 1,2) c ON c.g=q.i AND c.s=q.j"""


@query("estimate_transition", ctes("noisy_line") + transition_sql("noisy_line", "noisy_label", "label", KL))
def _(spark, sf):
    return noise.transition(noisy_line(spark, sf), "noisy_label", "label", KL)


@query("transition_given_true", ctes("noisy_line") + transition_sql("noisy_line", "label", "noisy_label", KL))
def _(spark, sf):
    return noise.transition(noisy_line(spark, sf), "label", "noisy_label", KL)


@query("transition_three_digits", ctes("noisy_line") + transition_sql("noisy_line", "label", "noisy_label", KL, 3))
def _(spark, sf):
    return noise.transition(noisy_line(spark, sf), "label", "noisy_label", KL, 3)


RATES = [0.1, 0.4]


def _sweep_sql() -> str:
    parts = []
    for r in RATES:
        parts.append(f"SELECT 'uniform-{r}' AS noise_type, * FROM ({uniform_sql('lab_line', KL, r, f'uniform-{r}')})")
        parts.append(f"SELECT 'asymmetric-{r}' AS noise_type, * FROM ({asymmetric_sql('lab_line', KL, r, f'asymmetric-{r}')})")
    parts.append(f"SELECT 'classdependent' AS noise_type, * FROM ({MATRIX_DRAW.format(u=U('classdependent', 'id'), src='lab_line', m='cd_line')})")
    return f"SELECT noise_type, label, noisy_label, count(*) AS n, sum(is_injected_noise)::BIGINT AS injected FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


@query("noise_sweep", ctes("cd_line") + _sweep_sql())
def _(spark, sf):
    s = noise.sweep(lab_line(spark, sf), preds_line(spark, sf), KL, RATES)
    return s.groupBy("noise_type", "label", "noisy_label").agg(F.count("*").alias("n"), F.sum("is_injected_noise").alias("injected"))


# ---- splits and samples ----

@query("stratified_split", ctes("lab_line") + f"""SELECT id, label, (row_number() OVER (PARTITION BY label ORDER BY {H('split', 'id')}, id)
 <= round(count(*) OVER (PARTITION BY label) * 0.15::DOUBLE))::INT AS is_test FROM lab_line""")
def _(spark, sf):
    return sampling.stratified_split(lab_line(spark, sf), "label", 0.15).select("id", "label", "is_test")


@query("random_split", ctes("lab_line") + f"SELECT id, (row_number() OVER (ORDER BY {H('validation', 'id')}, id) <= floor(round(0.25*(SELECT count(*) FROM lab_line),9)))::INT AS is_validation FROM lab_line")
def _(spark, sf):
    return sampling.random_split(lab_line(spark, sf)).select("id", "is_validation")


@query("half_split", ctes("lab_line") + f"SELECT id, CASE WHEN row_number() OVER (ORDER BY {H('half', 'id')}, id) <= floor((SELECT count(*) FROM lab_line)/2) THEN 'A' ELSE 'B' END AS half FROM lab_line")
def _(spark, sf):
    return sampling.half_split(lab_line(spark, sf)).select("id", "half")


@query("kfold_assign", ctes("lab_line") + f"SELECT id, label, ((row_number() OVER (PARTITION BY label ORDER BY {H('fold', 'id')}, id) - 1) % 5)::INT AS fold FROM lab_line")
def _(spark, sf):
    return sampling.kfold(lab_line(spark, sf), "label", 5).select("id", "label", "fold")


@query("downsample_class", ctes("lab_line") + f"SELECT id, label FROM lab_line WHERE label<>1 OR {U('down', 'id')} < 0.15")
def _(spark, sf):
    return sampling.downsample_class(lab_line(spark, sf), "label", 1).select("id", "label")


@query("class_weights", ctes("lab_line") + "SELECT label, round(1-count(*)/(SELECT count(*) FROM lab_line),6) AS weight FROM lab_line GROUP BY label")
def _(spark, sf):
    return sampling.class_weights(lab_line(spark, sf), "label").withColumn("weight", F.round("weight", 6))


@query("class_prior", ctes("lab_line") + "SELECT label, count(*) AS n, round(count(*)/(SELECT count(*) FROM lab_line),6) AS share FROM lab_line GROUP BY label")
def _(spark, sf):
    return sampling.class_counts(lab_line(spark, sf, spread=False), "label").withColumn("share", F.round("share", 6))


@query("cap_per_class", ctes("lab_line") + f"SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {H('cap', 'id')}, id) AS rn FROM lab_line) WHERE rn <= 1000")
def _(spark, sf):
    return sampling.cap_per_class(lab_line(spark, sf), "label", 1000).select("id", "label")


@query("sample_without_replacement", ctes("lab_line") + f"""SELECT round, id, label FROM (SELECT id, label, r AS round, row_number() OVER (PARTITION BY r ORDER BY {H('round', 'r', 'id')}, id) AS rn
 FROM lab_line, (SELECT unnest(range(4))::INT AS r)) WHERE rn <= 3000""")
def _(spark, sf):
    return sampling.sample_rounds(lab_line(spark, sf), 3000, 4).select("round", "id", "label")
