"""Nearest-neighbour queries on structured vectors with uniform label noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelq.catalog.base import DIM, H, KE, ctes, fragment, lab_structured, metrics_sql, noisy_structured, query
from labelq.functions import arrays, rand
from labelq.operators import consensus, neighbours, noise
from labelq.operators.metrics import metrics
from labelq.operators.sampling import class_counts
from labelq.session import materialised

K = 10  # the row itself and nine others
SIM = 0.0

fragment("nn", f"""SELECT id, label, rank, nbr_id, nbr_label, dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nbr_id) AS rank FROM (
 SELECT a.id, a.label, b.id AS nbr_id, b.label AS nbr_label, round(1-list_dot_product(a.features,b.features),9) AS dist FROM noisy_structured a JOIN noisy_structured b ON a.id<>b.id)) WHERE rank <= {K-1}""", "noisy_structured")


def nn(spark, sf, metric="cosine"):
    d = noisy_structured(spark, sf)
    return neighbours.knn(d, d, K - 1, metric)


@query("knn_cosine", ctes("nn") + "SELECT id, label, rank::INT AS rank, nbr_id, nbr_label, round(dist,6) AS dist FROM nn")
def _(spark, sf):
    return nn(spark, sf).withColumn("dist", F.round("dist", 6))


fragment("nn_weights", f"""SELECT id, label, c, sum(w) AS w, sum(n0) AS n0 FROM (
 SELECT id, label, nbr_label AS c, {1-SIM}::DOUBLE - dist AS w, {1-SIM}::DOUBLE - dist AS n0 FROM nn UNION ALL
 SELECT id, label, label, {1-SIM}::DOUBLE - (2*max(dist) FILTER (WHERE rank=1) - max(dist) FILTER (WHERE rank=2)), {1-SIM}::DOUBLE FROM nn GROUP BY id, label UNION ALL
 SELECT id, label, c, 0::DOUBLE, 0::DOUBLE FROM noisy_structured, (SELECT unnest(range({KE}))::INT AS c)) GROUP BY id, label, c""", "nn")
fragment("nn_dist", "SELECT id, label, c, w / greatest(sqrt(sum(w*w) OVER (PARTITION BY id)), 1e-12::DOUBLE) AS p FROM nn_weights", "nn_weights")


def dist(spark, sf):
    return consensus.label_distribution(nn(spark, sf), KE, SIM)


@query("knn_label_distribution", ctes("nn_dist") + "SELECT id, c AS class, round(p,6) AS p FROM nn_dist")
def _(spark, sf):
    return dist(spark, sf).select("id", F.posexplode("distribution").alias("class", "p")).withColumn("p", F.round("p", 6))


@query("knn_label_distribution_l1", ctes("nn_weights") + "SELECT id, c AS class, round(w/sum(w) OVER (PARTITION BY id),6) AS p FROM nn_weights")
def _(spark, sf):
    d = consensus.label_distribution(nn(spark, sf), KE, SIM, "l1")
    return d.select("id", F.posexplode("distribution").alias("class", "p")).withColumn("p", F.round("p", 6))


@query("knn_confidence", ctes("nn_weights") + "SELECT id, round(sum(n0),6) AS confidence FROM nn_weights GROUP BY id")
def _(spark, sf):
    return dist(spark, sf).select("id", F.round("confidence", 6).alias("confidence"))


fragment("prior_noisy", "SELECT label AS l, count(*)/(SELECT count(*) FROM noisy_structured) AS share FROM noisy_structured GROUP BY 1", "noisy_structured")
fragment("nn_loss", "SELECT d.id, d.label, c, -ln(p+1e-8::DOUBLE) AS l, share FROM nn_dist d LEFT JOIN prior_noisy q ON q.l=d.c", "nn_dist", "prior_noisy")
fragment("nn_scores", """SELECT id, label, max(CASE WHEN c=label THEN l END) AS ce, max(CASE WHEN c=label THEN l END)-avg(l) AS cores, -avg(l) AS avg, 1.1::DOUBLE*max(CASE WHEN c=label THEN l END)-avg(l) AS new,
 max(CASE WHEN c=label THEN l END)-sum(l*coalesce(share,0)) AS peer FROM nn_loss GROUP BY id, label""", "nn_loss")


@query("knn_scores", ctes("nn_scores") + "SELECT id, round(ce,5) AS ce, round(cores,5) AS cores, round(avg,5) AS avg, round(new,5) AS new, round(peer,5) AS peer FROM nn_scores")
def _(spark, sf):
    s = consensus.scores(dist(spark, sf), class_counts(noisy_structured(spark, sf), "label"))
    return s.select("id", *[F.round(c, 5).alias(c) for c in ("ce", "cores", "avg", "new", "peer")])


fragment("nn_vote", "SELECT id, (arg_max(c, (round(p,9), -c)) <> any_value(label))::INT AS label_issue FROM nn_dist GROUP BY id", "nn_dist")


@query("knn_majority_vote", ctes("nn_vote") + "SELECT * FROM nn_vote")
def _(spark, sf):
    return consensus.majority_flags(dist(spark, sf))


fragment("keep_frac", """SELECT label, 1-CASE WHEN 1-least(2.5*k,1) >= 1 THEN 0.95::DOUBLE WHEN 1-least(2.5*k,1) <= 0 THEN 0.05::DOUBLE ELSE 1-least(2.5*k,1) END AS f FROM (
 SELECT label, round(avg((label=true_label)::INT),6) AS k FROM noisy_structured GROUP BY label)""", "noisy_structured")
fragment("nn_cut", """SELECT label, a + (coalesce(b,a)-a)*(pos-floor(pos)) AS cut FROM (SELECT label, any_value(pos) AS pos, max(ce) FILTER (WHERE r=floor(pos)) AS a, max(ce) FILTER (WHERE r=floor(pos)+1) AS b FROM (
 SELECT s.label, ce, f.f*(count(*) OVER (PARTITION BY s.label)-1) AS pos, row_number() OVER (PARTITION BY s.label ORDER BY ce)-1 AS r FROM nn_scores s JOIN keep_frac f ON f.label=s.label) GROUP BY label)""", "nn_scores", "keep_frac")
fragment("nn_rank", "SELECT s.id, (s.ce >= c.cut)::INT AS label_issue FROM nn_scores s JOIN nn_cut c ON c.label=s.label", "nn_cut")


def rank_flags(spark, sf, d):
    t = noise.transition(noisy_structured(spark, sf), "label", "true_label", KE)
    keep = t.filter("label = true_label").select("label", F.col("prob").alias("keep"))
    return consensus.rank_flags(consensus.scores(d), keep)


@query("knn_rank", ctes("nn_rank") + "SELECT * FROM nn_rank")
def _(spark, sf):
    return rank_flags(spark, sf, materialised(dist(spark, sf), "distribution"))


@query("knn_both", ctes("nn_rank", "nn_vote") + "SELECT v.id, v.label_issue*r.label_issue AS label_issue FROM nn_vote v JOIN nn_rank r ON r.id=v.id")
def _(spark, sf):
    d = materialised(dist(spark, sf), "distribution")
    return consensus.both_flags(consensus.majority_flags(d), rank_flags(spark, sf, d))


fragment("vote_eval", "SELECT s.true_label AS label, s.is_injected_noise AS t, v.label_issue AS p FROM noisy_structured s JOIN nn_vote v ON v.id=s.id", "noisy_structured", "nn_vote")
QUALITY = ("weighted_f1", "accuracy", "weighted_precision", "weighted_recall")


@query("neighbour_vote_quality", ctes("vote_eval") + "SELECT * FROM (" + metrics_sql("vote_eval", "label", QUALITY) + ") UNION ALL SELECT * FROM (" + metrics_sql("(SELECT -1 AS label, t, p FROM vote_eval)", "label", QUALITY) + ")")
def _(spark, sf):
    """How well the neighbour vote finds 20 % uniform noise: one row per class, and the total as class -1."""
    flags = consensus.majority_flags(dist(spark, sf))
    joined = noisy_structured(spark, sf).select("id", F.col("true_label").alias("label"), "is_injected_noise").join(flags, "id")
    both = joined.withColumn("label", F.explode(F.array("label", F.lit(-1))))
    return metrics(both, "is_injected_noise", "label_issue", ["label"]).select("label", "n_rows", *QUALITY)


@query("neighbour_detect")
def _(spark, sf):
    """The whole method with an estimated transition; no true label is used."""
    d = noisy_structured(spark, sf)
    return consensus.detect(d, nn(spark, sf), KE, min_similarity=SIM)


# ---- consensus ----

ROUNDS = 10
fragment("triples", f"""SELECT l1, l2, l3, count(*)/(any_value(m)*{ROUNDS}) AS share FROM (SELECT r, id, any_value(label) AS l1, max(nl) FILTER (WHERE rk=1) AS l2, max(nl) FILTER (WHERE rk=2) AS l3, any_value(m) AS m FROM (
 SELECT a.r, a.id, a.label, b.label AS nl, a.m, row_number() OVER (PARTITION BY a.r, a.id ORDER BY round(1-list_dot_product(a.features,b.features),9), b.id) AS rk FROM picked a JOIN picked b ON a.r=b.r AND a.id<>b.id) WHERE rk<=2 GROUP BY r, id) GROUP BY l1, l2, l3""", "noisy_structured")
fragment("picked", f"""SELECT *, count(*) OVER (PARTITION BY r) AS m FROM (SELECT s.*, r, row_number() OVER (PARTITION BY r ORDER BY {H('consensus', 'r', 's.id')}, s.id) AS rn FROM noisy_structured s, (SELECT unnest(range({ROUNDS}))::INT AS r))
 WHERE rn <= floor((SELECT count(*) FROM noisy_structured)/4)""", "noisy_structured")
from labelq.catalog.base import SQL  # noqa: E402

SQL["triples"] = (SQL["triples"][0], ("picked",))


def triples(spark, sf):
    return consensus.consensus_counts(noisy_structured(spark, sf), F.floor(F.col("group_rows") / 4), ROUNDS)


@query("consensus_counts", ctes("triples") + """SELECT 3 AS level, l1, l2, l3, round(share,6) AS share FROM triples UNION ALL SELECT 2, l1, l2, NULL, round(sum(share),6) FROM triples GROUP BY l1, l2
 UNION ALL SELECT 1, l1, NULL, NULL, round(sum(share),6) FROM triples GROUP BY l1""")
def _(spark, sf):
    return consensus.consensus_levels(triples(spark, sf)).withColumn("share", F.round("share", 6))


@query("estimate_transition_hoc")
def _(spark, sf):
    t, p = consensus.estimate_transition(triples(spark, sf), KE)
    return t.join(F.broadcast(p), "label").select("label", "noisy_label", F.round("prob", 6).alias("prob"), F.round("share", 6).alias("share"))


fragment("t_true", "SELECT true_label AS i, label AS j, count(*)/(sum(count(*)) OVER (PARTITION BY true_label)) AS q FROM noisy_structured GROUP BY 1,2", "noisy_structured")
fragment("p_true", "SELECT true_label AS i, count(*)/(SELECT count(*) FROM noisy_structured) AS p FROM noisy_structured GROUP BY 1", "noisy_structured")


def true_transition(spark, sf):
    d = noisy_structured(spark, sf)
    t = noise.transition(d, "true_label", "label", KE, 15).select(F.col("true_label").alias("label"), F.col("label").alias("noisy_label"), "prob")
    return t, class_counts(d.select(F.col("true_label").alias("label")), "label")


@query("predicted_consensus", ctes("t_true", "p_true") + """SELECT a.j AS l1, b.j AS l2, c.j AS l3, round(sum(p*a.q*b.q*c.q),6) AS share FROM p_true JOIN t_true a ON a.i=p_true.i JOIN t_true b ON b.i=p_true.i JOIN t_true c ON c.i=p_true.i GROUP BY 1,2,3 HAVING sum(p*a.q*b.q*c.q) > 0""")
def _(spark, sf):
    t, p = true_transition(spark, sf)
    return consensus.predicted_consensus(t.filter("prob > 0"), p).withColumn("share", F.round("share", 6))


@query("posterior_true_given_noisy", ctes("t_true", "p_true", "prior_noisy") + "SELECT t.i AS label, t.j AS noisy_label, round(q*p/share,6) AS prob FROM t_true t JOIN p_true ON p_true.i=t.i JOIN prior_noisy n ON n.l=t.j")
def _(spark, sf):
    t, p = true_transition(spark, sf)
    out = consensus.posterior_true_given_noisy(t, p, class_counts(noisy_structured(spark, sf), "label"))
    return out.filter("prob > 0").withColumn("prob", F.round("prob", 6))


# ---- distances ----

EUCLID = "sqrt(list_sum(list_transform(list_zip(a.features, b.features), lambda z: (z[1]-z[2])*(z[1]-z[2]))))"


@query("local_neighbourhood", ctes("lab_structured") + f"SELECT id, label, round(dist,6) AS dist FROM (SELECT a.id, a.label, round({EUCLID},9) AS dist FROM lab_structured a, (SELECT features FROM lab_structured WHERE id=0) b) ORDER BY dist, id LIMIT 250")
def _(spark, sf):
    d = lab_structured(spark, sf)
    return neighbours.local_neighbourhood(d, d.filter("id = 0"), 250).select("id", "label", F.round("dist", 6).alias("dist"))


fragment("centroids", f"SELECT label AS point, list(v ORDER BY i) AS features FROM (SELECT label, i, avg(features[i]) AS v FROM (SELECT label, features, unnest(range(1,{DIM+1})) AS i FROM lab_structured) GROUP BY label, i) GROUP BY label", "lab_structured")


def centroids(spark, sf):
    per = lab_structured(spark, sf).select("label", F.posexplode("features").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return per.groupBy(F.col("label").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("features"))


@query("pairwise_distance", ctes("centroids") + f"""SELECT a.id, b.point, round(1-list_dot_product(a.features,b.features)/(sqrt(list_dot_product(a.features,a.features))*sqrt(list_dot_product(b.features,b.features))),6) AS cosine,
 round({EUCLID},6) AS euclidean, round({EUCLID}*{EUCLID},6) AS squared FROM lab_structured a, centroids b""")
def _(spark, sf):
    d = lab_structured(spark, sf)
    centres = materialised(centroids(spark, sf), "centres")
    out = None
    for name, metric in (("cosine", "cosine"), ("euclidean", "euclidean"), ("squared", "sqeuclidean")):
        one = neighbours.pairwise_distance(d, centres, metric).withColumn(name, F.round("dist", 6)).drop("dist")
        out = one if out is None else out.join(one, ["id", "point"])
    return out


fragment("centres", f"SELECT id AS cell, features FROM lab_structured ORDER BY {H('centre', 'id')}, id LIMIT 8", "lab_structured")
fragment("placed", f"SELECT id, tl, nl, cell FROM (SELECT a.id, a.true_label AS tl, a.label AS nl, b.cell, row_number() OVER (PARTITION BY a.id ORDER BY round({EUCLID},9), b.cell) AS rn FROM noisy_structured a, centres b) WHERE rn=1", "noisy_structured", "centres")


@query("local_transition", ctes("placed") + f""", cnt AS (SELECT c.cell, i, j, count(p.id) AS n FROM (SELECT DISTINCT cell FROM placed) c, (SELECT unnest(range({KE}))::INT AS i), (SELECT unnest(range({KE}))::INT AS j)
 LEFT JOIN placed p ON p.cell=c.cell AND p.tl=i AND p.nl=j GROUP BY 1,2,3)
 SELECT cell, i AS label, j AS noisy_label, round(sh*CASE WHEN r>0 THEN n/r ELSE 0 END + (1-sh)*g,6) AS prob FROM (SELECT *, r/sum(n) OVER (PARTITION BY cell) AS sh FROM (
  SELECT *, sum(n) OVER (PARTITION BY cell, i) AS r, sum(n) OVER (PARTITION BY i, j)/sum(n) OVER (PARTITION BY i) AS g FROM cnt))""")
def _(spark, sf):
    d = noisy_structured(spark, sf).select("id", "features", F.col("true_label").alias("label"), F.col("label").alias("noisy_label"))
    centres = lab_structured(spark, sf).orderBy(rand.hash32("centre", "id"), "id").limit(8).select(F.col("id").alias("cell"), "features")
    return consensus.cell_transitions(d, centres, KE).withColumn("prob", F.round("prob", 6))


@query("local_transition_consensus")
def _(spark, sf):
    d = noisy_structured(spark, sf).select("id", "features", "label")
    out = consensus.local_transitions(d, KE, 250)
    return out.select("cell", "label", "noisy_label", "n", *[F.round(c, 4).alias(c) for c in ("share", "local", "prob")])
