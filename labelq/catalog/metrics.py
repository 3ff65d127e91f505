"""Classification metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelq.catalog.base import KL, ctes, metrics_sql, preds_line, probs_line, query
from labelq.operators import metrics as m

SRC = "(SELECT label AS t, pred AS p FROM preds_line)"


@query("metrics_all", ctes("preds_line") + metrics_sql(SRC))
def _(spark, sf):
    return m.metrics(preds_line(spark, sf), "label", "pred")


def _pick(key, cols):
    @query(key, ctes("preds_line") + metrics_sql(SRC, cols=cols))
    def _(spark, sf):
        return m.metrics(preds_line(spark, sf), "label", "pred").select("n_rows", *cols)


_pick("f1_weighted", ("weighted_f1",))
_pick("accuracy", ("accuracy",))
_pick("precision_recall_micro", ("precision", "recall"))
_pick("error_rate", ("error_rate", "true_error_rate"))
_pick("prf_weighted", ("weighted_precision", "weighted_recall", "weighted_f1"))


@query("class_scores", ctes("preds_line") + """SELECT c AS class, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS hits, round(2*sum(h)/(sum(s)+sum(p)),6) AS f1 FROM (
 SELECT label AS c, 1 AS s, 0 AS p, (label=pred)::INT AS h FROM preds_line UNION ALL SELECT pred, 0, 1, 0 FROM preds_line) GROUP BY c""")
def _(spark, sf):
    return m.class_scores(preds_line(spark, sf), "label", "pred").select("class", "support", "predicted", "hits", F.round("f1", 6).alias("f1"))


@query("confusion_matrix", ctes("preds_line") + "SELECT label AS from_label, " + ", ".join(
    f"round(avg((pred={j})::INT),6) AS to_{j}" for j in range(KL)) + " FROM preds_line GROUP BY label")
def _(spark, sf):
    cm = m.confusion_matrix(preds_line(spark, sf), "label", "pred", KL)
    wide = cm.groupBy("from_label").pivot("to_label", list(range(KL))).agg(F.first("prob"))
    return wide.select("from_label", *[F.col(str(j)).alias(f"to_{j}") for j in range(KL)])


@query("calibration_error", ctes("probs_line") + """SELECT round(sum(n*abs(a-c))/sum(n),6) AS ece FROM (SELECT count(*) AS n, avg(h) AS a, avg(c) AS c FROM (
 SELECT list_max(probs) AS c, (list_position(probs, list_max(probs))-1=label)::INT AS h FROM probs_line) GROUP BY least(floor(c*3),2))""")
def _(spark, sf):
    return m.calibration_error(probs_line(spark, sf), "label", "probs")


@query("topk_accuracy", ctes("probs_line") + """SELECT k, round(100*avg((r < k)::INT),6) AS accuracy_pct FROM (SELECT id, len(list_filter(probs, lambda p, j: p > probs[label+1] OR (p = probs[label+1] AND j < label+1))) AS r FROM probs_line),
 (SELECT unnest([1,2])::INT AS k) GROUP BY k""")
def _(spark, sf):
    return m.topk_accuracy(probs_line(spark, sf), "label", "probs", [1, 2])
