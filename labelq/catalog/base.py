"""Registry and shared inputs. Every input exists twice: as a DataFrame and as a SQL fragment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelq.functions import arrays, rand

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KE = 10  # classes of the embedding table
KL = 3  # classes of lineitem (return flag)
KO = 5  # classes of orders (priority)
DIM = 64  # length of the embedding vectors

#: Tasks over which the narrow inputs of the queries are dealt by id. The given files are one row group each, which no
#: scan can split; several hashes a row would be made in one task.
SPREAD = 32


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, scanned in place; how many tasks a scan has is set by the session."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- SQL text helpers ----

def H(tag: str, *ids: str) -> str:
    """Keyed 32-bit hash; a tag starting with a quote or parenthesis is an expression."""
    head = tag if tag[0] in "'(" else f"'{tag}'"
    text = "||':'||".join([head, *[f"({i})" for i in ids]])
    return f"(('0x'||substr(md5({text}),1,8))::BIGINT)"


def U(tag: str, *ids: str) -> str:
    return f"({H(tag, *ids)}/4294967296.0::DOUBLE)"


def _join(tag: str, suffix: str) -> str:
    return f"({tag}||'{suffix}')" if tag[0] in "'(" else tag + suffix


def N(tag: str, *ids: str) -> str:
    u1 = f"(({H(_join(tag, '/1'), *ids)}+1.0::DOUBLE)/4294967296.0::DOUBLE)"
    return f"(sqrt(-2.0::DOUBLE*ln({u1}))*cos(6.283185307179586::DOUBLE*{U(_join(tag, '/2'), *ids)}))"


SQL: dict[str, tuple[str, tuple[str, ...]]] = {}


def fragment(name: str, text: str, *needs: str) -> None:
    SQL[name] = (text, needs)


def ctes(*names: str) -> str:
    """WITH clause holding the named fragments and all they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        for need in SQL[n][1]:
            visit(need)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n][0]})" for n in order) + "\n"


# ---- labelled tables ----

def lab_embed(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


fragment("lab_embed", "SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS features, label FROM embeddings")

OFFSET = 0.6


def lab_structured(spark, sf) -> DataFrame:
    """Embeddings shifted along their label's axis, so that vectors carry the label."""
    shifted = F.transform("features", lambda x, i: x + F.when(i == F.col("label"), F.lit(OFFSET)).otherwise(F.lit(0.0)))
    return lab_embed(spark, sf).withColumn("features", arrays.unit(shifted))


fragment("structured_raw", f"SELECT id, label, list_transform(features, lambda x, i: x + CASE WHEN i = label + 1 THEN {OFFSET}::DOUBLE ELSE 0::DOUBLE END) AS v FROM lab_embed", "lab_embed")
fragment("lab_structured", "SELECT id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y*y)))) AS features FROM structured_raw", "structured_raw")


def lab_line(spark, sf, spread: bool = True) -> DataFrame:
    """Not ``spread``: for queries that hash nothing, and so need neither the id nor a shuffle."""
    li = table(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    lab = li.select(key.alias("id"), F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"), code.cast("int").alias("label"))
    return lab.repartition(SPREAD, "id") if spread else lab


fragment("lab_line", """SELECT l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey AS id,
 [l_quantity, l_extendedprice, l_discount, l_tax] AS features,
 CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM lineitem""")


def lab_order(spark, sf, spread: bool = True) -> DataFrame:
    o = table(spark, sf, "orders")
    lab = o.select(F.col("o_orderkey").alias("id"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("label"),
                   F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"))
    return lab.repartition(SPREAD, "id") if spread else lab


fragment("lab_order", "SELECT o_orderkey AS id, substr(o_orderpriority,1,1)::INT - 1 AS label, o_custkey AS cust, o_totalprice AS price FROM orders")

# ---- three annotators per order ----

ANN = ["a1", "a2", "a3"]


def annotators(spark, sf) -> DataFrame:
    df = lab_order(spark, sf).select("id", "label")
    for i, c in enumerate(ANN, 1):
        wrong = ((F.col("label") + 1 + F.floor(rand.uniform(f"ann{i}/to", "id") * (KO - 1))) % KO).cast("int")
        df = df.withColumn(c, F.when(rand.uniform(f"ann{i}", "id") < 0.15, wrong).otherwise(F.col("label")))
    return df


fragment("annotators", "SELECT id, label, " + ", ".join(
    f"(CASE WHEN {U(f'ann{i}', 'id')} < 0.15 THEN (label+1+floor({U(f'ann{i}/to', 'id')}*{KO-1})::INT)%{KO} ELSE label END)::INT AS {c}"
    for i, c in enumerate(ANN, 1)) + " FROM lab_order", "lab_order")


# ---- score tables over lineitem (three classes) ----

def probs_line(spark, sf) -> DataFrame:
    easy = rand.uniform("pk", "id") < 0.8
    raw = F.array(*[rand.uniform("p", "id", F.lit(j)) + F.when((F.col("label") == j) & easy, 1.0).otherwise(0.0) for j in range(KL)])
    return lab_line(spark, sf).select("id", "label", raw.alias("w")).select(
        "id", "label", arrays.shares("w").alias("probs"))


fragment("probs_raw", "SELECT id, label, [" + ", ".join(
    f"{U('p', 'id', str(j))} + CASE WHEN label={j} AND {U('pk', 'id')} < 0.8 THEN 1.0::DOUBLE ELSE 0::DOUBLE END" for j in range(KL)) + "] AS w FROM lab_line", "lab_line")
fragment("probs_line", "SELECT id, label, list_transform(w, lambda x: x / (w[1]+w[2]+w[3])) AS probs FROM probs_raw", "probs_raw")

EPOCHS = 5


def dynamics_line(spark, sf, label=None) -> DataFrame:
    base = lab_line(spark, sf).select("id", "label", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))).alias("epoch"))
    easy = rand.uniform("lk", "id") < 0.8
    logits = F.array(*[
        rand.uniform(F.concat(F.lit("l"), F.col("epoch").cast("string")), "id", F.lit(j)) * 4.0
        + F.when((F.col("label") == j) & easy, F.col("epoch") / 2).otherwise(0.0) for j in range(KL)])
    return base.select("id", "epoch", F.col("label").alias("target"), logits.alias("logits"))


fragment("dynamics_line", "SELECT id, epoch, label AS target, [" + ", ".join(
    "(" + U("('l'||epoch)", "id", str(j)) + f"*4.0::DOUBLE + CASE WHEN label={j} AND {U('lk', 'id')} < 0.8 THEN epoch/2.0::DOUBLE ELSE 0::DOUBLE END)" for j in range(KL))
    + f"] AS logits FROM lab_line, (SELECT unnest(range({EPOCHS})) AS epoch)", "lab_line")


def preds_line(spark, sf) -> DataFrame:
    wrong = ((F.col("label") + 1 + F.floor(rand.uniform("pred/to", "id") * (KL - 1))) % KL).cast("int")
    return lab_line(spark, sf).select("id", "label", F.when(rand.uniform("pred", "id") < 0.25, wrong).otherwise(F.col("label")).alias("pred"))


fragment("preds_line", f"SELECT id, label, (CASE WHEN {U('pred', 'id')} < 0.25 THEN (label+1+floor({U('pred/to', 'id')}*{KL-1})::INT)%{KL} ELSE label END)::INT AS pred FROM lab_line", "lab_line")


def noisy_structured(spark, sf, rate: float = 0.2) -> DataFrame:
    """Structured vectors with uniform label noise; ``label`` is the noisy one, as a detector sees it."""
    from labelq.operators import noise

    d = noise.uniform(lab_structured(spark, sf), KE, rate, "uni")
    return d.select("id", "features", F.col("noisy_label").alias("label"), F.col("label").alias("true_label"), "is_injected_noise")


fragment("noisy_structured", f"""SELECT id, features, nl AS label, label AS true_label, (nl <> label)::INT AS is_injected_noise FROM (
 SELECT *, (CASE WHEN {U('uni', 'id')} < 0.2 THEN (label+1+floor({U('uni/to', 'id')}*{KE-1})::INT)%{KE} ELSE label END)::INT AS nl FROM lab_structured)""", "lab_structured")

# Metrics of a (by, t, p) relation named ``src`` as SQL; used by many twins.


def metrics_sql(src: str, by: str = "", cols: tuple[str, ...] = ("f1", "weighted_f1", "accuracy", "precision", "recall", "error_rate", "true_error_rate", "weighted_precision", "weighted_recall")) -> str:
    g = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    defs = {
        "f1": "sum(h)/sum(s)", "weighted_f1": "sum(f*s)/sum(s)", "accuracy": "sum(h)/sum(s)", "precision": "sum(h)/sum(s)",
        "recall": "sum(h)/sum(s)", "error_rate": "sum(h)/sum(s)", "true_error_rate": "1-sum(h)/sum(s)",
        "weighted_precision": "sum(pr*s)/sum(s)", "weighted_recall": "sum(rc*s)/sum(s)"}
    outs = ", ".join(f"round({defs[c]},6) AS {c}" for c in cols)
    return f"""SELECT {g}sum(s)::BIGINT AS n_rows, {outs} FROM (
 SELECT {g}c, s, p, h, CASE WHEN p>0 THEN h/p ELSE 0 END AS pr, CASE WHEN s>0 THEN h/s ELSE 0 END AS rc, CASE WHEN s+p>0 THEN 2*h/(s+p) ELSE 0 END AS f FROM (
  SELECT {g}c, sum(s)::DOUBLE AS s, sum(p)::DOUBLE AS p, sum(h)::DOUBLE AS h FROM (
   SELECT {g}t AS c, 1 AS s, 0 AS p, (t=p)::INT AS h FROM {src} UNION ALL SELECT {g}p AS c, 0, 1, 0 FROM {src}) GROUP BY {g}c)) {gb}"""
