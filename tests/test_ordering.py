import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelq.functions import rand
from labelq.functions.ordering import DIGIT, _next_digit, flag_first, halo, ordered_image, quantile, ranked, take_first


@pytest.fixture(scope="module")
def hot(spark):
    """20 000 rows; one key has a third of them, half of its values are equal."""
    rng = np.random.default_rng(1)
    n = 20000
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    value = np.where(rng.random(n) < 0.5, 7.0, np.round(rng.normal(size=n), 3))
    pdf = pd.DataFrame({"id": np.arange(n), "key": key, "value": value})
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_ranked_with_heavy_ties(hot):
    pdf, df = hot
    got = ranked(df, ["key"], F.col("value"), F.col("id"), buckets=16).toPandas().set_index("id")["rank"].sort_index()
    want = pdf.sort_values(["key", "value", "id"]).groupby("key").cumcount() + 1
    assert (got == want.sort_index()).all()


def test_ranked_without_keys_and_with_given_bucket(hot):
    pdf, df = hot
    h = rand.hash32("x", "id")
    got = ranked(df, [], h, F.lit(0), [F.col("id")], bucket=F.shiftright(h, 26)).withColumn("h", h).toPandas()
    want = got.sort_values(["h", "id"]).reset_index(drop=True)
    assert (want["rank"] == np.arange(1, len(want) + 1)).all()


@pytest.mark.parametrize("f", [0.0, 0.013, 0.25, 0.5, 0.95, 1.0])
def test_quantile(hot, f):
    pdf, df = hot
    got = quantile(df, "value", f, ["key"]).toPandas().set_index("key")["quantile"]
    want = pdf.groupby("key")["value"].quantile(f)
    assert np.allclose(got.sort_index(), want.sort_index())


def test_quantile_by_position_and_fraction_per_key(spark, hot):
    pdf, df = hot
    sizes = pdf.groupby("key").size()
    places = spark.createDataFrame([(int(k), int(n // 3)) for k, n in sizes.items()], "key long, position long")
    got = quantile(df, "value", places, ["key"]).toPandas().set_index("key")["quantile"].sort_index()
    want = pdf.sort_values("value").groupby("key")["value"].apply(lambda s: s.iloc[len(s) // 3])
    assert (got == want.sort_index()).all()
    shares = spark.createDataFrame([(int(k), (k + 1) / 50) for k in sizes.index], "key long, fraction double")
    got = quantile(df, "value", shares, ["key"]).toPandas().set_index("key")["quantile"].sort_index()
    want = pd.Series({k: pdf[pdf.key == k]["value"].quantile((k + 1) / 50) for k in sizes.index})
    assert np.allclose(got, want.sort_index())


def test_take_first_exact_counts_and_edges(hot):
    pdf, df = hot
    h = rand.hash32("t", "id")
    got = take_first(df, F.floor(F.col("group_rows") * 0.3), h, F.col("id"), ["key"]).toPandas()
    assert (got.groupby("key").size() == np.floor(pdf.groupby("key").size() * 0.3)).all()
    assert take_first(df, F.lit(0), h, F.col("id")).count() == 0
    assert take_first(df, F.lit(10 ** 9), h, F.col("id")).count() == len(pdf)
    flagged = flag_first(df, F.lit(1234), h, F.col("id")).withColumn("h", h).toPandas()
    first = flagged.sort_values(["h", "id"]).head(1234)
    assert flagged["taken"].sum() == 1234 and first["taken"].all()


def test_draws_do_not_depend_on_partitioning(hot):
    _, df = hot
    a = df.repartition(3).select("id", rand.uniform("z", "id").alias("u")).orderBy("id").toPandas()
    b = df.repartition(11).select("id", rand.uniform("z", "id").alias("u")).orderBy("id").toPandas()
    assert a.equals(b)
    assert abs(a["u"].mean() - 0.5) < 0.01


def test_halo_gives_exact_neighbours(spark):
    df = spark.range(100).select(F.lit(1).alias("id"), F.col("id").alias("t"), (F.col("id") * F.col("id")).alias("value"))
    w = W.partitionBy("id", "chunk").orderBy("t")
    got = halo(df, "t", 7, 2).withColumn("b", F.lag("value", 2).over(w)).withColumn("a", F.lead("value", 2).over(w)).filter("core").toPandas()
    assert len(got) == 100
    assert got[got.t >= 2].apply(lambda r: r["b"] == (r["t"] - 2) ** 2, axis=1).all()
    assert got[got.t <= 97].apply(lambda r: r["a"] == (r["t"] + 2) ** 2, axis=1).all()


def test_normal_draws(spark):
    x = spark.range(20000).select(rand.normal("n", "id").alias("x"), rand.truncated_normal_above(0.2, 0.1, "q", "id").alias("q")).toPandas()
    assert abs(x["x"].mean()) < 0.03 and abs(x["x"].std() - 1) < 0.03
    assert x["q"].between(0.2, 0.3).all() and abs(x["q"].mean() - 0.2460) < 0.002


def test_ordered_image_is_the_bit_pattern(spark):
    rng = np.random.default_rng(5)
    raw = rng.integers(-(2 ** 63), 2 ** 63 - 1, 20000).view(np.float64)
    powers = np.ldexp(1.0, np.arange(-1074, 1024))
    near = np.concatenate([powers, np.nextafter(powers, np.inf), np.nextafter(powers, 0)])
    x = np.concatenate([raw[~np.isnan(raw)], near, -near, [0.0, -0.0, np.inf, -np.inf]])
    df = spark.createDataFrame(pd.DataFrame({"n": np.arange(len(x)), "x": x}))
    got = df.select("n", ordered_image(F.col("x")).alias("i")).toPandas().sort_values("n")["i"].to_numpy()
    size = np.abs(x).view(np.int64)
    assert (got == np.where(x < 0, -size, size)).all()
    nan = spark.sql("SELECT double('NaN') AS x UNION ALL SELECT CAST(NULL AS DOUBLE)").select(ordered_image(F.col("x")).alias("i")).collect()
    assert {r["i"] for r in nan} == {0x7FF8 << 48, None}


def test_quantile_of_a_million_distinct_values_counts_digits(spark):
    """No keys: the values of one bracket differ in their low bits only, the worst case for high digits."""
    n = 1_000_000
    df = spark.range(n).select((F.lit(1.0) + F.col("id") * F.lit(2.0 ** -52)).alias("value"))
    for f in (0.0, 0.37, 1.0):
        got = quantile(df, "value", f).first()
        assert got["group_rows"] == n
        at = f * (n - 1)
        assert abs(got["quantile"] - (1.0 + at * 2.0 ** -52)) <= 2.0 ** -52
    cells = df.select(F.col("value").alias("_v"), ordered_image(F.col("value")).alias("_i"), F.lit(1).cast("long").alias("_c"))
    pick = spark.createDataFrame([(370_000, 0)], "_need long, _p long")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digits = cells.filter(F.shiftright("_i", shift + DIGIT) == pick.first()["_p"]) if shift + DIGIT < 64 else cells
        assert digits.select(F.shiftright("_i", shift)).distinct().count() <= 1 << DIGIT
        pick = spark.createDataFrame(_next_digit(cells, pick, [], shift).collect(), "_need long, _p long")
    assert pick.first()["_need"] == 0 and pick.first()["_p"] == (1023 << 52) + 370_000


def test_quantile_of_nulls_infinities_and_nothing(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", -inf), ("a", 1.0), ("a", inf), ("b", None), ("c", -0.0), ("c", 0.0)], "key string, value double")
    got = {r["key"]: (r["group_rows"], r["quantile"]) for r in quantile(df, "value", 0.5, ["key"]).collect()}
    assert got == {"a": (3, 1.0), "c": (2, 0.0)}
    assert {r["key"]: r["quantile"] for r in quantile(df, "value", 1.0, ["key"]).collect()} == {"a": inf, "c": 0.0}
    assert quantile(df.limit(0), "value", 0.5, ["key"]).count() == 0
