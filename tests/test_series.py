import numpy as np
import pytest
from pyspark.sql import functions as F

from labelq.functions import rand
from labelq.operators import series


def signal(spark, n, ids=2, digits=1):
    return spark.range(n).select(F.explode(F.sequence(F.lit(0), F.lit(ids - 1))).alias("s"), F.col("id").alias("t")).select(
        F.col("s").cast("long").alias("id"), "t", F.round(rand.normal("sig", "s", "t"), digits).alias("value"))


def brute_maxima(v):
    out, i, n = [], 1, len(v)
    while i < n - 1:
        if v[i - 1] < v[i]:
            j = i
            while j < n - 1 and v[j + 1] == v[i]:
                j += 1
            if j < n - 1 and v[j + 1] < v[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return out


def brute_apart(t, h, d):
    keep = dict.fromkeys(t, True)
    for i in sorted(range(len(t)), key=lambda i: (-h[i], -t[i])):
        if keep[t[i]]:
            for j in range(len(t)):
                if j != i and abs(t[j] - t[i]) < d:
                    keep[t[j]] = False
    return [x for x in t if keep[x]]


@pytest.mark.parametrize("chunk,rounds", [(64, 1), (64, 3), (100000, 8)])
def test_maxima_and_spacing_across_chunks(spark, chunk, rounds):
    d = signal(spark, 1500)
    p = series.local_maxima(d, chunk)
    spaced = series.peaks_apart(p, 6, chunk, rounds).toPandas()
    rows = d.toPandas()
    peaks = p.toPandas()
    for i, g in rows.groupby("id"):
        v = g.sort_values("t")["value"].to_numpy()
        want = brute_maxima(v)
        assert sorted(peaks[peaks.id == i]["t"]) == want
        assert sorted(spaced[spaced.id == i]["t"]) == brute_apart(want, [v[t] for t in want], 6)


def test_falling_heights_take_many_passes(spark):
    """A long falling chain makes every outcome depend on the far left."""
    d = spark.range(400).select(F.lit(1).cast("long").alias("id"), F.col("id").alias("t"), (F.when(F.col("id") % 2 == 1, 1000.0).otherwise(0.0) - F.col("id") * (F.col("id") % 2)).alias("value"))
    p = series.local_maxima(d)
    got = sorted(r["t"] for r in series.peaks_apart(p, 3, 20, 16).collect())
    t = [r["t"] for r in p.orderBy("t").collect()]
    h = [1000.0 - x for x in t]
    assert got == brute_apart(t, h, 3)


def test_spacing_of_ties_nulls_and_no_peaks(spark):
    """Equal heights: the later peak stays. An empty table gives an empty table."""
    flat = spark.range(0, 300, 2).select(F.lit(1).cast("long").alias("id"), F.col("id").alias("t"), F.lit(5.0).alias("height"))
    got = sorted(r["t"] for r in series.peaks_apart(flat, 5, 32, 16).collect())
    assert got == brute_apart(list(range(0, 300, 2)), [5.0] * 150, 5)
    assert series.peaks_apart(flat.limit(0), 5).count() == 0
    assert sorted(r["t"] for r in series.peaks_apart(flat, 1).collect()) == list(range(0, 300, 2))


@pytest.mark.parametrize("direct", [10000, 50])
def test_self_convolution_direct_and_split(spark, direct):
    d = signal(spark, 333, 2, 6)
    got = series.self_convolution(d, series.lengths(d), direct).toPandas()
    for i, g in d.toPandas().groupby("id"):
        v = g.sort_values("t")["value"].to_numpy()
        v = v - v.mean()
        full = np.convolve(v, v)
        want = full[(len(v) - 1) // 2:(len(v) - 1) // 2 + len(v)]
        assert np.allclose(got[got.id == i].sort_values("t")["value"], want, atol=1e-8)


def test_speedup_and_average_match_numpy(spark):
    d = signal(spark, 60, 1, 3).select("id", F.lit(0).alias("channel"), "t", "value")
    place = spark.createDataFrame([(0, 60, 8, 20, 37)], "id long, n long, w long, s long, e long")
    v = d.orderBy("t").toPandas()["value"].to_numpy()
    fast = series.speedup(d, place, 2.0).orderBy("t").toPandas()["value"].to_numpy()
    m = 17
    want = np.r_[v[:20], np.interp(np.linspace(0, m - 1, int(m / 2.0)), np.arange(m), v[20:37]), v[37:]]
    assert np.allclose(fast, want)
    for width in (2, 3, 5):
        avg = series.average(d, place, width).orderBy("t").toPandas()["value"].to_numpy()
        smooth = np.r_[v[:20], np.convolve(v[20:37], np.ones(width), "same") / width, v[37:]]
        assert np.allclose(avg, smooth)


def test_series_without_window_keeps_its_values(spark):
    d = signal(spark, 40, 2, 3).select("id", F.lit(0).alias("channel"), "t", "value")
    place = spark.createDataFrame([(0, 40, 8, 5, 13)], "id long, n long, w long, s long, e long")
    for kind in ("flip", "speedup", "noise", "cutoff", "scale", "wander", "average", "contextual"):
        out = series.inject(d, place, kind).filter("id = 1").orderBy("t").toPandas()
        assert np.allclose(out["value"], d.filter("id = 1").orderBy("t").toPandas()["value"]), kind
    with pytest.raises(ValueError):
        series.inject(d, place, "melt")


def test_segments_hold_one_known_note(spark):
    d = signal(spark, 800, 1, 6)
    notes = d.filter(rand.uniform("note", "t") < 0.05).select("id", "t", F.when(rand.uniform("sym", "t") < 0.5, "N").otherwise("V").alias("symbol"))
    got = series.segment_at_peaks(d, notes, ["N", "V"], 20, 10, chunk=64).toPandas()
    v = d.orderBy("t").toPandas()["value"].to_numpy()
    peaks = brute_maxima(v)
    peaks = brute_apart(peaks, [v[t] for t in peaks], 10)[1:-1]
    marks = notes.toPandas()
    want = {}
    for p in peaks:
        inside = marks[(marks.t >= p - 10) & (marks.t <= p + 10)]
        if len(inside) == 1:
            want[p] = (inside.iloc[0]["symbol"], list(v[max(0, p - 10):p + 10]))
    assert {int(r.t): (r.symbol, list(r["values"])) for _, r in got.iterrows()} == want


def test_nearest_size_across_blocks(spark):
    d = signal(spark, 90, 1, 3).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel"), "t", (F.col("value")).alias("value"))
    moved = d.withColumn("value", F.col("value") + F.when(F.col("t") % 5 == 0, 0.37).otherwise(0.0))
    got = series.anomaly_size_nearest(d, moved, rows=16).orderBy("t").toPandas()["size"].to_numpy()
    a = d.toPandas().pivot(index="t", columns="channel", values="value").to_numpy()
    b = moved.toPandas().pivot(index="t", columns="channel", values="value").to_numpy()
    want = np.sort(np.abs(b[:, None] - a[None]).sum(2), axis=1)[:, :2].mean(1) / 2
    assert np.allclose(got, want)
