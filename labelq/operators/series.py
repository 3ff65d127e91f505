"""Time series in long form ``(id, channel, t, value)``: peaks, windows and injected anomalies.

``t`` counts from 0 without gaps. A series may hold most of the table: frames over a whole series
run on overlapping chunks (``halo``), long transforms are split, and only the anomaly windows, which
have at most ``3 * MAX_WINDOW`` steps, are handled as one group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelq.functions import rand
from labelq.functions.ordering import halo, ranked
from labelq.session import materialised

# Bounds of the anomaly window in steps, and the kinds of anomaly.
MIN_WINDOW, MAX_WINDOW = 8, 128
KINDS = ("spikes", "contextual", "flip", "speedup", "noise", "cutoff", "scale", "wander", "average")

CHUNK = 65536
DIRECT = 32768


def lengths(series: DataFrame) -> DataFrame:
    """(id, n): number of steps."""
    return series.groupBy("id").agg((F.max("t") + 1).alias("n"))


# ---- peaks ----

def local_maxima(signal: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(id, t, height) of strict local maxima of (id, t, value); a flat top counts once, at its middle."""
    w = W.partitionBy("id", "chunk").orderBy("t")
    prev = F.lag("value").over(w)
    steps = halo(signal.select("id", "t", "value"), "t", chunk, 1).withColumn("_p", prev)
    turns = steps.filter(F.col("core") & (F.col("_p").isNull() | (F.col("_p") != F.col("value")))).select("id", "t", "value")
    numbered = ranked(turns, ["id"], F.col("t"), F.lit(0), out="_c").withColumn("_c", F.col("_c") - 1)
    v = W.partitionBy("id", "chunk").orderBy("_c")
    around = halo(numbered, "_c", chunk, 1).select(
        "*", F.lag("value").over(v).alias("_b"), F.lead("value").over(v).alias("_a"), F.lead("t").over(v).alias("_e"))
    top = F.col("core") & (F.col("value") > F.col("_b")) & (F.col("value") > F.col("_a"))
    return around.filter(top).select("id", F.floor((F.col("t") + F.col("_e") - 1) / 2).alias("t"), F.col("value").alias("height"))


def peaks_apart(peaks: DataFrame, distance: int, chunk: int = CHUNK, rounds: int = 8) -> DataFrame:
    """(id, t, height) of peaks at least ``distance`` apart, the higher ones first, later ones on ties.

    Rounds of a ranked independent set: an open peak that tops all open peaks closer than ``distance``
    stays, and it closes those peaks. A round looks ``distance`` to either side twice, so a pass of
    ``rounds`` rounds over chunks that overlap by that reach is exact for the own rows of a chunk; its
    width never grows. The next pass sees only what is still open, usually nothing. Every pass closes
    the highest open peak of each series at least, so the passes end.
    """
    reach = distance - 1
    near = W.partitionBy("id", "chunk").orderBy("t").rangeBetween(-reach, reach)
    todo, done = peaks.select("id", F.col("t").cast("long").alias("t"), "height"), None
    while True:
        # state: 0 open, 1 stays, 2 closed by a neighbour
        cut = halo(todo, "t", chunk, 2 * reach * rounds).withColumn("_s", F.lit(0))
        for _ in range(rounds):
            rank = F.when(F.col("_s") == 0, F.struct("height", "t"))
            top = (F.col("_s") == 0) & (F.max(rank).over(near)["t"] == F.col("t"))
            cut = cut.withColumn("_top", F.coalesce(top, F.lit(False)))
            closed = (F.col("_s") == 0) & F.max("_top").over(near)
            cut = cut.withColumn("_s", F.when(F.col("_top"), 1).when(closed, 2).otherwise(F.col("_s")))
        step = materialised(cut.filter("core AND _s < 2").select("id", "t", "height", "_s"), "peaks")
        kept = step.filter("_s = 1").select("id", "t", "height")
        done = kept if done is None else done.unionByName(kept)
        todo = step.filter("_s = 0").select("id", "t", "height")
        if todo.isEmpty():
            return done


def self_convolution(signal: DataFrame, lengths_: DataFrame, direct: int = DIRECT) -> DataFrame:
    """(id, t, value): the centred signal convolved with itself, middle part of the signal's length.

    Short series are transformed in one task each. A long one is padded to N1*N2 and transformed by
    the two-stage split of the discrete Fourier transform: groups of N1, twiddle factors, groups of
    N2; so a group holds about sqrt(N) values.
    """
    idt = dict(signal.dtypes)["id"]
    means = signal.groupBy("id").agg(F.avg("value").alias("_m"), F.count("*").alias("_n"))
    x = signal.join(means, "id").select("id", "t", (F.col("value") - F.col("_m")).alias("value"), F.col("_n").alias("n"))

    @F.pandas_udf("array<double>")
    def whole(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            n = len(v)
            size = 1 << int(2 * n - 1).bit_length()
            full = np.fft.irfft(np.fft.rfft(v, size) ** 2, size)
            out.append(full[(n - 1) // 2:(n - 1) // 2 + n])
        return pd.Series(out)

    # A short series is one row of at most ``direct`` values, so many of them share an Arrow batch.
    packed = x.filter(F.col("n") <= direct).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("p"))
    short = packed.select("id", F.posexplode(whole(F.col("p.value"))).alias("t", "value")).select("id", F.col("t").cast("long").alias("t"), "value")
    if lengths_.filter(F.col("n") > direct).isEmpty():
        return short

    # side = number of rows and columns of the N1 x N2 arrangement, a power of two
    side = F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * F.col("n")) / 2)).cast("long")
    long = x.filter(F.col("n") > direct).withColumn("side", side)

    def stage(first: bool, inverse: bool, square: bool):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            m, n = int(pdf["side"].iloc[0]), int(pdf["n"].iloc[0])
            z = np.zeros(m, dtype=complex)
            z[pdf["a"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
            z = np.fft.ifft(z) if inverse else np.fft.fft(z)
            other = int(key[1])
            if first:
                sign = 2j if inverse else -2j
                z = z * np.exp(sign * np.pi * other * np.arange(m) / (m * m))
            if square:
                z = z * z
            return pd.DataFrame({"id": key[0], "n": n, "side": m, "a": np.full(m, other), "b": np.arange(m), "re": z.real, "im": z.imag})
        return run

    schema = f"id {idt}, n long, side long, a long, b long, re double, im double"
    # input index = a*side + b, transformed over a in groups of b
    cells = long.select("id", "n", "side", F.floor(F.col("t") / F.col("side")).alias("a"), (F.col("t") % F.col("side")).alias("b"), F.col("value").alias("re"), F.lit(0.0).alias("im"))
    one = cells.groupBy("id", "b").applyInPandas(stage(True, False, False), schema)  # a = old b, b = frequency k1
    two = one.groupBy("id", "b").applyInPandas(stage(False, False, True), schema)  # a = k1, b = k2; frequency = k2*side + k1
    # inverse: index f = k2*side + k1 plays the part of a*side + b
    back = two.select("id", "n", "side", F.col("b").alias("a"), F.col("a").alias("b"), "re", "im")
    three = back.groupBy("id", "b").applyInPandas(stage(True, True, False), schema)
    four = three.groupBy("id", "b").applyInPandas(stage(False, True, False), schema)
    place = F.col("b") * F.col("side") + F.col("a") - F.floor((F.col("n") - 1) / 2)
    long_out = four.select("id", place.cast("long").alias("t"), F.col("re").alias("value"), "n").filter((F.col("t") >= 0) & (F.col("t") < F.col("n"))).drop("n")
    return short.unionByName(long_out)


def window_size_from(peaks: DataFrame) -> DataFrame:
    """(id, w): whole part of the mean gap between peaks, kept within the window bounds; null below two peaks."""
    gap = (F.max("t") - F.min("t")) / (F.count("*") - 1)
    w = F.when(F.count("*") > 1, F.least(F.greatest(F.floor(gap), F.lit(MIN_WINDOW)), F.lit(MAX_WINDOW)))
    return peaks.groupBy("id").agg(w.cast("long").alias("w"))


def conv_peaks(signal: DataFrame, chunk: int = CHUNK, direct: int = DIRECT) -> DataFrame:
    """Peaks of the self-convolution, at least ``MIN_WINDOW`` apart."""
    n = lengths(signal)
    conv = materialised(self_convolution(signal, n, direct), "conv")
    return peaks_apart(local_maxima(conv, chunk), MIN_WINDOW, chunk)


def place_anomaly(peaks: DataFrame, window: DataFrame, lengths_: DataFrame, max_length: int = 4, tag: str = "place") -> DataFrame:
    """(id, n, w, s, e): an anomaly of 1..max_length-1 windows, starting around a random peak after the first tenth."""
    numbered = ranked(peaks.select("id", "t"), ["id"], F.col("t"), F.lit(0), out="_i").withColumn("_i", F.col("_i") - 1)
    counts = peaks.groupBy("id").agg(F.count("*").alias("_k"))
    first = F.ceil(F.col("_k") * F.lit(0.1))
    pick = (first + F.floor(rand.uniform(tag + "/peak", "id") * (F.col("_k") - first))).cast("long")
    series = lengths_.join(window, "id").filter(F.col("w").isNotNull()).join(counts, "id").withColumn("_i", pick)
    chosen = series.join(numbered, ["id", "_i"])
    length = 1 + F.floor(rand.uniform(tag + "/length", "id") * (max_length - 1))
    s = F.greatest(F.col("t") - F.floor(F.col("w") / 2), F.lit(0))
    return chosen.select("id", "n", "w", s.alias("s"), length.cast("long").alias("_l")).select(
        "id", "n", "w", "s", F.least(F.col("s") + F.col("_l") * F.col("w"), F.col("n")).alias("e"))


# ---- anomalies ----

def channel_correlation(series: DataFrame, chosen: int = 0, root: float = 5.0) -> DataFrame:
    """(id, channel, corr): correlation with the chosen channel, sign(c)*|c|^(1/root), undefined as 0.

    Every channel of every series has a row; one of a series without the chosen channel correlates with nothing.
    """
    base = series.filter(F.col("channel") == chosen).select("id", "t", F.col("value").alias("_y"))
    c = series.join(base, ["id", "t"], "left").groupBy("id", "channel").agg(F.corr("value", "_y").alias("c"), F.max("channel").alias("_x"))
    c = c.withColumn("c", F.when(F.isnan("c"), None).otherwise(F.col("c")))
    return c.select("id", "channel", F.coalesce(F.signum("c") * F.pow(F.abs("c"), F.lit(1.0 / root)), F.lit(0.0)).alias("corr"))


def _inside() -> Column:
    return (F.col("t") >= F.col("s")) & (F.col("t") < F.col("e"))


def _spot(series: DataFrame, place: DataFrame) -> DataFrame:
    """Series rows with their anomaly window; a series without one keeps its values (nulls compare false)."""
    return series.join(place.select("id", "s", "e"), "id", "left")


def spikes(series: DataFrame, corr: DataFrame, p: float = 0.5, scale: float = 2.0, tag: str = "spikes") -> DataFrame:
    """(.., value, label): a spike with probability p at every step, shared by the channels up to their correlation."""
    hit = (rand.uniform(tag + "/hit", "id", "t") < p).cast("int") * F.lit(scale) * rand.normal(tag, "id", "t")
    j = series.join(corr, ["id", "channel"], "left").withColumn("corr", F.coalesce("corr", F.lit(0.0))).withColumn("_spike", hit)
    return j.select("id", "channel", "t", (F.col("value") + F.col("_spike") * F.col("corr")).alias("value"), (F.abs("_spike") > 0.05).cast("int").alias("label"))


def contextual(series: DataFrame, place: DataFrame, corr: DataFrame, scale: float = 2.0, tag: str = "contextual") -> DataFrame:
    """Inside the window x becomes x + (a*x + b - x)*corr, with one random line per series."""
    a, b = 1.0 + F.lit(scale) * rand.normal(tag + "/a", "id"), F.lit(scale) * rand.normal(tag + "/b", "id")
    j = _spot(series, place).join(corr, ["id", "channel"], "left").withColumn("corr", F.coalesce("corr", F.lit(0.0)))
    x = F.col("value")
    return j.select("id", "channel", "t", F.when(_inside(), x + (a * x + b - x) * F.col("corr")).otherwise(x).alias("value"))


def flip(series: DataFrame, place: DataFrame) -> DataFrame:
    """The window runs backwards: its rows are renumbered."""
    t = F.when(_inside(), F.col("s") + F.col("e") - 1 - F.col("t")).otherwise(F.col("t"))
    return _spot(series, place).select("id", "channel", t.alias("t"), "value")


def speedup(series: DataFrame, place: DataFrame, speed: float = 2.0) -> DataFrame:
    """The window is resampled linearly to floor(length/speed) steps; what follows moves up."""
    j = _spot(series, place)
    m = F.col("e") - F.col("s")
    q = F.floor(m / F.lit(speed))
    outside = j.filter(~_inside() | F.col("s").isNull()).select(
        "id", "channel", F.when(F.col("t") >= F.col("e"), F.col("t") - m + q).otherwise(F.col("t")).alias("t"), "value")
    packed = j.filter(_inside()).groupBy("id", "channel", "s", "e").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda z: z["value"]).alias("v"))
    fresh = packed.filter(q > 0).withColumn("q", q).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), q - 1)))
    pos = F.when(F.col("q") > 1, F.col("i") * (m - 1) / (F.col("q") - 1)).otherwise(F.lit(0.0))
    lo = F.floor(F.col("_pos"))
    a, b = F.get("v", lo.cast("int")), F.get("v", F.least(lo + 1, F.size("v") - 1).cast("int"))
    inside = fresh.withColumn("_pos", pos).select("id", "channel", (F.col("s") + F.col("i")).alias("t"), (a + (b - a) * (F.col("_pos") - lo)).alias("value"))
    return outside.unionByName(inside)


def jitter(series: DataFrame, place: DataFrame, sigma: float = 0.05, tag: str = "jitter") -> DataFrame:
    """Normal noise inside the window, the same for all channels."""
    x = F.col("value")
    return _spot(series, place).select("id", "channel", "t", F.when(_inside(), x + F.lit(sigma) * rand.normal(tag, "id", "t")).otherwise(x).alias("value"))


def cutoff(series: DataFrame, place: DataFrame, kind: str = "noisy_0", quantile: float = 0.75, tag: str = "cutoff") -> DataFrame:
    """The window becomes a constant: its quantile, 0, 1, or 0 or 1 with slight noise."""
    j = _spot(series, place)
    if kind == "quantile":
        level = j.filter(_inside()).groupBy("id").agg(F.percentile("value", F.lit(quantile)).alias("_q"))
        j, new = j.join(level, "id", "left"), F.col("_q")
    elif kind in ("0", "1"):
        new = F.lit(float(kind))
    elif kind in ("noisy_0", "noisy_1"):
        new = F.lit(float(kind[-1])) + F.lit(0.01) * rand.normal(tag, "id", "t")
    else:
        raise ValueError(f"unknown cutoff {kind!r}")
    return j.select("id", "channel", "t", F.when(_inside(), new).otherwise(F.col("value")).alias("value"))


def scale(series: DataFrame, place: DataFrame, factor: float = 2.0) -> DataFrame:
    x = F.col("value")
    return _spot(series, place).select("id", "channel", "t", F.when(_inside(), x * factor).otherwise(x).alias("value"))


def wander(series: DataFrame, place: DataFrame, baseline: float = 0.2) -> DataFrame:
    """A ramp inside the window, a constant shift after it."""
    x, m = F.col("value"), F.col("e") - F.col("s")
    ramp = F.when(m > 1, F.lit(baseline) * (F.col("t") - F.col("s")) / (m - 1)).otherwise(F.lit(0.0))
    return _spot(series, place).select("id", "channel", "t", F.when(_inside(), x + ramp).when(F.col("t") >= F.col("e"), x + baseline).otherwise(x).alias("value"))


def average(series: DataFrame, place: DataFrame, width: int = 2) -> DataFrame:
    """Moving average inside the window, zeros beyond its ends."""
    j = _spot(series, place)
    after = (width - 1) // 2
    w = W.partitionBy("id", "channel").orderBy("t").rowsBetween(after - (width - 1), after)
    smooth = j.filter(_inside()).select("id", "channel", "t", (F.sum("value").over(w) / width).alias("value"))
    return j.filter(~_inside() | F.col("s").isNull()).select("id", "channel", "t", "value").unionByName(smooth)


def inject(series: DataFrame, place: DataFrame, kind: str, corr: DataFrame | None = None, **options) -> DataFrame:
    """Apply one kind of anomaly to every series that has a window; others are returned unchanged."""
    if kind == "spikes":
        return spikes(series, corr if corr is not None else channel_correlation(series), **options).drop("label")
    if kind == "contextual":
        return contextual(series, place, corr if corr is not None else channel_correlation(series), **options)
    plain = {"flip": flip, "speedup": speedup, "noise": jitter, "cutoff": cutoff, "scale": scale, "wander": wander, "average": average}
    if kind not in plain:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    return plain[kind](series, place, **options)


def anomaly_size(series: DataFrame, noisy: DataFrame, how: str = "mae") -> DataFrame:
    """(id, t, size): mean absolute or squared change over the channels."""
    a = F.abs(F.col("value") - F.col("_v")) if how == "mae" else F.pow(F.col("value") - F.col("_v"), 2)
    if how not in ("mae", "mse"):
        raise ValueError(f"unknown size {how!r}")
    both = series.join(noisy.select("id", "channel", "t", F.col("value").alias("_v")), ["id", "channel", "t"])
    return both.groupBy("id", "t").agg(F.avg(a).alias("size"))


def anomaly_size_nearest(series: DataFrame, noisy: DataFrame, rows: int = 4096) -> DataFrame:
    """(id, t, size): mean city-block distance of a changed step to its two nearest original steps, per channel.

    A series is cut into blocks of originals and chunks of changed steps; a task compares one of each
    and returns two numbers per step.
    """
    def points(df: DataFrame) -> DataFrame:
        v = F.transform(F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda z: z["value"])
        return df.groupBy("id", "t").agg(v.alias("v"))

    n = lengths(series).select("id", F.ceil(F.col("n") / rows).cast("int").alias("_parts"))
    each = lambda: F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    part = lambda seed: F.pmod(F.xxhash64("id", "t", F.lit(seed)), F.col("_parts").cast("long")).cast("int")
    data = points(series).join(n, "id").withColumn("block", part(1)).withColumn("chunk", each()).drop("_parts")
    queries = points(noisy).join(n, "id").withColumn("chunk", part(2)).withColumn("block", each()).drop("_parts")
    queries = queries.toDF(*queries.columns)  # fresh column identities: both sides come from one table
    idt = dict(series.dtypes)["id"]

    def run(key: tuple, q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"id": [], "t": [], "dist": []})
        y = np.stack(d["v"].to_list())
        out = []
        for start in range(0, len(q), 256):
            x = np.stack(q["v"].iloc[start:start + 256].to_list())
            two = np.sort(np.abs(x[:, None, :] - y[None, :, :]).sum(2), axis=1)[:, :2]
            out.append(pd.DataFrame({"id": key[0], "t": np.repeat(q["t"].to_numpy()[start:start + 256], two.shape[1]), "dist": two.ravel() / x.shape[1]}))
        return pd.concat(out)

    near = queries.groupBy("id", "block", "chunk").cogroup(data.groupBy("id", "block", "chunk")).applyInPandas(run, f"id {idt}, t long, dist double")
    two = near.withColumn("_r", F.row_number().over(W.partitionBy("id", "t").orderBy("dist"))).filter("_r <= 2")
    return two.groupBy("id", "t").agg(F.avg("dist").alias("size"))


def anomaly_labels(series: DataFrame, place: DataFrame, widen: int = MIN_WINDOW, speed: float | None = None) -> DataFrame:
    """(id, t, label): 1 in the window and ``widen`` steps on both sides, for every step of any channel.

    With ``speed`` the labels are those of the series after ``speedup``: the window is floor(length / speed) steps
    long, and the series is shorter by what it lost.
    """
    steps = series.select("id", "t").distinct()
    j = steps.join(place.select("id", "s", "e"), "id", "left")
    if speed is not None:
        lost = (F.col("e") - F.col("s")) - F.floor((F.col("e") - F.col("s")) / F.lit(speed))
        last = steps.groupBy("id").agg(F.max("t").alias("_last"))
        j = j.join(last, "id").withColumn("_lost", F.coalesce(lost, F.lit(0))).filter(F.col("t") <= F.col("_last") - F.col("_lost"))
        j = j.withColumn("e", F.col("e") - F.col("_lost"))
    hit = (F.col("t") >= F.col("s") - widen) & (F.col("t") < F.col("e") + widen)
    return j.select("id", "t", F.coalesce(hit, F.lit(False)).cast("int").alias("label"))


# ---- segments ----

def segment_at_peaks(signal: DataFrame, annotations: DataFrame, classes: Sequence[str], size: int, distance: int = 150,
                     common: str | None = None, keep: float = 0.15, chunk: int = CHUNK, tag: str = "segment") -> DataFrame:
    """(id, t, symbol, values): a window around every peak that holds exactly one annotation, of a known class.

    The first and the last peak of a series are dropped, the common class is thinned. Windows meet
    annotations and samples through the chunks they touch, which is an equi-join.
    """
    peaks = peaks_apart(local_maxima(signal, chunk), distance, chunk)
    ends = peaks.groupBy("id").agg(F.min("t").alias("_f"), F.max("t").alias("_l"))
    inner = peaks.join(ends, "id").filter((F.col("t") > F.col("_f")) & (F.col("t") < F.col("_l")))
    half = size // 2
    spans = inner.select("id", F.col("t").alias("peak"), (F.col("t") - half).alias("s"), (F.col("t") + half).alias("e"))
    spans = materialised(spans.withColumn("chunk", F.explode(F.sequence(F.floor(F.greatest("s", F.lit(0)) / chunk), F.floor(F.col("e") / chunk)))), "spans")
    noted = annotations.withColumn("chunk", F.floor(F.col("t") / chunk))
    hits = spans.join(noted, ["id", "chunk"]).filter((F.col("t") >= F.col("s")) & (F.col("t") <= F.col("e")))
    single = hits.groupBy("id", "peak").agg(F.count("*").alias("_n"), F.max("symbol").alias("symbol")).filter(F.col("_n") == 1).filter(F.col("symbol").isin(*classes))
    if common is not None:
        single = single.filter((F.col("symbol") != common) | (rand.uniform(tag, "id", "peak") < keep))
    samples = signal.withColumn("chunk", F.floor(F.col("t") / chunk))
    inside = spans.join(single.select("id", "peak", "symbol"), ["id", "peak"]).join(samples, ["id", "chunk"]).filter((F.col("t") >= F.col("s")) & (F.col("t") < F.col("e")))
    values = F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda z: z["value"])
    return inside.groupBy("id", F.col("peak").alias("t"), "symbol").agg(values.alias("values"))
