"""Series queries: one series per user of ``events``, channels value and k."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelq.catalog.base import N, U, ctes, fragment, query, table
from labelq.functions import rand
from labelq.functions.ordering import ranked
from labelq.operators import prep, series
from labelq.session import materialised


def wide(spark, sf):
    """Events numbered within their user; stored, as every series query reads it several times."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("id"), "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("us"))
    d = ranked(e, ["id"], F.col("us"), F.col("event_id"), out="t").withColumn("t", F.col("t") - 1)
    return materialised(d.select("id", "t", "event_id", "event_type", F.col("value").alias("c0"), F.col("k").alias("c1")), "wide")


def long(w, columns=("c0", "c1")):
    cells = F.array(*[F.struct(F.lit(i).alias("channel"), F.col(c).alias("value")) for i, c in enumerate(columns)])
    return w.select("id", "t", F.explode(cells).alias("z")).select("id", "z.channel", "t", "z.value")


def signal(w):
    return w.select("id", "t", F.col("c0").alias("value"))


fragment("wide", """SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS t, event_id, event_type, value AS c0, json_extract(props, '$.k')::DOUBLE AS c1 FROM events""")
fragment("long", "SELECT id, 0 AS channel, t, c0 AS value FROM wide UNION ALL SELECT id, 1, t, c1 FROM wide", "wide")
fragment("maxima", """SELECT id, floor((t+e-1)/2)::BIGINT AS t, v AS height FROM (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a, lead(t) OVER w AS e FROM (
 SELECT * FROM (SELECT id, t, c0 AS v, lag(c0) OVER (PARTITION BY id ORDER BY t) AS p FROM wide) WHERE p IS NULL OR p<>v) WINDOW w AS (PARTITION BY id ORDER BY t)) WHERE v>b AND v>a""", "wide")


@query("series_local_maxima", ctes("maxima") + "SELECT id, t, height FROM maxima")
def _(spark, sf):
    return series.local_maxima(signal(wide(spark, sf)))


@query("series_autocorrelation", ctes("wide") + """, x AS (SELECT id, t, c0-avg(c0) OVER (PARTITION BY id) AS v, count(*) OVER (PARTITION BY id) AS n FROM wide)
 SELECT id, t, round(v+1e-7::DOUBLE,3) AS value FROM (SELECT a.id, a.t+b.t-(a.n-1)//2 AS t, sum(a.v*b.v) AS v, any_value(a.n) AS n FROM x a JOIN x b ON a.id=b.id GROUP BY 1,2) WHERE t>=0 AND t<n""")
def _(spark, sf):
    s = signal(wide(spark, sf))
    return series.self_convolution(s, series.lengths(s)).withColumn("value", F.round(F.col("value") + 1e-7, 3))


fragment("conv", """SELECT id, t, v FROM (SELECT a.id, a.t+b.t-(a.n-1)//2 AS t, sum(a.v*b.v) AS v, any_value(a.n) AS n FROM centred a JOIN centred b ON a.id=b.id GROUP BY 1,2) WHERE t>=0 AND t<n""", "centred")
fragment("centred", "SELECT id, t, c0-avg(c0) OVER (PARTITION BY id) AS v, count(*) OVER (PARTITION BY id) AS n FROM wide", "wide")
fragment("conv_maxima", """SELECT id, floor((t+e-1)/2)::BIGINT AS t, v AS height FROM (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a, lead(t) OVER w AS e FROM (
 SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY id ORDER BY t) AS p FROM conv) WHERE p IS NULL OR p<>v) WINDOW w AS (PARTITION BY id ORDER BY t)) WHERE v>b AND v>a""", "conv")


def apart(peaks: str, distance: int) -> str:
    """A recursive table of peaks (id, t, height, s); those with s=1 stay."""
    near = f"(PARTITION BY id ORDER BY t RANGE BETWEEN {distance - 1} PRECEDING AND {distance - 1} FOLLOWING)"
    return f"""apart AS (SELECT id, t, height, 0 AS s FROM {peaks} UNION ALL
 SELECT id, t, height, top::INT FROM (SELECT *, max(top::INT) OVER {near} AS shut FROM (SELECT id, t, height, k=max(k) OVER {near} AS top FROM (
 SELECT id, t, height, row_number() OVER (PARTITION BY id ORDER BY height, t) AS k FROM apart WHERE s=0))) WHERE top OR shut=0)"""


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("series_window_size", recursive(ctes("conv_maxima")) + f""", {apart("conv_maxima", series.MIN_WINDOW)}
 SELECT id, CASE WHEN count(*)>1 THEN least(greatest(floor((max(t)-min(t))/(count(*)-1)), {series.MIN_WINDOW}), {series.MAX_WINDOW})::BIGINT END AS w FROM apart WHERE s=1 GROUP BY id""")
def _(spark, sf):
    return series.window_size_from(series.conv_peaks(signal(wide(spark, sf))))


def place(w):
    s = signal(w)
    peaks = materialised(series.local_maxima(s), "maxima")
    return series.place_anomaly(peaks, series.window_size_from(peaks), series.lengths(s))


fragment("place", f"""SELECT id, n, w, s, least(s+len*w, n) AS e FROM (SELECT p.id, n, w, greatest(p.t-w//2, 0) AS s, 1+floor({U('place/length', 'p.id')}*3)::BIGINT AS len FROM (
 SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY t)-1 AS i FROM maxima) p JOIN (
 SELECT id, count(*) AS k, least(greatest(floor((max(t)-min(t))/(count(*)-1)),8),128)::BIGINT AS w FROM maxima GROUP BY id) m ON m.id=p.id JOIN (SELECT id, count(*) AS n FROM wide GROUP BY id) l ON l.id=p.id
 WHERE p.i = ceil(k*0.1::DOUBLE)+floor({U('place/peak', 'p.id')}*(k-ceil(k*0.1::DOUBLE))))""", "maxima")


@query("anomaly_place", ctes("place") + "SELECT * FROM place")
def _(spark, sf):
    return place(wide(spark, sf))


fragment("corr", """SELECT id, channel, coalesce(sign(c)*pow(abs(c),0.2::DOUBLE),0) AS corr FROM (SELECT a.id, a.channel, CASE WHEN stddev_pop(a.value)=0 OR stddev_pop(b.c0)=0 THEN NULL ELSE corr(a.value,b.c0) END AS c FROM long a JOIN wide b ON a.id=b.id AND a.t=b.t GROUP BY 1,2)""", "long")


@query("channel_correlation", ctes("corr") + "SELECT id, channel, round(corr,6) AS corr FROM corr")
def _(spark, sf):
    return series.channel_correlation(long(wide(spark, sf))).withColumn("corr", F.round("corr", 6))


SPIKE = f"(({U('spikes/hit', 'x.id', 't')} < 0.5)::INT*2.0::DOUBLE*{N('spikes', 'x.id', 't')})"
R = "round(value,6) AS value"


@query("anomaly_spikes", ctes("corr") + f"SELECT x.id, x.channel, t, round(value+{SPIKE}*corr,5) AS value, (abs({SPIKE})>0.05)::INT AS label FROM long x JOIN corr c ON c.id=x.id AND c.channel=x.channel")
def _(spark, sf):
    s = long(wide(spark, sf))
    return series.spikes(s, series.channel_correlation(s)).withColumn("value", F.round("value", 5))


fragment("spot", "SELECT x.*, p.s, p.e, coalesce(t>=s AND t<e, FALSE) AS inside FROM long x LEFT JOIN place p ON p.id=x.id", "long", "place")


def _register(key, sql, fn, digits=6, needs=("spot",)):
    @query(key, ctes(*needs) + sql)
    def _(spark, sf):
        w = wide(spark, sf)
        return fn(long(w), place(w)).withColumn("value", F.round("value", digits))


A, B = f"(1.0::DOUBLE+2.0::DOUBLE*{N('contextual/a', 'x.id')})", f"(2.0::DOUBLE*{N('contextual/b', 'x.id')})"
_register("anomaly_contextual", f"SELECT x.id, x.channel, t, round(CASE WHEN inside THEN value+({A}*value+{B}-value)*corr ELSE value END,4) AS value FROM spot x JOIN corr c ON c.id=x.id AND c.channel=x.channel",
          lambda s, p: series.contextual(s, p, series.channel_correlation(s)), 4, ("spot", "corr"))
_register("anomaly_flip", f"SELECT id, channel, CASE WHEN inside THEN s+e-1-t ELSE t END AS t, {R} FROM spot", series.flip)
_register("anomaly_speedup", """SELECT id, channel, CASE WHEN t>=e THEN t-(e-s)+(e-s)//2 ELSE t END AS t, round(value,5) AS value FROM spot WHERE NOT inside UNION ALL
 SELECT id, channel, s+i, round(v[lo+1]+(v[least(lo+2, len(v))]-v[lo+1])*(pos-lo),5) FROM (SELECT *, floor(pos)::BIGINT AS lo FROM (SELECT *, CASE WHEN q>1 THEN i*(len(v)-1)/(q-1) ELSE 0 END AS pos FROM (
  SELECT *, unnest(range(q)) AS i FROM (SELECT id, channel, s, (e-s)//2 AS q, list(value ORDER BY t) AS v FROM spot WHERE inside GROUP BY id, channel, s, e))))""", series.speedup, 5)
_register("anomaly_noise", f"SELECT id, channel, t, round(CASE WHEN inside THEN value+0.05::DOUBLE*{N('jitter', 'id', 't')} ELSE value END,6) AS value FROM spot", series.jitter)
_register("anomaly_cutoff", f"SELECT id, channel, t, round(CASE WHEN inside THEN 0.01::DOUBLE*{N('cutoff', 'id', 't')} ELSE value END,6) AS value FROM spot", series.cutoff)
_register("anomaly_cutoff_quantile", "SELECT x.id, channel, t, round(CASE WHEN inside THEN q ELSE value END,6) AS value FROM spot x LEFT JOIN (SELECT id, quantile_cont(value,0.75) AS q FROM spot WHERE inside GROUP BY id) l ON l.id=x.id",
          lambda s, p: series.cutoff(s, p, "quantile"))
_register("anomaly_scale", "SELECT id, channel, t, round(CASE WHEN inside THEN value*2 ELSE value END,6) AS value FROM spot", series.scale)
_register("anomaly_wander", "SELECT id, channel, t, round(CASE WHEN inside THEN value+CASE WHEN e-s>1 THEN 0.2::DOUBLE*(t-s)/(e-s-1) ELSE 0 END WHEN t>=e THEN value+0.2::DOUBLE ELSE value END,6) AS value FROM spot", series.wander)
AVG = "SELECT id, channel, t, value FROM spot WHERE NOT inside UNION ALL SELECT id, channel, t, (value+coalesce(lag(value) OVER (PARTITION BY id, channel ORDER BY t),0))/2 FROM spot WHERE inside"
_register("anomaly_average", f"SELECT id, channel, t, {R} FROM ({AVG})", series.average)

fragment("averaged", AVG, "spot")


@query("anomaly_size", ctes("averaged") + """SELECT a.id, a.t, round(avg(abs(a.value-b.value)),6) AS mae, round(avg((a.value-b.value)*(a.value-b.value))+1e-9::DOUBLE,6) AS mse FROM long a JOIN averaged b ON a.id=b.id AND a.channel=b.channel AND a.t=b.t GROUP BY 1,2""")
def _(spark, sf):
    w = wide(spark, sf)
    s = long(w)
    noisy = materialised(series.average(s, place(w)), "noisy")
    mae = series.anomaly_size(s, noisy, "mae").select("id", "t", F.round("size", 6).alias("mae"))
    return mae.join(series.anomaly_size(s, noisy, "mse").select("id", "t", F.round(F.col("size") + 1e-9, 6).alias("mse")), ["id", "t"])


@query("anomaly_size_nearest", ctes("averaged") + """, o AS (SELECT id, t, max(value) FILTER (WHERE channel=0) AS a, max(value) FILTER (WHERE channel=1) AS b FROM long GROUP BY 1,2),
 q AS (SELECT id, t, max(value) FILTER (WHERE channel=0) AS a, max(value) FILTER (WHERE channel=1) AS b FROM averaged GROUP BY 1,2)
 SELECT id, t, round(avg(d)/2,6) AS size FROM (SELECT q.id, q.t, abs(q.a-o.a)+abs(q.b-o.b) AS d, row_number() OVER (PARTITION BY q.id, q.t ORDER BY abs(q.a-o.a)+abs(q.b-o.b)) AS r FROM q JOIN o ON o.id=q.id) WHERE r<=2 GROUP BY 1,2""")
def _(spark, sf):
    w = wide(spark, sf)
    s = long(w)
    noisy = series.average(s, place(w))
    return series.anomaly_size_nearest(s, noisy).withColumn("size", F.round("size", 6))


@query("anomaly_labels", ctes("spot") + "SELECT id, t, coalesce(t>=s-8 AND t<e+8, FALSE)::INT AS label FROM spot WHERE channel=0")
def _(spark, sf):
    w = wide(spark, sf)
    return series.anomaly_labels(long(w), place(w))


@query("anomaly_labels_speedup", ctes("spot") + """SELECT id, t, coalesce(t>=s-8 AND t<s+(e-s)//2+8, FALSE)::INT AS label FROM (
 SELECT *, max(t) OVER (PARTITION BY id) AS z FROM spot WHERE channel=0) WHERE t <= z-coalesce((e-s)-(e-s)//2, 0)""")
def _(spark, sf):
    w = wide(spark, sf)
    return series.anomaly_labels(long(w), place(w), speed=2.0)


fragment("part_spot", "SELECT * FROM spot WHERE NOT (id % 7 = 3 AND channel = 0)", "spot")
fragment("part_corr", """SELECT x.id, x.channel, coalesce(CASE WHEN isnan(c) THEN 0 ELSE sign(c)*pow(abs(c),0.2::DOUBLE) END,0) AS c FROM (SELECT DISTINCT id, channel FROM part_spot) x LEFT JOIN (
 SELECT a.id, a.channel, corr(a.value,b.value) AS c FROM part_spot a JOIN part_spot b ON a.id=b.id AND a.t=b.t AND b.channel=0 GROUP BY 1,2) y ON y.id=x.id AND y.channel=x.channel""", "part_spot")


@query("anomaly_spikes_lost_channel", ctes("part_corr") + f"""SELECT s.id, s.channel, t, round(value+k*c,6) AS value, (abs(k)>0.05)::INT AS label FROM (
 SELECT *, ({U('spikes/hit', 'id', 't')}<0.5)::INT*2.0::DOUBLE*{N('spikes', 'id', 't')} AS k FROM part_spot) s JOIN part_corr p ON p.id=s.id AND p.channel=s.channel""")
def _(spark, sf):
    """Series of which every seventh has lost the chosen channel; all their rows come back."""
    part = long(wide(spark, sf)).filter("NOT (id % 7 = 3 AND channel = 0)")
    return series.spikes(part, series.channel_correlation(part)).withColumn("value", F.round("value", 6))


@query("feature_noise_series", ctes("spot") + f"""SELECT kind, id, channel, round(sum(v*t),3) AS moment FROM (
 SELECT 'flip' AS kind, id, channel, CASE WHEN inside THEN s+e-1-t ELSE t END AS t, value AS v FROM spot UNION ALL
 SELECT 'scale', id, channel, t, CASE WHEN inside THEN value*2 ELSE value END FROM spot UNION ALL
 SELECT 'noise', id, channel, t, CASE WHEN inside THEN value+0.05::DOUBLE*{N('jitter', 'id', 't')} ELSE value END FROM spot) GROUP BY 1,2,3""")
def _(spark, sf):
    w = wide(spark, sf)
    s = long(w)
    p = materialised(place(w), "place")
    kinds = [series.inject(s, p, k).select(F.lit(k).alias("kind"), "id", "channel", "t", "value") for k in ("flip", "scale", "noise")]
    both = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return both.groupBy("kind", "id", "channel").agg(F.round(F.sum(F.col("value") * F.col("t")), 3).alias("moment"))


@query("segment_at_peaks", recursive(ctes("maxima")) + f""", {apart("maxima", 10)},
 scaled AS (SELECT id, t, (c0-avg(c0) OVER w)/CASE WHEN stddev_pop(c0) OVER w=0 THEN 1 ELSE stddev_pop(c0) OVER w END AS value FROM wide WINDOW w AS (PARTITION BY id)),
 notes AS (SELECT id, t, event_type AS symbol FROM wide WHERE {U('note', 'event_id')}<0.1),
 spans AS (SELECT id, t AS peak FROM (SELECT *, min(t) OVER w AS f, max(t) OVER w AS l FROM apart WHERE s=1 WINDOW w AS (PARTITION BY id)) WHERE t>f AND t<l),
 single AS (SELECT p.id, peak, max(symbol) AS symbol FROM spans p JOIN notes n ON n.id=p.id AND n.t BETWEEN peak-8 AND peak+8 GROUP BY 1,2 HAVING count(*)=1),
 kept AS (SELECT * FROM single WHERE symbol IN ('view','purchase','error') OR (symbol='click' AND {U('segment', 'id', 'peak')}<0.15))
 SELECT k.id, peak AS t, symbol, count(*)::INT AS length, round(max(value), 6) AS top FROM kept k JOIN scaled v ON v.id=k.id AND v.t>=peak-8 AND v.t<peak+8 GROUP BY 1,2,3""")
def _(spark, sf):
    """Windows of 16 steps around peaks 10 apart that hold exactly one noted event."""
    w = wide(spark, sf)
    scaled = materialised(prep.zscore_per_record(w.select("id", "t", F.col("c0").alias("value")), ["id"], "value").select("id", "t", "value"), "scaled")
    notes = w.filter(rand.uniform("note", "event_id") < 0.1).select("id", "t", F.col("event_type").alias("symbol"))
    out = series.segment_at_peaks(scaled, notes, ["click", "view", "purchase", "error"], 16, 10, "click")
    return out.select("id", "t", "symbol", F.size("values").alias("length"), F.round(F.array_max("values"), 6).alias("top"))
