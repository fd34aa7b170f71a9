"""Queries on arrays of samples: native kernels with SQL, and spectral ones that run as Arrow kernels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from nocturne.functions import arrays as A
from nocturne.functions import spectral
from nocturne.operators import cardiac
from nocturne.plans.base import EV, ev, t
from nocturne.plans.registry import query

r6 = lambda c: F.round(c, 6)

S = "s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), m AS (SELECT *, list_avg(a) AS m, len(a) AS n FROM s)"


def samples(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))


def _mom(k):
    return f"(list_sum(list_transform(a, lambda x: {'*'.join(['(x - m)'] * k)})) / n)"


@query("arr_stats", f"""WITH {S}, v AS (SELECT *, {_mom(2)} AS m2, {_mom(3)} AS m3, {_mom(4)} AS m4 FROM m)
SELECT vec_id, round(m, 6) AS mean, round(sqrt(m2), 6) AS std, round(list_max(a) - list_min(a), 6) AS range, round(m3 / (m2 * sqrt(m2)), 6) AS skew, round(m4 / (m2 * m2) - 3, 6) AS kurtosis, round(sqrt(list_sum(list_transform(a, lambda x: x * x)) / n), 6) AS rms, round(list_avg(list_transform(a, lambda x: abs(x))), 6) AS abs_mean FROM v""")
def arr_stats(spark, sf):
    a = F.col("a")
    v = samples(spark, sf).withColumn("m", A.mean(a)).withColumns({"m2": A.moment(a, F.col("m"), 2), "m3": A.moment(a, F.col("m"), 3), "m4": A.moment(a, F.col("m"), 4)})
    m2 = F.col("m2")
    return v.select(
        "vec_id", r6("m").alias("mean"), r6(F.sqrt(m2)).alias("std"), r6(F.array_max(a) - F.array_min(a)).alias("range"), r6(F.col("m3") / (m2 * F.sqrt(m2))).alias("skew"),
        r6(F.col("m4") / (m2 * m2) - 3).alias("kurtosis"), r6(A.rms(a)).alias("rms"), r6(A.mean(F.transform(a, F.abs))).alias("abs_mean"),
    )


DIFF = "d AS (SELECT *, list_transform(range(2, len(a) + 1), lambda i: a[i] - a[i - 1]) AS d FROM m)"


@query("arr_hjorth", f"""WITH {S}, {DIFF}, e AS (SELECT *, list_transform(range(2, len(d) + 1), lambda i: d[i] - d[i - 1]) AS e FROM d),
v AS (SELECT vec_id, list_var_pop(a) AS va, list_var_pop(d) AS vd, list_var_pop(e) AS ve FROM e)
SELECT vec_id, round(va, 6) AS activity, round(sqrt(vd / va), 6) AS mobility, round(sqrt(ve / vd) / sqrt(vd / va), 6) AS complexity FROM v""")
def arr_hjorth(spark, sf):
    rows = samples(spark, sf).withColumn("d", A.diff(F.col("a"))).withColumn("e", A.diff(F.col("d")))
    rows = rows.withColumns({f"m{c}": A.mean(F.col(c)) for c in "ade"}).withColumns({f"v{c}": A.moment(F.col(c), F.col(f"m{c}"), 2) for c in "ade"})
    return rows.selectExpr("vec_id", "round(va, 6) AS activity", "round(sqrt(vd / va), 6) AS mobility", "round(sqrt(ve / vd) / sqrt(vd / va), 6) AS complexity")


@query("arr_shape", f"""WITH {S}, {DIFF} SELECT vec_id, CAST(list_sum(list_transform(range(2, len(a) + 1), lambda i: CAST((a[i] - m) * (a[i - 1] - m) < 0 AS INTEGER))) AS BIGINT) AS crossings, round(list_sum(list_transform(d, lambda x: abs(x))), 6) AS line_length,
 round(list_aggregate(a, 'quantile_cont', 0.75) - list_aggregate(a, 'quantile_cont', 0.25), 6) AS iqr, round(list_median(a), 6) AS median FROM d""")
def arr_shape(spark, sf):
    a = F.col("a")
    rows = samples(spark, sf).withColumn("m", A.mean(a))
    return rows.select("vec_id", A.zero_crossings(a, F.col("m")).cast("long").alias("crossings"), r6(A.line_length(a)).alias("line_length"), r6(A.percentile(a, 0.75) - A.percentile(a, 0.25)).alias("iqr"), r6(A.median(a)).alias("median"))


@query("arr_energy_cv", f"WITH {S}, e AS (SELECT vec_id, list_transform(range(0, 8), lambda k: list_sum(list_transform(a[k * 8 + 1 : k * 8 + 8], lambda x: x * x))) AS e FROM m) SELECT vec_id, round(list_stddev_pop(e) / list_avg(e), 6) AS energy_cv FROM e")
def arr_energy_cv(spark, sf):
    return samples(spark, sf).select("vec_id", r6(A.energy_cv(F.col("a"), 8)).alias("energy_cv"))


@query("arr_perm_entropy", f"""WITH {S}, c AS (SELECT vec_id, list_transform(range(1, len(a) - 1), lambda i: CAST(a[i] <= a[i + 1] AS INTEGER) * 4 + CAST(a[i] <= a[i + 2] AS INTEGER) * 2 + CAST(a[i + 1] <= a[i + 2] AS INTEGER)) AS c FROM m),
u AS (SELECT vec_id, unnest(c) AS c, len(c) AS n FROM c), k AS (SELECT vec_id, c, count(*) / any_value(n) AS p FROM u GROUP BY ALL) SELECT vec_id, round(-sum(p * log2(p)) / log2(6), 6) AS perm_entropy FROM k GROUP BY 1""")
def arr_perm_entropy(spark, sf):
    return samples(spark, sf).select("vec_id", r6(A.permutation_entropy(F.col("a"))).alias("perm_entropy"))


@query("arr_quality", f"""WITH {S} SELECT vec_id, round(len(list_filter(a, lambda x: abs(x) >= 0.05 AND abs(x) <= 200)) / n, 6) AS amp_share, list_stddev_pop(a) < 0.5 AS flat,
 CASE WHEN list_stddev_pop(a) < 1e-3 THEN 1e6 WHEN list_stddev_pop(a) < 1 THEN 1e3 ELSE 1e0 END AS unit_factor FROM m""")
def arr_quality(spark, sf):
    """Parts of the signal quality index and the unit that the deviation suggests."""
    a = F.col("a")
    rows = samples(spark, sf).withColumn("m", A.mean(a)).withColumn("sd", F.sqrt(A.moment(a, F.col("m"), 2)))
    good = F.size(F.filter(a, lambda x: F.abs(x).between(0.05, 200))) / F.size(a)
    return rows.select("vec_id", r6(good).alias("amp_share"), (F.col("sd") < 0.5).alias("flat"), F.when(F.col("sd") < 1e-3, 1e6).when(F.col("sd") < 1, 1e3).otherwise(1.0).alias("unit_factor"))


RR = f"WITH {EV}, r AS (SELECT pid, list(300 + value * 10 ORDER BY t, event_id) AS rr FROM ev GROUP BY pid)"


def rr(spark, sf):
    pairs = F.array_sort(F.collect_list(F.struct("t", "event_id", (300 + F.col("value") * 10).alias("v"))))
    return ev(spark, sf).groupBy("pid").agg(F.transform(pairs, lambda x: x["v"]).alias("rr"))


@query("rr_hrv_time", RR + """, d AS (SELECT *, list_transform(range(2, len(rr) + 1), lambda i: rr[i] - rr[i - 1]) AS d FROM r)
SELECT pid, CAST(len(rr) AS BIGINT) AS n, round(list_avg(rr), 6) AS mean_nn, round(list_stddev_samp(rr), 6) AS sdnn, round(sqrt(list_avg(list_transform(d, lambda x: x * x))), 6) AS rmssd, round(100e0 * len(list_filter(d, lambda x: abs(x) > 50)) / len(d), 6) AS pnn50,
 round(60000 / list_avg(rr), 6) AS hr_mean, round(list_stddev_samp(rr) / list_avg(rr), 6) AS cvnn FROM d WHERE len(rr) >= 10""")
def rr_hrv_time(spark, sf):
    r = F.col("rr")
    rows = rr(spark, sf).where("size(rr) >= 10").withColumn("d", A.diff(r)).withColumn("m", A.mean(r))
    sd = F.sqrt(A.moment(r, F.col("m"), 2) * F.size(r) / (F.size(r) - 1))
    return rows.select(
        "pid", F.size(r).cast("long").alias("n"), r6("m").alias("mean_nn"), r6(sd).alias("sdnn"), r6(A.rms(F.col("d"))).alias("rmssd"),
        r6(100.0 * F.size(F.filter("d", lambda x: F.abs(x) > 50)) / F.size("d")).alias("pnn50"), r6(60000 / F.col("m")).alias("hr_mean"), r6(sd / F.col("m")).alias("cvnn"),
    )


@query("rr_poincare", RR + """, d AS (SELECT *, list_var_samp(list_transform(range(2, len(rr) + 1), lambda i: rr[i] - rr[i - 1])) AS vd, list_var_samp(rr) AS vr FROM r WHERE len(rr) >= 10)
SELECT pid, round(sqrt(vd / 2), 6) AS sd1, round(sqrt(2 * vr - vd / 2), 6) AS sd2 FROM d""")
def rr_poincare(spark, sf):
    r = F.col("rr")
    rows = rr(spark, sf).where("size(rr) >= 10").withColumn("d", A.diff(r)).withColumn("m", A.mean(r)).withColumn("md", A.mean(F.col("d")))
    rows = rows.withColumn("vd", A.moment(F.col("d"), F.col("md"), 2) * F.size("d") / (F.size("d") - 1)).withColumn("vr", A.moment(r, F.col("m"), 2) * F.size(r) / (F.size(r) - 1))
    return rows.selectExpr("pid", "round(sqrt(vd / 2), 6) AS sd1", "round(sqrt(2 * vr - vd / 2), 6) AS sd2")


@query("rr_hrv_full", RR + """, d AS (SELECT pid, list_transform(rr, lambda x: CAST(x AS DOUBLE)) AS rr, list_transform(range(2, len(rr) + 1), lambda i: CAST(rr[i] - rr[i - 1] AS DOUBLE)) AS d, list_transform(rr, lambda x: 60000e0 / x) AS hr FROM r WHERE len(rr) >= 10),
h AS (SELECT pid, max(k) AS best FROM (SELECT pid, b, count(*) AS k FROM (SELECT pid, unnest(list_transform(rr, lambda x: least(floor((x - list_min(rr)) / 7.8125e0), greatest(1, ceil((list_max(rr) - list_min(rr) + 7.8125e0) / 7.8125e0) - 1) - 1))) AS b FROM d) GROUP BY ALL) GROUP BY pid)
SELECT d.pid, CAST(len(rr) AS BIGINT) AS n, round(list_avg(rr), 5) AS mean_nn, round(list_median(rr), 5) AS median_nn, round(list_stddev_samp(rr), 5) AS sdnn, round(sqrt(list_avg(list_transform(d, lambda x: x * x))), 5) AS rmssd, round(list_stddev_samp(d), 5) AS sdsd,
 round(100e0 * len(list_filter(d, lambda x: abs(x) > 50)) / len(d), 5) AS pnn50, round(100e0 * len(list_filter(d, lambda x: abs(x) > 20)) / len(d), 5) AS pnn20, round(list_stddev_samp(rr) / list_avg(rr), 5) AS cvnn, round(sqrt(list_avg(list_transform(d, lambda x: x * x))) / list_avg(rr), 5) AS cvsd,
 round(len(rr) / best, 5) AS hti, round(list_avg(hr), 5) AS hr_mean, round(list_stddev_pop(hr), 5) AS hr_std, round(list_min(hr), 5) AS hr_min, round(list_max(hr), 5) AS hr_max, round(list_max(hr) - list_min(hr), 5) AS hr_range, round(list_median(hr), 5) AS hr_median FROM d JOIN h ON d.pid = h.pid""")
def rr_hrv_full(spark, sf):
    """All measures in time, the triangular index and the heart rate's among them."""
    rows = rr(spark, sf).where("size(rr) >= 10").withColumn("rr", F.transform("rr", lambda x: x.cast("double")))
    return rows.select("pid", *[(c if n == "n" else F.round(c, 5)).alias(n) for n, c in cardiac.hrv_time(F.col("rr")).items()])


@query("rr_nonlinear", RR + """, d AS (SELECT *, list_var_samp(list_transform(range(2, len(rr) + 1), lambda i: rr[i] - rr[i - 1])) AS vd, list_var_samp(rr) AS vr FROM r WHERE len(rr) >= 10), s AS (SELECT pid, sqrt(vd / 2) AS a, CASE WHEN 2 * vr - vd / 2 >= 0 THEN sqrt(greatest(2 * vr - vd / 2, 0)) ELSE sqrt(vr) END AS b FROM d)
SELECT pid, round(a, 5) AS sd1, round(b, 5) AS sd2, round(CASE WHEN b > 0 THEN a / b END, 5) AS sd1_sd2, round(CASE WHEN a > 0 THEN b / a END, 5) AS csi, round(CASE WHEN a > 0 AND b > 0 THEN log10(a * b) END, 5) AS cvi FROM s""")
def rr_nonlinear(spark, sf):
    rows = rr(spark, sf).where("size(rr) >= 10").withColumn("rr", F.transform("rr", lambda x: x.cast("double")))
    return rows.select("pid", *[F.round(c, 5).alias(n) for n, c in cardiac.hrv_nonlinear(F.col("rr")).items()])


@query("breathing_channel", "WITH c AS (SELECT user_id % 50 AS patient_id, event_type AS channel, count(*) FILTER (value > 50) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY n DESC, channel) AS rn FROM c) SELECT patient_id, channel FROM r WHERE rn = 1 AND n > 0")
def breathing_channel(spark, sf):
    """The channel of each recording with most segments that have data."""
    rows = t(spark, sf, "events").select((F.col("user_id") % 50).alias("patient_id"), F.col("event_type").alias("channel"), F.when(F.col("value") > 50, F.lit(1)).alias("data"))
    return cardiac.breathing_channel(rows)


@query("rr_artifacts", RR + """, g AS (SELECT pid, rr, coalesce(list_median(list_filter(rr, lambda x: x >= 300 AND x <= 2000)), 800) AS md FROM r), v AS (SELECT pid, list_transform(rr, lambda x: x >= 300 AND x <= 2000 AND abs(x - md) / md < 0.2) AS ok FROM g)
SELECT pid, CAST(len(list_filter(ok, lambda x: x)) AS BIGINT) AS n_valid, round(100e0 * len(list_filter(ok, lambda x: NOT x)) / len(ok), 6) AS artifact_pct,
 CAST(list_max(list_transform(string_split(list_reduce(list_transform(ok, lambda x: CASE WHEN x THEN '1' ELSE '0' END), lambda p, q: p || q), '0'), lambda s: len(s))) AS BIGINT) AS longest_clean FROM v""")
def rr_artifacts(spark, sf):
    inside = F.filter("rr", lambda x: x.between(300, 2000))
    rows = rr(spark, sf).withColumn("md", F.coalesce(A.median(inside), F.lit(800.0)))
    rows = rows.withColumn("ok", F.transform("rr", lambda x: x.between(300, 2000) & (F.abs(x - F.col("md")) / F.col("md") < 0.2)))
    bad = F.size(F.filter("ok", lambda x: ~x))
    return rows.select("pid", F.size(F.filter("ok", lambda x: x)).cast("long").alias("n_valid"), r6(100.0 * bad / F.size("ok")).alias("artifact_pct"), A.longest_true(F.col("ok")).cast("long").alias("longest_clean"))


@query("peak_thinning", f"WITH RECURSIVE {EV}, n AS (SELECT pid, count(*) AS n, min(t) AS first FROM ev GROUP BY pid), k AS (SELECT pid, first AS t FROM n UNION ALL SELECT k.pid, (SELECT min(e.t) FROM ev e WHERE e.pid = k.pid AND e.t - k.t >= 14400) AS t FROM k WHERE k.t IS NOT NULL) SELECT n.pid, CAST(n AS INTEGER) AS n, CAST(count(k.t) AS INTEGER) AS n_kept FROM n JOIN k ON k.pid = n.pid GROUP BY n.pid, n")
def peak_thinning(spark, sf):
    """Greedy thinning: whether a peak stays depends on the last one kept, so a fold and not a window."""
    at = F.array_sort(F.collect_list("t"))
    rows = ev(spark, sf).groupBy("pid").agg(at.alias("at"))
    return rows.select("pid", F.size("at").alias("n"), F.size(A.thin_peaks(F.col("at"), 14_400.0)).alias("n_kept"))


def _kernel(name):
    def run(spark, sf):
        schema = spectral.SCHEMAS[name]
        udf = spectral.arrow_kernel(name, fs=64.0)
        out = samples(spark, sf).select("vec_id", udf(F.col("a").cast(T.ArrayType(T.FloatType()))).alias("x"))
        return out.select("vec_id", *[r6(f"x.{c}").alias(c) for c in schema])

    run.__name__ = name
    return run


#: The spectrum of 64 samples at 64 Hz: one Hann window, p[k + 1] is the density at k Hz.
PSD = """s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)) AS a FROM embeddings), c AS (SELECT vec_id, list_transform(range(0, 64), lambda n: (a[n + 1] - list_avg(a)) * (0.5 - 0.5 * cos(2 * pi() * n / 64))) AS w FROM s),
psd AS (SELECT vec_id, list_transform(range(0, 33), lambda k: (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) * (pow(list_sum(list_transform(range(0, 64), lambda n: w[n + 1] * cos(2 * pi() * k * n / 64))), 2) + pow(list_sum(list_transform(range(0, 64), lambda n: w[n + 1] * sin(2 * pi() * k * n / 64))), 2)) / (64 * 24e0)) AS p FROM c)"""


def _power(low: int, high: int) -> str:
    """Trapezoid rule from ``low`` to ``high`` Hz."""
    return f"(list_sum(p[{low + 1}:{high + 1}]) - (p[{low + 1}] + p[{high + 1}]) / 2)"


_EDGES = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 12), "sigma": (12, 16), "beta": (16, 30)}
_B = {b: _power(*e) for b, e in _EDGES.items()}
_SIZES = ", ".join(str(n) for n in sorted({int(4 * 4 ** (i / 19) + 1e-9) for i in range(20)}))
_LISTS = "s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)) AS a FROM embeddings)"

_SQL = {
    "psd_bandpower": f"WITH {PSD} SELECT vec_id, " + ", ".join(f"round({v}, 6) AS {b}_abs, round({v} / {_power(1, 32)}, 6) AS {b}_rel" for b, v in _B.items())
    + f", round({_power(1, 32)}, 6) AS total, CAST(list_position(p[2:33], list_max(p[2:33])) AS DOUBLE) AS peak_hz, round(list_sum(list_transform(range(1, 33), lambda k: k * p[k + 1])) / list_sum(p[2:33]), 6) AS centroid FROM psd",
    "spectral_entropy_sef": f"WITH {PSD}, q AS (SELECT vec_id, p[2:33] AS p, list_sum(p[2:33]) AS t FROM psd), e AS (SELECT *, list_transform(range(1, 33), lambda k: list_sum(p[1:k]) - (p[1] + p[k]) / 2) AS cum FROM q) SELECT vec_id, round(-list_sum(list_transform(p, lambda x: x / t * log2(x / t))) / log2(32), 6) AS entropy, "
    + ", ".join(f"CAST(list_filter(range(1, 33), lambda k: cum[k] >= {q} * cum[32])[1] AS DOUBLE) AS sef{n}" for q, n in ((0.5, 50), (0.95, 95))) + " FROM e",
    "sleep_bands": f"""WITH {PSD} SELECT vec_id, round({_power(1, 2)}, 6) AS swa_power, round(log10({_power(1, 2)} + 1e-10), 6) AS swa_power_log, round({_power(12, 14)}, 6) AS slow_spindle_power, round({_power(14, 16)}, 6) AS fast_spindle_power, round({_B['sigma']}, 6) AS spindle_power_total,
 round({_B['sigma']} / (({_B['theta']} + {_B['beta']}) / 2), 6) AS spindle_prominence, round({_B['alpha']} / {_B['theta']}, 6) AS alpha_theta_ratio, round({_B['theta']} / {_B['alpha']}, 6) AS theta_alpha_ratio, round({_B['delta']} / {_B['alpha']}, 6) AS delta_alpha_ratio, round({_B['delta']} / {_B['beta']}, 6) AS delta_beta_ratio,
 round(({_B['delta']} + {_B['theta']}) / ({_B['alpha']} + {_B['beta']}), 6) AS slowing_ratio, round({_B['delta']} / ({_B['alpha']} + 1e-10), 6) AS dar, round(({_B['delta']} + {_B['theta']}) / ({_B['alpha']} + {_B['beta']}), 6) AS dtabr FROM psd""",
    "sample_entropy": f"""WITH {_LISTS}, x AS (SELECT vec_id, a, 0.2 * list_stddev_pop(a) AS r FROM s), q AS (SELECT vec_id, count(*) AS b, count(*) FILTER (abs(a[i + 2] - a[j + 2]) < r) AS c FROM x, range(1, 63) u(i), range(1, 63) v(j) WHERE i < j AND abs(a[i] - a[j]) < r AND abs(a[i + 1] - a[j + 1]) < r GROUP BY vec_id)
SELECT x.vec_id, CASE WHEN b > 0 AND c > 0 THEN round(-ln(c / b), 6) END AS sample_entropy FROM x LEFT JOIN q ON q.vec_id = x.vec_id""",
    "approximate_entropy": f"""WITH {_LISTS}, x AS (SELECT vec_id, a, 0.2 * list_stddev_pop(a) AS r FROM s), p2 AS (SELECT vec_id, i, count(*) / 63 AS f FROM x, range(1, 64) u(i), range(1, 64) v(j) WHERE abs(a[i] - a[j]) <= r AND abs(a[i + 1] - a[j + 1]) <= r GROUP BY ALL),
p3 AS (SELECT vec_id, i, count(*) / 62 AS f FROM x, range(1, 63) u(i), range(1, 63) v(j) WHERE abs(a[i] - a[j]) <= r AND abs(a[i + 1] - a[j + 1]) <= r AND abs(a[i + 2] - a[j + 2]) <= r GROUP BY ALL), m2 AS (SELECT vec_id, avg(ln(f)) AS m FROM p2 GROUP BY 1), m3 AS (SELECT vec_id, avg(ln(f)) AS m FROM p3 GROUP BY 1)
SELECT vec_id, round(m2.m - m3.m, 6) AS approx_entropy FROM m2 JOIN m3 USING (vec_id)""",
    "higuchi": f"""WITH {_LISTS}, l AS (SELECT vec_id, k, m, list_transform(range(1, CAST((63 - m) // k AS BIGINT) + 1), lambda i: abs(a[m + i * k + 1] - a[m + (i - 1) * k + 1])) AS d FROM s, range(1, 11) u(k), range(0, 10) v(m) WHERE m < k),
o AS (SELECT vec_id, k, avg(list_sum(d) * 63e0 / (len(d) * k) / k) AS l FROM l WHERE len(d) > 0 GROUP BY ALL) SELECT vec_id, round(regr_slope(ln(l), ln(1e0 / k)), 6) AS higuchi_fd FROM o WHERE l > 0 GROUP BY vec_id""",
    "dfa": f"""WITH {_LISTS}, y AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(list_transform(range(1, 65), lambda k: list_sum(list_transform(a[1:k], lambda x: x - list_avg(a))))) AS y FROM s), z AS (SELECT unnest([{_SIZES}]) AS n),
b AS (SELECT vec_id, n, i // n AS box, sqrt(greatest((regr_syy(y, i) - CASE WHEN regr_sxx(y, i) > 0 THEN pow(regr_sxy(y, i), 2) / regr_sxx(y, i) ELSE 0 END) / n, 0)) AS e FROM y, z WHERE i < 64 // n * n GROUP BY vec_id, n, i // n), m AS (SELECT vec_id, n, avg(e) AS e FROM b GROUP BY ALL)
SELECT vec_id, CASE WHEN count(*) FILTER (e > 0) >= 4 THEN round(regr_slope(ln(e), ln(n)) FILTER (e > 0), 6) END AS dfa FROM m GROUP BY vec_id""",
}

for _name in spectral.SCHEMAS:
    query(_name, _SQL.get(_name))(_kernel(_name))
