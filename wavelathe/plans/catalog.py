"""The registered queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import functionals as fn
from ..functions import scales, spectral, vectors
from ..operators import kernels, models, segments, windows
from ..series import Series, of_level, seconds

USER = of_level("user_id")
_QUERIES: dict = {}
_SQL: dict = {}


def r6(c):
    """Six decimals, and no negative zero; the shift keeps decimal ties off the rounding's edge."""
    return F.round(c + F.lit(1e-10), 6) + F.lit(0.0)


def nine(c):
    """r6, but numbers from a million on, of whose decimals a double's sum holds too few, by their first nine digits."""
    big = F.abs(c) >= 1e6
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.when(big, F.abs(c)))))
    return F.when(big, F.round(c / power, 8) * power).otherwise(r6(c))


def r_of(name: str, c):
    return nine(c) if name.endswith("variance") else r6(c)


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark, d) -> DataFrame:
    return Series(("user_id",), ("ts", "event_id")).level(table(spark, d, "events"), {"x": "value", "kind": "event_type"}, seconds("ts"))


def orders(spark, d) -> DataFrame:
    return Series(("o_custkey",), ("o_orderdate", "o_orderkey")).level(table(spark, d, "orders"), {"x": "o_totalprice"})


def items(spark, d) -> DataFrame:
    s = Series(("l_partkey",), ("l_shipdate", "l_orderkey", "l_linenumber"))
    return s.level(table(spark, d, "lineitem"), {"x": "l_discount", "q": "l_quantity", "flag": "l_returnflag"})


def frames(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


_E = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS vidx, epoch_us(ts) / 1e6 AS t, value AS x, event_type AS kind FROM events)"
_O = "e AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS vidx, o_totalprice AS x FROM orders)"
_L = "e AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS vidx, l_discount AS x, l_quantity AS q, l_returnflag AS flag FROM lineitem)"
_V = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, len(embedding) AS n FROM embeddings)"
_R = "CAST(0 AS DOUBLE)"


def s6(e: str) -> str:
    return f"round({e} + CAST(1e-10 AS DOUBLE), 6) + {_R}"


def s9(e: str) -> str:
    power = f"pow(CAST(10 AS DOUBLE), floor(log10(abs({e}))))"
    return f"CASE WHEN abs({e}) >= 1e6 THEN round(({e}) / {power}, 8) * {power} ELSE {s6(e)} END"


def s_of(name: str, e: str) -> str:
    return s9(e) if name.endswith("variance") else s6(e)


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _pad(k: str, x: str, by: int) -> str:
    w = f"(PARTITION BY {k} ORDER BY vidx)"
    full = f"(PARTITION BY {k} ORDER BY vidx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    if by == 0:
        return x
    return f"coalesce(lag({x}, {-by}) OVER {w}, first_value({x}) OVER {full})" if by < 0 else f"coalesce(lead({x}, {by}) OVER {w}, last_value({x}) OVER {full})"


def _windowed(name: str, level, head: str, key: str, column, sql: str):
    """A query keys, vidx, y of one window expression."""

    def run(spark, d):
        return level(spark, d).select(key, "vidx", r6(column(of_level(key))).alias("y"))

    query(name, f"WITH {head} SELECT {key}, vidx, {s6(sql)} AS y FROM e")(run)


_p = partial(_pad, "user_id", "x")
_sma = f"({_p(-1)} + x + {_p(1)}) / 3"
_delta = f"(({_p(1)} - {_p(-1)}) + 2 * ({_p(2)} - {_p(-2)})) / 10"
_w = "OVER (PARTITION BY user_id ORDER BY vidx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_windowed("sma_events", events, _E, "user_id", lambda s: windows.sma(s, "x"), _sma)
_windowed("delta_events", events, _E, "user_id", lambda s: windows.delta(s, "x"), _delta)
_windowed("delta_first_difference_events", events, _E, "user_id", lambda s: windows.delta(s, "x", 0), f"x - {_p(-1)}")
_windowed("delta_half_wave_events", events, _E, "user_id", lambda s: windows.delta(s, "x", half_wave=True), f"greatest({_delta}, 0)")
_windowed("delta_relative_events", events, _E, "user_id", lambda s: windows.delta(s, "x", relative=True, absolute=True), f"abs(CASE WHEN x = 0 THEN 0 ELSE ({_delta}) / x END)")
_windowed("preemphasis_events", events, _E, "user_id", lambda s: windows.preemphasis(s, "x"), f"x - 0.97 * {_p(-1)}")
_windowed("median_events", events, _E, "user_id", lambda s: windows.running_median(s, "x", 5), "median(x) OVER (PARTITION BY user_id ORDER BY vidx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
_windowed("mvn_running_events", events, _E, "user_id", lambda s: windows.mvn(s, "x", "running"), f"(x - avg(x) {_w}) / greatest(stddev_pop(x) {_w}, 1e-7)")
_b = "OVER (PARTITION BY user_id ORDER BY vidx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_windowed("mvn_buffer_events", events, _E, "user_id", lambda s: windows.mvn(s, "x", "buffer", 20), f"(x - avg(x) {_b}) / greatest(stddev_pop(x) {_b}, 1e-7)")
_c = "OVER (PARTITION BY o_custkey)"
_windowed("mean_norm_orders", orders, _O, "o_custkey", lambda s: windows.mean_norm(s, "x"), f"x - avg(x) {_c}")
_windowed("rms_mean_norm_orders", orders, _O, "o_custkey", lambda s: windows.mean_norm(s, "x", "rqmean", clip=True), f"greatest(x - sqrt(avg(x * x) {_c}), 0)")
_windowed("znorm_orders", orders, _O, "o_custkey", lambda s: windows.mvn(s, "x"), f"(x - avg(x) {_c}) / greatest(stddev_pop(x) {_c}, 1e-7)")
_windowed("minmax_orders", orders, _O, "o_custkey", lambda s: windows.range_norm(s, "x", -1.0, 1.0), f"CASE WHEN max(x) {_c} = min(x) {_c} THEN -1 ELSE -1 + 2 * (x - min(x) {_c}) / (max(x) {_c} - min(x) {_c}) END")
_windowed("log_energy_norm_orders", orders, _O, "o_custkey", lambda s: windows.log_energy_norm(s, "x"), f"x - max(x) {_c} + 1")
_l = partial(_pad, "l_partkey", "x")
_nz = " + ".join(f"CASE WHEN {_l(k)} <> 0 THEN 1 ELSE 0 END" for k in (-1, 0, 1))
_windowed("sma_nonzero_lineitem", items, _L, "l_partkey", lambda s: windows.sma(s, "x", 3, True), f"CASE WHEN x = 0 THEN 0 ELSE ({_l(-1)} + x + {_l(1)}) / ({_nz}) END")
_windowed("mean_norm_nonzero_lineitem", items, _L, "l_partkey", lambda s: windows.mean_norm(s, "x", exclude_zeros=True), "x - coalesce(avg(CASE WHEN x <> 0 THEN x END) OVER (PARTITION BY l_partkey), 0)")
_ds = [(i, _l(i), _l(-i)) for i in (1, 2)]
_num = " + ".join(f"CASE WHEN {a} <> 0 AND {b} <> 0 THEN {i} * ({a} - {b}) ELSE 0 END" for i, a, b in _ds)
_den = " + ".join(f"CASE WHEN {a} <> 0 AND {b} <> 0 THEN {2 * i * i} ELSE 0 END" for i, a, b in _ds)
_windowed("delta_in_segments_lineitem", items, _L, "l_partkey", lambda s: windows.delta(s, "x", in_segments=True), f"CASE WHEN x = 0 THEN 0 ELSE coalesce(({_num}) / nullif({_den}, 0), 0) END")
_windowed("pitch_direction_events", events, _E, "user_id", lambda s: windows.pitch_direction(s, "x").cast("double"), "CASE WHEN a > b * 1.02 THEN 1 WHEN a < b * 0.98 THEN -1 ELSE 0 END")
_SQL["pitch_direction_events"] = f"WITH {_E}, m AS (SELECT user_id, vidx, avg(CASE WHEN x > 0 THEN x END) OVER (PARTITION BY user_id ORDER BY vidx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a, avg(CASE WHEN x > 0 THEN x END) OVER (PARTITION BY user_id ORDER BY vidx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS b FROM e) SELECT user_id, vidx, CAST(CASE WHEN a > b * 1.02 THEN 1 WHEN a < b * 0.98 THEN -1 ELSE 0 END AS DOUBLE) AS y FROM m"


@query("valsel_adaptive_events", f"WITH {_E}, m AS (SELECT *, avg(x) OVER (PARTITION BY user_id ORDER BY vidx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS level FROM e) SELECT user_id, vidx, {s6('x')} AS x FROM m WHERE m.x > level")
def _(spark, d):
    e = events(spark, d)
    return e.withColumn("keep", windows.above(USER, "x", adaptive=10)).where("keep").select("user_id", "vidx", r6(F.col("x")).alias("x"))


@query("valsel_zeroed_lineitem", f"WITH {_L} SELECT l_partkey, vidx, {s6('CASE WHEN x >= 0.05 THEN x ELSE 0 END')} AS x FROM e")
def _(spark, d):
    e = items(spark, d)
    keep = windows.above(of_level("l_partkey"), "x", 0.05, allow_equal=True)
    return e.select("l_partkey", "vidx", r6(F.when(keep, F.col("x")).otherwise(0.0)).alias("x"))


# Functionals: the same shared columns in SQL, and each set's formulas.
_SQL_SETS = {
    "extremes": {"max": "max(x)", "min": "min(x)", "range": "max(x) - min(x)", "maxpos": "min(CASE WHEN x = hi THEN i END) / max(n)", "minpos": "min(CASE WHEN x = lo THEN i END) / max(n)", "amean": "avg(x)", "maxameandist": "max(x) - avg(x)", "minameandist": "avg(x) - min(x)"},
    "means": {
        "absmean": "avg(abs(x))", "qmean": "avg(x * x)", "nzamean": "coalesce(avg(x) FILTER (x <> 0), 0)", "nzabsmean": "coalesce(avg(abs(x)) FILTER (x <> 0), 0)", "nzqmean": "coalesce(avg(x * x) FILTER (x <> 0), 0)",
        "nzgmean": "coalesce(exp(avg(ln(abs(nullif(x, 0))))), 0)", "nnz": "count(*) FILTER (x <> 0)", "flatness": "CASE WHEN avg(abs(x)) = 0 THEN 1 ELSE coalesce(exp(avg(ln(abs(nullif(x, 0))))), 0) / avg(abs(x)) END",
        "posamean": "coalesce(avg(x) FILTER (x > 0), 0)", "negamean": "coalesce(avg(x) FILTER (x < 0), 0)", "posqmean": "coalesce(avg(x * x) FILTER (x > 0), 0)", "posrqmean": "sqrt(coalesce(avg(x * x) FILTER (x > 0), 0))",
        "negqmean": "coalesce(avg(x * x) FILTER (x < 0), 0)", "negrqmean": "sqrt(coalesce(avg(x * x) FILTER (x < 0), 0))", "rqmean": "sqrt(avg(x * x))", "nzrqmean": "sqrt(coalesce(avg(x * x) FILTER (x <> 0), 0))",
    },
    "moments": {
        "variance": "avg((x - mu) ** 2)", "stddev": "sqrt(avg((x - mu) ** 2))", "skewness": "CASE WHEN avg((x - mu) ** 2) > 1e-12 THEN avg((x - mu) ** 3) / avg((x - mu) ** 2) ** 1.5 ELSE 0 END",
        "kurtosis": "CASE WHEN avg((x - mu) ** 2) > 1e-12 THEN avg((x - mu) ** 4) / avg((x - mu) ** 2) ** 2 ELSE 0 END", "stddevnorm": "CASE WHEN avg(x) <> 0 THEN sqrt(avg((x - mu) ** 2)) / avg(x) ELSE 0 END",
    },
    "percentiles": {
        "quartile1": "quantile_cont(x, 0.25)", "quartile2": "quantile_cont(x, 0.5)", "quartile3": "quantile_cont(x, 0.75)", "iqr12": "abs(quantile_cont(x, 0.5) - quantile_cont(x, 0.25))", "iqr23": "abs(quantile_cont(x, 0.75) - quantile_cont(x, 0.5))",
        "iqr13": "abs(quantile_cont(x, 0.75) - quantile_cont(x, 0.25))", **{f"iqq{k}": f"CASE WHEN quantile_cont(x, {b}) <> 0 THEN quantile_cont(x, {a}) / quantile_cont(x, {b}) ELSE 0 END" for k, a, b in (("12", 0.25, 0.5), ("23", 0.5, 0.75), ("13", 0.25, 0.75))}, "percentile5": "quantile_cont(x, 0.05)", "percentile95": "quantile_cont(x, 0.95)", "pctlrange0_1": "abs(quantile_cont(x, 0.95) - quantile_cont(x, 0.05))",
        "pctlquotient0_1": "CASE WHEN quantile_cont(x, 0.95) <> 0 THEN quantile_cont(x, 0.05) / quantile_cont(x, 0.95) ELSE 0 END",
    },
    "crossings": {
        "zcr": "sum(CASE WHEN i >= 1 AND i <= n - 2 AND (was * x < 0 OR (x = 0 AND was <> 0)) THEN 1 ELSE 0 END) / max(n)",
        "mcr": "sum(CASE WHEN i >= 1 AND i <= n - 2 AND ((was - mu) * (x - mu) < 0 OR (x - mu = 0 AND was - mu <> 0)) THEN 1 ELSE 0 END) / max(n)",
    },
    "samples": {f"samplepos{k}": f"max(CASE WHEN i = floor((n - 1) * {p}) THEN x END)" for k, p in enumerate((0.0, 0.25, 0.5, 0.75, 1.0))},
    "times": {
        **{f"upleveltime{p}": f"sum(CASE WHEN x > lo + {p / 100} * (hi - lo) THEN 1 ELSE 0 END) / max(n)" for p in (25, 50, 75, 90)},
        **{f"downleveltime{p}": f"sum(CASE WHEN x <= lo + {p / 100} * (hi - lo) THEN 1 ELSE 0 END) / max(n)" for p in (25, 50, 75, 90)},
        "risetime": "sum(CASE WHEN was < x THEN 1 ELSE 0 END) / greatest(max(n) - 1, 1)", "falltime": "sum(CASE WHEN was > x THEN 1 ELSE 0 END) / greatest(max(n) - 1, 1)",
        "leftctime": "sum(CASE WHEN will - 2 * x + was < 0 THEN 1 ELSE 0 END) / greatest(max(n) - 2, 1)", "rightctime": "sum(CASE WHEN will - 2 * x + was > 0 THEN 1 ELSE 0 END) / greatest(max(n) - 2, 1)", "duration": "max(n)",
    },
    "dct": {f"dct{k}": f"sum(sqrt(2.0 / n) * x * cos(pi() * {k} * (i + 0.5) / n))" for k in range(1, 7)},
    "onset": {
        "onsetpos": "coalesce(min(CASE WHEN abs(x) > 0 AND coalesce(abs(was), 0) <= 0 THEN i END), 0) / max(n)", "offsetpos": "coalesce(max(CASE WHEN abs(x) <= 0 AND abs(was) > 0 THEN i END), 0) / max(n)",
        "numonsets": "count(*) FILTER (abs(x) > 0 AND coalesce(abs(was), 0) <= 0)", "numoffsets": "count(*) FILTER (abs(x) <= 0 AND abs(was) > 0)", "onsetrate": "count(*) FILTER (abs(x) > 0 AND coalesce(abs(was), 0) <= 0) / max(n)",
    },
    "segments": {"numsegments": "count(*) FILTER (was IS NULL OR was <> x)", "meanseglen": "1 / count(*) FILTER (was IS NULL OR was <> x)"},
}


def _functional_sql(head: str, keys: str, order: str, name: str, source: str = "e") -> str:
    w = f"(PARTITION BY {keys})"
    o = f"(PARTITION BY {keys} ORDER BY {order})"
    prep = f"b AS (SELECT {keys}, x, CAST(row_number() OVER {o} - 1 AS DOUBLE) AS i, CAST(count(*) OVER {w} AS DOUBLE) AS n, min(x) OVER {w} AS lo, max(x) OVER {w} AS hi, avg(x) OVER {w} AS mu, lag(x) OVER {o} AS was, lead(x) OVER {o} AS will FROM {source})"
    cols = ", ".join(f"{s_of(c, f'CAST({e} AS DOUBLE)')} AS x_{c}" for c, e in _SQL_SETS[name].items())
    return f"WITH {head}, {prep} SELECT {keys}, {cols} FROM b GROUP BY {keys}"


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[r_of(c, F.col(c)).alias(c) for c in df.columns if c not in keys])


for _name, _table, _level, _head, _key, _args in (
    ("extremes", "events", events, _E, "user_id", {}), ("means", "lineitem", items, _L, "l_partkey", {}), ("moments", "orders", orders, _O, "o_custkey", {}),
    ("percentiles", "lineitem", items, _L, "l_partkey", {}), ("crossings", "events", events, _E, "user_id", {}), ("samples", "events", events, _E, "user_id", {}),
    ("times", "events", events, _E, "user_id", {}), ("dct", "orders", orders, _O, "o_custkey", {}), ("onset", "lineitem", items, _L, "l_partkey", {}), ("segments", "lineitem", items, _L, "l_partkey", {}),
):

    def _run(spark, d, name=_name, level=_level, key=_key, args=_args):
        return _rounded(fn.functionals(level(spark, d), [key], ["vidx"], "x", {name: args}), [key])

    query(f"func_{_name}_{_table}", _functional_sql(_head, _key, "vidx", _name))(_run)


@query(
    "func_regression_events",
    f"""WITH {_E}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e), f AS (SELECT user_id, regr_slope(x, vidx) AS s, regr_intercept(x, vidx) AS o FROM e GROUP BY user_id)
    SELECT user_id, {s6('max(s)')} AS x_linregc1, {s6('max(o)')} AS x_linregc2, {s6('avg(abs(x - s * vidx - o))')} AS x_linregerra, {s6('avg((x - s * vidx - o) ** 2)')} AS x_linregerrq,
           {s6('sum(abs(x) * vidx) / sum(abs(x)) / max(n)')} AS x_centroid FROM n JOIN f USING (user_id) GROUP BY user_id""",
)
def _(spark, d):
    out = fn.functionals(events(spark, d), ["user_id"], ["vidx"], "x", ["regression"])
    return _rounded(out.select("user_id", "x_linregc1", "x_linregc2", "x_linregerra", "x_linregerrq", "x_centroid"), ["user_id"])


_SQL["func_parabola_events"] = f"""WITH {_E}, m AS (SELECT user_id, vidx, x, vidx - avg(vidx) OVER (PARTITION BY user_id) AS t FROM e),
    k AS (SELECT user_id, count(*) AS n, sum(t * t) AS s2, sum(t ** 4) AS s4, sum(x) AS y0, sum(t * x) AS y1, sum(t * t * x) AS y2, min(vidx - t) AS c FROM m GROUP BY user_id),
    p AS (SELECT user_id, c, (n * y2 - s2 * y0) / (n * s4 - s2 * s2) AS a, y1 / s2 AS b, (s4 * y0 - s2 * y2) / (n * s4 - s2 * s2) AS g FROM k)
    SELECT user_id, {s6('any_value(a)')} AS x_qregc1, {s6('any_value(b - 2 * a * c)')} AS x_qregc2, {s6('any_value(a * c * c - b * c + g)')} AS x_qregc3, {s6('avg((x - a * t * t - b * t - g) ** 2)')} AS x_qregerrq FROM m JOIN p USING (user_id) GROUP BY user_id"""


@query("func_parabola_events")
def _(spark, d):
    out = fn.functionals(events(spark, d), ["user_id"], ["vidx"], "x", ["regression"])
    return _rounded(out.select("user_id", "x_qregc1", "x_qregc2", "x_qregc3", "x_qregerrq"), ["user_id"])


@query("func_nonzero_lineitem", _functional_sql(_L + ", z AS (SELECT * FROM e WHERE x > 0)", "l_partkey", "vidx", "extremes", "z"))
def _(spark, d):
    return _rounded(fn.functionals(items(spark, d), ["l_partkey"], ["vidx"], "x", ["extremes"], nonzero=2), ["l_partkey"])


# Segments.
@query("win_fixed_events", _functional_sql(f"{_E}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS m FROM e), g AS (SELECT user_id, vidx, x, unnest(range(CAST(greatest(0, ceil((vidx - 9) / 5.0)) AS BIGINT), CAST(least(floor(vidx / 5.0), floor((m - 10) / 5.0)) AS BIGINT) + 1)) AS segment FROM c)", "user_id, segment", "vidx", "extremes", "g"))
def _(spark, d):
    cut = segments.fixed(events(spark, d), USER, 10, 5)
    return _rounded(fn.functionals(cut, ["user_id", "segment"], ["vidx"], "x", ["extremes"]), ["user_id", "segment"])


@query("win_list_events", _functional_sql(f"{_E}, g AS (SELECT user_id, vidx, x, CAST(k AS BIGINT) AS segment FROM e JOIN (VALUES (0, 0, 9), (1, 5, 24), (2, 40, 59)) s(k, a, b) ON vidx BETWEEN a AND b)", "user_id, segment", "vidx", "moments", "g"))
def _(spark, d):
    cut = segments.listed(events(spark, d), segments.parse_list("0-9,5-24,40-59", 0.01))
    return _rounded(fn.functionals(cut, ["user_id", "segment"], ["vidx"], "x", ["moments"]), ["user_id", "segment"])


_RUN = "{h}, d AS (SELECT *, CASE WHEN lag({c}) OVER (PARTITION BY {k} ORDER BY vidx) IS NULL OR lag({c}) OVER (PARTITION BY {k} ORDER BY vidx) <> {c} THEN 1 ELSE 0 END AS new FROM e), g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY {k} ORDER BY vidx) - 1 AS BIGINT) AS segment FROM d)"


@query("win_meta_events", _functional_sql(_RUN.format(h=_E, c="kind", k="user_id"), "user_id, segment", "vidx", "extremes", "g"))
def _(spark, d):
    cut = segments.runs(events(spark, d), USER, "kind")
    return _rounded(fn.functionals(cut, ["user_id", "segment"], ["vidx"], "x", ["extremes"]), ["user_id", "segment"])


@query("run_lengths_lineitem", f"WITH {_RUN.format(h=_L, c='flag', k='l_partkey')}, n AS (SELECT l_partkey, segment, any_value(flag) AS flag, count(*) AS n FROM g GROUP BY 1, 2) SELECT l_partkey, flag, count(*) AS segments, max(n) AS longest FROM n GROUP BY 1, 2")
def _(spark, d):
    cut = segments.runs(items(spark, d), of_level("l_partkey"), "flag")
    n = cut.groupBy("l_partkey", "segment").agg(F.first("flag").alias("flag"), F.count(F.lit(1)).alias("n"))
    return n.groupBy("l_partkey", "flag").agg(F.count(F.lit(1)).alias("segments"), F.max("n").alias("longest"))


@query("sessions_events", f"WITH {_E}, d AS (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY user_id ORDER BY vidx) IS NULL OR t - lag(t) OVER (PARTITION BY user_id ORDER BY vidx) > 43200 THEN 1 ELSE 0 END AS new FROM e), g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY vidx) - 1 AS BIGINT) AS segment FROM d) SELECT user_id, segment, count(*) AS n, {s6('max(t) - min(t)')} AS length_sec FROM g GROUP BY 1, 2")
def _(spark, d):
    cut = segments.sessions(events(spark, d), USER, "time", 43200.0)
    return cut.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), r6(F.max("time") - F.min("time")).alias("length_sec"))


@query("role_runs_conversations", "WITH e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS vidx, role FROM conversations), d AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY vidx) IS NULL OR lag(role) OVER (PARTITION BY conv_id ORDER BY vidx) <> role THEN 1 ELSE 0 END AS new FROM e) SELECT conv_id, CAST(sum(new) AS BIGINT) AS runs, count(*) AS turns FROM d GROUP BY 1")
def _(spark, d):
    s = Series(("conv_id",), ("turn", "role", "text"))
    cut = segments.runs(s.level(table(spark, d, "conversations"), {"role": "role"}), of_level("conv_id"), "role")
    return cut.groupBy("conv_id").agg((F.max("segment") + 1).alias("runs"), F.count(F.lit(1)).alias("turns"))


@query("level_join_events", f"WITH {_E}, s AS (SELECT user_id, vidx, x, {_sma} AS y FROM e) SELECT user_id, vidx, {s6('x')} AS x, {s6('y')} AS x_sma, {s6(_delta.replace('x,', 'y,').replace('(x)', '(y)'))} AS x_sma_de FROM s")
def _(spark, d):
    e = events(spark, d)
    sma = e.select("user_id", "vidx", windows.sma(USER, "x").alias("x_sma"))
    de = sma.select("user_id", "vidx", windows.delta(USER, "x_sma").alias("x_sma_de"))
    out = segments.join_levels(("user_id",), e.select("user_id", "vidx", "time", "x"), sma, de)
    return out.select("user_id", "vidx", r6(F.col("x")).alias("x"), r6(F.col("x_sma")).alias("x_sma"), r6(F.col("x_sma_de")).alias("x_sma_de"))


@query("interval_join_events", f"WITH {_E}, t AS (SELECT user_id, floor(vidx / 7) AS segment, min(vidx) AS start, min(vidx) + 3 AS stop FROM e WHERE vidx % 7 = 2 GROUP BY 1, 2) SELECT e.user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, {s6('sum(x)')} AS total FROM e JOIN t ON e.user_id = t.user_id AND vidx BETWEEN start AND stop GROUP BY 1, 2")
def _(spark, d):
    e = events(spark, d)
    t = e.where("vidx % 7 = 2").select("user_id", F.floor(F.col("vidx") / 7).alias("segment"), F.col("vidx").alias("start"), (F.col("vidx") + 3).alias("stop"))
    return segments.interval_join(e, t, USER).groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("x")).alias("total"))


@query("framer_events", f"WITH {_E}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS m FROM e) SELECT user_id, CAST(vidx // 8 AS BIGINT) AS segment, {s6('sqrt(avg(x * x))')} AS rms FROM c WHERE vidx // 8 < m // 8 GROUP BY 1, 2")
def _(spark, d):
    f = segments.frames(events(spark, d), USER, "x", 8)
    return f.select("user_id", "segment", r6(vectors.rms(F.col("frame"))).alias("rms"))


@query("overlap_add_events", f"WITH {_E}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS m FROM e), g AS (SELECT *, unnest(range(CAST(greatest(0, ceil((vidx - 9) / 5.0)) AS BIGINT), CAST(least(floor(vidx / 5.0), floor((m - 10) / 5.0)) AS BIGINT) + 1)) AS k FROM c) SELECT user_id, vidx, {s6('sum(x)')} AS x FROM g GROUP BY 1, 2")
def _(spark, d):
    f = segments.frames(events(spark, d), USER, "x", 10, 5)
    return segments.overlap_add(f, USER, "frame", 5).select("user_id", F.col("vidx").cast("long").alias("vidx"), r6(F.col("x")).alias("x"))


# Vectors.
def _vector_query(name: str, cols, sql: dict[str, str]):
    def run(spark, d):
        v = F.col("v")
        return frames(spark, d).select("vec_id", *[r6(c.cast("double")).alias(k) for k, c in cols(v).items()])

    query(name, f"WITH {_V} SELECT vec_id, " + ", ".join(f"{s6(f'CAST({e} AS DOUBLE)')} AS {k}" for k, e in sql.items()) + " FROM e")(run)


_sq = "list_sum(list_transform(v, lambda x: x * x))"
_digest = lambda e: f"list_sum(list_transform({e}, lambda x, i: x * i))"
_col_digest = lambda c: F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
_vector_query("vec_scalar_operations", lambda v: {k: vectors.operation(k, v) for k in ("sum", "ssm", "ll1", "ll2")}, {"sum": "list_sum(v)", "ssm": _sq, "ll1": "list_sum(v) / n", "ll2": f"sqrt({_sq}) / n"})
_OPS = {
    "norm_rms": f"x / sqrt({_sq} / n)", "norm_l2": f"x / sqrt({_sq})", "nl1": "x / CASE WHEN list_sum(v) > 0 THEN list_sum(v) ELSE 1 END", "nr0": "(x - list_min(v)) / (list_max(v) - list_min(v))",
    "nr1": "-1 + 2 * (x - list_min(v)) / (list_max(v) - list_min(v))", "nma": "x / list_max(list_transform(v, lambda y: abs(y)))", "add": "x + 1", "mul": "x * 1", "log": "ln(greatest(x, 1e-12))", "lga": "ln(greatest(x, 1e-12)) / ln(2)",
    "sqrt": "sqrt(greatest(x, 0))", "pow": "x ** 2", "exp": "2 ** x", "ee": "exp(x)", "abs": "abs(x)", "min": "least(x, 1)", "max": "greatest(x, 1)", "dbp": "10 * log10(greatest(x, 1e-12))", "dbv": "20 * log10(greatest(x, 1e-12))",
}
_vector_query("vec_operations", lambda v: {k: _col_digest(vectors.operation(k, v)) for k in _OPS}, {k: _digest(f"list_transform(v, lambda x: {e})") for k, e in _OPS.items()})
_vector_query("vec_flattened", lambda v: {"fla": _col_digest(vectors.operation("fla", v))}, {"fla": _digest("list_transform(v, lambda x, i: x - (list_avg(v[1:5]) + (list_avg(v[n - 4:n]) - list_avg(v[1:5])) * (i - 1) / (n - 1)))")})
_vector_query("vec_binary_operations", lambda v: {k: _col_digest(vectors.binary(k, v, F.reverse(v))) for k in ("add", "sub", "mul", "div", "min", "max")}, {k: _digest(f"list_transform(v, lambda x, i: {e})") for k, e in {"add": "x + v[n - i + 1]", "sub": "x - v[n - i + 1]", "mul": "x * v[n - i + 1]", "div": "CASE WHEN v[n - i + 1] = 0 THEN x ELSE x / v[n - i + 1] END", "min": "least(x, v[n - i + 1])", "max": "greatest(x, v[n - i + 1])"}.items()})
_vector_query("vec_energy", lambda v: vectors.energy(v), {"rms": f"sqrt({_sq} / n)", "energy2": f"{_sq} / n", "log": f"ln(greatest({_sq} / n, 8.67e-19))"})
_ham = "(0.54 - 0.46 * cos(2 * pi() * (i - 1) / 63))"
_vector_query("vec_intensity", lambda v: vectors.intensity(v, 64), {"intensity": f"list_sum(list_transform(v, lambda x, i: x * x * {_ham})) / list_sum(list_transform(v, lambda x, i: {_ham}))", "loudness": f"(list_sum(list_transform(v, lambda x, i: x * x * {_ham})) / list_sum(list_transform(v, lambda x, i: {_ham})) / 1e-6) ** 0.3"})
_vector_query("vec_crossings", lambda v: vectors.crossing_rates(v), {"zcr": "len(list_filter(range(1, n), lambda i: v[i] * v[i + 1] < 0)) / n", "mcr": "len(list_filter(range(1, n), lambda i: (v[i] - list_sum(v) / n) * (v[i + 1] - list_sum(v) / n) < 0)) / n", "amax": "list_max(list_transform(v, lambda x: abs(x)))", "max": "list_max(v)", "min": "list_min(v)", "dc": "list_sum(v) / n"})
_vector_query("vec_preemphasis", lambda v: {"y": _col_digest(vectors.preemphasised(v))}, {"y": _digest("list_transform(v, lambda x, i: CASE WHEN i = 1 THEN 0.03 * x ELSE x - 0.97 * v[i - 1] END)")})
_WIN = {"hann": "0.5 - 0.5 * cos(2 * pi() * (i - 1) / 63)", "hamming": "0.54 - 0.46 * cos(2 * pi() * (i - 1) / 63)", "sine": "sin(pi() * (i - 1) / 63)", "bartlett": "1 - abs(2 * (i - 1) / 63 - 1)", "triangular": "1 - abs(2 * (i - 0.5) / 64 - 1)", "gauss": "exp(-0.5 * ((2 * (i - 1) / 63 - 1) / 0.4) ** 2)", "blackman": "0.42 - 0.5 * cos(2 * pi() * (i - 1) / 63) + 0.08 * cos(4 * pi() * (i - 1) / 63)"}
_vector_query("vec_windows", lambda v: {k.replace("-", "_"): _col_digest(vectors.windowed(v, k, 64)) for k in _WIN}, {k: _digest(f"list_transform(v, lambda x, i: x * ({e}))") for k, e in _WIN.items()})
_vector_query("vec_acf", lambda v: {f"acf{k}": F.element_at(vectors.autocorrelation(v, 8), k + 1) for k in range(8)}, {f"acf{k}": f"list_sum(list_transform(range(1, n - {k} + 1), lambda i: v[i] * v[i + {k}]))" for k in range(8)})
_vector_query("vec_amdf", lambda v: {f"{m}{k}": F.element_at(vectors.amdf(v, 6, m), k + 1) for m in ("limit", "warp") for k in range(6)}, {**{f"limit{k}": f"list_sum(list_transform(range(1, n - {k} + 1), lambda i: abs(v[i] - v[i + {k}]))) / (n - {k})" for k in range(6)}, **{f"warp{k}": f"list_sum(list_transform(range(1, n + 1), lambda i: abs(v[i] - v[(i + {k} - 1) % n + 1]))) / n" for k in range(6)}})
_pos = "list_transform(v, lambda x: greatest(x - least(list_min(v), 0), 1e-7))"
_vector_query("vec_entropy", lambda v: {"entropy": vectors.entropy(v)}, {"entropy": f"-list_sum(list_transform({_pos}, lambda x: x / list_sum({_pos}) * log2(x / list_sum({_pos}))))"})
_vector_query("vec_distances", lambda v: {"cosine": vectors.cosine_distance(v, F.reverse(v)), "euclid": vectors.euclidean(v, F.reverse(v))}, {"cosine": f"1 - list_sum(list_transform(v, lambda x, i: x * v[n - i + 1])) / {_sq}", "euclid": "sqrt(list_sum(list_transform(v, lambda x, i: (x - v[n - i + 1]) ** 2)))"})


@query("vec_top_indices", f"WITH {_V}, u AS (SELECT vec_id, unnest(range(1, n + 1)) AS i, abs(unnest(v)) AS a FROM e), k AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY a DESC, i) AS rk FROM u) SELECT vec_id, CAST(rk AS INTEGER) AS rank, CAST(i AS INTEGER) AS place FROM k WHERE rk <= 3")
def _(spark, d):
    top = F.posexplode(vectors.top_indices(F.col("v"), 3)).alias("r", "place")
    return frames(spark, d).select("vec_id", top).select("vec_id", (F.col("r") + 1).alias("rank"), "place")


@query("selector_lineitem", "SELECT l_orderkey, l_linenumber, round(l_quantity * 1.0, 6) AS f_1, round(l_discount, 6) AS f_2 FROM lineitem")
def _(spark, d):
    packed = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_extendedprice", "l_quantity", "l_discount", "l_tax").alias("f"))
    return packed.select("l_orderkey", "l_linenumber", F.slice("f", 2, 2).alias("s")).select("l_orderkey", "l_linenumber", F.round(F.col("s")[0], 6).alias("f_1"), F.round(F.col("s")[1], 6).alias("f_2"))


@query("mono_mixdown_lineitem", f"SELECT l_orderkey, l_linenumber, {s6('(l_discount + l_tax) / 2')} AS mix FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(vectors.mean(F.array("l_discount", "l_tax"))).alias("mix"))


# Spectra.
_MAG = "m AS (SELECT vec_id, list_transform(range(0, 33), lambda k: sqrt(list_sum(list_transform(v, lambda x, i: x * cos(2 * pi() * k * (i - 1) / 64))) ** 2 + list_sum(list_transform(v, lambda x, i: x * sin(2 * pi() * k * (i - 1) / 64))) ** 2)) AS m FROM e)"
_FREQ = [k * 8000 / 32 for k in range(33)]


def mags(spark, d) -> DataFrame:
    return frames(spark, d).select("vec_id", spectral.magnitude("v").alias("m"))


@query("fft_magnitude_embeddings", f"WITH {_V}, {_MAG} SELECT vec_id, CAST(unnest(range(0, 33)) AS INTEGER) AS bin, {s6('unnest(m)')} AS magnitude FROM m")
def _(spark, d):
    return mags(spark, d).select("vec_id", F.posexplode("m").alias("bin", "v")).select("vec_id", "bin", r6(F.col("v")).alias("magnitude"))


_pw = "list_transform(m, lambda x: x * x)"
_ps = f"list_sum({_pw})"
_cen = f"(list_sum(list_transform(m, lambda x, i: x * x * (i - 1) * 250)) / {_ps})"
_dev = lambda k: f"(list_sum(list_transform(m, lambda x, i: x * x * ((i - 1) * 250 - {_cen}) ** {k})) / {_ps})"
_SPEC = {
    "band_0_650": f"list_sum({_pw}[1:3])", "band_1000_4000": f"list_sum({_pw}[5:16])", "centroid": _cen, "maxpos": "(list_position(m, list_max(m)) - 1) * 250", "minpos": "(list_position(m, list_min(m)) - 1) * 250",
    "variance": _dev(2), "stddev": f"sqrt({_dev(2)})", "skewness": f"{_dev(3)} / {_dev(2)} ** 1.5", "kurtosis": f"{_dev(4)} / {_dev(2)} ** 2",
    "entropy": f"-list_sum(list_transform(m, lambda x: greatest(x * x / {_ps}, 1e-12) * log2(greatest(x * x / {_ps}, 1e-12))))",
    "flatness": f"exp(list_sum(list_transform(m, lambda x: ln(greatest(x * x, 1e-12)))) / 33) / ({_ps} / 33)",
    "alpharatio": f"10 * log10(list_sum({_pw}[5:20]) / list_sum({_pw}[2:4]))", "hammarberg": f"10 * log10(list_max({_pw}[1:8]) / list_max({_pw}[9:20]))",
    "harmonicity": "list_sum(list_transform(range(1, 33), lambda i: abs(m[i + 1] - m[i]))) / list_sum(m)",
}


@query("spectral_descriptors_embeddings", f"WITH {_V}, {_MAG} SELECT vec_id, " + ", ".join(f"{s_of(k, f'CAST({e} AS DOUBLE)')} AS {k}" for k, e in _SPEC.items()) + " FROM m")
def _(spark, d):
    got = spectral.descriptors(F.col("m"), _FREQ)
    return mags(spark, d).select("vec_id", *[r_of(k, got[k].cast("double")).alias(k) for k in _SPEC])


@query("spectral_rolloff_embeddings", f"WITH {_V}, {_MAG} SELECT vec_id, " + ", ".join(f"CAST((len(list_filter(range(1, 34), lambda j: list_sum({_pw}[1:j]) < {r} * {_ps}))) * 250 AS DOUBLE) AS rolloff{round(100 * r)}" for r in (0.25, 0.5, 0.75, 0.9)) + " FROM m")
def _(spark, d):
    got = spectral.descriptors(F.col("m"), _FREQ)
    return mags(spark, d).select("vec_id", *[got[f"rolloff{p}"].cast("double").alias(f"rolloff{p}") for p in (25, 50, 75, 90)])


_MEL = spectral.filterbank(33, 16000, 12)
_mel_sql = "[" + ", ".join("list_sum(list_transform(m, lambda x, i: x * [" + ", ".join(repr(float(v)) for v in row) + "][i]))" for row in _MEL) + "]"


@query("mel_bands_embeddings", f"WITH {_V}, {_MAG} SELECT vec_id, CAST(unnest(range(0, 12)) AS INTEGER) AS band, {s6(f'unnest({_mel_sql})')} AS energy FROM m")
def _(spark, d):
    b = mags(spark, d).select("vec_id", F.posexplode(spectral.apply_matrix(F.col("m"), _MEL)).alias("band", "e"))
    return b.select("vec_id", "band", r6(F.col("e")).alias("energy"))


@query("mfcc_embeddings", f"WITH {_V}, {_MAG}, b AS (SELECT vec_id, list_transform({_mel_sql}, lambda x: ln(greatest(x, 1e-8))) AS b FROM m), c AS (SELECT vec_id, unnest(range(1, 7)) AS k, b FROM b) SELECT vec_id, CAST(k AS INTEGER) AS k, {s6('sqrt(2.0 / 12) * (1 + 11 * sin(pi() * k / 22)) * list_sum(list_transform(b, lambda x, j: x * cos(pi() * k * (j - 0.5) / 12)))')} AS mfcc FROM c")
def _(spark, d):
    bands = spectral.apply_matrix(F.col("m"), _MEL)
    c = mags(spark, d).select("vec_id", bands.alias("b")).select("vec_id", F.posexplode(spectral.mfcc(F.col("b"), 12, 1, 6)).alias("k", "c"))
    return c.select("vec_id", (F.col("k") + 1).alias("k"), r6(F.col("c")).alias("mfcc"))


@query("chroma_embeddings", f"WITH {_V}, f AS (SELECT vec_id, list_transform(range(1, 13), lambda k: abs(v[k]) + abs(v[k + 12]) + abs(v[k + 24])) AS f FROM e) SELECT vec_id, CAST(unnest(range(0, 12)) AS INTEGER) AS note, {s6('unnest(list_transform(f, lambda x: CASE WHEN list_min(f) < 0.001 THEN 0 ELSE x / list_sum(f) END))')} AS chroma FROM f")
def _(spark, d):
    c = frames(spark, d).select("vec_id", F.posexplode(spectral.chroma(F.transform("v", F.abs), 3)).alias("note", "c"))
    return c.select("vec_id", "note", r6(F.col("c")).alias("chroma"))


@query("spectrum_acf_embeddings", f"WITH {_V}, c AS (SELECT vec_id, v, unnest(range(0, 8)) AS lag FROM e) SELECT vec_id, CAST(lag AS INTEGER) AS lag, {s6('list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * v[(i + lag) % 64 + 1])) / 33')} AS acf FROM c")
def _(spark, d):
    a = mags(spark, d).select("vec_id", F.posexplode(F.slice(spectral.spectrum_acf("m"), 1, 8)).alias("lag", "a"))
    return a.select("vec_id", "lag", r6(F.col("a")).alias("acf"))


@query("frequency_scales", "SELECT p_partkey, " + ", ".join(f"{s6(e)} AS {k}" for k, e in {"mel": "1127 * ln(1 + p_retailprice / 700)", "bark": "26.81 / (1 + 1960 / p_retailprice) - 0.53", "semitone": "12 * log2(p_retailprice / 27.5)", "schroed": "6 * ln(p_retailprice / 600 + sqrt(p_retailprice ** 2 / 360000 + 1))", "erb": "24.7 * (1 + 4.37 * p_retailprice / 1000)", "logistic": "1 / (1 + exp(-p_retailprice / 1000))", "db": "20 * log10(p_retailprice)"}.items()) + " FROM part")
def _(spark, d):
    f = F.col("p_retailprice")
    cols = {"mel": scales.SCALES["mel"][0](f), "bark": scales.SCALES["bark"][0](f), "semitone": scales.SCALES["semitone"][0](f), "schroed": scales.SCALES["bark_schroed"][0](f), "erb": scales.erb(f), "logistic": scales.logistic(f / 1000), "db": scales.amplitude_db(f)}
    return table(spark, d, "part").select("p_partkey", *[r6(c).alias(k) for k, c in cols.items()])


# Linear prediction in the JVM: order 2 has a closed form.
@query("lpc_embeddings", f"WITH {_V}, a AS (SELECT vec_id, " + ", ".join(f"list_sum(list_transform(range(1, n - {k} + 1), lambda i: v[i] * v[i + {k}])) AS r{k}" for k in range(3)) + f" FROM e) SELECT vec_id, {s6('-(r1 * r0 - r1 * r2) / (r0 * r0 - r1 * r1)')} AS a1, {s6('-(r0 * r2 - r1 * r1) / (r0 * r0 - r1 * r1)')} AS a2 FROM a")
def _(spark, d):
    a = frames(spark, d).select("vec_id", vectors.durbin(vectors.autocorrelation(F.col("v"), 3), 2).alias("l"))
    return a.select("vec_id", r6(F.col("l.a")[0]).alias("a1"), r6(F.col("l.a")[1]).alias("a2"))


# Models.
_W = [((k * 37) % 11 - 5) / 10 for k in range(64)]


@query("svm_embeddings", f"WITH {_V} SELECT vec_id, {s6(f'list_sum(list_transform(v, lambda x, i: x * {_W}[i])) + 0.1')} AS decision, CASE WHEN list_sum(list_transform(v, lambda x, i: x * {_W}[i])) + 0.1 < 0 THEN 'a' ELSE 'b' END AS class FROM e")
def _(spark, d):
    f = frames(spark, d)
    return f.select("vec_id", r6(models.svm_decision(F.col("v"), _W, 0.1)).alias("decision"), models.svm_vote(F.col("v"), [("a", "b", _W, 0.1)]).alias("class"))


@query("ctc_labels_events", f"WITH {_E}, w AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY vidx) AS was FROM e) SELECT user_id, vidx, kind FROM w WHERE (was IS NULL OR was <> kind) AND kind <> 'view'")
def _(spark, d):
    return models.ctc_labels(events(spark, d), ["user_id"], ["vidx"], "kind", "view").select("user_id", "vidx", "kind")


@query("messages_events", "SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE value >= 90")
def _(spark, d):
    from ..streaming.live import messages

    m = messages(table(spark, d, "events").select("event_id", "user_id", "value"), "value", "gteq", 90.0, "loud")
    return m.select(F.from_json("message", "event_id long, user_id long, value double").alias("r")).select("r.event_id", "r.user_id", F.round("r.value", 6).alias("value"))


@query("printed_events", f"WITH {_E}, f AS (SELECT user_id, max(x) AS x_max, min(x) AS x_min FROM e GROUP BY 1) SELECT user_id, 'x_max' AS field, {s6('x_max')} AS value FROM f UNION ALL SELECT user_id, 'x_min', {s6('x_min')} FROM f")
def _(spark, d):
    from ..sources.files import printed

    f = events(spark, d).groupBy("user_id").agg(F.max("x").alias("x_max"), F.min("x").alias("x_min"))
    return printed(f, ["user_id"]).select("user_id", "field", r6(F.col("value")).alias("value"))


@query("libsvm_lines_labels", "SELECT quality || ' 1:' || toxic || ' 2:' || (doc_id % 7) AS value FROM labels")
def _(spark, d):
    from ..sources.files import libsvm_lines

    return libsvm_lines(table(spark, d, "labels").select("quality", F.array(F.col("toxic").cast("long"), F.col("doc_id") % 7).alias("f")), "quality", "f")


@query("equal_loudness_and_dba", "SELECT p_partkey, " + f"{s6('(f * f + 56.8e6) * f ** 4 / ((f * f + 6.3e6) ** 2 * (f * f + 0.38e9))')} AS loud, {s6('20 * log10(12194.0 ** 2 * f ** 4 / ((f * f + 20.6 ** 2) * sqrt((f * f + 107.7 ** 2) * (f * f + 737.9 ** 2)) * (f * f + 12194.0 ** 2))) + 2.0')} AS dba FROM (SELECT p_partkey, p_retailprice AS f FROM part)")
def _(spark, d):
    f = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", r6(scales.equal_loudness(f)).alias("loud"), r6(scales.a_weight_db(f)).alias("dba"))


# Sequential kernels: rows only; tests hold them against closed forms.
def _kernel(name, fun, names):
    query(name)(lambda spark, d: _rounded(kernels.per_series(events(spark, d), ["user_id"], ["vidx"], "x", fun, names), ["user_id"]))




_kernel("jitter_events", lambda x: kernels.jitter(x, 7), ["jitterlocal", "jitterddp", "shimmerlocal", "shimmerdb", "loghnr"])


@query("exponential_mvn_events")
def _(spark, d):
    out = windows.exponential_mvn(events(spark, d).select("user_id", "vidx", "x"), USER, "x", rows=32)
    return out.select("user_id", "vidx", r6(F.col("x_mvn")).alias("x_mvn"))


def _frame_kernel(name, fun, source=frames, column="v"):
    query(name)(lambda spark, d: source(spark, d).select("vec_id", kernels.on_frames(fun)(F.col(column)).alias("y")).select("vec_id", F.posexplode("y").alias("i", "y")).select("vec_id", "i", r6(F.col("y")).alias("y")))


_frame_kernel("lsp_embeddings", lambda v: kernels.lsp(kernels.lpc(v, 8)[0]).tolist())
_frame_kernel("burg_embeddings", lambda v: kernels.lpc_burg(v, 8)[0].tolist())
_frame_kernel("formants_embeddings", lambda v: kernels.formants(kernels.lpc(v, 8)[0], 16000)[0].tolist())
_frame_kernel("lpc_cepstrum_embeddings", lambda v: kernels.lpc_cepstrum(*kernels.lpc(v, 8)[:2]).tolist())
_frame_kernel("pitch_acf_embeddings", lambda v: list(kernels.pitch_acf(v, 16000)))
_frame_kernel("pitch_shs_embeddings", lambda m: [x for c in kernels.pitch_shs(m, 16000) for x in c], mags, "m")
_frame_kernel("harmonics_embeddings", lambda m: kernels.harmonics(m, 16000, 500.0).tolist(), mags, "m")
_frame_kernel("tone_filter_embeddings", lambda v: kernels.tone_filter(v, 16000, 12, every=64)[0].tolist())
query("plp_embeddings")(lambda spark, d: mags(spark, d).select("vec_id", F.posexplode(spectral.plp(spectral.apply_matrix(F.col("m"), _MEL), [200.0 * (k + 1) for k in range(12)])).alias("i", "y")).select("vec_id", "i", r6(F.col("y")).alias("y")))
query("resample_embeddings")(lambda spark, d: frames(spark, d).select("vec_id", F.posexplode(spectral.resampled(F.col("v"), 0.5)).alias("i", "y")).select("vec_id", "i", r6(F.col("y")).alias("y")))
query("tonespec_embeddings")(lambda spark, d: mags(spark, d).select("vec_id", F.posexplode(spectral.apply_matrix(F.col("m"), spectral.tonespec(33, 16000))).alias("i", "y")).select("vec_id", "i", r6(F.col("y")).alias("y")))


query("vad_events")(lambda spark, d: _rounded(kernels.per_series(events(spark, d), ["user_id"], ["vidx"], "x", lambda x: {"voice": kernels.vad(x).mean()}, ["voice"]), ["user_id"]))


@query("lstm_embeddings")
def _(spark, d):
    import numpy as np

    rng = np.random.default_rng(4)
    w = {"wx": rng.normal(0, 0.1, (16, 64)), "wh": rng.normal(0, 0.1, (16, 4)), "b": np.zeros(16), "p": rng.normal(0, 0.1, (3, 4))}
    v = table(spark, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = models.recurrent(v, ["label"], ["vec_id"], "v", w)
    return out.select("label", "vec_id", F.posexplode("activation").alias("i", "y")).select("label", "vec_id", "i", r6(F.col("y")).alias("y"))


_SUMMARY = {k: _SQL_SETS["extremes"][k] for k in ("max", "min", "range", "maxpos", "minpos", "amean")} | _SQL_SETS["moments"]


@query(
    "flagship_contour_summary",
    f"""WITH {_E}, y AS (SELECT user_id, vidx, {_sma} AS x FROM e),
    b AS (SELECT user_id, x, CAST(vidx AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE) AS n, min(x) OVER (PARTITION BY user_id) AS lo, max(x) OVER (PARTITION BY user_id) AS hi, avg(x) OVER (PARTITION BY user_id) AS mu FROM y)
    SELECT user_id, """ + ", ".join(f"{s_of(k, f'CAST({e} AS DOUBLE)')} AS x_sma_{k}" for k, e in _SUMMARY.items()) + f", {s6('regr_slope(x, i)')} AS x_sma_linregc1 FROM b GROUP BY user_id",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: the event values' contour, smoothed, and its extremes, moments and trend."""
    e = events(spark, sf_dir)
    sma = e.select("user_id", "vidx", windows.sma(USER, "x").alias("x_sma"))
    out = fn.functionals(sma, ["user_id"], ["vidx"], "x_sma", ["extremes", "moments", "regression"])
    return _rounded(out.select("user_id", *[f"x_sma_{k}" for k in _SUMMARY], "x_sma_linregc1"), ["user_id"])


from . import long, more  # noqa: E402, F401  register their queries


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
