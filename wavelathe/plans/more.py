"""More registered queries: pipelines, norms, state machines (recursive SQL gives the same rows), models and sources."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import functionals as fn
from ..functions import scales, spectral, vectors
from ..operators import kernels, models, segments, windows
from ..series import of_level
from ..sources import plugins
from . import graph
from .catalog import (
    USER, _E, _FREQ, _L, _MAG, _MEL, _O, _RUN, _SQL, _SQL_SETS, _V, _col_digest, _digest, _pad, _ps, _rounded, _vector_query, _windowed,
    events, frames, items, mags, orders, query, r6, s6, table,
)

LABEL = of_level("label")


# A pipeline from a dict: frames, their energy, smoothed, with its trend, then statistics of both.
_SPEC = [
    {"type": "functionals", "reads": ["both"], "writes": "out", "options": {"which": ["extremes"], "fields": ["x_rms_sma", "x_rms_sma_de"]}},
    {"type": "frame", "reads": ["wave"], "writes": "frames", "options": {"field": "x", "size": 8, "step": 4}},
    {"type": "energy", "reads": ["frames"], "writes": "energy", "options": {"only": ["rms"]}},
    {"type": "smooth", "reads": ["energy"], "writes": "lld"},
    {"type": "delta", "reads": ["lld"], "writes": "lld_de"},
    {"type": "join", "reads": ["lld", "lld_de"], "writes": "both"},
]


def _energy_sql() -> str:
    p = partial(_pad, "user_id", "e")
    q = partial(_pad, "user_id", "s")
    cut = f"{_E}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS m FROM e), g AS (SELECT user_id, x, unnest(range(CAST(greatest(0, ceil((vidx - 7) / 4.0)) AS BIGINT), CAST(least(floor(vidx / 4.0), floor((m - 8) / 4.0)) AS BIGINT) + 1)) AS k FROM c)"
    rows = f"{cut}, en AS (SELECT user_id, k AS vidx, sqrt(avg(x * x)) AS e FROM g GROUP BY 1, 2), sm AS (SELECT user_id, vidx, ({p(-1)} + e + {p(1)}) / 3 AS s FROM en), de AS (SELECT user_id, vidx, s, (({q(1)} - {q(-1)}) + 2 * ({q(2)} - {q(-2)})) / 10 AS d FROM sm)"
    w = "(PARTITION BY user_id)"
    wide = f"b AS (SELECT *, CAST(vidx AS DOUBLE) AS i, CAST(count(*) OVER {w} AS DOUBLE) AS n, max(s) OVER {w} AS hs, min(s) OVER {w} AS ls, max(d) OVER {w} AS hd, min(d) OVER {w} AS ld FROM de)"
    cols = []
    for c, f in (("s", "x_rms_sma"), ("d", "x_rms_sma_de")):
        for name, e in _SQL_SETS["extremes"].items():
            e = e.replace("x = hi", f"{c} = h{c}").replace("x = lo", f"{c} = l{c}").replace("max(x)", f"max({c})").replace("min(x)", f"min({c})").replace("avg(x)", f"avg({c})")
            cols.append(f"{s6(f'CAST({e} AS DOUBLE)')} AS {f}_{name}")
    return f"WITH {rows}, {wide} SELECT user_id, {', '.join(cols)} FROM b GROUP BY user_id"


@query("graph_energy_contour_events", _energy_sql())
def _(spark, d):
    levels = graph.build(_SPEC, {"wave": events(spark, d).select("user_id", "vidx", "x")}, keys=("user_id",))
    return _rounded(levels["out"], ["user_id"])


@query("graph_select_lineitem", f"WITH {_L} SELECT l_partkey, vidx, {s6('x')} AS a, {s6('q')} AS b, {s6('q')} AS c FROM e")
def _(spark, d):
    e = items(spark, d).select("l_partkey", "vidx", "x", "q", F.array("x", "q").alias("f"))
    spec = [
        {"type": "select", "reads": ["in"], "writes": "named", "options": {"ranges": ["1-2"], "fields": ["f[2-$]"], "new_names": ["a", "b", "c"]}},
        {"type": "select", "reads": ["named"], "writes": "packed", "options": {"fields": ["a", "b", "c"], "into": "row"}},
    ]
    row = graph.build(spec, {"in": e}, keys=("l_partkey",))["packed"]
    return row.select("l_partkey", "vidx", *[r6(F.col("row")[i]).alias(n) for i, n in enumerate("abc")])


@query("graph_filter_zeroed_events", f"WITH {_E} SELECT user_id, vidx, {s6('CASE WHEN x > 50 THEN x ELSE -1 END')} AS x FROM e")
def _(spark, d):
    spec = [{"type": "filter", "reads": ["in"], "writes": "out", "options": {"field": "x", "threshold": 50.0, "instead": -1.0}}]
    out = graph.build(spec, {"in": events(spark, d).select("user_id", "vidx", "x")}, keys=("user_id",))["out"]
    return out.select("user_id", "vidx", r6(F.col("x")).alias("x"))


# Functionals: norms, several fields, options.
def _shared_sql(head: str, key: str, cols: dict[str, str]) -> str:
    w, o = f"(PARTITION BY {key})", f"(PARTITION BY {key} ORDER BY vidx)"
    prep = f"b AS (SELECT {key}, x, CAST(row_number() OVER {o} - 1 AS DOUBLE) AS i, CAST(count(*) OVER {w} AS DOUBLE) AS n, min(x) OVER {w} AS lo, max(x) OVER {w} AS hi, avg(x) OVER {w} AS mu, lag(x) OVER {o} AS was FROM e)"
    return f"WITH {head}, {prep} SELECT {key}, " + ", ".join(f"{s6(f'CAST({e} AS DOUBLE)')} AS {c}" for c, e in cols.items()) + f" FROM b GROUP BY {key}"


@query("func_norm_frame_events", _shared_sql(_E, "user_id", {"x_maxpos": "min(CASE WHEN x = hi THEN i END)", "x_minpos": "min(CASE WHEN x = lo THEN i END)", "x_meanseglen": "max(n) / count(*) FILTER (was IS NULL OR was <> x)"}))
def _(spark, d):
    out = fn.functionals(events(spark, d), ["user_id"], ["vidx"], "x", ["extremes", "segments"], norm="frame")
    return _rounded(out.select("user_id", "x_maxpos", "x_minpos", "x_meanseglen"), ["user_id"])


_zcr = _SQL_SETS["crossings"]["mcr"]


@query("func_norm_second_events", _shared_sql(_E, "user_id", {"x_maxpos": "min(CASE WHEN x = hi THEN i END) * 0.5", "x_mcr": f"({_zcr}) / 0.5", "x_nnz": "count(*) FILTER (x <> 0) * 0.5"}))
def _(spark, d):
    out = fn.functionals(events(spark, d), ["user_id"], ["vidx"], "x", ["extremes", "crossings", "means"], norm="second", period=0.5)
    return _rounded(out.select("user_id", "x_maxpos", "x_mcr", "x_nnz"), ["user_id"])


@query("func_two_fields_lineitem", f"WITH {_L} SELECT l_partkey, {s6('max(x)')} AS x_max, {s6('min(q)')} AS q_min, {s6('avg(q)')} AS q_amean FROM e GROUP BY 1")
def _(spark, d):
    out = fn.functionals_of(items(spark, d), ["l_partkey"], ["vidx"], ["x", "q"], ["extremes"])
    return _rounded(out.select("l_partkey", "x_max", "q_min", "q_amean"), ["l_partkey"])


def _rank(q: float) -> str:
    return f"list_sort(list(x))[CAST(round({q} * (count(*) - 1)) AS BIGINT) + 1]"


@query("func_percentiles_nearest_lineitem", f"WITH {_L} SELECT l_partkey, {s6(_rank(0.25))} AS x_quartile1, {s6(_rank(0.95))} AS x_percentile95, {s6(f'CASE WHEN {_rank(0.75)} <> 0 THEN {_rank(0.25)} / {_rank(0.75)} ELSE 0 END')} AS x_iqq13 FROM e GROUP BY 1")
def _(spark, d):
    out = fn.functionals(items(spark, d), ["l_partkey"], ["vidx"], "x", {"percentiles": {"interpolated": False}})
    return _rounded(out.select("l_partkey", "x_quartile1", "x_percentile95", "x_iqq13"), ["l_partkey"])


_lim = "CASE WHEN abs(v) <= 0.4 THEN v ELSE sign(v) * (0.1 * tanh(sqrt(greatest(abs(v) - 0.4, 0)) / 0.1) + 0.4) END"


@query("ratio_limited_orders", f"WITH {_O}, r AS (SELECT o_custkey, stddev_pop(x) / avg(x) AS v FROM e GROUP BY 1) SELECT o_custkey, {s6(_lim)} AS y FROM r")
def _(spark, d):
    v = orders(spark, d).groupBy("o_custkey").agg((F.stddev_pop("x") / F.avg("x")).alias("v"))
    return v.select("o_custkey", r6(fn.ratio_limit(F.col("v"), 0.4, 0.5)).alias("y"))


@query("win_centred_events", f"WITH {_E}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS m FROM e), g AS (SELECT user_id, x, unnest(range(CAST(greatest(0, ceil((vidx + 3 - 9) / 5.0)) AS BIGINT), CAST(least(floor((vidx + 3) / 5.0), floor((m + 3 - 10) / 5.0)) AS BIGINT) + 1)) AS segment FROM c) SELECT user_id, segment, count(*) AS n, {s6('sum(x)')} AS total FROM g GROUP BY 1, 2")
def _(spark, d):
    cut = segments.fixed(events(spark, d), USER, 10, 5, centre=3)
    return cut.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("x")).alias("total"))


@query("win_zero_padded_events", f"WITH {_E} SELECT user_id, vidx // 16 AS segment, CAST(16 AS BIGINT) AS n, {s6('sum(x) / 16')} AS amean FROM e GROUP BY 1, 2")
def _(spark, d):
    cut = segments.fixed(segments.zero_padded(events(spark, d), USER, ["x"], 16), USER, 16)
    return cut.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("amean"))


@query("win_list_table_events", f"WITH {_E} SELECT user_id, s AS segment, {s6('sum(x)')} AS total FROM e JOIN (VALUES (0, 3, 9), (2, 20, 60)) t(s, a, b) ON vidx BETWEEN a AND b GROUP BY 1, 2")
def _(spark, d):
    spans = spark.createDataFrame([(0, 3, 9), (1, 12, 13), (2, 20, 60)], "segment int, start long, stop long")
    return segments.listed_in(events(spark, d), spans, least=3).groupBy("user_id", "segment").agg(r6(F.sum("x")).alias("total"))


# Rows of a series.
_f0 = "CASE WHEN x > 40 THEN x ELSE 0 END"
_EF = f"{_E}, f AS (SELECT user_id, vidx, x, kind, {_f0} AS f0 FROM e)"
_up = "(PARTITION BY user_id ORDER BY vidx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _pitched(spark, d) -> DataFrame:
    return events(spark, d).withColumn("f0", F.when(F.col("x") > 40, F.col("x")).otherwise(0.0))


def _pitch_query(name: str, column, sql: str):
    query(name, f"WITH {_EF} SELECT user_id, vidx, {s6(sql)} AS y FROM f")(lambda spark, d: _pitched(spark, d).select("user_id", "vidx", r6(column()).alias("y")))


_pitch_query("held_pitch_events", lambda: windows.held(USER, "f0"), f"coalesce(last_value(CASE WHEN f0 > 0 THEN f0 END IGNORE NULLS) OVER {_up}, 0)")
_pitch_query("formant_smoothed_events", lambda: windows.smoothed_formant(USER, "x", "f0"), "CASE WHEN f0 > 0 THEN coalesce(median(CASE WHEN f0 > 0 AND x > 0 THEN x END) OVER (PARTITION BY user_id ORDER BY vidx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) ELSE 0 END")
_was, _will = "lag(f0) OVER (PARTITION BY user_id ORDER BY vidx)", "lead(f0) OVER (PARTITION BY user_id ORDER BY vidx)"
_pitch_query("spikes_removed_events", lambda: windows.without_spikes(USER, "f0"), f"CASE WHEN f0 > 0 AND {_was} = 0 AND {_will} = 0 THEN 0 WHEN f0 = 0 AND {_was} > 0 AND {_will} > 0 THEN ({_was} + {_will}) / 2 ELSE f0 END")
_pre = "avg(CASE WHEN f0 > 0 THEN f0 END) OVER (PARTITION BY user_id ORDER BY vidx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_pitch_query("octave_corrected_events", lambda: windows.octave_corrected(USER, "f0"), f"CASE WHEN f0 <= 0 OR {_pre} IS NULL OR {_pre} <= 0 OR abs(f0 / {_pre} - 1) < 0.2 THEN f0 WHEN abs(f0 * 2 / {_pre} - 1) < 0.2 THEN f0 * 2 WHEN abs(f0 / 2 / {_pre} - 1) < 0.2 THEN f0 / 2 ELSE f0 END")
_mean = lambda n: f"avg(CASE WHEN f0 > 0 THEN f0 END) OVER (PARTITION BY user_id ORDER BY vidx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_pitch_query("direction_score_events", lambda: windows.direction_score(USER, "f0"), f"coalesce({_mean(5)} - {_mean(20)}, 0)")
_good = "(x > 30)"
_lags = " AND ".join(f"coalesce(lag({_good}, {k}) OVER (PARTITION BY user_id ORDER BY vidx), false)" for k in (1,))
_syl = f"CASE WHEN {_good} AND {_lags} AND NOT coalesce(lag({_good}, 2) OVER (PARTITION BY user_id ORDER BY vidx), false) THEN 1 ELSE 0 END"


@query("speaking_rate_events", f"WITH {_E}, y AS (SELECT user_id, vidx, {_syl} AS s FROM e) SELECT user_id, vidx, {s6('sum(s) OVER (PARTITION BY user_id ORDER BY vidx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / 1.0')} AS rate FROM y")
def _(spark, d):
    e = events(spark, d).withColumn("syllable", windows.syllable_starts(USER, "x", "x", 30.0, 2))
    return e.select("user_id", "vidx", r6(windows.speaking_rate(USER, "syllable", 10, 0.1)).alias("rate"))


_windowed("mean_norm_symmetric_orders", orders, _O, "o_custkey", lambda s: windows.mean_norm(s, "x", symmetric=True), "sign(x) * greatest(abs(x) - abs(avg(x) OVER (PARTITION BY o_custkey)), 0)")
_windowed("spectral_floor_orders", orders, _O, "o_custkey", lambda s: windows.spectral_floor(s, "x"), "greatest(x - avg(x) OVER (PARTITION BY o_custkey), 0.1 * x, 1e-10)")
_windowed("window_udf_events", events, _E, "user_id", lambda s: kernels.window_udf(lambda v: v.max() - v.min())("x").over(s.upto(6)), "max(x) OVER (PARTITION BY user_id ORDER BY vidx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) - min(x) OVER (PARTITION BY user_id ORDER BY vidx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")


@query("mvn_saved_orders", "WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice AS x, o_orderkey % 2 = 0 AS past FROM orders), t AS (SELECT o_orderpriority, avg(x) AS m, stddev_pop(x) AS s FROM o WHERE past AND o_orderpriority <> '1-URGENT' GROUP BY 1) " + f"SELECT o_orderkey, {s6('CASE WHEN m IS NULL THEN x ELSE (x - m) / greatest(s, 1e-7) END')} AS y FROM o LEFT JOIN t USING (o_orderpriority) WHERE NOT past")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("x"))
    saved = windows.learned(o.where("o_orderkey % 2 = 0 and o_orderpriority <> '1-URGENT'"), ["o_orderpriority"], "x")
    new = windows.applied(o.where("o_orderkey % 2 <> 0"), saved, ["o_orderpriority"], "x")
    return new.select("o_orderkey", r6(F.col("x")).alias("y"))


@query("gated_mvn_events", f"WITH {_RUN.format(h=_E, c='kind', k='user_id')}, t AS (SELECT * FROM g WHERE kind = 'view') SELECT user_id, vidx, {s6('(x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-7)')} AS y FROM t WINDOW w AS (PARTITION BY user_id, segment ORDER BY vidx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(spark, d):
    cut = segments.runs(events(spark, d), USER, "kind").withColumn("turn", F.when(F.col("kind") == "view", F.col("segment")))
    return cut.withColumn("y", windows.gated_mvn(("user_id",), "x", "turn")).where("turn is not null").select("user_id", "vidx", r6(F.col("y")).alias("y"))


@query("mean_norm_turns_lineitem", f"WITH {_RUN.format(h=_L, c='flag', k='l_partkey')} SELECT l_partkey, vidx, {s6('x - avg(x) OVER (PARTITION BY l_partkey, segment)')} AS y FROM g")
def _(spark, d):
    cut = segments.runs(items(spark, d), of_level("l_partkey"), "flag")
    return cut.select("l_partkey", "vidx", r6(windows.mean_norm(of_level("l_partkey", "segment"), "x")).alias("y"))


# State machines, row by row in recursive SQL.
def _stepped(first: str, step: str, names: str) -> str:
    """r: the state after each row of e, from `first` (of row 0) by `step` (of r and the next row n)."""
    return f"r(user_id, vidx, x, {names}) AS (SELECT user_id, vidx, x, {first} FROM e WHERE vidx = 0 UNION ALL SELECT n.user_id, n.vidx, n.x, {step} FROM r JOIN e n ON n.user_id = r.user_id AND n.vidx = r.vidx + 1)"


# Rows of a turn's state: where it began (-1: outside), rows in a row above and below, and a turn that ends at this row.
_in = "r.start >= 0"
_above = f"CASE WHEN {_in} THEN 0 WHEN n.x > 50 THEN r.above + 1 ELSE 0 END"
_below = f"CASE WHEN {_in} AND n.x <= 45 THEN r.below + 1 ELSE 0 END"
_TURNS = f"""WITH RECURSIVE {_E}, {_stepped("CAST(-1 AS BIGINT), CAST(CASE WHEN x > 50 THEN 1 ELSE 0 END AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)",
    f"CASE WHEN {_in} THEN CASE WHEN {_below} > 2 THEN -1 ELSE r.start END WHEN {_above} > 1 THEN n.vidx - 1 ELSE -1 END, CASE WHEN NOT {_in} AND {_above} > 1 THEN 0 ELSE {_above} END, CASE WHEN {_below} > 2 THEN 0 ELSE {_below} END, CASE WHEN {_in} AND {_below} > 2 THEN r.start END, CASE WHEN {_in} AND {_below} > 2 THEN n.vidx - 3 END", "start, above, below, a, b")},
    last AS (SELECT user_id, max(vidx) AS vidx FROM r GROUP BY 1),
    ended AS (SELECT user_id, a, b FROM r WHERE a IS NOT NULL UNION ALL SELECT user_id, start, vidx - below FROM r JOIN last USING (user_id, vidx) WHERE start >= 0),
    turns AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY a) - 1 AS BIGINT) AS segment, a AS start, b AS stop FROM ended)"""


def _turns(spark, d) -> DataFrame:
    return windows.turns_between(events(spark, d), USER, "x", on=50.0, off=45.0, pre=1, post=2)


query("turns_events", f"{_TURNS} SELECT user_id, segment, start, stop FROM turns")(_turns)


@query("turn_functionals_events", f"{_TURNS}, g AS (SELECT e.user_id, segment, vidx, x FROM e JOIN turns t ON e.user_id = t.user_id AND vidx BETWEEN start AND stop), b AS (SELECT user_id, segment, x, CAST(row_number() OVER (PARTITION BY user_id, segment ORDER BY vidx) - 1 AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY user_id, segment) AS DOUBLE) AS n, min(x) OVER (PARTITION BY user_id, segment) AS lo, max(x) OVER (PARTITION BY user_id, segment) AS hi FROM g) SELECT user_id, segment, " + ", ".join(f"{s6(f'CAST({e} AS DOUBLE)')} AS x_{c}" for c, e in _SQL_SETS["extremes"].items()) + " FROM b GROUP BY 1, 2")
def _(spark, d):
    cut = segments.interval_join(events(spark, d), _turns(spark, d), USER)
    return _rounded(fn.functionals(cut, ["user_id", "segment"], ["vidx"], "x", ["extremes"]), ["user_id", "segment"])


_SQL["exponential_mvn_events"] = f"""WITH RECURSIVE {_E}, {_stepped("0.995 * x + 0.005 * x, 0.995 * x * x + 0.005 * x * x", "0.995 * r.m + 0.005 * n.x, 0.995 * r.q + 0.005 * n.x * n.x", "m, q")}
    SELECT user_id, vidx, {s6('(x - m) / greatest(sqrt(greatest(q - m * m, 0)), 1e-7)')} AS x_mvn FROM r"""
_SQL["vad_events"] = f"""WITH RECURSIVE {_E}, {_stepped("x, CAST(1e-6 + 1e-9 AS DOUBLE) * 1.0, CAST(0 AS DOUBLE)", "CASE WHEN (n.x - r.m) / sqrt(r.v) < 1 THEN 0.98 * r.m + 0.02 * n.x ELSE r.m END, CASE WHEN (n.x - r.m) / sqrt(r.v) < 1 THEN 0.98 * r.v + 0.02 * (n.x - r.m) ** 2 + 1e-9 ELSE r.v END, greatest(0, least(1, ceil((n.x - r.m) / sqrt(r.v)) * 0.2))", "m, v, voice")}
    SELECT user_id, {s6('avg(voice)')} AS x_voice FROM r GROUP BY user_id""".replace("CAST(1e-6 + 1e-9 AS DOUBLE) * 1.0", "CAST(0.98 * 1e-6 + 1e-9 AS DOUBLE)")

# Peaks: the highest and lowest row since the last turn, the way it goes, and the tops so far.
_hi, _lo = "CASE WHEN n.x > r.xhi THEN n.vidx ELSE r.hi END", "CASE WHEN n.x < r.xlo THEN n.vidx ELSE r.lo END"
_xhi, _xlo = "greatest(n.x, r.xhi)", "least(n.x, r.xlo)"
_top = f"(r.going >= 0 AND {_xhi} - n.x > n.need)"
_bot = f"(NOT {_top} AND r.going <= 0 AND n.x - {_xlo} > n.need)"
_PEAKS = f"""WITH RECURSIVE {_E.replace('e AS', 'e0 AS', 1)}, e AS (SELECT user_id, vidx, x, 0.1 * (max(x) OVER w - min(x) OVER w) AS need, count(*) OVER w AS n FROM e0 WINDOW w AS (PARTITION BY user_id)),
    r(user_id, vidx, x, hi, lo, xhi, xlo, going, tops, heights) AS (
        SELECT user_id, vidx, x, vidx, vidx, x, x, 0, CAST([] AS BIGINT[]), CAST([] AS DOUBLE[]) FROM e WHERE vidx = 0 UNION ALL
        SELECT n.user_id, n.vidx, n.x, CASE WHEN {_top} OR {_bot} THEN n.vidx ELSE {_hi} END, CASE WHEN {_top} OR {_bot} THEN n.vidx ELSE {_lo} END, CASE WHEN {_top} OR {_bot} THEN n.x ELSE {_xhi} END, CASE WHEN {_top} OR {_bot} THEN n.x ELSE {_xlo} END,
            CASE WHEN {_top} THEN -1 WHEN {_bot} THEN 1 ELSE r.going END, CASE WHEN {_top} AND {_hi} > 0 THEN list_append(r.tops, {_hi}) ELSE r.tops END, CASE WHEN {_top} AND {_hi} > 0 THEN list_append(r.heights, {_xhi}) ELSE r.heights END
        FROM r JOIN e n ON n.user_id = r.user_id AND n.vidx = r.vidx + 1),
    f AS (SELECT user_id, arg_max(tops, vidx) AS t, arg_max(heights, vidx) AS h, count(*) AS n, avg(x) AS mu FROM r GROUP BY user_id),
    k AS (SELECT *, CASE WHEN n >= 3 THEN t ELSE [] END AS p FROM f), z AS (SELECT *, list_transform(range(1, len(p)), lambda i: CAST(p[i + 1] - p[i] AS DOUBLE)) AS d FROM k)"""


def _peaks2_sql() -> str:
    """The same state with the bottoms too, then statistics of lists."""
    both = _PEAKS[: _PEAKS.index("f AS (SELECT user_id, arg_max")]
    both = both.replace("tops, heights)", "tops, heights, bots, lows)").replace("CAST([] AS BIGINT[]), CAST([] AS DOUBLE[])", "CAST([] AS BIGINT[]), CAST([] AS DOUBLE[]), CAST([] AS BIGINT[]), CAST([] AS DOUBLE[])")
    both = both.replace("ELSE r.heights END", f"ELSE r.heights END, CASE WHEN {_bot} AND {_lo} > 0 THEN list_append(r.bots, {_lo}) ELSE r.bots END, CASE WHEN {_bot} AND {_lo} > 0 THEN list_append(r.lows, {_xlo}) ELSE r.lows END")
    none = lambda c: f"CASE WHEN n >= 3 THEN {c} ELSE [] END"
    steps = lambda v: f"list_transform(range(1, len({v})), lambda i: CAST({v}[i + 1] - {v}[i] AS DOUBLE))"
    spot = lambda t, h, k: f"list_transform({t}, lambda v, i: struct_pack(i := v, k := {k}, x := {h}[i]))"
    tables = f"""f AS (SELECT user_id, arg_max(tops, vidx) AS t0, arg_max(heights, vidx) AS h0, arg_max(bots, vidx) AS b0, arg_max(lows, vidx) AS l0, count(*) AS n, avg(x) AS mu, max(x) - min(x) AS span FROM r GROUP BY user_id),
    k AS (SELECT user_id, n, mu, span, {none('t0')} AS t, {none('h0')} AS h, {none('b0')} AS b, {none('l0')} AS l FROM f),
    w AS (SELECT *, {steps('t')} AS dist, list_transform({steps('h')}, lambda v: abs(v)) AS up, list_transform({steps('l')}, lambda v: abs(v)) AS down, list_sort(list_concat({spot('t', 'h', 1)}, {spot('b', 'l', -1)})) AS m FROM k),
    y AS (SELECT *, list_transform({steps('dist')}, lambda v: abs(v)) AS dd, list_transform(list_filter(range(1, len(m)), lambda i: m[i + 1].i > m[i].i), lambda i: struct_pack(s := (m[i + 1].x - m[i].x) / (m[i + 1].i - m[i].i), k := m[i + 1].k)) AS sl FROM w),
    z AS (SELECT *, list_transform(list_filter(sl, lambda v: v.k > 0), lambda v: v.s) AS rise, list_transform(list_filter(sl, lambda v: v.k < 0), lambda v: v.s) AS fall FROM y)"""
    mean = lambda v: f"coalesce(list_avg({v}), 0)"
    std = lambda v: f"coalesce(sqrt(list_avg(list_transform({v}, lambda q: (q - list_avg({v})) ** 2))), 0)"
    ptp = lambda v: f"coalesce(list_max({v}) - list_min({v}), 0)"
    by = lambda v, d: f"coalesce({v} / nullif({d}, 0), 0)"
    cols = {"numpeaks": "len(t)", "meanpeakdist": mean("dist"), "meanpeakdistdelta": mean("dd"), "peakdiststddev": std("dist")}
    for name, v, amp, word, sign in (("peak", "h", "up", "ptp", "{m} - mu"), ("min", "l", "down", "mtm", "mu - {m}")):
        cols |= {f"{name}rangeabs": ptp(v), f"{name}rangerel": by(ptp(v), "span"), f"{name}meanabs": mean(v), f"{name}meanmeandist": f"CASE WHEN len({v}) > 0 THEN {sign.format(m=mean(v))} ELSE 0 END", f"{name}meanrel": by(mean(v), "mu")}
        cols |= {f"{word}ampmeanabs": mean(amp), f"{word}ampmeanrel": by(mean(amp), "span"), f"{word}ampstddevabs": std(amp), f"{word}ampstddevrel": by(std(amp), "span")}
    for name, v in (("rising", "rise"), ("falling", "fall")):
        cols |= {f"mean{name}slope": mean(v), f"max{name}slope": f"coalesce(list_max({v}), 0)", f"min{name}slope": f"coalesce(list_min({v}), 0)", f"stddev{name}slope": std(v), f"cov{name}slope": by(std(v), mean(v))}
    return f"{both} {tables} SELECT user_id, " + ", ".join(f"{s6(f'CAST({e} AS DOUBLE)')} AS x_{c}" for c, e in cols.items()) + " FROM z"


_SQL["func_peaks2_events"] = _peaks2_sql()


# Vectors and spectra.
_cov = "list_sum(list_transform(v, lambda x, i: (x - list_avg(v)) * (v[n - i + 1] - list_avg(v))))"
_sh = "list_transform(v, lambda x: greatest(x - least(list_min(v), 0), 1e-7))"
_rel = f"list_sum(list_transform({_sh}, lambda x, i: x / list_sum({_sh}) * log2(x / list_sum({_sh}) / (greatest(v[n - i + 1] - least(list_min(v), 0), 1e-7) / list_sum({_sh})))))"
_vector_query(
    "vec_correlations",
    lambda v: {"pearson": vectors.pearson(v, F.reverse(v)), "angle": vectors.angle(v, F.reverse(v)), "second": vectors.second_max(v), "relative": vectors.relative_entropy(v, F.reverse(v))},
    {
        "pearson": f"{_cov} / list_sum(list_transform(v, lambda x: (x - list_avg(v)) ** 2))", "angle": "acos(greatest(-1, least(1, list_sum(list_transform(v, lambda x, i: x * v[n - i + 1])) / list_sum(list_transform(v, lambda x: x * x)))))",
        "second": "list_reverse_sort(v)[2]", "relative": _rel,
    },
)
_place = "least(floor((x - list_min(v)) / (list_max(v) - list_min(v)) * 4), 3)"
_vector_query("vec_energy_htk", lambda v: vectors.energy(v, sums=True, scale=0.5, bias=1.0), {"rms": "0.5 * sqrt(list_sum(list_transform(v, lambda x: x * x)) / n) + 1", "energy2": "0.5 * list_sum(list_transform(v, lambda x: x * x)) / n + 1", "log": "0.5 * ln(greatest(32767.0 * 32767.0 * list_sum(list_transform(v, lambda x: x * x)), 1)) + 1"})
_vector_query("vec_histogram", lambda v: {f"bin{k}": vectors.histogram(v, 4)[k] for k in range(4)}, {f"bin{k}": f"len(list_filter(v, lambda x: {_place} = {k})) / n" for k in range(4)})
_vector_query("vec_preemphasis_de", lambda v: {"y": _col_digest(vectors.preemphasised(v, de=True))}, {"y": _digest("list_transform(v, lambda x, i: CASE WHEN i = 1 THEN 0.03 * x ELSE x + 0.97 * v[i - 1] END)")})
_vector_query("vec_amdf_inverted", lambda v: {f"y{k}": F.element_at(vectors.amdf(v, 6, "limit", True), k + 1) for k in range(3)}, {f"y{k}": f"list_max(list_transform(range(0, 6), lambda k: list_sum(list_transform(range(1, n - k + 1), lambda i: abs(v[i] - v[i + k]))) / (n - k))) - list_sum(list_transform(range(1, n - {k} + 1), lambda i: abs(v[i] - v[i + {k}]))) / (n - {k})" for k in range(3)})
_vector_query("vec_window_options", lambda v: {"root": _col_digest(vectors.windowed(v, "hann", 64, square_root=True)), "gain": _col_digest(vectors.windowed(v, "sine", 64, 2.0, 0.5))}, {"root": _digest("list_transform(v, lambda x, i: x * sqrt(greatest(0.5 - 0.5 * cos(2 * pi() * (i - 1) / 63), 0)))"), "gain": _digest("list_transform(v, lambda x, i: x * 2 * sin(pi() * (i - 1) / 63) + 0.5)")})
_vector_query("vec_amplitude_zeropad", lambda v: {f"y{k}": F.element_at(vectors.amdf(v, 4, "zeropad"), k + 1) for k in range(4)}, {f"y{k}": f"list_sum(list_transform(range(1, n + 1), lambda i: abs(v[i] - CASE WHEN i + {k} <= n THEN v[i + {k}] ELSE 0 END))) / n" for k in range(4)})
_tone = lambda k: (55 * 2 ** (k / 12)) / 16000
_vector_query(
    "tone_filter_values",
    lambda v: {f"note{k}": kernels.on_frames(lambda a: kernels.tone_filter(a, 16000, 12, every=64)[0].tolist())(v)[k] for k in (0, 7)},
    {f"note{k}": f"10 * sqrt(list_sum(list_transform(v, lambda x, i: 0.002 * 0.998 ** (64 - i) * x * cos(2 * pi() * {_tone(k)} * (i - 1)))) ** 2 + list_sum(list_transform(v, lambda x, i: 0.002 * 0.998 ** (64 - i) * x * sin(2 * pi() * {_tone(k)} * (i - 1)))) ** 2)" for k in (0, 7)},
)


def _mag_query(name: str, cols, sql: dict[str, str]):
    def run(spark, d):
        return mags(spark, d).select("vec_id", *[r6(c.cast("double")).alias(k) for k, c in cols(F.col("m")).items()])

    query(name, f"WITH {_V}, {_MAG} SELECT vec_id, " + ", ".join(f"{s6(f'CAST({e} AS DOUBLE)')} AS {k}" for k, e in sql.items()) + " FROM m")(run)


_mag_query("harmonic_products_embeddings", lambda m: {"product": _col_digest(spectral.harmonic_product(m, 3)), "sum": _col_digest(spectral.harmonic_sum(m, 3))}, {"product": _digest("list_transform(range(0, 33), lambda k: CASE WHEN 3 * k < 33 THEN m[k + 1] * m[2 * k + 1] * m[3 * k + 1] ELSE 0 END)"), "sum": _digest("list_transform(range(0, 33), lambda k: m[k + 1] + coalesce(m[2 * k + 1], 0) + coalesce(m[3 * k + 1], 0))")})
_fr = "((i - 1) * 250)"


def _slope(a: int, b: int) -> str:
    at = [k for k, f in enumerate(_FREQ) if a <= f < b]
    n, sf, sff = len(at), sum(_FREQ[k] for k in at), sum(_FREQ[k] ** 2 for k in at)
    p = f"list_transform(m[{at[0] + 1}:{at[-1] + 1}], lambda x: x * x)"
    return f"({n} * list_sum(list_transform({p}, lambda x, i: x * (i - 1 + {at[0]}) * 250)) - {sf} * list_sum({p})) / {n * sff - sf * sf}"


_bark = f"(26.81 / (1 + 1960 / greatest({_fr}, 1e-9)) - 0.53)"
_sharp = f"0.11 * greatest(CASE WHEN {_fr} > 0 THEN {_bark} ELSE 0 END, 0) * CASE WHEN {_bark} <= 16 THEN 1 ELSE 0.066 * exp(0.171 * {_bark}) END"
_mag_query("spectral_slopes_embeddings", lambda m: {k: spectral.descriptors(m, _FREQ)[k] for k in ("slope", "slope_0_500", "slope_500_1500", "sharpness")}, {"slope": _slope(0, 9000), "slope_0_500": _slope(0, 500), "slope_500_1500": _slope(500, 1500), "sharpness": f"list_sum(list_transform(m, lambda x, i: x * x * {_sharp})) / {_ps}"})
_mag_query("power_db_embeddings", lambda m: {"y": _col_digest(spectral.power_db(m))}, {"y": _digest("list_transform(m, lambda x: greatest(10 * log10(greatest(x * x, 1e-30)) + 90.302, -102))")})
_s2 = f"({_fr} * {_fr} + 0.0)"
_mag_query("a_weighted_embeddings", lambda m: {"y": _col_digest(spectral.a_weighted(m, _FREQ))}, {"y": _digest(f"list_transform(m, lambda x, i: CASE WHEN i = 1 THEN 0 ELSE x * 10 ** ((20 * log10(12194.0 ** 2 * {_s2} * {_s2} / (({_s2} + 20.6 ** 2) * sqrt(({_s2} + 107.7 ** 2) * ({_s2} + 737.9 ** 2)) * ({_s2} + 12194.0 ** 2))) + 2.0) / 10) END)")})
_TONE = spectral.tonespec(33, 16000, 3)
_tones = "[" + ", ".join("list_sum(list_transform(m, lambda x, i: x * [" + ", ".join(repr(float(v)) for v in row) + "][i]))" for row in _TONE) + "]"


@query("tonespec_values", f"WITH {_V}, {_MAG} SELECT vec_id, CAST(unnest(range(0, 36)) AS INTEGER) AS note, {s6(f'unnest({_tones})')} AS level FROM m")
def _(spark, d):
    n = mags(spark, d).select("vec_id", F.posexplode(spectral.apply_matrix(F.col("m"), _TONE)).alias("note", "v"))
    return n.select("vec_id", "note", r6(F.col("v")).alias("level"))


_LM = f"{_V.replace('e AS (SELECT vec_id,', 'e AS (SELECT vec_id, label,')}, {_MAG.replace('m AS (SELECT vec_id,', 'm AS (SELECT vec_id, label,')}"


def labelled_mags(spark, d) -> DataFrame:
    v = table(spark, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return v.select("label", F.col("vec_id").alias("vidx"), spectral.magnitude("v").alias("m"))


@query("spectral_flux_embeddings", f"WITH {_LM}, u AS (SELECT label, vec_id, list_transform(m, lambda x: x / sqrt({_ps})) AS u FROM m), w AS (SELECT label, vec_id, u, lag(u) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM u) SELECT vec_id, {s6('CASE WHEN p IS NULL THEN 0 ELSE sqrt(list_sum(list_transform(u, lambda x, i: (x - p[i]) ** 2)) / 33) END')} AS flux FROM w")
def _(spark, d):
    m = graph.build([{"type": "flux", "reads": ["m"], "writes": "f", "options": {"field": "m"}}], {"m": labelled_mags(spark, d)}, keys=("label",))["f"]
    return m.select(F.col("vidx").alias("vec_id"), r6(F.col("m_flux")).alias("flux"))


_dif = "list_transform(m, lambda x, i: x - p[i])"


@query("spectral_differences_embeddings", f"WITH {_LM}, w AS (SELECT vec_id, m, lag(m) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM m) SELECT vec_id, {s6(f'CASE WHEN p IS NULL THEN 0 ELSE list_sum(list_transform({_dif}, lambda x: abs(x))) END')} AS diff, {s6(f'CASE WHEN p IS NULL THEN 0 ELSE list_sum(list_transform({_dif}, lambda x: greatest(x, 0))) END')} AS posdiff, {s6(f'CASE WHEN p IS NULL THEN 0 ELSE list_sum(list_transform({_dif}, lambda x, i: abs(x) * (i - 1) * 250)) / list_sum(list_transform({_dif}, lambda x: abs(x))) END')} AS fluxcentroid FROM w")
def _(spark, d):
    m = labelled_mags(spark, d).withColumn("p", F.lag("m").over(LABEL.ordered()))
    return m.select(F.col("vidx").alias("vec_id"), *[r6(c).alias(k) for k, c in spectral.differences(F.col("m"), F.col("p"), _FREQ).items()])


_q = " + ".join(f"CASE WHEN c > {t} THEN 1 ELSE 0 END" for t in (0.05, 0.1, 0.2, 0.4))


@query("cens_embeddings", f"""WITH b AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS vidx, embedding FROM embeddings),
    q AS (SELECT label, vidx, k, ({_q}) AS q FROM (SELECT label, vidx, unnest(range(1, 5)) AS k, abs(CAST(unnest(embedding[1:4]) AS DOUBLE)) AS c FROM b)),
    s AS (SELECT t.label, t.vidx, q.k, sum(q.q * (0.5 - 0.5 * cos(2 * pi() * (q.vidx - t.vidx + 5) / 10))) AS v FROM (SELECT label, vidx FROM b WHERE vidx % 3 = 0) t JOIN q ON q.label = t.label AND q.vidx BETWEEN t.vidx - 4 AND t.vidx + 4 GROUP BY 1, 2, 3)
    SELECT label, vidx, CAST(k - 1 AS INTEGER) AS bin, {s6('coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY label, vidx)), 0), 0)')} AS cens FROM s""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("label", (F.row_number().over(of_level("label").whole().orderBy("vec_id")) - 1).cast("long").alias("vidx"), F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x.cast("double"))).alias("c"))
    return windows.cens(LABEL, e, "c", 9, 3).select("label", "vidx", F.posexplode("c_cens").alias("bin", "y")).select("label", "vidx", "bin", r6(F.col("y")).alias("cens"))


@query("scales_inverse", f"SELECT p_partkey, {s6('700 * (exp(p_size / 10.0) - 1)')} AS mel, {s6('600 * sinh(p_size / 6.0)')} AS schroed, {s6('27.5 * 2 ** (p_size / 12.0)')} AS semitone, {s6('13.1 * atan(0.00074 * p_retailprice) + 2.24 * atan(p_retailprice ** 2 * 1.85e-8) + 1e-4 * p_retailprice')} AS speex FROM part")
def _(spark, d):
    z = F.col("p_size").cast("double")
    cols = {"mel": scales.SCALES["mel"][1](z * 112.7), "schroed": scales.SCALES["bark_schroed"][1](z), "semitone": scales.SCALES["semitone"][1](z), "speex": scales.SCALES["bark_speex"][0](F.col("p_retailprice"))}
    return table(spark, d, "part").select("p_partkey", *[r6(c).alias(k) for k, c in cols.items()])

# Linear prediction in SQL: the recursion's steps as one table after another.
def _levinson(source: str, keys: str, order: int) -> str:
    """p<order>(keys, a1.., e) from source (keys, r0..): prediction coefficients and residual energy."""
    out, was = [], source
    for m in range(1, order + 1):
        r = ", ".join(f"r{k}" for k in range(order + 1))
        own = "".join(f", a{j}" for j in range(1, m))
        e = "e" if m > 1 else "r0"
        k = f"-(r{m}" + "".join(f" + a{j} * r{m - j}" for j in range(1, m)) + f") / {e}"
        out.append(f"q{m} AS (SELECT {keys}, {r}{own}, {e} AS e0, {k} AS k FROM {was})")
        new = "".join(f", a{j} + k * a{m - j} AS a{j}" for j in range(1, m))
        out.append(f"p{m} AS (SELECT {keys}, {r}{new}, k AS a{m}, e0 * (1 - k * k) AS e FROM q{m})")
        was = f"p{m}"
    return ", ".join(out)


def _cepstrum(source: str, keys: str, order: int) -> str:
    """c<order>(keys, c0..) from source (keys, a1.., e)."""
    out, was = [f"c0 AS (SELECT *, ln(greatest(e, 1e-12)) AS c0 FROM {source})"], "c0"
    for n in range(1, order + 1):
        terms = "".join(f" - {k} / {n}.0 * c{k} * a{n - k}" for k in range(1, n))
        out.append(f"c{n} AS (SELECT *, -a{n}{terms} AS c{n} FROM {was})")
        was = f"c{n}"
    return ", ".join(out)


def _rows(source: str, keys: str, cols: list[str]) -> str:
    return f"SELECT {keys}, CAST(unnest(range(0, {len(cols)})) AS INTEGER) AS i, {s6('unnest([' + ', '.join(cols) + '])')} AS y FROM {source}"


_acf_of = lambda k: f"coalesce(list_sum(list_transform(range(1, CAST(len(v) - {k} + 1 AS BIGINT)), lambda i: v[i] * v[i + {k}])), 0)"
_SQL["func_lpc_events"] = f"""WITH {_E}, w AS (SELECT user_id, list(x ORDER BY vidx) AS v FROM e GROUP BY 1), r AS (SELECT user_id, len(v) AS n, {', '.join(f'{_acf_of(k)} AS r{k}' for k in range(6))} FROM w),
    {_levinson('r', 'user_id, n', 5)} SELECT user_id, CASE WHEN p5.e / n >= 0 THEN {s6('greatest(p5.e, 0) / n')} END AS x_lpgain, {', '.join(f"{s6(f'a{k + 1}')} AS x_lpc{k}" for k in range(5))} FROM p5"""
_LPC8 = f"r AS (SELECT vec_id, {', '.join(f'{_acf_of(k)} AS r{k}' for k in range(9))} FROM e), {_levinson('r', 'vec_id', 8)}"
_SQL["lpc_cepstrum_embeddings"] = f"WITH {_V}, {_LPC8}, {_cepstrum('p8', 'vec_id', 8)} {_rows('c8', 'vec_id', [f'c{k}' for k in range(9)])}"


def _burg(order: int) -> str:
    """b<order>(vec_id, a1..) by forward and backward errors f and b."""
    out, was = ["b0 AS (SELECT vec_id, v AS f, v AS b FROM e)"], "b0"
    for m in range(1, order + 1):
        own = "".join(f", a{j}" for j in range(1, m))
        out.append(f"s{m} AS (SELECT vec_id, f[2:] AS f, b[1:len(b) - 1] AS b{own} FROM {was})")
        out.append(f"k{m} AS (SELECT *, -2 * list_sum(list_transform(f, lambda x, i: x * b[i])) / (list_sum(list_transform(f, lambda x: x * x)) + list_sum(list_transform(b, lambda x: x * x))) AS k FROM s{m})")
        new = "".join(f", a{j} + k * a{m - j} AS a{j}" for j in range(1, m))
        out.append(f"b{m} AS (SELECT vec_id, list_transform(f, lambda x, i: x + k * b[i]) AS f, list_transform(b, lambda x, i: x + k * f[i]) AS b{new}, k AS a{m} FROM k{m})")
        was = f"b{m}"
    return ", ".join(out)


_SQL["burg_embeddings"] = f"WITH {_V}, {_burg(8)} {_rows('b8', 'vec_id', [f'a{k}' for k in range(1, 9)])}"
_mel_bands = "[" + ", ".join("list_sum(list_transform(m, lambda x, i: x * [" + ", ".join(repr(float(v)) for v in row) + "][i]))" for row in _MEL) + "]"
_f2 = [(200.0 * (k + 1)) ** 2 for k in range(12)]
_loud = [(f + 56.8e6) * f * f / ((f + 6.3e6) ** 2 * (f + 0.38e9)) for f in _f2]
_plp_acf = lambda k: f"(s[1] + s[12] * cos(pi() * {k}) + 2 * list_sum(list_transform(s, lambda x, i: x * cos(2 * pi() * i * {k} / 26)))) / 26"
_SQL["plp_embeddings"] = f"""WITH {_V}, {_MAG}, s AS (SELECT vec_id, list_transform({_mel_bands}, lambda x, i: (greatest(x, 1e-9) * {[x / max(_loud) for x in _loud]}[i]) ** 0.33) AS s FROM m),
    r AS (SELECT vec_id, {', '.join(f'{_plp_acf(k)} AS r{k}' for k in range(6))} FROM s), {_levinson('r', 'vec_id', 5)}, {_cepstrum('p5', 'vec_id', 5)} {_rows('c5', 'vec_id', [f'c{k}' for k in range(6)])}"""
# Harmonics of 500 Hz lie at every second bin; a harmonic is the nearer local maximum of two bins.
_peak_at = lambda k: f"(m[{k + 1}] >= m[{k}] AND m[{k + 1}] >= m[{k + 2}])"
_level = [f"CASE WHEN {_peak_at(2 * h)} THEN m[{2 * h + 1}]" + (f" WHEN {_peak_at(2 * h + 1)} THEN m[{2 * h + 2}]" if 2 * h + 1 < 32 else "") + " END" for h in range(1, 11)]
_db = [f"CASE WHEN l[1] IS NULL OR l[1] = 0 OR l[{h}] IS NULL THEN -201 ELSE greatest(20 * log10(greatest(l[{h}], 1e-12) / l[1]), -200) END" for h in range(1, 11)]
_SQL["harmonics_embeddings"] = f"WITH {_V}, {_MAG}, l AS (SELECT vec_id, [{', '.join(_level)}] AS l FROM m) {_rows('l', 'vec_id', _db)}"
_note = lambda k: f"10 * sqrt(list_sum(list_transform(v, lambda x, i: 0.002 * 0.998 ** (64 - i) * x * cos(2 * pi() * {_tone(k)} * (i - 1)))) ** 2 + list_sum(list_transform(v, lambda x, i: 0.002 * 0.998 ** (64 - i) * x * sin(2 * pi() * {_tone(k)} * (i - 1)))) ** 2)"
_SQL["tone_filter_embeddings"] = f"WITH {_V} {_rows('e', 'vec_id', [_note(k) for k in range(12)])}"
_SQL["tonespec_embeddings"] = f"WITH {_V}, {_MAG} " + _rows("m", "vec_id", ["list_sum(list_transform(m, lambda x, i: x * [" + ", ".join(repr(float(v)) for v in row) + "][i]))" for row in spectral.tonespec(33, 16000)])
# Half the rate: the first 17 of 33 bins, turned back to 32 values.
_re = "list_sum(list_transform(v, lambda x, i: x * cos(2 * pi() * k * (i - 1) / 64)))"
_im = "-list_sum(list_transform(v, lambda x, i: x * sin(2 * pi() * k * (i - 1) / 64)))"
_SQL["resample_embeddings"] = f"""WITH {_V}, z AS (SELECT vec_id, list_transform(range(0, 17), lambda k: {_re}) AS re, list_transform(range(0, 17), lambda k: {_im}) AS im FROM e), u AS (SELECT vec_id, re, im, unnest(range(0, 32)) AS t FROM z)
    SELECT vec_id, CAST(t AS INTEGER) AS i, {s6('(re[1] + re[17] * cos(pi() * t) + 2 * list_sum(list_transform(range(1, 16), lambda k: re[k + 1] * cos(2 * pi() * k * t / 32) - im[k + 1] * sin(2 * pi() * k * t / 32)))) / 64')} AS y FROM u"""


# Models.
_W = [((k * 37) % 11 - 5) / 10 for k in range(64)]
_dec = f"(list_sum(list_transform(v, lambda x, i: x * {_W}[i])) + 0.1)"
_vector_query("svm_coupled_embeddings", lambda v: models.coupled(v, [("a", "b", _W, 0.1, 0.2, 1.5)]), {"a": f"1 - 1 / (1 + exp(-(0.2 + 1.5 * {_dec})))", "b": f"1 / (1 + exp(-(0.2 + 1.5 * {_dec})))"})
_vector_query("svm_platt_embeddings", lambda v: {"p": models.platt(models.svm_decision(v, _W, 0.1), 0.2, 1.5)}, {"p": f"1 / (1 + exp(-(0.2 + 1.5 * {_dec})))"})
_SV = [[((k * 7 + s * 13) % 9 - 4) / 20 for k in range(64)] for s in range(3)]
_MODEL = "svm_type c_svc\nkernel_type rbf\ngamma 0.1\nnr_class 2\ntotal_sv 3\nrho 0.05\nlabel 1 2\nnr_sv 2 1\nSV\n" + "\n".join(f"{c} " + " ".join(f"{k + 1}:{x}" for k, x in enumerate(sv)) for c, sv in zip((0.7, 0.4, -1.1), _SV))
_rbf = [f"exp(-0.1 * list_sum(list_transform(v, lambda x, i: (x - {sv}[i]) ** 2)))" for sv in _SV]


@query("kernel_svm_embeddings", f"WITH {_V} SELECT vec_id, CASE WHEN 0.7 * {_rbf[0]} + 0.4 * {_rbf[1]} - 1.1 * {_rbf[2]} - 0.05 > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END AS class FROM e")
def _(spark, d):
    return frames(spark, d).select("vec_id", models.kernel_svm(F.col("v"), models.parse_libsvm(_MODEL, 64)).alias("class"))


_vector_query("scaled_features_embeddings", lambda v: {"y": _col_digest(models.scaled(v, [(-0.5, 0.5), (0.0, 0.0), (-1.0, 3.0)], chosen=[0, 5, 9]))}, {"y": "1 * (-1 + 2 * (v[1] + 0.5)) + 2 * 0 + 3 * (-1 + 2 * (v[10] + 1) / 4)"})


@query("net_labels_embeddings", f"WITH {_V} SELECT vec_id, CASE WHEN v[1] >= v[2] AND v[1] >= v[3] THEN 'a' WHEN v[2] >= v[3] THEN 'b' ELSE 'c' END AS label FROM e")
def _(spark, d):
    return frames(spark, d).select("vec_id", models.labelled(F.slice("v", 1, 3), ["a", "b", "c"]).alias("label"))


# Sources.
@query("signal_source", f"SELECT vidx, {s6('vidx * 0.01')} AS time, {s6('sin(2 * pi() * 3 * vidx * 0.01)')} AS x FROM (SELECT unnest(range(0, 250)) AS vidx)")
def _(spark, d):
    plugins.register(spark)
    s = spark.read.format("wavelathe_signal").option("rows", "250").option("frequency", "3").load()
    return s.select("vidx", r6(F.col("time")).alias("time"), r6(F.col("x")).alias("x"))


@query("pushed_rows", "SELECT vidx, CAST(vidx AS DOUBLE) AS a, CAST(vidx * 2 + vidx * 3 AS DOUBLE) AS s FROM (SELECT unnest(range(0, 20)) AS vidx)")
def _(spark, d):
    p = plugins.pushed(spark, [[i, i * 2, i * 3] for i in range(20)], {"a": 1, "b": 2}, 0.05)
    return p.select("vidx", "a", vectors.total(F.col("b")).alias("s"))

