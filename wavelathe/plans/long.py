"""Queries of long series: the whole of a table as one series in blocks, and machines along series that span blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import functionals as fn
from ..functions import spectral
from ..operators import blocks, contours, models, paths, windows
from ..operators.blocks import Blocks
from ..series import Series, of_level
from .catalog import _E, _MAG, _MEL, _SQL_SETS, _V, _mel_sql, _rounded, events, mags, nine, query, r6, s6, s9, table
from .more import _TURNS, _cepstrum, _levinson, _loud, _plp_acf, _rows, _stepped

LINE = Blocks(("line",), 4096)
USERS = Blocks(("user_id",), 64)  # a user has 49 to 86 events, so many span two blocks


def line(spark, d) -> DataFrame:
    """All rows of lineitem as one series by date."""
    t = table(spark, d, "lineitem").withColumn("line", F.lit(0))
    return blocks.numbered(t, Series(("line",), ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")), {"x": F.col("l_extendedprice").cast("double")})


_LINE = "e AS (SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS vidx, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem)"


def _at(k: int) -> str:
    """x of the row k places on, edges repeated."""
    if not k:
        return "x"
    return f"coalesce({'lead' if k > 0 else 'lag'}(x, {abs(k)}) OVER o, {'last_value' if k > 0 else 'first_value'}(x) OVER w)"


@query("long_contours_lineitem", f"""WITH {_LINE} SELECT vidx, {s6(f"({_at(-1)} + x + {_at(1)}) / 3")} AS sma, {s6(f"({_at(1)} - {_at(-1)} + 2 * ({_at(2)} - {_at(-2)})) / 10")} AS delta,
    {s6("median(x) OVER (ORDER BY vidx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")} AS med, {s6(f"x - 0.97 * {_at(-1)}")} AS pre
    FROM e WINDOW o AS (ORDER BY vidx), w AS (ORDER BY vidx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def _(spark, d):
    make = {"sma": lambda s: windows.sma(s, "x"), "delta": lambda s: windows.delta(s, "x"), "med": lambda s: windows.running_median(s, "x", 5), "pre": lambda s: windows.preemphasis(s, "x")}
    out = LINE.windowed(line(spark, d), make, 2, 2)
    return out.select("vidx", *[r6(F.col(c)).alias(c) for c in make])


@query("long_frames_lineitem", f"""WITH {_LINE}, g AS (SELECT x, unnest(range(CAST(greatest(0, ceil((vidx - 399) / 160.0)) AS BIGINT), CAST(floor(vidx / 160.0) AS BIGINT) + 1)) AS segment FROM e)
    SELECT segment, {s6('max(x)')} AS top, {s6('min(x)')} AS bottom, {s6('sqrt(avg(x * x)) / 1000')} AS rms FROM g GROUP BY segment HAVING count(*) = 400""")
def _(spark, d):
    out = LINE.frames(line(spark, d), "x", 400, 160)
    rms = F.sqrt(F.aggregate("frame", F.lit(0.0), lambda a, v: a + v * v) / 400) / 1000
    return out.select("segment", r6(F.array_max("frame")).alias("top"), r6(F.array_min("frame")).alias("bottom"), r6(rms).alias("rms"))


_SETS = ["extremes", "means", "moments", "percentiles", "crossings", "samples", "times", "dct"]
_columns = {c: e for s in _SETS for c, e in _SQL_SETS[s].items()}
_large = {c for c in _columns if c.endswith(("variance", "qmean")) or c.startswith("dct")}


@query("long_functionals_lineitem", f"""WITH {_LINE}, b AS (SELECT x, CAST(vidx AS DOUBLE) AS i, CAST(count(*) OVER () AS DOUBLE) AS n, min(x) OVER () AS lo, max(x) OVER () AS hi, avg(x) OVER () AS mu, lag(x) OVER (ORDER BY vidx) AS was, lead(x) OVER (ORDER BY vidx) AS will FROM e),
    f AS (SELECT {', '.join(f'CAST({e} AS DOUBLE) AS x_{c}' for c, e in _columns.items())} FROM b)
    SELECT {', '.join(f'{s9(f"x_{c}") if c in _large else s6(f"x_{c}")} AS x_{c}' for c in _columns)} FROM f""")
def _(spark, d):
    out = fn.functionals(line(spark, d), ["line"], ["vidx"], "x", _SETS, blocks=LINE)
    return out.select(*[(nine if c in _large else r6)(F.col(f"x_{c}")).alias(f"x_{c}") for c in _columns])


@query("long_running_mvn_lineitem", f"""WITH {_LINE} SELECT vidx, {s6("(x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-7)")} AS x_mvn FROM e WINDOW w AS (ORDER BY vidx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return LINE.running_mvn(line(spark, d), "x").select("vidx", r6(F.col("x_mvn")).alias("x_mvn"))


query("long_turns_events", f"{_TURNS} SELECT user_id, segment, start, stop FROM turns")(lambda spark, d: blocks.turns(events(spark, d), USERS, "x", 50.0, 45.0, 1, 2))


# -- Contour functionals ---------------------------------------------------


@query("func_onset_two_thresholds_events", f"""WITH RECURSIVE {_E}, {_stepped("abs(x) > 60, abs(x) > 60, false", "CASE WHEN r.s THEN abs(n.x) > 40 ELSE abs(n.x) > 60 END, NOT r.s AND abs(n.x) > 60, r.s AND abs(n.x) <= 40", "s, up, down")}
    SELECT user_id, CAST(coalesce(min(vidx) FILTER (up), 0) AS DOUBLE) + 0 AS x_onsetpos, CAST(coalesce(max(vidx) FILTER (down), 0) AS DOUBLE) + 0 AS x_offsetpos, CAST(count(*) FILTER (up) AS DOUBLE) AS x_numonsets,
    CAST(count(*) FILTER (down) AS DOUBLE) AS x_numoffsets, {s6('CAST(count(*) FILTER (up) AS DOUBLE) / count(*)')} AS x_onsetrate FROM r GROUP BY user_id""")
def _(spark, d):
    return _rounded(contours.onsets(events(spark, d), USERS, "x", 60.0, 40.0), ["user_id"])


# A peak begins where a local maximum (of the row before) is over the last minimum by 0.11 of the range, and ends 0.09 below its highest maximum.
_w = "(PARTITION BY user_id)"
_o = "(PARTITION BY user_id ORDER BY vidx)"
_up, _down = "coalesce(n.pp < n.p AND n.p > n.x, false)", "coalesce(n.pp > n.p AND n.p < n.x, false)"
_now = f"CASE WHEN {_up} AND r.peak IS NULL AND n.p - r.low > 0.11 * n.span THEN n.p WHEN {_up} AND n.p > r.peak THEN n.p ELSE r.peak END"
_spot = f"CASE WHEN {_up} AND ((r.peak IS NULL AND n.p - r.low > 0.11 * n.span) OR n.p > r.peak) THEN n.vidx - 1 ELSE r.spot END"
_over = f"coalesce(n.x < ({_now}) - 0.09 * n.span OR (n.vidx = n.n - 1 AND ({_now}) IS NOT NULL), false)"


@query("func_peaks_events", f"""WITH RECURSIVE {_E.replace('e AS', 'e0 AS', 1)}, e AS (SELECT user_id, vidx, x, lag(x) OVER {_o} AS p, lag(x, 2) OVER {_o} AS pp, max(x) OVER {_w} - min(x) OVER {_w} AS span, count(*) OVER {_w} AS n FROM e0),
    {_stepped("CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE)", f"CASE WHEN {_down} THEN n.p ELSE r.low END, CASE WHEN {_over} THEN NULL ELSE {_now} END, CASE WHEN {_over} THEN NULL ELSE {_spot} END, CASE WHEN {_over} THEN {_spot} END, CASE WHEN {_over} THEN {_now} END", "low, peak, spot, place, height")},
    k AS (SELECT user_id, height, place - lag(place) OVER (PARTITION BY user_id ORDER BY place) AS dist FROM r WHERE place IS NOT NULL),
    s AS (SELECT user_id, count(*) AS c, avg(dist) AS d, avg(height) AS h, stddev_pop(dist) AS sd FROM k GROUP BY user_id), a AS (SELECT user_id, count(*) AS n, avg(x) AS mu FROM e GROUP BY user_id)
    SELECT user_id, CAST(coalesce(c, 0) AS DOUBLE) AS x_numpeaks, {s6('coalesce(d, n + 1)')} AS x_meanpeakdist, {s6('coalesce(h, 0)')} AS x_peakmean, {s6('coalesce(h, 0) - mu')} AS x_peakmeanmeandist, {s6('coalesce(sd, 0)')} AS x_peakdiststddev FROM a LEFT JOIN s USING (user_id)""")
def _(spark, d):
    return _rounded(contours.peaks(events(spark, d), USERS, "x"), ["user_id"])


@query("func_peaks2_events")
def _(spark, d):
    return _rounded(contours.peaks2(events(spark, d), USERS, "x"), ["user_id"])


# Segments: statistics of the first 20 lengths, lengths as shares of the series.
_STATS = f"""c AS (SELECT user_id, len, row_number() OVER (PARTITION BY user_id ORDER BY vidx) AS k FROM r WHERE len IS NOT NULL),
    s AS (SELECT user_id, count(*) AS c, avg(len) AS a, max(len) AS hi, min(len) AS lo, stddev_pop(len) AS sd FROM c WHERE k <= 20 GROUP BY user_id), z AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id)
    SELECT user_id, {s6('coalesce(c, 0) / 20.0')} AS x_numsegments, {s6('coalesce(a, 0) / n')} AS x_meanseglen, {s6('CAST(coalesce(hi, 0) AS DOUBLE) / n')} AS x_maxseglen, {s6('CAST(coalesce(lo, 0) AS DOUBLE) / n')} AS x_minseglen, {s6('coalesce(sd, 0) / n')} AS x_seglenstddev FROM z LEFT JOIN s USING (user_id)"""
_SPAN = f"m AS (SELECT *, count(*) OVER {_w} AS n, max(x) OVER {_w} - min(x) OVER {_w} AS span, min(x) OVER {_w} AS lo, avg(x) OVER {_w} AS mu FROM e0), g AS (SELECT *, greatest(n // 20 - 1, 2) AS least, n // 10 AS width FROM m)"
_spaced = _stepped("-(least // 2), CAST(NULL AS BIGINT)", "CASE WHEN n.hit AND n.vidx - r.last > n.least THEN n.vidx ELSE r.last END, CASE WHEN n.hit AND n.vidx - r.last > n.least THEN n.vidx - r.last END", "last, len")
_head = f"WITH RECURSIVE {_E.replace('e AS', 'e0 AS', 1)}, {_SPAN}"
_mean = "h AS (SELECT a.user_id, a.vidx, any_value(a.x) AS x, any_value(a.span) AS span, any_value(a.least) AS least, any_value(a.x) - avg(b.x) AS over FROM g a LEFT JOIN g b ON a.user_id = b.user_id AND b.vidx BETWEEN a.vidx - a.width + 1 AND a.vidx GROUP BY 1, 2)"
_three = f"h AS (SELECT *, avg(x) OVER (PARTITION BY user_id ORDER BY vidx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS now, avg(x) OVER (PARTITION BY user_id ORDER BY vidx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS was, lag(x) OVER {_o} AS p FROM g)"


def _through(now: str, was: str, *at: str) -> str:
    return "coalesce(" + " OR ".join(f"({now} > {t} AND {was} <= {t}) OR ({now} < {t} AND {was} >= {t})" for t in at) + ", false)"


for _name, _args, _frames, _hit in (
    ("delta", {}, _mean, "coalesce(over > 0.2 * span, false)"),
    ("delt2", {}, _mean, f"coalesce(over > 0.2 * span AND lag(over) OVER {_o} <= 0.2 * span, false)"),
    ("relth", {"thresholds": (0.25, 0.75)}, _three, _through("now", "was", "(lo + span * 0.25)", "(lo + span * 0.75)")),
    ("mrelth", {"thresholds": (1.0,)}, _three, _through("now", "was", "(mu * 1.0)")),
    ("absth", {"thresholds": (50.0,)}, _three, _through("now", "was", "50.0")),
    ("narelth", {"thresholds": (0.5,)}, _three, _through("x", "p", "(lo + span * 0.5)")),
    ("naabsth", {"thresholds": (30.0, 70.0)}, _three, _through("x", "p", "30.0", "70.0")),
):

    def _run(spark, d, kind=_name, args=_args):
        return _rounded(contours.segments(events(spark, d).select("user_id", "vidx", "x"), USERS, "x", kind, **args), ["user_id"])

    query("func_threshold_segments_events" if _name == "delta" else f"func_segments_{_name}_events", f"{_head}, {_frames}, e AS (SELECT user_id, vidx, x, least, {_hit} AS hit FROM h), {_spaced}, {_STATS}")(_run)


# Regions of a contour of ones and zeros: phases 0 out, 1 a beginning, 2 in, 3 a beginning of the other; run, gap, and where the last two began.
def _machine(rules: list[tuple[str, str, str, str, str, str, str]], end: str) -> str:
    """Rules (condition, phase, run, gap, a, b, len) of the state r and the row n; end gives the length at a series' last row."""
    pick = lambda k, other: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[k]}" for r in rules) + f" ELSE {other} END"
    first = "CASE WHEN hit THEN 1 ELSE 0 END, CASE WHEN hit THEN 1 ELSE 0 END, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT)"
    step = f"{pick(1, 'r.phase')}, {pick(2, 'r.run')}, {pick(3, 'r.gap')}, {pick(4, 'r.a')}, {pick(5, 'r.b')}, {pick(6, 'NULL')}"
    e = f"e AS (SELECT user_id, vidx, CASE WHEN x > 50 THEN 1.0 ELSE 0.0 END AS x, {{hit}} AS hit, count(*) OVER {_w} AS n FROM e0)"
    found = _stepped(first, step, "phase, run, gap, a, b, len").replace("r(", "r0(", 1).replace("FROM r JOIN", "FROM r0 r JOIN")
    last = f"r AS (SELECT user_id, vidx, len FROM r0 WHERE len >= 0 UNION ALL SELECT user_id, vidx + 1, len FROM (SELECT user_id, vidx, {end} AS len FROM (SELECT r0.* EXCLUDE (len), n FROM r0 JOIN e USING (user_id, vidx)) q WHERE vidx = n - 1) WHERE len >= 0)"
    return f"WITH RECURSIVE {_E.replace('e AS', 'e0 AS', 1)}, {e}, {found}, {last}, {_STATS}"


_region = _machine([
    ("n.hit AND r.phase = 0", "1", "1", "0", "n.vidx", "r.b", "NULL"), ("n.hit AND r.phase = 1 AND r.run + 1 >= 3", "2", "0", "0", "r.a", "r.b", "NULL"),
    ("n.hit AND r.phase = 1", "1", "r.run + 1", "0", "r.a", "r.b", "NULL"), ("n.hit", "2", "0", "0", "r.a", "r.b", "NULL"),
    ("r.phase > 0 AND r.gap + 1 >= 2", "0", "0", "0", "r.a", "r.b", "CASE WHEN r.phase = 2 THEN n.vidx - 2 - r.a END"), ("r.phase > 0", "r.phase", "r.run", "r.gap + 1", "r.a", "r.b", "NULL"),
], "CASE WHEN phase = 2 THEN n - 1 - gap - a END")
_both = _machine([
    ("n.hit AND r.phase = 0", "1", "1", "0", "n.vidx", "r.b", "NULL"), ("n.hit AND r.phase = 1 AND r.run + 1 >= 3", "2", "0", "0", "r.a", "r.b", "r.a - 1 - r.b"),
    ("n.hit AND r.phase = 1", "1", "r.run + 1", "0", "r.a", "r.b", "NULL"), ("n.hit AND r.phase = 2", "2", "0", "0", "r.a", "r.b", "NULL"),
    ("n.hit AND r.run + 1 >= 3", "2", "0", "0", "r.a", "r.b", "NULL"), ("n.hit", "3", "r.run + 1", "r.gap", "r.a", "r.b", "NULL"),
    ("r.phase = 1 AND r.gap + 1 >= 2", "0", "0", "0", "r.a", "r.b", "NULL"), ("r.phase = 1", "1", "r.run", "r.gap + 1", "r.a", "r.b", "NULL"),
    ("r.phase = 2", "3", "0", "1", "r.a", "n.vidx", "NULL"), ("r.phase = 3 AND r.gap + 1 >= 3", "0", "0", "0", "r.a", "r.b", "r.b - 1 - r.a"), ("r.phase = 3", "3", "0", "r.gap + 1", "r.a", "r.b", "NULL"),
], "CASE WHEN phase = 2 THEN n - 1 - a WHEN phase = 0 THEN n - 1 - b END")
for _name, _sql in (("nonx", _region.format(hit="x > 50")), ("eqx", _region.format(hit="NOT x > 50")), ("chx", _both.format(hit="x > 50"))):

    def _run(spark, d, kind=_name):
        e = events(spark, d).select("user_id", "vidx", F.when(F.col("x") > 50, 1.0).otherwise(0.0).alias("x"))
        return _rounded(contours.segments(e, USERS, "x", kind, value=0.0), ["user_id"])

    query(f"func_segments_{_name}_events", _sql)(_run)


def _shape_sql(by: str, end: str, unit: str, low: str) -> str:
    """The parabola's vertex, ends and slopes, from sums about the middle."""
    v = lambda e: f"(({e}) - {low}) * {unit}"
    return f"""WITH {_E}, m AS (SELECT user_id, vidx, x, vidx - avg(vidx) OVER {_w} AS t, count(*) OVER {_w} AS n, min(x) OVER {_w} AS lo, max(x) OVER {_w} AS hi FROM e),
    k AS (SELECT user_id, n, lo, hi, sum(t * t) AS s2, sum(t ** 4) AS s4, sum(x) AS y0, sum(t * x) AS y1, sum(t * t * x) AS y2, min(vidx - t) AS mid FROM m GROUP BY ALL),
    p AS (SELECT *, (n * y2 - s2 * y0) / (n * s4 - s2 * s2) AS a, y1 / s2 AS d, (s4 * y0 - s2 * y2) / (n * s4 - s2 * s2) AS g FROM k),
    q AS (SELECT *, d - 2 * a * mid AS b, a * mid * mid - d * mid + g AS c FROM p), z AS (SELECT *, greatest(least(-b / (2 * a), n), -n) / {by} AS px, c - b * b / (4 * a) AS py, a * (n - 1) ** 2 + b * (n - 1) + c AS pr FROM q),
    r AS (SELECT m.user_id, avg(abs(m.x - a * (vidx ** 2) - b * vidx - c)) AS ea FROM m JOIN z USING (user_id) GROUP BY 1)
    SELECT user_id, {s6(f'd * {by} * {unit}')} AS x_linregc1, {s6(f'a * {by} * {by} * {unit}')} AS x_qregc1, {s6(f'b * {by} * {unit}')} AS x_qregc2, {s6(v('c'))} AS x_qregc3, {s6(f'ea * {unit}')} AS x_qregerra, {s6('px')} AS x_qregx0, {s6(v('py'))} AS x_qregy0, {s6(v('pr'))} AS x_qregyr,
    {s6(f"CASE WHEN px > 0 THEN ({v('py')} - {v('c')}) / px ELSE 0 END")} AS x_qregls, {s6(f"CASE WHEN px < {end} THEN ({v('pr')} - {v('py')}) / ({end} - px) ELSE 0 END")} AS x_qregrs, {s6('py')} AS x_qregy0nn, {s6('c')} AS x_qregc3nn, {s6('pr')} AS x_qregyrnn FROM z JOIN r USING (user_id)"""


_SHAPE = "linregc1 qregc1 qregc2 qregc3 qregerra qregx0 qregy0 qregyr qregls qregrs qregy0nn qregc3nn qregyrnn".split()
for _name, _args, _sql in (
    ("shape", {}, _shape_sql("1", "(n - 1)", "1", "0")), ("shape_segment", {"coefficients": "segment", "inputs": True}, _shape_sql("(n - 1)", "1", "(1 / (hi - lo))", "lo")),
    ("shape_second", {"coefficients": "second", "period": 0.01}, _shape_sql("100.0", "((n - 1) / 100.0)", "1", "0")),
):

    def _run(spark, d, args=_args):
        out = fn.functionals(events(spark, d), ["user_id"], ["vidx"], "x", {"regression": args})
        return _rounded(out.select("user_id", *[f"x_{c}" for c in _SHAPE]), ["user_id"])

    query(f"func_{_name}_events", _sql)(_run)


@query("func_lpc_events")
def _(spark, d):
    return _rounded(contours.linear_prediction(events(spark, d), USERS, "x"), ["user_id"])


_MOD = {"period": 0.1, "size": 2.0, "resolution": 0.5, "low": 0.5, "high": 4.0}
_rows_, _points, _spots = contours.modulation_bins(**_MOD)
_bins = sorted({k for a, c, _ in _spots for k in (a, c)})
_wave = lambda f, k: f"sum(h * (x - mu) * {f}(2 * pi() * {k} * j / {_points}))"


@query("func_modulation_events", f"""WITH {_E}, m AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e), g AS (SELECT user_id, x, vidx, n, unnest(range(CAST(greatest(0, ceil((vidx - {_rows_} + 1) / 10.0)) AS BIGINT), CAST(floor(vidx / 10.0) AS BIGINT) + 1)) AS k FROM m),
    w AS (SELECT user_id, k, x, vidx - k * 10 AS j, least({_rows_}, n - k * 10) AS len FROM g), f AS (SELECT user_id, k, j, x, 0.54 - 0.46 * cos(2 * pi() * j / nullif(len - 1, 0)) AS h0, avg(x) OVER (PARTITION BY user_id, k) AS mu FROM w WHERE k = 0 OR len > {2 * _rows_ / 3}),
    b AS (SELECT user_id, k, {', '.join(f'sqrt({_wave("cos", k)} ** 2 + {_wave("sin", k)} ** 2) AS b{k}' for k in _bins)} FROM (SELECT *, coalesce(h0, 1) AS h FROM f) GROUP BY user_id, k)
    SELECT user_id, {', '.join(f'{s6(f"avg(b{a} * {1 - w!r} + b{c} * {w!r})")} AS x_mod{i}' for i, (a, c, w) in enumerate(_spots))} FROM b GROUP BY user_id""")
def _(spark, d):
    return _rounded(contours.modulation(events(spark, d), USERS, "x", step=1.0, **_MOD), ["user_id"])


# -- RASTA -----------------------------------------------------------------

_RASTA_TAPS, _RASTA_POLE = blocks.rasta_filter(0.01)
_CENTRES = [200.0 * (k + 1) for k in range(12)]


def rasta_bands(spark, d) -> DataFrame:
    """Per label, in the order of vec_id: log bands, filtered along the rows."""
    bands = spectral.apply_matrix(F.col("m"), _MEL)
    rows = mags(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").select("label", "vec_id", bands.alias("bands"))
    level = blocks.numbered(rows, Series(("label",), ("vec_id",)), {"vec_id": "vec_id", "bands": F.transform("bands", lambda x: F.ln(F.greatest(x, F.lit(1e-8))))})
    return blocks.rasta(level, Blocks(("label",), 32), "bands", _RASTA_TAPS, _RASTA_POLE, quiet=4)


_slope = " + ".join(f"{c!r} * list_extract({f'coalesce(lag(b, {k}) OVER o, first_value(b) OVER w)' if k else 'b'}, CAST(j AS BIGINT))" for k, c in enumerate(_RASTA_TAPS) if c)
_RASTA = f"""WITH RECURSIVE {_V}, {_MAG}, l AS (SELECT m.vec_id, x.label, list_transform({_mel_sql}, lambda x: ln(greatest(x, 1e-8))) AS b FROM m JOIN embeddings x USING (vec_id)),
    t AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS vidx, b FROM l),
    u AS (SELECT label, vec_id, vidx, j, {_slope} AS v FROM t, range(1, 13) z(j) WINDOW o AS (PARTITION BY label, j ORDER BY vidx), w AS (PARTITION BY label, j ORDER BY vidx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    y(label, vec_id, vidx, j, y) AS (SELECT label, vec_id, vidx, j, v FROM u WHERE vidx = 0 UNION ALL SELECT u.label, u.vec_id, u.vidx, u.j, {_RASTA_POLE!r} * y.y + u.v FROM y JOIN u ON u.label = y.label AND u.j = y.j AND u.vidx = y.vidx + 1),
    f AS (SELECT vec_id, j, CASE WHEN vidx < 4 THEN 0 ELSE y END AS y FROM y)"""


@query("rasta_embeddings", f"{_RASTA} SELECT vec_id, CAST(j - 1 AS INTEGER) AS i, {s6('y')} AS y FROM f")
def _(spark, d):
    return rasta_bands(spark, d).select("vec_id", F.posexplode("rasta").alias("i", "y")).select("vec_id", "i", r6(F.col("y")).alias("y"))


@query("rasta_plp_embeddings", f"""{_RASTA}, s AS (SELECT vec_id, list_transform(list(exp(y) ORDER BY j), lambda x, i: (greatest(x, 1e-9) * {[x / max(_loud) for x in _loud]}[i]) ** 0.33) AS s FROM f GROUP BY vec_id),
    r AS (SELECT vec_id, {', '.join(f'{_plp_acf(k)} AS r{k}' for k in range(6))} FROM s), {_levinson('r', 'vec_id', 5)}, {_cepstrum('p5', 'vec_id', 5)} {_rows('c5', 'vec_id', [f'c{k}' for k in range(6)])}""")
def _(spark, d):
    bands = F.transform("rasta", lambda v: F.exp(v))
    out = rasta_bands(spark, d).select("vec_id", F.posexplode(spectral.plp(bands, _CENTRES)).alias("i", "y"))
    return out.select("vec_id", "i", r6(F.col("y")).alias("y"))


# -- Pitch paths -----------------------------------------------------------


def pitch_paths(spark, d) -> DataFrame:
    """Three candidates a row, a value, its double and its half, of which the value is not always the likeliest; and the cheapest path."""
    x, f = F.col("x"), 100 + F.abs(F.col("x"))
    over = lambda t, a, b: F.when(x > t, a).otherwise(b)
    rows = events(spark, d).select("user_id", "vidx", F.array(f, 2 * f, 50 + F.abs(x) / 2).alias("f"), F.array(over(30, 0.9, 0.3), over(30, 0.8, 0.2), over(70, 0.95, 0.1)).alias("v"))
    return paths.cheapest_path(rows, USERS, "f", "v")


@query("viterbi_pitch_events")
def _(spark, d):
    s = of_level("user_id")
    path = pitch_paths(spark, d).withColumn("f1", windows.without_spikes(s, "f0final"))
    path = path.withColumn("f2", windows.smoothed_formant(s, "f1", "f1", 3))
    out = path.groupBy("user_id").agg(F.coalesce(F.avg(F.when(F.col("f2") > 0, F.col("f2"))), F.lit(0.0)).alias("x_meanf0"), F.avg(F.when(F.col("f2") > 0, 1.0).otherwise(0.0)).alias("x_voiced"))
    return _rounded(out, ["user_id"])


_pair = "(z // 4 + 1)", "(z % 4 + 1)"  # of z, a pair (before, now) of candidates
_both = f"r.f[{_pair[0]}] > 0 AND n.f[{_pair[1]}] > 0"
_ratio = f"ln(n.f[{_pair[1]}] / nullif(r.f[{_pair[0]}], 0))"
_bend = f"CASE WHEN {_both} THEN 10 * abs({_ratio}) + 5 * abs({_ratio} - r.ch[i * 4 + z // 4 + 1]) WHEN r.f[{_pair[0]}] = 0 AND n.f[{_pair[1]}] = 0 THEN 0 ELSE 10 END"


@query("viterbi_price_events", f"""WITH RECURSIVE {_E.replace('e AS', 'e0 AS', 1)},
    c AS (SELECT user_id, vidx, x, [100 + abs(x), 200 + 2 * abs(x), 50 + abs(x) / 2] AS g, [CASE WHEN x > 30 THEN 0.9 ELSE 0.3 END::DOUBLE, CASE WHEN x > 30 THEN 0.8 ELSE 0.2 END::DOUBLE, CASE WHEN x > 70 THEN 0.95 ELSE 0.1 END::DOUBLE] AS v FROM e0),
    e AS (SELECT user_id, vidx, x, list_append(g, 0.0::DOUBLE) AS f, list_append(list_transform(v, lambda q, i: -2 * ln(q) + CASE WHEN q < 0.7 THEN 1 ELSE 0 END + CASE WHEN g[i] < 100 OR g[i] > 350 THEN 1 ELSE 0 END), -2 * ln(greatest(1 - list_max(v), 1e-6))) AS loc FROM c),
    {_stepped("f, list_transform(range(16), lambda z: CASE WHEN z >= 12 THEN loc[z - 11] ELSE 1e300 END), list_transform(range(16), lambda z: 0.0::DOUBLE)", f"n.f, list_transform(range(16), lambda z: list_min(list_transform(range(4), lambda i: r.cost[i * 4 + z // 4 + 1] + {_bend})) + n.loc[{_pair[1]}]), list_transform(range(16), lambda z: CASE WHEN {_both} THEN {_ratio} ELSE 0 END)", "f, cost, ch")}
    SELECT user_id, {s6('list_min(arg_max(cost, vidx))')} AS price FROM r GROUP BY user_id""")
def _(spark, d):
    """What the chosen path costs; the SQL has the least that any path costs."""
    w = of_level("user_id").ordered()
    f, at = F.col("f0final"), F.array_position("f", F.col("f0final")).cast("int")
    q = F.when(f > 0, F.get("v", at - 1)).otherwise(F.greatest(1 - F.array_max("v"), F.lit(1e-6)))
    own = -2 * F.ln(q) + F.when((f > 0) & (q < 0.7), 1).otherwise(0) + F.when((f > 0) & ((f < 100) | (f > 350)), 1).otherwise(0)
    was = F.lag("f0final").over(w)
    rows = pitch_paths(spark, d).select("user_id", "vidx", "f0final", own.alias("own"), was.alias("was"), F.when((f > 0) & (was > 0), F.ln(f / F.when(was > 0, was))).alias("change"))
    last = F.coalesce(F.lag("change").over(w), F.lit(0.0))
    step = F.when(F.col("was").isNull(), 0.0).when(F.col("change").isNotNull(), 10 * F.abs("change") + 5 * F.abs(F.col("change") - last)).when((f == 0) & (F.col("was") == 0), 0.0).otherwise(10.0)
    return rows.select("user_id", (F.col("own") + step).alias("p")).groupBy("user_id").agg(r6(F.sum("p")).alias("price"))


# -- Spectra on other axes ---------------------------------------------------


def _matrix_sql(m, v: str) -> str:
    return "[" + ", ".join(f"list_sum(list_transform({v}, lambda x, i: x * {row}[i]))" for row in m.tolist()) + "]"


_KEPT = """list_filter(range(1, 34), lambda i: (i = 1 OR m[i] > m[i - 1]) AND (i = 33 OR CASE WHEN i = 1 THEN m[i] > m[i + 1] ELSE m[i] >= m[i + 1] END))"""
_clear = "list_transform(m, lambda x, i: CASE WHEN len(list_filter(t, lambda k: abs(k - i) <= 2)) > 0 THEN x WHEN len(t) = 1 OR (i > list_min(t) AND i < list_max(t)) THEN 0 ELSE x END)"


def _axis(name: str, sql: str, **how) -> None:
    @query(name, sql)
    def run(spark, d):
        y = spectral.scaled_axis(F.col("m"), 33, 16000, **how)
        return mags(spark, d).select("vec_id", F.posexplode(y).alias("i", "y")).select("vec_id", "i", r6(F.col("y")).alias("y"))


for _scale in ("log", "bark", "mel"):
    _m = spectral.scaled_matrix(33, 16000, 24, _scale, 200.0)
    _axis("specscale_embeddings" if _scale == "log" else f"specscale_{_scale}_embeddings", f"WITH {_V}, {_MAG} SELECT vec_id, CAST(unnest(range(0, 24)) AS INTEGER) AS i, {s6(f'unnest({_matrix_sql(_m, chr(109))})')} AS y FROM m", points=24, scale=_scale, low=200.0)
_w = spectral.hearing_weights(30, 250.0, 8000.0).tolist()
_axis(
    "specscale_heard_embeddings",
    f"""WITH {_V}, {_MAG}, t AS (SELECT vec_id, m, {_KEPT} AS t FROM m), c AS (SELECT vec_id, {_clear} AS c FROM t), y AS (SELECT vec_id, {_matrix_sql(spectral.scaled_matrix(33, 16000, 30, "log", 250.0, smooth=True), "c")} AS y FROM c)
    SELECT vec_id, CAST(unnest(range(0, 30)) AS INTEGER) AS i, {s6(f'unnest(list_transform(y, lambda x, i: CASE WHEN x > 0 THEN x * {_w}[i] ELSE 0 END))')} AS y FROM y""",
    points=30, low=250.0, smooth=True, enhance=True, weighting=True,
)


# -- Models by the names of features -----------------------------------------

_PAIRS = """A LINEAR SVM MODEL
linear
3,low,middle,high
3
3
x_amean
x_max
x_range
++BINARYSVM++: low,middle
1
0.5
-0.25
0.125
BIAS: -10.5
##++LOGISTIC;0.25;-0.5
++BINARYSVM++: low,high
1
0.25
0.5
-0.5
BIAS: -12
##++LOGISTIC;0.5;-0.25
++BINARYSVM++: middle,high
1
-1
0.75
0.25
BIAS: -30
##++LOGISTIC;-0.125;-0.125
++END++
"""
_dists = ["0.5 * a - 0.25 * b + 0.125 * c - 10.5", "0.25 * a + 0.5 * b - 0.5 * c - 12", "-1 * a + 0.75 * b + 0.25 * c - 30"]
_won = [f"CASE WHEN {d} < 0 THEN '{p}' ELSE '{q}' END" for d, (p, q) in zip(_dists, (("low", "middle"), ("low", "high"), ("middle", "high")))]


@query("svm_by_names_events", f"""WITH {_E}, f AS (SELECT user_id, avg(x) AS a, max(x) AS b, max(x) - min(x) AS c FROM e GROUP BY user_id), w AS (SELECT user_id, unnest([{', '.join(_won)}]) AS k FROM f),
    v AS (SELECT user_id, k, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT user_id, first(k ORDER BY n DESC, list_position(['low', 'middle', 'high'], k)) AS class FROM v GROUP BY user_id""")
def _(spark, d):
    f = fn.functionals(events(spark, d), ["user_id"], ["vidx"], "x", ["extremes"])
    return models.pairs_class(f, models.parse_pairs(_PAIRS)).select("user_id", "class")


# -- Options of spectra -------------------------------------------------------

for _name, _how in (("critical", {"width": "erb"}), ("fixed_width", {"width": 600.0, "scale": "bark"})):
    _bank = spectral.filterbank(33, 16000, 10, 300.0, 7000.0, **_how)

    def _run(spark, d, bank=_bank):
        y = spectral.apply_matrix(F.col("m"), bank)
        return mags(spark, d).select("vec_id", F.posexplode(y).alias("band", "y")).select("vec_id", "band", r6(F.col("y")).alias("energy"))

    query(f"{_name}_bands_embeddings", f"WITH {_V}, {_MAG} SELECT vec_id, CAST(unnest(range(0, 10)) AS INTEGER) AS band, {s6(f'unnest({_matrix_sql(_bank, chr(109))})')} AS energy FROM m")(_run)


@query("spectrum_scales_embeddings", f"""WITH {_V}, {_MAG} SELECT vec_id, CAST(unnest(range(0, 33)) AS INTEGER) AS bin, {s6('unnest(list_transform(m, lambda x: x / 64))')} AS share, {s6('unnest(list_transform(m, lambda x: (x / 64) ** 2))')} AS power,
    {s6('unnest(list_transform(m, lambda x: greatest(CASE WHEN x > 0 THEN 90.302 + 20 * log10(x / 64) ELSE -102 END, -102)))')} AS db FROM m""")
def _(spark, d):
    m = F.col("m")
    z = F.arrays_zip(spectral.scaled_spectrum(m, True).alias("a"), spectral.scaled_spectrum(m, True, True).alias("b"), spectral.scaled_spectrum(m, decibels=True).alias("c"))
    out = mags(spark, d).select("vec_id", F.posexplode(z).alias("bin", "z"))
    return out.select("vec_id", "bin", r6(F.col("z.a")).alias("share"), r6(F.col("z.b")).alias("power"), r6(F.col("z.c")).alias("db"))


_floor_db = "(10 * log10(greatest(x * x, 1e-14)) + 140)"
_part = "m[5:17]"  # 1000 to 4000 Hz
_dbs = f"list_transform(m, lambda x: {_floor_db})"


@query("spectral_options_embeddings", f"""WITH {_V}, {_MAG}, s AS (SELECT vec_id, m, {_dbs} AS db, list_transform({_part}, lambda x: x * x) AS p, list_sum(list_transform(m, lambda x: x * x)) AS all_ FROM m)
    SELECT vec_id, {s6('list_sum(list_transform(m[1:3], lambda x: x * x)) / all_')} AS band, {s6('list_sum(list_transform(p, lambda x, i: x * (750 + 250 * i))) / list_sum(p)')} AS span_centroid, {s6('list_sum(list_transform(db, lambda x, i: x * 250 * (i - 1))) / list_sum(db)')} AS log_centroid,
    {s6('(33 * list_sum(list_transform(db, lambda x, i: x * 250 * (i - 1))) - list_sum(range(0, 33)) * 250 * list_sum(db)) / (33 * list_sum(list_transform(range(0, 33), lambda i: (250.0 * i) ** 2)) - (250.0 * list_sum(range(0, 33))) ** 2) * 1000')} AS log_slope, {s6('10 * log10(greatest(list_sum(list_transform(m[1:3], lambda x: x * x)), 1e-14))')} AS log_band FROM s""")
def _(spark, d):
    at = [250.0 * k for k in range(33)]
    m = F.col("m")
    relative, span, log = spectral.descriptors(m, at, relative=True), spectral.descriptors(m, at, span=(1000, 4000)), spectral.descriptors(m, at, decibels=True)
    cols = {"band": relative["band_0_650"], "span_centroid": span["centroid"], "log_centroid": log["centroid"], "log_slope": log["slope"] * 1000, "log_band": log["band_0_650"]}
    return mags(spark, d).select("vec_id", *[r6(c.cast("double")).alias(n) for n, c in cols.items()])
