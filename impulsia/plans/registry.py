"""Named queries of the engine and the SQL that reproduces them.

The model behind most is a first-order autoregression of the monthly orders: y1, 100 log of their value, and y2, 100
log of their number. The instrument z is the lineitem discounts' deviation by month, kept every third month. Values
are rounded, as sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from impulsia.functions import linalg as L
from impulsia.operators import bootstrap as B
from impulsia.operators import decompose as D
from impulsia.operators import estimate as E
from impulsia.operators import inference as I
from impulsia.operators import panel as P
from impulsia.operators import series as S
from impulsia.operators import structural as R
from impulsia.operators import tidy as T
from impulsia.plans import sql as Q
from impulsia.sources.tables import frame, table

NAMES, HORIZON, REPS = ["y1", "y2"], 12, 20
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def out(*cols: str, digits: int = 4) -> str:
    """The select list that rounds cols as rounded() does; a name after a space is the column's."""
    made = []
    for c in cols:
        e, _, name = c.rpartition(" as ")
        made.append(f"round({e or name}, {digits}) + 0.0 AS {name}")
    return ", ".join(made)


# Series ---------------------------------------------------------------------------------------------------------


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """t, ts, y1, y2 by month."""
    m = {"y1": 100 * F.log(F.sum("o_totalprice")), "y2": 100 * F.log(F.count(F.lit(1)))}
    return S.periods(table(spark, sf, "orders"), "o_orderdate", "month", m, drop_last=True)


def instrument(spark: SparkSession, sf: str) -> DataFrame:
    """t, z, inside: z is 0 but every third month; inside is its window."""
    d = S.periods(table(spark, sf, "lineitem"), "l_shipdate", "month", {"d": F.avg("l_discount")}, drop_last=True)
    d = S.demeaned(d, ["d"]).select("ts", (1000 * F.col("d")).alias("d"))
    z = orders(spark, sf).select("t", "ts").join(d, "ts")
    return z.select("t", F.when(F.col("t") % 3 == 0, F.col("d")).otherwise(F.lit(0.0)).alias("z"), (F.col("t") >= 20).alias("inside"))


def with_z(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf).join(instrument(spark, sf), "t").select("t", "ts", "y1", "y2", "z", "inside")


def var(spark: SparkSession, sf: str, p: int = 1) -> E.Var:
    return E.fit_var(orders(spark, sf), NAMES, p)


def z_array(spark: SparkSession, sf: str) -> np.ndarray:
    """The instrument by time; a number a month."""
    return np.array([r["z"] for r in instrument(spark, sf).orderBy("t").collect()])


V = Q.var1("v", "s", HORIZON)


def base(*more: str, select: str) -> str:
    return Q.with_(Q.ORDERS, V, *more, select=select)


def base_z(*more: str, select: str) -> str:
    return Q.with_(Q.ORDERS, Q.SHIP, V, *more, select=select)


@query(Q.with_(Q.ORDERS, select=f"SELECT t, {out('y1', 'y2', digits=6)} FROM s"))
def orders_series(spark, sf):
    return rounded(orders(spark, sf).select("t", *NAMES), 6)


@query(
    "WITH m AS (SELECT date_trunc('month', l_shipdate) AS ts, sum(l_quantity) AS q, avg(l_discount) AS d, count(*) AS n FROM lineitem GROUP BY 1) "
    f"SELECT row_number() OVER (ORDER BY ts) AS t, {out('q', 'd', digits=6)}, n FROM m WHERE ts < (SELECT max(ts) FROM m)"
)
def ship_series(spark, sf):
    m = {"q": F.sum("l_quantity"), "d": F.avg("l_discount"), "n": F.count(F.lit(1))}
    return rounded(S.periods(table(spark, sf, "lineitem"), "l_shipdate", "month", m, drop_last=True).drop("ts"), 6)


@query(
    "WITH h AS (SELECT date_trunc('hour', ts) AS ts, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL), "
    "grid AS (SELECT unnest(generate_series((SELECT min(ts) FROM h), (SELECT max(ts) FROM h), INTERVAL 1 HOUR)) AS ts), "
    "full_ AS (SELECT * FROM grid, (SELECT DISTINCT event_type FROM h)) "
    f"SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS t, coalesce(n, 0)::BIGINT AS n, {out('coalesce(total, 0) as total')} FROM full_ LEFT JOIN h USING (ts, event_type)"
)
def events_hourly(spark, sf):
    e = table(spark, sf, "events")
    h = e.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp").alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(S.gap_filled(h, "hour", h.select("event_type"), ["n", "total"], 0).select("event_type", "t", "n", "total"))


@query(Q.with_(Q.ORDERS, select=f"SELECT t, {out('y1', 'y2', digits=6)} FROM (SELECT t, y1 - lag(y1) OVER (ORDER BY t) AS y1, y2 - lag(y2) OVER (ORDER BY t) AS y2 FROM s) WHERE y1 IS NOT NULL"))
def series_diff(spark, sf):
    return rounded(S.differenced(orders(spark, sf), NAMES).select("t", *NAMES), 6)


@query(Q.with_(Q.ORDERS, select=f"SELECT t, {out('y1 - avg(y1) OVER () as y1', 'y2 - avg(y2) OVER () as y2', digits=6)} FROM s"))
def series_demeaned(spark, sf):
    return rounded(S.demeaned(orders(spark, sf), NAMES).select("t", *NAMES), 6)


@query(Q.with_(Q.ORDERS, select=f"SELECT t, {out('sum(y1) OVER w as y1', digits=3)} FROM s WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)"))
def series_cumulated(spark, sf):
    return rounded(S.cumulated(orders(spark, sf), "y1", (), "t").select("t", "y1"), 3)


@query(Q.with_(Q.ORDERS, select=f"SELECT t, variable, {out('value', digits=6)} FROM (SELECT t, 'y1' AS variable, y1 AS value FROM s UNION ALL SELECT t, 'y2', y2 FROM s)"))
def series_long(spark, sf):
    return rounded(S.long(orders(spark, sf), NAMES), 6)


@query(Q.with_(Q.ORDERS, select=f"SELECT t, {out('y1', 'y2', digits=6)} FROM s"))
def series_wide(spark, sf):
    return rounded(S.wide(S.long(orders(spark, sf), NAMES), NAMES), 6)


@query(Q.with_(Q.ORDERS, Q.SHIP, select=f"SELECT t, {out('z', digits=6)} FROM z WHERE inside"))
def instrument_window(spark, sf):
    z = instrument(spark, sf)
    return rounded(S.window(z, 20, 10**6).select("t", "z"), 6)


@query(Q.with_(Q.ORDERS, Q.SHIP, select=f"SELECT t, {out('CASE WHEN inside THEN z ELSE 0 END as z', digits=6)} FROM z"))
def instrument_truncated(spark, sf):
    return rounded(S.zero_for_missing(instrument(spark, sf).select("t", F.when(F.col("inside"), F.col("z")).alias("z")), "z"), 6)


@query(Q.with_(Q.ORDERS, select="SELECT t, " + out("y1", "y2", "a as y1_l1", "b as y2_l1", "c as y1_l2", "d as y2_l2", digits=6) + " FROM (SELECT *, lag(y1) OVER w AS a, lag(y2) OVER w AS b, lag(y1, 2) OVER w AS c, lag(y2, 2) OVER w AS d FROM s WINDOW w AS (ORDER BY t)) WHERE t > 2"))
def lag_matrix(spark, sf):
    return rounded(E.lag_matrix(orders(spark, sf), NAMES, 2).drop("ts"), 6)


@query(Q.with_(Q.ORDERS, select="SELECT t, " + out("lead(y1) OVER w as y1_f1", "lead(y1, 2) OVER w as y1_f2", digits=6) + " FROM s WINDOW w AS (ORDER BY t)"))
def lead_matrix(spark, sf):
    return rounded(S.leads_and_lags(orders(spark, sf), "y1", [-1, -2]).select("t", "y1_f1", "y1_f2"), 6)


# Estimation -----------------------------------------------------------------------------------------------------


@query(base(select="SELECT equation, term, " + out("value", digits=3) + " FROM (" + " UNION ALL ".join(f"SELECT 'y{i}' AS equation, '{t}' AS term, {c} AS value FROM v_b" for i in (1, 2) for t, c in (("const", f"k{i}"), ("y1_l1", f"a{i}1"), ("y2_l1", f"a{i}2"))) + ")"))
def var_beta(spark, sf):
    return rounded(E.coefficients(var(spark, sf), spark), 3)


@query(base(select=f"SELECT t, {out('u1 as u_y1', 'u2 as u_y2')} FROM v_u"))
def var_residuals(spark, sf):
    return rounded(var(spark, sf).residuals())


@query(base(select='SELECT "row", col, ' + out("value") + " FROM (" + " UNION ALL ".join(f"SELECT 'y{i}' AS \"row\", 'y{j}' AS col, s{min(i, j)}{max(i, j)} AS value FROM v_v" for i in (1, 2) for j in (1, 2)) + ")"))
def var_sigma(spark, sf):
    v = var(spark, sf)
    return rounded(E.matrix(spark, v.sigma, NAMES, NAMES))


LAGGED = "x AS (SELECT 0 AS g, t, y1, y2, z, lag(y1) OVER w AS y1_l1, lag(y2) OVER w AS y2_l1, lag(y1, 2) OVER w AS y1_l2, lag(y2, 2) OVER w AS y2_l2, lag(z) OVER w AS z_l1 FROM s JOIN z USING (t) WINDOW w AS (ORDER BY t))"


def _terms(n: str, terms: list[str]) -> str:
    return "SELECT equation, term, " + out("value", digits=3) + " FROM (" + " UNION ALL ".join(f"SELECT '{e}' AS equation, '{t}' AS term, {'k_' + e if t == 'const' else e + '_' + t} AS value FROM {n}_b" for e in NAMES for t in ["const", *terms]) + ")"


@query(Q.with_(Q.ORDERS, Q.SHIP, LAGGED, Q.ols("r", "x", NAMES, ["y1_l1", "y2_l1", "z"]), select=_terms("r", ["y1_l1", "y2_l1", "z"])))
def var_exog_beta(spark, sf):
    return rounded(E.coefficients(E.fit_var(with_z(spark, sf), NAMES, 1, exog=["z"]), spark), 3)


@query(Q.with_(Q.ORDERS, Q.SHIP, LAGGED, Q.ols("r", "x", NAMES, ["y1_l1", "y2_l1", "z", "z_l1"]), select=_terms("r", ["y1_l1", "y2_l1", "z", "z_l1"])))
def varx_beta(spark, sf):
    return rounded(E.coefficients(E.fit_varx(with_z(spark, sf), NAMES, ["z"], 1), spark), 3)


@query(Q.with_(Q.ORDERS, Q.SHIP, LAGGED, Q.ols("r", "x", NAMES, ["y1_l1", "y2_l1", "y1_l2", "y2_l2"]), select=_terms("r", ["y1_l1", "y2_l1", "y1_l2", "y2_l2"])))
def var2_beta(spark, sf):
    return rounded(E.coefficients(var(spark, sf, 2), spark), 3)


def _crit(p: int, n: str) -> str:
    a, b = f"ln(({n}.e_y1_y1 * {n}.e_y2_y2 - {n}.e_y1_y2 * {n}.e_y1_y2) / (tt * tt))", f"({4 * p} + 2) / tt"
    return f"SELECT {p} AS p, {a} + 2 * {b} AS aic, {a} + ln(tt) * {b} AS bic, {a} + 2 * {b} * ln(ln(tt)) AS hq FROM {n}_b {n}, (SELECT count(*)::DOUBLE AS tt FROM s)"


@query(Q.with_(Q.ORDERS, Q.SHIP, LAGGED.replace("FROM s JOIN z USING (t)", "FROM (SELECT *, 0 AS z FROM s)"), Q.ols("r1", "x", NAMES, ["y1_l1", "y2_l1"]), Q.ols("r2", "x", NAMES, ["y1_l1", "y2_l1", "y1_l2", "y2_l2"]), select="SELECT p, " + out("aic", "bic", "hq") + f" FROM ({_crit(1, 'r1')} UNION ALL {_crit(2, 'r2')})"))
def lag_selection(spark, sf):
    return rounded(frame(spark, E.lag_selection(orders(spark, sf), NAMES, 2), "p int, aic double, bic double, hq double"))


@query(_sql["lag_selection"].replace("SELECT p, round", "SELECT p_, round", 1).replace("SELECT p_, round", "SELECT criterion, arg_min(p, value)::INTEGER AS p FROM (UNPIVOT (SELECT p, round", 1) + ") ON aic, bic, hq INTO NAME criterion VALUE value) GROUP BY criterion")
def lag_choice(spark, sf):
    found = E.best_lags(E.lag_selection(orders(spark, sf), NAMES, 2))
    return frame(spark, list(found.items()), "criterion string, p int")


@query(base(select='SELECT "row", col, ' + out("value") + " FROM (" + " UNION ALL ".join(f"SELECT {i} AS \"row\", {j} AS col, a{i}{j} AS value FROM v_b" for i in (1, 2) for j in (1, 2)) + ")"))
def companion(spark, sf):
    m = L.companion(var(spark, sf).beta, 2, 1)
    return rounded(frame(spark, [(i + 1, j + 1, float(m[i, j])) for i in range(2) for j in range(2)], "row int, col int, value double"))


def _ols_row(r: dict) -> tuple:
    return (float(r["beta"][1]), float(r["r2"]), float(r["r2adj"]), float(r["f"]), float(r["f_robust"]))


OLS = "slope double, r2 double, r2adj double, f double, f_robust double"
UZ = "e AS (SELECT 0 AS g, t, u1, u2, z, inside FROM v_u JOIN z USING (t))"


def _summary(src: str, lags: int) -> str:
    """SQL of one regression of u1 on z: scores are of the demeaned regressor, which gives the slope's robust variance."""
    middle = "sum(w * w)" + "".join(f" + {2 * (1 - j / (lags + 1))} * sum(w * w{j})" for j in range(1, lags + 1))
    lagged = "".join(f", lag(w, {j}) OVER (ORDER BY t) AS w{j}" for j in range(1, lags + 1))
    # By Frisch-Waugh, robust variances of the slope need the demeaned scores only.
    return (
        f"a AS (SELECT *, z - avg(z) OVER () AS dz FROM {src}), b AS (SELECT sum(dz * u1) / sum(dz * dz) AS slope, sum(dz * dz) AS zz, avg(u1) AS mu, avg(z) AS mz, count(*)::DOUBLE AS n, sum(u1 * u1) - count(*) * avg(u1) * avg(u1) AS tss FROM a), "
        f"w0 AS (SELECT t, dz * (u1 - mu - slope * dz) AS w, (u1 - mu - slope * dz) AS r FROM a, b), w1 AS (SELECT *{lagged} FROM w0), x1 AS (SELECT {middle} AS m, sum(r * r) AS ssr FROM w1)",
        "SELECT " + out("slope", "1 - ssr / tss as r2", "1 - (n - 1) / (n - 2) * ssr / tss as r2adj", "slope * slope * zz / (ssr / (n - 2)) as f", "slope * slope * zz * zz / (m * n / (n - 2)) as f_robust") + " FROM b, x1",
    )


@query(base_z(UZ, _summary("e", 0)[0], select=_summary("e", 0)[1]))
def ols_summary(spark, sf):
    d = var(spark, sf).residuals().join(instrument(spark, sf), "t")
    return rounded(frame(spark, [_ols_row(E.ols(d, "u_y1", ["z"]))], OLS))


@query(base_z(UZ, _summary("e", 2)[0], select=_summary("e", 2)[1]))
def ols_newey_west(spark, sf):
    d = var(spark, sf).residuals().join(instrument(spark, sf), "t")
    return rounded(frame(spark, [_ols_row(E.ols(d, "u_y1", ["z"], lags=2))], OLS))


@query(base_z(UZ, "ein AS (SELECT * FROM e WHERE inside)", _summary("ein", 0)[0], select=_summary("ein", 0)[1]))
def first_stage_window(spark, sf):
    d = var(spark, sf).residuals().join(instrument(spark, sf).where("inside"), "t")
    return rounded(frame(spark, [_ols_row(E.ols(d, "u_y1", ["z"]))], OLS))


@query(base_z(UZ, "etr AS (SELECT g, t, u1, u2, CASE WHEN inside THEN z ELSE 0 END AS z FROM e)", _summary("etr", 0)[0], select=_summary("etr", 0)[1]))
def first_stage_truncated(spark, sf):
    z = S.zero_for_missing(instrument(spark, sf).select("t", F.when(F.col("inside"), F.col("z")).alias("z")), "z")
    return rounded(frame(spark, [_ols_row(E.ols(var(spark, sf).residuals().join(z, "t"), "u_y1", ["z"]))], OLS))


# Responses ------------------------------------------------------------------------------------------------------

IRF = "SELECT variable, shock, horizon, " + out("value") + " FROM "


@query(base("f AS (SELECT g, h, f11 AS r11, f12 AS r12, f21 AS r21, f22 AS r22 FROM v_w)", select=IRF + f"({Q.cells('f')})"))
def wold_irf(spark, sf):
    return rounded(R.responses(spark, var(spark, sf).wold(HORIZON), NAMES))


@query(base(select=IRF + "v_i"))
def chol_irf(spark, sf):
    return rounded(R.responses(spark, R.cholesky_irf(var(spark, sf), HORIZON), NAMES))


@query(base(select=IRF + "v_i"))
def chol_irf_join(spark, sf):
    v = var(spark, sf)
    ma = R.responses(spark, v.wold(HORIZON), NAMES).withColumnsRenamed({"variable": "row", "shock": "col"})
    return rounded(R.multiplied(ma, E.matrix(spark, np.linalg.cholesky(v.sigma), NAMES, NAMES)))


LR = Q.long_run("v")


@query(base(LR, select='SELECT "row", col, ' + out("value") + " FROM (" + " UNION ALL ".join(f"SELECT 'y{i}' AS \"row\", 'y{j}' AS col, k{i}{j} AS value FROM v_kk" for i in (1, 2) for j in (1, 2)) + ")"))
def bq_k(spark, sf):
    v = var(spark, sf)
    return rounded(E.matrix(spark, L.long_run_impact(v.wold(HORIZON), v.sigma), NAMES, NAMES))


@query(base(LR, select=IRF + f"({Q.cells('v_q')})"))
def bq_irf(spark, sf):
    return rounded(R.responses(spark, R.long_run_irf(var(spark, sf), HORIZON), NAMES))


@query(base(LR, "f AS (SELECT g, h, r11 / k11 * 2 AS r11, r12 / k11 * 2 AS r12, r21 / k11 * 2 AS r21, r22 / k11 * 2 AS r22 FROM v_q JOIN v_kk USING (g))", select=IRF + f"({Q.cells('f')})"))
def bq_irf_scaled(spark, sf):
    return rounded(R.responses(spark, R.long_run_irf(var(spark, sf), HORIZON, (0, 2.0)), NAMES))


@query(base(LR, f"f AS ({Q.cells('v_q')})", select="SELECT variable, shock, horizon, " + out("CASE WHEN variable = 'y1' THEN sum(value) OVER (PARTITION BY variable, shock ORDER BY horizon ROWS UNBOUNDED PRECEDING) ELSE value END as value") + " FROM f"))
def bq_irf_cumulated(spark, sf):
    return rounded(R.levels(R.responses(spark, R.long_run_irf(var(spark, sf), HORIZON), NAMES), ["y1"]))


@query(base("lr AS (SELECT *, CASE WHEN r12 < 0 THEN -1 ELSE 1 END AS sg FROM v_c WHERE h = (SELECT max(h) FROM v_c))", select="SELECT variable, horizon, " + out("value") + " FROM (SELECT 'y1' AS variable, c.h AS horizon, c.r12 * sg AS value FROM v_c c, lr UNION ALL SELECT 'y2', c.h, c.r22 * sg FROM v_c c, lr)"))
def lrmax_irf(spark, sf):
    v = var(spark, sf)
    return rounded(R.response(spark, L.long_run_max(v.wold(HORIZON), np.linalg.cholesky(v.sigma), 1), NAMES))


@query(_sql["lrmax_irf"])
def maxshare_irf(spark, sf):
    v = var(spark, sf)
    return rounded(R.response(spark, L.max_share(v.wold(HORIZON), np.linalg.cholesky(v.sigma), 1), NAMES))


NAMES3 = [*NAMES, "y3"]


def orders3(spark: SparkSession, sf: str) -> DataFrame:
    """t, ts, y1, y2, y3 by month: with the share of urgent orders, in percent."""
    m = {"y1": 100 * F.log(F.sum("o_totalprice")), "y2": 100 * F.log(F.count(F.lit(1))), "y3": 100 * F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0))}
    return S.periods(table(spark, sf, "orders"), "o_orderdate", "month", m, drop_last=True)


_LAGS3 = [f"{n}_l1" for n in ("y1", "y2", "y3")]
_R3 = (1, 2, 3)
THREE = (
    "m3 AS (SELECT date_trunc('month', o_orderdate) AS ts, 100 * ln(sum(o_totalprice)) AS y1, 100 * ln(count(*)) AS y2, 100 * avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS y3 FROM orders GROUP BY 1)",
    "s3 AS (SELECT row_number() OVER (ORDER BY ts) AS t, * FROM m3 WHERE ts < (SELECT max(ts) FROM m3))",
    "x3 AS (SELECT 0 AS g, t, y1, y2, y3, lag(y1) OVER w AS y1_l1, lag(y2) OVER w AS y2_l1, lag(y3) OVER w AS y3_l1 FROM s3 WINDOW w AS (ORDER BY t))",
    Q.ols("q", "x3", ["y1", "y2", "y3"], _LAGS3),
    "v3 AS (SELECT " + ", ".join(f"e_y{i}_y{j} / (n - 4) AS s{i}{j}" for i in _R3 for j in _R3 if i <= j) + " FROM q_b)",
    "w3(h, " + ", ".join(f"f{i}{j}" for i in _R3 for j in _R3) + ") AS (SELECT 0, " + ", ".join(f"{float(i == j)}::DOUBLE" for i in _R3 for j in _R3)
    + " UNION ALL SELECT h + 1, " + ", ".join(" + ".join(f"f{i}{k} * y{k}_y{j}_l1" for k in _R3) for i in _R3 for j in _R3) + f" FROM w3, q_b WHERE h < {HORIZON})",
    "l1 AS (SELECT *, sqrt(s11) AS l11, s12 / sqrt(s11) AS l21, s13 / sqrt(s11) AS l31 FROM v3)",
    "l2 AS (SELECT *, sqrt(s22 - l21 * l21) AS l22, (s23 - l31 * l21) / sqrt(s22 - l21 * l21) AS l32 FROM l1)",
    "l3 AS (SELECT *, sqrt(s33 - l31 * l31 - l32 * l32) AS l33 FROM l2)",
    # Responses to the second and third Cholesky shocks.
    "c3 AS (SELECT h, " + ", ".join(f"f{i}2 * l22 + f{i}3 * l32 AS a{i}, f{i}3 * l33 AS b{i}" for i in _R3) + " FROM w3, l3)",
)
#: Weights of both shocks where they move the second variable most at the end, and where they make most of its summed error variances.
LRMAX3 = f"k3 AS (SELECT a2 / sqrt(a2 * a2 + b2 * b2) AS ka, b2 / sqrt(a2 * a2 + b2 * b2) AS kb FROM c3 WHERE h = {HORIZON})"
SHARE3 = (
    f"o3 AS (SELECT sum(({HORIZON} + 1 - h) * a2 * a2) AS a, sum(({HORIZON} + 1 - h) * a2 * b2) AS b, sum(({HORIZON} + 1 - h) * b2 * b2) AS d FROM c3)",
    "g3 AS (SELECT a, b, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS top FROM o3)",
    "k3 AS (SELECT b / sqrt(b * b + (top - a) ** 2) AS ka, (top - a) / sqrt(b * b + (top - a) ** 2) AS kb FROM g3)",
)
OUT3 = f"z3 AS (SELECT h, " + ", ".join(f"a{i} * ka + b{i} * kb AS r{i}" for i in _R3) + f" FROM c3, k3), n3 AS (SELECT CASE WHEN r1 < 0 THEN -1 ELSE 1 END AS sg FROM z3 WHERE h = {HORIZON})"
SELECT3 = "SELECT variable, horizon, " + out("value") + " FROM (" + " UNION ALL ".join(f"SELECT 'y{i}' AS variable, h AS horizon, r{i} * sg AS value FROM z3, n3" for i in _R3) + ")"


@query(Q.with_(*THREE, LRMAX3, OUT3, select=SELECT3))
def lrmax_irf_three(spark, sf):
    v = E.fit_var(orders3(spark, sf), NAMES3, 1)
    return rounded(R.response(spark, L.long_run_max(v.wold(HORIZON), np.linalg.cholesky(v.sigma), 1), NAMES3))


@query(Q.with_(*THREE, *SHARE3, OUT3, select=SELECT3))
def maxshare_irf_three(spark, sf):
    v = E.fit_var(orders3(spark, sf), NAMES3, 1)
    return rounded(R.response(spark, L.max_share(v.wold(HORIZON), np.linalg.cholesky(v.sigma), 1), NAMES3))


@query(Q.with_(*THREE, *SHARE3, select="SELECT variable, " + out("value") + " FROM (SELECT 'y1' AS variable, 0.0 AS value UNION ALL SELECT 'y2', abs(ka) FROM k3 UNION ALL SELECT 'y3', abs(kb) FROM k3)"))
def maxshare_vector_three(spark, sf):
    v = E.fit_var(orders3(spark, sf), NAMES3, 1)
    h = np.abs(L.max_share_vector(v.wold(HORIZON), np.linalg.cholesky(v.sigma), 1))
    return rounded(frame(spark, [(n, float(x)) for n, x in zip(NAMES3, h, strict=True)], "variable string, value double"))


@query(Q.with_(*THREE, select="SELECT variable, shock, horizon, " + out("value") + " FROM (" + " UNION ALL ".join(f"SELECT 'y{i}' AS variable, 'y{j}' AS shock, h AS horizon, f{i}{j} AS value FROM w3" for i in _R3 for j in _R3) + ")"))
def wold_irf_three(spark, sf):
    return rounded(R.responses(spark, E.fit_var(orders3(spark, sf), NAMES3, 1).wold(HORIZON), NAMES3))


@query(base(select="SELECT 'y1' AS variable, 0.0 AS value UNION ALL SELECT 'y2', 1.0"))
def maxshare_vector(spark, sf):
    v = var(spark, sf)
    h = np.abs(L.max_share_vector(v.wold(HORIZON), np.linalg.cholesky(v.sigma), 0))
    return rounded(frame(spark, [(n, float(x)) for n, x in zip(NAMES, h, strict=True)], "variable string, value double"))


@query(base("a AS (SELECT h, * EXCLUDE (h) FROM v_w)", select='SELECT "row", col, lag, ' + out("value") + " FROM (" + " UNION ALL ".join(f"SELECT 'y{i}' AS \"row\", 'y{j}' AS col, a.h + b.h AS lag, sum(a.f{i}1 * b.f1{j} + a.f{i}2 * b.f2{j}) AS value FROM a, a b WHERE a.h + b.h < 10 GROUP BY ALL" for i in (1, 2) for j in (1, 2)) + ")"))
def poly_convolve(spark, sf):
    ma = R.responses(spark, var(spark, sf).wold(HORIZON), NAMES).withColumnsRenamed({"variable": "row", "shock": "col", "horizon": "lag"})
    return rounded(R.convolved(ma, ma, 10))


IVS = "iv AS (SELECT sum(z * u2) / sum(z * u1) AS s2 FROM e WHERE inside)"


@query(base_z(UZ, IVS, select="SELECT variable, " + out("value") + " FROM (SELECT 'y1' AS variable, 1.0 AS value FROM iv UNION ALL SELECT 'y2', s2 FROM iv)"))
def iv_impact(spark, sf):
    return rounded(frame(spark, [(n, float(x)) for n, x in zip(NAMES, _iv(spark, sf)[1], strict=True)], "variable string, value double"))


def _inside(spark, sf, v: E.Var) -> tuple[np.ndarray, np.ndarray]:
    """The instrument and the residual rows of its window."""
    z = z_array(spark, sf)
    rows = np.arange(19, len(z)) - v.p
    return z[19:], rows


def _iv(spark, sf) -> tuple[E.Var, np.ndarray]:
    v = var(spark, sf)
    z, rows = _inside(spark, sf, v)
    return v, L.iv_impact(v.arrays()[1][rows], z, 0)


IVIRF = "ivr AS (SELECT h, f11 + f12 * s2 AS r1, f21 + f22 * s2 AS r2 FROM v_w, iv)"
TWO = "SELECT variable, horizon, " + out("value") + " FROM (SELECT 'y1' AS variable, h AS horizon, r1 AS value FROM {0} UNION ALL SELECT 'y2', h, r2 FROM {0})"


@query(base_z(UZ, IVS, IVIRF, select=TWO.format("ivr")))
def iv_irf(spark, sf):
    v, s = _iv(spark, sf)
    return rounded(R.response(spark, v.wold(HORIZON) @ s, NAMES))


@query(base_z(UZ, "iv AS (SELECT (sum(z * u2) / count(*)) / (sum(z * u1) / count(*)) AS s2 FROM e)", "sc AS (SELECT s2, sqrt((s22 - 2 * s2 * s12 + s2 * s2 * s11) / (s11 * s22 - s12 * s12)) AS size FROM iv, v_v)", "ivr AS (SELECT h, (f11 + f12 * s2) / size AS r1, (f21 + f22 * s2) / size AS r2 FROM v_w, sc)", select=TWO.format("ivr")))
def svar_iv_unit_irf(spark, sf):
    """The standard instrument estimator over all residual rows, for a shock of unit variance."""
    v = var(spark, sf)
    _, u, _ = v.arrays()
    z = z_array(spark, sf)[1:]
    s = z @ u / (z @ z)
    s = s / s[0]
    return rounded(R.response(spark, v.wold(HORIZON) @ (s / np.sqrt(s @ np.linalg.solve(v.sigma, s))), NAMES))


TREAT = "tr AS (SELECT u1, u2, z FROM e WHERE inside AND z <> 0)", "tb AS (SELECT covar_pop(u2, z) / covar_pop(u1, z) AS s2 FROM tr)"


@query(base_z(UZ, *TREAT, select="SELECT variable, " + out("value") + " FROM (SELECT 'y1' AS variable, 10.0 AS value FROM tb UNION ALL SELECT 'y2', 10 * s2 FROM tb)"))
def hetero_impact(spark, sf):
    return rounded(frame(spark, [(n, float(x)) for n, x in zip(NAMES, _hetero(spark, sf)[1], strict=True)], "variable string, value double"))


def _hetero(spark, sf) -> tuple[E.Var, np.ndarray]:
    v = var(spark, sf)
    z, rows = _inside(spark, sf, v)
    return v, L.treated_impact(v.arrays()[1][rows], z, z != 0, 0, 10.0)


@query(base_z(UZ, *TREAT, "hr AS (SELECT h, 10 * (f11 + f12 * s2) AS r1, 10 * (f21 + f22 * s2) AS r2 FROM v_w, tb)", select=TWO.format("hr")))
def hetero_irf(spark, sf):
    v, s = _hetero(spark, sf)
    return rounded(R.response(spark, v.wold(HORIZON) @ s, NAMES))


CLEAN = "cl0 AS (SELECT 0 AS g, t, z AS zz, lag(z) OVER w AS z_l1, lag(y1) OVER w AS y1_l1, lag(y2) OVER w AS y2_l1 FROM s JOIN z USING (t) WINDOW w AS (ORDER BY t))", Q.ols("cl", "cl0", ["zz"], ["z_l1", "y1_l1", "y2_l1"])


@query(base_z(*CLEAN, select=f"SELECT t, {out('u_zz as value')} FROM cl_u"))
def clean_instrument(spark, sf):
    d = E.lag_matrix(with_z(spark, sf), ["z", *NAMES], 1)
    r = E.regress(d, ["z"], ["z_l1", "y1_l1", "y2_l1"])
    return rounded(r.residuals(d).select("t", F.col("u_z").alias("value")))


def _cleaned(spark, sf) -> tuple[E.Var, np.ndarray, np.ndarray]:
    """The model, its residuals, and the instrument cleaned, aligned with them."""
    v = var(spark, sf)
    y, u, _ = v.arrays()
    return v, u, L.clean_instrument(z_array(spark, sf), y, 1)


CZ = "cz AS (SELECT 0 AS g, t, u_zz AS zc, u1, u2, lead(u1) OVER w AS u1f, lead(u2) OVER w AS u2f, lag(u_zz) OVER w AS zc_l1 FROM cl_u JOIN (SELECT t, u1, u2 FROM v_u) USING (t) WINDOW w AS (ORDER BY t)), czf AS (SELECT * FROM cz WHERE u1f IS NOT NULL)"


@query(
    base_z(*CLEAN, CZ, Q.ols("inw", "czf", ["zc"], ["u1", "u2", "u1f", "u2f"]), Q.ols("inn", "czf", ["zc"], ["u1", "u2"]),
           select="SELECT " + out("((1 - w.e_zc_zc / tss) - (1 - k.e_zc_zc / tss)) / 2 / ((w.e_zc_zc / tss) / (w.n - 5)) as f", "sqrt(1 - w.e_zc_zc / tss) as relevance") + ", 2 AS d1, (w.n - 5)::INTEGER AS d2 FROM (SELECT *, n * c_zc_zc AS tss FROM inw_b) w, inn_b k")
)
def invertibility_test(spark, sf):
    _, u, z = _cleaned(spark, sf)
    r = I.invertibility(z, u, 1)
    return rounded(frame(spark, [(float(r["f"]), float(r["relevance"]), int(r["df"][0]), int(r["df"][1]))], "f double, relevance double, d1 int, d2 int"))


INVERT = Q.ols("inw", "czf", ["zc"], ["u1", "u2", "u1f", "u2f"]), Q.ols("inn", "czf", ["zc"], ["u1", "u2"]), "ft AS (SELECT ((k.e_zc_zc - w.e_zc_zc) / 2) / (w.e_zc_zc / (w.n - 5)) AS f, w.n - 5 AS d2 FROM inw_b w, inn_b k)"


@query(base_z(*CLEAN, CZ, *INVERT, select="SELECT " + out("f", "(1 + 2 * f / d2) ** (-d2 / 2.0) as pval", digits=6) + " FROM ft"))
def invertibility_pvalue(spark, sf):
    """With two numerator degrees of freedom, the F law's tail is a power."""
    _, u, z = _cleaned(spark, sf)
    r = I.invertibility(z, u, 1)
    return rounded(frame(spark, [(float(r["f"]), float(r["pval"]))], "f double, pval double"), 6)


@query(base("lb AS (SELECT u1 - avg(u1) OVER () AS d, t FROM v_u)", "lc AS (SELECT d, lag(d) OVER (ORDER BY t) AS d1, lag(d, 2) OVER (ORDER BY t) AS d2 FROM lb)", "lq AS (SELECT count(*) AS n, sum(d * d1) / sum(d * d) AS r1, sum(d * d2) / sum(d * d) AS r2 FROM lc)", "ls AS (SELECT n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)) AS q FROM lq)", select="SELECT " + out("q as statistic", "exp(-q / 2) as pval") + " FROM ls"))
def ljung_box(spark, sf):
    r = I.ljung_box(var(spark, sf).arrays()[1][:, 0], 2)
    return rounded(frame(spark, [(float(r["statistic"]), float(r["pval"]))], "statistic double, pval double"))


PSI = CZ, Q.ols("ps", "cz", ["u1", "u2"], ["zc", "zc_l1"]), "pv AS (SELECT u1_zc AS p01, u2_zc AS p02, u1_zc_l1 AS p11, u2_zc_l1 AS p12, s11, s12, s22, s11 * s22 - s12 * s12 AS dt FROM ps_b, v_v)", "pa AS (SELECT *, ((p01 * p01 + p11 * p11) * s22 - 2 * (p01 * p02 + p11 * p12) * s12 + (p02 * p02 + p12 * p12) * s11) / dt AS a2 FROM pv)"
GEN = "gi AS (SELECT w.h, (w.f11 * p01 + w.f12 * p02 + coalesce(b.f11 * p11 + b.f12 * p12, 0)) / sqrt(a2) AS r1, (w.f21 * p01 + w.f22 * p02 + coalesce(b.f21 * p11 + b.f22 * p12, 0)) / sqrt(a2) AS r2 FROM v_w w LEFT JOIN v_w b ON b.h = w.h - 1, pa)"


@query(base_z(*CLEAN, *PSI, GEN, select=TWO.format("gi")))
def generalized_iv_irf(spark, sf):
    v, _, z = _cleaned(spark, sf)
    return rounded(R.response(spark, R.generalized_iv(v, z, 1, HORIZON)[0], NAMES))


@query(base_z(*CLEAN, *PSI, GEN, "g0 AS (SELECT r1 AS top FROM gi WHERE h = 0)", "rel AS (SELECT h, r1 / top AS r1, r2 / top AS r2 FROM gi, g0)", select=TWO.format("rel")))
def relative_irf(spark, sf):
    v, _, z = _cleaned(spark, sf)
    irf = R.generalized_iv(v, z, 1, HORIZON)[0]
    return rounded(R.response(spark, irf / irf[0, 0], NAMES))


@query(base_z(*CLEAN, *PSI, "gr AS (SELECT range * pi() / 256 AS th FROM range(256))", "wv AS (SELECT p01 + p11 * cos(th) AS a, -p11 * sin(th) AS b, p02 + p12 * cos(th) AS c, -p12 * sin(th) AS d, s11, s12, s22, dt FROM pa, gr)", "sz AS (SELECT sqrt(max(((a * a + b * b) * s22 - 2 * (a * c + b * d) * s12 + (c * c + d * d) * s11) / dt)) AS m FROM wv)", select="SELECT " + out("m * vz as lower_scale", "sqrt(vz) as upper_scale") + " FROM sz, (SELECT var_samp(zc) AS vz FROM cz)"))
def irf_bounds(spark, sf):
    v, _, z = _cleaned(spark, sf)
    lo, hi = R.scale_bounds(R.generalized_iv(v, z, 1, HORIZON)[1], v.sigma, z)
    return rounded(frame(spark, [(lo, hi)], "lower_scale double, upper_scale double"))


@query(base_z(*CLEAN, CZ, "iv AS (SELECT sum(zc * u2) / sum(zc * u1) AS s2 FROM cz)", "sc AS (SELECT s2, sqrt((s22 - 2 * s2 * s12 + s2 * s2 * s11) / (s11 * s22 - s12 * s12)) AS size FROM iv, v_v)", "ivr AS (SELECT h, (f11 + f12 * s2) / size AS r1, (f21 + f22 * s2) / size AS r2 FROM v_w, sc)", select=TWO.format("ivr")))
def svar_iv_cleaned_irf(spark, sf):
    """As svar_iv_unit_irf, with the instrument cleaned of its own lags and those of the variables."""
    v, u, z = _cleaned(spark, sf)
    s = z @ u / (z @ z)
    s = s / s[0]
    return rounded(R.response(spark, v.wold(HORIZON) @ (s / np.sqrt(s @ np.linalg.solve(v.sigma, s))), NAMES))


FIT = Q.ols("inw", "czf", ["zc"], ["u1", "u2", "u1f", "u2f"]), "ft AS (SELECT t, zc - u_zc AS f FROM inw_u)"


@query(base_z(*CLEAN, CZ, *FIT, "lb AS (SELECT f - avg(f) OVER () AS d, t FROM ft)", "lc AS (SELECT d, lag(d) OVER (ORDER BY t) AS d1, lag(d, 2) OVER (ORDER BY t) AS d2 FROM lb)", "lq AS (SELECT count(*) AS n, sum(d * d1) / sum(d * d) AS r1, sum(d * d2) / sum(d * d) AS r2 FROM lc)", "ls AS (SELECT n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)) AS q FROM lq)", select="SELECT " + out("q as statistic", "exp(-q / 2) as pval") + " FROM ls"))
def recoverability_test(spark, sf):
    _, u, z = _cleaned(spark, sf)
    r = I.recoverability(z, u, 1, 2)
    return rounded(frame(spark, [(float(r["statistic"]), float(r["pval"]))], "statistic double, pval double"))


@query(base_z(*CLEAN, *PSI, GEN, *FIT, "rh AS (SELECT x.t + gi.h AS t, sum(r1 * x.e) AS r1, sum(r2 * x.e) AS r2 FROM (SELECT t, f / stddev_samp(f) OVER () AS e FROM ft) x, gi WHERE x.t + gi.h <= (SELECT max(t) FROM ft) GROUP BY ALL)", select="SELECT t, " + out("r1 as y1", "r2 as y2") + " FROM rh"))
def hist_decomp_recoverable(spark, sf):
    """Contributions of a shock that leads of the residuals recover, through its responses up to HORIZON."""
    v, u, z = _cleaned(spark, sf)
    hd = D.recoverable_history(R.generalized_iv(v, z, 1, HORIZON)[0], I.invertibility(z, u, 1)["fit"])
    return rounded(frame(spark, [(i + 2, float(a), float(b)) for i, (a, b) in enumerate(hd)], "t long, y1 double, y2 double"))


BOUNDS = "gr AS (SELECT range * pi() / 256 AS th FROM range(256))", "wv AS (SELECT p01 + p11 * cos(th) AS a, -p11 * sin(th) AS b, p02 + p12 * cos(th) AS c, -p12 * sin(th) AS d, s11, s12, s22, dt FROM pa, gr)", "sz AS (SELECT sqrt(max(((a * a + b * b) * s22 - 2 * (a * c + b * d) * s12 + (c * c + d * d) * s11) / dt)) AS m FROM wv)"


@query(
    base_z(*CLEAN, *PSI, GEN, *BOUNDS, "om AS (SELECT k * pi() / 128 AS w FROM range(1, 129) t(k) WHERE k * pi() / 128 BETWEEN 2 * pi() / 32 AND 2 * pi() / 4.5)",
           "gl AS (SELECT 'y1' AS variable, h, r1 * sqrt(a2) AS r FROM gi, pa UNION ALL SELECT 'y2', h, r2 * sqrt(a2) FROM gi, pa)",
           "tp AS (SELECT variable, sum(p) AS top FROM (SELECT variable, w, sum(r * cos(w * h)) ** 2 + sum(r * sin(w * h)) ** 2 AS p FROM gl, om GROUP BY ALL) GROUP BY variable)",
           "wh AS (SELECT variable, sum(p) AS whole FROM (SELECT variable, shock, w, sum(value * cos(w * horizon)) ** 2 + sum(value * sin(w * horizon)) ** 2 AS p FROM v_i, om GROUP BY ALL) GROUP BY variable)",
           select="SELECT variable, " + out("top / whole * vz as lower", "top / whole / (m * m) as upper") + " FROM tp JOIN wh USING (variable), sz, (SELECT var_samp(zc) AS vz FROM cz)")
)
def spectral_fevd_bounds(spark, sf):
    v, _, z = _cleaned(spark, sf)
    psi = R.generalized_iv(v, z, 1, HORIZON)[1]
    one = R.response(spark, L.convolve(v.wold(HORIZON), psi[:, :, None], HORIZON + 1)[:, :, 0], NAMES)
    all_ = R.responses(spark, R.cholesky_irf(v, HORIZON), NAMES)
    return rounded(D.spectral_bounds(all_, one, *R.scale_bounds(psi, v.sigma, z), 128, 4.5, 32))


@query(Q.with_(Q.ORDERS, Q.SHIP, "s2 AS (SELECT 0::BIGINT AS g, t, CASE WHEN inside THEN z ELSE 0 END AS y1, s.y1 AS y2 FROM s JOIN z USING (t))", Q.var1("n", "s2", HORIZON), "n0 AS (SELECT r21 AS top FROM n_c WHERE h = 0)", "nr AS (SELECT h, r11 / top * 10 AS r1, r21 / top * 10 AS r2 FROM n_c, n0)", select=TWO.format("nr").replace("'y2'", "'y1_'").replace("'y1'", "'z'").replace("'y1_'", "'y1'")))
def internal_instrument_irf(spark, sf):
    d = with_z(spark, sf).select("t", "ts", F.when(F.col("inside"), F.col("z")).otherwise(F.lit(0.0)).alias("z"), "y1")
    irf = R.cholesky_irf(E.fit_var(d, ["z", "y1"], 1), HORIZON)[:, :, 0]
    return rounded(R.response(spark, irf * (10 / irf[0, 1]), ["z", "y1"]))


# Decompositions -------------------------------------------------------------------------------------------------

FEVD = "fc AS (SELECT variable, shock, horizon, sum(value * value) OVER (PARTITION BY variable, shock ORDER BY horizon ROWS UNBOUNDED PRECEDING) AS c FROM v_i)", "fs AS (SELECT variable, shock, horizon, c / sum(c) OVER (PARTITION BY variable, horizon) AS share FROM fc)"


@query(base(*FEVD, select=f"SELECT variable, shock, horizon, {out('share')} FROM fs"))
def fevd(spark, sf):
    return rounded(D.variance_shares(R.responses(spark, R.cholesky_irf(var(spark, sf), HORIZON), NAMES)))


@query(base(*FEVD, select=f"SELECT variable, horizon, {out('share')} FROM fs WHERE shock = 'y2'"))
def fevd_single_shock(spark, sf):
    return rounded(D.variance_shares(R.responses(spark, R.cholesky_irf(var(spark, sf), HORIZON), NAMES)).where("shock = 'y2'").drop("shock"))


IVSIZE = "iz AS (SELECT s2, sqrt((s22 - 2 * s2 * s12 + s2 * s2 * s11) / (s11 * s22 - s12 * s12)) AS size FROM iv, v_v)"
IVFEVD = (
    "ivv AS (SELECT h, sum(f11 * f11 * s11 + 2 * f11 * f12 * s12 + f12 * f12 * s22) OVER w AS d1, sum(f21 * f21 * s11 + 2 * f21 * f22 * s12 + f22 * f22 * s22) OVER w AS d2 FROM v_w JOIN v_v USING (g) WINDOW w AS (ORDER BY h ROWS UNBOUNDED PRECEDING)), "
    "ivs AS (SELECT h, sum((r1 / size) ** 2) OVER w / d1 AS r1, sum((r2 / size) ** 2) OVER w / d2 AS r2 FROM ivr JOIN ivv USING (h), iz WINDOW w AS (ORDER BY h ROWS UNBOUNDED PRECEDING))"
)


@query(base_z(UZ, IVS, IVIRF, IVSIZE, IVFEVD, select=TWO.format("ivs").replace("value", "share")))
def fevd_iv(spark, sf):
    v, s = _iv(spark, sf)
    return rounded(D.shares_frame(spark, D.one_shock_shares(v, s, HORIZON)["share"], NAMES))


@query(base_z(UZ, IVS, IVSIZE, "ck AS (SELECT (u1 * (s22 - s12 * s2) + u2 * (s2 * s11 - s12)) / (s11 * s22 - s12 * s12) / size AS e FROM v_u, v_v, iz)", select="SELECT " + out("sum(e * e) / (count(*) - 3) as check_uv") + " FROM ck"))
def fevd_iv_check(spark, sf):
    v, s = _iv(spark, sf)
    return rounded(frame(spark, [(D.one_shock_shares(v, s, HORIZON)["check"],)], "check_uv double"))


def _spectral_sql(grid: str) -> str:
    return base(
        f"om AS ({grid})",
        "pw AS (SELECT variable, shock, om.w, sum(value * cos(om.w * horizon)) ** 2 + sum(value * sin(om.w * horizon)) ** 2 AS p FROM v_i, om GROUP BY ALL)",
        select=f"SELECT variable, {out('sum(CASE WHEN shock = ' + chr(39) + 'y1' + chr(39) + ' THEN p END) / sum(p) as share')} FROM pw GROUP BY variable",
    )


@query(_spectral_sql("SELECT k * pi() / 128 AS w FROM range(1, 129) t(k) WHERE k * pi() / 128 BETWEEN 2 * pi() / 32 AND 2 * pi() / 4.5"))
def spectral_fevd_fourier(spark, sf):
    irf = R.responses(spark, R.cholesky_irf(var(spark, sf), HORIZON), NAMES)
    return rounded(D.spectral_shares(irf, irf.where("shock = 'y1'").drop("shock"), 128, 4.5, 32))


@query(_spectral_sql("SELECT 2 * pi() / 32 + k * (2 * pi() / 4.5 - 2 * pi() / 32) / 63 AS w FROM range(64) t(k)"))
def spectral_fevd_linspace(spark, sf):
    irf = R.responses(spark, R.cholesky_irf(var(spark, sf), HORIZON), NAMES)
    return rounded(D.spectral_shares(irf, irf.where("shock = 'y1'").drop("shock"), 64, 4.5, 32, fourier=False))


VL = Q.var1("vl", "s", 200)
SHOCKS = "sh AS (SELECT t, 'y1' AS shock, u1 / l11 AS e FROM v_u JOIN v_p USING (g) UNION ALL SELECT t, 'y2', (u2 - l21 * u1 / l11) / l22 FROM v_u JOIN v_p USING (g))"
HIST = SHOCKS, VL, "hd AS (SELECT sh.t + i.horizon AS t, i.variable, i.shock, sum(i.value * sh.e) AS value FROM sh JOIN vl_i i ON i.shock = sh.shock WHERE sh.t + i.horizon <= (SELECT max(t) FROM s) GROUP BY ALL)"


def _history(spark, sf) -> tuple[E.Var, DataFrame]:
    v = var(spark, sf)
    chol = np.linalg.cholesky(v.sigma)
    return v, D.historical_var(v, chol, NAMES)


@query(base(*HIST, select=f"SELECT t, variable, shock, {out('value')} FROM hd"))
def hist_decomp(spark, sf):
    return rounded(_history(spark, sf)[1])


@query(base(*HIST, "tg AS (SELECT t, y1 - avg(y1) OVER () AS v FROM s)", "ow AS (SELECT t, value AS own FROM hd WHERE variable = 'y1' AND shock = 'y2')", select='SELECT t, \'y1\' AS variable, ' + out("own as y2", 'v - own as "Residual"', 'v as "Total"') + " FROM ow JOIN tg USING (t)"))
def hist_decomp_tidy(spark, sf):
    v, h = _history(spark, sf)
    target = S.long(S.demeaned(v.series, NAMES).select("t", *NAMES), NAMES)
    return rounded(T.history(h.where("variable = 'y1'"), "y2", target.where("variable = 'y1'")))


@query(base(*HIST, select="SELECT t, variable, " + out("sum(CASE WHEN shock = 'y1' THEN value END) as y1", "sum(CASE WHEN shock = 'y2' THEN value END) as y2") + " FROM hd GROUP BY t, variable"))
def hist_decomp_wide(spark, sf):
    return rounded(T.history_by_shock(_history(spark, sf)[1], NAMES))


IVSHOCK = "we AS (SELECT (s22 - s12 * s2) / dt AS w1, (s2 * s11 - s12) / dt AS w2, (s22 - 2 * s2 * s12 + s2 * s2 * s11) / dt AS q FROM iv, (SELECT *, s11 * s22 - s12 * s12 AS dt FROM v_v))"


@query(base_z(UZ, IVS, IVSHOCK, select=f"SELECT t, {out('2 * (u1 * w1 + u2 * w2) / q as value')} FROM v_u, we"))
def shock_unit(spark, sf):
    v, s = _iv(spark, sf)
    w = np.linalg.solve(v.sigma, s)
    w = 2 * w / (s @ w)
    return rounded(v.residuals().select("t", (F.col("u_y1") * float(w[0]) + F.col("u_y2") * float(w[1])).alias("value")))


@query(base_z(UZ, IVS, IVSHOCK, select=f"SELECT t, {out('(u1 * w1 + u2 * w2) / sqrt(q) as value')} FROM v_u, we"))
def shock_sd(spark, sf):
    v, s = _iv(spark, sf)
    shock = L.shock_series(v.arrays()[1], v.sigma, s, normalize="sd")
    return rounded(frame(spark, [(i + 2, float(x)) for i, x in enumerate(shock)], "t int, value double").select(F.col("t").cast("long").alias("t"), "value"))


@query(base_z(UZ, IVS, IVSHOCK, VL, "se AS (SELECT t, (u1 * w1 + u2 * w2) / q AS e FROM v_u, we)", "hv AS (SELECT se.t + h AS t, sum((f11 + f12 * s2) * e) AS r1, sum((f21 + f22 * s2) * e) AS r2 FROM se, vl_w, iv WHERE se.t + h <= (SELECT max(t) FROM s) GROUP BY ALL)", select="SELECT t, " + out("r1 as y1", "r2 as y2") + " FROM hv"))
def hd_iv(spark, sf):
    v, s = _iv(spark, sf)
    hd = D.historical_iv(v, s)
    return rounded(frame(spark, [(i + 2, float(a), float(b)) for i, (a, b) in enumerate(hd)], "t long, y1 double, y2 double"))


@query(base(select="SELECT shock, " + out("sum(r1 * r2) / sqrt(sum(r1 * r1) * sum(r2 * r2)) as value") + " FROM (SELECT 'y1' AS shock, h, r11 AS r1, r21 AS r2 FROM v_c UNION ALL SELECT 'y2', h, r12, r22 FROM v_c) GROUP BY shock"))
def conditional_corr(spark, sf):
    return rounded(D.conditional_correlation(R.responses(spark, R.cholesky_irf(var(spark, sf), HORIZON), NAMES), *NAMES))


@query(base(*FEVD, select=f"SELECT horizon, variable, shock, {out('share as value')} FROM fs"))
def vardec_tidy(spark, sf):
    return rounded(T.shares(D.variance_shares(R.responses(spark, R.cholesky_irf(var(spark, sf), HORIZON), NAMES))))


@query(base(*FEVD, select="SELECT horizon, variable, CASE WHEN shock = 'y2' THEN 'demand' ELSE 'Other Shocks' END AS shock, " + out("share as value") + " FROM fs"))
def vardec_tidy_single(spark, sf):
    one = D.variance_shares(R.responses(spark, R.cholesky_irf(var(spark, sf), HORIZON), NAMES)).where("shock = 'y2'").drop("shock")
    return rounded(T.shares(one, "demand"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(R.STEPS)) + ") AS t(step, text)")
def svar_steps(spark, sf):
    return frame(spark, [(i + 1, t) for i, t in enumerate(R.STEPS)], "step int, text string")


# Resampling -----------------------------------------------------------------------------------------------------

N = "(SELECT n::BIGINT FROM v_v)"
DRAWN = f"dr AS ({Q.draws(7, REPS, N)})"
RESIDUAL = DRAWN, f"rs AS (SELECT dr.b AS g, dr.i + 2 AS t, u.u1 AS e1, u.u2 AS e2 FROM dr JOIN v_u u ON u.t = 2 + dr.u % {N})"
WILD = DRAWN, "rs AS (SELECT dr.b AS g, u.t, CASE WHEN dr.u % 2 = 0 THEN u1 ELSE -u1 END AS e1, CASE WHEN dr.u % 2 = 0 THEN u2 ELSE -u2 END AS e2 FROM dr JOIN v_u u ON u.t = dr.i + 2)"
SIM = Q.simulated("sm", "rs")
BV = Q.var1("b", "sm", HORIZON)


def _plan(spark, sf, **more) -> B.Plan:
    return B.plan(var(spark, sf), HORIZON, generator="hash", **more)


def _paths(spark, q: B.Plan, reps: int) -> DataFrame:
    y = L.simulate(q.y[: q.p], q.beta, B.draw(q, range(reps)).u, q.p, q.c, q.exog)
    return frame(spark, [(b, t + 1, float(y[b, t, 0]), float(y[b, t, 1])) for b in range(reps) for t in range(y.shape[1])], "b int, t int, y1 double, y2 double")


@query(base("rs AS (SELECT g, t, u1 AS e1, u2 AS e2 FROM v_u)", SIM, select=f"SELECT t, {out('y1', 'y2')} FROM sm"))
def simulate_var(spark, sf):
    v = var(spark, sf)
    y, u, _ = v.arrays()
    path = L.simulate(y[:1], v.beta, u[None], 1)[0]
    return rounded(frame(spark, [(t + 1, float(a), float(b)) for t, (a, b) in enumerate(path)], "t long, y1 double, y2 double"))


@query(base(*RESIDUAL, SIM, select=f"SELECT g AS b, t, {out('y1', 'y2', digits=3)} FROM sm WHERE g < 3"))
def boot_residual_path(spark, sf):
    return rounded(_paths(spark, _plan(spark, sf), 3), 3)


@query(base(*WILD, SIM, select=f"SELECT g AS b, t, {out('y1', 'y2', digits=3)} FROM sm WHERE g < 3"))
def boot_wild_path(spark, sf):
    return rounded(_paths(spark, _plan(spark, sf, scheme="wild"), 3), 3)


KEYS = "variable, shock, horizon"


@query(base(*RESIDUAL, SIM, BV, select=Q.bands("b_i", KEYS, 3)))
def boot_chol(spark, sf):
    return rounded(B.bands(B.replicate(spark, _plan(spark, sf), REPS, B.by_cholesky)), 3)


@query(base(*WILD, SIM, BV, select=Q.bands("b_i", KEYS, 3)))
def boot_chol_wild(spark, sf):
    return rounded(B.bands(B.replicate(spark, _plan(spark, sf, scheme="wild"), REPS, B.by_cholesky)), 3)


CORRECT = (
    "bm AS (SELECT avg(a11) AS a11, avg(a12) AS a12, avg(a21) AS a21, avg(a22) AS a22, avg(k1) AS k1, avg(k2) AS k2 FROM b_b)",
    "bd AS (SELECT d, " + ", ".join(f"v.{c} - (m.{c} - v.{c}) * (1 - d / 100.0) AS {c}" for c in ("a11", "a12", "a21", "a22", "k1", "k2")) + " FROM v_b v, bm m, (SELECT unnest(range(101)) AS d))",
    "be AS (SELECT *, (a11 + a22) AS tr, a11 * a22 - a12 * a21 AS de FROM bd)",
    "bs AS (SELECT *, CASE WHEN tr * tr >= 4 * de THEN greatest(abs(tr + sqrt(greatest(tr * tr - 4 * de, 0))), abs(tr - sqrt(greatest(tr * tr - 4 * de, 0)))) / 2 ELSE sqrt(de) END AS r FROM be)",
    "bc_b AS (SELECT 0::BIGINT AS g, a11, a12, a21, a22, k1, k2 FROM bs WHERE r < 1 ORDER BY d LIMIT 1)",
)


@query(base(*RESIDUAL, SIM, BV, *CORRECT, select="SELECT equation, term, " + out("value", digits=2) + " FROM (" + " UNION ALL ".join(f"SELECT 'y{i}' AS equation, '{t}' AS term, {c} AS value FROM bc_b" for i in (1, 2) for t, c in (("const", f"k{i}"), ("y1_l1", f"a{i}1"), ("y2_l1", f"a{i}2"))) + ")"))
def bias_correct(spark, sf):
    beta = B.corrected(spark, _plan(spark, sf), REPS).beta
    terms = ["const", "y1_l1", "y2_l1"]
    return rounded(frame(spark, [(e, t, float(beta[i, j])) for j, e in enumerate(NAMES) for i, t in enumerate(terms)], "equation string, term string, value double"), 2)


SIM2, BV2 = Q.simulated("sk", "rs", "bc_b"), Q.var1("k", "sk", HORIZON)


@query(base(*RESIDUAL, SIM, BV, *CORRECT, SIM2, BV2, select=Q.bands("k_i", KEYS, 3)))
def boot_chol_corrected(spark, sf):
    return rounded(B.bands(B.replicate(spark, B.corrected(spark, _plan(spark, sf), REPS), REPS, B.by_cholesky)), 3)


def _cum(src: str) -> str:
    return f"cu AS (SELECT g, variable, shock, horizon, CASE WHEN variable = 'y1' THEN sum(value) OVER (PARTITION BY g, variable, shock ORDER BY horizon ROWS UNBOUNDED PRECEDING) ELSE value END AS value FROM ({src}))"


@query(base(*RESIDUAL, SIM, BV, Q.long_run("b"), _cum(Q.cells("b_q")), select=Q.bands("cu", KEYS, 3)))
def boot_bq(spark, sf):
    return rounded(B.bands(B.replicate(spark, _plan(spark, sf, extra={"cumulate": [0]}), REPS, B.by_long_run)), 3)


def _second(n: str, flat: str = "false") -> str:
    """Responses to the second Cholesky shock by group, the first variable up at the end: what both maximising shocks are for two variables. flat: where there is nothing to maximise."""
    return f"{n}l AS (SELECT g, CASE WHEN {flat} THEN 0 WHEN r12 < 0 THEN -1 ELSE 1 END AS sg FROM {n}_c WHERE h = {HORIZON}), {n}o AS (SELECT c.g, 'y1' AS variable, h AS horizon, r12 * sg AS value FROM {n}_c c JOIN {n}l USING (g) UNION ALL SELECT c.g, 'y2', h, r22 * sg FROM {n}_c c JOIN {n}l USING (g))"


KEY1 = "variable, horizon"


def _one(spark, q: B.Plan, identify, digits: int = 3) -> DataFrame:
    return rounded(B.bands(B.replicate(spark, q, REPS, identify), ("variable", "horizon")), digits)


FLAT = "abs(r22) <= 1e-14"


@query(base(*RESIDUAL, SIM, BV, _second("b", FLAT), select=Q.bands("bo", KEY1, 3)))
def boot_lrmax(spark, sf):
    return _one(spark, _plan(spark, sf, extra={"target": 1}), B.by_long_run_max)


@query(base(*RESIDUAL, SIM, BV, _second("b"), select=Q.bands("bo", KEY1, 3)))
def boot_maxshare(spark, sf):
    return _one(spark, _plan(spark, sf, extra={"target": 1}), B.by_max_share)


@query(base(*RESIDUAL, SIM, BV, *CORRECT, SIM2, BV2, _second("k", FLAT), select=Q.bands("ko", KEY1, 3)))
def boot_lrmax_corrected(spark, sf):
    return _one(spark, B.corrected(spark, _plan(spark, sf, extra={"target": 1}), REPS), B.by_long_run_max)


@query(base(*RESIDUAL, SIM, BV, *CORRECT, SIM2, BV2, _second("k"), select=Q.bands("ko", KEY1, 3)))
def boot_maxshare_corrected(spark, sf):
    return _one(spark, B.corrected(spark, _plan(spark, sf, extra={"target": 1}), REPS), B.by_max_share)


# Moving blocks of 6 rows over the instrument's window.
SIZE = 6
BLOCKS = (
    "wi AS (SELECT row_number() OVER (ORDER BY t) - 1 AS r, t, u1, u2, z FROM e WHERE inside)",
    "wn AS (SELECT count(*)::BIGINT AS n FROM wi)",
    f"bl AS ({Q.draws(7, REPS, '(SELECT (n + 5) // 6 FROM wn)')})",
    f"pl AS (SELECT k, avg(u1) AS c1, avg(u2) AS c2, coalesce(avg(z) FILTER (WHERE z <> 0), 0) AS cz FROM wi, (SELECT unnest(range({SIZE})) AS k), wn WHERE r >= k AND r <= k + n - {SIZE} GROUP BY k)",
    f"dw AS (SELECT b AS g, bl.i * {SIZE} + k AS r, bl.u % (n - {SIZE} + 1) + k AS src, k FROM bl, pl, wn WHERE bl.i * {SIZE} + k < n)",
    "mb AS (SELECT dw.g, dw.r, a.t, o.u1 - c1 AS e1, o.u2 - c2 AS e2, CASE WHEN o.z <> 0 THEN o.z - cz ELSE 0 END AS z FROM dw JOIN wi o ON o.r = dw.src JOIN pl USING (k) JOIN wi a ON a.r = dw.r)",
)
BLOCKED = *BLOCKS, "rs AS (SELECT g, t, e1, e2 FROM mb UNION ALL SELECT k.g, v_u.t, u1, u2 FROM v_u, (SELECT unnest(range(" + str(REPS) + ")) AS g) k WHERE t < 20)"
BUZ = "bz AS (SELECT u.g, u.t, u1, u2, mb.z FROM b_u u JOIN mb ON mb.g = u.g AND mb.t = u.t)", "bi AS (SELECT g, sum(z * u2) / sum(z * u1) AS s2 FROM bz GROUP BY g)"


def _block_plan(spark, sf, **extra) -> B.Plan:
    v = var(spark, sf)
    z, rows = _inside(spark, sf, v)
    return B.plan(v, HORIZON, generator="hash", scheme="block", z=z, rows=rows, block=SIZE, extra=extra)


def _sample(spark, sf) -> DataFrame:
    q = _block_plan(spark, sf)
    d = B.draw(q, range(3))
    return frame(spark, [(b, int(r), float(d.u[b, q.rows[r], 0]), float(d.u[b, q.rows[r], 1]), float(d.z[b, r])) for b in range(3) for r in range(len(q.rows))], "b int, r int, e1 double, e2 double, z double")


@query(base_z(UZ, *BLOCKS, select=f"SELECT g AS b, r, {out('e1', 'e2')} FROM mb WHERE g < 3"))
def mbb_sample(spark, sf):
    return rounded(_sample(spark, sf).drop("z"))


@query(base_z(UZ, *BLOCKS, select=f"SELECT g AS b, r, {out('e1', 'e2', 'z')} FROM mb WHERE g < 3"))
def mbb_sample_instr(spark, sf):
    return rounded(_sample(spark, sf))


def _two(ma: str, s: str, factor: str = "1") -> str:
    return " UNION ALL ".join(f"SELECT w.g, 'y{i}' AS variable, h AS horizon, {factor} * (f{i}1 + f{i}2 * s2) AS value FROM {ma} w JOIN {s} USING (g)" for i in (1, 2))


@query(base_z(UZ, *BLOCKED, SIM, BV, *BUZ, f"bp AS ({_two('b_w', 'bi')})", select=Q.bands("bp", KEY1, 2)))
def boot_proxy_mbb(spark, sf):
    return _one(spark, _block_plan(spark, sf, policy=0), B.by_instrument, 2)


BH = "tz AS (SELECT * FROM bz WHERE abs(z) > 1e-14)", "th AS (SELECT g, covar_pop(u2, z) / covar_pop(u1, z) AS s2 FROM tz GROUP BY g HAVING count(*) >= 15)"


@query(
    base_z(UZ, *BLOCKED, SIM, BV, *BUZ, *BH, *TREAT, f"bp AS ({_two('b_w', 'th', '10')})",
           f"qt AS (SELECT variable, horizon, quantile_cont(value, 0.05) AS lower, quantile_cont(value, 0.95) AS upper, quantile_cont(value, 0.16) AS lower2, quantile_cont(value, 0.84) AS upper2, quantile_cont(value, 0.5) AS median, avg(value) AS mean, list_sort(list(value))[(count(*) // 2)::INTEGER + 1] AS mid FROM bp GROUP BY ALL)",
           "pt AS (SELECT h AS horizon, variable, CASE WHEN variable = 'y1' THEN 10 * (f11 + f12 * s2) ELSE 10 * (f21 + f22 * s2) END AS point FROM v_w, tb, (VALUES ('y1'), ('y2')) n(variable))",
           select=f"SELECT variable, horizon, {out('point', 'lower + point - mid as lower', 'upper + point - mid as upper', 'lower2 + point - mid as lower2', 'upper2 + point - mid as upper2', 'median', 'mean', digits=2)} FROM qt JOIN pt USING (variable, horizon)")
)
def boot_hetero(spark, sf):
    v, s = _hetero(spark, sf)
    draws = B.replicate(spark, _block_plan(spark, sf, variable=0, scale_to=10.0), REPS, B.by_treatment)
    point = R.response(spark, v.wold(HORIZON) @ s, NAMES)
    return rounded(B.recentred(draws, point, ["variable", "horizon"], order_statistic=True), 2)


def _impulses(n: str, s: str) -> str:
    """The unit-normalised shock by group and time, from residuals and covariances of n and impact vectors (1, s2) of s."""
    return f"(SELECT u.g, t, s2, (u1 * (s22 - s12 * s2) + u2 * (s2 * s11 - s12)) / (s22 - 2 * s2 * s12 + s2 * s2 * s11) AS e FROM {n}_u u JOIN {n}_v USING (g) JOIN {s} USING (g))"


def _histories(n: str, s: str, ma: str) -> str:
    return " UNION ALL ".join(f"SELECT e.g, 'y{i}' AS variable, e.t + w.h - 2 AS horizon, sum((f{i}1 + f{i}2 * s2) * e.e) AS value FROM {_impulses(n, s)} e JOIN {ma}_w w ON w.g = e.g WHERE e.t + w.h <= (SELECT max(t) FROM s) GROUP BY ALL" for i in (1, 2))


@query(
    base_z(UZ, IVS, *BLOCKED, SIM, BV, *BUZ, Q.var1("bl", "sm", 80), VL, "iv0 AS (SELECT 0::BIGINT AS g, s2 FROM iv)", f"hb AS ({_histories('b', 'bi', 'bl')})", f"hp AS ({_histories('v', 'iv0', 'vl')})",
           "qt AS (SELECT variable, horizon, quantile_cont(value, 0.05) AS lower, quantile_cont(value, 0.95) AS upper, quantile_cont(value, 0.16) AS lower2, quantile_cont(value, 0.84) AS upper2, quantile_cont(value, 0.5) AS median, avg(value) AS mean FROM hb GROUP BY ALL)",
           select="SELECT variable, horizon, " + out("hp.value as point", *(f"{c} + hp.value - median as {c}" for c in ("lower", "upper", "lower2", "upper2")), "median", "mean", digits=2) + " FROM qt JOIN hp USING (variable, horizon)")
)
def boot_hd_iv(spark, sf):
    v, s = _iv(spark, sf)
    draws = B.replicate(spark, _block_plan(spark, sf, policy=0), REPS, B.by_history)
    return rounded(B.recentred(draws, R.response(spark, D.historical_iv(v, s), NAMES), ["variable", "horizon"]), 2)


@query(
    base_z(*WILD, SIM, BV, "zb AS (SELECT k.g, z.t, CASE WHEN z.t = 1 OR dr.u % 2 = 0 THEN z.z ELSE -z.z END AS z FROM z CROSS JOIN (SELECT DISTINCT g FROM rs) k LEFT JOIN dr ON dr.b = k.g AND dr.i + 2 = z.t)",
           "cw0 AS (SELECT sm.g, sm.t, z AS zz, lag(z) OVER w AS z_l1, lag(y1) OVER w AS y1_l1, lag(y2) OVER w AS y2_l1 FROM sm JOIN zb USING (g, t) WINDOW w AS (PARTITION BY sm.g ORDER BY sm.t))",
           Q.ols("cw", "cw0", ["zz"], ["z_l1", "y1_l1", "y2_l1"]),
           "ws AS (SELECT c.g, sum(u_zz * u2) / sum(u_zz * u1) AS s2 FROM cw_u c JOIN b_u u ON u.g = c.g AND u.t = c.t GROUP BY c.g)",
           "wz AS (SELECT g, s2, sqrt((s22 - 2 * s2 * s12 + s2 * s2 * s11) / (s11 * s22 - s12 * s12)) AS size FROM ws JOIN b_v USING (g))",
           "wr AS (SELECT g, 'y1' AS variable, h AS horizon, (f11 + f12 * s2) / size AS value FROM b_w JOIN wz USING (g) UNION ALL SELECT g, 'y2', h, sum((f21 + f22 * s2) / size) OVER (PARTITION BY g ORDER BY h ROWS UNBOUNDED PRECEDING) FROM b_w JOIN wz USING (g))",
           select=Q.bands("wr", KEY1, 2))
)
def boot_iv_wild(spark, sf):
    z = z_array(spark, sf)
    q = _plan(spark, sf, scheme="wild", z=z[1:], extra={"first": z[:1], "cumulate": [1]})
    return _one(spark, q, B.by_clean_instrument, 2)


@query(
    base_z(*CLEAN, CZ, INVERT[0], f"dq AS ({Q.draws(7, REPS, '(SELECT n::BIGINT - 1 FROM v_v)')})",
           "rq AS (SELECT dq.b AS g, dq.i + 2 AS t, r.u1 AS e1, r.u2 AS e2, r.u_zc AS nz FROM dq JOIN inw_u r ON r.t = 2 + dq.u % (SELECT n::BIGINT - 1 FROM v_v) UNION ALL SELECT k.b, v_u.t, u1, u2, NULL FROM v_u, (SELECT DISTINCT b FROM dq) k WHERE v_u.t = (SELECT max(t) FROM s))",
           "rs AS (SELECT g, t, e1, e2 FROM rq)", SIM, BV,
           "ri AS (SELECT rq.g, rq.t, k_zc + zc_u1 * e1 + zc_u2 * e2 + zc_u1f * lead(e1) OVER w + zc_u2f * lead(e2) OVER w + nz AS z FROM rq, inw_b WINDOW w AS (PARTITION BY rq.g ORDER BY rq.t))",
           "rz AS (SELECT g, t, z FROM ri WHERE z IS NOT NULL UNION ALL SELECT k.b, 1, z.z FROM z, (SELECT DISTINCT b FROM dq) k WHERE z.t = 1)",
           "rc0 AS (SELECT sm.g, sm.t, z AS zz, lag(z) OVER w AS z_l1, lag(y1) OVER w AS y1_l1, lag(y2) OVER w AS y2_l1 FROM sm JOIN rz USING (g, t) WINDOW w AS (PARTITION BY sm.g ORDER BY sm.t))",
           Q.ols("rc", "rc0", ["zz"], ["z_l1", "y1_l1", "y2_l1"]),
           "rp0 AS (SELECT c.g, c.t, u1, u2, u_zz AS zc, lag(u_zz) OVER (PARTITION BY c.g ORDER BY c.t) AS zc_l1 FROM rc_u c JOIN b_u u ON u.g = c.g AND u.t = c.t)",
           Q.ols("rp", "rp0", ["u1", "u2"], ["zc", "zc_l1"]),
           "ra AS (SELECT g, u1_zc AS p01, u2_zc AS p02, u1_zc_l1 AS p11, u2_zc_l1 AS p12, sqrt(((u1_zc ** 2 + u1_zc_l1 ** 2) * s22 - 2 * (u1_zc * u2_zc + u1_zc_l1 * u2_zc_l1) * s12 + (u2_zc ** 2 + u2_zc_l1 ** 2) * s11) / (s11 * s22 - s12 * s12)) AS a FROM rp_b JOIN b_v USING (g))",
           "rr AS (SELECT w.g, w.h, (w.f11 * p01 + w.f12 * p02 + coalesce(l.f11 * p11 + l.f12 * p12, 0)) / a AS r1, (w.f21 * p01 + w.f22 * p02 + coalesce(l.f21 * p11 + l.f22 * p12, 0)) / a AS r2 FROM b_w w JOIN ra USING (g) LEFT JOIN b_w l ON l.g = w.g AND l.h = w.h - 1)",
           "rg AS (SELECT g, CASE WHEN r1 < 0 THEN -1 ELSE 1 END AS sg FROM rr WHERE h = 0)",
           "ro AS (SELECT g, 'y1' AS variable, h AS horizon, r1 * sg AS value FROM rr JOIN rg USING (g) UNION ALL SELECT g, 'y2', h, r2 * sg FROM rr JOIN rg USING (g))",
           select=Q.bands("ro", KEY1, 2))
)
def boot_iv_recover(spark, sf):
    _, u, z = _cleaned(spark, sf)
    r = I.invertibility(z, u, 1)
    q = _plan(spark, sf, extra={"leads": 1, "delta": r["delta"], "noise": r["rest"], "first": z_array(spark, sf)[:1]})
    return rounded(B.bands(B.replicate(spark, q, REPS, B.by_recovery, B.recovery_draws), ("variable", "horizon")), 2)


def _msw_sql(lags: int, confidence: float = 0.9) -> tuple[str, ...]:
    """ms: the weak-instrument sets of a first-order model, by scalar influences: of each response's numerator (q) and of the target's covariance (w)."""
    crit = NormalDist().inv_cdf(0.5 + confidence / 2) ** 2

    def covariance(a: str, b: str) -> str:
        more = "".join(f" + {1 - k / (lags + 1)} * (sum({a} * {b}_l{k}) + sum({a}_l{k} * {b})) / count(*)" for k in range(1, lags + 1))
        return f"sum({a} * {b}) / count(*){more}"

    lagged = "".join(f", lag({c}, {k}, 0) OVER o AS {c}_l{k}" for k in range(1, lags + 1) for c in "qw")
    lag_terms = " UNION ALL ".join(f"SELECT a.h + b.h + 1 AS h, {j} AS j, a.f{j}1 * b.c1 AS r11, a.f{j}2 * b.c1 AS r21, a.f{j}1 * b.c2 AS r12, a.f{j}2 * b.c2 AS r22 FROM v_w a, mc b WHERE a.h + b.h < {HORIZON}" for j in (1, 2))
    return (
        "mx0 AS (SELECT d.t, d.x1, d.x2, u1, u2, e.z FROM v_d d JOIN e USING (t) WHERE e.inside)",
        "mq AS (SELECT count(*)::DOUBLE AS tt, avg(x1) AS m1, avg(x2) AS m2, avg(z) AS mz, covar_pop(x1, x1) AS c11, covar_pop(x1, x2) AS c12, covar_pop(x2, x2) AS c22, covar_pop(x1, z) AS cz1, covar_pop(x2, z) AS cz2, sum(z * u1) / count(*) AS g1, sum(z * u2) / count(*) AS g2 FROM mx0)",
        "mi AS (SELECT t, a1 * u1 AS p11, a1 * u2 AS p21, a2 * u1 AS p12, a2 * u2 AS p22, zr * u1 AS w1, zr * u2 AS w2 FROM (SELECT t, u1, u2, (c22 * (x1 - m1) - c12 * (x2 - m2)) / det AS a1, (c11 * (x2 - m2) - c12 * (x1 - m1)) / det AS a2, "
        "z - mz - (c22 * cz1 - c12 * cz2) / det * (x1 - m1) - (c11 * cz2 - c12 * cz1) / det * (x2 - m2) AS zr FROM mx0, (SELECT *, c11 * c22 - c12 * c12 AS det FROM mq)))",
        "mc AS (SELECT h, f11 * g1 + f12 * g2 AS c1, f21 * g1 + f22 * g2 AS c2 FROM v_w, mq)",
        f"mr AS (SELECT h, j, sum(r11) AS r11, sum(r21) AS r21, sum(r12) AS r12, sum(r22) AS r22 FROM ({lag_terms}) GROUP BY h, j)",
        "mh AS (SELECT w.h, n.j, CASE n.j WHEN 1 THEN f11 ELSE f21 END AS s1, CASE n.j WHEN 1 THEN f12 ELSE f22 END AS s2, CASE n.j WHEN 1 THEN c1 ELSE c2 END AS cg, coalesce(r11, 0) AS r11, coalesce(r21, 0) AS r21, coalesce(r12, 0) AS r12, coalesce(r22, 0) AS r22 FROM v_w w JOIN mc USING (h) CROSS JOIN (VALUES (1), (2)) n(j) LEFT JOIN mr ON mr.h = w.h AND mr.j = n.j)",
        "mt AS (SELECT h, j, cg, t, r11 * p11 + r21 * p21 + r12 * p12 + r22 * p22 + s1 * w1 + s2 * w2 AS q, w1 AS w FROM mh, mi)",
        "md AS (SELECT h, j, cg, t, q - avg(q) OVER (PARTITION BY h, j) AS q, w - avg(w) OVER (PARTITION BY h, j) AS w FROM mt)",
        f"ml AS (SELECT *{lagged} FROM md WINDOW o AS (PARTITION BY h, j ORDER BY t))",
        f"mv AS (SELECT h, j, any_value(cg) AS cg, {covariance('q', 'q')} AS vq, {covariance('q', 'w')} AS vqw, {covariance('w', 'w')} AS vw FROM ml GROUP BY h, j)",
        f"mm AS (SELECT h, j, cg / g1 AS irf, sqrt(greatest(vq / (g1 * g1) - 2 * cg / g1 * vqw / (g1 * g1) + (cg / g1) ** 2 * vw / (g1 * g1), 0) / tt) AS se, tt * g1 * g1 - {crit!r} * vw AS a, -2 * tt * cg * g1 + 2 * {crit!r} * vqw AS b, tt * cg * cg - {crit!r} * vq AS c FROM mv, mq)",
        f"ms AS (SELECT 'y' || j AS variable, h AS horizon, irf, se, irf - sqrt({crit!r}) * se AS dm_lower, irf + sqrt({crit!r}) * se AS dm_upper, "
        "CASE WHEN h = 0 AND j = 1 THEN 1.0 WHEN b * b - 4 * a * c > 0 THEN least((-b - sqrt(b * b - 4 * a * c)) / (2 * a), (-b + sqrt(b * b - 4 * a * c)) / (2 * a)) END AS ar_lower, "
        "CASE WHEN h = 0 AND j = 1 THEN 1.0 WHEN b * b - 4 * a * c > 0 THEN greatest((-b - sqrt(b * b - 4 * a * c)) / (2 * a), (-b + sqrt(b * b - 4 * a * c)) / (2 * a)) END AS ar_upper, "
        "CASE WHEN h = 0 AND j = 1 THEN 'interval' WHEN b * b - 4 * a * c > 0 THEN CASE WHEN a > 0 THEN 'interval' ELSE 'complement' END WHEN a > 0 THEN 'empty' ELSE 'real_line' END AS set_kind FROM mm)",
    )


SETS = ["irf", "se", "dm_lower", "dm_upper", "ar_lower", "ar_upper"]


def _sets(spark, sf, lags: int) -> DataFrame:
    v = var(spark, sf)
    z, rows = _inside(spark, sf, v)
    r = I.weak_iv_sets(v, z, rows, HORIZON, 0, lags=lags)
    # A missing end is null, as in SQL.
    ends = lambda k, h, i: None if np.isnan(r[k][h, i]) else float(r[k][h, i])
    made = [(n, h, *(ends(k, h, i) for k in SETS), str(r["set_kind"][h, i])) for h in range(HORIZON + 1) for i, n in enumerate(NAMES)]
    return frame(spark, made, "variable string, horizon int, " + ", ".join(f"{k} double" for k in SETS) + ", set_kind string")


@query(base_z(UZ, *_msw_sql(0), select="SELECT variable, horizon, " + out(*SETS) + ", set_kind FROM ms"))
def msw(spark, sf):
    return rounded(_sets(spark, sf, 0))


@query(base_z(UZ, *_msw_sql(3), select="SELECT variable, horizon, " + out(*SETS) + ", set_kind FROM ms"))
def msw_newey_west(spark, sf):
    return rounded(_sets(spark, sf, 3))


@query(base_z(UZ, *_msw_sql(0), select="SELECT 'policy' AS shock, variable, horizon, " + out("10 * irf as point", "10 * dm_lower as dm_lo", "10 * dm_upper as dm_hi", "10 * ar_lower as ar_lo", "10 * ar_upper as ar_hi", digits=3) + " FROM ms"))
def msw_tidy(spark, sf):
    return rounded(T.sets(_sets(spark, sf, 0), "policy", 10.0), 3)


@query(base_z(UZ, "ei AS (SELECT u1, u2, z FROM e WHERE inside)", select="SELECT " + out("count(*) * (sum(z * u1) / count(*)) ** 2 / var_pop(z * u1) as wald", digits=3) + " FROM ei"))
def msw_wald_zero_lag(spark, sf):
    """Of the instrument's strength, the part that the products with the target's residual give: the weak-instrument statistic without the lags' estimation error."""
    d = var(spark, sf).residuals().join(instrument(spark, sf).where("inside"), "t")
    p = F.col("z") * F.col("u_y1")
    return rounded(d.agg((F.count(F.lit(1)) * F.pow(F.sum(p) / F.count(F.lit(1)), 2) / F.var_pop(p)).alias("wald")), 3)


@query(base(*RESIDUAL, SIM, BV, f"bb AS ({Q.bands('b_i', KEYS, 3)})", select="SELECT v.variable, v.horizon, " + out("v.value as point", "bb.lower as lower", "bb.upper as upper", "bb.lower2 as lower2", "bb.upper2 as upper2", digits=3) + " FROM v_i v JOIN bb USING (variable, shock, horizon) WHERE v.shock = 'y1'"))
def irf_tidy(spark, sf):
    point = R.responses(spark, R.cholesky_irf(var(spark, sf), HORIZON), NAMES)
    return rounded(T.irf_with_bands(point, boot_chol(spark, sf), "y1"), 3)


@query(
    base(*RESIDUAL, SIM, BV, Q.long_run("b"), LR, _cum(Q.cells("b_q")), f"bb AS ({Q.bands('cu', KEYS, 3)})",
         f"pq AS (SELECT variable, shock, horizon, CASE WHEN variable = 'y1' THEN sum(value) OVER (PARTITION BY variable, shock ORDER BY horizon ROWS UNBOUNDED PRECEDING) ELSE value END AS point FROM ({Q.cells('v_q')}))",
         select="SELECT variable, horizon, " + out("point", "lower", "upper", "lower2", "upper2", digits=3) + " FROM pq JOIN bb USING (variable, shock, horizon) WHERE shock = 'y2'")
)
def irf_tidy_bq(spark, sf):
    point = R.responses(spark, R.long_run_irf(var(spark, sf), HORIZON), NAMES)
    return rounded(T.irf_with_bands(point, boot_bq(spark, sf), "y2", cumulate=["y1"]), 3)


@query(base_z(UZ, *BLOCKED, SIM, BV, *BUZ, f"bp AS ({_two('b_w', 'bi')})", f"bb AS ({Q.bands('bp', KEY1, 2)})", select="SELECT variable, horizon, " + out("mean * 10 as point", *(f"{c} * 10 as {c}" for c in ("lower", "upper", "lower2", "upper2")), digits=1) + " FROM bb"))
def irf_tidy_iv(spark, sf):
    return rounded(T.mean_with_bands(boot_proxy_mbb(spark, sf), scale=10.0), 1)


@query(base("lr AS (SELECT *, CASE WHEN r12 < 0 THEN -1 ELSE 1 END AS sg FROM v_c WHERE h = (SELECT max(h) FROM v_c))", select="SELECT variable, horizon, " + out("point") + " FROM (SELECT 'y1' AS variable, c.h AS horizon, c.r12 * sg AS point FROM v_c c, lr UNION ALL SELECT 'y2', c.h, c.r22 * sg FROM v_c c, lr)"))
def irf_tidy_lr(spark, sf):
    return rounded(T.irf_with_bands(lrmax_irf(spark, sf), None, keys=("variable", "horizon")))


@query(base(*RESIDUAL, SIM, BV, Q.long_run("b"), "bq AS (SELECT q.g, q.h, r11 / k11 * 2 AS r11, r12 / k11 * 2 AS r12, r21 / k11 * 2 AS r21, r22 / k11 * 2 AS r22 FROM b_q q JOIN b_kk USING (g))", f"bs0 AS ({Q.cells('bq')})", select=Q.bands("bs0", KEYS, 2)))
def boot_bq_scaled(spark, sf):
    return rounded(B.bands(B.replicate(spark, _plan(spark, sf, extra={"scale": (0, 2.0)}), REPS, B.by_long_run)), 2)


@query(
    "WITH RECURSIVE m AS (SELECT c_mktsegment AS g, date_trunc('month', o_orderdate) AS ts, 100 * ln(sum(o_totalprice)) AS y1, 100 * ln(count(*)) AS y2 FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), "
    "s AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY ts) AS t, y1, y2 FROM m WHERE ts < (SELECT max(ts) FROM m)), "
    + V
    + "\nSELECT g AS c_mktsegment, variable, shock, horizon, " + out("value") + " FROM v_i"
)
def panel_irf(spark, sf):
    facts = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    m = {"y1": 100 * F.log(F.sum("o_totalprice")), "y2": 100 * F.log(F.count(F.lit(1)))}
    return rounded(P.panel_irf(S.periods(facts, "o_orderdate", "month", m, ["c_mktsegment"], drop_last=True), "c_mktsegment", NAMES, 1, HORIZON))
