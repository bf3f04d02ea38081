"""DuckDB SQL for the registered queries: first-order, two-variable models by group g, from common table expressions."""

from __future__ import annotations

ORDERS = """
m AS (SELECT date_trunc('month', o_orderdate) AS ts, 100 * ln(sum(o_totalprice)) AS y1, 100 * ln(count(*)) AS y2 FROM orders GROUP BY 1),
s AS (SELECT 0::BIGINT AS g, row_number() OVER (ORDER BY ts) AS t, ts, y1, y2 FROM m WHERE ts < (SELECT max(ts) FROM m))"""

SHIP = """
zm AS (SELECT date_trunc('month', l_shipdate) AS ts, avg(l_discount) AS d FROM lineitem GROUP BY 1),
zs AS (SELECT ts, 1000 * (d - avg(d) OVER ()) AS d FROM zm WHERE ts < (SELECT max(ts) FROM zm)),
z AS (SELECT s.t, CASE WHEN s.t % 3 = 0 THEN zs.d ELSE 0.0 END AS z, s.t >= 20 AS inside FROM s JOIN zs USING (ts))"""


def var1(n: str, src: str, horizon: int = 12) -> str:
    """d: lags, b: coefficients, u: residuals, v: covariance, w: moving average, p: Cholesky factor, i: its responses in rows."""
    return f"""
{n}_d AS (SELECT g, t, y1, y2, lag(y1) OVER w AS x1, lag(y2) OVER w AS x2 FROM {src} WINDOW w AS (PARTITION BY g ORDER BY t)),
{n}_m AS (SELECT g, count(*) AS n, avg(x1) AS mx1, avg(x2) AS mx2, avg(y1) AS my1, avg(y2) AS my2,
  covar_pop(x1, x1) AS c11, covar_pop(x1, x2) AS c12, covar_pop(x2, x2) AS c22,
  covar_pop(x1, y1) AS d11, covar_pop(x2, y1) AS d21, covar_pop(x1, y2) AS d12, covar_pop(x2, y2) AS d22
  FROM {n}_d WHERE x1 IS NOT NULL GROUP BY g),
{n}_k AS (SELECT *, (c22 * d11 - c12 * d21) / (c11 * c22 - c12 * c12) AS a11, (c11 * d21 - c12 * d11) / (c11 * c22 - c12 * c12) AS a12,
  (c22 * d12 - c12 * d22) / (c11 * c22 - c12 * c12) AS a21, (c11 * d22 - c12 * d12) / (c11 * c22 - c12 * c12) AS a22 FROM {n}_m),
{n}_b AS (SELECT g, n, a11, a12, a21, a22, my1 - a11 * mx1 - a12 * mx2 AS k1, my2 - a21 * mx1 - a22 * mx2 AS k2 FROM {n}_k),
{n}_u AS (SELECT g, t, y1 - k1 - a11 * x1 - a12 * x2 AS u1, y2 - k2 - a21 * x1 - a22 * x2 AS u2 FROM {n}_d JOIN {n}_b USING (g) WHERE x1 IS NOT NULL),
{n}_v AS (SELECT g, count(*) AS n, sum(u1 * u1) / (count(*) - 3) AS s11, sum(u1 * u2) / (count(*) - 3) AS s12, sum(u2 * u2) / (count(*) - 3) AS s22 FROM {n}_u GROUP BY g),
{n}_w(g, h, f11, f12, f21, f22) AS (
  SELECT g, 0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM {n}_b
  UNION ALL SELECT w.g, w.h + 1, f11 * a11 + f12 * a21, f11 * a12 + f12 * a22, f21 * a11 + f22 * a21, f21 * a12 + f22 * a22
  FROM {n}_w w JOIN {n}_b b ON b.g = w.g WHERE w.h < {horizon}),
{n}_p AS (SELECT g, sqrt(s11) AS l11, s12 / sqrt(s11) AS l21, sqrt(s22 - s12 * s12 / s11) AS l22 FROM {n}_v),
{n}_c AS (SELECT g, h, f11 * l11 + f12 * l21 AS r11, f12 * l22 AS r12, f21 * l11 + f22 * l21 AS r21, f22 * l22 AS r22 FROM {n}_w JOIN {n}_p USING (g)),
{n}_i AS ({cells(f"{n}_c")})"""


def cells(src: str) -> str:
    """Rows of responses from a frame of r11 .. r22."""
    return " UNION ALL ".join(f"SELECT g, 'y{i}' AS variable, 'y{j}' AS shock, h AS horizon, r{i}{j} AS value FROM {src}" for i in (1, 2) for j in (1, 2))


def long_run(n: str) -> str:
    """k: the long-run impact matrix, q: its responses in r11 .. r22."""
    return f"""
{n}_t AS (SELECT g, sum(f11) AS t11, sum(f12) AS t12, sum(f21) AS t21, sum(f22) AS t22 FROM {n}_w GROUP BY g),
{n}_o AS (SELECT *, t11 * (t11 * s11 + t12 * s12) + t12 * (t11 * s12 + t12 * s22) AS o11,
  t21 * (t11 * s11 + t12 * s12) + t22 * (t11 * s12 + t12 * s22) AS o12,
  t21 * (t21 * s11 + t22 * s12) + t22 * (t21 * s12 + t22 * s22) AS o22 FROM {n}_t JOIN {n}_v USING (g)),
{n}_e AS (SELECT *, sqrt(o11) AS e11, o12 / sqrt(o11) AS e21, sqrt(o22 - o12 * o12 / o11) AS e22, t11 * t22 - t12 * t21 AS det FROM {n}_o),
{n}_kk AS (SELECT g, (t22 * e11 - t12 * e21) / det AS k11, -t12 * e22 / det AS k12, (t11 * e21 - t21 * e11) / det AS k21, t11 * e22 / det AS k22 FROM {n}_e),
{n}_q AS (SELECT g, h, f11 * k11 + f12 * k21 AS r11, f11 * k12 + f12 * k22 AS r12, f21 * k11 + f22 * k21 AS r21, f21 * k12 + f22 * k22 AS r22 FROM {n}_w JOIN {n}_kk USING (g))"""


def draws(seed: int, reps: int, n: str) -> str:
    """Integers u of the hash draws by replication b and place i below n (an expression)."""
    return f"SELECT b, i, ('0x' || substr(md5('{seed}:' || b || ':' || i), 1, 15))::BIGINT AS u FROM (SELECT unnest(range({reps})) AS b), (SELECT unnest(range({n})) AS i)"


def simulated(n: str, shocks: str, beta: str = "v_b") -> str:
    """Series by replication from shocks (g, t, e1, e2), t from 2 on, and coefficients of group 0 of beta."""
    return f"""
{n}(g, t, y1, y2) AS (
  SELECT k.g, s.t, s.y1, s.y2 FROM (SELECT DISTINCT g FROM {shocks}) k, s WHERE s.t = 1
  UNION ALL SELECT p.g, p.t + 1, b.k1 + b.a11 * p.y1 + b.a12 * p.y2 + e.e1, b.k2 + b.a21 * p.y1 + b.a22 * p.y2 + e.e2
  FROM {n} p JOIN {shocks} e ON e.g = p.g AND e.t = p.t + 1 CROSS JOIN {beta} b WHERE b.g = 0)"""


def bands(src: str, keys: str, digits: int = 4) -> str:
    q = ", ".join(f"round(quantile_cont(value, {p}), {digits}) AS {n}" for p, n in ((0.05, "lower"), (0.95, "upper"), (0.16, "lower2"), (0.84, "upper2"), (0.5, "median")))
    return f"SELECT {keys}, {q}, round(avg(value), {digits}) AS mean FROM {src} GROUP BY ALL"


def with_(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select


def det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    terms = []
    for j, head in enumerate(m[0]):
        rest = [[c for k, c in enumerate(r) if k != j] for r in m[1:]]
        terms.append(f"{'-' if j % 2 else '+'} {head} * ({det(rest)})")
    return " ".join(terms).removeprefix("+ ")


def ols(n: str, src: str, targets: list[str], regressors: list[str]) -> str:
    """b: intercept k_<target> and slopes <target>_<regressor> by Cramer's rule, rows n, and sums of residual products e_<a>_<b>; u: residuals u_<target> by g and t."""
    k = len(regressors)
    names = [*regressors, *targets]
    full = " AND ".join(f"{v} IS NOT NULL" for v in names)
    covs = ", ".join(f"covar_pop({a}, {b}) AS c_{a}_{b}" for i, a in enumerate(names) for b in names[i:])
    means = ", ".join(f"avg({v}) AS m_{v}" for v in names)

    def cov(a: str, b: str) -> str:
        return f"c_{a}_{b}" if names.index(a) <= names.index(b) else f"c_{b}_{a}"

    base = [[cov(a, b) for b in regressors] for a in regressors]
    slopes = ", ".join(f"({det([[cov(a, t) if j == i else base[r][j] for j in range(k)] for r, a in enumerate(regressors)])}) / det AS {t}_{x}" for t in targets for i, x in enumerate(regressors))
    consts = ", ".join("m_{t} - ({s}) AS k_{t}".format(t=t, s=" + ".join(f"{t}_{x} * m_{x}" for x in regressors)) for t in targets)
    ssr = ", ".join("n * ({c} - ({s})) AS e_{a}_{b}".format(a=a, b=b, c=cov(a, b), s=" + ".join(f"{b}_{x} * {cov(x, a)}" for x in regressors)) for i, a in enumerate(targets) for b in targets[i:])
    resid = ", ".join("{t} - k_{t} - ({s}) AS u_{t}".format(t=t, s=" + ".join(f"{t}_{x} * {x}" for x in regressors)) for t in targets)
    return f"""
{n}_m AS (SELECT g, count(*) AS n, {means}, {covs} FROM {src} WHERE {full} GROUP BY g),
{n}_d AS (SELECT *, {det(base)} AS det FROM {n}_m),
{n}_k AS (SELECT *, {slopes} FROM {n}_d),
{n}_b AS (SELECT *, {consts}, {ssr} FROM {n}_k),
{n}_u AS (SELECT a.*, {resid} FROM (SELECT * FROM {src} WHERE {full}) a JOIN (SELECT g, {', '.join(f'k_{t}' for t in targets)}, {', '.join(f'{t}_{x}' for t in targets for x in regressors)} FROM {n}_b) b USING (g))"""
