"""DuckDB SQL for the registered queries of the mixture laboratory, written apart from them."""

from __future__ import annotations

import re

SALT_INNER = "".join(f"{b ^ 0x36:02x}" for b in bytes(range(32)).ljust(64, b"\0"))
SALT_OUTER = "".join(f"{b ^ 0x5C:02x}" for b in bytes(range(32)).ljust(64, b"\0"))

_STATES = """
st AS (SELECT 'formal-' || lpad((date_diff('day', DATE '2024-01-01', ts::DATE) + 1)::VARCHAR, 4, '0') AS block_id, (hour(ts) // 4)::INTEGER AS snapshot_index, event_id AS ordinal,
         lower(lpad(to_hex(user_id), 6, '0')) AS identity, value AS velocity, json_extract_string(props, '$.k')::INTEGER * 3.6::DOUBLE AS true_track,
         ((event_id * 37) % 101 - 50) / 5.0::DOUBLE AS vertical_rate, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 1 END AS category, ts
       FROM events)"""
_BAD = """
bad AS (SELECT block_id, snapshot_index, ordinal, CASE WHEN ordinal % 53 = 0 THEN 'xyz' WHEN ordinal % 67 = 0 THEN NULL ELSE identity END AS identity,
          CASE WHEN ordinal % 59 = 0 THEN -velocity - 1 WHEN ordinal % 61 = 0 THEN 'inf'::DOUBLE WHEN ordinal % 71 = 0 THEN NULL ELSE velocity END AS velocity,
          CASE WHEN ordinal % 73 = 0 THEN 'nan'::DOUBLE ELSE true_track END AS true_track, vertical_rate, CASE WHEN ordinal % 7 = 0 THEN category + 19 ELSE category END AS category FROM st)"""


def _accepted(source: str) -> str:
    return f"""
good AS (SELECT *, coalesce(regexp_full_match(identity, '[0-9a-fA-F]{{6}}') AND isfinite(velocity) AND isfinite(true_track) AND isfinite(vertical_rate) AND velocity >= 0, false) AS good FROM {source}),
mark AS (SELECT *, good AND row_number() OVER (PARTITION BY block_id, snapshot_index, good, lower(identity) ORDER BY ordinal) = 1 AS accepted FROM good),
obs AS (SELECT block_id, snapshot_index, ordinal, identity, velocity, true_track, vertical_rate, CASE WHEN category BETWEEN 0 AND 20 THEN category END AS category,
          (row_number() OVER (PARTITION BY block_id, snapshot_index ORDER BY ordinal) - 1)::INTEGER AS obs_index, ln(1 + velocity) AS x0, asinh(vertical_rate / 5) AS x1,
          radians(true_track - 360 * floor(true_track / 360)) AS theta FROM mark WHERE accepted)"""


_OBS = "WITH" + _STATES + "," + _accepted("st")
_SEED = "(('0x' || substr(sha256('2026|' || block_id || '|' || snapshot_index), 9, 8))::BIGINT)"
_KEPT = (
    _OBS
    + f""",
uni AS (SELECT *, (('0x' || substr(sha256({_SEED}::VARCHAR || '|' || obs_index), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0 AS u FROM obs),
kept AS (SELECT * FROM uni JOIN (SELECT unnest([0.0, 0.15, 0.3])::DOUBLE AS dropout_rate) ON u >= dropout_rate)"""
)
_USABLE = "(category BETWEEN 2 AND 20 AND category <> 13)"
_FIRST = (
    _OBS
    + """,
fst AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY x0, obs_index) - 1 AS place, count(*) OVER (PARTITION BY block_id) AS n_first FROM obs WHERE snapshot_index = 0),
enough AS (SELECT * FROM fst WHERE n_first >= 4)"""
)
_HARD = (
    _FIRST
    + """,
hard AS (SELECT *, least(floor(true_track / 90), 3)::INTEGER AS label FROM obs WHERE block_id IN (SELECT block_id FROM enough)),
grid AS (SELECT block_id, k::INTEGER AS k FROM (SELECT DISTINCT block_id FROM hard), range(4) t(k)),
hs AS (SELECT g.block_id, g.k, count(label)::DOUBLE AS n, coalesce(sum(x0), 0) AS s0, coalesce(sum(x1), 0) AS s1, coalesce(sum(x0 * x0), 0) AS q0, coalesce(sum(x1 * x1), 0) AS q1,
         coalesce(sum(cos(theta)), 0) AS dc, coalesce(sum(sin(theta)), 0) AS ds FROM grid g LEFT JOIN hard h ON g.block_id = h.block_id AND g.k = h.label GROUP BY ALL)"""
)


def _params(stats: str, base: str, name: str) -> str:
    """Posterior parameters of a table of statistics, over all observations of ``base``."""
    return f"""
{name}b AS (SELECT block_id, avg(x0) AS m0, avg(x1) AS m1, greatest(var_samp(x0), 2.220446049250313e-16) AS v0, greatest(var_samp(x1), 2.220446049250313e-16) AS v1 FROM {base} GROUP BY block_id),
{name} AS (SELECT block_id, k, n, n + 0.05 AS kappa, (0.05 * m0 + s0) / (n + 0.05) AS mean0, (0.05 * m1 + s1) / (n + 0.05) AS mean1, 2.5 + n / 2 AS a,
   greatest(1.5 * v0 + 0.5 * (q0 + 0.05 * m0 * m0 - (0.05 * m0 + s0) * (0.05 * m0 + s0) / (n + 0.05)), 2.2250738585072014e-308) AS b0,
   greatest(1.5 * v1 + 0.5 * (q1 + 0.05 * m1 * m1 - (0.05 * m1 + s1) * (0.05 * m1 + s1) / (n + 0.05)), 2.2250738585072014e-308) AS b1,
   6 * dc AS e0, 6 * ds AS e1, 1 + n AS sa, 1.5 + coalesce(sum(n) OVER (PARTITION BY block_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS sb
   FROM {stats} JOIN {name}b USING (block_id))"""


def _psi(x: str) -> str:
    """Digamma by eight steps of the recurrence and the asymptotic series."""
    y = f"({x} + 8)"
    steps = " + ".join(f"1 / ({x} + {i})" for i in range(8))
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y}^2) + 1 / (120 * {y}^4) - 1 / (252 * {y}^6) + 1 / (240 * {y}^8) - 5 / (660 * {y}^10) + 691 / (32760 * {y}^12) - ({steps}))"


def _weights(source: str, name: str) -> str:
    return f"""
{name} AS (SELECT *, exp(coalesce(sum(ln(sb / (sa + sb))) OVER w, 0)) * CASE WHEN k = 3 THEN 1 ELSE sa / (sa + sb) END AS weight,
   coalesce(sum({_psi("sb")} - {_psi("(sa + sb)")}) OVER w, 0) + CASE WHEN k = 3 THEN 0 ELSE {_psi("sa")} - {_psi("(sa + sb)")} END AS log_weight
   FROM {source} WINDOW w AS (PARTITION BY block_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


#: Midpoint nodes of the half circle: averages over them give I0 and I1 by the trapezoid rule.
_NODES = "(SELECT cos((i + 0.5) * pi() / 512) AS c FROM range(512) t(i))"


def _log_i0(x: str) -> str:
    return f"({x} + ln((SELECT avg(exp({x} * (c - 1))) FROM nodes)))"


def _series(x: str, order: int) -> str:
    """log of the asymptotic factor of I_order; used for ratios far out."""
    terms, t = ["1"], "1"
    for k in range(1, 9):
        t = f"({t} * {-(4 * order * order - (2 * k - 1) ** 2) / (k * 8.0)!r} / {x})"
        terms.append(t)
    return "(" + " + ".join(terms) + ")"


def _respond(params: str, rows: str, name: str) -> str:
    """Responsibilities of ``rows`` under ``params``, a row per observation and component."""
    lean = "6 * CASE WHEN r < 1e-3 THEN r / 2 WHEN r < 300 THEN (SELECT avg(c * exp(r * (c - 1))) / avg(exp(r * (c - 1))) FROM nodes) ELSE " + _series("r", 1) + " / " + _series("r", 0) + " END"
    return f"""
{name}p AS (SELECT *, {lean} AS lean, atan2(e1, e0) AS mu FROM (SELECT *, sqrt(e0 * e0 + e1 * e1) AS r FROM {params})),
{name}z AS (SELECT o.block_id, o.ordinal, o.x0, o.x1, o.theta, p.k, 0.5 * ({_psi("a")} - ln(b0) - 1 / kappa - a / b0 * (x0 - mean0)^2 + {_psi("a")} - ln(b1) - 1 / kappa - a / b1 * (x1 - mean1)^2)
    + lean * cos(theta - mu) + log_weight AS z FROM {rows} o JOIN {name}p p USING (block_id)),
{name}m AS (SELECT *, max(z) OVER (PARTITION BY ordinal) AS top FROM {name}z),
{name} AS (SELECT * EXCLUDE (z, top), exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY ordinal) AS r FROM {name}m)"""


_SEEDED = (
    _FIRST
    + """,
spot AS (SELECT b.block_id, k::INTEGER AS k, round_even(k * (n_first - 1) / 3.0, 0)::BIGINT AS place FROM (SELECT DISTINCT block_id, n_first FROM enough) b, range(4) t(k)),
sd AS (SELECT block_id, k, x0, x1, theta, obs_index FROM spot JOIN enough USING (block_id, place)),
s0 AS (SELECT block_id, k, 0.25 AS n, 0.25 * x0 AS s0, 0.25 * x1 AS s1, 0.25 * x0 * x0 AS q0, 0.25 * x1 * x1 AS q1, 0.25 * cos(theta) AS dc, 0.25 * sin(theta) AS ds FROM sd),
own AS (SELECT * FROM obs WHERE block_id IN (SELECT block_id FROM enough)),
nodes AS """
    + _NODES
)
_T = " + ".join(
    f"lgamma(a + 0.5) - lgamma(a) - 0.5 * ln(2 * a * pi()) - 0.5 * ln(b{d} * (kappa + 1) / (a * kappa)) - (a + 0.5) * ln(1 + (x{d} - mean{d})^2 * a * kappa / (b{d} * (kappa + 1)) / (2 * a))" for d in "01"
)
_FAR = "sqrt((e0 + 6 * cos(theta))^2 + (e1 + 6 * sin(theta))^2)"


def _big_i0(x: str) -> str:
    """log I0 that holds far out too."""
    return f"(CASE WHEN {x} < 300 THEN {_log_i0(f'least({x}, 300)')} ELSE {x} - 0.5 * ln(2 * pi() * {x}) + ln({_series(x, 0)}) END)"


def _fitted(snapshots: int = 6, head: str = _SEEDED, scores: bool = True) -> str:
    """The model through its snapshots, each scored before it is learned: ``log_density`` in ``score1`` and on, statistics in ``s6``."""
    sums = "sum(r) AS n, sum(r * x0) AS s0, sum(r * x1) AS s1, sum(r * x0 * x0) AS q0, sum(r * x1 * x1) AS q1, sum(r * cos(theta)) AS dc, sum(r * sin(theta)) AS ds"
    sql = head
    for t in range(snapshots):
        sql += "," + _params(f"s{t}", "enough", f"p{t}") + "," + _weights(f"p{t}", f"w{t}") + f",\nnow{t} AS (SELECT * FROM own WHERE snapshot_index = {t})"
        if t and scores:
            sql += f""",
ld{t} AS (SELECT o.block_id, o.ordinal, ln(greatest(weight, 2.2250738585072014e-308)) + {_T} + {_big_i0(_FAR)} - {_big_i0("sqrt(e0 * e0 + e1 * e1)")} - ln(2 * pi()) - {_log_i0("6.0::DOUBLE")} AS z
  FROM now{t} o JOIN w{t} USING (block_id)),
score{t} AS (SELECT block_id, ordinal, any_value(m) + ln(sum(exp(z - m))) AS log_density FROM (SELECT *, max(z) OVER (PARTITION BY ordinal) AS m FROM ld{t}) GROUP BY ALL)"""
        sql += "," + _respond(f"w{t}", f"now{t}", f"r{t}") + f",\nl{t} AS (SELECT block_id, k, {sums} FROM r{t} GROUP BY ALL)"
        before = f"SELECT * FROM s{t} UNION ALL BY NAME " if t else ""
        columns = ", ".join(f"sum({c}) AS {c}" for c in ("n", "s0", "s1", "q0", "q1", "dc", "ds"))
        sql += f",\ns{t + 1} AS (SELECT block_id, k, {columns} FROM ({before}SELECT * FROM l{t}) GROUP BY ALL)"
    return sql


def _finished() -> str:
    """All observations under the final statistics, and all scores."""
    scores = " UNION ALL ".join(f"FROM score{t}" for t in range(1, 6))
    return _fitted() + "," + _params("s6", "enough", "p6") + "," + _weights("p6", "w6") + "," + _respond("w6", "own", "r6") + f",\nscores AS ({scores})"


def _of_size(sql: str, k: int) -> str:
    """A chain of four components per block made one of ``k``, with the base that table ``pool`` has instead of each block's own."""
    sql = sql.replace("CASE WHEN k = 3 THEN", f"CASE WHEN k = {k - 1} THEN").replace("(n_first - 1) / 3.0", f"(n_first - 1) / {k - 1}.0").replace("range(4) t(k)", f"range({k}) t(k)")
    return re.sub(r"SELECT block_id, avg\(x0\) AS m0.*? FROM enough GROUP BY block_id\)", "SELECT b.block_id, pool.* FROM (SELECT DISTINCT block_id FROM enough) b, pool)", sql)


_POOL = (
    "pool AS (SELECT avg(x0) AS m0, avg(x1) AS m1, greatest(var_samp(x0), 2.220446049250313e-16) AS v0, greatest(var_samp(x1), 2.220446049250313e-16) AS v1 FROM {source})"
)
_AFTER_FIRST = _SEEDED.removeprefix(_FIRST)


def _final_labels(k: int = 8) -> str:
    """The label of each observation under the final posterior of blocks that can start at every rate."""
    head = _KEPT + f""",
okb AS (SELECT block_id FROM kept WHERE dropout_rate = 0.3::DOUBLE GROUP BY block_id HAVING count(*) FILTER (snapshot_index = 0) >= {k} AND count(DISTINCT snapshot_index) = 6),
mine AS (SELECT * FROM obs WHERE block_id IN (SELECT block_id FROM okb)),
{_POOL.format(source="mine")},
enough AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY x0, obs_index) - 1 AS place, count(*) OVER (PARTITION BY block_id) AS n_first FROM mine WHERE snapshot_index = 0)"""
    sql = _fitted(6, head + _AFTER_FIRST, False) + "," + _params("s6", "enough", "p6") + "," + _weights("p6", "w6") + "," + _respond("w6", "own", "r6")
    return _kept_once(_of_size(sql, k)) + """
SELECT o.block_id, 'streaming_vi' AS method, 0.0::DOUBLE AS dropout_rate, o.snapshot_index, o.obs_index, l.label FROM own o
JOIN (SELECT ordinal, k AS label FROM r6 QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY r DESC, k) = 1) l USING (ordinal)"""


def _calibration(grid: tuple[int, ...] = (8, 12, 16, 24, 32)) -> str:
    """For each K the rule's numbers: a cell is a block at a rate, its key both."""
    parts = []
    for k in grid:
        head = _KEPT + f""",
{_POOL.format(source="obs")},
thin AS (SELECT o.block_id, coalesce(f, 0) AS f, coalesce(s, 0) AS s, due FROM (SELECT DISTINCT block_id FROM obs) o CROSS JOIN (SELECT max(snapshot_index) + 1 AS due FROM obs) m
  LEFT JOIN (SELECT block_id, count(*) FILTER (snapshot_index = 0) AS f, count(DISTINCT snapshot_index) AS s FROM kept WHERE dropout_rate = 0.3::DOUBLE GROUP BY block_id) t ON t.block_id = o.block_id),
use AS (SELECT coalesce(bool_and(f >= {k} AND s >= due), false) AS usable FROM thin),
cells AS (SELECT block_id || '|' || dropout_rate::VARCHAR AS block_id, ordinal * 3 + CASE WHEN dropout_rate = 0 THEN 0 WHEN dropout_rate < 0.2 THEN 1 ELSE 2 END AS ordinal, snapshot_index, obs_index, x0, x1, theta
  FROM kept, use WHERE usable),
enough AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY x0, obs_index) - 1 AS place, count(*) OVER (PARTITION BY block_id) AS n_first FROM cells WHERE snapshot_index = 0)"""
        sql = _fitted(6, head + _AFTER_FIRST.replace("FROM obs", "FROM cells"), False) + "," + _params("s6", "enough", "p6") + "," + _weights("p6", "w6")
        parts.append("(" + _kept_once(_of_size(sql, k)) + f""",
each AS (SELECT split_part(block_id, '|', 1) AS block, max(CASE WHEN k = {k - 1} THEN weight END) AS tail, CASE WHEN count(*) FILTER (weight >= 0.01) >= {k} THEN 1.0::DOUBLE ELSE 0 END AS saturated FROM w6 GROUP BY block_id),
worst AS (SELECT block, max(tail) AS tail, max(saturated) AS saturated FROM each GROUP BY block),
rule AS (SELECT quantile_cont(tail, 0.95) AS q, avg(saturated) AS s FROM worst)
SELECT {k} AS k, usable, round(q, 6) + 0 AS tail_weight_q95, round(s, 6) + 0 AS saturation_rate, coalesce(usable AND q <= 0.01 AND s <= 0.05, false) AS passed FROM use, rule)""")
    return " UNION ALL ".join(parts)


def _kept_once(sql: str) -> str:
    """Every table of the chain is computed once."""
    return re.sub(r"(?m)^(\w+) AS \(", r"\1 AS MATERIALIZED (", sql)


_CELLS = """
WITH c AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::VARCHAR AS block_id, CASE WHEN event_type IN ('view', 'purchase') THEN 'streaming_vi' ELSE 'collapsed_dp_smc' END AS method,
   [0.0, 0.15, 0.3][hour(ts) % 3 + 1]::DOUBLE AS dropout_rate, avg(value) AS endpoint, count(*) AS n FROM events GROUP BY ALL),
all_cells AS (SELECT b.block_id, m.method, r.dropout_rate FROM (SELECT DISTINCT block_id FROM c) b, (SELECT unnest(['streaming_vi', 'collapsed_dp_smc']) AS method) m, (SELECT unnest([0.0, 0.15, 0.3])::DOUBLE AS dropout_rate) r)"""
_CUBE = (
    _CELLS
    + """,
cube AS (SELECT block_id, """
    + ", ".join(f"max(endpoint) FILTER (method = '{m}' AND dropout_rate = {r}) AS {x}{i}" for x, m in (("a", "streaming_vi"), ("b", "collapsed_dp_smc")) for i, r in enumerate((0.0, 0.15, 0.3)))
    + """ FROM c GROUP BY block_id),
long AS (SELECT block_id, unnest(['paired_0', 'paired_1', 'paired_2', 'architecture_average', 'dropout_linear', 'dropout_quadratic', 'architecture_x_linear', 'architecture_x_quadratic']) AS contrast,
   unnest([b0 - a0, b1 - a1, b2 - a2, (b0 - a0 + b1 - a1 + b2 - a2) / 3, (a2 + b2 - a0 - b0) / 2, (a0 + b0 - 2 * (a1 + b1) + a2 + b2) / 2, (b2 - a2) - (b0 - a0), (b0 - a0) - 2 * (b1 - a1) + (b2 - a2)]) AS value FROM cube),
mom AS (SELECT contrast, count(value) AS n, avg(value) AS estimate, stddev_samp(value) / sqrt(count(value)) AS se FROM long GROUP BY contrast)"""
)
_DRAWS = """
WITH e AS (SELECT event_id % 4 AS chain, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS draw, value FROM events),
d AS (SELECT * FROM e WHERE draw <= (SELECT min(n) FROM (SELECT count(*) AS n FROM e GROUP BY chain)))"""
_PARTICLES = "WITH pt AS (SELECT event_id // 64 AS cell, event_id % 64 AS particle, value / sum(value) OVER (PARTITION BY event_id // 64) AS weight FROM events)"
_RHAT = """
m AS (SELECT avg(value) AS mean, var_samp(value) AS var, count(*) AS n FROM {split} GROUP BY {by}),
t AS (SELECT avg(var) AS w, any_value(n) * var_samp(mean) AS b, any_value(n) AS n FROM m)
SELECT round(w, 6) + 0 AS "within", round(b, 6) + 0 AS "between", round(sqrt(((n - 1) / n * w + b / n) / w), 6) + 0 AS rhat FROM t"""


#: Fixed values of algorithm AS 241 for the normal quantile: numerator and denominator near the middle, and further out (to about 1e-11).
_MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080),
    (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867, 5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0),
)
_OUTER = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 0.241780725177450611770, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 0.148103976427480074590, 0.689767334985100004550, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)


def _polynomial(c: tuple[float, ...], x: str) -> str:
    out = f"{c[0]!r}::DOUBLE"
    for v in c[1:]:
        out = f"({out} * {x} + {v!r}::DOUBLE)"
    return out


def _normal_quantile(p: str) -> str:
    near, far = f"(0.180625 - ({p} - 0.5)^2)", f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)"
    return (
        f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {_polynomial(_MIDDLE[0], near)} / {_polynomial(_MIDDLE[1], near)}"
        f" ELSE sign({p} - 0.5) * {_polynomial(_OUTER[0], far)} / {_polynomial(_OUTER[1], far)} END"
    )


def _scores(values: str, name: str) -> str:
    """Normal scores of the average ranks of half chains."""
    return f"""
{name}r AS (SELECT chain, side, place, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r, count(*) OVER () AS n FROM ({values})),
{name} AS MATERIALIZED (SELECT chain, side, place, {_normal_quantile("p")} AS value FROM (SELECT *, (r - 0.375) / (n + 0.25) AS p FROM {name}r))"""


def _spread(scores: str, name: str) -> str:
    return f"""
{name}m AS (SELECT avg(value) AS mean, var_samp(value) AS var, count(*) AS n FROM {scores} GROUP BY chain, side),
{name} AS (SELECT w, b, n, (n - 1) / n * w + b / n AS pooled FROM (SELECT avg(var) AS w, any_value(n) * var_samp(mean) AS b, any_value(n)::DOUBLE AS n FROM {name}m))"""


_HALVES = _DRAWS + """,
l AS (SELECT *, count(*) OVER (PARTITION BY chain) AS n FROM d),
h AS (SELECT chain, CASE WHEN draw <= n // 2 THEN 0 ELSE 1 END AS side, CASE WHEN draw <= n // 2 THEN draw ELSE draw - (n - n // 2) END - 1 AS place, value AS v FROM l WHERE draw <= n // 2 OR draw > n - n // 2)"""
_RANK_RHAT = _HALVES + ",\nmid AS (SELECT median(v) AS m FROM h)," + ",".join([
    _scores("SELECT * FROM h", "zb"), _spread("zb", "sb"), _scores("SELECT chain, side, place, abs(v - m) AS v FROM h, mid", "zf"), _spread("zf", "sf"),
]) + """,
pair AS (SELECT sqrt(sb.pooled / sb.w) AS bulk, sqrt(sf.pooled / sf.w) AS folded FROM sb, sf)
SELECT round(bulk, 6) + 0 AS bulk, round(folded, 6) + 0 AS folded, round(greatest(bulk, folded), 6) + 0 AS max FROM pair"""  # fmt: skip
#: Lags up to 63 are enough where Geyer's sequence ends before; a table for which it doesn't has no row.
_BULK_ESS = _HALVES + "," + _scores("SELECT * FROM h", "z") + "," + _spread("z", "s") + """,
c AS MATERIALIZED (SELECT chain, side, place, value - avg(value) OVER (PARTITION BY chain, side) AS c, count(*) OVER () AS total FROM z),
lags AS (SELECT lag, CASE WHEN lag = 0 THEN 1 ELSE (pooled - w + any_value(t)) / pooled END AS rho FROM (
  SELECT lag, sum(a.c * b.c) / any_value(a.total) AS t FROM c a CROSS JOIN range(64) g(lag) JOIN c b ON b.chain = a.chain AND b.side = a.side AND b.place = a.place + lag GROUP BY lag), s GROUP BY lag, pooled, w),
pairs AS (SELECT lag // 2 AS k, sum(rho) AS p FROM lags GROUP BY k HAVING count(*) = 2),
ended AS (SELECT min(k) AS k FROM pairs WHERE p < 0),
steps AS (SELECT min(p) OVER (ORDER BY pairs.k) AS p FROM pairs, ended WHERE pairs.k < ended.k)
SELECT round((SELECT any_value(total) FROM c) / greatest(1, 2 * sum(p) - 1), 3) + 0 AS ess FROM steps"""


def _rounded(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0 AS {c}" for c in columns.split())


_SNAPSHOTS = _HARD + """,
by_t AS (SELECT block_id, snapshot_index, label AS k, count(*)::DOUBLE AS n, sum(x0) AS s0, sum(x1) AS s1, sum(cos(theta)) AS dc, sum(sin(theta)) AS ds FROM hard GROUP BY ALL),
fg AS (SELECT g.block_id, g.k, """ + ", ".join(f"coalesce(sum(0.9^(5 - snapshot_index) * {c}), 0) AS {c}" for c in ("n", "s0", "s1", "dc", "ds")) + " FROM grid g LEFT JOIN by_t USING (block_id, k) GROUP BY ALL)"
_TAILS = _HARD + _KEPT.removeprefix(_OBS).replace("FROM obs)", "FROM hard)") + """,
tl AS (SELECT block_id, max(last / n) AS tail, max(CASE WHEN last * 4 >= n THEN 1.0::DOUBLE ELSE 0 END) AS saturated
       FROM (SELECT block_id, dropout_rate, count(*) FILTER (label = 3) AS last, count(*) AS n FROM kept GROUP BY ALL) GROUP BY block_id)"""
_COUNTS = _OBS + ",\ncn AS (SELECT block_id, snapshot_index, count(*) FILTER (accepted) AS eligible_observations, count(*) FILTER (NOT accepted) AS rejected_incomplete_states FROM mark GROUP BY ALL)"

ORACLES: dict[str, str] = {
    "sanitize_counts": "WITH" + _STATES + "," + _BAD + "," + _accepted("bad") + " SELECT block_id, snapshot_index, count(*) FILTER (accepted) AS eligible_observations, count(*) FILTER (NOT accepted) AS rejected_incomplete_states FROM mark GROUP BY ALL",
    "dedup_first": "WITH" + _STATES + "," + _BAD + "," + _accepted("bad") + " SELECT block_id, snapshot_index, obs_index, ordinal, identity, category FROM obs",
    "features": _OBS + f" SELECT ordinal, {_rounded('x0 x1 theta')}, coalesce(category, -1) AS category FROM obs",
    "pseudonym_hmac": "WITH" + _STATES + f" SELECT ordinal, substr(sha256(unhex('{SALT_OUTER}' || sha256(unhex('{SALT_INNER}') || encode(identity)))), 1, 24) AS track_key FROM st",
    "stable_seeds": "WITH" + _STATES + f" SELECT DISTINCT block_id, snapshot_index, {_SEED} AS seed FROM st",
    "nested_mask_counts": _KEPT + f" SELECT block_id, dropout_rate, count(*) AS retained_observations, count(*) FILTER (snapshot_index > 0) AS scored_observations, count(*) FILTER ({_USABLE}) AS category_observations FROM kept GROUP BY ALL",
    "mask_is_nested": _KEPT + ", g AS (SELECT ordinal, list(dropout_rate) AS s FROM kept GROUP BY ordinal) SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (list_contains(s, {b}) AND NOT list_contains(s, {a})) AS broken_{i}" for i, (a, b) in enumerate(((0.0, 0.15), (0.0, 0.3), (0.15, 0.3)))) + " FROM g",
    "moments": _OBS + " SELECT block_id, round(avg(x0), 6) + 0 AS m0, round(avg(x1), 6) + 0 AS m1, round(greatest(var_samp(x0), 2.220446049250313e-16), 6) + 0 AS v0, round(greatest(var_samp(x1), 2.220446049250313e-16), 6) + 0 AS v1 FROM obs GROUP BY block_id",
    "eligible_blocks": _COUNTS + " SELECT block_id, min(eligible_observations) AS least, count(*) AS snapshots, min(eligible_observations) >= 32 AND count(*) = 6 AS accepted FROM cn GROUP BY block_id",
    "chronology_violations": "WITH" + _STATES + """, s AS (SELECT block_id, snapshot_index, min(ts) AS f, max(ts) AS l FROM st GROUP BY ALL),
x AS (SELECT *, coalesce(f <= lag(l) OVER (PARTITION BY block_id ORDER BY snapshot_index), false) AS bad FROM s),
b AS (SELECT block_id, count(*) FILTER (bad) AS snapshots_out_of_order, min(f) AS f, max(l) AS l FROM x GROUP BY block_id)
SELECT block_id, snapshots_out_of_order, coalesce(f <= lag(l) OVER (ORDER BY block_id), false) AS overlaps FROM b""",
    "init_seeds": _SEEDED + f" SELECT block_id, k, {_rounded('x0 x1 theta')}, obs_index FROM sd",
    "suff_stats_hard": _HARD + f" SELECT block_id, k, {_rounded('n s0 s1 q0 q1 dc ds')} FROM hs",
    "posterior_params": _HARD + "," + _params("hs", "hard", "pp") + f" SELECT block_id, k, {_rounded('kappa mean0 mean1 a b0 b1 e0 e1')} FROM pp",
    "stick_params": _HARD + "," + _params("hs", "hard", "pp") + f" SELECT block_id, k, {_rounded('sa sb')} FROM pp",
    "expected_weights": _HARD + "," + _params("hs", "hard", "pp") + "," + _weights("pp", "ww") + f" SELECT block_id, k, {_rounded('weight log_weight')} FROM ww",
    "forgetting_merge": _SNAPSHOTS + f" SELECT block_id, k, {_rounded('n s0 s1 dc ds')} FROM fg",
    "forgetting_closed_form": _SNAPSHOTS + f" SELECT block_id, k, {_rounded('n s0 s1 dc ds')} FROM fg",
    "vi_responsibilities": _kept_once(_finished()) + " SELECT ordinal, " + ", ".join(f"round(sum(r) FILTER (k = {k}), 4) + 0 AS r{k}" for k in range(4)) + " FROM r6 GROUP BY ordinal",
    "argmax_labels": _kept_once(_finished()) + " SELECT ordinal, k AS label, round(r, 4) + 0 AS responsibility FROM r6 QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY r DESC, k) = 1",
    "vi_one_step": _kept_once(_fitted(1)) + f" SELECT block_id, k, {_rounded('n s0 s1 q0 q1 dc ds', 4)} FROM s1",
    "vi_log_predictive": _kept_once(_finished()) + " SELECT ordinal, round(log_density, 3) + 0 AS log_density FROM scores",
    "vi_prequential": _kept_once(_finished()) + """,
sc AS (SELECT block_id, round(avg(log_density), 5) + 0 AS mean_prequential_log_score, count(*) AS scored_observations FROM scores GROUP BY block_id)
SELECT sc.*, round(weight, 5) + 0 AS tail_weight FROM sc JOIN w6 USING (block_id) WHERE k = 3""",
    "occupied_clusters": _HARD + " SELECT block_id, count(DISTINCT label) AS occupied_clusters FROM hard GROUP BY block_id",
    "category_coverage": _KEPT + f" SELECT method, dropout_rate, count(*) AS retained_observations, count(*) FILTER ({_USABLE}) AS category_observations FROM kept, (SELECT unnest(['streaming_vi', 'collapsed_dp_smc']) AS method) GROUP BY ALL",
    "nmi": _HARD + f""", us AS (SELECT block_id, label, category FROM hard WHERE {_USABLE}), tot AS (SELECT block_id, count(*) AS t FROM us GROUP BY block_id),
hl AS (SELECT block_id, -sum(n / t * ln(n / t)) AS h, count(*) AS c FROM (SELECT block_id, label, count(*)::DOUBLE AS n FROM us GROUP BY ALL) JOIN tot USING (block_id) GROUP BY block_id),
hc AS (SELECT block_id, -sum(n / t * ln(n / t)) AS h, count(*) AS c FROM (SELECT block_id, category, count(*)::DOUBLE AS n FROM us GROUP BY ALL) JOIN tot USING (block_id) GROUP BY block_id),
hj AS (SELECT block_id, -sum(n / t * ln(n / t)) AS h FROM (SELECT block_id, label, category, count(*)::DOUBLE AS n FROM us GROUP BY ALL) JOIN tot USING (block_id) GROUP BY block_id)
SELECT b.block_id, round(CASE WHEN t < 2 THEN NULL WHEN hl.c = 1 AND hc.c = 1 THEN 1 WHEN hl.h + hc.h <= 0 THEN 0 ELSE least(greatest((hl.h + hc.h - hj.h) / ((hl.h + hc.h) / 2), 0), 1) END, 6) + 0 AS nmi
FROM (SELECT DISTINCT block_id FROM hard) b LEFT JOIN tot USING (block_id) LEFT JOIN hl USING (block_id) LEFT JOIN hc USING (block_id) LEFT JOIN hj USING (block_id)""",
    "tail_q95": _TAILS + " SELECT round(quantile_cont(tail, 0.95), 6) + 0 AS tail_weight_q95 FROM tl",
    "saturation_rate": _TAILS + " SELECT round(avg(saturated), 6) + 0 AS saturation_rate FROM tl",
    "contrast_cube": _CUBE + f" SELECT block_id, {_rounded('a0 a1 a2 b0 b1 b2')} FROM cube",
    "paired_contrasts": _CUBE + " SELECT contrast, n, round(estimate, 6) + 0 AS estimate, round(se, 6) + 0 AS se, round(estimate / nullif(se, 0), 6) + 0 AS t FROM mom",
    "holm": _CUBE + """, ps AS (SELECT contrast, round(exp(-abs(estimate / nullif(se, 0))), 9) AS p FROM mom),
st AS (SELECT contrast, p, least(1, (count(p) OVER () - row_number() OVER (ORDER BY p) + 1) * p) AS step FROM ps WHERE p IS NOT NULL)
SELECT contrast, round(p, 6) + 0 AS p, round(max(step) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) + 0 AS p_holm FROM st UNION ALL SELECT contrast, NULL, NULL FROM ps WHERE p IS NULL""",
    "avg_ranks": "WITH e AS (SELECT event_id, event_type, round(value, 1) AS v FROM events) SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY v) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2 AS rank FROM e",
    "split_rhat_raw": _DRAWS + ", h AS (SELECT *, count(*) OVER (PARTITION BY chain) AS n FROM d), s AS (SELECT chain, draw > n // 2 AS side, value FROM h WHERE draw <= n // 2 OR draw > n - n // 2)," + _RHAT.format(split="s", by="chain, side"),
    "rhat_demo": _DRAWS + "," + _RHAT.format(split="d", by="chain"),
    "ess_demo": _DRAWS + """, x AS (SELECT chain, draw, value - avg(value) OVER (PARTITION BY chain) AS c FROM d),
y AS (SELECT chain, sum(c * later) / sum(c * c) AS rho, count(*) AS n FROM (SELECT *, lead(c) OVER (PARTITION BY chain ORDER BY draw) AS later FROM x) GROUP BY chain),
z AS (SELECT avg(rho) AS rho, sum(n)::DOUBLE AS n FROM y)
SELECT round(rho, 4) + 0 AS rho, round(least(n, n * (1 - rho) / (1 + rho)), 4) + 0 AS ess FROM z""",
    "particle_ess": _PARTICLES + " SELECT cell, round(1 / sum(weight * weight), 6) + 0 AS ess FROM pt GROUP BY cell",
    "resample_ancestors": _PARTICLES + """,
cu AS (SELECT cell, particle, sum(weight) OVER w AS high, count(*) OVER (PARTITION BY cell) AS n, lead(particle) OVER w IS NULL AS last FROM pt WINDOW w AS (PARTITION BY cell ORDER BY particle)),
pl AS (SELECT DISTINCT cell, n, unnest(range(n)) AS i FROM cu)
SELECT pl.cell, i::INTEGER AS place, min(CASE WHEN high >= (0.37 + i) / pl.n OR last THEN particle END) AS ancestor FROM pl JOIN cu USING (cell) GROUP BY ALL""",
    "log_mean_weight": _PARTICLES + " SELECT cell, round(ln(sum(weight^3)), 6) + 0 AS logsumexp FROM pt GROUP BY cell",
    "design_cross": "WITH" + _STATES + " SELECT b.block_id, method, dropout_rate FROM (SELECT DISTINCT block_id FROM st) b, (SELECT unnest(['streaming_vi', 'collapsed_dp_smc']) AS method), (SELECT unnest([0.0, 0.15, 0.3])::DOUBLE AS dropout_rate)",
    "pending_cells": _CELLS + """, o AS (SELECT a.* FROM all_cells a ANTI JOIN (SELECT * FROM c WHERE n % 4 <> 0) d USING (block_id, method, dropout_rate))
SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY sha256('2026|' || block_id || '|' || method || '|' || dropout_rate::VARCHAR))::INTEGER AS position FROM o""",
    "leakage": "WITH" + _STATES + " SELECT DISTINCT block_id FROM st WHERE substr(block_id, 8)::INTEGER % 6 = 0",
    "key_equality": _CELLS + """ SELECT block_id, method, dropout_rate, 'missing' AS side FROM (FROM all_cells EXCEPT SELECT block_id, method, dropout_rate FROM c WHERE n % 4 <> 0)
UNION ALL SELECT block_id, method, dropout_rate, 'unexpected' FROM (SELECT block_id, method, dropout_rate FROM c WHERE n % 4 <> 0 EXCEPT FROM all_cells)""",
    "unique_ids": _OBS + " SELECT block_id, snapshot_index, count(*) AS n, count(DISTINCT identity) AS identities, count(*) = count(DISTINCT identity) AS \"unique\" FROM obs GROUP BY ALL",
    "result_violations": _KEPT + f""", ex AS (SELECT block_id, dropout_rate, count(*) AS retained, count(*) FILTER (snapshot_index > 0) AS scored FROM kept GROUP BY ALL),
ce AS (SELECT *, substr(block_id, 8, 4)::INTEGER AS day, retained + substr(block_id, 8, 4)::INTEGER % 2 AS claimed FROM ex, (SELECT unnest(['streaming_vi', 'collapsed_dp_smc']) AS method)),
ru AS (SELECT block_id, method, dropout_rate, concat_ws(',', CASE WHEN day % 7 = 0 THEN 'failed' END, CASE WHEN day % 2 = 1 OR scored < 1 THEN 'counts' END, CASE WHEN day % 5 = 0 THEN 'occupied' WHEN claimed < 3 THEN 'occupied' END,
  CASE WHEN day % 3 = 0 OR abs(retained * 0.5 / claimed - 0.5) > 1e-10 * 0.5 THEN 'latency' END) AS rules FROM ce) SELECT * FROM ru WHERE rules <> ''""",
    "mean_score": _KEPT + " SELECT block_id, dropout_rate, round(avg(-abs(x0 - 4) - abs(x1)), 6) + 0 AS mean_prequential_log_score FROM kept WHERE snapshot_index > 0 GROUP BY ALL",
    "chain_autocovariance": _DRAWS + """, x AS (SELECT chain, draw, value - avg(value) OVER (PARTITION BY chain) AS c, count(*) OVER (PARTITION BY chain) AS n FROM d)
SELECT a.chain, lag::INTEGER AS lag, round(sum(a.c * b.c) / any_value(a.n), 4) + 0 AS autocovariance FROM x a, range(6) l(lag), x b WHERE b.chain = a.chain AND b.draw = a.draw + lag GROUP BY ALL""",
    "snapshot_union": _OBS + " SELECT block_id, ordinal, (row_number() OVER (PARTITION BY block_id ORDER BY snapshot_index, obs_index) - 1)::INTEGER AS place FROM obs",
    "arc_distance": "WITH" + _STATES + ", w AS (SELECT ordinal, true_track - 350 - 360 * floor((true_track - 350) / 360) AS a FROM st) SELECT ordinal, round(least(a, 360 - a), 6) + 0 AS arc FROM w",
    "gem_residual": _COUNTS + """, b AS (SELECT block_id, count(*) AS k, ln(1 + sum(eligible_observations)) AS alpha FROM cn GROUP BY block_id)
SELECT block_id, round((alpha / (1 + alpha))^(k - 1), 6) + 0 AS residual, round(1 - (alpha / (1 + alpha))^(k - 1), 6) + 0 AS represented FROM b""",
    "mask_demo": "SELECT event_id % 10 AS digit, " + ", ".join(f"count(*) FILTER (event_id * 73 % 101 / 101.0::DOUBLE >= {r}::DOUBLE) AS kept_{i}" for i, r in enumerate((0.0, 0.15, 0.3))) + " FROM events GROUP BY digit",
    "vi_kernel_labels": _final_labels(),
    "calibration_diagnostics": _calibration(),
    "rank_rhat": _RANK_RHAT,
    "bulk_ess": _BULK_ESS,
    "uniforms": _KEPT.rsplit(",\nkept", 1)[0] + " SELECT ordinal, round(u, 12) + 0 AS u FROM uni",
}
