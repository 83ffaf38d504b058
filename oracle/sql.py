"""SQL equivalents of the named queries, as one self-contained statement each.

Written from the definitions, not from the Spark plans: distinct counts instead of
counted cells, an extended panel instead of reading the last row, joins instead of
windows where that is the plainer statement.
"""

from __future__ import annotations

# Names of the panel and of the model inputs, in contract order.
EXOG = [
    "numeric_dist_pct",
    "wtd_dist_val",
    "num_stores",
    "ms_value",
    "volume_tonnes",
    "sah",
    "str_days",
    "pdo_rs",
]
METRICS = ["value_lakhs", *EXOG]
NUMERIC = [
    "d_l3",
    "rm6",
    "sd6",
    "zt_d1",
    "share_l1",
    *[f"{c}_{s}" for c in EXOG for s in ("l1", "d1")],
    "month",
    "is_festive",
]
LOGGED = NUMERIC[:5]
LAST = "(SELECT last_closed FROM bounds)"
TRAIN_END = "(SELECT CAST(last_closed - INTERVAL 6 MONTH AS DATE) FROM bounds)"

BASE = """
lines AS (
  SELECT p_brand AS brand, r_name AS zone, l_suppkey AS store,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS v,
         CAST(l_quantity AS DECIMAL(12,2)) AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey),
bounds AS (
  SELECT CAST(date_trunc('month', CAST(max(l_shipdate) AS DATE) + 1) - INTERVAL 1 MONTH AS DATE)
    AS last_closed FROM lineitem),
store_sales AS (SELECT zone, date, store, sum(v) AS sv FROM lines GROUP BY zone, date, store),
zone_sales AS (
  SELECT zone, date, sum(v) AS zv, count(DISTINCT store) AS zs FROM lines GROUP BY zone, date),
cells AS (
  SELECT brand, zone, date, sum(v) AS v, sum(q) AS q, count(*) AS n,
         count(DISTINCT store) AS s
  FROM lines GROUP BY brand, zone, date),
handled AS (
  SELECT brand, zone, date, sum(sv) AS h
  FROM (SELECT DISTINCT brand, zone, date, store FROM lines) JOIN store_sales
       USING (zone, date, store)
  GROUP BY brand, zone, date),
all_months AS (
  SELECT brand, zone, date,
         CAST(v AS DOUBLE) / 1e5 AS value_lakhs,
         CAST(s AS DOUBLE) * 1e2 / CAST(zs AS DOUBLE) AS numeric_dist_pct,
         CAST(h AS DOUBLE) * 1e2 / CAST(zv AS DOUBLE) AS wtd_dist_val,
         CAST(s AS DOUBLE) AS num_stores,
         CAST(v AS DOUBLE) * 1e2 / CAST(zv AS DOUBLE) AS ms_value,
         CAST(q AS DOUBLE) AS volume_tonnes,
         CAST(v AS DOUBLE) * 1e2 / CAST(h AS DOUBLE) AS sah,
         CAST(s AS DOUBLE) * 3e1 / CAST(n AS DOUBLE) AS str_days,
         CAST(v AS DOUBLE) / CAST(s AS DOUBLE) AS pdo_rs
  FROM cells JOIN handled USING (brand, zone, date) JOIN zone_sales USING (zone, date))"""
PANEL = BASE + ",\npanel AS (SELECT * FROM all_months)"
CLOSED = BASE + ",\npanel AS (SELECT * FROM all_months WHERE date <= (SELECT last_closed FROM bounds))"

KEY = "brand, zone, date"
W = "PARTITION BY brand, zone ORDER BY date"


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def rr(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in columns)


def _csv(items) -> str:
    return ", ".join(items)


def stmt(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n" + select


def on_panel(select: str, *ctes: str) -> str:
    return stmt([PANEL, *ctes], select)


def on_closed(select: str, *ctes: str) -> str:
    """On the months that the lines cover to their end."""
    return stmt([CLOSED, *ctes], select)


def feats(src: str, out: str) -> str:
    """CTEs that end in ``out``: ``src`` with every feature except the codes."""
    lags = [f"lag(ly, {k}) OVER w AS ly_l{k}" for k in range(1, 8)]
    exog = [f"lag({c}, 1) OVER w AS {c}_l1, lag({c}, 2) OVER w AS {c}_l2" for c in EXOG]
    diffs = [f"{c}_l1 - {c}_l2 AS {c}_d1" for c in EXOG]
    return f"""
{out}_tot AS (
  SELECT zone, date, ln(sum(value_lakhs)) AS lzt FROM {src} GROUP BY zone, date),
{out}_lev AS (
  SELECT p.*, value_lakhs AS y, ln(value_lakhs) AS ly, lzt
  FROM {src} p LEFT JOIN {out}_tot USING (zone, date)),
{out}_lag AS (
  SELECT *, {_csv(lags)}, {_csv(exog)},
         avg(ly) OVER w3 AS mean3, avg(ly) OVER w6 AS mean6, stddev_samp(ly) OVER w6 AS sd6,
         lag(lzt, 1) OVER w AS zt_l1, lag(lzt, 2) OVER w AS zt_l2
  FROM {out}_lev
  WINDOW w AS ({W}), w3 AS ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
         w6 AS ({W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
{out} AS (
  SELECT *, ly_l1 - ly_l2 AS d_l1, ly_l2 - ly_l3 AS d_l2, ly_l3 - ly_l4 AS d_l3,
         mean3 - ly_l1 AS rm3, mean6 - ly_l1 AS rm6, zt_l1 - zt_l2 AS zt_d1,
         ly_l1 - zt_l1 AS share_l1, {_csv(diffs)},
         CAST(month(date) AS INTEGER) AS month,
         CAST(month(date) IN (8, 9, 10, 11) AS INTEGER) AS is_festive,
         CAST(month(date) IN (4, 5, 6) AS INTEGER) AS is_summer,
         ly - ly_l1 AS target_d,
         CASE WHEN date <= {TRAIN_END} THEN 'train' ELSE 'test' END AS split
  FROM {out}_lag)"""


F_ = feats("panel", "f")
CODES = """
brand_codes AS (
  SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT brand AS value FROM panel)),
zone_codes AS (
  SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT zone AS value FROM panel))"""


def coded(src: str) -> str:
    return f"""(SELECT s.*, b.code AS brand_code, z.code AS zone_code FROM {src} s
  LEFT JOIN brand_codes b ON s.brand = b.value LEFT JOIN zone_codes z ON s.zone = z.value)"""


CLEAN = f"""
clean AS (SELECT * FROM f WHERE {" AND ".join(f"{c} IS NOT NULL" for c in NUMERIC)}
  AND target_d IS NOT NULL AND ly_l1 IS NOT NULL AND y IS NOT NULL)"""
FEATURES = (
    rr(LOGGED) + ", " + _csv(c for c in NUMERIC if c not in LOGGED) + ", brand_code, zone_code"
)

COEF = """
coef AS (
  SELECT brand, zone, regr_count(target_d, d_l1) AS n_steps,
         regr_intercept(target_d, d_l1) AS a, regr_slope(target_d, d_l1) AS b
  FROM f WHERE split = 'train' GROUP BY brand, zone)"""
PRED = f"""
hist AS (
  SELECT {KEY}, exp(ly_l1) AS naive, lag(y, 12) OVER w AS seasonal_naive,
         CASE WHEN row_number() OVER w > 2 THEN
           lag(y) OVER w + (lag(y) OVER w - first(y) OVER w) / (row_number() OVER w - 2)
         END AS drift,
         exp(ly_l1 + a + b * d_l1) AS ar1
  FROM f LEFT JOIN coef USING (brand, zone) WINDOW w AS ({W})),
scale AS (
  SELECT brand, zone, avg(abs(y - py)) AS scale
  FROM (SELECT brand, zone, y, lag(y) OVER ({W}) AS py FROM clean WHERE split = 'train')
  GROUP BY brand, zone),
bt AS (
  SELECT clean.*, naive, seasonal_naive, drift, ar1, scale
  FROM clean JOIN hist USING ({KEY}) LEFT JOIN scale USING (brand, zone))"""
BACKTEST = [CLOSED, F_, CLEAN, COEF, PRED]


def long(candidates: list[str], where: str = "split = 'test'") -> str:
    shared = " AND ".join(f"{c} IS NOT NULL" for c in candidates)
    parts = [
        f"SELECT '{c}' AS candidate, {KEY}, y, {c} AS pred, scale FROM bt "
        f"WHERE {where} AND {shared}"
        for c in candidates
    ]
    covered = [
        f"SELECT '{c}' AS candidate, count({c}) / count(*)::DOUBLE AS coverage FROM bt WHERE {where}"
        for c in candidates
    ]
    return (
        "long AS (" + " UNION ALL ".join(parts) + "),\n"
        "covered AS (" + " UNION ALL ".join(covered) + ")"
    )


SCORES = """
zone_grain AS (
  SELECT candidate, 100.0 * sum(abs(y - pred)) / sum(y) AS zone_wmape,
         avg(abs(y - pred) / scale) AS mase, 100.0 * avg(abs(y - pred) / abs(y)) AS mape,
         1.0 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y)) AS r2
  FROM long GROUP BY candidate),
total_grain AS (
  SELECT candidate, 100.0 * sum(abs(y - pred)) / sum(y) AS ai_brand_wmape,
         100.0 * avg(abs(y - pred) / abs(y)) AS total_mape,
         1.0 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y)) AS total_r2
  FROM (SELECT candidate, brand, date, sum(y) AS y, sum(pred) AS pred FROM long
        GROUP BY candidate, brand, date)
  GROUP BY candidate),
segment_grain AS (
  SELECT candidate, 100.0 * sum(abs(y - pred)) / sum(y) AS segment_wmape
  FROM (SELECT candidate, zone, date, sum(y) AS y, sum(pred) AS pred FROM long
        GROUP BY candidate, zone, date)
  GROUP BY candidate),
scores AS (
  SELECT * FROM covered LEFT JOIN zone_grain USING (candidate)
  LEFT JOIN total_grain USING (candidate) LEFT JOIN segment_grain USING (candidate))"""


def metric_rows(metrics: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT candidate, '{m}' AS metric, {r(m)} AS value FROM scores" for m in metrics
    )


BASIC = ["zone_wmape", "ai_brand_wmape", "mase"]


def evaluated(candidates: list[str], metrics: list[str]) -> str:
    return stmt([*BACKTEST, long(candidates), SCORES], metric_rows(metrics))


def backtest(select: str, *ctes: str) -> str:
    return stmt([*BACKTEST, *ctes], select)


AR1 = f"""
as_of AS (SELECT max(date) AS d FROM panel),
last_row AS (
  SELECT brand, zone, max(date) AS date FROM panel GROUP BY brand, zone),
ahead AS (
  SELECT brand, zone, ly, ly - ly_l1 AS step FROM f JOIN last_row USING (brand, zone, date)),
fc AS (
  SELECT brand, zone,
         CAST((SELECT date_trunc('month', d) + INTERVAL 1 MONTH FROM as_of) AS DATE)
           AS target_month,
         exp(ly) AS last_actual, exp(ly + a + b * step) AS prediction
  FROM ahead LEFT JOIN coef USING (brand, zone)),
totals AS (
  SELECT brand, 'All India (U+R)' AS zone, target_month,
         CASE WHEN bool_and(last_actual IS NOT NULL) THEN sum(last_actual) END AS last_actual,
         CASE WHEN bool_and(prediction IS NOT NULL) THEN sum(prediction) END AS prediction
  FROM fc GROUP BY brand, target_month),
fc_all AS (SELECT * FROM fc UNION ALL SELECT * FROM totals)"""
AR1_CTES = [CLOSED, F_, COEF, AR1]
FC_COLUMNS = (
    f"brand, zone, target_month, {r('last_actual', 9)} AS last_actual, "
    f"{r('prediction')} AS prediction, {r('(prediction / last_actual - 1) * 100')} AS pct_change"
)

PAYLOAD = f"""
payload AS (
  SELECT CASE WHEN brand = 'Brand#1' AND zone = 'ASIA' THEN 'Brand#X' ELSE brand END AS brand,
         zone, date,
         CASE WHEN brand = 'Brand#4' AND zone = 'AMERICA' AND date = {LAST} THEN 0.0
              ELSE value_lakhs END AS value_lakhs,
         {_csv(c for c in EXOG if c not in ("sah", "str_days", "pdo_rs"))},
         CASE WHEN brand = 'Brand#5' AND date = {LAST} THEN NULL ELSE sah END AS sah,
         str_days, pdo_rs
  FROM (SELECT * FROM panel
        UNION ALL
        SELECT * FROM panel
        WHERE brand = 'Brand#6' AND zone = 'MIDDLE EAST' AND date = {LAST})
  WHERE NOT (brand = 'Brand#2' AND zone = 'EUROPE')
    AND NOT (brand = 'Brand#3' AND zone = 'AFRICA' AND date < {LAST} - INTERVAL 2 MONTH))"""
NULLS = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST(count(*) AS BIGINT) AS n_null FROM payload "
    f"WHERE {m} IS NULL HAVING count(*) > 0"
    for m in METRICS
)
SHALLOW = """SELECT brand, zone, count(DISTINCT date) AS n_dates FROM payload
  GROUP BY brand, zone HAVING count(DISTINCT date) < 7"""
INCOMPLETE = """SELECT zone, count(DISTINCT brand) AS n_entities,
  (SELECT count(DISTINCT brand) FROM payload) AS n_expected FROM payload GROUP BY zone
  HAVING count(DISTINCT brand) < (SELECT count(DISTINCT brand) FROM payload)"""
NONPOSITIVE = """SELECT count(*) AS n_rows FROM payload WHERE value_lakhs <= 0
  HAVING count(*) > 0"""
UNKNOWN = """SELECT DISTINCT 'brand' AS "column", brand AS value FROM payload
  WHERE brand NOT IN (SELECT brand FROM panel)
  UNION ALL SELECT DISTINCT 'zone', zone FROM payload
  WHERE zone NOT IN (SELECT zone FROM panel)"""
REPORT = f"""
SELECT CAST(CASE "column" WHEN 'brand' THEN 2 ELSE 3 END AS INTEGER) AS rule_no,
       CASE "column" WHEN 'brand' THEN 'unknown_entity' ELSE 'unknown_segment' END AS rule,
       value AS key, CAST(1 AS BIGINT) AS observed, CAST(0 AS BIGINT) AS expected
FROM ({UNKNOWN})
UNION ALL SELECT 4, 'null_metric', metric, n_null, 0 FROM ({NULLS})
UNION ALL SELECT 5, 'nonpositive_target', 'value_lakhs', n_rows, 0 FROM ({NONPOSITIVE})
UNION ALL SELECT 6, 'short_history', brand || '|' || zone, n_dates, 7 FROM ({SHALLOW})
UNION ALL SELECT 7, 'incomplete_segment', zone, n_entities, n_expected FROM ({INCOMPLETE})
UNION ALL SELECT 8, 'duplicate_keys', brand || '|' || zone, count(*), 0
  FROM (SELECT {KEY} FROM payload GROUP BY {KEY} HAVING count(*) > 1) GROUP BY brand, zone"""

STAMPED = f"""
stamped AS (
  SELECT *, CASE WHEN date <= {TRAIN_END} THEN 'train' ELSE 'test' END AS split FROM panel),
train AS (SELECT * FROM stamped WHERE split = 'train')"""


def pct(values: str, p: str) -> str:
    """Linear interpolation between the two neighbours in a sorted list."""
    pos = f"((len({values}) - 1) * CAST({p} AS DOUBLE))"
    low = f"{values}[CAST(floor({pos}) AS BIGINT) + 1]"
    high = f"{values}[CAST(ceil({pos}) AS BIGINT) + 1]"
    return (
        f"CASE WHEN {low} = {high} THEN {low} ELSE (ceil({pos}) - {pos}) * {low} "
        f"+ ({pos} - floor({pos})) * {high} END"
    )


def sorted_lists(src: str, columns: list[str]) -> str:
    lists = [f"list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL)) AS {c}_v" for c in columns]
    return f"""
lists AS (SELECT brand, zone, {_csv(lists)} FROM {src} GROUP BY brand, zone)"""


def fences(columns: list[str], k: str) -> str:
    qs = [f"{pct(f'{c}_v', '0.25')} AS {c}_q1, {pct(f'{c}_v', '0.75')} AS {c}_q3" for c in columns]
    bounds = [
        f"{c}_q1 - ({c}_q3 - {c}_q1) * {k} AS {c}_lo, {c}_q3 + ({c}_q3 - {c}_q1) * {k} AS {c}_hi"
        for c in columns
    ]
    return (
        sorted_lists("train", columns)
        + f""",
quartiles AS (SELECT brand, zone, {_csv(qs)} FROM lists),
fences AS (SELECT brand, zone, {_csv(bounds)} FROM quartiles)"""
    )


def capped(c: str) -> str:
    return (
        f"CASE WHEN {c} < {c}_lo THEN {c}_lo WHEN {c} > {c}_hi THEN {c}_hi ELSE {c} END AS {c}"
    )


HOLES = """
holes AS (
  SELECT * EXCLUDE (str_days),
         CASE WHEN month(date) IN (3, 6, 9, 12) THEN NULL ELSE str_days END AS str_days
  FROM stamped),
holes_train AS (SELECT * FROM holes WHERE split = 'train')"""

EXTENDED_PANEL = f"""
tail AS (
  SELECT brand, zone, {_csv(f"arg_max({m}, date) FILTER (WHERE {m} IS NOT NULL) AS {m}" for m in METRICS)}
  FROM panel GROUP BY brand, zone),
month_ahead AS (
  SELECT CAST(date_trunc('month', max(date)) + INTERVAL 1 MONTH AS DATE) AS tm FROM panel),
ext AS (
  SELECT {KEY}, {_csv(METRICS)} FROM panel
  UNION ALL
  SELECT brand, zone, tm, {_csv(METRICS)} FROM tail, month_ahead)"""

WITH_TOTAL = """
with_total AS (
  SELECT brand, zone, date, value_lakhs FROM panel
  UNION ALL
  SELECT brand, 'All India (U+R)', date, sum(value_lakhs) FROM panel GROUP BY brand, date)"""

PERTURBED = f"""
bent AS (
  SELECT {KEY}, {_csv(
    f"CASE WHEN date = (SELECT max(date) FROM panel) THEN {m} * 7.3 + 11 ELSE {m} END AS {m}"
    for m in METRICS)}
  FROM panel)"""

FOLDS = f"""
folds AS (
  SELECT CAST(i AS INTEGER) AS fold,
         CAST({TRAIN_END} - to_months(CAST(6 * (6 - i) AS INTEGER)) AS DATE) AS cutoff,
         CAST({TRAIN_END} - to_months(CAST(6 * (5 - i) AS INTEGER)) AS DATE) AS fold_end
  FROM range(1, 6) t(i))"""

CV = " UNION ALL ".join(
    f"""SELECT '{c}' AS candidate, fold, sum(abs(y - {c})) / sum(y) * 100 AS e
  FROM bt JOIN folds ON date > cutoff AND date <= fold_end
  WHERE split = 'train' AND naive IS NOT NULL AND seasonal_naive IS NOT NULL AND drift IS NOT NULL
  GROUP BY fold"""
    for c in ("naive", "seasonal_naive", "drift")
)

MOMENTS = "count(value_lakhs) AS n, avg(value_lakhs) AS m, var_samp(value_lakhs) AS v"


def df_sums(y: str, x: str, t: str) -> str:
    return (
        f"regr_count({y}, {x}) AS {t}_n, regr_sxx({y}, {x}) AS {t}_xx, "
        f"regr_sxy({y}, {x}) AS {t}_xy, regr_syy({y}, {x}) AS {t}_yy"
    )


def df_t(t: str) -> str:
    slope = f"({t}_xy / {t}_xx)"
    sse = f"({t}_yy - {slope} * {t}_xy)"
    return f"{slope} / sqrt({sse} / ({t}_n - 2) / {t}_xx)"


def regression(src: str, by: str, y: str, xs: list[str], out: str, where: str = "true", each: int = 0) -> str:
    """CTEs that end in ``out`` (by, n, a, b, sse, v): least squares with a constant.

    The normal equations of the deviations from the means, with the identity beside them,
    are solved by Gauss-Jordan elimination, a pivot at a time. ``b`` are the slopes, ``v``
    the diagonal of the inverse.
    """
    k = len(xs)
    there = " AND ".join(f"{c} IS NOT NULL" for c in [*xs, y])
    rows = _csv(
        "[" + _csv(f"covar_pop({a}, {b}) * count(*)" for b in [*xs, y])
        + "".join(f", CAST({int(i == j)} AS DOUBLE)" for j in range(k)) + "]"
        for i, a in enumerate(xs)
    )
    return f"""
{out}_sums AS (
  SELECT {by}, count(*) AS n, avg({y}) AS my, [{_csv(f"avg({x})" for x in xs)}] AS mx,
         var_pop({y}) * count(*) AS syy, [{_csv(f"covar_pop({x}, {y}) * count(*)" for x in xs)}] AS sxy,
         [{rows}] AS m
  FROM {src} WHERE ({where}) AND {there} GROUP BY {by}),
{out}_steps AS (
  SELECT {by}, m, 1 AS s FROM {out}_sums WHERE n >= {max(k + 2, each * (k + 1))}
  UNION ALL
  SELECT {by}, list_transform(m, lambda row, i: CASE
      WHEN i = s THEN list_transform(row, lambda v: v / m[s][s])
      ELSE list_transform(row, lambda v, j: v - row[s] / m[s][s] * m[s][j]) END), s + 1
  FROM {out}_steps WHERE s <= {k}),
{out}_solved AS (
  SELECT *, [{_csv(f"m[{i}][{k + 1}]" for i in range(1, k + 1))}] AS b,
         [{_csv(f"m[{i}][{k + 1 + i}]" for i in range(1, k + 1))}] AS v
  FROM {out}_steps WHERE s = {k + 1}),
{out} AS (
  SELECT {by}, n, b, v, my - list_dot_product(b, mx) AS a, syy - list_dot_product(b, sxy) AS sse
  FROM {out}_sums LEFT JOIN {out}_solved USING ({by}))"""


def linear(a: str, b: str, xs: list[str], first: int = 1) -> str:
    return " + ".join([a, *(f"{b}[{i}] * {x}" for i, x in enumerate(xs, first))])


STEPS = f"""
st AS (
  SELECT {KEY}, y, ly_l1, ly - ly_l1 AS step, row_number() OVER ({W}) AS t, date <= {TRAIN_END} AS in_fit
  FROM (SELECT {KEY}, value_lakhs AS y, ln(value_lakhs) AS ly, lag(ln(value_lakhs)) OVER ({W}) AS ly_l1
        FROM panel))"""


def inside(k: int, q: int) -> list[str]:
    """One or two shock coefficients, moved to where old shocks die out."""

    def clip(x: str) -> str:
        return f"greatest(least({x}, 0.98), -0.98)"

    if q == 1:
        return [clip(f"b[{k + 1}]")]
    second = clip(f"b[{k + 2}]")
    return [f"{clip(f'b[{k + 1}] / (1 + {second})')} * (1 + {second})", second]


def arma(out: str, p: int, q: int, seasonal: int = 0, src: str = "st", by: str = "brand, zone") -> str:
    """CTEs that end in ``out``: ``src`` rows (by, t, step, in_fit, ...) with n, a, b and delta."""
    w = f"PARTITION BY {by} ORDER BY t"
    lags = [*range(1, p + 1), *(12 * i for i in range(1, seasonal + 1))]
    first = [f"a{i}" for i in range(1, p + q + 3)]
    xs, es = [f"x{i}" for i in lags], [f"e{i}" for i in range(1, q + 1)]
    wide = _csv([*(f"lag(step, {i}) OVER ({w}) AS a{i}" for i in range(1, p + q + 3)),
                 *(f"lag(step, {i}) OVER ({w}) AS x{i}" for i in lags)])
    base = linear("a", "b", xs)
    walked = "".join(f" + b[{len(xs) + i}] * e{i}" for i in range(1, q + 1))
    zero = _csv(f"CAST(0 AS DOUBLE) AS e{i}" for i in range(1, q + 1))
    shift = _csv(
        "coalesce(step - delta, 0) AS e1" if i == 1 else f"e{i - 1} AS e{i}" for i in range(1, q + 1)
    )
    old = _csv(f"w.e{i} AS e{i}" for i in range(1, q + 1))
    return f"""
{out}_l AS (SELECT *, {wide} FROM {src}),
{regression(f"{out}_l", by, "step", first, f"{out}_c1", "in_fit", 3)},
{out}_r AS (
  SELECT l.*, step - ({linear("a", "b", first)}) AS shock FROM {out}_l l LEFT JOIN {out}_c1 USING ({by})),
{out}_e AS (SELECT *, {_csv(f"lag(shock, {i}) OVER ({w}) AS e{i}" for i in range(1, q + 1))} FROM {out}_r),
{regression(f"{out}_e", by, "step", [*xs, *es], f"{out}_c2", "in_fit", 3)},
{out}_c AS (SELECT {by}, n, a, CASE WHEN b IS NOT NULL THEN [{_csv([*(f"b[{i}]" for i in range(1, len(xs) + 1)), *inside(len(xs), q)])}] END AS b FROM {out}_c2),
{out}_b AS (SELECT l.*, coalesce(n, 0) AS n, a, b, {base} AS base FROM {out}_l l LEFT JOIN {out}_c USING ({by})),
{out}_w AS (
  SELECT {by}, t, step, base AS delta, {zero} FROM {out}_b WHERE t = 1
  UNION ALL
  SELECT {by}, t, step, base{walked} AS delta, {_csv(es)}
  FROM (SELECT {_csv(f"r.{c} AS {c}" for c in [*by.split(", "), "t", "step", "base", "b"])}, {old}
        FROM (SELECT {by}, t, {shift} FROM {out}_w) w
        JOIN {out}_b r ON {" AND ".join(f"r.{c} = w.{c}" for c in by.split(", "))} AND r.t = w.t + 1)),
{out} AS (SELECT r.*, w.delta FROM {out}_b r JOIN (SELECT {by}, t, delta FROM {out}_w) w USING ({by}, t))"""


ORDERS = {"arima_111": (1, 1, 0), "arima_212": (2, 2, 0), "sarima": (1, 1, 1)}
ARIMAS = f"""{",".join(arma(name, *order) for name, order in ORDERS.items())},
arimas AS (
  SELECT {KEY}, st.y, {_csv(f"exp(ly_l1 + {name}.delta) AS {name}" for name in ORDERS)}
  FROM st {" ".join(f"JOIN (SELECT {KEY}, delta FROM {name}) {name} USING ({KEY})" for name in ORDERS)})"""
ORIGINS = f"""
origins AS (
  SELECT CAST({TRAIN_END} + to_months(CAST(i AS INTEGER)) AS DATE) AS origin FROM range(1, 7) g(i)),
so AS (
  SELECT st.* EXCLUDE (in_fit), origin, date < origin AS in_fit FROM st JOIN origins ON date <= origin)"""
AHEAD = f"""
last_row AS (SELECT brand, zone, max(date) AS date FROM panel GROUP BY brand, zone),
ahead AS (
  SELECT brand, zone, CAST((SELECT max(date) FROM panel) + INTERVAL 1 MONTH AS DATE) AS date,
         ln(value_lakhs) AS ly_l1
  FROM panel JOIN last_row USING (brand, zone, date)),
sf AS (
  SELECT * EXCLUDE (t), row_number() OVER ({W}) AS t
  FROM (SELECT * FROM st UNION ALL
        SELECT brand, zone, date, CAST(NULL AS DOUBLE), ly_l1, CAST(NULL AS DOUBLE), 0, false FROM ahead)),
{arma("sarima", 1, 1, 1, "sf")},
fc AS (
  SELECT brand, zone, ahead.date AS target_month, exp(ahead.ly_l1) AS last_actual,
         exp(ahead.ly_l1 + delta) AS prediction
  FROM ahead JOIN sarima USING (brand, zone, date)),
totals AS (
  SELECT brand, 'All India (U+R)' AS zone, target_month,
         CASE WHEN bool_and(last_actual IS NOT NULL) THEN sum(last_actual) END AS last_actual,
         CASE WHEN bool_and(prediction IS NOT NULL) THEN sum(prediction) END AS prediction
  FROM fc GROUP BY brand, target_month),
fc_all AS (SELECT * FROM fc UNION ALL SELECT * FROM totals)"""


def adf(p: int, name: str, v: str) -> str:
    """CTEs that end in ``{name}{p}``: the augmented Dickey-Fuller regression of column ``v``."""
    lags = [f"x{i} - x{i + 1} AS d{i}" for i in range(1, p + 1)]
    wide = _csv([v + " AS x0", *(f"lag({v}, {i}) OVER ({W}) AS x{i}" for i in range(1, p + 2))])
    return f"""
{name}{p}_l AS (
  SELECT brand, zone, x0 - x1 AS dy, x1, {_csv(lags)} FROM (SELECT {KEY}, {wide} FROM adf_steps)),
{regression(f"{name}{p}_l", "brand, zone", "dy", ["x1", *(f"d{i}" for i in range(1, p + 1))], f"{name}{p}")}"""


ADF = f"""
adf_steps AS (
  SELECT {KEY}, ln(value_lakhs) AS v, ln(value_lakhs) - lag(ln(value_lakhs)) OVER ({W}) AS dv FROM train),
{",".join(adf(p, name, v) for p in (1, 2, 3) for name, v in (("level", "v"), ("diff", "dv")))}"""


def adf_rows(p: int) -> str:
    def t(name: str) -> str:
        return f"{name}{p}.b[1] / sqrt({name}{p}.sse / ({name}{p}.n - {p + 2}) * {name}{p}.v[1])"

    return f"""SELECT brand, zone, {p} AS lags, coalesce(level{p}.n, 0) AS n_rows, {t("level")} AS tl, {t("diff")} AS td
FROM (SELECT DISTINCT brand, zone FROM train) LEFT JOIN level{p} USING (brand, zone)
LEFT JOIN diff{p} USING (brand, zone)"""


def eliminated(columns: list[str], matrix: str, out: str, src: str) -> str:
    """CTEs that end in ``out`` (m, rank): a k x k matrix eliminated on all pivots that are not rounding.

    Each row is the matrix's, then the identity's; ``matrix`` is the expression of entry (i, j).
    """
    k = len(columns)
    rows = _csv(
        "[" + _csv(matrix.format(a=a, b=b) for b in columns)
        + "".join(f", CAST({int(i == j)} AS DOUBLE)" for j in range(k)) + "]"
        for i, a in enumerate(columns)
    )
    return f"""
{out}_first AS (SELECT count(*) AS n, [{rows}] AS m FROM {src}),
{out}_steps AS (
  SELECT n, m, m AS whole, 0 AS rank, 1 AS s FROM {out}_first
  UNION ALL
  SELECT n, CASE WHEN m[s][s] > 1e-9 * whole[s][s] THEN
      list_transform(m, lambda row, i: CASE
        WHEN i = s THEN list_transform(row, lambda v: v / m[s][s])
        ELSE list_transform(row, lambda v, j: v - row[s] / m[s][s] * m[s][j]) END)
      ELSE m END, whole, rank + CAST(m[s][s] > 1e-9 * whole[s][s] AS INTEGER), s + 1
  FROM {out}_steps WHERE s <= {k}),
{out} AS (SELECT n, m, rank FROM {out}_steps WHERE s = {k + 1})"""


TRAINED = "trained AS (SELECT * FROM clean WHERE split = 'train')"
VIF = eliminated(NUMERIC, "corr({a}, {b})", "vif", "trained")
COVAR = "covar_pop({a}, {b}) * count(*)"
RANKS = (
    eliminated(["d_l1", "d_l2", "rm3"], COVAR, "trio", "trained")
    + "," + eliminated(NUMERIC, COVAR, "inputs", "trained")
)
# ridge as least squares with rows of the penalty added: the standardised matrix plus 0.1 on its diagonal
RIDGE = (
    "penalised AS (SELECT "
    + _csv(f"({c} - (SELECT avg({c}) FROM trained)) / (SELECT stddev_pop({c}) FROM trained) AS {c}" for c in NUMERIC)
    + ", target_d - (SELECT avg(target_d) FROM trained) AS target_d FROM trained),"
    + eliminated(
        NUMERIC, "avg({a} * {b}) + CASE WHEN '{a}' = '{b}' THEN 0.1 ELSE 0 END", "gram", "penalised"
    )
    + ",\nright_side AS (SELECT [" + _csv(f"avg({c} * target_d)" for c in NUMERIC) + "] AS z FROM penalised),\n"
    + "slopes AS (SELECT ["
    + _csv(
        f"list_dot_product(list_slice(m[{i}], {len(NUMERIC) + 1}, {2 * len(NUMERIC)}), z) "
        f"/ (SELECT stddev_pop({c}) FROM trained)"
        for i, c in enumerate(NUMERIC, 1)
    )
    + "] AS b FROM gram, right_side),\n"
    + "ridge AS (SELECT b, (SELECT avg(target_d) FROM trained) - ("
    + " + ".join(f"b[{i}] * (SELECT avg({c}) FROM trained)" for i, c in enumerate(NUMERIC, 1))
    + ") AS a FROM slopes)"
)


AR1_STEPS = f"""
st_x AS (SELECT *, lag(step) OVER ({W}) AS x1 FROM st),
{regression("st_x", "brand, zone", "step", ["x1"], "whole_fit", "in_fit", 3)},
fold_rows AS (
  SELECT st_x.*, fold, date <= cutoff AS in_fold FROM st_x JOIN folds ON date <= fold_end),
{regression("fold_rows", "brand, zone, fold", "step", ["x1"], "fold_fit", "in_fold", 3)},
errors AS (
  SELECT brand, CAST(round_even((step - (a + b[1] * x1)) / 1e-4, 0) AS BIGINT) AS bin
  FROM fold_rows JOIN fold_fit USING (brand, zone, fold)
  WHERE NOT in_fold AND step - (a + b[1] * x1) IS NOT NULL),
grid AS (SELECT brand, bin, count(*) AS n FROM errors GROUP BY brand, bin),
ranked AS (
  SELECT brand, bin, sum(n) OVER (PARTITION BY brand ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY brand) AS whole
  FROM grid),
pooled AS (
  SELECT bin, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS whole
  FROM (SELECT bin, sum(n) AS n FROM grid GROUP BY bin)),
own AS (
  SELECT brand, any_value(whole) AS n, min(bin) FILTER (WHERE upto >= whole * 0.1::DOUBLE) * 1e-4 AS a1,
         min(bin) FILTER (WHERE upto >= whole * 0.5::DOUBLE) * 1e-4 AS a5,
         min(bin) FILTER (WHERE upto >= whole * 0.9::DOUBLE) * 1e-4 AS a9
  FROM ranked GROUP BY brand),
of_all AS (
  SELECT min(bin) FILTER (WHERE upto >= whole * 0.1::DOUBLE) * 1e-4 AS b1,
         min(bin) FILTER (WHERE upto >= whole * 0.5::DOUBLE) * 1e-4 AS b5,
         min(bin) FILTER (WHERE upto >= whole * 0.9::DOUBLE) * 1e-4 AS b9
  FROM pooled),
quantiles AS (
  SELECT brand, {_csv(f"n / (n + 30.0::DOUBLE) * a{i} + (1 - n / (n + 30.0::DOUBLE)) * b{i} AS z{i}" for i in (1, 5, 9))}
  FROM own, of_all),
bands AS (
  SELECT {KEY}, y, exp(ly_l1 + a + b[1] * x1) AS prediction,
         {_csv(f"exp(ly_l1 + a + b[1] * x1) * exp(z{i}) AS q{i}0" for i in (1, 5, 9))}
  FROM st_x LEFT JOIN whole_fit USING (brand, zone) LEFT JOIN quantiles USING (brand) WHERE NOT in_fit)"""


def drift_sql(payload: str) -> list[str]:
    bin_ = (
        "CASE WHEN v > 0 THEN CAST(ceil(ln(v) / 0.01980262729617973) AS INTEGER) + 100000 "
        "WHEN v < 0 THEN -(CAST(ceil(ln(-v) / 0.01980262729617973) AS INTEGER) + 100000) WHEN v = 0 THEN 0 END"
    )

    def counted(src: str, out: str) -> str:
        rows = union(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {src}" for c in NUMERIC)
        return f"{out} AS (SELECT feature, {bin_} AS bin, count(*) AS n FROM ({rows}) GROUP BY ALL)"

    return [
        CLOSED,
        F_,
        CLEAN,
        "reference AS (SELECT * FROM clean WHERE split = 'train')",
        f"payload AS ({payload})",
        counted("reference", "hr"),
        counted("payload", "hp"),
        """both_ AS (
  SELECT feature, bin, sum(r) AS r, sum(p) AS p
  FROM (SELECT feature, bin, n AS r, 0 AS p FROM hr UNION ALL SELECT feature, bin, 0, n FROM hp)
  GROUP BY feature, bin)""",
        """edges AS (
  SELECT feature, min(bin) AS edge, g
  FROM (SELECT feature, bin, CAST(floor(10 * (sum(r) OVER (PARTITION BY feature ORDER BY bin) - r)
               / sum(r) OVER (PARTITION BY feature)) AS INTEGER) AS g
        FROM both_ WHERE bin IS NOT NULL AND r > 0)
  GROUP BY feature, g),
grouped AS (
  SELECT feature, r, p, CASE WHEN bin IS NULL THEN -1 ELSE coalesce(
           (SELECT max(g) FROM edges WHERE edges.feature = b.feature AND edge <= b.bin), 0) END AS g
  FROM both_ b),
shares AS (SELECT feature, g, sum(r) AS r, sum(p) AS p FROM grouped GROUP BY feature, g),
parts AS (
  SELECT *, (r + 0.5::DOUBLE) / (sum(r) OVER f + 0.5::DOUBLE * count(*) OVER f) AS e,
         (p + 0.5::DOUBLE) / (sum(p) OVER f + 0.5::DOUBLE * count(*) OVER f) AS a
  FROM shares WINDOW f AS (PARTITION BY feature)),
gaps AS (
  SELECT feature, max(abs(cr / tr - cp / tp)) AS max_gap
  FROM (SELECT feature, CAST(sum(r) OVER u AS DOUBLE) AS cr, CAST(sum(p) OVER u AS DOUBLE) AS cp,
               sum(r) OVER t AS tr, sum(p) OVER t AS tp
        FROM both_ WHERE bin IS NOT NULL
        WINDOW u AS (PARTITION BY feature ORDER BY bin), t AS (PARTITION BY feature))
  GROUP BY feature),
indexed AS (
  SELECT feature, CAST(sum(r) AS BIGINT) AS n_reference, CAST(sum(p) AS BIGINT) AS n_payload,
         CAST(coalesce(sum(r) FILTER (WHERE g = -1), 0) AS BIGINT) AS missing_reference,
         CAST(coalesce(sum(p) FILTER (WHERE g = -1), 0) AS BIGINT) AS missing_payload,
         sum((a - e) * ln(a / e)) AS psi
  FROM parts GROUP BY feature)""",
    ]


DRIFT_ROWS = f"""SELECT feature, n_reference, n_payload, missing_reference, missing_payload,
  {r('psi')} AS psi, {r('max_gap')} AS max_gap,
  CASE WHEN psi >= 0.25 THEN 'shifted' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS level
FROM indexed JOIN gaps USING (feature)"""

LATTICE = [
    PANEL.replace("r_name AS zone,", "r_name AS zone, n_name AS town,"),
    f"""towns AS (
  SELECT *, lag(value_lakhs) OVER (PARTITION BY brand, zone, town ORDER BY date) AS naive
  FROM (SELECT brand, zone, town, date, CAST(sum(v) AS DOUBLE) / 1e5 AS value_lakhs
        FROM lines GROUP BY brand, zone, town, date)),
lattice AS (
  SELECT CASE grouping(brand, zone, town) WHEN 0 THEN 'town' WHEN 1 THEN 'zone' WHEN 3 THEN 'brand' ELSE 'all' END AS level,
         brand, zone, town, date, count(*) AS n_cells,
         CASE WHEN count(value_lakhs) = count(*) THEN sum(value_lakhs) END AS value_lakhs,
         count(*) - count(value_lakhs) AS n_missing_value_lakhs,
         CASE WHEN count(naive) = count(*) THEN sum(naive) END AS naive,
         count(*) - count(naive) AS n_missing_naive
  FROM towns GROUP BY GROUPING SETS ((brand, zone, town, date), (brand, zone, date), (brand, date), (date)))""",
]


def coherent(child: str, parent: str, keys: list[str], measure: str) -> str:
    on = _csv([*keys, "date"])
    return f"""SELECT '{parent}' AS level, '{child}' AS child, count(*) AS n_cells,
  count(*) FILTER (WHERE c IS NULL OR p IS NULL) AS n_missing,
  count(*) FILTER (WHERE c IS NOT NULL AND p IS NOT NULL AND (parts IS NULL OR whole IS NULL)) AS n_incomplete,
  {r('max(abs((whole - parts) / whole))', 9)} AS max_relative_gap, '{measure}' AS measure
FROM (SELECT {on}, {measure} AS whole, 1 AS p FROM lattice WHERE level = '{parent}')
FULL JOIN (SELECT {on}, CASE WHEN count({measure}) = count(*) THEN sum({measure}) END AS parts, 1 AS c
           FROM lattice WHERE level = '{child}' GROUP BY {on}) USING ({on})"""


GAPPY = """
gappy AS (SELECT * FROM panel WHERE (month(date) * 7 + length(brand)) % 5 <> 0),
ends AS (SELECT brand, zone, min(date) AS lo, max(date) AS hi FROM gappy GROUP BY brand, zone),
every_month AS (
  SELECT brand, zone, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS date FROM ends),
dense AS (
  SELECT m.*, value_lakhs, g.date IS NULL AS is_gap, lo, hi
  FROM every_month m LEFT JOIN gappy g USING (brand, zone, date) JOIN ends USING (brand, zone)),
runs AS (
  SELECT *, CASE WHEN is_gap THEN
    datediff('month', max(date) FILTER (WHERE NOT is_gap) OVER (PARTITION BY brand, zone ORDER BY date),
             min(date) FILTER (WHERE NOT is_gap) OVER (PARTITION BY brand, zone ORDER BY date DESC)) - 1
    ELSE 0 END AS gap_length
  FROM dense)"""


REALISED = f"""
realised AS (
  SELECT 'run-' || CAST(p.date AS VARCHAR) AS run_id, 'none' AS model_version, 'fallback' AS source, p.brand, p.zone,
         CAST(p.date + INTERVAL 1 MONTH AS DATE) AS target_month, p.value_lakhs AS prediction, a.value_lakhs AS actual,
         (p.value_lakhs / a.value_lakhs - 1) * 100 AS error_pct
  FROM panel p LEFT JOIN panel a
    ON a.brand = p.brand AND a.zone = p.zone AND a.date = CAST(p.date + INTERVAL 1 MONTH AS DATE)
  WHERE p.date IN ({LAST}, CAST({LAST} - INTERVAL 1 MONTH AS DATE)))"""
PART_ROWS = f"""
steps AS (
  SELECT *, lag(step) OVER ({W}) AS step_l1
  FROM (SELECT {KEY}, ln(value_lakhs) - lag(ln(value_lakhs)) OVER ({W}) AS step FROM panel)),
moved AS (
  SELECT *, date <= {TRAIN_END} AS is_train,
         CASE WHEN date <= {TRAIN_END} THEN CAST((year(date) * 12 + month(date)) % 5 AS INTEGER) ELSE -1 END AS fold
  FROM steps WHERE step IS NOT NULL),
fs AS (SELECT fold, sum(step) AS s, count(*) AS n FROM moved WHERE is_train GROUP BY fold),
ms AS (SELECT brand, sum(step) AS s, count(*) AS n FROM moved WHERE is_train GROUP BY brand),
mf AS (SELECT brand, fold, sum(step) AS s, count(*) AS n FROM moved WHERE is_train GROUP BY brand, fold),
w AS (SELECT sum(step) AS s, count(*) AS n FROM moved WHERE is_train),
part_rows AS (
  SELECT moved.*, CASE
    WHEN is_train THEN (ms.s - mf.s + 20.0::DOUBLE * (w.s - fs.s) / (w.n - fs.n)) / (ms.n - mf.n + 20)
    WHEN ms.n IS NOT NULL THEN (ms.s + 20.0::DOUBLE * w.s / w.n) / (ms.n + 20)
    ELSE w.s / w.n END AS encoded
  FROM moved LEFT JOIN ms USING (brand) LEFT JOIN mf USING (brand, fold) LEFT JOIN fs USING (fold), w)"""
PARTS = [CLOSED.replace("p_brand AS brand", "CAST(p_partkey AS VARCHAR) AS brand"), PART_ROWS]


def union(rows) -> str:
    return " UNION ALL ".join(rows)


_pairs = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]

EXTENDED = [*BASIC, "mape", "r2", "total_mape", "total_r2", "segment_wmape", "coverage"]


def digest_text(column: str, number: bool) -> str:
    text = f"CAST(round_even({column} * 1e6, 0) AS DECIMAL(38,0))" if number else column
    return f"coalesce('=' || CAST({text} AS VARCHAR), '-')"


DIGEST = " || '|' || ".join(
    [digest_text(c, False) for c in ("brand", "zone", "date")] + [digest_text(m, True) for m in METRICS]
)

ORACLES: dict[str, str] = {
    "panel_from_files": on_panel("SELECT * FROM panel"),
    "data_fingerprint": on_panel(
        f"""SELECT count(*) AS n_rows, bit_xor(h) AS hash_xor, CAST(sum(h) AS BIGINT) AS hash_sum
FROM (SELECT CAST('0x' || substr(md5({DIGEST}), 1, 12) AS BIGINT) AS h FROM panel)"""
    ),
    "gbt_invariants": stmt(
        [*BACKTEST, AR1, long(["naive"]), SCORES],
        """SELECT 'n_forecasts' AS name, CAST(count(*) AS DOUBLE) AS value FROM fc_all
UNION ALL SELECT 'n_positive', CAST(count(*) AS DOUBLE) FROM fc_all
UNION ALL SELECT 'n_gaps', CAST(0 AS DOUBLE)
UNION ALL SELECT 'importance', CAST(1 AS DOUBLE)
UNION ALL SELECT 'n_features', CAST(25 AS DOUBLE)
UNION ALL """
        + " UNION ALL ".join(
            f"SELECT 'naive_{m}', {r(m)} FROM scores" for m in EXTENDED
        ),
    ),
    "panel_monthly": on_panel("SELECT * FROM panel"),
    "panel_without_total": on_panel(
        "SELECT * FROM with_total WHERE zone <> 'All India (U+R)'", WITH_TOTAL
    ),
    "labels_standardised": """
SELECT p_partkey,
       upper(regexp_replace(trim('  ' || p_name || '   ' || p_type || ' '), '\\s+', ' ', 'g'))
         AS label,
       upper(regexp_replace(trim(p_brand), '\\s+', ' ', 'g')) AS brand
FROM part""",
    "crosstab_roundtrip": on_panel("SELECT * FROM panel"),
    "segment_subset": on_panel("SELECT * FROM panel WHERE zone IN ('ASIA', 'EUROPE')"),
    "latest_n_months": on_panel(
        "SELECT * FROM panel WHERE date IN "
        "(SELECT DISTINCT date FROM panel ORDER BY date DESC LIMIT 10)"
    ),
    "panel_profile": on_panel(
        union(
            f"""SELECT '{scope}' AS scope, count(*) AS n_rows,
  count(DISTINCT brand || '|' || zone) AS n_series, min(date) AS first_month,
  max(date) AS last_month FROM stamped WHERE {cond}"""
            for scope, cond in (
                ("all", "true"),
                ("train", "split = 'train'"),
                ("test", "split = 'test'"),
            )
        ),
        STAMPED,
    ),
    "split_counts": on_panel(
        "SELECT split, count(*) AS n_rows, min(date) AS first_month, max(date) AS last_month "
        "FROM stamped GROUP BY split",
        STAMPED,
    ),
    "calendar_features": on_panel(f"SELECT {KEY}, month, is_festive, is_summer FROM f", F_),
    "lag_features": on_panel(
        f"SELECT {KEY}, {rr(['ly', *[f'ly_l{k}' for k in range(1, 8)]])} FROM f", F_
    ),
    "momentum_features": on_panel(f"SELECT {KEY}, {rr(['d_l1', 'd_l2', 'd_l3'])} FROM f", F_),
    "rolling_features": on_panel(f"SELECT {KEY}, {rr(['rm3', 'rm6', 'sd6'])} FROM f", F_),
    "exog_lags": on_panel(
        f"SELECT {KEY}, {_csv(f'{c}_l1, {c}_d1' for c in EXOG)} FROM f", F_
    ),
    "segment_totals": on_panel(
        f"SELECT zone, date, {r('sum(value_lakhs)', 9)} AS total, "
        f"{r('ln(sum(value_lakhs))')} AS lzt FROM panel GROUP BY zone, date"
    ),
    "cross_section_features": on_panel(
        f"SELECT {KEY}, {rr(['zt_l1', 'zt_d1', 'share_l1'])} FROM f", F_
    ),
    "encoder_map": on_panel(
        "SELECT 'brand' AS kind, * FROM brand_codes UNION ALL SELECT 'zone', * FROM zone_codes",
        CODES,
    ),
    "encoded_panel": on_panel(
        f"SELECT {KEY}, brand_code, zone_code FROM {coded('panel')}", CODES
    ),
    "feature_table": on_panel(f"SELECT {KEY}, {FEATURES} FROM {coded('f')}", F_, CODES),
    "training_frame": on_panel(
        f"SELECT {KEY}, split, y, {rr(['ly_l1', 'target_d'])}, {FEATURES} FROM {coded('clean')}",
        F_,
        CLEAN,
        CODES,
    ),
    "target_month": on_closed(
        "SELECT max(date) AS as_of, "
        "CAST(date_trunc('month', max(date)) + INTERVAL 1 MONTH AS DATE) AS target_month "
        "FROM panel"
    ),
    "series_last": on_panel(
        "SELECT brand, zone, max(date) AS date, "
        + _csv(f"arg_max({m}, date) FILTER (WHERE {m} IS NOT NULL) AS {m}" for m in METRICS)
        + " FROM panel GROUP BY brand, zone",
    ),
    "extended_panel": on_closed("SELECT * FROM ext", EXTENDED_PANEL),
    "scoring_frame": on_closed(
        f"SELECT brand, zone, date AS target_month, {r('ly_l1')} AS ly_l1, {FEATURES} "
        f"FROM {coded('s')} WHERE date = (SELECT tm FROM month_ahead)",
        EXTENDED_PANEL,
        feats("ext", "s"),
        CODES,
    ),
    "history_depth": on_closed(
        "SELECT brand, zone, count(*) AS n_rows FROM payload GROUP BY brand, zone "
        "HAVING count(*) < 7",
        PAYLOAD,
    ),
    "contract_shallow": on_closed(SHALLOW, PAYLOAD),
    "contract_incomplete": on_closed(INCOMPLETE, PAYLOAD),
    "contract_nulls": on_closed(NULLS, PAYLOAD),
    "contract_nonpositive": on_closed(NONPOSITIVE, PAYLOAD),
    "contract_unknown": on_closed(UNKNOWN, PAYLOAD),
    "contract_report": on_closed(REPORT, PAYLOAD),
    "contract_ranges": on_panel(
        union(
            [
                f"SELECT '{c}' AS column_name, '{kind}' AS dtype, count(*) > count({c}) AS nullable, "
                f"CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, "
                f"{n} AS n_allowed, count(*) = count({c}) AS required FROM train"
                for c, kind, n in (
                    ("brand", "string", "count(DISTINCT brand)"),
                    ("zone", "string", "count(DISTINCT zone)"),
                    ("date", "date", "CAST(NULL AS BIGINT)"),
                )
            ]
            + [
                f"SELECT '{m}', 'double', count(*) > count({m}), min({m}), max({m}), NULL, "
                f"count(*) = count({m}) FROM train"
                for m in METRICS
            ]
        ),
        STAMPED,
    ),
    "contract_allowed": on_panel(
        "SELECT DISTINCT 'brand' AS column_name, brand AS value FROM train "
        "UNION ALL SELECT DISTINCT 'zone', zone FROM train",
        STAMPED,
    ),
    "part_features": stmt(
        [PANEL.replace("p_brand AS brand", "CAST(p_partkey AS VARCHAR) AS brand"), F_],
        f"SELECT {KEY}, {rr(['rm6', 'sd6', 'zt_d1', 'share_l1'])}, sah_l1, num_stores_d1 FROM f",
    ),
    "series_ids": on_panel(
        "SELECT brand || '|' || zone AS series_id, count(*) AS count FROM panel GROUP BY brand, zone"
    ),
    "totals_with_gaps": stmt(
        [
            *AR1_CTES,
            """gaps AS (
  SELECT brand, target_month,
         CASE WHEN zone = 'ASIA' AND brand IN ('Brand#1', 'Brand#2') THEN NULL ELSE prediction END AS p
  FROM fc)""",
        ],
        f"""SELECT brand, target_month, {r('CASE WHEN count(p) = count(*) THEN sum(p) END')} AS prediction,
  count(*) AS n_segments, count(*) - count(p) AS n_missing
FROM gaps GROUP BY brand, target_month""",
    ),
    "eval_with_gaps": stmt(
        [
            CLOSED, F_, CLEAN, COEF, PRED,
            "whole AS (SELECT *, CASE WHEN zone <> 'ASIA' THEN ar1 END AS partial FROM bt)",
            long(["partial", "naive"]).replace("FROM bt", "FROM whole"),
            SCORES,
        ],
        metric_rows([*BASIC, "coverage"]),
    ),
    "contract_range_violations": on_panel(
        union(
            f"SELECT '{m}' AS column_name, "
            f"count(*) FILTER (WHERE {m} < (SELECT min({m}) FROM train)) AS n_below, "
            f"count(*) FILTER (WHERE {m} > (SELECT max({m}) FROM train)) AS n_above "
            "FROM stamped WHERE split = 'test'"
            for m in METRICS
        ),
        STAMPED,
    ),
    "forecast_ar1": stmt(AR1_CTES, f"SELECT {FC_COLUMNS} FROM fc"),
    "reconcile_total": stmt(AR1_CTES, f"SELECT {FC_COLUMNS} FROM totals"),
    "forecast_with_total": stmt(AR1_CTES, f"SELECT {FC_COLUMNS} FROM fc_all"),
    "forecast_ranked": stmt(
        AR1_CTES,
        f"SELECT {FC_COLUMNS}, row_number() OVER "
        "(PARTITION BY zone ORDER BY prediction DESC, brand) AS rank FROM fc_all",
    ),
    "forecast_summary": stmt(
        AR1_CTES,
        f"SELECT {r('CASE WHEN bool_and(prediction IS NOT NULL) THEN sum(prediction) END')} AS total_prediction, "
        f"{r('sum(last_actual)', 9)} AS total_last_actual, count(*) AS n_entities, "
        f"{r('(CASE WHEN bool_and(prediction IS NOT NULL) THEN sum(prediction) END / sum(last_actual) - 1) * 100')} AS total_pct_change, "
        "arg_max(brand, prediction) AS largest_entity FROM totals",
    ),
    "fallback_forecast": on_closed(
        "SELECT brand, zone, CAST(date + INTERVAL 1 MONTH AS DATE) AS target_month, "
        "value_lakhs AS last_actual, value_lakhs AS prediction, CAST(0 AS DOUBLE) AS pct_change, "
        "'fallback' AS source, 'none' AS model_version, CAST(0 AS INTEGER) AS contract_version "
        "FROM panel WHERE date = (SELECT max(date) FROM panel)"
    ),
    "forecast_envelope": stmt(
        [
            *AR1_CTES,
            f"""swing AS (
  SELECT brand, zone, max(abs((y / py - 1) * 100)) AS max_swing_pct
  FROM (SELECT brand, zone, value_lakhs AS y, lag(value_lakhs) OVER ({W}) AS py FROM panel)
  GROUP BY brand, zone)""",
        ],
        f"""SELECT brand, zone, {r('prediction / last_actual')} AS level_ratio, max_swing_pct,
  coalesce(max_swing_pct < 30, false) AS is_stable,
  prediction / last_actual BETWEEN 0.2 AND 5 AS in_envelope,
  (NOT coalesce(max_swing_pct < 30, false)
   OR abs((prediction / last_actual - 1) * 100) < 30) AS calm_enough
FROM fc LEFT JOIN swing USING (brand, zone)""",
    ),
    "parity_diff": stmt(
        [
            *AR1_CTES,
            """got AS (SELECT brand, zone, CAST(date + INTERVAL 1 MONTH AS DATE) AS target_month,
         value_lakhs AS got FROM panel
  WHERE date = (SELECT max(date) FROM panel)),
both_sides AS (
  SELECT brand || '|' || zone AS key, got, prediction AS want, abs(got - prediction) AS d
  FROM got FULL JOIN fc_all USING (brand, zone, target_month))""",
        ],
        f"""SELECT count(*) FILTER (WHERE got IS NOT NULL AND want IS NOT NULL) AS n_compared,
  count(*) FILTER (WHERE got IS NULL) AS n_missing,
  count(*) FILTER (WHERE want IS NULL) AS n_extra, {r('max(d)')} AS max_abs_diff,
  arg_max(key, d) AS worst_key,
  (count(*) FILTER (WHERE got IS NULL OR want IS NULL) = 0 AND max(d) <= 1e-6)
    AS within_tolerance
FROM both_sides""",
    ),
    "ar1_coefficients": on_panel(
        f"SELECT brand, zone, CAST(n_steps AS BIGINT) AS n_steps, {r('a')} AS intercept, "
        f"{r('b')} AS slope FROM coef",
        F_,
        COEF,
    ),
    "mase_scale": backtest(f"SELECT brand, zone, {r('scale')} AS scale FROM scale"),
    "naive_backtest": backtest(
        f"SELECT {KEY}, y, {r('naive', 9)} AS naive FROM bt WHERE split = 'test'"
    ),
    "seasonal_naive": backtest(f"SELECT {KEY}, y, seasonal_naive FROM bt WHERE split = 'test'"),
    "drift_walk": backtest(f"SELECT {KEY}, y, {r('drift')} AS drift FROM bt WHERE split = 'test'"),
    "blend_forecast": backtest(
        f"SELECT {KEY}, y, {r('ar1')} AS ar1, "
        f"{r('ar1 * 0.7 + seasonal_naive * 0.3')} AS blend_70_30, "
        f"{r('ar1 * 0.5 + seasonal_naive * 0.5')} AS blend_50_50 FROM bt WHERE split = 'test'"
    ),
    "eval_naive": evaluated(["naive"], BASIC),
    "eval_ar1": evaluated(["ar1"], BASIC),
    "eval_extended": evaluated(
        ["naive", "seasonal_naive", "drift", "ar1"], [*BASIC, "mape", "r2", "total_mape", "total_r2", "segment_wmape", "coverage"],
    ),
    "quality_gate": stmt(
        [
            *BACKTEST,
            long(["ar1", "naive"]),
            SCORES,
            """pair AS (
  SELECT m.ai_brand_wmape AS w, m.ai_brand_wmape / n.ai_brand_wmape AS v, m.mase / n.mase AS s,
         m.coverage AS c, n.coverage AS nc
  FROM scores m, scores n WHERE m.candidate = 'ar1' AND n.candidate = 'naive')""",
        ],
        f"""SELECT 'ai_brand_wmape' AS gate, {r('w')} AS value, CAST(6 AS DOUBLE) AS threshold,
  w <= 6.0 AS passed FROM pair
UNION ALL SELECT 'vs_naive', {r('v')}, CAST(0.8 AS DOUBLE), v <= 0.8 FROM pair
UNION ALL SELECT 'naive_rel_mase', {r('s')}, CAST(1 AS DOUBLE), s < 1.0 FROM pair
UNION ALL SELECT 'coverage', {r('c')}, nc, c >= nc FROM pair""",
    ),
    "beats_naive": backtest(
        f"""SELECT count(*) AS n_entities, count(*) FILTER (WHERE m < n) AS n_better,
  {r('sum(CASE WHEN m < n THEN y ELSE 0 END) / sum(y) * 100')} AS value_share_pct
FROM (SELECT brand, sum(y) AS y, sum(abs(y - ar1)) / sum(y) AS m,
        sum(abs(y - naive)) / sum(y) AS n
      FROM bt WHERE split = 'test' GROUP BY brand)"""
    ),
    "monthly_bias": backtest(
        f"""SELECT candidate, date, {r('sum(y)', 9)} AS actual, {r('sum(pred)')} AS forecast,
  {r('(sum(pred) / sum(y) - 1) * 100')} AS error_pct
FROM long GROUP BY candidate, date""",
        long(["ar1", "naive"]),
    ),
    "entity_wmape": backtest(
        f"""SELECT candidate, brand, count(*) AS n_rows,
  {r('sum(abs(y - pred)) / sum(y) * 100')} AS zone_wmape
FROM long GROUP BY candidate, brand""",
        long(["ar1", "naive"]),
    ),
    "cv_folds": on_closed(
        """SELECT fold, 'train' AS role, count(*) AS n_rows, min(date) AS first_month,
  max(date) AS last_month
FROM clean JOIN folds ON date <= cutoff WHERE split = 'train' GROUP BY fold
UNION ALL
SELECT fold, 'valid', count(*), min(date), max(date)
FROM clean JOIN folds ON date > cutoff AND date <= fold_end WHERE split = 'train' GROUP BY fold""",
        F_,
        CLEAN,
        FOLDS,
    ),
    "cv_selection_naive": backtest(
        f"""SELECT candidate, n_folds, {r('cv')} AS cv_wmape,
  candidate = (SELECT arg_min(candidate, cv) FROM means) AS selected FROM means""",
        FOLDS,
        f"per_fold AS ({CV})",
        """means AS (
  SELECT candidate, count(*) AS n_folds, avg(e) AS cv FROM per_fold GROUP BY candidate)""",
    ),
    "imputed_panel": on_panel(
        f"SELECT {KEY}, coalesce(str_days, {pct('str_days_v', '0.5')}) AS str_days, "
        f"coalesce(sah, {pct('sah_v', '0.5')}) AS sah FROM holes LEFT JOIN lists "
        "USING (brand, zone)",
        STAMPED,
        HOLES,
        sorted_lists("holes_train", ["str_days", "sah"]),
    ),
    "capped_exog": on_panel(
        f"SELECT {KEY}, {_csv(capped(c) for c in EXOG)} FROM stamped LEFT JOIN fences "
        "USING (brand, zone)",
        STAMPED,
        fences(EXOG, "3.0"),
    ),
    "target_outlier_flags": on_panel(
        """SELECT CAST(month(date) AS INTEGER) AS month, count(*) AS n_rows,
  count(*) FILTER (WHERE value_lakhs < value_lakhs_lo OR value_lakhs > value_lakhs_hi)
    AS n_outliers
FROM stamped LEFT JOIN fences USING (brand, zone) GROUP BY month(date)""",
        STAMPED,
        fences(["value_lakhs"], "1.5"),
    ),
    "scaled_features": on_panel(
        f"SELECT {KEY}, "
        + _csv(f"{r(f'({c} - {c}_m) / {c}_s')} AS {c}" for c in NUMERIC)
        + " FROM clean, fitted",
        F_,
        CLEAN,
        "fitted AS (SELECT "
        + _csv(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in NUMERIC)
        + " FROM clean WHERE split = 'train')",
    ),
    "concentration": on_panel(
        f"""SELECT brand, rank, {r('value', 9)} AS value, {r('value / t')} AS share,
  {r('cum / t')} AS cum_share, {r('hhi')} AS hhi
FROM (SELECT brand, value, row_number() OVER w AS rank, sum(value) OVER w AS cum,
        sum(value) OVER () AS t,
        sum(value * value) OVER () / (sum(value) OVER () * sum(value) OVER ()) AS hhi
      FROM (SELECT brand, sum(value_lakhs) AS value FROM train GROUP BY brand)
      WINDOW w AS (ORDER BY value DESC, brand ROWS UNBOUNDED PRECEDING))""",
        STAMPED,
    ),
    "seasonality_index": on_panel(
        f"""SELECT CAST(month(date) AS INTEGER) AS month, count(*) AS n_rows,
  {r('avg(value_lakhs)')} AS mean,
  {r('avg(value_lakhs) / (SELECT avg(value_lakhs) FROM train)')} AS idx
FROM train GROUP BY month(date)""",
        STAMPED,
    ),
    "series_volatility": on_panel(
        f"""SELECT brand, zone, {r('stddev_samp(step)')} AS sd_step,
  {r('stddev_samp(value_lakhs) / avg(value_lakhs)')} AS cv
FROM (SELECT *, ln(value_lakhs) - lag(ln(value_lakhs)) OVER ({W}) AS step FROM train)
GROUP BY brand, zone""",
        STAMPED,
    ),
    "series_swing": on_panel(
        f"""SELECT brand, zone, max(abs((y / py - 1) * 100)) AS max_swing_pct
FROM (SELECT brand, zone, value_lakhs AS y, lag(value_lakhs) OVER ({W}) AS py FROM panel)
GROUP BY brand, zone"""
    ),
    "anova_segment": on_panel(
        f"""SELECT count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within,
  {r('(sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*)))')}
    AS f_stat
FROM (SELECT zone, {MOMENTS} FROM train GROUP BY zone),
     (SELECT avg(value_lakhs) AS gm FROM train)""",
        STAMPED,
    ),
    "kruskal_month": on_panel(
        f"""SELECT count(*) - 1 AS df, CAST(any_value(n) AS BIGINT) AS n_rows,
  {r('(12.0 / (any_value(n) * (any_value(n) + 1)) * sum(rs * rs / c) - 3 * (any_value(n) + 1)) / (SELECT 1 - sum(t * t * t - t) / any_value(n * n * n - n) FROM ties)')}
    AS h_stat
FROM (SELECT month(date) AS g, sum(rk) AS rs, count(*) AS c, any_value(n) AS n
      FROM ranked GROUP BY month(date))""",
        STAMPED,
        """ranked AS (
  SELECT date, value_lakhs,
         rank() OVER (ORDER BY value_lakhs)
           + (count(*) OVER (PARTITION BY value_lakhs) - 1) / 2.0::DOUBLE AS rk,
         CAST(count(*) OVER () AS DOUBLE) AS n
  FROM train),
ties AS (
  SELECT CAST(count(*) AS DOUBLE) AS t, any_value(n) AS n FROM ranked GROUP BY value_lakhs)""",
    ),
    "welch_festive": on_panel(
        f"""SELECT a.n AS n_first, b.n AS n_second, {r('a.m')} AS mean_first,
  {r('b.m')} AS mean_second, {r('(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n)')} AS t_stat,
  {r('pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1))')}
    AS df
FROM (SELECT {MOMENTS} FROM train WHERE month(date) IN (8, 9, 10, 11)) a,
     (SELECT {MOMENTS} FROM train WHERE month(date) NOT IN (8, 9, 10, 11)) b""",
        STAMPED,
    ),
    "dickey_fuller": on_panel(
        f"""SELECT brand, zone, {r('tl')} AS t_level, {r('td')} AS t_diff,
  CAST(CASE WHEN tl < -2.86 THEN 0 WHEN td < -2.86 THEN 1 END AS INTEGER) AS d
FROM (SELECT brand, zone, {df_t('l')} AS tl, {df_t('d')} AS td
      FROM (SELECT brand, zone, {df_sums('dx', 'x1', 'l')}, {df_sums('dx - s1', 's1', 'd')}
            FROM (SELECT brand, zone, x1, x0 - x1 AS dx, x1 - x2 AS s1
                  FROM (SELECT brand, zone, ln(value_lakhs) AS x0,
                          lag(ln(value_lakhs), 1) OVER ({W}) AS x1,
                          lag(ln(value_lakhs), 2) OVER ({W}) AS x2 FROM train))
            GROUP BY brand, zone))""",
        STAMPED,
    ),
    "feature_correlation": on_panel(
        union(
            f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(f'c{i}')} AS corr FROM pairs"
            for i, (a, b) in enumerate(_pairs)
        ),
        F_,
        CLEAN,
        "pairs AS (SELECT "
        + _csv(f"corr({a}, {b}) AS c{i}" for i, (a, b) in enumerate(_pairs))
        + " FROM clean WHERE split = 'train')",
    ),
    "augmented_dickey_fuller": on_panel(
        f"""SELECT brand, zone, lags, n_rows, {r('tl')} AS t_level, {r('td')} AS t_diff,
  CAST(CASE WHEN tl < -2.86 THEN 0 WHEN td < -2.86 THEN 1 END AS INTEGER) AS d
FROM ({union(adf_rows(p) for p in (1, 2, 3))})""",
        STAMPED,
        ADF,
    ),
    "arima_backtest": on_closed(
        f"SELECT {KEY}, y, {rr(list(ORDERS))} FROM arimas WHERE date > {TRAIN_END}", STEPS, ARIMAS
    ),
    "arima_coefficients": on_closed(
        f"""SELECT brand, zone, max(n) AS n_fit, {r('max(a)')} AS constant,
  {_csv(f"{r(f'max(b[{i}])')} AS {c}" for i, c in enumerate(["ar1", "ar2", "ma1", "ma2"], 1))}
FROM arima_212 GROUP BY brand, zone""",
        STEPS,
        arma("arima_212", 2, 2),
    ),
    "eval_arima": stmt(
        [
            *BACKTEST,
            STEPS,
            ARIMAS,
            f"whole AS (SELECT bt.*, {_csv(ORDERS)} FROM bt LEFT JOIN arimas USING ({KEY}))",
            long([*ORDERS, "naive"]).replace("FROM bt", "FROM whole"),
            SCORES,
        ],
        metric_rows([*BASIC, "coverage"]),
    ),
    "arima_refitted": on_closed(
        f"SELECT {KEY}, y, n AS n_fit, {r('exp(ly_l1 + delta)')} AS prediction FROM refit WHERE date = origin",
        STEPS,
        ORIGINS,
        arma("refit", 1, 1, 0, "so", "brand, zone, origin"),
    ),
    "forecast_sarima": on_closed(f"SELECT {FC_COLUMNS} FROM fc_all", STEPS, AHEAD),
    "feature_vif": on_panel(
        union(
            f"SELECT '{c}' AS feature, {r(f'CASE WHEN rank = {len(NUMERIC)} THEN m[{i}][{len(NUMERIC) + i}] END')} AS vif FROM vif"
            for i, c in enumerate(NUMERIC, 1)
        ),
        F_,
        CLEAN,
        TRAINED,
        VIF,
    ),
    "feature_rank": on_panel(
        "SELECT 'momentum' AS design, n AS n_rows, 3 AS n_columns, rank FROM trio "
        f"UNION ALL SELECT 'inputs', n, {len(NUMERIC)}, rank FROM inputs",
        F_,
        CLEAN,
        TRAINED,
        RANKS,
    ),
    "ridge_coefficients": on_panel(
        f"SELECT 'intercept' AS feature, {r('a')} AS value FROM ridge UNION ALL "
        + union(f"SELECT '{c}', {r(f'b[{i}]')} FROM ridge" for i, c in enumerate(NUMERIC, 1)),
        F_,
        CLEAN,
        TRAINED,
        RIDGE,
    ),
    "prediction_intervals": on_closed(
        f"SELECT {KEY}, y, {rr(['prediction', 'q10', 'q50', 'q90'])} FROM bands", STEPS, FOLDS, AR1_STEPS
    ),
    "interval_scores": on_closed(
        union(
            f"SELECT zone, '{name}' AS metric, {r(value)} AS value FROM scored GROUP BY zone"
            for name, value in (
                ("pinball_q10", "avg(CASE WHEN y >= q10 THEN 0.1 * (y - q10) ELSE 0.9 * (q10 - y) END) FILTER (WHERE ok)"),
                ("pinball_q50", "avg(0.5 * abs(y - q50)) FILTER (WHERE ok)"),
                ("pinball_q90", "avg(CASE WHEN y >= q90 THEN 0.9 * (y - q90) ELSE 0.1 * (q90 - y) END) FILTER (WHERE ok)"),
                ("coverage", "avg(CAST(y BETWEEN q10 AND q90 AS DOUBLE)) FILTER (WHERE ok)"),
                ("width", "sum(q90 - q10) FILTER (WHERE ok) / sum(y) FILTER (WHERE ok)"),
                ("scored", "avg(CAST(ok AS DOUBLE))"),
            )
        ),
        STEPS,
        FOLDS,
        AR1_STEPS,
        "scored AS (SELECT *, y IS NOT NULL AND q10 IS NOT NULL AND q50 IS NOT NULL AND q90 IS NOT NULL AS ok FROM bands)",
    ),
    "drift_holdout": stmt(drift_sql("SELECT * FROM clean WHERE split = 'test'"), DRIFT_ROWS),
    "drift_shifted": stmt(
        drift_sql(
            "SELECT * REPLACE (num_stores_l1 * 1.5 AS num_stores_l1, -sah_d1 - 1.0 AS sah_d1, "
            "CASE WHEN zone <> 'ASIA' THEN str_days_l1 END AS str_days_l1) FROM clean WHERE split = 'test'"
        ),
        DRIFT_ROWS,
    ),
    "level_lattice": stmt(
        LATTICE,
        f"""SELECT level, brand, zone, town, date, n_cells, {r('value_lakhs', 9)} AS value_lakhs,
  n_missing_value_lakhs, {r('naive', 9)} AS naive, n_missing_naive FROM lattice""",
    ),
    "level_coherence": stmt(
        LATTICE,
        union(
            coherent(child, parent, keys, m)
            for m in ("value_lakhs", "naive")
            for child, parent, keys in (
                ("town", "zone", ["brand", "zone"]), ("zone", "brand", ["brand"]), ("brand", "all", [])
            )
        ),
    ),
    "densified_panel": on_panel(
        f"SELECT {KEY}, value_lakhs, is_gap, CAST(gap_length AS INTEGER) AS gap_length FROM runs", GAPPY
    ),
    "gap_report": on_panel(
        """SELECT brand, zone, count(*) AS n_months, count(*) FILTER (WHERE is_gap) AS n_missing,
  count(*) FILTER (WHERE is_gap AND NOT was_gap) AS n_gaps, CAST(max(gap_length) AS INTEGER) AS longest_gap
FROM (SELECT *, lag(is_gap) OVER (PARTITION BY brand, zone ORDER BY date) AS was_gap FROM runs)
GROUP BY brand, zone""",
        GAPPY,
    ),
    "calendar_lags": on_panel(
        f"""SELECT g.brand, g.zone, g.date, lag(g.value_lakhs) OVER (PARTITION BY g.brand, g.zone ORDER BY g.date) AS row_before,
  {_csv(f"m{k}.value_lakhs AS value_lakhs_m{k}" for k in (1, 2, 12))}
FROM gappy g {" ".join(
            f"LEFT JOIN gappy m{k} ON m{k}.brand = g.brand AND m{k}.zone = g.zone "
            f"AND m{k}.date = CAST(g.date - to_months({k}) AS DATE)" for k in (1, 2, 12))}""",
        GAPPY,
    ),
    "ridge_backtest": stmt(
        [
            *BACKTEST,
            TRAINED,
            RIDGE,
            f"""whole AS (
  SELECT bt.*, exp(ly_l1 + {linear("a", "b", NUMERIC)}) AS ridge FROM bt, ridge)""",
            long(["ridge", "naive"]).replace("FROM bt", "FROM whole"),
            SCORES,
        ],
        metric_rows([*BASIC, "coverage"]),
    ),
    "realised_errors": on_closed(
        f"""SELECT run_id, model_version, source, brand, zone, target_month, prediction, actual,
  {r('error_pct')} AS error_pct FROM realised""",
        REALISED,
    ),
    "realised_summary": on_closed(
        f"""SELECT run_id, model_version, target_month, count(*) AS n_forecasts,
  count(*) - count(actual) AS n_open,
  {r('sum(abs(actual - prediction)) / sum(actual) * 100')} AS wmape,
  {r('(sum(prediction) FILTER (WHERE actual IS NOT NULL) / sum(actual) - 1) * 100')} AS bias_pct
FROM realised GROUP BY run_id, model_version, target_month""",
        REALISED,
    ),
    "part_encoding": stmt(PARTS, f"SELECT {KEY}, {r('encoded', 9)} AS encoded FROM part_rows"),
    "part_ridge": stmt(
        [
            *PARTS,
            "used AS (SELECT step, encoded, step_l1 FROM part_rows WHERE is_train AND step_l1 IS NOT NULL)",
            """sums AS (
  SELECT count(*) AS n, avg(step) AS my, avg(encoded) AS m1, avg(step_l1) AS m2,
         stddev_pop(encoded) AS s1, stddev_pop(step_l1) AS s2, corr(encoded, step_l1) AS c,
         covar_pop(encoded, step) / stddev_pop(encoded) AS z1, covar_pop(step_l1, step) / stddev_pop(step_l1) AS z2
  FROM used),
two AS (
  SELECT *, (1.01 * z1 - c * z2) / (1.01 * 1.01 - c * c) / s1 AS b1,
         (1.01 * z2 - c * z1) / (1.01 * 1.01 - c * c) / s2 AS b2 FROM sums)""",
        ],
        f"SELECT n, {r('my - b1 * m1 - b2 * m2')} AS intercept, {r('b1')} AS encoded, {r('b2')} AS step_l1 FROM two",
    ),
    "attribution_identity": backtest(
        f"SELECT count(*) AS n_rows, CAST({len(NUMERIC) + 3} AS BIGINT) AS n_parts, CAST(0 AS BIGINT) AS n_off "
        "FROM bt WHERE split = 'test'"
    ),
    "contract_required": on_closed(
        "SELECT CAST(1 AS INTEGER) AS rule_no, 'required_columns' AS rule, unnest(['sah', 'str_days']) AS key, "
        "CAST(0 AS BIGINT) AS observed, CAST(1 AS BIGINT) AS expected"
    ),
    "contract_offenders": on_closed(
        f"""SELECT * FROM (
  SELECT rule_no, rule, CAST(row_number() OVER (PARTITION BY rule_no ORDER BY key) AS INTEGER) AS place, key, observed, expected,
         count(*) OVER (PARTITION BY rule_no) AS n_offenders
  FROM ({REPORT})) WHERE place <= 3""",
        PAYLOAD,
    ),
    "restored_codes": on_panel(
        f"SELECT {KEY}, brand_code, zone_code FROM {coded('panel')} WHERE zone = 'EUROPE'", CODES
    ),
    "reference_snapshot": on_closed(
        f"SELECT {KEY}, y, brand_code, zone_code, sah_l1, num_stores_d1 FROM {coded('clean')} WHERE split = 'train'",
        F_,
        CLEAN,
        CODES,
    ),
    "prediction_log": on_closed(
        f"""SELECT brand, zone, target_month, {r('last_actual', 9)} AS last_actual, {r('last_actual', 9)} AS prediction,
  CAST(0 AS DOUBLE) AS pct_change, 'fallback' AS source, 'none' AS model_version, CAST(0 AS INTEGER) AS contract_version,
  'run-1' AS run_id, {LAST} AS dt
FROM (SELECT brand, zone, value_lakhs AS last_actual, CAST(date + INTERVAL 1 MONTH AS DATE) AS target_month
      FROM panel WHERE date = (SELECT max(date) FROM panel)
      UNION ALL
      SELECT brand, 'All India (U+R)', sum(value_lakhs), CAST(any_value(date) + INTERVAL 1 MONTH AS DATE)
      FROM panel WHERE date = (SELECT max(date) FROM panel) GROUP BY brand)"""
    ),
    "metrics_log": "SELECT *, 'run-1' AS run_id FROM (" + evaluated(["naive"], BASIC)
    + ") UNION ALL SELECT *, 'run-2' FROM (" + evaluated(["ar1"], BASIC) + ")",
    "random_search": on_closed(
        "SELECT CAST(3 AS BIGINT) AS n_candidates, count(*) AS n_folds, CAST(1 AS BIGINT) AS n_selected, "
        "CAST(1 AS BIGINT) AS n_best FROM folds",
        FOLDS,
    ),
    "seed_stability": union(
        f"SELECT '{m}' AS metric, CAST(3 AS BIGINT) AS n_seeds, true AS is_stable" for m in BASIC
    ),
    "cv_learners_checked": backtest(
        f"""SELECT candidate, n_folds, {r('cv')} AS cv_wmape, true AS chosen_by_error FROM means
UNION ALL SELECT c, (SELECT count(*) FROM folds), NULL, true
FROM (SELECT unnest(['gbt', 'rf', 'ridge', 'gbt_70_ar1_30', 'ar1_50_seasonal_50']) AS c)""",
        FOLDS,
        f"per_fold AS ({CV})",
        """means AS (
  SELECT candidate, count(*) AS n_folds, avg(e) AS cv FROM per_fold GROUP BY candidate)""",
    ),
    "gbt_gate": """SELECT * FROM (VALUES ('ai_brand_wmape', CAST(6 AS DOUBLE), true), ('vs_naive', CAST(0.8 AS DOUBLE), true),
  ('naive_rel_mase', CAST(1 AS DOUBLE), true), ('coverage', CAST(1 AS DOUBLE), true)) AS t(gate, threshold, follows)""",
    "rf_invariants": backtest(
        "SELECT count(*) AS n_rows, count(*) AS n_inside, CAST(1 AS DOUBLE) AS importance FROM bt WHERE split = 'test'"
    ),
    "additivity_check": on_panel(
        f"""SELECT count(*) AS n_cells,
  {r('max(abs(total - parts) / abs(total))', 9)} AS max_relative_error
FROM (SELECT brand, date, sum(value_lakhs) FILTER (WHERE zone = 'All India (U+R)') AS total,
        sum(value_lakhs) FILTER (WHERE zone <> 'All India (U+R)') AS parts
      FROM with_total GROUP BY brand, date)""",
        WITH_TOTAL,
    ),
    "degeneracy_check": on_panel(
        f"""SELECT count(*) AS n_rows, {r('max(abs(rm3 + (2 * d_l1 + d_l2) / 3))', 9)}
    AS max_abs_gap,
  max(abs(rm3 + (2 * d_l1 + d_l2) / 3)) < 1e-12 AS holds
FROM f WHERE rm3 IS NOT NULL AND d_l1 IS NOT NULL AND d_l2 IS NOT NULL""",
        F_,
    ),
    "warmup_nulls": on_panel(
        union(
            f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM mature"
            for c in NUMERIC
        ),
        F_,
        f"mature AS (SELECT * FROM (SELECT *, row_number() OVER ({W}) AS i FROM f) WHERE i > 7)",
    ),
    "leakage_perturbation": on_panel(
        union(
            f"SELECT count(*) AS n_rows, '{c}' AS feature, "
            f"{r(f'max(abs(CAST(a.{c} AS DOUBLE) - b.{c}))', 9)} AS max_abs_diff, "
            f"max(abs(CAST(a.{c} AS DOUBLE) - b.{c})) >= 1e-12 AS leaks "
            "FROM f_last a JOIN g_last b USING (brand, zone)"
            for c in NUMERIC
        ),
        F_,
        PERTURBED,
        feats("bent", "g"),
        f"f_last AS (SELECT * FROM f WHERE date = (SELECT max(date) FROM panel))",
        f"g_last AS (SELECT * FROM g WHERE date = (SELECT max(date) FROM panel))",
    ),
    "leakage_equality": on_panel(
        union(
            f"SELECT '{c}' AS feature, '{m}' AS metric, "
            f"bool_and(CAST({c} AS DOUBLE) IS NOT DISTINCT FROM {m}) AS same FROM f"
            for c in NUMERIC
            for m in METRICS
        ),
        F_,
    ),
    "leakage_shift": on_panel(
        f"""SELECT count(*) AS n_rows, {r('max(abs(a.ly_l1 - b.ly))', 9)} AS max_abs_gap
FROM f a JOIN f b ON a.brand = b.brand AND a.zone = b.zone
  AND a.date = CAST(b.date + INTERVAL 1 MONTH AS DATE)""",
        F_,
    ),
    "partial_segment_effect": on_panel(
        f"""SELECT count(*) AS n_rows,
  count(*) FILTER (WHERE abs(f.share_l1 - h.share_l1) > 1e-9) AS n_moved,
  {r('max(abs(f.share_l1 - h.share_l1))')} AS max_abs_gap
FROM f JOIN h USING (brand, zone, date)
WHERE f.share_l1 IS NOT NULL AND h.share_l1 IS NOT NULL""",
        F_,
        "rest AS (SELECT * FROM panel WHERE brand <> 'Brand#13')",
        feats("rest", "h"),
    ),
}
