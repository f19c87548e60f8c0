"""Registered analytic questions over the sensitivity view (risk pack)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import risk as K
from tessera.plans.registry import query
from tessera.plans.sqlviews import with_risk


def _r(spark, d):
    return K.risk_view(spark, d)


@query("risk_by_measure", with_risk("""
SELECT 'measure' AS dim, measure AS key, CAST(SUM(value) AS DOUBLE) AS total_value FROM risk GROUP BY measure
UNION ALL SELECT 'risk_factor', risk_factor, CAST(SUM(value) AS DOUBLE) FROM risk GROUP BY risk_factor
UNION ALL SELECT 'book', book, CAST(SUM(value) AS DOUBLE) FROM risk GROUP BY book"""))
def q_by_measure(spark, d):
    return K.by_dimensions(_r(spark, d))


@query("risk_uniques", with_risk("""
SELECT measure, COUNT(DISTINCT deal) AS n_deals, COUNT(DISTINCT book) AS n_books FROM risk GROUP BY measure"""))
def q_uniques(spark, d):
    return K.uniques(_r(spark, d))


@query("risk_concentration", with_risk("""
SELECT 'counterparty' AS dim, counterparty AS key, CAST(SUM(ABS(value)) AS DOUBLE) AS gross_value,
       CAST(ROUND(SUM(ABS(value)) / (SELECT SUM(ABS(value)) FROM risk), 6) AS DOUBLE) AS share
FROM risk GROUP BY counterparty
UNION ALL
SELECT 'desk', desk, CAST(SUM(ABS(value)) AS DOUBLE),
       CAST(ROUND(SUM(ABS(value)) / (SELECT SUM(ABS(value)) FROM risk), 6) AS DOUBLE)
FROM risk GROUP BY desk"""))
def q_concentration(spark, d):
    return K.concentration(_r(spark, d), ["counterparty", "desk"])


@query("risk_pivot", with_risk("""
SELECT currency,
  CAST(SUM(CASE WHEN scenario = '1-URGENT' THEN value END) AS DOUBLE) AS urgent,
  CAST(SUM(CASE WHEN scenario = '2-HIGH' THEN value END) AS DOUBLE) AS high,
  CAST(SUM(CASE WHEN scenario = '3-MEDIUM' THEN value END) AS DOUBLE) AS medium,
  CAST(SUM(CASE WHEN scenario = '4-NOT SPECIFIED' THEN value END) AS DOUBLE) AS not_specified,
  CAST(SUM(CASE WHEN scenario = '5-LOW' THEN value END) AS DOUBLE) AS low
FROM risk GROUP BY currency"""))
def q_pivot(spark, d):
    return K.currency_scenario_matrix(_r(spark, d))


@query("risk_top_points", with_risk("""
SELECT measure_point, CAST(SUM(ABS(value)) AS DOUBLE) AS gross_value FROM risk
GROUP BY measure_point ORDER BY SUM(ABS(value)) DESC, measure_point LIMIT 5"""))
def q_top_points(spark, d):
    return K.top_measure_points(_r(spark, d), 5)


@query("risk_top_deals", with_risk("""
SELECT measure, deal, net_value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT measure, deal, CAST(SUM(value) AS DOUBLE) AS net_value,
         row_number() OVER (PARTITION BY measure ORDER BY SUM(value) DESC, deal) AS rank
  FROM risk GROUP BY measure, deal) WHERE rank <= 5"""))
def q_top_deals(spark, d):
    return K.top_deals(_r(spark, d), 5)


@query("risk_trend", with_risk("""
SELECT measure, strftime(month, '%Y-%m') AS month, CAST(total AS DOUBLE) AS total_value,
       CAST(total - lag(total) OVER (PARTITION BY measure ORDER BY month) AS DOUBLE) AS change
FROM (SELECT measure, date_trunc('month', valuation_date) AS month, SUM(value) AS total
      FROM risk GROUP BY measure, date_trunc('month', valuation_date))"""))
def q_trend(spark, d):
    return K.monthly_trend(_r(spark, d))


@query("risk_outliers", with_risk("""
WITH dly AS (SELECT risk_factor, valuation_date, CAST(SUM(value) AS DOUBLE) AS daily FROM risk GROUP BY ALL),
st AS (SELECT risk_factor, AVG(daily) mu, STDDEV_SAMP(daily) sd FROM dly GROUP BY risk_factor)
SELECT d.risk_factor, CAST(d.valuation_date AS VARCHAR) AS valuation_date, ROUND(d.daily, 2) AS daily_value,
       ROUND((d.daily - st.mu) / st.sd, 4) AS z_score
FROM dly d JOIN st USING (risk_factor) WHERE ABS((d.daily - st.mu) / st.sd) > 3.0"""))
def q_outliers(spark, d):
    return K.outliers(_r(spark, d), "risk_factor", 3.0)


@query("risk_stability", with_risk("""
WITH dly AS (SELECT book, valuation_date, CAST(SUM(value) AS DOUBLE) AS daily FROM risk GROUP BY ALL)
SELECT book, ROUND(AVG(daily), 4) AS mean_daily, ROUND(STDDEV_SAMP(daily), 4) AS sd_daily,
       ROUND(STDDEV_SAMP(daily) / ABS(AVG(daily)), 6) AS cv, COUNT(*) AS n_days
FROM dly GROUP BY book"""))
def q_stability(spark, d):
    return K.stability(_r(spark, d), "book")


@query("risk_scenario", with_risk("""
WITH per AS (SELECT measure, scenario, SUM(value) AS total FROM risk GROUP BY ALL)
SELECT measure, list(scenario ORDER BY total, scenario)[1] AS worst_scenario, CAST(MIN(total) AS DOUBLE) AS worst_total,
       list(scenario ORDER BY total DESC, scenario)[1] AS best_scenario, CAST(MAX(total) AS DOUBLE) AS best_total
FROM per GROUP BY measure"""))
def q_scenario(spark, d):
    return K.scenario_compare(_r(spark, d))


@query("risk_corr", with_risk("""
WITH wide AS (
  SELECT valuation_date,
    COALESCE(CAST(SUM(CASE WHEN risk_factor = 'ECONOMY' THEN value END) AS DOUBLE), 0) AS f0,
    COALESCE(CAST(SUM(CASE WHEN risk_factor = 'LARGE' THEN value END) AS DOUBLE), 0) AS f1,
    COALESCE(CAST(SUM(CASE WHEN risk_factor = 'MEDIUM' THEN value END) AS DOUBLE), 0) AS f2,
    COALESCE(CAST(SUM(CASE WHEN risk_factor = 'PROMO' THEN value END) AS DOUBLE), 0) AS f3,
    COALESCE(CAST(SUM(CASE WHEN risk_factor = 'SMALL' THEN value END) AS DOUBLE), 0) AS f4,
    COALESCE(CAST(SUM(CASE WHEN risk_factor = 'STANDARD' THEN value END) AS DOUBLE), 0) AS f5
  FROM risk GROUP BY valuation_date),
names AS (SELECT * FROM (VALUES (0,'ECONOMY'),(1,'LARGE'),(2,'MEDIUM'),(3,'PROMO'),(4,'SMALL'),(5,'STANDARD')) t(i, n)),
long AS (SELECT valuation_date, 0 AS i, f0 AS v FROM wide UNION ALL SELECT valuation_date, 1, f1 FROM wide
  UNION ALL SELECT valuation_date, 2, f2 FROM wide UNION ALL SELECT valuation_date, 3, f3 FROM wide
  UNION ALL SELECT valuation_date, 4, f4 FROM wide UNION ALL SELECT valuation_date, 5, f5 FROM wide)
SELECT na.n AS factor_a, nb.n AS factor_b, ROUND(CORR(a.v, b.v), 6) AS correlation
FROM long a JOIN long b ON a.valuation_date = b.valuation_date AND a.i < b.i
JOIN names na ON na.i = a.i JOIN names nb ON nb.i = b.i
GROUP BY na.n, nb.n"""))
def q_corr(spark, d):
    return K.factor_correlation(_r(spark, d))


@query("risk_offsets", with_risk("""
WITH g AS (SELECT deal, SUM(CASE WHEN value > 0 THEN value ELSE 0 END) AS lv,
                  SUM(CASE WHEN value < 0 THEN -value ELSE 0 END) AS sv FROM risk GROUP BY deal)
SELECT deal, CAST(lv AS DOUBLE) AS long_value, CAST(sv AS DOUBLE) AS short_value,
       CAST(lv - sv AS DOUBLE) AS net_value, CAST(ROUND(LEAST(lv, sv) / GREATEST(lv, sv), 6) AS DOUBLE) AS offset_ratio
FROM g WHERE lv > 0 AND sv > 0"""))
def q_offsets(spark, d):
    return K.offsets(_r(spark, d), "deal")


@query("risk_missing", with_risk("""
SELECT CAST(d.valuation_date AS VARCHAR) AS valuation_date, s.scenario AS missing_scenario
FROM (SELECT DISTINCT valuation_date FROM risk) d, (SELECT DISTINCT scenario FROM risk) s
WHERE NOT EXISTS (SELECT 1 FROM risk r WHERE r.valuation_date = d.valuation_date AND r.scenario = s.scenario)"""))
def q_missing(spark, d):
    return K.missing_scenarios(_r(spark, d))


@query("risk_update_freq", with_risk("""
WITH days AS (SELECT DISTINCT book, valuation_date FROM risk),
g AS (SELECT book, datediff('day', lag(valuation_date) OVER (PARTITION BY book ORDER BY valuation_date), valuation_date) AS gap FROM days)
SELECT book, COUNT(*) AS n_dates, ROUND(AVG(gap), 6) AS avg_gap_days, CAST(MAX(gap) AS INTEGER) AS max_gap_days FROM g GROUP BY book"""))
def q_update_freq(spark, d):
    return K.update_frequency(_r(spark, d), "book")


@query("risk_audit", with_risk("""
SELECT CASE WHEN GROUPING(measure) = 1 THEN 'ALL' ELSE measure END AS measure,
       CASE WHEN GROUPING(risk_factor) = 1 THEN 'ALL' ELSE risk_factor END AS risk_factor,
       CAST(SUM(value) AS DOUBLE) AS total_value, COUNT(*) AS n, GROUPING(measure, risk_factor) AS level
FROM risk GROUP BY ROLLUP (measure, risk_factor)"""))
def q_audit(spark, d):
    return K.audit(_r(spark, d))
