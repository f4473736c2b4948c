"""SQL (DuckDB) with the same meaning as the market queries: shared steps, and one SELECT a query."""

STEPS = r"""
WITH prices AS (
  SELECT 'S' || lpad(l_suppkey::VARCHAR, 5, '0') AS ticker, l_shipdate::DATE AS date,
    100 + 100 * (sum(l_discount::DECIMAL(4,2))::DOUBLE / count(*)) + sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(*) / 20000 AS close,
    sum(l_quantity::DECIMAL(18,2))::DOUBLE AS volume
  FROM lineitem WHERE l_suppkey % 5 <> 0 OR l_shipdate::DATE < DATE '2000-01-01' GROUP BY 1, 2),
ships AS (
  SELECT l_shipdate::DATE AS date,
    100 + 100 * (sum(l_discount::DECIMAL(4,2))::DOUBLE / count(*)) + sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(*) / 20000 AS sector_close,
    10 + 250 * (sum(l_tax::DECIMAL(4,2))::DOUBLE / count(*)) AS vix
  FROM lineitem GROUP BY 1),
rates AS (SELECT o_orderdate::DATE AS date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) / 100000 AS tnx FROM orders GROUP BY 1),
market AS (SELECT date, sector_close, vix, tnx FROM ships FULL JOIN rates USING (date)),
spans AS (SELECT ticker, min(date) AS first, max(date) AS last FROM prices GROUP BY 1),
meta AS (
  SELECT ticker, first, last, CASE WHEN (SELECT max(last) FROM spans) - last > 30 THEN 'delisted' ELSE 'active' END AS fate FROM spans),
filled AS (
  SELECT ticker, date, close, volume,
    last_value(sector_close IGNORE NULLS) OVER w AS sector_close, last_value(vix IGNORE NULLS) OVER w AS vix, last_value(tnx IGNORE NULLS) OVER w AS tnx
  FROM prices LEFT JOIN market USING (date)
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
joined AS (SELECT * FROM filled WHERE close IS NOT NULL AND sector_close IS NOT NULL AND vix IS NOT NULL),
returns AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS log_return FROM joined),
measured AS (
  SELECT *,
    close / lag(close, 63) OVER w - 1 AS momentum, sector_close / lag(sector_close, 63) OVER w - 1 AS sector_change, tnx - lag(tnx, 63) OVER w AS rate_change,
    CASE WHEN count(log_return) OVER v = 21 THEN stddev_samp(log_return) OVER v END AS rv,
    CASE WHEN count(volume) OVER v = 21 THEN avg(volume) OVER v END AS mean_volume,
    lead(close, 21) OVER w / close - 1 AS raw_ret, lead(sector_close, 21) OVER w / sector_close - 1 AS sector_ret,
    count(*) OVER (PARTITION BY ticker) AS n_rows
  FROM returns
  WINDOW w AS (PARTITION BY ticker ORDER BY date), v AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
medians AS (
  SELECT *,
    CASE WHEN count(rv) OVER r = 252 THEN median(rv) OVER r END AS rv_median,
    CASE WHEN count(vix) OVER r = 252 THEN median(vix) OVER r END AS vix_median,
    CASE WHEN count(mean_volume) OVER r = 252 THEN median(mean_volume) OVER r END AS volume_median
  FROM measured WINDOW r AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
flags AS (
  SELECT *, coalesce(momentum > 0, false) AS stock_momentum, coalesce(sector_change > 0, false) AS sector_momentum, coalesce(rv > rv_median, false) AS vol_regime,
    coalesce(vix > vix_median, false) AS vix_regime, coalesce(rate_change > 0, false) AS rate_trend, coalesce(mean_volume > volume_median, false) AS volume_regime
  FROM medians WHERE n_rows >= 323),
feat AS (
  SELECT ticker, date, close, volume, stock_momentum, sector_momentum, vol_regime, vix_regime, rate_trend, volume_regime,
    CASE WHEN momentum IS NOT NULL AND rv_median IS NOT NULL THEN
      CASE WHEN stock_momentum THEN 'Up' ELSE 'Down' END || '/' || CASE WHEN sector_momentum THEN 'Up' ELSE 'Down' END || '/' || CASE WHEN vix_regime THEN 'HighVIX' ELSE 'LowVIX' END END AS state,
    raw_ret AS fwd_ret, raw_ret - sector_ret AS rel_ret
  FROM flags),
buckets(bucket, lo, hi, is_up, label) AS (
  VALUES (0, NULL, -0.10::DOUBLE, false, 'below -10%'), (1, -0.10, -0.05, false, '-10% to -5%'), (2, -0.05, -0.02, false, '-5% to -2%'), (3, -0.02, 0.0, false, '-2% to +0%'),
         (4, 0.0, 0.02, true, '+0% to +2%'), (5, 0.02, 0.05, true, '+2% to +5%'), (6, 0.05, 0.10, true, '+5% to +10%'), (7, 0.10, NULL, true, 'above +10%')),
states AS (
  SELECT a || '/' || b || '/' || c AS state FROM (VALUES ('Up'), ('Down')) x(a), (VALUES ('Up'), ('Down')) y(b), (VALUES ('HighVIX'), ('LowVIX')) z(c)),
bucketed AS (
  SELECT *, CASE WHEN fwd_ret IS NULL THEN NULL WHEN fwd_ret < -0.10 THEN 0 WHEN fwd_ret < -0.05 THEN 1 WHEN fwd_ret < -0.02 THEN 2 WHEN fwd_ret < 0 THEN 3
    WHEN fwd_ret < 0.02 THEN 4 WHEN fwd_ret < 0.05 THEN 5 WHEN fwd_ret < 0.10 THEN 6 ELSE 7 END AS bucket FROM feat),
usable AS (SELECT * FROM bucketed WHERE state IS NOT NULL AND fwd_ret IS NOT NULL),
cluster AS (SELECT greatest(1.0, avg(n)) AS cluster FROM (SELECT date, count(*) AS n FROM feat GROUP BY 1)),
cells AS (
  SELECT s.state, b.bucket, b.is_up, count(u.ticker) AS n, coalesce(sum(u.fwd_ret), 0) AS sum_r, coalesce(sum(u.fwd_ret * u.fwd_ret), 0) AS sum_r2
  FROM states s CROSS JOIN buckets b LEFT JOIN usable u ON u.state = s.state AND u.bucket = b.bucket GROUP BY 1, 2, 3),
summed AS (
  SELECT *, sum(n) OVER (PARTITION BY bucket) AS n_bucket, sum(n) OVER (PARTITION BY state) AS n_state, sum(n) OVER () AS n_all,
    sum(sum_r) OVER (PARTITION BY bucket) AS r_bucket, sum(sum_r2) OVER (PARTITION BY bucket) AS r2_bucket FROM cells),
base AS (
  SELECT *, n_bucket / n_all AS q, coalesce(r_bucket / nullif(n_bucket, 0), 0) AS m_bucket, coalesce(r2_bucket / nullif(n_bucket, 0), 0) AS m2_bucket,
    n_state / (21 * cluster) AS n_eff, n_state / (21 * cluster) / (n_state / (21 * cluster) + 20) AS w FROM summed, cluster),
model AS (
  SELECT *, w * coalesce(n / nullif(n_state, 0), q) + (1 - w) * q AS p, w * coalesce(sum_r / nullif(n, 0), m_bucket) + (1 - w) * m_bucket AS m,
    w * coalesce(sum_r2 / nullif(n, 0), m2_bucket) + (1 - w) * m2_bucket AS m2 FROM base),
moments AS (
  SELECT state, max(n_state)::BIGINT AS n_rows, max(n_eff) AS n_eff, max(w) AS w, sum(CASE WHEN is_up THEN p ELSE 0 END) AS p_up, sum(CASE WHEN is_up THEN q ELSE 0 END) AS p_up_base,
    sum(p * m) AS ev, sum(q * m_bucket) AS ev_base, greatest(sum(p * m2) - sum(p * m) * sum(p * m), 1e-12) AS variance FROM model GROUP BY 1),
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n, min(date) OVER () AS first FROM (SELECT DISTINCT date FROM feat)),
fits AS (SELECT row_number() OVER (ORDER BY date) - 1 AS fit_id, date AS refit_date FROM days WHERE n % 21 = 0 AND date >= first + 1095),
known AS (
  SELECT date, date + (21 + 2 * floor((least(isodow(date) - 1, 4) + 21) / 5)::INTEGER - greatest(isodow(date) - 5, 0))::INTEGER AS known_at FROM days),
dated AS (
  SELECT k.date, (SELECT max(fit_id) FROM fits WHERE refit_date <= k.date) AS test_fit, (SELECT min(fit_id) FROM fits WHERE refit_date >= k.known_at) AS train_fit FROM known k),
attached AS (SELECT u.*, d.test_fit, d.train_fit FROM usable u JOIN dated d USING (date)),
fit_cells AS (
  SELECT f.fit_id, s.state, b.bucket, b.is_up, count(a.ticker) AS n, coalesce(sum(a.fwd_ret), 0) AS sum_r, coalesce(sum(a.fwd_ret * a.fwd_ret), 0) AS sum_r2
  FROM fits f CROSS JOIN states s CROSS JOIN buckets b LEFT JOIN attached a ON a.state = s.state AND a.bucket = b.bucket AND a.train_fit <= f.fit_id GROUP BY 1, 2, 3, 4),
fit_seen AS (SELECT fit_id FROM fit_cells WHERE n > 0 GROUP BY 1 HAVING count(DISTINCT state) >= 2),
fit_summed AS (
  SELECT *, sum(n) OVER (PARTITION BY fit_id, bucket) AS n_bucket, sum(n) OVER (PARTITION BY fit_id, state) AS n_state, sum(n) OVER (PARTITION BY fit_id) AS n_all,
    sum(sum_r) OVER (PARTITION BY fit_id, bucket) AS r_bucket FROM fit_cells SEMI JOIN fit_seen USING (fit_id)),
fit_base AS (
  SELECT *, n_bucket / n_all AS q, coalesce(r_bucket / nullif(n_bucket, 0), 0) AS m_bucket, n_state / (21 * cluster) / (n_state / (21 * cluster) + 20) AS w FROM fit_summed, cluster),
fit_model AS (
  SELECT *, w * coalesce(n / nullif(n_state, 0), q) + (1 - w) * q AS p, w * coalesce(sum_r / nullif(n, 0), m_bucket) + (1 - w) * m_bucket AS m FROM fit_base),
fit_states AS (
  SELECT fit_id, state, sum(CASE WHEN is_up THEN p ELSE 0 END) AS p_up, sum(CASE WHEN is_up THEN q ELSE 0 END) AS p_up_base, sum(p * m) AS ev, sum(q * m_bucket) AS ev_base,
    sum(p * p) AS p2, sum(q * q) AS q2 FROM fit_model GROUP BY 1, 2),
losses AS (
  SELECT a.date, a.ticker, a.test_fit AS fit_id, a.state, a.bucket, -ln(greatest(c.p, 1e-12)) AS ll_model, -ln(greatest(c.q, 1e-12)) AS ll_base,
    s.p2 - 2 * c.p + 1 AS brier_model, s.q2 - 2 * c.q + 1 AS brier_base, s.p_up AS p_up_model, s.p_up_base, a.fwd_ret > 0 AS went_up, s.ev AS ev_model, s.ev_base, a.fwd_ret AS realized
  FROM attached a JOIN fit_model c ON c.fit_id = a.test_fit AND c.state = a.state AND c.bucket = a.bucket JOIN fit_states s ON s.fit_id = a.test_fit AND s.state = a.state),
loss_days AS (SELECT date, sum(count(*)) OVER (ORDER BY date) AS upto, sum(count(*)) OVER () AS total FROM losses GROUP BY 1),
cut AS (SELECT min(date) AS cut FROM loss_days WHERE upto > floor(total * 0.8)),
scored AS (SELECT l.*, CASE WHEN date < cut THEN 'dev' ELSE 'holdout' END AS period FROM losses l, cut),
track AS (
  SELECT *, (ev_model > 0) = (realized > 0) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS k FROM scored) WHERE k % 21 = 0),
dev AS (SELECT * FROM scored WHERE period = 'dev'),
units AS (SELECT date, sum(ll_base - ll_model) AS s, count(*) AS n FROM dev GROUP BY 1),
blocks AS (
  SELECT row_number() OVER (ORDER BY date) - 1 AS start, sum(s) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS s, sum(n) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS n FROM units),
size AS (SELECT count(*) AS units, count(*) - 20 AS starts, ceil(count(*) / 21)::BIGINT AS blocks FROM blocks),
picks AS (
  SELECT d.range AS draw, ('0x' || substr(md5('0:' || d.range || ':' || j.range), 1, 12))::BIGINT % starts AS start
  FROM size, range(2000) d, range(10000) j WHERE j.range < blocks AND units >= 42),
means AS (SELECT draw, sum(s) / sum(n) AS mean FROM picks JOIN blocks USING (start) GROUP BY 1),
ci AS (SELECT quantile_cont(mean, 0.05) AS lo, quantile_cont(mean, 0.95) AS hi FROM means),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM prices),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM feat) WHERE k = 1)
"""

VERDICT = "CASE WHEN lo IS NULL OR hi IS NULL THEN 'too little data' WHEN lo > 0 THEN 'better than baseline' WHEN hi < 0 THEN 'worse than baseline' ELSE 'indistinguishable from baseline' END"

_factor = lambda name: f"SELECT ticker, date, {name} FROM feat"

SELECTS = {
    "prices_min_history": "SELECT ticker, date, close, volume FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM prices) WHERE n >= 300",
    "vendor_ingest": "SELECT ticker, count(*) AS n_rows, min(date) AS first, max(date) AS last, sum(volume) AS volume FROM prices WHERE ticker <> 'S00003' GROUP BY 1 HAVING count(*) >= 300",
    "adj_close_prefer": "SELECT ticker, date, CASE WHEN extract(day FROM date) % 2 = 0 THEN close / 2 ELSE close END AS close FROM prices",
    "delisted_select": "SELECT ticker, last FROM meta WHERE fate = 'delisted' AND last >= DATE '1999-01-01' ORDER BY last DESC, ticker LIMIT 10",
    "ticker_list_parse": "SELECT 'C' || c_custkey AS symbol, CASE WHEN c_custkey % 3 = 0 THEN 'C' || c_custkey ELSE c_name END AS name FROM customer WHERE c_custkey % 7 <> 0",
    "prices_unpivot": "SELECT symbol, date, close FROM market UNPIVOT (close FOR symbol IN (sector_close, vix, tnx)) QUALIFY count(*) OVER (PARTITION BY symbol) >= 400",
    "market_pivot": "SELECT date, sector_close, vix, tnx FROM market",
    "union_sources": "SELECT ticker, last AS delisted_date FROM meta WHERE fate = 'delisted' UNION SELECT ticker, NULL FROM meta WHERE fate = 'active'",
    "incremental_anti": "SELECT DISTINCT ticker FROM prices WHERE ticker NOT IN (SELECT ticker FROM meta WHERE fate = 'delisted')",
    "fate_from_gap": "SELECT ticker, first, last, fate FROM meta",
    "fate_counts": "SELECT fate, count(*) AS n, min(first) AS first, max(last) AS last FROM meta GROUP BY 1",
    "alive_by_year": "SELECT y.range::INTEGER AS year, count(*) AS alive FROM meta, range(1900, 2100) y WHERE y.range BETWEEN extract(year FROM first) AND extract(year FROM last) GROUP BY 1",
    "equal_weight_index": """SELECT date, round(ret, 6) AS ret, round(100 * exp(sum(ln(1 + ret)) OVER (ORDER BY date)), 6) AS level FROM (
        SELECT date, sum(r) / count(*) AS ret FROM (SELECT date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM prices) WHERE r IS NOT NULL GROUP BY 1)""",
    "market_join_ffill": "SELECT ticker, date, close, sector_close, vix, tnx FROM joined",
    "ffill": "SELECT ticker, date, tnx FROM filled",
    "realized_vol": "SELECT ticker, date, round(rv, 6) AS rv FROM measured",
    "rolling_mean_volume": "SELECT ticker, date, round(mean_volume, 6) AS mean_volume FROM measured",
    "rolling_median": "SELECT ticker, date, round(vix_median, 6) AS vix_median, round(rv_median, 6) AS rv_median, round(volume_median, 6) AS volume_median FROM medians",
    "history_filter": "SELECT ticker, n_rows FROM (SELECT ticker, count(*) AS n_rows FROM joined GROUP BY 1) WHERE n_rows >= 323",
    "factor_stock_momentum": _factor("stock_momentum"),
    "factor_sector_momentum": _factor("sector_momentum"),
    "factor_vol_regime": _factor("vol_regime"),
    "factor_vix_regime": _factor("vix_regime"),
    "factor_rate_trend": _factor("rate_trend"),
    "factor_volume_regime": _factor("volume_regime"),
    "state_assign": "SELECT ticker, date, state FROM feat",
    "fwd_return": "SELECT ticker, date, round(fwd_ret, 6) AS fwd_ret FROM feat",
    "fwd_return_relative": "SELECT ticker, date, round(rel_ret, 6) AS fwd_ret FROM feat",
    "bucket_assign": "SELECT ticker, date, bucket FROM bucketed",
    "bucket_dollars": "SELECT ticker, bucket, label, round(close * lo, 2) AS lo_dollars, round(close * hi, 2) AS hi_dollars FROM latest, buckets",
    "business_day_add": "SELECT date, known_at FROM known",
    "cluster_factor": "SELECT round(cluster, 6) AS cluster, (SELECT count(*) FROM usable) AS usable_rows, round((SELECT count(*) FROM usable) / (21 * cluster), 6) AS independent FROM cluster",
    "state_bucket_counts": "SELECT state, bucket, n, round(sum_r, 6) AS sum_r, round(sum_r2, 6) AS sum_r2 FROM cells",
    "unconditional": "SELECT DISTINCT bucket, round(q, 6) AS q, round(m_bucket, 6) AS m_bucket, round(m2_bucket, 6) AS m2_bucket FROM base",
    "shrunk_probs": "SELECT state, bucket, n, round(w, 6) AS w, round(q, 6) AS q, round(p, 6) AS p FROM model",
    "state_moments": "SELECT state, round(ev, 6) AS ev, round(sqrt(variance), 6) AS std, round(ev / sqrt(variance), 6) AS ev_over_std, round(ev / variance, 4) AS kelly_full, round(ev / variance / 2, 4) AS kelly_half FROM moments",
    "state_table": "SELECT state, n_rows, round(n_eff, 6) AS n_eff, round(p_up, 6) AS p_up, round(ev, 6) AS ev, round(sqrt(variance), 6) AS std FROM moments",
    "predict_state": "SELECT bucket, round(p, 6) AS p, round(q, 6) AS q, round(p * m, 6) AS contribution FROM model WHERE state = 'Up/Up/LowVIX'",
    "predict_record": """SELECT state, n_rows, round(n_eff, 1) AS independent_obs, round(w, 3) AS weight_on_state, round(p_up, 6) AS p_up, round(p_up_base, 6) AS p_up_base, round(ev, 6) AS ev,
        round(ev_base, 6) AS ev_base, round(sqrt(variance), 6) AS std, round(ev / sqrt(variance), 6) AS ev_over_std FROM moments""",
    "predict_latest": "SELECT l.ticker, l.date, l.state, m.n_rows, round(m.p_up, 6) AS p_up, round(m.p_up_base, 6) AS p_up_base, round(m.ev, 6) AS ev FROM latest l JOIN moments m USING (state)",
    "transition_matrix": """SELECT from_state, to_state, n, round(w * coalesce(n / nullif(rows, 0), share) + (1 - w) * share, 6) AS p FROM (
        SELECT *, rows / (21 * cluster) / (rows / (21 * cluster) + 20) AS w FROM (
          SELECT from_state, to_state, n, sum(n) OVER (PARTITION BY from_state) AS rows, sum(n) OVER (PARTITION BY to_state) / sum(n) OVER () AS share FROM (
            SELECT a.state AS from_state, b.state AS to_state, count(p.f) AS n FROM states a CROSS JOIN states b
            LEFT JOIN (SELECT state AS f, lead(state, 21) OVER (PARTITION BY ticker ORDER BY date) AS t FROM usable) p ON p.f = a.state AND p.t = b.state GROUP BY 1, 2)), cluster)""",
    "survivorship_gap": """SELECT * FROM (WITH both_ AS (SELECT 'all' AS cohort, u.* FROM feat u UNION ALL SELECT 'survivors', u.* FROM feat u SEMI JOIN (SELECT ticker FROM meta WHERE fate = 'active') USING (ticker)),
        cl AS (SELECT DISTINCT cohort, cluster FROM both_, cluster),
        us AS (SELECT b.*, CASE WHEN fwd_ret < -0.10 THEN 0 WHEN fwd_ret < -0.05 THEN 1 WHEN fwd_ret < -0.02 THEN 2 WHEN fwd_ret < 0 THEN 3 WHEN fwd_ret < 0.02 THEN 4 WHEN fwd_ret < 0.05 THEN 5 WHEN fwd_ret < 0.10 THEN 6 ELSE 7 END AS bucket FROM both_ b WHERE state IS NOT NULL AND fwd_ret IS NOT NULL),
        ce AS (SELECT c.cohort, c.cluster, s.state, b.bucket, b.is_up, count(u.ticker) AS n, coalesce(sum(u.fwd_ret), 0) AS sum_r FROM cl c CROSS JOIN states s CROSS JOIN buckets b LEFT JOIN us u ON u.cohort = c.cohort AND u.state = s.state AND u.bucket = b.bucket GROUP BY ALL),
        su AS (SELECT *, sum(n) OVER (PARTITION BY cohort, bucket) AS nb, sum(n) OVER (PARTITION BY cohort, state) AS ns, sum(n) OVER (PARTITION BY cohort) AS na, sum(sum_r) OVER (PARTITION BY cohort, bucket) AS rb FROM ce),
        ba AS (SELECT *, nb / na AS q, coalesce(rb / nullif(nb, 0), 0) AS mb, ns / (21 * cluster) / (ns / (21 * cluster) + 20) AS w FROM su)
        SELECT cohort, state, max(ns)::BIGINT AS n_rows, round(sum(CASE WHEN is_up THEN w * coalesce(n / nullif(ns, 0), q) + (1 - w) * q ELSE 0 END), 6) AS p_up,
          round(sum((w * coalesce(n / nullif(ns, 0), q) + (1 - w) * q) * (w * coalesce(sum_r / nullif(n, 0), mb) + (1 - w) * mb)), 6) AS ev,
          round(sum(CASE WHEN is_up THEN q ELSE 0 END), 6) AS p_up_base, round(sum(q * mb), 6) AS ev_base FROM ba WHERE cohort = 'all' OR na > 210 GROUP BY 1, 2)""",
    "latest_state": "SELECT ticker, date, state, stock_momentum, sector_momentum, vix_regime FROM latest",
    "lookback_changes": """SELECT ticker, date, close, round(c1, 6) AS change_1, round(c21, 6) AS change_21, round(c252, 6) AS change_252 FROM (
        SELECT ticker, date, close, close / lag(close, 1) OVER w - 1 AS c1, close / lag(close, 21) OVER w - 1 AS c21, close / lag(close, 252) OVER w - 1 AS c252,
          row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE k = 1""",
    "annualised_vol": """SELECT ticker, round(stddev_samp(r) * sqrt(252), 6) AS vol FROM (
        SELECT ticker, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM prices) WHERE k <= 252 GROUP BY 1""",
    "recent_history": "SELECT ticker, count(*) AS n_days, min(close) AS low, max(close) AS high, min(date) AS first, max(date) AS last FROM ranked WHERE k <= 756 GROUP BY 1",
    "stored_history": "SELECT ticker, date, close FROM ranked WHERE k <= 756",
    "price_store": """SELECT p.ticker, count(*) AS n_rows, min(date) AS first, max(date) AS last, sum(floor(CASE WHEN fate = 'delisted' THEN close ELSE close + 1000 END * 1000))::BIGINT AS total
        FROM (SELECT ticker, date, close FROM prices) p JOIN meta m USING (ticker) GROUP BY 1""",
    "store_features": "SELECT ticker, date, state, round(fwd_ret, 6) AS fwd_ret FROM feat",
    "features_in_slices": "SELECT ticker, date, state, round(fwd_ret, 6) AS fwd_ret FROM feat",
    "ticker_search": "SELECT s_suppkey, s_name FROM supplier WHERE lower(s_name) LIKE '%' || lower('R#00000000') || '%'",
    "refit_calendar": "SELECT fit_id::INTEGER AS fit_id, refit_date FROM fits",
    "asof_fit": "SELECT date, test_fit::INTEGER AS test_fit FROM dated",
    "purge_fit": "SELECT date, train_fit::INTEGER AS train_fit FROM dated",
    "expanding_fit": "SELECT fit_id::INTEGER AS fit_id, state, bucket, n::BIGINT AS n, round(sum_r, 6) AS sum_r FROM fit_cells SEMI JOIN fit_seen USING (fit_id) WHERE fit_id IN (SELECT test_fit FROM attached UNION SELECT train_fit FROM attached)",
    "fit_guard": "SELECT fit_id::INTEGER AS fit_id, count(DISTINCT state)::INTEGER AS n_seen FROM fit_cells WHERE n > 0 AND fit_id IN (SELECT test_fit FROM attached UNION SELECT train_fit FROM attached) GROUP BY 1 HAVING count(DISTINCT state) >= 2",
    "predict_rows": "SELECT date, ticker, state, round(p_up_model, 6) AS p_up_model, round(p_up_base, 6) AS p_up_base FROM scored",
    "log_loss": "SELECT date, ticker, round(ll_model, 6) AS ll_model, round(ll_base, 6) AS ll_base FROM scored",
    "brier": "SELECT date, ticker, round(brier_model, 6) AS brier_model, round(brier_base, 6) AS brier_base FROM scored",
    "walk_forward": """SELECT date, ticker, fit_id::INTEGER AS fit_id, state, bucket, round(ll_model, 6) AS ll_model, round(ll_base, 6) AS ll_base, round(brier_model, 6) AS brier_model, round(brier_base, 6) AS brier_base,
        round(p_up_model, 6) AS p_up_model, round(p_up_base, 6) AS p_up_base, went_up, round(ev_model, 6) AS ev_model, round(ev_base, 6) AS ev_base, round(realized, 6) AS realized, period FROM scored""",
    "holdout_split": "SELECT period, count(*) AS n, min(date) AS first, max(date) AS last FROM scored GROUP BY 1",
    "score_summary": """SELECT period, rows, start, "end", CASE WHEN period = 'dev' THEN round(a, 6) END AS logloss_model, CASE WHEN period = 'dev' THEN round(b, 6) END AS logloss_base, CASE WHEN period = 'dev' THEN round(c, 6) END AS logloss_gain,
        CASE WHEN period = 'dev' THEN round(d, 6) END AS brier_model, CASE WHEN period = 'dev' THEN round(e, 6) END AS brier_base, CASE WHEN period = 'dev' THEN round(f, 6) END AS hit_model, CASE WHEN period = 'dev' THEN round(g, 6) END AS hit_base,
        CASE WHEN period = 'dev' THEN round(rows / (21 * cluster), 6) END AS independent FROM (
          SELECT period, count(*) AS rows, min(date) AS start, max(date) AS "end", avg(ll_model) AS a, avg(ll_base) AS b, avg(ll_base - ll_model) AS c, avg(brier_model) AS d, avg(brier_base) AS e,
            avg(((round(p_up_model, 9) > 0.5) = went_up)::INTEGER) AS f, avg(((round(p_up_base, 9) > 0.5) = went_up)::INTEGER) AS g FROM scored GROUP BY 1), cluster""",
    "calibration": """SELECT bin::INTEGER AS bin, round(avg(p_up_model), 6) AS predicted, round(avg(went_up::INTEGER), 6) AS realized, count(*) AS rows FROM (
        SELECT *, CASE WHEN p_up_model <= e[2] THEN 0 WHEN p_up_model <= e[3] THEN 1 WHEN p_up_model <= e[4] THEN 2 WHEN p_up_model <= e[5] THEN 3 ELSE 4 END AS bin
        FROM (SELECT round(p_up_model, 9) AS p_up_model, went_up FROM dev), (SELECT quantile_cont(round(p_up_model, 9), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM dev)) GROUP BY 1""",
    "block_bootstrap": "SELECT round(lo, 6) AS lo, round(hi, 6) AS hi FROM ci",
    "verdict": f"SELECT {VERDICT} AS verdict FROM ci",
    "track_record": "SELECT ticker, date, state, round(ev_model, 6) AS ev_model, round(ev_base, 6) AS ev_base, round(realized, 6) AS realized, hit, period FROM track",
    "track_record_summary": """SELECT ticker, count(*) AS n, count(*) FILTER (ev_model > 0) AS n_positive, round(avg(hit::INTEGER), 6) AS hit_rate, round(avg(hit::INTEGER) FILTER (ev_model > 0), 6) AS hit_when_positive, round(avg(hit::INTEGER) FILTER (ev_model <= 0), 6) AS hit_when_negative,
        round(avg(((ev_base > 0) = (realized > 0))::INTEGER), 6) AS base_hit_rate,
        round(avg((realized > 0)::INTEGER), 6) AS always_up_rate FROM track WHERE period = 'dev' GROUP BY 1""",
    "last_dev_months": "SELECT ticker, date, round(ev_model, 6) AS ev_model, round(realized, 6) AS realized FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM track WHERE period = 'dev') WHERE r <= 24",
}

# One calendar, one cut and one model for each ticker; a state that a ticker has not seen takes q.
BY_TICKER = r"""
, t_days AS (SELECT ticker, date, row_number() OVER w - 1 AS n, min(date) OVER (PARTITION BY ticker) AS first FROM {feat} WINDOW w AS (PARTITION BY ticker ORDER BY date)),
t_fits AS (SELECT ticker, date AS refit_date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS fit_id FROM t_days WHERE n % 63 = 0 AND date >= first + {days}),
t_known AS (SELECT u.*, k.known_at FROM {usable} u JOIN known k USING (date)),
t_tested AS (SELECT u.*, f.fit_id AS test_fit FROM t_known u ASOF LEFT JOIN t_fits f ON u.ticker = f.ticker AND u.date >= f.refit_date),
t_rows AS (SELECT u.*, f.fit_id AS train_fit FROM t_tested u ASOF LEFT JOIN t_fits f ON u.ticker = f.ticker AND u.known_at <= f.refit_date),
t_cells AS (
  SELECT f.ticker, f.fit_id, s.state, b.bucket, b.is_up, count(a.date) AS n, coalesce(sum(a.fwd_ret), 0) AS sum_r
  FROM t_fits f CROSS JOIN states s CROSS JOIN buckets b LEFT JOIN t_rows a ON a.ticker = f.ticker AND a.state = s.state AND a.bucket = b.bucket AND a.train_fit <= f.fit_id GROUP BY ALL),
t_summed AS (
  SELECT *, sum(n) OVER (PARTITION BY ticker, fit_id, bucket) AS n_bucket, sum(n) OVER (PARTITION BY ticker, fit_id, state) AS n_state, sum(n) OVER (PARTITION BY ticker, fit_id) AS n_all,
    sum(sum_r) OVER (PARTITION BY ticker, fit_id, bucket) AS r_bucket FROM t_cells
  SEMI JOIN (SELECT ticker, fit_id FROM t_cells WHERE n > 0 GROUP BY 1, 2 HAVING count(DISTINCT state) >= 2) USING (ticker, fit_id)),
t_base AS (SELECT *, n_bucket / n_all AS q, coalesce(r_bucket / nullif(n_bucket, 0), 0) AS m_bucket, n_state / 21 / (n_state / 21 + 20) AS w FROM t_summed),
t_model AS (SELECT *, w * coalesce(n / nullif(n_state, 0), q) + (1 - w) * q AS p, w * coalesce(sum_r / nullif(n, 0), m_bucket) + (1 - w) * m_bucket AS m FROM t_base),
t_states AS (
  SELECT ticker, fit_id, state, sum(CASE WHEN is_up THEN p ELSE 0 END) AS p_up, sum(CASE WHEN is_up THEN q ELSE 0 END) AS p_up_base, sum(p * m) AS ev, sum(q * m_bucket) AS ev_base,
    sum(p * p) AS p2, sum(q * q) AS q2 FROM t_model GROUP BY 1, 2, 3),
t_losses AS (
  SELECT a.date, a.ticker, a.test_fit AS fit_id, a.state, a.bucket, -ln(greatest(c.p, 1e-12)) AS ll_model, -ln(greatest(c.q, 1e-12)) AS ll_base, s.p2 - 2 * c.p + 1 AS brier_model, s.q2 - 2 * c.q + 1 AS brier_base,
    s.p_up AS p_up_model, s.p_up_base, a.fwd_ret > 0 AS went_up, s.ev AS ev_model, s.ev_base, a.fwd_ret AS realized
  FROM t_rows a JOIN t_model c ON c.ticker = a.ticker AND c.fit_id = a.test_fit AND c.state = a.state AND c.bucket = a.bucket JOIN t_states s ON s.ticker = a.ticker AND s.fit_id = a.test_fit AND s.state = a.state),
t_upto AS (SELECT ticker, date, sum(count(*)) OVER (PARTITION BY ticker ORDER BY date) AS upto, sum(count(*)) OVER (PARTITION BY ticker) AS total FROM t_losses GROUP BY 1, 2),
t_cut AS (SELECT ticker, min(date) AS cut FROM t_upto WHERE upto > floor(total * 0.8) GROUP BY 1)
"""
BY_TICKER_ROWS = r"""
SELECT date, ticker, fit_id::INTEGER AS fit_id, state, bucket, round(ll_model, 6) AS ll_model, round(ll_base, 6) AS ll_base, round(brier_model, 6) AS brier_model, round(brier_base, 6) AS brier_base,
  round(p_up_model, 6) AS p_up_model, round(p_up_base, 6) AS p_up_base, went_up, round(ev_model, 6) AS ev_model, round(ev_base, 6) AS ev_base, round(realized, 6) AS realized,
  CASE WHEN date < cut THEN 'dev' ELSE 'holdout' END AS period FROM t_losses JOIN t_cut USING (ticker)
"""

# The cards' tickers, their own models, transitions and walk-forwards.
OWN = r"""
, own_good AS (SELECT ticker FROM feat GROUP BY 1 HAVING count(*) FILTER (state IS NOT NULL AND fwd_ret IS NOT NULL) >= 100 AND arg_max(state IS NOT NULL, date)),
own_feat AS (SELECT * FROM feat SEMI JOIN own_good USING (ticker)),
own_usable AS (SELECT * FROM usable SEMI JOIN own_good USING (ticker)),
o_cells AS (
  SELECT t.ticker, s.state, b.bucket, b.is_up, count(u.date) AS n, coalesce(sum(u.fwd_ret), 0) AS sum_r, coalesce(sum(u.fwd_ret * u.fwd_ret), 0) AS sum_r2
  FROM own_good t CROSS JOIN states s CROSS JOIN buckets b LEFT JOIN own_usable u ON u.ticker = t.ticker AND u.state = s.state AND u.bucket = b.bucket GROUP BY ALL),
o_summed AS (
  SELECT *, sum(n) OVER (PARTITION BY ticker, bucket) AS n_bucket, sum(n) OVER (PARTITION BY ticker, state) AS n_state, sum(n) OVER (PARTITION BY ticker) AS n_all,
    sum(sum_r) OVER (PARTITION BY ticker, bucket) AS r_bucket, sum(sum_r2) OVER (PARTITION BY ticker, bucket) AS r2_bucket FROM o_cells),
o_base AS (
  SELECT *, n_bucket / n_all AS q, coalesce(r_bucket / nullif(n_bucket, 0), 0) AS m_bucket, coalesce(r2_bucket / nullif(n_bucket, 0), 0) AS m2_bucket, n_state / 21 AS n_eff, n_state / 21 / (n_state / 21 + 20) AS w FROM o_summed),
o_model AS (
  SELECT *, w * coalesce(n / nullif(n_state, 0), q) + (1 - w) * q AS p, w * coalesce(sum_r / nullif(n, 0), m_bucket) + (1 - w) * m_bucket AS m,
    w * coalesce(sum_r2 / nullif(n, 0), m2_bucket) + (1 - w) * m2_bucket AS m2 FROM o_base),
o_moments AS (
  SELECT ticker, state, max(n_state)::BIGINT AS n_rows, max(n_eff) AS n_eff, max(w) AS w, sum(CASE WHEN is_up THEN p ELSE 0 END) AS p_up, sum(CASE WHEN is_up THEN q ELSE 0 END) AS p_up_base,
    sum(p * m) AS ev, sum(q * m_bucket) AS ev_base, greatest(sum(p * m2) - sum(p * m) * sum(p * m), 1e-12) AS variance FROM o_model GROUP BY 1, 2),
o_pairs AS (SELECT ticker, state AS f, lead(state, 21) OVER (PARTITION BY ticker ORDER BY date) AS t FROM own_usable),
o_moves AS (
  SELECT ticker, from_state, to_state, n, rows / 21 / (rows / 21 + 20) * coalesce(n / nullif(rows, 0), share) + (1 - rows / 21 / (rows / 21 + 20)) * share AS p FROM (
    SELECT *, sum(n) OVER (PARTITION BY ticker, from_state) AS rows, coalesce(sum(n) OVER (PARTITION BY ticker, to_state) / nullif(sum(n) OVER (PARTITION BY ticker), 0), 0.125) AS share FROM (
      SELECT g.ticker, a.state AS from_state, b.state AS to_state, count(p.f) AS n FROM own_good g CROSS JOIN states a CROSS JOIN states b
      LEFT JOIN o_pairs p ON p.ticker = g.ticker AND p.f = a.state AND p.t = b.state GROUP BY 1, 2, 3)))
"""
CARD = r"""
, o_scored AS (SELECT * FROM t_losses JOIN t_cut USING (ticker) WHERE date < cut),
o_units AS (SELECT ticker, date, sum(ll_base - ll_model) AS s, count(*) AS n FROM o_scored GROUP BY 1, 2),
o_blocks AS (
  SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS start, sum(s) OVER w AS s, sum(n) OVER w AS n, count(*) OVER (PARTITION BY ticker) AS units
  FROM o_units WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING)),
o_sizes AS (SELECT DISTINCT ticker, units, units - 20 AS starts, ceil(units / 21)::BIGINT AS blocks FROM o_blocks WHERE units >= 42),
o_picks AS (
  SELECT ticker, d.range AS draw, ('0x' || substr(md5('0:' || d.range || ':' || j.range), 1, 12))::BIGINT % starts AS start
  FROM o_sizes, range(2000) d, range(1000) j WHERE j.range < blocks),
o_ci AS (SELECT ticker, quantile_cont(mean, 0.05) AS lo, quantile_cont(mean, 0.95) AS hi FROM (SELECT ticker, draw, sum(s) / sum(n) AS mean FROM o_picks JOIN o_blocks USING (ticker, start) GROUP BY 1, 2) GROUP BY 1),
o_verdicts AS (
  SELECT s.*, c.lo, c.hi FROM (
    SELECT ticker, count(*) AS own_rows, avg(ll_base - ll_model) AS gain, avg(((round(p_up_model, 9) > 0.5) = went_up)::INTEGER) AS hit, avg(((round(p_up_base, 9) > 0.5) = went_up)::INTEGER) AS hit_base
    FROM o_scored GROUP BY 1) s LEFT JOIN o_ci c USING (ticker)),
look AS (
  SELECT * FROM (SELECT ticker, close, close / lag(close, 1) OVER w - 1 AS c1, close / lag(close, 21) OVER w - 1 AS c21, close / lag(close, 252) OVER w - 1 AS c252,
    row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE k = 1),
vols AS (
  SELECT ticker, stddev_samp(r) * sqrt(252) AS vol FROM (
    SELECT ticker, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM prices) WHERE k <= 252 GROUP BY 1),
recent AS (SELECT ticker, count(*) AS n_days, min(close) AS low, max(close) AS high, min(date) AS first FROM ranked WHERE k <= 756 GROUP BY 1)
SELECT l.ticker, l.date, k.close, l.state, l.stock_momentum, l.sector_momentum, l.vix_regime, round(c1, 6) AS change_1, round(c21, 6) AS change_21, round(c252, 6) AS change_252, round(vol, 6) AS vol,
  n_days, low, high,
  m.n_rows AS pooled_n_rows, round(m.n_eff, 1) AS pooled_independent_obs, round(m.w, 3) AS pooled_weight_on_state, round(m.p_up, 6) AS pooled_p_up, round(m.p_up_base, 6) AS pooled_p_up_base, round(m.ev, 6) AS pooled_ev, round(sqrt(m.variance), 6) AS pooled_std,
  o.n_rows AS own_n_rows, round(o.n_eff, 1) AS own_independent_obs, round(o.w, 3) AS own_weight_on_state, round(o.p_up, 6) AS own_p_up, round(o.p_up_base, 6) AS own_p_up_base, round(o.ev, 6) AS own_ev, round(sqrt(o.variance), 6) AS own_std,
  v.own_rows, round(v.gain, 6) AS own_gain, round(v.lo, 6) AS own_lo, round(v.hi, 6) AS own_hi, round(v.hit, 6) AS own_hit, round(v.hit_base, 6) AS own_hit_base,
  CASE WHEN v.ticker IS NOT NULL THEN CASE WHEN lo IS NULL OR hi IS NULL THEN 'too little data' WHEN lo > 0 THEN 'better than baseline' WHEN hi < 0 THEN 'worse than baseline' ELSE 'indistinguishable from baseline' END ELSE 'too little history for a walk-forward of its own' END AS own_verdict,
  r.first AS history_first, round((SELECT sum(p_up) FROM o_moments x WHERE x.ticker = l.ticker), 6) AS own_p_up_sum, (SELECT sum(n) FROM o_moves x WHERE x.ticker = l.ticker)::DOUBLE AS transitions_n,
  round((SELECT sum(p) FROM o_moves x WHERE x.ticker = l.ticker AND from_state = to_state), 6) AS p_stay_sum, round((SELECT sum(round(l.close * hi, 2)) FROM buckets WHERE bucket > 3), 2) AS dollars_up_sum
FROM latest l SEMI JOIN own_good USING (ticker) JOIN moments m USING (state) JOIN o_moments o ON o.ticker = l.ticker AND o.state = l.state JOIN look k ON k.ticker = l.ticker JOIN vols ON vols.ticker = l.ticker
JOIN recent r ON r.ticker = l.ticker LEFT JOIN o_verdicts v ON v.ticker = l.ticker
"""
_by_ticker = lambda feat, usable, days: BY_TICKER.format(feat=feat, usable=usable, days=days)
_said = "round(n_eff, 1) AS independent_obs, round(w, 3) AS weight_on_state, round(p_up, 6) AS p_up, round(p_up_base, 6) AS p_up_base, round(ev, 6) AS ev, round(ev_base, 6) AS ev_base, round(sqrt(variance), 6) AS std, round(ev / sqrt(variance), 6) AS ev_over_std"
_kelly = "round(ev / variance, 6) AS kelly_full, round(ev / variance / 2, 6) AS kelly_half"
SELECTS["ticker_models"] = f"{OWN} SELECT ticker, state, n_rows, {_said} FROM o_moments"
SELECTS["card_buckets"] = f"""{OWN} SELECT l.ticker, 'pooled' AS side, m.bucket, round(m.p, 6) AS p, round(m.q, 6) AS q, round(m.m, 6) AS mean FROM latest l SEMI JOIN own_good USING (ticker) JOIN model m USING (state)
    UNION ALL SELECT l.ticker, 'own', m.bucket, round(m.p, 6), round(m.q, 6), round(m.m, 6) FROM latest l JOIN o_model m ON m.ticker = l.ticker AND m.state = l.state"""
_base = "sum(q * m_bucket) AS ev, greatest(sum(q * m2_bucket) - sum(q * m_bucket) * sum(q * m_bucket), 1e-12) AS variance"
SELECTS["baseline_moments"] = f"{OWN} SELECT ticker, round(ev, 6) AS ev_base, round(sqrt(variance), 6) AS std_base, round(ev / sqrt(variance), 6) AS ev_over_std_base FROM (SELECT ticker, {_base} FROM o_base WHERE state = 'Up/Up/HighVIX' GROUP BY 1)"
SELECTS["ticker_transitions"] = f"{OWN} SELECT ticker, from_state, to_state, n, round(p, 6) AS p FROM o_moves"
SELECTS["terminal_tickers"] = f"{OWN} SELECT ticker, count(*) AS n_rows FROM own_feat GROUP BY 1"
SELECTS["ticker_cards"] = f"{OWN}{_by_ticker('own_feat', 'own_usable', 1095)}{CARD}"
SELECTS["focal_prediction"] = f"SELECT l.ticker, l.date, l.state, n_rows, {_said}, {_kelly} FROM latest l JOIN moments m USING (state) WHERE ticker = (SELECT min(ticker) FROM meta WHERE fate = 'active')"
SELECTS["sparse_fit_cells"] = _by_ticker("feat", "usable", 365) + """SELECT ticker, train_fit::INTEGER AS fit_id, state, sum(count(*)) OVER w AS n, round(sum(sum(fwd_ret)) OVER w, 6) AS sum_r
    FROM t_rows WHERE train_fit IS NOT NULL GROUP BY ticker, train_fit, state WINDOW w AS (PARTITION BY ticker, state ORDER BY train_fit)"""
SELECTS["walk_forward_by_ticker"] = _by_ticker("feat", "usable", 365) + BY_TICKER_ROWS

SQL = {name: f"{STEPS}\n{select}" for name, select in SELECTS.items()}
# The pool without the outsider, and the outsider's own rows.
_pool = STEPS.replace("usable AS (SELECT * FROM bucketed WHERE state", "usable AS (SELECT * FROM bucketed WHERE ticker <> 'S00003' AND state").replace("count(*) AS n FROM feat GROUP BY 1)", "count(*) AS n FROM feat WHERE ticker <> 'S00003' GROUP BY 1)")
SQL["outside_prediction"] = f"{_pool}\nSELECT l.ticker, l.date, l.state, n_rows, {_said}, {_kelly} FROM latest l JOIN moments m USING (state) WHERE ticker = 'S00003'"
