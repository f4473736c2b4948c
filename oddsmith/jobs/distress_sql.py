"""SQL (DuckDB) with the same meaning as the filing and distress queries."""

STEPS = r"""
WITH filed AS (
  SELECT o_orderkey AS order_key, o_custkey AS cik, o_orderdate::DATE AS filing_date, extract(year FROM o_orderdate)::INTEGER AS year,
    CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN 'DEFM14A' WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0 THEN '10-Q'
      WHEN o_orderkey % 3 = 0 THEN '8-K/A' ELSE '8-K' END AS form,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderkey % 2 = 0 THEN '1.03,9.01' WHEN o_orderkey % 7 = 0 THEN '2.01,1.03' ELSE '1.03' END ELSE '8.01,9.01' END AS item,
    o_orderstatus AS status, o_orderpriority AS priority, o_totalprice::DECIMAL(18,2) AS total FROM orders),
cy AS (
  SELECT cik, year, min(filing_date) AS first_date, 200 * sum(total)::DOUBLE AS assets, 200 * coalesce(sum(total) FILTER (status <> 'F'), 0)::DOUBLE AS liabilities,
    200 * (coalesce(sum(total) FILTER (status = 'F'), 0) - 50000)::DOUBLE AS equity, 60 * coalesce(sum(total) FILTER (priority IN ('1-URGENT', '2-HIGH')), 0)::DOUBLE AS cash,
    160 * sum(total)::DOUBLE AS revenue, 20 * sum(CASE status WHEN 'F' THEN total WHEN 'O' THEN -total END)::DOUBLE AS net_income,
    100 * sum(CASE WHEN order_key % 2 = 0 THEN total ELSE -total END)::DOUBLE AS ocf, 80 * sum(total)::DOUBLE AS current_assets,
    100 * (sum(total) FILTER (status = 'P'))::DOUBLE AS current_liabilities, max((priority = '1-URGENT' AND status = 'F')::INTEGER) AS going_concern
  FROM filed GROUP BY 1, 2),
survived AS (
  SELECT c.*, EXISTS (SELECT 1 FROM cy d WHERE d.cik = c.cik AND d.year IN (c.year + 2, c.year + 3)) AS files_on, c.year + 2 < 2002 AND c.year + 2 IN (SELECT year FROM cy) AS known FROM cy c WHERE assets > 0),
gone AS (SELECT cik, year, first_date FROM survived WHERE NOT files_on AND known),
exits AS (
  SELECT g.cik, g.year, CASE WHEN coalesce(bool_or(f.form LIKE '8-K%' AND f.item LIKE '%1.03%'), false) THEN 'bankrupt' WHEN coalesce(bool_or(f.form = 'DEFM14A'), false) THEN 'acquired' ELSE 'deregistered' END AS exit
  FROM gone g LEFT JOIN filed f ON f.cik = g.cik AND f.filing_date >= g.first_date GROUP BY 1, 2),
panel AS (
  SELECT s.cik, s.year, first_date, assets, liabilities, equity, cash, revenue, net_income, ocf, current_assets, current_liabilities, going_concern,
    coalesce(c.c_name, '') AS name, coalesce('S' || lpad(c.c_custkey::VARCHAR, 5, '0'), '') AS ticker, CASE WHEN files_on OR NOT known THEN 'filing' ELSE e.exit END AS outcome, known AS outcome_known
  FROM survived s LEFT JOIN exits e USING (cik, year) LEFT JOIN customer c ON c.c_custkey = s.cik),
eligible AS (
  SELECT * REPLACE (coalesce(going_concern, 0) AS going_concern), greatest(assets, 1.0) AS a, greatest(-ocf, 0) AS burn FROM panel
  WHERE assets IS NOT NULL AND liabilities IS NOT NULL AND cash IS NOT NULL AND ocf IS NOT NULL),
ratios AS (
  SELECT *, log10(a) AS log_assets, liabilities / a AS leverage, cash / a AS cash_ratio, net_income / a AS roa, ocf / a AS ocf_assets,
    current_assets / greatest(current_liabilities, 1.0) AS cr, CASE WHEN current_liabilities IS NOT NULL THEN current_assets / greatest(current_liabilities, 1.0) END AS current_ratio,
    CASE WHEN burn > 0 THEN cash / (burn + 1e-9) ELSE 'infinity'::DOUBLE END AS runway_years FROM eligible),
feats AS (
  SELECT *, ocf < 0 AS is_burning, coalesce(runway_years < 1, false) AS is_short_runway, coalesce(equity < 0, false) AS is_neg_equity, leverage > 0.8 AS is_high_leverage,
    going_concern = 1 AS is_going_concern, assets < 50e6 AS is_micro, coalesce(net_income < 0, false) AS is_loss,
    CASE WHEN ocf < 0 THEN 'Burning' ELSE 'CashPositive' END || '/' || CASE WHEN runway_years < 1 THEN 'Runway<1y' ELSE 'Runway>1y' END || '/' ||
    CASE WHEN equity < 0 THEN 'NegEquity' ELSE 'PosEquity' END || '/' || CASE WHEN going_concern = 1 THEN 'GoingConcern' ELSE 'NoGC' END AS state FROM ratios),
known AS (SELECT * FROM feats WHERE outcome_known),
states AS (
  SELECT a || '/' || b || '/' || c || '/' || d AS state FROM (VALUES ('Burning'), ('CashPositive')) x(a), (VALUES ('Runway<1y'), ('Runway>1y')) y(b),
    (VALUES ('NegEquity'), ('PosEquity')) z(c), (VALUES ('GoingConcern'), ('NoGC')) u(d)),
outcomes(outcome, is_bad) AS (VALUES ('filing', false), ('acquired', false), ('bankrupt', true), ('deregistered', true)),
cells AS (SELECT s.state, o.outcome, o.is_bad, count(k.cik) AS n FROM states s CROSS JOIN outcomes o LEFT JOIN known k ON k.state = s.state AND k.outcome = o.outcome GROUP BY 1, 2, 3),
summed AS (SELECT *, sum(n) OVER (PARTITION BY state) AS n_state, sum(n) OVER (PARTITION BY outcome) / sum(n) OVER () AS q FROM cells),
model AS (SELECT *, n_state / (n_state + 20) AS w, n_state / (n_state + 20) * coalesce(n / nullif(n_state, 0), q) + (1 - n_state / (n_state + 20)) * q AS p FROM summed),
final AS (SELECT state, sum(p) FILTER (is_bad) AS p_bad, max(n_state)::BIGINT AS n_rows FROM model GROUP BY 1),
years AS (SELECT DISTINCT year FROM known),
folds AS (SELECT f.year AS fold FROM years f JOIN years t ON t.year <= f.year - 2 GROUP BY 1 HAVING count(*) >= 1),
fold_cells AS (
  SELECT f.fold, s.state, o.outcome, o.is_bad, count(k.cik) AS n FROM folds f CROSS JOIN states s CROSS JOIN outcomes o
  LEFT JOIN known k ON k.state = s.state AND k.outcome = o.outcome AND k.year <= f.fold - 2 GROUP BY 1, 2, 3, 4),
fold_summed AS (
  SELECT *, sum(n) OVER (PARTITION BY fold, state) AS n_state, sum(n) OVER (PARTITION BY fold, outcome) / sum(n) OVER (PARTITION BY fold) AS q FROM fold_cells),
fold_model AS (SELECT *, n_state / (n_state + 20) * coalesce(n / nullif(n_state, 0), q) + (1 - n_state / (n_state + 20)) * q AS p FROM fold_summed),
fold_states AS (SELECT fold, state, sum(p) FILTER (is_bad) AS p_bad_state, sum(q) FILTER (is_bad) AS p_bad_base FROM fold_model GROUP BY 1, 2),
scored AS (
  SELECT k.cik, k.year, k.state, k.outcome, -ln(greatest(m.p, 1e-12)) AS ll_state, -ln(greatest(m.q, 1e-12)) AS ll_base, s.p_bad_state, s.p_bad_base, m.is_bad::INTEGER AS y_bad
  FROM known k JOIN fold_model m ON m.fold = k.year AND m.state = k.state AND m.outcome = k.outcome JOIN fold_states s ON s.fold = k.year AND s.state = k.state),
by_score AS (SELECT year, p_bad_state AS score, sum(y_bad) AS pos, sum(1 - y_bad) AS neg FROM scored GROUP BY 1, 2),
all_scores AS (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM by_score GROUP BY 1),
won_year AS (SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY year ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS won FROM by_score),
won_all AS (SELECT *, pos * (coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS won FROM all_scores),
units AS (SELECT row_number() OVER (ORDER BY year) - 1 AS start, sum(ll_base - ll_state) AS s, count(*) AS n FROM scored GROUP BY year),
size AS (SELECT count(*) AS units FROM units),
picks AS (SELECT d.range AS draw, ('0x' || substr(md5('0:' || d.range || ':' || j.range), 1, 12))::BIGINT % units AS start FROM size, range(2000) d, range(1000) j WHERE j.range < units AND units >= 2),
means AS (SELECT draw, sum(s) / sum(n) AS mean FROM picks JOIN units USING (start) GROUP BY 1),
ci AS (SELECT quantile_cont(mean, 0.05) AS lo, quantile_cont(mean, 0.95) AS hi FROM means),
indexed AS (
  SELECT o_custkey AS cik, o_orderdate::DATE AS filing_date, 'edgar/data/' || o_custkey || '/' || lpad(o_orderkey::VARCHAR, 12, '0') || '.txt' AS file, 'HOLDINGS ' || o_custkey || ' INC' AS name,
    CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-K405' WHEN '3-MEDIUM' THEN '10-KSB' END AS form FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_orderkey % 11 <> 0)
"""

SELECTS = {
    "filing_index_parse": "SELECT form, name, cik, filing_date, file FROM indexed",
    "cohort_first_filing": "SELECT cik, year, name, filing_date FROM (SELECT *, extract(year FROM filing_date)::INTEGER AS year, row_number() OVER (PARTITION BY cik, extract(year FROM filing_date) ORDER BY filing_date, file) AS k FROM indexed) WHERE k = 1",
    "index_line_numbers": """SELECT form, name, cik, filing_date, file, extract(year FROM filing_date)::INTEGER AS year, extract(quarter FROM filing_date)::INTEGER AS quarter, line_no FROM indexed
        JOIN (SELECT lpad(o_orderkey::VARCHAR, 12, '0') || '.txt' AS last, row_number() OVER (PARTITION BY extract(year FROM o_orderdate::DATE), extract(quarter FROM o_orderdate::DATE) ORDER BY o_orderkey) AS line_no FROM orders)
        ON last = split_part(file, '/', 4)""",
    "index_order_cohorts": """SELECT cik, year, name, filing_date FROM (SELECT *, extract(year FROM filing_date)::INTEGER AS year,
        row_number() OVER (PARTITION BY cik, extract(year FROM filing_date) ORDER BY extract(quarter FROM filing_date), file) AS k FROM indexed) WHERE k = 1""",
    "landed_submissions": "SELECT cik, form, filing_date, CASE WHEN cik % 4 = 0 THEN '' ELSE item END AS item FROM filed WHERE cik % 97 <> 0",
    "landed_rejects": """SELECT '{"cik":' AS head, count(DISTINCT cik) AS n FROM filed WHERE cik % 97 = 0 HAVING count(*) > 0""",
    "submissions_explode": "SELECT cik, form, filing_date, CASE WHEN cik % 4 = 0 THEN '' ELSE item END AS item FROM filed",
    "hit_ciks": "SELECT DISTINCT cik FROM filed WHERE priority = '1-URGENT'",
    "ticker_map": "SELECT c_custkey AS cik, 'S' || lpad(c_custkey::VARCHAR, 5, '0') AS ticker FROM customer",
    "concept_fallback": """SELECT cik, year - 1 AS fy, assets, CASE WHEN cik % 5 = 0 THEN NULL ELSE cash END AS cash, CASE WHEN cik % 3 = 0 THEN revenue / 2 ELSE revenue END AS revenue, net_income FROM cy""",
    "cohort_exits": "SELECT cik, year, files_on FROM survived",
    "exit_classify": "SELECT cik, year, exit FROM exits",
    "panel_build": "SELECT cik, year, first_date, assets, liabilities, equity, cash, revenue, net_income, ocf, current_assets, current_liabilities, going_concern, name, ticker, outcome, outcome_known FROM panel",
    "panel_meta": "SELECT count(*) AS n_rows, count(DISTINCT cik) AS companies, min(year) AS first_year, max(year) AS last_year FROM panel",
    "text_flag": "SELECT DISTINCT source, lang FROM documents WHERE contains(lower(text), 'licensed under') AND contains(lower(text), 'version')",
    "outcome_counts": "SELECT outcome, count(*) AS n FROM panel WHERE outcome_known GROUP BY 1",
    "outcome_pullback": """SELECT cik, year, CASE WHEN outcome = 'filing' AND ny = year + 1 AND nxt IN ('bankrupt', 'deregistered', 'acquired') THEN nxt ELSE outcome END AS label FROM (
        SELECT cik, year, outcome, lead(outcome) OVER w AS nxt, lead(year) OVER w AS ny FROM panel WINDOW w AS (PARTITION BY cik ORDER BY year))""",
    "distress_ratios": """SELECT cik, year, round(log_assets, 6) AS log_assets, round(leverage, 6) AS leverage, round(cash_ratio, 6) AS cash_ratio, round(roa, 6) AS roa, round(ocf_assets, 6) AS ocf_assets,
        round(current_ratio, 6) AS current_ratio, CASE WHEN isinf(runway_years) THEN NULL ELSE round(runway_years, 6) END AS runway_years FROM ratios""",
    "distress_factors": "SELECT cik, year, is_burning, is_short_runway, is_neg_equity, is_high_leverage, is_going_concern, is_micro, is_loss FROM feats",
    "distress_state": "SELECT cik, year, state FROM feats",
    "distress_state_model": "SELECT state, outcome, n, round(w, 6) AS w, round(q, 6) AS q, round(p, 6) AS p FROM model",
    "distress_state_table": "SELECT state, n_rows, round(p_bad, 6) AS p_bad FROM final",
    "distress_transitions": """SELECT from_state, to_state, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY from_state), 0), 0), 6) AS p FROM (
        SELECT s.state AS from_state, t.state AS to_state, count(p.f) AS n FROM states s CROSS JOIN (SELECT state FROM states UNION ALL SELECT 'exited') t LEFT JOIN (
          SELECT a.state AS f, coalesce(b.state, CASE WHEN a.outcome_known AND a.outcome <> 'filing' THEN 'exited' END) AS t FROM feats a LEFT JOIN feats b ON b.cik = a.cik AND b.year = a.year + 1) p
        ON p.f = s.state AND p.t = t.state GROUP BY 1, 2)""",
    "distress_walk_forward": "SELECT cik, year, state, outcome, round(ll_state, 6) AS ll_state, round(ll_base, 6) AS ll_base, round(p_bad_state, 6) AS p_bad_state, round(p_bad_base, 6) AS p_bad_base, y_bad FROM scored",
    "distress_by_year": """SELECT s.year, n, round(bad_rate, 6) AS bad_rate, round(auc, 6) AS auc_state FROM (SELECT year, count(*) AS n, avg(y_bad) AS bad_rate FROM scored GROUP BY 1) s
        JOIN (SELECT year, sum(won) / nullif(sum(pos) * sum(neg), 0) AS auc FROM won_year GROUP BY 1) a USING (year)""",
    "distress_rollup": "SELECT year, count(*) AS n, round(avg(ll_state), 6) AS logloss_state, round(avg(ll_base), 6) AS logloss_base, round(avg(ll_base - ll_state), 6) AS logloss_gain, round(avg(y_bad), 6) AS bad_rate FROM scored GROUP BY ROLLUP (year)",
    "auc_overall": "SELECT sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, round(sum(won) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM won_all",
    "auc_by_year": "SELECT year, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, round(sum(won) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM won_year GROUP BY 1",
    "cohort_bootstrap": "SELECT round(lo, 6) AS lo, round(hi, 6) AS hi FROM ci",
    "distress_verdict": "SELECT CASE WHEN lo IS NULL OR hi IS NULL THEN 'too little data' WHEN lo > 0 THEN 'better than baseline' WHEN hi < 0 THEN 'worse than baseline' ELSE 'indistinguishable from baseline' END AS verdict FROM ci",
    "distress_calibration": """SELECT bin::INTEGER AS bin, round(avg(p), 6) AS predicted, round(avg(y_bad), 6) AS realized, count(*) AS rows FROM (
        SELECT *, CASE WHEN p <= e[2] THEN 0 WHEN p <= e[3] THEN 1 WHEN p <= e[4] THEN 2 WHEN p <= e[5] THEN 3 ELSE 4 END AS bin
        FROM (SELECT round(p_bad_state, 9) AS p, y_bad FROM scored), (SELECT quantile_cont(round(p_bad_state, 9), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM scored)) GROUP BY 1""",
    "latest_cohort_scores": "SELECT f.cik, f.name, f.year, f.state, round(m.p_bad, 6) AS p_bad FROM feats f JOIN final m USING (state) WHERE f.year = (SELECT max(year) FROM feats)",
    "worst_companies": "SELECT f.cik, f.name, f.state, round(m.p_bad, 6) AS p_bad FROM feats f JOIN final m USING (state) WHERE f.year = (SELECT max(year) FROM feats) ORDER BY round(m.p_bad, 6) DESC, f.cik LIMIT 5",
    "ticker_distress_join": """SELECT t.ticker, d.cik, round(d.p_bad, 6) AS p_bad FROM (SELECT DISTINCT 'S' || lpad(l_suppkey::VARCHAR, 5, '0') AS ticker FROM lineitem) t LEFT JOIN (
        SELECT f.ticker, max(f.cik) AS cik, arg_max(m.p_bad, f.cik) AS p_bad FROM feats f JOIN final m USING (state) WHERE f.year = (SELECT max(year) FROM feats) AND f.ticker <> '' GROUP BY 1) d USING (ticker)""",
}

# The logistic model: Newton's steps as a recursive table; each step solves its system by elimination.
_COLUMNS = ("log_assets", "leverage", "cash_ratio", "roa", "ocf_assets", "current_ratio", "going_concern")
_N = len(_COLUMNS) + 1
_stat = lambda f: "[" + ", ".join(f"{f}(x[{k}])" for k in range(1, _N)) + "]"
_design = "[1.0, " + ", ".join(f"greatest(-5.0, least(5.0, (x[{k}] - mu[{k}]) / sd[{k}]))" for k in range(1, _N)) + "]"
_dot = " + ".join(f"w[{k}] * z[{k}]" for k in range(1, _N + 1))
_row = lambda i: "[" + ", ".join([*(f"sum(p * (1 - p) * z[{i}] * z[{j}]){' + 1' if i == j > 1 else ''}" for j in range(1, _N + 1)), f"sum((p - y) * z[{i}]){f' + any_value(w[{i}])' if i > 1 else ''}"]) + "]"
_solved = f"SELECT fold, step, any_value(w) AS w, [{', '.join(_row(i) for i in range(1, _N + 1))}] AS m FROM (SELECT n.fold, n.step, n.w, z, y, 1 / (1 + exp(-({_dot}))) AS p FROM newton n JOIN design d ON d.fold = n.fold WHERE n.step < 15) GROUP BY fold, step"
for _k in range(1, _N + 1):
    _solved = f"SELECT fold, step, w, list_transform(m, lambda r, i: CASE WHEN i = {_k} THEN list_transform(r, lambda v: v / r[{_k}]) ELSE list_transform(r, lambda v, j: v - r[{_k}] * m[{_k}][j] / m[{_k}][{_k}]) END) AS m FROM ({_solved})"
LOGIT = f"""
, inputs AS (SELECT cik, year, outcome_known, (outcome IN ('bankrupt', 'deregistered'))::DOUBLE AS y, [{', '.join(f'coalesce({c}, 0)::DOUBLE' for c in _COLUMNS)}] AS x FROM feats),
spans AS (SELECT fold, fold - 2 AS last FROM folds UNION ALL SELECT 0, 9999),
stats AS (SELECT fold, {_stat('avg')} AS mu, list_transform({_stat('stddev_pop')}, lambda s: s + 1e-9) AS sd FROM spans JOIN inputs ON year <= last WHERE outcome_known GROUP BY fold),
design AS (SELECT fold, y, {_design} AS z FROM stats JOIN spans USING (fold) JOIN inputs ON year <= last WHERE outcome_known),
newton AS (
  SELECT fold, 0 AS step, list_transform(range({_N}), lambda i: 0.0::DOUBLE) AS w FROM stats
  UNION ALL
  SELECT fold, step + 1, list_transform(w, lambda v, i: v - m[i][{_N + 1}]) FROM ({_solved})),
fitted AS (SELECT fold, w, mu, sd FROM newton JOIN stats USING (fold) WHERE step = 15),
logit AS (SELECT cik, year, fold, 1 / (1 + exp(-({_dot}))) AS p_bad_logit FROM (
  SELECT cik, year, fold, w, {_design} AS z FROM inputs JOIN fitted ON (fold = year AND outcome_known) OR (fold = 0 AND year = (SELECT max(year) FROM feats)))),
both_ AS (SELECT s.*, l.p_bad_logit FROM scored s JOIN logit l ON l.fold = s.year AND l.cik = s.cik AND l.year = s.year),
l_score AS (SELECT year, p_bad_logit AS score, sum(y_bad) AS pos, sum(1 - y_bad) AS neg FROM both_ GROUP BY 1, 2),
l_all AS (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM l_score GROUP BY 1),
l_won_year AS (SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY year ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS won FROM l_score),
l_won AS (SELECT *, pos * (coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS won FROM l_all)
"""
_auc = "sum(won) / nullif(sum(pos) * sum(neg), 0)"
_terms = "[" + ", ".join(f"'{c}'" for c in ("intercept", *_COLUMNS)) + "]"
WITH_LOGIT = {
    "logit_scores": "SELECT cik, year, round(p_bad_logit, 6) AS p_bad_logit FROM logit WHERE fold = year",
    "logit_weights": f"SELECT unnest({_terms}) AS term, round(unnest(w), 6) AS weight FROM fitted WHERE fold = 0",
    "distress_walk_forward": SELECTS.pop("distress_walk_forward").replace("p_bad_base, y_bad FROM scored", "p_bad_base, round(p_bad_logit, 6) AS p_bad_logit, y_bad FROM both_"),
    "distress_by_year": f"""SELECT s.year, n, round(bad_rate, 6) AS bad_rate, round(a.auc, 6) AS auc_state, round(b.auc, 6) AS auc_logit FROM (SELECT year, count(*) AS n, avg(y_bad) AS bad_rate FROM scored GROUP BY 1) s
        JOIN (SELECT year, {_auc} AS auc FROM won_year GROUP BY 1) a USING (year) JOIN (SELECT year, {_auc} AS auc FROM l_won_year GROUP BY 1) b USING (year)""",
    "distress_summary": f"""SELECT count(*) AS n, round(avg(ll_state), 6) AS logloss_state, round(avg(ll_base), 6) AS logloss_base, round(avg(y_bad), 6) AS bad_rate,
        round((SELECT {_auc} FROM won_all), 6) AS auc_state, round((SELECT {_auc} FROM l_won), 6) AS auc_logit FROM scored""",
    "latest_cohort_scores": """SELECT f.cik, f.name, f.year, f.state, round(m.p_bad, 6) AS p_bad, round(p_filing, 6) AS p_filing, round(p_acquired, 6) AS p_acquired, round(p_bankrupt, 6) AS p_bankrupt,
        round(p_deregistered, 6) AS p_deregistered, round(l.p_bad_logit, 6) AS p_bad_logit FROM feats f JOIN final m USING (state) JOIN (
          SELECT state, max(p) FILTER (outcome = 'filing') AS p_filing, max(p) FILTER (outcome = 'acquired') AS p_acquired, max(p) FILTER (outcome = 'bankrupt') AS p_bankrupt,
            max(p) FILTER (outcome = 'deregistered') AS p_deregistered FROM model GROUP BY 1) o USING (state)
        JOIN logit l ON l.fold = 0 AND l.cik = f.cik AND l.year = f.year WHERE f.year = (SELECT max(year) FROM feats)""",
}
SELECTS.pop("distress_by_year"), SELECTS.pop("latest_cohort_scores")
SELECTS["informative_factors"] = "SELECT factor, factor <> 'going_concern' OR (SELECT count(going_concern) FROM panel) > 0 AS used FROM (VALUES ('burning'), ('short_runway'), ('neg_equity'), ('going_concern')) v(factor)"
SELECTS["landed_panel"] = """SELECT * FROM (WITH co AS (
    SELECT cik, year, name, filing_date AS first_date FROM (SELECT *, extract(year FROM filing_date)::INTEGER AS year, row_number() OVER (PARTITION BY cik, extract(year FROM filing_date) ORDER BY extract(quarter FROM filing_date), file) AS k FROM indexed) WHERE k = 1),
  ro AS (
    SELECT o.cik, o.year, o.name, o.first_date, assets, liabilities, equity, CASE WHEN o.cik % 5 <> 0 THEN cash END AS cash, CASE WHEN o.cik % 3 = 0 THEN revenue / 2 ELSE revenue END AS revenue, net_income, ocf,
      current_assets, current_liabilities, EXISTS (SELECT 1 FROM co e WHERE e.cik = o.cik AND e.year IN (o.year + 2, o.year + 3)) AS files_on, o.year + 2 < 2002 AND o.year + 2 IN (SELECT year FROM co) AS known,
      EXISTS (SELECT 1 FROM filed f WHERE f.cik = o.cik AND f.year = o.year AND f.priority = '1-URGENT')::INTEGER AS going_concern
    FROM co o JOIN cy USING (cik, year) WHERE assets > 0),
  ex AS (
    SELECT g.cik, g.year, CASE WHEN coalesce(bool_or(f.form LIKE '8-K%' AND f.item LIKE '%1.03%'), false) THEN 'bankrupt' WHEN coalesce(bool_or(f.form = 'DEFM14A'), false) THEN 'acquired' ELSE 'deregistered' END AS exit
    FROM ro g LEFT JOIN filed f ON f.cik = g.cik AND f.filing_date >= g.first_date WHERE NOT files_on AND known GROUP BY 1, 2)
  SELECT r.cik, r.year, name, first_date, assets, liabilities, equity, cash, revenue, net_income, ocf, current_assets, current_liabilities, going_concern,
    coalesce('S' || lpad(c.c_custkey::VARCHAR, 5, '0'), '') AS ticker, known AS outcome_known, CASE WHEN files_on OR NOT known THEN 'filing' ELSE e.exit END AS outcome
  FROM ro r LEFT JOIN ex e USING (cik, year) LEFT JOIN customer c ON c.c_custkey = r.cik)"""

SQL = {name: f"{STEPS}\n{select}" for name, select in SELECTS.items()}
SQL |= {name: f"{STEPS.replace('WITH filed', 'WITH RECURSIVE filed', 1)}{LOGIT}{select}" for name, select in WITH_LOGIT.items()}
