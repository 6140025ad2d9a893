"""DuckDB oracle SQL for every registered query with an exact check.

Tables are the pre-registered views of the benchmark parquet files.  Column
names equal the Spark outputs.
"""

import math

ORACLE = {}

ORACLE["outcome_crosstab_pct"] = """
WITH base AS (
  SELECT o.o_orderpriority, o.o_orderstatus, l.l_linestatus, c.c_mktsegment,
         CASE WHEN l.l_returnflag = 'R' THEN 'Avslag' ELSE 'Godkjent' END AS outcome
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey),
long AS (
  SELECT 'o_orderpriority' AS column_name, CAST(o_orderpriority AS VARCHAR) AS value, outcome FROM base
  UNION ALL SELECT 'o_orderstatus', CAST(o_orderstatus AS VARCHAR), outcome FROM base
  UNION ALL SELECT 'l_linestatus', CAST(l_linestatus AS VARCHAR), outcome FROM base
  UNION ALL SELECT 'c_mktsegment', CAST(c_mktsegment AS VARCHAR), outcome FROM base),
cnt AS (SELECT column_name, value, outcome, count(*) AS n FROM long
        WHERE value IS NOT NULL GROUP BY column_name, value, outcome)
SELECT column_name, value, outcome, n,
       round(100.0 * CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY column_name, value) AS DOUBLE), 1) AS pct
FROM cnt
"""

_LI = """
li AS (
  SELECT *,
    CASE WHEN l_returnflag = 'R' THEN 'Avslag' ELSE 'Godkjent' END AS truth,
    CASE WHEN l_discount >= 0.05 THEN 'Avslag' ELSE 'Godkjent' END AS pred,
    CASE WHEN (CASE WHEN l_returnflag = 'R' THEN 'Avslag' ELSE 'Godkjent' END)
            = (CASE WHEN l_discount >= 0.05 THEN 'Avslag' ELSE 'Godkjent' END)
         THEN 'correct' ELSE 'incorrect' END AS correct,
    CAST(year(l_shipdate) AS VARCHAR) AS ship_year
  FROM lineitem)"""

ORACLE["freq_by_outcome"] = f"""
WITH {_LI},
long AS (
  SELECT 'l_linestatus' AS column_name, CAST(l_linestatus AS VARCHAR) AS value, truth FROM li
  UNION ALL SELECT 'ship_year', ship_year, truth FROM li),
cnt AS (SELECT column_name, value, truth, count(*) AS n FROM long WHERE value IS NOT NULL
        GROUP BY ALL),
sh AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY column_name, truth) AS share FROM cnt)
SELECT column_name, value,
  round(coalesce(max(CASE WHEN truth = 'Avslag' THEN share END), 0.0), 6) AS "Avslag",
  round(coalesce(max(CASE WHEN truth = 'Godkjent' THEN share END), 0.0), 6) AS "Godkjent"
FROM sh GROUP BY column_name, value
"""


def _describe_sql(src: str, by: str, cols: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {by}, '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM {src}" for c in cols)
    return f"""
long AS ({parts})
SELECT {by}, column_name, count(value) AS count, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
  round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max
FROM long WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY {by}, column_name"""


def _text_sql(src: str, by: str, cols: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {by}, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {src}" for c in cols)
    return f"""
tlong AS ({parts}),
vc AS (SELECT {by}, column_name, value, count(*) AS n FROM tlong WHERE value IS NOT NULL GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY {by}, column_name ORDER BY n DESC, value) AS r FROM vc)
SELECT {by}, column_name, CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
  max(CASE WHEN r = 1 THEN value END) AS top, max(CASE WHEN r = 1 THEN n END) AS freq
FROM rk GROUP BY {by}, column_name"""


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

ORACLE["profile_numeric"] = f"WITH {_LI}, " + _describe_sql("li", "truth", _NUM)

ORACLE["profile_mixed"] = f"""
WITH {_LI}, num AS (WITH {_describe_sql('li', 'truth', ['l_quantity', 'l_extendedprice'])}),
txt AS (WITH {_text_sql('li', 'truth', ['l_linestatus', 'ship_year'])})
SELECT truth, column_name, count, mean, std, min, p25, p50, p75, max,
       NULL::DOUBLE AS "unique", NULL::VARCHAR AS top, NULL::DOUBLE AS freq FROM num
UNION ALL
SELECT truth, column_name, count, NULL, NULL, NULL, NULL, NULL, NULL, NULL, "unique", top, freq FROM txt
"""

_SUBSETS = f"""{_LI},
tagged AS (
  SELECT *, truth || '=' || pred AS subset FROM li
  UNION ALL SELECT *, 'Predikert ' || pred AS subset FROM li)"""

ORACLE["profile_by_confusion"] = f"""
WITH {_SUBSETS}, num AS (WITH {_describe_sql('tagged', 'subset', ['l_quantity', 'l_tax'])}),
txt AS (WITH {_text_sql('tagged', 'subset', ['l_linestatus'])})
SELECT subset, column_name, count, mean, std, min, p25, p50, p75, max,
       NULL::DOUBLE AS "unique", NULL::VARCHAR AS top, NULL::DOUBLE AS freq FROM num
UNION ALL
SELECT subset, column_name, count, NULL, NULL, NULL, NULL, NULL, NULL, NULL, "unique", top, freq FROM txt
"""

ORACLE["confusion_subset_counts"] = f"""
WITH {_SUBSETS}
SELECT subset, ship_year, count(*) AS n FROM tagged WHERE ship_year IS NOT NULL GROUP BY ALL
"""

ORACLE["cardinality_gate"] = """
WITH long AS (
  SELECT 'l_returnflag' AS column_name, CAST(l_returnflag AS VARCHAR) AS value FROM lineitem
  UNION ALL SELECT 'l_linestatus', CAST(l_linestatus AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_partkey', CAST(l_partkey AS VARCHAR) FROM lineitem)
SELECT column_name, count(DISTINCT value) AS n_distinct, count(DISTINCT value) <= 50 AS encode
FROM long WHERE value IS NOT NULL GROUP BY column_name
"""

ORACLE["encode_gate"] = """
WITH long AS (
  SELECT 'l_returnflag' AS column_name, CAST(l_returnflag AS VARCHAR) AS value FROM lineitem
  UNION ALL SELECT 'l_linestatus', CAST(l_linestatus AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_partkey', CAST(l_partkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_quantity', CAST(l_quantity AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'line', CASE WHEN l_linenumber % 7 = 0 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END FROM lineitem)
SELECT column_name, count(DISTINCT value) <= 50 AS encode FROM long WHERE value IS NOT NULL GROUP BY column_name
"""

_CORR_COLS = _NUM + ["l_returnflag_code", "l_linestatus_code"]  # and "constant", without correlations


def _corr_sql() -> str:
    from itertools import combinations
    sel = []
    for a, b in combinations(_CORR_COLS, 2):
        sel.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM enc")
        sel.append(f"SELECT '{b}', '{a}', round(corr({a}, {b}), 6) FROM enc")
    for c in _CORR_COLS:
        sel.append(f"SELECT '{c}', '{c}', CASE WHEN min({c}) < max({c}) THEN 1.0 END FROM enc")
        sel.append(f"SELECT '{c}', 'constant', CAST(NULL AS DOUBLE)")
        sel.append(f"SELECT 'constant', '{c}', CAST(NULL AS DOUBLE)")
    sel.append("SELECT 'constant', 'constant', CAST(NULL AS DOUBLE)")
    return f"""
WITH rf AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
            FROM (SELECT DISTINCT CAST(l_returnflag AS VARCHAR) AS v FROM lineitem WHERE l_returnflag IS NOT NULL)),
ls AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT CAST(l_linestatus AS VARCHAR) AS v FROM lineitem WHERE l_linestatus IS NOT NULL)),
enc AS (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice,
               CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax,
               CAST(rf.code AS DOUBLE) AS l_returnflag_code, CAST(ls.code AS DOUBLE) AS l_linestatus_code
        FROM lineitem l LEFT JOIN rf ON l.l_returnflag = rf.v LEFT JOIN ls ON l.l_linestatus = ls.v
        WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL
          AND l_tax IS NOT NULL AND rf.code IS NOT NULL AND ls.code IS NOT NULL)
""" + "\nUNION ALL\n".join(sel)


ORACLE["corr_matrix"] = _corr_sql()

ORACLE["top_mean_diff"] = f"""
WITH {_LI},
long AS ({" UNION ALL ".join(f"SELECT correct, '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM li" for c in _NUM + ['l_linenumber'])}),
m AS (SELECT column_name, avg(CASE WHEN correct = 'correct' THEN value END) AS mean_correct,
             avg(CASE WHEN correct = 'incorrect' THEN value END) AS mean_incorrect
      FROM long GROUP BY column_name)
SELECT column_name, round(mean_correct, 6) AS mean_correct, round(mean_incorrect, 6) AS mean_incorrect,
       round(abs(mean_correct - mean_incorrect), 6) AS abs_diff
FROM m WHERE abs(mean_correct - mean_incorrect) IS NOT NULL
ORDER BY abs(mean_correct - mean_incorrect) DESC, column_name LIMIT 3
"""

ORACLE["score_quantiles"] = f"""
WITH {_LI}
SELECT truth, round(quantile_cont(l_discount * 10, 0.25), 6) AS p25,
       round(quantile_cont(l_discount * 10, 0.5), 6) AS p50,
       round(quantile_cont(l_discount * 10, 0.75), 6) AS p75
FROM li WHERE l_discount IS NOT NULL GROUP BY truth
"""

ORACLE["box_stats"] = f"""
WITH {_LI},
q AS (SELECT truth, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
             quantile_cont(l_extendedprice, 0.75) AS q3 FROM li WHERE l_extendedprice IS NOT NULL GROUP BY truth),
j AS (SELECT li.truth, l_extendedprice AS v, q1, median, q3, q3 - q1 AS iqr FROM li JOIN q ON li.truth = q.truth
      WHERE l_extendedprice IS NOT NULL)
SELECT truth, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min(CASE WHEN v >= q1 - 1.5 * iqr AND v <= q3 + 1.5 * iqr THEN v END), 6) AS whisker_lo,
  round(max(CASE WHEN v >= q1 - 1.5 * iqr AND v <= q3 + 1.5 * iqr THEN v END), 6) AS whisker_hi,
  count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * iqr AND v <= q3 + 1.5 * iqr)) AS n_outliers,
  count(*) AS n
FROM j GROUP BY truth
"""

ORACLE["kde_grid"] = """
WITH v AS (SELECT o_orderstatus, o_totalprice AS x FROM orders WHERE o_totalprice IS NOT NULL),
st AS (SELECT o_orderstatus, count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM v GROUP BY 1),
st2 AS (SELECT *, pow(CAST(n AS DOUBLE), -0.2) * sd AS h FROM st),
st3 AS (SELECT *, mn - 3.0 * h AS g0, (mx - mn + 6.0 * h) / 199 AS step FROM st2 WHERE h > 0),
grid AS (SELECT o_orderstatus, n, h, CAST(i AS INTEGER) AS grid_idx, g0 + i * step AS x
         FROM st3, range(0, 200) r(i)),
dv AS (SELECT o_orderstatus, x AS v, count(*) AS c FROM v GROUP BY 1, 2)
SELECT grid.o_orderstatus, grid_idx, round(grid.x, 6) AS x,
  round(sum(c * exp(-0.5 * ((grid.x - v) / h) * ((grid.x - v) / h))) / (n * h * sqrt(2 * pi())), 12) AS density
FROM grid JOIN dv ON grid.o_orderstatus = dv.o_orderstatus
GROUP BY grid.o_orderstatus, grid_idx, grid.x, n, h
"""

ORACLE["histogram_density"] = f"""
WITH {_LI},
v AS (SELECT correct, l_extendedprice AS x FROM li WHERE l_extendedprice IS NOT NULL AND correct IS NOT NULL),
r AS (SELECT min(x) AS mn, max(x) AS mx FROM v),
b AS (SELECT correct, CAST(CASE WHEN (mx - mn) / 20 > 0 THEN least(floor((x - mn) / ((mx - mn) / 20)), 19) ELSE 0 END AS INTEGER) AS bin,
             mn, mx FROM v, r),
g AS (SELECT DISTINCT correct FROM v),
c AS (SELECT g.correct, i.bin, any_value(r.mn) AS mn, any_value(r.mx) AS mx, count(b.bin) AS n
      FROM g CROSS JOIN r CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) i
      LEFT JOIN b ON b.correct = g.correct AND b.bin = i.bin GROUP BY g.correct, i.bin)
SELECT correct, bin, round(mn + bin * ((mx - mn) / 20), 8) AS lo, round(mn + (bin + 1) * ((mx - mn) / 20), 8) AS hi,
  n, round(n / (sum(n) OVER (PARTITION BY correct) * ((mx - mn) / 20)), 8) AS density
FROM c
"""

_OC = "(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) oc"

ORACLE["facet_options"] = f"""
SELECT DISTINCT facet, value FROM (
  SELECT 'o_orderpriority' AS facet, CAST(o_orderpriority AS VARCHAR) AS value FROM {_OC}
  UNION ALL SELECT 'o_orderstatus', CAST(o_orderstatus AS VARCHAR) FROM {_OC}
  UNION ALL SELECT 'c_mktsegment', CAST(c_mktsegment AS VARCHAR) FROM {_OC}) WHERE value IS NOT NULL
"""

ORACLE["facet_bounds"] = f"""
SELECT facet, CAST(trunc(min(value)) AS BIGINT) AS lo, CAST(trunc(max(value)) AS BIGINT) AS hi FROM (
  SELECT 'o_totalprice' AS facet, CAST(o_totalprice AS DOUBLE) AS value FROM {_OC}
  UNION ALL SELECT 'c_acctbal', CAST(c_acctbal AS DOUBLE) FROM {_OC}) GROUP BY facet
"""

_LIE = _LI + """,
lie AS (SELECT *, CASE WHEN l_tax = 0 THEN 'Feil' ELSE pred END AS pred2 FROM li)"""

ORACLE["confusion"] = f"""
WITH {_LIE},
grid AS (SELECT * FROM (VALUES ('Godkjent', 'Godkjent', 0, 0), ('Godkjent', 'Avslag', 0, 1),
                               ('Avslag', 'Godkjent', 1, 0), ('Avslag', 'Avslag', 1, 1))
         g(truth, pred, truth_idx, pred_idx)),
cnt AS (SELECT truth, pred2 AS pred, count(*) AS n FROM lie
        WHERE truth IN ('Godkjent', 'Avslag') AND pred2 IN ('Godkjent', 'Avslag') GROUP BY ALL)
SELECT g.truth, g.pred, CAST(g.truth_idx AS INTEGER) AS truth_idx, CAST(g.pred_idx AS INTEGER) AS pred_idx,
       coalesce(cnt.n, 0) AS n
FROM grid g LEFT JOIN cnt ON g.truth = cnt.truth AND g.pred = cnt.pred
"""


def _report_sql(src: str, truth: str, pred: str) -> str:
    return f"""
v AS (SELECT {truth} AS truth, {pred} AS pred FROM {src} WHERE {truth} IS NOT NULL AND {pred} IS NOT NULL),
lab AS (SELECT truth AS label FROM v UNION SELECT pred FROM v),
cnt AS (SELECT lab.label,
          (SELECT count(*) FROM v WHERE v.truth = lab.label) AS support,
          (SELECT count(*) FROM v WHERE v.pred = lab.label) AS npred,
          (SELECT count(*) FROM v WHERE v.truth = lab.label AND v.pred = lab.label) AS tp FROM lab),
per AS (SELECT label, support, tp,
          CASE WHEN npred > 0 THEN CAST(tp AS DOUBLE) / npred ELSE 0.0 END AS precision,
          CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall FROM cnt),
per2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall)
                   ELSE 0.0 END AS f1 FROM per),
tot AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
          sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
          sum(f1 * support) / sum(support) AS wf FROM per2)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM per2
UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(tp AS DOUBLE) / n, 6), CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), CAST(n AS BIGINT) FROM tot"""


ORACLE["class_report"] = f"""
WITH {_LIE}, valid AS (SELECT * FROM lie WHERE pred2 IN ('Godkjent', 'Avslag')), {_report_sql('valid', 'truth', 'pred2')}
"""

_AUTO = """
auto AS (SELECT *,
  CASE WHEN l_returnflag = 'A' THEN 'Utvidet bruk' WHEN l_returnflag = 'N' THEN 'Varig tillatelse'
       ELSE 'Avslag' END AS pred_label,
  1.0 - l_discount * 5 AS confidence FROM lineitem),
auto2 AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN pred_label ELSE 'Avslag' END AS true_label FROM auto)"""

ORACLE["auto_approve"] = f"""
WITH {_AUTO}
SELECT pred_label, CASE WHEN pred_label IN ('Utvidet bruk', 'Varig tillatelse') AND confidence >= 0.8
                        THEN 'AUTO_APPROVE' ELSE 'MANUAL_REVIEW' END AS decision, count(*) AS n
FROM auto2 GROUP BY ALL
"""

ORACLE["high_conf_report"] = f"""
WITH {_AUTO}, hc AS (SELECT * FROM auto2 WHERE confidence >= 0.8), {_report_sql('hc', 'true_label', 'pred_label')}
"""

ORACLE["class_ratio"] = """
WITH y AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)
SELECT count(*) FILTER (WHERE y <> 1) AS n_neg, count(*) FILTER (WHERE y = 1) AS n_pos,
       CAST(count(*) FILTER (WHERE y <> 1) AS DOUBLE) / nullif(count(*) FILTER (WHERE y = 1), 0) AS ratio
FROM y
"""

_EV = """
ev AS (SELECT *, value / 490 AS p, CASE WHEN value > 200 THEN 1 ELSE 0 END AS hit,
              event_type <> 'view' AS predicted,
              CASE WHEN value > 245 THEN event_type ELSE 'other' END AS true_class FROM events)"""

ORACLE["precision_threshold"] = f"""
WITH {_EV},
tot AS (SELECT count(*) AS n_all FROM ev),
cand AS (SELECT DISTINCT round(p, 6) AS t FROM ev WHERE predicted AND p IS NOT NULL),
sc AS (SELECT c.t, count(*) AS n, sum(hit) AS hits FROM cand c JOIN ev ON ev.predicted AND ev.p >= c.t GROUP BY c.t),
ok AS (SELECT t, CAST(hits AS DOUBLE) / n AS precision, n FROM sc WHERE n > 0 AND CAST(hits AS DOUBLE) / n >= 0.9),
best AS (SELECT * FROM ok ORDER BY t LIMIT 1)
SELECT best.t AS threshold, round(best.precision, 6) AS precision,
       round(CAST(best.n AS DOUBLE) / tot.n_all, 6) AS coverage, CAST(coalesce(best.n, 0) AS BIGINT) AS n_auto
FROM tot LEFT JOIN best ON TRUE
"""

ORACLE["class_thresholds"] = f"""
WITH {_EV},
e2 AS (SELECT *, CASE WHEN true_class = event_type THEN 1 ELSE 0 END AS hit2 FROM ev),
tot AS (SELECT count(*) AS n_all FROM e2),
cand AS (SELECT DISTINCT event_type AS class, round(p, 6) AS t FROM e2 WHERE p IS NOT NULL),
sc AS (SELECT c.class, c.t, count(*) AS n, sum(hit2) AS hits FROM cand c
       JOIN e2 ON e2.event_type = c.class AND e2.p >= c.t GROUP BY c.class, c.t),
ok AS (SELECT class, t, CAST(hits AS DOUBLE) / n AS precision, n FROM sc
       WHERE n > 0 AND CAST(hits AS DOUBLE) / n >= 0.95),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY t) AS r FROM ok) WHERE r = 1),
classes AS (SELECT DISTINCT true_class AS class FROM e2)
SELECT classes.class, best.t AS threshold, round(best.precision, 6) AS precision,
       round(CAST(best.n AS DOUBLE) / (SELECT n_all FROM tot), 6) AS coverage,
       CAST(coalesce(best.n, 0) AS BIGINT) AS n_auto
FROM classes LEFT JOIN best ON classes.class = best.class
"""


def _grid_sql() -> str:
    # seventeen thresholds from 0.1 to 0.9
    vals = ", ".join([f"(CAST(0.1 AS DOUBLE) + {i} * CAST(0.05 AS DOUBLE))" for i in range(16)] + ["(CAST(0.9 AS DOUBLE))"])
    return f"""
WITH d AS (SELECT l_discount * 10 AS p,
                  CASE WHEN (l_discount >= 0.05 AND l_quantity > 10) OR l_quantity < 3 THEN 1 ELSE 0 END AS y
           FROM lineitem),
g AS (SELECT * FROM (VALUES {vals}) g(t)),
cm AS (SELECT t, sum(CASE WHEN p >= t AND y = 1 THEN 1 ELSE 0 END) AS tp,
              sum(CASE WHEN NOT (p >= t) AND y = 1 THEN 1 ELSE 0 END) AS fn,
              sum(CASE WHEN NOT (p >= t) AND y <> 1 THEN 1 ELSE 0 END) AS tn
       FROM g, d GROUP BY t),
sc AS (SELECT t, CASE WHEN tn + fn > 0 THEN CAST(tn AS DOUBLE) / (tn + fn) ELSE 0.0 END AS npv,
              CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall FROM cm),
ok AS (SELECT *, (recall + npv) / 2 AS score FROM sc WHERE npv >= 0.6 AND recall >= 0.6),
best AS (SELECT * FROM ok ORDER BY score DESC, t LIMIT 1)
SELECT coalesce(best.t, 0.5) AS threshold, round(best.score, 6) AS score, round(best.npv, 6) AS npv,
       round(best.recall, 6) AS recall
FROM (SELECT 1) one LEFT JOIN best ON TRUE
"""


ORACLE["grid_threshold"] = _grid_sql()

_POL = """
pin AS (
  SELECT l.l_discount * 10 AS p_reject,
    CASE WHEN l.l_discount >= 0.05 THEN 'Avslag' ELSE 'Tillatelse' END AS stage1_pred,
    o.o_orderpriority AS stage2_class, 1.0 - l.l_tax * 10 AS stage2_p,
    CASE WHEN l.l_returnflag = 'R' THEN 'Avslag' ELSE o.o_orderpriority END AS truth,
    CASE WHEN o.o_orderstatus = 'F' THEN ' Lite  streng' WHEN o.o_orderstatus = 'O' THEN 'Mindre streng '
         ELSE 'Streng' END AS policy_class
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
thr AS (SELECT * FROM (VALUES (1, 'Avslag', 0.8), (2, '1-URGENT', 0.5), (2, '2-HIGH', 0.9),
          (2, '3-MEDIUM', NULL), (2, '4-NOT SPECIFIED', 0.7), (2, '5-LOW', 0.3)) t(stage, class, threshold)),
gated AS (SELECT pin.*, coalesce(trim(regexp_replace(policy_class, '\\s+', ' ', 'g')) IN ('Lite streng', 'Mindre streng'), false) AS gate_ok,
            (SELECT max(threshold) FROM thr WHERE stage = 1) AS t1, t2.threshold AS t2
          FROM pin LEFT JOIN (SELECT class, threshold FROM thr WHERE stage = 2) t2 ON pin.stage2_class = t2.class)"""


def _decide(gate: bool) -> str:
    g = " AND gate_ok" if gate else ""
    f1 = f"stage1_pred = 'Avslag' AND t1 IS NOT NULL AND p_reject >= t1{g}"
    f2 = f"stage1_pred = 'Tillatelse' AND t2 IS NOT NULL AND stage2_p >= t2{g}"
    return f"""
dec AS (SELECT *, CASE WHEN {f1} THEN 'Avslag' WHEN {f2} THEN stage2_class ELSE 'manual_review' END AS auto_decision,
                  CASE WHEN {f1} THEN p_reject WHEN {f2} THEN stage2_p END AS decision_conf FROM gated)"""


ORACLE["two_stage_policy"] = f"""
WITH {_POL}, {_decide(False)}
SELECT auto_decision, count(*) AS n, round(avg(decision_conf), 6) AS mean_conf FROM dec GROUP BY auto_decision
"""

_METRICS = """
SELECT count(*) AS n, count(*) FILTER (WHERE auto_decision <> 'manual_review') AS auto_n,
  round(avg(CASE WHEN auto_decision <> 'manual_review' THEN CAST(auto_decision = truth AS DOUBLE) END), 6) AS auto_accuracy,
  round(CAST(count(*) FILTER (WHERE auto_decision <> 'manual_review') AS DOUBLE) / count(*), 6) AS coverage"""

ORACLE["two_stage_metrics"] = f"WITH {_POL}, {_decide(False)} {_METRICS} FROM dec"

ORACLE["gated_policy"] = f"""WITH {_POL}, {_decide(True)} {_METRICS},
  count(*) FILTER (WHERE NOT gate_ok) AS blocked FROM dec"""

ORACLE["rule_reject"] = """
WITH b AS (
  SELECT CASE WHEN o.o_orderstatus = 'F' THEN 'Lite streng' WHEN o.o_orderstatus = 'O' THEN 'Mindre streng' END AS policy_class,
         l.l_quantity + 40 AS speed,
         CASE WHEN l.l_linenumber = 1 THEN 'Krapp sving' ELSE 'Rett veg' END AS curve,
         CASE WHEN l.l_returnflag = 'A' THEN 'Utvidet bruk' WHEN l.l_returnflag = 'N' THEN NULL
              ELSE 'Ny avkjørsel' END AS application_type
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT policy_class, application_type,
  (policy_class IS DISTINCT FROM 'Lite streng')
  OR ((coalesce(speed > 60, false) OR curve IS NOT DISTINCT FROM 'Krapp sving')
      AND NOT coalesce(application_type IN ('Utvidet bruk', 'Endret bruk'), false)) AS reject,
  count(*) AS n
FROM b GROUP BY ALL
"""

_ANN = """
base AS (SELECT o_orderkey, o_custkey AS case_id FROM orders),
ann AS (SELECT user_id AS case_id, event_id, CASE WHEN event_type <> 'error' THEN event_type END AS difficulty
        FROM events),
per_key AS (SELECT case_id, arg_max(difficulty, event_id) FILTER (WHERE difficulty IS NOT NULL) AS difficulty
            FROM ann WHERE case_id IS NOT NULL GROUP BY case_id)"""

ORACLE["merge_annotations"] = f"""
WITH {_ANN}
SELECT b.case_id, b.o_orderkey, p.difficulty FROM base b LEFT JOIN per_key p ON b.case_id = p.case_id
"""

ORACLE["unmatched_keys"] = f"""
WITH {_ANN}
SELECT DISTINCT case_id FROM ann WHERE case_id IS NOT NULL
  AND case_id NOT IN (SELECT case_id FROM base WHERE case_id IS NOT NULL)
"""

ORACLE["duplicate_keys"] = f"""
WITH {_ANN},
dup AS (SELECT case_id, count(*) AS n_base FROM base WHERE case_id IS NOT NULL GROUP BY case_id HAVING count(*) > 1),
na AS (SELECT case_id, count(*) AS n_ann FROM ann WHERE case_id IS NOT NULL GROUP BY case_id)
SELECT dup.case_id, dup.n_base, coalesce(na.n_ann, 0) AS n_ann FROM dup LEFT JOIN na ON dup.case_id = na.case_id
"""

ORACLE["duplicate_annotations"] = f"""
WITH {_ANN},
dup AS (SELECT case_id FROM base WHERE case_id IS NOT NULL GROUP BY case_id HAVING count(*) > 1)
SELECT case_id, difficulty FROM per_key WHERE case_id IN (SELECT case_id FROM dup)
"""

ORACLE["reconcile"] = f"""
WITH {_ANN},
merged AS (SELECT b.case_id, p.difficulty FROM base b LEFT JOIN per_key p ON b.case_id = p.case_id),
a AS (SELECT count(*) AS annotated FROM ann WHERE difficulty IS NOT NULL),
t AS (SELECT count(*) AS transferred FROM merged WHERE difficulty IS NOT NULL)
SELECT annotated, transferred, annotated - transferred AS missing FROM a, t
"""

ORACLE["lookup_attribute"] = """
WITH first AS (SELECT user_id, arg_min(props, event_id) AS props FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT c.c_custkey, c.c_mktsegment,
       coalesce(CAST(json_extract_string(f.props, '$.k') AS VARCHAR), '') AS k_value
FROM customer c LEFT JOIN first f ON c.c_custkey = f.user_id
"""

ORACLE["lookup_first_line"] = """
WITH first AS (
  SELECT l_partkey, l_quantity AS qty FROM (
    SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber,
        l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS r
    FROM lineitem) WHERE r = 1)
SELECT p.p_partkey, coalesce(CAST(f.qty AS VARCHAR), '') AS first_qty
FROM part p LEFT JOIN first f ON p.p_partkey = f.l_partkey
"""

ORACLE["count_within"] = """
SELECT c.l_orderkey, c.l_linenumber, c.l_partkey, c.l_extendedprice,
  (SELECT count(*) FROM lineitem p WHERE p.l_partkey = c.l_partkey
     AND abs(p.l_extendedprice - c.l_extendedprice) <= 500.0) AS n_within
FROM lineitem c
"""

ORACLE["count_events_nearby"] = """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS sec FROM events)
SELECT c.event_id, c.user_id,
  (SELECT count(*) FROM e p WHERE p.user_id = c.user_id AND abs(p.sec - c.sec) <= 60.0) AS n_within
FROM e c
"""

ORACLE["clean_parse_numbers"] = """
WITH t AS (
  SELECT CASE WHEN l_linenumber = 7 THEN 'abc'
              ELSE ' ' || translate(format('{:,.2f}', l_extendedprice), ',.', chr(160) || ',') || ' ' END AS txt,
         ' ' || l_returnflag || '   ' || l_linestatus AS cat,
         CASE WHEN l_returnflag = 'R' THEN 'Avslag' ELSE 'Godkjent' END AS truth
  FROM lineitem)
SELECT DISTINCT TRY_CAST(replace(translate(trim(txt), ' ' || chr(160), ''), ',', '.') AS DOUBLE) AS price,
       regexp_replace(trim(cat), '\\s+', ' ', 'g') AS category, truth
FROM t
"""

_CURVE = """
r AS (SELECT p_partkey, CASE WHEN p_size <> 1 THEN round((p_retailprice - 950) * 100, 1) END AS radius FROM part),
c AS (SELECT p_partkey, radius,
  CASE WHEN abs(radius) >= 3000 THEN 'Rett veg'
       WHEN abs(radius) >= 1000 THEN 'Veldig slak sving (svingradius ' || CAST(abs(radius) AS VARCHAR) || 'm)'
       WHEN abs(radius) >= 500 THEN 'Slak sving (svingradius ' || CAST(abs(radius) AS VARCHAR) || 'm)'
       WHEN abs(radius) >= 0 THEN 'Krapp sving'
       ELSE 'Ukjent' END AS curve_category FROM r)"""

ORACLE["curve_category"] = f"""
WITH {_CURVE}
SELECT p_partkey, curve_category,
  CASE WHEN curve_category = 'Krapp sving' THEN 'Sving (svingradius ' || CAST(abs(radius) AS VARCHAR) || 'm)'
       ELSE curve_category END AS turn_label
FROM c
"""

ORACLE["curve_category_counts"] = f"""
WITH {_CURVE}
SELECT regexp_replace(curve_category, ' \\(svingradius .*\\)$', '') AS curve_class, count(*) AS n
FROM c GROUP BY 1
"""

ORACLE["risk_band"] = """
WITH p AS (SELECT l_discount * 5 AS p FROM lineitem)
SELECT CASE WHEN p < 0.05 THEN 'lav sannsynlighet for avslag' WHEN p < 0.5 THEN 'medium sannsynlighet for avslag'
            ELSE 'høy sannsynlighet for avslag' END AS band,
       CASE WHEN round(p * 100, 1) < 5 THEN 'lav sannsynlighet for avslag'
            WHEN round(p * 100, 1) < 50 THEN 'medium sannsynlighet for avslag'
            ELSE 'høy sannsynlighet for avslag' END AS band_pct,
       count(*) AS n
FROM p GROUP BY ALL
"""


def _derived_sql() -> str:
    # the ten products a served case is scored on
    products = {
        "aadt_x_access_x_gradient": "aadt accesses gradient",
        "aadt_x_access": "aadt accesses",
        "aadt_x_long": "aadt long",
        "share_x_access_x_long": "share accesses long",
        "access_x_gradient_x_long": "accesses gradient long",
        "aadt_x_access_x_long": "aadt accesses long",
        "access_x_long": "accesses long",
        "aadt_x_gradient": "aadt gradient",
        "aadt_x_share": "aadt share",
        "aadt_x_speed_x_access": "aadt speed accesses",
    }
    base = {"aadt": "(l_extendedprice / 1000)", "accesses": "l_quantity", "share": "(l_discount * 100)",
            "speed": "(l_tax * 1000)", "gradient": "abs(l_discount - 0.05)",
            "long": "((l_extendedprice / 1000) * (l_discount * 100) / 100)"}
    feats = []
    for name, parts in products.items():
        feats.append(f"CAST({' * '.join(base[p] for p in parts.split())} AS DOUBLE) AS {name}")
    return f"""
SELECT l_orderkey, l_linenumber,
  (l_extendedprice / 1000) / (l_quantity + 1) AS per_access,
  round(ln(1 + (l_extendedprice / 1000)), 9) AS log_aadt,
  abs(l_discount - 0.05) AS abs_gradient,
  CASE WHEN abs(l_partkey * 50) > 99000 THEN 0 ELSE 1 END AS curve_ind,
  CASE WHEN abs(l_discount - 0.05) > 0.1 THEN 1 ELSE 0 END AS gradient_ind,
  round(CASE WHEN abs(l_partkey * 50) < 99000 THEN 1.0 / (1.0 + exp(-0.001 * abs(l_partkey * 50))) ELSE 0.0 END, 9)
    AS curve_sigmoid,
  (l_extendedprice / 1000) * (l_discount * 100) / 100 AS long_vehicles,
  {', '.join(feats)}
FROM lineitem"""


ORACLE["derived_features"] = _derived_sql()

ORACLE["facet_filter"] = """
WITH d AS (SELECT o.*, c.*, strftime(o.o_orderdate, '%d.%m.%Y') AS received_text,
                  CAST(o.o_orderdate AS DATE) AS received
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)
SELECT o_orderkey, o_custkey,
  'Saksnr: ' || coalesce(CAST(o_orderkey AS VARCHAR), '') || ' | For ' || lower(coalesce(c_mktsegment, ''))
  || ' på ' || split_part(coalesce(o_orderpriority, ''), ' ', 1) || ' i ' || coalesce(CAST(c_nationkey AS VARCHAR), '')
  || ' mottatt ' || coalesce(received_text, '') AS display_label
FROM d
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND c_mktsegment IN ('BUILDING', 'MACHINERY')
  AND coalesce(o_totalprice BETWEEN 50000 AND 300000, false) AND coalesce(c_acctbal BETWEEN 0 AND 8000, false)
  AND coalesce(received >= DATE '1997-01-01', false)
"""

def _key_sql(cols: list[str]) -> str:
    """Cells with their lengths, NULL as a dash."""
    return "concat(" + ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in cols) + ")"


_ORDER_KEY = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]

ORACLE["row_lookup"] = f"""
WITH last AS (SELECT max(o_orderkey) AS k FROM orders GROUP BY o_custkey)
SELECT sha256({_key_sql(_ORDER_KEY)}) AS row_id, o_orderkey, o_totalprice FROM orders
WHERE o_orderkey IN (SELECT k FROM last)
"""

ORACLE["row_ids"] = f"""
WITH o AS (SELECT * REPLACE (CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS o_orderpriority) FROM orders)
SELECT o_orderkey, sha256({_key_sql(_ORDER_KEY)}) AS row_id FROM o
"""

ORACLE["row_ids_repeated"] = f"""
WITH g AS (SELECT CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS flag,
                  CASE WHEN l_linenumber <> 3 THEN l_linestatus END AS status, l_linenumber AS line FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY flag, status, line) AS i FROM g)
SELECT flag, status, line, sha256({_key_sql(["flag", "status", "line", "i"])}) AS row_id FROM n
"""


def _h(key: str, seed: int) -> str:
    # an affine hash modulo a prime; the seed moves both factors
    a, b = (2654435761 + seed * 7919) % 1000003 or 1, (seed * 104729) % 1000003
    return f"((({key}) % 1000003) * {a} + {b}) % 1000003"


def _u(key: str, seed: int) -> str:
    return f"{_h(key, seed)} / 1000003.0"


_OL = """
ol AS (SELECT o_orderkey, o_orderstatus, o_orderpriority,
              CASE WHEN o_orderpriority = '1-URGENT' THEN 'Avslag' ELSE 'Tillatelse' END AS label FROM orders)"""

ORACLE["hash_split"] = f"""
WITH {_OL}
SELECT o_orderkey, CASE WHEN {_u('o_orderkey', 42)} < 0.6 THEN 'train' ELSE 'test' END AS split FROM ol
"""


def _strat(src: str, strata: str, frac: float, seed: int, names=("train", "test")) -> str:
    return f"""(SELECT *, CASE WHEN row_number() OVER (PARTITION BY {strata} ORDER BY {_h('o_orderkey', seed)}, o_orderkey)
        <= floor(count(*) OVER (PARTITION BY {strata}) * {frac} + 0.5) THEN '{names[1]}' ELSE '{names[0]}' END AS split
      FROM {src})"""


ORACLE["stratified_split"] = f"""
WITH {_OL}
SELECT o_orderkey, o_orderstatus, split FROM {_strat('ol', 'o_orderstatus', 0.2, 7)}
"""

ORACLE["nested_split"] = f"""
WITH {_OL}, outer_s AS {_strat('ol', 'label', 0.2, 11)},
tr AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, label FROM outer_s WHERE split = 'train')
SELECT o_orderkey, split FROM outer_s WHERE split = 'test'
UNION ALL SELECT o_orderkey, split FROM {_strat('tr', 'o_orderpriority', 0.2, 13, ('train', 'val'))}
"""

ORACLE["balanced_sample"] = f"""
WITH {_OL}, nm AS (SELECT count(*) AS n_min FROM ol WHERE label = 'Avslag'),
r AS (SELECT *, row_number() OVER (PARTITION BY label = 'Avslag' ORDER BY {_h('o_orderkey', 5)}, o_orderkey) AS rn FROM ol)
SELECT o_orderkey, label FROM r, nm
WHERE (label = 'Avslag' AND rn <= n_min) OR (label <> 'Avslag' AND rn <= floor(n_min * 2.0))
"""

ORACLE["oversample"] = f"""
WITH {_OL}, tr AS (SELECT * FROM ol WHERE {_u('o_orderkey', 3)} < 0.8),
c AS (SELECT label, count(*) AS n FROM tr GROUP BY label),
m AS (SELECT max(n) AS mx FROM c),
r AS (SELECT tr.*, row_number() OVER (PARTITION BY tr.label ORDER BY {_h('o_orderkey', 9)}, o_orderkey) AS rn,
             c.n, m.mx FROM tr JOIN c ON tr.label = c.label, m),
k AS (SELECT o_orderkey, label, CAST(floor(mx / n) + CASE WHEN rn <= mx % n THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r)
SELECT o_orderkey, label, CAST(g.copy AS BIGINT) AS copy FROM k, LATERAL (SELECT unnest(range(1, copies + 1)) AS copy) g
"""


def _bags_sql() -> str:
    bk = "(o_orderkey * 1009 + bag)"
    return f"""
WITH {_OL}, nm AS (SELECT count(*) AS n_min FROM ol WHERE label = 'Avslag'),
bags AS (SELECT unnest([1, 2, 3]) AS bag),
mj AS (SELECT ol.*, bags.bag FROM ol, bags WHERE label <> 'Avslag'),
r AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY {_h(bk, 100)}, {bk}) AS rn FROM mj)
SELECT CAST(bag AS INTEGER) AS bag, o_orderkey, label FROM r, nm WHERE rn <= floor(n_min * 1.0)
UNION ALL SELECT CAST(bag AS INTEGER), o_orderkey, label FROM ol, bags WHERE label = 'Avslag'
"""


ORACLE["balanced_bags"] = _bags_sql()

ORACLE["stage2_pool"] = f"""
WITH {_OL}
SELECT o_orderkey, o_orderpriority FROM ol
WHERE {_u('o_orderkey', 42)} < 0.6 AND label = 'Tillatelse'
"""

ORACLE["one_hot"] = """
WITH li AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS rf, l_linestatus
            FROM lineitem)
SELECT l_orderkey, l_linenumber,
  coalesce(CAST(rf = 'A' AS INTEGER), 0) AS l_returnflag_A, coalesce(CAST(rf = 'R' AS INTEGER), 0) AS l_returnflag_R,
  coalesce(CAST(l_linestatus = 'F' AS INTEGER), 0) AS l_linestatus_F,
  coalesce(CAST(l_linestatus = 'O' AS INTEGER), 0) AS l_linestatus_O
FROM li
"""

ORACLE["one_hot_unseen"] = """
SELECT o_orderstatus, coalesce(CAST(o_orderstatus = 'F' AS INTEGER), 0) AS o_orderstatus_F,
       coalesce(CAST(o_orderstatus = 'O' AS INTEGER), 0) AS o_orderstatus_O, count(*) AS n
FROM orders GROUP BY ALL
"""

ORACLE["label_encode"] = """
WITH p AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
           FROM (SELECT DISTINCT CAST(o_orderpriority AS VARCHAR) AS v FROM orders WHERE o_orderpriority IS NOT NULL)),
s AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
      FROM (SELECT DISTINCT CAST(o_orderstatus AS VARCHAR) AS v FROM orders WHERE o_orderstatus IS NOT NULL))
SELECT o.o_orderkey, p.code AS o_orderpriority_code, s.code AS o_orderstatus_code, p.v AS decoded
FROM orders o LEFT JOIN p ON o.o_orderpriority = p.v LEFT JOIN s ON o.o_orderstatus = s.v
"""

ORACLE["zscore"] = """
WITH li AS (SELECT l_orderkey, l_linenumber, coalesce(l_quantity, 0) AS q, coalesce(l_extendedprice, 0) AS e,
                   coalesce(CASE WHEN l_tax <> 0 THEN l_tax END, 0) AS t FROM lineitem),
st AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(e) AS me, stddev_pop(e) AS se, avg(t) AS mt, stddev_pop(t) AS stt
       FROM li)
SELECT l_orderkey, l_linenumber,
  round((q - mq) / CASE WHEN sq = 0 THEN 1.0 ELSE sq END, 6) AS l_quantity_z,
  round((e - me) / CASE WHEN se = 0 THEN 1.0 ELSE se END, 6) AS l_extendedprice_z,
  round((t - mt) / CASE WHEN stt = 0 THEN 1.0 ELSE stt END, 6) AS l_tax_z
FROM li, st
"""


def _inter_sql() -> str:
    # every product of one to three of four columns
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber",
             "l_quantity l_discount", "l_quantity l_tax", "l_quantity l_linenumber", "l_discount l_tax",
             "l_discount l_linenumber", "l_tax l_linenumber",
             "l_quantity l_discount l_tax", "l_quantity l_discount l_linenumber", "l_quantity l_tax l_linenumber",
             "l_discount l_tax l_linenumber"]
    sel = [f'CAST({" * ".join(f"CAST({c} AS DOUBLE)" for c in name.split())} AS DOUBLE) AS "{name}"' for name in names]
    return "SELECT l_orderkey, " + ", ".join(sel) + " FROM lineitem"


ORACLE["interactions3"] = _inter_sql()

_IMP = """
imp AS (SELECT l_orderkey, CASE WHEN l_quantity <> 25 THEN l_quantity END AS l_quantity, l_discount,
               CASE WHEN l_returnflag <> 'N' THEN l_linestatus END AS l_linestatus, l_returnflag FROM lineitem)"""


def _mode_sql(c: str) -> str:
    return f"""(SELECT '{c}' AS column_name, 'most_frequent' AS stat, v AS fill_value FROM (
   SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM imp WHERE {c} IS NOT NULL GROUP BY 1
   ORDER BY n DESC, v LIMIT 1))"""


ORACLE["impute_stats"] = f"""
WITH {_IMP}
SELECT 'l_quantity' AS column_name, 'median' AS stat, CAST(quantile_cont(l_quantity, 0.5) AS VARCHAR) AS fill_value FROM imp
UNION ALL SELECT 'l_discount', 'median', CAST(quantile_cont(l_discount, 0.5) AS VARCHAR) FROM imp
UNION ALL {_mode_sql('l_linestatus')}
UNION ALL {_mode_sql('l_returnflag')}
"""

ORACLE["impute"] = f"""
WITH {_IMP},
f AS (SELECT coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM imp)) AS l_quantity,
             coalesce(l_linestatus, (SELECT v FROM (SELECT l_linestatus AS v, count(*) AS n FROM imp
                      WHERE l_linestatus IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1))) AS l_linestatus FROM imp)
SELECT l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM f GROUP BY 1
"""

_SIM = """
c AS (SELECT o_orderkey AS case_id, o_orderpriority AS s1, c_mktsegment AS s2,
             CASE WHEN o_orderstatus = 'P' THEN 'Avslag' ELSE 'Godkjent' END AS label,
             coalesce(o_totalprice, 0) AS f1, coalesce(c_acctbal, 0) AS f2,
             coalesce(CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE), 0) AS f3,
             coalesce(CAST(c_nationkey AS DOUBLE), 0) AS f4
      FROM orders JOIN customer ON o_custkey = c_custkey),
st AS (SELECT avg(f1) AS m1, stddev_pop(f1) AS d1, avg(f2) AS m2, stddev_pop(f2) AS d2,
              avg(f3) AS m3, stddev_pop(f3) AS d3, avg(f4) AS m4, stddev_pop(f4) AS d4 FROM c),
z AS (SELECT case_id, s1, s2, label,
             (f1 - m1) / CASE WHEN d1 = 0 THEN 1.0 ELSE d1 END AS z1, (f2 - m2) / CASE WHEN d2 = 0 THEN 1.0 ELSE d2 END AS z2,
             (f3 - m3) / CASE WHEN d3 = 0 THEN 1.0 ELSE d3 END AS z3, (f4 - m4) / CASE WHEN d4 = 0 THEN 1.0 ELSE d4 END AS z4
      FROM c, st)"""

ORACLE["similar_cases"] = f"""
WITH {_SIM},
n2 AS (SELECT s1, s2, count(*) AS n FROM z WHERE s1 IS NOT NULL AND s2 IS NOT NULL GROUP BY s1, s2),
n1 AS (SELECT s1, count(*) AS n FROM z WHERE s1 IS NOT NULL GROUP BY s1),
q AS (SELECT z.*, CASE WHEN coalesce(n2.n, 0) > 1 THEN '2|' || z.s1 || '|' || z.s2
                       WHEN coalesce(n1.n, 0) > 1 THEN '1|' || z.s1 ELSE '0' END AS seg
      FROM z LEFT JOIN n2 ON z.s1 = n2.s1 AND z.s2 = n2.s2 LEFT JOIN n1 ON z.s1 = n1.s1),
p AS (SELECT case_id AS nid, z1, z2, z3, z4, '2|' || s1 || '|' || s2 AS seg FROM z
      WHERE label = 'Godkjent' AND s1 IS NOT NULL AND s2 IS NOT NULL
      UNION ALL SELECT case_id, z1, z2, z3, z4, '1|' || s1 FROM z WHERE label = 'Godkjent' AND s1 IS NOT NULL
      UNION ALL SELECT case_id, z1, z2, z3, z4, '0' FROM z WHERE label = 'Godkjent'),
pairs AS (SELECT q.case_id, p.nid,
   (q.z1 - p.z1) * (q.z1 - p.z1) + (q.z2 - p.z2) * (q.z2 - p.z2) + (q.z3 - p.z3) * (q.z3 - p.z3)
   + (q.z4 - p.z4) * (q.z4 - p.z4) AS dist
   FROM q JOIN p ON q.seg = p.seg AND q.case_id <> p.nid),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY dist, nid) AS rank FROM pairs)
          WHERE rank <= 2),
got AS (SELECT q.case_id, count(first.nid) AS m FROM q LEFT JOIN first ON q.case_id = first.case_id GROUP BY q.case_id),
need AS (SELECT case_id, m FROM got WHERE m < 2),
gpairs AS (SELECT n.case_id, p.nid,
   (q.z1 - p.z1) * (q.z1 - p.z1) + (q.z2 - p.z2) * (q.z2 - p.z2) + (q.z3 - p.z3) * (q.z3 - p.z3)
   + (q.z4 - p.z4) * (q.z4 - p.z4) AS dist, n.m
   FROM need n JOIN q ON n.case_id = q.case_id JOIN p ON p.seg = '0' AND p.nid <> n.case_id
   LEFT JOIN first f ON f.case_id = n.case_id AND f.nid = p.nid WHERE f.nid IS NULL),
fill AS (SELECT case_id, nid, dist, m + r AS rank FROM (
   SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY dist, nid) AS r FROM gpairs) WHERE r <= 2 - m)
SELECT case_id, nid AS example_id, round(dist, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM first
UNION ALL SELECT case_id, nid, round(dist, 6), CAST(rank AS INTEGER) FROM fill
"""

ORACLE["reject_examples"] = f"WITH {_SIM} SELECT case_id AS example_id FROM z WHERE label = 'Avslag'"

_OT = """
ot AS (SELECT o_orderkey,
  'o_orderkey: ' || coalesce(CAST(o_orderkey AS VARCHAR), 'nan') || chr(10) ||
  'o_orderstatus: ' || coalesce(CAST(o_orderstatus AS VARCHAR), 'nan') || chr(10) ||
  'o_totalprice: ' || coalesce(CAST(o_totalprice AS VARCHAR), 'nan') || chr(10) ||
  'o_orderpriority: ' || coalesce(CAST(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS VARCHAR), 'nan')
  AS case_text FROM orders)"""

ORACLE["case_text"] = f"WITH {_OT} SELECT o_orderkey, case_text FROM ot"


def _prompt_sql() -> str:
    from casework.functions.text import PROMPT_HEAD, PROMPT_TAIL
    sim = ORACLE["similar_cases"]
    nl2 = "chr(10) || chr(10)"
    return f"""
WITH {_OT}, sim AS ({sim}),
ex AS (SELECT sim.case_id, sim.rank,
         'Søknadsdata:' || chr(10) || ot.case_text || chr(10) || 'Fasit:' || chr(10) || '{{"approve": true}}' AS block
       FROM sim JOIN ot ON sim.example_id = ot.o_orderkey),
pc AS (SELECT case_id, array_to_string(list(block ORDER BY rank), {nl2}) AS examples FROM ex GROUP BY case_id),
g AS (SELECT min(doc_id) AS guideline_id FROM documents WHERE source = 'src0')
SELECT ot.o_orderkey,
  '{PROMPT_HEAD}' || {nl2} || '' || {nl2} || 'Søknad:' || chr(10) || ot.case_text || {nl2} ||
  'Retningslinjer: [dokument ' || CAST(g.guideline_id AS VARCHAR) || ']' || {nl2} ||
  'Eksempler med fasit:' || chr(10) || coalesce(pc.examples, '') || {nl2} ||
  'Avslåtte eksempler: [tabell reject_examples]' || {nl2} || '{PROMPT_TAIL}' AS prompt
FROM ot LEFT JOIN pc ON ot.o_orderkey = pc.case_id, g
"""


ORACLE["prompt"] = _prompt_sql()

def _replies_sql() -> str:
    from casework.plans.catalog import REPLIES  # the input rows, not the rule
    return ", ".join("'" + r.replace("'", "''") + "'" for r in REPLIES)


ORACLE["parse_reply"] = r"""
WITH r AS (
  SELECT conv_id, turn,
    CASE WHEN turn = 1 THEN text
         ELSE list_extract([%s], CAST((conv_id * 7 + turn * 3 + length(text)) %% len([%s]) AS INTEGER) + 1) END AS reply,
    CASE WHEN turn = 3 AND role = 'assistant' THEN 'timeout' END AS error
  FROM conversations),
t AS (SELECT *, regexp_replace(reply, '^\s+|\s+$', '', 'g') AS trimmed FROM r),
f AS (SELECT *, regexp_replace(regexp_replace(trimmed, '^```[a-zA-Z]*', ''), '```$', '') AS inner_text FROM t),
b AS (SELECT *, regexp_replace(inner_text, '^\s+|\s+$', '', 'g') AS body FROM f),
j AS (SELECT *, coalesce(json_valid(body), false) AND coalesce(CASE WHEN json_valid(body) THEN json_type(body) END = 'OBJECT', false) AS ok FROM b),
k AS (SELECT *, CASE WHEN ok THEN json_type(body, '$.approve') END AS kind,
             CASE WHEN ok THEN json_extract_string(body, '$.approve') END AS val,
             CASE WHEN ok THEN json_extract_string(body, '$.reason') END AS reason FROM j),
v AS (SELECT *, CASE kind WHEN 'BOOLEAN' THEN val = 'true' WHEN 'VARCHAR' THEN val <> '' WHEN 'ARRAY' THEN val <> '[]'
                          WHEN 'OBJECT' THEN val <> '{}' WHEN 'NULL' THEN false ELSE TRY_CAST(val AS DOUBLE) <> 0 END AS approve FROM k),
d AS (SELECT *,
  CASE WHEN error IS NOT NULL OR NOT ok THEN 'Feil' WHEN coalesce(approve, false) THEN 'Godkjent' ELSE 'Avslag' END
    AS strict_decision,
  CASE WHEN error IS NOT NULL OR NOT ok THEN coalesce(error, 'Ugyldig svar') ELSE coalesce(reason, 'Ingen begrunnelse oppgitt.') END
    AS strict_reason,
  CASE WHEN error IS NOT NULL THEN 'Feil' WHEN ok AND coalesce(approve, false) THEN 'Godkjent' ELSE 'Avslag' END
    AS lenient_decision FROM v)
SELECT conv_id, turn, strict_decision, strict_reason, lenient_decision,
       strict_decision IN ('Godkjent', 'Avslag') AS strict_valid FROM d
""" % (_replies_sql(), _replies_sql())

ORACLE["explanation_text"] = """
WITH f AS (
  SELECT l_orderkey, l_linenumber,
    [{'contribution': (l_quantity - 25) / 100, 'name': 'antall', 'value': l_quantity},
     {'contribution': (l_discount - 0.05) * 2, 'name': 'rabatt', 'value': l_discount},
     {'contribution': (l_tax - 0.04) * 3, 'name': 'avgift', 'value': l_tax},
     {'contribution': floor((l_extendedprice - 50000) / 1000) / 1000, 'name': 'pris', 'value': l_extendedprice}] AS fac,
    least(greatest(0.1 + (l_quantity - 25) / 100 + (l_discount - 0.05) * 2 + (l_tax - 0.04) * 3
                   + floor((l_extendedprice - 50000) / 1000) / 1000, 0.0), 1.0) AS p
  FROM lineitem),
s AS (SELECT *, list_sort(fac, 'DESC') AS srt FROM f),
pn AS (SELECT *, list_filter(srt, lambda x: x.contribution > 0)[1:3] AS pos,
              list_filter(srt, lambda x: x.contribution < 0) AS neg_all FROM s),
pn2 AS (SELECT *, neg_all[greatest(len(neg_all) - 2, 1):greatest(len(neg_all) - 2, 1) + 2] AS neg FROM pn),
ln AS (SELECT *,
  CASE WHEN len(pos) = 0 THEN '  (ingen vesentlige faktorer)' ELSE array_to_string(list_transform(pos, lambda x:
    '  • ' || x.name || ' (verdi: ' || CAST(round(x.value, 3) AS VARCHAR) || ', effekt: ' ||
    CASE WHEN round(x.contribution, 3) >= 0 THEN '+' ELSE '' END || CAST(round(x.contribution, 3) AS VARCHAR) || ')'),
    chr(10)) END AS pos_txt,
  CASE WHEN len(neg) = 0 THEN '  (ingen vesentlige faktorer)' ELSE array_to_string(list_transform(neg, lambda x:
    '  • ' || x.name || ' (verdi: ' || CAST(round(x.value, 3) AS VARCHAR) || ', effekt: ' ||
    CASE WHEN round(x.contribution, 3) >= 0 THEN '+' ELSE '' END || CAST(round(x.contribution, 3) AS VARCHAR) || ')'),
    chr(10)) END AS neg_txt FROM pn2)
SELECT l_orderkey, l_linenumber,
  'Sannsynlighet for avslag: ' || CAST(round(p * 100, 1) AS VARCHAR) || ' %' || chr(10) ||
  'Kategori: ' || CASE WHEN p < 0.05 THEN 'lav sannsynlighet for avslag' WHEN p < 0.5 THEN 'medium sannsynlighet for avslag'
                       ELSE 'høy sannsynlighet for avslag' END || chr(10) || chr(10) ||
  'Faktorer som ØKER sannsynligheten for avslag:' || chr(10) || pos_txt || chr(10) || chr(10) ||
  'Faktorer som REDUSERER sannsynligheten for avslag:' || chr(10) || neg_txt AS explanation
FROM ln
"""

ORACLE["application_type"] = """
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Avslag' WHEN o_orderstatus = 'O' THEN 'Varig tillatelse'
                                   ELSE 'Utvidet bruk' END AS decision,
                  'arkiv/' || CAST(o_orderkey AS VARCHAR) AS archive_url FROM orders),
ov AS (SELECT DISTINCT 'arkiv/' || CAST(o_orderkey AS VARCHAR) AS archive_url, 'Endret bruk' AS application_type
       FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT decision, CASE WHEN decision = 'Avslag' THEN coalesce(ov.application_type, '') ELSE decision END AS application_type,
       count(*) AS n
FROM c LEFT JOIN ov ON c.archive_url = ov.archive_url GROUP BY ALL
"""

# The two sparse columns (rare_note: a handful of rows; approved_only:
# NULL in the whole reject group) are pruned, the others kept.
ORACLE["sparse_prune"] = """
SELECT CASE WHEN l_returnflag = 'R' THEN 'Avslag' ELSE 'Godkjent' END AS truth, l_orderkey, l_quantity,
       trim(' ' || l_linestatus || ' ') AS status_txt
FROM lineitem
"""

ORACLE["quality_report"] = f"""
WITH d AS (SELECT CAST(l.quality AS VARCHAR) AS truth, CASE WHEN d.n_chars >= 1500 THEN '1' ELSE '0' END AS pred
           FROM labels l JOIN documents d ON l.doc_id = d.doc_id), {_report_sql('d', 'truth', 'pred')}
"""


def _emb_sql() -> str:
    dist = " + ".join(f"(CAST(q.embedding[{i + 1}] AS DOUBLE) - CAST(p.embedding[{i + 1}] AS DOUBLE)) * "
                      f"(CAST(q.embedding[{i + 1}] AS DOUBLE) - CAST(p.embedding[{i + 1}] AS DOUBLE))"
                      for i in range(64))
    return f"""
WITH pairs AS (SELECT q.vec_id, p.vec_id AS neighbor_id, {dist} AS dist
               FROM embeddings q JOIN embeddings p ON q.label = p.label AND q.vec_id <> p.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbor_id) AS rank FROM pairs)
SELECT vec_id, neighbor_id, round(dist, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
"""


ORACLE["similar_embeddings"] = _emb_sql()

ORACLE["annotated_counts"] = f"""
WITH {_ANN},
merged AS (SELECT b.case_id, p.difficulty FROM base b LEFT JOIN per_key p ON b.case_id = p.case_id)
SELECT difficulty, count(*) AS n FROM merged
WHERE difficulty IS NOT NULL AND trim(difficulty) <> '' GROUP BY difficulty
"""

ORACLE["reject_rate"] = """
WITH d AS (SELECT o_orderpriority,
  CASE WHEN (CASE WHEN o_orderstatus = 'F' THEN 'Avslag' WHEN o_orderstatus = 'P' THEN 'Avslag etter klage '
                  ELSE 'Varig tillatelse' END) IN ('Avslag', 'Avslag etter klage ') THEN 1 ELSE 0 END AS y FROM orders)
SELECT o_orderpriority, CAST(sum(y) AS BIGINT) AS n_reject, round(avg(y), 6) AS reject_rate FROM d GROUP BY 1
"""

ORACLE["count_within_ref"] = """
WITH c AS (
  SELECT l_orderkey, l_linenumber,
    'P' || CAST(l_partkey AS VARCHAR) || ' S1D1 m' || CAST(l_extendedprice AS VARCHAR)
      || CASE WHEN l_linenumber = 5 THEN ' K1' ELSE '' END AS road_ref FROM lineitem),
p AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) || ' S1D1' AS road, l_extendedprice AS meter FROM lineitem),
cp AS (SELECT *, split_part(road_ref, ' m', 1) AS road,
              TRY_CAST(nullif(regexp_extract(road_ref, ' m([0-9.]+)', 1), '') AS DOUBLE) AS m FROM c)
SELECT l_orderkey, l_linenumber, road_ref,
  (SELECT count(*) FROM p WHERE p.road = cp.road AND abs(p.meter - cp.m) <= 500.0) AS n_within
FROM cp
"""

ORACLE["lookup_along_road"] = """
WITH obj AS (
  SELECT o_orderkey, 'R' || substr(o_orderpriority, 1, 1) AS road, (o_orderkey * 7919) % 1000003 AS a,
    (o_orderkey * 7919) % 1000003 + floor(o_totalprice * CASE WHEN o_orderkey % 50 = 0 THEN 2.0 ELSE 0.002 END) AS b FROM orders),
pos AS (SELECT DISTINCT 'R' || (l_linenumber % 7) AS road, CAST(floor(l_extendedprice * 10) AS BIGINT) % 1000003 AS m FROM lineitem),
best AS (SELECT pos.road, m, min(o_orderkey) AS k FROM pos JOIN obj ON pos.road = obj.road AND m BETWEEN a AND b GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, 'R' || (l_linenumber % 7) || ' m' || (CAST(floor(l_extendedprice * 10) AS BIGINT) % 1000003) AS road_ref,
  coalesce(CAST(k AS VARCHAR), '') AS first_order
FROM lineitem LEFT JOIN best ON best.road = 'R' || (l_linenumber % 7) AND best.m = CAST(floor(l_extendedprice * 10) AS BIGINT) % 1000003
"""

ORACLE["lookup_by_reference"] = """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS pr, o_orderstatus AS st, (o_orderkey % 10) * 100 AS lo,
                  (o_orderkey % 10) * 100 + CASE WHEN o_orderkey % 3 = 0 THEN 400 ELSE 0 END AS hi FROM orders),
first AS (
  SELECT c_custkey, arg_min(pr, o_orderkey) AS pr, arg_min(st, o_orderkey) AS st
  FROM customer JOIN o ON c_custkey = o_custkey AND (c_custkey % 5 = 0 OR 500 BETWEEN lo AND hi) GROUP BY c_custkey)
SELECT c.c_custkey, 'C' || CAST(c.c_custkey AS VARCHAR) || CASE WHEN c.c_custkey % 5 = 0 THEN '' ELSE ' m500' END AS road_ref,
       coalesce(f.pr, '') AS priority, coalesce(f.st, '') AS status
FROM customer c LEFT JOIN first f ON c.c_custkey = f.c_custkey
"""

ORACLE["stratified_split_missing"] = f"""
WITH om AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority FROM orders)
SELECT o_orderkey, priority, split FROM {_strat('om', 'priority', 0.2, 3)}
"""

ORACLE["oversample_missing"] = f"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS status FROM orders),
c AS (SELECT status, count(*) AS n FROM o WHERE status IS NOT NULL GROUP BY status),
r AS (SELECT o.*, row_number() OVER (PARTITION BY o.status ORDER BY {_h('o_orderkey', 5)}, o_orderkey) AS rn, c.n,
             (SELECT max(n) FROM c) AS mx FROM o JOIN c ON o.status = c.status),
k AS (SELECT o_orderkey, status, CAST(mx // n + CASE WHEN rn <= mx % n THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r
      UNION ALL SELECT o_orderkey, status, 1 FROM o WHERE status IS NULL)
SELECT o_orderkey, status, CAST(g.copy AS BIGINT) AS copy FROM k, LATERAL (SELECT unnest(range(1, copies + 1)) AS copy) g
"""

ORACLE["label_encode_many"] = """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer,
       CAST(dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS INTEGER) AS customer_code FROM orders
"""


def _n(text: str) -> str:
    """The number of a text key: the first 52 bits of its md5."""
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


_OT = f"""
ot AS (SELECT *, {_n('row_id')} AS k FROM (
  SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Avslag' ELSE 'Tillatelse' END AS label,
         sha256({_key_sql(_ORDER_KEY)}) AS row_id FROM orders) x)"""

ORACLE["split_text_keys"] = f"""
WITH {_OT}
SELECT o_orderkey, CASE WHEN {_u('k', 42)} < 0.6 THEN 'train' ELSE 'test' END AS part,
       CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_h('k', 7)}, row_id)
            <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM ot
"""

ORACLE["samples_text_keys"] = f"""
WITH {_OT}, c AS (SELECT label, count(*) AS n FROM ot GROUP BY label),
mi AS (SELECT count(*) AS n_min FROM ot WHERE label = 'Avslag'),
s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_h('k', 5)}, row_id) AS rs,
             row_number() OVER (PARTITION BY label ORDER BY {_h('k', 9)}, row_id) AS ro FROM ot),
bags AS (SELECT ot.*, b.bag, row_number() OVER (PARTITION BY b.bag, label ORDER BY {_h('(k * 1009 + b.bag)', 100)}, k * 1009 + b.bag, row_id) AS rb
         FROM ot, (SELECT unnest(range(1, 4)) AS bag) b)
SELECT o_orderkey, 'sample' AS way, CAST(1 AS BIGINT) AS n FROM s, mi WHERE label = 'Avslag' OR rs <= 2 * n_min
UNION ALL
SELECT o_orderkey, 'copies', CAST(mx // n + CASE WHEN ro <= mx % n THEN 1 ELSE 0 END AS BIGINT)
FROM s JOIN c USING (label), (SELECT max(n) AS mx FROM c) z
UNION ALL
SELECT o_orderkey, 'bag' || bag, CAST(1 AS BIGINT) FROM bags, mi WHERE label = 'Avslag' OR rb <= n_min
"""

ORACLE["csv_round_trip"] = """
SELECT doc_id AS case_id, q.quoted, md5(nullif(text, '')) AS text_md5, lang AS purpose, n_chars / 4.0 AS aadt_total,
       'a;"b" ' || source AS policy_class
FROM documents, (SELECT unnest([false, true]) AS quoted) q
"""

ORACLE["csv_bad_rows"] = """
SELECT c_custkey AS case_id, CASE WHEN c_nationkey <> 5 THEN c_mktsegment END AS decision,
       CASE WHEN c_nationkey NOT IN (3, 5) THEN CAST(c_nationkey AS DOUBLE) END AS nation,
       CASE c_nationkey WHEN 3 THEN 'too few cells' WHEN 5 THEN 'too many cells' END AS reason
FROM customer
"""

_PROMPTS = """
p AS (SELECT c_custkey AS case_id, c_mktsegment, 'c_mktsegment: ' || c_mktsegment || chr(10) || 'c_nationkey: ' || c_nationkey AS prompt
      FROM customer)"""

ORACLE["reply_intake"] = f"""
WITH {_PROMPTS}, m AS (SELECT max(conv_id) + 1 AS n FROM conversations),
inbox AS (
  SELECT sha256(prompt) AS k, turn, conv_id % 5 = 0 AND turn = 1 AS failed, conv_id % 7 = 0 AS plain, text
  FROM conversations, m JOIN p ON p.case_id % m.n = conv_id WHERE role = 'assistant' AND conv_id % 11 <> 0 AND turn <= 4),
ranked AS (
  SELECT *, CASE WHEN failed THEN NULL WHEN plain THEN text
                 ELSE '{{"approve":' || (len(text) % 2 = 0) || ',"reason":' || to_json(substr(text, 1, 40)) || '}}' END AS reply FROM inbox),
best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY failed, turn, reply) AS i FROM ranked)
SELECT case_id, CASE WHEN k IS NULL THEN 'open' WHEN failed THEN 'failed' ELSE 'answered' END AS status,
       CASE WHEN k IS NULL THEN NULL WHEN failed OR plain THEN 'Feil' WHEN len(text) % 2 = 0 THEN 'Godkjent' ELSE 'Avslag' END AS decision,
       CASE WHEN k IS NULL THEN NULL WHEN failed THEN 'timeout' WHEN plain THEN 'Ugyldig svar' ELSE substr(text, 1, 40) END AS reason,
       k IS NOT NULL AND NOT failed AND NOT plain AS valid
FROM p LEFT JOIN best ON sha256(prompt) = k AND i = 1
"""

ORACLE["reply_outbox"] = f"""
WITH {_PROMPTS}
SELECT DISTINCT sha256(prompt) AS prompt_key, prompt FROM p WHERE c_mktsegment <> 'BUILDING'
"""


def _poisson(u: str) -> str:
    """The count of thresholds of Poisson(1) at or below ``u``."""
    upto, out = 0.0, []
    for k in range(12):
        upto += math.exp(-1) / math.factorial(k)
        out.append(f"CAST({u} >= {upto!r} AS INTEGER)")
    return " + ".join(out)


ORACLE["bootstrap_weights"] = f"""
WITH u AS (SELECT bag, o_orderkey, o_orderpriority AS c, {_u('(o_orderkey % 1000003) * 1009 + bag', 3)} AS u
           FROM orders, (SELECT unnest(range(1, 5)) AS bag) b WHERE o_orderpriority IS NOT NULL),
d AS (SELECT *, {_poisson('u')} AS draws FROM u),
n AS (SELECT bag, c, sum(draws) AS nc FROM d WHERE draws > 0 GROUP BY bag, c),
t AS (SELECT bag, sum(nc) AS n, count(*) AS k FROM n GROUP BY bag)
SELECT CAST(bag AS INTEGER) AS bag, o_orderkey, draws, round(draws * (n / (k * nc)), 9) AS weight
FROM d JOIN n USING (bag, c) JOIN t USING (bag) WHERE draws > 0
"""

ORACLE["bag_ratios"] = f"""
WITH o AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS y FROM orders WHERE o_orderpriority IS NOT NULL),
m AS (SELECT count(*) AS n FROM o WHERE y),
r AS (SELECT bag, o_orderkey, y, row_number() OVER (PARTITION BY bag, y ORDER BY {_h('(o_orderkey * 1009 + bag)', 43)}, o_orderkey * 1009 + bag) AS i
      FROM o, (SELECT unnest(range(1, 7)) AS bag) b)
SELECT CAST(bag AS INTEGER) AS bag, CAST(count_if(y) AS BIGINT) AS minority, CAST(count_if(NOT y) AS BIGINT) AS majority, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM r, m WHERE y OR i <= floor(n * 0.5) GROUP BY bag
"""

ORACLE["argmax_class"] = """
WITH n AS (SELECT o_custkey, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o,
                  count_if(o_orderstatus = 'P') AS p, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN f >= o AND f >= p THEN 'F' WHEN o >= p THEN 'O' ELSE 'P' END AS pred_class,
       round(greatest(f, o, p) / n, 9) AS confidence FROM n
"""

ORACLE["similar_cases_default"] = ORACLE["similar_cases"]

ORACLE["similar_embeddings_default"] = ORACLE["similar_embeddings"]

ORACLE["object_snapshot"] = """
WITH pts AS (
  SELECT 'B' || right(p_brand, 1) AS road, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS meter FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT 'B0', CAST(p_size * 20 AS DOUBLE) FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 = 0)
SELECT s_suppkey, count(pts.meter) AS n_objects
FROM supplier LEFT JOIN pts ON pts.road = 'B' || (s_suppkey % 6) AND abs(pts.meter - CAST(s_suppkey * 7 % 1500 AS DOUBLE)) <= 500.0
GROUP BY s_suppkey
"""

ORACLE["stat_sinks"] = """
SELECT 'counts_o_orderstatus' AS stat_table, 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n
FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'counts_o_orderpriority', 'o_orderpriority', o_orderpriority, count(*)
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL
"""

ORACLE["threshold_store"] = f"""
SELECT CAST(2 AS INTEGER) AS stage, class, threshold, CAST(0.95 AS DOUBLE) AS target_precision FROM ({ORACLE["class_thresholds"]}) c
"""

ORACLE["source_headers"] = """
SELECT l_orderkey || '-' || l_linenumber AS key, l_orderkey AS case_id,
       CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS aadt_total, CAST(l_linenumber AS BIGINT) AS accesses,
       l_quantity AS curve_radius, CAST(NULL AS BIGINT) AS accidents, CAST(NULL AS VARCHAR) AS municipality
FROM lineitem
"""

ORACLE["ordered_columns"] = """
SELECT *, 'c_mktsegment,c_custkey,c_name,c_nationkey,c_acctbal' AS "order" FROM customer
"""
