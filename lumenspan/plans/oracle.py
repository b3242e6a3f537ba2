"""DuckDB SQL for the rows of ``queries``."""

from __future__ import annotations

from lumenspan.functions.scalars import POISSON_1
from lumenspan.plans.fixtures import SQL

#: Counts per distinct score of ``src`` (grp, score, y), cumulated from the highest score down.
ROC = """, cnt AS (SELECT grp, score, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM src GROUP BY grp, score),
roc AS (
  SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER (PARTITION BY grp) AS P, sum(neg) OVER (PARTITION BY grp) AS N
  FROM cnt WINDOW o AS (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
), auc AS (
  SELECT grp, sum(neg * (tp - pos / 2.0)) / nullif(max(P) * max(N), 0) AS auc, CAST(max(P) AS BIGINT) AS n_pos, CAST(max(N) AS BIGINT) AS n_neg FROM roc GROUP BY grp
)
"""


def src(select: str) -> str:
    return SQL + ", src AS (" + select + ")" + ROC


TOKENS = src("SELECT lang AS grp, logit AS score, y, 1 AS w FROM tok_scores")
EXAMPLES = src("SELECT 1 AS grp, score, y, 1 AS w FROM exs")


def hashed(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0)"


def merged(name: str, of: str, gap: int = 0) -> str:
    # Equal ranges are counted first, so that the order has no ties that two windows could break in two ways.
    return f""", {name}_0 AS (SELECT eid, s, e, count(*) AS k FROM ({of}) GROUP BY eid, s, e),
{name}_1 AS (SELECT *, max(e) OVER (PARTITION BY eid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {name}_0),
{name}_2 AS (SELECT *, sum(CASE WHEN s > reach + {gap} OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY eid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM {name}_1),
{name} AS (SELECT eid, i, min(s) AS s, max(e) AS e, CAST(sum(k) AS BIGINT) AS members FROM {name}_2 GROUP BY eid, i)
"""


def boot(scores: dict[str, str], draws: int, seed: int) -> str:
    weight = " + ".join(f"(u >= {c!r})::INT" for c in POISSON_1)
    out = SQL + f""", wt AS (
  SELECT draw, eid, {weight} AS w FROM (SELECT draw, eid, {hashed(str(seed), 'draw', 'eid')} AS u
  FROM (SELECT DISTINCT eid FROM tok_scores WHERE is_test), (SELECT unnest(range({draws})) AS draw))
)"""
    for i, (name, expr) in enumerate(scores.items()):
        out += f""", c{i} AS (
  SELECT draw, {expr} AS score, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM tok_scores JOIN wt USING (eid) WHERE w > 0 AND is_test GROUP BY draw, score
), r{i} AS (
  SELECT *, sum(pos) OVER (PARTITION BY draw ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(pos) OVER (PARTITION BY draw) AS P, sum(neg) OVER (PARTITION BY draw) AS N FROM c{i}
), a{i} AS (SELECT draw, sum(neg * (tp - pos / 2.0)) / nullif(max(P) * max(N), 0) AS {name} FROM r{i} GROUP BY draw)"""
    return out


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_BEST = {
    "g_mean": "sqrt(tp / nullif(P, 0) * (1 - fp / nullif(N, 0)))",
    "f1": "2.0 * tp / nullif(P + tp + fp, 0)",
    "accuracy": "(tp + N - fp) * 1.0 / nullif(P + N, 0)",
}


def best(objective: str) -> str:
    return TOKENS + f"""SELECT grp AS lang, round(score, 6) AS threshold, round(v, 6) AS {objective}
FROM (SELECT *, round({_BEST[objective]}, 12) AS v FROM roc) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY v DESC, score DESC) = 1"""


_METRICS = "(SELECT lang, count(*) FILTER (prob >= 0.5 AND y = 1) AS tp, count(*) FILTER (prob >= 0.5 AND y = 0) AS fp, count(*) FILTER (prob < 0.5 AND y = 1) AS fn, count(*) FILTER (prob < 0.5 AND y = 0) AS tn FROM tok_scores GROUP BY lang)"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"

ORACLE_SQL: dict[str, str] = {
    "s8_contiguous_shards": "SELECT doc_id, CAST(floor(((doc_id + 1) * 7 - 1) / (SELECT count(*) FROM documents)) AS BIGINT) AS shard FROM documents",
    "s9_modulo_shards": "SELECT doc_id % 8 AS shard, count(*) AS n FROM documents GROUP BY 1",
    "s10_merge_gates": "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_keys, count(*) - count(DISTINCT o_orderkey) AS n_repeated, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders",
    "s11_last_write_wins": "SELECT user_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "s18_row_violations": SQL + """, x AS (SELECT eid, code, CASE WHEN eid % 13 <> 0 THEN cwe END AS cwe, CASE WHEN eid % 17 <> 0 THEN row_label END AS row_label FROM ex)
SELECT eid, 'label is 0 or 1' AS rule FROM x WHERE row_label IS NULL OR row_label NOT IN (0, 1)
UNION ALL SELECT eid, 'code is not empty' FROM x WHERE length(coalesce(code, '')) = 0
UNION ALL SELECT eid, 'positive has a class' FROM x WHERE row_label = 1 AND cwe IS NULL
UNION ALL SELECT eid, 'negative has no class' FROM x WHERE row_label = 0 AND cwe IS NOT NULL""",
    "p4_cwe_keys": "SELECT doc_id, upper('cwe-' || lpad(substr(source, 4), 3, '0')) AS cwe, 'CWE-' || CAST(CAST(substr(source, 4) AS INT) AS VARCHAR) AS cwe_key FROM documents",
    "p7_group_keys": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'repo::' || source WHEN doc_id % 3 = 1 THEN 'func::::' || lang ELSE 'row::' || substr(sha1(text), 1, 12) END AS grp FROM documents""",
    "p8_paired_class": SQL + """SELECT eid, coalesce(CASE WHEN row_label = 1 THEN cwe END, p.c) AS paired_cwe FROM ex LEFT JOIN (SELECT grp, arg_max(cwe, eid) AS c FROM ex WHERE row_label = 1 AND cwe <> '' GROUP BY grp) p USING (grp)""",
    "p9_context_windows": SQL + """SELECT eid, tok, substr(code, CAST(cs AS BIGINT) + 1, CAST(ce - cs AS BIGINT)) AS surface,
  substr(code, CAST(greatest(0, cs - 48) + 1 AS BIGINT), CAST(ce + 48 - greatest(0, cs - 48) AS BIGINT)) AS context
FROM tok JOIN (SELECT eid, code FROM ex) USING (eid) WHERE length(word) >= 18""",
    "p15_null_safe_holdout": SQL + "SELECT CASE WHEN cwe IS NOT DISTINCT FROM 'CWE-003' THEN 'test' ELSE 'train' END AS side, count(*) AS n FROM ex GROUP BY 1",
    "j1_span_tokens": SQL + """, q AS (SELECT eid, greatest(0, s - 3) AS s, e + 3 AS e FROM spans WHERE key = 'sink'),
h AS (SELECT q.eid, q.s, q.e, min(tok) AS a, max(tok) AS b FROM tok JOIN q ON tok.eid = q.eid AND ce > s AND cs < e GROUP BY q.eid, q.s, q.e)
SELECT eid, count(*) AS n_spans, CAST(sum(a) AS BIGINT) AS first_sum, CAST(sum(b) AS BIGINT) AS last_sum FROM h GROUP BY eid""",
    "j2_token_labels": SQL + """SELECT eid, count(*) AS n, CAST(sum(CASE WHEN y THEN 1 ELSE 0 END) AS BIGINT) AS n_pos
FROM (SELECT t.eid, t.tok, EXISTS (SELECT 1 FROM spans s WHERE s.key = 'evidence' AND s.eid = t.eid AND s.s < t.ce AND s.e > t.cs) AS y FROM tok t) GROUP BY eid""",
    "j5_ordinal_pairs": SQL + "SELECT grp, rn, vuln_eid, safe_eid FROM pairs",
    "j11_member_combine": SQL + "SELECT eid, round(max(score), 6) AS best, round(avg(score), 6) AS mean, count(score) AS n_members FROM member_scores WHERE score IS NOT NULL GROUP BY eid",
    "j16_nearest_span": SQL + """, a AS (SELECT eid, s, e FROM spans WHERE key = 'sink'), b AS (SELECT eid, s AS s2, e AS e2 FROM spans WHERE key = 'sanitizer'),
d AS (SELECT a.eid, a.s, min(greatest(0, s2 - e, s - e2)) AS d FROM a LEFT JOIN b ON a.eid = b.eid GROUP BY a.eid, a.s),
f AS (SELECT d.eid, d.s, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.eid = d.eid) THEN d END AS d FROM d)
SELECT eid, count(*) AS n, CAST(sum(d) AS BIGINT) AS total, max(d) AS longest FROM f GROUP BY eid""",
    "j17_line_of_offset": SQL + """SELECT eid, CAST(off AS BIGINT) AS off, CAST(1 + length(b) - length(replace(b, chr(10), '')) AS BIGINT) AS line
FROM (SELECT eid, off, substr(code, 1, greatest(off, 0)) AS b FROM ex, (SELECT unnest([-1, 0, 200, 1000]) AS off))""",
    "w5_merged_spans": SQL + merged("m", "SELECT eid, s, e + 1 AS e FROM spans") + "SELECT eid, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS chars, CAST(sum(members) AS BIGINT) AS members FROM m GROUP BY eid",
    "w6_merged_with_gap": SQL + merged("m", "SELECT eid, s, e FROM spans", 2) + "SELECT eid, count(*) AS n, max(members) AS most FROM m GROUP BY eid",
    "u2_span_difference": SQL + """, a AS (SELECT DISTINCT eid, unnest(range(s, e + 4)) AS p FROM spans WHERE key = 'sink'), b AS (SELECT DISTINCT eid, unnest(range(s, e)) AS p FROM spans WHERE key = 'sanitizer')
SELECT eid, count(*) AS chars FROM a ANTI JOIN b USING (eid, p) GROUP BY eid""",
    "u3_live_ranges": SQL + merged("m", "SELECT eid, s, e FROM spans WHERE key = 'evidence'") + """, edges AS (SELECT eid, s AS pos, e AS nx FROM m UNION ALL SELECT eid, length(code), NULL FROM ex),
g AS (SELECT eid, pos, coalesce(lag(nx) OVER (PARTITION BY eid ORDER BY pos, nx NULLS LAST), 0) AS s FROM edges)
SELECT eid, count(*) AS n, CAST(sum(pos - s) AS BIGINT) AS chars FROM g WHERE s < pos GROUP BY eid""",
    "w4_islands": SQL + """, i AS (SELECT eid, tok, tok - row_number() OVER (PARTITION BY eid ORDER BY tok) AS k FROM tok_scores WHERE y = 1),
r AS (SELECT eid, k, max(tok) - min(tok) + 1 AS n FROM i GROUP BY eid, k)
SELECT eid, count(*) AS n, max(n) AS longest FROM r GROUP BY eid""",
    "w7_soft_labels": SQL + """, d AS (SELECT eid, tok, CASE WHEN y = 1 THEN tok END AS p FROM tok_scores),
n AS (SELECT eid, tok, last_value(p IGNORE NULLS) OVER (PARTITION BY eid ORDER BY tok ROWS UNBOUNDED PRECEDING) AS b,
  first_value(p IGNORE NULLS) OVER (PARTITION BY eid ORDER BY tok ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM d)
SELECT eid, round(sum(coalesce(greatest(0.0, 1 - least(tok - b, a - tok) / 4.0), 0.0)), 6) AS soft FROM n GROUP BY eid""",
    "w8_dilation": SQL + """SELECT eid, CAST(sum(m) AS BIGINT) AS n FROM (SELECT eid, max(y) OVER (PARTITION BY eid ORDER BY tok ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM tok_scores) GROUP BY eid""",
    "a1_token_auc": TOKENS + "SELECT grp AS lang, round(auc, 6) AS auc, n_pos, n_neg FROM auc",
    "a1_example_auc": EXAMPLES + "SELECT round(auc, 6) AS auc, n_pos, n_neg FROM auc",
    "a3_confusion": SQL + f"""SELECT lang, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(sqrt(coalesce(tp / nullif(tp + fn, 0), 0) * coalesce(tn / nullif(tn + fp, 0), 0)), 6) AS g_mean FROM {_METRICS}""",
    "a5_best_gmean": best("g_mean"),
    "a6_best_accuracy": best("accuracy"),
    "a10_best_f1": best("f1"),
    "a7_recall_at_fpr": EXAMPLES + """, v AS (SELECT *, coalesce((fp - coalesce(lag(fp) OVER o, 0)) * (lead(tp) OVER o - tp) <> (lead(fp) OVER o - fp) * (tp - coalesce(lag(tp) OVER o, 0)), TRUE) AS keep
  FROM roc WINDOW o AS (PARTITION BY grp ORDER BY fp, tp))
SELECT """ + ", ".join(f"round(coalesce(max(CASE WHEN fp <= N * {t / 100} THEN tp END) / max(P), 0), 6) AS recall_at_{t}" for t in (1, 5, 10, 20)) + " FROM v WHERE keep",
    "a8_tpr_at_fpr": TOKENS + """, p AS (SELECT grp, fp, P, N, max(tp) AS tp FROM roc GROUP BY grp, fp, P, N),
q AS (SELECT *, lead(fp) OVER o AS fp2, lead(tp) OVER o AS tp2, row_number() OVER o AS i, N * 0.05 AS x FROM p WINDOW o AS (PARTITION BY grp ORDER BY fp))
SELECT grp AS lang, round(coalesce(max(CASE WHEN fp <= x AND fp2 > x THEN tp + (tp2 - tp) * (x - fp) / (fp2 - fp) END), max(CASE WHEN i = 1 AND fp > x THEN tp * x / fp END), max(tp)) / max(P), 6) AS tpr,
  round(coalesce(max(CASE WHEN fp <= floor(x) THEN tp END), 0) / max(P), 6) AS tpr_discrete FROM q GROUP BY grp""",
    "a9_global_threshold_recall": SQL + """, neg AS (SELECT logit, row_number() OVER (ORDER BY logit DESC) AS i, count(*) OVER () AS n FROM tok_scores WHERE y = 0),
thr AS (SELECT logit AS t FROM neg WHERE i = floor(n * 0.01) + 1)
SELECT lang, round(avg(CASE WHEN logit > t THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS n FROM tok_scores, thr WHERE y = 1 GROUP BY lang""",
    "a12_calibration": SQL + """, b AS (SELECT lang, CASE WHEN floor(prob * 15) < 15 THEN floor(prob * 15) END AS bin, count(*) AS n, sum(prob) AS p, sum(y) AS y, sum((prob - y) * (prob - y)) AS sq FROM tok_scores GROUP BY 1, 2)
SELECT lang, round(sum(sq) / sum(n), 6) AS brier, round(sum(CASE WHEN bin IS NOT NULL THEN abs(p - y) ELSE 0 END) / sum(n), 6) AS ece FROM b GROUP BY lang""",
    "a13_reliability": SQL + """SELECT CAST(i AS BIGINT) AS bin, round((i + 0.5) / 10, 6) AS centre, round(a, 6) AS accuracy, coalesce(n, 0) AS n
FROM (SELECT unnest(range(10)) AS i) LEFT JOIN (SELECT CAST(least(floor(prob * 10), 9) AS BIGINT) AS b, avg(y) AS a, count(*) AS n FROM tok_scores GROUP BY 1) ON i = b""",
    "a14_pooling": SQL + """, t AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY logit DESC, tok) AS r FROM tok_scores)
SELECT eid, round(max(logit), 6) AS max_all, round(coalesce(max(logit) FILTER (is_code), max(logit)), 6) AS max_code, round(coalesce(avg(logit) FILTER (is_code), avg(logit)), 6) AS mean_code,
  round(avg(logit) FILTER (r <= 5), 6) AS top_mean, round(arg_max(logit, tok), 6) AS last, CAST(max(y) AS BIGINT) AS y FROM t GROUP BY eid""",
    "a16_span_max": SQL + """, i AS (SELECT eid, prob, tok - row_number() OVER (PARTITION BY eid ORDER BY tok) AS k FROM tok_scores WHERE y = 1),
m AS (SELECT eid, k, max(prob) AS p FROM i GROUP BY eid, k) SELECT eid, count(*) AS n_spans, round(avg(p), 6) AS mean_score FROM m GROUP BY eid""",
    "a17_slice_auc": src("""SELECT cwe AS grp, score, y, 1 AS w FROM exs WHERE y = 1
UNION ALL SELECT c.cwe, score, y, 1 FROM exs, (SELECT DISTINCT cwe FROM exs WHERE cwe IS NOT NULL) c WHERE y = 0
UNION ALL SELECT 'all', score, y, 1 FROM exs UNION ALL SELECT 'lang::' || lang, score, y, 1 FROM exs""") + "SELECT grp AS slice, round(auc, 6) AS auc, n_pos, n_neg FROM auc",
    "a18_macro_auc": src("SELECT eid AS grp, logit AS score, y, 1 AS w FROM tok_scores") + "SELECT round(avg(auc), 6) AS macro_auc, count(auc) AS n FROM auc",
    "a19_pair_accuracy": SQL + """SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 ELSE 0 END), 6) AS strict, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS half_ties, count(*) AS n_pairs
FROM pairs JOIN exs a ON a.eid = vuln_eid JOIN exs b ON b.eid = safe_eid""",
    "a20_transfer_blocks": src(f"""WITH cl AS (SELECT unnest(range(9)) AS k),
    d AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(x) AS v FROM acts),
    wv AS (SELECT k AS train, i, avg(v) FILTER (label = k) - avg(v) FILTER (label <> k) AS w FROM d, cl GROUP BY k, i),
    sc AS (SELECT train, vec_id, any_value(label) AS label, round(sum(v * w), 9) AS score FROM d JOIN wv USING (i) GROUP BY train, vec_id)
    SELECT {{'train': train, 'test': k}} AS grp, score, CASE WHEN label <> 9 THEN 1 ELSE 0 END AS y, 1 AS w FROM sc, cl WHERE label = k OR label = 9""") + """
SELECT CASE WHEN grp.train < 4 THEN 'low' ELSE 'high' END AS train_family, CASE WHEN grp.test < 4 THEN 'low' ELSE 'high' END AS test_family,
  round(sum(auc * n_pos) / sum(n_pos), 6) AS mean_all, round(sum(auc * n_pos) FILTER (grp.train <> grp.test) / sum(n_pos) FILTER (grp.train <> grp.test), 6) AS mean_off_diagonal
FROM auc WHERE auc IS NOT NULL GROUP BY 1, 2""",
    "a25_retrieval": SQL + """, ld AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY coalesce(rank, 1000000000), lead_id) AS pos FROM leads),
h AS (SELECT l.repo_id, l.pos, t.trace_id FROM ld l JOIN traces t ON l.repo_id = t.repo_id AND l.file = t.file AND l.start_line <= t.end_line AND l.end_line >= t.start_line),
rp AS (SELECT repo_id, count(*) AS nt FROM traces GROUP BY 1), sz AS (SELECT repo_id, count(*) AS nl FROM ld GROUP BY 1)
SELECT rp.repo_id, min(pos) AS first_hit, round(coalesce(1.0 / min(pos), 0), 6) AS rr, """ + ", ".join(
        f"CAST(CASE WHEN count(*) FILTER (pos <= {k}) > 0 THEN 1 ELSE 0 END AS BIGINT) AS hit_at_{k}, round(count(DISTINCT CASE WHEN pos <= {k} THEN trace_id END) / any_value(nt), 6) AS trace_recall_at_{k}, round(count(DISTINCT CASE WHEN pos <= {k} THEN pos END) / least(any_value(nl), {k}), 6) AS precision_at_{k}"
        for k in (1, 3, 10)
    ) + " FROM rp LEFT JOIN h USING (repo_id) LEFT JOIN sz ON sz.repo_id = rp.repo_id GROUP BY rp.repo_id",
    "a27_score_summary": SQL + """SELECT CAST(y AS BIGINT) AS y, round(avg(logit), 6) AS mean, round(stddev_pop(logit), 6) AS std, round(quantile_cont(logit, 0.1), 6) AS p10, round(quantile_cont(logit, 0.5), 6) AS median, round(quantile_cont(logit, 0.9), 6) AS p90,
  round(min(logit), 6) AS lo, round(max(logit), 6) AS hi, count(*) AS n FROM tok_scores GROUP BY y""",
    "a28_length_correlation": SQL + "SELECT round(corr(s, n), 6) AS pearson FROM (SELECT max(logit) AS s, CAST(count(*) AS DOUBLE) AS n FROM tok_scores GROUP BY eid)",
    "a30_clustered_bootstrap": boot({"v": "logit"}, 40, 7) + "SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, count(v) AS n_draws FROM a0",
    "a33_paired_bootstrap": boot({"v": "logit", "o": "CAST(length(word) AS DOUBLE)"}, 20, 11) + "SELECT round(avg(v - o), 6) AS mean, round(quantile_cont(v - o, 0.025), 6) AS lo, round(quantile_cont(v - o, 0.975), 6) AS hi, count(v - o) AS n_draws FROM a0 JOIN a1 USING (draw)",
    "a36_wilson": SQL + """SELECT lang, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS lo, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS hi
FROM (SELECT lang, avg(row_label) AS p, CAST(count(*) AS DOUBLE) AS n FROM ex GROUP BY lang)""",
    "a37_language_null": src("SELECT 1 AS grp, CASE WHEN lang IN ('de', 'fr') THEN 1.0 ELSE 0.0 END AS score, y, 1 AS w FROM tok_scores") + "SELECT round(auc, 6) AS auc, n_pos, n_neg FROM auc",
    "a42_code_contrast": src("SELECT 'tokens' AS grp, logit AS score, y, 1 AS w FROM tok_scores UNION ALL SELECT 'tokens_code', logit, y, 1 FROM tok_scores WHERE is_code") + "SELECT grp AS level, round(auc, 6) AS auc, n_pos, n_neg FROM auc",
    "a24_class_counts": SQL + "SELECT cwe, count(*) AS n, min(eid) AS first_eid FROM ex WHERE row_label = 1 AND cwe IS NOT NULL GROUP BY cwe ORDER BY n DESC, first_eid LIMIT 5",
    "f6_probe_scores": SQL + """, d AS (SELECT vec_id, layer, y, unnest(range(1, 65)) AS i, unnest(x) AS v FROM acts),
wv AS (SELECT layer, i, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS w FROM d GROUP BY layer, i)
SELECT vec_id, round(sum(v * w), 6) AS score, round(sum(v * w) / (sqrt(sum(v * v)) * sqrt(sum(w * w))), 6) AS cosine FROM d JOIN wv USING (layer, i) GROUP BY vec_id""",
    "f8_span_max_loss": SQL + """, b AS (SELECT eid, tok, logit, greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit))) AS l FROM tok_scores),
m AS (SELECT eid, avg(l) AS a FROM b GROUP BY eid), t AS (SELECT eid, l FROM b QUALIFY row_number() OVER (PARTITION BY eid ORDER BY logit DESC, tok) = 1)
SELECT eid, round(0.5 * a + 0.5 * l, 6) AS loss FROM m JOIN t USING (eid)""",
    "f5_logit_aggregation": SQL + "SELECT vec_id, round(list_max(x) + ln(list_sum(list_transform(x, lambda v: exp((v - list_max(x)) * 4)))) / 4, 6) AS lse, round(list_max(x), 6) AS top FROM acts",
    "f10_pattern_counts": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS numbers, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS BIGINT) AS capitalised, CAST(len(regexp_extract_all(text, '[.,;]')) AS BIGINT) AS marks FROM documents",
    "f22_char_ngrams": SQL + """SELECT gram, count(*) AS n FROM (SELECT substr(c, i, 3) AS gram FROM (SELECT c, unnest(range(1, length(c) - 1)) AS i FROM (SELECT code AS c FROM ex))) GROUP BY gram ORDER BY n DESC, gram LIMIT 50""",
    "f24_json_fields": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN '{}' ELSE '{\"k\":' || json_extract_string(props, '$.k') || '}' END AS again FROM events",
    "j6_adjacent_pairs": SQL + """, n AS (SELECT grp, row_label, row_number() OVER (PARTITION BY grp ORDER BY eid) - 1 AS i FROM ex),
p AS (SELECT a.grp, coalesce(a.row_label = 1 AND b.row_label = 0, FALSE) AS ok FROM n a LEFT JOIN n b ON b.grp = a.grp AND b.i = a.i + 1 WHERE a.i % 2 = 0)
SELECT grp, count(*) FILTER (ok) AS n_pairs, count(*) FILTER (NOT ok) AS n_rejected FROM p GROUP BY grp""",
    "j13_span_meets_live": SQL + """SELECT eid, EXISTS (SELECT 1 FROM spans a WHERE a.eid = ex.eid AND key = 'sink') AND (NOT EXISTS (SELECT 1 FROM spans a WHERE a.eid = ex.eid AND key = 'evidence')
  OR EXISTS (SELECT 1 FROM spans a JOIN spans b ON a.eid = b.eid AND a.s < b.e AND a.e > b.s WHERE a.key = 'sink' AND b.key = 'evidence' AND a.eid = ex.eid)) AS subtractive FROM ex""",
    "j18_negative_pools": src("""SELECT pool AS grp, score, y, 1 AS w FROM exs, (SELECT unnest(['all_clean', 'english_only', 'matched']) AS pool)
WHERE y = 1 OR pool = 'all_clean' OR (pool = 'english_only' AND lang = 'en') OR (pool = 'matched' AND eid IN (SELECT safe_eid FROM pairs))""") + "SELECT grp AS pool, round(auc, 6) AS auc, n_pos, n_neg FROM auc",
    "a22_agreement": SQL + "SELECT n_models, count(*) AS n, min(eid) AS first_eid FROM (SELECT eid, count(*) FILTER (score >= 0.5) AS n_models FROM member_scores GROUP BY eid) GROUP BY n_models",
    "a23_false_alarm_kinds": SQL + """, t AS (SELECT eid, row_label, cs AS s, ce AS e FROM tok_scores WHERE y = 0 AND logit >= 4),
d AS (SELECT t.eid, t.row_label, (SELECT min(greatest(0, k.s - t.e, t.s - k.e)) FROM spans k WHERE k.key = 'sink' AND k.eid = t.eid) AS d FROM t)
SELECT CASE WHEN row_label = 0 THEN 'safe_alarm' WHEN d <= 40 THEN 'spread' ELSE 'misplaced' END AS kind, count(*) AS n, count(DISTINCT eid) AS n_examples FROM d GROUP BY 1""",
    "o5_top_per_kind": SQL + """SELECT lang, eid, n_models, row_number() OVER (PARTITION BY lang ORDER BY n_models DESC, eid) AS place
FROM (SELECT eid, count(*) FILTER (score >= 0.5) AS n_models FROM member_scores GROUP BY eid) JOIN ex USING (eid) QUALIFY place <= 15""",
    "o7_hardest_examples": SQL + """SELECT CAST(y AS BIGINT) AS y, eid, round(score, 6) AS score, row_number() OVER (PARTITION BY y ORDER BY CASE WHEN y = 1 THEN score ELSE -score END, eid) AS place FROM exs QUALIFY place <= 2""",
    "x1_random_split": SQL + f""", o AS (SELECT *, row_number() OVER (PARTITION BY row_label ORDER BY {hashed('7', 'eid')}, eid) AS i, count(*) OVER (PARTITION BY row_label) AS n FROM ex)
SELECT CAST(row_label AS BIGINT) AS row_label, CASE WHEN i <= round(n * 0.2) THEN 'test' ELSE 'train' END AS side, count(*) AS n, CAST(sum(eid) AS BIGINT) AS ids FROM o GROUP BY 1, 2""",
    "x6_group_holdout": SQL + f""", g AS (SELECT DISTINCT grp FROM ex), o AS (SELECT grp, row_number() OVER (ORDER BY {hashed('42', 'grp')}, grp) AS i, count(*) OVER () AS n FROM g)
SELECT eid, grp, CASE WHEN i <= greatest(1, round(0.2 * n)) THEN 'test' ELSE 'train' END AS side FROM ex JOIN o USING (grp)""",
    "x8_group_folds": SQL + f""", g AS (SELECT DISTINCT grp FROM ex), o AS (SELECT grp, ntile(5) OVER (ORDER BY {hashed('42', 'grp')}, grp) AS fold FROM g) SELECT eid, fold FROM ex JOIN o USING (grp)""",
    "x3_leave_one_class_out": SQL + """, h AS (SELECT cwe AS held, count(*) AS n, min(eid) AS f FROM ex WHERE row_label = 1 AND cwe IS NOT NULL GROUP BY cwe ORDER BY n DESC, f LIMIT 5)
SELECT 'heldout_cwe::' || held AS split_name, CASE WHEN cwe IS NOT DISTINCT FROM held THEN 'test' ELSE 'train' END AS side, count(*) AS n, CAST(sum(row_label) AS BIGINT) AS n_pos FROM ex, h GROUP BY 1, 2""",
    "x4_leave_one_language_out": SQL + """SELECT 'heldout_lang::' || held AS split_name, CASE WHEN lang = held THEN 'test' ELSE 'train' END AS side, count(*) AS n, CAST(sum(row_label) AS BIGINT) AS n_pos
FROM ex, (SELECT DISTINCT lang AS held FROM ex) GROUP BY 1, 2""",
    "x9_oversample": SQL + """, k AS (SELECT CAST(least(round(count(*) FILTER (lang = 'en') / count(*) FILTER (lang = 'es')), 8) AS BIGINT) AS k, max(eid) + 1 AS step FROM ex)
SELECT lang, count(*) AS n, CAST(sum(eid) AS BIGINT) AS ids FROM (SELECT eid + step * i AS eid, lang FROM (SELECT eid, lang, step, unnest(range(k)) AS i FROM ex, k WHERE lang = 'es') UNION ALL SELECT eid, lang FROM ex WHERE lang <> 'es') GROUP BY lang""",
}
