"""Queries that build corpora: the repository benchmark with its decoys, and missed and spurious spans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenspan.operators import intervals as I
from lumenspan.operators import lines as N
from lumenspan.operators import ranking as R
from lumenspan.operators import retrieval
from lumenspan.operators import splits as X
from lumenspan.plans.fixtures import SQL
from lumenspan.plans.oracle import hashed, merged, src
from lumenspan.plans.registry import longs, query, r6
from lumenspan.store import staged

DECOYS = 40

#: Decoys of the positives in the other engine: rings of a language and of all, a positive's own group cut out.
_DECOYS = SQL + f""", nk AS (SELECT eid AS decoy, grp, lang, {hashed('7', 'grp')} AS h FROM ex WHERE row_label = 0 AND trim(code) <> ''),
ring AS (SELECT '=' || lang AS ring, grp, decoy, row_number() OVER (PARTITION BY lang ORDER BY h, decoy) AS pos FROM nk UNION ALL SELECT '*', grp, decoy, row_number() OVER (ORDER BY h, decoy) FROM nk),
rs AS (SELECT ring, count(*) AS size FROM ring GROUP BY 1), rb AS (SELECT ring, grp, min(pos) - 1 AS f, max(pos) - min(pos) + 1 AS own FROM ring GROUP BY 1, 2),
pp AS (SELECT eid, r.ring, coalesce(own, 0) AS own, coalesce(f, size) AS f, size - coalesce(own, 0) AS pool FROM (SELECT eid, grp, unnest(['=' || lang, '*']) AS ring FROM ex WHERE row_label = 1) r JOIN rs USING (ring) LEFT JOIN rb ON rb.ring = r.ring AND rb.grp = r.grp),
pc AS (SELECT * FROM pp WHERE TRUE QUALIFY row_number() OVER (PARTITION BY eid ORDER BY CASE WHEN ring <> '*' AND pool >= {DECOYS} THEN 0 WHEN ring = '*' THEN 1 ELSE 2 END) = 1),
pe AS (SELECT *, floor({hashed('7', 'eid')} * pool) AS st, least({DECOYS}, pool) AS k, unnest(range(1, CAST(least({DECOYS}, pool) + 1 AS BIGINT))) AS place FROM pc WHERE pool > 0),
pa AS (SELECT eid, ring, place, CAST((st + (place - 1) * (pool // k)) % pool AS BIGINT) AS a, f, own FROM pe),
dec AS (SELECT pa.eid, ring.decoy, pa.place FROM pa JOIN ring ON ring.ring = pa.ring AND ring.pos = a + CASE WHEN a >= f THEN own ELSE 0 END + 1)
"""


def _decoys(v):
    x = v.ex
    return X.sampled_decoys(x.where("row_label = 1"), x.where("row_label = 0 and trim(code) <> ''"), DECOYS, 7)


@query(_DECOYS + "SELECT eid, decoy, CAST(place AS BIGINT) AS place FROM dec")
def j15_sampled_decoys(v):
    """Exactly as many decoys as asked for, from other languages where a positive's own has too few."""
    return _decoys(v).select("eid", "decoy", *longs("place"))


@query(_DECOYS + merged("m", "SELECT eid, s, e FROM spans WHERE key = 'sink'") + """, sz AS (SELECT eid, greatest(1, length(code) - length(replace(code, chr(10), '')) + CASE WHEN suffix(code, chr(10)) THEN 0 ELSE 1 END) AS n FROM ex),
tr AS (SELECT m.eid, 1 + length(substr(code, 1, m.s)) - length(replace(substr(code, 1, m.s), chr(10), '')) AS a, 1 + length(substr(code, 1, greatest(m.e - 1, 0))) - length(replace(substr(code, 1, greatest(m.e - 1, 0)), chr(10), '')) AS b FROM m JOIN ex USING (eid) WHERE row_label = 1),
fl AS (SELECT eid, 'vulnerable' AS role, eid AS src FROM ex WHERE row_label = 1 UNION ALL SELECT vuln_eid, 'fixed_counterpart', safe_eid FROM pairs UNION ALL SELECT eid, 'safe_decoy', decoy FROM dec),
f AS (SELECT fl.eid, count(*) AS n_files, count(*) FILTER (role = 'fixed_counterpart') AS n_fixed, count(*) FILTER (role = 'safe_decoy') AS n_decoys, sum(src) AS sources, sum(n) FILTER (role <> 'vulnerable') AS negative_lines FROM fl JOIN sz ON sz.eid = fl.src GROUP BY 1),
t AS (SELECT eid, count(*) AS n_traces, sum(a) AS first_lines, sum(b) AS last_lines FROM tr GROUP BY 1)
SELECT eid AS repo_id, n_files, n_fixed, n_decoys, CAST(sources AS BIGINT) AS sources, CAST(coalesce(negative_lines, 0) AS BIGINT) AS negative_lines, coalesce(n_traces, 0) AS n_traces, CAST(coalesce(first_lines, 0) AS BIGINT) AS first_lines, CAST(coalesce(last_lines, 0) AS BIGINT) AS last_lines
FROM f LEFT JOIN t USING (eid)""")
def c15_benchmark_build(v):
    """The benchmark's manifests, nested; what they hold is counted and summed here so that rows can be compared."""
    x = v.ex
    positives = x.where("row_label = 1").select("eid", "cwe", "lang")
    own = x.where("row_label = 1").select("eid", "code")
    line_feeds = F.length("code") - F.length(F.replace("code", F.lit("\n"), F.lit("")))
    sizes = x.select("eid", F.greatest(F.lit(1), line_feeds + F.when(F.col("code").endswith("\n"), 0).otherwise(1)).cast("long").alias("n_lines"))
    spans = I.merge_spans(v.spans.where("key = 'sink'").join(positives.select("eid"), "eid", "left_semi").select("eid", "s", "e"), ["eid"])
    starts = N.lines(own).select("eid", F.col("s").alias("at"), F.col("line_no").cast("long").alias("value"))
    points = spans.select("eid", F.explode(F.array(F.struct(F.col("s").alias("at"), F.col("s").alias("point")), F.struct((F.col("e") - 1).alias("at"), (-F.col("s") - 1).alias("point")))).alias("p"))
    found = N.last_before(points.select("eid", F.col("p.at").cast("long").alias("at"), F.col("p.point").cast("long").alias("point")), starts, "eid")
    first, last = found.where("point >= 0"), found.where("point < 0").withColumn("point", -F.col("point") - 1)
    traces = first.select("eid", "point", F.col("value").alias("start_line")).join(last.select("eid", "point", F.col("value").alias("end_line")), ["eid", "point"])
    fixed = v.pairs.select(F.col("vuln_eid").alias("eid"), "safe_eid")
    m = retrieval.benchmark_manifest(positives, fixed, _decoys(v), sizes, traces)
    count = lambda role: F.size(F.filter("files", lambda f: f["role"] == role))
    total = lambda a, field: F.aggregate(a, F.lit(0).cast("long"), lambda s, e: s + e[field])
    return m.select(
        "repo_id", *(c.cast("long").alias(n) for n, c in {
            "n_files": F.size("files"), "n_fixed": count("fixed_counterpart"), "n_decoys": count("safe_decoy"), "sources": total("files", "source_row"),
            "negative_lines": total("negative_regions", "end_line"), "n_traces": F.size("traces"), "first_lines": total("traces", "start_line"), "last_lines": total("traces", "end_line"),
        }.items())
    )


# missed and spurious spans of several models

NEAR = 40
#: Spans of each kind in the sample, and of how many models they have to be.
CAPS = {"safe_alarm": (50, 2), "spread": (45, 2), "misplaced": (35, 1)}

_MODELS = "SELECT t.*, m, logit + ((eid * 31 + tok * 17 + m * 7) % 13) / 6.0 - 1 AS z FROM tok_scores t, (SELECT unnest([0, 1, 2]) AS m)"
_SPANS_SQL = src(f"SELECT m AS grp, round(z, 9) AS score, y, 1 AS w FROM ({_MODELS}) WHERE NOT is_test") + f""", th AS (
  SELECT grp AS m, score AS thr FROM (SELECT *, round(2.0 * tp / nullif(P + tp + fp, 0), 12) AS v FROM roc) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY v DESC, score DESC) = 1
), pr AS (SELECT eid, tok, m, cs, ce, y, row_label, round(z, 9) - thr AS margin FROM ({_MODELS}) JOIN th USING (m) WHERE is_test AND round(z, 9) >= thr)
""" + merged("tr", "SELECT eid, cs AS s, ce AS e FROM tok_scores WHERE is_test AND y = 1") + """, hit AS (SELECT tr.eid, tr.s, tr.e, count(DISTINCT pr.m) AS n_models FROM tr LEFT JOIN pr ON pr.eid = tr.eid AND pr.y = 1 AND pr.cs < tr.e AND pr.ce > tr.s GROUP BY 1, 2, 3),
miss AS (SELECT h.eid, h.s, h.e, h.n_models, (SELECT min(greatest(0, p.cs - h.e, h.s - p.ce)) FROM pr p WHERE p.eid = h.eid) AS d FROM hit h WHERE n_models < 3),
fp0 AS (SELECT *, max(ce) OVER (PARTITION BY eid, m ORDER BY cs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pr WHERE y = 0),
fp1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR cs > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY eid, m ORDER BY cs ROWS UNBOUNDED PRECEDING) AS i FROM fp0),
fp2 AS (SELECT eid, m, i, min(cs) AS s, max(ce) AS e, max(margin) AS margin, any_value(row_label) AS row_label FROM fp1 GROUP BY 1, 2, 3),
fp3 AS (SELECT eid, s, e, count(*) AS n_models, max(margin) AS margin, any_value(row_label) AS row_label FROM fp2 GROUP BY 1, 2, 3),
fa AS (SELECT *, CASE WHEN row_label = 0 THEN 'safe_alarm' WHEN (SELECT min(greatest(0, k.s - f.e, f.s - k.e)) FROM tr k WHERE k.eid = f.eid) <= 40 THEN 'spread' ELSE 'misplaced' END AS kind FROM fp3 f)
"""


def _models(v):
    """Test tokens that one of three models takes for positive, with their margin, and the true spans."""
    m = F.explode(F.array(*map(F.lit, range(3)))).alias("m")
    t = v.tok_scores.select("eid", "tok", "cs", "ce", "y", "row_label", "is_test", "logit", m)
    t = t.withColumn("z", F.round(F.col("logit") + ((F.col("eid") * 31 + F.col("tok") * 17 + F.col("m") * 7) % 13) / 6.0 - 1, 9))
    roc = R.cumulative(R.score_counts(t.where("not is_test"), ["m"], "z", "y"), ["m"])
    thr = R.best_threshold(roc, ["m"], "f1").select("m", "threshold")
    found = t.where("is_test").join(F.broadcast(thr), "m").where("z >= threshold")
    found = staged(found.select("eid", "m", F.col("cs").cast("long").alias("s"), F.col("ce").cast("long").alias("e"), "y", "row_label", (F.col("z") - F.col("threshold")).alias("margin")), "fired")
    true = v.tok_scores.where("is_test and y = 1").select("eid", F.col("cs").alias("s"), F.col("ce").alias("e"))
    return found, staged(I.merge_spans(true, ["eid"]).select("eid", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")), "true-spans")


def _alarms(found, true):
    """(eid, s, e, n_models, margin, kind): false alarms merged over gaps of two characters in each model; equal spans of
    several models are one."""
    by = found.where("y = 0").select("eid", "m", "s", "e")
    spans = I.merge_spans(by, ["eid", "m"], gap=2).select("eid", "m", "s", "e")
    tops = _joined(spans, found.where("y = 0"))
    one = tops.groupBy("eid", "s", "e").agg(F.count("*").alias("n_models"), F.max("margin").alias("margin"), F.first("row_label").alias("row_label"))
    return I.alarm_kinds(staged(one, "alarms"), true, NEAR)


def _joined(spans, tokens):
    """Each span with the largest margin of its tokens; a token belongs to the last span that starts before its end."""
    starts = spans.select("eid", "m", F.col("s").alias("_at"), F.lit(0).alias("_k"), "s", "e", F.lit(None).cast("double").alias("margin"), F.lit(None).cast("int").alias("row_label"))
    own = tokens.select("eid", "m", F.col("s").alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"), "margin", F.col("row_label").cast("int").alias("row_label"))
    order = F.struct("_at", "_k")
    w = Window.partitionBy("eid", "m").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = starts.unionByName(own).withColumn("s", F.last("s", True).over(w)).withColumn("e", F.last("e", True).over(w)).where("_k = 1")
    return rows.groupBy("eid", "m", "s", "e").agg(F.max("margin").alias("margin"), F.first("row_label").alias("row_label"))


@query(_SPANS_SQL + """SELECT corpus, kind, n_models, count(*) AS n_spans, CAST(sum(e - s) AS BIGINT) AS chars FROM (
  SELECT 'miss' AS corpus, CASE WHEN d IS NULL THEN 'silent' WHEN d <= 40 THEN 'beside' ELSE 'elsewhere' END AS kind, n_models, s, e FROM miss
  UNION ALL SELECT 'alarm', kind, n_models, s, e FROM fa) GROUP BY 1, 2, 3""")
def c11_span_corpora(v):
    """Both corpora: true spans that not all models found, by what fired nearest to them, and false alarms by kind; with
    the number of models."""
    found, true = _models(v)
    alarms = _alarms(found, true).select(F.lit("alarm").alias("corpus"), "kind", "n_models", "s", "e")
    hits = None
    for m in range(3):
        # A span is found by a model if one of its positive tokens fired.
        met = I.meeting(true, "s", "e", found.where(f"y = 1 and m = {m}"), ["s", "e"]).select("eid", "s", "e", F.col("meets").cast("int").alias("hit"))
        hits = met if hits is None else hits.unionByName(met)
    missed = hits.groupBy("eid", "s", "e").agg(F.sum("hit").alias("n_models")).where("n_models < 3")
    near = I.nearest_distance(missed.select("eid", "s", "e"), found)
    kind = F.when(F.col("distance").isNull(), "silent").when(F.col("distance") <= NEAR, "beside").otherwise("elsewhere")
    missed = missed.join(near, ["eid", "s", "e"]).select(F.lit("miss").alias("corpus"), kind.alias("kind"), "n_models", "s", "e")
    both = missed.unionByName(alarms)
    return both.groupBy("corpus", "kind", F.col("n_models").cast("long").alias("n_models")).agg(F.count("*").alias("n_spans"), F.sum(F.col("e") - F.col("s")).cast("long").alias("chars"))


@query(_SPANS_SQL + """, rk AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n_models DESC, round(margin, 6) DESC, eid, s, e) AS place FROM fa
  WHERE n_models >= CASE WHEN kind = 'misplaced' THEN 1 ELSE 2 END)
SELECT kind, eid, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, n_models, round(margin, 6) AS margin, place FROM rk WHERE place <= CASE kind WHEN 'safe_alarm' THEN 50 WHEN 'spread' THEN 45 ELSE 35 END""")
def o5_alarm_sample(v):
    """The alarms to look at: of each kind those of most models, then of the largest margin, each span once, up to the
    kind's cap."""
    found, true = _models(v)
    a = _alarms(found, true).withColumn("margin", F.round("margin", 6))
    least, cap = F.lit(0), F.lit(0)
    for kind, (n, models) in CAPS.items():
        cap, least = F.when(F.col("kind") == kind, n).otherwise(cap), F.when(F.col("kind") == kind, models).otherwise(least)
    most = max(n for n, _ in CAPS.values())
    top = X.top_per_group(a.where(F.col("n_models") >= least), ["kind"], [F.desc("n_models"), F.desc("margin"), F.asc("eid"), F.asc("s"), F.asc("e")], most)
    return top.where(F.col("place") <= cap).select("kind", "eid", "s", "e", *longs("n_models"), *r6("margin"), *longs("place"))
