"""Labels of examples and tokens: precedence of label columns, span sets, evidence, and rows built from edits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions.text import CLASS_PATTERNS, SANITIZER, last_line
from lumenspan.operators.intervals import merge_spans, subtract_spans
from lumenspan.operators.lines import last_before, lines
from lumenspan.store import staged

#: Span columns in order of precedence, and the label they give.
SPAN_KEYS = {"evidence": 1, "vulnerable_line": 1, "sink": 1, "source": 1, "sanitizer": 0}


def row_label(label: Column, *flags: Column) -> Column:
    """The first of ``label`` and the boolean flags that is set; 0 if none is."""
    return F.coalesce(label.cast("int"), *(f.cast("int") for f in flags), F.lit(0))


def strict_labels(ex: DataFrame, spans: DataFrame) -> DataFrame:
    """(eid, row_label, strict_label): strictly positive are positive examples with a positive span."""
    marked = spans.select("eid").distinct().withColumn("_m", F.lit(1))
    both = (F.col("row_label") == 1) & F.col("_m").isNotNull()
    return ex.join(marked, "eid", "left").select("eid", "row_label", both.cast("int").alias("strict_label"))


def priority_spans(spans: DataFrame, keys: dict[str, int] = SPAN_KEYS) -> DataFrame:
    """(eid, key, s, e) -> each range once with the label of its first key; ranges that end before they start go."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(keys) for x in (k, i)])
    label = F.create_map(*[F.lit(x) for k, v in keys.items() for x in (k, v)])
    rows = spans.where(F.col("key").isin(*keys) & (F.col("e") >= F.col("s")))
    return rows.groupBy("eid", "s", "e").agg(F.min_by("key", order[F.col("key")]).alias("key")).withColumn("label", label[F.col("key")])


def evidence(sinks: DataFrame, sources: DataFrame, lines: DataFrame) -> DataFrame:
    """Sinks, sources, and what of the marked lines neither of them covers, merged."""
    flagged = merge_spans(sinks.select("eid", "s", "e").unionByName(sources.select("eid", "s", "e")), ["eid"]).select("eid", "s", "e")
    rest = subtract_spans(merge_spans(lines.select("eid", "s", "e"), ["eid"]).select("eid", "s", "e"), flagged)
    return merge_spans(flagged.unionByName(rest), ["eid"]).select("eid", "s", "e")


def last_lines(ex: DataFrame) -> DataFrame:
    """(eid, s, e) of each text's last line that isn't empty."""
    s, e = last_line(F.col("code"))
    return ex.where(F.length("code") > 0).select("eid", s.cast("long").alias("s"), e.cast("long").alias("e"))


def chosen_spans(ex: DataFrame, spans: DataFrame, first: str, second: str) -> DataFrame:
    """Ranges under key ``first`` of each example, or under ``second`` where it has none; clipped to the text, merged."""
    has = spans.where(F.col("key") == first).select("eid").distinct().withColumn("_has", F.lit(1))
    rows = spans.where(F.col("key").isin(first, second)).join(has, "eid", "left")
    rows = rows.where((F.col("key") == first) | F.col("_has").isNull()).join(ex.select("eid", F.length("code").alias("_n")), "eid")
    clip = lambda c: F.greatest(F.lit(0), F.least(c, "_n")).cast("long").alias(c)
    rows = rows.select("eid", clip("s"), clip("e")).where("s < e")
    return merge_spans(rows, ["eid"]).select("eid", "s", "e")


def token_labels(tok: DataFrame, spans: DataFrame) -> DataFrame:
    """(eid, tok, y, in_span): a token belongs to a span from its first to its last overlapping token.

    ``y`` is the highest label of the spans it belongs to; ``spans`` are (eid, first_tok, last_tok, label).
    """
    n = spans.groupBy("eid", F.col("first_tok").alias("tok")).agg(F.sum(F.lit(1)).alias("all_d"), F.sum("label").alias("pos_d"))
    ends = spans.groupBy("eid", (F.col("last_tok") + 1).alias("tok")).agg(F.sum(F.lit(-1)).alias("all_d"), F.sum(-F.col("label")).alias("pos_d"))
    steps = n.unionByName(ends).groupBy("eid", "tok").agg(F.sum("all_d").alias("all_d"), F.sum("pos_d").alias("pos_d"))
    upto = Window.partitionBy("eid").orderBy("tok").rowsBetween(Window.unboundedPreceding, 0)
    t = tok.select("eid", "tok").join(steps, ["eid", "tok"], "left")
    t = t.withColumn("_a", F.sum(F.coalesce("all_d", F.lit(0))).over(upto)).withColumn("_p", F.sum(F.coalesce("pos_d", F.lit(0))).over(upto))
    return t.select("eid", "tok", (F.col("_p") > 0).cast("int").alias("y"), (F.col("_a") > 0).alias("in_span"))


def edit_rows(pairs: DataFrame, most_chars: int = 6000) -> DataFrame:
    """(grp, before, after) -> a positive row (the text before the fix) and a negative one; unusable pairs go."""
    ok = (F.col("before") != F.col("after")) & (F.length("before") > 0) & (F.length("after") > 0)
    ok = ok & (F.length("before") <= most_chars) & (F.length("after") <= most_chars)
    both = F.array(F.struct(F.col("before").alias("code"), F.lit(1).alias("label")), F.struct(F.col("after").alias("code"), F.lit(0).alias("label")))
    return pairs.where(ok).select("grp", F.explode(both).alias("r")).select("grp", "r.*")


def canonical(rows: DataFrame) -> DataFrame:
    """Negatives carry no class and no spans."""
    pos = F.col("row_label") == 1
    return rows.withColumn("cwe", F.when(pos, F.col("cwe"))).withColumn("n_spans", F.when(pos, F.col("n_spans")).otherwise(F.lit(0)))


def prefix_rows(ex: DataFrame, at: str, back: int = 50, least_pos: int = 20, least_neg: int = 10) -> DataFrame:
    """(eid, code, end of the edit) -> the text up to the edit (positive) and up to ``back`` characters before (negative)."""
    cuts = F.array(F.struct(F.col(at).alias("n"), F.lit(1).alias("label")), F.struct((F.col(at) - back).alias("n"), F.lit(0).alias("label")))
    usable = (F.col(at) >= least_pos) & (F.col(at) - back >= least_neg)
    rows = ex.where(usable).select("eid", "code", F.explode(cuts).alias("c"))
    return rows.select("eid", "c.label", F.substring("code", F.lit(1), F.col("c.n").cast("int")).alias("code"))


def line_prefix_rows(ex: DataFrame, target: str, back: int = 3) -> DataFrame:
    """Texts up to the first line that holds ``target`` (positive) and up to ``back`` lines before it (negative)."""
    lines = F.split("code", "\n")
    holds = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit(target))), True)
    rows = ex.withColumn("_at", holds.cast("int")).where(F.col("_at") > back)
    cuts = F.array(F.struct(F.col("_at").alias("n"), F.lit(1).alias("label")), F.struct((F.col("_at") - back).alias("n"), F.lit(0).alias("label")))
    rows = rows.select("eid", "code", F.explode(cuts).alias("c"))
    return rows.select("eid", "c.label", F.array_join(F.slice(lines, 1, F.col("c.n")), "\n").alias("code"))


def paired_classes(ex: DataFrame) -> DataFrame:
    """(eid, paired_cwe): a positive's own class; a negative gets that of its group's last positive that has one."""
    last = ex.where("row_label = 1 and cwe <> ''").groupBy("grp").agg(F.max_by("cwe", "eid").alias("_last"))
    own = F.when(F.col("row_label") == 1, F.col("cwe"))
    return ex.join(last, "grp", "left").select("eid", F.coalesce(own, "_last").alias("paired_cwe"))


#: So many characters of pieces at once from a task.
PIECES = 4 << 20


def pieces(ex: DataFrame, ranges: DataFrame) -> DataFrame:
    """(eid, key, piece): the characters [s, e) of the ranges (eid, key, s, e) of each text (eid, code).

    A text meets all its ranges in one row and is cut there, so that it is neither copied to each range nor counted
    through from its start for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = (batch.column(c) for c in ("eid", "code", "r"))
            for i in range(batch.num_rows):
                eid, text, own = ids[i].as_py(), texts[i].as_py() or "", lists[i].values
                key, s, e = (own.field(c).to_pylist() for c in ("key", "s", "e"))
                at = 0
                while at < len(key):
                    out, held = [], 0
                    while at + len(out) < len(key) and held < PIECES:
                        j = at + len(out)
                        out.append(text[max(0, s[j]) : max(0, e[j])])
                        held += len(out[-1]) + 50
                    arrays = [pa.array([eid] * len(out), pa.int64()), pa.array(key[at : at + len(out)], pa.int64()), pa.array(out, pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, ["eid", "key", "piece"])
                    at += len(out)

    listed = ranges.groupBy("eid").agg(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("key", "s", "e")))).alias("r"))
    rows = ex.select(F.col("eid").cast("long").alias("eid"), "code").join(listed, "eid")
    return rows.mapInArrow(run, "eid long, key long, piece string")


def contexts(tok: DataFrame, ex: DataFrame, around: int = 48) -> DataFrame:
    """(eid, tok, surface, context): a token as it stands in the text, and with some characters on both sides."""
    wide = tok.select("eid", F.col("tok").alias("key"), (F.col("cs") - around).alias("s"), (F.col("ce") + around).alias("e"))
    cut = pieces(ex, wide).select("eid", F.col("key").cast(dict(tok.dtypes)["tok"]).alias("tok"), F.col("piece").alias("context"))
    inside = F.substring("context", (F.least(F.lit(around), F.col("cs")) + 1).cast("int"), (F.col("ce") - F.col("cs")).cast("int"))
    return cut.join(tok.select("eid", "tok", "cs", "ce"), ["eid", "tok"]).select("eid", "tok", inside.alias("surface"), "context")


def grown_to_lines(spans: DataFrame, ex: DataFrame) -> DataFrame:
    """(eid, key, s, e, line_s, line_e): spans grown to whole lines, the last one's line feed included.

    Starts and ends are looked up among the line starts by position; texts are only cut into lines.
    """
    rows = lines(ex).select("eid", F.col("s").alias("at"), F.struct("s", "e").alias("value"))
    own = spans.select("eid", "s", "e").distinct()
    first = last_before(own.select("eid", F.col("s").alias("at"), F.col("s").alias("point")), rows, "eid").select("eid", F.col("point").alias("s"), F.col("value.s").alias("line_s"))
    at = F.greatest("e", F.col("s") + 1) - 1
    last = last_before(own.select("eid", at.alias("at"), at.alias("point")).distinct(), rows, "eid").select("eid", F.col("point").alias("_at"), F.col("value.e").alias("line_e"))
    return spans.withColumn("_at", at).join(first.distinct(), ["eid", "s"]).join(last, ["eid", "_at"]).select("eid", "key", "s", "e", "line_s", "line_e")


def pattern_spans(ex: DataFrame, pattern: str | Column) -> DataFrame:
    """(eid, s, e) of every match of a pattern (never an empty one) in each text; a column gives each text its own.

    A match begins where the pieces between matches and the matches before it end; both are summed per text.  A row of a
    match carries two lengths, never the text or its other matches.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    length = lambda x: F.length(x)
    pieces, own = F.transform(F.split("code", pattern, -1), length), F.transform(F.regexp_extract_all("code", pattern, F.lit(0)), length)
    both = F.zip_with(pieces, own, lambda a, b: F.struct((a + b).alias("both"), b.alias("own")))
    rows = ex.select("eid", F.posexplode(both).alias("_i", "_x")).select("eid", "_i", "_x.both", "_x.own").where("own is not null")
    before = Window.partitionBy("eid").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("both").over(before)
    return rows.select("eid", (end - F.col("own")).cast("long").alias("s"), end.cast("long").alias("e"))


def class_spans(ex: DataFrame, patterns: dict[str, tuple[str, str]] = CLASS_PATTERNS, sanitizer: str = SANITIZER) -> DataFrame:
    """(eid, key, s, e) of positives (eid, code, cwe, row_label): sinks and sources of their class, checks, last line, evidence."""
    pos = staged(ex.where("row_label = 1").select("eid", "code", "cwe"), "class-texts")
    found = []
    for which in (0, 1):
        # A text's pattern is looked up by its class, so that all classes are one pass.
        table = [F.lit(x) for cls, both in patterns.items() if both[which] for x in (cls, both[which])]
        own = pos.withColumn("_p", F.element_at(F.create_map(*table), F.col("cwe"))).where("_p is not null") if table else pos.withColumn("_p", F.lit("x")).limit(0)
        found.append(staged(merge_spans(pattern_spans(own, F.col("_p")), ["eid"]).select("eid", "s", "e"), "class-spans"))
    sinks, sources = found
    ends = last_lines(pos)
    keyed = {"evidence": evidence(sinks, sources, ends), "vulnerable_line": ends, "sink": sinks, "source": sources}
    keyed["sanitizer"] = merge_spans(pattern_spans(pos, sanitizer), ["eid"]).select("eid", "s", "e")
    out = None
    for key, rows in keyed.items():
        one = rows.select("eid", F.lit(key).alias("key"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
        out = one if out is None else out.unionByName(one)
    return out
