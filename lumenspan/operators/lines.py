"""Lines of texts, and the live ranges that are left when some lines are dropped."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.operators.intervals import complement, merge_spans

#: Lines that are comments, imports, or heads of definitions; the same in Java and RE2.
DROPPED_LINE = r"^\s*(#|//|/\*|\*|import |from |def |class |@)"


#: So many characters of excerpts at once from a task.
EXCERPTS = 4 << 20


def lines(ex: DataFrame) -> DataFrame:
    """(eid, line_no, s, e, line): 1-based lines and their ranges, line feed included but for the last."""
    rows = ex.select("eid", F.length("code").alias("_n"), F.posexplode(F.split("code", "\n")).alias("_i", "line"))
    before = Window.partitionBy("eid").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    rows = rows.withColumn("s", start)
    end = F.least(F.col("s") + F.length("line") + 1, F.col("_n"))
    return rows.select("eid", (F.col("_i") + 1).alias("line_no"), F.col("s").cast("long").alias("s"), end.cast("long").alias("e"), "line")


def live_ranges(ex: DataFrame, dropped: str = DROPPED_LINE) -> DataFrame:
    """(eid, s, e) of what is left of each text without the lines that ``dropped`` matches."""
    gone = lines(ex).where(F.col("line").rlike(dropped) & (F.col("s") < F.col("e")))
    sizes = ex.select("eid", F.length("code").cast("long").alias("n"))
    return complement(merge_spans(gone.select("eid", "s", "e"), ["eid"]).select("eid", "s", "e"), sizes)


def live_mask(tok: DataFrame, live: DataFrame) -> DataFrame:
    """``is_live``: the token holds more than white space and meets a live range.

    Live ranges don't overlap, so a token's candidate is the last one that starts before its end: a merge of starts
    and tokens by position, one pass over both.
    """
    starts = live.select("eid", F.col("s").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("tok"), F.lit(None).cast("long").alias("cs"), "e")
    ends = tok.select("eid", F.col("ce").alias("at"), F.lit(-1).alias("kind"), "tok", F.col("cs").cast("long").alias("cs"), F.lit(None).cast("long").alias("e"))
    order = Window.partitionBy("eid").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    marked = starts.unionByName(ends).withColumn("_e", F.last("e", True).over(order)).where("kind = -1")
    meets = marked.select("eid", "tok", F.coalesce(F.col("_e") > F.col("cs"), F.lit(False)).alias("_m"))
    return tok.join(meets, ["eid", "tok"]).withColumn("is_live", F.col("_m") & (F.trim(F.replace("word", F.lit("\n"), F.lit(" "))) != "")).drop("_m")


def scattered_mask(tok: DataFrame, mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """A mask brought back to the token axis; where an example has no mask or one of another length, all is kept.

    ``mask`` is (eid, tok, is_live); ``sizes`` the tokens (eid, n) that the mask was made for.
    """
    n = tok.groupBy("eid").agg(F.count("*").alias("_n")).join(sizes, "eid", "left")
    fits = n.select("eid", F.coalesce(F.col("_n") == F.col("n"), F.lit(False)).alias("_fits"))
    t = tok.join(fits, "eid").join(mask.select("eid", "tok", "is_live"), ["eid", "tok"], "left")
    return t.withColumn("is_live", F.when(F.col("_fits"), F.coalesce("is_live", F.lit(True))).otherwise(F.lit(True))).drop("_fits")


def last_before(points: DataFrame, starts: DataFrame, by: str) -> DataFrame:
    """As-of lookup: for each (by, at) of ``points`` the value of the last row of ``starts`` (by, at, value) not after it."""
    s = starts.select(by, "at", F.lit(0).alias("_k"), F.col("value"), F.lit(None).cast("long").alias("point"))
    p = points.select(by, "at", F.lit(1).alias("_k"), F.lit(None).cast(dict(starts.dtypes)["value"]).alias("value"), "point")
    order = Window.partitionBy(by).orderBy("at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    rows = s.unionByName(p).withColumn("value", F.last("value", True).over(order))
    return rows.where("_k = 1").select(by, "point", "at", "value")


def excerpts(ex: DataFrame, spans: DataFrame, around: int = 2) -> DataFrame:
    """(eid, s, e, excerpt): the lines of a span and some around it, numbered, the span between « and ».

    A text meets all its spans in one row and is cut into lines once; what a span costs is its own excerpt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = (batch.column(c) for c in ("eid", "code", "r"))
            for i in range(batch.num_rows):
                eid, parts, own = ids[i].as_py(), texts[i].as_py().split("\n"), lists[i].values
                starts = [0, *accumulate(len(x) + 1 for x in parts)][:-1]
                places, out, held = list(zip(own.field("s").to_pylist(), own.field("e").to_pylist(), strict=True)), [], 0
                for s, e in places:
                    out.append((s, e, one(parts, starts, s, e)))
                    held += len(out[-1][2]) + 50
                    if held >= EXCERPTS:
                        yield rows(eid, out)
                        out, held = [], 0
                if out:
                    yield rows(eid, out)

    def one(parts: list[str], starts: list[int], s: int, e: int) -> str:
        first, last = bisect_right(starts, s) - 1, bisect_right(starts, e) - 1
        shown = []
        for k in range(max(0, first - around), min(len(parts), last + around + 1)):
            line, at, to = parts[k], s - starts[k], e - starts[k]
            if k == last:
                line = f"{line[:to]}»{line[to:]}"
            if k == first:
                line = f"{line[:at]}«{line[at:]}"
            shown.append(f"{k + 1:>5} | {line}")
        return "\n".join(shown)

    def rows(eid: int, out: list[tuple[int, int, str]]) -> pa.RecordBatch:
        s, e, text = zip(*out, strict=True)
        arrays = [pa.array([eid] * len(out), pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(text, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["eid", "s", "e", "excerpt"])

    listed = spans.groupBy("eid").agg(F.collect_list(F.struct(F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))).alias("r"))
    texts = ex.where("code is not null").select(F.col("eid").cast("long").alias("eid"), "code")
    return texts.join(listed, "eid").mapInArrow(run, "eid long, s long, e long, excerpt string")
