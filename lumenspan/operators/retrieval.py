"""Ranked leads against ground-truth traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(leads: DataFrame) -> DataFrame:
    """Position of each lead: by rank, missing ranks last, then by order of arrival."""
    order = Window.partitionBy("repo_id").orderBy(F.coalesce("rank", F.lit(10**9)), "lead_id")
    return leads.withColumn("pos", F.row_number().over(order))


def hits(leads: DataFrame, traces: DataFrame, bucket: int = 256) -> DataFrame:
    """Lead and trace pairs in one file whose line ranges overlap; malformed ranges hit nothing.

    Ranges are listed in every bucket of lines they touch, so that the pairs of a long file are not all made; a pair is
    taken in the bucket where the later of the two begins.
    """
    covers = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket)))
    t = traces.select("repo_id", "file", "trace_id", F.col("start_line").alias("ts"), F.col("end_line").alias("te"), "cwe").where("ts <= te")
    t = t.withColumn("_b", covers("ts", "te"))
    le = leads.where("start_line <= end_line").withColumn("_b", covers("start_line", "end_line"))
    both = le.join(t, ["repo_id", "file", "_b"]).where((F.col("start_line") <= F.col("te")) & (F.col("end_line") >= F.col("ts")))
    return both.where(F.floor(F.greatest("start_line", "ts") / bucket) == F.col("_b")).drop("_b")


def retrieval_metrics(leads: DataFrame, traces: DataFrame, ks: list[int]) -> DataFrame:
    """A row per repository: first hit's rank, reciprocal rank, and recall and precision at each k."""
    r = ranked(leads)
    h = hits(r, traces)
    repos = traces.groupBy("repo_id").agg(F.count("*").alias("n_traces"))
    found = h.groupBy("repo_id").agg(
        F.min("pos").alias("first_hit"),
        *[F.countDistinct(F.when(F.col("pos") <= k, F.col("trace_id"))).alias(f"_t{k}") for k in ks],
        *[F.countDistinct(F.when(F.col("pos") <= k, F.col("pos"))).alias(f"_p{k}") for k in ks],
    )
    size = r.groupBy("repo_id").agg(F.count("*").alias("_n"))
    out = repos.join(found, "repo_id", "left").join(size, "repo_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cols = [F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("rr")]
    for k in ks:
        cols.append((zero(f"_t{k}") > 0).cast("int").alias(f"hit_at_{k}"))
        cols.append((zero(f"_t{k}") / F.col("n_traces")).alias(f"trace_recall_at_{k}"))
        cols.append((zero(f"_p{k}") / F.nullif(F.least(F.col("_n"), F.lit(k)), F.lit(0))).alias(f"precision_at_{k}"))
    return out.select("repo_id", "first_hit", *cols)


def class_on_hits(leads: DataFrame, traces: DataFrame, ks: list[int]) -> DataFrame:
    """Of the first k leads that hit a trace with a class, the share naming that class (the first such trace's).

    Leads without a class are left out; NULL where no lead counts.
    """
    h = hits(ranked(leads), traces).where(F.col("cwe").isNotNull() & F.col("lead_cwe").isNotNull())
    first = h.groupBy("repo_id", "pos", "lead_cwe").agg(F.min_by("cwe", "trace_id").alias("cwe"))
    same = (F.col("lead_cwe") == F.col("cwe")).cast("double")
    return first.groupBy("repo_id").agg(*[F.avg(F.when(F.col("pos") <= k, same)).alias(f"cwe_at_{k}") for k in ks])


def manifest(traces: DataFrame) -> DataFrame:
    """A row per repository: its files, each with its traces, in order."""
    trace = F.struct("start_line", "end_line", "cwe", "trace_id")
    files = traces.groupBy("repo_id", "file").agg(F.sort_array(F.collect_list(trace)).alias("traces"))
    return files.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("file", "traces"))).alias("files"))


def benchmark_manifest(positives: DataFrame, fixed: DataFrame, decoys: DataFrame, sizes: DataFrame, traces: DataFrame) -> DataFrame:
    """(repo_id, cwe, lang, files, traces, negative_regions): a small repository for each positive (eid, cwe, lang).

    Its files are the faulty text, its mended counterpart (eid, safe_eid) where there is one, and the decoys (eid, decoy,
    place); traces (eid, start_line, end_line) lie in the first, and all lines of the others (``sizes``: eid, n_lines) are
    negative regions.  Lists are ordered: files by role and place, traces by line.
    """
    first = positives.select("eid", F.lit(0).alias("o"), F.lit(0).alias("place"), F.lit("vulnerable").alias("role"), F.col("eid").alias("row"), F.lit(1).alias("label"))
    mended = fixed.join(positives.select("eid"), "eid").select("eid", F.lit(1), F.lit(0), F.lit("fixed_counterpart"), "safe_eid", F.lit(0))
    safe = decoys.select("eid", F.lit(2), "place", F.lit("safe_decoy"), "decoy", F.lit(0))
    folder = F.element_at(F.create_map(*(F.lit(x) for x in ("vulnerable", "src/", "fixed_counterpart", "fixed/", "safe_decoy", "decoys/"))), F.col("role"))
    files = first.unionAll(mended).unionAll(safe).join(sizes.select(F.col("eid").alias("row"), "n_lines"), "row")
    files = files.withColumn("path", F.concat(folder, F.col("place").cast("string"), F.lit("_"), F.col("row").cast("string")))
    listed = files.groupBy("eid").agg(F.sort_array(F.collect_list(F.struct("o", "place", "path", "role", "row", "label", "n_lines"))).alias("f"))
    found = traces.join(positives.select("eid"), "eid").groupBy("eid").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line"))).alias("t"))
    out = positives.join(listed, "eid").join(found, "eid", "left")
    region = lambda x: F.struct(x["path"].alias("file"), F.lit(1).cast("long").alias("start_line"), x["n_lines"].alias("end_line"), x["role"].alias("role"))
    none = F.array().cast("array<struct<file:string,start_line:long,end_line:long>>")
    return out.select(
        F.col("eid").alias("repo_id"), "cwe", "lang",
        F.transform("f", lambda x: F.struct(x["path"].alias("path"), x["role"].alias("role"), x["row"].alias("source_row"), x["label"].alias("label"))).alias("files"),
        F.coalesce(F.transform("t", lambda x: F.struct(F.get("f", F.lit(0))["path"].alias("file"), x["start_line"].cast("long").alias("start_line"), x["end_line"].cast("long").alias("end_line"))), none).alias("traces"),
        F.transform(F.filter("f", lambda x: x["label"] == 0), region).alias("negative_regions"),
    )
