"""Quality by co-training two naive Bayes classifiers.

One view of a document is its text (shares of symbols, capitals, separators and repeats, word and line lengths), the
other its metadata (source, language, length).  Features are binned once, natively, into a narrow table.  In each
round both views are fitted on the labelled documents and on the confident pseudo-labels that the *other* view gave to
unlabelled ones.  Fitting is one sum of counts per feature and bin, so all documents take part and what reaches the
driver is a table of bins.  By a hash of the id a tenth of the labelled documents is held out to tell how confident a
view is in each round, and another tenth, which neither a fit nor a round has seen, to calibrate both views' log odds
and combine them by a logistic regression, on binned sums again.

Cases: a null text is the empty text.  A null source or language is a value of its own, as is a missing n_chars.
Repeated rows are scored one by one; a null doc_id is scored and never labelled.  A document with several labels takes
the smallest.  Where a tenth that is held out lacks a class, or all the rest does, nothing is held out and all labelled
documents serve for all three.  Without labels of both classes every score is the share of good labels (1 without
labels).  An empty table gives an empty result.  Other columns are not carried.

``fit_on`` names the documents that the views are fitted on, where they are not those to be scored (a stage's input
may lack the labelled bad documents that a stage before it removed).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.quality_rules import SEPARATORS, SYMBOLS, char_count, words_of
from lumenspan.store import staged

SOURCE_BINS = 256
BINS = {"t": 12, "m": 24}


def _bin(share: Column, cuts: list[float]) -> Column:
    """How many of the cuts the value reaches; 0 for null."""
    out = F.lit(0)
    for c in cuts:
        out = out + F.coalesce((share >= c).cast("int"), F.lit(0))
    return out.cast("short")


def view_features(docs: DataFrame) -> DataFrame:
    """(doc columns) -> the same with ``t0..t7`` (text view) and ``m0..m2`` (metadata view) as small numbers."""
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_w", words_of(t))
    w = F.col("_w")
    n = F.nullif(F.size(w), F.lit(0))
    letters = F.length(t)
    upper = char_count(t, r"\p{Lu}")
    unlike = F.size(F.array_distinct(w))
    lines = F.size(F.split(t, "\n"))
    next_same = F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1)))
    shares = [0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0, 1.5]
    length = [1, 2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 9]
    per_line = [1, 2, 4, 8, 12, 20, 30, 45, 70, 120, 250]
    text_view = [
        _bin(char_count(t, SYMBOLS) / n, shares),
        _bin(char_count(t, SEPARATORS) / n, shares),
        _bin(upper / F.nullif(letters, F.lit(0)), shares),
        _bin(char_count(t, "!?") / n, shares),
        _bin(1 - unlike / n, shares),
        _bin(next_same / n, shares),
        _bin(letters / n - 1, length),
        _bin(F.size(w) / lines, per_line),
    ]
    sizes = [2.0**i for i in range(3, 26)]
    meta_view = [
        F.pmod(F.xxhash64(F.coalesce("source", F.lit("\x00"))), F.lit(SOURCE_BINS)).cast("short"),
        F.pmod(F.xxhash64(F.coalesce("lang", F.lit("\x00"))), F.lit(BINS["m"])).cast("short"),
        _bin(F.col("n_chars"), sizes),
    ]
    named = {f"t{i}": c for i, c in enumerate(text_view)} | {f"m{i}": c for i, c in enumerate(meta_view)}
    return df.select("*", *(c.alias(k) for k, c in named.items())).drop("_w")


TEXT, META = [f"t{i}" for i in range(8)], ["m0", "m1", "m2"]


def _fit(table: DataFrame, features: list[str], good: Column, bad: Column, smooth: float = 0.5) -> dict[str, list[float]]:
    """Log odds per bin of each feature, from weighted counts; key '' holds the prior's."""
    counted = table.select(good.alias("g"), bad.alias("b"), *features).where("g > 0 or b > 0")
    stacked = counted.select("g", "b", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("int").alias("v")) for f in features])).alias("x"))
    rows = stacked.groupBy("x.f", "x.v").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).collect()
    out: dict[str, list[float]] = {}
    for f in features:
        own = {r["v"]: (r["g"], r["b"]) for r in rows if r["f"] == f}
        size = SOURCE_BINS if f == "m0" else BINS[f[0]]
        g, b = (sum(x[i] for x in own.values()) for i in (0, 1))
        out[f] = [
            math.log((own.get(v, (0, 0))[0] + smooth) / (g + smooth * size)) - math.log((own.get(v, (0, 0))[1] + smooth) / (b + smooth * size))
            for v in range(size)
        ]
        out[""] = [math.log((g + 1) / (b + 1))]
    return out


def _log_odds(model: dict[str, list[float]]) -> Column:
    total = F.lit(model[""][0])
    for f, values in model.items():
        if f:
            total = total + F.element_at(F.array(*map(F.lit, values)), F.col(f).cast("int") + 1)
    return total


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps for a weighted logistic regression with an intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _calibrate(held: DataFrame, columns: list[str]) -> np.ndarray:
    """Logistic regression of the label on ``columns``, from counts on a grid of quarter log odds in [-30, 30]."""
    grid = [F.round(F.least(F.greatest(F.col(c), F.lit(-30.0)), F.lit(30.0)) * 4) / 4 for c in columns]
    cells = held.groupBy(*(g.alias(c) for g, c in zip(grid, columns, strict=True))).agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect()
    x = np.array([[r[c] for c in columns] for r in cells] * 2)
    good, n = np.array([r["good"] for r in cells], float), np.array([r["n"] for r in cells], float)
    return _logistic(x, np.repeat([1.0, 0.0], len(cells)), np.concatenate([good, n - good]))


def _sigmoid(beta: np.ndarray, columns: list[str]) -> Column:
    z = F.lit(float(beta[-1]))
    for b, c in zip(beta, columns, strict=False):
        z = z + F.col(c) * float(b)
    return 1 / (1 + F.exp(-z))


def _features(docs: DataFrame) -> DataFrame:
    features = view_features(docs.select("doc_id", "text", "source", "lang", "n_chars"))
    return staged(features.select("doc_id", *TEXT, *META), "features")


def classify(
    docs: DataFrame, labels: DataFrame, rounds: int = 3, confident: float = 0.98, threshold: float = 0.5, fit_on: DataFrame | None = None
) -> DataFrame:
    """doc_id, ``text_score``, ``meta_score``, ``score`` (probability of good quality) and ``kept`` of every row."""
    results = ["text_score", "meta_score", "score", "kept"]
    features = _features(docs if fit_on is None else fit_on)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    table = features.join(known, "doc_id", "left")
    part = F.when(F.col("y").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(10)))
    # 1: tells a round's confidence, 2: calibrates, 0: is fitted; unlabelled documents are fitted once they are taught.
    table = table.withColumn("part", F.when(part == 1, 1).when(part == 2, 2).otherwise(0))
    table = staged(table, "views")
    counts = table.where("y is not null").groupBy("part").agg(F.sum("y").alias("g"), F.sum(1 - F.col("y")).alias("b")).collect()
    totals = {"g": sum(r["g"] for r in counts), "b": sum(r["b"] for r in counts)}
    whole = sum(bool(r["g"] and r["b"]) for r in counts) == 3
    fitted, round_rows, last_rows = (F.col("part") == i if whole else F.lit(True) for i in range(3))
    text_model = meta_model = None
    if totals["g"] and totals["b"]:
        fit_rows = table.where(fitted)
        good, bad = F.coalesce("y", F.lit(0)), F.coalesce(1 - F.col("y"), F.lit(0))
        text_model, meta_model = _fit(fit_rows, TEXT, good, bad), _fit(fit_rows, META, good, bad)
        for _ in range(rounds):
            # Confidence is that of the calibrated view, or a view without information would teach the other noise.
            scored = table.withColumn("t", _log_odds(text_model)).withColumn("m", _log_odds(meta_model))
            known_rows = scored.where(round_rows & F.col("y").isNotNull())
            beta_t, beta_m = (_calibrate(known_rows, [c]) for c in ("t", "m"))
            scored = scored.where(fitted).withColumn("pt", _sigmoid(beta_t, ["t"])).withColumn("pm", _sigmoid(beta_m, ["m"]))
            unlabelled = F.col("y").isNull()

            def taught(p: str) -> tuple[Column, Column]:
                yes = (unlabelled & (F.col(p) >= confident)).cast("int")  # noqa: B023
                no = (unlabelled & (F.col(p) <= 1 - confident)).cast("int")  # noqa: B023
                return good + yes, bad + no  # noqa: B023

            text_model, meta_model = _fit(scored, TEXT, *taught("pm")), _fit(scored, META, *taught("pt"))
    if text_model is None:
        share = totals["g"] / (totals["g"] + (totals["b"] or 0)) if totals["g"] else (0.0 if totals["b"] else 1.0)
        asked = table if fit_on is None else _features(docs)
        scored = asked.withColumns({c: F.lit(float(share)) for c in ("text_score", "meta_score", "score")})
    else:
        odds = {"t": _log_odds(text_model), "m": _log_odds(meta_model)}
        rows = table.where(last_rows & F.col("y").isNotNull()).withColumns(odds)
        betas = [_calibrate(rows, c) for c in (["t"], ["m"], ["t", "m"])]
        scored = (table if fit_on is None else _features(docs)).withColumns(odds)
        scored = scored.withColumns({"text_score": _sigmoid(betas[0], ["t"]), "meta_score": _sigmoid(betas[1], ["m"]), "score": _sigmoid(betas[2], ["t", "m"])})
    return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in results[:3]], (F.round("score", 6) >= threshold).alias("kept"))
