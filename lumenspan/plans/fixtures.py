"""Views of the given tables that play the parts of examples, tokens, spans, scores, pairs, leads and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.functions.scalars import sigmoid
from lumenspan.operators.splits import ranked

#: Lines of source text made of eight words of a text: {a} the first, {b} the second, {rest} the others; by line number.
SNIPPETS = {
    "python": [
        "# {rest}",
        "import {a}; {b} = 1",
        "@{a}({rest})",
        'def {a}(x: "{b}") -> y:',
        "    '''{rest}'''",
        '    x = "{rest} # in" # {a} ({b}',
        "class {a}({b}): z = 1",
        "    call(({a}, # {b}\n {rest}))",
    ],
    "c": [
        '/* {rest}\n * "{a} */',
        "#include <{a}>",
        "#if {a}\n{rest}\n#endif",
        "static int {a}x({b}) {",
        '  s = "{rest} /*"; // {a} {',
        "  if (x) { y({b}); }",
        "} struct t { int q; };",
        "  z = '\"'; /* {b} */ w = {1, 2};",
    ],
    "cpp": [
        "namespace n { // {rest}",
        'class K : public B { public: K(int a) : b(a) { "{rest}"; }',
        " ~K() = default; bool operator==(int o) { return o; }",
        "}; using namespace std; using T = int;",
        "struct P q; auto f = [](int v) { return v; };",
        "void g() { /* {a} */ h(); for (;;) { } }",
        "#define M(x) \\\n {a}",
        "}",
    ],
}
SNIPPET_LANGUAGES = {"de": "python", "en": "c", "es": "cpp"}


def _line(template: str, parts: dict[str, Column]) -> Column:
    out, rest = [], template
    while rest:
        at, name = min(((rest.find("{" + n + "}"), n) for n in parts if "{" + n + "}" in rest), default=(len(rest), None))
        if at:
            out.append(F.lit(rest[:at]))
        if name is not None:
            out.append(parts[name])
        rest = rest[at + len(name or "") + 2 :]
    return F.concat(*out)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def ex(self) -> DataFrame:
        d, lab = self.table("documents"), self.table("labels").select("doc_id", "quality")
        cwe = F.concat(F.lit("CWE-"), F.lpad(F.substring("source", 4, 9), 3, "0"))
        return d.join(lab, "doc_id").select(
            F.col("doc_id").alias("eid"),
            F.col("text").alias("code"),
            (1 - F.col("quality")).alias("row_label"),
            F.when(F.col("quality") == 0, cwe).alias("cwe"),
            "lang",
            "source",
            F.concat(F.lit("func::"), "lang", F.lit("::"), "source").alias("grp"),
        )

    @property
    def tok(self) -> DataFrame:
        t = self.ex.select("eid", "lang", "cwe", "row_label", F.posexplode(F.split("code", " ")).alias("tok", "word"))
        before = Window.partitionBy("eid").orderBy("tok").rowsBetween(Window.unboundedPreceding, -1)
        t = t.withColumn("cs", F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)))
        return t.withColumn("ce", F.col("cs") + F.length("word"))

    @property
    def snippets(self) -> DataFrame:
        """(eid, lang, code): source texts in several languages, a line for each eight words of an example's text."""
        words = F.split("code", " ")

        def lines(templates: list[str]) -> Column:
            def line(i: Column) -> Column:
                own = F.slice(words, i * 8 + 1, 8)
                parts = {"a": F.coalesce(F.get(own, F.lit(0)), F.lit("")), "b": F.coalesce(F.get(own, F.lit(1)), F.lit("")), "rest": F.array_join(F.slice(own, 3, 6), " ")}
                out = _line(templates[-1], parts)
                for k in range(len(templates) - 1):
                    out = F.when(i % len(templates) == k, _line(templates[k], parts)).otherwise(out)
                return out

            return F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.size(words) / 8).cast("int") - 1), line), "\n")

        code, lang = F.col("code"), F.lit("rust")
        for natural, language in SNIPPET_LANGUAGES.items():
            code = F.when(F.col("lang") == natural, lines(SNIPPETS[language])).otherwise(code)
            lang = F.when(F.col("lang") == natural, language).otherwise(lang)
        return self.ex.select("eid", lang.alias("lang"), code.alias("code"))

    @property
    def spans(self) -> DataFrame:
        t = self.tok
        keys = F.array_compact(
            F.array(
                F.when(F.length("word") >= 10, F.lit("sink")),
                F.when(F.col("word").rlike("^[A-Z]"), F.lit("evidence")),
                F.when(F.col("word").endswith("."), F.lit("sanitizer")),
            )
        )
        return t.select("eid", F.explode(keys).alias("key"), F.col("cs").alias("s"), F.col("ce").alias("e"))

    @property
    def tok_scores(self) -> DataFrame:
        y = (F.length("word") >= 10).cast("int")
        t = self.tok.withColumn("y", y)
        logit = ((F.col("eid") * 7919 + F.col("tok") * 104729) % 1009) / 100.0 - 5 + 2 * F.col("y")
        t = t.withColumn("logit", logit.cast("double"))
        return t.withColumn("prob", sigmoid(F.col("logit"))).withColumn("is_code", F.col("tok") % 7 != 0).withColumn("is_test", F.col("eid") % 5 == 0)

    @property
    def pairs(self) -> DataFrame:
        r = ranked(self.ex.select("grp", "row_label", "eid"), ["grp", "row_label"], F.col("eid").cast("double"), "eid", "rn")
        v = r.where("row_label = 1").select("grp", "rn", F.col("eid").alias("vuln_eid"))
        s = r.where("row_label = 0").select("grp", "rn", F.col("eid").alias("safe_eid"))
        return v.join(s, ["grp", "rn"]).select("grp", "rn", "vuln_eid", "safe_eid")

    @property
    def acts(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") < 5).cast("int").alias("y"), (F.col("vec_id") % 4).alias("layer"), "label")

    @property
    def traces(self) -> DataFrame:
        return self.ex.select(
            F.col("source").alias("repo_id"),
            (F.col("eid") % 7).alias("file"),
            F.col("eid").alias("trace_id"),
            (F.col("eid") % 50 * 5).alias("start_line"),
            (F.col("eid") % 50 * 5 + 4).alias("end_line"),
            F.concat(F.lit("CWE-"), F.col("lang")).alias("cwe"),
        )

    @property
    def leads(self) -> DataFrame:
        return self.ex.select(
            F.col("source").alias("repo_id"),
            (F.col("eid") % 7).alias("file"),
            F.col("eid").alias("lead_id"),
            (F.col("eid") * 13 % 250).alias("start_line"),
            (F.col("eid") * 13 % 250 + 2).alias("end_line"),
            F.when(F.col("eid") % 11 != 0, F.col("eid") * 31 % 97).alias("rank"),
        )

    @property
    def member_scores(self) -> DataFrame:
        m = self.spark.range(3).select(F.col("id").alias("member"))
        e = self.ex.select("eid").crossJoin(F.broadcast(m))
        s = ((F.col("eid") * 37 + F.col("member") * 11) % 101) / 101.0
        return e.select("eid", "member", F.when((F.col("eid") + F.col("member")) % 7 != 0, s).alias("score"))


#: The same views for the other engine.
SQL = """WITH ex AS (
  SELECT d.doc_id AS eid, d.text AS code, 1 - l.quality AS row_label,
    CASE WHEN l.quality = 0 THEN 'CWE-' || lpad(substr(d.source, 4), 3, '0') END AS cwe, d.lang, d.source,
    'func::' || d.lang || '::' || d.source AS grp
  FROM documents d JOIN labels l USING (doc_id)
), tok0 AS (
  SELECT eid, lang, cwe, row_label, unnest(range(len(ws))) AS tok, unnest(ws) AS word
  FROM (SELECT *, string_split(code, ' ') AS ws FROM ex)
), tok1 AS (
  SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY eid ORDER BY tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cs FROM tok0
), tok AS (SELECT *, cs + length(word) AS ce FROM tok1),
spans AS (
  SELECT eid, 'sink' AS key, cs AS s, ce AS e FROM tok WHERE length(word) >= 10
  UNION ALL SELECT eid, 'evidence', cs, ce FROM tok WHERE regexp_matches(word, '^[A-Z]')
  UNION ALL SELECT eid, 'sanitizer', cs, ce FROM tok WHERE suffix(word, '.')
), ts0 AS (SELECT *, CASE WHEN length(word) >= 10 THEN 1 ELSE 0 END AS y FROM tok),
ts1 AS (SELECT *, CAST(((eid * 7919 + tok * 104729) % 1009) / 100.0 - 5 + 2 * y AS DOUBLE) AS logit FROM ts0),
tok_scores AS (SELECT *, 1 / (1 + exp(-logit)) AS prob, tok % 7 <> 0 AS is_code, eid % 5 = 0 AS is_test FROM ts1),
rn AS (SELECT *, row_number() OVER (PARTITION BY grp, row_label ORDER BY eid) AS rn FROM ex),
pairs AS (
  SELECT v.grp, v.rn, v.eid AS vuln_eid, s.eid AS safe_eid FROM rn v JOIN rn s ON v.grp = s.grp AND v.rn = s.rn AND v.row_label = 1 AND s.row_label = 0
), acts AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, vec_id % 4 AS layer, label FROM embeddings
), traces AS (
  SELECT source AS repo_id, eid % 7 AS file, eid AS trace_id, eid % 50 * 5 AS start_line, eid % 50 * 5 + 4 AS end_line, 'CWE-' || lang AS cwe FROM ex
), leads AS (
  SELECT source AS repo_id, eid % 7 AS file, eid AS lead_id, eid * 13 % 250 AS start_line, eid * 13 % 250 + 2 AS end_line,
    CASE WHEN eid % 11 <> 0 THEN eid * 31 % 97 END AS rank FROM ex
), member_scores AS (
  SELECT eid, m AS member, CASE WHEN (eid + m) % 7 <> 0 THEN ((eid * 37 + m * 11) % 101) / 101.0 END AS score FROM ex, (SELECT unnest([0, 1, 2]) AS m)
), exs AS (SELECT eid, max(logit) AS score, any_value(row_label) AS y, any_value(lang) AS lang, any_value(cwe) AS cwe FROM tok_scores GROUP BY eid)
"""


def _sql_line(template: str) -> str:
    text = template.replace("'", "''").replace("\\", "\\\\").replace("\n", "\\n")
    for name in ("a", "b", "rest"):
        text = text.replace("{" + name + "}", f"' || w.{name} || E'")
    return f"E'{text}'"


def _sql_lines(language: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {_sql_line(t)}" for k, t in enumerate(SNIPPETS[language]))
    part = "{'i': i, 'a': coalesce(ws[i * 8 + 1], ''), 'b': coalesce(ws[i * 8 + 2], ''), 'rest': array_to_string(ws[i * 8 + 3:least(i * 8 + 8, len(ws))], ' ')}"
    n = len(SNIPPETS[language])
    return f"array_to_string(list_transform(list_transform(range((len(ws) + 7) // 8), lambda i: {part}), lambda w: CASE w.i % {n} {cases} END), chr(10))"


#: The snippets for the other engine, after ``SQL``.
SNIPPETS_SQL = f""", snippets AS (
  SELECT eid, CASE {" ".join(f"WHEN lang = '{k}' THEN '{v}'" for k, v in SNIPPET_LANGUAGES.items())} ELSE 'rust' END AS lang,
    CASE {" ".join(f"WHEN lang = '{k}' THEN {_sql_lines(v)}" for k, v in SNIPPET_LANGUAGES.items())} ELSE code END AS code
  FROM (SELECT eid, lang, code, string_split(code, ' ') AS ws FROM ex)
)
"""
