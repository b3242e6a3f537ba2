"""Live code: what is left of a source text without comments, imports, decorators, preprocessor lines and signatures.

A text is cut into lexical tokens by one pattern of its language, in which strings and comments are single tokens, so
that quotes in comments and comment marks in strings mean nothing.  All else are sums in order of position, by text:
nesting of brackets and braces, logical lines or statements, and per statement what its head is.  What is dropped are
ranges; the others (`intervals.complement`) are live.

Python: comments, ``import`` and ``from`` statements and decorators go whole; ``def`` and ``class`` heads go up to the
first token of their body.  C: comments, preprocessor lines and all that stands between ``#if`` and ``#endif``; heads of
functions up to the brace.  C++: also heads of classes, structs and namespaces up to the brace, ``using`` declarations,
namespace aliases, functions without a body (``= default``), and the name of a class or struct that has no body here.
Template parameters before a function count as its head.

Cases: a language that is not known keeps all, so does an empty text.  A comment, string or ``#if`` without an end
goes on to the end (a string to the end of its line); closing brackets too many don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.operators.intervals import complement, merge_spans

#: Names of languages.
LANGUAGES = {"python": "python", "py": "python", "c": "c", "cpp": "cpp", "c++": "cpp", "cxx": "cpp", "cc": "cpp"}

_WORD = r"[A-Za-z_$\x{80}-\x{10FFFF}][A-Za-z0-9_$\x{80}-\x{10FFFF}]*+"
_REST = rf"|{_WORD}|[0-9][A-Za-z0-9_.]*+|[ \t\r\f\x0B]++|."
_QUOTED = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|' + r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?"
_TRIPLE = r'"""(?:"{0,2}(?:[^"\\]|\\.))*+(?:"""|"{0,2}\z)|' + r"'''(?:'{0,2}(?:[^'\\]|\\.))*+(?:'''|'{0,2}\z)"
#: Tokens of Python and of C and C++; possessive, so that long texts need no stack.
PYTHON = rf"(?s)(?:[rRbBuUfF]{{1,2}}+)?+(?:{_TRIPLE}|{_QUOTED})|#[^\n]*+|\\\n|\n" + _REST
C_LIKE = rf"(?s)/\*.*?(?:\*/|\z)|//(?:\\\n|[^\n])*+|{_QUOTED}|\n[ \t]*+#(?:\\\n|/\*.*?\*/|[^\n])*+|\\\n|\n" + _REST

#: First words of statements with a block that are no functions.
CONTROL = "if else for while switch do return case default catch try goto sizeof new delete throw using co_return".split()
COMPOUND = "def class async if elif else for while with try except finally match case".split()
ACCESS = ("public", "private", "protected")


def _nested(df: DataFrame, step: Column, out: str) -> DataFrame:
    """Adds the depth after each token: the running sum of steps, where what would fall below 0 is forgotten."""
    upto = Window.partitionBy("eid").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_sum", F.sum(step).over(upto))
    return df.withColumn(out, F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto))).drop("_sum")


def tokens(ex: DataFrame) -> DataFrame:
    """(eid, family, i, t, s, e, kind) of the texts (eid, code, lang) whose language is known; kind is code, line, space,
    comment or directive."""
    family = F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), F.lower("lang"))
    known = ex.withColumn("family", family).where("family is not null")
    # A line feed before the first line, so that directives are found behind one.
    text = F.concat(F.lit("\n"), F.col("code"))
    cut = F.when(F.col("family") == "python", F.regexp_extract_all(text, F.lit(PYTHON), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(C_LIKE), F.lit(0)))
    rows = known.select("eid", "family", F.posexplode(cut).alias("i", "t"))
    upto = Window.partitionBy("eid").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("e", F.sum(F.length("t")).over(upto) - 1)
    python, t = F.col("family") == "python", F.col("t")
    comment = F.when(python, t.startswith("#")).otherwise(t.startswith("/*") | t.startswith("//"))
    kind = (
        F.when(t == "\n", "line").when(t.startswith("\n"), "directive").when(comment, "comment").when(F.length(F.trim(F.translate(t, "\t\r\f\x0b\n\\", " "))) == 0, "space").otherwise("code")
    )
    # The line feed before a directive is not part of it.
    return rows.select("eid", "family", "i", "t", (F.col("e") - F.length("t") + (kind == "directive").cast("int")).alias("s"), "e", kind.alias("kind"))


def python_heads(rows: DataFrame) -> DataFrame:
    """Ranges of imports, decorators and heads of definitions in the ``tokens`` of Python texts."""
    by_text = Window.partitionBy("eid").orderBy("i")
    t = F.col("t")
    rows = rows.where((F.col("family") == "python") & F.col("kind").isin("code", "line"))
    step = F.when(t.isin("(", "[", "{"), 1).when(t.isin(")", "]", "}"), -1).otherwise(0)
    rows = _nested(rows, step, "depth")
    ends = ((F.col("depth") == 0) & t.isin("\n", ";")).cast("int")
    before = by_text.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("line", F.coalesce(F.sum(ends).over(before), F.lit(0))).where("kind = 'code' and not (depth = 0 and t = ';')")
    rows = rows.withColumn("next_s", F.lead("s").over(by_text)).withColumn("next_t", F.lead("t").over(by_text))
    # A compound statement's body may follow on its line.
    in_line = Window.partitionBy("eid", "line").orderBy("i")
    colon = ((F.col("depth") == 0) & (t == ":")).cast("int")
    first = F.first("t").over(in_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    part = (first.isin(*COMPOUND) & (F.coalesce(F.sum(colon).over(in_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0)).cast("int")
    rows = rows.withColumn("part", part).withColumn("colon", colon)
    heads = rows.groupBy("eid", "line", "part").agg(
        F.min_by("t", "i").alias("first"),
        F.min_by("next_t", "i").alias("second"),
        F.min("s").alias("s"),
        F.max("e").alias("e"),
        F.min_by(F.struct("next_s"), F.when(F.col("colon") == 1, F.col("i"))).alias("body"),
    )
    definition = F.col("first").isin("def", "class") | ((F.col("first") == "async") & (F.col("second") == "def"))
    gone = F.col("first").isin("import", "from", "@")
    body = F.when(definition, F.coalesce("body.next_s", "e")).otherwise(F.col("e"))
    return heads.where((definition & (F.col("part") == 0)) | gone).select("eid", "s", body.alias("e"))


def c_heads(rows: DataFrame) -> DataFrame:
    """Ranges of conditional blocks, heads of functions and, in C++, of classes, namespaces and using declarations."""
    by_text = Window.partitionBy("eid").orderBy("i")
    before = by_text.rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("t")
    rows = rows.where("family <> 'python'")
    directive = F.col("kind") == "directive"
    step = F.when(directive & t.rlike(r"^\n[ \t]*#[ \t]*if"), 1).when(directive & t.rlike(r"^\n[ \t]*#[ \t]*endif"), -1).otherwise(0)
    rows = _nested(rows, step, "off")
    conditional = rows.where("off > 0").select("eid", "s", "e")
    rows = rows.where("off = 0 and kind = 'code'")
    step = F.when(t.isin("(", "["), 1).when(t.isin(")", "]"), -1).otherwise(0)
    rows = _nested(rows, step, "depth").withColumn("last", F.lag("t").over(by_text))
    top = F.col("depth") == 0
    label = (F.col("family") == "cpp") & (t == ":") & F.col("last").isin(*ACCESS)
    rows = rows.withColumn("next_t", F.lead("t").over(by_text)).withColumn("next_e", F.lead("e").over(by_text))
    rows = rows.withColumn("statement", F.coalesce(F.sum((top & (t.isin(";", "{", "}") | label)).cast("int")).over(before), F.lit(0)))
    rows = _nested(rows, F.when(top & (t == "{"), 1).when(top & (t == "}"), -1).otherwise(0), "braces")

    def first(cond: Column, value: str = "i") -> Column:
        return F.min(F.when(cond, F.col(value)))

    found = rows.groupBy("eid", "family", "statement").agg(
        F.min_by("t", "i").alias("first"),
        F.min("s").alias("s"),
        F.max("e").alias("e"),
        F.max("i").alias("at"),
        F.max_by(F.struct("t", "s", "braces"), "i").alias("end"),
        first(t == "(").alias("paren"),
        first(top & (t == "=") & ~F.coalesce(F.col("last").isin("operator", "=", "<", ">", "!"), F.lit(False))).alias("equals"),
        first(top & t.isin("class", "struct"), "s").alias("type_s"),
        first(top & (t == "namespace"), "s").alias("space_s"),
        F.max(top & t.isin("union", "enum")).alias("other"),
        F.max(t == "enum").alias("enum"),
        F.max(t.isin("default", "delete") & (F.coalesce("last", F.lit("")) == "=")).alias("defaulted"),
    )
    block, none = F.col("end.t") == "{", F.col("paren").isNull()
    container = block & none & (F.col("type_s").isNotNull() | F.col("space_s").isNotNull() | F.col("other") | (F.col("first") == "extern"))
    found = found.withColumn("block", block).withColumn("container", container)
    # A block stands in the last one before it that is one brace further out; on the outside or in a container it can
    # be a function's.
    opened = found.where("block").select("eid", "statement", "at", "container", F.col("end.braces").alias("braces"))
    sides = opened.select("eid", "statement", "at", "container", F.explode(F.array(F.struct(F.col("braces").alias("level"), F.lit(0).alias("outer")), F.struct((F.col("braces") + 1).alias("level"), F.lit(1).alias("outer")))).alias("x")).select(
        "eid", "statement", "at", "x.*", F.when(F.col("x.outer") == 1, F.col("container")).alias("holds")
    )
    at_level = Window.partitionBy("eid", "level").orderBy("at", "outer").rowsBetween(Window.unboundedPreceding, -1)
    places = sides.withColumn("defines", F.coalesce(F.last("holds", True).over(at_level), F.lit(True))).where("outer = 0").select("eid", "statement", "defines")
    found = found.join(places, ["eid", "statement"], "left")
    cpp = F.col("family") == "cpp"
    plain = F.col("equals").isNull() | (F.col("equals") > F.col("paren"))
    function = block & ~none & plain & ~F.col("first").isin(*CONTROL) & F.col("defines") & ~container
    bodiless = cpp & (F.col("end.t") == ";") & ~none & F.col("defaulted")
    declared = cpp & (F.col("end.t") == ";") & F.col("equals").isNull() & (F.col("first") == "using")
    alias = cpp & (F.col("end.t") == ";") & (F.col("first") == "namespace")
    head = cpp & container & ~F.col("enum")
    start = F.coalesce("space_s", "type_s")
    ranges = F.array_compact(
        F.array(
            F.when(function, F.struct(F.col("s").alias("s"), F.col("end.s").alias("e"))),
            F.when(bodiless | declared | alias, F.struct(F.col("s").alias("s"), F.col("e").alias("e"))),
            F.when(head & start.isNotNull(), F.struct(start.alias("s"), F.col("end.s").alias("e"))),
        )
    )
    heads = found.select("eid", F.explode(ranges).alias("x")).select("eid", "x.s", "x.e")
    # A class or struct named without a body.
    named = rows.where((F.col("family") == "cpp") & t.isin("class", "struct") & F.col("next_t").rlike(rf"^{_WORD}$"))
    bare = found.where("not container and first <> 'template' and not enum").select("eid", "statement")
    named = named.join(bare, ["eid", "statement"]).select("eid", "s", F.col("next_e").alias("e"))
    return conditional.unionAll(heads).unionAll(named)


def dropped_ranges(ex: DataFrame) -> DataFrame:
    """(eid, s, e), merged: what of each text (eid, code, lang) is no live code."""
    gone = None
    for heads, names in ((python_heads, ["python"]), (c_heads, ["c", "cpp"])):
        own = [k for k, v in LANGUAGES.items() if v in names]
        rows = tokens(ex.where(F.lower("lang").isin(own)))
        both = rows.where("kind in ('comment', 'directive')").select("eid", "s", "e").unionAll(heads(rows))
        gone = both if gone is None else gone.unionAll(both)
    return merge_spans(gone.where("s < e"), ["eid"]).select("eid", "s", "e")


def live_code(ex: DataFrame) -> DataFrame:
    """(eid, s, e) of the live ranges of each text (eid, code, lang)."""
    sizes = ex.select("eid", F.length("code").cast("long").alias("n"))
    gone = dropped_ranges(ex).select("eid", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    return complement(gone, sizes)
