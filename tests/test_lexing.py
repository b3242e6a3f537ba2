"""Live code of texts in Python, C and C++: what is left is given in full."""

import pytest

#: What must be left of each text, white space aside; fixed cases.
CASES = {
    "python": [
        ("# top\nimport os\nfrom a import (b,\n  c)\n\ndef f(x: int) -> int:\n    y = x + 1\n    return y\n", "y=x+1returny"),
        ("def q(name):\n    sql = f\"SELECT # {name}\"  # why\n    return sql\n", 'sql=f"SELECT#{name}"returnsql'),
        ("@cache\n@retry(3,\n  4)\nasync def f():\n    return 1\n", "return1"),
        ("class A(B, metaclass=M): x = 1; import os; y = {'a': 2}\n", "x=1;;y={'a':2}"),
        ("if x: import os\nelse: y = 'import # os'\n", "ifx:else:y='import#os'"),
        ("def f(a={'k': 1},\n      b=lambda: 3):\n    '''doc # no \" comment'''\n    pass\n", "'''doc#no\"comment'''pass"),
        ("x = '\\'# in' # out\ny = '''a\n# in\n'''\nz = (1, # gone\n 2)\n", "x='\\'#in'y='''a#in'''z=(1,2)"),
        ("def f():\n    # first\n    def g():\n        return 2\n", "return2"),
        ("x = ')' # )\nimport os\n\\\n", "x=')'\\"),
        ("x = \"open\ny = 'a' # b\n", "x=\"openy='a'"),
        ("été = 1 # ça\ndef é(ü): return ü\n", "été=1returnü"),
        ("", ""),
        ("def f(", ""),
    ],
    "c": [
        ("#include <stdio.h>\n// header\nint main(int argc, char **argv) {\n    int x = 1;\n    return x;\n}\n", "{intx=1;returnx;}"),
        ('/* int f() { */ char *s = "/* in */"; // int g() {\nchar c = \'"\';\n', 'char*s="/*in*/";charc=\'"\';'),
        ("#if A\nint gone(void) { return 1; }\n#ifdef B\nx;\n#endif\ny;\n#else\nz;\n#endif\nint kept;\n#define M(a) \\\n  a + 1\nint k2;\n", "intkept;intk2;"),
        ("struct s { int a; };\nint t[] = {1, 2};\nint d(int);\n", "structs{inta;};intt[]={1,2};intd(int);"),
        ("static int\nf (a, b)\n{\n  if (a) { g(b); } else while (b) { b--; }\n  for (;;) { }\n  return (x) ? 1 : 2;\n}\nint g(void){}", "{if(a){g(b);}elsewhile(b){b--;}for(;;){}return(x)?1:2;}{}"),
        ("int f() { /* open", "{"),
        ("#endif\nint x; }\nint f() { y; }", "intx;}{y;}"),
    ],
    "cpp": [
        ("#include <string>\nnamespace ns {\n    int g() {\n        return 42;\n    }\n}\n", "{{return42;}}"),
        ("using namespace std;\nusing a::b;\nusing T = int;\nnamespace x = y;\nclass A : public B {\npublic:\n  A(int x) : y(x) { z(); }\n  ~A() = default;\n  int h() const { auto f = [&](int q) { return q; }; return f(1); }\n  virtual int p() = 0;\n};\n", "usingT=int;{public:{z();}{autof=[&](intq){returnq;};returnf(1);}virtualintp()=0;};"),
        ("struct P { int a; };\nstruct P q;\nenum class E { A, B };\nbool operator==(const P& a, const P& b) { return a.a == b.a; }\n", "{inta;};q;enumclassE{A,B};{returna.a==b.a;}"),
        ("template <class T> T m(T a) { return a; }\nextern \"C\" { void f(int a) { FOR(x) { y; } } }\n", '{returna;}extern"C"{{FOR(x){y;}}}'),
    ],
}


def texts():
    return [(f"{lang}{i}", code, lang, left) for lang, cases in CASES.items() for i, (code, left) in enumerate(cases)]


@pytest.fixture(scope="module")
def ranges(spark):
    from lumenspan.operators.lexing import live_code

    rows = [(eid, code, lang) for eid, code, lang, _ in texts()]
    rows += [("other", "let x = 1; // kept", "rust"), ("none", "x # y", None), ("null", None, "python"), ("alias", "int f() { a; } // b", "CXX")]
    out = {eid: [] for eid, _, _ in rows}
    for r in live_code(spark.createDataFrame(rows, "eid string, code string, lang string").repartition(3)).orderBy("eid", "s").collect():
        out[r["eid"]].append((r["s"], r["e"]))
    return out, {eid: code for eid, code, _ in rows}


def kept(ranges, eid):
    out, codes = ranges
    return "".join("".join(codes[eid][s:e] for s, e in out[eid]).split())


@pytest.mark.parametrize("case", texts(), ids=lambda c: c[0])
def test_live_code(ranges, case):
    assert kept(ranges, case[0]) == case[3]


def test_unknown_languages_keep_all(ranges):
    assert ranges[0]["other"] == [(0, 18)] and ranges[0]["none"] == [(0, 5)] and ranges[0]["null"] == []
    assert kept(ranges, "alias") == "{a;}"


def test_very_long_tokens(spark):
    from lumenspan.operators.lexing import live_code

    n = 300_000
    rows = [(1, "x = '" + "\\n" * n + "'\n#" + "c" * n, "py"), (2, 'x = "' + "a\\\\" * n + '"; /*' + "*" * n + "*/ y;", "c"), (3, "'''" + "''x\\'" * n + "'''", "py"), (4, "#define a \\\n" * n + "x;\n", "c")]
    got = {}
    for r in live_code(spark.createDataFrame(rows, "eid long, code string, lang string")).collect():
        got.setdefault(r["eid"], []).append((r["s"], r["e"]))
    assert sorted(got[1]) == [(0, 5 + 2 * n + 2)]
    assert sum(e - s for s, e in got[2]) == 5 + 3 * n + 2 + 1 + 3 and sum(e - s for s, e in got[3]) == len(rows[2][1])
