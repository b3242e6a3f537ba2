"""Column builders on text: patterns, lexicons, paths, slugs, token kinds and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named patterns of risky calls.
RISKY_PATTERNS = {
    "sql-template-string": r"(?i)`[^`]*SELECT[^`]*\$\{",
    "sql-f-string": r'(?i)f"[^"]*SELECT[^"]*\{',
    "sql-pyformat": r'(?i)"[^"]*SELECT[^"]*%s',
    "sql-concat-plus": r'(?i)"\s*SELECT[^"]*"\s*\+',
    "eval-call": r"\beval\s*\(",
    "exec-shell": r"\bexec(Sync)?\s*\(\s*[`'\"][^`'\"]*\$\{?",
    "shell-true": r"shell\s*=\s*True",
    "os-system": r"\bos\.system\s*\(",
    "yaml-load-unsafe": r"yaml\.load\s*\(\s*[^,)]+\s*\)",
    "pickle-loads": r"\bpickle\.loads?\s*\(",
    "math-random": r"Math\.random\s*\(",
    "md5-hash": r"(?i)md5\s*\(",
    "sha1-hash": r"(?i)\bsha1\s*\(",
    "path-concat": r"['\"]\s*/var/data/?['\"]\s*\+",
    "child-process-exec": r"child_process\.exec\s*\(",
    "innerHTML": r"\.innerHTML\s*=",
    "strcpy": r"\bstrcpy\s*\(",
    "sprintf-user": r"\bsprintf\s*\([^,]+,[^,]+,",
    "memcpy-user": r"\bmemcpy\s*\(",
}

#: Words of the security lexicon, by group.
LEXICON = {
    "sql": "SELECT INSERT UPDATE DELETE WHERE execute executemany query cursor",
    "cmd": "system popen exec execve execl subprocess shell Popen",
    "path": "open fopen realpath basename dirname",
    "mem": "strcpy strcat memcpy memmove malloc calloc realloc free sizeof len idx index NULL alloca sprintf gets",
}

#: File endings and the languages they stand for, and the usual ending of a language.
EXTENSIONS = {"c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rb": "ruby", "php": "php"}
ENDINGS = {"c": ".c", "cpp": ".cpp", "python": ".py", "javascript": ".js", "typescript": ".ts", "java": ".java", "go": ".go", "ruby": ".rb", "php": ".php"}


#: Fixed value: where input from outside enters.
INPUT_SOURCE = (
    r"req\.(?:query|body|params|cookies|headers)(?:\.[\w\[\]'\"]+)?|request\.(?:args|form|values|json|GET|POST)\[?|sys\.argv\[?\d*\]?"
    r"|os\.environ(?:\.get)?\[?|input\(|process\.argv|process\.env\.\w+"
)
_RANDOM = r"Math\.random|random\.random\(|random\.randint|random\.choice|rand\(\)|mt_rand"
_EVAL = r"\beval\s*\(|\bexec\s*\(|Function\s*\(|new\s+Function|setTimeout\s*\(\s*['\"]|vm\.runIn"
_HASH = r"\bMD5\b|\bSHA1\b|md5\(|sha1\(|hashlib\.md5|hashlib\.sha1|createHash\(\s*['\"](?:md5|sha1)['\"]|DES\b|RC4\b|MD4\b"

#: Patterns of a class's sinks, and of its sources where it has any.
CLASS_PATTERNS = {
    "CWE-89": (r"db\.query|cursor\.execute|connection\.query|conn\.execute|execute\s*\(|executemany\s*\(|\.raw\s*\(|session\.execute|Session\.execute", INPUT_SOURCE),
    "CWE-78": (
        r"\bexec\b|\bspawn\b|execSync|execFile|spawnSync|os\.system|subprocess\.(?:call|run|Popen|check_output)|child_process\.\w+|shell_exec|popen\(",
        INPUT_SOURCE,
    ),
    "CWE-22": (
        r"fs\.readFile|fs\.readFileSync|fs\.writeFile|fs\.createReadStream|\bopen\s*\(|\.read_text\(|\.read_bytes\(|pathlib\.Path\(|os\.path\.join\(|send_file\(|sendFile\(",
        INPUT_SOURCE,
    ),
    "CWE-79": (
        r"innerHTML|outerHTML|document\.write|document\.writeln|res\.send\(|response\.write\(|render_template_string\(|dangerouslySetInnerHTML|\$\(.*\)\.html\(",
        INPUT_SOURCE,
    ),
    "CWE-330": (_RANDOM, ""),
    "CWE-338": (_RANDOM, ""),
    "CWE-502": (
        r"pickle\.loads?\(|cPickle\.loads?\(|yaml\.load\(|yaml\.unsafe_load\(|marshal\.loads\(|JSON\.parse\(|unserialize\(|node-serialize",
        INPUT_SOURCE,
    ),
    "CWE-94": (_EVAL, INPUT_SOURCE),
    "CWE-95": (_EVAL, INPUT_SOURCE),
    "CWE-327": (_HASH, ""),
    "CWE-328": (_HASH, ""),
    "CWE-798": (r"(?:password|passwd|secret|api[_-]?key|token|auth)\s*[:=]\s*['\"][^'\"\s]+['\"]", ""),
    "CWE-345": (r"verify\s*=\s*False|rejectUnauthorized\s*:\s*false|InsecureRequestWarning|ssl\._create_unverified", ""),
    "CWE-208": (r"==\s*['\"]|!=\s*['\"]|\.equals\(|strcmp\(|memcmp\(", ""),
    "CWE-185": (r"re\.compile\(|new RegExp\(|\.match\(|\.test\(|\.search\(", INPUT_SOURCE),
    "CWE-908": (r"\bmalloc\(|\bcalloc\(|uninitialized|free\(", ""),
    "CWE-770": (r"\bread\(|recv\(|while\s+True|for\s*\(;;\)|\.repeat\(", INPUT_SOURCE),
    "CWE-312": (r"(?:password|secret|token|api[_-]?key)\s*[:=]", ""),
    "CWE-119": (r"strcpy\(|strcat\(|sprintf\(|gets\(|memcpy\(", INPUT_SOURCE),
    "CWE-319": (r"http://|ftp://|telnet://|verify\s*=\s*False", ""),
}
#: Fixed value: calls that check or escape a value.
SANITIZER = (
    r"(?i)\bvalidate\w*\(|\bsanitize\w*\(|\bescape\w*\(|isInteger\(|parseInt\(|parseFloat\(|re\.escape\(|html\.escape\(|cgi\.escape\("
    r"|shlex\.quote\(|shell_quote\(|bindParam\(|prepare\(|\bquote\(|encodeURIComponent\(|encodeURI\(|DOMPurify|bleach\.clean\("
    r"|markupsafe\.escape\(|isinstance\("
)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def risky_calls(text: Column, patterns: dict[str, str] = RISKY_PATTERNS) -> Column:
    """How often the patterns match in all."""
    total = F.lit(0).cast("long")
    for p in patterns.values():
        total = total + count_of(text, p)
    return total


def lexicon_pattern(words: str) -> str:
    return "|".join(rf"\b{w}\b" for w in words.split())


def saturating(n: Column) -> Column:
    """1 - exp(-n): 0 for none, near 1 for several."""
    return 1 - F.exp(-n)


def lookup(key: Column, table: dict[str, str], otherwise: str | None) -> Column:
    """A small table of fixed values as an expression."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), key), F.lit(otherwise))


def language_of_file(name: Column, otherwise: str = "c") -> Column:
    """Language by the ending of a file name; names without one count as ``otherwise``."""
    return lookup(F.lower(F.substring_index(name, ".", -1)), EXTENSIONS, otherwise)


def slug(text: Column, fallback: str) -> Column:
    """Runs of characters that no path should hold become one dash; none at the ends; lower case."""
    s = F.lower(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.\-]+", "-"), r"^[.\-]+|[.\-]+$", ""))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(fallback)).otherwise(s)


def model_slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_")


#: Kinds of tokens with their patterns, tried in this order; what is left is an identifier.
TOKEN_KINDS = {
    "punctuation": r"^[^0-9A-Za-z]*$",
    "path": r"(?i)(ssh|svctask|svcinfo|svcuser|chown|rmhost|-name|mpol_|/|\.\.)",
    "db-api": r"(?i)(cursor|execute|\.query|order_by|fetchone|fetchall|\.format)",
    "sql": r"(?i)\b(select|insert|update|delete|where|from|set|values|order\s+by|group\s+by|like|join|union)\b|insert\s+into|(^|\s)(and|or)(\s|$)",
}


def token_kind(word: Column, kinds: dict[str, str] = TOKEN_KINDS, otherwise: str = "identifier") -> Column:
    out = F.lit(otherwise)
    for name, pattern in reversed(kinds.items()):
        out = F.when(word.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def line_start(text: Column, offset: Column) -> Column:
    """0-based start of the line that holds the 0-based ``offset``."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.element_at(F.split(before, "\n"), -1))


def whole_lines(text: str, s: str, e: str) -> tuple[Column, Column]:
    """The range [s, e) of column ``text`` grown to whole lines, the last one's line feed included."""
    start = line_start(F.col(text), F.col(s))
    feed = F.expr(f"locate('\\n', `{text}`, cast(greatest(`{e}`, `{s}` + 1) as int))")
    return start, F.when(feed == 0, F.length(text)).otherwise(feed)


def last_line(text: Column) -> tuple[Column, Column]:
    """Range of the last line; a line feed at the very end is not counted; the whole text if that line is empty."""
    end = F.length(text) - F.endswith(text, F.lit("\n")).cast("int")
    body = F.substring(text, F.lit(1), end)
    start = end - F.length(F.element_at(F.split(body, "\n"), -1))
    empty = start >= end
    return F.when(empty, 0).otherwise(start), F.when(empty, F.length(text)).otherwise(end)


def fixed_or_na(x: Column, digits: int = 3) -> Column:
    """``0.123``, or ``n/a`` where there is no number."""
    return F.when(x.isNull() | F.isnan(x), "n/a").otherwise(F.format_string(f"%.{digits}f", x))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two texts share."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.least(F.length(a), F.length(b))).otherwise(first - 1)
