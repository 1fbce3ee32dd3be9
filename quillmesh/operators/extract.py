"""Extraction from source text and logs: symbols, imports, stack frames, errors, diffs, references.

Source text becomes an array of tokens (words, strings, marks), in the row where the content is read. Every rule looks at
tokens and their neighbours: a declaration is a small automaton over a line's tokens, an import is a string or a run
of words behind an introducing word, a reference is a name with certain tokens beside it. Line numbers come from exploding
lines with their position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.session import staged

TOKEN = r"""\w+|"[^"\n]*"|'[^'\n]*'|`[^`\n]*`|::|->|=>|\S"""
#: Tokens of a line that a declaration may take.
MOST_TOKENS = 60


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_word(token: Column) -> Column:
    return token.rlike(r"^\w+$")


def is_string(token: Column) -> Column:
    return token.rlike("""^['"].*['"]$""")


def unquoted(token: Column) -> Column:
    return token.substr(F.lit(2), F.length(token) - 2)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: What declares a symbol, by kind and language; languages share words where they share a family.
DECLARING = {
    "class": {"class": "python php ruby java typescript javascript other", "struct": "rust other", "enum": "rust java other", "trait": "other", "interface": "other", "type": "other", "module": "ruby"},
    "interface": {"interface": "php java typescript", "trait": "php rust", "type": "typescript"},
    "function": {"def": "python ruby", "function": "php javascript typescript", "fn": "rust", "impl": "rust", "func": "go"},
    "go type": {"type": "go"},
}
#: Words that may stand before, by language.
BEFORE = {"python": "async", "rust": "pub async unsafe const", "typescript": "export default declare abstract async", "javascript": "export default async", "other": "export",
          "php": "public protected private static abstract final readonly", "java": "public protected private static abstract final sealed open override async"}
#: Words before a member of a class, in any language.
MEMBER = ("public", "protected", "private", "static", "abstract", "final", "readonly", "override", "async", "get", "set")
_OTHERS = ("python", "php", "ruby", "rust", "go", "java", "typescript", "javascript")
#: Languages that are read like another.
ALIASES = {"kotlin": "java", "swift": "java", "csharp": "java"}
KINDS = {f"{lang} {word}": kind for kind, words in DECLARING.items() for word, langs in words.items() for lang in langs.split()}
# Words that look like names in these patterns.
NO_NAMES = (
    "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return", "try", "catch", "finally", "throw", "new", "this", "super",
    "import", "export", "from", "as", "default", "const", "let", "var", "true", "false", "null", "undefined", "void", "typeof", "instanceof",
    "in", "of", "with", "yield", "await", "async", "static", "get", "set", "constructor", "extends", "implements", "private", "public", "protected")
#: Lines that a symbol spans at most.
MAX_SPAN = 500


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in values.items() for x in p])


def declared(toks: Column, lang: Column) -> Column:
    """(kind, name) of the symbol that a line declares by a declaring word, null for none. An automaton reads the tokens:
    words that may stand before (0), the declaring word, what may stand before a name (1), the name (2) and, of a Go
    type, what kind of type (3). What is in brackets is passed by."""
    known, before = _map(KINDS), F.array(*[F.lit(f"{k} {w}") for k, ws in BEFORE.items() for w in ws.split()])
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"))

    def step(acc, t):
        opens, closes = t.isin("(", "[", "<"), t.isin(")", "]", ">")
        depth = acc["depth"] + opens.cast("int") - closes.cast("int")
        inside = opens | closes | (acc["depth"] > 0)
        own = F.concat(lang, F.lit(" "), t)
        kind = F.element_at(known, own)
        at = (F.when(acc["at"] == 9, 9).when(inside, acc["at"])
              .when(acc["at"] == 0, F.when(kind.isNotNull(), 1).when(F.array_contains(before, own), 0).otherwise(9))
              .when(acc["at"] == 1, F.when(t.isin("*", "&", ".", "self"), 1).when(is_word(t), 2).otherwise(9))
              .when((acc["at"] == 2) & (acc["kind"] == "go type"), F.when(t.isin("struct", "interface"), 3).otherwise(9)).otherwise(acc["at"]))
        new_kind = F.when(~inside & (acc["at"] == 0), kind).when((at == 3) & (acc["at"] == 2), F.when(t == "struct", "class").otherwise("interface")).otherwise(acc["kind"])
        return F.struct(at.alias("at"), depth.alias("depth"), new_kind.alias("kind"), F.when((at == 2) & (acc["at"] == 1), t).otherwise(acc["name"]).alias("name"))

    done = lambda acc: F.when((acc["at"] >= 2) & (acc["at"] < 9) & (acc["kind"] != "go type"), F.struct(acc["kind"].alias("kind"), acc["name"].alias("name")))
    return F.aggregate(F.slice(toks, 1, MOST_TOKENS), start, step, done)


def _first(toks: Column, wanted) -> Column:
    """The place, from 0, of the first token that ``wanted`` holds for; -1 for none."""
    return (F.array_position(F.transform(toks, wanted), True) - 1).cast("int")


def undeclared(toks: Column, lang: Column) -> Column:
    """(kind, name) of the function that a line has without a declaring word, null for none: a variable that is given an
    arrow function, a member followed by parameters and a body, a member with a type before its name, a call by itself."""
    at = lambda i: F.get(toks, i)
    count = lambda x: F.size(F.filter(toks, lambda t: t == x))
    script = lang.isin("typescript", "javascript")
    lead = (at(F.lit(0)) == "export").cast("int")
    given, arrow, params = _first(toks, lambda t: t == "="), _first(toks, lambda t: t == "=>"), _first(toks, lambda t: t == "(")
    value = given + 1 + (at(given + 1) == "async").cast("int")
    is_arrow = script & at(lead).isin("let", "const", "var") & (given > lead) & (arrow > given) & ((at(value) == "(") | (at(value + 1) == "=>"))
    member = _first(toks, lambda t: ~t.isin(*MEMBER))
    is_member = script & is_word(at(member)) & at(member + 1).isin("(", "<") & (F.element_at(toks, -1) == "{") & (count("(") == count(")")) & (params > 0)
    kind_of_type = at(params - 2)
    typed = (lang == "java") & (params - 2 >= member) & is_word(at(params - 1)) & (is_word(kind_of_type) | kind_of_type.isin(">", "]")) & ((given < 0) | (given > params))
    typed = typed & ~at(F.lit(0)).isin("return", "new", "throw", "else", "await")
    called = lead + at(lead).isin("function", "func", "fn", "def").cast("int")
    is_call = (lang == "other") & is_word(at(called)) & (at(called + 1) == "(")
    out = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    return F.when(F.size(toks) > 1, F.when(is_arrow, out("function", at(lead + 1))).when(is_member, out("method", at(member))).when(typed, out("method", at(params - 1))).when(is_call, out("function", at(called))))


def grammar(lang: Column, known: tuple[str, ...] = _OTHERS) -> Column:
    """The language by whose rules a file is read: aliases resolved, `other` for languages without rules."""
    out = F.coalesce(F.element_at(_map(ALIASES), lang), lang)
    return F.when(out.isin(*known), out).otherwise("other")


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """path, the columns ``keep``, line (from 1) and body."""
    return files.select("path", *keep, F.posexplode(F.split("content", r"\r?\n")).alias("line", "body")).withColumn("line", F.col("line") + 1)


def symbol_starts(files: DataFrame) -> DataFrame:
    """``files``: path, language, content. path, name, kind, start_line, signature; of several symbols of a name in a
    file the one of the first form and line."""
    ls = lines(files.filter("language <> 'unknown'"), "language").select("path", "line", "body", grammar(F.col("language")).alias("lang"), tokens(F.col("body")).alias("toks"))
    found = F.array_compact(F.array(declared(F.col("toks"), F.col("lang")), undeclared(F.col("toks"), F.col("lang"))))
    found = ls.filter(F.size("toks") > 1).select("path", "line", "body", F.posexplode(found).alias("ord", "s")).select("path", "line", "body", "ord", "s.*").filter(~F.col("name").isin(*NO_NAMES))
    first = F.row_number().over(Window.partitionBy("path", "name").orderBy("ord", "line"))
    return found.withColumn("rn", first).filter("rn = 1").select("path", "name", "kind", F.col("line").alias("start_line"), T.signature(F.col("body")).alias("signature"))


def symbols(files: DataFrame) -> DataFrame:
    """The rows of ``symbol_starts``, and their end_line. They are written, for the ends are found by them."""
    starts = staged(symbol_starts(files), "starts")
    return starts.join(symbol_ends(files, starts), ["path", "start_line"])


def symbol_ends(files: DataFrame, starts: DataFrame) -> DataFrame:
    """path, start_line, end_line: the first line at which the brackets opened since the start are closed
    again, or MAX_SPAN lines on, or the last line. All in the row of the file, which gets the list of its
    starts: a running sum over the lines from each start, kept to the span."""
    count = lambda body, chars: F.length(body) - F.length(F.translate(body, chars, ""))
    rows = files.select("path", F.transform(F.split("content", r"\r?\n"), lambda b: F.struct((count(b, "{(") - count(b, "})")).alias("delta"), (count(b, "{(") > 0).alias("opens"))).alias("ls"))
    rows = rows.join(starts.groupBy("path").agg(F.collect_set("start_line").alias("starts")), "path")  # at most the lines of a file
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("sum"), F.lit(False).alias("open"), F.lit(0).alias("end"))

    def step(acc, x):
        total, opened, at = acc["sum"] + x["delta"], acc["open"] | x["opens"], acc["at"] + 1
        return F.struct(at.alias("at"), total.alias("sum"), opened.alias("open"), F.when((acc["end"] == 0) & opened & (total == 0), at).otherwise(acc["end"]).alias("end"))

    used = lambda s: F.aggregate(F.slice("ls", s, F.lit(MAX_SPAN + 2)), begin, step, lambda acc: F.when(acc["end"] > 0, acc["end"]).otherwise(acc["at"]))
    ends = F.transform("starts", lambda s: F.struct(s.alias("start_line"), (s + used(s) - 1).alias("end_line")))
    return rows.select("path", F.explode(ends).alias("x")).select("path", "x.*")


# What marks a specifier as external.
VENDORS = {
    "php": ["Illuminate\\", "Symfony\\", "Psr\\", "GuzzleHttp\\", "Carbon\\", "Laravel\\"],
    "ruby": ["json", "yaml", "csv", "net/http", "uri", "fileutils", "pathname", "date", "time", "logger", "rails", "active_record", "active_support"],
    "java": ["java.", "javax.", "org.", "com.google."],
}
PYTHON_MODULES = ("os", "sys", "json", "typing", "collections", "functools", "itertools", "pathlib", "datetime", "re", "math", "random", "time", "logging", "unittest", "pytest", "django", "flask", "numpy", "pandas")


def is_external(lang: Column, spec: Column) -> Column:
    """Whether an import leaves the source tree."""
    begins = lambda words: F.reduce(F.array(*[F.lit(w) for w in words]), F.lit(False), lambda a, w: a | spec.startswith(w))
    return (F.when(lang.isin("typescript", "javascript"), ~spec.rlike(r"^(\.|/|[@~]/)"))
            .when(lang == "python", F.split(spec, r"\.")[0].isin(*PYTHON_MODULES))
            .when(lang == "go", ~spec.startswith(".") & (F.contains(spec, F.lit("github.com")) | ~F.contains(spec, F.lit("/")) | spec.startswith("golang.org")))
            .when(lang == "rust", ~spec.rlike("^(crate|super|self)"))
            .when(lang == "php", begins(VENDORS["php"])).when(lang == "ruby", begins(VENDORS["ruby"])).when(lang == "java", begins(VENDORS["java"])).otherwise(F.lit(False)))


def _run(toks: Column, start: Column, links: tuple[str, ...]) -> Column:
    """The name at a place: words with one of ``links`` between them, joined."""
    rest = F.slice(toks, start + 1, F.lit(MOST_TOKENS))
    odd = _first(rest, lambda t, i: ~(t.isin(*links) | (is_word(t) & ((i == 0) | F.get(rest, i - 1).isin(*links)))))
    return F.array_join(F.when(odd < 0, rest).otherwise(F.slice(rest, F.lit(1), odd)), "")


def _introduced(toks: Column, lang: Column) -> Column:
    """The imported specifiers among a file's tokens, in order; null where there is none."""
    at = lambda i: F.get(toks, i)

    def here(t, i):
        before, two_before = at(i - 1), at(i - 2)
        # The statement that a `from` belongs to begins with the last `import` or `export` before it.
        opening = F.filter(F.slice(toks, F.greatest(i - MOST_TOKENS, F.lit(0)) + 1, F.least(i, F.lit(MOST_TOKENS))), lambda x: x.isin("import", "export"))
        some = (before == "import") | ((before == "from") & (F.coalesce(F.try_element_at(opening, F.lit(-1)), F.lit("")) == "import")) | ((before == "(") & two_before.isin("import", "require"))
        script = F.when(is_string(t) & some, unquoted(t))
        loads = ("require", "require_once", "include", "include_once")
        php = F.when(is_string(t) & (before.isin(*loads) | ((before == "(") & two_before.isin(*loads))), unquoted(t)).when(is_word(t) & (before == "use"), _run(toks, i, ("\\",)))
        ruby = F.when(is_string(t) & before.isin("require", "require_relative"), unquoted(t))
        rust = F.when((before == "use") & t.isin("crate", "self", "super"), _run(toks, i, ("::",)))
        java = F.when(is_word(t) & (t != "static") & ((before == "import") | ((before == "static") & (two_before == "import"))), _run(toks, i, (".",)))
        return F.when(lang.isin("typescript", "javascript"), script).when(lang == "php", php).when(lang == "ruby", ruby).when(lang == "rust", rust).when(lang == "java", java)

    return F.transform(toks, here)


def _by_line(content: Column, lang: Column) -> Column:
    """The same for languages whose imports are lines: Python's first word, Go's lines that end in a string."""
    def here(line):
        def of(toks):
            first = F.get(toks, F.lit(0))
            python = F.when(first.isin("from", "import") & ~line.rlike(r"^\s"), _run(toks, F.lit(1), (".",)))
            last, rest = F.element_at(toks, -1), F.slice(toks, 1, F.size(toks) - 1)
            go = F.when((F.size(toks) <= 3) & is_string(last) & F.forall(rest, lambda t: is_word(t) | (t == ".")), unquoted(last))
            return F.when(F.size(toks) > 0, F.when(lang == "python", python).otherwise(go))
        return let(tokens(line), of)

    # Lines that cannot be imports are not read.
    return F.transform(F.filter(F.split(content, r"\r?\n"), lambda x: F.when(lang == "python", x.rlike("^(from|import)\\s")).otherwise(F.contains(x, F.lit('"')))), here)


def imports(files: DataFrame) -> DataFrame:
    """``files``: path, language, content. path, language, specifier of the imports within the tree, each once."""
    f = files.select("path", "content", grammar(F.col("language")).alias("lang")).filter(F.col("lang") != "other")
    lang = F.col("lang")
    found = F.when(lang.isin("python", "go"), _by_line(F.col("content"), lang)).otherwise(let(tokens(F.col("content")), lambda toks: _introduced(toks, lang)))
    specs = f.select("path", lang.alias("language"), F.explode(F.array_distinct(F.array_compact(found))).alias("specifier"))
    return specs.filter((F.col("specifier") != "") & ~is_external(F.col("language"), F.col("specifier")))


#: A place in a log: a file, what leads to its line, the line, and perhaps a column.
PLACE = r"""((?:[A-Za-z]:)?[^\s"'():,]*\.[A-Za-z]{1,6})(["']?,?\s+(?:on\s+)?line\s+|[:(])(\d+)(?::(\d+))?"""
#: The formats that tell a place in their own way, in order of precedence; the language of a bare place is that of its file.
FORMATS = ("php", "php-line", "javascript", "python", "java")
#: Folders from which a path counts, by format.
ROOTS = {"php": ("app", "tests", "vendor"), "javascript": ("src", "dist", "test", "tests", "node_modules"), "python": ("app", "src", "test", "tests")}
BARE = {"rb": "ruby", "go": "go", "rs": "rust"}
SOURCES = ("php", "js", "jsx", "ts", "tsx", "py", "rb", "go", "rs", "java", "vue", "svelte")
# What marks a frame as external.
EXTERNAL_FRAMES = r"node_modules/|vendor/|\.phar|(^|/)usr/|(^|/)opt/|site-packages/|\.gem/"


def frame_path(path: Column) -> Column:
    """A frame's path from its first directory on, with forward slashes."""
    p = F.replace(F.regexp_replace(path, "^file://", ""), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(p, r"^.*?(?=[A-Za-z]+/)", ""), "^/+", "")


def frames(logs: DataFrame) -> DataFrame:
    """``logs``: id, content. id, ord, grammar, file, line, col, function, message. Every place of every line is read once;
    its format follows from what leads to the line number and from how the log line begins. Of places with the same
    file name and line the one of the first format counts; external ones drop out; the first error message goes
    with the first frame."""
    ls = logs.select("id", F.posexplode(F.split("content", r"\r?\n")).alias("row", "body"))
    found = ls.select("id", "row", "body", F.posexplode(F.regexp_extract_all("body", F.lit(PLACE), F.lit(0))).alias("pos", "m"))
    get = lambda i: F.regexp_extract("m", PLACE, i)
    found = found.select("id", "row", "pos", "body", get(1).alias("raw"), F.btrim(get(2)).alias("lead"), get(3).cast("int").alias("line"), F.nullif(get(4), F.lit("")).cast("int").alias("col"),
                         F.call_function("substring_index", F.col("body"), F.col("m"), F.lit(1)).alias("head"), F.call_function("substring_index", F.col("body"), F.col("m"), F.lit(-1)).alias("tail"))
    ext, frame = F.lower(F.regexp_extract("raw", r"\.(\w+)$", 1)), F.regexp_replace("head", r"^\s+", "")
    kind = (F.when((F.col("lead") == "(") & frame.rlike(r"^#\d+\s"), "php").when((ext == "php") & F.col("lead").endswith("line") & ~frame.startswith("File "), "php-line")
            .when(frame.startswith("File ") & F.col("lead").endswith("line"), "python")
            .when((ext == "java") & frame.startswith("at ") & frame.endswith("("), "java").when((F.col("lead") == ":") & frame.rlike(r"^at\s") & F.col("raw").rlike(r"[/\\\\]"), "javascript")
            .when((F.col("lead") == ":") & ext.isin(*SOURCES), F.coalesce(F.element_at(_map(BARE), ext), F.lit("generic"))))
    found = found.withColumn("grammar", kind).filter("grammar is not null")
    called = F.btrim(F.regexp_replace(F.regexp_replace("head", r"^\s*at\s", ""), r"\($", ""))  # what is between `at` and the bracket
    named = F.regexp_extract("tail", r"^:in\s+[`']([^']+)'", 1)
    function = (F.when(F.col("grammar") == "php", F.regexp_replace("tail", r"^\):?\s*", "")).when(F.col("grammar") == "python", F.regexp_extract("tail", r"^,\s*in\s+(.+)$", 1))
                .when(F.col("grammar") == "java", F.element_at(F.split(called, r"\."), -1)).when(F.col("grammar") == "javascript", called).otherwise(named))
    package = F.concat(F.array_join(F.slice(F.split(called, r"\."), F.lit(1), F.greatest(F.size(F.split(called, r"\.")) - 1, F.lit(0))), "/"), F.lit(".java"))
    file = F.when(F.col("grammar") == "java", package)
    for name, roots in ROOTS.items():
        file = file.when(F.col("grammar") == name, F.regexp_replace("raw", rf"^.*?(?=(?:{'|'.join(roots)})/)", ""))
    g = F.array_position(F.array(*[F.lit(x) for x in FORMATS]), F.col("grammar"))
    every = found.select("id", F.when(g == 0, len(FORMATS) + 1).otherwise(g).alias("g"), "row", "pos", "grammar", file.otherwise(F.col("raw")).alias("raw"), frame_path(file.otherwise(F.col("raw"))).alias("file"), "line", "col", F.nullif(F.btrim(function), F.lit("")).alias("function"))
    every = every.filter((F.col("line") > 0) & ~F.col("raw").rlike(EXTERNAL_FRAMES) & ~F.col("file").rlike(EXTERNAL_FRAMES))
    once = F.row_number().over(Window.partitionBy("id", T.basename(F.col("file")), "line").orderBy("g", "row", "pos"))
    kept = every.withColumn("rn", once).filter("rn = 1")
    kept = kept.withColumn("ord", F.row_number().over(Window.partitionBy("id").orderBy("g", "row", "pos")))
    first = error_messages(logs).filter("ord = 1").select("id", F.lit(1).alias("ord"), "message")
    return kept.join(first, ["id", "ord"], "left").select("id", "ord", "grammar", "file", "line", "col", "function", "message")


#: What stands before an error message, the most telling first: (words, what separates them from the message).
ERRORS = [(r"(?:fatal|parse|syntax)\s+error", r":\s*"), (r"\w*(?:error|exception)", r":\s*"), (r"uncaught(?:\s+\w+:)?", r"\s+"), (r"(?:error|exception|fatal|failed)", r"[\s:]+(?!error\b)")]
#: Where it ends: at the place it names, or with the line.
_ENDS = r"(?=\s+(?:in|at)\s|\s*$)"


def error_messages(logs: DataFrame) -> DataFrame:
    """``logs``: id, content. id, ord, message: distinct messages of 6 to 499 characters in order of telling words and place."""
    patterns = [rf"(?im)\b{words}{gap}(\S.*?){_ENDS}" for words, gap in ERRORS]
    found = F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns]))
    kept = F.array_distinct(F.filter(found, lambda m: (F.length(m) > 5) & (F.length(m) < 500)))
    return logs.select("id", F.posexplode(kept).alias("ord", "message")).select("id", (F.col("ord") + 1).alias("ord"), "message")


TIMESTAMP = r"(\d{4}-\d{2}-\d{2})[T\s](\d{2}:\d{2}:\d{2})"


def since(logs: DataFrame, cutoff: Column, keep_untimed: bool = False) -> DataFrame:
    """``logs``: id, line, body. Lines from ``cutoff`` on: a line without a timestamp shares the fate of
    the last one with it (before the first it stays), or stays always with ``keep_untimed``."""
    at = F.to_timestamp(F.nullif(F.concat_ws(" ", F.regexp_extract("body", TIMESTAMP, 1), F.regexp_extract("body", TIMESTAMP, 2)), F.lit(" ")))
    last = at if keep_untimed else F.last(at, ignorenulls=True).over(Window.partitionBy("id").orderBy("line"))
    return logs.withColumn("__at", last).filter(F.col("__at").isNull() | (F.col("__at") >= cutoff)).drop("__at")


def name_status(diffs: DataFrame) -> DataFrame:
    """``diffs``: id, content as of `git diff --name-status`. id, file, status."""
    rows = diffs.select("id", F.explode(F.split("content", r"\r?\n")).alias("body")).withColumn("p", F.split("body", "\t")).filter(F.size("p") >= 2)
    code = F.substring(F.col("p")[0], 1, 1)
    status = F.when(code == "A", "added").when(code == "D", "deleted").when(code == "R", "renamed").otherwise("modified")
    return rows.select("id", F.element_at("p", -1).alias("file"), status.alias("status"))


def diff_entries(statuses: DataFrame, numstats: DataFrame) -> DataFrame:
    """Both as git prints them. id, file, status, additions, deletions: one join, no command per file."""
    rows = numstats.select("id", F.explode(F.split("content", r"\r?\n")).alias("body")).withColumn("p", F.split("body", "\t")).filter(F.size("p") >= 3)
    n = rows.select("id", F.element_at("p", -1).alias("file"), F.expr("try_cast(p[0] as bigint)").alias("additions"), F.expr("try_cast(p[1] as bigint)").alias("deletions"))
    out = name_status(statuses).join(n, ["id", "file"], "left")
    return out.select("id", "file", "status", F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"))


HUNK = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def changed_lines(diffs: DataFrame) -> DataFrame:
    """``diffs``: id, content of a diff without surrounding lines. id, line."""
    h = diffs.select("id", F.explode(F.regexp_extract_all("content", F.lit(HUNK), F.lit(0))).alias("h"))
    start, count = F.regexp_extract("h", HUNK, 1).cast("int"), F.coalesce(F.expr(f"try_cast(regexp_extract(h, r'{HUNK}', 2) as int)"), F.lit(1))
    h = h.select("id", start.alias("start"), count.alias("n")).filter("n > 0")
    return h.select("id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("line")).distinct()


# How names of classes with a role end.
_ROLES = ("Controller", "Service", "Model", "Repository", "Factory", "Handler", "Provider", "Middleware", "Request", "Resource", "Event", "Listener", "Job", "Command", "Policy", "Rule", "Exception",
          "Interface", "Trait", "Helper", "Manager", "Facade", "Client", "Gateway", "Adapter", "Builder", "Validator", "Observer", "Seeder", "Migration")
#: Folders that begin a path wherever it stands, and the verbs of routes.
TOP_FOLDERS = ("src", "lib", "app", "routes", "resources", "database", "config", "spec", "specs", "test", "tests")
VERBS = ("get", "post", "put", "patch", "delete", "options")
# Constants and methods too common to be references, and extensions of reference paths.
COMMON_CONSTANTS = ("HTTP", "API", "DB", "URL", "JSON", "XML", "HTML", "CSS", "SQL", "TRUE", "FALSE", "NULL", "VOID", "INT", "STRING", "BOOL", "ARRAY", "ENV", "CONFIG", "LOG", "DEBUG", "ERROR", "WARNING", "INFO")
COMMON_METHODS = (
    "get", "set", "has", "is", "to", "from", "add", "remove", "delete", "find", "all", "first", "last", "count", "each", "map", "filter", "push", "pop", "shift", "unshift", "slice", "splice", "concat",
    "log", "error", "warn", "info", "debug", "trace", "then", "catch", "finally", "resolve", "reject", "render", "mount", "update", "destroy", "init", "create", "save", "load", "fetch", "send", "receive",
    "open", "close", "read", "write", "flush", "on", "off", "emit", "trigger", "dispatch", "call", "apply", "bind", "toString", "toArray", "toJson", "toObject", "where", "select", "insert")
PATH_EXTENSIONS = ("php", "js", "ts", "jsx", "tsx", "vue", "svelte", "py", "rb", "go", "rs", "java", "kt", "swift", "c", "cpp", "h", "hpp", "cs", "html", "css", "scss", "sass", "less", "json", "yaml", "yml", "toml", "xml",
                   "md", "txt", "sql", "graphql", "gql", "blade", "twig", "ejs", "hbs", "pug", "env", "sh", "bash", "zsh")


def _named(toks: Column) -> Column:
    """Classes and methods that tokens refer to, by what stands beside a name: arrays of (kind, ref)."""
    at = lambda i: F.coalesce(F.get(toks, i), F.lit(""))
    ref = lambda kind, name, cond: F.when(cond, F.struct(F.lit(kind).alias("kind"), name.alias("ref")))

    def here(t, i):
        before, after = at(i - 1), at(i + 1)
        quoted = F.regexp_replace(F.regexp_replace(t, "^`|`$", ""), r"\(\)$", "")
        capital = lambda x: x.rlike("^[A-Z][A-Za-z0-9]+$")
        small = lambda x: x.rlike(r"^[a-z]\w+$") & (F.length(x) > 2)
        uncommon, unusual = ~F.upper(t).isin(*COMMON_CONSTANTS), lambda x: ~x.isin(*COMMON_METHODS)
        doc = before.isin("throws", "return", "param", "type", "var") & (at(i - 2) == "@") | ((before == "\\") & (at(i - 3) == "@"))
        opening = F.filter(F.slice(toks, F.greatest(i - 12, F.lit(0)) + 1, F.least(i, F.lit(12))), lambda x: x.isin("use", "namespace", "new", ";"))
        used = after.isin(";", "as") & ((before == "use") | ((before == "\\") & (F.coalesce(F.try_element_at(opening, F.lit(-1)), F.lit("")) == "use")))
        is_class = capital(t) & (((before == "new") & (after == "(")) | before.isin("implements", "extends") | doc | used | ((after == "::") & is_word(at(i + 2)) & uncommon) | reduce(lambda a, r: a | t.endswith(r), _ROLES, F.lit(False)))
        is_method = small(t) & (((before == "function") & (after == "(")) | (before.isin("::", "->") & (after == "(") & unusual(t)))
        text_of = unquoted(t)
        listed = is_string(t) & small(text_of) & (((before == ",") & (at(i - 2) == "class") & (at(i - 3) == "::") & (after == "]")) | ((before == "=>") & at(i - 2).isin("'action'", '"action"')))
        code = t.startswith("`") & (F.length(t) > 2)
        parts = F.split(quoted, "::")
        owner, own = F.get(parts, F.lit(0)), F.element_at(parts, -1)
        route = F.when(is_string(t) & (before == "(") & F.lower(at(i - 2)).isin(*VERBS, "any") & (((at(i - 3) == "::") & (at(i - 4) == "Route")) | ((at(i - 3) == ".") & at(i - 4).isin("router", "app"))),
                       F.struct(F.lit("route").alias("kind"), F.concat(F.upper(at(i - 2)), F.lit(" "), text_of).alias("ref")))
        return F.array(ref("class", t, is_class), ref("method", t, is_method), ref("method", text_of, listed),
                       ref("class", owner, code & (F.size(parts) <= 2) & capital(owner) & ~F.upper(owner).isin(*COMMON_CONSTANTS)),
                       ref("method", own, code & t.endswith("()`") & small(own) & unusual(own) & ((F.size(parts) == 1) | capital(owner))), route)

    return F.flatten(F.transform(toks, here))


def _pathlike(words: Column) -> Column:
    """Paths and routes among words (see ``references``), each as (kind, ref)."""
    at = lambda i: F.coalesce(F.get(words, i), F.lit(""))

    def here(w, i):
        bare = F.regexp_replace(w, r"^(\]|\./)", "")
        is_path = bare.rlike(r"^[\w./-]+\.[A-Za-z]{2,5}$") & F.contains(bare, F.lit("/")) & F.lower(F.regexp_extract(bare, r"\.(\w+)$", 1)).isin(*PATH_EXTENSIONS)
        told = w.startswith("]") | w.startswith("./") | F.split(bare, "/")[0].isin(*TOP_FOLDERS) | at(i - 1).isin("include", "include_once", "require", "require_once")
        is_route = w.startswith("/") & F.lower(at(i - 1)).isin(*VERBS, "head")
        return (F.when(is_path & told, F.struct(F.lit("path").alias("kind"), bare.alias("ref")))
                .when(is_route, F.struct(F.lit("route").alias("kind"), F.concat(F.upper(at(i - 1)), F.lit(" "), F.regexp_replace(w, r"[.?]$", "")).alias("ref"))))

    return F.transform(words, here)


def references(files: DataFrame) -> DataFrame:
    """``files``: path, content. path, kind (class, method, path, route), ref: what the content refers to. Names are
    found among tokens; paths and routes among words, where the target of a link begins with its bracket."""
    words = F.split(F.replace("content", F.lit("]("), F.lit(" ]")), r"""[\s"'`()<>,;\[]+""")
    named, paths = let(tokens(F.col("content")), _named), let(words, _pathlike)
    return files.select("path", F.explode(F.array_distinct(F.array_compact(F.concat(named, paths)))).alias("x")).select("path", "x.kind", "x.ref")
