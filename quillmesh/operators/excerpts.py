"""Excerpts: which lines of a selected file to show, and how.

A long file's lines are chosen as intervals, in the row of the file: what is wanted gives intervals with a priority,
their ends cut the file into segments of one priority each, and a fold over the segments in order of priority spends
the budget of lines. Lines become rows only where a caller asks for rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL, MOST, AROUND, HEADER_LINES, HEADER_LEAST = 200, 300, 20, 50, 10
# First words of a header's lines, and of what ends it.
HEADER_WORDS = ("import", "from", "require", "use", "namespace", "package")
DEFINING_WORDS = ("class", "interface", "function", "const", "export")
KIND_ORDER = ("class", "interface", "function", "method", "constant", "variable")
GAP = "// ... (lines omitted)\n"


def header_end(lines: Column) -> Column:
    """The last header line within the first HEADER_LINES, at least HEADER_LEAST: imports, comments and
    blank lines count, the first definition ends it."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(False).alias("comment"), F.lit(False).alias("done"))

    def step(acc, line):
        body = F.btrim(line, F.lit(" \t\r"))
        inside = F.when(F.contains(body, F.lit("*/")), False).when(F.contains(body, F.lit("/*")), True).otherwise(acc["comment"])
        word, begins = F.regexp_extract(body, r"^\w+", 0), lambda *marks: F.substring(body, 1, 1).isin(*marks)
        is_header = word.isin(*HEADER_WORDS) | (body == "") | begins("#", "*") | body.startswith("//") | body.startswith("<?php") | inside
        done = acc["done"] | (~is_header & word.isin(*DEFINING_WORDS))
        at = acc["at"] + 1
        return F.struct(at.alias("at"), F.when(~done & is_header, at).otherwise(acc["end"]).alias("end"), inside.alias("comment"), done.alias("done"))

    return F.aggregate(F.slice(lines, 1, HEADER_LINES), start, step, lambda acc: F.greatest(acc["end"], F.lit(HEADER_LEAST)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def segments(wanted: Column) -> Column:
    """``wanted``: an array of (p, a, b), lines a to b with priority p, one of which is the whole file. The file in
    segments (p, a, b), each with the first priority of the intervals around it, in order of priority and place."""
    def cut(w):
        ends = F.array_sort(F.array_distinct(F.concat(F.transform(w, lambda x: x["a"]), F.transform(w, lambda x: x["b"] + 1))))
        first = lambda at: F.array_min(F.transform(F.filter(w, lambda x: (x["a"] <= at) & (x["b"] >= at)), lambda x: x["p"]))
        return let(ends, lambda e: F.array_sort(F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda at, i: F.struct(first(at).alias("p"), at.alias("a"), (F.get(e, i + 1) - 1).alias("b")))))

    return let(wanted, cut)


def spent(parts: Column, most: int = MOST) -> Column:
    """The segments that ``most`` lines pay for, in order of place: those of priority 0 whatever they cost, then the others
    in order, the last of them in part."""
    start = F.struct(F.lit(most).alias("left"), F.array().cast("array<struct<a: int, b: int>>").alias("out"))

    def step(acc, s):
        size = s["b"] - s["a"] + 1
        take = F.when(s["p"]["p1"] == 0, size).otherwise(F.least(size, F.greatest(acc["left"], F.lit(0))))
        out = F.when(take > 0, F.concat(acc["out"], F.array(F.struct(s["a"].alias("a"), (s["a"] + take - 1).alias("b"))))).otherwise(acc["out"])
        return F.struct((acc["left"] - size).alias("left"), out.alias("out"))

    return F.array_sort(F.aggregate(parts, start, step, lambda acc: acc["out"]))


def chosen(files: DataFrame, symbols: DataFrame, highlights: DataFrame) -> DataFrame:
    """``files``: path, content, in_trace, has_symbol; ``symbols``: path, name, kind, start_line, end_line; ``highlights``:
    path, line. path, ls (the lines) and kept, the intervals (a, b) of long files to show: the header and the
    surroundings of highlights, then up to MOST lines of symbols and from the top. Files meet their symbols and
    highlights, a row each."""
    ends = symbols.filter("end_line >= start_line").groupBy("path").agg(F.collect_list(F.struct("kind", "start_line", "end_line")).alias("symbols"))
    near = highlights.groupBy("path").agg(F.collect_set("line").alias("near"))
    f = files.select("path", "in_trace", "has_symbol", F.split("content", "\n").alias("ls")).filter(F.size("ls") > SMALL)
    f = f.join(ends, "path", "left").join(near, "path", "left")
    n = F.size("ls")
    span = lambda p1, p2, a, b: F.struct(F.struct(F.lit(p1).alias("p1"), p2.cast("long").alias("p2")).alias("p"), F.greatest(a, F.lit(1)).cast("int").alias("a"), F.least(b, n).cast("int").alias("b"))
    kind = lambda s: F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), s["kind"])
    none = F.array().cast("array<struct<p: struct<p1: int, p2: bigint>, a: int, b: int>>")
    zero, some = F.lit(0), lambda cond, spans: F.coalesce(F.when(cond, spans), none)
    wanted = F.concat(
        F.array(span(0, zero, F.lit(1), header_end(F.col("ls"))), span(3, zero, F.lit(1), n)),
        some(F.col("near").isNotNull(), F.transform("near", lambda x: span(0, zero, x - AROUND, x + AROUND))),
        some(F.col("in_trace"), F.transform("symbols", lambda s: span(1, s["start_line"], s["start_line"], s["end_line"]))),
        some(F.col("has_symbol"), F.transform("symbols", lambda s: span(2, kind(s) * 10_000_000 + s["start_line"], s["start_line"], s["end_line"]))))
    return f.select("path", "ls", spent(segments(F.filter(wanted, lambda x: x["a"] <= x["b"]))).alias("kept"))


def numbered(ls: Column, kept: Column) -> Column:
    """The lines (line, body) of the intervals ``kept``, in order."""
    one = lambda x: F.transform(F.slice(ls, x["a"], x["b"] - x["a"] + 1), lambda body, i: F.struct((x["a"] + i).alias("line"), body.alias("body")))
    return F.flatten(F.transform(kept, one))


def chosen_lines(files: DataFrame, symbols: DataFrame, highlights: DataFrame) -> DataFrame:
    """path, line, body of what ``chosen`` keeps."""
    return chosen(files, symbols, highlights).select("path", F.explode(numbered(F.col("ls"), F.col("kept"))).alias("x")).select("path", "x.line", "x.body")


def render(ls: Column, kept: Column) -> Column:
    """Numbered lines, with a mark wherever lines are left out between two intervals."""
    text = lambda x: F.array_join(F.transform(F.slice(ls, x["a"], x["b"] - x["a"] + 1), lambda body, i: F.concat((x["a"] + i).cast("string"), F.lit(": "), body)), "\n")
    gap = lambda x, i: F.when((i > 0) & (F.get(kept, i - 1)["b"] + 1 < x["a"]), GAP).otherwise("")
    return F.array_join(F.transform(kept, lambda x, i: F.concat(gap(x, i), text(x))), "\n")


def excerpts(files: DataFrame, symbols: DataFrame, highlights: DataFrame) -> DataFrame:
    """path, content, start_line, end_line, total_lines, truncated."""
    n = F.size(F.split("content", "\n"))
    small = files.filter(n <= SMALL).select("path", "content", F.lit(1).alias("start_line"), n.alias("end_line"), n.alias("total_lines"), F.lit(False).alias("truncated"))
    shown = F.aggregate("kept", F.lit(0), lambda a, x: a + x["b"] - x["a"] + 1)
    long_ = chosen(files, symbols, highlights).filter(F.size("kept") > 0)
    return small.unionByName(long_.select("path", render(F.col("ls"), F.col("kept")).alias("content"), F.col("kept")[0]["a"].alias("start_line"), F.element_at("kept", -1)["b"].alias("end_line"),
                                          F.size("ls").alias("total_lines"), (shown < F.size("ls")).alias("truncated")))


def symbol_text(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, name, content: the numbered lines of each symbol."""
    rows = files.select("path", F.split("content", "\n").alias("ls")).join(symbols, "path")
    numbered = F.transform(F.slice("ls", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), lambda x, i: F.concat((i + F.col("start_line")).cast("string"), F.lit(": "), x))
    return rows.select("path", "name", F.array_join(numbered, "\n").alias("content"))


def budget_tokens(contents: DataFrame) -> DataFrame:
    """budget_tokens: about a token per four characters."""
    return contents.agg(F.ceil(F.coalesce(F.sum(F.length("content")), F.lit(0)) / 4).cast("long").alias("budget_tokens"))
