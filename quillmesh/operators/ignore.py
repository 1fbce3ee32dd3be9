"""Ignore rules in the manner of gitignore files, as columns.

Rules become regular expressions over paths with `/`; of the rules that match a path, or a directory
above it, the last decides, and a negated one keeps the path. Built-in rules come last, so that no
user rule overrides them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules that always hold.
BUILT_IN = (".quillmesh/", ".idea/", ".vscode/", "*.swp", "*.swo", ".DS_Store", "Thumbs.db")


def to_regex(rule: str) -> str:
    """A rule's regular expression over a whole relative path, directories above included."""
    body = rule.rstrip("/").removeprefix("/")
    anchored = rule.startswith("/") or "/" in rule.rstrip("/").lstrip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body[i:i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif body[i:i + 2] == "**":
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 1:]:
            end = body.index("]", i + 1)
            out, i = out + "[" + body[i + 1:end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    # A rule for directories matches what is inside one, any other also the path itself.
    return ("^" if anchored else "(?:^|/)") + out + ("/." if rule.endswith("/") else "(?:/.|$)")


def parse(rules: str) -> list[tuple[str, bool]]:
    """(regular expression, negated) of each rule of a file."""
    found = []
    for line in rules.splitlines():
        line = line.rstrip()
        if line and not line.startswith("#"):
            found.append((to_regex(line.removeprefix("!").removeprefix("\\")), line.startswith("!")))
    return found


def is_ignored(path: Column, rules: str = "") -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    verdict = lambda rs: reduce(lambda acc, r: F.when(p.rlike(r[0]), F.lit(not r[1])).otherwise(acc), rs, F.lit(False))
    return verdict(parse("\n".join(BUILT_IN))) | verdict(parse(rules))


def keep(files: DataFrame, rules: str = "") -> DataFrame:
    return files.filter(~is_ignored(F.col("path"), rules))
