r"""Column functions on identifiers, paths and text.

Word boundaries are spelled out as look-arounds over ASCII, because ``\b`` is Unicode-aware in Java.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Boundaries inside an identifier: lower to upper, and before the last capital of an acronym.
HUMPS = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"

# Language by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "php": "php", "py": "python", "rb": "ruby", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "swift": "swift",
    "cs": "csharp", "cpp": "cpp", "c": "c", "h": "c", "hpp": "cpp", "vue": "vue", "svelte": "svelte", "json": "json",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "html": "html", "css": "css", "scss": "scss", "sass": "sass",
    "less": "less", "md": "markdown", "sql": "sql", "sh": "shell", "bash": "shell", "zsh": "shell", "dockerfile": "dockerfile",
}
# Files that are text although their extension has no language.
TEXT_EXTENSIONS = ("txt", "log", "conf", "cfg", "ini")
TEXT_NAMES = ("readme", "license", "changelog", "makefile", "dockerfile", "vagrantfile", ".env.example", ".gitignore", ".dockerignore", ".editorconfig")
# Fence language by extension.
FENCES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "php": "php", "py": "python", "rb": "ruby", "go": "go",
          "rs": "rust", "java": "java", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown", "sql": "sql", "sh": "bash"}
# Words of two or three letters that count as raw words all the same.
SHORT_WORDS = ("ip", "id", "ui", "db", "api", "cdn", "sms", "otp", "ai", "ml", "io")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    """The directory, `.` for files in the root."""
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(path, r"/[^/]*$", ""))


def extension(path: Column) -> Column:
    """The last extension in lower case without its dot; empty for dotfiles and names without one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def stem_name(path: Column) -> Column:
    """The basename without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def language(path: Column) -> Column:
    return F.coalesce(F.element_at(_map(LANGUAGES), extension(path)), F.lit("unknown"))


def is_text_file(path: Column) -> Column:
    return extension(path).isin(*TEXT_EXTENSIONS) | F.lower(basename(path)).isin(*TEXT_NAMES)


def fence_language(path: Column) -> Column:
    return F.coalesce(F.element_at(_map(FENCES), extension(path)), F.lit(""))


def safe_filename(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\.]", "_")


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def display_path(path: Column) -> Column:
    """At most the last three parts."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), "/")


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), word.substr(F.lit(2), F.length(word)))


def snake_to_pascal(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "_"), _capital), "")


def snake_to_camel(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "_"), lambda w, i: F.when(i == 0, w).otherwise(_capital(w))), "")


def camel_to_snake(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(name, "([A-Z])", "_$1")), "^_", "")


def snake_plural(name: Column) -> Column:
    """Snake case and a simple English plural, as in table names."""
    s = camel_to_snake(name)
    return (F.when(s.endswith("y"), F.concat(F.regexp_replace(s, "y$", ""), F.lit("ies")))
            .when(s.rlike("(s|x|ch|sh)$"), F.concat(s, F.lit("es"))).otherwise(F.concat(s, F.lit("s"))))


def case_variants(name: Column) -> Column:
    """The name in every case style that it suggests, each once, the name itself first."""
    snake = F.contains(name, F.lit("_"))
    camel = name.rlike("[a-z][A-Z]|^[A-Z][a-z]")
    forms = F.array(name, F.lower(name), F.when(snake, snake_to_camel(name)), F.when(snake, snake_to_pascal(name)),
                    F.when(snake, F.replace(name, F.lit("_"), F.lit(""))), F.when(camel, camel_to_snake(name)))
    return F.array_distinct(F.filter(F.array_compact(forms), lambda x: x != ""))


def identifier_segments(name: Column, separators: str = r"[-_.]") -> Column:
    """Parts of an identifier in lower case, split at humps and separators; parts of one letter drop out."""
    return F.filter(F.transform(F.split(name, f"{HUMPS}|{separators}"), F.lower), lambda x: F.length(x) >= 2)


def path_segments(path: Column) -> Column:
    return identifier_segments(path, r"[-_./\\]")


def completion_segments(name: Column) -> Column:
    """Runs of letters and digits of a name without its extension, for acronyms."""
    return F.regexp_extract_all(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"), F.lit(0))


def acronym_pattern(query: str) -> str:
    """A regular expression over space-joined lower-case segments: the query is made of non-empty
    prefixes of successive segments from the first on."""
    q = "".join(c for c in query.lower() if c.isascii() and c.isalnum())
    return "^" + "(?:[a-z0-9]* )?".join(q) if q else "$^"


def matches_acronym(name: Column, query: str) -> Column:
    return F.array_join(F.transform(completion_segments(name), F.lower), " ").rlike(acronym_pattern(query))


def keyword_tokens(text: Column) -> Column:
    """Lower-case tokens of over two ASCII word characters and hyphens."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s-]", " "), r"\s+"), lambda x: F.length(x) > 2)


def raw_words(text: Column) -> Column:
    """The distinct words as typed: letters and digits of any script, three or more, or a known short one."""
    stripped = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.array_distinct(F.filter(stripped, lambda w: (F.length(w) >= 3) | w.isin(*SHORT_WORDS)))


@cache
def _accented() -> tuple[str, str]:
    """All characters that are one base character and marks, and their base characters."""
    bases = {}
    for c in map(chr, range(0x80, 0x110000)):
        base = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M")] if unicodedata.decomposition(c) else []
        if len(base) == 1 and base[0] != c:
            bases[c] = base[0]
    return "".join(bases), "".join(bases.values())


def without_accents(text: Column) -> Column:
    """A text without diacritics, composed or combining; ASCII texts are passed by."""
    accented, bases = _accented()
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text, accented, bases), r"\p{M}+", "")).otherwise(text)


def search_tokens(text: Column) -> Column:
    """Tokens of the search index: runs of letters and digits in lower case, without accents. Marks belong to the token
    that they are in, and only tokens that are not ASCII are mapped."""
    low = F.lower(text)
    tokens = lambda marks: F.regexp_extract_all(low, F.lit(rf"[\p{{L}}\p{{N}}{marks}]+"), F.lit(0))
    plain = F.filter(F.transform(tokens(r"\p{M}"), without_accents), lambda t: t != "")
    return F.when(low.rlike(r"[^\x00-\x7F]"), plain).otherwise(tokens(""))


def sanitize_query(query: Column) -> Column:
    """A search string without operators and special characters; empty if it is shorter than two."""
    s = F.regexp_replace(query, r"""['"():\-^~*]""", " ")
    s = F.btrim(F.regexp_replace(F.regexp_replace(s, f"(?i){START}(AND|OR|NOT|NEAR){END}", " "), r"\s+", " "))
    return F.when(F.length(s) < 2, F.lit("")).otherwise(s)


def slug(task: Column, at: Column) -> Column:
    """Timestamp and the cleaned task of at most 40 characters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(task), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.concat(F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), F.regexp_replace(F.substring(s, 1, 40), "-$", ""))


def slug_parts(s: Column) -> Column:
    """date, time and task of a slug; null for other names."""
    p = r"^(\d{4})(\d{2})(\d{2})-(\d{2})(\d{2})(\d{2})-(.+)$"
    g = lambda i: F.regexp_extract(s, p, i)
    return F.when(s.rlike(p), F.struct(F.concat_ws("-", g(1), g(2), g(3)).alias("date"), F.concat_ws(":", g(4), g(5), g(6)).alias("time"), g(7).alias("task")))


def pretty_bytes(n: Column) -> Column:
    one = lambda x: F.format_string("%.1f", F.round(x.cast("decimal(24,6)"), 1).cast("double"))
    return (F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(one(n / 1024), F.lit(" KB")))
            .otherwise(F.concat(one(n / (1024 * 1024)), F.lit(" MB"))))


def signature(line: Column, most: int = 200) -> Column:
    s = F.btrim(line, F.lit(" \t\r\n"))
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)


def namespace_path(specifier: Column, lang: Column) -> Column:
    """Path of a namespaced import."""
    php = F.regexp_replace(F.replace(specifier, F.lit("\\"), F.lit("/")), "^App/", "app/")
    return F.when(lang == "php", php).when(lang.isin("python", "java"), F.replace(specifier, F.lit("."), F.lit("/"))).otherwise(specifier)


def similar_path(file: Column, specifier: Column) -> Column:
    """Whether at least half of the specifier's parts (of over two letters) occur in the file's parts."""
    parts = lambda c, sep: F.filter(F.split(F.lower(c), sep), lambda p: F.length(p) > 2)
    own, wanted = parts(file, r"[/\\]"), parts(specifier, r"[/.\\:]")
    hit = lambda w: F.exists(own, lambda p: F.contains(p, w) | F.contains(w, F.regexp_replace(p, r"\.[^.]+$", "")))
    return F.size(F.filter(wanted, hit)) * 2 >= F.size(wanted)
