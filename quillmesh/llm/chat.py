"""Chat formatting by quotation linking.

Messages that answer others often quote them. Each message is parsed into runs of lines at one quote
level (the number of leading `>`); quoted runs are hashed after normalising case and white space, as
a whole and line by line, and joined to the first message of the conversation that says the same in
its own words. The message that the quotes of the lowest level come from, by most characters, is the
parent. Following parents gives every message its thread and depth; the messages of a thread by turn
are the reply order, in which an answer always follows what it answers. Quotes, and the line that
introduces them, are left out of the formatted conversation.

Passages are parsed and hashed once, inside the row, and linked with equi-joins whose one side is
unique per (conversation, passage), so a very common passage or a conversation with a third of all
messages never makes pairs, and Spark can split its partition. Roots are found by doubling the distance
to the known ancestor in each round. A conversation is built in parts of PART turns, so no task gathers
one of any length; where a turn repeats so often that a part has twice as many messages, its turns are
parts of their own, in pieces of about PART messages.

Defined results: a null text is empty and a null role `user`; a quote that no earlier message
explains links nothing but is left out all the same; a message that repeats (conversation, turn) is
formatted each time and counts as one node; messages without links are threads of their own; rows
with a null conversation or turn link to nothing, each is a thread; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import let, written

#: A line of its own words that introduces a quote.
INTRODUCES = r"(?i)(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns of a thread in one formatted part.
PART = 256


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[\s\x{A0}]+", " "))


def lines(text: Column) -> Column:
    """The lines of a text with their quote level, without those that introduce a quote."""
    marks = lambda x: F.regexp_extract(x, r"^((?:[ \t]*>)*)", 1)
    every = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.struct(
        (F.length(marks(x)) - F.length(F.replace(marks(x), F.lit(">"), F.lit("")))).alias("level"), F.regexp_replace(x, r"^(?:[ \t]*>)+[ \t]?", "").alias("body")))

    def without_introductions(ls):
        n = F.size(ls)
        return F.filter(ls, lambda x, i: ~((x["level"] == 0) & x["body"].rlike(INTRODUCES) & (i + 1 < n) & (F.get(ls, i + 1)["level"] > 0)))

    return let(every, without_introductions)


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, hash, chars, whole: the distinct passages of each message, with ``whole`` false for
    the single lines of longer runs. Rows without a conversation or turn have none."""

    def runs(ls):
        blank = lambda x: F.btrim(x["body"]) == ""
        starts = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i == 0) | (F.get(ls, i)["level"] != F.get(ls, i - 1)["level"]) | (blank(F.get(ls, i)) != blank(F.get(ls, i - 1))))

        def cut(ss):
            return F.transform(ss, lambda s, k: F.struct(F.get(ls, s)["level"].alias("level"), F.slice(ls, s + 1, F.coalesce(F.get(ss, k + 1), F.size(ls)) - s).alias("lines")))

        return let(starts, cut)

    def found(rs):
        wholes = F.transform(rs, lambda r: F.struct(r["level"].alias("level"), normalised(F.array_join(F.transform(r["lines"], lambda x: x["body"]), " ")).alias("text"), F.lit(True).alias("whole")))
        singles = F.flatten(F.transform(F.filter(rs, lambda r: F.size(r["lines"]) > 1), lambda r: F.transform(r["lines"], lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("text"), F.lit(False).alias("whole")))))
        return F.filter(F.concat(wholes, singles), lambda p: p["text"] != "")

    rows = messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn", lines(F.col("text")).alias("lines"))
    rows = rows.select("conv_id", "turn", F.transform(let(F.filter("lines", lambda x: F.lit(True)), lambda ls: F.when(F.size(ls) > 0, let(let(ls, runs), found))), lambda p: F.struct(
        p["level"].alias("level"), F.unhex(F.md5(p["text"])).alias("hash"), F.length(p["text"]).alias("chars"), p["whole"].alias("whole"))).alias("passages"))
    return rows.select("conv_id", "turn", F.explode(F.array_distinct("passages")).alias("p")).select("conv_id", "turn", "p.*")


def links(p: DataFrame) -> DataFrame:
    """``p`` of ``passages``: conv_id, turn, parent_turn, quoted and linked (numbers of whole quoted passages),
    for messages that quote."""
    quotes = written(p.filter("level > 0"), "quotes")
    wanted = quotes.select("conv_id", "hash").distinct()
    # Written, so that the join of the quotes has two plain exchanges and Spark can split a common passage's partition.
    first = written(p.filter("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin")).join(wanted, ["conv_id", "hash"], "left_semi"), "origins")
    found = quotes.join(first, ["conv_id", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    by_origin = found.groupBy("conv_id", "turn", "origin").agg(F.min("level").alias("level"), F.sum("chars").alias("chars"), F.sum(F.col("whole").cast("int")).alias("n"))
    better = F.max(F.when(F.col("origin").isNotNull(), F.struct((-F.col("level")).alias("near"), "chars", "origin")))
    best = by_origin.groupBy("conv_id", "turn").agg(better.alias("best"), F.sum("n").alias("quoted"), F.sum(F.when(F.col("origin").isNotNull(), F.col("n")).otherwise(0)).alias("linked"))
    return written(best.select("conv_id", "turn", F.col("best.origin").alias("parent_turn"), "quoted", "linked"), "links", spent=[quotes, first])


def roots(parents: DataFrame) -> DataFrame:
    """``parents``: conv_id, turn, parent_turn (not null). Adds root_turn and depth."""
    now = written(parents.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")), "roots")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        step = now.join(up, ["conv_id", "root_turn"], "left")
        if step.filter("next is not null").isEmpty():
            return now
        now = written(step.select("conv_id", "turn", "parent_turn", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "roots", spent=[now])


def format_messages(messages: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, parent_turn, root_turn, depth, quoted, linked, content."""
    p = written(passages(messages), "passages")
    linked = links(p)
    placed = roots(linked.filter("parent_turn is not null"))
    known = written(linked.select("conv_id", "turn", "quoted", "linked").join(placed, ["conv_id", "turn"], "left"), "known", spent=[p, linked, placed])
    own = F.transform(F.filter(lines(F.col("text")), lambda x: x["level"] == 0), lambda x: x["body"])
    reply = F.btrim(F.regexp_replace(F.array_join(own, "\n"), r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))
    content = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("user")), F.lit("\n"), reply, F.lit(CLOSE + "\n"))
    out = messages.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), content.alias("content")).join(known, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
                      F.coalesce("quoted", F.lit(0)).cast("long").alias("quoted"), F.coalesce("linked", F.lit(0)).cast("long").alias("linked"), "content")


def crowded(formatted: DataFrame) -> DataFrame:
    """The turns of parts with over 2 * PART messages, and in how many pieces each is built: __c, __r, __t, pieces."""
    part = F.floor(F.col("turn") / PART).alias("part")
    turns = formatted.filter("conv_id is not null and turn is not null").groupBy("conv_id", "root_turn", "turn").agg(F.count("*").alias("n"))
    full = turns.groupBy("conv_id", "root_turn", part).agg(F.sum("n").alias("total")).filter(F.col("total") > 2 * PART).drop("total")
    return turns.withColumn("part", F.floor(F.col("turn") / PART)).join(full, ["conv_id", "root_turn", "part"]).select(
        F.col("conv_id").alias("__c"), F.col("root_turn").alias("__r"), F.col("turn").alias("__t"), F.ceil(F.col("n") / PART).alias("pieces"))


def conversations(formatted: DataFrame) -> DataFrame:
    """The reply-ordered conversations, in parts: conv_id, root_turn, part, at (the turn at which it begins, at
    least), piece, n_messages, turns, parents, depths, quoted, linked, content."""
    row = F.monotonically_increasing_id()
    lone = F.col("conv_id").isNull() | F.col("turn").isNull()
    rows = formatted.select("*", row.alias("__row"), F.floor(F.col("turn") / PART).alias("part"))
    pieces = written(crowded(formatted), "crowded")
    at, piece = F.col("part") * PART, F.lit(0).cast("long")
    if not pieces.isEmpty():
        rows = rows.join(pieces, (F.col("conv_id") == F.col("__c")) & (F.col("root_turn") == F.col("__r")) & (F.col("turn") == F.col("__t")), "left")
        at, piece = F.when(F.col("pieces").isNull(), at).otherwise(F.col("turn")), F.coalesce(F.pmod(F.col("__row"), F.col("pieces")), piece)
    rows = rows.select("*", at.alias("at"), piece.alias("piece"), F.when(lone, F.col("__row")).alias("__lone"))
    message = F.struct("turn", "content", "parent_turn", "depth", "quoted", "linked")
    parts = rows.groupBy("conv_id", "root_turn", "part", "at", "piece", "__lone").agg(F.array_sort(F.collect_list(message)).alias("m"))
    of = lambda name: F.transform("m", lambda x: x[name])
    total = lambda name: F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x[name])
    return parts.select("conv_id", "root_turn", "part", "at", "piece", F.size("m").alias("n_messages"), of("turn").alias("turns"), of("parent_turn").alias("parents"), of("depth").alias("depths"),
                        total("quoted").alias("quoted"), total("linked").alias("linked"), F.array_join(of("content"), "").alias("content"))


ORACLE = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, 'user') AS role, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM conversations
), a AS (
  SELECT id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM m
), b AS (
  SELECT id, i, length(regexp_extract(line, '^((?:[ \t]*>)*)', 1)) - length(replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), '>', '')) AS level,
         regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') AS body FROM a
), c AS (
  SELECT *, lead(level) OVER (PARTITION BY id ORDER BY i) AS below FROM b
), l AS (
  SELECT *, trim(body) = '' AS blank FROM c
  WHERE NOT (level = 0 AND coalesce(below, 0) > 0 AND regexp_matches(body, '(?i)(wrote|writes|said|schrieb|a écrit|escribió)[ \t\x0B\f\r]*:[ \t\x0B\f\r]*$'))
), n AS (
  SELECT *, CASE WHEN lag(level) OVER w IS DISTINCT FROM level OR lag(blank) OVER w IS DISTINCT FROM blank THEN 1 ELSE 0 END AS fresh FROM l WINDOW w AS (PARTITION BY id ORDER BY i)
), r AS (
  SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY i) AS run FROM n
), s AS (
  SELECT *, count(*) OVER (PARTITION BY id, run) AS size FROM r
), t AS (
  SELECT id, any_value(level) AS level, string_agg(body, ' ' ORDER BY i) AS text, true AS whole FROM s GROUP BY id, run
  UNION ALL SELECT id, level, body, false FROM s WHERE size > 1
), p AS (
  SELECT DISTINCT conv_id, turn, id, level, said, whole
  FROM (SELECT id, level, trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r\x{A0}]+', ' ', 'g')) AS said, whole FROM t) JOIN m USING (id)
  WHERE said <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL
), f AS (
  SELECT conv_id, said, min(turn) AS origin FROM p WHERE level = 0 GROUP BY ALL
), q AS (
  SELECT p.conv_id, p.turn, CASE WHEN f.origin < p.turn THEN f.origin END AS origin, min(level) AS level, sum(length(said)) AS chars, sum(whole::INT) AS n
  FROM p LEFT JOIN f USING (conv_id, said) WHERE level > 0 GROUP BY ALL
), k AS (
  SELECT conv_id, turn, sum(n) AS quoted, sum(n) FILTER (origin IS NOT NULL) AS linked, arg_max(origin, (-level, chars, origin)) FILTER (origin IS NOT NULL) AS parent_turn FROM q GROUP BY ALL
), u AS (
  SELECT conv_id, turn, parent_turn AS root_turn, 1 AS depth FROM k WHERE parent_turn IS NOT NULL
  UNION ALL SELECT u.conv_id, u.turn, k.parent_turn, u.depth + 1 FROM u JOIN k ON k.conv_id = u.conv_id AND k.turn = u.root_turn WHERE k.parent_turn IS NOT NULL
), top AS (
  SELECT conv_id, turn, min(root_turn) AS root_turn, max(depth) AS depth FROM u GROUP BY ALL
), own AS (
  SELECT id, trim(regexp_replace(string_agg(body, chr(10) ORDER BY i), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10)) AS reply FROM l WHERE level = 0 GROUP BY id
), x AS (
  SELECT m.conv_id, m.turn, k.parent_turn, coalesce(top.root_turn, m.turn) AS root_turn, coalesce(top.depth, 0) AS depth, coalesce(k.quoted, 0) AS quoted, coalesce(k.linked, 0) AS linked,
         '<|im_start|>' || role || chr(10) || coalesce(reply, '') || '<|im_end|>' || chr(10) AS content
  FROM m LEFT JOIN own USING (id) LEFT JOIN k ON k.conv_id = m.conv_id AND k.turn = m.turn LEFT JOIN top ON top.conv_id = m.conv_id AND top.turn = m.turn
)
SELECT conv_id, root_turn, turn // 256 AS part, count(*)::INT AS n_messages, list(turn ORDER BY turn, content) AS turns, list(parent_turn ORDER BY turn, content) AS parents,
       list(depth::INT ORDER BY turn, content) AS depths, sum(quoted)::BIGINT AS quoted, sum(linked)::BIGINT AS linked,
       sum(length(content))::INT AS n_chars, sha256(string_agg(content, '' ORDER BY turn, content)) AS content_sha256
FROM x GROUP BY conv_id, root_turn, part
"""


def op3_chat(spark, sf_dir: str) -> DataFrame:
    out = conversations(format_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return out.select("conv_id", "root_turn", "part", "n_messages", "turns", "parents", "depths", "quoted", "linked", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))
