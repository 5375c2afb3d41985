"""Quotation linking in conversations, with DataFrame operations only.

A line's quote level is the number of ``>`` marks it starts with. Neighbouring
lines of one level make a passage (a blank line ends it); passages are
normalised (lower case, white space as one space) and hashed. A quoted passage
is linked to the latest earlier message of its conversation that wrote the
same passage, or a line that is the passage, itself. A passage of several lines
that nothing earlier equals (a trimmed quote, or paragraphs quoted without the blank line between) is
linked by its lines: to the message that the latest earlier writers of its lines name
for more than half of its words. The message that most of a message's
directly quoted words lead to is the one it replies to. Threads
follow the replies to their first message; a conversation is ordered by
thread and within it along the replies: a message, then each reply to it with all that follows
from it, by turn. Its messages are given without quotes and without the line that announces one.

Messages are never gathered by conversation: the latest earlier writer is found in
two steps, within blocks of ``BLOCK`` turns and over the blocks, so that one
conversation may hold any share of the rows.

Defined cases: a null or empty text has no passages and stays as it is; a null
conversation or turn is never linked and is a thread of its own, at position 0; of repeated
rows each is kept and linked alike, at one position; a passage that quotes nothing earlier has
no link; ties between messages replied to go to the latest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, drop

BLOCK = 1024
MARKS = r"^\s*((?:>\s?)+)"
#: A line that announces a quote, directly before one.
ANNOUNCES = r"(?i)\b(wrote|writes|said|schrieb|escribi\x{F3}|a \x{E9}crit)\s*:\s*$"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " ")))


def lines(text: Column) -> Column:
    """``array<struct<level,body,blank>>`` of the lines of a text."""
    def line(raw: Column) -> Column:
        marks = F.regexp_extract(raw, MARKS, 1)
        body = F.regexp_replace(raw, MARKS, "")
        return F.struct((F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).alias("level"),
                        body.alias("body"), (F.trim(F.regexp_replace(body, r"\s+", " ")) == "").alias("blank"))
    return F.transform(F.split(text, "\r?\n", -1), line)


def quoted_passages(messages: DataFrame) -> DataFrame:
    """``(conv, turn, at, level, body, lines)`` of the quoted passages of messages
    ``(conv, turn, text)``: runs of lines of one level, ``at`` numbering the
    runs of a message and ``lines`` holding the run's normalised lines. Lines are numbered within their own message only."""
    rows = messages.where(F.col("text").contains(">")).withColumn("row", F.monotonically_increasing_id())
    split = rows.select("row", "conv", "turn", F.posexplode(lines(F.col("text"))).alias("pos", "line")).select(
        "row", "conv", "turn", "pos", "line.*")
    by = Window.partitionBy("row").orderBy("pos")
    new = F.lag("level").over(by).isNull() | (F.lag("level").over(by) != F.col("level")) | F.col("blank") | F.lag("blank").over(by)
    runs = split.withColumn("new", new.cast("int")).withColumn("at", F.sum("new").over(by)).where("level > 0 and not blank")
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"])
    return (runs.groupBy("row", "conv", "turn", "at", "level").agg(
                normalised(F.array_join(bodies, " ")).alias("body"), F.filter(F.transform(bodies, normalised), lambda x: x != "").alias("lines"))
            .where((F.col("body") != "") & ~F.col("body").rlike(ANNOUNCES)).drop("row"))


def written_passages(messages: DataFrame) -> DataFrame:
    """``(conv, turn, body)`` of what messages wrote themselves: runs of lines
    that are neither quoted nor blank, and each such line."""
    own = F.regexp_replace("text", r"(?m)^[^\S\n]*>.*$", "")
    body = F.explode(F.concat(F.split(own, r"\n\s*\n", -1), F.split(own, "\n", -1)))
    return (messages.select("conv", "turn", body.alias("body")).select("conv", "turn", normalised(F.col("body")).alias("body"))
            .where((F.col("body") != "") & ~F.col("body").rlike(ANNOUNCES)))


def without_quotes(text: Column) -> Column:
    """The lines of level 0, without one that announces a quote."""
    own = lines(text)
    next_level = F.slice(F.transform(own, lambda x: x["level"]), 2, F.size(own))
    both = F.arrays_zip(own.alias("line"), F.concat(next_level, F.array(F.lit(0))).alias("next"))
    kept = F.filter(both, lambda x: (x["line"]["level"] == 0) & ~((x["next"] > 0) & x["line"]["body"].rlike(ANNOUNCES)))
    return F.when(text.contains(">"), F.trim(F.array_join(F.transform(kept, lambda x: x["line"]["body"]), "\n"))).otherwise(text)


def _latest_writer(quoted: DataFrame, written: DataFrame) -> DataFrame:
    """``quoted`` (conv, turn, hash) with ``source``: the last earlier turn in
    ``written`` (conv, turn, hash); rows without one are left out. Linear in both."""
    keys = ["conv", "hash"]
    asked = written.join(quoted.select(*keys).distinct(), keys, "left_semi")
    block = F.floor(F.col("turn") / BLOCK)
    events = (asked.select(*keys, "turn", F.col("turn").alias("wrote")).distinct()
              .unionByName(quoted.select(*keys, "turn", F.lit(None).cast("bigint").alias("wrote")).distinct()).withColumn("block", block))
    within = Window.partitionBy(*keys, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.max("wrote").over(within)).where("wrote is null")
    over = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy(*keys, "block").agg(F.max("wrote").alias("last")).withColumn("carried", F.max("last").over(over))
    found = near.join(carried.select(*keys, "block", "carried"), [*keys, "block"])
    return found.select(*keys, "turn", F.coalesce("near", "carried").alias("source")).where("source is not null")


def _by_lines(passages: DataFrame, written: DataFrame) -> DataFrame:
    """``passages`` of two lines or more with ``source``, the message that most of their
    words lead to line by line (the latest of equals), if that is more than half of the words."""
    keys = ["conv", "turn", "at", "level", "body", "hash"]
    split = passages.where(F.size("lines") > 1).select(*keys, F.explode("lines").alias("line")).withColumnRenamed("hash", "whole")
    split = cut(split.withColumn("hash", F.sha2("line", 256)))
    keys[-1] = "whole"
    words = lambda text: F.size(F.split(text, " "))
    named = split.join(_latest_writer(split.select("conv", "turn", "hash"), written), ["conv", "turn", "hash"])
    best = (named.groupBy(*keys, "source").agg(F.sum(words("line")).alias("words"))
            .groupBy(*keys).agg(F.max(F.struct("words", "source")).alias("best")))
    return best.where(2 * F.col("best.words") > words("body")).select(
        *keys[:-1], F.col("whole").alias("hash"), F.col("best.source").alias("source"))


def _walked(replies: DataFrame) -> DataFrame:
    """``(conv, turn, thread, position)`` of the messages in ``replies`` (conv, turn,
    source): the first message that the replies lead back to, and the number of the thread's messages
    before this one, where a message comes before its replies and these come by turn.

    A walk through a thread goes into a message, through its replies, and out of it. Its steps are a list,
    each with the step before it, and are ranked by pointer jumping: no two steps of a round look up the same step,
    and no path is held, whatever the depth of a thread or the number of replies to a message."""
    kids = replies.withColumn("block", F.floor(F.col("turn") / BLOCK))
    near = F.lag("turn").over(Window.partitionBy("conv", "source", "block").orderBy("turn"))
    over = Window.partitionBy("conv", "source").orderBy("block")
    blocks = kids.groupBy("conv", "source", "block").agg(F.max("turn").alias("last")).withColumn("carried", F.lag("last").over(over))
    before = kids.withColumn("near", near).join(blocks, ["conv", "source", "block"]).select(
        "conv", "turn", "source", F.coalesce("near", "carried").alias("sibling"))
    last = replies.groupBy("conv", "source").agg(F.max("turn").alias("last")).withColumnRenamed("source", "turn")
    tree = cut(before.join(last, ["conv", "turn"], "full"))
    step = lambda out, to, to_out: tree.select("conv", "turn", F.lit(out).alias("out"), to.alias("to"), to_out.alias("to_out"))
    steps = step(False, F.coalesce("sibling", "source"), F.col("sibling").isNotNull()).unionByName(
        step(True, F.coalesce("last", "turn"), F.col("last").isNotNull()))
    # a step into a message counts for those behind it; a thread's first step has none before it
    steps = cut(steps.select("*", F.when(F.col("to").isNotNull() & ~F.col("to_out"), 1).otherwise(0).cast("bigint").alias("position"),
                             F.when(F.col("to").isNull(), F.col("turn")).alias("thread")))
    drop(tree)
    while not steps.where("to is not null").isEmpty():
        ahead = steps.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("out").alias("o"), F.col("to").alias("further"),
                             F.col("to_out").alias("further_out"), F.col("position").alias("more"), F.col("thread").alias("first"))
        jumped = steps.where("to is not null").join(ahead, (F.col("conv") == F.col("c")) & (F.col("to") == F.col("t")) & (F.col("to_out") == F.col("o"))).select(
            "conv", "turn", "out", F.col("further").alias("to"), F.col("further_out").alias("to_out"),
            (F.col("position") + F.col("more")).alias("position"), F.col("first").alias("thread"))
        moved = cut(jumped.unionByName(steps.where("to is null")))
        drop(steps)
        steps = moved
    return steps.where("not out").select("conv", "turn", "thread", "position")


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` with ``n_quoted`` (quoted passages), ``n_linked`` (those
    found in an earlier message), ``reply_to`` (turn replied to, else null),
    ``thread`` (turn of the thread's first message), ``position`` (its place in the thread, from 0)
    and ``clean_text``, ordered by conversation, thread and position; columns of these names are replaced."""
    base = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(text).alias("text")).where(
        "conv is not null and turn is not null and text <> ''")
    once = quoted_passages(base).groupBy("conv", "turn", "at", "level", "body").agg(F.max("lines").alias("lines"))
    quoted = cut(once.withColumn("hash", F.sha2("body", 256)))
    asked = base.join(quoted.select("conv").distinct(), "conv", "left_semi")
    written = written_passages(asked).select("conv", "turn", F.sha2("body", 256).alias("hash"))
    found = cut(quoted.join(_latest_writer(quoted.select("conv", "turn", "hash"), written), ["conv", "turn", "hash"], "left"))
    linked = cut(found.where("source is not null").drop("lines").unionByName(_by_lines(found.where("source is null"), written)))
    # a message's own quotes are its lowest level; deeper ones were quoted by others
    votes = (linked.groupBy("conv", "turn", "level", "source").agg(F.sum(F.size(F.split("body", " "))).alias("words"))
             .groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "words", "source")).alias("best")))
    replies = cut(votes.select("conv", "turn", F.col("best.source").alias("source")))
    counts = (quoted.groupBy("conv", "turn").agg(F.count("*").alias("n_quoted"))
              .join(linked.groupBy("conv", "turn").agg(F.count("*").alias("n_linked")), ["conv", "turn"], "left"))
    facts = counts.join(replies, ["conv", "turn"], "left").join(_walked(replies), ["conv", "turn"], "left").select(
        F.col("conv").alias("__conv"), F.col("turn").alias("__turn"), F.col("n_quoted").alias("__quoted"),
        F.col("n_linked").alias("__linked"), F.col("source").alias("__source"), F.col("thread").alias("__thread"), F.col("position").alias("__position"))
    facts = cut(facts)  # its size is known then, and a small one spares the messages a shuffle
    out = messages.join(facts, (messages[conv] == facts["__conv"]) & (messages[turn] == facts["__turn"]), "left")
    done = out.withColumns({
        "n_quoted": F.coalesce("__quoted", F.lit(0)), "n_linked": F.coalesce("__linked", F.lit(0)), "reply_to": F.col("__source"),
        "thread": F.coalesce("__thread", F.col(turn).cast("bigint")), "position": F.coalesce("__position", F.lit(0).cast("bigint")), "clean_text": without_quotes(F.col(text)),
    }).drop("__conv", "__turn", "__quoted", "__linked", "__source", "__thread", "__position")
    return done.orderBy(conv, "thread", "position", turn)


def oracle_sql() -> str:
    """The same over ``conversations`` in DuckDB."""
    white = "[ \\t\\n\\x0B\\f\\r\\x{A0}]+"
    clean = lambda text: f"lower(trim(regexp_replace({text}, '{white}', ' ', 'g')))"
    parts = "regexp_split_to_array(text, '\r?\n')"
    return f"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, text FROM conversations),
l AS (SELECT r, conv_id AS conv, turn, unnest({parts}) AS raw, unnest(range(len({parts}))) AS pos FROM m),
p AS (SELECT r, conv, turn, pos, len(marks) - len(replace(marks, '>', '')) AS level, regexp_replace(raw, '{MARKS}', '') AS body
      FROM (SELECT *, regexp_extract(raw, '{MARKS}', 1) AS marks FROM l)),
b AS (SELECT *, {clean('body')} = '' AS blank FROM p),
n AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY pos) AS part FROM (SELECT *, CASE WHEN lag(level) OVER o IS NULL OR lag(level) OVER o <> level
        OR blank OR lag(blank) OVER o THEN 1 ELSE 0 END AS new FROM b WINDOW o AS (PARTITION BY r ORDER BY pos))),
g AS (SELECT r, conv, turn, part, level, {clean("string_agg(body, ' ' ORDER BY pos)")} AS body, list({clean('body')} ORDER BY pos) AS lines FROM n
      WHERE NOT blank AND conv IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
quoted AS (SELECT conv, turn, part, level, body, max(lines) AS lines FROM g WHERE level > 0 AND NOT regexp_matches(body, '{ANNOUNCES}') GROUP BY ALL),
written AS (SELECT conv, turn, body FROM g WHERE level = 0 UNION SELECT conv, turn, {clean('body')} FROM b WHERE level = 0 AND NOT blank),
whole AS (SELECT q.conv, q.turn, q.part, q.level, q.body, max(w.turn) AS source FROM quoted q JOIN written w
          ON q.conv = w.conv AND q.body = w.body AND w.turn < q.turn AND NOT regexp_matches(w.body, '{ANNOUNCES}') GROUP BY ALL),
split AS (SELECT *, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM quoted ANTI JOIN whole USING (conv, turn, part, level, body) WHERE len(lines) > 1),
named AS (SELECT s.conv, s.turn, s.part, s.level, s.body, s.pos, s.line, max(w.turn) AS source FROM split s JOIN written w
          ON s.conv = w.conv AND s.line = w.body AND w.turn < s.turn AND NOT regexp_matches(w.body, '{ANNOUNCES}') GROUP BY ALL),
sums AS (SELECT conv, turn, part, level, body, source, sum(len(string_split(line, ' '))) AS words FROM named GROUP BY ALL),
linked AS (FROM whole UNION ALL SELECT conv, turn, part, level, body, source FROM sums
  QUALIFY row_number() OVER (PARTITION BY conv, turn, part, level, body ORDER BY words DESC, source DESC) = 1 AND 2 * words > len(string_split(body, ' '))),
votes AS (SELECT conv, turn, level, source, sum(len(string_split(body, ' '))) AS words FROM linked GROUP BY ALL),
replies AS (SELECT conv, turn, source FROM (SELECT *, row_number() OVER (PARTITION BY conv, turn ORDER BY level, words DESC, source DESC) AS k FROM votes) WHERE k = 1),
walk(conv, turn, path) AS (SELECT DISTINCT conv, source, [source] FROM replies s WHERE NOT EXISTS (FROM replies r WHERE r.conv = s.conv AND r.turn = s.source)
  UNION ALL SELECT r.conv, r.turn, list_append(walk.path, r.turn) FROM walk JOIN replies r ON r.conv = walk.conv AND r.source = walk.turn),
heads AS (SELECT conv, turn, path[1] AS thread, row_number() OVER (PARTITION BY conv, path[1] ORDER BY path) - 1 AS position FROM walk),
cq AS (SELECT conv, turn, count(*) AS n FROM quoted GROUP BY ALL), cl AS (SELECT conv, turn, count(*) AS n FROM linked GROUP BY ALL),
kept AS (SELECT r, trim(string_agg(body, chr(10) ORDER BY pos)) AS clean FROM (SELECT *, coalesce(lead(level) OVER (PARTITION BY r ORDER BY pos), 0) AS below FROM b)
         WHERE level = 0 AND NOT (below > 0 AND regexp_matches(body, '{ANNOUNCES}')) GROUP BY r)
SELECT m.conv_id, m.turn, m.role, coalesce(cq.n, 0)::BIGINT AS n_quoted, coalesce(cl.n, 0)::BIGINT AS n_linked, replies.source AS reply_to,
  coalesce(heads.thread, m.turn) AS thread, coalesce(heads.position, 0)::BIGINT AS position, CASE WHEN contains(text, '>') THEN coalesce(kept.clean, '') ELSE text END AS clean_text
FROM m LEFT JOIN cq ON m.conv_id = cq.conv AND m.turn = cq.turn LEFT JOIN cl ON m.conv_id = cl.conv AND m.turn = cl.turn
LEFT JOIN replies ON m.conv_id = replies.conv AND m.turn = replies.turn LEFT JOIN heads ON m.conv_id = heads.conv AND m.turn = heads.turn
LEFT JOIN kept USING (r)"""
