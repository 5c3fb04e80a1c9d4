"""Conversations without quotes, by quotation linking.

A line's quote level is the number of ``>`` signs before its text (blanks between them do not count).  Runs of lines of one
level form passages; the passages of level 0 are the message's body, all others are quotes.  A passage is looked for as a whole, by
its paragraphs (parted by lines without letters or digits) and by its lines.  Each of these is normalised (letters lowered, all but
letters and digits dropped, so that another wrapping of the lines does not matter) and hashed, and joined to the hashes of
the bodies of earlier messages of the same conversation, as a whole, by their passages, paragraphs and lines.

Each whole, paragraph and line votes for the latest earlier message that has it, with its length after normalisation; wholes,
paragraphs and lines are summed apart and the largest sum counts.  The message of the most votes, the latest of equals, is the
passage's original; the original of the first passage of the least level is the message's parent.

A thread begins with a message without a parent, or whose parent is unknown, and holds all that answer it, found as connected
components.  Messages are ordered by the first turn of their thread and then by turn, so that answers follow what they answer.
format_chats() gives the order as columns; conversations() gives the ordered messages, long threads in several rows.

A line that all messages of a conversation quote has one vote for each of them: the messages of one hash are ordered in ranges
of ``RANGE`` turns, with the last message that has it in earlier ranges, so no two messages are ever paired but by a vote.

Defined cases: a null text is an empty message; a null role is "user"; null conversation or turn is a value like any other, but
such messages are linked with nothing; of repeated (conversation, turn) rows each is formatted, and they share their links;
quotes without letters or digits, or that occur in no earlier body, link nothing and are dropped from the body all the
same, as are quotes of a part of a line; very long messages are read whole; an empty table gives an empty result; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.llm.common import staged
from sedgewren.llm.graph import components

_QUOTE = r"^[ \t]*(>[> \t]*)"
#: Turns that are ordered in one piece, and messages in a row of conversations().
RANGE, PART = 1000, 1000
WHOLE, PARAGRAPH, LINE = 0, 1, 2


def _lines(text: Column) -> Column:
    """(place, level, line without its quote signs) of each line."""
    marks = lambda x: F.regexp_extract(x, _QUOTE, 1)
    return F.transform(F.split(text, "\r?\n"), lambda x, i: F.struct(i.alias("place"), F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.regexp_replace(x, _QUOTE, "").alias("line")))


def _plain(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]", "")


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines: messages with their lines by quote level."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return messages.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), _lines(text).alias("lines"))


def _units(lines: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage, kind, digest, size: what the passages of messages are looked for by."""
    # one line a row; a line's passage and paragraph are named by the places where they begin
    own = Window.partitionBy("conv_id", "turn", "copy").orderBy("place")
    rows = lines.withColumn("copy", F.monotonically_increasing_id()).select("conv_id", "turn", "copy", F.explode("lines").alias("x")).select("conv_id", "turn", "copy", "x.place", "x.level", _plain(F.col("x.line")).alias("plain"))
    new = F.coalesce(F.lag("level").over(own) != F.col("level"), F.lit(True))
    rows = rows.withColumn("passage", F.last(F.when(new, F.col("place")), ignorenulls=True).over(own))
    rows = rows.withColumn("paragraph", F.coalesce(F.last(F.when(F.col("plain") == "", F.col("place")), ignorenulls=True).over(own), F.lit(-1))).where("plain <> ''")
    by = ["conv_id", "turn", "copy", "level", "passage"]
    whole = lambda *more: rows.groupBy(*by, *more).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "plain"))), lambda x: x["plain"]), "").alias("plain"))
    kinds = [(WHOLE, whole()), (PARAGRAPH, whole("paragraph")), (LINE, rows)]
    # a body as a whole, across the quotes in it
    body = rows.where("level = 0").groupBy("conv_id", "turn", "copy").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "plain"))), lambda x: x["plain"]), "").alias("plain"))
    parts = [x.select("conv_id", "turn", "level", "passage", F.lit(k).alias("kind"), "plain") for k, x in kinds]
    parts.append(body.select("conv_id", "turn", F.lit(0).alias("level"), F.lit(0).alias("passage"), F.lit(WHOLE).alias("kind"), "plain"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("conv_id", "turn", "level", "passage", "kind", F.md5("plain").alias("digest"), F.length("plain").alias("size")).distinct()


def originals(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, level, original): the message that each quoted passage comes from, where one is found."""
    lines = parsed(messages.where("conv_id is not null and turn is not null"))
    quoting = lines.where(F.exists("lines", lambda x: x["level"] > 0))
    quoted = staged(_units(quoting).where("level > 0"), "quotes")
    # only conversations with quotes are read further, and of their bodies only what is quoted somewhere
    asked = quoted.select("conv_id", "digest").distinct()
    bodies = _units(lines.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")).where("level = 0").select("conv_id", "turn", "digest").distinct()
    bodies = bodies.join(asked, ["conv_id", "digest"], "left_semi")
    events = bodies.select("conv_id", "digest", "turn", F.col("turn").alias("body")).unionByName(quoted.select("conv_id", "digest", "turn").distinct().withColumn("body", F.lit(None).cast(bodies.schema["turn"].dataType)))
    events = staged(events.withColumn("range", F.floor(F.col("turn") / RANGE)), "events")
    by = ["conv_id", "digest"]
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    last = events.groupBy(*by, "range").agg(F.max("body").alias("body")).select(*by, "range", F.max("body").over(earlier).alias("before"))
    inside = Window.partitionBy(*by, "range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = events.select(*by, "range", "turn", "body", F.max("body").over(inside).alias("near")).where("body is null").join(last, [*by, "range"])
    found = found.select(*by, "turn", F.coalesce("near", "before").alias("original")).where("original is not null")
    votes = quoted.join(found, [*by, "turn"]).groupBy("conv_id", "turn", "passage", "level", "original", "kind").agg(F.sum("size").alias("votes"))
    votes = votes.groupBy("conv_id", "turn", "passage", "level", "original").agg(F.max("votes").alias("votes"))
    return votes.groupBy("conv_id", "turn", "passage", "level").agg(F.max(F.struct("votes", "original")).alias("m")).select("conv_id", "turn", "passage", "level", F.col("m.original").alias("original"))


def format_chats(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, formatted, n_quoted, n_linked, parent_turn, thread_turn: one row for each message.

    Ordered by (conv_id, thread_turn, turn), the formatted texts are the conversations.
    """
    found = staged(originals(messages), "originals")
    node = lambda turn: F.struct("conv_id", F.col(turn).alias("turn"))
    parents = found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "passage", "original")).alias("m"), F.count("*").alias("n_linked")).select("conv_id", "turn", "n_linked", F.col("m.original").alias("parent_turn"))
    parents = staged(parents, "parents")
    threads = components(parents.select(node("turn").alias("a"), node("parent_turn").alias("b")))
    threads = staged(threads.select(F.col("node.conv_id").alias("conv_id"), F.col("node.turn").alias("turn"), F.col("label.turn").alias("thread_turn")), "threads")
    lines = F.col("lines")
    kept = F.filter(lines, lambda x: x["level"] == 0)
    body = F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    # a passage begins where the level is above 0 and differs from the line before
    passages = F.size(F.filter(lines, lambda x: (x["level"] > 0) & ((x["place"] == 0) | (F.get(lines, x["place"] - 1)["level"] != x["level"]))))
    rows = parsed(messages).select("conv_id", "turn", "role", body.alias("body"), passages.cast("long").alias("n_quoted"))
    out = rows.join(parents, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
    formatted = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"), F.lit("\n"))
    return out.select("conv_id", "turn", "role", "body", formatted.alias("formatted"), "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, thread_turn, part, messages: the threads as ordered lists of (turn, parent_turn, role, body).

    A thread of more than ``PART`` messages takes several rows, so no row grows with the thread.
    """
    rows = format_chats(messages)
    place = F.row_number().over(Window.partitionBy("conv_id", "thread_turn").orderBy("turn", "role", "body")) - 1
    rows = rows.withColumn("place", place).withColumn("part", F.floor(F.col("place") / PART))
    listed = F.sort_array(F.collect_list(F.struct("place", "turn", "parent_turn", "role", "body")))
    return rows.groupBy("conv_id", "thread_turn", "part").agg(F.transform(listed, lambda x: F.struct(x["turn"].alias("turn"), x["parent_turn"].alias("parent_turn"), x["role"].alias("role"), x["body"].alias("body"))).alias("messages"))
