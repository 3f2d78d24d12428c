"""Quotation linking: conversations in reply order, without the text they quote.

A message is cut into lines and each line into its quote level (leading ``>`` marks) and content. Runs of lines of one
level are passages; a passage, its paragraphs and its lines are normalised and hashed, and the hashes of quoted units are joined
to units of the unquoted text (whole bodies, paragraphs, lines) of earlier messages of the conversation. The reply goes
to the message that the longest unit of its least deeply quoted passage came from, the latest one if several said the same;
a message without a linked quote replies to the one before it. Conversations are then walked in depth: each reply
follows the message it answers, with everything below it, before the next reply to the same message.

Only DataFrame functions are used. The latest earlier message with a unit is found by a scan over bounded chunks, so a
unit that a third of all messages share makes no pairs. The walk is a linked list of entering and leaving each message,
ranked by pointer doubling in a number of rounds that grows with the logarithm of the longest conversation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.ordered import last_value, next_value, position_chunk, with_running
from turnwise.llm.common import discard, materialize, prefix_sums

#: Marks at the head of a quoted line, each with up to three blanks before it and one behind.
MARKS = r"^(?:[ \t]{0,3}>)+ ?"
#: A line that only says who is quoted below it.
ATTRIBUTION = r"(?i)^\s*(?:on|am|le|el)\b.*\b(?:wrote|schrieb|crit|escribi\S*)[^\w]*:\s*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed_lines(text: Column) -> Column:
    """Array of (level, content, attribution) of the lines of a text; null has none."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")

    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        return F.struct(
            (F.length(marks) - F.length(F.replace(marks, F.lit(">")))).alias("level"),
            F.regexp_replace(line, MARKS, "").alias("content"),
            line.rlike(ATTRIBUTION).alias("attribution"),
        )

    parsed = F.transform(lines, parse)
    # An attribution counts as one only if a quoted line follows it, at once or after one empty line.
    level_at = lambda i: F.coalesce(F.try_element_at(parsed, i), F.struct(F.lit(0).alias("level"), F.lit("x").alias("content"), F.lit(False).alias("attribution")))

    def decide(x: Column, i: Column) -> Column:
        following, second = level_at(i + 2), level_at(i + 3)
        quoted = (following["level"] > x["level"]) | ((F.trim(following["content"]) == "") & (second["level"] > x["level"]))
        return F.struct(x["level"].alias("level"), x["content"].alias("content"), (x["attribution"] & quoted).alias("attribution"))

    return F.when(text.contains(">"), F.transform(parsed, decide)).otherwise(F.transform(lines, lambda x: F.struct(F.lit(0).alias("level"), x.alias("content"), F.lit(False).alias("attribution"))))


def _messages(conversations: DataFrame) -> DataFrame:
    """Distinct messages with pos, their place in the conversation: by turn (null last), then by role and text."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).distinct()
    order = [F.col("turn"), F.col("role"), F.col("text")]
    numbered = prefix_sums(rows, ["conv_id"], order, "messages", pos=F.lit(1))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    return materialize(numbered.select(conv.alias("conv"), "pos", "conv_id", "turn", "role", parsed_lines(F.col("text")).alias("lines")), "parsed")


def _body(lines: Column) -> Column:
    kept = F.filter(lines, lambda x: (x["level"] == 0) & ~x["attribution"])
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["content"]), "\n"), r"^\s+|\s+$", "")


def _units(text: Column) -> Column:
    """A text of several lines, its paragraphs and its lines."""
    return F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, r"\n"))


def quoted_units(messages: DataFrame) -> DataFrame:
    """(conv, pos, passage, level, unit, size) of quoted passages, of their paragraphs and of their lines."""
    lines = F.col("lines")
    quoting = messages.filter(F.exists("lines", lambda x: x["level"] > 0))
    # A passage begins where the level changes; it is cut out by its place, so a message is gone over once.
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)
    begins = F.filter(numbers, lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
    placed = quoting.select("conv", "pos", "lines", begins.alias("begins"))

    def passage(begin: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("begins"), k + 1), F.size(lines))
        said = F.transform(F.slice(lines, begin + 1, end - begin), lambda x: x["content"])
        return F.struct(F.get(lines, begin)["level"].alias("level"), F.array_join(said, "\n").alias("text"))

    each = placed.select("conv", "pos", F.posexplode(F.transform("begins", passage)).alias("passage", "p")).filter("p.level > 0")
    parts = F.array_distinct(F.transform(_units(F.col("p.text")), _normal))
    return each.select("conv", "pos", "passage", F.col("p.level").alias("level"), F.explode(parts).alias("t")).filter("t <> ''").select(
        "conv", "pos", "passage", "level", F.md5("t").alias("unit"), F.length("t").alias("size")
    )


def original_units(messages: DataFrame) -> DataFrame:
    """(conv, pos, unit) of unquoted text: the body, its paragraphs and its lines."""
    body = messages.select("conv", "pos", _body(F.col("lines")).alias("body"))
    return body.select("conv", "pos", F.explode(F.array_distinct(F.transform(_units(F.col("body")), _normal))).alias("t")).filter("t <> ''").select("conv", "pos", F.md5("t").alias("unit"))


def linked_quotes(messages: DataFrame) -> DataFrame:
    """(conv, pos, passage, level, parent): parent is the pos of the quoted message, null where none was found."""
    quoted = materialize(quoted_units(messages), "quoted")
    wanted = quoted.select("conv", "unit").distinct()
    known = original_units(messages).join(wanted, ["conv", "unit"], "left_semi").select("conv", "unit", "pos", F.lit(1).alias("side"), F.col("pos").alias("said"))
    asked = quoted.select("conv", "unit", "pos").distinct().select("*", F.lit(0).alias("side"), F.lit(None).cast("long").alias("said"))
    # At one message the question comes before its own text, so a message never quotes itself.
    found = with_running(known.unionByName(asked), ["conv", "unit"], ["pos", "side"], [position_chunk("pos")], origin=last_value(F.col("said"), inclusive=False))
    origins = found.filter("side = 0 AND origin IS NOT NULL").select("conv", "unit", "pos", "origin")
    joined = quoted.join(origins, ["conv", "unit", "pos"], "left")
    best = F.max_by("origin", F.when(F.col("origin").isNotNull(), F.struct("size", "origin")))
    return joined.groupBy("conv", "pos", "passage", "level").agg(best.alias("parent"))


def reply_order(parents: DataFrame) -> DataFrame:
    """(conv, pos, parent) to (conv, pos, position, depth): a walk in depth, replies to one message by pos.

    ``parent`` is null or a smaller pos of the same conversation; messages without parent follow one another.
    """
    edges = parents.select("conv", "pos", F.coalesce("parent", F.lit(-1)).alias("parent"))
    siblings = with_running(edges, ["conv", "parent"], ["pos"], [position_chunk("pos")], sibling=next_value(F.col("pos"), inclusive=False))
    children = edges.groupBy("conv", "parent").agg(F.min("pos").alias("child")).withColumnRenamed("parent", "pos")
    nodes = siblings.join(children, ["conv", "pos"], "left")
    # Entering a message leads to its first reply, or out of it; leaving leads to the next sibling, or out of the parent.
    enter = nodes.select("conv", F.col("pos").alias("at"), F.lit(0).alias("out"), F.coalesce("child", "pos").alias("next"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("next_out"), F.lit(1).alias("enters"), F.lit(1).alias("rise"))
    leave = nodes.select("conv", F.col("pos").alias("at"), F.lit(1).alias("out"), F.when(F.col("sibling").isNotNull(), F.col("sibling")).when(F.col("parent") >= 0, F.col("parent")).alias("next"), F.when(F.col("sibling").isNotNull(), 0).otherwise(1).alias("next_out"), F.lit(0).alias("enters"), F.lit(-1).alias("rise"))
    tour = enter.unionByName(leave).select("conv", "at", "out", "next", "next_out", F.col("enters").cast("long"), F.col("rise").cast("long"))
    # ``enters`` and ``rise`` add up a step and all it has skipped; steps that end the walk have no next.
    # A round is over the conversations that still have open steps: steps never lead from one conversation to another.
    finished, tour = [], materialize(tour, "tour")
    while True:
        unfinished = materialize(tour.filter("next IS NOT NULL").select("conv").distinct(), "unfinished")
        # Only where messages are entered is asked for in the end.
        finished.append(materialize(tour.filter("out = 0").join(unfinished, "conv", "left_anti").select("conv", "at", "enters", "rise"), "walked"))
        if unfinished.isEmpty():
            discard(tour, unfinished)
            break
        open_steps = tour.join(unfinished, "conv", "left_semi")
        ahead = open_steps.select("conv", F.col("at").alias("next"), F.col("out").alias("next_out"), F.col("next").alias("n"), F.col("next_out").alias("no"), F.col("enters").alias("e"), F.col("rise").alias("r"))
        doubled = open_steps.join(ahead, ["conv", "next", "next_out"], "left").select(
            "conv", "at", "out", F.col("n").alias("next"), F.when(F.col("n").isNotNull(), F.col("no")).alias("next_out"),
            (F.col("enters") + F.coalesce("e", F.lit(0))).alias("enters"), (F.col("rise") + F.coalesce("r", F.lit(0))).alias("rise"),
        )
        doubled = materialize(doubled, "tour")
        discard(tour, unfinished)
        tour = doubled
    walked = reduce(DataFrame.unionByName, finished)
    # ``enters`` now counts the messages from here to the end, and ``rise`` is minus the depth above.
    totals = parents.groupBy("conv").agg(F.count("*").alias("n"))
    entered = walked.select("conv", F.col("at").alias("pos"), "enters", (-F.col("rise")).alias("depth"))
    return entered.join(totals, "conv").select("conv", "pos", (F.col("n") - F.col("enters")).alias("position"), "depth")


def reply_conversations(conversations: DataFrame) -> DataFrame:
    """Per distinct message: conv_id, turn, role, position, depth, parent_turn, linked, n_passages, n_linked, body.

    ``position`` counts from 0 in reply order; ``depth`` is 0 for a message without parent, which only the first of a
    conversation is; ``linked`` tells whether the parent was found by a quote; ``n_passages`` quoted passages, of which
    ``n_linked`` were found; ``body`` is the text without quotes and attributions. Rows equal in conv_id, turn, role and
    text are one message; rows without conv_id are one conversation; a null turn comes last, a null text has an empty
    body and quotes nothing; quotes of unknown text are cut out like any other. Other columns are not read.
    """
    messages = _messages(conversations)
    quotes = materialize(linked_quotes(messages), "quotes")
    shallow = F.when(F.col("parent").isNotNull(), F.struct(-F.col("level"), -F.col("passage")))
    found = quotes.groupBy("conv", "pos").agg(F.max_by("parent", shallow).alias("quoted"), F.count("*").alias("n_passages"), F.count("parent").alias("n_linked"))
    before = F.when(F.col("pos") > 0, F.col("pos") - 1)
    parents = messages.select("conv", "pos", "turn").join(found, ["conv", "pos"], "left").select(
        "conv", "pos", F.coalesce("quoted", before).alias("parent"), F.col("quoted").isNotNull().alias("linked"),
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )
    parents = materialize(parents, "parents")
    placed = reply_order(parents)
    turns = messages.select("conv", F.col("pos").alias("parent"), F.col("turn").alias("parent_turn"))
    told = parents.join(placed, ["conv", "pos"]).join(turns, ["conv", "parent"], "left")
    return messages.select("conv", "pos", "conv_id", "turn", "role", _body(F.col("lines")).alias("body")).join(told, ["conv", "pos"]).select(
        "conv_id", "turn", "role", "position", "depth", "parent_turn", "linked", "n_passages", "n_linked", "body"
    )
