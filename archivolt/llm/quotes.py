"""Conversations without quotations: quoted passages are linked to the messages they come from.

A line that begins with ``>`` signs is quoted; their number is its level.  Lines
of one level that follow each other are a passage.  A passage's lines are
normalised (signs off, small letters, single spaces) and hashed, and so are the
lines of what each message says itself.  A quoted line comes from the latest
earlier message of the conversation that says it.  A message replies to the
message that most of its first-level lines come from; deeper levels are links of
the messages quoted in it.  Replies follow their message; text goes without
quotations that were found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm.tables import checkpoint
from archivolt.operators.ordered import carried

_SIGNS = r"^((?:\s*>)+)\s?"


def level(line: Column) -> Column:
    """Number of quotation signs before a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _SIGNS, 1), r"[^>]", ""))


def normalised(line: Column) -> Column:
    """A line as it is compared: without signs, in small letters, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _SIGNS, "")), r"[\s\x{00A0}]+", " "))


def lines(messages: DataFrame) -> DataFrame:
    """``row, conv_id, turn, at, line, level, key`` of all lines; ``key`` is null for blank ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = messages.select("row", "conv_id", "turn", F.posexplode(F.split(text, r"\r\n|\r|\n", -1)).alias("at", "line"))
    plain = normalised(F.col("line"))
    return each.select("*", level(F.col("line")).alias("level"), F.when(plain != "", F.xxhash64(plain)).alias("key"))


def quotations(each: DataFrame) -> DataFrame:
    """``row, conv_id, turn, at, level, origin`` of the quoted lines that an earlier turn of the conversation says.

    No line meets all its equals: what is said and what is quoted are put in
    order of turns, and the latest turn that says the line is carried forward.
    """
    both = each.where("key IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "row", "conv_id", "turn", "at", "level", "key", F.when(F.col("level") == 0, F.col("turn")).alias("says"),
        (F.col("turn") * 2 + F.when(F.col("level") == 0, 1).otherwise(0)).alias("order"))
    # Said once or often in a turn, it is one fact.
    said = both.where("level = 0").groupBy("conv_id", "key", "turn", "says", "order").agg(F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("level"))
    # Lines that nobody quotes need not travel.
    quoted = both.where("level > 0")
    wanted = quoted.select("conv_id", "key").distinct()
    rows = said.join(wanted, ["conv_id", "key"], "left_semi").unionByName(quoted)
    found = carried(rows, ["conv_id", "key"], "order", "says", "origin")
    return found.where("level > 0 AND origin IS NOT NULL").select("row", "conv_id", "turn", "at", "level", "origin")


def paths(replies: DataFrame) -> DataFrame:
    """``conv_id, turn, path``: the turns from a thread's first message down, for ``replies (conv_id, turn, reply_to)``.

    Each pass doubles the length that paths reach, so a thread of depth ``d``
    takes about ``log2(d)`` passes.  A reply is later than its message, so there
    are no circles.
    """
    state = checkpoint(replies.select("conv_id", "turn", F.col("reply_to").alias("top"), F.array("turn").alias("path")))
    while not state.where("top IS NOT NULL").isEmpty():
        upper = state.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("path").alias("before"))
        state = checkpoint(state.join(upper, ["conv_id", "top"], "left").select(
            "conv_id", "turn", F.when(F.col("before").isNotNull(), F.col("next")).alias("top"),
            F.when(F.col("before").isNotNull(), F.concat("before", "path")).when(F.col("top").isNotNull(), F.concat(F.array("top"), F.col("path"))).otherwise(F.col("path")).alias("path")))
    return state.select("conv_id", "turn", "path")


def format_chats(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, reply_to, depth, path, n_quoted`` of every message.

    ``text`` is what the message says itself: lines whose source was found are
    gone, other quoted lines stay as they are; ``n_quoted`` counts the lines
    that went.  ``reply_to`` is the turn replied to, null for a message that
    begins a thread; of turns quoted alike the latest counts.  Sorting by
    ``conv_id, path`` puts replies after their message, threads in order of
    their first turns.  Messages with one conv_id and turn are one place in the
    order.  A message without conv_id or turn quotes nobody; its path is its
    turn, or empty.  A null text is empty; other columns are not read; an empty
    table gives no rows.
    """
    rows = checkpoint(messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    ).withColumn("row", F.monotonically_increasing_id()))
    quoting = rows.where(F.coalesce("text", F.lit("")).rlike(r"(?m)^\s*>"))
    # Only conversations in which somebody quotes need their lines cut and compared.
    busy = rows.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    each = lines(busy)
    found = checkpoint(quotations(each))
    votes = found.where("level = 1").groupBy("conv_id", "turn", "origin").agg(F.count("*").alias("n"))
    replies = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "origin")).alias("best")).select("conv_id", "turn", F.col("best.origin").alias("reply_to"))
    # Messages replied to stand in the tree too.
    heads = replies.select("conv_id", F.col("reply_to").alias("turn")).distinct().join(replies, ["conv_id", "turn"], "left_anti")
    tree = checkpoint(replies.unionByName(heads.withColumn("reply_to", F.lit(None).cast("long"))))
    places = paths(tree).join(tree, ["conv_id", "turn"])
    gone = found.groupBy("row").agg(F.collect_set("at").alias("gone"))  # a message's own lines
    own = rows.join(gone, "row", "left").join(places, ["conv_id", "turn"], "left")
    kept = F.filter(F.split("text", r"\r\n|\r|\n", -1), lambda line, at: ~F.array_contains("gone", at))
    path = F.coalesce("path", F.when(F.col("turn").isNull(), F.array().cast("array<long>")).otherwise(F.array("turn")))
    return own.select(
        "conv_id", "turn", "role", F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.trim(F.array_join(kept, "\n"))).alias("text"), "reply_to",
        (F.greatest(F.size(path), F.lit(1)) - 1).alias("depth"), path.alias("path"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_quoted"))


def reply_order(formatted: DataFrame) -> DataFrame:
    """The messages in reading order, range-partitioned by conversation and path."""
    return formatted.orderBy("conv_id", "path")
