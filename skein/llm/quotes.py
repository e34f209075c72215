"""Chat formatting by quotation linking: quoted lines and passages are hashed and joined to the messages they come from; conversations keep replies without quotes in reply order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.shared import staged, table

_MARKS = r"^\s*((?:>\s?)+)"
#: Turns of a conversation that are looked at together; a longer one spans several tasks.
BLOCK = 4096
_COUNTS = ("n_quoted", "n_linked", "max_level")


def _units(rows: DataFrame) -> DataFrame:
    """The distinct hashed units of each message, with their quote level, 0 for what the message says itself, and whether a line is one.

    Units are lines, paragraphs (lines of one level up to a blank line or another level) and runs (the same over
    blank lines), each in lower case with single spaces, so that a passage is found where its lines are broken elsewhere.
    """
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))
    passage = lambda line: F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARKS, "")), r"\s+", " "))
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(level(x).alias("level"), passage(x).alias("passage")))
    rows = rows.select("conv_id", "turn", "m", lines.alias("lines")).withColumn("full", F.filter("lines", lambda x: x.passage != ""))
    rows = rows.select("conv_id", "turn", "m", "lines", "full", F.explode(F.array_distinct(F.transform("full", lambda x: x.level))).alias("level"))
    at = lambda x: x.level == F.col("level")
    end = F.lit("\0")
    pieces = lambda lines: F.split(F.array_join(F.transform(lines, lambda x: F.when(at(x) & (x.passage != ""), x.passage).otherwise(end)), " "), r"\s*\x00\s*")
    unit = lambda texts, line: F.transform(texts, lambda x: F.struct(F.trim(x).alias("passage"), F.lit(line).alias("line")))
    alone = F.transform(F.filter("full", at), lambda x: x.passage)
    units = rows.select("conv_id", "turn", "m", "level", F.explode(F.concat(unit(alone, True), unit(pieces(F.col("lines")), False), unit(pieces(F.col("full")), False))).alias("u")).where("u.passage <> ''")
    return units.groupBy("conv_id", "turn", "m", "level", F.xxhash64("u.passage").alias("h")).agg(F.max("u.line").alias("line"))


def _sources(lines: DataFrame) -> DataFrame:
    """(conv_id, h, turn, source): of each turn that quotes a passage, the latest earlier turn that says it.

    Turns are looked at in blocks, and blocks carry the latest turn that says the passage to those after
    them, so that no task sorts all the turns of one line.
    """
    said = lines.groupBy("conv_id", "h", "turn").agg(F.max(F.when(F.col("level") == 0, F.col("turn"))).alias("said"), F.max(F.col("level") > 0).alias("quotes"))
    said = said.withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = said.groupBy("conv_id", "h", "block").agg(F.max("said").alias("last"), F.max("quotes").alias("quotes"))
    before = Window.partitionBy("conv_id", "h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.max("last").over(before)).where("quotes").select("conv_id", "h", "block", "before")
    inside = Window.partitionBy("conv_id", "h", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    near = said.withColumn("near", F.max("said").over(inside)).where("quotes")
    return near.join(blocks, ["conv_id", "h", "block"]).select("conv_id", "h", "turn", F.coalesce("near", "before").alias("source"))


def _linked(messages: DataFrame) -> DataFrame:
    """Every message with its counts, its link, and a link elsewhere for what its own conversation doesn't say before."""
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("m", F.xxhash64("text"))
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    units = _units(rows.where(placed))
    linked = units.where("level > 0").join(_sources(units), ["conv_id", "h", "turn"])
    # Of each passage two conversations that say it are enough: one of them isn't the quoting one.
    elsewhere = units.where("level = 0").groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("lo"), F.max(F.struct("conv_id", F.negative("turn").alias("turn"))).alias("hi"))
    hi = F.when(F.col("hi.conv_id") != F.col("conv_id"), F.struct(F.col("hi.conv_id").alias("conv_id"), F.negative("hi.turn").alias("turn")))
    linked = linked.join(elsewhere, "h", "left").withColumn("other", F.when(F.col("source").isNull(), F.when(F.col("lo.conv_id") != F.col("conv_id"), F.col("lo")).otherwise(hi)))
    line = lambda c: F.count(F.when(F.col("line"), F.col(c)))
    passages = F.count(F.when(~F.col("line"), F.col("source"))).alias("n_passages")
    per = linked.groupBy("conv_id", "turn", "m").agg(line("h").alias("n_quoted"), line("source").alias("n_linked"), F.max("level").cast("int").alias("max_level"), F.max("source").alias("reply_to"), passages, F.min("other").alias("other"))
    reply = F.trim(F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(_MARKS)), "\n"))
    rows = rows.withColumn("reply", reply)
    # Rows without a place stay out of the join, where their nulls would meet in one task.
    out = rows.where(placed).join(per, ["conv_id", "turn", "m"], "left").unionByName(rows.where(~placed), allowMissingColumns=True)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in (*_COUNTS, "n_passages")]
    return out.select("conv_id", "turn", "m", "role", "reply", *counts, "reply_to", F.col("other.conv_id").alias("other_conv"), F.col("other.turn").alias("other_turn"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply, n_quoted, n_linked, max_level and reply_to for each row of messages (conv_id, turn, role, text).

    Lines that begin with > marks are quotes of as many levels; a quoted line's passage, lower-cased with single
    spaces, is hashed and linked to the latest earlier turn of its conversation that says the same itself, as a line or
    over several; so are quoted lines of one level together. n_quoted and n_linked count lines. reply_to is the
    latest linked turn; reply the text without quotes. Only hashes are shuffled, and a hash's rows meet in turn order, not in
    pairs. Null and empty texts have an empty reply; rows with null conv_id or turn aren't linked; repeated rows
    stay rows; other columns are ignored.
    """
    return _linked(messages).select("conv_id", "turn", "role", "reply", *_COUNTS, "reply_to")


def reply_order(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, position, depth) of each turn that answers one or is answered, for replies (conv_id, turn, parent).

    thread is the turn that begins it; position counts its turns from 0 so that each turn's answers, in turn order, come
    with all of theirs before the next one. Sizes and then places are summed over ancestors at doubling distances, in
    as many equi-joins as the depth has bits; the answers of one turn are summed in blocks, so no task holds a thread.
    """
    replies = staged(replies.select("conv_id", "turn", "parent"), "replies")
    size = replies.select("conv_id", "turn").union(replies.select("conv_id", "parent")).distinct().withColumn("size", F.lit(1).cast("long"))
    up = replies
    while not up.isEmpty():
        more = size.join(up, ["conv_id", "turn"]).groupBy("conv_id", F.col("parent").alias("turn")).agg(F.sum("size").alias("more"))
        size = staged(size.join(more, ["conv_id", "turn"], "left").select("conv_id", "turn", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
        up = staged(up.join(up.select("conv_id", F.col("turn").alias("parent"), F.col("parent").alias("next")), ["conv_id", "parent"]).select("conv_id", "turn", F.col("next").alias("parent")), "ancestors")
    sons = replies.join(size, ["conv_id", "turn"]).withColumn("block", F.floor(F.col("turn") / BLOCK))
    before = lambda *by: Window.partitionBy("conv_id", "parent", *by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sons.groupBy("conv_id", "parent", "block").agg(F.sum("size").alias("all"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("all").over(before().orderBy("block")), F.lit(0))).drop("all")
    sons = sons.withColumn("near", F.coalesce(F.sum("size").over(before("block").orderBy("turn")), F.lit(0))).join(blocks, ["conv_id", "parent", "block"])
    place = staged(sons.select("conv_id", "turn", F.col("parent").alias("thread"), (F.col("near") + F.col("before") + 1).alias("position"), F.lit(1).cast("long").alias("depth")), "places")
    while not place.join(above := place.toDF("conv_id", "thread", "next", "far", "deep"), ["conv_id", "thread"], "semi").isEmpty():
        joined = place.join(above, ["conv_id", "thread"], "left")
        place = staged(joined.select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("position") + F.coalesce("far", F.lit(0))).alias("position"), (F.col("depth") + F.coalesce("deep", F.lit(0))).alias("depth")), "places")
    zero = F.lit(0).cast("long")
    first = place.select("conv_id", F.col("thread").alias("turn")).distinct()
    return place.union(first.select("conv_id", "turn", F.col("turn").alias("thread"), zero, zero))


def conversations(messages: DataFrame) -> DataFrame:
    """The linked messages without quotes in reply order, over ranges of it, so that a long conversation spans several tasks.

    Conversations are rows in the order of conv_id, thread (the turn that begins it) and position, each answer after what
    it answers, depth replies deep. Rows of one turn stand together, under the latest turn that any of them answers. n_passages counts quoted
    paragraphs and runs, apart from lines, that are linked; (other_conv, other_turn) is a message of another conversation
    that says what this one's doesn't say before, if any. Rows without conv_id or turn have no thread and come first.
    """
    rows = staged(_linked(messages), "linked")
    replies = rows.where("reply_to is not null").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("parent"))
    alone = F.when(F.col("conv_id").isNotNull(), F.col("turn"))
    if replies.isEmpty():
        rows = rows.select("*", alone.alias("thread"), F.lit(None).cast("long").alias("position"), F.lit(None).cast("long").alias("depth"))
    else:
        rows = rows.join(reply_order(replies), ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", alone))
    start = lambda c: F.coalesce(c, F.when(F.col("thread").isNotNull(), F.lit(0).cast("long"))).alias(c)
    out = rows.select("conv_id", "thread", start("position"), start("depth"), "turn", "role", "reply", *_COUNTS, "reply_to", "n_passages", "other_conv", "other_turn", "m")
    order = ["conv_id", "thread", "position", "turn", "m"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).drop("m")


def op3_quote_links(spark, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))
