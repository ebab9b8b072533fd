"""Conversations from quotes (native).

Messages quote earlier ones in lines that begin with ``>``, nested by repeating
it.  Lines are parsed into paragraphs with their level; quoted paragraphs are
normalised (case, white space) and hashed, as are the paragraphs that messages
wrote themselves; a quoted paragraph is linked to the first message that wrote it.
A message answers the latest message linked at the lowest level that has a link.
Answers are joined into conversations, numbered so that every message comes
after the one it answers, with the quotes taken out.

Originals come down to one row for each (scope, paragraph), so a paragraph that
many messages write or quote is a hot key on one side only, which Spark can split.
Places in a conversation come from one global sort, not from a window over it.

A conversation is named after the message it begins with.

Defined cases: a null text is empty; a message without an original, or whose
quotes all come from later messages, starts a conversation; rows with one
message_id are one message, which begins at the smallest of their positions; a null scope is a scope;
a null message_id or position takes no part in links and is a conversation
of its own; ties in position go to the smaller message_id; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.sources.workspace import Workspace

from .components import followed

QUOTE = r"^(?:[\x20\t]?>)+[\x20\t]?"
ATTRIBUTION = r"^On .{1,200} wrote:\s*$"
PARAGRAPHS = "array<struct<level:int,text:string>>"


def parsed_lines(text: Column) -> Column:
    """(level, text) of every line; level 0 is the message's own."""
    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, QUOTE, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.substring(line, F.length(marks) + 1, F.length(line)).alias("text"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), one)


def paragraphs(lines: Column) -> Column:
    """Runs of lines of one level without a blank line between them, as (level, text)."""
    start = F.struct(F.array().cast(PARAGRAPHS).alias("out"), F.lit(0).alias("level"), F.lit("").alias("text"))

    def flushed(acc: Column) -> Column:
        one = F.array(F.struct(acc["level"].alias("level"), acc["text"].alias("text"))).cast(PARAGRAPHS)
        return F.when(acc["text"] == "", acc["out"]).otherwise(F.concat(acc["out"], one))

    def step(acc: Column, line: Column) -> Column:
        blank = F.trim(line["text"]) == ""
        same = ~blank & (acc["level"] == line["level"])
        return F.struct(
            F.when(same, acc["out"]).otherwise(flushed(acc)).alias("out"), line["level"].alias("level"),
            F.when(blank, F.lit("")).when(same & (acc["text"] != ""), F.concat(acc["text"], F.lit("\n"), line["text"])).otherwise(line["text"]).alias("text"))

    return F.aggregate(lines, start, step, flushed)


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def without_quotes(lines: Column) -> Column:
    """The message's own lines, without lines that announce a quote and without blank lines at the ends."""
    own = F.filter(lines, lambda x: (x["level"] == 0) & ~x["text"].rlike(ATTRIBUTION))
    return F.btrim(F.array_join(F.transform(own, lambda x: x["text"]), "\n"), F.lit("\n"))


def conversations(messages: DataFrame, work: Workspace) -> DataFrame:
    """(scope, conversation_id, place, message_id, parent_id, n_quoted, n_linked, role, text) of every message.

    ``messages`` has scope, message_id, position, role and text.
    """
    rows = messages.select("scope", F.col("message_id").cast("string").alias("message_id"), "position", "role",
                           parsed_lines(F.col("text")).alias("lines"))
    rows = rows.withColumn("paragraphs", F.transform(paragraphs(F.col("lines")), lambda p: F.struct(
        p["level"].alias("level"), F.unhex(F.md5(normalised(p["text"]).cast("binary"))).alias("hash"), p["text"].rlike(ATTRIBUTION).alias("says"))))
    rows = work.save(rows.select("scope", "message_id", "position", "role", without_quotes(F.col("lines")).alias("text"),
                                 F.filter("paragraphs", lambda p: ~((p["level"] == 0) & p["says"])).alias("paragraphs")), "messages")
    parts = rows.where("message_id IS NOT NULL AND position IS NOT NULL").select(
        "scope", "message_id", "position", F.explode("paragraphs").alias("p")).select("scope", "message_id", "position", "p.level", "p.hash")
    first = parts.where("level = 0").groupBy("scope", "hash").agg(F.min(F.struct("position", "message_id")).alias("origin"))
    first = work.save(first.select(F.col("scope").alias("o_scope"), F.col("hash").alias("o_hash"), F.col("origin.position").alias("o_position"),
                                   F.col("origin.message_id").alias("origin")), "originals")
    quoted = work.save(parts.where("level > 0"), "quoted")
    # a message begins where its first row stands, so answers never run in circles
    begins = rows.groupBy(F.col("message_id").alias("b_id")).agg(F.min("position").alias("begins"))
    quoted = quoted.join(begins, F.col("message_id") == F.col("b_id"))
    linked = quoted.join(first, F.col("scope").eqNullSafe(F.col("o_scope")) & (F.col("hash") == F.col("o_hash"))).where(
        "o_position < begins AND origin <> message_id")
    linked = work.save(linked.select("scope", "message_id", "level", "o_position", "origin"), "linked")
    answers = linked.groupBy("message_id").agg(F.max(F.struct((-F.col("level")).alias("near"), "o_position", "origin")).alias("best"),
                                               F.count(F.lit(1)).cast("long").alias("n_linked"))
    answers = work.save(answers.select(F.col("message_id").alias("a_id"), F.col("best.origin").alias("parent_id"), "n_linked"), "answers")
    roots = followed(answers.select(F.col("a_id").alias("node"), F.col("parent_id").alias("root")), work, "threads")

    whole = rows.join(answers, F.col("message_id") == F.col("a_id"), "left").join(roots, F.col("message_id") == F.col("node"), "left")
    whole = whole.select("scope", F.coalesce("root", "message_id").alias("conversation_id"), "message_id", "position", "parent_id",
                         F.size(F.filter("paragraphs", lambda p: p["level"] > 0)).cast("long").alias("n_quoted"),
                         F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "role", "text")
    # a global sort by (conversation, position) deals a long conversation over many tasks
    whole = work.save(whole.sort("conversation_id", "position", "message_id", "text"), "sorted_rows")
    placed = work.save(whole.sort("conversation_id", "position", "message_id", "text").withColumn("at", F.monotonically_increasing_id()), "placed")
    per_task = placed.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count(F.lit(1)).alias("n"))
    tasks = {r["task"]: r["n"] for r in per_task.collect()}  # one row for each task of the sort
    starts, total = [], 0
    for task in range(max(tasks, default=-1) + 1):
        starts.append(total)
        total += tasks.get(task, 0)
    offset = F.get(F.split(F.lit(",".join(map(str, starts or [0]))), ",").cast("array<bigint>"), F.shiftright("at", 33).cast("int"))
    indexed = placed.withColumn("index", offset + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    low = work.save(indexed.groupBy("conversation_id").agg(F.min("index").alias("low")).withColumnRenamed("conversation_id", "l_id"), "first_places")
    return indexed.join(low, F.col("conversation_id").eqNullSafe(F.col("l_id"))).select(
        "scope", "conversation_id", (F.col("index") - F.col("low")).alias("place"), "message_id", "parent_id", "n_quoted", "n_linked", "role", "text")


def as_mails(turns: DataFrame) -> DataFrame:
    """Turns of a chat (conv_id, turn, role, text) as mails that quote the turn before them and, nested, the one before that."""
    mark = lambda text, sign: F.concat(F.lit(sign), F.regexp_replace(text, "\n", "\n" + sign))
    one = turns.select(F.col("conv_id").alias("scope"), F.col("turn").cast("long").alias("position"), "role", "text")

    def before(n: int) -> DataFrame:
        return one.where("text <> ''").groupBy(F.col("scope").alias(f"s{n}"), (F.col("position") + n).alias(f"p{n}")).agg(
            F.min(F.struct("text", "role")).alias(f"t{n}"))

    all_ = one
    for n in (1, 2):
        all_ = all_.join(before(n), F.col("scope").eqNullSafe(F.col(f"s{n}")) & (F.col("position") == F.col(f"p{n}")), "left")
    said = F.concat(F.lit("On an earlier turn the "), F.coalesce("t1.role", F.lit("other")), F.lit(" wrote:"))
    text = F.concat_ws("\n", F.when(F.col("t1").isNotNull(), said), mark(F.col("t2.text"), ">> "), mark(F.col("t1.text"), "> "),
                       F.lit(""), F.coalesce("text", F.lit("")))
    return all_.select("scope", F.concat_ws(":", F.coalesce(F.col("scope").cast("string"), F.lit("none")), F.col("position")).alias("message_id"),
                       "position", "role", text.alias("text"))
