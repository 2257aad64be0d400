"""Replies linked to what they quote, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import saved, with_rank
from rankloom.llm.components import components

# Quote marks at the start of a line, with or without spaces between them.
MARKS = "^(?:[ \\t]*>)+[ \\t]?"

# A line such as "On Monday, X wrote:" right above a quote, in four languages.
ANNOUNCES = "^(?:On|Am|Le|El) .*(?:wrote|schrieb.*|a écrit|escribió)\\s*:\\s*$"


def _lines(text: str = "text") -> Column:
    """Lines of a text as structs: ``level`` (number of quote marks) and ``line`` without them."""
    def one(line):
        marks = F.regexp_extract(line, MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(line, MARKS, "").alias("line"))
    return F.transform(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), "\n"), one)


def _bound(value: Column, of) -> Column:
    """``of(value)``, with ``value`` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), of), 0)


def _passages(lines: Column) -> Column:
    """Runs of lines of one level as structs ``(level, body)``; blank lines end a run and belong to none."""
    def blank(at):
        return F.trim(F.get(lines, at)["line"]) == ""

    # Where a run starts; its end is the next start, so all slices together are as long as the text.
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda at: F.coalesce(
        blank(at) | blank(at - 1) | (F.get(lines, at)["level"] != F.get(lines, at - 1)["level"]), F.lit(True)))

    def run(starts, start, k):
        end = F.coalesce(F.get(starts, k + 1), F.size(lines))
        body = F.array_join(F.transform(F.slice(lines, start + 1, end - start), lambda x: x["line"]), "\n")
        return F.struct(F.get(lines, start)["level"].alias("level"), body.alias("body"))

    runs = _bound(starts, lambda starts: F.transform(starts, lambda start, k: run(starts, start, k)))
    return F.filter(runs, lambda r: F.trim(r["body"]) != "")


def normal(text: Column) -> Column:
    """A passage as it is compared: lower case, any run of white space one space."""
    return F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))


def unquoted(lines: Column) -> Column:
    """The text without quoted lines and the lines that announce them, blank lines at both ends removed."""
    def stays(x, at):
        announces = x["line"].rlike(ANNOUNCES) & (F.coalesce(F.get(lines, at + 1)["level"], F.lit(0)) > 0)
        return (x["level"] == 0) & ~announces

    own = F.transform(F.filter(lines, stays), lambda x: x["line"])
    return F.regexp_replace(F.array_join(own, "\n"), "^\\s*\n|\\s+$", "")


def _numbered_lines(body: str) -> Column:
    """Rows ``(i, line)`` of a passage's lines, each by a hash of it as it is compared."""
    return F.posexplode(F.transform(F.split(body, "\n"), lambda line: F.md5(normal(line)))).alias("i", "line")


def _trimmed(runs: DataFrame, quotes: DataFrame) -> DataFrame:
    """``(conv_id, turn, at, source)``: the first earlier turn with a passage that has a quote's lines one after the other.

    The rarest of a quote's lines in its conversation says where it can lie;
    each of these few places is then held against all lines, by equal joins of
    line and place. Work grows with the lines and not with pairs of windows.
    """
    key = ["conv_id", "turn", "at", "hash"]
    mine = saved(quotes.select(*key, "n", _numbered_lines("body")), "quoted-lines")
    passages = (runs.where("run.level = 0").join(quotes.select("conv_id").distinct(), "conv_id", "left_semi")
                .select("conv_id", F.col("turn").alias("source"), F.md5("run.body").alias("passage"), F.col("run.body").alias("body")).distinct())
    lines = saved(passages.select("conv_id", "source", "passage", F.size(F.split("body", "\n")).alias("size"), _numbered_lines("body")), "passage-lines")
    counts = lines.groupBy("conv_id", "line").count()
    # A quote with a line that no passage has is not found.
    rarest = (mine.join(counts, ["conv_id", "line"]).groupBy(*key, "n")
              .agg(F.count(F.lit(1)).alias("known"), F.min_by(F.struct("i", "line"), F.struct("count", "i")).alias("rare")).where("known = n"))
    places = (rarest.select(*key, "n", F.col("rare.i").alias("j"), F.col("rare.line").alias("line")).join(lines, ["conv_id", "line"])
              .where("source < turn AND i >= j AND i - j + n <= size").select(*key, "n", "source", "passage", (F.col("i") - F.col("j")).alias("start")))
    asked = places.join(mine.drop("n"), key).withColumn("i", F.col("start") + F.col("i"))
    same = asked.join(lines.select("conv_id", "source", "passage", "i", "line"), ["conv_id", "source", "passage", "i", "line"])
    whole = same.groupBy(*key, "n", "source", "passage", "start").count().where("count = n")
    return whole.groupBy(*key).agg(F.min("source").alias("source")).select("conv_id", "turn", "at", "source")


def conversations(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, level, reply_to, thread, position, content, message)`` for every row of ``messages(conv_id, turn, role, text)``.

    A quoted passage is a run of lines with the same number of quote marks; it
    is linked by the hash of its normalised text to the first earlier turn of
    the conversation that has it as a passage (or a single line) of its own,
    else to the first one with a passage that holds its lines one after the other.
    ``reply_to`` is the latest turn linked to a quote of the first level, or of
    the lowest level that links at all. ``thread`` is the turn at the root of a
    chain of replies, the message's own if it answers nothing known, and
    ``position`` counts from 0 within the conversation by (thread, turn): what
    is answered stands before the answer. ``level`` is the deepest quote,
    ``content`` the text without quoted lines, ``message`` the content with its
    role in front. A null text is empty; rows with a null conv_id or turn link
    to nothing and are their own thread. Rows that repeat (conv_id, turn) are
    one message for links and stay in the result. Other columns are ignored.
    """
    found = _bound(_lines(), lambda lines: F.struct(
        unquoted(lines).alias("content"), _passages(lines).alias("passages"),
        F.array_max(F.transform(lines, lambda x: x["level"])).alias("level")))
    parsed = saved(messages.select("conv_id", "turn", "role", found.alias("found")).select("conv_id", "turn", "role", "found.*"), "messages")
    keyed = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    runs = keyed.select("conv_id", "turn", F.explode("passages").alias("run"))
    # A quote may be of one line of a passage only.
    lines = F.array_distinct(F.concat(F.array(F.col("run.body")), F.split("run.body", "\n")))
    own = (runs.where("run.level = 0").select("conv_id", "turn", F.explode(lines).alias("body"))
           .select("conv_id", "turn", normal(F.col("body")).alias("body")).where("body <> ''"))
    # The first turn with a passage, summed up before the shuffle: one row a passage, however often it is repeated.
    first = own.groupBy("conv_id", F.sha2("body", 256).alias("hash")).agg(F.min("turn").alias("source"))
    quoted = saved(runs.where("run.level > 0").select("conv_id", "turn", F.col("run.level").alias("at"), F.size(F.split("run.body", "\n")).alias("n"),
                                                      F.sha2(normal(F.col("run.body")), 256).alias("hash"), "run.body")
                   .dropDuplicates(["conv_id", "turn", "at", "n", "hash"]), "quotes")
    whole = saved(quoted.join(first, ["conv_id", "hash"]).where("source < turn"), "whole-quotes")
    rest = saved(quoted.where("n > 1").join(whole, ["conv_id", "turn", "at", "n", "hash"], "left_anti"), "other-quotes")
    trimmed = _trimmed(runs, rest)
    linked = (whole.select("conv_id", "turn", "at", "source").union(trimmed.select("conv_id", "turn", "at", "source"))
              .groupBy("conv_id", "turn").agg(F.min(F.struct("at", (-F.col("source")).alias("neg"))).alias("best"))
              .select("conv_id", "turn", (-F.col("best.neg")).alias("reply_to")))
    linked = saved(linked, "replies")
    # Turns grow along a chain, so the smallest of a component is its root.
    roots = components(linked.select(F.struct("conv_id", F.col("reply_to").alias("turn")).alias("src"), F.struct("conv_id", "turn").alias("dst")))
    threads = saved(roots.select(F.col("node.conv_id").alias("conv_id"), F.col("node.turn").alias("turn"), F.col("root.turn").alias("thread")), "threads")
    joined = (parsed.drop("passages").join(linked, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
              .withColumn("thread", F.coalesce("thread", "turn")))
    ranked = with_rank(joined, ["conv_id", "thread", "turn", "role", "content"], "reply-order")
    start = saved(ranked.groupBy("conv_id").agg(F.min("rank").alias("start")), "conversation-starts")
    # Null-safe, for rows without a conversation.
    return (ranked.alias("m").join(start.alias("s"), F.col("m.conv_id").eqNullSafe(F.col("s.conv_id")))
            .select("m.conv_id", "turn", "role", "level", "reply_to", "thread", (F.col("rank") - F.col("start")).alias("position"), "content",
                    F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("content")).alias("message")))
