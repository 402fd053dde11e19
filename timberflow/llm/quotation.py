"""Chat conversations from messages that quote each other.

1. The lines of a message are read with their quote level (the number of ``>`` in front).  Level 0 is the message's own text; a
   line just above a quote that only says who wrote it belongs to the quote.
2. Passages are the sentences and the lines of each level's runs, normalised (case folded, words only, so that wrapping and
   punctuation do not matter) and hashed.
3. The original of a passage is the first message of the conversation to say it as its own text.  A quoted passage is joined to
   its original; a message replies to the original that holds most of its outermost linked quote, by characters.
4. A message without a linked quote replies to the message before it.  The first reply to a message goes on with its thread,
   every other one opens a thread, so each message stands right behind the one it replies to.  Places in threads come from
   doubled pointers, in as many rounds as the logarithm of the longest thread.

No step gathers a conversation: originals are a minimum for each passage, threads are joins of unique keys.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberflow.llm.common import materialize

QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)")
WROTE = re.compile(r"[^>]*\b(?:wrote|writes|said|schrieb|schreibt|a écrit|écrit|escribió|escribe)\b[^.!?]{0,120}:\s*", re.I)
SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+")
WORD = re.compile(r"\w+")
#: Stands for a missing turn, which comes before all others.
NO_TURN = -(1 << 63)
#: Turns (as a power of two) that are ordered in one task; beyond, only each block's last turn goes on.
BLOCK_BITS = 12


def quote_levels(text: str) -> list[tuple[int, str]]:
    """(level, line without its quote signs) of every line; a line of who wrote what follows has level -1."""
    lines: list[tuple[int, str]] = []
    for line in text.split("\n"):
        sign = QUOTE.match(line)
        if not sign:
            lines.append((0, line))
            continue
        above = next((k for k in range(len(lines) - 1, -1, -1) if lines[k][1].strip()), None)
        if above is not None and lines[above][0] == 0 and WROTE.fullmatch(lines[above][1]):
            lines[above] = (-1, lines[above][1])
        lines.append((sign[1].count(">"), line[sign.end() :]))
    return lines


def own_text(text: str | None) -> str | None:
    """The message without quotes; one that quotes nothing is unchanged to the character, null stays null."""
    if not text or ">" not in text:
        return text
    lines = quote_levels(text)
    if not any(level for level, _ in lines):
        return text
    kept: list[str] = []
    for level, line in lines:
        if level == 0 and (line.strip() or (kept and kept[-1].strip())):
            kept.append(line)
    return "\n".join(kept).strip()


def _mark(passage: str) -> int:
    return int.from_bytes(hashlib.blake2b(passage.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def passages(text: str | None) -> list[tuple[int, str]]:
    """Distinct (level, normalised passage) in order: the sentences of each run of one level between blank lines, and its lines."""
    found: dict[tuple[int, str], None] = {}
    for (level, blank), run in groupby(quote_levels(text or ""), key=lambda x: (x[0], not x[1].strip())):
        if level < 0 or blank:
            continue
        lines = [line for _, line in run]
        for passage in (*SENTENCE.split(" ".join(lines)), *lines):
            normal = " ".join(WORD.findall(passage.casefold()))
            if normal:
                found[(level, normal)] = None
    return list(found)


@F.pandas_udf(T.StringType())
def _own(texts: pd.Series) -> pd.Series:
    return pd.Series([own_text(t) for t in texts], dtype=object)


def _passages(text: Column) -> Column:
    @F.pandas_udf("array<struct<level: int, hash: long, size: int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"level": lv, "hash": _mark(p), "size": len(p)} for lv, p in passages(t)] for t in texts], dtype=object)

    return cut(text)


def _join(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str = "inner") -> DataFrame:
    """Equality join in which a missing conversation equals itself; ``keys``: column of the left to column of the right."""
    right = right.select(*(F.col(c).alias(f"_r_{c}" if c in keys.values() else c) for c in right.columns))
    on = [F.col(a).eqNullSafe(F.col(f"_r_{b}")) for a, b in keys.items()]
    joined = left.join(right, on, how)
    return joined if how == "left_semi" else joined.drop(*(f"_r_{b}" for b in keys.values()))


def quoted_turns(passage_rows: DataFrame) -> DataFrame:
    """(conv, at, quoted) of messages with a linked quote, from (conv, at, level, hash, size)."""
    first = passage_rows.filter("level = 0").groupBy("conv", "hash").agg(F.min("at").alias("first"))
    quotes = passage_rows.filter("level > 0").distinct()
    linked = _join(quotes, first, {"conv": "conv", "hash": "hash"}).filter("first < at")
    votes = linked.groupBy("conv", "at", "level", "first").agg(F.sum("size").alias("votes"))
    best = F.max_by("first", F.struct(-F.col("level"), F.col("votes"), F.col("first")))
    return votes.groupBy("conv", "at").agg(best.alias("quoted"))


def turns_before(turns: DataFrame) -> DataFrame:
    """(conv, at, before): the turn before each distinct turn, null for a conversation's first."""
    blocks = turns.withColumn("block", F.shiftright("at", BLOCK_BITS))
    inside = blocks.withColumn("before", F.lag("at").over(Window.partitionBy("conv", "block").orderBy("at")))
    ends = blocks.groupBy("conv", "block").agg(F.max("at").alias("end"))
    carried = ends.select("conv", "block", F.lag("end").over(Window.partitionBy("conv").orderBy("block")).alias("carried"))
    return _join(inside, carried, {"conv": "conv", "block": "block"}, "left").select("conv", "at", F.coalesce("before", "carried").alias("before"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv, at, up, head, place) from (conv, at, up): thread by the turn of its head, and place in it from 0."""
    heirs = replies.filter("up IS NOT NULL").groupBy("conv", "up").agg(F.min("at").alias("heir"))
    followed = _join(replies, heirs.select("conv", F.col("heir"), F.lit(True).alias("goes_on")), {"conv": "conv", "at": "heir"}, "left")
    start = followed.select(
        "conv", "at", "up", F.when(F.col("goes_on"), F.col("up")).otherwise(F.col("at")).alias("head"), F.when(F.col("goes_on"), 1).otherwise(0).cast("long").alias("place")
    )
    state = materialize(start.withColumn("done", F.col("place") == 0))
    while not state.filter("NOT done").isEmpty():
        ahead = state.select("conv", "at", F.col("head").alias("far"), F.col("place").alias("steps"), F.col("done").alias("ends"))
        moved = _join(state.filter("NOT done"), ahead, {"conv": "conv", "head": "at"}).select(
            "conv", "at", "up", F.col("far").alias("head"), (F.col("place") + F.col("steps")).alias("place"), F.col("ends").alias("done")
        )
        state = materialize(state.filter("done").unionByName(moved))
    return state.drop("done")


def _turn(at: Column) -> Column:
    return F.when(at != NO_TURN, at)


def link(messages: DataFrame) -> DataFrame:
    """Reply structure of ``messages`` (conv_id, turn, role, text): conv_id, turn, role, thread, place, reply_to, body.

    ``thread`` is the turn of the thread's first message, ``place`` the message's place in it, ``reply_to`` the turn it replies
    to (null for a conversation's first), ``body`` its text without quotes.  Messages without conv_id form one conversation;
    a message without turn comes first in its own, as turn null; rows that share conv_id and turn share their place, and repeated
    rows come out repeated.  Null and empty texts say and quote nothing.  Other columns are left out; no rows give no rows.
    """
    own = messages.select(
        F.col("conv_id").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)).alias("at"), "role", "text"
    )
    cut = own.select("conv", "at", F.explode(_passages(F.col("text"))).alias("p")).select("conv", "at", "p.*")
    quoted = quoted_turns(materialize(cut))
    before = turns_before(own.select("conv", "at").distinct())
    replies = _join(before, quoted, {"conv": "conv", "at": "at"}, "left").select("conv", "at", F.coalesce("quoted", "before").alias("up"))
    places = threads(replies)
    said = own.select("conv", "at", "role", _own("text").alias("body"))
    return _join(said, places, {"conv": "conv", "at": "at"}).select(
        F.col("conv").alias("conv_id"),
        _turn(F.col("at")).alias("turn"),
        "role",
        _turn(F.col("head")).alias("thread"),
        "place",
        _turn(F.col("up")).alias("reply_to"),
        "body",
    )


def chats(linked: DataFrame, messages: int = 256) -> DataFrame:
    """(conv_id, thread, part, chat): the threads as chat text, cut into parts of at most ``messages`` places each; repeated rows speak once."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("body", F.lit("")), F.lit("<|end|>\n"))
    parts = linked.select("conv_id", "thread", F.floor(F.col("place") / messages).cast("long").alias("part"), F.struct("place", line.alias("line")).alias("m"))
    ordered = F.array_sort(F.collect_set("m"))
    return parts.groupBy("conv_id", "thread", "part").agg(F.array_join(F.transform(ordered, lambda m: m["line"]), "").alias("chat"))
