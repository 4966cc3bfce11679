"""Quotation linking: reply-ordered conversations without quotes.

A line's quote level is the number of its leading `>` marks.  Runs of lines of
one level are passages; each passage, its paragraphs and its lines are
normalised (lower case, single spaces) and hashed.  The own text of a message
(level 0) gives hashes in the same three grains.  The original of a passage is
the first message that stated it: the earliest turn of the same conversation
before the quoting one, else the smallest (conversation, turn) of any other
conversation.  For each hash the two smallest conversations that state it are
kept, so whoever quotes it finds one that is not its own; a phrase that everyone
writes makes one row and not all pairs.  A message replies to the latest turn
that its level-1 passages link to in its own conversation; chains of replies are
followed by pointer doubling.

Null text is empty.  Messages with a null conversation or turn stay, unlinked;
those with a null conversation have position null, as there is nothing that they
are a position in.  Of rows that repeat a (conversation, turn) each stays; they
share their links.  Positions number a conversation's rows by (thread, turn),
ties by text and role.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import materialize, slices, texts_of

MARKS = re.compile(r"^(?:[ \t]*>)+[ \t]?")
BLOCK_TURNS = 256
PARSED = "conv_id long, turn long, role string, own string, level int, passages array<struct<level:int,seq:int,grain:int,hash:string>>, stated array<struct<grain:int,hash:string>>"


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> str | None:
    n = normalised(text)
    return hashlib.sha256(n.encode("utf-8", "replace")).hexdigest() if n else None


def blocks(text: str) -> list[tuple[int, str]]:
    """(level, text) of each run of lines of one level; blank lines inside a
    quote belong to it only if marked."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        mark = MARKS.match(line)
        level, body = (mark[0].count(">"), line[mark.end() :]) if mark else (0, line)
        if out and out[-1][0] == level:
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
    return [(level, "\n".join(lines)) for level, lines in out]


def grains(text: str) -> list[tuple[int, str]]:
    """(grain, hash) of the whole (0), its paragraphs (1) and its lines (2);
    a hash appears once, in its widest grain."""
    found: dict[str, int] = {}
    for grain, parts in enumerate(([text], re.split(r"\n[ \t]*\n", text), text.split("\n"))):
        for h in filter(None, map(digest, parts)):
            found.setdefault(h, grain)
    return [(g, h) for h, g in found.items()]


def own_text(parts: list[tuple[int, str]]) -> str:
    return "\n".join(t for level, t in parts if level == 0).strip("\n")


def parse(messages: DataFrame) -> DataFrame:
    """Each message with its own text, its quoted passages and what it states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.list_(pa.struct([("level", pa.int32()), ("seq", pa.int32()), ("grain", pa.int32()), ("hash", pa.string())])), pa.list_(pa.struct([("grain", pa.int32()), ("hash", pa.string())])))
        for batch in slices(batches):
            own, level, passages, stated = [], [], [], []
            for text in texts_of(batch):
                parts = blocks((text or b"").decode("utf-8", "replace"))
                own.append(own_text(parts))
                quoted = [(i, lv, t) for i, (lv, t) in enumerate(parts) if lv and normalised(t)]
                level.append(max((lv for _, lv, _ in quoted), default=0))
                passages.append([{"level": lv, "seq": i, "grain": g, "hash": h} for i, lv, t in quoted for g, h in grains(t)])
                stated.append([{"grain": g, "hash": h} for g, h in grains(own[-1])])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "turn", "role")), pa.array(own, pa.string()), pa.array(level, pa.int32()), pa.array(passages, kinds[0]), pa.array(stated, kinds[1])],
                names=["conv_id", "turn", "role", "own", "level", "passages", "stated"],
            )

    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, PARSED)


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, seq, level, origin_conv, origin_turn) of each quoted
    passage whose original is known, by its widest grain that links."""
    keyed = parsed.where("conv_id is not null and turn is not null")
    quoted = keyed.where(F.size("passages") > 0).select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.*").distinct()
    hashes = quoted.select("hash").distinct()
    stated = keyed.select("conv_id", "turn", F.explode("stated.hash").alias("hash")).join(hashes, "hash", "left_semi")
    first_here = stated.groupBy("conv_id", "hash").agg(F.min("turn").alias("here"))
    # one row for each conversation that states a hash; the smallest, and the smallest of the others
    least = first_here.groupBy("hash").agg(F.min(F.struct("conv_id", F.col("here").alias("turn"))).alias("any"))
    other = first_here.join(least, "hash").where(F.col("conv_id") != F.col("any.conv_id")).groupBy("hash").agg(F.min(F.struct("conv_id", F.col("here").alias("turn"))).alias("next"))
    found = quoted.join(first_here, ["conv_id", "hash"], "left").join(least, "hash", "left").join(other, "hash", "left")
    here = F.when(F.col("here") < F.col("turn"), F.struct("conv_id", F.col("here").alias("turn")))
    elsewhere = F.when(F.col("any.conv_id") != F.col("conv_id"), F.col("any")).otherwise(F.col("next"))
    found = found.withColumn("origin", F.coalesce(here, elsewhere)).where("origin is not null")
    best = found.groupBy("conv_id", "turn", "seq", "level").agg(F.min_by("origin", F.struct("grain", F.col("origin.conv_id") != F.col("conv_id"), -F.col("origin.turn"), "hash")).alias("origin"))
    return best.select("conv_id", "turn", "seq", "level", F.col("origin.conv_id").alias("origin_conv"), F.col("origin.turn").alias("origin_turn"))


def threads(parents: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(conv_id, turn, parent_turn) -> with thread_turn, the first of the chain
    of replies, and depth, its length."""
    at = materialize(parents.withColumns({"thread_turn": F.col("parent_turn"), "depth": F.lit(1)}))
    for _ in range(max_rounds):
        up = at.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("higher"), F.col("depth").alias("more"))
        step = at.join(up, ["conv_id", "thread_turn"], "left")
        moved = step.select("conv_id", "turn", "parent_turn", F.coalesce("higher", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved"))
        moved = materialize(moved)
        at = moved.drop("moved")
        if not moved.where("moved").take(1):
            return at
    raise RuntimeError("reply chains did not settle")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message, without quotes: conv_id, position, turn, role, text,
    parent_turn, thread_turn, depth, quote_level, n_quotes, n_linked, n_elsewhere."""
    parsed = materialize(parse(messages))
    linked = materialize(links(parsed))
    counts = linked.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_linked"), F.count_if(F.col("origin_conv") != F.col("conv_id")).alias("n_elsewhere"),
        F.max(F.when((F.col("origin_conv") == F.col("conv_id")) & (F.col("level") == 1), F.col("origin_turn"))).alias("parent_turn"),
    )
    chains = threads(counts.where("parent_turn is not null").select("conv_id", "turn", "parent_turn")).drop("parent_turn")
    rows = parsed.select("conv_id", "turn", "role", F.col("own").alias("text"), F.col("level").alias("quote_level"), F.size(F.array_distinct(F.transform("passages", lambda p: p["seq"]))).cast("long").alias("n_quotes"))
    rows = rows.join(counts, ["conv_id", "turn"], "left").join(chains, ["conv_id", "turn"], "left")
    rows = rows.withColumns({"thread_turn": F.coalesce("thread_turn", "turn"), "depth": F.coalesce("depth", F.lit(0)), "n_linked": F.coalesce("n_linked", F.lit(0)), "n_elsewhere": F.coalesce("n_elsewhere", F.lit(0))})
    return _numbered(rows).select("conv_id", "position", "turn", "role", "text", "parent_turn", "thread_turn", "depth", "quote_level", "n_quotes", "n_linked", "n_elsewhere")


def _numbered(rows: DataFrame) -> DataFrame:
    """position from 0 by (thread_turn, turn, text) in each conversation: rows
    are numbered in blocks of BLOCK_TURNS turns, and blocks by their counts.
    Rows without a conversation are not dealt into one window."""
    block = F.floor(F.col("turn") / BLOCK_TURNS)
    loose = rows.where("conv_id is null").withColumn("position", F.lit(None).cast("long"))
    rows = rows.where("conv_id is not null").withColumn("_block", F.struct("thread_turn", block.alias("b")))
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn", "text", "role")
    sizes = rows.groupBy("conv_id", "_block").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    numbered = rows.withColumn("_k", F.row_number().over(inside) - 1).alias("r").join(before.alias("s"), F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & F.col("r._block").eqNullSafe(F.col("s._block")))
    return numbered.select("r.*", (F.col("_k") + F.coalesce("_before", F.lit(0))).alias("position")).drop("_block", "_k").unionByName(loose)
