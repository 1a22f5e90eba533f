"""Conversations ordered by replies, with quotations linked and taken out.

Lines that start with ``>`` are quoted; the markers before the text give the
nesting level. Every line is normalised (markers off, white space as one space,
lower case) and hashed. Quoted lines of a message are joined by conversation and
hash to the unquoted lines of earlier messages of the same conversation. A line
of a re-wrapped passage is found by words: runs of quoted lines of one level are
one passage, a line in it is all its windows of ``WINDOW`` words (shorter lines
take words from their neighbours), and an earlier message holds the line if its
unquoted text, lines joined, has all these windows; a passage of fewer words must
be a whole paragraph there. Among quoted lines of the lowest level that has a
match, the message that holds most of them is the parent (ties: the one that
holds more as whole lines, then the latest). Only quoted lines are joined, and
their originals are first reduced to (message, hash) that some quote asks for;
words are read only in conversations that have quotes.

The reply order is the path of turns from the thread's first message: sorting
by it lists a message before its replies and replies in turn order. Paths grow
by doubling: each pass joins a message's known ancestors with those of the
oldest one, so long chains take few passes.

Defined results: null text has no lines; a message whose quotes match nothing
starts a thread; messages with a null conversation or turn are threads of their
own; rows that repeat (conversation, turn) are one message for links and each
keep their own text; blank quoted lines are no quotation; an empty table gives
an empty result; other columns are carried untouched whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowmill.llm.common import ship_package, written

MARK = re.compile(r"^\s*((?:>\s?)+)")
SPACE = re.compile(r"\s+")
WINDOW = 5                       # words


def quote_levels(text: str | None) -> list[tuple[int, str]]:
    """(level, text without markers) of each line."""
    out = []
    for line in (text or "").split("\n") if text else []:
        m = MARK.match(line)
        out.append((m[1].count(">") if m else 0, line[m.end():] if m else line))
    return out


def normal(line: str) -> str:
    return SPACE.sub(" ", line).strip().lower()


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def line_hash(line: str) -> int | None:
    line = normal(line)
    return _hash(line) if line else None


def runs(lines: list[tuple[int, str]]) -> list[tuple[int, list[list[str]]]]:
    """(level, words of each line) of every run of lines of one level; blank lines end a run."""
    out, before = [], None
    for level, line in lines:
        line = normal(line)
        if line and level == before:
            out[-1][1].append(line.split(" "))
        elif line:
            out.append((level, [line.split(" ")]))
        before = level if line else None
    return out


def _windows(words: list[str]) -> set[int]:
    return {_hash("w\n" + " ".join(words[k:k + WINDOW])) for k in range(len(words) - WINDOW + 1)}


def _paragraph(words: list[str]) -> int:
    return _hash("p\n" + " ".join(words))


def asked_words(lines: list[tuple[int, str]]) -> dict[tuple[int, int], set[int]]:
    """What a message must hold for each quoted (level, line hash)."""
    out: dict[tuple[int, int], set[int]] = {}
    for level, run in runs(lines):
        if not level:
            continue
        words, b = [w for line in run for w in line], 0
        for line in run:
            a, b = b, b + len(line)
            first = min(a, max(b - WINDOW, 0))
            key = _windows(words[first:max(b, first + WINDOW)]) if len(words) >= WINDOW else {_paragraph(words)}
            out.setdefault((level, _hash(" ".join(line))), key)
    return out


def held_words(lines: list[tuple[int, str]]) -> set[int]:
    """What a message holds: windows of its unquoted text, and its short paragraphs."""
    own = [[w for line in run for w in line] for level, run in runs(lines) if not level]
    return _windows([w for p in own for w in p]) | {_paragraph(p) for p in own if len(p) < WINDOW}


def _parse(batches):
    for batch in batches:
        own, plain, quoted, levels, words, deep = [], [], [], [], [], []
        for text in batch.column("text").to_pylist():
            lines = quote_levels(text)
            own.append("\n".join(x for k, x in lines if not k).strip("\n") if text is not None else None)
            plain.append(sorted({h for k, x in lines if not k and (h := line_hash(x)) is not None}))
            marked = {(k, h) for k, x in lines if k and (h := line_hash(x)) is not None}
            quoted.append([h for _, h in sorted(marked)])
            levels.append([k for k, _ in sorted(marked)])
            need = asked_words(lines) if marked else {}
            words.append([sorted(need[x]) for x in sorted(marked)])
            deep.append(max((k for k, _ in marked), default=0))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("turn"), batch.column("row"), pa.array(own, pa.string()),
             pa.array(plain, pa.list_(pa.int64())), pa.array(quoted, pa.list_(pa.int64())),
             pa.array(levels, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.list_(pa.int64()))),
             pa.array(deep, pa.int32())],
            names=["conv", "turn", "row", "own_text", "plain", "quoted", "levels", "words", "quote_depth"])


def _held(batches):
    for batch in batches:
        held = [sorted(held_words(quote_levels(text))) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turn"), pa.array(held, pa.list_(pa.int64()))],
                                         names=["conv", "origin", "held"])


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                text_col: str = "text") -> DataFrame:
    """``(conv, turn, row, own_text, quote_depth, parent_turn, path)``; ``row`` has the other columns."""
    ship_package(messages.sparkSession)
    others = [F.col(f"`{c}`") for c in messages.columns if c != text_col]
    m = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.struct(*others).alias("row"), F.col(text_col).cast("string").alias("text"))
    parsed = m.select("conv", "turn", "row", "text").mapInArrow(
        _parse, StructType([*m.schema.fields[:3], *StructType.fromDDL(
            "own_text string, plain array<bigint>, quoted array<bigint>, levels array<int>, words array<array<bigint>>, "
            "quote_depth int").fields]))
    asked = (parsed.where("quote_depth > 0 and conv is not null and turn is not null")
             .select("conv", "turn", F.explode(F.arrays_zip("quoted", "levels", "words")).alias("q"))
             .groupBy("conv", "turn", F.col("q.quoted").alias("h"), F.col("q.levels").alias("level"))
             .agg(F.min("q.words").alias("words")))
    asked = written(asked, "quoted-lines")
    held = (parsed.where("conv is not null and turn is not null").select("conv", "turn", F.explode("plain").alias("h"))
            .join(asked.select("conv", "h").distinct(), ["conv", "h"], "left_semi").distinct()
            .withColumnRenamed("turn", "origin"))
    found = (asked.join(held, ["conv", "h"]).where("origin < turn")
             .select("conv", "turn", "level", "h", "origin", F.lit(1).alias("whole")))
    if not asked.isEmpty():
        found = found.union(_by_words(m, asked).withColumn("whole", F.lit(0)))
    votes = (found.groupBy("conv", "turn", "level", "h", "origin").agg(F.max("whole").alias("whole"))
             .groupBy("conv", "turn", "level", "origin").agg(F.count("*").alias("count"), F.sum("whole").alias("whole")))
    parents = written(votes.groupBy("conv", "turn").agg(
        F.min_by("origin", F.struct("level", -F.col("count"), -F.col("whole"), -F.col("origin"))).alias("parent_turn")),
        "parents")
    paths = _paths(parents)
    return (parsed.join(parents, ["conv", "turn"], "left").join(paths, ["conv", "turn"], "left")
            .select("conv", "turn", "row", "own_text", "quote_depth", "parent_turn",
                    F.coalesce("path", F.array("turn")).alias("path")))


def _by_words(m: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv, turn, level, h, origin): earlier messages that have all words asked for by a quoted line."""
    need = asked.select("conv", "turn", "level", "h", F.size("words").alias("n"), F.explode("words").alias("w"))
    held = (m.where("conv is not null and turn is not null").select("conv", "turn", "text")
            .join(asked.select("conv").distinct(), "conv", "left_semi")
            .mapInArrow(_held, "conv long, origin long, held array<bigint>")
            .select("conv", "origin", F.explode("held").alias("w"))
            .join(need.select("conv", "w").distinct(), ["conv", "w"], "left_semi").distinct())
    return (need.join(held, ["conv", "w"]).where("origin < turn")
            .groupBy("conv", "turn", "level", "h", "origin", "n").count().where("count = n")
            .select("conv", "turn", "level", "h", "origin"))


def _paths(parents: DataFrame) -> DataFrame:
    """(conv, turn, path): turns from the first message of the thread to the message."""
    known = written(parents.select("conv", "turn", F.array("parent_turn", "turn").alias("path")), "paths")
    while True:
        up = known.select("conv", F.col("turn").alias("top"), F.col("path").alias("above"))
        grown = written(known.withColumn("top", F.element_at("path", 1)).join(up, ["conv", "top"], "left")
                        .select("conv", "turn", F.when(F.col("above").isNull(), F.col("path"))
                                .otherwise(F.concat("above", F.slice("path", F.lit(2), F.size("path")))).alias("path"),
                                F.col("above").isNotNull().alias("more")), "paths")
        known = grown.select("conv", "turn", "path")
        if grown.where("more").isEmpty():
            return known
