"""Chat formatting in budgeted windows with a loss mask.

Prefix sums of turn tokens cut a conversation into turn-aligned windows. Every window
starts with the system turn and repeats a limited history of the window before it;
only new assistant turns are under the loss mask, so each is a target exactly once.

A turn becomes ``<s>role[INST]text[/INST]</s>``. These control strings inside roles and
texts are broken up by a backslash, and backslashes are doubled, so a formatted window
can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.session import ship_package

OPEN, MIDDLE, CLOSE = "<s>", "[INST]", "[/INST]</s>"
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


@dataclass(frozen=True)
class ChatParams:
    """``budget`` tokens a window, of which up to ``history`` repeat earlier turns.

    A turn counts ``overhead`` tokens and one for every four bytes of its text.
    ``chunk`` turn numbers are summed by one task.
    """

    budget: int = 1024
    history: int = 256
    overhead: int = 4
    chunk: int = 1024


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(<|\[)(/?(?:s>|INST\]))", r"$1\\$2")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def windows(turns: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """One row per window: conv_id, window, n_repeated, n_new, formatted, loss_spans.

    ``turns`` has conv_id, turn, role, text; turns go by number, ties by role and
    text, nulls first. A null text or role is empty, a null conv_id is one
    conversation. The first turn, if its role is system, leads every window.

    With stride s = (budget - history - system tokens) / 2 (at least budget / 8), a turn
    that begins after p tokens belongs to window p div s. New turns of at most s
    tokens thus never exceed the budget; a longer turn ends its window and may.
    History are the turns of the window before within ``history`` tokens of its end.
    loss_spans are (start, length) in code points of ``formatted``.

    Sums are made by ranges of turn numbers first, so a conversation with a third of
    all turns is spread over many tasks. Needs no Python.
    """
    p = params
    base = turns.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / p.chunk), F.lit(-(1 << 62))))
    first = base.groupBy("conv_id").agg(F.min(F.struct("chunk", "turn", "role", "text")).alias("head"))
    length = lambda c: F.ceil(F.octet_length(c) / 4).cast("long") + p.overhead
    heads = first.select(
        F.col("conv_id").alias("_conv"), F.col("head.chunk").alias("first_chunk"),
        F.when(F.col("head.role") == "system", F.col("head.text")).alias("system"),
    ).withColumn(
        "stride",
        F.greatest(
            F.floor((p.budget - p.history - F.coalesce(length("system"), F.lit(0))) / 2).cast("long"),
            F.lit(p.budget // 8).cast("long"),
        ),
    )
    order = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    counted = base.join(heads, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    counted = (
        counted.withColumn("nth", F.row_number().over(order))
        .withColumn("lead", (F.col("nth") == 1) & (F.col("chunk") == F.col("first_chunk")) & F.col("system").isNotNull())
        .withColumn("tokens", F.when(F.col("lead"), F.lit(0)).otherwise(length("text")))
        .withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # per range of turn numbers: what all earlier ranges hold
    sums = base.groupBy("conv_id", "chunk").agg(F.sum(length("text")).alias("t"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("before"),
    )
    # the lead turn counts nothing: its tokens are taken off every later range
    lead_tokens = F.when(F.col("system").isNotNull() & (F.col("chunk") != F.col("first_chunk")), length("system")).otherwise(0)
    placed = (
        counted.join(sums, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")))
        .withColumn("end", F.col("upto") + F.col("before") - lead_tokens)
        .withColumn("begin", F.when(F.col("lead"), F.lit(-1)).otherwise(F.col("end") - F.col("tokens")))
        .withColumn("window", F.when(F.col("lead"), F.lit(0)).otherwise(F.expr("begin div stride")))
    )
    edge = F.max("end").over(Window.partitionBy("conv_id", "window"))
    # the next turn begins where this window ends; the last window has no next one
    repeated = ~F.col("lead") & (F.col("edge") - F.col("begin") <= p.history) & (F.expr("edge div stride") > F.col("window"))
    copies = F.when(
        repeated,
        F.array(
            F.struct(F.col("window").alias("w"), F.lit(False).alias("again")),
            F.struct(F.expr("edge div stride").alias("w"), F.lit(True).alias("again")),
        ),
    ).otherwise(F.array(F.struct(F.col("window").alias("w"), F.lit(False).alias("again"))))
    each = placed.withColumn("edge", edge).select("conv_id", "begin", "role", "text", "system", F.inline(copies))
    gathered = (
        each.groupBy("conv_id", "w")
        .agg(F.array_sort(F.collect_list(F.struct("begin", "again", "role", "text"))).alias("turns"), F.max("system").alias("system"))
        .where(F.exists("turns", lambda t: ~t["again"]))
    )
    system = F.array(F.struct(
        F.lit(-1).cast("long").alias("begin"), F.lit(True).alias("again"), F.lit("system").alias("role"), F.col("system").alias("text"),
    ))
    whole = F.when(F.col("system").isNotNull() & (F.col("w") > 0), F.concat(system, "turns")).otherwise(F.col("turns"))
    lined = gathered.withColumn("turns", whole).withColumn(
        "pieces",
        F.transform("turns", lambda t: F.struct(
            F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"),
            escape(t["text"]).alias("body"),
            (~t["again"] & (t["role"] == "assistant")).alias("target"),
        )),
    )
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)).alias("at"),
            F.when(
                x["target"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    repeats = F.size(F.filter("turns", lambda t: t["again"]))
    return lined.select(
        "conv_id",
        F.col("w").alias("window"),
        repeats.alias("n_repeated"),
        (F.size("turns") - repeats).alias("n_new"),
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        spans["spans"].alias("loss_spans"),
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.

    Windows stream past in order and only the running digests are held, so memory
    does not grow with a conversation. One conversation's digest is a chain over its
    whole text and so is made by one task.
    """
    ship_package(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state = None

        def closed(done):
            rows = [(k, n, a.hexdigest(), c, b.hexdigest(), f) for k, n, a, c, b, f in done]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            done = []
            table = [batch.column(n).to_pylist() for n in ("conv_id", "n_repeated", "formatted", "loss_spans")]
            for conv, again, text, spans in zip(*table, strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text)[again:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    target = unescape(text[span["start"] : span["start"] + span["length"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
            if done:
                yield closed(done)
        if state is not None:
            yield closed([state])

    return (
        formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "window", "n_repeated", "formatted", "loss_spans")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "window")
        .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )
