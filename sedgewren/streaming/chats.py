"""Chats as a stream: every question with the turns before it, from state kept for each chat."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sedgewren.operators.answering import HISTORY_TURNS, trimmed_history

ASKED = "chat_id string, at timestamp, question string, history array<struct<role:string,content:string>>"
#: Bytes of turns that a task puts in order, about, and bytes of a turn besides its text.
SHARE, TURN = 16 << 20, 100


def is_question(role: Column, text: Column) -> Column:
    """What a channel answers: a user's message that is neither empty nor a command."""
    said = F.trim(F.coalesce(text, F.lit("")))
    return (role == "user") & (said != "") & ~said.startswith("/")


def questions(stream: DataFrame, lateness: str = "10 minutes", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """chat_id, at, question, history: each question of a stream of turns (chat_id, at, role, text), with the trimmed turns before it.

    Turns are put in the order of their time, whatever batch brings them, if they are late by ``lateness`` at most; later ones are left
    out. The state of a chat is its last turns before the watermark and those since; it is dropped ``idle_ms`` after the last turn. Turns of
    one time stand in the order of role and text. Commands and empty messages are no turns; null chats and times are left out.
    """
    said = F.trim(F.coalesce("text", F.lit("")))
    rows = stream.where("chat_id is not null and at is not null and role is not null").where((said != "") & ~said.startswith("/"))
    rows = rows.select(F.col("chat_id").cast("string").alias("chat_id"), F.col("at").cast("timestamp").alias("at"), "role", said.alias("text")).withWatermark("at", lateness)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark = state.getCurrentWatermarkMs()
        turns = [tuple(t) for t in json.loads(state.get[0])] if state.exists else []
        new = []
        for part in parts:
            ms = part["at"].dt.as_unit("us").astype("int64")
            new += [(t, r, x) for t, r, x in zip(ms.tolist(), part["role"], part["text"]) if t // 1000 >= mark]
        fresh, out = set(new), []
        turns = sorted([*turns, *new])
        for i, (t, role, text) in enumerate(turns):
            if role == "user" and (t, role, text) in fresh:
                past = turns[max(0, i - HISTORY_TURNS) : i]
                out.append((key[0], pd.Timestamp(t, unit="us"), text, [{"role": r, "content": x} for _, r, x in past]))
        if turns:
            settled = sum(t // 1000 < mark for t, _, _ in turns)
            state.update((json.dumps(turns[max(0, settled - HISTORY_TURNS) :]),))
            state.setTimeoutTimestamp(max(turns[-1][0] // 1000 + idle_ms, mark + 1))
        yield pd.DataFrame(out, columns=["chat_id", "at", "question", "history"])

    found = rows.groupBy("chat_id").applyInPandasWithState(step, ASKED, "turns string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("history", trimmed_history(F.col("history")))


def all_questions(turns: DataFrame) -> DataFrame:
    """What questions() gives for a table of all turns."""
    from pyspark.sql import Window

    said = F.trim(F.coalesce("text", F.lit("")))
    rows = turns.where("chat_id is not null and at is not null and role is not null").where((said != "") & ~said.startswith("/"))
    rows = rows.select(F.col("chat_id").cast("string").alias("chat_id"), F.col("at").cast("timestamp").alias("at"), "role", said.alias("text"))
    # partitions by the bytes of turns: shuffled text is compressed, so its bytes there do not tell what a task has to sort
    held = rows.agg(F.coalesce(F.sum(F.octet_length("text") + TURN), F.lit(0))).first()[0]
    rows = rows.repartition(max(turns.sparkSession.sparkContext.defaultParallelism, -(-held // SHARE)), "chat_id")
    before = Window.partitionBy("chat_id").orderBy("at", "role", "text").rowsBetween(-HISTORY_TURNS, -1)
    past = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(before)
    return rows.withColumn("history", trimmed_history(past)).where("role = 'user'").select("chat_id", "at", F.col("text").alias("question"), "history")
