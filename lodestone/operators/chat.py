"""Conversations: recent messages before each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 4
CLEAR = "clear"
# The texts of a history.
HISTORY_HEAD, ASKED, ANSWERED = "이전 대화:", "질문", "답변"


def segments(messages: DataFrame, clear: str = CLEAR) -> DataFrame:
    """User and assistant messages (conv_id, turn, role, text) with the number of `clear` messages
    before them; these themselves are left out."""
    said = messages.where(F.col("role").isin("user", "assistant"))
    is_clear = (F.col("role") == "user") & (F.lower(F.trim(F.col("text"))) == clear)
    before = F.sum(F.when(is_clear, 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn"))
    return said.withColumn("segment", before).where(~F.coalesce(is_clear, F.lit(False)))


def histories(messages: DataFrame, last: int = HISTORY, clear: str = CLEAR) -> DataFrame:
    """(conv_id, turn, question, history) of every question of a user: the `last` messages before it
    since the history was cleared, as text; '' for none."""
    by = Window.partitionBy("conv_id", "segment").orderBy("turn").rowsBetween(-last, -1)
    told = F.collect_list(F.struct("role", "text")).over(by)
    lines = F.array_join(F.transform("told", lambda m: F.concat(F.when(m["role"] == "user", ASKED).otherwise(ANSWERED), F.lit(": "), F.coalesce(m["text"], F.lit("")))), "\n")
    return segments(messages, clear).withColumn("told", told).where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), lines.alias("history"))


def with_history(prompts: DataFrame, told: DataFrame) -> DataFrame:
    """(query_id, prompt) with the history (query_id, history) before it, where there is one."""
    head = F.concat(F.lit(f"{HISTORY_HEAD}\n"), F.col("history"), F.lit("\n\n"))
    return prompts.join(told.select("query_id", "history"), "query_id").select("query_id", F.concat(F.when(F.length("history") > 0, head).otherwise(""), F.col("prompt")).alias("prompt"))
