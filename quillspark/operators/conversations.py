"""Message operators: last turns, answers and session memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def last_user_turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn, text of the last user message of each conversation."""
    last = F.max_by(F.struct("turn", "text"), "turn")
    return messages.where("role = 'user'").groupBy("conv_id").agg(last.alias("m")).select("conv_id", "m.turn", "m.text")


def answers_after_last_user(messages: DataFrame) -> DataFrame:
    """conv_id, answer: the last assistant message after the last user message; null where there is none. One
    aggregate: the last of each role is enough."""
    of = lambda role: F.max_by(F.when(F.col("role") == role, F.struct("turn", "text")), F.when(F.col("role") == role, F.col("turn")))
    d = messages.groupBy("conv_id").agg(of("user").alias("u"), of("assistant").alias("a"))
    return d.where("u is not null").select("conv_id", F.when(F.col("a.turn") > F.col("u.turn"), F.col("a.text")).alias("answer"))


def session_memory(messages: DataFrame, last: int = 8, most: int = 1200) -> DataFrame:
    """The last messages of each conversation without blank ones; long assistant texts are cut."""
    text = F.when((F.col("role") == "assistant") & (F.length("text") > most), F.concat(F.left("text", F.lit(most)), F.lit("…"))).otherwise(F.col("text"))
    d = messages.where(~T.blank(F.col("text"))).select("conv_id", "turn", "role", text.alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last).drop("_n")
