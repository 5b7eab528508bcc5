"""Polls: scoring of answers, percentages, leaderboard, latest answers, client names.

``answers``: question, client, value (array of strings), time; ``clients``: client, name, time, score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.numbers import half_up


def points(answers: DataFrame, correct: Column, system: str = "incremental", most: int | None = None, start: Column | None = None, limit_s: float = 30) -> DataFrame:
    """question, client, points of the correct answers; an answer of a client to a question counts once, the first.

    incremental: ``most`` each; falloff: one less for each earlier correct answer, 1 at least; speed: in proportion to
    the time left of ``limit_s`` seconds since ``start`` or the question's first answer (times are milliseconds)."""
    most = most if most is not None else {"incremental": 1, "falloff": 10, "speed": 100}[system]
    if system == "speed":
        first = answers.where(F.col("time") > 0).groupBy("question").agg(F.min("time").alias("__first"))
        answers = answers.join(first, "question", "left")
    right = answers.where(correct)
    one = right.groupBy("question", "client").agg(F.min("time").alias("time"), *([F.min("__first").alias("__first")] if system == "speed" else []))
    if system == "incremental":
        return one.select("question", "client", F.lit(most).cast("long").alias("points"))
    if system == "falloff":
        place = F.row_number().over(Window.partitionBy("question").orderBy("time", "client")) - 1
        return one.select("question", "client", F.greatest(F.lit(1), most - place).cast("long").alias("points"))
    began = F.coalesce(start, F.col("__first")) if start is not None else F.col("__first")
    share = F.least(F.greatest(F.greatest(F.col("time") - began, F.lit(0)) / 1000 / limit_s, F.lit(0.0)), F.lit(1.0))
    return one.select("question", "client", F.coalesce(half_up(most * (1 - share)), F.lit(most)).cast("long").alias("points"))


def percentages(answers: DataFrame, options: DataFrame) -> DataFrame:
    """question, option, percent of answers that chose it; options that nobody chose have 0. ``options``: question, option."""
    total = answers.groupBy("question").agg(F.count("*").alias("n"))
    chosen = answers.select("question", F.explode(F.array_distinct("value")).alias("option")).groupBy("question", "option").agg(F.count("*").alias("k"))
    joined = options.join(chosen, ["question", "option"], "left").join(total, "question", "left")
    return joined.select("question", "option", F.coalesce(half_up(F.try_divide("k", "n") * 100), F.lit(0)).cast("long").alias("percent"))


def leaderboard(clients: DataFrame, scored: DataFrame) -> DataFrame:
    """client, name, score: old score plus points, zeros included."""
    total = scored.groupBy("client").agg(F.sum("points").alias("points"))
    return clients.join(total, "client", "left").select("client", F.coalesce("name", F.lit("")).alias("name"), (F.coalesce("score", F.lit(0)) + F.coalesce("points", F.lit(0))).alias("score"))


def latest(answers: DataFrame) -> DataFrame:
    """The last value of the latest answer to each question."""
    return answers.groupBy("question").agg(F.max_by(F.element_at("value", -1), F.struct("time", "client")).alias("latest"))


def client_names(clients: DataFrame, poll: str = "poll") -> DataFrame:
    """Clients without a name are User #n, in the order of joining."""
    n = F.row_number().over(Window.partitionBy(poll).orderBy("time", "client"))
    return clients.withColumn("name", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("User #"), n.cast("string"))))
