"""History of circuit breakers from a log of calls: failures in a row, openings, and what each call met.

A breaker's state after a call follows from what came since the last success: failures are counted, and the last one
that was the ``limit``-th or a later one, or a rate limit, opened it. Days of a provider are summed up on their own and what a day begins with is carried over
from the days before, so a provider with very many calls is as many tasks as it has days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history(calls: DataFrame, limit: int = 3, cool_down: int = 300) -> DataFrame:
    """calls (provider, at, seq, outcome) with met, failures and opened_at.

    outcome: success, failure or rate-limited; seq orders calls of one instant. met is the state that a call found: closed,
    open, or half-open once ``cool_down`` seconds have passed since it opened. failures and opened_at are as the call left them.
    """
    given = calls.withColumn("_day", F.to_date("at")).withColumn("_bad", F.col("outcome") != "success")
    day = Window.partitionBy("provider", "_day").orderBy("at", "seq")
    upto = day.rowsBetween(Window.unboundedPreceding, 0)
    given = given.withColumn("_run", F.count_if(~F.col("_bad")).over(upto))  # successes of the day so far
    run = Window.partitionBy("provider", "_day", "_run").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    given = given.withColumn("_own", F.count_if(F.col("_bad")).over(run))

    # what each day hands on: failures after its last success, and whether there was one
    days = given.groupBy("provider", "_day").agg(F.max("_run").alias("_ok"), F.max(F.struct("_run", "_own"))["_own"].alias("_rest"))
    past = Window.partitionBy("provider").orderBy("_day")  # a row a day
    days = days.withColumn("_island", F.count_if(F.col("_ok") > 0).over(past))
    held = Window.partitionBy("provider", "_before").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    # a day's carry is the sum of the rests since the last day with a success, that day's included
    lagged = days.select(
        "provider", "_day", F.lag("_island", 1, 0).over(past).alias("_before"), F.lag("_rest", 1, 0).over(past).alias("_came"),
    )
    carry = lagged.withColumn("_carry", F.sum("_came").over(held)).drop("_came")
    given = given.join(carry, ["provider", "_day"])
    failures = F.col("_own") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(0)
    opens = F.col("_bad") & ((F.col("outcome") == "rate-limited") | (failures >= limit))
    given = given.withColumn("failures", F.when(F.col("_bad"), failures).otherwise(0)).withColumn("_opens", F.when(opens, F.col("at")))
    given = given.withColumn("_open_own", F.max("_opens").over(run))

    # the same for the instant of opening
    last = given.groupBy("provider", "_day").agg(F.max(F.struct("_run", "_own", "at", "seq", "_open_own"))["_open_own"].alias("_left"), F.max("_before").alias("_before"))
    came = last.select("provider", "_day", "_before", F.lag("_left").over(past).alias("_came"))
    came = came.select("provider", "_day", F.max("_came").over(held).alias("_open_came"))
    given = given.join(came, ["provider", "_day"])
    left = F.coalesce("_open_own", F.when(F.col("_run") == 0, F.col("_open_came")))
    given = given.withColumn("opened_at", F.when(F.col("_bad"), left))
    before = F.coalesce(F.lag("opened_at").over(day), F.when(F.row_number().over(day) == 1, F.col("_open_came")))
    waited = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    met = F.when(before.isNull(), "closed").when(waited >= cool_down * 1_000_000, "half-open").otherwise("open")
    return given.withColumn("met", met).select(*calls.columns, "met", "failures", "opened_at")
