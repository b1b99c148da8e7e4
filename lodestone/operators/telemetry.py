"""Usage, jobs and cost analytics over append-only logs; one aggregation pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# List prices in US dollars for a million tokens (input, output, cached input).
PRICES = (
    ("text-embedding-3-small", 0.02, None, None), ("text-embedding-3-large", 0.13, None, None), ("text-embedding-ada-002", 0.10, None, None),
    ("gpt-5.5", 5.00, 30.00, 0.50), ("gpt-5.4", 2.50, 15.00, 0.25), ("gpt-5.4-mini", 0.75, 4.50, 0.075), ("gpt-5.4-nano", 0.20, 1.25, 0.02),
    ("gpt-4o", 2.50, 10.00, 1.25), ("gpt-4o-mini", 0.15, 0.60, 0.075), ("gpt-4o-2024-08-06", 2.50, 10.00, 1.25), ("gpt-4-turbo", 10.00, 30.00, None),
    ("gpt-4", 30.00, 60.00, None), ("gpt-3.5-turbo", 0.50, 1.50, None), ("o1", 15.00, 60.00, 7.50), ("o1-mini", 3.00, 12.00, 1.50), ("o3-mini", 1.10, 4.40, 0.55),
)


def log_filters(logs: DataFrame, user=None, tool=None, status=None, empty_only=False, text=None, since=None, until=None) -> DataFrame:
    out = logs
    for column, value in (("user_id", user), ("tool", tool), ("status", status)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if empty_only:
        out = out.where("result_count = 0")
    if text:
        out = out.where(F.lower("query_text").contains(text.lower()))
    if since is not None:
        out = out.where(F.col("created_at") >= since)
    if until is not None:
        out = out.where(F.col("created_at") <= until)
    return out


def nearest_rank_by(rows: DataFrame, keys: list[str], value: str, percents: tuple[float, ...]) -> DataFrame:
    """Nearest-rank percentiles, the index rounded half to even, for groups of any size: values are counted first,
    then ranked by running counts, so a group meets as its distinct values only."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys)
    running = counted.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("total", F.sum("n").over(w))
    at = lambda p: F.rint(F.lit(p / 100) * (F.col("total") - 1))
    return running.groupBy(*keys).agg(*(F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(f"p{p:g}") for p in percents))


def window_stats(logs: DataFrame, *keys: str) -> DataFrame:
    """Counts, failures and costs in one pass."""
    return logs.groupBy(*keys).agg(
        F.count("*").alias("queries"), F.count_if(F.col("result_count") == 0).alias("empty"), F.count_if(F.col("status") == "error").alias("errors"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost_micros"), F.lit(0)).alias("cost_micros"), F.count("cost_micros").alias("rows_with_cost"),
    )


def top_values(logs: DataFrame, column: str, k: int) -> DataFrame:
    return logs.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def per_user(users: DataFrame, usage: DataFrame, id: str) -> DataFrame:
    """Every user with their usage, silent ones with zeros, and usage of users that are gone."""
    counts = [c for c in usage.columns if c != id]
    known = users.join(usage, id, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumn("known", F.lit(True))
    gone = usage.join(users.select(id), id, "left_anti").withColumn("known", F.lit(False))
    return known.unionByName(gone, allowMissingColumns=True)


def buckets(logs: DataFrame, at: str, unit: str, since, until, aggregates: list[Column]) -> DataFrame:
    """Tumbling buckets of an hour or a day from since to until, empty ones with zeros. A row in no bucket
    (at ``until`` on a bucket's edge) is dropped."""
    spark = logs.sparkSession
    step = {"hour": "interval 1 hour", "day": "interval 1 day"}[unit]
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_trunc(unit, F.lit(since).cast("timestamp")), F.expr(f"date_trunc('{unit}', timestamp'{until}' - interval 1 second)"), F.expr(step))).alias("bucket"))
    counted = logs.where(F.col(at).between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp"))).groupBy(F.date_trunc(unit, at).alias("bucket")).agg(*aggregates)
    return calendar.join(counted, "bucket", "left").fillna(0)


def cost(usage: DataFrame, model: str = "model", tokens_in: str = "tokens_in", tokens_out: str = "tokens_out", cached: str = "tokens_cached") -> DataFrame:
    """usage with cost_micros: micro-dollars rounded up, cached tokens a clamped part of the input;
    null for unknown models or without tokens."""
    prices = F.broadcast(usage.sparkSession.createDataFrame(list(PRICES), "price_model string, price_in double, price_out double, price_cached double"))
    known = usage.join(prices, F.lower(model) == F.col("price_model"), "left")
    of_input = F.greatest(F.coalesce(tokens_in, F.lit(0)), F.lit(0))
    hit = F.when(F.col("price_cached").isNotNull(), F.least(F.greatest(F.coalesce(cached, F.lit(0)), F.lit(0)), of_input)).otherwise(0)
    out = F.greatest(F.coalesce(tokens_out, F.lit(0)), F.lit(0))
    # A dollar for a million tokens is a micro-dollar for each.
    micros = (of_input - hit) * F.col("price_in") + hit * F.coalesce("price_cached", F.lit(0.0)) + out * F.coalesce("price_out", F.lit(0.0))
    value = F.when((of_input + out > 0) & F.col("price_in").isNotNull(), F.ceil(F.round(micros, 9)))
    return known.withColumn("cost_micros", value.cast("long")).drop("price_model", "price_in", "price_out", "price_cached")


def cost_rollup(costed: DataFrame, stage: str, model: str, tokens: str) -> DataFrame:
    """Cost and the model of most tokens for each stage; equal ones: the first name."""
    per = costed.groupBy(stage, model).agg(F.sum(tokens).alias("t"), F.sum("cost_micros").alias("c"))
    return per.groupBy(stage).agg(F.sum("t").alias("tokens"), F.sum("c").alias("cost_micros"), F.min(F.struct(-F.col("t"), F.col(model).alias("m")))["m"].alias("dominant_model"))


def status_counts(jobs: DataFrame, batch: str, status: str, values: tuple[str, ...], done: tuple[str, ...]) -> DataFrame:
    """A column for each status, and whether every job is done."""
    counts = [F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values]
    return jobs.groupBy(batch).agg(*counts, F.count("*").alias("n"), F.every(F.col(status).isin(*done)).alias("complete"))
