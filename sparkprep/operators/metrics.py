"""Training-log metrics: schedules, windows, averages, early stopping, weighted losses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def learning_rate(step: Column, warmup: int, total: int, peak: float, floor: float) -> Column:
    """Linear warm-up, cosine to ``floor``, then ``floor``."""
    cosine = floor + 0.5 * (peak - floor) * (1 + F.cos(F.lit(math.pi) * (step - warmup) / max(total - warmup, 1)))
    return F.when(step < warmup, peak * step / max(warmup, 1)).when(step >= total, F.lit(floor)).otherwise(cosine)


def epoch_cap(n: Column, batch: Column, steps: Column, most: Column) -> Column:
    """Micro steps allowed: all of them, or as many as ``most`` epochs have."""
    per_epoch = F.greatest(F.lit(1), F.floor(n / batch))
    return F.when(steps / per_epoch > most, F.floor(per_epoch * most)).otherwise(steps).cast("bigint")


def log_windows(log: DataFrame, every: int = 50) -> DataFrame:
    """(window, n_steps, mean_loss, token_mean, tokens_per_s) over consecutive ``every`` steps of log(step, loss, tokens, dt).

    ``mean_loss`` averages steps, ``token_mean`` weights them by tokens. Null losses are left out of both.
    """
    key = F.floor((F.col("step") - 1) / every).alias("window")
    seen = F.when(F.col("loss").isNotNull(), F.col("tokens"))
    return log.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_steps"), F.round(F.avg("loss"), 6).alias("mean_loss"),
        F.round(F.sum(F.col("loss") * F.col("tokens")) / F.greatest(F.coalesce(F.sum(seen), F.lit(0)), F.lit(1)), 6).alias("token_mean"),
        F.round(F.try_divide(F.sum("tokens"), F.sum("dt")), 6).alias("tokens_per_s"),
    )


def macro_mean(rows: DataFrame, batch: str, value: str) -> DataFrame:
    """(n_batches, macro, micro): the mean of the batches' means, and of all values; null means of empty batches are left out."""
    per = rows.groupBy(batch).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("c"))
    return per.agg(F.count(F.lit(1)).alias("n_batches"), F.round(F.avg("m"), 6).alias("macro"), F.round(F.try_divide(F.sum("s"), F.sum("c")), 6).alias("micro"))


def early_stopping(evaluations: DataFrame, group: str, patience: int, min_delta: float) -> DataFrame:
    """(group, n_seen, best, stop_at): fold over evaluations(group, step, metric) in step order.

    The best value moves only by more than ``min_delta``; after ``patience`` evaluations in a row without that the run stops
    (0: never), and later ones do not count. Null and NaN metrics are no evaluations. One run's evaluations are a short list.
    """
    ordered = F.array_sort(F.collect_list(F.struct("step", "metric")))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(0).alias("seen"), F.lit(None).cast("bigint").alias("stop"))

    def step(s: Column, x: Column) -> Column:
        better, live = x["metric"] < s["best"] - min_delta, s["stop"].isNull()
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        return F.struct(
            F.when(live & better, x["metric"]).otherwise(s["best"]).alias("best"), F.when(live, bad).otherwise(s["bad"]).alias("bad"),
            F.when(live, s["seen"] + 1).otherwise(s["seen"]).alias("seen"),
            F.when(live & (F.lit(patience) > 0) & (bad >= patience), x["step"].cast("bigint")).otherwise(s["stop"]).alias("stop"),
        )

    known = evaluations.where(F.col("metric").isNotNull() & ~F.isnan("metric"))
    out = known.groupBy(group).agg(F.aggregate(ordered, start, step).alias("s"))
    return out.select(group, F.col("s.seen").cast("bigint").alias("n_seen"), F.round("s.best", 6).alias("best"), F.col("s.stop").alias("stop_at"))


def weighted_loss(loss: Column, weight: Column) -> Column:
    return F.sum(loss * weight) / F.greatest(F.sum(weight), F.lit(1e-8))


def split_eval(rows: DataFrame, batch: str, loss: str, answer: str, most: int | None = None) -> DataFrame:
    """(n_batches, loss, think_loss, answer_loss): means of the batches' means, over all tokens and over either kind.

    ``answer`` is 1 for tokens of answers, 0 for reasoning. Batches without tokens of a kind do not count for it; without any the
    mean is NaN. ``loss`` is 0 without batches. Only the first ``most`` batches (by number) count.
    """
    x, own = F.col(loss), F.col(answer)
    kept = rows if most is None else rows.where(F.col(batch) < most)
    per = kept.groupBy(batch).agg(F.avg(x).alias("m"), F.avg(F.when(own == 0, x)).alias("t"), F.avg(F.when(own == 1, x)).alias("a"))
    nan = F.lit(float("nan"))
    return per.agg(
        F.count(F.lit(1)).alias("n_batches"), F.round(F.coalesce(F.avg("m"), F.lit(0.0)), 6).alias("loss"),
        F.round(F.coalesce(F.avg("t"), nan), 6).alias("think_loss"), F.round(F.coalesce(F.avg("a"), nan), 6).alias("answer_loss"),
    )


def split_log_windows(rows: DataFrame, step: str, loss: str, tokens: str, answer: str, every: int = 50) -> DataFrame:
    """(window, loss, think_loss, answer_loss) of a log: the mean over steps, and means weighted by tokens of either kind (0 without)."""
    x, n, own = F.col(loss), F.col(tokens), F.col(answer)

    def weighted(kind: int) -> Column:
        return F.round(F.coalesce(F.sum(F.when(own == kind, x * n)), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(F.when((own == kind) & x.isNotNull(), n)), F.lit(0)), F.lit(1)), 6)

    key = F.floor((F.col(step) - 1) / every).alias("window")
    return rows.groupBy(key).agg(F.round(F.avg(x), 6).alias("loss"), weighted(0).alias("think_loss"), weighted(1).alias("answer_loss"))
