"""Splits, samples, training metrics, trends, and the places where models are plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship


def split(rows: DataFrame, batch: list[str], order: list[str], share: float = 0.85) -> DataFrame:
    """``part`` of each row of a batch: train for the first ``floor(share * n)`` in order, then eval."""
    own = Window.partitionBy(*batch)
    place = F.row_number().over(own.orderBy(*order)) - 1
    return rows.withColumn("part", F.when(place < F.floor(F.count("*").over(own) * share), "train").otherwise("eval"))


def sample(rows: DataFrame, batch: list[str], key: str, most: int = 15) -> DataFrame:
    """At most ``most`` rows of each batch, by the hash of their key; the same at each run."""
    order = Window.partitionBy(*batch).orderBy(F.md5(F.col(key)), key)
    return rows.withColumn("sample_rank", F.row_number().over(order)).where(F.col("sample_rank") <= most)


def training_metrics(log: DataFrame, batch: str = "batch") -> DataFrame:
    """Losses, epochs and steps of each batch's log (step, epoch, train_loss, eval_loss); tokens are the usual estimate of 1000 a row."""
    has = F.col("eval_loss").isNotNull()
    epoch = F.coalesce("epoch", F.lit(1.0))
    r = log.groupBy(batch).agg(
        F.max_by("train_loss", F.when(F.col("train_loss").isNotNull(), F.col("step"))).alias("final_train_loss"),
        F.min_by("eval_loss", F.when(has, F.col("step"))).alias("initial_eval_loss"),
        F.max_by("eval_loss", F.when(has, F.col("step"))).alias("final_eval_loss"),
        F.min("eval_loss").alias("best_eval_loss"),
        F.min_by(epoch, F.when(has, F.struct("eval_loss", "step"))).alias("best_epoch"),
        F.count_distinct(epoch).alias("epochs"),
        F.count("*").alias("steps"),
    )
    return r.select(batch, "final_train_loss", "initial_eval_loss", "final_eval_loss", "best_eval_loss", F.round(F.col("initial_eval_loss") - F.col("best_eval_loss"), 6).alias("loss_improvement"), "best_epoch", "epochs", (F.col("best_epoch") < F.col("epochs")).alias("early_stopped"), "steps", (F.col("steps") * 1000).alias("estimated_tokens"))


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    return tokens / F.greatest(seconds, F.lit(1.0))


def spread(series: DataFrame, by: list[str], value: str) -> DataFrame:
    """min, max, mean, population deviation and its percentage of the mean."""
    r = series.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return r.withColumn("cv_percent", F.when(F.col("mean") != 0, 100 * F.col("sd") / F.col("mean")).otherwise(0.0))


def trends(series: DataFrame, by: list[str], order: str, value: str, flat: float = 0.001) -> DataFrame:
    """The slope of the least-squares line over 0, 1, 2 … in order, and its direction."""
    placed = series.withColumn("x", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    r = placed.groupBy(*by).agg(F.regr_slope(F.col(value), F.col("x")).alias("slope"), F.count("*").alias("points"))
    return r.withColumn("trend", F.when(F.col("slope") > flat, "up").when(F.col("slope") < -flat, "down").otherwise("stable"))


def against_baseline(series: DataFrame, by: list[str], first: Column, value: str, seconds: str) -> DataFrame:
    """Averages with and without the first batch, their difference, and the time all others took."""
    rest = F.avg(F.when(~first, F.col(value)))
    return series.groupBy(*by).agg(F.avg(value).alias("with_first"), rest.alias("without_first"), (rest - F.avg(value)).alias("difference"), F.sum(F.when(~first, F.col(seconds)).otherwise(0.0)).alias("rest_time"))


def quality_score(bleu: Column, rouge: Column, comet: Column, improvement: Column) -> Column:
    """0 to 100: at most 40, 25, 25 and 10 points, cut to a whole number."""
    points = F.least(bleu * 100, F.lit(40.0)) + F.least(rouge * 100, F.lit(25.0)) + F.least(comet * 100, F.lit(25.0)) + F.least(improvement * 50, F.lit(10.0))
    return F.least(F.round(points, 9).cast("int"), F.lit(100))


def best_batch(metrics: DataFrame, batch: str = "batch") -> DataFrame:
    """The batch of the best COMET score, or of the best ROUGE where there is none."""
    value = F.when(F.col("comet_score") > 0, F.col("comet_score")).otherwise(F.col("rouge_score"))
    return metrics.agg(F.max_by(F.struct(F.col(batch).alias("batch"), value.alias("value")), F.struct(value, -F.col(batch))).alias("b")).select("b.batch", "b.value")


def tuning_averages(metrics: DataFrame) -> DataFrame:
    means = [F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("bleu_score", "rouge_score", "meteor_score", "loss_improvement")]
    return metrics.agg(F.count("*").alias("batches"), *means, F.round(F.avg(F.when(F.col("comet_score") > 0, F.col("comet_score"))), 6).alias("avg_comet_score"), F.sum("training_time").alias("total_time"), F.max("rouge_score").alias("peak_rouge"))


def keep_newest(rows: DataFrame, owner: str, name: str, count: int = 2) -> DataFrame:
    """``keep`` for the ``count`` last names of each owner in descending order.

    The names to keep are found first, cut to ``count`` before they are shuffled, so an owner of many rows isn't one task.
    """
    order = Window.partitionBy(owner).orderBy(F.desc(name))
    newest = rows.select(owner, name).withColumn("r", F.row_number().over(order)).where(F.col("r") <= count).select(owner, name, F.lit(True).alias("newest"))
    return rows.join(newest, [owner, name], "left").withColumn("keep", F.coalesce("newest", F.lit(False))).drop("newest")


def expired(rows: DataFrame, at: str, now: Column, days: int = 7) -> DataFrame:
    return rows.where(F.col(at) < now - F.expr(f"INTERVAL {days} DAYS"))


def over_limit(rows: DataFrame, owner: str, size: str, most: float) -> DataFrame:
    """Owners whose files take more than ``most`` in all, with their total: what the cache rule clears."""
    return rows.groupBy(owner).agg(F.sum(size).alias("total")).where(F.col("total") > most)


def gloss(verses: DataFrame, keys: list[str], text: str, best: DataFrame) -> DataFrame:
    """A word-by-word translation by each term's best target; words without one stay, and a verse without words is empty."""
    from .tokens import tokens

    rows = tokens(verses, keys, text).join(best.withColumnRenamed("source_term", "term"), "term", "left")
    glossed = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("best_target", "term").alias("w")))), lambda x: x.w), " ").alias("translation"))
    return verses.select(*keys).join(glossed, keys, "left").select(*keys, F.coalesce("translation", F.lit("")).alias("translation"))


def plugged(rows: DataFrame, keys: list[str], inputs: list[str], model: Callable[..., list], name: str, kind: str) -> DataFrame:
    """``name`` for each row by a model that the caller gives: it gets a list for each input column and returns one."""
    ship(rows.sparkSession)
    given = rows.select(*keys, *inputs)
    schema = rows.select(*keys).schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model(*(c.to_pylist() for c in batch.columns[len(keys) :])) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(got, {"string": pa.string(), "double": pa.float64()}[kind])], names=[*keys, name])

    return given.mapInArrow(run, schema)


def translated(verses: DataFrame, keys: list[str], text: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Translations by a plugged-in model, which gets the texts that aren't null or empty; the others' are empty."""

    def run(texts: list[str | None]) -> list[str]:
        own = [i for i, t in enumerate(texts) if t]
        got = dict(zip(own, model([texts[i] for i in own]) if own else [], strict=True))
        return [got.get(i, "") for i in range(len(texts))]

    return plugged(verses, keys, [text], run, "translation", "string")


def lines(series: DataFrame, by: str, order: str, value: str, step: int = 10, height: int = 100) -> DataFrame:
    """A drawing of each metric's values in order, as an SVG line from its least to its greatest value.

    A metric has a value a batch, so one row holds a line.
    """
    own = Window.partitionBy(by)
    low, high = F.min(value).over(own), F.max(value).over(own)
    y = F.when(high > low, F.round(height * (high - F.col(value)) / (high - low))).otherwise(F.lit(height / 2)).cast("int")
    placed = series.select(by, F.row_number().over(own.orderBy(order)).alias("_i"), y.alias("_y"))
    points = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_y"))), lambda p: F.concat_ws(",", ((p["_i"] - 1) * step).cast("string"), p["_y"].cast("string")))
    drawn = placed.groupBy(by).agg(F.array_join(points, " ").alias("points"), F.count("*").alias("n"))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), (F.col("n") * step).cast("string"), F.lit(f' {height}"><polyline fill="none" stroke="black" points="'))
    return drawn.select(by, F.concat(head, "points", F.lit('"/></svg>')).alias("svg"))


def chained(batches: list, tune: Callable[[object, object], tuple[object, dict]], model: object = None) -> tuple[object, list[dict]]:
    """Tunes a model batch by batch, each time the one that the batch before left; the last model and each batch's metrics.

    ``tune`` gets the model and a batch, and returns the next model and a row of metrics.
    """
    rows = []
    for batch in batches:
        model, metrics = tune(model, batch)
        rows.append(metrics)
    return model, rows
