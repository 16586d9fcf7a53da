"""Norms, softmax, ranks and differences of captured values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def top1_probability(values: Column) -> Column:
    return F.exp(F.array_max(values) - log_sum_exp(values))


def log_probability(values: Column, token: Column) -> Column:
    return F.get(values, token.cast("int")) - log_sum_exp(values)


def rank_of(values: Column, token: Column) -> Column:
    """1 for the largest; ties share the better rank."""
    chosen = F.get(values, token.cast("int"))
    return F.size(F.filter(values, lambda x: x > chosen)) + 1


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def top_k(rows: DataFrame, key: list[str], k: int, values: str = "values") -> DataFrame:
    """(key, rank, token, value): the k largest, ties by the smaller index. Row-local: no shuffle."""
    order = F.transform(F.col(values), lambda x, i: F.struct((-x).alias("m"), i.alias("i")))
    best = F.slice(F.array_sort(order), 1, k)
    return rows.select(*key, F.posexplode(best).alias("p", "b")).select(*key, (F.col("p") + 1).alias("rank"), F.col("b.i").cast("long").alias("token"), (-F.col("b.m")).alias("value"))


def differences(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(key, col, diff): absolute differences of equal keys, one row for each element."""
    both = a.join(b.withColumnRenamed("values", "others"), key)
    return both.select(*key, F.posexplode(F.zip_with("values", "others", lambda x, y: F.abs(x - y))).alias("col", "diff"))


def first_largest(diffs: DataFrame, by: list[str], place: list[str]) -> DataFrame:
    """For each key the place of its largest difference, the first one where several are equal."""
    order = Window.partitionBy(*by).orderBy(F.desc("diff"), *place)
    return diffs.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
