"""Running values that are kept within limits, as scans.

A step adds an amount to the value (or multiplies it) and clamps the result. Such steps compose to a step of the same kind
(amount, low, high), which is associative: a span of rows is folded to one, spans are composed over doubling distances by
lags of one window, and each span's rows then start from what all spans before it make of the first value. So no row
holds a stream, and a stream's spans are three numbers each where they meet in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def combined(value: Column, amount: Column, times: bool) -> Column:
    return value * amount if times else value + amount


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, value))


def clamped(rows: DataFrame, amount: Column, low: float, high: float, start: float, name: str, order: str = "frame_no", times: bool = False, span: int = 64) -> DataFrame:
    """rows (stream_id, ``order`` from 0 and any more) with ``name``: the running value after each row, where a row adds
    ``amount`` (or multiplies by it) and the result is kept within low and high."""
    kind = "double" if times or not all(float(x).is_integer() for x in (low, high, start)) else "bigint"
    lit = lambda x: F.lit(x).cast(kind)
    step = f"struct<amount: {kind}, low: {kind}, high: {kind}>"
    as_step = lambda a, lo, hi: F.struct(a.alias("amount"), lo.alias("low"), hi.alias("high")).cast(step)
    neutral = as_step(lit(1 if times else 0), lit(low), lit(high))

    def then(first: Column, second: Column) -> Column:
        after = lambda x: clamp(combined(x, second.amount, times), second.low, second.high)
        return as_step(combined(first.amount, second.amount, times), after(first.low), after(first.high))

    own = F.struct(F.col(order).alias("__at"), amount.cast(kind).alias("__amount"), F.struct(*rows.columns).alias("__row"))
    spans = rows.groupBy("stream_id", F.floor(F.col(order) / span).cast("bigint").alias("__span")).agg(F.array_sort(F.collect_list(own)).alias("__rows"))
    # the running value is within the limits before the first row too, so the neutral step may clamp
    spans = spans.withColumn("__step", F.aggregate("__rows", neutral, lambda s, r: then(s, as_step(r["__amount"], lit(low), lit(high)))))
    w = Window.partitionBy("stream_id").orderBy("__span")
    last = rows.agg(F.max(order)).first()[0] or 0
    for k in range((last // span).bit_length()):
        earlier = F.lag("__step", 1 << k).over(w)
        spans = spans.withColumn("__earlier", earlier).withColumn("__step", F.when(F.col("__earlier").isNull(), F.col("__step")).otherwise(then(F.col("__earlier"), F.col("__step")))).drop("__earlier")
    before = F.lag("__step").over(w)
    first = clamp(lit(start), lit(low), lit(high))
    spans = spans.withColumn("__before", before).withColumn("__first", F.when(F.col("__before").isNull(), first).otherwise(clamp(combined(first, F.col("__before").amount, times), F.col("__before").low, F.col("__before").high)))
    acc = f"struct<v: {kind}, out: array<{kind}>>"

    def follow(s: Column, r: Column) -> Column:
        v = clamp(combined(s.v, r["__amount"], times), lit(low), lit(high))
        return F.struct(v.alias("v"), F.concat(s.out, F.array(v)).alias("out")).cast(acc)

    values = F.aggregate("__rows", F.struct(F.col("__first").alias("v"), F.array().cast(f"array<{kind}>").alias("out")).cast(acc), follow, lambda s: s.out)
    each = spans.select(F.explode(F.arrays_zip(F.col("__rows"), values.alias("__values"))).alias("z"))
    return each.select("z.__rows.__row.*", F.col("z.__values").alias(name))
