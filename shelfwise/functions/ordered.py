"""Exact order statistics, ranks and running totals that never sort one whole group in one task.

Order statistics are selected by radix: doubles become longs of the same order, rows are counted by
their leading bits with a map-side partial aggregation, and only the rows of the buckets that hold a
wanted position are looked at by further bits, until a bucket is small. Ranks and running totals are
prefix sums over a range partitioning: rows are dealt to tasks by value and tie break, each task
counts within itself, and the totals of the tasks before it are added. Neither a hot group nor a hot
value nor a narrow range of values meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.sources.staging import stage

#: bits that a round looks at; a bucket of up to _ROOM rows is sorted in one task
_BITS = 16
_ROUNDS = 64 // _BITS
_ROOM = 1 << 16
_ALL_BUT_SIGN = (1 << 63) - 1


def _flip(bits: Column) -> Column:
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(_ALL_BUT_SIGN))).otherwise(bits)


def ordered_bits(value: Column) -> Column:
    """A long that orders as the double does; blank for NULL and NaN, one value for both zeros."""
    v = value.cast("double") + F.lit(0.0)
    raw = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), v).cast("long")
    return F.when(v.isNotNull() & ~F.isnan(v), _flip(raw))


def value_of_bits(bits: Column) -> Column:
    """The double that `ordered_bits` came from."""
    raw = F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), _flip(bits))
    return F.when(bits.isNotNull(), raw.cast("double"))


def _leading(depth: int) -> Column:
    """The first ``depth`` rounds' bits of ``_u``."""
    if depth == 0:
        return F.col("_u").bitwiseAND(F.lit(0).cast("long"))
    return F.shiftright("_u", 64 - _BITS * depth)


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL keys match each other; the keys appear once in the result."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def order_statistics(
    df: DataFrame,
    value: str,
    wanted: dict[str, Callable[[Column, Column], Column]],
    keys: Sequence[str] = (),
    cheap: bool = False,
    room: int = _ROOM,
) -> DataFrame:
    """Per group the values at 0-based positions of its sorted values, all found in the same rounds.

    ``wanted`` maps a column name to the position, given the group's number of values and of blanks
    (NULL and NaN); a NULL position gives NULL. ``_total`` and ``_blanks`` are returned too. Groups
    without a value, or without a position, are absent. The rounds read one long per row: it is written once, or worked out
    anew from ``df`` each time if that is ``cheap``. Each round is a job over what is left.
    """
    keys = list(keys)
    bits = df.select(*keys, ordered_bits(F.col(value)).alias("_u"))
    if not cheap:
        bits = stage(bits, "order-bits")
    groups = bits.groupBy(*keys).agg(
        F.count("_u").alias("_total"), (F.count(F.lit(1)) - F.count("_u")).alias("_blanks")
    )
    named = [
        F.struct(F.lit(n).alias("name"), at(F.col("_total"), F.col("_blanks")).cast("long").alias("at"))
        for n, at in wanted.items()
    ]
    slots = (
        groups.where("_total > 0")
        .select(*keys, "_total", "_blanks", F.explode(F.array(*named)).alias("_s"))
        .where(F.col("_s.at").isNotNull())
        .select(*keys, "_total", "_blanks", F.lit(0).cast("long").alias("_p"), F.col("_total").alias("_n"), "_s.name", "_s.at")
    )
    depth = 0
    held = bits.where(F.col("_u").isNotNull())
    slots = stage(slots, "order-slots")
    group = [*keys, "_total", "_blanks"]

    def narrowed(next_bits: Column) -> DataFrame:
        """Each slot with the bucket ``_q`` of ``next_bits`` that holds it, and its place in there."""
        rows = held.withColumn("_p", _leading(depth))
        if depth:
            rows = join_null_safe(rows, slots.select(*keys, "_p").distinct(), [*keys, "_p"])
        counted = rows.groupBy(*keys, "_p", next_bits.alias("_q")).agg(F.count(F.lit(1)).alias("_m"))
        inside = Window.partitionBy(*keys, "_p").orderBy("_q")
        running = counted.withColumn("_before", F.sum("_m").over(inside) - F.col("_m"))
        return (
            join_null_safe(slots, running, [*keys, "_p"])
            .where((F.col("at") >= F.col("_before")) & (F.col("at") < F.col("_before") + F.col("_m")))
            .withColumn("at", F.col("at") - F.col("_before"))
        )

    while depth < _ROUNDS and (slots.agg(F.max("_n")).head()[0] or 0) > room:
        found = narrowed(_leading(depth + 1))
        slots = stage(found.select(*group, F.col("_q").alias("_p"), F.col("_m").alias("_n"), "name", "at"), "order-slots")
        depth += 1
    last = slots.withColumn("_q", F.col("_p")) if depth == _ROUNDS else narrowed(F.col("_u"))
    picked = last.select(*group, "name", value_of_bits(F.col("_q")).alias("_v"))
    columns = [F.max(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in wanted]
    # one row a group; written, as a reflected call may stand neither in an aggregate nor in a join
    return stage(picked.groupBy(*group).agg(*columns), "order-found")


def quantile_positions(probs: dict[str, float]) -> dict[str, Callable[[Column, Column], Column]]:
    """The two positions that each linearly interpolated quantile lies between."""
    out: dict[str, Callable[[Column, Column], Column]] = {}
    for name, p in probs.items():
        out[f"{name}_lo"] = lambda n, _, p=p: F.floor(F.lit(float(p)) * (n - 1))
        out[f"{name}_hi"] = lambda n, _, p=p: F.ceil(F.lit(float(p)) * (n - 1))
    return out


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (), cheap: bool = False
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per group; groups without a value are absent.

    ``probs`` maps output column names to probabilities.
    """
    found = order_statistics(df, value, quantile_positions(probs), keys, cheap)

    def interpolated(name: str, p: float) -> Column:
        position = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return found.select(*keys, *[interpolated(name, p) for name, p in probs.items()])


def average_rank(
    df: DataFrame, value: str, keys: Sequence[str], rank: str, total: str
) -> DataFrame:
    """``df`` with the 1-based average rank of ``value`` in its group and the non-null count.

    ``df`` is read twice, so hand in a staged or otherwise cheap table. Equal values are one counted
    row, range partitions of those are ranked by themselves, and offsets are added per group.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    counts = (
        # Adding zero turns -0.0 into 0.0, which sort and group alike but print differently.
        df.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*keys, (v + F.lit(0.0)).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    dealt = stage(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "ranks")
    group = Window.partitionBy(*keys)
    offsets = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_pn")).select(
        *keys,
        "_part",
        (F.sum("_pn").over(group.orderBy("_part")) - F.col("_pn")).alias("_before"),
        F.sum("_pn").over(group).alias("_total"),
    )
    inside = Window.partitionBy("_part", *keys).orderBy("_v")
    ranks = join_null_safe(
        dealt.withColumn("_lower", F.sum("_n").over(inside) - F.col("_n")), offsets, [*keys, "_part"]
    ).select(
        *keys,
        "_v",
        (F.col("_before") + F.col("_lower") + (F.col("_n") + 1) / 2).alias(rank),
        F.col("_total").alias(total),
    )
    keyed = df.withColumn("_v", F.col(value).cast("double") + F.lit(0.0))
    return join_null_safe(keyed, ranks, [*keys, "_v"], "left").drop("_v")


def position_by(
    df: DataFrame,
    value: str,
    tie_break: str,
    position: str,
    running: str | None = None,
) -> DataFrame:
    """1-based position by ``value`` descending, then ``tie_break``, over the whole table.

    With ``running``, also the running total of ``value`` in that order. Rows of one value are split
    over tasks by their tie break.
    """
    dealt = stage(
        df.repartitionByRange(F.desc(value), F.asc(tie_break)).withColumn("_part", F.spark_partition_id()), "places"
    )
    ahead = Window.orderBy("_part")  # a row for each task
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_pn"), F.sum(value).alias("_ps")).select(
        F.col("_part").alias("_rpart"),
        F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_ps").over(before), F.lit(0.0)).alias("_sum_before"),
    )
    inside = Window.partitionBy("_part").orderBy(F.desc(value), F.asc(tie_break))
    columns = [(F.col("_before") + F.col("_at")).cast("long").alias(position)]
    if running:
        columns.append((F.col("_sum_before") + F.col("_run")).alias(running))
    return (
        dealt.withColumn("_at", F.row_number().over(inside))
        .withColumn("_run", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, F.col("_part") == F.col("_rpart"))
        .select(*df.columns, *columns)
    )
