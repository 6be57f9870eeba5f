"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha.session import cut_lineage

DEFAULT_SALTS = 16

#: Rows of one key that a task of a sliced join takes.
SLICE_ROWS = 2000
SALT = "_salt"

#: A side of a join is broadcast if it has at most this many rows and characters when stored.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 16 << 20


def salts_of(df: DataFrame, salts: int | None = None) -> int:
    """Number of slices a hot key is cut into (session setting or default)."""
    if salts:
        return salts
    return int(df.sparkSession.conf.get("kotonoha.join.salts", str(DEFAULT_SALTS)))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread_by: list[str],
                how: str = "inner", salts: int | None = None) -> DataFrame:
    """Equi-join whose big side may have hot keys.

    Rows of ``big`` are spread over the slices by the hash of ``spread_by``; the
    rows of ``small`` are repeated once per slice.  A key that holds a third of
    ``big`` therefore reaches ``salts`` tasks instead of one.  ``small`` is stored
    and measured: a small one is broadcast and needs no slices, any other is shuffled.  The optimizer's
    own choice rests on the size of compressed files, which says little about rows
    that were exploded since, and may pick ``big``.
    """
    small = cut_lineage(small, "join-side")
    if is_small(small):
        return big.join(F.broadcast(small), on, how)
    n = salts_of(big, salts)
    if n <= 1:
        return big.join(grown(small), on, how)
    left = big.withColumn(SALT, F.pmod(F.xxhash64(*spread_by), F.lit(n)).cast("int"))
    right = small.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(grown(right), [*on, SALT], how).drop(SALT)


def is_small(stored: DataFrame) -> bool:
    """Whether a stored table may be broadcast; characters are only counted if the rows are few."""
    if stored.count() > BROADCAST_ROWS:
        return False
    return (stored.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0) <= BROADCAST_CHARS


def measured_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join without hot keys; ``small`` is broadcast only if it is small when stored."""
    return salted_join(big, small, on, [], how, salts=1)


def grown(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: it is shuffled and never sent through the driver,
    whatever size the optimizer expects of it or of the other side."""
    return df.hint("merge")


def heavy_keys(df: DataFrame, on: list[str], slice_rows: int) -> DataFrame:
    """on..., slices: the keys with more than ``slice_rows`` rows, and how many slices they need.

    Rows are counted per key where they are read and the counts merged.  There are
    at most rows / slice_rows such keys.
    """
    counted = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > slice_rows)
    return counted.select(*on, F.ceil(F.col("n") / slice_rows).cast("int").alias("_slices"))


def sliced_join(big: DataFrame, small: DataFrame, on: list[str], spread_by: list[str], slice_rows: int | None = None) -> DataFrame:
    """Equi-join whose heavy keys are measured first; only these are cut into slices.

    A heavy key's rows of ``big`` are dealt to its slices by the hash of
    ``spread_by``, and its rows of ``small`` are repeated once per slice; the rows of all other
    keys are neither copied nor salted.  Both sides are dealt into the session's
    number of partitions, so small inputs with many pairs are not merged into few tasks.
    ``big`` is read twice and should be a stored table.
    """
    rows = slice_rows or int(big.sparkSession.conf.get("kotonoha.join.slice", str(SLICE_ROWS)))
    heavy = cut_lineage(heavy_keys(big, on, rows), "heavy-keys")
    slices = F.coalesce("_slices", F.lit(1))
    left = big.join(heavy, on, "left").withColumn(SALT, F.pmod(F.xxhash64(*spread_by), slices).cast("int")).drop("_slices")
    right = small.join(heavy, on, "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), slices - 1))).drop("_slices")
    return by_key(left, *on, SALT).join(by_key(right, *on, SALT).hint("merge"), [*on, SALT]).drop(SALT)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's number of shuffle partitions.

    With the number given, small tables that are about to grow (an explode, a
    join on postings) are not merged into a few tasks first, and an aggregate
    that groups by ``keys`` and more needs no further exchange.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(k) for k in keys])


def running_sum(df: DataFrame, group: str, order: str, value: str, out: str,
                chunk: int = 4096) -> DataFrame:
    """Running total of ``value`` along ``order`` inside ``group``.

    ``order`` must count up from 0.  Works in two levels: totals per block of
    ``chunk`` positions, a running total over the (few) blocks, and a running
    total inside each block, so that no task ever sees a whole long group.
    """
    from pyspark.sql import Window

    blocks = df.withColumn("_block", F.floor(F.col(order) / chunk))
    totals = blocks.groupBy(group, "_block").agg(F.sum(value).alias("_total"))
    over_blocks = Window.partitionBy(group).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    before = totals.select(group, "_block", F.coalesce(F.sum("_total").over(over_blocks), F.lit(0))
                           .alias("_before"))
    inside = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (blocks.join(before, [group, "_block"])
            .withColumn(out, F.col("_before") + F.sum(value).over(inside))
            .drop("_block", "_before"))
