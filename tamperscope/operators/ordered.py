"""Row-order operators that never put a whole ordered series in one task.

A series is cut into blocks of consecutive positions. Fixed-lag and sliding
operators run per block after each block has received the few neighbouring
rows it needs; running totals are taken per block and then carried across the
small table of blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tamperscope.session import new_path

BLOCK = 1 << 13
#: Number of a task's file: at the end of its name, as the write's id may look alike.
FILE_NUMBER = r"-c(\d+)\."


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    out: str,
    name: str = "ordinal",
) -> DataFrame:
    """Dense 0-based position of each row inside ``keys``, at any size.

    The rows are written range-sorted into the shared folder; a row's position
    is its index in its file, shifted by what earlier files hold of its key.
    Only one count per file and key is aggregated, so no task sees a whole key.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.orderBy(*keys, *order).write.parquet(path)
    # A task may write several files, numbered in order.
    file = F.col("_metadata.file_name")
    part = F.struct(F.regexp_extract(file, r"part-(\d+)", 1).cast("int").alias("task"),
                    F.regexp_extract(file, FILE_NUMBER, 1).cast("int").alias("file"))
    written = spark.read.schema(df.schema).parquet(path).select(
        "*", part.alias("_part"), F.col("_metadata.row_index").alias("_at")
    )
    # One row per file and key: the window below is bounded by the file count.
    held = written.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = held.select(
        *keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return (
        written.join(shifts, [*keys, "_part"])
        .withColumn(out, F.col("_shift") + F.col("_at"))
        .drop("_part", "_at", "_shift")
    )


def dense_position(
    df: DataFrame, unit: Sequence[str], order: str, out: str = "pos", block: int = BLOCK
) -> DataFrame:
    """Dense 0-based position inside ``unit`` for rows that already carry a
    unique, roughly dense BIGINT ``order`` (rows may be missing from it)."""
    unit = list(unit)
    cut = df.withColumn("_blk", F.floor(F.col(order) / block))
    sizes = cut.groupBy(*unit, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*unit).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *unit, "_blk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    local = F.row_number().over(Window.partitionBy(*unit, "_blk").orderBy(order))
    return (
        cut.withColumn("_local", local)
        .join(offsets, [*unit, "_blk"])
        .withColumn(out, (F.col("_offset") + F.col("_local") - 1).cast("bigint"))
        .drop("_blk", "_local", "_offset")
    )


def with_halo(
    df: DataFrame,
    unit: Sequence[str],
    pos: str = "pos",
    before: int = 0,
    after: int = 0,
    block: int = BLOCK,
) -> tuple[DataFrame, WindowSpec, Column]:
    """Copies the ``before`` rows ahead of each block and the ``after`` rows
    behind it into the block.

    Returns the rows, the window ordered inside a block, and the predicate
    that keeps a block's own rows once the window has been evaluated.
    """
    if max(before, after) > block:
        raise ValueError("a halo reaches into the neighbouring block only")
    home = F.floor(F.col(pos) / block)
    inside = F.col(pos) - home * block
    targets = F.array_compact(
        F.array(
            home,
            F.when(inside >= block - before, home + 1) if before else F.lit(None).cast("bigint"),
            F.when((inside < after) & (home > 0), home - 1) if after else F.lit(None).cast("bigint"),
        )
    )
    spread = df.withColumn("_blk", F.explode(targets))
    window = Window.partitionBy(*unit, "_blk").orderBy(pos)
    return spread, window, F.col("_blk") == home


def lagged(
    df: DataFrame, unit: Sequence[str], column: str, lags: Sequence[int], pos: str = "pos"
) -> DataFrame:
    """Adds ``{column}_lag{k}`` for each fixed lag k >= 1."""
    spread, window, own = with_halo(df, unit, pos, before=max(lags))
    for k in lags:
        spread = spread.withColumn(f"{column}_lag{k}", F.lag(column, k).over(window))
    return spread.where(own).drop("_blk")


def sliding(
    df: DataFrame,
    unit: Sequence[str],
    columns: Sequence[str],
    width: int,
    stride: int,
    pos: str = "pos",
) -> DataFrame:
    """Full windows of ``width`` consecutive positions, every ``stride``.

    Each window is one row: unit, ``w`` (window number), ``start`` and one
    array per requested column, in position order.
    """
    spread, window, own = with_halo(df, unit, pos, after=width - 1)
    frame = window.rowsBetween(0, width - 1)
    out = spread
    for c in columns:
        out = out.withColumn(f"_w_{c}", F.collect_list(c).over(frame))
    return (
        out.where(own & (F.col(pos) % stride == 0) & (F.size(f"_w_{columns[0]}") == width))
        .select(
            *unit,
            (F.col(pos) / stride).cast("bigint").alias("w"),
            F.col(pos).alias("start"),
            *[F.col(f"_w_{c}").alias(c) for c in columns],
        )
    )


def prefix_sum(
    df: DataFrame, unit: Sequence[str], column: str, out: str, pos: str = "pos", block: int = BLOCK
) -> DataFrame:
    """Inclusive running total of ``column`` along ``pos``."""
    unit = list(unit)
    cut = df.withColumn("_blk", F.floor(F.col(pos) / block))
    totals = cut.groupBy(*unit, "_blk").agg(F.sum(column).alias("_t"))
    earlier = (
        Window.partitionBy(*unit).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *unit, "_blk", F.coalesce(F.sum("_t").over(earlier), F.lit(0.0)).alias("_carry")
    )
    running = Window.partitionBy(*unit, "_blk").orderBy(pos).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        cut.withColumn("_s", F.sum(column).over(running))
        .join(carry, [*unit, "_blk"])
        .withColumn(out, F.col("_carry") + F.col("_s"))
        .drop("_blk", "_s", "_carry")
    )


def sign_runs(df: DataFrame, unit: Sequence[str], sign: str, order: str, block: int = BLOCK) -> DataFrame:
    """Runs of equal sign per unit after zeros are dropped: n_pos, n_neg, runs."""
    unit = list(unit)
    signs = df.where(F.col(sign) != 0).withColumn("_blk", F.floor(F.col(order) / block))
    inner = Window.partitionBy(*unit, "_blk").orderBy(order)
    marked = signs.withColumn("_prev", F.lag(sign).over(inner))
    blocks = marked.groupBy(*unit, "_blk").agg(
        F.count_if(F.col(sign) > 0).alias("n_pos"),
        F.count_if(F.col(sign) < 0).alias("n_neg"),
        F.count_if(F.col(sign) != F.col("_prev")).alias("_inner"),
        F.min_by(sign, order).alias("_first"),
        F.max_by(sign, order).alias("_last"),
    )
    across = Window.partitionBy(*unit).orderBy("_blk")
    joined = blocks.withColumn(
        "_edge", F.when(F.lag("_last").over(across) != F.col("_first"), 1).otherwise(0)
    )
    return joined.groupBy(*unit).agg(
        F.sum("n_pos").alias("n_pos"),
        F.sum("n_neg").alias("n_neg"),
        (F.sum("_inner") + F.sum("_edge") + 1).alias("runs"),
    )


def islands(
    df: DataFrame,
    unit: Sequence[str],
    pos: str,
    block: int = BLOCK,
    aggs: Sequence[Column] = (),
    merge: Sequence[Column] = (),
) -> DataFrame:
    """Maximal stretches of consecutive ``pos`` per unit: lo, hi, length.

    Stretches are found per block and then stitched where one ends at a block
    edge and the next starts right after it. ``aggs`` are computed per piece
    and ``merge`` combines them over the pieces of a stretch.
    """
    unit = list(unit)
    cut = df.withColumn("_blk", F.floor(F.col(pos) / block))
    inner = Window.partitionBy(*unit, "_blk").orderBy(pos)
    pieces = (
        cut.withColumn("_isle", F.col(pos) - F.row_number().over(inner))
        .groupBy(*unit, "_blk", "_isle")
        .agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"), *aggs)
    )
    # A piece inside its block is complete; only edge pieces need stitching,
    # and a block has at most two of those per unit.
    at_edge = (F.col("_lo") == F.col("_blk") * block) | (F.col("_hi") == (F.col("_blk") + 1) * block - 1)
    across = Window.partitionBy(*unit).orderBy("_lo")
    edge = pieces.where(at_edge).withColumn(
        "_new", F.when(F.col("_lo") == F.lag("_hi").over(across) + 1, 0).otherwise(1)
    )
    edge = edge.withColumn(
        "_run", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0))
    )
    span = [F.min("_lo").alias("lo"), F.max("_hi").alias("hi")]
    stitched = edge.groupBy(*unit, "_run").agg(*span, *merge).drop("_run")
    whole = pieces.where(~at_edge).groupBy(*unit, "_lo").agg(*span, *merge).drop("_lo")
    return stitched.unionByName(whole).withColumn("length", F.col("hi") - F.col("lo") + 1)


def median(column: str | Column) -> Column:
    """Middle value, or the mean of the two middle values.

    Built on a bounded-size quantile sketch: exact while a group holds fewer
    values than the sketch keeps, and within 1/200000 of the rank beyond.
    """
    both = F.percentile_approx(column, [0.5, 0.5 + 1e-9], 200_000)
    return (F.get(both, F.lit(0)) + F.get(both, F.lit(1))) / 2


def rank_value(column: str | Column, fraction: float) -> Column:
    """Value whose rank is ceil(fraction * n), from the same sketch."""
    return F.percentile_approx(column, fraction, 200_000)


def rank_values(column: str | Column, fractions: list[float]) -> Column:
    """Several such values from one sketch, as an array."""
    return F.percentile_approx(column, fractions, 200_000)


def windows_in(n: Column, width: int, stride: int) -> Column:
    """How many full windows a series of ``n`` rows holds."""
    return F.when(n >= width, F.floor((n - width) / stride) + 1).otherwise(0)


