"""Values that recur any number of rows away.

Short offsets are scanned one by one elsewhere. Here a column is read as
stretches of a few rows, and equal stretches meet by their hash: a stretch and
its nearest earlier occurrence propose an offset, and the rows around are then
compared at that offset until they differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamperscope.functions.rows import cells
from tamperscope.model import KEY, Sheet
from tamperscope.operators.ordered import islands, with_halo
from tamperscope.session import materialize

#: Rows in which a task looks for recurrences by itself.
BLOCK = 4096
#: Rows compared on either side of a recurrence in the first round, and how
#: many times as many in each further one.
FIRST_STEP, GROWTH = 2, 8
#: Rows on either side of a window that its place carries marks of.
MARKS = 4
#: Least rows of a recurring stretch.
LEAST = 3

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def gram_rows(n_rows: Column, hhi: Column) -> Column:
    """Rows of a stretch: the fewest, but at least LEAST, at which chance gives
    no more than one recurrence per row of the sheet, by the column's
    concentration; 0 for a column of one value. What is found so grows with
    the rows, not their square."""
    pairs = F.greatest((n_rows.cast("double") - 1) / 2, F.lit(1.0))
    fewest = F.ceil(F.log(pairs) / -F.log(hhi) - 1e-9)
    return F.when(hhi >= 1, 0).otherwise(F.least(F.greatest(fewest, F.lit(LEAST)), F.lit(BLOCK))).cast("int")


def _hashes(x: np.ndarray, rows: int) -> np.ndarray:
    """Hash of every ``rows`` neighbours."""
    bits = (x + 0.0).view(np.uint64)
    bits = (bits ^ (bits >> np.uint64(32))) * np.uint64(_PRIME)
    bits = bits ^ (bits >> np.uint64(29))
    n = len(bits)
    up, down = (np.cumprod(np.full(n + 1, f, np.uint64), dtype=np.uint64) for f in (_PRIME, _INVERSE))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(bits * up[:n], dtype=np.uint64)))
    out = (sums[rows:] - sums[:-rows]) * down[:n - rows + 1]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(30))


def _marks(idx: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """A byte for each of the MARKS values before a window of ``rows`` rows and
    behind it, the nearest first; different bytes are different values, and 0
    is no value."""
    bits = (x + 0.0).view(np.uint64) * np.uint64(_PRIME)
    byte = np.where(np.isnan(x), 0, bits >> np.uint64(56) | np.uint64(1)).astype(np.uint64)
    at = np.zeros(int(idx[-1] - idx[0]) + rows + 2 * MARKS + 1, np.uint64)
    place = idx - idx[0] + MARKS
    at[place] = byte
    out = np.zeros(len(x) - rows + 1, np.uint64)
    place = place[:len(out)]
    for k in range(MARKS):
        out |= at[place - 1 - k] << np.uint64(8 * k)
        out |= at[place + rows + k] << np.uint64(8 * (MARKS + k))
    return out.view(np.int64)


def _goes_on(a: Column, b: Column) -> Column:
    """Whether all marks of one side are alike."""
    def side(first: int) -> Column:
        out = F.lit(True)
        for k in range(first, first + MARKS):
            x, y = (F.shiftright(c, 8 * k).bitwiseAND(F.lit(255)) for c in (a, b))
            out = out & (x == y) & (x != 0)
        return out

    return side(0) | side(MARKS)


def _block_grams(idx: np.ndarray, vals: np.ndarray, block: int, size: int, lengths: list[int], reach: int):
    """(col, rows, hash, d, lo, hi, at_lo, at_hi): of each stretch its first
    and last place in the block and their marks (d null), and recurrences
    inside the block beyond the reach as runs of places at one offset (hash
    and marks null)."""
    out = []
    own = (idx >= block * size) & (idx < (block + 1) * size)
    for c, k in enumerate(lengths):
        x = vals[:, c]
        n = len(x) - k + 1
        if not k or n <= 0:
            continue
        absent = np.concatenate(([0], np.cumsum(np.isnan(x))))
        moves = np.concatenate(([0, 0], np.cumsum(x[1:] != x[:-1])))  # up to each row
        good = own[:n] & (idx[k - 1:] - idx[:n] == k - 1) & (absent[k:] == absent[:-k][:n]) & (moves[k:] - moves[1:n + 1] > 0)
        at = np.flatnonzero(good)
        if not len(at):
            continue
        h = _hashes(x, k)[at]
        order = np.argsort(h, kind="stable")
        h, place, marks = h[order], idx[at[order]], _marks(idx, x, k)[at[order]]
        edge = np.append(True, h[1:] != h[:-1])
        first, last = np.flatnonzero(edge), np.append(np.flatnonzero(edge)[1:], len(h)) - 1
        m = len(first)
        out.append((np.full(m, c), np.full(m, k), h[first].view(np.int64), None, place[first], place[last], marks[first], marks[last]))
        here = np.flatnonzero(~edge)
        d, later = place[here] - place[here - 1], place[here]
        far = d > reach
        if far.any():
            d, later = d[far], later[far]
            order = np.lexsort((later, d))
            d, later = d[order], later[order]
            new = np.append(True, (d[1:] != d[:-1]) | (later[1:] != later[:-1] + 1))
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(d)) - 1
            out.append((np.full(len(lo), c), np.full(len(lo), k), None, d[lo], later[lo], later[hi], None, None))
    return out


def recurrences(sheet: Sheet, lengths: DataFrame, block: int = BLOCK, *, paired: bool = False) -> DataFrame:
    """(KEY, col, d, lo, hi): stretches lo..hi of a column whose every window
    of its ``gram`` rows has its nearest earlier occurrence d rows before,
    further away than ``reach``. Windows hold two different values or more.

    ``lengths`` (KEY, reach, grams ARRAY<INT> by column) has a row per group.
    A block of rows sends the first and last place of each different window,
    so a window that fills a third of the sheet is one row per block.
    ``paired`` leaves out windows whose maximal run can share no row with one
    of another column at that offset: the marks beside most windows tell that
    their run ends there, so they are told apart before any row is looked up.
    """
    longest = lengths.agg(F.max(F.array_max("grams"))).head()[0] or LEAST
    rows = sheet.rows.select(*KEY, "row_idx", "vals").join(lengths, KEY)
    spread, _, _ = with_halo(
        rows, KEY, "row_idx", before=min(MARKS, block), after=min(longest - 1 + MARKS, block), block=block)
    names = [*KEY, "col", "gram", "g", "d", "lo", "hi", "at_lo", "at_hi"]
    kinds = [pa.string()] * len(KEY) + [pa.int32(), pa.int32(), *[pa.int64()] * 6]

    def find(part: pa.Table) -> pa.Table:
        part = part.sort_by("row_idx")
        vals = part["vals"].combine_chunks()
        width = len(vals[0])
        flat = vals.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        found = _block_grams(part["row_idx"].to_numpy(), flat, part["_blk"][0].as_py(), block, part["grams"][0].as_py(),
                             part["reach"][0].as_py())
        tables = []
        for cols in found:
            m = len(cols[0])
            arrays = [pa.array([part[k][0].as_py()] * m, pa.string()) for k in KEY]
            arrays += [pa.nulls(m, t) if c is None else pa.array(c).cast(t) for c, t in zip(cols, kinds[len(KEY):], strict=True)]
            tables.append(pa.Table.from_arrays(arrays, names))
        return pa.concat_tables(tables) if tables else pa.Table.from_arrays([pa.nulls(0, t) for t in kinds], names)

    schema = ", ".join(f"{k} string" for k in KEY) + ", col int, gram int, g long, d long, lo long, hi long, at_lo long, at_hi long"
    found = materialize(spread.groupBy(*KEY, "_blk").applyInArrow(find, schema), "grams")
    before = Window.partitionBy(*KEY, "col", "g").orderBy("lo")
    across = found.where("g IS NOT NULL").select(
        "*", (F.col("lo") - F.lag("hi").over(before)).alias("_d"), _goes_on(F.col("at_lo"), F.lag("at_hi").over(before)).alias("_open"))
    across = across.drop("d").withColumnRenamed("_d", "d").join(lengths.select(*KEY, "reach"), KEY).where(
        F.col("d") > F.col("reach")).select(*KEY, "col", "gram", "d", "lo", "_open")
    inside = found.where("g IS NULL").select(*KEY, "col", "gram", "d", "lo", "hi")
    if paired:
        across = _that_may_meet(materialize(across, "far-places"), inside, longest + MARKS > block, block)
    across = islands(across, [*KEY, "col", "gram", "d"], "lo", block).drop("length")
    both = inside.unionByName(across)
    return both.select(*KEY, "col", "d", (F.col("lo") - F.col("d")).alias("lo"), (F.col("hi") - F.col("d") + F.col("gram") - 1).alias("hi"))


def _that_may_meet(places: DataFrame, inside: DataFrame, unmarked: bool, block: int) -> DataFrame:
    """``places`` without windows whose run shares no row with another column's.

    A run that isn't ``_open`` ends within MARKS rows of its window. Offsets
    at which some run may go on are left whole; at others, windows of two
    columns must come near each other.
    """
    if unmarked:  # the marks behind a window of nearly a block are beyond its task
        return places
    long_ = inside.select(*KEY, "d").union(places.where("_open").select(*KEY, "d")).distinct()
    long_ = materialize(long_.withColumn("_long", F.lit(True)), "far-offsets")
    told = places.join(long_, [*KEY, "d"], "left")
    columns = places.columns
    first = F.col("lo") - F.col("d") - MARKS
    cells_ = F.sequence(F.floor(first / block), F.floor((first + F.col("gram") - 1 + 2 * MARKS) / block))
    near = Window.partitionBy(*KEY, "d", "_cell")
    ended = told.where("_long IS NULL").select(*columns, F.explode(cells_).alias("_cell"))
    ended = ended.select(*columns, (F.min("col").over(near) != F.max("col").over(near)).alias("_met"))
    return told.where("_long").select(*columns).union(ended.where("_met").select(*columns).distinct())


def merged(pieces: DataFrame) -> DataFrame:
    """Pieces (KEY, col, d, lo, hi, left, right) of one column and offset that
    touch or overlap as one; ``left`` and ``right`` tell whether that end may
    still grow. Pieces of a block of rows are joined first, so that few are
    left where a whole column and offset meet."""
    unit = [*KEY, "col", "d"]

    def once(df: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("lo", "hi")
        reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
        cut = df.withColumn("_new", F.when(F.col("lo") <= reach + 1, 0).otherwise(1))
        cut = cut.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        # An end that one piece found closed is closed.
        return cut.groupBy(*by, "_run").agg(
            F.min(F.struct("lo", "left")).alias("_a"), F.max(F.struct("hi", (~F.col("right")).alias("closed"))).alias("_b")
        ).select(*unit, F.col("_a.lo").alias("lo"), F.col("_b.hi").alias("hi"), F.col("_a.left").alias("left"),
                 (~F.col("_b.closed")).alias("right"))

    return once(once(pieces.withColumn("_cell", F.floor(F.col("lo") / BLOCK)), [*unit, "_cell"]), unit)


def extended(sheet: Sheet, runs: DataFrame) -> DataFrame:
    """(KEY, col, d, lo, hi): ``runs`` (rows lo..hi of a column are equal to
    those d rows on) stretched both ways as far as the rows agree, each once.

    Rows beside a run are looked up, a few at first, then ever more for the
    runs that still go on; rows of the sheet meet only the runs that ask for
    them. Runs of one offset that have met go on as one, so that the rows
    looked up grow with the rows of the runs, and the rounds with the logarithm
    of the longest.
    """
    if runs.isEmpty():
        return runs
    values = materialize(cells(sheet.rows).select(*KEY, "col", F.col("row_idx").alias("at"), "x"), "far-values")
    end = values.agg(F.max("at")).head()[0]
    unit = [*KEY, "col", "d", "lo", "hi"]
    open_ = F.lit(True)
    left = materialize(merged(runs.distinct().select(*unit, open_.alias("left"), open_.alias("right"))), "far-runs")
    done: list[DataFrame] = []
    step = FIRST_STEP
    while not left.isEmpty():
        sides = left.select("*", F.explode(F.array(F.lit(-1), F.lit(1))).alias("way")).where(
            F.when(F.col("way") < 0, F.col("left")).otherwise(F.col("right")))
        room = F.when(F.col("way") < 0, F.col("lo")).otherwise(end - F.col("d") - F.col("hi"))
        # The row behind the last one closes a run, so it is asked for, too.
        last = F.greatest(F.least(room + 1, F.lit(step)), F.lit(1))
        asked = sides.select(*unit, "way", last.alias("_last"), F.explode(F.sequence(F.lit(0), F.floor((last - 1) / BLOCK))).alias("_b"))
        if step > BLOCK:
            asked = asked.repartition(*unit, "way", "_b")
        first = F.col("_b") * BLOCK + 1
        asked = asked.select(*unit, "way", F.explode(F.sequence(first, F.least(F.col("_last"), first + BLOCK - 1))).alias("k"))
        edge = F.when(F.col("way") < 0, F.col("lo")).otherwise(F.col("hi"))
        asked = asked.withColumn("at", edge + F.col("way") * F.col("k"))
        here = asked.join(values, [*KEY, "col", "at"], "left").withColumnRenamed("x", "y").withColumn("at", F.col("at") + F.col("d"))
        both = here.join(values, [*KEY, "col", "at"], "left")
        same = F.coalesce(F.col("x") == F.col("y"), F.lit(False))
        grown = both.groupBy(*unit).agg(
            F.min(F.when(~same & (F.col("way") < 0), F.col("k"))).alias("_l"),
            F.min(F.when(~same & (F.col("way") > 0), F.col("k"))).alias("_r"))
        wide = left.join(grown, unit, "left")
        more = {side: F.when(F.col(side), F.coalesce(F.col(at) - 1, F.lit(step))).otherwise(0) for side, at in (("left", "_l"), ("right", "_r"))}
        wide = wide.select(*KEY, "col", "d", (F.col("lo") - more["left"]).alias("lo"), (F.col("hi") + more["right"]).alias("hi"),
                           (F.col("left") & F.col("_l").isNull()).alias("left"), (F.col("right") & F.col("_r").isNull()).alias("right"))
        met = materialize(merged(wide), "far-runs")
        done.append(met.where("not left and not right").select(*unit))
        left = materialize(met.where("left or right"), "far-runs")
        step *= GROWTH
    each = done[0]
    for part in done[1:]:
        each = each.unionByName(part)
    return each


def with_changes(sheet: Sheet, runs: DataFrame) -> DataFrame:
    """``runs`` (KEY, col, d, lo, hi) with how often the value changes inside;
    as many rows are looked up as the runs have."""
    values = cells(sheet.rows).select(*KEY, "col", F.col("row_idx").alias("at"), "x")
    unit = [*KEY, "col", "d", "lo", "hi"]
    placed = runs.select(*unit, F.explode(F.sequence("lo", "hi")).alias("at")).join(values, [*KEY, "col", "at"])
    cell = F.floor((F.col("at") - F.col("lo")) / BLOCK)
    order = Window.partitionBy(*unit, "_cell").orderBy("at")
    marked = placed.withColumn("_cell", cell).withColumn("_move", (F.lag("x").over(order) != F.col("x")).cast("int"))
    parts = marked.groupBy(*unit, "_cell").agg(F.sum("_move").alias("n"), F.min_by("x", "at").alias("first"), F.max_by("x", "at").alias("last"))
    over = Window.partitionBy(*unit).orderBy("_cell")
    parts = parts.withColumn("n", F.coalesce("n", F.lit(0)) + F.coalesce((F.lag("last").over(over) != F.col("first")).cast("int"), F.lit(0)))
    return parts.groupBy(*unit).agg(F.sum("n").alias("changes"))


def column_sets(runs: DataFrame) -> DataFrame:
    """(KEY, d, cols, lo, hi): stretches in which the same two or more columns
    have a run at the offset, cut wherever a column joins or leaves."""
    several = runs.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))))
    unit = [*KEY, "d", "_cell"]
    wide = several.groupBy(*unit).agg(F.count_distinct("col").alias("_n")).where("_n >= 2").drop("_n")
    inside = several.join(wide, unit).select(
        *unit, "col", F.greatest("lo", F.col("_cell") * BLOCK).alias("lo"), F.least("hi", (F.col("_cell") + 1) * BLOCK - 1).alias("hi"))
    # Between two cuts of a cell the columns stay the same; a cell has a cut
    # at most once per row.
    cuts = inside.select(*unit, F.col("lo").alias("cut")).union(inside.select(*unit, F.col("hi") + 1)).distinct()
    pieces = cuts.withColumn("_to", F.lead("cut").over(Window.partitionBy(*unit).orderBy("cut")) - 1).where("_to IS NOT NULL")
    held = pieces.join(inside, unit).where((F.col("lo") <= F.col("cut")) & (F.col("hi") >= F.col("_to")))
    sets = held.groupBy(*unit, "cut", "_to").agg(F.array_sort(F.collect_set("col")).alias("cols")).where(F.size("cols") >= 2)
    across = Window.partitionBy(*KEY, "d", "cols").orderBy("cut")
    marked = sets.withColumn("_new", F.when(F.lag("_to").over(across) == F.col("cut") - 1, 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*KEY, "d", "cols", "_run").agg(F.min("cut").alias("lo"), F.max("_to").alias("hi")).drop("_run")
