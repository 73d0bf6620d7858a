"""Copied values, rows and blocks inside one sheet.

Equal things meet by grouping on their key, so a value held by a third of all
rows is one count, never a list of pairs. Offset scans run in blocks of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamperscope.functions import special
from tamperscope.functions.adjust import bh_small
from tamperscope.functions.rows import cells, mean, pair_values, present, sheet_sizes
from tamperscope.functions.stats import flag_from_p, let
from tamperscope.functions.tails import lgamma
from tamperscope.functions.values import decimal_places, plain_decimal, value_key
from tamperscope.model import KEY, Outcome, Sheet, result_rows, unit_rows
from tamperscope.operators import recurrence
from tamperscope.operators.ordered import islands, ordinal, with_halo
from tamperscope.session import materialize

MAX_OFFSET = 200             # every offset up to this one is scanned row by row;
FREE_OFFSET_ROWS = 500       # ... up to so many rows, all are; further ones by recurrence
FIT_LIMIT = 5000             # integer sheets up to this size get a fitted law
BIN_ROWS = 30
_PAIR_CELLS = 1 << 22      # cells times columns of the bins counted at a time
MIN_BLOCK_CELLS = 6
MIN_AGREEING = 4
HOT_SHARE = 0.02
EXACT_SUBSET_COLUMNS = 10    # sheets up to this width expand rows into column subsets
FEW_ROWS = 64                # rows of a wide sheet that may share a filing key by chance
SHORT = 32                   # rows of a run that meets others by both its places
TALLEST = 10                 # rows of a whole-row block
_SCAN_BLOCK = 4096


def pairs_of(n: Column) -> Column:
    return n.cast("double") * (n.cast("double") - 1) / 2


# ------------------------------------------------------------ value collisions

def value_collisions(sheet: Sheet) -> DataFrame:
    """Cells, distinct values, concentration and colliding pairs per group."""
    c = cells(sheet.rows)
    freq = c.groupBy(*KEY, value_key(F.col("x")).alias("key")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("x").alias("sx"), F.min("x").alias("x")
    )
    places = c.groupBy(*KEY, decimal_places(plain_decimal(F.col("x"))).alias("dp")).agg(
        F.count(F.lit(1)).alias("c")
    )
    modal = places.groupBy(*KEY).agg(F.max_by("dp", F.struct("c", -F.col("dp"))).alias("modal_dp"))
    sums = freq.groupBy(*KEY).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_distinct"),
        F.sum(F.col("c").cast("double") * F.col("c")).alias("_cc"),
        F.sum(pairs_of(F.col("c"))).alias("colliding_pairs"),
        F.count_if(F.col("c") >= 3).alias("over_represented"),
    )
    return (
        sums.join(modal, KEY)
        .withColumn("hhi", F.col("_cc") / (F.col("n").cast("double") * F.col("n")))
        .withColumn("all_pairs", pairs_of(F.col("n")))
        .drop("_cc")
    )


@F.pandas_udf(T.DoubleType())
def _fitted_match(values: pd.Series, counts: pd.Series) -> pd.Series:
    """Match probability under the better of a Poisson and a negative binomial."""
    return pd.Series([_match_probability(v, c) for v, c in zip(values, counts, strict=True)], dtype=float)


def _match_probability(values, counts) -> float:
    k, c = np.asarray(values, float), np.asarray(counts, float)
    n = c.sum()
    mu = float((k * c).sum() / n)
    var = float((c * (k - mu) ** 2).sum() / max(n - 1, 1))
    top = int(min(np.ceil(max(k.max(), mu + 6 * np.sqrt(var))) + 1, 100_000))
    grid = np.arange(max(0, int(np.floor(k.min()))), top + 1, dtype=float)
    whole = np.maximum(np.floor(k + 0.5), 0)

    def poisson(x):
        return np.where(x >= 0, -mu + x * np.log(max(mu, 1e-300)) - lgamma(x + 1), -np.inf)

    best, law = float((c * poisson(whole)).sum()), poisson
    if var > mu > 0:
        r, q = mu * mu / (var - mu), (var - mu) / var

        def negative_binomial(x):
            return lgamma(x + r) - lgamma(x + 1) - lgamma(r) + x * np.log(q) + r * np.log(1 - q)

        if float((c * negative_binomial(whole)).sum()) > best:
            law = negative_binomial
    logs = law(grid)
    match = float(np.exp(2 * logs[logs > -50]).sum())
    return float(min(1.0, max(match, 1.0 / (top + 1))))


def _collision_p(sheet: Sheet) -> DataFrame:
    sums = value_collisions(sheet)
    small = sums.where((F.col("modal_dp") == 0) & (F.col("n") <= FIT_LIMIT)).select(*KEY)
    # At most FIT_LIMIT distinct values reach each list.
    lists = (
        cells(sheet.rows).join(small, KEY).groupBy(*KEY, "x").agg(F.count(F.lit(1)).alias("c"))
        .groupBy(*KEY).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("x", "c"))), lambda s: s["x"]).alias("xs"),
            F.transform(F.array_sort(F.collect_list(F.struct("x", "c"))), lambda s: s["c"].cast("double")).alias("cs"),
        )
        .select(*KEY, _fitted_match("xs", "cs").alias("fitted"))
    )
    out = sums.join(lists, KEY, "left").withColumn("p1", F.coalesce("fitted", "hhi"))
    return out.withColumn(
        "collision_p",
        F.when(F.col("all_pairs") > 0, special.binomial_tail("colliding_pairs", "all_pairs", "p1"))
        .otherwise(1.0),
    )


# ------------------------------------------------------------- identical rows

def column_concentration(sheet: Sheet) -> DataFrame:
    """HHI of each column over its values, and over all rows with every missing
    cell counted as a value of its own."""
    freq = cells(sheet.rows).groupBy(*KEY, "col", value_key(F.col("x")).alias("key")).agg(
        F.count(F.lit(1)).alias("c")
    )
    per_col = freq.groupBy(*KEY, "col").agg(
        F.sum("c").alias("n_col"), F.sum(F.col("c").cast("double") * F.col("c")).alias("cc"),
        F.max("c").alias("top"),
    )
    sizes = sheet_sizes(sheet.rows)
    r = F.col("n_rows").cast("double")
    return per_col.join(sizes, KEY).select(
        *KEY, "col", "n_col", "top", "n_rows", "n_cols",
        (F.col("cc") / (F.col("n_col").cast("double") * F.col("n_col"))).alias("hhi"),
        ((F.col("cc") + (r - F.col("n_col"))) / (r * r)).alias("row_hhi"),
    )


def duplicate_rows(sheet: Sheet) -> DataFrame:
    """Groups of rows equal in every column at four decimals."""
    keyed = sheet.rows.withColumn("_k", F.transform("vals", lambda v: value_key(v)))
    return (
        keyed.groupBy(*KEY, "_k").agg(
            F.count(F.lit(1)).alias("n_copies"), F.min("row_idx").alias("first_row"),
            F.max("row_idx").alias("last_row"),
            F.max(F.size(present("vals"))).alias("n_present"), F.max(F.size("vals")).alias("n_cols"),
        )
        .where((F.col("n_copies") >= 2) & (F.col("n_present") > F.col("n_cols") * 0.5))
        .drop("_k", "n_present")
    )


def _log_product(col: str) -> Column:
    return F.exp(F.sum(F.log(F.greatest(F.col(col), F.lit(1e-300)))))


def _row_p(sheet: Sheet) -> DataFrame:
    dup = duplicate_rows(sheet).groupBy(*KEY).agg(
        F.sum(F.col("n_copies") - 1).alias("extra_rows"),
        F.sum(pairs_of(F.col("n_copies"))).alias("row_pairs"),
    )
    chance = column_concentration(sheet).groupBy(*KEY).agg(
        _log_product("row_hhi").alias("p_row"), F.max("n_rows").alias("n_rows")
    )
    return chance.join(dup, KEY, "left").withColumn(
        "row_p",
        F.when(F.col("row_pairs") > 0, special.binomial_tail("row_pairs", pairs_of(F.col("n_rows")), "p_row"))
        .otherwise(1.0),
    ).select(*KEY, "extra_rows", "row_p")


# ---------------------------------------------------------- within-row matches

def _bin_sums(vals: np.ndarray, keys: np.ndarray, valid: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows, pairs, matches and expected matches of each bin of these rows,
    sorted by bin; ``starts`` are the first rows of the bins."""
    width = vals.shape[1]
    sizes = np.diff(np.append(starts, len(vals)))
    n_valid = np.add.reduceat(valid, starts, axis=0, dtype=np.int64)
    row, col = np.nonzero(valid)
    owner, key = np.repeat(np.arange(len(starts)), sizes)[row], keys[valid]
    order = np.lexsort((key, owner))
    owner, key, col = owner[order], key[order], col[order]
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]))[:len(owner)]
    value = np.cumsum(fresh) - 1
    share = np.bincount(value * width + col, minlength=int(fresh.sum()) * width).reshape(-1, width)
    several = (share > 0).sum(axis=1) >= 2  # a value of one column meets no other
    owner = owner[fresh][several]
    share = share[several] / np.maximum(n_valid[owner], 1)
    held, first = np.unique(owner, return_index=True)
    pairs, matches = np.zeros((2, len(starts)), np.int64)
    expected = np.zeros(len(starts))
    for c in range(width - 1):
        both = valid[:, c, None] & valid[:, c + 1:]
        x, y = vals[:, c, None], vals[:, c + 1:]
        equal = both & ((x == y) | (np.isnan(x) & np.isnan(y)))
        complete = np.add.reduceat(both, starts, axis=0, dtype=np.int64)
        pairs += complete.sum(axis=1)
        matches += np.add.reduceat(equal, starts, axis=0, dtype=np.int64).sum(axis=1)
        if len(held):
            chance = np.add.reduceat(share[:, c, None] * share[:, c + 1:], first, axis=0)
            expected[held] += (complete[held] * chance).sum(axis=1)
    return sizes, pairs, matches, np.where(sizes >= 2, expected, 0.0)


def _scan_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of bins whose rows (KEY, bin, vals, keys) follow each other; the
    last bin of a batch waits for the next."""
    names = [*KEY, "bin", "n_rows", "n_pairs", "matches", "expected"]

    def sums(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        lists = rows.column(3)
        widths = lists.value_lengths().to_numpy()
        width = int(widths.max())
        if width < 2:
            return
        inside = np.arange(width) < widths[:, None]
        cell = lists.flatten()
        valid = np.zeros(inside.shape, bool)
        valid[inside] = cell.is_valid().to_numpy(zero_copy_only=False)
        vals, keys = np.zeros(inside.shape), np.zeros(inside.shape, np.int64)
        vals[inside] = cell.fill_null(0.0).to_numpy()
        keys[inside] = rows.column(4).flatten().fill_null(0).to_numpy()
        ends = np.append(starts[1:], rows.num_rows)
        lo = 0
        while lo < len(starts):  # so many bins that the arrays of pairs stay small
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _PAIR_CELLS // width**2, side="right")))
            part = slice(starts[lo], ends[hi - 1])
            sizes, pairs, matches, expected = _bin_sums(vals[part], keys[part], valid[part], starts[lo:hi] - starts[lo])
            some = pairs > 0
            at = pa.array(starts[lo:hi][some])
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(k).take(at) for k in range(3)), *(pa.array(x[some]) for x in (sizes, pairs, matches, expected))], names)
            lo = hi

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for k in range(3):
            new[1:] |= pc.not_equal(rows.column(k).slice(1), rows.column(k).slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield from sums(rows.slice(0, starts[-1]), starts[:-1])
        held = rows.slice(starts[-1])
    if held is not None:
        yield from sums(held, np.zeros(1, np.int64))


def within_row_bins(sheet: Sheet) -> DataFrame:
    """Observed and expected equal pairs per bin of 30 rows of similar mean.

    The rows of a bin meet once; cells and pairs are counted where they are.
    """
    rows = sheet.rows.withColumn("_m", mean(present("vals"))).where(F.col("_m").isNotNull())
    placed = ordinal(rows.select(*KEY, "row_idx", "vals", "_m"), KEY, ["_m", "row_idx"], "_o", "row-means")
    dealt = placed.select(*KEY, F.floor(F.col("_o") / BIN_ROWS).alias("bin"), "vals").repartition(*KEY, "bin")
    keyed = dealt.sortWithinPartitions(*KEY, "bin").select(*KEY, "bin", "vals", F.transform("vals", value_key).alias("keys"))
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}
    return keyed.mapInArrow(_scan_bins, ", ".join([
        *(f"{k} {kinds[k]}" for k in [*KEY, "bin"]), "n_rows long, n_pairs long, matches long, expected double"]))


def _within_row_p(sheet: Sheet) -> DataFrame:
    sums = within_row_bins(sheet).groupBy(*KEY).agg(
        F.sum("n_pairs").alias("wr_pairs"), F.sum("matches").alias("wr_matches"),
        F.sum("expected").alias("wr_expected"),
    )
    rate = F.col("wr_expected") / F.col("wr_pairs")
    chance = F.when(rate <= 0, F.lit(1e-300)).when(rate >= 1, F.lit(1 - 1e-12)).otherwise(rate)
    return sums.withColumn(
        "within_p",
        F.when(F.col("wr_matches") > 0, special.binomial_tail("wr_matches", "wr_pairs", chance)).otherwise(1.0),
    )


# ---------------------------------------------------------------- offset scans

def offset_limit(n_rows: Column) -> Column:
    return F.when(n_rows > FREE_OFFSET_ROWS, F.least(n_rows - 1, F.lit(MAX_OFFSET))).otherwise(n_rows - 1)


def offset_runs(sheet: Sheet, by_column: bool) -> DataFrame:
    """Runs of rows i with row i equal to row i+d, for every offset d in reach.

    ``by_column``: one run per column, with the number of value changes inside.
    Otherwise a run keeps the same set of at least two matching columns.

    Rows are dealt into blocks, each with the next rows in reach copied in, and
    a block compares all its offsets with array operations; work is rows x
    offsets however often a value repeats, and only runs leave the task. Runs
    cut by a block edge are stitched afterwards.
    """
    # Written, the sizes are known to be small: rows and runs aren't dealt by group to meet them.
    sizes = materialize(sheet_sizes(sheet.rows).select(*KEY, "n_rows", offset_limit(F.col("n_rows")).alias("reach")), "reaches")
    rows = sheet.rows.select(*KEY, "row_idx", "vals").join(sizes, KEY)
    spread, _, _ = with_halo(
        rows, KEY, "row_idx", before=1, after=max(MAX_OFFSET, FREE_OFFSET_ROWS - 1), block=_SCAN_BLOCK
    )
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in KEY)
    schema = (f"{key_types}, d int, cols array<int>, lo bigint, hi bigint, changes bigint, "
              "change_at_lo int, starts_open boolean, ends_open boolean")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx")
        vals = np.array(list(pdf["vals"]), dtype=float)
        return _scan_block(
            vals, pdf["row_idx"].to_numpy(), int(pdf["_blk"].iloc[0]), int(pdf["reach"].iloc[0]),
            tuple(pdf[k].iloc[0] for k in KEY), by_column,
        )

    pieces = materialize(spread.groupBy(*KEY, "_blk").applyInPandas(scan, schema), "offset-runs")
    unit = [*KEY, "d", "cols"]
    across = Window.partitionBy(*unit).orderBy("lo")
    open_pieces = pieces.where("starts_open or ends_open").withColumn(
        "_new",
        F.when(F.col("starts_open") & F.lag("ends_open").over(across)
               & (F.col("lo") == F.lag("hi").over(across) + 1), 0).otherwise(1),
    )
    open_pieces = open_pieces.withColumn(
        "_run", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0))
    )
    stitched = open_pieces.groupBy(*unit, "_run").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        (F.sum("changes") + F.sum(F.when(F.col("_new") == 0, F.col("change_at_lo")).otherwise(0))).alias("changes"),
    ).drop("_run")
    closed = pieces.where("not starts_open and not ends_open").select(*unit, "lo", "hi", "changes")
    runs = stitched.unionByName(closed).withColumn("height", F.col("hi") - F.col("lo") + 1)
    return runs.join(sizes, KEY)


def _scan_block(vals, idx, blk, reach, key, by_column) -> pd.DataFrame:
    columns = [*KEY, "d", "cols", "lo", "hi", "changes", "change_at_lo", "starts_open", "ends_open"]
    out: list[list] = []
    base, end = blk * _SCAN_BLOCK, (blk + 1) * _SCAN_BLOCK
    first = int(np.searchsorted(idx, base))
    last = int(np.searchsorted(idx, end))      # own rows are [first, last)
    n, p = vals.shape
    shift = np.zeros((n, p), dtype=np.int64)
    shift[1:] = vals[1:] != vals[:-1]
    changes = np.cumsum(shift, axis=0)
    coded = not by_column and p <= 62
    columns_ = np.ascontiguousarray(vals.T)
    bits = np.uint8 if p <= 8 else np.int64
    for d in range(1, reach + 1):
        stop = min(last, n - d)
        if stop <= first:
            break
        if coded:
            # Bit c of a row's code: column c is equal. Only runs that are sent are looked at one by one.
            code = np.zeros(stop - first, bits)
            for c in range(p):
                code |= (columns_[c, first:stop] == columns_[c, first + d:stop + d]).astype(bits) << bits(c)
            code[code & (code - bits(1)) == 0] = 0
            if not code.any():
                continue
            cut = np.concatenate(([0], np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]))
            starts, ends, held = cut[:-1], cut[1:], code[cut[:-1]].astype(np.int64)
            width = sum((held >> c) & 1 for c in range(p))
            at_start, at_end = (starts == 0) & (base > 0), first + ends == last
            tall = (ends - starts >= 2) & ((ends - starts) * width >= MIN_BLOCK_CELLS)
            for k in np.flatnonzero((held > 0) & (at_start | at_end | tall)):
                out.append([*key, d, [c for c in range(p) if held[k] >> c & 1], int(idx[first + starts[k]]),
                            int(idx[first + ends[k] - 1]), 0, 0, bool(at_start[k]), bool(at_end[k])])
            continue
        same = vals[first:stop] == vals[first + d:stop + d]
        if by_column:
            if not same.any():
                continue
            for c in np.flatnonzero(same.any(axis=0)):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], same[:, c].view(np.int8), [0]))))
                for s, e in zip(edge[::2], edge[1::2], strict=True):
                    lo, hi = first + s, first + e - 1
                    at_start, at_end = lo == first and base > 0, hi == last - 1
                    if not (at_start or at_end) and (e - s < 3 or changes[hi, c] == changes[lo, c]):
                        continue
                    out.append([*key, d, [int(c)], int(idx[lo]), int(idx[hi]),
                                int(changes[hi, c] - changes[lo, c]), int(shift[lo, c]),
                                bool(at_start), bool(at_end)])
        else:
            wide = same.sum(axis=1) >= 2
            if not wide.any():
                continue
            code = np.array([hash(r.tobytes()) for r in same])
            code = np.where(wide, code, -1)
            cut = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True])))
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if not wide[s]:
                    continue
                lo, hi = first + s, first + e - 1
                at_start, at_end = lo == first and base > 0, hi == last - 1
                cols = np.flatnonzero(same[s])
                if not (at_start or at_end) and (e - s < 2 or (e - s) * len(cols) < MIN_BLOCK_CELLS):
                    continue
                out.append([*key, d, [int(c) for c in cols], int(idx[lo]), int(idx[hi]), 0, 0,
                            bool(at_start), bool(at_end)])
    return pd.DataFrame(out, columns=columns)


def opportunities(n_rows: Column, height: Column, reach: Column) -> Column:
    """Row pairs at which a block of ``height`` could start: sum over offsets."""
    m = F.greatest(F.lit(0), F.least(reach, n_rows - height)).cast("double")
    total = m * (n_rows - height + 1).cast("double") - m * (m + 1) / 2
    return F.greatest(F.lit(1.0), total)


def not_dominated(runs: DataFrame, unit: list[str]) -> DataFrame:
    """Drops a run whose source and destination lie inside those of a run at
    least as long whose columns include its own.

    A covering run is met through the cells its source passes through. Short
    runs, of which a sheet may hold many at each place, meet by the cells of
    their destination as well, so that a row copied often brings no pairs of
    copies that lie apart.
    """
    reach = F.col("hi") - F.col("lo") + 1 <= SHORT
    cell, to = F.floor(F.col("lo") / SHORT), F.floor((F.col("lo") + F.col("d")) / SHORT)
    brief = _covering(runs.where(reach), unit, SHORT).withColumn(
        "_to", F.explode(F.sequence(F.floor((F.col("b_lo") + F.col("b_d")) / SHORT), F.floor((F.col("b_hi") + F.col("b_d")) / SHORT))))
    left = _uncovered(runs.withColumn("_cell", cell).withColumn("_to", to), brief, [*unit, "_cell", "_to"])
    wide = _covering(runs.where(~reach), unit, 256)
    return _uncovered(left.withColumn("_cell", F.floor(F.col("lo") / 256)), wide, [*unit, "_cell"])


def _covering(runs: DataFrame, unit: list[str], rows: int) -> DataFrame:
    """``runs`` once per cell of ``rows`` rows that their source passes through."""
    return runs.select(
        *unit, F.col("cols").alias("b_cols"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.col("d").alias("b_d"),
        F.explode(F.sequence(F.floor(F.col("lo") / rows), F.floor(F.col("hi") / rows))).alias("_cell"),
    )


def _uncovered(small: DataFrame, big: DataFrame, keys: list[str]) -> DataFrame:
    inside = (
        (F.col("b_lo") <= F.col("lo")) & (F.col("b_hi") >= F.col("hi"))
        & (F.col("b_lo") + F.col("b_d") <= F.col("lo") + F.col("d"))
        & (F.col("b_hi") + F.col("b_d") >= F.col("hi") + F.col("d"))
        & ((F.col("b_hi") - F.col("b_lo") > F.col("hi") - F.col("lo"))
           | (F.size("b_cols") > F.size("cols")))
        & (F.size(F.array_except("cols", "b_cols")) == 0)
    )
    on = inside
    for k in keys:
        on = on & (small[k] == big[k])
    return small.join(big, on, "left_anti").drop("_cell", "_to")


def far_column_runs(sheet: Sheet, paired: bool = False) -> DataFrame:
    """Maximal runs of a column that recur further away than the scanned
    offsets: those in which some window of ``recurrence.gram_rows`` rows, with
    two values or more, has its nearest earlier occurrence at that offset.
    ``paired`` may leave out runs that share no row with a run of another
    column at their offset."""
    conc = column_concentration(sheet).select(
        *KEY, "col", "n_rows", offset_limit(F.col("n_rows")).alias("reach"), recurrence.gram_rows(F.col("n_rows"), F.col("hhi")).alias("gram"),
        F.col("n_cols"))
    by_col = F.map_from_entries(F.collect_list(F.struct("col", "gram")))
    lengths = conc.where(F.col("n_rows") - 1 > F.col("reach")).groupBy(*KEY, "n_rows", "n_cols", "reach").agg(by_col.alias("_g"))
    # A column without a value has no windows.
    grams = F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda c: F.coalesce(F.element_at(F.col("_g"), c), F.lit(0)))
    lengths = materialize(lengths.select(*KEY, F.col("reach").cast("long").alias("reach"), grams.alias("grams")), "gram-rows")
    found = materialize(recurrence.recurrences(sheet, lengths, paired=paired), "recurrences")
    return recurrence.extended(sheet, found)


def _priced_far(sheet: Sheet, runs: DataFrame) -> DataFrame:
    """Far runs with the sheet's rows; all offsets count as tried."""
    sizes = materialize(sheet_sizes(sheet.rows).select(*KEY, "n_rows", (F.col("n_rows") - 1).alias("reach")), "far-reaches")
    return runs.withColumn("height", F.col("hi") - F.col("lo") + 1).join(sizes, KEY)


def sequential_runs(sheet: Sheet, far: DataFrame | None = None) -> DataFrame:
    """Runs of three or more values, two of them distinct, that recur in the
    same column at a fixed offset, near or far."""
    runs = offset_runs(sheet, by_column=True)
    near = runs.where((F.col("height") >= 3) & (F.col("changes") >= 1)).withColumn("col", F.col("cols")[0])
    far = materialize(far_column_runs(sheet), "far-column-runs") if far is None else far
    counted = _priced_far(sheet, recurrence.with_changes(sheet, far)).withColumn("cols", F.array("col"))
    return near.withColumn("d", F.col("d").cast("long")).unionByName(counted.select(*near.columns))


def sequential_duplication(sheet: Sheet) -> Outcome:
    test = "Sequential Duplication"
    hhi = materialize(column_concentration(sheet).select(*KEY, "col", "hhi"), "column-shares")
    runs = sequential_runs(sheet).join(hhi, [*KEY, "col"])
    chance = F.pow("hhi", F.col("height")) * opportunities(F.col("n_rows"), F.col("height"), F.col("reach"))
    runs = materialize(runs.withColumn("p", F.least(F.lit(1.0), chance)), "sequences")
    kept = materialize(not_dominated(runs, [*KEY, "col"]), "sequences-kept")
    sums = kept.groupBy(*KEY).agg(
        F.min("p").alias("p"), F.count(F.lit(1)).alias("n_sequences"),
        F.max_by("height", -F.col("p")).alias("top_height"), F.max_by("d", -F.col("p")).alias("top_offset"),
    )
    every = sheet_sizes(sheet.rows).join(sums, KEY, "left")
    p = F.coalesce("p", F.lit(1.0))
    result = result_rows(
        every, test, flag_from_p(p), p,
        {"sequences": F.coalesce("n_sequences", F.lit(0)), "top_height": F.col("top_height"),
         "top_offset": F.col("top_offset")},
        na_cause=F.when(F.col("n_rows") < 4, "tooFewRows"), na_observed=F.col("n_rows"), na_minimum=4.0,
    )
    return Outcome(
        lambda: unit_rows(
            kept, test, F.concat(F.lit("offset "), F.col("d")), F.col("height"),
            raw_p=F.col("p"), row_lo=F.col("lo"), row_hi=F.col("hi"), cols=F.col("cols"),
        ),
        result,
    )


# ----------------------------------------------------------------- block copies

def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def full_row_blocks(sheet: Sheet) -> DataFrame:
    """Blocks of 2 to 10 whole rows that occur again anywhere, tallest first;
    every later copy is paired with the first one.

    Equal rows are named by the first of them, and so are equal blocks of each
    height: a block is the name of all its rows but the last, and that of the
    last, so only rows whose blocks recur go on to the next height. A block
    counts where some row of some copy lies in no taller one; that copy's own
    tallest block is then this one.
    """
    sizes = materialize(sheet_sizes(sheet.rows), "sheet-sizes")
    keyed = sheet.rows.select(
        *KEY, "row_idx", F.transform("vals", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v)).alias("_v"),
        (F.size(present("vals")) > F.size("vals") * 0.5).alias("_dense"), F.size("vals").alias("_width"),
    )
    # Only rows that have an equal row somewhere can be part of a block.
    again = keyed.groupBy(*KEY, "_v").agg(F.count(F.lit(1)).alias("_n"), F.min("row_idx").alias("_id")).where("_n >= 2").drop("_n")
    hits = materialize(keyed.join(again, [*KEY, "_v"]).drop("_v"), "repeated-rows")
    spread, window, own = with_halo(hits, KEY, "row_idx", after=TALLEST - 1)
    block = F.collect_list(F.struct("row_idx", "_id")).over(window.rangeBetween(0, TALLEST - 1))
    chains = spread.withColumn("_c", block).where(own & F.col("_dense"))
    # Rows of the block must be consecutive.
    run = F.transform(F.filter("_c", lambda s, i: s["row_idx"] == F.col("row_idx") + i), lambda s: s["_id"])
    high = F.least(F.size("_c"), F.floor(F.col("n_rows") / 2)).cast("int")
    tall = chains.withColumn("_c", run).join(sizes.select(*KEY, "n_rows"), KEY).where(high >= 2)
    # Names of the rows of the tallest block that could start here.
    grams = materialize(tall.select(*KEY, "row_idx", "_width", F.slice("_c", F.lit(1), high).alias("_g")), "grams")
    left = grams.select(*KEY, "row_idx", "_width", F.get("_g", F.lit(0)).alias("_name"), F.slice("_g", F.lit(2), F.lit(TALLEST)).alias("_rest"))
    levels: list[DataFrame] = []
    ended: list[DataFrame] = []
    own_tallest = [*KEY, "row_idx", F.col("_name").alias("first_row")]
    for h in range(2, TALLEST + 1):
        # A row without a further one has no name to meet.
        further = left.withColumn("_next", F.get("_rest", F.lit(0)))
        classes = further.where("_next IS NOT NULL").groupBy(*KEY, "_name", "_next").agg(
            F.min("row_idx").alias("first_row"), F.count(F.lit(1)).alias("n_copies")).where("n_copies >= 2").drop("n_copies")
        met = materialize(further.join(classes, [*KEY, "_name", "_next"], "left").drop("_next"), f"blocks-of-{h}-rows")
        if h > 2:
            ended.append(met.where("first_row IS NULL").drop("first_row").select(*own_tallest, F.lit(h - 1).alias("_t")))
        met = met.where("first_row IS NOT NULL")
        levels.append(met.select(*KEY, "row_idx", "_width", "first_row", F.lit(h).alias("h")))
        left = met.select(*KEY, "row_idx", "_width", F.col("first_row").alias("_name"),
                          F.slice("_rest", F.lit(2), F.lit(TALLEST)).alias("_rest"))
        if left.isEmpty():
            break
    ended.append(left.select(*own_tallest, F.lit(h).alias("_t")))
    starts = _united(ended)
    # The tallest block over each row of a start's own tallest one.
    spread, window, own = with_halo(starts, KEY, "row_idx", before=TALLEST - 1, after=TALLEST - 1)
    near = F.collect_list(F.struct(F.col("row_idx").alias("at"), F.col("_t").alias("t"))).over(window.rangeBetween(1 - TALLEST, TALLEST - 1))
    over = F.transform(F.sequence(F.lit(0), F.col("_t") - 1), lambda k: F.array_max(F.transform(
        F.filter("_near", lambda s: (s["at"] <= F.col("row_idx") + k) & (s["at"] + s["t"] > F.col("row_idx") + k)), lambda s: s["t"])))
    fresh = spread.withColumn("_near", near).where(own).where(F.array_min(over) <= F.col("_t"))
    fresh = materialize(fresh.select(*KEY, F.col("_t").alias("h"), "first_row").distinct(), "fresh-blocks")
    kept = _united(levels).where("row_idx > first_row").join(fresh, [*KEY, "h", "first_row"], "left_semi").join(
        sizes.select(*KEY, "n_rows"), KEY)
    return kept.select(
        *KEY, F.lit("full-row").alias("kind"), F.col("first_row").alias("lo"),
        (F.col("first_row") + F.col("h") - 1).alias("hi"),
        (F.col("row_idx") - F.col("first_row")).alias("d"), F.col("h").cast("bigint").alias("height"),
        F.sequence(F.lit(0), F.col("_width") - 1).alias("cols"), "n_rows",
        (F.col("n_rows") - 1).alias("reach"),
    )


def partial_blocks(sheet: Sheet, far: DataFrame | None = None) -> DataFrame:
    """Blocks of at least 2x2 and six cells, not whole rows, that recur at a
    fixed offset in the same columns. Beyond the scanned offsets, a block is
    made of columns whose own runs recur there."""
    sizes = sheet_sizes(sheet.rows).select(*KEY, "n_cols")
    near = offset_runs(sheet, by_column=False)
    far = materialize(far_column_runs(sheet, paired=True), "far-column-runs") if far is None else far
    wide = _priced_far(sheet, recurrence.column_sets(far))
    shared = [*KEY, "d", "cols", "lo", "hi", "height", "n_rows", "reach"]
    runs = near.withColumn("d", F.col("d").cast("long")).select(*shared).unionByName(wide.select(*shared)).join(sizes, KEY)
    return runs.where(
        (F.col("height") >= 2) & (F.size("cols") < F.col("n_cols"))
        & (F.col("height") * F.size("cols") >= MIN_BLOCK_CELLS)
    ).select(*KEY, F.lit("partial").alias("kind"), "lo", "hi", "d", "height", "cols", "n_rows", "reach")


def column_streaks(sheet: Sheet) -> DataFrame:
    """Stretches of three or more rows in which two columns are equal."""
    equal = pair_values(sheet.rows).where(F.col("a") == F.col("b"))
    runs = islands(equal, [*KEY, "c1", "c2"], "row_idx").where(F.col("length") >= 3)
    # Written, the sizes are known to be small: runs aren't dealt by group to meet them.
    sizes = materialize(sheet_sizes(sheet.rows), "streak-sizes")
    return runs.join(sizes, KEY).select(
        *KEY, F.lit("column").alias("kind"), "lo", "hi", F.lit(0).alias("d"),
        F.col("length").alias("height"), F.array("c1", "c2").alias("cols"), "n_rows", "n_cols",
    )


def column_overlap(sheet: Sheet) -> DataFrame:
    """Chance that two columns show the same value in a random row."""
    conc = column_concentration(sheet).select(*KEY, "col", "n_col")
    freq = cells(sheet.rows).groupBy(*KEY, "col", value_key(F.col("x")).alias("key")).agg(
        F.count(F.lit(1)).alias("c")
    ).join(conc, [*KEY, "col"]).withColumn("s", F.col("c") / F.col("n_col"))
    # One entry per column and value: bounded by the sheet's width.
    together = freq.groupBy(*KEY, "key").agg(F.array_sort(F.collect_list(F.struct("col", "s"))).alias("e"))
    meets = F.flatten(F.transform("e", lambda p: F.transform(
        F.filter("e", lambda q: q["col"] > p["col"]),
        lambda q: F.struct(p["col"].alias("c1"), q["col"].alias("c2"), (p["s"] * q["s"]).alias("pm")),
    )))
    return (
        together.where(F.size("e") >= 2).select(*KEY, F.explode(meets).alias("m")).select(*KEY, "m.*")
        .groupBy(*KEY, "c1", "c2").agg(F.sum("pm").alias("overlap"))
    )


def block_copies(sheet: Sheet) -> DataFrame:
    """All three kinds of copied block with the chance of seeing each."""
    rows_blocks = materialize(full_row_blocks(sheet).unionByName(partial_blocks(sheet)), "blocks")
    rows_blocks = not_dominated(rows_blocks, KEY)
    hhi = column_concentration(sheet).groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("col", "hhi"))).alias("hhis")
    )
    row_chance = F.aggregate(
        "cols", F.lit(1.0), lambda acc, c: acc * F.coalesce(F.element_at(F.col("hhis"), c), F.lit(1.0))
    )
    priced = rows_blocks.join(hhi, KEY).withColumn(
        "p", F.least(F.lit(1.0), F.pow(row_chance, F.col("height"))
                     * opportunities(F.col("n_rows"), F.col("height"), F.col("reach"))),
    ).drop("hhis", "reach", "n_rows")
    streaks = column_streaks(sheet).withColumn("c1", F.col("cols")[0]).withColumn("c2", F.col("cols")[1])
    n_pairs = F.col("n_cols") * (F.col("n_cols") - 1) / 2
    priced_cols = streaks.join(column_overlap(sheet), [*KEY, "c1", "c2"], "left").withColumn(
        "p",
        F.least(F.lit(1.0), F.pow(F.coalesce("overlap", F.lit(0.0)), F.col("height")) * n_pairs
                * F.greatest(F.lit(1), F.col("n_rows") - F.col("height") + 1)),
    ).select(*priced.columns)
    return priced.unionByName(priced_cols)


# ---------------------------------------------------------- partly copied rows

def _row_cells(sheet: Sheet, narrow: bool) -> DataFrame:
    """(KEY, row_idx, e): cells of each row as (col, key, hhi, hot, n), by
    column. A column is hot where one value covers more than 2% of the rows.
    Other cells whose value occurs once agree with none and are left out.
    ``narrow`` picks the sheets of up to EXACT_SUBSET_COLUMNS columns, or the others."""
    conc = column_concentration(sheet)
    width = F.col("n_cols") <= EXACT_SUBSET_COLUMNS
    by_col = materialize(conc.where(width if narrow else ~width).select(
        *KEY, "col", "hhi", (F.col("top") > HOT_SHARE * F.col("n_rows")).alias("hot")), "concentration")
    c = cells(sheet.rows).select(*KEY, "row_idx", "col", value_key(F.col("x")).alias("key"))
    repeated = c.groupBy(*KEY, "col", "key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").join(by_col, [*KEY, "col"])
    live = c.join(repeated, [*KEY, "col", "key"]).groupBy(*KEY, "row_idx").agg(
        F.array_sort(F.collect_list(F.struct("col", "key", "hhi", "hot", "n"))).alias("e"))
    return live.where(F.size(F.filter("e", lambda x: ~x["hot"])) >= MIN_AGREEING)


def _chance(cells_: Column) -> Column:
    return F.aggregate(cells_, F.lit(1.0), lambda a, x: a * x["hhi"])


def partial_row_groups(sheet: Sheet) -> DataFrame:
    """Sets of rows of sheets of up to ten columns that agree on four or more
    columns that aren't hot, and on the hot columns named with them.

    A row's cells are expanded into the subsets that hold four cells of
    columns that aren't hot, and equal subsets meet by grouping, so no pair of
    rows is ever formed.
    """
    live = _row_cells(sheet, narrow=True)
    masks = F.sequence(F.lit(1), F.pow(F.lit(2.0), F.size("e")).cast("int") - 1)
    chosen = F.transform(masks, lambda m: F.filter("e", lambda _, i: m.bitwiseAND(F.pow(F.lit(2.0), i).cast("int")) != 0))
    usable = F.filter(chosen, lambda s: F.size(F.filter(s, lambda x: ~x["hot"])) >= MIN_AGREEING)
    each = live.select(*KEY, F.explode(usable).alias("s"), "row_idx").select(
        *KEY, "row_idx", F.transform("s", lambda x: x["col"]).alias("cols"), F.transform("s", lambda x: x["key"]).alias("keys"),
        F.exists("s", lambda x: x["hot"]).alias("with_hot"), _chance(F.col("s")).alias("chance"))
    return each.groupBy(*KEY, "cols", "keys").agg(
        F.count(F.lit(1)).alias("n_copies"), F.min("row_idx").alias("first_row"),
        F.max("row_idx").alias("last_row"), F.max("chance").alias("chance"), F.max("with_hot").alias("with_hot"),
    ).where("n_copies >= 2").drop("keys")


def partial_row_pairs(sheet: Sheet) -> DataFrame:
    """(KEY, a, b, n_a, n_b, n_agree, chance): pairs of different rows of
    sheets of more than ten columns that agree on four or more columns that
    aren't hot. Equal rows are one, named by the first (``n_`` of them);
    ``a`` = ``b`` stands for the pairs among them. ``chance`` multiplies the
    concentrations of all columns in which the pair agrees.

    Two rows that agree on four of their m cells share k of the m - 4 + k
    rarest, in any order that all rows follow, so a row is filed under every k
    of these. k, from 1 to 4, is the fewest cells that few rows of a sheet
    share by chance, so that values of many rows bring no long lists; the
    pairs are the same for any k.
    """
    live = _row_cells(sheet, narrow=False)
    bare = F.transform("e", lambda x: F.struct(x["col"].alias("col"), x["key"].alias("key")))
    rows = materialize(live.groupBy(*KEY, bare.alias("cells")).agg(
        F.min("row_idx").alias("a"), F.count(F.lit(1)).alias("n"), F.min("e").alias("e")), "partial-rows")
    cool = F.filter("e", lambda x: ~x["hot"])
    # Chance that two rows agree on a cell: the mean concentration of the columns at hand.
    share = rows.select(*KEY, F.explode(cool).alias("x")).groupBy(*KEY).agg(F.avg("x.hhi").alias("hhi"))
    plan = share.join(sheet_sizes(sheet.rows), KEY)
    k = F.greatest(F.lit(1), F.least(F.lit(MIN_AGREEING), F.ceil(F.log(F.col("n_rows") / FEW_ROWS) / -F.log(F.least("hhi", F.lit(0.999))))))
    plan = materialize(plan.select(*KEY, k.cast("int").alias("k")), "partial-plan")
    rarest = F.array_sort(F.transform(cool, lambda x: F.struct(x["n"].alias("n"), x["col"].alias("col"), x["key"].alias("key"))))
    ranked = rows.join(plan, KEY).select(*KEY, "a", "k", rarest.alias("r"))
    filed: DataFrame | None = None
    for size in range(1, MIN_AGREEING + 1):
        part = ranked.where(F.col("k") == size).withColumn("_m", F.size("r") - MIN_AGREEING + size)
        for i in range(size):
            prior = F.col(f"_i{i - 1}") + 1 if i else F.lit(0)
            # Behind the last place there is none, and sequence would count down.
            last = F.col("_m") - size + i
            part = part.withColumn(f"_i{i}", F.explode(F.when(prior <= last, F.sequence(prior, last))))
        key = F.array(*[F.struct(F.get("r", F.col(f"_i{i}"))["col"].alias("col"), F.get("r", F.col(f"_i{i}"))["key"].alias("key"))
                        for i in range(size)])
        part = part.select(*KEY, "a", F.xxhash64(key).alias("h"))
        filed = part if filed is None else filed.unionByName(part)
    several = filed.groupBy(*KEY, "h").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n")
    met = filed.join(several, [*KEY, "h"])
    pairs = met.join(met.withColumnRenamed("a", "b"), [*KEY, "h"]).where("a < b").select(*KEY, "a", "b").distinct()
    left = rows.select(*KEY, "a", F.col("n").alias("n_a"), F.col("e").alias("_x"))
    right = rows.select(*KEY, F.col("a").alias("b"), F.col("n").alias("n_b"), F.col("e").alias("_y"))
    both = pairs.join(left, [*KEY, "a"]).join(right, [*KEY, "b"]).withColumn("_s", F.array_intersect("_x", "_y"))
    same = rows.where("n >= 2").select(*KEY, "a", F.col("a").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.col("e").alias("_s"))
    agree = F.size(F.filter("_s", lambda x: ~x["hot"]))
    shared = [*KEY, "a", "b", "n_a", "n_b", "_s"]
    return both.select(*shared).unionByName(same.select(*shared)).withColumn("n_agree", agree).where(
        F.col("n_agree") >= MIN_AGREEING).withColumn("chance", _chance(F.col("_s"))).drop("_s")


def partial_rows(sheet: Sheet) -> DataFrame:
    """Pairs of rows agreeing on four or more columns, per group: their exact
    number, the smallest p, and the hot columns, which decide no pair but
    count in its p. Narrow sheets count pairs by inclusion and exclusion over
    column subsets, wide ones meet by their rarest cells."""
    groups = partial_row_groups(sheet)
    sizes = sheet_sizes(sheet.rows)
    k = F.size("cols")
    # Pairs agreeing on m columns sit in C(m, k) subsets of size k >= 4; with
    # weights (-1)^(k-4) C(k-1, 3) each is counted once.
    weight = F.when((k - 4) % 2 == 0, 1).otherwise(-1) * ((k - 1) * (k - 2) * (k - 3) / 6)
    narrow = groups.groupBy(*KEY).agg(
        F.sum(F.when(~F.col("with_hot"), weight * pairs_of(F.col("n_copies"))).otherwise(0.0)).alias("n_pairs"),
        F.count_if(~F.col("with_hot")).alias("n_groups"), F.min("chance").alias("chance"),
    )
    each = F.when(F.col("a") == F.col("b"), pairs_of(F.col("n_a"))).otherwise(F.col("n_a").cast("double") * F.col("n_b"))
    wide = partial_row_pairs(sheet).groupBy(*KEY).agg(
        F.sum(each).alias("n_pairs"), F.count(F.lit(1)).alias("n_groups"), F.min("chance").alias("chance"))
    hot = column_concentration(sheet).groupBy(*KEY).agg(F.count_if(F.col("top") > HOT_SHARE * F.col("n_rows")).alias("hot_columns"))
    return sizes.join(narrow.unionByName(wide), KEY, "left").join(hot, KEY, "left").select(
        *KEY, F.coalesce("n_pairs", F.lit(0.0)).alias("n_pairs"),
        F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("hot_columns", F.lit(0)).alias("hot_columns"),
        F.when(F.col("chance").isNull(), 1.0).otherwise(
            F.least(F.lit(1.0), F.col("chance") * pairs_of(F.col("n_rows")))).alias("partial_p"),
    )


# ------------------------------------------------------------------- the test

def exact_duplicates(sheet: Sheet) -> Outcome:
    test = "Exact Duplicate Detection"
    genomics = F.lit(sheet.settings.assay == "genomics")
    blocks = materialize(block_copies(sheet), "block-copies")
    block_p = blocks.groupBy(*KEY).agg(F.min("p").alias("block_p"), F.count(F.lit(1)).alias("n_blocks"))
    base = (
        _collision_p(sheet).join(_row_p(sheet), KEY, "left").join(_within_row_p(sheet), KEY, "left")
        .join(block_p, KEY, "left").join(partial_rows(sheet), KEY, "left")
        .withColumn("within_p", F.when(genomics, 1.0).otherwise(F.coalesce("within_p", F.lit(1.0))))
        .fillna(1.0, ["collision_p", "row_p", "block_p", "partial_p"])
        .fillna(0, ["extra_rows", "wr_matches", "n_blocks", "n_pairs"])
    )
    base = materialize(base, "duplicates")
    names = ["collision_p", "row_p", "within_p", "block_p", "partial_p"]
    # The smallest BH-adjusted p of the five sub-tests, from the sorted array.
    ordered = F.array_sort(F.array(*[F.col(n) for n in names]))
    combined = let(ordered, lambda a: F.array_min(F.transform(a, lambda p, i: p * 5 / (i + 1))))
    base = base.withColumn("p", F.least(F.lit(1.0), combined))
    result = result_rows(
        base, test, flag_from_p(F.col("p")), F.col("p"),
        {"n": F.col("n"), "hhi": F.col("hhi"), "colliding_pairs": F.col("colliding_pairs"),
         "extra_rows": F.col("extra_rows"), "within_row_matches": F.col("wr_matches"),
         "within_row_expected": F.col("wr_expected"), "blocks": F.col("n_blocks"),
         "partial_row_pairs": F.col("n_pairs"), "hot_columns": F.col("hot_columns"), **{n: F.col(n) for n in names}},
    )

    def units() -> DataFrame:
        parts = base.select(*KEY, F.explode(F.array(
            *[F.struct(F.lit(n[:-2]).alias("unit"), F.col(n).alias("raw_p")) for n in names])).alias("u")
        ).select(*KEY, "u.*")
        out = unit_rows(
            bh_small(parts, KEY), test, F.col("unit"), F.lit(None), raw_p=F.col("raw_p"), adj_p=F.col("adj_p"))
        out = out.unionByName(unit_rows(
            blocks, test, F.concat_ws(" ", F.lit("block"), "kind"), F.col("height"), raw_p=F.col("p"),
            row_lo=F.col("lo"), row_hi=F.col("hi"), cols=F.col("cols"),
        ))
        return out.unionByName(unit_rows(
            duplicate_rows(sheet), test, F.lit("identical rows"), F.col("n_copies"),
            row_lo=F.col("first_row"), row_hi=F.col("first_row"),
        ))

    return Outcome(units, result)

