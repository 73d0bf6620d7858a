"""Resampled null distributions.

Results carry the design in ``null_method``. Every draw is seeded by the data
set, test and unit it belongs to, so a retried task or another partitioning
gives the same numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperscope.session import materialize

# Units longer than this are never gathered into one task; their null comes
# from the closed-form tail named in ``null_method``.
MAX_UNIT_ROWS = 4096


def generator(*parts: object) -> np.random.Generator:
    digest = hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(digest, "little")))


def multinomial_mad_p(test: str, probs: np.ndarray, draws: int, seed: int) -> Callable:
    """UDF (dataset, grp, n, mad) -> share of simulated digit tables whose mean
    absolute deviation from ``probs`` reaches the observed one."""

    @F.pandas_udf("double")
    def mad_p(dataset: pd.Series, grp: pd.Series, n: pd.Series, mad: pd.Series) -> pd.Series:
        out = []
        for d, g, size, observed in zip(dataset, grp, n, mad, strict=True):
            if not size or observed is None or not np.isfinite(observed):
                out.append(float("nan"))
                continue
            sims = generator(seed, test, d, g).multinomial(int(size), probs, size=draws) / size
            exceed = int((np.abs(sims - probs).mean(axis=1) >= observed - 1e-15).sum())
            out.append((exceed + 1) / (draws + 1))
        return pd.Series(out, dtype=float)

    return mad_p


def permutation_exceedances(
    units: DataFrame,
    unit: Sequence[str],
    *,
    test: str,
    seed: int,
    draws: Callable[[int], int],
    statistic: Callable[[dict, np.ndarray, np.random.Generator], np.ndarray],
    array_columns: Sequence[str],
    observed: str,
    scalars: Sequence[str] = (),
    chunk: int = 100,
) -> DataFrame:
    """Row-shuffle null for bounded units.

    ``units`` has one row per unit of at most MAX_UNIT_ROWS positions:
    ``array_columns`` hold the series and ``observed`` the array of statistics.
    The shuffles of a unit are cut into chunks that run as separate tasks.
    ``statistic(row, order, rng)`` evaluates a batch of shuffles, ``order`` being
    (shuffles, positions), and returns (shuffles, statistics).
    Returns unit columns, ``exceed`` ARRAY<BIGINT> and ``n_draws``.
    """
    unit = list(unit)
    length = F.size(array_columns[0])
    thresholds = [100, 500, 1000, MAX_UNIT_ROWS]
    n_draws: Column = F.lit(draws(MAX_UNIT_ROWS))
    for t in reversed(thresholds[:-1]):
        n_draws = F.when(length <= t, draws(t)).otherwise(n_draws)
    ready = units.select(
        *unit, *array_columns, *scalars, F.col(observed).alias("_obs"), n_draws.alias("_total")
    )
    tasks = ready.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_total") / chunk).cast("int") - 1))
    )
    # One shuffle spreads (unit, chunk) pairs evenly over the cluster.
    tasks = tasks.repartition(F.xxhash64(*unit, "_chunk"))
    key_fields = [f for f in ready.schema.fields if f.name in unit]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    schema += ", _exceed array<bigint>, _done bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                for c in array_columns:
                    rec[c] = _matrix(rec[c])
                obs = np.asarray(rec["_obs"], float)
                n = len(rec[array_columns[0]])
                first = rec["_chunk"] * chunk
                count = min(chunk, rec["_total"] - first)
                rng = generator(seed, test, *[rec[u] for u in unit], rec["_chunk"])
                order = rng.permuted(np.tile(np.arange(n), (count, 1)), axis=1)
                stats = np.asarray(statistic(rec, order, rng), float)
                slack = 1e-12 * np.maximum(1.0, np.abs(obs))
                exceed = (stats >= obs - slack).sum(axis=0)
                rows.append([rec[u] for u in unit] + [exceed.tolist(), count])
            yield pd.DataFrame(rows, columns=[*unit, "_exceed", "_done"])

    parts = tasks.mapInPandas(run, schema)
    summed = parts.select(*unit, "_done", F.posexplode("_exceed").alias("_i", "_e"))
    per_stat = summed.groupBy(*unit, "_i").agg(
        F.sum("_e").alias("_e"), F.sum("_done").alias("n_draws")
    )
    return per_stat.groupBy(*unit).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_i", "_e"))), lambda s: s["_e"]
        ).alias("exceed"),
        F.max("n_draws").alias("n_draws"),
    )


def exceed_p(i: int) -> Column:
    """p of statistic ``i`` from the counts above."""
    return (F.get("exceed", F.lit(i)) + 1) / (F.col("n_draws") + 1)


def _matrix(value) -> np.ndarray:
    if len(value) and isinstance(value[0], (list, np.ndarray)):
        return np.array([np.asarray(v, float) for v in value])
    return np.asarray(value, float)


def gather(df: DataFrame, unit: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Series of the units short enough for one task, as arrays in order.

    Longer units are left out before anything is collected: their list is
    written first, so that its size is known and the rows of a long unit
    aren't dealt by their unit to meet it.
    """
    unit = list(unit)
    df = df.select(*unit, order, *columns)
    short = materialize(
        df.groupBy(*unit).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= MAX_UNIT_ROWS), "short-units")
    rows = df.join(short, unit).groupBy(*unit).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_s")
    )
    return rows.select(
        *unit, "n", *[F.col(f"_s.{c}").alias(c) for c in [order, *columns]]
    )
