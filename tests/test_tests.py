"""Each test against brute force, a planted flaw, or its smallest reachable p."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamperscope.operators import (
    conditions, digits, duplicates, missing, multivariate, noise, offsets, replicates, resample, shapes,
)

KEY = ["dataset_id", "grp"]


def brute_column_runs(m, reach):
    out = set()
    n, p = m.shape
    for c in range(p):
        for d in range(1, min(reach, n - 1) + 1):
            i = 0
            while i + d < n:
                j = i
                while j + d < n and m[j, c] == m[j + d, c]:
                    j += 1
                if j - i >= 3 and len(set(m[i:j, c])) >= 2:
                    out.add((c, d, i, j - 1))
                i = max(j, i + 1)
    return out


@pytest.mark.parametrize("rows,block", [(120, 4096), (700, 512)])
def test_recurring_sequences_match_brute_force(make_sheet, monkeypatch, rows, block):
    monkeypatch.setattr(duplicates, "_SCAN_BLOCK", block)
    rng = np.random.default_rng(rows)
    m = rng.integers(0, 6, (rows, 2)).astype(float)
    m[10:60, 1] = 3.0                       # a constant stretch
    m[80:92] = m[20:32]
    got = {(r.col, r.d, r.lo, r.hi) for r in duplicates.sequential_runs(make_sheet(m)).collect()}
    assert got == (brute_column_runs(m, 200) | brute_far_runs(m) if rows > 500 else brute_column_runs(m, rows - 1))


def brute_far_runs(m, reach=200):
    """Maximal runs around windows that recur, by their nearest earlier place."""
    out, n = set(), len(m)
    for c in range(m.shape[1]):
        x = m[:, c]
        share = np.unique(x, return_counts=True)[1] / n
        hhi = (share ** 2).sum()
        if hhi >= 1:
            continue
        k = max(3, math.ceil(math.log((n - 1) / 2) / -math.log(hhi) - 1e-9))
        last = {}
        for i in range(n - k + 1):
            w = tuple(x[i:i + k])
            if len(set(w)) < 2:
                continue
            d = i - last.get(w, i)
            last[w] = i
            if d > reach:
                lo, hi = i - d, i - d + k - 1
                while lo > 0 and x[lo - 1] == x[lo - 1 + d]:
                    lo -= 1
                while hi + d + 1 < n and x[hi + 1] == x[hi + 1 + d]:
                    hi += 1
                out.add((c, d, lo, hi))
    return out


def far_sheet(n):
    rng = np.random.default_rng(5)
    m = np.stack([rng.integers(0, 60, n), rng.integers(0, 25, n), np.tile([1, 2], n)[:n], np.full(n, 7)], axis=1).astype(float)
    m[100:2300, 1] = 3.0                                   # a constant stretch
    m[2600:2640, :2] = m[2399:2439, :2]                    # 201 rows away
    m[n - 60:n - 30, :2] = m[20:50, :2]                    # far away, and a third copy
    m[n // 2:n // 2 + 25, :2] = m[22:47, :2]
    return m


@pytest.mark.parametrize("block", [4096, 512])
def test_far_recurrences_match_brute_force(make_sheet, monkeypatch, block):
    monkeypatch.setattr(duplicates.recurrence, "BLOCK", block)
    monkeypatch.setattr(duplicates.recurrence.recurrences, "__defaults__", (block,))
    m = far_sheet(6000)
    got = [(r.col, r.d, r.lo, r.hi) for r in duplicates.far_column_runs(make_sheet(m)).collect()]
    want = brute_far_runs(m)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(d == 201 and hi - lo >= 39 for _, d, lo, hi in want) and any(d > 5000 or d > 2900 for _, d, _, _ in want)


def test_copies_far_away_are_found(make_sheet):
    rng = np.random.default_rng(6)
    m = rng.normal(50, 5, (52_000, 3)).round(2)
    m[700:712, :2] = m[499:511, :2]                        # 201 rows away
    m[50_600:50_612, 0] = m[600:612, 0]                    # 50,000 rows away
    sheet = make_sheet(m)
    runs = {(r.col, r.d, r.lo, r.hi, r.changes) for r in duplicates.sequential_runs(sheet).where("height >= 8").collect()}
    assert {(0, 201, 499, 510, 11), (1, 201, 499, 510, 11), (0, 50_000, 600, 611, 11)} <= runs
    blocks = {(tuple(b.cols), b.d, b.lo, b.hi) for b in duplicates.partial_blocks(sheet).where("height >= 8").collect()}
    assert ((0, 1), 201, 499, 510) in blocks
    out = duplicates.sequential_duplication(sheet).result.first()
    assert out.flag == "HIGH" and out.primary_p < 1e-9


def test_column_sets_are_cut_where_a_column_joins(make_sheet, spark, monkeypatch):
    monkeypatch.setattr(duplicates.recurrence, "BLOCK", 16)
    runs = spark.createDataFrame([("d", "all", 0, 300, 5, 60), ("d", "all", 1, 300, 20, 70), ("d", "all", 2, 300, 40, 45),
                                  ("d", "all", 2, 301, 40, 45)], "dataset_id string, grp string, col int, d long, lo long, hi long")
    got = sorted((tuple(r.cols), r.lo, r.hi) for r in duplicates.recurrence.column_sets(runs).collect())
    assert got == [((0, 1), 20, 39), ((0, 1), 46, 60), ((0, 1, 2), 40, 45)]


def test_partial_blocks_match_brute_force(make_sheet):
    rng = np.random.default_rng(2)
    m = rng.integers(0, 4, (90, 3)).astype(float)
    got = {(r.d, tuple(r.cols), r.lo, r.hi) for r in duplicates.partial_blocks(make_sheet(m)).collect()}
    want = set()
    for d in range(1, 90):
        same = [tuple(np.flatnonzero(m[i] == m[i + d])) for i in range(90 - d)]
        i = 0
        while i < len(same):
            j = i
            while j < len(same) and same[j] == same[i]:
                j += 1
            if 2 <= len(same[i]) < 3 and j - i >= 2 and (j - i) * len(same[i]) >= 6:
                want.add((d, same[i], i, j - 1))
            i = j
    assert got == want


def test_partial_rows_count_pairs_once(make_sheet):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(400, 6)).round(4)
    m[300, :5] = m[10, :5]
    m[301] = m[10]
    m[350, 1:5] = m[200, 1:5]
    pairs = sum((m[i] == m[j]).sum() >= 4 for i in range(400) for j in range(i))
    row = duplicates.partial_rows(make_sheet(m)).first()
    assert pairs == 4 and row.n_pairs == pairs and row.partial_p < 1e-3


def plain_partial_rows(m, hot_share=0.02):
    """Pairs that agree on four columns that aren't hot, and the least p."""
    n, p = m.shape
    keys = np.floor(m * 1e4 + 0.5)
    hhi, hot = np.ones(p), np.zeros(p, bool)
    for c in range(p):
        counts = np.unique(keys[~np.isnan(keys[:, c]), c], return_counts=True)[1]
        hhi[c], hot[c] = (counts.astype(float) ** 2).sum() / counts.sum() ** 2, counts.max() > hot_share * n
    pairs, least = 0, None
    for i in range(n):
        for j in range(i):
            same = keys[i] == keys[j]
            if (same & ~hot).sum() >= 4:
                pairs += 1
                chance = np.prod(hhi[same])
                least = chance if least is None else min(least, chance)
    return pairs, int(hot.sum()), 1.0 if least is None else min(1.0, least * n * (n - 1) / 2)


@pytest.mark.parametrize("columns", [6, 30])
def test_partial_rows_with_hot_columns(make_sheet, columns):
    rng = np.random.default_rng(columns)
    m = rng.integers(0, 400, (900, columns)).astype(float)
    m[:, 2] = rng.integers(0, 5, 900)                     # a hot column
    m[rng.random(m.shape) < 0.05] = np.nan
    m[200:206] = m[10]                                    # whole copies
    m[250, :5] = m[20, :5]
    m[260] = m[30]
    m[260, columns // 2] += 1
    m[270, -4:] = m[40, -4:]
    pairs, hot, p = plain_partial_rows(m)
    row = duplicates.partial_rows(make_sheet(m)).first()
    assert pairs >= 20 and (row.n_pairs, row.hot_columns) == (pairs, hot) and row.partial_p == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize("few", [64, 1, 0.01])
def test_wide_rows_of_few_values(make_sheet, monkeypatch, few):
    monkeypatch.setattr(duplicates, "FEW_ROWS", few)      # filed under one cell, two and three
    rng = np.random.default_rng(1)
    m = rng.integers(0, 120, (1200, 12)).astype(float)
    m[1100:1110, 3:8] = m[100:110, 3:8]
    row = duplicates.partial_rows(make_sheet(m)).first()
    pairs, hot, p = plain_partial_rows(m)
    assert (row.n_pairs, row.hot_columns) == (pairs, hot) and row.partial_p == pytest.approx(p, rel=1e-9)


def test_copied_rows_are_found(make_sheet):
    rng = np.random.default_rng(9)
    m = rng.normal(50, 5, (150, 4)).round(3)
    clean = duplicates.exact_duplicates(make_sheet(m)).result.first()
    m[100:108] = m[20:28]
    sheet = make_sheet(m)
    blocks = duplicates.full_row_blocks(sheet).collect()
    assert {(b.lo, b.hi, b.d) for b in blocks} == {(20, 27, 80)}
    assert clean.flag == "LOW"
    assert duplicates.exact_duplicates(sheet).result.first().flag == "HIGH"
    out = duplicates.sequential_duplication(sheet)
    assert out.result.first().flag == "HIGH" and out.units.count() == 4


def test_constant_offset_counts_and_shuffle(make_sheet):
    rng = np.random.default_rng(8)
    m = rng.normal(50, 5, (200, 3)).round(2)
    m[40:80, 1] = m[40:80, 0] + 1.25
    sheet = make_sheet(m)
    d = np.floor((m[:, 0] - m[:, 1]) * 1e4 + 0.5)
    want = ((d[1:] == d[:-1]) & (d[1:] != 0)).sum()
    counts = {(r.kind, r.c1, r.c2): r.blocks for r in offsets.offset_counts(sheet).collect()}
    assert counts[("additive", 0, 1)] == want >= 39
    result = offsets.constant_offset(sheet).result.first()
    assert result.flag in ("HIGH", "MODERATE") and result.primary_p < 0.01


def test_autocorrelation_statistics(make_sheet):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(60, 3))
    m[5, 1] = np.nan
    rows = {(r.c1, r.c2): r for r in replicates.pair_autocorrelation(make_sheet(m)).collect()}
    d = m[:, 0] - m[:, 1]
    e = d[~np.isnan(d)] - np.nanmean(d)
    assert rows[(0, 1)].n == 59
    assert rows[(0, 1)].r2 == pytest.approx((e[2:] * e[:-2]).sum() / (e * e).sum())


def test_serial_noise_is_flagged(make_sheet):
    rng = np.random.default_rng(11)
    base = rng.normal(100, 10, (200, 1))
    honest = base + rng.normal(size=(200, 4))
    walk = np.zeros((200, 4))
    for i in range(1, 200):
        walk[i] = 0.95 * walk[i - 1] + rng.normal(size=4)
    for run in (replicates.autocorrelation, replicates.runs_test):
        assert run(make_sheet(honest)).result.first().flag == "LOW"
        assert run(make_sheet(base + walk)).result.first().flag == "HIGH"


def test_loess_matches_a_direct_fit(make_sheet, spark):
    rng = np.random.default_rng(13)
    y = np.abs(rng.normal(size=300))
    df = spark.createDataFrame([("d", "all", i, i, float(v)) for i, v in enumerate(y)],
                               "dataset_id string, grp string, row_idx bigint, pos bigint, y double")
    got = {r.pos: r.resid for r in noise.loess_residuals(df, KEY).collect()}
    assert len(got) == 300
    x = np.arange(300.0)
    for t in (0, 3, 24, 25, 150, 274, 275, 299):
        dist = np.abs(x - t)
        near = np.argsort(dist, kind="stable")[:50]
        w = np.clip(1 - (dist[near] / dist[near].max()) ** 3, 0, None) ** 3
        slope, level = np.polyfit(x[near] - t, y[near], 1, w=np.sqrt(w))
        assert got[t] == pytest.approx(y[t] - level, abs=1e-9)


def test_quiet_region_is_found_and_p_has_its_floor(make_sheet):
    rng = np.random.default_rng(17)
    m = rng.normal(size=(90, 4)) + rng.normal(20, 1, (90, 1))
    m[30:60] = m[30:60].mean(axis=1, keepdims=True) + 0.02 * rng.normal(size=(30, 4))
    result = noise.loess_cusum(make_sheet(m)).result.first()
    assert result.null_method == "row shuffle" and result.stats["cusum_p"] >= 1 / 5000
    assert result.flag in ("HIGH", "MODERATE")


def test_regional_shuffle_on_honest_rows(make_sheet):
    rng = np.random.default_rng(19)
    m = rng.normal(size=(80, 4)) + rng.normal(20, 1, (80, 1))
    result = noise.regional_noise(make_sheet(m)).result.first()
    assert result.flag == "LOW" and result.primary_p >= 1 / 5000


def test_dip_matches_exhaustive_split():
    rng = np.random.default_rng(23)
    for x in (np.sort(rng.normal(size=40)), np.sort(np.round(rng.normal(size=40), 1)),
              np.sort(np.concatenate([rng.normal(size=30), rng.normal(9, 1, 30)]))):
        n = len(x)
        left = [shapes._hull_gap(x[:k + 1], n, 0) for k in range(n)]
        right = [shapes._hull_gap(-x[k:][::-1], n, 0) for k in range(n)]
        assert all(a <= b + 1e-12 for a, b in zip(left[:-1], left[1:], strict=True))
        best = min(max(left[k], right[k]) for k in range(1, n - 1)) / 2
        assert shapes.dip(x) == pytest.approx(best)


def test_two_humps_and_rounded_columns(make_sheet):
    rng = np.random.default_rng(29)
    two = np.concatenate([rng.normal(0, 1, 60), rng.normal(4.5, 1, 140)])
    m = np.stack([rng.permutation(two), rng.normal(size=200)], axis=1).round(2)
    units = {u.unit: u for u in shapes.modality(make_sheet(m)).units.collect()}
    assert units["column 1"].raw_p < 0.02 <= units["column 2"].raw_p
    few = np.stack([rng.choice(rng.normal(size=6), 200), rng.normal(size=200)], axis=1).round(3)
    flags = {u.unit: u for u in shapes.entropy(make_sheet(few)).units.collect()}
    assert flags["column 1"].raw_p < 0.005 and flags["column 2"].raw_p > 0.01


def test_block_statistics_match_direct_computation():
    rng = np.random.default_rng(31)
    x = rng.normal(size=(100, 4)) @ rng.normal(size=(4, 4))
    x -= x.mean(axis=0)
    f = multivariate._features(x)
    got = multivariate.block_statistics(f[20:50].sum(axis=0)[None, :], f.sum(axis=0), 30, 100, 4)[0]

    def shrink(rows):
        n, p = rows.shape
        m = rows.mean(axis=0)
        s = np.cov(rows.T)
        mu = np.trace(s) / p
        delta = ((s - mu * np.eye(p)) ** 2).sum()
        beta = min(sum(((np.outer(r - m, r - m) - s) ** 2).sum() for r in rows) / n**2, delta)
        a = beta / delta
        return m, (1 - a) * s + a * mu * np.eye(p)

    mb, sb = shrink(x[20:50])
    mc, sc = shrink(np.vstack([x[:20], x[50:]]))
    pooled = (29 * sb + 69 * sc) / 98
    d = mb - mc
    assert got[0] == pytest.approx(d @ np.linalg.solve(pooled, d) * 30 * 70 / 100, rel=1e-6)
    assert got[1] == pytest.approx(np.linalg.eigvals(sb @ np.linalg.inv(sc)).real.max(), rel=1e-6)


def test_outlier_rows(make_sheet):
    rng = np.random.default_rng(37)
    m = rng.normal(size=(200, 4))
    m[[5, 50, 90, 120, 150, 180]] += rng.choice([-9, 9], (6, 4))
    out = multivariate.mahalanobis_rows(make_sheet(m))
    d = m - m.mean(axis=0)
    want = np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(m.T)), d)
    got = {r.row_idx: r.d2 for r in multivariate.row_distances(make_sheet(m)).collect()}
    assert max(abs(got[i] - want[i]) for i in range(200)) < 1e-8
    assert {u.row_lo for u in out.units.collect()} == {5, 50, 90, 120, 150, 180}
    assert out.result.first().flag in ("HIGH", "MODERATE")


def test_average_ranks(spark):
    df = spark.createDataFrame([("u", float(v)) for v in (3, 1, 3, 2, 3)], "u string, x double")
    got = sorted((r.x, r.rk) for r in conditions.average_ranks(df, ["u"], "x", "rk").collect())
    assert got == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)]


def test_too_similar_conditions(make_sheet):
    rng = np.random.default_rng(41)
    a = rng.normal(10, 2, (60, 3))
    b = a + rng.normal(0, 0.002, a.shape)
    conds = ["a"] * 60 + ["b"] * 60
    out = conditions.condition_consistency(make_sheet(np.vstack([a, b]), conds))
    p = {u.unit: u.raw_p for u in out.units.collect()}
    assert p["P3 a vs b similar"] <= 0.01
    assert out.result.first().flag in ("HIGH", "MODERATE")
    honest = rng.normal(10, 2, (120, 3))
    assert conditions.condition_consistency(make_sheet(honest, conds)).result.first().flag == "LOW"


def test_shared_spikes(make_sheet):
    rng = np.random.default_rng(43)
    blocks = []
    for _ in range(3):
        m = rng.normal(50, 1, (60, 4))
        m[10:16] += rng.normal(0, 25, (6, 4))
        blocks.append(m)
    result = conditions.residual_spike(make_sheet(np.vstack(blocks), ["x"] * 60 + ["y"] * 60 + ["z"] * 60)).result.first()
    assert result.stats["overlap"] == 6
    # 999 draws: the smallest p is 0.001, which is not below the HIGH level.
    assert result.flag == "MODERATE" and result.primary_p == pytest.approx(0.001)


@pytest.mark.parametrize("n_rows", [400, 12_000])
def test_kurtosis_of_honest_and_flat_noise(make_sheet, n_rows):
    rng = np.random.default_rng(61)
    level = rng.uniform(50, 150, (n_rows, 1))
    honest = replicates.excess_kurtosis(make_sheet(level + rng.normal(size=(n_rows, 3)))).result.first()
    assert honest.primary_p > 0.01 and honest.stats["ad_p"] == honest.primary_p
    two_sided = rng.choice([-1.0, 1.0], (n_rows, 3)) + rng.normal(scale=0.1, size=(n_rows, 3))
    flat = replicates.excess_kurtosis(make_sheet(level + two_sided)).result.first()
    assert flat.primary_p < 0.01 and flat.stats["deviation"] < 0


def test_pooled_distance_matches_direct_computation(make_sheet):
    rng = np.random.default_rng(67)
    m = 100 + rng.normal(size=(90, 3))
    sheet = make_sheet(m)
    lv = np.log(m.var(axis=1, ddof=1))
    lm = np.log(m.mean(axis=1))
    slope = np.cov(lm, lv)[0, 1] / lm.var(ddof=1)
    # With two degrees of freedom ln(s^2 / sigma^2) has minus Euler's constant as its mean.
    sigma = np.exp((lv.mean() + slope * (lm - lm.mean()) + np.euler_gamma) / 2)
    d = np.sort(np.concatenate([(m[:, a] - m[:, b]) / sigma / np.sqrt(2) for a, b in ((0, 1), (0, 2), (1, 2))]))
    got = replicates.pooled_ad(replicates.standardised_differences(sheet)).first()["ad"]
    assert got == pytest.approx(replicates._ad(d), rel=1e-5)


def test_gaps_beyond_fifty_columns_and_later_windows(make_sheet):
    rng = np.random.default_rng(71)
    m = rng.normal(size=(80, 60))
    m[10:30, 55:57] = np.nan
    m[40:44, 3] = np.nan
    got = {(r.c1, r.c2): (r.both, r.only1, r.only2, r.neither) for r in missing.pair_gaps(make_sheet(m)).collect()}
    assert got == {(55, 56): (20, 0, 0, 60), (3, 55): (0, 4, 20, 56), (3, 56): (0, 4, 20, 56)}
    long_ = make_sheet(rng.normal(size=(1100, 2)))
    assert replicates.runs_windows(long_).where("seq = 'all'").count() > 200


def test_missing_rectangle(make_sheet):
    rng = np.random.default_rng(47)
    m = rng.normal(size=(100, 5))
    m[30:42, 1:4] = np.nan
    sheet = make_sheet(m, ["p"] * 50 + ["q"] * 50)
    pair = {(r.c1, r.c2): (r.both, r.neither) for r in missing.pair_gaps(sheet).collect()}
    assert pair == {(1, 2): (12, 88), (1, 3): (12, 88), (2, 3): (12, 88)}
    widest = max(missing.missing_blocks(sheet).collect(), key=lambda r: r.c2 - r.c1)
    assert (widest.lo, widest.hi, widest.c1, widest.c2) == (30, 41, 1, 3)
    assert missing.missing_data_pattern(sheet).result.first().flag == "HIGH"


def test_digit_verdicts(make_sheet):
    rng = np.random.default_rng(53)
    honest = make_sheet(10 ** rng.uniform(0, 3, (200, 3)).round(6))
    assert digits.benford_first(honest).result.first().flag == "LOW"
    typed = np.floor(rng.uniform(10, 90, (120, 2)) * 10) / 10 + 0.07
    assert digits.terminal_digit(make_sheet(typed)).result.first().flag == "HIGH"
    flat = make_sheet(rng.integers(1, 10, (400, 2)) * 10.0 ** rng.integers(0, 3, (400, 2)) + 0.25)
    got = digits.benford_first(flat).result.first()
    assert got.flag == "HIGH" and got.primary_p == pytest.approx(1 / 5001)
    counts = np.concatenate([rng.poisson(60, 300), np.full(60, 67)])
    spikes = digits.value_frequency_spike(make_sheet(counts[:, None]))
    assert spikes.result.first().flag == "HIGH"
    assert spikes.units.where(F.col("unit") == "full 67").count() == 1


def test_same_answer_at_any_partitioning(make_sheet):
    rng = np.random.default_rng(59)
    m = rng.normal(size=(120, 4))
    seen = set()
    for parts in (1, 16):
        sheet = make_sheet(m, parts=parts)
        seen.add(round(noise.regional_noise(sheet).result.first().primary_p, 12))
    assert len(seen) == 1


def test_far_runs_of_one_offset_go_on_as_one(make_sheet, monkeypatch):
    """A long copy is proposed by many stretches; the rounds grow with the
    logarithm of its length."""
    rng = np.random.default_rng(8)
    half = np.round(rng.normal(size=3000), 1)
    sheet = make_sheet([[x] for x in np.concatenate([half, half])])
    rounds = []
    merge = duplicates.recurrence.merged
    monkeypatch.setattr(duplicates.recurrence, "merged", lambda df: rounds.append(1) or merge(df))
    spark = sheet.rows.sparkSession
    pieces = spark.createDataFrame([("d", "all", 0, 3000, i, i + 2) for i in range(0, 2990, 100)],
                                   "dataset_id string, grp string, col int, d long, lo long, hi long")
    got = [(r.lo, r.hi) for r in duplicates.recurrence.extended(sheet, pieces).collect()]
    assert got == [(0, 2999)]
    assert len(rounds) <= 6


def test_pairs_of_rows_are_not_shuffled_to_meet_the_row_before(make_sheet):
    sheet = make_sheet([[1.0, 2.0, 4.0], [2.0, 3.0, 5.5], [None, 4.0, 6.5], [3.0, 4.0, 6.5], [7.0, 8.0, 9.0]])
    steps = offsets.equal_steps(sheet)
    got = sorted((r.c1, r.c2, r.prev_row, r.row_idx) for r in steps.where("hit and kind = 'additive'").collect())
    assert got == [(0, 1, 0, 1), (0, 1, 3, 4), (1, 2, 1, 2), (1, 2, 2, 3)]
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") > plan.index("Generate explode(sequence"), plan


def test_rows_of_long_units_do_not_meet_by_their_unit(make_sheet):
    sheet = make_sheet([[float(i)] for i in range(50)])
    got = resample.gather(sheet.rows, ["dataset_id", "grp"], "row_idx", ["vals"])
    assert got.head().n == 50
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("table", [noise.column_levene, replicates.within_row_z, conditions.condition_profiles, conditions.spike_profiles])
def test_rows_are_not_dealt_by_group_to_meet_one_row_per_group(make_sheet, table):
    rng = np.random.default_rng(4)
    sheet = make_sheet(np.round(rng.normal(10, 1, size=(80, 3)), 3), conds=["a", "b"] * 40)
    plan = table(sheet)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortMergeJoin \[dataset_id#\d+(, (grp|cond|target|own|bin)#\d+)*\], ", plan), plan


def test_whole_row_blocks_are_told_apart_by_row_numbers(make_sheet, monkeypatch):
    rows = [[float(i), i + 0.5, i + 0.25] for i in range(30)]
    sheet = make_sheet([*rows, *rows[:12], [99.0, 98.0, 97.0], *rows[3:6]])
    kept, write = {}, duplicates.materialize
    monkeypatch.setattr(duplicates, "materialize", lambda df, name: kept.setdefault(name, write(df, name)))
    got = sorted((r.lo, r.hi, r.d) for r in duplicates.full_row_blocks(sheet).collect())
    assert got == [(0, 9, 30), (1, 10, 30), (2, 11, 30), (3, 5, 30), (3, 5, 40)]
    assert kept["grams"].schema["_g"].dataType.simpleString() == "array<bigint>"
    runs = sheet.rows.sparkSession.createDataFrame(
        [("d", "all", 0, 9, 30, [0, 1, 2]), ("d", "all", 2, 4, 30, [0, 1]), ("d", "all", 2, 4, 500, [0, 1]),
         ("d", "all", 0, 99, 500, [0, 1]), ("d", "all", 40, 50, 30, [0])],
        "dataset_id string, grp string, lo long, hi long, d long, cols array<int>")
    assert sorted((r.lo, r.d) for r in duplicates.not_dominated(runs, KEY).collect()) == [(0, 30), (0, 500), (40, 30)]


def _kurtosis(sheet):
    sizes = replicates.sheet_sizes(sheet.rows).select(*KEY, "n_rows")
    return replicates._trimmed_kurtosis(replicates.standardised_differences(sheet), KEY, sizes)


@pytest.mark.parametrize("table", [
    lambda s: replicates.predicted_sigma(s.rows), _kurtosis, duplicates.column_streaks, multivariate.row_distances,
    missing.missing_blocks, digits.spike_neighbourhoods], ids=["sigma", "kurtosis", "streaks", "distances", "gaps", "spikes"])
def test_small_tables_are_written_before_rows_meet_them(make_sheet, table):
    rng = np.random.default_rng(4)
    sheet = make_sheet(np.round(rng.normal(10, 1, size=(80, 3)), 3), conds=["a", "b"] * 40)
    plan = table(sheet)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortMergeJoin \[dataset_id#\d+(, (grp|cond|pass|len)#\d+)*\], ", plan), plan


def test_rows_of_a_bin_meet_once(make_sheet, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [[None if rng.random() < 0.15 else float(x) for x in rng.integers(0, 6, rng.integers(1, 6))] for _ in range(400)]
    rows += [[None, None], [3.00001, 3.0], [9e15, 9e15]]
    means = [sum(v for v in r if v is not None) / max(1, sum(v is not None for v in r)) for r in rows]
    order = sorted((m, i) for i, m in enumerate(means) if any(v is not None for v in rows[i]))
    want = {}
    for b in range(0, len(order), 30):
        members = [rows[i] for _, i in order[b:b + 30]]
        n_pairs = matches = 0
        expected = 0.0
        for c1 in range(5):
            for c2 in range(c1 + 1, 5):
                pairs = [(r[c1], r[c2]) for r in members if len(r) > c2 and r[c1] is not None and r[c2] is not None]
                sides = [[np.floor(r[c] * 1e4 + 0.5) for r in members if len(r) > c and r[c] is not None] for c in (c1, c2)]
                n_pairs += len(pairs)
                matches += sum(x == y for x, y in pairs)
                if len(members) >= 2 and pairs:
                    expected += len(pairs) * sum(x == y for x in sides[0] for y in sides[1]) / (len(sides[0]) * len(sides[1]))
        want[b // 30] = (len(members), n_pairs, matches, round(expected, 9))
    sheet = make_sheet(rows)
    for cells in (1 << 22, 1):
        monkeypatch.setattr(duplicates, "_PAIR_CELLS", cells)
        bins = duplicates.within_row_bins(sheet)
        assert {r.bin: (r.n_rows, r.n_pairs, r.matches, round(r.expected, 9)) for r in bins.collect()} == {k: v for k, v in want.items() if v[1]}
    plan = bins._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*\bbin#", plan)) == 1, plan


def test_kurtosis_null_has_all_rows_of_the_sheet(make_sheet):
    rng = np.random.default_rng(8)
    n = 6000
    level = rng.uniform(50, 150, (n, 1))
    # Noise a little flatter than Gaussian: far out among sheets of 6,000 rows, not among those of 500.
    noise = rng.normal(size=(n, 4)) + rng.uniform(-2.5, 2.5, (n, 4))
    stats = replicates.excess_kurtosis(make_sheet(level + noise)).result.first().stats
    assert stats["kurtosis"] < stats["null_median"] and stats["kurtosis_p"] < 0.002


@pytest.mark.parametrize("p,from_fit", [(3, True), (3, False), (5, True)])
def test_simulated_sheet_in_pieces_matches_whole(monkeypatch, p, from_fit):
    monkeypatch.setattr(replicates, "PIECE", 1 << 10)
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
    left, right = (np.array(x) for x in zip(*pairs, strict=True))
    sizes, bias = [20_000, 300, 9_000], replicates.log_variance_bias(p - 1.0, np.log)
    kurts, ad = replicates._simulate_in_pieces(np.random.default_rng(2), sizes, p, from_fit, left, right, bias)
    rng = np.random.Generator(np.random.SFC64(np.random.default_rng(2).integers(1 << 63)))
    list(replicates._differences(rng, 8 * replicates._piece_rows(left), p, from_fit, left, right))
    parts = [[*replicates._differences(rng, n, p, from_fit, left, right)] for n in sizes]
    logs = sum(x for part in parts for _, x in part)
    values = [np.concatenate([d for d, _ in part]) for part in parts]
    whole = np.sort(np.concatenate(values))
    assert whole.var() == pytest.approx(2, rel=0.05)
    assert kurts == pytest.approx([replicates._sorted_kurtosis(np.sort(d), True) for d in (whole, *values)], abs=1e-9)
    scale = np.exp((logs / sum(sizes) - bias) / 2) if from_fit else 1.0
    if p <= replicates.AD_COLUMNS:
        assert ad == pytest.approx(replicates._ad(whole / (scale * 2**0.5)), rel=1e-3, abs=2e-3)


@pytest.mark.parametrize("block", [4096, 256])
def test_windows_that_meet_no_other_column_are_left_out(make_sheet, monkeypatch, block):
    recurrence = duplicates.recurrence
    monkeypatch.setattr(recurrence, "BLOCK", block)
    monkeypatch.setattr(recurrence.recurrences, "__defaults__", (block,))
    rng = np.random.default_rng(12)
    m = rng.integers(0, [40, 6, 9], (6000, 3)).astype(float)
    m[rng.random(m.shape) < 0.02] = np.nan
    m[5000:5012, :2] = m[100:112, :2]
    m[5012:5025, 1] = m[112:125, 1]              # one column goes on, the other one stops
    m[3000:3040, 2], m[3039:3060, 0] = m[700:740, 2], m[739:760, 0]   # two runs that share a row
    m[5990:, 1:] = m[2000:2010, 1:]              # up to the last row
    m[4000:4010] = m[0:10]                       # and from the first
    sheet = make_sheet(m)

    def sets(found):
        return sorted((r.d, tuple(r.cols), r.lo, r.hi) for r in recurrence.column_sets(found).collect())

    every = duplicates.far_column_runs(sheet)
    some = duplicates.far_column_runs(sheet, paired=True)
    assert sets(some) == sets(every) and {(4900, (0, 1)), (2300, (0, 2)), (3990, (1, 2))} <= {x[:2] for x in sets(every)}
    if block == 256:
        assert some.count() < every.count() / 3


def test_offset_scan_of_row_codes(make_sheet):
    rng = np.random.default_rng(3)
    for width in (5, 12):                        # codes of a byte and of eight
        m = rng.integers(0, 3, (60, width)).astype(float)
        m[rng.random(m.shape) < 0.1] = np.nan
        got = {(r.d, tuple(r.cols), r.lo, r.hi) for r in duplicates.offset_runs(make_sheet(m), by_column=False).collect()}
        want = set()
        for d in range(1, 60):
            same = [tuple(np.flatnonzero(m[i] == m[i + d])) for i in range(60 - d)]
            i = 0
            while i < len(same):
                j = i
                while j < len(same) and same[j] == same[i]:
                    j += 1
                if len(same[i]) >= 2 and j - i >= 2 and (j - i) * len(same[i]) >= 6:
                    want.add((d, same[i], i, j - 1))
                i = j
        assert {g for g in got if g[3] - g[2] >= 1 and (g[3] - g[2] + 1) * len(g[1]) >= 6} == want


def test_no_table_of_blocks_is_taller_than_the_sheet(make_sheet, monkeypatch):
    rng = np.random.default_rng(2)
    m = rng.integers(0, 2, (400, 4)).astype(float)        # all rows have an equal one
    m[200:260] = m[20:80]
    written, write = [], duplicates.materialize
    monkeypatch.setattr(duplicates, "materialize", lambda df, name: written.append(write(df, name)) or written[-1])
    blocks = duplicates.full_row_blocks(make_sheet(m)).collect()
    assert any(b.height == 10 and b.d == 180 for b in blocks) and max(t.count() for t in written) <= len(m)


@pytest.mark.parametrize("table", [
    lambda s, k: noise.loess_residuals(s, k), lambda s, k: noise.changepoint(s, k),
    lambda s, k: noise.loess_windows(s.withColumn("resid", F.col("y")), k)], ids=["residuals", "changepoint", "windows"])
def test_loess_units_are_not_dealt_whole(make_sheet, table):
    rng = np.random.default_rng(4)
    series = noise.noise_profile(make_sheet(rng.normal(10, 1, size=(300, 3))))
    plan = table(series, KEY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortMergeJoin \[dataset_id#\d+, grp#\d+\], ", plan), plan
