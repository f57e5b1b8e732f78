"""Whitening against plain numpy."""

import numpy as np
import pytest

from ledgermatch.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, x int, n int, index int"


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(i, e, 0, 1, 2, 3) for i, e in rows], SCHEMA).repartition(partitions)


def brute(rows, most=16):
    """By vec_id: whitened, deviation, shares; signs are left open."""
    x = {i: np.floor(64 * np.array(e, np.float32).astype(float)).astype(np.int64) + 1_000_000 for i, e in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, s = len(fit), fit.sum(0)
    covariance = (fit - s / n).T @ (fit - s / n) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    white = {i: (v - s / n) @ axes / np.sqrt(values) for i, v in x.items()}
    return n, white, {i: int(((n * v - s) ** 2).sum()) for i, v in x.items()}, values / np.trace(covariance)


def check(spark, rows, **kw):
    got = wh.whiten(frame(spark, rows), **kw).collect()
    n, white, deviation, shares = brute(rows, kw.get("most", 16))
    signs = {}
    for r in sorted(got, key=lambda r: -abs(white[r.vec_id][r.component - 1])):
        expected = white[r.vec_id][r.component - 1]
        sign = signs.setdefault(r.component, np.sign(expected * r.whitened))
        assert r.whitened == pytest.approx(sign * expected, abs=1e-8)
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9) and r.identity_error < 1e-8
    assert len(got) == len(white) * len(shares)


def rows_of(seed, count, width):
    rng = np.random.default_rng(seed)
    shape = rng.standard_normal((width, width))
    return [(k, (rng.standard_normal(width) @ shape).tolist()) for k in range(count)]


def test_whitening_against_numpy(spark):
    check(spark, rows_of(1, 300, 20))


def test_more_blocks_and_splits_than_one(spark, monkeypatch):
    monkeypatch.setattr(wh, "BLOCK_BYTES", 8 * 5 * 16)
    monkeypatch.setattr(wh, "BLOCK_COLUMNS", 5)
    monkeypatch.setattr(wh, "SPLIT_ROWS", 60)
    check(spark, rows_of(2, 200, 12), most=4)


def test_copies_count_once_and_bad_vectors_go(spark):
    rows = rows_of(3, 60, 6)
    copies = [(1000 + k, rows[0][1]) for k in range(50)] + [(None, rows[1][1]), (5, rows[2][1])]
    bad = [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, [])]
    got = wh.whiten(frame(spark, rows + copies + bad)).collect()
    n, white, deviation, _ = brute(rows)
    assert {r.n for r in got} == {n} and len(got) == 6 * (len(rows) + len(copies))
    assert {r.vec_id for r in got} == {i for i, _ in rows + copies}
    assert {r.deviation for r in got if r.vec_id == 1003} == {deviation[0]}


def test_lengths_are_whitened_on_their_own(spark):
    short, long = rows_of(4, 30, 3), [(100 + i, e) for i, e in rows_of(5, 40, 5)]
    got = wh.whiten(frame(spark, short + long)).collect()
    assert {(r.vec_id < 100, r.n) for r in got} == {(True, 30), (False, 40)} and len(got) == 90 + 200


def test_no_variance_gives_no_rows(spark):
    assert wh.whiten(frame(spark, [])).count() == 0
    assert wh.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = wh.whiten(frame(spark, [(k, [float(k), 1.0, float(k)]) for k in range(5)])).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 5


def test_deviations_beyond_a_long_are_null(spark):
    got = wh.whiten(frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])])).collect()
    # (3 * 320 - 384) ** 2 for the one at the mean of the first entries
    assert {(r.vec_id, r.deviation) for r in got} == {(1, None), (2, None), (3, 331776)}
