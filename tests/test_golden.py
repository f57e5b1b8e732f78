"""Figures written down before the code existed (sf 0.01)."""

import pytest

from verification.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"

# Tran, KO, system, manual, exceptions, opening, zero, partial.
COUNTS = {
    "RC0": (863, 791, 753, 71, 206, 167, 756, 33),
    "RC1": (920, 837, 817, 47, 236, 180, 803, 27),
    "RC2": (875, 792, 757, 70, 218, 170, 762, 35),
    "RC3": (996, 950, 873, 77, 236, 129, 889, 0),
    "RC4": (859, 816, 730, 86, 257, 138, 740, 0),
}


def test_counts(spark):
    rows = QUERIES["dashboard_counts"](spark, SF_DIR).collect()
    got = {
        r.recon_code: (
            r.tran_count, r.ko_count, r.ko_system_count, r.ko_manual_count,
            r.excp_count, r.opening_excp_count, r.ko_zeroexcp_count, r.ko_partialexcp_count,
        )
        for r in rows
    }
    assert got == COUNTS


def test_collisions(spark):
    rows = QUERIES["universe_collisions"](spark, SF_DIR).groupBy("recon_code").count().collect()
    assert {r.recon_code: r["count"] for r in rows} == {"RC3": 6, "RC4": 4}


@pytest.mark.parametrize("name,expected", [("match_many_to_many", 11358), ("match_one_to_many", 1200)])
def test_group_matches(spark, name, expected):
    assert QUERIES[name](spark, SF_DIR).count() == expected
