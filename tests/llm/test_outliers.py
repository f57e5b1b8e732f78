"""Counts against brute force, estimates against a slow search."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgermatch.llm import outliers as ol
from ledgermatch.llm.outliers import COUNTS, quality_rules, text_counts
from ledgermatch.sources.rounds import RunFolder


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(hit)


@pytest.mark.parametrize("seed", range(30))
def test_counts_against_brute_force(seed):
    pick = random.Random(seed)
    parts = ["a", "b", "é", "#", "*$%&|<>", "\n", "\n\n", " ", "\t", "\x1c", " ", "𝄞", "word", "line of words\n"]
    text = "".join(pick.choice(parts) + pick.choice(["", " "]) for _ in range(pick.randint(0, 400)))
    assert text_counts(text.encode()) == brute(text)


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(ol, "PIECE", 7)
    for seed in range(20):
        pick = random.Random(seed)
        text = " ".join(pick.choice(["a", "bb", "longer-than-a-piece", "é€𝄞", "#"]) for _ in range(pick.randint(0, 80)))
        assert text_counts(text.encode()) == brute(text)
    assert text_counts(b"") == (0, 0, 0, 0, 0)


def ordinary(pick, words=None):
    return " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 8))) for _ in range(words or pick.randint(30, 400)))


def junk(pick):
    return " ".join("#$%&*"[pick.randrange(5)] * pick.randint(3, 9) + "x" * pick.randint(0, 9) for _ in range(pick.randint(40, 90)))


SCHEMA = "doc_id long, text string, lang string, source string, n_words int, cell string, kept string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 1, "c", "k") for i, t, la, s in rows], SCHEMA).repartition(3)


def test_outliers_go_and_ordinary_texts_stay(spark):
    pick = random.Random(1)
    rows = [(k, ordinary(pick), "en", "hot" if k % 3 else "cold") for k in range(600)]
    rows += [(1000 + k, junk(pick), "en", "hot") for k in range(90)]
    rows += [(2000 + k, ordinary(pick), None, None) for k in range(5)]  # too few: all small groups together
    rows += [(3000, None, "en", "hot"), (3001, "", "en", "hot"), (3002, "too few words", "en", "hot"), (None, ordinary(pick), "en", "hot")]
    rows += [(3003, "again and again and " * 30, "en", "hot"), (1, ordinary(pick), "en", "hot")]
    rows += [(4000, ordinary(pick, 100_000), "en", "cold")]
    got = quality_rules(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text, *_ in rows:
        if i is not None and i != 1:
            assert tuple(by_id[i][c] for c in COUNTS) == brute(text or "")
    assert all(by_id[k].kept for k in range(600)) and by_id[None].kept and by_id[4000].distance is not None
    assert not any(by_id[k].kept or by_id[k].base_failed for k in range(1000, 1090))
    assert all(by_id[k].base_failed and not by_id[k].kept for k in (3000, 3001, 3002, 3003))
    assert all(by_id[2000 + k].kept and by_id[2000 + k].distance is None for k in range(5))
    assert quality_rules(table(spark, [])).count() == 0


def test_small_groups_are_taken_together(spark):
    pick = random.Random(2)
    rows = [(k, ordinary(pick), "en", f"s{k % 40}") for k in range(160)] + [(200 + k, ordinary(pick), "de", None) for k in range(30)]
    rows += [(300 + k, ordinary(pick), f"l{k}", "t") for k in range(90)] + [(400, junk(pick), "en", "s1")]
    got = {r.doc_id: r for r in quality_rules(table(spark, rows)).collect()}
    assert all(r.distance is not None for r in got.values()) and not got[400].kept
    assert sum(r.kept for r in got.values()) == len(rows) - 1


def test_estimates_find_the_half_with_the_smallest_determinant(spark):
    """A quarter of the rows lie far off and close together; the estimate is that of the rest."""
    rng = np.random.default_rng(3)
    good = rng.multivariate_normal([3, 1, 0, 0, 0], np.diag([9, 0.09, 4, 4, 1]), 900)
    bad = rng.multivariate_normal([30, 9, 40, 9, 9], np.eye(5) * 0.01, 300)
    rows = [("a", *map(int, np.round(x * ol.STEPS))) for x in np.concatenate([good, bad])]
    df = spark.createDataFrame(rows, "cell string, " + ", ".join(f"{f} bigint" for f in ol.FEATURES))
    (r,) = ol.estimates(df, RunFolder(spark)).collect()
    assert np.array(r.mean) / ol.STEPS == pytest.approx(good.mean(0), abs=0.25)
    lower = np.zeros((5, 5))
    for (i, j), v in zip(ol._pairs(), r.root, strict=True):
        lower[i, j] = v
    shape = np.linalg.inv(lower.T @ lower) / ol.STEPS**2
    expected = np.cov(good.T) + np.diag([a * a for a in ol.ALLOWED.values()])
    assert np.diag(shape) == pytest.approx(np.diag(expected), rel=0.2)


def test_distribution_of_distances():
    rng = np.random.default_rng(4)
    d2 = (rng.standard_normal((200_000, 5)) ** 2).sum(1)
    for share in (0.5, 0.975, 0.9999):
        assert (d2 <= ol._quantile(share)).mean() == pytest.approx(share, abs=0.003)
    inside = rng.standard_normal((400_000, 5))
    inside = inside[(inside**2).sum(1) <= ol._quantile(0.5)]
    assert inside.var() * ol._factor(0.5) == pytest.approx(1, rel=0.01)
    assert math.isclose(ol._chi2(1e9, 5), 1)
