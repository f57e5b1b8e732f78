"""Texts that are hard on an operator: repeated words, long runs of white space, crowded roots."""

import random
import time

import numpy as np
import pytest

from ledgermatch.llm import simhash, tokens
from ledgermatch.llm.contamination import Index, merged
from ledgermatch.llm.simhash import GrayIndex, forest, gray_rank, root_bits
from ledgermatch.llm.textscan import LETTERS, Words


def brute_spans(doc, items, window=13):
    """Words inside any occurrence of a window of an item, and the items with one."""
    hit, found = set(), set()
    for k, item in enumerate(items):
        n = min(window, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(doc) - n + 1 if n else 0):
            if tuple(doc[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(k)
    return hit, found


def hits(doc, items):
    index = Index([(k, " ".join(x).encode()) for k, x in enumerate(items)])
    spans, found = index.spans(Words(" ".join(doc).encode(), LETTERS))
    assert spans == merged(spans)
    return {p for s, e in spans for p in range(s, e)}, found


@pytest.mark.parametrize("seed", range(12))
def test_repetitive_texts_against_brute_force(seed):
    pick = random.Random(seed)
    few = [f"w{k}" for k in range(1 + seed % 4)]
    doc = [pick.choice(few) for _ in range(pick.randint(1, 300))]
    items = [[pick.choice(few) for _ in range(pick.randint(0, 60))] for _ in range(4)]
    items.append(doc[20:60])
    assert hits(doc, items) == brute_spans(doc, items)


def test_one_word_repeated_takes_no_time():
    began = time.process_time()
    assert hits(["again"] * 20_000, [["again"] * 200]) == (set(range(20_000)), {0})
    assert time.process_time() - began < 3  # 0.7 s on the machine it was written on
    assert hits(["again"] * 12 + ["other"] + ["again"] * 12, [["again"] * 200]) == (set(), set())


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "　", " \n"])
def test_long_blank_runs_are_split_as_the_pattern_does(blank):
    ranks = open(tokens.RANKS, "rb").read()
    plain, whole = (tokens.encoder(ranks, p)[0] for p in (tokens.PATTERN, tokens.ONE_PIECE))
    pick = random.Random(3)
    for _ in range(60):
        parts = [pick.choice(["word", "7", "!", blank * pick.randint(1, 30), " ", "é"]) for _ in range(12)]
        text = "".join(parts)
        assert tokens.encode(text, plain, whole, tokens.PATTERN, long=4).tolist() == plain.encode_ordinary(text)


@pytest.mark.parametrize("blank", [" ", "\t", "\n"])
def test_two_million_blanks(spark, docs, blank):
    rows = [(1, blank * 2_000_000 + "a"), (2, "a" + blank * 2_000_000), (3, "a b")]
    got = {r.doc_id: r for r in tokens.count_tokens(docs(rows)).collect()}
    assert got[1].n_chars == got[2].n_chars == 2_000_001 and got[3].n_tokens == 2
    assert sum(got[1].section_tokens) == got[1].n_tokens > 1


def brute_links(codes, groups, distance=3):
    out = set()
    for g in set(groups.tolist()):
        at = np.flatnonzero(groups == g)
        near = np.bitwise_count(codes[at][:, None] ^ codes[at][None, :]) <= distance
        out |= {(int(at[i]), int(at[j])) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
    return out


def components(n, edges):
    top = list(range(n))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        top[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


def test_an_index_of_groups_of_all_sizes():
    rng = np.random.default_rng(5)
    groups = np.repeat(np.arange(8), [1, 2, 7, 8, 9, 64, 65, 700])
    codes = rng.integers(0, 1 << 63, len(groups), dtype=np.uint64)
    for k in range(0, len(codes) - 1, 3):
        if groups[k] == groups[k + 1]:
            codes[k + 1] = codes[k] ^ np.uint64(1 << int(rng.integers(0, 63)))
    order = np.lexsort((gray_rank(codes), groups))
    index = GrayIndex(codes[order], groups[order])
    q, found = index.search(codes[order], 3, groups[order])
    links = {(min(a, b), max(a, b)) for a, b in zip(q.tolist(), found.tolist(), strict=True) if a != b}
    assert links == brute_links(codes[order], groups[order])
    assert index.compared < (np.bincount(groups) ** 2).sum() * 0.8  # the rest was pruned with its group
    a, b = forest(groups, codes)
    place = {int(c): k for k, c in enumerate(codes)}
    got = components(len(codes), [(place[int(x)], place[int(y)]) for x, y in zip(a, b, strict=True)])
    assert got == components(len(codes), brute_links(codes, groups))


def test_the_index_prunes_on_the_registered_table(spark):
    """No group of the table is compared pair by pair: all go through the index, which leaves out many."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    codes = simhash.fingerprints(docs).select("fp").distinct().toArrow()["fp"].to_numpy().view(np.uint64)
    groups = (codes >> np.uint64(64 - root_bits(len(codes)))).astype(np.int64)
    groups = np.unique(groups, return_inverse=True)[1]
    order = np.lexsort((gray_rank(codes), groups))
    index = GrayIndex(codes[order], groups[order])
    index.search(codes[order], 3, groups[order])
    every = int((np.bincount(groups) ** 2).sum())
    assert len(codes) > 5_000 and index.compared < 0.8 * every


def test_root_bits_follow_the_codes():
    assert [root_bits(n) for n in (0, 1, 512, 2048, 1 << 20, 1 << 40)] == [1, 1, 1, 2, 11, 16]
