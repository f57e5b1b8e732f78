"""The parts without Spark, against plain Python."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgermatch.llm import textscan
from ledgermatch.llm.contamination import Index
from ledgermatch.llm.lines import CuckooFilter
from ledgermatch.llm.passages import GAP, runs, sentences
from ledgermatch.llm.simhash import GrayIndex, fingerprint, forest, gray_rank
from ledgermatch.llm.textscan import LETTERS, SOLID, Words, grams, sliding_min
from ledgermatch.llm.tokens import attribute, character_spans
from ledgermatch.llm.vectors import MultiIndex

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTER_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID_WORDS = re.compile(r"[^\x20\x09-\x0D]+")

TEXT = st.text(st.sampled_from("aAbZé中 \n\t.,09-\x0b\x00"), max_size=60)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_words_are_those_of_the_patterns(text):
    data = text.encode()
    for inside, pattern in ((LETTERS, LETTER_WORDS), (SOLID, SOLID_WORDS)):
        words = Words(data, inside)
        assert [words.word(k).decode() for k in range(len(words))] == pattern.findall(text.translate(ASCII_LOWER))
        same = {}
        for k in range(len(words)):
            assert same.setdefault(words.word(k), words.hashes[k]) == words.hashes[k]
        assert len(set(words.hashes.tolist())) == len(same)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = ("one twothree four " * 50 + "x" * 200 + " end").encode()
    whole = Words(text, SOLID)
    monkeypatch.setattr(textscan, "PIECE", 16)
    cut = Words(text, SOLID)
    assert np.array_equal(whole.starts, cut.starts) and np.array_equal(whole.ends, cut.ends)
    assert np.array_equal(whole.hashes, cut.hashes)


@given(st.lists(st.integers(0, 3), max_size=30), st.integers(1, 6))
@settings(deadline=None)
def test_grams_are_equal_only_for_equal_words(words, n):
    hashes = textscan.mix(np.array(words, np.uint64) + np.uint64(9))
    found = grams(hashes, n).tolist()
    plain = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
    assert len(found) == len(plain)
    assert len(set(zip(found, plain, strict=True))) == len(set(found)) == len(set(plain))


@given(st.lists(st.integers(0, 50), max_size=30), st.integers(1, 9))
@settings(deadline=None)
def test_sliding_min(values, n):
    assert sliding_min(np.array(values), n).tolist() == [min(values[k : k + n]) for k in range(len(values) - n + 1)]


@given(st.data())
@settings(max_examples=200, deadline=None)
def test_winnowing_finds_every_window(data):
    """Hit words are those of all 13-word windows, or of whole items of fewer words."""
    word = st.sampled_from(["a", "b", "c"])
    items = [data.draw(st.lists(word, max_size=20)) for _ in range(data.draw(st.integers(1, 4)))]
    text = data.draw(st.lists(word, max_size=20))
    for item in items:
        text = text + item[data.draw(st.integers(0, 3)) :] + data.draw(st.lists(word, max_size=3))
    hit, found = set(), set()
    for k, item in enumerate(items):
        n = min(13, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(text) - n + 1):
            if tuple(text[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(k)
    index = Index([(k, " ".join(x).encode()) for k, x in enumerate(items)])
    spans, numbers = index.spans(Words(" ".join(text).encode(), LETTERS))
    assert {p for s, e in spans for p in range(s, e)} == hit
    assert {index.items[n][0] for n in numbers} == found


def test_gray_rank_orders_neighbours():
    codes = np.array([g ^ (g >> 1) for g in range(256)], np.uint64)
    assert gray_rank(codes).tolist() == list(range(256))


@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(0, 3))
@settings(max_examples=40, deadline=None)
def test_gray_index_finds_all_and_only_neighbours(seed, n, distance):
    rng = np.random.default_rng(seed)
    codes = np.unique(_clustered(rng, n))
    codes = codes[np.argsort(gray_rank(codes))]
    q, found = GrayIndex(codes).search(codes, distance)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= distance
    assert sorted(zip(q.tolist(), found.tolist(), strict=True)) == sorted(zip(*map(list, np.nonzero(near)), strict=True))


def _clustered(rng, n):
    centres = rng.integers(0, 2**63, 5, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (n, 3), dtype=np.uint64)
    return centres[rng.integers(0, 5, n)] ^ flips[:, 0] ^ np.where(rng.random(n) < 0.5, flips[:, 1], np.uint64(0))


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 900):
        codes = np.unique(_clustered(rng, n))
        groups = (codes >> np.uint64(62)).astype(np.int64)
        groups = np.unique(groups, return_inverse=True)[1] if n else groups
        a, b = forest(groups, codes)
        assert (np.bitwise_count(a ^ b) <= 64).all() and len(a) < max(1, len(codes))
        near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3) & (groups[:, None] == groups[None, :])
        assert _sets(codes, zip(codes[np.nonzero(near)[0]], codes[np.nonzero(near)[1]], strict=True)) == _sets(
            codes, zip(a, b, strict=True)
        )


def _sets(nodes, edges):
    up = {int(x): int(x) for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(int(a)), root(int(b))
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_fingerprint_of_no_words_and_few_words():
    assert fingerprint(b"") == fingerprint(b" \n\t") == 0
    assert fingerprint(b"A b") == fingerprint(b"a  B\n") != 0


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), unique=True, max_size=200))
@settings(max_examples=50, deadline=None)
def test_cuckoo_filter_is_reversible(keys):
    pairs = np.array(keys, np.uint64).reshape(-1, 2)
    own = CuckooFilter(buckets=128)
    assert own.insert(pairs[:, 0], pairs[:, 1])
    assert own.holds(pairs[:, 0], pairs[:, 1]).all()
    gone, stay = pairs[::2], pairs[1::2]
    own.delete(gone[:, 0], gone[:, 1])
    assert own.holds(stay[:, 0], stay[:, 1]).all()
    own.delete(stay[:, 0], stay[:, 1])
    assert not own.table.any()


def test_cuckoo_filter_says_when_it_is_full():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (40, 2), dtype=np.uint64)
    assert not CuckooFilter(buckets=8).insert(keys[:, 0], keys[:, 1])


def test_sentences_do_not_depend_on_what_is_around():
    rng = np.random.default_rng(2)
    words = ["w%d%s" % (k, "." if k % 9 == 0 else "") for k in rng.integers(0, 400, 600)]
    inner = words[100:400]
    for before in ([], words[:37], words[500:]):
        found, first = sentences(" ".join(before + inner + ["tail"]).encode())
        cuts = {int(k) - len(before) for k in first}
        alone = {int(k) for k in sentences(" ".join(inner).encode())[1]}
        assert {c for c in cuts if 0 < c < 299} == {c for c in alone if 0 < c < 299}


@pytest.mark.parametrize("vocabulary", [2, 12, 50_000])
def test_each_passage_of_48_words_holds_a_run_whatever_is_around(vocabulary):
    rng = np.random.default_rng(4)
    for _ in range(400):
        inner, *around = (["w%d" % k for k in rng.integers(0, vocabulary, n)] for n in (48, 40, 40, 40, 40))
        inside = []
        for before, after in (around[:2], around[2:]):
            found, first = sentences(" ".join(before + inner + after).encode())
            assert np.diff(first).max() <= GAP
            n, one, _ = runs(found, first, 3, 25)
            own = (first[: len(n)] >= 40) & (first[np.arange(len(n)) + n] <= 88)
            inside.append(set(one[own].tolist()))
        assert inside[0] & inside[1]


def test_token_attribution_rules():
    starts, ends, bounds = np.array([0, 2, 5, 7]), np.array([2, 5, 7, 12]), np.array([0, 4, 4, 6, 12])
    for rule, want in (("first", [2, 0, 1, 1]), ("most", [2, 0, 1, 1]), ("share", [1 + 2 / 3, 0, 1 / 3 + 0.5, 1.5])):
        counts, crossing = attribute(starts, ends, bounds, rule)
        assert np.allclose(counts, want) and counts.sum() == 4 and crossing == 2
    assert attribute(np.array([1]), np.array([6]), np.array([0, 2, 6]), "most")[0].tolist() == [0, 1]
    assert attribute(np.array([1]), np.array([6]), np.array([0, 2, 6]), "first")[0].tolist() == [1, 0]


def test_character_spans_of_tokens_within_a_character():
    spans = character_spans("a中b".encode(), np.array([1, 2, 1, 1]))
    assert [x.tolist() for x in spans] == [[0, 1, 1, 2], [1, 2, 2, 3]]


def test_multi_sequence_visits_cells_by_distance():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 10))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = MultiIndex(x, 6, 0.9, 0.99)
    index.visits = 36
    for row, cells in zip(x[:20], index.cells(x[:20]), strict=True):
        d = [((row[:5] - w) ** 2).sum() for w in index.words[0]]
        e = [((row[5:] - w) ** 2).sum() for w in index.words[1]]
        sums = [d[c // 6] + e[c % 6] for c in cells]
        assert sorted(cells) == list(range(36)) and np.allclose(sums, sorted(sums))
