"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgermatch.llm import variants as vr
from ledgermatch.sources.rounds import RunFolder

A_TO_Z = str.maketrans(vr.UPPER, vr.LOWER)


def brute(rows, letters=5, least=3, times=2, noise=97):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run if h % noise else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= letters and n >= least}
    near, holes = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].append(w)
            if (shorter := w[:i] + w[i + 1 :]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= set(group) - {w}
    form = {}
    for w, others in near.items():
        if others and words[best := min(others, key=lambda x: (-words[x], x))] >= times * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items()}


def found(docs, **kw):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in vr.variants(docs, **kw).collect()}


def random_rows(seed, docs=60, words=120):
    pick = random.Random(seed)
    letters = "abAéÿÀ"
    vocabulary = ["".join(pick.choice(letters) for _ in range(pick.randint(4, 9))) for _ in range(40)]
    out = []
    for k in range(docs):
        text = []
        for _ in range(words):
            w = pick.choice(vocabulary)
            i = pick.randrange(len(w))
            text.append(pick.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + pick.choice(letters) + w[i:], w[:i] + "b" + w[i + 1 :]]))
        out.append((k, pick.choice([" ", ", ", "1", "\n"]).join(text)))
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_variants_against_brute_force(spark, docs, partitions):
    """Several ranges of words, so that prefixes go on from one to the next."""
    rows = random_rows(partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = found(docs(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == brute(rows) and any(v[2] for v in got.values())


def test_nulls_empty_texts_repeats_and_long_words(docs):
    long = "ab" * 30_000
    rows = [(1, None), (2, ""), (3, "1 2 !"), (None, "hello hello"), (5, "Hello HELLO"), (5, "Hello HELLO")]
    rows += [(6, f"{long} {long} {long}"), (7, f"{long}x {long}x {long}x {long}x {long}x {long}x {long}x"), (8, "étude Étude étude ÉTUDE")]
    assert found(docs(rows)) == brute(rows)
    assert found(docs([])) == {} and found(docs([(1, None)])) == {}
    assert found(docs([(1, "solitary solitary solitary")])) == {"solitary": (3, 0, None, None, "solitary")}


def test_ties_go_to_the_smallest_word(docs):
    rows = [(1, "aaaaa " * 3 + "aaaab " * 6 + "aaaac " * 6 + "aaaaaa " * 6)]
    got = found(docs(rows), noise=None)
    assert got["aaaaa"] == (3, 3, "aaaaaa", 6, "aaaaaa") and got["aaaab"][2] is None


def test_chains_of_forms_end_at_the_last(docs):
    chain = ["aaaaaaaa", "baaaaaaa", "bbaaaaaa", "bbbaaaaa", "bbbbaaaa", "bbbbbaaa"]
    rows = [(k, f"{w} " * 3 * 2**k) for k, w in enumerate(chain)]
    got = found(docs(rows), noise=None)
    assert {w: v[4] for w, v in got.items()} == dict.fromkeys(chain, chain[-1])


def test_trie_numbers_follow_words_and_prefixes(spark):
    words = sorted({"".join(random.Random(k).choice("abc") for _ in range(k % 7 + 1)) for k in range(300)})
    table = spark.createDataFrame([(w,) for w in words], "word string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = {r.word: r for r in vr.trie(table, RunFolder(spark)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [rows[w].leaf for w in words] == sorted({r.leaf for r in rows.values()})
    number = {}
    for w in words:
        for k, node in enumerate(rows[w].nodes):
            assert number.setdefault(w[:k], node) == node
    assert len(set(number.values())) == len(number)
    shared = {w[:k] for w in words for k in range(len(w) + 1) if sum(x.startswith(w[:k]) for x in words) > 1}
    assert shared <= set(number)


def test_names_of_other_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, "hello hello hello", 1, "x")], "doc_id long, text string, n long, word string")
    assert found(df.withColumn("id", F.lit(1)).withColumn("ident", F.lit(2)))["hello"][0] == 3
