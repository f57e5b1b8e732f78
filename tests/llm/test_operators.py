"""Operators on small tables against brute force, with nulls, empty texts, ties and repeated rows."""

import base64
import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from ledgermatch.llm import contamination, mixing, passages, quality, simhash, tokens, toxicity, vectors, warc
from ledgermatch.llm.features import Rows, low_hashes, word_features
from ledgermatch.llm.lines import CuckooFilter, LineIndex
from ledgermatch.llm.links import components
from ledgermatch.sources.rounds import RunFolder

LONG = "long " * 30_000


def words(n, seed=0):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 10**6, n))


# --- contamination ------------------------------------------------------------------------------


def test_contamination(spark, docs):
    passage = words(30, 1)
    items = [(1, passage), (1, passage), (2, "Three Little Words"), (3, None), (4, "?!"), (None, words(20, 2))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [
        (1, f"{words(40)} {passage.upper()} {words(40, 3)}"),
        (2, f"{words(2000, 4)} three LITTLE-words, x"),
        (3, None),
        (4, ""),
        (None, words(20, 2)),
        (6, " ".join(passage.split()[:12])),
        (7, " ".join(passage.split()[5:18])),
        (7, " ".join(passage.split()[5:18])),
        (8, LONG),
    ]
    for block in (1 << 20, 60):
        found = contamination.find_contamination(docs(rows), bench, block_bytes=block)
        got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in found.collect())
        assert got == {
            (1, 110, 30, (1,)): 1,
            (2, 2004, 3, (2,)): 1,
            (3, 0, 0, ()): 1,
            (4, 0, 0, ()): 1,
            (None, 20, 20, ()): 1,
            (6, 12, 0, ()): 1,
            (7, 13, 13, (1,)): 2,
            (8, 30000, 0, ()): 1,
        }
    flags = found.select("doc_id", contamination.contaminated().alias("x")).where("x").collect()
    assert sorted(str(r.doc_id) for r in flags) == ["1", "7", "7", "None"]
    assert contamination.find_contamination(docs(rows), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert contamination.find_contamination(docs([]), bench).count() == 0


# --- near-duplicates ----------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_rows():
    base = words(400, 5).split()
    rows = [(k, " ".join(base[:-k] + ["x"] * k)) for k in range(1, 30)]
    rows += [(100 + k, words(300, 100 + k)) for k in range(40)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One two"), (204, "one TWO"), (None, "one two"), (205, LONG)]
    return [*rows, (1, rows[0][1]), (150, rows[0][1])]


def brute_components(rows):
    prints = [brute_fingerprint(text) for _, text in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min((x for x in (i, least.get(g)) if x is not None), default=None)
    return prints, group, [least[g] for g in group]


def test_near_duplicates(spark, docs):
    rows = near_rows()
    prints, group, least = brute_components(rows)
    want = collections.Counter(zip((i for i, _ in rows), prints, least, strict=True))
    got = simhash.near_duplicates(docs(rows)).collect()
    assert collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs([])).count() == 0
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(docs(rows)).collect()]
    assert len(kept) == len(set(group))
    assert {i for i, _ in kept} == {x for x in least if x is not None}


def test_crowded_root_is_dealt_out(spark):
    rng = np.random.default_rng(6)
    flips = np.uint64(1) << rng.integers(0, 48, (6000, 4), dtype=np.uint64)
    codes = np.unique(np.bitwise_xor.reduce(flips, axis=1) ^ np.uint64(0xABCD << 48))
    frame = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp bigint").repartition(3)
    folder = RunFolder(spark)
    edges = simhash.linked(folder.scratch(frame), folder)
    assert edges.count() < 60 * len(codes)
    root = {r.node: r.root for r in components(edges, folder).collect()}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
    signed = codes.view(np.int64)
    for k in range(len(codes)):
        mine = root.get(int(signed[k]), int(signed[k]))
        assert all(root.get(int(x), int(x)) == mine for x in signed[near[k]])
    with pytest.raises(ValueError):
        simhash.linked(frame, folder, 4)


def test_components(spark):
    rng = np.random.default_rng(8)
    chain = [(k, k + 1) for k in range(60)]
    star = [(500, 501 + k) for k in range(200)]
    loose = [tuple(map(int, x)) for x in rng.integers(1000, 1400, (250, 2))]
    edges = chain + star + loose + [(7, 7), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), RunFolder(spark)).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert {x: got.get(x, x) for x in up} == {x: root(x) for x in up}


# --- lines --------------------------------------------------------------------------------------


def line_rows():
    often = [(k, f"own {k}\n  Shared LINE\t\nown {k}") for k in range(10)]
    rare = [(20 + k, f"rare\nÄ {k}") for k in range(9)]
    case = [(40 + k, "Ä shared" if k % 2 else "ä shared") for k in range(18)]
    return [*often, *rare, *case, (60, None), (61, ""), (62, "\n\n"), (None, "shared line"), (63, "shared line\n" * 50), (64, LONG)]


def brute_lines(rows, threshold=10):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    df = collections.Counter(k for _, text in rows for k in {key(x) for x in (text or "").split("\n")})
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) and df[key(x)] >= threshold)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


def dropped(index, frame):
    return collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in index.drop(frame).collect())


@pytest.mark.parametrize("filter_bytes", [1 << 28, 0])
def test_lines(spark, docs, filter_bytes):
    rows = line_rows()
    index = LineIndex(spark, 10, filter_bytes=filter_bytes).insert(docs(rows))
    assert dropped(index, docs(rows)) == brute_lines(rows)


def test_lines_are_reversible(spark, docs):
    rows = line_rows()
    first, more = rows[:-8], [(90 + k, "rare\nnew") for k in range(3)]
    index = LineIndex(spark, 10).insert(docs(first))
    index.insert(docs(rows[-8:] + more))
    assert dropped(index, docs(rows + more)) == brute_lines(rows + more)
    index.delete(docs(more)).delete(docs(rows[-8:]))
    assert dropped(index, docs(first)) == brute_lines(first)
    index.delete(docs(first))
    assert index.counts.where("n > 0").count() == 0
    assert not any(any(bytes(r.table)) for r in index.filters.collect())


def test_filters_grow_by_shards(spark, docs, monkeypatch):
    monkeypatch.setattr("ledgermatch.llm.lines.SHARD_KEYS", 50)
    rows = [(k, "\n".join(f"line {j}" for j in range(400))) for k in range(3)] + [(9, "alone")]
    index = LineIndex(spark, 2).insert(docs(rows))
    assert index.shards == 8 and dropped(index, docs(rows)) == brute_lines(rows, 2)


def test_counted_lines_that_a_filter_holds_by_accident_stay(spark, docs):
    rows = [(k, "\n".join(f"line {j}" for j in range(30))) for k in range(3)] + [(9, "\n".join(f"x {j}" for j in range(90)))]
    index = LineIndex(spark, 2).insert(docs(rows))
    cold = np.array([[r.h1, r.h2] for r in index.counts.where("n < 2").collect()], np.int64).view(np.uint64)
    own = CuckooFilter.from_bytes(bytes(index.filters.first().table))
    assert own.insert(cold[:, 0], cold[:, 1])
    index.filters = spark.createDataFrame([(0, bytearray(own.table.tobytes()))], "shard int, table binary")
    assert len(index._shipped().exceptions) == 90
    assert dropped(index, docs(rows)) == brute_lines(rows, 2)


# --- mixing -------------------------------------------------------------------------------------


def test_targets_are_capped_and_shared_anew(spark):
    sizes = [("b", 1000), ("a", 10), ("é", 500), (None, 200), ("z", 0)]
    frame = spark.createDataFrame(sizes, "source string, source_size bigint")
    got = {r.source: r for r in mixing.source_targets(frame, RunFolder(spark)).collect()}
    assert [s for s, _ in sorted(got.items(), key=lambda x: x[1].number)] == ["a", "b", "z", "é", None]
    assert got["a"].target == 30 and got["z"].target == 0
    rest = {k: w for k, w in (("b", 2), ("é", 5), (None, 2))}
    target, open_ = {}, dict(rest)
    while True:
        left = 1710 - 30 - sum(target.values())
        share = {k: left * w / sum(open_.values()) for k, w in open_.items()}
        over = {k for k in open_ if share[k] > 3 * got[k].source_size}
        if not over:
            break
        target |= {k: 3.0 * got[k].source_size for k in over}
        open_ = {k: w for k, w in open_.items() if k not in over}
    for k, want in (target | share).items():
        assert abs(got[k].target - want) < 1e-6


def test_mix(spark, docs):
    rng = np.random.default_rng(9)
    rows = [(k, "w " * int(n), "abc"[k % 3] if k % 7 else None) for k, n in enumerate(rng.integers(1, 40, 900))]
    rows += [(None, "x y", "a"), (2000, None, "b"), (2001, "", "c"), (2002, " one\n", "d")] + [(3000, "r s t", "e")] * 5
    frame = docs(rows)
    got = mixing.mix(frame).collect()
    assert collections.Counter((r.doc_id, r.source, r.size) for r in got) == collections.Counter(
        (i, s, len((t or "").split())) for i, t, s in rows
    )
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in got)
    for source in {s for _, _, s in rows}:
        own = [r for r in got if r.source == source]
        longest = max(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= (5 if len(own) > 100 else 3 * longest)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame.repartition(5)).collect()))
    assert mixing.mix(docs([])).count() == 0
    assert [r.taken for r in mixing.mix(docs([(1, None), (2, "")])).collect()] == [0, 0]


def test_each_document_keeps_its_expectation(spark, docs):
    rows = [(k, "w " * (1 + k % 5), "ab"[k % 2]) for k in range(40)]
    runs = [mixing.mix(docs(rows), weights=(3, 1), seed=s) for s in range(12)]
    union = runs[0].select("doc_id", "copies", "target", "source_size")
    for more in runs[1:]:
        union = union.union(more.select("doc_id", "copies", "target", "source_size"))
    mean = union.groupBy("target", "source_size").agg(F.avg("copies").alias("m")).collect()
    assert all(abs(r.m - r.target / r.source_size) < 0.12 for r in mean)


# --- embeddings ---------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(10)
    centre = rng.standard_normal((6, 16))
    x = [(centre[k % 6] + rng.standard_normal(16) * (0.02 if k % 3 else 0.12)).astype(np.float32) for k in range(300)]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] + [1.0] * 15), (404, [None] + [1.0] * 15)]
    rows += [(405, [float("inf")] * 16), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (None, x[0].tolist()), (0, x[0].tolist())]
    frame = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id bigint, embedding array<float>, n int, node string")
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for _, v in rows]
    link = np.zeros((len(rows), len(rows)), bool)
    for a, (_, v) in enumerate(rows):
        for b, (_, w) in enumerate(rows):
            if a != b and ok[a] and ok[b] and len(v) == len(w):
                v2, w2 = np.array(v, np.float64), np.array(w, np.float64)
                link[a, b] = v2 @ w2 / np.sqrt((v2 @ v2) * (w2 @ w2)) >= 0.9
    got = vectors.near_duplicates(frame.repartition(3), recall=1.0).collect()
    assert collections.Counter((r.vec_id, r.n_links) for r in got) == collections.Counter(
        (i, int(n)) for (i, _), n in zip(rows, link.sum(1), strict=True)
    )
    group = list(range(len(rows)))
    for a, b in zip(*np.nonzero(link), strict=True):
        if group[a] != group[b]:
            old, new = group[a], group[b]
            group = [new if g == old else g for g in group]
    for r in got:
        mine = {group[k] for k, (i, _) in enumerate(rows) if i == r.vec_id}
        ids = [i for k, (i, _) in enumerate(rows) if group[k] in mine and i is not None]
        assert r.component_id == min(ids) and r.kept == (r.vec_id == r.component_id)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_crowded_cell_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("ledgermatch.llm.vectors.BLOCK", 16)
    rng = np.random.default_rng(11)
    x = np.ones(8) + rng.standard_normal((120, 8)) * 0.05
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    y = x / np.linalg.norm(x, axis=1)[:, None]
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(frame).collect()}
    assert got == dict(enumerate((y @ y.T >= 0.9).sum(1) - 1))


# --- passages -----------------------------------------------------------------------------------


def test_passages(spark, docs):
    shared = words(60, 20)
    rows = [
        (1, f"{words(50, 21)} {shared} {words(50, 22)}"),
        (2, f"{words(31, 23)} {shared} {words(7, 24)}"),
        (None, f"{words(11, 25)} {shared}"),
        (3, words(200, 26)),
        (4, None),
        (5, ""),
        (6, "short one."),
        (7, "short one."),
        (8, words(80, 27)),
        (8, words(80, 27)),
        (9, words(300, 28).replace("w", "\nw")),
        (10, "A b c. D e f! G h i? " * 200),
        (11, LONG),
    ]
    got = passages.remove_repeats(docs(rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[2].n_words_removed >= 30 and by[None].n_words_removed >= 30
    assert all(by[k].n_removed == 0 for k in (1, 3, 4, 5, 6, 7, 8, 9))
    assert by[4].kept is None and by[5].kept == "" and by[3].kept == rows[3][1]
    gone = collections.Counter(rows[1][1].split()) - collections.Counter(by[2].kept.split())
    assert set(gone) <= set(shared.split()) and sum(gone.values()) == by[2].n_words_removed
    # A text that repeats itself keeps its first occurrence.
    # The shortest runs need not reach the last sentence.
    assert 1780 < by[10].n_words_removed < 1800 and by[10].kept.startswith("A b c. D e f! G h i? ")
    # Its one pair of words is a cut, so each word is a sentence, and all runs but the first repeat it.
    assert (by[11].n_sentences, by[11].n_removed) == (30_000, 29_999)
    assert passages.remove_repeats(docs([])).count() == 0


def test_passages_against_all_spans(spark, docs):
    rng = np.random.default_rng(30)
    pool = [words(int(n), 300 + k) for k, n in enumerate(rng.integers(5, 60, 12))]
    rows = [(k, ". ".join(pool[j] for j in rng.integers(0, 12, 5))) for k in range(25)]
    seen, want = {}, {}
    for i, text in rows:
        found, first = passages.sentences(text.encode())
        ends = [passages.runs(found, first, 3, 25)[0], found]
        covered = set()
        for s, n in enumerate(ends[0]):
            span = tuple(found.word(k) for k in range(first[s], first[s + n]))
            if seen.setdefault(span, (i, s)) != (i, s):
                covered |= set(range(s, s + n))
        want[i] = len(covered)
    got = {r.doc_id: r.n_removed for r in passages.remove_repeats(docs(rows)).collect()}
    assert got == want and any(want.values())


# --- archives -----------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    rows = [
        (5, "http://a", "same"),
        (3, None, "same"),
        (3, "http://again", "same"),
        (7, "http://b\r\nx", "other é"),
        (None, "http://c", "same"),
        (8, "u", None),
        (9, "u", ""),
        (10, "u", "<p>" + "long text " * 30000),
    ]
    rows += [(100 + k, "u", f"<html><body>page {k} with common words and {words(30, k)}</body></html>") for k in range(60)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, first int")
    want = collections.Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        first = min(ids) if ids and min(ids) != i else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[i, len(data), digest, "revisit" if first is not None else "response", first, None] += 1
    for dictionary in (warc.train_dictionary(pages), None):
        path = f"{tmp_path}/archives-{dictionary is None}"
        warc.write_archives(pages, path, dictionary=dictionary)
        records = warc.read_archives(spark, path)
        columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
        assert collections.Counter(tuple(r) for r in records.select(*columns).collect()) == want
        got = collections.Counter((r.page_id, bytes(r.payload).decode()) for r in warc.restored(records).collect())
        assert got == collections.Counter((i, html or "") for i, _, html in rows)
    warc.write_archives(pages, f"{tmp_path}/least", least=5)
    kinds = warc.read_archives(spark, f"{tmp_path}/least").groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in kinds} == {"response": len(rows)}
    assert warc.train_dictionary(pages.limit(0)) is None
    warc.write_archives(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def test_damage_is_found():
    packer = zstandard.ZstdCompressor(write_checksum=True)
    good = warc.record(1, "u", b"payload" * 100, None)
    assert warc.parse(good)["payload"] == b"payload" * 100
    bad = {
        "no WARC header": b"nothing",
        "Content-Length is": good[:-6] + b"\r\n\r\n",
        "block digest": good.replace(b"payloadpayload", b"payloadPayload", 1),
        "given twice": good.replace(b"WARC-Date:", b"WARC-Type:", 1),
        "no warc-date": good.replace(b"WARC-Date:", b"WARC-Dote:", 1),
        "no number": re.sub(rb"\r\nContent-Length: \d+\r\nWARC-Page", b"\r\nContent-Length: x\r\nWARC-Page", good),
    }
    for message, data in bad.items():
        rows = list(warc.records_of(packer.compress(data) + packer.compress(good)))
        assert message in rows[0]["error"] and rows[1]["error"] is None, message
    frame = packer.compress(good)
    assert "cut off" in list(warc.records_of(frame + frame[:-5]))[1]["error"]
    broken = bytearray(frame)
    broken[len(frame) // 2] ^= 255
    assert list(warc.records_of(bytes(broken)))[0]["error"]
    assert "dictionary" in list(warc.records_of(warc.DICTIONARY_FRAME + b"\x05\0\0\0abcde" + frame))[0]["error"]


# --- classifiers --------------------------------------------------------------------------------


def labelled(n=600):
    rng = np.random.default_rng(40)
    rows, labels = [], []
    for k in range(n):
        text = [f"w{j}" for j in rng.integers(0, 300, 40)]
        insult, junk = k % 5 == 0, k % 4 == 0
        text += ["insult", "nasty"][: 1 + k % 2] if insult else []
        text += ["spam!!"] * 3 if junk else []
        rows.append((k, " ".join(rng.permutation(text))))
        labels.append((k, int(not junk), int(insult), int(insult and junk)))
    return rows, labels


LABELS = "doc_id bigint, quality int, toxic int, severe int"


def test_quality(spark, docs):
    rows, labels = labelled()
    train = labels[:400] + [(9999, 1, 0, 0), (None, 0, 0, 0), (401, None, 0, 0), (5, labels[5][1], 0, 0)]
    model = quality.train(docs(rows + [rows[0]] * 3), spark.createDataFrame(train, LABELS))
    more = [(None, "spam!!"), (700, None), (701, ""), (702, LONG)]
    got = quality.score(docs(rows + more), model).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got) and by[700] == by[701]
    right = [(by[i] >= 0.5) == bool(q) for i, q, *_ in labels[400:]]
    assert np.mean(right) > 0.97
    again = quality.train(docs(rows, 7), spark.createDataFrame(train[::-1], LABELS))
    assert np.allclose(again.weights, model.weights)
    one = quality.train(docs(rows), spark.createDataFrame([(1, 1, 0, 0)], LABELS))
    assert {r.score for r in quality.score(docs(rows[:5]), one).collect()} == {one.score(b"")}
    assert one.score(b"") == pytest.approx(2 / 3)
    none = quality.train(docs(rows), spark.createDataFrame([], LABELS))
    assert {r.score for r in quality.score(docs(rows[:5]), none).collect()} == {0.5}
    assert quality.score(docs([]), model).count() == 0


def test_toxicity_chain(spark, docs):
    rows, labels = labelled()
    train = spark.createDataFrame([*labels[:400], (None, 0, 1, 1), (402, None, None, None)], LABELS)
    chain = toxicity.train(docs(rows), train, ["toxic", "severe"])
    got = {r.doc_id: r for r in toxicity.predict(docs([*rows, (800, None), (801, "")]), chain).collect()}
    assert np.mean([(got[i].p_toxic >= 0.5) == bool(t) for i, _, t, _ in labels[400:]]) > 0.97
    assert np.mean([(got[i].p_severe >= 0.5) == bool(s) for i, _, _, s in labels[400:]]) > 0.9
    assert got[800].p_toxic == got[801].p_toxic < 0.5
    # What is predicted for the earlier category has a part in the later one.
    assert chain.models[1].more[0] > 0
    none = toxicity.train(docs(rows), train.limit(0), ["toxic"])
    assert {r.p_toxic for r in toxicity.predict(docs(rows[:4]), none).collect()} == {0.5}
    assert toxicity.predict(docs([]), chain).count() == 0


def test_later_models_see_unseen_predictions_only():
    """A category that follows labels which no model could learn gets nothing from the chain."""
    rng = np.random.default_rng(41)
    texts = [" ".join(f"u{k}x{j}" for j in range(20)).encode() for k in range(300)]
    found = [word_features(x) for x in texts]
    rows = Rows(np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])]))
    noise = rng.integers(0, 2, 300).astype(float)
    chain = toxicity.fit_chain(["noise", "same"], rows, np.stack([noise, noise], axis=1))
    assert abs(chain.models[1].more[0]) < 1


# --- tokens -------------------------------------------------------------------------------------


def test_token_counts(spark, docs):
    rows = [(1, "Hello wörld\n\n\nnew line 中文\n"), (2, None), (3, ""), (3, ""), (4, "\n"), (None, "a b"), (5, LONG[:3000])]
    encoding, lengths = tokens.encoder(open(tokens.RANKS, "rb").read(), tokens.PATTERN)
    for rule in tokens.RULES:
        got = tokens.count_tokens(docs(rows), ("source", "text"), " ", by_line=True, rule=rule).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r for r in got}
        for i, text in rows:
            text = f"s {text or ''}"
            ids, at, spans = encoding.encode_ordinary(text), 0, []
            for n in lengths[ids]:
                a, b = (len(text.encode()[:x].decode("utf-8", "ignore")) for x in (at, at + n))
                spans.append((a, max(b, a + 1)))
                at += n
            lines = ["s "] + [x + "\n" for x in text[2:].split("\n")]
            lines[-1] = lines[-1][:-1]
            lines = lines if lines[-1] or len(lines) == 2 else lines[:-1]
            owner = [k for k, x in enumerate(lines) for _ in x]
            want = [0.0] * len(lines)
            for a, b in spans:
                own = collections.Counter(owner[a:b])
                if rule == "share":
                    for k, n in own.items():
                        want[k] += n / (b - a)
                else:
                    want[owner[a] if rule == "first" else max(sorted(own), key=own.get)] += 1
            assert by[i].n_tokens == len(ids) and by[i].n_chars == len(text)
            assert np.allclose(by[i].section_tokens, want), (rule, text)
    assert tokens.count_tokens(docs([])).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(docs(rows), rule="last")


def test_low_hashes_hold_the_lowest(spark):
    rows = spark.range(5000)
    key = F.xxhash64("id")
    some = low_hashes(rows, key, 50)
    assert 50 <= some.count() < 200
    want = [r.id for r in rows.orderBy(key).limit(50).collect()]
    assert [r.id for r in some.orderBy(key).limit(50).collect()] == want
    assert low_hashes(rows.limit(100), key, 50).count() == 100
