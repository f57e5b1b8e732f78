"""Substring deduplication by sliding sentence spans.

A text is cut into sentences: at line feeds and behind words that end in a full stop, an exclamation
or a question mark. Long sentences are cut further, where the hash of two neighbouring words says so, and
where it is the smallest of ``GAP`` pairs none of which is a cut. So a sentence has ``GAP`` words at most,
and cuts depend on words nearby only: a passage is cut the same wherever it is quoted, but for less than
``GAP`` words at its ends. From each sentence on, the shortest run of at least ``run`` sentences and ``words``
words is hashed. Runs that occur twice or more, in all texts, are joined; all their occurrences but the
first cover sentences, and covered sentences are removed.
With the defaults every passage of 48 words holds a run, whatever is around it: its first ``GAP`` pairs have
a cut, and the run from there ends before its last ``GAP`` pairs. As runs are the shortest from each sentence
on, words at the two ends of a repeated passage may be left.

The first pass counts 64-bit hashes only. Occurrences, with 128-bit hashes, are moved for runs whose
short hash repeats. Counts and firsts are partial aggregates; they are written and joined back as
tables, so that a run found in a third of all documents is a plain skewed join, which Spark splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.llm.textscan import SOLID, Words, as_bytes, grams, map_rows, mix, sliding_min, span_hashes
from ledgermatch.sources.rounds import RunFolder

RUN = 3
WORDS = 25
#: One in so many pairs of words is a cut.
CUT = 5
#: Every so many pairs of words in a row have a cut.
GAP = 8
#: Sentences of a run at most, by its number of words: each has a word at least.
_PACK = 1 << 10

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def sentences(data: bytes) -> tuple[Words, np.ndarray]:
    """The words of a text, and the number of each sentence's first word, ended by their count."""
    words = Words(data, SOLID)
    if not len(words):
        return words, np.zeros(1, np.int64)
    a = np.frombuffer(data, np.uint8)
    cut = _ENDS[a[words.ends - 1]]
    lines = np.flatnonzero(a == 10)
    cut[np.searchsorted(words.ends, lines, side="right") - 1] |= len(lines) > 0  # the word before each line feed
    pairs = grams(words.hashes, 2)
    cut[:-1] |= pairs % np.uint64(CUT) == 0
    cut[:-1] |= smallest_without_cut(pairs, cut[:-1])
    cut[-1] = True
    return words, np.concatenate([[0], np.flatnonzero(cut) + 1])


def smallest_without_cut(pairs: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Where a pair is the smallest (all, if several are) of ``GAP`` pairs in a row that have no cut."""
    found = np.zeros(len(pairs), bool)
    seen = np.concatenate([[0], np.cumsum(cut)])
    bare = seen[GAP:] == seen[:-GAP]
    if bare.any():
        least = sliding_min(pairs, GAP)
        for k in range(GAP):
            found[k : k + len(bare)] |= bare & (pairs[k : k + len(bare)] == least)
    return found


def runs(words: Words, first: np.ndarray, run: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of sentences of the run that starts at each sentence which has one, and two hashes."""
    count = len(first) - 1
    ends = np.maximum(np.arange(count) + run, np.searchsorted(first, first[:-1] + least))
    ends = ends[ends <= count]
    s, e = first[: len(ends)], first[ends]
    one, two = span_hashes(words.hashes, s, e), span_hashes(mix(words.hashes), s, e)
    return ends - np.arange(len(ends)), mix(one), mix(two)


def remove_repeats(
    docs: DataFrame,
    run: int = RUN,
    words: int = WORDS,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_sentences, n_removed, n_words_removed and kept, the
    text without the removed sentences.

    First is the occurrence with the smallest doc_id (null last), then by text and place. Rows equal in
    doc_id and text are the same document and get the same result. Null and empty texts have no
    sentences; their kept is as it was. Other columns are not read.
    """
    if words + run > _PACK:
        raise ValueError(f"runs of more than {_PACK - run} words")
    folder = RunFolder(docs.sparkSession)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def hashes(batch: pa.RecordBatch) -> dict[str, object]:
        found = [runs(*sentences(x or b""), run, words)[1] for x in as_bytes(batch.column("text"))]
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        return {"h1": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))}

    counted = map_rows(given.select("text"), hashes, "h1 bigint, n bigint")
    again = folder.scratch(counted.groupBy("h1").agg(F.sum("n").alias("n")).where("n > 1").select("h1"))

    def occurrences(batch: pa.RecordBatch) -> dict[str, object]:
        out: list[list[np.ndarray]] = [[] for _ in range(4)]
        rows = []
        for k, data in enumerate(as_bytes(batch.column("text"))):
            n, one, two = runs(*sentences(data or b""), run, words)
            place = np.arange(len(n)) * _PACK + n
            name = np.full(len(n), text_hash(data), np.int64)
            for part, more in zip(out, (one.view(np.int64), two.view(np.int64), name, place), strict=True):
                part.append(more)
            rows.append(np.full(len(n), k))
        h1, h2, name, place = (np.concatenate([np.zeros(0, np.int64), *x]) for x in out)
        ids = batch.column("doc_id").take(pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))
        return {"h1": h1, "h2": h2, "doc_id": ids, "name": name, "place": place}

    schema = "h1 bigint, h2 bigint, doc_id bigint, name bigint, place bigint"
    found = folder.scratch(map_rows(given, occurrences, schema).join(again, "h1", "left_semi"))
    at = F.struct(F.col("doc_id").isNull(), "doc_id", "name", "place")
    firsts = found.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = folder.scratch(firsts.drop("n"))
    later = found.join(firsts, ["h1", "h2"]).where(~at.eqNullSafe(F.col("first")))
    gone = later.groupBy("doc_id", "name").agg(F.collect_set("place").alias("places"))

    def named(batch: pa.RecordBatch) -> dict[str, object]:
        names = [text_hash(x) for x in as_bytes(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "name": names}

    rows = map_rows(given, named, "doc_id bigint, text string, name bigint").alias("d")
    same = (F.col("d.name") == F.col("g.name")) & F.col("d.doc_id").eqNullSafe(F.col("g.doc_id"))
    joined = rows.join(gone.alias("g"), same, "left").select("d.doc_id", "d.text", "g.places")

    def cut(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {"n_sentences": [], "n_removed": [], "n_words_removed": [], "kept": []}
        for data, places in zip(as_bytes(batch.column("text")), batch.column("places").to_pylist(), strict=True):
            found, first = sentences(data or b"")
            covered = np.zeros(len(first), np.int64)
            for place in places or ():
                covered[place // _PACK] += 1
                covered[place // _PACK + place % _PACK] -= 1
            covered = np.cumsum(covered)[:-1] > 0
            out["n_sentences"].append(len(covered))
            out["n_removed"].append(int(covered.sum()))
            out["n_words_removed"].append(int(np.diff(first)[covered].sum()))
            out["kept"].append(_without(data, found, first, covered) if covered.any() else data)
        kept = pa.array(out.pop("kept"), pa.binary()).cast(pa.string())
        return {"doc_id": batch.column("doc_id"), **out, "kept": kept}

    schema = "doc_id bigint, n_sentences bigint, n_removed bigint, n_words_removed bigint, kept string"
    return map_rows(joined, cut, schema)


def text_hash(data: bytes | None) -> int:
    """64 bits of a text's hash, signed; tells rows with the same id apart."""
    value = xxhash.xxh3_64_intdigest(data or b"")
    return value - (1 << 64) if value >> 63 else value


def _without(data: bytes, words: Words, first: np.ndarray, covered: np.ndarray) -> bytes:
    """The text less the covered sentences, each with the blanks behind it."""
    edges = np.append(words.starts[first[:-1]], len(data))
    parts = [data[: edges[0]]]
    parts += [data[edges[k] : edges[k + 1]] for k in np.flatnonzero(~covered)]
    return b"".join(parts)
