"""Spelling variants: words that differ by one code point, by a pair dictionary of trie nodes.

The words stand in two tries, one of the words and one of the words read backwards. Nodes are numbered, so
that a prefix and a suffix are an integer each. Every word is filed under pairs (prefix node, suffix node):
once for each code point skipped, and once for each place where one could be inserted. Two words under the
same pair differ by one replaced code point if both skip one, and by one deleted code point if only one
does; equal pairs mean equal letters, so what is found needs no further check, and nothing is missed.

Numbers come from sorted words: a word adds the nodes beyond what it shares with the word before it. Words
are sorted by ranges, each range counts on its own, and the few nodes that a range shares with the one before
it are put right from the first and last word of each range. Numbers follow the order of words, so the last
node of a word is also its number. Only nodes that another word goes through are kept, since no pair with
any other can meet.

A pair has at most as many words as there are letters, and one; sums and the two best of a pair are what
is needed, so no two words are ever put side by side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgermatch.llm.textscan import ROWS, map_rows
from ledgermatch.sources.rounds import RunFolder

#: Letters of a word; A-Z are lower-cased.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the runs of a document, one in so many has a code point deleted.
NOISE = 97

_SORTED = "word string, part int, edge boolean, nodes array<bigint>, leaf bigint"


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", noise: int | None = NOISE) -> DataFrame:
    """``word`` and ``n``, how often it is found in all texts.

    With ``noise`` a code point is deleted from about one run in ``noise``, as fixed by the crc32 of
    ``<doc_id>:<run>``, where a null id is an empty text.
    """
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    runs = docs.select(ident.alias("ident"), F.explode(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.select("ident", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if noise is not None:
        h = F.crc32(F.concat("ident", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(h % noise == 0, without).otherwise(word)
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _shared(a: str, b: str) -> int:
    return len(commonprefix((a, b)))


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one sorted range, numbered from 1 in the order in which words add them. The first and last
    word have all their nodes, the others those that a neighbour goes through as well."""
    part, held, last = TaskContext.get().partitionId(), None, 0
    path: list[int] = [0]
    out: list[tuple[str, bool, list[int], int]] = []

    def batch() -> pa.RecordBatch:
        words, edges, nodes, leaves = zip(*out, strict=True)
        columns = [
            pa.array(words, pa.string()),
            pa.array([part] * len(out), pa.int32()),
            pa.array(edges, pa.bool_()),
            pa.array(nodes, pa.list_(pa.int64())),
            pa.array(leaves, pa.int64()),
        ]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["word", "part", "edge", "nodes", "leaf"])

    for rows in batches:
        for word in rows.column(0).to_pylist():
            common = _shared(held[0], word) if held else 0
            if held:
                out.append((held[0], held[1], path if held[1] else path[: 1 + max(held[2], common)], path[-1]))
            path = path[: common + 1] + list(range(last + 1, last + 1 + len(word) - common))
            last, held = path[-1], (word, held is None, common)
            if len(out) == ROWS:
                yield batch()
    if held:
        out.append((held[0], True, path, path[-1]))
    if out:
        yield batch()


@dataclass(frozen=True)
class Range:
    """What turns the numbers of a range into those of the whole trie: the first ``len(spine) - 1`` nodes
    of its first word are those of the range before it, all others follow ``base``."""

    spine: np.ndarray
    base: int

    def whole(self, nodes: np.ndarray) -> np.ndarray:
        common = len(self.spine) - 1
        return np.where(nodes <= common, self.spine[np.minimum(nodes, common)], self.base + nodes - common)


def _ranges(edges: list[tuple[int, str, list[int], int]]) -> dict[int, Range]:
    """Of the first and last word of each range, in order: part, word, nodes and last node."""
    out: dict[int, Range] = {}
    total, before, path = 0, "", np.zeros(1, np.int64)
    for part, word, nodes, leaf in edges:
        if part not in out:
            common = _shared(before, word)
            out[part], added = Range(path[: common + 1], total), common
        before, path = word, out[part].whole(np.asarray(nodes))
        total = out[part].base + leaf - added
    return out


def trie(words: DataFrame, folder: RunFolder) -> DataFrame:
    """``word``, ``leaf`` and ``nodes`` for distinct words: the number of the word's last node in the trie
    of all of them, and those of its nodes from the root on that other words go through as well.

    The first and the last word of each partition go to the driver; numbers follow the order of words.
    """
    placed = words.select("word").repartitionByRange("word").sortWithinPartitions("word")
    counted = folder.scratch(placed.mapInArrow(_number, StructType.fromDDL(_SORTED)))
    edges = counted.where("edge").select("part", "word", "nodes", "leaf").orderBy("part", "leaf").collect()
    ranges = words.sparkSession.sparkContext.broadcast(_ranges([tuple(e) for e in edges]))

    def whole(batch: pa.RecordBatch) -> dict[str, object]:
        part = batch.column("part").to_numpy()
        nodes, leaf = batch.column("nodes"), batch.column("leaf").to_numpy().copy()
        offsets = np.asarray(nodes.offsets, np.int64)
        flat, owner = nodes.flatten().to_numpy().copy(), np.repeat(part, np.diff(offsets))
        for k in np.unique(part):
            flat[owner == k] = ranges.value[k].whole(flat[owner == k])
            leaf[part == k] = ranges.value[k].whole(leaf[part == k])
        lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(flat))
        return {"word": batch.column("word"), "leaf": leaf, "nodes": lists}

    return map_rows(counted.select("word", "part", "nodes", "leaf"), whole, "word string, leaf bigint, nodes array<bigint>")


def _pairs(batch: pa.RecordBatch) -> dict[str, object]:
    """Pairs of nodes that each word is filed under. Of equal letters in a row the first one stands for
    the deletion of any (``first``), so that two words meet at one pair only."""
    ids, counts, heads, tails, skips, firsts = [], [], [], [], [], []
    rows = zip(*(batch.column(c).to_pylist() for c in ("word", "id", "n")), strict=True)
    left, right = batch.column("left"), batch.column("right")
    for k, (word, ident, n) in enumerate(rows):
        size = len(word)
        p, s = left[k].values.to_numpy(), right[k].values.to_numpy()
        letters = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        new = np.ones(size, bool)
        new[1:] = letters[1:] != letters[:-1]
        for skip in (1, 0):
            at = np.arange(max(0, size - skip - len(s) + 1), min(len(p), size - skip + 1))
            heads.append(p[at])
            tails.append(s[size - skip - at])
            skips.append(np.full(len(at), skip == 1))
            firsts.append(new[at] if skip else np.zeros(len(at), bool))
            ids.append(np.full(len(at), ident))
            counts.append(np.full(len(at), n))
    none = np.zeros(0, np.int64)
    numbers = {"p": heads, "s": tails, "id": ids, "n": counts}
    flags = {"skip": skips, "first": firsts}
    return {c: np.concatenate([none, *v]) for c, v in numbers.items()} | {
        c: np.concatenate([none.astype(bool), *v]) for c, v in flags.items()
    }


def near_words(words: DataFrame, folder: RunFolder) -> DataFrame:
    """``id``, ``n_near`` and ``best``, the near word with the largest ``n`` (smallest word of equals), for
    words with any near word. ``words``: ``word``, ``id`` (in the order of words), ``n``, ``left`` and
    ``right`` (nodes of both tries)."""
    filed = map_rows(
        words.select("word", "id", "n", "left", "right"),
        _pairs,
        "p bigint, s bigint, id bigint, n bigint, skip boolean, first boolean",
    )
    pair = Window.partitionBy("p", "s")
    ordered = pair.orderBy(F.col("skip").desc(), F.col("n").desc(), F.col("id").asc())
    all_of = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    word = F.struct(F.col("n").alias("n"), (-F.col("id")).alias("minus"))
    skipper = F.struct("skip", word.alias("word"))
    seen = filed.select(
        "id",
        "skip",
        "first",
        F.row_number().over(ordered).alias("place"),
        F.first(skipper).over(all_of).alias("one"),
        F.nth_value(skipper, 2).over(all_of).alias("two"),
        F.sum(F.col("skip").cast("int")).over(pair).alias("skips"),
        F.sum(F.col("first").cast("int")).over(pair).alias("firsts"),
        F.max(F.when(F.col("first"), word)).over(pair).alias("longer"),
        F.max(F.when(~F.col("skip"), word)).over(pair).alias("shorter"),
    )
    other = F.when(F.col("place") > 1, F.col("one")).otherwise(F.col("two"))
    replaced = F.when(other["skip"], other["word"])
    deleted = F.when(F.col("first"), F.col("shorter"))
    found = seen.select(
        "id",
        F.when(F.col("skip"), F.col("skips") - 1 + F.when(deleted.isNotNull(), 1).otherwise(0))
        .otherwise(F.col("firsts"))
        .alias("near"),
        F.when(F.col("skip"), F.greatest(replaced, deleted)).otherwise(F.col("longer")).alias("best"),
    )
    sums = found.where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
    return sums.select("id", "n_near", (-F.col("best.minus")).alias("best"), F.col("best.n").alias("best_n"))


def last_forms(forms: DataFrame, folder: RunFolder) -> DataFrame:
    """``id`` and ``root``, where its forms end, for the rows ``id``, ``form``. Pointers are followed in
    steps of doubled length. A form is at least twice as frequent as its word, so there are no rings and
    chains are no longer than the logarithm of the largest count."""
    now = folder.scratch(forms.select("id", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        after = now.join(ahead, "root", "left")
        now = folder.scratch(after.select("id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("id", "root")
        now = now.drop("moved")


def variants(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    letters: int = 5,
    least: int = 3,
    times: int = 2,
    noise: int | None = NOISE,
) -> DataFrame:
    """A row for each word of at least ``letters`` code points found ``least`` times or more in all texts:
    ``word``, ``n``, ``n_near`` (words that differ by one inserted, deleted or replaced code point),
    ``form`` (the most frequent of these, the smallest of equals, if at least ``times`` as frequent as the
    word, else null), ``form_n``, ``root`` (from the word, forms followed to the last).

    Null and empty texts have no words, and an empty table gives no rows. Texts and words of any length
    are taken whole. Repeated rows count again, with the same deletions, as these depend on id and run.
    Other columns of ``docs`` are not read, whatever their names. The run's tables stay below
    ``spark.checkpoint.dir`` as long as the result is read.
    """
    folder = RunFolder(docs.sparkSession)
    counted = count_words(docs, text, doc_id, noise)
    words = folder.scratch(counted.where((F.col("n") >= least) & (F.length("word") >= letters)))
    left = trie(words, folder).select("word", F.col("leaf").alias("id"), F.col("nodes").alias("left"))
    back = trie(words.select(F.reverse("word").alias("word")), folder)
    right = back.select(F.reverse("word").alias("word"), F.col("nodes").alias("right"))
    words = folder.scratch(words.join(left, "word").join(right, "word"))
    near = folder.scratch(near_words(words, folder))
    known = words.select("id", "word", "n").join(near, "id", "left")
    with_form = F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False))
    known = folder.scratch(known.withColumn("form_id", F.when(with_form, F.col("best"))))
    roots = last_forms(known.where("form_id is not null").select("id", F.col("form_id").alias("form")), folder)
    names = words.select("id", "word")
    form_names = names.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    root_names = names.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    named = (
        known.join(roots.withColumnRenamed("root", "root_id"), "id", "left")
        .join(form_names, "form_id", "left")
        .join(root_names, "root_id", "left")
    )
    return named.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "form",
        F.when(with_form, F.col("best_n")).alias("form_n"),
        F.coalesce("root", "word").alias("root"),
    )
