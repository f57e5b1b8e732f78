"""Near-duplicate embeddings by an inverted multi-index.

Vectors are scaled to length 1 and halved. Each half has its own codebook; the pairs of code words
form a grid of cells, and a vector lies in the cell of its two nearest code words. A vector looks for
its neighbours by a multi-sequence traversal: cells in order of the sum of both distances, by a heap
over the two sorted lists. How many cells it visits comes from ``recall``: on the sample that the
codebooks are fitted to, neighbours are made at the similarity asked for, the farthest there may be,
and the traversal is as long as it takes to meet that share of them. Whatever is met is verified by
its cosine in double precision.

Equal vectors are one class and are compared once. A cell is compared in blocks of ``BLOCK`` members
by ``BLOCK`` visitors, so a crowded cell is spread over many tasks. Tasks return sums of links and a
spanning forest, never the pairs.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.llm.features import low_hashes
from ledgermatch.llm.links import components
from ledgermatch.llm.simhash import unite
from ledgermatch.llm.textscan import map_rows
from ledgermatch.sources.rounds import RunFolder

#: Distinct vectors that codebooks are fitted to at most, and members of a cell on average.
SAMPLE = 20_000
CELL = 400
BLOCK = 1024
MOST_WORDS = 1024
#: Members of a block whose visits are worked out together.
ROWS_AT_ONCE = 256


def unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision, scaled to length 1; None for those that link with nothing."""
    out: list[np.ndarray | None] = []
    for value in column:
        x = None
        if value.is_valid and len(value.values) and not value.values.null_count:
            x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(x).max()
            x = x / top if np.isfinite(top) and top > 0 else None
        out.append(None if x is None else x / np.sqrt(x @ x))
    return out


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all code words."""
    return (x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None, :]


def _codebook(x: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), min(size, len(x)), replace=False)]
    for _ in range(8):
        own = _nearest(x, words).argmin(1)
        sums = np.zeros_like(words)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=len(words))
        words = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], words)
    return words


class MultiIndex:
    def __init__(self, sample: np.ndarray, size: int, least: float, recall: float):
        rng = np.random.default_rng(11)
        self.half = sample.shape[1] // 2
        self.words = [_codebook(x, size, rng) for x in (sample[:, : self.half], sample[:, self.half :])]
        some = sample[rng.permutation(len(sample))[:1000]]
        noise = rng.standard_normal(some.shape)
        noise -= (noise * some).sum(1)[:, None] * some
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-300)[:, None]
        near = least * some + np.sqrt(max(0.0, 1 - least**2)) * noise
        rank = np.minimum(self._rank(some, near), self._rank(near, some))
        self.visits = 1 + int(np.quantile(rank, recall, method="higher")) if len(rank) else 1

    def _rank(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """How many cells each row of ``x`` visits before the own cell of the row of ``of``: those with a
        smaller sum of distances, counted by places in the sorted distances of one half."""
        parts = [slice(0, self.half), slice(self.half, None)]
        first, second = (_nearest(x[:, p], w) for p, w in zip(parts, self.words, strict=True))
        own = [_nearest(of[:, p], w).argmin(1) for p, w in zip(parts, self.words, strict=True)]
        row = np.arange(len(x))
        apart = second[row, own[1]]
        # What is left for the other half; exactly so for the code word of the cell itself.
        left = (first[row, own[0]] + apart)[:, None] - first
        left[row, own[0]] = apart
        second.sort(axis=1)
        return np.array([np.searchsorted(e, v).sum() for e, v in zip(second, left, strict=True)])

    def cells(self, x: np.ndarray) -> list[list[int]]:
        """The cells that each row visits, its own first."""
        first, second = _nearest(x[:, : self.half], self.words[0]), _nearest(x[:, self.half :], self.words[1])
        order1, order2 = first.argsort(1, kind="stable"), second.argsort(1, kind="stable")
        first, second = np.take_along_axis(first, order1, 1), np.take_along_axis(second, order2, 1)
        wide = len(self.words[1])
        return [
            [int(a[i]) * wide + int(b[j]) for i, j in self._traverse(d.tolist(), e.tolist())]
            for a, b, d, e in zip(order1, order2, first, second, strict=True)
        ]

    def _traverse(self, d: list[float], e: list[float]) -> list[tuple[int, int]]:
        """Places in two ascending lists by ascending sums. A place is opened once those before it in
        both lists were visited."""
        out: list[tuple[int, int]] = []
        heap, done = [(d[0] + e[0], 0, 0)], set()
        while heap and len(out) < self.visits:
            _, i, j = heapq.heappop(heap)
            out.append((i, j))
            done.add((i, j))
            if i + 1 < len(d) and (j == 0 or (i + 1, j - 1) in done):
                heapq.heappush(heap, (d[i + 1] + e[j], i + 1, j))
            if j + 1 < len(e) and (i == 0 or (i - 1, j + 1) in done):
                heapq.heappush(heap, (d[i] + e[j + 1], i, j + 1))
        return out


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = table["x"].combine_chunks()
    values = x.flatten().to_numpy().reshape(table.num_rows, -1)
    return values, table["n"].to_numpy(), table["own"].to_numpy(), table["node"].to_numpy()


def compare(table: pa.Table, least: float, index: MultiIndex) -> pa.Table:
    """Links between the members and the visitors of one block.

    Two vectors that visit each other's cells meet twice; then each meeting counts for its visitor
    only. Otherwise the one meeting counts for both. Which cells a member visits is worked out anew, for
    members with a link only, instead of being sent to all cells that it visits.
    """
    role = table["member"].to_numpy(zero_copy_only=False)
    x, n, own, node = _rows(table)
    a, b = np.flatnonzero(~role), np.flatnonzero(role)
    linked = (x[a] @ x[b].T) >= least
    linked &= node[a][:, None] != node[b][None, :]
    links = np.zeros(len(n), np.int64)
    links[a] += linked @ n[b]
    back = np.zeros_like(linked)
    met = np.flatnonzero(linked.any(axis=0))
    for at in range(0, len(met), ROWS_AT_ONCE):
        some = met[at : at + ROWS_AT_ONCE]
        seen = [set(cells) for cells in index.cells(x[b[some]])]
        callers = np.flatnonzero(linked[:, some].any(axis=1))
        for cell in np.unique(own[a[callers]]):
            back[np.ix_(callers[own[a[callers]] == cell], some)] = [cell in cells for cells in seen]
    links[b] += (linked & ~back).T @ n[a]
    i, j = np.nonzero(linked)
    # The same class may be here as member and as visitor: number the classes.
    number = np.unique(node, return_inverse=True)[1]
    parent = np.arange(number.max() + 1 if len(number) else 0)
    unite(parent, number[a[i]], number[b[j]])
    names = np.empty(len(parent), object)
    names[number] = node
    top = unite(parent, *(np.arange(len(parent)),) * 2)
    child = np.flatnonzero(top != np.arange(len(parent)))
    count = np.flatnonzero(links)
    return pa.table(
        {
            "node": pa.array([*node[count], *names[child]], pa.binary()),
            "links": pa.array([*links[count], *[0] * len(child)], pa.int64()),
            "to": pa.array([*[None] * len(count), *names[top[child]]], pa.binary()),
        }
    )


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.9,
    recall: float = 0.995,
    embedding: str = "embedding",
    vec_id: str = "vec_id",
    sample: int = SAMPLE,
) -> DataFrame:
    """A row for each row of ``vectors``: vec_id, n_links (other rows linked directly), component_id
    (smallest vec_id reachable, itself included) and kept (vec_id = component_id).

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing.
    Vectors of different lengths do not link. Repeated rows are linked to each other. Rows with a null
    vec_id are linked, never kept, and name no component. Other columns are not read.
    """
    folder = RunFolder(vectors.sparkSession)

    def name(batch: pa.RecordBatch) -> dict[str, object]:
        found = unit_rows(batch.column("x"))
        nodes = [None if x is None else xxhash.xxh3_128_digest(x.tobytes()) for x in found]
        return {"vec_id": batch.column("vec_id"), "node": nodes, "x": found}

    kinds = dict(vectors.dtypes)
    named = map_rows(
        vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("x")),
        name,
        f"vec_id {kinds[vec_id]}, node binary, x array<double>",
    )
    named = folder.scratch(named)
    classes = named.where("node is not null").groupBy("node")
    classes = folder.scratch(
        classes.agg(F.first("x").alias("x"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    )
    met = None
    for (length,) in classes.select(F.size("x")).distinct().collect():
        more = _meetings(classes.where(F.size("x") == length), folder, least, recall, sample)
        met = more if met is None else met.union(more)
    if met is None:
        alone = named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    edges = met.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b"))
    roots = components(edges, folder).withColumnRenamed("node", "of")
    joined = classes.join(roots, F.col("node") == F.col("of"), "left").select(
        "node", "n", "least", F.coalesce("root", "node").alias("root")
    )
    ids = folder.scratch(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    known = joined.join(ids, "root").join(links, "node", "left")
    known = known.select("node", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = named.select("vec_id", "node").join(folder.scratch(known), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _meetings(classes: DataFrame, folder: RunFolder, least: float, recall: float, sample: int) -> DataFrame:
    """node, links and edges node - to of all blocks, for classes of one length."""
    spark = classes.sparkSession
    order = F.xxhash64("node")
    some = low_hashes(classes.select("node", "x"), order, sample).orderBy(order, "node").limit(sample).toArrow()
    fitted = np.array(some["x"].to_pylist(), np.float64)
    size = min(MOST_WORDS, max(1, round((classes.count() / CELL) ** 0.5)))
    index = spark.sparkContext.broadcast(MultiIndex(fitted, size, least, recall))

    def place(batch: pa.RecordBatch) -> dict[str, object]:
        x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
        visits = index.value.cells(x) if len(x) else []
        out = {c: batch.column(c) for c in ("node", "n", "x")}
        return out | {"own": [v[0] for v in visits], "visits": visits}

    placed = map_rows(
        classes.select("node", "n", "x"),
        place,
        "node binary, n bigint, x array<double>, own int, visits array<int>",
    )
    placed = folder.scratch(placed)
    visitors = placed.withColumn("cell", F.explode("visits")).withColumn("member", F.lit(False)).drop("visits")
    members = placed.withColumn("cell", F.col("own")).withColumn("member", F.lit(True)).drop("visits")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    m = members.groupBy("cell").count().select("cell", blocks.alias("m"))
    v = visitors.groupBy("cell").count().select("cell", blocks.alias("v"))
    sizes = m.join(v, "cell")  # a row for each cell; a cell without members has no work
    both = members.union(visitors).join(sizes, "cell")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("member"), F.col("m")).otherwise(F.col("v"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("v")).otherwise(F.col("m")) - 1))
    dealt = both.withColumn("mine", own).withColumn("theirs", other)
    i = F.when(F.col("member"), F.col("mine")).otherwise(F.col("theirs"))
    j = F.when(F.col("member"), F.col("theirs")).otherwise(F.col("mine"))
    dealt = dealt.select("cell", i.alias("i"), j.alias("j"), "member", "node", "n", "x", "own")
    met = dealt.groupBy("cell", "i", "j").applyInArrow(
        lambda table: compare(table, least, index.value), "node binary, links bigint, to binary"
    )
    return folder.scratch(met)
