"""Mixing sources to target weights by pivotal dependent rounding. DataFrame operations only.

A source's target divided by its size is the expected number of copies of each of its documents. The
whole part is taken as it is. The fractions are rounded by pivotal steps: two documents trade
probability, weighted by their words so that the words expected of both stay the same, until one of
them has 0 or 1. The direction is random, with odds that keep every document's expectation. What is
left of a group of documents is one document with a fraction; those of many groups form the groups
of the next level, and so on up a tree, to one per source, which is rounded at random. A source's
long documents (more than half its mean) are rounded first; what that leaves over in words is carried
to the probabilities of the short ones. So a source's words come within a short document of its
target, where its short documents can make up for it, and within a long one otherwise.

Groups hold ``FAN`` documents on average, by hash, so a source of any size is spread over all tasks.
All random numbers are hashes of the documents: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.sources.rounds import RunFolder

WEIGHTS = (5, 2, 1)
CAP = 3.0
FAN = 48
#: Sources up to which their table is sent to all tasks by hint.
SMALL = 100_000

_LEVEL = "struct<doc_id:bigint,size:bigint,m:bigint,p:double>"


def size_of(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, folder: RunFolder, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP
) -> DataFrame:
    """``sizes`` (source, source_size; one row each) with ``number``, ``weight`` and ``target``.

    Sources are numbered by code point, null last; weights repeat along the numbers. All targets
    together are the sum of all sizes; none is above ``cap`` times its source's size, and what is cut
    off goes to the others by weight, until none is above.
    """
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    dealt = folder.scratch(
        sizes.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id())
    )
    counts = dealt.groupBy("part").agg(F.count("*").alias("own"))  # a row for each partition
    earlier = F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("part", F.coalesce(earlier, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    named = dealt.withColumn("own_rank", rank).join(before, "part")
    number = (F.col("before") + F.col("own_rank")).cast("long")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("number") % len(weights) + 1).cast("int"))
    top = F.lit(float(cap)) * F.col("source_size")
    ready = named.select(*sizes.columns, number.alias("number")).select("*", weight.alias("weight"), top.alias("top"))
    ready = folder.scratch(ready)
    total = float(ready.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        capped = F.col("top") <= F.lit(level) * F.col("weight")
        used, rest, now = ready.agg(
            F.sum(F.when(capped, F.col("top"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))
        ).first()
        if now == full or not rest:
            break
        full, level = now, (total - (used or 0.0)) / rest
    target = F.least("top", F.lit(level) * F.col("weight"))
    return ready.select(*sizes.columns, "number", "weight", target.alias("target"))


def _uniform(*columns: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def _pivot(group: Column, seed: int, level: int) -> Column:
    """Fold a group of documents: those decided, and what is left, if anything."""
    near = 1e-9
    none = F.lit(None).cast(_LEVEL)
    start = F.struct(none.alias("held"), F.array().cast(f"array<{_LEVEL}>").alias("done"))

    def with_p(x: Column, p: Column) -> Column:
        p = F.when(p < near, 0.0).when(p > 1 - near, 1.0).otherwise(p)
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["m"].alias("m"), p.alias("p"))

    def step(state: Column, b: Column) -> Column:
        a = state["held"]
        up = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"])  # words that may move from b to a
        down = F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))
        number = _uniform(F.lit(seed), F.lit(level), a["doc_id"], a["size"], b["doc_id"], b["size"])
        moved = F.when(number * (up + down) < down, up).otherwise(-down)
        pair = F.array(with_p(a, a["p"] + moved / a["size"]), with_p(b, b["p"] - moved / b["size"]))
        left = F.filter(pair, lambda x: (x["p"] > 0) & (x["p"] < 1))
        done = F.filter(pair, lambda x: (x["p"] <= 0) | (x["p"] >= 1))
        paired = F.struct(F.try_element_at(left, F.lit(1)).alias("held"), F.concat(state["done"], done).alias("done"))
        alone = F.struct(b.alias("held"), state["done"].alias("done"))
        return F.when(a.isNull(), alone).otherwise(paired)

    return F.aggregate(group, start, step)


def _rounded(open_: DataFrame, folder: RunFolder, seed: int, few: bool) -> DataFrame:
    """``open_`` (number, doc_id, size, m, p) with every p made 0 or 1. ``few``: there are so few sources
    that a table of them may go to all tasks."""
    decided, level = [], 0
    rows = open_
    while True:
        counts = rows.groupBy("number").agg(F.count("*").alias("n"))
        if not counts.where("n > 1").limit(1).count():
            break
        groups = F.ceil(F.col("n") / FAN).cast("long")
        # Largest first: documents trade with others of about their size, and what is left is small.
        order = F.struct(-F.col("size"), F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size", "m"))
        item = F.struct("doc_id", "size", "m", "p").cast(_LEVEL)
        folded = (
            rows.join(F.broadcast(counts) if few else counts, "number")
            .withColumn("group", F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(level), "doc_id", "size", "m"), groups))
            .repartition("number", "group")  # or a join by number would leave a source's groups together
            .groupBy("number", "group")
            .agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), item.alias("item")))).alias("rows"))
            .select("number", _pivot(F.col("rows")["item"], seed, level).alias("out"))
        )
        folded = folder.scratch(folded)
        decided.append(folded.select("number", F.explode("out.done").alias("x")).select("number", "x.*"))
        rows = folded.where("out.held is not null").select("number", "out.held.*")
        level += 1
    last = _uniform(F.lit(seed), F.lit("last"), "doc_id", "size") < F.col("p")
    out = rows.withColumn("p", last.cast("double"))
    for more in decided:
        out = out.union(more)
    return out


def _words(before: DataFrame, after: DataFrame) -> DataFrame:
    """Words that rounding left over (or took too many) in each source."""
    words = F.col("size") * F.col("p")
    both = before.select("number", words.alias("w")).union(after.select("number", -words))
    return both.groupBy("number").agg(F.sum("w").alias("carry"))


def _with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """``rows`` with probabilities that make up for a source's carried words, as far as they can."""
    free = rows.groupBy("number").agg(
        F.sum(F.col("size") * (1 - F.col("p"))).alias("more"), F.sum(F.col("size") * F.col("p")).alias("less")
    )
    part = F.when(F.col("carry") > 0, F.least(F.col("carry") / F.col("more"), F.lit(1.0))).otherwise(
        F.greatest(F.col("carry") / F.col("less"), F.lit(-1.0))
    )
    shifts = free.join(carry, "number").select("number", part.alias("part"))
    moved = F.when(F.col("part") > 0, F.col("p") + F.col("part") * (1 - F.col("p"))).otherwise(
        F.col("p") * (1 + F.coalesce("part", F.lit(0.0)))
    )
    return rows.join(shifts, "number", "left").select("number", "doc_id", "size", "m", moved.alias("p"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    cap: float = CAP,
    seed: int = 0,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    Null and empty texts have size 0 and no copies. A null source is a source of its own, the last.
    Repeated rows (equal id, source and size) share their copies as evenly as possible, so none gets
    more than ``cap``. No rows: no result rows. Other columns are not read.
    """
    folder = RunFolder(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")
    )
    units = folder.scratch(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")))
    sizes = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("rows")
    )
    sources = folder.scratch(source_targets(sizes, folder, weights, cap))
    small = sources.count() <= SMALL
    few = F.broadcast(sources) if small else sources
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + F.lit(1e-12))
    share = F.greatest(rate - whole, F.lit(0.0)) * F.col("m")  # expected extra copies of a unit's rows
    due = units.join(few, units["source"].eqNullSafe(sources["source"])).select(
        "number",
        "doc_id",
        "size",
        "m",
        "rows",
        "source_size",
        F.floor(share + F.lit(1e-12)).alias("more"),
        share.alias("share"),
    )
    due = folder.scratch(due.withColumn("p", F.greatest(F.col("share") - F.col("more"), F.lit(0.0))))
    has, long_one = (F.col("p") > 1e-9) & (F.col("size") > 0), F.col("size") * 2 * F.col("rows") > F.col("source_size")
    columns = ["number", "doc_id", "size", "m", "p"]
    long_ones = due.where(has & long_one).select(columns)
    done = folder.scratch(_rounded(long_ones, folder, seed, small))
    rest = _with_carry(due.where(has & ~long_one).select(columns), _words(long_ones, done))
    done = done.union(_rounded(folder.scratch(rest), folder, seed + 2, small))
    settled = done.union(due.where(~has).select(columns).withColumn("p", F.lit(0.0)))
    named = settled.join(few, "number").withColumn("more", F.floor(share + F.lit(1e-12)) + F.col("p"))
    turn = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("turn")
    copies = F.when(F.col("size") > 0, whole + (F.col("turn") <= F.col("more")).cast("long")).otherwise(0)
    out = named.select("doc_id", "source", "size", "source_size", "target", "more", turn)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")
    ).withColumn("taken", F.col("copies") * F.col("size"))

