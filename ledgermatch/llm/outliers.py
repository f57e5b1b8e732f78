"""Quality rules by robust multivariate outliers.

Each text gets counts (words, characters, symbols, repeated lines, words in repeated windows). A few plain rules
reject on them at once. The others are judged together: the counts become five statistics on scales
on which ordinary texts spread evenly, and for each language and source the minimum covariance determinant
gives the place and shape of the bulk of its texts. A text whose Mahalanobis distance from that is beyond what
nearly all ordinary texts would have is rejected.

The estimate is the half of the texts whose covariance has the smallest determinant, found by concentration
steps: distances to the present estimate, the nearest half, its mean and covariance, until the determinant
no longer falls.
A step is one pass over all texts of all groups. Texts are summed by (group, bin of distance), so that a
group of any size is spread over all tasks, and bins in order of distance make up the half. Statistics are whole
numbers of small steps, so that all sums are exact and runs agree. Steps start from two estimates, by medians
and by means, and the one with the smaller determinant wins. A last step takes all texts within the usual distance.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.llm.textscan import PIECE, SOLID, as_bytes, map_rows
from ledgermatch.sources.rounds import RunFolder

#: Characters that count as symbols, and words of a window.
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Statistics, and the deviation in each that is ordinary wherever it is found: what spreads less in a
#: group than this is held to spread as much.
ALLOWED = {"length": 1.5, "word": 0.08, "symbols": 0.35, "lines": 0.5, "repeats": 0.08}
FEATURES = tuple(ALLOWED)
SIZE = len(FEATURES)
#: Words of an average kind that averages are taken over besides a text's own, so that those of short
#: texts don't spread more than others'.
ORDINARY_WORDS, ORDINARY_LENGTH = 50, 5
#: Steps to a unit of a statistic.
STEPS = 1024
#: Texts that an estimate is made from at least.
LEAST_TEXTS = 100
#: Share of ordinary texts whose distances are within the limit, and within the last step.
WITHIN, LAST = 0.9999, 0.975
#: Bins of distance: so many to a doubling, from 2 ** -LOW to 2 ** HIGH.
PER_DOUBLING, LOW, HIGH = 64, 16, 40
MOST_ROUNDS = 30
#: Steps end when the logarithm of no determinant falls by as much as this.
SETTLED = 0.01

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL_BYTES = np.zeros(256, np.int64)
_SYMBOL_BYTES[list(SYMBOLS.encode())] = 1
_WORD_START = SOLID & ((np.arange(256) & 0xC0) != 0x80)


def _numbers(data: bytes) -> np.ndarray:
    """A number for each word, equal for equal words. Words are looked up piece by piece, so that only
    distinct ones are held."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts, at = [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and SOLID[data[end]]:
            end += 1
        words = data[at:end].split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(parts)


def _repeated(words: np.ndarray, size: int = WINDOW) -> int:
    """Words in windows that occur twice or more. Windows are numbered exactly, pair by pair."""
    windows = len(words) - size + 1
    if windows < 2:
        return 0
    number = words[:windows]
    for k in range(1, size):
        pair = number * (int(words.max()) + 1) + words[k : k + windows]
        number = np.unique(pair, return_inverse=True)[1]
    often = np.bincount(number)[number] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(often), 1)
    np.add.at(edges, np.flatnonzero(often) + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def _repeated_lines(data: bytes) -> int:
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def text_counts(data: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    words = _numbers(data)
    chars = symbols = 0
    for at in range(0, len(data), PIECE):
        found = np.bincount(np.frombuffer(data, np.uint8, min(PIECE, len(data) - at), at), minlength=256)
        chars, symbols = chars + int(found[_WORD_START].sum()), symbols + int(found @ _SYMBOL_BYTES)
    return len(words), chars, symbols, _repeated_lines(data), _repeated(words)


def _statistics() -> dict[str, Column]:
    words, all_words = F.col("n_words"), F.col("n_words") + ORDINARY_WORDS
    values = {
        "length": F.log1p(words),
        "word": F.log((F.col("word_chars") + ORDINARY_WORDS * ORDINARY_LENGTH) / all_words),
        "symbols": F.log1p(20 * F.col("n_symbols") / all_words),
        "lines": F.log1p(100 * F.col("n_dup_lines") / all_words),
        "repeats": F.col("n_repeat_words") / all_words,
    }
    return {f: F.round(v * STEPS).cast("long") for f, v in values.items()}


def _name(*parts: str) -> Column:
    """One text for several columns, different for different values and nulls."""
    return F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), F.col(p)), F.lit("-")) for p in parts])


def _groups(rows: DataFrame, folder: RunFolder) -> DataFrame:
    """``lang``, ``source`` and ``cell``, the group whose estimate they go by. Groups with too few texts
    are taken together by language, and if these are still too few, over all languages; if all of them
    are too few, they have no estimate."""
    sizes = rows.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    few = folder.scratch(sizes.withColumn("few", F.col("n") < LEAST_TEXTS))
    by_lang = few.where("few").groupBy("lang").agg(F.sum("n").alias("of_lang"))
    rest = by_lang.where(F.col("of_lang") < LEAST_TEXTS).agg(F.coalesce(F.sum("of_lang"), F.lit(0)).alias("of_rest"))
    enough = rest.first()[0] >= LEAST_TEXTS
    of_lang = by_lang.withColumnRenamed("lang", "l")
    joined = few.join(of_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    own, shared = F.concat(F.lit("s"), _name("lang", "source")), F.concat(F.lit("l"), _name("lang"))
    cell = F.when(~F.col("few"), own).when(F.col("of_lang") >= LEAST_TEXTS, shared)
    cell = cell.otherwise(F.lit("all") if enough else F.lit(None))
    return folder.scratch(joined.select("lang", "source", cell.alias("cell")))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(SIZE) for j in range(i + 1)]


def _distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance from the estimate ``mean``, ``root``: the sum of squares of the
    deviations multiplied by the lower triangle ``root``, row by row."""
    apart = [F.col(f).cast("double") - F.col(f"{prefix}mean")[i] for i, f in enumerate(FEATURES)]
    at = {p: k for k, p in enumerate(_pairs())}
    scaled = [
        reduce(Column.__add__, [F.col(f"{prefix}root")[at[i, j]] * apart[j] for j in range(i + 1)]) for i in range(SIZE)
    ]
    return reduce(Column.__add__, [z * z for z in scaled])


_ESTIMATE = "cell string, start string, mean array<double>, root array<double>, size double"


def _chi2(x: float, df: int) -> float:
    """Distribution function of the squared distance of ``df`` normal variables, for odd ``df``."""
    total = math.erf(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(3, df + 1, 2):
        total, term = total - term, term * x / k
    return total


def _quantile(share: float, df: int = SIZE) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2(middle, df) < share else (low, middle)
    return high


def _factor(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal variables must be multiplied by."""
    return share / _chi2(_quantile(share), SIZE + 2)


def _estimates(sums: DataFrame, share: Column) -> DataFrame:
    """Estimates from ``n``, ``s`` (sums of the statistics) and ``q`` (sums of their products) by cell and
    start; ``share`` is the share of ordinary texts that these are. ``size`` is the logarithm of the determinant."""
    floor = np.diag([(ALLOWED[f] * STEPS) ** 2 for f in FEATURES])
    rows, columns = (np.array(x) for x in zip(*_pairs(), strict=True))

    def solve(batch: pa.RecordBatch) -> dict[str, object]:
        n = batch.column("n").to_numpy().astype(np.float64)
        s, q = (batch.column(c).flatten().to_numpy().astype(np.float64) for c in ("s", "q"))
        mean = s.reshape(-1, SIZE) / n[:, None]
        product = np.zeros((len(n), SIZE, SIZE))
        product[:, rows, columns] = q.reshape(len(n), -1) / n[:, None]
        product[:, columns, rows] = product[:, rows, columns]
        shape = product - mean[:, :, None] * mean[:, None, :]
        shape = shape * batch.column("factor").to_numpy()[:, None, None] + floor
        lower = np.linalg.cholesky(shape)
        root = np.linalg.inv(lower)
        size = 2 * np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(1)
        return {
            "cell": batch.column("cell"),
            "start": batch.column("start"),
            "mean": list(mean),
            "root": list(root[:, rows, columns]),
            "size": size,
        }

    return map_rows(sums.select("cell", "start", "n", "s", "q", share.alias("factor")), solve, _ESTIMATE)


def _moments() -> list[Column]:
    s = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    q = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}_{j}") for i, j in _pairs()]
    return [F.count("*").alias("n"), *s, *q]


_NAMES = ["n", *(f"s{i}" for i in range(SIZE)), *(f"q{i}_{j}" for i, j in _pairs())]


def _packed(sums: DataFrame) -> DataFrame:
    s = F.array(*[F.col(f"s{i}") for i in range(SIZE)])
    q = F.array(*[F.col(f"q{i}_{j}") for i, j in _pairs()])
    return sums.select("cell", "start", "n", s.alias("s"), q.alias("q"))


def _from_medians(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Medians and quartiles of each statistic, from counts of its values, as estimates without correlations."""
    stacked = rows.select("cell", F.posexplode(F.array(*FEATURES)).alias("k", "v"))
    counts = stacked.groupBy("cell", "k", "v").agg(F.count("*").alias("c")).join(sizes, "cell")
    below = F.sum("c").over(Window.partitionBy("cell", "k").orderBy("v"))
    counts = counts.withColumn("below", below)
    at = [F.min(F.when(F.col("below") >= F.col("all") * q, F.col("v"))) for q in (0.25, 0.5, 0.75)]
    marks = counts.groupBy("cell", "k").agg(at[1].alias("middle"), ((at[2] - at[0]) / 1.349).alias("spread"))
    marks = marks.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("k", "middle", "spread"))).alias("m"))  # five
    spread = [F.greatest(F.col("m")[i]["spread"], F.lit(ALLOWED[f] * STEPS)) for i, f in enumerate(FEATURES)]
    root = F.array(*[1 / spread[i] if i == j else F.lit(0.0) for i, j in _pairs()])
    return marks.select(
        "cell",
        F.lit("medians").alias("start"),
        F.transform("m", lambda x: x["middle"].cast("double")).alias("mean"),
        root.alias("root"),
        F.lit(0.0).alias("size"),
    )


def _half(n: Column) -> Column:
    return F.floor((n + SIZE + 1) / 2)


def _concentrate(rows: DataFrame, sizes: DataFrame, now: DataFrame) -> DataFrame:
    """One step: sums over the nearest half by the present estimates."""
    near = rows.join(now, "cell").withColumn("d2", _distance())
    place = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(2.0**-LOW))) * PER_DOUBLING)
    binned = near.withColumn("bin", F.least(place, F.lit(HIGH * PER_DOUBLING)).cast("int"))
    bins = binned.groupBy("cell", "start", "bin").agg(*_moments()).join(sizes, "cell")
    nearer = F.sum("n").over(Window.partitionBy("cell", "start").orderBy("bin")) - F.col("n")
    taken = bins.withColumn("nearer", nearer).where(F.col("nearer") < _half(F.col("all")))
    sums = taken.groupBy("cell", "start").agg(*[F.sum(c).alias(c) for c in _NAMES])
    return _estimates(_packed(sums), F.lit(_factor(0.5)))


def estimates(rows: DataFrame, folder: RunFolder) -> DataFrame:
    """Final estimates by ``cell`` for ``rows`` (``cell`` and the statistics of the texts to fit)."""
    sizes = folder.scratch(rows.groupBy("cell").agg(F.count("*").alias("all")))
    whole = rows.groupBy("cell").agg(*_moments()).withColumn("start", F.lit("means"))
    starts = _estimates(_packed(whole), F.lit(1.0)).union(_from_medians(rows, sizes))
    now = folder.scratch(_concentrate(rows, sizes, starts))
    for _ in range(MOST_ROUNDS):
        before = now.select("cell", "start", F.col("size").alias("larger"))
        now = folder.scratch(_concentrate(rows, sizes, now))
        fall = now.join(before, ["cell", "start"]).agg(F.max(F.col("larger") - F.col("size"))).first()[0]
        if fall is None or fall < SETTLED:
            break
    best = now.groupBy("cell").agg(F.min(F.struct("size", "start", "mean", "root")).alias("b")).select("cell", "b.*")
    inside = rows.join(best, "cell").where(_distance() <= _quantile(LAST))
    sums = inside.groupBy("cell", "start").agg(*_moments())
    return folder.scratch(_estimates(_packed(sums), F.lit(_factor(LAST))))


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    lang: str = "lang",
    source: str = "source",
    least_words: int = 10,
    most_repeats: int = 20,
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (fewer than ``least_words`` words, or more than ``most_repeats`` in a hundred in repeated
    windows), distance (squared Mahalanobis distance, null where there is no estimate) and kept.

    Null and empty texts have no words and fail. Texts of any length are read whole, a piece at a time; the
    numbers of a text's words and its distinct words and lines are held in memory. A null language or source is
    a value like any other. Repeated rows count again and get rows of their own. A group with fewer than
    100 texts that did not fail goes by the estimate of such groups of its language, or of all; where that
    is too few as well (an empty or small table), a text is kept unless it failed. Other columns are not
    read, whatever their names.
    """
    folder, kind = RunFolder(docs.sparkSession), dict(docs.dtypes)[doc_id]

    def read(batch: pa.RecordBatch) -> dict[str, object]:
        found = np.array([text_counts(x or b"") for x in as_bytes(batch.column("text"))], np.int64).reshape(-1, len(COUNTS))
        named = {c: batch.column(c) for c in ("doc_id", "lang", "source")}
        return named | {c: found[:, k] for k, c in enumerate(COUNTS)}

    columns = [F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang")]
    columns += [F.col(source).cast("string").alias("source"), F.col(text).alias("text")]
    schema = ", ".join([f"doc_id {kind}, lang string, source string", *(f"{c} bigint" for c in COUNTS)])
    counted = map_rows(docs.select(*columns), read, schema)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    rows = folder.scratch(counted.withColumn("base_failed", failed).withColumns(_statistics()))
    groups = _groups(rows, folder).select(F.col("lang").alias("l"), F.col("source").alias("s"), "cell")
    same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    placed = folder.scratch(rows.join(groups, same, "left").drop("l", "s"))
    fit = placed.where(~F.col("base_failed") & F.col("cell").isNotNull()).select("cell", *FEATURES)
    known = estimates(fit, folder).select("cell", "mean", "root")
    distance = F.when(F.col("mean").isNotNull(), _distance())
    judged = placed.join(known, "cell", "left").withColumn("distance", distance)
    within = F.coalesce(F.col("distance") <= _quantile(WITHIN), F.lit(True))
    return judged.select("doc_id", *COUNTS, "base_failed", "distance", (~F.col("base_failed") & within).alias("kept"))
