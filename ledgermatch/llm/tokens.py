"""Token counts by section, from one encoding of each whole document.

A document's fields are put together and encoded once, as they will be in training. Each token has a
span of characters; sections have spans as well, which cover the document without gaps. An interval
join gives tokens to sections. A token that crosses a boundary goes, by ``rule``,

* ``first``: to the section of its first character,
* ``most``: to the section with most of its characters, the earlier one of equals,
* ``share``: to each section by its share of the characters; counts are fractions then.

Under every rule the counts of a document's sections add up to its tokens.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.llm.textscan import map_rows

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are split before byte pairs are merged; a fixed value of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "most", "share")
#: White space as the pattern has it, and how the pattern ends: of a run of it that a word follows, the last
#: character stands apart from the others.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BLANKS_LAST = r"|\s+(?!\S)|\s+"
#: Longer runs of white space are cut out before the pattern is applied, which needs memory for each character.
LONG_BLANKS = 10_000
#: A pattern that does not split at all.
ONE_PIECE = "(?s).+"


@lru_cache(maxsize=4)
def encoder(ranks: bytes, pattern: str):
    """The encoding, and the bytes of each token by its id."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    lengths = np.zeros(max(table.values()) + 1, np.int64)
    lengths[list(table.values())] = [len(x) for x in table]
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={}), lengths


def encode(text: str, plain, whole, pattern: str, long: int = LONG_BLANKS) -> np.ndarray:
    """Token ids of ``text`` by the encoding ``plain``. A long run of white space goes through ``whole``, which
    takes a text as one piece, less its last character if a word follows, as the pattern would have it."""
    if not pattern.endswith(BLANKS_LAST):
        return np.array(plain.encode_ordinary(text), np.int64)
    parts, at = [], 0
    for run in re.finditer(f"[{BLANK}]{{{long + 1},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        parts += [plain.encode_ordinary(text[at : run.start()]), whole.encode_ordinary(text[run.start() : end])]
        at = end
    parts.append(plain.encode_ordinary(text[at:]))
    return np.concatenate([np.array(x, np.int64) for x in parts])


def character_spans(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters [start, end) of tokens of so many bytes; a character that tokens share counts for
    each of them."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    begun = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return begun[starts] - 1, begun[ends - 1]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section [bounds[k], bounds[k + 1]), and how many tokens cross a boundary."""
    count = len(bounds) - 1
    own = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    out = np.bincount(own[own == last], minlength=count).astype(np.float64)
    crossing = np.flatnonzero(own != last)
    for k in crossing:
        sections = np.arange(own[k], last[k] + 1)
        parts = np.minimum(bounds[sections + 1], ends[k]) - np.maximum(bounds[sections], starts[k])
        if rule == "share":
            out[sections] += parts / parts.sum()
        else:
            out[sections[0 if rule == "first" else int(parts.argmax())]] += 1
    return out, len(crossing)


def count_tokens(
    docs: DataFrame,
    fields: tuple[str, ...] = ("text",),
    separator: str = "\n",
    by_line: bool = False,
    rule: str = "first",
    ranks: str = RANKS,
    pattern: str = PATTERN,
    carry: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """A row for each row of ``docs``: columns ``carry``, n_tokens, n_chars, n_crossing and
    section_tokens.

    The document is its ``fields`` joined by ``separator``. Each field is a section, with the separator
    behind it; ``by_line``, each line of each field, with its line feed. Null fields are empty; empty
    sections have no tokens. Long texts are encoded whole, and runs of white space of any length as the pattern would
    split them (if it ends as the default one does; with others a run of a million fails). Repeated rows each get their row. ``ranks``: a vocabulary file, which is
    read by the driver and sent to the tasks.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(ranks, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kinds = dict(docs.dtypes)

    def sections(values: list[str]) -> list[str]:
        parts = [x + separator for x in values[:-1]] + values[-1:]
        return [y for x in parts for y in _lines(x)] if by_line else parts

    def make(batch: pa.RecordBatch) -> dict[str, object]:
        plain, lengths = encoder(shared.value, pattern)
        whole, _ = encoder(shared.value, ONE_PIECE)
        out: dict[str, list] = {"n_tokens": [], "n_chars": [], "n_crossing": [], "section_tokens": []}
        for values in zip(*(batch.column(f"__{k}").to_pylist() for k in range(len(fields))), strict=True):
            own = sections([x or "" for x in values])
            text = "".join(own)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            ids = encode(text, plain, whole, pattern)
            counts, crossing = np.zeros(len(own)), 0
            if len(ids):
                counts, crossing = attribute(*character_spans(text.encode(), lengths[ids]), bounds, rule)
            out["n_tokens"].append(len(ids))
            out["n_chars"].append(len(text))
            out["n_crossing"].append(crossing)
            out["section_tokens"].append(counts if rule == "share" else counts.astype(np.int64))
        return {c: batch.column(c) for c in carry} | out

    kind = "double" if rule == "share" else "bigint"
    schema = [*(f"`{c}` {kinds[c]}" for c in carry), "n_tokens bigint", "n_chars bigint", "n_crossing bigint"]
    given = docs.select(*carry, *(F.col(c).alias(f"__{k}") for k, c in enumerate(fields)))
    return map_rows(given, make, ", ".join([*schema, f"section_tokens array<{kind}>"]))


def _lines(text: str) -> list[str]:
    """Lines with their line feeds; no text is one empty line."""
    parts = text.split("\n")
    return [x + "\n" for x in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])
