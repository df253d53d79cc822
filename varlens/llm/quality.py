"""Quality rules as a short-circuit cascade.

Each rule rejects a text or lets it pass.  A bounded sample of rows gives every
rule's cost (seconds per text, with the measures it needs) and selectivity
(share rejected); rules then run in order of rejection per cost, and a text
rejected by one rule never reaches the next.  The order changes the work, never
the verdict.  Measures are computed on first use and kept with the text.

Defined results: a null text has no words, so it is rejected (too short); an
empty table gives an empty table; repeated rows give repeated results; columns
of the input whose names clash with the added ones are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 256
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


class Text:
    """One text (UTF-8 bytes) with its measures, each computed once when asked.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, which is what
    ``bytes.split()`` splits on."""

    def __init__(self, data: bytes | None):
        self.data = data or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def histogram(self) -> np.ndarray:
        return np.bincount(np.frombuffer(self.data, np.uint8), minlength=256)

    @cached_property
    def word_chars(self) -> int:
        h = self.histogram  # bytes that start a code point, less white space
        return int(h[:128].sum() + h[192:].sum() - h[9:14].sum() - h[32])

    @cached_property
    def n_symbols(self) -> int:
        return int(self.histogram[list(SYMBOLS)].sum())

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def ids(self) -> np.ndarray:
        number = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        return np.fromiter(map(number.__getitem__, self.words), np.int64, len(self.words))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of 8 words that occur twice or more.  A hash of
        the windows rules most texts out; else windows of 2, 4 and 8 words are
        numbered by their halves' numbers, which is exact."""
        ids = self.ids
        n = len(ids) - WINDOW + 1
        if n < 2:
            return 0
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        for _ in range(3):  # h over 1, 2, 4, 8 words
            width = len(ids) - len(h) + 1
            h = h[:-width] * np.uint64(0xBF58476D1CE4E5B9) + h[width:] * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
        h.sort()
        if not (h[1:] == h[:-1]).any():
            return 0
        for _ in range(3):
            width = len(self.ids) - len(ids) + 1
            ids = np.unique(ids[:-width] * np.int64(len(self.ids) + 1) + ids[width:], return_inverse=True)[1]
        edge = np.zeros(len(self.ids) + 1, np.int64)
        at = np.flatnonzero(np.bincount(ids)[ids] > 1)
        edge[at] += 1
        edge[at + WINDOW] -= 1
        return int((np.cumsum(edge)[:-1] > 0).sum())

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before."""
        ids = self.ids
        return int((ids[1:] == ids[:-1]).sum())

    @cached_property
    def upper_share(self) -> float:
        h = self.histogram
        upper, lower = int(h[65:91].sum()), int(h[97:123].sum())
        return upper / (upper + lower) if upper + lower else 0.0


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


def too_short(t: Text) -> bool:
    return t.n_words < MIN_WORDS


def repeated_passages(t: Text) -> bool:
    return 100 * t.n_repeat_words > 30 * t.n_words


def many_symbols(t: Text) -> bool:
    return 10 * t.n_symbols > t.n_words


def odd_word_length(t: Text) -> bool:
    return not 2 * t.n_words <= t.word_chars <= 20 * t.n_words


def repeated_lines(t: Text) -> bool:
    return 10 * t.n_dup_lines > 4 * len(t.lines)


def stutter(t: Text) -> bool:
    return 5 * t.n_stutters > t.n_words


def shouting(t: Text) -> bool:
    return t.upper_share > 0.3


RULES = (Rule("too_short", too_short), Rule("repeated_passages", repeated_passages),
         Rule("many_symbols", many_symbols), Rule("odd_word_length", odd_word_length),
         Rule("repeated_lines", repeated_lines), Rule("stutter", stutter), Rule("shouting", shouting))


def estimates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds per text, share rejected), measured on about
    ``sample_rows`` rows of ``docs`` in the executors; one small row per rule
    and task comes back."""
    total = docs.count()
    if not total:
        return [(r.name, 0.0, 0.0) for r in rules]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for data in batch.column(0).cast(pa.binary()).to_pylist():
                n += 1
                for i, rule in enumerate(rules):
                    text, began = Text(data), time.perf_counter()
                    hits[i] += bool(rule.rejects(text))
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "spent": spent, "hits": hits, "n": [n] * len(rules)})

    rows = (docs.select("text").sample(fraction=min(1.0, sample_rows / total), seed=7)
            .mapInArrow(measure, "rule long, spent double, hits long, n long")
            .groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect())
    by = {r["rule"]: r for r in rows}
    return [(rule.name, by[i]["spent"] / max(1, by[i]["n"]), by[i]["hits"] / max(1, by[i]["n"])) if i in by else (rule.name, 0.0, 0.0)
            for i, rule in enumerate(rules)]


def ordered(rules: tuple[Rule, ...], found: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """Rules by rejections per second, highest first; ties keep their place."""
    by = {name: share / max(cost, 1e-9) for name, cost, share in found}
    return tuple(sorted(rules, key=lambda r: -by[r.name]))


def rejected_by(text: Text, rules: tuple[Rule, ...]) -> str | None:
    """The first rule that rejects, or None; later rules are not evaluated."""
    return next((r.name for r in rules if r.rejects(text)), None)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, measures: bool = False, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``passed`` (no rule rejects the whole text).  With
    ``measures`` the counts of ``MEASURES`` are added too, which computes them
    for rejected texts as well."""
    order = ordered(rules, estimates(docs, rules, sample_rows))
    added = [x.split()[0] for x in MEASURES.split(", ")] if measures else []
    kept = docs.select(*[c for c in docs.columns if c not in [*added, "passed"]])
    schema = pa.schema([pa.field(n, pa.int64()) for n in added] + [pa.field("passed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            out: list[list] = [[] for _ in schema]
            for i in range(len(texts)):
                raw = texts[i].as_buffer()
                text = Text(raw.to_pybytes() if raw is not None else b"")
                out[-1].append(rejected_by(text, order) is None)
                for column, name in zip(out, added):
                    column.append(getattr(text, name))
            columns = [pa.array(v, f.type) for v, f in zip(out, schema)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *schema.names])

    fields = [T.StructField(n, T.LongType()) for n in added] + [T.StructField("passed", T.BooleanType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))
