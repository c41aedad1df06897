"""Quality rules learned as a decision list.

Every document is measured (``measures``); measures of labelled documents train
an ordered list of threshold conjunctions by sequential covering: a rule is
*grown* on two thirds of the rows by adding the condition with the greatest
information gain until it covers no good document, then *pruned* on the other
third by dropping final conditions while its worth (p - n) / (p + n) rises, and
kept only if, on the pruning rows, at least ``PRECISION`` of what it covers is
bad and that is more than ``LEAST`` documents. Rows that a rule covers, kept or
not, are set aside and the next rule is grown. What no rule covers is kept, so documents that
resemble no labelled bad document stay.

The list is emitted as one ordered Spark conditional expression over the measure
columns (``as_expression``) and as text (``as_text``).

Training reads about ``SAMPLE`` labelled documents at most, chosen by the hash of
their id: a bounded sample, whatever the size of the table.

Defined results: a null text has no words and fails the base rule; labels that
are null or whose document is missing are not used; with no labels, or only
one kind, the list is empty and the base rule alone decides; rows that repeat
an id get rows of their own, and the least of their measures trains; very long texts are measured whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pathloom.llm.common import batched, rows, window_hashes, word_hashes

SAMPLE = 20_000
PRECISION = 0.97
LEAST = 5
MAX_CONDITIONS = 4
MAX_RULES = 12
WINDOW = 8

_SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that rules may test, from the counts and the upper-case and punctuation characters.
#: Word lengths and vocabulary are left out: they tell languages and lengths of texts apart rather than quality.
RATIOS = ("symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate")


def measure(text: str | None) -> tuple:
    """The counts of a text, then lines with a word, upper-case letters and marks (``!`` and ``?``)."""
    if not text:
        return (0,) * 8
    data = text.encode("utf-8", "surrogatepass")
    tokens = data.split()
    n = len(tokens)
    chars = len(text) - (len(data) - sum(map(len, tokens)))  # every separator is one byte and one code point
    seen: set[str] = set()
    lines = duplicates = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            duplicates += line in seen
            seen.add(line)
    repeated = 0
    hashes = word_hashes(tokens)
    if n > WINDOW:
        windows = window_hashes(hashes, WINDOW)
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            twice = np.zeros(len(windows) + 1, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice[:-1])
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    symbols = sum(data.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    bytes_ = np.frombuffer(data, np.uint8)
    upper = int(((bytes_ >= 65) & (bytes_ <= 90)).sum())
    marks = data.count(b"!") + data.count(b"?")
    return n, chars, symbols, duplicates, repeated, lines, upper, marks


_NAMES = (*COUNTS, "n_lines", "n_upper", "n_marks")


def _with_ratios(counted: DataFrame, prefix: str = "") -> DataFrame:
    own = lambda n: F.col(prefix + n)
    words, chars = F.greatest(own("n_words"), F.lit(1)), F.greatest(own("word_chars"), F.lit(1))
    ratios = {
        "symbol_rate": own("n_symbols") / words,
        "dup_line_rate": own("n_dup_lines") / F.greatest(own("n_lines"), F.lit(1)),
        "repeat_rate": own("n_repeat_words") / words,
        "upper_rate": own("n_upper") / chars,
        "mark_rate": own("n_marks") / words,
    }
    return counted.withColumns({prefix + n: c for n, c in ratios.items()})


def measures(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts, ratios) of every document."""
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return with_measures(chosen).drop("text")


def with_measures(docs: DataFrame, prefix: str = "", text: str = "text") -> DataFrame:
    """``docs`` with counts and ratios, their names after ``prefix``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [measure(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                for name, values in zip(_NAMES, zip(*found)):
                    part = part.append_column(prefix + name, pa.array(values, pa.int64()))
                yield part

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return _with_ratios(docs.mapInArrow(make, ", ".join([*fields, *(f"{prefix}{n} long" for n in _NAMES)])), prefix)


def base_failed(prefix: str = "") -> Column:
    n, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 20) | (repeated * 100 > n * 30)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.value if self.above else x[self.name] < self.value

    def column(self, prefix: str = "") -> Column:
        own = F.col(prefix + self.name)
        return own >= F.lit(self.value) if self.above else own < F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.value:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x) for c in self.conditions])

    def column(self, prefix: str = "") -> Column:
        out = self.conditions[0].column(prefix)
        for c in self.conditions[1:]:
            out = out & c.column(prefix)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition] | None:
    """The condition of the greatest gain: covered bad rows x rise in log precision."""
    p, n = bad.sum(), (~bad).sum()
    if not p or not n:
        return None
    before, best = np.log2(p / (p + n)), None
    for name in RATIOS:
        values, first = np.unique(x[name], return_inverse=True)
        if len(values) < 2:
            continue
        below_p = np.cumsum(np.bincount(first, bad, len(values)))[:-1]
        below_n = np.cumsum(np.bincount(first, ~bad, len(values)))[:-1]
        cuts = (values[:-1] + values[1:]) / 2
        for above, pp, nn in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - before), -1)
            at = int(np.argmax(gain))
            if gain[at] > 1e-9 and (best is None or gain[at] > best[0]):
                best = float(gain[at]), Condition(name, above, float(cuts[at]))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> list[Rule]:
    """The decision list for rejecting: rows come in the order of their hash, every third is for pruning.

    Covering ends when too few bad rows are left to learn from, when no condition gains anything, or after ``max_rules``
    rules; a rule grows while a condition gains, to ``max_conditions`` of them. Both bound how long the list may get to
    stay readable; they bound no documents.
    """
    prune = np.arange(len(bad)) % 3 == 2
    left, out = np.ones(len(bad), bool), []
    for _ in range(max_rules):
        if (left & ~prune & bad).sum() <= LEAST:
            break
        rows_ = left & ~prune
        grown: list[Condition] = []
        while len(grown) < max_conditions and (found := _best_condition({k: v[rows_] for k, v in x.items()}, bad[rows_])):
            grown.append(found[1])
            rows_ &= found[1].holds(x)
        if not grown:
            break

        def worth(rule: Rule) -> float:
            covered = rule.covers(x) & left & prune
            p, n = (covered & bad).sum(), (covered & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        options = [Rule(tuple(grown[:k])) for k in range(1, len(grown) + 1)]
        rule = max(options, key=lambda r: (worth(r), -len(r.conditions)))
        tested = rule.covers(x) & left & prune
        if (tested & bad).sum() > LEAST and (tested & bad).sum() >= PRECISION * tested.sum():
            out.append(rule)
        left &= ~rule.covers(x)
    return out


def sampled(labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, quality) of about ``limit`` labelled documents at most, by the hash of their id.

    The share to read follows from their number, so each task sends its share and no more.
    """
    own = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, limit / max(1, own.count()))
    return own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def sample(measured: DataFrame, labels: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The measures of the documents of ``labels`` (as ``sampled``), in the order of their hash, and whether they are bad."""
    joined = measured.select("doc_id", *RATIOS).join(labels.select("doc_id", "quality"), "doc_id")
    # One row an id: as many as labels, however often an id is repeated.
    joined = joined.groupBy("doc_id", "quality").agg(F.min(F.struct(*RATIOS)).alias("m")).select(F.xxhash64("doc_id").alias("h"), "doc_id", "m.*", "quality")
    held = joined.toPandas().sort_values(["h", "doc_id", *RATIOS], kind="stable")
    return {c: held[c].to_numpy(float) for c in RATIOS}, held["quality"].to_numpy(int) == 0


def as_expression(rules: list[Rule], prefix: str = "") -> Column:
    """The list as one ordered conditional: the first rule that holds rejects; otherwise the document is kept."""
    out = F.when(base_failed(prefix), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(prefix), F.lit(False))
    return out.otherwise(F.lit(True))


def as_text(rules: list[Rule]) -> str:
    return "\n".join([f"if {r}: reject" for r in rules] + ["else: keep"])


def judge(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """``measured`` with base_failed, kept and the number of the rule that decided (0: the base rule, null: none)."""
    which = F.when(base_failed(), F.lit(0))
    for k, rule in enumerate(rules, 1):
        which = which.when(rule.column(), F.lit(k))
    return measured.withColumns({"base_failed": base_failed(), "kept": as_expression(rules), "rule_no": which})
