"""Operator 6: quality rules as a learned decision list.

``quality_stats`` computes the statistics of whole texts in one Arrow pass
without a shuffle.  ``fit_rules`` learns an ordered list of conjunctions of
thresholds by sequential covering: a rule grows by FOIL gain on two thirds of
the labelled rows, is pruned on the other third, and the rows it covers leave
before the next rule grows.  ``rejected`` turns the list into one ordered Spark
conditional expression.

Defined results: a null or empty text has zero in every statistic; with no
words the ratios are zero; an empty table gives no rows; without labelled rows
of both classes the list is empty and rejects nothing.  Rows that repeat a
doc_id, or have none, are judged each by their own text, and in the fit count
as one, that of the smallest statistics; of repeated labels the worse counts.
A value at a threshold is not above it.  A very long text is a chunk of its own.
Columns that begin with ``__stat_`` are the operator's own; others pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import bounded, chunks, inside, mix64, split_words, window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
PREFIX = "__stat_"
#: Labelled rows that a fit reads at most: those of the smallest hashes of their id.
MAX_LABELLED = 12_000
REPEAT_WIDTH = 5

_SYMBOL_TABLE = np.zeros(256, np.int64)
_SYMBOL_TABLE[list(SYMBOLS)] = 1


def _stats(texts: pa.Array) -> list[np.ndarray]:
    n = len(texts)
    texts = pc.fill_null(texts, "")
    words, firsts = split_words(texts)
    n_words = np.diff(firsts)
    add = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[firsts])
    word_chars = add(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))

    joined = np.frombuffer(b"".join(x.as_py().encode() for x in texts), np.uint8) if n else np.zeros(0, np.uint8)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))]) if n else np.zeros(1, np.int64)
    n_symbols = np.diff(np.concatenate([[0], np.cumsum(_SYMBOL_TABLE[joined])])[ends])

    lines = pc.split_pattern(texts, "\n")
    owner = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    flat = lines.flatten()
    real = pc.not_equal(pc.ascii_trim_whitespace(flat), "").to_numpy(zero_copy_only=False)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair = (owner * (len(flat) + 1) + codes)[real]
    first = np.unique(pair, return_index=True)[1]
    again = np.ones(len(pair), bool)
    again[first] = False
    n_dup = np.bincount(owner[real][again], minlength=n)

    h = window_hashes(word_hashes(words), REPEAT_WIDTH, 0x5851F42D4C957F2D)
    ok = inside(firsts, REPEAT_WIDTH, len(h))
    at = np.flatnonzero(ok)
    text_of = np.searchsorted(firsts, at, "right") - 1
    _, which, times = np.unique(h[at] ^ mix64(text_of.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    cover = np.zeros(len(words) + 1, np.int64)
    twice = at[times[which] > 1] if len(at) else at
    np.add.at(cover, twice, 1)
    np.add.at(cover, np.minimum(twice + REPEAT_WIDTH, len(words)), -1)
    n_repeat = add((np.cumsum(cover)[: len(words)] > 0).astype(np.int64))
    return [n_words, word_chars, n_symbols, n_dup, n_repeat]


def quality_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the five statistics of ``text`` after its own columns, named ``__stat_*``."""
    names = df.columns
    at = names.index(text)
    schema = T.StructType([*df.schema.fields, *(T.StructField(PREFIX + s, T.LongType()) for s in STATS)])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.int64()) for x in _stats(part.column(at)))], [*names, *(PREFIX + s for s in STATS)])

    return bounded(df).mapInArrow(run, schema)


def stat(name: str) -> Column:
    return F.col(PREFIX + name)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


#: Features that rules may test, each an expression over the statistics.
FEATURES = {
    "n_words": lambda: stat("n_words").cast("double"),
    "mean_word_chars": lambda: _ratio(stat("word_chars"), stat("n_words")),
    "symbols_per_word": lambda: _ratio(stat("n_symbols"), stat("n_words")),
    "repeat_share": lambda: _ratio(stat("n_repeat_words"), stat("n_words")),
    "dup_lines_per_word": lambda: _ratio(stat("n_dup_lines"), stat("n_words")),
}


def base_failed() -> Column:
    return (stat("n_words") < 10) | (100 * stat("n_repeat_words") > 20 * stat("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        f = FEATURES[self.feature]()
        return f > F.lit(self.threshold) if self.above else f <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)


def _cover(conditions, x, n: int) -> np.ndarray:
    ok = np.ones(n, bool)
    for c in conditions:
        ok &= c.holds(x)
    return ok


def _best_condition(x, y, ok, cuts: int = 32) -> tuple[float, Condition | None]:
    """The condition with the largest FOIL gain over thresholds between quantiles."""
    p0, n0 = (ok & y).sum(), (ok & ~y).sum()
    best, found = 1e-9, None
    before = np.log2(p0 / (p0 + n0))
    for name, v in x.items():
        own = np.unique(v[ok])
        if len(own) < 2:
            continue
        grid = np.unique(own[np.linspace(0, len(own) - 1, min(cuts, len(own))).astype(int)])
        for t in (grid[1:] + grid[:-1]) / 2:
            for above in (True, False):
                hit = ok & ((v > t) == above)
                p, n = (hit & y).sum(), (hit & ~y).sum()
                if p and (gain := p * (np.log2(p / (p + n)) - before)) > best:
                    best, found = gain, Condition(name, above, float(t))
    return best, found


def learn_list(x: dict[str, np.ndarray], y: np.ndarray, min_precision: float = 0.9, min_cover: int = 8, max_rules: int = 12, max_conditions: int = 4) -> list[Rule]:
    """Ordered rules for the positive class of ``y`` by sequential covering."""
    n = len(y)
    left = np.ones(n, bool)
    grow_set = np.arange(n) % 3 != 0
    rules: list[Rule] = []
    while len(rules) < max_rules and (left & grow_set & y).sum() >= min_cover and (left & grow_set & ~y).any():
        conditions: list[Condition] = []
        ok = left & grow_set
        while len(conditions) < max_conditions and (ok & ~y).any():
            _, c = _best_condition(x, y, ok)
            if c is None:
                break
            conditions.append(c)
            ok = ok & c.holds(x)
        held = left & ~grow_set

        def worth(cs, held=held):
            hit = held & _cover(cs, x, n)
            p, q = (hit & y).sum(), (hit & ~y).sum()
            return (p - q) / (p + q) if p + q else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        hit = left & _cover(conditions, x, n)
        p, q = int((hit & y).sum()), int((hit & ~y).sum())
        # Laplace's correction keeps rules of a few rows from looking certain.
        if not conditions or p < min_cover or (p + 1) / (p + q + 2) < min_precision or worth(conditions) < 2 * min_precision - 1:
            break
        rules.append(Rule(tuple(conditions), p / (p + q), p + q))
        left &= ~hit
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **options) -> list[Rule]:
    """Learn the list from labelled rows: ``labels(doc_id, quality)``, 0 meaning bad.

    At most ``max_labelled`` rows are read, those whose id has the smallest
    hash, so the sample is the same for every layout of the tables.
    """
    order = F.xxhash64("doc_id")
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(order, "doc_id").limit(max_labelled)
    rows = quality_stats(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality"))
    # One row an id, so that no more rows than were asked for come, however often an id repeats.
    one = F.min(F.struct("quality", *(f().alias(k) for k, f in FEATURES.items()))).alias("x")
    got = rows.filter(~base_failed()).groupBy("doc_id").agg(one).select("doc_id", "x.*").toPandas()
    if not len(got):
        return []
    got = got.assign(key=[(int(d) * 0x9E3779B1) % (1 << 32) for d in got["doc_id"]]).sort_values(["key", "doc_id"])
    return learn_list({k: got[k].to_numpy(float) for k in FEATURES}, (got["quality"] == 0).to_numpy(), **options)


def verdict(rules: list[Rule]) -> Column:
    """0 where no rule fires, else the number of the first rule that does (from 1)."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule.conditions[0].column()
        for c in rule.conditions[1:]:
            test = test & c.column()
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = fit_rules(docs, labels)
    failed = base_failed()
    return quality_stats(docs.select("doc_id", "text")).select("doc_id", *(stat(s).alias(s) for s in STATS), failed.alias("base_failed"), (~failed & (verdict(rules) == 0)).alias("kept"), verdict(rules).alias("rule"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass the base rules and the learned list, columns unchanged."""
    rules = fit_rules(docs, labels)
    return quality_stats(docs).filter(~base_failed() & (verdict(rules) == 0)).select(*docs.columns)
