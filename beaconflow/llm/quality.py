"""Quality rules learned from labelled documents as a decision list.

Statistics of every whole text are computed once.  On a bounded labelled sample, sequential covering
learns ordered rules, each a conjunction of threshold conditions: a rule is grown condition by
condition by information gain until it covers no good document, pruned on documents held back, kept if
it is precise there, and what it covers is set aside before the next.  The list becomes one
ordered Spark ``when`` expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import SPACES, add_columns, ngrams, word_hashes
from .common import hashed_sample

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that rules may test.
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share",
            "digit_share", "mark_share", "top_word_share", "run_share"]
UPPER, DIGITS, MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!\"'()*+,-./:;<=>?@[\\]^_`{|}~#$%&"


def text_statistics(text: str | None, words: np.ndarray | None = None) -> tuple:
    """The five counts, then the features other than ``n_words``; null counts as empty (all zero).

    ``words``: the hashes of the text's words, where they are known already.
    """
    b = (text or "").encode()
    h = word_hashes([b], lower=False)[0] if words is None else words
    n = len(h)
    if not n:
        return (0, 0, len(b) - len(b.translate(None, SYMBOLS)), 0, 0, *[0.0] * (len(FEATURES) - 1))
    share = lambda drop, of: (len(b) - len(b.translate(None, drop))) / of
    chars = len(text) - (len(b) - len(b.translate(None, SPACES)))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines, seen, dup = 0, set(), 0
    for line in b.split(b"\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    if n > 5:
        windows, back, times = np.unique(ngrams(h, 5), return_inverse=True, return_counts=True)
        if len(windows) < n - 4:
            edge = np.zeros(n + 1, np.int32)
            starts = np.flatnonzero(times[back] > 1)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + 5, -1)
            repeat = int((np.cumsum(edge[:-1]) > 0).sum())
    _, times = np.unique(h, return_counts=True)
    same = np.flatnonzero(np.diff(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))) > 1)
    return (n, chars, symbols, dup, repeat, chars / n, symbols / n, dup / lines, repeat / n, len(times) / n,
            share(UPPER, chars), share(DIGITS, chars), share(MARKS, chars), float(times.max()) / n, len(same) / n)


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``keep``, COUNTS and FEATURES of every row's whole text."""
    names = [*COUNTS, *FEATURES[1:]]

    def work(texts: list) -> dict[str, list]:
        words, n = word_hashes([(t or "").encode() for t in texts], lower=False)
        ends = np.cumsum(n)
        rows = [text_statistics(t, words[e - k:e]) for t, k, e in zip(texts, n, ends)]
        return {c: list(v) for c, v in zip(names, zip(*rows))}

    new = ", ".join([*[f"{c} long" for c in COUNTS], *[f"{c} double" for c in FEATURES[1:]]])
    return add_columns(docs, [key, *keep], text, new, work)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= limit, else feature <= limit
    limit: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.limit if self.above else v <= self.limit

    def column(self) -> Column:
        return F.col(self.feature) >= self.limit if self.above else F.col(self.feature) <= self.limit


def covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def best_condition(x: np.ndarray, bad: np.ndarray, cuts: int = 64) -> Condition | None:
    """The condition with the greatest information gain for covering bad rows; None if none gains."""
    p0, n0 = bad.sum(), len(bad)
    best, found = 1e-9, None
    for k, name in enumerate(FEATURES):
        limits = np.unique(np.quantile(x[:, k], np.linspace(0, 1, cuts), method="nearest"))
        order = np.sort(x[:, k]), np.sort(x[bad, k])
        for above in (True, False):
            side = "left" if above else "right"
            n = np.searchsorted(order[0], limits, side)
            p = np.searchsorted(order[1], limits, side)
            if above:
                n, p = n0 - n, p0 - p
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(n, 1)) - np.log2(p0 / n0)), -1)
            i = int(gain.argmax())
            if gain[i] > best:
                best, found = gain[i], Condition(name, above, float(limits[i]))
    return found


def learn_rules(x: np.ndarray, bad: np.ndarray, max_rules: int = 12, precision: float = 0.98, least: int = 5,
                patience: int = 8, seed: int = 3) -> list[list[Condition]]:
    """Sequential covering; a rule is kept when on held-back rows it covers ``least`` bad ones with ``precision``.

    Each rule is grown and tried on a random division of the rows; learning ends after ``patience`` divisions in a row
    without a rule that stands.
    """
    rng, rules, failed = np.random.default_rng(seed), [], 0
    while len(rules) < max_rules and bad.sum() >= 2 * least and failed < patience:
        grow = rng.random(len(x)) < 2 / 3
        rule, inside = [], grow.copy()
        while bad[inside].sum() and not bad[inside].all() and len(rule) < 6:
            c = best_condition(x[inside], bad[inside])
            if c is None:
                break
            rule.append(c)
            inside &= c.holds(x)
        # pruning: the prefix of the rule that is worth most on the rows held back
        worth = []
        for k in range(1, len(rule) + 1):
            hit = covers(rule[:k], x) & ~grow
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            worth.append(((p - n) / (p + n) if p + n else -1, p))
        failed += 1
        if not worth:
            continue
        k = max(range(len(worth)), key=lambda i: (round(float(worth[i][0]), 3), worth[i][1], -i)) + 1
        # of several limits on one side of a statistic only the tightest says anything
        last = {(c.feature, c.above): c for c in rule[:k]}
        rule = list(last.values())
        hit = covers(rule, x) & ~grow
        if (hit & bad).sum() < least or (hit & bad).sum() < precision * hit.sum():
            continue
        rules.append(rule)
        failed = 0
        left = ~covers(rule, x)
        x, bad = x[left], bad[left]
    return rules


def learn(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
          sample: int = 30_000) -> list[list[Condition]]:
    """Rules for documents labelled 0, from at most ``sample`` labelled rows (those with the smallest hashed ids).

    Null labels and ids are skipped; no labelled row, or one class only, gives no rules.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_bad"))
    labelled = stats.join(known, stats[key] == known["_k"]).select((F.col("_bad") == 0).alias("_bad"), *FEATURES, key)
    rows = sorted(hashed_sample(labelled, sample, [key]).collect())
    if not rows:
        return []
    x = np.array([[float(r[f]) for f in FEATURES] for r in rows])
    return learn_rules(x, np.array([bool(r["_bad"]) for r in rows]))


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list: the number (from 1) of the first rule that holds, 0 when none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column()
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(stats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Add ``base_failed`` (under 10 words, or over 20 % of the words in repeated windows), ``rule`` and ``kept``."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))
