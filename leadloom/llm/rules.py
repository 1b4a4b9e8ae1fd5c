"""Quality rules: statistics of whole texts, and a decision list learnt from labelled statistics."""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let

#: Bound of the fitting sample: labelled rows, those with the smallest seeded hashes.
SAMPLE_ROWS = 6000
#: Statistics the learnt conditions may use, each a share of words or characters.
FEATURES = ("symbol_share", "repeat_share", "dup_line_share", "upper_share", "bar_share", "mean_word", "log_words")


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of width words that occur twice or more in the array, first occurrences included."""

    def of_hashes(h):
        keys = F.transform(
            F.sequence(F.lit(0), F.size(h) - width),
            lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(width)]).alias("h"), i.alias("i")),
        )
        return let(F.sort_array(keys), of_sorted)

    def of_sorted(s):
        twice = F.filter(
            s,
            lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])),
        )
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def covered(p):
        return F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))),
            F.lit(0),
            lambda a, x: a + x,
        )

    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """docs with the contract's statistics and the shares that rules use; null text: no word."""
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("__t", text).withColumn("__w", F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(WORD))
    d = d.select(
        *docs.columns,
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("__t", SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("__t") - F.char_length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("__w")).alias("n_repeat_words"),
        F.char_length(F.regexp_replace("__t", "[^A-Z]", "")).cast("long").alias("__upper"),
        F.size(F.filter("__w", lambda x: x == "|")).cast("long").alias("__bars"),
        F.size(F.split("__t", "\n")).cast("long").alias("__lines"),
    )
    words = F.greatest("n_words", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    return d.select(
        *docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_dup_lines") / F.col("__lines")).alias("dup_line_share"),
        (F.col("__upper") / chars).alias("upper_share"),
        (F.col("__bars") / words).alias("bar_share"),
        (F.col("word_chars") / words).alias("mean_word"),
        F.log1p(F.col("n_words").cast("double")).alias("log_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


def _cuts(values: list[float]) -> list[float]:
    """Thresholds to try: midpoints between neighbours among the 1/128 quantiles."""
    values = sorted(values)
    some = sorted({values[len(values) * k // 128] for k in range(128)} | {values[-1]}) if values else []
    return [(a + b) / 2 for a, b in zip(some, some[1:])]


def learn_rules(rows: list[dict], target: int = 0, min_precision: float = 0.95, min_cover: int = 5, max_conditions: int = 3, max_rules: int = 12) -> list[list[Condition]]:
    """An ordered list of conjunctions that cover rows whose y is target, by sequential covering.

    Two thirds of the rows grow a rule, condition by condition, by FOIL gain; the rest prune it: trailing
    conditions go while (p - n) / (p + n) does not fall. A rule that lacks the precision or the cover on
    both parts ends the search. Rows that a rule covers leave before the next one is grown.
    """
    rows = sorted(rows, key=lambda r: r["h"])
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    cuts = {f: _cuts([r[f] for r in grow]) for f in FEATURES}
    rules: list[list[Condition]] = []

    def holds(c, r):
        return (r[c.feature] > c.threshold) == c.above

    def count(some, conds):
        hit = [r for r in some if all(holds(c, r) for c in conds)]
        p = sum(r["y"] == target for r in hit)
        return p, len(hit) - p

    while len(rules) < max_rules:
        rule: list[Condition] = []
        inside = grow
        while len(rule) < max_conditions:
            p0 = sum(r["y"] == target for r in inside)
            n0 = len(inside) - p0
            if not p0 or not n0:
                break
            best = None
            for f in FEATURES:
                good = sorted(r[f] for r in inside if r["y"] == target)
                other = sorted(r[f] for r in inside if r["y"] != target)
                for t in cuts[f]:
                    p, n = p0 - bisect_right(good, t), n0 - bisect_right(other, t)
                    for above, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
                        if pp >= min_cover:
                            gain = pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0)))
                            if best is None or gain > best[0] + 1e-9:
                                best = gain, Condition(f, above, t)
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
            inside = [r for r in inside if holds(best[1], r)]
        worth = lambda c: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*count(prune, c))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        (p, n), (q, m) = count(grow, rule), count(prune, rule)
        if not rule or p < min_cover or p + q < min_precision * (p + q + n + m) or (q + m and q < min_precision * (q + m)):
            break
        rules.append(rule)
        grow = [r for r in grow if not all(holds(c, r) for c in rule)]
        prune = [r for r in prune if not all(holds(c, r) for c in rule)]
    return rules


def rejected_by(rules: list[list[Condition]]) -> Column:
    """The number, from 1, of the first rule that holds; null if none does."""
    found = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        cond = rule[0].column()
        for c in rule[1:]:
            cond = cond & c.column()
        found = F.when(cond, F.lit(k)).otherwise(found)
    return found


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """The decision list, from the statistics of at most rows labelled documents that pass the base rules.

    A doc_id with several labels has the largest of them.
    """
    chosen = (
        labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("y"))
        .withColumn("h", F.xxhash64("doc_id", F.lit(11))).orderBy("h", "doc_id").limit(rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # rows bounds what is broadcast
    # what fails the base rules goes after the collect: as a filter, it would be pushed below the join, to all documents
    stats = text_statistics(sample).select("h", "y", base_failed().alias("failed"), *FEATURES)
    return learn_rules([r.asDict() for r in stats.collect() if not r.failed])


def apply_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with their statistics, base_failed, rule (number of the rejecting rule or null) and kept."""
    rules = fit_rules(docs, labels, rows)
    return text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", rejected_by(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) for each row.

    Null and empty texts have no words and fail the base rules; repeated rows are judged alike; without
    labels the list is empty and the base rules alone decide; further columns are ignored; an empty table
    gives no rows. The whole text counts; all work but the fit on the bounded sample is column expressions.
    """
    return apply_rules(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, rows).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the rules keep, columns as given, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    return apply_rules(docs.select(row, "doc_id", "text"), labels, rows).where("kept").select("__row.*")
