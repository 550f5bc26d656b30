"""Quality rules: a decision list learned by sequential covering, applied as ordered conditional expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .columns import BREAKS, chars_without, let, word_list

#: Labelled rows the list is learned from, at most; those with the smallest hash of their id.
LABELLED_ROWS = 20_000
#: Ratios the conditions may use.
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "punct_rate", "digit_rate", "distinct_rate", "solo_rate")


def _window_counts(h: Column) -> Column:
    """Hashes of a text's words -> (repeats, distinct): words in windows of five found twice or more, and different words."""

    def repeated(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(let(F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))

    def covered(order: Column) -> Column:
        def twice(p: Column, k: Column) -> Column:
            after = F.coalesce(F.get(order, k + 1)["h"] == p["h"], F.lit(False))
            return after | F.when(k > 0, F.get(order, F.greatest(k - 1, F.lit(0)))["h"] == p["h"]).otherwise(F.lit(False))

        starts = F.array_sort(F.transform(F.filter(order, twice), lambda p: p["i"]))
        reach = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
        return F.aggregate(starts, reach, lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    at = lambda i, k: F.get(h, i + k)
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2), at(i, 3), at(i, 4)))
    return F.struct(F.when(F.size(h) < 5, F.lit(0)).otherwise(let(windows, repeated)).alias("repeats"), F.size(F.array_distinct(h)).alias("distinct"))


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the ratios of FEATURES (double).

    All of it is built-in functions over the whole text. Windows of five words are compared by a 64-bit hash; texts
    without a repeated window, nearly all, stop at one pass over the hashes. Null texts count as empty: all counts are 0. Repeated rows
    are rows like others, an empty table gives none; columns with a name of the statistics are replaced, all others stay.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    taken = set(docs.columns)
    name = {}
    for short in ("words", "lines", "stat", "distinct", "solo", "n_lines", "upper", "punct", "digit"):
        name[short] = short
        while name[short] in taken:  # no column of the table's own
            name[short] += "_"
    words = name["words"]
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.trim(F.translate(x, BREAKS, " " * len(BREAKS))) != "")
    df = docs.withColumn(words, word_list(F.col(text))).withColumn(name["lines"], lines)
    df = df.withColumn(name["stat"], let(F.transform(words, lambda w: F.xxhash64(w)), _window_counts))
    df = df.withColumns({"n_words": F.size(words).cast("long"), "n_repeat_words": F.col(name["stat"])["repeats"].cast("long"), name["distinct"]: F.col(name["stat"])["distinct"]})
    df = df.withColumns(
        {
            "word_chars": chars_without(whole, " " + BREAKS),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size(name["lines"]) - F.size(F.array_distinct(name["lines"]))).cast("long"),
            name["solo"]: F.size(F.filter(words, lambda w: F.length(w) == 1)),
            name["n_lines"]: F.size(name["lines"]),
            name["upper"]: F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
            name["punct"]: F.length(whole) - F.length(F.translate(whole, "!?;:=/\\@_~^{}[]()\"", "")),
            name["digit"]: F.length(whole) - F.length(F.translate(whole, "0123456789", "")),
        }
    )
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    df = df.withColumns(
        {
            "mean_word": per("word_chars", "n_words"),
            "symbol_rate": per("n_symbols", "n_words"),
            "dup_line_rate": per("n_dup_lines", name["n_lines"]),
            "repeat_rate": per("n_repeat_words", "n_words"),
            "upper_rate": per(name["upper"], "word_chars"),
            "punct_rate": per(name["punct"], "n_words"),
            "digit_rate": per(name["digit"], "word_chars"),
            "distinct_rate": per(name["distinct"], "n_words"),
            "solo_rate": per(name["solo"], "n_words"),
        }
    )
    return df.drop(*name.values())


def base_failed(n_words: str = "n_words", n_repeat: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat) > 20 * F.col(n_words))


@dataclass(frozen=True)
class Rule:
    """If all conditions (feature, sign, threshold) hold, the document is rejected."""

    conditions: tuple[tuple[str, str, float], ...]
    support: int
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, at in self.conditions:
            out = out & (F.col(name) > at if sign == ">" else F.col(name) <= at)
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, at in self.conditions:
            out &= x[name] > at if sign == ">" else x[name] <= at
        return out

    def __str__(self) -> str:
        return "reject if " + " and ".join(f"{n} {s} {a:.6g}" for n, s, a in self.conditions) + f" ({self.support} rows, {self.precision:.3f} right)"


def _cuts(values: np.ndarray, most: int = 64) -> np.ndarray:
    """Thresholds between distinct values, at quantiles if there are many."""
    u = np.unique(values)
    mid = (u[1:] + u[:-1]) / 2
    return mid if len(mid) <= most else np.unique(mid[np.linspace(0, len(mid) - 1, most).astype(int)])


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """FOIL's information gain of a condition that leaves p of p0 wanted and n of n0 other rows."""
    return p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p > 0 else -1.0


def learn_decision_list(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 3, least_precision: float = 0.97, least_support: int = 5) -> list[Rule]:
    """Ordered rules that reject bad rows: grown on two thirds of the rows not yet covered, pruned on the rest.

    A rule grows by the threshold of highest FOIL gain until it covers no good row or the gain ends; then trailing
    conditions go while that doesn't lower (p - n) / (p + n) on the pruning rows. Learning ends when a rule misses the
    precision or support asked for on all rows left. No labelled rows, or of one class only, give an empty list.
    """
    left = np.ones(len(bad), bool)
    grow_part = np.arange(len(bad)) % 3 != 2
    rules: list[Rule] = []
    while len(rules) < most_rules and (left & bad).sum() >= least_support and (left & ~bad).any():
        conditions: list[tuple[str, str, float]] = []
        inside = left & grow_part
        while len(conditions) < most_conditions:
            p0, n0 = float((inside & bad).sum()), float((inside & ~bad).sum())
            if p0 == 0 or n0 == 0:
                break
            best = (1e-9, None)
            for name, values in x.items():
                v, b = values[inside], bad[inside]
                cuts = _cuts(v)
                if not len(cuts):
                    continue
                at = np.searchsorted(cuts, v, side="left")  # v <= cuts[at]
                p_le = np.cumsum(np.bincount(at[b], minlength=len(cuts) + 1))[:-1]
                n_le = np.cumsum(np.bincount(at[~b], minlength=len(cuts) + 1))[:-1]
                for sign, ps, ns in (("<=", p_le, n_le), (">", p0 - p_le, n0 - n_le)):
                    gains = [_gain(float(p), float(n), p0, n0) for p, n in zip(ps, ns, strict=True)]
                    k = int(np.argmax(gains))
                    if gains[k] > best[0]:
                        best = (gains[k], (name, sign, float(cuts[k])))
            if best[1] is None:
                break
            conditions.append(best[1])
            inside &= Rule((best[1],), 0, 0.0).holds(x)
        held = left & ~grow_part

        def worth(c: list, held: np.ndarray = held) -> float:
            m = held & Rule(tuple(c), 0, 0.0).holds(x)
            p, n = (m & bad).sum(), (m & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions = conditions[:-1]
        if not conditions:
            break
        hit = left & Rule(tuple(conditions), 0, 0.0).holds(x)
        support, right = int(hit.sum()), float((hit & bad).sum()) / max(1, hit.sum())
        if right < least_precision or support < least_support:
            break
        rules.append(Rule(tuple(conditions), support, right))
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, reject): the number of the first rule that holds (null: none), and whether there is one."""
    if not rules:
        return F.lit(None).cast("int"), F.lit(False)
    chain = F.when(rules[0].column(), F.lit(0))
    for k, rule in enumerate(rules[1:], 1):
        chain = chain.when(rule.column(), F.lit(k))
    return chain.cast("int"), chain.isNotNull()


def learn_rules(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> list[Rule]:
    """Learns from at most `rows` labelled documents, those with the smallest hash of their id; labels with a null don't count."""
    known = labels.select(F.col("doc_id").alias("of"), (F.col("quality") == 0).alias("bad")).where("of is not null and bad is not null")
    some = known.orderBy(F.xxhash64("of"), "of").limit(rows)
    # at most `rows` rows of 9 bytes: small whatever the tables hold
    labelled = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("of")).drop("of")
    # no filter on the statistics: the optimizer would take it, and with it the statistics of every document, below the join
    made = base_statistics(labelled).select("doc_id", "bad", base_failed().alias("failed"), *FEATURES)
    got = [r for r in made.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect() if not r["failed"]]
    x = {name: np.array([r[name] for r in got], float) for name in FEATURES}
    return learn_decision_list(x, np.array([r["bad"] for r in got], bool)) if got else []


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with the statistics, base_failed, rule (int, null if none) and kept. Columns of these names are replaced. Null texts
    are empty and fail the base rules, texts may be as long as a value of Spark, an empty table gives no rows."""
    rule, reject = verdict(rules)
    made = base_statistics(docs).withColumn("base_failed", base_failed())
    return made.withColumn("rule", F.when(~F.col("base_failed"), rule)).withColumn("kept", ~F.col("base_failed") & ~reject)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    out = apply_rules(docs, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
