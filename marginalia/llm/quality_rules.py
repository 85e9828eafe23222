"""Quality rules: a decision list learned by sequential covering, applied as one Spark conditional expression.

Everything here is DataFrame work: text statistics are array expressions, learning reads histograms that Spark
aggregates (features x bins rows reach the driver, whatever the corpus), and the verdict is a chain of when().

Defined cases: a null text is an empty text (no words, base_failed). A null doc_id passes through and never meets a
label. Repeated rows are judged alike, each on its own. Ties between candidate conditions go to the first feature and
the lowest cut. Without labels of both kinds no rule is learned and only the base decides. Very long texts are one row of arrays. Extra columns are ignored,
or kept by `flagged` where they don't clash with the names added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, let, words_of

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_chars", "n_lines", "n_marks")


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeat_words(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more, first occurrence included."""

    def windows(ws: Column) -> Column:
        return F.transform(
            F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))),
            lambda w, i: F.struct(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")),
        )

    def repeated(s: Column) -> Column:
        again = F.filter(s, lambda g, k: F.get(s, k + 1)["h"].eqNullSafe(g["h"]) | F.get(s, k - 1)["h"].eqNullSafe(g["h"]))
        return F.sort_array(F.transform(again, lambda g: g["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(let(F.sort_array(let(words, windows)), repeated), covered).cast("long")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and the columns STATS."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = docs.withColumns({"_words": words_of(F.col(text)), "_lines": lines})
    return d.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": _without(body, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_words")),
            "n_upper": _without(body, UPPER).cast("long"),
            "n_chars": F.length(body).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_marks": _without(body, "!?").cast("long"),
        }
    ).drop("_words", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What conditions may test, as shares of a document, so that its length doesn't decide alone."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "marks_per_word": F.col("n_marks") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        f = features()[self.feature]
        return f > self.cut if self.above else f <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction; a document that meets it is rejected."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _cuts(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    share = [k / bins for k in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(c, share, 10_000).alias(n) for n, c in features().items()]).first()
    return {n: sorted({float(x) for x in got[n] or ()}) for n in features()}


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, dict[int, tuple[int, int]]]:
    """Bad and good rows by feature and bin, bin k holding the values over k cuts: features x bins rows in all."""

    def bin_of(value: Column, own: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, own)), lambda cut: cut < value)) if own else F.lit(0)

    binned = F.array(*[bin_of(c, cuts[n]) for n, c in features().items()])
    got = (
        rows.select("bad", F.posexplode(binned).alias("f", "bin"))
        .groupBy("f", "bin")
        .agg(F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n"))
        .collect()
    )
    names = list(features())
    out: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in names}
    for r in got:
        out[names[r["f"]]][r["bin"]] = (r["p"], r["n"])
    return out


def _best(hist: dict, cuts: dict, p0: int, n0: int) -> tuple[float, Condition, int, int] | None:
    """The condition of the highest information gain over p0 bad and n0 good rows."""
    before, found = math.log2(p0 / (p0 + n0)), None
    for name, bins in hist.items():
        low_p = low_n = 0
        for k, cut in enumerate(cuts[name]):
            p, n = bins.get(k, (0, 0))
            low_p, low_n = low_p + p, low_n + n
            for above, p1, n1 in ((True, p0 - low_p, n0 - low_n), (False, low_p, low_n)):
                if p1 <= 0 or (p1, n1) == (p0, n0):
                    continue
                gain = p1 * (math.log2(p1 / (p1 + n1)) - before)
                if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                    found = gain, Condition(name, above, cut), p1, n1
    return found


def _centred(condition: Condition, rows: DataFrame) -> Condition:
    """The condition with its cut halfway to the next value seen above it, so that it decides alike here and leaves room elsewhere."""
    f = features()[condition.feature]
    above = rows.where(f > condition.cut).agg(F.min(f)).first()[0]
    return condition if above is None else replace(condition, cut=(condition.cut + above) / 2)


def learn(labelled: DataFrame, *, bins: int = 32, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.95, min_support: int = 8) -> list[Rule]:
    """Sequential covering over rows with doc_id, STATS and a boolean `bad`.

    Two thirds of the rows grow each conjunction by information gain, the other third prunes it to the prefix of the
    best (p - n) / (p + n) and must show it at least min_precision precise; rows it covers then leave both parts.
    """
    rows = labelled.where(F.col("bad").isNotNull()).withColumn("_grow", F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0)
    cuts = _cuts(rows, bins)
    rules: list[Rule] = []
    count = [F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")]
    while len(rules) < max_rules:
        left = rows
        for r in rules:
            left = left.where(~r.column())
        grow, got = left.where("_grow"), []
        hist = _histogram(grow, cuts)
        some = next(iter(hist.values()))
        p, n = sum(x[0] for x in some.values()), sum(x[1] for x in some.values())
        if p < min_support:
            break
        while len(got) < max_conditions and n and (best := _best(hist, cuts, p, n)):
            _, condition, p, n = best
            got.append(_centred(condition, left))
            if n and len(got) < max_conditions:
                hist = _histogram(grow.where(Rule(tuple(got)).column()), cuts)
        if not got:
            break
        prefixes = [Rule(tuple(got[: k + 1])) for k in range(len(got))]
        seen = left.where(~F.col("_grow")).agg(
            *[F.sum((x.column() & F.col("bad")).cast("long")).alias(f"p{k}") for k, x in enumerate(prefixes)],
            *[F.sum((x.column() & ~F.col("bad")).cast("long")).alias(f"n{k}") for k, x in enumerate(prefixes)],
        ).first()
        worth = [((seen[f"p{k}"] or 0) - (seen[f"n{k}"] or 0)) / max(1, (seen[f"p{k}"] or 0) + (seen[f"n{k}"] or 0)) for k in range(len(got))]
        k = max(range(len(got)), key=lambda i: (worth[i], -i))
        p, n = seen[f"p{k}"] or 0, seen[f"n{k}"] or 0
        if p < max(1, min_support // 2) or p < min_precision * (p + n):
            break
        rules.append(prefixes[k])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the number of the first rule met, from 1; 0 if none is."""
    out = None
    for k, r in enumerate(rules, 1):
        out = F.when(r.column(), k) if out is None else out.when(r.column(), k)
    return F.lit(0) if out is None else out.otherwise(0)


def _learned(stats: DataFrame, labels: DataFrame, doc_id: str, quality: str) -> list[Rule]:
    marks = labels.where(F.col(quality).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.min(quality) == 0).alias("bad"))
    return learn(kept(stats.where(~base_failed()).join(marks, "doc_id"), "quality-labelled"))


def flagged(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """One row for each document: doc_id, STATS, base_failed, rule (0: none), kept. Labels 0 are bad, 1 good."""
    stats = kept(with_stats(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"), "quality-stats")
    rules = _learned(stats, labels, doc_id, quality)
    return stats.withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that flagged() keeps, with their columns, whatever their names.

    Statistics are taken once: the rows that pass the base rules are written beside them, and texts are never shuffled.
    """
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    passed = kept(with_stats(whole).where(~base_failed()).drop("text"), "quality-passed")
    rules = _learned(passed.drop("row"), labels, "doc_id", "quality")
    return passed.where(verdict(rules) == 0).select("row.*")
