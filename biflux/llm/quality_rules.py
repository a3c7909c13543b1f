"""Ordered reject rules over document statistics, learned from labels by sequential covering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from biflux.llm.common import BLANK_RUN, BLANKS
from biflux.runtime import durable

SYMBOLS = "#*$%&|<>"
#: What the rules test.
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "digit_share",
            "upper_share", "mark_share", "line_words", "wide_share")


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text and the shares made of them; narrow, built-in expressions only.

    A null text has no words and no symbols, a share of nothing is 0. Repeated 3-word windows are told by a 64-bit hash
    within one text. Other columns are ignored.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    trimmed = F.btrim(text, F.lit(BLANKS))
    rows = rows.select(
        "id", "text", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN)).alias("words"))
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "lines": F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""),
        "windows": F.when(F.size("words") >= 3, F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))})
    rows = rows.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    rows = rows.withColumn("sorted", F.when(F.col("repeats"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("sorted", lambda e, k: (F.get("sorted", k - 1)["h"] == e["h"]) | (F.get("sorted", k + 1)["h"] == e["h"]))
    rows = rows.withColumn("repeat_at", F.transform(twice, lambda e: e["i"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform("repeat_at", lambda i: F.array(i, i + 1, i + 2)))))
    rows = rows.select(
        "id", "n_words",
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        _count(text, "0123456789").alias("n_digits"), _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _count(text, ".,;:!?").alias("n_marks"), (F.octet_length(text) - F.length(text)).cast("long").alias("n_wide"))

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))

    return rows.withColumns({
        "word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"), "digit_share": share("n_digits", "word_chars"),
        "upper_share": share("n_upper", "word_chars"), "mark_share": share("n_marks", "n_words"),
        "line_words": share("n_words", "n_lines"), "wide_share": share("n_wide", "word_chars")})


def _condition(tests: list[tuple[str, str, float]]) -> Column:
    out = F.lit(True)
    for name, sign, cut in tests:
        value = F.col(name).cast("double")
        out = out & (value <= cut if sign == "<=" else value > cut)
    return out


def learn(labelled: DataFrame, *, max_rules: int = 8, max_tests: int = 3, cuts: int = 48, least_precision: float = 0.7,
          least_rows: int = 5) -> list[list[tuple[str, str, float]]]:
    """Decision list that covers label 0: rules in order, each a conjunction of (feature, sign, threshold).

    ``labelled`` has the features, ``label`` and ``grow`` (false: the pruning third). A rule grows by the test of highest
    gain, is cut back to the prefix of best worth on the pruning rows, and takes its rows away from the next rule. One
    grouped count over (feature, bin) serves a growing step, so a step brings at most features x cuts rows to the
    driver, whatever the number of labels. Without labels, or with one class only, the list is empty.
    """
    points = [k / cuts for k in range(1, cuts)]
    found = labelled.agg(*[F.percentile_approx(F.col(f).cast("double"), points, 10_000).alias(f) for f in FEATURES],
                         *[F.percentile_approx(F.when(F.col("label") == 0, F.col(f).cast("double")), points, 10_000).alias(f"{f}_0") for f in FEATURES]).first()
    edges = {f: sorted({*(found[f] or []), *(found[f"{f}_0"] or [])}) for f in FEATURES}
    if not any(edges.values()):
        return []

    def bin_of(name: str) -> Column:
        value = F.col(name).cast("double")
        return F.array_size(F.filter(F.array(*[F.lit(float(e)) for e in edges[name]]), lambda edge: edge < value))

    bins = F.array(*[bin_of(f) for f in FEATURES])
    rows = durable(labelled.select(*FEATURES, "label", "grow", bins.alias("bins")).coalesce(16))
    rules: list[list[tuple[str, str, float]]] = []

    def rest() -> DataFrame:
        left = rows
        for rule in rules:
            left = left.where(~_condition(rule))
        return left

    def sums(*keep: Column) -> list[Column]:
        of = F.when(F.col("label") == 0, 1).otherwise(0)
        return [F.coalesce(F.sum(F.when(c, of)), F.lit(0)) for c in keep] + [F.coalesce(F.sum(F.when(c, 1 - of)), F.lit(0)) for c in keep]

    def precision(bad: float, good: float) -> float:
        return (bad + 1) / (bad + good + 2)

    while len(rules) < max_rules:
        rule: list[tuple[str, str, float]] = []
        base = None
        for _ in range(max_tests):
            counted = (
                rest().where(F.col("grow") & _condition(rule)).select("label", F.posexplode("bins").alias("f", "bin"))
                .groupBy("f", "bin").agg(F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("bad"), F.count("*").alias("n")).collect())
            best = None
            for f, name in enumerate(FEATURES):
                own = {r.bin: (r.bad, r.n - r.bad) for r in counted if r.f == f}
                bad_all, good_all = sum(b for b, _ in own.values()), sum(g for _, g in own.values())
                base = precision(bad_all, good_all)
                bad = good = 0
                for k, edge in enumerate(edges[name]):  # bin k: over k edges, so "<= edge k" are the bins 0 to k
                    b, g = own.get(k, (0, 0))
                    bad, good = bad + b, good + g
                    for sign, x, y in (("<=", bad, good), (">", bad_all - bad, good_all - good)):
                        if x >= least_rows:
                            gain = x * (math.log(precision(x, y)) - math.log(base))
                            if best is None or gain > best[0]:
                                best = (gain, (name, sign, edge), x, y)
            if best is None or best[0] <= 1e-9:
                break
            rule.append(best[1])
            if best[3] == 0:
                break
        if not rule:
            return rules
        prefixes = [_condition(rule[:k + 1]) for k in range(len(rule))]
        got = rest().where(~F.col("grow")).agg(*[c.alias(f"c{i}") for i, c in enumerate(sums(*prefixes))]).first()
        worth = [((got[k] - got[k + len(rule)]) / max(1, got[k] + got[k + len(rule)]), -k, k) for k in range(len(rule))]
        keep = max(worth)[2]
        if got[keep] < least_rows or precision(got[keep], got[keep + len(rule)]) < least_precision:
            return rules
        rules.append(rule[:keep + 1])
    return rules


def verdict(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The list as one ordered conditional: the first rule that holds rejects, none keeps."""
    if not rules:
        return F.lit(True)
    out = F.when(_condition(rules[0]), F.lit(False))
    for rule in rules[1:]:
        out = out.when(_condition(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          **limits) -> DataFrame:
    """Statistics and verdict of every document: the columns of ``statistics`` with ``base_failed`` and ``kept``.

    Labels are matched by id; of repeated labels the lowest counts, null ones and null ids are none. All labelled rows
    take part, a third of them (by a hash of the id) only in pruning.
    """
    stats = durable(statistics(docs, id_col=id_col, text_col=text_col))
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    labelled = stats.join(known, "id").withColumn("grow", F.pmod(F.xxhash64("id"), F.lit(3)) > 0)
    rules = learn(labelled, **limits)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules)).withColumnRenamed("id", id_col)
