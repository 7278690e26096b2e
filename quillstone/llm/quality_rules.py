"""Quality rules: decision lists learned by sequential covering, applied as Spark conditionals."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.base import cut, documents, fold, load
from quillstone.llm.doc_stats import RATIOS, add_stats, ratio


@dataclass(frozen=True)
class Test:
    """One threshold test of a statistic; ``above`` means strictly greater."""

    name: str
    above: bool
    threshold: float
    bin: int

    def on_value(self) -> Column:
        return ratio(self.name) > self.threshold if self.above else ratio(self.name) <= self.threshold

    def on_bin(self) -> Column:
        return F.col(f"b_{self.name}") > self.bin if self.above else F.col(f"b_{self.name}") <= self.bin

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules, each a conjunction that says reject; what none covers gets ``default_keep``."""

    rules: list[tuple[Test, ...]] = field(default_factory=list)
    default_keep: bool = True

    def keep(self) -> Column:
        """The list as one ordered conditional over the columns of add_stats()."""
        out = None
        for rule in self.rules:
            held = all_of([t.on_value() for t in rule])
            out = F.when(held, F.lit(False)) if out is None else out.when(held, F.lit(False))
        return F.lit(self.default_keep) if out is None else out.otherwise(F.lit(self.default_keep))

    def number(self) -> Column:
        """The 1-based rule that decided a row, 0 for the default."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            held = all_of([t.on_value() for t in rule])
            out = F.when(held, F.lit(i)) if out is None else out.when(held, F.lit(i))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def __str__(self) -> str:
        lines = [f"if {' and '.join(map(str, rule))}: reject" for rule in self.rules]
        return "\n".join([*lines, f"otherwise: {'keep' if self.default_keep else 'reject'}"])


def all_of(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def learn(stats: DataFrame, labels: DataFrame, bins: int = 16, max_rules: int = 8, max_tests: int = 3, min_precision: float = 0.8, min_support: int = 5) -> DecisionList:
    """Grow and prune rules that cover the rows of label 0.

    The labelled rows become counts per combination of quantile bins; each step of
    growing reads one histogram of bounded size (statistics x bins x labels) from
    them. A third of the rows, by crc32 of the id, is kept for pruning. Rows without
    a label, labels other than 0 and 1 and a repeated label that disagrees are not
    learned from; with no labelled rows the list is empty and keeps everything.
    """
    names = list(RATIOS)
    told = labels.select("doc_id", "quality").where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_y"), F.max("quality").alias("_z")).where("_y = _z").drop("_z")
    rows = stats.join(told, "doc_id").select("doc_id", "_y", *[ratio(n).alias(n) for n in names])
    points = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(n, points, 2000).alias(n) for n in names]).first()
    if found[names[0]] is None:
        return DecisionList()
    edges = {n: sorted(set(found[n])) for n in names}
    binned = [sum(((F.col(n) > e).cast("int") for e in edges[n]), F.lit(0)).alias(f"b_{n}") for n in names]
    cells = cut(rows.select(*binned, "_y", (fold(F.col("doc_id"), 3) == 0).alias("_prune")).groupBy(*[f"b_{n}" for n in names], "_y", "_prune").count(), "rule-cells")

    open_cells, made = F.lit(True), DecisionList()

    def histogram(held: Column) -> dict:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"b_{n}").alias("bin")) for n in names])).alias("at")
        got = cells.where(open_cells & held & ~F.col("_prune")).select("_y", "count", each).groupBy("at.name", "at.bin", "_y").agg(F.sum("count").alias("n")).collect()
        out = {n: [[0, 0] for _ in range(len(edges[n]) + 1)] for n in names}
        for r in got:
            out[r["name"]][r["bin"]][r["_y"]] = r["n"]
        return out

    for _ in range(max_rules):
        rule: list[Test] = []
        while len(rule) < max_tests:
            table = histogram(all_of([t.on_bin() for t in rule]))
            total = [sum(c[y] for c in table[names[0]]) for y in (0, 1)]
            if not total[0] or not total[1]:
                break
            best, gain = None, 1e-9
            for n in names:
                below = [0, 0]
                for b, e in enumerate(edges[n]):
                    below = [below[y] + table[n][b][y] for y in (0, 1)]
                    for above, (p, q) in ((False, below), (True, [total[y] - below[y] for y in (0, 1)])):
                        if p < min_support:
                            continue
                        g = p * (math.log2(p / (p + q)) - math.log2(total[0] / sum(total)))
                        if g > gain:
                            best, gain = Test(n, above, e, b), g
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        held = [all_of([t.on_bin() for t in rule[: k + 1]]) for k in range(len(rule))]
        sums = [F.coalesce(F.sum(F.when(h & (F.col("_y") == y) & (F.col("_prune") == p), F.col("count"))), F.lit(0)) for h in held for p in (True, False) for y in (0, 1)]
        got = list(cells.where(open_cells).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
        scored = []
        for k in range(len(rule)):
            p, q, p1, q1 = got[4 * k : 4 * k + 4]
            scored.append(((p - q) / (p + q) if p + q else -1.0, -k, (p + p1) / max(1, p + q + p1 + q1), p + p1))
        worth, k, precision, support = max(scored)
        rule = rule[: 1 - k]
        if worth <= 0 or precision < min_precision or support < min_support:
            break
        made.rules.append(tuple(rule))
        open_cells = open_cells & ~all_of([t.on_bin() for t in rule])
    rest = {r["_y"]: r["n"] for r in cells.where(open_cells).groupBy("_y").agg(F.sum("count").alias("n")).collect()}
    made.default_keep = rest.get(1, 0) >= rest.get(0, 0)
    return made


def apply_rules(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """stats with base_failed, kept and rule (which rule decided; 0: the default)."""
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return stats.withColumns({"base_failed": failed, "kept": F.when(failed, F.lit(False)).otherwise(rules.keep()), "rule": rules.number()})


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict of the learned list for every document.

    Null and empty texts have no words and so fail the base rule; repeated rows give
    repeated rows; an empty table gives an empty result; further columns are ignored.
    """
    stats = cut(add_stats(documents(load(spark, sf_dir, "documents"))), "stats")
    rules = learn(stats, load(spark, sf_dir, "labels"))
    return apply_rules(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
