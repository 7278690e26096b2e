"""Aggregates over evaluation results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T


def _rate(part, whole):
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 9)


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Runs, successes, retention, completion and fabrications of each group; rates are null on nothing, failures have no scores."""
    ok = F.col("status") == "success"
    passed, done = F.count_if(ok & F.col("passed")), F.count_if(ok & (F.col("completion") == "passed"))
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("succeeded"), _rate(passed, F.count_if(ok)).alias("retention"), _rate(done, F.count_if(ok)).alias("completion_rate"), F.count_if(ok & (F.col("completion") == "fabricated")).alias("fabrications"), F.round(F.avg(F.when(ok, F.col("context_tokens"))), 6).alias("mean_context_tokens")
    )


def failure_class(results: DataFrame) -> DataFrame:
    """The class of each failed result: fabricated text is hallucination, an overfull context budget overflow, else the check's category."""
    kind = F.when(F.col("status") != "success", "not_measured").when(F.col("completion") == "fabricated", "hallucination").when(F.col("context_tokens") > F.col("budget"), "budget_overflow").when(~F.col("passed"), F.concat("category", F.lit("_loss")))
    return results.withColumn("failure_class", kind).where("failure_class is not null")


def comparability(results: DataFrame) -> DataFrame:
    """Per strategy how many models were mixed; more than one makes its numbers incomparable."""
    return results.groupBy("strategy").agg(F.count_distinct("model").alias("models")).withColumn("comparable", F.col("models") <= 1)


def shared_coverage(results: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that every strategy covers: counted, not collected."""
    arms = results.agg(F.count_distinct("strategy").alias("arms"))
    return results.groupBy(key).agg(F.count_distinct("strategy").alias("n")).join(F.broadcast(arms)).where("n = arms").select(key)


def pending_cells(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def category_scores(results: DataFrame) -> DataFrame:
    return results.where("status = 'success'").groupBy("category").agg(F.count(F.lit(1)).alias("checks"), F.round(F.avg(F.col("passed").cast("double")), 9).alias("score"))


def completed(criteria: DataFrame, key: str) -> DataFrame:
    """Per scenario: null if none or any criterion is not evaluable, else whether all passed."""
    none = F.bool_or(F.col("completion") == "not_evaluable")
    return criteria.groupBy(key).agg(F.when(none, F.lit(None)).otherwise(F.bool_and(F.col("completion") == "passed")).alias("completed"))


def calibration(results: DataFrame, reference: str, least: float = 0.7) -> DataFrame:
    """Whether judged answers of the reference strategy can be trusted: its share that passed, void below ``least``."""
    own = results.where((F.col("strategy") == reference) & (F.col("status") == "success"))
    share = F.try_divide(F.count_if("passed").cast("double"), F.count(F.lit(1)))
    return own.agg(F.count(F.lit(1)).alias("judged"), F.round(share, 9).alias("share"), (share < least).alias("void"))


def matrix(scenarios: DataFrame, strategies: list[str], budgets: list[int], reference: str, repetitions: int) -> DataFrame:
    """Planned cells: each scenario and repetition once for the reference, and for every other strategy at every budget."""
    cells = [(reference, None)] + [(s, b) for s in strategies if s != reference for b in budgets]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(b).cast("int").alias("budget")) for s, b in cells])).alias("cell")
    runs = scenarios.select("scenario_id", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition"))
    return runs.select("scenario_id", "repetition", each).select("scenario_id", "repetition", "cell.strategy", "cell.budget")


def holds(text: Column, required: Column, required_any: Column, forbidden: Column, case: bool = False) -> Column:
    """A retention check: all of required stand in the text, one of required_any (if there are any), none of forbidden."""
    low = (lambda c: c) if case else F.lower
    held = low(F.coalesce(text, F.lit("")))
    has = lambda x: F.contains(held, low(x))
    none = F.array().cast("array<string>")
    some = F.coalesce(required_any, none)
    return F.forall(F.coalesce(required, none), has) & ((F.size(some) == 0) | F.exists(some, has)) & ~F.exists(F.coalesce(forbidden, none), has)


def outcome(response: Column, expected: Column, alternatives: Column, min_words: Column, requires_execution: Column) -> Column:
    """A completion criterion's outcome, by the first rule that holds."""
    low, none = F.lower(F.coalesce(response, F.lit(""))), F.array().cast("array<string>")
    has = lambda x: F.contains(low, F.lower(x))
    wanted = F.coalesce(expected, none)
    return (
        F.when(F.coalesce(requires_execution, F.lit(False)), "not_evaluable")
        .when(F.exists(F.coalesce(alternatives, none), has), "fabricated")
        .when((F.size(wanted) > 0) & ~F.exists(wanted, has), "omitted")
        .when(F.coalesce(min_words, F.lit(0)) > T.word_count(response), "insubstantial")
        .otherwise("passed")
    )


def disowned(warnings: Column) -> Column:
    """Whether a run says of itself that it is no measurement of its strategy."""
    return F.coalesce(F.exists(warnings, lambda w: F.contains(w, F.lit("should not be read as"))), F.lit(False))


def measured(results: DataFrame) -> DataFrame:
    """Successful results that do not disown themselves."""
    return results.where((F.col("status") == "success") & ~disowned(F.col("warnings")))


def cells(results: DataFrame) -> DataFrame:
    """Per strategy and budget: runs, succeeded, disowned, the failures by status as a map, and scores of the measured runs only."""
    own = (F.col("status") == "success") & ~disowned(F.col("warnings"))
    failed = results.where("status <> 'success'").groupBy("strategy", "budget", "status").count().groupBy("strategy", "budget").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "count")))).alias("failures"))
    out = results.groupBy("strategy", "budget").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if((F.col("status") == "success") & disowned(F.col("warnings"))).alias("disowned"),
        _rate(F.count_if(own & F.col("passed")), F.count_if(own)).alias("retention"),
        F.round(F.avg(F.when(own, F.col("context_tokens"))), 6).alias("mean_context_tokens"),
    )
    return out.join(failed, ["strategy", "budget"], "left")


def pareto(summaries: DataFrame, cost: str, score: str) -> DataFrame:
    """Rows that no other row beats: none has at most their cost with a higher score, or less cost with as high a one. A running maximum in order of cost, not pairs."""
    by_cost = summaries.groupBy(cost).agg(F.max(score).alias("_best"))
    before = F.max("_best").over(Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))  # one row for each cost of a report
    best = by_cost.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_best") > F.col("_before")))
    return summaries.join(best.select(cost, F.col("_best").alias(score)), [cost, score])


def mode_completion(results: DataFrame) -> DataFrame:
    """strategy, mode, completed, evaluable of the failure modes that scenarios were built around."""
    each = results.where("status = 'success'").select("strategy", F.explode("failure_modes").alias("mode"), "completed")
    return each.groupBy("strategy", "mode").agg(F.count_if("completed").alias("completed"), F.count("completed").alias("evaluable"))


#: What a failed check of a category means, and where the scenario's mode says it more exactly.
CLASSES = {
    "constraint": "lost_constraint",
    "decision": "lost_decision",
    "rationale": "lost_rationale",
    "temporal_state": "temporal_confusion",
    "open_task": "lost_incomplete_work",
    "failed_approach": "lost_failed_approach",
    "entity": "entity_confusion",
    "hallucination": "hallucination",
}
REFINED = {
    ("constraint", "negative_constraint"): "lost_negative_constraint",
    ("critical_fact", "exact_value"): "exact_value_loss",
    ("critical_fact", "current_state"): "lost_current_state",
    ("critical_fact", "similar_entities"): "entity_confusion",
    ("critical_fact", "temporal_state"): "temporal_confusion",
    ("decision", "reversed_decision"): "lost_decision",
}


def check_class(category: Column, modes: Column) -> Column:
    """The class of a failed check: by its category and the first (in order of name) of the scenario's modes that refines it, else by the category alone."""
    refined = F.filter(F.transform(F.array_sort(F.coalesce(modes, F.array().cast("array<string>"))), lambda m: F.try_element_at(F.create_map(*[F.lit(x) for (c, k), v in REFINED.items() for x in (f"{c}/{k}", v)]), F.concat(category, F.lit("/"), m))), lambda x: x.isNotNull())
    plain = F.try_element_at(F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair]), category)
    return F.coalesce(F.get(refined, F.lit(0)), plain, F.lit("unclassified"))


def observations(results: DataFrame) -> DataFrame:
    """strategy, scenario_id, failure_class of every failure that successful results show: failed checks, fabrications, contexts over their target."""
    ok = results.where("status = 'success'")
    checks = ok.select("strategy", "scenario_id", "failure_modes", F.explode("retention_checks").alias("c")).where("not c.passed").select("strategy", "scenario_id", check_class(F.col("c.category"), F.col("failure_modes")).alias("failure_class"))
    made_up = ok.where(F.exists("completion", lambda c: c["status"] == "fabricated")).select("strategy", "scenario_id", F.lit("hallucination").alias("failure_class"))
    over = ok.where("context_tokens > target_tokens and target_tokens > 0").select("strategy", "scenario_id", F.lit("budget_overflow").alias("failure_class"))
    return checks.unionByName(made_up).unionByName(over)


def problems(results: DataFrame) -> DataFrame:
    """code, found: why results are no fair comparison; each code at most once."""
    n = results.agg(*[F.count_distinct(F.coalesce(c, F.lit(""))).alias(c) for c in ("model", "prompt", "dataset_version", "evaluation_mode")])
    each = F.explode(F.array(*[F.struct(F.lit(f"mixed_{c}").alias("code"), F.col(c).alias("found")) for c in n.columns])).alias("x")
    return n.select(each).select("x.code", "x.found").where("found > 1")


def coverage_problems(results: DataFrame, reference_budget: int = 0) -> DataFrame:
    """budget, strategy, scenarios, shared: arms whose scenarios are not those that all arms of the budget share; the reference's arms belong to every budget."""
    ok = results.where("status = 'success'").select("budget", "strategy", "scenario_id").distinct()
    reference = ok.where(F.col("budget") == reference_budget).drop("budget")
    compared = ok.where(F.col("budget") != reference_budget)
    budgets = compared.groupBy().agg(F.collect_set("budget").alias("budgets"))  # few: the budgets of a matrix
    own = compared.select("budget", "strategy").distinct()
    everywhere = reference.join(F.broadcast(budgets)).select("strategy", "scenario_id", F.explode("budgets").alias("budget")).join(own, ["budget", "strategy"], "left_anti")
    arms = compared.unionByName(everywhere)
    total = arms.groupBy("budget").agg(F.count_distinct("strategy").alias("arms"))
    common = arms.groupBy("budget", "scenario_id").agg(F.count_distinct("strategy").alias("n")).join(total, "budget").where("n = arms").groupBy("budget").agg(F.count(F.lit(1)).alias("shared"))
    sizes = arms.groupBy("budget", "strategy").agg(F.count_distinct("scenario_id").alias("scenarios"))
    return sizes.join(total, "budget").join(common, "budget", "left").select("budget", "strategy", "scenarios", F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared"), "arms").where("arms > 1 and scenarios <> shared").drop("arms")


def total_tokens(*parts: Column) -> Column:
    """The sum of the parts that are not null; null if all are."""
    known = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")))


def requests(matrix: DataFrame, per_run: dict[str, int], judged: DataFrame) -> DataFrame:
    """requests that a matrix needs: those of each strategy's run and one for each of a scenario's judged questions."""
    own = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in per_run.items() for x in pair]), F.col("strategy")), F.lit(1))
    return matrix.join(judged, "scenario_id", "left").agg(F.sum(own + F.coalesce("questions", F.lit(0))).alias("requests"))


def mirrors(runs: DataFrame, names: list[str]) -> DataFrame:
    """run_id, field of run metadata whose fingerprint map does not repeat its field."""
    each = F.explode(F.filter(F.array(*[F.when(~F.col(n).cast("string").eqNullSafe(F.try_element_at("fingerprint", F.lit(n))), F.lit(n)) for n in names]), lambda x: x.isNotNull()))
    return runs.select("run_id", each.alias("field"))


def noise(spark: SparkSession, topics: list[str], packages: list[str], notes: list[str], turns: int) -> DataFrame:
    """seq, role, content: filler turns by index arithmetic, alike on every run."""
    at = lambda values, step: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("id") / step) % len(values) + 1).cast("int"))
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("What about "), at(topics, 2), F.lit("?"))).otherwise(F.concat(at(packages, 1), F.lit(": "), at(notes, 3)))
    return spark.range(turns).select(F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), text.alias("content"))


def absence_to_questions(checks: DataFrame) -> DataFrame:
    """checks(scenario_id, check_id, category, required, required_any, forbidden): their positive halves, and the forbidden words as judged questions.

    kind is check or question; a check that only forbids becomes a question alone.
    """
    positive = checks.where((F.coalesce(F.size("required"), F.lit(0)) > 0) | (F.coalesce(F.size("required_any"), F.lit(0)) > 0)).select("scenario_id", "check_id", "category", F.lit("check").alias("kind"), "required", "required_any", F.lit(None).cast("string").alias("question"))
    asked = checks.where(F.coalesce(F.size("forbidden"), F.lit(0)) > 0).select("scenario_id", "check_id", "category", F.lit("question").alias("kind"), F.lit(None).cast("array<string>").alias("required"), F.lit(None).cast("array<string>").alias("required_any"), F.concat(F.lit("Does the response avoid proposing "), F.array_join("forbidden", ", "), F.lit("?")).alias("question"))
    return positive.unionByName(asked)


def run_cells(cells: DataFrame, run: Callable[[dict], str], schema_of_context: str = "context") -> DataFrame:
    """cells with response and status: a cell whose run fails has the error's status and no response, and no later step scores it."""
    from quillstone.plugins import ModelError

    def each(frames):
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                try:
                    if not row.get(schema_of_context):
                        out.append((None, "context_error"))
                        continue
                    out.append((run(row), "success"))
                except ModelError:
                    out.append((None, "model_error"))
            yield f.assign(response=[o[0] for o in out], status=[o[1] for o in out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    return cells.mapInPandas(each, f"{fields}, response string, status string")
