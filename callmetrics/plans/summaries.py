"""Queries that match gold arguments, compare runs and conditions, select among variants and audit results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.functions import stats, text
from callmetrics.operators import aggregates as agg
from callmetrics.operators import calls
from callmetrics.plans import records as rec
from callmetrics.plans.records import ANCHOR, COMPONENTS, H, M, PAIRS, R, RESIDUAL, wilson_sql
from callmetrics.plans.tools import CANON, FEAT, NAME, featured
from callmetrics.plans.views import TASKS, TOOLS, predictions, read, tasks, tools


def gold(spark, d) -> DataFrame:
    """Gold arguments of each task with a tool, as canonical members, with the defaults of the tool's arguments."""
    t = tools(spark, d, "arguments").select("tool_id", F.transform(F.filter("arguments", lambda a: a["default_value"].isNotNull() & a["name"].isNotNull()), lambda a: calls.member(a["name"], F.try_parse_json(a["default_value"]))).alias("defaults"))
    e = tasks(spark, d, "tool_id", "expected_arguments").where("expected_arguments IS NOT NULL AND tool_id IS NOT NULL").select("task_id", "tool_id", calls.members(F.col("expected_arguments")).alias("members"))
    return e.where("members IS NOT NULL").join(t, "tool_id")


def c3_argument_match(spark, d):
    """Whether each task's gold arguments match those of its tool's first task; a member that only repeats the tool's default may be left out."""
    g = gold(spark, d)
    first = g.groupBy("tool_id").agg(F.min("task_id").alias("first"), F.min_by("members", "task_id").alias("expected"))
    out = calls.matches(F.col("members"), F.col("expected"), F.coalesce("defaults", F.array().cast("array<struct<key:string,value:string>>")))
    return g.join(first, "tool_id").where("task_id <> first").select("task_id", out.alias("exact"))


def c4_best_match(spark, d):
    """Whether each task's gold arguments equal those of any other task of its tool: groups of equal arguments, no pairs."""
    g = gold(spark, d).select("task_id", "tool_id", F.to_json("members").alias("c"))
    n = g.groupBy("tool_id", "c").agg(F.count(F.lit(1)).alias("n"))
    return g.join(n, ["tool_id", "c"]).select("task_id", (F.col("n") > 1).alias("any_match"))


def d16_run_deltas(spark, d):
    """Differences between runs (models) of a listed pair, by condition."""
    m = agg.main_metrics(predictions(spark, d), "baseline_name", "model_slug").select("baseline_name", "model_slug", "joint_exact_match", "tool_selection_accuracy", "avg_latency_ms")
    p = spark.createDataFrame(RUN_PAIRS, "run_a string, run_b string")
    side = lambda x: m.select("baseline_name", F.col("model_slug").alias(f"run_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in m.columns[2:]])
    j = F.broadcast(p).join(side("a"), "run_a").join(side("b"), ["run_b", "baseline_name"])  # a list of pairs in the program
    return j.select("run_a", "run_b", "baseline_name", *[F.round(F.col(f"{c}_b") - F.col(f"{c}_a"), 4).alias(f"delta_{c}") for c in m.columns[2:]])


RUN_PAIRS = [("model-s", "model-m"), ("model-m", "model-l"), ("model-s", "model-l")]
#: Comparisons to be reported: name, condition, other condition.
TEMPLATES = [("skill_vs_plain", "skill_v1", "plain_schema"), ("skill_vs_strict", "skill_v1", "schema_strict"), ("docs_vs_skill", "docs_long", "skill_v1"), ("gated_vs_skill", "skill_gated", "skill_v1"), ("skill_vs_absent", "skill_v1", "not_run")]


def d17_comparisons(spark, d):
    """Each listed comparison with both sides' rates and the paired test, whichever way round it was made; missing sides are reported."""
    m = agg.main_metrics(predictions(spark, d), "baseline_name").select("baseline_name", "joint_exact_match")
    t = spark.createDataFrame(TEMPLATES, "comparison string, a string, b string")
    p = rec.i4_mcnemar(spark, d).select(F.least("left_name", "right_name").alias("low"), F.greatest("left_name", "right_name").alias("high"), "p_value")
    side = lambda x: m.select(F.col("baseline_name").alias(x), F.col("joint_exact_match").alias(f"rate_{x}"))
    j = t.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")}).join(side("a"), "a", "left").join(side("b"), "b", "left").join(p, ["low", "high"], "left")
    status = F.when(F.col("rate_a").isNull() | F.col("rate_b").isNull(), "missing").when(F.col("p_value") <= 0.05, "significant").otherwise("not_significant")
    return j.select("comparison", "rate_a", "rate_b", F.round(F.col("rate_a") - F.col("rate_b"), 4).alias("delta"), "p_value", status.alias("status"))


def d18_gold_fallback(spark, d):
    """Success against the task's expected tool, or where there is none the record's own, by model."""
    e = tasks(spark, d, "expected_tool_name").withColumn("known", F.lit(True))
    j = predictions(spark, d).select("task_id", "model_slug", "selected_tool_name", F.col("expected_tool_name").alias("own")).join(e, "task_id", "left")
    right = F.coalesce(F.col("selected_tool_name") == F.coalesce("expected_tool_name", "own"), F.lit(False))
    return j.groupBy("model_slug").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("with_task"), stats.mean(right).alias("success"))


def e6_reliability_summary(spark, d):
    r = rec.i8_reliability(spark, d)
    is_ = lambda x: F.count_if(F.col("decision") == x)
    return r.groupBy("baseline_name").agg(F.count(F.lit(1)).alias("tools"), stats.mean(F.col("score")).alias("avg_score"), is_("deploy").alias("deploy"), is_("repair").alias("repair"), is_("reject").alias("reject"), stats.mean(F.col("decision") == "deploy").alias("deploy_rate"))


def e17_pairwise(spark, d):
    """Wins of each condition's validity against the anchor among the tasks that decide, with Wilson's bounds."""
    p = rec.d3_anchor_deltas(spark, d)
    n = F.col("wins") + F.col("losses")
    low, high = stats.wilson(F.col("wins"), n)
    return p.select("baseline_name", "wins", "ties", "losses", "avg_delta", stats.ratio(F.col("wins"), n, 0.0).alias("win_rate"), low.alias("low"), high.alias("high"))


def e20_compactness(spark, d):
    return predictions(spark, d).groupBy("baseline_name").agg(F.count(F.lit(1)).alias("n"), stats.mean(F.col("prompt_tokens")).alias("mean_tokens"), F.min("prompt_tokens").alias("least"), F.max("prompt_tokens").alias("most"), F.count_if(F.col("prompt_tokens") > 600).alias("over_600"))


def e22_ablation(spark, d):
    """A row for each condition: rates, the score 4 joint + validity - 6 harm, and the score lost against the anchor."""
    p = predictions(spark, d)
    mean = lambda c: F.avg(c.cast("double"))
    g = p.groupBy("baseline_name").agg(
        F.count(F.lit(1)).alias("n"), mean(F.col("joint_exact_match")).alias("j"), mean(F.col("argument_validity")).alias("v"), F.count_if("joint_exact_match").alias("k"), F.count_if(F.col("should_trigger") & F.col("triggered")).alias("tp"), F.count_if("triggered").alias("t"),
        F.count_if("harmful_injection").alias("h"), F.count_if(~F.col("should_trigger")).alias("neg"),
    )
    low, high = stats.wilson(F.col("k"), F.col("n"))
    hsir = stats.ratio(F.col("h"), F.col("neg"), 0.0)
    g = g.select("baseline_name", "n", F.round(F.col("j") + stats.TIE, 4).alias("joint"), F.round(F.col("v") + stats.TIE, 4).alias("validity"), stats.ratio(F.col("tp"), F.col("t"), 1.0).alias("precision"), hsir.alias("harm_rate"), low.alias("low"), high.alias("high"))
    g = g.withColumn("score", F.round(4 * F.col("joint") + F.col("validity") - 6 * F.col("harm_rate"), 4))
    return g.withColumn("lost", F.round(F.max(F.when(F.col("baseline_name") == ANCHOR, F.col("score"))).over(Window.partitionBy(F.lit(1))) - F.col("score"), 4))  # a row a condition


def e26_live_summary(spark, d):
    p = predictions(spark, d).where("should_trigger")
    return p.groupBy("model_slug").agg(F.count(F.lit(1)).alias("attempts"), F.countDistinct("task_id").alias("tasks"), stats.mean(F.col("joint_exact_match")).alias("success_rate"), stats.mean(F.col("triggered")).alias("call_rate"))


def e27_usage(spark, d):
    """Records by model: how many fell back to the default condition, and the counts of conditions in one text."""
    p = predictions(spark, d).groupBy("model_slug", "baseline_name").agg(F.count(F.lit(1)).alias("n"))
    shown = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "baseline_name", "n"))), "; ")
    return p.groupBy("model_slug").agg(F.sum("n").alias("records"), F.round(F.sum(F.when(F.col("baseline_name") == "default", F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("fallback_rate"), shown.alias("conditions"))


def e28_progress(spark, d):
    """Tasks of the plan done by each model and condition, never more than planned."""
    plan = read(spark, d, "routing_examples").select(F.col("source_control_id").alias("task_id")).distinct()
    total = plan.agg(F.count(F.lit(1)).alias("n")).scalar()
    done = predictions(spark, d).select("model_slug", "baseline_name", "task_id").distinct().join(plan, "task_id", "left_semi").groupBy("model_slug", "baseline_name").agg(F.count(F.lit(1)).alias("done"))
    return done.withColumn("total", total).select("model_slug", "baseline_name", F.least("done", "total").alias("completed"), "total", F.round(100 * F.least("done", "total") / F.col("total"), 2).alias("percent"))


def e31_sweep(spark, d):
    """Each model and condition with its distance from the model's best condition."""
    m = agg.main_metrics(predictions(spark, d), "model_slug", "baseline_name").select("model_slug", "baseline_name", "joint_exact_match")
    return m.withColumn("from_best", F.round(F.col("joint_exact_match") - F.max("joint_exact_match").over(Window.partitionBy("model_slug")), 4))


def f2_dedupe(spark, d):
    """The first tool of each server and name."""
    return tools(spark, d, "server_name", "tool_name").groupBy(F.coalesce("server_name", F.lit("")).alias("server_name"), F.coalesce("tool_name", F.lit("")).alias("tool_name")).agg(F.min("tool_id").alias("tool_id"), F.count(F.lit(1)).alias("copies"))


#: What a balanced set of tools needs: check, column of the counts, least value.
BALANCE = (("sources", "sources", 3), ("domains", "domains", 10), ("side_effects", "acting", 20), ("hard", "hard", 20), ("documented", "documented", 50), ("unreachable", "hard", 10**9))


def f5_balance(spark, d):
    """Checks of a set's balance: what it has, what it needs, and whether that holds."""
    g = featured(spark, d).agg(F.countDistinct("source_type").alias("sources"), F.countDistinct("resolved_domain").alias("domains"), F.count_if(F.col("side_effect_type").isin("write", "delete", "execute", "external_communication")).alias("acting"), F.count_if(F.col("difficulty") == "hard").alias("hard"), F.count_if(F.col("completeness") >= 0.5).alias("documented"))
    rows = F.array(*[F.struct(F.lit(c).alias("check_id"), F.col(k).alias("actual"), F.lit(n).alias("required"), (F.col(k) >= n).alias("ok")) for c, k, n in BALANCE])
    return g.select(F.explode(rows).alias("r")).select("r.*")


def policies() -> dict[str, Column]:
    c = F.col
    return {
        "best_validation_only": F.struct(c("v"), c("c"), c("s"), -c("tokens"), c("baseline_name")), "best_behavior_dev": F.struct(c("n"), c("p"), c("v"), c("c"), c("baseline_name")),
        "best_reliability_score": F.struct(c("score"), c("v"), c("n"), c("baseline_name")), "oracle_upper_bound_dev": F.struct(c("p") + c("n"), c("v"), c("c"), c("baseline_name")),
    }


def f13_policy_choice(spark, d):
    """The condition each selection policy takes for each tool: the largest tuple of components."""
    r = rec.components(spark, d).withColumn("score", rec.score())
    r = r.select("baseline_name", "tool_name", *[F.round(k, 6).alias(k) for k in "vpnacs"], "score", F.round(1200 * (1 - F.col("s")), 6).alias("tokens"))
    g = r.groupBy("tool_name").agg(*[F.max_by("baseline_name", k).alias(p) for p, k in policies().items()])
    return g.unpivot(["tool_name"], list(policies()), "policy", "chosen")


def f15_variant_ranking(spark, d):
    """Conditions by utility, harm, negatives left alone and length, each with why it isn't the first."""
    p = predictions(spark, d)
    m = p.groupBy("baseline_name").agg(F.round(F.avg(F.col("joint_exact_match").cast("double")), 6).alias("joint"), F.round(F.avg(F.when(~F.col("should_trigger"), F.col("triggered").cast("double"))), 6).alias("harm"), F.round(F.avg("prompt_tokens"), 6).alias("length"))
    m = m.withColumns({"harm": F.coalesce("harm", F.lit(0.0)), "length": F.coalesce("length", F.lit(0.0))}).withColumn("score", F.round(4 * F.col("joint") - 6 * F.col("harm"), 6))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "harm", "length", "baseline_name")  # a row a condition
    m = m.withColumns({"rank": F.row_number().over(w), "best": F.first("score").over(w), "shortest": F.first("length").over(w)})
    why = F.when(F.col("rank") == 1, "selected").when(F.col("best") - F.col("score") > 0.0001, "lower utility").when(F.col("length") > F.col("shortest"), "longer").otherwise("tie")
    return m.select("baseline_name", "score", "harm", "rank", why.alias("reason"))


def f24_first_lines(spark, d):
    """The first two snippets, warnings and argument names of each tool."""
    t = tools(spark, d, "doc_snippets", "usage_warnings", "arguments")
    head = lambda c: F.coalesce(F.array_join(F.slice(c, 1, 2), "|"), F.lit(""))
    return t.select("tool_id", F.md5(head(F.col("doc_snippets"))).alias("snippets"), head(F.col("usage_warnings")).alias("warnings"), head(F.col("arguments.name")).alias("arguments"))


def f25_cases(spark, d):
    """Of each condition and kind of failure the record nearest to being right: validity, recall, then the smallest id."""
    df = predictions(spark, d).where("NOT joint_exact_match").withColumn("category", rec.residual())
    key = F.struct(F.coalesce("argument_validity", F.lit(0.0)), F.coalesce("required_argument_recall", F.lit(0.0)), -F.col("record_id"))
    return df.groupBy("baseline_name", "category").agg(F.max_by("record_id", key).alias("record_id"))


def f28_richest(spark, d):
    """Of the tools of one normalised name the one with a purpose, then the richest: arguments, enumerations, snippets, length; then the smallest id."""
    t = featured(spark, d).where("normalized_name <> ''").withColumn("snippets", F.greatest(F.coalesce(F.size("doc_snippets"), F.lit(0)), F.lit(0)))
    rich = F.when(F.col("documentation_length") > 0, 100).otherwise(-100) + 3 * F.col("num_arguments") + 2 * F.col("num_enum") + 2 * F.col("snippets")
    g = t.groupBy("normalized_name").agg(F.min_by("tool_id", F.struct(-rich, -F.col("documentation_length"), F.col("tool_id"))).alias("tool_id"), F.max(rich).alias("richness"))
    return g.select("normalized_name", "tool_id", "richness")


def i9_critical(spark, d):
    """Critical failures of each condition and tool, and the decision they force: harm, recall under one half, invalid calls."""
    p = predictions(spark, d).groupBy("baseline_name", "tool_name").agg(F.count_if("harmful_injection").alias("harm"), F.count_if("should_trigger").alias("pos"), F.count_if(F.col("should_trigger") & F.col("triggered")).alias("tp"), F.count_if(~F.col("argument_schema_valid")).alias("invalid"))
    s = rec.components(spark, d).withColumn("score", rec.score()).select("baseline_name", "tool_name", "score")
    failures = F.array_join(F.array_compact(F.array(F.when(F.col("invalid") > 0, "structural_validation_error"), F.when(F.col("harm") > 0, "harmful_skill_injection"), F.when((F.col("pos") > 0) & (F.col("tp") < 0.5 * F.col("pos")), "positive_trigger_recall_below_0.5"))), ",")
    decision = F.when(F.col("failures") != "", "reject").when(F.col("score") >= 85, "deploy").when(F.col("score") >= 60, "repair").otherwise("reject")
    return p.withColumn("failures", failures).join(s, ["baseline_name", "tool_name"]).select("baseline_name", "tool_name", "failures", decision.alias("decision"))


def i10_coverage(spark, d):
    """Of each tool with arguments: the shares of its arguments, required ones and enumerated ones that gold arguments use."""
    a = tools(spark, d, "arguments").select("tool_id", F.explode("arguments").alias("a")).where("a.name IS NOT NULL").groupBy("tool_id", F.col("a.name").alias("name")).agg(F.bool_or("a.required").alias("required"), F.first("a.enum", ignorenulls=True).alias("enum"))
    e = tasks(spark, d, "tool_id", "expected_arguments").where("tool_id IS NOT NULL").select("tool_id", F.explode(F.from_json("expected_arguments", "map<string,string>")).alias("name", "value"))
    used = e.groupBy("tool_id", "name", "value").agg(F.lit(True).alias("used"))
    j = a.join(used, ["tool_id", "name"], "left").groupBy("tool_id", "name").agg(F.bool_or("required").alias("required"), F.bool_or(F.col("enum").isNotNull()).alias("listed"), F.bool_or(F.coalesce("used", F.lit(False))).alias("used"), F.bool_or(F.coalesce(F.array_contains("enum", F.col("value")), F.lit(False))).alias("in_list"))
    share = lambda hit, of: stats.ratio(F.count_if(hit & of), F.count_if(of), 1.0)
    req = F.coalesce("required", F.lit(False))
    return j.groupBy("tool_id").agg(share(F.col("used"), F.lit(True)).alias("arguments"), share(F.col("used"), req).alias("required"), share(F.col("in_list"), F.col("listed")).alias("enums"))


def i21_dominance(spark, d):
    """Of each condition against the anchor: whether the anchor is at least as good with every model, and whether the paired test is significant."""
    m = agg.main_metrics(predictions(spark, d), "model_slug", "baseline_name").select("model_slug", "baseline_name", "joint_exact_match")
    a = m.where(F.col("baseline_name") == ANCHOR).select("model_slug", F.col("joint_exact_match").alias("anchor"))
    g = m.where(F.col("baseline_name") != ANCHOR).join(a, "model_slug").groupBy("baseline_name").agg(F.count(F.lit(1)).alias("models"), F.bool_and(F.col("anchor") >= F.col("joint_exact_match")).alias("dominated"), F.min(F.round(F.col("anchor") - F.col("joint_exact_match"), 4)).alias("least_margin"))
    p = rec.i19_claims(spark, d).select(F.col("other").alias("baseline_name"), (F.col("p_value") <= 0.05).alias("significant"))
    return g.join(p, "baseline_name", "left")


def invariants() -> dict[str, Column]:
    """Conditions that no record may meet."""
    c, off = F.col, F.coalesce(F.size("hallucinated_args"), F.lit(0))
    return {
        "exact_without_validity": F.coalesce(c("exact_match") & (c("argument_validity") < 1), F.lit(False)), "exact_with_hallucination": F.coalesce(c("exact_match") & (off > 0), F.lit(False)),
        "abstained_with_tool": F.coalesce(~c("triggered") & (c("selected_tool_name") != "__abstain__"), F.lit(False)), "recall_out_of_range": F.coalesce(~c("required_argument_recall").between(0, 1), F.lit(False)), "negative_time": F.coalesce(c("latency_ms") < 0, F.lit(False)),
    }


def i22_invariants(spark, d):
    """Records that break each rule, in one pass."""
    p = read(spark, d, "predictions").dropDuplicates(["record_id"])
    g = p.agg(*[F.count_if(x).alias(k) for k, x in invariants().items()])
    return g.unpivot([], list(invariants()), "rule", "violations")


#: Conditions every model must have results of, and how many.
REQUIRED = ("skill_v1", "plain_schema", "schema_strict", "docs_long", "not_run")
LEAST_RECORDS = 50


def n26_audit(spark, d):
    """Of each model and required condition: whether its records are there, and enough of them."""
    n = predictions(spark, d).groupBy("model_slug", "baseline_name").agg(F.count(F.lit(1)).alias("n"))
    want = n.select("model_slug").distinct().select("model_slug", F.explode(F.array(*map(F.lit, REQUIRED))).alias("baseline_name"))
    n = want.join(n, ["model_slug", "baseline_name"], "left").withColumn("evidence", F.coalesce("n", F.lit(0)))
    return n.select("model_slug", "baseline_name", "evidence", F.when(F.col("evidence") == 0, "missing_condition").when(F.col("evidence") < LEAST_RECORDS, "small_sample").otherwise("ok").alias("status"))


def n28_existence(spark, d):
    """Of each condition: whether any record is harmful, has unknown arguments, or lacks a time."""
    return predictions(spark, d).groupBy("baseline_name").agg(F.bool_or("harmful_injection").alias("any_harm"), F.bool_or(F.coalesce(F.size("hallucinated_args") > 0, F.lit(False))).alias("any_unknown_argument"), F.bool_or(F.col("latency_ms").isNull()).alias("any_without_time"))


def g1_streams(spark, d):
    """Predictions, routing examples and tasks as one stream of records, missing columns null, counted by kind and split."""
    p = read(spark, d, "predictions").select(F.lit("benchmark").alias("record_type"), "task_id", "model_slug")
    r = read(spark, d, "routing_examples").select(F.lit("routing").alias("record_type"), F.col("source_control_id").alias("task_id"), F.trim(F.lower("split")).alias("split"))
    e = read(spark, d, "eval_tasks").select(F.lit("behavior").alias("record_type"), "task_id", F.trim(F.lower("split")).alias("split"))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p, r, e])
    return both.groupBy("record_type", "split").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("task_id").alias("tasks"), F.countDistinct("model_slug").alias("models"))


def b32_annotated(spark, d):
    """Records with their shard of eight, by model."""
    shard = F.conv(F.substring(F.md5("task_id"), 1, 8), 16, 10).cast("long") % 8
    return predictions(spark, d).groupBy("model_slug", shard.alias("shard")).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("task_id").alias("tasks"))


def b35_case_types(spark, d):
    """Records by kind of case: first the safe abstentions and accepted calls, then the failures."""
    kind = F.when(~F.col("should_trigger") & ~F.col("triggered"), "safe_abstention").when(F.col("joint_exact_match"), "accepted_call").when(F.col("tool_selection_correct") & (F.coalesce("argument_validity", F.lit(0.0)) > 0), "repairable_call").when(F.col("harmful_injection"), "harmful_call")
    return predictions(spark, d).groupBy("baseline_name", F.coalesce(kind, F.lit("none")).alias("case_type")).agg(F.count(F.lit(1)).alias("records"))


def b28_buckets(spark, d):
    """Tools by bucket of required arguments and tier of complexity."""
    n = F.col("num_required")
    bucket = F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 5, "3-5").otherwise("6+")
    tier = F.when(F.col("has_object") | (F.col("num_arguments") > 6), "complex").when(F.col("has_array") | (F.col("num_arguments") > 3), "moderate").otherwise("simple")
    return featured(spark, d).groupBy(bucket.alias("required_bucket"), tier.alias("tier")).agg(F.count(F.lit(1)).alias("tools"))


QUERIES = {k: f for k, f in globals().items() if callable(f) and k[0] in "bcdefgin" and k[1:2].isdigit()}

MEMBERS = lambda a: f"list_sort(list_transform(json_keys({a}), lambda k: {{'key': k, 'value': {VALUE('k', a)}}}))"
PATH = lambda p: rf"CASE WHEN contains({p}, '://') THEN regexp_replace({p}, '/+$', '') ELSE CASE regexp_replace(regexp_replace(regexp_replace({p}, '/(\./)+', '/', 'g'), '/\.$', ''), '/{{2,}}', '/', 'g') WHEN '' THEN '.' WHEN '/' THEN '/' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace({p}, '/(\./)+', '/', 'g'), '/\.$', ''), '/{{2,}}', '/', 'g'), '/$', '') END END"
START = lambda s: rf"regexp_replace(trim(replace({s}, '\', '/')), '^(\./)+', '')"
CANONED = lambda k, j, s: rf"CASE WHEN json_type({j}) = 'VARCHAR' THEN to_json(CASE WHEN regexp_matches(lower({k}), 'path|file|dir|folder') OR contains({s}, '\') OR starts_with({s}, './') OR starts_with({s}, '../') THEN {PATH(START(s))} ELSE trim(regexp_replace({s}, '\s+', ' ', 'g')) END)::VARCHAR WHEN json_type({j}) = 'DOUBLE' AND {s}::DOUBLE = floor({s}::DOUBLE) THEN {s}::DOUBLE::BIGINT::VARCHAR ELSE {j}::VARCHAR END"
VALUE = lambda k, a: CANONED(k, f"json_extract({a}, '$.\"' || {k} || '\"')", f"json_extract_string({a}, '$.\"' || {k} || '\"')")
GOLD = f"""WITH {TASKS}, {TOOLS}, de AS (SELECT tool_id, coalesce(list_transform(list_filter(arguments, lambda a: a.default_value IS NOT NULL AND json_valid(a.default_value)), lambda a: {{'key': a.name, 'value': {CANONED('a.name', 'json(a.default_value)', "json_extract_string(a.default_value, '$')")}}}), []) AS defaults FROM tl),
g AS (SELECT task_id, ev.tool_id, {MEMBERS('expected_arguments')} AS m, defaults FROM ev JOIN de ON de.tool_id = ev.tool_id WHERE expected_arguments IS NOT NULL)"""
T = "(SELECT count(DISTINCT source_control_id) FROM routing_examples)"
PICK = lambda order: f"arg_max(baseline_name, {order})"
SQL = {
    "c3_argument_match": f"{GOLD}, f AS (SELECT tool_id, min(task_id) AS first, arg_min(m, task_id) AS x FROM g GROUP BY 1) SELECT task_id, list_filter(m, lambda e: NOT (list_contains(defaults, e) AND NOT list_contains(list_transform(x, lambda y: y.key), e.key))) = x AS exact FROM g JOIN f USING (tool_id) WHERE task_id <> first",
    "c4_best_match": f"{GOLD} SELECT task_id, count(*) OVER (PARTITION BY tool_id, m) > 1 AS any_match FROM g",
    "d16_run_deltas": f"""{H}, m AS (SELECT baseline_name, model_slug, {M('joint_exact_match')} AS j, {M('tool_selection_correct')} AS t, {M('latency_ms')} AS l FROM pr GROUP BY 1, 2)
      SELECT a.model_slug AS run_a, b.model_slug AS run_b, baseline_name, round(b.j - a.j, 4) AS delta_joint_exact_match, round(b.t - a.t, 4) AS delta_tool_selection_accuracy, round(b.l - a.l, 4) AS delta_avg_latency_ms FROM m a JOIN m b USING (baseline_name) WHERE (a.model_slug, b.model_slug) IN ({', '.join(map(str, RUN_PAIRS))})""",
    "d17_comparisons": f"""WITH mc AS ({rec.SQL['i4_mcnemar']}), mm AS ({H} SELECT baseline_name, {M('joint_exact_match')} AS j FROM pr GROUP BY 1), te(comparison, a, b) AS (VALUES {', '.join(map(str, TEMPLATES))})
      SELECT comparison, x.j AS rate_a, y.j AS rate_b, round(x.j - y.j, 4) AS delta, p_value, CASE WHEN x.j IS NULL OR y.j IS NULL THEN 'missing' WHEN p_value <= 0.05 THEN 'significant' ELSE 'not_significant' END AS status
      FROM te LEFT JOIN mm x ON x.baseline_name = a LEFT JOIN mm y ON y.baseline_name = b LEFT JOIN mc ON (left_name = a AND right_name = b) OR (left_name = b AND right_name = a)""",
    "d18_gold_fallback": f"{H}, {TASKS} SELECT model_slug, count(*) AS n, count(ev.task_id) AS with_task, {M('coalesce(pr.selected_tool_name = coalesce(ev.expected_tool_name, pr.expected_tool_name), false)')} AS success FROM pr LEFT JOIN ev USING (task_id) GROUP BY 1",
    "e6_reliability_summary": f"{COMPONENTS} SELECT baseline_name, count(*) AS tools, {M('score')} AS avg_score, count_if(score >= 85) AS deploy, count_if(score >= 60 AND score < 85) AS repair, count_if(score < 60) AS reject, {M('score >= 85')} AS deploy_rate FROM sc GROUP BY 1",
    "e17_pairwise": f"WITH d AS ({rec.SQL['d3_anchor_deltas']}) SELECT baseline_name, wins, ties, losses, avg_delta, {R('wins', '(wins + losses)', '0')} AS win_rate, CASE WHEN wins + losses = 0 THEN 0 ELSE {wilson_sql('wins', '(wins + losses)')[0]} END AS low, CASE WHEN wins + losses = 0 THEN 0 ELSE {wilson_sql('wins', '(wins + losses)')[1]} END AS high FROM d",
    "e20_compactness": f"{H} SELECT baseline_name, count(*) AS n, {M('prompt_tokens')} AS mean_tokens, min(prompt_tokens) AS least, max(prompt_tokens) AS most, count_if(prompt_tokens > 600) AS over_600 FROM pr GROUP BY 1",
    "e22_ablation": f"""{H}, g AS (SELECT baseline_name, count(*) AS n, {M('joint_exact_match')} AS joint, {M('argument_validity')} AS validity, {R('count_if(should_trigger AND triggered)', 'count_if(triggered)', 1.0)} AS precision, {R('count_if(harmful_injection)', 'count_if(NOT should_trigger)', 0.0)} AS harm_rate,
      {wilson_sql('count_if(joint_exact_match)', 'count(*)')[0]} AS low, {wilson_sql('count_if(joint_exact_match)', 'count(*)')[1]} AS high FROM pr GROUP BY 1), s AS (SELECT *, round(4 * joint + validity - 6 * harm_rate, 4) AS score FROM g) SELECT *, round((SELECT score FROM s WHERE baseline_name = '{ANCHOR}') - score, 4) AS lost FROM s""",
    "e26_live_summary": f"{H} SELECT model_slug, count(*) AS attempts, count(DISTINCT task_id) AS tasks, {M('joint_exact_match')} AS success_rate, {M('triggered')} AS call_rate FROM pr WHERE should_trigger GROUP BY 1",
    "e27_usage": f"{H}, c AS (SELECT model_slug, baseline_name, count(*) AS n FROM pr GROUP BY 1, 2) SELECT model_slug, CAST(sum(n) AS BIGINT) AS records, round(coalesce(sum(n) FILTER (baseline_name = 'default'), 0) / sum(n), 4) AS fallback_rate, array_to_string(list_sort(list(baseline_name || '=' || n)), '; ') AS conditions FROM c GROUP BY 1",
    "e28_progress": f"{H}, c AS (SELECT model_slug, baseline_name, count(DISTINCT task_id) AS done FROM pr WHERE task_id IN (SELECT source_control_id FROM routing_examples) GROUP BY 1, 2) SELECT model_slug, baseline_name, least(done, {T}) AS completed, {T} AS total, round(100 * least(done, {T}) / {T}, 2) AS percent FROM c",
    "e31_sweep": f"{H}, m AS (SELECT model_slug, baseline_name, {M('joint_exact_match')} AS joint_exact_match FROM pr GROUP BY 1, 2) SELECT *, round(joint_exact_match - max(joint_exact_match) OVER (PARTITION BY model_slug), 4) AS from_best FROM m",
    "f2_dedupe": f"WITH {TOOLS} SELECT coalesce(server_name, '') AS server_name, coalesce(tool_name, '') AS tool_name, min(tool_id) AS tool_id, count(*) AS copies FROM tl GROUP BY 1, 2",
    "f5_balance": f"""{FEAT}, g AS (SELECT count(DISTINCT source_type) AS sources, count(DISTINCT resolved_domain) AS domains, count_if(side_effect_type IN ('write', 'delete', 'execute', 'external_communication')) AS acting, count_if(difficulty = 'hard') AS hard, count_if(completeness >= 0.5) AS documented FROM ft)
      {' UNION ALL '.join(f"SELECT '{c}' AS check_id, {k} AS actual, {n} AS required, {k} >= {n} AS ok FROM g" for c, k, n in BALANCE)}""",
    "f13_policy_choice": f"""{COMPONENTS}, r AS (SELECT baseline_name, tool_name, round(v, 6) AS v, round(p, 6) AS p, round(n, 6) AS n, round(c, 6) AS c, round(s, 6) AS s, round(1200 * (1 - s), 6) AS tokens, score FROM sc),
      g AS (SELECT tool_name, {PICK('(v, c, s, -tokens, baseline_name)')} AS best_validation_only, {PICK('(n, p, v, c, baseline_name)')} AS best_behavior_dev, {PICK('(score, v, n, baseline_name)')} AS best_reliability_score, {PICK('(p + n, v, c, baseline_name)')} AS oracle_upper_bound_dev FROM r GROUP BY 1)
      SELECT tool_name, policy, chosen FROM g UNPIVOT (chosen FOR policy IN (best_validation_only, best_behavior_dev, best_reliability_score, oracle_upper_bound_dev))""",
    "f15_variant_ranking": f"""{H}, m AS (SELECT baseline_name, round(avg(joint_exact_match::INT), 6) AS joint, coalesce(round(avg(triggered::INT) FILTER (NOT should_trigger), 6), 0) AS harm, coalesce(round(avg(prompt_tokens), 6), 0) AS length FROM pr GROUP BY 1), s AS (SELECT *, round(4 * joint - 6 * harm, 6) AS score FROM m),
      k AS (SELECT *, row_number() OVER w AS rank, first(score) OVER w AS best, first(length) OVER w AS shortest FROM s WINDOW w AS (ORDER BY score DESC, harm, length, baseline_name))
      SELECT baseline_name, score, harm, CAST(rank AS INT) AS rank, CASE WHEN rank = 1 THEN 'selected' WHEN best - score > 0.0001 THEN 'lower utility' WHEN length > shortest THEN 'longer' ELSE 'tie' END AS reason FROM k""",
    "f24_first_lines": f"WITH {TOOLS} SELECT tool_id, md5(coalesce(array_to_string(list_filter(doc_snippets[1:2], lambda x: x IS NOT NULL), '|'), '')) AS snippets, coalesce(array_to_string(usage_warnings[1:2], '|'), '') AS warnings, coalesce(array_to_string(list_transform(arguments[1:2], lambda a: a.name), '|'), '') AS arguments FROM tl",
    "f25_cases": f"{H} SELECT baseline_name, {RESIDUAL} AS category, arg_max(record_id, (coalesce(argument_validity, 0), coalesce(required_argument_recall, 0), -record_id)) AS record_id FROM pr WHERE NOT joint_exact_match GROUP BY 1, 2",
    "f28_richest": f"{FEAT}, r AS (SELECT *, CASE WHEN documentation_length > 0 THEN 100 ELSE -100 END + 3 * num_arguments + 2 * num_enum + 2 * coalesce(len(doc_snippets), 0) AS rich FROM ft WHERE normalized_name <> '') SELECT normalized_name, tool_id, rich AS richness FROM (SELECT *, row_number() OVER (PARTITION BY normalized_name ORDER BY rich DESC, documentation_length DESC, tool_id) AS k FROM r) WHERE k = 1",
    "i9_critical": f"""{COMPONENTS}, f AS (SELECT baseline_name, tool_name, concat_ws(',', CASE WHEN count_if(NOT argument_schema_valid) > 0 THEN 'structural_validation_error' END, CASE WHEN count_if(harmful_injection) > 0 THEN 'harmful_skill_injection' END,
      CASE WHEN count_if(should_trigger) > 0 AND count_if(should_trigger AND triggered) < 0.5 * count_if(should_trigger) THEN 'positive_trigger_recall_below_0.5' END) AS failures FROM pr GROUP BY 1, 2)
      SELECT baseline_name, tool_name, failures, CASE WHEN failures <> '' THEN 'reject' WHEN score >= 85 THEN 'deploy' WHEN score >= 60 THEN 'repair' ELSE 'reject' END AS decision FROM f JOIN sc USING (baseline_name, tool_name)""",
    "i10_coverage": f"""WITH {TASKS}, {TOOLS}, a0 AS (SELECT tool_id, unnest(arguments) AS a FROM tl), a1 AS (SELECT tool_id, a.name AS name, bool_or(a.required) AS required, any_value(a.enum) AS enum FROM a0 WHERE a.name IS NOT NULL GROUP BY 1, 2),
      u AS (SELECT DISTINCT tool_id, name, json_extract_string(x, '$."' || name || '"') AS value FROM (SELECT tool_id, expected_arguments AS x, unnest(json_keys(expected_arguments)) AS name FROM ev WHERE tool_id IS NOT NULL AND expected_arguments IS NOT NULL)),
      j AS (SELECT a1.tool_id, a1.name, coalesce(bool_or(required), false) AS required, bool_or(enum IS NOT NULL) AS listed, bool_or(u.tool_id IS NOT NULL) AS used, bool_or(coalesce(list_contains(enum, value), false)) AS hit FROM a1 LEFT JOIN u ON u.tool_id = a1.tool_id AND u.name = a1.name GROUP BY 1, 2)
      SELECT tool_id, {R('count_if(used)', 'count(*)', '1')} AS arguments, {R('count_if(used AND required)', 'count_if(required)', '1')} AS required, {R('count_if(hit AND listed)', 'count_if(listed)', '1')} AS enums FROM j GROUP BY 1""",
    "i21_dominance": f"""WITH cl AS ({rec.SQL['i19_claims']}), mm AS ({H} SELECT model_slug, baseline_name, {M('joint_exact_match')} AS j FROM pr GROUP BY 1, 2),
      g AS (SELECT b.baseline_name, count(*) AS models, bool_and(a.j >= b.j) AS dominated, min(round(a.j - b.j, 4)) AS least_margin FROM mm a JOIN mm b USING (model_slug) WHERE a.baseline_name = '{ANCHOR}' AND b.baseline_name <> '{ANCHOR}' GROUP BY 1) SELECT g.*, p_value <= 0.05 AS significant FROM g LEFT JOIN cl ON other = g.baseline_name""",
    "i22_invariants": """WITH p AS (SELECT DISTINCT ON (record_id) * FROM predictions ORDER BY record_id) SELECT 'exact_without_validity' AS rule, count_if(exact_match AND argument_validity < 1) AS violations FROM p UNION ALL SELECT 'exact_with_hallucination', count_if(exact_match AND len(hallucinated_args) > 0) FROM p
      UNION ALL SELECT 'abstained_with_tool', count_if(NOT triggered AND selected_tool_name <> '__abstain__') FROM p UNION ALL SELECT 'recall_out_of_range', count_if(required_argument_recall < 0 OR required_argument_recall > 1) FROM p UNION ALL SELECT 'negative_time', count_if(latency_ms < 0) FROM p""",
    "n26_audit": f"{H}, c AS (SELECT model_slug, baseline_name, count(*) AS n FROM pr GROUP BY 1, 2), w AS (SELECT DISTINCT model_slug, x.b AS baseline_name FROM c, (SELECT unnest({list(REQUIRED)}) AS b) x) SELECT model_slug, baseline_name, coalesce(n, 0) AS evidence, CASE WHEN coalesce(n, 0) = 0 THEN 'missing_condition' WHEN n < {LEAST_RECORDS} THEN 'small_sample' ELSE 'ok' END AS status FROM w LEFT JOIN c USING (model_slug, baseline_name)",
    "n28_existence": f"{H} SELECT baseline_name, bool_or(harmful_injection) AS any_harm, bool_or(coalesce(len(hallucinated_args) > 0, false)) AS any_unknown_argument, bool_or(latency_ms IS NULL) AS any_without_time FROM pr GROUP BY 1",
    "g1_streams": "SELECT record_type, split, count(*) AS records, count(DISTINCT task_id) AS tasks, count(DISTINCT model_slug) AS models FROM (SELECT 'benchmark' AS record_type, task_id, NULL AS split, model_slug FROM predictions UNION ALL SELECT 'routing', source_control_id, trim(lower(split)), NULL FROM routing_examples UNION ALL SELECT 'behavior', task_id, trim(lower(split)), NULL FROM eval_tasks) GROUP BY 1, 2",
    "b32_annotated": f"{H} SELECT model_slug, ('0x' || md5(task_id)[1:8])::BIGINT % 8 AS shard, count(*) AS records, count(DISTINCT task_id) AS tasks FROM pr GROUP BY 1, 2",
    "b35_case_types": f"{H} SELECT baseline_name, CASE WHEN NOT should_trigger AND NOT triggered THEN 'safe_abstention' WHEN joint_exact_match THEN 'accepted_call' WHEN tool_selection_correct AND coalesce(argument_validity, 0) > 0 THEN 'repairable_call' WHEN harmful_injection THEN 'harmful_call' ELSE 'none' END AS case_type, count(*) AS records FROM pr GROUP BY 1, 2",
    "b28_buckets": f"{FEAT} SELECT CASE WHEN num_required = 0 THEN '0' WHEN num_required <= 2 THEN '1-2' WHEN num_required <= 5 THEN '3-5' ELSE '6+' END AS required_bucket, CASE WHEN has_object OR num_arguments > 6 THEN 'complex' WHEN has_array OR num_arguments > 3 THEN 'moderate' ELSE 'simple' END AS tier, count(*) AS tools FROM ft GROUP BY 1, 2",
}
