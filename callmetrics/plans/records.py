"""Queries over prediction records: metrics, pairing, significance, slices, reliability."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.functions import stats
from callmetrics.operators import aggregates as agg
from callmetrics.plans.views import PREDICTIONS, TASKS, TOOLS, predictions, tasks, tools

ORDER = ["created_at", "ingested_at", "record_id"]
ANCHOR = "skill_v1"
#: Iterations of resampling, as many as the reference's default.
ITERATIONS = 500


def b25_normalized(spark, d):
    keep = ["record_id", "task_id", "baseline_name", "should_trigger", "triggered", "expected_tool_name", "selected_tool_name", "argument_schema_valid", "argument_exact_match", "tool_selection_correct", "joint_exact_match", "harmful_injection"]
    return predictions(spark, d).select(*keep)


def e1_main_metrics(spark, d):
    return agg.main_metrics(predictions(spark, d), "baseline_name")


def e1_by_model(spark, d):
    return agg.main_metrics(predictions(spark, d), "baseline_name", "model_slug")


def e2_task_summary(spark, d):
    """Three grains in one pass by grouping sets."""
    df = predictions(spark, d).join(tasks(spark, d, "split").withColumn("split", F.trim(F.lower("split"))), "task_id", "left")
    df = df.withColumns({"split": F.coalesce("split", F.lit("unknown")), "hallucinated": F.greatest(F.coalesce(F.size("hallucinated_args"), F.lit(0)), F.lit(0))})
    sets = [["baseline_name"], ["baseline_name", "tool_name"], ["baseline_name", "split"]]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], "baseline_name", "tool_name", "split").agg(
        F.count(F.lit(1)).alias("n"), stats.mean(F.col("exact_match")).alias("exact_rate"), stats.mean(F.col("argument_validity")).alias("avg_validity"),
        stats.mean(F.col("required_argument_recall")).alias("avg_recall"), F.sum("hallucinated").alias("hallucinated"),
        F.grouping_id("baseline_name", "tool_name", "split").alias("grain"),
    )


def e3_harm(spark, d):
    return agg.harm_metrics(predictions(spark, d), "baseline_name")


def e5_confusion_by_tool(spark, d):
    return agg.harm_metrics(predictions(spark, d), "tool_name", "baseline_name")


def d14_harm_with_utility(spark, d):
    df = predictions(spark, d)
    harm = agg.harm_metrics(df, "baseline_name").select("baseline_name", "num_controls", "harmful_skill_injection_rate")
    utility = df.where("should_trigger").groupBy("baseline_name").agg(stats.mean(F.col("joint_exact_match")).alias("u"))
    return harm.join(utility, "baseline_name", "left").select("baseline_name", "num_controls", "harmful_skill_injection_rate", F.coalesce("u", F.lit(0.0)).alias("utility_joint_exact_match"))


def outcomes(spark, d):
    return agg.last_outcomes(predictions(spark, d), ["model_slug", "task_id"], "baseline_name", "joint_exact_match", ORDER)


def d2_pairs(spark, d):
    return agg.paired(outcomes(spark, d), ["model_slug", "task_id"], "baseline_name")


def i4_mcnemar(spark, d):
    return agg.with_mcnemar(d2_pairs(spark, d)).select("left_name", "right_name", "left_only", "right_only", "statistic", "p_value")


def i5_randomization(spark, d):
    """Approximate randomisation of the anchor against each condition: signs flip, so only the discordant counts matter.

    The sum of n random signs is drawn per discordant pair and iteration, as a sum of bits of a hash of (pair, iteration, block
    of 32 pairs): work is (discordant pairs / 32) x iterations whatever the number of rows.
    """
    p = agg.paired(outcomes(spark, d), ["model_slug", "task_id"], "baseline_name").where((F.col("left_name") == ANCHOR) | (F.col("right_name") == ANCHOR))
    p = p.withColumn("n", (F.col("left_only") + F.col("right_only")).cast("long"))
    runs = p.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(ITERATIONS)))).withColumn("blocks", F.ceil(F.col("n") / 32))
    runs = runs.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    wide = F.least(F.col("n") - 32 * F.col("k"), F.lit(32)).cast("int")
    bits = F.bit_count(F.expr("shiftright(r, 32 - wide)"))
    drawn = runs.withColumns({"r": stats.draw(F.col("left_name"), F.col("right_name"), F.col("i").cast("string"), F.col("k").cast("string")), "wide": wide})
    sums = drawn.groupBy("left_name", "right_name", "pairs", "n", "left_only", "right_only", "i").agg(F.sum(bits).alias("plus"))
    four = lambda x: F.round(F.abs(x) / F.col("pairs"), 4)
    extreme = F.count_if(four(2 * F.col("plus") - F.col("n")) >= four(F.col("left_only") - F.col("right_only")))
    return sums.groupBy("left_name", "right_name", "pairs").agg(F.round((extreme + 1) / (F.lit(ITERATIONS) + 1), 6).alias("p_value"))


def resampled(batches):
    """(baseline_name, n, m): sorted rates of ``ITERATIONS`` binomial draws for each row (baseline_name, n, k)."""
    for b in batches:
        rows = b.to_pylist()
        rates = []
        for r in rows:
            seed = hashlib.md5(f"boot|{r['baseline_name']}".encode()).digest()
            drawn = np.random.Generator(np.random.Philox(int.from_bytes(seed, "big"))).binomial(r["n"], r["k"] / r["n"], ITERATIONS)
            rates.append(np.sort(np.round(drawn / r["n"], 4)).tolist())
        yield pa.RecordBatch.from_arrays([b["baseline_name"], b["n"], pa.array(rates, pa.list_(pa.float64()))], ["baseline_name", "n", "m"])


def i2_bootstrap(spark, d):
    """Percentile interval of the joint rate by condition: a bootstrap over the two outcome counts.

    Drawing n of n rows with two outcomes, with replacement, has k' hits as a binomial of n and k / n gives them, so each
    iteration is one exact binomial draw (no normal approximation), seeded by a hash of the condition. Groups of any size
    cost the same.
    """
    g = predictions(spark, d).groupBy("baseline_name").agg(F.count(F.lit(1)).alias("n"), agg.hits("joint_exact_match").alias("k"))
    out = g.mapInArrow(resampled, "baseline_name string, n long, m array<double>")
    at = lambda q: F.element_at("m", int(q * (ITERATIONS - 1)) + 1)
    return out.select("baseline_name", "n", at(0.025).alias("low"), at(0.975).alias("high"))


MOST_DRAWS = 13
#: The distribution function of Poisson(1) at 0, 1, ...
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(MOST_DRAWS)]


def i3_cluster_bootstrap(spark, d):
    """Resampling of tools: (sum, count) by tool first, then tools are drawn by hash with replacement.

    A tool's number of draws in an iteration is Poisson(1) by its own hash, which needs no global count or order; the 32 bits of
    a hash can't tell more than ``MOST_DRAWS`` draws from the rest.
    """
    per = predictions(spark, d).groupBy("baseline_name", "expected_tool_name").agg(F.count(F.lit(1)).alias("n"), agg.hits("tool_selection_correct").alias("k"))
    u = stats.draw(F.coalesce("expected_tool_name", F.lit("")), F.col("baseline_name"), F.col("i").cast("string")) / 4294967296.0
    times = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    runs = per.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(ITERATIONS)))).withColumn("t", times)
    m = runs.groupBy("baseline_name", "i").agg(F.round(F.coalesce(F.sum(F.col("k") * F.col("t")) / F.nullif(F.sum(F.col("n") * F.col("t")), F.lit(0)), F.lit(0.0)), 4).alias("m"))
    out = m.groupBy("baseline_name").agg(F.sort_array(F.collect_list("m")).alias("m"))
    at = lambda q: F.element_at("m", int(q * (ITERATIONS - 1)) + 1)
    return out.select("baseline_name", at(0.025).alias("low"), at(0.975).alias("high"))


def d3_anchor_deltas(spark, d):
    """Wins, ties and losses of each condition's validity against the anchor, task by task."""
    last = agg.last_outcomes(predictions(spark, d), ["model_slug", "task_id"], "baseline_name", "argument_validity", ORDER)
    anchor = last.where(F.col("baseline_name") == ANCHOR).select("model_slug", "task_id", F.col("value").alias("av"))
    both = last.where(F.col("baseline_name") != ANCHOR).join(anchor, ["model_slug", "task_id"]).withColumn("delta", F.coalesce("av", F.lit(0.0)) - F.coalesce("value", F.lit(0.0)))
    return both.groupBy("baseline_name").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") == 0).alias("ties"), F.count_if(F.col("delta") < 0).alias("losses"), F.round(F.avg("delta"), 4).alias("avg_delta"))


def d5_disagreement(spark, d):
    """Model and task on which the anchor and another condition disagree, by direction and model."""
    o = outcomes(spark, d)
    a = o.where(F.col("baseline_name") == ANCHOR).select("model_slug", "task_id", F.col("value").alias("anchor_ok"))
    return o.where(F.col("baseline_name") != ANCHOR).join(a, ["model_slug", "task_id"]).where("anchor_ok <> value").groupBy("model_slug", "baseline_name", "anchor_ok").agg(F.count(F.lit(1)).alias("tasks"))


def error_class():
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    has = lambda x: F.array_contains(tags, x)
    missing = F.coalesce("required_argument_recall", F.lit(1.0)) < 1.0
    return (
        F.when(F.coalesce("exact_match", F.lit(False)), "success").when(F.size("hallucinated_args") > 0, "hallucinated_argument")
        .when(missing & has("semantic"), "semantic_missing_required_argument").when(missing, "missing_required_argument").when(has("semantic"), "semantic_mapping_failure")
        .when(has("exclude"), "exclude_pattern_failure").when(has("head") | has("tail"), "range_direction_failure").when(has("write"), "content_extraction_failure").otherwise("wrong_argument_value")
    )


def e15_error_taxonomy(spark, d):
    df = predictions(spark, d).join(tasks(spark, d, "tags"), "task_id", "left").withColumn("error_type", error_class()).where("error_type <> 'success'")
    n = df.groupBy("baseline_name", "error_type").agg(F.count(F.lit(1)).alias("failures"))
    return n.withColumn("rate", F.round(F.col("failures") / F.sum("failures").over(Window.partitionBy("baseline_name")), 4))


def e16_anchor_wins_by_tag(spark, d):
    """Tasks the anchor gets right and another condition wrong, by tag (multi-valued)."""
    o = outcomes(spark, d)
    a = o.where((F.col("baseline_name") == ANCHOR) & F.col("value")).select("model_slug", "task_id")
    wins = o.where((F.col("baseline_name") != ANCHOR) & ~F.col("value")).join(a, ["model_slug", "task_id"], "left_semi")
    return wins.join(tasks(spark, d, "tags"), "task_id").select("baseline_name", F.explode("tags").alias("tag")).groupBy("baseline_name", "tag").agg(F.count(F.lit(1)).alias("wins"))


def residual():
    return (
        F.when(~F.col("should_trigger") & F.col("triggered"), "negative_control_overtrigger")
        .when(F.coalesce("selected_tool_name", F.lit("")) != F.coalesce("expected_tool_name", F.lit("")), "tool_routing_error")
        .when(~F.col("triggered") & F.col("should_trigger"), "false_abstention").when(~F.col("argument_exact_match"), "argument_mismatch").otherwise("other_residual")
    )


def b30_residuals(spark, d):
    df = predictions(spark, d).where("NOT joint_exact_match")
    return df.groupBy("baseline_name", residual().alias("category")).agg(F.count(F.lit(1)).alias("records"))


DIMENSIONS = ("domain", "source_type", "difficulty", "negative_category", "num_required_args_bucket", "split")


def sliced(spark, d) -> DataFrame:
    """Prediction records with a row for each slice dimension, the dimension tables joined on their keys."""
    t = tools(spark, d, "domain", "source_type", "arguments")
    required = F.coalesce(F.size(F.filter("arguments", lambda a: a["required"])), F.lit(0))
    bucket = F.when(required <= 0, "0").when(required <= 2, "1-2").when(required <= 5, "3-5").otherwise("6+")
    t = t.select("tool_id", F.trim(F.lower("domain")).alias("domain"), "source_type", bucket.alias("num_required_args_bucket"))
    e = tasks(spark, d, "tool_id", "difficulty", "negative_category", "split").withColumns({"difficulty": F.lower("difficulty"), "split": F.trim(F.lower("split"))})
    df = predictions(spark, d).select("record_id", "task_id", "baseline_name", "joint_exact_match", "should_trigger", "triggered", "latency_ms").join(e, "task_id", "left").join(t, "tool_id", "left")
    label = lambda c: F.struct(F.lit(c).alias("dimension"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias("value"))
    return df.withColumn("slice", F.explode(F.array(*map(label, DIMENSIONS)))).select("*", "slice.dimension", "slice.value")


def e13_slices(spark, d):
    g = sliced(spark, d).groupBy("dimension", "value", "baseline_name").agg(
        F.count(F.lit(1)).alias("n"), stats.mean(F.col("joint_exact_match")).alias("joint_exact_match"),
        stats.ratio(F.count_if(F.col("should_trigger") & F.col("triggered")), F.count_if(F.col("triggered")), 1.0).alias("trigger_precision"),
        stats.mean(F.col("latency_ms")).alias("mean_latency"),
    )
    return g.withColumn("suppressed", F.col("n") < 30)


def e14_slice_deltas(spark, d):
    """Differences from the anchor within a slice, of means already rounded."""
    g = e13_slices(spark, d).select("dimension", "value", "baseline_name", "n", "joint_exact_match")
    a = g.where(F.col("baseline_name") == ANCHOR).select("dimension", "value", F.col("joint_exact_match").alias("anchor"), F.col("n").alias("anchor_n"))
    return g.where(F.col("baseline_name") != ANCHOR).join(a, ["dimension", "value"]).select("dimension", "value", "baseline_name", "n", "anchor_n", F.round(F.col("anchor") - F.col("joint_exact_match"), 4).alias("delta"))


QUANTILES = {"p50": 0.5, "p95": 0.95}


def e21_cost_latency(spark, d):
    """Latency (nulls skipped) and tokens by condition and model, with exact interpolated quantiles.

    Values are counted in narrow bins first (a few thousand rows a group whatever the number of records); only the values of
    the bins that hold a quantile's two ranks are counted one by one, so no group's values are gathered.
    """
    keys, p = ["baseline_name", "model_slug"], predictions(spark, d).select("baseline_name", "model_slug", "latency_ms", "prompt_tokens")
    sums = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("latency_ms").alias("timed"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"), F.sum("prompt_tokens").alias("tokens"))
    v = p.where("latency_ms IS NOT NULL").select(*keys, "latency_ms", F.floor(F.signum("latency_ms") * F.log2(1 + F.abs("latency_ms")) * 128).alias("bin"))
    running = lambda df, by, n: df.withColumn("upto", F.sum(n).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0)))
    bins = running(v.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("c")), [*keys, "bin"], "c").withColumn("before", F.col("upto") - F.col("c"))
    at = [F.struct(F.lit(q).alias("q"), F.lit(hi).alias("hi"), ((F.ceil if hi else F.floor)(F.lit(x) * (F.col("timed") - 1)) + 1).alias("rank")) for q, x in QUANTILES.items() for hi in (False, True)]
    wanted = sums.where("timed > 0").select(*keys, F.explode(F.array(*at)).alias("w")).select(*keys, "w.*")
    held = bins.join(wanted, keys).where("rank > before AND rank <= upto").select(*keys, "bin", "before", "q", "hi", "rank")
    near = v.join(held.select(*keys, "bin").distinct(), [*keys, "bin"], "left_semi").groupBy(*keys, "bin", "latency_ms").agg(F.count(F.lit(1)).alias("c"))
    found = running(near, [*keys, "bin", "latency_ms"], "c").join(held, [*keys, "bin"]).where("rank > before + upto - c AND rank <= before + upto")
    pick = lambda q, hi: F.max(F.when((F.col("q") == q) & (F.col("hi") == hi), F.col("latency_ms")))
    ends = found.groupBy(*keys).agg(*[pick(q, hi).alias(f"{q}_{hi}") for q in QUANTILES for hi in (False, True)])
    part = lambda q: (F.lit(QUANTILES[q]) * (F.col("timed") - 1)) % 1
    return sums.join(ends, keys, "left").select(*keys, "n", "timed", "avg_latency", "tokens", *[F.round(F.col(f"{q}_False") + part(q) * (F.col(f"{q}_True") - F.col(f"{q}_False")), 4).alias(q) for q in QUANTILES])


def f21_duplicates(spark, d):
    """Records delivered more than once."""
    from callmetrics.plans.views import read

    return read(spark, d, "predictions").groupBy("record_id").agg(F.count(F.lit(1)).alias("deliveries")).where("deliveries > 1")


def f27_failures(spark, d):
    """The three worst failures of each condition."""
    df = predictions(spark, d).where("NOT joint_exact_match").withColumn("h", F.greatest(F.size("hallucinated_args"), F.lit(0)))
    w = Window.partitionBy("baseline_name").orderBy(F.coalesce("argument_validity", F.lit(0.0)), F.coalesce("required_argument_recall", F.lit(0.0)), F.desc("h"), "record_id")
    return df.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("baseline_name", "rank", "record_id")


def f17_cases(spark, d):
    """The first five records of each residual category."""
    df = predictions(spark, d).where("NOT joint_exact_match").withColumn("category", residual())
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy("record_id"))).where("rank <= 5").select("category", "rank", "record_id")


WEIGHTS = {"v": 0.20, "p": 0.30, "n": 0.30, "a": 0.10, "c": 0.05, "s": 0.05}


def components(spark, d) -> DataFrame:
    """Six components in [0, 1] of each condition and tool."""
    df = predictions(spark, d)
    rate = lambda c, w: F.coalesce(F.avg(F.when(w, c.cast("double"))), F.lit(1.0))
    return df.groupBy("baseline_name", "tool_name").agg(
        F.avg(F.col("argument_schema_valid").cast("double")).alias("v"), rate(F.col("triggered") & F.col("tool_selection_correct"), F.col("should_trigger")).alias("p"),
        rate(~F.col("triggered"), ~F.col("should_trigger")).alias("n"), F.coalesce(F.avg("required_argument_recall"), F.lit(0.0)).alias("a"),
        F.coalesce(F.avg("argument_validity"), F.lit(0.0)).alias("c"), (1 - F.least(F.coalesce(F.avg("prompt_tokens"), F.lit(0.0)) / 1200, F.lit(1.0))).alias("s"),
    )


def score(weights=WEIGHTS):
    total = sum(weights.values())
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * sum(F.lit(w / total) * F.col(c) for c, w in weights.items()))) + stats.TIE, 4)


def i8_reliability(spark, d):
    r = components(spark, d).withColumn("score", score())
    return r.select("baseline_name", "tool_name", "score", F.when(F.col("score") >= 85, "deploy").when(F.col("score") >= 60, "repair").otherwise("reject").alias("decision"))


def i11_threshold_sweep(spark, d):
    r = components(spark, d).withColumn("score", score())
    return r.withColumn("threshold", F.explode(F.array(*map(F.lit, (60, 70, 80, 85, 90, 95))))).groupBy("baseline_name", "threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= F.col("threshold")).alias("accepted"))


def i12_weight_sensitivity(spark, d):
    """Mean change of the score if one weight is a tenth more or less, the weights made to sum to one again."""
    r = components(spark, d).withColumn("base", score())
    moved = [F.struct(F.lit(k).alias("component"), F.lit(f).alias("factor"), score({**WEIGHTS, k: WEIGHTS[k] * f}).alias("score")) for k in WEIGHTS for f in (0.9, 1.1)]
    return r.select("baseline_name", "base", F.explode(F.array(*moved)).alias("m")).groupBy("baseline_name", "m.component", "m.factor").agg(F.round(F.avg(F.col("m.score") - F.col("base")), 3).alias("mean_change"))


def i20_delta_ci(spark, d):
    """Difference of joint rates with bounds from both Wilson intervals, against the anchor."""
    m = e1_main_metrics(spark, d).select("baseline_name", "joint_exact_match", "joint_wilson_low", "joint_wilson_high")
    a = m.where(F.col("baseline_name") == ANCHOR).select(*[F.col(c).alias(f"a_{c}") for c in m.columns[1:]])
    r = lambda x, y: F.round(F.col(x) - F.col(y), 4)
    a = a.select(F.struct("*").alias("a")).scalar()  # one row: the anchor's
    out = m.where(F.col("baseline_name") != ANCHOR).withColumn("a", a).where("a IS NOT NULL").select("*", "a.*")
    out = out.select("baseline_name", r("a_joint_exact_match", "joint_exact_match").alias("delta"), r("a_joint_wilson_low", "joint_wilson_high").alias("low"), r("a_joint_wilson_high", "joint_wilson_low").alias("high"))
    return out.withColumn("claim", F.when(F.col("low") > 0, "supported").when(F.col("high") < 0, "unsupported").when(F.col("delta") > 0, "weak").otherwise("mixed"))


def e23_utility(spark, d):
    df = predictions(spark, d)
    m = df.groupBy("baseline_name").agg(F.avg(F.col("joint_exact_match").cast("double")).alias("j"), F.avg("argument_validity").alias("v"), F.avg(F.col("harmful_injection").cast("double")).alias("h"))
    m = m.withColumn("utility", F.round(4 * F.col("j") + F.col("v") - 6 * F.col("h"), 4))
    return m.select("baseline_name", "utility", F.rank().over(Window.orderBy(F.desc("utility"))).alias("rank"))


def b27_tokens(spark, d):
    df = predictions(spark, d)
    v = F.col("prompt_tokens")
    bucket = F.when(v.isNull(), "unknown").when(v <= 150, "ultra_compact").when(v <= 300, "compact").when(v <= 600, "medium").when(v <= 1200, "verbose").otherwise("very_verbose")
    return df.groupBy(bucket.alias("skill_token_bucket")).agg(F.count(F.lit(1)).alias("n"), stats.mean(F.col("joint_exact_match")).alias("joint_exact_match"))


def best_record(spark, d):
    """The best record of each task and condition: exact first, then validity, recall, fewest hallucinated, smallest id."""
    key = F.struct(F.coalesce("exact_match", F.lit(False)), F.coalesce("argument_validity", F.lit(0.0)), F.coalesce("required_argument_recall", F.lit(0.0)), -F.greatest(F.coalesce(F.size("hallucinated_args"), F.lit(0)), F.lit(0)), -F.col("record_id"))
    return predictions(spark, d).groupBy("task_id", "baseline_name").agg(F.max_by("record_id", key).alias("record_id"))


def run_plan(spark, d):
    """Calls and tokens of a run of every task under every condition and model, from the means so far."""
    m = predictions(spark, d).groupBy("baseline_name", "model_slug").agg(F.avg("prompt_tokens").alias("t"))
    n = tasks(spark, d).agg(F.count(F.lit(1)).alias("calls")).scalar()
    return m.withColumn("calls", n).select("baseline_name", "model_slug", "calls", F.round(F.col("t") * F.col("calls"), 2).alias("tokens"))


def i19_claims(spark, d):
    """Of each condition against the anchor: the claim, by the paired test and the direction of the difference."""
    p = i4_mcnemar(spark, d).where((F.col("left_name") == ANCHOR) | (F.col("right_name") == ANCHOR))
    left = F.col("left_name") == ANCHOR
    p = p.select(F.when(left, F.col("right_name")).otherwise(F.col("left_name")).alias("other"), F.when(left, F.col("left_only") - F.col("right_only")).otherwise(F.col("right_only") - F.col("left_only")).alias("net"), "p_value")
    return p.withColumn("claim", F.when((F.col("p_value") <= 0.05) & (F.col("net") > 0), "supported").when((F.col("p_value") <= 0.05) & (F.col("net") < 0), "unsupported").when(F.col("net") > 0, "weak").otherwise("insufficient"))


QUERIES = {k: f for k, f in globals().items() if callable(f) and k[0] in "bdefi" and k[1:2].isdigit()} | {"x_best_record": best_record, "x_run_plan": run_plan}

H = "WITH" + PREDICTIONS
M = lambda x: f"round(coalesce(avg(CAST({x} AS DOUBLE)), 0) + 1e-9::DOUBLE, 4)"
R = lambda a, b, e: f"CASE WHEN {b} = 0 THEN {e} ELSE round(CAST({a} AS DOUBLE) / {b}, 4) END"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    z, z2 = "1.959963984540054", "(1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE)"
    p = f"({k}::DOUBLE / {n})"
    return tuple(f"round({f}, 4)" for f in (
        f"greatest(0, ({p} + {z2} / (2 * {n}) - {z}::DOUBLE * sqrt(({p} * (1 - {p}) + {z2} / (4 * {n})) / {n})) / (1 + {z2} / {n}))",
        f"least(1, ({p} + {z2} / (2 * {n}) + {z}::DOUBLE * sqrt(({p} * (1 - {p}) + {z2} / (4 * {n})) / {n})) / (1 + {z2} / {n}))"))


def main_sql(keys: str) -> str:
    (tl, th), (jl, jh) = wilson_sql("count_if(tool_selection_correct)", "count(*)"), wilson_sql("count_if(joint_exact_match)", "count(*)")
    return f"""{H} SELECT {keys}, count(*) AS num_examples, {M('tool_selection_correct')} AS tool_selection_accuracy, {M('argument_schema_valid')} AS argument_schema_validity,
    {M('argument_exact_match')} AS argument_exact_match, {M('joint_exact_match')} AS joint_exact_match, {M('latency_ms')} AS avg_latency_ms, {M('prompt_tokens')} AS avg_token_overhead,
    {tl} AS tool_wilson_low, {th} AS tool_wilson_high, {jl} AS joint_wilson_low, {jh} AS joint_wilson_high FROM pr GROUP BY {keys}"""


def harm_sql(keys: str) -> str:
    return f"""{H} SELECT {keys}, count(*) AS num_controls, count_if(should_trigger) AS positive_controls, count_if(NOT should_trigger) AS negative_controls,
    count_if(should_trigger AND triggered) AS true_positives, count_if(should_trigger AND NOT triggered) AS false_negatives, count_if(NOT should_trigger AND triggered) AS harmful_activations,
    count_if(NOT should_trigger AND NOT triggered) AS true_negatives, {R('count_if(should_trigger AND triggered)', 'count_if(triggered)', 1.0)} AS trigger_precision,
    {R('count_if(should_trigger AND triggered)', 'count_if(should_trigger)', 1.0)} AS trigger_recall, {R('count_if(NOT should_trigger AND triggered)', 'count_if(NOT should_trigger)', 0.0)} AS harmful_skill_injection_rate,
    {R('count_if(harmful_injection)', 'count(*)', 0.0)} AS skill_induced_harm_rate FROM pr GROUP BY {keys}"""


LAST = f"{H}, ou AS (SELECT model_slug, task_id, baseline_name, arg_max(joint_exact_match, (created_at, ingested_at, record_id)) AS ok FROM pr GROUP BY ALL)"
PAIRS = LAST + """, pa AS (SELECT a.baseline_name AS left_name, b.baseline_name AS right_name, count(*) AS pairs, count_if(a.ok AND NOT b.ok) AS left_only, count_if(b.ok AND NOT a.ok) AS right_only,
  round(avg(a.ok::INT - b.ok::INT), 4) AS delta FROM ou a JOIN ou b ON a.model_slug = b.model_slug AND a.task_id = b.task_id AND a.baseline_name < b.baseline_name GROUP BY ALL)"""
ERROR = """CASE WHEN coalesce(exact_match, false) THEN 'success' WHEN len(hallucinated_args) > 0 THEN 'hallucinated_argument'
  WHEN coalesce(required_argument_recall, 1) < 1 AND list_contains(tags, 'semantic') THEN 'semantic_missing_required_argument' WHEN coalesce(required_argument_recall, 1) < 1 THEN 'missing_required_argument'
  WHEN list_contains(tags, 'semantic') THEN 'semantic_mapping_failure' WHEN list_contains(tags, 'exclude') THEN 'exclude_pattern_failure'
  WHEN list_contains(tags, 'head') OR list_contains(tags, 'tail') THEN 'range_direction_failure' WHEN list_contains(tags, 'write') THEN 'content_extraction_failure' ELSE 'wrong_argument_value' END"""
RESIDUAL = """CASE WHEN NOT should_trigger AND triggered THEN 'negative_control_overtrigger' WHEN coalesce(selected_tool_name, '') <> coalesce(expected_tool_name, '') THEN 'tool_routing_error'
  WHEN NOT triggered AND should_trigger THEN 'false_abstention' WHEN NOT argument_exact_match THEN 'argument_mismatch' ELSE 'other_residual' END"""
SLICED = f"""{H}, {TASKS}, {TOOLS}, tt AS (SELECT tool_id, trim(lower(domain)) AS domain, source_type, coalesce(len(list_filter(arguments, lambda a: a.required)), 0) AS rq FROM tl),
 sd AS (SELECT pr.*, unnest([('domain', t.domain), ('source_type', t.source_type), ('difficulty', lower(e.difficulty)), ('negative_category', e.negative_category),
   ('num_required_args_bucket', CASE WHEN t.tool_id IS NULL THEN NULL WHEN rq <= 0 THEN '0' WHEN rq <= 2 THEN '1-2' WHEN rq <= 5 THEN '3-5' ELSE '6+' END), ('split', trim(lower(e.split)))]) AS s
   FROM pr LEFT JOIN ev e USING (task_id) LEFT JOIN tt t ON e.tool_id = t.tool_id),
 sl AS (SELECT s[1] AS dimension, coalesce(nullif(s[2], ''), 'unknown') AS value, baseline_name, count(*) AS n, {M('joint_exact_match')} AS joint_exact_match,
   {R('count_if(should_trigger AND triggered)', 'count_if(triggered)', 1.0)} AS trigger_precision, {M('latency_ms')} AS mean_latency, count(*) < 30 AS suppressed FROM sd GROUP BY 1, 2, 3)"""
COMPONENTS = H + """, co AS (SELECT baseline_name, tool_name, avg(argument_schema_valid::INT::DOUBLE) AS v, coalesce(avg((triggered AND tool_selection_correct)::INT::DOUBLE) FILTER (should_trigger), 1) AS p,
  coalesce(avg((NOT triggered)::INT::DOUBLE) FILTER (NOT should_trigger), 1) AS n, coalesce(avg(required_argument_recall), 0) AS a, coalesce(avg(argument_validity), 0) AS c,
  1 - least(coalesce(avg(prompt_tokens), 0) / 1200, 1) AS s FROM pr GROUP BY ALL),
sc AS (SELECT *, round(least(100, greatest(0, 100 * (0.2::DOUBLE * v + 0.3::DOUBLE * p + 0.3::DOUBLE * n + 0.1::DOUBLE * a + 0.05::DOUBLE * c + 0.05::DOUBLE * s))) + 1e-9::DOUBLE, 4) AS score FROM co)"""
DRAW = lambda parts: f"('0x' || md5(concat_ws('|', {parts}))[1:8])::BIGINT"
SCORED = lambda w: "round(least(100, greatest(0, 100 * (" + " + ".join(f"{x / sum(w.values())!r}::DOUBLE * {c}" for c, x in w.items()) + "))) + 1e-9::DOUBLE, 4)"
MOVED = [f"{{'component': '{k}', 'factor': {f}, 'score': {SCORED({**WEIGHTS, k: WEIGHTS[k] * f})}}}" for k in WEIGHTS for f in (0.9, 1.1)]
T_ = "(1 / (1 + 0.3275911::DOUBLE * sqrt(chi / 2)))"
SQL = {
    "b25_normalized": f"{H} SELECT record_id, task_id, baseline_name, should_trigger, triggered, expected_tool_name, selected_tool_name, argument_schema_valid, argument_exact_match, tool_selection_correct, joint_exact_match, harmful_injection FROM pr",
    "e1_main_metrics": main_sql("baseline_name"), "e1_by_model": main_sql("baseline_name, model_slug"), "e3_harm": harm_sql("baseline_name"), "e5_confusion_by_tool": harm_sql("tool_name, baseline_name"),
    "e2_task_summary": f"""{H}, {TASKS}, j AS (SELECT pr.*, coalesce(trim(lower(ev.split)), 'unknown') AS split FROM pr LEFT JOIN ev USING (task_id))
      SELECT baseline_name, tool_name, split, count(*) AS n, {M('exact_match')} AS exact_rate, {M('argument_validity')} AS avg_validity, {M('required_argument_recall')} AS avg_recall,
      CAST(sum(coalesce(len(hallucinated_args), 0)) AS BIGINT) AS hallucinated, grouping(baseline_name, tool_name, split) AS grain FROM j GROUP BY GROUPING SETS ((baseline_name), (baseline_name, tool_name), (baseline_name, split))""",
    "d14_harm_with_utility": f"""{H} SELECT baseline_name, count(*) AS num_controls, {R('count_if(NOT should_trigger AND triggered)', 'count_if(NOT should_trigger)', 0.0)} AS harmful_skill_injection_rate,
      coalesce(round(avg(joint_exact_match::INT) FILTER (should_trigger), 4), 0) AS utility_joint_exact_match FROM pr GROUP BY 1""",
    "d2_pairs": f"{PAIRS} SELECT * FROM pa",
    "i4_mcnemar": f"""{PAIRS}, ch AS (SELECT *, CASE WHEN left_only + right_only = 0 THEN 0 ELSE pow(greatest(abs(left_only - right_only) - 1, 0), 2) / (left_only + right_only) END AS chi FROM pa)
      SELECT left_name, right_name, left_only, right_only, round(chi, 6) AS statistic, CASE WHEN left_only + right_only = 0 THEN 1 ELSE round({T_} * (0.254829592::DOUBLE + {T_} * (-0.284496736::DOUBLE + {T_} * (1.421413741::DOUBLE
      + {T_} * (-1.453152027::DOUBLE + {T_} * 1.061405429::DOUBLE)))) * exp(-chi / 2), 6) END AS p_value FROM ch""",
    "d3_anchor_deltas": f"""{H}, la AS (SELECT model_slug, task_id, baseline_name, arg_max(coalesce(argument_validity, 0), (created_at, ingested_at, record_id)) AS v FROM pr GROUP BY ALL)
      SELECT b.baseline_name, count(*) AS pairs, count_if(a.v > b.v) AS wins, count_if(a.v = b.v) AS ties, count_if(a.v < b.v) AS losses, round(avg(a.v - b.v), 4) AS avg_delta
      FROM la a JOIN la b USING (model_slug, task_id) WHERE a.baseline_name = '{ANCHOR}' AND b.baseline_name <> '{ANCHOR}' GROUP BY 1""",
    "d5_disagreement": f"{LAST} SELECT model_slug, b.baseline_name, a.ok AS anchor_ok, count(*) AS tasks FROM ou a JOIN ou b USING (model_slug, task_id) WHERE a.baseline_name = '{ANCHOR}' AND b.baseline_name <> '{ANCHOR}' AND a.ok <> b.ok GROUP BY ALL",
    "e15_error_taxonomy": f"""{H}, {TASKS}, f AS (SELECT baseline_name, {ERROR} AS error_type FROM pr LEFT JOIN ev USING (task_id))
      SELECT baseline_name, error_type, count(*) AS failures, round(count(*) / sum(count(*)) OVER (PARTITION BY baseline_name), 4) AS rate FROM f WHERE error_type <> 'success' GROUP BY 1, 2""",
    "e16_anchor_wins_by_tag": f"""{LAST}, {TASKS}, w AS (SELECT b.baseline_name, task_id FROM ou a JOIN ou b USING (model_slug, task_id) WHERE a.baseline_name = '{ANCHOR}' AND b.baseline_name <> '{ANCHOR}' AND a.ok AND NOT b.ok)
      SELECT baseline_name, tag, count(*) AS wins FROM (SELECT baseline_name, unnest(tags) AS tag FROM w JOIN ev USING (task_id)) GROUP BY 1, 2""",
    "b30_residuals": f"{H} SELECT baseline_name, {RESIDUAL} AS category, count(*) AS records FROM pr WHERE NOT joint_exact_match GROUP BY 1, 2",
    "e13_slices": f"{SLICED} SELECT * FROM sl",
    "e14_slice_deltas": f"{SLICED} SELECT dimension, value, b.baseline_name, b.n, a.n AS anchor_n, round(a.joint_exact_match - b.joint_exact_match, 4) AS delta FROM sl a JOIN sl b USING (dimension, value) WHERE a.baseline_name = '{ANCHOR}' AND b.baseline_name <> '{ANCHOR}'",
    "e21_cost_latency": f"{H} SELECT baseline_name, model_slug, count(*) AS n, count(latency_ms) AS timed, round(avg(latency_ms), 4) AS avg_latency, CAST(sum(prompt_tokens) AS BIGINT) AS tokens, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95 FROM pr GROUP BY 1, 2",
    "f21_duplicates": "SELECT record_id, count(*) AS deliveries FROM predictions GROUP BY 1 HAVING count(*) > 1",
    "f27_failures": f"{H} SELECT baseline_name, CAST(rank AS INT) AS rank, record_id FROM (SELECT *, row_number() OVER (PARTITION BY baseline_name ORDER BY coalesce(argument_validity, 0), coalesce(required_argument_recall, 0), coalesce(len(hallucinated_args), 0) DESC, record_id) AS rank FROM pr WHERE NOT joint_exact_match) WHERE rank <= 3",
    "f17_cases": f"{H} SELECT category, CAST(rank AS INT) AS rank, record_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY record_id) AS rank FROM (SELECT *, {RESIDUAL} AS category FROM pr WHERE NOT joint_exact_match)) WHERE rank <= 5",
    "i8_reliability": f"{COMPONENTS} SELECT baseline_name, tool_name, score, CASE WHEN score >= 85 THEN 'deploy' WHEN score >= 60 THEN 'repair' ELSE 'reject' END AS decision FROM sc",
    "i11_threshold_sweep": f"{COMPONENTS} SELECT baseline_name, threshold, count(*) AS n, count_if(score >= threshold) AS accepted FROM sc, (SELECT unnest([60, 70, 80, 85, 90, 95]) AS threshold) GROUP BY 1, 2",
    "i20_delta_ci": f"""WITH m AS ({main_sql('baseline_name')}), x AS (SELECT b.baseline_name, round(a.joint_exact_match - b.joint_exact_match, 4) AS delta, round(a.joint_wilson_low - b.joint_wilson_high, 4) AS low, round(a.joint_wilson_high - b.joint_wilson_low, 4) AS high
      FROM m a, m b WHERE a.baseline_name = '{ANCHOR}' AND b.baseline_name <> '{ANCHOR}') SELECT *, CASE WHEN low > 0 THEN 'supported' WHEN high < 0 THEN 'unsupported' WHEN delta > 0 THEN 'weak' ELSE 'mixed' END AS claim FROM x""",
    "e23_utility": f"{H}, u AS (SELECT baseline_name, round(4 * avg(joint_exact_match::INT) + avg(argument_validity) - 6 * avg(harmful_injection::INT), 4) AS utility FROM pr GROUP BY 1) SELECT *, CAST(rank() OVER (ORDER BY utility DESC) AS INT) AS rank FROM u",
    "b27_tokens": f"{H} SELECT CASE WHEN prompt_tokens IS NULL THEN 'unknown' WHEN prompt_tokens <= 150 THEN 'ultra_compact' WHEN prompt_tokens <= 300 THEN 'compact' WHEN prompt_tokens <= 600 THEN 'medium' WHEN prompt_tokens <= 1200 THEN 'verbose' ELSE 'very_verbose' END AS skill_token_bucket, count(*) AS n, {M('joint_exact_match')} AS joint_exact_match FROM pr GROUP BY 1",
    "x_best_record": f"{H} SELECT task_id, baseline_name, record_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id, baseline_name ORDER BY coalesce(exact_match, false) DESC, coalesce(argument_validity, 0) DESC, coalesce(required_argument_recall, 0) DESC, coalesce(len(hallucinated_args), 0), record_id) AS k FROM pr) WHERE k = 1",
    "i12_weight_sensitivity": f"""{COMPONENTS}, w AS (SELECT baseline_name, score AS base, unnest([{', '.join(MOVED)}]) AS m FROM sc) SELECT baseline_name, m.component, m.factor::DOUBLE AS factor, round(avg(m.score - base), 3) AS mean_change FROM w GROUP BY 1, 2, 3""",
    "i5_randomization": f"""{PAIRS}, p AS (SELECT left_name, right_name, pairs, left_only, right_only, left_only + right_only AS n FROM pa WHERE '{ANCHOR}' IN (left_name, right_name) AND left_only + right_only > 0),
      b AS (SELECT p.*, i, k, least(n - 32 * k, 32)::INT AS wide FROM p, range(1, {ITERATIONS} + 1) x(i), range(0, 100000) y(k) WHERE k < ceil(n / 32)),
      s AS (SELECT left_name, right_name, pairs, n, left_only, right_only, i, sum(bit_count(({DRAW("left_name, right_name, i, k")}) >> (32 - wide))) AS plus FROM b GROUP BY ALL)
      SELECT left_name, right_name, pairs, round((count_if(round(abs(2 * plus - n) / pairs, 4) >= round(abs(left_only - right_only) / pairs, 4)) + 1) / ({ITERATIONS} + 1), 6) AS p_value FROM s GROUP BY 1, 2, 3""",
    "i3_cluster_bootstrap": f"""{H}, g AS (SELECT baseline_name, expected_tool_name AS t, count(*) AS n, count_if(tool_selection_correct) AS k FROM pr GROUP BY 1, 2), u AS (SELECT g.*, i, {DRAW("coalesce(t, ''), baseline_name, i")} / 4294967296.0::DOUBLE AS u FROM g, range(1, {ITERATIONS} + 1) x(i)),
      d AS (SELECT *, {' + '.join(f"(u >= {c!r}::DOUBLE)::INT" for c in POISSON)} AS times FROM u), m AS (SELECT baseline_name, i, round(coalesce(sum(k * times) / nullif(sum(n * times), 0), 0), 4) AS m FROM d GROUP BY 1, 2), l AS (SELECT baseline_name, list(m ORDER BY m) AS m FROM m GROUP BY 1)
      SELECT baseline_name, m[{int(0.025 * (ITERATIONS - 1)) + 1}] AS low, m[{int(0.975 * (ITERATIONS - 1)) + 1}] AS high FROM l""",
    "x_run_plan": f"{H} SELECT baseline_name, model_slug, (SELECT count(DISTINCT task_id) FROM eval_tasks) AS calls, round(avg(prompt_tokens) * (SELECT count(DISTINCT task_id) FROM eval_tasks), 2) AS tokens FROM pr GROUP BY 1, 2",
}
SQL["i19_claims"] = f"""WITH m AS ({SQL['i4_mcnemar']}), x AS (SELECT CASE WHEN left_name = '{ANCHOR}' THEN right_name ELSE left_name END AS other, CASE WHEN left_name = '{ANCHOR}' THEN left_only - right_only ELSE right_only - left_only END AS net, p_value FROM m WHERE '{ANCHOR}' IN (left_name, right_name))
  SELECT *, CASE WHEN p_value <= 0.05 AND net > 0 THEN 'supported' WHEN p_value <= 0.05 AND net < 0 THEN 'unsupported' WHEN net > 0 THEN 'weak' ELSE 'insufficient' END AS claim FROM x"""
