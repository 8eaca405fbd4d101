"""Scores of summaries and runs, and the tables that training reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.text import basename, word_count

TOP_K, GOOD_DISTORTION = 20, 0.5


def step_entities(steps: DataFrame, key: str, name: str = "name", calls: str = "tool_calls") -> DataFrame:
    """key, entity (distinct, lower case) of step rows: names of tools and calls, and of every string argument at the top
    level with a slash or dot what follows its last slash. Arguments are JSON texts; others than objects have none."""
    own = steps.where(F.coalesce(name, F.lit("")) != "").select(key, F.lower(name).alias("entity"))
    call = steps.select(key, F.explode(calls).alias("c"))
    named = call.where("c IS NOT NULL").select(key, F.lower(F.coalesce("c.name", F.lit(""))).alias("entity"))
    args = F.from_json(F.col("c.arguments"), "map<string,variant>")
    value = call.select(key, F.explode(F.map_values(args)).alias("v")).where("schema_of_variant(v) = 'STRING'").select(key, F.expr("variant_get(v, '$', 'string')").alias("v"))
    used = value.where(F.contains("v", F.lit("/")) | F.contains("v", F.lit("."))).select(key, F.lower(basename(F.col("v"))).alias("entity"))
    return own.unionByName(named).unionByName(used).distinct()


def coverage(entities: DataFrame, summaries: DataFrame, key: str, summary: str) -> DataFrame:
    """key, n_entities, coverage: the share of a trajectory's entities that its summary contains; 0.5 without entities."""
    per = entities.groupBy(key).agg(F.collect_set("entity").alias("_e"))
    text = F.lower(F.coalesce(summary, F.lit("")))
    hit = F.size(F.filter("_e", lambda e: F.contains(text, e)))
    joined = summaries.join(per, key, "left")
    return joined.select(key, F.coalesce(F.size("_e"), F.lit(0)).cast("long").alias("n_entities"), F.when(F.size("_e") > 0, hit / F.size("_e")).otherwise(F.lit(0.5)).alias("coverage"))


def top_k(log_probs: Column, k: int = TOP_K) -> Column:
    """The k likeliest entries of a map of token to log-probability; equals by token."""
    order = lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.map_from_entries(F.slice(F.array_sort(F.map_entries(log_probs), order), 1, k))


def kl(x: Column, z: Column) -> Column:
    """Sum over the tokens of both maps of p_x (log p_x - log p_z); 0 where either map is null. Not renormalised."""
    terms = F.aggregate(F.map_entries(x), F.lit(0.0), lambda a, e: a + F.coalesce(F.exp(e["value"]) * (e["value"] - F.try_element_at(z, e["key"])), F.lit(0.0)))
    return F.when(x.isNull() | z.isNull(), F.lit(0.0)).otherwise(terms)


def kl_per_position(x_top: Column, z_top: Column) -> Column:
    """`kl` at each position of the shorter list."""
    n = F.least(F.size(x_top), F.size(z_top))
    return F.transform(F.slice(F.arrays_zip(x_top.alias("x"), z_top.alias("z")), F.lit(1), n), lambda p: kl(p["x"], p["z"]))


def completion_positions(x_top: Column, z_top: Column, n_x_context: Column, n_x_full: Column, n_z_context: Column) -> tuple[Column, Column]:
    """The positions of the completion in both lists: as many as the full prompt has beyond its context."""
    n = F.greatest(n_x_full - n_x_context, F.lit(0))
    return F.slice(x_top, n_x_context + 1, n), F.slice(z_top, n_z_context + 1, n)


def score_completion(answers: DataFrame, completion: str) -> DataFrame:
    """Adds per_position, the divergence at each position of a completion, to answers of log-probabilities (`providers.LOG_PROBS`);
    no positions for a blank or null completion, null where the answers are null (a request that failed)."""
    x, z = completion_positions(*(F.col(c) for c in ("x_top", "z_top", "n_x_context", "n_x_full", "n_z_context")))
    blank = F.trim(F.coalesce(F.col(completion), F.lit(""))) == ""
    return answers.withColumn("per_position", F.when(blank, F.array().cast("array<double>")).otherwise(kl_per_position(x, z)))


def distortion(per_position: Column) -> Column:
    """Mean over all positions; null without positions."""
    n = F.size(per_position)
    return F.when(n > 0, F.aggregate(per_position, F.lit(0.0), lambda a, v: a + v) / n)


def distortion_error(per_position: Column) -> Column:
    """Why there is no distortion; null where there is one."""
    return F.when(per_position.isNull(), "score_completion failed").when(F.size(per_position) == 0, "No completion tokens scored")


def distortion_reward(distorted: Column, summary: Column, penalty: float = 0.0) -> Column:
    """Fidelity less the penalty per word; 0 where there is no distortion."""
    return F.coalesce(-distorted - F.lit(penalty) * word_count(summary), F.lit(0.0))


def realised_log_ratio(x_log_probs: Column, z_log_probs: Column) -> Column:
    """Mean log-ratio of the realised tokens, the measure the top-k sum approximates."""
    pairs = F.slice(F.arrays_zip(x_log_probs.alias("x"), z_log_probs.alias("z")), F.lit(1), F.least(F.size(x_log_probs), F.size(z_log_probs)))
    return distortion(F.transform(pairs, lambda p: p["x"] - p["z"]))


def centred(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Adds mean_reward and advantage (reward less the group's mean). Means are combined before the shuffle and joined, so a hot
    group is never gathered in one task; a null group is a group."""
    means = df.groupBy(F.col(group).alias("_g")).agg(F.avg(reward).alias("mean_reward"))
    joined = df.drop("mean_reward", "advantage").join(means, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    return joined.withColumn("advantage", F.col(reward) - F.col("mean_reward"))


def varied_groups(df: DataFrame, group: str, advantage: str = "advantage") -> DataFrame:
    """Drops groups all of whose advantages are 0."""
    varied = df.groupBy(F.col(group).alias("_g")).agg(F.max(F.abs(F.col(advantage))).alias("_m")).where("_m > 0").select("_g")
    return df.join(varied, F.col(group).eqNullSafe(F.col("_g")), "left_semi")


def batch_rewards(df: DataFrame, batch: str, group: str, reward: str) -> DataFrame:
    """batch, mean and max of the group means, n_groups; groups without variation count too."""
    means = df.groupBy(batch, group).agg(F.coalesce(F.avg(reward), F.lit(0.0)).alias("_m"))
    return means.groupBy(batch).agg(F.avg("_m").alias("mean_reward"), F.max("_m").alias("max_reward"), F.count("*").alias("n_groups"))


def datum(prompt_len: Column, tokens: Column, log_probs: Column, advantage: Column) -> Column:
    """target_tokens, logprobs, advantages: arrays as long as the model input (prompt and all tokens but the last), 0 over the
    prompt but for its last position, which predicts the first token."""
    ob = prompt_len - 1
    zeros = lambda kind: F.array_repeat(F.lit(0).cast(kind), ob)
    return F.struct(
        F.concat(zeros("int"), tokens).alias("target_tokens"), F.concat(zeros("double"), log_probs).alias("logprobs"), F.concat(zeros("double"), F.array_repeat(advantage.cast("double"), F.size(tokens))).alias("advantages")
    )


def loss_mask(n_prompt: Column, n_summary: Column, max_length: int | None = None) -> Column:
    """0 for the prompt's tokens and 1 for the summary's, cut at max_length."""
    mask = F.concat(F.array_repeat(F.lit(0), n_prompt), F.array_repeat(F.lit(1), n_summary))
    return F.slice(mask, 1, max_length) if max_length else mask


def mean_nll(weights: Column, log_probs: Column) -> Column:
    """Mean negative log-likelihood of weighted tokens (our definition: -sum(w lp) / sum(w))."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)
    return F.try_divide(-total(F.zip_with(weights, log_probs, lambda w, lp: w * lp)), total(F.transform(weights, lambda w: w.cast("double"))))


def batch_metrics(df: DataFrame, batch: str, n_tokens: str, n_steps: str) -> DataFrame:
    """batch, n_rows, n_tokens, mean_steps."""
    return df.groupBy(batch).agg(F.count("*").alias("n_rows"), F.sum(n_tokens).alias("n_tokens"), F.avg(n_steps).alias("mean_steps"))


def partial_score(f2p_success: Column, f2p_failure: Column, p2p_success: Column, p2p_failure: Column, empty_is_failure: bool = False) -> Column:
    """Mean of the shares of passed tests of both classes. An empty class counts 1; with empty_is_failure (the older form) it
    makes the score 0. A null count (malformed report) makes the score 0."""

    def share(good: Column, bad: Column) -> Column:
        total = good + bad
        return F.when(total > 0, good / total).when(total.isNotNull(), F.lit(None).cast("double") if empty_is_failure else F.lit(1.0))

    return F.coalesce((share(f2p_success, f2p_failure) + share(p2p_success, p2p_failure)) / 2, F.lit(0.0))


def resolved(f2p_failure: Column, p2p_failure: Column) -> Column:
    """Whether no test failed (our reading of full resolution)."""
    return F.coalesce((f2p_failure == 0) & (p2p_failure == 0), F.lit(False))


def test_report(gold: DataFrame, statuses: DataFrame, key: str, test: str, kind: str, status: str, passed: tuple[str, ...] = ("PASSED", "XFAIL")) -> DataFrame:
    """key, kind, success, failure: gold tests by outcome (sorted). A test without a status, or all where the log could not be
    parsed, is a failure."""
    rows = gold.join(statuses.select(key, test, status).distinct(), [key, test], "left")
    good = F.coalesce(F.col(status).isin(list(passed)), F.lit(False))
    return rows.groupBy(key, kind).agg(F.array_sort(F.collect_set(F.when(good, F.col(test)))).alias("success"), F.array_sort(F.collect_set(F.when(~good, F.col(test)))).alias("failure"))
