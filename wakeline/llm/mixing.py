"""Problem 7: mixing sources to target weights.

Sizes are tokens of a public tokenizer. A source's target is its share of the size of the mix (by default the tokens of all
documents); its repetition rate is the target over the tokens it has, at most `max_repeats`. Poisson replication: each document
is used as often as the inverse of a Poisson distribution, cut off at `max_repeats`, gives for a number hashed from its key,
where the mean of the cut-off distribution is the rate. Documents are exploded by that count and shuffled by hash.

Used tokens deviate from the target by chance; the standard deviation that the distribution gives is reported beside them.
A source that cannot reach its target at `max_repeats` is short: all its documents are used that often.

Documents are tokenized once, and their sizes are stored; the plan, one row per target, is stored too, so the planner knows its
size and broadcasts it only if it is small.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from math import exp

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.lineage import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEED = 42
#: The pattern that splits text before the merges of the rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def source_key(source: Column) -> Column:
    """Sources in the form in which they are compared; blank ones are null."""
    s = F.translate(F.lower(F.regexp_replace(source, r"^\s+|(?<!\s)\s+$", "")), "- ", "__")
    return F.when(s != "", s)


def token_counter(path: str):
    """A function from text to its number of tokens, kept for the life of the process."""
    import base64

    import tiktoken

    kept = vars(tiktoken).setdefault("_wakeline_counters", {})
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("wakeline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        kept[path] = lambda text: len(encode(text)) if text else 0
    return kept[path]


def token_sizes(docs: DataFrame, key: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_key, source (compared form, null if blank), n_tokens of every row; null texts have 0. Other columns are not read.
    The tokenizer's file is read where the driver runs and travels with the job."""
    kind = docs.schema[key].dataType.simpleString()
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        count = token_counter(SparkFiles.get(name))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(count, batch.column(2).to_pylist()), pa.int64())], names=["doc_key", "source", "n_tokens"])

    return docs.select(F.col(key).alias("k"), source_key(F.col(source)).alias("s"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"doc_key {kind}, source string, n_tokens long")


def cut_off_mean(rate: float, repeats: int) -> float:
    """Mean of the Poisson distribution that has the mean `rate` when cut off at `repeats`; rate < repeats."""
    low, high = rate, max(1.0, 8.0 * repeats + 50.0)
    for _ in range(80):
        mid = (low + high) / 2
        term, total = exp(-mid), 0.0
        missing = 1.0
        for k in range(repeats):  # E[min(X, c)] = sum over k < c of P(X > k)
            missing -= term
            total += missing
            term *= mid / (k + 1)
        low, high = (mid, high) if total < rate else (low, mid)
    return (low + high) / 2


def steps_of(rate: float, repeats: int) -> list[float]:
    """P(count <= k) for k below `repeats`: a document with the number u in [0, 1) is used as often as there are steps <= u."""
    if repeats <= 0 or rate <= 0:
        return []
    if rate >= repeats:
        return [0.0] * repeats
    mean = cut_off_mean(rate, repeats)
    term, total, out = exp(-mean), 0.0, []
    for k in range(repeats):
        total += term
        out.append(total)
        term *= mean / (k + 1)
    return out


def variance_of(steps: list[float]) -> float:
    """Of the number of uses of one document."""
    mean = sum(1 - c for c in steps)
    return sum((2 * k + 1) * (1 - c) for k, c in enumerate(steps)) - mean * mean


def mix_plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target: source (as spelled in targets), key, target_share, max_repeats, n_docs, tokens, wanted (tokens),
    available (tokens times max_repeats), short, rate, steps (of the distribution of uses), sd_tokens (standard deviation of the
    tokens used). sizes: as `token_sizes`. total_tokens: size of the mix; None for the tokens of all documents.

    A source that occurs in several targets is planned once, with the largest share. Null shares and repeats count as 0.
    """
    have = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("squares"))
    total = have.agg(F.coalesce(F.sum("tokens") if total_tokens is None else F.lit(total_tokens), F.lit(0)).alias("total"))
    named = targets.select(F.col("source").alias("name"), source_key(F.col("source")).alias("key"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).where("key IS NOT NULL")
    once = named.groupBy("key").agg(F.max_by(F.struct("name", "target_share", "max_repeats"), F.struct("target_share", "name")).alias("t")).select("key", "t.*")
    plan = once.join(have, once["key"] == have["source"], "left").crossJoin(F.broadcast(total)).select(  # total: one row
        F.col("name").alias("source"), "key", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        (F.col("target_share") * F.col("total")).alias("wanted"), (F.col("max_repeats") * F.coalesce("tokens", F.lit(0))).cast("double").alias("available"), F.coalesce("squares", F.lit(0.0)).alias("squares"),
    )
    rate = F.when(F.col("tokens") > 0, F.least("wanted", "available") / F.col("tokens")).otherwise(F.lit(0.0))
    rated = plan.withColumn("short", F.col("available") < F.col("wanted")).withColumn("rate", rate)
    kinds = ", ".join(f"{n} {t}" for n, t in rated.dtypes if n != "squares")

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = [steps_of(r, n) for r, n in zip(batch.column("rate").to_pylist(), batch.column("max_repeats").to_pylist())]
            sd = [max(0.0, x * variance_of(s)) ** 0.5 for x, s in zip(batch.column("squares").to_pylist(), steps)]
            own = [n for n in batch.schema.names if n != "squares"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in own), pa.array(steps, pa.list_(pa.float64())), pa.array(sd, pa.float64())], names=[*own, "steps", "sd_tokens"])

    return rated.mapInArrow(stepped, f"{kinds}, steps array<double>, sd_tokens double")


def replicate(sizes: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_key, source, n_tokens, copy (from 1): every use of a document in the mix, in an order that is a global shuffle.

    The same seed gives the same mix. Documents without a source or of a source without target are not used.
    """
    order = F.xxhash64(F.lit(seed + 1), "doc_key", "copy")
    return _uses(sizes, plan, seed).withColumn("_o", order).repartition("_o").sortWithinPartitions("_o", "doc_key", "copy").drop("_o")


def _uses(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    ready = plan.select(F.col("key").alias("_key"), F.col("source").alias("_name"), F.col("steps").alias("_steps"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_key"), 11) / F.lit(float(1 << 53))
    used = sizes.join(ready, sizes["source"] == ready["_key"]).withColumn("_u", u).withColumn("_n", F.size(F.filter("_steps", lambda c: c <= F.col("_u"))))
    return used.where("_n > 0").select("doc_key", F.col("_name").alias("source"), "n_tokens", F.explode(F.sequence(F.lit(1), "_n")).alias("copy"))


def shares(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """plan's source, target_share, max_repeats, n_docs, tokens, wanted, short and sd_tokens, and what the mix has: n_used,
    used_tokens, actual_share (of the mix). Order and repeats of `mixed` do not matter.

    short is judged by what was used: fewer tokens than wanted although every document was used max_repeats times."""
    used = mixed.groupBy("source").agg(F.count("*").alias("n_used"), F.sum("n_tokens").alias("used_tokens"))
    both = plan.select("source", "target_share", "max_repeats", "n_docs", "tokens", "wanted", "sd_tokens").join(used, "source", "left").na.fill(0, ["n_used", "used_tokens"])
    total = used.agg(F.sum("used_tokens").alias("_total"))
    short = (F.col("used_tokens") == F.col("max_repeats") * F.col("tokens")) & (F.col("used_tokens") < F.col("wanted"))
    return both.crossJoin(F.broadcast(total)).withColumn("short", short).withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.col("_total"), F.lit(0.0))).drop("_total")  # total: one row


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, seed: int = SEED, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses of documents as `replicate`, shares as `shares`). Token counts are computed once and stored."""
    sizes = stored(token_sizes(docs, key, text, source, tokenizer))
    plan = stored(mix_plan(sizes, targets, total_tokens))
    return replicate(sizes, plan, seed), shares(plan, _uses(sizes, plan, seed))
