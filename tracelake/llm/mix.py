"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.bpe import VOCABULARY
from tracelake.llm.encode import token_counts
from tracelake.operators._groups import salted_join
from tracelake.session import materialize

SEED = 20240229
#: Documents of one sorted range; a range is sorted and summed by one task.
DOCUMENTS_PER_RANGE = 1_000_000


def _plan(counts: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """One row per mix and source: share, cap, wanted and available tokens, whole epochs and the rest to cut."""
    wanted = counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]  # one number
    sources = counts.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    weight = F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)
    weight = F.when(F.isnan("target_share"), 0.0).otherwise(weight)
    targets = (
        mix_targets.filter("mix_name is not null and source is not null")
        .select("mix_name", "source", weight.alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
        .groupBy("mix_name", "source")
        .agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    )
    total = F.sum("weight").over(Window.partitionBy("mix_name"))
    share = F.when(total > 0, F.col("weight") / total).otherwise(0.0)
    joined = targets.withColumn("target_share", share).join(sources, "source", "left").withColumn("wanted_total", F.lit(wanted).cast("long"))
    have = F.coalesce("available_tokens", F.lit(0))
    budget = F.round(F.col("target_share") * F.col("wanted_total")).cast("long")
    used = F.least(budget, have * F.col("max_repeats"))
    planned = joined.select(
        "mix_name", "source", "target_share", "max_repeats", "wanted_total", budget.alias("wanted_tokens"), have.alias("available_tokens"),
        used.alias("used"),
    )
    epochs = F.when(F.col("available_tokens") > 0, F.floor(F.col("used") / F.col("available_tokens"))).otherwise(0).cast("int")
    return planned.withColumn("epochs", epochs).withColumn("rest", F.col("used") - F.col("epochs") * F.col("available_tokens"))


def _ordered(counts: DataFrame, seed: int, partitions: int | None) -> DataFrame:
    """Documents with tokens, range-sorted by (source, hash-random key), and the tokens before each in its source.

    There are as many ranges as the documents fill, or partitions. Sorted ranges are written with their number; the sums within a range and the sums of whole ranges are then added,
    so a source that holds most of the corpus is summed in as many pieces as it fills ranges.
    """
    key = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.col("n_tokens"))
    keyed = counts.filter("n_tokens > 0 and source is not null").withColumn("key", key)
    if partitions is None:
        partitions = max(8, -(-counts.count() // DOCUMENTS_PER_RANGE))  # one number
    ranged = keyed.repartitionByRange(partitions, "source", "key", "doc_id").withColumn("range", F.spark_partition_id())
    written = materialize(ranged)
    within = Window.partitionBy("range", "source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    local = written.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    pieces = written.groupBy("range", "source").agg(F.sum("n_tokens").alias("piece"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("range", "source", F.coalesce(F.sum("piece").over(earlier), F.lit(0)).alias("offset"))
    return local.join(offsets, ["range", "source"]).select("doc_id", "source", "n_tokens", (F.col("before") + F.col("offset")).alias("before"))


def mixed_documents(
    documents: DataFrame, mix_targets: DataFrame, path: str = VOCABULARY, seed: int = SEED, partitions: int | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """Documents of each mix with how often each is taken: (mix_name, doc_id, source, n_tokens, repeats).

    The wanted total is the number of tokens of all documents; a source's budget is its share (weights divided by their
    sum) of it. Each source's documents come in a hash-random order: as many whole epochs as fit, then documents from
    the start up to the rest of the budget; the last one is taken if more than half of it fits, so a source misses its
    budget by half a document at most. No document is taken more than max_repeats times in total; a source
    that would need more falls short, and the other sources keep their budgets. Null, negative and NaN weights count
    0, a null max_repeats 1; documents without tokens or source are never taken; a source named twice in a mix has
    the sum of its weights and the smaller cap; rows of repeated doc_id are documents of their own. counts, if given, are
    the written token counts of the same documents.
    """
    counts = materialize(token_counts(documents, path)) if counts is None else counts
    plan = _plan(counts, mix_targets)
    ordered = _ordered(counts, seed, partitions)
    taken = salted_join(ordered, plan.select("mix_name", "source", "epochs", "rest"), "source", F.xxhash64("doc_id", "before"))
    repeats = F.col("epochs") + F.when(F.col("before") + F.col("n_tokens") / 2 < F.col("rest"), 1).otherwise(0)
    return taken.select("mix_name", "doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats")).filter("repeats > 0")


def mix_shares(
    documents: DataFrame, mix_targets: DataFrame, path: str = VOCABULARY, seed: int = SEED, partitions: int | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """Per mix and source what was wanted and reached.

    reached_share is of the wanted total, share_of_mix of what the mix holds; both differ if a source falls short.
    """
    counts = materialize(token_counts(documents, path)) if counts is None else counts
    plan = _plan(counts, mix_targets)
    ordered = _ordered(counts, seed, partitions)
    taken = salted_join(ordered, plan.select("mix_name", "source", "epochs", "rest"), "source", F.xxhash64("doc_id", "before"))
    repeats = F.col("epochs") + F.when(F.col("before") + F.col("n_tokens") / 2 < F.col("rest"), 1).otherwise(0)
    reached = taken.withColumn("repeats", repeats).filter("repeats > 0").groupBy("mix_name", "source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("reached_tokens"), F.max("repeats").alias("most_repeats")
    )
    out = plan.join(reached, ["mix_name", "source"], "left")
    tokens = F.coalesce("reached_tokens", F.lit(0))
    whole = F.sum(tokens).over(Window.partitionBy("mix_name"))
    return out.select(
        "mix_name", "source", "target_share", "max_repeats", "wanted_tokens", "available_tokens",
        F.coalesce("documents", F.lit(0)).alias("documents"), tokens.alias("reached_tokens"), F.coalesce("most_repeats", F.lit(0)).cast("int").alias("most_repeats"),
        F.when(F.col("wanted_total") > 0, tokens / F.col("wanted_total")).otherwise(0.0).alias("reached_share"),
        F.when(whole > 0, tokens / whole).otherwise(0.0).alias("share_of_mix"),
    )
