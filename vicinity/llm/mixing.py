"""Operator 1, mixing sources to target weights: Poisson replication.  DataFrame functions only.

A group's mean repetition rate is its target share of the mixture divided by its share of the
characters.  Each document draws a uniform number from a hash of its id and a seed, and inverts the
Poisson distribution of its group's mean: the smallest count whose cumulative probability exceeds
the number.  It is exploded by that count, and the copies are dealt anew by a hash of id and copy
number and put in the order of that hash, which is a global shuffle that any rerun repeats.

Groups are the sources that the caller names and one for all others, so the table of means has a
size fixed by the parameters and is broadcast; sizes are partial sums, so a hot source is no burden.

Rules for odd input: a null source belongs to the others; a null or empty text adds no characters
but is replicated like its group, and a group without characters has mean ``epochs``; a null id
hashes like an empty one; rows that repeat an id draw the same count, each for itself; an empty
table gives an empty result; ``copies``, ``copy_no``, ``mean`` and ``shuffle_key`` replace input
columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HASH_BITS = 52


def uniform(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of md5(seed:id)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << _HASH_BITS))


def poisson_cdf(mean: str) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to far beyond any 52-bit number, as an array."""
    return F.expr(f"""
        aggregate(
          sequence(1, cast(ceil({mean} + 12 * sqrt({mean}) + 30) as int)),
          named_struct('log_p', -{mean}, 'cdf', array(exp(-{mean}))),
          (s, k) -> named_struct(
            'log_p', s.log_p + ln({mean}) - ln(k),
            'cdf', array_append(s.cdf, element_at(s.cdf, -1) + exp(s.log_p + ln({mean}) - ln(k)))),
          s -> s.cdf)
    """)


def group_of(source_col: str, weights: dict[str, float]) -> Column:
    """The source itself where it is named in ``weights``, else null (all others)."""
    return F.when(F.col(source_col).isin(*weights), F.col(source_col)) if weights else F.lit(None).cast("string")


def means(docs: DataFrame, weights: dict[str, float], other_weight: float, source_col: str, text_col: str, epochs: float) -> DataFrame:
    """``(group, mean, cdf)``: at most one row for each named source and one for the others."""
    sizes = docs.groupBy(group_of(source_col, weights).alias("group")).agg(
        F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("double").alias("chars"))
    pairs = [F.lit(x) for name, weight in weights.items() for x in (name, float(weight))]
    named = F.element_at(F.create_map(*pairs), F.col("group")) if pairs else F.lit(None).cast("double")
    sizes = sizes.withColumn("weight", F.when(F.col("chars") > 0, F.coalesce(named, F.lit(float(other_weight)))))
    totals = sizes.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    mean = F.when(F.col("chars") > 0, F.lit(epochs) * F.col("weight") / F.col("all_weight") * F.col("all_chars") / F.col("chars"))
    # One row of totals meets the few rows of sizes.
    return sizes.join(F.broadcast(totals)).select("group", F.coalesce(mean, F.lit(float(epochs))).alias("mean")).select(
        "group", "mean", F.when(F.col("mean") > 0, poisson_cdf("mean")).otherwise(F.array(F.lit(1.0))).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float], other_weight: float = 0.0, epochs: float = 1.0, seed: int = 0,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, one row for each copy, with ``mean, copies, copy_no, shuffle_key``."""
    added = ("mean", "copies", "copy_no", "shuffle_key")
    kept = [c for c in docs.columns if c not in added]
    table = means(docs, weights, other_weight, source_col, text_col, epochs)
    # The input's columns travel in a struct, so no name of theirs can clash with the operator's.
    rows = docs.select(
        F.struct(*(F.col(c) for c in kept)).alias("_doc"), group_of(source_col, weights).alias("_group"), uniform(id_col, seed).alias("_u"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"))
    rows = rows.join(F.broadcast(table), F.col("_group").eqNullSafe(F.col("group")))
    copies = F.expr("size(filter(cdf, c -> c <= _u))").cast("long")
    drawn = rows.withColumn("copies", copies).where("copies > 0").select(
        "_doc", "_id", "mean", "copies", F.explode(F.expr("sequence(1L, copies)")).alias("copy_no"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_id"), F.lit("#"), F.col("copy_no").cast("string")))
    drawn = drawn.select("_doc", "mean", "copies", "copy_no", key.alias("shuffle_key"))
    return drawn.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key").select("_doc.*", *added)
