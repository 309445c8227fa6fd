"""Operator 9, token counts without ids.

1. Every text is split into pre-tokens; each task counts its own and the counts are summed, which
   gives one table of distinct pre-tokens with their frequency.
2. The tokenizer counts the pieces of each distinct pre-token once.
3. That table is joined to the per-document frequencies and summed.  A third of all rows may hold
   the same word, so the join has two forms: the ``head`` most frequent pre-tokens (a fixed number,
   a few MB at any corpus size) are shipped to the tasks and summed there, and all others, each
   rare by definition, meet their documents in a shuffled join.

Rules for odd input: a null text counts as empty (0 bytes, 0 tokens); repeated rows and ids give
one result row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.llm.common import cut_lineage, ship_by_value
from vicinity.llm.pretoken import PreTokens

#: Pre-tokens that are shipped to the tasks; fixed, whatever the size of the corpus.
HEAD = 200_000
#: Distinct pre-tokens that a task holds before it hands its counts on.
HELD = 400_000
#: Documents of more tokens than this are flagged.
LIMIT = 2048


def distinct_pre_tokens(docs: DataFrame, text_col: str, path: str | None) -> DataFrame:
    """``(pre_token, n)`` over the whole corpus, summed in the tasks before the shuffle."""

    def count(batches):
        pre, seen = PreTokens(path), Counter()

        def flush():
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pre_token", "n"])
                seen.clear()

        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    seen.update(pre.split(text.as_py())[0])
                if len(seen) > HELD:
                    yield from flush()
        yield from flush()

    parts = docs.select(text_col).mapInArrow(count, "pre_token string, n long")
    return parts.groupBy("pre_token").agg(F.sum("n").alias("n"))


def with_pieces(pre_tokens: DataFrame, path: str | None) -> DataFrame:
    """Adds ``pieces``: the tokenizer sees each distinct pre-token once."""

    def count(batches):
        pre = PreTokens(path)
        for batch in batches:
            pieces = pre.counts(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], names=["pre_token", "n", "pieces"])

    return pre_tokens.select("pre_token", "n").mapInArrow(count, "pre_token string, n long, pieces long")


def most_frequent(table: DataFrame, head: int) -> DataFrame:
    """The pre-tokens of the largest counts, in whole classes of counts, at most ``head`` of them.

    A class spans a sixteenth of a power of e, so a few hundred class sizes tell where to stop and the
    rows themselves are filtered where they lie.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) * 16)
    sizes = table.groupBy(size_class.alias("c")).agg(F.count("*").alias("rows")).collect()
    least, total = None, 0
    for r in sorted(sizes, key=lambda r: -r["c"]):
        total += r["rows"]
        if total > head:
            break
        least = r["c"]
    return table.where(F.lit(False) if least is None else size_class >= least)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
                 tokenizer_path: str | None = None, head: int = HEAD) -> DataFrame:
    """One row per document: ``n_bytes``, ``n_tokens``, ``over_limit``."""
    ship_by_value()
    spark = docs.sparkSession
    table = cut_lineage(with_pieces(distinct_pre_tokens(docs, text_col, tokenizer_path), tokenizer_path), "pretokens")
    first = most_frequent(table, head).select("pre_token", "pieces").toArrow()
    known = dict(zip(first.column(0).to_pylist(), first.column(1).to_pylist(), strict=True))
    shipped = spark.sparkContext.broadcast(known)
    id_type = docs.schema[id_col].dataType
    rest_type = T.ArrayType(T.StructType([T.StructField("pre_token", T.StringType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_head", T.LongType()), T.StructField("rest", rest_type)])
    pair = pa.struct([("pre_token", pa.string()), ("n", pa.int64())])

    def frequencies(batches):
        pre, pieces = PreTokens(tokenizer_path), shipped.value
        for batch in batches:
            n_bytes, n_head, rest = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                tokens, added = pre.split(text)
                total, other = len(added), []
                for token, n in Counter(tokens).items():
                    k = pieces.get(token)
                    if k is None:
                        other.append((token, n))
                    else:
                        total += k * n
                n_bytes.append(len(text.encode()))
                n_head.append(total)
                rest.append([{"pre_token": t, "n": n} for t, n in other])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_head, pa.int64()), pa.array(rest, pa.list_(pair))],
                names=schema.names)

    per_doc = docs.select(id_col, text_col).mapInArrow(frequencies, schema).withColumn("row_no", F.monotonically_increasing_id())
    per_doc = cut_lineage(per_doc, "pretoken-freq")
    rare = (
        per_doc.select("row_no", F.explode("rest").alias("r"))
        .select("row_no", F.col("r.pre_token").alias("pre_token"), F.col("r.n").alias("in_doc"))
        .join(table.select("pre_token", "pieces"), "pre_token")
        .groupBy("row_no").agg(F.sum(F.col("in_doc") * F.col("pieces")).alias("n_rare"))
    )
    n_tokens = F.col("n_head") + F.coalesce(F.col("n_rare"), F.lit(0))
    return (
        per_doc.drop("rest").join(rare, "row_no", "left")
        .select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
    )
