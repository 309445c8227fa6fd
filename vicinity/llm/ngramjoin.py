"""Operator 12, Jaccard self-join on word n-grams by token-combination prefixes.

A token is an n-word shingle.  All sets share one order of tokens, and a set is indexed under
signatures made of a prefix of its tokens:

* Two similar sets of which the larger has n tokens share at least ``ceil(t n)`` of them, so among the
  first tokens of a set at most ``e = n - ceil(t n)`` are missing in the other.
* Tokens are of two classes.  A rare one is a signature by itself.  Frequent ones, which would bring
  thousands of sets together, count in pairs: they are dealt by hash over some parts, and two of one
  part make a signature.  Two sets without a common signature share no rare token of the prefix and at
  most one token of each part.  So a prefix is extended until its tokens, less one for each part that
  it touches, are more than e; then similar sets have a common signature (of the two prefixes the one
  that ends first lies within the other).
* Frequencies are counted over the tokens with the lowest quarter of hashes, of all sets.  Tokens of one
  set alone come first in the order, then repeated ones, then frequent ones, then those that were not
  counted; ties by hash.  A token of one set alone meets nobody, so it is not indexed.  Tasks are told
  the repeated tokens as a bitmap and the frequent ones as a list, both bounded; beyond the bounds the
  most frequent ones are told, and all rare tokens are indexed.  This steers costs, never results.
* The number of parts follows the size of the larger set, by powers of two; a set whose partners can
  reach the next power is indexed for both.

Equal sets form one class and only one member of each goes on.  Buckets of one signature are compared
through hubs (``hubs.py``), so a group of near copies costs comparisons in proportion to its members,
and every link is confirmed on the words of the full sets.

Rules for odd input: a null text, or one without words, has an empty set and is linked with nothing; a
text of fewer words than a shingle is one token; rows that repeat an id are compared and reported one
by one, and a null id counts as no id in minima; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.llm import hubs
from vicinity.llm.common import cut_lineage, rows_among, ship_by_value, short_batches
from vicinity.llm.components import components, labels, star_round
from vicinity.llm.wordscan import U, Powers, mix

WORDS = 3
SIMILARITY_PCT = 90
#: Hashes below this are counted: a quarter of all.
COUNTED = 1 << 62
#: Least number of sets that makes a token frequent, and the most frequent tokens that tasks are told.
FREQUENT = 32
MOST_FREQUENT = 1 << 17
#: Bits of the map of repeated tokens (as powers of two; at least, at most, and some to a token between them), and
#: the most tokens that are put into it.
MAP_BITS, MOST_MAP_BITS, BITS_EACH = 26, 28, 8
MOST_REPEATED = 1 << 28


@dataclass(frozen=True)
class Frequencies:
    """What tasks know of counted tokens: a bitmap of repeated ones by their highest bits (2^n longs), whether it
    holds all of them, and the sorted frequent ones."""

    repeated: np.ndarray
    complete: bool
    frequent: np.ndarray

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        """0 for tokens not known to be repeated, 1 repeated, 2 frequent, 3 not counted."""
        counted = tokens < U(COUNTED)
        place = np.where(counted, tokens, U(0)) >> U(62 - (64 * len(self.repeated) - 1).bit_length())
        out = (self.repeated[place >> U(6)] >> (place & U(63)) & U(1)).astype(np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
            out[self.frequent[at] == tokens] = 2
        out[~counted] = 3
        return out


def _missing(n: int, similarity_pct: int) -> int:
    """The most tokens of a set of n that a similar set can lack."""
    return n - -(-similarity_pct * n // 100)


def set_rows(docs: DataFrame, id_col: str, text_col: str, n_words: int) -> DataFrame:
    """``(doc_id, text, n_shingles, digest)``: size and digest of each document's set; no digest for an empty one."""
    docs = docs.select(id_col, text_col)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType())])

    def hash_texts(batches):
        powers = Powers()
        for batch in batches:
            for lo, hi, sets in hubs.hashed_sets(batch.column(1), n_words, powers):
                digests = [None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([0 if x is None else len(x) for x in sets], pa.int64()),
                     pa.array(digests, pa.binary())], names=schema.names)

    ship_by_value()
    return docs.mapInArrow(hash_texts, schema)


def token_rows(texts: DataFrame, n_words: int) -> DataFrame:
    """``token``: the tokens with low hashes, once for each set of ``texts(text)``."""
    def low(batches):
        powers = Powers()
        for batch in batches:
            for _, _, sets in hubs.hashed_sets(batch.column(0), n_words, powers):
                tokens = [x[:np.searchsorted(x, U(COUNTED))] for x in sets if x is not None]
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64))], names=["token"])

    ship_by_value()
    return texts.select("text").mapInArrow(low, "token long")


def frequencies(tokens: DataFrame, least: int = FREQUENT, most_frequent: int = MOST_FREQUENT, most_repeated: int = MOST_REPEATED) -> Frequencies:
    """Counts over ``token``, one row for each set that has it.  A histogram of counts, in steps of an eighth of
    a power of two, tells from which count on the tokens fit into each bound."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    counts = cut_lineage(counts.withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "token-counts")
    steps = counts.groupBy("step").agg(F.count("*").alias("tokens"), F.min("n").alias("n")).orderBy(F.col("step").desc()).collect()

    def from_step(most: int, least: int) -> tuple[int, int, bool]:
        total, lowest = 0, 1 << 30
        for row in steps:
            if row["n"] < least:
                break
            if total + row["tokens"] > most:
                return lowest, total, False
            total += row["tokens"]
            lowest = row["step"]
        return lowest, total, True

    frequent_from, _, _ = from_step(most_frequent, least)
    repeated_from, told, complete = from_step(most_repeated, 2)
    map_bits = min(MOST_MAP_BITS, max(MAP_BITS, (BITS_EACH * told).bit_length()))
    frequent = counts.where(F.col("step") >= frequent_from).select("token").toArrow().column(0).to_numpy()
    place = F.shiftright("token", 62 - map_bits)
    bits = counts.where(F.col("step") >= repeated_from).groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(shiftright(token, {62 - map_bits}) & 63 as int)))").alias("bits")).toArrow()
    repeated = np.zeros(1 << (map_bits - 6), np.uint64)
    repeated[bits.column(0).to_numpy()] = bits.column(1).to_numpy().view(np.uint64)
    return Frequencies(repeated, complete, np.sort(frequent.view(np.uint64)))


def signatures(tokens: np.ndarray, known: Frequencies, similarity_pct: int = SIMILARITY_PCT) -> np.ndarray:
    """Signatures of a set, given by its sorted token hashes; none for a set that only its copies resemble."""
    n = len(tokens)
    largest = 100 * n // similarity_pct
    if largest == n:
        return np.empty(0, np.uint64)
    kind = known.classes(tokens)
    order = np.argsort(kind, kind="stable")
    tokens, often, alone = tokens[order], kind[order] == 2, (kind[order] == 0) & known.complete
    out = []
    for power in range(n.bit_length() - 1, largest.bit_length()):
        parts = max(1, (100 - similarity_pct) * (1 << power) // 100)
        part = (mix(tokens) % U(parts)).astype(np.int64)
        counts = np.ones(n, np.int64)
        first = np.unique(part[often], return_index=True)[1]
        counts[np.flatnonzero(often)[first]] = 0  # one token of each part may be shared without a signature
        size = int(np.searchsorted(np.cumsum(counts), _missing(n, similarity_pct) + 1)) + 1
        out.append(mix(tokens[:size][~(often | alone)[:size]]))
        own, mine = part[:size][often[:size]], tokens[:size][often[:size]]
        by_part = np.argsort(own, kind="stable")
        own, mine = own[by_part], mine[by_part]
        for step in range(1, len(own)):
            same = own[step:] == own[:-step]
            if not same.any():
                break
            pairs = mix(np.minimum(mine[step:], mine[:-step])[same]) * U(3) + np.maximum(mine[step:], mine[:-step])[same]
            out.append(mix(pairs ^ U(power + 1)))
    return np.unique(np.concatenate(out))


def signature_rows(texts: DataFrame, known: Frequencies, similarity_pct: int, n_words: int) -> DataFrame:
    """``(key, node)`` of ``texts(node, text)``: one row for each signature."""
    def index(batches):
        powers = Powers()
        for batch in batches:
            for lo, hi, sets in hubs.hashed_sets(batch.column(1), n_words, powers):
                keys = [signatures(x, known, similarity_pct) for x in sets]
                nodes = np.repeat(batch.column(0).slice(lo, hi - lo).to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(nodes)], names=["key", "node"])

    ship_by_value()
    return texts.select("node", "text").mapInArrow(index, "key long, node long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity_pct: int = SIMILARITY_PCT,
                       n_words: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per document: size of its set, and the smallest id that
    links of similar sets reach."""
    with short_batches(docs.sparkSession):  # all jobs with Python in them run in here
        table = set_rows(docs, id_col, text_col, n_words).withColumn("row_no", F.monotonically_increasing_id())
        table = cut_lineage(table, "token-sets")
        filled = table.where("digest is not null")
        classes = cut_lineage(filled.groupBy("digest").agg(F.min("row_no").alias("node"), F.min("doc_id").alias("first_id")), "classes")
        one_each = rows_among(filled.withColumnRenamed("row_no", "node"), classes.select("node"), "node")
        known = frequencies(token_rows(one_each, n_words))
        stars = hubs.elect(cut_lineage(signature_rows(one_each, known, similarity_pct, n_words), "signatures"))
        stars = stars.select(F.col("hub").alias("u"), F.col("node").alias("v"))
        wanted = cut_lineage(stars.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "bucket-nodes")
        texts = cut_lineage(rows_among(filled.select(F.col("row_no").alias("node"), "text"), wanted, "node"), "member-texts")

        compared = hubs.compare(stars, texts, similarity_pct, n_words, differences=True)
        links = star_round(compared.where("linked").select("u", "v"))
        compared = hubs.recentre(hubs.outsiders(compared, labels(links)), texts, similarity_pct, n_words)
        links = star_round(links.unionByName(compared.where("linked").select("u", "v")))
        across = hubs.candidates(hubs.outsiders(compared, labels(links)), texts, similarity_pct, n_words)
        more = hubs.compare(across, texts, similarity_pct, n_words).where("linked").select("u", "v")
        label = cut_lineage(components(links.unionByName(more)), "all-components")

    grouped = classes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = cut_lineage(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")), "component-names")
    grouped = grouped.join(names, "component").select("digest", "component_id")
    out = filled.select("doc_id", "n_shingles", "digest").join(grouped, "digest").drop("digest")
    return out.unionByName(table.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
