"""Operator 6, near-duplicates: MinHash bands with sequential Bayesian verification.

1. Texts with equal shingle sets form a class; only one member of each goes on.  Classes are found
   with partial minima, so thousands of copies cost no more than one row in each task.
2. MinHash signatures are cut into bands; classes that share a band's key are candidates.
3. In each bucket every member is first compared with the bucket's hub, the member that meets most
   others (a star, so the number of pairs is that of the members).  A round over the confirmed links
   labels what is connected.
4. Only members outside their hub's component are looked at again, and there only pairs that can be
   similar by their differences from the hub (``hubs.py``).
5. Every pair is verified sequentially: members of buckets get a longer signature of one-bit
   positions, and after each batch of 64 of them a pair is dropped if the posterior probability of
   the target similarity is below the miss probability.  Survivors are compared on their full shingle
   sets, and only those links count.

No pair of two texts that share a band is lost: it is linked, refuted, or already in one component.
With 32 bands of 6 values, texts of similarity 0.85 share no band with a chance of 3e-7.

Rules for odd input: a null text, or one without words, has an empty set, is linked with nothing
and is kept; a text of fewer words than a shingle is one shingle; rows that repeat an id are
compared one by one and reported one by one, and a null id counts as no id in minima; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.llm import hubs
from vicinity.llm.common import cut_lineage, ship_by_value, short_batches
from vicinity.llm.components import components, labels, star_round
from vicinity.llm.hubs import hashed_sets
from vicinity.llm.wordscan import U, Powers, mix
from vicinity.operators.broadcast import broadcast_checked

WORDS = 5
SIMILARITY_PCT = 85
BANDS = 32
BAND_ROWS = 6
#: Batches of 64 one-bit positions that a pair can be tested on.
SKETCH_WORDS = 16
#: Chance of dropping a pair of the target similarity that each Bayesian test may take.
MISS = 1e-6
#: Shingles that are hashed in one go.
_CHUNK = 256


def bayes_limits(n_batches: int, similarity: float, miss: float = MISS, batch: int = 64) -> list[int]:
    """For 1, 2, ... batches of one-bit positions: the most that may differ without being dropped.

    Positions of two sets agree with probability (1 + similarity) / 2; the prior of the similarity is
    uniform.  A pair goes once P(similarity >= target | differences so far) falls below ``miss``.
    """
    agree = np.linspace(0.5, 1.0, 5_001)[1:-1]
    wanted = agree >= (1 + similarity) / 2
    limits = []
    for n in range(batch, batch * n_batches + 1, batch):
        most = 0
        for differing in range(n + 1):
            log = (n - differing) * np.log(agree) + differing * np.log1p(-agree)
            weight = np.exp(log - log.max())
            if weight[wanted].sum() < miss * weight.sum():
                break
            most = differing
        limits.append(most)
    return limits


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def _signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        np.minimum(least, np.multiply.outer(multipliers, shingles[at:at + _CHUNK]).min(axis=1), out=least)
    return least


class _Bands:
    """Band keys of a set of shingle hashes."""

    def __init__(self, bands: int, rows: int) -> None:
        self._shape = bands, rows
        self._multipliers, self._weights = _multipliers(bands * rows), _multipliers(rows + 1)[1:]
        self._salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        least = _signature(shingles, self._multipliers).reshape(self._shape)
        return mix((least * self._weights).sum(axis=1, dtype=np.uint64) ^ mix(self._salt)).view(np.int64)


def shingle_rows(docs: DataFrame, id_col: str, text_col: str, n_words: int = WORDS, bands: int = BANDS, rows: int = BAND_ROWS,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, text, n_shingles, digest, bands)``; no digest and no bands for an empty set.  The
    columns ``keep`` come along as the fields of ``others``."""
    docs = docs.select(id_col, text_col, *([F.struct(*(F.col(c) for c in keep)).alias("others")] if keep else []))
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text", T.StringType()),
        T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
        *docs.schema.fields[2:]])

    def hash_texts(batches):
        powers, in_bands = Powers(), _Bands(bands, rows)
        for batch in batches:
            for lo, hi, sets in hashed_sets(batch.column(1), n_words, powers):
                digests = [None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                keys = [None if x is None else in_bands.keys(x) for x in sets]
                counts = [0 if x is None else len(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(counts, pa.int64()),
                     pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *(c.slice(lo, hi - lo) for c in batch.columns[2:])],
                    names=schema.names)

    ship_by_value()
    return docs.mapInArrow(hash_texts, schema)


def sketch_rows(texts: DataFrame, n_words: int = WORDS, bands: int = BANDS, rows: int = BAND_ROWS, sketch_words: int = SKETCH_WORDS) -> DataFrame:
    """``(node, n, bands, sketch)`` of ``texts(node, text)``: set size, band keys, and one-bit MinHash
    positions, by 64 in a long, of hash functions other than the bands'."""

    def sketch(batches):
        powers, in_bands = Powers(), _Bands(bands, rows)
        multipliers = _multipliers(bands * rows + 64 * sketch_words)[bands * rows:]
        for batch in batches:
            for lo, hi, sets in hashed_sets(batch.column(1), n_words, powers):
                bits = [np.packbits((mix(_signature(x, multipliers)) & U(1)).astype(bool)).view(np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()),
                     pa.array([in_bands.keys(x) for x in sets], pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    names=["node", "n", "bands", "sketch"])

    ship_by_value()
    return texts.select("node", "text").mapInArrow(sketch, "node long, n long, bands array<long>, sketch array<long>")


def _passes(limits: list[int], similarity_pct: int) -> str:
    """The sequential test of sketches a and b as a condition: sizes first, then batch after batch,
    each counted only if those before it passed."""
    tests = [f"100 * least(na, nb) >= {similarity_pct} * greatest(na, nb)"]
    for n, most in enumerate(limits, 1):
        tests.append(" + ".join(f"bit_count(a[{i}] ^ b[{i}])" for i in range(n)) + f" <= {most}")
    return " and ".join(f"({t})" for t in tests)


def _grouped(docs: DataFrame, id_col: str, text_col: str, similarity_pct: int = SIMILARITY_PCT, n_words: int = WORDS, bands: int = BANDS,
             band_rows: int = BAND_ROWS, sketch_words: int = SKETCH_WORDS, miss: float = MISS,
             keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The written shingle rows with a ``row_no``, and the component of each class of them:
    ``(digest, component, component_id)``, named by the smallest id in it."""
    passes = _passes(bayes_limits(sketch_words, similarity_pct / 100, miss), similarity_pct)
    with short_batches(docs.sparkSession):  # all jobs with Python in them run in here
        table = shingle_rows(docs, id_col, text_col, n_words, bands, band_rows, keep).withColumn("row_no", F.monotonically_increasing_id())
        table = cut_lineage(table, "shingles")
        filled = table.where("digest is not null")
        classes = cut_lineage(filled.groupBy("digest").agg(F.min("row_no").alias("node"), F.min("doc_id").alias("first_id")), "classes")
        one_each = cut_lineage(
            filled.join(classes.select(F.col("node").alias("row_no")), "row_no", "left_semi").select(
                F.col("row_no").alias("node"), "bands"), "class-signatures")
        stars = hubs.elect(one_each.select("node", F.explode("bands").alias("key"))).select(F.col("hub").alias("u"), F.col("node").alias("v"))
        nodes = cut_lineage(stars.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "bucket-nodes")
        wanted, _ = broadcast_checked(nodes, 1)
        texts = cut_lineage(table.select(F.col("row_no").alias("node"), "text").join(wanted, "node", "left_semi"), "member-texts")
        sketches = cut_lineage(sketch_rows(texts, n_words, bands, band_rows, sketch_words), "sketches")
        a = sketches.select(F.col("node").alias("u"), F.col("sketch").alias("a"), F.col("n").alias("na"))
        b = sketches.select(F.col("node").alias("v"), F.col("sketch").alias("b"), F.col("n").alias("nb"))

        tested = cut_lineage(stars.join(a, "u").join(b, "v").select("u", "v", F.expr(passes).alias("passed")), "tested-stars")
        near = hubs.compare(tested.where("passed").select("u", "v"), texts, similarity_pct, n_words, differences=True)
        links = star_round(near.where("linked").select("u", "v"))
        far = tested.where("not passed").select("u", "v", F.lit(False).alias("linked"))
        placed = cut_lineage(hubs.outsiders(near.unionByName(far, allowMissingColumns=True), labels(links)), "open-members")
        compared = hubs.recentre(placed, texts, similarity_pct, n_words)
        links = star_round(links.unionByName(compared.where("linked").select("u", "v")))
        across = hubs.candidates(hubs.outsiders(compared, labels(links)), texts, similarity_pct, n_words)
        across = across.join(a, "u").join(b, "v").where(passes).select("u", "v")
        more = hubs.compare(across, texts, similarity_pct, n_words).where("linked").select("u", "v")
        label = cut_lineage(components(links.unionByName(more)), "all-components")

    # Each class's component, named by the smallest id in it.
    grouped = classes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = cut_lineage(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")), "component-names")
    return table, cut_lineage(grouped.join(names, "component").select("digest", "component", "component_id"), "class-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity_pct: int = SIMILARITY_PCT,
                    n_words: int = WORDS, bands: int = BANDS, band_rows: int = BAND_ROWS, sketch_words: int = SKETCH_WORDS,
                    miss: float = MISS) -> DataFrame:
    """One row per document: size of its shingle set, component, and whether its id is the one kept."""
    table, named = _grouped(docs, id_col, text_col, similarity_pct, n_words, bands, band_rows, sketch_words, miss)
    out = table.where("digest is not null").select("doc_id", "n_shingles", "digest").join(named.drop("component"), "digest").select(
        "doc_id", "n_shingles", "component_id")
    alone = table.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id, a null id last,
    and of equal ids the first one written.  Rows are dropped by number, so repeated and null ids do no harm."""
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    table, named = _grouped(docs, id_col, text_col, keep=others)
    rows = table.where("digest is not null").select("doc_id", "digest", "row_no").join(named, "digest").select(
        "row_no", "component", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("smallest"))
    rows = cut_lineage(rows, "component-rows")
    first = rows.where("smallest").groupBy("component").agg(F.min("row_no").alias("row_no"))
    dropped = cut_lineage(rows.join(first, "row_no", "left_anti").select("row_no"), "dropped-rows")
    dropped, _ = broadcast_checked(dropped, 1)
    of = {id_col: F.col("doc_id"), text_col: F.col("text")}
    return table.join(dropped, "row_no", "left_anti").select(
        *((of[c] if c in of else F.col("others").getField(c)).alias(c) for c in docs.columns))
