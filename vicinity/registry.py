"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
over the driver tables.  ``ORACLES`` holds the DuckDB SQL for the same result.

Scores are rounded to 6 decimals in the output (ranking uses the unrounded
score) so that 1-ulp summation-order differences between engines vanish.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_sql as O
from vicinity.functions import metrics as M
from vicinity.functions.vectors import VEC, wide_to_vector
from vicinity.operators.topk import SCORE, null_score_last, ranked_report
from vicinity.plans.exact import QueryInfo, exact_top_k, score_all
from vicinity.sources import tables as T
from vicinity.sources.generate import uniform_like
from vicinity.sources.queries import Q, QID, queries_by_id, seeded_query
from vicinity.sources.store import load_or_materialise
from vicinity.session import scratch_path

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

SHORT = {"cosine": "cosine", "euclidean_sim": "euclidean", "manhattan_sim": "manhattan",
         "dot_product": "dot"}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def round_sig(c, digits: int = 8) -> F.Column:
    """Round to ``digits`` significant digits: dot scores are unbounded, so a
    fixed number of decimals cannot absorb relative rounding noise."""
    c = F.col(c) if isinstance(c, str) else c
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))))
    special = (c == 0) | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(c.isNull() | special, c).otherwise(F.round(c / p, digits - 1) * p)


def round_scores(df: DataFrame, col: str = SCORE, metric: str = "cosine") -> DataFrame:
    return df.withColumn(col, round_sig(col) if metric == "dot_product" else r6(col))


def min_id_query(table: DataFrame, id_col: str) -> DataFrame:
    """The row with the smallest id as a one-row query table (data-derived)."""
    lo = table.agg(F.min(id_col).alias("_lo"))
    # ``lo`` is a one-row global aggregate
    return (table.join(F.broadcast(lo), F.col(id_col) == F.col("_lo"))
            .select(F.col(id_col).alias(QID), F.col(VEC).alias(Q)))


def per_label_queries(spark: SparkSession, sf_dir: str, table: DataFrame) -> DataFrame:
    """One query per label: the row with the smallest vec_id of each label."""
    e = T.read_table(spark, sf_dir, "embeddings")
    firsts = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    # one row per label: size depends on the data, so the planner chooses the join
    return table.join(firsts.select("vec_id"), "vec_id").select(
        F.col("vec_id").alias(QID), F.col(VEC).alias(Q))


# ---------------------------------------------------------------- sources

register("scan_vectors", f"SELECT vec_id, vec FROM ({O.EMB})")(
    lambda spark, d: T.embeddings(spark, d))


@register("wide_to_vector",
          "SELECT l_orderkey, l_linenumber, [l_quantity, l_extendedprice, l_discount, l_tax] AS vec "
          "FROM lineitem")
def _wide_to_vector(spark: SparkSession, d: str) -> DataFrame:
    return wide_to_vector(T.read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"],
                          ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@register("materialise_roundtrip", f"SELECT l_orderkey, vec FROM ({O.ORDER_VEC})")
def _materialise(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "order_vec_" + d.rstrip("/").replace("/", "_"))
    return load_or_materialise(spark, path, lambda: T.order_vectors(spark, d), ["l_orderkey", VEC], force=True)


@register("materialise_reuse", f"SELECT l_orderkey, vec FROM ({O.ORDER_VEC})")
def _materialise_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Written once; the second call finds it and does not build (it would build nothing)."""
    path = scratch_path(spark, "order_vec_reuse_" + d.rstrip("/").replace("/", "_"))
    cols = ["l_orderkey", VEC]
    load_or_materialise(spark, path, lambda: T.order_vectors(spark, d), cols, force=True)
    return load_or_materialise(spark, path, lambda: T.order_vectors(spark, d).limit(0), cols)


@register("uniform_vectors", "SELECT vec_id, len(embedding)::INTEGER AS n, true AS in_range FROM embeddings")
def _uniform(spark: SparkSession, d: str) -> DataFrame:
    """Random vectors for the table's ids, as wide as its own: what holds of them whatever the numbers."""
    t = T.embeddings(spark, d)
    width = t.agg(F.max(F.size(VEC))).first()[0]
    u = uniform_like(t, "vec_id", width)
    return u.select("vec_id", F.size(VEC).alias("n"), F.forall(VEC, lambda x: (x >= 0) & (x < 1)).alias("in_range"))


@register("query_constant", O.exact_topk_sql(
    O.EMB, "vec_id",
    "SELECT 0::BIGINT AS query_id, list_transform(range((SELECT max(len(embedding)) FROM embeddings)), "
    "lambda i: 0.5) AS q", "cosine", 10))
def _query_constant(spark: SparkSession, d: str) -> DataFrame:
    t = T.embeddings(spark, d)
    q = t.agg(F.max(F.size(VEC)).alias("_k")).select(
        F.lit(0).cast("long").alias(QID), F.array_repeat(F.lit(0.5), F.col("_k")).alias(Q))
    return round_scores(exact_top_k(t, q, "cosine", 10, "vec_id", info=QueryInfo(1, 0)))


_SEEDED = ", ".join(repr(float(x)) for x in np.random.RandomState(42).rand(64))


@register("query_seeded", O.exact_topk_sql(
    O.EMB, "vec_id", f"SELECT 0::BIGINT AS query_id, CAST([{_SEEDED}] AS DOUBLE[]) AS q", "manhattan_sim", 10))
def _query_seeded(spark: SparkSession, d: str) -> DataFrame:
    t = T.embeddings(spark, d)
    return round_scores(exact_top_k(t, seeded_query(spark, 64, 42), "manhattan_sim", 10, "vec_id", info=QueryInfo(1, 64)))


@register("count_vectors", f"SELECT count(*) AS n FROM ({O.ORDER_VEC})")
def _count(spark: SparkSession, d: str) -> DataFrame:
    return T.order_vectors(spark, d).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- scalar metrics

_MIN_ORDER_Q = (f"SELECT l_orderkey AS query_id, vec AS q FROM ({O.ORDER_VEC}) "
                f"WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)")


def _score_orders(metric: str) -> QueryFn:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        t = T.order_vectors(spark, d)
        s = score_all(t, min_id_query(t, "l_orderkey"), metric, "l_orderkey", info=QueryInfo(1, 4))
        return round_scores(s.select("l_orderkey", SCORE), metric=metric)
    return fn


for _m in M.METRIC_NAMES:
    register(f"score_{SHORT[_m]}",
             f"SELECT t.l_orderkey, {O.rscore(_m, O.metric(_m, 't.vec', 'qq.q'))} AS similarity_score "
             f"FROM ({O.ORDER_VEC}) t CROSS JOIN ({_MIN_ORDER_Q}) qq")(_score_orders(_m))


_MIN_PART_Q = (f"SELECT p_partkey AS query_id, vec AS q FROM ({O.PART_VEC}) "
               f"WHERE p_partkey = (SELECT min(p_partkey) FROM part)")


@register("metric_dispatch", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, t.p_partkey, {O.r6(O.metric(m, 't.vec', 'qq.q'))} AS similarity_score "
    f"FROM ({O.PART_VEC}) t CROSS JOIN ({_MIN_PART_Q}) qq" for m in M.METRIC_NAMES))
def _dispatch(spark: SparkSession, d: str) -> DataFrame:
    t = T.part_vectors(spark, d)
    q = min_id_query(t, "p_partkey")
    parts = [score_all(t, q, m, "p_partkey", info=QueryInfo(1, 2))
             .select(F.lit(m).alias("metric"), "p_partkey", r6(SCORE).alias(SCORE))
             for m in M.METRIC_NAMES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("vector_norm", f"SELECT vec_id, {O.r6(O.norm('vec'))} AS norm FROM ({O.SCALED_EMB})")
def _norm(spark: SparkSession, d: str) -> DataFrame:
    return T.scaled_embeddings(spark, d).select("vec_id", r6(M.norm(VEC)).alias("norm"))


# NaN features: parts larger than size 45 carry a NaN price element.
_NAN_PART = ("SELECT p_partkey, [CAST(p_size AS DOUBLE), CASE WHEN p_size > 45 THEN 'NaN'::DOUBLE "
             "ELSE p_retailprice END] AS vec FROM part")


def _nan_parts(spark: SparkSession, d: str) -> DataFrame:
    p = T.read_table(spark, d, "part")
    return p.select("p_partkey", F.array(
        F.col("p_size").cast("double"),
        F.when(F.col("p_size") > 45, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))).alias(VEC))


def _nan_part_scores(metric: str) -> QueryFn:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        t = _nan_parts(spark, d)
        q = min_id_query(T.part_vectors(spark, d), "p_partkey")
        s = score_all(t, q, metric, "p_partkey", info=QueryInfo(1, 2))
        return round_scores(s.filter(M.is_valid_score(SCORE)).select("p_partkey", SCORE))
    return fn


register("nan_score_filter",
         f"SELECT p_partkey, similarity_score FROM (SELECT t.p_partkey, "
         f"{O.r6(O.metric('euclidean_sim', 't.vec', 'qq.q'))} AS similarity_score "
         f"FROM ({_NAN_PART}) t CROSS JOIN ({_MIN_PART_Q}) qq) WHERE NOT isnan(similarity_score)")(
    _nan_part_scores("euclidean_sim"))

_NAN_COS = ("CASE WHEN list_bool_or(list_transform(t.vec, lambda x: isnan(x))) THEN 0.0 ELSE "
            + O.metric("cosine", "t.vec", "qq.q") + " END")
register("nan_cosine_zero",
         f"SELECT t.p_partkey, {O.r6(_NAN_COS)} AS similarity_score "
         f"FROM ({_NAN_PART}) t CROSS JOIN ({_MIN_PART_Q}) qq")(_nan_part_scores("cosine"))


@register("null_score_last",
          "SELECT p.p_partkey, coalesce(s.sold, '-inf'::DOUBLE) AS similarity_score FROM part p "
          "LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS sold FROM lineitem GROUP BY l_partkey) s "
          "ON p.p_partkey = s.l_partkey")
def _null_last(spark: SparkSession, d: str) -> DataFrame:
    p = T.read_table(spark, d, "part").select("p_partkey")
    sold = T.read_table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias(SCORE))
    j = p.join(sold, p.p_partkey == sold.l_partkey, "left")
    return j.select("p_partkey", null_score_last(SCORE).alias(SCORE))


# ---------------------------------------------------------------- exact top-k

_Q0 = f"SELECT vec_id AS query_id, vec AS q FROM ({O.EMB}) WHERE vec_id = 0"
_LABEL_Q = (f"SELECT t.vec_id AS query_id, t.vec AS q FROM ({O.SCALED_EMB}) t "
            f"JOIN (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY label) f ON t.vec_id = f.vec_id")


def flagship(spark: SparkSession, d: str, metric: str = "cosine", k: int = 5) -> DataFrame:
    """Exact top-k over ``embeddings`` for the query row ``vec_id = 0``."""
    t = T.embeddings(spark, d)
    return round_scores(exact_top_k(t, queries_by_id(t, "vec_id", 0), metric, k, "vec_id",
                                    info=QueryInfo(1, 64)), metric=metric)


def _topk_abs(metric: str) -> QueryFn:
    return lambda spark, d: flagship(spark, d, metric, 10)


def _topk_multi(metric: str) -> QueryFn:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        t = T.scaled_embeddings(spark, d)
        q = per_label_queries(spark, d, t)
        return round_scores(exact_top_k(t, q, metric, 10, "vec_id"), metric=metric)
    return fn


def _topk_orders(metric: str) -> QueryFn:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        t = T.order_vectors(spark, d)
        return round_scores(exact_top_k(t, min_id_query(t, "l_orderkey"), metric, 10, "l_orderkey",
                                        info=QueryInfo(1, 4)), metric=metric)
    return fn


for _m in M.METRIC_NAMES:
    _s = SHORT[_m]
    register(f"topk_absolute_{_s}", O.exact_topk_sql(O.EMB, "vec_id", _Q0, _m, 10))(_topk_abs(_m))
    register(f"topk_multi_{_s}", O.exact_topk_sql(O.SCALED_EMB, "vec_id", _LABEL_Q, _m, 10))(_topk_multi(_m))
    register(f"topk_orders_{_s}", O.exact_topk_sql(O.ORDER_VEC, "l_orderkey", _MIN_ORDER_Q, _m, 10))(
        _topk_orders(_m))


USER_METRIC = M.register_metric("neg_sq_l2", lambda a, b: f"(0D - {M.sq_distance_sql(a, b)})")
register("topk_user_metric", O.exact_topk_sql(O.SCALED_EMB, "vec_id", _LABEL_Q, USER_METRIC, 10))(_topk_multi(USER_METRIC))

_TEN_ORDERS = f"SELECT l_orderkey AS query_id, vec AS q FROM ({O.ORDER_VEC}) ORDER BY l_orderkey LIMIT 10"


@register("topk_large_k_multi", O.exact_topk_sql(O.ORDER_VEC, "l_orderkey", _TEN_ORDERS, "euclidean_sim", 1500))
def _large_k(spark: SparkSession, d: str) -> DataFrame:
    """Ten queries (the orders of the ten smallest keys), 1,500 results each."""
    t = T.order_vectors(spark, d)
    q = t.orderBy("l_orderkey").limit(10).select(F.col("l_orderkey").alias(QID), F.col(VEC).alias(Q))
    return round_scores(exact_top_k(t, q, "euclidean_sim", 1500, "l_orderkey"))


@register("ranked_report",
          "SELECT query_id, rank, vec_id, similarity_score, printf('%.4f', similarity_score) AS score_text "
          "FROM (" + O.exact_topk_sql(O.EMB, "vec_id", _Q0, "cosine", 5) + ")")
def _report(spark: SparkSession, d: str) -> DataFrame:
    return ranked_report(flagship(spark, d))


# ---------------------------------------------------------------- sampling, centers, references

from vicinity.operators.centers import CENTER, mean_vector, median_vector  # noqa: E402
from vicinity.operators.references import REF_NO, nearest_to  # noqa: E402
from vicinity.operators.sampling import bernoulli_sample, hash_sample  # noqa: E402
from vicinity.plans.transform import (SIMS, TransformParams,  # noqa: E402
                                      query_to_similarity_space, select_references,
                                      to_similarity_space, transform_top_k)
from vicinity.functions.vectors import vector_to_wide  # noqa: E402

# Build parameters sized for the 500-row fixture.
TP = TransformParams(n_refs=8, sample_size=200, seed=42)
_Q7 = f"SELECT vec_id AS query_id, vec AS q FROM ({O.EMB}) WHERE vec_id = 7"


def r6_list(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(c, lambda x: F.round(x, 6))


@register("hash_sample", f"SELECT vec_id FROM ({O.hash_sample_sql(O.EMB, 'vec_id', 200, 42)})")
def _hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return hash_sample(T.embeddings(spark, d), "vec_id", 200, 42).select("vec_id")


@register("bernoulli_sample", "SELECT true AS known_ids, true AS no_repeats, true AS plausible_size")
def _bernoulli(spark: SparkSession, d: str) -> DataFrame:
    """What holds of any sample of about 240 rows: its ids are the table's, without
    repeats, and its size is within six standard deviations."""
    t = T.embeddings(spark, d)
    n = t.count()
    s = bernoulli_sample(t, 200, n, 42).select("vec_id")
    known = t.select("vec_id", F.lit(1).alias("known"))
    p = min(1.0, 240 / n)
    six = 6 * (n * p * (1 - p)) ** 0.5
    return s.join(known, "vec_id", "left").agg(
        (F.count("known") == F.count("*")).alias("known_ids"), (F.countDistinct("vec_id") == F.count("*")).alias("no_repeats"),
        F.count("*").between(n * p - six, n * p + six).alias("plausible_size"))


@register("center_mean", "SELECT label, " + O.round_list("center") + " AS center FROM (" + O.mean_vector_sql(
    "SELECT label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings", group=["label"]) + ")")
def _center_mean(spark: SparkSession, d: str) -> DataFrame:
    e = T.read_table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias(VEC))
    return mean_vector(e, VEC, ["label"]).select("label", r6_list(CENTER).alias(CENTER))


@register("center_median", "SELECT " + O.round_list("center") + " AS center FROM (" + O.median_vector_sql(O.EMB) + ")")
def _center_median(spark: SparkSession, d: str) -> DataFrame:
    return median_vector(T.embeddings(spark, d)).select(r6_list(CENTER).alias(CENTER))


@register("nearest_to_center", f"""
SELECT vec_id, {O.r6('score')} AS similarity_score FROM (
  SELECT t.vec_id, {O.metric('cosine', 't.vec', 'c.center')} AS score
  FROM ({O.SCALED_EMB}) t, ({O.mean_vector_sql(O.SCALED_EMB)}) c
  ORDER BY score DESC, t.vec_id LIMIT 1)""")
def _nearest_center(spark: SparkSession, d: str) -> DataFrame:
    t = T.scaled_embeddings(spark, d)
    s = nearest_to(t, mean_vector(t), CENTER, "cosine", "vec_id").withColumnRenamed("_score", SCORE)
    from vicinity.operators.topk import top_k
    return round_scores(top_k(s, 1, "vec_id", by=None).select("vec_id", SCORE))


def _refs(metric: str, use_median: bool = False) -> QueryFn:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        p = TransformParams(TP.n_refs, TP.sample_size, TP.seed, use_median)
        return select_references(T.embeddings(spark, d), "vec_id", metric, p).select(REF_NO, "vec_id")
    return fn


def _refs_sql(metric: str, use_median: bool = False) -> str:
    return ("WITH RECURSIVE " + O.references_ctes(O.EMB, "vec_id", metric, TP.n_refs, TP.sample_size,
                                                  TP.seed, use_median)
            + " SELECT ref_no, id AS vec_id FROM refs")


register("diverse_references", _refs_sql("cosine"))(_refs("cosine"))
register("diverse_references_median", _refs_sql("cosine", True))(_refs("cosine", True))
register("diverse_references_manhattan", _refs_sql("manhattan_sim"))(_refs("manhattan_sim"))


def _space(spark: SparkSession, d: str, metric: str = "cosine") -> DataFrame:
    t = T.embeddings(spark, d)
    return to_similarity_space(t, select_references(t, "vec_id", metric, TP), metric, "vec_id")


@register("similarity_space", "WITH RECURSIVE " + O.references_ctes(O.EMB, "vec_id", "cosine", TP.n_refs,
                                                                      TP.sample_size, TP.seed)
          + O.space_ctes("vec_id", "cosine", _Q7) + f" SELECT id AS vec_id, {O.round_list('sims')} AS sims FROM space")
def _sim_space(spark: SparkSession, d: str) -> DataFrame:
    return _space(spark, d).select("vec_id", r6_list(SIMS).alias(SIMS))


@register("similarity_space_wide", "WITH RECURSIVE " + O.references_ctes(
    O.EMB, "vec_id", "euclidean_sim", TP.n_refs, TP.sample_size, TP.seed)
    + O.space_ctes("vec_id", "euclidean_sim", _Q7) + " SELECT id AS vec_id, "
    + ", ".join(f"round(sims[{i + 1}], 6) AS sim_to_ref_{i}" for i in range(TP.n_refs)) + " FROM space")
def _sim_space_wide(spark: SparkSession, d: str) -> DataFrame:
    w = vector_to_wide(_space(spark, d, "euclidean_sim"), "vec_id", SIMS, TP.n_refs, "sim_to_ref_")
    return w.select("vec_id", *[r6(c).alias(c) for c in w.columns if c != "vec_id"])


@register("query_in_similarity_space", "WITH RECURSIVE " + O.references_ctes(
    O.EMB, "vec_id", "dot_product", TP.n_refs, TP.sample_size, TP.seed)
    + O.space_ctes("vec_id", "dot_product", _Q7) + f" SELECT query_id, {O.round_list('q')} AS q FROM qspace")
def _q_space(spark: SparkSession, d: str) -> DataFrame:
    t = T.embeddings(spark, d)
    refs = select_references(t, "vec_id", "dot_product", TP)
    qs = query_to_similarity_space(queries_by_id(t, "vec_id", 7), refs, "dot_product")
    return qs.select(QID, r6_list(Q).alias(Q))


def _topk_transform(metric: str) -> QueryFn:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        t = T.embeddings(spark, d)
        r = transform_top_k(t, queries_by_id(t, "vec_id", 7), metric, 10, "vec_id", TP, one_query=True)
        return round_scores(r, metric=metric)
    return fn


for _m in M.METRIC_NAMES:
    register(f"topk_transform_{SHORT[_m]}",
             O.transform_topk_sql(O.EMB, "vec_id", _Q7, _m, 10, TP.n_refs, TP.sample_size, TP.seed))(
        _topk_transform(_m))


def _topk_transform_on(source: Callable[[SparkSession, str], DataFrame], id_col: str, metric: str) -> QueryFn:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        t = source(spark, d)
        r = transform_top_k(t, min_id_query(t, id_col), metric, 10, id_col, TP, one_query=True)
        return round_scores(r, metric=metric)
    return fn


# Vectors of unequal length, on which the metrics rank differently.
_MIN_SCALED_Q = f"SELECT vec_id AS query_id, vec AS q FROM ({O.SCALED_EMB}) WHERE vec_id = (SELECT min(vec_id) FROM embeddings)"
for _m in M.METRIC_NAMES:
    register(f"topk_transform_scaled_{SHORT[_m]}",
             O.transform_topk_sql(O.SCALED_EMB, "vec_id", _MIN_SCALED_Q, _m, 10, TP.n_refs, TP.sample_size, TP.seed))(
        _topk_transform_on(T.scaled_embeddings, "vec_id", _m))
register("topk_transform_orders_manhattan",
         O.transform_topk_sql(O.ORDER_VEC, "l_orderkey", _MIN_ORDER_Q, "manhattan_sim", 10, TP.n_refs, TP.sample_size, TP.seed))(
    _topk_transform_on(T.order_vectors, "l_orderkey", "manhattan_sim"))


# ---------------------------------------------------------------- forest index

import hashlib  # noqa: E402
import time  # noqa: E402
import uuid  # noqa: E402

from vicinity.plans import forest as FO  # noqa: E402
from vicinity.plans import modes  # noqa: E402

FP = FO.ForestParams(shards=2, k=3, max_depth=2, min_leaf=20, iterations=3, seed=42)
FP_ONE = FO.ForestParams(shards=2, k=3, max_depth=1, min_leaf=20, iterations=3, seed=42)


def forest_for(spark: SparkSession, d: str, metric: str, fp: FO.ForestParams = FP) -> FO.Forest:
    """Load the stored index for (table, metric, params), building it if absent or stale."""
    key = hashlib.md5(f"{d}|{fp}|{FO.FORMAT}".encode()).hexdigest()[:16]
    return FO.load_or_build_forest(T.embeddings(spark, d), "vec_id", metric, fp,
                                   scratch_path(spark, f"forest-{key}"))


def _fsql(metric: str, fp: FO.ForestParams = FP, query_sql: str = _Q7) -> str:
    return O.forest_all_ctes(O.EMB, "vec_id", metric, query_sql, fp)


_LABEL_Q_EMB = (f"SELECT t.vec_id AS query_id, t.vec AS q FROM ({O.EMB}) t "
                f"JOIN (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY label) f ON t.vec_id = f.vec_id")


@register("shard_assign", "SELECT l_orderkey, CAST((('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8))"
                          "::BIGINT % 8) AS INTEGER) AS shard FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def _shard_assign(spark: SparkSession, d: str) -> DataFrame:
    keys = T.read_table(spark, d, "lineitem").select("l_orderkey").distinct()
    return keys.select("l_orderkey", FO.shard_of("l_orderkey", 8).alias(FO.SHARD))


@register("kmeans_one_level", _fsql("cosine", FP_ONE) + " SELECT shard, leaf_id, id AS vec_id FROM members")
def _kmeans_one(spark: SparkSession, d: str) -> DataFrame:
    f = forest_for(spark, d, "cosine", FP_ONE)
    return f.members.select(FO.SHARD, FO.LEAF, "vec_id")


# Seeds drawn by distance, at both levels.
FP_SPREAD = FO.ForestParams(shards=2, k=4, max_depth=2, min_leaf=20, iterations=2, seed=11, seeding="spread")


@register("kmeans_spread_seeds", _fsql("cosine", FP_SPREAD) + " SELECT shard, leaf_id, id AS vec_id FROM members")
def _kmeans_spread(spark: SparkSession, d: str) -> DataFrame:
    return forest_for(spark, d, "cosine", FP_SPREAD).members.select(FO.SHARD, FO.LEAF, "vec_id")


# Mini-batches with three starts: nodes of many batches and, below, of a single one.
FP_BATCH = FO.ForestParams(shards=2, k=4, max_depth=2, min_leaf=20, seed=5, batch_size=64, batch_steps=6, starts=3)
FP_BATCH_SPREAD = FO.ForestParams(shards=2, k=3, max_depth=1, min_leaf=20, seed=8, seeding="spread", batch_size=50, batch_steps=4, starts=2)


def _members_of(fp: FO.ForestParams):
    return lambda spark, d: forest_for(spark, d, "cosine", fp).members.select(FO.SHARD, FO.LEAF, "vec_id")


# The same clusters with the sums taken in Arrow tasks.
FP_BATCH_ARROW = FO.ForestParams(shards=2, k=4, max_depth=2, min_leaf=20, seed=6, batch_size=64, batch_steps=5, starts=3, engine="arrow")
FP_ARROW = FO.ForestParams(shards=2, k=4, max_depth=2, min_leaf=20, iterations=3, seed=9, engine="arrow")

for _name, _fp in (("kmeans_minibatch", FP_BATCH), ("kmeans_minibatch_spread", FP_BATCH_SPREAD),
                   ("kmeans_minibatch_arrow", FP_BATCH_ARROW), ("kmeans_arrow", FP_ARROW)):
    register(_name, _fsql("cosine", _fp) + " SELECT shard, leaf_id, id AS vec_id FROM members")(_members_of(_fp))


# The shipped limit of iterations: the build stops by itself, where every row is nearest to its own cluster's mean.
FP_CONVERGED = FO.ForestParams(shards=2, k=3, max_depth=1, min_leaf=20, seeding="spread")


@register("kmeans_converged", "SELECT CAST((('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT % 2) AS INTEGER) AS shard, "
          f"count(*) AS n_rows, CAST(0 AS BIGINT) AS n_misplaced FROM ({O.EMB}) GROUP BY 1")
def _kmeans_converged(spark: SparkSession, d: str) -> DataFrame:
    members = forest_for(spark, d, "cosine", FP_CONVERGED).members
    means = mean_vector(members, VEC, [FO.SHARD, FO.LEAF]).groupBy(FO.SHARD).agg(
        F.collect_list(F.struct(FO.LEAF, F.col(CENTER).alias("c"))).alias("means"))
    # At most k means a shard.
    away = F.expr(f"transform(means, m -> named_struct('own', m.{FO.LEAF} = {FO.LEAF}, 'd', {M.sq_distance_sql(VEC, 'm.c')}))")
    placed = members.join(F.broadcast(means), FO.SHARD).select(FO.SHARD, away.alias("away"))
    misplaced = F.expr("array_min(transform(filter(away, a -> a.own), a -> a.d)) > "
                       "array_min(transform(away, a -> a.d)) * (1 + 1e-9) + 1e-12")
    return placed.groupBy(FO.SHARD).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(misplaced.cast("long")).alias("n_misplaced"))


_NODE_COLS = [FO.SHARD, FO.NODE, FO.PARENT, FO.CHILD, FO.DEPTH, FO.IS_LEAF, FO.COUNT, FO.REP_ID]


@register("tree_nodes", _fsql("cosine") + " SELECT " + ", ".join(_NODE_COLS) + " FROM nodes")
def _tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return forest_for(spark, d, "cosine").nodes.select(*_NODE_COLS)


@register("node_counts", _fsql("cosine") + " SELECT shard, node_id, member_count FROM nodes")
def _node_counts(spark: SparkSession, d: str) -> DataFrame:
    return forest_for(spark, d, "cosine").nodes.select(FO.SHARD, FO.NODE, FO.COUNT)


@register("leaf_members", _fsql("cosine") + " SELECT shard, leaf_id, id AS vec_id FROM members")
def _leaf_members(spark: SparkSession, d: str) -> DataFrame:
    return forest_for(spark, d, "cosine").members.select(FO.SHARD, FO.LEAF, "vec_id")


@register("cluster_representatives", _fsql("euclidean_sim")
          + " SELECT shard, node_id, rep_id FROM nodes WHERE rep_id IS NOT NULL")
def _reps(spark: SparkSession, d: str) -> DataFrame:
    n = forest_for(spark, d, "euclidean_sim").nodes
    return n.filter(F.col(FO.REP_ID).isNotNull()).select(FO.SHARD, FO.NODE, FO.REP_ID)


@register("forest_invariants", _fsql("cosine") + """
 SELECT p.shard, p.node_id, p.member_count, CAST(sum(c.member_count) AS BIGINT) AS children_total
 FROM nodes p JOIN nodes c ON c.shard = p.shard AND c.parent_id = p.node_id
 GROUP BY p.shard, p.node_id, p.member_count""")
def _invariants(spark: SparkSession, d: str) -> DataFrame:
    n = forest_for(spark, d, "cosine").nodes
    kids = n.filter(F.col(FO.PARENT).isNotNull()).groupBy(FO.SHARD, F.col(FO.PARENT).alias(FO.NODE)).agg(
        F.sum(FO.COUNT).cast("long").alias("children_total"))
    return n.select(FO.SHARD, FO.NODE, FO.COUNT).join(kids, [FO.SHARD, FO.NODE])


@register("forest_descent", _fsql("cosine", FP, _LABEL_Q_EMB)
          + " SELECT query_id, shard, node_id AS leaf_id FROM f" + str(FP.max_depth))
def _descent(spark: SparkSession, d: str) -> DataFrame:
    f = forest_for(spark, d, "cosine")
    q = per_label_queries(spark, d, T.embeddings(spark, d))
    return FO.descend(f, q, "cosine").select(QID, FO.SHARD, FO.LEAF)


@register("leaf_scan", _fsql("cosine") + f"""
 SELECT h.query_id, m.id AS vec_id, {O.r6(O.metric('cosine', 'm.vec', 'h.q'))} AS similarity_score
 FROM members m JOIN hits h ON m.shard = h.shard AND m.leaf_id = h.leaf_id""")
def _leaf_scan(spark: SparkSession, d: str) -> DataFrame:
    f = forest_for(spark, d, "cosine")
    t = T.embeddings(spark, d)
    s = FO.leaf_scores(f, queries_by_id(t, "vec_id", 7), "cosine", QueryInfo(1, 64))
    return round_scores(s.select(QID, "vec_id", SCORE))


def _topk_forest(metric: str, multi: bool = False) -> QueryFn:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        f = forest_for(spark, d, metric)
        t = T.embeddings(spark, d)
        q = per_label_queries(spark, d, t) if multi else queries_by_id(t, "vec_id", 7)
        r = FO.forest_top_k(f, q, metric, 10, None if multi else QueryInfo(1, 64))
        return round_scores(r, metric=metric)
    return fn


for _m in M.METRIC_NAMES:
    register(f"topk_forest_{SHORT[_m]}", O.forest_topk_sql(O.EMB, "vec_id", _Q7, _m, 10, FP))(_topk_forest(_m))
register("topk_forest_multi_cosine", O.forest_topk_sql(O.EMB, "vec_id", _LABEL_Q_EMB, "cosine", 10, FP))(
    _topk_forest("cosine", True))


BEST_LEAVES = 7


@register("topk_forest_best_first", O.forest_topk_sql(O.EMB, "vec_id", _LABEL_Q_EMB, "euclidean_sim", 10, FP, n_leaves=BEST_LEAVES))
def _topk_best_first(spark: SparkSession, d: str) -> DataFrame:
    f = forest_for(spark, d, "euclidean_sim")
    q = per_label_queries(spark, d, T.embeddings(spark, d))
    return round_scores(FO.forest_top_k(f, q, "euclidean_sim", 10, n_leaves=BEST_LEAVES))


@register("forest_best_first_leaves", _fsql("cosine", FP, _LABEL_Q_EMB).split(",\nqs AS")[0] + ",\n"
          + O.best_first_ctes(_LABEL_Q_EMB, "cosine", FP.max_depth, BEST_LEAVES)
          + f" SELECT query_id, shard, node_id AS leaf_id, round(loss, 6) AS loss FROM f{FP.max_depth}")
def _best_first_leaves(spark: SparkSession, d: str) -> DataFrame:
    f = forest_for(spark, d, "cosine")
    q = per_label_queries(spark, d, T.embeddings(spark, d))
    leaves = FO.descend_best_first(f, q, "cosine", BEST_LEAVES)
    return leaves.select(QID, FO.SHARD, FO.LEAF, r6(FO.LOSS).alias(FO.LOSS))


@register("forest_rows_read", O.forest_all_ctes(O.EMB, "vec_id", "euclidean_sim", _LABEL_Q_EMB, FP, n_leaves=BEST_LEAVES) + """
SELECT h.query_id, count(DISTINCT (h.shard, h.leaf_id)) AS leaves, count(*) AS rows,
       round(count(*) / (SELECT count(*) FROM members), 6) AS share
FROM hits h JOIN members m ON m.shard = h.shard AND m.leaf_id = h.leaf_id WHERE h.leaf_id <> 'invalid' GROUP BY h.query_id""")
def _forest_rows_read(spark: SparkSession, d: str) -> DataFrame:
    f = forest_for(spark, d, "euclidean_sim")
    q = per_label_queries(spark, d, T.embeddings(spark, d))
    return FO.rows_read(f, q, "euclidean_sim", BEST_LEAVES).withColumn("share", r6("share"))


def _forest_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"forest-{name}-{uuid.uuid4().hex}")


FP_DEEP = FO.ForestParams(shards=2, k=4, max_depth=3, min_leaf=40, iterations=3, seed=42)


def _topk_forest_scaled(metric: str) -> QueryFn:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        t = T.scaled_embeddings(spark, d)
        path = scratch_path(spark, "forest-scaled-" + hashlib.md5(f"{d}|{FP_DEEP}|{FO.FORMAT}".encode()).hexdigest()[:16])
        f = FO.load_or_build_forest(t, "vec_id", metric, FP_DEEP, path)
        return round_scores(FO.forest_top_k(f, min_id_query(t, "vec_id"), metric, 10, QueryInfo(1, 64)), metric=metric)
    return fn


for _m in M.METRIC_NAMES:
    register(f"topk_forest_scaled_{SHORT[_m]}",
             O.forest_topk_sql(O.SCALED_EMB, "vec_id", _MIN_SCALED_Q, _m, 10, FP_DEEP))(_topk_forest_scaled(_m))

# Few distinct points (equal seeds, so children that lose all rows), early leaves, and rows with NaN.
_GRID = ("SELECT vec_id, [CASE WHEN vec_id % 17 = 3 THEN 'NaN'::DOUBLE ELSE CAST(label AS DOUBLE) END, "
         "CAST(label % 3 AS DOUBLE), CAST(vec_id % 2 AS DOUBLE)] AS vec FROM embeddings")
_GRID_Q = f"SELECT vec_id AS query_id, vec AS q FROM ({_GRID}) WHERE vec_id IN (0, 1, 25)"
_GRID_INVALID = "isnan(vec[1])"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    e = T.read_table(spark, d, "embeddings")
    x = F.when(F.col("vec_id") % 17 == 3, F.lit(float("nan"))).otherwise(F.col("label").cast("double"))
    return e.select("vec_id", F.array(x, (F.col("label") % 3).cast("double"), (F.col("vec_id") % 2).cast("double")).alias(VEC))


FP_GRID = FO.ForestParams(shards=2, k=5, max_depth=3, min_leaf=30, iterations=3, seed=7)


@register("tree_nodes_sparse", O.forest_all_ctes(_GRID, "vec_id", "euclidean_sim", _GRID_Q, FP_GRID, _GRID_INVALID)
          + " SELECT " + ", ".join(_NODE_COLS) + " FROM nodes")
def _tree_sparse(spark: SparkSession, d: str) -> DataFrame:
    return FO.build_forest(_grid(spark, d), "vec_id", "euclidean_sim", FP_GRID, _forest_path(spark, "grid")).nodes.select(*_NODE_COLS)


@register("topk_forest_sparse_euclidean",
          O.forest_topk_sql(_GRID, "vec_id", _GRID_Q, "euclidean_sim", 10, FP_GRID, _GRID_INVALID))
def _forest_sparse(spark: SparkSession, d: str) -> DataFrame:
    t = _grid(spark, d)
    f = FO.build_forest(t, "vec_id", "euclidean_sim", FP_GRID, _forest_path(spark, "grid"))
    return round_scores(FO.forest_top_k(f, queries_by_id(t, "vec_id", [0, 1, 25]), "euclidean_sim", 10))


@register("index_rebuild", O.forest_topk_sql(O.EMB, "vec_id", _Q7, "manhattan_sim", 10, FP))
def _index_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Built with one seed for two metrics, rebuilt with another for one of them, searched with the other."""
    t = T.embeddings(spark, d)
    path = _forest_path(spark, "rebuild")
    old = FO.ForestParams(FP.shards, FP.k, FP.max_depth, FP.min_leaf, FP.iterations, seed=1)
    for m in ("cosine", "manhattan_sim"):
        FO.load_or_build_forest(t, "vec_id", m, old, path)
    FO.load_or_build_forest(t, "vec_id", "cosine", FP, path)
    f = FO.load_or_build_forest(t, "vec_id", "manhattan_sim", FP, path)
    return round_scores(FO.forest_top_k(f, queries_by_id(t, "vec_id", 7), "manhattan_sim", 10, QueryInfo(1, 64)),
                        metric="manhattan_sim")


# A table half of whose rows have no features, searched without features: the exact mode scores
# those rows 0, the other modes have no place for them.
@register("zero_features_modes",
          "SELECT 'absolute' AS mode, vec_id, 0.0::DOUBLE AS similarity_score FROM embeddings WHERE len(embedding) > 0 AND label % 2 = 0")
def _zero_features(spark: SparkSession, d: str) -> DataFrame:
    e = T.embeddings(spark, d).join(T.read_table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    t = e.select("vec_id", F.when(F.col("label") % 2 == 0, F.array().cast("array<double>")).otherwise(F.col(VEC)).alias(VEC))
    q = spark.createDataFrame([(0, [])], f"{QID} long, {Q} array<double>")
    n = t.count()
    out = None
    for mode in modes.MODES:
        opts = modes.SearchOptions(transform=TP, forest=FP, index_path=_forest_path(spark, "zero"))
        r = modes.search(t, q, mode, "euclidean_sim", n, "vec_id", opts, one_query=True)
        r = r.select(F.lit(mode).alias("mode"), "vec_id", SCORE)
        out = r if out is None else out.unionByName(r)
    return out


@register("index_roundtrip", O.forest_topk_sql(O.EMB, "vec_id", _Q7, "manhattan_sim", 10, FP))
def _index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Build (forced), then load through the fingerprint check, then search."""
    t = T.embeddings(spark, d)
    path = scratch_path(spark, "forest-roundtrip-" + hashlib.md5(d.encode()).hexdigest()[:12])
    FO.build_forest(t, "vec_id", "manhattan_sim", FP, path)
    f = FO.load_or_build_forest(t, "vec_id", "manhattan_sim", FP, path)
    return round_scores(FO.forest_top_k(f, queries_by_id(t, "vec_id", 7), "manhattan_sim", 10, QueryInfo(1, 64)),
                        metric="manhattan_sim")


# ---------------------------------------------------------------- requests with a metric each, as a stream

from vicinity.plans.exact import exact_top_k_mixed  # noqa: E402
from vicinity.streaming.query_stream import REQUEST_SCHEMA, start_search_stream  # noqa: E402

# Names as callers write them: canonical ones, aliases in any case, a user metric, an unknown one.
_LABEL_METRIC = ("CASE WHEN label < 3 THEN 'cosine' WHEN label < 4 THEN 'Euclidean' WHEN label < 6 THEN 'manhattan_sim' "
                 "WHEN label < 7 THEN ' dot' WHEN label < 8 THEN 'NEG_SQ_L2' ELSE 'nonsense' END")
_WRITTEN = {"cosine": "cosine", "euclidean_sim": "Euclidean", "manhattan_sim": "manhattan_sim", "dot_product": " dot",
            "neg_sq_l2": "NEG_SQ_L2"}


def label_requests(spark: SparkSession, d: str) -> DataFrame:
    """One request per label (its smallest vec_id), metric chosen by label."""
    e = T.read_table(spark, d, "embeddings")
    firsts = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return (e.join(firsts, ["label", "vec_id"])
            .select(F.col("vec_id").alias(QID), F.col("embedding").cast("array<double>").alias(Q),
                    F.expr(_LABEL_METRIC).alias("metric")))


def _mixed_sql() -> str:
    requests = (f"SELECT e.vec_id, e.embedding, {_LABEL_METRIC} AS metric FROM embeddings e "
                f"JOIN (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY label) f ON e.vec_id = f.vec_id")
    parts = []
    for m, written in _WRITTEN.items():
        q = f"SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM ({requests}) WHERE metric = '{written}'"
        parts.append(f"SELECT query_id, '{m}' AS metric, rank, vec_id, similarity_score, CAST(NULL AS VARCHAR) AS error FROM ("
                     + O.exact_topk_sql(O.EMB, "vec_id", q, m, 5) + ")")
    parts.append(f"SELECT vec_id, metric, NULL, NULL, NULL, 'unknown metric: ' || metric FROM ({requests}) WHERE metric = 'nonsense'")
    return " UNION ALL ".join(parts)


def _round_mixed(df: DataFrame) -> DataFrame:
    return df.withColumn(SCORE, F.when(F.col("metric") == "dot_product", round_sig(SCORE)).otherwise(r6(SCORE)))


@register("topk_mixed_metrics", _mixed_sql())
def _mixed(spark: SparkSession, d: str) -> DataFrame:
    r = exact_top_k_mixed(T.embeddings(spark, d), label_requests(spark, d), 5, "vec_id")
    return _round_mixed(r)


@register("stream_requests", _mixed_sql())
def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The same requests delivered as a file stream (one file per label) and
    answered micro-batch by micro-batch."""
    base = scratch_path(spark, "stream-" + hashlib.md5(f"{d}{time.time_ns()}".encode()).hexdigest()[:12])
    label_requests(spark, d).repartition(10, QID).write.parquet(f"{base}/requests")
    reqs = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", 3).parquet(f"{base}/requests")
    q = start_search_stream(reqs, T.embeddings(spark, d), 5, "vec_id", f"{base}/out", f"{base}/ckpt",
                            available_now=True)
    q.awaitTermination()
    return _round_mixed(spark.read.parquet(f"{base}/out").drop("epoch"))


# ---------------------------------------------------------------- stored similarity space (write once, search many)

from vicinity.plans.transform import build_similarity_space  # noqa: E402


@register("topk_transform_stored_manhattan",
          O.transform_topk_sql(O.EMB, "vec_id", _LABEL_Q_EMB, "manhattan_sim", 10, TP.n_refs, TP.sample_size,
                               TP.seed))
def _transform_stored(spark: SparkSession, d: str) -> DataFrame:
    """References and the profile table written once, then searched by ten
    queries at once from the stored tables."""
    t = T.embeddings(spark, d)
    path = scratch_path(spark, "space-" + hashlib.md5(f"{d}{time.time_ns()}".encode()).hexdigest()[:12])
    space, refs = build_similarity_space(t, "vec_id", "manhattan_sim", TP, path)
    q = per_label_queries(spark, d, t)
    r = transform_top_k(t, q, "manhattan_sim", 10, "vec_id", TP, space=space, refs=refs)
    return round_scores(r)


# ---------------------------------------------------------------- opt-in vectorised scorer (mapInArrow + NumPy)

from vicinity.plans.arrow_scan import arrow_top_k  # noqa: E402


def _topk_arrow(metric: str) -> QueryFn:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        t = T.scaled_embeddings(spark, d)
        q = per_label_queries(spark, d, t)
        return round_scores(arrow_top_k(t, q, metric, 10, "vec_id"), metric=metric)
    return fn


for _m in M.METRIC_NAMES:
    register(f"topk_arrow_{SHORT[_m]}", O.exact_topk_sql(O.SCALED_EMB, "vec_id", _LABEL_Q, _m, 10))(_topk_arrow(_m))
