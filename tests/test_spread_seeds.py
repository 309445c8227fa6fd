"""Seeds drawn by distance: distinct vectors only, and a lower loss than seeds drawn by hash."""

import random

import pytest
from pyspark.sql import functions as F

from vicinity.functions import metrics as M
from vicinity.plans import forest as FO
from vicinity.sources.tables import embeddings

SF = "/root/testdata/sf0.01"
SCHEMA = "id long, features array<double>"


def blobs(spark, sizes, seed):
    draw = random.Random(seed)
    rows = [[10.0 * b + draw.random(), -7.0 * b + draw.random()] for b, n in enumerate(sizes) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(rows)), SCHEMA)


def node(table, id_col):
    return table.select(F.lit(0).alias(FO.SHARD), F.lit(FO.ROOT).alias(FO.NODE), id_col, F.col("features").alias(FO.VEC))


def loss(work, cents):
    nearest = F.expr(f"array_min(transform({FO.CENTS}, cc -> {M.sq_distance_sql(FO.VEC, 'cc.c')}))")
    return work.join(F.broadcast(FO._pack(cents)), [FO.SHARD, FO.NODE]).agg(F.sum(nearest)).first()[0]


@pytest.mark.parametrize("sizes", [(300, 10, 10, 10), (200, 100, 20, 5, 5)])
def test_every_blob_gets_a_seed_and_loss_falls(spark, sizes):
    work = node(blobs(spark, sizes, 4), "id")
    spread = FO._spread_seeds(work, "id", len(sizes), 42, 1, 2)
    assert sorted(round(r.center[0]) // 10 for r in spread.collect()) == list(range(len(sizes)))
    assert loss(work, spread) < loss(work, FO._seeds(work, "id", len(sizes), 42, 1))


def test_embeddings(spark):
    table = embeddings(spark, SF)
    work = node(table.withColumnRenamed(FO.VEC, "features") if FO.VEC in table.columns else table, "vec_id")
    dim = len(work.first()[FO.VEC])
    mean = lambda make: sum(loss(work, make(seed)) for seed in range(3))
    assert mean(lambda s: FO._spread_seeds(work, "vec_id", 5, s, 1, dim)) < 1.05 * mean(lambda s: FO._seeds(work, "vec_id", 5, s, 1))


def test_few_distinct_vectors_and_a_wrong_name(spark):
    work = node(spark.createDataFrame([(i, [float(i % 2)]) for i in range(9)], SCHEMA), "id")
    got = FO._spread_seeds(work, "id", 4, 1, 1, 1).collect()
    assert sorted(r.center[0] for r in got) == [0.0, 1.0] and sorted(r.child_no for r in got) == [0, 1]
    with pytest.raises(ValueError):
        FO._check_params(FO.ForestParams(seeding="other"))
