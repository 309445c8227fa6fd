"""Nearest centroids with sums in the task: one k-means step as ``mapInArrow`` and NumPy.

Every task keeps one sum vector, one count and one sum of squared distances for each (node, child)
that its rows meet, and emits them once; the shuffle carries those alone.  A task's state is as
large as the centroid table, which the caller checks against the broadcast limit before it is sent
along.  Distances are taken of the differences themselves (no cancellation), ties go to the lowest
child.  A node without centroids has no result; an empty input gives an empty table.

``NodeCentroids`` serves the steps of either engine: the nearest child and the distances by which
seeds are drawn, for the rows of all nodes at once.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows that are compared with the centroids of a node at once: bounds the differences held.
BLOCK_ROWS = 4096


def centroid_table(cents: DataFrame, keys: list[str], child: str, center: str) -> dict:
    """``{node key: (children, matrix)}``, children ascending, from a centroid table of checked size."""
    table = cents.select(*keys, child, center).toArrow().combine_chunks()
    if not table.num_rows:
        return {}
    matrix = table.column(center).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    children = table.column(child).to_numpy()
    places: dict = {}
    for i, key in enumerate(zip(*(table.column(k).to_pylist() for k in keys), strict=True)):
        places.setdefault(key, []).append(i)
    out = {}
    for key, rows in places.items():
        rows = np.array(rows)[np.argsort(children[rows])]
        out[key] = (children[rows], np.ascontiguousarray(matrix[rows]))
    return out


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of each row's nearest centroid, the first on ties."""
    place = np.empty(len(vectors), dtype=np.int64)
    away = np.empty(len(vectors))
    for at in range(0, len(vectors), BLOCK_ROWS):
        block = vectors[at:at + BLOCK_ROWS]
        d = np.stack([np.square(block - c).sum(axis=1) for c in centroids], axis=1)
        best = d.argmin(axis=1)
        place[at:at + BLOCK_ROWS] = best
        away[at:at + BLOCK_ROWS] = d[np.arange(len(block)), best]
    return place, away


def nearest_sums(rows: DataFrame, cents: DataFrame, keys: list[str], child: str, vec: str, center: str,
                 mean: str, count: str, loss: str) -> DataFrame:
    """``(keys, child, mean, count, loss)`` of the rows nearest to each centroid of their node."""
    table = centroid_table(cents, keys, child, center)

    def step(batches):
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            nodes = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True))
            places: dict = {}
            for i, key in enumerate(nodes):
                places.setdefault(key, []).append(i)
            for key, mine in places.items():
                if key not in table:
                    continue
                matrix = table[key][1]
                total = sums.setdefault(key, (np.zeros_like(matrix), np.zeros(len(matrix), np.int64), np.zeros(len(matrix))))
                own = vectors[mine]
                place, away = nearest(own, matrix)
                for j in np.unique(place):
                    total[0][j] += own[place == j].sum(axis=0)
                total[1][:] += np.bincount(place, minlength=len(matrix))
                total[2][:] += np.bincount(place, weights=away, minlength=len(matrix))
        for key, (total, n, away) in sums.items():
            met = np.flatnonzero(n)
            columns = [pa.array([part] * len(met), type=t) for part, t in zip(key, key_types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(table[key][0][met], pa.int32()), pa.array(list(total[met]), pa.list_(pa.float64())),
                 pa.array(n[met], pa.int64()), pa.array(away[met], pa.float64())], names=names)

    arrow_types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    types = [rows.schema[k].dataType.simpleString() for k in keys]
    key_types = [arrow_types[t] for t in types]
    names = [*keys, child, "_sum", count, loss]
    schema = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, types, strict=True)), f"`{child}` int", "_sum array<double>",
                        f"`{count}` bigint", f"`{loss}` double"])
    partial = rows.filter(F.size(vec) > 0).select(*keys, vec).mapInArrow(step, schema)
    total = partial.groupBy(*keys, child).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("_sum")))).alias("_sum"), F.sum(count).alias(count), F.sum(loss).alias(loss))
    return total.select(*keys, child, F.expr(f"transform(_sum, x -> x / `{count}`)").alias(mean), count, loss)


class NodeCentroids:
    """Centroids of many nodes, a slot for each child of a node (ascending), by the length of the centroids.

    Distances are summed left to right over the elements, as ``metrics.sq_distance_sql`` does, and for the
    rows of all nodes at once.  A row of another length than a centroid's has no distance from it."""

    def __init__(self, packed: pa.Table, cents: str, child: str):
        lists = packed.column(cents).combine_chunks()
        of_node = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        node = np.repeat(np.arange(len(of_node)), of_node)
        slot = np.arange(len(node)) - np.repeat(np.cumsum(of_node) - of_node, of_node)
        number, centers = (lists.flatten().field(i) for i in range(2))
        lengths = np.asarray(centers.value_lengths().fill_null(-1)).astype(np.int64)
        values = centers.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.maximum(lengths, 0))
        shape = (int(of_node.max(initial=0)), len(of_node))
        self.children = np.zeros(shape, np.int32)
        self.children[slot, node] = number.to_numpy()
        self.exists = np.zeros(shape, bool)
        self.exists[slot, node] = True
        self.tables = {}
        for length in np.unique(lengths[lengths >= 0]).tolist():
            mine = np.flatnonzero(lengths == length)
            table, there = np.zeros((shape[0], length, shape[1])), np.zeros(shape, bool)
            for i in mine:
                table[slot[i], :, node[i]] = values[ends[i] - length:ends[i]]
            there[slot[mine], node[mine]] = True
            self.tables[length] = table, there

    def blocks(self, places: np.ndarray, vectors: pa.Array):
        """``(rows, places, distances)`` of up to ``BLOCK_ROWS`` rows of one length at a time; ``distances`` has
        one pair a slot: squared distances, and where there is one."""
        lengths = np.asarray(vectors.value_lengths().fill_null(-1)).astype(np.int64)
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        for length in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == length)
            for at in range(0, len(mine), BLOCK_ROWS):
                rows = mine[at:at + BLOCK_ROWS]
                block = values[starts[rows][:, None] + np.arange(max(length, 0))]
                yield rows, places[rows], self._distances(places[rows], np.ascontiguousarray(block.T), length)

    def _distances(self, places: np.ndarray, block: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        table, there = self.tables.get(length, (None, None))
        one = places[0] if (places == places[0]).all() else None
        for slot in range(len(self.children)):
            total = np.zeros(len(places))
            if table is None:
                out.append((total, np.zeros(len(places), bool)))
                continue
            with np.errstate(invalid="ignore", over="ignore"):
                for x, c in zip(block, table[slot], strict=True):
                    away = x - (c[places] if one is None else c[one])
                    away *= away
                    total += away
            out.append((total, there[slot, places]))
        return out

    def nearest_child(self, places: np.ndarray, vectors: pa.Array) -> np.ndarray:
        """Child of the nearest centroid of the row's node, the lowest on ties.  As in Spark's order, NaN
        comes after, and no distance before, every number."""
        out = np.zeros(len(places), np.int32)
        for rows, at, distances in self.blocks(places, vectors):
            best, child, met = np.zeros(len(rows)), np.zeros(len(rows), np.int32), np.zeros(len(rows), bool)
            for slot, (away, there) in enumerate(distances):
                away = np.where(there, away, -np.inf)
                nearer = (away < best) | (np.isnan(best) & ~np.isnan(away)) | ~met
                nearer &= self.exists[slot, at]
                best[nearer], child[nearer] = away[nearer], self.children[slot, at[nearer]]
                met |= nearer
            out[rows] = child
        return out

    def nearest_distance(self, places: np.ndarray, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance from the nearest centroid of the row's node (NaN only beside no number), and
        where there is one."""
        out, found = np.zeros(len(places)), np.zeros(len(places), bool)
        for rows, _, distances in self.blocks(places, vectors):
            best, met = np.full(len(rows), np.nan), np.zeros(len(rows), bool)
            for away, there in distances:
                best = np.where(there, np.fmin(best, away), best)
                met |= there
            out[rows], found[rows] = best, met
        return out, found


def _ship_by_value() -> None:
    """Task functions are pickled by value: executors need no copy of this module."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def placed(packed: DataFrame, keys: list[str], child: str, cents: str, place: str) -> tuple[NodeCentroids, DataFrame]:
    """The centroids of a packed table of checked size, and ``(keys, place)``: where each node stands in them."""
    _ship_by_value()
    table = packed.select(*keys, cents).toArrow()
    numbers = table.select(keys).append_column(place, pa.array(np.arange(table.num_rows, dtype=np.int32)))
    schema = T.StructType([*(packed.schema[k] for k in keys), T.StructField(place, T.IntegerType())])
    rows = [tuple(r.values()) for r in numbers.to_pylist()]
    return NodeCentroids(table, cents, child), packed.sparkSession.createDataFrame(rows, schema)


def nearest_child(nodes: NodeCentroids, place: str, vec: str) -> Column:
    """The nearest child of each row, its node's place given: one Arrow pass, no row moves."""
    def step(places: pa.Array, vectors: pa.Array) -> pa.Array:
        return pa.array(nodes.nearest_child(places.to_numpy(), vectors))

    return F.arrow_udf(step, T.IntegerType())(place, vec)


def smallest_draws(rows: DataFrame, nodes: NodeCentroids, place: str, weight: str, vec: str, key: str) -> DataFrame:
    """Rows with ``key`` = weight / squared distance from the nearest centroid, in place of those two and ``place``.

    A task drops rows whose key is above the smallest that it has met in their node; the caller takes the smallest
    of what is left.  Rows with no distance, a distance of 0 or no weight have no key."""
    kept = [c for c in rows.columns if c not in (place, weight, vec)]

    def step(batches):
        best = np.full(nodes.children.shape[1], np.nan)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(place).to_numpy()
            away, found = nodes.nearest_distance(at, batch.column(vec))
            found &= away != 0
            weights = batch.column(weight)
            found &= np.asarray(weights.is_valid())
            keys = np.full(len(at), np.nan)
            with np.errstate(invalid="ignore", over="ignore"):
                np.divide(weights.to_numpy(zero_copy_only=False), away, out=keys, where=found)
            np.fmin.at(best, at, keys)
            chosen = np.flatnonzero(found & ((keys == best[at]) | (np.isnan(keys) & np.isnan(best[at]))))
            if len(chosen):
                small = batch.select(kept).take(pa.array(chosen))
                yield pa.RecordBatch.from_arrays([*small.columns, pa.array(keys[chosen])], names=[*kept, key])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(key, T.DoubleType())])
    return rows.mapInArrow(step, schema)
