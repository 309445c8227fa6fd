"""One entry point for the three search modes.

``search`` dispatches on the mode names ``absolute`` (exact),
``optimized_transform`` (similarity space) and ``hierarchical_kmeans``
(forest), so a job written against those modes maps onto one call.  Every
mode returns ``(query_id, rank, <id>, similarity_score)``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from vicinity.functions import metrics as M
from vicinity.functions.vectors import VEC
from vicinity.plans import forest as FO
from vicinity.plans.exact import QueryInfo, exact_top_k
from vicinity.plans.transform import TransformParams, build_similarity_space, transform_top_k

MODES = ("absolute", "optimized_transform", "hierarchical_kmeans")


@dataclass
class SearchOptions:
    transform: TransformParams = field(default_factory=TransformParams)
    forest: FO.ForestParams = field(default_factory=FO.ForestParams)
    index_path: str | None = None          # forest tables (required for hierarchical_kmeans)
    force_rebuild: bool = False
    space_path: str | None = None          # write the similarity-space tables here
    verify_index: bool = True              # compare the stored forest with the table (one scan of it)
    engine: str = "native"                 # absolute mode: native | arrow (NumPy per batch, for wide vectors)


def search(table: DataFrame, queries: DataFrame, mode: str, metric: str, k: int, id_col: str,
           options: SearchOptions | None = None, vec_col: str = VEC, one_query: bool = False) -> DataFrame:
    """Top-k per query with the chosen mode.  ``one_query`` declares that there
    is a single query, which is checked in the plan."""
    opts = options or SearchOptions()
    metric = M.resolve_metric(metric)
    mode = mode.strip().lower()
    info = QueryInfo(1, 0) if one_query else None
    if mode == "absolute":
        engine = opts.engine.strip().lower()
        if engine not in ("native", "arrow"):
            raise ValueError(f"Unknown engine {opts.engine!r}; use native or arrow")
        if engine == "arrow":
            from vicinity.plans.arrow_scan import arrow_top_k
            return arrow_top_k(table, queries, metric, k, id_col, vec_col)
        return exact_top_k(table, queries, metric, k, id_col, vec_col, info=info)
    if mode == "optimized_transform":
        space = refs = None
        if opts.space_path:
            space, refs = build_similarity_space(table, id_col, metric, opts.transform, opts.space_path, vec_col)
        return transform_top_k(table, queries, metric, k, id_col, opts.transform, vec_col, one_query, space, refs)
    if mode == "hierarchical_kmeans":
        if not opts.index_path:
            raise ValueError("hierarchical_kmeans needs options.index_path for the stored forest")
        t = table.select(id_col, vec_col) if vec_col == VEC else table.select(id_col, table[vec_col].alias(VEC))
        forest = None
        if not opts.verify_index and not opts.force_rebuild:
            forest = FO.load_forest(table.sparkSession, opts.index_path, metric)
        if forest is None:
            forest = FO.load_or_build_forest(t, id_col, metric, opts.forest, opts.index_path, force=opts.force_rebuild)
        return FO.forest_top_k(forest, queries, metric, k, info)
    raise ValueError(f"Unknown search mode {mode!r}; choose one of {list(MODES)}")
