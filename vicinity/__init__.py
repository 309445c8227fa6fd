"""vicinity: vector similarity search as Spark DataFrame plans.

Three ways to answer "which k rows of a vector table are most similar to this
query": exact top-k (``plans.exact``), top-k in a space of similarities to a
few diverse reference rows (``plans.transform``), and top-k through a sharded
hierarchical k-means index stored as tables (``plans.forest``).  Four metrics:
cosine, euclidean_sim, manhattan_sim, dot_product (``functions.metrics``).
"""

from vicinity.functions.metrics import METRIC_NAMES, resolve_metric, score  # noqa: F401

__all__ = ["METRIC_NAMES", "resolve_metric", "score"]
