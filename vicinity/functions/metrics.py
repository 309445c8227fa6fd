"""Similarity metrics as native Spark expressions.

Every metric takes two ``array<double>`` operands and returns a double where
higher means more similar.  They are Catalyst higher-order functions
(``zip_with`` / ``aggregate``), so they run inside the JVM with no Python
worker and compose with joins, windows and aggregates.

Operands are Spark SQL expressions given as text (a column name, a lambda
variable, ``from_json(...)`` of a constant vector, ...).  The ``*_sql``
builders return SQL text, so nested uses (a metric inside ``transform`` over
a reference array) are plain string composition; the Column builders wrap
the text in one ``F.expr`` call.  Building the same tree through PySpark's
Python-lambda API costs dozens of py4j round trips per expression (measured
~0.15 s per cosine) -- paid on every query plan and every loop step.

An unrolled sum of products was measured no faster at 64 dimensions and
overflows the 64 KB generated-method limit, so the higher-order form is the
only one.  Sums run left to right over the elements.

Argument order matters only for ``cosine``: the second operand is the
*target* (query, center, centroid, representative) whose near-zero norm makes
every score 0.0, while the first operand's norm is clamped up to ``EPS``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour:
#   norm clamp / zero-vector threshold for cosine: 1e-9
#   metric names: cosine, euclidean_sim, manhattan_sim, dot_product
EPS = 1e-9
METRIC_NAMES = ("cosine", "euclidean_sim", "manhattan_sim", "dot_product")

# Short aliases accepted by ``resolve_metric`` (case-insensitive).
_ALIASES = {
    "cosine": "cosine",
    "euclidean": "euclidean_sim",
    "euclidean_sim": "euclidean_sim",
    "manhattan": "manhattan_sim",
    "manhattan_sim": "manhattan_sim",
    "dot": "dot_product",
    "dot_product": "dot_product",
}

_EPS = "1.0E-9D"


def _s(x) -> str:
    if isinstance(x, str):
        return x
    raise TypeError("metric operands are Spark SQL expressions given as text (e.g. a column name)")


def _sum_pairs_sql(a: str, b: str, body: str) -> str:
    """Sum over i of body(x = a[i], y = b[i]), left to right."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> {body}), 0D, (s, x) -> s + x)"


def dot_sql(a: str, b: str) -> str:
    return _sum_pairs_sql(_s(a), _s(b), "x * y")


def sq_norm_sql(a: str) -> str:
    return f"aggregate({_s(a)}, 0D, (s, x) -> s + x * x)"


def norm_sql(a: str) -> str:
    return f"sqrt({sq_norm_sql(a)})"


def sq_distance_sql(a: str, b: str) -> str:
    return _sum_pairs_sql(_s(a), _s(b), "(x - y) * (x - y)")


def _guard(a: str, b: str, score: str) -> str:
    """0.0 when either side has no features (pair-form rule)."""
    return f"(CASE WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D ELSE {score} END)"


def cosine_sql(a: str, b: str, a_norm: str | None = None, b_norm: str | None = None) -> str:
    """Cosine similarity of row ``a`` to target ``b``.

    Target norm below EPS gives 0.0 for every row; the row norm is clamped up
    to EPS; NaN or null (from NaN/null elements) becomes 0.0.  Denominators
    are never zero, so ANSI division never raises.
    """
    a, b = _s(a), _s(b)
    an = a_norm or norm_sql(a)
    bn = b_norm or norm_sql(b)
    raw = f"{dot_sql(a, b)} / (greatest({an}, {_EPS}) * greatest({bn}, {_EPS}))"
    score = f"coalesce(CASE WHEN {bn} < {_EPS} THEN 0D ELSE nanvl({raw}, 0D) END, 0D)"
    return _guard(a, b, score)


def cosine_clamped_sql(a: str, b: str, a_norm: str | None = None, b_norm: str | None = None) -> str:
    """Cosine for the row x reference-matrix shape: both norms clamped to EPS,
    no zero-target rule; NaN/null becomes 0.0."""
    a, b = _s(a), _s(b)
    an = a_norm or norm_sql(a)
    bn = b_norm or norm_sql(b)
    raw = f"{dot_sql(a, b)} / (greatest({an}, {_EPS}) * greatest({bn}, {_EPS}))"
    return _guard(a, b, f"coalesce(nanvl({raw}, 0D), 0D)")


def euclidean_sql(a: str, b: str, **_) -> str:
    """1 / (1 + ||a - b||_2)."""
    a, b = _s(a), _s(b)
    return _guard(a, b, f"(1D / (1D + sqrt({sq_distance_sql(a, b)})))")


def manhattan_sql(a: str, b: str, **_) -> str:
    """1 / (1 + sum |a[i] - b[i]|)."""
    a, b = _s(a), _s(b)
    return _guard(a, b, f"(1D / (1D + {_sum_pairs_sql(a, b, 'abs(x - y)')}))")


def dot_product_sql(a: str, b: str, **_) -> str:
    a, b = _s(a), _s(b)
    return _guard(a, b, dot_sql(a, b))


_METRICS: dict[str, Callable[..., str]] = {
    "cosine": cosine_sql,
    "euclidean_sim": euclidean_sql,
    "manhattan_sim": manhattan_sql,
    "dot_product": dot_product_sql,
}

# Shape used when a table is re-described by its similarities to references.
_MATRIX_METRICS: dict[str, Callable[..., str]] = {**_METRICS, "cosine": cosine_clamped_sql}


def register_metric(name: str, sql_builder: Callable[[str, str], str],
                    matrix_builder: Callable[[str, str], str] | None = None) -> str:
    """Add a user metric usable by every native plan (exact, similarity space,
    forest).  ``sql_builder(a, b)`` returns Spark SQL text for the similarity
    of row ``a`` to target ``b`` (higher = more similar); ``matrix_builder``
    is the row-to-reference form (defaults to the same).  Returns the
    canonical (lower-case) name."""
    key = name.strip().lower()
    if key in _ALIASES and _ALIASES[key] in METRIC_NAMES:
        raise ValueError(f"{name!r} is a built-in metric")
    _ALIASES[key] = key
    _METRICS[key] = lambda a, b, **_: _guard(_s(a), _s(b), sql_builder(_s(a), _s(b)))
    mb = matrix_builder or sql_builder
    _MATRIX_METRICS[key] = lambda a, b, **_: _guard(_s(a), _s(b), mb(_s(a), _s(b)))
    return key


def known_metrics() -> list[str]:
    """Canonical names of all metrics, user metrics included."""
    return list(_METRICS)


def metric_aliases() -> dict[str, str]:
    """Every accepted (lower-case) name with its canonical one."""
    return dict(_ALIASES)


def resolve_metric(name: str) -> str:
    """Canonical metric name; unknown names raise ValueError at plan time."""
    if not isinstance(name, str):
        raise ValueError(f"metric name must be a string, got {name!r}")
    key = _ALIASES.get(name.strip().lower())
    if key is None:
        raise ValueError(f"Unknown similarity metric {name!r}; choose one of {list(METRIC_NAMES)}")
    return key


def metric_sql_fn(name: str, shape: str = "vector") -> Callable[..., str]:
    """SQL builder for a metric.  ``shape`` is ``vector`` (rows against one
    target) or ``matrix`` (rows against a set of references)."""
    key = resolve_metric(name)
    if shape == "vector":
        return _METRICS[key]
    if shape == "matrix":
        return _MATRIX_METRICS[key]
    raise ValueError(f"Unknown similarity shape {shape!r}; use 'vector' or 'matrix'")


def score_sql(name: str, a: str, b: str, shape: str = "vector", a_norm: str | None = None,
              b_norm: str | None = None) -> str:
    fn = metric_sql_fn(name, shape)
    if resolve_metric(name) == "cosine":
        return fn(a, b, a_norm=a_norm, b_norm=b_norm)
    return fn(a, b)


# ---------------------------------------------------------------- Column API

def score(name: str, a: str, b: str, dim: int | None = None, shape: str = "vector",
          a_norm: str | None = None, b_norm: str | None = None) -> Column:
    """Score column ``metric(a, b)`` for the named metric (``dim`` is accepted
    for API symmetry; the expression works for any length)."""
    return F.expr(score_sql(name, a, b, shape, a_norm, b_norm))


def cosine(a: str, b: str, dim: int | None = None, a_norm: str | None = None, b_norm: str | None = None) -> Column:
    return F.expr(cosine_sql(a, b, a_norm, b_norm))


def cosine_clamped(a: str, b: str, dim: int | None = None, a_norm: str | None = None,
                   b_norm: str | None = None) -> Column:
    return F.expr(cosine_clamped_sql(a, b, a_norm, b_norm))


def euclidean_sim(a: str, b: str, dim: int | None = None) -> Column:
    return F.expr(euclidean_sql(a, b))


def manhattan_sim(a: str, b: str, dim: int | None = None) -> Column:
    return F.expr(manhattan_sql(a, b))


def dot_product(a: str, b: str, dim: int | None = None) -> Column:
    return F.expr(dot_product_sql(a, b))


def dot(a: str, b: str, dim: int | None = None) -> Column:
    """Plain inner product sum(a[i] * b[i]); null if any element is null."""
    return F.expr(dot_sql(a, b))


def norm(a: str, dim: int | None = None) -> Column:
    """Euclidean (L2) norm of an array column."""
    return F.expr(norm_sql(a))


def sq_distance(a: str, b: str, dim: int | None = None) -> Column:
    return F.expr(sq_distance_sql(a, b))


def metric_fn(name: str, shape: str = "vector") -> Callable[..., Column]:
    """Column function ``(a, b) -> Column`` for a metric."""
    fn = metric_sql_fn(name, shape)
    return lambda a, b, dim=None, **kw: F.expr(fn(a, b, **kw))


def is_valid_score(s) -> Column:
    """True for scores that may be ranked: not null and not NaN (Spark orders
    NaN above every number, so NaN must never reach a sort or argmax)."""
    s = F.col(s) if isinstance(s, str) else s
    return s.isNotNull() & ~F.isnan(s)
