"""DuckDB SQL builders for the independent oracle of every registered query.

These produce SQL text only; DuckDB runs it on the driver's pre-registered
views.  The metric expressions restate the engine's rules in DuckDB's list
functions (lambdas use the ``lambda x: ...`` form).  Every score is output
rounded to 6 decimals on both sides; ranking uses the unrounded score and
the id as tie-break.
"""

from __future__ import annotations

EPS = "1e-9"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def norm(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"


def _guard(a: str, b: str, expr: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {expr} END)"


def cosine(a: str, b: str) -> str:
    raw = f"{dot(a, b)} / (greatest({norm(a)}, {EPS}) * greatest({norm(b)}, {EPS}))"
    return _guard(a, b, f"(CASE WHEN {norm(b)} < {EPS} THEN 0.0 ELSE coalesce({raw}, 0.0) END)")


def cosine_clamped(a: str, b: str) -> str:
    raw = f"{dot(a, b)} / (greatest({norm(a)}, {EPS}) * greatest({norm(b)}, {EPS}))"
    return _guard(a, b, f"coalesce({raw}, 0.0)")


def euclidean(a: str, b: str) -> str:
    d2 = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return _guard(a, b, f"(1.0 / (1.0 + sqrt({d2})))")


def manhattan(a: str, b: str) -> str:
    d1 = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))"
    return _guard(a, b, f"(1.0 / (1.0 + {d1}))")


def dot_product(a: str, b: str) -> str:
    return _guard(a, b, dot(a, b))


def neg_sq_l2(a: str, b: str) -> str:
    """A user metric of the registry."""
    return _guard(a, b, f"(0.0 - list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))")


METRIC_SQL = {
    "neg_sq_l2": neg_sq_l2,
    "cosine": cosine,
    "euclidean_sim": euclidean,
    "manhattan_sim": manhattan,
    "dot_product": dot_product,
}
MATRIX_METRIC_SQL = {**METRIC_SQL, "cosine": cosine_clamped}


def metric(name: str, a: str, b: str, shape: str = "vector") -> str:
    return (METRIC_SQL if shape == "vector" else MATRIX_METRIC_SQL)[name](a, b)


def r6(expr: str) -> str:
    return f"round({expr}, 6)"


def rsig(expr: str, digits: int = 8) -> str:
    """Round to ``digits`` significant digits (for unbounded dot scores)."""
    p = f"pow(10.0, floor(log10(abs({expr}))))"
    return (f"(CASE WHEN {expr} = 0 OR isnan({expr}) OR isinf({expr}) THEN {expr} "
            f"ELSE round({expr} / {p}, {digits - 1}) * {p} END)")


def rscore(metric_name: str, expr: str) -> str:
    return rsig(expr) if metric_name == "dot_product" else r6(expr)


EMB = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings"
PART_VEC = ("SELECT p_partkey, [CAST(p_size AS DOUBLE), CAST(p_retailprice AS DOUBLE)] AS vec FROM part")
ORDER_VEC = ("SELECT l_orderkey, [sum(l_quantity), sum(l_extendedprice), avg(l_discount), avg(l_tax)] AS vec "
             "FROM lineitem GROUP BY l_orderkey")
SCALED_EMB = ("SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), "
              "lambda x: x * CAST(label + 1 AS DOUBLE)) AS vec FROM embeddings")


def mean_vector_sql(src: str, vec: str = "vec", group: list[str] | None = None) -> str:
    """Element-wise mean vector of ``src`` (optionally per group) as ``center``."""
    g = group or []
    gsel = "".join(f"{c}, " for c in g)
    gby = ", ".join(g + ["pos"])
    inner = (f"SELECT {gsel}pos, avg(x) AS m FROM (SELECT {gsel}unnest({vec}) AS x, "
             f"generate_subscripts({vec}, 1) AS pos FROM ({src})) GROUP BY {gby}")
    outer_g = f" GROUP BY {', '.join(g)}" if g else ""
    return f"SELECT {gsel}list(m ORDER BY pos) AS center FROM ({inner}){outer_g}"


def median_vector_sql(src: str, vec: str = "vec") -> str:
    inner = (f"SELECT pos, median(x) AS m FROM (SELECT unnest({vec}) AS x, "
             f"generate_subscripts({vec}, 1) AS pos FROM ({src})) GROUP BY pos")
    return f"SELECT list(m ORDER BY pos) AS center FROM ({inner})"


def hash_sample_sql(src: str, id_col: str, n: int, seed: int) -> str:
    """Bottom-n rows by md5(id || seed), id as tie-break."""
    return (f"SELECT * FROM ({src}) ORDER BY md5(CAST({id_col} AS VARCHAR) || '{seed}'), {id_col} "
            f"LIMIT {n}")


def exact_topk_sql(table_sql: str, id_col: str, query_sql: str, metric_name: str, k: int,
                   shape: str = "vector") -> str:
    """Per-query top-k; ``query_sql`` yields (query_id, q)."""
    s = metric(metric_name, "t.vec", "qq.q", shape)
    return f"""
SELECT query_id, rank, {id_col}, {rscore(metric_name, 'score')} AS similarity_score FROM (
  SELECT qq.query_id, t.{id_col}, {s} AS score,
         CAST(row_number() OVER (PARTITION BY qq.query_id ORDER BY {s} DESC, t.{id_col}) AS INTEGER) AS rank
  FROM ({table_sql}) t CROSS JOIN ({query_sql}) qq
  WHERE {s} IS NOT NULL AND NOT isnan({s})
) WHERE rank <= {k}"""


def _valid(expr: str) -> str:
    return f"{expr} IS NOT NULL AND NOT isnan({expr})"


def references_ctes(table_sql: str, id_col: str, metric_name: str, n_refs: int, sample_n: int,
                    seed: int, use_median: bool = False) -> str:
    """CTE list ending in ``refs(ref_no, id, vec)``: the diverse references."""
    center = median_vector_sql("SELECT vec FROM samp") if use_median else mean_vector_sql("SELECT vec FROM samp")
    s_first = metric(metric_name, "s.vec", "c.center")
    s_next = metric(metric_name, "s.vec", "r.vec")
    return f"""
base AS ({table_sql}),
samp AS (SELECT {id_col} AS id, vec FROM base
         ORDER BY md5(CAST({id_col} AS VARCHAR) || '{seed}'), {id_col} LIMIT {sample_n}),
ctr AS ({center}),
first_ref AS (SELECT s.id, s.vec FROM samp s, ctr c WHERE {_valid(s_first)}
              ORDER BY {s_first} DESC, s.id LIMIT {1 if n_refs > 0 else 0}),
chain(ref_no, id, vec, chosen) AS (
  SELECT 0, id, vec, [id] FROM first_ref
  UNION ALL
  SELECT r.ref_no + 1, nx.id, nx.vec, list_append(r.chosen, nx.id)
  FROM chain r, LATERAL (SELECT s.id, s.vec FROM samp s
                         WHERE NOT list_contains(r.chosen, s.id) AND {_valid(s_next)}
                         ORDER BY {s_next} ASC, s.id LIMIT 1) nx
  WHERE r.ref_no + 1 < {n_refs}
),
refs AS (SELECT ref_no, id, vec FROM chain)"""


def space_ctes(id_col: str, metric_name: str, query_sql: str) -> str:
    """After ``references_ctes``: ``space(id, sims)`` and ``qspace(query_id, q)``."""
    m_row = metric(metric_name, "t.vec", "r.vec", "matrix")
    m_q = metric(metric_name, "qq.q", "r.vec", "matrix")
    return f""",
space AS (SELECT t.{id_col} AS id, list({m_row} ORDER BY r.ref_no) AS sims
          FROM base t CROSS JOIN refs r GROUP BY t.{id_col}),
qspace AS (SELECT qq.query_id, list({m_q} ORDER BY r.ref_no) AS q
           FROM ({query_sql}) qq CROSS JOIN refs r GROUP BY qq.query_id)"""


def round_list(expr: str) -> str:
    return f"list_transform({expr}, lambda x: round(x, 6))"


def transform_topk_sql(table_sql: str, id_col: str, query_sql: str, metric_name: str, k: int,
                       n_refs: int, sample_n: int, seed: int) -> str:
    ctes = references_ctes(table_sql, id_col, metric_name, n_refs, sample_n, seed) + space_ctes(
        id_col, metric_name, query_sql)
    s = metric(metric_name, "t.sims", "qq.q")
    return f"""WITH RECURSIVE {ctes}
SELECT query_id, rank, id AS {id_col}, {rscore(metric_name, 'score')} AS similarity_score FROM (
  SELECT qq.query_id, t.id, {s} AS score,
         CAST(row_number() OVER (PARTITION BY qq.query_id ORDER BY {s} DESC, t.id) AS INTEGER) AS rank
  FROM space t CROSS JOIN qspace qq WHERE {_valid(s)}
) WHERE rank <= {k}"""


def forest_ctes(table_sql: str, id_col: str, metric_name: str, shards: int, k: int, max_depth: int,
                min_leaf: int, iterations: int, seed: int, invalid: str = "false", seeding: str = "hash",
                batch_size: int = 0, batch_steps: int = 0, starts: int = 1) -> str:
    """CTE list building the sharded k-means forest: ends with ``nodes`` and
    ``members(shard, leaf_id, id, vec)``.  One CTE per level and Lloyd step."""
    sq = "list_sum(list_transform(list_zip(w.vec, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

    def assign(w: str, c: str) -> str:
        return (f"SELECT w.shard, w.node_id, w.id, any_value(w.vec) AS vec, "
                f"arg_min(c.child_no, ({sq}, c.child_no)) AS child_no "
                f"FROM {w} w JOIN {c} c ON w.shard = c.shard AND w.node_id = c.node_id "
                f"GROUP BY w.shard, w.node_id, w.id")

    parts = [f"base AS ({table_sql})",
             f"rall AS (SELECT {id_col} AS id, vec, "
             f"CAST((('0x' || substr(md5(CAST({id_col} AS VARCHAR)), 1, 8))::BIGINT % {shards}) AS INTEGER) "
             f"AS shard, 'root' AS node_id, {invalid} AS bad FROM base)",
             "r0 AS (SELECT id, vec, shard, node_id FROM rall WHERE NOT bad)"]
    leaf_parts, kid_parts = [], []
    can_split = k >= 2
    depth_range = range(max_depth if can_split else 0)
    for d in depth_range:
        parts.append(f"st{d} AS (SELECT shard, node_id, count(*) AS n FROM r{d} GROUP BY shard, node_id)")
        parts.append(f"act{d} AS (SELECT shard, node_id, least({k}, n) AS kk FROM st{d} "
                     f"WHERE n >= {min_leaf} AND n >= 2)")
        parts.append(f"w{d} AS (SELECT r.* FROM r{d} r SEMI JOIN act{d} a ON r.shard = a.shard "
                     f"AND r.node_id = a.node_id)")
        parts.append(f"lm{d} AS (SELECT r.shard, r.node_id AS leaf_id, r.id, r.vec FROM r{d} r "
                     f"ANTI JOIN act{d} a ON r.shard = a.shard AND r.node_id = a.node_id)")
        leaf_parts.append(f"SELECT * FROM lm{d}")
        # Mini-batches: (node, start) stands for the node until a start has won.
        src, seed_text = f"w{d}", f"'{seed}'"
        if batch_size:
            src, seed_text = f"p{d}", f"CAST({seed} + CAST(split_part(node_id, '#', 2) AS INTEGER) AS VARCHAR)"
            parts.append(f"nb{d} AS (SELECT shard, node_id, CAST(ceil(n / {batch_size}) AS BIGINT) AS batches FROM st{d})")
            dealt = [f"SELECT w.shard, w.node_id || '#{s}' AS node_id, w.id, w.vec, batches, CAST(floor("
                     f"('0x' || substr(md5(CAST(w.id AS VARCHAR) || '{seed}/batch{s}'), 1, 13))::BIGINT / {1 << 52}::DOUBLE * batches) "
                     f"AS BIGINT) AS batch FROM w{d} w JOIN nb{d} b ON w.shard = b.shard AND w.node_id = b.node_id"
                     for s in range(starts)]
            parts.append(f"p{d} AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(dealt)}) WHERE batch < {batch_steps})")
        first = 1 if seeding == "spread" else k
        parts.append(f"s{d}_0 AS (SELECT shard, node_id, child_no, vec AS c FROM ("
                     f"SELECT shard, node_id, vec, CAST(row_number() OVER (PARTITION BY shard, node_id "
                     f"ORDER BY md5(CAST(id AS VARCHAR) || {seed_text}), id) - 1 AS INTEGER) AS child_no FROM {src}) "
                     f"WHERE child_no < {first})")
        rounds = k - 1 if seeding == "spread" else 0
        for t in range(1, rounds + 1):
            u = f"(('0x' || substr(md5(CAST(id AS VARCHAR) || {seed_text} || '/{t}'), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE"
            parts.append(f"d{d}_{t} AS (SELECT w.shard, w.node_id, w.id, any_value(w.vec) AS vec, min({sq}) AS dist "
                         f"FROM {src} w JOIN s{d}_{t - 1} c ON w.shard = c.shard AND w.node_id = c.node_id "
                         f"GROUP BY w.shard, w.node_id, w.id)")
            parts.append(f"s{d}_{t} AS (SELECT * FROM s{d}_{t - 1} UNION ALL "
                         f"SELECT shard, node_id, CAST({t} AS INTEGER) AS child_no, vec AS c FROM ("
                         f"SELECT shard, node_id, vec, row_number() OVER (PARTITION BY shard, node_id "
                         f"ORDER BY -ln({u}) / dist, id) AS rn FROM d{d}_{t} WHERE dist > 0) WHERE rn = 1)")
        parts.append(f"c{d}_0 AS (SELECT * FROM s{d}_{rounds})")
        if batch_size:
            parts.append(f"b{d}_0 AS MATERIALIZED (SELECT *, CAST(0 AS BIGINT) AS seen FROM c{d}_0)")
        for t in range(1, batch_steps + 1 if batch_size else 1):
            parts.append(f"n{d}_{t} AS (SELECT * FROM p{d} WHERE {t - 1} % batches = batch)")
            parts.append(f"ba{d}_{t} AS MATERIALIZED ({assign(f'n{d}_{t}', f'b{d}_{t - 1}')})")
            mean = mean_vector_sql(f"SELECT * FROM ba{d}_{t}", group=["shard", "node_id", "child_no"])
            parts.append(f"bm{d}_{t} AS (SELECT m.*, x.n FROM ({mean}) m JOIN (SELECT shard, node_id, child_no, count(*) AS n "
                         f"FROM ba{d}_{t} GROUP BY ALL) x USING (shard, node_id, child_no))")
            parts.append(f"b{d}_{t} AS MATERIALIZED (SELECT b.shard, b.node_id, b.child_no, CASE WHEN m.n IS NULL THEN b.c ELSE "
                         f"list_transform(list_zip(b.c, m.center), lambda p: (p[1] * b.seen + p[2] * m.n) / (b.seen + m.n)) END AS c, "
                         f"b.seen + coalesce(m.n, 0) AS seen FROM b{d}_{t - 1} b LEFT JOIN bm{d}_{t} m "
                         f"ON b.shard = m.shard AND b.node_id = m.node_id AND b.child_no = m.child_no)")
        if batch_size:
            parts.append(f"bt{d} AS (SELECT w.shard, w.node_id, w.id, c.node_id AS try, min({sq}) AS dist FROM w{d} w "
                         f"JOIN b{d}_{batch_steps} c ON w.shard = c.shard AND w.node_id = split_part(c.node_id, '#', 1) "
                         f"GROUP BY w.shard, w.node_id, w.id, c.node_id)")
            parts.append(f"bw{d} AS (SELECT shard, arg_min(try, (inertia, start)) AS try FROM (SELECT shard, node_id, try, "
                         f"CAST(split_part(try, '#', 2) AS INTEGER) AS start, CAST(sum(dist) AS FLOAT) AS inertia FROM bt{d} "
                         f"GROUP BY shard, node_id, try) GROUP BY shard, node_id)")
            parts.append(f"c{d}_final AS MATERIALIZED (SELECT c.shard, split_part(c.node_id, '#', 1) AS node_id, c.child_no, c.c "
                         f"FROM b{d}_{batch_steps} c SEMI JOIN bw{d} b ON c.shard = b.shard AND c.node_id = b.try)")
        for t in range(1, 1 if batch_size else iterations + 1):
            parts.append(f"a{d}_{t} AS ({assign(f'w{d}', f'c{d}_{t - 1}')})")
            mean = mean_vector_sql(f"SELECT * FROM a{d}_{t}", group=["shard", "node_id", "child_no"])
            parts.append(f"c{d}_{t} AS (SELECT shard, node_id, child_no, center AS c FROM ({mean}))")
        cf = f"c{d}_final" if batch_size else f"c{d}_{iterations}"
        parts.append(f"a{d} AS ({assign(f'w{d}', cf)})")
        rep_score = metric(metric_name, "a.vec", "c.c")
        parts.append(f"rep{d} AS (SELECT shard, node_id, child_no, id AS rep_id, vec AS rep_vec FROM ("
                     f"SELECT a.*, row_number() OVER (PARTITION BY a.shard, a.node_id, a.child_no "
                     f"ORDER BY {rep_score} DESC, a.id) AS rn FROM a{d} a JOIN {cf} c "
                     f"ON a.shard = c.shard AND a.node_id = c.node_id AND a.child_no = c.child_no) WHERE rn = 1)")
        parts.append(f"cnt{d} AS (SELECT shard, node_id, child_no, count(*) AS n FROM a{d} "
                     f"GROUP BY shard, node_id, child_no)")
        parts.append(f"g{d} AS (SELECT shard, node_id, CAST(unnest(range(kk)) AS INTEGER) AS child_no FROM act{d})")
        parts.append(f"kid{d} AS (SELECT g.shard, g.node_id || '_' || g.child_no AS node_id, g.node_id AS parent_id, "
                     f"g.child_no, {d + 1} AS depth, CAST(coalesce(cnt.n, 0) AS BIGINT) AS member_count, "
                     f"rep.rep_id, rep.rep_vec FROM g{d} g "
                     f"LEFT JOIN cnt{d} cnt ON g.shard = cnt.shard AND g.node_id = cnt.node_id "
                     f"AND g.child_no = cnt.child_no "
                     f"LEFT JOIN rep{d} rep ON g.shard = rep.shard AND g.node_id = rep.node_id "
                     f"AND g.child_no = rep.child_no)")
        kid_parts.append(f"SELECT * FROM kid{d}")
        parts.append(f"r{d + 1} AS (SELECT shard, node_id || '_' || child_no AS node_id, id, vec FROM a{d})")
    last = len(depth_range)
    leaf_parts.append(f"SELECT shard, node_id AS leaf_id, id, vec FROM r{last}")
    leaf_parts.append("SELECT shard, 'invalid' AS leaf_id, id, vec FROM rall WHERE bad")
    parts.append("roots AS (SELECT shard, 'root' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, "
                 "CAST(NULL AS INTEGER) AS child_no, 0 AS depth, CAST(count(*) AS BIGINT) AS member_count, "
                 "CAST(NULL AS BIGINT) AS rep_id, CAST(NULL AS DOUBLE[]) AS rep_vec FROM r0 GROUP BY shard)")
    parts.append("allnodes AS (" + " UNION ALL ".join(["SELECT * FROM roots"] + kid_parts) + ")")
    parts.append("nodes AS (SELECT n.*, NOT EXISTS (SELECT 1 FROM allnodes c WHERE c.shard = n.shard "
                 "AND c.parent_id = n.node_id) AS is_leaf FROM allnodes n)")
    parts.append("members AS (" + " UNION ALL ".join(leaf_parts) + ")")
    return ",\n".join(parts)


def descent_ctes(query_sql: str, metric_name: str, max_depth: int) -> str:
    """After ``forest_ctes``: ``hits(query_id, q, shard, leaf_id)``."""
    parts = [f"qs AS ({query_sql})",
             "f0 AS (SELECT qs.query_id, qs.q, s.shard, 'root' AS node_id FROM qs "
             "CROSS JOIN (SELECT DISTINCT shard FROM roots) s)"]
    s = metric(metric_name, "f.q", "kn.rep_vec")
    for step in range(1, max_depth + 1):
        parts.append(
            f"f{step} AS (SELECT query_id, q, shard, nxt AS node_id FROM ("
            f"SELECT query_id, q, shard, CASE WHEN child IS NULL THEN node_id "
            f"WHEN score IS NOT NULL AND NOT isnan(score) THEN child END AS nxt FROM ("
            f"SELECT f.query_id, f.q, f.shard, f.node_id, kn.node_id AS child, kn.child_no, "
            f"CASE WHEN kn.node_id IS NULL THEN NULL ELSE {s} END AS score, "
            f"row_number() OVER (PARTITION BY f.query_id, f.shard ORDER BY "
            f"CASE WHEN kn.node_id IS NULL THEN NULL ELSE {s} END DESC NULLS LAST, kn.child_no NULLS LAST) AS rn "
            f"FROM f{step - 1} f LEFT JOIN (SELECT * FROM nodes WHERE parent_id IS NOT NULL AND rep_vec IS NOT NULL) kn "
            f"ON kn.shard = f.shard AND kn.parent_id = f.node_id) WHERE rn = 1) WHERE nxt IS NOT NULL)")
    parts.append(f"hits AS (SELECT query_id, q, shard, node_id AS leaf_id FROM f{max_depth} "
                 f"UNION ALL SELECT query_id, q, shard, 'invalid' FROM f{max_depth})")
    return ",\n".join(parts)


def best_first_ctes(query_sql: str, metric_name: str, max_depth: int, n_leaves: int) -> str:
    """After ``forest_ctes``: ``hits(query_id, q, shard, leaf_id)`` of the best-first descent."""
    parts = [f"qs AS ({query_sql})",
             "f0 AS (SELECT qs.query_id, s.shard, 'root' AS node_id, CAST(0 AS DOUBLE) AS loss FROM qs "
             "CROSS JOIN (SELECT DISTINCT shard FROM roots) s)"]
    s = metric(metric_name, "qs.q", "kn.rep_vec")
    for step in range(1, max_depth + 1):
        parts.append(
            f"x{step} AS (SELECT f.query_id, f.shard, f.node_id, f.loss, kn.node_id AS child, "
            f"CASE WHEN kn.node_id IS NULL OR isnan({s}) THEN NULL ELSE {s} END AS score "
            f"FROM f{step - 1} f JOIN qs ON qs.query_id = f.query_id "
            f"LEFT JOIN (SELECT * FROM nodes WHERE parent_id IS NOT NULL AND rep_vec IS NOT NULL) kn "
            f"ON kn.shard = f.shard AND kn.parent_id = f.node_id)")
        parts.append(
            f"y{step} AS (SELECT query_id, shard, CASE WHEN child IS NULL THEN node_id WHEN score IS NOT NULL THEN child END AS nxt, "
            f"loss + coalesce(max(score) OVER (PARTITION BY query_id, shard, node_id) - score, 0) AS loss FROM x{step})")
        parts.append(
            f"f{step} AS (SELECT query_id, shard, nxt AS node_id, loss FROM y{step} WHERE nxt IS NOT NULL "
            f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY loss, shard, nxt) <= {n_leaves})")
    last = f"f{max_depth}"
    parts.append(f"hits AS (SELECT h.query_id, qs.q, h.shard, h.leaf_id FROM (SELECT query_id, shard, node_id AS leaf_id FROM {last} "
                 f"UNION ALL SELECT DISTINCT query_id, shard, 'invalid' FROM {last}) h JOIN qs ON qs.query_id = h.query_id)")
    return ",\n".join(parts)


def forest_all_ctes(table_sql: str, id_col: str, metric_name: str, query_sql: str, fp, invalid: str = "false",
                    n_leaves: int | None = None) -> str:
    return ("WITH " + forest_ctes(table_sql, id_col, metric_name, fp.shards, fp.k, fp.max_depth, fp.min_leaf,
                                  fp.iterations, fp.seed, invalid, fp.seeding, fp.batch_size, fp.batch_steps, fp.starts)
            + ",\n" + (descent_ctes(query_sql, metric_name, fp.max_depth) if n_leaves is None
                       else best_first_ctes(query_sql, metric_name, fp.max_depth, n_leaves)))


def forest_topk_sql(table_sql: str, id_col: str, query_sql: str, metric_name: str, k: int, fp, invalid: str = "false",
                    n_leaves: int | None = None) -> str:
    s = metric(metric_name, "m.vec", "h.q")
    return forest_all_ctes(table_sql, id_col, metric_name, query_sql, fp, invalid, n_leaves) + f"""
SELECT query_id, rank, id AS {id_col}, {rscore(metric_name, 'score')} AS similarity_score FROM (
  SELECT h.query_id, m.id, {s} AS score,
         CAST(row_number() OVER (PARTITION BY h.query_id ORDER BY {s} DESC, m.id) AS INTEGER) AS rank
  FROM members m JOIN hits h ON m.shard = h.shard AND m.leaf_id = h.leaf_id WHERE {_valid(s)}
) WHERE rank <= {k}"""
