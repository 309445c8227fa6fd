"""The registered queries of this subpackage and, where SQL can say it, their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm import conversations, fim, hamming, langid, mixing, neardup, ngramjoin, packing, pii, repetition, secrets, tokencount, warc
from vicinity.llm.common import read_table


#: Target shares of the mixture, for the query and the pipeline.
MIX_WEIGHTS = {"src0": 0.20, **{f"src{i}": 0.04 for i in range(1, 20)}}
MIX_OTHER = 0.04


def op1_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_OTHER)
    return mixed.withColumn("mean", F.round("mean", 6))


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(read_table(spark, sf_dir, "documents"))


TOP_K = 10


def op3_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code("embedding").alias("code"))
    return hamming.top_k(rows, rows.where("vec_id % 100 = 0"), TOP_K, "vec_id", "code", "vec_id", "code")


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write_archives(read_table(spark, sf_dir, "pages"), path)
    pages = warc.read_archives(spark, path)
    return pages.select(
        pages.page.cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        pages.refers_to.cast("long").alias("refers_to"))


def op5_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


def op6_bayes_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents"))


def op10_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(read_table(spark, sf_dir, "conversations")))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(read_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.with_digests(fim.transform(read_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_poisson_mixing": op1_poisson_mixing,
    "op2_repetition_coverage": op2_repetition_coverage,
    "op3_hamming_top_k": op3_hamming_top_k,
    "op4_warc_segments": op4_warc_segments,
    "op5_pii_weak_supervision": op5_pii_weak_supervision,
    "op6_bayes_near_duplicates": op6_bayes_near_duplicates,
    "op7_secret_novelty": op7_secret_novelty,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_cutting_stock_packing": op10_cutting_stock_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
    "op13_fill_in_middle": op13_fill_in_middle,
}

def near_duplicates_sql(table: str, n_words: int = neardup.WORDS, pct: int = neardup.SIMILARITY_PCT, kept: bool = True) -> str:
    """Components of ``table(doc_id, text)`` by comparing all sets that share a shingle."""
    last = ", k.doc_id = coalesce(m.label, k.doc_id) AS kept" if kept else ""
    return f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x20\\x09-\\x0D]+') AS words FROM {table}),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {n_words} THEN [array_to_string(words, ' ')]
                     ELSE [array_to_string(words[i:i + {n_words - 1}], ' ') FOR i IN range(1, len(words) - {n_words - 2})] END) AS shingles FROM w),
        c AS (SELECT md5(array_to_string(list_sort(shingles), chr(10))) AS class, min(doc_id) AS first_id, any_value(shingles) AS shingles,
                     any_value(len(shingles)) AS n FROM s WHERE len(shingles) > 0 GROUP BY class),
        e AS (SELECT first_id, n, unnest(shingles) AS shingle FROM c),
        l AS (SELECT a.first_id AS u, b.first_id AS v FROM e a JOIN e b USING (shingle) WHERE a.first_id <> b.first_id
              GROUP BY a.first_id, b.first_id HAVING 100 * count(*) >= {pct} * (any_value(a.n) + any_value(b.n) - count(*))),
        r(node, label) AS (SELECT first_id, first_id FROM c UNION SELECT l.v, r.label FROM r JOIN l ON l.u = r.node),
        m AS (SELECT node, min(label) AS label FROM r GROUP BY node),
        k AS (SELECT md5(array_to_string(list_sort(shingles), chr(10))) AS class, doc_id, len(shingles) AS n FROM s)
        SELECT k.doc_id, k.n AS n_shingles, coalesce(m.label, k.doc_id) AS component_id{last}
        FROM k LEFT JOIN c ON k.class = c.class AND k.n > 0 LEFT JOIN m ON m.node = c.first_id
    """


def repetition_sql(table: str) -> str:
    """Word and line repetition of ``table(doc_id, text)``."""
    limits = repetition.MAX_NGRAM_SHARE
    word = "[^\\x20\\x09-\\x0D]"
    shares = ", ".join(f"coalesce(sum(chars) FILTER (n = {n}), 0) AS later_{n}" for n in limits)
    named = ", ".join(f"coalesce(later_{n}, 0) / greatest(word_chars, 1) AS dup_{n}gram_share" for n in limits)
    bad = " OR ".join(f"dup_{n}gram_share > {most}" for n, most in limits.items())
    return f"""
        WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                          regexp_extract_all(coalesce(text, ''), '{word}+') AS words FROM {table}),
        c AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN words]), 0) AS BIGINT) AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
        g AS (SELECT r, words, n, unnest(range(1, CAST(len(words) AS BIGINT) - n + 2)) AS i FROM w, (VALUES {", ".join(f"({n})" for n in limits)}) t(n)),
        k AS (SELECT r, n, i, words[i:i + n - 1] AS gram FROM g),
        d AS (SELECT r, n, i, row_number() OVER (PARTITION BY r, n, gram ORDER BY i) AS nth, count(*) OVER (PARTITION BY r, n, gram) AS times FROM k),
        a AS (SELECT DISTINCT r, unnest(range(i, i + 5)) AS pos FROM d WHERE n = 5 AND times > 1),
        a2 AS (SELECT r, count(*) AS n_repeat_words FROM a GROUP BY r),
        l AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS pos FROM d WHERE nth > 1),
        l2 AS (SELECT l.r, l.n, sum(length(w.words[pos])) AS chars FROM l JOIN w USING (r) GROUP BY l.r, l.n),
        l3 AS (SELECT r, {shares} FROM l2 GROUP BY r),
        p AS (SELECT r, string_split(text, chr(10)) AS lines FROM w),
        q AS (SELECT r, lines[i] AS line, i FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM p)),
        s AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) AS nth FROM q WHERE regexp_matches(line, '{word}')),
        s2 AS (SELECT r, count(*) FILTER (nth > 1) AS n_dup_lines, coalesce(sum(length(line)) FILTER (nth > 1), 0) AS dup_chars,
                      sum(length(line)) AS line_chars FROM s GROUP BY r),
        m AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                     coalesce(dup_chars, 0) / greatest(coalesce(line_chars, 0), 1) AS dup_line_share, {named}
              FROM c LEFT JOIN a2 USING (r) LEFT JOIN l3 USING (r) LEFT JOIN s2 USING (r)),
        b AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_WORDS_PCT} * n_words AS base_failed FROM m)
        SELECT *, NOT base_failed AND NOT (dup_line_share > {repetition.MAX_LINE_SHARE} OR {bad}) AS kept FROM b
    """


def conversations_sql(table: str) -> str:
    """Damage and cheapest repair of ``table(conv_id, turn, role, text)``: one step of the recursion takes one row of every
    conversation, and keeps for each state of the grammar (0 nothing, 1 after s, 2 after u, 3 after a) the best edits."""
    space = "\\x20\\x09-\\x0D"
    return f"""
        WITH RECURSIVE t AS (SELECT list(c ORDER BY n) AS t FROM (
                SELECT n, list_reduce(list_prepend(n::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                      lambda c, z: xor(c >> 1, 3988292384::BIGINT * (c & 1))) AS c FROM range(256) r(n))),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM {table}),
        d AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT,
                         list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS d FROM k, t),
        m AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
                     CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE d WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE d <> 0),
        n AS (SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before,
                     row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
              FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                             WHEN NOT regexp_matches(text, '[.!?][{space}]*$') THEN 'truncated' ELSE 'none' END AS fault FROM n),
        nx(q, to_q, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
        kp(q, initial, to_q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        ins(q, to_q, edits, lines, cost) AS (
            SELECT q, q, '', []::VARCHAR[], 0 FROM nx UNION ALL SELECT q, to_q, 'I', [role || ':'], 2 FROM nx
            UNION ALL SELECT a.q, b.to_q, 'II', [a.role || ':', b.role || ':'], 4 FROM nx a JOIN nx b ON b.q = a.to_q),
        ways AS (
            SELECT ins.q, f.conv_id, f.i, ins.to_q, ins.edits || 'D' AS edits, ins.lines, ins.cost + 3 AS cost FROM ins, f
            UNION ALL SELECT ins.q, f.conv_id, f.i, kp.to_q, ins.edits || 'K', list_append(ins.lines, f.role || ':' || f.text),
                   ins.cost + (fault = 'truncated')::INT FROM ins JOIN kp ON kp.q = ins.to_q JOIN f ON left(f.role, 1) = kp.initial
                   WHERE fault IN ('none', 'truncated')
            UNION ALL SELECT ins.q, f.conv_id, f.i, nx.to_q, ins.edits || 'R', list_append(ins.lines, nx.role || ':' || f.text),
                   ins.cost + 2 + (fault = 'truncated')::INT FROM ins JOIN nx ON nx.q = ins.to_q, f WHERE fault IN ('none', 'truncated')),
        r(conv_id, i, q, cost, edits, lines) AS (
            SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM f
            UNION ALL
            SELECT conv_id, i, to_q, b.cost, b.edits, b.lines FROM (
                SELECT w.conv_id, w.i, w.to_q, min(struct_pack(cost := r.cost + w.cost, edits := r.edits || w.edits,
                                                               lines := list_concat(r.lines, w.lines))) AS b
                FROM r JOIN ways w ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.i = r.i + 1 AND w.q = r.q GROUP BY w.conv_id, w.i, w.to_q)),
        c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                     count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                     count(*) FILTER (fault = 'truncated') AS truncated,
                     count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
              FROM f GROUP BY conv_id),
        e AS (SELECT c.conv_id, min(struct_pack(cost := r.cost + ins.cost, edits := r.edits || ins.edits,
                                                lines := list_concat(r.lines, ins.lines))) AS b
              FROM c JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.n JOIN ins ON ins.q = r.q
              WHERE ins.to_q = 3 OR ins.edits = '' AND ins.to_q = 0 GROUP BY c.conv_id)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.b.cost, 0)::BIGINT AS cost,
               coalesce(e.b.edits, '') AS audit, sha256(coalesce(array_to_string(e.b.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM {table}) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
    """


def fill_in_middle_sql(table: str) -> str:
    draws = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {table}),
        d AS (SELECT doc_id, text, length(text) AS n, {draws} FROM t),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM p
    """


_WEIGHTS_SQL = ", ".join(f"('{name}', {weight}::DOUBLE)" for name, weight in MIX_WEIGHTS.items())

ORACLES: dict[str, str] = {
    "op1_poisson_mixing": f"""
        WITH w(grp, weight) AS (VALUES {_WEIGHTS_SQL}),
        d AS (SELECT documents.*, w.grp,
                     ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
              FROM documents LEFT JOIN w ON source = w.grp),
        s AS (SELECT d.grp, sum(coalesce(length(text), 0))::DOUBLE AS chars, coalesce(max(weight), {MIX_OTHER})::DOUBLE AS weight
              FROM d LEFT JOIN w ON d.grp = w.grp GROUP BY d.grp),
        m AS (SELECT grp, CASE WHEN chars > 0
                THEN 1.0::DOUBLE * weight / (SELECT sum(weight) FROM s WHERE chars > 0) * (SELECT sum(chars) FROM s) / chars
                ELSE 1.0::DOUBLE END AS mean FROM s),
        k AS (SELECT grp, mean, unnest(range(0, cast(ceil(mean + 12 * sqrt(mean) + 30) AS BIGINT) + 1)) AS k FROM m),
        p AS (SELECT grp, mean, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS p FROM k),
        f AS (SELECT grp, mean, k, sum(p) OVER (PARTITION BY grp ORDER BY k) AS cdf FROM p),
        c AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, f.mean, d.u, list(f.cdf) AS cdfs
              FROM d JOIN f ON d.grp IS NOT DISTINCT FROM f.grp GROUP BY ALL),
        n AS (SELECT doc_id, text, lang, source, n_chars, round(mean, 6) AS mean, len(list_filter(cdfs, lambda x: x <= u)) AS copies FROM c),
        e AS (SELECT *, unnest(range(1, copies + 1)) AS copy_no FROM n)
        SELECT *, md5('0:' || coalesce(doc_id::VARCHAR, '') || '#' || copy_no) AS shuffle_key FROM e
    """,
    "op2_repetition_coverage": repetition_sql("documents"),
    "op3_hamming_top_k": f"""
        WITH s AS (SELECT DISTINCT vec_id, [coalesce(embedding[i + 1] >= 0, false) FOR i IN range(64)] AS bits
                   FROM embeddings WHERE embedding IS NOT NULL),
        d AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id,
                     len(list_filter(list_zip(q.bits, r.bits), lambda p: p[1] <> p[2])) AS distance
              FROM s q, s r WHERE q.vec_id % 100 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank, neighbour_id, distance
        FROM d QUALIFY rank <= {TOP_K}
    """,
    "op6_bayes_near_duplicates": near_duplicates_sql("documents"),
    "op11_conversation_repair": conversations_sql("conversations"),
    "op12_ngram_jaccard_join": near_duplicates_sql("documents", ngramjoin.WORDS, ngramjoin.SIMILARITY_PCT, kept=False),
    "op13_fill_in_middle": fill_in_middle_sql("documents"),
    "op4_warc_segments": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body)) AS n, sha256(body) AS digest FROM p),
        r AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM r
    """,
}
