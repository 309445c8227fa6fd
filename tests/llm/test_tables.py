"""Operators 1, 3, 4, 6, 10 and the pipeline against plain Python and DuckDB, with odd input."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from tools.compare import TABLES, digest
from vicinity.llm import components, hamming, mixing, neardup, packing, pretoken, queries, warc

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    rows, res = [tuple(r) for r in df.collect()], con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert digest(rows, df.columns) == digest(res.fetchall(), res.columns)


def test_every_operator_is_registered():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()


# ---- 1: mixing

def test_mixing(spark):
    rows = [(i, "x" * (i % 7), f"s{i % 3}") for i in range(600)] + [(None, "abc", None), (700, None, "s1"), (5, "x" * 5, "s2")]
    weights = {"s0": 5.0, "s1": 0.5}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'mine' AS copies", "9 AS cdf", "8 AS group", "7 AS _u")
    got = mixing.mix(df, weights, 1.0, epochs=2.0, seed=4).collect()
    means = brute.mixing_means([(s, t) for _, t, s in rows], weights, 1.0, 2.0)
    want = Counter()
    for i, t, s in rows:
        want[i, t, s] += brute.poisson_count(i, means[s if s in weights else None], 4)
    assert Counter((r.doc_id, r.text, r.source) for r in got) == +want
    assert {r["cdf"] for r in got} == {9} and all(1 <= r.copy_no <= r.copies for r in got)
    keys = {hashlib.md5(f"4:{'' if r.doc_id is None else r.doc_id}#{r.copy_no}".encode()).hexdigest() for r in got}
    assert {r.shuffle_key for r in got} == keys


def test_mixing_large_mean_and_empty(spark):
    rows = [(i, "ab", "rare") for i in range(3)] + [(10 + i, "ab" * 400, "big") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in mixing.mix(df, {"rare": 1.0, "big": 1.0}).collect())
    means = brute.mixing_means([(s, t) for _, t, s in rows], {"rare": 1.0, "big": 1.0}, 0)
    assert means["rare"] > 1000 and got == +Counter({i: brute.poisson_count(i, means[s]) for i, _, s in rows})
    assert mixing.mix(df.limit(0), {"rare": 1.0}).count() == 0
    assert mixing.mix(df, {}, 1.0).columns == [*df.columns, "mean", "copies", "copy_no", "shuffle_key"]


def test_mixing_runs_no_python(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.mix(df, queries.MIX_WEIGHTS, queries.MIX_OTHER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# ---- 3: exact top-k

def brute_top_k(rows, query_rows, k):
    want = set()
    for qid, q in query_rows:
        found = sorted({(bin((q ^ c) & (2**64 - 1)).count("1"), i) for i, c in rows if c is not None and i is not None})[:k]
        want |= {(qid, rank, i, d) for rank, (d, i) in enumerate(found, 1)}
    return want


@pytest.mark.parametrize("segments", [None, 1, 3, 8])
def test_hamming(spark, segments):
    rng = random.Random(segments or 0)
    signed = [rng.getrandbits(16) * 3 - 2**15 for _ in range(200)] + [-1, 0, 2**63 - 1, -(2**63)]
    rows = [(i, c) for i, c in enumerate(signed)] + [(1000 + i, signed[0]) for i in range(500)] + [(2000, None), (3, signed[3])]
    bits = 64
    if segments == 1:
        rows, bits = [(i, c & 1023 if c is not None else None) for i, c in rows], 10
    query_rows = [(i, c) for i, c in rows[:12] + rows[202:206]] + [(9999, None)]
    df = spark.createDataFrame(rows, "id long, code long").selectExpr("*", "1 AS distance", "2 AS `key`", "3 AS place")
    qs = spark.createDataFrame(query_rows, "id long, code long")
    got = hamming.top_k(df, qs, 7, "id", "code", "id", "code", bits, segments, step=8)
    assert {tuple(r) for r in got.collect()} == brute_top_k(rows, {(i, c) for i, c in query_rows if c is not None}, 7)


def test_hamming_few_rows_and_empty(spark):
    df = spark.createDataFrame([(1, 5), (2, 7)], "id long, code long")
    got = hamming.top_k(df, df, 5, "id", "code", "id", "code", step=16).collect()
    assert len(got) == 4
    assert hamming.top_k(df.limit(0), df, 5, "id", "code", "id", "code", step=32).count() == 0
    assert hamming.top_k(df, df.limit(0), 5, "id", "code", "id", "code", step=32).count() == 0


def test_radii_cover():
    for m in (1, 3, 5, 8):
        for covered in range(40):
            per = hamming.radii(covered, m)
            assert sum(r + 1 for r in per) == covered + 1  # one bit more must reach some segment


def test_sign_code(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0, None],), (None,), ([],), ([-1.0] * 70,), ([1.0] * 70,)], "v array<double>")
    assert [r[0] for r in df.select(hamming.sign_code("v")).collect()] == [5, None, 0, 0, -1]


# ---- 4: WARC

def test_warc(spark):
    big = "é€x\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(1, "u", "a" * 200), (2, None, "a" * 200), (3, "u b\n", None), (4, "u", "short"), (5, "u", "short"), (6, "u", big), (7, "u", big),
            (7, "u", big), (8, "", big + "1"), (8, "", big + "2"), (None, "u", big), (9, "u", ""), (10, "u", "b" * 99), (11, "u", "b" * 99)]
    rows += [(100 + i, "u", "hot" * 60) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7).selectExpr("*", "1 AS digest", "2 AS id", "3 AS record")
    path = warc.archive_path(spark)
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path, with_payload=True).collect()
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None and len(body) >= 100:
            first[body] = min(first.get(body, i), i)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = i is not None and body in first and i != first[body]
        want.append((None if i is None else str(i), len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response",
                     str(first[body]) if again else None))
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert warc.read_records(spark, path).where("kind = 'continuation'").count() > 10


def test_warc_empty(spark):
    path = warc.archive_path(spark)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_chunked_framing():
    for size in (1, 7, 4096):
        for body in (b"", b"x", b"0\r\n\r\n" * 50, bytes(range(256)) * 40):
            assert warc.dechunk(warc._chunked(body, size)) == body
    for broken in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n0\r\n"):
        with pytest.raises(ValueError):
            warc.dechunk(broken)


# ---- 6: near-duplicates

def near_corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    texts, passage = {}, text(60)
    for i in range(60):
        texts[i] = " ".join(text(rng.randint(1, 120)))
    hot = text(100)
    for i in range(100, 260):  # a large group of near copies around one text
        words = list(hot)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(100)] = rng.choice(vocabulary)
        texts[i] = " ".join(words)
    for i in range(300, 330):  # texts that share a passage but are no copies
        texts[i] = " ".join(passage + text(rng.randint(30, 60)))
    for i in range(400, 440):  # exact copies, with other case and space
        texts[i] = texts[3].upper() if i % 2 else texts[3].replace(" ", "\n")
    chain = text(80)
    for i in range(500, 540):  # a chain: neighbours are near, ends are not
        chain = list(chain)
        chain[(2 * i) % 80] = f"c{i}"
        texts[i] = " ".join(chain)
    texts |= {600: None, 601: "", 602: " \t", 603: "one two", 604: "One Two", 605: "one two three four five", 606: "É é", 607: "é é"}
    return texts


def test_near_duplicates(spark):
    texts = near_corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5).selectExpr("*", "1 AS node", "2 AS bands", "3 AS kept")
    got = neardup.near_duplicates(df).collect()
    want = brute.near_components(texts)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(texts)
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(brute.shingles(texts[r.doc_id])) for r in got)
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == sorted(set(want.values()))


def test_near_duplicates_odd_input(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b C d e f"), (3, None), (3, None), (4, "long " * 50_000), (5, "long " * 60_000)]
    got = Counter(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == Counter({(1, 2, 1, True): 2, (2, 2, 1, False): 1, (3, 0, 3, True): 2, (4, 1, 4, True): 1, (5, 1, 4, False): 1})


def test_keep_one_decides_by_row(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    a, b, c, d, e = (" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(5))
    rows = [(1, a, "x")] * 3                             # repeated rows
    rows += [(None, b, "x")] * 2                         # copies without an id
    rows += [(None, c, "null"), (4, c + " end", "four")]  # a null id comes after all others
    rows += [(5, d, "first"), (9, d + " end", "copy"), (9, e, "clean")]  # one id, two texts
    rows += [(None, None, "x")] * 2 + [(7, "", "x")] * 2  # empty sets are no copies of each other
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    got = neardup.keep_one(df)
    assert got.columns == df.columns and [f.dataType for f in got.schema] == [f.dataType for f in df.schema]
    want = [(1, a, "x"), (None, b, "x"), (4, c + " end", "four"), (5, d, "first"), (9, e, "clean")]
    assert Counter(map(tuple, got.collect())) == Counter(want + [(None, None, "x")] * 2 + [(7, "", "x")] * 2)
    only = df.select("text", "doc_id")  # no other columns, another order
    assert Counter(map(tuple, neardup.keep_one(only).collect())) == Counter((t, i) for i, t, _ in want + [(None, None, "x")] * 2 + [(7, "", "x")] * 2)


def test_bayes_limits_miss_rarely():
    limits = neardup.bayes_limits(16, 0.85)
    assert limits == sorted(limits)
    rng = np.random.default_rng(0)
    differing = rng.random((50_000, 1024)) < (1 - 0.85) / 2
    ok = np.ones(len(differing), bool)
    for n, most in enumerate(limits, 1):
        ok &= differing[:, :64 * n].sum(axis=1) <= most
    assert (~ok).mean() < 1e-4
    far = rng.random((20_000, 1024)) < (1 - 0.7) / 2
    assert (far.sum(axis=1) <= limits[-1]).mean() < 0.01
    assert (far[:, :192].sum(axis=1) <= limits[2]).mean() > 0.5  # three batches alone do not tell


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 300)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(300)]
    links += [(7, 7), (1000, 1001), (1001, 1000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {n: n for link in links for n in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    alone = {n for n in parent if all(u == v for u, v in links if n in (u, v))}
    assert got == {n: find(n) for n in parent if n not in alone}


# ---- 10: packing

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(pretoken.default_path())


def check_packing(rows, got, library):
    ids = defaultdict(list)
    for i, text in rows:
        ids[i].append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    want = Counter()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, versions in ids.items():
        n_tokens = Counter(len(v) for v in versions)
        assert sum(r.length for r in pieces[i]) == sum(map(len, versions))
        assert {r.doc_tokens for r in pieces[i]} == set(n_tokens)
        for r in pieces[i]:
            assert any(zlib.crc32(np.array(v[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for v in versions if len(v) == r.doc_tokens)
        covered = Counter()
        for r in pieces[i]:
            for at in range(r.start, r.start + r.length):
                covered[r.doc_tokens, at] += 1
        want = Counter({(n, at): c for n, c in n_tokens.items() for at in range(n)})
        assert covered == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    padding = 0
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        at = 0
        for r in rs:
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / max(1, padding + sum(r.length for r in got))


def test_packing(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    rows = docs + docs[:20] + [(5000, None), (5001, ""), (5002, "word " * 2047), (5003, "word " * 2048), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "1 AS length", "2 AS rank", "3 AS sequence_id")
    assert check_packing(rows, packing.pack(df).collect(), library) < 0.02


def test_packing_awkward_lengths(spark, library):
    rows = [(i, "word " * 700) for i in range(400)] + [(1000 + i, "word " * (1100 + i % 50)) for i in range(200)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert check_packing(rows, got, library) < 0.02


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("histogram", [{7: 1}, {1300: 1000}, {2048: 3, 1: 5}, {1024: 9}, {n: 1 + n % 5 for n in range(1, 2049, 9)}, {}])
def test_plans_cover_the_histogram(histogram):
    plan, cut = packing.plan_sequences(histogram, 2048)
    made = Counter()
    for pattern, times in plan:
        assert sum(s * k for s, k in pattern.items()) <= 2048
        for s, k in pattern.items():
            made[s] += k * times
    want = Counter(histogram)
    for s, k in cut.items():
        want[s] -= k
        for p in packing.binary_parts(s):
            want[p] += k
    assert made == +want


@pytest.mark.parametrize("name", ["middle", "uniform", "lognormal", "one length"])
def test_column_generation_reaches_the_bound(name):
    draw = np.random.default_rng(1)
    lengths = {"middle": lambda: draw.integers(700, 1101, 50_000), "uniform": lambda: draw.integers(1, 2049, 20_000),
               "lognormal": lambda: np.clip(draw.lognormal(6, 1, 20_000).astype(int), 1, 2048),
               "one length": lambda: np.append(draw.integers(1, 2049, 10_000), [700] * 5_000)}[name]()
    histogram = {int(k): v for k, v in Counter(lengths.tolist()).items()}
    sizes = np.array(sorted({*histogram, *(1 << k for k in range(12))}), np.int64)
    solution = packing.solve_patterns(sizes, np.array([histogram.get(int(s), 0) for s in sizes]), 2048)
    assert solution.entered > 0 and solution.priced >= solution.entered
    least = sum(s * n for s, n in histogram.items()) / 2048
    assert solution.cost @ solution.x <= 1.002 * least
    assert sum(times for _, times in packing.plan_sequences(histogram, 2048)[0]) <= 1.005 * least


# ---- pipeline

def test_pipeline(spark, tmp_path, library):
    import corpus_pipeline

    en, de = "the cat and a dog sat on that mat while it rained all day".split(), "der hund und die katze schlafen im haus wenn es regnet".split()
    rng = random.Random(8)
    rows = []
    for i in range(160):
        words = [rng.choice(en if i % 2 else de) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(words), "en" if i % 2 else "de", f"src{i % 4}", 0))
    rows += [(200 + i, rows[7][1], "en", "src0", 0) for i in range(50)]
    rows += [(300, "a dog and token=0123456789abcdef0123456789 the cat", None, None, None), (301, None, None, "src1", None), (302, "12 34", "en", "src1", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))

    texts = {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    component = brute.near_components(texts)
    kept = {i: t for i, t in texts.items() if component[i] == i}
    for i, t in kept.items():
        spans = brute.secret_spans(t)
        if spans:
            kept[i] = t[:min(s for s, _, _ in spans)] + "[SECRET]" + t[max(e for _, _, e in spans):]
    assert "[SECRET]" in kept[300]
    source = {r[0]: r[3] for r in rows}
    means = brute.mixing_means([(source[i], t) for i, t in kept.items()], queries.MIX_WEIGHTS, queries.MIX_OTHER)
    mixed = [(i, t) for i, t in kept.items()
             for _ in range(brute.poisson_count(i, means[source[i] if source[i] in queries.MIX_WEIGHTS else None]))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(mixed, got, library)
    assert Counter(r.doc_id for r in got if r.start + r.length == r.doc_tokens) == Counter(i for i, _ in mixed)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns, name
