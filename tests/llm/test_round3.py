"""Operators 11, 12, 13 and the hub comparisons against plain Python, with odd input."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from vicinity.llm import conversations, fim, hubs, neardup, ngramjoin, wordscan

SPACE = " \t\n\v\f\r"


# ---- 11: conversations

def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if key:
            text = "" if key == 1 else re.sub("[.!?]", "", text) if key == 2 else text
            out += [(conv, turn, "user" if key == 4 else role, text)] * (2 if key == 3 else 1)
    return out


def repaired(rows):
    """Least (cost, edits, lines) over all edit scripts, kept as whole strings for each state of the grammar."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        shown = text.strip(SPACE)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(layer):
        out = dict(layer)
        for _ in range(4):
            for q, (cost, edits, lines) in list(out.items()):
                to = after[q]
                way = (cost + 2, edits + "I", lines + [name[to] + ":"])
                out[to] = min(out.get(to, way), way)
        return out

    layer = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        ways = {}
        for q, (cost, edits, lines) in inserted(layer).items():
            options = [(q, 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] == after[q] or (q, role[:1]) == ("", "s"):
                    options.append((role[:1], extra, "K", [f"{role}:{text}"]))
                options.append((after[q], 2 + extra, "R", [f"{name[after[q]]}:{text}"]))
            for to, more, edit, line in options:
                way = (cost + more, edits + edit, lines + line)
                ways[to] = min(ways.get(to, way), way)
        layer = ways
    cost, edits, lines = min(v for q, v in inserted(layer).items() if q in ("", "a"))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, edits,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_conversations(spark):
    rng = random.Random(5)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Yes.", "No", "", " \t", "Why?  ", "é!", None, "x y."]
    rows = [(c if c % 40 else None, rng.choice([None, *range(6)]), rng.choice(roles[:3] * 4 + roles), rng.choice(texts))
            for c in range(200) for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS conv", "1 AS key", "2 AS nth")
    got = {r[0]: tuple(r[1:]) for r in conversations.repair(conversations.damage(df.repartition(5))).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        mine = damaged([r for r in rows if r[0] == conv])
        want[conv] = repaired(sorted(mine, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])))
    assert got == want


def test_giant_conversation_spills_across_batches():
    """Batches of few rows and a spool of few bytes give what one large batch gives."""
    rng = random.Random(1)
    n = 3000
    rows = pd.DataFrame({"conv_key": ["a"] * n, "null_turn": [False] * n, "turn": list(range(n)),
                         "role": [rng.choice(["user", "assistant", "system"]) for _ in range(n)],
                         "text": [rng.choice(["Yes.", "No", ""]) + str(i % 7) + rng.choice([".", ""]) for i in range(n)],
                         "dropped": [rng.random() < 0.1 for _ in range(n)], "nth": [1 + (rng.random() < 0.1) for _ in range(n)]})
    whole = pd.concat(conversations._stream(iter([rows])))
    old, conversations.SPILL_BYTES = conversations._Spool.__init__.__defaults__, 64
    conversations._Spool.__init__.__defaults__ = (64,)
    try:
        parts = pd.concat(conversations._stream(rows.iloc[i:i + 7] for i in range(0, n, 7)))
    finally:
        conversations._Spool.__init__.__defaults__ = old
    assert len(whole) == 1 and whole.values.tolist() == parts.values.tolist()
    assert len(whole.audit[0].replace("I", "")) == (~rows.dropped).sum()


def test_conversations_empty(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversations.repair(conversations.damage(df)).collect() == []
    one = spark.createDataFrame([("é", None, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    assert conversations.repair(conversations.damage(one)).first().conv_id == "é"


# ---- 13: fill in middle

def test_fill_in_middle(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "😀é\n", "has <P> inside", "<S>", "a<", "<M", "$1 \\ $", "x" * 5000, "é😀" * 3000, ">S><S"]
    texts += ["".join(rng.choice("ab<>PSM$\n é😀") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "nobody"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'q' AS form", "2 AS a", "3 AS third")
    out = fim.transform(df)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    want = []
    for i, t in rows:
        t = t or ""
        h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        plain = not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        p, m, s = t[:a], t[a:b], t[b:]
        made = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want.append((i is None, i or 0, len(t), form, None if plain else a, None if plain else b - a, made))
    assert got == sorted(want, key=lambda r: (r[0], r[1])) or sorted(map(repr, got)) == sorted(map(repr, want))
    back = fim.with_digests(out).groupBy("doc_id").agg({"restored_sha256": "max"}).collect()
    known = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows}
    assert {r[0]: r[1] for r in back} == known
    assert fim.transform(df.limit(0)).collect() == []


# ---- 12, 6: joins on sets

def brute_components(rows, n_words, pct):
    """Component of each row, named by the smallest id; rows without words stand alone."""
    sets = [hubs.shingle_set(t or "", n_words) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j]):
            group[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 9)}" if rng.random() < 0.7 else rng.choice(["the", "of", "and"])
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(9)
    base = [f"v{rng.randrange(400)}" for _ in range(150)]
    rows = [(i, edited(rng, base, rng.choice([0, 1, 1, 2, 3, 4, 6, 9]))) for i in range(150)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, passage + " " + " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randint(5, 200)))) for i in range(60)]
    chain = [f"c{i}" for i in range(300)]
    rows += [(2000 + i, " ".join(chain[i * 6:i * 6 + 200])) for i in range(16)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "One two"), (3004, "one TWO"), (3005, "one"), (3006, "a b c"), (3007, "A B C"),
             (None, "a b c"), (3007, "A B C"), (3008, passage), (3009, passage + " end")]
    return rows


@pytest.mark.parametrize("most", [1 << 24, 3])
def test_ngram_join(spark, copies, most, monkeypatch):
    """Also where tasks are told of few tokens only: results do not depend on it."""
    monkeypatch.setattr(ngramjoin.frequencies, "__defaults__", (4, min(most, 50), most))
    df = spark.createDataFrame(copies, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS key", "3 AS digest").repartition(3)
    got = [tuple(r) for r in ngramjoin.jaccard_components(df).collect()]
    assert sorted(got, key=repr) == brute_components(copies, 3, 90)


def test_near_duplicates_of_edited_copies(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    got = [tuple(r)[:3] for r in neardup.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == brute_components(copies, 5, 85)


def test_ngram_join_moves_no_texts_to_pick_classes(spark, copies, monkeypatch):
    """More classes than a broadcast list may hold: rows are picked by bitmaps, and their texts stay where they are."""
    from vicinity.operators import broadcast
    plans = {}

    def written(df, tag="t", write=ngramjoin.cut_lineage):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, tag)

    monkeypatch.setattr(ngramjoin, "cut_lineage", written)
    monkeypatch.setattr(broadcast, "MAX_BROADCAST_BYTES", 13_000)  # three bitmaps, or 180 numbers
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in ngramjoin.jaccard_components(df).collect()]
    assert sorted(got, key=repr) == brute_components(copies, 3, 90)
    for tag in ("signatures", "token-counts", "member-texts"):
        assert not [x for x in plans[tag].splitlines() if "Exchange hashpartitioning(node" in x], plans[tag]


@pytest.mark.parametrize("limit", [None, 1])
def test_rows_among(spark, limit):
    """By bitmaps and, beyond the limit, by a join: numbers at the ends of bitmaps, of many partitions, repeated rows and nulls."""
    from vicinity.llm.common import rows_among
    at = [0, 1, 7, 8, 63, 64, 32767, 32768, 65535, (1 << 33) - 1, 1 << 33, (5 << 33) + 40_000, (1 << 62) + 3]
    rows = spark.createDataFrame([(n, f"t{n}") for m in at for n in (m, m + 1)] + [(7, "again"), (None, "none")], "node long, text string")
    numbers = spark.createDataFrame([(n,) for n in at[::2]], "node long")
    got = rows_among(rows, numbers, "node", limit_bytes=limit)
    assert got.columns == rows.columns
    want = [tuple(r) for r in rows.collect() if r.node in at[::2]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert rows_among(rows, numbers.limit(0), "node", limit_bytes=limit).collect() == []


def test_token_map_grows_with_the_repeated_tokens(spark, monkeypatch):
    """A map of a fixed size fills up, and tokens of one set look repeated."""
    monkeypatch.setattr(ngramjoin, "MAP_BITS", 10)
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, ngramjoin.COUNTED, 3000, dtype=np.int64)
    twice, once = tokens[:2000], tokens[2000:]
    known = ngramjoin.frequencies(spark.createDataFrame([(int(t),) for t in [*twice, *twice, *once]], "token long").repartition(4))
    assert known.complete and not len(known.frequent)
    assert (known.classes(twice.view(np.uint64)) == 1).all()
    assert (known.classes(once.view(np.uint64)) == 0).mean() > 0.8


def test_whole_prefixes(spark, copies):
    """Own shingles first, then missing ones, and last the common ones, of hubs with and without these; only the prefix is returned."""
    import pyarrow as pa
    rows = [(i, t) for i, (_, t) in enumerate(copies) if t and t.split()]
    sets = {n: s[0] for n, t in rows for _, _, s in hubs.hashed_sets(pa.array([t]), 3, wordscan.Powers())}
    apart = [n for n, t in rows if t.startswith("p0 ")]
    pairs = [(0, v) for v in range(1, 150)] + [(apart[0], v) for v in apart[1:]] + [(apart[1], 3)]
    common = {u: np.setxor1d(sets[u], sets[v])[::2].view(np.int64).tolist() for u, v in [(0, 5), (apart[0], apart[4])]}
    got = hubs.whole_prefixes(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(list(common.items()), "u long, common array<long>"),
                              spark.createDataFrame(rows, "node long, text string"), 90, 3)
    assert got.columns == ["u", "v", "prefix"]
    want = {}
    for u, v in pairs:
        own, missing = ([int(x) for x in sets[a].view(np.int64) if x not in set(sets[b].view(np.int64))] for a, b in ((v, u), (u, v)))
        late = set(common.get(u, []))
        order = [x for x in own if x not in late] + [x for x in missing if x not in late] + sorted(x for x in own + missing if x in late)
        want[u, v] = order[:10 * (len(sets[v]) + 100 * len(sets[v]) // 90) // 190 + 1]
    assert {(r.u, r.v): r.prefix for r in got.collect()} == want


def test_ngram_join_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngramjoin.jaccard_components(df).collect() == []


def test_signatures_of_similar_sets_meet():
    """Any two sets of the wanted similarity share a signature, whatever is known of frequencies."""
    rng = np.random.default_rng(4)
    for trial in range(300):
        n = int(rng.integers(9, 400))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        lost = int(rng.integers(0, max(1, len(x) // 10) + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[lost:], rng.integers(0, 1 << 62, lost, dtype=np.int64).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 90 * (len(x) + len(y) - both) or len(x) == both == len(y):
            continue
        known_tokens = np.sort(rng.choice(x, int(rng.integers(0, len(x) + 1)), replace=False))
        bits = np.full(1 << (ngramjoin.MAP_BITS - 6), np.iinfo(np.uint64).max if trial % 2 else 0, np.uint64)
        known = ngramjoin.Frequencies(bits, bool(trial % 2), known_tokens)
        assert len(np.intersect1d(ngramjoin.signatures(x, known), ngramjoin.signatures(y, known)))


def test_parities_bound_differences():
    rng = np.random.default_rng(8)
    for n in (3, 200, 2000):
        x, y = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)) for _ in range(2))
        y[:n // 2] = x[:n // 2]
        odd = sum(int(v).bit_count() for v in (hubs.parities(x) ^ hubs.parities(y)).view(np.uint64))
        assert odd <= len(np.setxor1d(x, y)) and len(hubs.folded(hubs.parities(x))) == hubs.PARITY


def test_words_that_one_modulus_confuses(spark):
    """Thue-Morse words and their complements have one hash modulo 2**64 for any base."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((word + other).encode(), np.uint8)
    block = wordscan.Block(data, np.array([0, 1024, 2048]), wordscan.Powers())
    a, b = block.run_hash(np.array([0, 1024]), np.array([1024, 2048]))
    assert a != b
    df = spark.createDataFrame([(1, f"{word} x y z q"), (2, f"{other} x y z q")], "doc_id long, text string")
    assert {r.component_id for r in neardup.near_duplicates(df).collect()} == {1, 2}


def test_head_of_frequencies_is_whole_classes(spark):
    from vicinity.llm.tokencount import most_frequent

    rows = [(f"a{i}", 1) for i in range(50)] + [(f"b{i}", 9) for i in range(5)] + [("c", 1000)]
    table = spark.createDataFrame(rows, "pre_token string, n long")
    found = {head: sorted(r.n for r in most_frequent(table, head).collect()) for head in (0, 1, 5, 6, 55, 56)}
    assert found == {0: [], 1: [1000], 5: [1000], 6: [9] * 5 + [1000], 55: [9] * 5 + [1000], 56: [1] * 50 + [9] * 5 + [1000]}
