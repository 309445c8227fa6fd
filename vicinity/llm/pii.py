"""Operator 5, personal data: weak supervision.  DataFrame functions only.

1. Patterns find the base spans, and a wider pattern finds further candidates (local phone numbers,
   names after a title, bank account numbers, long numbers).
2. Labelers vote on every candidate: pattern, checksum, gazetteer, context words, clean borders.
3. Expectation-maximisation over the counts of vote patterns (at most kinds x 2**labelers rows)
   estimates how reliable each labeler is; it runs as one fold inside Spark SQL.
4. Each candidate's posterior is a soft label, from which a naive Bayes classifier over features of
   the span (kind, length, digits, borders, context) is trained by grouped sums.
5. Base spans stay; other candidates become spans where the classifier favours them.

``split`` and ``regexp_extract_all`` with one expression give the text between and in the matches,
hence positions in code points.  The texts are read once, no text is shuffled, and expressions use
possessive quantifiers and run starts only, so that long runs of digits or letters stay linear.

Rules for odd input: a null text counts as empty and has no spans; repeated rows and ids give one
result row each; an empty table gives an empty result; with no candidates nothing is trained; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import cut_lineage

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("name", "iban", "phone_local", "account")
KINDS = BASE_KINDS + MORE_KINDS

#: The base patterns, in the form that Java matches in linear time.
_LOCAL = "A-Za-z0-9._%+-"
_PATTERN = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Señor|Señora|Sr|Sra"
_CAPITALISED = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,30}"
_MORE = {
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.?\x20{_CAPITALISED}(?:\x20{_CAPITALISED})?",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone_local": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "account": r"(?<![0-9])[0-9]{9,19}(?![0-9])",
}
_MORE_PATTERN = "|".join(f"(?:{p})" for p in _MORE.values())

#: Gazetteers and context words.
DOMAIN_ENDS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|us"
COUNTRY_CODES = "1|33|34|39|41|43|44|49|52|54|57"
IBAN_COUNTRIES = "AT|BE|CH|DE|ES|FR|GB|IE|IT|LU|NL|PT"
CONTEXT_WORDS = ("account|address|adresse|appel|call|card|carte|contact|correo|credit|e-?mail|fax|handy|host|iban|ip|konto|"
                 "mail|mobile|nombre|phone|server|t[eé]l|telefon|t[eé]l[eé]phone|tarjeta|visa|write")

LABELERS = ("pattern", "checksum", "gazetteer", "context", "borders")
#: Chance that a labeler fires on personal data and on other text, before anything is estimated.
START = (0.7, 0.3)
EM_STEPS = 30
CONTEXT_CHARS = 24


def _hits(pattern: str, needs: str | None) -> Column:
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    return F.when(F.contains(F.col("text"), F.lit(needs)), found).otherwise(F.array().cast("array<string>")) if needs else found


def _positions(name: str) -> str:
    """Start of each match, by summing the lengths of what lies between and in the matches."""
    return f"""aggregate(sequence(0, size(hits_{name}) - 1), named_struct('at', 0, 'out', cast(array() as array<int>)),
        (s, i) -> named_struct('at', s.at + length(between_{name}[i]) + length(hits_{name}[i]),
                               'out', array_append(s.out, s.at + length(between_{name}[i]))),
        s -> s.out)"""


def _luhn(digits: str) -> str:
    doubled = f"cast(substr({digits}, -i, 1) as int) * 2"
    return f"""aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if(i % 2 = 1,
        cast(substr({digits}, -i, 1) as int), {doubled} - if({doubled} > 9, 9, 0))) % 10 = 0"""


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_VALID = {
    "email": "true",
    "ip": f"m rlike '^{_BYTE}([.]{_BYTE}){{3}}$'",
    "card": f"length({_DIGITS}) between 16 and 19 and {_luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) between 8 and 15",
}


def _candidates(name: str, kind: str) -> str:
    """Structs ``kind, s, e, m, before, after`` of the matches found under ``name``."""
    return f"""if(size(hits_{name}) = 0, cast(array() as array<struct<kind:int,s:int,e:int,m:string,before:string,after:string>>),
        transform(hits_{name}, (m, i) -> named_struct(
            'kind', {kind}, 's', starts_{name}[i], 'e', starts_{name}[i] + length(m), 'm', m,
            'before', right(between_{name}[i], {CONTEXT_CHARS}), 'after', left(between_{name}[i + 1], 1))))"""


def _more_kind() -> str:
    """Which of the wider patterns a match came from."""
    tests = " ".join(f"when m rlike r'^(?:{p})$' then {KINDS.index(k)}" for k, p in _MORE.items())
    return f"case {tests} else {KINDS.index('account')} end"


def find_candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, found)``: base spans that pass their checks and the candidates that overlap none."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sources = {**{k: (p, {"email": "@", "phone": "+", "ip": "."}.get(k)) for k, p in _PATTERN.items()}, "more": (_MORE_PATTERN, None)}
    rows = rows.select("*", *(_hits(p, needs).alias(f"hits_{k}") for k, (p, needs) in sources.items()))
    rows = rows.select("*", *(
        F.when(F.size(f"hits_{k}") > 0, F.split("text", p, -1)).alias(f"between_{k}") for k, (p, _) in sources.items()))
    rows = rows.select("doc_id", *(f"hits_{k}" for k in sources), *(f"between_{k}" for k in sources), *(
        F.expr(f"if(size(hits_{k}) = 0, cast(array() as array<int>), {_positions(k)})").alias(f"starts_{k}") for k in sources))
    base = ", ".join(
        f"filter({_candidates(k, str(KINDS.index(k)))}, c -> {_VALID[k].replace('(m,', '(c.m,').replace('m rlike', 'c.m rlike')})" for k in BASE_KINDS)
    rows = rows.select("doc_id", F.expr(f"concat({base})").alias("base"), F.expr(_candidates("more", _more_kind())).alias("more"))
    return rows.select("doc_id", "base", F.expr(
        "filter(more, c -> not exists(base, b -> b.s < c.e and b.e > c.s))").alias("more"))


def _votes() -> str:
    digits = _DIGITS.replace("(m,", "(c.m,")
    k = {name: KINDS.index(name) for name in KINDS}
    checks = {
        "pattern": f"c.kind < {len(BASE_KINDS)}",
        "checksum": f"""case when c.kind in ({k['card']}, {k['account']}) then length({digits}) >= 12 and {_luhn(digits)}
            when c.kind = {k['email']} then c.m rlike '[.][A-Za-z]{{2,}}$'
            when c.kind = {k['iban']} then length(replace(c.m, ' ', '')) between 15 and 34
            when c.kind = {k['phone_local']} then c.m rlike '^[(]?[2-9]' else c.kind < {len(BASE_KINDS)} end""",
        "gazetteer": f"""case when c.kind = {k['email']} then c.m rlike '(?i)[.]({DOMAIN_ENDS})$'
            when c.kind = {k['phone']} then c.m rlike '^[+]({COUNTRY_CODES})'
            when c.kind = {k['iban']} then c.m rlike '^({IBAN_COUNTRIES})'
            when c.kind = {k['name']} then true when c.kind = {k['card']} then c.m rlike '^[3-6]'
            when c.kind = {k['ip']} then not c.m rlike '^(0|127|255)[.]' else false end""",
        "context": f"c.before rlike '(?i)(^|[^\\\\p{{L}}])({CONTEXT_WORDS})[^\\\\p{{L}}]'",
        "borders": "(c.before = '' or c.before rlike '[^\\\\p{L}\\\\p{N}]$') and (c.after = '' or not c.after rlike '[\\\\p{L}\\\\p{N}]')",
    }
    return "array(" + ", ".join(f"cast(coalesce({checks[name]}, false) as int)" for name in LABELERS) + ")"


def _features() -> str:
    """Names of the feature values of a candidate; a few dozen in all."""
    return """array(
        concat('kind=', c.kind),
        concat('length=', least(length(c.m) div 4, 9)),
        concat('digits=', 4 * length(regexp_replace(c.m, '[^0-9]', '')) div length(c.m)),
        concat('before=', case when c.before = '' then 'none' when c.before rlike '[\\\\p{L}\\\\p{N}]$' then 'word' when c.before rlike '\\\\s$' then 'space' else 'mark' end),
        concat('after=', case when c.after = '' then 'none' when c.after rlike '[\\\\p{L}\\\\p{N}]' then 'word' when c.after rlike '\\\\s' then 'space' else 'mark' end),
        concat('context=', votes[3]))"""


def estimate_reliabilities(patterns: DataFrame, steps: int = EM_STEPS) -> dict[str, object] | None:
    """EM over ``(votes, n)``: prior, and for each labeler its rate of firing on either class.

    ``patterns`` has at most 2**labelers rows; the whole estimation is one fold over their array.
    """
    hit, false = START
    start = ", ".join([f"{hit}D"] * len(LABELERS)), ", ".join([f"{false}D"] * len(LABELERS))

    def likelihood(rates: str) -> str:
        return f"aggregate(zip_with(p.votes, s.{rates}, (v, r) -> if(v = 1, r, 1 - r)), 1D, (a, x) -> a * x)"

    posterior = f"s.prior * {likelihood('hit')} / (s.prior * {likelihood('hit')} + (1 - s.prior) * {likelihood('miss')})"
    labelers = f"sequence(0, {len(LABELERS) - 1})"
    rates = "transform({l}, j -> (aggregate(w, 1D, (a, p) -> a + {x} * p.votes[j])) / (aggregate(w, 2D, (a, p) -> a + {x})))"
    update = f"""named_struct(
        'prior', (aggregate(w, 1D, (a, p) -> a + p.w)) / (aggregate(w, 2D, (a, p) -> a + p.n)),
        'hit', {rates.format(l=labelers, x='p.w')},
        'miss', {rates.format(l=labelers, x='(p.n - p.w)')})"""
    weighted = f"transform(patterns, p -> named_struct('votes', p.votes, 'n', p.n, 'w', p.n * {posterior}))"
    fold = f"""aggregate(sequence(1, {steps}),
        named_struct('prior', 0.5D, 'hit', array({start[0]}), 'miss', array({start[1]})),
        (s, step) -> element_at(transform(array({weighted}), w -> {update}), 1))"""
    row = patterns.select("votes", F.col("n").cast("double").alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns")).where("size(patterns) > 0")
    found = row.select(F.expr(fold).alias("em")).select("em.*").first()
    return None if found is None else found.asDict()


def _posterior(em: dict[str, object]) -> Column:
    def likelihood(rates: list[float]) -> Column:
        out = F.lit(1.0)
        for j, r in enumerate(rates):
            out = out * F.when(F.col("c.votes")[j] == 1, F.lit(r)).otherwise(F.lit(1 - r))
        return out

    yes, no = F.lit(em["prior"]) * likelihood(em["hit"]), F.lit(1 - em["prior"]) * likelihood(em["miss"])
    return yes / (yes + no)


def train_classifier(candidates: DataFrame, em: dict[str, object]) -> tuple[float, dict[str, float]]:
    """Naive Bayes on soft labels: prior log-odds and log-odds by feature value (a few dozen rows)."""
    soft = candidates.select(_posterior(em).alias("w"), "c.features")
    sums = soft.select("w", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("w").alias("yes"), F.sum(1 - F.col("w")).alias("no"))
    family = F.substring_index("feature", "=", 1)
    totals = sums.groupBy(family.alias("family")).agg(
        F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"), F.count("*").alias("values"))
    odds = sums.join(F.broadcast(totals), family == F.col("family")).select(
        "feature", "family", "all_yes", "all_no",
        F.expr("ln((yes + 1) / (all_yes + values)) - ln((no + 1) / (all_no + values))").alias("odds"),
        F.expr("ln((all_yes + 1) / (all_no + 1))").alias("prior")).collect()
    return (odds[0]["prior"] if odds else 0.0), {r["feature"]: r["odds"] for r in odds}


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts and digest, all spans, and how many the method added."""
    votes, features = _votes(), _features()
    judged = "transform({a}, c -> element_at(transform(array({v}), votes -> named_struct('kind', c.kind, 's', c.s, 'e', c.e, 'votes', votes, 'features', {f})), 1))"
    found = find_candidates(docs, id_col, text_col)
    found = cut_lineage(found.select(
        "doc_id", *(F.expr(judged.format(a=a, v=votes, f=features)).alias(a) for a in ("base", "more"))), "pii-candidates")
    candidates = found.select(F.explode(F.concat("base", "more")).alias("c"))
    em = estimate_reliabilities(candidates.groupBy("c.votes").agg(F.count("*").alias("n")))
    more = F.expr("filter(more, c -> false)")
    if em is not None:
        prior, odds = train_classifier(candidates, em)
        table = F.create_map(*(F.lit(x) for pair in sorted(odds.items()) for x in pair))
        more = F.filter("more", lambda c: F.aggregate(c["features"], F.lit(prior), lambda a, f: a + F.coalesce(table[f], F.lit(0.0))) > 0)
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"

    def shown(spans: str) -> Column:
        return F.expr(f"""array_join(transform(
            array_sort(transform({spans}, c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e))),
            c -> concat_ws(':', {names}[c.kind], c.s, c.e)), ',')""")

    rows = found.withColumn("more", more)
    return rows.select(
        "doc_id",
        *(F.expr(f"size(filter(base, c -> c.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)),
        F.sha2(shown("base"), 256).alias("base_sha256"),
        shown("concat(base, more)").alias("spans"),
        F.size("more").cast("long").alias("n_added"))
