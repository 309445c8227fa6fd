"""Operator 7, secret scans: novelty under a primed compressor.

Fixed patterns give the base spans.  The method adds strings that stand in a sensitive context and
do not compress: zstandard is primed with a dictionary of identifiers, and a candidate is measured
by the bytes it adds when the code around it is compressed with and without it.  A name built from
known parts adds little; random material adds nearly its own length.  Of NAME=value only the value
is measured, and a sensitive word in the name is context.  What follows a reported span directly, after
a dot or alone on the next line, is in its context, and so is all between sensitive BEGIN and END lines.

Each text is scanned alone, inside Arrow batches; nothing is shuffled or collected.

Rules for odd input: a null text counts as empty and has no spans; repeated rows and ids give one
result row each; an empty table gives an empty result; other columns are not read, and the columns
that a caller keeps may not be named like the result's own.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vicinity.llm.common import ship_by_value

KINDS = ("assign", "access", "hex", "novel")

#: The base patterns.  Lengths are part of them where that changes no match.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
MIN_VALUE = 6

#: Words that make a context sensitive.
SENSITIVE_WORDS = ("access", "apikey", "api_key", "auth", "bearer", "certificate", "client_id", "credential",
                   "passw", "private", "secret", "session", "signature", "signing", "token", "webhook")
_SENSITIVE = re.compile("(?ai:" + "|".join(SENSITIVE_WORDS) + ")")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A run, or a part of NAME=value, of at least so many characters is a candidate.
MIN_CANDIDATE = 16
_PART = re.compile(r"[^=]+=*")
#: What may stand between a reported span and the next part of the same secret: a dot, also with short
#: parts and dots after it, or a line end (also an escaped one) with quotes and indentation.
_JOIN = re.compile(r"""\.(?:[A-Za-z0-9_-]{0,15}\.)*|["'\\+,;\x20\t]*\r?\n["'\x20\t]*|\\(?:r\\)?""")
#: What ends a line, so that a part of a secret has it to itself.
_LINE_END = re.compile(r"""[."'\\+,;)<\x20\t]*(?:\r?\n|\Z)|[\\<]""")
#: Blocks of lines between BEGIN and END, and the short last lines in them.
_BEGIN = re.compile(r"-----BEGIN [A-Z0-9\x20]*-----")
_END = "-----END "
_TAIL = re.compile(r"[A-Za-z0-9+/=]{1,15}(?![A-Za-z0-9+/_=-])")

#: Identifiers that prime the compressor.
IDENTIFIERS = """
access_key access_token account admin api_key application args assert async auth authorization await
base64 bearer boolean buffer callback certificate class client_id client_secret config connection
const container content_type context cookie credentials database default delete deploy description
development dictionary document element endpoint environment error example export extends false
field file filename final float format function getattr handler hash header host http https import
include index init instance integer interface json kwargs lambda length library localhost logger
message method middleware module namespace null number object options output package parameter
password payload placeholder print private_key production properties protected public_key query
random refresh_token region registry repository request required response result return schema
secret_key self server service session_id settings signature static status string struct template
test timeout timestamp token true type undefined update upload url user username uuid value variable
version void webhook www your_api_key_here yield 0123456789abcdef 1234567890
ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/
""".encode()

#: Characters after a sensitive word in which a first candidate may start; characters of code around it.
REACH = 40
AROUND = 200
#: Least share of a candidate's length that it must add to the compressed size.
NOVEL_SHARE = 0.5
#: The same for a candidate without a digit outside a block: long words and names add 0.6 to 0.8 of theirs.
LETTERS_SHARE = 0.75

Span = tuple[int, int, int]  # start, kind, end


def blocks(text: str) -> list[tuple[int, int]]:
    """``(start, end)`` of what stands between BEGIN and END lines whose name is sensitive."""
    out, ended = [], -1
    begins = list(_BEGIN.finditer(text)) if "-----BEGIN " in text else []
    for i, m in enumerate(begins):
        if ended < m.end():
            ended = text.find(_END, m.end())
        if ended < 0:
            break
        if _SENSITIVE.search(m[0]) and (i + 1 == len(begins) or ended < begins[i + 1].start()):
            out.append((m.end(), ended))
    return out


def _joined(text: str, end: int) -> int:
    """Where the next part of a secret that ends at ``end`` would start; -1 if nothing can follow."""
    m = _JOIN.match(text, end)
    return m.end() if m else -1


def candidates(start: int, run: str) -> list[tuple[int, int]]:
    """``(start, end)`` of the candidates in a run of characters.  After an inner '=' there is a value:
    it is a candidate of its own, without its name.  A run without a value long enough is one."""
    values = [(start + m.start(), start + m.end()) for m in list(_PART.finditer(run))[1:] if m.end() - m.start() >= MIN_CANDIDATE]
    return values or [(start, start + len(run))]


class Scanner:
    def __init__(self, identifiers: bytes = IDENTIFIERS, novel_share: float = NOVEL_SHARE) -> None:
        import zstandard

        primed = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._compress = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_dict_id=False).compress
        self._share = novel_share

    def added_bytes(self, before: str, candidate: str, after: str) -> int:
        """Compressed bytes that the candidate adds to the code around it."""
        return len(self._compress((before + candidate + after).encode())) - len(self._compress((before + after).encode()))

    def base(self, text: str) -> list[Span]:
        low = text.lower()
        spans = []
        if any(w in low for w in _ASSIGN_WORDS):
            spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
        if "AKIA" in text:
            spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return sorted(spans)

    def novel(self, text: str, base: list[Span]) -> list[Span]:
        """Incompressible candidates in a sensitive context that overlap no base span."""
        low = text.lower()
        if not any(w in low for w in SENSITIVE_WORDS):
            return []
        taken, at, reach, named, found = sorted((s, e) for s, _, e in base), 0, -1, -1, []
        words, inside, reported, joined = _SENSITIVE.finditer(text), blocks(text), -1, -1
        word = next(words, None)
        for m in _RUN.finditer(text):
            for start, end in candidates(m.start(), m[0]):
                if start < reported:
                    continue
                while word is not None and word.start() < start:
                    named, reach = word.start(), word.end() + REACH
                    word = next(words, None)
                while inside and inside[0][1] <= start:
                    inside.pop(0)
                while at < len(taken) and taken[at][1] <= start:
                    if taken[at][1] > reported:
                        reported, joined = taken[at][1], _joined(text, taken[at][1])
                    at += 1
                candidate, block = text[start:end], bool(inside) and inside[0][0] <= start
                follows = start == joined and "=" not in candidate.rstrip("=") and (
                    text[reported] == "." or _LINE_END.match(text, end) is not None)
                # A sensitive word in the name of NAME=value counts however long the name is.
                if start > reach and named < m.start() and not block and not follows:
                    continue
                if any(s < end and e > start for s, e in taken[at:at + 4]):
                    continue
                least = self._share if block or any(c.isdigit() for c in candidate) else max(self._share, LETTERS_SHARE)
                if self.added_bytes(text[max(0, start - AROUND):start], candidate, text[end:end + AROUND]) < least * (end - start):
                    continue
                # Short parts between dots belong to what they stand in.
                found.append((reported + 1 if follows and text[reported] == "." else start, 3, end))
                reported, joined = end, _joined(text, end)
                while block and joined >= 0 and (tail := _TAIL.match(text, joined)) and tail.end() <= inside[0][1]:
                    found.append((joined, 3, tail.end()))
                    reported, joined = tail.end(), _joined(text, tail.end())
        return found


def show(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: bytes = IDENTIFIERS,
         novel_share: float = NOVEL_SHARE) -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, all spans."""
    ship_by_value()
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def find(batches):
        scanner = Scanner(identifiers, novel_share)
        for batch in batches:
            counts, digests, shown = [[] for _ in KINDS], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = scanner.base(text)
                spans = sorted(base + scanner.novel(text, base))
                for k, column in enumerate(counts):
                    column.append(sum(s[1] == k for s in spans))
                digests.append(hashlib.sha256(show(base).encode()).hexdigest())
                shown.append(show(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(shown, pa.string())],
                names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(find, schema)


def redact(text: str, spans: list[Span], mark: str) -> str:
    """``text`` with each stretch covered by spans replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """All columns of ``docs``, with secrets in the text replaced and, if named, its length renewed."""
    ship_by_value()
    names = docs.columns
    text_at, length_at = names.index(text_col), names.index(length_col) if length_col else None

    def clean(batches):
        scanner = Scanner()
        for batch in batches:
            texts, lengths = batch.column(text_at).to_pylist(), batch.column(length_at).to_pylist() if length_col else None
            for i, text in enumerate(texts):
                if not text:
                    continue
                base = scanner.base(text)
                if spans := base + scanner.novel(text, base):
                    texts[i] = redact(text, spans, mark)
                    if lengths is not None:
                        lengths[i] = len(texts[i])
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if lengths is not None:
                columns[length_at] = pa.array(lengths, columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(clean, docs.schema)
