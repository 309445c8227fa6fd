"""Operator 2, quality rules: repetition coverage.

Rolling hashes of word n-grams of several lengths give the share of a text's characters that lies
inside n-grams equal to an earlier one of that text, and in lines equal to an earlier line.  Everything
is computed in numpy over blocks of whole texts; no row leaves its task, so there is no shuffle and
a long text costs memory only in proportion to its own length.

Rules for odd input:

* null or empty text: no words, all counts 0, all shares 0, ``base_failed`` true, ``kept`` false;
* repeated rows and repeated ids are judged one by one, one result row per input row;
* empty table: empty result of the same schema;
* other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vicinity.llm.common import ship_by_value, text_blocks
from vicinity.llm.wordscan import U, Block, Powers, mix, per_doc, repeated, windows

#: Largest share of characters in duplicated n-grams, by n, as published for
#: massive web text (n-gram lengths 5 to 10).
MAX_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in lines equal to an earlier line.
MAX_LINE_SHARE = 0.20
MIN_WORDS = 10
MAX_REPEAT_WORDS_PCT = 20
BASE_N = 5
SYMBOLS = "#*$%&|<>"

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(at: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Words inside the windows of ``size`` words that start at ``at``."""
    covered = np.zeros(n_words, bool)
    for j in range(size):
        covered[at + j] = True
    return np.flatnonzero(covered)


def _block_measures(data: np.ndarray, offsets: np.ndarray, powers: Powers, lengths: list[int]) -> dict[str, np.ndarray]:
    block = Block(data, offsets, powers)
    n = block.n_docs
    words = block.words()
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    word_chars = points[words.end] - points[words.start]
    symbol = np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8))
    out = {
        "n_words": per_doc(words.doc, n),
        "word_chars": per_doc(words.doc, n, word_chars),
        "n_symbols": per_doc(block.doc_of(np.flatnonzero(symbol)), n),
    }

    start, end, doc = block.lines()
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(block.inside(), out=filled[1:])
    has_word = filled[end] > filled[start]
    start, end, doc = start[has_word], end[has_word], doc[has_word]
    by_position = np.lexsort((start, doc))
    start, end, doc = start[by_position], end[by_position], doc[by_position]
    chars = points[end] - points[start]
    _, later = repeated(mix(block.run_hash(start, end) ^ mix(doc.astype(np.uint64) + U(1))))
    out["n_dup_lines"] = per_doc(doc[later], n)
    line_chars = per_doc(doc, n, chars)
    out["dup_line_share"] = per_doc(doc[later], n, chars[later]) / np.maximum(line_chars, 1)

    salt = mix(words.doc.astype(np.uint64) + U(1))
    rolling, alive = None, np.arange(len(words.hash))
    for size in range(1, max(lengths) + 1):
        rolling, whole = windows(words, size, rolling)
        # A repeated window starts with a repeated shorter one: only those positions are looked at.
        alive = alive[alive < len(rolling)]
        alive = alive[whole[alive]]
        members, later = repeated(mix(rolling[alive] ^ salt[alive]))
        again = _covered(alive[later], size, len(words.hash))
        alive = np.sort(alive[members])
        if size == BASE_N:
            out["n_repeat_words"] = per_doc(words.doc[_covered(alive, size, len(words.hash))], n)
        if size not in lengths:
            continue
        out[f"dup_{size}gram_share"] = per_doc(words.doc[again], n, word_chars[again]) / np.maximum(out["word_chars"], 1)
    return out


def repetition_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_ngram_share: dict[int, float] | None = None,
    max_line_share: float = MAX_LINE_SHARE,
    min_words: int = MIN_WORDS,
    max_repeat_words_pct: int = MAX_REPEAT_WORDS_PCT,
) -> DataFrame:
    """One row per document: counts, shares of duplicated characters and the verdict ``kept``."""
    limits = dict(sorted((max_ngram_share or MAX_NGRAM_SHARE).items()))
    lengths = sorted({BASE_N, *limits})
    shares = ["dup_line_share", *(f"dup_{n}gram_share" for n in lengths)]
    id_field = T.StructField("doc_id", docs.schema[id_col].dataType)
    schema = T.StructType([
        id_field,
        *(T.StructField(c, T.LongType()) for c in _COUNTS),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        *(T.StructField(c, T.DoubleType()) for c in shares),
    ])
    names = schema.names

    def measure(batches):
        powers = Powers()
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                m = _block_measures(data, offsets, powers, lengths)
                failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_words_pct * m["n_words"])
                bad = m["dup_line_share"] > max_line_share
                for n, most in limits.items():
                    bad |= m[f"dup_{n}gram_share"] > most
                columns = {**m, "base_failed": failed, "kept": ~failed & ~bad}
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array(columns[c]) for c in names[1:])], names=names)

    ship_by_value()
    return docs.select(id_col, text_col).mapInArrow(measure, schema)
