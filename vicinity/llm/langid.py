"""Operator 8, language ID: unigram pieces with all segmentations summed.

Each language has probabilities of the pieces of a fixed public vocabulary.  The probability of a
word is the sum over all ways to cut it into pieces (a forward algorithm); that of a text is the
product over its words.  The language with the largest posterior, under equal priors, is predicted.

Training: tasks count words by language, the counts are summed by word (the only shuffle), and
expectation-maximisation runs on that table; an E-step adds expected piece counts inside the tasks
and sends at most pieces x languages sums to the driver.  Everything else is one pass over the texts.
Forward and backward sums run in numpy over many distinct words at once.

Rules for odd input: a null text, or one without a letter, gets ``und`` and score 0; an unknown
language label is a null one and is not learned; with nothing to learn from, every row gets ``und``;
a null id is never held out; repeated rows and ids give one result row each; ties go to the language
first in alphabetical order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.llm.common import cut_lineage, ship_by_value

UNDETERMINED = "und"
ITERATIONS = 2
#: Longest piece that is used, and longest stretch of a word that is summed in one go.
MAX_PIECE = 12
STRETCH = 24
#: Added to every expected count; probability of a letter that is no piece.
SMOOTHING = 0.1
UNKNOWN = 1e-7
#: Words that a task holds before it hands its counts on, or forgets their scores.
HELD = 300_000
#: Texts whose word counts are held at a time.
ROWS = 256

_WORD = re.compile(r"[^\W\d_]+")


def default_vocabulary() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def load_pieces(path: str | None) -> dict[str, int]:
    """Pieces made of letters, in lower case, each with its index; a word start is ``▁``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    found = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if len(piece) <= MAX_PIECE and piece.removeprefix("▁").isalpha():
            found.add(piece)
    found.add("▁")
    return {p: i for i, p in enumerate(sorted(found))}


class _Places(dict):
    """Numbers words as they come; ``fresh`` collects the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = at = len(self)
        return at


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def has_letter(words) -> bool:
    return any(c.isalpha() for w in words for c in w)


def _stretches(word: str) -> list[str]:
    word = "▁" + word
    if len(word) <= STRETCH:
        return [word]
    return [word[i:i + STRETCH] for i in range(0, len(word), STRETCH)]


class PieceTable:
    """Finds the pieces among all substrings of many words at once, by hashes of their letters."""

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[str, int], slot_bits: int = 20, probes: int = 8) -> None:
        self._shift, self._mask = np.uint64(64 - slot_bits), (1 << slot_bits) - 1
        self._hash = np.zeros(1 << slot_bits, np.uint64)
        self._piece = np.full(1 << slot_bits, -1, np.int32)
        self._probes = 1
        for piece, i in pieces.items():
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in piece:
                    h = h * self._BASE + np.uint64(ord(c))
            at = int(self._slots(np.array([h]))[0])
            for n in range(probes):
                if self._piece[at + n & self._mask] < 0:
                    self._hash[at + n & self._mask], self._piece[at + n & self._mask] = h, i
                    self._probes = max(self._probes, n + 1)
                    break
            else:
                raise ValueError("too many pieces for the table")
        self._taken = self._piece >= 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * self._BASE >> self._shift).astype(np.int64)

    def _look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and which pieces."""
        slot = self._slots(h)
        some = np.flatnonzero(self._taken[slot])  # an empty slot ends the search for nearly all
        slot, h = slot[some], h[some]
        out = np.full(len(some), -1, np.int32)
        for n in range(self._probes):
            at = slot + n & self._mask
            out = np.where((out < 0) & (self._hash[at] == h), self._piece[at], out)
        found = out >= 0
        return some[found], out[found]

    def edges(self, words: list[str], length: int, unknown: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(start, size, which words, piece)`` of all substrings that are pieces; a letter that is
        none is the piece ``unknown``.  All words have the given length."""
        letters = np.array(words, dtype=f"<U{length}").view(np.uint32).reshape(len(words), length).astype(np.uint64)
        out = []
        for start in range(length):
            h = np.zeros(len(words), np.uint64)
            for size in range(1, min(MAX_PIECE, length - start) + 1):
                h = h * self._BASE + letters[:, start + size - 1]
                at, piece = self._look_up(h)
                if size == 1 and len(at) < len(words):
                    letter = np.full(len(words), unknown, np.int32)
                    letter[at] = piece
                    at, piece = np.arange(len(words)), letter
                if len(at):
                    out.append((start, size, at, piece))
        return out


class Lattice:
    """Sums over all segmentations of many words at once.

    ``probability`` has a row for each piece and a column for each language; a letter that is no
    piece has a small probability of its own.
    """

    def __init__(self, pieces: dict[str, int], probability: np.ndarray) -> None:
        self.pieces, self.n_langs, self.unknown = PieceTable(pieces), probability.shape[1], len(pieces)
        self.table = np.vstack([probability, np.full((1, self.n_langs), UNKNOWN)])

    def _groups(self, words: list[str], step: int = 8192):
        """Stretches of the words, by equal length: ``(length, stretches, index of the word)``."""
        by_length: dict[int, tuple[list[str], list[int]]] = {}
        for i, w in enumerate(words):
            for s in _stretches(w):
                parts, owner = by_length.setdefault(len(s), ([], []))
                parts.append(s)
                owner.append(i)
        for length, (parts, owner) in by_length.items():
            for lo in range(0, len(parts), step):
                yield length, parts[lo:lo + step], np.array(owner[lo:lo + step])

    def _forward(self, edges, length: int, n: int) -> np.ndarray:
        """Probability of each prefix, at [end, word, language]."""
        alpha = np.zeros((length + 1, n, self.n_langs))
        alpha[0] = 1
        for start, size, at, piece in edges:  # in order of their start
            alpha[start + size][at] += alpha[start][at] * self.table[piece]
        return alpha

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Log-probability of whole words, [word, language]."""
        out = np.zeros((len(words), self.n_langs))
        for length, parts, owner in self._groups(words):
            alpha = self._forward(self.pieces.edges(parts, length, self.unknown), length, len(parts))
            np.add.at(out, owner, np.log(alpha[length]))
        return out

    def expected(self, words: list[str], counts: np.ndarray, total: np.ndarray) -> None:
        """Adds the expected pieces of ``words`` (``counts`` by language) to ``total``."""
        for length, parts, owner in self._groups(words):
            edges = self.pieces.edges(parts, length, self.unknown)
            alpha = self._forward(edges, length, len(parts))
            beta = np.zeros_like(alpha)
            beta[length] = counts[owner] / alpha[length]
            seen, weights = [], []
            for start, size, at, piece in reversed(edges):
                through = self.table[piece] * beta[start + size][at]
                beta[start][at] += through
                seen.append(piece)
                weights.append(alpha[start][at] * through)
            seen, weights = np.concatenate(seen), np.concatenate(weights)
            for lang in range(self.n_langs):
                total[:, lang] += np.bincount(seen, weights[:, lang], len(total))


def held_out(id_col: str) -> Column:
    """Rows that are not learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(word, counts: array<struct<lang, n>>)``."""

    def count(batches):
        seen: dict[str, Counter] = {}

        def flush():
            for lang, words in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())],
                    names=["lang", "word", "n"])
            seen.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                seen.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
                if sum(map(len, seen.values())) > HELD:
                    yield from flush()
        yield from flush()

    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    parts = known.select(text_col, F.col(lang_col).cast("string")).mapInArrow(count, "lang string, word string, n long")
    sums = parts.groupBy("word", "lang").agg(F.sum("n").alias("n"))
    return sums.groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("counts"))  # a few languages each


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None,
          iterations: int = ITERATIONS) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order, and piece probabilities [piece, language]."""
    ship_by_value()
    spark = docs.sparkSession
    table = cut_lineage(word_counts(docs, text_col, lang_col), "lang-words")
    langs = [r["lang"] for r in table.select(F.explode("counts.lang").alias("lang")).distinct().orderBy("lang").collect()]
    n_pieces = len(load_pieces(vocabulary))
    probability = np.full((n_pieces, len(langs)), 1 / n_pieces)
    for _ in range(iterations if langs else 0):
        sent = spark.sparkContext.broadcast(probability)

        def expect(batches, sent=sent):
            lattice = Lattice(load_pieces(vocabulary), sent.value)
            column = {lang: i for i, lang in enumerate(langs)}
            total = np.zeros((len(lattice.table), len(langs)))
            for batch in batches:
                rows = batch.column(1).to_pylist()
                counts = np.zeros((len(rows), len(langs)))
                for i, row in enumerate(rows):
                    for c in row:
                        counts[i, column[c["lang"]]] += c["n"]
                lattice.expected(batch.column(0).to_pylist(), counts, total)
            at, lang = np.nonzero(total[:lattice.unknown])
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[at, lang])], names=["piece", "lang", "n"])

        sums = table.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        total = np.full((n_pieces, len(langs)), SMOOTHING)
        total[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["n"].to_numpy()
        probability = total / total.sum(axis=0)
    return langs, probability


def predict(docs: DataFrame, langs: list[str], probability: np.ndarray, id_col: str = "doc_id",
            text_col: str = "text", vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to the columns ``keep`` (the id alone by default)."""
    ship_by_value()
    keep = [id_col] if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(probability)
    names = [*keep, "lang_pred", "score"]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches):
        lattice = Lattice(load_pieces(vocabulary), sent.value)
        place, logs = _Places(), np.empty((0, len(langs)))
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            if len(place) > HELD:
                place, logs = _Places(), np.empty((0, len(langs)))
            known = len(place)
            found = []
            for text in batch.column(0).to_pylist():
                words = words_of(text) if text and langs else []
                found.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)) if has_letter(words) else None)
            if place.fresh:
                if len(place) > len(logs):
                    logs = np.vstack([logs[:known], np.empty((len(place) + len(place.fresh), len(langs)))])
                logs[known:len(place)] = lattice.log_probability(place.fresh)
                place.fresh.clear()
            pred, best = [], []
            for at in found:
                if at is None:
                    pred.append(UNDETERMINED)
                    best.append(0.0)
                    continue
                total = logs[at].sum(axis=0)
                share = np.exp(total - total.max())
                top = int(share.argmax())
                pred.append(langs[top])
                best.append(float(share[top] / share.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(best, pa.float64())], names=names)

    # The text goes first, under a name of its own: ``keep`` may hold it again.
    return docs.select(F.col(text_col).alias("_text_"), *keep).mapInArrow(score, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Learn from the labelled rows that are not held out, and predict every row."""
    langs, probability = train(docs.where(~held_out(id_col)), text_col, lang_col, vocabulary)
    return predict(docs, langs, probability, id_col, text_col, vocabulary, keep)


def keep_identified(docs: DataFrame, min_score: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    vocabulary: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose language could be told, with a score of at least ``min_score``.  With no
    labelled row to learn from, every row whose text has a letter."""
    langs, probability = train(docs.where(~held_out(id_col)), text_col, lang_col, vocabulary)
    if not langs:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    whole = docs.select(F.col(text_col).alias("_text_"), F.struct(*(F.col(c) for c in docs.columns)).alias("_doc"))
    found = predict(whole, langs, probability, text_col="_text_", vocabulary=vocabulary, keep=["_doc"])
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("_doc.*")
