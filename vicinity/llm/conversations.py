"""Operator 11, conversation structure repair as a stream of secondary-sorted rows.

Rows are repartitioned by conversation and sorted by turn; ``mapInPandas`` then reads each
conversation once, from its first row to its last, across the borders of Arrow batches.  It carries
the state of a dynamic program over the four states of the role grammar ``(s?(ua)+)?`` (nothing yet,
after s, after u, after a): cost, order of the edit strings, and a running SHA-256 of the repaired
conversation.  So no text is held.  Each row leaves four bytes of backpointers, one for each state;
beyond a threshold they go to an anonymous temporary file of the task, which vanishes with it, and a
task that is lost is simply run again.

Edits: Keep (0), Rerole to user or assistant (2), Delete (3; the only one for blank rows and
duplicates), Insert an empty user or assistant row (2); a truncated row that stays adds 1.  Of the
cheapest repairs the one whose string of edit initials is least in ASCII is taken.  Two strings that
end with the edit of the same row are never prefixes of one another, so the order of the best
strings of the four states is all that has to be carried to compare longer ones.

Rules for odd input: a null role or text is one space, and in the key of the damage a null id or turn
is written as one space; null ids make one conversation; null turns sort first; rows of equal turns
are ordered by role and text, so repeated rows stand together; an empty table gives an empty result;
other columns are not read.  A conversation is one task's stream however long it is: its rows must be
read in order, but memory does not grow with it except by its audit string.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinity.llm.common import ship_by_value

#: Costs of the edits, and what a truncated row that stays adds.
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
#: White space, and the marks that end a sentence.
SPACE = " \t\n\v\f\r"
ENDS = ".!?"
#: Bytes of backpointers and conversations held in memory before they go to a file.
SPILL_BYTES = 1 << 22

# States of the grammar, the state after an inserted or changed row, and the role of such a row.
_EMPTY, _S, _U, _A = range(4)
_NEXT = {_EMPTY: _U, _S: _U, _U: _A, _A: _U}
_ROLE = {_U: "user", _A: "assistant"}
_KEEPS = {(_EMPTY, "s"): _S, (_EMPTY, "u"): _U, (_S, "u"): _U, (_U, "a"): _A, (_A, "u"): _U}
_LEGAL = {"su", "ua", "au"}
_OK, _BLANK, _DUPLICATE, _TRUNCATED = range(4)

RESULT = ("conv_key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def damage_key(conv: Column, turn: Column) -> Column:
    """crc32 of ``conv:turn`` modulo 20; a null is one space."""
    text = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)))
    return F.pmod(F.crc32(text), F.lit(20))


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, role, text, dropped)``: the damaged rows.  A dropped row stays, marked and
    without its text, so that its conversation is known."""
    rows = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"), damage_key(F.col(conv_col), F.col(turn_col)).alias("key"))
    text = F.when(F.col("key") <= 1, "").when(F.col("key") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("key") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("key") == 0).alias("dropped"), F.explode(F.when(F.col("key") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
                           F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


class _Spool:
    """Fixed-size records, appended, and read from the last to the first."""

    def __init__(self, size: int, limit: int = SPILL_BYTES) -> None:
        self._size, self._file, self._n = size, tempfile.SpooledTemporaryFile(max_size=limit), 0

    def append(self, record: bytes) -> None:
        self._file.write(record)
        self._n += 1

    def backwards(self, block: int = 1 << 14) -> Iterator[bytes]:
        for hi in range(self._n, 0, -block):
            lo = max(0, hi - block)
            self._file.seek(lo * self._size)
            data = self._file.read((hi - lo) * self._size)
            for at in range(len(data) - self._size, -1, -self._size):
                yield data[at:at + self._size]

    def clear(self) -> None:
        self._file.seek(0)
        self._file.truncate()
        self._n = 0

    def close(self) -> None:
        self._file.close()


def _steps(initial: str, fault: int) -> list[tuple[int, int, str, int, int]]:
    """``(state, inserts, edit, next state, cost)`` of all ways to take one row.  Two inserts at most:
    a third would come back to a state that fewer reach."""
    out = []
    for state, inserts in product(range(4), range(3)):
        at = state
        for _ in range(inserts):
            at = _NEXT[at]
        before = COST["I"] * inserts
        out.append((state, inserts, "D", at, before + COST["D"]))
        if fault in (_OK, _TRUNCATED):
            stays = before + (TRUNCATED if fault == _TRUNCATED else 0)
            if (at, initial) in _KEEPS:
                out.append((state, inserts, "K", _KEEPS[at, initial], stays + COST["K"]))
            out.append((state, inserts, "R", _NEXT[at], stays + COST["R"]))
    return out


class _Repair:
    """The dynamic program over one conversation after another."""

    def __init__(self) -> None:
        self._back, self._known = _Spool(4), {}
        self.start()

    def start(self) -> None:
        """Costs are kept above the least one, so that few different layers exist and each is worked out once."""
        self._base, self._costs, self._ranks = 0, (0, None, None, None), (0, None, None, None)
        self._hashes: list = [(hashlib.sha256(), False), None, None, None]
        self._back.clear()

    def _layer(self, initial: str, fault: int):
        key = self._costs, self._ranks, initial, fault
        if key not in self._known:
            best: dict[int, tuple] = {}
            for state, inserts, edit, after, cost in _steps(initial, fault):
                if self._costs[state] is not None:
                    way = self._costs[state] + cost, self._ranks[state], "I" * inserts + edit, state
                    best[after] = min(best.get(after, way), way)
            order = sorted(best, key=lambda q: best[q][1:3])
            least = min(way[0] for way in best.values())
            costs = tuple(best[q][0] - least if q in best else None for q in range(4))
            ranks = tuple(order.index(q) if q in best else None for q in range(4))
            pointers = bytes(best[q][3] | (len(best[q][2]) - 1) << 2 | "DKR".index(best[q][2][-1]) << 4 if q in best else 255 for q in range(4))
            self._known[key] = costs, ranks, least, pointers, [(q, best[q][3], best[q][2]) for q in best]
        return self._known[key]

    @staticmethod
    def _written(hashed, state: int, edits: str, role: str, text: str):
        """The running hash after the edits."""
        digest, begun = hashed
        if edits == "D":
            return hashed
        digest = digest.copy()
        for edit in edits:
            if edit != "D":
                if edit != "K":
                    state = _NEXT[state]
                line = f"{role}:{text}" if edit == "K" else f"{_ROLE[state]}:{text if edit == 'R' else ''}"
                digest.update(("\n" + line if begun else line).encode())
                begun = True
        return digest, begun

    def add(self, role: str, text: str, fault: int) -> None:
        self._costs, self._ranks, least, pointers, ways = self._layer(role[:1], fault)
        self._base += least
        hashes: list = [None] * 4
        for after, state, edits in ways:
            hashes[after] = self._written(self._hashes[state], state, edits, role, text)
        self._hashes = hashes
        self._back.append(pointers)

    def finish(self) -> tuple[int, str, str]:
        """Cost, edits and hash of the repaired conversation."""
        ends = []
        for state, inserts in ((_EMPTY, 0), (_A, 0), (_U, 1), (_S, 2)):
            if self._costs[state] is not None:
                ends.append((self._costs[state] + COST["I"] * inserts, self._ranks[state], "I" * inserts, state))
        cost, _, edits, state = min(ends)
        digest, _ = self._written(self._hashes[state], state, edits, "", "") if edits else self._hashes[state]
        parts = [edits]
        for pointers in self._back.backwards():
            way = pointers[state]
            parts.append("I" * (way >> 2 & 3) + "DKR"[way >> 4])
            state = way & 3
        return self._base + cost, "".join(reversed(parts)), digest.hexdigest()

    def close(self) -> None:
        self._back.close()


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per conversation, from rows that come conversation by conversation in order."""
    repair, done, conv, begun = _Repair(), [], None, False
    first_turn = last_turn = None
    distinct = blank = duplicate = cut = illegal = 0
    before = None

    def closed():
        gaps = 0 if first_turn is None else last_turn - first_turn + 1 - distinct
        return (conv, gaps, blank, duplicate, cut, illegal, *repair.finish())

    names = [c.split()[0] for c in RESULT.split(", ")]
    try:
        for batch in batches:
            columns = (batch[c].tolist() for c in ("conv_key", "null_turn", "turn", "role", "text", "dropped", "nth"))
            for key, null_turn, turn, role, text, dropped, nth in zip(*columns, strict=True):
                if not begun or key != conv:
                    if begun:
                        done.append(closed())
                        if len(done) >= 4096:
                            yield pd.DataFrame(done, columns=names)
                            done = []
                    repair.start()
                    conv, begun, first_turn, before = key, True, None, None
                    distinct = blank = duplicate = cut = illegal = 0
                if dropped:
                    continue
                if not null_turn:
                    if first_turn is None:
                        first_turn, last_turn, distinct = turn, turn, 1
                    elif turn != last_turn:
                        last_turn, distinct = turn, distinct + 1
                fault, shown = _OK, text.rstrip(SPACE)
                if not shown:
                    fault, blank = _BLANK, blank + 1
                elif nth > 1:
                    fault, duplicate = _DUPLICATE, duplicate + 1
                elif shown[-1] not in ENDS:
                    fault, cut = _TRUNCATED, cut + 1
                if before is not None and before + role[:1] not in _LEGAL:
                    illegal += 1
                before = role[:1]
                repair.add(role, text, fault)
        if begun:
            done.append(closed())
        yield pd.DataFrame(done, columns=names)
    finally:
        repair.close()


def repair(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of
    ``rows(conv, turn, role, text, dropped)``, one row per conversation."""
    kind = rows.schema["conv"].dataType
    rows = rows.select(
        F.col("conv").cast("string").alias("conv_key"), F.col("turn").isNull().alias("null_turn"), F.coalesce("turn", F.lit(0)).alias("turn"),
        "role", "text", "dropped")
    rows = rows.repartition("conv_key")
    # The window's rows are those of one conversation already, so it costs a sort and no exchange.
    same = Window.partitionBy("conv_key", "role", "text", "dropped").orderBy(F.col("null_turn").desc(), "turn")
    rows = rows.withColumn("nth", F.row_number().over(same))
    rows = rows.sortWithinPartitions("conv_key", F.col("null_turn").desc(), "turn", "role", "text")
    ship_by_value()
    out = rows.mapInPandas(_stream, RESULT)
    return out.select(F.col("conv_key").cast(kind).alias("conv_id"), *out.columns[1:])
