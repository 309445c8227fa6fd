"""Operator 13, fill-in-middle transformation by counted quantifiers.

A text is a row of units, here code points.  ``regexp_count`` gives their number n; hashes of the id
choose two cuts a <= b and a form.  One match of a pattern made for the row, with the possessive
groups ``(unit{a}+)(unit{b-a}+)(unit*+)``, captures prefix, middle and suffix, and its replacement
writes them in the order of the form.  All expressions are Spark's own; rows are mapped one by one,
so nothing is shuffled and a lost executor costs its rows only.

Forms: ``plain`` (the text itself), ``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle) and ``spm``
(``<S>`` suffix ``<P>`` prefix ``<M>`` middle).  A text that is empty or holds a marker stays plain,
so that every output can be taken apart again: the first markers of an output are its own.

Rules for odd input: a null text is an empty one; a null id is hashed as an empty string, so all null
ids share their draws; repeated ids share theirs; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One unit, and the number of units that one step of the count takes: ``regexp_count`` lists its
#: matches, and a list of whole blocks stays short for a very long text.
UNIT = "(?s:.)"
BLOCK = 1024


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _literal(marker: str) -> str:
    """A marker as part of a pattern."""
    return "".join(c if c.isalnum() else f"\\{c}" for c in marker)


def _template(marker: str) -> str:
    """A marker as part of a replacement."""
    return marker.replace("\\", "\\\\").replace("$", "\\$")


def count_units(text: Column) -> Column:
    """Number of units: whole blocks first, then what is left after them."""
    blocks = F.regexp_count(text, F.lit(f"{UNIT}{{{BLOCK}}}+")).cast("long")
    rest = F.regexp_replace(text, F.lit(f"\\A(?:{UNIT}{{{BLOCK}}})*+"), F.lit(""))
    return blocks * BLOCK + F.regexp_count(rest, F.lit(UNIT))


def draws(id_col: Column, seed: int, n: int = 4) -> list[Column]:
    """The first ``n`` groups of eight hexadecimal digits of sha256(``seed:id``), as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def restore(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text, from an output and its form alone."""
    p, s, m = (_literal(x) for x in markers.all())
    psm = F.regexp_replace(output, F.lit(f"(?s)\\A{p}(.*?){s}(.*?){m}(.*+)\\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)\\A{s}(.*?){p}(.*?){m}(.*+)\\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20,
              markers: Markers = Markers()) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row for each of ``docs``.

    Of 100 texts, those whose third draw is ``plain_from`` or more stay plain; of the others, those
    whose fourth is below ``spm_below`` become ``spm``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first, second, third, fourth = draws(F.col("doc_id"), seed)
    rows = rows.withColumn("n", count_units(F.col("text")))
    rows = rows.select(
        "doc_id", "text", "n", F.least(F.pmod(first, F.col("n") + 1), F.pmod(second, F.col("n") + 1)).alias("a"),
        F.greatest(F.pmod(first, F.col("n") + 1), F.pmod(second, F.col("n") + 1)).alias("b"),
        F.pmod(third, F.lit(100)).alias("third"), F.pmod(fourth, F.lit(100)).alias("fourth"))
    marked = F.lit(False)
    for marker in markers.all():
        marked = marked | F.col("text").contains(marker)
    form = F.when((F.col("n") == 0) | marked | (F.col("third") >= plain_from), "plain").when(F.col("fourth") < spm_below, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", "a", (F.col("b") - F.col("a")).alias("m"), form.alias("form"))
    pattern = F.format_string(f"\\A({UNIT}{{%d}}+)({UNIT}{{%d}}+)({UNIT}*+)\\z", "a", "m")
    p, s, m = (_template(x) for x in markers.all())
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    changed = F.col("form") != "plain"
    return rows.select(
        "doc_id", "n", "form", F.when(changed, F.col("a")).alias("prefix_chars"), F.when(changed, F.col("m")).alias("middle_chars"),
        F.when(changed, F.regexp_replace("text", pattern, order)).otherwise(F.col("text")).alias("output"))


def with_digests(out: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """``transform``'s rows with SHA-256 of the output and of the text rebuilt from it."""
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form"), markers), 256).alias("restored_sha256"))
