"""Text functions with Unicode white space and code-point lengths, as Spark column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it, and the four separators below U+0020.
WS = r"[\s\x1C-\x1F]"
BLANK = rf"(?U)^{WS}*$"

#: Characters of the private use area that stand for masked ones inside a splitter.
DOT, BANG, ASK, SEMI, APOSTROPHE, QUOTE, ELLIPSIS, CUT, PAD = (chr(0xE000 + k) for k in range(9))
ZH_DOT, ZH_BANG, ZH_ASK, ZH_SEMI = (chr(0xE010 + k) for k in range(4))
MASKED = ".!?;'\"。！？；"
MASKS = DOT + BANG + ASK + SEMI + APOSTROPHE + QUOTE + ZH_DOT + ZH_BANG + ZH_ASK + ZH_SEMI


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}+|(?<!{WS}){WS}+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)[^\s\x1C-\x1F]")


def unmask(c: Column) -> Column:
    return F.replace(F.translate(c, MASKS + PAD, MASKED), F.lit(ELLIPSIS), F.lit("..."))


def nonempty(c: Column) -> Column:
    return F.filter(c, lambda x: x != "")


def let(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns that are computed once a row; the optimizer neither inlines them nor pushes predicates through."""
    for name, value in values.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows: the id and 128 bits of the text. Rows of one key are equal in both, so they share results."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("a"), F.xxhash64(F.lit(1), F.col(text_col)).alias("b"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, inside an expression."""
    return F.transform(F.array(value), use)[0]


def mask_matches(text: Column, pattern: str, group_pattern: str, wrap: Callable[[Column], Column], needs: Callable[[Column], Column] | None = None) -> Column:
    """Rewrites each match of a pattern by wrap(match) if it also has group_pattern inside; texts that `needs` doesn't hold for stay as they are."""

    def rewritten(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        done = F.transform(found, lambda m: F.when(m.rlike(group_pattern), wrap(m)).otherwise(m))
        joined = F.array_join(F.zip_with(F.split(t, pattern, -1), done, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
        return joined if needs is None else F.when(needs(t), joined).otherwise(t)

    return once(text, rewritten)


def slices(c: Column, size: int) -> Column:
    """Runs of `size` code points of a non-empty text."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(c) - 1) / size).cast("int")), lambda i: F.substring(c, i * size + 1, F.lit(size)))


def split_long(c: Column, pattern: str, most: int) -> Column:
    """A text over `most` code points cut at the pattern, then by size; an array of stripped, non-empty texts."""
    parts = nonempty(F.transform(F.split(c, pattern, -1), strip))
    cut = F.transform(parts, lambda p: F.when(F.length(p) > most, F.transform(slices(p, most), strip)).otherwise(F.array(p)))
    return F.when(F.length(c) > most, nonempty(F.flatten(cut))).otherwise(F.array(c))


def two_decimals(x: Column) -> Column:
    """A double that isn't negative, rounded to two decimals by its exact binary value; true ties go to the even neighbour.

    Spark's own rounding takes the shortest decimal text of the double, so that 0.575 (a little less than that) becomes 0.58.
    A double that isn't the tie's own lies on the side that comparing tells. For the tie's own, halves of the bits are
    multiplied apart, without an error.
    """

    def near(b: Column) -> Column:
        tie, high = (b["m"] + 0.5) / 100, b["x"] * 134217729.0 - (b["x"] * 134217729.0 - b["x"])
        beyond = (high * 200 - (b["m"] * 2 + 1)) + (b["x"] - high) * 200
        up = F.when(b["x"] != tie, b["x"] > tie).when(beyond != 0, beyond > 0).otherwise(b["m"] % 2 == 1)
        return (b["m"] + up.cast("double")) / 100

    return once(x.cast("double"), lambda v: once(F.struct(v.alias("x"), F.floor(v * 100).cast("double").alias("m")), near))
