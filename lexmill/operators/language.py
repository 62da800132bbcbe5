"""Language of a text by its characters, and routing by language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import is_blank, let, strip, two_decimals

#: Character classes and punctuation that doesn't count.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}"
KANA = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}"
LETTERS = "A-Za-z"
PUNCTUATION = r""".,!?;:"'()\[\]{}，。！？；：（）【】"""


def count_of(text: Column, inside: str) -> Column:
    """Code points of a class."""
    return F.length(F.regexp_replace(text, f"(?U)[^{inside}]+", ""))


def counters(text: Column) -> Column:
    """Struct of counts: cjk, kana, ascii letters and all that are neither space nor punctuation."""
    t = F.coalesce(text, F.lit(""))
    rest = F.length(F.regexp_replace(t, rf"(?U)[\s\x1C-\x1F{PUNCTUATION}]+", ""))
    return F.struct(count_of(t, CJK).alias("cjk"), count_of(t, KANA).alias("kana"), count_of(t, LETTERS).alias("ascii"), rest.alias("total"))


def language_of(c: Column, blank: Column) -> Column:
    """zh, en, ja or mixed from counters."""
    share = lambda name: c[name] / F.greatest(c["total"], F.lit(1))
    return (
        F.when(blank | (c["total"] == 0), "zh")
        .when(share("kana") > 0.1, "ja")
        .when(share("cjk") > 0.3, F.when(share("ascii") > 0.2, "mixed").otherwise("zh"))
        .when(share("ascii") > 0.9, "en")
        .otherwise("mixed")
    )


def confidence_of(c: Column, language: Column, blank: Column) -> Column:
    n = c["cjk"] + c["kana"] + c["ascii"]
    own = F.when(language == "ja", c["kana"] + c["cjk"]).when(language == "zh", c["cjk"]).when(language == "en", c["ascii"])
    value = F.when(language == "mixed", F.lit(0.5)).otherwise(two_decimals(own / F.greatest(n, F.lit(1))))
    return F.when(blank | (n == 0), F.lit(0.0)).otherwise(value)


def detect(docs: DataFrame, text_col: str = "text", forced: str = "auto") -> DataFrame:
    """Adds language and confidence; a forced language other than auto replaces the detected one."""
    out = let(docs, _c=counters(F.col(text_col)))
    blank = is_blank(F.col(text_col))
    out = let(out, _l=language_of(F.col("_c"), blank))
    zero = F.col("_c.cjk") + F.col("_c.kana") + F.col("_c.ascii") == 0
    told = F.when(blank | zero, "zh").otherwise(F.col("_l"))
    language = F.col("_l") if forced == "auto" else F.lit(forced)
    return out.withColumns({"language": language, "confidence": confidence_of(F.col("_c"), told, blank)}).drop("_c", "_l")


def route(language: Column) -> Column:
    """The splitter chain of a language: en, ja, and zh for everything else."""
    return F.when(language.isin("en", "ja"), language).otherwise("zh")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = r"\n\n") -> DataFrame:
    """(id, paragraph, text, language): stripped, non-empty paragraphs, each with its own language."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), separator, -1), strip), lambda p: p != "")
    return detect(docs.select(id_col, F.posexplode(parts).alias("paragraph", "text"))).drop("confidence")
