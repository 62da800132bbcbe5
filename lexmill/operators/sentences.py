"""Sentence records, the choice of splitter by language and tier, and large texts in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import CUT, is_blank, let, strip
from lexmill.operators import chinese, english, japanese
from lexmill.operators.language import detect, route
from lexmill.schema import SENTENCES

#: A line of only these characters, two at least, separates parts.
SEPARATOR = r"^[\s\-—*=~•]{2,}$"


def records(texts: Column, language: Column, tier: Column, confidence: Column | None = None, boundaries: Column | None = None) -> Column:
    """Sentence records with dense indexes from an array of texts."""
    none = F.array().cast("array<string>")

    def one(t: Column, i: Column) -> Column:
        flag = F.lit(False) if boundaries is None else F.array_contains(boundaries, i)
        return F.struct(
            t.alias("text"), i.alias("index"), F.length(t).alias("char_count"), F.lit(0).alias("word_count"), none.alias("words"), none.alias("pos_tags"), language.alias("language"),
            tier.alias("tier"), (F.lit(1.0) if confidence is None else confidence).alias("confidence"), flag.alias("is_topic_boundary"), F.lit(0.0).alias("topic_depth_score"),
            F.lit("ok").alias("length_status"), F.lit("none").alias("length_strategy_applied"))

    return F.transform(texts, one).cast(SENTENCES)


def is_valid(texts: Column) -> Column:
    """Whether a splitter's result is plausible: not empty, mean length above 1 and below 1000."""
    total = F.aggregate(texts, F.lit(0), lambda a, t: a + F.length(t))
    mean = total / F.greatest(F.size(texts), F.lit(1))
    return (F.size(texts) > 0) & (mean > 1) & (mean < 1000)


def is_separator(line: Column) -> Column:
    """Blank lines and lines of only separator characters."""
    return is_blank(line) | strip(line).rlike("(?U)" + SEPARATOR)


def without_separators(sentences: Column) -> Column:
    return F.filter(sentences, lambda s: ~is_separator(s["text"]))


def split_texts(docs: DataFrame, text_col: str = "text", language_col: str = "language", longest: int = 200, extra=(), ellipsis: bool = True, window: int = 5) -> DataFrame:
    """Adds `texts`, the sentence texts by the language's rules."""
    chain = route(F.col(language_col))
    text = F.col(text_col)
    own = F.when(chain == "en", english.sentences(text, longest, extra, ellipsis)).when(chain == "ja", japanese.sentences(text)).otherwise(chinese.sentences(text, longest, window))
    return let(docs, texts=F.coalesce(own, F.array().cast("array<string>")))


def tier_of(texts: Column, language: Column, fallback: bool = True) -> Column:
    """Label of the rule tier; an implausible result comes from the last splitter and says so."""
    name = F.when(route(language) == "ja", "tier3_rule_ja").otherwise("tier3_rule")
    return F.when(is_valid(texts), name).otherwise(F.concat(name, F.lit("_fallback"))) if fallback else name


def split_sentences(docs: DataFrame, text_col: str = "text", forced: str = "auto", **rules) -> DataFrame:
    """Adds language, tier_used and sentences."""
    out = split_texts(detect(docs, text_col, forced).drop("confidence"), text_col, **rules)
    blank = is_blank(F.col(text_col))
    language = F.when(blank, "zh").otherwise(F.col("language"))
    tier = F.when(blank, "tier3_rule").otherwise(tier_of(F.col("texts"), F.col("language")))
    out = out.withColumns({"language": language, "tier_used": tier})
    confidence = F.when(F.col("language") == "ja", F.lit(0.9)).otherwise(F.lit(1.0))
    own = F.when(route(F.col("language")) == "ja", "tier3_rule_ja").otherwise("tier3_rule")
    return let(out, sentences=records(F.col("texts"), F.col("language"), own, confidence)).drop("texts")


def chunks(text: Column, most: int) -> Column:
    """A large text in stripped chunks: runs up to a terminator or line end, packed greedily, larger runs sliced."""
    marked = F.regexp_replace(text, "([。！？；!?.\n…])", f"$1{CUT}")
    runs = F.flatten(F.transform(F.filter(F.split(marked, CUT, -1), lambda r: r != ""), lambda r: F.when(F.length(r) > most, F.transform(F.sequence(F.lit(0), F.floor((F.length(r) - 1) / most).cast("int")), lambda i: F.substring(r, i * most + 1, F.lit(most)))).otherwise(F.array(r))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, r: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(r) <= most
        done = F.when(fits | (acc["now"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        return F.struct(done.alias("done"), F.when(fits, F.concat(acc["now"], r)).otherwise(r).alias("now"))

    packed = F.aggregate(runs, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    whole = F.filter(F.transform(packed, strip), lambda c: c != "")
    return F.when(F.length(text) > most, whole).otherwise(F.filter(F.array(strip(text)), lambda c: c != ""))


def chunked(docs: DataFrame, most: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_no, chunks_total, text): the chunks of each document."""
    pieces = let(docs.select(id_col, text_col), _c=chunks(F.coalesce(F.col(text_col), F.lit("")), most))
    return pieces.select(id_col, F.size("_c").alias("chunks_total"), F.posexplode("_c").alias("chunk_no", "text"))
