"""License phrases, notices and whole license texts in documents.

Method: diagonal voting. Rolling word k-gram hashes of documents (k = 2 for base phrases, `gram` for notices and texts)
are joined with the k-gram positions of templates. A match votes for its diagonal, the place where the template would
start. Votes are aggregated by row, template and diagonal; diagonals with votes that lie within `slack` words of each
other (words put in or left out) are merged, and merged spans are verified: a base phrase must match whole on one
diagonal, word for word; a notice or text must have `least` of its distinct k-grams. Templates may have any length.

How it runs. Built-in expressions in one generated loop: positions are exploded, hashed, and probed against the
template hashes; the words of each match are compared, so hash clashes don't count. Texts are read once and never
shuffled; what is shuffled is votes, pre-aggregated by diagonal, and one entry a row. The template table is broadcast:
its size is known when the plan is made, as templates are arguments.

Defined results: null and empty texts have no words and no labels, positions are null and the score is 0. Rows are told
by id and text, so rows that share an id are each judged on their own text, and equal rows each get their row. A null
id is a value like any other. An empty table gives an empty result. Columns other than id and text are ignored,
whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import alnum_words, let, row_key, written
from lexmill.llm.license_texts import NOTICES, TEXTS

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_GRAMS = "t int, label string, base boolean, grams int, k int, o int, words array<string>"


def words_of(text: str) -> list[str]:
    return re.findall("[0-9a-z]+", text.lower())


def templates(phrases: dict[str, str], notices: dict[str, str], texts: dict[str, str]) -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, whether a base phrase, words)."""
    rows = [(label, True, words_of(p)) for p, label in phrases.items()] + [(label, False, words_of(n)) for more in (notices, texts) for label, n in more.items()]
    return [(k, label, base, words) for k, (label, base, words) in enumerate(rows)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, texts: dict[str, str] = TEXTS, least: float = 0.6, slack: int = 3, gram: int = 4) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, start, stop, share)."""
    spark = docs.sparkSession
    rows = []
    for t, label, base, words in templates(phrases, notices, texts):
        k = 2 if base else gram
        if len(words) < k:
            raise ValueError(f"the template of {label!r} has fewer than {k} words")
        grams = [tuple(words[o : o + k]) for o in range(len(words) - k + 1)]
        rows += [(t, label, base, len(set(grams)), k, o, list(g)) for o, g in enumerate(grams)]
    hashed = F.when(F.col("k") == 2, F.xxhash64(*(F.get("words", F.lit(j)) for j in range(2)))).otherwise(F.xxhash64(*(F.get("words", F.lit(j)) for j in range(gram))))
    known = spark.createDataFrame(rows, _GRAMS).withColumn("h", hashed)
    text = F.col(text_col).cast("string")
    met = let(docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text).alias("key"), text.alias("text")), w=alnum_words(F.col("text"))).drop("text")
    w, n, p = F.col("w"), F.size("w"), F.col("p")
    # place -1 stands for the row itself, whatever its words are
    met = met.select("key", "w", F.explode(F.sequence(F.lit(-1), F.greatest(n - 2, F.lit(-1)))).alias("p"))
    two, more = (F.xxhash64(*(F.get(w, F.greatest(p, F.lit(0)) + j) for j in range(k))) for k in (2, gram))
    hashes = [r["h"] for r in known.select("h").distinct().collect()]
    met = met.withColumns({"two": two, "more": more}).where((p < 0) | F.col("two").isin(hashes) | F.col("more").isin(hashes))
    met = met.select("key", "p", n.alias("n_words"), F.slice("w", F.greatest(p, F.lit(0)) + 1, max(2, gram)).alias("near"), F.explode(F.when(p < 0, F.array(F.lit(None).cast("long"))).otherwise(F.array("two", "more"))).alias("h"))
    met = met.join(F.broadcast(known), "h", "left").where((p < 0) | (F.col("t").isNotNull() & (F.slice("near", F.lit(1), F.col("k")) == F.col("words"))))
    votes = met.groupBy("key", "t", "label", "base", "grams", "k", (p - F.coalesce("o", F.lit(0))).alias("diagonal")).agg(
        F.count("*").alias("n"), F.collect_set("words").alias("found"), F.min("p").alias("first"), F.max("p").alias("last"), F.max("n_words").alias("n_words"))
    votes = written(votes, "license-votes")
    seen = votes.where("t IS NOT NULL")
    # base phrases: every 2-gram of the phrase on one diagonal is the phrase, word for word
    whole = F.size("found") == F.col("grams")
    base = seen.where(F.col("base") & whole).groupBy("key").agg(
        F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.sort_array(F.collect_set("label")).alias("base_labels"))
    # notices and texts: runs of neighbouring diagonals
    order = Window.partitionBy("key", "t").orderBy("diagonal")
    runs = seen.where(~F.col("base") | whole).withColumn("new", (F.col("base") | (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(order), F.lit(-(2**30))) > slack)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order)).groupBy("key", "t", "label", "grams", "k", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n"), F.min("first").alias("start"), (F.max("last") + F.col("k")).alias("stop"))
    runs = runs.withColumn("share", F.least(F.lit(1.0), F.col("n") / F.col("grams"))).where(F.col("share") >= least)
    spans = runs.groupBy("key").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.max("share").alias("score"), F.sort_array(F.collect_list(F.struct("start", "stop", "label", "share"))).alias("spans"))
    all_ = votes.where("t IS NULL").select("key", F.col("n_words").cast("long").alias("n_words"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    for part in (base, spans):
        part = part.withColumnRenamed("key", "_key")
        all_ = all_.join(part, all_["key"].eqNullSafe(part["_key"]), "left").drop("_key")
    none = F.array().cast("array<string>")
    return all_.select(F.col("key.id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans")
