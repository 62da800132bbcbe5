"""Topic boundaries between sentences: similarity of neighbouring windows of sentences, its depth and its peaks."""

from __future__ import annotations

import math
from collections import Counter
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import let
from lexmill.operators.sentences import records

#: Characters that don't count as terms.
STOP = "的了在是不也和就都而及与或但被把从到这那上下有我你他她它们个之以为所能会很太又再还吧吗啊呢嗯哦哈呀哟噢喔嘛呗啵"
TERM = r"[\x{4E00}-\x{9FFF}]|[A-Za-z][A-Za-z']*"


def terms(text: Column) -> Column:
    """Chinese characters but stop characters, and ASCII words in lower case."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)
    return F.filter(found, lambda t: ~t.isin(*STOP))


def jaccard(a: Column, b: Column) -> Column:
    """Shared terms by all terms; 0 if either has none."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1))).otherwise(F.lit(0.0))


def cosine(dot: Column, a: Column, b: Column) -> Column:
    """From a dot product and two sums of squares; 0 if either is 0."""
    return F.when((a > 0) & (b > 0), F.coalesce(dot, F.lit(0)) / (F.sqrt(a) * F.sqrt(b))).otherwise(F.lit(0.0))


def tiles(rows: DataFrame, id_col: str = "doc_id", window: int = 3, step: int | None = None, terms_of=terms) -> DataFrame:
    """(id, tile, term, n): term counts of windows of sentences (id, index, text). A tile is named by its first sentence."""
    step = step or max(1, window // 2)
    last = Window.partitionBy(id_col)
    rows = rows.select(id_col, "index", "text", (F.max("index").over(last) + 1).alias("n_sentences")).where(F.col("n_sentences") >= 2 * window)
    low = F.greatest(F.lit(0), (F.ceil((F.col("index") - window + 1) / step) * step).cast("int"))
    high = F.least(F.col("index"), F.col("n_sentences") - window)
    own = F.when(low <= high, F.sequence(low, F.greatest(high, low), F.lit(step)))
    spread = rows.select(id_col, F.explode(own).alias("tile"), terms_of(F.col("text")).alias("terms")).select(id_col, "tile", F.explode_outer("terms").alias("term"))
    return spread.groupBy(id_col, "tile", "term").agg(F.count("term").alias("n"))


def similarities(counts: DataFrame, id_col: str = "doc_id", step: int = 1) -> DataFrame:
    """(id, tile, similarity) of each tile and the next one."""
    after = Window.partitionBy(id_col, "term").orderBy("tile")
    meets = F.when((F.lead("tile").over(after) == F.col("tile") + step) & F.col("term").isNotNull(), F.col("n") * F.lead("n").over(after))
    each = counts.withColumn("product", meets).groupBy(id_col, "tile").agg(F.sum("product").alias("dot"), F.sum(F.col("n") * F.col("n")).alias("square"))
    order = Window.partitionBy(id_col).orderBy("tile")
    each = each.withColumn("next", F.lead("square").over(order))
    return each.where("next IS NOT NULL").select(id_col, "tile", cosine(F.col("dot"), F.col("square"), F.col("next")).alias("similarity"))


def depths(sims: DataFrame, id_col: str = "doc_id", smoothing: int = 0) -> DataFrame:
    """Adds depth: how far the similarity lies below its neighbours; the first and last have none."""
    order = Window.partitionBy(id_col).orderBy("tile")
    for _ in range(max(0, smoothing)):
        l, c, r = F.lag("similarity").over(order), F.col("similarity"), F.lead("similarity").over(order)
        sims = sims.withColumn("similarity", F.coalesce((l + 2 * c + r) / 4, c))
    l, r = F.lag("similarity").over(order), F.lead("similarity").over(order)
    return sims.withColumn("depth", F.coalesce(F.greatest(F.lit(0.0), l + r - 2 * F.col("similarity")), F.lit(0.0)))


def peaks(found: DataFrame, id_col: str, threshold: float, ratio: float) -> DataFrame:
    """(id, index, depth_score, confidence) of local maxima of depth above a threshold and a share of the deepest."""
    order, doc = Window.partitionBy(id_col).orderBy("tile"), Window.partitionBy(id_col)
    found = found.withColumns({"l": F.lag("depth").over(order), "r": F.lead("depth").over(order), "most": F.max("depth").over(doc)})
    peak = (F.col("depth") > F.greatest(F.lit(float(threshold)), F.col("most") * ratio)) & (F.col("depth") >= F.col("l")) & (F.col("depth") >= F.col("r"))
    return found.where(peak).select(id_col, F.col("tile").alias("index"), F.col("depth").alias("depth_score"), F.least(F.lit(1.0), F.col("depth") / F.col("most")).alias("confidence"))


def boundaries(rows: DataFrame, id_col: str = "doc_id", window: int = 3, step: int | None = None, threshold: float = 0.15, smoothing: int = 0) -> DataFrame:
    """(id, index, position, depth_score, confidence, text_before, text_after) of sentences that start a topic."""
    step = step or max(1, window // 2)
    found = peaks(depths(similarities(tiles(rows, id_col, window, step), id_col, step), id_col, smoothing), id_col, threshold, 0.3)
    order = Window.partitionBy(id_col).orderBy("index")
    near = rows.select(
        id_col, "index", F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("position"),
        F.coalesce(F.lag("text").over(order), F.lit("")).alias("before"), F.concat("text", F.coalesce(F.lead("text").over(order), F.lit(""))).alias("after"))
    right30 = F.substring(F.col("before"), F.greatest(F.length("before") - 29, F.lit(1)), F.lit(30))
    return found.join(near, [id_col, "index"]).select(id_col, "index", "position", "depth_score", "confidence", right30.alias("text_before"), F.substring("after", 1, 30).alias("text_after"))


def peaks_of(counts: list[Counter[str]], window: int = 3, step: int | None = None, threshold: float = 0.15, smoothing: int = 0) -> list[tuple[int, float, float]]:
    """(index, depth, confidence) of the sentences that start a topic, of one document's term counts by sentence."""
    step = step or max(1, window // 2)
    if len(counts) < 2 * window:
        return []
    places = range(0, len(counts) - window + 1, step)
    tiles_ = [sum(counts[k : k + window], Counter()) for k in places]
    squares = [sum(n * n for n in t.values()) for t in tiles_]
    sims = []
    for k, (a, b) in enumerate(pairwise(tiles_)):
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        dot = sum(n * b[t] for t, n in a.items() if t in b)
        sims.append(dot / (math.sqrt(squares[k]) * math.sqrt(squares[k + 1])) if squares[k] and squares[k + 1] else 0.0)
    for _ in range(max(0, smoothing)):
        sims = [(sims[k - 1] + 2 * c + sims[k + 1]) / 4 if 0 < k < len(sims) - 1 else c for k, c in enumerate(sims)]
    deep = [max(0.0, sims[k - 1] + sims[k + 1] - 2 * c) if 0 < k < len(sims) - 1 else 0.0 for k, c in enumerate(sims)]
    most = max(deep, default=0.0)
    least = max(threshold, 0.3 * most)
    return [(places[k], deep[k], min(1.0, deep[k] / most)) for k in range(1, len(deep) - 1) if deep[k] > least and deep[k] >= deep[k - 1] and deep[k] >= deep[k + 1]]


def find_topics(docs: DataFrame, texts_col: str = "texts", out_col: str = "topics", **tiling) -> DataFrame:
    """Adds an array of (index, position, depth_score, confidence, text_before, text_after) of sentences that start a topic.

    What `boundaries` gives, but terms are expressions, and tiles, similarities and peaks are found inside the row in Arrow
    batches, so nothing is shuffled and rows need no ids.
    """

    @F.pandas_udf(T.ArrayType(T.StructType.fromDDL("index int, position long, depth_score double, confidence double")))
    def found(sentences: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for told, sizes in zip(sentences, lengths, strict=True):
            starts = [0, *accumulate(n + 1 for n in (() if sizes is None else sizes.tolist()))]
            out.append([(k, int(starts[k]), depth, sure) for k, depth, sure in peaks_of([Counter(s) for s in told], **tiling)] if told is not None else [])
        return pd.Series(out, dtype=object)

    texts = F.col(texts_col)
    counted = let(docs, _terms=F.transform(texts, terms))
    marked = let(counted, _peaks=found(F.col("_terms"), F.transform(texts, F.length)))

    def with_texts(p: Column) -> Column:
        before, after = F.coalesce(F.get(texts, p["index"] - 1), F.lit("")), F.concat(F.get(texts, p["index"]), F.coalesce(F.get(texts, p["index"] + 1), F.lit("")))
        right30 = F.substring(before, F.greatest(F.length(before) - 29, F.lit(1)), F.lit(30))
        return p.withField("text_before", right30).withField("text_after", F.substring(after, 1, 30))

    return marked.withColumn(out_col, F.transform("_peaks", with_texts)).drop("_terms", "_peaks")


def mark_topics(docs: DataFrame, texts_col: str = "texts", shortest: int = 100, text_col: str = "text", **tiling) -> DataFrame:
    """Adds `topic_starts`, the indexes of sentences that start a topic; short texts have none."""
    long_ = F.coalesce(F.length(text_col) >= shortest, F.lit(False))
    marked = find_topics(docs.withColumn("_long", F.when(long_, F.col(texts_col))), "_long", "_topics", **tiling)
    return marked.withColumn("topic_starts", F.coalesce(F.col("_topics.index"), F.array().cast("array<int>"))).drop("_long", "_topics")


def semantic_records(texts: Column, language: Column, starts: Column) -> Column:
    """Sentence records of the semantic tier."""
    return records(texts, language, F.lit("tier3_rule"), boundaries=starts)


def token_boundaries(tokens: DataFrame, id_col: str = "doc_id", window: int = 3, step: int | None = None, threshold: float = 0.15, smoothing: int = 0) -> DataFrame:
    """The older form on tokens (id, index, text), each a term as it is: (id, index, position, depth_score, confidence)."""
    step = step or max(1, window // 2)
    counts = tiles(tokens, id_col, window, step, F.array)
    found = peaks(depths(similarities(counts, id_col, step), id_col, smoothing), id_col, threshold, 0.4)
    before = Window.partitionBy(id_col).orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    places = tokens.select(id_col, "index", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).alias("position"))
    return found.join(places, [id_col, "index"]).select(id_col, "index", "position", "depth_score", "confidence")
