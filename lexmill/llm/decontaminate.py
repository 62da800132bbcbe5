"""Benchmark passages in documents, found by a prefix-filtered set join.

Method. A benchmark item's windows are its runs of `window` consecutive words (an item with fewer words is one window).
A window's set is its shingles of up to three words. Shingles are ordered by their count over all documents. An exact
occurrence must hold the whole set, so the necessary prefix is the one rarest shingle (a window with a shingle that no
document holds is out): only prefixes are joined with the rolling shingles of documents. A match's place in the window
fixes where the window would start; length and positional bounds (the window must lie inside the document) prune
candidates, and exact containment of all the window's words at that place is verified.

How it runs. Built-in expressions only, in two passes over the documents: one counts the benchmark's shingles
(pre-aggregated, one row a shingle), one joins the prefixes. Shingles are hashed inside the generated loop; where the
benchmark side is broadcast, candidates are verified on the row itself and nothing but found places and one entry a row
is shuffled. The benchmark side is broadcast only if its counted windows and bytes are at most `broadcast_windows` and
`broadcast_bytes`. Beyond that the joins shuffle hashes and, for the prefixes, the few words around a shingle; every
row's own entry comes from a pass of its own, so no key gathers all rows.

Defined results: a null or empty text has no words and no hits; null, empty and wordless items have no windows. Items
that share words are each counted. Rows are told by id and text: rows that share an id are each judged on their own
text, and equal rows each get their row. A null id is a value like any other. Empty tables give an empty result, or no
hits. Columns other than ids and texts are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import alnum_words, checkpointed, free_name, let, row_key, written

SHINGLE = 3


def _windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words): each item's windows."""
    words = items.select(F.col(id_col).alias("item"), alnum_words(F.col(text_col).cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    each = words.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, window).alias("words"))
    return each.distinct()


def _hash(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *(F.get(words, at + j) for j in range(n)))


def _by_size(words: Column, at: Column, size: Column, sizes: list[int]) -> Column:
    out = F.lit(None).cast("long")
    for n in sizes:
        out = F.when(size == n, _hash(words, at, n)).otherwise(out)
    return out


def _rolling(rows: DataFrame, sizes: list[int], low: int) -> DataFrame:
    """Rows (key, w) by place p from `low` on (-1: the row itself) and size, with the shingle's hash h there; null where none fits."""
    w, p = F.col("w"), F.col("p")
    each = rows.select("key", "w", F.explode(F.sequence(F.lit(low), F.greatest(F.size(w) - 1, F.lit(low)))).alias("p"))
    if len(sizes) > 1:
        each = each.select("key", "w", "p", F.explode(F.when(p < 0, F.array(F.lit(sizes[0]))).otherwise(F.array(*map(F.lit, sizes)))).alias("n"))
    else:
        each = each.withColumn("n", F.lit(sizes[0]))
    fits = (p >= 0) & (p + F.col("n") <= F.size(w))
    return each.withColumn("h", F.when(fits, _by_size(w, F.greatest(p, F.lit(0)), F.col("n"), sizes)))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, broadcast_windows: int = 1_000_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Per row: doc_id, n_words, n_hit (words inside occurrences), items (sorted ids as strings of the items with occurring windows)."""
    keyed = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, window, broadcast_windows, broadcast_bytes)
    return keyed.select(F.col("key.id").alias("doc_id"), "n_words", "n_hit", "items", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, broadcast_windows: int, broadcast_bytes: int) -> DataFrame:
    """(key, copies, n_words, n_hit, items): one row a key (id and text)."""
    text = F.col(text_col).cast("string")
    rows = let(docs.select(row_key(id_col, text).alias("key"), text.alias("text")), w=alnum_words(F.col("text"))).drop("text")
    held = checkpointed(_windows(benchmark, item_col, item_text_col, window))
    texts = held.select("words").distinct().withColumn("n", F.least(F.size("words"), F.lit(SHINGLE)))
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("words", " ")) + 160), F.lit(0)).alias("bytes"), F.collect_set("n").alias("sizes")).first()
    small = size["n"] <= broadcast_windows and size["bytes"] <= broadcast_bytes
    side = F.broadcast if small else (lambda x: x)
    sizes = sorted(size["sizes"]) or [SHINGLE]
    parts = texts.select("words", "n", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))).alias("o"))
    parts = parts.select("words", "n", "o", _by_size(F.col("words"), F.col("o"), F.col("n"), sizes).alias("h"))
    # how rare each shingle of the benchmark is in all documents
    counts = _rolling(rows, sizes, 0).select("h").where("h IS NOT NULL")
    counts = counts if small else counts.groupBy("h").agg(F.count("*").alias("n"))
    counts = counts.join(side(parts.select("h").distinct()), "h").groupBy("h").agg((F.count("*") if small else F.sum("n")).alias("count"))
    rarity = parts.join(checkpointed(counts), "h", "left")
    # the prefix: of each window's shingles the rarest, the leftmost of equals
    prefix = rarity.groupBy("words").agg(F.min(F.struct("count", "o", "h", "n")).alias("p"), F.count("*").alias("all"), F.count("count").alias("some")).where("all = some")
    prefix = prefix.select(F.col("p.h").alias("_h"), F.col("p.n").alias("_n"), "p.o", "words", F.size("words").alias("size"))
    start = F.col("p") - F.col("o")
    inside = (start >= 0) & (start + F.col("size") <= F.size("w"))
    spot = (F.col("key"), start.alias("s"), F.col("words"))
    if small:
        same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("words")
        met = _rolling(rows, sizes, -1)
        met = met.join(side(prefix), met["h"] == F.col("_h"), "left").where((F.col("p") < 0) | (F.col("_h").isNotNull() & inside & same))
        met = written(met.select(*spot, F.when(F.col("p") < 0, F.size("w")).alias("n_words")), "benchmark-places")
        own, spots = met.where("n_words IS NOT NULL").select("key", "n_words"), met.where("n_words IS NULL").select("key", "s", "words")
    else:
        own = rows.select("key", F.size("w").alias("n_words"))
        # the words that any window through the shingle can have
        first = F.greatest(F.col("p") - (window - 1), F.lit(0))
        met = _rolling(rows, sizes, 0).where("h IS NOT NULL").select("key", "p", "h", first.alias("first"), F.slice("w", first + 1, 2 * window).alias("near"))
        from_ = start - F.col("first")
        spots = met.join(prefix, met["h"] == F.col("_h")).where((start >= 0) & (from_ + F.col("size") <= F.size("near")))
        spots = spots.where(F.slice("near", F.greatest(from_, F.lit(0)) + 1, F.col("size")) == F.col("words")).select(*spot)
    spots = checkpointed(spots.distinct())
    # the union of the occurrences' spans, by row: what each adds beyond the furthest end before it
    order = Window.partitionBy("key").orderBy("s")
    ends = spots.groupBy("key", "s").agg(F.max(F.col("s") + F.size("words")).alias("e"))
    before = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = ends.withColumn("new", F.greatest(F.col("e") - F.greatest("s", before), F.lit(0))).groupBy("key").agg(F.sum("new").alias("n_hit"))
    items = spots.select("key", "words").distinct().join(side(held), "words").select("key", F.col("item").cast("string").alias("item")).distinct()
    items = items.groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_list("item")).alias("items"))
    hit = hits.join(items, hits["key"].eqNullSafe(items["_key"])).select("_key", "n_hit", "items")
    all_ = own.groupBy("key").agg(F.first("n_words").cast("long").alias("n_words"), F.count("*").cast("int").alias("copies"))
    return all_.join(hit, all_["key"].eqNullSafe(hit["_key"]), "left").select("key", "copies", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, broadcast_windows: int = 1_000_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark; every row is judged on its own text."""
    mark = free_name(docs, "_hit")
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, window, broadcast_windows, broadcast_bytes)
    bad = found.where("n_hit > 0").select(F.col("key").alias(mark))
    own = f"{mark}_own"
    keyed = docs.withColumn(own, row_key(id_col, F.col(text_col).cast("string")))
    return keyed.join(bad, keyed[own].eqNullSafe(bad[mark]), "left_anti").drop(own)
