"""Quality rules for documents: fixed base rules and a decision list learned from labelled documents.

Method: sequential covering. From labelled statistics, conjunctions of thresholds are grown one after another (by
information gain on two thirds of the rows), pruned (on the other third), and kept only if they are precise by the
Laplace estimate there; covered
rows are taken out before the next one. The result is an ordered list that reads as text and becomes one Spark
conditional expression.

How it runs. Statistics are built-in expressions on each row; nothing is shuffled and no Python runs on executors. The
list is fitted in plain Python on the driver from at most `max_rows` labelled rows (those of least hashed id).

Defined results: null and empty texts have zero words and fail the base rules. Without usable labels the list is empty
and the base rules decide. Labels that are null are not used; of several labels of an id each counts, and rows that share
an id are each judged. Columns other than id and text are kept by `filter_quality` and otherwise ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import SPACE_CHARS, free_name, let, space_words

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Statistics that rules may test.
FEATURES = ("n_words", "mean_word", "symbols_per_word", "shouts_per_word", "dup_line_share", "repeat_share", "words_per_line")


def _without(text: Column, pieces) -> Column:
    for piece in pieces:
        text = F.replace(text, F.lit(piece), F.lit(""))
    return text


def with_statistics(docs: DataFrame, text_col: str = "text", mark: str = "_q") -> DataFrame:
    """The documents with a struct column of statistics named by `mark`, which must be free (see `free_name`)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    c = {k: free_name(docs, f"{mark}_{k}") for k in ("w", "l", "h", "t", "i")}
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    out = let(docs, **{c["w"]: space_words(text), c["l"]: lines})
    words = F.col(c["w"])
    n = F.size(words)
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    out = let(out, **{c["h"]: grams})
    # windows in order of their hash, where any is found twice
    hashes = F.col(c["h"])
    twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
    out = let(out, **{c["t"]: F.when(twice, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))})
    ordered = F.col(c["t"])
    again = F.filter(ordered, lambda x, j: F.get(ordered, j - 1)["h"].eqNullSafe(x["h"]) | F.get(ordered, j + 1)["h"].eqNullSafe(x["h"]))
    out = let(out, **{c["i"]: F.transform(F.coalesce(again, F.array().cast("array<struct<h:bigint,i:int>>")), lambda x: x["i"])})
    at = F.col(c["i"])
    covered = F.size(F.array_union(at, F.array_union(F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2))))
    each, share = F.greatest(n, F.lit(1)), F.size(c["l"])
    n_symbols = F.length(text) - F.length(_without(text, SYMBOLS))
    shouts = F.length(text) - F.length(_without(text, "!"))
    dup = share - F.size(F.array_distinct(c["l"]))
    chars = F.length(F.array_join(words, ""))
    stats = {
        "n_words": n, "word_chars": chars, "n_symbols": n_symbols, "n_dup_lines": dup, "n_repeat_words": covered, "n_lines": share,
        "n_shouts": shouts,
    }
    out = let(out, **{mark: F.struct(*(v.cast("long").alias(k) for k, v in stats.items()))})
    ratio = lambda a, b: (F.col(f"{mark}.{a}") / F.greatest(F.col(f"{mark}.{b}"), F.lit(1))).cast("double")
    more = {
        "mean_word": ratio("word_chars", "n_words"), "symbols_per_word": ratio("n_symbols", "n_words"), "shouts_per_word": ratio("n_shouts", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"), "repeat_share": ratio("n_repeat_words", "n_words"), "words_per_line": ratio("n_words", "n_lines"),
    }
    out = out.withColumn(mark, F.struct(f"{mark}.*", *(v.alias(k) for k, v in more.items())))
    return out.drop(*c.values())


def base_failed(mark: str = "_q") -> Column:
    return (F.col(f"{mark}.n_words") < MIN_WORDS) | (100 * F.col(f"{mark}.n_repeat_words") > REPEAT_PERCENT * F.col(f"{mark}.n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.bound if self.above else row[self.feature] < self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.bound!r}"


@dataclass
class DecisionList:
    """Ordered conjunctions; a row that meets one is rejected by it, others are kept."""

    rules: list[tuple[Test, ...]] = field(default_factory=list)

    def rule_of(self, row: dict) -> int | None:
        return next((k for k, tests in enumerate(self.rules, 1) if all(t.holds(row) for t in tests)), None)

    def expression(self, mark: str = "_q") -> Column:
        """Number of the first rule that a row meets, else null."""
        out = F.lit(None).cast("int")
        for k, tests in reversed(list(enumerate(self.rules, 1))):
            met = F.lit(True)
            for t in tests:
                value = F.col(f"{mark}.{t.feature}")
                met &= (value >= F.lit(t.bound)) if t.above else (value < F.lit(t.bound))
            out = F.when(met, F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"{k}. reject if {' and '.join(map(str, tests))}" for k, tests in enumerate(self.rules, 1)) or "keep all"


def _best(rows: list[tuple[dict, bool]], features) -> Test | None:
    """The threshold with the largest gain; it lies halfway between neighbouring values."""
    p = sum(bad for _, bad in rows)
    base, best, gain = math.log2(p / len(rows)), None, 1e-9
    for f in features:
        ordered = sorted((float(r[f]), bad) for r, bad in rows)
        below = 0
        for k, ((x, bad), (y, _)) in enumerate(zip(ordered, ordered[1:], strict=False), 1):
            below += bad
            if x < y:
                for above, q, n in ((True, p - below, len(rows) - k), (False, below, k)):
                    if q and (g := q * (math.log2(q / n) - base)) > gain:
                        best, gain = Test(f, above, (x + y) / 2), g
    return best


def _grow(rows: list[tuple[dict, bool]], features, most: int) -> list[Test]:
    tests: list[Test] = []
    while len(tests) < most and any(bad for _, bad in rows) and not all(bad for _, bad in rows):
        best = _best(rows, features)
        if best is None:
            break
        tests.append(best)
        rows = [x for x in rows if best.holds(x[0])]
    return tests


def _precision(tests, rows) -> float:
    """The share of bad rows among those that meet the tests, as if one more of each kind did: few hits prove little."""
    inside = [bad for r, bad in rows if all(t.holds(r) for t in tests)]
    return (sum(inside) + 1) / (len(inside) + 2)


def cover(rows: list[tuple[dict, bool]], features=FEATURES, max_rules: int = 12, max_tests: int = 3, min_precision: float = 0.9) -> DecisionList:
    """Fits a list to (statistics, bad) rows. A rule must keep `min_precision` on the rows that it wasn't grown on and on all (at 0.9, eight hits at least)."""
    out, left = DecisionList(), rows
    while len(out.rules) < max_rules and any(bad for _, bad in left):
        grow, prune = [x for k, x in enumerate(left) if k % 3], left[::3]
        tests = _grow(grow, features, max_tests)
        if not tests:
            break
        tests = list(max((tests[:k] for k in range(1, len(tests) + 1)), key=lambda x: (_precision(x, prune), -len(x))))
        if min(_precision(tests, prune), _precision(tests, left)) < min_precision:
            break
        out.rules.append(tuple(tests))
        left = [x for x in left if not all(t.holds(x[0]) for t in tests)]
    return out


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4096, **more) -> DecisionList:
    """A list that rejects what labels call bad (0). At most max_rows labelled rows are used, those of least hashed id."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id IS NOT NULL AND _label IS NOT NULL")
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    found = with_statistics(rows, "_text").where(~base_failed()).select("_id", "_label", "_q").orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_rows).collect()
    return cover([(r["_q"].asDict(), r["_label"] == 0) for r in found], **more)


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text", mark: str = "_q") -> DataFrame:
    """The documents with statistics in `mark`, and in `mark`_failed, _rule and _kept the base verdict, the first rule met and the whole verdict.

    Where a column of docs is called so or starts so, underscores are put behind `mark` until none does.
    """
    mark = free_name(docs, mark)
    out = with_statistics(docs, text_col, mark).withColumns({f"{mark}_failed": base_failed(mark), f"{mark}_rule": rules.expression(mark)})
    return out.withColumn(f"{mark}_kept", ~F.col(f"{mark}_failed") & F.col(f"{mark}_rule").isNull())


def filter_quality(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The documents, with their own columns, that pass."""
    mark = free_name(docs, "_q")
    judged = judge(docs, rules, text_col, mark)
    return judged.where(f"{mark}_kept").select(*(F.col(f"`{c}`") for c in docs.columns))
