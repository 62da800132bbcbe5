"""A mix of sources by target weights.

Method: hierarchical budgeting. The target of tokens is divided down a tree of levels (domain, language, source) by the
weights of each node's children. A child that has fewer tokens than its share (over all its epochs) gets what it has;
the rest goes to its siblings by their weights, and only what all siblings together can't use reaches the ancestors'
other children, because a node never asks for more than its leaves hold. Each leaf then takes a prefix of its tokens
from seeded epochs: whole epochs while the budget lasts, and of the last epoch's order the documents up to the budget.

How it runs. Token counts, leaf sums and shares are DataFrame aggregates and windows over one row a node. The order of
an epoch is the MD5 of seed, epoch and id. Where a leaf's last epoch ends is found without sorting the leaf: its tokens
are summed by the next `digits` hex digits of the order (pre-aggregated, 256 sums a leaf at most), the range that holds
the end is chosen, and so on inside that range until it is one place. The number of rounds grows with the logarithm of
the largest leaf, and each looks only at rows of the chosen ranges. The result is one row a leaf, by which documents
are filtered in place; texts are not shuffled. Leaves are broadcast if they are at most `broadcast_leaves`, else joined.

Weights. A value's weight is the one given for it, else the one given for `OTHERS`. Where neither is, it is 0 on a level
that gives any weights, and 1 on a level that gives none. What has no weight isn't taken.

Tokens are words [^\\x20\\x09-\\x0D]+. Budgets are whole tokens, rounded down; a prefix never exceeds its budget.

Defined results: a null level value is a leaf of its own, with the weight given for None or for unlisted values. Null and
empty texts have no tokens; in an order they stand like others, so those before its end are in. A null id orders like an empty one. Rows
of a leaf that share an id share their place: all or none are in. A node without weight gets nothing. An empty table
gives an empty result. Extra columns are kept by `mix` whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import free_name, own_columns, space_words, written

OTHER = "other"
#: Hex digits of an order.
PLACE = 32
#: Stands in weights for the values that they don't list.
OTHERS = "*"
#: Production weights: by domain, by language, and equal sources within a language.
DOMAINS = {"web": ("src0",), "books": tuple(f"src{k}" for k in range(1, 7)), "news": tuple(f"src{k}" for k in range(7, 14)), "reference": tuple(f"src{k}" for k in range(14, 20))}
WEIGHTS: dict[str, dict[str | None, float]] = {"domain": {"web": 0.4, "books": 0.25, "news": 0.2, "reference": 0.15, OTHERS: 0.05}, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15, OTHERS: 0.05}, "source": {}}


def domain_of(source: Column, domains: Mapping[str, Sequence[str]] = DOMAINS) -> Column:
    out = F.lit(OTHER)
    for name, members in domains.items():
        out = F.when(source.isin(*members), name).otherwise(out)
    return out


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _weight(level: str, weights: Mapping[str | None, float]) -> Column:
    out = F.lit(float(weights.get(OTHERS, 0.0 if weights else 1.0)))
    for value, w in weights.items():
        if value != OTHERS:
            out = F.when(F.col(level).eqNullSafe(F.lit(value)), float(w)).otherwise(out)
    return out


def _share(nodes: DataFrame, parents: list[str], level: str, weight: Column) -> DataFrame:
    """Divides each parent's `budget` among its children by weight, none above its `capacity`: column `own`."""
    family, w, cap = Window.partitionBy(*parents), F.col("w"), F.col("capacity").cast("double")
    nodes = nodes.withColumn("w", weight).where("w > 0")
    order = family.orderBy(cap / w, level)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = nodes.withColumns({"left": F.col("budget") - (F.sum(cap).over(upto) - cap), "rest": F.sum(w).over(family) - (F.sum(w).over(upto) - w)})
    nodes = nodes.withColumn("full", cap * F.col("rest") <= F.col("left") * w * (1 + 1e-12))
    nodes = nodes.withColumn("level_of", F.max(F.when(~F.col("full"), F.col("left") / F.col("rest"))).over(family))
    return nodes.withColumn("own", F.when(F.col("full"), cap).otherwise(w * F.col("level_of"))).drop("w", "left", "rest", "full", "level_of")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str | None, float]], target: Column) -> DataFrame:
    """Leaves (levels, tokens, capacity) with a column `budget`, in whole tokens. target is an aggregate over leaves."""
    usable = F.lit(True)
    for level in levels:
        usable &= _weight(level, weights.get(level, {})) > 0
    leaves = leaves.where(usable)
    root = leaves.agg(F.least(target.cast("double"), F.sum("capacity").cast("double")).alias("budget"))
    above, parents = root, []
    for level in levels:
        path = [*parents, level]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        if parents:
            left, right = nodes.alias("n"), above.alias("a")
            same = F.lit(True)
            for p in parents:
                same &= F.col(f"n.{p}").eqNullSafe(F.col(f"a.{p}"))
            nodes = left.join(right, same).select("n.*", "a.budget")
        else:
            nodes = nodes.join(F.broadcast(above))  # one row
        shared = _share(nodes, parents, level, _weight(level, weights.get(level, {})))
        above, parents = shared.select(*path, F.col("own").alias("budget")), path
    return _join(leaves, above.withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long")), parents, False)


def _join(left: DataFrame, right: DataFrame, levels: Sequence[str], small: bool, how: str = "inner") -> DataFrame:
    """Joins on levels (null equals null) and keeps the left one's."""
    names = {level: f"_r{k}" for k, level in enumerate(levels)}
    right = right.withColumnsRenamed(names)
    same = F.lit(True)
    for level, other in names.items():
        same &= left[level].eqNullSafe(right[other])
    return left.join(F.broadcast(right) if small else right, same, how).drop(*names.values())


def plan_mix(docs: DataFrame, id_col: str, text_col: str, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str | None, float]], share: float, max_epochs: int, seed: int, digits: int) -> DataFrame:
    """One row a leaf: levels, tokens, budget, whole (epochs taken whole) and last (the order's first place of the epoch after that is out; null: all are)."""
    names = list(levels)
    rows = docs.select(F.col(id_col).alias("_id"), *(c.alias(k) for k, c in levels.items()), F.size(space_words(F.col(text_col).cast("string"))).cast("long").alias("tokens"))
    rows = written(rows, "mix-tokens")
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")).where("tokens > 0").withColumn("capacity", F.col("tokens") * max_epochs)
    leaves = budgets(leaves, names, weights, F.floor(F.sum("tokens") * F.lit(float(share)) + 1e-6))
    leaves = leaves.withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    leaves = written(leaves.select(*names, "tokens", "budget", "whole", "rest"), "mix-leaves")
    small = leaves.count() <= 100_000
    part = _join(rows, leaves.where("rest > 0").select(*names, "whole", "rest"), names, small)
    part = written(part.select(*names, "rest", "tokens", _order(seed, F.col("whole"), F.col("_id")).alias("place")), "mix-orders")
    ends = _ends(part, names, small, digits)
    return _join(leaves, ends, names, False, "left")


def _ends(part: DataFrame, names: list[str], small: bool, digits: int) -> DataFrame:
    """(levels, last): the first place of each leaf's order at which its tokens sum to more than `rest`."""
    known = part.select(*names).distinct().withColumns({"range": F.lit(""), "before": F.lit(0).cast("long")})
    for length in [*range(digits, PLACE, digits), PLACE]:
        inside = _join(part, known, names, small).where(F.col("place").startswith(F.col("range")))
        sums = inside.groupBy(*names, "rest", "before", F.substring("place", 1, length).alias("next")).agg(F.sum("tokens").alias("sum"), F.min("place").alias("low"), F.max("place").alias("high"))
        upto = Window.partitionBy(*names).orderBy("next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("after", F.col("before") + F.sum("sum").over(upto)).where("after > rest")
        # the range in which the budget runs out
        found = sums.groupBy(*names).agg(F.min(F.struct("next", (F.col("after") - F.col("sum")).alias("before"), "low", "high")).alias("b"))
        known = written(found.select(*names, F.col("b.next").alias("range"), "b.before", F.col("b.low").alias("last"), (F.col("b.low") != F.col("b.high")).alias("open")), "mix-ends")
        if known.where("open").limit(1).count() == 0:
            break
        known = known.drop("last", "open")
    return known.select(*names, "last")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: Mapping[str, Column] | None = None, weights: Mapping[str, Mapping[str | None, float]] = WEIGHTS, share: float = 0.8, max_epochs: int = 2, seed: int = 17, digits: int = 2, broadcast_leaves: int = 100_000) -> DataFrame:
    """The chosen documents with all their columns and `mix` (or the first free name that starts so), a struct of the levels, epoch (from 0) and the leaf's budget.

    share: target tokens as a share of the tokens of all leaves that have weight. max_epochs: how often a document may be taken at most.
    """
    levels = levels or {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    names = list(levels)
    leaves = written(plan_mix(docs, id_col, text_col, levels, weights, share, max_epochs, seed, digits), "mix-plan")
    of, mark = free_name(docs, "_of"), free_name(docs, "_leaf")
    found = docs.select(*own_columns(docs), F.struct(*(c.alias(k) for k, c in levels.items())).alias(of))
    leaf = leaves.select(F.struct(*names, "budget", "whole", "last").alias(mark))
    same = F.lit(True)
    for k in names:
        same &= F.col(f"{of}.{k}").eqNullSafe(F.col(f"{mark}.{k}"))
    found = found.join(F.broadcast(leaf) if leaves.count() <= broadcast_leaves else leaf, same)
    whole, last = F.col(f"{mark}.whole"), F.col(f"{mark}.last")
    partly = last.isNotNull() & (_order(seed, whole, F.col(f"`{id_col}`")) < last)
    times = whole + F.coalesce(partly, F.lit(False)).cast("int")
    epoch = F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)))
    found = found.withColumn(f"{mark}_epoch", epoch)
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), F.struct(f"{of}.*", F.col(f"{mark}_epoch").alias("epoch"), F.col(f"{mark}.budget").alias("budget")).alias(free_name(docs, "mix")))
