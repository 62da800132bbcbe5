"""Chinese sentences, also for mixed texts: terminators with a window on both sides, quotations masked while cutting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import CUT, MASKED, MASKS, PAD, is_blank, mask_matches, nonempty, split_long, strip, unmask

#: Words before a terminator that keep the sentence open, quotation marks, terminators.
CONJUNCTIONS = (
    "因为 由于 所以 因此 于是 故 虽然 尽管 即使 即便 不论 不管 无论 但是 然而 不过 可是 但 却 只是 如果 假如 倘若 只要 除非 否则 "
    "并且 而且 同时 此外 另外 再者 更 为了 以便 以求 以至于 致使 使得"
).split()
QUOTES = ("「」", "『』", '""', "''", "“”")
ENDS = "。！？；.!?;"
LONG = r"(?U)(?<=[；，,;])[\s\x1C-\x1F]*"


def mask_quotations(text: Column) -> Column:
    """Terminators at the end of a quotation move behind its closing mark; others inside it are masked.

    A masked quotation ends in a pad as wide as the window, so words inside it don't keep a sentence open.
    """
    for opening, closing in QUOTES:
        text = mask_matches(text, f"{opening}[^{closing}\n]*{closing}", f"[{ENDS}]", moved_by(closing), lambda t: F.contains(t, F.lit(opening)))
    return text


def moved_by(mark: str):
    def moved(m: Column) -> Column:
        body = F.regexp_replace(F.substring(m, F.lit(1), F.length(m) - 1), f"[{ENDS}]+$", "")
        tail = F.substring(m, F.length(body) + 1, F.length(m) - F.length(body) - 1)
        return F.concat(F.translate(F.concat(body, F.lit(mark)), MASKED, MASKS), F.lit(PAD * 6), tail)

    return moved


def end_pattern(window: int = 5) -> str:
    """A terminator without a conjunction in the window before it nor only letters and digits, four or more, in the one after."""
    by_length: dict[int, list[str]] = {}
    for c in CONJUNCTIONS:
        by_length.setdefault(len(c), []).append(c)
    before = "|".join(f"(?:{'|'.join(words)}).{{0,{window - n}}}" for n, words in sorted(by_length.items()) if n <= window)
    some = "|".join([f"[a-zA-Z0-9]{{{window}}}", *(rf"[a-zA-Z0-9]{{{k}}}\n?\z" for k in range(4, window)), rf"[a-zA-Z0-9]{{{window - 1}}}\n"])
    return rf"(?s)([{ENDS}\n])(?!{some})(?<!(?:{before})[{ENDS}\n])"


def sentences(text: Column, longest: int = 200, window: int = 5) -> Column:
    """Array of sentence texts; a blank text has none."""
    marked = F.regexp_replace(mask_quotations(strip(text)), end_pattern(window), f"$1{CUT}")
    parts = nonempty(F.transform(F.split(marked, CUT, -1), lambda p: strip(unmask(p))))
    whole = F.flatten(F.transform(parts, lambda p: split_long(p, LONG, longest)))
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(whole)


def tokens(text: Column) -> Column:
    """A token for each character: the segmentation without a dictionary of words."""
    return nonempty(F.split(F.coalesce(text, F.lit("")), ""))
