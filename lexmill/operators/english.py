"""English sentences: rules on terminators, with abbreviations, quotations and ellipses masked while cutting."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import CUT, DOT, ELLIPSIS, MASKED, MASKS, is_blank, mask_matches, nonempty, split_long, strip, unmask

#: Abbreviations that don't end a sentence.
ABBREVIATIONS = (
    "Mr. Mrs. Ms. Dr. Prof. Sr. Jr. St. U.S. U.K. U.S.A. E.U. U.N. Inc. Ltd. Corp. Co. LLC. etc. i.e. e.g. vs. cf. al. "
    "a.m. p.m. A.M. P.M. No. Vol. pp. p. n.b. q.v. Jan. Feb. Mar. Apr. Jun. Jul. Aug. Sep. Oct. Nov. Dec. "
    "Mon. Tue. Wed. Thu. Fri. Sat. Sun."
).split() + ["et al."]
TOKEN = r"[A-Za-z]+(?:'[a-z]+)?|\d+(?:\.\d+)?|[^\s\w]"
#: A masked abbreviation; where a sentence would start with one, the one before stays open.
_ABBREVIATED = f"[A-Za-z]+{DOT}"
LONG = r"(?U)(?<=[,;:])[\s\x1C-\x1F]+"


def mask_abbreviations(text: Column, extra: Iterable[str] = ()) -> Column:
    """The dots of whole-word abbreviations masked, longer abbreviations first."""
    known = sorted({*ABBREVIATIONS, *extra}, key=lambda a: (-len(a), a))
    pattern = rf"(?U)(?<!\w)(?:{'|'.join(map(re.escape, known))})(?!\w)"
    return mask_matches(text, pattern, r"\.", lambda m: F.translate(m, ".", DOT), lambda t: t.rlike(pattern))


def mask_quotations(text: Column, quote: str) -> Column:
    """Quotations with a terminator inside become opaque."""
    pattern = f"{quote}[^{quote}]*{quote}"
    return mask_matches(text, pattern, "[.!?]", lambda m: F.translate(m, MASKED, MASKS), lambda t: F.contains(t, F.lit(quote)))


def cut(text: Column, ellipsis: bool = True) -> Column:
    """Marks sentence ends in a masked text and splits there."""
    if ellipsis:
        text = F.regexp_replace(text, r"\.{3,}", ELLIPSIS)
    text = F.regexp_replace(text, rf"(?U)([.!?;])[\s\x1C-\x1F]+(?=[A-Z\"(])(?!{_ABBREVIATED})", f"$1{CUT}")
    if ellipsis:
        text = F.regexp_replace(text, rf"(?U){ELLIPSIS}[\s\x1C-\x1F]+(?=[a-z])", f"{ELLIPSIS}{CUT}")
    return F.split(text, CUT, -1)


def sentences(text: Column, longest: int = 200, extra: Iterable[str] = (), ellipsis: bool = True) -> Column:
    """Array of sentence texts; a blank text has none."""
    masked = mask_abbreviations(strip(text), extra)
    masked = mask_quotations(mask_quotations(masked, '"'), "'")
    parts = F.transform(cut(masked, ellipsis), lambda p: strip(F.regexp_replace(unmask(p), r"[\t ]+", " ")))
    whole = F.flatten(F.transform(nonempty(parts), lambda p: split_long(p, LONG, longest)))
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(whole)


def tokens(text: Column) -> Column:
    """Words, numbers and punctuation marks."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + TOKEN), F.lit(0))
