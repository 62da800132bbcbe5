"""Japanese sentences: terminators outside brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import CUT, is_blank, mask_matches, nonempty, strip

#: Bracket pairs that protect what is inside, terminators.
BRACKETS = ("「」", "『』", "（）", "()", "〔〕")
ENDS = "。！？\n"
_HIDDEN = "".join(chr(0xE020 + k) for k in range(len(ENDS)))


def sentences(text: Column) -> Column:
    """Array of sentence texts. Each kind of bracket protects from an opening one to the next closing one."""
    masked = text
    for opening, closing in BRACKETS:
        masked = mask_matches(masked, rf"\Q{opening}\E[^{closing}]*\Q{closing}\E", f"[{ENDS}]", lambda m: F.translate(m, ENDS, _HIDDEN), lambda t: F.contains(t, F.lit(opening)))
    parts = F.split(F.regexp_replace(masked, f"([{ENDS}])", f"$1{CUT}"), CUT, -1)
    whole = nonempty(F.transform(parts, lambda p: strip(F.translate(p, _HIDDEN, ENDS))))
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(whole)
