"""Personal data and secrets in documents.

Method: candidate gradient boosting. High-recall generators propose overlapping spans; boosted trees score each from
its format and its context; a threshold for each kind, calibrated for precision on rows that the trees didn't see,
selects what is redacted. Base matches (below) are always spans; the trees decide on the other candidates. Of
overlapping candidates that pass, the best score stays; none may overlap a base span.

The trees are fitted once on the driver, on examples that a seeded generator writes, and travel with the task.

How it runs. One pass in Arrow batches, no shuffle. A text without digits is only looked at for addresses. All
patterns are linear in the text: an address is sought around each @, a number from the start of its digits.

Defined results: null and empty texts have no spans. Each row is judged by itself, so repeated ids and null ids give
their rows. An empty table gives an empty result. Columns other than id and text are ignored, whatever their names.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.boosting import BoostedTrees, threshold_for

#: Kinds in output order; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "id", "secret")
SPANS = "array<struct<kind: string, start: int, stop: int, score: double, base: boolean>>"

_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Generators of candidates beyond the base patterns.
_MORE = {
    "email": re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{2,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{2,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "id": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "secret": re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{32,128}|(?:AKIA|ghp_|sk-)[0-9A-Za-z]{16,64})(?![0-9A-Za-z])"),
}
#: International account numbers of 15 to 34 characters in any grouping; national phone numbers of 8 to 12 digits.
_IBAN = re.compile(r"(?<![0-9A-Za-z-])[A-Z]{2}[0-9]{2}(?:[ \u00A0-]?[A-Z0-9]){11,30}")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+])(?<![0-9][ ./-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,8}(?:[ ./-][0-9]{2,8}){0,4}(?![ ./-]?[0-9])(?![A-Za-z])|(?<![0-9A-Za-z+.,-])(?:0[1-9][0-9]{7,10}|[6-9][0-9]{8})(?![0-9A-Za-z])")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2}|[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-](?:19|20)[0-9]{2}")
#: Words that speak for or against a kind where they stand shortly before a candidate.
_HINTS = (
    re.compile(r"card|visa|master|kredit|carte|tarjeta", re.I),
    re.compile(r"phone|t[eé]l|call|mobile|fax|llam|appel|handy|m[oó]vil|rufnummer", re.I),
    re.compile(r"mail|contact|write|kontakt", re.I),
    re.compile(r"\bip\b|host|address|server|login", re.I),
    re.compile(r"ssn|social|iban|account|passport|konto|compte", re.I),
    re.compile(r"token|key|secret|passw|credential|bearer|auth", re.I),
    re.compile(r"version|isbn|order|sha|commit|hash|checksum|md5|price|part|serial|invoice|ticket|tracking|digest", re.I),
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found around each @ of a run of address characters."""
    at = text.find("@")
    while at >= 0:
        start = at
        while start and _RUN.match(text[start - 1]):
            start -= 1
        run = _RUN.match(text, start)
        end, low = run.end(), start
        while 0 <= at < end:
            domain = _DOMAIN.match(text, at + 1, end) if at > low else None
            if domain:
                yield low, domain.end()
                low = domain.end()
            else:
                low = at + 1
            at = text.find("@", low, end)
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches by kind as listed, then by start."""
    out = [("email", i, j) for i, j in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for kind, pattern, low, high in (("card", _CARD, 13, 19), ("phone", _PHONE, 9, 15)):
            if kind == "phone" and "+" not in text:
                continue
            for m in pattern.finditer(text):
                digits = "".join(c for c in m.group() if "0" <= c <= "9") if m.end() - m.start() >= low else ""
                if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                    out.append((kind, *m.span()))
    return out


def mod97(own: str) -> bool:
    """Whether an international account number's check digits are right."""
    own = "".join(c for c in own if c.isalnum())
    return own[:2].isalpha() and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each start the longest number and those that end with an earlier group, of 15 to 34 characters."""
    for m in _IBAN.finditer(text):
        n, start = 0, m.start()
        for k in range(start, m.end()):
            n += text[k].isalnum()
            if 15 <= n <= 34 and text[k].isalnum() and not text[k + 1 : k + 2].isalnum() and (text[k + 1 : k + 2] != "-" or k + 1 < m.end()):
                yield start, k + 1


def _nationals(text: str) -> Iterator[tuple[int, int]]:
    for m in _NATIONAL.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 12:
            yield m.span()


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that the generators propose; they may overlap each other and base matches."""
    digits = bool(_DIGIT.search(text))
    kinds = KINDS if digits else ("email", "secret")
    out = [(k, *m.span()) for k in kinds if k != "email" or "at" in text and ("[" in text or "(" in text) for m in _MORE[k].finditer(text)]
    return out + [("id", *s) for s in _ibans(text)] + [("phone", *s) for s in _nationals(text)] if digits else out


def features(text: str, kind: str, start: int, stop: int) -> list[float]:
    own, left, right = text[start:stop], text[max(0, start - 32) : start], text[stop : stop + 12]
    digits = "".join(c for c in own if "0" <= c <= "9")
    groups = re.findall(r"[0-9]+", own)
    account = kind == "id" and own[:2].isalpha()
    return [
        *(float(kind == k) for k in KINDS), float(len(own)), float(len(digits)), len(digits) / len(own), float(len(groups)), float(max(map(len, groups), default=0)),
        float(len(digits) >= 12 and luhn(digits)), float(digits[:1] in ("3", "4", "5", "6") and digits != ""), len(set(own)) / len(own), float(sum(c in " -.()" for c in own)),
        float(left[-1:].isalnum()), float(right[:1].isalnum()), float(left.rstrip()[-1:] in ("=", ":")), float(left[-1:] in ("\"", "'")), *(float(bool(h.search(left))) for h in _HINTS),
        float(account), float(account and mod97(own)), float(digits[:1] == "0"), float(bool(_DATE.fullmatch(own))),
    ]


@dataclass
class Model:
    trees: BoostedTrees
    thresholds: dict[str, float]

    def spans(self, text: str) -> list[tuple[str, int, int, float, bool]]:
        """All spans, by kind as listed, then start."""
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str]) -> list[list[tuple[str, int, int, float, bool]]]:
        """The same for each text; the trees score all candidates at once."""
        bases, candidates_of, rows = [], [], []
        for text in texts:
            base = base_spans(text)
            taken = Taken(base)
            more = [c for c in dict.fromkeys(candidates(text)) if not taken.meets(c[1], c[2])]
            bases.append(base)
            candidates_of.append(more)
            rows += [features(text, *c) for c in more]
        scores = self.trees.predict(np.array(rows)).tolist() if rows else []
        out, at = [], 0
        for base, more in zip(bases, candidates_of, strict=True):
            chosen: list[tuple[str, int, int, float, bool]] = [(*b, 1.0, True) for b in base]
            own = Taken([])
            for c, score in sorted(zip(more, scores[at : at + len(more)], strict=True), key=lambda x: (-x[1], x[0][1], -x[0][2], KINDS.index(x[0][0]))):
                if score >= self.thresholds.get(c[0], 2.0) and not own.meets(c[1], c[2]):
                    own.add(c[1], c[2])
                    chosen.append((*c, float(score), False))
            at += len(more)
            out.append(sorted(chosen, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))
        return out


class Taken:
    """Places that spans cover, as ranges in order that don't overlap."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.stops: list[int] = []
        for i, j in sorted((i, j) for _, i, j in spans):
            if self.stops and i < self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], j)
            else:
                self.starts.append(i)
                self.stops.append(j)

    def meets(self, start: int, stop: int) -> bool:
        k = bisect_right(self.stops, start)
        return k < len(self.starts) and self.starts[k] < stop

    def add(self, start: int, stop: int) -> None:
        """Takes in a span that meets none."""
        k = bisect_right(self.stops, start)
        self.starts.insert(k, start)
        self.stops.insert(k, stop)


def _number(rng: random.Random, n: int, valid: bool | None = None) -> str:
    while True:
        out = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(n - 1))
        if valid is None or luhn(out) == valid:
            return out


#: Lengths of account numbers by country, and how many letters follow the check digits.
_ACCOUNTS = (("DE", 22, 0), ("FR", 27, 0), ("ES", 24, 0), ("GB", 22, 4), ("NL", 18, 4), ("IT", 27, 1), ("AT", 20, 0), ("BE", 16, 0), ("CH", 21, 0), ("NO", 15, 0), ("PT", 25, 0), ("MT", 31, 4))


def _account(rng: random.Random, valid: bool) -> str:
    """An account number with right or wrong check digits, compact or in groups."""
    country, n, letters = rng.choice(_ACCOUNTS)
    rest = "".join(rng.choice("ABCDEFGHIKLMNPRSTUVW") for _ in range(letters)) + "".join(rng.choice("0123456789") for _ in range(n - 4 - letters))
    check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
    own = f"{country}{check if valid else (check + rng.randint(1, 90)) % 97:02d}{rest}"
    return own if rng.random() < 0.5 else " ".join(own[i : i + 4] for i in range(0, n, 4))


def _national(rng: random.Random) -> str:
    """A national phone number in one of several groupings (8 to 12 digits)."""
    shape = rng.choice(("0d dd dd dd dd", "0dd dddddddd", "0ddd ddddddd", "ddd ddd ddd", "0ddd/dddddd", "0dddd-dddddd", "(0dd) dddddddd", "dd dd dd dd", "0d.dd.dd.dd.dd", "0ddddddddd", "ddd dd dd dd", "0ddd ddd dddd"))
    return "".join(rng.choice("0123456789") if c == "d" else c for c in shape)


def _plain_numbers(rng: random.Random) -> str:
    """A date or numbers in a row: shapes of national numbers that are none."""
    y, m, t = rng.randint(1950, 2030), rng.randint(1, 12), rng.randint(1, 28)
    return rng.choice((f"{y}-{m:02d}-{t:02d}", f"{t:02d}.{m:02d}.{y}", f"{t:02d}/{m:02d}/{y}", *[" ".join(str(rng.randint(10, 99999)) for _ in range(3))] * 2))


def examples(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """Seeded (text, kind, start, stop, 1 if personal) rows, about as many of each kind."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    good = {
        "email": [lambda: f"{word()} [at] {word()} [dot] com", lambda: f"{word()}(at){word()}.org"],
        "ip": [lambda: ":".join(hexes(4) for _ in range(8))],
        "card": [lambda: _number(rng, 16, True), lambda: "-".join(re.findall("....", _number(rng, 16, True))), lambda: _number(rng, 15, True)],
        "phone": [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", *[lambda: _national(rng)] * 4],
        "id": [lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: _account(rng, True)],
        "secret": [lambda: hexes(40), lambda: "ghp_" + hexes(36), lambda: hexes(64)],
    }
    said = {"email": "contact mail write", "ip": "ip host login", "card": "card visa pay", "phone": "phone call tel telefon appel handy", "id": "ssn iban account konto compte", "secret": "token key secret"}
    against = "version isbn order sha commit checksum price serial invoice tracking".split()
    out = []
    for k in range(n):
        kind = KINDS[k % len(KINDS)]
        own = rng.choice(good[kind])()
        yes = rng.random() < 0.5
        if yes:
            hint = rng.choice(said[kind].split()) if kind in ("phone", "id", "secret") or rng.random() < 0.5 else word()
            join = rng.choice([" = \"", ": ", " "]) if kind == "secret" else rng.choice([": ", " ", " is "])
        else:
            hint, join = rng.choice([*against, word()] if kind != "card" else against), rng.choice([" ", ": ", " no. "])
            if kind == "card":
                own = _number(rng, rng.choice((13, 16, 16, 19)), False)
                hint = rng.choice([*against, word()])
            elif kind in ("email", "ip"):
                hint, own = rng.choice(against), own if kind == "ip" else f"{word()} (at) {word()}.{d(2)}"
            elif kind == "phone" and rng.random() < 0.3:
                own = _plain_numbers(rng)
            elif kind == "id" and own[:2].isalpha():
                hint = rng.choice([hint, *said["id"].split()])
                # wrong check digits, or a right number and a word too much
                own = _account(rng, False) if rng.random() < 0.6 else _account(rng, True) + " " + "".join(rng.choice("ABDEGKLNORST") for _ in range(rng.randint(1, 7)))
        left = f"{word()} {word()} {hint}{join}"
        out.append((f"{left}{own} {word()}", kind, len(left), len(left) + len(own), int(yes)))
    return out


@lru_cache(maxsize=4)
def fitted(rows: int = 3000, seed: int = 7, precision: float = 0.97) -> Model:
    """Trees on two thirds of the seeded examples, thresholds from the rest."""
    made = examples(rows, seed)
    x, y = np.array([features(t, k, i, j) for t, k, i, j, _ in made]), np.array([r[-1] for r in made], float)
    held = np.arange(len(made)) // len(KINDS) % 3 == 0
    trees = BoostedTrees().fit(x[~held], y[~held])
    scores, kinds = trees.predict(x), np.array([r[1] for r in made])
    return Model(trees, {k: threshold_for(scores[held & (kinds == k)], y[held & (kinds == k)], precision) for k in KINDS})


def redacted(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first."""
    out, end = [], 0
    for kind, i, j, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if i >= end:
            out += [text[end:i], f"[{kind.upper()}]"]
        elif j <= end:
            continue
        end = max(end, j)
    return "".join([*out, text[end:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, redact: bool = True) -> DataFrame:
    """Per row: doc_id, spans (kind, start, stop, score, base) and, if asked for, the redacted text."""
    model = model or fitted()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = model.spans_of(texts)
            spans = pa.array([[dict(zip(("kind", "start", "stop", "score", "base"), s, strict=True)) for s in x] for x in found], kind)
            out = {"doc_id": batch.column("doc_id"), "spans": spans}
            if redact:
                out["redacted"] = pa.array([redacted(t, s) for t, s in zip(texts, found, strict=True)], pa.string())
            yield pa.record_batch(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {SPANS}" + ", redacted string" * redact)
