"""Secret scans by patterns and sliding-window entropy, in DataFrame functions only.

Patterns give the base spans.  Beside them, long runs of token characters are candidates.  A sign of
assignment parts a run, and so does a word of the allow-list, so neither a name before a value nor a placeholder beside it decides about the rest.
Each candidate has a character class (hex digits, letters and digits, base64 signs), and the Shannon entropy
of a sliding window is kept by incremental counts: one character's count falls, one rises, and
only their two terms of sum(c log2 c) change.  The windows at or over the class's
threshold make a span unless a pattern of the allow-list matches the candidate.

Nothing is shuffled: a document is one row throughout.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, with the least number of characters of the text that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: What every match of ASSIGN holds, in lower case; texts without it are not searched.
ASSIGN_NEEDS = ("passw", "secret", "token", "api")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
KINDS = ("assign", "access", "hex", "hexent", "alnument", "b64ent")
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


@dataclass(frozen=True)
class CharacterClass:
    """A class of candidates: its kind, the pattern that a whole candidate matches, bits of entropy that a window must have, and its characters."""

    kind: str
    pattern: str
    threshold: float
    alphabet: str


_HEX, _ALNUM = string.digits + "abcdefABCDEF", string.digits + string.ascii_letters
CLASSES = (CharacterClass("hexent", r"^[0-9A-Fa-f]+$", 3.2, _HEX), CharacterClass("alnument", r"^[A-Za-z0-9]+$", 3.7, _ALNUM), CharacterClass("b64ent", r".", 3.8, _ALNUM + "+/_-"))
#: Words of placeholders and runs of the alphabet, in either case; a run of token characters is parted where one lies.
ALLOW_WORDS = ("example", "placeholder", "sample", "dummy", "xxxx", "0123456789", "abcdefgh")
#: Candidates that match are no secrets: no mix of letters and digits, UUIDs.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: A candidate of nothing but such pieces between signs is a path of plain words and numbers, no secret.
SIGNS, PLAIN = r"[/_+-]", r"^([A-Za-z]{0,15}|[0-9]{1,8})$"


#: Matches that are put in place together.
TOGETHER = 128


def _placed(pairs: Column, begin: Column) -> Column:
    """(at, out): (start, end, found) of each of *pairs* (gap, found), the first gap beginning at *begin*, and where the last ends."""
    start = F.struct(begin.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,found:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["found"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("found")))).alias("out"))

    return F.aggregate(pairs, start, step)


def _bound(value: Column, body) -> Column:
    """body(value), with the value evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of the leftmost matches that don't overlap, in code points.

    Places are running sums of the lengths of gaps and matches.  An array that grows by one is copied each time, so the matches are
    summed in groups, and the groups' beginnings are summed apart: a text of very many matches costs no square of their number.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found")), lambda x: x["found"].isNotNull())
    named = F.transform(pairs, lambda x: F.struct(x["gap"].alias("gap"), x["found"].alias("found")))

    def grouped(all_: Column) -> Column:
        firsts = F.when(F.size(all_) > 0, F.sequence(F.lit(1), F.size(all_), F.lit(TOGETHER))).otherwise(F.array().cast("array<int>"))
        return F.transform(firsts, lambda i: _placed(F.slice(all_, i, F.lit(TOGETHER)), F.lit(0).cast("long")))

    return F.flatten(_bound(_bound(named, grouped), _moved))


def _moved(groups: Column) -> Column:
    """The spans of each group, moved on by what all groups before it are long."""
    begins = F.aggregate(groups, F.array(F.lit(0).cast("long")), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + g["at"])))
    return F.zip_with(groups, F.slice(begins, F.lit(1), F.size(groups)), lambda g, by: F.transform(g["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["found"].alias("found"))))


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def _c_log_c(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def high_entropy(found: Column, least: Column, cells: Column, window: int = WINDOW, classes: tuple[CharacterClass, ...] = CLASSES) -> Column:
    """(first, last): the first and last window of *window* characters, from 1, whose entropy in bits is *least* or more; 0 for none.

    The counts have *cells* places, which the characters of a class take in the order of :func:`_places`; one that no class has takes the last.
    """
    place = _places(classes)
    every = F.array(*(F.lit(place.get(chr(c), -1)) for c in range(128)))
    codes = F.transform(F.split(found, ""), lambda c: F.pmod(F.coalesce(F.get(every, F.ascii(c)), F.lit(-1)), cells))
    old = F.concat(F.array_repeat(F.lit(-1), window), F.slice(codes, F.lit(1), F.greatest(F.size(codes) - window, F.lit(0))))
    # A place's character comes in as the one a window before it goes out.
    moves = F.zip_with(codes, F.slice(old, F.lit(1), F.size(codes)), lambda a, b: F.struct(a.alias("new"), b.alias("old")))
    start = F.struct(F.array_repeat(F.lit(0), cells).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(acc: Column, m: Column) -> Column:
        new, old = m["new"], m["old"]
        at_new, at_old = F.get(acc["counts"], new), F.coalesce(F.get(acc["counts"], F.greatest(old, F.lit(0))), F.lit(0))
        change = _c_log_c(at_new + 1) - _c_log_c(at_new) - F.when(old >= 0, _c_log_c(at_old) - _c_log_c(at_old - 1)).otherwise(F.lit(0.0))
        total = acc["sum"] + F.when(new == old, F.lit(0.0)).otherwise(change)
        counts = F.when(new == old, acc["counts"]).otherwise(F.transform(acc["counts"], lambda c, k: c + F.when(k == new, 1).when(k == old, -1).otherwise(0)))
        place = acc["at"] + 1 - (window - 1)
        high = (place >= 1) & (math.log2(window) - total / window >= least)
        first = F.when(high & (acc["first"] == 0), place).otherwise(acc["first"])
        return F.struct(counts.alias("counts"), total.alias("sum"), (acc["at"] + 1).alias("at"), first.alias("first"), F.when(high, place).otherwise(acc["last"]).alias("last"))

    return F.aggregate(moves, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _places(classes: tuple[CharacterClass, ...]) -> dict[str, int]:
    """A place for every character of the classes, those of the first class first."""
    return {c: i for i, c in enumerate(dict.fromkeys("".join(c.alphabet for c in classes)))}


def _cells(c: CharacterClass, classes: tuple[CharacterClass, ...]) -> int:
    """How many places the counts of a class need."""
    place = _places(classes)
    return 1 + max(place[x] for x in c.alphabet)


def either_case(word: str) -> str:
    """A pattern for an ASCII word in either case, which means the same to every matcher."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


def without_words(text: Column, words: tuple[str, ...]) -> Column:
    """The text with blanks for these words, one after the other, so that all places stay."""
    out = text
    for word in words:
        out = F.regexp_replace(out, either_case(word), " " * len(word))
    return F.when(text.rlike("|".join(map(either_case, words))), out).otherwise(text) if words else text


def _entropy_spans(text: Column, window: int, classes: tuple[CharacterClass, ...], allow: tuple[str, ...], words: tuple[str, ...]) -> Column:
    def allowed(found: Column) -> Column:
        out = F.forall(F.split(found, SIGNS), lambda p: p.rlike(PLAIN))
        for pattern in allow:
            out = found.rlike(pattern) | out
        return out

    def classed(s: Column) -> Column:
        def of(c: CharacterClass) -> Column:
            return F.struct(F.lit(KINDS.index(c.kind)).alias("kind"), F.lit(c.threshold).alias("least"), F.lit(_cells(c, classes)).alias("cells"))

        own = of(classes[-1])
        for c in reversed(classes[:-1]):
            own = F.when(s["found"].rlike(c.pattern), of(c)).otherwise(own)
        return _bound(own, lambda c: F.struct(s["start"].alias("start"), c["kind"].alias("kind"), high_entropy(s["found"], c["least"], c["cells"], window, classes).alias("high")))

    # Each step binds its result, so that no fold is evaluated twice.
    kept = F.filter(_bound(without_words(text, words), lambda t: spans_of(t, CANDIDATE)), lambda s: ~allowed(s["found"]))
    hits = F.filter(F.transform(kept, classed), lambda s: s["high"]["first"] > 0)
    return F.transform(hits, lambda s: F.struct((s["start"] + s["high"]["first"] - 1).cast("long").alias("start"), s["kind"].alias("kind"), (s["start"] + s["high"]["last"] - 1 + window).cast("long").alias("end")))


def scan(docs: DataFrame, text_col: str = "text", window: int = WINDOW, classes: tuple[CharacterClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, words: tuple[str, ...] = ALLOW_WORDS) -> DataFrame:
    """*docs* with ``base`` and ``added``: arrays of (start, kind, end), kind a place in KINDS, sorted.

    Spans are in code points, end exclusive.  base: for each kind the leftmost matches that don't
    overlap, less those too short: "assign" 12 characters of the value, "access" 18, "hex" 16.  added:
    the stretch from the first to the last window of high entropy in a candidate, a run of CANDIDATE outside all *words*.  A span of one place may be in both.  A null text
    is empty and gives empty arrays.  Columns base and added of *docs* are replaced, others pass through.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lower = F.lower(text)
    needed = lower.contains(ASSIGN_NEEDS[0])
    for x in ASSIGN_NEEDS[1:]:
        needed = needed | lower.contains(x)
    none = F.array().cast(SPAN)
    assign = F.filter(spans_of(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["found"], f"^{ASSIGN}$", 2)) >= ASSIGN_LEAST)
    base = F.concat(
        F.when(needed, _kind(assign, "assign")).otherwise(none),
        F.when(text.contains("AKIA"), _kind(spans_of(text, ACCESS), "access")).otherwise(none),
        F.when(text.rlike(HEX), _kind(spans_of(text, HEX), "hex")).otherwise(none),
    )
    added = F.when(text.rlike(CANDIDATE), _entropy_spans(text, window, classes, allow, words)).otherwise(none)
    return docs.drop("base", "added").withColumns({"base": F.array_sort(base.cast(SPAN)), "added": F.array_sort(added.cast(SPAN))})


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
