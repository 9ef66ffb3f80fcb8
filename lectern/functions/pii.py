"""Personal data in texts: e-mail, Australian phone and tax numbers, Medicare, business numbers, payment cards.

All of it is DataFrame functions.  A span's place comes from the lengths of a text's matches and of what lies between them; the spans of all
kinds are then sorted and folded.  Running sums, folds and redaction work on groups of `GROUP` values, as adding to an array copies it.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats, check-digit weights, order of precedence.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+(?![\w-])",
    "phone_au": r"(?<![\d+])(?:\+61[\s-]?(?:\(0\)[\s-]?)?[2-478](?:[\s-]?\d){8}|\(0[2-478]\)[\s-]?\d(?:[\s-]?\d){7}|0[2-478](?:[\s-]?\d){8})(?!\d)",
    "tfn": r"(?<!\d)\d{3}[\s-]?\d{3}[\s-]?\d{2,3}(?!\d)",
    "medicare": r"(?<!\d)[2-6]\d{3}[\s-]?\d{5}[\s-]?\d(?:[\s-]?\d)?(?!\d)",
    "credit_card": r"(?<!\d)\d(?:[\s-]?\d){12,18}(?!\d)",
    "abn": r"(?<!\d)\d{2}[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{3}(?!\d)",
}
TFN9, TFN8 = (1, 4, 3, 7, 5, 8, 6, 9, 10), (10, 7, 8, 4, 6, 3, 5, 1)
MEDICARE, ABN = (1, 3, 7, 9, 1, 3, 7, 9), (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
PRECEDENCE = ("email", "credit_card", "abn", "medicare", "tfn", "phone_au")
GROUP = 256


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _weighted(number: Column, weights: tuple[int, ...]) -> Column:
    return sum((F.substring(number, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def tfn_ok(number: Column) -> Column:
    """Tax file number of 9 or 8 digits, not all the same."""
    n9, n8 = _weighted(number, TFN9) % 11 == 0, _weighted(number, TFN8) % 11 == 0
    varied = ~number.rlike(r"^(\d)\1*$")
    return F.coalesce(varied & F.when(F.length(number) == 9, n9).when(F.length(number) == 8, n8), F.lit(False))


def medicare_ok(number: Column) -> Column:
    return F.coalesce(number.rlike("^[2-6][0-9]{9,10}$") & (_weighted(number, MEDICARE) % 10 == F.substring(number, 9, 1).cast("int")), F.lit(False))


def abn_ok(number: Column) -> Column:
    """The first digit less one; a first digit of 0 is none."""
    return F.coalesce(number.rlike("^[1-9][0-9]{10}$") & ((_weighted(number, ABN) - ABN[0]) % 89 == 0), F.lit(False))


def card_ok(number: Column) -> Column:
    return F.coalesce((F.length(number) >= 13) & F.call_function("luhn_check", number), F.lit(False))


NATIVE = {"tfn": tfn_ok, "medicare": medicare_ok, "credit_card": card_ok, "abn": abn_ok}


def runs(text: Column, kind: str) -> Column:
    """The digits of each run that looks like a number of the kind."""
    return F.transform(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), digits)


def has(text: Column, kind: str) -> Column:
    """Whether a text holds personal data of the kind."""
    if kind in NATIVE:
        return F.exists(runs(text, kind), NATIVE[kind])
    return text.rlike("(?U)" + PATTERNS[kind])


def redacted_kind(text: Column, kind: str) -> Column:
    """The text without one kind that has no check digit."""
    return F.regexp_replace(text, "(?U)" + PATTERNS[kind], f"[REDACTED:{kind}]")


def _java(kind: str) -> str:
    """A kind's pattern with classes of all scripts spelled out: letters, numbers and _; decimal digits; white space and separators."""
    return PATTERNS[kind].replace(r"[\s-]", r"[\s\x1c-\x1f\x85\p{Z}-]").replace(r"\w", r"\p{L}\p{N}_").replace(r"\d", r"\p{Nd}")


@functools.cache
def _other_digits() -> tuple[str, str]:
    """Decimal digits of other scripts, and what they are in ASCII."""
    every = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.decimal(c, None) is not None]
    return "".join(every), "".join(str(unicodedata.decimal(c)) for c in every)


def _valid(found: Column, kind: str) -> Column:
    """Whether the check digits of a match are right; kinds without any always are."""
    if kind not in NATIVE:
        return F.lit(True)
    return NATIVE[kind](digits(F.when(found.rlike(r"[^\x00-\x7f]"), F.translate(found, *_other_digits())).otherwise(found)))


def _bound(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def _groups(values: Column) -> Column:
    """An array cut into arrays of GROUP values."""

    def cut(v: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / GROUP).cast("int")), lambda g: F.slice(v, g * GROUP + 1, F.lit(GROUP)))
        return F.when(F.size(v) > 0, groups).otherwise(F.slice(F.array(v), F.lit(1), F.lit(0)))

    return _bound(values, cut)


def _running(values: Column) -> Column:
    """The sums of an array's first 1, 2, ... values."""
    none = F.expr("cast(array() as array<int>)")

    def last(a: Column) -> Column:
        return F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))

    def summed(a: Column) -> Column:
        return F.aggregate(a, none, lambda sums, x: F.concat(sums, F.array(last(sums) + x)))

    def joined(inner: Column) -> Column:
        return _bound(summed(F.transform(inner, last)), lambda ends: F.flatten(F.transform(inner, lambda sums, g: F.transform(sums, lambda x: x + F.coalesce(F.get(ends, g - 1), F.lit(0))))))

    return _bound(F.transform(_groups(values), summed), joined)


def _places(text: Column, kind: str) -> Column:
    """start, -end and precedence of each match of a kind whose check digits are right."""
    pattern = _java(kind)
    rank = PRECEDENCE.index(kind)
    none = F.expr("cast(array() as array<struct<start:int,back:int,kind:int>>)")

    def placed(found: Column) -> Column:
        lengths = F.transform(found, F.length)
        ends = _running(F.zip_with(F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found)), lengths, lambda gap, n: gap + n))
        spot = F.zip_with(found, ends, lambda m, end: F.when(_valid(m, kind), F.struct((end - F.length(m)).alias("start"), (-end).alias("back"), F.lit(rank).alias("kind"))))
        return F.when(F.exists(found, lambda m: _valid(m, kind)), F.filter(spot, lambda x: x.isNotNull())).otherwise(none)

    return _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _found(text: Column, kinds: tuple[str, ...]) -> Column:
    """The places of all kinds; texts without an at sign, or without a digit, aren't searched for what has one."""
    none = F.expr("cast(array() as array<struct<start:int,back:int,kind:int>>)")
    numbers = [_places(text, k) for k in kinds if k != "email"]
    mails = F.when(F.contains(text, F.lit("@")), _places(text, "email")).otherwise(none) if "email" in kinds else none
    return F.concat(mails, F.when(text.rlike(r"\p{Nd}"), F.concat(*numbers)).otherwise(none) if numbers else none)


def _apart(spots: Column) -> Column:
    """Of sorted places those that don't overlap one kept before, in groups."""
    kept = "array<struct<start:int,back:int,kind:int>>"

    def step(acc: Column, x: Column) -> Column:
        return F.when(x["start"] >= acc["end"], F.struct((-x["back"]).alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    def group(acc: Column, g: Column) -> Column:
        inner = F.aggregate(g, F.struct(acc["end"].alias("end"), F.expr(f"cast(array() as {kept})").alias("kept")), step)
        return _bound(inner, lambda r: F.struct(r["end"].alias("end"), F.concat(acc["kept"], F.array(r["kept"])).alias("kept")))

    start = F.struct(F.lit(0).alias("end"), F.expr(f"cast(array() as array<{kept}>)").alias("kept"))
    return F.filter(F.aggregate(_groups(spots), start, group)["kept"], lambda g: F.size(g) > 0)


def spans(text: Column, kinds: tuple[str, ...] = tuple(PATTERNS)) -> Column:
    """Groups of places (start, back, kind) in code points, without overlap: of those that start first the longest, then by precedence."""
    if unknown := set(kinds) - set(PATTERNS):
        raise ValueError(f"unknown kinds {sorted(unknown)}; there are {', '.join(PATTERNS)}")
    return _bound(F.array_sort(_found(text, kinds)), _apart)


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PRECEDENCE)), kind + 1)


def _redacted(text: Column, groups: Column) -> Column:
    """The text with its places blotted out.  Each group's stretch is cut out of the text once."""

    def end(g: Column) -> Column:
        return -F.element_at(g, -1)["back"]

    def blotted(g: Column, i: Column) -> Column:
        low = F.coalesce(end(F.get(groups, i - 1)), F.lit(0))

        def told(piece: Column) -> Column:
            def one(x: Column, j: Column) -> Column:
                at = F.coalesce(-F.get(g, j - 1)["back"], low)
                return F.concat(F.substring(piece, at - low + 1, x["start"] - at), F.lit("[REDACTED:"), _name(x["kind"]), F.lit("]"))

            return F.array_join(F.transform(g, one), "")

        return _bound(F.substring(text, low + 1, end(g) - low), told)

    rest = F.substring(text, end(F.element_at(groups, -1)) + 1, F.length(text))
    return F.when(F.size(groups) > 0, F.concat(F.array_join(F.transform(groups, blotted), ""), rest)).otherwise(text)


def detected(rows: DataFrame, column: str, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """rows with findings (kind, start, end) and redacted; a null text has no findings and stays null."""
    text = F.col(column)
    found = rows.withColumn("spans__", spans(text, kinds))
    told = F.transform(F.flatten("spans__"), lambda x: F.struct(_name(x["kind"]).alias("kind"), x["start"].alias("start"), (-x["back"]).alias("end")))
    return found.withColumns({"findings": told, "redacted": _redacted(text, F.col("spans__"))}).drop("spans__")
