"""An analyser for indexes: case and diacritics folded, Porter's stems (M. F. Porter, 1980)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.functions.shipping import map_arrow

# The paper's suffix rules of steps 2, 3 and 4.
STEP2 = dict(zip("ational tional enci anci izer abli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti".split(), "ate tion ence ance ize able al ent e ous ize ate ate al ive ful ous al ive ble".split(), strict=True))
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c for each consonant, v for each vowel; y after a consonant is a vowel."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swap(word: str, rules: dict[str, str]) -> str:
    for suffix in sorted((s for s in rules if word.endswith(s)), key=len, reverse=True)[:1]:
        stem = word[: -len(suffix)]
        return stem + rules[suffix] if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=50_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif m := re.fullmatch("(.*?)(?:ed|ing)", w):
        if "v" in _shape(m[1]):
            w = m[1]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2), STEP3)
    for suffix in sorted((s for s in STEP4 if w.endswith(s)), key=len, reverse=True)[:1]:
        base = w[: -len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
            w = base
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def analysed(text: str | None) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFKD", (text or "").casefold()) if not unicodedata.combining(c))
    return [stem(t) for t in re.findall(r"[^\W_]+", plain)]


def with_terms(rows: DataFrame, column: str) -> DataFrame:
    """rows with terms, the analysed words of a column."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(map(analysed, part.column(column).to_pylist())), pa.list_(pa.string()))], [*names, "terms"])

    return map_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField("terms", T.ArrayType(T.StringType()))]))
