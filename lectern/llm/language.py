"""Language ID with a bit-sliced Bloom filter of character n-grams.

Every slot of the filter is a bitmask of languages (of 64 each, as many as it takes), so that one probe of `PROBES` slots returns all
languages that contain an n-gram.  A document's hits are counted per language; the share of its n-grams that a language
contains is corrected for the filter's false positives of that language, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.shipping import map_arrow
from lectern.llm.common import checkpoint, text_chunks

#: Documents of each language to learn from, at most in expectation (chosen by a hash of doc_id).
SAMPLE = 2000
#: Slots that each n-gram sets; a language's n-grams set at most this share of the filter's slots, whose number is a power of two and this at least.
PROBES, FULL, LEAST_SLOTS = 3, 0.25, 1 << 16
#: N-grams rarer than this in a language's sample aren't learned, so that no language has more than 1 / RARE of them.
RARE = 2.0**-18
#: A language contains an n-gram if it has it this often in the sample, and at this share of the largest rate among languages.
LEAST, SHARE = 2, 0.2
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the n-gram around each letter, and the offsets of each text's.

    The n-gram is the letter before (or a border), the letter and the two after it within the word.
    """
    low = [(t or "").lower() for t in texts]
    c = np.frombuffer(("\0" + "\0\0".join(low) + "\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c], c, 0).astype(np.uint64)
    c0, c1, c2, c3 = c[:-3], c[1:-2], c[2:-1], c[3:]
    at = np.flatnonzero(c1)
    p = np.uint64(0x9E3779B97F4A7C15)
    h = ((c0[at] * p + c1[at]) * p + c2[at]) * p + np.where(c2[at] > 0, c3[at], 0)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    ends = np.cumsum([len(t) + 2 for t in low]) if low else np.zeros(0, np.int64)
    return h, np.concatenate([[0], np.searchsorted(at, ends, "left")])


def _slots(h: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The places of n-grams among n slots (a power of two), for each probe."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield (h + np.uint64(k) * step & np.uint64(n - 1)).astype(np.int64)


@dataclass
class Filter:
    """languages in order; bit l % 64 of masks[l // 64] of a slot stands for languages[l]; false_hit: its rate of false positives."""

    languages: list[str]
    masks: np.ndarray
    false_hit: np.ndarray

    @classmethod
    def of(cls, languages: list[str], entries: list[np.ndarray]) -> Filter:
        most = max((len(h) for h in entries), default=0)
        n = LEAST_SLOTS
        while PROBES * most > FULL * n:
            n *= 2
        masks = np.zeros((-(-len(languages) // 64), n), np.uint64)
        for k, h in enumerate(entries):
            for s in _slots(h, n):
                masks[k // 64, s] |= np.uint64(1 << k % 64)
        fill = [float((masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean()) for k in range(len(languages))]
        return cls(languages, masks, np.array([f**PROBES for f in fill]))

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The corrected share of each language for each text (0 to 1), and the number of its n-grams."""
        h, at = grams(texts)
        n, out = np.diff(at), np.zeros((len(texts), len(self.languages)))
        places = list(_slots(h, self.masks.shape[1]))
        for group, mask in enumerate(self.masks):
            found = np.full(len(h), np.uint64(0xFFFFFFFFFFFFFFFF))
            for s in places:
                found &= mask[s]
            for k in range(64 * group, min(64 * group + 64, len(self.languages))):
                wrong = self.false_hit[k]
                hits = np.concatenate([[0], np.cumsum(found >> np.uint64(k % 64) & np.uint64(1))])[at].astype(np.int64)
                out[:, k] = np.clip((np.diff(hits) / np.maximum(n, 1) - wrong) / (1 - wrong if wrong < 1 else 1), 0, 1)
        return out, n


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for tests: crc32 of its doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_chunks(batches):
        texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
        for name in sorted(set(langs)):
            g, n = np.unique(grams([t for t, x in zip(texts, langs, strict=True) if x == name])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Filter:
    """The filter learned from docs (doc_id, text, lang), about `sample` documents of each language.

    Rows without text or language aren't used.  Only the n-grams of each language that are common enough in it reach the driver.
    """
    rows = docs.where("lang is not null and text is not null")
    found = dict(sorted((r[0], r[1]) for r in rows.groupBy("lang").count().collect()))
    if not found:
        return Filter.of([], [])
    share = F.broadcast(docs.sparkSession.createDataFrame([(k, min(1.0, sample / n)) for k, n in found.items()], "lang string, share double"))
    chance = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.join(share, "lang").where(chance < F.col("share"))
    counts = map_arrow(rows.select("lang", "text"), _counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = checkpoint(counts)
    total = F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("total")))
    counts = counts.join(total, "lang").where((F.col("n") >= LEAST) & (F.col("n") >= RARE * F.col("total"))).select("lang", "gram", "n", "total")
    got = counts.toArrow()
    lang = pc.index_in(got.column("lang").combine_chunks(), pa.array(list(found))).to_numpy(zero_copy_only=False)
    gram = got.column("gram").to_numpy().view(np.uint64)
    rate = got.column("n").to_numpy() / got.column("total").to_numpy()
    order = np.argsort(gram, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]])) if len(gram) else order
    highest = np.empty(len(gram))
    highest[order] = np.repeat(np.maximum.reduceat(rate[order], first), np.diff(np.append(first, len(gram)))) if len(gram) else rate
    keep = rate >= SHARE * highest
    return Filter.of(list(found), [np.sort(gram[keep & (lang == k)]) for k in range(len(found))])


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """docs with lang_pred and score.

    lang_pred is the language with the largest corrected share (the first by name of several), `und` for a null
    text, one without letters, or a filter without languages; score is its lead over the next
    language, 0 to 1.  All other columns pass through; an empty table gives an empty one.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept.value
        for b in text_chunks(batches):
            if model.languages:
                rate, n = model.rates(b.column("text").to_pylist())
                best = rate.argmax(axis=1)
                top = np.sort(np.concatenate([np.zeros((len(rate), 1)), rate], axis=1), axis=1)
                lang = [model.languages[k] if m else UNKNOWN for k, m in zip(best, n, strict=True)]
                score = np.where(n > 0, top[:, -1] - top[:, -2], 0.0)
            else:
                lang, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    fields = docs.select(*names).schema.fields
    return map_arrow(docs.select(*names), run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, lang_pred and score, which replace columns of these names; learned from those that aren't held out.

    A null doc_id isn't held out.  Rows that repeat stay, and an empty table gives an empty one; other columns pass through.
    """
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return predict(marked, fit(marked.where("not held_out"), sample))
