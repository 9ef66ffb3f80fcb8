"""Removal of passages that an earlier document already has, through a log-structured fingerprint index.

A window is `window` consecutive words of one document.  Fingerprinting all windows would cost a row for
each word, so each window is represented by the smallest hash among its `GRAM`-word grams (winnowing): equal
windows choose the same gram, wherever they stand, hence no repeated window can hide.  One posting stands
for a chosen gram and its context, the words of all windows that chose it.

* The index has a sorted immutable run for each batch of documents: one row for each gram, bucketed by it, and the
  contexts of grams that have several.  A new batch becomes a run and is merge-joined with the older ones, bucket by
  bucket; this decides which of its postings are repeated.  When there are `FANOUT` runs they are compacted into one.
  The index can be kept, and opened again by its path, for batches that come later.
* Grams of one document only are done.  A context that an earlier document has word for word is a run of repeated windows.
* What is left are contexts at the edges of repeated passages.  Their single windows are verified by their words.

Words of up to 15 bytes are compared as they are, longer ones by 128 bits of BLAKE2b; contexts by 64 and single windows by 96 bits of
BLAKE2b over their words.  The hash of a gram only proposes.

A word is removed if any window over it also starts in a document with a smaller doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.shipping import map_arrow
from lectern.llm.common import bucketed, checkpoint, entries, mixed, partitions, remove, scratch, text_chunks, utf8, word_bounds, word_codes

WINDOW, GRAM, FANOUT, BATCHES = 50, 10, 2, 3
#: Words of a posting's context, at most: longer runs of one context are several rows.
LONGEST = 60000
M = (1 << 64) - 1


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbouring words, by doubling."""
    h, have = mixed(codes[:, 0], codes[:, 1]), 1
    while 2 * have <= n:
        h, have = mixed(h[:-have], h[have:]), 2 * have
    return mixed(h[: len(h) - (n - have)], h[n - have :])


def _digests(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> bytes:
    """BLAKE2b digests of `size` bytes of the words from each start to each end, one after the other."""
    view, make = memoryview(np.ascontiguousarray(codes)).cast("B"), hashlib.blake2b
    return b"".join([make(view[s:e], digest_size=size).digest() for s, e in zip((16 * starts).tolist(), (16 * ends).tolist(), strict=True)])


def _sliding(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """The best of each n neighbours."""
    have = 1
    while 2 * have <= n:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def postings_of(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Document number, gram, context digest, first word and number of words of the context of each chosen gram."""
    starts, ends, first = word_bounds(data, offsets)
    n, gram = len(starts), min(GRAM, window)
    span = window - gram + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    if n < window:
        return none
    codes = word_codes(data, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    g = _grams(codes, gram)
    g[g == 0] = 1
    low = _sliding(g, span, np.minimum)
    stop = first[1:][doc]
    fits = np.arange(len(low)) + window <= stop[: len(low)]
    best = np.zeros(len(g) + span - 1, np.uint64)
    best[span - 1 : span - 1 + len(low)] = np.where(fits, low, 0)
    p = np.flatnonzero(_sliding(best, span, np.maximum)[: len(g)] == g)
    if not len(p):
        return none
    # The windows that chose gram p start after the last smaller gram before it and end before the first one after it.
    near = np.full(len(g) + 2 * span, M, np.uint64)
    near[span : span + len(g)] = g
    a, b = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
    steps = np.arange(1, max(2, span))
    for k in range(0, len(p), 1 << 14):
        q = p[k : k + (1 << 14)]
        less = near[q[:, None] + span - steps] < g[q][:, None]
        a[k : k + len(q)] = q - np.where(less.any(1), less.argmax(1), span - 1)
        less = near[q[:, None] + span + steps] < g[q][:, None]
        b[k : k + len(q)] = q + np.where(less.any(1), less.argmax(1), span - 1) - span + 1
    a, b = np.maximum(a, first[doc[p]]), np.minimum(np.minimum(b, p), stop[p] - window)
    c = mixed(np.frombuffer(_digests(codes, a, b + window, 8), np.uint64), (p - a).astype(np.uint64))
    # Monotonous text repeats a context at overlapping places: these are one posting, as what holds for one holds for all.
    d, f, a, b = doc[p], g[p], a - first[doc[p]], b + window - first[doc[p]]
    new = np.ones(len(p), bool)
    new[1:] = (d[1:] != d[:-1]) | (f[1:] != f[:-1]) | (c[1:] != c[:-1]) | (a[1:] > b[:-1]) | (a[1:] // LONGEST != a[:-1] // LONGEST)
    i = np.flatnonzero(new)
    return d[i], f[i], c[i], a[i], b[np.append(i[1:], len(p)) - 1] - a[i]


def windows_of(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers, 96 bits in all, for the windows that start at the given words of the given documents."""
    starts, ends, first = word_bounds(data, offsets)
    at = first[doc] + start
    found = np.frombuffer(_digests(word_codes(data, starts, ends), at, at + window, 12), np.uint32).reshape(-1, 3)
    return np.ascontiguousarray(found[:, :2]).view(np.int64)[:, 0], found[:, 2].view(np.int32)


LOG = "f long, c long, doc_id long, twin long, at long"


def postings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """f, c, doc_id, twin, at: the chosen grams of every row of docs (doc_id, twin, text) with a doc_id.  twin tells rows of equal doc_id apart;
    at packs first word and number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            doc, f, c, a, n = postings_of(*utf8(b.column("text")), window)
            ids, twins = (b.column(x).to_numpy(zero_copy_only=False)[doc].astype(np.int64) for x in ("doc_id", "twin"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f.view(np.int64), c.view(np.int64), ids, twins, (a << 32) + n)], ["f", "c", "doc_id", "twin", "at"])

    return map_arrow(docs.where("doc_id is not null").select("doc_id", "twin", "text"), run, LOG)


class FingerprintIndex:
    """Sorted immutable runs at a path, which can be opened again by another index at that path.

    A run has `grams`, bucketed and sorted by f: f, doc_id, twin, at, c (the posting with the smallest doc_id), hi (the largest doc_id),
    several (contexts); and `contexts`: f, c, doc_id, twin, at for each context of a gram with several.  A run counts once its contexts
    are complete.  Merging runs takes smallest and largest values, so a run that is merged twice, as after a crash in compaction, changes
    nothing.
    """

    GRAMS = "f bigint, doc_id bigint, twin bigint, at bigint, c bigint, hi bigint, several boolean"
    WHO = ("doc_id", "twin", "at", "c")

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.fanout = spark, path or scratch(spark, "fingerprints"), fanout
        done = sorted(name for name in entries(spark, self.path) if "_SUCCESS" in entries(spark, f"{self.path}/{name}/contexts"))
        self.runs: list[str] = done
        self.made = max([int(name.split("-")[1]) + 1 for name in entries(spark, self.path)], default=0)
        self.buckets = int(done[0].split("-")[2]) if done else buckets or partitions(spark)

    def _name(self, run: str) -> str:
        return bucketed(self.spark, f"{self.path}/{run}/grams", self.GRAMS, "f", self.buckets)

    def grams(self, run: str) -> DataFrame:
        return self.spark.table(self._name(run))

    def contexts(self, run: str) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/{run}/contexts")

    def _new(self, grams: DataFrame) -> str:
        run = f"run-{self.made:06d}-{self.buckets}"
        self.made += 1
        grams.select("f", *self.WHO, "hi", "several").write.insertInto(self._name(run))
        self.spark.catalog.refreshTable(self._name(run))
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"drop table if exists {self._name(run)}")
        remove(self.spark, f"{self.path}/{run}")

    def looked_up(self, run: str) -> DataFrame:
        """The run's grams, merge-joined with all older runs: f, lo, hi, several over all, and old, the older runs' postings of f."""
        found = self.grams(run).select("f", F.col("doc_id").alias("lo"), "hi", "several", "c", F.array().cast("array<struct<c:bigint,doc_id:bigint,twin:bigint,at:bigint>>").alias("old"))
        for other in self.runs:
            o = self.grams(other).select("f", F.struct("c", "doc_id", "twin", "at").alias("o"), F.col("hi").alias("o_hi"), F.col("several").alias("o_several"))
            several = F.col("several") | F.coalesce(F.col("o_several") | (F.col("o.c") != F.col("c")), F.lit(False))
            old = F.when(F.col("o").isNotNull(), F.array_append("old", F.col("o"))).otherwise(F.col("old"))
            found = found.join(o.hint("merge"), "f", "left").select("f", F.least("lo", "o.doc_id").alias("lo"), F.greatest("hi", "o_hi").alias("hi"), several.alias("several"), "c", old.alias("old"))
        return found.select("f", "lo", "hi", "several", "old")

    def add(self, log: DataFrame) -> DataFrame:
        """Adds a batch of postings as a run.  Returns doc_id, twin, at, whole, later: the batch's contexts that an earlier document, of this batch or
        of an older run, has (whole); and those, of older runs too, whose windows must be verified, with whether an earlier document has the gram (later)."""
        if len(self.runs) >= self.fanout:
            self.compact()
        who = F.min(F.struct(*self.WHO)).alias("who")
        grams = log.groupBy("f").agg(who, F.max("doc_id").alias("hi"), (F.min("c") < F.max("c")).alias("several"))
        run = self._new(grams.select("f", "who.*", "hi", "several"))
        wanted = checkpoint(self.looked_up(run).where("lo < hi or several"))
        shared = checkpoint(log.join(wanted.select("f", "lo", "hi", "several"), "f"))
        many = shared.where("several")
        contexts = many.groupBy("f", "c").agg(F.min(F.struct("doc_id", "twin", "at")).alias("who")).select("f", "c", "who.*")
        contexts.write.parquet(f"{self.path}/{run}/contexts")
        repeated = wanted.where("several and lo < hi")
        old = repeated.select("f", F.explode("old").alias("o")).select("f", "o.*")
        for other in self.runs:
            old = old.unionByName(self.contexts(other).join(repeated.select("f"), "f", "left_semi"))
        old = checkpoint(old.select("f", "c", "doc_id", "twin", "at"))
        first = old.union(self.contexts(run)).groupBy("f", "c").agg(F.min("doc_id").alias("first"))
        known = shared.where("not several and doc_id > lo").select("doc_id", "twin", "at", F.lit(True).alias("whole"), F.lit(True).alias("later"))
        known = known.union(many.where("lo < hi").join(first, ["f", "c"]).select("doc_id", "twin", "at", F.expr("doc_id > first").alias("whole"), F.expr("doc_id > lo").alias("later")))
        known = checkpoint(known.union(old.select("doc_id", "twin", "at", F.lit(False), F.lit(False))))
        self.runs.append(run)
        return known

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(self.runs) < 2:
            return
        old = list(self.runs)
        rows = self.grams(old[0]).select("f", F.struct(*self.WHO).alias("who"), "hi", "several", F.array().cast("array<struct<doc_id:bigint,twin:bigint,at:bigint,c:bigint>>").alias("more"))
        for run in old[1:]:
            o = self.grams(run).select("f", F.struct(*self.WHO).alias("o"), F.col("hi").alias("o_hi"), F.col("several").alias("o_several"))
            several = F.coalesce("several", F.lit(False)) | F.coalesce("o_several", F.lit(False)) | F.coalesce(F.col("who.c") != F.col("o.c"), F.lit(False))
            rows = rows.join(o.hint("merge"), "f", "full_outer").select("f", F.least("who", "o").alias("who"), F.greatest("hi", "o_hi").alias("hi"), several.alias("several"), F.filter(F.array_append(F.array_append(F.coalesce("more", F.array().cast("array<struct<doc_id:bigint,twin:bigint,at:bigint,c:bigint>>")), F.col("who")), F.col("o")), lambda x: x.isNotNull()).alias("more"))
        # A gram that has several contexts only now brings those of its rows along.
        contexts = rows.where("several").select("f", F.explode("more").alias("o")).select("f", "o.c", "o.doc_id", "o.twin", "o.at")
        for run in old:
            contexts = contexts.union(self.contexts(run).select("f", "c", "doc_id", "twin", "at"))
        contexts = contexts.groupBy("f", "c").agg(F.min(F.struct("doc_id", "twin", "at")).alias("who")).select("f", "c", "who.*")
        run = self._new(rows.select("f", "who.*", "hi", "several"))
        contexts.write.parquet(f"{self.path}/{run}/contexts")
        self.runs = [run]
        for name in old:
            self._drop(name)

    def discard(self) -> None:
        for run in self.runs:
            self._drop(run)
        self.runs = []
        remove(self.spark, self.path)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, twin (64 bits of a hash of the text), text, and row: all other columns, whatever their names."""
    rest = [c for c in docs.columns if c not in ("text", "kept", "n_words", "n_removed")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin"), F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))


def _added(index: FingerprintIndex, docs: DataFrame, window: int) -> DataFrame:
    """What the index finds for docs, which it then holds."""
    path = scratch(docs.sparkSession, "postings")
    postings(docs, window).write.parquet(path)
    known = index.add(docs.sparkSession.read.schema(LOG).parquet(path))
    remove(docs.sparkSession, path)
    return known


def _joined(docs: DataFrame, lists: DataFrame) -> DataFrame:
    lists = lists.select(F.col("doc_id").alias("its_id"), F.col("twin").alias("its_twin"), "found")
    return docs.join(lists.hint("shuffle_hash"), (F.col("doc_id") == F.col("its_id")) & (F.col("twin") == F.col("its_twin")), "left").drop("its_id", "its_twin")


def _cuts(docs: DataFrame, known: DataFrame, window: int) -> DataFrame:
    """doc_id, twin, found: packed (first word, number of words) of the passages to remove of each of the keyed docs."""
    whole = known.where("whole").select("doc_id", "twin", "at")
    edges = known.where("not whole").groupBy("doc_id", "twin").agg(F.collect_set(F.expr("at * 2 + int(later)")).alias("found"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            lists = b.column("found")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not sizes.any():
                continue
            doc, at = np.repeat(np.arange(b.num_rows), sizes), lists.flatten().to_numpy(zero_copy_only=False)
            a, n = at >> 33, (at >> 1 & 0x7FFFFFFF) - window + 1
            more = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            d, s, later = np.repeat(doc, n), np.repeat(a, n) + more, np.repeat(at & 1, n) == 1
            k1, k2 = windows_of(*utf8(b.column("text")), d, s, window)
            # Equal windows of a document that touch are one row: monotonous text has many.
            order = np.lexsort((s, later, k2, k1, d))
            d, s, later, k1, k2 = (x[order] for x in (d, s, later, k1, k2))
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (later[1:] != later[:-1]) | (s[1:] - s[:-1] > window) | (s[1:] // LONGEST != s[:-1] // LONGEST)
            i = np.flatnonzero(new)
            n = s[np.append(i[1:], len(s)) - 1] + window - s[i]
            ids, twins = (b.column(x).to_numpy(zero_copy_only=False)[d[i]].astype(np.int64) for x in ("doc_id", "twin"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[i], k2[i], ids, twins, (s[i] << 32) + n, later[i])], ["k1", "k2", "doc_id", "twin", "at", "later"])

    # Both this join and the last one keep all documents and columns, so that they share one exchange of the texts.
    seen = map_arrow(_joined(docs, edges).select("doc_id", "twin", "text", "found"), verified, "k1 long, k2 int, doc_id long, twin long, at long, later boolean")
    owner = seen.groupBy("k1", "k2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    single = seen.where("later").join(owner, ["k1", "k2"]).where("owner < doc_id").select("doc_id", "twin", "at")
    return whole.union(single).groupBy("doc_id", "twin").agg(F.collect_set("at").alias("found"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_chunks(batches):
        texts, total, gone = [], [], []
        for text, cut in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True):
            parts = (text or "").encode().split()
            left, at = [], 0
            for s, e in sorted((x >> 32, (x >> 32) + (x & 0xFFFFFFFF)) for x in cut or ()):
                if s > at:
                    left += parts[at:s]
                at = max(at, e)
            left += parts[at:]
            total.append(len(parts))
            gone.append(len(parts) - len(left))
            texts.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "kept", "n_words", "n_removed"])


def _result(docs: DataFrame, keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    fields = [keyed.schema["row"], T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    done = map_arrow(_joined(keyed, cuts).select("row", "text", "found"), _without, T.StructType(fields))
    names = [c for c in docs.columns if c not in ("kept", "n_words", "n_removed")]
    return done.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names], "kept", "n_words", "n_removed")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """docs with kept (the remaining words joined by one space), n_words, n_removed.

    Needs doc_id and text; other columns pass through, whatever their names, but for those three, which are replaced.  Every
    window is judged on the input.  A null text has no words; a document of fewer words than a window loses none.  Rows that
    repeat a doc_id aren't earlier than each other, so none loses words to the other.  A null doc_id is neither earlier nor
    later than any.  An empty table gives an empty one.  The table goes through an index of its own in batches of rising doc_id.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    cuts = keyed.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10000)).first()[0] if batches > 1 else []
    index, known = FingerprintIndex(spark), None
    for lo, hi in zip([None, *(cuts or [])], [*(cuts or []), None], strict=True):
        part = keyed if lo is None else keyed.where(F.col("doc_id") > lo)
        part = part if hi is None else part.where(F.col("doc_id") <= hi)
        found = _added(index, part, window)
        known = found if known is None else known.union(found)
    index.discard()
    return _result(docs, keyed, _cuts(keyed, known, window))


def dedup_batch(docs: DataFrame, index: FingerprintIndex, earlier: DataFrame, window: int = WINDOW) -> DataFrame:
    """Like dedup_substrings for a batch that comes after those in the index: its rows lose passages that rows of this batch, or of earlier batches, with
    a smaller doc_id have.  The index then holds the batch too.

    earlier: the rows (doc_id, text) that the index was made of, as they were.  They are read to verify single windows, and no row of theirs is returned.
    """
    keyed = _keyed(docs)
    known = _added(index, keyed, window)
    both = keyed.select("doc_id", "twin", "text").union(_keyed(earlier.select("doc_id", "text")).select("doc_id", "twin", "text"))
    return _result(docs, keyed, _cuts(both, known, window))
