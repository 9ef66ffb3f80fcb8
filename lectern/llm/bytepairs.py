"""Byte-level BPE: ranked merges folded over the bytes of distinct words by higher-order functions, decoding by joined pieces.

A word is one match of the vocabulary's pattern.  While a word is merged, each of its pieces is one character, the piece's id above the
first 65,536, so a string is a word's state, and the order of characters is that of ranks.  Pairs of pieces and known words are looked up in
one-row tables (`tabled`), which plans name as subqueries: their entries stay packed, and no plan's text or driver's heap holds them as objects.

Words are counted over all documents; those that occur most often, KNOWN at most, are encoded once.  All others are encoded where they
stand, so no text is ever moved.  A word of more than SHORT bytes is merged in rounds that join, from left to right, every pair of lowest
rank; that is the same as one pair at a time unless a new piece and a neighbour rank lower still, when one pair is joined.

Null texts count as empty; empty texts have no ids.  Rows, also repeated ones, keep their own row and all their columns but those that the
result names (ids, n_tokens).  An empty table gives an empty result.  Java's Unicode tables tell letters and numbers.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.folders import checkpoint

#: Words that are encoded once and looked up: the most that the table holds, and the most bytes of one.
KNOWN, KNOWN_BYTES = 3 << 18, 64
#: Words of more bytes merge all pairs of a rank in one round, shorter ones a pair in each.
SHORT = 96
#: The character of the id 0, and that of no piece, above all others.
UNIT, NONE = 1 << 16, chr(0x10FFFF)


def _slot(key: Column, slots: int) -> Column:
    return F.crc32(key.cast("binary")).bitwiseAND(F.lit(slots - 1)).cast("int")


def _sought(table: Column, key: Column, slots: int) -> Column:
    return F.try_element_at(F.get(table, _slot(key, slots)), key)


def _slots(entries: int) -> int:
    return 1 << max(4, (entries // 2).bit_length())


def tabled(entries: DataFrame, slots: int) -> DataFrame:
    """entries (k string, v) as one row: an array of small maps, of which a key's checksum names one."""
    held = entries.groupBy(_slot(F.col("k"), slots).alias("s")).agg(F.collect_list(F.struct("k", "v")).alias("e"))
    every = entries.sparkSession.range(slots).select(F.col("id").cast("int").alias("s")).join(held, "s", "left")
    listed = every.agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("t"))
    return checkpoint(listed.select(F.transform("t", lambda x: F.map_from_entries(x["e"])).alias("t")))


class Table:
    """A few entries as a literal, as `tabled` has them; `bound` hands a lookup function to an expression."""

    def __init__(self, entries: dict, kind: str) -> None:
        self.slots = 1 << max(4, len(entries).bit_length())
        rows: list[dict] = [{} for _ in range(self.slots)]
        for k, v in entries.items():
            rows[zlib.crc32(k.encode()) & self.slots - 1][k] = v
        self.literal = F.from_json(F.lit(json.dumps(rows, separators=(",", ":"))), f"array<map<string,{kind}>>")

    def bound(self, body) -> Column:
        """body(f), where f looks a column up and gives null for what the table doesn't have."""
        return _let(self.literal, lambda t: body(lambda key: _sought(t, key, self.slots)))


def _unit(rank: int) -> str:
    return chr(UNIT + rank)


class Ranks:
    """A vocabulary of pieces and ranks, as a file of base64 pieces and decimal ranks has them."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (x.split() for x in f if x.strip())}
        if any(chr(b) not in self.rank for b in range(256)):
            raise ValueError("a byte has no rank")
        if max(self.rank.values()) >= ord(NONE) - UNIT:
            raise ValueError("a rank has no character")
        by = {p: _unit(r) for p, r in self.rank.items()}
        cuts = ((by.get(p[:k]), by.get(p[k:]), u) for p, u in by.items() for k in range(1, len(p)))
        self.pairs = {a + b: u for a, b, u in cuts if a and b}
        self.slots = _slots(len(self.pairs))
        # Pieces that their own bytes' merges don't give: a word that is one of them is that piece all the same.
        self.apart = {p: [r] for p, r in self.rank.items() if len(p) > 1 and self._merged(p) != by[p]}

    def _merged(self, piece: str) -> str:
        t = [_unit(self.rank[x]) for x in piece]
        while len(t) > 1:
            new, k = min((self.pairs.get(t[k] + t[k + 1], NONE), k) for k in range(len(t) - 1))
            if new == NONE:
                break
            t[k : k + 2] = [new]
        return "".join(t)

    def tabled(self, spark: SparkSession) -> DataFrame:
        """The unit that each pair of units gives."""
        return tabled(spark.createDataFrame(pa.table({"k": list(self.pairs), "v": list(self.pairs.values())})), self.slots)

    def units(self, word: Column) -> Column:
        """A word's bytes, each as the unit of its piece."""
        return F.translate(word_bytes(word), "".join(map(chr, range(256))), "".join(_unit(self.rank[chr(b)]) for b in range(256)))

    def ids(self, word: Column, pairs: Column) -> Column:
        """The ids of a word; pairs is the table of the vocabulary's pairs."""
        found = merged(self.units(word), lambda pair: _sought(pairs, pair, self.slots))
        return Table(self.apart, "array<int>").bound(lambda look: F.coalesce(look(word_bytes(word)), found)) if self.apart else found

    def pieces(self) -> Column:
        """The piece of each id, as an array by id."""
        by = {r: p for p, r in self.rank.items()}
        return F.from_json(F.lit(json.dumps([by.get(k) for k in range(max(by) + 1)])), "array<string>")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_tables(docs: DataFrame, name: str, tables: list[DataFrame], body) -> DataFrame:
    """docs with the column `name`, body(t), where t holds each table as t0, t1, ...

    Subqueries may not be written inside higher-order functions, so tables are a column that only `name` reads: the optimizer puts it there.
    """
    own = f"tables_{uuid.uuid4().hex}"
    held = docs.select("*", F.struct(*(t.scalar().alias(f"t{k}") for k, t in enumerate(tables))).alias(own))
    return held.withColumn(name, _let(F.col(own), body)).drop(own)


def word_bytes(word: Column) -> Column:
    """A word's bytes, each as one character."""
    return F.decode(word.cast("binary"), "ISO-8859-1")


def _joined(rank, p: Column, r: Column, lowest: Column) -> Column:
    """The state after the first pair of the lowest rank is joined."""

    def after(k):
        pieces = F.transform(p, lambda x, i: F.when(i == k, lowest).otherwise(x))
        beside = F.transform(r, lambda x, i: F.when(i == k - 1, rank(F.concat(F.get(p, i), lowest))).when(i == k, rank(F.concat(lowest, F.get(p, k + 2)))).otherwise(x))
        return _state(*(F.filter(a, lambda _, i: i != k + 1) for a in (pieces, beside)))

    return _let(F.array_position(r, lowest).cast("int") - 1, after)


def _round(rank, p: Column, r: Column, lowest: Column) -> Column:
    """The state after all pairs of the lowest rank are joined, from left to right, or the first, if a joined pair would rank lower with a neighbour."""
    marks = F.regexp_replace(F.array_join(F.transform(r, lambda x: F.when(x == lowest, "x").otherwise(".")), ""), "xx", "xo")

    def after(m):
        def beside(i):
            return F.when(F.get(m, i) == "x", F.least(rank(F.concat(F.get(p, i - 1), lowest)), rank(F.concat(lowest, F.get(p, i + 2))), rank(F.concat(lowest, lowest))))

        kept = F.transform(p, lambda x, i: F.when((i > 0) & (F.get(m, i - 1) == "x"), None).when(F.get(m, i) == "x", lowest).otherwise(x))
        every = _let(F.filter(kept, lambda x: x.isNotNull()), lambda q: _state(q, _ranked(rank, q)))
        return F.when(F.array_min(F.transform(p, lambda _, i: beside(i))) < lowest, _joined(rank, p, r, lowest)).otherwise(every)

    return _let(F.split(marks, ""), after)


def _state(p: Column, r: Column) -> Column:
    return F.struct(p.alias("p"), r.alias("r")).cast("struct<p:array<string>,r:array<string>>")


def _ranked(rank, p: Column) -> Column:
    """The rank of each piece with the next."""
    return F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: rank(F.concat(a, b)))


def _in_rounds(units: Column, rank) -> Column:
    """The units of a long word after all merges."""

    def step(s, _):
        return _let(F.array_min(s["r"]), lambda m: F.when(m.isNull(), s).when(F.size(s["p"]) > SHORT, _round(rank, s["p"], s["r"], m)).otherwise(_joined(rank, s["p"], s["r"], m)))

    return _let(F.split(units, ""), lambda p: F.aggregate(p, _state(p, _ranked(rank, p)), step, lambda s: F.array_join(s["p"], "")))


def _one_by_one(units: Column, rank) -> Column:
    """The units of a short word after all merges: t has them between two that are no piece's, r the rank of each with the next."""

    def ranked(pair):
        return F.coalesce(_let(pair, rank), F.lit(NONE))

    def step(s, _):
        t, r = s["t"], s["r"]

        def after(m, k):
            beside = F.concat(ranked(F.concat(F.substr(t, k - 1, F.lit(1)), m)), ranked(F.concat(m, F.substr(t, k + 2, F.lit(1)))))
            return F.struct(F.overlay(t, m, k, F.lit(2)).alias("t"), F.overlay(r, beside, k - 1, F.lit(3)).alias("r"))

        return _let(F.array_min(F.split(r, "")), lambda m: F.when(m == F.lit(NONE), s).otherwise(_let(F.instr(r, m), lambda k: after(m, k))))

    def folded(t):
        places = F.sequence(F.lit(1), F.char_length(t) - 1)
        r = F.array_join(F.transform(places, lambda i: ranked(F.substr(t, i, F.lit(2)))), "")
        return F.aggregate(places, F.struct(t.alias("t"), r.alias("r")), step, lambda s: F.substr(s["t"], F.lit(2), F.char_length(s["t"]) - 2))

    return _let(F.concat(F.lit(NONE), units, F.lit(NONE)), folded)


def merged(units: Column, rank) -> Column:
    """The ids of a word of units: ranked merges folded over them; rank looks a pair up, and gives the unit that it makes."""

    def all_merged(u):
        return F.when(F.char_length(u) > SHORT, _in_rounds(u, rank)).otherwise(_one_by_one(u, rank))

    return F.transform(F.split(_let(units, all_merged), ""), lambda x: F.ascii(x) - UNIT)


def split_words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def known_words(docs: DataFrame, ranks: Ranks, pairs: DataFrame, pattern: str, most: int = KNOWN) -> tuple[DataFrame, int]:
    """The ids of the words that occur most often in all documents, at most `most`, as a table, and its slots.

    Counts are grouped by quarters of powers of two to find how often a word must occur: at most 256 numbers.
    """
    counted = docs.select(F.explode(split_words(F.col("text"), pattern)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    counted = counted.where(F.octet_length("k") <= KNOWN_BYTES).withColumn("p", F.floor(F.log2("n") * 4).cast("int")).persist()
    try:
        held, least = 0, 1 << 30
        for p, n in sorted(((r.p, r["count"]) for r in counted.groupBy("p").count().collect()), reverse=True):
            if held + n > most:
                break
            held, least = held + n, p
        common = counted.where(F.col("p") >= least).select("k")
        return tabled(with_tables(common, "v", [pairs], lambda t: ranks.ids(F.col("k"), t["t0"])), _slots(held)), _slots(held)
    finally:
        counted.unpersist()


def encode(docs: DataFrame, path: str, pattern: str, most: int = KNOWN) -> DataFrame:
    """docs with ids (an array) and n_tokens of each text."""
    ranks = Ranks(path)
    pairs = ranks.tabled(docs.sparkSession)
    known, slots = known_words(docs, ranks, pairs, pattern, most)

    def every(t):
        return F.flatten(F.transform(split_words(F.col("text"), pattern), lambda w: F.coalesce(_sought(t["t1"], w, slots), ranks.ids(w, t["t0"]))))

    return with_tables(docs, "ids", [pairs, known], every).withColumn("n_tokens", F.size("ids").cast("long"))


def decode(ids: Column, ranks: Ranks) -> Column:
    """The bytes that ids stand for: their pieces, joined.  Null ids give null; an id without a piece adds nothing."""
    return F.encode(_let(ranks.pieces(), lambda pieces: F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "ISO-8859-1")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids (decimal, joined by one space) and of the bytes that they decode to."""
    found = encode(docs.select("doc_id", "text"), path, pattern)
    told = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return found.select("doc_id", "n_tokens", told.alias("ids_sha256"), F.sha2(decode(F.col("ids"), Ranks(path)), 256).alias("decoded_sha256"))
