"""Mixes sources to target weights in fixed-length blocks.

The words of each source, document after document, are one stream cut into blocks of `BLOCK` words (the last one may
be shorter).  Targets are shares of the mix by weight, level at `MOST` times what a source has.  An epoch of a
source takes every block once; the last epoch takes blocks in the order of a pseudorandom permutation of
the block indices until the target is met to the word.  How many blocks of each source an output shard has is a seeded
multinomial draw, given the sources' totals, which keeps each source at its target; a shard's slots follow from the draws
before it.  Slots meet blocks by (source, index).  Everything is DataFrame functions; streams and draws are numbered with two-level
prefix sums, so that no source has to fit into one task.  Only the table of sources, a row each, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import checkpoint, n_words, partitions, words, written

BLOCK, SHARE, MOST, WEIGHTS = 256, 1.5, 2, (3, 1, 2)
#: Rounds of the permutation of block indices.
ROUNDS = 24
#: Streams are numbered in this many hashed parts; output shards have about this many blocks.
PARTS, SHARD_BLOCKS, SEED = 1024, 4096, 42


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of each source of sizes (source, size): one row for each source.

    Sources take the weights in turn by code point, null last.  All share `share` of the total; a
    source's target stops at `most` times its size, and the excess is shared again by weight until none
    is above: target = min(level * weight, most * size) with the level at which they add up.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    # In order of cap / weight, sources below the level are capped; the first prefix that leaves the rest room sets it.
    rank = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by = by.withColumns({
        "capped": F.coalesce(F.sum("cap").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "total": share * F.sum("source_size").over(every).cast("double"),
    })
    level = (F.col("total") - F.col("capped")) / F.col("open")
    by = by.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).over(every))
    return by.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _permuted(index: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """Where a pseudorandom permutation of 0..n-1 sends index: a swap-or-not shuffle of `ROUNDS` rounds, a bijection for every n.

    Each round may swap i with its mirror image (turn - i) modulo n; whether it does hangs on the pair alone.
    """

    def swap(i: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), n) - i, n)
        return F.when(F.xxhash64(key, r, F.greatest(i, mirror)).bitwiseAND(1) == 1, mirror).otherwise(i)

    rounds = F.array(*[F.lit(r) for r in (range(ROUNDS, 0, -1) if inverse else range(1, ROUNDS + 1))])
    return F.aggregate(rounds, index, swap)


def plan(sizes: DataFrame, block: int = BLOCK, **rule) -> DataFrame:
    """A row for each source: sid, source, source_size, target, blocks, short (words of the last block), epochs (whole ones), rest
    (words to take in the last epoch), rest_slots, short_at (slot of the last block in that epoch)."""
    t = targets(sizes, **rule).where("source_size > 0")
    t = t.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    t = t.withColumn("words", F.floor(F.col("target") + 1e-6))
    t = t.withColumns({"blocks": F.expr(f"(source_size + {block - 1}) div {block}"), "epochs": F.expr("words div source_size"), "rest": F.expr("words % source_size")})
    t = t.withColumn("short", F.expr(f"source_size - (blocks - 1) * {block}"))
    t = t.withColumn("short_at", _permuted(F.col("blocks") - 1, F.col("blocks"), F.xxhash64(F.lit(SEED), "sid"), inverse=True))
    slots = F.expr(f"(rest + {block - 1}) div {block}")
    return t.withColumn("rest_slots", F.when(slots <= F.col("short_at"), slots).otherwise(F.expr(f"(rest + {block} - short + {block - 1}) div {block}")))


def _before(rows: DataFrame, key: str, part: Column, order: list[str], value: str, name: str) -> DataFrame:
    """rows with name: the sum of value over the rows of the same key that come before, first by part, then by order."""
    rows = rows.withColumn("part", part)
    sums = rows.groupBy(key, "part").agg(F.sum(value).alias("held"))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(sums, [key, "part"]).withColumn(name, F.col(name) + F.col("base")).drop("part", "base")


def draws(planned: DataFrame) -> DataFrame:
    """planned's columns, shard, n, begin: how many slots of a source each output shard has, and how many those before it have.

    Every slot of a source draws its shard, so that counts are multinomial given the source's slots.  Slots are dealt out in ranges before they are
    written out, so that a large source is many tasks' work, and counted before anything is shuffled.
    """
    each = planned.withColumn("slots_in_all", F.expr("epochs * blocks + rest_slots")).where("slots_in_all > 0")
    each = each.withColumn("shards", F.ceil(F.sum("slots_in_all").over(Window.partitionBy()) / SHARD_BLOCKS))
    ranges = each.select("sid", "slots_in_all", "shards", F.explode(F.expr(f"sequence(0L, (slots_in_all - 1) div {SHARD_BLOCKS})")).alias("range")).repartition(partitions(planned.sparkSession))
    every = ranges.select("sid", "shards", F.explode(F.expr(f"sequence(range * {SHARD_BLOCKS}, least((range + 1) * {SHARD_BLOCKS}, slots_in_all) - 1)")).alias("draw"))
    counts = every.groupBy("sid", F.pmod(F.xxhash64(F.lit(SEED), "sid", "draw"), F.col("shards")).alias("shard")).agg(F.count("*").alias("n"))
    return _before(counts, "sid", F.expr(f"shard div {PARTS}"), ["shard"], "n", "begin").join(planned, "sid")


def slots(planned: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix, a row for each slot: sid, epoch, slot, index (of the block), words (taken from its start), turn (slot over all epochs), shard."""
    # AQE would put the few rows of the draws into one task, which then wrote all slots out.
    every = draws(planned).repartition(partitions(planned.sparkSession)).withColumn("turn", F.explode(F.expr("sequence(begin, begin + n - 1)")))
    every = every.withColumns({"epoch": F.expr("turn div blocks"), "slot": F.expr("turn % blocks")})
    every = every.withColumn("index", _permuted(F.col("slot"), F.col("blocks"), F.xxhash64(F.lit(SEED), "sid")))
    length = F.expr(f"if(index = blocks - 1, short, {block})")
    left = F.expr(f"rest - (slot * {block} - if(slot > short_at, {block} - short, 0))")
    taken = F.when(F.col("epoch") < F.col("epochs"), length).otherwise(F.greatest(F.lit(0), F.least(left, length)))
    return every.select("sid", "epoch", "slot", "index", taken.cast("long").alias("words"), "turn", "shard")


def numbered(docs: DataFrame) -> DataFrame:
    """docs (doc_id, sid, size, rid, more) with begin: the words of the same source before the document."""
    return _before(docs, "sid", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(PARTS)), ["doc_id", "size", "rid"], "size", "begin")


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, source, text, size, rid, and row: all columns but text, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    return docs.select("doc_id", "source", F.col("text").alias("text"), n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("rid"), row)


def _own(docs: DataFrame) -> list[Column]:
    """docs' columns out of row and text; n_chars, if there, follows the text."""
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return [F.col("text") if c == "text" else F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns]


def _taken(marked: DataFrame, planned: DataFrame, block: int) -> DataFrame:
    """rid, epoch, low, high: the words low..high-1 of a row that a slot takes; sid, turn and shard of the slot, and at, where in it they begin."""
    names = planned.select("sid", F.col("source").alias("name__"))
    rows = marked.where("size > 0").join(names, F.col("source").eqNullSafe(F.col("name__"))).select("rid", "doc_id", "sid", "size")
    spans = numbered(rows).withColumn("index", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")))
    met = spans.join(slots(planned, block).hint("merge"), ["sid", "index"])
    low = F.expr(f"greatest(index * {block}, begin) - begin")
    high = F.expr(f"least(index * {block} + words, begin + size) - begin")
    at = F.expr(f"greatest(begin - index * {block}, 0)")
    return met.select("rid", "epoch", low.alias("low"), high.alias("high"), "sid", "turn", "shard", at.alias("at")).where("low < high")


def mix(docs: DataFrame, block: int = BLOCK, **rule) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id, text, source).

    size is the number of words (null text: 0), source_size and target are its source's, taken the words that the mix
    takes from the row, repeats counted.  A null source is a source of its own, after the others.
    Repeated rows count as documents of their own; a table without words has targets and takes of 0.
    """
    marked = checkpoint(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("rid")))
    goals = targets(marked, **rule).withColumnRenamed("source", "name__")
    planned = checkpoint(plan(marked, block, **rule))
    taken = _taken(marked, planned, block).groupBy("rid").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    rows = marked.join(goals, F.col("source").eqNullSafe(F.col("name__"))).join(taken, "rid", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, **rule) -> DataFrame:
    """The mix as rows of docs' columns: for each epoch the part of a document that it takes.

    A document that an epoch takes whole keeps its text; else its text is the taken words, joined by one space.  n_chars,
    if there, follows the text.  Documents that no slot takes are left out, those without words too.  All other columns pass through,
    whatever their names; rows that repeat are documents of their own, and an empty table gives an empty one.
    """
    marked = written(_marked(docs), "mix")
    sizes = marked.select("doc_id", "source", "size", "rid")
    planned = checkpoint(plan(sizes, block, **rule))
    taken = _taken(sizes, planned, block).groupBy("rid", "epoch").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"), F.sum(F.col("high") - F.col("low")).alias("n"))
    copies = taken.groupBy("rid").agg(F.collect_list(F.struct("epoch", "spans", "n")).alias("copies"))
    rows = marked.join(copies.hint("shuffle_hash"), "rid").withColumn("copy", F.explode("copies"))
    part = F.array_join(F.flatten(F.transform(F.col("copy.spans"), lambda s: F.slice(words(F.col("text")), (s["low"] + 1).cast("int"), (s["high"] - s["low"]).cast("int")))), " ")
    rows = rows.withColumn("text", F.when(F.col("copy.n") == F.col("size"), F.col("text")).otherwise(part))
    return rows.select(*_own(docs))


def mixed_shards(docs: DataFrame, block: int = BLOCK, **rule) -> DataFrame:
    """The mix in its shards: shard, place (1, 2, 3, ... in the shard), then docs' other columns; a row for what a slot takes of a document.

    A shard's slots are in a seeded order, whatever their source; the pieces of a slot follow each other as in its block.  A piece
    that is a whole document keeps its text, else the words are joined by one space.  n_chars, if there, follows the text.
    """
    marked = written(_marked(docs), "mix")
    sizes = marked.select("doc_id", "source", "size", "rid")
    planned = checkpoint(plan(sizes, block, **rule))
    # Places are dealt to the pieces before they meet their texts, which so move once.
    turns = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED), F.lit("place"), "sid", "turn"), "sid", "turn", "at", "rid")
    placed = _taken(sizes, planned, block).withColumn("place", F.row_number().over(turns))
    pieces = placed.groupBy("rid").agg(F.collect_list(F.struct("shard", "place", "low", "high")).alias("pieces"))
    rows = marked.join(pieces.hint("shuffle_hash"), "rid")

    def cut(w: Column) -> Column:
        def piece(p: Column) -> Column:
            said = F.array_join(F.slice(w, (p["low"] + 1).cast("int"), (p["high"] - p["low"]).cast("int")), " ")
            return F.struct(*[p[n].alias(n) for n in ("shard", "place")], F.when(p["high"] - p["low"] == F.col("size"), F.col("text")).otherwise(said).alias("text"))

        return F.transform("pieces", piece)

    rows = rows.select("row", F.explode(F.flatten(F.transform(F.array(words(F.col("text"))), cut))).alias("piece"))
    rows = rows.select("row", "piece.text", F.col("piece.shard").alias("its_shard"), F.col("piece.place").alias("its_place"))
    return rows.select(F.col("its_shard").alias("shard"), F.col("its_place").alias("place"), *[c for c, n in zip(_own(docs), docs.columns, strict=True) if n not in ("shard", "place")])
