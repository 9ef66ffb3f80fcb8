"""SpotSigs fingerprints of documents and their near-duplicates.

A text is lower-cased and cut into runs of letters and digits.  `ANCHORS` are common words of the languages at hand.  Each
content word that follows an anchor starts a chain of `CHAIN` content words; the anchor and its chain form a
signature.  A text without anchors has the chains of all its content words, one of fewer content words than a chain the
chain of those it has.  The fingerprint is the sorted set of the signatures' hashes, eight hex digits each.

Likeness is the Jaccard coefficient of the sets.  Near-duplicates are joined by partitions of the set's length:
with at least t * n shared signatures, sets of n and m are near only if t <= m / n <= 1 / t, so a set meets its own partition
and the next.  Within them sets meet by the prefix of their rarest signatures.  All of it is DataFrame functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import checkpoint, components, partitions

#: Common words of English, French, German and Spanish.
ANCHORS = """a an and are as at be by for from has he in is it its of on or that the this to was were which will with
le la les un une des du de et est en que qui dans pour pas sur au aux par plus ce se
der die das den dem ein eine und ist nicht mit von zu auf für im sich auch es an
el los las una y que en del se por con no para al lo como""".split()
CHAIN, THRESHOLD, DIGITS, HEX = 2, 0.8, 6, 8


def _bound(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def signatures(text: Column) -> Column:
    """The sorted array of a text's distinct signature hashes; null counts as empty."""
    anchor = "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w)))
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " "))
    # Anchors stick to the content word that they precede: "of the house is" becomes "of~the~house is~".
    marked = F.regexp_replace(F.concat(plain, F.lit(" ")), f"(?<![^ ~])({anchor}) ", "$1~")
    spots = F.filter(F.split(marked, " "), lambda w: (w != "") & ~F.endswith(w, F.lit("~")))

    def chain(w: Column, following: Column) -> Column:
        return F.substring(F.md5(F.concat(F.substring_index(w, "~", -2), F.lit(" "), F.substring_index(following, "~", -1))), 1, HEX)

    def hashed(g: Column) -> Column:
        after = F.slice(g, F.lit(2), F.greatest(F.size(g), F.lit(1)))
        spotted = F.filter(F.zip_with(g, after, lambda w, x: F.when(F.contains(w, F.lit("~")), chain(w, x))), lambda h: h.isNotNull())
        every = F.when(F.size(g) > 1, F.filter(F.zip_with(g, after, chain), lambda h: h.isNotNull())).otherwise(F.transform(g, lambda w: F.substring(F.md5(w), 1, HEX)))
        return _bound(spotted, lambda h: F.array_sort(F.array_distinct(F.when(F.size(h) > 0, h).otherwise(every))))

    return _bound(spots, hashed)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two arrays of distinct values; two empty ones are alike."""
    return _bound(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(F.round(both / (F.size(a) + F.size(b) - both), DIGITS)))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below key, by binary search.  The bounds are one literal, however many they are."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    known = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(known, at + s - 1) < key), at + s).otherwise(at))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text) with bucket, key and guest, such that in descending order of key a bucket ends with a guest row: the first
    row of the next bucket, and in the last one that of the first.  Rows of equal doc_id are in order of their text's hash."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"))
    n = buckets or 4 * partitions(docs.sparkSession)
    bounds = rows.agg(F.percentile_approx("key", [(k + 1) / n for k in range(n - 1)], 10 * n)).first()[0] if n > 1 else []
    rows = rows.withColumn("bucket", _bucket(F.col("key"), sorted(set(bounds or []))))
    # A row for each bucket: at most n.
    tops = sorted((r[0], r[1]) for r in rows.groupBy("bucket").agg(F.max("key")).collect())
    if not tops:
        return rows.withColumn("guest", F.lit(False))
    guests = F.broadcast(docs.sparkSession.createDataFrame([(key, tops[(k + 1) % len(tops)][0]) for k, (_, key) in enumerate(tops)], "key long, host int"))
    visiting = rows.join(guests, "key").select("doc_id", "text", "key", F.col("host").alias("bucket"))
    return rows.withColumn("guest", F.lit(False)).union(visiting.withColumn("guest", F.lit(True)))


def compared(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs (doc_id, text).

    The edited text has its last half (floor of n_chars / 2 code points) replaced by as many, or all, of the first code points
    of the next text in descending order of doc_id (after the last: the first).  A null text is empty; a null doc_id is
    last; rows that repeat are documents of their own.  The texts move once, to buckets of neighbouring doc_ids.
    """
    rows = with_next(docs, buckets).withColumn("text", F.coalesce("text", F.lit("")))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("key").desc(), F.xxhash64("text"))
    rows = rows.withColumn("following", F.lead("text").over(order))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("spots", signatures(F.col("text")))
    edited = F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 2))"), F.expr("substring(following, 1, int(n_chars div 2))"))
    rows = rows.select("doc_id", "key", "bucket", "guest", "text", "n_chars", "spots", F.lead("spots").over(order).alias("next_spots"), edited.alias("edited")).where("not guest")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "spots", "next_spots", signatures(F.col("edited")).alias("edited_spots"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("spots", "").alias("fingerprint"),
        F.array_join("edited_spots", "").alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def oracle() -> str:
    """The same for DuckDB."""
    anchor = "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w)))
    last, first = "regexp_extract({}, '[^~]*$')", "regexp_extract({}, '([^~]*~)?[^~]*$')"

    def spots(source: str, name: str) -> str:
        # Without lookbehind, anchors are found word by word.
        words = f"list_filter(string_split(regexp_replace(lower({source}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
        marked = f"array_to_string(list_transform({words}, lambda w: case when regexp_full_match(w, '{anchor}') then w || '~' else w || ' ' end), '')"
        return f"list_filter(string_split({marked}, ' '), lambda w: w <> '' and not ends_with(w, '~')) as {name}"

    def hashed(g: str, name: str) -> str:
        chain = f"substr(md5({first.format(f'{g}[i]')} || ' ' || {last.format(f'{g}[i + 1]')}), 1, {HEX})"
        some = f"list_transform(list_filter(range(1, len({g})), lambda i: contains({g}[i], '~')), lambda i: {chain})"
        every = f"case when len({g}) > 1 then list_transform(range(1, len({g})), lambda i: {chain}) else list_transform({g}, lambda w: substr(md5(w), 1, {HEX})) end"
        return f"list_sort(list_distinct(case when len({some}) > 0 then {some} else {every} end)) as {name}"

    def near(a: str, b: str) -> str:
        both = f"len(list_intersect({a}, {b}))"
        return f"case when len({a}) + len({b}) = 0 then 1.0 else round({both}::double / (len({a}) + len({b}) - {both}), {DIGITS}) end"

    return f"""with t as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
    o as (select *, coalesce(lead(text) over (order by doc_id desc), first_value(text) over (order by doc_id desc)) as nxt,
        coalesce(lead(doc_id) over (order by doc_id desc), first_value(doc_id) over (order by doc_id desc)) as next_id from t),
    e as (select *, substr(text, 1, n - n // 2) || substr(nxt, 1, n // 2) as edited from o),
    s as (select *, {spots("text", "g")}, {spots("edited", "h")} from e),
    f as (select *, {hashed("g", "a")}, {hashed("h", "b")} from s)
    select f.doc_id, f.n as n_chars, sha256(f.edited) as edited_sha256, array_to_string(f.a, '') as fingerprint, array_to_string(f.b, '') as edited_fingerprint,
        {near("f.a", "f.b")} as near_edited, {near("f.a", "x.a")} as near_next from f join f x on f.next_id = x.doc_id"""


def _numbers(spots: Column) -> Column:
    """Signatures as numbers of four bytes, in the same order."""
    return F.transform(spots, lambda h: (F.conv(h, 16, 10).cast("long") - (1 << 31)).cast("int"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id of every row of docs (doc_id, text): class_id is the smallest doc_id reachable over likenesses of threshold or more.

    Equal fingerprints are one node.  A node's rarest signatures, as many as a match must meet (n - ceil(t n) + 1), are
    posted under its length partition and looked up under its own and the next; candidates are verified by their
    sets.  Texts without words are alike.  Null doc_ids are nobody's class unless all of a class are null.
    """
    # Likeness is rounded; pruning allows for that.
    low = threshold - 10.0**-DIGITS
    rows = checkpoint(docs.select("doc_id", signatures(F.col("text")).alias("spots")).withColumn("name", F.sha2(F.array_join("spots", ""), 256)).withColumn("spots", _numbers(F.col("spots"))))
    nodes = checkpoint(rows.groupBy("name").agg(F.min("doc_id").alias("first"), F.first("spots").alias("spots")).withColumn("node", F.monotonically_increasing_id()))
    sets = nodes.where(F.size("spots") > 0).select("node", "spots", F.size("spots").alias("n"))
    posts = sets.select("node", "n", F.explode("spots").alias("sig"))
    often = posts.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    here = Window.partitionBy("node")
    need = F.col("n") - F.ceil(F.col("n") * low - 1e-9) + 1
    # Signatures of one set alone are its rarest: they count in the rank, and need no rows.
    alone = F.col("n") - F.count("*").over(here)
    posts = posts.join(often, "sig").withColumn("k", F.row_number().over(here.orderBy("df", "sig")) + alone).where(F.col("k") <= need)
    posts = posts.select("node", "n", "k", "sig", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / low)) + 1e-9).alias("part"))
    lookups = posts.select(F.col("node").alias("other"), F.col("n").alias("m"), F.col("k").alias("l"), "sig", F.col("part").alias("own"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    once = (F.col("own") < F.col("part")) | (F.col("node") < F.col("other"))
    sizes = (F.col("n") >= F.col("m") * low - 1e-9) & (F.col("m") >= F.col("n") * low - 1e-9)
    # A near pair's first signature in common leaves it enough others: so many have places behind it in both sets.
    left_over = 1 + F.least(F.col("n") - F.col("k"), F.col("m") - F.col("l")) >= (F.col("n") + F.col("m")) * (low / (1 + low)) - 1e-9
    pairs = posts.join(lookups, ["sig", "part"]).where(once & sizes & left_over)
    pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    left, right = sets.select(F.col("node").alias("a"), F.col("spots").alias("x")), sets.select(F.col("node").alias("b"), F.col("spots").alias("y"))
    links = pairs.join(left, "a").join(right, "b").where(likeness(F.col("x"), F.col("y")) >= threshold).select("a", "b")
    parts = components(links, forests=True).withColumnRenamed("component", "class")
    named = nodes.join(parts, "node", "left").select("name", "first", F.coalesce("class", "node").alias("class"))
    least = named.groupBy("class").agg(F.min("first").alias("class_id"))
    return rows.select("doc_id", "name").join(named.select("name", "class").join(least, "class"), "name").select("doc_id", "class_id")
