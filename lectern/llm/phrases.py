"""Phrase collocations: 1..max_n-grams as rows, counted per language, scored in Decimal, pruned by one-word extensions, ranked.

Phrases of one and two words are all counted; longer ones where their ends are frequent enough (`counted`).

A phrase's longest extension that counts can be grown one word at a time, and each step occurs at least as often as the next; so a phrase is
inside a longer candidate that is frequent enough exactly if it is inside such a candidate of one word more, and one anti-join decides.

Null texts count as empty, null languages as `und`; texts without words give nothing, repeated rows count as often as they are there, and
other columns aren't read.  An empty table gives an empty result.  Ties are decided by count, then by the phrase's bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, UPPER, ascii_lower, written

PIECES, GAPS = "[.,;:!?\\x0A-\\x0D]", "[\\x20\\x09]+"
MAX_N, LEAST, SCALE, SHARE, BEST = 3, 10, 1_000_000, 50, 2000
#: Slots that frequent phrases mark, a power of two.
SLOTS = 1 << 25
LANG = "und"


def places(docs: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """lang, w1, w2, ... to max_n: a row for each word with those that follow it in its piece; a piece's first row has its number of words, too.

    Pieces without words go after the last generator: a filter on their arrays would be moved below the split and compute it again.
    """
    pieces = F.explode_outer(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), PIECES, -1))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(LANG)).alias("lang"), pieces.alias("piece"))
    rows = rows.select("lang", F.array_remove(F.split("piece", GAPS, -1), "").alias("w"))
    shifted = [F.slice("w", n, F.size("w")).alias(f"w{n}") for n in range(1, max_n + 1)]
    return rows.select("lang", F.inline_outer(F.arrays_zip(*shifted, F.array(F.size("w")).alias("words")))).where("w1 is not null")


def phrase(first: int, last: int) -> Column:
    """The words of a place from one to another, null beyond the piece."""
    return F.concat(*[x for n in range(first, last + 1) for x in (F.lit(" "), F.col(f"w{n}"))][1:])


def frequent(rows: DataFrame, least: int) -> DataFrame:
    """lang, gram, f of rows (lang, gram, weight), of which `least` are left, and the empty gram."""
    return rows.where("gram is not null").groupBy("lang", "gram").agg(F.sum("weight").alias("f")).where((F.col("f") >= least) | (F.col("gram") == ""))


def slot(lang: Column | str, gram: Column | str) -> Column:
    return F.xxhash64(lang, gram).bitwiseAND(F.lit(SLOTS - 1))


def marked(counts: DataFrame, n: int) -> DataFrame:
    """at, bits: a bit for each slot that a phrase of n words has, 64 to a row; SLOTS / 64 rows at most, however many phrases there are."""
    slots = counts.where((F.col("gram") != "") & (n_of(F.col("gram")) == n)).select(slot("lang", "gram").alias("slot"))
    return slots.groupBy(F.expr("slot >>> 6").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))


def hopeful(rows: DataFrame, n: int, marks: DataFrame) -> DataFrame:
    """The places whose first n words are a phrase of which both ends, of n - 1 words, have a marked slot."""
    rows = rows.where(f"w{n} is not null")
    for first in (1, 2):
        rows = rows.withColumn("slot", slot("lang", phrase(first, first + n - 2))).withColumn("at", F.expr("slot >>> 6"))
        rows = rows.join(F.broadcast(marks), "at").where("(shiftrightunsigned(bits, cast(slot & 63 as int)) & 1) = 1").drop("at", "slot", "bits")
    return rows


def n_of(phrase: Column) -> Column:
    return F.size(F.split(phrase, " "))


def counted(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """lang, gram, f of all phrases that occur `least` times in a language, and its number of words under an empty gram.

    Words and pairs are all counted.  A longer phrase occurs at most as often as its two ends of one word less, so it is counted only where both
    have a slot of a phrase that is frequent enough.  Phrases that share slots by chance are counted in vain, none is lost.
    """
    short = F.array(F.when(F.col("words").isNotNull(), ""), *[phrase(1, n) for n in range(1, min(max_n, 2) + 1)])
    rows = places(docs, min(max_n, 2)).select("lang", "words", F.explode(short).alias("gram"))
    found = written(frequent(rows.select("lang", "gram", F.when(F.col("gram") == "", F.col("words")).otherwise(1).cast("long").alias("weight")), least), "phrases")
    for n in range(3, max_n + 1):
        rows = hopeful(places(docs, n), n, marked(found, n - 1)).select("lang", phrase(1, n).alias("gram"), F.lit(1).cast("long").alias("weight"))
        found = found.union(written(frequent(rows, least), "phrases"))
    return found


def part(phrase: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases.

    A phrase's lowest-scoring cut counts, of equal ones the first.  A part occurs at least as often as its phrase, so its count is among those
    that are kept.  Counts are Decimals of 15 digits: a million times a squared stays below 38.
    """
    counts = counted(docs, max_n, least)
    longer = counts.where("gram <> ''").select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), n_of(F.col("gram")).alias("words")).where("words > 1")
    heads, tails = (counts.select("lang", F.col("gram").alias(side), F.col("f").alias(name)) for side, name in (("head", "l"), ("tail", "r")))
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"head": part(F.col("phrase"), F.lit(1), F.col("k")), "tail": part(F.col("phrase"), F.col("k") + 1, F.col("words"))})
    a, l, r = (F.col(x).cast("decimal(15,0)") for x in "alr")
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumns({"above": a * a * F.lit(SCALE).cast("decimal(7,0)"), "below": l * r})
    lowest = scored.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ends = F.array(part(F.col("phrase"), F.lit(1), F.col("words") - 1), part(F.col("phrase"), F.lit(2), F.col("words")))
    grown = longer.where("words > 2").select(F.col("lang").alias("its_lang"), F.col("a").alias("of_longer"), F.explode(ends).alias("inside"))
    grown = grown.groupBy("its_lang", "inside").agg(F.max("of_longer").alias("of_longer"))
    kept = lowest.join(grown, (F.col("lang") == F.col("its_lang")) & (F.col("phrase") == F.col("inside")) & (F.col("of_longer") * 100 >= F.col("a") * share), "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return top.join(counts.where("gram = ''").select("lang", F.col("f").alias("n")), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """The same as SQL, with two and three words spelled out."""
    return f"""
    with pieces as (
        select coalesce(lang, '{LANG}') as lang,
            unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PIECES}')) as piece
        from documents),
    words as (select lang, [x for x in regexp_split_to_array(piece, '{GAPS}') if x <> ''] as w from pieces),
    phrases as (
        select lang, 1 as size, unnest(w) as phrase from words
        union all select lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) from words
        union all select lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) from words),
    f as (select lang, size, phrase, count(*) as f from phrases group by all),
    n as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
    candidates as (select *, string_split(phrase, ' ') as w from f where size > 1 and f >= {LEAST}),
    cuts as (
        select c.lang, c.phrase, c.f as a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail
        from candidates c, range(1, 3) as ks(k) where k < size),
    scored as (
        select c.lang, c.phrase, a, k, l.f as l, r.f as r, (({SCALE}::hugeint * a * a) // (l.f::hugeint * r.f))::bigint as score
        from cuts c join f l on l.lang = c.lang and l.phrase = c.head join f r on r.lang = c.lang and r.phrase = c.tail),
    lowest as (select *, row_number() over (partition by lang, phrase order by score, k) as place from scored),
    grown as (
        select lang, phrase, max(f) as f from (
            select lang, array_to_string(w[1:2], ' ') as phrase, f from candidates where size = 3
            union all select lang, array_to_string(w[2:3], ' '), f from candidates where size = 3) group by all),
    kept as (
        select l.* from lowest l left join grown g on g.lang = l.lang and g.phrase = l.phrase and 100 * g.f >= {SHARE} * l.a
        where place = 1 and g.lang is null),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
    select ranked.lang, rank, phrase, a, l, r, n, score from ranked join n on n.lang = ranked.lang where rank <= {BEST}"""
