"""Licence scans: units of a text against licence templates by the Dice coefficient over their sets of word bigrams.

A document's units are its whole text, its paragraphs (between blank lines), its lines, and its windows of up to 1.5 times a template's bigrams (at a threshold of 0.8), which
find licences of several paragraphs within a text and notices within a line, with words put in.  Words are runs of a-z and 0-9
once A-Z is lower-cased.  Dice >= t needs set sizes within a factor of t / (2 - t), which prunes templates by size.  It also needs
that share of a template's bigrams, so a text in which none of the `anchors` occurs, words that enough of every
template's bigrams hold, has no match and isn't cut up at all.  Everything is a function of the row: no shuffle.
"""

from __future__ import annotations

import math
import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, UPPER, ascii_lower
from lectern.llm.license_texts import TEMPLATES

THRESHOLD, DIGITS = 0.8, 6
#: Not taken as anchors while other words do: nearly every text has them.
COMMON = frozenset("a and any as by for from in is it may of or that the this to under with you your".split())
#: Places that a window may span for each distinct bigram that it may have.
REPEATS = 2
TOKEN, PARAGRAPH = "[a-z0-9]+", "\n[ \t\r]*\n"


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a text, in order of appearance."""
    w = re.findall(TOKEN, text.translate(str.maketrans(UPPER, LOWER)))
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


@cache
def anchors(templates: tuple[tuple[str, str], ...], threshold: float) -> tuple[str, ...]:
    """Words of which every text that matches a template has one at least.

    A match shares at least need = threshold / (2 - threshold) of the template's bigrams, so words that are in all but fewer
    than need of them will do.  They are added from the longest to the shortest, `COMMON` ones last.
    """
    chosen: set[str] = set()
    for _, text in templates:
        left = [g.split() for g in bigrams(text)]
        need = math.ceil(len(left) * threshold / (2 - threshold) - 1e-9)
        left = [g for g in left if not chosen.intersection(g)]
        for word in sorted({w for g in left for w in g}, key=lambda w: (w in COMMON, -len(w), w)):
            if len(left) < need:
                break
            if any(word in g for g in left):
                chosen.add(word)
                left = [g for g in left if word not in g]
    return tuple(sorted(chosen))


def _hits(text: Column, templates: tuple[tuple[str, str], ...], threshold: float) -> Column:
    """struct(neg, license, scope) of every unit and template that match: neg is minus the Dice coefficient."""
    known = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, bigrams(t))).alias("g")) for name, t in templates])
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    units = F.concat(
        F.array(F.struct(F.lit("text").alias("scope"), text.alias("t"))),
        F.transform(F.split(text, PARAGRAPH), lambda t: F.struct(F.lit("paragraph").alias("scope"), t.alias("t"))),
        F.transform(F.split(text, "\n"), lambda t: F.struct(F.lit("line").alias("scope"), t.alias("t"))),
    )
    cut = F.transform(units, lambda u: F.struct(u["scope"].alias("scope"), F.regexp_extract_all(ascii_lower(u["t"]), F.lit(TOKEN), F.lit(0)).alias("w")))
    paired = F.transform(
        F.filter(cut, lambda u: F.size(u["w"]) > 1),
        lambda u: F.struct(u["scope"].alias("scope"), F.array_distinct(F.zip_with(F.slice(u["w"], F.lit(1), F.size(u["w"]) - 1), F.slice(u["w"], F.lit(2), F.size(u["w"]) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).alias("g")),
    )

    def scored(u: Column) -> Column:
        near = F.filter(known, lambda t: F.size(u["g"]).between(F.size(t["g"]) * (low - 1e-9), F.size(t["g"]) * (high + 1e-9)))
        return F.transform(near, lambda t: F.struct((-F.round(2.0 * F.size(F.array_intersect(u["g"], t["g"])) / (F.size(u["g"]) + F.size(t["g"])), DIGITS)).alias("neg"), t["license"].alias("license"), u["scope"].alias("scope")))

    return F.filter(F.flatten(F.transform(paired, scored)), lambda s: s["neg"] <= -threshold)


def _some(text: Column, templates: tuple[tuple[str, str], ...], threshold: float) -> Column:
    return text.rlike("(?<![A-Za-z0-9])(?i:" + "|".join(anchors(templates, threshold)) + ")(?![A-Za-z0-9])")


def best_match(text: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """struct(neg, license, scope) of the best unit and template; null without a match."""
    return F.when(_some(text, templates, threshold), F.array_min(F.concat(_hits(text, templates, threshold), _window_hits(text, templates, threshold))))


def _let(value: Column, body) -> Column:
    """body of value, which is worked out once; body gives an array."""
    return F.flatten(F.transform(F.array(value), body))


def _window_hits(text: Column, templates: tuple[tuple[str, str], ...], threshold: float) -> Column:
    """struct(neg, license, scope) of every window of a text that may be the best for a template and matches it.

    A window that matches has at most (2 - threshold) / threshold times the template's distinct bigrams; it spans up to REPEATS times as many
    places, for bigrams that occur in it again.  The best starts and ends with a
    run of the template's bigrams: one more of them beside it, new or not, wouldn't lower its coefficient.  Windows are runs' starts with runs' ends
    in reach; starts with fewer than `need` of the template's bigrams in reach are left out, which is exact.
    """
    rows = []
    for name, t in templates:
        g, size = bigrams(t), len(re.findall(TOKEN, t.translate(str.maketrans(UPPER, LOWER)))) - 1
        need, most = math.ceil(len(g) * threshold / (2 - threshold) - 1e-9), max(size, REPEATS * math.floor(len(g) * (2 - threshold) / threshold + 1e-9))
        rows.append(F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, g)).alias("g"), F.lit(most).alias("most"), F.lit(need).alias("need")))
    none = F.expr("cast(array() as array<struct<neg: double, license: string, scope: string>>)")

    def at(g: Column, t: Column, places: Column) -> Column:
        def scored(p: Column, e: Column) -> Column:
            return _let(F.array_distinct(F.slice(g, p, e - p + 1)), lambda w: F.array(F.struct((-F.round(2.0 * F.size(F.array_intersect(w, t["g"])) / (F.size(w) + F.size(t["g"])), DIGITS)).alias("neg"), t["license"].alias("license"), F.lit("window").alias("scope"))))

        def of_start(s: Column, ends: Column) -> Column:
            # The runs that start in reach of s number half of it at most.
            reach = F.filter(F.slice(ends, s["run"] + 1, (t["most"] / 2).cast("int") + 1), lambda e: e.between(s["p"] + t["need"] - 1, s["p"] + t["most"] - 1))
            return F.flatten(F.transform(reach, lambda e: scored(s["p"], e)))

        first = F.filter(F.transform(places, lambda p, k: F.struct(p.alias("p"), k.alias("k"))), lambda s: (s["k"] == 0) | (F.get(places, s["k"] - 1) < s["p"] - 1))
        starts = F.transform(first, lambda s, n: F.struct(s["p"].alias("p"), s["k"].alias("k"), n.alias("run")))
        starts = F.filter(starts, lambda s: F.coalesce(F.get(places, s["k"] + t["need"] - 1) < s["p"] + t["most"], F.lit(False)))
        ends = F.filter(places, lambda p, k: F.coalesce(F.get(places, k + 1) > p + 1, F.lit(True)))
        return F.filter(_let(ends, lambda e: F.flatten(F.transform(starts, lambda s: of_start(s, e)))), lambda s: s["neg"] <= -threshold)

    def of(g: Column, t: Column) -> Column:
        return _let(F.array_intersect(g, t["g"]), lambda shared: F.when(F.size(shared) >= t["need"], _let(F.filter(F.sequence(F.lit(1), F.size(g)), lambda i: F.array_contains(shared, F.get(g, i - 1))), lambda places: at(g, t, places))).otherwise(none))

    def paired(w: Column) -> Column:
        return F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.expr("cast(array() as array<string>)"))

    return _let(F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0)), lambda w: _let(paired(w), lambda g: F.flatten(F.transform(F.array(*rows), lambda t: of(g, t)))))


def scan_all(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, scope of every licence that a row of docs (doc_id, text) matches, wherever in the text it stands.

    Units are those of `scan`, windows too, so a licence of several paragraphs within a text, or a notice within
    a line, is found.  Each licence has its best unit; of equal ones the first of line, paragraph, text and window.  A row without
    a match, or without a text, has one row with nulls.
    """
    text = F.col("text")
    found = F.concat(_hits(text, templates, threshold), _window_hits(text, templates, threshold))
    best = _let(found, lambda h: F.transform(F.array_distinct(F.transform(h, lambda s: s["license"])), lambda n: F.array_min(F.filter(h, lambda s: s["license"] == n))))
    rows = docs.select("doc_id", F.explode_outer(F.when(_some(text, templates, threshold), best)).alias("m"))
    return rows.select("doc_id", F.col("m.license").alias("license"), (-F.col("m.neg")).alias("dice"), F.col("m.scope").alias("scope"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, scope of every row of docs (doc_id, text).

    The best match of at least threshold; of equal ones the first licence by name, then the first of line,
    paragraph, text and window.  Without a match, or without a text, license, dice and scope are null.  Rows that repeat stay;
    an empty table gives an empty one.
    """
    found = docs.select("doc_id", best_match(F.col("text"), templates, threshold).alias("m"))
    return found.select("doc_id", F.col("m.license").alias("license"), (-F.col("m.neg")).alias("dice"), F.col("m.scope").alias("scope"))


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same for DuckDB: every unit against every template.  Texts without an anchor are left out before they are cut into windows."""
    quoted = [(name, t.replace("'", "''")) for name, t in templates]
    listed = ", ".join(f"({i}, '{name}', '{t}')" for i, (name, t) in enumerate(quoted))
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    tokens = f"regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '{TOKEN}')"
    dice = f"round(2.0 * len(list_intersect({{0}}, k.g)) / (len({{0}}) + len(k.g)), {DIGITS})"
    share = threshold / (2 - threshold)
    return f"""with templates(tid, license, t) as (values {listed}),
    tt as (select tid, license, list_distinct({pairs}) as g, greatest(len(w) - 1, {REPEATS} * floor(len(list_distinct({pairs})) * {1 / share} + 1e-9)) as most, ceil(len(list_distinct({pairs})) * {share} - 1e-9) as need from (select tid, license, {tokens} as w from templates)),
    units as (select doc_id, 'text' as scope, text as t from documents where text is not null
        union all select doc_id, 'paragraph', unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) from documents where text is not null
        union all select doc_id, 'line', unnest(string_split(text, chr(10))) from documents where text is not null),
    cut as (select doc_id, scope, list_distinct({pairs}) as g from (select doc_id, scope, {tokens} as w from units) where len(w) > 1),
    hits as (select doc_id, license, scope, {dice.format('c.g')} as dice from cut c join tt k
        on len(c.g) between len(k.g) * {share - 1e-9} and len(k.g) * {1 / share + 1e-9}),
    anchored as (select doc_id, {pairs} as g from (select doc_id, {tokens} as w from (select doc_id, text as t from documents where regexp_matches(text, '(^|[^A-Za-z0-9])(?i:{"|".join(anchors(templates, threshold))})([^A-Za-z0-9]|$)'))) where len(w) > 1),
    placed as (select s.doc_id, k.tid, list_filter(range(1, len(s.g) + 1), lambda i: list_contains(k.g, s.g[i])) as p from anchored s cross join tt k),
    spots as (select doc_id, tid, unnest(p) as p from placed join tt using (tid) where len(p) >= need),
    edges as (select *, lag(p) over w as before, lead(p) over w as after from spots window w as (partition by doc_id, tid order by p)),
    ends as (select s.doc_id, s.tid, s.p, e.p as e from edges s join edges e using (doc_id, tid) join tt using (tid)
        where coalesce(s.before < s.p - 1, true) and coalesce(e.after > e.p + 1, true) and e.p between s.p + need - 1 and s.p + most - 1),
    windows as (select n.doc_id, n.tid, list_distinct(list_slice(s.g, n.p, n.e)) as g from ends n join anchored s using (doc_id)),
    every as (select * from hits union all select doc_id, license, 'window', {dice.format('w.g')} from windows w join tt k using (tid)),
    best as (select *, row_number() over (partition by doc_id order by dice desc, license, scope) as k from every where dice >= {threshold})
    select d.doc_id, b.license, b.dice, b.scope from documents d left join best b on d.doc_id = b.doc_id and b.k = 1"""
