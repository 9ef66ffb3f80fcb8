"""Judges URLs by rules and, where none fits, by trust that travels over the links between hosts.

Hosts with pages that a rule allows are trusted seeds, those with pages that a rule blocks are distrusted ones.  Personalised
PageRank takes trust along links and distrust against them; a host is blocked if more than `THRESHOLD` of what it holds of both is
distrust.  All steps are DataFrame functions; the state is one row for each host and kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ascii_lower, checkpoint, spread_join

#: (host, start of the path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Rounds and digits are those of the SQL.
DAMPING, ROUNDS, THRESHOLD, DIGITS = 0.85, 8, 0.5, 12
#: Scores are done when no host's grows by more than this share of itself; shares of distrust are compared to so many digits.
TOLERANCE, SHARE_DIGITS = 1e-8, 6
#: More rounds than this are an error.
MOST_ROUNDS = 10_000
#: Rules are sent with the plan; more than this many are refused.
MOST_RULES = 10_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """rule, verdict of the longest rule that fits, or null.  A rule fits its host, all subdomains and all paths that start with its own."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    texts = [(h, p, v, h + p) for h, p, v in rules]
    table = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"), F.lit(t).alias("rule")) for h, p, v, t in sorted(texts, key=lambda t: (-len(t[3]), t[3]))])
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.get(fits, 0)


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """src, dst, weight: share of a host's links to each other host.  Links within a host count as none."""
    links = F.regexp_extract_all(F.col(html), F.lit("(?i)href\\s*=\\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\\s>]*)"), F.lit(1))
    found = pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(links).alias("link"))
    # A link that starts with // has its page's scheme; only its host counts here.
    found = found.select("src", host_of(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst"))
    counts = found.where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = counts.groupBy("src").agg(F.sum("n").alias("all"))
    return counts.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("weight"))


def propagated(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, most: int = MOST_ROUNDS) -> DataFrame:
    """kind, host, score of personalised PageRank from seeds (kind, host, score; adding up to 1 for each kind).

    edges (kind, src, dst, weight) have weights that add up to 1 for each source.  What a host without edges
    holds goes back to the seeds, as does 1 - DAMPING of the rest: the scores are then those of y = seeds + DAMPING * (what y
    sends along edges), divided by their sum.  Every round adds to y, and reaches hosts one link further, until no
    host's y grows by more than `tolerance` of itself, whatever its size.
    """
    seeds, edges = checkpoint(seeds), checkpoint(edges)
    if edges.isEmpty():
        return seeds
    links = edges.withColumnRenamed("src", "host")
    state = seeds
    for _ in range(most):
        moved = state.join(links, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (DAMPING * F.col("score") * F.col("weight")).alias("score"), F.lit(0.0).alias("before"))
        rows = moved.union(seeds.select("kind", "host", "score", F.lit(0.0))).union(state.select("kind", "host", F.lit(0.0), "score"))
        grown = checkpoint(rows.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before")))
        state = grown.select("kind", "host", "score")
        if grown.where(F.col("score") - F.col("before") > tolerance * F.col("score")).isEmpty():
            total = state.groupBy("kind").agg(F.sum("score").alias("all"))
            return state.join(total, "kind").select("kind", "host", (F.col("score") / F.col("all")).alias("score"))
    raise RuntimeError(f"scores of hosts still change after {most} rounds")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url, html).

    A null url, or one without ://, has an empty host and path: no rule fits, and it is allowed, as are
    hosts that hold neither trust nor distrust.  Repeated rows keep their rows; a null html has no links; other columns aren't
    used, and an empty table gives an empty one.
    """
    named = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = named.withColumn("fit", matched(F.col("host"), F.col("path"), rules))
    held = named.groupBy("host").agg(F.count(F.when(F.col("fit.verdict") == "allow", 1)).alias("allow"), F.count(F.when(F.col("fit.verdict") == "block", 1)).alias("block")).where("host <> ''")
    seeds = held.select("host", F.explode(F.create_map(F.lit("trust"), "allow", F.lit("distrust"), "block")).alias("kind", "n")).where("n > 0")
    total = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = seeds.join(total, "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("score"))
    links = host_edges(named)
    back = links.groupBy("dst").agg(F.sum("weight").alias("all"))
    back = links.join(back, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("all")).alias("weight"))
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(back)
    scores = propagated(seeds, edges).groupBy(F.col("host").alias("h")).agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"),
    )
    bad = scores.where(F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), SHARE_DIGITS) > THRESHOLD).select("h")
    pages_of = named.groupBy("host").agg(F.count("*").alias("n"))
    plain = spread_join(named.select("page_id", "host", "path", "fit"), bad.select(F.col("h").alias("host"), F.lit(True).alias("bad")), "host", pages_of, "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("bad"), "block").otherwise("allow"))
    return plain.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def oracle(rules: tuple[tuple[str, str, str], ...] = RULES, rounds: int = ROUNDS) -> str:
    """The same over the views of DuckDB, but for `rounds` rounds only, each a subquery, and without links that start with //."""
    listed = ", ".join(f"('{h}', '{p}', '{v}', '{h}{p}')" for h, p, v in rules)
    sql = f"""with rules(rhost, rpath, rverdict, rule) as (values {listed}),
    named as (select page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
    hits as (select page_id, rule, rverdict, row_number() over (partition by page_id order by length(rule) desc, rule) as k
        from named join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)),
    fit as (select n.*, h.rule, h.rverdict from named n left join hits h on n.page_id = h.page_id and h.k = 1),
    counts as (select host, 'trust' as kind, count(*) filter (rverdict = 'allow') as n from fit where host <> '' group by host
        union all select host, 'distrust', count(*) filter (rverdict = 'block') from fit where host <> '' group by host),
    seeds as (select kind, host, n / sum(n) over (partition by kind)::double as score from counts where n > 0),
    raw as (select host as src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["'']?([a-z][a-z0-9+.-]*://[^"''\\s>]*)', 1)) as link from fit where host <> ''),
    pairs as (select src, translate(regexp_extract(link, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst from raw),
    links as (select src, dst, n / sum(n) over (partition by src)::double as weight from (select src, dst, count(*) as n from pairs where dst <> '' and src <> dst group by src, dst)),
    edges as (select 'trust' as kind, src, dst, weight from links
        union all select 'distrust', dst, src, weight / sum(weight) over (partition by dst) from links),
    s0 as (select kind, host, score from seeds)"""
    for k in range(1, rounds + 1):
        sql += f""",
    s{k} as (select kind, host, round(sum(score), {DIGITS}) as score from (
        select e.kind, e.dst as host, {DAMPING} * sum(s.score * e.weight) as score from s{k - 1} s join edges e on s.kind = e.kind and s.host = e.src group by e.kind, e.dst
        union all select d.kind, d.host, d.score * (1 - coalesce((select {DAMPING} * sum(s.score) from s{k - 1} s where s.kind = d.kind and exists (select 1 from edges e where e.kind = s.kind and e.src = s.host)), 0)) from seeds d)
        group by kind, host)"""
    return sql + f""",
    bad as (select host from s{rounds} group by host having sum(score) filter (kind = 'distrust') > {THRESHOLD} * sum(score))
    select page_id, f.host, path, rule, coalesce(rverdict, case when b.host is not null then 'block' else 'allow' end) as verdict from fit f left join bad b on f.host = b.host"""
