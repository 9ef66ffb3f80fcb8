"""Entitlement: who may see a row.  A row is visible if its tags and the user's meet and it isn't quarantined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUBLIC = ("public",)
CONTROL = "[\\x00-\\x1f\\x7f]"


def parse_tags(raw: Column) -> Column:
    """Stored JSON as an array of tags: text elements only; anything but an array gives none."""
    items = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    return F.coalesce(F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.variant_get(x, "$", "string")), F.array().cast("array<string>"))


def clean_tags(tags: Column) -> Column:
    """User tags without those that hold control characters."""
    return F.filter(tags, lambda t: ~F.rlike(t, F.lit(CONTROL)))


def normalised_tags(tags: Column) -> Column:
    """Tags at ingest: trimmed, without empty ones, sorted and distinct; none at all is `public`."""
    found = F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, PUBLIC)))


def given_tags(tags: list[str] | None) -> list[str]:
    """The tags that an ingest gives its documents: none at all is `public`, a list that names none is an error."""
    found = sorted({t.strip() for t in tags or () if t.strip()})
    if tags is not None and not found:
        raise ValueError("a list of tags must name one")
    return found or list(PUBLIC)


def may_see(row_tags: Column, user_tags: Column, quarantined: Column) -> Column:
    return F.coalesce(F.arrays_overlap(row_tags, user_tags), F.lit(False)) & ~F.coalesce(quarantined, F.lit(True))


def entitled(rows: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """The rows of (acl_tags, quarantined, ...) that a user with tags may see.  None: a public user; []: nothing."""
    tags = list(PUBLIC) if tags is None else [t for t in tags if not any(ord(c) < 32 or ord(c) == 127 for c in t)]
    if not tags:
        return rows.limit(0)
    return rows.where(may_see(F.col("acl_tags"), F.array(*map(F.lit, tags)), F.col("quarantined")))


def entitled_semi(rows: DataFrame, key: str, tags: list[str]) -> DataFrame:
    """As entitled, by a semi join on the rows' exploded tags, which a table of (key, tag) can answer without reading rows."""
    user = rows.sparkSession.createDataFrame([(t,) for t in tags], "tag string")
    held = rows.where(~F.col("quarantined")).select(key, F.explode("acl_tags").alias("tag")).join(user, "tag", "left_semi").select(key).distinct()
    return rows.join(held, key, "left_semi")


def source_status(acl_tags: Column, user_tags: Column) -> Column:
    """The source viewer's answer: 404 for an unknown row, 403 without a common tag, else 200 (quarantined rows too)."""
    return F.when(acl_tags.isNull(), 404).when(F.arrays_overlap(acl_tags, user_tags), 200).otherwise(403)


def odata_filter(tags: list[str]) -> str:
    """The same predicate for a search service that takes OData; a tag with a comma can't be said."""
    if any("," in t for t in tags):
        raise ValueError("a tag can't have a comma")
    if not tags:
        return "false"
    listed = ",".join(t.replace("'", "''") for t in tags)
    return f"quarantined eq false and acl_tags/any(t: search.in(t, '{listed}', ','))"


def identity(user: Column, tags: Column, address: Column, trusted: Column) -> Column:
    """struct(id, tags) of a request: a trusted proxy's user and tags, the owner on the machine itself, else an anonymous public user."""
    local = address.isin("127.0.0.1", "::1", "localhost") | F.startswith(address, F.lit("127."))
    public = F.array(*map(F.lit, PUBLIC))
    named = trusted & (F.coalesce(user, F.lit("")) != "")
    return F.when(named, F.struct(user.alias("id"), normalised_tags(clean_tags(F.coalesce(tags, public))).alias("tags"))).when(local, F.struct(F.lit("owner").alias("id"), normalised_tags(F.coalesce(tags, public)).alias("tags"))).otherwise(F.struct(F.lit("anonymous").alias("id"), public.alias("tags")))
