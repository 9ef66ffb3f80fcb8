"""Entitlement by layout, exact percentiles by ranges, passages that are checked again."""

import random
import re

import numpy as np
import pytest

from lectern.operators import acl, evals, layout, search


def test_layout_lists_only_what_a_user_may_read(spark, tmp_path):
    r = random.Random(2)
    sets = [["public"], ["hr", "public"], ["public", "hr"], ["staff"], [], None, ["a\x01"]]
    rows = spark.createDataFrame([(i, r.choice(sets), r.choice([True, False, None])) for i in range(200)], "id long, acl_tags array<string>, quarantined boolean")
    laid = layout.ByTagSet.write(rows, str(tmp_path / "t"))
    for tags in (None, [], ["hr"], ["staff", "public"], ["none"], ["a\x01"]):
        want = sorted(x.id for x in acl.entitled(rows, tags).collect())
        seen = laid.visible(tags)
        assert sorted(x.id for x in seen.collect()) == want
        plan = seen._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^]]*tag_set", plan) or not want
    assert len(laid.numbers(["public"])) == 2 and len(laid.numbers(["staff"])) == 1
    assert laid.visible().columns == rows.columns
    empty = layout.ByTagSet.write(rows.limit(0), str(tmp_path / "e"))
    assert empty.numbers(["public"]) == []


def test_exact_percentiles(spark):
    r = random.Random(3)
    data = [("one", float(r.choice([1, 2, 2, 2, 7, 1e9, -3.5]))) for _ in range(500)] + [("many", r.random()) for _ in range(5000)] + [("single", 4.0), ("none", None), (None, 1.0), (None, 2.0)]
    rows = spark.createDataFrame(data, "g string, v double").repartition(5)
    found = {x.g: x for x in evals.exact_percentiles(rows, "g", "v", {"low": 0.0, "mid": 0.5, "high": 0.95, "top": 1.0}).collect()}
    for g in ("one", "many", "single", None):
        values = [v for k, v in data if k == g and v is not None]
        assert list(found[g])[1:] == pytest.approx([np.percentile(values, p) for p in (0, 50, 95, 100)], rel=1e-12)
    assert list(found["none"])[1:] == [None] * 4
    assert evals.exact_percentiles(rows.limit(0), "g", "v", {"p": 0.5}).count() == 0


def test_passages_are_checked_again(spark):
    chunks = spark.createDataFrame([(1, "a  b\n" * 200, ["public"], False, "x.md"), (2, "secret", ["hr"], False, "y"), (3, "held", ["public"], True, "z"), (4, "short", ["public", "hr"], False, None)], "doc_id long, text string, acl_tags array<string>, quarantined boolean, source string")
    asked = spark.createDataFrame([(0, ["public"]), (1, ["hr"])], "query_id long, user_tags array<string>")
    hits = spark.createDataFrame([(q, i, p) for q in (0, 1) for p, i in enumerate((3, 2, 1, 4), 1)], "query_id long, doc_id long, rank long")
    found = {(x.query_id, x["rank"]): x for x in search.passages(hits, chunks, asked).collect()}
    assert {k: x.doc_id for k, x in found.items()} == {(0, 1): 1, (0, 2): 4, (1, 1): 2, (1, 2): 4}
    assert len(found[0, 1].passage) <= 400 and found[0, 1].passage.endswith("…") and "\n" not in found[0, 1].passage


def test_given_tags():
    assert acl.given_tags(None) == ["public"] and acl.given_tags([" b", "a", "b"]) == ["a", "b"]
    for bad in ([], [" "]):
        with pytest.raises(ValueError, match="must name"):
            acl.given_tags(bad)
