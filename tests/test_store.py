"""The table log, keyed merges, the governed store and the kept index: races, crashes, conflicts, and results against loops."""

import math
import random
import re
import threading
from collections import Counter
from pathlib import Path

import pytest

from lectern.operators import governed, inverted, ledger, search
from lectern.operators.tablelog import Change, Lost, TableLog, merged


def rows(spark, *r, schema="k long, seq long, v string"):
    return spark.createDataFrame(list(r), schema)


def test_two_writers_at_once(spark, tmp_path):
    log = TableLog(spark, str(tmp_path / "t"))
    wait, failed = threading.Barrier(2), []

    def write(name):
        def build(base):
            if base.number == 0:
                wait.wait(timeout=60)
            return log.stage("t", rows(spark, (1, 1, name)))

        try:
            log.commit(build)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and log.number() == 2
    assert sorted(r.v for r in log.read("t", log.version()).collect()) == ["a", "b"]
    with pytest.raises(Lost):
        log.put(log.version(1), Change())
    # The writer that lost staged its part twice; the first try is an orphan.
    assert len(log.vacuum()) == 1 and log.read("t", log.version()).count() == 2


def test_a_crash_between_tables_leaves_nothing(spark, tmp_path):
    log = TableLog(spark, str(tmp_path / "t"))
    log.commit(lambda _: log.stage("a", rows(spark, (1, 1, "x"))))

    def crash(_):
        log.stage("a", rows(spark, (2, 1, "y")))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        log.commit(crash)
    before = log.version()
    assert log.read("a", before).count() == 1 and len(list(Path(tmp_path / "t" / "a").iterdir())) == 2
    assert len(log.vacuum()) == 1 and len(list(Path(tmp_path / "t" / "a").iterdir())) == 1
    log.commit(lambda base: Change(drop={p.path for p in base.parts["a"]}))
    assert log.read("a", log.version()).count() == 0 and log.read("a", before).count() == 1


def test_merge_is_the_last_row_of_each_key(spark, tmp_path):
    r, want = random.Random(4), {}
    log = TableLog(spark, str(tmp_path / "t"))
    for batch in range(6):
        part = [(r.choice([None, *range(12)]), r.randrange(8), f"{batch}-{i}", r.random() < 0.2) for i in range((9, 12, 0, 1, 9, 12)[batch])]
        part = list({(k, s): (k, s, v, g) for k, s, v, g in part}.values())
        for k in {x[0] for x in part}:
            old = [(*want[k][:1], 0, want[k][1], False)] if k in want else []
            last = max(old + [(s, 1, v, g) for kk, s, v, g in part if kk == k], key=lambda x: x[:2])
            want.pop(k, None)
            if not last[3]:
                want[k] = (last[0], last[2])
        df = spark.createDataFrame(part, "k long, seq long, v string, gone boolean")
        log.commit(lambda base, df=df: merged(log, "t", base, df, "k", "seq", 4, "gone"))
    got = {x.k: (x.seq, x.v) for x in log.read("t", log.version()).collect()}
    assert got == want and len(want) > 2


def test_buckets_that_a_batch_does_not_touch_keep_their_files(spark, tmp_path):
    log = TableLog(spark, str(tmp_path / "t"))
    one = log.commit(lambda base: merged(log, "t", base, spark.range(200).selectExpr("id as k", "0 as seq", "'a' as v"), "k", "seq", 16))
    two = log.commit(lambda base: merged(log, "t", base, spark.range(2).selectExpr("id as k", "1 as seq", "'b' as v"), "k", "seq", 16))
    same = set(one.parts["t"]) & set(two.parts["t"])
    assert len(one.parts["t"]) == len(two.parts["t"]) == 16 and len(same) >= 14
    assert log.read("t", two).where("v = 'b'").count() == 2 and log.read("t", two).count() == 200


def store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x", ["public"]), (2, "y", ["hr"]), (3, "x", ["public"])], "doc_id long, checksum string, acl_tags array<string>")
    chunks = spark.createDataFrame([(10, 1, ["public"], True), (11, 1, ["public"], False), (20, 2, ["hr"], False), (30, 3, ["public"], False)], "chunk_id long, doc_id long, acl_tags array<string>, quarantined boolean")
    log = TableLog(spark, str(tmp_path / "s"))
    governed.ingest(log, docs, chunks, "me")
    return log, docs, chunks


def test_governed_changes_carry_their_ledger_rows(spark, tmp_path):
    log, docs, chunks = store(spark, tmp_path)
    assert sorted(r.chunk_id for r in log.read("chunks", log.version()).collect()) == [10, 11, 20]
    governed.ingest(log, docs, chunks, "me")
    governed.release(log, [10], "admin")
    governed.retag(log, {1: ["staff", "public"]}, "admin")
    now = log.version()
    assert now.number == 4 and log.read("documents", now).count() == 2
    assert {r.chunk_id: (list(r.acl_tags), r.quarantined) for r in log.read("chunks", now).collect()} == {10: (["staff", "public"], False), 11: (["staff", "public"], False), 20: (["hr"], False)}
    book = log.read("ledger", now)
    assert [(r.seq, r.kind) for r in book.orderBy("seq").collect()] == [(1, "ingest"), (2, "ingest"), (3, "quarantine"), (4, "retag")]
    assert '"previous_acl_tags":["public"]' in book.where("seq = 4").first().payload and ledger.verify(book).first().ok
    for bad, error in (([99], KeyError), ([10], ValueError)):
        with pytest.raises(error):
            governed.release(log, bad, "admin")
    with pytest.raises(KeyError):
        governed.retag(log, {3: ["x"]}, "admin")
    with pytest.raises(ValueError):
        governed.retag(log, {1: []}, "admin")
    assert log.number() == 4 and log.read("ledger", log.version()).count() == 4


def test_two_releases_at_once_follow_one_another_in_the_ledger(spark, tmp_path):
    log, _, _ = store(spark, tmp_path)
    base = log.version()
    governed.retag(log, {2: ["it"]}, "a")
    with pytest.raises(Lost):
        log.put(base, governed._entries(log, base, [("note", None, {"x": 1})]))
    governed.release(log, [10], "b")
    assert ledger.verify(log.read("ledger", log.version())).first().ok


def brute_bm25(docs, query, k):
    tokens = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in docs.items()}
    n, mean = len(docs), sum(map(len, tokens.values())) / max(1, len(docs))
    score = Counter()
    for term, reps in Counter(re.findall(r"[^\W_]+", query.lower())[:64]).items():
        df = sum(term in w for w in tokens.values())
        idf = math.log((n - df + 0.5) / (df + 0.5))
        for i, w in tokens.items():
            if tf := w.count(term):
                score[i] += reps * (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return [(i, round(s, 6)) for i, s in sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]]


def test_kept_index_follows_its_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "RUNS", 3)
    r, now = random.Random(8), {}
    names = "red blue green house tree river stone cloud".split()
    asked = spark.createDataFrame([(0, "Red house river red"), (1, "cloud"), (2, "..."), (3, "nothing here")], "query_id long, text string")
    for batch in range(7):
        docs = {r.randrange(40): " ".join(r.choice(names) for _ in range(r.randint(0, 20))) for _ in range(12)}
        gone = r.sample(sorted(now), min(3, len(now)))
        index = inverted.InvertedIndex(spark, str(tmp_path / "i"), buckets=4)
        if batch % 3 != 2:
            index.add(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
            now |= docs
        else:
            index.add(spark.createDataFrame([(i, None) for i in docs] + [(None, "red")], "doc_id long, text string"), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
            now = {i: t for i, t in now.items() if i not in gone} | dict.fromkeys(docs, "")
        found = index.search(asked, None, 5).collect()
        for q in asked.collect():
            got = [(x.doc_id, x.score) for x in sorted(found, key=lambda x: x["rank"]) if x.query_id == q.query_id]
            assert [i for i, _ in got] == [i for i, _ in brute_bm25(now, q.text, 5)]
            assert [s for _, s in got] == pytest.approx([s for _, s in brute_bm25(now, q.text, 5)], abs=2e-6)
    assert index.log.version().facts["runs"] <= 3
    assert index.search(asked, None, 0).count() == 0


def test_index_of_stems_and_headings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Nothing of note", "Running costs"), (2, "He ran home", None), (3, "The café runs well", "x")], "doc_id long, text string, heading string")
    index = inverted.InvertedIndex(spark, str(tmp_path / "i"), columns=("text", "heading"), analyser="stemmed", buckets=4)
    index.add(docs)
    asked = spark.createDataFrame([(0, "run"), (1, "CAFE")], "query_id long, text string")
    assert {(x.query_id, x.doc_id) for x in index.search(asked, None).collect()} == {(0, 1), (0, 3), (1, 3)}


def test_search_reads_the_asked_terms_buckets(spark, tmp_path):
    index = inverted.InvertedIndex(spark, str(tmp_path / "i"), buckets=32)
    index.add(spark.createDataFrame([(i, f"common w{i} w{i + 1}") for i in range(300)], "doc_id long, text string"))
    read = index.postings(spark.createDataFrame([("w7",)], "term string"), index.log.version())
    assert read.count() == 2 and len({f.rsplit("/", 2)[1] for f in read.inputFiles()}) == 1
    assert "PushedFilters: [" in read._jdf.queryExecution().executedPlan().toString()


def test_kept_index_is_bm25(spark, tmp_path):
    from lectern.plans.tables import docs_acl, questions
    from tests.oracle import DATA

    index = inverted.InvertedIndex(spark, str(tmp_path / "i"), buckets=8)
    index.add(docs_acl(spark, DATA))
    want = search.bm25(docs_acl(spark, DATA), questions(spark, DATA)).select("query_id", "doc_id", "score", "rank")
    got = index.search(questions(spark, DATA), docs_acl(spark, DATA)).select("query_id", "doc_id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
