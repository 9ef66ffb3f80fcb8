"""Training-data operators on whole inputs, on rows where a cut would show."""

import re

import numpy as np

from lectern.llm import licenses, mixing, packing, urls
from lectern.llm.license_texts import TEMPLATES
from tests.oracle import DATA

PAGES = "page_id long, url string, html string"


def verdicts(spark, pages):
    return {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, PAGES)).collect()}


def test_distrust_travels_any_number_of_links(spark):
    chain = [(k, f"http://h{k}.test/", f"<a href='http://h{k - 1}.test/'>") for k in range(2, 16)]
    found = verdicts(spark, [(1, "http://h1.test/", '<a href="//bad.org/z">'), (0, "http://bad.org/es/1", ""), *chain, (99, "http://alone.test/", "")])
    assert found == {k: "block" for k in range(16)} | {99: "allow"}


def test_verdicts_do_not_hang_on_the_size_of_the_table(spark):
    many = [(100 + k, f"http://s{k}.org/es/1", "") for k in range(2000)]
    thin = " ".join(f"<a href='http://t{k}.test/'>" for k in range(99))
    chain = [(k, f"http://h{k}.test/", f"<a href='http://h{k - 1}.test/'>{thin}") for k in range(2, 6)]
    others = [(10 + k, f"http://x{k}.test/", " ".join(f"<a href='http://h{j}.test/'>" for j in range(1, 6))) for k in range(80)]
    pages = [(0, "http://bad.org/es/1", ""), (1, "http://h1.test/", f"<a href='http://bad.org/'>{thin}"), *chain, *others]
    assert {k: v for k, v in verdicts(spark, pages + many).items() if k < 6} == {k: "block" for k in range(6)}


def brute_licences(text):
    """The best coefficient of every licence over all windows of a text."""
    found = {}
    words = re.findall("[a-z0-9]+", text.lower())
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    for name, template in TEMPLATES:
        g = set(licenses.bigrams(template))
        for i in range(len(pairs)):
            seen, shared = set(), 0
            for j in range(i, len(pairs)):
                if pairs[j] not in seen:
                    seen.add(pairs[j])
                    shared += pairs[j] in g
                if len(seen) > 1.5 * len(g):
                    break
                dice = round(2 * shared / (len(seen) + len(g)), 6)
                if dice >= licenses.THRESHOLD:
                    found[name] = max(found.get(name, 0), dice)
    return found


def test_stretched_licences_are_found_in_prose(spark):
    import duckdb

    from tests.oracle import same

    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 300).split()
    prose = "We walked along the river and talked of the house and of the software. "
    texts = []
    for share, spots in ((0.4, 1), (0.45, 1), (0.4, 5), (0.2, 30), (0.7, 1)):
        n, w = int(share * len(mit)), list(mit)
        for k in range(spots):
            at = (k + 1) * len(mit) // (spots + 1) + k * (n // spots)
            w[at:at] = [f"x{k}y{i}" for i in range(n // spots)]
        texts.append(prose * 4 + " ".join(w) + " " + prose * 4)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in licenses.scan_all(rows).collect():
        found.setdefault(r.doc_id, {})[r.license] = r.dice
    for k, t in enumerate(texts):
        assert {n: d for n, d in found[k].items() if n} == brute_licences(t), k
    assert [("MIT" in found[k]) for k in range(5)] == [True, True, True, False, False]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    same(con, licenses.scan(rows), licenses.oracle())


def test_a_long_text_of_licences(spark):
    import time

    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 300)
    text = "\n\n".join(f"Package {i} by author {i * 7}.\n\n{mit}" for i in range(1_000_000 // len(mit)))
    licenses.scan(spark.createDataFrame([(1, mit)], "doc_id long, text string")).collect()
    began = time.time()
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().license == "MIT"
    assert time.time() - began < 60


def test_licences_inside_longer_texts(spark):
    by = {}
    for name, text in TEMPLATES:
        by.setdefault(name, []).append(text)
    long = {n: max(t, key=len) for n, t in by.items()}
    mit = long["MIT"].split()
    paragraphs = "\n\n".join(" ".join(mit[i : i + len(mit) // 3 + 1]) for i in range(0, len(mit), len(mit) // 3 + 1))
    prose = "We walked along the river and talked of the house. " * 20
    other = next(n for n in sorted(long) if n != "MIT")
    texts = [prose + "\n\n" + paragraphs, "Copyright 2024 Acme Ltd. Released under the MIT License. Enjoy it.", paragraphs + "\n\n" + prose + long[other], prose, None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in licenses.scan_all(rows).collect():
        found.setdefault(r.doc_id, {})[r.license] = r.dice
    assert "MIT" in found[0] and "MIT" in found[1] and {"MIT", other} <= set(found[2])
    assert found[3] == found[4] == found[5] == {None: None}
    for k in (0, 1):
        want = brute_licences(texts[k])
        assert set(want) == set(found[k]) and all(found[k][n] >= want[n] - 1e-9 for n in want)


def test_mix_comes_in_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 64)
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    out = mixing.mixed_shards(rows, block=16).toPandas()
    want = {r.doc_id: r.taken for r in mixing.mix(rows, block=16).collect() if r.taken}
    assert out.text.map(lambda t: len(t.encode().split())).groupby(out.doc_id).sum().to_dict() == want
    assert out.shard.nunique() > 1 and (out.groupby("shard").place.max() == out.groupby("shard").size()).all() and not out.duplicated(["shard", "place"]).any()
    assert out.groupby("shard").source.nunique().max() > 1
    again = mixing.mixed_shards(rows.repartition(7), block=16).toPandas()
    order = ["shard", "place", "doc_id", "text"]
    assert out[order].sort_values(order[:2]).values.tolist() == again[order].sort_values(order[:2]).values.tolist()


def test_every_sentence_end_is_a_cut():
    ids = np.array([0, 1] * 20)
    at, _ = packing.cuts_of(ids, np.array([40]), np.array([False, True]))
    assert at == [0, *range(2, 41, 2)]
