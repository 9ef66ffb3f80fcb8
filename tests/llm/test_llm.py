"""The training-data operators against brute force, and on hard inputs: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import archive, common, language, licenses, mixing, neardup_vectors, packing, queries, simhash, spotsigs, substrings, urls
from tests.oracle import DATA, duck, plain, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


#: Ids that repeat, nulls, empty and blank texts, equal texts, one long text.
def hard(spark):
    random.seed(3)
    long = " ".join(random.choice("the of red blue house tree is runs. Fast! and".split()) for _ in range(30_000))
    rows = [(1, None, None), (2, "", "a"), (3, " \n\t", "a"), (4, "one", "b"), (5, "one", None), (5, "the red house and the blue tree", "b"), (5, "the red house and the blue tree", "b"), (None, "of one is two", "a"), (7, long, "é"), (8, long, "z"), (9, "日本語 😀 ünï\x00 x", "a"), (10, "0 1 2 | & %", "a")]
    return docs_of(spark, rows).withColumns({"part": F.lit(1), "index": F.lit("x"), "begin": F.lit(2), "size": F.lit(0), "bucket": F.lit(0), "key": F.lit("k"), "guest": F.lit("g"), "twin": F.lit("t"), "kept": F.lit("q"), "score": F.lit("s")})


OPERATORS = {
    "licenses": licenses.scan,
    "spotsigs": spotsigs.compared,
    "spotsigs_classes": spotsigs.near_duplicates,
    "packing": lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    "substrings": substrings.dedup_substrings,
    "mixing": mixing.mix,
    "mixed": mixing.mixed_documents,
    "simhash": simhash.near_duplicates,
    "keep_one": simhash.keep_one,
    "language": language.identify,
    "licenses_all": licenses.scan_all,
    "mixed_shards": mixing.mixed_shards,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hard_rows(spark, name):
    rows = OPERATORS[name](hard(spark)).collect()
    if name not in ("packing", "mixed", "keep_one", "licenses_all", "mixed_shards"):
        assert len(rows) == 12


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](docs_of(spark, [])).count() == 0


def test_hard_pages(spark):
    long = "http://long.test/" + "a" * 200_000
    rows = [(1, None, None), (2, "", ""), (2, "no scheme", "<a href='http://x.org/es/'>"), (3, "HTTP://EXAMPLE.com/en/7", None), (3, "HTTP://EXAMPLE.com/en/7", None), (None, "http://a.net/de/", "x"), (4, long, "<a href='//b.test/'>" * 20_000), (5, "://", "\x00"), (6, "http://b.test?x#y", "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("host", "path", "rule", "verdict", "score", "src", "dst", "kind", "a.b")})
    found = urls.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()
    assert len(found) == len(rows) and {r.verdict for r in found} <= {"allow", "block"}
    assert [(r.host, r.rule, r.verdict) for r in found if r.page_id == 3] == [("example.com", "example.com/en/7", "allow")] * 2
    assert [(r.host, r.path) for r in found if r.page_id == 1] == [("", "")]
    assert urls.judge(df.limit(0)).count() == 0


def test_hard_vectors(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, one, 1), (2, one, 1), (2, one, 1), (3, one, None), (None, one, 1), (4, None, 1), (5, [0.0] * 4, 1), (6, [float("nan"), 1.0, 0.0, 0.0], 1), (7, [None, 1.0, 0.0, 0.0], 1), (8, [2.0, 0.0, 0.0, 0.0], 1), (9, one, 2), (10, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(c) for c in ("n_links", "kept", "component_id", "cell", "tile", "a.b")})
    found = neardup_vectors.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()
    by = {r.vec_id: r for r in found}
    assert len(found) == len(rows) and by[1].component_id == by[8].component_id == 1 and by[9].n_links == by[3].n_links == by[5].n_links == by[6].n_links == by[7].n_links == 0
    assert neardup_vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_and_sql_agree(spark, name):
    same(duck(), queries.QUERIES[name](spark, DATA), queries.ORACLES[name])


def test_licences(spark):
    from lectern.llm.license_texts import TEMPLATES

    mit = TEMPLATES[0][1]
    rows = docs_of(spark, [(1, "x\nReleased under the MIT license\ny", "a"), (2, mit.replace("free of charge", "gratis"), "a"), (3, "about the license of the house", "a"), (4, "RELEASED under  the M.I.T. License", "a")])
    found = {r.doc_id: (r.license, r.scope) for r in licenses.scan(rows).collect()}
    assert found == {1: ("MIT", "line"), 2: ("MIT", "line"), 3: (None, None), 4: (None, None)}
    for name, text in TEMPLATES:
        assert any(a in common_words(text) for a in licenses.anchors(TEMPLATES, licenses.THRESHOLD)), name


def test_licences_of_several_paragraphs_and_within_lines(spark):
    import duckdb

    from lectern.llm.license_texts import TEMPLATES

    def parts(name):
        w = max((t for n, t in TEMPLATES if n == name), key=len).split()
        return "\n\n".join(" ".join(w[k * len(w) // 3 : (k + 1) * len(w) // 3]) for k in range(3))

    prose = "\n\n".join(f"Paragraph {i} tells of house {i} and of tree {i * 7}." for i in range(30))
    rows = [(i, f"{prose}\n\n{parts(n)}\n\n{prose}") for i, n in enumerate(("MIT", "BSD-3-Clause", "Zlib", "Apache-2.0", "MPL-2.0"))]
    rows += [(10, "Copyright 2024 Acme. " + parts("MIT").replace("\n\n", " ") + " And so on it goes, for a long while after."), (11, "Copyright 2024 Acme Ltd. Released under the MIT License."), (12, prose), (13, None), (14, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert found == {0: "MIT", 1: "BSD-3-Clause", 2: "Zlib", 3: "Apache-2.0", 4: "MPL-2.0", 10: "MIT", 11: "MIT", 12: None, 13: None, 14: None}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    same(con, licenses.scan(df), licenses.oracle())


def common_words(text):
    import re

    return set(re.findall("[a-z0-9]+", text.lower()))


def jaccard_sets(text):
    """SpotSigs by loops."""
    import re

    words = re.sub(r"[^\w]|_", " ", text.lower()).split()
    spots, anchor = [], ""
    for w in words:
        if w in spotsigs.ANCHORS:
            anchor = w
        else:
            spots.append((anchor, w))
            anchor = ""
    if len(spots) == 1:
        a, w = spots[0]
        return {hashlib.md5((f"{a}~{w}" if a else w).encode()).hexdigest()[:8]} if not a or len(spots) == 1 else set()
    pairs = [(a, w, x) for (a, w), (_, x) in zip(spots, spots[1:], strict=False)]
    some = [p for p in pairs if p[0]] or pairs
    return {hashlib.md5((f"{a}~{w} {x}" if a else f"{w} {x}").encode()).hexdigest()[:8] for a, w, x in some}


def test_spotsigs_classes(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas()
    extra = [(10_000 + i, " ".join(t.split()[:-2])) for i, t in zip(rows.doc_id[:30], rows.text[:30], strict=True)]
    every = list(zip(rows.doc_id.tolist(), rows.text.tolist(), strict=True)) + extra
    sets = {i: jaccard_sets(t) for i, t in every}
    forest = common.Forest()
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if (not a and not b) or (a or b) and round(len(a & b) / max(1, len(a | b)), 6) >= 0.8:
                forest.join(i, j)
    spark.createDataFrame(every, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op2_spotsigs_classes"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: forest.find(i) for i in ids}


def test_spotsigs_buckets(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    assert sorted(spotsigs.compared(rows, 1).collect()) == sorted(spotsigs.compared(rows, 37).collect())


def brute_substrings(rows, window):
    first = {}
    cut = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in cut:
        for s in range(len(w) - window + 1 if d is not None else 0):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in cut:
        gone = set()
        for s in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[s : s + window])] < d:
                gone |= set(range(s, s + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "seed", "batches"), [(50, 1, 2), (12, 2, 3), (5, 3, 1)])
def test_substrings(spark, window, seed, batches):
    random.seed(seed)
    base = [[random.choice("abcdefgh ijk lmno pq".split()) for _ in range(random.randint(0, 120))] for _ in range(6)]
    rows = []
    for i in range(50):
        w = list(random.choice(base))
        for _ in range(random.randint(0, 3)):
            if w:
                w[random.randrange(len(w))] = random.choice("xyz")
        if random.random() < 0.15:
            w = random.choice([["z"], ["x", "y"]]) * random.randint(0, 100)
        if random.random() > 0.8:
            w = w[:30] + list(random.choice(base)) + w[30:]
        rows.append((random.choice([i, i, i, 3, None]), random.choice([" ", "\n", "\t "]).join(w) if random.random() > 0.05 else None))
    found = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), window, batches)
    assert sorted(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str) == brute_substrings(rows, window)


def test_substrings_long_monotonous(spark):
    rows = [(1, "x " * 70_000), (2, "a b " * 200 + "x " * 60), (3, "b a " * 300)]
    found = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in found.collect()} == {1: 0, 2: 60, 3: 600}


def test_substrings_in_batches_that_come_later(spark, tmp_path):
    random.seed(12)
    base = [[random.choice("abcdefgh ijk lmno pq".split()) for _ in range(random.randint(0, 90))] for _ in range(5)]
    rows = [(i, " ".join(random.choice(base)[random.randint(0, 9) :] + random.choice(base))) for i in range(60)]
    want = {r[0]: r for r in brute_substrings(rows, 12)}
    random.shuffle(rows)
    past = []
    for part in (rows[:25], rows[25:40], rows[40:50], rows[50:]):
        index = substrings.FingerprintIndex(spark, str(tmp_path / "index"), buckets=4)
        assert len(index.runs) <= index.fanout
        found = substrings.dedup_batch(spark.createDataFrame(part, "doc_id long, text string"), index, spark.createDataFrame(past, "doc_id long, text string"), 12)
        got = sorted(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept").collect()))
        past += part
        assert got == sorted(r for r in brute_substrings(past, 12) if r[0] in {i for i, _ in part})
    assert index.made > 4 and want


def test_index_side_has_no_exchange(spark, tmp_path):
    index = substrings.FingerprintIndex(spark, str(tmp_path / "index"), buckets=4)
    for k in range(2):
        index.add(substrings.postings(substrings._keyed(spark.createDataFrame([(k, " ".join(map(str, range(200 + 40 * k))))], "doc_id long, text string"))))
    plan = index.looked_up(index.runs.pop())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_substrings_of_rows_that_repeat_a_doc_id(spark):
    a, b = " ".join(f"a{i}" for i in range(201)), " ".join(f"b{i}" for i in range(201))
    rows = [(1, a), (2, a), (2, b), (2, "one two"), (3, b)]
    found = sorted(map(tuple, substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed").collect()))
    assert found == [(1, 201, 0), (2, 2, 0), (2, 201, 0), (2, 201, 201), (3, 201, 201)]


def test_words_of_one_polynomial_digest_differ(spark):
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    words = ["".join("ab"[x ^ k] for x in bits) for k in (0, 1)]
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{words[0]} {rest}"), (2, f"{words[1]} {rest}"), (3, "a\0 " + rest), (4, "a " + rest), (5, "a " + rest)]
    found = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in found.collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 50}


def test_substrings_keeps_columns_of_any_name(spark):
    names = ["edges", "key__", "twin__", "cuts__", "twin", "row", "found", "at", "f", "its_id", "a.b"]
    rows = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    found = substrings.dedup_substrings(rows)
    assert found.columns == [*rows.columns, "kept", "n_words", "n_removed"]
    assert all([r[n] for n in names] == names for r in found.collect())


def simhash_of(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash(spark):
    random.seed(4)
    base = [" ".join(random.choice("red blue green tall house tree river".split()) + str(random.randint(0, 30)) for _ in range(90)) for _ in range(5)]
    rows = []
    for i in range(120):
        w = random.choice(base).split()
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = "new"
        rows.append((i, random.choice([" ", "\n"]).join(w).title() if i % 9 else [None, "", "one two", "One Two", "x"][i // 9 % 5]))
    forest, codes = common.Forest(), {i: simhash_of(t) for i, t in rows}
    for i in codes:
        for j in codes:
            if (codes[i] ^ codes[j]).bit_count() <= 4:
                forest.join(i, j)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert found == {i: (codes[i], forest.find(i)) for i in codes}
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted({forest.find(i) for i in codes})


def test_golay_keys_lose_no_link():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y ^= 1 << int(b)
        keys = []
        for v in (x, y):
            parts = [np.array([v >> low & (1 << n) - 1], np.uint32) for low, n in simhash.SEGMENTS]
            near = [simhash.golay_keys(p, n)[0] for p, (_, n) in zip(parts, simhash.SEGMENTS, strict=True)]
            home = {(s, int(p[0])) for s, p in enumerate(parts)} | {(s, t, int(near[s][0]), int(near[t][0])) for s in range(3) for t in range(s + 1, 3)}
            every = home | {(s, t, int(a), int(b)) for s in range(3) for t in range(s + 1, 3) for a in near[s] for b in near[t] if a >= 0 and b >= 0}
            keys.append((home, every))
        assert keys[0][0] & keys[1][1]


def test_dense_links_are_a_forest():
    fp = np.array([0b1, 0b11, 0b111, 1 << 40, (1 << 40) | 1, 0], np.uint64)
    assert len(simhash.linked(fp, 1)) == len(fp) - 1
    assert len(simhash.linked(np.array([0, (1 << 10) - 1, ((1 << 10) - 1) << 40], np.uint64), 4)) == 0


def test_components(spark):
    random.seed(6)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)]
    forest = common.Forest()
    for a, b in edges:
        forest.join(a, b)
    found = common.components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long").repartition(5))
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in found.collect()} == {x: forest.find(x) for x in nodes}


def test_packing_covers_every_id(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    slow = Tokenizer.from_file(path)
    texts = [None, "", "It'S <|endoftext|> don'T x<|startoftext|>y", "日本語 テスト", "a.b! c? " * 900, "İI Σς ß", "word " * 5000, "naïve\x1ccafé\xa0½", "0123 | & %% ..."]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(3, "again")]
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(np.array([*slow.encode(t or "", add_special_tokens=False).ids, 2], np.uint32))
    for length in (64, 4096):
        found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, length).collect()
        by_doc, by_sequence = {}, {}
        for r in found:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_sequence.setdefault(r.sequence_id, []).append(r)
        assert set(by_doc) == set(want)
        for i, pieces in by_doc.items():
            if len(want[i]) == 1:
                at = 0
                for r in sorted(pieces, key=lambda r: r.start):
                    assert r.start == at and r.doc_tokens == len(want[i][0])
                    assert r.ids_crc32 == zlib.crc32(want[i][0][r.start : r.start + r.length].tobytes())
                    at += r.length
                assert at == len(want[i][0])
        padding = 0
        for pieces in by_sequence.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= length
            padding += 0 if at & (at - 1) == 0 else length - at
        assert padding <= 0.06 * sum(r.length for r in found)


def test_ids_are_the_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    slow, random_ = Tokenizer.from_file(path), random.Random(13)
    with open(path, encoding="utf-8") as f:
        fast = packing.WordTokenizer(f.read(), cached=300)
    alphabet = "aabcdeeXYZ019'.,!?-|<>~éÉßÿŁłŒµªº²¼×÷¡¿ǅȺİıſΣς\u00ad\u0301\u00a0\x1c\x85日😀" + "  \n"
    texts = ["".join(random_.choice(alphabet[: random_.choice([12, 30, len(alphabet)])] + " ") for _ in range(random_.randint(0, 400))) for _ in range(150)]
    texts += ["", "don't I'LL we're 's''s 'Tis", "x<|endoftext|>y <| |>", "a" * 3000, "é" * 700 + " a"]
    want = [np.array([*slow.encode(t, add_special_tokens=False).ids, 2], np.uint32).tobytes() for t in texts]
    assert list(fast.each([t.encode() for t in texts])) == want
    long = (" ".join(texts[:150]) + " ") * 60
    pieces = list(packing.split_at_spaces(long.encode(), 1000))
    assert b"".join(pieces) == long.encode() and max(map(len, pieces)) < 2000
    assert list(fast.each([long.encode()]))[0] == np.array([*slow.encode(long, add_special_tokens=False).ids, 2], np.uint32).tobytes()


def test_best_cuts_are_best():
    random.seed(7)
    for _ in range(60):
        at = sorted({0, *(random.randint(1, 300) for _ in range(40)), *range(0, 300, 20)})
        penalty = [0] + [random.choice([0, 4, 24]) for _ in at[1:]]
        cuts = packing.best_cuts(at, penalty, 64, False)
        cost = {0: 0}
        for p, extra in list(zip(at, penalty, strict=True))[1:]:
            cost[p] = min(cost[q] + 64 - (p - q) for q in cost if p - q <= 64) + packing.WINDOW_COST + extra
        total = sum(64 - (b - a) + packing.WINDOW_COST + penalty[at.index(b)] for a, b in zip([0, *cuts], cuts, strict=False))
        assert total == cost[cuts[-1]] == min(cost[p] for p in at if p > at[-1] - 64)


def test_language(spark):
    words = {"en": "the house with green windows", "fr": "la maison avec des fenêtres vertes", "de": "das große haus mit grünen fenstern"}
    random.seed(8)
    rows = [(i, " ".join(random.choice(words[l].split()) for _ in range(30)), l) for i in range(150) for l in [random.choice(sorted(words))]]
    rows += [(900, None, "en"), (901, "123 …", "fr"), (902, "", None), (903, "zzz qqq", None), (904, words["fr"], None)]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[i].lang_pred == l for i, _, l in rows[:150])
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and found[904].lang_pred == "fr" and found[903].lang_pred in words
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_never_misses_a_gram():
    grams = np.unique(language.grams(["some words of a language"])[0])
    model = language.Filter.of(["a", "b"], [grams, grams[:0]])
    rate, n = model.rates(["some words", "", "ß"])
    assert rate[0, 0] == 1 and rate[0, 1] <= 0.01 and n.tolist() == [9, 0, 1]


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(rows).where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert found >= 0.97


def test_targets(spark):
    random.seed(9)
    for n in (1, 2, 5, 12):
        sizes = {random.choice([f"s{i}", "Ä" * i + "z", None if i == 0 else f"t{i}"]): random.choice([0, 3, 50, 1000]) for i in range(n)}
        order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        rest, left, want = 1.5 * sum(sizes.values()), set(sizes), {}
        while left:
            w = sum(weight[s] for s in left)
            over = [s for s in left if rest * weight[s] / w > 2 * sizes[s] + 1e-9]
            if not over:
                want |= {s: rest * weight[s] / w for s in left}
                break
            for s in over:
                want[s] = 2.0 * sizes[s]
                left.discard(s)
            rest -= sum(want[s] for s in over)
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        assert {r.source: r.target for r in mixing.targets(df).collect()} == pytest.approx(want, abs=1e-6)


def test_mixing(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    found = mixing.mix(rows, block=16).join(rows.select("doc_id", "source"), "doc_id").toPandas()
    by = found.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (by.taken - by.target).abs().max() <= 1 and (found.taken <= 2 * found["size"]).all()
    again = mixing.mix(rows.repartition(7), block=16).toPandas()
    assert dict(zip(found.doc_id, found.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    out = mixing.mixed_documents(rows, block=16).toPandas()
    words = out.text.map(lambda t: len(t.encode().split())).groupby(out.doc_id).sum()
    assert words.to_dict() == {i: t for i, t in zip(found.doc_id, found.taken, strict=True) if t}


def words_taken(spark, rows, block):
    """doc_id and taken by loops, from the plan and the permutation alone."""
    sizes = {}
    for i, s, n in rows:
        sizes.setdefault(s, []).append((i, n))
    frame = spark.createDataFrame([(i, s, n, i) for i, s, n in rows], "doc_id long, source string, size long, rid long")
    planned = mixing.plan(frame, block).collect()
    order = {r.doc_id: r.begin for r in mixing.numbered(frame.join(spark.createDataFrame([(p.sid, p.source) for p in planned], "sid long, source string"), "source")).collect()}
    taken = dict.fromkeys((i for i, _, _ in rows), 0)
    for p in planned:
        stream = [i for i, n in sorted(sizes[p.source], key=lambda x: order[x[0]]) for _ in range(n)]
        assert len(stream) == p.source_size
        slots = spark.range(p.blocks).select(mixing._permuted(F.col("id"), F.lit(p.blocks), F.xxhash64(F.lit(mixing.SEED), F.lit(p.sid).cast("long"))).alias("at"), "id").orderBy("id").collect()
        todo = p.words
        while todo > 0:
            for r in slots:
                for i in stream[r["at"] * block : (r["at"] + 1) * block][: max(0, todo)]:
                    taken[i] += 1
                    todo -= 1
    return taken


def test_taken_by_loops(spark):
    random.seed(14)
    rows = [(i, random.choice("abc"), random.randint(0, 40)) for i in range(60)]
    docs = spark.createDataFrame([(i, s, " ".join("w" * n)) for i, s, n in rows], "doc_id long, source string, text string")
    assert {r.doc_id: r.taken for r in mixing.mix(docs, block=8).collect()} == words_taken(spark, rows, 8)


def test_draws(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 50)
    planned = mixing.plan(spark.createDataFrame([("a", 40_000), ("b", 9000)], "source string, size long"), block=8)
    found = mixing.draws(planned).toPandas()
    shards = -(-int(found.n.sum()) // 50)
    assert found.shard.max() < shards and found.groupby("sid").size().max() > 0.9 * shards
    for _, rows in found.groupby("sid"):
        rows = rows.sort_values("shard")
        assert rows.begin.tolist() == [0, *rows.n.cumsum().tolist()[:-1]]
        mean = rows.n.sum() / shards
        # A multinomial count varies about as much as its mean.
        assert 0.4 * mean < rows.n.var() < 2 * mean


def test_mixed_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(i, "s", "a b c") for i in range(20)], "doc_id long, source string, text string").withColumns({n: F.lit(777) for n in ("size", "rid", "row", "place", "epoch", "sid", "a.b")})
    found = mixing.mixed_documents(rows).collect()
    assert found and all(r[n] == 777 for r in found for n in rows.columns[3:])
    found = mixing.mixed_shards(rows).collect()
    assert found and all(r["size"] == r["rid"] == 777 and r["place"] != 777 for r in found)


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select("id", mixing._permuted(F.col("id"), F.lit(n), F.lit(5).cast("long")).alias("p")).withColumn("back", mixing._permuted(F.col("p"), F.lit(n), F.lit(5).cast("long"), inverse=True)).collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    assert [r.p for r in rows] != list(range(100))


def test_slots(spark):
    sizes = spark.createDataFrame([(str(s), 37 * s + 5) for s in range(1, 6)], "source string, size long")
    planned = mixing.plan(sizes, block=8)
    found = mixing.slots(planned, block=8).toPandas()
    want = {r.sid: r.words for r in planned.collect()}
    assert found.groupby("sid").words.sum().to_dict() == want
    assert found.groupby(["sid", "epoch", "index"]).size().max() == 1 and found.groupby(["sid", "index"]).size().max() <= 2


def test_urls(spark):
    rows = [(1, "http://a.example.com/en/1", ""), (2, "http://X.EXAMPLE.com/en/7?q", ""), (3, "https://notexample.net/de/8", ""), (4, "https://example.net/de/81#x", ""), (5, None, None), (6, "mailto:x", ""), (7, "http://org/es/", ""), (8, "ftp://b.org?x/es/", ""), (8, "x://y://z/a b", ""), (None, "http://q.com/EN/", "")]
    found = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    assert found == sorted([(1, "a.example.com", "/en/1", "com/en/", "block"), (2, "x.example.com", "/en/7", "example.com/en/7", "allow"), (3, "notexample.net", "/de/8", "net/de/", "allow"), (4, "example.net", "/de/81", "example.net/de/8", "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "org", "/es/", "org/es/", "block"), (8, "b.org", "", None, "allow"), (8, "y:", "//z/a b", None, "allow"), (None, "q.com", "/EN/", None, "allow")], key=str)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_distrust_travels_back_along_links(spark):
    pages = [(1, "http://bad.org/es/1", ""), (2, "http://feeds-bad.test/x", "<a href='http://bad.org/z'>"), (3, "http://good.net/de/1", "<a href=\"http://friend.test/\">"), (4, "http://friend.test/y", ""), (5, "http://alone.test/y", "")]
    found = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_urls_sql_with_links(spark):
    import duckdb

    random.seed(10)
    hosts = [f"h{k}.{t}" for k in range(6) for t in ("com", "net", "org")]
    pages = [(i, f"http://{random.choice(hosts)}/{random.choice(['en', 'de', 'es', 'x'])}/{i}", " ".join(f'<a href="http://{random.choice(hosts)}/">' for _ in range(random.randint(0, 4)))) for i in range(300)]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", pages)
    same(con, urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")), urls.oracle())


def test_archive(spark, tmp_path):
    rows = [(1, "http://a/\r\nx: y", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "u", ""), (4, "u", ""), (5, "u", "z" * 100_000), (None, "n", "<p>é</p>"), (None, "n", "only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = archive.archived(df, str(tmp_path / "w")).collect()
    b32 = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(1, 9, b32("<p>é</p>"), "revisit", 2), (2, 9, b32("<p>é</p>"), "response", None), (3, 0, b32(""), "revisit", 4), (4, 0, b32(""), "response", None), (4, 0, b32(""), "response", None), (5, 100_000, b32("z" * 100_000), "response", None), (None, 9, b32("<p>é</p>"), "revisit", 2), (None, 4, b32("only"), "response", None)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    bodies = archive.records(spark, str(tmp_path / "w")).collect()
    assert sorted(bytes(r.payload) for r in bodies) == sorted((h or "").encode() for _, _, h in rows)
    for r in bodies:
        head, _, block = bytes(r.warc).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and bytes(r.warc).endswith(b"\r\n\r\n")
        assert int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"]) == len(block) - 4
    stored = [(r.digest, bytes(r.payload)) for r in archive.payloads(spark, str(tmp_path / "w")).collect()]
    assert len(stored) == len({d for d, _ in stored}) == 4
    archive.store(df, str(tmp_path / "x"))
    name = next(x for x in common.entries(spark, str(tmp_path / "x")) if x.startswith("payloads"))
    spark.createDataFrame([(d, p + b"!") for d, p in stored], archive.PAYLOADS).write.insertInto(common.bucketed(spark, str(tmp_path / "x" / name), archive.PAYLOADS, "digest", 4), overwrite=True)
    with pytest.raises(Exception, match="damaged"):
        archive.summary(spark, str(tmp_path / "x")).collect()
    archive.discard(spark, str(tmp_path / "x"))
    assert common.entries(spark, str(tmp_path / "x")) == []
    small = {r.page_id: r.record_type for r in archive.archived(df.where("page_id < 3"), str(tmp_path / "v"), least_bytes=10).collect()}
    assert small == {1: "response", 2: "response"}
    assert archive.archived(df.limit(0), str(tmp_path / "u")).count() == 0


def test_archive_of_many_equal_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "HEAVY", 20)
    monkeypatch.setattr(common, "HEAVY", 20)
    rows = [(i, f"http://a/{i}", "" if i % 3 else ("x" * i if i % 2 else "error")) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("d"), "bytes": F.lit(1), "salt": F.lit(2)})
    found = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in archive.archived(df, str(tmp_path / "w")).collect()}
    last = {h: i for i, _, h in rows}
    assert found == {i: (len(h), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, _, h in rows}
    assert {(r.page_id, bytes(r.payload).decode()) for r in archive.records(spark, str(tmp_path / "w")).collect()} == {(i, h) for i, _, h in rows}


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 10)
    left = spark.createDataFrame([(i, i % 7 if i < 100 else 99) for i in range(300)], "i long, k long")
    right = spark.createDataFrame([(k, f"r{k}") for k in (0, 1, 2, 99)], "k long, name string")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        assert sorted(map(tuple, common.spread_join(left, right, "k", counts, how).select("i", "k", "name").collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).select("i", "k", "name").collect()), key=str)


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 10)
    edges = [(1000, i) for i in range(200)] + [(i, i + 2000) for i in range(50)] + [(5000, 5001)]
    for forests in (True, False):
        found = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), forests).collect()}
        assert found == {x: 5000 if x >= 5000 else 0 for e in edges for x in e}


def test_more_than_64_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"{letters[k % 26]}{letters[k // 26]}{letters[(k * 7) % 26]}q" for k in range(70)]
    rows = [(20 * k + j, " ".join([words[k]] * 8), f"l{k:02d}") for k in range(70) for j in range(8)]
    found = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == r.lang for r in found)


def test_filter_grows_with_its_grams():
    rng = np.random.default_rng(3)
    many = np.unique(rng.integers(0, 1 << 63, 400_000).astype(np.uint64))
    model = language.Filter.of(["a", "b"], [many, many[:10]])
    assert model.masks.shape[1] * language.FULL >= language.PROBES * len(many) and model.false_hit[0] < 0.05
    other = rng.integers(0, 1 << 63, 100_000).astype(np.uint64)
    hit = np.full(len(other), np.uint64(3))
    for s in language._slots(other, model.masks.shape[1]):
        hit &= model.masks[0, s]
    assert abs((hit & np.uint64(1)).mean() - model.false_hit[0]) < 0.01


def test_vectors(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(160):
        v = base[i % 12] + rng.normal(size=16) * rng.choice([0, 0.1, 0.25, 1])
        rows.append((int(rng.integers(0, 150)), [float(np.float32(x)) for x in v], int(rng.integers(0, 3)) if i % 10 else None))
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [1.0] * 15 + [float("nan")], 1), (504, [1.0] * 15 + [None], 1), (505, [1.0] * 15 + [float("inf")], 1), (506, [1.0] * 8, 1), (507, [2.0] * 8, 1), (508, rows[1][1], rows[1][2]), (None, rows[1][1], rows[1][2])]
    valid = [k for k, (_, v, l) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    forest, links = common.Forest(), dict.fromkeys(range(len(rows)), 0)
    for a in valid:
        for b in valid:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if a < b and rows[a][2] == rows[b][2] and len(x) == len(y) and (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= 0.93:
                links[a] += 1
                links[b] += 1
                forest.join(a, b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[forest.find(k)] = min(least.get(forest.find(k), i), i)
    want = [(i, links[k], least.get(forest.find(k)), i is not None and i == least.get(forest.find(k))) for k, (i, _, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for tile, sparse in ((2048, 4), (5, 0), (5, 1000), (40, 0.5)):
        assert sorted(map(tuple, neardup_vectors.near_duplicates(df, tile=tile, sparse=sparse).collect()), key=str) == sorted(want, key=str)
    assert neardup_vectors.near_duplicates(df.limit(0)).count() == 0
    assert neardup_vectors.near_duplicates(df.where("label is null")).count() == 16


def test_pipeline(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    bad = rows.limit(2).selectExpr("doc_id + 100000 as doc_id", "cast(null as string) as text", "lang", "source", "n_chars")
    docs = corpus_pipeline.STAGES[0][1](spark, rows.union(bad), DATA)
    assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(r.doc_id for r in rows.select("doc_id").collect())
    one = corpus_pipeline.STAGES[1][1](spark, docs, DATA)
    assert sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted(r.doc_id for r in simhash.near_duplicates(docs).where("doc_id = component_id").collect())
    cut = corpus_pipeline.STAGES[2][1](spark, one, DATA).toPandas()
    source = one.toPandas()
    want = {i: (n, k) for i, _, n, k in brute_substrings(list(zip(source.doc_id, source.text, strict=True)), 50)}
    for i, t in zip(cut.doc_id, cut.text, strict=True):
        assert t == (want[i][1] if want[i][0] else source.set_index("doc_id").text[i])
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0 and plain(out.first()) is not None
