"""Byte-level BPE, periodic runs and collocations against libraries, brute force and hard rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lectern.llm import bytepairs, periodic, phrases, queries
from tests.llm.test_llm import docs_of, hard
from tests.oracle import DATA

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library(path=RANKS):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


ODD = [None, "", " ", "a", "It's  DON'T we'll\n\n \tx", "日本語テキスト😀👩‍👩‍👧 naïve   x\x1c\x85y", "a" * 5000, "=" * 3001 + " " * 777, "abcabcabd" * 400, "\x00\x01 ünï <|endoftext|>", "İſẞ ǅ ²³ ½ ٣٤", "0123456789" * 90, "ab" * 30, "x\r\n\r\ny  \n z "]


def scrambled(seed, n=60):
    r = random.Random(seed)
    return ["".join(r.choice("aeiourstlnABC é-'.,;  \n0１" if r.random() < 0.9 else "日😀ß́") for _ in range(r.choice([3, 40, 400]))) for _ in range(n)] + ["".join(r.choice("etaoinshrdlu") for _ in range(700))]


@pytest.mark.parametrize("most", [0, 40, bytepairs.KNOWN])
def test_ids_are_the_librarys(spark, most):
    texts, own = ODD + scrambled(1), library()
    rows = bytepairs.encode(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), RANKS, public_tokenizers.PATTERN, most).collect()
    for r in rows:
        want = own.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want and r.n_tokens == len(want), r.doc_id


def test_byte_bpe_query(spark, tmp_path):
    texts, own = ODD + scrambled(2), library()
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), f"{tmp_path}/documents.parquet")
    for r in queries.op11_byte_bpe(spark, str(tmp_path)).collect():
        want = own.encode_ordinary(texts[r.doc_id] or "")
        assert tuple(r)[1:] == (len(want), sha(" ".join(map(str, want))), sha(texts[r.doc_id] or ""))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op11_byte_bpe(spark, DATA).collect():
        assert (r.n_tokens, r.decoded_sha256) == (len(own.encode_ordinary(docs[r.doc_id])), sha(docs[r.doc_id]))


def test_ranks_are_checked(spark, tmp_path):
    every = [bytes([b]) for b in range(256)]

    def ranks(pieces):
        path = tmp_path / "ranks"
        path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate(pieces)))
        return str(path)

    path = ranks([*every, b"bc", b"abc", b"abcab", b"ab", b"ca", b"abab"])
    r = random.Random(9)
    texts = ["".join(r.choice("abc") for _ in range(n)) for n in (3, 9, 30, 60, 300) for _ in range(20)]
    rows = bytepairs.encode(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), path, public_tokenizers.PATTERN, 0).collect()
    assert all(x.ids == library(path).encode_ordinary(texts[x.doc_id]) for x in rows)
    with pytest.raises(ValueError, match="no rank"):
        bytepairs.Ranks(ranks(every[1:]))


def test_another_vocabulary(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own, texts = library(path), scrambled(3, 20)
    rows = bytepairs.encode(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), path, public_tokenizers.PATTERN, 10).collect()
    assert all(r.ids == own.encode_ordinary(texts[r.doc_id]) for r in rows)


def test_a_piece_that_merges_dont_give(spark, tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate([*(bytes([b]) for b in range(256)), b"xyz", b"ab", b"xyza"])))
    texts = ["xyz", "xyza", "xyzab xyz", "abxyz", "xyz" * 40]
    rows = bytepairs.encode(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), str(path), public_tokenizers.PATTERN, 0).collect()
    assert all(x.ids == library(path).encode_ordinary(texts[x.doc_id]) for x in rows) and {tuple(x.ids) for x in rows} >= {(256,), (258,)}


def test_tables_stay_out_of_plans(spark):
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(scrambled(4))])
    run = bytepairs.encode(docs, RANKS, public_tokenizers.PATTERN)._jdf.queryExecution()
    # Their entries are not spelt out in a plan's text, which the driver builds again and again, nor copied as a column for each row.
    assert len(run.executedPlan().toString()) < 1 << 20
    assert "tables_" not in run.optimizedPlan().toString()


def brute_runs(w):
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            part = w[s : s + length]
            if length >= max(6, 4 * q) and all(part[:-p] != part[p:] for p in range(1, q)):
                found.append((s, length, q))
    return sorted(found)


def test_runs_are_all_runs():
    r = random.Random(5)
    for _ in range(3000):
        w = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            unit = [r.randrange(4) for _ in range(r.randint(1, 7))]
            w += (unit * 9)[: r.randint(1, len(unit) * 9)]
            w += [r.randrange(5) for _ in range(r.randint(0, 4))]
        assert periodic.runs_of(w) == brute_runs(w)
    w = [r.randrange(2) for _ in range(3000)]
    assert periodic.runs_of(w) == brute_runs(w)


def edited(i, text):
    w = (text or "").encode().split()
    if i is None or not w:
        return w
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
    return w


def wanted(i, text):
    w = edited(i, text)
    runs = brute_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    left = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(left))


def test_periodic_query(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, r.choice([" ", "\n", " \t "]).join(r.choice("a b c the of river".split()) * r.choice([1, 1, 1, 7]) for _ in range(r.randint(0, 90)))) for i in range(300)]
    rows += [(None, "a " * 9), (7, None), (7, ""), (8, "x " * 5), (8, "x " * 6), (8, "x " * 6), (10**15, "é ü " * 50)]
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in rows], pa.int64()), "text": [x[1] for x in rows]}), f"{tmp_path}/documents.parquet")
    found = sorted(map(repr, map(tuple, queries.op12_periodic_runs(spark, str(tmp_path)).collect())))
    assert found == sorted(repr((i, *wanted(i, t))) for i, t in rows)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars < 4000")
    found = {x.doc_id: tuple(x)[1:] for x in periodic.digests(periodic.repeated(docs)).collect()}
    assert found == {x.doc_id: wanted(x.doc_id, x.text) for x in docs.collect()} and any(x[0] for x in found.values())


def test_a_long_run(spark):
    rows = docs_of(spark, [(1, "x y " * 60_000, "s"), (2, " ".join(map(str, range(50_000))) + " z" * 9, "s")])
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.runs(rows).collect()} == {1: [(0, 120_000, 2)], 2: [(50_000, 9, 1)]}


def brute_phrases(rows, least=10, best=2000):
    count, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    count.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = {}
        for p, a in candidates.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer.get(part, 0), a)
        kept = []
        for p, a in candidates.items():
            if 100 * longer.get(p, 0) >= 50 * a:
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:best])]
    return sorted(out)


def test_collocations(spark):
    r = random.Random(7)
    names = ["New York", "new york city", "of the house", "Éa ü", "x", "the", "a\x0bb", "tea"]
    rows = [(r.choice(["en", "en", None, "und", "fr"]), r.choice([" ", ", ", "\n", "  \t"]).join(r.choice(names) for _ in range(r.randint(0, 60)))) for _ in range(120)] + [("en", None), (None, ""), ("de", "one two")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"n": F.lit(1), "gram": F.lit("g"), "rank": F.lit(0), "a": F.lit("a")})
    want = brute_phrases(rows)
    assert sorted(map(tuple, phrases.collocations(df).collect())) == want and len(want) > 30
    assert sorted(map(tuple, phrases.collocations(df, best=4).collect())) == brute_phrases(rows, best=4)


@pytest.mark.parametrize("slots", [64, 1 << 25])
def test_phrases_are_counted_where_their_ends_are_frequent(spark, monkeypatch, slots):
    monkeypatch.setattr(phrases, "SLOTS", slots)
    r = random.Random(11)
    rows = [(r.choice(["en", "d\ne"]), " ".join(r.choice(["New", "york", "city", "of", f"rare{r.random()}"]) for _ in range(40)) + ", new york city") for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(df).collect())) == brute_phrases(rows)
    places, pairs = phrases.places(df, 3), spark.createDataFrame([("en", "new york"), ("en", "york city")], "lang string, gram string")
    found = phrases.hopeful(places, 3, phrases.marked(pairs, 2)).select("lang", phrases.phrase(1, 3).alias("gram")).distinct().collect()
    assert ("en", "new york city") in found and (slots == 64 or found == [("en", "new york city")])
    # What splits texts is read once: no filter computes it again.
    assert not re.search(r"Filter.*split\(", places._jdf.queryExecution().optimizedPlan().toString())


def test_scores_are_exact(spark, monkeypatch):
    big = 3_000_000_000_123
    counts = spark.createDataFrame([("en", "a", big + 7), ("en", "b", 3 * big + 1), ("en", "a b", big), ("en", "", 9 * big)], "lang string, gram string, f long")
    monkeypatch.setattr(phrases, "counted", lambda *_: counts)
    found = phrases.collocations(counts).collect()
    assert [(x.phrase, x.score) for x in found] == [("a b", 10**6 * big * big // ((big + 7) * (3 * big + 1)))]


@pytest.mark.parametrize("name", ["bytes", "runs", "phrases"])
def test_hard_and_empty_rows(spark, name):
    f = {"bytes": lambda d: bytepairs.encode(d, RANKS, public_tokenizers.PATTERN), "runs": periodic.runs, "phrases": phrases.collocations}[name]
    named = hard(spark).withColumns({c: F.lit(c) for c in ("ids", "n_tokens", "runs", "strongest", "collapsed", "w", "a.b")})
    found = f(named)
    assert found.count() == 12 or name == "phrases"
    assert name == "phrases" or set(named.columns) <= set(found.columns)
    assert f(docs_of(spark, [])).count() == 0
