"""Periodic runs of words: squares from a suffix automaton whose end-position sets are merged small into large, extended to runs.

A run is a stretch of words with smallest period q (words q apart are equal) and a length of at least max(LEAST, TIMES * q) that no
neighbouring word extends.  Documents are worked on one by one in Arrow batches; no text leaves its row.

In a run, each word but the first q has an equal one at most q before it.  Stretches whose words all come back within a (TIMES-1)th of the
stretch's length are all that can hold a run, and only these, with as many words before them, get an automaton: exact, and ordinary prose has
none.  Where a state's set of end positions is complete, neighbours in it that came together there and are no further apart than
1/(TIMES-1) of the state's length are occurrences of one word sequence that overlap: seeds, extended as far as words q apart are equal.  An
automaton takes about 500 bytes a word of its stretch.

Null texts count as empty; texts without words have no runs.  Repeated rows keep a row each, other columns stay but for those that the
result names.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.shipping import map_arrow
from lectern.llm.common import text_chunks, words

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def back(ids: np.ndarray) -> np.ndarray:
    """How far back each id occurred last; the length of ids if it didn't."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), len(ids), np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def stretches(far: np.ndarray, least: int = LEAST, times: int = TIMES, rounds: int = 64) -> list[tuple[int, int]]:
    """Stretches of positions that may follow the first period of a run, by how far back their words occurred last; more rounds leave fewer."""
    alive = far < len(far)
    for _ in range(rounds):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], alive.view(np.int8), [0]])))
        sizes = edges[1::2] - edges[::2]
        room = np.zeros(len(far), np.int64)
        room[alive] = np.repeat(sizes, sizes)
        left = alive & (far * (times - 1) <= room) & ((far > 1) | (room >= least - 1))
        if np.array_equal(left, alive):
            break
        alive = left
    edges = np.flatnonzero(np.diff(np.concatenate([[0], alive.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and own end position (-1: a copy) of the states of the suffix automaton of ids; state 0 is the empty sequence."""
    length, link, own, moves = [0], [-1], [-1], [{}]
    last = 0
    for at, c in enumerate(ids):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        own.append(at)
        moves.append({})
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] != length[p] + 1:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                own.append(-1)
                moves.append(dict(moves[q]))
                link[q] = copy
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                q = copy
            link[new] = q
        last = new
    return length, link, own


def seeds(ids: list[int], times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """End, length and distance of word sequences that end at `end` and next at `end` + distance, at most a (times-1)th of their length."""
    length, link, own = automaton(ids)
    parts: list[list[list[int]]] = [[[x]] if x >= 0 else [] for x in own]
    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        held = parts[v]
        ends = max(held, key=len)
        new = [x for p in held if p is not ends for x in p]
        if len(new) * 16 < len(ends):
            for x in new:
                insort(ends, x)
        elif new:
            ends += new
            ends.sort()
        most = length[v] // (times - 1)
        for x in new if most else ():
            k = bisect_left(ends, x)
            if k and x - ends[k - 1] <= most:
                yield ends[k - 1], length[v], x - ends[k - 1]
            if k + 1 < len(ends) and ends[k + 1] - x <= most:
                yield x, length[v], ends[k + 1] - x
        parts[v] = []
        if link[v]:
            parts[link[v]].append(ends)


def runs_of(ids: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """start, length and period of all runs, by start and period."""
    found: dict[int, list[tuple[int, int]]] = {}
    for a, b in stretches(back(np.array(ids, np.int64)), least, times):
        first = max(0, a - (b - a) // (times - 1))
        for end, size, q in seeds(ids[first:b], times):
            s, e = first + end - size + 1, first + end + q + 1
            known = found.setdefault(q, [])
            k = bisect_right(known, (s, len(ids)))
            if k and known[k - 1][1] >= e:
                continue
            while s and ids[s - 1] == ids[s - 1 + q]:
                s -= 1
            while e < len(ids) and ids[e] == ids[e - q]:
                e += 1
            insort(known, (s, e))
    return sorted((s, e - s, q) for q, known in found.items() for s, e in known if e - s >= max(least, times * q))


def collapsed(found: list[bytes], spans: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not spans:
        return found
    gone = np.zeros(len(found) + 1, np.int64)
    for s, n, q in spans:
        gone[s + q] += 1
        gone[s + n] -= 1
    return [w for w, g in zip(found, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with runs (by start and period), strongest (the run of most periods, the first of equal ones) and collapsed: the words that are left."""
    names = [n for n in docs.columns if n not in ("runs", "strongest", "collapsed")]
    at = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            spans, best, left = [], [], []
            for text in b.column(at):
                found = (text.as_py() or "").encode().split()
                seen: dict[bytes, int] = {}
                of = runs_of([seen.setdefault(w, len(seen)) for w in found], least, times)
                spans.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in of])
                k = min(range(len(of)), key=lambda i, of=of: (-Fraction(of[i][1], of[i][2]), of[i][0], of[i][2]), default=None)
                best.append(None if k is None else spans[-1][k])
                left.append(b" ".join(collapsed(found, of)).decode())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(left, pa.string())], [*b.schema.names, "runs", "strongest", "collapsed"])

    kept = docs.select(*(F.col(f"`{n}`").alias("text" if k == at else f"c{k}") for k, n in enumerate(names)))
    made = T.StructType.fromDDL(f"runs array<{RUN}>, strongest {RUN}, collapsed string")
    return map_arrow(kept, work, T.StructType([*kept.schema.fields, *made.fields])).toDF(*names, *made.names)


def repeated(docs: DataFrame) -> DataFrame:
    """docs with periods planted into the texts of a tenth of them, chosen by their id; the others, and rows without an id, as they are."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    rows = docs.select("doc_id", "text", words(F.col("text")).alias("w"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("chosen"))
    rows = rows.withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("w", lambda x, i: F.when(i >= F.col("a"), F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(x))
    return rows.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the strongest, and SHA-256 of all runs and of the words that are left."""
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    milli = F.expr("1000 * strongest.length div strongest.period")
    return runs(docs.select("doc_id", "text")).select("doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period", milli.alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
