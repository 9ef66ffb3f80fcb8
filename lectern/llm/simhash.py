"""Near-duplicates by SimHash, found through Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect
(23, 12) Golay code with zeros in front.  Every 23-bit word is within 3 bits of exactly one codeword.  A
segment has several keys: the indices of the codewords to which it and its one-bit neighbours decode
(at most 6).  Two fingerprints that differ in at most 4 bits have either a segment without any
difference, which then is itself a key, or two segments with exactly one difference each, whose decoded
indices meet: that of the one is among the keys of the other, in both segments.  So no link is lost, and
a pair of indices (24 bits) or a whole segment is selective enough to keep groups small.  Within a group
every link is verified by its Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.shipping import map_arrow
from lectern.llm.common import Forest, checkpoint, components, partitions, spread_join, text_chunks, utf8

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Lowest bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code.
GENERATOR = 0b110001110101


@cache
def _decoder() -> tuple[np.ndarray, list[np.ndarray]]:
    """The error pattern of each syndrome, and the syndromes of each byte of a word."""

    def remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        return x

    errors = np.zeros(2048, np.uint32)
    for n in range(4):
        for bits in combinations(range(23), n):
            e = sum(1 << b for b in bits)
            errors[remainder(e)] = e
    return errors, [np.array([remainder(v << s & 0x7FFFFF) for v in range(256)], np.uint16) for s in (0, 8, 16)]


def golay_index(x: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    errors, tables = _decoder()
    x = x.astype(np.uint32)
    syndrome = tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255]
    return (x ^ errors[syndrome]) >> 11


def golay_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """A row for each word: the distinct indices of it (first) and of its one-bit neighbours, -1 where there are no more."""
    near = np.stack([golay_index(x)] + [golay_index(x ^ np.uint32(1 << b)) for b in range(bits)], axis=1).astype(np.int64)
    home = near[:, :1]
    near = np.sort(near, axis=1)
    again = np.zeros(near.shape, bool)
    again[:, 1:] = near[:, 1:] == near[:, :-1]
    near[again | (near == home)] = -1
    near = -np.sort(-near, axis=1)
    return np.concatenate([home, near[:, :8]], axis=1)


def fingerprint_bits(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One SimHash for each run of hashes between two offsets; none: 0."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, offsets[full], axis=0, dtype=np.int32)
        over = 2 * votes > np.diff(offsets)[full][:, None]
        out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for b in text_chunks(batches):
        data, at = utf8(b.column("text"))
        data, hashes, counts = data.tobytes().lower(), [], [0]
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            parts = data[s:e].split()
            if len(parts) > SHINGLE:
                line = b" ".join(parts)
                ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                hashes += [digest(line[i:j], SEED) for i, j in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
            elif parts:
                hashes.append(digest(b" ".join(parts), SEED))
            counts.append(len(hashes))
        found = pa.array(fingerprint_bits(np.array(hashes, np.uint64), np.array(counts)).view(np.int64))
        rest = [c for c in b.schema.names if c not in ("doc_id", "text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), found, *map(b.column, rest)], ["doc_id", "fp", *rest])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp long: the SimHash of every whole text."""
    return map_arrow(docs.select("doc_id", "text"), _fingerprints, "doc_id long, fp long")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            fp = whole.column("fp").slice(at, 4096).to_numpy()
            u, keys, homes, owners = fp.view(np.uint64), [], [], []
            near = []
            for s, (low, n) in enumerate(SEGMENTS):
                part = (u >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.uint32)
                near.append(golay_keys(part, n))
                keys.append((s << 48) + part.astype(np.int64))
                homes.append(np.ones(len(fp), bool))
                owners.append(fp)
            for p, (s, t) in enumerate(combinations(range(3), 2)):
                a, b = near[s][:, :, None], near[t][:, None, :]
                key, real = (p + 3 << 48) + a * 4096 + b, (a >= 0) & (b >= 0)
                home = np.zeros(key.shape, bool)
                home[:, 0, 0] = True
                keys.append(key[real])
                homes.append(home[real])
                owners.append(np.broadcast_to(fp[:, None, None], key.shape)[real])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, owners, homes)], ["key", "fp", "home"])


def linked(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints; each is compared only with those not yet reached."""
    rest, found = np.unique(fp), []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= most
            new = rest[near]
            found += [(int(x), int(y)) for y in new]
            todo.extend(new)
            rest = rest[~near]
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; those of a key can lie in several batches."""
    forest, held = Forest(), [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

    def found(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        pairs, u = [], fp.view(np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(key)))
        number = np.repeat(np.arange(len(edge)), size)
        small = size <= 24
        for d in range(1, int(size[small].max()) if small.any() else 0):
            i = np.flatnonzero((number[d:] == number[:-d]) & small[number[d:]])
            i = i[(home[i] | home[i + d]) & (np.bitwise_count(u[i] ^ u[i + d]) <= DISTANCE)]
            pairs += zip(fp[i].tolist(), fp[i + d].tolist(), strict=True)
        for g in np.flatnonzero(~small):
            if home[edge[g] : edge[g] + size[g]].any():
                pairs += [(int(np.uint64(x).view(np.int64)), int(np.uint64(y).view(np.int64))) for x, y in linked(u[edge[g] : edge[g] + size[g]], DISTANCE)]
        pairs = [(x, y) for x, y in pairs if x != y and forest.join(x, y)]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for b in batches:
        rows = [np.concatenate([h, b.column(n).to_numpy(zero_copy_only=False)]) for h, n in zip(held, ("key", "fp", "home"), strict=True)]
        cut = int(np.searchsorted(rows[0], rows[0][-1], "left")) if len(rows[0]) else 0
        held = [r[cut:] for r in rows]
        if cut:
            yield found(*(r[:cut] for r in rows))
    yield found(*held)


def _components(marked: DataFrame) -> DataFrame:
    """fp, component_id, n (rows) of every fingerprint of marked (doc_id, fp)."""
    nodes = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    # Few rows become very many: they are dealt out before.
    keyed = map_arrow(nodes.select("fp").repartition(partitions(marked.sparkSession)), _keyed, "key long, fp long, home boolean")
    links = map_arrow(keyed.repartition("key").sortWithinPartitions("key"), _links, "a long, b long")
    found = nodes.join(components(links, forests=True).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    least = found.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = spread_join(found.select("fp", "component", F.col("n").alias("rows")), least.select("component", "component_id"), "component", least)
    return checkpoint(named.select("fp", "component_id", F.col("rows").alias("n")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp long, component_id of every row of docs (doc_id, text).

    Texts are lower-cased (A-Z), cut into words and shingles of 4 words, repeats included; a shorter text is one
    shingle, a null or empty text has fingerprint 0 and is linked like any other.  Fingerprints at 4
    or fewer differing bits are linked; component_id is the smallest doc_id reachable.  Equal
    fingerprints are one node, so groups of copies, however large, cost one row.  Repeated doc_ids keep
    their rows; a null doc_id is never a component_id unless its component has no other.  An empty
    table gives an empty one.
    """
    marked = checkpoint(fingerprints(docs))
    named = _components(marked)
    return spread_join(marked, named.select("fp", "component_id"), "fp", named).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, more columns) without near-duplicates: of each component the one with the smallest
    doc_id stays, of several the one with the smallest hash of its text, of identical ones any.

    A null doc_id comes after all others, a null or empty text is linked like any other; other columns pass through, whatever their
    names, and an empty table gives an empty one.
    """
    key, twin = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64("text")
    marked = checkpoint(map_arrow(docs.select("doc_id", "text", twin.alias("twin")), _fingerprints, "doc_id long, fp long, twin long"))
    named = _components(marked)
    met = spread_join(marked, named.select("fp", "component_id"), "fp", named)
    best = met.groupBy(F.coalesce("component_id", "fp")).agg(F.min(F.struct(key.alias("its_key"), F.col("twin").alias("its_twin"))).alias("best")).select("best.*")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(key.alias("key"), twin.alias("twin"), row.alias("row"))
    rows = rows.join(best.hint("shuffle_hash"), (F.col("key") == F.col("its_key")) & (F.col("twin") == F.col("its_twin")), "left_semi")
    # The join has dealt rows out by key and twin already, so this moves no text again.
    return rows.dropDuplicates(["key", "twin"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
