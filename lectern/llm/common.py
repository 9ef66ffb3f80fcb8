"""What the training-data operators share: words, shared folders, Arrow text chunks, components."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.folders import checkpoint, shared_dir
from lectern.functions.shipping import map_arrow

#: A word is a run of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a Python step holds at once, unless one document is longer.
CHUNK_BYTES = 1 << 20


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def bucketed(spark: SparkSession, path: str, columns: str, key: str, buckets: int) -> str:
    """The name of the table at path, bucketed and sorted by key, which joins by key without an exchange."""
    name = "lectern_" + hashlib.md5(path.encode()).hexdigest()
    spark.sql(f"create table if not exists {name} ({columns}) using parquet clustered by ({key}) sorted by ({key}) into {buckets} buckets location '{path}'")
    return name


#: A key with fewer rows than this is never heavy.
HEAVY = 10_000


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right, of which right has one row at most for each value of key.

    counts (key, n) has the rows of left for each key.  Keys that hold more than their share of a partition are at most twice as many as
    partitions: their rows of left stay where they are and meet a broadcast of right's.
    """
    spark = left.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(HEAVY, total // (2 * partitions(spark)))
    heavy = [(r[0],) for r in counts.where(F.col("n") > most).select(key).collect()]
    if not heavy:
        return left.join(right, key, how)
    keys = F.broadcast(spark.createDataFrame(heavy, right.select(key).schema))
    few = F.broadcast(right.join(keys, key, "left_semi"))
    return left.join(keys, key, "left_anti").join(right, key, how).unionByName(left.join(keys, key, "left_semi").join(few, key, how))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text, as an array; null gives an empty one."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES, -1), lambda x: x != "")


def n_words(c: Column) -> Column:
    """Number of words of a text."""
    s = F.coalesce(c, F.lit(""))
    parts = F.split(s, SPACES, -1)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece has about `most` bytes of the column at most, or one row."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield b.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, one after the other, and the offsets of each; null counts as empty."""
    a = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    if a.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the number of words before it (one more at the end)."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    first = solid & (~before | edge[:-1])
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    last = solid & (~after | edge[1:])
    count = np.concatenate([[0], np.cumsum(first)])
    return np.flatnonzero(first), np.flatnonzero(last) + 1, count[offsets]


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of pairs of numbers."""
    z = x * np.uint64(0x9E3779B97F4A7C15) + (y ^ y >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(29)
    return z


#: Bytes of a word that are kept as they are.
PLAIN = 15
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two numbers for each word: its bytes and length, or 128 bits of BLAKE2b of a word of more than PLAIN bytes."""
    size = ends - starts
    room = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(room, 8)
    codes = np.empty((len(starts), 2), np.uint64)
    codes[:, 0] = np.ascontiguousarray(eight[starts]).view(np.uint64)[:, 0] & _MASKS[np.minimum(size, 8)]
    codes[:, 1] = np.ascontiguousarray(eight[starts + 8]).view(np.uint64)[:, 0] & _MASKS[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > PLAIN)
    if len(long):
        raw = data.tobytes()
        found = b"".join(hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        codes[long] = np.frombuffer(found, np.uint64).reshape(-1, 2)
    return codes


class Forest:
    """Union-find over integers; the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for b in batches:
        found = [(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if forest.join(x, y)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])


def components(edges: DataFrame, forests: bool = False, most_rounds: int = 200) -> DataFrame:
    """node, component of every node of edges (a, b long): component is the smallest node reachable.

    Each task first keeps a spanning forest of its edges, which leaves the components as they are;
    large-star and small-star rounds then shrink what remains until nothing changes.  Every round is
    checkpointed; a hub's edges don't meet in one task.  Without edges the result is empty; null ends and loops are ignored.  forests: the
    edges are few or forests already, or no Python may run: this step is left out.
    """
    now = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = now if forests else map_arrow(now, _forest_edges, "a long, b long")
    now = checkpoint(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == mark or not state[0]:
            break
        mark = state
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        large = spread_join(both, low.select("a", F.least("a", "m").alias("m")), "a", low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low.select("a", "m"), "a", low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpoint(small.union(low.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError("the components haven't settled")
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))
