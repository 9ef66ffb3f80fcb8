"""Packs token streams into windows of fixed length by order-preserving dynamic programming.

The documents of a scan partition, in its order, are one stream.  Cuts may stand at document ends (free), sentence
ends (`SENTENCE`) and, inside sentences longer than `STRIDE` tokens, every `STRIDE` tokens (`TRUNCATED`).  The cost
of a window is its padding plus `WINDOW_COST` plus the penalty of the cut that ends it.  The best way to reach a cut from those at most one window before it is the head of a
monotone queue, so a cut costs constant time.  A window whose length is a power of two isn't padded, which what is left at a
partition's end makes use of.  A partition needs no other's rows, hence no
shuffle; blocks of the stream are packed as they come, and what follows a block's last good cut waits for the next.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lectern.functions.shipping import map_arrow
from lectern.llm.common import CHUNK_BYTES, text_chunks, utf8

LENGTH, END_ID = 4096, 2
SENTENCE, TRUNCATED, WINDOW_COST, STRIDE = 4, 24, 16, 64
#: Tokens of a block, and words whose ids a Python worker keeps (up to twice as many, 0.2 KB each); fewer cost time.
BLOCK, CACHED = 1 << 18, 300_000
END = END_ID.to_bytes(4, "little")
#: The end of the Latin characters of one or two bytes.
LATIN = 0x250
SPACE = re.compile(b"[\\x20\\x09-\\x0d]")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Merges:
    """Byte-pair encoding of many parts of words at a time.

    In each round the pair of neighbours that comes first among the merges, the leftmost of several, becomes one symbol in every part that has
    any; parts that have none are done.
    """

    def __init__(self, model: dict, letters: dict[int, int]) -> None:
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner, self.last = (np.array([vocabulary[chr(letters[b]) + end] for b in range(256)], np.int32) for end in ("", suffix))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.width = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.none = len(pairs)

    @classmethod
    def of(cls, model: dict, letters: dict[int, int]) -> Merges | None:
        """None if the model isn't plain byte-pair encoding with a symbol for every byte."""
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        suffix = model.get("end_of_word_suffix") or ""
        return cls(model, letters) if plain and model["merges"] and all(chr(c) + end in model["vocab"] for c in letters.values() for end in ("", suffix)) else None

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.order[i], self.none)

    def encode(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, which are the bytes one after the other, and each part's number of ids.  No part is empty."""
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
        symbol, ends = self.inner[data], np.cumsum(size) - 1
        symbol[ends] = self.last[data[ends]]
        rank = np.full(len(symbol), self.none, np.int32)
        rank[:-1] = self._rank(symbol[:-1], symbol[1:])
        rank[ends] = self.none
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            final = np.ones(len(owner), bool)
            np.not_equal(owner[1:], owner[:-1], out=final[:-1])
            starts = np.flatnonzero(np.concatenate([[True], final[:-1]]))
            best = np.minimum.reduceat(rank.astype(np.int64) << 32 | np.arange(len(rank)), starts)
            some = best < self.none << 32
            best = best[some]
            at, keep = best & 0xFFFFFFFF, np.repeat(some, np.diff(starts, append=len(owner)))
            if not some.all():
                done.append((owner[~keep], symbol[~keep]))
            symbol[at] = self.made[best >> 32]
            final[at] = final[at + 1]
            keep[at + 1] = False
            symbol, owner, rank, final, at = symbol[keep], owner[keep], rank[keep], final[keep], (np.cumsum(keep) - 1)[at]
            for k in (at, at[at > 0] - 1):
                k = k[~final[k]]
                rank[k] = self._rank(symbol[k], symbol[k + 1])
            rank[final] = self.none
        owner = np.concatenate([np.zeros(0, np.int32), *(d[0] for d in done)])
        ids = np.concatenate([np.zeros(0, np.int32), *(d[1] for d in done)])[np.argsort(owner, kind="stable")]
        return ids.astype(np.uint32), np.bincount(owner, minlength=len(size))


#: Kinds of characters.
GAP, LETTER, NUMBER, OTHER, STRANGE = range(5)


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """The kind and the lower case of each character up to the end of the Latin ones, and of one more that stands for the rest.

    Strange are those that normalisation changes in other ways, and the apostrophe, which the pattern treats by what follows.
    """
    kind, low = np.full(LATIN + 1, STRANGE, np.uint8), np.arange(LATIN + 1)
    for c in [*range(0x21, 0x7F), *range(0xA1, LATIN)]:
        x = chr(c)
        if unicodedata.normalize("NFC", x) == x and len(x.lower()) == 1 and ord(x.lower()) < LATIN and x != "'":
            kind[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(x)[0], OTHER)
            low[c] = ord(x.lower())
    kind[0xAD], kind[0x20] = STRANGE, GAP
    return kind, low


class WordTokenizer:
    """Ids of texts by a tokenizer whose pieces never cross white space; words are encoded once and kept.

    The words that a batch of texts has and that aren't kept are encoded together: those of plain Latin characters are lower-cased, split
    where the file's pattern does and merged here, part by part; any other word goes through the file's own tokenizer, which is slower.
    What is kept has two halves: a full newer one becomes the older, from which words in use come back.
    """

    #: The pattern that is split by here.
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, json_text: str, cached: int = CACHED) -> None:
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(json_text)
        vocabulary = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.removesuffix("</w>").rstrip("\"')]»”’").endswith((".", "!", "?"))
        told = json.loads(json_text)
        steps = [x.get("type") for x in (told["normalizer"] or {}).get("normalizers", [])]
        split = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        known = steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in split] == ["Split", "ByteLevel"] and split[0]["behavior"] == "Removed" and split[0]["invert"] and split[0]["pattern"].get("Regex") == self.PATTERN
        # A byte-level model names each byte by a printable character: itself, or those from 256 on in order.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.merges = Merges.of(told["model"], letters) if known else None
        self.most = cached
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _slowly(self, words: list[bytes]) -> None:
        for word in words:
            self.words[word] = np.array(self.encoder.encode(word.decode(errors="replace"), add_special_tokens=False).ids, np.uint32).tobytes()

    def _encode(self, words: list[bytes]) -> None:
        """Keeps the ids of the words, none of which is kept."""
        if not self.merges or not words:
            self._slowly(words)
            return
        kinds, lows = _characters()
        text = np.frombuffer(b" ".join(words).decode(errors="replace").encode("utf-32-le"), np.uint32)
        text = np.minimum(text, LATIN)
        kind = kinds[text]
        word = np.cumsum(kind == GAP)
        odd = np.zeros(len(words), bool)
        odd[word[kind == STRANGE]] = True
        odd[word[1:][(text[1:] == ord("|")) & (text[:-1] == ord("<"))]] = True
        good = (kind != GAP) & ~odd[word]
        text, kind, word = lows[text[good]].astype(np.uint16), kind[good], word[good]
        first = np.ones(len(text), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (word[1:] != word[:-1]) | (kind[1:] == NUMBER)
        starts, width = np.flatnonzero(first), 1 + (text > 127)
        data = np.frombuffer(text.tobytes().decode("utf-16-le").encode(), np.uint8)
        ids, n = self.merges.encode(data, np.add.reduceat(width, starts) if len(starts) else starts)
        stops = (4 * np.cumsum(np.bincount(word[starts], weights=n, minlength=len(words)).astype(np.int64))).tolist()
        raw = ids.tobytes()
        self.words.update(zip(words, [raw[s:e] for s, e in zip([0, *stops], stops, strict=False)], strict=True))
        self._slowly([words[k] for k in np.flatnonzero(odd)])

    def learn(self, words: set[bytes]) -> None:
        """Keeps all of the words, if they aren't yet."""
        if len(self.words) >= self.most:
            self.words, self.older = {}, self.words
        new = words.difference(self.words)
        again = {w: self.older[w] for w in new if w in self.older}
        self.words.update(again)
        self._encode(list(new.difference(again)))

    def each(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, END_ID last.  A long text is encoded piece after piece."""
        if sum(map(len, texts)) <= 2 * CHUNK_BYTES:
            cut = [text.split() for text in texts]
            self.learn(set().union(*cut))
            for words in cut:
                yield b"".join(map(self.words.__getitem__, words)) + END
            return
        for text in texts:
            found = []
            for piece in split_at_spaces(text):
                words = piece.split()
                self.learn(set(words))
                found.append(b"".join(map(self.words.__getitem__, words)))
            yield b"".join(found) + END


def split_at_spaces(text: bytes, most: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The text in pieces of about `most` bytes that don't cut words."""
    at = 0
    while len(text) - at > most:
        space = SPACE.search(text, at + most)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def cuts_of(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions where windows may end, and their penalties; the first is 0.  Every sentence end is one."""
    at = np.union1d(np.flatnonzero(sentence_ends[ids]) + 1, doc_ends)
    at = np.concatenate([[0], at[at > 0]])
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > STRIDE)
    inner = [np.arange(at[i] + STRIDE, at[i + 1], STRIDE) for i in wide]
    every = np.concatenate([at, *inner])
    cost = np.full(len(every), SENTENCE)
    cost[len(at) :] = TRUNCATED
    cost[: len(at)][np.isin(at, doc_ends)] = 0
    order = np.argsort(every, kind="stable")
    return every[order].tolist(), cost[order].tolist()


def best_cuts(at: list[int], penalty: list[int], length: int, final: bool) -> list[int]:
    """The cheapest chain of cuts from 0: to the last position if final, else to the best one in the last window."""
    n = len(at)
    cost, back = [0] * n, [0] * n
    queue, keys, head = [0], [0], 0
    for i in range(1, n):
        p = at[i]
        while at[queue[head]] < p - length:
            head += 1
        j = queue[head]
        c = keys[head] + length - p
        c += WINDOW_COST + penalty[i]
        cost[i], back[i] = c, j
        key = c + p
        while len(queue) > head and keys[-1] >= key:
            queue.pop()
            keys.pop()
        queue.append(i)
        keys.append(key)
    tail: list[int] = []
    if final:
        # The rest after a cut is one padded window, or windows of powers of two without padding.
        best, i = None, n - 1
        for k in range(n - 1, -1, -1):
            rest = at[-1] - at[k]
            if rest > length:
                break
            pieces = rest.bit_count()
            for c, split in ((cost[k] + (length - rest if pieces > 1 else 0) + (WINDOW_COST if rest else 0), False), (cost[k] + pieces * (WINDOW_COST + TRUNCATED), True)):
                if best is None or c < best:
                    best, i, tail = c, k, [at[-1]] if rest and not split else []
                    if split:
                        p = at[k]
                        for bit in range(rest.bit_length() - 1, -1, -1):
                            if rest >> bit & 1:
                                p += 1 << bit
                                tail.append(p)
    else:
        low = next(k for k in range(n) if at[k] > at[-1] - length)
        i = min(range(low, n), key=cost.__getitem__)
    found = []
    while i > 0:
        found.append(at[i])
        i = back[i]
    return found[::-1] + tail


class Packer:
    """Takes documents one after the other and gives the pieces of finished windows."""

    def __init__(self, sentence_ends: np.ndarray, first_sequence: int, length: int = LENGTH, block: int = BLOCK) -> None:
        self.ends, self.sequence, self.length, self.block = sentence_ends, first_sequence, length, block
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, its ids before what is held, all its ids
        self.held: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        self.docs.append((doc_id, 0, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids) // 4
        if self.size >= self.block:
            yield from self.pack(False)

    def pack(self, final: bool) -> Iterator[tuple]:
        if not self.size:
            return
        raw = b"".join(self.held)
        ids = np.frombuffer(raw, np.uint32)
        doc_ends = np.cumsum([total - before for _, before, total in self.docs])
        cuts = best_cuts(*cuts_of(ids, doc_ends, self.ends), self.length, final)
        view, doc, doc_start, at = memoryview(raw), 0, 0, 0
        stops = doc_ends.tolist()
        for cut in cuts:
            window = at
            while at < cut:
                doc_id, before, total = self.docs[doc]
                to = min(cut, stops[doc])
                yield doc_id, before + at - doc_start, to - at, zlib.crc32(view[4 * at : 4 * to]), total, self.sequence, at - window
                at = to
                if at == stops[doc]:
                    doc, doc_start = doc + 1, at
            self.sequence += 1
        self.docs = self.docs[doc:]
        if self.docs and at > doc_start:
            doc_id, before, total = self.docs[0]
            self.docs[0] = (doc_id, before + at - doc_start, total)
        self.held, self.size = [raw[4 * at :]], len(ids) - at


_tokenizers: dict[tuple[int, int], WordTokenizer] = {}


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, cached: int = CACHED) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every whole text of docs (doc_id, text) becomes its ids by the tokenizer file, without special tokens, and
    id 2; each id is in exactly one piece.  A null or empty text is id 2 alone.  Rows with equal or null doc_id
    are documents of their own.  A text longer than a window goes over several.  length is a power
    of two of 4 at least.  An empty table gives no piece.  Columns other than doc_id and text aren't used.
    """
    spark: SparkSession = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = file.value
        name = (zlib.crc32(told.encode()), cached)
        if name not in _tokenizers:
            _tokenizers[name] = WordTokenizer(told, cached)
        tokenizer = _tokenizers[name]
        packer = Packer(tokenizer.ends, TaskContext.get().partitionId() << 40, length)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 7)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in text_chunks(batches):
            data, at = utf8(b.column("text"))
            raw = data.tobytes()
            texts = [raw[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            found = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), tokenizer.each(texts), strict=True):
                found += packer.add(doc_id, ids)
            if found:
                yield rows(found)
        yield rows(list(packer.pack(True)))

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
