"""Removal of repeated passages with difference-cover anchors.

A window is ``WINDOW`` consecutive words. ``COVER`` is a difference cover modulo ``PERIOD``: for any two positions there is
a shift below ``PERIOD`` that takes both to residues in ``COVER``. So if two documents share a window, they share a hash of
``WINDOW - PERIOD + 1`` words at positions that both lie on the cover: an aligned anchor. Only these positions are hashed
(6 of 31), anchors are grouped, and those that start in two different texts are kept in a filter. Then the match is
extended: a window that holds a kept anchor is hashed whole (128 bits), each such hash gets the smallest document it starts
in, and the words of a window whose hash starts in a smaller document go. Copies of a whole text are found by its hash; all
of a copy's windows start in the smallest of its documents, so it goes whole and its windows need no hashing.

The filter is a Bloom filter in blocks of 4 KiB with three bits for each kept anchor; it only saves work, a false hit costs
a few hashed windows. It is sized by a count and at most ``FILTER_BYTES`` long. Where that gives fewer than ``LEAST_BITS``
an anchor, anchors and kept anchors are joined instead. A group of many copies is a row for each copy and window, never a
pair of copies.

Defined cases: null, empty and blank texts have no words and the hash of the empty string; documents shorter than a window
lose nothing; rows with a null id lose nothing and cause no loss; a row repeated with its id is no smaller document, so it
loses nothing to its twin; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, table, turned

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
BITS_PER_ANCHOR = 64
#: Below this many bits an anchor the filter lets too much pass; then anchors are joined instead.
LEAST_BITS = 12
FILTER_BYTES = 128 << 20
BLOCK_BITS = 32768
SHIFTS = (49, 34, 19)
#: Words whose hashes a worker keeps.
CACHE = 200_000

_B1, _B2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so they have inverses modulo 2^64
_MASK = (1 << 64) - 1


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        x = xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = x
        return x


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and base^-1.. modulo 2^64, for n positions."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any run of words, from prefix sums of word hash times power."""

    def __init__(self, hashes: np.ndarray, base: int) -> None:
        up, self.down = _power(base, len(hashes) + 1)
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))

    def __call__(self, at: np.ndarray, length: int) -> np.ndarray:
        return _mix((self.prefix[at + length] - self.prefix[at]) * self.down[at])


def _cover(n: int, window: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    """Cover positions at which an anchor fits into n words."""
    last = n - (window - period + 1)
    at = (np.arange(0, last + 1, period)[:, None] + np.array(cover)).ravel() if last >= 0 else np.empty(0, np.int64)
    return at[at <= last]


class Scanner:
    def __init__(self, window: int, period: int, cover: tuple[int, ...]) -> None:
        self.window, self.period, self.cover, self.known = window, period, cover, WordHashes()

    def hashes(self, text: str | None) -> np.ndarray:
        of = words(text)
        return np.array([self.known[w] for w in of], dtype=np.uint64) if len(of) >= self.window else np.empty(0, np.uint64)

    def anchors(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, Rolling]:
        at, roll = _cover(len(h), self.window, self.period, self.cover), Rolling(h, _B1)
        return at, roll(at, self.window - self.period + 1), roll


def _flush(rows: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names)


def _anchors(window: int, period: int, cover: tuple[int, ...]):
    """Distinct anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, rows, held = Scanner(window, period, cover), [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                if not len(h := scan.hashes(text.as_py())):
                    continue
                a = np.unique(scan.anchors(h)[1]).view(np.int64)
                rows.append((a, np.full(len(a), doc.as_py(), np.int64)))
                held += len(a)
                if held > 100_000:
                    yield _flush(rows, ["anchor", "row_key"])
                    rows, held = [], 0
        if rows:
            yield _flush(rows, ["anchor", "row_key"])

    return run


def _anchor_places(window: int, period: int, cover: tuple[int, ...]):
    """All anchors with the row and position they start at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(window, period, cover)
        for batch in batches:
            for doc, key, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if len(h := scan.hashes(text.as_py())):
                    at, anchor, _ = scan.anchors(h)
                    yield _flush([(anchor.view(np.int64), np.full(len(at), doc.as_py(), np.int64), np.full(len(at), key.as_py(), np.int64), at.astype(np.int32))], ["anchor", "doc_id", "row_key", "at"])

    return run


def _bits(anchor: np.ndarray, blocks: int) -> list[np.ndarray]:
    """The three bits of each anchor, all in its block."""
    block = (anchor % np.uint64(blocks)) * np.uint64(BLOCK_BITS)
    return [block + ((anchor >> np.uint64(s)) & np.uint64(BLOCK_BITS - 1)) for s in SHIFTS]


def _windows(window: int, period: int, cover: tuple[int, ...], bloom=None):
    """Windows that hold a kept anchor, as the filter says, or without one the column of positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if bloom is not None:
            bits, blocks = np.frombuffer(bloom.value[0], np.uint8), bloom.value[1]
        scan, rows, held, names = Scanner(window, period, cover), [], 0, ["doc_id", "row_key", "at", "h1", "h2"]
        for batch in batches:
            for doc, key, text, places in zip(*[batch.column(c) for c in range(3)], batch.column(3) if bloom is None else repeat(None)):  # noqa: B905
                if not len(h := scan.hashes(text.as_py())):
                    continue
                if bloom is None:
                    hit, roll = np.array(places.as_py(), np.int64), Rolling(h, _B1)
                else:
                    at, anchor, roll = scan.anchors(h)
                    in_all = np.ones(len(at), bool)
                    for where in _bits(anchor, blocks):
                        in_all &= (bits[where >> np.uint64(3)] >> (where & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    hit = at[in_all]
                if not len(hit):
                    continue
                # A window at i holds the aligned anchor at a cover position in [i, i + period).
                n = len(h) - window + 1
                change = np.zeros(len(h) + 2, np.int64)
                np.add.at(change, np.maximum(hit - period + 1, 0), 1)
                np.add.at(change, hit + 1, -1)
                start = np.flatnonzero(np.cumsum(change)[:n])
                if not len(start):
                    continue
                h1, h2 = roll(start, window), Rolling(_mix(h), _B2)(start, window)
                rows.append((np.full(len(start), doc.as_py(), np.int64), np.full(len(start), key.as_py(), np.int64), start.astype(np.int32), h1.view(np.int64), h2.view(np.int64)))
                held += len(start)
                if held > 100_000:
                    yield _flush(rows, names)
                    rows, held = [], 0
        if rows:
            yield _flush(rows, names)

    return run


def removal(n: int, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n words the windows at these positions cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + window, n), -1)
    return np.cumsum(change[:n]) > 0


def repeated_windows(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, row_key and the starts (array) of windows that also start in a smaller document; docs: doc_id, row_key, text."""
    spark = docs.sparkSession
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    anchors = known.select("row_key", "text").mapInArrow(_anchors(window, period, cover), "anchor long, row_key long")
    # Anchors of one text and its copies are none that texts share; copies are found by their whole text.
    shared = anchors.groupBy("anchor").agg(F.min("row_key").alias("lo"), F.max("row_key").alias("hi")).where("lo < hi").select("anchor")
    shared = cut(shared, "anchors")
    n = shared.count()
    schema = "doc_id long, row_key long, at int, h1 long, h2 long"
    if n * LEAST_BITS > filter_bytes * 8:
        places = known.select("doc_id", "row_key", "text").mapInArrow(_anchor_places(window, period, cover), "anchor long, doc_id long, row_key long, at int")
        kept = places.withColumn("anchor", turned(F.col("anchor"))).join(shared.select(turned(F.col("anchor")).alias("anchor")), "anchor", "left_semi")
        kept = kept.groupBy("doc_id", "row_key").agg(F.collect_set("at").alias("places"))
        found = known.join(kept, ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "places").mapInArrow(_windows(window, period, cover), schema)
    else:
        blocks = min(filter_bytes * 8 // BLOCK_BITS, max(1, -(-n * BITS_PER_ANCHOR // BLOCK_BITS)))
        # Unsigned remainder of a signed long: 2^64 mod blocks is added for negative ones.
        block = F.expr(f"pmod(pmod(anchor, {blocks}L) + if(anchor < 0, {(1 << 64) % blocks}L, 0L), {blocks}L)")
        three = F.array(*[F.shiftrightunsigned("anchor", s).bitwiseAND(F.lit(BLOCK_BITS - 1)) for s in SHIFTS])
        packed = shared.select(block.alias("block"), F.explode(three).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
        data = bytearray(blocks * BLOCK_BITS // 8)
        for row in packed.toLocalIterator():  # at most FILTER_BYTES, whatever the corpus
            data[row["block"] * BLOCK_BITS // 8 : (row["block"] + 1) * BLOCK_BITS // 8] = row["bits"]
        bloom = spark.sparkContext.broadcast((bytes(data), blocks))
        found = known.select("doc_id", "row_key", "text").mapInArrow(_windows(window, period, cover, bloom), schema)
    found = cut(found, "windows")
    first = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    first = first.select(turned(F.col("h1")).alias("h1"), turned(F.col("h2")).alias("h2"), "lo")
    later = found.withColumns({"h1": turned(F.col("h1")), "h2": turned(F.col("h2"))}).join(first, ["h1", "h2"]).where("doc_id > lo")
    return later.groupBy("doc_id", "row_key").agg(F.collect_set("at").alias("at"))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, row_key of documents whose whole text is that of a smaller document."""
    keys = cut(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "row_key", F.sha2("text", 256).alias("d")), "texts")
    first = keys.groupBy("d").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(F.unhex("d").alias("b"), "lo")
    return keys.withColumn("b", F.unhex("d")).join(first, "b").where("doc_id > lo").select("doc_id", "row_key").distinct()


def _kept(window: int, as_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, at in zip(batch["doc_id"], batch["text"], batch["at"], strict=True):
                of = words(text)
                if at is None or len(of) < window:
                    gone = np.zeros(len(of), bool)
                elif len(at) == 0:  # a copy: all its windows start in the smaller document
                    gone = np.ones(len(of), bool)
                else:
                    gone = removal(len(of), np.asarray(at, np.int64), window)
                kept = b" ".join([w for w, g in zip(of, gone.tolist(), strict=True) if not g])
                out.append((doc, len(of), int(gone.sum()), kept.decode("utf-8", "surrogatepass") if as_text else hashlib.sha256(kept).hexdigest()))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, digest: bool = False, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and what is left: kept (words joined by one space), or kept_sha256 of it."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    at = repeated_windows(slim, window, period, cover, filter_bytes)
    whole = cut(copies(slim), "copies")
    at = at.join(whole, ["doc_id", "row_key"], "left_anti").unionByName(whole.withColumn("at", F.array().cast("array<int>")))
    at = cut(at, "repeated")
    joined = slim.join(at, ["doc_id", "row_key"], "left").select("doc_id", "text", "at")
    last = "kept_sha256" if digest else "kept"
    return joined.mapInPandas(_kept(window, not digest), "doc_id long, n_words long, n_removed long, kept string").withColumnRenamed("kept", last)


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), digest=True)
