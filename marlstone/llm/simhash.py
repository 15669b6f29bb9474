"""SimHash near-duplicate detection with pigeonhole blocks.

A fingerprint has a bit for each bit position that is set in over half of the XXH64 hashes (seed 42) of a text's shingles.
Fingerprints that differ in at most ``MAX_BITS`` bits link. The 64 bits are cut into ``m`` blocks; two linked fingerprints
agree on at least ``m - MAX_BITS`` of them, so each fingerprint is put under every choice of that many blocks and only
fingerprints with a common choice are compared. ``m`` grows with the number of distinct fingerprints, which holds the
expected bucket at about a row. Equal fingerprints are one row from the start, so groups of copies cost nothing. A bucket
of more than ``SPLIT`` chunks is split by the pigeonhole again: the bits that its fingerprints need not share are cut into
``FINER`` blocks, and each fingerprint goes under every choice of all but ``MAX_BITS`` of these. Buckets are cut into chunks
of ``CHUNK`` rows, each pair of chunks is one unit of work, and of a unit only a spanning forest of its links leaves the
task, never all pairs. Connected components of the links are the groups.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; repeated rows are a row each of
the result, with the same component; null ids are no component's smallest unless it has no other, and ``near_dedup`` keeps
their rows; of rows that share an id it decides by id and fingerprint, and of those that share both it keeps one, that with
the smallest text; an empty table gives an empty result. Extra
columns are ignored by ``simhash_groups`` and kept by ``near_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, table, turned
from marlstone.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
CHUNK = 256
#: Buckets of more chunks are split by further blocks, of which there are so many choices: about as many rows either way.
SPLIT = 20
FINER = 6
#: Ids of near copies that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a (signed) long."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(made, "doc_id long, fp long")


def block_count(n: int, bits: int = MAX_BITS) -> int:
    """The fewest blocks for which a bucket holds about a fingerprint: 64 (m - bits) / m key bits against log2(n)."""
    m = bits + 2
    while m < 12 and 64 * (m - bits) / m < np.log2(max(n, 2)) + 2:
        m += 1
    return m


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(m: int, bits: int) -> list[int]:
    edge = [round(64 * k / m) for k in range(m + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(block, m - bits)]


def _finer(mask: int, bits: int) -> list[int]:
    """The mask with each choice of all but ``bits`` blocks of the positions that it leaves out."""
    free = [1 << p for p in range(64) if not mask >> p & 1]
    edge = [round(len(free) * k / FINER) for k in range(FINER + 1)]
    block = [sum(free[a:b]) for a, b in zip(edge, edge[1:], strict=False)]
    return [_signed(mask % (1 << 64) | sum(c)) for c in combinations(block, FINER - bits)]


_POP8 = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def popcount(x: np.ndarray) -> np.ndarray:
    if hasattr(np, "bitwise_count"):
        return np.bitwise_count(x)
    return _POP8[x.view(np.uint8).reshape(*x.shape, 8)].sum(axis=-1)


def forest(fp: np.ndarray, side: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs of a unit connect; pairs within its second side belong to another unit."""
    label, out = np.arange(len(fp)), []
    for i in range(1, len(fp)):
        near = popcount(fp[:i] ^ fp[i]) <= bits
        for root in np.unique(label[:i][near]):
            if root != label[i]:
                j = int(np.flatnonzero(near & (label[:i] == root))[0])
                out.append((int(fp[j]), int(fp[i])))
                label[: i + 1][label[: i + 1] == root] = label[i]
    return out


def _linked(bits: int):
    """Links within each run of equal (key, i, j) of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None

        def links(frame: pd.DataFrame) -> pa.RecordBatch:
            fp = frame["fp"].to_numpy().view(np.uint64)
            cols = [frame[c].to_numpy() for c in ("which", "key", "i", "j")]
            new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols], axis=0)))
            at = np.append(np.flatnonzero(new), len(fp))
            size = np.diff(at)
            pairs = [(a, b) for a, b in zip(fp[at[:-1]][size == 2].tolist(), fp[at[:-1][size == 2] + 1].tolist(), strict=True) if (a ^ b).bit_count() <= bits]
            for start, n in zip(at[:-1][size > 2], size[size > 2], strict=True):
                pairs += forest(fp[start : start + n], None, bits)
            out = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, 0])), pa.array(np.ascontiguousarray(out[:, 1]))], ["a", "b"])

        for batch in batches:
            frame = batch.to_pandas()
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if len(held) < 20_000:
                continue
            last = held.iloc[-1][["which", "key", "i", "j"]]
            open_run = (held[["which", "key", "i", "j"]] == last).all(axis=1).to_numpy()
            done, held = held[~open_run], held[open_run].reset_index(drop=True)
            if len(done):
                yield links(done)
        if held is not None and len(held):
            yield links(held)

    return run


def _units(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows (fp, which, key) of the buckets (which, key, n) in ``hot``, under each pair of chunks that theirs belongs to."""
    hot = hot.select("which", turned(F.col("key")).alias("key"), F.ceil(F.col("n") / CHUNK).cast("int").alias("c"))
    member = rows.withColumn("key", turned(F.col("key"))).join(hot, ["which", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    unit = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda x: F.struct(F.least(F.col("own"), x).alias("i"), F.greatest(F.col("own"), x).alias("j")))
    return member.select("which", "key", "fp", F.explode(unit).alias("u")).select("which", "key", "u.i", "u.j", "fp")


def links(distinct: DataFrame, n: int, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column fp, distinct, n of them) within ``bits`` bits."""
    masks = _masks(block_count(n, bits), bits)
    several = lambda df: df.groupBy("which", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = distinct.select("fp", F.posexplode(F.array(*[F.lit(x) for x in masks])).alias("which", "mask")).select("fp", "which", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    hot = cut(several(rows), "buckets")
    most = SPLIT * CHUNK
    units = _units(rows, hot.where(F.col("n") <= most))
    big = hot.where(F.col("n") > most).select("which", turned(F.col("key")).alias("key"))
    if not big.isEmpty():
        inner = rows.withColumn("key", turned(F.col("key"))).join(big, ["which", "key"], "left_semi")
        of = F.array(*[F.array(*[F.lit(y) for y in _finer(x, bits)]) for x in masks])[F.col("which")]
        count = F.lit(len(_finer(masks[0], bits)))
        finer = inner.select("fp", (F.col("which") + 1).alias("w"), F.posexplode(of).alias("k", "mask"))
        finer = cut(finer.select("fp", (F.col("w") * count + F.col("k") + len(masks)).cast("int").alias("which"), F.col("fp").bitwiseAND(F.col("mask")).alias("key")), "finer-buckets")
        units = units.unionByName(_units(finer, several(finer)))
    units = units.repartition("which", "key", "i", "j").sortWithinPartitions("which", "key", "i", "j")
    return units.mapInArrow(_linked(bits), "a long, b long").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) and keep_fp (the smallest fingerprint of that id in the component)."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    root = components(links(distinct.select("fp"), distinct.count(), bits))
    rooted = cut(distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("z"), "first", "fp")).alias("b"))
    least = least.select(turned(F.col("root")).alias("r"), F.col("b.first").alias("component_id"), F.col("b.fp").alias("keep_fp"))
    of = rooted.select("fp", turned(F.col("root")).alias("r")).join(least, "r").select("fp", "component_id", "keep_fp")
    of = cut(of, "fingerprint-components")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id", "keep_fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    of = _grouped(docs, id_col, text_col, shingle, bits)
    return of.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each group: that with the smallest id."""
    groups = cut(_grouped(docs, id_col, text_col), "near-groups").where("doc_id IS NOT NULL").withColumn("gone", F.expr("doc_id != component_id OR fp != keep_fp"))
    ids = groups.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("often"), F.max("gone").alias("gone")).where("often OR gone")
    ids = cut(ids.select(F.col("doc_id").alias("__ms_gone"), "often"), "near-copies")
    # Ids of 8 bytes: by their count a side of a few tens of MB at most is broadcast, and texts need no shuffle.
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    own = F.col(id_col).cast("long")
    rest = docs.join(small(ids.select("__ms_gone")), own == F.col("__ms_gone"), "left_anti")
    often = ids.where("often").select("__ms_gone")
    if often.isEmpty():
        return rest

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    # Ids of several rows: each row by its own fingerprint.
    stay = groups.where("NOT gone").join(often, F.col("doc_id") == F.col("__ms_gone"), "left_semi").select(F.col("doc_id").alias("__ms_id"), F.col("fp").alias("__ms_fp")).distinct()
    rows = docs.join(small(often), own == F.col("__ms_gone"), "left_semi")
    rows = rows.select(own.alias("__ms_id"), print_of(F.col(text_col).cast("string")).alias("__ms_fp"), F.col(text_col).alias("__ms_text"), F.struct(*docs.columns).alias("__ms_row"))
    one = rows.join(stay, ["__ms_id", "__ms_fp"]).groupBy("__ms_id", "__ms_fp").agg(F.min_by("__ms_row", F.coalesce("__ms_text", F.lit(""))).alias("__ms_row"))
    return rest.unionByName(one.select("__ms_row.*"))


def op8_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
