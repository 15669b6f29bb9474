"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

Pass one counts the bit slots that the text hashes of the corpus set, two for each hash, both in one 4 KiB block of
the filter, and keeps the slots that were set more than once as bitmaps. Pass two probes: only a hash whose two slots
were both set repeatedly may repeat, so only its row is shuffled and grouped; all others pass straight through. Both passes
have keys (id, hash, length) in their hands, never texts; a key is written once, in the order of its hash within its file.
The filter has ``BITS_PER_ROW`` bits a row, whatever their number. It is broadcast in segments of ``BROADCAST_BYTES`` by hash
range: a segment's probe is a scan of its range of the keys, which Parquet's statistics bound, so a larger corpus takes
more of the same map-only scans and shuffles no more of its rows. False positives cost a shuffled key each and change
nothing in the result.

``exact_dedup`` takes the rows that lose out of the documents. Their ids are broadcast up to ``BROADCAST_BYTES`` by count;
beyond that a Bloom filter of these ids, at most that large, decides which documents are shuffled to be compared exactly. A
document that loses nowhere is never hashed again nor moved.

Defined cases: null text counts as empty, so null, empty and blank texts are one group. Of equal texts the row with the
most code points stays, then the smallest id, null ids last; of rows that repeat an id as well, one stays, that with the
smallest text. Texts of any length are hashed whole. An empty table gives an empty result. Extra columns pass through
``exact_dedup`` unchanged, unless their names begin with ``__ms_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import bloom
from marlstone.llm.common import cut, no_space

BITS_PER_ROW = 16
BROADCAST_BYTES = 64 << 20
#: Bytes that a broadcast row of an id takes, and bits of a filter for each such row.
ROW_BYTES, LOSER_BITS = 100, 16

_KEY, _LEN, _ROW = "__ms_sha", "__ms_len", "__ms_row"


def text_key(text: Column) -> Column:
    """SHA-256 of the text without white space."""
    return F.unhex(F.sha2(no_space(text), 256))


def _length(text: Column) -> Column:
    return F.char_length(F.coalesce(text, F.lit("")))


def repeated_slots(keys: DataFrame, rows: int) -> DataFrame:
    """The filter of slots set more than once: a bitmap for each block."""
    slots = bloom.exploded(keys, bloom.block_bits(rows * BITS_PER_ROW))
    return bloom.bitmaps(slots.groupBy("__ms_block", "__ms_p").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A table of doc_id, hash of the text, its length, a row number; each file in the order of a hash of the hash."""
    keys = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias(_KEY), _length(F.col(text_col)).alias(_LEN), F.monotonically_increasing_id().alias(_ROW))
    return cut(keys.withColumn(bloom.HASH, F.xxhash64(_KEY)).sortWithinPartitions(bloom.HASH), "dedup-keys")


def _split(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys that repeat nowhere, and those that may, with ``__ms_size`` and ``__ms_best`` of their hash."""
    n = keys.count()
    probed = bloom.probe(keys, cut(repeated_slots(keys, n), "dedup-bloom"), bloom.block_bits(n * BITS_PER_ROW), BROADCAST_BYTES)
    maybe = cut(probed.where("__ms_maybe"), "dedup-maybe")
    order = F.struct((-F.col(_LEN)).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col(_ROW).alias("r"))
    groups = cut(maybe.groupBy(_KEY).agg(F.count(F.lit(1)).alias("__ms_size"), F.min(order).alias("__ms_best")), "dedup-groups")
    # By their counted size groups are broadcast. Else both sides are shuffled and merged, so that a hot hash can be split.
    side = F.broadcast(groups) if 2 * ROW_BYTES * groups.count() <= BROADCAST_BYTES else groups.hint("merge")
    return probed.where("NOT __ms_maybe"), maybe.join(side, _KEY)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    alone, of = _split(_keys(docs, id_col, text_col))
    sha = F.lower(F.hex(_KEY)).alias("text_sha256")
    repeated = of.select("doc_id", F.col("__ms_best.i").alias("keep_id"), F.col("__ms_size").alias("group_size"), (F.col(_ROW) == F.col("__ms_best.r")).alias("kept"), sha)
    single = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return single.unionByName(repeated)


def _told(id_: Column) -> Column:
    """The id as a string that no null can make null."""
    return F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit(""))


def _suspects(docs: DataFrame, own: Column, ids: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """``docs`` with ``__ms_hit``: whether the row's id is, or by a filter may be, among ``ids``; and whether ids are few."""
    if n * ROW_BYTES <= BROADCAST_BYTES:
        return docs.withColumn("__ms_own", own).join(F.broadcast(ids.withColumn("__ms_hit", F.lit(True))), F.col("__ms_own") == F.col("__ms_id"), "left").withColumn("__ms_hit", F.coalesce("__ms_hit", F.lit(False))).drop("__ms_id"), True
    # The filter's bits a row shrink beyond its bound: more documents are then compared, and no other result comes out.
    of_block = min(bloom.block_bits(n * LOSER_BITS), max(0, (BROADCAST_BYTES >> 12).bit_length() - 1))
    slots = bloom.exploded(ids.select(F.xxhash64("__ms_id").alias(bloom.HASH)), of_block)
    side = cut(bloom.bitmaps(slots.distinct()), "dedup-losers-bloom")
    hashed = docs.withColumn("__ms_own", own).withColumn(bloom.HASH, F.xxhash64("__ms_own"))
    return bloom.probe(hashed, side, of_block, BROADCAST_BYTES + (1 << 12)).drop(bloom.HASH).withColumnRenamed("__ms_maybe", "__ms_hit"), False


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns."""
    _, of = _split(_keys(docs, id_col, text_col))
    best = F.col(_ROW) == F.col("__ms_best.r")
    own = _told(F.col(id_col))
    marked = of.select(_told(F.col("doc_id")).alias("__ms_id"), _KEY, _LEN, best.alias("__ms_is_best"))
    # A row is told by its id and hash. Of rows that share both, the winner's among them, one is picked by itself.
    rows = marked.groupBy("__ms_id", _KEY).agg(F.count(F.lit(1)).alias("__ms_n"), F.max("__ms_is_best").alias("__ms_is_best"), F.max(_LEN).alias(_LEN))
    gone = cut(rows.where("NOT __ms_is_best OR __ms_n > 1"), "dedup-losers")
    ids = gone.select("__ms_id").distinct()
    docs_, few = _suspects(docs, own, ids, gone.count())
    sha = F.when(F.col("__ms_hit"), text_key(F.col(text_col)))
    if few:  # one scan; rows that are no suspects have no hash and match nothing
        stay = docs_.withColumn(_KEY, sha).join(F.broadcast(gone.select(F.col("__ms_id").alias("__ms_own"), _KEY)), ["__ms_own", _KEY], "left_anti").select(docs.columns)
    else:
        compared = docs_.where("__ms_hit").withColumn(_KEY, sha).join(gone.select(F.col("__ms_id").alias("__ms_own"), _KEY), ["__ms_own", _KEY], "left_anti")
        stay = docs_.where("NOT __ms_hit").select(docs.columns).unionByName(compared.select(docs.columns))
    twice = gone.where("__ms_is_best")
    if twice.isEmpty():
        return stay
    again = docs.withColumns({"__ms_id": own, _LEN: _length(F.col(text_col))}).join(twice.select("__ms_id").distinct(), "__ms_id", "left_semi")
    again = again.select("__ms_id", _LEN, text_key(F.col(text_col)).alias(_KEY), F.col(text_col).alias("__ms_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__ms_row"))
    one = again.join(twice.select("__ms_id", _KEY, _LEN), ["__ms_id", _KEY, _LEN]).groupBy("__ms_id", _KEY).agg(F.min_by("__ms_row", F.coalesce("__ms_text", F.lit(""))).alias("__ms_row"))
    return stay.unionByName(one.select("__ms_row.*"))


def op1_exact_dedup(spark, sf_dir):
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH k AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
                  length(coalesce(text, '')) AS n FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size,
             row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept FROM k)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""
