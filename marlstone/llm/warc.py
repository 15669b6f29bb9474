"""WARC archives: writing with revisit records, and reading with verified record boundaries.

Writing. Of records with equal payloads of at least ``LEAST_REVISIT`` bytes, that with the smallest id becomes a response,
the others revisits of it. Records are rows of a text table whose line separator is the two line ends that close a WARC
record, so any file system that Spark knows takes them; ``ROWS_PER_FILE`` bounds the files.

Reading. A file is cut into ranges by Spark's text reader, whose line separator is the record magic after a line end, so a
range is a task's however large the file is, and holds no more than a segment at a time. Each segment, inside payloads
too, starts with a candidate: its task parses the header and emits the segment's length and the content length, hence the
candidate's offset and that of its successor. Only candidates that a chain of successors from the start of the file
reaches are records. They are found by pointer jumping: the reached set follows pointers of length 1, 2, 4, ... that are
squared in each round, so a file takes rounds in the logarithm of its number of records. A payload that ends in its segment
is hashed there, once; the segments of payloads that hold the magic are read again and put together once they are known to
belong to a record. So the time is in proportion to the bytes, whatever a payload feigns.

Defined cases: null and empty payloads are responses of zero bytes; of equal payloads, rows that share the smallest id are
all responses, and null ids come last; payloads hold any characters, the magic and line ends included, at any length that
a row may have; repeated rows are a record each; an empty table writes and reads nothing; a damaged record ends its file's
chain, and what comes after it is not read, nor is a record that holds the magic and is not followed by a record or the end.
Extra columns are not archived.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import cut, scratch_path, table

LEAST_REVISIT = 100
ROWS_PER_FILE = 20_000
MAGIC = b"WARC/1.1\r\n"
SEPARATOR = b"\n" + MAGIC
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """page_id, payload_digest, refers_to for each row that repeats a payload of a smaller id."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    keys = cut(pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(payload, 256).alias("d"), F.octet_length(payload).alias("n")).where(F.col("n") >= LEAST_REVISIT), "payloads")
    first = keys.groupBy("d").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c")).where("c > 1 AND refers_to IS NOT NULL")
    return keys.withColumn("b", F.unhex("d")).join(first.select(F.unhex("d").alias("b"), "refers_to"), "b").where("page_id IS NULL OR page_id != refers_to").select("page_id", F.col("d").alias("payload_digest"), "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes a record for each row."""
    again = cut(revisits(pages, id_col, payload_col), "revisits").select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("__ms_id"), F.col("payload_digest").alias("__ms_digest"), "refers_to")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("__ms_id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", "").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("__ms_digest"))
    rows = rows.join(again, ["__ms_id", "__ms_digest"], "left")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.when(F.col("refers_to").isNull(), F.concat(http, "payload")).otherwise(http)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise("revisit")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), "__ms_id", F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "__ms_digest")),
        F.when(F.col("refers_to").isNotNull(), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    rows.withColumn("block", block).select(F.concat(head, "block").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


FIELD = re.compile(rb"(?im)^([a-z-]+):[ \t]*([^\r\n]*)\r?$")
PLACE = "file string, block long, n int"
CANDIDATE = f"{PLACE}, size long, head long, length long, tail int, inside boolean, page_id long, record_type string, refers_to long, digest string, declared string, payload_bytes long, payload binary"


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.lower(): v.strip() for k, v in FIELD.findall(head)}


def _named(head: bytes) -> tuple:
    """page_id, record_type, refers_to, declared digest of a record's header."""
    field = _fields(head)
    one = lambda name: int(x) if (x := re.sub(rb"^<urn:page:|>$", b"", field.get(name, b""))).lstrip(b"-").isdigit() else None
    return one(b"warc-record-id"), field.get(b"warc-type", b"").decode("latin-1"), one(b"warc-refers-to"), field.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:")


def _payload(block: bytes) -> bytes:
    """What follows the HTTP header, if there is one."""
    at = block.find(b"\r\n\r\n")
    return block[at + 4 :] if at >= 0 else block


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """file, block, number within it, and bytes of each segment of a task's ranges, in order."""
    place, n = None, 0
    for batch in batches:
        for file, block, value in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
            n = n + 1 if place == (file, block) else 0
            place = (file, block)
            yield file, block, n, value


def _frame(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])


def _candidates(with_payload: bool):
    """A row for each segment, with what its header says if it has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for file, block, n, value in _segments(batches):
            if block == 0 and n == 0:  # the start of the file, where no line end comes before the magic
                if not value.startswith(MAGIC):
                    rows.append((file, block, n, len(value) - len(MAGIC), -1, -1, 0, False, None, "", None, "", "", 0, None))
                    continue
                value = value[len(MAGIC) :]
            last = b"\r\n" + value[-4:]  # the magic before it ends a line, too
            tail = 2 if last.endswith(b"\r\n\r\n") else 1 if last.endswith(b"\r\n\r") else 0
            stop = value.find(b"\r\n\r\n")
            size = _fields(value[: stop + 2]).get(b"content-length", b"") if stop >= 0 else b""
            if not size.isdigit() or len(size) > 18:
                rows.append((file, block, n, len(value), -1, -1, tail, False, None, "", None, "", "", 0, None))
            else:
                head, length, payload, digest = stop + 4, int(size), b"", ""
                inside = head + length <= len(value)
                if inside:
                    payload = _payload(value[head : head + length])
                    digest = hashlib.sha256(payload).hexdigest()
                    # The line end that the next magic follows is not in the segment.
                    if value[head + length : head + length + 4] not in (b"\r\n\r\n", b"\r\n\r"):
                        length = -1
                page_id, kind, refers_to, declared = _named(value[: stop + 2])
                rows.append((file, block, n, len(value), head, length, tail, inside, page_id, kind, refers_to, digest, declared, len(payload), payload if with_payload and inside else None))
                held += len(payload) if with_payload else 0
            if len(rows) >= 5000 or held > 16 << 20:
                yield _frame(rows, CANDIDATE)
                rows, held = [], 0
        if rows:
            yield _frame(rows, CANDIDATE)

    return run


def reached(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Of a file's candidates, which a chain from offset 0 reaches, by pointer jumping."""
    order = np.argsort(offset, kind="stable")
    offset, successor = offset[order], successor[order]
    n = len(offset)
    at = np.searchsorted(offset, successor)
    jump = np.where((at < n) & (offset[np.minimum(at, n - 1)] == successor), at, n)  # n: no candidate there
    jump = np.append(jump, n)
    mark = np.zeros(n + 1, bool)
    mark[0] = n > 0 and offset[0] == 0
    while True:
        grown = mark.copy()
        grown[jump[mark]] = True
        if (grown == mark).all():
            break
        mark, jump = grown, jump[jump]
    out = np.zeros(n, bool)
    out[order] = mark[:n]
    return out


def _chained(group: pd.DataFrame) -> pd.DataFrame:
    """The segments of a file's records: each with the place of the record it belongs to."""
    group = group.sort_values(["block", "n"], ignore_index=True)
    size, head, length, tail, inside = (group[c].to_numpy() for c in ("size", "head", "length", "tail", "inside"))
    # A segment's bytes begin after its magic; the magic begins after the separator's line end.
    begin = len(MAGIC) + np.concatenate(([0], np.cumsum(size[:-1] + len(SEPARATOR))))
    start, end = begin - len(MAGIC), begin[-1] + size[-1]
    after = np.where(length >= 0, begin + head + length + len(END), -1)
    j = np.searchsorted(start, after)  # the first segment that is not the record's
    closed = np.where(j < len(start), tail[np.maximum(j - 1, 0)] >= 1, tail[-1] == 2) & (np.append(start, end)[np.minimum(j, len(start))] == after)
    good = (length >= 0) & (inside | closed)
    if group["block"].iloc[0] != 0 or group["n"].iloc[0] != 0:
        good[:] = False
    found = np.flatnonzero(reached(start, np.where(good, after, -1)) & good)
    many = np.where(inside[found], 1, j[found] - found)
    which = np.repeat(found, many)
    at = which + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    out = group.loc[at, ["file", "block", "n"]].reset_index(drop=True)
    return out.assign(of_block=group["block"].to_numpy()[which], of_n=group["n"].to_numpy()[which], inside=inside[which])


def _gathered(with_payload: bool):
    """A row for each record whose payload holds the magic, from its segments in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, segments in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                value = SEPARATOR.join(x["value"] for x in segments)
                if segments[0]["block"] == 0 and segments[0]["n"] == 0:
                    value = value[len(MAGIC) :]
                head = value.find(b"\r\n\r\n") + 4
                page_id, kind, refers_to, declared = _named(value[: head - 2])
                payload = _payload(value[head : head + int(_fields(value[: head - 2])[b"content-length"])])
                yield _frame([(file, segments[0]["block"], segments[0]["n"], page_id, kind, refers_to, hashlib.sha256(payload).hexdigest(), declared, len(payload), payload if with_payload else None)], RECORD)

    return run


RECORD = f"{PLACE}, page_id long, record_type string, refers_to long, digest string, declared string, payload_bytes long, payload binary"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _segments(batches):
        yield _frame([row], f"{PLACE}, value binary")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record: file, block and n (its place), page_id, record_type, refers_to, digest, declared, payload_bytes, payload."""
    text = spark.read.option("lineSep", SEPARATOR.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    found = cut(text.mapInArrow(_candidates(with_payload), CANDIDATE), "candidates")
    kept = cut(found.select("file", "block", "n", "size", "head", "length", "tail", "inside").groupBy("file").applyInPandas(_chained, f"{PLACE}, of_block long, of_n int, inside boolean"), "chained")
    place = ["file", "block", "n"]
    # Merged whatever their size: what is kept grows with the archives.
    own = found.join(kept.where("inside").select(place).hint("merge"), place, "left_semi").select([x.split()[0] for x in RECORD.split(", ")])
    apart = kept.where("NOT inside")
    if apart.isEmpty():
        return own
    segments = text.mapInArrow(_numbered, f"{PLACE}, value binary").join(apart, place)
    gathered = segments.groupBy("file", "of_block", "of_n").agg(F.sort_array(F.collect_list(F.struct("block", "n", "value"))).alias("s")).select("file", "s")
    return own.unionByName(gathered.mapInArrow(_gathered(with_payload), RECORD))


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit has them of the response it refers to."""
    read = cut(read_archives(spark, path, with_payload=False), "records")
    own = read.where("record_type != 'revisit'").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    size = own.select(F.col("payload_digest").alias("declared"), F.col("payload_bytes").alias("b"), F.col("page_id").alias("refers_to")).join(read.where("record_type = 'revisit'").select("declared", "refers_to").distinct(), ["declared", "refers_to"], "left_semi").distinct()
    size = cut(size, "responses").select(F.concat("declared", F.lit("")).alias("declared"), "refers_to", "b")
    later = read.where("record_type = 'revisit'").join(size, ["declared", "refers_to"], "left")
    return own.unionByName(later.select("page_id", F.col("b").alias("payload_bytes"), F.col("declared").alias("payload_digest"), "record_type", "refers_to"))


def op9_warc(spark, sf_dir):
    path = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return records(spark, path)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM k)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id != first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id != first THEN first END AS refers_to FROM f
"""
