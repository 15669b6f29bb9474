"""Best-fit packing of tokenised documents by the sum-of-squares rule.

Documents become token ids (an ``END`` id closes each), ids become pieces of at most ``capacity``, and each piece goes
where the sum over residual gaps of the squared number of open sequences with that gap becomes smallest; of equal places it
takes the smallest gap. A new sequence is opened only if no open one has room, and pieces are placed by falling length: on
the check tables this takes one sequence more than the fewest possible, where the rule that may always open one took 143
more. The rule needs only the number of open sequences for each gap, so a task holds ``capacity``
counters and its own pieces. Pieces are dealt by hash to shards of ``SHARD`` pieces on average; shards pack on their own,
which leaves at most a few open sequences in each, and nothing is gathered in one task however many documents come.

Defined cases: null text counts as empty and gives one piece of the ``END`` id alone; repeated rows are packed each; an
empty table gives no pieces. Whole texts are tokenised, however long. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import struct
from array import array
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, table

CAPACITY = 2048
#: Pieces that one task packs, on average.
SHARD = 120_000
#: Entries of a worker's cache of encoded words.
CACHE = 200_000
END = b"\0\0\0\0"
SPECIAL = "<|endoftext|>"


def default_vocabulary() -> tuple[str, str]:
    """The byte-level vocabulary as a tokenizers file and as the same ranks for a faster library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Text to little-endian 32-bit ids, equal to those of the tokenizers file (a test compares them).

    A space between two characters that are not white space (Unicode's: no-break spaces and line ends too) always begins a
    pre-token, so words are encoded once and cached. Texts with a space beside other white space go to the rank encoder
    whole, texts with the special token to the tokenizers library.
    """

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.exact, self.known = json_path, None, {}

    def whole(self, text: str) -> bytes:
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.json_path)
            ids = self.exact.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if "  " in text:
            return self.whole(text)
        first, *words = text.split(" ")
        if words and first[-1:].isspace():
            return self.whole(text)
        parts, known = [self.whole(first)], self.known
        for w in words:
            x = known.get(w)
            if x is None:
                if w[:1].isspace() or w[-1:].isspace():  # words in the cache have been through this
                    return self.whole(text)
                x = self.whole(" " + w)
                if len(known) < CACHE and len(w) < 40:
                    known[w] = x
            parts.append(x)
        return b"".join(parts)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece. All pieces of a document but the first are full."""
    files = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(*files)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder(text or "") + END
                n = len(ids) // 4
                head = (n - 1) % capacity + 1
                for k, stop in enumerate(range(head, n + 1, capacity)):
                    start = max(0, stop - capacity) if k else 0
                    out.append((doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInPandas(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each item, for lengths in the order of placing."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by gap; a full one (gap 0) is not open
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        best = capacity
        if size < capacity:
            # Placing into gap h changes the sum by 2 (N[h - size] - N[h]) + 2, or by 1 - 2 N[h] if it fills the gap.
            room = count[size:capacity]
            change = 2 * (count[: capacity - size] - room) + 2
            change[0] = 1 - 2 * room[0]
            change[room == 0] = 1 << 60
            at = int(change.argmin())
            if change[at] < 1 << 60:
                best = at + size
        if best == capacity:
            bin_id, made = made, made + 1
        else:
            bin_id = open_at[best].pop()
            count[best] -= 1
        left = best - size
        sequence[k], offset[k] = bin_id, capacity - best
        if left:
            open_at[left].append(bin_id)
            count[left] += 1
    return sequence, offset


def pack(of: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    of = cut(of.withColumn("__ms_row", F.monotonically_increasing_id()), "pieces")
    n = of.count()
    shards = max(1, -(-n // shard))

    def place(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "__ms_row"], ascending=[False, True], ignore_index=True)
        sequence, offset = sum_of_squares(group["length"].to_numpy(), capacity)
        group["sequence_id"], group["offset"] = (int(key[0]) << 32) + sequence, offset
        group["doc_id"] = group["doc_id"].astype("Int64")
        return group[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = of.withColumn("__ms_shard", F.pmod(F.xxhash64("__ms_row"), F.lit(shards)).cast("int"))
    return dealt.groupBy("__ms_shard").applyInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark, sf_dir):
    return pack(pieces(table(spark, sf_dir, "documents", "doc_id", "text")))
