"""Semantic chunking: sentences, TF-IDF similarity of neighbours, and grouping within length bounds.

Grouping restarts its running length at each cut, which no window frame expresses, so a document's chunks are made by
plain Python in an Arrow-batched UDF; documents are independent and nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.hooks import Segmenter, WordSegmenter

HARD_LIMIT = 8000
#: Characters of texts whose chunks leave a task at once.
OUT_CHARS = 1 << 20
_RULE = re.compile(r"[|][:\s]*[:-]+[:\s]*[|]")
_BREAK = re.compile(r"((?:\A|\n)#{1,6}\s+[^\r\n]*|[\n\r！。？!.?](?:[！。？!.?]|\s)*)")
_HEADER = re.compile(r"#{1,6}[ \t]")
_GONE = re.compile("[\n\r\t\f\v\0\u0085\u2028\u2029]")


@dataclass(frozen=True)
class ChunkConfig:
    similarity: float = 0.2
    max_size: int = 1000
    min_size: int = 50
    max_sentences: int = 50
    remove_whitespace: bool = False
    filter_garbage: bool = False

    def bounded(self) -> ChunkConfig:
        from dataclasses import replace

        return replace(self, max_size=max(self.max_size, self.min_size))


def is_table_row(line: str) -> bool:
    row = line.strip()
    if "|" not in row:
        return False
    return bool(_RULE.search(row)) if "---" in row else row.startswith("|")


def is_header(line: str) -> bool:
    return bool(_HEADER.match(line))


def clean_content(text: str) -> str:
    return " ".join(_GONE.sub("", text).split())


def tables(text: str) -> list[tuple[int, int]]:
    """Ranges of runs of table rows."""
    found, start, at = [], -1, 0
    for line in text.split("\n"):
        if is_table_row(line):
            start = at if start < 0 else start
        elif start >= 0:
            found.append((start, at - 1))
            start = -1
        at += len(line) + 1
    if start >= 0:
        found.append((start, len(text)))
    return found


def _add(out: list[str], content: str, mark: str) -> None:
    """A sentence with its mark; a mark alone belongs to the sentence before it."""
    content = clean_content(content)
    if is_header(mark.strip()):
        out += [x for x in (content, mark.rstrip().lstrip("\n\r")) if x]
        return
    mark = "".join(mark.split())
    if not content and out:
        out[-1] += mark
    elif content + mark:
        out.append(content + mark)


def sentences(text: str) -> list[str]:
    """Sentences with their end marks, headers, and tables as a unit. A point between digits ends nothing."""
    spans, out, last = tables(text) if "|" in text else [], [], 0
    inside = lambda p: any(a <= p < b for a, b in spans)
    for m in _BREAK.finditer(text):
        start, end = m.span()
        if spans and (inside(start) or inside(end)):
            continue
        if text[start] == "." and 0 < start and end < len(text) and text[start - 1].isdigit() and text[end].isdigit():
            continue
        table = next(((a, b) for a, b in spans if a >= last and b <= start), None) if spans else None
        if table:
            out += [x for x in (clean_content(text[last : table[0]]), text[slice(*table)]) if x]
            last = table[1]
            if last < start:
                _add(out, text[last:start], m[0])
        else:
            _add(out, text[last:start], m[0])
        last = end
    for a, b in [(a + last, b + last) for a, b in tables(text[last:])] if "|" in text else ():
        out += [x for x in (clean_content(text[last:a]), text[a:b]) if x]
        last = b
    tail = clean_content(text[last:])
    return out + [tail] if tail else out


def tfidf(of: list[list[str]]) -> list[dict[str, float]]:
    """TF-IDF of token lists with smooth inverse frequencies ln((1 + n) / (1 + df)) + 1."""
    n, counts, df = len(of), [Counter(tokens) for tokens in of], Counter()
    for c in counts:
        df.update(c.keys())
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    return [{t: c / size * idf[t] for t, c in count.items()} for count, size in zip(counts, map(len, of), strict=True)]


def cosine(a: dict[str, float], b: dict[str, float]) -> float:
    return neighbours([a, b])[0]


def neighbours(of: list[dict[str, float]]) -> list[float]:
    """Cosines of each vector with the one before it; a norm is taken once."""
    norms = [math.sqrt(sum([x * x for x in v.values()])) for v in of]
    return [sum([x * b[t] for t, x in a.items() if t in b]) / (p * q) if p * q else 0.0 for (a, b), (p, q) in zip(pairwise(of), pairwise(norms), strict=True)]


def clean_chunk(chunk: str, c: ChunkConfig) -> str:
    if not any(map(is_table_row, chunk.split("\n"))):
        return "".join(chunk.split()) if c.remove_whitespace else chunk.replace("\n", " ").replace("\r", " ")
    tidy = (lambda x: "".join(x.split())) if c.remove_whitespace else (lambda x: x.replace("\r", "").strip())
    lines = [x if is_table_row(x) else tidy(x) for x in chunk.split("\n")]
    return "\n".join(x for x in lines if x)


def split_table(rows: list[str], most: int = HARD_LIMIT) -> list[str]:
    """Pieces of a table of at most ``most`` characters, each under the header where both fit."""
    head = rows[:1] if rows and is_table_row(rows[0]) else []
    if head and len(rows) > 1 and is_table_row(rows[1]) and "---" in rows[1]:
        head = rows[:2]
    head_size = len("\n".join(head)) + 1 if head else 0
    out, held, size = [], [], 0
    for row in rows[len(head) :]:
        if held and size + 1 + len(row) > most:
            out.append("\n".join(held))
            held = []
        if not held:
            held = [*head, row] if head and head_size + len(row) <= most else [row]
            size = len("\n".join(held))
        else:
            held.append(row)
            size += 1 + len(row)
    return [*out, "\n".join(held)] if held else out


def is_garbage(chunk: str, segmenter: Segmenter) -> bool:
    if not chunk:
        return False
    tokens = [t for t in (x.strip() for x in segmenter.segment(chunk)) if t]
    if not tokens:
        return True
    valid = sum(len(t) > 1 and any(x.isalpha() or x.isnumeric() for x in t) for t in tokens) / len(tokens)
    single = sum(len(t) == 1 for t in tokens) / len(tokens)
    return valid < 0.2 or (valid < 0.3 and single > 0.5)


def group(of: list[str], similar: list[float], c: ChunkConfig) -> list[str]:
    """Chunks of sentences; ``similar[i]`` compares sentence i with the one before it."""
    sep = "" if c.remove_whitespace else " "
    out: list[str] = []
    held: list[str] = []
    size, table = 0, False

    def flush() -> None:
        nonlocal held
        if held and table:
            whole = "\n".join(held)
            out.extend(split_table([r for x in held for r in x.split("\n")]) if len(whole) > HARD_LIMIT else [whole])
        elif held:
            out.append(clean_chunk(sep.join(held), c))
        held = []

    for i, sentence in enumerate(of):
        row = is_table_row(sentence)
        if row != table:
            flush()
            table = row
        if held:
            if table:
                full = size + len(sentence) + 1 > HARD_LIMIT
            else:
                want = is_header(sentence.strip()) or similar[i] < c.similarity or size >= c.max_size or len(held) >= c.max_sentences
                full = want and size >= c.min_size or size >= c.max_size or len(held) >= 2 * c.max_sentences
            if full:
                flush()
        size = size + len(sentence) + (1 if table else len(sep)) if held else len(sentence)
        held.append(sentence)
    last = "" if table or not held else clean_chunk(sep.join(held), c)
    if last and len(last) < c.min_size and out and len(out[-1]) + len(sep) + len(last) <= min(3 * c.max_size, HARD_LIMIT):
        out[-1] += sep + last
    else:
        flush()
    return out


def split_text(text: str | None, config: ChunkConfig = ChunkConfig(), segmenter: Segmenter | None = None) -> list[str]:  # noqa: B008
    """Chunks of a text. Short texts, and texts of one sentence, are a chunk."""
    c = config.bounded()
    segmenter = segmenter or WordSegmenter()
    trimmed = (text or "").strip()
    if not trimmed:
        return []
    if len(trimmed) < c.min_size:
        return [clean_chunk(trimmed, c)]
    of = sentences(text)
    if len(of) == 1:
        return of
    of = [x for x in of if len(x.strip()) >= 3]
    if not of:
        return [trimmed]
    if len(of) == 1:
        return of
    vectors = tfidf([[t.lower() for t in segmenter.segment(x)] or [x] for x in of])
    chunks = group(of, [1.0, *neighbours(vectors)], c)
    return [x for x in chunks if not is_garbage(x, segmenter)] if c.filter_garbage else chunks


def chunk_documents(docs: DataFrame, config: ChunkConfig = ChunkConfig(), segmenter: Segmenter | None = None, key: str = "id", content: str = "content") -> DataFrame:  # noqa: B008
    """A row for each chunk: the document's columns, chunk_no from 0, and the chunk as content. Documents without chunks
    keep their text as one; null and blank ones give none."""

    rest = [c for c in docs.columns if c != content]
    schema = docs.select(*rest, F.lit(0).alias("chunk_no"), F.lit("").alias(content)).schema

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A few texts at a time become Python strings, and their chunks leave at once."""

        def out() -> pa.RecordBatch:
            made = [rows.column(c).take(pa.array(at, pa.int32())) for c in rest]
            return pa.RecordBatch.from_arrays([*made, pa.array(no, pa.int32()), pa.array(found, pa.string())], names=[*rest, "chunk_no", content])

        for rows in batches:
            texts, at, no, found, size = rows.column(content), [], [], [], 0
            for i in range(rows.num_rows):
                text = texts[i].as_py()
                made = split_text(text, config, segmenter) or ([text] if text and text.strip() else [])
                at += [i] * len(made)
                no += range(len(made))
                found += made
                size += len(text or "")
                if size >= OUT_CHARS:
                    yield out()
                    at, no, found, size = [], [], [], 0
            if found:
                yield out()

    return docs.select(*rest, F.col(content).cast("string").alias(content)).mapInArrow(chunks, schema).select(*docs.columns, "chunk_no")
