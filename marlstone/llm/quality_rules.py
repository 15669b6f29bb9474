"""Quality rules: base counts, and a conditional random field that labels lines as content or boilerplate.

Each line with a word has the features of ``features``. A linear chain of the two labels runs over a document's lines;
Viterbi decoding finds the best sequence, and a document is kept if at least ``LEAST_SHARE`` of its words stand in content
lines. Documents that fail the base rules are not kept.

The field is fitted on a sample of about ``SAMPLE`` labelled documents, fewer if their texts would exceed ``SAMPLE_CHARS``
characters, and none longer than a ``LONGEST``-th of that. Labels are of documents: at first every line of a
good document is content and every line of a bad one boilerplate; then, ``ROUNDS`` times, the lines of bad documents take the
labels that the fitted field decodes for them. Everything but the fit reads all documents, and whole texts.

Defined cases: null, empty and blank texts have no words, fail the base rules and are not kept; without labels of both
kinds every document that passes the base rules is kept; of equally probable labels boilerplate
wins; a share of exactly ``LEAST_SHARE`` is kept; texts of any length are judged whole; repeated rows are a row each; a
document with several labels has the largest; null ids pass through; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, table

SAMPLE = 1000
#: Characters of the sample's texts at most; a longer text than a LONGEST-th of them is not fitted on.
SAMPLE_CHARS = 64_000_000
LONGEST = 64
#: Lines of a sequence in the fit; longer documents are several sequences there. Decoding has whole documents.
FIT_LINES = 48
EPOCHS = 60
ROUNDS = 2
RIDGE = 1e-3
LEAST_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = b"#*$%&|<>"
WS = b" \t\n\v\f\r"
N_FEATURES = 18


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words in windows of ``size`` words that occur twice or more, the first occurrence included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    key = w[:n]
    for k in range(1, size):
        # Renumbered after each step, so that the products stay small at any length.
        key = key * len(ids) + w[k : k + n]
        if k < size - 1:
            key = np.unique(key, return_inverse=True)[1]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    hot = np.flatnonzero(count[back] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[hot + k] = True
    return int(covered.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    in_words = text.translate(None, WS)
    word_chars = len(in_words.decode("utf-8", "surrogatepass"))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line.translate(None, WS):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), word_chars, n_symbols, dup, repeated_words(words)


_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"


def lines_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with a word, and its number of words."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, k = len(line), len(words)
        upper, lower, digit = n - len(line.translate(None, _UPPER)), n - len(line.translate(None, _LOWER)), n - len(line.translate(None, _DIGIT))
        symbols, pipes = n - len(line.translate(None, SYMBOLS)), line.count(b"|")
        excl, at = line.count(b"!"), line.count(b"@") + line.count(b"://")
        mean = (n - k + 1) / k
        last = line.rstrip()[-1:]
        again = line in seen
        seen.add(line)
        rows.append((1, k <= 3, 3 < k <= 10, 10 < k <= 40, k > 40, symbols > 0.5 * k, symbols > 0.1 * k, pipes >= 2, pipes > 0.3 * k, upper > lower, upper > 0.3 * (upper + lower + 1), digit > 0.2 * n, excl > 0.2 * k, at > 0, mean > 9, last in b".?!" and len(last) > 0, again, not rows))
        sizes.append(k)
    return np.array(rows, np.float64).reshape(-1, N_FEATURES), np.array(sizes, np.int64)


class Field:
    """A linear-chain conditional random field of two labels (1: content)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.move = emit, move  # (features, 2), (2, 2)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most probable label sequence (Viterbi)."""
        scores = (x @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            p0, p1 = a + m00 < b + m10, a + m01 < b + m11
            a, b = (b + m10 if p0 else a + m00) + s0, (b + m11 if p1 else a + m01) + s1
            back.append((p0, p1))
        label = int(b > a)
        out = [label]
        for p in reversed(back):
            label = int(p[label])
            out.append(label)
        return np.array(out[::-1], np.int64)


def _padded(seqs: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [(x[k : k + FIT_LINES], y[k : k + FIT_LINES]) for x, y in zip(seqs, labels, strict=True) for k in range(0, len(x), FIT_LINES)]
    t = max(len(x) for x, _ in parts)
    x, y, mask = np.zeros((len(parts), t, N_FEATURES)), np.zeros((len(parts), t), np.int64), np.zeros((len(parts), t), bool)
    for i, (a, b) in enumerate(parts):
        x[i, : len(a)], y[i, : len(a)], mask[i, : len(a)] = a, b, True
    return x, y, mask


def _fit(x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> Field:
    """Maximum likelihood with a ridge, by Adam on the exact gradient (forward-backward over all sequences at once)."""
    n, t, f = x.shape
    w, steps = np.zeros(2 * f + 4), mask.sum()
    m, v = np.zeros_like(w), np.zeros_like(w)
    hot = np.eye(2)[y] * mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    seen_e = np.einsum("ntf,nts->fs", x, hot)
    seen_m = np.einsum("nti,ntj->ij", hot[:, :-1] * both[..., None], hot[:, 1:])
    for epoch in range(1, EPOCHS + 1):
        emit, move = w[: 2 * f].reshape(f, 2), w[2 * f :].reshape(2, 2)
        s = (x @ emit) * mask[..., None]
        fwd, bwd = np.empty((n, t, 2)), np.zeros((n, t, 2))
        fwd[:, 0] = s[:, 0]
        for k in range(1, t):
            nxt = np.logaddexp(fwd[:, k - 1, 0, None] + move[0], fwd[:, k - 1, 1, None] + move[1]) + s[:, k]
            fwd[:, k] = np.where(mask[:, k, None], nxt, fwd[:, k - 1])
        for k in range(t - 2, -1, -1):
            right = s[:, k + 1] + bwd[:, k + 1]
            nxt = np.logaddexp(move[:, 0] + right[:, 0, None], move[:, 1] + right[:, 1, None])
            bwd[:, k] = np.where(mask[:, k + 1, None], nxt, 0.0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
        pair = np.exp(fwd[:, :-1, :, None] + move + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        g = np.concatenate([(seen_e - np.einsum("ntf,nts->fs", x, p)).ravel(), (seen_m - pair.sum(axis=(0, 1))).ravel()]) / steps - RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.3 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return Field(w[: 2 * f].reshape(f, 2), w[2 * f :].reshape(2, 2))


def fit_field(texts: list[str], good: list[int]) -> Field | None:
    """The field from document labels; None without both kinds of label."""
    found = [(x, q) for text, q in zip(texts, good, strict=True) if len(x := lines_of((text or "").encode("utf-8", "surrogatepass"))[0])]
    if len({q for _, q in found}) < 2:
        return None
    seqs = [x for x, _ in found]
    labels = [np.full(len(x), int(q)) for x, q in found]
    field = _fit(*_padded(seqs, labels))
    for _ in range(ROUNDS):
        labels = [np.ones(len(x), np.int64) if q else field.decode(x) for x, q in found]
        if not any((y == 0).any() for y in labels):
            break
        field = _fit(*_padded(seqs, labels))
    return field


def content_share(text: bytes, field: Field | None) -> float:
    """Share of a text's words in content lines; 1 without a field, 0 without words."""
    x, sizes = lines_of(text)
    if not len(x):
        return 0.0
    return 1.0 if field is None else float(sizes[field.decode(x) == 1].sum() / sizes.sum())


def sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """About ``sample`` labelled documents of ``chars`` characters at most: their texts and quality."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, sample / max(rows.count(), 1))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)).alias("__ms_draw")
    rows = rows.select(F.col("doc_id").alias("__ms_id"), "quality", drawn).where(F.col("__ms_draw") < int(share * (1 << 20)) + (share == 1))
    # A bounded sample, so it is the side that is broadcast.
    found = docs.select(F.col(id_col).alias("__ms_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__ms_text")).join(F.broadcast(rows), F.col("__ms_doc") == F.col("__ms_id"))
    found = cut(found.where(F.char_length("__ms_text") <= chars // LONGEST).select("__ms_id", "__ms_draw", "__ms_text", "quality"), "quality-sample")
    size = found.agg(F.sum(F.char_length("__ms_text")).alias("n"), F.max("__ms_draw").alias("top")).first()
    if size["n"] and size["n"] > chars:
        found = found.where(F.col("__ms_draw") <= int(size["top"] * chars / size["n"]))
    taken = found.orderBy("__ms_id", F.xxhash64("__ms_text"), "__ms_text").select("__ms_text", "quality").collect()
    return [r[0] for r in taken], [r[1] for r in taken]


def judge(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SHARE) -> DataFrame:
    """doc_id, the base counts, base_failed, content_share and kept of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                counts = base_counts(data)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED * counts[0]
                share = content_share(data, field)
                out.append((doc, *counts, failed, share, not failed and share >= least))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInPandas(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")


def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return judge(docs, fit_field(*sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
