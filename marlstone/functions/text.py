"""Text expressions, JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = "a an and are as at but by for from how in is of on or that the these this those to was were what when where who why with".split()
#: Han, ASCII letters, digits, punctuation and white space stay.
INVALID = r"[^\p{IsHan}a-zA-Z\p{Nd}\p{P}\s\x{85}\x{A0}\x{2028}\x{2029}]"
INVALID_KEEP_LETTERS = r"[^\p{L}\p{M}\p{Nd}\p{P}\s\x{85}\x{A0}\x{2028}\x{2029}]"


def search_terms(query: str, tokens: str | None = None) -> list[str]:
    """Terms of a query: tokens of two characters or more with a letter or digit, else long words that are no stop words."""
    import re

    if tokens and tokens != query:
        found = [t for t in tokens.split() if len(t) >= 2 and any(c.isalnum() for c in t)]
        if found:
            return found
    return [w for w in re.findall(r"[a-z0-9]+", query.lower()) if len(w) >= 3 and w not in STOP_WORDS]


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))


def valid_characters(text: Column, keep_letters: bool = False) -> Column:
    return F.regexp_replace(text, INVALID_KEEP_LETTERS if keep_letters else INVALID, "")


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def remove_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\x{85}\x{A0}\p{Z}]", "")


def clean_content(text: Column) -> Column:
    """Line ends and control spaces go without a trace, other runs of space become one."""
    joined = F.regexp_replace(text, r"[\n\r\t\f\x0B\x00\x{85}\x{2028}\x{2029}]", "")
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


def is_header(text: Column) -> Column:
    return text.rlike(r"^#{1,6}[ \t]")


def is_table_row(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    ruled = t.rlike(r"[|][:\s]*[:-]+[:\s]*[|]")
    return F.when(~t.contains("|"), False).when(t.contains("---"), ruled).otherwise(t.startswith("|"))


def contains_table(text: Column) -> Column:
    return F.exists(F.split(text, "\n"), is_table_row)


def clean_chunk(text: Column, remove_whitespace: bool = False) -> Column:
    """Table rows as they are and other lines trimmed; without a table, line ends become spaces or all space goes."""
    tidy = remove_space if remove_whitespace else (lambda x: F.regexp_replace(F.regexp_replace(x, "\r", ""), r"^\s+|\s+$", ""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(is_table_row(x), x).otherwise(tidy(x)))
    plain = remove_space(text) if remove_whitespace else F.translate(text, "\n\r", "  ")
    return F.when(contains_table(text), F.array_join(F.filter(lines, lambda x: is_table_row(x) | (x != "")), "\n")).otherwise(plain)


def is_garbage(tokens: Column) -> Column:
    """Few tokens of two characters or more with a letter or digit, or somewhat few and many single characters."""
    t = F.filter(F.transform(tokens, lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(t)
    valid = F.size(F.filter(t, lambda x: (F.char_length(x) >= 2) & x.rlike(r"[\p{L}\p{N}]"))) / n
    single = F.size(F.filter(t, lambda x: F.char_length(x) == 1)) / n
    return F.when(n == 0, True).otherwise((valid < 0.2) | ((valid < 0.3) & (single > 0.5)))


def json_slice(reply: Column) -> Column:
    """The JSON in a model's reply: from the first { to the last }, else from the first [ to the last ]; null if none."""
    braces, brackets = F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    return F.when(braces != "", braces).when(brackets != "", brackets)


def short(text: Column, limit: int = 10) -> Column:
    return F.coalesce(F.char_length(text) <= limit, F.lit(True))


def like_any(columns: list[Column], terms: list[str]) -> Column:
    """Whether any column holds any term, without regard to case; pattern characters in terms are plain."""
    tests = [F.lower(c).contains(t.lower()) for c in columns for t in terms]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))


def has_all(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.lower(text).contains(w.lower()) for w in words], F.lit(True))


def coverage(text: Column, words: list[str]) -> Column:
    """Share of the words that the text holds."""
    if not words:
        return F.lit(0.0)
    found = reduce(lambda a, b: a + b, [F.lower(text).contains(w.lower()).cast("int") for w in words])
    return F.coalesce(found / F.lit(float(len(words))), F.lit(0.0))


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def chunk_id(doc_id: Column, n: Column) -> Column:
    return F.concat(doc_id, F.lit("_chunk_"), n.cast("string"))


def fill(template: str, **values: Column) -> Column:
    """A prompt template with {name} places."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def context(triples: Column, contents: Column) -> Column:
    """The text that a question is answered from: distinct recalled triples, then numbered documents."""
    lines = F.transform(F.array_distinct(triples), lambda t: F.concat(F.lit("- "), t.subject, F.lit(" -["), t.predicate, F.lit("]-> "), t.object))
    graph = F.when(F.size(triples) > 0, F.concat(F.lit("Knowledge Graph recalled:\n"), F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise("")
    docs = F.array_join(F.transform(contents, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c, F.lit("\n"))), "")
    return F.when(F.size(contents) == 0, F.lit("No relevant information found.")).otherwise(F.concat(graph, F.lit("Relevant Documents:\n"), docs))


def scored_line(n: Column, score: Column, text: Column) -> Column:
    return F.format_string("[%d] (Score: %.4f) %s", n, score, text)
