from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.operators import chunk
from marlstone.operators.chunk import ChunkConfig, split_text
from marlstone.operators.hooks import WordSegmenter

ENGLISH = "Apples are red fruit. Bananas are yellow fruit. Go is a language. Rust is a language. The sun is hot. The moon is cold."


def test_english():
    assert len(split_text(ENGLISH, ChunkConfig(0.1, 50, 1, 2))) >= 3


def test_headers():
    text = "# Header 1\nSome text stands here.\n# Header 2\nOther text stands here.\n# Header 3\nLast text."
    got = split_text(text, ChunkConfig(max_size=1000, min_size=5))
    assert len(got) >= 3 and all("\n" not in c for c in got) and any("# Header 2" in c for c in got)
    assert len(split_text(text, ChunkConfig(min_size=300))) == 1


def test_whitespace_and_limits():
    assert all(not set(c) & set(" \n\t") for c in split_text("a b c.\n" * 20 + "\td e", ChunkConfig(remove_whitespace=True)))
    assert len(split_text("One two three. Four five six. Seven eight.", ChunkConfig(max_size=15, min_size=1))) >= 2
    assert split_text("自然语言处理。机器学习。" * 30, ChunkConfig(max_size=500, min_size=200))
    assert split_text("") == [] and split_text(None) == [] and split_text(" \n ") == []


def test_sentences():
    assert chunk.sentences("Pi is 3.14. Next! 好。") == ["Pi is 3.14.", "Next!", "好。"]
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    assert table in chunk.sentences(f"Before.\n{table}\nAfter.")


def test_tables():
    rows = ["| h |", "|---|", *[f"| row {i} " + "x" * 90 + " |" for i in range(200)]]
    parts = chunk.split_table(rows)
    assert all(len(p) <= chunk.HARD_LIMIT and p.startswith("| h |\n|---|") for p in parts)
    assert sum(p.count("row") for p in parts) == 200


def test_garbage():
    junk = "a b c d e f g h. i j k l m n o p. q r s t u v w x."
    assert split_text(junk, ChunkConfig(min_size=10, filter_garbage=True)) == []
    assert split_text(junk, ChunkConfig(min_size=10)) != []
    assert chunk.is_garbage("", WordSegmenter()) is False


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!\n|-#中。1", max_size=400), st.integers(1, 60), st.integers(1, 80))
def test_no_letter_is_lost(text, low, high):
    got = split_text(text, ChunkConfig(min_size=low, max_size=high))
    letters = lambda s: [c for c in s if c in "ab中1"]
    kept = letters("".join(got))
    short = sum(len(x) < 3 for x in chunk.sentences(text)) if text else 0
    assert len(kept) >= len(letters(text)) - 2 * short


def test_frame(spark):
    df = spark.createDataFrame([("1", ENGLISH, 7), ("2", None, 8), ("3", " ", 9)], "id string, content string, extra int")
    got = chunk.chunk_documents(df, ChunkConfig(0.1, 50, 1, 2)).collect()
    assert [r["content"] for r in sorted(got, key=lambda r: r["chunk_no"])] == split_text(ENGLISH, ChunkConfig(0.1, 50, 1, 2))
    assert {r["extra"] for r in got} == {7}


def test_chunks_leave_a_task_in_small_batches(spark, monkeypatch):
    """Chunks of one batch of texts are not held together; rows, columns and types stay."""
    text = "One sentence is here. " * 30 + "\n|a|b|\n|--|--|\n|1|2|\n" + "Another follows that. |x|y|\n" * 9
    rows = [(k, None if k % 7 == 0 else " " if k % 5 == 0 else text[k:], k * 2) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, content string, n int").coalesce(1)
    monkeypatch.setattr(chunk, "OUT_CHARS", 3000, raising=False)
    out = chunk.chunk_documents(df)
    assert out.dtypes == [("id", "bigint"), ("content", "string"), ("n", "int"), ("chunk_no", "int")]
    want = [(k, c, n, i) for k, t, n in rows for i, c in enumerate(chunk.split_text(t))]
    assert [tuple(r) for r in out.collect()] == want
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
