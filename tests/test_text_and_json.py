import json

from pyspark.sql import functions as F

from marlstone.functions import json as J
from marlstone.functions import text as X
from marlstone.operators import chunk


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    assert one(spark, "  a b \n c ", X.normalize_space) == "a b c"
    assert one(spark, "a b　c d\t", X.remove_space) == "abcd"
    assert one(spark, "a\nb  c d ", X.clean_content) == "ab cd"
    assert one(spark, "中文 ab1, é|$", X.valid_characters) == "中文 ab1, "
    assert one(spark, "é|$a", lambda c: X.valid_characters(c, True)) == "éa"
    assert one(spark, None, X.short) is True and one(spark, "12345678901", X.short) is False
    assert one(spark, "x [1] y", X.json_slice) == "[1]" and one(spark, "none", X.json_slice) is None
    assert one(spark, "say {a} {b}", lambda c: X.fill("{a}-{a}", a=c)) == "say {a} {b}-say {a} {b}"


def test_markdown_forms_agree(spark):
    lines = ["# a", "####### b", "#c", "| a | b |", "|---|:-:|", "a | b", "--- | x", "", "  | x", "x --- |-|"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    for r in df.select("x", X.is_header(F.col("x")).alias("h"), X.is_table_row(F.col("x")).alias("t")).collect():
        assert (r["h"], r["t"]) == (chunk.is_header(r["x"]), chunk.is_table_row(r["x"]))
    for c in (chunk.ChunkConfig(), chunk.ChunkConfig(remove_whitespace=True)):
        for text in ("a b\r\nc", "x y\n| a | b |\n z \n"):
            assert one(spark, text, lambda x, c=c: X.clean_chunk(x, c.remove_whitespace)) == chunk.clean_chunk(text, c)


def test_garbage(spark):
    df = spark.createDataFrame([(["a", "b", "."],), (["word", "more"],), ([],), (["ab", "cd", "e", "f", "g"],)], "t array<string>")
    assert [r[0] for r in df.select(X.is_garbage(F.col("t"))).collect()] == [True, False, True, False]


def test_terms():
    assert X.search_terms("What is the Capital of France?") == ["capital", "france"]
    assert X.search_terms("自然语言", "自然 语言") == ["自然", "语言"]


def test_json(spark):
    d = '{"tags": ["ab", "c"], "n": 5, "a.b": "x", "id": "1"}'
    assert one(spark, d, lambda c: J.matches({"n": 5, "a.b": "x"}, c)) is True
    assert one(spark, d, lambda c: J.matches({"n": 6}, c)) is False
    assert one(spark, None, lambda c: J.matches({"n": 6}, c)) is False
    assert one(spark, d, lambda c: J.tag_like(c, "b")) is True and one(spark, d, lambda c: J.has_tag(c, "b")) is False
    assert json.loads(one(spark, '{"a": 1, "b": [2]}', lambda c: J.merge(c, F.lit('{"b": {"x": true}, "c": null}')))) == {"a": 1, "b": {"x": True}, "c": None}
    assert json.loads(one(spark, d, lambda c: J.without(c, "id", "tags"))) == {"n": 5, "a.b": "x"}
    assert one(spark, '{"b": "two", "a": ["x", "y"], "embedding": [1], "n": 3, "id": "q"}', J.extract_text) == "x y two 3"
    assert one(spark, "not json", J.extract_text) == "" and one(spark, "raw", J.envelope_text) == "raw"
    assert one(spark, '{"content": "c"}', J.envelope_text) == "c"
    assert json.loads(one(spark, '{"k": 1}', lambda c: J.flatten(F.lit("i"), F.lit("t"), c))) == {"id": "i", "content": "t", "k": 1}
    assert one(spark, "", lambda c: J.first_text(c, F.lit(None).cast("string"), F.lit("p"))) == "p"


def test_context(spark):
    df = spark.range(1).select(F.array(F.struct(F.lit("a").alias("subject"), F.lit("p").alias("predicate"), F.lit("b").alias("object"))).alias("t"), F.array(F.lit("one"), F.lit("two")).alias("c"))
    assert df.select(X.context(F.col("t"), F.col("c"))).first()[0] == "Knowledge Graph recalled:\n- a -[p]-> b\n\nRelevant Documents:\n[1] one\n[2] two\n"
    assert df.select(X.context(F.col("t"), F.array().cast("array<string>"))).first()[0] == "No relevant information found."
    assert df.select(X.scored_line(F.lit(1), F.lit(0.5), F.lit("x"))).first()[0] == "[1] (Score: 0.5000) x"
