"""The pipeline against a stage-by-stage brute-force version."""

import re

import duckdb

import corpus_pipeline
from marlstone.llm import language_id, mixing
from tests.llm.test_dedup import brute_groups, brute_print
from tests.llm.test_packing import check


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_run(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    predict = language_id.Predictor(language_id.fit(docs))
    kept = {i for i, r in rows.items() if (p := predict(r["text"]))[0] != "und" and p[1] >= 0.5}
    groups = {}
    for i in kept:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", rows[i]["text"]), []).append(i)
    kept = {min(g, key=lambda i: (-len(rows[i]["text"]), i)) for g in groups.values()}
    order = sorted(kept)
    kept = {order[c] for c in brute_groups([brute_print(rows[i]["text"]) for i in order])}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet' WHERE doc_id IN ({', '.join(map(str, kept))})")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.SQL}) WHERE kept").fetchall()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == kept and 0.7 * len(order) < len(kept)
    check(got, {i: rows[i]["text"] for i in kept}, 2048)


def test_each_stage_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf)
        assert out.count() == 0
        assert name == "packing" or out.columns == docs.columns


def test_edges_from_end_to_end(spark, tmp_path):
    """Nulls in each column, repeated rows and ids, a very long text, ties, and columns that clash with inner names."""
    english = "the house number {0} is big and the dog of the neighbour runs to it every day before he sleeps there {0}"
    french = "la maison numero {0} est grande et le chien du voisin y court chaque jour avant de dormir la bas {0}"
    rows = [(k, (french if k % 3 == 0 else english).format(f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 9), "fr" if k % 3 == 0 else "en", f"s{k % 4}", 1) for k in range(300)]
    rows += [(300, None, "en", "s1", 1), (301, "", None, None, 1), (302, " \n", "en", "s0", 1), (303, "77 !! ½", "en", "s0", 1)]
    rows += [(None, english.format("null id"), "en", None, None), (304, french.format("null lang"), None, "s2", 1), (305, english.format("null source"), "en", None, 1)]
    rows += [rows[7], rows[7], (7, rows[8][1], "en", "s3", 1), (400, rows[9][1] + "  ", "fr", "s1", 1), (306, "the long dog " * 60_000, "en", "s1", 1)]
    clash = "doc_id long, text string, lang string, source string, n_chars long, p double, fp long, kept boolean, n long, topic string, score double, piece int, at int, host string"
    spark.createDataFrame([(*r, 0.5, 1, False, 2, "t", 0.1, 3, 4, "h") for r in rows], clash).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left.count(), stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
        kept = left.collect()
        left = spark.createDataFrame(kept, docs.schema)
        assert 0 < len(kept) <= before, name
        ids = [r["doc_id"] for r in kept]
        if name == "language_id":
            assert not {300, 301, 302, 303} & set(ids) and {None, 304, 305, 306, 7, 400} <= set(ids)
        if name == "exact_dedup":
            assert ids.count(7) == 2 and 400 in ids and 8 not in ids and 9 not in ids
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r["doc_id"]: r["text"] for r in kept}
    assert {r["doc_id"] for r in out} == set(texts)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
