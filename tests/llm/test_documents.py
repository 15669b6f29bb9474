"""Mixing, language ID and quality rules."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from marlstone.llm import language_id, mixing, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, topic string, weight long, p double, quality int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 0.5, 1) for r in rows], SCHEMA)


ROWS = [(k, f"word {'more ' * (k % 9)}{'a | b | c' if k % 5 == 0 else ''}", ["en", "fr", None][k % 3], f"s{k % 4 if k % 2 else 0}") for k in range(400)] + [(400, None, None, None), (401, "", "en", "s0"), (401, "", "en", "s0"), (None, "x", "en", "s1"), (402, "long " * 50_000, "de", "s9")]


def test_mixing_equals_sql(spark):
    docs = frame(spark, ROWS)
    out = mixing.calibrated(mixing.described(docs))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", ROWS)
    want = sorted(map(repr, con.execute(mixing.SQL).fetchall()))
    got = out.select("doc_id", F.col("__ms_topic").alias("topic"), F.col("__ms_weight").alias("weight"), F.col("__ms_p").alias("p"), F.col("__ms_kept").alias("kept"))
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert mixing.sample_mixed(docs).columns == docs.columns
    assert mixing.sample_mixed(frame(spark, [])).count() == 0


CELLS = [(s, la, t, 10 * (i + 1) * (j + 2) + 7 * k) for i, s in enumerate("ab") for j, la in enumerate(["en", "fr"]) for k, t in enumerate("xyz")]
CELL = "source string, lang string, topic string, weight long"


def shares(odds, d):
    """Share of the sampled weight by value, and the sampled weight."""
    got = {}
    for r in odds:
        got[r[d]] = got.get(r[d], 0.0) + r["p"] * r["weight"]
    return {k: v / sum(got.values()) for k, v in got.items()}, sum(got.values())


@pytest.mark.parametrize("budget", [0.05, 0.5, 0.9])
def test_rake_meets_targets(spark, budget):
    """At the production settings, with cells that fill up, and a budget that the targets cannot have."""
    targets = {"source": {"a": 0.7, "b": 0.3}, "lang": {"en": 0.5, "fr": 0.5}, "topic": {"x": 0.2, "y": 0.3, "z": 0.5, "none": 0.4}}
    odds = mixing.rake(spark.createDataFrame(CELLS, CELL), targets, budget).collect()
    assert all(0 <= r["p"] <= 1 for r in odds)
    for d, wanted in targets.items():
        got, spent = shares(odds, d)
        live = {k: v for k, v in wanted.items() if k in got}
        assert all(got[k] == pytest.approx(v / sum(live.values()), rel=2 * mixing.TOLERANCE) for k, v in live.items())
    total = sum(c[3] for c in CELLS)
    own = {d: shares([dict(zip(("source", "lang", "topic", "weight", "p"), (*c, 1.0), strict=True)) for c in CELLS], d)[0] for d in targets}
    most = min(own[d][k] / (v / sum(w for x, w in of.items() if x in own[d])) for d, of in targets.items() for k, v in of.items() if k in own[d])
    assert spent <= budget * total * 1.01 and (budget > 0.3 or spent == pytest.approx(budget * total, rel=0.01)) and spent > 0.3 * min(budget, most) * total


def test_targets_that_contradict_each_other(spark):
    cells = spark.createDataFrame([("a", "en", "x", 50), ("b", "fr", "x", 50)], CELL)
    with pytest.warns(UserWarning, match="contradict"):
        mixing.rake(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "fr": 0.9}})


def corpus(spark, n):
    """Sources, languages and topics of very unlike shares, by the row's number."""
    k = F.col("id")
    source = F.when(k % 3 == 0, "hot").when(k % 50 == 1, "rare").otherwise(F.concat(F.lit("s"), (k % 5).cast("string")))
    text = F.concat(F.lit("w "), F.repeat(F.lit("w "), (k % 7).cast("int")), F.when(k % 11 == 0, "a | b").when(k % 13 == 0, "license").otherwise("x"))
    return spark.range(n).select(k.alias("doc_id"), text.alias("text"), F.when(k % 17 < 12, "en").when(k % 17 < 16, "fr").alias("lang"), source.alias("source"))


def test_sample_meets_shipped_targets(spark):
    """The drawn documents themselves, not their expectation, are within 1 % of each target share."""
    docs = corpus(spark, 400_000)
    out = mixing.calibrated(mixing.described(docs)).select(*[F.col(f"__ms_{d}").alias(d) for d in mixing.DIMENSIONS], F.col("__ms_weight").alias("w"), F.col("__ms_kept").alias("kept"))
    cells = out.groupBy(*mixing.DIMENSIONS).agg(F.sum("w").alias("weight"), F.sum(F.when(F.col("kept"), F.col("w")).otherwise(0)).alias("drawn")).collect()
    total, drawn = sum(r["weight"] for r in cells), sum(r["drawn"] for r in cells)
    for d in mixing.DIMENSIONS:
        own = Counter()
        got = Counter()
        for r in cells:
            own[r[d]] += r["weight"] / total
            got[r[d]] += r["drawn"] / drawn
        z = sum(v**mixing.TEMPER for v in own.values())
        goal = {k: min(v**mixing.TEMPER / z, mixing.RAISE * v) for k, v in own.items()}
        assert all(got[k] == pytest.approx(g / sum(goal.values()), rel=0.01) for k, g in goal.items()), d
        assert any(abs(own[k] / got[k] - 1) > 0.03 for k in own)
    assert drawn > 0.8 * total


def test_topics_of_a_column(spark):
    docs = frame(spark, ROWS)
    assert mixing.described(docs, topic_col="topic").select("__ms_topic").distinct().collect() == [("t",)]
    assert mixing.sample_mixed(docs, {"topic": {"t": 1.0}}, topic_col="topic").columns == docs.columns


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.op7_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)


def test_language_ignores_what_it_must_not_see(spark, sf):
    """Held-out rows, languages and sources of predicted rows change nothing."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    noisy = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    again = language_id.fit(noisy)
    assert model.langs == again.langs and model.words.keys() == again.words.keys()


def test_every_language_is_learned(spark):
    """A sample far smaller than the rows: languages of one row, of a few, and without ids."""
    rare = [(50_001, "zzkk zzqq", "zz", "s"), (50_003, "yyww yyvv", "yy", "s"), (50_004, "yyww", "yy", "s"), (None, "xxjj xxhh", "xx", "s")]
    rare = [r for r in rare if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5]
    docs = frame(spark, [(k, f"the house number {k}", "en", "s") for k in range(20_000)] + rare)
    model = language_id.fit(docs, sample=50)
    assert model.langs == sorted({"en"} | {r[2] for r in rare}) and len(model.langs) == 4
    assert len(model.words) < 2000


def test_language_edges(spark):
    train = [(k, t, la, "s") for k, (t, la) in enumerate([("the house is big and the dog runs", "en"), ("la maison est grande et le chien court", "fr")] * 20)]
    model = language_id.fit(frame(spark, train))
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, "123 !?", "en", "s"), (4, "the dog", "fr", "s"), (4, "the dog", "fr", "s"), (None, "le chien " * 30_000, None, "s"), (6, "grandement", None, "s")]
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in language_id.identify(frame(spark, rows), model).collect()}
    assert set(got) == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "fr"), (6, "fr")}
    assert got[1, "und"] == 0 and all(0 <= s <= 1 for s in got.values())
    kept = language_id.keep_identified(frame(spark, train + [(999, "77", "en", "s")]))
    assert kept.count() == len(train) and kept.columns == frame(spark, []).columns
    empty = frame(spark, [])
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, rows), language_id.fit(empty)).collect()} == {"und"}


def test_back_off():
    m = language_id.Model({"a": {"zzzz": 5, "zzzy": 5}, "b": {"kkkk": 5, "kkkj": 5}})
    predict = language_id.Predictor(m)
    assert predict("zzzq")[0] == "a" and predict("qkkk")[0] == "b" and predict("qqqq")[0] in "ab"


def brute_language(counts, text):
    """The rule itself: per token, log frequency of a known word, else of the longest n-grams of which any is known."""
    langs = sorted(counts)
    vocabulary = sorted({w for la in langs for w in counts[la]})
    share = lambda n, total, kinds: math.log((n + 0.5) / (total + 0.5 * kinds))
    grams = {size: {la: Counter() for la in langs} for size in range(1, 5)}
    for la in langs:
        for w, n in counts[la].items():
            for size in grams:
                for i in range(len(w) + 2 - size + 1):
                    grams[size][la][f"^{w}$"[i : i + size]] += n
    tokens = regex.findall(r"\p{L}+", (text or "").lower())
    if not tokens or not langs:
        return "und", 0.0
    total = {la: 0.0 for la in langs}
    for w in tokens:
        if w in vocabulary:
            for la in langs:
                total[la] += share(counts[la].get(w, 0), sum(counts[la].values()), len(vocabulary))
            continue
        for size in range(min(4, len(w) + 2), 0, -1):
            kinds = {g for la in langs for g in grams[size][la]}
            found = [g for i in range(len(w) + 2 - size + 1) if (g := f"^{w}$"[i : i + size]) in kinds]
            if found:
                for la in langs:
                    total[la] += sum(share(grams[size][la][g], sum(grams[size][la].values()), len(kinds)) for g in found) / len(found) + math.log(0.4) * (5 - size)
                break
    best = max(langs, key=lambda la: (total[la], [-ord(c) for c in la]))
    return best, 1 / sum(math.exp(total[la] - total[best]) for la in langs)


def test_scores_equal_brute_force():
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 8)))
    counts = {la: {word(letters): rng.randrange(1, 30) for _ in range(60)} for la, letters in (("aa", "abcdeß"), ("bb", "cdefgé"), ("cc", "efghij"))}
    predict = language_id.Predictor(language_id.Model(counts))
    known = [w for of in counts.values() for w in of]
    texts = [" ".join(rng.choice([rng.choice(known), word("abcdefghijßé"), word("xyzü"), "Ⅻ", "½", "x²a", "7"]) for _ in range(rng.randrange(0, 14))) for _ in range(200)] + [None, "", "½ ² ①", "a\u0301b", "A" * 3000]
    for text in texts:
        got, want = predict(text), brute_language(counts, text)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-4), text
    assert predict("½ ² ①") == ("und", 0.0)


def test_all_words_of_the_sample_are_known(spark):
    docs = frame(spark, [(k, " ".join(f"w{chr(97 + k % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(200)), "en", "s") for k in range(100)])
    model = language_id.fit(docs)
    held = {k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert len(model.words) == 200 * len({k % 26 for k in range(100) if k not in held})


def test_cache_changes_nothing(monkeypatch):
    m = language_id.Model({"a": {"ab": 5, "ba": 2}, "b": {"bc": 4, "cb": 1}})
    texts = ["abab bcbc ab", "cbcb zz abab", None, "abab bcbc ab", "ba bb bbb"]
    with_cache = [language_id.Predictor(m)(t) for t in texts]
    monkeypatch.setattr(language_id, "CACHE", 1)
    without = [language_id.Predictor(m)(t) for t in texts]
    assert [x[0] for x in with_cache] == [x[0] for x in without] and all(abs(x[1] - y[1]) < 1e-5 for x, y in zip(with_cache, without, strict=True))


def brute_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, sf):
    extra = [None, "", " \n\t", "a b c a b c", "a b c b c a b c", "é 𝔘 é\né 𝔘 é\n \n \n", "# | <x> \r\n# | <x> \r\n", "z " * 60_000]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_rules.judge(docs.withColumn("kept", F.lit(1)), None).collect():
        want = brute_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)


def test_viterbi_is_the_best_sequence():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(20):
        f = quality_rules.Field(rng.normal(size=(quality_rules.N_FEATURES, 2)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(7, quality_rules.N_FEATURES))
        s = x @ f.emit
        score = lambda y: sum(s[i, y[i]] for i in range(7)) + sum(f.move[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=7), key=score)
        assert tuple(f.decode(x)) == best


def test_quality_held_out(spark, sf):
    """Fitted on half of the labels, judged on the others."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    field = quality_rules.fit_field(*quality_rules.sampled(docs, labels.where("doc_id % 2 = 0")))
    got = quality_rules.judge(docs, field).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    good, bad = [r["kept"] for r in got if r["quality"]], [r["kept"] for r in got if not r["quality"]]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.4 * len(bad)


def test_quality_edges(spark, sf):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.fit_field(*quality_rules.sampled(frame(spark, []), empty)) is None
    assert quality_rules.judge(frame(spark, []), None).count() == 0
    assert quality_rules.fit_field(["a b", None], [1, 1]) is None
    rows = [(1, None, None, None), (None, "a b c d " * 20, None, None), (2, "w" + " x y z" * 3, "en", "s"), (2, "w", "en", "s")]
    assert quality_rules.judge(frame(spark, rows), None).count() == 4
