"""Exact, near and passage dedup against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import bloom, components, exact_dedup, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, fp string, __key string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", "x", "y") for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "same text"), (5, "same  text"), (6, "sametext "), (7, "same text"), (7, "same text"), (None, "same text!"), (None, "same text!"), (8, "unique é 𝔘"), (9, "x " * 60_000)]


def brute_exact(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
        groups.setdefault(key, []).append((-len(t or ""), i is None, i or 0, i))
    return sorted((str(i), str(min(g)[3]), len(g), key) for key, g in groups.items() for *_, i in g)


def test_exact(spark):
    got = exact_dedup.exact_groups(frame(spark, EDGES)).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == brute_exact(EDGES)
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
    left = exact_dedup.exact_dedup(frame(spark, EDGES))
    assert left.columns == frame(spark, []).columns and left.count() == sum(r["kept"] for r in got)
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in got if r["kept"]}


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0 and exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_bloom_lets_few_pass(spark):
    keys = exact_dedup._keys(frame(spark, [(i, f"text {i if i % 10 else 0}") for i in range(3000)]), "doc_id", "text")
    passed = bloom.probe(keys, exact_dedup.repeated_slots(keys, 3000), bloom.block_bits(3000 * exact_dedup.BITS_PER_ROW), 1 << 20).where("__ms_maybe").count()
    assert 300 <= passed <= 420


def many(spark, n=12_000):
    """A third of all rows are one text, others come twice, most once; every copy's length differs; extra columns clash."""
    body = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.concat(F.lit("twin "), F.floor(F.col("id") / 1000).cast("string"))).otherwise(F.concat(F.lit("text "), F.col("id").cast("string")))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(body, F.repeat(F.lit(" "), (F.col("id") % 5).cast("int"))).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit("x").alias("fp"), F.lit("y").alias("kept"))


def moves(plan, source):
    """For each shuffle of what is read from the source: the nodes below it."""
    lines = plan.split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for k, x in enumerate(lines):
        if "Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x or "Exchange Round" in x:
            stop = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            if any(source in y for y in lines[k:stop]):
                out.append(lines[k:stop])
    return out


@pytest.mark.parametrize("most", [exact_dedup.BROADCAST_BYTES, 20_000, 1])
def test_no_size_changes_what_is_kept_or_moves_texts(spark, monkeypatch, most):
    """One broadcast, a few segments of the filter, and a segment a block with losers told by a filter of their own."""
    docs = many(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute_exact(rows)
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        groups = exact_dedup.exact_groups(docs).collect()
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in groups) == want
        stay = exact_dedup.exact_dedup(docs)
        plan = stay._jdf.queryExecution().executedPlan().toString()
        # Documents are shuffled only where a filter of many losers' ids lets them pass.
        moved = moves(plan, "Range (")
        assert len(moved) == (0 if most > 70_000 else 1), plan
        assert all(any("Filter" in x and "__ms_bits" in x for x in below) for below in moved)
        assert sorted(r["doc_id"] for r in stay.select("doc_id").collect()) == sorted({int(w[1]) for w in want})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exact_dedup_tells_rows_of_one_id_apart(spark):
    rows = [(1, "a"), (1, "a "), (1, " a"), (1, "b"), (2, "b"), (None, "c"), (None, "c"), (None, "d"), (3, "d"), (4, "e"), (4, "e"), (5, "e  ")]
    left = exact_dedup.exact_dedup(frame(spark, rows))
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted([("1", " a"), ("1", "b"), ("None", "c"), ("3", "d"), ("5", "e  ")])


def brute_print(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, bits=3):
    """Component (as the smallest index) of each fingerprint."""
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_simhash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    prints = [brute_print(t) for _, t in rows]
    want = {i: (f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, brute_groups(prints), strict=True)}
    got = simhash.simhash_groups(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want
    left = simhash.near_dedup(docs)
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == sorted({c for _, c in want.values()})


def test_simhash_edges(spark):
    got = {r["doc_id"]: r for r in simhash.simhash_groups(frame(spark, [x for x in EDGES if x[0] is not None])).collect()}
    assert {got[i]["component_id"] for i in (1, 2, 3)} == {1} and got[1]["fingerprint"] == "0" * 16
    assert got[4]["component_id"] == got[5]["component_id"] == got[7]["component_id"] == 4
    assert simhash.simhash_groups(frame(spark, [])).count() == 0 and simhash.near_dedup(frame(spark, [])).count() == 0
    assert simhash.near_dedup(frame(spark, [(1, "a b c"), (2, "a b c"), (None, "a b c")])).count() == 2


def test_near_dedup_keeps_one_of_each_group(spark):
    """Ids that come twice: in two groups, in one group, as the smallest of both, and with the same row."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    left = simhash.near_dedup(frame(spark, [(1, a), (2, a), (2, b), (3, c), (3, d), (4, d), (5, "x y z"), (5, "x y z"), (5, "X y z")]))
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted([(1, a), (2, b), (3, c), (3, d), (5, "X y z")])
    assert left.columns == frame(spark, []).columns


@pytest.mark.parametrize("chunk, split", [(16, 20), (4, 2), (2, 1)])
def test_dense_bucket_keeps_all_links(spark, monkeypatch, chunk, split):
    """Several hundred fingerprints in chains within a few blocks, cut into small chunks and split by further blocks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = random.Random(1)
    start = rng.getrandbits(64)
    prints = {start}
    while len(prints) < 200:
        x = rng.choice(sorted(prints))
        for _ in range(rng.choice([1, 3, 3, 4, 5])):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints |= {start ^ rng.getrandbits(12) << 3 for _ in range(150)}
    prints = sorted(prints)
    signed = [int(np.array([p], np.uint64).view(np.int64)[0]) for p in prints]
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), len(signed))
    root = {r["node"]: r["root"] for r in components.components(links).collect()}
    got = [root.get(s, s) for s in signed]
    want = brute_groups(prints)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_finer_blocks_cover_every_link():
    rng = random.Random(4)
    for m in (5, 8, 12):
        for mask in simhash._masks(m, 3):
            finer = [x & (1 << 64) - 1 for x in simhash._finer(mask, 3)]
            assert len(finer) == 20 and all(x & mask & (1 << 64) - 1 == mask & (1 << 64) - 1 for x in finer)
            free = [p for p in range(64) if not mask >> p & 1]
            for _ in range(20):
                d = 0
                for _ in range(3):
                    d |= 1 << rng.choice(free)
                assert any(d & x == 0 for x in finer)


@pytest.mark.parametrize("ids", [simhash.BROADCAST_IDS, 0])
def test_near_dedup_by_broadcast_and_by_shuffle(spark, sf, monkeypatch, ids):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", ids)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["component_id"] for r in simhash.simhash_groups(docs).select("component_id").collect()}
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs).select("doc_id").collect()) == sorted(want)


def test_simhash_of_a_larger_table(spark):
    """Queries of the stated set, every id divisible by 50, against all documents of sf0.1: no link is lost, none is made up."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    ids, fps = np.array(list(got)), np.array([x for x, _ in got.values()], np.uint64)
    of = np.array([c for _, c in got.values()])
    for q in ids[ids % 50 == 0]:
        near = np.bitwise_count(fps ^ fps[np.flatnonzero(ids == q)[0]]) <= 3
        assert len(set(of[near])) == 1
    for c in np.unique(of):  # a component is connected by links of its own
        group = fps[of == c]
        label = brute_groups([int(x) for x in np.unique(group)]) if len(group) < 400 else [0]
        assert len(set(label)) == 1 and c == ids[of == c].min()


def test_blocks_cover_every_link():
    for m in (5, 6, 7, 8):
        masks = [x & (1 << 64) - 1 for x in simhash._masks(m, 3)]
        rng = random.Random(m)
        for _ in range(200):
            d = 0
            for _ in range(3):
                d |= 1 << rng.randrange(64)
            assert any(d & mask == 0 for mask in masks)
    assert simhash.block_count(1000) <= simhash.block_count(10**9) <= simhash.block_count(10**11)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=30))
def test_components(spark, pairs):
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for a, b in pairs:
        if a != b:
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got.keys() == label.keys()
    assert len({(got[k], label[k]) for k in got}) == len(set(got.values())) == len(set(label.values()))


def test_long_chain(spark):
    pairs = [(i, i + 1) for i in range(300)]
    assert len({r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}) == 1


def brute_passages(rows, window=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((str(i), len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out)


def passages():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [text(n) for n in (49, 50, 51, 80, 120)]
    rows = []
    for i in range(60):
        parts = text(rng.randrange(0, 60))
        for s in rng.sample(shared, rng.randrange(0, 4)):
            parts += s + text(rng.randrange(0, 40))
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(60, rows[5][1]), (61, rows[5][1]), (62, None), (63, ""), (64, "same " * 300), (65, "same " * 120), (66, " é " * 70), (66, " é " * 70), (67, " é " * 70), (None, rows[5][1])]
    return rows


@pytest.mark.parametrize("filter_bytes", [substring_dedup.FILTER_BYTES, 1])
def test_passages(spark, filter_bytes):
    rows = passages()
    got = substring_dedup.substring_dedup(frame(spark, rows), digest=True, filter_bytes=filter_bytes).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_passages(rows)


def test_passages_of_a_larger_table(spark):
    """Every document of sf0.01 that is queried (id divisible by 50) against all documents of it, by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = {int(r[0]): r[1:] for r in brute_passages(rows)}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs, digest=True).collect()}
    assert got == want and sum(n > 0 for _, n, _ in want.values()) > 50


def test_passages_as_text_and_empty(spark):
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0
    got = {r["doc_id"]: r["kept"] for r in substring_dedup.substring_dedup(frame(spark, [(1, "a\tb"), (2, None)])).collect()}
    assert got == {1: "a b", 2: ""}


def test_cover():
    p, d = substring_dedup.PERIOD, substring_dedup.COVER
    assert all(any((i + s) % p in d and (j + s) % p in d for s in range(p)) for i in range(p) for j in range(p))


def test_long_text_hashes(spark):
    text = " ".join(f"w{k % 997}" for k in range(100_000))
    got = substring_dedup.substring_dedup(frame(spark, [(1, text), (2, "start " + text)]), digest=True).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 100_000}
