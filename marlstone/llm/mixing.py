"""Mixing documents to target weights by iterative proportional fitting, in DataFrame functions only.

Token weights are summed by cell (source, language, topic). Cells are raked: their inclusion ratios are scaled until each
source has its target share of the sampled weight, then each language, then each topic, round after round. A ratio counts
for at most 1, since a document is sampled once at most; what a full cell cannot give, the cells beside it do. ``ROUNDS``
rounds are a block; after each the largest relative error of any share is measured, and blocks go on until it is under
``TOLERANCE`` or falls no further. If it does not get there, the targets ask for more than there is, and the next smaller
part of the budget in ``PARTS`` is tried; once no cell is full, targets that still cannot be met contradict each other, which
causes a warning with what is left of the error. A document is sampled with its cell's ratio as probability. Its draw is
a hash of its id, the same in every run and on every cluster.

Targets are shares by value. Where none are given, they are the observed shares raised to ``TEMPER``, no value raised by more
than ``RAISE`` before they are scaled to one, which moves weight from heavy values to light ones. The budget is the given
share of all tokens, less if a value would need more than ``MARGIN`` of what it has. Cells and their sums are tables,
whose rows are as many as combinations of values; only totals and errors reach the driver.

Defined cases: null values of source, language and topic are a value of their own, the same as empty ones; a text without
words weighs one token, and texts of any length are counted whole; values without a target keep their observed share;
targets for values that do not occur are left out and the others scaled; rows that repeat an id are drawn alike, those without
an id by their text; a draw equal to the probability is not kept; an empty table gives an empty result. Extra columns are
kept, unless their names begin with ``__ms_``.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, release, table

ROUNDS = 4
TOLERANCE = 0.002
#: The error falls no further if a block leaves more than this share of it.
STALLED = 0.8
PARTS = (1.0, 0.7, 0.4, 0.1)
TEMPER = 0.95
RAISE = 1.1
BUDGET = 0.9
MARGIN = 0.95
SEED = "mix-1"
DIMENSIONS = ("source", "lang", "topic")
#: Sums by value that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Topic by what a text holds, where no column has it: (name, strings or None, pattern). The first that is found wins, else ``prose``.
TOPICS = (("licence", None, r"(?i)licen[sc]e"), ("listing", " | ", None), ("shouted", "!! ", None), ("symbols", None, r"[#$%&*]{3} "))


def weight_of(text: Column) -> Column:
    """Words of the text, at least one."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return (F.char_length(line) - F.char_length(F.replace(line, F.lit(" "))) + 1).cast("long")


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, part, pattern in reversed(TOPICS):
        out = F.when(text.contains(part) if part else text.rlike(pattern), name).otherwise(out)
    return out


def draw(id_col: Column, text: Column) -> Column:
    """A number in [0, 1) from 32 bits of a hash."""
    digest = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(id_col.cast("string"), F.md5(F.coalesce(text, F.lit(""))))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _each(cells: DataFrame, *more: Column) -> DataFrame:
    """A row for each cell and dimension: dim, value."""
    pair = [F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"), *([F.col(f"goal_{d}").alias("goal")] if f"goal_{d}" in cells.columns else [])) for d in DIMENSIONS]
    return cells.select(F.explode(F.array(*pair)).alias("of"), *more).select("of.*", *[c for c in cells.select(*more).columns])


def goals(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> tuple[DataFrame, float, float]:
    """Cells with the share that each of their values is to have (goal_source, ...), the total weight, and the budget that can be had."""
    own = cut(_each(cells, F.col("weight")).groupBy("dim", "value").agg(F.sum("weight").alias("w")), "mix-values")
    total = float(own.where(F.col("dim") == DIMENSIONS[0]).agg(F.sum("w")).first()[0] or 0)
    share = F.col("w") / F.lit(total or 1.0)
    wanted = F.lit(None).cast("double")
    tempered = own.groupBy("dim").agg(F.sum(F.pow(share, F.lit(TEMPER))).alias("z"), F.count(F.lit(1)).alias("n")).collect()
    size = {r["dim"]: r["n"] for r in tempered}
    for r in tempered:
        given = (targets or {}).get(r["dim"])
        if given:
            one = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in given.items() for x in (k or "", float(v))]), F.col("value")), share)
        else:
            one = F.least(F.pow(share, F.lit(TEMPER)) / F.lit(r["z"]), share * F.lit(RAISE))
        wanted = F.when(F.col("dim") == r["dim"], one).otherwise(wanted)
    own = cut(own.withColumn("goal", wanted), "mix-goals")
    sums = {r["dim"]: r["s"] for r in own.groupBy("dim").agg(F.sum("goal").alias("s")).collect()}
    scaled = F.lit(None).cast("double")
    for d, s in sums.items():
        scaled = F.when(F.col("dim") == d, F.col("goal") / F.lit(s)).otherwise(scaled)
    own = own.withColumn("goal", scaled)
    most = own.agg(F.max(F.col("goal") / share)).first()[0]
    for d in DIMENSIONS:
        of = own.where(F.col("dim") == d).select(F.col("value").alias(d), F.col("goal").alias(f"goal_{d}"))
        cells = cells.join(F.broadcast(of) if size.get(d, 0) <= BROADCAST_ROWS else of, d)
    return cells, total, min(budget, MARGIN / most) if most else budget


def _taken() -> Column:
    """The weight that is sampled of a cell."""
    return F.col("weight") * F.least(F.col("ratio"), F.lit(1.0))


def _round(cells: DataFrame, spent: float, few: dict[str, bool]) -> DataFrame:
    for d in DIMENSIONS:
        # Sums of partial sums, however many cells a value has.
        of = cells.groupBy(d).agg((F.max(f"goal_{d}") * F.lit(spent) / F.sum(_taken())).alias("__f"))
        cells = cells.join(F.broadcast(of) if few[d] else of, d).withColumn("ratio", F.col("ratio") * F.col("__f")).drop("__f")
    return cells


def error(cells: DataFrame, spent: float) -> tuple[float, float]:
    """The largest relative error of a share, and the largest ratio of a cell."""
    of = _each(cells, _taken().alias("t"), F.col("ratio")).groupBy("dim", "value").agg((F.sum("t") / (F.max("goal") * F.lit(spent)) - 1).alias("e"), F.max("ratio").alias("r"))
    found = of.agg(F.max(F.abs("e")).alias("e"), F.max("r").alias("r")).first()
    return float(found["e"] or 0.0), float(found["r"] or 0.0)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``p`` to cells (source, lang, topic, weight): probabilities that meet the target shares."""
    start, total, share = goals(cells, targets, budget)
    start = cut(start, "mix-cells")
    few = {d: start.select(d).distinct().count() <= BROADCAST_ROWS for d in DIMENSIONS}
    for part in PARTS:
        out = first = start.withColumn("ratio", F.lit(part * share))
        before, spent = float("inf"), part * share * total
        while True:
            for _ in range(ROUNDS):
                last, out = out, cut(_round(out, spent, few), "mix-round")
                if last is not first:
                    release(last)
            left, fullest = error(out, spent)
            if left <= tolerance or left > STALLED * before:
                break
            before = left
        if left <= tolerance or fullest <= 1:
            break
    if left > tolerance:
        warnings.warn(f"the targets contradict each other: a share is off by {left:.1%}", stacklevel=2)
    return out.select(*DIMENSIONS, "weight", F.round(F.least(F.col("ratio"), F.lit(1.0)), 6).alias("p"))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """``docs`` with ``__ms_source``, ``__ms_lang``, ``__ms_topic``, ``__ms_weight`` and ``__ms_draw``."""
    text, nil = F.col(text_col), F.lit("")
    topic = F.col(topic_col).cast("string") if topic_col else topic_of(text)
    return docs.withColumns({"__ms_source": F.coalesce(F.col(source_col).cast("string"), nil), "__ms_lang": F.coalesce(F.col(lang_col).cast("string"), nil), "__ms_topic": F.coalesce(topic, nil), "__ms_weight": weight_of(text), "__ms_draw": draw(F.col(id_col), text)})


def calibrated(seen: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """Described documents with ``__ms_p``, the probability of their cell, and ``__ms_kept``."""
    cells = seen.groupBy(*[F.col(f"__ms_{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("__ms_weight").alias("weight"))
    odds = cut(rake(cut(cells, "mix-weights"), targets, budget), "mix-odds").select(*[F.col(d).alias(f"__ms_{d}") for d in DIMENSIONS], F.col("p").alias("__ms_p"))
    side = F.broadcast(odds) if odds.count() <= BROADCAST_ROWS else odds
    return seen.join(side, [f"__ms_{d}" for d in DIMENSIONS]).withColumn("__ms_kept", F.col("__ms_draw") < F.col("__ms_p"))


def sample_mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, topic_col: str | None = None) -> DataFrame:
    """The documents that are drawn, unchanged."""
    return calibrated(described(docs, topic_col=topic_col), targets, budget).where("__ms_kept").select(docs.columns)


def op6_mixing(spark, sf_dir):
    """doc_id, topic, weight, p and kept of each document."""
    seen = described(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")).select("doc_id", "__ms_source", "__ms_lang", "__ms_topic", "__ms_weight", "__ms_draw")
    out = calibrated(cut(seen, "mix-described"))  # texts are read once
    return out.select("doc_id", F.col("__ms_topic").alias("topic"), F.col("__ms_weight").alias("weight"), F.col("__ms_p").alias("p"), F.col("__ms_kept").alias("kept"))


def _sql() -> str:
    """The fit in SQL, written out for one block of rounds, which suffice for the given tables."""
    topic = "CASE " + " ".join(f"WHEN {f'''contains(text, '{part}')''' if part else f'''regexp_matches(text, '{p}')'''} THEN '{n}'" for n, part, p in TOPICS) + " ELSE 'prose' END"
    ctes = [
        "d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents)",
        rf"s AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, greatest(len(string_split(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), ' ')), 1) AS weight, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(text))), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS draw FROM d)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(weight)::DOUBLE AS weight, sum(sum(weight)) OVER ()::DOUBLE AS total FROM s GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        ctes.append(f"v_{d} AS (SELECT {d}, sum(weight) / any_value(total) AS own FROM c GROUP BY {d})")
        ctes.append(f"w_{d} AS (SELECT {d}, own, least(pow(own, {TEMPER}) / sum(pow(own, {TEMPER})) OVER (), own * {RAISE}) AS g FROM v_{d})")
        ctes.append(f"g_{d} AS MATERIALIZED (SELECT {d}, own, g / sum(g) OVER () AS goal_{d} FROM w_{d})")
    most = ", ".join(f"(SELECT max(goal_{d} / own) FROM g_{d})" for d in DIMENSIONS)
    ctes.append(f"b AS MATERIALIZED (SELECT least({BUDGET}, {MARGIN} / greatest({most})) AS share)")
    ctes.append("r0 AS MATERIALIZED (SELECT c.*, share, share AS ratio, " + ", ".join(f"goal_{d}" for d in DIMENSIONS) + " FROM b, c" + "".join(f" JOIN g_{d} USING ({d})" for d in DIMENSIONS) + ")")
    k = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            ctes.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (ratio * (goal_{d} * (share * total) / sum(weight * least(ratio, 1.0)) OVER (PARTITION BY {d})) AS ratio) FROM r{k})")
            k += 1
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, topic, weight::BIGINT AS weight, round(least(ratio, 1.0), 6) AS p, draw < round(least(ratio, 1.0), 6) AS kept FROM s JOIN r{k} USING (source, lang, topic)".replace("SELECT doc_id, topic, weight::", f"SELECT doc_id, topic, s.weight::")


SQL = _sql()
