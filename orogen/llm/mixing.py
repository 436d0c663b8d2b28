"""Mixing sources to target weights: iterative proportional fitting, natively.

Tokens are summed into cells of (source, language, topic); only this small
table takes part in the fitting. Each round scales the cells' weights to each
margin's targets in turn, by window sums. A document's probability is its
cell's weight over its cell's tokens, scaled so that the largest is 1: expected
kept tokens then meet all three margins at once, with as much text as that
allows. The draw compares the probability with a hash of the doc_id, so it does not
depend on partitioning, order or retries.

Targets are shares by value for each margin. Without them a margin's targets are
its token shares to the power ``temper``, normalised.

Cases: a null source or language is a value of its own. A document
without tokens takes its cell's probability; a cell without tokens has probability 1, as it
cannot move a margin. Repeated rows share their draw. Texts of any length are
counted whole. Extra columns stay in ``doc``. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kit import Workspace

MARGINS = ["m_source", "m_lang", "m_topic"]
WORD = r"[^\x20\x09-\x0D]+"


def value_of(c: Column) -> Column:
    """A margin's value as text that keeps nulls apart."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("?"))


def topic_of(text: Column, tokens: Column) -> Column:
    """The text's form, in place of a topic column: table, note, article or book."""
    return F.when(F.contains(text, F.lit(" | ")), "table").when(tokens < 100, "note").when(tokens < 1000, "article").otherwise("book")


def draw(doc_id: Column, seed: int) -> Column:
    """A uniform number in [0, 1) from a hash of the doc_id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tempered(cells: DataFrame, margin: str, temper: float) -> DataFrame:
    """(margin, share): token shares to a power, normalised over all values."""
    mass = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("mass"))
    mass = mass.withColumn("raised", F.when(F.col("mass") > 0, F.pow("mass", F.lit(temper))).otherwise(F.lit(0.0)))
    total = mass.agg(F.sum("raised")).first()[0] or 0.0
    return mass.select(margin, (F.col("raised") / F.lit(total) if total else F.lit(0.0)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, store: Workspace) -> DataFrame:
    """Adds ``weight`` to the cells: proportional fitting of tokens to the targets."""
    for margin, target in targets.items():
        cells = cells.join(target.withColumnRenamed("share", f"share_{margin}"), margin, "left").fillna(0.0, [f"share_{margin}"])
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    for turn in range(rounds):
        for margin in targets:
            total = F.sum("weight").over(Window.partitionBy(margin))
            fitted = fitted.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"share_{margin}") / total).otherwise(F.lit(0.0)))
        if turn % 4 == 3 or turn == rounds - 1:
            fitted = store.save(fitted, f"raked-{turn}")
    return fitted


def mix_sources(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = 0.7, rounds: int = 12, seed: int = 17, topic: Column | None = None, tokens: Column | None = None, store: Workspace | None = None) -> DataFrame:
    """(doc, topic, n_tokens, probability, kept) of every row."""
    store = store or Workspace(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("doc"))
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    rows = rows.withColumn("n_tokens", (tokens if tokens is not None else F.regexp_count(text, F.lit(WORD))).cast("long"))
    rows = rows.withColumn("topic", topic if topic is not None else topic_of(text, F.col("n_tokens")))
    rows = rows.withColumns(dict(zip(MARGINS, [value_of(F.col("doc.source")), value_of(F.col("doc.lang")), value_of(F.col("topic"))], strict=True)))
    cells = store.save(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    targets = targets or {m: tempered(cells, m, temper) for m in MARGINS}
    fitted = rake(cells, targets, rounds, store)
    scale = fitted.filter("weight > 0").agg(F.min(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    odds = F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), F.col("weight") * scale / F.greatest("tokens", F.lit(1))), 9))
    chance = store.save(fitted.select(*MARGINS, odds.alias("probability")), "chance")
    drawn = rows.join(chance, MARGINS, "left")
    return drawn.select("doc", "topic", "n_tokens", "probability", (draw(F.col("doc.doc_id"), seed) < F.col("probability")).alias("kept"))


def oracle(temper: float = 0.7, rounds: int = 12, seed: int = 17) -> str:
    steps, last = [], "c0"
    for turn in range(rounds):
        for m in MARGINS:
            name = f"r{turn}_{m}"
            steps.append(f"{name} AS (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {m}) > 0 THEN weight * share_{m} / sum(weight) OVER (PARTITION BY {m}) ELSE 0 END AS weight) FROM {last})")
            last = name
    shares = ", ".join(f"t_{m} AS (SELECT {m}, CASE WHEN sum(raised) OVER () > 0 THEN raised / sum(raised) OVER () ELSE 0 END AS share_{m} FROM (SELECT {m}, CASE WHEN sum(tokens) > 0 THEN pow(CAST(sum(tokens) AS DOUBLE), {temper}) ELSE 0 END AS raised FROM cells GROUP BY {m}))" for m in MARGINS)
    joined = " ".join(f"JOIN t_{m} USING ({m})" for m in MARGINS)
    return rf"""
WITH w AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
d AS (SELECT *, CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'book' END AS topic FROM w),
v AS (SELECT *, coalesce('=' || source, '?') AS m_source, coalesce('=' || lang, '?') AS m_lang, '=' || topic AS m_topic FROM d),
cells AS (SELECT m_source, m_lang, m_topic, sum(n_tokens) AS tokens FROM v GROUP BY ALL),
{shares},
c0 AS (SELECT *, CAST(tokens AS DOUBLE) AS weight FROM cells {joined}),
{", ".join(steps)},
s AS (SELECT min(tokens / weight) AS scale FROM {last} WHERE weight > 0),
p AS (SELECT m_source, m_lang, m_topic, CASE WHEN tokens = 0 THEN 1.0 ELSE round(least(1.0, weight * coalesce(scale, 0) / greatest(tokens, 1)), 9) END AS probability FROM {last} CROSS JOIN s)
SELECT doc_id, source, lang, topic, n_tokens, CAST(probability AS DOUBLE) AS probability,
       CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 < probability AS kept
FROM v JOIN p USING (m_source, m_lang, m_topic)
"""
