"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are gathered into cells (source, language, topic) with their token weight. The weights of the cells are
raked: scaled in turn so that they sum to the target of each source, each language and each topic, again and again.
A document of a cell is then drawn with a probability in proportion to raked over present weight, scaled so that
the largest is 1 (or to an expected number of tokens), by a fixed pseudo-random number made from its id. Keys and
token counts of a text are made once and written; only the cells are shuffled, after a partial sum in each task, and the
text is not moved. Targets that no weights can meet leave gaps, which gaps() shows.

Targets are shares by key; where none are given, a dimension's own shares are tempered (raised to ALPHA and
normalised), which lifts rare sources and languages. The topic of a text is the first of TOPICS whose pattern it
holds, else general.

Defined cases: null sources and languages are a group of their own, written as an empty string; null and empty
texts have no tokens, are of topic general and are drawn with their cell's probability; a cell without tokens has
probability 0 unless it is all there is; keys without a target have target 0; an id decides a document's number, so
rows that repeat share a decision; an empty table gives an empty result; a column of the input named _mix_source,
_mix_lang, _mix_topic, _mix_tokens, _mix_probability or _mix_kept gives way in calibrated(), and stays as it is in
sample_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_of, documents, materialize

ALPHA = 0.9
ROUNDS = 8
SEED = "mix-1"
#: First match wins.
TOPICS = {
    "legal": r"[Ll]icen[cs]ed|[Ll]icen[cs]e|[Cc]opyright|All rights reserved",
    "contact": r"[0-9A-Za-z]@[0-9A-Za-z]|https?://",
    "tabular": r" \| ",
}
DIMENSIONS = ("source", "lang", "topic")
#: Cells up to which their table is broadcast to the documents.
BROADCAST_CELLS = 50_000


def topic_of(text: Column) -> Column:
    out = F.lit("general")
    for name, pattern in reversed(TOPICS.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def drawn_number(doc_id: Column, seed: str = SEED) -> Column:
    """A number in 0..1 from the id: 52 bits of an MD5."""
    code = F.md5(F.concat(doc_id.cast("string"), F.lit(":" + seed)).cast("binary"))
    return F.conv(F.substring(code, 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_cells(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({
        "_mix_source": F.coalesce(F.col("source"), F.lit("")), "_mix_lang": F.coalesce(F.col("lang"), F.lit("")),
        "_mix_topic": topic_of(text), "_mix_tokens": tokens_of(text),
    })


def cells_of(docs: DataFrame) -> DataFrame:
    """source, lang, topic, mass, n_docs of each cell, in the shared folder; in one partition where they are few."""
    cells = docs.groupBy(*(F.col(f"_mix_{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("_mix_tokens").cast("double").alias("mass"), F.count("*").alias("n_docs"))
    found = materialize(cells, "cells")
    return found.coalesce(1) if found.count() <= BROADCAST_CELLS else found


def tempered(cells: DataFrame, dim: str, alpha: float) -> DataFrame:
    """(key, share): a dimension's shares of the mass, raised to alpha and normalised."""
    sums = cells.groupBy(F.col(dim).alias("key")).agg(F.sum("mass").alias("mass")).where("mass > 0")
    total = sums.agg(F.sum("mass").alias("total"))
    power = sums.crossJoin(F.broadcast(total)).select("key", F.pow(F.col("mass") / F.col("total"), F.lit(alpha)).alias("power"))
    return power.crossJoin(F.broadcast(power.agg(F.sum("power").alias("all")))).select("key", (F.col("power") / F.col("all")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """The cells with weight: mass shares scaled in turn to the targets (key, share) of each dimension."""
    now = cells
    for dim, target in targets.items():
        now = now.join(target.select(F.col("key").alias(dim), F.col("share").alias(f"target_{dim}")), dim, "left")
    total = F.broadcast(cells.agg(F.sum("mass").alias("total")))
    now = now.crossJoin(total).withColumn("weight", F.col("mass") / F.col("total"))
    for _ in range(rounds):
        for dim in targets:
            present = F.sum("weight").over(Window.partitionBy(dim))
            now = now.withColumn("weight", F.when(present > 0, F.col("weight") * F.coalesce(f"target_{dim}", F.lit(0.0)) / present).otherwise(0.0))
    return now


def gaps(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """dim, key, target, reached of raked cells: how far each marginal is from its target."""
    out = None
    for dim, target in targets.items():
        own = raked.groupBy(F.col(dim).alias("key")).agg(F.sum("weight").alias("reached"))
        both = own.join(target.select("key", F.col("share").alias("target")), "key", "full")
        part = both.select(F.lit(dim).alias("dim"), "key", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("reached", F.lit(0.0)).alias("reached"))
        out = part if out is None else out.union(part)
    return out


def probabilities(cells: DataFrame, targets: dict[str, DataFrame] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, tokens: float | None = None) -> DataFrame:
    """source, lang, topic, weight, probability of each cell, in the shared folder.

    With tokens, the draw is expected to hold so many tokens, less where a cell has not enough of them.
    """
    goals = targets or {d: materialize(tempered(cells, d, alpha), f"target-{d}") for d in DIMENSIONS}
    ratio = F.when(F.col("mass") > 0, F.col("weight") * F.col("total") / F.col("mass")).otherwise(0.0)
    raked = materialize(rake(cells, goals, rounds).withColumn("ratio", ratio), "raked")
    most = F.broadcast(raked.agg(F.max("ratio").alias("most"), F.sum("weight").alias("sum"), F.max("total").alias("tokens")))
    scaled = F.col("ratio") / F.col("most") if tokens is None else F.col("ratio") * F.lit(float(tokens)) / (F.col("tokens") * F.col("sum"))
    chance = F.when(F.col("most") > 0, F.least(F.lit(1.0), scaled)).otherwise(1.0)
    return materialize(raked.crossJoin(most).select(*DIMENSIONS, "weight", chance.alias("probability")), "chances")


def _drawn(dealt: DataFrame, targets: dict[str, DataFrame] | None, tokens: float | None) -> DataFrame:
    chances = probabilities(cells_of(dealt), targets, tokens=tokens)
    keyed = chances.select(*(F.col(d).alias(f"_mix_{d}") for d in DIMENSIONS), F.col("probability").alias("_mix_probability"))
    small = chances.count() <= BROADCAST_CELLS
    joined = dealt.join(F.broadcast(keyed) if small else keyed, [f"_mix_{d}" for d in DIMENSIONS])
    number = F.coalesce(drawn_number(F.col("_mix_id")), F.lit(0.0))
    return joined.withColumn("_mix_kept", number < F.col("_mix_probability")).drop("_mix_id")


def calibrated(docs: DataFrame, targets: dict[str, DataFrame] | None = None, tokens: float | None = None) -> DataFrame:
    """docs with _mix_source, _mix_lang, _mix_topic, _mix_tokens, _mix_probability and _mix_kept."""
    return _drawn(materialize(with_cells(docs).withColumn("_mix_id", F.col("doc_id")), "dealt"), targets, tokens)


def sample_documents(docs: DataFrame, targets: dict[str, DataFrame] | None = None, tokens: float | None = None) -> DataFrame:
    """The rows of docs that are drawn, with the columns of docs, whatever their names."""
    whole = docs.select(F.struct(*columns_of(docs)).alias("_doc"), docs["doc_id"].alias("_mix_id"), docs["text"], docs["source"], docs["lang"])
    dealt = materialize(with_cells(whole).drop("text", "source", "lang"), "dealt")
    return _drawn(dealt, targets, tokens).where("_mix_kept").select("_doc.*")


def op2_raked_mixing(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    dealt = materialize(with_cells(docs).select("doc_id", F.col("doc_id").alias("_mix_id"), *(f"_mix_{c}" for c in (*DIMENSIONS, "tokens"))), "dealt")
    return _drawn(dealt, None, None).select(
        "doc_id", F.col("_mix_source").alias("source_key"), F.col("_mix_lang").alias("lang_key"), F.col("_mix_topic").alias("topic"),
        F.col("_mix_tokens").alias("n_tokens"), F.round("_mix_probability", 6).alias("probability"), F.col("_mix_kept").alias("kept"),
    )


def _sql() -> str:
    topic = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in TOPICS.items())
    out = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source_key, coalesce(lang, '') AS lang_key, coalesce(text, '') AS t FROM documents),
f AS MATERIALIZED (SELECT doc_id, source_key, lang_key, CASE {topic} ELSE 'general' END AS topic,
  CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM d),
c AS MATERIALIZED (SELECT source_key, lang_key, topic, CAST(sum(n_tokens) AS DOUBLE) AS mass FROM f GROUP BY ALL),
"""
    for k in ("source_key", "lang_key", "topic"):
        out += f"""s_{k} AS (SELECT {k}, sum(mass) AS m FROM c GROUP BY {k} HAVING sum(mass) > 0),
p_{k} AS (SELECT {k}, pow(m / (SELECT sum(m) FROM s_{k}), {ALPHA}) AS p FROM s_{k}),
t_{k} AS MATERIALIZED (SELECT {k}, p / (SELECT sum(p) FROM p_{k}) AS share_{k} FROM p_{k}),
"""
    out += """w0 AS MATERIALIZED (SELECT c.*, mass / (SELECT sum(mass) FROM c) AS w, coalesce(share_source_key, 0) AS ts, coalesce(share_lang_key, 0) AS tl, coalesce(share_topic, 0) AS tt
  FROM c LEFT JOIN t_source_key USING (source_key) LEFT JOIN t_lang_key USING (lang_key) LEFT JOIN t_topic USING (topic)),
"""
    n = 0
    for _ in range(ROUNDS):
        for k, t in (("source_key", "ts"), ("lang_key", "tl"), ("topic", "tt")):
            out += f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {k}) > 0 THEN w * {t} / sum(w) OVER (PARTITION BY {k}) ELSE 0 END AS w) FROM w{n}),\n"
            n += 1
    return out + f"""r AS MATERIALIZED (SELECT source_key, lang_key, topic, CASE WHEN mass > 0 THEN w * (SELECT sum(mass) FROM c) / mass ELSE 0 END AS ratio FROM w{n}),
q AS (SELECT source_key, lang_key, topic, CASE WHEN (SELECT max(ratio) FROM r) > 0 THEN least(1.0, ratio / (SELECT max(ratio) FROM r)) ELSE 1.0 END AS p FROM r)
SELECT doc_id, source_key, lang_key, topic, n_tokens, round(p, 6) AS probability,
  CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), 1, 13)) AS BIGINT) / 4503599627370496.0 < p AS kept
FROM f JOIN q USING (source_key, lang_key, topic)
"""


QUERIES = {"op2_raked_mixing": op2_raked_mixing}
ORACLES = {"op2_raked_mixing": _sql()}
