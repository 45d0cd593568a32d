"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells by source, language and topic; a cell's mass is its tokens.
Raking scales the cells in turn until their sums meet the target share of every source,
language and topic.  The caller may give target shares of any of the three; the others flatten
the present shares (share ** exponent).  A category without a given share gets none.  Where the
targets cannot be met on the cells that occur, ``mix_gap`` says by how much the worst marginal
is off, and ``most_gap`` makes that an error.

Each cell's factor is its raked share over its present share.  A document is sampled with
probability min(1, c * factor), where c makes the expected tokens ``RATE`` of all tokens;
cells that reach 1 are kept whole and the rest is calibrated without them.  The draw is a hash
of the id, so it repeats and does not depend on partitions.

Only cells (combinations that occur) are shuffled after the first aggregation, never documents, and
no step gathers all cells in one task: sums over everything are aggregates of one number.
A null source or language is a category of its own; null and empty texts weigh 0 tokens and
take the probability of their cell, and a cell of mass 0 is sampled with probability ``RATE``.
Rows of one id are drawn alike.  Columns of the input keep their names; those added start
with ``mix_`` and replace columns that have their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import saved

RATE = 0.6
EXPONENTS = {"mix_source": 0.5, "mix_lang": 0.7, "mix_topic": 0.8}
TOLERANCE = 1e-10
SWEEPS = 5
MAX_ROUNDS = 12
DIMS = tuple(EXPONENTS)
ADDED = (*DIMS, "mix_tokens", "mix_factor", "mix_probability", "mix_selected", "mix_gap")
#: Rounds until no further cell reaches probability 1; every round but the last adds one at least.
MAX_SCALES = 200


def topic(text: Column) -> Column:
    """A coarse topic from what a text contains."""
    return (F.when(text.contains("License"), "licence").when(text.contains("token = "), "code").when(text.contains(" | "), "table")
            .when(text.contains("@"), "contact").otherwise("prose"))


def with_cells(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_of: Column | None = None) -> DataFrame:
    """Documents with their cell and token weight (stretches between spaces)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaces = F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))
    return docs.select(
        "*", F.coalesce(F.col(source_col), F.lit("(none)")).alias("mix_source"), F.coalesce(F.col(lang_col), F.lit("(none)")).alias("mix_lang"), F.coalesce(topic(text) if topic_of is None else topic_of.cast("string"), F.lit("(none)")).alias("mix_topic"),
        F.when(text == "", 0).otherwise(spaces + 1).cast("long").alias("mix_tokens"))


def with_targets(cells: DataFrame, targets: dict[str, DataFrame] | None = None, exponents: dict[str, float] = EXPONENTS) -> DataFrame:
    """Cells with a target share per dimension, made to sum to one over the categories that occur.

    ``targets`` maps a dimension to a table (value, share); shares below zero and null count as zero.
    """
    for dim, exponent in exponents.items():
        shares = cells.groupBy(dim).agg(F.pow(F.sum("mass"), F.lit(exponent)).alias("_part"))
        if targets and dim in targets:
            given = targets[dim].groupBy(F.coalesce(F.col("value").cast("string"), F.lit("(none)")).alias(dim)).agg(F.sum("share").cast("double").alias("_given"))
            shares = shares.join(given, dim, "left").select(dim, F.greatest(F.coalesce("_given", F.lit(0.0)), F.lit(0.0)).alias("_part"))
        total = shares.agg(F.sum("_part")).first()[0]
        if total is not None and total <= 0:
            raise ValueError(f"no category of {dim} that occurs has a target share")
        cells = cells.join(shares.select(dim, (F.col("_part") / F.lit(total)).alias(f"{dim}_target")), dim)
    return cells


def rake(cells: DataFrame, dims: tuple[str, ...] = DIMS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """``share`` of cells scaled until every marginal meets ``<dim>_target``, and the largest gap that is left.

    Needs ``mass`` and the targets.  Stops when no marginal is off by more than ``tolerance``, or
    after ``MAX_ROUNDS`` rounds of ``SWEEPS`` sweeps where the targets cannot be met.
    """
    total = cells.agg(F.sum("mass")).first()[0]
    current, worst = cells.withColumn("share", F.col("mass") / F.lit(total)), 0.0
    for _ in range(MAX_ROUNDS):
        for _ in range(SWEEPS):
            for dim in dims:
                held = F.sum("share").over(Window.partitionBy(dim))
                current = current.withColumn("share", F.when(held > 0, F.col("share") * F.col(f"{dim}_target") / held).otherwise(0.0))
        current = saved(current)
        off = None
        for dim in dims:
            gap = current.groupBy(dim).agg(F.abs(F.sum("share") - F.first(f"{dim}_target")).alias("gap")).agg(F.max("gap").alias("gap"))
            off = gap if off is None else off.unionByName(gap)
        worst = off.agg(F.max("gap")).first()[0] or 0.0
        if worst <= tolerance:
            break
    return current, float(worst)


def calibrated(raked: DataFrame, rate: float = RATE, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """``factor`` and ``probability`` of every cell.

    With probability min(1, c * factor), c is raised until the cells below 1 make up for those that
    are kept whole; in every round the cells at 1 can only grow, and two sums tell the next c.
    """
    total = raked.agg(F.sum("mass")).first()[0]
    cells = raked.withColumn("factor", F.col("share") * F.lit(total) / F.col("mass"))
    c, whole = 0.0, -1
    for _ in range(MAX_SCALES):
        full = F.col("factor") * F.lit(c) >= 1
        row = cells.agg(F.sum(full.cast("long")).alias("n"), F.sum(F.when(full, F.col("mass")).otherwise(0)).alias("above"),
                        F.sum(F.when(full, 0.0).otherwise(F.col("mass") * F.col("factor"))).alias("below")).first()
        if row["n"] is None or row["n"] == whole:
            break
        whole = row["n"]
        if not row["below"] or row["below"] <= 0:
            c = 1e300
            break
        c = max(0.0, (rate * float(total) - float(row["above"])) / row["below"])
    return cells.select(*dims, "mass", "share", "factor", F.least(F.lit(1.0), F.lit(c) * F.col("factor")).alias("probability"))


def draw(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the id."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)


def mix(docs: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
        targets: dict[str, DataFrame] | None = None, topic_of: Column | None = None, most_gap: float | None = None) -> DataFrame:
    """Documents with mix_source, mix_lang, mix_topic, mix_tokens, mix_factor, mix_probability, mix_selected, mix_gap.

    ``targets``: tables (value, share) for mix_source, mix_lang or mix_topic.  ``topic_of`` is the topic
    as a column; by default it follows from the text.
    """
    docs = docs.drop(*ADDED)
    rows = with_cells(docs, text_col, source_col, lang_col, topic_of)
    cells = saved(rows.groupBy(*DIMS).agg(F.sum("mix_tokens").alias("mass")))
    raked, gap = rake(with_targets(cells.filter("mass > 0"), targets))
    if most_gap is not None and gap > most_gap:
        raise ValueError(f"the targets cannot be met: a marginal is off by {gap}")
    table = saved(calibrated(raked, rate).select(*DIMS, F.col("factor").alias("mix_factor"), F.col("probability").alias("mix_probability")))
    joined = rows.join(table, list(DIMS), "left")
    chance = F.coalesce("mix_probability", F.lit(rate))
    return joined.select(*docs.columns, *DIMS, "mix_tokens", "mix_factor", chance.alias("mix_probability"), (draw(F.col(id_col)) < chance).alias("mix_selected"), F.lit(gap).alias("mix_gap"))


def op6_source_raking(spark, sf_dir) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_factor", 6).alias("factor"), F.round("mix_probability", 6).alias("probability"), F.col("mix_selected").alias("selected"))


def oracle(rounds: int = 60) -> str:
    """The same in SQL with a fixed number of sweeps, enough to converge on dense cells."""
    step = ("SELECT source, lang, topic, mass, ts, tl, tt, share * {t} / sum(share) OVER (PARTITION BY {d}) AS share FROM {f}")
    ctes, last = [], "r0"
    for k in range(rounds):
        for d, t in (("source", "ts"), ("lang", "tl"), ("topic", "tt")):
            name = f"r{k}_{d}"
            ctes.append(f"{name} AS MATERIALIZED ({step.format(d=d, t=t, f=last)})")
            last = name
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, source, lang, CASE WHEN contains(text, 'License') THEN 'licence' WHEN contains(text, 'token = ') THEN 'code' WHEN contains(text, ' | ') THEN 'table'
  WHEN contains(text, '@') THEN 'contact' ELSE 'prose' END AS topic, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS n_tokens FROM d),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS mass FROM x GROUP BY ALL HAVING sum(n_tokens) > 0),
s AS (SELECT source, power(sum(mass), 0.5) / sum(power(sum(mass), 0.5)) OVER () AS ts FROM c GROUP BY source),
l AS (SELECT lang, power(sum(mass), 0.7) / sum(power(sum(mass), 0.7)) OVER () AS tl FROM c GROUP BY lang),
t AS (SELECT topic, power(sum(mass), 0.8) / sum(power(sum(mass), 0.8)) OVER () AS tt FROM c GROUP BY topic),
r0 AS MATERIALIZED (SELECT source, lang, topic, mass, ts, tl, tt, mass / sum(mass) OVER () AS share FROM c JOIN s USING (source) JOIN l USING (lang) JOIN t USING (topic)),
{', '.join(ctes)},
f AS (SELECT *, sum(mass) OVER () AS total, share * sum(mass) OVER () / mass AS factor FROM {last}),
o AS (SELECT *, coalesce(sum(mass) OVER (ORDER BY factor DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
  sum(mass * factor) OVER (ORDER BY factor DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below,
  row_number() OVER (ORDER BY factor DESC, source, lang, topic) AS place FROM f),
q AS (SELECT min_by(({RATE} * total - above) / below, place) FILTER (({RATE} * total - above) / below * factor <= 1) AS c FROM o),
p AS (SELECT source, lang, topic, factor, least(1.0, coalesce(q.c, 1e300) * factor) AS probability FROM o, q)
SELECT x.doc_id, x.source, x.lang, x.topic, x.n_tokens, round(p.factor, 6) AS factor, round(coalesce(p.probability, {RATE}), 6) AS probability,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(x.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 < coalesce(p.probability, {RATE}) AS selected
FROM x LEFT JOIN p ON x.source = p.source AND x.lang = p.lang AND x.topic = p.topic
"""


ORACLE = oracle()
