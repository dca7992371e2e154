"""Mixing by iterative proportional fitting.

Token counts are summed over cells (source, language, topic). Raking finds one factor for each source, language and topic
so that the cells' weights meet the target share of each margin; a document is then kept with a probability that
makes expected kept tokens follow the raked weights. The draw is a hash of the id, so it repeats on any cluster. Everything
is built from DataFrame functions, and only sums over cells and factors travel.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortgraph.llm.shared import SPACE, cut, let_go

DIMENSIONS = ("source", "lang", "topic")
#: Language shares that the registered query aims at; sources and topics are tempered.
LANG_TARGETS: dict[str, float] = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
#: Raking rounds. Each meets one margin after another; the error shrinks by a constant factor a round.
ROUNDS = 8
#: Rounds in which probabilities over 1 are cut and the rest scaled up to the budget.
CAP_ROUNDS = 4
#: Cells up to which their chances are sent to all tasks; beyond, rows and cells are joined by a shuffle.
SENT_CELLS = 100_000


def topic_of(text: Column) -> Column:
    """A coarse topic from a text's characters: symbols, numbers, capitals, tables, or prose."""
    n = F.greatest(F.length(text), F.lit(1))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&<>{}=]+", "")) / n
    bars = F.length(F.regexp_replace(text, r"[^|]+", "")) / n
    digits = F.length(F.regexp_replace(text, r"[^0-9]+", "")) / n
    capitals = F.length(F.regexp_replace(text, r"[^A-Z]+", "")) / n
    return F.when(symbols > 0.02, "symbols").when(bars > 0.02, "tables").when(digits > 0.05, "numbers").when(capitals > 0.3, "capitals").otherwise("prose")


def words_of(text: Column) -> Column:
    """Number of words, as the token count of a document."""
    return F.regexp_count(text, F.lit(f"[^{SPACE[1:-1]}]+")).cast("long")


def _targets(cells: DataFrame, dim: str, wanted: Mapping[str, float] | None, power: float, rest: bool = True) -> DataFrame:
    """(dim, target): shares as wanted among the values present, or in proportion to tokens to a power.

    With rest, values that wanted does not name get their tempered share, and the wanted shares are scaled to what is left;
    without it they get nothing. Where wanted gives nothing to the values present, all are tempered."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens"))
    tempered = F.pow(F.col("tokens"), F.lit(power))
    if wanted:
        share = F.lit(0.0)
        for value, x in wanted.items():
            share = F.when(F.col(dim) == value, F.lit(float(x))).otherwise(share)
        sums = sums.withColumn("share", share)
    else:
        sums = sums.withColumn("share", tempered)
    unnamed = ~F.col(dim).isin(list(wanted)) if wanted and rest else F.lit(False)
    total = sums.agg(F.sum("share").alias("whole"), F.sum(tempered).alias("all"), F.sum(F.when(unnamed, 0.0).otherwise(tempered)).alias("named"))
    free = tempered / F.nullif("all", F.lit(0.0))
    held = F.col("named") / F.nullif("all", F.lit(0.0)) if wanted and rest else F.lit(1.0)
    share = F.when((F.col("whole") > 0) & ~unnamed, F.col("share") / F.nullif("whole", F.lit(0.0)) * held).otherwise(free)
    return sums.crossJoin(F.broadcast(total)).select(dim, share.alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """cells (dimensions, tokens) with weight: shares that meet the targets of each margin in turn.

    Each step scales the weights of a margin's values to their targets. A value whose cells all have weight 0 cannot be met;
    the others then share its part, since the weights are scaled to sum to 1 at the end."""
    held = cells.withColumn("w", F.col("tokens").cast("double"))
    for d, target in targets.items():
        held = held.join(target.select(d, F.col("target").alias(f"t_{d}")), d)
    held = cut(held)
    for _ in range(rounds):
        for d in targets:
            scale = F.try_divide(F.col(f"t_{d}"), F.sum("w").over(Window.partitionBy(d)))
            held = held.withColumn("w", F.coalesce(F.col("w") * scale, F.lit(0.0)))
        held = cut(held)
    whole = held.agg(F.sum("w").alias("all_w"))
    return held.crossJoin(F.broadcast(whole)).withColumn("weight", F.coalesce(F.try_divide("w", "all_w"), F.lit(0.0))).drop("w", "all_w", *(f"t_{d}" for d in targets))


def margin_error(cells: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """(error): the largest difference of a margin's weight in raked cells from its target."""
    off = [cells.groupBy(d).agg(F.sum("weight").alias("w")).join(target, d).select(F.abs(F.col("w") - F.col("target")).alias("off")) for d, target in targets.items()]
    return reduce(DataFrame.union, off).agg(F.max("off").alias("error"))


def probabilities(cells: DataFrame, share: float, cap_rounds: int = CAP_ROUNDS) -> DataFrame:
    """weighted cells with p: the chance to keep a document, so that about share of all tokens is kept.

    No cell keeps more than it has; what is cut off goes to the other cells in proportion to their weights."""
    held = cells.withColumn("p", F.lit(0.0))
    totals = cut(cells.agg(F.sum("tokens").alias("budget"))).select((F.col("budget") * F.lit(share)).alias("budget"))
    scale = totals.select("budget", F.lit(1.0).alias("open_w"), F.lit(0.0).alias("full"))
    for _ in range(cap_rounds):
        rate = F.coalesce(F.try_divide(F.greatest(F.col("budget") - F.col("full"), F.lit(0.0)) * F.col("weight"), F.col("open_w") * F.col("tokens")), F.lit(0.0))
        held = cells.crossJoin(F.broadcast(scale)).withColumn("p", F.least(rate, F.lit(1.0))).drop("budget", "open_w", "full")
        full = F.col("p") >= 1
        sums = held.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).cast("double").alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open_w"))
        scale = cut(totals.crossJoin(F.broadcast(sums)).select("budget", "open_w", "full"))
    rate = F.coalesce(F.try_divide(F.greatest(F.col("budget") - F.col("full"), F.lit(0.0)) * F.col("weight"), F.col("open_w") * F.col("tokens")), F.lit(0.0))
    return cells.crossJoin(F.broadcast(scale)).withColumn("p", F.when(F.col("weight") > 0, F.least(rate, F.lit(1.0))).otherwise(0.0)).drop("budget", "open_w", "full")


def draw(i: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(i.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _cell_of(text_col: str, source_col: str, lang_col: str, topic: Column | None) -> tuple[dict[str, Column], Column]:
    """The dimensions of a row's cell, and its tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = {d: F.coalesce(F.col(c).cast("string"), F.lit("?")) for d, c in (("source", source_col), ("lang", lang_col))}
    return named | {"topic": topic_of(text) if topic is None else topic}, F.greatest(words_of(text), F.lit(1))


def _rated(rows: DataFrame, share: float, targets: Mapping[str, Mapping[str, float] | None] | None, power: float, rounds: int, rest: bool) -> DataFrame:
    """(dimensions, weight, p) of each cell of rows (dimensions, tokens)."""
    targets = {"lang": LANG_TARGETS} if targets is None else targets
    cells = cut(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    margins = {d: cut(_targets(cells, d, targets.get(d), power, rest)) for d in DIMENSIONS}
    rated = cut(probabilities(rake(cells, margins, rounds), share).select(*DIMENSIONS, "weight", "p"))
    let_go(rows.sparkSession)
    return rated


def mix_sources(
    docs: DataFrame, share: float = 0.5, targets: Mapping[str, Mapping[str, float] | None] | None = None, power: float = 0.7, rounds: int = ROUNDS, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, rest: bool = True,
) -> DataFrame:
    """One row for each row of docs: id, source, lang, topic, tokens, weight, p, kept.

    targets: for a dimension, shares by value; a dimension without any gets shares in proportion to tokens ** power.
    With rest, values without a named share keep that tempered share and named shares are scaled to the rest; without it
    they get nothing.
    weight is the raked share of the row's cell, p its chance to be kept, kept the draw. About share of all tokens is kept,
    less where too few cells have weight. Null sources and languages are the value '?'. A null or blank text has no
    tokens; it counts as one, so it has a chance as well. Rows that repeat an id are kept or dropped alike within a cell.
    An empty table gives no rows. Other columns are ignored.
    """
    dims, tokens = _cell_of(text_col, source_col, lang_col, topic)
    rows = cut(docs.select(F.col(id_col).alias("id"), *(c.alias(d) for d, c in dims.items()), tokens.alias("tokens")))
    rated = _rated(rows, share, targets, power, rounds, rest)
    out = rows.join(rated, list(DIMENSIONS))
    return out.select(F.col("id").alias(id_col), *DIMENSIONS, "tokens", F.round("weight", 9).alias("weight"), F.round("p", 6).alias("p"), (draw(F.col("id"), seed) < F.round("p", 6)).alias("kept"))


def keep_mixed(
    docs: DataFrame, share: float = 0.5, targets: Mapping[str, Mapping[str, float] | None] | None = None, power: float = 0.7, rounds: int = ROUNDS, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, rest: bool = True,
) -> DataFrame:
    """docs without the rows that mix_sources does not keep; all columns stay.

    Each row is judged by its own cell, and a row without an id draws by its text, so null and repeated ids do no harm."""
    dims, tokens = _cell_of(text_col, source_col, lang_col, topic)
    rated = _rated(docs.select(*(c.alias(d) for d, c in dims.items()), tokens.alias("tokens")), share, targets, power, rounds, rest)
    rated = rated.select(*DIMENSIONS, F.round("p", 6).alias("p"))
    rated = F.broadcast(rated) if rated.count() <= SENT_CELLS else rated
    drawn = draw(F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))), seed)
    rows = docs.select(F.struct("*").alias("row"), *(c.alias(d) for d, c in dims.items()), drawn.alias("u"))
    return rows.join(rated, list(DIMENSIONS)).where(F.col("u") < F.col("p")).select("row.*")


def _sql(rounds: int, cap_rounds: int, share: float, power: float) -> str:
    """The same computation as one chain of CTEs."""
    dims = DIMENSIONS
    langs = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_TARGETS.items())
    parts = [
        """d AS MATERIALIZED (SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang,
  CASE WHEN length(regexp_replace(t, '[^#*$%&<>{}=]+', '', 'g')) / n > 0.02 THEN 'symbols' WHEN length(regexp_replace(t, '[^|]+', '', 'g')) / n > 0.02 THEN 'tables'
       WHEN length(regexp_replace(t, '[^0-9]+', '', 'g')) / n > 0.05 THEN 'numbers' WHEN length(regexp_replace(t, '[^A-Z]+', '', 'g')) / n > 0.3 THEN 'capitals' ELSE 'prose' END AS topic,
  greatest(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')), 1) AS tokens
  FROM (SELECT *, coalesce(text, '') AS t, greatest(length(coalesce(text, '')), 1) AS n FROM documents))""",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for x in dims:
        tempered = f"pow(sum(tokens), {power})"
        first = f"CASE {x} {langs} ELSE 0 END" if x == "lang" else tempered
        parts.append(f"t0_{x} AS (SELECT {x}, {first} AS s, {tempered} AS a FROM c GROUP BY {x})")
        parts.append(f"t_{x} AS MATERIALIZED (SELECT {x}, CASE WHEN sum(s) OVER () > 0 THEN s / sum(s) OVER () ELSE a / sum(a) OVER () END AS target FROM t0_{x})")
        parts.append(f"f_{x}_0 AS (SELECT {x}, 1.0::DOUBLE AS f FROM t_{x})")
    now = dict.fromkeys(dims, 0)
    for r in range(1, rounds + 1):
        for x in dims:
            a, b = (y for y in dims if y != x)
            parts.append(f"f_{x}_{r} AS MATERIALIZED (SELECT {x}, coalesce(any_value(target) / nullif(sum(tokens * u.f * v.f), 0), 0) AS f FROM c JOIN f_{a}_{now[a]} u USING ({a}) JOIN f_{b}_{now[b]} v USING ({b}) JOIN t_{x} USING ({x}) GROUP BY {x})")
            now[x] = r
    parts.append(f"w AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens * a.f * b.f * e.f AS w FROM c JOIN f_source_{rounds} a USING (source) JOIN f_lang_{rounds} b USING (lang) JOIN f_topic_{rounds} e USING (topic))")
    parts.append("ww AS MATERIALIZED (SELECT source, lang, topic, tokens, coalesce(w / nullif(sum(w) OVER (), 0), 0) AS weight FROM w)")
    parts.append(f"s_0 AS (SELECT sum(tokens) * {share} AS budget, 1.0::DOUBLE AS open_w, 0.0::DOUBLE AS full_t FROM c)")
    rate = "coalesce(greatest(budget - full_t, 0) * weight / nullif(open_w * tokens, 0), 0)"
    for k in range(1, cap_rounds + 1):
        parts.append(f"s_{k} AS MATERIALIZED (SELECT any_value(budget) AS budget, sum(CASE WHEN {rate} >= 1 THEN 0 ELSE weight END) AS open_w, sum(CASE WHEN {rate} >= 1 THEN tokens ELSE 0 END) AS full_t FROM ww, s_{k - 1})")
    parts.append(f"p AS MATERIALIZED (SELECT source, lang, topic, round(weight, 9) AS weight, round(CASE WHEN weight > 0 THEN least({rate}, 1) ELSE 0 END, 6) AS p FROM ww, s_{cap_rounds})")
    u = "CAST(('0x' || substr(md5('1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, source, lang, topic, tokens, weight, p, {u} < p AS kept FROM d JOIN p USING (source, lang, topic)"


SQL = _sql(ROUNDS, CAP_ROUNDS, 0.5, 0.7)
