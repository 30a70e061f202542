"""Mixing documents to target shares by iterative proportional fitting.

Tokens are summed up by cell (source, language, topic).  The cells' weights are
raked: scaled so that the sources have their target shares of all tokens, then
the languages, then the topics, and again.  A document is then drawn with the
probability that its cell's weight asks for.  Asked to be ``exact``, raking keeps
cells below what they have, and the rate falls until none has to give more, so
that the tokens drawn have the target shares too.  DataFrame expressions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelake.llm.common import settle

DIMENSIONS = ("source", "lang", "topic")
#: target shares; dimensions without an entry get equal shares
TARGETS = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
RATE = 0.5  # tokens to draw, as a share of all
SWEEPS = 12  # times that every marginal is raked
SWEEPS_AT_ONCE = 4  # in one plan
BOUNDED_SWEEPS, LAST_SWEEPS = 16, 8  # of an exact mix: within what cells have, then free
SLACK = 0.98  # of the highest rate that single categories allow, so that sweeps settle
FEW_CELLS = 1 << 16  # cells raked in one task, without a shuffle for each marginal
NONE = "(none)"  # stands for a null source or language

WORD = "[^\\x20\\x09-\\x0D]+"


def token_count(text: Column) -> Column:
    """Words of a text; 0 of a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(tokens: Column) -> Column:
    """Stands for a topic where documents have none: brief, middle or long."""
    return (F.when(tokens < 200, "brief").when(tokens < 1000, "middle").otherwise("long"))


def draw(id_: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the document's id, and on its text where it has none."""
    named = F.coalesce(id_.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    digits = F.substring(F.md5(named), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def marked(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with _tokens, _draw, _source, _lang and _topic."""
    out = docs.withColumns({
        "_tokens": token_count(F.col("text")), "_draw": draw(F.col("doc_id"), F.col("text"))})
    return out.withColumns({
        "_source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
        "_lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        "_topic": F.coalesce(size_class(F.col("_tokens")) if topic is None else topic, F.lit(NONE)),
    })


def cell_weights(
    cells: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, sweeps: int = SWEEPS
) -> DataFrame:
    """Rakes cells (source, lang, topic, tokens) and adds their ``share`` of the mix.

    Shares of listed categories that do not occur go to the others listed in
    proportion.  Categories that are not listed keep their share of the tokens.
    Cells without tokens have no share.
    """
    return _raked(_aimed(cells, targets), sweeps).select(*DIMENSIONS, "tokens", "share")


def exact_weights(
    cells: DataFrame, rate: float = RATE, targets: Mapping[str, Mapping[str, float]] = TARGETS
) -> DataFrame:
    """As :func:`cell_weights`, with the ``rate`` at which every cell has what it has to give.

    No category can give more than it has, which bounds the rate.  At that bound
    cells are raked and cut back in turn, so that others in their categories make
    up for them.  Where cells cannot meet all targets together even so, the last,
    free sweeps leave weights above 1 / rate, and the rate falls to 1 / the largest.
    """
    out = _aimed(cells, targets)
    total = out.agg(F.sum("tokens").cast("double").alias("_all"))
    out = out.crossJoin(total)
    able = [
        F.sum("tokens").over(Window.partitionBy(dim)) / (F.col("_all") * F.col(f"_{dim}_target"))
        for dim in DIMENSIONS
    ]
    bound = out.select(F.least(*able).alias("_able")).agg(
        F.least(F.lit(float(rate)), F.lit(SLACK) * F.min("_able")).alias("_bound"))
    out = settle(
        out.crossJoin(bound).withColumn("_most", F.col("tokens") / F.col("_bound")).drop("_bound"), "cells")
    out = _raked(_raked(out, BOUNDED_SWEEPS, bounded=True), LAST_SWEEPS)
    largest = out.agg(F.max(F.col("share") * F.col("_all") / F.col("tokens")).alias("_largest"))
    return out.crossJoin(largest).select(
        *DIMENSIONS, "tokens", "share",
        F.least(F.lit(float(rate)), F.lit(1.0) / F.col("_largest")).alias("rate"))


def _aimed(cells: DataFrame, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Cells with tokens, with their first ``share`` and the targets of their categories."""
    out = cells.where("tokens > 0").withColumn("share", F.col("tokens").cast("double"))
    for dim in DIMENSIONS:
        out = out.join(_shares(cells, dim, targets.get(dim)), dim)
    return settle(out, "cells")


def _raked(out: DataFrame, sweeps: int, bounded: bool = False) -> DataFrame:
    """Sweeps over all marginals; ``bounded`` ones start from shares within ``_most`` tokens.

    Cells are as many as categories meet, not as documents; few are raked in one task.
    """
    few = out.count() <= FEW_CELLS
    for first in range(0, sweeps, SWEEPS_AT_ONCE):
        if few:
            out = out.coalesce(1)
        for sweep in range(first, min(first + SWEEPS_AT_ONCE, sweeps)):
            if bounded and sweep:  # the first shares are tokens, and no shares yet
                out = out.withColumn("share", F.least("share", F.col("_most") / F.col("_all")))
            for dim in DIMENSIONS:
                of = F.sum("share").over(Window.partitionBy(dim))
                out = out.withColumn("share", F.col("share") * F.col(f"_{dim}_target") / of)
        out = settle(out, "cells")
    return out


def _shares(cells: DataFrame, dim: str, listed: Mapping[str, float] | None) -> DataFrame:
    """(category, target share) of one dimension; one row for each category."""
    known = cells.where("tokens > 0").groupBy(dim).agg(F.sum("tokens").cast("double").alias("_mass"))
    if listed is None:
        total = known.agg(F.count(F.lit(1)).alias("_n"))
        return known.crossJoin(total).select(dim, (F.lit(1.0) / F.col("_n")).alias(f"_{dim}_target"))
    asked = F.element_at(F.create_map(*[F.lit(x) for c, s in listed.items() for x in (c, float(s))]),
                         F.col(dim))
    known = known.withColumn("_asked", asked)
    total = known.agg(
        F.sum("_mass").alias("_all"), F.sum("_asked").alias("_asked_all"),
        F.sum(F.when(F.col("_asked").isNull(), F.col("_mass")).otherwise(0.0)).alias("_other"),
    )
    rest = F.lit(1.0) - F.col("_other") / F.col("_all")
    target = F.when(F.col("_asked").isNull(), F.col("_mass") / F.col("_all")).otherwise(
        F.col("_asked") * rest / F.col("_asked_all"))
    return known.crossJoin(total).select(dim, target.alias(f"_{dim}_target"))


def _weighed(marks: DataFrame, tokens: DataFrame, rate: float, targets, exact: bool) -> DataFrame:
    """``marks`` with _weight and _probability by cell, from (_source, _lang, _topic, _tokens)."""
    cells = settle(
        tokens.groupBy(*[F.col(f"_{d}").alias(d) for d in DIMENSIONS])
        .agg(F.sum("_tokens").alias("tokens")),
        "cells",
    )
    if exact:
        shares = exact_weights(cells, rate, targets)
    else:
        shares = cell_weights(cells, targets).withColumn("rate", F.lit(float(rate)))
    total = shares.agg(F.sum("tokens").cast("double").alias("_all"))
    weight = F.col("share") * F.col("_all") / F.col("tokens")
    by_cell = shares.crossJoin(total).select(
        *[F.col(d).alias(f"_cell_{d}") for d in DIMENSIONS], weight.alias("_weight"),
        F.least(F.lit(1.0), F.col("rate") * weight).alias("_probability"),
    )
    same = [F.col(f"_{d}") == F.col(f"_cell_{d}") for d in DIMENSIONS]
    return marks.join(by_cell, same, "left")


def _drawn() -> Column:
    # A document without tokens costs nothing and stays.
    return (F.col("_tokens") == 0) | (F.col("_draw") < F.col("_probability"))


def mixture(
    docs: DataFrame, rate: float = RATE, targets: Mapping[str, Mapping[str, float]] = TARGETS,
    topic: Column | None = None, exact: bool = False,
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability and kept of every document.

    ``weight`` is the cell's share of the mix by its share of the tokens; the
    document is kept with probability min(1, rate * weight), decided by a hash of
    its id, or of its text if it has none: rows with one id share their fate, and so do
    rows without one that have one text.  A cell that would have to give
    more than it has gives all of it, and the tokens drawn then miss the targets;
    with ``exact`` they meet them, and the rate is lower (:func:`exact_weights`).
    Null sources and languages are categories of their own, "(none)".  Documents without
    tokens, null and empty texts, are kept; a cell without any has null weights.
    ``topic`` is a column expression; without one, size classes stand in.  Other
    columns are ignored; an empty table gives an empty result.
    """
    base = settle(
        marked(docs.select("doc_id", "source", "lang", "text"), topic)
        .select("doc_id", *[f"_{d}" for d in DIMENSIONS], "_tokens", "_draw"), "tokens")
    return _weighed(base, base, rate, targets, exact).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.col(f"_{d}").alias(d) for d in DIMENSIONS], F.col("_tokens").alias("n_tokens"),
        F.round("_weight", 6).alias("weight"), F.round("_probability", 6).alias("probability"),
        _drawn().alias("kept"),
    )


def sampled(docs: DataFrame, rate: float = RATE,
            targets: Mapping[str, Mapping[str, float]] = TARGETS, exact: bool = False) -> DataFrame:
    """The documents that :func:`mixture` keeps, with their own columns."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", "lang", "text")
    marks = marked(row)
    return _weighed(marks, marks, rate, targets, exact).where(_drawn()).select("_row.*")
