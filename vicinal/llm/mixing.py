"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Tokens (words) are summed by cell (source, language, topic). Raking scales the cells' weights to the target share of each
source, then of each language, then of each topic, for ``rounds`` rounds. Documents of a cell are then kept with
probability min(1, scale * weight / available share), the scale set so that the expected tokens make up ``keep`` of all;
cells that would need more than they have are kept whole and the others make up for it. A document's draw is a hash of its
id, so a rerun, or a lost executor, draws the same.

That spreads what capped cells lack over all others by one factor, and so misses targets that could be reached. With
``bounded`` the caps are part of the raking: each step scales a group's weights so that its expected tokens, each cell's
least(n, w), meet the group's goal. A group's goal is its target share of the kept tokens, or all it has where that is
less, and the margin's other groups make up for it in proportion to their targets.

The cells are pre-aggregated before any shuffle, so a source with a third of all rows is a few cells like any other. Counted
to be few, they are raked by windows within one task; otherwise each margin's groups are dealt to the cluster. The
fitting is the same.

Target shares default to tempered ones, each share to the power ``temper``, normalized; or give {name: share} a margin.
Without a ``topic`` column the topic is the text's form: short (under 50 words), list (under 12 words a line), long (over
1000 words), else prose.

Defined results: null texts have no words and are kept with the others of their cell; null sources, languages and topics
are the group "". A cell without tokens has the probability ``keep``. Equal ids draw alike. An empty table gives an empty
result; a null id draws as the text "null".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, WORD, table

MARGINS = ("source", "lang", "topic")
ROUNDS, TEMPER, KEEP = 8, 0.5, 0.7
#: Rounds of the bounded raking, which settles which cells are capped on the way.
BOUNDED_ROUNDS = 16
#: Up to this many cells (some 7 MB) are raked in one task, without a shuffle for each margin and round.
ONE_TASK = 100_000


def described(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, ``also``, source, lang, topic, n_tokens."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(1))
    named = {m: F.coalesce(F.col(m).cast("string"), F.lit("")) for m in MARGINS if m in docs.columns}
    base = docs.select("doc_id", *also, *[c.alias(f"m_{m}") for m, c in named.items()], words.alias("n_words_"), lines.alias("n_lines_"))
    form = F.expr("case when n_words_ < 50 then 'short' when n_words_ < 12 * n_lines_ then 'list' when n_words_ > 1000 then 'long' else 'prose' end")
    return base.select("doc_id", *also, *[(F.col(f"m_{m}") if m in named else form if m == "topic" else F.lit("")).alias(m) for m in MARGINS], F.col("n_words_").cast("long").alias("n_tokens"))


def draw(doc_id: Column) -> Column:
    """A uniform number of [0, 1) from the id's text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / float(2**32)


def levelled(cells: DataFrame, by: str, goal: Column) -> DataFrame:
    """``cells(.., n, w)`` with w scaled in each group so that least(n, w) sums to ``goal``, or to all n if that is less.

    With the cells of largest w / n capped one after another, the scale of the rest rises up to the right one, then falls.
    """
    per = f"over (partition by {by} order by w / n desc rows between"
    left = F.expr(f"coalesce(sum(n) {per} unbounded preceding and 1 preceding), 0)")
    scaled = cells.withColumn("scale", F.try_divide(goal - left, F.expr(f"sum(w) {per} current row and unbounded following)")))
    return scaled.withColumn("w", F.expr(f"coalesce(w * max(scale) over (partition by {by}), 0.0)")).drop("scale")


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int, temper: float, kept: float | None = None) -> DataFrame:
    """``cells(source, lang, topic, n)`` with their weights w, which sum to 1.

    With ``kept``, the share of all tokens to keep, w are bounded cells' expected tokens: least(n, w) is what a cell gives.
    """
    total = cells.agg(F.sum("n")).collect()[0][0]
    out = cells.withColumn("w", F.col("n") / F.lit(float(total)))
    for m in MARGINS:
        if m in targets:
            share = F.lit(0.0)
            for name, of in targets[m].items():
                share = F.when(F.col(m) == name, F.lit(float(of))).otherwise(share)
            out = out.withColumn(f"t_{m}", share)
        else:
            shares = cells.groupBy(m).agg(F.sum("n").alias("s")).select(m, F.pow(F.col("s") / F.lit(float(total)), F.lit(temper)).alias("s"))
            norm = shares.agg(F.sum("s")).collect()[0][0]
            out = out.join(shares.select(m, (F.col("s") / F.lit(norm)).alias(f"t_{m}")), m)
    if kept is not None:
        out = out.withColumn("w", F.col("w") * F.lit(kept * total))
        for m in MARGINS:
            groups = out.groupBy(m).agg(F.sum("n").alias("n"), F.first(f"t_{m}").alias("w"))
            goals = levelled(groups, "1", F.lit(kept * total)).select(m, F.least("n", "w").alias(f"t_{m}"))
            out = out.drop(f"t_{m}").join(goals, m)
    out = table(out, "cells")
    few = out.count() <= ONE_TASK
    for i in range(rounds):
        if few and i % 4 == 0:
            out = out.coalesce(1)
        for m in MARGINS:
            out = out.withColumn("w", F.expr(f"w * t_{m} / sum(w) over (partition by {m})")) if kept is None else levelled(out, m, F.col(f"t_{m}"))
        if i % 4 == 3 or i == rounds - 1:
            out = table(out, "cells")
    return out.select(*MARGINS, "n", "w")


def probabilities(cells: DataFrame, keep: float) -> DataFrame:
    """(source, lang, topic, probability) for raked cells; each round settles the cells that are kept whole."""
    total, weight = cells.agg(F.sum("n"), F.sum("w")).collect()[0]
    budget, scale = keep * total, keep * total / weight
    while True:
        whole = F.col("w") * F.lit(scale) >= F.col("n")
        full, rest = cells.agg(F.sum(F.when(whole, F.col("n")).otherwise(0)), F.sum(F.when(whole, 0.0).otherwise(F.col("w")))).collect()[0]
        now = max(scale, (budget - full) / rest) if rest else scale
        if now <= scale * (1 + 1e-12):
            return cells.select(*MARGINS, F.least(F.lit(1.0), F.col("w") * F.lit(scale) / F.col("n")).alias("probability"))
        scale = now


def mix(docs: DataFrame, *also: str, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, temper: float = TEMPER, keep: float = KEEP, bounded: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source, lang[, topic])``: doc_id, ``also``, source, lang, topic, n_tokens,
    probability, sampled. Margins that ``targets`` does not name have tempered shares. ``bounded`` rakes within the caps."""
    seen = described(docs, *also)
    cells = table(seen.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n")).where("n > 0"), "cells")
    n = cells.count()
    if n:
        raked = rake(cells, targets or {}, max(rounds, BOUNDED_ROUNDS), temper, keep) if bounded else rake(cells, targets or {}, rounds, temper)
        odds = table(probabilities(raked, keep), "odds")
        seen = seen.join(F.broadcast(odds) if n <= BROADCAST_KEYS else odds, list(MARGINS), "left")
    else:
        seen = seen.withColumn("probability", F.lit(None).cast("double"))
    seen = seen.withColumn("probability", F.coalesce("probability", F.lit(float(keep))))
    return seen.select("doc_id", *also, *MARGINS, "n_tokens", "probability", (draw(F.col("doc_id")) < F.col("probability")).alias("sampled"))
