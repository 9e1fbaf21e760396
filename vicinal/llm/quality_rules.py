"""Quality rules with risk-controlled thresholds.

Features of each whole text are compared with cut-offs, one for each rule and stratum (language). They are chosen on good
labelled documents so that the rules together reject less than ``risk`` of a stratum's good documents:

1. One in ``LEARN`` good documents, by a hash of the id, proposes: each rule's tightest cut-off of its grid that rejects at
   most ``risk / (2 * rules)`` of these.
2. The others certify. The proposal is loosened by ``STEPS`` places of all grids, where every rule is off, and tightened a
   place at a time up to the proposal itself. At each step an exact binomial test asks whether the true share that the
   rules reject together may be ``risk`` or more: with k of n rejected, the step is certified if P(Bin(n, risk) <= k), the
   Clopper-Pearson upper bound read backwards, is at most delta / strata. The first step that fails ends the sequence.
   Tests in a fixed order need no correction among themselves, and strata share ``delta`` by Bonferroni.

So with probability 1 - delta no stratum loses ``risk`` of its good documents or more to its rules. A stratum whose number
of labels could not certify any step takes no part; it has no rule on, and its documents say so by ``certified`` = false.

Defined results: null and empty texts have zero counts and fail the base rule (fewer than 20 words). The documents without
a language are a stratum like any other; a language with too few labels to certify a cut-off has no rule on, whatever other
languages show. A document labelled twice is good only if all its labels are. Without labels no rule is on. Repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, covered, let, table

RUN = 8
#: One in so many good documents proposes cut-offs; the places of a grid by which certification starts looser.
LEARN, STEPS = 4, 18
#: Cut-offs tried, loosest last. A document is rejected if its value is above the cut-off.
GRIDS: dict[str, list[float]] = {
    "symbols_per_word": [round(0.02 * 1.3**i, 4) for i in range(18)],
    "repeat_share": [round(0.02 * i, 2) for i in range(1, 16)],
    "dup_line_share": [round(0.05 * i, 2) for i in range(1, 19)],
    "longest_mean_word": [6.0 + 0.5 * i for i in range(16)],
    "shortest_mean_word": [-6.0 + 0.5 * i for i in range(11)],
}


def _repeated(w: Column) -> Column:
    """Words inside windows of RUN words that occur twice or more in the text."""
    at = F.sequence(F.lit(1), F.size(w) - (RUN - 1))
    grams = F.transform(at, lambda i: F.struct(F.array_join(F.slice(w, i, F.lit(RUN)), " ").alias("g"), i.alias("i")))

    def twice(s: Column) -> Column:
        return F.filter(s, lambda x, i: (F.get(s, i + 1)["g"] == x["g"]) | ((i > 0) & (F.get(s, i - 1)["g"] == x["g"])))

    def spans(s: Column) -> Column:
        return F.transform(F.sort_array(F.transform(twice(s), lambda x: x["i"])), lambda i: F.struct(i.alias("b"), (i + RUN).alias("e")))

    # equal windows have equal hashes, so most texts end here
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(w, i, F.lit(RUN))))
    unique = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when((F.size(w) <= RUN) | unique, F.lit(0).cast("long")).otherwise(let(F.sort_array(grams), lambda s: covered(spans(s))))


def features(docs: DataFrame, *also: str) -> DataFrame:
    """Counts of each whole text: doc_id, ``also``, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counts = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated(w).alias("n_repeat_words"),
    ))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    rows = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
    return docs.select("doc_id", *also, counts.alias("c"), rows.alias("r"), symbols.alias("n_symbols")).select("doc_id", *also, "c.*", "r.*", "n_symbols")


def _values() -> dict[str, Column]:
    """The rules' values, from the counts of a text with words."""
    n, mean = F.col("n_words"), F.col("word_chars") / F.col("n_words")
    return {
        "symbols_per_word": F.col("n_symbols") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "dup_line_share": F.col("n_dup_lines") / F.col("n_lines"),
        "longest_mean_word": mean,
        "shortest_mean_word": -mean,
    }


def below(n: int, rate: float, k: int) -> float:
    """P(Bin(n, rate) <= k) for k under the mean, summed downwards until terms no longer count; 1 from the mean on."""
    if k >= n * rate:
        return 1.0
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    total, term, j = 0.0, 1.0, k
    while j >= 0 and term > 1e-18 * total:
        total += term
        term *= j * (1 - rate) / ((n - j + 1) * rate)
        j -= 1
    return min(1.0, math.exp(first + math.log(total)))


def _failing() -> dict[str, Column]:
    """How many cut-offs of its grid a document fails, for each rule; they are the tightest ones."""
    def failing(name: str, value: Column) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in GRIDS[name]]), lambda c: value > c))

    return {name: failing(name, value) for name, value in _values().items()}


def thresholds(counted: DataFrame, labels: DataFrame, risk: float, delta: float) -> dict[str | None, dict[str, float]]:
    """{language or None: {rule: cut-off}} of the strata with a certified step, by their own ``labels(doc_id, quality)``.

    A stratum needs some 150 certifying documents to take part, and gives the driver a row or two for each step.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    part = F.conv(F.substring(F.md5(F.concat(F.lit("quality:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long") % LEARN
    held = counted.where("n_words > 0").join(good, "doc_id", "left_semi").withColumn("learns", part == 0)
    held = table(held.select("lang", "learns", *[n.alias(name) for name, n in _failing().items()]), "held")
    least = math.ceil(math.log(delta) / math.log1p(-risk))  # fewer certify nothing, whatever they show
    beyond = [F.sum(F.when(F.col("learns") & (F.col(f"`{name}`") > i), 1).otherwise(0)).alias(f"{name}@{i}") for name in GRIDS for i in range(len(GRIDS[name]))]
    strata = held.groupBy("lang").agg(F.sum(F.col("learns").cast("long")).alias("n"), F.sum((~F.col("learns")).cast("long")).alias("m"), *beyond).where(F.col("m") >= least).collect()
    allowed = risk / (2 * len(GRIDS))
    proposed = {r.lang: {name: next((i for i in range(len(g)) if r[f"{name}@{i}"] <= allowed * r.n), len(g)) for name, g in GRIDS.items()} for r in strata}
    if not proposed:
        return {}
    rows = F.array(*[F.struct(F.lit(lang).cast("string").alias("of"), *[F.lit(i).alias(f"at_{name}") for name, i in p.items()]) for lang, p in proposed.items()])
    own = F.broadcast(counted.sparkSession.range(1).select(F.inline(rows)))
    steps = F.greatest(*[F.col(name) - F.col(f"at_{name}") for name in GRIDS])  # rejected at every step below this one
    seen = held.where("not learns").join(own, F.col("lang").eqNullSafe(F.col("of"))).groupBy("lang", steps.alias("step")).count().collect()
    out = {}
    for r in strata:
        certified = None
        for step in range(STEPS, -1, -1):
            k = sum(s["count"] for s in seen if s.lang == r.lang and s.step > step)
            if below(r.m, risk, k) > delta / len(strata):
                break
            certified = step
        if certified is not None:
            out[r.lang] = {name: GRIDS[name][i + certified] for name, i in proposed[r.lang].items() if i + certified < len(GRIDS[name])}
    return out


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang)``: its counts, base_failed, failed (rules, sorted), certified, kept."""
    counted = table(features(docs, "lang"), "quality")
    cuts = thresholds(counted, labels, risk, delta)
    none = [F.struct(F.lit(None).cast("string").alias("of"), *[F.lit(None).cast("double").alias(f"cut_{name}") for name in GRIDS])]
    rows = [F.struct(F.lit(lang).cast("string").alias("of"), *[F.lit(c.get(name)).cast("double").alias(f"cut_{name}") for name in GRIDS]) for lang, c in cuts.items()]
    own = docs.sparkSession.range(1).select(F.inline(F.array(*(rows or none)))).withColumn("certified", F.lit(bool(rows)))
    counted = counted.join(F.broadcast(own), F.col("lang").eqNullSafe(F.col("of")), "left")
    failed = [F.when(F.coalesce(value > F.col(f"cut_{name}"), F.lit(False)), F.lit(name)) for name, value in _values().items()]
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = counted.withColumn("base_failed", base).withColumn("certified", F.coalesce("certified", F.lit(False)))
    out = out.withColumn("failed", F.when(F.col("n_words") > 0, F.array_sort(F.array_compact(F.array(*failed)))).otherwise(F.expr("cast(array() as array<string>)")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("of", *[f"cut_{name}" for name in GRIDS])
