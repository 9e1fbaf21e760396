"""Benchmark decontamination: a broadcast hash set of benchmark word windows, probed at every window of every document.

The benchmark's windows (13 words, or a whole shorter item) are hashed to 64 bits. Up to ``IN_PLAN`` hashes become a literal
set of the plan, which Spark ships to each executor once, and each document is scanned in place against it: only windows
that are in the set become rows. With more windows every document window becomes a row of a join on the hash, broadcast or
shuffled as Spark sees fit. Either way the words of what was found are then joined with the benchmark's, so a hit is always
a true one.

Defined results: a null text, or one without words, has no words and no hits. An item without words has no window.
Items that share a null id count as no item, though their windows hit. Repeated rows, ties and repeated ids each get
their own row's result; empty tables give empty or clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ITEM_WORD, covered, let, lower_ascii, running, table

#: Hashes (8 bytes each) up to this number are part of the plan.
IN_PLAN = 50_000
#: A result of this many hit rows is broadcast back to the texts; a larger one is shuffled.
BROADCAST_HITS = 200_000
#: As ITEM_WORD, for text whose A-Z are still there.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column, pattern: str = ITEM_WORD) -> Column:
    lowered = lower_ascii(text) if pattern == ITEM_WORD else text
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct (gram, size, hash, items): each window's words, word count, hash and sorted ids as strings."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = words.select("item", F.least(F.size("w"), F.lit(n)).alias("size"), "w")
    grams = cut.select("item", "size", F.expr("explode(transform(sequence(1, size(w) - size + 1), i -> slice(w, i, size)))").alias("g"))
    return grams.groupBy(F.array_join("g", " ").alias("gram"), "size", F.xxhash64("g").alias("hash")).agg(F.sort_array(F.collect_set("item")).alias("items"))


def _row_key() -> Column:
    """Equal rows have equal keys, and equal results."""
    return F.struct("doc_id", F.xxhash64("text").alias("h"))


NONE = "cast(array() as array<struct<b: int, e: int, gram: string>>)"


def _probe(sizes: dict[int, list[int]]) -> str:
    """SQL over ``w``: struct(b, e, gram) of the windows whose hash is in the literal set of their size."""
    parts = []
    for size, hashes in sorted(sizes.items()):
        known = ", ".join(f"{h}L" if h > -(2**63) else "(-9223372036854775807L - 1L)" for h in hashes)
        found = f"filter(if(size(w) < {size}, array(), sequence(1, size(w) - {size - 1})), i -> xxhash64(slice(w, i, {size})) in ({known}))"
        parts.append(f"transform({found}, i -> struct(i - 1 as b, i - 1 + {size} as e, array_join(slice(w, i, {size}), ' ') as gram))")
    return f"concat({', '.join(parts)})" if parts else NONE


def _all_windows(sizes: list[int]) -> str:
    """SQL over ``w``: struct(b, size, hash) of all windows of the given sizes."""
    parts = [f"transform(if(size(w) < {k}, array(), sequence(1, size(w) - {k - 1})), i -> struct(i - 1 as b, {k} as size, xxhash64(slice(w, i, {k})) as hash))" for k in sizes]
    return f"concat({', '.join(parts)})" if parts else "cast(array() as array<struct<b: int, size: int, hash: bigint>>)"


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, in_plan: int = IN_PLAN) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: key, doc_id, n_words, n_hit, items, spans, contaminated.

    ``spans`` are the maximal runs of hit words as half-open word positions; ``items`` the ids with a window here.
    contaminated: some word is hit, and at least one in twenty. ``key`` is the row's key.
    """
    windows = table(benchmark_windows(benchmark, n), "windows")
    few = windows.select("size", "hash").distinct().limit(in_plan + 1).collect()
    base = docs.select(_row_key().alias("key"), "doc_id", words_of(F.col("text")).alias("w"))
    if len(few) <= in_plan:
        sizes: dict[int, list[int]] = {}
        for r in few:
            sizes.setdefault(r["size"], []).append(r["hash"])
        probe = F.expr(f"transform(array(w), w -> struct(cast(size(w) as long) as n_words, {_probe(sizes)} as near))[0]")
        # a generator of one row: nothing that is asked of its result is evaluated on the words again
        seen = table(base.select("key", "doc_id", F.explode_outer(F.array(probe)).alias("c")).select("key", "doc_id", "c.*"), "scanned")
        near = seen.where("size(near) > 0").select("key", F.explode("near").alias("p")).select("key", "p.*")
    else:  # windows meet the benchmark by hash alone; only those that do are looked up again as words
        sizes = [r[0] for r in windows.select("size").distinct().orderBy("size").collect()]  # n values at most
        seen = base.select("key", "doc_id", F.size("w").cast("long").alias("n_words"))
        probes = base.select("key", F.explode(F.expr(f"transform(array(w), w -> {_all_windows(sizes)})[0]")).alias("p")).select("key", "p.*")
        met = probes.join(windows.select("size", "hash").distinct(), ["size", "hash"], "left_semi")
        met = table(met.groupBy("key").agg(F.collect_set(F.struct("b", "size")).alias("at")), "met")
        words = base.join(met, "key").select("key", F.expr("explode(transform(at, x -> struct(x.b as b, x.b + x.size as e, array_join(slice(w, x.b + 1, x.size), ' ') as gram)))").alias("p"))
        near = words.dropDuplicates(["key", "p"]).select("key", "p.*")
    true = near.join(windows.select("gram", F.col("items").alias("of")), "gram")
    found = table(true.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("b", "e"))).alias("found"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("of")))).alias("items")), "hits")
    out = seen.join(found, "key", "left").select(
        "key", "doc_id", "n_words", F.coalesce("found", F.expr("cast(array() as array<struct<b: int, e: int>>)")).alias("found"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
    out = out.select("key", "doc_id", "n_words", covered(F.col("found")).alias("n_hit"), "items", _merged(F.col("found")).alias("spans"))
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def _merged(found: Column) -> Column:
    """Sorted spans joined where they touch or overlap, in linear time."""

    def joined(x: Column) -> Column:
        tops = running(F.transform(x, lambda s: s["e"]), F.lit(0), lambda a, v: F.greatest(a, v))  # the furthest end so far
        return let(tops, lambda t: heads(x, t))

    def heads(x: Column, t: Column) -> Column:
        first = F.filter(F.transform(x, lambda s, i: F.struct(s["b"].alias("b"), i.alias("i"))), lambda s: (s["i"] == 0) | (F.get(t, s["i"] - 1) < s["b"]))
        return let(first, lambda f: F.transform(f, lambda s, i: F.struct(s["b"].alias("b"), F.get(t, F.coalesce(F.get(f, i + 1)["i"], F.size(t)) - 1).alias("e"))))

    return F.when(F.size(found) > 0, let(found, joined)).otherwise(F.expr("cast(array() as array<struct<b: int, e: int>>)"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *also: str, n: int = 13) -> DataFrame:
    """``docs(doc_id, text)`` without contaminated documents, and without the hit words of the others.

    Returns doc_id, ``also``, text. A text without hits comes back as it was; its words are not even looked for again.
    """
    hit = table(contamination(docs, benchmark, n).where("n_hit > 0").select("key", "spans", "contaminated").dropDuplicates(["key"]), "contaminated")
    few = hit.count() <= BROADCAST_HITS
    joined = docs.select("doc_id", *also, "text", _row_key().alias("key")).join(F.broadcast(hit) if few else hit.hint("shuffle_hash"), "key", "left")
    scored = joined.where(F.coalesce(~F.col("contaminated"), F.lit(True)))
    words, gaps = words_of(F.col("text"), RAW_WORD), F.split("text", RAW_WORD, -1)

    def rebuilt(w: Column) -> Column:
        pieces = let(gaps, lambda g: F.transform(w, lambda x, i: F.concat(x, F.get(g, i + 1))))

        def between(p: Column) -> Column:  # what stands between a span and the next one, at both ends of the text too
            def part(i: Column) -> Column:
                start = F.coalesce(F.get("spans", i - 1)["e"], F.lit(0))
                return F.array_join(F.slice(p, start + 1, F.coalesce(F.get("spans", i)["b"], F.size(p)) - start), "")

            return F.array_join(F.transform(F.sequence(F.lit(0), F.size("spans")), part), "")

        return F.concat(F.get(gaps, F.lit(0)), let(pieces, between))

    return scored.select("doc_id", *also, F.when(F.col("spans").isNull(), F.col("text")).otherwise(let(words, rebuilt)).alias("text"))
