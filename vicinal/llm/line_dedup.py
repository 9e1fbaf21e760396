"""Line dedup by a segment-partition edit join.

A line is dropped if an equal line stands earlier (in a document of smaller doc_id, or higher up in its own), or if
another line that first occurs earlier is within one edit. "Earlier" among different lines compares (least doc_id that
has the line, the line itself).

With a threshold of one edit a line is split into two segments: within one edit at least one segment is untouched. Each
distinct line files its two segments under (length, side, segment) and probes the segments that a line one shorter would
file, cut from its own start and end; so lines meet if and only if their lengths allow it. Groups that meet in a segment:

* small groups give their pairs, verified by a banded bit-parallel edit automaton (one word for each number of errors,
  one bit for each diagonal of the band);
* a group above ``SMALL`` is never paired. What its lines have in common is set aside and the rest of each is split again,
  until the groups are small or one character is left; then all its equally long lines are within one edit of the
  earliest, and each longer one has at most two partners. The work is linear in the group's size at every level.

Exact copies collapse before the join, by map-side aggregation on a 128-bit hash, so a very common line is one row.

Defined results: null texts have no lines and stay null. Lines without a word stay, wherever they repeat; lines shorter
than ``min_chars`` are dropped only as exact copies, as one edit may change all they say. Rows
of one doc_id count as one document; a null doc_id counts as the last. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, before, let, semi, table

SMALL = 8
_LAST = "coalesce(doc_id, 9223372036854775807L)"


def within(a: Column, b: Column, edits: int = 1) -> Column:
    """Whether two arrays of characters are within ``edits`` edits, by a banded bit-parallel automaton.

    Bit d of word e is set iff the first j + d - edits characters of ``a`` turn into the first j of ``b`` with at most e
    edits. Each character of ``b`` moves all diagonals at once by shifts and masks.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    start = F.struct(*[F.lit(sum(1 << (edits + i) for i in range(e + 1))).alias(f"r{e}") for e in range(edits + 1)])

    def run(x: Column, y: Column) -> Column:
        def step(r: Column, at: Column) -> Column:
            c = F.get(y, at)
            equal = F.lit(0)
            for d in range(width):
                i = at + (d - edits)
                equal = equal + F.when((i >= 0) & (F.get(x, i) == c), 1 << d).otherwise(0)
            return let(equal, lambda m: moved(r, m))

        def moved(r: Column, m: Column) -> Column:
            new, out = None, []
            for e in range(edits + 1):
                now = r[f"r{e}"].bitwiseAND(m)
                if e:
                    old = r[f"r{e - 1}"]
                    now = now.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new, 1)).bitwiseAND(F.lit(mask))
                new = now
                out.append(now.alias(f"r{e}"))
            return F.struct(*out)

        def body(r: Column, at: Column) -> Column:
            return F.when(r[f"r{edits}"] == 0, r).otherwise(step(r, at))  # all diagonals are dead

        steps = F.when(F.size(y) > 0, F.sequence(F.lit(0), F.size(y) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        end = F.size(x) - F.size(y) + edits
        return F.aggregate(steps, start, body, lambda r: F.getbit(r[f"r{edits}"], end) == 1)

    near = F.abs(F.size(a) - F.size(b)) <= edits
    return F.when(near, let(F.struct(a.alias("a"), b.alias("b")), lambda p: run(p["a"], p["b"]))).otherwise(F.lit(False))


def _lines(docs: DataFrame, min_chars: int = 0) -> DataFrame:
    """(doc, line) for the distinct lines of each document that hold a word and are long enough."""
    own = F.array_distinct(F.filter(F.split("text", "\n", -1), lambda x: (F.length(x) >= min_chars) & x.rlike(WORD)))
    return docs.select(F.expr(_LAST).alias("doc"), F.explode(own).alias("line"))


def _keys(text: str, length: str, parent: str) -> str:
    """SQL: the four (key, own, side) of a string: its own two segments, and those that one shorter would file."""
    out = []
    for size, own in ((length, "true"), (f"({length} - 1)", "false")):
        half = f"({size} div 2)"
        out.append(f"struct(xxhash64({parent}, {size}, 1, left({text}, cast({half} as int))) as key, {own} as own, 1 as side)")
        out.append(f"struct(xxhash64({parent}, {size}, 2, right({text}, cast({size} - {half} as int))) as key, {own} as own, 2 as side)")
    return "array(" + ", ".join(out) + ")"


def _met(keyed: DataFrame) -> DataFrame:
    """Members of groups with an own member and another one, with the group's size."""
    per = "over (partition by key)"
    sized = keyed.withColumn("size", F.expr(f"count(1) {per}")).withColumn("owns", F.expr(f"sum(cast(own as int)) {per}"))
    return sized.where("size > 1 and owns > 0").drop("owns")


def near_links(docs: DataFrame, lines: DataFrame, min_chars: int) -> DataFrame | None:
    """(a, b) texts' hashes of lines within one edit, a's line earlier; enough of them that each line with an earlier
    partner has one. None if no two lines share a segment."""
    met = table(_met(lines.where("k0 is not null").select("id", F.explode(F.array(*[F.struct(F.col(f"k{i}").alias("key"), F.lit(i < 2).alias("own"), F.lit(1 + i % 2).alias("side")) for i in range(4)])).alias("k")).select("id", "k.*")), "segments")
    ids = met.select("id").distinct()
    found = semi(_lines(docs, min_chars).withColumn("id", F.xxhash64("line")), ids, "id")
    texts = table(found.groupBy("id", "line").agg(F.min("doc").alias("first")), "candidates")
    if not texts.limit(1).count():
        return None
    pairs, links = [], []
    rest = met.where(F.col("size") > SMALL)
    level = 0
    while True:
        small = met.where(F.col("size") <= SMALL)
        x, y = small.where("own").alias("x"), small.alias("y")
        pairs.append(x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id"))).select(F.least("x.id", "y.id").alias("p"), F.greatest("x.id", "y.id").alias("q")))
        if not rest.limit(1).count():
            break
        if level == 0:
            rest = rest.join(texts.select("id", "line"), "id").withColumn("rest", F.col("line")).drop("line")
        # the segment in common goes; size is the length of an own member's remainder
        whole = F.expr("length(rest) - if(own, 0, 1)")
        cut = rest.withColumn("n", whole).withColumn("half", F.expr("n div 2"))
        cut = cut.withColumn("rest", F.expr("if(side = 1, substring(rest, cast(half + 1 as int)), left(rest, cast(length(rest) - (n - half) as int)))"))
        cut = cut.withColumn("n", F.expr("length(rest) - if(own, 0, 1)")).select(F.col("key").alias("parent"), "own", "id", "rest", "n")
        cut = table(cut, "remainders")
        # one character left (or none): equally long lines are all within one edit of each other
        ends = cut.where("n <= 1")
        order = ends.where("own").join(texts, "id").select("parent", "id", "first", "line", "rest")
        order = order.withColumn("head", F.expr("first(id) over (partition by parent order by first, line)"))
        links.append(order.where("id != head").select(F.col("head").alias("p"), F.col("id").alias("q")))
        longer = ends.where("not own").select("parent", F.col("id").alias("q"), F.explode(F.expr("if(n = 0, array(''), array_distinct(split(rest, '')))")).alias("rest"))
        links.append(longer.join(ends.where("own").select("parent", "rest", F.col("id").alias("p")), ["parent", "rest"]).select("p", "q"))
        again = ", ".join(f"struct(xxhash64(parent, n, {side}, {part}) as key, {side} as side)" for side, part in ((1, "left(rest, cast(n div 2 as int))"), (2, "right(rest, cast(n - n div 2 as int))")))
        more = cut.where("n > 1").select("id", "own", "rest", F.explode(F.expr(f"array({again})")).alias("k"))
        met = table(_met(more.select("id", "own", "rest", "k.*")), "segments")
        rest = met.where(F.col("size") > SMALL).select("key", "own", "side", "id", "rest")
        level += 1
    both = pairs[0]
    for p in pairs[1:]:
        both = both.union(p)
    a = texts.select(F.col("id").alias("p"), F.col("line").alias("x"), F.col("first").alias("fx"))
    b = texts.select(F.col("id").alias("q"), F.col("line").alias("y"), F.col("first").alias("fy"))
    checked = both.distinct().join(a, "p").join(b, "q").where(within(F.split("x", ""), F.split("y", "")))
    out = checked.select("x", "fx", "y", "fy")
    if links:
        sure = links[0]
        for p in links[1:]:
            sure = sure.union(p)
        out = out.union(sure.distinct().join(a, "p").join(b, "q").select("x", "fx", "y", "fy"))
    earlier = F.struct("fx", "x") < F.struct("fy", "y")
    return out.select(F.when(earlier, F.xxhash64("x")).otherwise(F.xxhash64("y")).alias("a"), F.when(earlier, F.col("y")).otherwise(F.col("x")).alias("line"))


def dedup_lines(docs: DataFrame, *also: str, min_chars: int = 20) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, ``also``, n_lines, n_removed, n_near, the text without dropped lines.

    n_near counts the removed lines that are no exact copy of an earlier one.
    """
    texts = docs.select("doc_id", "text")
    seen = _lines(texts)
    hashed = seen.select("doc", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"), F.when(F.length("line") >= min_chars, F.expr(_keys("line", "length(line)", "0"))).alias("k"))
    hashed = hashed.select("doc", "id", "id2", *[F.col("k")[i]["key"].alias(f"k{i}") for i in range(4)])
    lines = table(hashed.groupBy("id", "id2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("docs"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)]), "lines")
    near = near_links(texts, lines, min_chars)
    doomed = lines.where("docs > 1").select("id", "id2", "first", F.lit(False).alias("near"))
    if near is not None:
        gone = near.select("line").distinct().select(F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"), F.lit(True).alias("late"))
        late = lines.select("id", "id2", "first", "docs").join(table(gone, "late"), ["id", "id2"], "left")
        doomed = late.where("docs > 1 or late").select("id", "id2", "first", F.coalesce("late", F.lit(False)).alias("near"))
    doomed = table(doomed, "doomed")
    held = seen.select("doc", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"))
    few = doomed.count() <= 1_000_000
    drop = held.join(F.broadcast(doomed) if few else doomed, ["id", "id2"]).where("near or doc > first")
    drop = drop.groupBy("doc").agg(F.collect_list("id").alias("drop"), F.sum((F.col("near") & (F.col("doc") == F.col("first"))).cast("long")).alias("n_near"))
    out = docs.select("doc_id", "text", *also).withColumn("doc", F.expr(_LAST)).join(drop.hint("shuffle_hash"), "doc", "left")

    def kept(x: Column) -> Column:
        # lines in an order in which equal ones are neighbours, so that a text of many lines takes no search for each
        def marked(all_: Column) -> Column:
            gone = F.array_sort(F.array_distinct(F.coalesce("drop", F.expr("cast(array() as array<bigint>)"))))

            def doomed(sorted_: Column, d: Column) -> Column:
                def stays(s: Column, i: Column) -> Column:
                    h = F.xxhash64(s["line"])
                    at = before(F.size(d), lambda m: F.get(d, m) < h)
                    again = F.coalesce((i > 0) & (F.get(sorted_, i - 1)["line"] == s["line"]), F.lit(False))
                    return ~s["line"].rlike(WORD) | (~again & ~F.coalesce(F.get(d, at) == h, F.lit(False)))

                return F.transform(F.array_sort(F.transform(F.filter(sorted_, stays), lambda s: F.struct(s["at"].alias("at"), s["line"].alias("line")))), lambda s: s["line"])

            rows = F.sort_array(F.transform(all_, lambda s, i: F.struct(s.alias("line"), i.alias("at"))))
            return let(F.struct(rows.alias("rows"), gone.alias("gone")), lambda p: doomed(p["rows"], p["gone"]))

        clean = F.col("drop").isNull() & (F.size(F.array_distinct(x)) == F.size(x))
        return F.when(clean, x).otherwise(marked(x))

    parts = F.split("text", "\n", -1)
    out = out.select("doc_id", "text", *also, parts.alias("was"), F.coalesce("n_near", F.lit(0)).alias("n_near"), let(parts, kept).alias("now"))
    return out.select(
        "doc_id", *also, F.coalesce(F.size("was"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("was") - F.size("now"), F.lit(0)).cast("long").alias("n_removed"),
        "n_near", F.when(F.size("was") == F.size("now"), F.col("text")).otherwise(F.array_join("now", "\n")).alias("text"),
    )
