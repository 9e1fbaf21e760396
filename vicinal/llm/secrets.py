"""Secret scans: fixed patterns, and a randomness test battery over long tokens with false-discovery control.

Base spans come from three patterns (kinds assign, access, hex). The battery looks at every other token of 20 or more
characters of a base-64 alphabet. Each token has an inferred encoding (hex, letters of one case, base 32, base 36, base 64),
which gives its alphabet; numbers are left out. Two questions are asked of it:

* Do its characters look independent and uniform over the alphabet? Three tests answer by tail probabilities under that
  hypothesis: chi-squared uniformity (upper tail, by Wilson and Hilferty's cube root, with the statistic's exact variance),
  runs of the lower and upper half of the alphabet (Wald and Wolfowitz, both tails), and circular serial correlation of
  neighbouring codes (both tails, by its exact mean and variance for random orders). ``battery`` is three times the least
  of them, which is valid however they depend on each other. A token with less than ``alpha`` is ordinary, so at most that
  share of random tokens is lost here.
* Would ordinary text look like that? The null hypothesis is a chain of text in the token's encoding: classes of characters
  follow each other as in words, names and paths (``FOLLOWS``, or ``ONE_CASE`` where case says nothing), letters have the
  shares of Latin-script prose, and characters may also repeat, alternate or count upwards. Under it, the likelihood ratio
  of uniform characters to the chain is r or more with a probability of 1/r at most, whatever the length.

A token's p-value is 1/r, or 1 where the battery finds it not random; either way it is valid under the chain.
Benjamini-Hochberg at level ``fdr`` runs within each length class (powers of two), over counts of p-values in bins of a
twentieth of a decade, so long and short tokens do not lend each other credit.

All of it is Column expressions; what reaches the driver is one count for each length class and bin that occurs.

Defined results: a null text is empty and has no spans. Positions are code points, end exclusive. Rows are independent,
save that the cut-off counts all tokens; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before, let, running, table

#: The base kinds in their order: pattern, and the least length of the match or of its group 2.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
SPAN = "struct<b: int, kind: int, e: int>"
#: Numbers are never weighed: their digits look random, but are ordinary text.
NUMBER = "^[0-9]+$"
ALPHABETS = [
    ("^([0-9a-f]+|[0-9A-F]+)=*$", "0123456789abcdef"),
    ("^([a-z]+|[A-Z]+)=*$", "abcdefghijklmnopqrstuvwxyz"),
    ("^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("^([a-z0-9]+|[A-Z0-9]+)=*$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]
#: Letters a to z in a thousand of Latin-script prose, several languages together.
LETTERS = [82, 15, 30, 42, 140, 15, 17, 30, 72, 4, 10, 45, 27, 75, 62, 22, 6, 66, 68, 68, 42, 14, 12, 3, 10, 8]
#: Shares of the next class (lower case, upper case, digit, other) after each class, in text; the same without case.
FOLLOWS = [[0.75, 0.10, 0.04, 0.11], [0.60, 0.27, 0.05, 0.08], [0.10, 0.10, 0.70, 0.10], [0.50, 0.25, 0.15, 0.10]]
ONE_CASE = [[0.96, 0, 0.04, 0], [0, 0, 0, 0], [0.20, 0, 0.80, 0], [0, 0, 0, 0]]
#: Parts of the chain: text, the character before again, the one before that, the next one of the alphabet.
TEXT, AGAIN, ALTERNATE, UPWARDS = 0.85, 0.05, 0.05, 0.05


def _spans(text: Column, pattern: str, kind: int, least: int = 0, words: bool = False) -> Column:
    """All leftmost matches of ``pattern`` as struct(b, kind, e); with ``least``, those whose group 2 is that long; with
    ``words``, their text as well, as word."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tails = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else matches
    sizes = F.zip_with(F.zip_with(matches, pieces, lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("m"), m.alias("word"))), tails, lambda s, t: F.struct(s["gap"].alias("gap"), s["m"].alias("m"), s["word"].alias("word"), F.length(t).alias("t")))

    def placed(x: Column) -> Column:
        ends = running(F.transform(x, lambda v: v["gap"] + F.coalesce(v["m"], F.lit(0))), F.lit(0), lambda a, v: a + v)
        found = F.zip_with(x, ends, lambda v, e: F.struct((e - v["m"]).alias("b"), F.lit(kind).alias("kind"), e.alias("e"), v["t"].alias("t"), v["word"].alias("word")))
        return F.transform(F.filter(found, lambda v: v["b"].isNotNull() & (v["t"] >= least)), lambda v: F.struct(*[v[c].alias(c) for c in ("b", "kind", "e", *(["word"] if words else []))]))

    return F.when(text.rlike(pattern), let(sizes, placed)).otherwise(F.expr(f"cast(array() as array<{SPAN[:-1]}{', word: string' if words else ''}>>)"))


def _phi(z: Column) -> Column:
    """Normal lower tail, by the logistic approximation of Page's cubic; monotone, error below 2e-4."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _above(z: Column) -> Column:
    """Normal upper tail."""
    return 1 - _phi(z)


def _array(values: list[float]) -> str:
    return f"array({', '.join(f'{v!r}D' for v in values)})"


def encoded(token: Column, of) -> Column:
    """``of`` a struct: codes of the token in its inferred encoding, k, and the chain's shares of first and of next codes.
    Padding is off, and case away where the alphabet has one."""
    bare = F.translate(F.regexp_replace(token, "=+$", ""), "-_=", "+/+")
    tables = F.expr(f"array({', '.join('named_struct(' + repr('a') + ', ' + repr(a) + ', ' + repr('first') + f', {_array(_chain(a)[0])}, ' + repr('next') + f', {_array(_chain(a)[1])})' for _, a in ALPHABETS)})")

    def chosen(t: Column) -> Column:
        which = F.lit(len(ALPHABETS) - 1)
        for i, (pattern, _) in reversed(list(enumerate(ALPHABETS[:-1]))):
            which = F.when(t.rlike(pattern), i).otherwise(which)

        def coded(a: Column) -> Column:
            letters = F.when(F.length(a["a"]) < 64, F.lower(t)).otherwise(t)
            return F.struct(F.transform(F.split(letters, ""), lambda c: F.instr(a["a"], c) - 1).alias("x"), F.length(a["a"]).cast("double").alias("k"), a["first"].alias("first"), a["next"].alias("next"))

        return let(F.get(tables, which), lambda a: let(coded(a), of))

    return F.when((F.length(bare) >= 20) & ~bare.rlike(NUMBER), let(bare, chosen)).otherwise(F.lit(0.0))


def battery(x: Column, k: Column) -> Column:
    """Combined p-value of uniform, independent codes 0 to k - 1, for 20 codes or more."""
    n = F.size(x).cast("double")
    squares = F.aggregate(F.transform(F.array_distinct(x), lambda s: F.size(F.filter(x, lambda y: y == s)).cast("double")), F.lit(0.0), lambda a, c: a + c * c)
    # chi-squared has k - 1 degrees; its variance is less than 2 (k - 1) by (n - 1) / n, so it is stretched about its mean
    chi2 = (k - 1) + (squares * k / n - n - (k - 1)) * F.sqrt(n / (n - 1))
    cube = F.pow(F.greatest(chi2, F.lit(0.0)) / (k - 1), F.lit(1 / 3))
    uniform = _above((cube - 1 + 2 / (9 * (k - 1))) / F.sqrt(2 / (9 * (k - 1))))
    upper = F.transform(x, lambda c: c >= F.floor(k / 2))
    high = F.size(F.filter(x, lambda c: c >= F.floor(k / 2))).cast("double")
    changes = let(upper, lambda u: F.aggregate(u, F.struct(F.get(u, F.lit(0)).alias("last"), F.lit(0).alias("n")), lambda a, c: F.struct(c.alias("last"), (a["n"] + F.when(c != a["last"], 1).otherwise(0)).alias("n")), lambda a: a["n"]))
    both = 2 * high * (n - high)
    spread = both * (both - n) / (n * n * (n - 1))
    z = (F.abs(changes - both / n) - 0.5) / F.sqrt(F.greatest(spread, F.lit(1e-9)))  # runs are changes and one more
    runs = F.when(both == 0, F.exp((1 - n) * math.log(2))).otherwise(F.least(F.lit(1.0), 2 * _above(F.greatest(z, F.lit(0.0)))))
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n

    def along(y: Column) -> Column:
        squared = F.aggregate(y, F.lit(0.0), lambda a, v: a + v * v)
        near = F.aggregate(y, F.struct(F.get(y, F.size(y) - 1).alias("last"), F.lit(0.0).alias("s")), lambda a, v: F.struct(v.alias("last"), (a["s"] + a["last"] * v).alias("s")), lambda a: a["s"])
        z = (near / squared + 1 / (n - 1)) / F.sqrt(n * (n - 3) / ((n + 1) * (n - 1) * (n - 1)))
        return F.when(squared == 0, 0.0).otherwise(F.least(F.lit(1.0), 2 * _above(F.abs(z))))

    serial = let(let(mean, lambda m: F.transform(x, lambda v: v - m)), along)
    return F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial))


def _chain(alphabet: str) -> tuple[list[float], list[float]]:
    """Shares in text of a first code, and of each code after each."""
    kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in alphabet]
    weight = [LETTERS[ord(c.lower()) - 97] if c.isalpha() else 1 for c in alphabet]
    whole = [sum(w for w, q in zip(weight, kind) if q == of) for of in range(4)]
    follows = FOLLOWS if len(alphabet) == 64 else ONE_CASE
    return [follows[0][q] * w / whole[q] for w, q in zip(weight, kind)], [TEXT * follows[p][q] * w / whole[q] for p in kind for w, q in zip(weight, kind)]


def log_ratio(of: Column) -> Column:
    """Natural logarithm of the likelihood ratio of uniform codes to the chain of text, for a struct of ``encoded``."""
    x, k = of["x"], of["k"]

    def one(i: Column) -> Column:
        def share(here: Column, last: Column) -> Column:
            two = F.when((i > 1) & (here == F.get(x, i - 2)), ALTERNATE).otherwise(0.0)
            return F.get(of["next"], (last * k + here).cast("int")) + F.when(here == last, AGAIN).otherwise(0.0) + two + F.when(here == last + 1, UPWARDS).otherwise(0.0)

        return share(F.get(x, i), F.get(x, i - 1))

    return -F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.log(F.get(of["first"], F.get(x, F.lit(0)))), lambda a, i: a + F.log(one(i))) - F.size(x) * F.log(k)


def _log_p(token: Column, alpha: float) -> Column:
    """log10 of a token's p-value under the chain of text."""
    return encoded(token, lambda of: F.when(battery(of["x"], of["k"]) >= alpha, F.least(F.lit(0.0), -log_ratio(of) / math.log(10))).otherwise(0.0))


def scan(docs: DataFrame, fdr: float = 0.001, alpha: float = 0.001) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id and spans, an array of struct(b, kind, e) by start, then kind.

    kind indexes KINDS. Random tokens that touch a base span are left out; base spans always stay.
    """
    text = F.coalesce("text", F.lit(""))
    spans = docs.select("doc_id", F.sort_array(F.concat(_spans(text, ASSIGN, 0, 6), _spans(text, ACCESS, 1), _spans(text, HEX, 2))).alias("base"), _spans(text, TOKEN, 3, words=True).alias("all"))

    def free(y: Column) -> Column:
        tops = running(F.transform(y, lambda z: z["e"]), F.lit(0), lambda a, v: F.greatest(a, v))  # the furthest end so far

        def apart(s: Column, base: Column, top: Column) -> Column:
            earlier = before(F.size(base), lambda m: F.get(base, m)["b"] < s["e"])
            return F.coalesce(F.get(top, earlier - 1) <= s["b"], F.lit(True))

        return let(F.struct(y.alias("y"), tops.alias("tops")), lambda p: F.filter(F.col("all"), lambda s: apart(s, p["y"], p["tops"])))

    def scored(s: Column) -> Column:
        return F.struct(s["b"].alias("b"), s["kind"].alias("kind"), s["e"].alias("e"), F.floor(-20 * _log_p(s["word"], alpha)).cast("int").alias("bin"))

    none = F.expr("cast(array() as array<struct<b: int, kind: int, e: int, bin: int>>)")
    left = F.when(F.size("base") == 0, F.col("all")).otherwise(free(F.col("base")))
    found = spans.select("doc_id", "base", F.when(F.size("all") > 0, F.transform(left, scored)).otherwise(none).alias("tokens"))
    found = table(found, "secrets")
    size = F.floor(F.log2((F.col("t.e") - F.col("t.b")).cast("double"))).cast("int")
    counts = found.select(F.explode("tokens").alias("t")).groupBy(size.alias("size"), F.col("t.bin").alias("bin")).count().collect()
    cuts = cutoffs([(r["size"], r["bin"], r["count"]) for r in counts], fdr)
    ranges = " or ".join(f"(s.e - s.b >= {2**of} and s.e - s.b < {2 ** (of + 1)} and s.bin >= {cut})" for of, cut in sorted(cuts.items())) or "false"
    added = F.expr(f"transform(filter(tokens, s -> {ranges}), s -> struct(s.b as b, s.kind as kind, s.e as e))")
    return found.select("doc_id", F.sort_array(F.concat("base", added)).alias("spans"))


def cutoffs(counts: list[tuple[int, int, int]], fdr: float) -> dict[int, int]:
    """{length class: least bin rejected} by Benjamini-Hochberg within each class; a bin counts with its largest p."""
    out = {}
    for of in {c[0] for c in counts}:
        bins = sorted(((b, n) for s, b, n in counts if s == of), reverse=True)
        total, seen = sum(n for _, n in bins), 0
        for b, n in bins:
            seen += n
            if total * math.pow(10, -b / 20) <= fdr * seen:
                out[of] = b
    return out


def text_of(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["b"].cast("string"), s["e"].cast("string"))), ",")
