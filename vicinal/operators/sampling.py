"""Row samples, complements and bins. Samples depend on ids and the seed only, not on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(id_col: Column, seed: int) -> Column:
    """An order of ids that looks random: the md5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def sample_size(n: int, fraction: float) -> int:
    """ceil(n * fraction), at least 1 and at most n."""
    return min(n, max(1, math.ceil(n * fraction))) if n else 0


#: Leading hexadecimal digits of a draw that are counted to find the cut; the driver reads one row for each value.
DIGITS = 4


def cut(df: DataFrame, size: int, seed: int = 42, id_col: str = "id") -> Column:
    """Whether a row is among the ``size`` least by (draw, id): a filter without a join.

    Rows are counted by the leading digits of their draws, and only the few that share the boundary's digits are ranked.
    """
    drawn = df.select(draw(F.col(id_col), seed).alias("d"), F.col(id_col).alias("i"))
    lead = F.substring("d", 1, DIGITS)
    before = 0
    for r in sorted(drawn.groupBy(lead.alias("lead")).count().collect()):  # 16 ** DIGITS rows at most
        if before + r["count"] >= size:
            last = drawn.where(lead == r["lead"]).orderBy("d", "i").limit(size - before).agg(F.max(F.struct("d", "i"))).collect()[0][0]
            own = draw(F.col(id_col), seed)
            return (own < last.d) | ((own == last.d) & (F.col(id_col) <= last.i))
        before += r["count"]
    return F.lit(True)


def sample(df: DataFrame, fraction: float, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Exactly ceil(n * fraction) rows without replacement, the least by ``draw``."""
    return df.where(cut(df, sample_size(df.count(), fraction), seed, id_col))


def split(df: DataFrame, fraction: float, seed: int = 42, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """The sample and the other rows."""
    chosen = cut(df, sample_size(df.count(), fraction), seed, id_col)
    return df.where(chosen), df.where(~chosen)


def complement(df: DataFrame, chosen: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(chosen.select(id_col), id_col, "left_anti")


def positions(df: DataFrame, id_col: str = "id", ranges: int = 512) -> DataFrame:
    """(id, at): each row's position in the order of ids, from 0.

    Ids are cut into ranges of about equal numbers, counted, and ranked within their range, so no task sorts them all.
    """
    found = df.select(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)], 10 * ranges)).collect()[0][0]
    edges = sorted(set(found or []))
    of = F.expr(f"size(filter(array({', '.join(f'{e}L' for e in edges)}), e -> e < `{id_col}`))") if edges else F.lit(0)
    ranged = df.select(F.col(id_col), of.alias("_range"))
    before, total = {}, 0
    for r in sorted(ranged.groupBy("_range").count().collect()):  # one row a range
        before[r["_range"]] = total
        total += r["count"]
    base = F.get(F.array(*[F.lit(before.get(i, 0)).cast("long") for i in range(len(edges) + 1)]), F.col("_range"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(id_col)) - 1
    return ranged.select(id_col, (base + rank).alias("at"))


def gather(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of the given ids."""
    return df.join(ids.select(id_col), id_col, "left_semi")


def head(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The n rows of least id."""
    return df.orderBy(id_col).limit(n)


def scatter(train: DataFrame, rest: DataFrame) -> DataFrame:
    """Results of a sample and of the other rows, as one table; ids restore any order."""
    return train.unionByName(rest)


def random_pairs(df: DataFrame, m: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """(i, j) of m draws with replacement among the rows' positions by id; draws of a row with itself are left out."""
    n = df.count()
    if not n:
        return df.sparkSession.createDataFrame([], "i long, j long")
    at = positions(df, id_col)

    def position(side: int) -> Column:
        return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{side}:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long") % n

    drawn = df.sparkSession.range(m).select(position(0).alias("a"), position(1).alias("b")).where("a != b")
    x, y = at.select(F.col(id_col).alias("i"), F.col("at").alias("a")), at.select(F.col(id_col).alias("j"), F.col("at").alias("b"))
    return drawn.join(x, "a").join(y, "b").select("i", "j")


def conditional_label(df: DataFrame, condition: Column, yes: str, no: str, name: str = "label") -> DataFrame:
    return df.withColumn(name, F.when(condition, F.lit(yes)).otherwise(F.lit(no)))


def drop_housekeeping(df: DataFrame, columns: tuple[str, ...] = ("Time", "Cell_length", "DNA", "Viability")) -> DataFrame:
    """Without the columns that hold no marker; names that are not there are ignored."""
    return df.drop(*columns)
