"""Ranks and running counts over a whole table, without sorting it in one task.

Equal values are merged first, so a value that fills a third of the table is one row. The distinct values
are cut into consecutive parts; a running sum inside a part plus the total of the parts before gives the
position of every value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from raretide.operators.joins import HOT_ROWS, HotKeys, left_join_spread
from raretide.session import stage

PARTS = 200
PART_ROWS = 100_000
EXPLODE_ROWS = 100_000


def weight_before(
    df: DataFrame, by: Sequence[str], order: str, weights: Sequence[str], part: Column
) -> DataFrame:
    """Add ``before_<w>``: the sum of each weight over rows of smaller ``order`` in the same group.

    ``order`` is unique in a group; ``part`` grows with it and bounds the rows of one part.
    """
    rows = df.withColumn("_part", part)
    totals = rows.groupBy(*by, "_part").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_part", *[F.sum(f"_t_{w}").over(earlier).alias(f"_o_{w}") for w in weights])
    inside = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumns({f"_r_{w}": F.sum(w).over(inside) for w in weights})
    joined = running.join(offsets, [*by, "_part"])
    zero = F.lit(0)
    return joined.withColumns(
        {f"before_{w}": F.coalesce(f"_r_{w}", zero) + F.coalesce(f"_o_{w}", zero) for w in weights}
    ).drop("_part", *[f"{p}_{w}" for p in ("_r", "_o") for w in weights])


def value_positions(df: DataFrame, column: str, parts: int = PARTS) -> DataFrame:
    """value, n, before_n (rows with a smaller value) and before_one (smaller distinct values)."""
    counts = (
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shares = [i / parts for i in range(1, parts)]
    distinct, cuts = counts.agg(F.count(F.lit(1)), F.percentile_approx("value", shares, 10 * parts)).first()
    cuts = sorted(set(cuts or [])) if distinct > PART_ROWS else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("value"))) if cuts else F.lit(0)
    return weight_before(counts.withColumn("one", F.lit(1)), [], "value", ["n", "one"], part).drop("one")


def average_ranks(df: DataFrame, columns: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each column replaced by its 1-based average rank; null stays null."""
    out = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    rows = df.count()
    if rows <= PART_ROWS:  # one part: the built-in ranking windows do
        def rank(c: str) -> Column:
            w = Window.orderBy(F.asc_nulls_last(c))
            # first and last position of the ties of a value
            return F.when(F.col(c).isNotNull(), (F.rank().over(w) + F.round(F.cume_dist().over(w) * rows)) / 2)

        return out.select(*[rank(c).alias(c) for c in columns])
    # Rows of one value are told apart by their place in a written copy, also where whole rows are equal.
    out = stage(out, "rank-input").withColumn("_row", F.monotonically_increasing_id())
    for c in columns:
        found = value_positions(df, c)
        hot = HotKeys({r["value"]: r["n"] for r in found.where(F.col("n") >= hot_rows).select("value", "n").collect()}, hot_rows)
        ranks = found.select(
            F.col("value").alias(c), (F.col("before_n") + (F.col("n") + 1) / 2).alias("_rank")
        )
        out = left_join_spread(out, ranks, [c], c, hot, "_row").withColumn(c, F.col("_rank")).drop("_rank")
    return out.select(*columns)


def ordered_values(df: DataFrame, column: str, parts: int = PARTS) -> DataFrame:
    """One row per non-null value: its 1-based position in ascending order. Ties get consecutive positions.

    A much repeated value is expanded in blocks that are dealt to several tasks.
    """
    values = value_positions(df, column, parts)
    blocks = values.select(
        "value", "before_n", "n",
        F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("bigint"), F.lit(EXPLODE_ROWS))).alias("start"),
    ).repartition("value", "start")
    stop = F.least(F.col("start") + EXPLODE_ROWS, F.col("n")) - 1
    offset = F.explode(F.sequence(F.col("start"), stop)).alias("offset")
    return blocks.select("value", "before_n", offset).select(
        (F.col("before_n") + F.col("offset") + 1).cast("bigint").alias("position"), "value"
    )


def kendall_taus(df: DataFrame, columns: Sequence[str]) -> dict[tuple[int, int], float | None]:
    """Kendall's tau-b of every two columns, by their places, each over the rows where both are present.

    Each column is ranked once; twice an average rank is a whole number that orders and ties as the values do.
    Discordant pairs are counted, not listed: two ranks of the second column differ first in one binary digit, so
    for each digit the rows with 1 that precede a row with 0 under the same leading digits are summed. That is one
    running sum per digit over the distinct cells of a pair of columns. All pairs share one table of cells and one
    job per kind of sum, however many columns there are.
    """
    names = [f"c{i}" for i in range(len(columns))]
    pairs = list(combinations(range(len(columns)), 2))
    taus: dict[tuple[int, int], float | None] = dict.fromkeys(pairs)
    if not pairs:
        return taus
    renamed = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)])
    ranked = average_ranks(renamed, names).select(*[F.round(F.col(n) * 2).cast("bigint").alias(n) for n in names])
    both = F.array(*[
        F.struct(F.lit(k).alias("pair"), F.col(names[i]).alias("rx"), F.col(names[j]).alias("ry")) for k, (i, j) in enumerate(pairs)
    ])
    present = ranked.select(F.inline(both)).where("rx is not null and ry is not null")
    cells = stage(present.groupBy("pair", "rx", "ry").agg(F.count(F.lit(1)).alias("n")), "rank-cells")
    top = cells.agg(F.max("ry")).first()[0]
    if top is None:
        return taus

    def tied(kind: str, *by: str) -> DataFrame:
        t = F.col("t").cast("double")
        groups = cells.groupBy("pair", *by).agg(F.sum("n").alias("t"))
        return groups.groupBy("pair").agg(F.sum(t * (t - 1) / 2).alias("value")).select("pair", F.lit(kind).alias("kind"), "value")

    digits = F.sequence(F.lit(0), F.lit(int(top).bit_length() - 1))
    by_level = cells.withColumn("level", F.explode(digits))
    digit = F.expr("shiftright(ry, level) & 1")
    sums = by_level.groupBy("pair", "level", F.expr("shiftright(ry, level + 1)").alias("lead"), "rx").agg(
        F.sum(F.when(digit == 1, F.col("n")).otherwise(0)).alias("ones"),
        F.sum(F.when(digit == 0, F.col("n")).otherwise(0)).alias("zeros"),
    )
    before = weight_before(sums, ["pair", "level", "lead"], "rx", ["ones"], F.floor(F.col("rx") / (2 * PART_ROWS)))
    crossings = before.groupBy("pair").agg(F.sum(F.col("zeros").cast("double") * F.col("before_ones")).alias("value"))
    kinds = [tied("all"), tied("x", "rx"), tied("y", "ry"), tied("both", "rx", "ry"),
             crossings.select("pair", F.lit("crossed").alias("kind"), "value")]
    found = {(row["pair"], row["kind"]): row["value"] for row in reduce(DataFrame.union, kinds).collect()}  # five numbers a pair
    for k, pair in enumerate(pairs):
        n0, n1, n2, n3, crossed = (found.get((k, kind)) or 0.0 for kind in ("all", "x", "y", "both", "crossed"))
        if n0 > n1 and n0 > n2:
            concordant = n0 - n1 - n2 + n3 - crossed
            taus[pair] = (concordant - crossed) / ((n0 - n1) * (n0 - n2)) ** 0.5
    return taus


def kendall_tau(df: DataFrame, a: str, b: str) -> float | None:
    """Kendall's tau-b over the rows where both columns are present."""
    return kendall_taus(df, [a, b])[0, 1]
