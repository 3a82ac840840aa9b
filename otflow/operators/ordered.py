"""Ordered operators over keys of any weight.

A key with more rows than a task should order is cut into slices by quantiles of
its time (and of ``tie`` where many rows share one time). Windows then run by key
and slice, and what they need from before is carried over: :meth:`Sliced.led` gives
each slice copies of the last k rows before it, :meth:`Sliced.carried` the sums of
all slices before. Light keys are one slice; where no key is heavy nothing is copied
or joined. Cut points are bounded: at most ``MOST_CUTS`` in all, whatever the input.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key from which it is cut, and the number of cut points that the driver holds at most.
SLICE_ROWS, MOST_CUTS = 1_000_000, 10_000
_INNER = 64


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in ``spark.checkpoint.dir``, read back: what it comes from is computed once. Without such a
    folder it is persisted."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder}/w-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` dealt by ``key`` over parts of about ``rows`` rows: a task's share doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key)


def _same(left: DataFrame, right: DataFrame, names: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[prefix + n]) for n in names], F.lit(True))


class Sliced:
    """``df`` with ``_slice``. ``heavy`` tells whether any key is cut; its keys are then in ``cuts``."""

    def __init__(self, df: DataFrame, keys: list[str], cuts: DataFrame | None):
        self.df, self.keys, self.cuts, self.heavy = df, keys, cuts, cuts is not None

    def window(self, *order) -> Window:
        return Window.partitionBy(*self.keys, "_slice").orderBy(*order)

    def _cut_only(self, df: DataFrame) -> DataFrame:
        """Rows of heavy keys."""
        if not self.keys:
            return df
        marked = self.cuts.select(*[F.col(c).alias("_k_" + c) for c in self.keys])
        return df.join(F.broadcast(marked), _same(df, marked, self.keys, "_k_"), "left_semi")

    def led(self, order: list[str], k: int) -> DataFrame:
        """All rows and, with ``_copy`` set, the last ``k`` rows of the same key before each slice."""
        own = self.df.withColumn("_copy", F.lit(False))
        if not self.heavy:
            return own
        names = self.df.columns
        ends = self._cut_only(self.df).withColumn("_last", F.row_number().over(self.window(*[F.desc(c) for c in order]))).where(F.col("_last") <= k).drop("_last")
        # k rows a slice: few, so that a window may take all of a key
        along = Window.partitionBy(*self.keys).orderBy("_slice", *order)
        held = ends.withColumns({"_rows": F.collect_list(F.struct(*names)).over(along.rowsBetween(-(k - 1), 0)), "_next": F.lead("_slice").over(along)})
        tails = held.where(F.col("_next") > F.col("_slice")).select("_next", F.explode("_rows").alias("_row"))
        copies = tails.select(*[F.col("_next").alias("_slice") if n == "_slice" else F.col(f"_row.`{n}`").alias(n) for n in names], F.lit(True).alias("_copy"))
        return own.unionByName(copies)

    def carried(self, df: DataFrame, sums: dict[str, Column]) -> DataFrame:
        """``df`` (with the keys and ``_slice``) with sums over all slices of the key before a row's own; 0 in the first."""
        if not self.heavy:
            kinds = df.groupBy().agg(*[c.alias(n) for n, c in sums.items()]).schema
            return df.withColumns({f.name: F.lit(0).cast(f.dataType) for f in kinds.fields})
        parts = self._cut_only(df).groupBy(*self.keys, "_slice").agg(*[c.alias(n) for n, c in sums.items()])
        before = Window.partitionBy(*self.keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        whole = parts.select(*[F.col(c).alias("_k_" + c) for c in [*self.keys, "_slice"]], *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])
        joined = df.join(F.broadcast(whole), _same(df, whole, [*self.keys, "_slice"], "_k_"), "left")
        return joined.select(*[df[c] for c in df.columns], *[F.coalesce(whole[n], F.lit(0)).alias(n) for n in sums])


def placed(time: Column) -> Column:
    """``time`` as a number to cut by: null, which sorts first, is before all."""
    return F.coalesce(time.cast("double"), F.lit(float("-inf")))


def numeric(df: DataFrame, name: str) -> str | None:
    """``name``, if it is a number to cut ties by."""
    return name if dict(df.dtypes).get(name, "").split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") else None


def _search(cuts: Column, at: Column) -> Column:
    """How many of the sorted ``cuts``, in chunks, lie before ``at``: a look at the chunks' first, then at one chunk."""
    chunk = F.size(F.filter(cuts, lambda c: F.get(c, F.lit(0)) < at))
    inside = F.size(F.filter(F.get(cuts, chunk - 1), lambda c: c < at))
    return F.when(chunk == 0, 0).otherwise((chunk - 1) * _INNER + inside)


def sliced(df: DataFrame, keys: list[str], time: str, tie: str | None = None, rows: int = SLICE_ROWS) -> Sliced:
    """Cut heavy keys of ``df``. ``time`` and ``tie`` are numeric and not null; rows of one slice have times (and, where
    one time is heavy, ties) no larger than those of the next. Null keys are a key."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counted.agg(F.sum("_n").alias("all"), F.max("_n").alias("most")).first()
    rows = max(rows, -(-(total["all"] or 0) // MOST_CUTS))
    if (total["most"] or 0) <= rows:
        return Sliced(df.withColumn("_slice", F.lit(0)), keys, None)
    k = -(-total["most"] // rows)
    heavy = counted.where(F.col("_n") > rows).select(*[F.col(c).alias("_k_" + c) for c in keys], "_n")
    own = df.join(F.broadcast(heavy), _same(df, heavy, keys, "_k_"))
    shares = [i / k for i in range(1, k)]
    whole = own.groupBy(*keys).agg(F.percentile_approx(F.col(time).cast("double"), shares, 20 * k).alias("_at"), F.ceil(F.first("_n") / rows).cast("int").alias("_parts"))
    found = whole.select(*keys, F.expr(f"transform(sequence(1, _parts - 1), j -> _at[cast(j * {k}L div _parts as int) - 1])").alias("_at")).collect()
    points, ties = {}, []
    for i, r in enumerate(found):
        chosen = r["_at"]
        points[i] = sorted({(t, float("inf")) for t in chosen})
        if tie:
            ties += [(*[r[c] for c in keys], i, t, chosen.count(t)) for t in sorted({t for t in chosen if chosen.count(t) > 1})]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    if ties:
        most = max(t[-1] for t in ties) + 1
        at = df.sparkSession.createDataFrame(ties, ", ".join(f"`_k_{c}` {kinds[c]}" for c in keys) + f"{', ' if keys else ''}_tie_i int, _tie_at double, _tie_n int")
        crowded = df.join(F.broadcast(at), _same(df, at, keys, "_k_") & (F.col(time).cast("double") == F.col("_tie_at")))
        for r in crowded.groupBy("_tie_i", "_tie_at").agg(F.percentile_approx(F.col(tie).cast("double"), [j / most for j in range(1, most)], 20 * most).alias("ties")).collect():
            points[r["_tie_i"]] = sorted({*points[r["_tie_i"]], *((r["_tie_at"], q) for q in r["ties"])})
    table = [(*[r[c] for c in keys], [points[i][a : a + _INNER] for a in range(0, len(points[i]), _INNER)]) for i, r in enumerate(found)]
    cuts = df.sparkSession.createDataFrame(table, f"{schema}{', ' if keys else ''}_cuts array<array<struct<t:double,u:double>>>")
    named = cuts.select(*[F.col(c).alias("_k_" + c) for c in keys], "_cuts")
    joined = df.join(F.broadcast(named), _same(df, named, keys, "_k_"), "left")
    here = F.struct(F.col(time).cast("double").alias("t"), (F.col(tie).cast("double") if tie else F.lit(0.0)).alias("u"))
    out = joined.select(*df.columns, F.when(F.col("_cuts").isNull(), 0).otherwise(_search(F.col("_cuts"), here)).alias("_slice"))
    return Sliced(out, keys, cuts.select(*keys) if keys else cuts.select(F.lit(1).alias("_all")))
