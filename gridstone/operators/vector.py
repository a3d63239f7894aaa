"""Indexed vectors: a DataFrame with a dense BIGINT index and one column for each component.

Order is the index, never the physical order of rows. Views are lazy and
return new vectors; what the mutating forms of such libraries write in place
comes back as a new vector here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDX = "idx"
#: Rows of a block in block-wise operators.
BLOCK_ROWS = 1 << 20

Fn = Callable[..., Column]


def div(a: Column, n: int | Column) -> Column:
    """Integer division; exact at any size, unlike a quotient of doubles."""
    return F.call_function("div", a, n if isinstance(n, Column) else F.lit(n))


class Vec:
    """``df`` has the index ``idx`` (0 to n - 1, each once) and the components named in ``cols``.

    ``base`` remembers the DataFrame that the components are expressions over,
    so that zipping vectors of one base is a projection and not a join.
    """

    def __init__(self, df: DataFrame, cols: list[str] | None = None, base: DataFrame | None = None, exprs: dict[str, Column] | None = None):
        self.cols = list(cols or exprs or [c for c in df.columns if c != IDX])
        self.base = df if base is None else base
        self.exprs = dict(exprs) if exprs is not None else {c: F.col(c) for c in self.cols}

    @property
    def df(self) -> DataFrame:
        return self.base.select(IDX, *[self.exprs[c].alias(c) for c in self.cols])

    @staticmethod
    def from_table(table: DataFrame, key: str, **cols: str | Column) -> Vec:
        """A vector over a table whose ``key`` is dense from 0; the table itself stays the base."""
        exprs = {name: F.col(c) if isinstance(c, str) else c for name, c in cols.items()}
        return Vec(table, list(exprs), table.withColumn(IDX, F.col(key).cast("bigint")), exprs)

    @staticmethod
    def iota(spark: SparkSession, n: int, start: int = 0) -> Vec:
        return Vec(spark.range(n).select(F.col("id").alias(IDX), (F.col("id") + start).alias("v")))

    @staticmethod
    def filled(spark: SparkSession, n: int, value: object = 0) -> Vec:
        return Vec(spark.range(n).select(F.col("id").alias(IDX), F.lit(value).alias("v")))

    @staticmethod
    def of(spark: SparkSession, values: list, kind: str = "bigint") -> Vec:
        """A vector of a few local values."""
        return Vec(spark.createDataFrame(list(enumerate(values)), f"{IDX} bigint, v {kind}"))

    def pick(self, *cols: str) -> Vec:
        """Some components; they keep the base, so that zipping them again is a projection."""
        return Vec(self.base, list(cols), self.base, {c: self.exprs[c] for c in cols})

    def over(self, df: DataFrame) -> Vec:
        return Vec(df, self.cols)

    # Views

    def transform(self, fn: Fn, name: str = "v") -> Vec:
        """One component from all; nothing is computed until an action, and projections collapse."""
        return Vec(self.base, [name], self.base, {name: fn(*[self.exprs[c] for c in self.cols])})

    def take(self, n: int) -> Vec:
        return self._range(0, n)

    def drop(self, n: int) -> Vec:
        return self._range(n, None)

    def slice(self, start: int, stop: int) -> Vec:
        return self._range(start, stop)

    def counted(self, start: int, n: int) -> Vec:
        return self._range(start, start + n)

    def subrange(self, first: int, last: int) -> Vec:
        return self._range(first, last)

    def _range(self, start: int, stop: int | None) -> Vec:
        """[start, stop) with the index from 0; bounds beyond the end are the end."""
        kept = F.col(IDX) >= max(0, start)
        if stop is not None:
            kept = kept & (F.col(IDX) < stop)
        return self.over(self.df.filter(kept).withColumn(IDX, F.col(IDX) - F.lit(max(0, start)).cast("bigint")))

    def all(self) -> Vec:
        """The whole vector as a view."""
        return self

    def enumerate(self, name: str = "i") -> Vec:
        return Vec(self.base, [name, *self.cols], self.base, {name: F.col(IDX), **self.exprs})

    def ranked(self, name: str = "rank") -> Vec:
        """With the number of the partition that holds each row."""
        return Vec(self.df.withColumn(name, F.spark_partition_id()))

    def segmented(self, parts: int) -> Vec:
        """Dealt to contiguous ranges of the index."""
        return self.over(self.df.repartitionByRange(parts, IDX))

    def segmented_by(self, lengths: list[int], name: str = "segment") -> Vec:
        """With the number of the segment that holds each element; segments have the given lengths, the last takes the rest."""
        from gridstone.operators import segments

        return segments.segmented_by(self, lengths, name)

    def segmented_like(self, other: Vec, name: str = "segment") -> Vec:
        """Segmented at the places where other's partitions begin; its rows must lie in ranges of the index."""
        from gridstone.operators import segments

        return segments.segmented_like(self, other, name)

    def segments(self) -> DataFrame:
        """How many rows each partition holds, and from where to where."""
        return self.df.groupBy(F.spark_partition_id().alias("segment")).agg(F.count("*").alias("n"), F.min(IDX).alias("first"), F.max(IDX).alias("last"))

    def chunk(self, n: int, name: str = "chunk") -> DataFrame:
        """Arrays of n consecutive elements, the last perhaps shorter."""
        key = div(F.col(IDX), n)
        pair = F.sort_array(F.collect_list(F.struct(IDX, *self.cols)))
        return self.df.groupBy(key.alias(IDX)).agg(F.transform(pair, lambda x: x[self.cols[0]]).alias(name))

    # Elementwise

    def for_each(self, fn: Fn, col: str | None = None) -> Vec:
        """The component replaced by fn of all components."""
        return self._update(F.lit(True), fn, col)

    def for_each_n(self, start: int, n: int, fn: Fn, col: str | None = None) -> Vec:
        return self._update(self._within(start, start + n), fn, col)

    def for_each_indexed(self, fn: Fn, col: str | None = None) -> Vec:
        """As for_each; fn also gets the index, first."""
        return self._update(F.lit(True), lambda *x: fn(F.col(IDX), *x), col)

    def fill(self, value: object, start: int = 0, stop: int | None = None) -> Vec:
        return self._update(self._within(start, stop), lambda *_: F.lit(value), None)

    def fill_iota(self, start: int = 0) -> Vec:
        return self._update(F.lit(True), lambda *_: F.col(IDX) + F.lit(start).cast("bigint"), None)

    def _within(self, start: int, stop: int | None) -> Column:
        inside = F.col(IDX) >= start
        return inside if stop is None else inside & (F.col(IDX) < stop)

    def _update(self, where: Column, fn: Fn, col: str | None) -> Vec:
        col = col or self.cols[0]
        new = F.when(where, fn(*[self.exprs[c] for c in self.cols])).otherwise(self.exprs[col])
        return Vec(self.base, self.cols, self.base, {**self.exprs, col: new})

    def transform_into(self, out: Vec, fn: Fn, at: int = 0) -> Vec:
        """out with fn of this vector written from place ``at`` on; what does not fit is left out."""
        moved = self.transform(fn, "__new").df.withColumn(IDX, F.col(IDX) + F.lit(at).cast("bigint")).withColumn("__hit", F.lit(True))
        col = out.cols[0]
        joined = out.df.join(moved, IDX, "left")
        new = F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(col)).alias(col)
        return Vec(joined.select(IDX, new, *out.cols[1:]))

    def copy_into(self, out: Vec, at: int = 0) -> Vec:
        return self.transform_into(out, lambda x, *_: x, at)

    def resize(self, size: int, n: int, value: object = 0) -> Vec:
        """The first n elements of this vector of ``size``, padded with value where n is larger."""
        if n <= size:
            return self.take(n)
        col = self.cols[0]
        kind = self.df.schema[col].dataType
        more = self.base.sparkSession.range(size, n).select(F.col("id").alias(IDX), F.lit(value).cast(kind).alias(col))
        return Vec(self.df.select(IDX, col).union(more))

    def get(self, i: int) -> object:
        row = self.df.filter(F.col(IDX) == i).select(self.cols[0]).first()
        if row is None:
            raise IndexError(i)
        return row[0]

    def put(self, i: int, value: object) -> Vec:
        return self._update(F.col(IDX) == i, lambda *_: F.lit(value), None)

    def to_pandas(self):
        return self.df.orderBy(IDX).toPandas()

    def to_root(self) -> list:
        """The first component's values in order, on the driver; for small vectors."""
        return [r[0] for r in self.df.orderBy(IDX).select(self.cols[0]).collect()]

    @staticmethod
    def from_root(spark: SparkSession, values: list, kind: str = "double", name: str = "v") -> Vec:
        """A vector from values on the driver."""
        return Vec(spark.createDataFrame(list(enumerate(values)), f"{IDX} bigint, {name} {kind}"), [name])

    def write_text(self, path: str) -> None:
        """The first component as a folder of text, a line an element; parts and lines follow the index."""
        self.df.repartitionByRange(IDX).sortWithinPartitions(IDX).select(F.col(self.cols[0]).cast("string")).write.text(path)

    def __str__(self) -> str:
        return printed(self.df.orderBy(IDX).select(self.cols[0]), ())


#: Elements that printing shows.
PRINTED = 100


def printed(ordered: DataFrame, shape: tuple[int, ...]) -> str:
    """``{ 1, 2 }`` of the first PRINTED values; with a shape, a line for each of its innermost rows."""
    some = [str(r[0]) for r in ordered.limit(PRINTED + 1).collect()]
    width = shape[-1] if len(shape) > 1 else PRINTED
    lines = [", ".join(some[:PRINTED][k : k + width]) for k in range(0, min(len(some), PRINTED), width)]
    return "{ " + ",\n  ".join(lines) + (", ..." if len(some) > PRINTED else "") + " }"


def zipped(*vecs: Vec, names: list[str] | None = None) -> Vec:
    """Elementwise tuples; as long as the shortest. Vectors of one base need no join."""
    if names is None:
        names = [c for v in vecs for c in v.cols]
        if len(set(names)) < len(names):
            names = [f"v{k}" for k in range(len(names))]
    fresh = iter(names)
    first = vecs[0]
    if all(v.base is first.base for v in vecs):
        exprs = {next(fresh): v.exprs[c] for v in vecs for c in v.cols}
        return Vec(first.base, names, first.base, exprs)
    joined = None
    for v in vecs:
        part = v.df.select(IDX, *[F.col(c).alias(next(fresh)) for c in v.cols])
        joined = part if joined is None else joined.join(part, IDX)
    return Vec(joined, names)


def with_halo(df: DataFrame, before: int, after: int, block: int = BLOCK_ROWS, n: int | None = None) -> DataFrame:
    """df with ``blk`` and ``own``: each row in its block, and again (own false) in blocks that see it from outside.

    A block sees ``before`` rows in front of it and ``after`` rows behind it,
    so windows over one block never need another; no window spans the table.
    With n the index wraps around at its ends: ghost rows then lie beyond them.
    """
    if block < max(before, after):
        raise ValueError("a halo wider than a block")
    i = F.col(IDX)
    home = div(i, block)
    place = lambda at, blk, own: F.struct(at.cast("bigint").alias("at"), blk.alias("blk"), F.lit(own).alias("own"))
    copies = [place(i, home, True)]
    if after:
        copies.append(F.when(i % block < after, place(i, home - 1, False)))
    if before:
        copies.append(F.when(i % block >= block - before, place(i, home + 1, False)))
    if n is not None:
        last = (n - 1) // block
        if before:
            copies.append(F.when(i >= n - before, place(i - n, F.lit(0).cast("bigint"), False)))
        if after:
            copies.append(F.when(i < after, place(i + n, F.lit(last).cast("bigint"), False)))
            # The last block may be shorter than the halo of the one before it.
            over = after - (n - last * block)
            if last and over > 0:
                copies.append(F.when(i < over, place(i + n, F.lit(last - 1).cast("bigint"), False)))
    spread = df.withColumn("__h", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull())))
    return spread.withColumns({IDX: F.col("__h.at"), "blk": F.col("__h.blk"), "own": F.col("__h.own")}).drop("__h")
