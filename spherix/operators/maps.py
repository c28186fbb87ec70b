"""Count and density maps, multi-order maps, indexes, coverages as ranges, cross matches: DataFrame programs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spherix import storage
from spherix.functions import cells, geometry

CHI2_3DOF = 16.266


def with_hash(df: DataFrame, depth: int, lon: str = "lon", lat: str = "lat", out: str = "ipix") -> DataFrame:
    return cells.apply(df, cells.cell_hash(depth, lon, lat, out))


def count_map(df: DataFrame, depth: int) -> DataFrame:
    """(ipix, value): rows per cell; positions without a cell are left out. Counts are partial before the shuffle."""
    return with_hash(df, depth).where("ipix IS NOT NULL").groupBy("ipix").agg(F.count("*").alias("value"))


def dense(skymap: DataFrame, depth: int) -> DataFrame:
    return skymap.sparkSession.range(cells.n_hash(depth)).select(F.col("id").alias("ipix")).join(skymap, "ipix", "left").select("ipix", F.coalesce("value", F.lit(0)).alias("value"))


def to_dense(skymap: DataFrame, depth: int, null_value) -> DataFrame:
    """dense with a value of its own for the cells that the map lacks."""
    every = skymap.sparkSession.range(cells.n_hash(depth)).select(F.col("id").alias("ipix"))
    kind = dict(skymap.dtypes)["value"]
    return every.join(skymap, "ipix", "left").select("ipix", F.coalesce("value", F.lit(null_value).cast(kind)).alias("value"))


def to_sparse(skymap: DataFrame, null_value) -> DataFrame:
    """The cells of a map whose value isn't null_value; a null_value of None or NaN stands for itself."""
    value = F.col("value")
    if null_value is None:
        return skymap.where(value.isNotNull())
    if isinstance(null_value, float) and math.isnan(null_value):
        return skymap.where(~F.isnan(value))
    return skymap.where(value != F.lit(null_value))


def representation_sizes(skymap: DataFrame, depth: int, value_bytes: int = 8) -> DataFrame:
    """One row (implicit_bytes, explicit_bytes, best): sizes of a map with a value for every cell, and with its cells beside their values."""
    key = 4 if depth <= 13 else 8
    implicit = F.lit(cells.n_hash(depth) * value_bytes).cast("long")
    explicit = F.count("*") * (key + value_bytes)
    sizes = skymap.agg(implicit.alias("implicit_bytes"), explicit.alias("explicit_bytes"))
    return sizes.withColumn("best", F.when(F.col("explicit_bytes") < F.col("implicit_bytes"), "explicit").otherwise("implicit"))


def colour_scale(skymap: DataFrame, most: int = 25) -> DataFrame:
    """One row (least, greatest, values): extremes but 0 and NaN, and the distinct values if there are at most `most`, else NULL."""
    v = F.col("value").cast("double")
    rows = skymap.where((v != 0) & ~F.isnan(v)).groupBy(v.alias("v")).count()
    ends = rows.agg(F.min("v").alias("least"), F.max("v").alias("greatest"), F.count("*").alias("n"))
    few = rows.select("v").orderBy("v").limit(most).agg(F.array_sort(F.collect_list("v")).alias("values"))
    return ends.crossJoin(few).select("least", "greatest", F.when(F.col("n") <= most, F.col("values")).alias("values"))


def density(skymap: DataFrame, depth: int) -> DataFrame:
    """Counts per steradian: count * n_hash / (4 pi)."""
    return skymap.select("ipix", (F.col("value") * F.lit(float(cells.n_hash(depth))) / (F.lit(4.0) * F.pi())).alias("value"))


def degrade(skymap: DataFrame, delta: int) -> DataFrame:
    return skymap.groupBy(F.shiftright("ipix", 2 * delta).alias("ipix")).agg(F.sum("value").alias("value"))


def add(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).groupBy("ipix").agg(F.sum("value").alias("value"))


def rollup(skymap: DataFrame, depth: int, least: int = 0) -> DataFrame:
    """(order_, ipix, value) at all depths from one shuffle of the finest map: each row goes to its ancestors."""
    up = F.explode(F.array(*[F.struct(F.lit(d).alias("order_"), F.shiftright("ipix", 2 * (depth - d)).alias("ipix")) for d in range(least, depth + 1)]))
    return skymap.select("value", up.alias("a")).groupBy("a.order_", "a.ipix").agg(F.sum("value").alias("value"))


def cumulative_index(skymap: DataFrame, depth: int) -> DataFrame:
    """(ipix, row_start, row_end) over occupied cells. Running sums are taken within ranges of cells and raised by the ranges before, so no task holds all."""
    return running(skymap.select("ipix", "value"), "ipix", "value").select("ipix", F.col("before").alias("row_start"), (F.col("before") + F.col("value")).alias("row_end"))


def index_get(index: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (ipix, at the index's depth) with row_start: the first row of the cell, or, where it has none, of the next that has; NULL behind the last."""
    starts = index.select("ipix", "row_start")
    both = asked.select("ipix").distinct().withColumn("asked", F.lit(True)).join(starts, "ipix", "full")
    w = Window.partitionBy("_b").orderBy("ipix").rowsBetween(0, Window.unboundedFollowing)
    # the next cell is looked for in the block, and beyond it among the blocks' first rows
    own = both.withColumn("_b", F.shiftright("ipix", 2 * 4)).withColumn("_r", F.first("row_start", ignorenulls=True).over(w))
    firsts = own.groupBy("_b").agg(F.min("row_start").alias("_f"))
    later = firsts.select("_b", F.first("_f", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)).alias("_l"))
    return own.where("asked").join(later, "_b").select("ipix", F.coalesce("_r", "_l").alias("row_start"))


def index_rows(index: DataFrame, index_depth: int, depth: int, lo: int, hi: int) -> DataFrame:
    """One row (row_start, row_end): the rows of the cells [lo, hi) of a depth, at most the index's; NULLs if there are none."""
    if depth > index_depth:
        raise ValueError(f"depth {depth} is below the index's, {index_depth}")
    by = 2 * (index_depth - depth)
    own = index.where((F.col("ipix") >= lo << by) & (F.col("ipix") < hi << by))
    return own.agg(F.min("row_start").alias("row_start"), F.max("row_end").alias("row_end"))


def index_cell_count(index: DataFrame, index_depth: int, depth: int, ipix: int) -> DataFrame:
    """One row (n): how many rows a cell has."""
    return index_rows(index, index_depth, depth, ipix, ipix + 1).select(F.coalesce(F.col("row_end") - F.col("row_start"), F.lit(0)).alias("n"))


def sort_by_cell(df: DataFrame, partitions: int | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows in the order of their depth-29 cells, range-partitioned; rows without a cell come first and stay."""
    out = with_hash(df, cells.MAX_DEPTH, lon, lat, "hash29")
    return (out.repartitionByRange(partitions, "hash29") if partitions else out.repartitionByRange("hash29")).sortWithinPartitions("hash29")


def store(df: DataFrame, path: str, partitions: int | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """sort_by_cell as a table at path, with small row groups and pages, whose ranges of hash29 a region filter prunes."""
    out = sort_by_cell(df, partitions, lon, lat)
    out.write.option("parquet.block.size", 16 << 20).option("parquet.page.row.count.limit", 4000).parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


# Multi-order maps


def _chi2(a: list[Column]) -> Column:
    total = reduce(lambda x, y: x + y, a).cast("double")
    inverse = reduce(lambda x, y: x + y, [F.lit(1.0) / x.cast("double") for x in a])
    return F.when(F.least(*a) <= 0, total).otherwise(total - 16.0 / inverse)


def chi2_count_merger(threshold: float = CHI2_3DOF):
    """Four counts become their sum if they agree with one mean; an empty one makes the mean 0, as 1/0 is infinite."""
    return lambda depth, v: F.when(_chi2(v) < threshold, reduce(lambda x, y: x + y, v))


def threshold_merger(most: float):
    return lambda depth, v: F.when(reduce(lambda x, y: x + y, v) < most, reduce(lambda x, y: x + y, v))


def chi2_density_merger(depth_floor: int = 0, threshold: float = CHI2_3DOF):
    """Four densities become their mean if they agree; a density counts as that of one row a cell at least, in its variance."""

    def merge(depth, v):
        one = cells.n_hash(depth) / 4 / math.pi
        total = reduce(lambda x, y: x + y, v)
        inverse = reduce(lambda x, y: x + y, [F.lit(1.0) / F.greatest(x, F.lit(one)) for x in v])
        return F.when((total - 16.0 / inverse) / F.lit(one) < threshold, total / 4) if depth > depth_floor else F.lit(None).cast("double")

    return merge


def equal_merger():
    return lambda depth, v: F.when((v[0] == v[1]) & (v[1] == v[2]) & (v[2] == v[3]), v[0])


def range_merger(tolerance: float):
    """Mean of four values that differ by at most tolerance of the mean."""

    def merge(depth, v):
        mean = reduce(lambda x, y: x + y, v) / 4
        return F.when(F.greatest(*v) - F.least(*v) <= tolerance * F.abs(mean), mean)

    return merge


def tolerance_merger(tolerance: float):
    """Mean of values whose least and greatest lie within tolerance of the mean, relative to it."""
    return range_merger(tolerance)


def sum_until_merger(most: float):
    """Sum of values, up to most itself; threshold_merger stays below it."""
    return lambda depth, v: F.when(reduce(lambda x, y: x + y, v) <= most, reduce(lambda x, y: x + y, v))


def empty_siblings_merger(most: float, empty: int):
    """sum_until_merger for groups with at most `empty` values of 0."""

    def merge(depth, v):
        total = reduce(lambda x, y: x + y, v)
        none = reduce(lambda x, y: x + y, [F.when(x == 0, 1).otherwise(0) for x in v])
        return F.when((total <= most) & (none <= empty), total)

    return merge


def build_tree(leaves: DataFrame, depth: int, merger, children: int = 4, least: int = 0) -> DataFrame:
    """(order_, ipix, value) of a tree whose nodes have `children` children: complete groups merge, bottom up, where the merger gives a value.

    leaves (ipix, value) are the nodes of depth; node k's children are children * k and on. merger takes the depth and the
    values of the children in their order.
    """
    alive, done = leaves.select("ipix", "value"), []
    write = storage.held if depth - least > 5 else (lambda df: df)
    for d in range(depth, least, -1):
        own = alive.withColumn("_p", F.expr(f"ipix div {children}"))
        values = [F.max(F.when(F.col("ipix") % children == k, F.col("value"))).alias(f"_v{k}") for k in range(children)]
        groups = own.groupBy("_p").agg(F.count("*").alias("_n"), *values)
        merged = write(groups.withColumn("_m", F.when(F.col("_n") == children, merger(d, [F.col(f"_v{k}") for k in range(children)]))))
        each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_v{k}").alias("v")) for k in range(children)])
        stay = merged.where("_m IS NULL").select("_p", F.explode(each).alias("c")).where("c.v IS NOT NULL")
        done.append(stay.select(F.lit(d).alias("order_"), (F.col("_p") * children + F.col("c.k")).alias("ipix"), F.col("c.v").alias("value")))
        alive = merged.where("_m IS NOT NULL").select(F.col("_p").alias("ipix"), F.col("_m").alias("value"))
    return reduce(DataFrame.unionByName, [*done, alive.select(F.lit(least).alias("order_"), "ipix", "value")])


def multi_order_map(skymap: DataFrame, depth: int, merger, least: int = 0) -> DataFrame:
    """(order_, ipix, value): complete groups of four siblings merge, bottom up, where the merger gives a value."""
    return merge_siblings(skymap.select(F.lit(depth).alias("order_"), "ipix", "value"), depth, merger, least)


def merge_siblings(mom: DataFrame, depth: int, merger, least: int = 0) -> DataFrame:
    """multi_order_map of a map whose cells, of depth at most, already have different orders.

    Beyond a few levels, what is left of each is written, so that no level is computed again for the next ones.
    """
    write = storage.held if depth - least > 5 else (lambda df: df)
    mixed = mom.select("order_", "ipix", "value")
    alive, done = mixed.where(F.col("order_") == depth), [mixed.where(F.col("order_") < least)]
    for d in range(depth, least, -1):
        own = alive.withColumn("_p", F.shiftright("ipix", 2))
        four = [F.max(F.when(F.col("ipix").bitwiseAND(F.lit(3)) == k, F.col("value"))) for k in range(4)]
        groups = own.groupBy("_p").agg(F.count("*").alias("_n"), *[c.alias(f"_v{k}") for k, c in enumerate(four)])
        merged = write(groups.withColumn("_m", F.when(F.col("_n") == 4, merger(d, [F.col(f"_v{k}") for k in range(4)]))))
        cells_ = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_v{k}").alias("v")) for k in range(4)])
        stay = merged.where("_m IS NULL").select("_p", F.explode(cells_).alias("c")).where("c.v IS NOT NULL")
        done.append(stay.select(F.lit(d).alias("order_"), (F.shiftleft("_p", 2) + F.col("c.k")).alias("ipix"), F.col("c.v").alias("value")))
        alive = merged.where("_m IS NOT NULL").select(F.lit(d - 1).alias("order_"), F.col("_p").alias("ipix"), F.col("_m").alias("value")).unionByName(mixed.where(F.col("order_") == d - 1))
    return reduce(DataFrame.unionByName, [*done, alive])


def lookup(df: DataFrame, mom: DataFrame, depth: int, ipix: str = "ipix") -> DataFrame:
    """df with the order_ and value of the map cell that holds ipix (at depth): an equi join on the codes of its ancestors."""
    codes = F.explode(F.array(*[F.expr(cells.zuniq(str(d), f"{ipix} >> {2 * (depth - d)}")) for d in range(depth + 1)]))
    coded = mom.select(F.expr(f"CASE {' '.join(f'WHEN order_ = {d} THEN {cells.zuniq(str(d), 'ipix')}' for d in range(depth + 1))} END").alias("_z"), F.col("order_"), F.col("value"))
    return df.withColumn("_z", codes).join(coded, "_z").drop("_z")


def multiply(left: DataFrame, right: DataFrame, depth: int, factor: float = 1.0) -> DataFrame:
    """Product of two multi-order maps on their common refinement, down to depth: each cell meets its equals and its ancestors."""
    code = lambda o: F.expr(f"CASE {' '.join(f'WHEN order_ = {d} THEN {cells.zuniq(str(d), 'ipix')}' for d in range(depth + 1))} END").alias(o)

    def up(df):
        own = F.array(*[F.when(F.col("order_") >= d, F.expr(cells.zuniq(str(d), f"ipix >> (2 * (order_ - {d}))"))) for d in range(depth + 1)])
        return df.select("order_", "ipix", "value", F.explode(F.array_compact(own)).alias("_z"))

    a = up(left).join(right.select(code("_z"), F.col("order_").alias("_o"), F.col("value").alias("_v")), "_z")
    b = up(right).join(left.select(code("_z"), F.col("order_").alias("_o"), F.col("value").alias("_v")), "_z").where("order_ > _o")
    return a.unionByName(b).select("order_", "ipix", (F.col("value") * F.col("_v") * F.lit(factor)).alias("value"))


def densities(mom: DataFrame) -> DataFrame:
    """Counts of a multi-order map per steradian."""
    return mom.select("order_", "ipix", (F.col("value") * F.expr("CAST(12L << CAST(2 * order_ AS INT) AS DOUBLE)") / (F.lit(4.0) * F.pi())).alias("value"))


def _coded(df: DataFrame, depth: int) -> DataFrame:
    """df with _z, the code of each cell."""
    return df.withColumn("_z", F.expr(f"CASE {' '.join(f'WHEN order_ = {d} THEN {cells.zuniq(str(d), 'ipix')}' for d in range(depth + 1))} END"))


def _above(df: DataFrame, depth: int, itself: bool = True) -> DataFrame:
    """df once for each ancestor of a cell (and itself), with its code _z and order _d."""
    up = [F.when((F.col("order_") >= d) if itself else (F.col("order_") > d), F.struct(F.lit(d).alias("d"), F.expr(cells.zuniq(str(d), f"ipix >> (2 * (order_ - {d}))")).alias("z"))) for d in range(depth + 1)]
    return df.withColumn("_a", F.explode(F.array_compact(F.array(*up)))).withColumns({"_d": F.col("_a.d"), "_z": F.col("_a.z")}).drop("_a")


def overlapping(df: DataFrame, mom: DataFrame, depth: int) -> DataFrame:
    """(order_, ipix, m_order, m_ipix, value): cells of df with the map's cells that hold or divide them, by equi joins on codes."""
    entry = mom.select(F.col("order_"), "ipix", "value")
    named = lambda m: m.select(F.col("order_").alias("m_order"), F.col("ipix").alias("m_ipix"), "value", "_z")
    own = df.select("order_", "ipix")
    holds = _above(own, depth).join(named(_coded(entry, depth)), "_z")
    divides = _coded(own, depth).join(named(_above(entry, depth, itself=False)), "_z")
    out = ["order_", "ipix", "m_order", "m_ipix", "value"]
    return holds.select(*out).unionByName(divides.select(*out))


def refine(left: DataFrame, right: DataFrame, depth: int, how: str = "full") -> DataFrame:
    """(order_, ipix, l, l_order, r, r_order): two multi-order maps on their common refinement, values uncut.

    how is inner, left, right or full. What a side has alone is NULL on the other; a cell that the other map
    divides leaves the cells beside the paths to its pieces. A caller cuts values by the difference of orders
    and combines them by a Column; merge_siblings may follow. All joins are on codes of ancestors. Each map is
    read several times, so it should be a table (sources.tables.held), not a long program.
    """
    a, b = (df.select("order_", "ipix", "value") for df in (left, right))
    parts = [_meet(a, b, depth, "l", "r", True), _meet(b, a, depth, "r", "l", False)]
    if how in ("left", "full"):
        parts.append(_alone(a, b, depth, "l", "r"))
    if how in ("right", "full"):
        parts.append(_alone(b, a, depth, "r", "l"))
    return reduce(DataFrame.unionByName, parts)


def _meet(fine: DataFrame, coarse: DataFrame, depth: int, f: str, c: str, equal: bool) -> DataFrame:
    held = _above(fine, depth, itself=equal).join(_coded(coarse, depth).select("_z", F.col("value").alias(c), F.col("order_").alias(f"{c}_order")), "_z")
    return held.select("order_", "ipix", F.col("value").alias(f), F.col("order_").alias(f"{f}_order"), c, f"{c}_order")


def _alone(own: DataFrame, other: DataFrame, depth: int, mine: str, theirs: str) -> DataFrame:
    kind = dict(other.dtypes)["value"]
    out = [F.col("value").alias(mine), F.col("_o").alias(f"{mine}_order"), F.lit(None).cast(kind).alias(theirs), F.lit(None).cast("int").alias(f"{theirs}_order")]
    below = _above(other, depth, itself=False).select(F.col("order_").alias("_fo"), F.col("ipix").alias("_fi"), "_z")
    equal = _coded(other, depth).select("_z")
    held = _above(own, depth).join(equal, "_z", "left_semi").select("order_", "ipix").distinct()
    free = _coded(own, depth).join(below.select("_z").distinct(), "_z", "left_anti").join(held, ["order_", "ipix"], "left_anti").withColumn("_o", F.col("order_"))
    divided = _coded(own, depth).withColumnRenamed("order_", "_o").join(below, "_z")
    steps = divided.select("_o", "value", "_fo", "_fi", F.explode(F.expr("sequence(_o + 1, _fo)")).alias("order_")).withColumn("_at", F.expr("_fi >> CAST(2 * (_fo - order_) AS INT)"))
    beside = steps.select("_o", "value", "order_", F.explode(F.array(*[F.expr(f"((_at >> 2) << 2) | {k}L") for k in range(4)])).alias("ipix")).distinct()
    path = steps.select("order_", F.col("_at").alias("ipix")).distinct()
    rest = beside.join(path, ["order_", "ipix"], "left_anti")
    return free.select("order_", "ipix", *out).unionByName(rest.select("order_", "ipix", *out))


def sampled_index(df: DataFrame, every: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(sample_no, hash29): the key of each every-th row in the order of cells.

    Rows are counted by cell, not sorted: a key that many rows share is one row with their number, and samples come from
    the running sum, which is taken within ranges of keys and raised by the ranges before.
    """
    keys = with_hash(df, cells.MAX_DEPTH, lon, lat, "hash29").where("hash29 IS NOT NULL").groupBy("hash29").agg(F.count("*").alias("n"))
    return sampled(keys, every)


def running(keys: DataFrame, key: str, n: str) -> DataFrame:
    """keys with before, the sum of n over all smaller keys; keys are distinct.

    Partitions are ranges of keys. To the one task that adds up the ranges comes a row a partition, and those sums,
    as many as partitions, go to all executors.
    """
    ranged = keys.repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    # written, as the numbers of partitions have to be the same for both uses
    own = storage.held(ranged.withColumn("_run", F.sum(n).over(Window.partitionBy("_p").orderBy(key))))
    sums = own.groupBy("_p").agg(F.max("_run").alias("_n"))
    sums = sums.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))
    return own.join(F.broadcast(sums), "_p").withColumn("before", F.col("_base") + F.col("_run") - F.col(n)).drop("_p", "_run", "_base")


def sampled(keys: DataFrame, every: int) -> DataFrame:
    """sampled_index of keys (hash29, n)."""
    first, last = F.expr(f"(before + {every - 1}) div {every}"), F.expr(f"(before + n - 1) div {every}")
    numbered = running(keys, "hash29", "n").where(first <= last)
    return numbered.select(F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("sample_no"), "hash29")


def sample_rows(index: DataFrame, every: int, lo: int, hi: int, total: int | None = None) -> DataFrame:
    """(row_start, row_end): the rows, in the order of cells, that can have keys in [lo, hi), by a sampled index.

    From the last sample below lo to the first at or above hi; without one, to total (NULL if unknown).
    """
    start = F.coalesce(F.max(F.when(F.col("hash29") < lo, F.col("sample_no"))), F.lit(0)) * every
    end = F.coalesce(F.min(F.when(F.col("hash29") >= hi, F.col("sample_no"))) * every, F.lit(total).cast("long"))
    return index.agg(start.cast("long").alias("row_start"), end.cast("long").alias("row_end"))


def order_breaks(df: DataFrame, key: str, places: list[str] | None = None) -> DataFrame:
    """One row (breaks): how often key falls from a row to the next; 0 if df is sorted. NULL comes before all keys.

    The order is that of partitions or, with places, of these columns, which tell the stretch that a row stands in: the
    first is a string. A partition may hold stretches in any order, as those of files, but each of them in one piece.
    Rows stay where they are: each partition tells its stretches' falls, first and last keys.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def ends(batches):
        import numpy as np
        from pyspark import TaskContext

        at, n, first, last = None, 0, None, None

        def told():
            return pa.RecordBatch.from_pydict({"file": [at[0]], "at": [at[1]], "p": [TaskContext.get().partitionId()], "n": [n], "first": [first], "last": [last]}, schema)

        for b in batches:
            if not b.num_rows:
                continue
            file, start = b.column(0), b.column(1)
            k = b.column(2).fill_null(-(2**63)).to_numpy()
            new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1]))
            cuts = [0, *(np.nonzero(new.to_numpy(zero_copy_only=False))[0] + 1).tolist(), len(k)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                own, here = k[lo:hi], (file[lo].as_py(), start[lo].as_py())
                if here != at:
                    if at is not None:
                        yield told()
                    at, n, first, last = here, 0, int(own[0]), int(own[0])
                n += int((own[1:] < own[:-1]).sum()) + (last > int(own[0]))
                last = int(own[-1])
        if at is not None:
            yield told()

    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("p", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
    where = [F.col(c) for c in places] if places else [F.lit(""), F.lit(0)]
    own = df.select(where[0].cast("string").alias("file"), where[1].cast("long").alias("at"), F.col(key).cast("long").alias("k"))
    own = own.mapInArrow(ends, "file string, at long, p long, n long, first long, last long")
    # of part files, the number tells the order, which may have more digits than the name was made for
    part = F.expr(r"try_cast(regexp_extract(file, '/part-(\\d+)[^/]*$', 1) AS BIGINT)")
    order = [F.regexp_extract("file", "^(.*/)?", 0), part, "file", "at", "p"]
    return own.withColumn("b", F.lag("last").over(Window.orderBy(*order))).agg((F.coalesce(F.sum("n"), F.lit(0)) + F.count_if(F.col("b") > F.col("first"))).alias("breaks"))


def checked_order(df: DataFrame, key: str, places: list[str] | None = None) -> DataFrame:
    """df itself if it is sorted by key, in the order of order_breaks; an error if not."""
    if n := order_breaks(df, key, places).first()["breaks"]:
        raise ValueError(f"rows aren't sorted by {key}: it falls {n} times")
    return df


# Coverages: (lo, hi, is_full) at depth 29, half open


def to_ranges(cover: DataFrame) -> DataFrame:
    shift = f"(2 * ({cells.MAX_DEPTH} - order_))"
    return cover.selectExpr(f"ipix << {shift} AS lo", f"(ipix + 1) << {shift} AS hi", "is_full")


def union_ranges(ranges: DataFrame, flags: bool = True) -> DataFrame:
    """Ranges that touch or overlap in one, over the borders of base cells too.

    With flags, ranges of one flag are joined, and where full and partial ones overlap the place is full. Runs are swept
    within blocks of the sky; those that go on in the next block are joined in a second sweep, over one row a run at most.
    """
    if flags:
        ranges = combine(ranges, None, "or") if "is_full" in ranges.columns else ranges
        return ranges.select("lo", "hi", "is_full")
    return _joined(ranges.select("lo", "hi").withColumn("is_full", F.lit(True)))


def _joined(ranges: DataFrame) -> DataFrame:
    """Gaps and islands of ranges by flag; ranges of different flags don't overlap. _b is the block that a range begins in."""
    blocks = ranges if "_b" in ranges.columns else ranges.withColumn("_b", F.shiftright("lo", BLOCK_BITS))
    runs = _islands(blocks, ["_b", "is_full"]).select("lo", "hi", "is_full")
    # what ends inside its block and begins inside it can't go on; the rest is few: at most two runs a block and flag
    edge = (F.col("lo").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) == 0) | (F.shiftright("lo", BLOCK_BITS) != F.shiftright(F.col("hi") - 1, BLOCK_BITS)) | (F.col("hi").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) == 0)
    over = _islands(runs.where(edge), ["is_full"]).select("lo", "hi", "is_full")
    return runs.where(~edge).unionByName(over)


def _islands(ranges: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    own = ranges.withColumn("_new", F.when(F.col("lo") <= F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    return own.withColumn("_g", F.sum("_new").over(w)).groupBy(*by, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


#: Bits of a depth-29 number within a block of the sky that a task sweeps alone: cells of depth 3, so 768 tasks at most.
BLOCK_BITS = 52

#: Flag of the result by the state of either side (0 absent, 1 partial, 2 full): None where nothing is left.
RULES = {
    "and": {(2, 2): True, (1, 1): False, (1, 2): False, (2, 1): False},
    "or": {(2, 2): True, (1, 1): False, (1, 2): True, (2, 1): True, (2, 0): True, (1, 0): False, (0, 2): True, (0, 1): False},
    "xor": {(1, 1): False, (1, 2): False, (2, 1): False, (2, 0): True, (1, 0): False, (0, 2): True, (0, 1): False},
    "minus": {(1, 1): False, (1, 2): False, (2, 1): False, (2, 0): True, (1, 0): False},
    "not": {(0, 0): True, (1, 0): False},
}


def combine(left: DataFrame, right: DataFrame | None, op: str) -> DataFrame:
    """Set operation of two coverages as ranges, by RULES: a sweep over the borders of both.

    Ranges are first cut at the borders of blocks, so that each block is swept alone, from a state of nothing. Ranges of
    one side may overlap; full goes before partial.
    """
    block = 1 << BLOCK_BITS

    def edges(df: DataFrame, side: int) -> DataFrame:
        cut = df.select("lo", "hi", "is_full", F.explode(F.sequence(F.shiftright("lo", BLOCK_BITS), F.shiftright(F.col("hi") - 1, BLOCK_BITS))).alias("b"))
        cut = cut.select("b", F.greatest("lo", F.col("b") * block).alias("lo"), F.least("hi", (F.col("b") + 1) * block).alias("hi"), "is_full")
        kind = F.col("is_full").cast("int")
        ends = F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("v")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("v")))
        each = cut.select("b", kind.alias("full"), F.explode(ends).alias("e")).select("b", "e.at", "e.v", "full")
        return each.select("b", "at", *[(F.col("v") * F.lit(int(side == s)) * (F.col("full") if f else 1 - F.col("full"))).alias(f"{'lr'[s]}{f}") for s in (0, 1) for f in (0, 1)])

    rows = edges(left, 0)
    if right is not None:
        rows = rows.unionByName(edges(right, 1))
    if op == "not":
        empty = [F.lit(0).alias(c) for c in ("l0", "l1", "r0", "r1")]
        ends = left.sparkSession.range(12 << (58 - BLOCK_BITS)).select(F.col("id").alias("b"), F.explode(F.array(F.col("id") * block, (F.col("id") + 1) * block)).alias("at"), *empty)
        rows = rows.unionByName(ends)
    # one shuffle, by block: sums, sweep and runs all need no finer one
    at = rows.repartition("b").groupBy("b", "at").agg(*[F.sum(c).alias(c) for c in ("l0", "l1", "r0", "r1")])
    w = Window.partitionBy("b").orderBy("at")
    swept = at.select("b", F.col("at").alias("lo"), F.lead("at").over(w).alias("hi"), *[F.sum(c).over(w).alias(c) for c in ("l0", "l1", "r0", "r1")])
    state = lambda s: F.when(F.col(f"{s}1") > 0, 2).when(F.col(f"{s}0") > 0, 1).otherwise(0)
    swept = swept.select("b", "lo", "hi", state("l").alias("l"), state("r").alias("r"))
    flag = F.lit(None).cast("boolean")
    for (a, b), full in RULES[op].items():
        flag = F.when((F.col("l") == a) & (F.col("r") == b), F.lit(full)).otherwise(flag)
    return _joined(swept.withColumn("is_full", flag).where("hi IS NOT NULL AND is_full IS NOT NULL").select("lo", "hi", "is_full", F.col("b").alias("_b")))


def equal_covers(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (equal): whether two coverages (order_, ipix, is_full) are the same part of the sky with the same flags."""
    a, b = (union_ranges(to_ranges(c)) for c in (left, right))
    only = a.exceptAll(b).unionByName(b.exceptAll(a))
    return only.agg((F.count("*") == 0).alias("equal"))


def to_cells(ranges: DataFrame) -> DataFrame:
    """(order_, ipix, is_full): the fewest cells that make up each range: at a depth, those inside whose parent isn't."""
    inside = lambda d: (f"shiftright(lo + {(1 << 2 * (29 - d)) - 1}L, {2 * (29 - d)})", f"shiftright(hi, {2 * (29 - d)})")
    runs = []
    for d in range(cells.MAX_DEPTH + 1):
        a, b = inside(d)
        pa, pb = inside(d - 1) if d else ("0L", "0L")
        # up to the first whole parent, and from the last one; all if there is none
        runs += [f"named_struct('d', {d}, 'a', {a}, 'b', CASE WHEN {pa} < {pb} THEN 4 * {pa} ELSE {b} END)", f"named_struct('d', {d}, 'a', CASE WHEN {pa} < {pb} THEN 4 * {pb} ELSE {b} END, 'b', {b})"]
    found = ranges.select("is_full", F.explode(F.expr(f"filter(array({', '.join(runs)}), r -> r.a < r.b)")).alias("r"))
    return found.select(F.col("r.d").alias("order_"), F.explode(F.expr("sequence(r.a, r.b - 1)")).alias("ipix"), "is_full")


def degrade_cover(cover: DataFrame, depth: int) -> DataFrame:
    """A coverage at most depth deep: deeper cells become partial ones at depth."""
    deep = cover.where(F.col("order_") > depth).select(F.lit(depth).alias("order_"), F.expr(f"ipix >> (2 * (order_ - {depth}))").alias("ipix"), F.lit(False).alias("is_full")).distinct()
    return cover.where(F.col("order_") <= depth).select("order_", "ipix", "is_full").unionByName(deep)


def deep_size(cover: DataFrame, depth: int) -> DataFrame:
    """(size, deep_size): cells of a coverage, and those of depth that they hold."""
    return cover.agg(F.count("*").alias("size"), F.coalesce(F.sum(F.expr(f"1L << CAST(2 * ({depth} - order_) AS INT)")), F.lit(0)).alias("deep_size"))


def flatten(ranges: DataFrame, depth: int) -> DataFrame:
    by = 2 * (cells.MAX_DEPTH - depth)
    return ranges.select(F.explode(F.sequence(F.shiftright("lo", by), F.shiftright(F.col("hi") - 1, by))).alias("ipix"), "is_full").distinct()


def pack(cover: DataFrame, depth: int) -> DataFrame:
    """(order_, ipix) from cells at one depth, four full siblings becoming their parent."""
    one = cover.select("ipix").distinct().withColumn("value", F.lit(1))
    return multi_order_map(one, depth, equal_merger()).select("order_", "ipix")


def minus_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells (ipix) of one depth that are in left alone."""
    return left.select("ipix").distinct().join(right.select("ipix"), "ipix", "left_anti")


def merge_cells(cover: DataFrame, depth: int) -> DataFrame:
    """pack under the name of its other use: four cells in a row become the one above, again and again."""
    return pack(cover, depth)


def moc_of(cells_: DataFrame, depth: int, full: bool = True) -> DataFrame:
    """(order_, ipix, is_full) from cells (ipix) of one depth with repeats, packed if they are full."""
    if not full:
        return cells_.select(F.lit(depth).alias("order_"), "ipix", F.lit(False).alias("is_full")).distinct()
    return pack(cells_, depth).select("order_", "ipix", F.lit(True).alias("is_full"))


def expand(cover: DataFrame, depth: int) -> DataFrame:
    """Cells at one depth with all their neighbours."""
    near = cells.apply(cover.select("ipix"), cells.neighbours(depth))
    return near.select(F.explode(F.array_compact(F.array("ipix", *[f"n_{d.lower()}" for d in cells.DIRECTIONS]))).alias("ipix")).distinct()


def external_border(cover: DataFrame, depth: int) -> DataFrame:
    return expand(cover, depth).join(cover.select("ipix"), "ipix", "left_anti")


# Predicates and joins


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Angular distance in degrees."""
    return f"degrees(2.0 * asin(least(1.0, sqrt(pow(sin(radians(({lat2}) - ({lat1})) / 2.0), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2.0), 2)))))"


def in_zone(lon_min: float, lat_min: float, lon_max: float, lat_max: float) -> str:
    """Lower borders belong to a zone and upper ones don't, but for the north pole; it crosses the meridian if lon_min > lon_max."""
    lon = f"(lon >= {lon_min!r} AND lon < {lon_max!r})" if lon_min <= lon_max else f"(lon >= {lon_min!r} OR lon < {lon_max!r})"
    top = "<=" if lat_max >= 90 else "<"
    return f"(lat >= {lat_min!r} AND lat {top} {lat_max!r} AND {lon})"


def in_ellipse(lon: float, lat: float, a: float, b: float, pa: float) -> str:
    """Elliptical cone: half axes and position angle (east of north) in degrees, in the orthographic plane of its centre."""
    dl = f"radians(lon - {lon!r})"
    x = f"(cos(radians(lat)) * sin({dl}))"
    y = f"(sin(radians(lat)) * cos(radians({lat!r})) - cos(radians(lat)) * sin(radians({lat!r})) * cos({dl}))"
    front = f"(sin(radians(lat)) * sin(radians({lat!r})) + cos(radians(lat)) * cos(radians({lat!r})) * cos({dl})) > 0"
    u, v = (f"({x} * sin(radians({pa!r})) + {y} * cos(radians({pa!r})))", f"({x} * cos(radians({pa!r})) - {y} * sin(radians({pa!r})))")
    return f"({front} AND pow({u} / sin(radians({a!r})), 2) + pow({v} / sin(radians({b!r})), 2) <= 1.0)"


def _turn(degrees: float) -> float:
    """An angle in [-180, 180)."""
    return (degrees + 180.0) % 360.0 - 180.0


def _edges(vertices: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(west end, latitude, latitude of the east end, width, sign) of each edge that isn't on a meridian; edges are the shorter arcs."""
    out = []
    for (lon1, lat1), (lon2, lat2) in zip(vertices, vertices[1:] + vertices[:1]):
        width = _turn(lon2 - lon1)
        if abs(math.sin(math.radians(width))) > 1e-14:
            out.append((lon1 % 360.0, lat1, lat2, width, 1.0) if width > 0 else (lon2 % 360.0, lat2, lat1, -width, -1.0))
    return out


def odd_south(vertices: list[tuple[float, float]], lon: float, lat: float) -> bool:
    """Whether the way from a position to the south pole crosses an odd number of edges."""
    odd = False
    for west, a, b, width, _ in _edges(vertices):
        from_west = (lon - west) % 360.0
        if from_west < width:
            t = (math.tan(math.radians(a)) * math.sin(math.radians(width - from_west)) + math.tan(math.radians(b)) * math.sin(math.radians(from_west))) / math.sin(math.radians(width))
            odd ^= lat > math.degrees(math.atan(t))
    return odd


def holds_south_pole(vertices: list[tuple[float, float]], inside="default") -> bool:
    """Whether the south pole is inside a polygon, by the choice of its inside.

    default: a polygon that goes around the poles holds the one on the side of its vertices' mean, any other none;
    complement: the other side of that; south_pole, no_south_pole; ("in" or "out", lon, lat): a position that is in or out.
    """
    if inside in ("south_pole", "no_south_pole"):
        return inside == "south_pole"
    around = abs(sum(_turn(b[0] - a[0]) for a, b in zip(vertices, vertices[1:] + vertices[:1]))) > 180.0
    default = around and sum(math.sin(math.radians(lat)) for _, lat in vertices) < 0
    if inside in ("default", "complement"):
        return default != (inside == "complement")
    kind, lon, lat = inside
    if kind not in ("in", "out"):
        raise ValueError(f"no such choice of the inside: {inside}")
    return odd_south(vertices, lon, lat) == (kind == "out")


def crosses_parallel(vertices: list[tuple[float, float]], lat: float, lon_min: float = 0.0, lon_max: float = 360.0) -> list[float]:
    """Longitudes in [lon_min, lon_max] at which the edges of a polygon cross a parallel, ascending."""
    out = []
    z = math.sin(math.radians(lat))
    for a, b in zip(vertices, vertices[1:] + vertices[:1]):
        n = _cross(_xyz(*a), _xyz(*b))
        size, flat = math.hypot(*n), math.hypot(n[0], n[1])
        if size < 1e-300 or flat < 1e-15 * size:
            continue
        # points of the great circle at height z: n . p = 0
        c = -n[2] * z / (flat * math.cos(math.radians(lat))) if abs(lat) < 90 else 2.0
        if abs(c) > 1:
            continue
        middle = math.atan2(n[1], n[0])
        for lon in {middle + math.acos(c), middle - math.acos(c)}:
            p = (math.cos(math.radians(lat)) * math.cos(lon), math.cos(math.radians(lat)) * math.sin(lon), z)
            if _between(p, _xyz(*a), _xyz(*b), n):
                out.append(math.degrees(lon) % 360.0)
    return sorted(x for x in out if (x - lon_min) % 360.0 <= (lon_max - lon_min if lon_max - lon_min >= 360 else (lon_max - lon_min) % 360.0))


def crosses_arc(vertices: list[tuple[float, float]], start: tuple[float, float], end: tuple[float, float], whole: bool = False) -> list[tuple[float, float]]:
    """Where the edges of a polygon cross the great-circle arc between two positions, or with whole its whole great circle, in the order of edges."""
    a, b = _xyz(*start), _xyz(*end)
    n, out = _cross(a, b), []
    for v, w in zip(vertices, vertices[1:] + vertices[:1]):
        p, q = _xyz(*v), _xyz(*w)
        m = _cross(p, q)
        line = _cross(m, n)
        size = math.hypot(*line)
        if size < 1e-15:
            continue
        for sign in (1.0, -1.0):
            x = tuple(sign * c / size for c in line)
            if _between(x, p, q, m) and (whole or _between(x, a, b, n)):
                out.append((math.degrees(math.atan2(x[1], x[0])) % 360.0, math.degrees(math.asin(max(-1.0, min(1.0, x[2]))))))
    return out


def _xyz(lon: float, lat: float) -> tuple[float, float, float]:
    lon, lat = math.radians(lon), math.radians(lat)
    return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)


def _cross(a, b) -> tuple[float, float, float]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _between(p, a, b, n) -> bool:
    """Whether p, on the great circle of normal n, is on the shorter arc from a to b."""
    dot = lambda x, y: sum(i * j for i, j in zip(x, y))
    return dot(_cross(n, a), p) >= -1e-15 and dot(_cross(b, n), p) >= -1e-15


def lon_between(lon_min: float, lon_max: float, lon: str = "lon") -> str:
    """A longitude in [lon_min, lon_max[, over the meridian if lon_min > lon_max."""
    return f"({lon} >= {lon_min!r} AND {lon} < {lon_max!r})" if lon_min <= lon_max else f"({lon} >= {lon_min!r} OR {lon} < {lon_max!r})"


def crossed_vertically(lon_min: float, lat_min: float, lon_max: float, lat_max: float, lon: str = "lon", down: str = "lat_down", up: str = "lat_up") -> str:
    """Whether a stretch of a meridian crosses a zone from below it to above it."""
    return f"({down} < {lat_min!r} AND {lat_max!r} <= {up} AND {lon_between(lon_min, lon_max, lon)})"


def crossed_horizontally(lon_min: float, lat_min: float, lon_max: float, lat_max: float, left: str = "lon_left", right: str = "lon_right", lat: str = "lat") -> str:
    """Whether a stretch of a parallel, over the meridian if left > right, crosses a zone from west of it to east of it."""
    both = f"{left} < {lon_min!r} AND {lon_max!r} <= {right}"
    if lon_min > lon_max:
        wide = f"({right} < {left} AND {both})"
    else:
        wide = f"(CASE WHEN {right} < {left} THEN {left} < {lon_min!r} OR {lon_max!r} <= {right} ELSE {both} END)"
    return f"({lat} >= {lat_min!r} AND {lat} < {lat_max!r} AND {wide})"


def in_zone_exclusive(lon_min: float, lat_min: float, lon_max: float, lat_max: float) -> str:
    """in_zone without any border."""
    inside = f"(lon > {lon_min!r} AND lon < {lon_max!r})" if lon_min <= lon_max else f"(lon > {lon_min!r} OR lon < {lon_max!r})"
    return f"({inside} AND lat > {lat_min!r} AND lat < {lat_max!r})"


def ellipse_overlaps_cone(lon: float, lat: float, a: float, b: float, pa: float, radius: str) -> str:
    """Whether cones of a radius (degrees) around (lon, lat) of the rows may overlap an elliptical cone: the axes grow by the radius."""
    grown = in_ellipse(lon, lat, a, b, pa)
    for axis in (a, b):
        grown = grown.replace(f"sin(radians({axis!r}))", f"sin(radians(least(90.0, {axis!r} + {radius})))")
    return grown


def enclosing_cone(positions: list[tuple[float, float]]) -> tuple[float, float, float]:
    """(lon, lat, radius) of the smallest cone around some positions, by two, three or all borders."""
    from itertools import combinations

    points = [_xyz(*p) for p in positions]

    def cone(own):
        if len(own) == 1:
            return own[0], 0.0
        if len(own) == 2:
            axis = tuple(x + y for x, y in zip(*own))
        else:
            p, q, r = own
            axis = _cross(tuple(y - x for x, y in zip(p, q)), tuple(y - x for x, y in zip(p, r)))
            if sum(i * j for i, j in zip(axis, p)) < 0:
                axis = tuple(-x for x in axis)
        size = math.hypot(*axis)
        if size < 1e-15:
            return None, math.pi
        axis = tuple(x / size for x in axis)
        return axis, _angle(axis, own[0])

    best = None
    for n in (1, 2, 3):
        for own in combinations(points, n):
            axis, r = cone(own)
            if axis is not None and (best is None or r < best[1]) and all(_angle(axis, p) <= r + 1e-12 for p in points):
                best = (axis, r)
    (x, y, z), r = best
    return math.degrees(math.atan2(y, x)) % 360.0, math.degrees(math.asin(max(-1.0, min(1.0, z)))), math.degrees(r)


def bounding_cone(positions: list[tuple[float, float]]) -> tuple[float, float, float]:
    """(lon, lat, radius) of a cone around the mean of some positions that holds them."""
    points = [_xyz(*p) for p in positions]
    axis = tuple(map(sum, zip(*points)))
    size = math.hypot(*axis)
    axis = tuple(x / size for x in axis)
    return math.degrees(math.atan2(axis[1], axis[0])) % 360.0, math.degrees(math.asin(axis[2])), math.degrees(max(_angle(axis, p) for p in points))


def _angle(a, b) -> float:
    return 2 * math.asin(min(1.0, math.dist(a, b) / 2))


def in_polygon(vertices: list[tuple[float, float]], inside="default") -> str:
    """Inside a polygon, that may cross itself, the meridian or a pole: the south pole's state, changed by each edge on the way there."""
    crossings = ["0"]
    for west, a, b, width, _ in _edges(vertices):
        d = f"(lon - {west!r} - 360.0 * floor((lon - {west!r}) / 360.0))"
        arc = f"degrees(atan((tan(radians({a!r})) * sin(radians({width!r} - {d})) + tan(radians({b!r})) * sin(radians({d}))) / sin(radians({width!r}))))"
        crossings.append(f"(CASE WHEN {d} < {width!r} AND lat > {arc} THEN 1 ELSE 0 END)")
    return f"(({' + '.join(crossings)}) % 2 = {0 if holds_south_pole(vertices, inside) else 1})"


def within(df: DataFrame, ranges: list[tuple[int, int]], exact: str, hash29: str = "hash29") -> DataFrame:
    """Rows in a region: key ranges that reach the Parquet scan, then the exact test. Beyond 200 ranges neighbours are joined over the least gaps."""
    merged = sorted(ranges)
    if len(merged) > 200:
        gaps = sorted(sorted(range(len(merged) - 1), key=lambda k: merged[k + 1][0] - merged[k][1], reverse=True)[:199])
        cuts = [0, *[g + 1 for g in gaps], len(merged)]
        merged = [(merged[a][0], merged[b - 1][1]) for a, b in zip(cuts, cuts[1:])]
    near = reduce(lambda x, y: x | y, [F.col(hash29).between(lo, hi - 1) for lo, hi in merged]) if merged else F.lit(False)
    return df.where(near).where(F.expr(cells.doubles(exact)))


def test_positions(df: DataFrame, cover: DataFrame, depth: int) -> DataFrame:
    """df with status IN, OUT or UNKNOWN against a coverage (order_, ipix, is_full).

    A position lies in one cell of a coverage at most, so a left join of its cell with each order that the coverage has
    keeps df's rows as they are; orders are a few numbers, read first.
    """
    orders = sorted(r[0] for r in cover.select("order_").distinct().collect())
    out = with_hash(df, depth, out="cell_")
    for d in orders:
        own = cover.where(F.col("order_") == d).select(F.col("ipix").alias("_c"), F.col("is_full").alias(f"_f{d}"))
        out = out.join(own, F.shiftright("cell_", 2 * (depth - d)) == F.col("_c"), "left").drop("_c")
    full = F.coalesce(*[F.col(f"_f{d}") for d in orders]) if orders else F.lit(None).cast("boolean")
    status = F.when(full, "IN").when(full.isNotNull(), "UNKNOWN").otherwise("OUT")
    return out.withColumn("status", status).drop("cell_", *[f"_f{d}" for d in orders])


#: Levels below the cells of the radius at which a cross match compares rows, rows of a side in one block of a cell, and pairs a task, about.
MATCH_LEVELS, MATCH_SIDE, MATCH_PAIRS = 3, 2048, 1 << 23


def cross_match(left: DataFrame, right: DataFrame, radius: float, depth: int | None = None) -> DataFrame:
    """Pairs (left_id, right_id, distance) within radius degrees: right rows go to all small cells that they reach, then an equi join.

    Those cells are found from a row's cell of a depth and its neighbours, level by level, by circles around cells. The
    cells of that depth must not be narrower than the radius: without depth the deepest such one is taken, a deeper one
    is refused. Rows of a cell are dealt in blocks, and there are as many tasks as the pairs to compare ask for.
    """
    most = geometry.best_starting_depth(radius)
    if most is None:
        raise ValueError(f"a radius of {radius} degrees is wider than the cells of depth 0")
    if depth is not None and depth > most:
        raise ValueError(f"at depth {depth} cells are narrower than {radius} degrees; the deepest depth for it is {most}")
    depth, fine = most if depth is None else depth, min(most + MATCH_LEVELS, cells.MAX_DEPTH)
    l = with_hash(left.selectExpr("id AS left_id", "lon AS l_lon", "lat AS l_lat"), fine, "l_lon", "l_lat", "cell").where("cell IS NOT NULL")
    # a row becomes some sixty, so few rows make a task; a small file comes as one partition
    r = right.selectExpr("id AS right_id", "lon AS r_lon", "lat AS r_lat").repartition(max(1, math.ceil(right.count() / 16384)), "right_id", "r_lon", "r_lat")
    r = with_hash(r, depth, "r_lon", "r_lat", "ipix").where("ipix IS NOT NULL")
    near = cells.apply(r, cells.neighbours(depth)).select("right_id", "r_lon", "r_lat", F.explode(F.array_distinct(F.array_compact(F.array("ipix", *[f"n_{d.lower()}" for d in cells.DIRECTIONS])))).alias("cell"))
    for d in range(depth + 1, fine + 1):
        near = near.select("right_id", "r_lon", "r_lat", F.explode(F.expr("sequence(4 * cell, 4 * cell + 3)")).alias("cell"))
        reach = radius * (1 + 1e-9) + geometry.largest_radius(d)
        near = cells.apply(near, cells.position(d, "cell", lon="c_lon", lat="c_lat"))
        near = near.where(F.expr(cells.doubles(haversine("c_lon", "c_lat", "r_lon", "r_lat"))) <= reach).select("right_id", "r_lon", "r_lat", "cell")
    l, near, n = _blocks(l, near)
    both = l.repartition(n, "cell", "_a", "_b").join(near.repartition(n, "cell", "_a", "_b"), ["cell", "_a", "_b"])
    both = both.withColumn("distance", F.expr(cells.doubles(haversine("l_lon", "l_lat", "r_lon", "r_lat"))))
    return both.where(F.col("distance") <= radius).select("left_id", "right_id", "distance")


def _blocks(l: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with _a and _b, so that rows of a cell meet once in blocks of few rows of each side; and how many tasks these need."""
    counts = l.groupBy("cell").agg(F.count("*").alias("_l")).join(r.groupBy("cell").agg(F.count("*").alias("_r")), "cell", "full")
    counts = storage.held(counts.select("cell", F.coalesce("_l", F.lit(0)).alias("_l"), F.coalesce("_r", F.lit(0)).alias("_r")))
    pairs, rows = counts.agg(F.sum(F.col("_l").cast("double") * F.col("_r")), F.sum(F.col("_l") + F.col("_r"))).first()
    n = max(l.sparkSession.sparkContext.defaultParallelism, math.ceil((pairs or 0) / MATCH_PAIRS), math.ceil((rows or 0) / (MATCH_PAIRS >> 3)))
    # of these there are few, as each has many rows
    many = counts.where(F.greatest("_l", "_r") > MATCH_SIDE).select("cell", *[F.ceil(F.greatest(F.col(c), F.lit(1)) / MATCH_SIDE).cast("int").alias(f"{c}_k") for c in ("_l", "_r")])
    out = []
    for side, own, other, mine, theirs in ((l, "_l_k", "_r_k", "_a", "_b"), (r, "_r_k", "_l_k", "_b", "_a")):
        block = F.pmod(F.xxhash64(*[c for c in side.columns if c != "cell"]), F.coalesce(own, F.lit(1))).cast("int")
        dealt = side.join(F.broadcast(many), "cell", "left").withColumn(mine, block)
        out.append(dealt.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("_l_k", "_r_k"))
    return *out, n
