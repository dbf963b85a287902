"""Ordered window numbers without single-partition or hot-group tasks.

``rank``, ``percent_rank``, ``row_number`` and ``ntile`` are defined over
``PARTITION BY group_by ORDER BY order_by``.  A plain Spark window shuffles
every row of a group into one task: one hot group (or an empty ``group_by``)
puts the whole table in one task.  Instead the order on ``(group_by, order_by,
tiebreak)`` is cut into slices, so that a hot group falls into many of them:

1. cuts between the slices come from a sample of the key columns, once, and
   make a row's slice an expression of its keys;
2. *local* numbers come from windows keyed by ``(slice, group)``: the one
   exchange of the rows;
3. a group (or tie run) lies in several slices only if a cut lies in it, so
   its rows per slice come from a pass over the key columns that counts, per
   slice, the rows that share the group (or the tie run) of the slice's cuts:
   one row per slice, whatever the number of groups;
4. the driver turns these into carries, which are broadcast (as many rows as
   slices, never growing with the data) and added to the local numbers.

This reads the source several times, so it needs a source that gives the same
rows each time: files or local rows under projections and filters, with a
unique ``tiebreak``.  Any other source is range-partitioned and written to the
shared checkpoint folder once (`staged_numbers`), with the same carries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardinal.functions.columns import asc, qcol
from cardinal.operators.joins import broadcast_if_bounded
from cardinal.session import reliable_checkpoint

_P = "_cd_pid"
_POS = "_cd_pos"
_TB = "_cd_tiebreak"
FILES_BROADCAST = 200_000  # offsets of so many files or splits (path and two numbers) may be broadcast: some 40 MB
RN, RANK, N = "_cd_rn", "_cd_rank", "_cd_n"
SLICE, CUTS = "_cd_slice", "_cd_cuts"
SLICES = 4  # slices for each shuffle partition, so that hashing them fills the partitions evenly
SAMPLED = 100  # key rows drawn for each slice


def _norm(v):
    """Hashable, NaN-safe key value for comparing boundary keys on the driver."""
    if isinstance(v, float) and math.isnan(v):
        return ("nan",)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def ordered_numbers(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = (),
                    tiebreak: Sequence[str] | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add ``_cd_rn`` (row_number), ``_cd_rank`` (rank) and ``_cd_n`` (group size).

    Order is ascending, NULLS LAST.  ``row_number`` breaks ties of
    ``order_by`` by ``tiebreak`` (unique columns, e.g. the primary key);
    without one, a generated id is used and tie order is arbitrary (as in SQL).
    """
    order_by, group_by = list(order_by), list(group_by)
    if not order_by:
        raise ValueError("order_by must not be empty")
    P = int(num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if tiebreak and repeatable(df):
        return sliced_numbers(df, order_by, group_by, list(tiebreak), SLICES * P)
    return staged_numbers(df, order_by, group_by, tiebreak, P)


def repeatable(df: DataFrame) -> bool:
    """True if every run of ``df`` gives the same rows: projections and filters over one file scan or local rows."""
    node = df._jdf.queryExecution().analyzed()
    while node.children().size() == 1 and node.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        if not node.deterministic():
            return False
        node = node.children().head()
    return node.children().isEmpty() and ("Relation" in node.nodeName() or node.nodeName() == "Range")


def sort_key(cols: Sequence[str]) -> Column:
    """The columns as one struct that compares in their order, NULLS LAST."""
    fields = []
    for i, c in enumerate(cols):
        fields += [qcol(c).isNull().alias(f"n{i}"), qcol(c).alias(f"k{i}")]
    return F.struct(*fields)


def same_head(a: Column, b: Column, size: int) -> Column:
    """True if two key structs, none of them null, agree in their first ``size`` columns."""
    same = a.isNotNull() & b.isNotNull()
    for i in range(size):
        same = same & a[f"k{i}"].eqNullSafe(b[f"k{i}"])
    return same


def slice_cuts(df: DataFrame, cols: Sequence[str], slices: int) -> DataFrame:
    """One row with ``_cd_cuts``: the sorted keys at which slices 1, 2, ... begin (fewer if the rows are few)."""
    keys = df.select(sort_key(cols).alias("k"))
    share = min(1.0, SAMPLED * slices / max(1, keys.count()))
    drawn = keys.sample(share, seed=0) if share < 1 else keys
    drawn = drawn.agg(F.sort_array(F.collect_list("k")).alias("s"))  # about SAMPLED * slices keys
    at = F.sequence(F.lit(1), F.lit(slices - 1))
    picked = F.transform(at, lambda i: F.get("s", F.floor(i * F.size("s") / slices).cast("int")))
    return reliable_checkpoint(drawn.select(F.array_distinct(F.filter(picked, lambda k: k.isNotNull())).alias(CUTS)))


def sliced_numbers(df: DataFrame, order_by: list[str], group_by: list[str], tiebreak: list[str],
                   slices: int) -> DataFrame:
    """`ordered_numbers` of a repeatable source: one exchange of the rows, nothing written but the cuts."""
    cols, spec = list(df.columns), group_by + order_by + tiebreak
    ng, nk = len(group_by), len(group_by) + len(order_by)
    cuts = slice_cuts(df, spec, max(2, slices))
    bounds = cuts.scalar()  # evaluated once, a literal in the tasks
    rows = df.withColumn(CUTS, bounds).withColumn("_cd_key", sort_key(spec)).withColumn(SLICE, F.lit(0))
    for i in reversed(range(max(2, slices).bit_length())):  # how many cuts are not above the row's key, by bisection
        above = F.get(F.col(CUTS), F.col(SLICE) + (1 << i) - 1) <= F.col("_cd_key")
        rows = rows.withColumn(SLICE, F.col(SLICE) + F.when(above, F.lit(1 << i)).otherwise(F.lit(0)))
    lower, upper = F.get(F.col(CUTS), F.col(SLICE) - 1), F.get(F.col(CUTS), F.col(SLICE))
    goes_on, run_goes_on = same_head(lower, F.col("_cd_key"), ng), same_head(lower, F.col("_cd_key"), nk)
    stays, run_stays = same_head(upper, F.col("_cd_key"), ng), same_head(upper, F.col("_cd_key"), nk)

    counted = rows.groupBy(SLICE).agg(
        F.count_if(goes_on).alias("first"), F.count_if(stays).alias("last"), F.count_if(run_stays).alias("run"))
    counts = {r[SLICE]: r for r in counted.collect()}  # one row per slice
    def pairs(size):
        at = F.filter(F.sequence(F.lit(0), F.size(CUTS)), lambda i: i + 1 < F.size(CUTS))
        return F.transform(at, lambda i: same_head(F.get(CUTS, i), F.get(CUTS, i + 1), size))

    alike = cuts.select(F.size(CUTS).alias("m"), pairs(ng).alias("group"), pairs(nk).alias("run")).first()
    m = alike["m"]

    def count(s: int, name: str) -> int:
        return counts[s][name] if s in counts else 0

    open_group, open_run, total = [0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for s in range(1, m + 1):  # cut s - 1 lies between slices s - 1 and s
        open_group[s] = count(s - 1, "last") + (open_group[s - 1] if s > 1 and alike["group"][s - 2] else 0)
        open_run[s] = count(s - 1, "run") + (open_run[s - 1] if s > 1 and alike["run"][s - 2] else 0)
    for s in range(m, 0, -1):  # rows of the group in which cut s - 1 lies
        total[s] = total[s + 1] if s < m and alike["group"][s - 1] else open_group[s] + count(s, "first")
    carries = [(s, open_group[s], open_run[s], total[s], total[s + 1] if s < m else 0) for s in range(m + 1)]
    carries = df.sparkSession.createDataFrame(
        carries, f"{SLICE} int, _cd_cg long, _cd_ck long, _cd_tf long, _cd_tl long")

    rows = rows.select(*[qcol(c) for c in cols], SLICE, goes_on.alias("_cd_on"), run_goes_on.alias("_cd_run"),
                       stays.alias("_cd_stays"))
    within = Window.partitionBy(SLICE, *[qcol(g) for g in group_by])
    rows = rows.withColumn("_cd_lrn", F.row_number().over(within.orderBy(*[asc(c) for c in order_by + tiebreak])))
    rows = rows.withColumn("_cd_lrank", F.rank().over(within.orderBy(*[asc(c) for c in order_by])))
    rows = rows.withColumn("_cd_ln", F.count(F.lit(1)).over(within))
    joined = rows.join(F.broadcast(carries), SLICE, "left")
    before = F.when(F.col("_cd_on"), F.col("_cd_cg")).otherwise(F.lit(0))
    run = F.when(F.col("_cd_run"), F.col("_cd_ck")).otherwise(F.lit(0))
    n = F.when(F.col("_cd_on"), F.col("_cd_tf")).when(F.col("_cd_stays"), F.col("_cd_tl")).otherwise(F.col("_cd_ln"))
    return joined.select(
        *[qcol(c) for c in cols],
        (F.col("_cd_lrn") + before).cast("bigint").alias(RN),
        (F.col("_cd_lrank") + before - run).cast("bigint").alias(RANK),
        n.cast("bigint").alias(N),
    )


def staged_numbers(df: DataFrame, order_by: list[str], group_by: list[str], tiebreak: Sequence[str] | None,
                   P: int) -> DataFrame:
    """`ordered_numbers` of any source: range partitions and positions in them, written once."""
    spark = df.sparkSession
    cols = list(df.columns)
    if tiebreak:
        tb = list(tiebreak)
        src = df
    else:
        tb = [_TB]
        src = df.withColumn(_TB, F.monotonically_increasing_id())
    spec = [asc(c) for c in group_by + order_by + tb]

    staged = (
        src.repartitionByRange(P, *spec)
        .sortWithinPartitions(*spec)
        .withColumn(_P, F.spark_partition_id())
        .withColumn(_POS, F.monotonically_increasing_id())
    )
    seg = Window.partitionBy(_P, *[qcol(g) for g in group_by])
    by_pos = seg.orderBy(_POS)
    by_key = seg.orderBy(*[asc(o) for o in order_by])
    windowed = staged.select(
        "*",
        F.row_number().over(by_pos).alias("_cd_lrn"),
        F.rank().over(by_key).alias("_cd_lrank"),
        F.count(F.lit(1)).over(seg).alias("_cd_ln"),
        F.min(_POS).over(seg).alias("_cd_seg0"),
        F.max(_POS).over(seg).alias("_cd_seg1"),
    )
    windowed = reliable_checkpoint(windowed)

    key = F.struct(*[qcol(c).alias(f"k{i}") for i, c in enumerate(group_by + order_by)])
    stats = (
        windowed.groupBy(_P)
        .agg(
            F.min(_POS).alias("p0"),
            F.max(_POS).alias("p1"),
            F.min_by(key, F.col(_POS)).alias("first_key"),
            F.max_by(key, F.col(_POS)).alias("last_key"),
            F.min_by(F.col("_cd_ln"), F.col(_POS)).alias("first_cnt"),
            F.max_by(F.col("_cd_ln"), F.col(_POS)).alias("last_cnt"),
            F.max_by(F.col("_cd_ln") - F.col("_cd_lrank") + 1, F.col(_POS)).alias("last_tie_cnt"),
        )
        .collect()  # one row per range partition: bounded by P
    )
    ng = len(group_by)
    rows = []
    chains: list[int] = []
    prev = None
    open_g = open_k = 0
    cid_last_prev = -1
    for s in sorted(stats, key=lambda r: r[_P]):
        fk = tuple(_norm(v) for v in s["first_key"])
        lk = tuple(_norm(v) for v in s["last_key"])
        fg, lg = fk[:ng], lk[:ng]
        cont_g = prev is not None and prev[1][:ng] == fg
        cont_k = prev is not None and prev[1] == fk
        carry_g = open_g if cont_g else 0
        carry_k = open_k if cont_k else 0
        if cont_g:
            cid_first = cid_last_prev
            chains[cid_first] += s["first_cnt"]
        else:
            chains.append(s["first_cnt"])
            cid_first = len(chains) - 1
        if fg == lg:
            cid_last = cid_first
            open_g = carry_g + s["last_cnt"]
        else:
            chains.append(s["last_cnt"])
            cid_last = len(chains) - 1
            open_g = s["last_cnt"]
        open_k = carry_k + s["last_tie_cnt"] if fk == lk else s["last_tie_cnt"]
        rows.append([s[_P], s["p0"], s["p1"], carry_g, carry_k, cid_first, cid_last])
        prev = (fk, lk)
        cid_last_prev = cid_last
    carry_rows = [(p, p0, p1, cg, ck, chains[a], chains[b]) for p, p0, p1, cg, ck, a, b in rows]
    carries = spark.createDataFrame(
        carry_rows,
        f"{_P} int, _cd_p0 long, _cd_p1 long, _cd_cg long, _cd_ck long, _cd_tf long, _cd_tl long",
    )

    joined = windowed.join(F.broadcast(carries), _P, "left")
    in_first = F.col("_cd_seg0") == F.col("_cd_p0")
    in_last = F.col("_cd_seg1") == F.col("_cd_p1")
    cg = F.when(in_first, F.col("_cd_cg")).otherwise(F.lit(0))
    ck = F.when(in_first & (F.col("_cd_lrank") == 1), F.col("_cd_ck")).otherwise(F.lit(0))
    n = F.when(in_first, F.col("_cd_tf")).when(in_last, F.col("_cd_tl")).otherwise(F.col("_cd_ln"))
    return joined.select(
        *[qcol(c) for c in cols],
        (F.col("_cd_lrn") + cg).cast("bigint").alias(RN),
        (F.col("_cd_lrank") + cg - ck).cast("bigint").alias(RANK),
        n.cast("bigint").alias(N),
    )


def percent_rank_expr(rank: Column | None = None, n: Column | None = None) -> Column:
    """``(rank - 1) / (n - 1)``, 0 for one-row groups."""
    rank = F.col(RANK) if rank is None else rank
    n = F.col(N) if n is None else n
    return F.when(n > 1, (rank - 1).cast("double") / (n - 1).cast("double")).otherwise(F.lit(0.0))


def ntile_expr(buckets: int, rn: Column | None = None, n: Column | None = None) -> Column:
    """SQL ``ntile(buckets)`` from row number and group size.

    The first ``n % b`` tiles hold one extra row; with more tiles than rows
    each row is its own tile.
    """
    rn = F.col(RN) if rn is None else rn
    n = F.col(N) if n is None else n
    b = F.least(F.lit(int(buckets)).cast("bigint"), n)
    size = F.floor(n / b).cast("bigint")
    large = n - b * size
    i = rn - 1
    small_start = large * (size + 1)
    return F.when(i < small_start, F.floor(i / (size + 1)) + 1).otherwise(
        large + F.floor((i - small_start) / size) + 1
    ).cast("bigint")


WINDOW_METHODS = ("rank", "percent_rank", "row_number")


def window_function(df: DataFrame, method: str, order_by: Sequence[str], group_by: Sequence[str] = (),
                    output: str = "output", tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Add ``output = method() OVER (PARTITION BY group_by ORDER BY order_by)``."""
    if method not in WINDOW_METHODS:
        raise ValueError(f"unknown window function {method!r}; valid: {', '.join(WINDOW_METHODS)}")
    num = ordered_numbers(df, order_by, group_by, tiebreak)
    expr = {"rank": F.col(RANK), "row_number": F.col(RN), "percent_rank": percent_rank_expr()}[method]
    return num.withColumn(output, expr).drop(RN, RANK, N)


def percentile_split(df: DataFrame, percentile: float, order_by: Sequence[str], group_by: Sequence[str] = (),
                     output: str = "partition", tiebreak: Sequence[str] | None = None) -> DataFrame:
    """``1 if percent_rank() <= p else 2``."""
    if not 0 <= percentile <= 1:
        raise ValueError("percentile must be in [0, 1]")
    num = ordered_numbers(df, order_by, group_by, tiebreak)
    part = F.when(percent_rank_expr() <= F.lit(float(percentile)), F.lit(1)).otherwise(F.lit(2))
    return num.withColumn(output, part).drop(RN, RANK, N)


def tiles_split(df: DataFrame, tiles: Sequence[int], order_by: Sequence[str], group_by: Sequence[str] = (),
                repeat: int = 1, tail: int = 0, output: str = "partition",
                tiebreak: Sequence[str] | None = None) -> DataFrame:
    """``tiles[(ntile(N) - 1) % n]`` with ``n = len(tiles)``, ``N = repeat*n + tail``."""
    tiles = list(tiles)
    if not tiles or any(t not in (1, 2) for t in tiles):
        raise ValueError("tiles must be a non-empty list of 1 and 2")
    if repeat < 1 or tail < 0:
        raise ValueError("repeat must be >= 1 and tail >= 0")
    n = len(tiles)
    big_n = repeat * n + tail
    num = ordered_numbers(df, order_by, group_by, tiebreak)
    arr = F.array(*[F.lit(int(t)) for t in tiles])
    idx = ((ntile_expr(big_n) - 1) % n + 1).cast("int")
    return num.withColumn(output, F.try_element_at(arr, idx)).drop(RN, RANK, N)


def ntile(df: DataFrame, buckets: int, order_by: Sequence[str], group_by: Sequence[str] = (),
          output: str = "ntile", tiebreak: Sequence[str] | None = None) -> DataFrame:
    """``ntile(buckets) OVER (...)``."""
    num = ordered_numbers(df, order_by, group_by, tiebreak)
    return num.withColumn(output, ntile_expr(buckets)).drop(RN, RANK, N)


def add_row_id(df: DataFrame, name: str = "_id", order_by: Sequence[str] | None = None) -> DataFrame:
    """Dense 1..N row id.

    With ``order_by`` the id follows that (unique) order.  Without, rows of a
    file scan are numbered in file order (:func:`file_row_id`: no shuffle or
    copy of the rows); rows that come from elsewhere are numbered in the order of
    their partitions, which needs them written once.
    """
    if order_by:
        num = ordered_numbers(df, order_by, (), tiebreak=list(order_by))
        return num.withColumn(name, F.col(RN)).drop(RN, RANK, N)
    in_files = file_row_id(df, name)
    if in_files is not None:
        return in_files
    cols = list(df.columns)
    tagged = reliable_checkpoint(df.withColumn("_cd_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_cd_mid"), 33)
    counts = tagged.groupBy(part.alias("_cd_part")).agg(F.count(F.lit(1)).alias("c")).collect()
    offsets, acc = [], 0
    for r in sorted(counts, key=lambda r: r["_cd_part"]):
        offsets.append((r["_cd_part"], acc))
        acc += r["c"]
    off = df.sparkSession.createDataFrame(offsets, "_cd_part long, _cd_off long")
    idx = F.col("_cd_mid") - F.shiftleft(F.col("_cd_part"), 33)
    return (
        tagged.withColumn("_cd_part", part)
        .join(F.broadcast(off), "_cd_part", "left")
        .select(*[qcol(c) for c in cols], (F.col("_cd_off") + idx + 1).cast("bigint").alias(name))
    )


def plain_scan(df: DataFrame) -> bool:
    """True if ``df`` is a file scan with projections only: no filter, join or limit lies between it and the files."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias", "View") and node.children().size() == 1:
        node = node.children().head()
    return node.children().isEmpty() and "Relation" in node.nodeName()


def scanned(df: DataFrame, column: str) -> bool:
    """True if the scan below ``df`` tells this field of the file metadata."""
    try:
        df.select(F.col(f"_metadata.{column}")).schema
    except AnalysisException:
        return False
    return True


def file_row_id(df: DataFrame, name: str = "_id") -> DataFrame | None:
    """Row ids in the order of (file path, row in the file), or None if ``df`` is not a scan with projections only.

    A row's id is the number of rows in earlier files plus its own number in
    its file.  Parquet readers tell that number; it stays right when filters
    are pushed into the scan and skip row groups, so the rows are read once,
    filtered, with no shuffle.  Other formats tell the place of the split a row
    was read from, and a task reads a split's rows in order.  The counts come
    from a pass over the file metadata; offsets are one row per file or split.
    """
    if not plain_scan(df) or not scanned(df, "file_path"):
        return None
    cols = [qcol(c) for c in df.columns]
    path = F.col("_metadata.file_path").alias("_cd_path")
    if scanned(df, "row_index"):
        keyed = df.select(*cols, path, F.col("_metadata.row_index").alias("_cd_row"))
        counts = df.select(path).groupBy("_cd_path").agg(F.count(F.lit(1)).alias("c"))
        keys, row = ["_cd_path"], F.col("_cd_row")
    else:
        place = F.col("_metadata.file_block_start").alias("_cd_block")
        keyed = df.select(*cols, path, place, F.monotonically_increasing_id().alias("_cd_mid"))
        counts = df.select(path, place, F.monotonically_increasing_id().alias("_cd_mid")).groupBy("_cd_path", "_cd_block").agg(
            F.count(F.lit(1)).alias("c"), F.min("_cd_mid").alias("_cd_first"))
        keys, row = ["_cd_path", "_cd_block"], F.col("_cd_mid") - F.col("_cd_first")
    counts = reliable_checkpoint(counts)
    offsets = ordered_cumsum(counts, F.struct(*keys), "c", "_cd_off")
    offsets, _ = broadcast_if_bounded(offsets.drop("c"), FILES_BROADCAST)
    return keyed.join(offsets, keys).select(*cols, (F.col("_cd_off") + row + 1).cast("bigint").alias(name))


def ordered_cumsum(df: DataFrame, order_col: str | Column, value_col: str, output: str,
                   num_partitions: int | None = None) -> DataFrame:
    """Exclusive running sum of ``value_col`` in ``order_col`` order (unique keys); of integers a long.

    Range partitions give ordered slices; a running window per slice gives
    local sums, and one total per slice (at most ``P`` rows) gives each
    slice's carry, broadcast back.  No single-partition window.
    """
    spark = df.sparkSession
    P = int(num_partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    cols = list(df.columns)
    value = "long" if df.schema[value_col].dataType.typeName() in ("byte", "short", "integer", "long") else "double"
    staged = df.repartitionByRange(P, asc(order_col)).withColumn("_cs_pid", F.spark_partition_id())
    w = Window.partitionBy("_cs_pid").orderBy(asc(order_col)).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(value)
    local = reliable_checkpoint(staged.withColumn("_cs_local", F.coalesce(F.sum(value_col).over(w), zero)))
    totals = local.groupBy("_cs_pid").agg(F.sum(value_col).alias("t")).collect()  # one row per range partition
    carry, acc = [], 0 if value == "long" else 0.0
    for r in sorted(totals, key=lambda r: r["_cs_pid"]):
        carry.append((r["_cs_pid"], acc))
        acc += r["t"] or 0
    cdf = spark.createDataFrame(carry, f"_cs_pid int, _cs_carry {value}")
    return local.join(F.broadcast(cdf), "_cs_pid", "left").select(
        *[qcol(c) for c in cols], (F.col("_cs_local") + F.coalesce("_cs_carry", zero)).alias(output))
