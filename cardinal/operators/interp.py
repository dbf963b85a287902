"""Interpolation card (I1-I8): knots are the training rows, evaluated at every row.

The as-of bracket (nearest knot at or before / at or after each row's
input) is computed without a single-partition window:

1. knots and rows are unioned and range-partitioned by ``(input, kind)``
   (knots sort before rows at equal input), so any hot input value or dense
   region is spread over many ordered partitions;
2. inside each partition a running ``last``/``first`` (ignore nulls) over the
   sorted positions gives the local brackets;
3. the first and last knot of every partition (at most ``P`` rows) give the
   carry-in from neighbouring partitions, broadcast back as a ``P``-row table.

Knots carry their neighbours (knot rank -2..+2), attached by equi-joins on
a dense knot rank, so quadratic pieces need no further lookup.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardinal.functions.columns import asc, ieee_div, join_names, qcol
from cardinal.operators.filters import training_rows
from cardinal.operators.ranking import RN, ordered_cumsum, ordered_numbers
from cardinal.plans.card import Card, CardState, OutputVariables, SourceVariables, check_fields, method_of, register_card
from cardinal.session import reliable_checkpoint

_K = "_ip_knot"
_KIND = "_ip_kind"
_X = "_ip_x"


def numeric_input(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        # wall-clock seconds since 1970-01-01, independent of the session time zone
        return (F.unix_date(c.cast("date")).cast("double") * 86400.0 + F.hour(c) * 3600.0 + F.minute(c) * 60.0
                + F.date_part(F.lit("SECOND"), c).cast("double"))
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("double") / 1e6
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double")


SPLINE_BLOCK = 4096  # knots solved together in one task
SPLINE_HALO = 64     # neighbouring knots on each side; boundary influence decays at least as 2**-k


def spline_second_derivatives(ranked: DataFrame, ys: list[str]) -> DataFrame:
    """Natural cubic spline second derivatives ``M`` per knot, solved in bounded blocks.

    Knot ``r`` belongs to block ``r // B`` and is copied into a neighbouring
    block when within ``H`` knots of its edge.  Each block solves its
    tridiagonal system (natural ends, exact at the true ends) and keeps its
    own knots.  The system is diagonally dominant with off-diagonal/diagonal
    ratio <= 1/2, so the error from the artificial block edges is below
    2**-H relative: at H = 64 the blocks reproduce the global solve.
    """
    import pandas as pd

    B, H = SPLINE_BLOCK, SPLINE_HALO
    blk = F.floor(F.col("r") / B).cast("long")
    lo_edge = (F.col("r") % B) < H
    hi_edge = (F.col("r") % B) >= B - H
    copies = F.array(*[F.when(c, b) for c, b in ((F.lit(True), blk), (lo_edge, blk - 1), (hi_edge, blk + 1))])
    exploded = ranked.select("r", "x", *ys, F.explode(F.filter(copies, lambda v: v.isNotNull() & (v >= 0))).alias("blk"))
    out_schema = "r long, " + ", ".join(f"M_{y} double" for y in ys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("r")
        b = int(pdf["blk"].iloc[0])
        x = pdf["x"].to_numpy(dtype=float)
        n = len(x)
        res = {"r": pdf["r"].to_numpy()}
        for y in ys:
            v = pdf[y].to_numpy(dtype=float)
            M = np.zeros(n)
            if n > 2:
                h = np.diff(x)
                d = np.diff(v) / h
                diag = 2 * (h[:-1] + h[1:])
                rhs = 6 * (d[1:] - d[:-1])
                sub, sup = h[1:-1].copy(), h[1:-1].copy()
                # Thomas algorithm on the interior unknowns M_1..M_{n-2}
                cp, dp = np.zeros(n - 2), np.zeros(n - 2)
                cp[0] = sup[0] / diag[0] if n > 3 else 0.0
                dp[0] = rhs[0] / diag[0]
                for i in range(1, n - 2):
                    den = diag[i] - sub[i - 1] * cp[i - 1]
                    cp[i] = sup[i] / den if i < n - 3 else 0.0
                    dp[i] = (rhs[i] - sub[i - 1] * dp[i - 1]) / den
                sol = np.zeros(n - 2)
                sol[-1] = dp[-1]
                for i in range(n - 4, -1, -1):
                    sol[i] = dp[i] - cp[i] * sol[i + 1]
                M[1:-1] = sol
            res[f"M_{y}"] = M
        out = pd.DataFrame(res)
        keep = (out["r"] // B) == b
        return out[keep.to_numpy()]

    return exploded.groupBy("blk").applyInPandas(solve, out_schema)


def quadratic_spline_slopes(ranked: DataFrame, ys: list[str]) -> DataFrame:
    """Knot slopes of the C1 quadratic spline with zero initial slope.

    ``z_{i+1} = 2 d_i - z_i`` unrolls to ``z_i = (-1)^i sum_{j<i} (-1)^(j+1) 2 d_i``:
    an exclusive running sum over the knot order, computed distributed.
    """
    a, n = ranked.alias("a"), ranked.alias("n")
    sec = a.join(n, F.col("n.r") == F.col("a.r") + 1, "left").select(
        F.col("a.r").alias("r"),
        *[((F.col(f"n.{y}") - F.col(f"a.{y}")) / (F.col("n.x") - F.col("a.x"))).alias(f"d_{y}") for y in ys])
    # ranks are 1-based: knot j = r - 1, so (-1)^(j+1) = (-1)^r and (-1)^i = (-1)^(r-1)
    sign = F.when(F.col("r") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    out = sec.select("r")
    for y in ys:
        terms = sec.select("r", (sign * 2 * F.coalesce(F.col(f"d_{y}"), F.lit(0.0))).alias("t"))
        cs = ordered_cumsum(terms, "r", "t", "c")
        z = F.when(F.col("r") % 2 == 1, F.col("c")).otherwise(-F.col("c"))
        out = out.join(cs.select("r", z.alias(f"Q_{y}")), "r")
    return out


def knot_table(train: DataFrame, x: Column, targets: list[str], spline: bool = False,
               quadspline: bool = False) -> DataFrame:
    """Distinct knots ``(r, x, y...)`` with neighbours; duplicate inputs are averaged."""
    k = (
        train.select(x.alias("x"), *[qcol(t).cast("double").alias(f"y{i}") for i, t in enumerate(targets)])
        .dropna()
        .groupBy("x")
        .agg(*[F.avg(f"y{i}").alias(f"y{i}") for i in range(len(targets))])
    )
    ranked = ordered_numbers(k, ["x"], (), tiebreak=["x"]).select(F.col(RN).alias("r"), "*").drop(RN, "_cd_rank", "_cd_n")
    ranked = reliable_checkpoint(ranked)
    ys = [f"y{i}" for i in range(len(targets))]
    if spline:
        ranked = reliable_checkpoint(ranked.join(spline_second_derivatives(ranked, ys), "r"))
    if quadspline:
        ranked = reliable_checkpoint(ranked.join(quadratic_spline_slopes(ranked, ys), "r"))
    extra = ([f"M_{y}" for y in ys] if spline else []) + ([f"Q_{y}" for y in ys] if quadspline else [])
    pt = lambda p: F.struct(F.col(f"{p}.x").alias("x"), *[F.col(f"{p}.{y}").alias(y) for y in ys + extra])
    a = ranked.alias("a")
    joined = (
        a.join(ranked.alias("m2"), F.col("m2.r") == F.col("a.r") - 2, "left")
        .join(ranked.alias("m1"), F.col("m1.r") == F.col("a.r") - 1, "left")
        .join(ranked.alias("p1"), F.col("p1.r") == F.col("a.r") + 1, "left")
        .join(ranked.alias("p2"), F.col("p2.r") == F.col("a.r") + 2, "left")
    )
    slopes = []
    for y in ys:
        slopes += [pchip_slope(y).alias(f"dp_{y}"), akima_slope(y).alias(f"da_{y}")]
        if spline:
            slopes.append(F.col(f"a.M_{y}").alias(f"M_{y}"))
        if quadspline:
            slopes.append(F.col(f"a.Q_{y}").alias(f"Q_{y}"))
    out = joined.select(F.col("a.x").alias("x"), F.struct(
        F.col("a.r").alias("r"), F.col("a.x").alias("x"), *[F.col(f"a.{y}").alias(y) for y in ys],
        *slopes,
        F.when(F.col("m2.r").isNotNull(), pt("m2")).alias("m2"),
        F.when(F.col("m1.r").isNotNull(), pt("m1")).alias("m1"),
        F.when(F.col("p1.r").isNotNull(), pt("p1")).alias("p1"),
        F.when(F.col("p2.r").isNotNull(), pt("p2")).alias("p2"),
    ).alias(_K))
    return out


def _secant(p: str, q: str, y: str) -> Column:
    """Slope of the segment between joined knots ``p`` and ``q`` (NULL if either is missing)."""
    return (F.col(f"{q}.{y}") - F.col(f"{p}.{y}")) / (F.col(f"{q}.x") - F.col(f"{p}.x"))


def pchip_slope(y: str) -> Column:
    """Fritsch-Carlson monotone slope at knot ``a`` (three-point rule at the ends)."""
    h0 = F.col("a.x") - F.col("m1.x")
    h1 = F.col("p1.x") - F.col("a.x")
    d0, d1 = _secant("m1", "a", y), _secant("a", "p1", y)
    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    interior = F.when(d0 * d1 <= 0, F.lit(0.0)).otherwise((w1 + w2) / (w1 / d0 + w2 / d1))

    def end(hA, hB, dA, dB):
        e = ((2 * hA + hB) * dA - hA * dB) / (hA + hB)
        return (F.when(F.signum(e) != F.signum(dA), F.lit(0.0))
                .when((F.signum(dA) != F.signum(dB)) & (F.abs(e) > 3 * F.abs(dA)), 3 * dA)
                .otherwise(e))

    first = end(h1, F.col("p2.x") - F.col("p1.x"), d1, _secant("p1", "p2", y))
    last = end(h0, F.col("m1.x") - F.col("m2.x"), d0, _secant("m2", "m1", y))
    two = F.coalesce(d0, d1)
    return (F.when(F.col("m1.r").isNull() & F.col("p1.r").isNull(), F.lit(0.0))
            .when(F.col("m1.r").isNull(), F.when(F.col("p2.r").isNull(), two).otherwise(first))
            .when(F.col("p1.r").isNull(), F.when(F.col("m2.r").isNull(), two).otherwise(last))
            .otherwise(interior))


def akima_slope(y: str) -> Column:
    """Akima (1970) slope at knot ``a`` from the four surrounding secants, ends extended linearly."""
    sm2, sm1 = _secant("m2", "m1", y), _secant("m1", "a", y)
    s0, sp1 = _secant("a", "p1", y), _secant("p1", "p2", y)
    # missing secants beyond the ends: m_-1 = 2 m_0 - m_1, m_-2 = 3 m_0 - 2 m_1 (mirrored on the right)
    sm1_ = F.coalesce(sm1, 2 * s0 - sp1)
    sm2_ = F.coalesce(sm2, F.when(sm1.isNull(), 3 * s0 - 2 * sp1).otherwise(2 * sm1 - s0))
    s0_ = F.coalesce(s0, 2 * sm1 - sm2)
    sp1_ = F.coalesce(sp1, F.when(s0.isNull(), 3 * sm1 - 2 * sm2).otherwise(2 * s0 - sm1))
    w1 = F.abs(sp1_ - s0_)
    w2 = F.abs(sm1_ - sm2_)
    return F.when(w1 + w2 == 0, (sm1_ + s0_) / 2).otherwise((w1 * sm1_ + w2 * s0_) / (w1 + w2))


def _hermite(X, lo, hi, y, slope):
    h = hi.x - lo.x
    t = (X - lo.x) / h
    t2, t3 = t * t, t * t * t
    return ((2 * t3 - 3 * t2 + 1) * lo[y] + (t3 - 2 * t2 + t) * h * lo[f"{slope}_{y}"]
            + (-2 * t3 + 3 * t2) * hi[y] + (t3 - t2) * h * hi[f"{slope}_{y}"])


def asof_brackets(df: DataFrame, x: Column, knots: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Add ``_ip_lo`` (last knot with x_k <= x) and ``_ip_hi`` (first knot with x_k >= x)."""
    spark = df.sparkSession
    P = int(num_partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    cols = list(df.columns)
    rows = df.select("*", x.alias(_X), F.lit(1).alias(_KIND), F.lit(None).cast(knots.schema[_K].dataType).alias(_K))
    ks = knots.select(F.col("x").alias(_X), F.lit(0).alias(_KIND), F.col(_K))
    # The tiebreak splits a hot input value over several range partitions; order among
    # equal inputs does not change any bracket (knots still sort first at equal input).
    allrows = rows.unionByName(ks, allowMissingColumns=True).withColumn("_ip_tb", F.monotonically_increasing_id())
    spec = [asc(_X), asc(_KIND), asc("_ip_tb")]
    staged = (
        allrows.repartitionByRange(P, *spec)
        .sortWithinPartitions(*spec)
        .withColumn("_ip_pid", F.spark_partition_id())
        .withColumn("_ip_pos", F.monotonically_increasing_id())
    )
    # Both brackets are running frames (unbounded preceding .. current row);
    # the upper one runs over descending positions, because a
    # current-row..unbounded-following frame is re-evaluated per row.
    fwd = Window.partitionBy("_ip_pid").orderBy(F.col("_ip_pos").asc())
    bwd = Window.partitionBy("_ip_pid").orderBy(F.col("_ip_pos").desc())
    lo = F.last(_K, ignorenulls=True).over(fwd.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hi = F.last(_K, ignorenulls=True).over(bwd.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = reliable_checkpoint(staged.select("*", lo.alias("_ip_llo"), hi.alias("_ip_lhi")))

    kstruct = knots.schema[_K].dataType
    edges = (
        local.where(F.col(_KIND) == 0)
        .groupBy("_ip_pid")
        .agg(F.min_by(F.col(_K), F.col("_ip_pos")).alias("first"), F.max_by(F.col(_K), F.col("_ip_pos")).alias("last"))
        .collect()  # at most one row per range partition
    )
    by_pid = {r["_ip_pid"]: r for r in edges}
    pids = sorted(set(by_pid) | set(range(P)))
    carry = []
    prev_last = None
    for p in pids:
        carry.append([p, prev_last, None])
        if p in by_pid:
            prev_last = by_pid[p]["last"]
    nxt = None
    for row in reversed(carry):
        row[2] = nxt
        if row[0] in by_pid:
            nxt = by_pid[row[0]]["first"]
    schema = T.StructType([T.StructField("_ip_pid", T.IntegerType()), T.StructField("_ip_clo", kstruct),
                           T.StructField("_ip_chi", kstruct)])
    carries = spark.createDataFrame([tuple(r) for r in carry], schema)
    joined = local.where(F.col(_KIND) == 1).join(F.broadcast(carries), "_ip_pid", "left")
    return joined.select(
        *[qcol(c) for c in cols], F.col(_X),
        F.coalesce("_ip_llo", "_ip_clo").alias("_ip_lo"), F.coalesce("_ip_lhi", "_ip_chi").alias("_ip_hi"),
    )


def _lin(x, x0, y0, x1, y1):
    return y0 + (y1 - y0) * ieee_div(x - x0, x1 - x0)


def _quad(x, pts):
    (x0, y0), (x1, y1), (x2, y2) = pts
    return (y0 * ((x - x1) * (x - x2)) / ((x0 - x1) * (x0 - x2))
            + y1 * ((x - x0) * (x - x2)) / ((x1 - x0) * (x1 - x2))
            + y2 * ((x - x0) * (x - x1)) / ((x2 - x0) * (x2 - x1)))


INTERP_METHODS = ("constant", "linear", "quadratic", "quadraticspline", "pchip", "akima", "cubicspline")
EXTRAPOLATIONS = ("none", "constant", "linear", "extension", "periodic", "reflective")


def folded(x: Column, knots: DataFrame, left: str, right: str) -> Column:
    """Inputs beyond the knots brought back among them, where the side's rule is periodic or reflective."""
    if not {left, right} & {"periodic", "reflective"}:
        return x
    low, high = knots.agg(F.min("x"), F.max("x")).first()
    if low is None or low == high:
        return x
    span = high - low

    def back(rule):
        if rule == "periodic":
            return F.lit(low) + F.pmod(x - F.lit(low), F.lit(span))
        if rule == "reflective":
            return F.lit(low) + F.lit(span) - F.abs(F.pmod(x - F.lit(low), F.lit(2 * span)) - F.lit(span))
        return x

    return F.when(x < F.lit(low), back(left)).when(x > F.lit(high), back(right)).otherwise(x)


def interpolate(df: DataFrame, input: str, targets: list[str], outputs: list[str], knots: DataFrame,
                method: str = "linear", dir: str = "left", extrapolation_left: str = "none",
                extrapolation_right: str = "none") -> DataFrame:
    x = numeric_input(qcol(input), df.schema[input].dataType)
    br = asof_brackets(df, folded(x, knots, extrapolation_left, extrapolation_right), knots)
    X = F.col(_X)
    lo, hi = F.col("_ip_lo"), F.col("_ip_hi")
    exprs = []
    for i, out in enumerate(outputs):
        y = f"y{i}"
        if method == "constant":
            inside = F.when(lo.x == X, lo[y]).otherwise(lo[y] if dir == "left" else hi[y])
            end_piece_left, end_piece_right = hi[y], lo[y]
        elif method == "linear":
            inside = F.when(lo.x == X, lo[y]).otherwise(_lin(X, lo.x, lo[y], hi.x, hi[y]))
            end_piece_left = _lin(X, hi.x, hi[y], hi.p1.x, hi.p1[y])
            end_piece_right = _lin(X, lo.m1.x, lo.m1[y], lo.x, lo[y])
        elif method == "quadraticspline":
            h = hi.x - lo.x
            t = X - lo.x
            dsec = (hi[y] - lo[y]) / h
            inside = F.when(lo.x == X, lo[y]).otherwise(lo[y] + lo[f"Q_{y}"] * t + (dsec - lo[f"Q_{y}"]) * t * t / h)
            end_piece_left = hi[y] + (X - hi.x) * hi[f"Q_{y}"]
            end_piece_right = lo[y] + (X - lo.x) * (2 * (lo[y] - lo.m1[y]) / (lo.x - lo.m1.x) - lo.m1[f"Q_{y}"])
        elif method == "cubicspline":
            h = hi.x - lo.x
            a_, b_ = hi.x - X, X - lo.x
            Ml, Mh = lo[f"M_{y}"], hi[f"M_{y}"]
            inside = F.when(lo.x == X, lo[y]).otherwise(
                Ml * a_ * a_ * a_ / (6 * h) + Mh * b_ * b_ * b_ / (6 * h)
                + (lo[y] / h - Ml * h / 6) * a_ + (hi[y] / h - Mh * h / 6) * b_)
            # natural ends: the end pieces continue as straight lines
            end_piece_left = hi[y] + (X - hi.x) * ((hi.p1[y] - hi[y]) / (hi.p1.x - hi.x)
                                                    - (hi.p1.x - hi.x) * hi.p1[f"M_{y}"] / 6)
            end_piece_right = lo[y] + (X - lo.x) * ((lo[y] - lo.m1[y]) / (lo.x - lo.m1.x)
                                                    + (lo.x - lo.m1.x) * lo.m1[f"M_{y}"] / 6)
        elif method in ("pchip", "akima"):
            sl = "dp" if method == "pchip" else "da"
            inside = F.when(lo.x == X, lo[y]).otherwise(_hermite(X, lo, hi, y, sl))
            end_piece_left = hi[y] + (X - hi.x) * hi[f"{sl}_{y}"]
            end_piece_right = lo[y] + (X - lo.x) * lo[f"{sl}_{y}"]
        else:
            fwd = [(lo.x, lo[y]), (hi.x, hi[y]), (hi.p1.x, hi.p1[y])]
            bwd = [(lo.m1.x, lo.m1[y]), (lo.x, lo[y]), (hi.x, hi[y])]
            inside = F.when(lo.x == X, lo[y]).when(hi.p1.isNotNull(), _quad(X, fwd)).otherwise(_quad(X, bwd))
            end_piece_left = _quad(X, [(hi.x, hi[y]), (hi.p1.x, hi.p1[y]), (hi.p2.x, hi.p2[y])])
            end_piece_right = _quad(X, [(lo.m2.x, lo.m2[y]), (lo.m1.x, lo.m1[y]), (lo.x, lo[y])])

        def extra(rule, end, piece):
            if rule == "none":
                return F.raise_error(F.lit(f"input {input!r} outside the knot range and extrapolation is none"))
            if rule in ("constant", "periodic", "reflective"):  # folded inputs lie among the knots
                return end
            return piece

        left_val = extra(extrapolation_left, hi[y],
                         end_piece_left if extrapolation_left == "extension" or method == "linear"
                         else _lin(X, hi.x, hi[y], hi.p1.x, hi.p1[y]))
        right_val = extra(extrapolation_right, lo[y],
                          end_piece_right if extrapolation_right == "extension" or method == "linear"
                          else _lin(X, lo.m1.x, lo.m1[y], lo.x, lo[y]))
        val = (F.when(X.isNull(), F.lit(None))
               .when(lo.isNull() & hi.isNull(), F.lit(None))
               .when(lo.isNull(), left_val)
               .when(lo.x == X, lo[y])
               .when(hi.isNull(), right_val)
               .otherwise(inside))
        exprs.append(val.cast("double").alias(out))
    keep = [qcol(c) for c in df.columns if c not in outputs]
    return br.select(*keep, *exprs)


@register_card("interp", "Interpolation")
@dataclass(frozen=True)
class InterpCard(Card):
    input: str
    targets: tuple
    method: str = "linear"
    dir: str = "left"
    extrapolation_left: str = "none"
    extrapolation_right: str = "none"
    partition: str | None = None
    suffix: str = "hat"
    streamable = False

    def __post_init__(self):
        object.__setattr__(self, "targets", tuple(self.targets))
        if self.method not in INTERP_METHODS:
            raise ValueError(f"unknown method {self.method!r}; valid: {', '.join(INTERP_METHODS)}")
        if self.dir not in ("left", "right"):
            raise ValueError("dir must be left or right")
        if not self.targets:
            raise ValueError("interp needs targets")
        for e in (self.extrapolation_left, self.extrapolation_right):
            if e not in EXTRAPOLATIONS:
                raise ValueError(f"unknown extrapolation {e!r}; valid: {', '.join(EXTRAPOLATIONS)}")

    @classmethod
    def from_config(cls, d):
        d = dict(d)
        m = d.pop("method")
        name, params = method_of(m, list(INTERP_METHODS))
        extra = params.pop("extrapolation", None)
        if extra:
            params.setdefault("extrapolation_left", extra)
            params.setdefault("extrapolation_right", extra)
        check_fields(cls, {**d, **params})
        return cls(method=name, **params, **d)

    def outputs(self):
        return [join_names(t, self.suffix) for t in self.targets]

    def source_variables(self):
        return SourceVariables(order_by=[self.input], inputs=[self.input], targets=list(self.targets),
                               partition=[self.partition] if self.partition else [])

    def output_variables(self):
        return OutputVariables(self.outputs())

    def fit(self, df, id_var=None):
        x = numeric_input(qcol(self.input), df.schema[self.input].dataType)
        knots = knot_table(training_rows(df, self.partition), x, list(self.targets),
                           spline=self.method == "cubicspline", quadspline=self.method == "quadraticspline")
        return CardState(tables={"knots": reliable_checkpoint(knots)})

    def transform(self, df, state, id_var=None):
        return interpolate(df, self.input, list(self.targets), self.outputs(), state.tables["knots"], self.method,
                           self.dir, self.extrapolation_left, self.extrapolation_right)
