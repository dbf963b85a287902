"""Linear and generalised linear mixed model card with one grouping factor.

Model: ``y = X beta + Z b_g + e``, ``b_g ~ N(0, sigma^2 L L')``, ``e ~ N(0, sigma^2)``,
fitted by maximum likelihood through the profiled deviance of the penalised
least-squares formulation (Bates et al. 2015):

* one Spark aggregation builds the per-group sufficient statistics
  ``Z'Z, Z'X, Z'y`` (one row per group, q and p small) and the global
  ``X'X, X'y, y'y, n``; a hot group is just a bigger partial aggregate;
* each deviance evaluation is one ``mapInPandas`` pass over the group table
  (numpy per group, q x q Cholesky) returning p x p and p sized partial sums;
* the relative covariance factor ``theta`` (q(q+1)/2 numbers) is optimised on
  the driver: Brent's method for one random term, Nelder-Mead otherwise;
* the conditional modes ``b_g`` (BLUPs) stay a DataFrame keyed by the group;
  prediction joins them back (broadcast only under a measured row bound).

Other families/links (G7) use the Laplace approximation: at each ``theta``
penalised IRLS (fixed effects updated inside it) runs the same per-group
statistics with GLM working weights, and ``theta`` minimises the Laplace
deviance.  A group level unseen in training predicts NULL.  Weights are
frequency weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardinal.functions.columns import join_names, qcol
from cardinal.operators.filters import training_rows
from cardinal.operators.glm import design, design_columns, formula_variables
from cardinal.operators.joins import broadcast_if_bounded
from cardinal.plans.card import Card, CardState, OutputVariables, SourceVariables, check_fields, register_card
from cardinal.session import reliable_checkpoint


def _lower(theta: np.ndarray, q: int) -> np.ndarray:
    L = np.zeros((q, q))
    L[np.tril_indices(q)] = theta
    return L


def group_statistics(df: DataFrame, X: list, Z: list, y, w, g: str) -> tuple[DataFrame, dict]:
    """Per-group ``Z'WZ, Z'WX, Z'Wy`` (checkpointed) and global ``X'WX, X'Wy, y'Wy, sum w``."""
    p, q = len(X), len(Z)
    data = df.select(qcol(g).alias("g"), *[x.alias(f"x{i}") for i, x in enumerate(X)],
                     *[z.alias(f"z{j}") for j, z in enumerate(Z)], y.cast("double").alias("y"),
                     w.cast("double").alias("w")).dropna()
    xs = [F.col(f"x{i}") for i in range(p)]
    zs = [F.col(f"z{j}") for j in range(q)]
    W = F.col("w")
    gaggs = [F.sum(W * zs[a] * zs[b]).alias(f"zz{a}_{b}") for a in range(q) for b in range(a, q)]
    gaggs += [F.sum(W * zs[a] * xs[i]).alias(f"zx{a}_{i}") for a in range(q) for i in range(p)]
    gaggs += [F.sum(W * zs[a] * F.col("y")).alias(f"zy{a}") for a in range(q)]
    groups = reliable_checkpoint(data.groupBy("g").agg(*gaggs))
    tot = [F.sum(W * xs[i] * xs[j]).alias(f"xx{i}_{j}") for i in range(p) for j in range(i, p)]
    tot += [F.sum(W * xs[i] * F.col("y")).alias(f"xy{i}") for i in range(p)]
    tot += [F.sum(W * F.col("y") * F.col("y")).alias("yy"), F.sum(W).alias("n")]
    r = data.agg(*tot).first()
    XtX = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            XtX[i, j] = XtX[j, i] = r[f"xx{i}_{j}"]
    glob = {"XtX": XtX, "Xty": np.array([r[f"xy{i}"] for i in range(p)]), "yty": r["yy"], "n": r["n"]}
    return groups, glob


def _unpack(pdf: pd.DataFrame, p: int, q: int):
    m = len(pdf)
    ZtZ = np.zeros((m, q, q))
    for a in range(q):
        for b in range(a, q):
            ZtZ[:, a, b] = ZtZ[:, b, a] = pdf[f"zz{a}_{b}"].to_numpy()
    ZtX = np.stack([np.stack([pdf[f"zx{a}_{i}"].to_numpy() for i in range(p)], -1) for a in range(q)], 1)
    Zty = np.stack([pdf[f"zy{a}"].to_numpy() for a in range(q)], -1)
    return ZtZ, ZtX, Zty


_PART = T.StructType([T.StructField("logdet", T.DoubleType()), T.StructField("M", T.ArrayType(T.DoubleType())),
                      T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("c", T.DoubleType()),
                      T.StructField("Q", T.ArrayType(T.DoubleType())), T.StructField("r", T.ArrayType(T.DoubleType())),
                      T.StructField("s", T.DoubleType()), T.StructField("t", T.ArrayType(T.DoubleType()))])


def _partials(groups: DataFrame, L: np.ndarray, p: int, q: int, norms: bool = False, totals: tuple = ()):
    """Sums over groups of log det A_g, X'Z L A^-1 L'Z'X, X'Z L A^-1 L'Z'y, y'Z L A^-1 L'Z'y.

    With ``norms`` also the three sums that give ``sum_g |u_g|^2`` as a quadratic
    form in beta (``u_g = A_g^-1 L'Z'(y - X beta)``), so the penalty needs no
    extra pass over the modes, and the plain sums of the ``totals`` columns.
    """

    def kernel(it):
        logdet, M, v, c = 0.0, np.zeros((p, p)), np.zeros(p), 0.0
        Q, r, s, t = np.zeros((p, p)), np.zeros(p), 0.0, np.zeros(len(totals))
        for pdf in it:
            if pdf.empty:
                continue
            ZtZ, ZtX, Zty = _unpack(pdf, p, q)
            A = np.einsum("ji,gjk,kl->gil", L, ZtZ, L) + np.eye(q)
            C = np.linalg.cholesky(A)
            logdet += 2 * np.log(np.diagonal(C, axis1=1, axis2=2)).sum()
            LX = np.einsum("ji,gjk->gik", L, ZtX)  # L' Z'X   (g, q, p)
            Ly = np.einsum("ji,gj->gi", L, Zty)    # L' Z'y   (g, q)
            AX = np.linalg.solve(A, LX)
            Ay = np.linalg.solve(A, Ly[..., None])[..., 0]
            M += np.einsum("gqi,gqj->ij", LX, AX)
            v += np.einsum("gqi,gq->i", LX, Ay)
            c += float(np.einsum("gq,gq->", Ly, Ay))
            t += np.array([pdf[name].sum(skipna=False) for name in totals])
            if norms:
                Q += np.einsum("gqi,gqj->ij", AX, AX)
                r += np.einsum("gqi,gq->i", AX, Ay)
                s += float(np.einsum("gq,gq->", Ay, Ay))
        yield pd.DataFrame({"logdet": [logdet], "M": [M.ravel().tolist()], "v": [v.tolist()], "c": [c],
                            "Q": [Q.ravel().tolist()], "r": [r.tolist()], "s": [s], "t": [t.tolist()]})

    from cardinal.functions.partials import sum_partials

    arr, sc = sum_partials(groups.mapInPandas(kernel, _PART), groups.rdd.getNumPartitions(),
                           {"M": p * p, "v": p, "Q": p * p, "r": p, "t": len(totals)}, ["logdet", "c", "s"])
    out = (sc["logdet"], arr["M"].reshape(p, p), arr["v"], sc["c"])
    if norms:
        return out + (arr["Q"].reshape(p, p), arr["r"], sc["s"], dict(zip(totals, arr["t"], strict=True)))
    return out


def profiled_deviance(groups, glob, theta, p, q) -> tuple[float, np.ndarray, float]:
    L = _lower(np.asarray(theta, dtype=float), q)
    logdet, M, v, c = _partials(groups, L, p, q)
    S = glob["XtX"] - M
    beta = np.linalg.solve(S, glob["Xty"] - v)
    r2 = glob["yty"] - c - beta @ (glob["Xty"] - v)
    n = glob["n"]
    dev = logdet + n * (1 + math.log(2 * math.pi * max(r2, 1e-300) / n))
    return dev, beta, r2


def nelder_mead(f, x0, step=0.5, tol=1e-6, maxiter=200, lower=None):
    x0 = np.asarray(x0, dtype=float)
    n = len(x0)
    clip = (lambda x: np.maximum(x, lower)) if lower is not None else (lambda x: x)
    pts = [clip(x0)] + [clip(x0 + step * np.eye(n)[i]) for i in range(n)]
    vals = [f(x) for x in pts]
    for _ in range(maxiter):
        order = np.argsort(vals)
        pts, vals = [pts[i] for i in order], [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) <= tol * (abs(vals[0]) + tol):
            break
        centroid = np.mean(pts[:-1], axis=0)
        xr = clip(centroid + (centroid - pts[-1]))
        fr = f(xr)
        if fr < vals[0]:
            xe = clip(centroid + 2 * (centroid - pts[-1]))
            fe = f(xe)
            pts[-1], vals[-1] = (xe, fe) if fe < fr else (xr, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = xr, fr
        else:
            xc = clip(centroid + 0.5 * (pts[-1] - centroid))
            fc = f(xc)
            if fc < vals[-1]:
                pts[-1], vals[-1] = xc, fc
            else:
                pts = [pts[0]] + [clip(pts[0] + 0.5 * (x - pts[0])) for x in pts[1:]]
                vals = [vals[0]] + [f(x) for x in pts[1:]]
    i = int(np.argmin(vals))
    return pts[i], vals[i]


def search_theta(f, first: float, tol: float, limit: int = 60) -> tuple[np.ndarray, float]:
    """Minimum over theta >= 0: the bracket doubles until the minimum lies inside, then Brent's method.

    A deviance that still falls after ``limit`` doublings has no finite minimum: raises.
    """
    lo, hi = 0.0, first
    here, ahead = f(hi), f(2 * hi)
    for _ in range(limit):
        if ahead >= here:
            return brent(f, lo, 2 * hi, tol=tol)
        lo, hi, here = hi, 2 * hi, ahead
        ahead = f(2 * hi)
    raise ArithmeticError("the deviance falls without bound as the variance ratio grows")


def brent(f, lo: float = 0.0, hi: float = 5.0, tol: float = 1e-3, maxiter: int = 60):
    """Brent's minimiser on [lo, hi]: parabolic steps with golden-section fallback."""
    cg = (3 - math.sqrt(5)) / 2
    a, b = lo, hi
    x = w = v = a + cg * (b - a)
    fx = fw = fv = f(x)
    d = e = 0.0
    for _ in range(maxiter):
        m = (a + b) / 2
        tol1 = tol * (abs(x) + 0.1)  # relative, with an absolute floor near the theta = 0 boundary
        if abs(x - m) <= 2 * tol1 - (b - a) / 2:
            break
        use_golden = True
        if abs(e) > tol1:
            r = (x - w) * (fx - fv)
            qq = (x - v) * (fx - fw)
            pp = (x - v) * qq - (x - w) * r
            qq = 2 * (qq - r)
            if qq > 0:
                pp = -pp
            qq = abs(qq)
            if abs(pp) < abs(0.5 * qq * e) and a * qq < x * qq + pp < b * qq:
                e, d = d, pp / qq
                u = x + d
                if u - a < 2 * tol1 or b - u < 2 * tol1:
                    d = tol1 if x < m else -tol1
                use_golden = False
        if use_golden:
            e = (a - x) if x >= m else (b - x)
            d = cg * e
        u = x + (d if abs(d) >= tol1 else (tol1 if d > 0 else -tol1))
        fu = f(u)
        if fu <= fx:
            if u >= x:
                a = x
            else:
                b = x
            v, w, x = w, x, u
            fv, fw, fx = fw, fx, fu
        else:
            if u < x:
                a = u
            else:
                b = u
            if fu <= fw or w == x:
                v, w, fv, fw = w, u, fw, fu
            elif fu <= fv or v == x or v == w:
                v, fv = u, fu
    return np.array([x]), fx


def blups(groups: DataFrame, theta, beta, q: int, p: int) -> DataFrame:
    """Conditional modes ``b_g = L A_g^-1 L' (Z'y - Z'X beta)`` (and ``|u_g|^2``) as a keyed DataFrame."""
    L = _lower(np.asarray(theta, dtype=float), q)
    gtype = groups.schema["g"].dataType
    schema = T.StructType([T.StructField("g", gtype)] + [T.StructField(f"b{j}", T.DoubleType()) for j in range(q)]
                          + [T.StructField("usq", T.DoubleType())])

    def kernel(it):
        for pdf in it:
            if pdf.empty:
                continue
            ZtZ, ZtX, Zty = _unpack(pdf, p, q)
            A = np.einsum("ji,gjk,kl->gil", L, ZtZ, L) + np.eye(q)
            rhs = np.einsum("ji,gj->gi", L, Zty - np.einsum("gqp,p->gq", ZtX, beta))
            u = np.linalg.solve(A, rhs[..., None])[..., 0]
            b = np.einsum("ij,gj->gi", L, u)
            out = {"g": pdf["g"]}
            for j in range(q):
                out[f"b{j}"] = b[:, j]
            out["usq"] = (u * u).sum(1)
            yield pd.DataFrame(out)

    return groups.mapInPandas(kernel, schema)


def _eta(X: list, beta: list, Z: list, bcols: list):
    eta = None
    for b, x in zip(beta, X):
        t = b * x
        eta = t if eta is None else eta + t
    for z, bc in zip(Z, bcols):
        eta = eta + F.coalesce(bc, F.lit(0.0)) * z
    return eta


def model_rows(df: DataFrame, X: list, Z: list, y, w, g: str) -> DataFrame:
    """The complete rows of a model: ``_g``, ``_x<i>``, ``_z<j>``, ``_y``, ``_w``."""
    return df.select(qcol(g).alias("_g"), *[x.alias(f"_x{i}") for i, x in enumerate(X)],
                     *[z.alias(f"_z{j}") for j, z in enumerate(Z)], y.cast("double").alias("_y"),
                     w.cast("double").alias("_w")).dropna()


def pirls(df: DataFrame, X: list, Z: list, y, w, g: str, theta, family: str, link: str, beta0,
          b_table: DataFrame | None = None, tol: float = 1e-7, iterations: int = 30):
    """Penalised IRLS at fixed ``theta`` over the rows of ``df``: see :func:`pirls_rows`."""
    return pirls_rows(model_rows(df, X, Z, y, w, g), len(X), len(Z), theta, family, link, beta0, b_table, tol, iterations)


def pirls_rows(base: DataFrame, p: int, q: int, theta, family: str, link: str, beta0,
               b_table: DataFrame | None = None, tol: float = 1e-7, iterations: int = 30):
    """Penalised IRLS at fixed ``theta`` (fixed effects updated inside, as in the fast Laplace fit) over :func:`model_rows`.

    Each iteration passes the rows once: it joins the current group modes (a
    table keyed by group), forms GLM working weights and responses per row, and
    writes one row of sums per group.  These are all that the rest of the
    iteration reads: their totals give the penalised deviance of the current
    iterate and the fixed effects, and each group's row its next modes.
    ``b_table``/``beta0`` warm-start the iteration.  Returns
    ``(laplace_deviance, beta, b_table)``.
    """
    from cardinal.operators.glm import deviance_resid, link_fns, variance
    from cardinal.functions.columns import ieee_div

    _, linv, mu_eta = link_fns(link)
    L = _lower(np.atleast_1d(np.asarray(theta, dtype=float)), q)
    xs = [F.col(f"_x{i}") for i in range(p)]
    zs = [F.col(f"_z{j}") for j in range(q)]
    beta = np.asarray(beta0, dtype=float)
    prev = np.inf
    logdet = 0.0
    dev = np.inf
    small = None
    norm = None
    moved = False
    if b_table is not None:  # warm start: modes given, penalty measured once
        norm = (np.zeros((p, p)), np.zeros(p), float(b_table.agg(F.sum("usq")).first()[0] or 0.0))
    for _ in range(iterations):
        if b_table is None:
            cur = base.select("*", *[F.lit(0.0).alias(f"b{j}") for j in range(q)], F.lit(0.0).alias("usq"))
        else:
            side = b_table.withColumnRenamed("g", "_bg")
            if small is None:  # one row per group: the bound holds for every iteration once measured
                side, small = broadcast_if_bounded(side)
            elif small:
                side = F.broadcast(side)
            cur = base.join(side, F.col("_g") == F.col("_bg"), "left")
        # the coefficients come as a row, not as literals (id is 0): every iteration runs the same compiled code
        fixed = base.sparkSession.range(1).select(*[(F.col("id") + float(b)).alias(f"_beta{i}") for i, b in enumerate(beta)])
        cur = cur.crossJoin(F.broadcast(fixed))
        st = cur.select("*", _eta(xs, [F.col(f"_beta{i}") for i in range(p)], zs, [F.col(f"b{j}") for j in range(q)]).alias("_eta"))
        st = st.select("*", linv(F.col("_eta")).alias("_mu"), mu_eta(F.col("_eta")).alias("_d"))
        st = st.select("*", variance(family, F.col("_mu")).alias("_v"))
        st = st.select(qcol("_g").alias("g"), *[x.alias(f"x{i}") for i, x in enumerate(xs)],
                       *[z.alias(f"z{j}") for j, z in enumerate(zs)],
                       ieee_div(F.col("_w") * F.col("_d") * F.col("_d"), F.col("_v")).alias("w"),
                       (F.col("_eta") + ieee_div(F.col("_y") - F.col("_mu"), F.col("_d"))).alias("y"),
                       (F.col("_w") * deviance_resid(family, F.col("_y"), F.col("_mu"))).alias("_dres"))
        W = F.col("w")
        gx = [F.col(f"x{i}") for i in range(p)]
        gz = [F.col(f"z{j}") for j in range(q)]
        gaggs = [F.sum(W * gz[a] * gz[b]).alias(f"zz{a}_{b}") for a in range(q) for b in range(a, q)]
        gaggs += [F.sum(W * gz[a] * gx[i]).alias(f"zx{a}_{i}") for a in range(q) for i in range(p)]
        gaggs += [F.sum(W * gz[a] * F.col("y")).alias(f"zy{a}") for a in range(q)]
        tot = {f"xx{i}_{j}": F.sum(W * gx[i] * gx[j]) for i in range(p) for j in range(i, p)}
        tot |= {f"xy{i}": F.sum(W * gx[i] * F.col("y")) for i in range(p)} | {"dev": F.sum("_dres")}
        # checkpointed: the next iteration starts from these rows, so the lineage stays short
        groups = reliable_checkpoint(st.groupBy("g").agg(*gaggs, *[c.alias(name) for name, c in tot.items()]))
        logdet_new, M, v, _c, Qn, rn, sn, r = _partials(groups, L, p, q, norms=True, totals=tuple(tot))
        # penalty |u|^2 of the current modes, from the last solve's sums (no pass over the modes)
        usq = 0.0 if norm is None else float(norm[2] - 2 * beta @ norm[1] + beta @ norm[0] @ beta)
        dev = float(r["dev"]) + usq
        if abs(prev - dev) <= tol * (abs(dev) + 0.1):
            break
        prev = dev
        XtX = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                XtX[i, j] = XtX[j, i] = r[f"xx{i}_{j}"]
        Xty = np.array([r[f"xy{i}"] for i in range(p)])
        beta = np.linalg.solve(XtX - M, Xty - v)
        logdet, norm, moved = logdet_new, (Qn, rn, sn), True
        b_table = blups(groups, L[np.tril_indices(q)], beta, q, p)  # read once, by the next pass or the end
    return dev + logdet, beta, reliable_checkpoint(b_table) if moved else b_table


@register_card("mixed_model", "Mixed model")
@dataclass(frozen=True)
class MixedModelCard(Card):
    target: str
    fixed: tuple
    random: tuple
    group: str
    weights: str | None = None
    partition: str | None = None
    suffix: str = "hat"
    distribution: str = "normal"
    link: str | None = None

    def __post_init__(self):
        from cardinal.operators.glm import CANONICAL, LINKS

        if self.distribution not in CANONICAL or (self.link is not None and self.link not in LINKS):
            raise ValueError("unknown distribution or link")
        object.__setattr__(self, "fixed", tuple(tuple(t) if isinstance(t, list) else t for t in self.fixed))
        object.__setattr__(self, "random", tuple(tuple(t) if isinstance(t, list) else t for t in self.random))
        if not self.target or not self.random or not self.group:
            raise ValueError("mixed model needs a target, random terms and one grouping factor")

    @classmethod
    def from_config(cls, d):
        check_fields(cls, d)
        return cls(**d)

    @property
    def output(self):
        return join_names(self.target, self.suffix)

    def source_variables(self):
        ins = formula_variables(self.fixed) + formula_variables(self.random) + [self.group]
        return SourceVariables(inputs=list(dict.fromkeys(ins)), targets=[self.target],
                               weights=[self.weights] if self.weights else [],
                               partition=[self.partition] if self.partition else [])

    def output_variables(self):
        return OutputVariables([self.output])

    def fit(self, df, id_var=None):
        train = training_rows(df, self.partition)
        need = formula_variables(self.fixed) + formula_variables(self.random) + [self.group, self.target]
        train = train.dropna(subset=list(dict.fromkeys(need + ([self.weights] if self.weights else []))))
        _, xspec = design(train, list(self.fixed))
        _, zspec = design(train, list(self.random))
        X, Z = design_columns(xspec), design_columns(zspec)
        w = qcol(self.weights) if self.weights else F.lit(1.0)
        if self.link_name != "identity" or self.distribution != "normal":
            return self._fit_glmm(train, X, Z, w, xspec, zspec)
        groups, glob = group_statistics(train, X, Z, qcol(self.target), w, self.group)
        groups = groups.persist(StorageLevel.MEMORY_AND_DISK)
        p, q = len(X), len(Z)
        try:
            f = lambda th: profiled_deviance(groups, glob, th, p, q)[0]
            if q == 1:
                theta, dev = search_theta(f, 5.0, tol=1e-5)
            else:
                lower = np.full(q * (q + 1) // 2, -np.inf)
                lower[[i * (i + 1) // 2 + i for i in range(q)]] = 0.0  # diagonal of L is non-negative
                x0 = np.zeros(q * (q + 1) // 2)
                x0[[i * (i + 1) // 2 + i for i in range(q)]] = 1.0
                theta, dev = nelder_mead(f, x0, lower=lower)
            dev, beta, r2 = profiled_deviance(groups, glob, theta, p, q)
            table = reliable_checkpoint(blups(groups, theta, beta, q, p))
        finally:
            groups.unpersist()
        sigma2 = r2 / glob["n"]
        return CardState(content={"beta": beta.tolist(), "theta": np.asarray(theta).tolist(), "sigma2": sigma2,
                                  "deviance": dev, "fixed": xspec, "random": zspec},
                         tables={"blups": table})

    @property
    def link_name(self) -> str:
        from cardinal.operators.glm import CANONICAL

        return self.link or CANONICAL[self.distribution]

    def _fit_glmm(self, train, X, Z, w, xspec, zspec) -> CardState:
        """Laplace fit: PIRLS at each theta, theta by golden section / Nelder-Mead."""
        p, q = len(X), len(Z)
        base = model_rows(train, X, Z, qcol(self.target), w, self.group)
        cores = base.sparkSession.sparkContext.defaultParallelism
        if base.rdd.getNumPartitions() < cores:  # a file of one split: every iteration would run in one task
            base = base.repartition(cores)
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._search_glmm(train, base, p, q, X, w, xspec, zspec)
        finally:
            base.unpersist()

    def _search_glmm(self, train, base, p, q, X, w, xspec, zspec) -> CardState:
        from cardinal.operators.glm import irls

        glm_fit = irls(train, X, qcol(self.target), w, self.distribution, self.link_name)
        start = glm_fit["coef"]
        cache: dict = {}
        warm = {"beta": start, "b": None}

        def f(th):
            th = np.atleast_1d(np.asarray(th, dtype=float))
            key = tuple(np.round(th, 10))
            if key not in cache:
                dev, beta, table = pirls_rows(base, p, q, th, self.distribution, self.link_name, warm["beta"], warm["b"])
                cache[key] = (dev, beta, table)
                warm["beta"], warm["b"] = beta, table  # warm start for the next theta
            return cache[key][0]

        if q == 1:
            # At theta = 0 the Laplace deviance is the plain GLM deviance (already known).  The
            # one-dimensional search assumes a unimodal profile, so when a small theta does not
            # improve on it the optimum is the boundary.
            delta = 0.01
            if f(delta) >= glm_fit["deviance"]:
                zeros = train.select(qcol(self.group).alias("g")).where(F.col("g").isNotNull()).distinct()
                table = reliable_checkpoint(zeros.select("g", *[F.lit(0.0).alias(f"b{j}") for j in range(q)]))
                return CardState(content={"beta": list(start), "theta": [0.0], "sigma2": None,
                                          "deviance": glm_fit["deviance"], "fixed": xspec, "random": zspec},
                                 tables={"blups": table})
            theta, _ = search_theta(f, 2.0, tol=1e-2)
        else:
            lower = np.full(q * (q + 1) // 2, -np.inf)
            lower[[i * (i + 1) // 2 + i for i in range(q)]] = 0.0
            x0 = np.zeros(q * (q + 1) // 2)
            x0[[i * (i + 1) // 2 + i for i in range(q)]] = 1.0
            theta, _ = nelder_mead(f, x0, tol=1e-5, lower=lower)
        theta = np.atleast_1d(np.asarray(theta, dtype=float))
        f(theta)
        dev, beta, table = cache[tuple(np.round(theta, 10))]
        return CardState(content={"beta": np.asarray(beta).tolist(), "theta": np.asarray(theta).tolist(),
                                  "sigma2": None, "deviance": dev, "fixed": xspec, "random": zspec},
                         tables={"blups": table.drop("usq")})

    def transform(self, df, state, id_var=None):
        xspec, zspec = state.content["fixed"], state.content["random"]
        X, Z = design_columns(xspec), design_columns(zspec)
        beta = state.content["beta"]
        fixed = None
        for b, x in zip(beta, X):
            t = F.lit(float(b)) * x
            fixed = t if fixed is None else fixed + t
        bl = state.tables["blups"].withColumnRenamed("g", "_mm_g")
        side, _ = broadcast_if_bounded(bl)
        joined = df.join(side, qcol(self.group) == F.col("_mm_g"), "left")
        rand = None
        for j, z in enumerate(Z):
            t = F.col(f"b{j}") * z
            rand = t if rand is None else rand + t
        from cardinal.operators.glm import link_fns

        linv = link_fns(self.link_name)[1]
        pred = F.when(F.col("_mm_g").isNotNull(), linv(fixed + rand))  # unseen group level: NULL
        keep = [qcol(c) for c in df.columns if c != self.output]
        return joined.select(*keep, pred.cast("double").alias(self.output))

    def report(self, state):
        return {k: state.content[k] for k in ("beta", "theta", "sigma2", "deviance")}
