"""Lagged network estimation from moments.

Solvers see weighted Gram matrices of u = (1, z, y) only, (2p + 1)-square with p the variables of one profile. Where a
fit needs a few of them, `mapInPandas` makes them from each batch of lag rows, which is a map-side combine, and they are
summed per profile. Cross validation and the bootstrap need hundreds, more than a profile has lag rows; there the rows
travel once, packed per profile (and block of draws), and the matrices live and die inside the grouped call.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lagweave.core.session import cut_lineage, spread
from lagweave.operators.series import SERIES, assign_nearest_point, interpolate, lag_pairs, t_norm

# Estimation points, folds, grids, bootstrap size, ridge of the residual precision.
POINTS, CV_POINTS, FOLDS, RIDGE = 20, 12, 5, 1e-3
BANDWIDTHS = [0.03, 0.05, 0.08, 0.11, 0.15, 0.20, 0.28, 0.36]
ALPHAS = [10 ** (-2.0 + 2.2 * i / 17) for i in range(18)]
DRAWS, BLOCK, CI_LOW, CI_HIGH = 80, 20, 0.05, 0.95
DRAW_BLOCKS = 2

MOMENTS = "profile_id string, codes array<string>, n_obs int, kind string, fold int, bw int, point int, gram array<double>, w2 double"


def lag_rows(obs: DataFrame) -> DataFrame:
    """One row per (profile, slot) with the vectors now (y) and one slot before (z). `obs` has no nulls. Slots that lack
    one of the profile's variables pair with nothing, so positions always mean the same variable."""
    packed = F.array_sort(F.collect_list(F.struct("code", "value")))
    vecs = t_norm(obs).groupBy("profile_id", "t_index", "t_norm").agg(packed.alias("v"))
    w = W.partitionBy("profile_id").orderBy("t_index")
    full = obs.groupBy("profile_id").agg(F.count_distinct("code").alias("n_codes"))
    rows = vecs.withColumn("before", F.lag("v").over(w)).join(full, "profile_id").where((F.size("v") == F.col("n_codes")) & (F.size("before") == F.col("n_codes")))
    return rows.select(
        "profile_id", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(W.partitionBy("profile_id")).cast("int").alias("n_obs"),
        F.col("t_norm").alias("t"), F.transform("v", lambda s: s["code"]).alias("codes"), F.transform("v", lambda s: s["value"]).alias("y"), F.transform("before", lambda s: s["value"]).alias("z"))


def _kernel(t: np.ndarray, te: float, bw: float) -> np.ndarray:
    z = (t - te) / max(bw, 1e-9)
    return np.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * max(bw, 1e-9))


def _folds(n: int, k: int = FOLDS) -> list[tuple[int, int]]:
    """(train end, validation end) of forward-chaining splits."""
    size = n // (k + 1)
    return [(n - (k - f) * size, n - (k - f - 1) * size) for f in range(k)] if size else []


def _points(m: int) -> np.ndarray:
    return np.linspace(0.0, 1.0, m)


def _nearest(t: np.ndarray, m: int) -> np.ndarray:
    return np.clip(np.ceil(t * (m - 1) - 0.5).astype(int), 0, m - 1)


def _multiplicity(profile: str, draw: int, n: int, block: int) -> np.ndarray:
    """How often each row occurs in a moving-block resample; a function of profile and draw only."""
    rng = np.random.default_rng([zlib.crc32(profile.encode()), draw])
    starts = rng.integers(0, max(1, n - block + 1), size=math.ceil(n / block))
    picked = np.concatenate([np.arange(s, s + block) for s in starts])[:n]
    return np.bincount(picked, minlength=n)[:n]


def _weights(kinds: tuple[str, ...], i: np.ndarray, t: np.ndarray, n: int, bandwidth: float):
    """Yield (kind, fold, bandwidth index, point, weights) for the asked kinds."""
    if "full" in kinds:
        yield "full", -1, -1, -1, np.ones_like(t)
    if "point" in kinds:
        for p, te in enumerate(_points(POINTS)):
            yield "point", -1, -1, p, _kernel(t, te, bandwidth)
    if "static_cv" in kinds:
        for f, (tr, va) in enumerate(_folds(n)):
            yield "train", f, -1, -1, (i < tr).astype(float)
            yield "val", f, -1, -1, ((i >= tr) & (i < va)).astype(float)


def moments(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Partial weighted Gram matrices of u = (1, z, y). Kind point reads a `bandwidth` column."""
    timed = rows if "bandwidth" in rows.columns else rows.withColumn("bandwidth", F.lit(0.0))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for profile, g in pdf.groupby("profile_id", sort=False):
                z, y = np.stack(g["z"].to_list()).astype(float), np.stack(g["y"].to_list()).astype(float)
                u = np.hstack([np.ones((len(g), 1)), z, y])
                outer = (u[:, :, None] * u[:, None, :]).reshape(len(g), -1)
                i, t, n = g["i"].to_numpy(), g["t"].to_numpy(), int(g["n_obs"].iloc[0])
                tags = list(_weights(kinds, i, t, n, float(g["bandwidth"].iloc[0])))
                w = np.stack([x[4] for x in tags])
                grams, w2, codes = w @ outer, (w * w).sum(axis=1), g["codes"].iloc[0]
                out += [(profile, codes, n, *x[:4], grams[j], w2[j]) for j, x in enumerate(tags)]
            if out:
                yield pd.DataFrame(out, columns=["profile_id", "codes", "n_obs", "kind", "fold", "bw", "point", "gram", "w2"])

    return timed.select("profile_id", "i", "n_obs", "t", "codes", "y", "z", "bandwidth").mapInPandas(partial, MOMENTS)


def _packed(pdf: pd.DataFrame) -> tuple:
    """All lag rows of one profile in the order of time: outer products of u, row numbers, times, codes."""
    pdf = pdf.sort_values("i")
    z, y = np.stack(pdf["z"].to_list()).astype(float), np.stack(pdf["y"].to_list()).astype(float)
    u = np.hstack([np.ones((len(pdf), 1)), z, y])
    return (u[:, :, None] * u[:, None, :]).reshape(len(pdf), -1), pdf["i"].to_numpy(), pdf["t"].to_numpy(), list(pdf["codes"].iloc[0])


def _grams(outer: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    q = int(math.isqrt(outer.shape[1]))
    return (np.stack(weights) @ outer).reshape(len(weights), q, q)


def _sum_partials(pdf: pd.DataFrame) -> dict[tuple, tuple[np.ndarray, float]]:
    q = 2 * len(pdf["codes"].iloc[0]) + 1
    out: dict[tuple, tuple[np.ndarray, float]] = {}
    for kind, fold, bw, point, gram, w2 in zip(pdf["kind"], pdf["fold"], pdf["bw"], pdf["point"], pdf["gram"], pdf["w2"]):
        g, s = out.get((kind, fold, bw, point), (0.0, 0.0))
        out[(kind, fold, bw, point)] = (g + np.asarray(gram).reshape(q, q), s + w2)
    return out


def lasso(gram: np.ndarray, alpha: np.ndarray, tol: float = 1e-10, rounds: int = 5000, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """L1 fits of every y on z for a stack of Grams: minimize weighted mean of squares / 2 + alpha |b|, free intercept.

    gram (k, 2p+1, 2p+1), alpha (k, p) -> coefficients (k, p dst, p src), intercepts (k, p). Grams of one `group` (all, if
    not given) stop together, as they would in a call of their own.
    """
    k, q, _ = gram.shape
    p = (q - 1) // 2
    w = np.maximum(gram[:, 0, 0], 1e-300)[:, None, None]
    mean = gram[:, 0, 1:] / w[:, :, 0]
    cov = gram[:, 1:, 1:] / w - mean[:, :, None] * mean[:, None, :]
    Q, R = cov[:, :p, :p], np.swapaxes(cov[:, :p, p:], 1, 2)  # R (k, dst, src)
    diag = np.maximum(np.einsum("kii->ki", Q), 1e-12)
    b = np.zeros((k, p, p))
    group = np.zeros(k, int) if group is None else group
    todo, now, alpha = np.arange(k), b.copy(), np.broadcast_to(alpha, (k, p))
    for _ in range(rounds):
        worst = np.zeros(len(todo))
        for j in range(p):
            rho = R[:, :, j] - np.einsum("kds,ks->kd", now, Q[:, :, j]) + now[:, :, j] * diag[:, None, j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - alpha, 0.0) / diag[:, None, j]
            worst = np.maximum(worst, np.abs(new - now[:, :, j]).max(axis=1))
            now[:, :, j] = new
        by_group = np.zeros(group.max() + 1)
        np.maximum.at(by_group, group[todo], worst)
        stay = by_group[group[todo]] >= tol
        if not stay.all():
            b[todo] = now
            todo, now, Q, R, diag, alpha = todo[stay], now[stay], Q[stay], R[stay], diag[stay], alpha[stay]
            if not len(todo):
                break
    b[todo] = now
    return b, mean[:, p:] - np.einsum("kds,ks->kd", b, mean[:, :p])


def _standardize(gram: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Gram of (1, (z - mu)/sd, (y - mu)/sd) from that of (1, z, y)."""
    p = len(mu)
    T = np.eye(2 * p + 1)
    for off in (1, 1 + p):
        T[off:off + p, off:off + p] = np.diag(1 / sd)
        T[off:off + p, 0] = -mu / sd
    return T @ gram @ T.T


def _fold_scale(parts: dict, fold: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sd of the training values: all z of the training rows and the y of the last one."""
    tr, last = parts[("train", fold, -1, -1)][0], parts[("last", fold, -1, -1)][0]
    n = tr[0, 0] + last[0, 0]
    s = tr[0, 1:1 + p] + last[0, 1 + p:]
    s2 = np.diag(tr)[1:1 + p] + np.diag(last)[1 + p:]
    mu = s / n
    sd = np.sqrt(np.maximum(s2 / n - mu * mu, 0.0))
    return mu, np.where(sd < 1e-12, 1.0, sd)


def _errors(gram: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sum of squared errors per target as a quadratic form in the moments."""
    p = len(c)
    v = np.hstack([-c[:, None], -b, np.eye(p)])
    return np.einsum("di,ij,dj->d", v, gram, v)


def select_tv_params(rows: DataFrame, bandwidths: list[float] = BANDWIDTHS, alphas: list[float] = ALPHAS) -> DataFrame:
    """Bandwidth, then alpha, by forward-chaining CV with train-only scaling and the nearest point's model. Only the lag
    rows are shuffled, once."""
    mid = float(np.median(alphas))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        outer, i, t, codes = _packed(pdf)
        p = len(codes)
        near, points = _nearest(t, CV_POINTS), _points(CV_POINTS)
        cuts = _folds(int(pdf["n_obs"].iloc[0]))
        folds = []
        for tr, va in cuts:
            train, val = (i < tr).astype(float), ((i >= tr) & (i < va)).astype(float)
            ends = _grams(outer, [train, (i == tr - 1).astype(float)])
            scale = _fold_scale({("train", 0, -1, -1): (ends[0], 0.0), ("last", 0, -1, -1): (ends[1], 0.0)}, 0, p)
            checked = [_standardize(g, *scale) for g in _grams(outer, [val * (near == q) for q in range(CV_POINTS)])]
            folds.append((train, scale, checked))

        def errors(tried: list[tuple[float, float]]) -> list[float]:
            """Mean squared error of each (bandwidth, alpha); the models of all of them and all folds are fitted in one call."""
            if not folds:
                return [float("inf")] * len(tried)
            kernels = {bw: [_kernel(t, te, bw) for te in points] for bw in {bw for bw, _ in tried}}
            made = {bw: [np.stack([_standardize(g, *scale) for g in _grams(outer, [train * w for w in ws])]) for train, scale, _ in folds] for bw, ws in kernels.items()}
            n = len(tried) * len(folds)
            b, c = lasso(np.concatenate([g for bw, _ in tried for g in made[bw]]), np.repeat([[a] * p for _, a in tried], len(folds) * CV_POINTS, 0), tol=1e-8, group=np.repeat(np.arange(n), CV_POINTS))
            b, c = b.reshape(len(tried), len(folds), CV_POINTS, p, p), c.reshape(len(tried), len(folds), CV_POINTS, p)
            out = []
            for k in range(len(tried)):
                out.append(float(np.mean([sum(_errors(g, b[k, f, q], c[k, f, q]).sum() for q, g in enumerate(checked)) / max(sum(g[0, 0] for g in checked) * p, 1)
                                          for f, (_, _, checked) in enumerate(folds)])))
            return out

        by_bw = errors([(bw, mid) for bw in bandwidths])
        best_bw = int(np.argmin(by_bw))
        by_alpha = errors([(bandwidths[best_bw], a) for a in alphas])
        best_a = int(np.argmin(by_alpha))
        return pd.DataFrame([{"profile_id": pdf["profile_id"].iloc[0], "bandwidth": bandwidths[best_bw], "alpha": alphas[best_a],
                              "mse_bandwidth": by_bw[best_bw], "mse_alpha": by_alpha[best_a]}])

    return spread(rows.select("profile_id", "i", "n_obs", "t", "codes", "y", "z"), "profile_id").groupBy("profile_id").applyInPandas(
        solve, "profile_id string, bandwidth double, alpha double, mse_bandwidth double, mse_alpha double")


COEFS = ("profile_id string, time_index int, t double, dst string, src string, beta double, intercept double, r2 double, alpha double, "
         "pcorr double, mse_point double, ess double")


def _coef_rows(profile, codes, index, t, b, c, r2, alpha, pc, mse, ess) -> list[tuple]:
    return [(profile, index, t, d, s, float(b[i, j]), float(c[i]), float(r2[i]), float(alpha[i]), None if pc is None else float(pc[i, j]), float(mse), float(ess))
            for i, d in enumerate(codes) for j, s in enumerate(codes)]


def partial_from_cov(cov: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    theta = np.linalg.inv(cov + ridge * np.eye(len(cov)))
    d = np.sqrt(np.clip(np.diag(theta), 1e-12, None))
    pc = -theta / np.outer(d, d)
    np.fill_diagonal(pc, 1.0)
    return pc


def _fit_quality(gram: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """R2 per target, mean squared error, residual covariance."""
    p, w = len(c), gram[0, 0]
    sse = _errors(gram, b, c)
    sst = np.diag(gram)[1 + p:] - gram[0, 1 + p:] ** 2 / w
    v = np.hstack([-c[:, None], -b, np.eye(p)])
    mean = v @ gram[:, 0] / w
    return 1 - sse / (sst + 1e-12), float(sse.sum() / (w * p)), v @ gram @ v.T / w - np.outer(mean, mean)


def fit_tv_var(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Kernel-weighted L1 VAR(1) at POINTS times. params(profile_id, bandwidth, alpha)."""
    timed = rows.join(params.select("profile_id", "bandwidth"), "profile_id")

    def solve(key: tuple, mom: pd.DataFrame, par: pd.DataFrame) -> pd.DataFrame:
        cols = [x.split()[0] for x in COEFS.split(", ")]
        if mom.empty or par.empty:
            return pd.DataFrame(columns=cols)
        parts, codes = _sum_partials(mom), list(mom["codes"].iloc[0])
        p, alpha = len(codes), float(par["alpha"].iloc[0])
        grams = np.stack([parts[("point", -1, -1, q)][0] for q in range(POINTS)])
        b, c = lasso(grams, np.full((POINTS, p), alpha))
        out = []
        for q, te in enumerate(_points(POINTS)):
            r2, mse, cov = _fit_quality(grams[q], b[q], c[q])
            ess = grams[q][0, 0] ** 2 / (parts[("point", -1, -1, q)][1] + 1e-12)
            out += _coef_rows(key[0], codes, q, float(te), b[q], c[q], r2, np.full(p, alpha), partial_from_cov(cov), mse, ess)
        return pd.DataFrame(out, columns=cols)

    return moments(timed, ("point",)).groupBy("profile_id").cogroup(params.groupBy("profile_id")).applyInPandas(solve, COEFS)


def fit_static_var(rows: DataFrame, alphas: list[float] = ALPHAS) -> DataFrame:
    """L1 VAR(1) per target; alpha per target by forward-chaining CV. Residual precision by ridge on the moments."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, codes = _sum_partials(pdf), list(pdf["codes"].iloc[0])
        p = len(codes)
        folds = sorted({k[1] for k in parts if k[0] == "train"})
        mses = np.zeros((len(alphas), p))
        for f in folds:
            train, val = parts[("train", f, -1, -1)][0], parts[("val", f, -1, -1)][0]
            b, c = lasso(np.repeat(train[None], len(alphas), 0), np.repeat(np.asarray(alphas)[:, None], p, 1))
            mses += np.stack([_errors(val, b[a], c[a]) / max(val[0, 0], 1) for a in range(len(alphas))])
        best = np.asarray(alphas)[np.argmin(mses, axis=0)] if folds else np.full(p, alphas[0])
        full = parts[("full", -1, -1, -1)][0]
        b, c = lasso(full[None], best[None])
        r2, mse, cov = _fit_quality(full, b[0], c[0])
        return pd.DataFrame(_coef_rows(pdf["profile_id"].iloc[0], codes, 0, 1.0, b[0], c[0], r2, best, partial_from_cov(cov), mse, full[0, 0]),
                            columns=[x.split()[0] for x in COEFS.split(", ")])

    return moments(rows, ("full", "static_cv")).groupBy("profile_id").applyInPandas(solve, COEFS)


def bootstrap_ci(rows: DataFrame, params: DataFrame, draws: int = DRAWS, block: int = BLOCK) -> DataFrame:
    """Moving-block bootstrap interval of every coefficient. A profile's lag rows go to DRAW_BLOCKS groups, each of which
    makes and solves its share of the draws; what leaves them are coefficients."""
    share = math.ceil(draws / DRAW_BLOCKS)
    dealt = rows.select("profile_id", "i", "n_obs", "t", "codes", "y", "z").join(params.select("profile_id", "bandwidth", "alpha"), "profile_id").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(DRAW_BLOCKS - 1))))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        profile, part = key
        outer, i, t, codes = _packed(pdf)
        n, bandwidth, alpha = int(pdf["n_obs"].iloc[0]), float(pdf["bandwidth"].iloc[0]), float(pdf["alpha"].iloc[0])
        kernels, grams = [_kernel(t, te, bandwidth) for te in _points(POINTS)], []
        for draw in range(part * share, min(draws, (part + 1) * share)):
            picked = _multiplicity(profile, draw, n, block)[i]
            grams.append(_grams(outer, [picked * w for w in kernels]))
        if not grams:
            return pd.DataFrame(columns=["profile_id", "time_index", "dst", "src", "b"])
        b, _ = lasso(np.concatenate(grams), np.full((len(grams) * POINTS, len(codes)), alpha), group=np.repeat(np.arange(len(grams)), POINTS))
        # One row for each coefficient, with its values in all draws of the group.
        stack = b.reshape(len(grams), POINTS, len(codes), len(codes))
        return pd.DataFrame([(profile, q, d, s, stack[:, q, k, j]) for q in range(POINTS) for k, d in enumerate(codes) for j, s in enumerate(codes)],
                            columns=["profile_id", "time_index", "dst", "src", "b"])

    drawn = spread(dealt, "profile_id", "part").groupBy("profile_id", "part").applyInPandas(solve, "profile_id string, time_index int, dst string, src string, b array<double>")
    return drawn.select("profile_id", "time_index", "dst", "src", F.explode("b").alias("b")).groupBy("profile_id", "time_index", "dst", "src").agg(
        F.percentile("b", CI_LOW).alias("ci_low"), F.percentile("b", CI_HIGH).alias("ci_high"), F.count(F.lit(1)).alias("n_draws"))


def _fill_gaps(slot: np.ndarray, code: np.ndarray, x: np.ndarray, gap: np.ndarray, rounds: int, ridge: float, rho: float) -> np.ndarray:
    """The fill of one profile. Rows are sorted by slot, code and value; `code` numbers the codes from 0, -1 is no code.
    Lag pairs are rows of neighbouring slots that hold as many values as the profile has codes; the fitted value of a gap
    is taken from the slot just before it."""
    p = int(code.max(initial=-1)) + 1
    slots, first, size = np.unique(slot, return_index=True, return_counts=True)
    now = np.nonzero((size[1:] == p) & (size[:-1] == p))[0] + 1
    if not p or not len(now):
        return x
    at = np.repeat(np.arange(len(slots)), size)
    cells = np.arange(p)
    names = code[first[now[0]] + cells]
    coded, known = code >= 0, np.isin(code, names)
    place = np.zeros(p, int)
    place[names] = cells
    before = np.searchsorted(slots, slot - 1)
    before[(before >= len(slots)) | (slots[np.minimum(before, len(slots) - 1)] != slot - 1)] = -1
    held = np.zeros(len(slots) + 1, bool)
    held[at[known]] = True
    asked = gap & known & (before >= 0) & held[before]
    for _ in range(rounds):
        z, y = x[first[now - 1][:, None] + cells], x[first[now][:, None] + cells]
        a = (np.linalg.inv(z.T @ z + (ridge + 1e-10) * np.eye(p)) @ (z.T @ y)).T
        radius = float(np.max(np.abs(np.linalg.eigvals(a))))
        a = a if radius <= rho or radius == 0 else a * (rho / radius)
        sums = np.zeros((len(slots), p))
        np.add.at(sums, (at[coded & known], place[code[coded & known]]), x[coded & known])
        x = x.copy()
        x[asked] = np.einsum("rs,rs->r", a[place[code[asked]]], sums[before[asked]])
    return x


def var_fill(obs: DataFrame, rounds: int = 3, ridge: float = 1.0, rho: float = 0.98) -> DataFrame:
    """Fill gaps by a ridge VAR(1): interpolate, then `rounds` times fit on centred moments and replace the missing
    cells by the fitted value; the transition matrix is scaled to spectral radius <= rho. All rounds of a profile, which
    is bounded by the calendar, run in one grouped call, so its rows are shuffled once."""
    mean = F.avg("value").over(W.partitionBy(*SERIES))
    base = obs.withColumn("mu", F.coalesce(mean, F.lit(0.0)))
    filled = interpolate(base).select(*SERIES, "t_index", "mu", F.col("value").isNull().alias("gap"), (F.coalesce("filled", F.lit(0.0)) - F.col("mu")).alias("x"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        # Rows without a profile take part in no fit.
        if pdf["profile_id"].iloc[0] is not None:
            names, code = np.unique(pdf["code"].dropna().to_numpy(str), return_inverse=True)
            number = np.full(len(pdf), -1)
            number[pdf["code"].notna().to_numpy()] = code
            slot, x = pdf["t_index"].to_numpy(), pdf["x"].to_numpy()
            order = np.lexsort((x, number, slot))
            out = np.empty(len(pdf))
            out[order] = _fill_gaps(slot[order], number[order], x[order], pdf["gap"].to_numpy()[order], rounds, ridge, rho)
            pdf = pdf.assign(x=out)
        return pdf.assign(filled=pdf["x"] + pdf["mu"])[[*SERIES, "t_index", "gap", "filled"]]

    kinds = ", ".join(f"{c} {filled.schema[c].dataType.simpleString()}" for c in (*SERIES, "t_index", "gap"))
    return cut_lineage(filled.groupBy("profile_id").applyInPandas(solve, f"{kinds}, filled double"))


def residual_moments(errors: DataFrame) -> DataFrame:
    """errors(profile_id, t_index, code, e): centred covariances per pair, trace and the shrinkage intensity of
    Ledoit and Wolf, all by aggregates."""
    e = errors.withColumn("e", F.col("e") - F.avg("e").over(W.partitionBy("profile_id", "code")))
    a = e.select("profile_id", "t_index", F.col("code").alias("a"), F.col("e").alias("x"))
    b = e.select("profile_id", "t_index", F.col("code").alias("b"), F.col("e").alias("y"))
    n = F.count(F.lit(1))
    cov = a.join(b, ["profile_id", "t_index"]).groupBy("profile_id", "a", "b").agg((F.sum(F.col("x") * F.col("y")) / n).alias("cov"), n.alias("n"))
    fourth = e.groupBy("profile_id", "t_index").agg(F.sum(F.col("e") * F.col("e")).alias("q")).groupBy("profile_id").agg(F.sum(F.col("q") * F.col("q")).alias("q2"))
    tot = cov.groupBy("profile_id").agg(F.sum(F.col("cov") * F.col("cov")).alias("s2"), F.sum(F.when(F.col("a") == F.col("b"), F.col("cov"))).alias("tr"),
                                        F.sum((F.col("a") == F.col("b")).cast("int")).alias("p"), F.max("n").alias("n_rows")).join(fourth, "profile_id")
    mu = F.col("tr") / F.col("p")
    beta = (F.col("q2") / F.col("n_rows") - F.col("s2")) / (F.col("p") * F.col("n_rows"))
    delta = (F.col("s2") - 2 * mu * F.col("tr") + F.col("p") * mu * mu) / F.col("p")
    shrink = F.when(delta <= 0, 0.0).otherwise(F.least(beta, delta) / delta)
    return cov.join(tot.select("profile_id", mu.alias("mu"), shrink.alias("shrinkage")), "profile_id")


def partial_correlation(moment_table: DataFrame) -> DataFrame:
    """Shrunk covariance -> precision -> partial correlation, one p x p inverse per profile."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = sorted(set(pdf["a"]))
        at = {c: i for i, c in enumerate(codes)}
        s = np.zeros((len(codes), len(codes)))
        s[pdf["a"].map(at), pdf["b"].map(at)] = pdf["cov"]
        k = float(pdf["shrinkage"].iloc[0])
        pc = partial_from_cov((1 - k) * s + k * float(pdf["mu"].iloc[0]) * np.eye(len(codes)))
        return pd.DataFrame([(pdf["profile_id"].iloc[0], x, y, float(pc[i, j])) for i, x in enumerate(codes) for j, y in enumerate(codes) if x < y], columns=["profile_id", "a", "b", "pcorr"])

    return moment_table.groupBy("profile_id").applyInPandas(solve, "profile_id string, a string, b string, pcorr double")


def correlation_baselines(obs: DataFrame) -> DataFrame:
    """Pearson, Spearman and shrunk partial correlation of every pair; `obs` has no nulls."""
    from lagweave.operators.describe import correlation_matrix

    pear = correlation_matrix(obs, "pearson").select("profile_id", "a", "b", F.col("r").alias("pearson"))
    spear = correlation_matrix(obs, "spearman").select("profile_id", "a", "b", F.col("r").alias("spearman"))
    part = partial_correlation(residual_moments(obs.select("profile_id", "t_index", "code", F.col("value").alias("e"))))
    return pear.join(spear, ["profile_id", "a", "b"]).join(part, ["profile_id", "a", "b"])


def lag_terms(obs: DataFrame, coefs: DataFrame, m: int) -> DataFrame:
    """Lag pairs with the coefficient of the nearest estimation point: (profile, t_index, dst, y, src, term, intercept)."""
    times = t_norm(obs).select("profile_id", "t_index", "t_norm").distinct()
    near = assign_nearest_point(times, F.col("t_norm"), m).drop("t_norm")
    pairs = lag_pairs(obs, 1).join(near, ["profile_id", "t_index"])
    c = coefs.select("profile_id", "time_index", "dst", "src", "beta", "intercept")
    return pairs.join(c, ["profile_id", "time_index", "dst", "src"]).withColumn("term", F.col("beta") * F.col("z"))


def predict_one_step(obs: DataFrame, coefs: DataFrame, m: int) -> DataFrame:
    return lag_terms(obs, coefs, m).groupBy("profile_id", "t_index", "dst").agg(
        F.max("y").alias("y"), (F.sum("term") + F.max("intercept")).alias("y_hat"))


def prediction_quality(predicted: DataFrame) -> DataFrame:
    err = F.col("y") - F.col("y_hat")
    return predicted.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"), (1 - F.sum(err * err) / (F.regr_sxx("y", "y") + 1e-12)).alias("r2"))


def loo_importance(obs: DataFrame, coefs: DataFrame, m: int, criteria: str = "C") -> DataFrame:
    """Increase of the squared error when one predictor's term is taken out, over all targets and over criteria."""
    terms = lag_terms(obs, coefs, m)
    full = terms.groupBy("profile_id", "t_index", "dst").agg((F.max("y") - F.sum("term") - F.max("intercept")).alias("err"))
    each = terms.select("profile_id", "t_index", "dst", "src", "term").join(full, ["profile_id", "t_index", "dst"])
    gain = F.pow(F.col("err") + F.col("term"), 2) - F.col("err") * F.col("err")
    return each.groupBy("profile_id", F.col("src").alias("predictor")).agg(
        F.avg(gain).alias("delta_mse_all"), F.avg(F.when(F.col("dst").startswith(criteria), gain)).alias("delta_mse_criteria"))


def coef_importance(coefs: DataFrame, criteria: str = "C") -> DataFrame:
    ab, crit = F.abs("beta"), F.col("dst").startswith(criteria)
    per = coefs.groupBy("profile_id", "time_index", "src").agg(
        F.sum(ab).alias("all_"), F.sum(F.when(crit, ab).otherwise(0.0)).alias("crit"), F.sum("beta").alias("signed"), F.avg((ab > 1e-12).cast("double")).alias("nz"))
    return per.groupBy("profile_id", F.col("src").alias("predictor")).agg(
        F.avg("all_").alias("out_strength_all_mean"), F.stddev_pop("all_").alias("out_strength_all_sd"), F.avg("crit").alias("out_strength_criteria_mean"),
        F.stddev_pop("crit").alias("out_strength_criteria_sd"), F.avg("signed").alias("signed_out_all_mean"), F.avg("nz").alias("nonzero_fraction_mean"))


def criterion_dependence(coefs: DataFrame, predictors: str = "P", criteria: str = "C") -> DataFrame:
    kept = coefs.where(F.col("dst").startswith(criteria) & F.col("src").startswith(predictors))
    per = kept.groupBy("profile_id", "time_index", "dst").agg(F.sum(F.abs("beta")).alias("s"))
    return per.groupBy("profile_id", F.col("dst").alias("criterion")).agg(
        F.avg("s").alias("incoming_mean"), F.stddev_pop("s").alias("incoming_sd"), F.max("s").alias("incoming_max"))


def collinearity(correlations: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """correlations(profile_id, a, b, n, r), a < b, on complete rows: mean and largest |r|, pairs at .80 and .90,
    condition number, eigenvalues and the largest ridge VIF per profile."""
    counts = correlations.groupBy("profile_id").agg(
        F.avg(F.abs("r")).alias("avg_abs_corr"), F.max(F.abs("r")).alias("max_abs_corr"), F.count_if(F.abs("r") >= 0.8).alias("n_high_80"), F.count_if(F.abs("r") >= 0.9).alias("n_high_90"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = sorted(set(pdf["a"]) | set(pdf["b"]))
        at, n = {c: i for i, c in enumerate(codes)}, float(pdf["n"].max())
        r = np.eye(len(codes))
        r[pdf["a"].map(at), pdf["b"].map(at)] = pdf["r"].fillna(0.0)
        r[pdf["b"].map(at), pdf["a"].map(at)] = pdf["r"].fillna(0.0)
        eig, vif = np.sort(np.linalg.eigvalsh(r))[::-1], []
        for j in range(len(codes)):
            o = [i for i in range(len(codes)) if i != j]
            x, y = n * r[np.ix_(o, o)], n * r[o, j]
            b = np.linalg.solve(x + (ridge + 1e-10) * np.eye(len(o)), y)
            r2 = 1 - (n - 2 * b @ y + b @ x @ b) / (n + 1e-12)
            vif.append(1 / (1 - r2 + 1e-12))
        return pd.DataFrame([{"profile_id": pdf["profile_id"].iloc[0], "condition_number": float(abs(eig[0]) / max(abs(eig[-1]), 1e-300)), "eigenvalues": eig.tolist(),
                              "vif": dict(zip(codes, map(float, vif)))}])

    kernel = correlations.groupBy("profile_id").applyInPandas(solve, "profile_id string, condition_number double, eigenvalues array<double>, vif map<string,double>")
    return counts.join(kernel, "profile_id")


def collinearity_drop(pairs: DataFrame, stats: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Variables dropped by walking highly correlated pairs from the strongest down.

    A pair may be decided as soon as it ranks first among the undecided pairs at both its ends; deciding all such
    pairs at once gives the sequential result in few rounds. The worse of a pair by (missing, outliers, dominance,
    fewer distinct values) goes; ties drop b.
    """
    bad = lambda p: F.struct(F.col("missing_pct").alias("m"), F.coalesce("outlier_pct", F.lit(0.0)).alias("o"), F.col("dominance").alias("d"), (-F.col("n_unique")).alias("u")).alias(p)
    badness = stats.select(*SERIES, bad("bad"))
    side = lambda c: badness.select("profile_id", F.col("code").alias(c), F.col("bad").alias(f"bad_{c}"))
    open_ = pairs.where(F.abs("r") >= threshold).join(side("a"), ["profile_id", "a"]).join(side("b"), ["profile_id", "b"]).select(
        "profile_id", "a", "b", F.struct((-F.abs("r")).alias("s"), "a", "b").alias("ord"), F.when(F.col("bad_a") > F.col("bad_b"), F.col("a")).otherwise(F.col("b")).alias("drop"))
    open_, dropped = cut_lineage(open_), None
    while open_.limit(1).count():
        ends = open_.select("profile_id", F.explode(F.array("a", "b")).alias("v"), "ord")
        first = ends.groupBy("profile_id", "v").agg(F.min("ord").alias("first"))
        at = lambda c: first.select("profile_id", F.col("v").alias(c), F.col("first").alias(f"first_{c}"))
        ready = open_.join(at("a"), ["profile_id", "a"]).join(at("b"), ["profile_id", "b"]).where((F.col("ord") == F.col("first_a")) & (F.col("ord") == F.col("first_b")))
        gone = cut_lineage(ready.select("profile_id", F.col("drop").alias("code"), F.when(F.col("drop") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("kept"), (-F.col("ord.s")).alias("abs_r")))
        dropped = gone if dropped is None else dropped.unionByName(gone)
        out = gone.select("profile_id", F.col("code").alias("x"))
        rest = open_.join(out, (open_["profile_id"] == out["profile_id"]) & ((open_["a"] == out["x"]) | (open_["b"] == out["x"])), "left_anti")
        open_ = cut_lineage(rest)
    if dropped is None:
        return open_.select("profile_id", F.col("a").alias("code"), F.col("b").alias("kept"), (-F.col("ord.s")).alias("abs_r"))
    return dropped


def edge_recovery(est: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall and F1 of |beta| >= threshold against the known edges, RMSE and MAE of the values."""
    on = ["profile_id", "dst", "src"]
    j = est.select(*on, F.col("beta").alias("e")).join(truth.select(*on, F.col("beta").alias("k")), on, "full_outer").fillna(0.0, ["e", "k"])
    hit, want = F.abs("e") >= threshold, F.abs("k") >= threshold
    out = j.groupBy("profile_id").agg(F.count_if(hit & want).alias("tp"), F.count_if(hit & ~want).alias("fp"), F.count_if(~hit & want).alias("fn"),
                                      F.sqrt(F.avg(F.pow(F.col("e") - F.col("k"), 2))).alias("rmse"), F.avg(F.abs(F.col("e") - F.col("k"))).alias("mae"))
    pr, rc = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return out.withColumn("precision", F.coalesce(pr, F.lit(0.0))).withColumn("recall", F.coalesce(rc, F.lit(0.0))).withColumn(
        "f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def error_ratio(rows_mse: DataFrame, coefs: DataFrame) -> DataFrame:
    """Kernel-weighted error of the static model at each point over the time-varying one: rows_mse(profile_id,
    time_index, mse_static)."""
    tv = coefs.groupBy("profile_id", "time_index").agg(F.max("mse_point").alias("mse_tv"))
    return rows_mse.join(tv, ["profile_id", "time_index"]).select("profile_id", "time_index", (F.col("mse_static") / (F.col("mse_tv") + 1e-12)).alias("ratio"))


def static_error_at_points(rows: DataFrame, static: DataFrame, params: DataFrame) -> DataFrame:
    """Kernel-weighted mean squared error of the static coefficients at every point, from the same moments."""
    timed = rows.join(params.select("profile_id", "bandwidth"), "profile_id")

    def solve(key: tuple, mom: pd.DataFrame, co: pd.DataFrame) -> pd.DataFrame:
        if mom.empty or co.empty:
            return pd.DataFrame(columns=["profile_id", "time_index", "mse_static"])
        parts, codes = _sum_partials(mom), list(mom["codes"].iloc[0])
        at, p = {c: i for i, c in enumerate(codes)}, len(codes)
        b, c = np.zeros((p, p)), np.zeros(p)
        b[co["dst"].map(at), co["src"].map(at)] = co["beta"]
        c[co["dst"].map(at)] = co["intercept"]
        return pd.DataFrame([(key[0], q, float(_errors(parts[("point", -1, -1, q)][0], b, c).sum() / (parts[("point", -1, -1, q)][0][0, 0] * p))) for q in range(POINTS)], columns=["profile_id", "time_index", "mse_static"])

    return moments(timed, ("point",)).groupBy("profile_id").cogroup(static.select("profile_id", "dst", "src", "beta", "intercept").groupBy("profile_id")).applyInPandas(
        solve, "profile_id string, time_index int, mse_static double")
