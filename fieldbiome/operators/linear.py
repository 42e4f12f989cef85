"""Linear models from sufficient statistics: one aggregate pass over the rows, then a small solve on the driver.

What comes to the driver is one row of sums, (terms + 1)^2 numbers, whatever the input's size. Columns are centred on their
means before the products, so that raw-scale covariates don't drown the others.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbiome.operators.ranking import placed

# ---- distributions


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5) if math.isfinite(t) else 0.0


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if math.isfinite(f) else 0.0


def t_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


# ---- fits


def design(df: DataFrame, terms: dict[str, Column], categorical: list[str], y: Column, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(rows with columns y, x0, x1, ..., term names): an intercept, the terms, and dummies of all but the first level.

    Rows with a null anywhere are left out. The levels of a categorical column are the only thing listed on the driver. keep: columns that stay.
    """
    names, columns = ["Intercept"], [F.lit(1.0)]
    kept = df
    for c in [*terms.values(), y]:
        kept = kept.where(c.isNotNull() & ~F.isnan(c.cast("double")))
    for c in categorical:
        kept = kept.where(F.col(c).isNotNull())
    for name, c in terms.items():
        names.append(name)
        columns.append(c.cast("double"))
    for c in categorical:
        levels = sorted(r[0] for r in kept.select(F.col(c).cast("string")).distinct().limit(10_001).collect())
        if len(levels) > 10_000:
            raise ValueError(f"{c} has over 10000 levels: absorb it by demeaning (see demeaned)")
        for v in levels[1:]:
            names.append(f"C({c})[T.{v}]")
            columns.append((F.col(c).cast("string") == v).cast("double"))
    return kept.select(y.cast("double").alias("y"), *[x.alias(f"x{k}") for k, x in enumerate(columns)], *(keep or [])), names


def ols(rows: DataFrame, names: list[str], robust: str | None = None) -> dict[str, object]:
    """Coefficients, errors, t, p, 95% limits, R2 and the like of y on x0.. (see design). robust='HC3' for that covariance."""
    k = len(names)
    means = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(f"x{i}").alias(f"x{i}") for i in range(1, k)]).first()
    n = means["n"]
    if n <= k:
        raise ValueError(f"{n} rows are too few for {k} terms")
    centred = [F.lit(1.0), *[F.col(f"x{i}") - F.lit(means[f"x{i}"]) for i in range(1, k)], F.col("y") - F.lit(means["y"])]
    sums = rows.agg(*[F.sum(centred[i] * centred[j]).alias(f"s{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]).first()
    s = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    size = np.sqrt(np.maximum(np.diag(s)[:k], 1e-300))
    inverse = np.linalg.pinv(s[:k, :k] / np.outer(size, size), rcond=1e-12) / np.outer(size, size)
    beta = inverse @ s[:k, k]
    rank = int(np.linalg.matrix_rank(s[:k, :k] / np.outer(size, size), tol=1e-10))
    total = s[k, k]
    rss = max(float(total - 2 * beta @ s[:k, k] + beta @ s[:k, :k] @ beta), 0.0)
    df = n - rank
    cov = inverse * rss / df
    if robust == "HC3":
        fitted, lever = F.lit(0.0), F.lit(0.0)
        for i in range(k):
            fitted = fitted + F.lit(float(beta[i])) * centred[i]
            for j in range(k):
                lever = lever + F.lit(float(inverse[i, j])) * centred[i] * centred[j]
        w = F.pow((centred[k] - fitted) / (1 - lever), 2)
        meat = rows.agg(*[F.sum(w * centred[i] * centred[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        m = np.array([[meat[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        cov = inverse @ m @ inverse
    # Back from centred columns: only the intercept changes.
    shift = np.eye(k)
    shift[0, 1:] = [-means[f"x{i}"] for i in range(1, k)]
    beta, cov = shift @ beta, shift @ cov @ shift.T
    beta[0] += means["y"]
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    q = t_quantile(0.975, df)
    r2 = 1 - rss / total if total > 0 else float("nan")
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta / se
    out = {"names": names, "coef": beta, "se": se, "t": t, "p": np.array([t_two_sided(x, df) for x in t]), "ci_low": beta - q * se, "ci_high": beta + q * se, "n": n, "df": df, "rss": rss, "tss": total, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / df}
    out["f"] = (total - rss) / (rank - 1) / (rss / df) if rank > 1 and rss > 0 else float("nan")
    out["loglik"] = -n / 2 * (math.log(2 * math.pi * rss / n) + 1) if rss > 0 else float("inf")
    out["aic"], out["bic"] = -2 * out["loglik"] + 2 * rank, -2 * out["loglik"] + rank * math.log(n)
    return out


def coefficients(df: DataFrame, fit: dict[str, object]) -> DataFrame:
    """term, coef, std_err, t, p_value, ci_low, ci_high, nobs, r2, adj_r2."""
    rows = [(name, *(float(fit[c][i]) for c in ("coef", "se", "t", "p", "ci_low", "ci_high")), int(fit["n"]), float(fit["r2"]), float(fit["adj_r2"])) for i, name in enumerate(fit["names"])]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, std_err double, t double, p_value double, ci_low double, ci_high double, nobs long, r2 double, adj_r2 double")


def nested_test(base: dict[str, object], full: dict[str, object]) -> dict[str, float]:
    """F, p and the gain in R2 of the full model over the base one."""
    d = base["df"] - full["df"]
    f = (base["rss"] - full["rss"]) / d / (full["rss"] / full["df"])
    return {"f": f, "p": f_upper(f, d, full["df"]), "delta_r2": full["r2"] - base["r2"], "n": full["n"]}


def lag_models(panel: DataFrame) -> dict[str, dict[str, object]]:
    """The forward, enriched, reverse and difference models of a lagged panel, and the nested test. Study is categorical;
    sequencing_depth joins in where three rows at least have it."""
    from fieldbiome.operators.panel import lagged

    rows = lagged(panel)
    pairs = rows.where("arg_t1 is not null")
    has = "sequencing_depth" in rows.columns and pairs.where("sequencing_depth is not null").limit(3).count() >= 3
    depth = {"sequencing_depth": F.col("sequencing_depth")} if has else {}
    m, a, e = {"mge_abundance": F.col("mge_abundance")}, {"arg_total": F.col("arg_total")}, {"entropy": F.col("entropy")}
    fit = lambda d, terms, y, cats=("study",): ols(*design(d, terms, list(cats), F.col(y)))
    out = {"forward": fit(pairs, m | depth, "arg_t1"), "reverse": fit(rows.where("mge_t1 is not null"), a | depth, "mge_t1")}
    if "entropy" in rows.columns:
        out["enriched"] = fit(pairs, m | e | depth, "arg_t1")
    diff = rows.where("d_mge_t is not null and d_arg_t1 is not null")
    if diff.limit(3).count() >= 3:
        out["difference"] = fit(diff, {"d_mge_t": F.col("d_mge_t")}, "d_arg_t1", ())
    if pairs.limit(5).count() >= 5:
        base = fit(pairs, a | depth, "arg_t1")
        out["added_value"] = nested_test(base, fit(pairs, a | m | depth, "arg_t1"))
    return out


def demeaned(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """columns minus their group means: fixed effects without dummies, however many groups there are."""
    means = df.groupBy(group).agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    return df.join(means, group).select(*[(F.col(c) - F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def simple_regression(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """n, slope, intercept and R2 of y on x, by group: built-in aggregates only."""
    fits = (F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    return df.groupBy(*(by or [])).agg(*fits)


def cell_stats(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"), F.avg(y).alias("m"), (F.var_pop(y) * F.count("*")).alias("ss"))


def did(df: DataFrame, treatment: str = "treatment", time: str = "time", y: str = "y", robust: bool = False) -> DataFrame:
    """Difference in differences of a saturated 2 x 2 design, from its four cells: term, coef, std_err, nobs, and rss, tss.

    A cell mean has variance s2/n, with s2 pooled; with robust (HC3), sum of u2 / (1 - 1/n)2 / n2 of the cell.
    """
    cells = cell_stats(df, treatment, time, y)
    pick = lambda g, t, c: F.max(F.when((F.col(treatment) == g) & (F.col(time) == t), F.col(c)))
    wide = cells.agg(*[pick(g, t, c).alias(f"{c}{g}{t}") for g in (0, 1) for t in (0, 1) for c in ("n", "m", "ss")])
    names = ("00", "01", "10", "11")
    total = lambda f: f(names[0]) + f(names[1]) + f(names[2]) + f(names[3])
    n, rss = total(lambda k: F.col(f"n{k}")), total(lambda k: F.col(f"ss{k}"))
    mean = total(lambda k: F.col(f"n{k}") * F.col(f"m{k}")) / n
    tss = rss + total(lambda k: F.col(f"n{k}") * F.pow(F.col(f"m{k}") - mean, 2))
    s2 = rss / (n - 4)
    v = {gt: (F.col(f"ss{gt}") / F.pow(F.col(f"n{gt}") - 1, 2) if robust else s2 / F.col(f"n{gt}")) for gt in names}
    m = {gt: F.col(f"m{gt}") for gt in v}
    terms = [("Intercept", m["00"], v["00"]), ("treatment", m["10"] - m["00"], v["10"] + v["00"]), ("time", m["01"] - m["00"], v["01"] + v["00"]), ("treatment:time", m["11"] - m["10"] - m["01"] + m["00"], v["00"] + v["01"] + v["10"] + v["11"])]
    return wide.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), c.alias("coef"), F.sqrt(e).alias("std_err"), n.alias("nobs"), rss.alias("rss"), tss.alias("tss")) for t, c, e in terms])))


def did_table(df: DataFrame, treatment: str = "treatment", time: str = "time", y: str = "y", robust: bool = False, log_outcome: bool = False) -> DataFrame:
    """term, coef, std_err, t, p_value, ci_low, ci_high, nobs, r2, adj_r2 of a difference in differences.

    log_outcome takes log1p of the outcome; a negative one raises. The four rows of cells come to the driver for the tails of
    Student's t.
    """
    from fieldbiome.functions.coerce import not_negative

    if log_outcome:
        df = df.withColumn(y, F.log1p(not_negative(F.col(y).cast("double"), y)))
    out = []
    for r in did(df, treatment, time, y, robust).collect():
        left = r["nobs"] - 4
        t = r["coef"] / r["std_err"] if r["std_err"] else float("nan")
        q, r2 = t_quantile(0.975, left), 1 - r["rss"] / r["tss"] if r["tss"] else float("nan")
        out.append((r["term"], r["coef"], r["std_err"], t, t_two_sided(t, left), r["coef"] - q * r["std_err"], r["coef"] + q * r["std_err"], int(r["nobs"]), r2, 1 - (1 - r2) * (r["nobs"] - 1) / left))
    return df.sparkSession.createDataFrame(out, "term string, coef double, std_err double, t double, p_value double, ci_low double, ci_high double, nobs long, r2 double, adj_r2 double")


def anova_type2(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """Type II sums of squares of a, b, a:b and Residual, with their share in percent of all of them.

    Only cells come to the driver (levels of a times levels of b).
    """
    cells = cell_stats(df, a, b, y).collect()
    la, lb = sorted({r[a] for r in cells}), sorted({r[b] for r in cells})
    n, m = np.array([r["n"] for r in cells], float), np.array([r["m"] for r in cells])
    within = sum(r["ss"] for r in cells)

    def rss(columns: list[np.ndarray]) -> float:
        x, w = np.stack(columns, 1), np.sqrt(n)
        beta = np.linalg.lstsq(x * w[:, None], m * w, rcond=None)[0]
        return float((n * (m - x @ beta) ** 2).sum())

    da = [np.array([float(r[a] == v) for r in cells]) for v in la]
    db = [np.array([float(r[b] == v) for r in cells]) for v in lb]
    r_a, r_b, r_ab = rss(da), rss(db), rss([*da, *db])
    parts = [(f"C({a})", r_b - r_ab), (f"C({b})", r_a - r_ab), (f"C({a}):C({b})", r_ab), ("Residual", within)]
    total = sum(v for _, v in parts)
    return df.sparkSession.createDataFrame([(k, float(v), 100 * float(v) / total if total else 0.0) for k, v in parts], "factor string, sum_sq double, variance_percent double")


def residual_shape(rows: DataFrame, residual: str, order: str) -> DataFrame:
    """One row: n, skew, kurtosis, Jarque-Bera and Durbin-Watson of residuals. Neighbours meet by their place, not in one window."""
    ranked = placed(rows.select(F.col(residual).alias("u"), F.col(order).alias("o")), [F.col("o")])
    next_ = ranked.select((F.col("place") - 1).alias("__at"), F.col("u").alias("__u"))
    steps = ranked.join(next_, F.col("place") == F.col("__at"), "left")
    s = steps.agg(F.count("*").alias("n"), F.skewness("u").alias("skew"), (F.kurtosis("u") + 3).alias("kurtosis"), (F.sum(F.pow(F.col("__u") - F.col("u"), 2)) / F.sum(F.pow("u", 2))).alias("durbin_watson"))
    return s.withColumn("jarque_bera", F.col("n") / 6 * (F.pow("skew", 2) + F.pow(F.col("kurtosis") - 3, 2) / 4))


def omnibus(skew: float, kurtosis: float, n: int) -> tuple[float, float]:
    """D'Agostino and Pearson's test of normality: (statistic, p), from skewness and kurtosis (3 for a normal law); n from 8."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    b = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b - 1))
    z1 = math.asinh(y / math.sqrt(2.0 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    mean, var = 3.0 * (n - 1) / (n + 1), 24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) ** 2 * (n + 3) * (n + 5))
    x = (kurtosis - mean) / math.sqrt(var)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / root * (2.0 / root + math.sqrt(1 + 4.0 / root**2))
    ratio = (1 - 2.0 / a) / (1 + x * math.sqrt(2.0 / (a - 4.0)))
    z2 = (1 - 2.0 / (9 * a) - math.copysign(abs(ratio) ** (1 / 3), ratio)) / math.sqrt(2.0 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return k2, math.exp(-k2 / 2)


def summary_extras(rows: DataFrame, fit: dict[str, object], order: str) -> dict[str, float]:
    """F and its p, log-likelihood, AIC, BIC, Omnibus, skew, kurtosis, Durbin-Watson, Jarque-Bera and condition number of a fit.

    rows: what ols() took (y, x0, x1, ...), with a column to order residuals by. One row of sums comes to the driver.
    """
    k = len(fit["names"])
    fitted = F.lit(0.0)
    for i, b in enumerate(fit["coef"]):
        fitted = fitted + F.lit(float(b)) * F.col(f"x{i}")
    shape = residual_shape(rows.withColumn("u", F.col("y") - fitted), "u", order).first()
    sums = rows.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    values = np.linalg.eigvalsh(np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]))
    out = {c: float(shape[c]) for c in ("skew", "kurtosis", "durbin_watson", "jarque_bera")}
    out["jb_p"] = math.exp(-out["jarque_bera"] / 2)
    out["omnibus"], out["omnibus_p"] = omnibus(out["skew"], out["kurtosis"], int(fit["n"])) if fit["n"] >= 8 else (float("nan"), float("nan"))
    out["condition"] = float(math.sqrt(values[-1] / values[0])) if values[0] > 0 else float("inf")
    out["f"], out["f_p"] = float(fit["f"]), f_upper(float(fit["f"]), k - 1, float(fit["df"])) if k > 1 else float("nan")
    return out | {c: float(fit[c]) for c in ("loglik", "aic", "bic")}
