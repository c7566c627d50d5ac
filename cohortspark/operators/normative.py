"""Cohort models and scores: one grouped aggregate for the controls, one join for the patients.

Measurements are long: subject keys, map keys, a point column and a value. A model has one row for each point, so
it never grows with the number of subjects; patients are joined on the point. Points are in every shuffle key,
so a map key that holds most of the data does not skew the plan.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.scores import asymmetry, float_divide, no_nan, region_asymmetry
from cohortspark.operators import gram

SUBJECT = ["participant_id"]
#: Features up to which covariances are columns of one aggregate; more are packed matrices.
AS_COLUMNS = 8


def zscore_model(controls: DataFrame, keys: list[str], *, min_controls: int = 2) -> DataFrame:
    """(keys, n, mean, std) with the population deviation; a deviation of 0 counts as 1. Points with fewer than
    min_controls controls have no model."""
    model = controls.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return model.where(F.col("n") >= min_controls).withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def zscore(controls: DataFrame, patients: DataFrame, keys: list[str], *, depth: str | None = None, subject: list[str] = SUBJECT, min_controls: int = 2) -> DataFrame:
    """(subject, keys, score); with a depth column every depth is scored by itself and scores are averaged."""
    points = [*keys, depth] if depth else keys
    scored = patients.join(zscore_model(controls, points, min_controls=min_controls), points).select(*subject, *points, ((F.col("value") - F.col("mean")) / F.col("std")).alias("score"))
    return scored.groupBy(*subject, *keys).agg(F.avg("score").alias("score")) if depth else scored


def zscore_nan(controls: DataFrame, patients: DataFrame, keys: list[str], *, depth: str, depths: int = 3, subject: list[str] = SUBJECT) -> DataFrame:
    """NaN-aware scores: depths beyond `depths` are cut, NaN controls are skipped, points that are zero in all controls
    score 0, other constant points divide by 0."""
    cut = lambda d: d.where(F.col(depth) < depths)
    model = cut(controls).groupBy(*keys, depth).agg(F.avg(no_nan(F.col("value"))).alias("mean"), F.stddev_pop(no_nan(F.col("value"))).alias("std"), F.bool_or(F.col("value") != 0).alias("used"))
    z = F.when(F.col("used"), float_divide(F.col("value") - F.col("mean"), F.col("std"))).otherwise(0.0)
    return cut(patients).join(model, [*keys, depth]).select(*subject, *keys, z.alias("z")).groupBy(*subject, *keys).agg(F.avg("z").alias("score"))


def complete_cases(frame: DataFrame, covariates: list[str]) -> DataFrame:
    """Rows without a null or NaN covariate."""
    return frame.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in covariates]))


def depth_mean(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.avg("value").alias("value"))


def _moments(x: list[str]) -> list[Column]:
    y = "value"
    own = [F.count("*").alias("n"), F.avg(y).alias("my"), F.var_pop(y).alias("vy"), F.bool_and(F.col(y) == 0).alias("zero")]
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]
    with_y = [F.covar_pop(c, y).alias(f"y{i}") for i, c in enumerate(x)]
    return own + means + with_y + [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]


def _pinv_solver(p: int):
    """Minimum-norm least squares on aggregated moments: rows are points, never subjects."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        n, my, vy = (rows[c].to_numpy(float) for c in ("n", "my", "vy"))
        m = np.stack([rows[f"m{i}"].to_numpy(float) for i in range(p)], 1)
        cxy = np.stack([rows[f"y{i}"].to_numpy(float) for i in range(p)], 1)
        cxx = np.empty((len(rows), p, p))
        for i in range(p):
            for j in range(i, p):
                cxx[:, i, j] = cxx[:, j, i] = rows[f"c{i}_{j}"].to_numpy(float)
        xtx = np.empty((len(rows), p + 1, p + 1))
        xtx[:, 0, 0] = 1
        xtx[:, 0, 1:] = xtx[:, 1:, 0] = m
        xtx[:, 1:, 1:] = cxx + m[:, :, None] * m[:, None, :]
        xty = np.concatenate([my[:, None], cxy + m * my[:, None]], 1)
        eps = np.finfo(float).eps * np.maximum(n, p + 1)
        beta = np.stack([np.linalg.pinv(a, rcond=e, hermitian=True) @ b for a, b, e in zip(xtx, xty, eps, strict=True)]) if len(rows) else np.zeros((0, p + 1))
        scale = np.sqrt(np.einsum("nii->ni", cxx))
        for r in np.flatnonzero((scale > 0).all(1)):  # regular points: centred and scaled, so units don't cost digits
            corr = cxx[r] / np.outer(scale[r], scale[r])
            if np.linalg.cond(corr) < 1e8:
                b = np.linalg.solve(corr, cxy[r] / scale[r]) / scale[r]
                beta[r] = [my[r] - b @ m[r], *b]
        slope = beta[:, 1:]
        residual = vy - 2 * (slope * cxy).sum(1) + np.einsum("ni,nij,nj->n", slope, cxx, slope)
        shift = beta[:, 0] + (slope * m).sum(1) - my  # not 0 when the intercept shares its column with a constant covariate
        return pd.DataFrame({"coefficients": list(beta), "resid_std": np.sqrt(np.maximum(0, residual + 0 * shift))})

    return F.pandas_udf(solve, "coefficients array<double>, resid_std double")


def wscore_model(controls: DataFrame, keys: list[str], covariates: list[str], *, min_controls: int = 2) -> DataFrame:
    """(keys, n, coefficients, resid_std, zero): least squares of the value on [1, covariates] at every point.

    The fit only needs centred moments, so it is one aggregate with map-side combining. One or two covariates have a
    closed form that stays in generated code; points where it is singular, and more covariates, take a pseudo-inverse of
    the moments. resid_std is the population deviation of the residuals; zero marks points that are 0 in all controls."""
    frame = complete_cases(controls, covariates).withColumns({c: F.col(c).cast("double") for c in covariates})
    if len(covariates) > AS_COLUMNS:
        return _wscore_packed(frame, keys, covariates, min_controls)
    moments = frame.groupBy(*keys).agg(*_moments(covariates)).where(F.col("n") >= min_controls)
    kept = [*keys, "n", "coefficients", "resid_std", "zero"]
    p = len(covariates)

    def general(rows: DataFrame) -> DataFrame:
        names = ["n", "my", "vy", *[f"m{i}" for i in range(p)], *[f"y{i}" for i in range(p)], *[f"c{i}_{j}" for i in range(p) for j in range(i, p)]]
        solved = rows.withColumn("fit", _pinv_solver(p)(F.struct(*[F.col(c) for c in names])))
        return solved.select(*keys, "n", F.col("fit.coefficients").alias("coefficients"), F.col("fit.resid_std").alias("resid_std"), "zero")

    if p > 2:
        return general(moments)
    if p == 1:
        singular = F.col("c0_0") <= 1e-12 * (F.col("m0") * F.col("m0") + F.col("c0_0"))
        safe = F.when(~singular, F.col("c0_0"))
        b = [F.col("y0") / safe]
    else:
        det = F.col("c0_0") * F.col("c1_1") - F.col("c0_1") * F.col("c0_1")
        singular = (det <= 1e-12 * F.col("c0_0") * F.col("c1_1")) | (F.col("c0_0") == 0) | (F.col("c1_1") == 0)
        safe = F.when(~singular, det)
        b = [(F.col("y0") * F.col("c1_1") - F.col("y1") * F.col("c0_1")) / safe, (F.col("y1") * F.col("c0_0") - F.col("y0") * F.col("c0_1")) / safe]
    intercept = F.col("my") - sum((b[i] * F.col(f"m{i}") for i in range(p)), F.lit(0.0))
    explained = sum((b[i] * F.col(f"y{i}") for i in range(p)), F.lit(0.0))
    regular = moments.where(~singular).select(*keys, "n", F.array(intercept, *b).alias("coefficients"), F.sqrt(F.greatest(F.lit(0.0), F.col("vy") - explained)).alias("resid_std"), "zero")
    return regular.unionByName(general(moments.where(singular)).select(*kept))


def _wscore_packed(frame: DataFrame, keys: list[str], covariates: list[str], min_controls: int) -> DataFrame:
    """The model of many covariates, from one packed matrix of them and the value for each point."""
    p = len(covariates)
    packed = gram.moments(frame, keys, [*covariates, "value"]).where(F.col("n") >= min_controls)
    order = {pair: k for k, pair in enumerate(zip(*np.triu_indices(p + 1), strict=True))}
    per = lambda i, j: F.col("scatter")[order[i, j]] / F.col("n")
    names = {"my": F.col("mean")[p], "vy": per(p, p), **{f"m{i}": F.col("mean")[i] for i in range(p)}, **{f"y{i}": per(i, p) for i in range(p)}, **{f"c{i}_{j}": per(i, j) for i in range(p) for j in range(i, p)}}
    solved = packed.withColumn("fit", _pinv_solver(p)(F.struct("n", *[x.alias(c) for c, x in names.items()])))
    # a point that is 0 in all controls has mean and scatter 0
    zero = (F.col("mean")[p] == 0) & (F.col("scatter")[order[p, p]] == 0)
    return solved.select(*keys, "n", F.col("fit.coefficients").alias("coefficients"), F.col("fit.resid_std").alias("resid_std"), zero.alias("zero"))


def predicted(covariates: list[str]) -> Column:
    return F.col("coefficients")[0] + sum((F.col("coefficients")[i + 1] * F.col(c).cast("double") for i, c in enumerate(covariates)), F.lit(0.0))


def wscore(controls: DataFrame, patients: DataFrame, keys: list[str], covariates: list[str], *, subject: list[str] = SUBJECT, regions: bool = False, min_controls: int = 2) -> DataFrame:
    """(subject, keys, score) from measurements that carry their covariates.

    Maps: points that are 0 in all controls score the raw value, and a residual deviation of 0 gives an infinity or NaN.
    Regions: such points score 0 and a deviation of 0 counts as 1."""
    model = wscore_model(controls, keys, covariates, min_controls=min_controls)
    joined = patients.join(model, keys)
    residual = F.col("value") - predicted(covariates)
    if regions:
        score = F.when(F.col("zero"), 0.0).otherwise(residual / F.when(F.col("resid_std") == 0, 1.0).otherwise(F.col("resid_std")))
    else:
        score = F.when(F.col("zero"), F.col("value")).otherwise(float_divide(residual, F.col("resid_std")))
    return joined.select(*subject, *keys, score.alias("score"))


def deconfound(frame: DataFrame, controls: Column, keys: list[str], covariates: list[str], *, subject: list[str] = SUBJECT) -> DataFrame:
    """Values with the covariates' effect, as fitted on the controls, removed from every subject."""
    model = wscore_model(frame.where(controls), keys, covariates)
    return frame.join(model.drop("n", "zero", "resid_std"), keys).select(*subject, *keys, (F.col("value") - predicted(covariates)).alias("value"))


def mahalanobis(controls: DataFrame, patients: DataFrame, keys: list[str], features: list[str], *, subject: list[str] = SUBJECT) -> DataFrame:
    """(subject, keys, distance) of wide rows with a column for each feature: sqrt(d' pinv(S) d), S with n - 1.

    Controls with a null feature are left out. Up to AS_COLUMNS features the F (F + 1) / 2 covariances are columns of one
    aggregate, more are a packed matrix. Two features have a closed form where S is regular; the rest takes a pseudo-inverse of
    each point's matrix."""
    f = len(features)
    if f < 2:
        raise ValueError("at least two features")
    if f > AS_COLUMNS:
        return _mahalanobis_packed(controls, patients, keys, features, subject)
    model = controls.dropna(subset=features).groupBy(*keys).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.covar_samp(features[i], features[j]).alias(f"s{i}_{j}") for i in range(f) for j in range(i, f)])
    joined = patients.join(model, keys)

    def solve(rows: pd.DataFrame) -> pd.Series:
        d = np.stack([rows[f"d{i}"].to_numpy(float) for i in range(f)], 1)
        s = np.empty((len(rows), f, f))
        for i in range(f):
            for j in range(i, f):
                s[:, i, j] = s[:, j, i] = rows[f"s{i}_{j}"].to_numpy(float)
        return pd.Series(_distances(d, s))

    with_d = joined.withColumns({f"d{i}": F.col(c) - F.col(f"m{i}") for i, c in enumerate(features)})
    general = lambda rows: rows.select(*subject, *keys, F.pandas_udf(solve, "double")(F.struct(*[F.col(f"d{i}") for i in range(f)], *[F.col(f"s{i}_{j}") for i in range(f) for j in range(i, f)])).alias("distance"))
    if f > 2:
        return general(with_d)
    det = F.expr("s0_0 * s1_1 - s0_1 * s0_1")
    regular = F.coalesce(det > 1e-12 * F.col("s0_0") * F.col("s1_1"), F.lit(False))
    closed = F.sqrt(F.greatest(F.lit(0.0), F.expr("s1_1 * d0 * d0 - 2 * s0_1 * d0 * d1 + s0_0 * d1 * d1") / F.when(regular, det)))
    return with_d.where(regular).select(*subject, *keys, closed.alias("distance")).unionByName(general(with_d.where(~regular)))


def _distances(d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """sqrt(d' pinv(s) d) for rows of differences and of matrices; regular matrices are scaled, so units don't cost digits."""
    sd = np.sqrt(np.einsum("nii->ni", s))
    unit = np.where((sd > 0) & np.isfinite(sd), sd, 1.0)
    corr = s / (unit[:, :, None] * unit[:, None, :])
    regular = np.isfinite(corr).all((1, 2))
    regular[regular] = np.linalg.cond(corr[regular]) < 1e8
    square = np.empty(len(d))
    z = d / unit
    square[regular] = (z[regular] * np.linalg.solve(corr[regular], z[regular][:, :, None])[:, :, 0]).sum(1)
    square[~regular] = np.einsum("ni,nij,nj->n", d[~regular], np.linalg.pinv(s[~regular], hermitian=True), d[~regular])
    return np.sqrt(np.maximum(0, square))


def _mahalanobis_packed(controls: DataFrame, patients: DataFrame, keys: list[str], features: list[str], subject: list[str]) -> DataFrame:
    """Many features: a point's matrix meets the point's patients once, in a cogroup, instead of being joined to each."""
    f = len(features)
    model = gram.moments(controls, keys, features)
    wide = patients.select(*subject, *keys, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(features)])
    kinds = ", ".join(f"`{k}` {wide.schema[k].dataType.simpleString()}" for k in [*subject, *keys])

    def run(here: pa.Table, there: pa.Table) -> pa.Table:
        if not there.num_rows or there.column("n")[0].as_py() < 2:
            here = here.slice(0, 0)
        x = np.stack([here.column(f"_{i}").to_numpy() for i in range(f)], 1).astype(float)
        distance = np.zeros(0)
        if len(x):
            s = gram.unpacked(np.array(there.column("scatter")[0].as_py())[None], f) / (there.column("n")[0].as_py() - 1)
            d = x - np.array(there.column("mean")[0].as_py())
            distance = np.concatenate([_distances(rows, np.broadcast_to(s, (len(rows), f, f))) for rows in np.array_split(d, 1 + len(d) // 256)])
        return pa.table([*[here.column(c) for c in [*subject, *keys]], pa.array(distance)], names=[*subject, *keys, "distance"])

    return wide.groupBy(*keys).cogroup(model.groupBy(*keys)).applyInArrow(run, f"{kinds}, distance double")


def in_every_feature(frame: DataFrame, features: list[str], *, feature: str = "feature", subject: list[str] = SUBJECT) -> DataFrame:
    """Rows of subjects that have all the features: distances need every one of them."""
    wanted = frame.where(F.col(feature).isin(features))
    full = wanted.groupBy(*subject).agg(F.count_distinct(feature).alias("_n")).where(F.col("_n") == len(set(features))).select(*subject)
    return wanted.join(full, subject, "left_semi")


def mahalanobis_maps(frame: DataFrame, keys: list[str], features: list[str], *, depths: list[int] | None = None, feature: str = "feature", analyses: tuple[str, ...] = ("regional", "asymmetry"), subject: list[str] = SUBJECT) -> DataFrame:
    """(subject, keys, analysis, distance) of patients, from long maps with cohort, hemi, feature and, if depths are given, depth.

    Every depth of a feature counts as a feature of its own. Subjects without one of the features drop out, and so do points where
    one of a subject's values is missing. Asymmetry maps have hemi L."""
    common = in_every_feature(frame, features, feature=feature, subject=subject)
    layer = ["depth"] if depths else []
    columns = [f"{f}_{d}" for f in features for d in depths] if depths else list(features)
    stacked = F.concat_ws("_", feature, *layer)
    out = None
    for analysis in analyses:
        maps = common
        if analysis == "asymmetry":
            rest = [k for k in keys if k != "hemi"]
            maps = asymmetry_maps(common, [*subject, "cohort", *rest, feature, *layer]).withColumn("hemi", F.lit("L"))
        wide = maps.withColumn("_f", stacked).groupBy(*subject, "cohort", *keys).pivot("_f", columns).agg(F.first("value")).dropna(subset=columns)
        got = mahalanobis(wide.where("cohort = 'control'"), wide.where("cohort = 'patient'"), keys, columns, subject=subject).select(*subject, *keys, F.lit(analysis).alias("analysis"), "distance")
        out = got if out is None else out.unionByName(got)
    return out


def asymmetry_maps(frame: DataFrame, keys: list[str], *, hemi: str = "hemi") -> DataFrame:
    """(keys, value): left/right asymmetry where both sides are there; one grouped pass, no self-join."""
    sides = frame.groupBy(*keys).agg(F.max(F.when(F.col(hemi) == "L", F.col("value"))).alias("l"), F.max(F.when(F.col(hemi) == "R", F.col("value"))).alias("r"))
    return sides.where("l is not null and r is not null").select(*keys, asymmetry(F.col("l"), F.col("r")).alias("value"))


def asymmetry_regions(frame: DataFrame, keys: list[str], *, region: str = "region") -> DataFrame:
    """Regions named L<x> and R<x> are a pair <x>; a mean that is not positive gives 0."""
    sided = frame.withColumn("side", F.substring(region, 1, 1)).withColumn("base", F.expr(f"substring({region}, 2)")).where(F.col("side").isin("L", "R"))
    sides = sided.groupBy(*keys, "base").agg(F.max(F.when(F.col("side") == "L", F.col("value"))).alias("l"), F.max(F.when(F.col("side") == "R", F.col("value"))).alias("r"))
    return sides.where("l is not null and r is not null").select(*keys, F.col("base").alias(region), region_asymmetry(F.col("l"), F.col("r")).alias("value"))


def score_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean_score, std_score) with the population deviation."""
    return scores.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))
