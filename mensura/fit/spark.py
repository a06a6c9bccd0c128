"""Fits on DataFrames: one for each group, one over a large table, and closed forms without Python."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.errors import DataError, MensuraError
from mensura.expr import formula as X
from mensura.fit import odr
from mensura.scratch import SMALL, drop_path, same_keys, saved, shared_dir, small

_D, _A = T.DoubleType(), T.ArrayType(T.DoubleType())
#: Result columns of a grouped fit.
RESULT = [
    T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("termination", T.StringType()), T.StructField("iterations", T.IntegerType()),
    T.StructField("n", T.LongType()), T.StructField("parameters", _A), T.StructField("sigmas", _A), T.StructField("sigmas_raw", _A), T.StructField("expanded", _A),
    T.StructField("covariance", T.ArrayType(_A)), T.StructField("correlation", T.ArrayType(_A)), T.StructField("coverage_factor", _D), T.StructField("effective_dof", _D),
    T.StructField("chi2", _D), T.StructField("chi2_reduced", _D), T.StructField("chi2_obs", _D), T.StructField("dof", T.LongType()), T.StructField("rmse", _D), T.StructField("r_squared", _D),
    T.StructField("r_squared_layers", _A), T.StructField("rank", T.IntegerType()), T.StructField("condition", _D), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("assumptions", T.ArrayType(T.StringType())),
]
#: Rows of a group above which it is fitted over the cluster, with all such groups at once, instead of in one task.
GROUP_ROWS = 50_000


def fit_grouped(df: DataFrame, keys: Sequence[str], spec: odr.FitSpec) -> DataFrame:
    """One fit for each group of ``keys``, of any size: keys and the RESULT columns.

    A model linear in its parameters whose independents carry no uncertainty is solved from sums
    (``fit_linear_groups``); others go to ``fit_groups``. A group that cannot be fitted gives a row
    with ``error`` and no values.
    """
    return fit_linear_groups(df, keys, spec) if linear(spec) else fit_groups(df, keys, spec)


def _fit_small(df: DataFrame, keys: Sequence[str], spec: odr.FitSpec) -> DataFrame:
    """One fit for each group, whose rows are one task's arrays."""
    need = spec.columns()
    schema = T.StructType([*(df.schema[k] for k in keys), *RESULT])
    names = [f.name for f in RESULT]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            out = odr.fit(spec, {c: pdf[c].to_numpy(float) for c in need})
            row = {n: out.get(n) for n in names} | {"n": len(pdf), "error": None}
        except (MensuraError, np.linalg.LinAlgError) as e:
            row = dict.fromkeys(names) | {"success": False, "error": str(e), "n": len(pdf)}
        return pd.DataFrame([[*key, *(row[n] for n in names)]], columns=[*keys, *names])

    used = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in need if c not in keys))
    return used.groupBy(*keys).applyInPandas(run, schema)


def linear(spec: odr.FitSpec) -> bool:
    """One layer, linear in its parameters, exact independents, no correlation, Poisson or type A notes."""
    if len(spec.layers) != 1 or spec.correlation is not None or spec.poisson or spec.type_a or any(v in spec.sigmas for v in spec.layers[0].independents):
        return False
    layer = spec.layers[0]
    m = odr.compiled(layer.formula, layer.independents, spec.parameters, tuple(sorted((k.lower(), v) for k, v in spec.fixed.items())))
    return all(e == X.ZERO for e in m.parts["pp"])


def fit_linear_groups(df: DataFrame, keys: Sequence[str], spec: odr.FitSpec) -> DataFrame:
    """Linear fits of all groups from two passes of sums: no group's rows ever meet in one task.

    The first pass sums products of the model's slopes, which do not depend on the parameters, and
    gives the normal equations; the second takes the residuals at their solution, so that sums of
    squares do not suffer from cancellation, and corrects it once. Groups are solved in batches.
    """
    layer, ps = spec.layers[0], [p.strip().lower() for p in spec.parameters]
    m = odr.compiled(layer.formula, layer.independents, spec.parameters, tuple(sorted((k.lower(), v) for k, v in spec.fixed.items())))
    q, need = len(ps), spec.columns()
    start = np.array(spec.guesses if spec.guesses is not None else np.ones(q), float)
    if len(start) != q or not np.isfinite(start).all():
        raise DataError("guesses must be one finite number for each parameter")
    at = {x: F.col(f"`{c}`") for x, c in zip(m.xs, layer.independents)}
    points = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in need if c not in keys))
    y = F.col(f"`{layer.dependent}`")
    given = F.col(f"`{spec.sigmas[layer.dependent]}`") if layer.dependent in spec.sigmas else F.lit(0.0)
    finite = [F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`")) & (F.abs(F.col(f"`{c}`")) < float("inf")) for c in need]
    good = finite[0]
    for f in finite[1:]:
        good = good & f
    sigma = F.greatest(given, F.lit(odr.MIN_SIGMA))
    rows = points.select(
        *keys, y.alias("_y"), (1 / (sigma * sigma)).alias("_w"), *(X.to_column(e, at).alias(f"_f{j}") for j, e in enumerate(m.parts["p"])),
        X.to_column(X.substitute(m.parts["f"][0], dict.fromkeys(ps, 0.0)), at).alias("_f"), good.alias("_good"), *((~f).alias(f"_bad{k}") for k, f in enumerate(finite)), (given < 0).alias("_minus"),
        ((given < odr.MIN_SIGMA).cast("int") + F.lit(len(layer.independents))).alias("_clamped"),
    )
    whole = F.col("_f").isNotNull() & ~F.isnan("_f") & (F.abs("_f") < float("inf"))
    pairs = [(i, j) for i in range(q) for j in range(i, q)]
    def sums(r):
        return [F.sum(F.col("_w") * r * r).alias("_rr"), F.sum(r * r).alias("_ss"), *(F.sum(F.col("_w") * F.col(f"_f{j}") * r).alias(f"_g{j}") for j in range(q))]
    first = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), *(F.count_if(F.col(f"_bad{k}")).alias(f"_bad{k}") for k in range(len(need))), F.count_if(F.col("_minus")).alias("_neg"), F.count_if(F.col("_good") & ~whole).alias("_open"), F.sum("_clamped").alias("_c"), F.sum("_y").alias("_sy"), F.sum(F.col("_y") * F.col("_y")).alias("_syy"),
        *(F.sum(F.col("_w") * F.col(f"_f{i}") * F.col(f"_f{j}")).alias(f"_h{i}_{j}") for i, j in pairs), *sums(F.col("_y") - F.col("_f")),
    )

    def hessian(r) -> np.ndarray:
        h = np.zeros((q, q))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"_h{i}_{j}"]
        return h

    def solved(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            beta = []
            for r in pdf.to_dict("records"):
                h, g = hessian(r), np.array([r[f"_g{j}"] for j in range(q)])
                ok = np.isfinite(h).all() and np.isfinite(g).all()
                beta.append((start + np.linalg.lstsq(h, g - h @ start, rcond=odr.RANK_EPS)[0]).tolist() if ok else start.tolist())
            yield pdf.assign(_b=beta)

    normal = saved(first.mapInPandas(solved, T.StructType([*first.schema.fields, T.StructField("_b", _A)])))
    fitted = F.col("_f")
    for j in range(q):
        fitted = fitted + F.col(f"_f{j}") * F.get("_b", F.lit(j))
    # few groups go by broadcast; else adaptive execution splits the rows of a hot one
    again = same_keys(rows, small(normal.select(*keys, "_b")), list(keys)).groupBy(*keys).agg(*sums(F.col("_y") - fitted))
    both = same_keys(normal.drop("_rr", "_ss", *(f"_g{j}" for j in range(q))), again, list(keys), "left")
    names = [f.name for f in RESULT]

    def judged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.to_dict("records"):
                n, error = int(r["_n"]), None
                bad = [c for k, c in enumerate(need) if r[f"_bad{k}"]]
                if bad and bad[0] in spec.variables:
                    error = f"{bad[0]} holds nulls or non-finite values"
                elif bad or r["_neg"]:
                    error = f"uncertainties of {layer.dependent} must be {n} finite numbers of at least 0"
                elif n < 2:
                    error = "a fit needs at least 2 points"
                elif r["_open"] or not np.isfinite(hessian(r)).all():
                    error = "the model is not finite at some point"
                if error:
                    out.append(dict.fromkeys(names) | {"success": False, "error": error, "n": n})
                    continue
                h, beta = hessian(r), np.array(r["_b"], float)
                g = np.array([r[f"_g{j}"] for j in range(q)])
                step = np.linalg.lstsq(h, g, rcond=odr.RANK_EPS)[0]
                chi2 = float(np.maximum(0.0, r["_rr"] - g @ step))  # NaN stays
                state = odr.State(chi2, chi2, -(g - h @ step), h, np.array([r["_ss"]]))
                got = odr.respond(spec, beta + step, state, 1, "gradient", n, {0: (n, r["_sy"], r["_syy"])}, {"clamped": int(r["_c"])})
                out.append({k: got.get(k) for k in names} | {"n": n, "error": None})
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return both.mapInPandas(judged, T.StructType([*(df.schema[k] for k in keys), *RESULT]))


def fit_groups(df: DataFrame, keys: Sequence[str], spec: odr.FitSpec, rows: int = GROUP_ROWS) -> DataFrame:
    """The general solver by group: those of up to ``rows`` rows in a task each, all larger ones together by ``fit_batched``."""
    keys = list(keys)
    big = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows).select(*keys)
    if not big.limit(1).count():
        return _fit_small(df, keys, spec)
    big = small(saved(big))
    return _fit_small(same_keys(df, big, keys, "left_anti"), keys, spec).unionByName(fit_batched(same_keys(df, big, keys, "left_semi"), keys, spec))


def _sigma(spec: odr.FitSpec, v: str) -> Column:
    """A variable's uncertainty before it is clamped, as ``odr.prepare`` takes it."""
    if v in spec.sigmas:
        return F.col(f"`{spec.sigmas[v]}`")
    if spec.poisson and v in {la.dependent for la in spec.layers}:
        return F.sqrt(F.greatest(F.col(f"`{v}`"), F.lit(odr.MIN_VARIANCE)))
    return F.lit(0.0)


def _facts(spec: odr.FitSpec, need: Sequence[str]) -> list[Column]:
    """What a group's result needs besides the state: counts of what is wrong or clamped, moments, mean variances."""
    c = {n: F.col(f"`{n}`") for n in need}
    wrong = [F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias(f"_bad{k}") for k, x in enumerate(c.values())]
    deps = [la.dependent for la in spec.layers]
    sig = {v: _sigma(spec, v) for v in spec.variables}
    minus = [F.count_if(c[spec.sigmas[v]] < 0 if v in spec.sigmas else c[v] < 0 if spec.poisson and v in deps else F.lit(False)).alias(f"_neg{k}") for k, v in enumerate(spec.variables)]
    counted = [c[d] for d in deps if spec.poisson and d not in spec.sigmas]
    low = [F.coalesce(F.max(F.greatest(F.lit(False), F.lit(False), *(x < most for x in counted))), F.lit(False)).alias(n) for n, most in (("_low", 20), ("_zero", odr.MIN_VARIANCE))]
    clamped = F.lit(0)
    for x in sig.values():
        clamped = clamped + (x < odr.MIN_SIGMA).cast("int")
    moments = [a for k, d in enumerate(deps) for a in (F.sum(c[d]).alias(f"_s{k}"), F.sum(c[d] * c[d]).alias(f"_q{k}"))]
    spread = [F.avg(F.pow(F.greatest(x, F.lit(odr.MIN_SIGMA)), F.lit(2))).alias(f"_v{k}") for k, x in enumerate(sig.values())]
    return [F.count("*").alias("_n"), *wrong, *minus, *low, F.sum(clamped).alias("_c"), *moments, *spread]


def _refused(spec: odr.FitSpec, need: Sequence[str]) -> Column:
    """Why a group cannot be fitted, null if it can: what ``odr.prepare`` would say first."""
    bad, out = {n: F.col(f"_bad{k}") > 0 for k, n in enumerate(need)}, []
    for k, v in enumerate(spec.variables):
        out.append(F.when(bad[v], f"{v} holds nulls or non-finite values"))
        if v in spec.sigmas:
            out.append(F.when(bad[spec.sigmas[v]] | (F.col(f"_neg{k}") > 0), F.concat(F.lit(f"uncertainties of {v} must be "), F.col("_n").cast("string"), F.lit(" finite numbers of at least 0"))))
        else:
            out.append(F.when(F.col(f"_neg{k}") > 0, f"Poisson counts of {v} are negative"))
    return F.coalesce(*out, F.when(F.col("_n") < 2, "a fit needs at least 2 points"))


def condensable(spec: odr.FitSpec) -> bool:
    """Models of first degree in their independents, with given uncertainties: each sum over points that share
    their uncertainties is then a quadratic form of the values, whatever the parameters are."""
    for la in spec.layers:
        m = odr.compiled(la.formula, la.independents, spec.parameters, tuple(sorted((k.lower(), v) for k, v in spec.fixed.items())))
        if X.degree(m.parts["f"][0], m.xs) > 1:
            return False
    return not spec.poisson and not set(spec.sigmas.values()) & set(spec.variables)


#: Kinds of points (of a group and its uncertainties) that a task holds before it lets them go.
HELD = 20_000


def _condensed(points: DataFrame, spec: odr.FitSpec) -> DataFrame:
    """(_g, the spec's columns, _weight): few weighted points that have the sums of all, exact for ``condensable`` specs.

    Points of a group that share all uncertainties are a matrix with rows (1, values). Its triangular
    factor R has the same products and is found part by part: in each task, then over the tasks. Of v
    variables 2 v points follow, the mean plus and minus each row of R's rest, which have the points'
    moments of first and second order. No squares are formed, so near-perfect fits keep their digits.
    """
    names, sig = list(spec.variables), list(dict.fromkeys(spec.sigmas.values()))
    kind, wide = ["_g", *sig], len(names) + 1
    head = [points.schema[c] for c in kind]

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def told() -> pd.DataFrame:
            return pd.DataFrame([(*k, z.ravel().tolist()) for k, z in held.items()], columns=[*kind, "_z"])

        for pdf in batches:
            for k, own in pdf.groupby(kind, sort=False):
                z = np.column_stack([np.ones(len(own)), own[names].to_numpy(float)])
                held[k] = np.linalg.qr(np.concatenate([held[k], z]) if k in held else z, mode="r")
            if len(held) > HELD:
                yield told()
                held.clear()
        yield told()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.concatenate([np.array(z, float).reshape(-1, wide) for z in pdf["_z"]]), mode="r")
        v = len(names)
        root, mean, rest = r[0, 0], r[0, 1:] / r[0, 0], np.zeros((v, v))
        rest[: len(r) - 1] = r[1:, 1:] * np.sqrt(v) / root
        out = pd.DataFrame(np.concatenate([mean + rest, mean - rest]), columns=names)
        return out.assign(**{c: pdf[c].iloc[0] for c in kind}, _weight=root**2 / (2 * v))

    factors = points.select(*kind, *names).mapInPandas(parts, T.StructType([*head, T.StructField("_z", _A)]))
    return factors.groupBy(*kind).applyInPandas(whole, T.StructType([*head, *(T.StructField(c, _D) for c in names), T.StructField("_weight", _D)]))


def fit_batched(df: DataFrame, keys: Sequence[str], spec: odr.FitSpec, rows: int = GROUP_ROWS) -> DataFrame:
    """The general solver over all groups at once, however many and of whatever size: keys and the RESULT columns.

    A table holds each group's progress (``odr.Progress``: parameters, damping, sums, what it waits
    for). A round joins the points to the groups not yet done, sums each point's part of the
    objective, gradient and Hessian at its own group's parameters (inside the tasks first), and
    advances every group by one step; groups that are done leave the table. Rounds are as many as
    the slowest group needs; no group's points meet anywhere, and the driver sees only how many
    groups remain. Each round's table is written to the shared folder, and the one before removed.

    Where the model is of first degree in its independents and many points share their
    uncertainties, a few weighted points take the place of them all (``_condensed``), so the table is
    read twice and no more; a group that then has up to ``rows`` points runs its rounds in one task.

    Groups with null keys are groups. One that cannot be fitted gives a row with ``error``. The
    correlation, if any, is one matrix. An empty table gives no rows.
    """
    spark, keys, need = df.sparkSession, list(keys), spec.columns()
    q, size, names = len(spec.parameters), odr.flat_size(spec), [f.name for f in RESULT]
    start = np.array(spec.guesses if spec.guesses is not None else np.ones(q), float)
    if len(start) != q or not np.isfinite(start).all():
        raise DataError("guesses must be one finite number for each parameter")
    own = [f"_own{i}" for i in range(len(keys))]
    table = df.select(*(F.col(f"`{k}`").alias(o) for k, o in zip(keys, own)), *(F.col(f"`{c}`").cast("double").alias(c) for c in need))
    # an estimate, by which only the way is chosen
    kinds = F.approx_count_distinct(F.xxhash64(*(F.col(f"`{c}`") for c in dict.fromkeys(spec.sigmas.values())))) if spec.sigmas else F.lit(1).cast("long")
    facts = table.groupBy(*own).agg(*_facts(spec, need), kinds.alias("_kinds")).withColumn("_error", _refused(spec, need))
    groups = saved(facts.withColumn("_g", F.monotonically_increasing_id()))
    points = same_keys(table, small(groups.where("_error is null").select(*own, "_g")), own).select("_g", *need)
    n, kinds = groups.where("_error is null").agg(F.sum("_n"), F.sum("_kinds")).first()
    condensed = condensable(spec) and n is not None and 4 * len(spec.variables) * kinds <= n
    points = saved(_condensed(points, spec) if condensed else points.withColumn("_weight", F.lit(1.0)))

    def by_point(pdf: pd.DataFrame, beta: np.ndarray) -> np.ndarray:
        out = odr.flat_by_point(spec, odr.prepare(spec, {c: pdf[c].to_numpy() for c in need}), beta)
        out[:, :-1] *= pdf["_weight"].to_numpy()[:, None]  # the last counts regularisations, not points
        return out

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                pdf = pdf.sort_values("_g", kind="stable")
                g, beta = pdf["_g"].to_numpy(), np.stack(pdf["_at"].to_numpy())
                twice = [0, 0] if len(pdf) == 1 else slice(None)  # preparation asks for two points of a fit, not of a batch
                each = by_point(pdf.iloc[twice], beta[twice])[: len(g)]
                first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                total = np.add.reduceat(each, first)
                open_ = ~np.isfinite(total).all(axis=1)  # told by itself: NaN would turn null on its way, and be left out of sums
                total[open_] = 0
                yield pd.DataFrame(total, columns=[f"v{i}" for i in range(size)]).assign(_g=g[first], _open=open_.astype(int))

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for v, open_, was in zip(pdf[[f"v{i}" for i in range(size)]].to_numpy(), pdf["_open"], pdf["_numbers"]):
                try:
                    if open_ or not np.isfinite(v).all():
                        raise DataError("the model is not finite at some point")
                    p = odr.advance(spec, odr.begin(spec, start) if was is None else odr.Progress.of(spec, was), odr.unflat(spec, v))
                    out.append((p.numbers(), p.at.tolist(), p.phase == odr.DONE, None))
                except (MensuraError, np.linalg.LinAlgError) as e:
                    out.append((None, None, True, str(e)))
            yield pd.concat([pdf[["_g"]].reset_index(drop=True), pd.DataFrame(out, columns=["_numbers", "_at", "_done", "_failed"])], axis=1)

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        p = odr.begin(spec, start)
        try:
            while p.phase != odr.DONE:
                v = by_point(pdf, np.tile(p.at, (len(pdf), 1))).sum(0)
                if not np.isfinite(v).all():
                    raise DataError("the model is not finite at some point")
                p = odr.advance(spec, p, odr.unflat(spec, v))
            out = p.numbers(), p.at.tolist(), True, None
        except (MensuraError, np.linalg.LinAlgError) as e:
            out = None, None, True, str(e)
        return pd.DataFrame([(pdf["_g"].iloc[0], *out)], columns=["_g", "_numbers", "_at", "_done", "_failed"])

    progress = "_g bigint, _numbers array<double>, _at array<double>, _done boolean, _failed string"
    done = shared_dir(spark)
    spark.createDataFrame([], progress).write.parquet(done)
    open_groups = groups.where("_error is null").select("_g")
    if condensed:
        large = small(saved(points.groupBy("_g").agg(F.count("*").alias("_points")).where(F.col("_points") > rows).select("_g")))
        points.join(large, "_g", "left_anti").groupBy("_g").applyInPandas(alone, progress).write.mode("append").parquet(done)
        open_groups = open_groups.join(large, "_g", "left_semi")
    before, active = None, open_groups.select("_g", F.lit(None).cast("array<double>").alias("_numbers"), F.array(*map(F.lit, start.tolist())).alias("_at"))
    left = active.count()
    while left:
        asked = active.select("_g", "_at")
        at = points.join(F.broadcast(asked) if left <= SMALL else asked, "_g")
        parts = at.mapInPandas(sums, ", ".join(f"v{i} double" for i in range(size)) + ", _g bigint, _open bigint")
        summed = parts.groupBy("_g").agg(*(F.sum(c).alias(c) for c in (*(f"v{i}" for i in range(size)), "_open")))
        now = shared_dir(spark)
        after = saved(summed.join(active.select("_g", "_numbers"), "_g").mapInPandas(step, progress), now)
        ended, left = after.agg(F.count_if("_done"), F.count_if(~F.col("_done"))).first()
        if ended:
            after.where("_done").write.mode("append").parquet(done)
        if before:
            drop_path(spark, before)
        before, active = now, after.where(~F.col("_done"))

    def told(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.to_dict("records"):
                n, error = int(r["_n"]), r["_error"] if isinstance(r["_error"], str) else r["_failed"]
                if isinstance(error, str):
                    out.append(dict.fromkeys(names) | {"success": False, "error": error, "n": n})
                    continue
                p = odr.Progress.of(spec, r["_numbers"])
                dof = {v: float(n - 1 if d is None else d) for v, d in spec.type_a.items() if v in spec.variables}
                var = {v: r[f"_v{k}"] for k, v in enumerate(spec.variables)}
                below = sum((var[v] / sum(var.values())) ** 2 / d for v, d in dof.items() if d > 0)
                notes = {"clamped": int(r["_c"]), "low_counts": bool(r["_low"]), "zero_counts": bool(r["_zero"]), "inferred_dof": sum(spec.type_a[v] is None for v in dof), "input_dof": 1 / below if below > 0 else None}
                moments = {k: (n, r[f"_s{k}"], r[f"_q{k}"]) for k in range(len(spec.layers))}
                got = odr.respond(spec, p.beta, p.now, p.iteration, p.reason, n, moments, notes)
                out.append({k: got.get(k) for k in names} | {"n": n, "error": None})
            yield pd.concat([pdf[own].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    ended = groups.join(spark.read.schema(progress).parquet(done).select("_g", "_numbers", "_failed"), "_g", "left")
    out = ended.mapInPandas(told, T.StructType([*(T.StructField(o, df.schema[k].dataType) for k, o in zip(keys, own)), *RESULT]))
    return out.toDF(*keys, *names)


def fit_large(df: DataFrame, spec: odr.FitSpec) -> dict:
    """One fit over all rows: each evaluation is a job that returns one small row from each partition.

    Partitions send their part of the objective, gradient and Hessian, P(P+1)/2 + P + 3 + L numbers;
    only these sums and the parameters ever reach the driver. Keep ``df`` cached or in Parquet, it
    is scanned once for each step.
    """
    need = spec.columns()
    points = df.select(*(F.col(c).cast("double").alias(c) for c in need))
    q, layers = len(spec.parameters), len(spec.layers)
    deps = [la.dependent for la in spec.layers]
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))) for c in need]
    small = [F.count_if(F.col(c) < odr.MIN_SIGMA) for c in spec.sigmas.values()]
    sums = [f(d) for d in deps for f in (lambda d: F.sum(d), lambda d: F.sum(F.col(d) * F.col(d)))]
    head = points.agg(F.count("*"), *bad, *small, *sums).first()
    n = head[0]
    if any(head[1 : 1 + len(need)]):
        raise DataError("variables hold nulls or non-finite values")
    if n < 2:
        raise DataError("a fit needs at least 2 points")
    clamped = sum(head[1 + len(need) : 1 + len(need) + len(small)]) + n * sum(v not in spec.sigmas and not (spec.poisson and v in deps) for v in spec.variables)
    moments = head[1 + len(need) + len(small) :]
    tri = np.triu_indices(q)

    def at(beta: np.ndarray) -> odr.State:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for pdf in parts:
                if len(pdf):
                    cols = {c: pdf[c].to_numpy() for c in need}
                    if len(pdf) == 1:  # preparation asks for two points of the whole, not of a batch
                        cols = {c: np.repeat(v, 2) for c, v in cols.items()}
                    s = odr.evaluate(spec, odr.prepare(spec, cols), beta)
                    if len(pdf) == 1:
                        s = odr.State(s.chi2 / 2, s.chi2_obs / 2, s.gradient / 2, s.hessian / 2, s.ssr / 2, s.unconverged // 2, s.jitter)
                    total = s if total is None else total + s
            if total is not None:
                flat = [total.chi2, total.chi2_obs, *total.gradient, *total.hessian[tri], *total.ssr, total.unconverged, total.jitter]
                yield pd.DataFrame({"v": [flat]})

        rows = points.mapInPandas(run, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
        v = np.array([r.s for r in rows])
        h = np.zeros((q, q))
        h[tri] = v[2 + q : 2 + q + len(tri[0])]
        rest = v[2 + q + len(tri[0]) :]
        return odr.State(v[0], v[1], v[2 : 2 + q], h + np.triu(h, 1).T, rest[:layers], int(rest[layers]), int(rest[layers + 1]))

    start = np.array(spec.guesses if spec.guesses is not None else np.ones(q), float)
    beta, s, it, reason = odr.solve(spec, at, start)
    by = {i: (n, moments[2 * i], moments[2 * i + 1]) for i in range(layers)}
    return odr.respond(spec, beta, s, it, reason, n, by, {"clamped": clamped})


# ---------------------------------------------------------------- closed forms


def normal_matrix(df: DataFrame, columns: Sequence[str], weight: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted sums of products of every two columns (``a_b``), aggregated before any shuffle."""
    w = F.lit(1.0) if weight is None else weight
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    aggs = [F.sum(w * F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]
    return (df.groupBy(*keys) if keys else df.groupBy()).agg(*aggs)


def fit_line(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), sigma: str | None = None) -> DataFrame:
    """Weighted least squares of y = slope * x + intercept by sums alone: keys, n, slope, intercept,
    slope_sigma, intercept_sigma (raw with ``sigma``, else scaled by the residuals), chi2, r2."""
    X_, Y = F.col(x).cast("double"), F.col(y).cast("double")
    w = F.lit(1.0) if sigma is None else 1 / (F.col(sigma) * F.col(sigma))
    rows = df.select(*keys, X_.alias("_x"), Y.alias("_y"), w.alias("_w"))
    s = lambda e, n: F.sum(F.expr(e)).alias(n)
    # sums about the means of the group keep the differences exact enough
    mean = rows.groupBy(*keys).agg(F.count("*").alias("n"), s("_w", "sw"), s("_w*_x", "swx"), s("_w*_y", "swy"), s("_w*_x*_x", "swxx"), s("_w*_x*_y", "swxy"), s("_w*_y*_y", "swyy"))
    sxx, sxy, syy = F.expr("swxx - swx*swx/sw"), F.expr("swxy - swx*swy/sw"), F.expr("swyy - swy*swy/sw")
    out = mean.withColumns({"_sxx": sxx, "_sxy": sxy, "_syy": syy}).withColumn("slope", F.try_divide("_sxy", "_sxx"))
    out = out.withColumn("intercept", F.expr("(swy - slope*swx)/sw")).withColumn("chi2", F.expr("_syy - slope*_sxy"))
    scale = F.lit(1.0) if sigma else F.expr("try_divide(chi2, n - 2)")
    return out.select(
        *keys, "n", "slope", "intercept", F.sqrt(scale * F.expr("try_divide(1, _sxx)")).alias("slope_sigma"), F.sqrt(scale * F.expr("try_divide(swxx, sw*_sxx)")).alias("intercept_sigma"), "chi2", F.expr("try_divide(_sxy*_sxy, _sxx*_syy)").alias("r2")
    )


def fit_deming(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), ratio: float = 1.0) -> DataFrame:
    """Errors in both variables with a constant ratio of variances var(y)/var(x): the closed form."""
    rows = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    m = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.var_pop("_x").alias("sxx"), F.var_pop("_y").alias("syy"), F.covar_pop("_x", "_y").alias("sxy"))
    d = F.lit(ratio)
    t = F.col("syy") - d * F.col("sxx")
    slope = F.try_divide(t + F.sqrt(t * t + 4 * d * F.col("sxy") * F.col("sxy")), 2 * F.col("sxy"))
    return m.withColumn("slope", slope).select(*keys, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def residuals(df: DataFrame, formula: str, dependent: str, columns: dict[str, str], parameters: dict[str, float]) -> DataFrame:
    """Adds ``fitted`` and ``residual`` as built-in expressions, for given parameter values."""
    e = X.substitute(X.parse(formula, [*columns, *parameters]), {k.lower(): v for k, v in parameters.items()})
    out = df.withColumn("fitted", X.to_column(e, {k.lower(): F.col(c).cast("double") for k, c in columns.items()}))
    return out.withColumn("residual", F.col(dependent).cast("double") - F.col("fitted"))


def fit_metrics(df: DataFrame, dependent: str, fitted: str, keys: Sequence[str] = (), sigma: str | None = None, parameters: int = 0) -> DataFrame:
    """n, ssr, sst, rmse, rse, r2 and (with sigma) chi2 of a table of fitted values."""
    y, r = F.col(dependent).cast("double"), F.col(dependent).cast("double") - F.col(fitted)
    aggs = [F.count("*").alias("n"), F.sum(r * r).alias("ssr"), (F.var_pop(y) * F.count("*")).alias("sst")]
    if sigma:
        aggs.append(F.sum(r * r / (F.col(sigma) * F.col(sigma))).alias("chi2"))
    out = df.groupBy(*keys).agg(*aggs)
    return out.withColumns({"rmse": F.sqrt(F.col("ssr") / F.col("n")), "rse": F.sqrt(F.try_divide(F.col("ssr"), F.col("n") - parameters)), "r2": F.when(F.col("sst") > 0, 1 - F.col("ssr") / F.col("sst")).otherwise(1.0)})
