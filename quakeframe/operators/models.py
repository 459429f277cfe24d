"""Layered and segmented one-dimensional models, their constraints and priors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import RHO_SCALINGS, VP_SCALINGS
from ..session import bounded, settle
from .grid import gradient


def _value(depth: Column) -> Column:
    """Value of a segment row at a depth inside it."""
    share = (depth - F.col("top")) / (F.col("bottom") - F.col("top"))
    return F.when(F.col("profile") == "constant", F.col("v_top")).otherwise(F.col("v_top") + (F.col("v_bottom") - F.col("v_top")) * share)


def profile_at_depths(segments: DataFrame, depths: DataFrame) -> DataFrame:
    """``depths`` (model_id, depth) with ``vs``: intervals are [top, bottom), the last is closed; NULL outside the model."""
    last = F.max("bottom").over(Window.partitionBy("model_id"))
    s = segments.withColumn("__last", last)
    on = [depths["model_id"] == s["model_id"], depths["depth"] >= s["top"], (depths["depth"] < s["bottom"]) | ((depths["depth"] == s["bottom"]) & (s["bottom"] == s["__last"]))]
    return depths.join(s, on, "left").select(depths["model_id"], depths["depth"], _value(depths["depth"]).alias("vs"))


def layer_at_depths(layers: DataFrame, depths: DataFrame) -> DataFrame:
    """``depths`` with the layer's vs; a depth on an interface belongs to the deeper layer, below the last one to the half-space."""
    w = Window.partitionBy("model_id").orderBy("layer")
    t = F.coalesce(F.sum("thickness").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = layers.withColumn("top", t).withColumn("bottom", F.lead("top").over(w))
    on = [depths["model_id"] == d["model_id"], depths["depth"] >= d["top"], d["bottom"].isNull() | (depths["depth"] < d["bottom"])]
    return depths.join(d, on, "left").select(depths["model_id"], depths["depth"], d["vs"])


def resolve_parameters(segments: DataFrame, draws: DataFrame, column: str = "v_top", name: str = "v_top_name", by: tuple[str, ...] = ()) -> DataFrame:
    """Segments of every draw: a named parameter takes the draw's value, a literal stays. ``draws`` is long (station, chain, step, parameter, value).

    ``segments`` is one model's small table, or with ``by`` the tables of many models: columns of both tables that name a draw's model.
    """
    key = ["station", "chain", "step", *by]
    # A draw becomes one row with its few values before it meets its segments, so no segment row is shuffled.
    each = draws.groupBy(*key).agg(F.collect_list(F.struct(F.col("parameter").alias("n"), F.col("value").alias("v"))).alias("__own"))
    every = each.join(segments, list(by)) if by else each.crossJoin(bounded(segments))
    named = F.transform(F.filter("__own", lambda x: x["n"] == F.col(name)), lambda x: x["v"])
    found = every.withColumn("__named", named).drop("__own")
    return found.select(*[c for c in found.columns if c != "__named"], F.explode_outer("__named").alias("__v")).withColumn(column, F.coalesce("__v", column)).drop("__v")


def unknown_parameters(segments: DataFrame, draws: DataFrame, name: str = "v_top_name") -> DataFrame:
    """Names that segments use and no draw has."""
    used = segments.filter(F.col(name).isNotNull()).select(F.col(name).alias("parameter")).distinct()
    return used.join(draws.select("parameter").distinct(), "parameter", "left_anti")


def depth_axis(spark: SparkSession, dz: float, zmax: float) -> DataFrame:
    """Depths from 0 to zmax, the end included within half a step."""
    return depth_axes(spark.range(1).select(F.lit(zmax).alias("zmax")), dz, ()).select("depth")


def depth_axes(ends: DataFrame, dz: float, keys: tuple[str, ...] = ("model_id",)) -> DataFrame:
    """(keys, depth): the depth axis of every row of ``ends`` (keys, zmax)."""
    last = F.floor((F.col("zmax") + dz / 2) / dz).cast("int")
    return ends.select(*keys, F.explode(F.sequence(F.lit(0), last)).alias("j")).select(*keys, (F.col("j") * dz).alias("depth"))


def profile_checks(profile: DataFrame, monotonic_tol: float = 0.0, max_gradient: float | None = None, bounds: tuple[float, float] | None = None, depth_range: tuple[float, float] | None = None) -> DataFrame:
    """(model_id, monotonic, gradient, in_range) over depth samples (model_id, depth, vs); segment edges are samples too, each depth once."""
    # Dealt before anything is held by depth: a small table of models may be one partition, however many samples it gives.
    profile = profile.repartition("model_id")
    d = profile.groupBy("model_id", "depth").agg(F.last("vs").alias("vs")) if "seg" not in profile.columns else profile.groupBy("model_id", "depth").agg(F.max_by("vs", "seg").alias("vs"))
    if depth_range is not None:
        d = d.filter(F.col("depth").between(*depth_range))
    w = Window.partitionBy("model_id").orderBy("depth")
    d = d.withColumns({"dv": F.col("vs") - F.lag("vs").over(w), "dz": F.col("depth") - F.lag("depth").over(w)})
    ok = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    slope = F.lit(True) if max_gradient is None else ok(F.abs(F.col("dv") / F.col("dz")) <= max_gradient)
    inside = F.lit(True) if bounds is None else ok(F.col("vs").between(*bounds))
    return d.groupBy("model_id").agg(ok(F.col("dv") >= -monotonic_tol).alias("monotonic"), slope.alias("gradient"), inside.alias("in_range"))


def boundary_check(segments: DataFrame, tol: float = 0.0) -> DataFrame:
    """(model_id, boundary): vs does not drop by more than ``tol`` where a segment ends and the next begins."""
    before = F.lag(F.when(F.col("profile") == "constant", F.col("v_top")).otherwise(F.col("v_bottom"))).over(Window.partitionBy("model_id").orderBy("seg"))
    d = segments.withColumn("drop", before - F.col("v_top"))
    return d.groupBy("model_id").agg(F.coalesce(F.bool_and(F.col("drop") <= tol), F.lit(True)).alias("boundary"))


def evaluate_constraints(models: DataFrame, rules: dict[str, Column], keys: tuple[str, ...] = ("model_id",)) -> DataFrame:
    """(keys, failed, valid, log_prior) from rows of layers: names of the rules that any row breaks, and 0 or -Infinity. A missing value breaks its rule."""
    broken = F.array(*[F.when(F.bool_or(~F.coalesce(ok, F.lit(False))), F.lit(n)) for n, ok in rules.items()])
    d = models.groupBy(*keys).agg(F.array_sort(F.filter(broken, lambda x: x.isNotNull())).alias("failed"))
    return d.withColumns({"valid": F.size("failed") == 0, "log_prior": F.when(F.size("failed") == 0, 0.0).otherwise(float("-inf"))})


def physical_rules(margin: float = 0.0, ratio: tuple[float, float] = (1.4, 2.5)) -> dict[str, Column]:
    """Positive velocities, vp above vs by a margin, and a range of vp / vs."""
    return {"positive": (F.col("vs") > 0) & (F.col("vp") > 0) & (F.col("rho") > 0), "vp_margin": F.col("vp") - F.col("vs") > margin, "vp_vs": (F.col("vp") / F.col("vs")).between(*ratio)}


def curvature_prior(profile: DataFrame, sigma: float) -> DataFrame:
    """(model_id, rms, log_prior): depth-averaged rms of the second derivative inside each segment, never across.

    ``profile`` has evenly ordered samples (model_id, seg, depth, vs) of every segment, its ends included.
    """
    w = Window.partitionBy("model_id", "seg").orderBy("depth")
    d = profile.select(F.col("model_id").alias("period_s"), F.col("seg").alias("source"), F.lit(0).alias("i_lat"), (F.row_number().over(w) - 1).alias("i_lon"), F.col("depth").alias("x_km"), F.lit(0.0).alias("y_km"), F.col("vs").alias("value"))
    d = gradient(gradient(d, "lon", "value", "g1"), "lon", "g1", "g2")
    o = Window.partitionBy("period_s", "source").orderBy("i_lon")
    nz = F.lead("x_km").over(o) - F.col("x_km")
    area = nz * (F.col("g2") ** 2 + F.lead("g2").over(o) ** 2) / 2
    e = d.withColumns({"e": area, "l": nz}).groupBy(F.col("period_s").alias("model_id")).agg(F.sqrt(F.sum("e") / F.sum("l")).alias("rms"))
    return e.withColumn("log_prior", -0.5 * (F.col("rms") / sigma) ** 2)


#: Soft priors by name; further ones may be added. Each takes a profile (model_id, seg, depth, vs) and its own settings and
#: returns one row a model: model_id, log_prior, and what else it found out. A NULL log_prior makes the model invalid.
SOFT_PRIORS: dict[str, Callable[..., DataFrame]] = {"curvature": curvature_prior}


def soft_priors(profile: DataFrame, wanted: dict[str, dict]) -> DataFrame:
    """(model_id, log_prior, log_<name>, <name>_<finding>...): the sum of the wanted priors, -Infinity where one gives no value.

    ``wanted`` names registered priors with their settings. Without any the sum is 0.
    """
    unknown = sorted(set(wanted) - set(SOFT_PRIORS))
    if unknown:
        raise ValueError(f"unknown soft priors {unknown}; there are {sorted(SOFT_PRIORS)}")
    d = profile.select("model_id").distinct()
    total = F.lit(0.0)
    for name, settings in wanted.items():
        found = SOFT_PRIORS[name](profile, **settings)
        missing = {"model_id", "log_prior"} - set(found.columns)
        if missing:
            raise ValueError(f"the soft prior {name} lacks {sorted(missing)}")
        d = d.join(found.select("model_id", F.col("log_prior").alias(f"log_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in found.columns if c not in ("model_id", "log_prior")]), "model_id", "left")
        d = d.withColumn(f"log_{name}", F.coalesce(F.col(f"log_{name}"), F.lit(float("-inf"))))
        total = total + F.col(f"log_{name}")
    return d.withColumn("log_prior", total)


def layers_from_profile(segments: DataFrame, dz: float, vp: str = "brocher2005", rho: str = "brocher2005") -> DataFrame:
    """(model_id, layer, thickness, vs, vp, rho): each segment in ceil(range / dz) equal layers with midpoint values, then a half-space with the value at the bottom."""
    n = F.ceil((F.col("bottom") - F.col("top")) / dz - 1e-9).cast("int")
    d = segments.withColumn("n", n).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    h = (F.col("bottom") - F.col("top")) / F.col("n")
    inner = d.select("model_id", "seg", "j", h.alias("thickness"), _value(F.col("top") + (F.col("j") + 0.5) * h).alias("vs"))
    end = segments.groupBy("model_id").agg(F.max_by(F.when(F.col("profile") == "constant", F.col("v_top")).otherwise(F.col("v_bottom")), "seg").alias("vs"), (F.max("seg") + 1).alias("seg"))
    d = inner.unionByName(end.select("model_id", "seg", F.lit(0).alias("j"), F.lit(0.0).alias("thickness"), "vs"))
    layer = F.row_number().over(Window.partitionBy("model_id").orderBy("seg", "j")) - 1
    return d.select("model_id", layer.alias("layer"), "thickness", "vs", VP_SCALINGS[vp](F.col("vs")).alias("vp"), RHO_SCALINGS[rho](F.col("vs")).alias("rho"))


def layers_from_tops(tops: DataFrame) -> DataFrame:
    """``tops`` (model_id, depth, ...) with ``thickness``: the way to the next top, 0 for the last."""
    w = Window.partitionBy("model_id").orderBy("depth")
    return tops.withColumn("thickness", F.coalesce(F.lead("depth").over(w) - F.col("depth"), F.lit(0.0)))


def segments_from_samples(samples: DataFrame) -> DataFrame:
    """Gradient segments between neighbouring samples (model_id, depth, vs)."""
    w = Window.partitionBy("model_id").orderBy("depth")
    d = samples.withColumns({"bottom": F.lead("depth").over(w), "v_bottom": F.lead("vs").over(w), "seg": (F.row_number().over(w) - 1).cast("int")})
    return d.filter("bottom IS NOT NULL").select("model_id", "seg", F.col("depth").alias("top"), "bottom", F.lit("gradient").alias("profile"), F.col("vs").alias("v_top"), "v_bottom")


def parameter_prior(draws: DataFrame, bounds: DataFrame) -> DataFrame:
    """(station, chain, step, log_prior): 0 inside the closed bounds of every parameter, else -Infinity. ``bounds`` lists each parameter once."""
    d = draws.join(bounded(bounds), "parameter", "left")
    inside = F.bool_and(F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False)))
    return d.groupBy("station", "chain", "step").agg(F.when(inside, 0.0).otherwise(float("-inf")).alias("log_prior"))


#: Numbers of the normal equations that are held at once.
HELD = 1 << 20


def bspline_basis(n: int, degree: int, z: np.ndarray, spacing: float = 1.0) -> np.ndarray:
    """Cox-de Boor basis values (len(z), n) of clamped B-splines on [0, 1]; knot intervals grow by ``spacing`` from one to the next."""
    inner = n - degree
    steps = spacing ** np.arange(inner)
    knots = np.concatenate([np.zeros(degree), np.concatenate([[0], np.cumsum(steps)]) / steps.sum(), np.ones(degree)])
    z = np.asarray(z, float)
    span = np.clip(np.searchsorted(knots, z, "right") - 1, degree, n - 1)
    b = (np.arange(len(knots) - 1)[None, :] == span[:, None]).astype(float)
    for d in range(1, degree + 1):
        out = np.zeros((len(z), len(knots) - 1 - d))
        for i in range(out.shape[1]):
            left, right = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            out[:, i] = (b[:, i] * (z - knots[i]) / left if left > 0 else 0) + (b[:, i + 1] * (knots[i + d + 1] - z) / right if right > 0 else 0)
        b = out
    return b


def basis_table(spark: SparkSession, n: int, degree: int, depths: list[float], spacing: float = 1.0) -> DataFrame:
    """(j, depth, b): a basis over the depth range, shared by all models of one specification."""
    z = np.array(depths)
    b = bspline_basis(n, degree, (z - z.min()) / (z.max() - z.min()), spacing)
    return spark.createDataFrame([(j, float(d), float(b[i, j])) for i, d in enumerate(z) for j in range(n)], "j int, depth double, b double")


def spline_profile(coefficients: DataFrame, basis: DataFrame) -> DataFrame:
    """(model_id, depth, vs): basis times coefficients (model_id, j, value)."""
    # Dealt before each coefficient becomes as many rows as the basis has depths.
    return coefficients.repartition("model_id").join(bounded(basis), "j").groupBy("model_id", "depth").agg(F.sum(F.col("value") * F.col("b")).alias("vs"))


def spline_normal_sums(samples: DataFrame, basis: DataFrame) -> DataFrame:
    """(model_id, i, j, a): the normal equations of weighted least squares on (model_id, depth, vs, weight), i <= j; i = -1 is the right side.

    Rows and values are multiplied by the weight, so sums hold its square. Only the few basis functions that are not
    zero at a depth meet each other: the sums are a band, and each sample gives a fixed number of terms. The basis is
    one row for each depth.
    """
    at = basis.filter("b <> 0").groupBy("depth").agg(F.array_sort(F.collect_list(F.struct("j", "b"))).alias("f"))
    d = samples.filter(F.col("vs").isNotNull() & F.col("weight").isNotNull()).join(bounded(at), "depth")
    w2 = F.col("weight") * F.col("weight")
    term = lambda i, j, a: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), a.alias("a"))
    band = F.flatten(F.transform("f", lambda x, k: F.transform(F.slice(F.col("f"), k + 1, F.size("f")), lambda y: term(x["j"], y["j"], w2 * x["b"] * y["b"]))))
    right = F.transform("f", lambda x: term(F.lit(-1), x["j"], w2 * x["b"] * F.col("vs")))
    return d.select("model_id", F.inline(F.concat(band, right))).groupBy("model_id", "i", "j").agg(F.sum("a").alias("a"))


def solve_splines(b: np.ndarray, n: np.ndarray, mean: np.ndarray, m2: np.ndarray, w2: np.ndarray, right: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, rms) of many models: a basis (depths, j), and what each model's samples sum up to at every depth (models, depths).

    ``n``, ``mean`` and ``m2`` are the number of values, their mean and their squares about it; ``w2`` and ``right`` sum
    the squared weights and these times the values. Of equally good coefficients the smallest are taken.
    """
    size = b.shape[1]
    m = ((w2[:, None, :] * b.T).reshape(-1, len(b)) @ b).reshape(-1, size, size) + penalty
    c = (np.linalg.pinv(m, rcond=np.finfo(float).eps * size, hermitian=True) @ (right @ b)[..., None])[..., 0]
    return c, np.sqrt((m2 + n * (mean - c @ b.T) ** 2).sum(axis=1) / n.sum(axis=1))


def fit_spline_coefficients(samples: DataFrame, basis: DataFrame, smoothing: float = 0.0) -> DataFrame:
    """(model_id, j, value, rms) of weighted least squares on (model_id, depth, vs, weight), with an optional penalty on second differences.

    A model's samples become one row of sums for each depth of the basis, which holds its normal equations
    (``spline_normal_sums``) and the root mean square of the residuals, which are not weighted. So samples are read once,
    and the small systems are solved many at a time. A model without a weighted value gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    cells = basis.toPandas()
    depths, size = np.unique(cells.loc[cells["b"] != 0, "depth"]), int(cells["j"].max()) + 1
    full, used = np.zeros((len(depths), size)), cells[cells["b"] != 0]
    full[np.searchsorted(depths, used["depth"]), used["j"].astype(int)] = used["b"]
    second = np.diff(np.eye(size), 2, axis=0) if smoothing > 0 and size > 2 else np.zeros((0, size))
    spark = samples.sparkSession
    settle(spark)
    shared = spark.sparkContext.broadcast((full, smoothing * second.T @ second))
    at = spark.createDataFrame([(float(d), k) for k, d in enumerate(depths)], "depth double, k int")

    vs, weight = F.col("vs").cast("double"), F.col("weight").cast("double")
    w2 = F.when(F.col("vs").isNotNull(), weight * weight)
    sums = {"n": F.count("vs").cast("double"), "mean": F.avg(vs), "m2": F.var_pop(vs) * F.count("vs"), "w2": F.coalesce(F.sum(w2), F.lit(0.0)), "right": F.coalesce(F.sum(w2 * vs), F.lit(0.0)), "weighted": F.count(w2)}
    d = samples.filter(F.col("model_id").isNotNull()).join(bounded(at), "depth").filter("vs IS NOT NULL").groupBy("model_id", "k").agg(*[c.alias(name) for name, c in sums.items()])
    names = ["n", "mean", "m2", "w2", "right"]
    rows = d.groupBy("model_id").agg(F.collect_list(F.struct("k", *names)).alias("s"), F.sum("weighted").alias("weighted")).filter("weighted > 0").select("model_id", *[F.col(f"s.{c}").alias(c) for c in ("k", *names)])
    kind = samples.schema["model_id"].dataType.simpleString()
    ddl = f"model_id {kind}, c array<double>, rms double"
    target = to_arrow_schema(type(rows.schema).fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, penalty = shared.value
        step = max(1, HELD // (b.shape[1] * max(b.shape)))
        for batch in batches:
            for start in range(0, len(batch), step):
                some = batch.slice(start, step)
                place = np.repeat(np.arange(len(some)), some.column("k").value_lengths().to_numpy()), some.column("k").flatten().to_numpy()
                held = np.zeros((len(names), len(some), len(b)))
                for out, c in zip(held, names, strict=True):
                    out[place] = some.column(c).flatten().to_numpy(zero_copy_only=False)
                c, rms = solve_splines(b, *held, penalty)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * b.shape[1], pa.int32()), pa.array(c.ravel()))
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip((some.column("model_id"), listed, pa.array(rms)), target, strict=True)], schema=target)

    return rows.mapInArrow(run, ddl).select("model_id", F.posexplode("c").alias("j", "value"), "rms")
