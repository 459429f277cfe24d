"""Fits of predictions to observations, and summaries of posterior draws."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded, cut
from .ranges import aside, same

QUANTILES = (0.01, 0.05, 0.16, 0.5, 0.84, 0.95, 0.99)
DRAW = ("station", "chain", "step")


def residual_join(obs: DataFrame, pred: DataFrame, tol: float = 1e-8) -> DataFrame:
    """(station, observable, model_id, period, value, sigma, predicted, unmatched): observed and predicted values by period.

    Both sides of a model are sorted together, once: a value and its partner within the tolerance are neighbours, and a
    pair is two neighbours of different sides of which each is the other's nearest (the lower one on ties). So every row
    has one partner at most; equal periods pair in turn. Rows that lack a partner are kept with ``unmatched``.
    """
    by = ["station", "observable", "model_id"]
    models = pred.select(*by).distinct()
    o = models.join(obs, ["station", "observable"]).select(*by, F.lit(0).alias("__side"), "period", "value", "sigma", F.lit(None).cast("double").alias("predicted"))
    p = pred.select(*by, F.lit(1).alias("__side"), "period", F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("sigma"), "predicted")
    turn = F.row_number().over(Window.partitionBy(*by, "__side", "period").orderBy("value", "sigma", "predicted"))
    d = o.unionByName(p).withColumn("__turn", turn)
    w = Window.partitionBy(*by).orderBy("period", "__turn", "__side")

    def gap(f: Callable[..., Column]) -> Column:
        away = F.abs(f("period").over(w) - F.col("period"))
        in_turn = (away > 0) | (f("__turn").over(w) == F.col("__turn"))
        return F.when((f("__side").over(w) != F.col("__side")) & (away <= tol) & in_turn, away)

    d = d.withColumns({"__back": gap(F.lag), "__ahead": gap(F.lead)})
    step = F.when(F.col("__back") <= F.coalesce("__ahead", F.lit(float("inf"))), -1).when(F.col("__ahead").isNotNull(), 1).otherwise(0)
    d = d.withColumn("__to", step)
    paired = F.when((F.col("__to") == -1) & (F.lag("__to").over(w) == 1), -1).when((F.col("__to") == 1) & (F.lead("__to").over(w) == -1), 1).otherwise(0)
    d = d.withColumns({"__pair": paired, "__lp": F.lag("predicted").over(w), "__np": F.lead("predicted").over(w)})
    found = F.when(F.col("__pair") == -1, F.col("__lp")).when(F.col("__pair") == 1, F.col("__np")).otherwise(F.col("predicted"))
    return d.filter((F.col("__side") == 0) | (F.col("__pair") == 0)).select(*by, "period", "value", "sigma", found.alias("predicted"), (F.col("__pair") == 0).alias("unmatched"))


def gaussian_fit(rows: DataFrame, weight: float = 1.0, keys: tuple[str, ...] = ("station", "model_id", "observable")) -> DataFrame:
    """(keys, n, chi2, misfit, weighted_chi2, log_likelihood) of residual rows; a group with an unmatched row has failed and is NULL."""
    r = (F.col("predicted") - F.col("value")) / F.col("sigma")
    d = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(r * r).alias("chi2"), F.max("unmatched").alias("__bad"))
    d = d.withColumn("chi2", F.when(~F.col("__bad"), F.col("chi2"))).drop("__bad")
    return d.withColumns({"misfit": F.sqrt(F.col("chi2") / F.col("n")), "weighted_chi2": weight * F.col("chi2"), "log_likelihood": -0.5 * weight * F.col("chi2")})


def joint_fit(fits: DataFrame, models: DataFrame, weights: dict[str, float] | None = None, keys: tuple[str, ...] = ("station", "model_id")) -> DataFrame:
    """One row per model: sums over its observables; weight 0 skips one, a failed or absent fit gives -Infinity."""
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("observable")], F.lit(1.0))
    used = fits.withColumn("__w", w).filter("__w > 0")
    d = used.groupBy(*keys).agg(F.sum("log_likelihood").alias("ll"), F.sum("chi2").alias("chi2"), F.sum("weighted_chi2").alias("weighted_chi2"), F.sum("n").alias("n"), F.max(F.col("chi2").isNull()).alias("__bad"))
    out = models.select(*keys).distinct().join(d, list(keys), "left")
    bad = F.coalesce("__bad", F.lit(True))
    return out.select(*keys, "n", F.when(~bad, F.col("chi2")).alias("chi2"), F.when(~bad, F.col("weighted_chi2")).alias("weighted_chi2"), F.when(~bad, F.sqrt(F.col("chi2") / F.col("n"))).alias("misfit"), F.when(bad, float("-inf")).otherwise(F.col("ll")).alias("log_likelihood"), (~bad).alias("valid"))


def posterior_table(priors: DataFrame, fits: DataFrame, keys: tuple[str, ...] = ("station", "model_id")) -> DataFrame:
    """(keys, log_posterior, error): prior plus likelihood; a failed prior needs no fit, a failed fit gives -Infinity."""
    d = priors.join(fits.select(*keys, "log_likelihood"), list(keys), "left")
    no_prior = F.col("log_prior") == float("-inf")
    no_fit = F.col("log_likelihood").isNull() | (F.col("log_likelihood") == float("-inf"))
    return d.select(*keys, F.when(no_prior | no_fit, float("-inf")).otherwise(F.col("log_prior") + F.col("log_likelihood")).alias("log_posterior"), F.when(no_prior, "prior").when(no_fit, "fit").alias("error"))


#: Rows of a group up to which its values go into one aggregation buffer, and bins that an interval is cut into.
BUFFERED, BINS = 1 << 20, 1 << 12


def exact_quantiles(samples: DataFrame, keys: tuple[str, ...], value: str = "value", quantiles: tuple[float, ...] = QUANTILES, bins: int = BINS) -> DataFrame:
    """(keys, q01...): exact quantiles between neighbouring ranks, in memory that does not depend on a group's size; NULLs are ignored.

    Selection by counting: the range of a group is cut into bins, which are counted on the map side with their smallest
    and largest values. Running counts name the bin of each wanted rank, and its values are the next range, until all
    values of the bin are equal. A pass reads only values inside a wanted range, and makes at most ``bins`` rows of each.
    """
    v = F.col(value).cast("double")
    rows = samples.filter(F.col(value).isNotNull()).select(*keys, v.alias("__v"))
    key = list(keys)
    first = rows.groupBy(*key).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.lit(float(p)).alias("p")) for i, p in enumerate(quantiles)])).alias("__x")
    h = F.col("__x.p") * (F.col("__n") - 1)
    ranks = first.select(*key, "__n", "__lo", "__hi", place).select(*key, "__lo", "__hi", F.explode(F.array(F.floor(h), F.least(F.floor(h) + 1, F.col("__n") - 1))).alias("__rank")).distinct()
    todo = cut(ranks.withColumn("__below", F.lit(0).cast("long")))
    done = None
    while True:
        settled = todo.filter("__lo = __hi").select(*key, "__rank", F.col("__lo").alias("__value"))
        done = settled if done is None else done.unionByName(settled)
        todo = todo.filter("__lo < __hi")
        spans = cut(todo.select(*key, "__lo", "__hi", "__below").distinct())
        if spans.isEmpty():
            break
        held = rows.join(bounded(aside(spans, keys)), same(keys) & F.col("__v").between(F.col("__lo"), F.col("__hi"))).select(*key, "__lo", "__hi", "__below", "__v")
        # Halves are scaled, so that a range of any width has a finite one; the ends always fall into different bins.
        part = F.floor(F.try_divide(F.col("__v") / 2 - F.col("__lo") / 2, F.col("__hi") / 2 - F.col("__lo") / 2) * (bins - 1)).cast("int")
        part = F.when(F.col("__v") == F.col("__hi"), bins - 1).otherwise(F.least(F.coalesce(part, F.lit(0)), F.lit(bins - 2)))
        binned = held.groupBy(*key, "__lo", "__below", part.alias("__bin")).agg(F.count("*").alias("__c"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
        w = Window.partitionBy(*key, "__lo").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
        binned = binned.withColumn("__start", F.col("__below") + F.coalesce(F.sum("__c").over(w), F.lit(0)))
        wanted = todo.select(*key, F.col("__lo").alias("__from"), "__rank")
        hit = (F.col("__from") == F.col("__lo")) & (F.col("__rank") >= F.col("__start")) & (F.col("__rank") < F.col("__start") + F.col("__c"))
        bins_ = aside(binned.drop("__below"), keys)
        todo = cut(wanted.join(bins_, same(keys) & hit).select(*key, F.col("__min").alias("__lo"), F.col("__max").alias("__hi"), "__rank", F.col("__start").alias("__below")))
    values = done.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__value"))).alias("__r"))
    d = first.select(*key, "__n").join(aside(values, keys), same(keys)).select(*key, "__n", "__r")

    def between(p: float) -> Column:
        at = F.lit(float(p)) * (F.col("__n") - 1)
        low, high = F.floor(at), F.least(F.floor(at) + 1, F.col("__n") - 1)
        a, b = F.element_at("__r", low), F.element_at("__r", high)
        return F.when(a == b, a).otherwise((1 - (at - low)) * a + (at - low) * b)

    return d.select(*key, *[between(p).alias(f"q{round(100 * p):02d}") for p in quantiles])


def ensemble_summary(samples: DataFrame, keys: tuple[str, ...], value: str = "value", quantiles: tuple[float, ...] = QUANTILES, buffered: int = BUFFERED) -> DataFrame:
    """(keys, n, mean, std, min, max, q01...): population deviation and exact, linearly interpolated quantiles; NULLs are ignored.

    Groups of at most ``buffered`` values get their quantiles from one buffer each, larger ones from ``exact_quantiles``;
    both are exact.
    """
    names = [f"q{round(100 * p):02d}" for p in quantiles]
    moments = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]
    sizes = cut(samples.groupBy(*keys).agg(*moments))
    large = sizes.filter(F.col("n") > buffered)
    q = F.percentile(value, F.array(*map(F.lit, quantiles))).alias("__q")
    apart = lambda d: d.select(*keys, *[F.get("__q", F.lit(i)).alias(c) for i, c in enumerate(names)])
    if large.isEmpty():
        found = apart(samples.groupBy(*keys).agg(q))
    else:
        marked = bounded(aside(large.select(*keys), keys))
        small = apart(samples.join(marked, same(keys), "left_anti").groupBy(*keys).agg(q))
        found = small.unionByName(exact_quantiles(samples.join(marked, same(keys), "left_semi"), keys, value, quantiles))
    return sizes.join(aside(found, keys), same(keys)).select(*keys, "n", "mean", "std", "min", "max", *names)


def best_draw(draws: DataFrame, keys: tuple[str, ...] = ("station",)) -> DataFrame:
    """The draw with the largest log_prob, the first by (chain, step) on ties, with all its columns."""
    rest = [c for c in draws.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("log_prob", -F.col("chain"), -F.col("step")))
    return draws.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def acceptance(draws: DataFrame) -> DataFrame:
    """(station, chain, rate, mean_rate): acceptance of each chain and the mean over the station's chains."""
    d = draws.groupBy("station", "chain").agg(F.avg(F.col("accepted").cast("int")).alias("rate"))
    return d.withColumn("mean_rate", F.avg("rate").over(Window.partitionBy("station")))


def retained_draws(draws: DataFrame, burn_in: int, thin: int) -> DataFrame:
    """Draws from ``burn_in`` on, every thin-th, numbered anew per chain as ``draw``."""
    d = draws.filter((F.col("step") >= burn_in) & ((F.col("step") - burn_in) % thin == 0))
    return d.withColumn("draw", F.row_number().over(Window.partitionBy("station", "chain").orderBy("step")) - 1)


def prior_decomposition(draws: DataFrame, parameter: DataFrame, hard: DataFrame, soft: DataFrame) -> DataFrame:
    """Per retained draw its parameter, hard, soft and total log prior and whether it is valid; a missing part is 0."""
    d = draws.select(*DRAW)
    for name, part in (("parameter", parameter), ("hard", hard), ("soft", soft)):
        d = d.join(part.select(*DRAW, F.col("log_prior").alias(f"log_{name}")), list(DRAW), "left")
    parts = [F.coalesce(f"log_{n}", F.lit(0.0)) for n in ("parameter", "hard", "soft")]
    total = parts[0] + parts[1] + parts[2]
    return d.select(*DRAW, *[p.alias(f"log_{n}") for n, p in zip(("parameter", "hard", "soft"), parts, strict=True)], total.alias("log_prior"), (total > float("-inf")).alias("valid"))
