"""Scalar functions of the measurement tables, as Column expressions.

A missing or undefined value is NULL, never NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 in km, the mean Earth radius, the default table of Gaussian widths by distance.
WGS84_A, WGS84_F = 6378.137, 1 / 298.257223563
EARTH_RADIUS_KM = 6371.0088
ALPHA_TABLE = ((0.0, 5.0), (100.0, 8.0), (250.0, 12.0), (500.0, 20.0), (1000.0, 25.0), (2000.0, 35.0), (4000.0, 50.0), (20000.0, 75.0))
VP_BROCHER = (0.9409, 2.0947, -0.8206, 0.2683, -0.0251)
RHO_BROCHER = (0.0, 1.6612, -0.4721, 0.0671, -0.0043, 0.000106)
#: Rayleigh phase terms in units of pi/4.
PI_OVER_4 = {"ZZ": -1.0, "ZR": 1.0, "RZ": -1.0, "RR": -1.0, "TT": -1.0}
#: Each step gains a factor of about 300 except near antipodes.
VINCENTY_STEPS = 6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def finite(x: Column) -> Column:
    """``x``, or NULL where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def wrap180(a: Column) -> Column:
    """Angle in [-180, 180)."""
    return F.pmod(a + 180, F.lit(360.0)) - 180


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Struct (distance_km, azimuth, back_azimuth) on WGS84, by a fixed number of Vincenty steps. Equal points are at distance 0, azimuths 0."""
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = F.atan((1 - WGS84_F) * F.tan(F.radians(lat1))), F.atan((1 - WGS84_F) * F.tan(F.radians(lat2)))
    start = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lon2 - lon1).alias("l"))

    def angles(p: Column, lam: Column) -> Column:
        east = p["c2"] * F.sin(lam)
        north = p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam)
        sin_s = F.sqrt(east * east + north * north)
        cos_s = p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam)
        return F.struct(east.alias("east"), north.alias("north"), sin_s.alias("ss"), cos_s.alias("cs"), F.atan2(sin_s, cos_s).alias("sigma"), F.when(sin_s == 0, 0.0).otherwise(p["c1"] * p["c2"] * F.sin(lam) / sin_s).alias("sa"))

    def middle(p: Column, q: Column) -> Column:
        c2 = 1 - q["sa"] * q["sa"]
        return F.struct(c2.alias("ca2"), F.when(c2 == 0, 0.0).otherwise(q["cs"] - 2 * p["s1"] * p["s2"] / c2).alias("cm"))

    def step(p: Column, lam: Column) -> Column:
        def body(q: Column) -> Column:
            def inner(m: Column) -> Column:
                c = WGS84_F / 16 * m["ca2"] * (4 + WGS84_F * (4 - 3 * m["ca2"]))
                return p["l"] + (1 - c) * WGS84_F * q["sa"] * (q["sigma"] + c * q["ss"] * (m["cm"] + c * q["cs"] * (2 * m["cm"] * m["cm"] - 1)))

            return let(middle(p, q), inner)

        return let(angles(p, lam), body)

    def finish(p: Column, lam: Column) -> Column:
        def body(q: Column) -> Column:
            def inner(m: Column) -> Column:
                u = m["ca2"] * ((WGS84_A**2 - b**2) / b**2)
                big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
                big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
                cm2 = m["cm"] * m["cm"]
                ds = big_b * q["ss"] * (m["cm"] + big_b / 4 * (q["cs"] * (2 * cm2 - 1) - big_b / 6 * m["cm"] * (4 * q["ss"] * q["ss"] - 3) * (4 * cm2 - 3)))
                back = F.atan2(p["c1"] * F.sin(lam), p["c1"] * p["s2"] * F.cos(lam) - p["s1"] * p["c2"])
                return F.struct((b * big_a * (q["sigma"] - ds)).alias("distance_km"), wrap180(F.degrees(F.atan2(q["east"], q["north"]))).alias("azimuth"), F.when(q["ss"] == 0, 0.0).otherwise(wrap180(F.degrees(back) + 180)).alias("back_azimuth"))

            return let(middle(p, q), inner)

        return let(angles(p, lam), body)

    return let(start, lambda p: let(F.aggregate(F.sequence(F.lit(1), F.lit(VINCENTY_STEPS)), p["l"], lambda lam, _: step(p, lam)), lambda lam: finish(p, lam)))


def with_geodesic(df: DataFrame, lon1: str, lat1: str, lon2: str, lat2: str, name: str = "g") -> DataFrame:
    """``df`` with a struct column as of ``geodesic``. Each part of a step is a projection of its own, so all of them become generated code and none is computed twice.

    A filter on the result that the optimiser pushes below these projections would spell all steps out in one expression;
    use ``geodesic`` there, or filter after a join or an aggregation.
    """
    b = WGS84_A * (1 - WGS84_F)
    col = lambda n: F.col(f"__{name}_{n}")
    put = lambda d, **x: d.withColumns({f"__{name}_{n}": v for n, v in x.items()})
    reduced = lambda lat: F.atan((1 - WGS84_F) * F.tan(F.radians(lat)))
    d = put(df, u1=reduced(lat1), u2=reduced(lat2), l=F.radians(F.col(lon2) - F.col(lon1)))
    d = put(d, s1=F.sin(col("u1")), c1=F.cos(col("u1")), s2=F.sin(col("u2")), c2=F.cos(col("u2")), lam=col("l"))
    for step in range(VINCENTY_STEPS + 1):
        d = put(d, sl=F.sin(col("lam")), cl=F.cos(col("lam")))
        d = put(d, east=col("c2") * col("sl"), north=col("c1") * col("s2") - col("s1") * col("c2") * col("cl"), cs=col("s1") * col("s2") + col("c1") * col("c2") * col("cl"))
        d = put(d, ss=F.sqrt(col("east") * col("east") + col("north") * col("north")))
        d = put(d, sigma=F.atan2(col("ss"), col("cs")), sa=F.when(col("ss") == 0, 0.0).otherwise(col("c1") * col("c2") * col("sl") / col("ss")))
        d = put(d, ca2=1 - col("sa") * col("sa"))
        d = put(d, cm=F.when(col("ca2") == 0, 0.0).otherwise(col("cs") - 2 * col("s1") * col("s2") / col("ca2")))
        if step < VINCENTY_STEPS:
            d = put(d, cc=WGS84_F / 16 * col("ca2") * (4 + WGS84_F * (4 - 3 * col("ca2"))))
            d = put(d, lam=col("l") + (1 - col("cc")) * WGS84_F * col("sa") * (col("sigma") + col("cc") * col("ss") * (col("cm") + col("cc") * col("cs") * (2 * col("cm") * col("cm") - 1))))
    d = put(d, u=col("ca2") * ((WGS84_A**2 - b**2) / b**2), cm2=col("cm") * col("cm"))
    u = col("u")
    d = put(d, ba=1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), bb=u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))))
    ds = col("bb") * col("ss") * (col("cm") + col("bb") / 4 * (col("cs") * (2 * col("cm2") - 1) - col("bb") / 6 * col("cm") * (4 * col("ss") * col("ss") - 3) * (4 * col("cm2") - 3)))
    back = F.atan2(col("c1") * col("sl"), col("c1") * col("s2") * col("cl") - col("s1") * col("c2"))
    out = F.struct((b * col("ba") * (col("sigma") - ds)).alias("distance_km"), wrap180(F.degrees(F.atan2(col("east"), col("north")))).alias("azimuth"), F.when(col("ss") == 0, 0.0).otherwise(wrap180(F.degrees(back) + 180)).alias("back_azimuth"))
    return d.withColumn(name, out).drop(*[c for c in d.columns if c.startswith(f"__{name}_")])


def local_xy(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Equirectangular kilometres east and north of a centre."""
    return F.radians(wrap180(lon - lon0)) * F.cos(F.radians(lat0)) * EARTH_RADIUS_KM, F.radians(lat - lat0) * EARTH_RADIUS_KM


def travel_time(distance: Column, velocity: Column) -> Column:
    return F.when(finite(distance).isNotNull() & (finite(velocity) > 0), distance / velocity)


def slowness_to_velocity(s: Column) -> Column:
    return F.when(finite(s) > 0, 1 / s)


def apparent_slowness(north: Column, east: Column) -> Column:
    return F.hypot(north, east)


def propagation_angle(north: Column, east: Column) -> Column:
    """Azimuth of a gradient in degrees."""
    return wrap180(F.degrees(F.atan2(east, north)))


def helmholtz_correction(amplitude: Column, laplacian: Column, period: Column) -> Column:
    """Amplitude term of the squared slowness; NULL where the amplitude is 0."""
    omega = 2 * math.pi / period
    return F.when(amplitude != 0, laplacian / (amplitude * omega * omega))


def corrected_slowness(slowness: Column, correction: Column) -> Column:
    """Slowness less the amplitude term; NULL unless its square stays positive."""
    s2 = slowness * slowness - correction
    return F.when(s2 > 0, F.sqrt(s2))


def filter_alpha(distance: Column, mode: str = "table", value: float = 20.0, factor: float = 1.0, nodes: tuple[tuple[float, float], ...] = ALPHA_TABLE) -> Column:
    """Width of the Gaussian filters by distance: ``constant``, ``table`` (linear, clamped), ``sqrt`` or ``flat``."""
    if mode == "constant":
        return F.lit(value)
    if mode == "flat":
        return F.lit(20.0 * factor)
    if mode == "sqrt":
        return F.when(distance > 0, factor * 20.0 * F.sqrt(distance / 1000.0))
    out = F.when(distance <= nodes[0][0], nodes[0][1])
    for (x0, y0), (x1, y1) in zip(nodes, nodes[1:], strict=False):
        out = out.when(distance <= x1, y0 + (distance - x0) * ((y1 - y0) / (x1 - x0)))
    return F.when(distance.isNotNull(), out.otherwise(nodes[-1][1]))


def effective_max_period(distance: Column, max_period: float, reference_velocity: float = 3.0, wavelengths: float = 2.0) -> Column:
    return F.least(F.lit(max_period), distance / (reference_velocity * wavelengths))


def reciprocal_component(component: Column) -> Column:
    return F.reverse(component)


def physical_component(component: Column, branch: Column) -> Column:
    return F.when(branch == "negative", F.reverse(component)).otherwise(component)


def physical_pair(source: Column, receiver: Column, branch: Column) -> Column:
    """Struct (source, receiver) in the direction of propagation; unchanged where a station is unknown."""
    swap = (branch == "negative") & source.isNotNull() & receiver.isNotNull()
    return F.struct(F.when(swap, receiver).otherwise(source).alias("source"), F.when(swap, source).otherwise(receiver).alias("receiver"))


def physical_branch(branch: Column) -> Column:
    return F.when(branch == "negative", "positive").otherwise(branch)


def pi_over_4(component: Column) -> Column:
    """Phase term of a component, NULL where none is defined."""
    return F.create_map(*[F.lit(x) for p in PI_OVER_4.items() for x in p])[component]


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def vp_from_vs(vs: Column, method: str = "brocher2005", ratio: float = 1.75) -> Column:
    """P velocity; the polynomial holds for vs in [0, 4.5] and is NULL outside."""
    if method == "constant_vp_vs":
        return vs * ratio
    return F.when(vs.between(0.0, 4.5), _polynomial(vs, VP_BROCHER))


def rho_from_vp(vp: Column) -> Column:
    return _polynomial(vp, RHO_BROCHER)


def rho_from_vs(vs: Column, method: str = "brocher2005", rho: float = 2.7) -> Column:
    if method == "constant":
        return F.when(vs.isNotNull(), F.lit(rho))
    return rho_from_vp(vp_from_vs(vs))


#: Scalings by name; further ones may be added.
VP_SCALINGS: dict[str, Callable[..., Column]] = {"brocher2005": vp_from_vs, "constant_vp_vs": lambda vs: vp_from_vs(vs, "constant_vp_vs")}
RHO_SCALINGS: dict[str, Callable[..., Column]] = {"brocher2005": rho_from_vs, "constant": lambda vs: rho_from_vs(vs, "constant")}


def snr_db(ratio: Column, fill: float = 3.0, decibel: bool = True) -> Column:
    """A ratio as it is or in dB; ``fill`` where it is missing, not finite or not positive."""
    good = F.coalesce(finite(ratio) > 0, F.lit(False))
    return F.when(good, 20 * F.log10(ratio) if decibel else ratio).otherwise(F.lit(fill))


def hv_ratio(h: dict[str, Column], v: dict[str, Column], definition: str = "sum") -> Column:
    """Struct (hv, status) from energy contributions: ``h`` has rayleigh, love, psv, sh, ``v`` has rayleigh, psv."""
    total = 2 * (h["rayleigh"] + h["love"] + h["psv"] + h["sh"]) / (2 if definition == "mean" else 1)
    vertical = v["rayleigh"] + v["psv"]
    good = F.coalesce((finite(total) >= 0) & (finite(vertical) > 0), F.lit(False))
    status = F.when(good, "ok").otherwise("invalid")
    return F.struct(F.when(status == "ok", F.sqrt(total / vertical)).alias("hv"), status.alias("status"))


def taper(omega: Column, low0: float, low1: float, high1: float, high0: float) -> Column:
    """Raised-cosine ramps from low0 up to low1 and from high1 down to high0; 1 between, 0 outside."""
    up = 0.5 * (1 - F.cos(math.pi * (omega - low0) / (low1 - low0)))
    down = 0.5 * (1 + F.cos(math.pi * (omega - high1) / (high0 - high1)))
    return F.when((omega <= low0) | (omega >= high0), 0.0).when(omega < low1, up).when(omega <= high1, 1.0).otherwise(down)


def gaussian_window(t: Column, centre: Column, width: Column, floor: float = -24.0) -> Column:
    """exp(-((t - centre) / width)^2 / 2), 0 where the exponent is below ``floor``."""
    e = -0.5 * ((t - centre) / width) * ((t - centre) / width)
    return F.when(e < floor, 0.0).otherwise(F.exp(e))


def gaussian_response(omega: Column, omega0: Column, alpha: Column, floor: float = -40.0) -> Column:
    """exp(-alpha ((omega - omega0) / omega0)^2), 0 where the exponent is below ``floor``."""
    e = -alpha * ((omega - omega0) / omega0) * ((omega - omega0) / omega0)
    return F.when(e < floor, 0.0).otherwise(F.exp(e))


def amplitude_factor(slowness: Column) -> Column:
    """Amplitude correction of a receiver function by slowness."""
    return 151.5478 * slowness * slowness + 3.2896 * slowness + 0.2618


def amp_correct(samples: Column, slowness: Column, b: Column, delta: Column, method: str = "seispy", window: tuple[float, float] = (-2.0, 2.0)) -> Column:
    """A sample array times its slowness factor, or over its largest absolute value in the P window (unchanged if that is 0, NULL without overlap)."""
    if method == "seispy":
        return let(amplitude_factor(slowness), lambda f: F.transform(samples, lambda x: x * f))
    inside = F.filter(samples, lambda x, i: (b + i * delta).between(*window))
    return let(F.array_max(F.transform(inside, F.abs)), lambda m: F.when(m == 0, samples).when(m > 0, F.transform(samples, lambda x: x / m)))


def log_likelihood(log_prob: Column, log_prior: Column) -> Column:
    return log_prob - log_prior


def parabolic_peak(left: Column, mid: Column, right: Column) -> Column:
    """Struct (offset, value) of the parabola through three neighbours; offset 0 on a line."""
    bend = left + right - 2 * mid
    offset = F.when(bend == 0, 0.0).otherwise((left - right) / bend / 2)
    return F.struct(offset.alias("offset"), (mid - (left - right) * offset / 4).alias("value"))
