"""The chain from samples to dispersion curves against plain NumPy, and its plan."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.operators import dispersion as D
from quakeframe.operators import kernels as K
from quakeframe.operators import traces as T

SF = "/root/testdata/sf0.001"
TAU = 2 * math.pi
PERIODS = tuple(1.5 * 1.08**k for k in range(16))


def bank(v, dt, period, alpha):
    """Envelope and phase of one trace in a Gaussian band, by a plain discrete Fourier sum."""
    n = len(v)
    edge = max(1, int(0.05 * n))
    x = np.array(v, float)
    for i in range(edge):
        f = 0.5 * (1 - math.cos(math.pi * i / edge))
        x[i] *= f
        x[n - 1 - i] *= f
    size = 1
    while size < n:
        size *= 2
    x = np.concatenate([x, np.zeros(size - n)])
    spectrum = np.array([sum(x * np.exp(-1j * TAU * k * np.arange(size) / size)) for k in range(size)])
    for k in range(size):
        spectrum[k] *= 0 if k > size // 2 else 1 if k in (0, size // 2) else 2
        f = k / (size * dt) if k < size // 2 else (k - size) / (size * dt)
        p = -alpha * ((TAU * f - TAU / period) / (TAU / period)) ** 2
        spectrum[k] *= math.exp(p) if p > -40 else 0
    z = np.array([sum(spectrum * np.exp(1j * TAU * np.arange(size) * i / size)) / size for i in range(n)])
    return np.abs(z), np.angle(z)


def peaks(env, ph, b, dt, period, distance, window, shift):
    """All candidates of one envelope, one sample at a time."""
    n, out, i = len(env), [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and env[j + 1] == env[i]:
            j += 1
        if j < n - 1 and env[i - 1] < env[i] > env[j + 1]:
            out.append((i + j) // 2)
        i = j + 1
    if not out:
        inside = [k for k in range(n) if distance / window[1] <= b + k * dt <= distance / window[0]] or range(n)
        k = max(inside, key=lambda m: (env[m], -m))
        out = [k if 0 < k < n - 1 else min(max(1, n // 2), n - 2)]
    found = []
    for a, k in enumerate(out):
        left, mid, right = env[k - 1], env[k], env[k + 1]
        o = 0.0 if left + right - 2 * mid == 0 else (left - right) / (left + right - 2 * mid) / 2
        w = TAU / period * dt
        pm = ph[k] - TAU * np.rint((ph[k] - ph[k - 1] - w) / TAU)
        pr = ph[k + 1] - TAU * np.rint((ph[k + 1] - pm - w) / TAU)
        bend, slope = ph[k - 1] + pr - 2 * pm, (pr - ph[k - 1]) / 2
        t = b + (k + o) * dt
        lo, hi = out[a - 1] if a else 0, out[a + 1] if a + 1 < len(out) else n - 1
        low = min(env[lo : k + 1]) * min(env[k : hi + 1])
        found.append({"i": k, "time": t, "group_velocity": distance / t, "amplitude": mid - (left - right) * o / 4, "phase": pm + o * slope + o * o * bend / 2 + shift * math.pi / 4, "instant_period": TAU * dt / (o * bend + slope), "snr": mid / math.sqrt(low) if low > 0 else 3.0})
    return found


def bends(x, y):
    return [0.0, *(((y[i + 1] - y[i]) / (x[i + 1] - x[i]) - (y[i] - y[i - 1]) / (x[i] - x[i - 1])) / (x[i + 1] - x[i - 1]) for i in range(1, len(x) - 1)), 0.0]


def branch(periods, found, threshold, points):
    """The rule of the repair, written out."""
    x = [math.log(p) for p in periods]
    own = [max(range(len(c)), key=lambda j: (c[j]["amplitude"], -j)) for c in found]
    first = list(own)
    mark = lambda pick: [int(c > threshold) - int(c < -threshold) for c in bends(x, [c[j]["group_velocity"] for c, j in zip(found, pick, strict=True)])]
    signs = mark(own)
    jumps = [k + 1 for k in range(len(signs) - 1) if abs(signs[k + 1] - signs[k]) == 2]
    for a, b in zip(jumps, jumps[1:], strict=False):
        if b - a > points:
            continue
        trial = list(own)
        for k in range(a, b):
            before = found[k - 1][trial[k - 1]]["group_velocity"]
            trial[k] = min(range(len(found[k])), key=lambda j: abs(found[k][j]["group_velocity"] - before))
        new = mark(trial)
        if not any(new[a - 1 : b + 1]):
            own, signs = trial, new
    lo, hi = 0, len(own) - 1
    if any(signs):
        ends = [0, *(k for k, s in enumerate(signs) if s), len(own) - 1]
        k = max(range(len(ends) - 1), key=lambda j: (ends[j + 1] - ends[j], -j))
        lo, hi = ends[k], ends[k + 1]
    return [(p, c[j], j != f) for p, c, j, f in list(zip(periods, found, own, first, strict=True))[lo : hi + 1]]


@pytest.fixture(scope="module")
def samples(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 25 = 3")
    return e.select(F.col("vec_id").alias("trace_id"), F.posexplode("embedding").alias("i", "v")).select("trace_id", "i", (1 + 0.5 * F.col("i")).alias("t"), F.col("v").cast("double").alias("v"))


@pytest.mark.parametrize("threshold", [5.0, 20.0])
def test_branches_equal_plain_numpy(spark, samples, threshold):
    traces = samples.select("trace_id").distinct().withColumn("distance", 30.0 + F.col("trace_id") % 40)
    got = {}
    for r in D.dispersion_branches(samples, traces, PERIODS, threshold=threshold, jump_points=4).collect():
        got.setdefault(r["trace_id"], []).append(r)
    rows = {}
    for r in samples.orderBy("trace_id", "i").collect():
        rows.setdefault(r["trace_id"], []).append(r["v"])
    assert set(got) == set(rows)
    for k, v in rows.items():
        found = [peaks(*bank(v, 0.5, p, 20.0), 1.0, 0.5, p, 30.0 + k % 40, (2.0, 5.0), -1.0) for p in PERIODS]
        want = branch(PERIODS, found, threshold, 4)
        own = sorted(got[k], key=lambda r: r["period"])
        assert [(r["period"], r["i"], r["replaced"]) for r in own] == [(p, c["i"], s) for p, c, s in want]
        for r, (_, c, _) in zip(own, want, strict=True):
            assert [r[x] for x in c] == pytest.approx(list(c.values()), rel=1e-6, abs=1e-9)
            assert r["distance"] == 30.0 + k % 40 and r["initial_count"] == 16


def test_walk_equals_the_rule_written_out():
    rng = np.random.default_rng(0)
    swapped = cut_ = 0
    for _ in range(400):
        n = int(rng.integers(1, 14))
        periods = np.geomspace(4, 40, n) if n > 1 else np.array([5.0])
        found = []
        for k in range(n):
            v = [3 + 0.02 * k + rng.normal(0, 0.002), *rng.uniform(2, 5, int(rng.integers(0, 3)))]
            a = rng.uniform(0, 1, len(v))
            if rng.random() < 0.8:
                a[0] = 2
            order = rng.permutation(len(v))
            found.append([{"group_velocity": v[i], "amplitude": a[i]} for i in order])
        best = np.array([max(range(len(c)), key=lambda j, c=c: (c[j]["amplitude"], -j)) for c in found])
        choice, first, last = K.branch_choice(periods, [np.array([c["group_velocity"] for c in o]) for o in found], best, 1.0, 4)
        want = branch(periods, found, 1.0, 4)
        assert [(periods[k], found[k][choice[k]], choice[k] != best[k]) for k in range(first, last + 1)] == want
        swapped += sum(s for _, _, s in want)
        cut_ += len(want) < n
    assert swapped > 20 and cut_ > 20


def test_no_shuffle_between_bank_and_picks(spark, samples):
    traces = samples.select("trace_id").distinct().withColumn("distance", F.lit(40.0))
    plan = T.best_candidates(T.peak_candidates(K.ftan_arrays(samples, PERIODS, traces=traces)))._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInPandas")[0]
    assert "MapInPandas" in plan and not any(x in above for x in ("Exchange", "Sort", "Window", "Join"))


def test_wave_packet_to_dispersion_table(spark):
    """A dispersed packet comes back with its group and phase velocity."""
    n, dt, d = 1024, 0.5, 200.0
    f = np.fft.rfftfreq(n, dt)
    w = TAU * f
    c = 3.5 - 0.6 * np.clip(f, 0, 0.5)
    spectrum = np.exp(-(((f - 0.18) / 0.1) ** 2)) * np.exp(-1j * w * d / c)
    v = np.fft.irfft(spectrum, n)
    s = spark.createDataFrame([(7, i, i * dt, float(x)) for i, x in enumerate(v)], "trace_id long, i int, t double, v double")
    traces = spark.createDataFrame([(7, d)], "trace_id long, distance double")
    reference = spark.createDataFrame([(p, float(3.5 - 0.6 / p)) for p in np.linspace(2, 20, 40).tolist()], "period double, velocity double")
    branches = D.dispersion_branches(s, traces, tuple(np.geomspace(4, 9, 12).tolist()), threshold=50.0, phase_shift=0.0)
    table = D.measure_dispersion(branches, reference).orderBy("target_period").collect()
    assert len(table) == 12 and {r["status"] for r in table} <= {"unchanged", "corrected"}
    for r in table:
        f0 = 1 / r["period"]
        slow = 1 / (3.5 - 0.6 * f0) + f0 * 0.6 / (3.5 - 0.6 * f0) ** 2
        assert r["group_velocity"] == pytest.approx(1 / slow, rel=0.03)
        assert r["phase_velocity"] == pytest.approx(3.5 - 0.6 * f0, rel=0.02)
    qc = D.dispersion_qc(D.measure_dispersion(branches, reference)).first()
    assert qc["trace_id"] == 7 and qc["retained_count"] == 12 and not qc["warn_short"]


def test_awkward_rows(spark):
    rows = [(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0)] + [(2, i, float(i), 0.0) for i in range(16)] + [(3, i, float(i), math.sin(i)) for i in range(16)]
    s = spark.createDataFrame(rows, "trace_id long, i int, t double, v double")
    traces = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "trace_id long, distance double")
    found = T.peak_candidates(K.ftan_arrays(s, (3.0, 4.0, 5.0), traces=traces))
    assert {r["trace_id"] for r in found.collect()} == {2, 3}
    # A silent trace has its middle or first sample of the window; one without a distance has no velocities and no branch.
    assert {r["trace_id"] for r in D.dispersion_branches(s, traces, (3.0, 4.0, 5.0)).collect()} == {2}
    assert D.dispersion_branches(s.limit(0), traces, (3.0,)).count() == 0
