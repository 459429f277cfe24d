"""All queries of the measurement operators and their SQL."""

from __future__ import annotations

from .plans import checks, dispersion, inversion, kernels, maps, scalars, tables, waveforms

MODULES = (scalars, checks, maps, waveforms, dispersion, inversion, kernels, tables)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
