"""Declared schemas of the tables that the operators exchange."""

from __future__ import annotations

#: uint16 bands don't fit a short.
OBSERVATIONS = "tile string, x int, y int, obs_date date, green int, red int, nir int, swir2 int"
#: A pixel's clean observations in order of time.
SERIES = "tile string, x int, y int, ordinal array<int>, ndvi array<double>, green array<int>, red array<int>, nir array<int>, swir2 array<int>"
SEGMENTS = (
    "tile string, x_coord int, y_coord int, tBreak long, tEnd long, tStart long, changeProb int, coeficientes array<double>, intercept_values double, "
    + ", ".join(f"{b}{e} double" for b in ("green", "red", "nir", "swir2") for e in ("Start", "Start2", "End", "End2"))
)
IMAGES = "path string, source string, tile string, acq_date date, width int, height int, cloud_pct double"
RING = "array<struct<x:double,y:double>>"
NODATA = 65535
