"""Sensor band tables as small DataFrames. Wavelengths and widths in micrometres, sampling in metres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Band, centre wavelength, width, ground sampling, common name.
SENTINEL_2 = """
B01 0.443 0.021 60 coastal
B02 0.492 0.066 10 blue
B03 0.560 0.036 10 green
B04 0.665 0.031 10 red
B05 0.704 0.015 20 rededge
B06 0.741 0.015 20 rededge
B07 0.783 0.020 20 rededge
B08 0.833 0.106 10 nir
B8A 0.865 0.021 20 nir08
B09 0.945 0.020 60 nir09
B10 1.374 0.031 60 cirrus
B11 1.614 0.091 20 swir16
B12 2.202 0.175 20 swir22
"""
LANDSAT_8 = """
B1 0.443 0.016 30 coastal
B2 0.482 0.060 30 blue
B3 0.561 0.057 30 green
B4 0.655 0.037 30 red
B5 0.865 0.028 30 nir08
B6 1.609 0.085 30 swir16
B7 2.201 0.187 30 swir22
B8 0.590 0.172 15 pan
B9 1.373 0.020 30 cirrus
B10 10.896 0.588 100 lwir11
B11 12.001 1.011 100 lwir12
"""
SCHEMA = "band string, wavelength double, width double, sampling double, common_name string"


def table(spark: SparkSession, text: str) -> DataFrame:
    rows = [line.split() for line in text.strip().splitlines()]
    return spark.createDataFrame([(b, float(w), float(f), float(g), n) for b, w, f, g, n in rows], SCHEMA)
