"""Units, dates and angles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TORR_PER_MBAR = 0.750061683


def kelvin_to_celsius(t: Column) -> Column:
    return t - 273.15


def celsius_to_kelvin(t: Column) -> Column:
    return t + 273.15


def hpa_to_pascal(p: Column) -> Column:
    return p * 100.0


def pascal_to_hpa(p: Column) -> Column:
    return p / 100.0


mbar_to_pascal, pascal_to_mbar = hpa_to_pascal, pascal_to_hpa


def mbar_to_torr(p: Column) -> Column:
    return p * TORR_PER_MBAR


def torr_to_mbar(t: Column) -> Column:
    return t / TORR_PER_MBAR


def degrees_to_dms(angle: Column) -> tuple[Column, Column, Column]:
    """Whole degrees, whole minutes and seconds, all by floors."""
    minutes = F.pmod(angle * 60, F.lit(60.0))
    return F.floor(angle), F.floor(minutes), F.pmod(angle * 3600, F.lit(60.0))


def dms_to_degrees(degrees: Column, minutes: Column, seconds: Column) -> Column:
    return degrees + minutes / 60.0 + seconds / 3600.0


def degrees_to_gon(angle: Column) -> Column:
    return angle * (400 / 360)


def gon_to_degrees(angle: Column) -> Column:
    return angle * (360 / 400)


def degrees_to_compass(angle: Column) -> Column:
    """0 up to 360."""
    return F.pmod(angle, F.lit(360.0))


def degrees_to_argument(angle: Column) -> Column:
    """-180 up to 180."""
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def clamp_zenith(angle: Column) -> Column:
    return F.greatest(F.least(angle, F.lit(90.0)), F.lit(0.0))


def clamp_latitude(lat: Column) -> Column:
    return F.greatest(F.least(lat, F.lit(90.0)), F.lit(-90.0))


def date_number(date: Column) -> Column:
    """A date as the number YYYYMMDD."""
    return F.date_format(date, "yyyyMMdd").cast("bigint")


def number_date(number: Column) -> Column:
    return F.to_date(number.cast("string"), "yyyyMMdd")


def day_of_year(date: Column) -> tuple[Column, Column]:
    return F.year(date).cast("bigint"), F.dayofyear(date).cast("bigint")


def date_of_day(day: Column, year: Column) -> Column:
    """The date so many days after the first of January; 365 days or more go round."""
    return F.date_add(F.make_date(year + F.floor(day / 365), F.lit(1), F.lit(1)), F.pmod(day, F.lit(365)).cast("int"))
