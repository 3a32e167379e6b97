"""Atmospheric physics as column expressions.

Temperatures ``kelvin`` are in kelvin and ``celsius`` in degrees Celsius,
pressures in pascal, wavelengths in micrometres, angles in degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from penumbra.functions.units import celsius_to_kelvin, kelvin_to_celsius

# Fixed values of the published formulas.
IAPWS_WATER = (1167.05214528, -724213.167032, -17.0738469401, 12020.8247025, -3232555.03223, 14.9151086135, -4823.26573616, 405113.405421, -0.238555575678, 650.175348448)
SIMPLE_WATER = (1.2378847e-5, -1.9121316e-2, 33.93711047, -6.3431645e3)
IAPWS_ICE = (-13.928169, 34.7078238)
ENHANCEMENT = (1.00062, 3.14e-8, 5.6e-7)
VAPOUR_DISPERSION = (295.235, 2.6422, -0.032380, 0.004028)
AIR_DISPERSION = (238.0185, 5792105.0, 57.362, 167917.0)
COMPRESSIBILITY = (1.58123e-6, -2.9331e-8, 1.1043e-10, 5.707e-6, -2.051e-8, 1.9898e-4, -2.376e-6, 1.83e-11, -7.65e-9)
GAS_CONSTANT, WATER_MASS, EARTH_RATE = 8.31451, 0.018015, 7.2921e-5


def _polynomial(x: Column, *coefficients: float) -> Column:
    """Horner's rule, the coefficient of the highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + c
    return out


def sea_level_temperature(lat: Column, split: bool = False) -> Column:
    """Kelvin by latitude; ``split`` takes other values for each hemisphere."""
    cosine = F.cos(F.radians(lat))
    if not split:
        return cosine * 53.4894 + 245.856
    return F.when(lat >= 0, cosine * 52.07 + (273.15 - 26.4)).otherwise(cosine * 78.08 + (273.15 - 48.2))


def tropopause_height(lat: Column) -> Column:
    phi = F.abs(F.radians(lat))
    return _polynomial(phi, 1271.91, -9338.96, 17786.1)


def troposphere_temperature(height: Column, kelvin: Column) -> Column:
    """Kelvin at a height, falling to -56.5 degrees at 11,019 m."""
    ground = kelvin_to_celsius(kelvin)
    return celsius_to_kelvin(ground + (-56.5 - ground) * height / 11019.0)


def vapour_pressure(kelvin: Column) -> Column:
    t = kelvin_to_celsius(kelvin)
    inches = F.pow(t * 0.00738 + 0.8072, F.lit(8)) - (t * 1.8 + 48) * 1.9e-5 + 0.001316
    return inches * 3386.39


def saturation_pressure(kelvin: Column, simple: bool = False) -> Column:
    """Over water."""
    if simple:
        a, b, c, d = SIMPLE_WATER
        return F.exp(kelvin * kelvin * a + kelvin * b + c + F.lit(d) / kelvin)
    k = IAPWS_WATER
    omega = kelvin + F.lit(k[8]) / (kelvin - k[9])
    a, b, c = _polynomial(omega, 1.0, k[0], k[1]), _polynomial(omega, *k[2:5]), _polynomial(omega, *k[5:8])
    root = F.sqrt(b * b - a * c * 4) - b
    return F.pow(c * 2 / root, F.lit(4)) * 1e6


def saturation_pressure_ice(kelvin: Column) -> Column:
    share = kelvin / 273.16
    first, second = IAPWS_ICE
    return F.exp((1 - F.pow(share, F.lit(-1.5))) * first + (1 - F.pow(share, F.lit(-1.25))) * second) * 611.657


def vapour_pressure_ice(kelvin: Column) -> Column:
    return F.pow(F.lit(10.0), F.lit(-2663.5) / kelvin + 12.537)


def enhancement_factor(celsius: Column, pressure: Column) -> Column:
    alpha, beta, gamma = ENHANCEMENT
    return pressure * beta + celsius * celsius * gamma + alpha


def vapour_fraction(pressure: Column, kelvin: Column, humidity: Column) -> Column:
    """Molar fraction of water; over ice and without enhancement up to the freezing point."""
    freezing = kelvin <= 273.15
    saturated = F.when(freezing, saturation_pressure_ice(kelvin)).otherwise(saturation_pressure(kelvin))
    enhanced = F.when(freezing, 1.0).otherwise(enhancement_factor(kelvin_to_celsius(kelvin), pressure))
    return enhanced * humidity * saturated / pressure


def compressibility(pressure: Column, kelvin: Column, fraction: Column) -> Column:
    a0, a1, a2, b0, b1, c0, c1, d, e = COMPRESSIBILITY
    t, by_t = kelvin_to_celsius(kelvin), pressure / kelvin
    linear = _polynomial(t, a2, a1, a0) + _polynomial(t, b1, b0) * fraction + _polynomial(t, c1, c0) * fraction * fraction
    return 1 - by_t * linear + by_t * by_t * (fraction * fraction * e + d)


def air_density(kelvin: Column, pressure: Column, humidity: Column, moist: bool = True, co2: float = 450.0) -> Column:
    """Density of the water (``moist``) or dry part of air; at full humidity the fraction of water is 1."""
    air_mass = (28.9635 + 1.2011e-5 * (co2 - 400)) * 1e-3
    x = F.when(humidity == 1, 1.0).otherwise(vapour_fraction(pressure, kelvin, humidity))
    part = x if moist else 1 - x
    return part * pressure * air_mass / (compressibility(pressure, kelvin, x) * GAS_CONSTANT * kelvin) * (1 - x * (1 - WATER_MASS / air_mass))


def vapour_refractivity(wavelength: Column) -> Column:
    square = 1 / (wavelength * wavelength)
    return _polynomial(square, *reversed(VAPOUR_DISPERSION)) * 1.022 * 1e-8


def refractive_index_visible(wavelength: Column, celsius: Column, pressure: Column, vapour: Column | None = None, co2: Column | None = None) -> Column:
    """Revised Edlen equation; ``vapour`` is partial pressure, ``co2`` in parts per million."""
    square = 1 / (wavelength * wavelength)
    standard = (F.lit(15998.0) / (38.9 - square) + F.lit(2406147.0) / (130 - square) + 8342.54) * 1e-8
    if co2 is not None:
        standard = standard * ((co2 * 1e-6 - 0.0003) * 0.54 + 1)
    density = (1 + pressure * (0.601 - celsius * 0.00972) * 1e-8) / (1 + celsius * 0.003661)
    index = standard * pressure / 96095.43 * density
    if vapour is not None:
        index = index + vapour * (3.7345 - square * 0.0401) * 1e-9
    return index + 1


def refractive_index_broadband(wavelength: Column, celsius: Column, pressure: Column, humidity: Column, co2: float = 450.0, lorentz_lorenz: bool = False) -> Column:
    """Group index of moist air from its dry and water densities against those of reference."""
    square = 1 / (wavelength * wavelength)
    k0, k1, k2, k3 = AIR_DISPERSION
    dry = (F.lit(k1) / (k0 - square) + F.lit(k3) / (k2 - square)) * 1e-8 * (1 + 5.34e-7 * (co2 - 450))
    wet, kelvin = vapour_refractivity(wavelength), celsius_to_kelvin(celsius)
    dry_part = air_density(kelvin, pressure, humidity, False, co2) / air_density(F.lit(288.15), F.lit(101325.0), F.lit(0.0), False, co2)
    wet_part = air_density(kelvin, pressure, humidity, True, co2) / air_density(F.lit(293.15), F.lit(1333.0), F.lit(1.0), True, co2)
    if not lorentz_lorenz:
        return dry_part * dry + wet_part * wet + 1
    first, second = ((n * n - 1) / (n * n + 2) for n in (dry + 1, wet + 1))
    total = dry_part * first + wet_part * second
    return F.sqrt((1 + total * 2) / (1 - total))


def refractive_index_simple(pressure: Column, humidity: Column, celsius: Column) -> Column:
    return 1 + pressure * 0.000786 / (celsius + 273) - humidity * (celsius * celsius + 160) * 1.5e-11


def refraction_angle(zenith: Column, index: Column) -> Column:
    return F.degrees(F.asin(F.sin(F.radians(zenith)) / index))


def simple_density_fraction(lat: Column) -> Column:
    return 1.14412 - F.cos(F.radians(lat)) * 0.185488


def density_fraction(lat: Column, height: Column, lapse: float = 0.0065) -> Column:
    """Density in the troposphere as a share of that at sea level."""
    gravity = (1 - F.cos(F.radians(lat * 2)) * 0.0026 - height * 2.8e-7) * 9.784
    return F.pow(1 - height * lapse / sea_level_temperature(lat), gravity * (28.825 / (8314.36 * lapse)) - 1)


def refraction_spherical(zenith: Column, lat: Column | None = None, height: Column | None = None) -> Column:
    """Refracted zenith angle in a mean atmosphere."""
    if lat is None:
        return refraction_angle(zenith, F.lit(1.0002904))
    share = simple_density_fraction(lat) if height is None else density_fraction(lat, height)
    return refraction_angle(zenith, share * 0.0002905 + 1)


def co2_level(lat: Column, date: Column, base: float = 3.0, terms: int = 3) -> Column:
    """Parts per million: a decadal parabola and a yearly saw-tooth that grows with latitude."""
    share = F.dayofyear(date) / 365.25
    years = F.year(date) + share
    level = _polynomial(years, 0.012786034930234986, -49.31617858270089, 47857.733173381115)
    wave = {}
    for sign in (1, -1):
        m, total = sign * base, F.lit(0.0)
        for n in range(1, terms + 1):
            weight = -2 * -(1**n) * m**2 / (n**2 * (m - 1) * math.pi**2) * math.sin(n * (m - 1) * math.pi / m)
            total = total - F.sin(share * (2 * math.pi * n)) * weight
        wave[sign] = total
    yearly = F.when(lat < 0, wave[-1]).otherwise(wave[1])
    return level - yearly * F.tanh(F.abs(lat) / 30) * 18


def coriolis(lat: Column) -> Column:
    return F.sin(F.radians(lat)) * (2 * EARTH_RATE)


def vapour_scale_height(kelvin: Column, lapse: float = 0.0065, vapour_constant: float = 461.0, latent_heat: float = 2.5e6) -> Column:
    return -(kelvin * kelvin) * vapour_constant / (latent_heat * lapse)
