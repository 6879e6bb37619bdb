"""Sea-water properties as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Approximate neutral density, McDougall and Jackett (2005), J. Mar. Res. 63, 159-185. Powers of t ascending.
_NUM_T = (1002.3063688892480, 2.2280832068441331e-1, 8.1157118782170051e-2, -4.3159255086706703e-4)
_NUM_S = (-1.0304537539692924e-4, -3.1710675488863952e-3, -1.7052298331414675e-7)  # s, s t, s s
_DEN_T = (1.0, 4.3907692647825900e-5, 7.8717799560577725e-5, -1.6212552470310961e-7, -2.3850178558212048e-9)
_DEN_S = (-5.1268124398160734e-4, 6.0399864718597388e-6, 0.0, -2.2744455733317707e-9)
_DEN_SS = (-3.6138532339703262e-5, 0.0, -1.3409379420216683e-9)
# Specific heat at the surface, Fofonoff and Millard (1983), UNESCO Tech. Pap. Mar. Sci. 44.
_CP = ((4217.4, -3.720283, 0.1412855, -2.654387e-3, 2.093236e-5), (-7.643575, 0.1072763, -1.38385e-3), (0.1770383, -4.07718e-3, 5.148e-5))
# Haline contraction, and the ratio of thermal expansion to it, at the surface, McDougall (1987), J. Phys. Oceanogr. 17, 1950-1964.
_BETA = ((0.785567e-3, -0.301985e-5, 0.555579e-7, -0.415613e-9), (-0.356603e-6, 0.788212e-8), 0.515032e-8)
_RATIO = ((0.665157e-1, 0.170907e-1, -0.203814e-3, 0.298357e-5, -0.255019e-7), (0.378110e-2, -0.846960e-4), -0.678662e-5)


def polynomial(x: Column, powers: tuple[float, ...]) -> Column:
    """sum of powers[i] * x**i, by Horner's rule."""
    out = F.lit(powers[-1])
    for c in reversed(powers[:-1]):
        out = out * x + F.lit(c)
    return out


def neutral_density(t: Column, s: Column) -> Column:
    """Density minus 1000 (kg/m3) of potential temperature (deg C) and practical salinity."""
    top = polynomial(t, _NUM_T) + (F.lit(_NUM_S[0]) + F.lit(_NUM_S[1]) * t + F.lit(_NUM_S[2]) * s) * s
    bottom = polynomial(t, _DEN_T) + polynomial(t, _DEN_S) * s + polynomial(t, _DEN_SS) * s * F.sqrt(s)
    return top / bottom - 1000.0


def specific_heat(t: Column, s: Column) -> Column:
    """J/(kg K) at the surface."""
    a, b, c = (polynomial(t, p) for p in _CP)
    return a + b * s + c * s * F.sqrt(s)


def haline_contraction(t: Column, s: Column) -> Column:
    d = s - 35.0
    return polynomial(t, _BETA[0]) + polynomial(t, _BETA[1]) * d + F.lit(_BETA[2]) * d * d


def thermal_expansion(t: Column, s: Column) -> Column:
    d = s - 35.0
    return (polynomial(t, _RATIO[0]) + polynomial(t, _RATIO[1]) * d + F.lit(_RATIO[2]) * d * d) * haline_contraction(t, s)


def density_flux_heat(heat: Column, t: Column, s: Column) -> Column:
    """Density flux of a heat flux into the ocean (W/m2): -alpha / cp * heat."""
    return -thermal_expansion(t, s) / specific_heat(t, s) * heat


def density_flux_water(loss: Column, t: Column, s: Column, times_salinity: bool = True) -> Column:
    """Density flux of a net freshwater loss (kg/m2/s): rho * beta * s * loss / 1000, or without s."""
    flux = (neutral_density(t, s) + 1000.0) * haline_contraction(t, s) * loss * 1e-3
    return flux * s if times_salinity else flux
