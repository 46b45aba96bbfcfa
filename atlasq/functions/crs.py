"""Transverse Mercator and conformal conic planes, worked out by series as column expressions or plain numbers."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half axis and inverse flattening of ellipsoids.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "intl": (6378388.0, 297.0), "airy": (6377563.396, 299.3249646), "bessel": (6377397.155, 299.1528128), "clrk66": (6378206.4, 294.9786982139), "krass": (6378245.0, 298.3)}
#: A metre's share of units.
UNITS = {"m": 1.0, "us-ft": 0.3048006096012192, "ft": 0.3048, "km": 1000.0}


class _Numbers:
    """The functions that the formulas need, of plain numbers."""

    sin, cos, tan, atan, atan2, sinh, cosh, asinh, atanh, sqrt, log, exp = (getattr(math, n) for n in "sin cos tan atan atan2 sinh cosh asinh atanh sqrt log exp".split())
    power = math.pow
    radians, degrees = math.radians, math.degrees

    @staticmethod
    def turn(x: float) -> float:
        """An angle within half a turn."""
        return (x + math.pi) % (2 * math.pi) - math.pi

    @staticmethod
    def let(f, *values):
        """f of values that are worked out once."""
        return f(*values)

    @staticmethod
    def pair(a, b):
        return a, b

    @staticmethod
    def parts(p):
        return p


class _Columns:
    """The same of columns."""

    sin, cos, tan, atan, atan2, sinh, cosh, asinh, atanh, sqrt, log, exp = (staticmethod(getattr(F, n)) for n in "sin cos tan atan atan2 sinh cosh asinh atanh sqrt log exp".split())
    power = staticmethod(F.pow)
    radians, degrees = staticmethod(F.radians), staticmethod(F.degrees)

    @staticmethod
    def turn(x: Column) -> Column:
        return F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi

    @staticmethod
    def let(f, *values: Column) -> Column:
        """Without it an expression would repeat its parts, and nested ones theirs, many times over."""
        row = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
        return F.element_at(F.transform(F.array(row), lambda r: f(*(r[f"v{i}"] for i in range(len(values))))), 1)

    @staticmethod
    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))

    @staticmethod
    def parts(p: Column) -> tuple[Column, Column]:
        return p["a"], p["b"]


def _functions(x):
    return _Columns if isinstance(x, Column) else _Numbers


def _series(n: float, *rows: tuple[float, ...]) -> tuple[float, ...]:
    """Coefficients: row k has those of n**(k + 1), n**(k + 2), ..."""
    return tuple(sum(c * n ** (k + 1 + i) for i, c in enumerate(row)) for k, row in enumerate(rows))


@dataclass(frozen=True)
class Plane:
    """Common to the projections: ellipsoid, origin in degrees, scale, false origin, a metre's share of the plane's unit."""

    a: float
    f: float
    lon: float = 0.0
    lat: float = 0.0
    scale: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    unit: float = 1.0

    @cached_property
    def e(self) -> float:
        return math.sqrt(self.f * (2 - self.f))

    @cached_property
    def third(self) -> float:
        """The third flattening, in whose powers the series go."""
        return self.f / (2 - self.f)

    @cached_property
    def to_latitude(self) -> tuple[float, ...]:
        """From conformal latitude to latitude."""
        return _series(self.third, (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675), (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945), (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835), (4279 / 630, -332 / 35, -399572 / 14175), (4174 / 315, -144838 / 6237), (601676 / 22275,))

    def latitude(self, chi):
        m = _functions(chi)
        out = chi
        for k, c in enumerate(self.to_latitude):
            out = out + c * m.sin(chi * (2 * (k + 1)))
        return out

    def placed(self, x, y):
        return (x + self.x0) / self.unit, (y + self.y0) / self.unit

    def unplaced(self, x, y):
        return x * self.unit - self.x0, y * self.unit - self.y0


class TransverseMercator(Plane):
    """By a series in the third flattening to its sixth power: within a micrometre up to 30 degrees from the central meridian."""

    @cached_property
    def radius(self) -> float:
        n = self.third
        return self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)

    @cached_property
    def alpha(self) -> tuple[float, ...]:
        """From the sphere's plane to the ellipsoid's."""
        return _series(self.third, (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800), (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360), (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440), (49561 / 161280, -179 / 168, 6601661 / 7257600), (34729 / 80640, -3418889 / 1995840), (212378941 / 319334400,))

    @cached_property
    def beta(self) -> tuple[float, ...]:
        """And back."""
        return _series(self.third, (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800), (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720), (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720), (4397 / 161280, -11 / 504, -830251 / 7257600), (4583 / 161280, -108847 / 3991680), (20648693 / 638668800,))

    def _plane(self, lam, phi):
        """East and north in radii, as a pair."""
        m = _functions(phi)

        def conformal(tau, c, s):
            root = m.sqrt(tau * tau + 1)
            return m.let(lambda sigma: sphere(tau * m.sqrt(sigma * sigma + 1) - sigma * root, c, s), m.sinh(m.atanh(tau / root * self.e) * self.e))

        def sphere(t, c, s):
            return m.let(lambda t: m.let(ellipsoid, m.atan2(t, c), m.asinh(s / m.sqrt(t * t + c * c))), t)

        def ellipsoid(xi, eta):
            north, east = xi, eta
            for k, a in enumerate(self.alpha):
                j = 2 * (k + 1)
                north, east = north + a * m.sin(xi * j) * m.cosh(eta * j), east + a * m.cos(xi * j) * m.sinh(eta * j)
            return m.pair(east, north)

        return m.let(conformal, m.tan(phi), m.cos(lam), m.sin(lam))

    @cached_property
    def origin(self) -> float:
        return self._plane(0.0, math.radians(self.lat))[1]

    def forward(self, lon, lat):
        m = _functions(lon)
        east, north = m.parts(self._plane(m.turn(m.radians(lon - self.lon)), m.radians(lat)))
        r = self.scale * self.radius
        return self.placed(east * r, (north - self.origin) * r)

    def backward(self, x, y):
        m = _functions(x)
        x, y = self.unplaced(x, y)
        r = self.scale * self.radius

        def sphere(xi, eta):
            north, east = xi, eta
            for k, c in enumerate(self.beta):
                j = 2 * (k + 1)
                north, east = north - c * m.sin(xi * j) * m.cosh(eta * j), east - c * m.cos(xi * j) * m.sinh(eta * j)
            return m.let(angles, north, east)

        def angles(xi, eta):
            s = m.sinh(eta)
            chi = m.atan2(m.sin(xi), m.sqrt(s * s + m.cos(xi) * m.cos(xi)))
            return m.pair(m.degrees(m.turn(m.atan2(s, m.cos(xi)) + math.radians(self.lon))), m.degrees(m.let(self.latitude, chi)))

        return m.parts(m.let(sphere, y / r + self.origin, x / r))


@dataclass(frozen=True)
class Conic(Plane):
    """A conformal cone through one or two parallels."""

    first: float = 0.0
    second: float = 0.0

    def _t(self, phi):
        m = _functions(phi)
        s = m.sin(phi) * self.e
        return m.tan(math.pi / 4 - phi / 2) / m.power((1 - s) / (1 + s), self.e / 2)

    def _m(self, phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (self.e * math.sin(phi)) ** 2)

    @cached_property
    def cone(self) -> tuple[float, float, float]:
        """Its constant, the factor of its radii, and the radius at the origin."""
        p, q = math.radians(self.first), math.radians(self.second)
        n = math.sin(p) if abs(p - q) < 1e-12 else math.log(self._m(p) / self._m(q)) / math.log(self._t(p) / self._t(q))
        factor = self.scale * self.a * self._m(p) / (n * self._t(p) ** n)
        return n, factor, factor * self._t(math.radians(self.lat)) ** n

    def forward(self, lon, lat):
        m = _functions(lon)
        n, factor, origin = self.cone

        def flat(theta, rho):
            return m.pair(rho * m.sin(theta), origin - rho * m.cos(theta))

        rho = m.let(lambda phi: m.power(self._t(phi), n) * factor, m.radians(lat))
        return self.placed(*m.parts(m.let(flat, m.turn(m.radians(lon - self.lon)) * n, rho)))

    def backward(self, x, y):
        m = _functions(x)
        n, factor, origin = self.cone
        x, y = self.unplaced(x, y)
        sign = 1.0 if n > 0 else -1.0

        def angles(x, down):
            chi = m.atan(m.power(m.sqrt(x * x + down * down) / abs(factor), 1 / n)) * -2 + math.pi / 2
            return m.pair(m.degrees(m.turn(m.atan2(x * sign, down) / n + math.radians(self.lon))), m.degrees(m.let(self.latitude, chi)))

        return m.parts(m.let(angles, x, (y * -1 + origin) * sign))


_PART = re.compile(r"\+(\w+)(?:=(\S+))?")
#: Codes of planes with parameters of their own; those of numbered zones follow from the number.
CODES = {
    "epsg:2154": "+proj=lcc +lat_0=46.5 +lon_0=3 +lat_1=49 +lat_2=44 +x_0=700000 +y_0=6600000 +ellps=GRS80",
    "epsg:3034": "+proj=lcc +lat_0=52 +lon_0=10 +lat_1=35 +lat_2=65 +x_0=4000000 +y_0=2800000 +ellps=GRS80",
}


def definition(srs: str) -> str:
    """The parameters of a code: the codes above, and zones 326zz (north), 327zz (south) and 258zz."""
    low = srs.strip().lower().removeprefix("+init=")
    if low in CODES:
        return CODES[low]
    if m := re.fullmatch(r"epsg:(326|327|258)(\d\d)", low):
        zone = int(m[2])
        if 1 <= zone <= 60:
            return f"+proj=utm +zone={zone}" + (" +south" if m[1] == "327" else "") + (" +ellps=GRS80" if m[1] == "258" else " +ellps=WGS84")
    return srs


def plane(srs: str) -> Plane | None:
    """The plane of a code or of parameters (+proj=utm, tmerc or lcc); none for anything else.

    Datums are not shifted: ellipsoidal coordinates are taken as they are.
    """
    own = {k.lower(): v for k, v in _PART.findall(definition(srs))}
    kind = own.get("proj")
    if kind not in ("utm", "tmerc", "lcc"):
        return None
    a, inverse = ELLIPSOIDS.get(own.get("ellps") or own.get("datum") or "WGS84", (None, None))
    if "a" in own:
        a = float(own["a"])
        f = 1 - float(own["b"]) / a if "b" in own else 1 / float(own["rf"]) if "rf" in own else 0.0
    elif a is None:
        raise ValueError(f"no ellipsoid {own.get('ellps') or own.get('datum')!r}")
    else:
        f = 1 / inverse
    number = lambda *names, default=0.0: next((float(own[n]) for n in names if n in own), default)
    unit = number("to_meter", default=UNITS[own.get("units", "m")])
    if kind == "utm":
        zone = int(own["zone"])
        return TransverseMercator(a, f, 6.0 * zone - 183, 0.0, 0.9996, 500000.0, 10_000_000.0 if "south" in own else 0.0, unit)
    common = (a, f, number("lon_0"), number("lat_0"), number("k_0", "k", default=1.0), number("x_0"), number("y_0"), unit)
    if kind == "tmerc":
        return TransverseMercator(*common)
    first = number("lat_1", default=number("lat_0"))
    return Conic(*common, first=first, second=number("lat_2", default=first))
