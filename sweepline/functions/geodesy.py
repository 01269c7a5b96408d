"""Column expressions between geodetic, earth-centred, local and transverse Mercator coordinates (WGS 84)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the ellipsoid.
A, INVERSE_F = 6378137.0, 298.257223563
FLAT = 1 / INVERSE_F
E2 = FLAT * (2 - FLAT)
N3 = FLAT / (2 - FLAT)


def to_ecef(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    """Earth-centred metres of degrees and ellipsoidal height."""
    p, q = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return (n + h) * F.cos(p) * F.cos(q), (n + h) * F.cos(p) * F.sin(q), (n * (1 - E2) + h) * F.sin(p)


def to_geodetic(x: Column, y: Column, z: Column, steps: int = 2) -> tuple[Column, Column, Column]:
    """Degrees and height by a closed first estimate and fixed-point steps."""
    r = F.sqrt(x * x + y * y)
    b = A * (1 - FLAT)
    t = F.atan2(z * A, r * b)
    e2 = E2 / (1 - E2)
    lat = F.atan2(z + e2 * b * F.pow(F.sin(t), F.lit(3)), r - E2 * A * F.pow(F.cos(t), F.lit(3)))
    for _ in range(steps):
        n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
        lat = F.atan2(z + E2 * n * F.sin(lat), r)
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    # stable at every latitude
    h = r * F.cos(lat) + z * F.sin(lat) - A * A / n
    return F.degrees(lat), F.degrees(F.atan2(y, x)), h


def to_enu(x: Column, y: Column, z: Column, lat0: float, lon0: float, h0: float) -> tuple[Column, Column, Column]:
    """East, north, up from an origin."""
    p, q = math.radians(lat0), math.radians(lon0)
    n = A / math.sqrt(1 - E2 * math.sin(p) ** 2)
    ox, oy = (n + h0) * math.cos(p) * math.cos(q), (n + h0) * math.cos(p) * math.sin(q)
    dx, dy, dz = x - ox, y - oy, z - (n * (1 - E2) + h0) * math.sin(p)
    flat = math.cos(q) * dx + math.sin(q) * dy
    return (
        -math.sin(q) * dx + math.cos(q) * dy,
        -math.sin(p) * flat + math.cos(p) * dz,
        math.cos(p) * flat + math.sin(p) * dz,
    )


def utm_zone(lat: Column, lon: Column) -> Column:
    """The zone number, with the wide zones of southern Norway and Svalbard."""
    plain = (F.floor((lon + 180) / 6).cast("int") % 60) + 1
    svalbard = (lat >= 72) & (lat < 84) & (lon >= 0) & (lon < 42)
    return (
        F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32)
        .when(svalbard & (lon < 9), 31)
        .when(svalbard & (lon < 21), 33)
        .when(svalbard & (lon < 33), 35)
        .when(svalbard, 37)
        .otherwise(plain)
    )


def epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat < 0, 32700).otherwise(32600) + utm_zone(lat, lon)


#: The transverse Mercator series to the sixth order in n = f / (2 - f); row j has the factors of n^j, n^(j+1), ... of its term.
FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
BACKWARD = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)
RADIUS = A / (1 + N3) * (1 + N3**2 / 4 + N3**4 / 64 + N3**6 / 256)
K0 = 0.9996
E = 2 * math.sqrt(N3) / (1 + N3)


def terms(series: tuple) -> list[float]:
    return [sum(f * N3 ** (j + i) for i, f in enumerate(row)) for j, row in enumerate(series, 1)]


def _conformal(p: Column) -> Column:
    return F.sinh(F.atanh(F.sin(p)) - E * F.atanh(E * F.sin(p)))


def _added(first: Column, others) -> Column:
    for x in others:
        first = first + x
    return first


def transverse_mercator(lat: Column, lon: Column, lon0: Column) -> dict[str, Column]:
    """x and y from the central meridian and the equator, scale k and convergence gamma (degrees), by the series."""
    p = F.radians(lat)
    dl = F.radians(F.pmod(lon - lon0 + 180, F.lit(360.0)) - 180)
    t, c = _conformal(p), F.cos(dl)
    hyp = F.sqrt(t * t + c * c)
    xi, eta = F.atan2(t, c), F.asinh(F.sin(dl) / hyp)
    a = list(enumerate(terms(FORWARD), 1))
    north = _added(xi, (f * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, f in a))
    east = _added(eta, (f * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, f in a))
    dx = _added(F.lit(1.0), (2 * j * f * F.cos(2 * j * xi) * F.cosh(2 * j * eta) for j, f in a))
    de = _added(F.lit(0.0), (2 * j * f * F.sin(2 * j * xi) * F.sinh(2 * j * eta) for j, f in a))
    k = F.sqrt(1 - E2 * F.sin(p) * F.sin(p)) / (F.cos(p) * hyp) * F.sqrt(dx * dx + de * de)
    gamma = F.degrees(F.atan2(t * F.tan(dl), F.sqrt(1 + t * t)) + F.atan2(de, dx))
    return {"x": K0 * RADIUS * east, "y": K0 * RADIUS * north, "k": K0 * RADIUS / A * k, "gamma": gamma}


def inverse_transverse_mercator(x: Column, y: Column, lon0: Column, steps: int = 4) -> tuple[Column, Column]:
    """Latitude and longitude of x and y from the central meridian and the equator; Newton steps double the digits of the latitude."""
    xi, eta = y / (K0 * RADIUS), x / (K0 * RADIUS)
    b = list(enumerate(terms(BACKWARD), 1))
    north = _added(xi, (-f * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, f in b))
    east = _added(eta, (-f * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, f in b))
    sh, c = F.sinh(east), F.cos(north)
    goal = F.sin(north) / F.sqrt(sh * sh + c * c)

    def step(t: Column) -> Column:
        s = F.sinh(E * F.atanh(E * t / F.sqrt(1 + t * t)))
        now = t * F.sqrt(1 + s * s) - s * F.sqrt(1 + t * t)
        return t + (goal - now) * (1 + (1 - E2) * t * t) / ((1 - E2) * F.sqrt(1 + t * t) * F.sqrt(1 + now * now))

    # an aggregate keeps the steps from being written into each other
    tau = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), goal, lambda t, _: step(t))
    return F.degrees(F.atan(tau)), F.pmod(lon0 + F.degrees(F.atan2(sh, c)) + 180, F.lit(360.0)) - 180


def central_meridian(zone: Column) -> Column:
    return zone * 6 - 183.0


def to_utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in the point's own zone."""
    tm = transverse_mercator(lat, lon, central_meridian(utm_zone(lat, lon)))
    return 500000 + tm["x"], F.when(lat < 0, 10000000.0).otherwise(0.0) + tm["y"]


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    return inverse_transverse_mercator(east - 500000, north - F.when(south, 10000000.0).otherwise(0.0), central_meridian(zone))


def from_enu(e: Column, n: Column, u: Column, lat0: float, lon0: float, h0: float) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of east, north, up from an origin."""
    p, q = math.radians(lat0), math.radians(lon0)
    r = A / math.sqrt(1 - E2 * math.sin(p) ** 2)
    flat = -math.sin(p) * n + math.cos(p) * u
    return (
        (r + h0) * math.cos(p) * math.cos(q) - math.sin(q) * e + math.cos(q) * flat,
        (r + h0) * math.cos(p) * math.sin(q) + math.cos(q) * e + math.sin(q) * flat,
        (r * (1 - E2) + h0) * math.sin(p) + math.cos(p) * n + math.sin(p) * u,
    )


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Length of a degree of latitude and of longitude at the ellipsoid."""
    s = F.sin(F.radians(lat))
    w = F.sqrt(1 - E2 * s * s)
    return F.radians(F.lit(A * (1 - E2))) / (w * w * w), F.radians(F.lit(A)) / w * F.cos(F.radians(lat))


def proj_string(lat: Column, lon: Column) -> Column:
    return F.concat(F.format_string("+proj=utm +zone=%d", utm_zone(lat, lon)), F.when(lat < 0, " +south").otherwise(""), F.lit(" +datum=WGS84 +units=m +no_defs"))


def wkt_name(lat: Column, lon: Column) -> Column:
    """The name that well-known text gives the zone."""
    return F.format_string("WGS 84 / UTM zone %d%s", utm_zone(lat, lon), F.when(lat < 0, "S").otherwise("N"))


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371000.0) -> Column:
    """Metres between two points of a sphere."""
    s = lambda a: F.sin(F.radians(a) / 2) * F.sin(F.radians(a) / 2)
    h = s(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s(lon2 - lon1)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
