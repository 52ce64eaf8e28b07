"""Scalar geometry, date and habitat expressions: Column in, Column out, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii of the haversine (metres) and of the planar projection (kilometres).
EARTH_M, EARTH_KM = 6378137.0, 6371.0
INF = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


def rounded(x, digits: int) -> Column:
    """x to so many digits, half away from zero, as of the number scaled up: what SQL engines in doubles do.

    Spark's round goes by the decimal notation, so 0.5055445, which times 1e6 is
    a little less than 505544.5, would go up and not down.
    """
    return F.round(_c(x) * 10.0**digits) / 10.0**digits


def finite(x) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF)


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres; NaN where a coordinate is missing or not finite."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    a = clamp(a, 0.0, 1.0)
    ok = finite(lon1) & finite(lat1) & finite(lon2) & finite(lat2)
    return F.when(ok, 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))).otherwise(F.lit(float("nan")))


def to_xy_km(lon, lat, lon0: float = 0.0, lat0: float = 0.0) -> tuple[Column, Column]:
    """Equirectangular kilometres about a centre."""
    return F.radians(_c(lon) - lon0) * EARTH_KM * F.cos(F.radians(F.lit(lat0))), F.radians(_c(lat) - lat0) * EARTH_KM


def to_lonlat(x, y, lon0: float = 0.0, lat0: float = 0.0) -> tuple[Column, Column]:
    return F.lit(lon0) + F.degrees(_c(x) / (EARTH_KM * F.cos(F.radians(F.lit(lat0))))), F.lit(lat0) + F.degrees(_c(y) / EARTH_KM)


def bearing_deg(lon1, lat1, lon2, lat2, geographic: bool = True) -> Column:
    """Degrees clockwise from north; NULL for a step of no length."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    ex = (lon2 - lon1) * (F.cos(F.radians(lat1)) if geographic else F.lit(1.0))
    ny = lat2 - lat1
    return F.when((ex == 0) & (ny == 0), F.lit(None)).otherwise(F.pmod(F.degrees(F.atan2(ex, ny)), F.lit(360.0)))


def heading_bin(bearing, bins: int) -> Column:
    """1-based sector from bearing; a missing bearing is sector 1."""
    b = _c(bearing)
    return F.when(finite(b), F.least(F.lit(bins), F.floor(b / (360.0 / bins)).cast("int") + 1)).otherwise(1)


def turn_logweight(kappa: float, bearing, heading) -> Column:
    """kappa * cos of the turn; no heading: 0, no bearing: kappa."""
    b, h = _c(bearing), _c(heading)
    return F.when(~finite(h), 0.0).when(~finite(b), float(kappa)).otherwise(kappa * F.cos(F.radians(b - h)))


def decimal_year(ts) -> Column:
    d = _c(ts).cast("date")
    y = F.year(d)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return y + (F.dayofyear(d) - 1) / F.when(leap, 366.0).otherwise(365.0)


def flexible_date(text) -> Column:
    """Dates in mixed spellings: ISO, Y/M/D, D/M/Y or M/D/Y (first part over 12: day first), decimal years,
    days since 1970 up to 60000, epoch seconds from 1e8; anything else is NULL."""
    s = F.trim(_c(text))
    n = F.expr(f"try_cast(trim({text}) AS DOUBLE)")
    y = F.floor(n).cast("int")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(leap, 366).otherwise(365)
    doy = F.least(days, F.greatest(F.lit(1), F.rint((n - y) * days).cast("int") + 1))
    year_first = F.regexp_extract(s, r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})", 0) != ""
    part = lambda rx, k: F.expr(f"try_cast(regexp_extract(trim({text}), '{rx}', {k}) AS INT)")
    yf, yl = r"^(\\d{4})[-/](\\d{1,2})[-/](\\d{1,2})", r"^(\\d{1,2})[-/](\\d{1,2})[-/](\\d{4})"
    iso = F.try_make_date(part(yf, 1), part(yf, 2), part(yf, 3)) if hasattr(F, "try_make_date") else _date(part(yf, 1), part(yf, 2), part(yf, 3))
    p1, p2, p3 = part(yl, 1), part(yl, 2), part(yl, 3)
    last = F.when(p1 > 12, _date(p3, p2, p1)).otherwise(_date(p3, p1, p2))
    number = (
        F.when((n >= 1900) & (n < 2101) & (n != y), F.date_add(_date(y, F.lit(1), F.lit(1)), doy - 1))
        .when((n == y) & (n >= 1900) & (n < 2101), _date(y, F.lit(1), F.lit(1)))
        .when((n >= 0) & (n <= 60000) & (n == y), F.date_add(F.lit("1970-01-01").cast("date"), y))
        .when(n >= 1e8, F.timestamp_seconds(n.cast("long")).cast("date"))
    )
    return F.when(n.isNotNull(), number).when(year_first, iso).otherwise(last)


def _date(y: Column, m: Column, d: Column) -> Column:
    """make_date that gives NULL for a day that does not exist."""
    first = F.when((m >= 1) & (m <= 12) & (y >= 1), F.make_date(y, F.greatest(F.lit(1), F.least(F.lit(12), m)), F.lit(1)))
    return F.when((d >= 1) & (d <= F.dayofmonth(F.last_day(first))), F.date_add(first, d - 1))


def alpha_rho(velocity, diffusion) -> tuple[Column, Column]:
    """Directed share and residency of a step from velocity and diffusion."""
    v, d = _c(velocity), _c(diffusion)
    total = v + d + 1e-6
    return clamp(v / total, 0.0, 1.0), clamp(1 / (1 + total), 0.01, 0.95)


def _fade(x: Column, start: float, end: float) -> Column:
    """1 up to start, 0 from end on, half a cosine between."""
    return 0.5 * (1 + F.cos(F.lit(3.141592653589793) * clamp((x - start) / (end - start), 0.0, 1.0)))


def habitat_suitability(temperature, depth, half: float = 5.0, steepness: float = 1.0, best: float = 150.0, spread: float = 50.0, shallow: float = 20.0, deep: float = 400.0, end: float = 10.0) -> Column:
    """Falling logistic of temperature that fades out from half to end degrees, times a Gaussian of depth (its absolute value) that fades out to shallow and to deep; in [0, 1]."""
    t, z = _c(temperature), F.abs(_c(depth))
    thermal = _fade(t, half, end) / (1 + F.exp(steepness * (t - half)))
    bathy = F.exp(-0.5 * F.pow((z - best) / spread, 2)) * F.when(z < best, 1 - _fade(z, shallow, best)).otherwise(_fade(z, best, deep))
    return clamp(thermal * bathy, 0.0, 1.0)


def ring_area(ring) -> Column:
    """Shoelace area of array<struct<x,y>>: points that are not finite and a closing vertex are dropped; under three points 0."""
    r = F.filter(_c(ring), lambda p: finite(p["x"]) & finite(p["y"]))
    closed = (F.size(r) > 1) & (F.element_at(r, 1)["x"] == F.element_at(r, -1)["x"]) & (F.element_at(r, 1)["y"] == F.element_at(r, -1)["y"])
    r = F.when(closed, F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    turned = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    cross = F.zip_with(r, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(r) < 3, 0.0).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda a, b: a + b)) / 2)


#: Coordinate spaces: degrees, kilometres of a plane, or to be told from the values (fixed names).
SPACES = ("geographic", "planar_km", "unknown")


#: Extents (west, east, south, north) within which coordinates count as degrees if nothing says what they are, and how
#: far west the westernmost must lie at least (fixed values).
DEGREE_BOXES = ((-180.0, -10.0, 30.0, 85.0, -20.0), (100.0, 180.0, -50.0, 70.0, 180.0), (-180.0, -50.0, -60.0, 75.0, -50.0))


def looks_geographic(*points) -> Column:
    """Whether points (lon, lat) lie in one of the extents of degrees together; a point that is not finite counts for nothing, and none at all is no."""
    ok = [finite(x) & finite(y) for x, y in points]
    some = lambda k, far: [F.when(o, _c(p[k])).otherwise(far) for o, p in zip(ok, points, strict=True)]
    least = lambda k: F.least(*some(k, INF), F.lit(INF))
    most = lambda k: F.greatest(*some(k, -INF), F.lit(-INF))
    boxed = F.lit(False)
    for west, east, south, north, furthest in DEGREE_BOXES:
        boxed = boxed | ((least(0) >= west) & (most(0) <= east) & (least(1) >= south) & (most(1) <= north) & (least(0) <= furthest))
    some_point = F.lit(False)
    for o in ok:
        some_point = some_point | o
    return some_point & boxed


def node_distance_km(x1, y1, x2, y2, space: str = "unknown") -> Column:
    """Kilometres between two nodes: great-circle for degrees, Euclidean for a plane; for unknown, by looks_geographic()."""
    if space not in SPACES:
        raise ValueError(f"space {space!r}: one of {SPACES}")
    plane = F.hypot(_c(x1) - _c(x2), _c(y1) - _c(y2))
    globe = haversine_m(x1, y1, x2, y2) / 1000
    return {"geographic": globe, "planar_km": plane, "unknown": F.when(looks_geographic((x1, y1), (x2, y2)), globe).otherwise(plane)}[space]
