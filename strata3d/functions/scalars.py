"""Scalar expressions: tolerances, rounding, identifiers, map projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shapes import let

# --- fixed values: identifier format ----------------------------------------------------
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
IDENTIFIER = r"^([A-Z0-9]{14})-V(\d+)-([ASB])(\d{2})-(\d{3})-([A-Z0-9])$"
PARENT = r"^[A-Z0-9]{14}$"
# -----------------------------------------------------------------------------------------


def pair_tolerance(a: Column, b: Column, k: Column) -> Column:
    """k sigma of the difference of two measurements."""
    return k * F.hypot(a, b)


def negligible_area(tol: Column) -> Column:
    return F.greatest(tol * tol, F.lit(1e-9))


def z_overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column, tol: Column) -> Column:
    """Intervals share more than `tol`; any unknown limit means no."""
    known = lo_a.isNotNull() & hi_a.isNotNull() & lo_b.isNotNull() & hi_b.isNotNull()
    return known & (F.greatest(lo_a, lo_b) < F.least(hi_a, hi_b) - tol)


def round_exact(x: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value.

    `round`/`bround` work on the shortest decimal text, so 2.675 rounds up there; its
    binary value lies below the tie. The error term of x*10^n decides real ties.
    """
    m = float(10 ** digits)
    p = x * F.lit(m)
    c = x * F.lit(134217729.0)
    hi = c - (c - x)
    e = (hi * F.lit(m) - p) + (x - hi) * F.lit(m)
    f = F.floor(p)
    d = p - f
    up = (d > 0.5) | ((d == 0.5) & ((e > 0) | ((e == 0) & (F.pmod(f, F.lit(2)) == 1))))
    return (f + F.when(up, 1).otherwise(0)).cast("double") / F.lit(m)


def check_character(body: Column) -> Column:
    """ISO 7064 MOD 37,36 check character of an identifier body; NULL on foreign text."""
    def step(p, ch):
        at = F.call_function("instr", F.lit(ALPHABET), ch) - 1
        r = F.pmod(F.pmod(p, F.lit(37)) + at, F.lit(36))
        return F.pmod(F.when(r == 0, F.lit(36)).otherwise(r) * 2, F.lit(37))

    total = F.aggregate(F.split(body, ""), F.lit(36), step)
    at = F.pmod(F.lit(37) - total, F.lit(36)) + 1
    return F.when(body.rlike("^[A-Z0-9]+$"), F.substring(F.lit(ALPHABET), at, F.lit(1)))


def version_number(version: Column) -> Column:
    """'v1' -> 1; an empty tail counts as 1, other text raises."""
    tail = F.regexp_replace(version, "^[vV]+", "")
    return F.when(tail == "", 1).otherwise(tail.cast("int"))


def format_identifier(parent: Column, version: Column, stratum: Column,
                      level: Column, sequence: Column) -> Column:
    """Identifier text, or NULL when a field does not fit the format."""
    up = F.upper(parent)
    lv = F.lpad(level.cast("string"), 2, "0")
    sq = F.lpad(sequence.cast("string"), 3, "0")
    body = F.concat(up, F.lit("V"), version.cast("string"), stratum, lv, sq)
    text = F.concat(up, F.lit("-V"), version.cast("string"), F.lit("-"), stratum, lv,
                    F.lit("-"), sq, F.lit("-"), check_character(body))
    fits = up.rlike(PARENT) & level.between(0, 99) & sequence.between(0, 999)
    return F.when(fits, text)


def identifier_parts(ulpin: Column) -> Column:
    """Struct of the identifier's fields, NULL when malformed or the check fails."""
    def g(i):
        return F.regexp_extract(ulpin, IDENTIFIER, i)

    body = F.concat(g(1), F.lit("V"), g(2), g(3), g(4), g(5))
    ok = ulpin.rlike(IDENTIFIER) & (check_character(body) == g(6))
    return F.when(ok, F.struct(
        g(1).alias("parent_ulpin_14"), g(2).try_cast("int").alias("version"), g(3).alias("stratum"), g(4).cast("int").alias("level"),
        g(5).cast("int").alias("sequence")))


def is_identifier(ulpin: Column) -> Column:
    return F.coalesce(identifier_parts(ulpin).isNotNull(), F.lit(False))


def identifier_urn(ulpin: Column) -> Column:
    p = identifier_parts(ulpin)
    return F.when(p.isNotNull(), F.concat(
        F.lit("urn:ulpin:3d:v"), p["version"].cast("string"), F.lit(":"),
        p["parent_ulpin_14"], F.lit(":"), p["stratum"], F.lit(":"),
        F.lpad(p["level"].cast("string"), 2, "0"), F.lit(":"),
        F.lpad(p["sequence"].cast("string"), 3, "0")))


def short_id(prefix: Column) -> Column:
    """Readable source id. Non-deterministic: write or checkpoint before reusing it."""
    return F.concat(F.lit("SRC-"), F.regexp_replace(F.upper(prefix), "_", "-"), F.lit("-"),
                    F.substring(F.md5(F.uuid().cast("binary")), 1, 6))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


# --- transverse Mercator (Krueger series to n^4, WGS84) ---------------------------------
_A, _INV_F, _K0 = 6378137.0, 298.257223563, 0.9996
_N = (1 / _INV_F) / (2 - 1 / _INV_F)
_E = (1 - (1 - 1 / _INV_F) ** 2) ** 0.5
_RADIUS = _A / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64)
_ALPHA = (_N / 2 - 2 * _N ** 2 / 3 + 5 * _N ** 3 / 16 + 41 * _N ** 4 / 180,
          13 * _N ** 2 / 48 - 3 * _N ** 3 / 5 + 557 * _N ** 4 / 1440,
          61 * _N ** 3 / 240 - 103 * _N ** 4 / 140,
          49561 * _N ** 4 / 161280)
_BETA = (_N / 2 - 2 * _N ** 2 / 3 + 37 * _N ** 3 / 96 - _N ** 4 / 360,
         _N ** 2 / 48 + _N ** 3 / 15 - 437 * _N ** 4 / 1440,
         17 * _N ** 3 / 480 - 37 * _N ** 4 / 840,
         4397 * _N ** 4 / 161280)


def _sum(terms):
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def utm_zone(crs: Column) -> Column:
    """Signed UTM zone of an EPSG code (south negative); NULL for any other system."""
    code = F.regexp_extract(crs, r"^EPSG:(\d{1,9})$", 1).try_cast("int")
    return (F.when(code.between(32601, 32660), code - 32600)
            .when(code.between(32701, 32760), -(code - 32700)))


def utm_forward(lon: Column, lat: Column, zone: Column) -> Column:
    """Longitude/latitude in degrees to struct<x,y> in metres."""
    lam = F.radians(lon - (F.abs(zone) * 6 - 183))
    phi = F.radians(lat)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_E) * F.atanh(F.lit(_E) * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    x = eta + _sum([F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
                    for j, a in enumerate(_ALPHA, 1)])
    y = xi + _sum([F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
                   for j, a in enumerate(_ALPHA, 1)])
    north = F.when(zone < 0, 10000000.0).otherwise(0.0)
    return F.struct((F.lit(500000.0) + F.lit(_K0 * _RADIUS) * x).alias("x"),
                    (north + F.lit(_K0 * _RADIUS) * y).alias("y"))


def utm_inverse(x: Column, y: Column, zone: Column) -> Column:
    """Metres to struct<x: longitude, y: latitude> in degrees.

    Each step is bound once: written out, five rounds of latitude repeat all before them, and inside
    a lambda (rings) nothing shares them.
    """
    north = F.when(zone < 0, 10000000.0).otherwise(0.0)
    xi = (y - north) / F.lit(_K0 * _RADIUS)
    eta = (x - 500000.0) / F.lit(_K0 * _RADIUS)

    def conformal(s):
        xp = s["xi"] - _sum([F.lit(b) * F.sin(s["xi"] * (2 * j)) * F.cosh(s["eta"] * (2 * j))
                             for j, b in enumerate(_BETA, 1)])
        ep = s["eta"] - _sum([F.lit(b) * F.cos(s["xi"] * (2 * j)) * F.sinh(s["eta"] * (2 * j))
                              for j, b in enumerate(_BETA, 1)])
        return let(F.struct(xp.alias("xp"), ep.alias("ep")), geodetic)

    def geodetic(c):
        lon = F.abs(zone) * 6 - 183 + F.degrees(F.atan2(F.sinh(c["ep"]), F.cos(c["xp"])))
        chi = F.asin(F.sin(c["xp"]) / F.cosh(c["ep"]))
        return F.struct(lon.alias("x"), let(chi, lambda v: let(
            F.struct(v.alias("chi"), F.atanh(F.sin(v)).alias("q")), latitude)).alias("y"))

    def latitude(s):
        # conformal to geodetic latitude, fixed-point steps far below a nanodegree
        phi = s["chi"]
        for _ in range(5):
            phi = F.atan(F.sinh(s["q"] + F.lit(_E) * F.atanh(F.lit(_E) * F.sin(phi))))
        return F.degrees(phi)

    return let(F.struct(xi.alias("xi"), eta.alias("eta")), conformal)
