"""Column expressions: weights, calendars, regions, basins, wind and pressure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KNOTS = 1.94384449  # a metre a second, in knots
EARTH_M = 6.37122e6


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, null where den is zero or null."""
    return col(num) / F.nullif(col(den).cast("double"), F.lit(0.0))


def missing(x: Column | str) -> Column:
    """NaN as null: null is the missing value everywhere."""
    return F.when(F.isnan(col(x)), None).otherwise(col(x))


def weight(lat: Column | str = "lat") -> Column:
    """Area weight of a cell."""
    return F.cos(F.radians(col(lat)))


def weighted_mean(x: Column | str, w: Column) -> Column:
    """Missing values are left out of both sums."""
    return F.sum(w * col(x)) / F.nullif(F.sum(F.when(col(x).isNotNull(), w)), F.lit(0.0))


def sinc(x: Column) -> Column:
    """sin(pi x) / (pi x)."""
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(F.lit(3.141592653589793) * x) / F.nullif(F.lit(3.141592653589793) * x, F.lit(0.0)))


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")


def seasons(month: Column) -> Column:
    """The seasons a month counts in, for a fan-out of one scan."""
    return F.array(F.lit("All"), season(month))


def regions(lat: Column | str = "lat") -> Column:
    """The regions a latitude counts in."""
    return F.array(F.lit("Global"), F.when(col(lat).between(-30, 30), "Tropics").otherwise("Extratropics"))


def lon_wrap(lon: Column | str) -> Column:
    return F.when(col(lon) < 0, col(lon) + 360).otherwise(col(lon))


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Haversine distance, in the radius's unit (radius 1: radians)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def arc_points(lat1: Column, lon1: Column, lat2: Column, lon2: Column, n: int, signed: bool = False) -> Column:
    """Array of n points (lat, lon), evenly spaced along the great circle from the first
    place to the second, both included; longitudes from 0 to 360, or from -180 to 180
    where they are signed.  Two points are the places as they are; places that are one
    have n equal points, and between opposite ones, which no one circle joins, the points
    are null."""
    ends = F.array(F.struct(lat1.cast("double").alias("lat"), lon1.cast("double").alias("lon")), F.struct(lat2.cast("double").alias("lat"), lon2.cast("double").alias("lon")))
    if n <= 2:
        return ends
    place = lambda p: F.struct((F.cos(F.radians(p["lat"])) * F.cos(F.radians(p["lon"]))).alias("x"), (F.cos(F.radians(p["lat"])) * F.sin(F.radians(p["lon"]))).alias("y"), F.sin(F.radians(p["lat"])).alias("z"))
    shares = F.sequence(F.lit(0), F.lit(n - 1))

    def along(arc: Column) -> Column:
        c, a, b = arc["c"], arc["p"][0], arc["p"][1]

        def point(k: Column) -> Column:
            f = k / (n - 1)
            u = F.when(c == 0, F.lit(1.0) - f).when(F.abs(F.sin(c)) > 1e-12, F.sin((F.lit(1.0) - f) * c) / F.sin(c))
            v = F.when(c == 0, f).when(F.abs(F.sin(c)) > 1e-12, F.sin(f * c) / F.sin(c))
            x, y, z = (u * a[d] + v * b[d] for d in "xyz")
            lon = F.degrees(F.atan2(y, x))
            return F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"), (F.pmod(lon + 180, F.lit(360.0)) - 180 if signed else F.pmod(lon, F.lit(360.0))).alias("lon"))

        return F.transform(shares, point)

    arc = F.struct(great_circle(lat1, lon1, lat2, lon2, 1.0).alias("c"), F.transform(ends, place).alias("p"))
    return F.transform(F.array(arc), along)[0]


def arc_spacing(lat1: Column, lon1: Column, lat2: Column, lon2: Column, n: int, radius: float = EARTH_M) -> Column:
    """Distance between neighbours of arc_points(), in the radius's unit."""
    return great_circle(lat1, lon1, lat2, lon2, radius) / max(n - 1, 1)


#: Basin codes and names.
BASIN_NAMES = {1: "NATL", 2: "EPAC", 3: "CPAC", 4: "WPAC", 5: "NIO", 6: "SIO", 7: "SPAC", 8: "SATL", 9: "FLA", 20: "NHEMI", 21: "SHEMI"}


def basin(lat: Column | str = "lat", lon: Column | str = "lon") -> Column:
    """Basin code of a genesis point (0: none); the Atlantic is parted from the
    East Pacific by a sloped line."""
    y, x = col(lat), lon_wrap(lon)
    north = (
        F.when((x > 257) & (x <= 359), F.when(y > -0.58 * x + 171.1, 1).otherwise(2))
        .when((x > 220) & (x <= 257), 2).when((x > 180) & (x <= 220), 3).when((x > 100) & (x <= 180), 4).when((x > 30) & (x <= 100), 5).otherwise(0)
    )
    south = F.when((x > 30) & (x <= 135), 6).when((x > 135) & (x <= 290), 7).otherwise(0)
    return F.when(F.abs(y) > 50, 0).when(y >= 0, north).otherwise(south)


def basin_name(code: Column | str) -> Column:
    """Negative codes are the globe."""
    names = F.create_map(*[F.lit(x) for pair in BASIN_NAMES.items() for x in pair])
    return F.when(col(code) < 0, "GLOB").otherwise(F.try_element_at(names, col(code)))


def wind_from_pressure(pres: Column | str) -> Column:
    """m/s from hPa, the sign of 1010 - pres kept."""
    d = F.lit(1010.0) - col(pres)
    return 2.3 * F.signum(d) * F.pow(F.abs(d), 0.76)


def pressure_from_wind(wind: Column | str) -> Column:
    w = col(wind) / 2.3
    return F.lit(1010.0) - F.signum(w) * F.pow(F.abs(w), 1 / 0.76)


def filled_pressure(pres: Column | str, wind: Column | str) -> Column:
    """Negative is missing; one is worked out from the other, both from defaults."""
    return F.when((col(pres) < 0) & (col(wind) < 0), 1008.0).when(col(pres) < 0, pressure_from_wind(wind)).otherwise(col(pres))


def filled_wind(pres: Column | str, wind: Column | str) -> Column:
    return F.when((col(pres) < 0) & (col(wind) < 0), 15.0).when(col(wind) < 0, wind_from_pressure(pres)).otherwise(col(wind))


def phase(pc1: Column | str, pc2: Column | str) -> Column:
    """Phase 1 to 8 of a pair of components."""
    angle = F.degrees(F.atan2(col(pc1), col(pc2)))
    turned = F.pmod(angle, F.lit(360.0)) + 180
    return (F.floor(turned / 45) % 8 + 1).cast("int")


def effect_class(d: Column | str) -> Column:
    """Size class of an effect."""
    a = F.abs(col(d))
    return (
        F.when(a < 0.01, "none").when(a < 0.2, "very small").when(a < 0.5, "small").when(a < 0.8, "medium")
        .when(a < 1.2, "large").when(a < 2.0, "very large").otherwise("huge")
    )


def grid_index(x: Column | str, origin: float, step: float) -> Column:
    """Bin number, truncated towards zero."""
    return ((col(x) - origin) / step).cast("int")


def normal_units(unit: Column | str) -> Column:
    """Exponents as powers: m-2 becomes m**-2."""
    return F.regexp_replace(col(unit), r"([A-Za-z])(-?[0-9]+)", "$1**$2")
