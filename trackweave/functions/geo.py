"""Closed-form geometry as Column functions: telemetry, cameras, poses, headings. Angles are degrees; frames are north-east-down and x right, y down, z forward."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

METRES_PER_DEGREE = 111_320.0
MPH = 2.23694


def speed_mph(vn: Column, ve: Column) -> Column:
    return F.hypot(vn, ve) * MPH


def heading(vn: Column, ve: Column, dead: float = 0.01) -> Column:
    """(-180, 180], null if neither component exceeds the dead zone."""
    return F.when((F.abs(vn) > dead) | (F.abs(ve) > dead), F.degrees(F.atan2(ve, vn)))


def heading_360(vn: Column, ve: Column) -> Column:
    """[0, 360), 0 at rest."""
    return F.when(F.hypot(vn, ve) < 1e-6, F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(ve, vn)), F.lit(360.0)))


def angular_difference(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def wrap_180(a: Column) -> Column:
    return F.degrees(F.atan2(F.sin(F.radians(a)), F.cos(F.radians(a))))


def lla_to_ned(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """Flat earth about (lat0, lon0, alt0)."""
    return (lat - lat0) * METRES_PER_DEGREE, (lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(lat0)), alt0 - alt


def ned_to_lla(n: Column, e: Column, d: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    return lat0 + n / METRES_PER_DEGREE, lon0 + e / (METRES_PER_DEGREE * F.cos(F.radians(lat0))), alt0 - d


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """EPSG:3857, latitude clipped to 85 degrees either way."""
    lat = F.greatest(F.lit(-85.0), F.least(F.lit(85.0), lat))
    return lon * 20037508.34 / 180, F.log(F.tan((90 + lat) * F.pi() / 360)) / (F.pi() / 180) * 20037508.34 / 180


def unproject(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    return (u - cx) * depth / fx, (v - cy) * depth / fy, depth


def camera_axes(yaw: Column, pitch: Column, roll: Column) -> list[list[Column]]:
    """Rotation from camera to NED for a body turned by yaw, pitch, roll (in that order) with its camera looking forward."""
    cy, sy, cp, sp, cr, sr = (f(F.radians(a)) for a in (yaw, pitch, roll) for f in (F.cos, F.sin))
    body = [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]
    return [[row[1], row[2], row[0]] for row in body]


def effective_yaw(mode: Column, gimbal_yaw: Column, drone_yaw: Column, declination: float = 0.0, offset: float = 0.0) -> Column:
    """FPV follows the airframe; in the other modes the gimbal's yaw is absolute."""
    return F.when(F.lower(mode).contains("fpv"), drone_yaw).otherwise(gimbal_yaw) + declination + offset


def rotate(r: list[list[Column]], p: tuple[Column, Column, Column]) -> tuple[Column, ...]:
    return tuple(row[0] * p[0] + row[1] * p[1] + row[2] * p[2] for row in r)


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> list[list[Column]]:
    """Rotation of a quaternion that need not have length 1."""
    s = F.lit(2.0) / (x * x + y * y + z * z + w * w)
    return [[1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w)], [s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w)], [s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)]]


def rigid_inverse(r: list[list[Column]], t: tuple[Column, Column, Column]) -> tuple[list[list[Column]], tuple[Column, ...]]:
    back = [[r[j][i] for j in range(3)] for i in range(3)]
    return back, tuple(-c for c in rotate(back, t))


def focal(fov: Column, size: float) -> Column:
    return F.lit(size / 2) / F.tan(fov / 2)


def pitch_below_horizontal(gimbal_pitch: Column, least: float = 0.0) -> Column:
    return F.least(F.greatest(-gimbal_pitch, F.lit(least)), F.lit(90.0))


def slant_range(altitude: Column, below: Column) -> Column:
    """Distance along the line of sight to flat ground; null below 5 degrees or at no height."""
    return F.when((altitude > 0) & (below >= 5) & (below <= 90), altitude / F.sin(F.radians(below)))


def truthy(c: Column) -> Column:
    return F.upper(c.cast("string")).isin("TRUE", "1", "1.0")


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def gimbal_axes(mode: Column, pitch: Column, yaw: Column, roll: Column, drone_yaw: Column, drone_roll: Column, use_gimbal_yaw: bool = False, add_drone_yaw: bool = False, declination: float = 0.0, offset: float = 0.0) -> list[list[Column]]:
    """Rotation from camera to NED. The yaw is the airframe's, or the gimbal's if asked for (added to the airframe's in the modes that follow it, if that is asked for, too); in FPV mode the roll is added to the airframe's."""
    fpv = F.lower(mode).contains("fpv")
    own = F.lower(mode).contains("free") | F.lower(mode).contains("lock")
    heading_deg = drone_yaw if not use_gimbal_yaw else F.when(own & ~fpv, yaw).otherwise(drone_yaw + yaw) if add_drone_yaw else yaw
    return camera_axes(heading_deg + declination + offset, pitch, F.when(fpv, drone_roll + roll).otherwise(roll))


def camera_to_ned(r: list[list[Column]], point: tuple[Column, Column, Column], camera: tuple[Column, Column, Column]) -> tuple[Column, ...]:
    return tuple(a + b for a, b in zip(rotate(r, point), camera, strict=True))


#: Semi-major axis and flattening of WGS84.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
_E2 = WGS84_F * (2 - WGS84_F)


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates on the WGS84 ellipsoid."""
    la, lo = F.radians(lat), F.radians(lon)
    n = WGS84_A / F.sqrt(1 - _E2 * F.sin(la) * F.sin(la))
    return (n + alt) * F.cos(la) * F.cos(lo), (n + alt) * F.cos(la) * F.sin(lo), (n * (1 - _E2) + alt) * F.sin(la)


def _to_north_east_down(lat0: Column, lon0: Column) -> list[list[Column]]:
    sa, ca, so, co = (f(F.radians(x)) for x in (lat0, lon0) for f in (F.sin, F.cos))
    return [[-sa * co, -sa * so, ca], [-so, co, F.lit(0.0)], [-ca * co, -ca * so, -sa]]


def geodetic_to_ned(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, ...]:
    here, there = ecef(lat, lon, alt), ecef(lat0, lon0, alt0)
    return rotate(_to_north_east_down(lat0, lon0), tuple(a - b for a, b in zip(here, there, strict=True)))


def ned_to_geodetic(n: Column, e: Column, d: Column, lat0: Column, lon0: Column, alt0: Column, rounds: int = 6) -> tuple[Column, Column, Column]:
    """The inverse; the latitude by so many fixed-point steps, each of which gains over two digits near the ground."""
    r = _to_north_east_down(lat0, lon0)
    back = rotate([[r[j][i] for j in range(3)] for i in range(3)], (n, e, d))
    x, y, z = (a + b for a, b in zip(back, ecef(lat0, lon0, alt0), strict=True))
    p = F.hypot(x, y)
    start = F.atan2(z, p * (1 - _E2))

    def step(la: Column, _: Column) -> Column:
        big = WGS84_A / F.sqrt(1 - _E2 * F.sin(la) * F.sin(la))
        return F.atan2(z + _E2 * big * F.sin(la), p)
    la = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    big = WGS84_A / F.sqrt(1 - _E2 * F.sin(la) * F.sin(la))
    return F.degrees(la), F.degrees(F.atan2(y, x)), p * F.cos(la) + z * F.sin(la) - WGS84_A * WGS84_A / big


def local_metres(lat: Column, lon: Column, lat0: Column, lon0: Column, radius: float = 6_371_000.0) -> tuple[Column, Column]:
    """(east, north) on a sphere about a start."""
    return F.radians(lon - lon0) * radius * F.cos(F.radians(lat0)), F.radians(lat - lat0) * radius


def turned(east: Column, north: Column, yaw: Column) -> tuple[Column, Column]:
    """(right, ahead) of a start that looks along yaw."""
    a = F.radians(yaw)
    return east * F.cos(a) - north * F.sin(a), east * F.sin(a) + north * F.cos(a)


def euler(r: list[list[Column]]) -> tuple[Column, Column, Column]:
    """(pitch, roll, yaw) of a rotation of x right, y down, z forward."""
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -r[1][2])))), F.degrees(F.atan2(r[1][0], r[1][1])), F.degrees(F.atan2(r[0][2], r[2][2]))


def matrix_quaternion(r: list[list[Column]]) -> tuple[Column, Column, Column, Column]:
    """x, y, z, w (w not negative) of a rotation, from its largest component."""
    t = [1 + r[0][0] - r[1][1] - r[2][2], 1 - r[0][0] + r[1][1] - r[2][2], 1 - r[0][0] - r[1][1] + r[2][2], 1 + r[0][0] + r[1][1] + r[2][2]]
    off = {(0, 1): r[0][1] + r[1][0], (0, 2): r[0][2] + r[2][0], (1, 2): r[1][2] + r[2][1], (0, 3): r[2][1] - r[1][2], (1, 3): r[0][2] - r[2][0], (2, 3): r[1][0] - r[0][1]}
    most = F.greatest(*t)
    root = 2 * F.sqrt(most)

    def part(i: int) -> Column:
        out = F.lit(None).cast("double")
        for k in reversed(range(4)):
            out = F.when(t[k] == most, root / 4 if i == k else off[min(i, k), max(i, k)] / root).otherwise(out)
        return out
    q = [part(i) for i in range(4)]
    sign = F.when(q[3] < 0, -1.0).otherwise(1.0)
    return tuple(c * sign for c in q)


def distorted(x: Column, y: Column, k1: float, k2: float) -> tuple[Column, Column]:
    r2 = x * x + y * y
    s = 1 + k1 * r2 + k2 * r2 * r2
    return x * s, y * s


def undistorted(u: Column, v: Column, k1: float, k2: float, rounds: int = 12) -> tuple[Column, Column]:
    """The inverse of distorted(), by fixed-point steps."""
    def step(p: Column, _: Column) -> Column:
        r2 = p.x * p.x + p.y * p.y
        s = 1 + k1 * r2 + k2 * r2 * r2
        return F.struct((u / s).alias("x"), (v / s).alias("y"))
    p = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(u.alias("x"), v.alias("y")), step)
    return p["x"], p["y"]


#: The colours of no density and of the most.
SPARSE, DENSE = (204, 204, 204), (10, 36, 99)


def density_colour(density: Column, most: float, least: float = 0.0) -> Column:
    """A colour in hex between SPARSE and DENSE; what is outside of least to most has the colour of the end."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (density - least) / (most - least)))
    return F.format_string("#%02X%02X%02X", *(F.floor(a * (1 - t) + b * t).cast("int") for a, b in zip(SPARSE, DENSE, strict=True)))
