"""Distances and time-to-collision as closed-form columns.

Positions are metres, speeds km/h, yaw degrees, angles of latitude/longitude
degrees. "No collision" is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadlens.functions.numeric import ratio

# Fixed values of the motion rules.
EARTH_RADIUS_M = 6371000.0
MIN_CLOSING_SPEED = 0.5  # m/s
MIN_GAP_M = 2.0
KMH_PER_MS = 3.6


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_m: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    half = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * radius_m) * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def signed_line_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance to the line AB, positive on its left; distance to A if A = B."""
    dx, dy = bx - ax, by - ay
    length = F.hypot(dx, dy)
    side = ratio(dx * (py - ay) - dy * (px - ax), length)
    return F.when(length < 1e-9, F.hypot(px - ax, py - ay)).otherwise(side)


def line_distance(px, py, ax, ay, bx, by) -> Column:
    return F.abs(signed_line_distance(px, py, ax, ay, bx, by))


def velocity(speed_kmh: Column, yaw_deg: Column) -> tuple[Column, Column]:
    """Velocity components in m/s."""
    v, yaw = speed_kmh / KMH_PER_MS, F.radians(yaw_deg)
    return v * F.cos(yaw), v * F.sin(yaw)


def ttc_range_rate(
    x, y, speed, yaw, ox, oy, ovx, ovy, touch: float = 1e-6, min_closing: float = MIN_CLOSING_SPEED
) -> Column:
    """Distance over closing speed towards a moving object; 0 when touching."""
    vx, vy = velocity(speed, yaw)
    rx, ry = ox - x, oy - y
    gap = F.hypot(rx, ry)
    closing = ratio(-(rx * (ovx - vx) + ry * (ovy - vy)), gap)
    return F.when(gap < touch, F.lit(0.0)).when(closing > min_closing, gap / closing)


def ttc_static(x, y, speed, yaw, ox, oy, min_closing: float = MIN_CLOSING_SPEED) -> Column:
    """Range-rate time to collision with a standing object."""
    zero = F.lit(0.0)
    return ttc_range_rate(x, y, speed, yaw, ox, oy, zero, zero, min_closing=min_closing)


def ttc_quadratic(x, y, speed, yaw, ox, oy, ovx, ovy, min_dist: float = MIN_GAP_M, eps: float = 1e-8) -> Column:
    """First time at which the distance shrinks to ``min_dist``; 0 when inside already."""
    vx, vy = velocity(speed, yaw)
    rx, ry = ox - x, oy - y
    wx, wy = ovx - vx, ovy - vy
    a = wx * wx + wy * wy
    b = 2 * (rx * wx + ry * wy)
    c = rx * rx + ry * ry - min_dist * min_dist
    disc = b * b - 4 * a * c
    root = F.sqrt(F.when(disc >= 0, disc))
    ahead = [F.when(t > eps, t) for t in (ratio(-b - root, 2 * a), ratio(-b + root, 2 * a))]
    return F.when(c <= 0, F.lit(0.0)).when((a >= eps) & (disc >= 0), F.least(*ahead))


def ttc_generic(
    distance: Column,
    speed: Column,
    object_speed: Column | None = None,
    movement: Column | None = None,
    min_closing: float = MIN_CLOSING_SPEED,
) -> Column:
    """Distance over relative speed; ``movement`` says how the object moves (default: it stands)."""
    own = speed / KMH_PER_MS
    relative = own
    if movement is not None:
        other = F.coalesce(object_speed / KMH_PER_MS, F.lit(0.0))
        relative = (
            F.when(movement.isin("static", "crossing"), own)
            .when(movement == "same_direction", F.greatest(own - other, F.lit(0.0)))
            .when(movement == "opposite_direction", own + other)
        )
    return F.when((distance > 0) & (relative > min_closing), distance / relative)
