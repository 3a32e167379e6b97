"""Attitude of platforms: quaternions and rotation matrices as column expressions. Angles are in degrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A matrix of three rows of three columns.
Matrix = Sequence[Sequence[Column]]


def quaternion_to_euler(q1: Column, q2: Column, q3: Column, q4: Column) -> tuple[Column, Column, Column]:
    """Roll, pitch and yaw; ``q4`` is the scalar part. The pitch is null if rounding takes its sine beyond 1."""
    sine = 2 * (q2 * q4 - q1 * q3)
    roll = F.atan2(2 * (q2 * q3 + q1 * q4), 1 - 2 * (q1 * q1 + q2 * q2))
    pitch = F.when(F.abs(sine) <= 1, F.asin(sine))
    yaw = F.atan2(2 * (q1 * q2 + q3 * q4), 1 - 2 * (q2 * q2 + q3 * q3))
    return F.degrees(roll), F.degrees(pitch), F.degrees(yaw)


def matrix_to_euler(r: Matrix) -> tuple[Column, Column, Column]:
    """Roll, pitch and yaw of a rotation matrix."""
    return F.degrees(F.atan2(r[1][2], r[2][2])), F.degrees(F.asin(-r[0][2])), F.degrees(F.atan2(r[0][1], r[0][0]))


def rotation_angle(r: Matrix) -> Column:
    """The turn around the matrix's axis."""
    return F.degrees(F.acos((r[0][0] + r[1][1] + r[2][2] - 1) / 2))


def rotation_axis(r: Matrix) -> tuple[Column, Column, Column]:
    """The vector that the matrix turns around, not scaled."""
    return r[1][2] - r[2][1], r[2][0] - r[0][2], r[0][1] - r[1][0]


def plane_rotation(angle: Column) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """The two by two matrix of a turn."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return (c, -s), (s, c)
