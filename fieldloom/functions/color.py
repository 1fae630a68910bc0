"""Colour conversions on columns in 0..1."""

from __future__ import annotations

from pyspark.sql import Column

# Luma weights of BT.709.
KR, KG, KB = 0.2126, 0.7152, 0.0722


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    y = KR * r + KG * g + KB * b
    return y, 0.5 * (b - y) / (1 - KB) + 0.5, 0.5 * (r - y) / (1 - KR) + 0.5


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    r = y + (2 - 2 * KR) * (cr - 0.5)
    b = y + (2 - 2 * KB) * (cb - 0.5)
    return r, (y - KR * r - KB * b) / KG, b
