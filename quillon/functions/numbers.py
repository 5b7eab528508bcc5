"""Column builders for numbers: rounding, interpolation, levels, colours, and a safe arithmetic grammar."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Rounds halves toward positive infinity, also below zero."""
    return F.floor(c + 0.5)


def lerp(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def decibels(rms: Column) -> Column:
    """20 log10; silence counts as 0.0001, that is -80 dB."""
    return 20 * F.log10(F.when(rms > 0, rms).otherwise(F.lit(1e-4)))


def hex_channel(colour: Column, k: int) -> Column:
    """Red, green or blue (k = 0, 1, 2) of #rrggbb."""
    return F.conv(F.substring(colour, 2 + 2 * k, 2), 16, 10).cast("int")


def contrast(colour: Column) -> Column:
    """Black or white text on #rrggbb, by luma."""
    luma = (hex_channel(colour, 0) * 299 + hex_channel(colour, 1) * 587 + hex_channel(colour, 2) * 114) / 1000
    return F.when(luma >= 128, "#000000").otherwise("#FFFFFF")


def fahrenheit(celsius: Column) -> Column:
    """One decimal, without a trailing .0."""
    return F.regexp_replace(F.format_string("%.1f", half_up((celsius * 9 / 5 + 32) * 10) / 10), r"\.0$", "")


_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|([-+*/%()]))")


def arithmetic(text: str, variables: dict[str, Column] | None = None) -> Column:
    """A column from numbers, variables, + - * / % and brackets; anything else is refused, nothing is evaluated as code."""
    found, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not allowed in an expression: {text[at:]!r}")
        found.append(m.groups())
        at = m.end()

    def peek() -> str | None:
        return found[0][2] if found else None

    def factor() -> Column:
        if not found:
            raise ValueError("the expression ends too soon")
        number, name, sign = found.pop(0)
        if number:
            return F.lit(float(number))
        if name:
            if name not in (variables or {}):
                raise ValueError(f"unknown variable: {name}")
            return variables[name]
        if sign in "+-":
            return -factor() if sign == "-" else factor()
        if sign != "(":
            raise ValueError(f"misplaced {sign}")
        inner = total()
        if peek() != ")":
            raise ValueError("a bracket isn't closed")
        found.pop(0)
        return inner

    def product() -> Column:
        left = factor()
        while peek() in ("*", "/", "%"):
            sign = found.pop(0)[2]
            right = factor()
            left = left * right if sign == "*" else F.try_divide(left, right) if sign == "/" else F.try_mod(left, right)
        return left

    def total() -> Column:
        left = product()
        while peek() in ("+", "-"):
            left = left + product() if found.pop(0)[2] == "+" else left - product()
        return left

    out = total()
    if found:
        raise ValueError("the expression goes on after its end")
    return out


def log_frequency(share: Column, low: float = 20.0, high: float = 20_000.0) -> Column:
    """Frequency at a share of a logarithmic scale."""
    return F.pow(F.lit(10.0), F.log10(F.lit(low)) + share * (F.log10(F.lit(high)) - F.log10(F.lit(low))))


def band_response(kind: Column, centre: Column, gain: Column, q: Column, frequency: Column) -> Column:
    """Gain of an equaliser's band (peaking, highpass, lowpass) at a frequency; other kinds have none."""
    ratio = frequency / centre
    steep = F.pow(ratio, 2 * F.greatest(q, F.lit(1)))
    peak = gain / (1 + F.pow(2 * F.log2(ratio) * q, F.lit(2)))
    return F.when(kind == "peaking", peak).when(kind == "highpass", gain * steep / (1 + steep)).when(kind == "lowpass", gain / (1 + steep)).otherwise(0.0)


def equaliser(bands: Column, frequency: Column) -> Column:
    """All bands (array of struct type, frequency, gain, q) together, within 30 dB of none."""
    total = F.aggregate(bands, F.lit(0.0), lambda s, b: s + band_response(b["type"], b["frequency"], b["gain"], b["q"], frequency))
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))


def loudness_scale(n: Column) -> Column:
    """Factor for each of n channels so that together they are as loud as one."""
    return F.try_divide(F.lit(1.0), F.sqrt(n))


def emu_pixels(emu: Column, dpi: int = 96, places: int = 2) -> Column:
    """English metric units as pixels; what isn't a number is 0."""
    x = F.coalesce(emu.try_cast("double"), F.lit(0.0)) / 914_400 * dpi
    return half_up(x * 10**places) / 10**places
