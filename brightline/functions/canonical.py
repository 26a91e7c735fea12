"""Canonical JSON: one text for values that are the same, whatever their order of keys, spacing, escapes or spelling of numbers."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: float, shortest: Callable[[float], str] = repr, least: int = -6) -> str:
    """A finite double as ECMAScript writes it: the shortest digits that read back as x, plain from 1e-6 (10 ** least) up to below 1e21."""
    if x == 0:
        return "0"
    sign = "-" if x < 0 else ""
    mantissa, _, exponent = shortest(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len((whole + part).lstrip("0")))
    digits = digits.rstrip("0")
    k = len(digits)
    if k <= point <= 21:
        return sign + digits + "0" * (point - k)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if least < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if k > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def digits_in_sql(x: float) -> str:
    """repr() of a positive double; but from 2 ** 84 on DuckDB passes over digits that lie halfway to the next smaller double, which reading rounds up to x."""
    step = Fraction(x) - Fraction(math.nextafter(x, 0.0)) if x >= 2.0**84 else None
    if step is None or 2 * (Fraction(x) - Fraction(repr(x))) != step:
        return repr(x)
    near = f"{x:.15e}"
    return near if float(near) == x and 2 * (Fraction(x) - Fraction(near)) != step else f"{x:.16e}"


def number_in_sql(x: float) -> str:
    """As DuckDB casts a double to text, without ".0" and zeros before exponents: like number(), but digits as digits_in_sql() gives them, and plain from 1e-4 only."""
    return number(x, digits_in_sql, -4)


def text_in_sql(value: str) -> str:
    """As text(), with capitals in \\uXXXX, as DuckDB's to_json has them."""
    return re.sub(r"(?<!\\)((?:\\\\)*\\u)([0-9a-f]{4})", lambda m: m[1] + m[2].upper(), text(value))


def text(value: str) -> str:
    """A string as ECMAScript quotes it: short escapes, control characters and lone surrogates as \\uXXXX, all else as it is."""
    quoted = json.dumps(value, ensure_ascii=False)
    return "".join(f"\\u{ord(c):04x}" if 0xD800 <= ord(c) < 0xE000 else c for c in quoted)


def written(value: object, number: Callable[[float], str] = number, text: Callable[[str], str] = text) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, str):
        return text(value)
    if isinstance(value, int | float):
        x = float(value)
        if not math.isfinite(x):
            raise ValueError("not finite")
        return number(x)
    if isinstance(value, list):
        return f"[{','.join(written(v, number, text) for v in value)}]"
    # Keys in order of UTF-16 code units, as big-endian bytes are.
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{text(k)}:{written(value[k], number, text)}" for k in keys) + "}"


def _refused(name: str) -> float:
    raise ValueError(name)


def canonical(value: str | None, in_sql: bool = False) -> str | None:
    """Canonical form of a JSON text; null if it is none, or holds a number that no finite double is. Of repeated keys the last counts.

    in_sql: numbers and escapes spelled as DuckDB spells them, not as ECMAScript does."""
    spelled = (number_in_sql, text_in_sql) if in_sql else (number, text)
    try:
        return None if value is None else written(json.loads(value, parse_int=float, parse_constant=_refused), *spelled)
    except (ValueError, RecursionError):
        return None


def canonical_json(c: Column, in_sql: bool = False) -> Column:
    return F.arrow_udf(lambda texts: pa.array([canonical(t, in_sql) for t in texts.to_pylist()], pa.string()), "string")(c)


def json_hash(c: Column, in_sql: bool = False) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical_json(c, in_sql), 256)
