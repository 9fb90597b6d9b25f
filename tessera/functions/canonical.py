"""Canonical JSON (RFC 8785) and name-based identifiers (UUID version 5)."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of URLs.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def _number(x: float) -> str:
    """The shortest form, as ECMAScript writes it."""
    if math.isnan(x) or math.isinf(x):
        raise ValueError("no JSON number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, exponent = f"{x!r}".lower().partition("e")[::2]
    if not exponent:
        if abs(x) >= 1e-6:
            return digits
        digits, exponent = f"{x:e}".split("e")
        digits = repr(x).lower().partition("e")[0] if "e" in repr(x).lower() else digits.rstrip("0").rstrip(".")
    power = int(exponent)
    return digits if power == 0 else f"{digits.removesuffix('.0')}e{'+' if power > 0 else '-'}{abs(power)}" if power >= 21 or power < -6 else f"{x:.{max(0, len(digits.partition('.')[2]) - power)}f}"


def canonical(value) -> str:
    """Keys in the order of their UTF-16 units, no blanks, shortest numbers."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return _number(float(value)) if isinstance(value, float) or abs(value) >= 2**53 else str(value)


def canonical_json(text: Column) -> Column:
    """The canonical form of a JSON text; null for what is no JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else canonical(json.loads(x))
        except ValueError:
            return None

    @F.arrow_udf("string")
    def each(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            yield pa.array([one(x) for x in col.to_pylist()], pa.string())

    return each(text)


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The version 5 identifier of ``name``, from built-in functions."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
