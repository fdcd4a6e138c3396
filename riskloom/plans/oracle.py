"""Independent DuckDB SQL for the registered queries.

The SQL follows the reference's own steps (filter the subset, group,
left join back; one-hot then mean), not the fused single-pass plans of
the Spark side, so a match checks the fusion too. Helpers here build
the long, spec-driven SELECT lists; column types are tracked so the
final projection can round floating outputs the same way on both
sides (``riskloom.plans.catalog.finalize``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

# Stable rounding for comparison. Floating results of two engines can
# differ in the last bit (different addition order). Rounding to a
# decimal grid does not remove that: decimal data gives exact results
# such as x.xxxx5 that sit on a rounding boundary, where one bit decides.
# Instead values snap to the nearest multiple of a step that is pi times
# a power of ten, chosen by magnitude band (about 7 significant digits):
# no terminating decimal lies on a half-step, and the band thresholds
# and steps are literals, so both engines do the same IEEE operations.
# Band edges are pi times a power of ten too, so no decimal value sits
# on a band edge.
E_MIN, E_MAX = -5, 12
DIGITS = 7   # step = pi * 10**(band - DIGITS): about 7 significant digits


def q(name: str) -> str:
    """Double-quoted SQL identifier."""
    return '"' + name.replace('"', '""') + '"'


def rnd(expr: str) -> str:
    """Band e = floor(log10(|x| / pi)) clamped to [E_MIN, E_MAX]; step
    pi * 10**(e - DIGITS), computed as pi times or divided by an integer
    power of ten (exact in both engines)."""
    band = f"least({E_MAX}, greatest({E_MIN}, CAST(floor(log10(abs({expr}) / {math.pi!r})) AS INTEGER)))"
    step = (f"(CASE WHEN {band} >= {DIGITS} THEN {math.pi!r} * pow(10.0, {band} - {DIGITS}) "
            f"ELSE {math.pi!r} / pow(10.0, {DIGITS} - {band}) END)")
    return (f"CASE WHEN {expr} = 0 OR isinf({expr}) OR isnan({expr}) THEN {expr} "
            f"ELSE round_even({expr} / {step}, 0) * {step} END")


def final_select(inner: str, cols: Sequence[tuple[str, str]]) -> str:
    """SELECT every column of ``inner``, doubles rounded."""
    items = [f"{rnd(q(n))} AS {q(n)}" if t == "double" else q(n) for n, t in cols]
    return f"SELECT {', '.join(items)} FROM ({inner}) AS final_q"


def agg_sql(col: str, fn: str, typ: str) -> tuple[str, str]:
    c = q(col)
    if fn == "min":
        return f"MIN({c})", typ
    if fn == "max":
        return f"MAX({c})", typ
    if fn == "mean":
        return f"AVG({c})", "double"
    if fn == "var":
        return f"VAR_SAMP({c})", "double"
    if fn == "sum":
        return (f"CAST(COALESCE(SUM({c}), 0) AS BIGINT)", "bigint") if typ in ("bigint", "int") \
            else (f"COALESCE(SUM({c}), 0)", "double")
    if fn == "size":
        return "COUNT(*)", "bigint"
    if fn == "nunique":
        return f"COUNT(DISTINCT {c})", "bigint"
    raise ValueError(fn)


def spec_sql(spec: Mapping[str, Sequence[str]], types: Mapping[str, str],
             prefix: str = "") -> list[tuple[str, str, str]]:
    """[(sql, name, type)] for a spec dict."""
    out = []
    for col, fns in spec.items():
        for fn in fns:
            s, t = agg_sql(col, fn, types[col])
            out.append((s, f"{prefix}{col}_{fn.upper()}", t))
    return out


def share_sql(col: str, values: Sequence[str], prefix: str = "", nan: bool = True,
              suffix: str = "_MEAN") -> list[tuple[str, str, str]]:
    c = q(col)
    out = [(f"AVG(CASE WHEN {c} IS NOT DISTINCT FROM '{v}' THEN 1 ELSE 0 END)",
            f"{prefix}{col}_{v}{suffix}", "double") for v in values]
    if nan:
        out.append((f"AVG(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)", f"{prefix}{col}_nan{suffix}",
                    "double"))
    return out


def select_list(items) -> str:
    return ", ".join(f"{s} AS {q(n)}" for s, n, _ in items)


def group_sql(src: str, key: str, items, where: str | None = None) -> str:
    w = f"{q(key)} IS NOT NULL" + (f" AND ({where})" if where else "")
    return f"SELECT {q(key)}, {select_list(items)} FROM {src} WHERE {w} GROUP BY {q(key)}"


def sanitize(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]+", "", name)


def ieee_div_sql(a: str, b: str) -> str:
    return (f"CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN CAST('inf' AS DOUBLE) "
            f"WHEN {a} < 0 THEN CAST('-inf' AS DOUBLE) END ELSE CAST({a} AS DOUBLE) / {b} END")


def clamp_sql(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} ELSE 0 END"


def flag_sql(col: str, value: str | None) -> str:
    c = q(col)
    cond = f"{c} IS NULL" if value is None else f"{c} IS NOT DISTINCT FROM '{value}'"
    return f"CAST({cond} AS INTEGER)"
