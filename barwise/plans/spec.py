"""Output specs: one declaration gives the Spark projection and the SQL projection.

A spec is ``"name:kind, name:kind, ..."``; kinds:

* ``d``  double rounded to 6 places, ``d2`` rounded to 2 places, ``d0`` unrounded double
* ``i``  int, ``l`` bigint, ``s`` string, ``t`` timestamp without zone, ``b`` boolean

Rounding makes the value hash of the two engines comparable (sums differ in the
last bits by summation order).  Both sides compute ``round(x * 10^p) / 10^p`` in
binary floating point.  ``-0.0`` is normalised to ``0.0`` on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(spec: str) -> list[tuple[str, str]]:
    out = []
    for part in spec.replace("\n", " ").split(","):
        part = part.strip()
        if not part:
            continue
        name, _, kind = part.partition(":")
        out.append((name.strip(), (kind or "d").strip()))
    return out


def _places(kind: str) -> int | None:
    if kind == "d":
        return 6
    if kind.startswith("d") and kind[1:].isdigit():
        p = int(kind[1:])
        return None if p == 0 else p
    return None


def spark_cols(spec: str):
    cols = []
    for name, kind in parse(spec):
        col = F.col(f"`{name}`")
        if kind.startswith("d"):
            col = col.cast("double")
            p = _places(kind)
            if p is not None:
                # same arithmetic as the oracle engine: round(x * 10^p) / 10^p on the binary
                # value (rounding the decimal text differs on exact binary halves)
                m = float(10 ** p)
                col = F.round(col * F.lit(m), 0) / F.lit(m)
            col = col + F.lit(0.0)
        elif kind == "i":
            col = col.cast("int")
        elif kind == "l":
            col = col.cast("bigint")
        elif kind == "s":
            col = col.cast("string")
        elif kind == "t":
            col = col.cast("timestamp_ntz")
        elif kind == "b":
            col = col.cast("boolean")
        cols.append(col.alias(name))
    return cols


def finalize(df: DataFrame, spec: str) -> DataFrame:
    """Project a Spark result to the spec (types, rounding, column order)."""
    return df.select(*spark_cols(spec))


def sql_cols(spec: str) -> str:
    out = []
    for name, kind in parse(spec):
        q = f'"{name}"'
        if kind.startswith("d"):
            e = f"cast({q} as double)"
            p = _places(kind)
            if p is not None:
                e = f"round({e}, {p})"
            e = f"({e} + 0.0)"
        elif kind == "i":
            e = f"cast({q} as integer)"
        elif kind == "l":
            e = f"cast({q} as bigint)"
        elif kind == "s":
            e = f"cast({q} as varchar)"
        elif kind == "t":
            e = f"cast({q} as timestamp)"
        elif kind == "b":
            e = f"cast({q} as boolean)"
        else:
            e = q
        out.append(f"{e} as {q}")
    return ", ".join(out)


def wrap_sql(sql: str, spec: str) -> str:
    """Project an oracle query to the spec."""
    return f"select {sql_cols(spec)} from (\n{sql}\n) as _q"
