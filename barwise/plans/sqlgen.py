"""Small text helpers for writing the DuckDB oracle queries.

They spell the same null rules as :mod:`barwise.functions.core` in SQL: full frames,
``nullif`` divisions, 0/1 flags, null-propagating greatest.  Recursive smoothers are
written as recursive CTEs (one row step per iteration), independent of the blocked
scan used on the Spark side.
"""

from __future__ import annotations

P = "partition by symbol order by ts"


def q(x: str) -> str:
    return f'"{x}"'


def fr(n: int, ahead: int = 0) -> str:
    return f"({P} rows between {n - 1} preceding and {'current row' if ahead == 0 else f'{ahead} following'})"


def full(agg: str, x: str, n: int) -> str:
    return f"(case when count({x}) over {fr(n)} = {n} then {agg}({x}) over {fr(n)} end)"


def sma(x: str, n: int) -> str:
    return full("avg", x, n)


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) over ({P})"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) over ({P})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def flag(cond: str) -> str:
    return f"cast(coalesce({cond}, false) as integer)"


def gmax(*xs: str) -> str:
    nulls = " or ".join(f"({x}) is null" for x in xs)
    return f"(case when {nulls} then null else greatest({', '.join(xs)}) end)"


def gmin(*xs: str) -> str:
    nulls = " or ".join(f"({x}) is null" for x in xs)
    return f"(case when {nulls} then null else least({', '.join(xs)}) end)"


def lit(x: float) -> str:
    return f"cast('{x!r}' as double)"


def tr() -> str:
    pc = lag('"close"')
    return gmax("high - low", f"abs(high - {pc})", f"abs(low - {pc})")


def scan(name: str, base: str, x: str, qv: float, a: float, seed: str, seed_value: str | None = None,
         seed_weight: float | str = 1.0, normalise: bool = False, min_j: int = 0) -> str:
    """CTEs computing ``name(symbol, rn, <name>)`` by recursion over ``base(symbol, rn, ...)``.

    ``seed`` is a boolean SQL expression over ``base`` (may use windows ordered by rn);
    the recursion starts on its first true row with ``seed_weight * seed_value``.
    """
    sv = seed_value or x
    sw = lit(seed_weight) if isinstance(seed_weight, float) else seed_weight
    y = "y"
    if normalise:
        y = f"y / (1 - pow({lit(qv)}, j + 1))"
    return f"""{name}_in as (
  select symbol, rn, {x} as x, {seed} as _seed, {sv} as _sv from {base}),
{name}_s as (select symbol, min(rn) filter (where _seed) as srn from {name}_in group by symbol),
{name}_r as (
  select i.symbol, i.rn, 0 as j, {sw} * i._sv as y
  from {name}_in i join {name}_s s on i.symbol = s.symbol and i.rn = s.srn
  union all
  select i.symbol, i.rn, r.j + 1, {lit(qv)} * r.y + {lit(a)} * i.x
  from {name}_r r join {name}_in i on i.symbol = r.symbol and i.rn = r.rn + 1),
{name} as (select symbol, rn, case when j >= {min_j} then {y} end as {q(name)} from {name}_r)"""


def wo(x: str) -> str:
    """window ordered by rn, for seeds"""
    return f"(partition by symbol order by rn rows between unbounded preceding and current row)"


def first_nonnull(x: str) -> str:
    return f"({x} is not null and count({x}) over {wo(x)} = 1)"


def nth_nonnull(x: str, n: int) -> str:
    return f"({x} is not null and count({x}) over {wo(x)} = {n})"


def ema(name: str, base: str, x: str, span: int | None = None, adjust: bool = False,
        alpha: float | None = None, warmup: bool = True) -> str:
    a = alpha if alpha is not None else 2.0 / (span + 1)
    qv = 1.0 - a
    if adjust:
        return scan(name, base, x, qv, a, first_nonnull(x), seed_weight=a, normalise=True)
    return scan(name, base, x, qv, a, first_nonnull(x), min_j=(span - 1) if (warmup and span) else 0)


def wilder(name: str, base: str, x: str, n: int) -> str:
    sv = f"avg({x}) over (partition by symbol order by rn rows between {n - 1} preceding and current row)"
    return scan(name, base, x, (n - 1) / n, 1.0 / n, nth_nonnull(x, n), seed_value=sv)
