"""Black-Scholes in SQL that both engines take."""

from __future__ import annotations

RATE = "0.045"
# Coefficients of a rational approximation of the normal distribution (West, 2005; fixed values), highest power first.
NUMERATOR = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def number(x: float) -> str:
    return f"cast('{x!r}' as double)"


def _horner(coefficients: tuple[float, ...], a: str) -> str:
    text = number(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {a} + {number(c)})"
    return text


def norm_pdf(x: str) -> str:
    return f"exp(-({x}) * ({x}) / 2) / sqrt(2 * pi())"


def upper_tail(x: str) -> str:
    """The normal distribution's share beyond the absolute value of ``x``."""
    a = f"abs({x})"
    e = f"exp(-({x}) * ({x}) / 2)"
    tail = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        tail = f"({a} + {k} / {tail})"
    return f"case when {a} > 37 then 0 when {a} < {number(7.07106781186547)} then {e} * {_horner(NUMERATOR, a)} / {_horner(DENOMINATOR, a)} else {e} / ({tail} * {number(2.506628274631)}) end"


def norm_cdf(x: str, upper: str | None = None) -> str:
    """``upper``: a column with the upper tail of ``x``, so that it is worked out once."""
    upper = upper or upper_tail(x)
    return f"(case when ({x}) > 0 then 1 - ({upper}) else {upper} end)"


LIVE = "t > 0 and sigma > 0 and spot > 0"
D1 = f"case when {LIVE} then (ln(spot / strike) + ({RATE} + sigma * sigma / 2) * t) / (sigma * sqrt(t)) end"
GAMMA = "case when d1 is null then 0 else p1 / (spot * sigma * sqrt(t)) end"


def gammas(source: str) -> str:
    """gamma alone."""
    return f"(select *, {GAMMA} as gamma from (select *, {norm_pdf('d1')} as p1 from (select *, {D1} as d1 from {source}) as a) as b)"


def greeks(source: str, keep: str = "*") -> str:
    """delta, gamma and theta (a day) of contracts with side, spot, strike, t (years) and sigma."""
    d = f"(select *, {D1} as d1 from {source})"
    d = f"(select *, d1 - sigma * sqrt(t) as d2 from {d} as a)"
    d = f"(select *, {upper_tail('d1')} as u1, {upper_tail('d2')} as u2 from {d} as u)"
    d = f"(select *, {norm_cdf('d1', 'u1')} as n1, {norm_cdf('d2', 'u2')} as n2, {norm_pdf('d1')} as p1 from {d} as b)"
    carry = f"{RATE} * strike * exp(-{RATE} * t)"
    return f"""(select {keep}, case when d1 is null then case when spot > strike then 1 else 0 end when side = 'call' then n1 else n1 - 1 end as delta,
      {GAMMA} as gamma,
      case when d1 is null then 0 when side = 'call' then (-(spot * p1 * sigma) / (2 * sqrt(t)) - {carry} * n2) / 365 else (-(spot * p1 * sigma) / (2 * sqrt(t)) + {carry} * (1 - n2)) / 365 end as theta from {d} as c)"""
