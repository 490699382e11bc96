"""Tails of distributions as DuckDB SQL: the regularised incomplete beta function by its continued fraction."""

from __future__ import annotations

#: Half steps of the continued fraction.
STEPS = 400


def beta_sql(source: str, keep: str, name: str = "p") -> str:
    """A SELECT of the columns ``keep`` of ``source`` (a table or a query in brackets) and of I_x(a, b) for its columns a, b, x."""
    return f"""SELECT {keep}, CASE WHEN x <= 0 THEN 0 WHEN x >= 1 THEN 1 WHEN flip THEN 1 - front * h ELSE front * h END AS {name} FROM (
  SELECT *, exp(lgamma(aa + bb) - lgamma(aa) - lgamma(bb) + aa * ln(xx) + bb * ln(1 - xx)) / aa AS front,
    list_reduce(list_prepend({{'c': 1.0::DOUBLE, 'd': 1 / (1 - (aa + bb) * xx / (aa + 1)), 'h': 1 / (1 - (aa + bb) * xx / (aa + 1))}},
      list_transform(range(2, {STEPS}), lambda k: {{'c': 0.0::DOUBLE, 'h': 0.0::DOUBLE, 'd': (CASE WHEN k % 2 = 0 THEN (k // 2) * (bb - k // 2) * xx / ((aa + k - 1) * (aa + k)) ELSE -(aa + k // 2) * (aa + bb + k // 2) * xx / ((aa + k - 1) * (aa + k)) END)::DOUBLE}}
        )), lambda s, e: {{'c': 1 + e.d / s.c, 'd': 1 / (1 + e.d * s.d), 'h': s.h * (1 + e.d / s.c) / (1 + e.d * s.d)}}).h AS h
  FROM (SELECT *, CASE WHEN flip THEN b ELSE a END AS aa, CASE WHEN flip THEN a ELSE b END AS bb, CASE WHEN flip THEN 1 - x ELSE x END AS xx
    FROM (SELECT *, x > (a + 1) / (a + b + 2) AS flip FROM (SELECT * REPLACE (a::DOUBLE AS a, b::DOUBLE AS b, x::DOUBLE AS x) FROM {source}))) WHERE xx > 0 AND xx < 1)"""
