"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

_LONG = """SELECT id, system_id, score FROM (
    SELECT id, system_id, primary_score AS score FROM human_cross UNION ALL SELECT id, system_id, cross_score FROM human_cross)
  WHERE score BETWEEN 0 AND 100"""
_BAND = "1 + (score >= 50)::INT + (score >= 70)::INT + (score >= 85)::INT"
_PAIRS = [(g, h) for g in (1, 2, 3, 4) for h in (1, 2, 3, 4) if g < h]


def _ordinal(g: int, h: int) -> str:
    return f"POWER({' + '.join(f't{k}' for k in range(g, h + 1))} - (t{g} + t{h}) / 2.0, 2)"


ORACLES = {
    "p3_agreement": f"""WITH c AS (SELECT id, system_id, {", ".join(f"COUNT(*) FILTER ({_BAND} = {g}) AS c{g}" for g in (1, 2, 3, 4))}, COUNT(*) AS n
    FROM ({_LONG}) GROUP BY ALL HAVING COUNT(*) >= 2),
  t AS (SELECT {", ".join(f"SUM(c{g} * c{h} / (n - 1.0)) AS o{g}{h}" for g, h in _PAIRS)}, {", ".join(f"SUM(c{g}) AS t{g}" for g in (1, 2, 3, 4))},
    SUM(n) AS n_ratings, COUNT(*) AS n_items FROM c)
SELECT n_items::BIGINT AS n_items, n_ratings::BIGINT AS n_ratings, ROUND(1 - ({" + ".join(f"o{g}{h} * {_ordinal(g, h)}" for g, h in _PAIRS)})
    / (({" + ".join(f"t{g} * t{h} * {_ordinal(g, h)}" for g, h in _PAIRS)}) / (n_ratings - 1)), 6) AS alpha FROM t""",
}
