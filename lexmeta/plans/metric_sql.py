"""DuckDB text for the n-gram metrics and the correlations, for the counterparts of the metric queries."""

from __future__ import annotations

from lexmeta.functions.metrics import BLEU_ORDERS, CHRF_CONFIGS, ROUGE_ORDERS

SQL_KEYS = tuple([f"bleu_{n}" for n in BLEU_ORDERS] + [f"chrf_{c}_{w}" for c, w in CHRF_CONFIGS] + [f"rouge_{n}" for n in ROUGE_ORDERS])
_SPLIT = r"CASE WHEN regexp_replace(coalesce({c}, ''), '[\s\p{{Z}}]', '', 'g') = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(regexp_replace({c}, '[\s\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g'), ' ') END"


def scores(rows: str, key: str, p: str = "") -> str:
    """CTEs that end in ``{p}wide``: one row per key with all SQL_KEYS. ``rows`` has (key, reference_vi, prediction_vi)."""
    t = f"{p}t AS (SELECT {key}, {_SPLIT.format(c='reference_vi')} AS r, {_SPLIT.format(c='prediction_vi')} AS q, coalesce(reference_vi, '') AS ref FROM ({rows}))"
    c = f"{p}c AS (SELECT *, array_to_string(r, '') AS rc, array_to_string(q, '') AS qc FROM {p}t)"
    pieces = []
    for side, w, ch in (("r", "r", "rc"), ("q", "q", "qc")):
        for n in (1, 2, 3, 4):
            pieces.append(f"SELECT {key}, '{side}' AS side, 'w{n}' AS kind, unnest(list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))) AS gram FROM {p}c")
        for n in range(1, 7):
            pieces.append(f"SELECT {key}, '{side}' AS side, 'c{n}' AS kind, unnest(list_transform(range(1, length({ch}) - {n} + 2), lambda i: substring({ch}, i, {n}))) AS gram FROM {p}c")
    g = f"{p}g AS (SELECT {key}, kind, gram, COUNT(*) FILTER (side = 'r') AS a, COUNT(*) FILTER (side = 'q') AS b FROM ({' UNION ALL '.join(pieces)}) GROUP BY ALL)"
    kinds = [f"w{n}" for n in (1, 2, 3, 4)] + [f"c{n}" for n in range(1, 7)]
    h = f"{p}h AS (SELECT {key}, {', '.join(f'''coalesce(SUM(least(a, b)) FILTER (kind = '{k}'), 0) AS m_{k}''' for k in kinds)} FROM {p}g GROUP BY {key})"
    size = {f"w{n}": (f"greatest(0, len(r) - {n - 1})", f"greatest(0, len(q) - {n - 1})") for n in (1, 2, 3, 4)}
    size |= {f"c{n}": (f"greatest(0, length(rc) - {n - 1})", f"greatest(0, length(qc) - {n - 1})") for n in range(1, 7)}
    m = {k: f"coalesce(m_{k}, 0)" for k in kinds}
    out = []
    for n in BLEU_ORDERS:
        logs = " + ".join(f"ln(({m[f'w{k}']} + 1) / ({size[f'w{k}'][1]} + 1.0))" for k in range(1, n + 1))
        out.append(f"CASE WHEN len(q) = 0 OR ref = '' THEN 0.0 ELSE exp(({logs}) / {n}.0) * CASE WHEN len(q) > len(r) THEN 1.0 ELSE exp(1 - len(r) / len(q)::DOUBLE) END END AS bleu_{n}")
    for cc, ww in CHRF_CONFIGS:
        ks = [f"c{n}" for n in range(1, cc + 1)] + [f"w{n}" for n in range(1, ww + 1)]
        there = {k: f"({size[k][0]} > 0 AND {size[k][1]} > 0)" for k in ks}
        count = " + ".join(f"{there[k]}::INT" for k in ks)
        pr = " + ".join(f"CASE WHEN {there[k]} THEN {m[k]} / ({size[k][1]})::DOUBLE ELSE 0 END" for k in ks)
        rc = " + ".join(f"CASE WHEN {there[k]} THEN {m[k]} / ({size[k][0]})::DOUBLE ELSE 0 END" for k in ks)
        p_, r_ = f"(({pr}) / ({count}))", f"(({rc}) / ({count}))"
        out.append(f"CASE WHEN ({count}) = 0 OR ({pr}) + ({rc}) = 0 THEN 0.0 ELSE 5 * {p_} * {r_} / (4 * {p_} + {r_}) END AS chrf_{cc}_{ww}")
    for n in ROUGE_ORDERS:
        a, b = size[f"w{n}"]
        out.append(f"CASE WHEN {m[f'w{n}']} = 0 THEN 0.0 ELSE 2 * {m[f'w{n}']} / (({a}) + ({b}))::DOUBLE END AS rouge_{n}")
    wide = f"{p}wide AS (SELECT {key}, {', '.join(out)} FROM {p}c LEFT JOIN {p}h USING ({key}))"
    return ",\n".join([t, c, g, h, wide])


def long(p: str, key: str) -> str:
    """A CTE ``{p}long`` (key, metric, score), scores rounded so that ties are the same in both engines."""
    return f"{p}long AS (SELECT {key}, metric, ROUND(score, 9) AS score FROM (UNPIVOT {p}wide ON {', '.join(SQL_KEYS)} INTO NAME metric VALUE score))"


def pearson(x: str, y: str) -> str:
    return f"CASE WHEN COUNT(*) < 2 OR MIN({x}) = MAX({x}) OR MIN({y}) = MAX({y}) THEN 'nan'::DOUBLE ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def correlations(source: str, keys: list[str], x: str, y: str, p: str = "") -> str:
    """CTEs that end in ``{p}corr`` (keys, n, pearson, spearman, kendall), not rounded."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}" if k else ""
    on = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in keys) or "true"
    group = f"GROUP BY {k}" if k else ""
    ka = ", ".join(f"a.{c}" for c in keys)
    lead = f"{k}, " if k else ""
    return f"""{p}pairs AS (SELECT {lead}({x})::DOUBLE AS x, ({y})::DOUBLE AS y FROM {source} WHERE ({x}) IS NOT NULL AND ({y}) IS NOT NULL),
{p}ranks AS (SELECT *, RANK() OVER ({part} ORDER BY x) + (COUNT(*) OVER ({"PARTITION BY " + k + ", x" if k else "PARTITION BY x"}) - 1) / 2.0 AS rx,
  RANK() OVER ({part} ORDER BY y) + (COUNT(*) OVER ({"PARTITION BY " + k + ", y" if k else "PARTITION BY y"}) - 1) / 2.0 AS ry FROM {p}pairs),
{p}cells AS (SELECT {lead}x, y, COUNT(*) AS c FROM {p}pairs GROUP BY {lead}x, y),
{p}tau AS (SELECT {ka + ", " if ka else ""}SUM(a.c * b.c * sign((a.x - b.x) * (a.y - b.y))) / nullif(sqrt(SUM(a.c * b.c * (a.x <> b.x)::INT)::DOUBLE * SUM(a.c * b.c * (a.y <> b.y)::INT)), 0) AS kendall
  FROM {p}cells a JOIN {p}cells b ON {on} {"GROUP BY " + ka if ka else ""}),
{p}flat AS (SELECT {lead}COUNT(*) AS n, {pearson("x", "y")} AS pearson, {pearson("rx", "ry")} AS spearman FROM {p}ranks {group}),
{p}corr AS (SELECT f.*, coalesce(t.kendall, 'nan'::DOUBLE) AS kendall FROM {p}flat f LEFT JOIN {p}tau t ON {" AND ".join(f"f.{c} IS NOT DISTINCT FROM t.{c}" for c in keys) or "true"})"""
