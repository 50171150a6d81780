"""Independent SQL (DuckDB dialect) for the registered queries.

Each statement recomputes its result from the ``embeddings`` view with plain
cross joins, list lambdas and a recursive CTE for the perplexity bisection —
a brute-force formulation that shares no code with the Spark operators.
"""

from __future__ import annotations

import math

K = 90
PERPLEXITY = 30.0
MAPS = 3
REALMIN = "1e-12"


def _sum(lst: str) -> str:
    return f"list_reduce({lst}, lambda x, y: x + y)"


def H(ds: str, b: str) -> str:
    s = _sum(f"list_transform({ds}, lambda d: exp(-d * {b}))")
    sd = _sum(f"list_transform({ds}, lambda d: d * exp(-d * {b}))")
    return f"(CASE WHEN {s} = 0 THEN 0.0 ELSE ln({s}) + {b} * {sd} / {s} END)"


def rnd(x: str, digits: int, scale: float = 1.0) -> str:
    if scale != 1.0:
        x = f"({x}) * {scale!r}"
    return f"(round({x}, {digits}) + 0.0)"


LOGU = repr(math.log(PERPLEXITY))

CTE = {
    "vec": "vec AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS INTEGER) AS label FROM embeddings)",
    "nrows": "nrows AS (SELECT count(*) AS n FROM vec)",
    "pairs": ("pairs AS (SELECT a.id AS i, b.id AS j, "
              + _sum("list_transform(range(1, len(a.v) + 1), lambda k: (a.v[k] - b.v[k]) * (a.v[k] - b.v[k]))")
              + " AS d2 FROM vec a JOIN vec b ON a.id <> b.id)"),
    "knn": (f"knn AS (SELECT i, j, d2, CAST(row_number() OVER (PARTITION BY i ORDER BY d2, j) AS INTEGER) AS r "
            f"FROM pairs QUALIFY r <= {K})"),
    "nb": "nb AS (SELECT i, list(d2 ORDER BY d2, j) AS ds, list(j ORDER BY d2, j) AS js FROM knn GROUP BY i)",
    "cal": ("cal AS (SELECT i, ds, js, 0 AS tries, CAST(1.0 AS DOUBLE) AS beta, CAST('-inf' AS DOUBLE) AS lo, "
            f"CAST('inf' AS DOUBLE) AS hi, {H('ds', 'CAST(1.0 AS DOUBLE)')} AS h FROM nb "
            "UNION ALL "
            f"SELECT i, ds, js, tries + 1, nbeta, nlo, nhi, {H('ds', 'nbeta')} FROM ("
            f"SELECT i, ds, js, tries, "
            f"CASE WHEN h - {LOGU} > 0 THEN (CASE WHEN hi = CAST('inf' AS DOUBLE) THEN beta * 2.0 ELSE (beta + hi) / 2.0 END) "
            f"ELSE (CASE WHEN lo = CAST('-inf' AS DOUBLE) THEN beta / 2.0 ELSE (beta + lo) / 2.0 END) END AS nbeta, "
            f"CASE WHEN h - {LOGU} > 0 THEN beta ELSE lo END AS nlo, "
            f"CASE WHEN h - {LOGU} > 0 THEN hi ELSE beta END AS nhi "
            f"FROM cal WHERE abs(h - {LOGU}) > 1e-5 AND tries < 50))"),
    "betas": ("betas AS (SELECT i, max_by(beta, tries) AS beta, CAST(max(tries) AS INTEGER) AS tries, "
              f"max_by(h, tries) AS h, abs(max_by(h, tries) - {LOGU}) <= 1e-5 AS converged, "
              "any_value(ds) AS ds, any_value(js) AS js FROM cal GROUP BY i)"),
    "cond": ("cond AS (SELECT i, unnest(js) AS j, unnest(list_transform(ds, lambda d: CASE WHEN s = 0 THEN 0.0 ELSE exp(-d * beta) / s END)) AS p "
             f"FROM (SELECT i, js, ds, beta, {_sum('list_transform(ds, lambda d: exp(-d * beta))')} AS s FROM betas))"),
    "joint": ("joint AS (SELECT i, j, greatest(sum(p) / 2.0 / (SELECT n FROM nrows), 1e-12) AS p FROM "
              "(SELECT i, j, p FROM cond UNION ALL SELECT j AS i, i AS j, p FROM cond) GROUP BY i, j)"),
    "st1": "st1 AS (SELECT id, 0 AS map, 10.0 * v[1] AS y1, 10.0 * v[2] AS y2 FROM vec)",
    # all ordered pairs of the single map with the Student-t numerator
    "mp1": ("mp1 AS (SELECT a.id AS i, b.id AS j, a.y1 AS y1_i, a.y2 AS y2_i, b.y1 AS y1_j, b.y2 AS y2_j, "
            "1.0 / (1.0 + ((a.y1 - b.y1) * (a.y1 - b.y1) + (a.y2 - b.y2) * (a.y2 - b.y2))) AS num "
            "FROM st1 a JOIN st1 b ON a.id <> b.id)"),
    "z1": "z1 AS (SELECT sum(num) AS z FROM mp1)",
    "stm": (f"stm AS (SELECT id, CAST(m AS INTEGER) AS map, 10.0 * v[2 * m + 1] AS y1, 10.0 * v[2 * m + 2] AS y2, "
            f"v[2 * {MAPS} + m + 1] AS w FROM vec, range({MAPS}) t(m))"),
    "pim": "pim AS (SELECT id, map, y1, y2, w, exp(-1.0 * w) / sum(exp(-1.0 * w)) OVER (PARTITION BY id) AS pi FROM stm)",
    "mpm": ("mpm AS (SELECT a.id AS i, b.id AS j, a.map, a.y1 AS y1_i, a.y2 AS y2_i, b.y1 AS y1_j, b.y2 AS y2_j, "
            "a.pi AS pi_i, b.pi AS pi_j, "
            "1.0 / (1.0 + ((a.y1 - b.y1) * (a.y1 - b.y1) + (a.y2 - b.y2) * (a.y2 - b.y2))) AS num "
            "FROM pim a JOIN pim b ON a.id <> b.id AND a.map = b.map)"),
    "mpq": ("mpq AS (SELECT *, pi_i * pi_j * num AS qq, "
            f"{REALMIN} + sum(pi_i * pi_j * num) OVER (PARTITION BY i, j) AS qz FROM mpm)"),
    "zm": f"zm AS (SELECT sum(pi_i * pi_j * num) + (SELECT n FROM nrows) * (SELECT n FROM nrows) * {REALMIN} AS z FROM mpm)",
}

ORDER = list(CTE.keys())
DEPS = {
    "nrows": ["vec"], "pairs": ["vec"], "knn": ["pairs"], "nb": ["knn"], "cal": ["nb"], "betas": ["cal"],
    "cond": ["betas"], "joint": ["cond", "nrows"], "st1": ["vec"], "mp1": ["st1"], "z1": ["mp1"],
    "stm": ["vec"], "pim": ["stm"], "mpm": ["pim"], "mpq": ["mpm"], "zm": ["mpm", "nrows"],
}


def with_(*names: str, extra: list[str] | None = None, recursive: bool = False) -> str:
    need: set[str] = set()

    def add(x):
        if x in need:
            return
        need.add(x)
        for d in DEPS.get(x, []):
            add(d)
    for nm in names:
        add(nm)
    add("vec")
    parts = [CTE[x] for x in ORDER if x in need]
    rec = "RECURSIVE " if recursive or "cal" in need else ""
    return "WITH " + rec + ", ".join(parts + (extra or [])) + " "


def gaussian(seed: int, map_: str, k: int) -> str:
    """The hashed N(0, 1) start of point ``id``: Box-Muller on two md5 uniforms."""
    u = [f"((CAST('0x' || substr(md5('{seed}:{tag}:' || id || ':' || {map_} || ':{k}'), 1, 13) AS BIGINT) + 0.5) / {2.0 ** 52!r})"
         for tag in (1, 2)]
    return f"(sqrt(-2.0 * ln({u[0]})) * cos({2.0 * math.pi!r} * {u[1]}))"


def tree_walk(x: str, state: str, theta: float, levels: int = 48) -> list[str]:
    """CTEs of the Barnes-Hut walk over the points of ``state(id, y1, y2)``: ``{x}rep(id,
    sum_q, n1, n2)``.  Cells of every level by brute force, then a recursive descent."""
    index = lambda t: f"CAST(least(greatest(ceil({t} * pow(2.0, l)) - 1, 0), pow(2.0, l) - 1) AS BIGINT)"
    test = (f"SELECT id, y1, y2, t1, t2, l, c1, c2, cnt, leaf, own, y1 - k1 AS d1, y2 - k2 AS d2, "
            f"leaf OR (NOT own AND r2 < {theta!r} * ((y1 - k1) * (y1 - k1) + (y2 - k2) * (y2 - k2))) AS acc FROM ("
            f"SELECT p.id, p.y1, p.y2, p.t1, p.t2, c.l, c.c1, c.c2, c.leaf, c.r2, o.own, c.cnt - CAST(o.own AS INTEGER) AS cnt, "
            f"CASE WHEN o.own THEN CASE WHEN c.cnt > 1 THEN (c.s1 - p.y1) / (c.cnt - 1) ELSE p.y1 END ELSE c.s1 / c.cnt END AS k1, "
            f"CASE WHEN o.own THEN CASE WHEN c.cnt > 1 THEN (c.s2 - p.y2) / (c.cnt - 1) ELSE p.y2 END ELSE c.s2 / c.cnt END AS k2 ")
    own = f"{index('p.t1')} = c.c1 AND {index('p.t2')} = c.c2"
    return [
        f"{x}bb AS MATERIALIZED (SELECT min(y1) AS lo1, max(y1) - min(y1) AS w1, min(y2) AS lo2, max(y2) - min(y2) AS w2 FROM {state})",
        f"{x}pt AS MATERIALIZED (SELECT id, y1, y2, CASE WHEN w1 > 0 THEN (y1 - lo1) / w1 ELSE 0.0 END AS t1, "
        f"CASE WHEN w2 > 0 THEN (y2 - lo2) / w2 ELSE 0.0 END AS t2, w1, w2 FROM {state}, {x}bb)",
        f"{x}cell AS MATERIALIZED (SELECT l, {index('t1')} AS c1, {index('t2')} AS c2, count(*) AS cnt, sum(y1) AS s1, sum(y2) AS s2, "
        f"min(y1) = max(y1) AND min(y2) = max(y2) AS leaf, any_value(w1 / pow(2.0, l) * (w1 / pow(2.0, l)) + w2 / pow(2.0, l) * (w2 / pow(2.0, l))) AS r2 "
        f"FROM {x}pt, range({levels}) r(l) GROUP BY ALL)",
        f"{x}walk AS ({test} FROM {x}pt p JOIN {x}cell c ON c.l = 0, LATERAL (SELECT {own.replace('l)', 'c.l)')} AS own) o) "
        f"UNION ALL {test} FROM {x}walk f JOIN {x}cell c ON c.l = f.l + 1 AND c.c1 // 2 = f.c1 AND c.c2 // 2 = f.c2 "
        f"JOIN {x}pt p ON p.id = f.id, LATERAL (SELECT {own.replace('l)', 'c.l)')} AS own) o WHERE NOT f.acc))",
        f"{x}rep AS MATERIALIZED (SELECT id, coalesce(sum(cnt * q) FILTER (WHERE acc AND cnt > 0), 0.0) AS sum_q, "
        f"coalesce(sum(cnt * q * q * d1) FILTER (WHERE acc AND cnt > 0), 0.0) AS n1, "
        f"coalesce(sum(cnt * q * q * d2) FILTER (WHERE acc AND cnt > 0), 0.0) AS n2 "
        f"FROM (SELECT *, 1.0 / (1.0 + d1 * d1 + d2 * d2) AS q FROM {x}walk) GROUP BY id)",
    ]
