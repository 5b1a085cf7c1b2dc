"""Pieces of SQL that the oracle queries share: the image views and steps over them, in formulations of their own."""

from __future__ import annotations

import math

PIX = "stack_id, y, x, c"
IMG = "stack_id, frame_id, c"

LINE = """px AS MATERIALIZED (
  SELECT 0 AS stack_id, l_linenumber - 1 AS frame_id, (l_orderkey % 32)::INT AS y, (l_partkey % 32)::INT AS x,
         CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c,
         sum(round(l_extendedprice * 100)::BIGINT) / (count(*) * 1e2) / 104729 AS v
  FROM lineitem GROUP BY ALL)"""
EMB = """px AS MATERIALIZED (
  SELECT label AS stack_id, vec_id AS frame_id, ((p - 1) // 8)::INT AS y, ((p - 1) % 8)::INT AS x, 0 AS c, e::DOUBLE AS v
  FROM (SELECT label, vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings))"""
FRAMES = """frames AS MATERIALIZED (
  SELECT user_id AS frame_id, median(value) AS fwhm, count(value) AS n_stars,
         count(*) FILTER (WHERE event_type = 'error') / count(*) AS eccentricity,
         1 - count(*) FILTER (WHERE event_type = 'error') / count(*) AS roundness
  FROM events GROUP BY 1)"""
SYNTH = """px AS MATERIALIZED (
  WITH grid AS (SELECT i, (i // 64)::INT AS y, (i % 64)::INT AS x FROM range(4096) t(i)),
  sky AS (SELECT 0 AS f),
  stars AS (SELECT f, (f * 5 + k * 23 + 7) % 64 AS sx, (f * 3 + k * 41 + 11) % 64 AS sy, (k % 5 + 1) / 10 AS a FROM sky, range(16) t(k)),
  light AS (SELECT f, i, sum(CASE WHEN (x-sx)*(x-sx) + (y-sy)*(y-sy) <= 25 THEN a / (1e0 + (x-sx)*(x-sx) + (y-sy)*(y-sy)) ELSE 0 END) AS s
            FROM grid, stars GROUP BY f, i)
  SELECT 0 AS stack_id, f AS frame_id, y, x, c::INT AS c,
         ((i * 7919 + 104729 + f * 613) % 1009 / 1009 * 2e-2 + (2 * x + y) / 192 * 1e-1 + s) * (10 - 2 * c) / 10 AS v
  FROM grid JOIN light USING (i), range(3) r(c))"""
SYNTH_FRAMES = SYNTH.replace("SELECT 0 AS f", "SELECT s_suppkey::INT AS f FROM supplier")
SKY = """px AS MATERIALIZED (
  WITH grid AS (SELECT i, (i // 64)::INT AS y, (i % 64)::INT AS x FROM range(4096) t(i)),
  lines AS (SELECT (l_orderkey % 64)::INT AS y, (l_partkey % 64)::INT AS x, sum(round(l_extendedprice * 100)::BIGINT) / (count(*) * 1e2) / 104729 AS noise FROM lineitem GROUP BY ALL),
  stars AS (SELECT (n_nationkey * 23 + 7) % 64 AS sx, (n_nationkey * 41 + 11) % 64 AS sy, (n_regionkey + 1) / 10 AS a FROM nation),
  light AS (SELECT i, sum(CASE WHEN (x-sx)*(x-sx) + (y-sy)*(y-sy) <= 25 THEN a / (1e0 + (x-sx)*(x-sx) + (y-sy)*(y-sy)) ELSE 0 END) AS s
            FROM grid, stars GROUP BY i)
  SELECT 0 AS stack_id, 0 AS frame_id, grid.y, grid.x, c::INT AS c,
         ((i * 7919 + 104729) % 1009 / 1009 * 2e-2 + coalesce(noise, 0) * 2e-2 + (2 * grid.x + grid.y) / 192 * 1e-1 + s) * (10 - 2 * c) / 10 AS v
  FROM grid JOIN light USING (i) LEFT JOIN lines ON lines.y = grid.y AND lines.x = grid.x, range(3) r(c))"""
_RED = ", mono AS MATERIALIZED (SELECT stack_id, frame_id, y, x, 0 AS c, v FROM px WHERE c = 0)"
MONO, MONO_FRAMES = SKY + _RED, SYNTH_FRAMES + _RED
PANELS = """panels AS MATERIALIZED (
  SELECT n_nationkey AS panel_id, 24 AS width, 24 AS height, 12e0 AS px0, 12e0 AS px1, 150 - (n_nationkey % 5) * 2e-2 AS r0, 20 + (n_nationkey // 5) * 2e-2 AS d0,
         -1e-3 AS a, (n_nationkey % 3 - 1) * 2e-5 AS b, (n_nationkey % 3 - 1) * 2e-5 AS e, 1e-3 AS f FROM nation),
px AS MATERIALIZED (
  SELECT panel_id, y, x, 0 AS c, coalesce(v, 0) AS v FROM (SELECT panel_id, y::INT AS y, x::INT AS x FROM panels, range(24) q(y), range(24) u(x))
  LEFT JOIN (SELECT s_nationkey AS panel_id, (l_orderkey % 24)::INT AS y, (l_partkey % 24)::INT AS x, sum(round(l_extendedprice * 100)::BIGINT) / (count(*) * 1e2) / 104729 AS v
             FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL) USING (panel_id, y, x))"""
REJECT = f"""pr AS MATERIALIZED (
  SELECT p.stack_id, frame_id, p.y, p.x, p.c,
         CASE WHEN nf < 3 OR v <= med + 10 * greatest(1.4826 * dev, 1e-10) THEN v END AS v
  FROM px p JOIN (SELECT {PIX}, median(v) AS med, mad(v) AS dev FROM px GROUP BY ALL) USING ({PIX})
  JOIN (SELECT stack_id, count(DISTINCT frame_id) AS nf FROM px GROUP BY 1) USING (stack_id))"""


def spline_table(n: int, to: int) -> str:
    """Rows (o, i, w) of a cubic spline through ``n`` places, mirrored at its ends, at ``to`` places from end to end.

    For each unit vector the coefficients are solved by elimination and the spline is read off its B-spline formula.
    """
    bump = lambda u: 2 / 3 - u * u + abs(u) ** 3 / 2 if abs(u) < 1 else (2 - abs(u)) ** 3 / 6 if abs(u) < 2 else 0.0
    rows = []
    for i in range(n):
        below, on, above = [1 / 6] * n, [4 / 6] * n, [1 / 6] * n
        above[0] = below[-1] = 2 / 6
        right = [float(j == i) for j in range(n)]
        for j in range(1, n):
            k = below[j] / on[j - 1]
            on[j] -= k * above[j - 1]
            right[j] -= k * right[j - 1]
        c = [0.0] * n
        for j in range(n - 1, -1, -1):
            c[j] = (right[j] - (above[j] * c[j + 1] if j + 1 < n else 0)) / on[j]
        for o in range(to):
            at = o * (n - 1) / (to - 1)
            near = range(math.floor(at) - 2, math.floor(at) + 4)
            rows.append((o, i, sum(bump(at - j) * c[abs(j) if abs(j) < n else 2 * (n - 1) - abs(j)] for j in near)))
    return "VALUES " + ", ".join(f"({o}, {i}, {w!r}::DOUBLE)" for o, i, w in rows)


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def rounds(source: str, step: str, keys: str, n: int, name: str = "r") -> list[str]:
    """``n`` steps over groups; ``step`` is an expression for the new value by v, med and dev (NULL drops it)."""
    out, last = [], source
    for i in range(n):
        out.append(f"""{name}{i} AS MATERIALIZED (
  SELECT * EXCLUDE (v, med, dev), {step} AS v FROM (SELECT * FROM {last} WHERE v IS NOT NULL)
  JOIN (SELECT {keys}, median(v) AS med, mad(v) AS dev FROM {last} GROUP BY {keys}) USING ({keys}))""")
        last = f"{name}{i}"
    return out


def blur(source: str, name: str, sigma: str, n: int, keys: str) -> str:
    """Separable Gaussian by gathering reflected neighbours."""
    radius = f"floor(4 * {sigma} + 0.5)::INT"
    return f"""{name}_k AS MATERIALIZED (
  SELECT d, exp(-0.5 * d * d / ({sigma} * {sigma})) / sum(exp(-0.5 * d * d / ({sigma} * {sigma}))) OVER () AS w
  FROM (SELECT unnest(range(-({radius}), {radius} + 1)) AS d)),
{name}_t AS MATERIALIZED (
  SELECT o, CASE WHEN m < {n} THEN m ELSE {2 * n - 1} - m END AS i, sum(w) AS w
  FROM (SELECT o, ((o + d) % {2 * n} + {2 * n}) % {2 * n} AS m, w FROM {name}_k, range({n}) r(o)) GROUP BY 1, 2),
{name}_y AS MATERIALIZED (SELECT {keys}, o::INT AS y, x, sum(w * v) / sum(w) AS v FROM {source} JOIN {name}_t ON y = i WHERE v IS NOT NULL GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {keys}, y, o::INT AS x, sum(w * v) / sum(w) AS v FROM {name}_y JOIN {name}_t ON x = i GROUP BY ALL)"""


def maxima(source: str, name: str, d: int, n: int) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, max(v) OVER (PARTITION BY stack_id, frame_id, x ORDER BY y RANGE BETWEEN {d} PRECEDING AND {d} FOLLOWING) AS my FROM {source})
  QUALIFY v = max(my) OVER (PARTITION BY stack_id, frame_id, y ORDER BY x RANGE BETWEEN {d} PRECEDING AND {d} FOLLOWING)
      AND y BETWEEN {d} AND {n - 1 - d} AND x BETWEEN {d} AND {n - 1 - d})"""


def sky(source: str, name: str, keys: str, k: str, value: str = "v") -> str:
    """Clipped sky of groups by lists: three rounds that stop when fewer than 5 values would stay."""
    step = lambda a: f"list_filter({a}, lambda e: e <= list_median({a}) + {k} * 1.4826 * list_median(list_transform({a}, lambda q: abs(q - list_median({a})))))"
    keep = lambda a, b: f"CASE WHEN stop OR len({b}) < 5 THEN {a} ELSE {b} END"
    out, last = f"{name}_0 AS MATERIALIZED (SELECT {keys}, list({value}) AS l, false AS stop FROM {source} GROUP BY {keys})", f"{name}_0"
    for i in (1, 2, 3):
        out += f""",
{name}_{i} AS MATERIALIZED (SELECT {keys}, {keep('l', 'n')} AS l, stop OR len(n) < 5 AS stop FROM (SELECT *, {step('l')} AS n FROM {last}))"""
        last = f"{name}_{i}"
    return out + f",\n{name} AS MATERIALIZED (SELECT {keys}, list_median(l) AS sky FROM {last})"


def background(source: str, name: str, n: int, grid: int, keys: str = IMG) -> str:
    """Cell skies, 3 x 3 medians, and splines by the weight table written out."""
    side = max(1, n // grid)
    cells = -(-n // side)
    return sky(f"(SELECT {keys}, (y // {side})::INT AS cy, (x // {side})::INT AS cx, v FROM {source} WHERE v > 0)", f"{name}_s", f"{keys}, cy, cx", "3") + f""",
{name}_g AS MATERIALIZED (
  SELECT {keys}, cy::INT AS cy, cx::INT AS cx, CASE WHEN s > 0 THEN s ELSE whole END AS v
  FROM (SELECT * FROM (SELECT {keys}, median(v) AS whole FROM {source} GROUP BY ALL), range({cells}) a(cy), range({cells}) b(cx))
  LEFT JOIN (
    SELECT {keys}, cy, cx, CASE WHEN np < 5 THEN coalesce(a, 0) ELSE sky END AS s FROM (
      SELECT {keys}, (y // {side})::INT AS cy, (x // {side})::INT AS cx, median(v) AS a, count(*) FILTER (WHERE v > 0) AS np FROM {source} GROUP BY ALL)
    LEFT JOIN {name}_s USING ({keys}, cy, cx)) USING ({keys}, cy, cx)),
{name}_m AS MATERIALIZED (
  SELECT {keys}, oy, ox, median(v) AS v FROM (
    SELECT oy, ox, least(greatest(oy + dy, 0), {cells - 1}) AS cy, least(greatest(ox + dx, 0), {cells - 1}) AS cx
    FROM range({cells}) a(oy), range({cells}) b(ox), range(-1, 2) c(dy), range(-1, 2) d(dx)) JOIN {name}_g USING (cy, cx) GROUP BY ALL),
{name}_w(o, i, w) AS ({spline_table(cells, n)}),
{name} AS MATERIALIZED (
  SELECT {keys}, wy.o::INT AS y, wx.o::INT AS x, sum(wy.w * wx.w * v) AS bg FROM {name}_m JOIN {name}_w wy ON oy = wy.i JOIN {name}_w wx ON ox = wx.i GROUP BY ALL)"""


def corners(source: str, name: str, n: int, share: float = 0.1) -> str:
    h = max(1, int(n * share))
    pick = [f"y {a} AND x {b}" for a in (f"< {h}", f">= {n - h}") for b in (f"< {h}", f">= {n - h}")]
    return f"{name} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {source} WHERE {p}" for p in pick) + ")"


STRETCH_PARAMS = """params AS MATERIALIZED (
  SELECT *, CASE WHEN n <= 0 OR n >= 1 OR abs(0.5 * n - 0.25 - n) < 1e-10 THEN 0.5
                 ELSE least(greatest(n * (0.25 - 1) / (0.5 * n - 0.25 - n), 0.001), 0.999) END AS midtone FROM (
    SELECT *, coalesce(least(greatest((med - shadow) / nullif(high - shadow, 0), 0.001), 0.999), NULL) AS n FROM (
      SELECT stack_id, median(v) AS med, greatest(median(v) - 2.8 * (1.4826 * mad(v)), min(v)) AS shadow, quantile_cont(v, 0.999) AS high
      FROM light GROUP BY 1)))"""
STRETCHED = """SELECT stack_id, y, x, c, CASE WHEN high > shadow AND v IS NOT NULL THEN floor(
    least(greatest((midtone - 1) * s / CASE WHEN abs((midtone * 2 - 1) * s - midtone) < 1e-10 THEN -1e-10 ELSE (midtone * 2 - 1) * s - midtone END, 0), 1) * 255)::INT ELSE 0 END AS v
FROM (SELECT *, least(greatest((v - shadow) / nullif(high - shadow, 0), 0), 1) AS s FROM img JOIN params USING (stack_id))"""
