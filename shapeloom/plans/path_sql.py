"""SQL that mines paths: what detecting repeated shapes gives on graphs that are paths, from the definitions alone.

On a path an occurrence of order k is a run of k consecutive vertices, told by its first place. Its canonical key is the least
(cells, links) over the frames of both directions of its k - 1 edges, and it grows by the vertex before or after it.
"""

from __future__ import annotations

HALF_EVEN = "CASE WHEN {x} - floor({x}) < 0.5 THEN floor({x}) WHEN {x} - floor({x}) > 0.5 THEN floor({x}) + 1 WHEN floor({x}) % 2 = 0 THEN floor({x}) ELSE floor({x}) + 1 END"


def places() -> str:
    """From p(g, v, x, y): r(g, i, x, y) with places i from 0 along each path, and its sizes n(g, n)."""
    return "r AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS i, x, y FROM p), n AS MATERIALIZED (SELECT g, count(*) AS n FROM r GROUP BY 1)"


def forms(k: int, source: str, quant: float) -> str:
    """f{k}(g, a, frame, q, links): the canonical key of the run of k places from a on, for each (g, a) of source."""
    return f"""f{k} AS MATERIALIZED (
  WITH d AS (SELECT s.g, s.a, t.frame, o.x AS ox, o.y AS oy, u.x - o.x AS dx, u.y - o.y AS dy FROM {source} s, range({2 * (k - 1)}) AS t(frame), r o, r u
    WHERE o.g = s.g AND o.i = s.a + t.frame // 2 + t.frame % 2 AND u.g = s.g AND u.i = s.a + t.frame // 2 + 1 - t.frame % 2),
  c AS (SELECT d.g, d.a, d.frame, v.i - d.a AS j, ((v.x - ox) * dx + (v.y - oy) * dy) / (dx * dx + dy * dy) / {quant!r}::DOUBLE AS cx, ((v.y - oy) * dx - (v.x - ox) * dy) / (dx * dx + dy * dy) / {quant!r}::DOUBLE AS cy
    FROM d JOIN r v ON v.g = d.g AND v.i >= d.a AND v.i < d.a + {k} WHERE dx * dx + dy * dy > 0),
  b AS (SELECT g, a, frame, j, CAST({HALF_EVEN.format(x='cx')} AS BIGINT) AS qx, CAST({HALF_EVEN.format(x='cy')} AS BIGINT) AS qy, CASE WHEN j IN (0, {k - 1}) THEN 1 ELSE 2 END AS degree FROM c),
  s AS (SELECT *, row_number() OVER (PARTITION BY g, a, frame ORDER BY qx, qy, degree, j) - 1 AS pos FROM b),
  l AS (SELECT g, a, frame, list([qx, qy] ORDER BY pos) AS q, list(pos ORDER BY j) AS ps FROM s GROUP BY 1, 2, 3),
  e AS (SELECT g, a, frame, q, list_sort(list_transform(range(1, {k}), lambda j: [least(ps[j], ps[j + 1]), greatest(ps[j], ps[j + 1])])) AS links FROM l)
  SELECT g, a, frame, q, links FROM e QUALIFY row_number() OVER (PARTITION BY g, a ORDER BY q, links, frame) = 1)"""


def alive(k: int) -> str:
    """o{k}: the runs of f{k} whose key is there twice in the graph."""
    return f"o{k} AS MATERIALIZED (SELECT * FROM f{k} QUALIFY count(*) OVER (PARTITION BY g, q, links) >= 2)"


def grown(k: int) -> str:
    """g{k}(g, a): runs of k + 1 places that frequent polar cells of the groups of o{k} add."""
    return f"""g{k} AS MATERIALIZED (
  WITH d AS (SELECT s.g, s.a, s.q, s.links, c.i AS c, o.x AS ox, o.y AS oy, u.x - o.x AS dx, u.y - o.y AS dy, c.x AS x, c.y AS y FROM o{k} s, r o, r u, r c
    WHERE o.g = s.g AND o.i = s.a + s.frame // 2 + s.frame % 2 AND u.g = s.g AND u.i = s.a + s.frame // 2 + 1 - s.frame % 2 AND c.g = s.g AND c.i IN (s.a - 1, s.a + {k})),
  z AS (SELECT g, a, q, links, c, ((x - ox) * dx + (y - oy) * dy) / (dx * dx + dy * dy) AS zx, ((y - oy) * dx - (x - ox) * dy) / (dx * dx + dy * dy) AS zy FROM d),
  t AS (SELECT *, sqrt(zx * zx + zy * zy) AS rad, CASE WHEN atan2(zy, zx) < 0 THEN atan2(zy, zx) + 2 * pi() ELSE atan2(zy, zx) END AS ang FROM z),
  m AS (SELECT g, a, q, links, least(floor(ang / (2 * pi()) * 10), 9) AS ai, least(floor(rad / 3 * 12), 11) AS di, min(c) AS c FROM t WHERE rad >= 1e-12 AND rad <= 3 GROUP BY 1, 2, 3, 4, 5, 6),
  w AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY g, q, links, ai, di) >= 2)
  SELECT DISTINCT g, least(a, c) AS a FROM w)"""


def mined(max_order: int, quant: float) -> str:
    """All of it from p: found(g, ord, a, q, links), a row for each occurrence of the orders 2 to max_order."""
    parts = [places(), "g1 AS (SELECT g, unnest(range(n - 1)) AS a FROM n)"]
    for k in range(2, max_order + 1):
        parts += [forms(k, f"g{k - 1}", quant), alive(k)]
        if k < max_order:
            parts.append(grown(k))
    found = " UNION ALL ".join(f"SELECT g, {k} AS ord, a, q, links FROM o{k}" for k in range(2, max_order + 1))
    return ",\n".join([*parts, f"found AS ({found})"])


#: The text of a key, as key_text gives it.
KEY_TEXT = "array_to_string(list_transform(q, lambda z: array_to_string(z, ' ')), ';') || '|' || array_to_string(list_transform(links, lambda z: array_to_string(z, ' ')), ';')"
