"""SQL building blocks for the trend checks: brute-force pairs, which the engine itself never forms."""

YEAR = "31557600e0"


def pairs(name: str, src: str, keys: str, y: str, res: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ks = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{name} AS (SELECT {ks}, a.st, b.{y} - a.{y} AS dy, (b.t - a.t) * 86400e0 AS dt,
 sign(round_even(b.{y} / {res}, 0) - round_even(a.{y} / {res}, 0)) AS sg
 FROM {src} a JOIN {src} b ON {on} AND a.st = b.st AND a.t < b.t WHERE a.{y} IS NOT NULL AND b.{y} IS NOT NULL)"""


def stats(name: str, src: str, keys: str, y: str = "y", res: str = "1e-6") -> str:
    """CTEs {name}_p (pairs), {name}_v (variance per series), {name} (n, s, var, n_pairs, z per series)."""
    ks, p = keys, pairs(f"{name}_p", src, keys, y, res)
    return f"""{p},
{name}_vt AS (SELECT {ks}, st, sum(c * (c - 1) * (2 * c + 5)) v5, sum(c * (c - 1) * (c - 2)) v3, sum(c * (c - 1)) v2, sum(c) n
 FROM (SELECT {ks}, st, round_even({y} / {res}, 0) q, CAST(count(*) AS DOUBLE) c FROM {src} WHERE {y} IS NOT NULL GROUP BY ALL) GROUP BY ALL),
{name}_tt AS (SELECT {ks}, st, sum(c * (c - 1) * (2 * c + 5)) t5, sum(c * (c - 1) * (c - 2)) t3, sum(c * (c - 1)) t2
 FROM (SELECT {ks}, st, t, CAST(count(*) AS DOUBLE) c FROM {src} WHERE {y} IS NOT NULL GROUP BY ALL) GROUP BY ALL),
{name}_v AS (SELECT {ks}, st, n, CASE WHEN n < 2 THEN 0e0 ELSE (n * (n - 1) * (2 * n + 5) - v5 - t5) / 18e0 + v2 * t2 / (2e0 * n * (n - 1))
 + CASE WHEN n > 2 THEN v3 * t3 / (9e0 * n * (n - 1) * (n - 2)) ELSE 0e0 END END AS var, (n * (n - 1) - t2) / 2e0 AS np
 FROM {name}_vt JOIN {name}_tt USING ({ks}, st)),
{name}_s AS (SELECT {ks}, CAST(sum(sg) AS BIGINT) AS s FROM {name}_p GROUP BY ALL),
{name} AS (SELECT *, CASE WHEN s = 0 OR var <= 0 THEN 0e0 ELSE (s - sign(s)) / sqrt(var) END AS z FROM
 (SELECT {ks}, CAST(sum(n) AS BIGINT) n, sum(var) AS var, CAST(sum(np) AS BIGINT) n_pairs FROM {name}_v GROUP BY ALL) LEFT JOIN {name}_s USING ({ks}))"""


def bounds(z: float) -> tuple[str, str]:
    lo = f"CAST(greatest(round_even((n_pairs - {z!r} * sqrt(var)) / 2e0, 0) - 1, 0) AS BIGINT)"
    hi = f"CAST(least(round_even((n_pairs + {z!r} * sqrt(var)) / 2e0, 0), n_pairs - 1) AS BIGINT)"
    return lo, hi


def ranked(name: str, pair_cte: str, keys: str) -> str:
    return f"{name} AS (SELECT {keys}, dy / dt AS slope, row_number() OVER (PARTITION BY {keys} ORDER BY dy / dt) - 1 AS rn FROM {pair_cte})"
