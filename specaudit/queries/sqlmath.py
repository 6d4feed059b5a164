"""SQL for the oracles: linear systems, proportional hazards, normal tails, all as chains of common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions import dealing


def _same(a: str, b: str, keys: Sequence[str]) -> str:
    return "".join(f" AND {a}.{k} = {b}.{k}" for k in keys)


def gauss_jordan(source: str, keys: Sequence[str], n: int, name: str) -> str:
    """CTEs that solve systems: ``source`` has keys, i from 1 to n, j and v; columns beyond n are right-hand sides.

    The last, ``name``, has keys, i, j and v of the solutions. For positive definite matrices, so nothing is pivoted.
    """
    steps, before, by = [], source, "".join(f"m.{k}, " for k in keys)
    for k in range(1, n + 1):
        after = name if k == n else f"{name}_{k}"
        steps.append(
            f"{after} AS MATERIALIZED (SELECT {by}m.i, m.j, CASE WHEN m.i = {k} THEN m.v / p.v ELSE m.v - c.v * r.v / p.v END AS v FROM {before} m JOIN {before} p ON p.i = {k} AND p.j = {k}{_same('p', 'm', keys)} JOIN {before} r ON r.i = {k} AND r.j = m.j{_same('r', 'm', keys)} JOIN {before} c ON c.j = {k} AND c.i = m.i{_same('c', 'm', keys)} WHERE m.j > {k})"
        )
        before = after
    return ",\n".join(steps)


def cox(rows: str, keys: Sequence[str], name: str, steps: int = 10) -> str:
    """CTEs of Newton steps on one covariate with Breslow ties: ``rows`` has keys, time, event and x; ``name`` keys, b and info."""
    k = ", ".join(keys)
    out = [f"{name}_0 AS (SELECT {k}, 0.0::DOUBLE AS b FROM {rows} GROUP BY ALL)"]
    for t in range(steps):
        after = name if t == steps - 1 else f"{name}_{t + 1}"
        out.append(f"{name}_at{t} AS (SELECT {k}, time, sum(event) AS d, sum(event * x) AS dx, sum(exp(b * x)) AS s0, sum(exp(b * x) * x) AS s1, sum(exp(b * x) * x * x) AS s2 FROM {rows} JOIN {name}_{t} USING ({k}) GROUP BY ALL)")
        out.append(f"{name}_run{t} AS (SELECT {k}, d, dx, sum(s0) OVER w AS s0, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2 FROM {name}_at{t} WINDOW w AS (PARTITION BY {k} ORDER BY time DESC))")
        out.append(f"{after} AS MATERIALIZED (SELECT {k}, max(b) + sum(dx - d * s1 / s0) / sum(d * (s2 / s0 - pow(s1 / s0, 2))) AS b, sum(d * (s2 / s0 - pow(s1 / s0, 2))) AS info FROM {name}_run{t} JOIN {name}_{t} USING ({k}) WHERE d > 0 GROUP BY ALL)")
    return ",\n".join(out)


def upper_tail(z: str) -> str:
    """P(Z > z) of a standard normal, by Simpson's rule over 4,000 steps from 0."""
    return f"(0.5 - {z} / 12000.0 * list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * pow({z} * i / 4000.0, 2)))) / sqrt(2 * pi()))"


def logistic_pair(rows: str, name: str, steps: int = 14) -> str:
    """CTEs of Newton steps of logistic models on two features: ``rows`` has m (the model), y, x1, x2; ``name`` m, w0, w1 and w2.

    The two weights are penalised by half their squares, the intercept isn't.
    """
    out = [f"{name}_0 AS (SELECT m, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM {rows} GROUP BY ALL)"]
    for t in range(steps):
        after = name if t == steps - 1 else f"{name}_{t + 1}"
        out.append(
            f"""{name}_p{t} AS (SELECT m, y, x1, x2, w1, w2, 1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2))) AS p, w0 FROM {rows} JOIN {name}_{t} USING (m)),
{name}_g{t} AS (SELECT m, max(w0) AS w0, max(w1) AS w1, max(w2) AS w2, sum(p - y) AS g0, sum((p - y) * x1) + max(w1) AS g1, sum((p - y) * x2) + max(w2) AS g2, sum(p * (1 - p)) AS a, sum(p * (1 - p) * x1) AS b, sum(p * (1 - p) * x2) AS c,
  sum(p * (1 - p) * x1 * x1) + 1 AS d, sum(p * (1 - p) * x1 * x2) AS e, sum(p * (1 - p) * x2 * x2) + 1 AS f FROM {name}_p{t} GROUP BY m),
{name}_d{t} AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM {name}_g{t}),
{after} AS MATERIALIZED (SELECT m, w0 - ((d * f - e * e) * g0 + (c * e - b * f) * g1 + (b * e - c * d) * g2) / det AS w0, w1 - ((c * e - b * f) * g0 + (a * f - c * c) * g1 + (b * c - a * e) * g2) / det AS w1,
  w2 - ((b * e - c * d) * g0 + (b * c - a * e) * g1 + (a * d - b * b) * g2) / det AS w2 FROM {name}_d{t})"""
        )
    return ",\n".join(out)


def _mixed(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * {dealing.MIX}) % {dealing.WORD})"
    return f"xor({x}, {x} >> 16)"


def dealt(source: str, name: str, walks: int = 8) -> str:
    """CTEs of keyed permutations: ``source`` has place, n and key (all BIGINT); ``name`` its columns and ``image``.

    The images that lie beyond n are dealt again, up to ``walks`` times; the share left is some n^(-walks / 2).
    """
    keys = ", ".join(f"{_mixed(f'((key + {r} * {dealing.ROUND_STEP}) % {dealing.WORD})')} AS k{r}" for r in range(dealing.ROUNDS))
    steps = [f"{name}_a AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS fa, {keys}, place AS image, false AS inside FROM {source})", f"{name}_0 AS (SELECT *, (n + fa - 1) // fa AS fb FROM {name}_a)"]
    before = f"{name}_0"
    for w in range(walks):
        now = f"{name}_w{w}"
        steps.append(f"{now}_s AS (SELECT *, image // fb AS l, image % fb AS r FROM {before})")
        inner = f"{now}_s"
        for r in range(dealing.ROUNDS):
            own, other, size = ("r", "l", "fb") if r % 2 else ("l", "r", "fa")
            steps.append(f"{now}_{r} AS (SELECT * REPLACE (({own} + {_mixed(f'(({other} + k{r}) % {dealing.WORD})')}) % {size} AS {own}) FROM {inner})")
            inner = f"{now}_{r}"
        steps.append(f"{now} AS (SELECT * EXCLUDE (l, r) REPLACE (CASE WHEN inside THEN image ELSE l * fb + r END AS image, inside OR l * fb + r < n AS inside) FROM {inner})")
        before = now
    steps.append(f"{name} AS MATERIALIZED (SELECT * EXCLUDE (fa, fb, {', '.join(f'k{r}' for r in range(dealing.ROUNDS))}, inside) FROM {before})")
    return ",\n".join(steps)


def deal_key(seed: int, draw: str, bin_: str | None = None, name: str | None = None) -> str:
    parts = [f"CAST({seed * dealing.SEED_STEP} AS BIGINT)", f"CAST({draw} AS BIGINT) * {dealing.DRAW_STEP}"]
    if bin_ is not None:
        parts.append(f"CAST({bin_} AS BIGINT) * {dealing.BIN_STEP}")
    if name is not None:
        parts.append(f"CAST('0x' || substr(md5(CAST({name} AS VARCHAR)), 1, 7) AS BIGINT)")
    return f"(({' + '.join(parts)}) % {dealing.KEYS})"


def drawn(n_draws: int, name: str = "drawn", seed: int = 0) -> str:
    """CTEs of random sets from ``want`` (set_name, bin, want) and ``bins`` (gene, bin): ``name`` has set_name, draw and gene."""
    return f"""placed AS (SELECT gene, bin, row_number() OVER (PARTITION BY bin ORDER BY gene) - 1 AS p FROM bins), have AS (SELECT bin, count(*) AS have FROM bins GROUP BY 1),
asked AS (SELECT set_name, draw, bin, unnest(range(0, least(want, have))) AS place, have AS n, {deal_key(seed, "draw", "bin", "set_name")} AS key FROM want JOIN have USING (bin), range(0, {n_draws}) AS d(draw)), {dealt("asked", "found")},
{name} AS (SELECT set_name, CAST(draw AS INTEGER) AS draw, gene FROM found JOIN placed ON placed.bin = found.bin AND p = image)"""


def permuted(base: str, key: str, within: str | None, n_perm: int, seed: int = 0) -> str:
    """CTEs of permutations of rows: ``deal`` has perm, k, the stratum and p, the place in ``own`` whose label the row takes."""
    by, cols = (f"PARTITION BY {within}", f"{within}, ") if within else ("", "")
    return f"""own AS (SELECT *, row_number() OVER ({by} ORDER BY {key}) - 1 AS p, count(*) OVER ({by}) AS rows_ FROM {base}),
asked AS (SELECT perm, {key} AS k, {cols}p AS place, rows_ AS n, {deal_key(seed, "perm", name=within)} AS key FROM own, range(0, {n_perm}) AS r(perm)), {dealt("asked", "found")}, deal AS (SELECT perm, k, {cols}image AS p FROM found)"""
