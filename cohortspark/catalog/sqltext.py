"""SQL text builders for the statements that need repeated formulas."""

from __future__ import annotations

from collections.abc import Sequence

from cohortspark.functions import numeric as num


def poly(x: str, coefficients: Sequence[float]) -> str:
    text = repr(float(coefficients[-1])) + ("" if "e" in repr(float(coefficients[-1])) else "e0")
    for c in reversed(coefficients[:-1]):
        c = repr(float(c)) + ("" if "e" in repr(float(c)) else "e0")
        text = f"({text}) * {x} + {c}"
    return f"({text})"


def qnorm(p: str) -> str:
    q, r0 = f"({p} - 0.5e0)", f"(0.180625e0 - ({p} - 0.5e0) * ({p} - 0.5e0))"
    t = f"sqrt(-ln(CASE WHEN {p} < 0.5e0 THEN {p} ELSE 1e0 - {p} END))"
    mid = f"{poly(f'({t} - 1.6e0)', num.AS241_MIDDLE_NUM)} / {poly(f'({t} - 1.6e0)', num.AS241_MIDDLE_DEN)}"
    far = f"{poly(f'({t} - 5e0)', num.AS241_FAR_NUM)} / {poly(f'({t} - 5e0)', num.AS241_FAR_DEN)}"
    centre = f"{q} * {poly(r0, num.AS241_CENTRE_NUM)} / {poly(r0, num.AS241_CENTRE_DEN)}"
    return f"CASE WHEN abs({q}) <= 0.425e0 THEN {centre} ELSE sign({q}) * (CASE WHEN {t} <= 5e0 THEN {mid} ELSE {far} END) END"


def log_erfc(x: str) -> str:
    y, inv = f"({x} * {x})", f"(1e0 / ({x} * {x}))"
    near = f"ln(1e0 - {x} * {poly(y, num.CODY_ERF_NUM)} / {poly(y, num.CODY_ERF_DEN)})"
    mid = f"(-{y} + ln({poly(x, num.CODY_MID_NUM)} / {poly(x, num.CODY_MID_DEN)}))"
    far = f"(-{y} + ln((1e0 / sqrt(pi()) - {inv} * {poly(inv, num.CODY_FAR_NUM)} / {poly(inv, num.CODY_FAR_DEN)}) / {x}))"
    return f"CASE WHEN {x} <= 0.46875e0 THEN {near} WHEN {x} <= 4e0 THEN {mid} ELSE {far} END"


def rank_norm(keys: Sequence[str], value: str) -> str:
    by = f"PARTITION BY {', '.join(keys)}"
    rank = f"(rank() OVER ({by} ORDER BY {value}) + (COUNT(*) OVER ({by}, {value}) - 1) / 2e0)"
    return f"({rank} - 0.375e0) / (COUNT(*) OVER ({by}) + 0.25e0)"


def gram_schmidt(source: str, xs: Sequence[str], prefix: str = "g") -> tuple[list[str], list[str]]:
    """CTEs that add columns q0.. spanning 1 and xs; returns (ctes, names of q columns)."""
    ctes = [f"{prefix}0 AS MATERIALIZED (SELECT *, 1e0 AS q0 FROM {source})"]
    qs = ["q0"]
    for j, x in enumerate(xs, start=1):
        prev = f"{prefix}{j - 1}"
        fit = " - ".join(
            [x, *[f"(SELECT SUM({x} * {q}) / SUM({q} * {q}) FROM {prev}) * {q}" for q in qs]])
        ctes.append(f"{prefix}{j} AS MATERIALIZED (SELECT *, {fit} AS q{j} FROM {prev})")
        qs.append(f"q{j}")
    return ctes, qs


def km(source: str, groups: Sequence[str], name: str = "km") -> list[str]:
    """CTEs ending in ``name``: groups, time, at_risk, events, censored, surv, std_err, lower, upper."""
    g = ", ".join(groups)
    part = f"PARTITION BY {g}" if groups else ""
    gg = f"{g}, " if groups else ""
    return [
        f"{name}_n AS (SELECT {gg}time, COUNT(*) AS n, SUM(CASE WHEN status = 1 THEN 1 ELSE 0 END) AS d FROM {source} WHERE time IS NOT NULL AND status IS NOT NULL GROUP BY {gg}time)",
        f"{name}_r AS (SELECT *, SUM(n) OVER ({part} ORDER BY time DESC) AS r FROM {name}_n)",
        f"""{name}_s AS (SELECT *, SUM(CASE WHEN d < r THEN ln(1e0 - d / CAST(r AS DOUBLE)) ELSE 0 END) OVER w AS ls, MAX(CASE WHEN d = r THEN 1 ELSE 0 END) OVER w AS dead,
  SUM(CASE WHEN d < r THEN d / (CAST(r AS DOUBLE) * (r - d)) ELSE 0 END) OVER w AS gs FROM {name}_r WINDOW w AS ({part} ORDER BY time))""",
        f"""{name} AS (SELECT {gg}time, CAST(r AS DOUBLE) AS at_risk, CAST(d AS BIGINT) AS events, CAST(n - d AS BIGINT) AS censored, CASE WHEN dead = 1 THEN 0e0 ELSE exp(ls) END AS surv,
  CASE WHEN dead = 0 THEN sqrt(gs) END AS std_err, CASE WHEN dead = 0 THEN exp(ls - 1.959963984540054e0 * sqrt(gs)) END AS lower,
  CASE WHEN dead = 0 THEN LEAST(exp(ls + 1.959963984540054e0 * sqrt(gs)), 1e0) END AS upper FROM {name}_s)""",
    ]


def median(source: str, groups: Sequence[str]) -> str:
    g = ", ".join(groups)
    gg = f"{g}, " if groups else ""
    tail = f" GROUP BY {g}" if groups else ""
    return f"""SELECT {gg}COALESCE((MIN(CASE WHEN abs(surv - 0.5) < 1e-9 THEN time END) + COALESCE(MIN(CASE WHEN surv < 0.5 AND abs(surv - 0.5) >= 1e-9 THEN time END), MIN(CASE WHEN abs(surv - 0.5) < 1e-9 THEN time END))) / 2,
  MIN(CASE WHEN surv < 0.5 THEN time END)) AS median, MIN(CASE WHEN lower <= 0.5 THEN time END) AS lower, MIN(CASE WHEN upper <= 0.5 THEN time END) AS upper FROM {source}{tail}"""


def pair_logrank(source: str, group: str, a: str, b: str) -> str:
    """Chi-square of two groups, from at-risk counts at each event time."""
    return f"""(SELECT SUM(da - (da + db) * ra / (ra + rb)) ^ 2 / NULLIF(SUM(CASE WHEN ra + rb > 1 THEN (da + db) * ra * rb / (ra + rb) / (ra + rb) * (ra + rb - da - db) / (ra + rb - 1) ELSE 0 END), 0)
  FROM (SELECT t.time, CAST(SUM(CASE WHEN s.{group} = {a} AND s.time >= t.time THEN 1 ELSE 0 END) AS DOUBLE) AS ra, CAST(SUM(CASE WHEN s.{group} = {b} AND s.time >= t.time THEN 1 ELSE 0 END) AS DOUBLE) AS rb,
    CAST(SUM(CASE WHEN s.{group} = {a} AND s.time = t.time AND s.status = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS da, CAST(SUM(CASE WHEN s.{group} = {b} AND s.time = t.time AND s.status = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS db
    FROM (SELECT DISTINCT time FROM {source} WHERE status = 1) t, {source} s GROUP BY t.time) g WHERE ra + rb > 0)"""


def cif(source: str, groups: Sequence[str]) -> list[str]:
    """CTEs ending in ``ci``: incidence of status 1 with status 2 competing, and its variance."""
    g = ", ".join(groups)
    w = f"(PARTITION BY {g} ORDER BY time)"
    before = f"(PARTITION BY {g} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return [
        f"ci_n AS (SELECT {g}, time, COUNT(*) AS n, SUM(CAST(status = 1 AS INT)) AS d1, SUM(CAST(status = 2 AS INT)) AS d2 FROM {source} WHERE time IS NOT NULL AND status IS NOT NULL GROUP BY {g}, time)",
        f"ci_r AS (SELECT {g}, time, CAST(d1 AS DOUBLE) AS d1, CAST(d2 AS DOUBLE) AS d2, CAST(SUM(n) OVER (PARTITION BY {g} ORDER BY time DESC) AS DOUBLE) AS r FROM ci_n)",
        f"""ci_s AS (SELECT *, CASE WHEN COALESCE(MAX(CASE WHEN d1 + d2 = r THEN 1 ELSE 0 END) OVER {before}, 0) = 1 THEN 0e0
  ELSE exp(COALESCE(SUM(CASE WHEN d1 + d2 < r THEN ln(1e0 - (d1 + d2) / r) ELSE 0 END) OVER {before}, 0)) END AS s0 FROM ci_r)""",
        f"ci_f AS (SELECT *, s0 * (r - d1 - d2) / r AS s1, SUM(s0 * d1 / r) OVER {w} AS est FROM ci_s)",
        f"""ci_t AS (SELECT *, CASE WHEN s1 > 0 THEN 1 / s1 ELSE 0 END AS iv, CASE WHEN d1 > 0 THEN s0 * s0 * CASE WHEN d1 > 1 THEN 1 - (d1 - 1) / (r - 1) ELSE 1 END * d1 / r / r ELSE 0 END AS w1,
  CASE WHEN d2 > 0 AND s1 > 0 THEN s0 * s0 * CASE WHEN d2 > 1 THEN 1 - (d2 - 1) / (r - 1) ELSE 1 END * d2 / r / r ELSE 0 END AS w2 FROM ci_f)""",
        f"""ci AS (SELECT {g}, time, r AS at_risk, CAST(d1 AS BIGINT) AS d1, CAST(d2 AS BIGINT) AS d2, est, GREATEST(SUM((1 + iv * est) ^ 2 * w1 + (iv * est) ^ 2 * w2) OVER {w}
  + est * est * SUM(iv * iv * (w1 + w2)) OVER {w} - 2 * est * SUM(iv * (1 + iv * est) * w1 + iv * iv * est * w2) OVER {w}, 0) AS var FROM ci_t)""",
    ]


def fold(key: str, nfolds: int) -> str:
    return f"CAST(CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 6) AS BIGINT) % {nfolds} AS INTEGER)"


def stitched(base: str, names: Sequence[str], generations: Sequence[Sequence[int]], step: int, nfolds: int, prefix: str = "") -> list[str]:
    """CTEs of ridge models (penalty 0.001) out of fold, oldest generation first.

    ``base`` selects id, sex, age, known, last and the features. Ends in ``{prefix}held`` (id,
    sex, age, fold, score) and ``{prefix}model`` (age, fold, base, m1.., w1..). The normal
    equations of every age and fold are solved by elimination, one CTE a pivot.
    """
    p, t = len(names), prefix
    cols = ", ".join(f'{n} AS x{j}' for j, n in enumerate(names, 1))
    ages = ", ".join(str(a) for g in generations for a in g)
    out = [f"{t}base AS MATERIALIZED (SELECT id, sex, age, {fold('id', nfolds)} AS fold, known, last, {cols} FROM ({base}) b WHERE age IN ({ages}))"]
    z = ["1e0", *[f"COALESCE(y.x{j} - m.m{j}, 0e0)" for j in range(1, p + 1)]]
    for g, mine in enumerate(generations):
        here = f"age IN ({', '.join(map(str, mine))})"
        if g == 0:
            out.append(f"{t}y0 AS MATERIALIZED (SELECT *, CAST(last AS DOUBLE) AS y FROM {t}base WHERE {here})")
        else:
            out.append(f"""{t}y{g} AS MATERIALIZED (SELECT b.*, COALESCE(CAST(b.known AS DOUBLE), h.score) AS y FROM {t}base b
  LEFT JOIN {t}h{g - 1} h ON h.id = b.id AND h.age = b.age + {step} WHERE b.{here})""")
        out.append(f"""{t}m{g} AS MATERIALIZED (SELECT y.age, f.f, {', '.join(f'AVG(y.x{j}) AS m{j}' for j in range(1, p + 1))}
  FROM {t}y{g} y JOIN range({nfolds}) f(f) ON y.fold <> f.f WHERE y.y IS NOT NULL GROUP BY y.age, f.f)""")
        ridge = lambda i, j: " * 1.001e0 + 1e-12 * COUNT(*)" if i == j > 0 else ""
        products = [f"SUM(({z[i]}) * ({z[j]})){ridge(i, j)} AS a{i}_{j}" for i in range(p + 1) for j in range(p + 1)] + [f"SUM(({z[i]}) * y.y) AS a{i}_{p + 1}" for i in range(p + 1)]
        out.append(f"{t}e{g}_0 AS MATERIALIZED (SELECT m.age, m.f, {', '.join(products)} FROM {t}y{g} y JOIN {t}m{g} m ON m.age = y.age AND m.f <> y.fold WHERE y.y IS NOT NULL GROUP BY m.age, m.f)")
        for k in range(p + 1):
            cells = [f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}"
                     for i in range(p + 1) for j in range(k + 1, p + 2)]
            out.append(f"{t}e{g}_{k + 1} AS MATERIALIZED (SELECT age, f, {', '.join(cells)} FROM {t}e{g}_{k})")
        out.append(f"""{t}c{g} AS MATERIALIZED (SELECT m.age, CAST(m.f AS INTEGER) AS fold, a0_{p + 1} AS base, {', '.join(f'm{j}, a{j}_{p + 1} AS w{j}' for j in range(1, p + 1))}
  FROM {t}m{g} m JOIN {t}e{g}_{p + 1} e ON e.age = m.age AND e.f = m.f)""")
        out.append(f"{t}h{g} AS MATERIALIZED (SELECT y.id, y.sex, y.age, y.fold, {linear_score(p)} AS score FROM {t}y{g} y JOIN {t}c{g} m ON m.age = y.age AND m.fold = y.fold)")
    n = range(len(generations))
    return [*out, f"{t}held AS ({' UNION ALL '.join(f'SELECT * FROM {t}h{g}' for g in n)})", f"{t}model AS ({' UNION ALL '.join(f'SELECT * FROM {t}c{g}' for g in n)})"]


def linear_score(p: int, x: str = "y.x{}") -> str:
    terms = " + ".join(f"COALESCE(m.w{j} * ({x.format(j)} - m.m{j}), 0e0)" for j in range(1, p + 1))
    return f"round(LEAST(GREATEST(m.base + {terms}, 0e0), 1e0), 9)"


def cox_null(source: str, keys: Sequence[str], names: Sequence[str], steps: int = 8) -> list[str]:
    """CTEs of a Cox model with Efron ties by unrolled Newton steps from zero.

    ``source`` selects keys, time, status and the covariates. Ends in ``cox`` with the
    residual of each row; the equations of a step are solved by elimination.
    """
    k, ks = range(1, len(names) + 1), ", ".join(keys)
    cols = ", ".join(f"CAST({n} AS DOUBLE) AS x{i}" for i, n in zip(k, names))
    out = [f"cr AS MATERIALIZED (SELECT {ks}, CAST(time AS DOUBLE) AS time, CAST(status AS INTEGER) AS status, {cols} FROM ({source}) s)",
           f"b0 AS (SELECT {', '.join(f'0e0 AS b{i}' for i in k)})"]
    pairs = [(i, j) for i in k for j in k if i <= j]
    parts = {"0": "e", **{f"{i}": f"e * x{i}" for i in k}, **{f"{i}_{j}": f"e * x{i} * x{j}" for i, j in pairs}}

    def risk(t: int, used: dict[str, str]) -> list[str]:
        line = " + ".join(f"x{i} * b{i}" for i in k)
        sums = ", ".join(f"SUM({v}) AS n{n}, SUM(CASE WHEN status = 1 THEN {v} ELSE 0e0 END) AS e{n}" for n, v in used.items())
        dead = ", ".join(f"SUM(CASE WHEN status = 1 THEN x{i} ELSE 0e0 END) AS d{i}" for i in k)
        return [f"p{t} AS MATERIALIZED (SELECT time, SUM(status) AS d, {sums}, {dead} FROM (SELECT cr.*, exp({line}) AS e FROM cr, b{t}) r GROUP BY time)",
                f"r{t} AS MATERIALIZED (SELECT *, {', '.join(f'SUM(n{n}) OVER (ORDER BY time DESC) AS s{n}' for n in used)} FROM p{t})",
                f"l{t} AS MATERIALIZED (SELECT *, l / d AS w, 1e0 / (s0 - l / d * e0) AS u FROM (SELECT *, CAST(unnest(range(CAST(d AS BIGINT))) AS DOUBLE) AS l FROM r{t}) q)"]

    for t in range(steps):
        out += risk(t, parts)
        a = {i: f"(s{i} - w * e{i})" for i in k}
        hess = [f"SUM((s{i}_{j} - w * e{i}_{j}) * u - {a[i]} * {a[j]} * u * u) AS a{x}_{y}" for i, j in pairs for x, y in {(i, j), (j, i)}]
        grad = [f"(SELECT SUM(d{i}) FROM p{t}) - SUM({a[i]} * u) AS a{i}_{len(names) + 1}" for i in k]
        out.append(f"h{t}_0 AS MATERIALIZED (SELECT {', '.join(hess + grad)} FROM l{t})")
        for q in k:
            cells = [f"a{q}_{j} / a{q}_{q} AS a{q}_{j}" if i == q else f"a{i}_{j} - a{i}_{q} * a{q}_{j} / a{q}_{q} AS a{i}_{j}" for i in k for j in range(q + 1, len(names) + 2)]
            out.append(f"h{t}_{q} AS MATERIALIZED (SELECT {', '.join(cells)} FROM h{t}_{q - 1})")
        moved = ", ".join(f"b{i} + a{i}_{len(names) + 1} AS b{i}" for i in k)
        out.append(f"b{t + 1} AS MATERIALIZED (SELECT {moved} FROM b{t}, h{t}_{len(names)})")
    out += risk(steps, {"0": "e"})
    line = " + ".join(f"x{i} * b{i}" for i in k)
    xs = ", ".join(f"x{i} AS {n}" for i, n in zip(k, names))
    return [*out,
            f"hz AS MATERIALIZED (SELECT time, SUM(COALESCE(jump, 0e0)) OVER (ORDER BY time) AS cum, COALESCE(tied, 0e0) AS tied FROM p{steps} LEFT JOIN (SELECT time, SUM(u) AS jump, SUM(w * u) AS tied FROM l{steps} GROUP BY time) j USING (time))",
            f"cox AS MATERIALIZED (SELECT {ks}, time, status, {xs}, status - exp({line}) * (cum - status * tied) AS resid FROM cr JOIN hz USING (time), b{steps})"]
