"""SQL text of the binned fit, for checking only."""

from __future__ import annotations

from regrowth.operators.fitting import RATIO, SCAN, TAU_HI, TAU_LO, ZOOM


def bins_sql(source: str, keys: str, value: str = "y", min_bin: int = 10) -> str:
    """SELECT of usable bins (keys, t, m, w, n) from rows with ``bin``."""
    k = f"{keys}, " if keys else ""
    return (
        f"SELECT {k}0.6::DOUBLE + (bin + 0.5::DOUBLE) AS t, avg({value}) AS m, "
        f"power(greatest(stddev_samp({value}) / sqrt(count({value})), 1e-3::DOUBLE), -2.0) AS w, count({value}) AS n "
        f"FROM {source} WHERE {value} IS NOT NULL GROUP BY {k}bin HAVING count({value}) >= {min_bin}"
    )


def fit_sql(bins: str, keys: str, out: str, min_bins: int = 5, bound: float = 25.0) -> str:
    """CTEs turning usable bins (keys, t, m, w) into ``out``(keys, tau, amp, tau_se, amp_se, n_bins)."""
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    num = "list_sum(list_transform(pts, lambda p: p.w * p.m * exp(-p.t / {t})))"
    den = "list_sum(list_transform(pts, lambda p: p.w * exp(-2 * p.t / {t})))"

    def best(grid: str) -> str:
        amps = f"list_transform({grid}, lambda x: {{'tau': x, 'amp': least(greatest({num.format(t='x')} / {den.format(t='x')}, {-bound}), {bound})}})"
        cost = (
            "{'ssr': list_sum(list_transform(pts, lambda p: p.w * power(p.m - g.amp * exp(-p.t / g.tau), 2.0))), 'tau': g.tau, 'amp': g.amp}"
        )
        return f"list_sort(list_transform({amps}, lambda g: {cost}))[1]"

    scan = f"list_transform(range({SCAN}), lambda i: {TAU_LO}::DOUBLE * power({RATIO!r}::DOUBLE, CAST(i AS DOUBLE)))"
    zoom = f"list_transform(range({ZOOM + 1}), lambda i: lo + (hi - lo) * i / {ZOOM})"
    parts = [
        f"{out}_p AS (SELECT {k}list({{'t': t, 'm': m, 'w': w}} ORDER BY t) AS pts, count(*) AS n_bins FROM ({bins}) {g} HAVING count(*) >= {min_bins})",
        f"{out}_0 AS (SELECT *, {best(scan)} AS b FROM {out}_p)",
        f"{out}_0r AS (SELECT * EXCLUDE (b), greatest({TAU_LO}, b.tau / {RATIO!r}::DOUBLE) AS lo, least({TAU_HI}, b.tau * {RATIO!r}::DOUBLE) AS hi FROM {out}_0)",
    ]
    for i in (1, 2, 3):
        parts.append(f"{out}_{i} AS (SELECT *, {best(zoom)} AS b FROM {out}_{i - 1}r)")
        if i < 3:
            parts.append(
                f"{out}_{i}r AS (SELECT * EXCLUDE (b, lo, hi), greatest({TAU_LO}, b.tau - (hi - lo) / {ZOOM}) AS lo, "
                f"least({TAU_HI}, b.tau + (hi - lo) / {ZOOM}) AS hi FROM {out}_{i})"
            )
    mom = "list_sum(list_transform(pts, lambda p: p.w * power(p.t, {j}) * exp(-2 * p.t / b.tau)))"
    parts.append(
        f"{out}_s AS (SELECT {k}b.tau AS tau, b.amp AS amp, n_bins, {mom.format(j=0)} AS s0, {mom.format(j=1)} AS s1, {mom.format(j=2)} AS s2 FROM {out}_3)"
    )
    parts.append(
        f"{out} AS (SELECT {k}tau, amp, n_bins, sqrt(s2 / (s0 * s2 - s1 * s1)) AS amp_se, "
        f"sqrt(s0 / (s0 * s2 - s1 * s1)) / abs(amp / (tau * tau)) AS tau_se FROM {out}_s)"
    )
    return ",\n".join(parts)


MELT = (
    "ml AS (SELECT * EXCLUDE (dlst, dndvi), 'dlst' AS measure, dlst AS y FROM post WHERE dlst IS NOT NULL "
    "UNION ALL SELECT * EXCLUDE (dlst, dndvi), 'dndvi', dndvi FROM post WHERE dndvi IS NOT NULL)"
)
