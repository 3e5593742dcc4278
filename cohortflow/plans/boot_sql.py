"""SQL twins of the resampling operators: the same uniform numbers, but distribution functions from
log-factorials, and draws by counting."""

from __future__ import annotations

from cohortflow import config
from cohortflow.plans import eval_sql as es

LO, HI = config.CI_QUANTILES


def _uniform(draw: str, keys) -> str:
    text = " || '|' || ".join([f"'{config.SEED}|{draw}'", *[f"CAST({k} AS VARCHAR)" for k in [*keys, "rep"]]])
    return f"((('0x' || substr(md5({text}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def _binomial(src: str, out: str, n: str, p: str, u: str) -> str:
    """CTEs: src with a column ``x`` under the name ``out``."""
    return f"""{out}_a AS (SELECT *, CAST({n} AS BIGINT) AS bn, {p} AS bp, {u} AS bu FROM {src}),
{out}_b AS (SELECT *, least(bp, 1.0 - bp) AS bq, CASE WHEN bp <= 0.5 THEN bu ELSE 1.0 - bu END AS bv FROM {out}_a),
{out}_t AS (SELECT bn, bq, j, CASE WHEN bq = 0 THEN CASE WHEN j = 0 THEN 1.0 ELSE 0.0 END
                 ELSE exp(lgamma(bn + 1) - lgamma(j + 1) - lgamma(bn - j + 1) + j * ln(bq) + (bn - j) * ln(1.0 - bq)) END AS pmf
            FROM (SELECT bn, bq, unnest(generate_series(0, bn - 1)) AS j FROM (SELECT DISTINCT bn, bq FROM {out}_b WHERE bn > 0))),
{out}_l AS (SELECT bn, bq, list(c ORDER BY j) AS cdf
            FROM (SELECT bn, bq, j, sum(pmf) OVER (PARTITION BY bn, bq ORDER BY j ROWS UNBOUNDED PRECEDING) AS c FROM {out}_t) GROUP BY bn, bq),
{out}_h AS (SELECT b.*, coalesce(len(list_filter(l.cdf, lambda c: c < b.bv)), 0) AS hits FROM {out}_b b LEFT JOIN {out}_l l ON l.bn = b.bn AND l.bq = b.bq),
{out} AS (SELECT * EXCLUDE (bn, bp, bu, bq, bv, hits), CAST(CASE WHEN bp <= 0.5 THEN hits ELSE bn - hits END AS BIGINT) AS x FROM {out}_h)"""


def replicates(src: str, keys, p: str = "", iterations: int = config.BOOTSTRAP_ITERATIONS) -> str:
    """B1: CTEs that end in ``{p}reps`` (rep, keys, TP, FN, FP)."""
    k = ", ".join(keys)
    return f"""
{p}r0 AS (SELECT {k}, TP, FN, FP, unnest(generate_series(0, {iterations - 1})) AS rep FROM {src}),
{_binomial(f"{p}r0", f"{p}r1", "TP + FN + FP", "CASE WHEN TP + FN + FP > 0 THEN CAST(TP AS DOUBLE) / (TP + FN + FP) ELSE 0.0 END", _uniform("first", keys))},
{p}r2 AS (SELECT * RENAME (x AS tp_drawn) FROM {p}r1),
{_binomial(f"{p}r2", f"{p}r3", "TP + FN + FP - tp_drawn", "CASE WHEN FN + FP > 0 THEN CAST(FN AS DOUBLE) / (FN + FP) ELSE 0.0 END", _uniform("second", keys))},
{p}reps AS (SELECT rep, {k}, tp_drawn AS TP, x AS FN, TP + FN + FP - tp_drawn - x AS FP FROM {p}r3)"""


def metric_rows(src: str, group, den: str | None = None, p: str = "", rep: bool = False) -> str:
    """A11-A16 of a confusion CTE: CTEs that end in ``{p}fin``."""
    keys = [*group, *(["rep"] if rep else [])]
    num = ["Support", "PPV", "Sensitivity", "F1", "TP", "FP", "FN"] + (["Specificity", "TN"] if den else [])
    if den:
        on = " AND ".join(f"c.{g} = d.{g}" for g in group)
        counted = f"{p}cn AS (SELECT c.*, d.N FROM {src} c LEFT JOIN {den} d ON {on}),\n"
        m = f"SELECT * EXCLUDE (N) FROM ({es.with_metrics(f'{p}cn', True, 'N - (TP + FP + FN)')})"
    else:
        counted, m = "", es.with_metrics(src)
    return f"""
{counted}{p}m AS ({m}),
{p}fin AS ({es.avg_metrics(f"{p}m", keys, num, with_specificity=bool(den))})"""


def one_decimal(x: str) -> str:
    return f"printf('%.1f', floor({x} * 10 + 0.5) / 10)"


def interval(src: str, keys, metrics, p: str = "") -> str:
    """CTE ``{p}ci``: keys, and for each metric its ``(lo - hi)``."""
    cols = []
    for m in metrics:
        whole = f"count({m}) = count(*)"
        lo, hi = (one_decimal(f"quantile_cont({m}, {q})") for q in (LO, HI))
        cols.append(f"CASE WHEN {whole} THEN '(' || {lo} || ' - ' || {hi} || ')' END AS {m}_ci")
    k = ", ".join(keys)
    return f"{p}ci AS (SELECT {k}, {', '.join(cols)} FROM {src} GROUP BY {k})"


def cells(point: str, ci: str, keys, metrics, p: str = "") -> str:
    """CTE ``{p}cell``: ``v (lo - hi)`` and the bare value of each metric."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    cell = ", ".join(f"CASE WHEN a.{m} IS NOT NULL THEN {one_decimal(f'a.{m}')} || coalesce(' ' || b.{m}_ci, '') END AS {m}, a.{m} AS {m}_value" for m in metrics)
    return f"{p}cell AS (SELECT {', '.join(f'a.{k}' for k in keys)}, {cell} FROM {point} a LEFT JOIN {ci} b ON {on})"


def with_intervals(counts: str, group, den: str | None = None, p: str = "") -> str:
    """CTEs that end in ``{p}cell`` for a confusion CTE (label_name, label_value, group...)."""
    keys = ["label_name", "label_value", *group]
    names = ["PPV", "Sensitivity", "F1"] + (["Specificity"] if den else [])
    base = f"{p}base AS (SELECT {', '.join(keys)}, TP, FN, FP FROM {counts} WHERE label_name <> 'Total')"
    return ",".join([f"\n{base}", metric_rows(f"{p}base", group, den, f"{p}o"), replicates(f"{p}base", keys, p),
                     metric_rows(f"{p}reps", group, den, f"{p}b", rep=True), "\n" + interval(f"{p}bfin", keys, names, p),
                     "\n" + cells(f"{p}ofin", f"{p}ci", keys, names, p)])


RARE = "(" + ", ".join(f"'{x}'" for x in ["Total", *config.RARE_COMORBS]) + ")"


def zero_safe(src: str, g, p: str = "") -> str:
    """CTEs that end in ``{p}zs`` (g, method, metric, value)."""
    ms = ["PPV", "Sensitivity", "F1", "Support"]
    by = ", ".join(g)
    sel, grp = (by + ", " if g else ""), (f"GROUP BY {by}" if g else "")

    def safe(x):
        return f"""SELECT *, CASE WHEN TP + FP > 0 THEN 100.0 * (TP / (TP + FP)) ELSE 0.0 END AS PPV,
              CASE WHEN TP + FN > 0 THEN 100.0 * (TP / (TP + FN)) ELSE 0.0 END AS Sensitivity,
              CASE WHEN TP + FP > 0 AND TP + FN > 0 THEN 100.0 * ((2.0 * TP) / (2.0 * TP + FP + FN)) ELSE 0.0 END AS F1,
              TP + FN AS Support FROM {x}"""

    return f"""
{p}z0 AS (SELECT {sel}label_name, CAST(sum(TP) AS DOUBLE) AS TP, CAST(sum(FP) AS DOUBLE) AS FP, CAST(sum(FN) AS DOUBLE) AS FN FROM {src} GROUP BY {sel}label_name),
{p}z1 AS ({safe(f"{p}z0")}),
{p}z2 AS (SELECT {sel}sum(TP) AS TP, sum(FP) AS FP, sum(FN) AS FN FROM {p}z0 {grp}),
{p}z3 AS (SELECT * FROM {p}z1 WHERE label_name NOT IN {RARE}),
{p}z4 AS (SELECT {sel}'micro' AS method, {", ".join(ms)} FROM ({safe(f"{p}z2")})
   UNION ALL SELECT {sel}'macro', {", ".join(f"sum({m}) / NULLIF(CAST(count_if(Support > 0) AS DOUBLE), 0)" for m in ms)} FROM {p}z3 {grp}
   UNION ALL SELECT {sel}'weighted', {", ".join(f"sum({m} * Support) / NULLIF(sum(Support), 0)" for m in ms)} FROM {p}z3 {grp}),
{p}zs AS (SELECT * FROM {p}z4 UNPIVOT INCLUDE NULLS (value FOR metric IN ({", ".join(ms)})))"""


def zero_safe_intervals(src: str, keys, stratify: str | None = None, p: str = "") -> str:
    """CTEs that end in ``{p}out`` (keys, metric, method, value, CI)."""
    k = [*keys, "method", "metric"]
    on = " AND ".join(f"a.{c} = b.{c}" for c in k)
    return ",".join([zero_safe(src, list(keys), f"{p}p"), replicates(src, [*keys, *([stratify] if stratify else []), "label_name"], p),
                     zero_safe(f"{p}reps", [*keys, "rep"], f"{p}q"), "\n" + interval(f"{p}qzs", k, ["value"], p),
                     f"\n{p}out AS (SELECT {', '.join(f'a.{c}' for c in k)}, a.value, b.value_ci AS CI FROM {p}pzs a JOIN {p}ci b ON {on})"])
