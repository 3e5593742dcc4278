"""SQL twins of the evaluation operators (DuckDB dialect), built as strings."""

from __future__ import annotations

from cohortflow import config
from cohortflow.plans.sqlmodel import lit
from cohortflow.sources import dims

LIST_LABELS = "(" + ", ".join(lit(x) for x in dims.list_type_labels()) + ")"
RARE = "(" + ", ".join(lit(x) for x in config.RARE_COMORBS) + ")"


def aggregated(src: str) -> str:
    return (f"SELECT * FROM {src} UNION ALL "
            f"SELECT * REPLACE ('3' AS label_value) FROM {src} WHERE label_name IN {LIST_LABELS}")


def overall(src: str) -> str:
    return f"SELECT * FROM {src} UNION ALL SELECT * REPLACE ('Overall' AS cse) FROM {src}"


def removed_aggregated(src: str) -> str:
    one = f"(SELECT count(DISTINCT label_value) <= 1 FROM {src})"
    return (f"SELECT * REPLACE (CASE WHEN label_name IN {LIST_LABELS} AND NOT {one} THEN '1' ELSE label_value END AS label_value) "
            f"FROM {src} WHERE {one} OR label_name NOT IN {LIST_LABELS} OR regexp_matches(label_value, '\\b(3|average)')")


def pct(num: str, den: str) -> str:
    return f"(100.0 * (CAST({num} AS DOUBLE) / CAST(NULLIF({den}, 0) AS DOUBLE)))"


def f1(p: str, s: str) -> str:
    return f"((2.0 * {p} * {s}) / NULLIF({p} + {s}, 0))"


def with_metrics(src: str, with_specificity: bool = False, tn_expr: str | None = None) -> str:
    tn = f", {tn_expr} AS TN" if tn_expr else ""
    inner = f"SELECT *, TP + FN AS Support, {pct('TP', 'TP + FP')} AS PPV, {pct('TP', 'TP + FN')} AS Sensitivity{tn} FROM {src}"
    spec = f", {pct('TN', 'TN + FP')} AS Specificity" if with_specificity else ""
    return f"SELECT *, {f1('PPV', 'Sensitivity')} AS F1{spec} FROM ({inner})"


def avg_metrics(src: str, group_cols, num_cols, label_cols=("label_name", "label_value"),
                with_specificity: bool = False) -> str:
    """A13-A16 appended to ``src`` (all columns of src, in order given by
    label_cols + group_cols + num_cols)."""
    metrics = ["PPV", "Sensitivity", "F1"] + (["Specificity"] if with_specificity else [])
    counts = ["TP", "FP", "FN"] + (["TN"] if with_specificity else [])
    g = ", ".join(group_cols)
    gsel = (g + ", ") if group_cols else ""
    gby = f"GROUP BY {g}" if group_cols else ""
    base = f"(SELECT * FROM {src} WHERE label_name <> 'Total')"
    data = f"(SELECT * FROM {base} WHERE label_name NOT IN {RARE})"
    if "label_value" in label_cols:
        data = f"({removed_aggregated(data)})"

    def lab(kind):
        if len(label_cols) == 1:
            return f"'{kind} average' AS {label_cols[0]}"
        return f"'Total' AS label_name, '{kind} average' AS label_value"

    micro_counts = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in counts)
    micro = f"SELECT {lab('Micro')}, * FROM ({with_metrics(f'(SELECT {gsel}{micro_counts} FROM {data} {gby})', with_specificity)})"
    macro = f"SELECT {lab('Macro')}, {gsel}" + ", ".join(f"avg({c}) AS {c}" for c in num_cols) + f" FROM {data} {gby}"
    w = []
    for c in num_cols:
        if c in metrics:
            w.append(f"(coalesce(sum({c} * Support), 0.0) / CAST(NULLIF(sum(Support), 0) AS DOUBLE)) AS {c}")
        elif c in counts or c == "Support":
            w.append(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}")
        else:
            w.append(f"sum({c}) AS {c}")
    weighted = f"SELECT {lab('Weighted')}, {gsel}" + ", ".join(w) + f" FROM {data} {gby}"
    cols = list(label_cols) + list(group_cols) + list(num_cols)
    sel = ", ".join(cols)
    return (f"SELECT {sel} FROM {base} UNION ALL SELECT {sel} FROM ({micro}) UNION ALL "
            f"SELECT {sel} FROM ({macro}) UNION ALL SELECT {sel} FROM ({weighted})")
