"""The report: Markdown from a packet, and the same as HTML."""

from __future__ import annotations

import html


def cell(value: object) -> str:
    """A value in a table's cell: one line, no bars or markup that would end it."""
    if value is None:
        return ""
    text = f"{value:.4g}" if isinstance(value, float) else ", ".join(map(str, value)) if isinstance(value, list) else str(value)
    return text.replace("\\", "\\\\").replace("|", "\\|").replace("\r", " ").replace("\n", " ").replace("<", "&lt;").replace(">", "&gt;")


def code(value: object) -> str:
    """A name as code, whatever backticks are in it."""
    text = cell(value)
    ticks = "`" * (max((len(r) for r in "".join(c if c == "`" else " " for c in text).split()), default=0) + 1)
    pad = " " if text[:1] == "`" or text[-1:] == "`" else ""
    return f"{ticks}{pad}{text}{pad}{ticks}"


def table(rows: list[dict], columns: dict[str, str], most: int) -> list[str]:
    if not rows:
        return ["None.", ""]
    names = ("column", "left", "right")
    out = ["| " + " | ".join(columns.values()) + " |", "|" + " --- |" * len(columns)]
    out += ["| " + " | ".join(code(r.get(k)) if k in names and r.get(k) is not None else cell(r.get(k)) for k in columns) + " |" for r in rows[:most]]
    return [*out, "", f"{len(rows) - most} more are in the packet.", ""] if len(rows) > most else [*out, ""]


def markdown(p: dict) -> str:
    o, gate, resp, shift, risks = p["dataset_overview"], p["quality_checks"], p["response_summary"], p["drift_summary"], p["modeling_risk_summary"]
    same = lambda *names: {n: n.replace("_", " ") for n in names}
    out = [f"# Profile of {cell(o['dataset_name'])}", ""]
    out += ["## Summary", "", f"- Rows: {o['row_count']}, columns: {o['column_count']}", f"- Gate: **{gate['overall_status']}** ({gate['summary']['fail']} fail, {gate['summary']['warn']} warn)", f"- Problem type: {resp['problem_type']}", f"- Risks: {risks['summary']['total']}", ""]
    out += ["## Quality gate", "", *table([c for c in gate["checks"] if c["status"] in ("fail", "warn")], same("check_id", "status", "metric_value", "threshold", "evidence"), 25)]
    out += ["## Alerts", "", *table(p["profile_summary"]["alerts"], same("severity", "category", "column", "issue_type", "evidence"), 25)]
    out += ["## Columns", "", *table([{"column": c["name"]} | c for c in p["column_type_summary"]["columns"]], same("column", "semantic_type", "roles", "missing_percentage", "unique_count", "warnings"), 200)]
    out += ["## Sensitive columns", "", "Redacted: " + (", ".join(code(c) for c in p["profile_summary"]["sensitive_report"]["redacted_columns"]) or "none") + ".", ""]
    out += ["## Missing values", "", *table(sorted(p["missingness_summary"]["columns"], key=lambda r: -r["missing_percentage"]), same("column", "missing_count", "missing_percentage", "blank_string_count", "zero_count"), 20)]
    out += ["## Numbers", "", *table(p["univariate_summary"]["numeric"], same("column", "count", "mean", "median", "std", "min", "max", "skewness", "iqr_outlier_count"), 50)]
    out += ["## Categories", "", *table(p["univariate_summary"]["categorical"], same("column", "unique_count", "rare_category_count", "rare_row_percentage"), 50)]
    out += ["## Texts and times", "", *table(p["profile_summary"]["text_summary"], same("column", "count", "mean_length", "p95_length", "mean_words", "blank_count"), 20), *table(p["profile_summary"]["datetime_summary"], same("column", "median_gap_seconds", "largest_gap_seconds", "inferred_frequency", "monotonic_increasing"), 20)]
    out += ["## Response", ""]
    if not resp["available"]:
        out += [cell(resp.get("reason", "None.")), ""]
    elif resp["problem_type"] == "binary_classification":
        out += [f"Rate of {code(resp['positive_class'])}: {cell(resp['response_rate'])}; larger to smaller class: {cell(resp['imbalance_ratio'])}.", ""]
    out += table(resp["warnings"], same("severity", "issue_type", "evidence"), 10)
    out += ["## Feature ranking", "", *table(p["feature_ranking"], same("rank", "column", "semantic_type", "signal_metric", "signal_value", "quality_penalty", "recommended_review_reason"), 20)]
    out += ["## Leakage", "", *table(p["leakage_warnings"], same("column", "severity", "reason", "evidence"), 25)]
    out += ["## Pairs of columns", "", *table(p["bivariate_summary"]["high_correlation_pairs"], same("left", "right", "correlation"), 20), *table(p["bivariate_summary"]["possible_duplicate_columns"], same("left", "right", "reason"), 20)]
    out += ["## Drift", ""]
    out += table(shift["top_shifted_features"], same("column", "metric", "value", "status"), 25) if shift["available"] else [cell(shift["reason"]), ""]
    out += ["## Comparison of groups", "", *table(p["comparison_summary"].get("column_changes", []), same("column", "metric", "missing_delta", "mean_delta", "change_score"), 15)]
    out += ["## Modelling risks", "", *table(risks["risks"], same("severity", "category", "column", "evidence", "recommended_action"), 15)]
    out += ["## Caveats", "", *[f"- {cell(c)}" for c in p["caveats"]], ""]
    return "\n".join(out)


def as_html(text: str, title: str = "Profile") -> str:
    return f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head>\n<body><pre>{html.escape(text)}</pre></body></html>\n'
