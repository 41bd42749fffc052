"""Rules over collected evidence: warnings, leakage, ranking, risks, gates, alerts. Plain Python on small records.

Each rule is a row of a table: what it is called, how severe it is, what it measures and what to do about it."""

from __future__ import annotations

import re
from collections import Counter

from ..config import ProfileConfig

# What names are suspicious of, and the constants of the rules.
SUSPICIOUS_WORDS = ("target", "outcome", "approved", "declined", "decision", "final", "result", "score", "label", "default", "claim", "lapse", "fraud", "bad", "post_", "after_")
PENALTY = {"high": 0.5, "medium": 0.25, "low": 0.1}
SEVERITY = {"high": 0, "medium": 1, "low": 2}
IMBALANCE, SKEW, MISSING_GAP, MISSING_FAIL, SEPARATION, PENALTY_RISK, UNUSUAL_RATIO, MIN_ROWS = 10.0, 2.0, 0.20, 0.95, 0.95, 0.5, 0.95, 20


def normal_name(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def token(value: object) -> str:
    return re.sub(r"[^0-9a-zA-Z]+", "_", str(value).strip().lower()).strip("_") or "dataset"


def suspicious(name: str) -> bool:
    return any(w in name.lower() for w in SUSPICIOUS_WORDS)


def name_warnings(name: str) -> list[str]:
    found = (("blank_name", not name.strip()), ("edge_whitespace", name != name.strip()), ("unnamed_column", name.strip().lower().startswith("unnamed:")), ("control_whitespace", bool(re.search(r"[\t\r\n]", name))))
    return [w for w, holds in found if holds]


def name_collisions(names: list[str]) -> dict[str, list[str]]:
    """Names that are one name once case and signs are set aside."""
    groups: dict[str, list[str]] = {}
    for n in names:
        groups.setdefault(normal_name(n), []).append(n)
    return {k: sorted(v) for k, v in sorted(groups.items()) if len(v) > 1}


def warning(issue: str, severity: str, column: str | None, metric: str, value, threshold, evidence: str, action: str) -> dict:
    scope = "column" if column else "dataset"
    return {"warning_id": f"{issue}.{token(column or scope)}", "column": column, "scope": scope, "issue_type": issue, "severity": severity, "metric_name": metric, "metric_value": value, "threshold": threshold, "evidence": evidence, "recommended_action": action}


#: Type warning -> issue, severity, metric, threshold (a setting's name or a value), what to do.
_BY_TYPE = {
    "constant": ("constant_column", "medium", "unique_count", "> 1", "Leave the column out, or find out why it never varies."),
    "near_constant": ("near_constant_column", "low", "top_frequency_ratio", "near_constant_threshold", "See whether the rare values mean anything."),
    "high_cardinality": ("high_cardinality", "medium", "unique_count", "high_cardinality_threshold", "Choose an encoding, or group the values."),
    "mostly_unique": ("id_like_candidate", "low", "unique_ratio", "confirm role", "Give the column an id role if it names records."),
    "suspicious_name": ("suspicious_column_name", "medium", "suspicious_name", False, "Make sure that the value is known before the response is."),
}
_PARSE = {"numeric_parse_candidate": "numeric_parse_rate", "datetime_parse_candidate": "datetime_parse_rate", "boolean_parse_candidate": "boolean_parse_rate"}


def quality_warnings(config: ProfileConfig, types: dict, missing: dict, overview: dict) -> list[dict]:
    out = []
    if n := overview["duplicate_row_count"]:
        out.append(warning("duplicate_rows", "medium", None, "duplicate_row_count", n, 0, f"{n} rows repeat an earlier row.", "Find out whether rows were loaded twice."))
    for c, n in overview["duplicate_id_counts"].items():
        if n:
            out.append(warning("duplicate_id_values", "high", c, "duplicate_id_count", n, 0, f"{n} rows repeat a value of the id {c}.", "Settle what one row stands for."))
    for norm, names in types["normalized_name_collisions"].items():
        out.append(warning("normalized_name_collision", "medium", None, "collision", ", ".join(names[:5]), "unique names", f"{len(names)} columns are all named {norm!r} once signs are set aside.", "Rename them."))
    by_missing = {r["column"]: r for r in missing["columns"]}
    for p in types["columns"]:
        c, m = p["name"], by_missing[p["name"]]
        for issue, rate in _PARSE.items():
            if issue in p["schema_warnings"]:
                out.append(warning(issue, "low", c, rate, p[rate], "candidate rate", f"{p[rate]:.1%} of the texts read as another type.", "Convert the column if that is what it holds."))
        gone = m["missing_percentage"]
        if p["semantic_type"] == "all_missing":
            out.append(warning("all_missing", "high", c, "non_null_count", 0, "> 0", "No value is there.", "Leave the column out, or mend its source."))
        elif gone >= config.high_missingness_threshold:
            out.append(warning("high_missingness", "medium", c, "missing_percentage", gone, config.high_missingness_threshold, f"{gone:.1%} of the values are missing.", "Find out why before filling in or leaving out."))
        for tag in p["warnings"]:
            if tag in _BY_TYPE:
                issue, severity, metric, threshold, action = _BY_TYPE[tag]
                limit = getattr(config, threshold) if isinstance(threshold, str) and hasattr(config, threshold) else threshold
                value = p.get(metric)
                out.append(warning(issue, severity, c, metric, value, limit, f"{metric} of {c} is {value}.", action))
        if n := m["blank_string_count"]:
            out.append(warning("blank_strings", "low", c, "blank_string_count", n, 0, f"{n} texts are blank.", "Make blanks missing values, if they are."))
        if n := sum(m["special_missing_code_counts"].values()):
            out.append(warning("special_missing_codes", "low", c, "special_missing_code_count", n, 0, f"{n} values look like codes for a missing one.", "Confirm the codes and make them missing."))
    return out


def leakage_warnings(config: ProfileConfig, types: dict, response: dict) -> list[dict]:
    out = []

    def add(column, reason, severity, evidence):
        out.append({"column": column, "reason": reason, "severity": severity, "evidence": evidence, "recommended_next_step": "Find out when the value comes to be known."})

    for p in types["columns"]:
        if p["name"] != config.response_column and p["suspicious_name"]:
            add(p["name"], "suspicious_name", "medium", f"The name {p['name']!r} speaks of the response or of what follows it.")
    if response.get("problem_type") == "binary_classification":
        for r in response.get("feature_relationships", []):
            auc, spread = r.get("auc_abs"), r.get("response_rate_spread")
            if auc is not None and auc >= config.high_auc_leakage_threshold:
                add(r["column"], "high_auc", "high", f"The column alone ranks the classes with an AUC of {auc:.3f}.")
            elif spread is not None and spread >= SEPARATION:
                add(r["column"], "near_perfect_separation", "high", f"Response rates of its groups are {spread:.3f} apart.")
    return out


def signal(response: dict, relation: dict) -> tuple[str | None, float | None, float | None]:
    """Metric, value, and score from 0 to 1 of a column's strongest measured relation."""
    if not relation or not response.get("available"):
        return None, None, None
    if response["problem_type"] == "binary_classification":
        order = (("auc_abs", lambda v: 2 * abs(v - 0.5)), ("cramers_v", float), ("response_rate_spread", float))
    elif response["problem_type"] == "regression":
        order = (("correlation", abs), ("target_mean_spread", float))
    else:
        order = ()
    for metric, score in order:
        if (v := relation.get(metric)) is not None:
            v = abs(v) if metric == "correlation" else v
            return ("correlation_abs" if metric == "correlation" else metric), v, score(v)
    return None, None, None


def feature_ranking(config: ProfileConfig, types: dict, missing: dict, response: dict, quality: list[dict], leakage: list[dict]) -> list[dict]:
    """Candidate predictors: those with leakage first, then by score, then by the smaller penalty, then in table order."""
    relations = {r["column"]: r for r in response.get("feature_relationships", [])}
    gone = {r["column"]: r["missing_percentage"] for r in missing["columns"]}
    rows = []
    for p in types["columns"]:
        c = p["name"]
        if c in config.excluded():
            continue
        rel = relations.get(c, {})
        metric, value, score = signal(response, rel)
        q, leak = [w for w in quality if w["column"] == c], [w for w in leakage if w["column"] == c]
        reason = "It may give the response away." if leak else "Its quality warnings come first." if q else f"{metric} with the response can be measured." if metric else "Only if it matters to the question."
        rows.append({
            "column": c, "semantic_type": p["semantic_type"], "missing_percentage": gone[c], "unique_count": p["unique_count"], "signal_metric": metric, "signal_value": value, "signal_score": score,
            "signal_direction": rel.get("signal_direction"), "quality_penalty": min(1.0, sum(PENALTY.get(w["severity"], 0.1) for w in [*q, *leak])), "recommended_review_reason": reason,
            "response_rate_spread": rel.get("response_rate_spread"), "auc": rel.get("auc"), "auc_abs": rel.get("auc_abs"), "chi_square_p_value": rel.get("chi_square_p_value"),
            "data_quality_warnings": [w["issue_type"] for w in q], "leakage_warnings": [w["reason"] for w in leak],
        })
    rows.sort(key=lambda r: (not r["leakage_warnings"], -(r["signal_score"] if r["signal_score"] is not None else -1.0), r["quality_penalty"]))
    for n, r in enumerate(rows, 1):
        r["rank"] = n
    return rows


#: Quality issue -> category of modelling risk.
_RISK_OF = {
    "high_cardinality": "cardinality", "id_like_candidate": "identifier", "high_missingness": "missingness", "all_missing": "missingness", "near_constant_column": "sparsity", "constant_column": "sparsity",
    "normalized_name_collision": "schema", "numeric_parse_candidate": "schema", "datetime_parse_candidate": "schema", "boolean_parse_candidate": "schema",
}


def deduplicated(risks: list[dict]) -> list[dict]:
    """Of each id the most severe, the first of equals; in order of first appearance."""
    best: dict[str, dict] = {}
    for r in risks:
        if r["risk_id"] not in best or SEVERITY.get(r["severity"], 3) < SEVERITY.get(best[r["risk_id"]]["severity"], 3):
            best[r["risk_id"]] = r
    return list(best.values())


def modeling_risks(config: ProfileConfig, types: dict, missing: dict, pairs: dict, ranking: list[dict], quality: list[dict], leakage: list[dict], drift: dict, response: dict) -> dict:
    risks = []

    def add(risk_id, category, severity, column, evidence, action, source, metric, value, threshold, related=None):
        risks.append({"risk_id": risk_id, "category": category, "severity": severity, "column": column, "related_column": related, "evidence": evidence, "recommended_action": action, "source": source, "metric_name": metric, "metric_value": value, "threshold": threshold})

    for w in leakage:
        add(f"leakage.{w['column']}.{token(w['reason'])}", "leakage", w["severity"], w["column"], w["evidence"], w["recommended_next_step"], "leakage_warnings", w["reason"], w["column"], "no high-severity leakage")
    for w in quality:
        if category := _RISK_OF.get(w["issue_type"]):
            add(f"{category}.{w['warning_id']}", category, w["severity"], w["column"], w["evidence"], w["recommended_action"], "data_quality_warnings", w["metric_name"], w["metric_value"], w["threshold"])
    for p in types["columns"]:
        if p["name"] in config.excluded():
            continue
        if p["semantic_type"] == "categorical_high_cardinality":
            add(f"cardinality.{token(p['name'])}", "cardinality", "medium", p["name"], f"It has {p['unique_count']} values.", "Choose an encoding that won't memorise rows.", "column_type_summary", "unique_count", p["unique_count"], config.high_cardinality_threshold)
        if p["semantic_type"] in ("constant", "near_constant"):
            add(f"sparsity.{token(p['name'])}", "sparsity", "medium" if p["semantic_type"] == "constant" else "low", p["name"], f"Its type is {p['semantic_type']}.", "Leave it out, or say why it stays.", "column_type_summary", "top_frequency_ratio", p["top_frequency_ratio"], config.near_constant_threshold)
    for r in missing.get("missingness_by_response", []):
        gap = r["response_rate_gap"]
        if gap is not None and abs(gap) >= MISSING_GAP:
            add(f"missingness_response.{token(r['column'])}", "missingness", "medium", r["column"], f"Response rates with and without the value are {gap:.3f} apart.", "See whether being missing tells of the response.", "missingness_summary.missingness_by_response", "response_rate_gap", gap, MISSING_GAP)
    for p in pairs.get("high_correlation_pairs", []):
        v = abs(p["correlation"])
        add(f"correlation.{token(p['left'])}.{token(p['right'])}", "correlation", "medium", p["left"], f"Correlation is {v:.3f} in size.", "Keep one of them, or check stability with both.", "bivariate_summary.high_correlation_pairs", "abs_correlation", v, config.high_correlation_threshold, p["right"])
    for p in pairs.get("possible_duplicate_columns", []):
        add(f"duplicate_column.{token(p['left'])}.{token(p['right'])}", "duplicate_column", "medium", p["left"], p["reason"], "Keep one of them.", "bivariate_summary.possible_duplicate_columns", "duplicate_column_pair", True, False, p["right"])
    for r in drift.get("top_shifted_features", []) if drift.get("available") else []:
        if r["status"] != "pass":
            add(f"drift.{token(r['column'])}.{token(r['metric'])}", "drift", "high" if r["status"] == "fail" else "medium", r["column"], f"{r['metric']} is {r['value']:.3f}.", "Compare where the two groups come from.", "drift_summary.top_shifted_features", r["metric"], abs(r["value"]), drift["fail_threshold" if r["status"] == "fail" else "warning_threshold"])
    for w in response.get("warnings", []):
        if w["issue_type"] != "positive_class_auto_selected":
            add(f"response.{token(w['issue_type'])}", "response", w["severity"], w["column"], w["evidence"], w["recommended_action"], "response_summary.warnings", w["metric_name"], w["metric_value"], w["threshold"])
    for r in ranking[:10]:
        if r["quality_penalty"] >= PENALTY_RISK and r["signal_score"] is not None:
            add(f"ranked_feature_quality.{token(r['column'])}", "ranked_feature_quality", "medium", r["column"], f"A top column with a penalty of {r['quality_penalty']:.2f}.", "Mend its quality before trusting its signal.", "feature_ranking", "quality_penalty", r["quality_penalty"], PENALTY_RISK)
    risks = sorted(deduplicated(risks), key=lambda r: SEVERITY.get(r["severity"], 3))
    by = lambda k: dict(sorted(Counter(r[k] for r in risks).items()))
    status = "fail" if any(r["severity"] == "high" for r in risks) else "warn" if risks else "pass"
    return {"available": True, "overall_status": status, "summary": {"total": len(risks), "by_severity": by("severity"), "by_category": by("category")}, "risks": risks, "caveat": "Signals for review; they approve or reject nothing."}


def quality_gate(config: ProfileConfig, overview: dict, response: dict, missing: dict, pairs: dict, quality: list[dict], leakage: list[dict], drift: dict, risks: dict) -> dict:
    checks = []

    def add(check_id, name, status, severity, metric, value, threshold, evidence, action=None):
        checks.append({"check_id": check_id, "name": name, "status": status, "severity": severity, "metric_name": metric, "metric_value": value, "threshold": threshold, "evidence": evidence, "recommended_action": action})

    level = lambda severity: "fail" if severity == "high" else "warn"
    add("dataset.non_empty", "There are rows and columns", "pass", "high", "shape", f"{overview['row_count']}x{overview['column_count']}", "rows > 0 and columns > 0", "Checked before profiling.")
    for w in response.get("warnings", []):
        add(f"response.{w['warning_id']}", f"Response: {w['issue_type']}", "pass" if w["issue_type"] == "positive_class_auto_selected" else level(w["severity"]), w["severity"], w["metric_name"], w["metric_value"], w["threshold"], w["evidence"], w["recommended_action"])
    for w in quality:
        add(f"quality.{w['warning_id']}.{w['column'] or w['scope']}", f"Data quality: {w['issue_type']}", level(w["severity"]), w["severity"], w["metric_name"], w["metric_value"], w["threshold"], w["evidence"], w["recommended_action"])
    for w in leakage:
        add(f"leakage.{w['column']}", "Possible leakage", level(w["severity"]), w["severity"], w["reason"], w["column"], "no high-severity leakage", w["evidence"], w["recommended_next_step"])
    high = [r for r in missing["columns"] if r["missing_percentage"] >= config.high_missingness_threshold]
    for r in high:
        v = r["missing_percentage"]
        add(f"missingness.high.{r['column']}", "Missing share under the limit", "fail" if v >= MISSING_FAIL else "warn", "high" if v >= MISSING_FAIL else "medium", "missing_percentage", v, config.high_missingness_threshold, f"{v:.1%} of {r['column']} is missing.", "Find out why.")
    if not high:
        add("missingness.high_columns", "No column misses much", "pass", "medium", "missing_percentage", 0, config.high_missingness_threshold, "Every column is under the limit.")
    for p in pairs.get("high_correlation_pairs", []):
        add(f"correlation.high.{p['left']}.{p['right']}", "Columns that go together", "warn", "medium", "abs_correlation", abs(p["correlation"]), config.high_correlation_threshold, f"{p['left']} and {p['right']}: {p['correlation']:.3f}.", "Review before using both.")
    if not pairs.get("high_correlation_pairs"):
        add("correlation.high_pairs", "No columns go together", "pass", "medium", "abs_correlation", 0, config.high_correlation_threshold, "Every pair is under the limit.")
    if not drift.get("available"):
        add("drift.available", "Two groups to compare", "not_applicable", "low", "comparison_groups", 0, "a split or segment column", drift.get("reason", ""))
    else:
        shifted = drift["top_shifted_features"]
        for r in shifted:
            if r["status"] != "pass":
                fail = r["status"] == "fail"
                add(f"drift.{r['metric']}.{r['column']}", "Shift under the limit", r["status"], "high" if fail else "medium", r["metric"], abs(r["value"]), config.drift_fail_threshold if fail else config.drift_warning_threshold, f"{r['column']} shifts by {abs(r['value']):.3f}.", "Compare where the two groups come from.")
        if all(r["status"] == "pass" for r in shifted):
            add("drift.thresholds", "No column shifts", "pass", "medium", "max_abs_drift", max((abs(r["value"]) for r in shifted), default=0.0), config.drift_warning_threshold, "Every column is under the limit.")
        if drift["ignored_groups"]:
            add("drift.ignored_groups", "Groups left out of the comparison", "warn", "medium", "ignored_group_count", len(drift["ignored_groups"]), 0, f"Compared {drift['baseline_group']} with {drift['comparison_group']} only.", "See whether the others need a comparison of their own.")
    for r in risks["risks"]:
        add(f"modeling_risk.{r['risk_id']}", f"Modelling risk: {r['category']}", level(r["severity"]), r["severity"], r["metric_name"], r["metric_value"], r["threshold"], r["evidence"], r["recommended_action"])
    if not risks["risks"]:
        add("modeling_risk.review_queue", "No modelling risks", "pass", "medium", "modeling_risk_count", 0, 0, "No rule found one.")
    n = Counter(c["status"] for c in checks)
    summary = {s: n.get(s, 0) for s in ("pass", "warn", "fail", "not_applicable")} | {"total": len(checks)}
    return {"overall_status": "fail" if n["fail"] else "warn" if n["warn"] else "pass", "summary": summary, "checks": checks}


def category_of(issue: str) -> str:
    for words, category in ((("missing", "blank"), "missingness"), (("duplicate",), "duplicates"), (("constant", "cardinality"), "distribution"), (("name", "id"), "schema")):
        if any(w in issue for w in words):
            return category
    return "data_quality"


def alerts(missing: dict, pairs: dict, quality: list[dict], leakage: list[dict]) -> list[dict]:
    """One list of what needs a look, the most severe first. High missingness is told by two sources."""
    out = []

    def add(source, category, severity, scope, column, issue, evidence, action, **more):
        out.append({"source": source, "category": category, "severity": severity, "scope": scope, "column": column, "issue_type": issue, "evidence": evidence, "recommended_action": action} | more)

    for w in quality:
        add("data_quality", category_of(w["issue_type"]), w["severity"], w["scope"], w["column"], w["issue_type"], w["evidence"], w["recommended_action"])
    for w in leakage:
        add("leakage", "leakage", w["severity"], "column", w["column"], w["reason"], w["evidence"], w["recommended_next_step"])
    for p in pairs.get("high_correlation_pairs", []):
        add("bivariate", "correlation", "medium", "pair", p["left"], "high_correlation", f"Correlation is {abs(p['correlation']):.3f} in size.", "See whether both are needed.", related_column=p["right"])
    for r in missing["high_missingness_columns"]:
        add("missingness", "missingness", "medium", "column", r["column"], "high_missingness", f"{r['missing_percentage']:.1%} of the values are missing.", "Find out why.")
    return sorted(out, key=lambda a: SEVERITY.get(a["severity"], 3))


def alert_summary(found: list[dict]) -> dict:
    by = lambda k: dict(sorted(Counter(a[k] for a in found).items()))
    return {"total": len(found), "by_severity": by("severity"), "by_category": by("category"), "top_alerts": found[:10]}
