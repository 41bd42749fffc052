"""One run: a table and a configuration in, an evidence packet, a report and (if asked for) a folder of files out.

All statistics are DataFrame aggregations, shared by columns; what is collected is a row for each column, category shown or
bin. Rules, ranking and texts then work on these rows on the driver."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ProfileConfig, check
from ..functions import columns as C
from ..functions import ranks, special
from ..functions.jsonable import jsonable, records
from ..operators import bivariate, drift, missingness, response, text_time, typing, univariate
from ..sources import tables
from . import artifacts, evidence, report, rules, shared_runs

ORDER = "__order"
TOOL = {"tool_name": "quarrylens", "tool_version": "0.1.0"}


@dataclass
class Result:
    packet: dict
    markdown: str
    folder: Path | str | None = None


def _by_column(df: DataFrame) -> dict[str, dict]:
    return {r["column"]: r for r in records(df)}


def type_summary(df: DataFrame, ordered: DataFrame, config: ProfileConfig, gone: dict[str, dict], counts: DataFrame) -> dict:
    """A profile of each column, and counts of what was found."""
    texts = C.text_columns(df)
    dates = typing.semantic_types(ordered.select(*[C.name(c) for c in df.columns], ORDER), config.near_constant_threshold, config.high_cardinality_threshold, config.date_columns, F.col(ORDER), counts)
    kinds = _by_column(dates.where(F.col("column") != ORDER))
    rates = _by_column(typing.parse_rates(df, texts)) if texts else {}
    samples = {c: [] for c in df.columns}
    firsts = ordered.orderBy(ORDER).limit(typing.DATE_SAMPLE).drop(ORDER).collect()
    for c in df.columns:
        for r in firsts:
            if r[c] is not None and r[c] not in samples[c] and len(samples[c]) < 5:
                samples[c].append(r[c])
    roles_of = config.role_columns() | {"excluded": config.exclude_columns}
    profiles = []
    for f in df.schema.fields:
        c, k, m = f.name, kinds[f.name], gone[f.name]
        n, u, ratio = k["non_null_count"], k["unique_count"], k["unique_ratio"] or 0.0
        total = n + m["missing_count"]
        idlike = typing.id_hint(c) or (ratio >= rules.UNUSUAL_RATIO and total >= rules.MIN_ROWS and u >= max(20, 0.8 * total))
        roles = [r for r, names in roles_of.items() if c in names]
        if idlike and "id" not in roles and c != config.response_column:
            roles.append("id_candidate")
        rate = rates.get(c, {})
        kind = k["semantic_type"]
        candidate = {
            "boolean_parse_candidate": (rate.get("boolean_parse_rate") or 0) == 1.0 and kind not in ("boolean", "all_missing"),
            "numeric_parse_candidate": (rate.get("numeric_parse_rate") or 0) >= typing.NUMBER_RATE and kind not in ("boolean", "all_missing"),
            "datetime_parse_candidate": (rate.get("datetime_parse_rate") or 0) >= typing.DATE_RATE,
        }
        top = k["top_frequency_ratio"]
        tags = {
            "all_missing": kind == "all_missing", "high_missingness": m["missing_percentage"] >= config.high_missingness_threshold, "constant": kind == "constant", "near_constant": kind == "near_constant",
            "high_cardinality": kind == "categorical_high_cardinality", "mostly_unique": ratio >= rules.UNUSUAL_RATIO and total >= rules.MIN_ROWS and "id" not in roles, "dominant_single_value": top is not None and top >= config.near_constant_threshold,
            "suspicious_name": rules.suspicious(c) and c != config.response_column, "very_high_cardinality": kind == "categorical_high_cardinality" and u > 5 * config.high_cardinality_threshold,
        }
        names = rules.name_warnings(c)
        profiles.append({
            "name": c, "normalized_name": rules.normal_name(c), "source_dtype": f.dataType.simpleString(), "semantic_type": kind, "roles": roles, "warnings": [t for t, on in tags.items() if on],
            "schema_warnings": names + [t for t, on in candidate.items() if on], "name_warnings": names, "non_null_count": n, "missing_count": m["missing_count"], "missing_percentage": m["missing_percentage"],
            "unique_count": u, "unique_ratio": ratio, "top_frequency_ratio": top, "numeric_parse_rate": rate.get("numeric_parse_rate"), "datetime_parse_rate": rate.get("datetime_parse_rate"),
            "boolean_parse_rate": rate.get("boolean_parse_rate"), "suspicious_name": rules.suspicious(c), "sample_values": jsonable(samples[c]), "type_counts": {f.dataType.simpleString(): n},
        })
    count = lambda values: dict(sorted(Counter(values).items()))
    having = lambda w: [p["name"] for p in profiles if w in p["schema_warnings"]]
    return {
        "columns": profiles, "normalized_name_collisions": rules.name_collisions(df.columns),
        "summary": {
            "semantic_type_counts": count(p["semantic_type"] for p in profiles), "role_counts": count(r for p in profiles for r in p["roles"]), "schema_warning_counts": count(w for p in profiles for w in p["schema_warnings"]),
            "name_warning_counts": count(w for p in profiles for w in p["name_warnings"]), "suspicious_name_columns": [p["name"] for p in profiles if p["suspicious_name"]],
            "numeric_parse_candidates": having("numeric_parse_candidate"), "datetime_parse_candidates": having("datetime_parse_candidate"), "boolean_parse_candidates": having("boolean_parse_candidate"),
        },
    }


def redacted_columns(types: dict, config: ProfileConfig) -> list[str]:
    return sorted(p["name"] for p in types["columns"] if {"sensitive", "id", "id_candidate"} & set(p["roles"]) or p["name"] in (*config.sensitive_columns, *config.id_columns))


def redacted(df: DataFrame, columns: list[str], policy: str) -> DataFrame:
    """Hides what is there in some columns; nothing under preview, everything under none."""
    if policy == "none":
        return df.limit(0)
    return df.select([F.when(C.name(c).isNotNull(), F.lit("<REDACTED>")).alias(c) if c in columns and policy == "redacted" else C.name(c) for c in df.columns])


def overview(df: DataFrame, ordered: DataFrame, config: ProfileConfig, types: dict, size: int | None) -> dict:
    dup = records(missingness.duplicate_rows(df))[0]
    ids = {r["column"]: r["duplicate_values"] for r in records(missingness.duplicate_ids(df, config.id_columns))} if config.id_columns else {}
    hidden = redacted_columns(types, config)
    rows = records(redacted(ordered.orderBy(ORDER).limit(5).drop(ORDER), hidden, config.sample_policy))
    for p in types["columns"]:
        if config.sample_policy == "none":
            p["sample_values"] = []
        elif config.sample_policy == "redacted" and p["name"] in hidden:
            p["sample_values"] = ["<REDACTED>"] if p["sample_values"] else []
    dictionary = [{k: p[k] for k in ("name", "normalized_name", "source_dtype", "semantic_type", "roles", "non_null_count", "missing_count", "missing_percentage", "unique_count", "unique_ratio", "top_frequency_ratio", "warnings", "schema_warnings", "name_warnings", "sample_values")} for p in types["columns"]]
    return {"dataset_name": config.dataset_name, "row_count": dup["rows"], "column_count": len(df.columns), "memory_usage_bytes": size, "memory_usage_is_estimate": True, "duplicate_row_count": dup["duplicate_rows"], "duplicate_row_percentage": dup["duplicate_percentage"], "duplicate_id_counts": ids, "type_summary": types["summary"], "sample_policy": config.sample_policy, "sample_rows": rows, "data_dictionary": dictionary}


def missing_summary(df: DataFrame, config: ProfileConfig, gone: dict[str, dict], y: F.Column | None) -> dict:
    codes: dict[str, dict] = {c: {} for c in df.columns}
    for r in records(missingness.special_missing_codes(df)):
        codes[r["column"]][r["code"]] = r["n"]
    rows = [gone[c] | {"special_missing_code_counts": dict(sorted(codes[c].items()))} for c in df.columns]
    lost = [c for c in df.columns if gone[c]["missing_count"]]
    out = {"columns": rows, "row_summary": records(missingness.row_missingness(df))[0], "high_missingness_columns": [{"column": r["column"], "missing_percentage": r["missing_percentage"]} for r in rows if r["missing_percentage"] >= config.high_missingness_threshold]}
    out["missing_flag_correlation"] = records(bivariate.missing_flags(df, lost)) if len(lost) > 1 else []
    others = [c for c in df.columns if c != config.response_column]
    out["missingness_by_response"] = records(missingness.missing_by_response(df, y, others)) if y is not None else []
    out["missingness_by_segment"] = [{"segment_column": s} | r for s in config.segment_columns for r in records(missingness.missing_by_segment(df, s, df.columns))]
    return out


#: Inputs of up to so many bytes, by the plan's estimate, are cached.
CACHED_BYTES = 2 << 30
_NUMERIC = ("numeric_continuous", "numeric_discrete", "binary")


def univariate_summary(df: DataFrame, config: ProfileConfig, types: dict, counts: DataFrame) -> dict:
    kinds = {p["name"]: p["semantic_type"] for p in types["columns"]}
    numbers = [c for c in C.numeric_columns(df) if kinds[c] not in ("all_missing",)]
    times = [c for c in C.time_columns(df)]
    rest = [c for c in df.columns if c not in numbers and c not in times]
    shown: dict[str, list] = {c: [] for c in rest}
    for r in records(univariate.categorical_summary(df, rest, config.max_categories, counts).orderBy("column", "rank")) if rest else []:
        shown[r["column"]].append({"value": r["value"], "count": r["n"], "percentage": r["percentage"]})
    rare = _by_column(univariate.rare_categories(df, rest, config.rare_category_threshold, counts)) if rest else {}
    categories = [rare[c] | {"top_values": shown[c], "high_cardinality": rare[c]["unique_count"] > config.high_cardinality_threshold} for c in rest if c in rare]
    return {"numeric": records(univariate.numeric_summary(df, numbers, counts)) if numbers else [], "categorical": categories, "datetime": records(univariate.datetime_summary(df, times)) if times else []}


def _response_warning(config: ProfileConfig, issue: str, severity: str, metric: str, value, threshold, text: str, action: str) -> dict:
    return rules.warning(issue, severity, config.response_column, metric, value, threshold, text, action)


def problem_type(df: DataFrame, config: ProfileConfig, types: dict) -> str:
    if config.problem_type != "auto":
        return config.problem_type
    p = next((p for p in types["columns"] if p["name"] == config.response_column), None)
    if p is None or not p["non_null_count"]:
        return "unsupervised"
    if p["unique_count"] == 2:
        return "binary_classification"
    number = config.response_column in C.numeric_columns(df) or (p["numeric_parse_rate"] or 0) >= typing.NUMBER_RATE
    return "regression" if number and p["unique_count"] > 10 else "multiclass_classification"


def _rates(df: DataFrame, config: ProfileConfig, y: F.Column, columns: list[str], counts: DataFrame, binary: bool) -> tuple[dict[str, list], dict[str, dict]]:
    """Of all columns: the categories' mean responses, and what is rare."""
    rates: dict[str, list] = {c: [] for c in columns}
    for r in records(response.all_category_rates(df, columns, y, config.max_categories, counts if binary else None).orderBy("column", "place")) if columns else []:
        rates[r["column"]].append({k: r[k] for k in ("category", "n", "mean_response")})
    return rates, _by_column(univariate.rare_categories(df, columns, config.rare_category_threshold, counts)) if columns else {}


def binary_summary(df: DataFrame, config: ProfileConfig, types: dict, y: F.Column | None, positive: str | None, classes: list[str], counts: DataFrame) -> dict:
    name = config.response_column
    table = records(response.class_table(df, name, positive).orderBy("class"))
    out = {"problem_type": "binary_classification", "available": y is not None, "response_column": name, "classes": classes, "positive_class": positive, "class_counts": {r["class"]: r["n"] for r in table}, "class_table": table, "warnings": [], "feature_relationships": []}
    gone = out["class_counts"].get(C.MISSING, 0)
    if gone:
        out["warnings"].append(_response_warning(config, "missing_response_values", "high", "missing_response_count", gone, 0, f"{gone} rows have no response.", "Settle what to do with them."))
    if y is None:
        out["reason"] = "The response needs two classes."
        out["warnings"].append(_response_warning(config, "unusable_binary_response", "high", "class_count", len(classes), 2, out["reason"], "Choose another response or problem type."))
        return out
    out |= records(response.imbalance(df, y))[0]
    out["warnings"].append(_response_warning(config, "positive_class_auto_selected", "low", "positive_class", positive, "confirm", f"{positive!r} was taken as the positive class.", "Confirm it."))
    if (out["imbalance_ratio"] or 0) >= rules.IMBALANCE:
        out["warnings"].append(_response_warning(config, "severe_class_imbalance", "high", "imbalance_ratio", out["imbalance_ratio"], rules.IMBALANCE, f"One class is {out['imbalance_ratio']:.1f} times the other.", "Choose measures that bear it."))
    kinds = {p["name"]: p["semantic_type"] for p in types["columns"]}
    features = [c for c in df.columns if c not in config.excluded()]
    numbers = [c for c in features if c in C.numeric_columns(df) and kinds[c] in _NUMERIC]
    found = []
    if numbers:
        rel = _by_column(response.numeric_relationships(df, y, numbers, counts))
        bins = response.quantile_bins(df, y, numbers, counts=counts)
        trend = _by_column(response.bin_trend(bins))
        by_bin: dict[str, list] = {c: [] for c in numbers}
        for r in records(bins.orderBy("column", "bin")):
            by_bin[r["column"]].append({"low": r["low"], "high": r["high"], "count": r["n"], "response_rate": r["response_rate"], "label": f"({r['low']:.6g}, {r['high']:.6g}]"})
        t = _by_column(response.welch_t(df, y, numbers))
        lost = _by_column(missingness.missing_by_response(df, y, numbers))
        for c in numbers:
            r = rel.get(c, {})
            measured = r.get("auc") is not None
            s, tr = r.get("spearman"), trend.get(c, {}) if measured else {}
            direction = "none" if s is None or abs(s) < 1e-12 else "positive" if s > 0 else "negative"
            found.append({
                "column": c, "relationship_type": "numeric", "n": r.get("n", 0), "auc": r.get("auc"), "auc_abs": r.get("auc_abs"), "spearman": s, "signal_direction": direction, "response_rate_spread": tr.get("response_rate_spread"),
                "bins": by_bin[c] if measured else [], "bottom_bin_rate": tr.get("bottom_bin_rate"), "top_bin_rate": tr.get("top_bin_rate"), "monotonic": tr.get("monotonic"), "trend": tr.get("trend"),
                "response_rate_missing": lost[c]["response_rate_missing"], "response_rate_present": lost[c]["response_rate_present"], "missing_gap": lost[c]["response_rate_gap"],
                "t_test_p_value": special.t_p(t[c]["t"], t[c]["degrees"]) if measured else None,
                "mann_whitney_p_value": special.mann_whitney_p(r.get("mann_whitney_u"), r.get("positives", 0), r.get("negatives", 0), r.get("tie_sum", 0.0)) if measured else None,
                "notes": [] if measured else ["Too few pairs, values or classes."],
            })
    rates_of, rest = _rates(df, config, y, [c for c in features if c not in numbers], counts, True)
    chis = _by_column(response.chi_squares(df, list(rest), name, counts)) if rest else {}
    for c in rest:
        rates, chi = rates_of[c], chis.get(c, {})
        means = [r["mean_response"] for r in rates]
        found.append({
            "column": c, "relationship_type": "categorical", "n": chi.get("n") or 0, "unique_count": next(p["unique_count"] for p in types["columns"] if p["name"] == c), "response_rate_spread": max(means) - min(means) if means else None,
            "chi_square": chi.get("chi_square"), "chi_square_p_value": special.chi_square_p(chi.get("chi_square"), chi.get("degrees") or 0), "cramers_v": chi.get("cramers_v"), "category_rates": rates, "top_risky": rates[:5],
            "rare_categories": rest[c],
        })
    order = {c: i for i, c in enumerate(df.columns)}
    out["feature_relationships"] = sorted(found, key=lambda r: order[r["column"]])
    return out


def regression_summary(df: DataFrame, config: ProfileConfig, types: dict, counts: DataFrame) -> dict:
    name = config.response_column
    text = name in C.text_columns(df)
    y = C.parsed_number(C.name(name)) if text else C.as_number(df, name)
    s = records(response.regression_target(df, name))[0]
    out = {"problem_type": "regression", "available": True, "response_column": name, "target_summary": s, "warnings": [], "feature_relationships": []}
    add = lambda *a: out["warnings"].append(_response_warning(config, *a))
    if s["missing_count"] - s["parse_failure_count"]:
        add("missing_response_values", "high", "missing_response_count", s["missing_count"] - s["parse_failure_count"], 0, f"{s['missing_count'] - s['parse_failure_count']} rows have no response.", "Settle what to do with them.")
    if text and config.problem_type == "auto":
        add("numeric_string_response_inferred_as_regression", "medium", "numeric_parse_rate", next(p["numeric_parse_rate"] for p in types["columns"] if p["name"] == name), typing.NUMBER_RATE, "The response is text that reads as numbers.", "Convert it.")
    if s["parse_failure_count"]:
        add("unparseable_regression_response_values", "medium", "parse_failure_count", s["parse_failure_count"], 0, f"{s['parse_failure_count']} responses are no numbers.", "Mend or leave them out.")
    if (s["count"] or 0) < 3:
        out |= {"available": False, "reason": "The response has fewer than three numbers."}
        add("unusable_regression_response", "high", "count", s["count"], 3, out["reason"], "Choose another response or problem type.")
        return out
    if s["zero_variance"]:
        add("zero_variance_regression_response", "high", "std", 0.0, "> 0", "The response never varies.", "Choose another response.")
    if s["iqr_outlier_count"]:
        add("regression_response_outliers", "medium", "iqr_outlier_count", s["iqr_outlier_count"], 0, f"{s['iqr_outlier_count']} responses are far out.", "Look at them before fitting.")
    if abs(s["skewness"] or 0) >= rules.SKEW:
        add("skewed_regression_response", "medium", "skewness", s["skewness"], rules.SKEW, f"Skewness is {s['skewness']:.2f}.", "Think of a transformation.")
    kinds = {p["name"]: p["semantic_type"] for p in types["columns"]}
    features = [c for c in df.columns if c not in config.excluded()]
    numbers = [c for c in features if c in C.numeric_columns(df) and kinds[c] in _NUMERIC]
    found = {}
    for c, r in (_by_column(response.regression_correlations(df, y, numbers)) if numbers else {}).items():
        found[c] = {"column": c, "relationship_type": "numeric", "n": r["n"], "correlation": r["pearson"], "pearson": r["pearson"], "spearman": r["spearman"], "signal_direction": r["direction"]}
    rates_of, rest = _rates(df, config, y, [c for c in features if c not in found], counts, False)
    for c in rest:
        means = rates_of[c]
        values = [r["mean_response"] for r in means]
        found[c] = {"column": c, "relationship_type": "categorical", "n": sum(r["n"] for r in means), "unique_count": next(p["unique_count"] for p in types["columns"] if p["name"] == c), "target_mean_spread": max(values) - min(values) if len(values) > 1 else None, "category_means": means, "top_by_target_mean": means[:5], "rare_categories": rest[c]}
    out["feature_relationships"] = [found[c] for c in features]
    return out


def response_summary(df: DataFrame, config: ProfileConfig, types: dict, kind: str, y, positive, classes, counts: DataFrame) -> dict:
    if kind == "unsupervised" or not config.response_column:
        return {"problem_type": "unsupervised", "available": False, "response_column": config.response_column, "reason": "No usable response column.", "warnings": [], "feature_relationships": []}
    if kind == "binary_classification":
        return binary_summary(df, config, types, y, positive, classes, counts)
    if kind == "regression":
        return regression_summary(df, config, types, counts)
    table = records(response.class_table(df, config.response_column).orderBy(F.desc("n"), "class").limit(config.max_categories))
    return {"problem_type": kind, "available": True, "response_column": config.response_column, "class_counts": {r["class"]: r["n"] for r in table}, "class_percentages": {r["class"]: r["percentage"] for r in table}, "warnings": [], "feature_relationships": []}


def pair_summary(df: DataFrame, config: ProfileConfig) -> dict:
    columns = [c for c in C.numeric_columns(df, booleans=True) if c not in config.excluded()]
    matrix = records(bivariate.matrix(df, columns[: config.max_correlation_columns])) if len(columns) > 1 else []
    high = sorted((p for p in matrix if p["correlation"] is not None and abs(p["correlation"]) >= config.high_correlation_threshold), key=lambda p: -abs(p["correlation"]))
    same = records(bivariate.duplicate_columns(df, columns)) if len(columns) > 1 else []
    return {"numeric_correlation_matrix": matrix, "high_correlation_pairs": high, "possible_duplicate_columns": [p | {"reason": "Every value is the same."} for p in same], "correlation_columns_left_out": columns[config.max_correlation_columns :], "comparison_columns_left_out": []}


def group_summaries(df: DataFrame, config: ProfileConfig, types: dict) -> tuple[dict, dict]:
    """Drift and comparison of the split's or the first segment's two groups."""
    group = config.train_test_column or (config.segment_columns[0] if config.segment_columns else None)
    if not group:
        reason = {"available": False, "reason": "No split or segment column was configured."}
        return reason, dict(reason)
    counts = records(drift.group_counts(df, group).limit(1000))
    names = [r["group"] for r in counts]
    chosen = drift.chosen_groups([n for n in names if n != C.MISSING] or names) or drift.chosen_groups(names)
    if not chosen:
        reason = {"available": False, "reason": f"{group} has fewer than two groups.", "group_column": group}
        return reason, dict(reason)
    ref, cur = chosen
    features = [c for c in df.columns if c not in config.excluded()]
    kinds = {p["name"]: p["semantic_type"] for p in types["columns"]}
    numbers = [c for c in features if c in C.numeric_columns(df, booleans=True)]
    texts = [c for c in features if c not in numbers and c not in C.time_columns(df) and kinds[c] != "text"]
    rows = records(drift.drift(df, group, ref, cur, numbers, texts, config.drift_warning_threshold, config.drift_fail_threshold)) if numbers or texts else []
    done = {r["column"] for r in rows}
    worst = "fail" if any(r["status"] == "fail" for r in rows) else "warn" if any(r["status"] == "warn" for r in rows) else "pass"
    ignored = [n for n in names if n not in chosen]
    shared = {"available": True, "group_counts": {r["group"]: r["n"] for r in counts}, "ignored_groups": ignored}
    shift = shared | {"overall_status": worst, "group_column": group, "baseline_group": ref, "comparison_group": cur, "warning_threshold": config.drift_warning_threshold, "fail_threshold": config.drift_fail_threshold, "top_shifted_features": rows, "skipped_features": [{"column": c, "reason": "not measured"} for c in features if c not in done][:25]}
    changes = [r | {"metric": "numeric_mean"} for r in records(drift.comparison(df, group, ref, cur, numbers))] if numbers else []
    if texts:
        for r in records(drift.category_changes(df, group, ref, cur, texts)):
            r |= {"metric": "category_set"}
            if config.profile_depth == "minimal":
                r.pop("new_values")
            if config.profile_depth != "deep":
                r.pop("removed_values")
            changes.append(r)
    changes.sort(key=lambda r: -abs(r["change_score"] or 0.0))
    compared = shared | {"comparison_column": group, "reference_group": ref, "current_group": cur, "column_changes": changes[:25]}
    return shift, compared


def profile_summary(df: DataFrame, ordered: DataFrame, config: ProfileConfig, types: dict, alerts: list[dict]) -> dict:
    texts = [p["name"] for p in types["columns"] if p["semantic_type"] == "text"]
    times = [c for c in C.time_columns(df)]
    hidden = redacted_columns(types, config)
    text_rows, time_rows = [], []
    if config.profile_depth != "minimal":
        text_rows = records(text_time.text_summary(df, texts)) if texts else []
        if config.profile_depth == "deep":
            for r in text_rows:
                r["top_terms"] = [] if r["column"] in hidden else records(text_time.top_terms(ordered, r["column"], F.col(ORDER)))
        for c in times:
            gaps = records(text_time.time_gaps(df, c).withColumn("inferred_frequency", text_time.frequency(F.col("median_gap_seconds"))))
            rises = records(text_time.rises_in_order(ordered.withColumn("__n", F.monotonically_increasing_id()), c, F.col("__n")))[0]
            time_rows.append({"column": c} | (gaps[0] if gaps else {}) | rises)
    modes = {"minimal": "Shape, types, missing values, response and ranking.", "standard": "Also correlations, groups, texts and time stamps.", "deep": "Also frequent terms of texts and values that went away."}
    return {"available": True, "profile_depth": config.profile_depth, "sample_policy": config.sample_policy, "sensitive_report": {"sensitive_columns": list(config.sensitive_columns), "redacted_columns": hidden, "row_samples_included": config.sample_policy != "none"}, "alert_summary": rules.alert_summary(alerts), "alerts": alerts, "text_summary": text_rows, "datetime_summary": time_rows, "profiling_modes": modes}


def caveats(config: ProfileConfig, resp: dict, left_out: int = 0) -> list[str]:
    out = ["Every number was calculated from the table alone.", "What it means for the business needs the data's lineage and timing."]
    if config.problem_type == "auto" and resp["problem_type"] == "binary_classification":
        out.append("The positive class was chosen by rule; confirm it.")
    if not resp["available"]:
        out.append("There was no usable response, so nothing was measured against one.")
    if config.sample_policy == "redacted":
        out.append("Samples of ids and sensitive columns are redacted.")
    if config.profile_depth == "minimal":
        out.append("Minimal depth leaves out correlations, texts and time stamps.")
    if left_out:
        out.append(f"{left_out} columns were over a limit and are in no correlations; they are listed there.")
    return [*out, "Risk signals help a review; they don't approve a model."]


def run(df: DataFrame, config: ProfileConfig | None = None, *, export: bool = False, base_dir: str | Path = "artifacts/runs") -> Result:
    """Profiles a table. An input that is estimated at CACHED_BYTES or less is cached while the passes run; a larger one is read
    again by each pass, of which there is a fixed number for a set of columns, and each reads the columns it needs. Values of
    all columns are counted once, by class of a binary response; types, frequencies, quantiles, outliers, ranks, bins, rates and
    chi-squares are made of that table, which is kept (on disk where it doesn't fit) until the run ends. base_dir is a local folder, or a
    URI of any file system that Spark reaches."""
    config = config or ProfileConfig()
    check(df, config)
    ordered = C.normalised(tables.with_order(df, ORDER))
    clean = C.normalised(df)
    size = tables.scan_bytes(df)
    small = size is not None and size <= CACHED_BYTES
    clean = clean.persist() if small else clean
    y = positive = counts = None
    classes: list[str] = []
    try:
        if config.response_column and config.problem_type in ("auto", "binary_classification"):
            classes = response.classes_of(ordered, config.response_column, F.col(ORDER))
            if len(classes) == 2:
                positive = response.positive_class(classes)
                y = response.encoded(C.name(config.response_column), positive, next(c for c in classes if c != positive))
        counts = ranks.value_table(clean, clean.columns, y).persist()
        gone = _by_column(missingness.column_missingness(clean))
        types = type_summary(clean, ordered, config, gone, counts)
        shape = overview(clean, ordered, config, types, size)
        kind = problem_type(clean, config, types)
        if kind != "binary_classification":
            y = positive = None
        missing = missing_summary(clean, config, gone, y)
        one = univariate_summary(clean, config, types, counts)
        resp = response_summary(clean, config, types, kind, y, positive, classes, counts)
        pairs = {"numeric_correlation_matrix": [], "high_correlation_pairs": [], "possible_duplicate_columns": [], "skipped": "profile_depth=minimal"} if config.profile_depth == "minimal" else pair_summary(clean, config)
        quality = rules.quality_warnings(config, types, missing, shape)
        leakage = rules.leakage_warnings(config, types, resp)
        ranking = rules.feature_ranking(config, types, missing, resp, quality, leakage)
        shift, compared = group_summaries(clean, config, types)
        risks = rules.modeling_risks(config, types, missing, pairs, ranking, quality, leakage, shift, resp)
        profile = profile_summary(clean, ordered, config, types, rules.alerts(missing, pairs, quality, leakage))
        gate = rules.quality_gate(config, shape, resp, missing, pairs, quality, leakage, shift, risks)
    finally:
        if counts is not None:
            counts.unpersist()
        if small:
            clean.unpersist()
    packet = jsonable({
        "metadata": TOOL | {"created_at_utc": dt.datetime.now(dt.timezone.utc).isoformat()}, "config": config.to_dict(), "dataset_overview": shape, "profile_summary": profile, "response_summary": resp, "column_type_summary": types,
        "missingness_summary": missing, "univariate_summary": one, "bivariate_summary": pairs, "feature_ranking": ranking, "data_quality_warnings": quality, "leakage_warnings": leakage, "drift_summary": shift, "modeling_risk_summary": risks,
        "quality_checks": gate, "comparison_summary": compared, "visual_specs": evidence.chart_specs(config, missing, resp, pairs, ranking, shift), "plots": [], "artifacts": [], "external_artifacts": [], "caveats": caveats(config, resp, len(pairs.get("correlation_columns_left_out", []))),
    })
    text = report.markdown(packet)
    if not export:
        return Result(packet, text, None)
    if "://" in str(base_dir):
        return Result(packet, text, f"{base_dir}/{shared_runs.export(df.sparkSession, packet, text, config, str(base_dir))}")
    return Result(packet, text, artifacts.export(packet, text, config, Path(base_dir)))
