"""The configuration of a run: roles of columns and thresholds."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PROBLEM_TYPES = ("auto", "binary_classification", "multiclass_classification", "regression", "unsupervised")
PROFILE_DEPTHS = ("minimal", "standard", "deep")
SAMPLE_POLICIES = ("redacted", "preview", "none")


class ValidationError(ValueError):
    """A table or a configuration that can't be worked on."""


@dataclass(frozen=True)
class ProfileConfig:
    dataset_name: str = "dataset"
    response_column: str | None = None
    problem_type: str = "auto"
    id_columns: tuple[str, ...] = ()
    date_columns: tuple[str, ...] = ()
    train_test_column: str | None = None
    segment_columns: tuple[str, ...] = ()
    exclude_columns: tuple[str, ...] = ()
    sensitive_columns: tuple[str, ...] = ()
    weight_column: str | None = None
    profile_depth: str = "standard"
    sample_policy: str = "redacted"
    max_categories: int = 20
    rare_category_threshold: float = 0.01
    high_cardinality_threshold: int = 50
    high_missingness_threshold: float = 0.40
    near_constant_threshold: float = 0.98
    high_correlation_threshold: float = 0.80
    high_auc_leakage_threshold: float = 0.98
    max_correlation_columns: int = 50
    drift_warning_threshold: float = 0.20
    drift_fail_threshold: float = 0.50

    def to_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    def role_columns(self) -> dict[str, tuple[str, ...]]:
        """Primary roles: a column has one of them at most."""
        one = lambda c: (c,) if c else ()
        return {"response": one(self.response_column), "id": self.id_columns, "date": self.date_columns, "train_test_split": one(self.train_test_column), "segment": self.segment_columns, "sensitive": self.sensitive_columns, "weight": one(self.weight_column)}

    def excluded(self) -> set[str]:
        """Columns that are no candidate predictors."""
        return set(self.exclude_columns).union(*self.role_columns().values())


_LISTS = ("id_columns", "date_columns", "segment_columns", "exclude_columns", "sensitive_columns")
_COUNTS = ("max_categories", "high_cardinality_threshold", "max_correlation_columns")
_SHARES = ("rare_category_threshold", "high_missingness_threshold", "near_constant_threshold", "high_correlation_threshold", "high_auc_leakage_threshold")


def check_labels(names: Sequence[object]) -> None:
    """Column labels have to be texts, not blank, and different."""
    if any(not isinstance(n, str) for n in names):
        raise ValidationError("Column labels must be text.")
    if any(not n.strip() for n in names):
        raise ValidationError("Column labels must not be blank.")
    if repeated := sorted({n for n in names if names.count(n) > 1}):
        raise ValidationError(f"Column labels must be unique; repeated: {', '.join(repeated)}.")


def check(df: DataFrame, config: ProfileConfig) -> None:
    """Raises ValidationError before any Spark job, but for the look for a first row."""
    if not df.columns:
        raise ValidationError("The table has no columns.")
    check_labels(df.columns)
    if nested := [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]:
        raise ValidationError(f"Nested columns can't be profiled; select their fields first: {', '.join(nested)}.")
    for name, allowed in (("problem_type", PROBLEM_TYPES), ("profile_depth", PROFILE_DEPTHS), ("sample_policy", SAMPLE_POLICIES)):
        if getattr(config, name) not in allowed:
            raise ValidationError(f"{name} must be one of {', '.join(allowed)}.")
    for name in _COUNTS:
        v = getattr(config, name)
        if isinstance(v, bool) or not isinstance(v, int) or v < 1:
            raise ValidationError(f"{name} must be a whole number of 1 or more.")
    for name in (*_SHARES, "drift_warning_threshold", "drift_fail_threshold"):
        v = getattr(config, name)
        top = 1 if name in _SHARES else math.inf
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or not 0 <= v <= top:
            raise ValidationError(f"{name} must be a finite number from 0" + (" to 1." if top == 1 else "."))
    if config.drift_warning_threshold > config.drift_fail_threshold:
        raise ValidationError("drift_warning_threshold must not pass drift_fail_threshold.")
    for name in _LISTS:
        v = getattr(config, name)
        if len(set(v)) < len(v):
            raise ValidationError(f"{name} names a column twice.")
    roles: dict[str, str] = {}
    for role, columns in config.role_columns().items():
        for c in columns:
            if c not in df.columns:
                raise ValidationError(f"Column {c!r} of role {role} is not in the table.")
            if c in config.exclude_columns:
                raise ValidationError(f"Column {c!r} is excluded and has the role {role}.")
            if c in roles and "sensitive" not in (role, roles[c]):
                raise ValidationError(f"Column {c!r} has the roles {roles[c]} and {role}.")
            roles[c] = role
    if missing := [c for c in config.exclude_columns if c not in df.columns]:
        raise ValidationError(f"Excluded columns are not in the table: {', '.join(missing)}.")
    if df.isEmpty():
        raise ValidationError("The table has no rows.")


def from_dict(values: dict) -> ProfileConfig:
    known = {f.name for f in fields(ProfileConfig)}
    if unknown := sorted(set(values) - known):
        raise ValidationError(f"Unknown settings: {', '.join(unknown)}.")
    return ProfileConfig(**{k: tuple(v) if k in _LISTS else v for k, v in values.items()})


def json_schema() -> dict:
    """Of the settings, for tools that write them."""
    kinds = {"str": "string", "int": "integer", "float": "number", "str | None": ["string", "null"]}
    enums = {"problem_type": PROBLEM_TYPES, "profile_depth": PROFILE_DEPTHS, "sample_policy": SAMPLE_POLICIES}
    out = {}
    for f in fields(ProfileConfig):
        out[f.name] = {"type": "array", "items": {"type": "string"}, "uniqueItems": True} if f.name in _LISTS else {"type": kinds[f.type]}
        if f.name in enums:
            out[f.name]["enum"] = list(enums[f.name])
    return {"type": "object", "properties": out, "additionalProperties": False}
