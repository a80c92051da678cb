"""Names for results: enumerations, the row schemas that operators return, and rows as plain dictionaries."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime
from enum import Enum

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.types import StructType

SCHEMA_VERSION = 1


class MoveDirection(Enum):
    UP = "UP"
    DOWN = "DOWN"
    FLAT = "FLAT"


class GateStatus(Enum):
    HALT = "HALT"
    WARN = "WARN"
    PASS = "PASS"
    SKIP = "SKIP"


class StationarityConclusion(Enum):
    STATIONARY = "stationary"
    NON_STATIONARY = "non_stationary"
    DIFFERENCE_STATIONARY = "difference_stationary"
    INSUFFICIENT_EVIDENCE = "insufficient_evidence"


class UndefinedMetricWarning(UserWarning):
    """A metric isn't defined for its rows; results carry null there."""


#: Columns after the grouping keys of each kind of result row (or of its rows, where a result has many).
ROWS = {
    "SplitInfo": "fold int, train_lo long, train_hi long, test_lo long, test_hi long, gap long",
    "SplitResult": "fold int, n long, mae double, rmse double, bias double",
    "WalkForwardResults": "fold int, position long, prediction double, actual double, error double, abs_error double, train_lo long, train_hi long",
    "PurgedSplit": "fold int, n_train long, n_test long, n_purged long, n_embargoed long",
    "NestedCVResult": "fold int, params string, inner_score double, outer_mae double, best_params string",
    "BrierScoreResult": "brier double, reliability double, resolution double, uncertainty double, skill_score double, n long",
    "PRAUCResult": "pr_auc double, baseline double, precision_at_50_recall double, n_positive long, n_total long",
    "VolatilityStratifiedResult": "low_mae double, med_mae double, high_mae double, n_low long, n_med long, n_high long, overall_mae double, vn_mae double",
    "MoveConditionalResult": "mae_up double, mae_down double, mae_flat double, n_up long, n_down long, n_flat long, skill_score double, move_threshold double, reliable boolean",
    "StratifiedMetricsResult": "regime string, mae double, rmse double, n long, pct double, kept boolean",
    "Changepoint": "position long, cost_reduction double",
    "StationarityTestResult": "statistic double, p_value double, lags int, is_stationary boolean",
    "JointStationarityResult": "adf_p double, kpss_p double, conclusion string",
    "LagSelectionResult": "lag int, criterion map<int,double>",
    "HACResult": "n long, lrv double, variance double, se double, dof long",
    "DMTestResult": "n long, mean_diff double, variance double, statistic double, p_value double",
    "CWTestResult": "n long, mean_diff double, variance double, statistic double, mean_unadjusted double, p_value double",
    "GWTestResult": "n_eff long, mean_diff double, r_squared double, statistic double, p_value double",
    "PTTestResult": "n long, accuracy double, expected double, statistic double, p_value double",
    "MultiModelComparisonResult": "better string, worse string, n long, mean_diff double, statistic double, p_value double, significant boolean",
    "MultiHorizonResult": "h int, n long, mean_diff double, statistic double, p_value double",
    "MultiModelHorizonResult": "model_a string, model_b string, n long, mean_diff double, h int, statistic double, p_value double",
    "EncompassingTestResult": "n long, lambda double, intercept double, statistic double, p_value double, encompasses boolean",
    "BidirectionalEncompassingResult": "lambda_a double, a_encompasses boolean, lambda_b double, b_encompasses boolean, recommendation string",
    "RealityCheckResult": "statistic double, best_model string, n int, n_bootstrap long, p_value double",
    "SPATestResult": "statistic double, best_model string, n int, n_bootstrap long, p_value double, p_value_consistent double, p_value_lower double",
    "PredictionInterval": "point double, lower double, upper double",
    "CoverageDiagnostics": "kind string, part string, n long, coverage double, undercovered boolean",
    "BlockBootstrapResult": "estimate double, ci_lower double, ci_upper double, std_error double, n_valid int, block_length int",
    "WildBootstrapResult": "estimate double, std_error double, ci_lower double, ci_upper double, p_value double, n_folds int, weight_type string",
    "GateResult": "gate string, scope string, status string, metric double, threshold double, message string, details map<string,string>",
    "ValidationReport": "status string, n_gates long, n_halt long, n_warn long",
    "StratifiedValidationReport": "scope string, status string, n_gates long, n_halt long, n_warn long",
    "GuardrailResult": "check string, level string, value double, message string",
    "InfluenceDiagnostic": "d double, influence double, high boolean, block long, block_influence double",
    "GapSensitivityResult": "gap int, metric double",
    "ModelResult": "model string, series_id string, idx long, prediction double, actual double",
    "ComparisonResult": "model string, mae double, rmse double, mape double, direction_accuracy double, rank int",
    "ComparisonReport": "model string, wins long, n_datasets long, mean_mae double, mean_rmse double",
}


def schema_of(result: str) -> StructType:
    return StructType.fromDDL(ROWS[result])


def conforms(df: DataFrame, result: str) -> bool:
    """Whether a frame has a result's columns, of the same kinds up to the width of numbers."""
    wide = {"int": "long", "bigint": "long", "float": "double"}
    kind = lambda t: wide.get(t, t)
    have = {c: kind(t) for c, t in df.dtypes}
    return all(have.get(f.name) == kind(f.dataType.simpleString()) for f in schema_of(result))


def date_to_json(value: date | datetime | None) -> str | None:
    return None if value is None else value.isoformat()


def array_to_list(value) -> list | None:
    return None if value is None else np.asarray(value).tolist()


def jsonify_key(key) -> str:
    """A map key as a string; tuples have no such form."""
    if isinstance(key, tuple):
        raise TypeError("tuples aren't JSON keys; use a list of records")
    return str(key.value if isinstance(key, Enum) else key)


def _json(value):
    if isinstance(value, Row):
        return {k: _json(v) for k, v in value.asDict().items()}
    if isinstance(value, Mapping):
        return {jsonify_key(k): _json(v) for k, v in value.items()}
    if isinstance(value, Enum):
        return value.value
    if isinstance(value, date | datetime):
        return date_to_json(value)
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, list | tuple | np.ndarray):
        return [_json(v) for v in (value.tolist() if isinstance(value, np.ndarray) else value)]
    return value


def result_to_dict(row: Row | Mapping) -> dict:
    """A result row as JSON-ready values with its schema version."""
    return {"schema_version": SCHEMA_VERSION} | _json(row)
