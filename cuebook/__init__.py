"""cuebook: review-priority signals on Spark.

Declarative rules become native Column programs evaluated in one scan; matches become scored,
explained signal rows; people accept or reject them; decisions drive a threshold sweep. Around
that: governed reads, masking and redaction, and append-only history tables.
"""

from .model import RulesetError, load, merge, validate
from .operators.protect import default_masking, mask_columns, redact_nested, redact_unless_local
from .operators.review import (build_cases, case_list, collect_labels, latest_decisions, recommend,
                               tally, threshold_sweep, tuning_header)
from .operators.rules import evaluate, evaluate_compact, expand, rule_dimension, validate_rules
from .operators.signals import check_contract, frame, to_predictions, to_signals
from .session import checkpoint_dir, local_session
from .sources.governed import AuditLog, GovernedSource
from .sources.open import open_source

__version__ = "0.1.0"

__all__ = [
    "AuditLog", "GovernedSource", "RulesetError", "build_cases", "case_list", "check_contract",
    "checkpoint_dir", "collect_labels", "default_masking", "evaluate", "evaluate_compact", "expand",
    "frame", "latest_decisions", "load", "local_session", "mask_columns", "merge", "open_source",
    "recommend", "redact_nested", "redact_unless_local", "rule_dimension", "tally", "threshold_sweep",
    "to_predictions", "to_signals", "tuning_header", "validate", "validate_rules",
]
