"""The queries and SQL of the text operators, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import OP5_SQL, op5_decontamination
from .language_id import op10_language_id
from .license_scan import OP4_SQL, op4_license_scan
from .lm_scoring import LM_BASE_SQL, lm_base_columns, op8_lm_scoring
from .near_dedup import OP2_SQL, op2_near_dedup
from .packing import op6_best_fit_packing
from .quality_classifier import op9_quality_classifier
from .quality_rules import OP1_SQL, op1_quality_rules
from .substring_dedup import OP3_SQL, op3_substring_dedup
from .warc import OP7_SQL, op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_near_dedup": op2_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_decontamination": op5_decontamination,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_warc": op7_warc,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
    "lm_base_columns": lm_base_columns,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op2_near_dedup": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_license_scan": OP4_SQL,
    "op5_decontamination": OP5_SQL,
    "op7_warc": OP7_SQL,
    "lm_base_columns": LM_BASE_SQL,
}
