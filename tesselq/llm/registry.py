"""The subpackage's queries and their SQL; ``__spark_entry__.py`` reads both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op4_chat_format
from .classifier import op7_quality_classifier
from .decontaminate import OP8_SQL, op8_benchmark_decontamination
from .katz import op3_katz_score
from .language import op5_language_id
from .licenses import op2_license_scan
from .packing import op10_pack_sequences
from .quality_rules import OP6_SQL, op6_quality_rules
from .secrets import op1_secret_scan
from .simhash import op9_simhash_near_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_license_scan,
        op3_katz_score,
        op4_chat_format,
        op5_language_id,
        op6_quality_rules,
        op7_quality_classifier,
        op8_benchmark_decontamination,
        op9_simhash_near_dedup,
        op10_pack_sequences,
    )
}
ORACLE: dict[str, str] = {"op6_quality_rules": OP6_SQL, "op8_benchmark_decontamination": OP8_SQL}
