"""The engine's session and its constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


def session(app: str = "loam", **conf: str) -> SparkSession:
    """A session with what the engine relies on: UTC, adaptive execution with skew handling. The master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@dataclass(frozen=True)
class Limits:
    """The defaults of every behavioural limit, each of them a parameter."""

    body_chars: int = 400
    section_chars: int = 20_000
    payload_chars: int = 40_000
    payload_units: int = 150
    rrf_k: int = 60
    cosine_floor: float = 0.15
    retrieval_units: int = 600
    retrieval_chars: int = 240_000
    query_segment_chars: int = 800
    query_min_chars: int = 3
    framing_tokens: int = 2000
    output_tokens: int = 6000
    min_turns: int = 10
    min_minutes: int = 120
    stale_ms: int = 3_600_000
    session_bytes: int = 64 << 20
    segment_chars: int = 24_000
    segment_messages: int = 200
    message_chars: int = 2000
    tool_result_chars: int = 400
    tool_input_chars: int = 200
    candidates: int = 12
    run_chars: int = 2_000_000
    run_minutes: int = 45
    manifest_sessions: int = 30
    page: int = 40
    page_max: int = 50
    recall_units: int = 5
    recall_shown: int = 3
    recall_chars: int = 200
    chars_per_token: int = 4


LIMITS = Limits()
