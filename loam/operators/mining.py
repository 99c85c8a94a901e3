"""Mining: segments -> candidates -> recall -> operations, with budgets before each model call. Models are plain callables."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.session import LIMITS, Limits

_FENCE = re.compile(r"^```(?:json)?\s*\n?(.*?)\n?```$", re.S)
_ID = re.compile(r"^M:(\d+)$")
CANDIDATES = "session string, segment_no int, candidate_id string, kind string, memory_text string, evidence_text string, error string"
OPERATIONS = "session string, op_seq int, op string, kind string, memory_id long, memory_text string, evidence_text string, error string"


def json_object(text: str) -> dict:
    """The object in a model's answer, with or without one code fence."""
    text = text.strip()
    if m := _FENCE.match(text):
        text = m[1]
    data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("no JSON object")
    return data


def body_error(text, most: int = LIMITS.body_chars) -> str | None:
    if not isinstance(text, str) or not text.strip():
        return "must be non-empty"
    if "\n" in text.strip():
        return "must be a single line"
    return f"exceeds {most} characters" if len(text.strip()) > most else None


def candidate(raw) -> dict | None:
    """A valid candidate, or None: one that is malformed is left out."""
    if not isinstance(raw, dict) or raw.get("kind") not in ("preference", "fact") or body_error(raw.get("memoryText")) or body_error(raw.get("evidenceText")):
        return None
    return {"kind": raw["kind"], "memory_text": raw["memoryText"].strip(), "evidence_text": raw["evidenceText"].strip()}


def operation(raw) -> dict | None:
    """A valid operation, or None: one that is malformed rejects the whole list."""
    if not isinstance(raw, dict):
        return None
    op, out = raw.get("op"), {"op": raw.get("op"), "kind": None, "memory_id": None, "memory_text": None, "evidence_text": None}
    if op == "no_op":
        return out
    if op not in ("create", "update", "forget") or body_error(raw.get("evidenceText")):
        return None
    out["evidence_text"] = raw["evidenceText"].strip()
    if op == "create":
        if raw.get("kind") not in ("preference", "fact") or body_error(raw.get("memoryText")):
            return None
        return out | {"kind": raw["kind"], "memory_text": raw["memoryText"].strip()}
    m = _ID.match(raw["memoryId"]) if isinstance(raw.get("memoryId"), str) else None
    if not m or int(m[1]) == 0:
        return None
    out["memory_id"] = int(m[1])
    if op == "update" and raw.get("memoryText") is not None:
        if body_error(raw["memoryText"]):
            return None
        out["memory_text"] = raw["memoryText"].strip()
    return out


def _twice(ask: Callable[[str | None], str], read: Callable[[dict], list]) -> tuple[list, str | None]:
    """The answer that can be read, from the first call or one corrective retry."""
    problem = None
    for _ in range(2):
        try:
            return read(json_object(ask(problem))), None
        except (ValueError, KeyError, TypeError) as e:
            problem = str(e)
    return [], problem


OUT_OF_TIME = "the run's time is up"  #: the error of a segment that was not asked about any more


def extract(segments: DataFrame, complete: Callable[[str, str | None], str], limits: Limits = LIMITS, until: float | None = None) -> DataFrame:
    """segments (session, segment_no, text): candidates with ids that are unique in a session; a segment that fails twice is a row with `error`.

    until: the time (seconds since 1970) from which on no call is begun.
    """

    def read(answer: dict) -> list[dict]:
        found = [c for c in map(candidate, answer["candidates"]) if c]
        if len(found) > limits.candidates:
            raise ValueError(f"more than {limits.candidates} candidates")
        return found

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for s in frame.itertuples():
                if until is not None and time.time() >= until:
                    rows.append((s.session, s.segment_no, None, None, None, None, OUT_OF_TIME))
                    continue
                found, error = _twice(lambda problem, text=s.text: complete(text, problem), read)
                rows += [(s.session, s.segment_no, f"S{s.segment_no}C{k + 1}", c["kind"], c["memory_text"], c["evidence_text"], None) for k, c in enumerate(found)]
                if error:
                    rows.append((s.session, s.segment_no, None, None, None, None, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    return segments.select("session", "segment_no", "text").mapInPandas(work, CANDIDATES)


def within_budget(segments: DataFrame, run_chars: int = LIMITS.run_chars, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """segments with session_order: those before the run's characters are used up. `partial`: the session is cut off; sessions after it are left out."""
    w = Window.partitionBy(*keys).orderBy("session_order", "segment_no")
    used = F.coalesce(F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = segments.withColumn("fits", used + F.col("chars") <= run_chars)
    first_bad = F.min(F.when(~F.col("fits"), F.struct("session_order", "segment_no"))).over(Window.partitionBy(*keys))
    marked = marked.withColumn("stop", first_bad)
    keep = F.col("stop").isNull() | (F.struct("session_order", "segment_no") < F.col("stop"))
    return marked.filter(keep).withColumn("partial", F.coalesce(F.col("stop.session_order") == F.col("session_order"), F.lit(False))).drop("fits", "stop")


def consolidate(candidates: DataFrame, recalled: DataFrame, complete: Callable[[str, str | None], str], limits: Limits = LIMITS, until: float | None = None) -> DataFrame:
    """candidates and recalled (session, candidate_id, rank, node_id, text): each session's operations, from one prompt and one retry.

    until: the time from which on no call is begun; such a session's error is OUT_OF_TIME.
    """
    hit = F.struct("rank", "node_id", F.left("text", F.lit(limits.recall_chars)).alias("text"))
    shown = recalled.filter(F.col("rank") <= limits.recall_shown).groupBy("session", "candidate_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    rows = candidates.filter("error is null").join(shown, ["session", "candidate_id"], "left")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["segment_no", "candidate_id"])
        session = frame.session.iloc[0]
        parts = []
        for c in frame.itertuples():
            parts.append(f"{c.candidate_id} ({c.kind}): {c.memory_text}\nEvidence: {c.evidence_text}")
            parts += [f"  similar M:{h['node_id']}: {h['text']}" for h in (c.hits if c.hits is not None else [])]

        def read(answer: dict) -> list[dict]:
            ops = [operation(o) for o in answer["operations"]]
            if None in ops:
                raise ValueError(f"operation {ops.index(None) + 1} is malformed")
            return ops

        late = until is not None and time.time() >= until
        ops, error = ([], OUT_OF_TIME) if late else _twice(lambda problem: complete("\n".join(parts), problem), read)
        out = [(session, k, o["op"], o["kind"], o["memory_id"], o["memory_text"], o["evidence_text"], None) for k, o in enumerate(ops)]
        return pd.DataFrame(out or [(session, 0, None, None, None, None, None, error)], columns=[c.split()[0] for c in OPERATIONS.split(", ")]).astype({"memory_id": "Int64"})

    return rows.groupBy("session").applyInPandas(one, OPERATIONS)


def capacity(payload: Column, request: Column, window: Column, most_output: Column, limits: Limits = LIMITS) -> Column:
    """Why a synthesis call would not fit, or null; unknown limits fit."""
    need = F.greatest(F.lit(1), F.ceil(F.length(payload) / limits.chars_per_token)) + F.greatest(F.lit(1), F.ceil(F.length(request) / limits.chars_per_token)) + limits.framing_tokens + limits.output_tokens
    return F.when(need > window, F.lit("context window too small")).when(F.lit(limits.output_tokens) > most_output, F.lit("output limit too small"))


def synthesis_error(content: Column, sources: Column, payload_ids: Column, purpose: Column, nothing: str, limits: Limits = LIMITS) -> Column:
    """Why a synthesis answer is not valid, or null. sources and payload_ids: arrays of public ids."""
    said = F.trim(content) != ""
    cited = F.size(sources) > 0
    return (
        F.when(content.isNull(), 'the answer has no string as its content')
        .when(F.length(content) > limits.section_chars, f"the content is longer than {limits.section_chars} characters")
        .when(sources.isNull(), 'the answer has no list of sources')
        .when(F.exists(sources, lambda s: ~F.coalesce(s.rlike(r"^M:0*[1-9]\d*$"), F.lit(False))), "a source id is invalid")
        .when(F.size(F.array_except(sources, payload_ids)) > 0, "a source is not visible in the payload")
        .when(F.size(F.array_distinct(sources)) < F.size(sources), "a source is named twice (duplicate)")
        .when((purpose == "briefing") & (said != cited), "content and sources must both be there or neither")
        .when((purpose == "search") & ~said, "empty answer")
        .when((purpose == "search") & (cited == (F.trim(content) == nothing)), "sources must be empty exactly where nothing was found")
    )
