"""Session transcripts: JSONL files -> entries -> messages -> visible evidence -> segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import budgets
from loam.session import LIMITS, Limits

KINDS = ("session", "message", "branch_summary", "compaction", "custom_message")  # fixed values: entries that count
PART = "struct<type:string,tool:string,tool_call_id:string,input:string,text:string,is_error:boolean>"


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime_ms, length of all *.jsonl below root; contents are read only by who selects them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root)
    return raw.select("path", F.unix_millis("modificationTime").alias("mtime_ms"), "length", "content")


def hashed(raw: DataFrame, most: int = LIMITS.session_bytes) -> DataFrame:
    """Files with content_hash; one over the size limit stops the job."""
    fine = F.when(F.col("length") > most, F.raise_error(F.concat(F.lit("session file too large: "), F.col("path")))).otherwise(F.col("content"))
    return raw.withColumn("content", fine).withColumn("content_hash", F.sha2("content", 256))


def verified(raw: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest's files; a file whose bytes are not those of the manifest stops the job."""
    both = hashed(raw).join(manifest.select("path", F.col("content_hash").alias("wanted")), "path")
    return both.withColumn("content", F.when(F.col("content_hash") == F.col("wanted"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("snapshot changed: "), F.col("path"))))).drop("wanted")


def header(content: Column) -> Column:
    """cwd and id of the first session line in the first 8 KiB, null without one."""
    lines = F.split(F.substring(content, 1, 8192).cast("string"), "\n")
    parsed = F.transform(lines, lambda x: F.from_json(x, "type string, cwd string, id string"))
    return F.get(F.filter(parsed, lambda s: (s["type"] == "session") & (s["cwd"] != "")), F.lit(0))


def entries(raw: DataFrame) -> DataFrame:
    """session (path), line number and JSON of every recognised line; anything else yields nothing."""
    lines = raw.select(F.col("path").alias("session"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line", "value"))
    parsed = lines.withColumn("v", F.try_parse_json("value")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    kind = F.try_variant_get("v", "$.type", "string")
    return parsed.withColumn("kind", kind).filter(F.col("kind").isin(*KINDS)).select("session", "line", "kind", "v")


def _text(v: Column, path: str) -> Column:
    """A string, or the text blocks of an array without anything between."""
    blocks = F.try_variant_get(v, path, "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
    return F.when(blocks.isNotNull(), F.array_join(texts, "")).otherwise(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def messages(found: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """entries -> session, position, role, ts_ms, custom_type, parts. A tool result without a name takes that of its call, the last of an id.

    before (session, call, known): tools of calls that earlier parts of the sessions made.
    """
    v = F.col("v")
    get = lambda p, t="string": F.try_variant_get(v, p, t)
    null = F.lit(None).cast("string")
    part = lambda kind, tool=null, call=null, input=null, text=null, error=F.lit(False): F.struct(kind.alias("type"), tool.alias("tool"), call.alias("tool_call_id"), input.alias("input"), text.alias("text"), error.alias("is_error"))
    blocks = get("$.message.content", "array<variant>")
    pick = lambda b, p: F.try_variant_get(b, p, "string")
    made = F.transform(
        F.filter(blocks, lambda b: ((pick(b, "$.type") == "text") & pick(b, "$.text").isNotNull()) | (pick(b, "$.type") == "toolCall")),
        lambda b: F.when(pick(b, "$.type") == "text", part(F.lit("text"), text=pick(b, "$.text"))).otherwise(
            part(F.lit("toolCall"), pick(b, "$.name"), pick(b, "$.id"), F.coalesce(F.to_json(F.coalesce(F.try_variant_get(b, "$.arguments", "variant"), F.try_variant_get(b, "$.input", "variant"))), F.lit("{}")))
        ),
    )
    whole = get("$.message.content")
    none = F.array().cast(f"array<{PART}>")
    role = get("$.message.role")
    own = (
        F.when(role == "toolResult", F.array(part(F.lit("toolResult"), get("$.message.toolName"), get("$.message.toolCallId"), text=_text(v, "$.message.content"), error=F.coalesce(get("$.message.isError", "boolean"), F.lit(False)))))
        .when(blocks.isNotNull(), made)
        .when(whole != "", F.array(part(F.lit("text"), text=whole)))
        .otherwise(none)
    )
    summary = F.when(get("$.summary") != "", F.array(part(F.lit("text"), text=get("$.summary")))).otherwise(none)
    custom = F.when(_text(v, "$.content") != "", F.array(part(F.lit("text"), text=_text(v, "$.content")))).otherwise(none)
    kind = F.col("kind")
    names = F.when(role == "branchSummary", "branch").when(role == "compactionSummary", "compaction").otherwise(role)
    stamp = lambda p: F.coalesce(F.try_variant_get(v, p, "double").cast("long"), F.unix_millis(F.try_to_timestamp(F.try_variant_get(v, p, "string"))))
    rows = found.filter("kind <> 'session'").select(
        "session",
        "line",
        F.when(kind == "message", names).when(kind == "branch_summary", "branch").when(kind == "compaction", "compaction").otherwise("custom").alias("role"),
        F.coalesce(stamp("$.message.timestamp"), stamp("$.timestamp")).alias("ts_ms"),
        get("$.customType").alias("custom_type"),
        F.when(kind == "message", own).when(kind == "custom_message", custom).otherwise(summary).alias("parts"),
    ).filter("role is not null")
    calls = rows.filter("role = 'assistant'").select("session", "line", F.posexplode("parts").alias("at", "p")).filter("p.type = 'toolCall' and p.tool_call_id <> '' and p.tool <> ''")
    tools = calls.groupBy("session", F.col("p.tool_call_id").alias("call")).agg(F.max_by("p.tool", F.struct("line", "at")).alias("known"))
    if before is not None:
        own = tools.select("session", "call")
        tools = tools.unionByName(before.select("session", "call", "known").join(own, ["session", "call"], "left_anti"))
    asked = F.when((F.col("role") == "toolResult") & F.get("parts", F.lit(0))["tool"].isNull(), F.get("parts", F.lit(0))["tool_call_id"])
    named = rows.withColumn("call", asked).join(tools, ["session", "call"], "left")
    filled = F.when(F.col("known").isNotNull(), F.transform("parts", lambda p: p.withField("tool", F.col("known")))).otherwise(F.col("parts"))
    w = Window.partitionBy("session").orderBy("line")
    return named.withColumn("parts", filled).withColumn("position", F.row_number().over(w) - 1).select("session", "position", "role", "ts_ms", "custom_type", "parts")


def visible(found: DataFrame, own_tool: str = "memory_search") -> DataFrame:
    """Messages that may be evidence: none that were generated, no part of the memory tool itself, none left empty; numbered anew."""
    parts = F.filter("parts", lambda p: ~p["tool"].eqNullSafe(F.lit(own_tool)))
    w = Window.partitionBy("session").orderBy("position")
    left = found.filter("role <> 'custom'").withColumn("parts", parts).filter(F.size("parts") > 0)
    return left.withColumn("index", F.row_number().over(w) - 1)


def line_of(limits: Limits = LIMITS, redact_first: bool = True) -> Column:
    """A message as text, bounded and redacted. redact_first: secrets go before a cut could hide them, too."""
    clean = T.redact if redact_first else (lambda x: x)
    body = lambda x: T.trim_space(F.coalesce(x, F.lit("")))

    def block(p: Column) -> Column:
        text = T.keep_edges(clean(body(p["text"])), limits.message_chars)
        tool = F.coalesce(p["tool"], F.lit("?"))
        call = F.concat(F.lit("[toolCall "), tool, F.lit(" "), T.keep_edges(clean(body(p["input"])), limits.tool_input_chars), F.lit("]"))
        result = F.concat(F.lit("[toolResult "), tool, F.lit(" "), F.when(p["is_error"], "ERROR ").otherwise(""), T.keep_edges(clean(body(p["text"])), limits.tool_result_chars), F.lit("]"))
        return F.when(p["type"] == "text", text).when(p["type"] == "toolCall", call).otherwise(result)

    joined = T.trim_space(F.array_join(F.transform("parts", block), "\n"))
    return F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), F.col("role"), F.lit(":\n"), T.redact(F.when(joined == "", "(no text)").otherwise(joined)))


def pack(lines: DataFrame, most_chars: int = LIMITS.segment_chars, most_messages: int = LIMITS.segment_messages) -> DataFrame:
    """lines (session, index, line) -> session, segment_no, start_index, end_index, text, chars (without what joins the lines).

    A session's lines are streamed through the fold; what is gathered in a row is one segment, which the caps bound (a single line apart).
    """
    sized = lines.select("session", "index", "line", F.length("line").cast("long").alias("chars"))
    cut = budgets.bin_rows(sized, ["session"], ["index"], "chars", most_chars, most_messages, number="segment_no")
    own = F.array_sort(F.collect_list(F.struct("index", "line")))
    found = cut.groupBy("session", "segment_no").agg(own.alias("own"), F.sum("chars").alias("chars"), F.min("index").alias("start_index"), (F.max("index") + 1).alias("end_index"))
    return found.select("session", "segment_no", "start_index", "end_index", F.array_join(F.transform("own", lambda x: x["line"]), "\n\n").alias("text"), "chars")
