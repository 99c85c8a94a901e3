"""Scalar text functions as Columns. Lengths count code points; white space is Unicode's, with U+FEFF."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.session import LIMITS

SPACE = r"[\s\x{FEFF}]"
_EDGE = r"(?<![A-Za-z0-9_])"  # a word boundary before a word character, ASCII only
_END = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# Secrets and what stands for them, in the order of replacement.
SECRETS = (
    (rf"(?i){_EDGE}Bearer\s+[A-Za-z0-9._~+/=-]{{8,}}{_END}", "[REDACTED_BEARER_TOKEN]"),
    (rf"(?i){_EDGE}(?:api[_-]?key|apikey|token|secret|password|passwd|authorization)\s*[:=]\s*['\"]?[^\s'\"]{{8,}}['\"]?", "[REDACTED_SECRET]"),
    (rf"{_EDGE}sk-[A-Za-z0-9]{{16,}}(?![A-Za-z0-9_])", "[REDACTED_API_KEY]"),
    (r"(?s)-----BEGIN[A-Z ]*PRIVATE KEY-----.*?-----END[A-Z ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (rf"(?i){_EDGE}(?:postgres|mysql|mongodb)(?:\+srv)?://[^\s'\"]+", "[REDACTED_CONNECTION_STRING]"),
    (rf"(?i){_EDGE}Cookie:\s*[^\n]+", "Cookie: [REDACTED_COOKIE]"),
    (rf"(?i){_EDGE}Set-Cookie:\s*[^\n]+", "Set-Cookie: [REDACTED_COOKIE]"),
)
# What a greeting consists of.
GREETINGS = (
    r"(?i)^(hi|hey|hello|yo|sup|howdy|hola|hiya|greetings|good\s+(morning|afternoon|evening|day))(?![A-Za-z0-9_])",
    r"(?i)what'?s?\s+up(?![A-Za-z0-9_])",
    r"(?i)how\s+(are\s+you|are\s+things|do\s+you\s+do)(?![A-Za-z0-9_])",
)


def trim_space(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def normalise(x: Column) -> Column:
    """Trimmed, inner white space one blank, lower case."""
    return F.lower(F.regexp_replace(trim_space(x), rf"(?U){SPACE}+", " "))


def terms(x: Column) -> Column:
    """Runs of letters and digits, lower case, repeats kept."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.lower)


def _accents() -> tuple[str, str]:
    """Letters up to U+024F and in U+1E00 to U+1EFF with the letter their decomposition starts with."""
    plain = {c: unicodedata.normalize("NFD", c) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])}
    pairs = {c: d[0] for c, d in plain.items() if d[0] != c and all(unicodedata.combining(m) for m in d[1:])}
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accents()


def fold_accents(x: Column) -> Column:
    """Accents go: letters lose them, and combining marks are dropped."""
    return F.regexp_replace(F.translate(x, _FROM, _TO), r"\p{M}+", "")


def search_terms(x: Column) -> Column:
    """Terms as the full-text index has them: accents folded."""
    return terms(fold_accents(x))


def match_expression(x: Column) -> Column:
    """The OR of quoted terms, null without any."""
    quoted = F.transform(terms(x), lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    return F.when(F.size(quoted) > 0, F.array_join(quoted, " OR "))


def redact(x: Column) -> Column:
    for pattern, instead in SECRETS:
        x = F.regexp_replace(x, pattern, instead.replace("$", r"\$"))
    return x


def keep_edges(x: Column, most: int) -> Column:
    """Head and tail of a text longer than `most`, with a note of what is left out between them."""
    if most <= 0:
        return F.when(F.length(x) <= most, x).otherwise("")
    head, tail = -(-most // 2), most // 2
    end = F.right(x, F.lit(tail)) if tail else x  # an empty tail keeps the whole text, as slicing by -0 does
    cut = F.concat(F.left(x, F.lit(head)), F.lit("…["), (F.length(x) - most).cast("string"), F.lit(" chars omitted]…"), end)
    return F.when(F.length(x) <= most, x).otherwise(cut)


def body_error(x: Column, most: int = LIMITS.body_chars, subject: str = "Memory text") -> Column:
    """Why a text is no valid body, or null."""
    t = trim_space(x)
    # The three messages, which callers compare.
    return F.when(t == "", f"{subject} must be non-empty").when(F.contains(t, F.lit("\n")), f"{subject} must be a single line").when(F.length(t) > most, f"{subject} exceeds {most} characters")


def public_id(n: Column) -> Column:
    return F.concat(F.lit("M:"), n.cast("string"))


def parse_id(x: Column) -> Column:
    """The number of an id M:n, null for anything else and for 0."""
    n = F.regexp_extract(trim_space(x), r"^M:(\d+)$", 1)
    n = F.when(n != "", n.try_cast("long"))
    return F.when(n > 0, n)


def id_error(x: Column) -> Column:
    return F.when(parse_id(x).isNotNull(), F.lit(None).cast("string")).when(trim_space(x).rlike(r"^O:"), F.concat(F.lit("Observation ids are retired: "), x)).otherwise(F.concat(F.lit("Invalid memory id: "), F.coalesce(x, F.lit("null"))))


def content_hash(x: Column, chars: int = 32) -> Column:
    return F.substring(F.sha2(x, 256), 1, chars)


def fallback_session_id(path: Column, cwd: Column) -> Column:
    return F.concat(F.lit("path:"), content_hash(F.concat(path, F.lit("\0"), cwd), 24))


def token_estimate(x: Column, per_token: int = LIMITS.chars_per_token) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(x) / per_token)).cast("long")


def greeting_only(x: Column) -> Column:
    t = trim_space(x)
    rest = t
    for pattern in GREETINGS:
        rest = F.regexp_replace(rest, pattern, " ")
    return (t != "") & (F.regexp_replace(rest, r"[^\p{L}\p{N}]+", "") == "")


def skips_retrieval(x: Column, least: int = LIMITS.query_min_chars) -> Column:
    return (F.length(trim_space(x)) < least) | greeting_only(x)


def payload_line(n: Column, kind: Column, state: Column, recurrence: Column, text: Column) -> Column:
    shown = F.when(state == "active", F.lit("")).otherwise(F.concat(F.lit(", "), state))
    return F.concat(F.lit("- "), public_id(n), F.lit(" ("), kind, shown, F.lit(", r="), recurrence.cast("string"), F.lit("): "), text)


def preference_line(n: Column, text: Column) -> Column:
    return F.concat(F.lit("- "), public_id(n), F.lit(" (preference): "), text)


def canonical_remote(x: Column) -> Column:
    """host/path of a git remote in lower case, null where it is none."""
    t = trim_space(x)
    web, ssh, scp = r"^(?i)https?://([^/]+)/(.+)$", r"^(?i)ssh://(?:[^@]+@)?([^/]+)/(.+)$", r"^(?:[^@]+@)?([^:]+):(.+)$"
    pick = lambda k: F.when(t.rlike(web), F.regexp_extract(t, web, k)).when(t.rlike(ssh), F.regexp_extract(t, ssh, k)).when(t.rlike(scp) & ~F.contains(t, F.lit("://")), F.regexp_extract(t, scp, k))
    path = F.regexp_replace(F.regexp_replace(pick(2), r"/+$", ""), r"(?i)\.git$", "")
    return F.when((pick(1) != "") & (path != ""), F.lower(F.concat(pick(1), F.lit("/"), path)))


def session_dir_name(cwd: Column) -> Column:
    return F.concat(F.lit("--"), F.regexp_replace(F.regexp_replace(cwd, r"^[/\\]", ""), r"[/\\:]", "-"), F.lit("--"))


def safe_name(source: Column, most: int = 32) -> Column:
    """A name for folders, from the last part of a path or remote."""
    base = F.regexp_replace(F.regexp_extract(F.regexp_replace(source, r"/+$", ""), r"([^/]*)$", 1), r"(?i)\.git$", "")
    clean = F.left(F.regexp_replace(F.regexp_replace(base, r"[^a-zA-Z0-9._-]+", "-"), r"^-+|-+$", ""), F.lit(most))
    return F.when(clean != "", clean).otherwise("workspace")


def workspace_id(remote: Column, common_dir: Column, cwd: Column) -> Column:
    """A workspace's id, from its remote where that has a canonical form, else its common git folder, else its folder."""
    source = F.coalesce(canonical_remote(remote), common_dir, cwd)
    return F.concat(content_hash(source, 12), F.lit("_"), safe_name(source))


def json_object(x: Column, anywhere: bool = False) -> Column:
    """The JSON object of a model's answer, with or without one code fence (`anywhere`: text around the fence goes); null where it is none."""
    fence = r"(?is)```(?:json)?\s*(.*?)```" if anywhere else r"(?s)^```(?:json)?\s*\n?(.*?)\n?```$"
    inner = F.regexp_extract(trim_space(x), fence, 1)
    parsed = F.try_parse_json(F.when(inner != "", inner).otherwise(trim_space(x)))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def significant(x: Column, digits: int = 12) -> Column:
    """A positive number rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(x)))
    return F.rint(x * scale) / scale
