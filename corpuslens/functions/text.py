"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Unicode white space, spelled out for both engines (Java's \s is ASCII only).
SPACE = "[\\t\\n\\x0b\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
THIN_WORDS = 50
#: Key-like strings that a log redacts, and attributes redacted whatever they hold (fixed values).
SECRET_PATTERNS = [r"sk-[A-Za-z0-9_-]{20,}", r"pa-[A-Za-z0-9_-]{20,}"]
SECRET_ATTRIBUTES = ["authorization", "x-api-key", "anthropic-api-key", "openai-api-key", "voyage-api-key", "api_key"]


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none stays at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def word_count(text: Column) -> Column:
    one = collapse(F.coalesce(text, F.lit("")))
    return F.when(one == "", 0).otherwise(F.size(F.split(one, " "))).cast("long")


def is_thin(words: Column, threshold: int = THIN_WORDS) -> Column:
    return words < (threshold if threshold > 0 else THIN_WORDS)


def byte_prefix(text: Column, n: int) -> Column:
    """The longest prefix of whole characters within ``n`` bytes."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, n)
    # A cut character leaves a lead byte and up to two followers at the end; hex digits tell them apart.
    hexed = F.regexp_replace(F.hex(raw), r"^((?:..)*?)(?:F[0-7](?:[89AB].){0,2}|E.(?:[89AB].)?|[CD].)$", "$1")
    return F.when(F.octet_length(text) <= n, text).otherwise(F.decode(F.unhex(hexed), "UTF-8"))


def strip_fences(reply: Column) -> Column:
    """The outer JSON object of a model's reply, without code fences and prose around it."""
    t = F.regexp_replace(reply, r"^\s+|\s+$", "")
    fenced = F.when(t.startswith("```") & (F.locate("\n", t) > 1), F.regexp_replace(F.regexp_replace(t, r"^[^\n]*\n", ""), r"(?s)```(?:(?!```).)*$", "")).when(t.startswith("```"), F.lit("")).otherwise(t)
    t = F.regexp_replace(fenced, r"^\s+|\s+$", "")
    t = F.regexp_replace(t, r"(?s)^[^{]+(?=\{)", "")
    return F.regexp_replace(t, r"(?s)(?<=\})[^}]*$", "")


def redact(text: Column, attribute: Column | None = None) -> Column:
    """Key-like strings replaced; the whole value where the attribute's name is a credential's."""
    out = text
    hit = F.lit(False)
    for p in SECRET_PATTERNS:
        # The first kind that occurs is the one replaced.
        out = F.when(~hit & text.rlike(p), F.regexp_replace(text, p, "REDACTED")).otherwise(out)
        hit = hit | text.rlike(p)
    return out if attribute is None else F.when(F.lower(attribute).isin(SECRET_ATTRIBUTES), F.lit("REDACTED")).otherwise(out)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def title_or_url(title: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), url)


def is_html(content_type: Column) -> Column:
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return t.startswith("text/html") | t.startswith("application/xhtml+xml") | (t == "")


def capped_body(raw: Column, cap: int = 5 << 20) -> tuple[Column, Column]:
    """The first ``cap`` bytes of a body, and whether that cut it."""
    return F.substring(raw, 1, cap), F.octet_length(raw) > cap


def user_prompt(url: Column, title: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("URL: "), url), F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))), F.lit(""), F.coalesce(body, F.lit("")))


def system_prompt(prompts: list[dict], messaging: list[dict], schema: str) -> str:
    """The part of a request that all pages share, built once."""
    lines = ["You audit one web page against the messages below and answer with one JSON object.", "", "Schema:", schema, "", "Canonical messages:"]
    lines += [f"- {m['title']}: {m['body']}" for m in messaging]
    lines += ["", "Questions that pages should answer:"]
    lines += [f"- {p['id']} (weight {p.get('weight', 1.0):g}): {p['text']}" for p in prompts]
    return "\n".join(lines)


def html_safe_json(value: Column) -> Column:
    """A struct, array or map as JSON in which "<", ">" and "&" are written as escapes."""
    out = F.to_json(value, {"ignoreNullFields": "false"})
    for c in "<>&":
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return out


def json_list(text: Column, kind: str = "array<string>") -> Column:
    """An array from JSON; null where the text is null, empty, "null" or no such array."""
    return F.from_json(F.when(text.rlike(r"^\s*\["), text), kind, {"mode": "PERMISSIVE"})


def list_json(value: Column) -> Column:
    """An array as JSON; null becomes the empty one."""
    return F.when(value.isNull(), "[]").otherwise(F.to_json(value))


def payload(text: Column) -> Column:
    """A JSON text parsed once, as a variant; null where it is null or no JSON."""
    return F.try_parse_json(text)


def payload_field(value: Column, path: str, kind: str = "string") -> Column:
    """The value at ``path`` of a ``payload`` as ``kind``; null where it is missing or cannot be such."""
    return F.try_variant_get(value, path, kind)
