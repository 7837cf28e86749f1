"""Sources beside Spark's own readers: sitemaps, robots rules, configuration files."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from xml.etree.ElementTree import ParseError, XMLPullParser

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.batches import mapped
from ..functions.urls import decoded_path, path as url_path, same_host
from ..session import materialize

MAX_INDEX_DEPTH = 5


def parse_sitemap(text: str) -> list[tuple[str, str, bool]]:
    """``(loc, lastmod, is_index)`` of every entry with a location; what comes before a fault in the document stays."""
    out, parser = [], XMLPullParser(events=("end",))
    try:
        parser.feed(text)
        parser.close()
    except ParseError:
        pass
    try:
        for _, e in parser.read_events():
            name = e.tag.rpartition("}")[2]
            if name in ("url", "sitemap"):
                own = {c.tag.rpartition("}")[2]: (c.text or "").strip() for c in e}
                if own.get("loc"):
                    out.append((own["loc"], own.get("lastmod", ""), name == "sitemap"))
    except ParseError:
        pass
    return out


def sitemap_entries(documents: DataFrame) -> DataFrame:
    """``documents(source, xml)`` to ``(source, loc, lastmod, is_index)``."""

    def run(frames):
        for f in frames:
            rows = [(s, *e) for s, x in zip(f["source"], f["xml"]) for e in parse_sitemap(x or "")]
            yield pd.DataFrame(rows, columns=["source", "loc", "lastmod", "is_index"])

    return documents.select("source", "xml").mapInPandas(run, "source string, loc string, lastmod string, is_index boolean")


def sitemap_files(spark: SparkSession, path: str, index: bool = False) -> DataFrame:
    """``(source, loc, lastmod, is_index)`` of sitemap files (or, with ``index``, files of indexes) of any size.

    A file is split between tasks and cut at its entries' closing tags, so no task holds a file.  An entry that is broken is
    left out and those around it stay; the last counts where its location is whole, though the file ends before its tag.
    """
    tag = "sitemap" if index else "url"
    opening, prefix = re.compile(rf"<{tag}(?:\s[^>]*)?>"), re.compile(r"<(/?)[\w.-]+:(?=[\w.-]+)")

    def run(batches):
        for batch in batches:
            out = []
            for source, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = opening.split(piece)
                if len(parts) > 1:
                    out += [(source, *e) for e in parse_sitemap(prefix.sub(r"<\1", f"<x><{tag}>{parts[-1]}</{tag}></x>"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 4, (pa.string(), pa.string(), pa.string(), pa.bool_()))], ["source", "loc", "lastmod", "is_index"])

    pieces = spark.read.option("lineSep", f"</{tag}>").text(path).select(F.col("_metadata.file_path").alias("source"), "value")
    return pieces.mapInArrow(run, "source string, loc string, lastmod string, is_index boolean")


def expand_sitemaps(documents: DataFrame, roots: list[str]) -> DataFrame:
    """Pages that ``roots`` list, directly or through indexes up to ``MAX_INDEX_DEPTH`` deep; ``documents`` stands for the web."""
    spark = documents.sparkSession
    frontier, out, seen = spark.createDataFrame([(r,) for r in roots], "source string"), None, None
    entries = materialize(sitemap_entries(documents), "sitemaps")
    for _ in range(MAX_INDEX_DEPTH + 1):
        level = entries.join(frontier, "source", "left_semi")
        pages = level.filter("not is_index").select("loc", "lastmod", "source")
        out = pages if out is None else out.unionAll(pages)
        seen = frontier if seen is None else seen.unionAll(frontier)
        frontier = level.filter("is_index").select(F.col("loc").alias("source")).distinct().join(seen, "source", "left_anti")
        if frontier.isEmpty():
            break
    return out


def robots_rules(robots_txt: str, agent: str = "*") -> list[tuple[bool, str]]:
    """``(allowed, pattern)`` of the group whose agent's name is the longest that ``agent`` begins with, else that of "*"."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    open_, naming = [], False
    for line in robots_txt.splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not naming:
                open_ = []
            naming = True
            open_.append(value.lower())
            groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow"):
            naming = False
            # An empty rule says nothing.
            if value:
                for name in open_:
                    groups[name].append((key == "allow", value))
    names = [n for n in groups if n != "*" and n and agent.lower().startswith(n)]
    return groups[max(names, key=len)] if names else groups.get("*", [])


def robots_pattern(rule: str) -> str:
    """A rule as a regular expression: "*" is any run of characters, "$" at the end is the path's end."""
    ends = rule.endswith("$")
    body = ".*".join(map(re.escape, (rule[:-1] if ends else rule).split("*")))
    return f"(?s)^{body}{'$' if ends else ''}"


def robots_filter(robots_txt: str | None, agent: str = "*"):
    """A function from a url column to whether the rules allow its path: the longest rule that matches decides, an
    allowing one of equals; no file allows all."""
    rules = robots_rules(robots_txt or "", agent)
    if not rules:
        return lambda url: F.lit(True)

    def allowed(url: Column) -> Column:
        path = F.coalesce(F.nullif(decoded_path(url_path(url)), F.lit("")), F.lit("/"))
        longest = lambda kind: F.greatest(F.lit(-1), F.lit(-1), *(F.when(path.rlike(robots_pattern(r)), len(r)).otherwise(-1) for ok, r in rules if ok == kind))
        return longest(True) >= longest(False)

    return allowed


def robots_sitemaps(robots_txt: str) -> list[str]:
    return re.findall(r"(?im)^\s*sitemap:\s*(\S+)", robots_txt or "")


def gunzipped(name: Column, raw: Column, encoding: Column | None = None) -> Column:
    """A body as text, unpacked where its header says gzip or its name ends in ".gz" and it begins like a gzip file."""

    @F.arrow_udf("binary")
    def unpack(bodies: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return mapped(gzip.decompress, bodies, pa.binary())

    said = F.lower(F.coalesce(encoding, F.lit(""))).contains("gzip") if encoding is not None else F.lit(False)
    packed = (said | F.lower(F.coalesce(name, F.lit(""))).endswith(".gz")) & (F.substring(raw, 1, 2) == F.unhex(F.lit("1F8B")))
    return F.decode(F.when(packed, unpack(F.when(packed, raw))).otherwise(raw), "UTF-8")


class ConfigError(ValueError):
    pass


def load_config(raw: bytes | str, site: str | None = None) -> dict:
    """The messaging configuration of a YAML document, validated, with its digest; weights of 0 or none become 1."""
    raw = raw.encode() if isinstance(raw, str) else raw
    try:
        c = yaml.safe_load(raw)
    except yaml.YAMLError as e:
        raise ConfigError(f"not YAML: {e}") from e
    if not isinstance(c, dict):
        raise ConfigError("a mapping is expected")
    unknown = set(c) - {"version", "prompts", "canonical_messaging", "label_overrides", "seeds"}
    if unknown:
        raise ConfigError(f"unknown keys: {sorted(unknown)}")
    if c.get("version") != "1":
        raise ConfigError('version must be "1"')
    prompts = c.get("prompts") or []
    if not 1 <= len(prompts) <= 100:
        raise ConfigError("1 to 100 prompts are expected")
    seen = set()
    for p in prompts:
        if not re.fullmatch(r"[a-z0-9_-]{1,64}", p.get("id") or ""):
            raise ConfigError(f"bad prompt id {p.get('id')!r}")
        if p["id"] in seen:
            raise ConfigError(f"prompt id {p['id']} repeats")
        seen.add(p["id"])
        if not 1 <= len((p.get("text") or "").encode()) <= 2000:
            raise ConfigError(f"prompt {p['id']}: text of 1 to 2000 bytes is expected")
        if not 0 <= (p.get("weight") or 0) <= 10:
            raise ConfigError(f"prompt {p['id']}: weight must lie within 0 and 10")
        p["weight"] = float(p.get("weight") or 1.0)
    blocks = c.get("canonical_messaging") or []
    if len(blocks) > 50 or any(not b.get("title") or len((b.get("body") or "").encode()) > 20000 for b in blocks):
        raise ConfigError("at most 50 messages, each with a title and a body of up to 20000 bytes")
    hosts = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)")
    for s in c.get("seeds") or []:
        m = hosts.match(s)
        if not m:
            raise ConfigError(f"seed {s} is not absolute")
        if site and m[1].lower() != (hosts.match(site) or [None, ""])[1].lower():
            raise ConfigError(f"seed {s} lies on another host than {site}")
    return c | {"sha256": hashlib.sha256(raw).hexdigest(), "canonical_messaging": blocks, "seeds": c.get("seeds") or []}


def prompts_frame(spark, config: dict) -> DataFrame:
    return spark.createDataFrame([(p["id"], p["text"], p["weight"], p.get("tags") or []) for p in config["prompts"]], "id string, text string, weight double, tags array<string>")


def allowed_host(url: Column, site: str) -> Column:
    return same_host(F.lit(site), url)
