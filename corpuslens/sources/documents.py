"""Report documents of any size: tasks write parts, a two-phase commit publishes one manifest.

A document is text of the driver's, such as its head, and sections, each an ordered table with a line a row.  Tasks write a
section's rows as parts under names of their own and send only name, size and digest; ``commit`` lists the parts in order
in one manifest, moved into place, and removes what an earlier document or a failed attempt left.  Readers follow
manifests, so nothing of a write that failed is ever seen.  The whole document is read as a stream of its chunks.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyarrow import fs as afs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.scores import rfc3339
from .sinks import CSV_COLUMNS, csv_frame

MANIFEST = "manifest.json"
#: Bytes that a reader holds at a time.
STEP = 1 << 20
#: Characters that are written as escapes in JSON (fixed values).
ESCAPED = "<>&  "


def place(path: str) -> tuple[afs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return afs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (afs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    bytes: int
    sha256: str


def _plain(value):
    """Whole floats as integers, as the document has them."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() and abs(value) < 1e21 else value


def pretty(value, indent: int = 0) -> str:
    """JSON in two-space steps, its lines after the first set in by ``indent`` more."""
    text = json.dumps(_plain(value), indent=2, ensure_ascii=False)
    for c in ESCAPED:
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text.replace("\n", "\n" + " " * indent)


#: What a row becomes in a document of each kind, and what stands between two rows.
KINDS = {"json": (lambda line: "    " + pretty(json.loads(line), 4), ",\n"), "lines": (lambda line: line, "")}


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"].rstrip("/"), options.get("kind", "lines")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {sorted(KINDS)}")

    def write(self, iterator) -> Part:
        render, between = KINDS[self.kind]
        system, base = place(self.path)
        system.create_dir(base, recursive=True)
        name, rows, size, digest = f"part-{uuid.uuid4().hex}", 0, 0, hashlib.sha256()
        with system.open_output_stream(f"{base}/{name}") as out:
            for row in iterator:
                if row[0] is None:
                    continue
                data = ((between if rows else "") + render(row[0])).encode()
                out.write(data)
                digest.update(data)
                rows, size = rows + 1, size + len(data)
        return Part(TaskContext.get().partitionId(), name, rows, size, digest.hexdigest())

    def commit(self, messages) -> None:
        system, base = place(self.path)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        publish(self.path, {"kind": self.kind, "between": KINDS[self.kind][1], "rows": sum(p.rows for p in parts), "bytes": sum(p.bytes for p in parts), "parts": [asdict(p) for p in parts]})
        kept = {p.name for p in parts}
        for info in system.get_file_info(afs.FileSelector(base)):
            if info.base_name.startswith("part-") and info.base_name not in kept:
                system.delete_file(info.path)

    def abort(self, messages) -> None:
        system, base = place(self.path)
        for m in messages:
            if m is not None and system.get_file_info(f"{base}/{m.name}").type == afs.FileType.File:
                system.delete_file(f"{base}/{m.name}")


class DocumentSink(DataSource):
    """``spark.dataSource.register(DocumentSink)``, then ``df.write.format("audit_document").mode("append")`` with the options
    ``path`` and ``kind``; the first column is a row's line.  A write takes the place of the section that was there."""

    @classmethod
    def name(cls):
        return "audit_document"

    def schema(self):
        return "line string"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def publish(path: str, manifest: dict) -> None:
    """The manifest under a name of its own first, then moved into place."""
    system, base = place(path.rstrip("/"))
    system.create_dir(base, recursive=True)
    hidden = f"{base}/.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        out.write(json.dumps(manifest).encode())
    system.move(hidden, f"{base}/{MANIFEST}")


def manifest(path: str) -> dict:
    system, base = place(path.rstrip("/"))
    with system.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


def write_section(rows: DataFrame, path: str, kind: str) -> dict:
    """Writes the one column of ``rows`` in its order; returns the manifest."""
    rows.sparkSession.dataSource.register(DocumentSink)
    rows.write.format("audit_document").mode("append").option("path", path).option("kind", kind).save()
    return manifest(path)


def write_document(folder: str, chunks: list) -> dict:
    """A document of ``chunks``: text, or ``(name, rows, kind)`` for a section.  Its manifest is published when all parts stand."""
    out, size, rows = [], 0, 0
    for chunk in chunks:
        if isinstance(chunk, str):
            out.append({"text": chunk})
            size += len(chunk.encode())
            continue
        name, df, kind = chunk
        own = write_section(df, f"{folder}/{name}", kind)
        rows += own["rows"]
        for i, p in enumerate(own["parts"]):
            if i and own["between"]:
                out.append({"text": own["between"]})
                size += len(own["between"].encode())
            out.append({"file": f"{name}/{p['name']}", "bytes": p["bytes"], "sha256": p["sha256"]})
            size += p["bytes"]
    found = {"rows": rows, "bytes": size, "chunks": out}
    publish(folder, found)
    return found


def document_chunks(folder: str) -> Iterator[bytes]:
    """The published document, some bytes at a time; raises where a part isn't what its digest says."""
    system, base = place(folder.rstrip("/"))
    for chunk in manifest(folder)["chunks"]:
        if "text" in chunk:
            yield chunk["text"].encode()
            continue
        digest = hashlib.sha256()
        with system.open_input_stream(f"{base}/{chunk['file']}") as f:
            while data := f.read(STEP):
                digest.update(data)
                yield data
        if digest.hexdigest() != chunk["sha256"]:
            raise ValueError(f"{chunk['file']} is not what was written")


def assemble(folder: str, target: str) -> str:
    """The document as one file; returns its digest."""
    system, path = place(target)
    digest = hashlib.sha256()
    with system.open_output_stream(path) as out:
        for data in document_chunks(folder):
            digest.update(data)
            out.write(data)
    return digest.hexdigest()


# -- what the documents say ------------------------------------------------------------------------------------------


def _json(value: Column, skip_null: bool = False) -> Column:
    return F.to_json(value, {"ignoreNullFields": str(skip_null).lower()})


def _inside(value: Column) -> Column:
    """A struct's fields as JSON without the braces."""
    return F.substr(value, F.lit(2), F.length(value) - 2)


def _filled(name: str) -> Column:
    return F.nullif(F.col(name).cast("string"), F.lit("")).alias(name)


def page_json(entries: DataFrame) -> Column:
    """A page of the JSON report, its fields in order; empty dates, clusters and lists of the plan are left out."""
    have = set(entries.columns)
    text = lambda c, name=None: F.coalesce(F.col(c) if c in have else F.lit(None).cast("string"), F.lit("")).alias(name or c)
    number = lambda c, name=None: F.coalesce(F.col(c) if c in have else F.lit(0), F.lit(0)).alias(name or c)
    lead = F.struct(
        "url", F.coalesce(F.col("final_url") if "final_url" in have else F.lit(None).cast("string"), F.col("url")).alias("final_url"), text("title"), text("primary_label"), "secondary_labels", "confidence",
        text("suggested_action"), "priority", "affected_prompts",
        F.struct(F.coalesce("page_summary.current_focus", F.lit("")).alias("current_focus"), F.col("page_summary.should_focus_on").alias("should_focus_on")).alias("page_summary"), "findings",
    )
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    plan = F.when(F.col("edit_plan").isNotNull(), F.struct(F.coalesce("edit_plan.summary", F.lit("")).alias("summary"), *(some(f"edit_plan.{c}").alias(c) for c in ("preserve", "remove", "rewrite", "add"))))
    data = F.struct(
        number("word_count"), *(_filled(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("last_modified", "published_date")), number("inbound", "inbound_internal_links"), _filled("cluster_id").alias("duplicate_cluster_id"),
        number("attempt_count", "judge_attempts"), (rfc3339(F.col("judged_at")) if "judged_at" in have else F.lit(None).cast("string")).alias("judged_at"), *(number(c) for c in ("input_tokens", "cache_hit_tokens", "output_tokens", "latency_ms")),
    )
    out = F.concat(
        F.lit("{"), _inside(_json(lead)), F.lit(',"edit_plan":'), F.coalesce(_json(plan, True), F.lit("null")), F.lit(","), _inside(_json(F.struct(text("rationale")))), F.lit(',"metadata":'), _json(data, True), F.lit("}")
    )
    for c in ESCAPED:
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return out


def json_document(entries: DataFrame, clusters: DataFrame, failed: DataFrame, head: dict, folder: str) -> dict:
    """The JSON report: the fields of ``head``, then pages by priority, clusters and failures in their order, each a section."""
    e = entries.orderBy(F.desc("priority"), "url")
    sections = [
        ("pages", e.select(page_json(entries).alias("line"))),
        ("duplicate_clusters", clusters.orderBy("cluster_id").select(_json(F.struct("cluster_id", "canonical_url", "member_urls", "size", "avg_similarity")).alias("line"))),
        ("failures", failed.orderBy("phase", "url").select(_json(F.struct("url", "phase", "attempts", F.coalesce("last_error", F.lit("")).alias("last_error"))).alias("line"))),
    ]
    chunks: list = [pretty(head).removesuffix("\n}").removesuffix("{}") if head else "{"]
    for i, (name, rows) in enumerate(sections):
        empty = rows.isEmpty()
        chunks.append(("," if head or i else "") + f'\n  "{name}": ' + ("[]" if empty else "[\n"))
        if not empty:
            chunks += [(name, rows, "json"), "\n  ]"]
    return write_document(folder, [*chunks, "\n}\n"])


def csv_line(columns: list[Column]) -> Column:
    """A row of CSV: fields with a comma, a quote, a line's end or white space in front are quoted, quotes doubled, lines end in CR LF."""
    cell = lambda c: F.when((c == "\\.") | c.rlike(r'[",\r\n]') | c.rlike(r"^[\s\x85\xa0]"), F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\r\n")), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat(F.concat_ws(",", *(cell(F.coalesce(c, F.lit(""))) for c in columns)), F.lit("\r\n"))


def csv_document(entries: DataFrame, folder: str) -> dict:
    """The CSV report: its header, then pages by priority."""
    e = entries if "last_modified" in entries.columns else entries.withColumn("last_modified", F.lit(""))
    rows = e.orderBy(F.desc("priority"), "url")
    cells = csv_frame(rows)
    line = cells.select(csv_line([F.col(c) for c in CSV_COLUMNS]).alias("line"))
    return write_document(folder, [",".join(CSV_COLUMNS) + "\r\n", ("pages", line, "lines")])
