"""A Spark data source that fetches pages: a partition a host, each with its own rate, agent name, size limit and retries."""

from __future__ import annotations

import gzip
import io
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow.parquet as pq
from pyarrow import fs as afs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.retry import Action, ExhaustedError, Retry, TokenBucket
from ..schemas import RETRYABLE_STATUS

MAX_BODY = 5 << 20
AGENT = "corpuslens/1"


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Bucket(InputPartition):
    """Files of urls, of whose hosts one task takes the ``bucket``-th of ``buckets`` shares."""

    def __init__(self, files: list[str], bucket: int, buckets: int):
        self.files, self.bucket, self.buckets = files, bucket, buckets


class _Fetcher:
    def __init__(self, options: dict):
        self.rate, self.agent = float(options.get("rate", 2)), options.get("agent", AGENT)
        self.timeout, self.attempts = float(options.get("timeout", 30)), int(options.get("attempts", 5))

    def fetch(self, url: str, bucket: TokenBucket) -> tuple:
        got: list[tuple] = []

        def one(attempt: int):
            bucket.wait()
            request = urllib.request.Request(url, headers={"User-Agent": self.agent, "Accept-Encoding": "gzip"})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    # As HTTP: status, final url, headers; files have none.
                    body = r.read(MAX_BODY + 1)
                    if body[:2] == b"\x1f\x8b" and (r.headers.get("Content-Encoding", "").lower() == "gzip" or url.endswith(".gz")):
                        body = gzip.GzipFile(fileobj=io.BytesIO(body)).read(MAX_BODY + 1)
                    got.append((url, r.geturl(), getattr(r, "status", None) or 200, r.headers.get("Content-Type", ""), body[:MAX_BODY].decode("utf-8", "replace"), len(body) > MAX_BODY, None))
                    return Action.DONE, 0.0, None
            except urllib.error.HTTPError as e:
                got.append((url, e.geturl(), e.code, e.headers.get("Content-Type", ""), None, False, f"status={e.code}"))
                wait = e.headers.get("Retry-After", "")
                return (Action.RETRY if e.code in RETRYABLE_STATUS else Action.ABORT), float(wait) if wait.isdigit() else 0.0, e
            except (OSError, EOFError) as e:
                got.append((url, None, None, None, None, False, str(e)))
                return (Action.RETRY if isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError) else Action.ABORT), 0.0, e

        try:
            Retry(self.attempts, sleep=time.sleep).run(one)
        except (ExhaustedError, OSError, EOFError):
            pass  # the last row tells the error
        return got[-1]


class _Reader(_Fetcher, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.urls = [u for u in options.get("urls", "").split() if u]

    def partitions(self):
        by_host: dict[str, list[str]] = {}
        for u in self.urls:
            by_host.setdefault(host(u), []).append(u)
        return [_Host(v) for v in by_host.values()]

    def read(self, partition):
        bucket = TokenBucket(self.rate)
        for url in partition.urls:
            yield self.fetch(url, bucket)


def host(url: str) -> str:
    return urlsplit(url).netloc.lower()


class _StreamReader(_Fetcher, DataSourceStreamReader):
    """Files of the url table in the order of their names; an offset is how many of them are done.

    The driver lists names and reads no urls.  Each task reads the new files' urls and fetches those of its share of
    hosts, so a host has one task, and one rate.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.table, self.buckets, self.column = options["table"].rstrip("/"), int(options.get("buckets", 8)), options.get("column", "url")

    def _files(self) -> list[str]:
        system, base = _place(self.table)
        found = system.get_file_info(afs.FileSelector(base, allow_not_found=True))
        return sorted(i.base_name for i in found if i.type == afs.FileType.File and not i.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self._files())}

    def partitions(self, start: dict, end: dict) -> list[_Bucket]:
        files = self._files()[start["files"] : end["files"]]
        return [_Bucket(files, b, self.buckets) for b in range(self.buckets)] if files else []

    def urls(self, partition: _Bucket) -> Iterator[str]:
        system, base = _place(self.table)
        for name in partition.files:
            with system.open_input_file(f"{base}/{name}") as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=[self.column]):
                    for url in batch.column(0).to_pylist():
                        if url and zlib.crc32(host(url).encode()) % partition.buckets == partition.bucket:
                            yield url

    def read(self, partition: _Bucket):
        limits: dict[str, TokenBucket] = {}
        for url in self.urls(partition):
            yield self.fetch(url, limits.setdefault(host(url), TokenBucket(self.rate)))


def _place(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (afs.LocalFileSystem(), path)


class PageSource(DataSource):
    """``spark.dataSource.register(PageSource)``, then ``spark.read.format("audit_pages").option("urls", ...)`` for a few urls,
    parted by white space.

    ``spark.readStream`` takes the option ``table``, a folder of Parquet files with a column of urls (``column``), to which
    files are added under names that sort after those there.  Its offsets are in the stream's checkpoint: what is stopped
    goes on with the files that no batch has ended, and a sink of the same checkpoint has each row of a file once.
    """

    @classmethod
    def name(cls):
        return "audit_pages"

    def schema(self):
        return "url string, final_url string, status_code int, content_type string, html string, truncated boolean, error string"

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)
