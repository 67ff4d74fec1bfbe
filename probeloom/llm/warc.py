"""WARC archives with a two-level capture index.

Tasks write gzipped WARC files into the shared folder and report where each
record lies. Captures are then sorted by reversed-host URL key over all tasks;
every task writes one index file of compressed blocks followed by a sparse
directory (the first capture of each block). A reader bisects the list of index
files, then one directory, then one block, and reads just the bytes of a record.

Files have a name of their own per task attempt and count only when listed, so a
lost executor leaves nothing that is read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_right
from collections import OrderedDict
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.llm.common import attach_group_facts, table
from probeloom.session import bounded_rows, materialize, new_folder

ARCHIVE_BYTES = 64 * 1024 * 1024
BLOCK_LINES = 300
# Payloads from this size on can be stored as a revisit of an equal one.
LEAST_REVISIT = 100
# Archive bytes that one task indexes or reads back.
TASK_BYTES = 8 * 1024 * 1024
# Index files of one archive set; one per task that sorts captures.
MAX_INDEX_FILES = 100_000
OPEN_FILES = 16
KEPT_BLOCKS = 64
DATE = "2000-01-01T00:00:00Z"

CAPTURE = "key string, page_id long, path string, position long, size long"
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, stored_digest string")


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", uri)
    return (pa.fs.LocalFileSystem(), local) if local.startswith("/") else pa.fs.FileSystem.from_uri(uri)


def one_line(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``com,example,www)/a?b=c``.

    The scheme, user, fragment and a port that the scheme implies are left out. What is no URL
    follows a bare ``)``; a null URL has an empty key.
    """
    if url is None:
        return ""
    text = one_line(url)
    try:
        parts = urlsplit(text)
        host, port = parts.hostname, parts.port
    except ValueError:
        return ")" + text
    if not host:
        return ")" + text
    named = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    return ",".join(reversed(host.split("."))) + named + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


# --- writing -------------------------------------------------------------------


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + b"\r\n" if revisit else http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_decisions(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to, revisit.

    Of equal payloads of LEAST_REVISIT bytes or more the smallest page_id is the
    response. Rows that repeat its id are responses too.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest")
    )
    groups = materialize(rows.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")
    ), "payloads")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    both = attach_group_facts(rows, groups, "digest", "copies", total)
    revisit = (F.octet_length("html") >= LEAST_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return both.select(
        "page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit")
    )


def write_archives(pages: DataFrame) -> DataFrame:
    """Writes WARC files; one stored row (key, page_id, path, position, size) per record."""
    folder = new_folder(pages.sparkSession, "warc")

    def run(batches):
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        sink, path = None, ""
        try:
            for batch in batches:
                for low in range(0, batch.num_rows, 256):
                    found = []
                    for r in batch.slice(low, 256).to_pylist():
                        if sink is None or sink.tell() >= ARCHIVE_BYTES:
                            if sink is not None:
                                sink.close()
                            path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                            sink = system.open_output_stream(path, compression=None)
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        raw = record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"], r["revisit"])
                        data = packer.compress(raw) + packer.flush()
                        found.append((url_key(r["url"]), r["page_id"], path, sink.tell(), len(data)))
                        sink.write(data)
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                        pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()),
                    ], ["key", "page_id", "path", "position", "size"])
        finally:
            if sink is not None:
                sink.close()

    return materialize(with_decisions(pages).mapInArrow(run, CAPTURE), "captures")


def place(key: str, page_id: int | None) -> tuple:
    """Order of captures: bytes of the key, then page ids with nulls first."""
    return key.encode(), page_id is not None, page_id or 0


def line(key: str, page_id, path: str, position: int, size: int) -> str:
    return f"{key}\t{'' if page_id is None else page_id}\t{path}\t{position}\t{size}"


def parsed(text: str) -> tuple:
    key, page_id, path, position, size = text.split("\t")
    return place(key, int(page_id) if page_id else None), path, int(position), int(size)


def tasks(captures: DataFrame) -> int:
    """Tasks in proportion to the archives: the rows of a capture are few, its bytes are not."""
    return max(1, -(-(captures.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES))


def build_index(captures: DataFrame) -> list[tuple]:
    """Writes the index files; (first place, path, directory position and size) of each, in order."""
    folder = new_folder(captures.sparkSession, "index")

    def run(batches):
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        path, sink, waiting, directory, first = f"{root}/{uuid.uuid4().hex}.idx", None, [], [], None

        def flush():
            data = zlib.compress("\n".join(waiting).encode())
            key, page_id = waiting[0].split("\t")[:2]
            directory.append(f"{key}\t{page_id}\t\t{sink.tell()}\t{len(data)}")
            sink.write(data)
            waiting.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if sink is None:
                    sink, first = system.open_output_stream(path, compression=None), (r["key"], r["page_id"])
                waiting.append(line(**r))
                if len(waiting) == BLOCK_LINES:
                    flush()
        if sink is not None:
            if waiting:
                flush()
            at, data = sink.tell(), zlib.compress("\n".join(directory).encode())
            sink.write(data)
            sink.close()
            yield pa.RecordBatch.from_pylist([
                {"key": first[0], "page_id": first[1], "path": path, "position": at, "size": len(data)}
            ], schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("position", pa.int64()), ("size", pa.int64())]))

    in_order = captures.repartitionByRange(tasks(captures), "key", "page_id").sortWithinPartitions("key", "page_id", "path", "position")
    files = materialize(in_order.mapInArrow(run, CAPTURE), "index-files")
    rows = bounded_rows(files, MAX_INDEX_FILES, "index files")
    return sorted((place(r["key"], r["page_id"]), r["path"], r["position"], r["size"]) for r in rows)


# --- reading -------------------------------------------------------------------


class Reader:
    """Looks captures up and reads records. Holds a bounded number of blocks and open files."""

    def __init__(self, folder: str, files: list[tuple]):
        self.system = file_system(folder)[0]
        self.files, self.firsts = files, [f[0] for f in files]
        self.blocks, self.open = OrderedDict(), OrderedDict()

    def bytes_at(self, path: str, position: int, size: int) -> bytes:
        if path not in self.open:
            if len(self.open) >= OPEN_FILES:
                self.open.popitem(last=False)[1].close()
            self.open[path] = self.system.open_input_file(path)
        return self.open[path].read_at(size, position)

    def lines(self, path: str, position: int, size: int) -> list[tuple]:
        at = (path, position)
        if at not in self.blocks:
            if len(self.blocks) >= KEPT_BLOCKS:
                self.blocks.popitem(last=False)
            text = zlib.decompress(self.bytes_at(path, position, size)).decode()
            self.blocks[at] = [parsed(x) for x in text.split("\n")]
        return self.blocks[at]

    def captures(self, key: str, page_id: int | None = None, every: bool = False):
        """Captures of a key and page id, or with ``every`` of a key."""
        low = place(key, None if every else page_id)
        belongs = (lambda p: p[0] == low[0]) if every else (lambda p: p == low)
        # Repeats of a place can start in an earlier block or file.
        f = max(0, self._before(self.firsts, low))
        while f < len(self.files) and (self.firsts[f] <= low or belongs(self.firsts[f])):
            _, path, position, size = self.files[f]
            directory = self.lines(path, position, size)
            firsts = [d[0] for d in directory]
            b = max(0, self._before(firsts, low))
            while b < len(directory) and (firsts[b] <= low or belongs(firsts[b])):
                for found in self.lines(path, directory[b][2], directory[b][3]):
                    if belongs(found[0]):
                        yield found
                b += 1
            f += 1

    @staticmethod
    def _before(firsts: list, low: tuple) -> int:
        """The last entry that starts strictly before ``low``."""
        at = bisect_right(firsts, low) - 1
        while at > 0 and firsts[at] == low:
            at -= 1
        return at

    def record(self, path: str, position: int, size: int) -> dict:
        raw = zlib.decompress(self.bytes_at(path, position, size), 31)
        head, rest = raw.split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[:int(fields["Content-Length"])]
        return fields | {"payload": block.split(b"\r\n\r\n", 1)[1]}


def read_back(captures: DataFrame, files: list[tuple], wanted: DataFrame, every: bool = False) -> DataFrame:
    """Records of the wanted (url, page_id) rows, found through the index.

    With ``every`` all captures of each wanted URL. A wanted row that was never captured gives none.
    ``wanted`` is sorted by URL, so neighbours share blocks.
    """
    import hashlib

    folder = new_folder(captures.sparkSession, "none")

    def keyed(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array([url_key(r["url"]) for r in rows], pa.string()), pa.array([r["page_id"] for r in rows], pa.int64())
            ], ["key", "page_id"])

    def run(batches):
        reader = Reader(folder, files)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(low, 256).to_pylist():
                    for _, path, position, size in reader.captures(r["key"], r["page_id"], every):
                        x = reader.record(path, position, size)
                        response = x["WARC-Type"] == "response"
                        stored, page = x["WARC-Payload-Digest"].removeprefix("sha256:"), x.get("X-Page-Id")
                        refers = re.sub(r"\D", "", x.get("WARC-Refers-To", ""))
                        out.append({
                            "page_id": int(page) if page else None, "url": x.get("WARC-Target-URI"),
                            "payload_bytes": len(x["payload"]) if response else int(x["X-Payload-Bytes"]),
                            "payload_digest": hashlib.sha256(x["payload"]).hexdigest() if response else stored,
                            "record_type": x["WARC-Type"], "refers_to": int(refers) if refers else None, "stored_digest": stored,
                        })
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=RECORD_SCHEMA)

    keys = wanted.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(keyed, "key string, page_id long")
    columns = ["key"] if every else ["key", "page_id"]
    if every:
        keys = keys.select("key", F.lit(None).cast("long").alias("page_id"))
    spread = keys.distinct().repartitionByRange(tasks(captures), *columns).sortWithinPartitions(*columns)
    return spread.mapInArrow(run, RECORD)


RECORD_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("stored_digest", pa.string()),
])


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes a record per page, indexes them and reads every page back.

    Null html is an empty payload; null URLs and page ids are kept as such.
    Repeated rows give a record each. An empty table gives no rows. Other columns are ignored.
    """
    captures = write_archives(pages.select("page_id", "url", "html"))
    return read_back(captures, build_index(captures), pages.select("page_id", "url"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_and_read(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        q AS (SELECT page_id, strlen(t) AS n, sha256(t) AS d, min(page_id) OVER (PARTITION BY t) AS first FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM q""",
}
