"""WARC archives of captures, and their assembly back into one nested row per capture.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record; request and metadata
name the response as concurrent. Every record is a gzip member of its own.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.llm import shared

VERSION = b"WARC/1.1"
# Fixed value: the profile that the format defines for revisits.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_DECIDED = ("page_id", "url", "payload", "digest", "response_of", "response_url", "turn", "turns")
_MANIFEST = "file string, records long"
_RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, digest string, length long, payload binary"
_LENGTH = "payload_bytes"
#: Repeats of a row that are written as one row of a task; more go to further tasks.
_TURNS = 64


def _id(kind: str, page_id: int | None, url: str | None, digest: str, turn: int) -> str:
    """The record id follows from the page, its URL, its payload and the row's turn among equal rows, so a task
    that runs again writes the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, json.dumps([kind, page_id, url, digest, turn]))}>"


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], content: bytes) -> bytes:
    named = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *headers]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*named, ("Content-Length", str(len(content)))])
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + content + b"\r\n\r\n"


def capture(
    page_id: int | None, url: str | None, payload: bytes, digest: str, response_of: int | None,
    response_url: str | None = None, turn: int = 0,
) -> list[bytes]:
    """The records of one page; ``response_of`` and ``response_url`` are the page with an equal payload that it
    revisits, or null. Rows that are equal differ by ``turn``; the first one has 0 and is the one revisited."""
    own, place = _id("response", page_id, url, digest, turn), quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~")
    target = [("WARC-Target-URI", place)]
    digests = [("WARC-Payload-Digest", f"sha1:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    message = [("Content-Type", "application/http; msgtype=response")]
    if response_of is None:
        main = _record("response", own, target + digests + message, http + payload)
    else:
        earlier = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id("response", response_of, response_url, digest, 0))]
        main = _record("revisit", own, target + digests + earlier + message, http)
    asked = f"GET {place or '/'} HTTP/1.1\r\n\r\n".encode()
    together = [("WARC-Concurrent-To", own)]
    request = [*target, *together, ("Content-Type", "application/http; msgtype=request")]
    facts = {"page_id": page_id, "url": url, _LENGTH: len(payload), "refers_to": response_of}
    about = [*target, *together, ("Content-Type", "application/json")]
    return [
        _record("request", _id("request", page_id, url, digest, turn), request, asked),
        main,
        _record("metadata", _id("metadata", page_id, url, digest, turn), about, json.dumps(facts).encode()),
    ]


def decide(pages: DataFrame, page_id: str, payload: str, least: int, each_row: bool) -> DataFrame:
    """``page_id, url, payload, digest, response_of, response_url, turn, turns``: which earlier payload each page
    repeats, and from which turn on how many captures it gets.

    Only pages whose payload others share, or rows that are repeated, are joined back, by small rows without payloads. With
    ``each_row`` equal rows become one per ``_TURNS`` of them, so that no task gets all of a large group.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    read = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    keys = ("page_id", "url", "digest")
    rows = read.groupBy(*keys, (F.length("payload") >= least).alias("large")).agg(F.count("*").alias("n"))
    last = F.max(F.struct("page_id", "url"))
    groups = rows.filter("large").groupBy("digest").agg(last.alias("last"), F.count("*").alias("m")).filter("m > 1")
    other = F.col("last.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last.page_id"))
    if each_row:
        other = other & F.col("page_id").isNotNull()
    told = rows.join(groups.drop("m"), "digest", "left").select(
        *[F.col(k).alias(f"r_{k}") for k in keys],
        F.when(other, F.col("last.page_id")).alias("response_of"),
        F.when(other, F.col("last.url")).alias("response_url"),
        (F.col("n") if each_row else F.lit(1).cast("long")).alias("n"),
    )
    told = shared.stored(told.filter("response_of IS NOT NULL OR n > 1"), "repeats")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    names = (*keys, "payload", "response_of", "response_url")
    alone = read.join(told, same, "left").filter("n IS NULL OR n = 1")
    alone = alone.select(*names, F.lit(0).cast("long").alias("turn"), F.lit(1).cast("long").alias("turns"))
    if not each_row:
        return alone
    # Equal rows hold equal payloads, so one of them and their number say all.
    equal = read.join(told.filter("n > 1"), same).groupBy(*keys, "response_of", "response_url", "n")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_TURNS).cast("long")))
    equal = equal.agg(F.first("payload").alias("payload")).withColumn("turn", starts)
    equal = equal.withColumn("turns", F.least(F.lit(_TURNS).cast("long"), F.col("n") - F.col("turn")))
    return alone.unionByName(equal.select(*names, "turn", "turns").repartition(*keys, "turn"))


def write(
    pages: DataFrame, directory: str, page_id: str = "page_id", payload: str = "html", least: int = 1000, level: int = 3,
    file_bytes: int = 32_000_000, each_row: bool = False,
) -> DataFrame:
    """Write a capture per page under ``directory``; returns the manifest, a row per file.

    Of the pages with equal payloads of at least ``least`` bytes the one with the largest id is a response and the
    others revisit it; all other pages are responses. A null payload is empty; a null URL is an empty target. A null id is a
    page of its own per URL and payload, and never the one that others revisit unless it is the only kind. Rows that share id and payload
    but not the URL are captures of their own. Rows that repeat all three are captures of their own with ``each_row``, as in the SQL, where null ids revisit
    nothing either; without, they write the same records again, which readers take for one. ``url`` must be a column; further columns are ignored. An empty table
    gives no files. A task that runs again writes the same files under the same names.
    """
    from pyarrow import fs

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(directory)
        system.create_dir(root, recursive=True)
        part, number, out, written, records = TaskContext.get().partitionId(), 0, None, 0, 0
        name = attempt = ""

        def close() -> pa.RecordBatch:
            out.close()
            system.move(attempt, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([records], pa.int64())})

        for batch in batches:
            columns = [batch[c] for c in _DECIDED]
            for *row, turn, turns in ([cell.as_py() for cell in cells] for cells in zip(*columns)):
                for own in range(turn, turn + turns):
                    if out is None:
                        name = f"captures-{part:07d}-{number:05d}.warc.gz"
                        attempt = f"{root}/.{name}-{TaskContext.get().taskAttemptId()}"
                        out, written, records = system.open_output_stream(attempt, compression=None), 0, 0
                    for record in capture(*row, own):
                        member = gzip.compress(record, level, mtime=0)
                        out.write(member)
                        written, records = written + len(member), records + 1
                    if written >= file_bytes:
                        yield close()
                        out, number = None, number + 1
        if out is not None:
            yield close()

    decided = decide(pages, page_id, payload, least, each_row).select(*_DECIDED)
    return shared.stored(decided.mapInArrow(files, _MANIFEST), "manifest")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and content of every record of an archive, compressed or not."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read(spark: SparkSession, directory: str, payloads: bool = True) -> DataFrame:
    """A row per record: ids, kind, target, payload digest (of a response computed from what was read), payload length and payload.

    Without ``payloads`` contents are read and digested but not kept, but for metadata.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "captures-*.warc.gz").load(directory)
    names = [c.split()[0] for c in _RECORD.split(", ")]
    types = (*[pa.string()] * 6, pa.int64(), pa.binary())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"]:
                held, size = [], 0
                for headers, content in records(data.as_buffer().to_pybytes()):
                    kind, digest, length = headers["warc-type"], None, None
                    body = content
                    if kind in ("response", "revisit"):
                        body = content.partition(b"\r\n\r\n")[2]
                        digest = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
                    if kind == "response":
                        digest, length = hashlib.sha1(body).hexdigest(), len(body)
                    kept = body if payloads or kind == "metadata" else None
                    held.append((
                        headers["warc-record-id"], kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
                        headers.get("warc-target-uri"), digest, length, kept,
                    ))
                    size += len(kept or b"") + 300
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    return found.select("content").mapInArrow(rows, _RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, response, request, metadata``, each a record or null.

    Records join through the id that they are concurrent to; a response is concurrent to itself. A record that names
    nothing stands alone. Records that share an id are one. A request or metadata record whose response is missing gives a capture without
    a response.
    """
    fields = ("record_id", "type", "refers_to", "uri", "digest", "length", "payload")

    def of(*kinds: str):
        return F.first(F.when(F.col("type").isin(*kinds), F.struct(*fields)), ignorenulls=True)

    # One record of each kind is held per capture, however often it was written.
    return found.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        of("response", "revisit").alias("response"),
        of("request").alias("request"),
        of("metadata").alias("metadata"),
    )


def facts(captures: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of assembled captures."""
    about = F.col("metadata.payload").cast("string")

    def fact(name: str):
        return F.get_json_object(about, f"$.{name}").cast("long")

    return captures.select(
        fact("page_id").alias("page_id"),
        F.coalesce(F.col("response.length"), fact(_LENGTH)).alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        fact("refers_to").alias("refers_to"),
    )
