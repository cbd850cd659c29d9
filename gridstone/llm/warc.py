"""WARC archives with a two-level capture index.

Pages become WARC/1.1 records, each a gzip member of its own, in one file a task. Of
records with equal payloads the one with the largest page_id is a response, the
others revisit it. The index: captures sorted by reversed-host URL key and id are
packed into compressed blocks; each index file ends in a sparse directory that has the
first key of each block; a root has the first key of each file. A look-up searches
root and directory by bisection and reads one block's byte range, then the record's.

Only narrow rows are collected in one place: the root has one entry an index file, of
which there are at most INDEX_FILES. A task writes under a name of its own, and only
files that a finished task reports are used, so that a lost executor leaves no trace.

Defined cases: a null payload is empty; a null or odd url is kept as text; repeated
rows of the largest page_id are all responses; a null page_id counts as the smallest;
an empty table gives an empty archive; other columns play no part.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

MIN_BYTES = 0
BLOCK_LINES = 512
INDEX_FILES = 4096
#: The record type names and profile of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A task looks up or reads about so many rows, and so many bytes of records.
TASK_ROWS, TASK_BYTES, MOST_TASKS = 4096, 1 << 26, 50_000
ENTRY = "key string, page_id bigint, file string, offset bigint, length bigint"


def url_key(url: str | None) -> str:
    """The host's labels reversed and joined by commas, then ')' and the path with its query; no scheme, no www, no fragment."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url or ""
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + f"{port}){path.lower()}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(text: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+|null)>", text)
    return None if found[1] == "null" else int(found[1])


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {quote(url or '', safe=''.join(chr(c) for c in range(33, 127) if c != 37))}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What a record says, with the payload of a response and the payload's length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != stated):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": _page(fields["WARC-Record-ID"]), "url": unquote(fields["WARC-Target-URI"]), "kind": kind, "refers_to": _page(fields["WARC-Refers-To"]) if kind == "revisit" else None, "digest": stated, "payload_bytes": size, "payload": payload if kind == "response" else None}


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def _range(path: str, offset: int, length: int) -> bytes:
    system, at = _open(path)
    with system.open_input_file(at) as f:
        return f.read_at(length, offset)


def judged(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html with keeper: the page_id of the equal payload's response, or null where no other row has it."""
    df = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    df = df.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    same = df.filter(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = written(same.select(F.col("sha").alias("s"), "keeper"), "warc-same")
    return df.join(same, (F.col("sha") == F.col("s")) & (F.octet_length("html") >= min_bytes), "left").select("page_id", "url", "html", "keeper")


def write(pages: DataFrame, min_bytes: int = MIN_BYTES) -> dict:
    """Writes archives and index for pages(page_id, url, html); returns the root."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")

    def records(batches):
        system, at = _open(folder)
        system.create_dir(at, recursive=True)
        name, out, offset = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, keeper in zip(*(batch.column(k).to_pylist() for k in range(4))):
                kind = "revisit" if keeper is not None and page_id != keeper else "response"
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = pack.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), kind, keeper)) + pack.flush()
                out = out or system.open_output_stream(f"{at}/{name}", compression=None)
                out.write(raw)
                rows.append((url_key(url), page_id, name, offset, len(raw)))
                offset += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "offset", "length"]) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())], ["key", "page_id", "file", "offset", "length"])
        if out:
            out.close()

    entries = written(judged(pages, min_bytes).mapInArrow(records, ENTRY), "warc-entries")
    return {"folder": folder, "root": _index(spark, entries, folder)}


def _index(spark: SparkSession, entries: DataFrame, folder: str) -> list[dict]:
    def blocks(batches):
        system, at = _open(folder)
        name, out, offset, held, directory, last = f"index-{uuid.uuid4().hex}.cdx", None, 0, [], [], None

        def flush():
            nonlocal offset
            raw = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
            directory.append([held[0][0], held[0][1], offset, len(raw)])
            out.write(raw)
            offset += len(raw)
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                out = out or system.open_output_stream(f"{at}/{name}", compression=None)
                held.append(row)
                last = row
                if len(held) == BLOCK_LINES:
                    flush()
        if out:
            if held:
                flush()
            raw = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(raw)
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "first_key": directory[0][0], "first_id": directory[0][1], "last_key": last[0], "offset": offset, "length": len(raw), "blocks": len(directory)}])

    parts = min(INDEX_FILES, max(1, entries.count() // (64 * BLOCK_LINES)))
    ordered = entries.repartitionByRange(parts, "key", F.col("page_id").asc_nulls_first()).sortWithinPartitions("key", F.col("page_id").asc_nulls_first())
    root = written(ordered.mapInArrow(blocks, "file string, first_key string, first_id bigint, last_key string, offset bigint, length bigint, blocks bigint"), "warc-root")
    # Spark orders strings as UTF-8 bytes, Python by code points: the same order
    return sorted((r.asDict() for r in root.collect()), key=lambda r: (r["first_key"], r["first_id"] is not None, r["first_id"] or 0))


def _tasks(df: DataFrame, size=None) -> int:
    """How many tasks df(with size: bytes a row) wants. Narrow rows say little of the work they make, so that the number is given."""
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size) if size is not None else F.lit(0), F.lit(0))).first()
    return min(MOST_TASKS, max(1, -(-rows // TASK_ROWS), -(-int(total) // TASK_BYTES)))


def lookup(archive: dict, wanted: DataFrame) -> DataFrame:
    """Captures of wanted(url[, page_id]): key, page_id, file, offset, length. With page_id only that capture, else all of the URL's key."""
    folder, root = archive["folder"], archive["root"]
    exact = "page_id" in wanted.columns

    def find(batches):
        at: dict[str, list] = {}  # the directory and block in use; keys come sorted

        def directory(entry):
            if at.get("file") != entry["file"]:
                at.update(file=entry["file"], dir=json.loads(zlib.decompress(_range(f"{folder}/{entry['file']}", entry["offset"], entry["length"]))), block=None)
            return at["dir"]

        def block(entry, k):
            if at.get("block") != (entry["file"], k):
                _, _, offset, length = directory(entry)[k]
                at.update(block=(entry["file"], k), rows=[json.loads(x) for x in zlib.decompress(_range(f"{folder}/{entry['file']}", offset, length)).decode().split("\n")])
            return at["rows"]

        order = lambda key, pid: (key, pid is not None, pid or 0)
        tops = [order(r["first_key"], r["first_id"]) for r in root]
        for batch in batches:
            out, seen = [], None
            ids = batch.column(1).to_pylist() if exact else [None] * batch.num_rows
            for key, pid in zip(batch.column(0).to_pylist(), ids):
                if (key, pid) == seen:
                    continue
                seen = (key, pid)
                low = order(key, pid) if exact else (key, False, 0)
                f = max(bisect.bisect_left(tops, low) - 1, 0)
                done = False
                while f < len(root) and not done and root[f]["first_key"] <= key:
                    if root[f]["last_key"] >= key:
                        firsts = [order(k, p) for k, p, _, _ in directory(root[f])]
                        b = max(bisect.bisect_left(firsts, low) - 1, 0)
                        while b < len(firsts) and firsts[b][0] <= key and not done:
                            for row in block(root[f], b):
                                if row[0] == key and (not exact or row[1] == pid):
                                    out.append(row)
                                elif order(row[0], row[1]) > (order(key, pid) if exact else (key, True, float("inf"))):
                                    done = True
                                    break
                            b += 1
                    f += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "offset", "length"])

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())] + ([batch.column(1)] if exact else []), ["key"] + ["page_id"] * exact)

    asked = wanted.select("url", *([F.col("page_id").cast("bigint").alias("page_id")] if exact else []))
    keyed = written(asked.mapInArrow(keys, "key string" + ", page_id bigint" * exact).distinct(), "warc-keys")
    columns = ["key"] + ["page_id"] * exact
    return keyed.repartitionByRange(_tasks(keyed), *columns).sortWithinPartitions(*columns).mapInArrow(find, ENTRY)


def read_records(archive: dict, captures: DataFrame) -> DataFrame:
    """The records of captures, by range reads in file order: page_id, url, kind, refers_to, digest, payload_bytes, payload."""
    folder = archive["folder"]
    types = {"page_id": pa.int64(), "url": pa.string(), "kind": pa.string(), "refers_to": pa.int64(), "digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches):
        name, handle = None, None
        for batch in batches:
            rows, size = [], 0
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if file != name:
                    if handle:
                        handle.close()
                    system, at = _open(f"{folder}/{file}")
                    name, handle = file, system.open_input_file(at)
                rows.append(parse(zlib.decompress(handle.read_at(length, offset), 31)))
                size += rows[-1]["payload_bytes"]
                if size > 1 << 24:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(types.items()))
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(types.items()))
        if handle:
            handle.close()

    ordered = captures.select("file", "offset", "length").repartitionByRange(_tasks(captures, F.col("length")), "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page_id bigint, url string, kind string, refers_to bigint, digest string, payload_bytes bigint, payload binary")


def warc_report(pages: DataFrame) -> DataFrame:
    """Writes all pages, looks every one up in the index and reads its record back."""
    archive = write(pages)
    captures = written(lookup(archive, pages.select("url", "page_id")), "warc-captures")
    df = read_records(archive, captures)
    return df.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM k
"""
