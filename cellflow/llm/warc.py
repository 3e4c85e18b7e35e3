"""Deterministic sharded WARC writer and reader.

Records are sorted by range, so that each partition is a run of page ids; a partition rolls to a new file when the compressed size reaches a
limit. Headers and digests are made anew from the payload. Each record is a gzip member of its own with a fixed time stamp, so equal input
gives equal bytes. A file is written under a temporary name that holds the attempt and then renamed; the manifest is written last and names
the files that count, so files of lost attempts do no harm.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, pick, shared_dir, ship

#: Compressed bytes after which a file is full, and payload bytes from which copies become revisits.
ROLL, REVISIT_FROM = 64_000_000, 100
#: Bytes that are read at a time, that are decompressed at a time, and of archives that a task reads.
BLOCK, STEP, TASK = 4_000_000, 16_384, 64_000_000
#: Fixed values of the WARC format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of all records: equal input gives equal files.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
NO_ID = -(1 << 63)


def clean(value: str) -> str:
    """A header's value can't hold line breaks."""
    return " ".join(value.split())


def record(page_id: int, url: str, payload: bytes, size: int, payload_digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit without."""
    kind = "response" if refers_to is None else "revisit"
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}"]
    block = "\r\n".join([*http, "", ""]).encode() + (payload if refers_to is None else b"")
    name = lambda p: f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{p}:{payload_digest}')}>"
    head = {
        "WARC-Type": kind, "WARC-Record-ID": name(page_id), "WARC-Date": DATE, "WARC-Target-URI": clean(url), "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{payload_digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "X-Page-Id": str(page_id), "X-Payload-Length": str(size),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(refers_to), "X-Refers-To-Page": str(refers_to)}
    head["Content-Length"] = str(len(block))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member; zlib writes no time stamp or name."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(blocks: Iterable[bytes]) -> Iterator[bytes]:
    """The gzip members of a file that is read in blocks. What is left of a block after a member's end is a view, so that many small members
    cost no copies of what follows them."""
    z, some = None, False
    out: list[bytes] = []
    for block in blocks:
        view = memoryview(block)
        while len(view):
            if z is None:
                z, some, out = zlib.decompressobj(31), False, []
            step = view[:STEP]
            out.append(z.decompress(step))
            some = True
            used = len(step) - len(z.unused_data)
            view = view[used:]
            if z.eof:
                yield b"".join(out)
                z = None
    if z is not None and some:
        raise ValueError("the file ends inside a record")


def parse(blocks: Iterable[bytes]) -> Iterator[dict]:
    """The records of a file in blocks; each is checked against its block digest, and a response also against its payload digest and length."""
    for raw in members(blocks):
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        h = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        block = rest[: int(h["Content-Length"])]
        if version.encode() != VERSION or f"sha256:{hashlib.sha256(block).hexdigest()}" != h["WARC-Block-Digest"]:
            raise ValueError(f"record {h.get('WARC-Record-ID')} is damaged")
        payload, sha, size = None, h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
        if h["WARC-Type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if hashlib.sha256(payload).hexdigest() != sha or len(payload) != size:
                raise ValueError(f"payload of {h['WARC-Record-ID']} is damaged")
        refers = h.get("X-Refers-To-Page")
        yield {"page_id": int(h["X-Page-Id"]), "url": h["WARC-Target-URI"], "payload": payload, "payload_bytes": size, "payload_digest": sha, "record_type": h["WARC-Type"], "refers_to": None if refers is None else int(refers)}


def records_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest) of each page; a null url or html is empty. digest is the SHA-256 of the html in UTF-8."""
    rows = pick(pages, page_id="long", url="string", html="string").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))


def write_warc(pages: DataFrame, path: str, partitions: int | None = None, roll: int = ROLL) -> DataFrame:
    """Write a record for each page below path and commit; returns the manifest (file, records, bytes, first_page, last_page).

    Of pages with equal payloads of at least REVISIT_FROM bytes that with the smallest page_id is the response (of rows that share it, one);
    a null payload is empty, a null url too, a null page_id counts as the smallest and is written as such (read back it is null, as is refers_to
    of its copies). An empty table gives no files. Payloads of any length are one record.
    """
    spark = pages.sparkSession
    rows = records_of(pages).withColumn("page_id", F.coalesce("page_id", F.lit(NO_ID)))
    told = rows.select("page_id", "digest", F.octet_length("html").alias("n"))
    many = told.where(F.col("n") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    # One row for each copy that must refer to another page; it meets its page's row in the sort, so html goes through one exchange.
    refer = told.where(F.col("n") >= REVISIT_FROM).join(many, "digest").select("page_id", "digest", "first").distinct()
    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("first")).unionByName(refer.select("page_id", "digest", F.lit(0).alias("kind"), F.lit("").alias("url"), F.lit("").alias("html"), "first"))
    ranged = both.repartitionByRange(partitions, "page_id") if partitions else both.repartitionByRange(F.col("page_id"))
    ordered = ranged.sortWithinPartitions("page_id", "digest", "kind", "url")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(path)
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        out, files = None, []
        referred, used = None, set()

        def close() -> None:
            nonlocal out
            if out is not None:
                out["to"].close()
                fs.move(out["temp"], f"{root}/{out['file']}")
                files.append((out["file"], out["records"], out["bytes"], out["first"], out["last"]))
                out = None

        for pdf in batches:
            for r in pdf.itertuples():
                if r.kind == 0:
                    referred, used = (r.page_id, r.digest, int(r.first)), set()
                    continue
                payload, first = r.html.encode("utf-8", "replace"), None
                if referred is not None and referred[:2] == (r.page_id, r.digest):
                    # The first page's own first row holds the payload.
                    if referred[2] != r.page_id or r.digest in used:
                        first = referred[2]
                    used.add(r.digest)
                data = member(record(r.page_id, r.url, payload, len(payload), r.digest, first))
                if out is not None and out["bytes"] + len(data) > roll:
                    close()
                if out is None:
                    name = f"part-{shard:05d}-{len(files):05d}.warc.gz"
                    temp = f"{root}/.tmp-{attempt}-{name}"
                    out = {"file": name, "temp": temp, "to": fs.open_output_stream(temp, compression=None), "records": 0, "bytes": 0, "first": r.page_id, "last": r.page_id}
                out["to"].write(data)
                out["records"], out["bytes"], out["last"] = out["records"] + 1, out["bytes"] + len(data), r.page_id
        close()
        yield pd.DataFrame(files, columns=["file", "records", "bytes", "first_page", "last_page"])

    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    manifest = keep(ordered.mapInPandas(write, "file string, records long, bytes long, first_page long, last_page long"), "manifest")
    lines = [json.dumps(r.asDict()) for r in manifest.orderBy("file").toLocalIterator()]  # a line for each file of about `roll` bytes
    with fs.open_output_stream(f"{root}/.tmp-manifest.json") as f:
        f.write("".join(x + "\n" for x in lines).encode())
    fs.move(f"{root}/.tmp-manifest.json", f"{root}/manifest.json")
    return manifest


def read_warc(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """The records of the files that the manifest names: page_id, url, payload (binary, null for a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    names = manifest if manifest is not None else spark.read.schema("file string, records long, bytes long, first_page long, last_page long").json(f"{path}/manifest.json")
    total, files = names.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(files, max(2 * spark.sparkContext.defaultParallelism, -(-total // TASK))))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(path)

        def blocks(f) -> Iterator[bytes]:
            while block := f.read(BLOCK):
                yield block

        for pdf in batches:
            for name in pdf["file"]:
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    rows, size = [], 0
                    for r in parse(blocks(f)):
                        rows.append(r)
                        size += r["payload_bytes"]
                        if size > 8_000_000:
                            yield _frame(rows)
                            rows, size = [], 0
                    yield _frame(rows)

    # Ranges of a hash deal the files evenly to that many tasks, which a stated number keeps from being merged.
    dealt = names.select("file", F.hash("file").alias("_h")).repartitionByRange(tasks, "_h", "file").select("file")
    out = dealt.mapInPandas(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(known("page_id"), "url", "payload", "payload_bytes", "payload_digest", "record_type", known("refers_to"))


def _frame(rows: list[dict]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return df.assign(refers_to=df["refers_to"].astype("Int64"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write to a new folder of the shared one, read back, and return the records without their payloads."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/cellflow-warc-{uuid.uuid4().hex}"
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    return read_warc(spark, path, write_warc(pages, path)).drop("payload", "url")


def oracle_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS least FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {REVISIT_FROM} AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT_FROM} AND page_id <> least THEN least END AS refers_to FROM f"""


ship(__name__)
