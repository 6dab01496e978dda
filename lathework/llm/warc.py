"""WARC archives, index first: write records, index them, read selected ones by coalesced byte ranges.

Each task writes the records of its rows to one archive file in the shared folder, every record a
gzip member of its own, and returns an index row for each: file, offset, length, URL, digest. The
index is a written table; files of failed attempts are in no index and so never read. Reading takes
index rows, sorts them by file and offset, joins ranges that lie close together into one read each,
and parses the records. Payloads that repeat are stored once: the record with the largest id is the
response, the others are revisits that name it.

Defined results: a null payload is empty; payloads under ``least`` bytes are always responses; a null id
is written as such, and gives way to any other id as response; of rows of one id with equal
payloads all are responses if that id is the largest; a null URL is written as empty; an empty table
gives an empty index; other columns are left out.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import shared_path, spread, stash, store

#: Payloads of at least so many bytes are stored once.
LEAST = 1000
#: Ranges of one file that lie at most so many bytes apart are read at once, up to so many bytes in all.
GAP, SPAN = 64 << 10, 8 << 20
#: Bytes of archives that a task reads.
TASK = 32 << 20
INDEX = "path string, offset long, length long, url string, digest string, record_type string, record_id long, refers_to long"


def record(kind: str, record_id: int | None, url: str, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record, compressed on its own."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if record_id is None else record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", 6, mtime=0)


def parse(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case, and the payload, of one record."""
    head, _, rest = gzip.decompress(block).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return {k.lower(): v for k, v in fields.items()}, rest[: int(fields["Content-Length"])]


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write all rows as archives in the shared folder; returns the written index."""
    folder = shared_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # Which ids repeat a payload: ids and digests alone are dealt out, pre-aggregated by digest.
    large = rows.filter(F.octet_length("payload") >= least).select("record_id", "digest")
    first = large.groupBy("digest").agg(F.max("record_id").alias("to"), F.count("*").alias("n")).filter("n > 1").select("digest", "to")
    again = spread(large, first, "digest").filter("record_id <> to OR record_id IS NULL AND to IS NOT NULL").select("record_id", F.col("digest").alias("_digest"), "to").distinct()
    same = F.col("record_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    marked = rows.join(again.withColumnRenamed("record_id", "_id"), same, "left").select("record_id", "url", "payload", "digest", F.col("to").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        name = f"{folder}/part-{at.partitionId():06d}-{at.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, offset = None, 0
        for batch in batches:
            index = []
            for i, url, body, digest, to in zip(*batch.columns):
                i, url, digest, to = i.as_py(), url.as_py(), digest.as_py(), to.as_py()
                kind = "response" if to is None else "revisit"
                block = record(kind, i, url, digest, body.as_py(), to)
                if out is None:
                    disk, path = store(name)
                    disk.create_dir(path.rpartition("/")[0], recursive=True)
                    out = disk.open_output_stream(path, compression=None)
                out.write(block)
                index.append((name, offset, len(block), url, digest, kind, i, to))
                offset += len(block)
            if index:
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), types)], [x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return stash(marked.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """(record_id, url, record_type, digest, refers_to, payload) of the records that the index rows name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fetch(path: str, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            disk, at = store(path)
            with disk.open_input_file(at) as f:
                start = ranges[0][0]
                block = f.read_at(ranges[-1][0] + ranges[-1][1] - start, start)
            out = []
            for offset, length in ranges:
                head, payload = parse(block[offset - start : offset - start + length])
                ids = [head.get(k, "").removeprefix("<urn:x-page:").removesuffix(">") for k in ("warc-record-id", "warc-refers-to")]
                own, to = (int(x) if x else None for x in ids)
                out.append((own, head["warc-target-uri"], head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), to, payload))
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["record_id", "url", "record_type", "digest", "refers_to", "payload"])

        path, ranges = "", []
        for batch in batches:
            for p, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                end = ranges[-1][0] + ranges[-1][1] if ranges else 0
                if ranges and (p != path or offset - end > gap or offset + length - ranges[0][0] > span):
                    yield fetch(path, ranges)
                    ranges = []
                path = p
                ranges.append((offset, length))
        if ranges:
            yield fetch(path, ranges)

    # Tasks are cut by the bytes of archives that they read; the index rows themselves are few bytes.
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(total // TASK, min(total // GAP, index.sparkSession.sparkContext.defaultParallelism), 1)
    near = index.select("path", "offset", "length").repartitionByRange(int(tasks), "path", "offset").sortWithinPartitions("path", "offset")
    return near.mapInArrow(run, "record_id long, url string, record_type string, digest string, refers_to long, payload binary")


def payload_sizes(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a revisit has the size of its response.

    The size travels with the digest, which a revisit shares with its response.
    """
    own = stash(
        records.select("record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("size"), F.col("digest"), F.sha1("payload").alias("found")),
        "warc-read",
    )
    full = own.filter("record_type = 'response'").select("record_id", "size", F.col("found").alias("digest"))
    sizes = own.filter("record_type = 'revisit'").select("refers_to", "digest").distinct()
    sizes = sizes.join(full, (sizes["refers_to"] == full["record_id"]) & (sizes["digest"] == full["digest"])).select(sizes["refers_to"].alias("_to"), sizes["digest"].alias("_digest"), F.col("size").alias("_size")).distinct()
    response = own.filter("record_type = 'response'").select(F.col("record_id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("found").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisit = own.filter("record_type = 'revisit'").join(sizes, (F.col("refers_to") == F.col("_to")) & (F.col("digest") == F.col("_digest")))
    return response.union(revisit.select("record_id", "_size", "digest", "record_type", "refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages and read all of them back."""
    return payload_sizes(read(write(pages)))
