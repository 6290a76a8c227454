"""Operator 6: WARC archives compressed record by record with a dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, staged

# fixed values: the frame that holds the dictionary, and the media and profile names of the format
SKIPPABLE_MAGIC = 0x184D2A5D
HTTP_TYPE = "application/http;msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # records say nothing of when the job ran

DICT_BYTES, SAMPLE_BYTES, FILE_BYTES, LEVEL = 64 << 10, 4 << 20, 64 << 20, 3
WARC = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def revisits(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): among equal payloads of ``min_bytes`` or more the largest page_id is
    the response (refers_to null) and the others revisit it. Payloads are equal when their bytes are, and are found by
    SHA-1 and length. A null id is below any other; rows that repeat the largest id are all responses."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumns({"digest": F.sha1("payload"), "n": F.length("payload")})
    top = p.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("many"))
    top = staged(top.where("many > 1 and top is not null").select("digest", "n", "top"), "repeated-payloads")
    out = p.join(top, ["digest", "n"], "left")
    return out.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def _record_id(page) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page_of(record_id: str):
    name = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def record(page, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, which tells the payload's length, and leaves out the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += [f"Content-Type: {HTTP_TYPE}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]):
    """A dictionary from records; where they are too few to train one, the records' own bytes serve as content."""
    import zstandard as z

    try:
        return z.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 10)), samples)
    except z.ZstdError:
        return z.ZstdCompressionDict(b"".join(s[:4096] for s in samples)[:DICT_BYTES] or b"WARC/1.1\r\n", dict_type=z.DICT_TYPE_RAWCONTENT)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``revisits`` rows as .warc.zst files below ``folder`` (a URI all machines share); returns one row (path,
    n_records, n_bytes) per file. Names carry the task attempt, so a task that runs again leaves the first files unlisted."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard as z
        from pyspark import TaskContext

        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        ctx, seq, done = TaskContext.get(), 0, []
        waiting: list[bytes] = []
        size = out = packer = None

        def start():
            nonlocal out, packer, seq, size
            d = dictionary(waiting)
            raw, params = d.as_bytes(), z.ZstdCompressor(level=LEVEL, dict_data=d)
            name = f"{root}/part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{seq}.warc.zst"
            out, packer, seq, size = fs.open_output_stream(name, compression=None), params, seq + 1, 0
            out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
            info = b"software: attesta\r\nformat: WARC File Format 1.1\r\n"
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            out.write(packer.compress(head.encode() + info + b"\r\n\r\n"))
            done.append([name, 0, 0])

        def put(r: bytes):
            nonlocal size
            out.write(packer.compress(r))
            size += len(r)
            done[-1][1] += 1
            done[-1][2] += len(r)

        def flush():
            if waiting:
                if out is None:
                    start()
                for r in waiting:
                    put(r)
                waiting.clear()

        held = 0
        for batch in batches:
            for cols in zip(*(c for c in batch.columns), strict=True):
                r = record(*(c.as_py() for c in cols))
                if out is not None and size > FILE_BYTES:
                    out.close()
                    out = None
                if out is not None:
                    put(r)
                    continue
                waiting.append(r)
                held += len(r)
                if held >= SAMPLE_BYTES:
                    flush()
                    held = 0
        flush()
        if out is not None:
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "n_records", "n_bytes"])

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, n_records long, n_bytes long")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open .warc.zst file, streamed; the dictionary comes from the first frame."""
    import zstandard as z

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the file does not begin with a dictionary frame")
    reader = io.BufferedReader(z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(stream.read(size))).stream_reader(stream, read_across_frames=True), 1 << 20)
    while first := reader.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        headers = {}
        while (line := reader.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            headers[k] = v
        block = reader.read(int(headers["Content-Length"]))
        if reader.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


def read_archives(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the listed files. Digests are recomputed from response payloads and must agree with the headers;
    a revisit's length and digest are those that its record states."""
    schema = WARC + (", payload binary" if payloads else "")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, _ = _filesystem(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payloads
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for headers, block in read_records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        size = int(head.decode().rpartition("Content-Length: ")[2])
                        if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
                        url = headers.get("WARC-Target-URI")
                        url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                        ref = headers.get("WARC-Refers-To")
                        rows.append((_page_of(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], _page_of(ref) if ref else None, url) + ((payload,) * payloads))
                        held += len(payload)
                        if len(rows) >= 10_000 or payloads and held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path").mapInArrow(run, schema)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, min_bytes: int = 1000, payloads: bool = False) -> DataFrame:
    """Write ``pages`` as archives and read them back. An empty table writes no file and gives no rows."""
    folder = folder or f"{shared_dir(spark)}/attesta/warc-{uuid.uuid4().hex}"
    files = staged(write_archives(revisits(pages, min_bytes), folder), "warc-files")
    n = max(1, files.count())
    return read_archives(files.repartition(n, "path"), folder, payloads)


#: The same rows in DuckDB SQL.
ORACLE = """
with p as (select page_id, coalesce(html, '') html from pages),
w as (select *, max(page_id) over (partition by html) top from p)
select page_id, strlen(html)::bigint payload_bytes, sha1(html) payload_digest,
  case when strlen(html) >= 1000 and page_id <> top then 'revisit' else 'response' end record_type,
  case when strlen(html) >= 1000 and page_id <> top then top end refers_to
from w
"""
