"""WARC archives: a writer, and a sequential reader that checks what it reads.

Each record is one gzip member, so archives can be cut and joined between records.  Rows with equal
payloads of at least ``least`` bytes are one group: its largest id is written as a response, the
others as revisits that refer to it and hold no payload.  The reader inflates bytes as they come,
frames each block by its Content-Length and verifies block and payload digests.

Null html counts as an empty payload; a null url is left out of the record; a null id is written as
an anonymous record (never a group's response, unless all ids of the group are null: then each is a
response).  Rows that repeat the group's largest id are all responses.  An empty table gives no
archives and an empty result; further columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.common import batch_rows, materialise, shared_path
from passagework.llm.store import AtomicWriter, open_fs

LEAST = 1000
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK, MOST_HEADERS = 1 << 16, 1 << 20
#: Groups of copies (about 100 bytes each) are broadcast up to this number, else they are shuffled in SALTS parts.
MAX_BROADCAST, SALTS = 200_000, 32
ANONYMOUS = "<urn:page:none>"


def groups(pages: DataFrame, least: int = LEAST, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``pages`` as (page_id, url, html, refers_to): the id of the group's response for a revisit."""
    body = F.coalesce(F.col(html), F.lit(""))
    named = pages.select(F.col(page_id).cast("long").alias("page_id"), "url", body.alias("html"), F.octet_length(body).alias("size"), F.sha1(F.encode(body, "UTF-8")).alias("digest"))
    large = named.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    copies = materialise(large.where("n > 1").select("digest", "size", "keeper"), "copies")
    if copies.count() <= MAX_BROADCAST:
        met = named.join(F.broadcast(copies), ["digest", "size"], "left")
    else:  # a group of very many copies is dealt out
        spread = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = named.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(spread, ["digest", "size", "salt"], "left")
    return met.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {ANONYMOUS if page_id is None else f'<urn:page:{page_id}>'}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: {sha1_label(payload)}",
        f"WARC-Block-Digest: {sha1_label(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%~-._''')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class DamagedArchive(ValueError):
    """A record isn't what its headers say."""


def inflated(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """The inflated bytes of a stream of gzip members, CHUNK at most at a time, and whether a member
    ends with them."""
    inflate, begun = zlib.decompressobj(31), False
    for chunk in chunks:
        more = False  # output that is still to come though all input was taken
        while chunk or more:
            begun = True
            data = inflate.decompress(chunk, CHUNK)
            more = not inflate.eof and len(data) == CHUNK
            chunk = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            yield data, inflate.eof
            if inflate.eof:
                inflate, begun = zlib.decompressobj(31), False
    if begun:
        raise DamagedArchive("the last member is cut off")


def headers(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        found[name.strip().lower().decode()] = value.strip().decode()
    return found


def read_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, framed by Content-Length, block digest verified.  A member
    that inflates to more than its header says is given up at once."""
    held, found, size = bytearray(), None, 0
    for data, ends in inflated(chunks):
        held += data
        if found is None:
            at = held.find(b"\r\n\r\n")
            if not held.startswith(b"WARC/"[: len(held)]) or (at < 0 and (ends or len(held) > MOST_HEADERS)):
                raise DamagedArchive("a member doesn't begin with a record")
            if at >= 0:
                found = headers(bytes(held[:at]))
                size = int(found["content-length"])
                del held[: at + 4]
        if found is not None and len(held) > size + 4:
            raise DamagedArchive("a block is longer than its header says")
        if not ends:
            continue
        if len(held) != size + 4 or held[size:] != b"\r\n\r\n":
            raise DamagedArchive("a block is not as long as its header says")
        block = bytes(held[:size])
        if sha1_label(block) != found["warc-block-digest"]:
            raise DamagedArchive("a block's digest is wrong")
        yield found, block
        held, found, size = bytearray(), None, 0


def page_of(record_id: str | None) -> int | None:
    tail = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def parse(found: dict[str, str], block: bytes) -> tuple[int | None, str | None, str, int, str, int | None, bytes | None]:
    """page_id, url, type, payload size and hex digest, refers_to, payload (None for a revisit)."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(headers(head)["content-length"])
    kind, label = found["warc-type"], found["warc-payload-digest"]
    if kind == "response" and (len(payload) != size or sha1_label(payload) != label):
        raise DamagedArchive("a payload's digest is wrong")
    digest = base64.b32decode(label.removeprefix("sha1:")).hex()
    return page_of(found["warc-record-id"]), found.get("warc-target-uri"), kind, size, digest, page_of(found.get("warc-refers-to")), payload if kind == "response" else None


def write(grouped: DataFrame, folder: str) -> list[str]:
    """An archive for each partition of ``grouped`` (see ``groups``); gives their paths."""
    batch_rows(grouped.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path = None, f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        try:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    out = out or AtomicWriter(path)
                    out.write(gzip_member(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)))
        except BaseException:
            if out:
                out.abort()
            raise
        if out:
            out.commit()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return sorted(r["path"] for r in grouped.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string").collect())


def read(spark: SparkSession, paths: list[str], payload: bool = True) -> DataFrame:
    """The records of the archives, a task an archive, in bounded batches."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def chunks(path: str) -> Iterator[bytes]:
        store, inner = open_fs(path)
        with store.open_input_stream(inner, compression=None) as stream:
            while data := stream.read(CHUNK):
                yield data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for found, block in read_records(chunks(path)):
                    row = parse(found, block)
                    rows.append(row if payload else (*row[:-1], None))
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    where = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return where.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def write_and_read(pages: DataFrame, least: int = LEAST, payload: bool = True) -> DataFrame:
    spark = pages.sparkSession
    return read(spark, write(groups(pages, least), shared_path(spark, "warc")), payload)
