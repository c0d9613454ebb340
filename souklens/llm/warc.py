"""WARC archives: written by Spark as plain WARC 1.1 files, read back by a salvage reader.

A record whose payload was already stored becomes a revisit that refers to the stored one. The reader
checks every record; after a failed check it looks for the next gzip member or version line that
holds, goes on from there, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souklens.functions.storage import materialise, own_folder

#: Payloads of fewer bytes are stored each time.
LEAST_SHARED = 100
#: Aimed-at bytes of an archive file; a file is read whole by one task.
FILE_BYTES = 32 << 20
#: No file of several records grows beyond this; Spark reads no file of 2 GB as one value.
MOST_BYTES = 1 << 30
#: About what a record takes beside payload and URL.
RECORD_BYTES = 700
#: Repeated payloads are broadcast up to this many (some 80 MB); more are joined by a shuffle.
BROADCAST_DIGESTS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member is unpacked so many bytes at a time.
UNPACKED_BYTES = 1 << 16


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   date: str = "2000-01-01T00:00:00Z", least_shared: int = LEAST_SHARED, file_bytes: int = FILE_BYTES,
                   most_bytes: int = MOST_BYTES) -> int:
    """Writes a record per row of ``pages`` to WARC files in ``folder``; gives their number.

    Of equal payloads of at least ``least_shared`` bytes the row with the smallest id is a response,
    the others revisit it; rows that repeat that smallest id are responses too. A null payload is
    empty, a null URL leaves its header out, control characters in a URL are dropped; a null id is
    written as such and is never referred to. Files aim at ``file_bytes``; records of very different
    sizes go to files of their own, so that none holds over ``most_bytes``, unless as its only record.
    """
    digest = F.sha2(F.col("payload").cast("binary"), 256)
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].alias("url"), F.coalesce(pages[payload_col], F.lit("")).alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload"), "digest": digest})
    size = F.col("n").cast("long") + F.coalesce(F.octet_length("url"), F.lit(0)) + RECORD_BYTES
    power = F.floor(F.log2(size)).cast("int")
    sizes = rows.groupBy(power.alias("power")).agg(F.count("*").alias("k"), F.sum(size).alias("bytes"), F.max(size).alias("most")).collect()
    groups = size_groups([tuple(r) for r in sizes], file_bytes, most_bytes)
    firsts = materialise(rows.filter(F.col("n") >= least_shared).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("k")).filter("k > 1 AND first IS NOT NULL").select("digest", "first"))
    few = firsts.count() <= BROADCAST_DIGESTS
    rows = rows.join(F.broadcast(firsts) if few else firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    rows = rows.withColumns({"revisit": revisit, "block": F.when(revisit, http).otherwise(F.concat(http, "payload"))})
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")), F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x1f\x7f]", "")), F.lit("")),
        F.when(F.col("revisit"), F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn(F.col("first")))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), "digest", F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(F.col("block").cast("binary"), 256),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"))
    # the writer ends each value by one line separator; a record ends by two
    record = F.concat(header, "block", F.lit("\r\n")).alias("record")
    for powers, per_file in groups:
        part = rows if len(groups) == 1 else rows.filter(power.between(*powers))
        part.select(record).write.mode("append").option("lineSep", "\r\n").option("maxRecordsPerFile", per_file).text(folder)
    return sum(r["k"] for r in sizes)


def size_groups(sizes: list[tuple[int, int, int, int]], file_bytes: int, most_bytes: int) -> list[tuple[tuple[int, int], int]]:
    """Ranges of sizes written together, each with its records per file.

    ``sizes`` has at most some 32 tuples: power of two, records, their bytes, and the largest one's. A
    range takes the next power as long as a file of only its largest records stays in ``most_bytes``.
    """
    groups = []  # lowest power, highest power, records, bytes, largest
    fits = lambda k, total: max(1, int(file_bytes * k / total))
    for power, k, total, most in sorted(sizes):
        if groups:
            low, _, k0, total0, _ = groups[-1]
            if fits(k0 + k, total0 + total) * most <= most_bytes:
                groups[-1] = low, power, k0 + k, total0 + total, most
                continue
        groups.append((power, power, k, total, most))
    done = [((low, high), min(fits(k, total), max(1, most_bytes // most))) for low, high, k, total, most in groups]
    return done or [((0, 0), 1)]


#: Where a record's headers end, or those of a broken one meet the next version line.
_HEADER_END = re.compile(rb"\r\n(?:\r\n|WARC/1\.[01]\r\n)")
_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


class Broken(ValueError):
    pass


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The plain record at ``at`` and where the next one begins; raises ``Broken`` if a check fails."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at):
        raise Broken("no version line")
    found = _HEADER_END.search(data, at + 8)  # headers may be of any length
    if not found or found[0] != b"\r\n\r\n":
        raise Broken("headers do not end")
    end = found.start()
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("a header line has no colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        raise Broken("no content length")
    begin, stop = end + 4, end + 4 + int(fields["content-length"])
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise Broken("the block does not end where its length says")
    block = data[begin:stop]
    if not _agrees(fields.get("warc-block-digest"), block):
        raise Broken("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    kind = fields.get("warc-type", "")
    digest, size = fields.get("warc-payload-digest", ""), len(payload)
    if kind == "revisit":
        told = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        size = int(told[1]) if told else None
    elif not _agrees(digest or None, payload):
        raise Broken("payload digest differs")
    own = digest.partition(":")[2].lower() if kind == "revisit" else hashlib.sha256(payload).hexdigest()
    return {"kind": kind, "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
            "payload_bytes": size, "payload_digest": own, "payload": payload, "reason": None}, stop + 4


def _agrees(told: str | None, data: bytes) -> bool:
    """Whether a labelled digest holds; of other algorithms than these nothing is said."""
    name, _, value = (told or "").partition(":")
    if name.lower() in ("sha256", "md5"):
        return hashlib.new(name.lower(), data).hexdigest() == value.lower()
    return True


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member at ``at``, unpacked, and where it ends."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            if pos >= len(data):
                raise Broken("a gzip member does not end")
            out.append(unpack.decompress(data[pos:pos + UNPACKED_BYTES]))
            pos = min(len(data), pos + UNPACKED_BYTES)
    except zlib.error as e:
        raise Broken("a gzip member is damaged") from e
    return b"".join(out), pos - len(unpack.unused_data)


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive's bytes in order, with ``offset`` and ``length``; gaps have kind ``gap`` and a reason."""
    at, gap, why = 0, None, ""
    while at < len(data):
        try:
            if data.startswith(b"\x1f\x8b", at):
                inner, after = inflate(data, at)
                records, pos = [], 0
                while pos < len(inner):
                    record, pos = parse_record(inner, pos)
                    records.append(record)
            else:
                record, after = parse_record(data, at)
                records = [record]
        except Broken as e:
            if gap is None:
                gap, why = at, str(e)
            found = _NEXT.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if gap is not None:
            yield _gap(gap, at, why)
            gap = None
        for record in records:
            yield record | {"offset": at, "length": after - at}
        at = after
    if gap is not None:
        yield _gap(gap, at, why)


def _gap(start: int, end: int, why: str) -> dict:
    return {"kind": "gap", "record_id": None, "url": None, "refers_to": None, "payload_bytes": None, "payload_digest": None, "payload": None, "reason": why, "offset": start, "length": end - start}


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the archive files in ``folder``.

    Columns ``path, offset, length, kind, record_id, url, refers_to, payload_bytes, payload_digest,
    reason`` and, if asked for, ``payload``. Plain archives and archives of gzip members are read;
    an empty file gives no row. A file is parsed whole by one task.
    """
    types = {"offset": pa.int64(), "length": pa.int64(), "kind": pa.string(), "record_id": pa.string(), "url": pa.string(), "refers_to": pa.string(),
             "payload_bytes": pa.int64(), "payload_digest": pa.string(), "reason": pa.string()} | ({"payload": pa.binary()} if payloads else {})
    names = ["path", *types]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path, held, size = batch.column(0)[i].as_py(), [], 0
                for record in salvage(batch.column(1)[i].as_py()):
                    held.append(record if payloads else record | {"payload": None})
                    size += len(held[-1]["payload"] or b"")
                    if len(held) == 1000 or size > FILE_BYTES // 4:
                        yield pack(path, held)
                        held, size = [], 0
                if held:
                    yield pack(path, held)

    def pack(path, held):
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held))] + [pa.array([r[n] for r in held], t) for n, t in types.items()], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(folder).select("path", "content")
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return files.mapInArrow(run, ", ".join(["path string"] + [f"`{n}` {kinds[t]}" for n, t in types.items()]))


def page_of(urn: str) -> Column:
    """The page id in a record's name."""
    return F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back: a row per page; raises ``ValueError`` if any is missing."""
    folder = own_folder(pages.sparkSession, "warc")
    written = write_archives(pages, folder, **names)
    back = read_archives(pages.sparkSession, folder, payloads=False).filter("kind IN ('response', 'revisit')")
    back = materialise(back.select(page_of("record_id").alias("page_id"), "url", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page_of("refers_to").alias("refers_to")))
    read = back.count()
    if read != written:
        raise ValueError(f"{read} of {written} records were read back from {folder}")
    return back
