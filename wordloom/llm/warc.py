"""WARC archives: writing with deduplication and segmentation, reading with reassembly.

Writing.  Payloads of at least MIN_REVISIT bytes are grouped by SHA-1; the
record with the largest page id is the response, the others are revisits that
name its record id.  A response's block is an HTTP message in chunked transfer
framing.  Blocks longer than SEGMENT are cut: the first record holds segment 1,
continuation records name it as their origin, and the last one states the total
length.  Archives are rows (archive, content), one gzip member per record, so
any sink can hold them; ``read`` takes such a table or Spark's ``binaryFile``.

Reading.  Archives may be plain or compressed, with one or several records a
member, and hold records of any type.  Records are parsed one by one; segments
are grouped by origin, ordered by number and joined, the total is verified, and
the chunked framing is decoded.  A stated payload digest (hexadecimal or base32,
of any hash that the platform has) is verified.  ``checked`` verifies revisits
against the records that they name, ``with_payloads`` gives them their payload.

Bounds: a group is the segments of one record; an archive, and a record's block,
are each held whole in one task, as ``binaryFile`` gives them.

Defined cases: a null html is an empty payload; empty tables give no archives;
equal rows are written and read as records of their own; where the largest page
id is repeated, each of its rows is a response; a null page id is read back as
null and never is referred to.  Very long pages are segments of 8 KB.  Columns
beyond page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.plans.staging import Workspace

MIN_REVISIT, SEGMENT, CHUNK, ARCHIVE = 1000, 8192, 4096, 4 << 20
_DATE = "2024-01-01T00:00:00Z"


def resolve(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, html, place, refers_to), refers_to the record id of another row, null for responses.

    The rows are written with their places first, since a revisit names the
    place of its original.
    """
    work = Workspace(pages.sparkSession, "warc")
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = work.write(pages.select("page_id", "url", body.alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size"), F.monotonically_increasing_id().alias("place")), "rows")
    twice = rows.where((F.col("size") >= MIN_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max(F.struct("page_id", "place")).alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = work.write(twice.select("digest", "original"), "payloads")
    name = F.concat_ws(":", F.lit("urn:page"), F.col("original.page_id").cast("string"), F.col("original.place").cast("string"))
    return rows.join(twice, "digest", "left").select("page_id", "url", "html", "place", F.when(F.col("page_id") != F.col("original.page_id"), name).alias("refers_to"))


def _record(kind: str, name: str, block: bytes, url: str | None, more: dict[str, str]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": _DATE, "Content-Length": str(len(block)), "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | more).items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def _chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(x), x) for x in (payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK))]
    return b"".join(parts) + b"0\r\n\r\n"


def _page_records(page_id, url, html: str, refers_to: str | None, place: int) -> Iterator[bytes]:
    payload = html.encode("utf-8", "replace")
    name = f"urn:page:{'' if page_id is None else page_id}:{place}"
    digest = {"WARC-Payload-Digest": f"sha1:{hashlib.sha1(payload).hexdigest()}"}
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{refers_to}>"}
        yield _record("revisit", name, block, url, digest | profile)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + _chunked(payload)
    if len(block) <= SEGMENT:
        yield _record("response", name, block, url, digest)
        return
    cuts = range(0, len(block), SEGMENT)
    yield _record("response", name, block[:SEGMENT], url, digest | {"WARC-Segment-Number": "1"})
    for k, at in enumerate(cuts[1:], 2):
        more = {"WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": str(k)}
        if k == len(cuts):
            more["WARC-Segment-Total-Length"] = str(len(block))
        yield _record("continuation", f"{name}:{k}", block[at : at + SEGMENT], None, more)


def write(pages: DataFrame) -> DataFrame:
    """Archives (archive string, content binary) of ``resolve``d pages, of about ARCHIVE bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, made = TaskContext.get().partitionId(), 0, 0, []

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:05d}-{count:08d}.warc.gz"]), pa.array([b"".join(made)], pa.binary())], ["archive", "content"])

        for batch in batches:
            for row in batch.to_pylist():
                for record in _page_records(row["page_id"], row["url"], row["html"], row["refers_to"], row["place"]):
                    made.append(record)
                    held += len(record)
                count += 1
                if held >= ARCHIVE:
                    yield archive()
                    made, held = [], 0
        if made:
            yield archive()

    return pages.select("page_id", "url", "html", "place", "refers_to").mapInArrow(run, "archive string, content binary")


def _members(content: bytes) -> Iterator[bytes]:
    """The plain parts of an archive: its gzip members, or all of it."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view = memoryview(content)
    while len(view) and bytes(view[:2]) == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        yield member.decompress(view) + member.flush()
        view = view[len(view) - len(member.unused_data) :]
    if bytes(view).strip(b"\0\r\n"):
        raise ValueError("bytes follow the last gzip member")


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields, names in lower case; folded lines go on their field, lines without a colon are left out."""
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record."""
    for data in _members(content):
        at = 0
        while True:
            while data[at : at + 1] in (b"\r", b"\n"):
                at += 1
            if at >= len(data):
                break
            end, size = data.find(b"\r\n\r\n", at), 4
            plain = data.find(b"\n\n", at)
            if 0 <= plain and (end < 0 or plain < end):
                end, size = plain, 2
            if end < 0 or data[at : at + 5] != b"WARC/":
                raise ValueError("not a WARC record")
            fields = _fields(data[at:end].decode("utf-8", "replace").splitlines()[1:])
            start, length = end + size, int(fields["content-length"])
            if len(data) < start + length or data[start + length : start + length + 4].strip(b"\r\n"):
                raise ValueError("a record's length is wrong")
            yield fields, data[start : start + length]
            at = start + length


def _digest_is(payload: bytes, stated: str) -> bool:
    """Whether a stated digest (algorithm:value) is the payload's; digests of unknown algorithms are not judged."""
    kind, _, value = stated.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in hashlib.algorithms_available:
        return True
    made = hashlib.new(kind, payload).digest()
    return value.strip().lower() in (made.hex(), base64.b32encode(made).decode().lower(), base64.b32encode(made).decode().rstrip("=").lower())


RECORD = "record_id string, record_type string, url string, refers_to string, payload_digest string, content_type string, segment int, total long, origin string, block binary"
_HEAD = ["record_type", "url", "refers_to", "payload_digest", "content_type"]


def records(archives: DataFrame, content: str = "content") -> DataFrame:
    """Every record of the archives, segments apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch[0]:
                out, held = [], 0
                for f, block in _parse(item.as_py()):
                    name = f.get("warc-record-id", "").strip("<>")
                    total = f.get("warc-segment-total-length")
                    out.append((name, f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-refers-to", "").strip("<>") or None, f.get("warc-payload-digest") or None, f.get("content-type"), int(f.get("warc-segment-number", 0)), int(total) if total else None, f.get("warc-segment-origin-id", name).strip("<>"), block))
                    held += len(block)
                    if held > 8 << 20:
                        yield _batch(out)
                        out, held = [], 0
                if out:
                    yield _batch(out)

    return archives.select(content).mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary())
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _dechunk(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunked framing")
        parts.append(body[at : at + size])
        at += size + 2


def _message(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of an HTTP message."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, _, body = block.partition(b"\n\n")
    return _fields(head.decode("latin-1").splitlines()[1:]), body


_PAYLOAD = "record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read(archives: DataFrame, content: str = "content") -> DataFrame:
    """Rows (record_id, record_type, url, refers_to, payload_digest, payload_bytes, payload binary) of all records.

    Segments are put together.  The payload of an HTTP message is its body
    without transfer framing, that of any other record its block.  A revisit has
    a null payload, the length that its HTTP header states (else null), and the
    digest that it states.  payload_digest is the bare SHA-1 in lower-case
    hexadecimal, made from the payload where there is one.  A wrong total, gap,
    framing or digest raises.
    """
    every = records(archives, content)
    plain = every.where("segment = 0").select("record_id", *_HEAD, F.array("block").alias("blocks"))
    parts = every.where("segment > 0").groupBy("origin").agg(
        F.max_by(F.struct(*_HEAD), -F.col("segment")).alias("head"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
    )
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["block"]))
    sound = F.coalesce((F.col("total") == length) & (F.element_at("parts", -1)["segment"] == F.size("parts")), F.lit(False))
    blocks = F.when(sound, F.transform("parts", lambda x: x["block"])).otherwise(F.raise_error(F.lit("segments are missing")))
    joined = parts.select(F.col("origin").alias("record_id"), "head.*", blocks.alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, payloads = [], [], []
            for kind, stated, media, block in zip(batch["record_type"].to_pylist(), batch["payload_digest"].to_pylist(), batch["content_type"].to_pylist(), batch["blocks"], strict=True):
                whole = b"".join(block.as_py())
                fields, payload = _message(whole) if (media or "").lower().startswith("application/http") else ({}, whole)
                if kind == "revisit":
                    length = fields.get("content-length", "")
                    sizes.append(int(length) if length.isdigit() else None)
                    digests.append(_bare(stated))
                    payloads.append(None)
                    continue
                if fields.get("transfer-encoding", "").lower() == "chunked":
                    payload = _dechunk(payload)
                if stated and not _digest_is(payload, stated):
                    raise ValueError("a payload's digest is wrong")
                sizes.append(len(payload))
                digests.append(hashlib.sha1(payload).hexdigest())
                payloads.append(payload)
            kept = batch.select(["record_id", "record_type", "url", "refers_to"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary())], [*kept.schema.names, "payload_digest", "payload_bytes", "payload"])

    return plain.unionByName(joined).mapInArrow(run, _PAYLOAD)


def _bare(stated: str | None) -> str | None:
    """A stated SHA-1 in lower-case hexadecimal, null for other algorithms."""
    kind, _, value = (stated or "").partition(":")
    if kind.strip().lower().replace("-", "") != "sha1":
        return None
    value = value.strip()
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def checked(found: DataFrame, complete: bool = True) -> DataFrame:
    """Written rows of ``read``; a revisit whose digest or length is not that of the record that it names raises.

    So does one whose record is missing, unless the archives are not ``complete``.
    Only ids, digests and lengths of named records meet the revisits.
    """
    named = found.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("record_id")).distinct()
    originals = found.where("record_type <> 'revisit'").select("record_id", "payload_digest", "payload_bytes").join(named, "record_id", "left_semi")
    originals = originals.groupBy(F.col("record_id").alias("refers_to")).agg(F.max(F.struct("payload_digest", "payload_bytes")).alias("original"))
    met = found.where("record_type = 'revisit'").join(originals, "refers_to", "left")
    same = lambda name: F.col(name).isNull() | (F.col(name) == F.col(f"original.{name}"))
    fine = F.when(F.col("original").isNull(), F.lit(not complete)).otherwise(same("payload_digest") & same("payload_bytes"))
    record = F.when(fine, F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("a revisit does not agree with its record: "), F.col("record_id"))))
    return found.where("record_type <> 'revisit' OR record_type IS NULL").unionByName(met.withColumn("record_type", record).select(found.columns))


def with_payloads(found: DataFrame) -> DataFrame:
    """Written rows of ``read`` with the payload of the named record where a revisit has none."""
    held = found.where("record_type <> 'revisit'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("payload").alias("__payload"))
    rows = found.where("record_type = 'revisit'").join(held, "refers_to", "left").withColumn("payload", F.coalesce("payload", "__payload"))
    return found.where("record_type <> 'revisit' OR record_type IS NULL").unionByName(rows.select(found.columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives of ``pages`` to the shared folder and reads them back."""
    work = Workspace(pages.sparkSession, "warc")
    return read(work.write(write(resolve(pages)), "archives"))


def page_number(name: str):
    """The page id in a record id ``urn:page:<id>:...``."""
    return F.expr(f"try_cast(split({name}, ':')[2] AS BIGINT)")
