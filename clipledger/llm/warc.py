"""WARC archives, one zstd frame for each record, with a dictionary in a leading skippable frame.

Every archive trains its dictionary on records of its own. A payload that occurs again becomes a
revisit record without a body, which refers to the record with the smallest page id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import keyed, partitions, written
from clipledger.session import scratch_path

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
#: Bytes of records in an archive before it is closed; of records a dictionary is trained on; of a dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 32 << 20, 1 << 20, 16 << 10


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes | None, n_bytes: int, sha1: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_ID}{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields of a record, its HTTP head, its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def archive(records: list[bytes]) -> bytes:
    import zstandard

    step, sample, size = max(1, sum(map(len, records)) // SAMPLE_BYTES), [], 0
    for r in records[::step]:
        if size < SAMPLE_BYTES:
            sample.append(r)
            size += len(r)
    try:
        words = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:  # too little to train on: the records' start serves as it is
        words = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True)
    own = words.as_bytes()
    return b"".join([struct.pack("<II", SKIPPABLE, len(own)), own, *map(press.compress, records)])


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at `at` ends: its header, its blocks, its checksum."""
    import zstandard

    end = at + zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        (word,) = struct.unpack("<I", bytes(data[end : end + 3]) + b"\0")
        last, kind, size = bool(word & 1), word >> 1 & 3, word >> 3
        end += 3 + (1 if kind == 1 else size)
    return end + 4 * zstandard.get_frame_parameters(data[at : at + 18]).has_checksum


def records_of(data: bytes) -> Iterator[bytes]:
    import zstandard

    view = memoryview(data)
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    own = data[8 : 8 + size]
    trained = own[:4] == struct.pack("<I", 0xEC30A437)
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    press, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own, dict_type=kind)), 8 + size
    while at < len(data):
        end = _frame_end(view, at)
        yield press.decompress(view[at:end])
        at = end


def with_references(pages: DataFrame, at_least: int) -> DataFrame:
    """page_id, url, html (null for revisits), n_bytes, refers_to.

    Equal payloads are found by digest: counts and the smallest id come from an aggregate, and the
    join back has one row for each repeated payload.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    whole = keyed(pages, "page_id", url="url", html="html").select(
        F.col("page_id").cast("long"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("n_bytes"), F.sha1(html).alias("sha1")
    )
    facts = written(whole.select("page_id", "n_bytes", "sha1"), "warc-facts")
    again = facts.where(f"n_bytes >= {at_least}").groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    again = written(again.where("n > 1").drop("n"), "warc-repeats")
    marks = written(facts.join(again, "sha1").where("page_id <> refers_to").select("page_id", "sha1", "refers_to").distinct(), "warc-marks")
    found = whole.join(marks, ["page_id", "sha1"], "left")
    return found.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "n_bytes", "sha1", "refers_to")


def write_archives(pages: DataFrame, at_least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes (page_id, url, html) and returns path, n_records.

    A null html is empty, a null id is left out, a null url has no header; a repeated row is a record
    of its own, of the kind the row is. Every attempt of a task writes files of its own; only those of
    tasks that ended are in the result.
    """
    folder = scratch_path(pages.sparkSession, "warc")

    def write(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.fs

        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        held, size, done = [], 0, []

        def close():
            name = f"{uuid.uuid4().hex}.warc.zst"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(archive(held))
            done.append((f"{folder}/{name}", len(held)))

        for batch in batches:
            for page_id, url, html, n_bytes, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = base64.b32encode(bytes.fromhex(sha1)).decode()
                held.append(record(page_id, url, html, n_bytes, own, refers_to, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    close()
                    held, size = [], 0
        if held:
            close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([d[0] for d in done], pa.string()), "n_records": pa.array([d[1] for d in done], pa.int64())})

    return with_references(pages, at_least).mapInArrow(write, "path string, n_records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; digests of bodies are verified."""

    def read(batches):
        import pyarrow as pa
        import pyarrow.fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = pyarrow.fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as f:
                    data, rows = f.read(), []
                for raw in records_of(data):
                    fields, http, payload = parsed(raw)
                    kind, sha1 = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    n_bytes = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if kind == "response" and (digest(payload), len(payload)) != (sha1, n_bytes):
                        raise ValueError(f"{path}: {fields['WARC-Record-ID']} differs from its digest")
                    number = lambda f: int(fields[f][1 + len(RECORD_ID) : -1]) if f in fields else None  # noqa: B023, E731
                    rows.append((number("WARC-Record-ID"), n_bytes, sha1, kind, number("WARC-Refers-To")))
                kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
                yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(kinds.items())})

    spread = archives.select("path").repartition(partitions(archives.sparkSession), "path")
    return spread.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
