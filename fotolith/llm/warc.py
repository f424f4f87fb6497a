"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of a group of WARC records, and a last
skippable frame with the seek table (the public Zstandard seekable format). The index maps each
record to its bundle, its frame's place in the file and its offset in the unpacked frame, so one
record is read by one ranged read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id long, record_id string, bundle string, frame int, frame_at long, frame_size long, at long, size long"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_LENGTH = re.compile(rb"(?im)^content-length: *(\d+)")


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame at a bundle's end, of (packed, unpacked) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """(packed, unpacked) sizes of a bundle's frames, from its last bytes (all of its table at least)."""
    n, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    step = 12 if flags & 0x80 else 8
    rows = tail[-9 - step * n:-9]
    return [struct.unpack_from("<II", rows, step * i) for i in range(n)]


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def record(kind: str, rid: str, url: str | None, payload: bytes, sha1: str, refers: str | None, refers_page: int | None, page_id: int | None) -> bytes:
    """One WARC 1.1 record. A revisit holds the HTTP head only, as the profile for identical payload
    digests says, and so the payload's length but not the payload."""
    block = _HTTP % len(payload) + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers}", f"X-Refers-To-Page-ID: {refers_page}"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """A record's fields: its headers in lower case, ``payload`` (None in a revisit), ``payload_bytes``."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in (y if ": " in y else y.rstrip(":") + ": " for y in lines))}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"payload": payload if fields["warc-type"] == "response" else None, "payload_bytes": int(_LENGTH.search(http)[1])}


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``pages`` with ``payload_digest``, ``refers_to`` and ``refers_url``: of rows with equal payloads of
    at least ``least`` bytes, that with the largest page_id is the response and others revisit it.

    Digests are grouped without the texts, so a hot group meets in partial maxima; only rows that
    revisit go into the join with the texts, by page_id and digest.
    """
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    light = p.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "url", "payload_digest")
    heads = light.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("head"), F.min("page_id").alias("least")).where("head.page_id > least")
    revisits = written(light.join(heads, "payload_digest").where("page_id < head.page_id")
                       .select("page_id", "payload_digest", F.col("head.page_id").alias("refers_to"), F.col("head.url").alias("refers_url")).distinct(), "revisits")
    return p.join(revisits, ["page_id", "payload_digest"], "left")


def write_bundles(planned: DataFrame, folder: str, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 27, level: int = 3) -> DataFrame:
    """Write records to bundles in ``folder`` (any store that pyarrow opens by URI) and return the index.

    A task streams its rows, holding one frame at a time; it opens a new bundle after
    ``bundle_bytes``. Each attempt writes files of its own name, and only those that the index names
    count: a lost or repeated task leaves at most an orphan. The index is written before it is used.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        out, name, frames, buffer, pending, place = None, "", [], bytearray(), [], 0
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal buffer, pending, place
            if buffer:
                data = pack.compress(bytes(buffer))
                out.write(data)
                rows.extend((pid, rid, name, len(frames), place, len(data), at, size) for pid, rid, at, size in pending)
                frames.append((len(data), len(buffer)))
                place += len(data)
                buffer, pending = bytearray(), []

        def close() -> None:
            nonlocal out, frames, place
            if out:
                flush()
                out.write(seek_table(frames))
                out.close()
                out, frames, place = None, [], 0

        def taken() -> Iterator:
            nonlocal rows
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
                rows = []

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                rid = record_id(r["page_id"], r["url"], r["payload_digest"])
                kind = "response" if r["refers_to"] is None else "revisit"
                raw = record(kind, rid, r["url"], r["html"].encode(), r["payload_digest"], record_id(r["refers_to"], r["refers_url"], r["payload_digest"]), r["refers_to"], r["page_id"])
                pending.append((r["page_id"], rid, len(buffer), len(raw)))
                buffer += raw
                if len(buffer) >= frame_bytes:
                    flush()
                    if place >= bundle_bytes:
                        close()
            yield from taken()
        close()
        yield from taken()

    return written(planned.select("page_id", "url", "html", "payload_digest", "refers_to", "refers_url").mapInArrow(run, INDEX), "warc-index")


def bundle_frames(file, bundle: str) -> list[tuple[int, int, int]]:
    """(place, packed size, unpacked size) of each frame of an open bundle, from the seek table at its end."""
    size = file.size()
    file.seek(max(0, size - 9))
    count = struct.unpack_from("<I", file.read(9))[0]
    file.seek(max(0, size - 9 - 12 * count))
    table = read_seek_table(file.read())
    place, out = 0, []
    for packed, unpacked in table:
        out.append((place, packed, unpacked))
        place += packed
    if place + len(seek_table(table)) != size:
        raise ValueError(f"the seek table of {bundle} doesn't fit the file")
    return out


def read_records(index: DataFrame, folder: str, stripe: int = 64, partitions: int | None = None) -> DataFrame:
    """Read every indexed record back: ``page_id, record_id, record_type, url, payload_bytes,
    payload_digest, refers_to, payload_ok``; each payload's digest is computed again.

    A record's frame number leads through the bundle's seek table to the frame's place in the file,
    which must be what the index says. Runs of ``stripe`` frames of a bundle are dealt to
    ``partitions`` tasks (the session's shuffle partitions) by number, not by the bytes of the light
    index, so the archives are read by many tasks; each opens a bundle once for its run.
    """
    schema = "page_id long, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload_ok boolean"
    n = partitions or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = index.withColumn("stripe", F.floor(F.col("frame") / stripe)).repartition(n, "bundle", "stripe")
    frames = (runs.groupBy("bundle", "stripe", "frame", "frame_at", "frame_size").agg(F.sort_array(F.collect_list(F.struct("at", "size"))).alias("records"))
              .sortWithinPartitions("bundle", "frame"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        name, file, places = None, None, []
        number = lambda got, k: int(got[k]) if got.get(k) else None
        for batch in batches:
            for r in batch.to_pylist():
                if r["bundle"] != name:
                    if file:
                        file.close()
                    name, file = r["bundle"], store.open_input_file(f"{path}/{r['bundle']}")
                    places = bundle_frames(file, name)
                place, packed, unpacked = places[r["frame"]]
                if (place, packed) != (r["frame_at"], r["frame_size"]):
                    raise ValueError(f"index and seek table of {name} differ in frame {r['frame']}")
                file.seek(place)
                data = unpack.decompress(file.read(packed), max_output_size=unpacked)
                rows = []
                for x in r["records"]:
                    got = parse_record(data[x["at"]:x["at"] + x["size"]])
                    digest = base64.b32decode(got["warc-payload-digest"].removeprefix("sha1:")).hex()
                    ok = got["payload"] is None or (len(got["payload"]) == got["payload_bytes"] and hashlib.sha1(got["payload"]).hexdigest() == digest)
                    rows.append((number(got, "x-page-id"), got["warc-record-id"], got["warc-type"], got["warc-target-uri"], got["payload_bytes"], digest, number(got, "x-refers-to-page-id"), ok))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])
        if file:
            file.close()

    return frames.select("bundle", "frame", "frame_at", "frame_size", "records").mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 1000) -> DataFrame:
    """Write one record for each row of ``pages`` and read the archives back (:func:`read_records`).

    Defined cases: null html is an empty payload, null urls are empty; rows with null page_id are
    responses; rows that repeat a page_id and payload are each written, all as what that page_id is;
    a very long page is a frame of its own, in memory whole; an empty table gives an empty result;
    other columns aren't written.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_records(write_bundles(plan_records(pages, least), folder), folder)
