"""WARC archives with boundary-chain verification (operator 10).

Writing: one record per page; of equal payloads the least page id gets a ``response``, the
others a ``revisit`` that refers to it and carries no payload.

Reading: the archives are uncompressed, and a payload may contain what looks like a record.
Tasks list every offset where a record could begin, with the offset where it would end.
Pointer jumping from the start of each file then keeps the offsets on the chain of true
boundaries: each round doubles the length of the known jumps and passes the mark on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm._spark import forget, keep

_MAGIC = b"WARC/1.1\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)(?=\r\n)")
_END = "\r\n\r\n"
#: Payload bytes that a batch of records read back holds, about.
_HELD = 16 << 20
HEADERS = {"record_type": "WARC-Type", "page_id": "WARC-Record-ID", "url": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 100, records_per_file: int = 1000, file_bytes: int = 64 << 20, small_rows: int = 200_000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``pages`` as WARC 1.1 files under ``path``, ``records_per_file`` records in each at most.

    Larger payloads go into files of fewer records, so that no file holds more than
    ``file_bytes`` of payload, but one payload that is larger by itself.
    Null html is an empty payload and a null url leaves its header out.  A null id is written
    as an empty one and is never the least unless all ids of equal payloads are null, which
    then are all responses, as are repeated rows of the least id.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    at_most = [records_per_file]
    while at_most[-1] > 1:
        at_most.append(max(1, at_most[-1] // 16))
    kind = F.lit(len(at_most) - 1)
    for k in reversed(range(len(at_most) - 1)):
        kind = F.when(F.col("size") <= file_bytes // at_most[k], k).otherwise(kind)
    kinds = sorted(r[0] for r in p.select(kind.alias("kind")).distinct().collect()) or [0]
    first = p.where(F.col("size") >= revisit_from).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    first = keep(first, "repeated")
    few = first.limit(small_rows + 1).count() <= small_rows
    p = p.join(F.broadcast(first) if few else first.hint("shuffle_hash"), F.col("digest") == F.col("d"), "left").withColumn("again", F.coalesce(F.col("first") != F.col("id"), F.col("first").isNotNull() & F.col("id").isNull()))
    clean = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")

    def header(name: str, value: F.Column, when: F.Column | None = None) -> F.Column:
        line = F.concat(F.lit(f"\r\n{name}: "), value)
        return line if when is None else F.when(when, line).otherwise("")

    def urn(c: F.Column) -> F.Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))

    size = F.when(F.col("again"), 0).otherwise(F.col("size")).cast("string")
    record = F.concat(
        F.lit("WARC/1.1"), header("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), header("WARC-Record-ID", urn(F.col("id"))), header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", clean, F.col("url").isNotNull()), header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), header("WARC-Refers-To", urn(F.col("first")), F.col("again")),
        header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.col("again")), header("Content-Type", F.lit("text/html; charset=utf-8")), header("Content-Length", size),
        F.lit(_END), F.when(F.col("again"), "").otherwise(F.col("payload")),
    )
    for n, k in enumerate(kinds):
        rows = p if len(kinds) == 1 else p.where(kind == k)
        rows.select(record.alias("value")).write.mode("append" if n else "errorifexists").option("lineSep", _END).option("maxRecordsPerFile", at_most[k]).text(path)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    return {k.decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}


def candidates(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(offset, successor, start of the payload) wherever a record could lie, true or not."""
    at = data.find(_MAGIC)
    while at >= 0:
        body = data.find(b"\r\n\r\n", at)
        if body >= 0 and (m := _LENGTH.search(data, at + len(_MAGIC) - 2, body + 2)):
            after = body + 4 + int(m[1]) + 4
            if after <= len(data) and data[after - 4 : after] == b"\r\n\r\n":
                yield at, after, body + 4
        at = data.find(_MAGIC, at + 1)


def _scan(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    """Every candidate with its headers and what its payload measures, and the payload itself if asked for."""
    fields = [("path", pa.string()), ("at", pa.int64()), ("after", pa.int64()), *((k, pa.string()) for k in HEADERS), ("size", pa.int64()), ("sha256", pa.string())]
    kinds = f"path string, at long, after long, {', '.join(f'{k} string' for k in HEADERS)}, size long, sha256 string"
    if payload:
        fields.append(("payload", pa.binary()))
        kinds += ", payload binary"
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, rows, held = data.as_py(), [], 0
                for at, after, body in candidates(data):
                    h = _headers(data[at : body - 4])
                    own = data[body : after - 4]
                    rows.append({"path": name, "at": at, "after": after, "size": len(own), "sha256": hashlib.sha256(own).hexdigest()} | {k: h.get(x) for k, x in HEADERS.items()} | ({"payload": own} if payload else {}))
                    held += len(own) if payload else 0
                    if held > _HELD or len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, kinds)


def boundary_chain(links: DataFrame) -> DataFrame:
    """(path, at) of the records on each file's chain from offset 0, by pointer jumping over (path, at, after)."""
    state = keep(links.select("path", "at", F.col("after").alias("jump"), (F.col("at") == 0).alias("on")), "chain")
    before = -1
    while (now := state.where("on").count()) != before:
        before = now
        far = state.select(F.col("path").alias("p"), F.col("at").alias("a"), F.col("jump").alias("far"))
        marked = state.where("on and jump is not null").select(F.col("path").alias("q"), F.col("jump").alias("j")).distinct()
        step = state.join(far, (F.col("path") == F.col("p")) & (F.col("jump") == F.col("a")), "left")
        step = step.join(marked, (F.col("path") == F.col("q")) & (F.col("at") == F.col("j")), "left")
        last, state = state, keep(step.select("path", "at", F.col("far").alias("jump"), (F.col("on") | F.col("j").isNotNull()).alias("on")), "chain")
        forget(last)
    return state.where("on").select("path", "at")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """(path, at, record_type, page_id, url, payload_digest, refers_to, size, sha256[, payload]) of every true record.

    ``size`` and ``sha256`` are of the bytes that the record holds, and null with ``payload``
    in a revisit, whose response holds them.  Ids come back as strings, empty ones as null.
    """
    found = keep(_scan(spark, path, payload), "records")
    chain = boundary_chain(found.select("path", "at", "after")).select(F.col("path").alias("p"), F.col("at").alias("a"))
    found = found.join(chain, (F.col("path") == F.col("p")) & (F.col("at") == F.col("a")), "left_semi")

    def ident(c: str) -> F.Column:
        return F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit(""))

    def held(c: str) -> F.Column:
        return F.when(F.col("record_type") != "revisit", F.col(c)).alias(c)

    return found.select("path", "at", "record_type", ident("page_id").alias("page_id"), "url", F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), ident("refers_to").alias("refers_to"), held("size"), held("sha256"), *([held("payload")] if payload else []))


def digest_of_archives(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); the two payload columns are of the full payload, taken from the response in the case of a revisit."""
    own = records.select(F.col("page_id").cast("long").alias("page_id"), "record_type", F.col("refers_to").cast("long").alias("refers_to"), F.col("size").alias("payload_bytes"), F.col("sha256").alias("payload_digest"), F.col("payload_digest").alias("stated"))
    full = own.where("record_type = 'response' and payload_bytes is not null").groupBy(F.col("page_id").alias("r"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("b"))
    joined = own.join(full, F.col("refers_to").eqNullSafe(F.col("r")) & (F.col("stated") == F.col("d")) & (F.col("record_type") == "revisit"), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "b").alias("payload_bytes"), F.coalesce("payload_digest", "d").alias("payload_digest"), "record_type", "refers_to")
