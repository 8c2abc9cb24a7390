"""WARC archives: pages to records, and records found again by their chain of boundaries.

Writing is Spark's text writer: a row is a record's header and block, and the writer's separator (two line
ends) is what ends a record, so a file is records on end. Of equal payloads one record has the content
(response), the others refer to it (revisit).

Reading is Spark's text reader with the first line of a record (the magic) as the separator, so that files
are split into byte ranges. A task sees what lies between two magics of its range, and emits for each magic
the candidate record that would start there, with the offset of its successor by its Content-Length. A magic
inside a payload is such a candidate too. Which candidates are records follows from the chain alone:

* within a byte range, each candidate gets the offset at which its chain leaves the range;
* those exits are pointers between ranges; from the start of the file, pointer jumping (doubling the
  pointers each round) finds the offset at which the chain enters each range;
* within each range, the chain from its entry keeps the records and rejects the other candidates.

A record whose payload holds the magic comes in several pieces; its pieces are put together from a second
look at the files that have such records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docwarden.llm.durable import shared_folder, written_to

#: The first line of a record, line ends, and the end of a record (fixed values of the format).
MAGIC, LINE, END = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"

_CANDIDATES = (
    "file string, file_size long, low long, span long, local long, size long, next long, leaves long, record_type string, page_id long, "
    "refers_to long, url string, payload_bytes long, payload_digest string, http int, head int, length long"
)
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
_SCHEMA = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in _CANDIDATES.split(", ")])
_FACTS = ("record_type", "page_id", "refers_to", "url", "payload_bytes", "payload_digest")


# Writing

def base32_sha1(content: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight groups of five hex digits, four letters each."""
    digest = F.sha1(content)

    def letters(group: Column) -> Column:
        bits = F.conv(F.substring(digest, group * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*(F.substring(F.lit(_ALPHABET), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def first_holders(pages: DataFrame) -> DataFrame:
    """(digest, bytes, holder): for each payload that occurs more than once, the largest page_id with it."""
    found = pages.groupBy(F.sha1(_payload().cast("binary")).alias("digest"), F.octet_length(_payload()).alias("bytes"))
    return found.agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1").drop("n")


def records(pages: DataFrame, holders: DataFrame, captured: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One text ``value`` per page: a record without its end. Line ends in a url are percent-encoded."""
    rows = pages.select("page_id", "url", _payload().alias("payload")).withColumns({
        "digest": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload"),
    }).join(holders, ["digest", "bytes"], "left")
    revisits = F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id"))
    one_line = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def urn(page: Column) -> Column:
        return F.concat(F.lit(f"<{PAGE}"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisits, F.lit("")).otherwise(F.col("payload")))
    head = F.concat_ws(
        LINE, F.concat(F.lit(MAGIC + "WARC-Type: "), F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))), F.lit(f"WARC-Date: {captured}"),
        F.concat(F.lit("WARC-Target-URI: "), one_line),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload").cast("binary"))),
        F.when(revisits, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("holder")))), F.when(revisits, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    )
    return rows.withColumn("block", block).select(F.concat(head, F.lit(END), F.col("block")).alias("value"))


def archived(pages: DataFrame) -> str:
    """Writes ``pages`` (page_id, url, html; other columns are ignored) as archives into a new folder below the
    shared one, and returns that folder. A null html is an empty payload. Of equal payloads, the largest
    page_id keeps the content (a row repeated with that id, too), the others refer to it; a null page_id
    never holds for others. No pages give an empty folder."""
    folder = shared_folder(pages.sparkSession)
    holders = written_to(folder, first_holders(pages), "payloads")
    path = f"{folder}/archives/{uuid.uuid4().hex}"
    records(pages, holders).write.option("lineSep", END).text(path)
    return path


# Reading

_FIELD = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)")
_LENGTH = re.compile(rb"(?:^|\r\n)content-length:[ \t]*(\d+)", re.IGNORECASE)


def _page(value: bytes) -> int | None:
    digits = value.strip(b"<>").removeprefix(PAGE.encode())
    return int(digits) if re.fullmatch(rb"-?\d+", digits) else None


def parsed(content: bytes) -> dict | None:
    """What stands after a magic, as a record: head (bytes of the header with its empty line), length (of
    the block), the record's facts, http (bytes of the header inside the block). None if it is no header."""
    head = content.find(b"\r\n\r\n") + 4
    if head < 4:
        return None
    fields = {m[1].lower(): m[2] for m in map(_FIELD.fullmatch, content[: head - 4].split(b"\r\n")) if m}
    length = fields.get(b"content-length", b"")
    if not re.fullmatch(rb"\d{1,18}", length):
        return None
    http = content.find(b"\r\n\r\n", head) + 4 if fields.get(b"content-type", b"").startswith(b"application/http") else head
    stated = _LENGTH.search(content, head, http)
    revisit = fields.get(b"warc-type") == b"revisit"
    record = {
        "head": head, "length": int(length), "http": max(http - head, 0), "record_type": fields.get(b"warc-type", b"").decode("utf-8", "replace"),
        "page_id": _page(fields.get(b"warc-record-id", b"")), "refers_to": _page(fields[b"warc-refers-to"]) if b"warc-refers-to" in fields else None,
        "url": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"),
    }
    if revisit:
        digest = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
        return record | {"payload_bytes": int(stated[1]) if stated else None, "payload_digest": digest}
    return record | measured(content, record)


def measured(content: bytes, record: dict) -> dict:
    """Size and digest of the payload, of a record whose whole block is in ``content``."""
    low, high = record["head"] + record["http"], record["head"] + record["length"]
    payload = content[low:high]
    return {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}


def _range_rows(rows: list[dict], file: str, file_size: int, low: int) -> pa.RecordBatch:
    """The candidates of one byte range, in order; ``leaves`` is where the chain of each one leaves it.
    Offsets within a range count from its first candidate."""
    span = sum(r["size"] for r in rows)
    leaves: dict[int, int] = {}
    for r in reversed(rows):
        if r["next"] is not None:
            r["leaves"] = leaves[r["local"]] = leaves.get(r["next"], r["next"]) if r["next"] < span else r["next"]
        r |= {"file": file, "file_size": file_size, "low": low, "span": span}
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (value, file, size, start of the byte range), each range in order, to candidates. The text before
    the first magic of a file is no candidate; it counts as if a magic came before it."""
    at, rows, local = None, [], 0
    for batch in batches:
        for value, *place in zip(*(c.to_pylist() for c in batch.columns)):
            if place != at:
                if rows:
                    yield _range_rows(rows, *at)
                at, rows, local = place, [], 0
            size = len(MAGIC) + len(value)
            record = parsed(value) if local or place[2] else None
            if record:
                record["next"] = local + len(MAGIC) + record["head"] + record["length"] + len(END)
            rows.append({"local": local, "size": size, "next": None} | (record or {}))
            local += size
    if rows:
        yield _range_rows(rows, *at)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("low"))


def _chain(batch: pa.Table, entry: int) -> list[int]:
    """Row numbers of the records of a range, from the candidate at ``entry`` on."""
    at = {local: i for i, local in enumerate(batch["local"].to_pylist())}
    following, found, local = batch["next"].to_pylist(), [], entry
    while local in at and following[at[local]] is not None:
        found.append(at[local])
        local = following[at[local]]
    return found


def _kept(candidates: pa.Table, entries: pa.Table) -> pa.Table:
    """A range's records: what the chain from its entry reaches."""
    if not len(entries) or not len(candidates):
        return candidates.slice(0, 0)
    candidates = candidates.sort_by("local")
    return candidates.take(pa.array(_chain(candidates, entries["local"][0].as_py()), pa.int64()))


def _bases(candidates: DataFrame) -> DataFrame:
    """(file, low, base): the offset of each byte range's first candidate in its file."""
    spans = candidates.groupBy("file", "low").agg(F.max("span").alias("span"))
    before = Window.partitionBy("file").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)  # the byte ranges of one file
    # The text before a file's first magic is counted with a magic of its own.
    return spans.select("file", "low", (F.coalesce(F.sum("span").over(before), F.lit(0)) - len(MAGIC)).alias("base"))


def chained(candidates: DataFrame, bases: DataFrame) -> DataFrame:
    """The candidates that the chain of boundaries reaches from the start of their file, with ``offset``."""
    folder = shared_folder(candidates.sparkSession)
    most = bases.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    pointers = candidates.filter("next is not null").join(bases, ["file", "low"]).select(
        "file", (F.col("base") + F.col("local")).alias("offset"), (F.col("base") + F.col("leaves")).alias("leaves"), "low", "local")
    # Only candidates that some chain of an earlier range leads to, or that start a file, are ever entered.
    targets = pointers.select("file", F.col("leaves").alias("offset")).union(pointers.filter("offset = 0").select("file", "offset")).distinct()
    enterable = written_to(folder, pointers.join(targets, ["file", "offset"]), "enterable")
    reached, jumps = enterable.filter("offset = 0").select("file", "offset"), enterable.select("file", "offset", "leaves")
    for _ in range(max(most - 1, 0).bit_length()):
        onward = reached.join(jumps, ["file", "offset"]).select("file", F.col("leaves").alias("offset"))
        reached = written_to(folder, reached.union(onward).distinct(), "reached")
        then = jumps.select("file", F.col("offset").alias("leaves"), F.col("leaves").alias("beyond"))
        jumps = written_to(folder, jumps.join(then, ["file", "leaves"]).select("file", "offset", F.col("beyond").alias("leaves")), "jumps")
    entries = reached.join(enterable, ["file", "offset"]).groupBy("file", "low").agg(F.min("local").alias("local"))
    kept = candidates.groupBy("file", "low").cogroup(entries.groupBy("file", "low")).applyInArrow(_kept, _CANDIDATES)
    return kept.join(bases, ["file", "low"]).withColumn("offset", F.col("base") + F.col("local"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in ``path``: page_id, payload_bytes, payload_digest, record_type,
    refers_to (null but for revisits), url, whole (false for a record that its file cuts short). Of a
    response, size and digest are those of the payload that was read; of a revisit, those it states.

    Files may be cut into byte ranges anywhere. Records come out once, wherever they lie; an empty folder
    gives no rows."""
    folder = shared_folder(spark)
    candidates = written_to(folder, _pieces(spark, path).mapInArrow(_candidates, _CANDIDATES), "candidates")
    bases = written_to(folder, _bases(candidates), "ranges")
    found = written_to(folder, chained(candidates, bases), "records")
    total = F.col("next") - F.col("local")
    whole = found.filter(F.col("size") >= total).select(*_FACTS, F.lit(True).alias("whole"))
    cut = found.filter(F.col("size") < total).select("file", F.col("offset").alias("record"), total.alias("total"))
    if not cut.isEmpty():
        whole = whole.unionByName(_put_together(spark, path, candidates, bases, cut))
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "whole")


def _joined(table: pa.Table) -> pa.Table:
    """The pieces of one record, in order, as a record."""
    pieces = table.sort_by("offset")
    content = MAGIC.encode().join(pieces["value"].to_pylist())
    record, total = parsed(content), pieces["total"][0].as_py() - len(MAGIC)
    facts = {k: record[k] for k in _FACTS} | {"whole": len(content) >= total}
    schema = pa.schema([*(_SCHEMA.field(k) for k in _FACTS), ("whole", pa.bool_())])
    return pa.Table.from_pylist([facts], schema=schema)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as for ``_candidates``, each with its offset from the first of its byte range."""
    at, local = None, 0
    for batch in batches:
        locals_, places = [], list(zip(*(c.to_pylist() for c in batch.columns[1:])))
        for place, size in zip(places, pc.binary_length(batch.column(0)).to_pylist()):
            at, local = place, 0 if place != at else local
            locals_.append(local)
            local += size + len(MAGIC)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), pa.array(locals_, pa.int64())], names=["value", "file", "low", "local"])


def _put_together(spark: SparkSession, path: str, candidates: DataFrame, bases: DataFrame, cut: DataFrame) -> DataFrame:
    """Records in several pieces. A piece belongs to the record that starts last at or before it, if that
    record reaches over it; which pieces that are is known from the candidates alone, and bytes are taken
    for those pieces only."""
    places = candidates.join(cut.select("file").distinct(), "file", "left_semi").join(bases, ["file", "low"]).select(
        "file", (F.col("base") + F.col("local")).alias("offset"), F.struct("low", "local").alias("piece"), F.lit(None).cast("struct<record:long,total:long>").alias("owner"))
    starts = cut.select(
        "file", F.col("record").alias("offset"), F.lit(None).cast("struct<low:long,local:long>").alias("piece"), F.struct("record", "total").alias("owner"))
    last = Window.partitionBy("file").orderBy("offset", F.col("owner").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    owned = (
        places.union(starts).withColumn("owner", F.last("owner", ignorenulls=True).over(last))
        .filter("piece is not null and offset < owner.record + owner.total")
        .select("file", "piece.low", "piece.local", "offset", "owner.record", "owner.total")
    )
    owned = written_to(shared_folder(spark), owned, "owned")
    numbered = _pieces(spark, path).mapInArrow(_numbered, "value binary, file string, low long, local long")
    pieces = numbered.join(owned, ["file", "low", "local"]).select("file", "record", "offset", "total", "value")
    types = dict(f.split() for f in _CANDIDATES.split(", "))
    return pieces.groupBy("file", "record").applyInArrow(_joined, ", ".join(f"{k} {types[k]}" for k in _FACTS) + ", whole boolean")


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL, from the pages themselves."""
    letters = " || ".join(
        f"substr('{_ALPHABET}', ((('0x' || substr(d, {5 * (i // 4) + 1}, 5))::int >> {15 - 5 * (i % 4)}) & 31) + 1, 1)" for i in range(32))
    return f"""
with rows as (select page_id, url, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as d from pages),
held as (select *, max(page_id) over (partition by d, payload_bytes) as holder from rows)
select page_id, payload_bytes, {letters} as payload_digest, case when page_id = holder then 'response' else 'revisit' end as record_type,
       case when page_id <> holder then holder end as refers_to, coalesce(url, '') as url, true as whole
from held"""
