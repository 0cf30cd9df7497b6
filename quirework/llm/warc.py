"""Content-addressed WARC archive.

Payload bytes are stored once per strong digest (SHA-256, checked again on
reading); exact record headers are a separate table; joining them by digest gives
the original records back. Of equal payloads of at least ``min_revisit`` bytes the
smallest page_id is the response and the others are revisits of it.

Defined results: a null html or url is empty; of repeated page_ids each row has a
record and the same rule holds (rows of the smallest id are all responses); null
page_ids are responses; an empty table gives an empty archive; extra columns are
ignored. Line ends in a url are written as spaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: Fixed value: the base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Fixed value: the profile of a revisit with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CAPTURED = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, in built-in functions: 40 bits of hex at a time."""
    digest, parts = F.sha1(payload), []
    for at in range(0, 40, 10):
        bits = F.conv(F.substring(digest, at + 1, 10), 16, 10).cast("long")
        parts += [F.substr(F.lit(BASE32), (F.shiftright(bits, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*parts)


@dataclass
class Archive:
    headers: DataFrame  #: page_id, record_type, refers_to, payload_bytes, strong (payload's key), header
    payloads: DataFrame  #: strong, payload


def _header(record_type: str, uri: Column, page_id: Column, digest: Column, length: Column, refers: Column | None) -> Column:
    lines = ["WARC/1.0", F.lit(f"WARC-Type: {record_type}"), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), uri), F.lit(f"WARC-Date: {CAPTURED}"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest)]
    if refers is not None:
        lines += [F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers.cast("string"), F.lit(">"))]
    lines += [F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), length.cast("string"))]
    return F.concat(F.concat_ws(CRLF, *[F.lit(x) if isinstance(x, str) else x for x in lines]), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, min_revisit: int = 0, name: str = "warc") -> Archive:
    """Two Parquet tables in the shared folder. Payload bytes are shuffled once, by page_id."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    light = save(p.select("page_id", "url", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("strong"), base32_sha1(F.col("payload")).alias("digest")), f"{name}-digests")
    first = light.groupBy("strong").agg(F.min("page_id").alias("first_id")).select(F.col("strong").alias("strong_"), "first_id")
    marked = light.join(first, light["strong"] == first["strong_"], "left")
    again = (F.col("payload_bytes") >= min_revisit) & (F.col("page_id") > F.col("first_id"))
    uri = F.regexp_replace("url", r"[\r\n]", " ")
    shape = [F.col("page_id"), F.col("digest"), F.col("payload_bytes")]
    marked = marked.select(
        "page_id", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"), "payload_bytes", "strong",
        F.when(again, _header("revisit", uri, shape[0], shape[1], F.lit(0), F.col("first_id"))).otherwise(_header("response", uri, shape[0], shape[1], shape[2], None)).alias("header"),
    )
    headers = save(marked, f"{name}-headers")
    # One row of each digest keeps its bytes: the first page's, or one without page_id where there is no other.
    none = F.lit(-(2**63))
    keyed = first.select("strong_", F.coalesce("first_id", none).alias("first_"))
    own = p.select(F.coalesce("page_id", none).alias("own_"), F.sha2("payload", 256).alias("strong"), "payload")
    stored = own.join(keyed, (own["strong"] == keyed["strong_"]) & (own["own_"] == keyed["first_"]), "left_semi").dropDuplicates(["strong", "own_"]).select("strong", "payload")
    return Archive(headers, save(stored, f"{name}-payloads"))


def verified(archive: Archive) -> DataFrame:
    """strong, payload_bytes, payload_digest of every stored payload, from its bytes; a payload that isn't what its key says is an error."""
    return archive.payloads.select(
        F.when(F.sha2("payload", 256) == F.col("strong"), F.col("strong")).otherwise(F.raise_error(F.lit("stored payload does not match its digest"))).alias("strong_"),
        F.length("payload").cast("long").alias("stored_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
    )


def records(archive: Archive, full: bool = False) -> DataFrame:
    """The exact records: header, payload (none for revisits unless ``full``), two line ends."""
    p = archive.payloads.withColumnRenamed("strong", "strong_")
    own = archive.headers if full else archive.headers.withColumn("strong", F.when(F.col("record_type") == "response", F.col("strong")))
    joined = own.join(p, own["strong"] == p["strong_"], "left")
    body = F.coalesce("payload", F.lit("").cast("binary"))
    return joined.select("page_id", "record_type", F.concat(F.col("header").cast("binary"), body, F.lit(CRLF + CRLF).cast("binary")).alias("record"), body.alias("payload"))


def read_back(archive: Archive) -> DataFrame:
    """What the archive says of each page: type and reference from its header's lines, size and digest from the stored bytes."""
    v, h = verified(archive), archive.headers
    line = lambda name: F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1)
    number = F.regexp_extract(line("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1)
    return h.join(v, h["strong"] == v["strong_"], "left").select(
        "page_id", F.col("stored_bytes").alias("payload_bytes"), "payload_digest", line("WARC-Type").alias("record_type"), F.when(number != "", number.cast("long")).alias("refers_to"),
    )


def parse(blob: bytes) -> list[dict]:
    """Records of one WARC file's bytes: its header fields, and its block under 'block'."""
    out, at = [], 0
    while at < len(blob):
        end = blob.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in blob[at:end].decode().split(CRLF)[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        out.append(fields | {"block": blob[start:stop]})
        at = stop + 4
    return out


def read_files(spark, path: str) -> DataFrame:
    """Records of WARC files: path, record_type, uri, payload."""
    import pandas as pd

    def each(batches):
        for pdf in batches:
            rows = [(p, r.get("WARC-Type"), r.get("WARC-Target-URI"), r["block"]) for p, blob in zip(pdf.path, pdf.content) for r in parse(blob)]
            yield pd.DataFrame(rows, columns=["path", "record_type", "uri", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, "path string, record_type string, uri string, payload binary")
