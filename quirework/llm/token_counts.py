"""Token counts of flat token files.

``write_tokens`` writes documents as flat little-endian 16-bit token files without an
index: a document's tokens, then one end-of-document identifier. Identifiers are
shifted by one so that 0 is the separator. Files are of bounded size and gzipped; a
file's documents are in the order of its manifest.

``count_tokens`` knows only the files: each is cut into blocks, separators are found
in a block by a vectorised search, and every block is summed up as (separators,
tokens before the first, tokens after the last). An exclusive scan over a file's
block sums, restarted where a block has a separator, gives the tokens that run on
into each block, and the number of documents before it.

Defined results: null and empty texts have 0 tokens; a file's last document may lack
its separator; an empty file has no documents; repeated rows are documents of their
own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
SEPARATOR_ID = 0
#: Tokens in one block of the scan; documents of one file.
BLOCK_TOKENS = 1 << 18
FILE_DOCUMENTS = 8000
_encoders: dict[str, object] = {}


def encoder(path: str):
    """A tiktoken encoding from a rank file; one a process."""
    if path not in _encoders:
        import importlib.util

        import tiktoken

        spec = importlib.util.spec_from_file_location("tokenizer_files", f"{path.rpartition('/')[0]}/__init__.py")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> None:
    """Token files under ``path``; every document is followed by the separator."""

    def encode(batches):
        enc = encoder(vocabulary)
        for pdf in batches:
            out = []
            for text in pdf.text:
                ids = np.array(enc.encode_ordinary(text or ""), dtype=np.int64) + 1
                if len(ids) and ids.max() >= 1 << 16:
                    raise ValueError("the vocabulary has identifiers of more than 16 bits")
                out.append(ids.astype("<u2").tobytes())
            yield pd.DataFrame({"tokens": out})

    tokens = docs.select("text").mapInPandas(encode, "tokens binary")
    # The line separator of the text writer is the separator's own two bytes; the cast leaves bytes as they are.
    tokens.select(F.col("tokens").cast("string").alias("value")).write.option("lineSep", "\0\0").option("maxRecordsPerFile", FILE_DOCUMENTS).option("compression", "gzip").text(path)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, part, file_no, doc_no: where write_tokens puts each document. Both read ``docs`` in its own order, as a scan of files has one."""
    place = F.monotonically_increasing_id()
    n = docs.select("doc_id", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    return n.select("doc_id", "part", F.expr(f"row div {FILE_DOCUMENTS}").alias("file_no"), (F.col("row") % FILE_DOCUMENTS).alias("doc_no"))


def scan_block(tokens: np.ndarray) -> tuple[int, int, int, list[int]]:
    """(separators, tokens before the first or all, tokens after the last or all, counts between them)."""
    at = np.flatnonzero(tokens == SEPARATOR_ID)
    if not len(at):
        return 0, len(tokens), len(tokens), []
    return len(at), int(at[0]), int(len(tokens) - at[-1] - 1), (np.diff(at) - 1).tolist()


def scan_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, separators, head, tail, inner of all blocks."""

    def scan(batches):
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                stream = zlib.decompressobj(zlib.MAX_WBITS | 32) if content[:2] == b"\x1f\x8b" else None
                rows, rest, no = [], b"", 0
                todo = content
                while todo or rest:
                    piece = (stream.decompress(todo, 2 * block_tokens - len(rest)) if stream else todo[: 2 * block_tokens - len(rest)])
                    todo = (stream.unconsumed_tail if stream else todo[2 * block_tokens - len(rest) :])
                    rest += piece
                    if len(rest) < 2 * block_tokens and todo and piece:
                        continue
                    if len(rest) % 2:
                        raise ValueError(f"{name} isn't made of 16-bit tokens")
                    if rest:
                        rows.append((name, no, *scan_block(np.frombuffer(rest, "<u2"))))
                    rest, no = b"", no + 1
                    if not piece and not todo:
                        break
                yield pd.DataFrame(rows, columns=["file", "block", "separators", "head", "tail", "inner"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(scan, "file string, block int, separators int, head long, tail long, inner array<long>")


def stitched(blocks: DataFrame) -> DataFrame:
    """file, doc_no, n_tokens: counts with what runs on over block ends."""
    order = Window.partitionBy("file").orderBy("block")
    b = blocks.withColumn("run", F.sum((F.col("separators") > 0).cast("int")).over(order))
    b = b.withColumn("held", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block")))
    b = b.withColumn("carry", F.coalesce(F.lag("held").over(order), F.lit(0)))
    b = b.withColumn("first", F.coalesce(F.sum("separators").over(order) - F.col("separators"), F.lit(0)))
    b = b.withColumn("is_last", F.lead("block").over(order).isNull())
    open_end = F.when(F.col("is_last") & (F.col("held") > 0), F.array(F.col("held"))).otherwise(F.array().cast("array<bigint>"))
    closed = F.when(F.col("separators") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    return b.select("file", "first", F.posexplode(F.concat(closed, open_end)).alias("i", "n_tokens")).select("file", (F.col("first") + F.col("i")).alias("doc_no"), "n_tokens")


def count_tokens(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    return stitched(scan_files(spark, path, block_tokens))


def document_counts(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """doc_id, n_tokens of every document, from its tokens in flat files written to the shared folder."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary)
    counted = count_tokens(spark, path)
    name = r"part-(\d+)-.*[.-]c(\d+)\."
    counted = counted.select(F.regexp_extract("file", name, 1).cast("long").alias("part_"), F.regexp_extract("file", name, 2).cast("long").alias("file_"), F.col("doc_no").alias("doc_"), "n_tokens")
    m = manifest(docs)
    joined = m.join(counted, (m["part"] == counted["part_"]) & (m["file_no"] == counted["file_"]) & (m["doc_no"] == counted["doc_"]), "left")
    return joined.select("doc_id", F.coalesce("n_tokens", F.raise_error(F.lit("a document isn't in the token files")).cast("long")).alias("n_tokens"))
