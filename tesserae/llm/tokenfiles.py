"""Token counts of documents in flat, unindexed token files.

A token file holds little-endian unsigned 16-bit ids of one document after another, each
followed by the end-of-document id; nothing says where a document begins. Blocks of a
file are searched for that id with vector operations; a block knows the documents that
begin and end in it, the ids before its first separator and those after its last. A
prefix scan over the blocks of a file stitches documents that cross blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import narrowed, shared_path
from tesserae.llm.tokens import word_tokenizer

#: The tokenizer's <|endoftext|>; a text that contains that string is encoded as ordinary text.
END_ID = 49407
#: Ids in a block.
BLOCK = 1 << 19


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, text_col: str = "text") -> None:
    """Write the ids of every whole text, ``end_id`` after each, to flat files, one a task.

    Null and empty texts have no ids. Spark's text writer does the writing, with the two
    bytes of ``end_id`` as line separator, so files are committed as any others are.
    """

    def encode(batches):
        tok = word_tokenizer(tokenizer, special_as_text=True)
        for batch in batches:
            out = [np.frombuffer(tok.ids(t.as_py()), np.uint32).astype("<u2").tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    text = narrowed(docs, text=text_col).select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    ids = text.mapInArrow(encode, "ids binary").select(F.col("ids").cast("string").alias("value"))
    separator = end_id.to_bytes(2, "little").decode("latin-1")
    ids.write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def block_boundaries(ids: np.ndarray, end_id: int) -> tuple[np.ndarray, int]:
    """(positions after each separator, ids after the last one) of one block."""
    after = np.flatnonzero(ids == end_id) + 1
    return after, len(ids) - (int(after[-1]) if len(after) else 0)


def scan_token_files(spark: SparkSession, path: str, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Documents of the flat token files under ``path``: (file, ordinal, start, n_tokens).

    ``file`` is the file's name; of files that Spark wrote its part's, without the random rest.

    ``start`` counts ids from the file's begin, ``n_tokens`` leaves the separator out;
    adjacent separators enclose a document of 0 tokens. Ids after a file's last separator
    make a last document if there are any. Empty files have none. A file of an odd number of bytes
    isn't a token file and is refused. A file is read by one task, so writers should
    keep files to some hundred megabytes (2 GB at most).
    """

    def search(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                if data.size % 2:
                    raise ValueError(f"{name} has an odd number of bytes")
                ids = np.frombuffer(data, "<u2")
                for n, at in enumerate(range(0, len(ids), block)):
                    part = ids[at : at + block]
                    after, tail = block_boundaries(part, end_id)
                    last = at + block >= len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([n], pa.int64()), pa.array([at], pa.int64()), pa.array([tail], pa.int64()),
                         pa.array([last]), pa.array([after.astype(np.int32)], pa.list_(pa.int32()))],
                        names=["file", "block", "at", "tail", "last", "after"])

    files = spark.read.format("binaryFile").load(path).where("length > 0")
    files = files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"^(part-[0-9]+)-.*$", "$1").alias("file"), "content")
    blocks = files.mapInArrow(search, "file string, block long, at long, tail long, last boolean, after array<int>")
    # The scan: how many documents ended before a block, and where the one that is open there began.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("after")
    open_at = F.when(n > 0, F.col("at") + F.try_element_at("after", F.lit(-1)))
    blocks = blocks.select(
        "file", "at", "last", "after", "tail", F.coalesce(F.sum(n).over(before), F.lit(0)).alias("ended"),
        F.coalesce(F.last(open_at, ignorenulls=True).over(before), F.lit(0)).alias("began"))
    # Ends of the block's documents; a file's last ids, if no separator follows, end where a separator would.
    ends = F.transform("after", lambda x: F.col("at") + x)
    rest = F.col("last") & (F.col("tail") > 0)
    length = F.col("at") + F.coalesce(F.try_element_at("after", F.lit(-1)), F.lit(0)) + F.col("tail") + 1
    ends = F.when(rest, F.concat(ends, F.array(length))).otherwise(ends)
    ended = blocks.select("file", "ended", "began", ends.alias("ends")).where(F.size("ends") > 0)
    starts = F.concat(F.array("began"), F.slice("ends", 1, F.size("ends") - 1))
    rows = ended.select("file", "ended", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("ends").alias("end"))).alias("i", "d"))
    return rows.select("file", (F.col("ended") + F.col("i")).alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start") - 1).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, end_id: int = END_ID, text_col: str = "text") -> DataFrame:
    """Write ``docs`` as token files in the shared folder and scan them back.

    One row per document: (file, ordinal, start, n_tokens); in a file, documents are in
    the order in which its task read them.
    """
    path = shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id, text_col)
    return scan_token_files(docs.sparkSession, path, end_id)
