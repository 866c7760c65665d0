"""Token counts with a digest cache.

A count is stored under the digest of the normalised content and the digest of the
tokenizer. A run joins the digests of its documents to the cache, encodes each
distinct missing content once, appends the new counts and joins them back, so a
second run over the same or overlapping documents encodes only what is new.

Encoding is done by the library, piece of text by piece of text: no entry of the
vocabulary has a blank after another character, so a text may be cut before each run
of blanks, and the counts of the parts add up. A worker keeps the counts of parts it
has seen, up to a fixed number of them, and asks the library for the rest. A
vocabulary that has such an entry is encoded whole.

How it runs: digests are computed on the JVM side. Counting copies, finding misses and
joining back move digests only; texts are shuffled once, each content once per task,
to the misses that they are. A content that a third of all documents share is one miss; the
join back reads stored tables, so adaptive execution may split it.

The cache is a folder of Parquet files in storage that all executors share. Each run
appends a batch folder of its own; if two runs add the same content, the rows agree
and one is used. The normalisation is part of the key.

Defined results: a null text is an empty one and has 0 tokens. Repeated rows and null
ids are counted like others. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import cut_lineage, ready_for_python
from linkloom.llm.pieces import Remembered, once

LIMIT = 4096
#: Parts of texts a worker remembers.
REMEMBERED = 1_000_000
BLANK = "▁"
CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
_PARTS = re.compile(f"{BLANK}+[^{BLANK}]*")


class PieceCounter:
    """Counts of whole texts as a sentencepiece model gives them, without begin and end."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        self.separable = not any(BLANK in p.lstrip(BLANK) for p in pieces) and self._keeps_blanks()
        self.blank = len(self.library.encode("a ")) - len(self.library.encode("a"))
        self.seen = Remembered(self._lengths, REMEMBERED)

    def _keeps_blanks(self) -> bool:
        """The model adds one blank in front and changes no other character."""
        given = " a  b　ﬁ\t "
        return self.library.decode(self.library.encode(given)) == given and self.library.encode("a") == self.library.encode("b a")[1:]

    def _lengths(self, pieces: list[str]) -> list[int]:
        # the library puts one blank in front of what it is given, except of nothing
        return [len(x) if p else self.blank for p, x in zip(pieces, self.library.encode(pieces, num_threads=1), strict=True)]

    def _parts(self, text: str) -> list[str]:
        """What to give to the library: each run of blanks with what follows, less one blank."""
        if "  " not in text and BLANK not in text and text[:1] != " ":
            return text.split(" ") if text else []
        return [p[1:] for p in _PARTS.findall(BLANK + text.replace(" ", BLANK))]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.separable:
            return [len(x) for x in self.library.encode(texts, num_threads=1)]
        parts = list(map(self._parts, texts))
        get = self.seen.group(list(chain.from_iterable(parts))).__getitem__
        return [sum(map(get, own)) for own in parts]


def file_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def read_cache(spark: SparkSession, cache_dir: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) stored for a tokenizer; empty when there is no cache yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "content string, n_tokens long")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    cache_dir: str,
    model_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and cached (known before this run) of each document.

    ``model_file`` is a path at which every executor has the model.
    """
    spark = docs.sparkSession
    ready_for_python(spark)
    tokenizer = file_digest(model_file)
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn(
        "content", F.sha2(F.encode("text", "UTF-8"), 256)
    )
    narrow = cut_lineage(given.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")))
    known = read_cache(spark, cache_dir, tokenizer)
    misses = cut_lineage(narrow.select("content").distinct().join(known, "content", "left_anti"))
    # repeats of a content become one row in each task, and one in all, before anything is encoded
    distinct = given.groupBy("content").agg(F.first("text").alias("text"))
    wanted = distinct.join(misses, "content", "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or once(("pieces", tokenizer), lambda: PieceCounter(model_file))
            n = len(batch)
            # long texts go in small groups, so the parts of few texts are held at once
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(sizes // 500_000)) + 1), n] if n else [0]
            counts: list[int] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                counts += counter.counts(batch.column("text").slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([tokenizer] * n, pa.string()), pa.array(counts, pa.int64())],
                ["content", "tokenizer", "n_tokens"],
            )

    wanted.select("content", "text").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_dir)
    counts = cut_lineage(read_cache(spark, cache_dir, tokenizer))
    new = misses.select(F.col("content").alias("m"))
    return (
        narrow.join(counts, "content")
        .join(new, F.col("content") == F.col("m"), "left")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.col("m").isNull().alias("cached"))
    )
