"""Token ids as Parquet list columns.

Documents are range-partitioned by id, encoded, and written in ascending id order: one file a partition, so file
names follow the ids. The writer's row groups and pages are sized, integers are delta- or dictionary-encoded, and
each page has its entry in the column index, so a reader that wants a few ids or only the metadata reads those
pages and columns alone.

Defined results: null text counts as empty and gives the end id alone; null ids sort first; repeated ids keep a
row each, ordered by the hash of the text; an empty table gives empty files; of the input's columns only the named ones
are used.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.llm import words
from tessitura.llm.common import scratch_dir, ship, staged, table

END_ID = 1
_caches: dict[str, words.Cache] = {}


#: Characters that lower case and composition treat one by one, so a word of these can be cut before it is normalised.
_PLAIN = re.compile("[\0-\u012f\u0131-\u024f]*")
# Fixed value: the pre-tokeniser's pattern.
_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return {b: chr(b if b in printable else next(other)) for b in range(256)}


class Words:
    """Ids, as bytes, of what stands between two spaces. The tokenizer's model encodes each distinct pre-token once; a
    word with other than plain characters or with an added token's content goes through the whole tokenizer."""

    def __init__(self, path: str, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.limit, self.known = self.tokenizer.model, limit, {}
        self.letters, self.pattern = _byte_letters(), regex.compile(_PRETOKEN)
        shape = json.loads(self.tokenizer.to_str())
        added = [re.escape(x["content"].lower()) for x in shape["added_tokens"]]
        self.added = re.compile("|".join(added) or "(?!)")
        split = (shape["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        steps = [x.get("type") for x in (shape["normalizer"] or {}).get("normalizers", [])]
        self.short = split.get("pattern", {}).get("Regex") == _PRETOKEN and steps == ["NFC", "Replace", "Lowercase"]

    def piece(self, p: str) -> bytes:
        got = self.known.get(p)
        if got is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            got = self.known[p] = array("i", [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, p.encode())))]).tobytes()
        return got

    def word(self, w: str) -> bytes:
        low = w.lower()
        if not self.short or not _PLAIN.fullmatch(w) or self.added.search(low):
            return array("i", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()
        w = low
        if w.isalpha():
            return self.piece(w)
        core = w.rstrip(".,!?;:")
        if core.isalpha():
            return self.piece(core) + self.piece(w[len(core):])
        return b"".join(map(self.piece, self.pattern.findall(w)))


def encoder(path: str) -> words.Cache:
    """A cache over the tokenizer in that file. Its normaliser and pre-tokeniser never look across a space or a line
    feed, so a text's ids are those of its words between them."""
    if path not in _caches:
        w = Words(path)
        _caches[path] = words.Cache(lambda ws: [w.word(x) for x in ws], limit=600_000)
    return _caches[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Rows (part, seq, id, n_tokens, ids) in ascending id order, part and seq counting partitions and rows in them."""
    spark = ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    d = d.repartitionByRange(F.col("id").asc()).sortWithinPartitions(F.col("id").asc(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, cache = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for b in words.chunks(batches, "text", 4_000_000):
            distinct, index, offsets = words.split(b.column("text"))
            ids, at = words.spread(cache.get(distinct), index, offsets)
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), b.column("id"),
                pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))),
            ], ["part", "seq", "id", "n_tokens", "ids"])
            seq += n

    return d.mapInArrow(run, f"part int, seq bigint, id {id_type}, n_tokens bigint, ids array<int>")


def write(encoded: DataFrame, path: str, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    """Format version 2: ids are dictionary-encoded while their dictionary fits a page, delta-encoded beyond."""
    (encoded.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes).option("parquet.dictionary.page.size", page_bytes).parquet(path))


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    return spark.read.schema(f"part int, seq bigint, id {id_type}, n_tokens bigint, ids array<int>").parquet(path)


def metadata(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Ids and lengths without the token pages."""
    return read(spark, path, id_type).select("id", "n_tokens")


def tokens(spark: SparkSession, path: str, first, last, id_type: str = "bigint") -> DataFrame:
    """The documents with ids from first to last; row groups and pages outside that range are skipped by their index."""
    return read(spark, path, id_type).where(F.col("id").between(first, last)).select("id", "ids")


def checksums(encoded: DataFrame) -> DataFrame:
    """(part, seq, id, n_tokens, ids_crc32) from rows as read: both figures come from the ids themselves."""
    id_type = encoded.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at = lists.offsets.to_numpy()
            ids = memoryview(np.ascontiguousarray(lists.values.to_numpy(), dtype="<u4")).cast("B")
            crc = [zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("seq"), b.column("id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "seq", "id", "n_tokens", "ids_crc32"])

    return encoded.select("part", "seq", "id", "ids").mapInArrow(run, f"part int, seq bigint, id {id_type}, n_tokens bigint, ids_crc32 bigint")


def starts(sums: DataFrame) -> DataFrame:
    """sums with `start`, the ids of all documents before: totals by part, then a running sum inside a part."""
    parts = sums.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = parts.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return sums.withColumn("inside", inside).join(before, "part").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = f"{scratch_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(encode(table(spark, sf_dir, "documents"), tokenizer), path)
    sums = staged(checksums(read(spark, path)), "token-sums")
    return starts(sums).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
