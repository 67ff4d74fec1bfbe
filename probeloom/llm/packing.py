"""Packing of tokenised documents by concatenation and cutting.

Pass one tokenises each document once, stores its ids and keeps a running sum
inside its partition. The partition totals (one number per task) are summed up
to global offsets. Pass two cuts every document at the multiples of the sequence
length; a document that crosses a boundary gives one record per side, so no
partition waits for another.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probeloom.llm.common import table
from probeloom.session import materialize

LENGTH = 1024
END_ID = 0
# Units remembered by a worker; the memory is emptied when full.
REMEMBERED = 400_000

STORED = "part int, doc_id long, start long, n long, ids binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


class Units(dict):
    """Ids of one space-led unit, encoded when first met."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, unit):
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[unit] = self.encode(" " + unit)
        return found


class Encoder:
    """Little-endian uint32 ids of whole texts by a byte-level vocabulary.

    Where no two white-space characters meet, the vocabulary's own pattern never
    joins text across a space that leads a unit, so units between spaces can be
    encoded, and remembered, on their own. Other texts are encoded whole. Strings
    of special tokens become the special ids, as in the tokenizers library.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = lambda text: np.array(bpe.encode_ordinary(text), "<u4").tobytes()
        self.units = Units(self.whole)
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.crowded = regex.compile(r"\s\s")

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.crowded.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        if rest and not rest[-1]:  # ends in a space
            return self.whole(text)
        return self.whole(first) + b"".join(map(self.units.__getitem__, rest))

    def __call__(self, text: str) -> bytes:
        if self.split is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(self.special.get(x) or self.plain(x) for x in self.split.split(text))


ENCODERS: dict[tuple, Encoder] = {}


def encoder(ranks_path: str, pattern: str, special: dict[str, int]) -> Encoder:
    """One encoder per worker process, kept between tasks."""
    key = (ranks_path, pattern, *special.items())
    if key not in ENCODERS:
        ENCODERS[key] = Encoder(ranks_path, pattern, special)
    return ENCODERS[key]


def tokenised(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int]) -> DataFrame:
    """part, doc_id, start (in the part), n, ids: stored, one row per document."""

    def run(batches):
        encode, part, at = encoder(ranks_path, pattern, special), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            texts = batch.column(1)
            for low in range(0, len(texts), 256):
                ids = [encode(t or "") + end for t in texts.slice(low, 256).to_pylist()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids), part, np.int32)), batch.column(0).slice(low, 256),
                    pa.array(start), pa.array(n), pa.array(ids, pa.binary()),
                ], ["part", "doc_id", "start", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(run, STORED), "tokens")


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Adds ``base``: the ids in all earlier partitions. One row per task is summed."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return tokens.join(F.broadcast(bases), "part")


def cut(placed: DataFrame, length: int) -> DataFrame:
    """One row per piece of a document that lies in one sequence."""

    def run(batches):
        for batch in batches:
            base, start, n = (batch.column(i).to_numpy() for i in (0, 1, 2))
            first = base + start
            pieces = (first + n - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            within = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = (first // length)[row] + within
            low = np.maximum(sequence * length, first[row])
            high = np.minimum((sequence + 1) * length, (first + n)[row])
            ids = [memoryview(x) for x in batch.column(4).to_pylist()]
            own = low - first[row]
            sums = [zlib.crc32(ids[r][4 * a:4 * (a + k)]) for r, a, k in zip(row.tolist(), own.tolist(), (high - low).tolist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(3).take(pa.array(row)), pa.array(own), pa.array(high - low), pa.array(sums, pa.int64()),
                pa.array(n[row]), pa.array(sequence), pa.array(low - sequence * length),
            ], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.select("base", "start", "n", "doc_id", "ids").mapInArrow(run, PIECES)


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], length: int = LENGTH) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` ids.

    Every document ends in id 0; a null or empty text is that id alone. Repeated
    rows are packed each. Only the last sequence can be short. Columns other than
    doc_id and text are ignored; an empty table gives no rows.
    """
    return cut(with_offsets(tokenised(docs, ranks_path, pattern, special)), length)


def public_vocabulary() -> tuple[str, str, dict[str, int]]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), *public_vocabulary())
