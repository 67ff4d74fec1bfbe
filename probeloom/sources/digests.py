"""Content digests of files and tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probeloom.session import materialize

# Bytes of a leaf and digests of a node of the tree.
LEAF_BYTES = 1 << 20
FANOUT = 1024
# Splits of the files of one call; their offsets (24 bytes each) are broadcast.
MAX_SPLITS = 1_000_000
MARK = b"\xef\xbb\xbf"
# The line reader unpacks files with these endings.
PACKED = r"\.(gz|gzip|bz2|deflate|zst|lz4|snappy|xz|passthrough)$"


# Larger files are hashed in rounds of so many bytes.
WHOLE_BYTES = 128 << 20
ROUND_BYTES = 256 << 20
# Bytes of SHA256_CTX: eight words, a count of bits, an open block and two lengths.
STATE_BYTES = 112


def opener(spark: SparkSession, path, pattern: str | None):
    def opened(kind: str, **options) -> DataFrame:
        reader = spark.read.format(kind).option("recursiveFileLookup", True)
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        return reader.options(**options).load(path)

    return opened


def file_digests(spark: SparkSession, path, pattern: str | None = None,
                 whole_bytes: int = WHOLE_BYTES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """path, n_bytes, sha256 of every file below ``path``; one row per file.

    Files of up to ``whole_bytes`` are a row each. SHA-256 is a chain, so larger ones are read by
    splits, stored in pieces and hashed in rounds: a round takes the next ``round_bytes`` of every
    file, a task per file, and hands on a state of 112 bytes. No task reads more than that, whatever the
    size of a file; the driver holds the states. Where libcrypto is missing, one round takes all and a file is
    streamed through one task. A packed file (see :func:`tree_digests`) is one row at any size, so 2 GB at most,
    as Spark's line reader would unpack it. Tables are compared with :func:`fingerprint`.
    """
    opened = opener(spark, path, pattern)
    meta = F.col("_metadata")
    # Conditions on these columns are met when files are listed; the others are not opened.
    large = (meta["file_size"] > whole_bytes) & ~F.lower(meta["file_path"]).rlike(PACKED)
    whole = opened("binaryFile").filter(~large).select(
        "path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    found = opened("binaryFile").filter(large).select("path", "length", meta["file_path"].alias("file")).collect()
    if not found:
        return whole
    # The files that are still open in a round are the first of this order.
    found.sort(key=lambda r: (-r["length"], r["path"]))
    lines, _ = placed_lines(opened, F.col("file"), large)
    places = spark.createDataFrame([(r["file"], i) for i, r in enumerate(found)], "stream string, place int")
    leaf = min(LEAF_BYTES, round_bytes)
    resume = libcrypto() is not None
    step = round_bytes // leaf * leaf if resume else found[0]["length"]
    # Written in order of their places, so that a round opens only the row groups that hold a part of it.
    stored = materialize(lines.mapInArrow(
        lambda batches: pieces_of(batches, leaf, False), "stream string, leaf long, start long, digest binary, piece binary"
    ), "pieces")
    states = [(b"", 0)] * len(found)
    for k in range(-(-found[0]["length"] // step)):
        n_open = sum(r["length"] > k * step for r in found)
        part = stored.filter((F.col("start") >= k * step) & (F.col("start") < (k + 1) * step)).join(F.broadcast(places), "stream")
        part = part.select("place", "start", "piece").repartitionById(n_open, F.col("place"))
        done = part.sortWithinPartitions("place", "start").mapInArrow(
            lambda batches, states=states: hash_on(batches, states, resume), "place int, state binary, n long")
        states = list(states)
        for r in done.collect():
            states[r["place"]] = bytes(r["state"]), r["n"]
    if any(n != r["length"] for (_, n), r in zip(states, found)):
        raise ValueError("the bytes read are not those of the files: one changed meanwhile")
    rows = [(r["path"], r["length"], (digest_of(state) if resume else state).hex()) for r, (state, _) in zip(found, states)]
    return whole.unionByName(spark.createDataFrame(rows, "path string, n_bytes long, sha256 string"))


def libcrypto():
    """OpenSSL's library, whose SHA-256 keeps its state in a plain struct; hashlib's cannot be handed on."""
    for name in ("libcrypto.so.3", "libcrypto.so.1.1", "libcrypto.so", "libcrypto.3.dylib"):
        try:
            return ctypes.CDLL(name)
        except OSError:
            continue
    return None


class ResumedSha256:
    """SHA-256 that goes on from the state of another task."""

    def __init__(self, state: bytes = b""):
        self.lib = libcrypto()
        if self.lib is None:
            raise OSError("no libcrypto here, though the driver has one")
        self.context = ctypes.create_string_buffer(state, STATE_BYTES)
        if not state:
            self.lib.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.context, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self.context.raw

    def digest(self) -> bytes:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, self.context)
        return out.raw


def digest_of(state: bytes) -> bytes:
    return ResumedSha256(state).digest()


def hash_on(batches: Iterator[pa.RecordBatch], states: list[tuple[bytes, int]], resume: bool) -> Iterator[pa.RecordBatch]:
    """place, state, n: the states after the pieces of a round, which come in order; without ``resume`` digests of all."""
    open_: dict[int, list] = {}
    for batch in batches:
        for place, start, piece in zip(batch["place"].to_pylist(), batch["start"].to_pylist(), batch["piece"]):
            if place not in open_:
                open_[place] = [ResumedSha256(states[place][0]) if resume else sha256(), states[place][1]]
            own = open_[place]
            if start != own[1]:
                raise ValueError(f"bytes {own[1]} to {start} of a file are missing; it changed meanwhile")
            data = piece.as_py()
            own[0].update(data)
            own[1] += len(data)
    rows = [(i, h.state() if resume else h.digest(), n) for i, (h, n) in open_.items()]
    kinds = (pa.int32(), pa.binary(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["place", "state", "n"])


def pieces_of(batches: Iterator[pa.RecordBatch], leaf_bytes: int, hashed: bool = True) -> Iterator[pa.RecordBatch]:
    """stream, leaf, start, digest, piece: digests of leaves that lie in one split, bytes of those at its ends.

    Unless ``hashed``, the bytes of all.

    The last byte of a split is held back until its end, as the file may not close with a line feed.
    """
    out: list[tuple] = []
    split, stream, at, closed, held = None, None, 0, True, bytearray()

    def cut(last: bool) -> None:
        nonlocal at
        done = 0
        while True:
            leaf = at // leaf_bytes
            size = min((leaf + 1) * leaf_bytes - at, len(held) - done)
            whole = hashed and size == leaf_bytes
            if size == 0 or not last and done + size >= len(held):
                break
            data = bytes(held[done:done + size])
            out.append((stream, leaf, at, sha256(b"\0" + data).digest() if whole else None, None if whole else data))
            at, done = at + size, done + size
        del held[:done]

    def flush() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        names = ("stream", "leaf", "start", "digest", "piece")
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        out.clear()
        return batch

    def finish() -> None:
        if not closed and held:
            del held[-1]
        cut(True)

    for batch in batches:
        keys = list(zip(batch["key"].to_pylist(), batch["block"].to_pylist()))
        lines, i = batch["line"].to_pylist(), 0
        while i < len(keys):
            j = i + 1
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            if keys[i] != split:
                finish()
                split, stream, at = keys[i], batch["stream"][i].as_py(), batch["offset"][i].as_py()
                closed = batch["closed"][i].as_py()
                held[:] = MARK if batch["marked"][i].as_py() else b""
            held += b"\n".join(lines[i:j]) + b"\n"
            cut(False)
            i = j
        if out:
            yield flush()
    finish()
    if out:
        yield flush()


def placed_lines(opened, stream: Column, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The lines of files with the places of their splits, as :func:`pieces_of` reads them, and the files' sizes.

    ``opened`` gives a reader of a format, ``stream`` names the stream by file, ``keep`` picks files by ``_metadata``.
    """
    meta = F.col("_metadata")
    keep = F.lit(True) if keep is None else keep
    files = opened("binaryFile").filter(keep).select(meta["file_path"].alias("file"), meta["file_size"].alias("size"))
    lines = opened("text", lineSep="\n").filter(keep).select(
        F.col("value").cast("binary").alias("line"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block")
    )
    blocks = materialize(lines.groupBy("file", "block").agg(F.sum(F.octet_length("line") + F.lit(1).cast("long")).alias("n")), "splits")
    if blocks.count() > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits; digest folder by folder")
    # What the lines lack: three bytes of a mark; what they have too much: a line feed at the end.
    read = blocks.groupBy("file").agg(F.sum("n").alias("read"), F.max("block").alias("last"))
    sizes = materialize(files.join(read, "file", "left").withColumn("lack", F.col("size") - F.coalesce("read", F.lit(0))), "files")
    if sizes.filter("NOT (lack IN (0, -1) OR read IS NOT NULL AND lack IN (3, 2))").limit(1).count():
        raise ValueError("the bytes read are not those of the files: one changed meanwhile, or is a mere byte order mark")
    own = blocks.join(sizes, "file").select(
        stream.alias("stream"), "file", "block", ((F.col("block") == 0) & (F.col("lack") >= 2)).alias("marked"),
        (~((F.col("block") == F.col("last")) & F.col("lack").isin(-1, 2))).alias("closed"), "n",
    ).withColumn("n", F.col("n") + F.when(F.col("marked"), 3).otherwise(0) - F.when(F.col("closed"), 0).otherwise(1))
    before = Window.partitionBy("stream").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(own.select(
        F.xxhash64("file").alias("key"), "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), "marked", "closed"
    ), "offsets")
    if placed.count() != placed.select("key", "block").distinct().count():
        raise ValueError("two paths share a hash; digest folder by folder")
    # A broadcast keeps the lines of a split in their order.
    with_place = lines.withColumn("key", F.xxhash64("file")).join(F.broadcast(placed), ["key", "block"], "left").select(
        "key", "block", stream.alias("stream"), "line", "offset", "marked", "closed"
    ).withColumn("offset", F.when(F.col("offset").isNull(), F.raise_error(F.lit("files were split otherwise; run again"))).otherwise(F.col("offset")))
    return with_place, sizes


def tree_digests(spark: SparkSession, path, pattern: str | None = None, as_one: bool = False,
                 leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """stream, n_files, n_bytes, root: Merkle roots of files of any size, read by splits.

    A stream is a file or, ``as_one``, all files below ``path`` in order of their paths, so that a
    file cut into parts, or cut anew elsewhere, keeps its root. Leaves are ranges of ``leaf_bytes`` bytes,
    hashed where they are read; only the bytes at both ends of a split travel. The root also
    binds the number of bytes. Spark's readers pass over empty files, so these are not counted.

    Bytes come from the line reader: line feeds, a missing one at the end and a byte order
    mark are put back by the sizes of the files. A run of bytes without line feed has to fit in a row (2 GB).
    Files with an ending that Spark unpacks are refused, as are files that change meanwhile
    and a file of nothing but a byte order mark, of which the reader gives no row.
    """
    opened = opener(spark, path, pattern)
    if opened("binaryFile").filter(F.lower(F.col("_metadata.file_path")).rlike(PACKED)).select("path").limit(1).count():
        raise ValueError("packed files have no tree digest; use file_digests")
    stream = F.lit("") if as_one else F.col("file")
    with_place, sizes = placed_lines(opened, stream)
    pieces = materialize(with_place.mapInArrow(
        lambda batches: pieces_of(batches, leaf_bytes), "stream string, leaf long, start long, digest binary, piece binary"
    ), "leaves")
    joined = pieces.filter("piece IS NOT NULL").groupBy("stream", F.col("leaf").alias("n")).agg(
        F.expr("unhex(sha2(concat(X'00', listagg(piece) WITHIN GROUP (ORDER BY start)), 256))").alias("digest")
    )
    level = pieces.filter("digest IS NOT NULL").select("stream", F.col("leaf").alias("n"), "digest").unionByName(joined)
    totals = sizes.groupBy(stream.alias("stream")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))
    most = -(-(totals.agg(F.max("n_bytes")).first()[0] or 0) // leaf_bytes)
    # ``left``: nodes of the stream at this level; a stream with one is done.
    level = level.join(totals.select("stream", F.ceil(F.col("n_bytes") / leaf_bytes).alias("left")), "stream")
    while most > 1:
        node = F.expr("unhex(sha2(concat(X'01', listagg(digest) WITHIN GROUP (ORDER BY n)), 256))")
        level = level.groupBy("stream", "left", F.expr(f"n div {int(fanout)}").alias("n")).agg(node.alias("node"), F.max("digest").alias("digest"))
        level = level.select("stream", F.ceil(F.col("left") / fanout).alias("left"), "n",
                             F.when(F.col("left") == 1, F.col("digest")).otherwise(F.col("node")).alias("digest"))
        most = -(-most // fanout)
    top = F.lower(F.hex(F.coalesce("digest", F.lit(b""))))
    return totals.join(level, "stream", "left").select(
        "stream", "n_files", "n_bytes", F.sha2(F.concat_ws(":", F.col("n_bytes").cast("string"), top), 256).alias("root")
    )


def row_digest(*columns: Column) -> Column:
    """SHA-256 of the fields as text, each led by its length, so that no two lists of fields agree."""
    texts = [F.coalesce(F.concat(F.length(c.cast("string")), F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *texts), 256)


def fingerprint(df: DataFrame, keys=(), columns=None) -> DataFrame:
    """keys, n_rows, checksum: independent of row order, column order and partitioning.

    Four parts of each row digest, 240 bits together, are added up as wide
    decimals, so partial sums of any part files combine; one scan, no sort and no
    shuffle of rows.
    """
    names = sorted(columns or [c for c in df.columns if c not in keys])
    parts = []
    for name in names:
        kind = df.schema[name].dataType.simpleString()
        parts.append(F.to_json(F.struct(name)) if kind.startswith(("array", "struct", "map")) else F.col(name))
    digest = row_digest(*parts)
    # A part of 60 bits is added as three longs of 20 bits, which hold for 2^43 rows and cost less than decimals.
    sums = []
    for at in (1, 16, 31, 46):
        part = F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
        whole = F.lit(0).cast("decimal(38,0)")
        for shift in (40, 20, 0):
            third = F.sum(F.shiftright(part, shift).bitwiseAND(F.lit((1 << 20) - 1)))
            whole = whole + third.cast("decimal(19,0)") * F.lit(1 << shift).cast("decimal(13,0)")
        sums.append(whole.cast("decimal(38,0)").cast("string"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws(":", *sums).alias("checksum"))


def checksum(df: DataFrame) -> str:
    """Fingerprint of a whole table as one comparable text."""
    row = fingerprint(df).first()
    return f"{row['n_rows']}:{row['checksum']}"


def sql_checksum(texts: list[str]) -> str:
    """The checksum of :func:`fingerprint` in ANSI SQL over text expressions in order of their names."""
    fields = ", ".join(f"coalesce(CAST(length({t}) AS VARCHAR) || '=' || {t}, '-')" for t in texts)
    digest = f"sha256(concat_ws('|', {fields}))"
    sums = [f"CAST(sum(CAST(CAST('0x' || substr({digest}, {at}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for at in (1, 16, 31, 46)]
    return f"concat_ws(':', {', '.join(sums)})"
