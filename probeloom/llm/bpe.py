"""Byte-pair encoding and decoding with a public word-level vocabulary.

A short word is held as two parallel lists: the boundaries of its parts (with
the part that starts there) and the ranks of adjacent parts. The least rank is
scanned for, its boundary deleted, and the two neighbouring ranks refreshed,
until no adjacent pair can merge. Long words use a heap over the same pairs.

Words repeat, so a worker remembers the ids of recent ones.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.llm.common import table

NONE = 1 << 30
SHORT = 128
# Words of one generation; the last two generations are remembered.
REMEMBERED = 500_000
# Characters that Python treats in another way than the tokenizers library: four
# controls that count as white space, and a letter whose lower case depends on its place.
UNLIKE = "\x1c\x1d\x1e\x1f\u03a3"


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            described = json.load(source)
        model, library = described["model"], Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.pieces = library.pre_tokenizer.pre_tokenize_str
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = self.vocabulary
        # (left id, right id) -> (rank, id of both together)
        self.merges = {(ids[a], ids[b]): (i, ids[a + b]) for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.tokens = {i: t for t, i in [*ids.items(), *self.special.items()]}
        steps = described["normalizer"]["normalizers"]
        splitter = described["pre_tokenizer"]["pretokenizers"][0]
        # The usual description is carried out on whole texts; any other by the library.
        usual = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and splitter["invert"]
        pattern = splitter["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall if usual else None
        # Within ASCII the faster standard module finds the same pieces.
        self.find_ascii = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), re.ASCII).findall
        self.characters = byte_characters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def symbols(self, word: str) -> list[int]:
        """Ids of the single characters; characters outside the vocabulary are left out."""
        characters = [*word[:-1], word[-1] + self.suffix]
        return [i for i in map(self.vocabulary.get, characters) if i is not None]

    def short(self, parts: list[int]) -> list[int]:
        """Merges by the contiguous rank array. ``parts[i]`` starts at boundary i."""
        merges = self.merges
        ranks = [merges.get(p, (NONE,))[0] for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = merges[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merges.get((parts[i], parts[i + 1]), (NONE,))[0]
            if i:
                ranks[i - 1] = merges.get((parts[i - 1], parts[i]), (NONE,))[0]
        return parts

    def long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order from a heap, for words of any length."""
        n, merges = len(parts), self.merges
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(merges[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = merges[a, b][1], False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (found := merges.get((parts[x], parts[y]))):
                    heapq.heappush(heap, (found[0], x, parts[x], parts[y]))
        return [p for p, a in zip(parts, alive) if a]

    def word(self, piece: str) -> list[int]:
        parts = self.symbols(piece)
        return self.short(parts) if len(parts) <= SHORT else self.long(parts)

    def words(self, text: str) -> list[str]:
        """The normalised text cut into the pieces in which merges happen."""
        if text.isascii():
            return self.find_ascii(text.lower())
        return self.find(unicodedata.normalize("NFC", text).lower())

    def miss(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            piece = "".join(map(self.characters.__getitem__, word.encode()))
            found = np.array(self.word(piece), np.int32).tobytes()
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        self.known[word] = found
        return found

    def plain(self, text: str) -> list[bytes]:
        if self.find is None or any(c in text for c in UNLIKE):
            return [np.array(self.word(p), np.int32).tobytes() for p, _ in self.pieces(self.normalise(text))]
        words = self.words(text)
        out = list(map(self.known.get, words))
        if None in out:
            miss = self.miss
            out = [miss(w) if found is None else found for w, found in zip(words, out)]
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; the strings of special tokens become those tokens."""
        if not any(s in text for s in self.special):
            return np.frombuffer(b"".join(self.plain(text)), np.int32)
        out, rest = [], text
        while rest:
            at, name = min(((rest.find(s), s) for s in self.special if s in rest), default=(len(rest), ""))
            out += self.plain(rest[:at])
            if name:
                out.append(np.array([self.special[name]], np.int32).tobytes())
            rest = rest[at + len(name):]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces, as for a tokenizer without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One instance per worker process, kept between tasks."""
    if path not in LOADED:
        LOADED[path] = Bpe(path)
    return LOADED[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded for every document.

    A null or empty text has no ids and decodes to the empty text. Repeated rows
    are encoded each, other columns ignored; an empty table gives no rows.
    """

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                ids = [bpe.encode(t or "") for t in batch.column(1).slice(low, 128).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, 128),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                    pa.array([bpe.decode(x.tolist()) for x in ids], pa.string()),
                ], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
