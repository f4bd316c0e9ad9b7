"""Byte-level BPE: texts to ids and back, split where no merge can reach across.

A pair of neighbouring bytes that is found inside no vocabulary entry can never end up within one token, so the text is
cut there for certain, and the fragments are encoded independently (and only once each, while they stay in a bounded
cache), then concatenated. The pre-tokenizer's own boundaries and special tokens are cuts as well.

Null and empty texts give no ids. Every row is encoded by itself and yields one row, so repeated rows, ties and extra columns play
no part: only the id and text columns are read. Very long fragments are merged with a heap, in n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import built, released

# Fixed value: the split of words, numbers, signs and white space that the byte-level vocabulary was made with.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
CACHED = 1 << 20
# A merge is one number: its rank above the id it makes.
IDS, NEVER = (1 << 24) - 1, 1 << 62


def byte_alphabet() -> dict[str, int]:
    """Printable Latin-1 characters stand for their own byte; the other bytes take the characters from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """What encoding and decoding need of a tokenizer file: of fixed size, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or before["type"] != "ByteLevel" or spec["normalizer"] or not before.get("use_regex", True) or before["add_prefix_space"]:
        raise ValueError("only byte-level BPE without a normaliser and a prefix space is read")
    letters = byte_alphabet()
    ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in letters for c in token)}
    merges = [tuple(bytes(letters[c] for c in part) for part in (m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {"ids": ids, "merges": merges, "special": special}


class Codec:
    """One per Python worker."""

    def __init__(self, tables: dict):
        ids = tables["ids"]
        self.single = [ids.get(bytes([b]), -1) for b in range(256)]
        self.ranks = {}
        for rank, (a, b) in enumerate(tables["merges"]):
            self.ranks.setdefault((ids[a], ids[b]), rank << 24 | ids[a + b])
        self.special = tables["special"]
        self.bytes_of = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        joined = np.zeros(1 << 16, bool)
        for token, i in ids.items():
            self.bytes_of[i] = token
            joined[[a << 8 | b for a, b in zip(token, token[1:])]] = True
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.joined = joined
        self.split = regex.compile(SPLIT)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def fragments(self, word: bytes) -> list[bytes]:
        """``word`` cut at every pair of bytes that no vocabulary entry holds."""
        if len(word) < 2:
            return [word]
        if len(word) < 64:
            joined, cuts = self.joined, [0]
            for i in range(len(word) - 1):
                if not joined[word[i] << 8 | word[i + 1]]:
                    cuts.append(i + 1)
        else:
            data = np.frombuffer(word, np.uint8).astype(np.uint16)
            cuts = [0, *(np.flatnonzero(~self.joined[data[:-1] << 8 | data[1:]]) + 1).tolist()]
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)])]

    def merge(self, fragment: bytes) -> list[int]:
        parts = [self.single[b] for b in fragment]
        if len(parts) > 48:
            return self._merge_long(parts)
        get = self.ranks.get
        hits = [get(pair, NEVER) for pair in zip(parts, parts[1:])]
        while hits and (best := min(hits)) != NEVER:
            i = hits.index(best)
            parts[i] = best & IDS
            del parts[i + 1], hits[i]
            if i:
                hits[i - 1] = get((parts[i - 1], parts[i]), NEVER)
            if i < len(hits):
                hits[i] = get((parts[i], parts[i + 1]), NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(hit, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (hit := self.ranks.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            hit, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], alive[j] = hit & IDS, False
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (hit := self.ranks.get((parts[x], parts[y]))):
                    heapq.heappush(heap, (hit, x, parts[x], parts[y]))
        return [p for p, kept in zip(parts, alive) if kept]

    def word(self, word: str) -> bytes:
        ids = array("i", chain.from_iterable(map(self.merge, self.fragments(word.encode())))).tobytes()
        if len(word) <= 64:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """The ids, four bytes each in this machine's order."""
        out: list[bytes] = []
        for part in self.marks.split(text) if self.marks and any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
                continue
            words = self.split.findall(part)
            known = list(map(self.cache.get, words))
            if None in known:
                cache, own = self.cache, self.word
                known = [cache.get(w) or own(w) if k is None else k for w, k in zip(words, known)]
            out += known
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[int, tuple[dict, Codec]] = {}


def codec(tables: Broadcast) -> Codec:
    return built(_codecs, tables.value, Codec)


def tokenizer(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(load(path))


def encode(docs: DataFrame, tables: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>), one row per row of ``docs``."""

    def run(batches):
        own = codec(tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [own.packed(t) if t else b"" for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tables: Broadcast, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, text) from (id, ids); null ids give an empty text."""

    def run(batches):
        own = codec(tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1)
                ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()]).tolist()
                ids = lists.flatten().to_numpy().tolist()
                texts = [own.decode(ids[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], names=[id_col, "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(released(run), f"{id_col} {kind}, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids (little-endian, 32 bits each) and of the decoded text."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            values, at = np.asarray(lists.flatten(), dtype="<u4"), np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
            ids = [hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(ids), batch.column(2)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = decoded.select("doc_id", "ids", F.sha2(F.col("text"), 256).alias("decoded_sha256"))
    kind = decoded.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
