"""Byte strings of a given length that occur again, found with suffix arrays over the neighbourhoods where they can.

Every window of ``least`` bytes is filed under the smallest hash of its ``GRAM``-byte substrings. Neighbouring windows with the same smallest hash make a piece;
equal windows are always filed under the same hash, so each hash can be worked on by itself:

* A piece that is equal to an earlier one, byte for byte, is a repeat as a whole. This settles the inside of long repeats by aggregation.
* Of the pieces that differ but share their hash, those of all windows' starts are sorted into a suffix array with common prefix lengths. One scan with a
  stack visits the tree of common-prefix intervals; an interval of at least ``least`` bytes whose occurrences are preceded by different
  bytes is a maximal repeat. Each occurrence is put out once, under the longest maximal repeat in which it is not the earliest,
  together with the repeat's length, its number of occurrences and its earliest one. Only the first
  of equal pieces is in the array, so occurrences counts different pieces, and a repeat that spans several pieces comes out in parts.
* Hashes with more than ``SPLIT`` windows in different pieces are not sorted in one task: their windows are grouped by content in Spark.

Windows are 64-bit hashes when they are compared across tasks. The order of strings is (doc_id, start); a null id comes first. Rows with the same id are
compared like any others, but strings at the same start of the same id count as one. Null texts are empty. Texts shorter than ``least`` lose nothing.
Extra columns are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import RollingHash, mixed, pieces, string_bytes, written

LEAST, GRAM = 100, 36
# windows under one hash, and in one suffix array, at most
SPLIT, BLOCK = 250_000, 60_000
NULL_ID = -(2**63)


def minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        hashes, size = np.minimum(hashes[:-size], hashes[size:]), size * 2
    return np.minimum(hashes[: len(hashes) - (width - size)], hashes[width - size :]) if size < width else hashes


def cut(column: pa.Array, least: int) -> tuple[np.ndarray, ...]:
    """(row, start, n, place, piece, twice): runs of ``n`` windows with one place, their start within the row, the hash of their bytes, and
    whether the place's substring stands more than once in them, without which no two of the windows are equal."""
    data, offsets = string_bytes(column)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if len(data) < least:
        return none
    gram = min(GRAM, least)
    width = least - gram + 1
    rolling = RollingHash(data)
    grams = rolling.windows(gram)
    place = minima(grams, width)
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(grams == ~minima(~np.concatenate([edge, place, edge]), width))
    lengths = np.diff(offsets)
    rows = np.flatnonzero(lengths >= least)
    if not len(rows):
        return none
    counts = lengths[rows] - least + 1
    at = np.arange(counts.sum()) + np.repeat(offsets[rows] - (np.cumsum(counts) - counts), counts)
    row = np.repeat(rows, counts)
    place = place[at]
    begins = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    n = np.diff([*begins, len(at)])
    start = at[begins]
    with np.errstate(over="ignore"):
        piece = mixed(rolling.of(start, start + n + least - 1) + n.astype(np.uint64))
    lo, hi = np.searchsorted(chosen, start), np.searchsorted(chosen, start + n + width - 1)
    sizes = hi - lo
    near = np.arange(sizes.sum()) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)
    own = np.repeat(np.arange(len(start)), sizes)
    twice = np.bincount(own[grams[chosen[near]] == place[begins][own]], minlength=len(start)) > 1
    return row[begins], start - offsets[row[begins]], n, place[begins], piece, twice


def pieces_of(docs: DataFrame, least: int) -> DataFrame:
    """(place, piece, doc_id, at) of every piece; ``at`` holds its start, then n in 31 bits, then twice, so that it is in order of start."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                row, start, n, place, piece, twice = cut(part.column(1), least)
                at = start << 32 | n << 1 | twice
                yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), pa.array(piece.view(np.int64)), part.column(0).take(pa.array(row)), pa.array(at)], names=["place", "piece", "doc_id", "at"])

    return docs.mapInArrow(run, "place long, piece long, doc_id long, at long")


def start_of(at: Column) -> Column:
    return F.shiftright(at, 32)


def windows_of(at: Column) -> Column:
    return F.shiftright(at.bitwiseAND(F.lit((1 << 32) - 1)), 1)


def cut_out(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``wanted`` (doc_id, start, n, place, piece, split) with the bytes of each piece; an id may stand on several rows, so the hash decides."""
    spans = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "place", "piece", "split")).alias("spans"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                out = []
                for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns)):
                    text = text.encode()
                    rolling = RollingHash(np.frombuffer(text, np.uint8))
                    spans = [s for s in spans if s["start"] + s["n"] + least - 1 <= len(text)]
                    start, n = (np.array([s[c] for s in spans], np.int64) for c in ("start", "n"))
                    with np.errstate(over="ignore"):
                        held = mixed(rolling.of(start, start + n + least - 1) + n.astype(np.uint64)).view(np.int64).tolist()
                    out += [(s["place"], s["split"], doc_id, s["start"], text[s["start"] : s["start"] + s["n"] + least - 1]) for s, h in zip(spans, held) if h == s["piece"]]
                if out:
                    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["place", "split", "doc_id", "start", "bytes"])

    return docs.join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(run, "place long, split boolean, doc_id long, start long, bytes binary").dropDuplicates(["place", "doc_id", "start", "bytes"])


def suffix_array(strings: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all starts whose next ``least`` bytes stand more than once, in the order of what follows (up to ``2 * least`` bytes): string, offset, and bytes shared with the one before."""
    depth = 2 * least
    if not any(len(s) >= least for s in strings):
        return (np.zeros(0, np.int64),) * 3
    which = np.repeat(np.arange(len(strings)), [max(0, len(s) - least + 1) for s in strings])
    offset = np.concatenate([np.zeros(0, np.int64), *[np.arange(max(0, len(s) - least + 1)) for s in strings]])
    # a start whose first ``least`` bytes stand nowhere else is in no interval; equal bytes have equal hashes
    begins = np.cumsum([0, *map(len, strings)])[:-1]
    hashes = RollingHash(np.frombuffer(b"".join(strings), np.uint8)).windows(least)[begins[which] + offset]
    _, kind, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    which, offset = which[counts[kind] > 1], offset[counts[kind] > 1]
    suffixes = [strings[i][o : o + depth] for i, o in zip(which.tolist(), offset.tolist())]
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    shared = np.zeros(len(order), np.int64)
    for a in range(0, len(order), 8192):
        some = [suffixes[i] for i in order[max(0, a - 1) : a + 8192]]
        sizes = np.array([len(s) for s in some])
        table = np.frombuffer(b"".join(s.ljust(depth, b"\0") for s in some), np.uint8).reshape(len(some), depth)
        differ = table[1:] != table[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
        shared[max(1, a) : a + 8192] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    order = np.array(order, np.int64)
    return which[order], offset[order], shared


def maximal_repeats(strings: list[bytes], rank: list, least: int) -> list[tuple[int, int, int, int, int, int]]:
    """(string, offset, length, occurrences, first string, first offset) of each start, under the longest maximal repeat in which it isn't the earliest. ``rank`` orders the strings."""
    which, offset, shared = suffix_array(strings, least)
    which, offset, shared = which.tolist(), offset.tolist(), [*shared.tolist(), 0]
    depth, out = 2 * least, []
    # an open interval: shared length, number of starts, the earliest (rank, offset, string), byte before all (-1: they differ), and
    # starts that are not the earliest of it and not put out yet
    stack: list[list] = []
    for i in range(len(which)):
        s, o = which[i], offset[i]
        node = [len(strings[s]) - o, 1, (rank[s], o, s), strings[s][o - 1] if o else -1, []]
        bound = shared[i + 1]
        # close what the next start does not share, from the inside out
        while True:
            above = stack[-1][0] if stack else 0
            if above > bound:
                top = stack.pop()
                node = _join(top, node, top[0])
                _close(node, least, depth, out)
                continue
            if bound >= least:
                if stack and above == bound:
                    stack[-1] = _join(stack[-1], node, bound)
                else:
                    stack.append([bound, node[1], node[2], node[3], []])
            break
    return out


def _join(a: list, b: list, shared: int) -> list:
    early, late = (a, b) if a[2] <= b[2] else (b, a)
    pending, fewer = (a[4], b[4]) if len(a[4]) >= len(b[4]) else (b[4], a[4])
    pending.extend(fewer)
    pending.append(late[2])
    return [shared, a[1] + b[1], early[2], a[3] if a[3] == b[3] else -1, pending]


def _close(node: list, least: int, depth: int, out: list) -> None:
    """Puts out an interval that can't be extended to the left; one that can is part of the one that begins a byte before."""
    shared, count, first, before, pending = node
    if shared >= least and (before < 0 or shared >= depth):
        out.extend((s, o, shared, count, first[2], first[1]) for _, o, s in pending)
    node[4] = []


REPEATS = "doc_id long, start long, length long, occurrences long, first_doc long, first_start long"


def sorted_repeats(strings: DataFrame, least: int) -> DataFrame:
    """Maximal repeats of (place, doc_id, start, bytes), where no place has more than ``SPLIT`` windows: several places share a suffix array, as they share no window."""

    def found(rows):
        if len(rows) < 2:
            return None
        repeats = maximal_repeats([r[3] for r in rows], [(r[1], r[2]) for r in rows], least)
        # the earliest of two starts is by document and then by the start within it
        out = [(rows[s][1], rows[s][2] + o, n, k, rows[f][1], rows[f][2] + p) for s, o, n, k, f, p in repeats]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "length", "occurrences", "first_doc", "first_start"]) if out else None

    def run(batches):
        held, windows = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if windows >= BLOCK and held[-1][0] != row[0]:
                    if (out := found(held)) is not None:
                        yield out
                    held, windows = [], 0
                held.append(row)
                windows += len(row[3]) - least + 1
        if (out := found(held)) is not None:
            yield out

    ordered = strings.select("place", "doc_id", "start", "bytes").repartition("place").sortWithinPartitions("place")
    return ordered.mapInArrow(run, REPEATS)


def counted_repeats(strings: DataFrame, least: int) -> DataFrame:
    """The same for places with any number of rows: windows of ``least`` bytes that occur earlier."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, starts, contents = (c.to_pylist() for c in batch.slice(at, 256).columns)
                hashes = [RollingHash(np.frombuffer(c, np.uint8)).windows(least).view(np.int64) for c in contents]
                sizes = [len(h) for h in hashes]
                place = np.concatenate([s + np.arange(n) for s, n in zip(starts, sizes)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(place)], names=["window", "doc_id", "start"])

    windows = strings.select("doc_id", "start", "bytes").mapInArrow(run, "window long, doc_id long, start long")
    firsts = windows.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("occurrences")).filter("occurrences > 1")
    rows = windows.join(firsts, "window").filter("first.doc_id != doc_id or first.start != start")
    return rows.select("doc_id", "start", F.lit(least).cast("long").alias("length"), "occurrences", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def repeats(docs: DataFrame, least: int = LEAST, split: int = SPLIT) -> DataFrame:
    """(doc_id, start, length, occurrences, first_doc, first_start): every string of at least ``least`` bytes that occurs earlier, and where."""
    texts = _keyed(docs)
    found = pieces_of(texts, least)
    twice = F.max(F.col("at").bitwiseAND(F.lit(1)))
    shared = found.groupBy("place").agg(F.count("*").alias("rows"), twice.alias("twice")).filter("rows > 1 or twice = 1").select("place")
    found = written(found.join(shared, "place", "left_semi"))
    kinds = written(found.groupBy("place", "piece").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("occurrences")))
    copies = found.join(kinds.filter("occurrences > 1"), ["place", "piece"]).filter("first.doc_id != doc_id or first.at != at")
    length = (windows_of(F.col("at")) + (least - 1)).alias("length")
    copies = copies.select("doc_id", start_of(F.col("at")).alias("start"), length, "occurrences", F.col("first.doc_id").alias("first_doc"), start_of(F.col("first.at")).alias("first_start"))
    firsts = kinds.select("place", "piece", "first.doc_id", "first.at")
    varied = firsts.groupBy("place").agg(F.count("*").alias("kinds"), twice.alias("twice"), F.sum(windows_of(F.col("at"))).alias("windows")).filter("kinds > 1 or twice = 1")
    varied = varied.select("place", (F.col("windows") > split).alias("split"))
    wanted = firsts.join(varied, "place").select("doc_id", start_of(F.col("at")).alias("start"), windows_of(F.col("at")).alias("n"), "place", "piece", "split")
    strings = written(cut_out(texts, wanted, least))
    return copies.unionByName(sorted_repeats(strings.filter("not split"), least)).unionByName(counted_repeats(strings.filter("split"), least))


def without_repeats(docs: DataFrame, least: int = LEAST, split: int = SPLIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): each text without the bytes of strings that occur earlier; one row per row of ``docs``."""
    texts = _keyed(docs)
    spans = repeats(docs, least, split)
    # written, so that the shuffles of the search are gone when the texts are shuffled
    spans = written(spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("spans")))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, out = part.column(0).to_pylist(), []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2)):
                    data = text.encode()
                    change = np.zeros(len(data) + 1, np.int64)
                    if spans.is_valid:
                        start, length = (c.to_numpy() for c in spans.values.flatten())
                        inside = start + length <= len(data)
                        np.add.at(change, start[inside], 1)
                        np.add.at(change, (start + length)[inside], -1)
                    gone = np.cumsum(change[:-1]) > 0
                    n = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    out.append((len(data), len(data) - len(kept), n, kept))
                columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([pa.array([None if i == NULL_ID else i for i in ids], pa.int64()), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

