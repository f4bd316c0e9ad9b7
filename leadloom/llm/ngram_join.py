"""Documents whose sets of word shingles have a Jaccard similarity of at least 3/4, and the groups they form.

Equal sets are one class from the start. For different sets:

1. Shingles are counted in a table of cells of fixed size, so every shingle is in a frequent or a rare cell. Rare shingles come
   first in the order of all shingles.
2. A set of ``n`` shingles shares at least three quarters of them with a partner, so if it writes down its first ``p = n - ceil(3n/4) + 1`` shingles, a
   partner has one of them among its own first. Where these reach into frequent shingles, the prefix is extended, and frequent shingles, dealt into
   classes, are indexed by pairs of one class: a prefix of ``p + c`` shingles, ``c`` of its classes holding frequent ones, shares a rare
   shingle or two frequent ones of a class with that of each partner. The number of classes follows the size of the sets, in bands of a
   factor 4/3, so the pairs stay in proportion to the shingles. Small sets index single shingles only.
3. Sets under one index key are candidates: in short lists all pairs, in long ones each with its neighbours by size and the first. Pairs that share too few
   keys to be linked are left out. A set's candidate that shares most keys with it, and its smallest one, are verified first, by the whole sets;
   candidates that this leaves in different groups come next, with a few members of other groups from some of the long lists of each set, and last all
   pairs of members of long lists whose groups still differ. So copies do not meet in all pairs, and no link between groups is lost.

Words are runs of anything but blanks, in lower case for A-Z. A text with fewer than five words is one shingle; a null or blank text has none and is linked
with nothing, its component is its own id. Each row is judged by its own text, also where ids repeat. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leadloom.llm.common import RollingHash, mixed, pieces, string_bytes, written
from leadloom.llm.components import components, grouped, merged

SHINGLE = 5
CELLS, SLICES = 1 << 20, 16
SMALL = 64
CLASSES = 8
SHORT = 8
# Before the last round a set meets a few others in some long lists: about so many of small groups, and of the list's largest one.
LISTS, SHARE, MOST = 8, 3, 8
# Keys of frequent shingles are odd, those of rare ones even.
ODD = np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, offsets = string_bytes(column)
    data = LOWER[data]
    inside = ~BLANK[data]
    # a row's first byte begins a word even if the row before ended in one
    begins = inside & np.concatenate([[True], ~inside[:-1]]) if len(data) else inside
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    after = np.concatenate([np.flatnonzero(~inside), offsets[1:]])
    after.sort()
    ends = after[np.searchsorted(after, starts, "right")] if len(starts) else starts
    words = RollingHash(data).of(starts, ends)
    at = np.searchsorted(starts, offsets)
    with np.errstate(over="ignore"):
        if len(words) >= SHINGLE:
            total = np.zeros(len(words) - SHINGLE + 1, np.uint64)
            for i in range(SHINGLE):
                total = total * np.uint64(0x5851F42D4C957F2D) + words[i : i + len(total)]
            total = mixed(total)
        out = []
        for a, b in zip(at.tolist(), at[1:].tolist()):
            if b - a >= SHINGLE:
                out.append(np.unique(total[a : b - SHINGLE + 1]))
            elif b > a:
                one = np.uint64(b - a)
                for w in words[a:b]:
                    one = one * np.uint64(0x5851F42D4C957F2D) + w
                out.append(mixed(np.array([one], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_id(tokens: np.ndarray) -> int:
    """A number for a set; sets count as equal if it is."""
    with np.errstate(over="ignore"):
        return int((mixed(tokens).sum() ^ np.uint64(len(tokens))).astype(np.int64))


def measured(docs: DataFrame) -> DataFrame:
    """One pass over the texts: (doc_id, set, n) of each row, and each task's shingle counts by cell, in slices (slice, counts)."""

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(part.column(1))
                counts += np.bincount(np.concatenate([np.zeros(0, np.int64), *[(x >> np.uint64(44)).astype(np.int64) for x in sets]]), minlength=CELLS)
                rows = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                    names=["doc_id", "set", "n", "slice", "counts"],
                )
        if counts.any():
            blobs = [x.astype("<u4").tobytes() for x in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, ids), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int32()), pa.array(range(SLICES), pa.int32()), pa.array(blobs)], names=["doc_id", "set", "n", "slice", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = to_arrow_type(docs.schema["doc_id"].dataType)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, set long, n int, slice int, counts binary")


def frequent_cells(rows: DataFrame) -> np.ndarray:
    """Which cells hold far more shingles than the mean: a table of ``CELLS`` flags, whatever the corpus."""

    def summed(code):
        def run(key, group):
            import pandas as pd

            total = np.sum([np.frombuffer(blob, code) for blob in group["counts"]], axis=0, dtype=np.int64)
            return pd.DataFrame({"slice": [key[0]], "counts": [total.tobytes()]})

        return run

    counts, size = np.zeros(CELLS, np.int64), CELLS // SLICES
    # in two steps, so that no task sums the slices of all tasks
    parts = rows.filter("slice is not null").select("slice", "counts", F.pmod(F.hash("counts"), F.lit(16)).alias("part"))
    some = parts.groupBy("slice", "part").applyInPandas(summed("<u4"), "slice int, counts binary")
    for r in some.groupBy("slice").applyInPandas(summed("<i8"), "slice int, counts binary").collect():
        counts[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["counts"], np.int64)
    mean = counts.mean()
    return counts > mean + 6 * math.sqrt(mean) + 48


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Index keys of a set: its first rare shingles, and pairs of frequent ones."""
    n = len(tokens)
    p = n - -(-3 * n // 4) + 1
    often = frequent[(tokens >> np.uint64(44)).astype(np.int64)]
    rare, common = tokens[~often], tokens[often]
    keys = [rare[:p] & ~ODD]
    if len(rare) < p:
        if n <= SMALL:
            keys.append(mixed(common[: p - len(rare)] ^ np.uint64(0xA5A5A5A5)) | ODD)
        if 4 * n > 3 * SMALL:
            band = int(math.log(n) / math.log(4 / 3) + 1e-9)
            for b in (band, band + 1):
                keys.append(_pairs(common, p - len(rare), b) | ODD)
    return np.concatenate(keys)


def sized(tokens: np.ndarray, frequent: np.ndarray) -> int:
    """The set's size, above 32 bits that hold one more than the number of its frequent shingles if its prefix reaches into them, else 0."""
    often = int(frequent[(tokens >> np.uint64(44)).astype(np.int64)].sum())
    n = len(tokens)
    return n << 32 | (often + 1 if n - often < n - -(-3 * n // 4) + 1 else 0)


def _pairs(common: np.ndarray, need: int, band: int) -> np.ndarray:
    classes = max(CLASSES, int((4 / 3) ** band / 16))
    kind = (mixed(common) % np.uint64(classes)).astype(np.int64)
    # the first ``need`` and one more for each class among those taken
    new = np.zeros(len(kind), bool)
    _, first = np.unique(kind, return_index=True)
    new[first] = True
    enough = np.flatnonzero(np.arange(1, len(kind) + 1) >= need + np.cumsum(new))
    taken = int(enough[0]) + 1 if len(enough) else len(kind)
    common, kind = common[:taken], kind[:taken]
    order = np.argsort(kind, kind="stable")
    common, kind = common[order], kind[order]
    out, step = [np.zeros(0, np.uint64)], 1
    with np.errstate(over="ignore"):
        while step < len(common):
            same = kind[step:] == kind[:-step]
            if not same.any():
                break
            out.append(mixed(common[:-step][same] * np.uint64(0xD1342543DE82EF95) + common[step:][same] * np.uint64(3) + np.uint64(band)))
            step += 1
    return np.concatenate(out)


def indexed(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(key, size, set) of every document that has shingles; size as in ``sized``."""
    flags = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent))

    def run(batches):
        often = np.unpackbits(flags.value).astype(bool)
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [s for s in shingle_sets(part.column(0)) if len(s) > 2]  # smaller sets are linked with equal ones only
                keys = [signatures(s, often) for s in sets]
                if not sets:
                    continue
                sizes = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array([sized(s, often) for s in sets], np.int64), sizes)), pa.array(np.repeat(np.array([set_id(s) for s in sets], np.int64), sizes))],
                    names=["key", "size", "set"],
                )

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, size long, set long")


def listed(keys: DataFrame) -> DataFrame:
    """Of kind ``pair``: candidates (a, b), their sizes, the keys they were met under, and how many of those are of rare shingles. Of kind ``long``: a member b of the long list of key a, and its size.

    A key's sets arrive together, in order of size; only the last sets of a list are held, however long it is."""
    names = ["kind", "a", "b", "size_a", "size_b", "met", "keys"]

    def emit(kind, *columns):
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(columns[0]), pa.string()), *[pa.array(c.astype(np.int64)) for c in columns]], names=names)

    def run(batches):
        # of the list that reaches into the next batch: its last SHORT rows, its first set, its length so far
        tail = [np.zeros(0, np.int64)] * 3
        head, length = None, 0
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(3)]
            if not len(columns[0]):
                continue
            old = len(tail[0])
            key, size, sets = (np.concatenate([t, c]) for t, c in zip(tail, columns))
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (sets[1:] != sets[:-1])])
            fresh[:old] = True
            key, size, sets = key[fresh], size[fresh], sets[fresh]
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            run_of = np.repeat(np.arange(len(begins)), np.diff([*begins, len(key)]))
            first_set, first_size, place = sets[begins], size[begins], np.arange(len(key)) - begins[run_of]
            lengths = np.bincount(run_of)
            if old:
                first_set[0], first_size[0] = head
                place[run_of == 0] += length - old
                lengths[0] += length - old
            long = lengths[run_of] > SHORT
            new = np.arange(len(key)) >= old
            # rows of a list that turned out short so far are sent on when it turns out long
            out = long & (new | (length <= SHORT))
            found = []
            for step in range(1, SHORT):
                same = (key[step:] == key[:-step]) & new[step:]
                found.append(np.stack([sets[:-step][same], sets[step:][same], size[:-step][same], size[step:][same], 1 - (key[step:][same] & 1)]))
            far = new & (place >= SHORT)
            found.append(np.stack([first_set[run_of][far], sets[far], first_size[run_of][far], size[far], 1 - (key[far] & 1)]))
            a, b, size_a, size_b, rare = np.concatenate(found, axis=1)
            fits = (4 * (size_a >> 32) >= 3 * (size_b >> 32)) & (a != b)
            a, b, size_a, size_b, rare = (c[fits] for c in (a, b, size_a, size_b, rare))
            if len(a):
                turned = a > b
                a, b, size_a, size_b = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, size_b, size_a), np.where(turned, size_a, size_b)
                order = np.lexsort((b, a))
                a, b, size_a, size_b, rare = (c[order] for c in (a, b, size_a, size_b, rare))
                begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                yield emit("pair", *(c[begin] for c in (a, b, size_a, size_b)), np.diff([*begin, len(a)]), np.add.reduceat(rare, begin))
            if out.any():
                none = np.zeros(int(out.sum()))
                yield emit("long", key[out], sets[out], none, size[out], none, none)
            head, length = (first_set[-1], first_size[-1]), int(lengths[-1])
            keep = np.flatnonzero(run_of == run_of[-1])[-SHORT:]
            tail = [key[keep], size[keep], sets[keep]]

    ordered = keys.repartition("key").sortWithinPartitions("key", "size", "set")
    return ordered.mapInArrow(run, "kind string, a long, b long, size_a long, size_b long, met long, keys long")


def possible(keys, size_a: str, size_b: str, long_a: str, long_b: str):
    """Whether sets that share ``keys`` keys of rare shingles in short lists can be linked. In long lists they share at most as many as each has there.

    A prefix that reaches into frequent shingles holds all rare ones of its set: what two such sets share beside common keys is frequent. Else what
    they share beside common keys lies behind the end of a prefix of rare shingles."""
    n = lambda size: F.shiftright(F.col(size), 32)
    often = lambda size: F.col(size).bitwiseAND(F.lit((1 << 32) - 1)) - 1
    behind = lambda size: F.when(often(size) < 0, F.ceil(n(size) * 3 / 4) - 1)
    both = (often(size_a) >= 0) & (often(size_b) >= 0)
    beside = F.when(both, F.least(often(size_a), often(size_b))).otherwise(F.greatest(behind(size_a), behind(size_b)))
    in_long = F.least(F.coalesce(F.col(long_a), F.lit(0)), F.coalesce(F.col(long_b), F.lit(0)))
    return keys + in_long >= F.ceil((n(size_a) + n(size_b)) * 3 / 7 - 1e-9) - beside


def contents(docs: DataFrame, wanted: DataFrame, members: DataFrame) -> DataFrame:
    """(set, tokens) of the sets in ``wanted`` (set), each taken from one document that has it."""
    sources = members.join(wanted, "set", "left_semi").groupBy("set").agg(F.min("doc_id").alias("doc_id")).withColumnRenamed("set", "wanted")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(part.column(1))
                numbers = [set_id(s) if len(s) else None for s in sets]
                # an id may stand on several rows; without one, any set may be wanted
                keep = [i for i, n in enumerate(numbers) if n is not None and part.column(0)[i].as_py() in (n, None)]
                at = np.cumsum([0, *[len(sets[i]) for i in keep]])
                flat = np.concatenate([np.zeros(0, np.uint64), *[sets[i] for i in keep]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([numbers[i] for i in keep], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], names=["set", "tokens"])

    schema = "set long, tokens array<long>"
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    named = texts.join(sources, "doc_id").select("wanted", "text").mapInArrow(run, schema)
    # sets that stand on rows without an id only are found by their number
    nameless = texts.filter("doc_id is null").select(F.lit(None).cast("long").alias("wanted"), "text").mapInArrow(run, schema).dropDuplicates(["set"])
    return named.unionByName(nameless.join(sources.filter("doc_id is null").select(F.col("wanted").alias("set")), "set", "left_semi"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, and what else is known of them) that are linked, by their whole sets."""
    joined = pairs.join(sets.select(F.col("set").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("set").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    rows = joined.select(*pairs.columns, shared.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return rows.filter("100L * both >= 75L * (sum - both)").select(*pairs.columns).distinct()


def meetings(rows: DataFrame, some: bool = False, among: DataFrame | None = None) -> DataFrame:
    """Pairs of rows (key, set, size, long, g; columns end in _a and _b) under one key: all in which several groups g meet, or those that meet in one of many parts of a few lists of each set (``among`` the sets).

    These lists are the least of the set by ``LISTS`` hashes, so sets that have many lists in common are likely to choose the same. In a part a set meets
    about ``MOST`` members of the list's largest group, and ``SHARE`` of all others."""
    rows = rows.join(among.select("set").distinct(), "set", "left_semi") if among is not None else rows
    rows = rows.join(rows.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo != hi").select("key"), "key")
    part = F.lit(0).cast("long")
    if some:
        least = rows.groupBy("set").agg(*[F.min_by("key", F.xxhash64("key", F.lit(i))).alias(f"key{i}") for i in range(LISTS)])
        rows = rows.join(least.select("set", F.explode(F.array_distinct(F.array(*[f"key{i}" for i in range(LISTS)]))).alias("key")), ["set", "key"])
        counts = rows.groupBy("key", "g").agg(F.count("*").alias("n")).groupBy("key").agg(F.max("n").alias("most"), F.sum("n").alias("members"))
        rows = rows.join(counts, "key")
        part = F.pmod(F.xxhash64("set", "key"), F.greatest(F.lit(1), F.col("most") / MOST, (F.col("members") - F.col("most")) / SHARE).cast("long"))
    rows = rows.withColumn("part", part)
    left, right = (rows.select("key", "part", *[F.col(c).alias(f"{c}_{end}") for c in ("set", "size", "long", "g")]) for end in "ab")
    return left.join(right, ["key", "part"]).filter("set_a < set_b and g_a != g_b")


def linked_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    passed = written(measured(docs))
    members = passed.filter("slice is null").select("doc_id", "set", "n")
    found = written(listed(indexed(docs, frequent_cells(passed))))
    long = found.filter("kind = 'long'").select(F.col("a").alias("key"), F.col("b").alias("set"), F.col("size_b").alias("size"))
    in_long = long.filter("key % 2 = 0").groupBy("set").agg(F.count("*").alias("long"))
    pairs = found.filter("kind = 'pair'").groupBy("a", "b", "size_a", "size_b").agg(F.sum("met").alias("met"), F.sum("keys").alias("keys"))
    for end in ("a", "b"):
        pairs = pairs.join(in_long.select(F.col("set").alias(end), F.col("long").alias(f"long_{end}")), end, "left")
    candidates = written(pairs.filter(possible(F.col("keys"), "size_a", "size_b", "long_a", "long_b")).select("a", "b", "size_a", "size_b", "met"))

    # for each set the candidate that shares most with it, and the smallest: the first of a long list is the same for most of its members
    ends = candidates.select("a", "b", "met", F.explode(F.array(F.struct(F.col("a").alias("end"), F.col("size_b").alias("size"), F.col("b").alias("other")), F.struct(F.col("b").alias("end"), F.col("size_a").alias("size"), F.col("a").alias("other")))).alias("x"))
    best = ends.groupBy("x.end").agg(F.max(F.struct("met", "a", "b")).alias("most"), F.min(F.struct("x.size", "x.other", "a", "b")).alias("least"))
    best = written(best.select(F.explode(F.array(F.struct("most.a", "most.b"), F.struct("least.a", "least.b"))).alias("x")).select("x.*").distinct())
    contents_of = lambda pairs: written(contents(docs, pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct(), members))

    groups = components(verified(best, contents_of(best)))
    n_a, n_b = F.shiftright("size_a", 32), F.shiftright("size_b", 32)
    fits = (n_a * 4 >= n_b * 3) & (n_b * 4 >= n_a * 3)

    def across(groups, **which):
        """Pairs of members of one long list that are in different groups and can be linked."""
        met = meetings(grouped(long.join(in_long, "set", "left"), groups, "set", "g"), **which)
        return met.filter(fits & possible(F.lit(0), "size_a", "size_b", "long_a", "long_b")).select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), "g_a", "g_b").distinct()

    def after(groups, pairs, sets):
        """The groups once the linked ones among ``pairs`` (a, b, and their groups g_a, g_b) are joined."""
        return merged(groups, verified(pairs, sets).select(F.col("g_a").alias("a"), F.col("g_b").alias("b")))

    rest = grouped(grouped(candidates.select("a", "b"), groups, "a", "g_a"), groups, "b", "g_b").filter("g_a != g_b")
    rest = written(rest.unionByName(across(groups, some=True)).distinct().join(best, ["a", "b"], "left_anti"))
    at_hand = contents_of(rest)
    groups = after(groups, rest, at_hand)
    # what is still apart meets a few members of the group that has grown, as long as their contents are at hand
    tried = best.unionByName(rest.select("a", "b"))
    more = written(across(groups, some=True, among=at_hand).join(tried, ["a", "b"], "left_anti"))
    groups = after(groups, more, at_hand)
    last = written(across(groups).join(tried.unionByName(more.select("a", "b")), ["a", "b"], "left_anti"))
    groups = after(groups, last, contents_of(last))

    # the least document of a set, then of a group
    by_set = members.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("least"))
    by_set = by_set.join(groups.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = by_set.groupBy("component").agg(F.min("least").alias("component_id"))
    named = by_set.join(least, "component").select("set", "component_id")
    rows = members.join(named, "set", "left")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
