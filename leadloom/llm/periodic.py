"""Periodic runs of words: maximal stretches that repeat with a smallest period, and texts without the repetitions.

All texts of an Arrow piece become one array of word codes, with a code of its own behind each text, so that no run leaves its text.

- Periods up to ``DIRECT`` are found by comparing the array with itself at that lag.
- Longer ones are found at scales ``G = 2 * DIRECT, 4 * DIRECT, ...``, each for periods ``q`` in ``(G/2, G]``. Every run of
  ``FACTOR`` >= 4 periods holds two windows of ``G/2`` neighbouring ``G``-grams that lie ``q`` apart and are alike, so the least gram of
  the first (leftmost of equal ones) and the same gram ``q`` words on are both window minima. A ``G``-gram is at least a period long, and
  a smallest period has no equal rotations, so it stands nowhere between the two: neighbours among equal minima give the period.
- Each such pair is extended word by word in both directions. Grams are compared by 64-bit hashes and only suggest a pair; runs are decided by
  the words themselves. A stretch with a smaller period too is that period's run, not this one's.

Words are stretches of bytes other than ASCII white space. A null text has none. Rows are judged one by one, whatever their id, so ids may be
null or repeat; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leadloom.llm.common import mixed, pieces
from leadloom.llm.fingerprint import bound

DIRECT, FACTOR, LEAST = 8, 4, 6
WORD = r"([^\x20\x09-\x0D]+)"


def least_length(period: int) -> int:
    return max(LEAST, FACTOR * period)


def stretches_of_lag(codes: np.ndarray, lag: int) -> np.ndarray:
    """(start, length) rows of all maximal stretches with period ``lag`` that are long enough."""
    same = codes[:-lag] == codes[lag:]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    enough = ends - starts + lag >= least_length(lag)
    return np.stack([starts[enough], ends[enough] - starts[enough] + lag], axis=1)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least value, leftmost of equal ones, in any window of ``width`` (a power of two) neighbours."""
    best = np.arange(len(values) - width + 1)
    at, size = np.arange(len(values)), 1
    while size < width:  # the best of a window of 2 * size is the better one of its halves
        left, right = at[:-size], at[size:]
        at = np.where(values[right] < values[left], right, left)
        size *= 2
    return np.unique(at[: len(best)])


def pairs_of_scale(grams: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of neighbouring equal minima whose distance belongs to the scale."""
    if len(grams) <= scale // 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    minima = window_minima(grams, scale // 2)
    order = np.argsort(grams[minima], kind="stable")
    spots, values = minima[order], grams[minima[order]]
    gap = spots[1:] - spots[:-1]
    pair = (values[1:] == values[:-1]) & (gap > scale // 2) & (gap <= scale)
    return spots[:-1][pair], gap[pair]


def extended(codes: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """Start and length of the maximal stretch of period ``lag`` around position ``at``, read in steps that double."""
    end, step = at, 64
    while end + lag < len(codes):
        to = min(end + step, len(codes) - lag)
        differ = codes[end:to] != codes[end + lag : to + lag]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = to, step * 2
    start, step = at, 64
    while start > 0:
        to = max(start - step, 0)
        differ = codes[to:start] != codes[to + lag : start + lag]
        if differ.any():
            start -= int(differ[::-1].argmax())
            break
        start, step = to, step * 2
    return start, end - start + lag


def has_period(codes: np.ndarray, start: int, length: int, period: int) -> bool:
    return bool((codes[start : start + length - period] == codes[start + period : start + length]).all())


def smallest(codes: np.ndarray, start: int, length: int, period: int) -> bool:
    """Whether no smaller period holds. With ``FACTOR`` periods a smaller one would have to divide this one, and hence ``period / p`` for a prime."""
    rest, factor = period, 2
    while factor * factor <= rest:
        if rest % factor == 0:
            if has_period(codes, start, length, period // factor):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return rest == 1 or not has_period(codes, start, length, period // rest)


def find_runs(codes: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) in order, of a text or of several with breaks; ``longest`` is the length of the longest text."""
    longest = len(codes) if longest is None else longest
    found = set()
    for lag in range(1, min(DIRECT, longest // FACTOR) + 1):
        found.update((s, n, lag) for s, n in stretches_of_lag(codes, lag).tolist() if smallest(codes, s, n, lag))
    grams, scale = mixed(codes.astype(np.uint64) + np.uint64(1)), 1
    while scale * FACTOR < longest:
        with np.errstate(over="ignore"):  # grams of twice the length from two that abut
            grams = mixed(grams[:-scale] * np.uint64(0x9E3779B97F4A7C15) + grams[scale:])
        scale *= 2
        if scale <= DIRECT:
            continue
        spots, lags = pairs_of_scale(grams, scale)
        reached = {}  # lag -> end of the last stretch looked at
        for at, lag in sorted(zip(spots.tolist(), lags.tolist())):
            if at < reached.get(lag, 0):
                continue
            start, length = extended(codes, at, lag)
            reached[lag] = start + length - lag
            if length >= least_length(lag) and smallest(codes, start, length, lag):
                found.add((start, length, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts_with_runs(texts: list[bytes]) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, text without repetitions) of each text."""
    words = [t.split() for t in texts]
    seen, ids, at = {}, count(), [0]
    codes = []
    for own in words:
        codes.append(np.fromiter(map(seen.setdefault, own, ids), np.int64, len(own)))
        codes.append(np.array([next(ids)], np.int64))  # ids are given once, so this one equals nothing
        at.append(at[-1] + len(own) + 1)
    runs = [[] for _ in texts]
    if words:
        for start, length, period in find_runs(np.concatenate(codes), max(map(len, words))):
            row = int(np.searchsorted(at, start, "right")) - 1
            runs[row].append((start - at[row], length, period))
    return [(len(w), r, collapsed(w, r)) for w, r in zip(words, runs)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds behind its first period, one space between them."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, n in zip(words, np.cumsum(gone).tolist()) if not n]
    return b" ".join(words)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row; runs in order of start, then period, starts in words from 0."""
    key = docs.schema["doc_id"].dataType
    schema = f"doc_id {key.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    run_kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
    kind = to_arrow_type(key)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                column = part.column("text").fill_null("").cast(pa.large_binary())
                n, runs, texts = zip(*texts_with_runs(column.to_pylist()))
                runs = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
                made = [pa.array(n, pa.int64()), pa.array(runs, run_kind), pa.array([t.decode() for t in texts], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(kind), *made], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared without rounding; the first in order of equal ones, null without runs."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    first = F.get(runs, F.lit(0))
    return F.aggregate(runs, first, lambda best, x: F.when(better(best, x), x).otherwise(best))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the ids, by their CRC-32, have a text whose words repeat from some place on. A null id is left as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeated(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        spot = lambda i, a, p: F.when(i < a, i).otherwise(a + (i - a) % p)
        spots = bound(F.struct(a.alias("a"), p.alias("p")), lambda s: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: spot(i, s["a"], s["p"])))
        return F.when(n > 0, F.array_join(F.transform(spots, lambda i: F.get(words, i.cast("int"))), " ")).otherwise("")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    edited = bound(F.regexp_extract_all(text, F.lit(WORD)), repeated)
    return docs.select("doc_id", F.when(h % 10 == 0, edited).otherwise(text).alias("text"))
