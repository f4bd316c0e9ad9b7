"""Texts rearranged for fill-in-the-middle training: cut into prefix, middle and suffix at unit boundaries.

One ``fullmatch`` of ``(unit)*`` with the ``regex`` library keeps every repetition of its group, so ``ends(1)`` holds the number of units
and the offset behind each; both cuts are read from it by index. Offsets count code points.

Draws come from a hash of seed and id, so that a rerun of a lost task gives the same cuts. A null id draws as an empty one, a null text is an
empty one and stays plain, repeated rows give repeated rows, and columns other than ``doc_id`` and ``text`` are not read. A text of which
units cover only a part is a caller's error and raises: units have to tile any text, as lines do.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leadloom.llm.common import pieces

LINE = r"[^\n]*+\n|[^\n]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50


def draws(doc_id: str = "doc_id", seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: the first groups of eight digits of the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def cut(text: str, units: regex.Pattern, h1: int, h2: int) -> tuple[int, int, int]:
    """Number of units, and the offsets where prefix and middle end."""
    ends = units.fullmatch(text).ends(1)
    n = len(ends)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, ends[first - 1] if first else 0, ends[second - 1] if second else 0


def rearranged(text: str, units: regex.Pattern, h: tuple[int, int, int, int], rate: int, spm_rate: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    n, a, b = cut(text, units, h[0], h[1])
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = LINE, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row; ``rate`` and ``spm_rate`` are percentages."""
    key = docs.schema["doc_id"].dataType
    schema = f"doc_id {key.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    kinds = [to_arrow_type(key), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        units = regex.compile(f"({unit})*+")
        for batch in batches:
            for part in pieces(batch, "text"):
                draws = zip(*(part.column(i).to_pylist() for i in range(2, 6)))
                rows = [rearranged(t or "", units, h, rate, spm_rate) for t, h in zip(part.column("text").to_pylist(), draws)]
                made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:])]
                made[-1] = made[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(kinds[0]), *made], names=names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *draws(seed=seed)).mapInArrow(run, schema)


def restored(form: Column, output: Column) -> Column:
    """The text behind ``output``. The marks stand in it once each, since texts that hold one stay plain."""

    def joined(first: str, order: tuple[int, int, int]) -> Column:
        parts = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), f"{first}|{MIDDLE}", -1)
        return F.concat(*[F.element_at(parts, i) for i in order])

    return F.when(form == "psm", joined(SUFFIX, (1, 3, 2))).when(form == "spm", joined(PREFIX, (2, 3, 1))).otherwise(output)


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('{SEED}:', doc_id)) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, {", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM d),
k AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix,
        CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
             WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
              ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
