"""Fill-in-the-middle, periodic runs and licence scans against plain restatements, and on odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import fim, licenses, periodic, queries
from leadloom.llm.common import table
from tests.llm.test_edges import LONG, docs, size  # noqa: F401  fixtures
from tools.compare import rows_of

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of_table(name="documents"):
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/{name}.parquet' ORDER BY 1").fetchall()


# fill in the middle


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


ODD = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "<P>\n", "x <S> y\n", "<M>", "<\nP>\n<P", "<S\n>\n", "é\U0001f600\n\r\n z\x85\n", "<", "<<P", "a\x00b\n\x00"]


def test_fim_equals_a_plain_restatement(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a", "é", "\n", "<", "P", "S", "M", ">", " ", "中"]) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    rows = [(i * 7, t) for i, t in enumerate(texts)]
    out = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {r["doc_id"]: r for r in out.withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(i, t)
        assert r["back"] == (t or "")
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_fim_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.op11_fill_in_middle(spark, SF)
    want = con.execute(fim.ORACLE)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in want.description], want.fetchall())


def test_fim_rates_and_long_texts(spark):
    long = "line of text\n" * 300_000
    df = spark.createDataFrame([(1, long), (2, "x" * 3_000_000)], "doc_id long, text string")
    plain = fim.fill_in_middle(df, rate=0).collect()
    assert {(r["doc_id"], r["n"], r["form"]) for r in plain} == {(1, 300_000, "plain"), (2, 1, "plain")}
    spm = fim.fill_in_middle(df, spm_rate=100).withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    assert {r["form"] for r in spm} == {"spm"} and {r["doc_id"]: r["back"] for r in spm}[1] == long


def test_fim_on_odd_rows(docs, size):
    rows = fim.fill_in_middle(docs).collect()
    assert len(rows) == size
    by_id = {r["doc_id"]: (r["n"], r["form"]) for r in rows}
    if size:
        assert by_id[1] == by_id[2] == (0, "plain") and by_id[7][0] == 3 and by_id[None][0] == 1
        assert len([r for r in rows if r["doc_id"] == 5]) == 2


# periodic runs


def plain_runs(words):
    """Every lag, every maximal stretch; a stretch belongs to its smallest period."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            stretch = words[i : i + length]
            if length >= max(6, 4 * q) and not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def random_words(rng):
    letters = "ab" if rng.random() < 0.5 else "abcdefghijk"
    words = []
    for _ in range(rng.randint(0, 5)):
        words += rng.choices(letters, k=rng.randint(0, 30))
        words += rng.choices(letters, k=rng.randint(1, 70)) * rng.choice([1, 1, 2, 4, 5, 9])
        words += words[-rng.randint(1, 40) :][: rng.randint(0, 20)] if words else []
    return words


def test_runs_equal_those_of_all_lags():
    rng = random.Random(4)
    lists = [random_words(rng) for _ in range(250)] + [[], ["a"] * 5, ["a"] * 6, list("abab" * 2), list("aab" * 90), list("aabaab" * 16 + "c") * 5]
    lists.append((list("ab" * 20) + ["c"]) * 6)  # runs inside the period of a run
    found = 0
    for words in lists:
        codes = np.unique(words, return_inverse=True)[1].astype(np.int64) if words else np.zeros(0, np.int64)
        assert periodic.find_runs(codes) == plain_runs(words)
        found += len(plain_runs(words))
    assert found > 300
    many = periodic.texts_with_runs([" ".join(w).encode() for w in lists])  # all at once
    assert [r for _, r, _ in many] == [plain_runs(w) for w in lists]
    assert [t.decode() for _, _, t in many] == [plain_collapsed(w, plain_runs(w)) for w in lists]


@pytest.mark.parametrize("period", [8, 9, 15, 16, 17, 31, 32, 33, 100, 257, 1000])
def test_runs_at_the_bounds_of_scales(period):
    rng = random.Random(period)
    for length, expected in ((4 * period - 1, 0), (4 * period, 1), (5 * period + 3, 1)):
        for ahead in (0, 1, 50):
            root = [f"r{i}" if rng.random() < 0.5 else "same" for i in range(period)]
            words = [f"x{i}" for i in range(ahead)] + (root * 6)[:length] + [f"y{i}" for i in range(ahead)]
            (_, runs, _), = periodic.texts_with_runs([" ".join(words).encode()])
            long = [r for r in runs if r[2] == period]
            assert long == [(ahead, length, period)] * expected


def planted(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return [w.decode() for w in words]


def test_runs_query_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    rows, some = rows_of_table(), 0
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words = planted(doc_id, text)
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-np.longdouble(r[1]) / r[2], r[0], r[2]), default=(None, None, None))
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r["collapsed_sha256"] == sha(plain_collapsed(words, runs))
        some += bool(runs)
    assert some >= 5


def test_strongest_run_is_exact(spark):
    big = 2**30
    rows = [([(0, big + 1, big), (1, big, big - 1), (2, big, big - 1)],), ([],), ([(0, 8, 2), (3, 4, 1)],)]
    df = spark.createDataFrame(rows, "runs array<struct<start:long,length:long,period:long>>").select(periodic.strongest(F.col("runs")).alias("b"))
    assert [r["b"] and tuple(r["b"]) for r in df.collect()] == [(1, big, big - 1), None, (0, 8, 2)]


def test_runs_of_a_long_text_in_linear_steps(spark):
    words = ["w"] * 200_000 + [f"u{i % 30_011}" for i in range(200_000)] + list("ab" * 1000)
    rows = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert [tuple(r) for r in rows[0]["runs"]] == [(0, 200_000, 1), (200_000, 200_000, 30_011), (400_000, 2000, 2)]


def test_runs_on_odd_rows(docs, size):
    rows = periodic.periodic_runs(docs).collect()
    assert len(rows) == size
    by_id = {r["doc_id"]: r for r in rows}
    if size:
        assert by_id[1]["n_words"] == by_id[2]["n_words"] == 0 and by_id[1]["collapsed"] == "" and by_id[4]["runs"][0]["period"] == 977
        assert by_id[4]["collapsed"] == " ".join(LONG.split()[:977])
    assert periodic.with_planted_repeats(docs).count() == size


# licence scans


def scanned(text, **options):
    own = licenses.Scanner(options.get("notices", licenses.NOTICES), options.get("phrases", licenses.PHRASES), options.get("least", 3), options.get("gap", 6), options.get("cover", 0.75))
    return own.scan(licenses.words_of(text.encode()))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_places(words, phrases=licenses.PHRASES):
    return sorted((i, label) for label, phrase in phrases for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def test_automaton_gives_the_longest_stretch():
    rng = random.Random(5)
    for _ in range(60):
        lists = [[rng.randrange(4) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 4))]
        machine = licenses.Automaton()
        for t, words in enumerate(lists):
            machine.add(t, words)
        machine.close()
        text = [rng.randrange(5) for _ in range(60)]
        state = length = 0
        for i, word in enumerate(text):
            state, length = machine.read(state, length, word)
            held = lambda n: {(t, k) for t, w in enumerate(lists) for k in range(n, len(w) + 1) if w[k - n : k] == text[i + 1 - n : i + 1]}  # noqa: E731, B023
            want = max(n for n in range(i + 2) if n == 0 or held(n))
            assert length == want
            if want:
                assert set(machine.ends[state]) == held(want)


def plain_best(words, notice, least, gap):
    """Best share of a template covered by a chain, with every pair of anchors compared."""
    anchors = []
    for i in range(len(words)):
        for j in range(len(notice)):
            n = 0
            while i + n < len(words) and j + n < len(notice) and words[i + n] == notice[j + n]:
                n += 1
            if n >= least:
                anchors.append((i + n, i, j + n, n))
    anchors.sort()
    best = {}
    for end, start, place, n in anchors:
        best[end, start, place] = max([n] + [best[e, s, p] + n - over for e, s, p in best
                                             for over in [max(e - start, p - (place - n), 0)] if over < n and start + over - e <= gap and place - n + over - p <= gap])
    return max(best.values(), default=0) / len(notice)


def test_chains_cover_as_much_as_all_pairs_allow():
    rng = random.Random(6)
    notice = "a b c d e f g h a b i j k l m".split()
    same = 0
    for _ in range(300):
        words = [rng.choice([w, w, w, w, "z"]) for w in notice]
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randrange(len(words)), "y")
        words = ["x"] * rng.randint(0, 3) + words
        _, spans, best = scanned(" ".join(words), notices=(("n", " ".join(notice)),), phrases=(), least=2, gap=3, cover=0.5)
        want = plain_best(words, notice, 2, 3)
        assert best <= want + 1e-9  # anchors of the automaton are those that cannot be extended to the left
        same += abs(best - want) < 1e-9
        assert bool(spans) == (best >= 0.5)
    assert same >= 285


def test_notices_are_found_with_words_changed_and_left_alone_else():
    for label, text in licenses.NOTICES:
        _, spans, score = scanned(f"Some words ahead. {text} And words behind.")
        assert label in {s[0] for s in spans} and score == 1.0
        words = text.split()
        if len(words) >= 30:
            words[len(words) // 2] = "CHANGED"
            words.insert(len(words) // 4, "one more")
            _, spans, score = scanned(" ".join(["ahead"] * 5 + words))
            span = next(s for s in spans if s[0] == label)
            assert span[1] == 5 and 0.75 <= span[3] <= 1
    phrases, spans, score = scanned("you may use the software and the license of this copy in all of the files")
    assert not phrases and not spans and score < 0.75


def test_scan_query_equals_brute_force_for_phrases(spark):
    extra = [(-1, "CC-BY cc by CC\nBY all rights  reserved"), (-2, "General Public License general public general public LICENSE"), (-3, None), (-4, "all rights reservedé cc by"), (-5, "ccby cc_by _cc by_")]
    rows = rows_of_table() + extra
    df = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = {r["doc_id"]: r for r in df.collect()}
    for doc_id, text in rows:
        words = plain_words(text)
        r = got[doc_id]
        assert r["n_words"] == len(words) and sorted((p["start"], p["label"]) for p in r["phrases"]) == plain_places(words)
    by_query = {r["doc_id"]: r for r in queries.op13_license_scan(spark, SF).collect()}
    assert len(by_query) == len(rows) - len(extra)
    for doc_id, text in rows_of_table():
        places, r = plain_places(plain_words(text)), by_query[doc_id]
        assert r["n_base"] == len(places) and r["base_labels"] == ",".join(sorted({p[1] for p in places})) and 0 <= r["score"] <= 1
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        if "MIT License" in (text or "") or "Apache License" in (text or ""):
            assert {"mit", "apache-2.0"} & set(r["labels"].split(",")) and r["score"] == 1.0
        if not re.search("licen|reserved|copyright|cc by", text or "", re.I):
            assert r["labels"] == "" and r["score"] < 0.75


def test_scan_on_odd_rows(docs, size):
    rows = licenses.scan(docs).collect()
    assert len(rows) == size and all(r["score"] == 0 and r["spans"] == [] and r["phrases"] == [] for r in rows)
    assert not size or {r["doc_id"]: r["n_words"] for r in rows}[1] == 0


def test_scan_of_a_long_text_full_of_fragments(spark):
    text = "of the software and all rights reserved to the software in the software " * 20_000
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(r["phrases"]) == 20_000 and not r["spans"]


def test_queries_read_all_documents(spark):
    n = table(spark, SF, "documents").count()
    assert queries.op11_fill_in_middle(spark, SF).count() == queries.op12_periodic_runs(spark, SF).count() == n
