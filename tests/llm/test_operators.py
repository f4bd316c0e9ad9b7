"""The operators against plain restatements on random rows, and their queries against SQL."""

import math
import random
from collections import Counter
from types import SimpleNamespace

import duckdb
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from leadloom.domain import BASE_TABLES
from leadloom.llm import bpe, common, components, decontaminate, fingerprint, langid, lines, ngram_join, quality, queries, rollup, suffix_dedup, warc
from leadloom.llm.common import built, shared_folder, table, written
from tests.llm import brute
from tools.compare import rows_of

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load(queries.TOKENIZER))


def texts(con, name="documents", key="doc_id", column="text"):
    return con.execute(f"SELECT {key}, {column} FROM {name} ORDER BY 1").fetchall()


def test_all_are_registered():
    names = set(entry.queries())
    assert {*queries.QUERIES, "pipeline"} <= names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_byte_strings(spark):
    rng = random.Random(1)
    for least, letters, split in ((12, "ab", 20), (12, "abcd", 40_000), (40, "ab", 40_000)):
        passages = ["".join(rng.choice(letters) for _ in range(least + 15)) for _ in range(4)]
        docs = []
        for i in range(60):
            body = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(0, 60))), rng.choice(passages), "a" * rng.choice([0, 0, least + 3])]
            rng.shuffle(body)
            docs.append((i * 3, rng.choice([None, "", "".join(body), "".join(body)])))
        docs += [(1000, docs[5][1]), (1001, docs[5][1])]
        got = suffix_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), least, split).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == brute.removed(sorted(docs), least)


def test_byte_strings_name_their_earliest(spark, con):
    docs = {d: (t or "").encode() for d, t in texts(con)}
    for r in suffix_dedup.repeats(table(spark, SF, "documents")).collect():
        a, b = docs[r["doc_id"]][r["start"] :][: r["length"]], docs[r["first_doc"]][r["first_start"] :][: r["length"]]
        assert a == b and len(a) == r["length"] >= 100 and (r["first_doc"], r["first_start"]) < (r["doc_id"], r["start"]) and r["occurrences"] > 1


def test_tree_of_intervals_puts_out_maximal_repeats_only():
    strings = [b"xxabcdefghyy", b"zzabcdefghqq", b"abcdefgh"]
    got = suffix_dedup.maximal_repeats(strings, [0, 1, 2], 4)
    assert sorted(got) == [(1, 2, 8, 3, 0, 2), (2, 0, 8, 3, 0, 2)]


def test_tokenizer_on_random_strings(codec):
    rng = random.Random(2)
    letters = [*map(chr, range(300)), " ", "　", "\U0001f600", "中", "́", "<|endoftext|>", "'ll", "  ", "\n\n"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids and codec.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    text = "ab" * 30_000 + "q" * 5000
    assert codec.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_forced_cuts_are_inside_no_token(codec):
    inside = {token[i : i + 2] for token in bpe.load(queries.TOKENIZER)["ids"] for i in range(len(token) - 1)}
    for word in (b"zqxjhello", bytes(range(256)), b"a" * 200):
        parts = codec.fragments(word)
        assert b"".join(parts) == word and all(a[-1:] + b[:1] not in inside for a, b in zip(parts, parts[1:]))


def test_tokens_of_documents(spark, con):
    import hashlib

    got = {r["doc_id"]: r for r in queries.op2_bpe(spark, SF).collect()}
    for d, text in texts(con):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        assert tuple(got[d])[1:] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_archives_hold_every_payload_once(spark, con):
    pages = warc.records(table(spark, SF, "pages"))
    path = shared_folder(spark)
    warc.write_archives(pages, warc.resolve(pages), path, records_per_file=7)
    read = warc.read_archives(spark, path).collect()
    html = {str(p): (h or "").encode() for p, h in texts(con, "pages", "page_id", "html")}
    assert sorted(r["page_id"] for r in read) == sorted(html)
    for r in read:
        assert bytes(r["payload"]) == (html[r["page_id"]] if r["record_type"] == "response" else b"")
        assert r["record_type"] == "response" or html[r["refers_to"]] == html[r["page_id"]]
    kept = [html[r["page_id"]] for r in read if r["record_type"] == "response" and len(html[r["page_id"]]) >= 1000]
    assert len(kept) == len(set(kept))


def test_items_within_an_edit_distance(spark):
    rng = random.Random(3)
    items = [(i, brute.prose(rng, rng.choice([1, 2, 5, 9, 20, 40]))) for i in range(25)]
    docs = []
    for i in range(150):
        item = rng.choice(items)[1]
        n = len(item.split())
        docs.append((i, f"{brute.prose(rng, 60)} {brute.edited(rng, item, rng.randint(0, max(1, n // 4)))} {brute.prose(rng, 60)}"))
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            edits = brute.edits_inside(item.split(), text.split())
            if edits <= decontaminate.allowed(len(item.split()), decontaminate.EDITS):
                want[d, i] = edits
    assert set(found) <= set(want) and len(found) >= 0.97 * len(want)
    assert all(found[p] >= want[p] for p in found)


@pytest.mark.parametrize("edits", [decontaminate.EDITS, 0.5])
@pytest.mark.parametrize("n", [1, 2, 5, 40, 80, 150, 300])
def test_long_items_with_deletions_at_the_limit(spark, n, edits):
    rng = random.Random(n)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(n))) for i in range(20)]
    docs = []
    for i, item in items:
        gone = set(rng.sample(range(n), decontaminate.allowed(n, edits)))
        docs.append((i, f"{brute.prose(rng, 60)} {' '.join(w for at, w in enumerate(item.split()) if at not in gone)} {brute.prose(rng, 60)}"))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), edits)
    assert {(i, i) for i, _ in items} <= {(r["doc_id"], r["item_id"]) for r in found.collect()}


def test_exact_items_are_always_found(spark, con):
    items, docs = texts(con, "benchmark", "item_id"), texts(con)
    want = {(d, i) for d, t in docs for i, x in items if t and x in t}
    assert want <= {(r["doc_id"], r["item_id"]) for r in queries.op4_decontaminate(spark, SF).collect()}


def test_totals_follow_the_changes(spark):
    rng = random.Random(4)
    state, ledger = {}, shared_folder(spark)
    schema = "op string, source string, lang string, tokenizer_version string, n_tokens long, old_n_tokens long, old_source string, old_lang string, old_tokenizer_version string"
    for batch in range(6):
        rows = []
        for _ in range(40):
            d, key, n = rng.randrange(60), (rng.choice("ab"), rng.choice(["en", None]), "v1"), rng.randrange(100)
            if d not in state:
                rows.append(("insert", *key, n, None, None, None, None))
                state[d] = (key, n)
            elif rng.random() < 0.4:
                rows.append(("delete", *state[d][0], state[d][1], None, None, None, None))
                del state[d]
            else:
                rows.append(("revise", *key, n, state[d][1], *state[d][0]))
                state[d] = (key, n)
        changes = spark.createDataFrame(rows, schema)
        assert rollup.commit(changes, ledger, f"b{batch}") and not rollup.commit(changes, ledger, f"b{batch}")
        if batch in (2, 4):
            rollup.compact(spark, ledger)
            assert not rollup.commit(changes, ledger, f"b{batch}")
        if batch == 3:  # a batch that broke off before its marker was written
            changes.limit(3).select(*rollup.KEYS, F.lit(1).cast("long").alias("d_docs"), F.lit(7).cast("long").alias("d_tokens")).write.parquet(f"{ledger}/batch=broken")
            from leadloom.llm.common import remove

            remove(spark, f"{ledger}/batch=broken/_SUCCESS")
        want = Counter()
        for key, n in state.values():
            want[key] += n
        got = {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals(spark, ledger).collect()}
        assert got == {k: (sum(1 for x, _ in state.values() if x == k), want[k]) for k in {x for x, _ in state.values()}}


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows) > 30


def test_rules_are_paths_over_statistics():
    rule = quality.Rules(["a", "b"], [(((0, True, 1.0), (1, False, 2.0)), 0.7)], -0.1)
    assert "a" in str(rule.score(F.col("s"))) and "b" in str(rule.score(F.col("s")))


def test_sketches_merge(spark):
    rng = random.Random(5)
    rows = [(brute.prose(rng, rng.randint(0, 80)), brute.prose(rng, rng.randint(0, 80))) for _ in range(40)]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b"))
    for r in df.select(a.alias("x"), b.alias("y"), fingerprint.merged(a, b).alias("m")).collect():
        both = sorted({*r["x"], *r["y"]})
        assert r["m"] == ([h for h in both if h < "4"] or both[:1])


def test_containment_of_unequal_texts(spark):
    rng = random.Random(6)
    long = brute.prose(rng, 4000, 10**6)
    part = " ".join(long.split()[500:1300])
    a, b = fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b"))
    r = spark.createDataFrame([(part, long)], "a string, b string").select(fingerprint.containment(a, b).alias("x"), fingerprint.containment(b, a).alias("y")).first()
    assert r["x"] == 1.0 and abs(r["y"] - 0.2) < 0.06


def test_next_document_over_gaps(spark):
    rng = random.Random(8)
    ids = sorted({0, 5, 1023, 1024, 2**30 - 1, 2**30, 2**40 + 7, -9, *[rng.randrange(2**33) for _ in range(50)]})
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(docs).collect()}
    assert got == {i: f"t{j}" for i, j in zip(ids, [*ids[1:], ids[0]])}


@pytest.mark.parametrize("short", [3, 8])
def test_linked_groups(spark, monkeypatch, short):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    rng = random.Random(9)
    docs, common = [], brute.prose(rng, 30)
    for g in range(12):
        base = brute.prose(rng, rng.choice([4, 6, 12, 40, 150]))
        for _ in range(rng.choice([1, 2, 5, 25])):
            docs.append(brute.edited(rng, base, rng.randint(0, max(1, len(base.split()) // 25))))
    docs += [f"{brute.prose(rng, 10)} {common} {brute.prose(rng, 10)}" for _ in range(40)] + [None, "", " ", "One two", "one  TWO", docs[0], docs[0]]
    rng.shuffle(docs)
    rows = [(i * 7, t) for i, t in enumerate(docs)]
    got = ngram_join.linked_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.groups(rows)


def test_rows_without_an_id_link_others(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(7, " ".join(words[:86])), (None, " ".join(words)), (9, " ".join(words[14:])), (None, "a text of its own that is near no other")]
    rows += [(20, brute.prose(random.Random(12), 60))]
    got = ngram_join.linked_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["n_shingles"] > 60) == [(82, 7), (82, 7), (96, 7)]


def test_edges_of_near_copies_grow_with_their_number_not_their_pairs(spark, monkeypatch):
    rng, fed, larger = random.Random(5), [], components._larger
    monkeypatch.setattr(components, "_larger", lambda edges: (fed.append(edges.count()), larger(edges))[1])
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(w for w in words if rng.random() > 0.015)) for i in range(300)]
    got = ngram_join.linked_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.groups(rows)
    assert sum(fed) <= 10 * len(rows), fed


def test_members_of_long_lists_meet_in_few_pairs(spark):
    # sets under 40 keys each; of 200, 40 are in groups of their own
    rows = spark.createDataFrame([(k, i, 0, 0, i if i < 40 else 1000) for i in range(200) for k in range(40)], "key long, set long, size long, long long, g long")
    pairs = lambda df: {(r["set_a"], r["set_b"]) for r in df.select("set_a", "set_b").collect()}
    every, some = pairs(ngram_join.meetings(rows)), pairs(ngram_join.meetings(rows, some=True))
    assert every == {(a, b) for a in range(40) for b in range(a + 1, 200)}
    assert some < every and {x for p in some for x in p} >= set(range(40))
    assert len(some) <= 40 * ngram_join.LISTS * (ngram_join.MOST + ngram_join.SHARE)
    assert pairs(ngram_join.meetings(rows, some=True, among=rows.filter("set < 20"))) <= {(a, b) for a in range(20) for b in range(a + 1, 20)}


def test_free_arrow_memory_goes_back_at_the_end_of_a_task(monkeypatch):
    events = []
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: events.append("released")))
    for batch in common.released(lambda batches: (b + 1 for b in batches))([1, 2]):
        events.append(batch)
    assert events == [2, 3, "released"]


def test_groups_are_merged_by_links_between_them(spark):
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)], "node long, component long")
    links = spark.createDataFrame([(5, 3), (3, 5), (1, 9), (7, 8), (8, 7), (1, 1)], "a long, b long")
    got = sorted(map(tuple, components.merged(groups, links).collect()))
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 3), (7, 7), (8, 7), (9, 1)]
    assert sorted(map(tuple, components.merged(groups, links.limit(0)).collect())) == sorted(map(tuple, groups.collect()))


def test_frequent_shingles_are_indexed_in_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (3, 5, 20, 49, 64, 65, 90, 400, 3000):
        base = rng.integers(0, 2**63, n + n // 3 + 1, dtype=np.uint64)
        often = np.zeros(ngram_join.CELLS, bool)
        often[(base[:: 1 if n % 2 else 2] >> np.uint64(44)).astype(np.int64)] = True
        for _ in range(20):
            k = rng.integers(-(-3 * n // 4), n + 1)  # a partner: a subset, or a superset
            for size in {int(k), min(len(base), 4 * n // 3)}:
                x, y = np.sort(base[:n]), np.sort(rng.choice(base[:n], size, replace=False) if size <= n else base[:size])
                if 4 * len(np.intersect1d(x, y)) >= 3 * len(np.union1d(x, y)):
                    a, b = ngram_join.signatures(x, often), ngram_join.signatures(y, often)
                    assert len(np.intersect1d(a, b)) or np.array_equal(x, y), (n, size)


def test_components(spark):
    rng = random.Random(10)
    edges = [(i, i + 1) for i in range(0, 200)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(5000, i) for i in range(5001, 5100)]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    looped = {a for a, b in edges if a == b}
    want = {x: find(x) for x in list(parent)}
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == c for x, c in want.items()) and set(want) - set(got) <= looped


def test_copied_documents_keep_their_lines_and_templates_go(spark):
    line = "Posted on {} by user number {} today"
    docs = [(i, f"own text {' '.join(random.Random(i).choices(['ash', 'birch', 'cedar', 'elm', 'fir', 'oak', 'pine', 'yew'], k=12))}\n{line.format(2000 + i, i)}") for i in range(8)]
    docs += [(100 + i, "This is a text that stands\nin many copies of one document") for i in range(20)]
    got = {r["doc_id"]: r["text"] for r in lines.without_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, text in docs:
        assert got[d] == (text if d >= 100 else text.split("\n")[0])


def test_worker_caches_answer_for_their_own_value():
    held = {}
    assert [built(held, [i], lambda v: v[0]) for i in range(1000)] == [*range(1000)]


def test_languages(spark):
    rng = random.Random(11)
    kinds = {"aa": "abcde", "bb": "defgh", "cc": "hijkl"}
    docs = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(2, 7))) for _ in range(30)), k) for i, k in enumerate(sorted(kinds) * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    tables = langid.learn(df.filter("doc_id < 90"))
    rows = langid.predict(df.filter("doc_id >= 90"), tables).collect()
    assert all(r["lang_pred"] == docs[r["doc_id"]][2] and 0.9 < r["score"] <= 1 for r in rows)
    scorer = langid.Scorer(tables)
    assert scorer.judge("12 34 !")[0] == "und" and len(scorer.backoff("abab")) > 0


def test_kept_words_have_their_counts_in_every_language(spark):
    docs = [(i, "common rare" if i else "common", "aa") for i in range(10)] + [(10 + i, "rare", "bb") for i in range(10)]
    tables = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"), words_per_language=1, grams_per_length=1)
    assert abs(float(tables["words"]["rare"][0]) - math.log(9.5 / 20)) < 1e-6  # 9 of 19, and a half for each of two words
    assert abs(float(tables["grams"]["^rare"][0]) - math.log(9.5 / 20)) < 1e-6


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_language(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns, got = rows_of(df.columns, df.collect())
    rel = con.execute(queries.ORACLE[name])
    assert (columns, got) == rows_of([d[0] for d in rel.description], rel.fetchall())


def test_query_results(spark, con):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_ngram_join(spark, SF).collect()}
    assert got == brute.groups(texts(con))
    import hashlib

    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op1_suffix_dedup(spark, SF).collect()}
    assert got == {d: (n, r, s, hashlib.sha256(k).hexdigest()) for d, (n, r, s, k) in brute.removed(texts(con), 100).items()}


def test_pipeline_stage_by_stage(spark, con):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    out = written(stages["quality_rules"](spark, docs, SF))
    marks = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert sum((d in ids) == bool(q) for d, q in marks.items()) >= 0.9 * len(marks)

    own = duckdb.connect()
    own.register("documents", out.toPandas())
    docs, out = out, written(stages["line_templates"](spark, out, SF))
    import hashlib

    want = {d: k for d, _, _, k in own.execute(lines.ORACLE).fetchall()}
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in rows.items()} == want

    docs, out = out, written(stages["ngram_groups"](spark, out, SF))
    kept = {d for d, (_, c) in brute.groups(list(rows.items())).items() if d == c}
    assert {r["doc_id"] for r in out.collect()} == kept

    items = [(i, decontaminate_words(t)) for i, t in texts(con, "benchmark", "item_id")]
    docs, out = out, written(stages["decontamination"](spark, out, SF))
    left = {r["doc_id"] for r in out.collect()}
    for d in kept:
        w = decontaminate_words(rows[d])
        inside = set(zip(w, w[1:]))
        # an item that shares no more pairs than this is too far away
        near = [t for _, t in items if sum(p in inside for p in zip(t, t[1:])) >= len(t) - 1 - 2 * decontaminate.allowed(len(t), decontaminate.EDITS)]
        assert (d in left) == (not any(brute.edits_inside(t, w) <= decontaminate.allowed(len(t), decontaminate.EDITS) for t in near)), d

    final = {r["doc_id"]: r for r in stages["bpe_tokens"](spark, out, SF).collect()}
    assert set(final) == left
    for d, r in final.items():
        assert r["ids"] == LIBRARY.encode(rows[d], add_special_tokens=False).ids and r["text"] == rows[d] and r["n_tokens"] == len(r["ids"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == left


def decontaminate_words(text):
    import re

    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
