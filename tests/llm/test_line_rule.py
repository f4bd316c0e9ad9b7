"""The rule of the line dedup on planted cases, each also by its SQL."""

import hashlib
import random

import duckdb
import pandas as pd
import pytest

from leadloom.llm import lines

WORDS = [a + b for a in "b c d f g k l m n p r s t".split() for b in "a e i o u al en ir os ut".split()]


def own_line(rng, n=9):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def dropped(spark, docs):
    """{doc_id: lines that went}, checked against the SQL."""
    rows = lines.without_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    want = {d: h for d, _, _, h in con.execute(lines.ORACLE).fetchall()}
    kept = {r["doc_id"]: r["text"] for r in rows}
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in kept.items()} == want
    return {d: [x for x in t.split("\n") if x not in kept[d].split("\n")] for d, t in docs}


@pytest.mark.parametrize("own,shared,seed", [(3, 6, 1), (3, 6, 2), (3, 6, 3), (4, 2, 4), (5, 5, 5)])
def test_shared_lines_go_though_they_are_much_of_a_document(spark, own, shared, seed):
    rng = random.Random(seed)
    often = [own_line(rng) for _ in range(shared)]
    docs = []
    for d in range(120):
        text = often + [own_line(rng) for _ in range(own)]
        rng.shuffle(text)
        docs.append((d, "\n".join(text)))
    assert all(sorted(gone) == sorted(often) for gone in dropped(spark, docs).values())


def test_a_large_group_of_copies_does_not_outweigh_the_rest(spark):
    rng = random.Random(6)
    often = "Subscribe to our newsletter for more of this"
    copy = "\n".join([own_line(rng), often, own_line(rng), own_line(rng)])
    docs = [(d, "\n".join([own_line(rng), own_line(rng), own_line(rng), often])) for d in range(50)] + [(1000 + d, copy) for d in range(200)]
    assert all(gone == [often] for gone in dropped(spark, docs).values())


def test_copies_and_near_copies_alone_lose_nothing(spark):
    rng = random.Random(7)
    text = [own_line(rng, 15) for _ in range(12)]
    docs = [(d, "\n".join(text)) for d in range(30)]
    for d in range(30, 60):
        near = [x.split() for x in text]
        for _ in range(2):
            line = rng.choice(near)
            line[rng.randrange(len(line))] = rng.choice(WORDS)
        docs.append((d, "\n".join(" ".join(x) for x in near)))
    assert not any(dropped(spark, docs).values())


def test_short_and_unspaced_lines_are_judged(spark):
    rng = random.Random(8)
    unspaced = "このサイトの利用規約に同意してください。"
    docs = [(d, "\n".join([own_line(rng), "Read more", own_line(rng), "", unspaced, own_line(rng), f"{d}"])) for d in range(40)]
    gone = dropped(spark, docs)
    assert all({"Read more", unspaced, f"{d}"} <= set(gone[d]) and len(gone[d]) == 3 for d in gone)


def test_two_unrelated_documents_are_not_enough(spark):
    rng = random.Random(9)
    a, b = ([own_line(rng) for _ in range(4)] for _ in range(2))
    docs = [(d, "\n".join([*(a if d < 20 else b), "A line in all of them, whatever they are"])) for d in range(40)]
    assert not any(dropped(spark, docs).values())
