"""Lists and titles are whole unless a limit is asked for."""

import json

from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions.text import brand_phrases
from leadloom.operators import aggregates, gates, queries
from leadloom.operators.contacts import contact_summary
from leadloom.operators.entities import prediction_snapshot
from leadloom.operators.joins import match_makers
from leadloom.sources import feeds


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_"))
    return row.select(column.alias("x")).first()["x"]


def test_documents_of_a_project(spark):
    html = "".join(f'<a href="https://brand.com/catalog{i}.pdf">c</a>' for i in range(9))
    pages = spark.createDataFrame([(1, 0, "https://brand.com/", html)], "project_id long, position int, url string, html string")
    projects = spark.createDataFrame([(1, "Brand", "Lamp", "kickstarter", "https://brand.com/")], "id long, maker_name string, title string, source_site string, maker_url string")
    assert len(contact_summary(pages, projects).first()["documents"]) == 9


def test_evidence_of_a_prediction(spark):
    layers = spark.createDataFrame([(1, 1, "email", "a@b.co"), *[(1, 1, "evidence", f"https://b.co/{i:02}") for i in range(25)]], "project_id long, layer_rank int, kind string, value string")
    assert len(prediction_snapshot(layers).first()["evidence_urls"]) == 25
    assert len(prediction_snapshot(layers, 20).first()["evidence_urls"]) == 20


def test_domains_and_phrases(spark):
    domains = queries.guessed_domains(F.col("a"), F.col("b"), F.col("c"))
    assert len(one(spark, domains, a="brand", b="slug", c="project")) == 27
    assert one(spark, brand_phrases(F.col("v"), ()), v="Aaa, Bbb, Ccc, Ddd, Eee, Fff") == ["Aaa", "Bbb", "Ccc", "Ddd", "Eee", "Fff"]


def test_channels_and_terms(spark):
    channels = F.transform(F.sequence(F.lit(10), F.lit(20)), lambda i: F.struct(
        F.concat(F.lit("c"), i.cast("string")).alias("channel"), F.lit("").alias("label"), F.lit("found").alias("status"),
        F.concat(F.lit("https://x.jp/"), i.cast("string")).alias("search_url"), F.lit("").alias("note")))
    found = aggregates.interpret_japan(F.lit("completed"), channels)
    assert len(one(spark, found["japan_evidence"])) == 11 == len(one(spark, found["japan_source_urls"]))
    terms = one(spark, gates.regulatory_checks(F.col("v")), v=" ".join(vocab.REGULATORY_CHECKS["radio_law"]))
    assert sorted(vocab.REGULATORY_CHECKS["radio_law"]) == next(t["terms"] for t in terms if t["item"] == "radio_law")


def test_long_titles(spark):
    title = "t" * 700
    payload = json.dumps({"data": [{"id": "1", "title": title, "linkUrl": "/web/x"}]})
    assert feeds.funding_projects(spark.createDataFrame([(payload,)], "payload string")).first()["title"] == title
    page = ("makuake", "https://www.makuake.com/project/a/", f'<meta property="og:title" content="{title}">', "")
    assert feeds.success_projects(spark.createDataFrame([page], "platform string, url string, html string, text string"), "2024-01-01").first()["title"] == title
    projects = spark.createDataFrame([(1, "n" * 300 + "a", None, None, None), (2, "n" * 300 + "b", None, None, None)], "id long, title string, maker_id long, maker_url string, maker_name string")
    makers = spark.createDataFrame([], "id long, name string, website_url string")
    assert len({r["maker_id"] for r in match_makers(projects, makers).collect()}) == 2


def test_payload_is_walked_to_the_end(spark):
    def nested(depth):
        node = {"url": f"https://deep.com/{depth}", "title": "t", "inner": {"url": "https://inside.com/"}}
        for i in range(depth):
            node = [node, 1] if i % 2 else {"a": node, "b": "x"}
        return json.dumps(node)

    depths = (0, 1, 5, 6, 7, 12, 40)
    rows = spark.createDataFrame([(d, "brave", nested(d)) for d in depths] + [(99, "brave", "{}"), (98, "brave", "no json")], "query_id long, provider string, payload string")
    got = sorted((r["query_id"], r["url"], r["title"]) for r in feeds.search_results(rows).collect())
    assert got == [(d, f"https://deep.com/{d}", "t") for d in depths]
