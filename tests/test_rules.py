"""Hand-made rows for the rule expressions."""

import pytest
from pyspark.sql import functions as F

from leadloom.functions import dates, numbers, urls
from leadloom.functions.text import html_to_text, short_title
from leadloom.operators import emails as em
from leadloom.operators import gates, sites
from leadloom.sources import feeds


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_"))
    return row.select(column.alias("x")).first()["x"]


PAGES = [
    ('<a href="mailto:hi@shopbrand.co">m</a>', ["hi@shopbrand.co"]),
    ('<script type="application/ld+json">{"email":"press@makerbrand.com"}</script>', ["press@makerbrand.com"]),
    ("press [at] makerbrand [dot] com", ["press@makerbrand.com"]),
    ("info ＠ makerbrand.com", ["info@makerbrand.com"]),
    ('var e = "info" + "@" + "brandco.com";', ["info@brandco.com"]),
    ("user</span>@<span>brand.io", ["user@brand.io"]),
    ("a​b@brand.io", ["ab@brand.io"]),
    ('<a href="mailto:enc%40brand.io?x=1">', ["enc@brand.io"]),
    ('<img src="logo@2x.png">', []),
    ("mail me at hi@example.com", []),
    ("hi@acme.com here", []),
]


@pytest.mark.parametrize("html,expected", PAGES)
def test_page_addresses(spark, html, expected):
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = em.page_emails(pages).filter(em.exclusion_reason(F.col("email")).isNull())
    assert [r["email"] for r in rows.orderBy("position").collect()] == expected


def test_xor_attribute(spark):
    key, address = 0x5A, "sales@makerbrand.com"
    hidden = f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in address)
    pages = spark.createDataFrame([(1, f'<a data-cfemail="{hidden}">x</a>')], "page_id long, html string")
    assert em.page_emails(pages).first()["email"] == address


def test_huge_token_is_linear(spark):
    import time

    html = "x" + "QUJD" * 60_000 + " tail info@brand.co"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    start = time.time()
    assert [r["email"] for r in em.page_emails(pages).collect()] == ["info@brand.co"]
    assert time.time() - start < 20


@pytest.mark.parametrize(
    "value,domain",
    [
        ("https://shop.unionchen.com.tw/x", "unionchen.com.tw"),
        ("mail.makerz.co.kr", "makerz.co.kr"),
        ("info@sharge.com", "sharge.com"),
        ("http://www.a.b.example.co.jp:8080/p?q#f", "example.co.jp"),
    ],
)
def test_registrable_domain(spark, value, domain):
    assert one(spark, urls.registrable_domain(F.col("v")), v=value) == domain


@pytest.mark.parametrize(
    "value,owner",
    [
        ("support@kickstarter.com", "crowdfunding_platform"),
        ("https://reurl.cc/abcd", "url_shortener"),
        ("apply@ideafound.com", "agency"),
        ("x@gmail.com", "personal_email"),
        ("a@lg.com", "unrelated_company"),
        ("a@nobody.org", "unknown"),
    ],
)
def test_ownership(spark, value, owner):
    assert one(spark, em.ownership(F.col("v"))["ownership_class"], v=value) == owner


@pytest.mark.parametrize("local,role", [("wholesale", "high"), ("care", "support"), ("info", "mid"), ("noreply", "exclude"), ("ethan", "unknown")])
def test_roles(spark, local, role):
    assert one(spark, em.email_role(F.col("v")), v=f"{local}@x.com") == role


def test_label_overrides_local_part_but_not_exclusion(spark):
    assert one(spark, em.email_role(F.col("v"), F.col("l")), v="ethan@x.com", l="Press & Influencers") == "exclude"
    assert one(spark, em.email_role(F.col("v"), F.col("l")), v="media@x.com", l="General Inquiry") == "exclude"
    text = "hello@x.com Press & Influencers ethan@x.com"
    assert one(spark, em.label_before(F.col("t"), F.col("e")), t=text, e="ethan@x.com") == "Press & Influencers"


def test_platform_account(spark):
    assert one(spark, urls.is_platform_account(F.col("v")), v="http://www.facebook.com/kickstarter") is True
    assert one(spark, urls.is_platform_account(F.col("v")), v="http://www.facebook.com/brand") is False


@pytest.mark.parametrize(
    "base,href",
    [
        ("https://a.com/b/c", "../d"), ("https://a.com/b/c/", "./d/./e"), ("https://a.com", "x/y"), ("https://a.com/b?q=1", "?p=2"),
        ("https://a.com/b/c", "//h.com/z"), ("https://a.com/b/c", "/r/../s/"), ("https://a.com/b/c", "https://t.io/u"), ("https://a.com/b/c/d", "../.."),
    ],
)
def test_resolve_url_like_the_standard_library(spark, base, href):
    from urllib.parse import urljoin

    assert one(spark, sites.resolve_url(F.col("b"), F.col("h")), b=base, h=href) == urljoin(base, href)


def test_clamp_rounds_half_to_even(spark):
    assert [one(spark, numbers.clamp(F.col("v")), v=v) for v in (0.5, 1.5, 2.5, -3.0, 100.4, 250.0)] == [0, 2, 2, 0, 100, 100]


def test_business_days_match_a_walk(spark):
    from datetime import datetime, timedelta

    starts = [datetime(2024, 1, 1, 9, 30) + timedelta(days=d) for d in range(14)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(starts)], "i int, ts timestamp")
    for n in (1, 2, 5, 11):
        got = {r["i"]: r["x"] for r in rows.select("i", dates.add_business_days(F.col("ts"), n).alias("x")).collect()}
        for i, day in enumerate(starts):
            left = n
            while left:
                day += timedelta(days=1)
                left -= day.weekday() < 5
            assert got[i] == day


def test_text_helpers(spark):
    html = "<div>A &amp; B<br>c<script>no()</script><img src='x'></div><p>  d   e </p>"
    assert one(spark, html_to_text(F.col("v")), v=html) == "A & B\nc\nd e"
    assert one(spark, short_title(F.col("v")), v="Aurora Lamp [2024]: light for all") == "Aurora Lamp"


def test_money(spark):
    currency, amount = feeds.money(F.col("v"))
    assert one(spark, currency, v="HK$6,302,621") == "HKD" and float(one(spark, amount, v="HK$6,302,621")) == 6302621.0
    assert one(spark, feeds.short_count(F.col("v")), v="1.9k") == 1900


def test_funding_items_goal_from_percent(spark):
    payload = '{"data":[{"id":"1","title":"t","linkUrl":"/web/x","amount":"87903000","rate":"17580","endDate":"2024-05-01T00:00:00Z"}]}'
    row = feeds.funding_projects(spark.createDataFrame([(payload,)], "payload string")).first()
    assert int(row["goal_amount"]) == 500017 and row["currency"] == "KRW" and row["source_url"].startswith("https://")


def test_reasons_are_merged_by_containment(spark):
    merged = gates.merge_reasons(F.array(F.lit("page missing (no url)")), F.array(F.lit("pagemissing"), F.lit("bulky"), F.lit("too bulky to ship")))
    assert one(spark, merged, v=1) == ["page missing (no url)", "bulky"]


def test_collisions(spark):
    rows = [
        ("https://stardome.com/", "<title>Stardome Comedy Club</title>", "Stardome", ["stardome", "projector"], "same_name_different_business"),
        ("https://www.wilson.com/", "<title>Wilson</title>", "Wilson", ["wilson"], "major_unrelated_brand:wilson.com"),
        ("https://demo.vercel.app/", "<title>x</title>", "Nova", ["nova"], "hosting_preview_not_official"),
        ("https://www.nih.gov/", "<title>x</title>", "Nova", ["nova"], "institutional_not_maker"),
        ("https://novalamp.com/", "<title>Nova Lamp</title>", "Nova", ["nova", "lamp"], "identity_match"),
    ]
    pages = spark.createDataFrame(rows, "url string, html string, maker_name string, terms array<string>, want string")
    checked = sites.collision_check(sites.site_identity(pages))
    assert all(r["collision_reason"] == r["want"] for r in checked.collect())


def test_long_local_parts_are_redacted_whole(spark):
    from leadloom.sources.store import redacted

    rows = spark.createDataFrame([(f"write to {'a' * 100}.b@brand.com, or x@y.co.jp now",)], "note string")
    assert redacted(rows, ["note"], {"note"}).first()["note"] == "write to [redacted-email], or [redacted-email] now"


def test_more_people_than_eight_are_found(spark):
    from leadloom.operators.contacts import people_on_pages

    firsts, lasts = ["Anna", "Boris", "Clara", "David", "Elena", "Frank", "Greta", "Henry", "Irene", "Jacob"], "Miller"
    text = ". ".join(f"{f} {lasts}, Manager" for f in firsts)
    rows = people_on_pages(spark.createDataFrame([(1, "https://www.brand1.com/team", text, "brand1.com")], "project_id long, url string, text string, official_domain string"))
    assert {r["name"] for r in rows.collect()} == {f"{f} {lasts}" for f in firsts}


def test_listings_without_an_address_hide_none(spark):
    one = "struct<url:string,checked_at:timestamp,method:string,excerpt:string>"
    items = [(None, None, "m", None)] * 6 + [("https://shop.com/", None, "m", None)]
    rows = spark.createDataFrame([(items,)], f"items array<{one}>")
    assert len(rows.select(gates._listings(F.col("items"), "sold", "shop").alias("e")).first()["e"]) == 1


def test_challenge_behind_a_long_page(spark):
    from leadloom.sources.html_cards import campaign_details

    html = "<title>x</title>" + "<p>filler</p>" * 1000
    pages = spark.createDataFrame([(1, html + "<title>Just a moment...</title>", "t"), (2, html, "已於 2024/3/5 募資結束")], "page_id long, html string, text string")
    rows = {r["page_id"]: r for r in campaign_details(pages).collect()}
    assert rows[1]["challenged"] and rows[1]["status"] is None
    assert not rows[2]["challenged"] and rows[2]["status"] == "finished" and str(rows[2]["end_date"]) == "2024-03-05"


@pytest.mark.parametrize("piece", ["QUJD", "<br> ", "a.", "\"x\" + ", "[at] ", " at", "@ "])
def test_address_search_takes_linear_time(spark, piece):
    import time

    took = []
    for n in (40_000, 160_000):
        pages = spark.createDataFrame([(1, piece * (n // len(piece)) + " tail info@brand.co")], "page_id long, html string").cache()
        pages.count()
        em.page_emails(pages).collect()
        start = time.time()
        assert "info@brand.co" in [r["email"] for r in em.page_emails(pages).collect()]
        took.append(time.time() - start)
    assert took[1] < 9 * took[0] + 2


def test_official_site_by_title_and_identity(spark):
    results = spark.createDataFrame(
        [(1, "https://hyundaebio.kr/a", "현대바이오 공식", 10, 1, "현대바이오", []), (2, "https://shop.kr/b", "놀로 lamp", 10, 1, "(주)놀로", []), (2, "https://nolo.kr/", "놀로", 5, 2, "(주)놀로", []),
         (3, "https://blocked.kr/", "노바", 9, 1, "노바", []), (4, "https://other.kr/", "no name", 9, 1, "노바", []), (5, "https://www.gmarket.co.kr/", "놀로", 9, 1, "놀로", []),
         (6, "https://brandlamp.com/x", "Brandlamp", 3, 1, "Brandlamp", ["brandlamp"])],
        "project_id long, url string, title string, score int, position long, maker_name string, terms array<string>",
    )
    names = {"hyundaebio.kr": ["현대 바이오"], "shop.kr": ["LG전자 놀로"], "nolo.kr": ["놀 로 | home"], "blocked.kr": ["노바 - Just a moment"], "other.kr": ["노바"], "gmarket.co.kr": ["놀로"], "brandlamp.com": ["x"]}
    identities = spark.createDataFrame(list(names.items()), "domain string, names array<string>")
    got = {r["project_id"]: (r["official_url"], r["how"]) for r in sites.official_site(results, identities).collect()}
    assert got == {1: ("https://hyundaebio.kr", "title"), 2: ("https://nolo.kr", "title"), 6: ("https://brandlamp.com", "domain")}


def test_labels_without_predictions_count_and_blocked_ones_do_not(spark):
    from leadloom.operators import evaluation as ev

    labels = spark.createDataFrame([(1, "verified", ["a@b.c"], []), (2, "verified", ["d@e.f"], []), (3, "blocked", ["g@h.i"], []), (4, None, ["j@k.l"], [])], "project_id long, verification_status string, expected_direct_emails array<string>, plausible_unconfirmed_emails array<string>")
    predictions = spark.createDataFrame([(1, ["A@b.c ", "x@y.z"]), (3, ["q@q.q"]), (9, ["n@n.n"])], "project_id long, emails array<string>")
    r = ev.email_scores(ev.scored(labels, predictions)).first()
    assert (r["n"], r["tp"], r["fp"], r["fn"]) == (2, 1, 1, 1)
    rows = {r["verification_status"]: (r["n_labels"], r["n_counted"], r["n_with_prediction"], r["n_unlabelled"]) for r in ev.coverage(labels, predictions).collect()}
    assert rows == {"verified": (2, 2, 1, 0), "blocked": (1, 0, 1, 0), None: (1, 0, 0, 1)}


def test_labelled_values_of_any_length(spark):
    from leadloom.operators.contacts import labelled_fields

    street = "서울특별시 강남구 테헤란로 " + "123-45 " * 30 + "7층"
    text = f"상호명: {'가나다 ' * 30}끝 대표자: 김철수 | 사업장  소재지: {street}\n브랜드: |  브랜드 : 노바/랩 전화 02-123-4567"
    df = spark.createDataFrame([(text,), ("",), (None,), ("대표 이메일: a@b.kr",)], "t string")
    rows = df.select(*[c.alias(n) for n, c in labelled_fields(F.col("t")).items()]).collect()
    assert rows[0]["company_name"] == "가나다 " * 30 + "끝" and rows[0]["representative"] == "김철수"
    assert rows[0]["address"] == street and rows[0]["brand_name"] == "노바" and rows[0]["maker_name"] is None
    assert all(rows[i][c] is None for i in (1, 2, 3) for c in ("company_name", "representative", "address"))


def test_people_are_read_in_front_of_titles(spark):
    from leadloom.operators.contacts import titled_people

    cases = {
        "Meet Jane Miller, CEO and (Tom B. Hardy | VP Sales Europe.": [("Jane Miller", "CEO"), ("Tom B. Hardy", "VP Sales Europe")],
        "Ann Lee - Co-Founder; Bo Xu – Head of Global Sales, Paris": [("Ann Lee", "Co-Founder"), ("Bo Xu", "Head of Global Sales")],
        "Sales, CEO": [], "CEO": [], "": [], "Jane Miller, friend of the CEO": [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i long, t string").orderBy("i").select(titled_people(F.col("t")).alias("p"))
    assert [[(x["name"], x["title"]) for x in r["p"]] for r in df.collect()] == list(cases.values())


def test_korean_channels(spark):
    from leadloom.operators.sites import korean_channels

    text = "see https://blog.naver.com/shop?x=1, 'https://pf.kakao.com/_abc' https://band.us/ https://blog.naver.com/other https://notband.us/x"
    got = spark.createDataFrame([(text,), ("",)], "t string").select(korean_channels(F.col("t")).alias("m")).collect()
    assert got[0]["m"] == {"naver_blog": "https://blog.naver.com/shop", "kakao": "https://pf.kakao.com/_abc"} and got[1]["m"] == {}


def test_labelled_fields_split_a_text_once(spark):
    from leadloom.operators.contacts import labelled_fields

    df = spark.createDataFrame([("상호: 대표 Works  / 상호: A\n상호 : B | C 대표자: Kim",), ("x",), (None,)], "t string")
    fields = df.select(labelled_fields(F.col("t"))["company_name"].alias("v"))
    assert fields._jdf.queryExecution().analyzed().toString().count("[<|/·") == 1
    assert [r[0] for r in fields.collect()] == ["대표 Works", None, None]


def test_search_payloads_are_parsed_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def loaded(payload):
        read.add(1)
        return payload

    record = '{"url": "https://a.io/%d", "title": "t", "description": "s"}'
    payloads = [(1, "brave", '{"web": {"results": [%s, %s]}}' % (record % 1, record % 1)), (2, "brave", '{"odd": [%s]}' % (record % 2)), (3, "brave", None),
                (4, "tavily", '{"results": [%s]}' % (record % 4)), (5, "bing", '{"odd": [%s]}' % (record % 5)), (6, "other", '{"results": [%s]}' % (record % 6))]
    rows = spark.createDataFrame(payloads, "query_id long, provider string, payload string").withColumn("payload", loaded("payload"))
    got = feeds.search_results(rows).collect()
    assert sorted((r["query_id"], r["url"]) for r in got) == [(1, "https://a.io/1"), (2, "https://a.io/2"), (4, "https://a.io/4")]
    assert read.value == len(payloads)
