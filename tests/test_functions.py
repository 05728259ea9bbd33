"""Cleaning rules on single values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from entitymill.functions import geo, text, web
from entitymill.operators import cleaning
from entitymill.operators.enrichment import page_contacts


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def results(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy("i").collect()]


def test_names(spark):
    cases = {
        "Blue Door Bakery Private Limited": "blue door bakery",
        "Blue Door & Sons Pvt. Ltd.": "blue door and sons",
        "Café Zoë": "cafe zoe", "Joe's": "joe s", "  A   B  ": "a b", "": "", None: "", " !! ": "",
        "x co ltd": "x", "x ltd co": "x ltd", "Coco": "coco", "½ Price ﬁsh": "12 price fish", "Øre ß": "re",
        "Ｆｕｌｌ Ｗｉｄｔｈ": "full width", "a & b": "a and b",
    }
    df = text.with_normalized_name(column(spark, list(cases)), "v", "n")
    assert results(df, "n") == list(cases.values())


def test_labels(spark):
    df = column(spark, ["Address: 12 Hill Rd", "phone: 1", None, "Address:  ", "ADDRESS : x"])
    assert results(df.withColumn("n", text.strip_label(F.col("v"), "Address")), "n") == ["12 Hill Rd", "phone: 1", None, None, "x"]


PHONES = {
    "+91 98200 12345": ("+919820012345", "FOUND"), "098200 12345": ("+919820012345", "FOUND"),
    "98200-12345": ("+919820012345", "FOUND"), "919820012345": ("+919820012345", "FOUND"),
    "0091 98200 12345": ("+919820012345", "FOUND"), "Tel: 022 2200 1234": ("+912222001234", "FOUND"),
    "1800 123 4567": ("+9118001234567", "FOUND"), "no number": (None, "INVALID"), "12": (None, "INVALID"),
    "": (None, "MISSING"), "  ": (None, "MISSING"), None: (None, "MISSING"),
    "+1 202 555 0123": ("+12025550123", "FOUND"), "98200 12345 ext 12": ("+919820012345", "FOUND"),
    "12345678901234567890": (None, "INVALID"), "+91 0 98200 12345": ("+919820012345", "FOUND"),
    "+0 98200 12345": ("+919820012345", "FOUND"), "+999 82001234": (None, "INVALID"), "+0 919820012345": (None, "INVALID"), "+44 20 7946 0958": ("+442079460958", "FOUND"),
}


def test_phones(spark):
    df = cleaning.clean_contacts(column(spark, list(PHONES)).withColumnRenamed("v", "phone").withColumn("website", F.lit(None).cast("string")))
    assert results(df, "normalized_phone", "phone_status") == list(PHONES.values())


URLS = {
    "https://shop.example": ("https://shop.example/", "shop.example", "FOUND"),
    "HTTP://WWW.Shop.Example/A/B/": ("http://www.shop.example/A/B", "shop.example", "FOUND"),
    "shop.example:8080/x": ("https://shop.example:8080/x", "shop.example", "FOUND"),
    "https://shop.example/p?utm_source=a&q=1&b=&GCLID=2#f": ("https://shop.example/p?q=1", "shop.example", "FOUND"),
    "https://shop.example?q=a+b%20c&z=~*": ("https://shop.example?q=a+b+c&z=~%2A/", "shop.example", "FOUND"),
    "https://shop.example/a;p=1/b;q=2": ("https://shop.example/a;p=1/b", "shop.example", "FOUND"),
    "https://shop.example/p?q=100%": ("https://shop.example/p?q=100%25", "shop.example", "FOUND"),
    "https://user:pw@shop.example/": (None, None, "INVALID"), "not a url": (None, None, "INVALID"),
    "under_score.example.com/x": ("https://under_score.example.com/x", "under_score.example.com", "FOUND"),
    "": (None, None, "MISSING"), None: (None, None, "MISSING"),
}


def test_urls(spark):
    df = web.with_url(column(spark, list(URLS)), "v")
    assert results(df, "website_url", "website_domain", "website_status") == list(URLS.values())


def test_website_falls_back_to_raw(spark):
    df = column(spark, ["not a url"]).withColumnRenamed("v", "website").withColumn("phone", F.lit("x"))
    assert results(cleaning.clean_contacts(df), "website_url", "website_status") == [("not a url", "INVALID")]


def test_coordinates_ratings_reviews(spark):
    pairs = [(19.07604321, 72.8777), (0.0, 0.0), (95.0, 72.0), (19.0, 181.0), (None, 1.0), (-19.0, 72.0), (0.0, 5.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, latitude double, longitude double")
    assert results(cleaning.clean_coordinates(df), "latitude", "longitude") == [
        (19.0760432, 72.8777), (None, None), (None, None), (None, None), (None, None), (-19.0, 72.0), (0.0, 5.0)]
    df = column(spark, [4.567, 5.0, 5.1, -0.1, float("nan"), None, 0.0], "double")
    assert results(df.withColumn("r", geo.clean_rating(F.col("v"))), "r") == [4.57, 5.0, None, None, None, None, 0.0]
    df = column(spark, ["12", "-1", "4.7", "x", None, "0"])
    assert results(df.withColumn("r", geo.clean_reviews(F.col("v"))), "r") == [12, None, None, None, None, 0]


def test_links(spark):
    links = [
        "https://m.example/maps/place/A/data=!1s0x1a:0x2b!3d19.5!4d72.25!19sChIJab_-9?x=1",
        "https://m.example/?q=1&place_id=Zz-9", "https://m.example/?ftid=0x1:0x2", "x!1s0xAB:0x9!3d1",
        "https://m.example/maps/place/" + "n" * 60 + "/@-1.5,2.25,3z", None, "https://m.example/",
    ]
    df = cleaning.read_links(column(spark, links), "v")
    assert results(df, "place_id", "latitude", "longitude") == [
        ("ChIJab_-9", 19.5, 72.25), ("Zz-9", None, None), ("0x1:0x2", None, None), ("0xAB:0x9", None, None),
        ("slug_" + "n" * 40, -1.5, 2.25), (None, None, None), (None, None, None)]


ADDRESSES = [
    # address, run city, street, locality, city, state, postal code
    ("Shop 1, 2, Rose Building, 12 Hill Rd, Shanti Nagar, Ward East, Mumbai, Maharashtra 400081", "Mumbai",
     "Shop 1, 2, Rose Building, 12 Hill Rd", "Shanti Nagar, Ward East", "Mumbai", "Maharashtra", "400081"),
    ("12 Hill Road Bandra", "Pune", "12 Hill Road", "Bandra", "Pune", None, None),
    ("12 Hill Road", "Pune", "12 Hill Road", None, "Pune", None, None),
    ("Shanti Nagar", "Pune", None, "Shanti Nagar", "Pune", None, None),
    ("Rose House", "Pune", "Rose House", None, "Pune", None, None),
    ("Flat 9, Shanti Nagar, Navi Mumbai 400703", "Pune", "Flat 9", "Shanti Nagar", "Navi Mumbai", None, "400703"),
    ("Plot 5 | Sector 9 – Noida ; Uttar Pradesh 201301", None, "Plot 5", "Sector 9", "Noida", "Uttar Pradesh", "201301"),
    ("Rose House, Smallville", None, "Rose House", None, "Smallville", None, None),
    ("Rose House, Side Lane", None, "Rose House", "Side Lane", None, None, None),
    ("a, b, West Colony, d", "Pune", "a, b", "West Colony, d", "Pune", None, None),
    ("a, b, c, d, India", "Pune", "a, b, c", "d", "Pune", None, None),
    ("Address: MH 400001", "Pune", "MH 400001", None, "Pune", "Maharashtra", "400001"),
    ("", "Pune", None, None, "Pune", None, None), (None, None, None, None, None, None, None),
    ("12 c.d. Road, c.d.", "c.d.", "12 c.d. Road", None, "c.d.", None, None),
]


def test_addresses(spark):
    df = spark.createDataFrame([(i, a[0], a[1]) for i, a in enumerate(ADDRESSES)], "i int, address string, town string")
    out = cleaning.parse_address(df, "address", "town")
    assert results(out, "street", "locality", "city", "state", "postal_code") == [a[2:] for a in ADDRESSES]
    assert {r["country"] for r in out.collect()} == {"India"}


CARDS = [
    (["Blue Door", "4.7 (1,540)", "Bakery · ₹₹ · 2 Hill Lane", "098200 12345", "Open · Closes 8 pm"],
     ("Blue Door", 4.7, 1540, "Bakery", "2 Hill Lane", "098200 12345", "Open · Closes 8 pm")),
    (["Blue Door", "5.0", "Cafe • Juhu"], ("Blue Door", 5.0, None, "Cafe", "Juhu", None, None)),
    (["Blue Door", "4.0 ★ 12 reviews", "Opens at 9", "Closed · Opens 10 am"], ("Blue Door", 4.0, 12, "Shop", None, None, "Closed · Opens 10 am")),
    (["Blue Door", "Near City Chowk", "Shop · Fort"], ("Blue Door", None, None, "Shop", "Near City Chowk", None, None)),
    (["Blue Door", "Open 098200 12345", "022 2200 1234"], ("Blue Door", None, None, "Shop", None, "022 2200 1234", "Open 098200 12345")),
    ([], (None, None, None, "Shop", None, None, None)),
]


def test_cards(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CARDS)], "i int, lines array<string>")
    out = cleaning.parse_cards(df, "lines", F.lit("Shop"))
    assert results(out, "name", "rating", "review_count", "category", "address", "phone", "opening_hours") == [c[1] for c in CARDS]


def test_contact_strategies(spark):
    rows = [
        (0, ["n", "call 98200 12345"], None, None, None, [], None),
        (1, ["n"], "tel:022 1", None, "https://www.google.com/x", ["https://a.example/"], "4.2 stars 1,200 Reviews"),
        (2, ["n"], None, "Phone: 77", "https://b.example/", [], None),
        (3, ["n", "Hill street"], None, None, None, ["https://fonts.gstatic.com/x", "/rel"], None),
    ]
    df = spark.createDataFrame(rows, "i int, lines array<string>, tel_href string, call_label string, website_href string, anchors array<string>, aria_label string")
    out = cleaning.extract_contacts(cleaning.parse_cards(df, "lines"))
    assert results(out, "phone", "phone_strategy") == [
        ("98200 12345", "card_parsed_phone"), ("022 1", "card_tel_link"), ("77", "card_call_button"), (None, "none")]
    assert results(out, "website", "website_strategy") == [
        (None, "none"), ("https://a.example/", "card_external_anchor"), ("https://b.example/", "card_website_button"), (None, "none")]
    assert results(out, "rating", "review_count")[1] == (4.2, 1200)
    assert results(out, "address", "address_strategy")[3] == ("Hill street", "card_parsed_lines")


def test_number_text(spark):
    df = column(spark, [0.0001, 19.0, -72.25, 12345678.5], "double")
    assert results(df.withColumn("t", text.number_text(F.col("v"))), "t") == ["0.0001", "19.0", "-72.25", "12345678.5"]


@pytest.mark.parametrize("link,network,profile", [
    ("https://www.instagram.com/shop/?hl=en", "instagram", "https://instagram.com/shop"),
    ("http://m.facebook.com/shop", "facebook", "https://m.facebook.com/shop"),
    ("https://wa.me/9198", "whatsapp", "https://wa.me/9198"), ("https://notinstagram.com/x", None, "https://notinstagram.com/x"),
])
def test_social_links(spark, link, network, profile):
    row = column(spark, [link]).select(web.social_network(F.col("v")), web.profile_url(F.col("v"))).first()
    assert tuple(row) == (network, profile)


def _contacts_of(spark, html):
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    rows = page_contacts(pages).collect()
    return {(r.kind, r.value, r.method) for r in rows}


def test_structured_contacts_at_any_depth(spark):
    block = ('{"@graph": [{"x": [[{"telephone": "+1 2"}]]}, {"contactPoint": {"telephone": ["3", 4], "email": "MailTo:A@B.co"}},'
             ' {"sameAs": ["https://x.com/me", "https://example.com/me"]}, {"sameAs": "https://www.facebook.com/me/"}],'
             ' "note": "\\"email\\": \\"not@this.one\\"", "email": null, "telephone": ["9", {"telephone": "5"}], "emails": "a@b.de"}')
    html = f'<script type="application/ld+json">{block}</script><script type="application/ld+json">{{"email": "open@x.de"</script>'
    assert _contacts_of(spark, html) == {
        ("phone", "+1 2", "json_ld"), ("phone", "3", "json_ld"), ("phone", "4", "json_ld"), ("phone", "5", "json_ld"),
        ("email", "a@b.co", "json_ld"), ("x", "https://x.com/me", "json_ld"), ("facebook", "https://facebook.com/me", "json_ld")}


def test_addresses_written_on_a_page(spark):
    html = ('<header>Top@a.example.com</header><style>s@a.example.com</style><p>one@a.example.com, ONE@a.example.com. two&#64;a&period;example.com'
            ' x@localhost @a.example.com</p><!-- --><footer><b>two@a.example.com</b></footer>')
    assert _contacts_of(spark, html) == {
        ("email", "top@a.example.com", "edge_text"), ("email", "two@a.example.com", "edge_text"), ("email", "one@a.example.com", "visible_text")}


def test_pages_without_or_with_very_long_text(spark):
    assert _contacts_of(spark, None) == set() and _contacts_of(spark, "") == set()
    long = "<p>" + "a" * 300_000 + " " + "b." * 100_000 + " c@" + "d." * 100_000 + ' e@f.example.com</p><script type="application/ld+json">{"n": "' + '\\"' * 100_000 + '", "l": ' + "[" * 50 + '{"email": "g@h.de"}' + "]" * 50 + "}</script>"
    assert _contacts_of(spark, long) == {("email", "e@f.example.com", "visible_text"), ("email", "g@h.de", "json_ld")}
