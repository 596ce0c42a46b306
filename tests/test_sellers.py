from pyspark.sql import functions as F

from leadloom.functions.user_code import run_adapter, run_extractor
from leadloom.operators import sellers as S

PAGE = """<html><script>{"x":1,"__typename":"GraphqlMarketplaceSeller","id":"77","name":"Shop &amp; Co","rating":4.2,"visibleReviewsCount":9,
"contactInfoForCustomers":{"email":"hi@shop.nl","phone":""},"legalInformation":{"imprint":"<p>KvK: 1234-A BTW NL99B</p>"}},"y":{"optimizelyDataFile":1}}</script>
<h1>Heading</h1><a href="tel:+31 6 1">call</a><dl><dt>Plaats</dt><dd>Ede</dd><dt>Postcode:</dt><dd>1234 AB</dd></dl></html>"""


def test_page_with_embedded_seller(spark):
    missing = "<h1>Helaas kan de verkoper niet worden gevonden</h1>"
    plain = '<h1>Plain <b>Ltd</b></h1><dl><dt>E-mail</dt><dd>x@plain.de</dd></dl><a href="tel:undefined">c</a>'
    df = spark.createDataFrame([(1, PAGE), (2, missing), (3, plain)], "seller_id long, html string")
    rows = {r.seller_id: r for r in S.seller_from_page(df).collect()}
    assert set(rows) == {1, 3}
    a, b = rows[1], rows[3]
    assert (a.business_name, a.email, a.phone, a.rating, a.rating_out_of, a.review_count) == ("Shop &amp; Co", "hi@shop.nl", "+31 6 1", 4.2, 5.0, 9)
    assert (a.city, a.zip_code, a.kvk_number, a.vat_number) == ("Ede", "1234 AB", "1234-A", "NL99B")
    assert (b.business_name, b.email, b.phone, b.rating, b.rating_out_of) == ("Plain Ltd", "x@plain.de", "", None, None)


def test_object_cut_knows_strings(spark):
    cases = {'{"a":"}","b":2} rest }': '{"a":"}","b":2}', '{"a":"\\\\","b":{"c":"{"}},x': '{"a":"\\\\","b":{"c":"{"}}', '{"a":"\\"}"}z': '{"a":"\\"}"}', '{"open":1': None, "": None}
    got = spark.createDataFrame(list(cases.items()), "t string, want string").withColumn("got", S._balanced_object(F.col("t"))).collect()
    assert all(r.got == r.want for r in got), got


def test_api_without_attributes(spark):
    df = spark.createDataFrame([(1, '{"errors":[]}', "u")], "seller_id long, body string, url string")
    r = S.seller_from_api(df).first()
    assert (r.business_name, r.registered_address, r.source_url) == ("", "", "u")


def test_user_code_never_fails_the_job(spark):
    raw = spark.createDataFrame([(1, "a", "u"), (2, "", "u"), (3, None, "u")], "seller_id long, raw string, url string")
    out = run_adapter(raw, lambda text, key, url: {"n": text.upper(), "k": key}, lambda p: not p["n"])
    got = {r.seller_id: (r.status, r.result) for r in out.collect()}
    assert got[1] == ("ok", {"n": "A", "k": "1"}) and got[2] == ("empty", None) and got[3][0] == "error"
    pages = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "page_id long, html string")
    made = run_extractor(pages, lambda h: [{"a": [1], "b": None}, {}, 5] if h == "x" else 1 / 0 if h == "y" else {"no": "list"})
    assert [(r.page_id, r.item) for r in made.collect()] == [(1, {"a": "[1]", "b": None})]
