import duckdb
import pytest
from pyspark.sql import functions as F

from leadloom.functions import nested as N
from leadloom.functions import text as X
from leadloom.functions import urls as U
from leadloom.plans.registry import BUILDS, SQL, Tables


@pytest.mark.parametrize("raw,want", [(" a ", "a"), (" NaN\t", None), ("N/A", None), ("", None), (None, None), ("null", None), ("nullx", "nullx")])
def test_clean_str(value, raw, want):
    assert value(X.clean_str("c"), c=raw) == want if raw is not None else value(X.clean_str(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("raw,want", [("1e3", 1000.0), (" 4.5 ", 4.5), ("nan", None), ("1.5f", None), ("12d", None), ("0x10", None), ("abc", None), ("inf", float("inf")), ("-inf", float("-inf"))])
def test_clean_float(value, raw, want):
    assert value(X.clean_float("c"), c=raw) == want


@pytest.mark.parametrize("raw,want", [("-3.7", -3), ("12.9", 12), ("inf", None), ("1e30", None), ("x", None)])
def test_clean_int(value, raw, want):
    assert value(X.clean_int("c"), c=raw) == want


@pytest.mark.parametrize("x,digits", [(0.245, 2), (0.225, 2), (0.125, 2), (0.375, 2), (0.0005, 3), (12.0, 2), (0.9999, 3), (0.0625, 3), (3.14159, 3), (0.3, 1), (7.5, 1)])
def test_fixed_text_matches_python(value, x, digits):
    assert value(X.fixed_text(F.lit(x), digits)) == f"{x:.{digits}f}"


def test_text_cleaning(value):
    assert value(X.clean_text("c"), c="<b>A</b>\n x&nbsp;y a\\u002Fz ") == "A x y a/z"
    assert value(X.decode_entities("c"), c="&amp;lt; &#39;") == "< '"
    assert value(X.strip_tags_keep_lines("c"), c="<p>a</p><SCRIPT>x\ny</SCRIPT><br/>b<i>c</i>") == " a\n\n\nb c "


def test_emails(value):
    text = "write to Sales@Acme.com, noreply@acme.com or x@example.com; b@c.de"
    assert value(X.extract_emails("c"), c=text) == ["Sales@Acme.com", "b@c.de"]
    assert value(X.extract_emails("c", ["ACME"]), c=text) == ["b@c.de"]
    assert value(X.extract_emails("c"), c="nothing") == []


def test_contact_patterns(value):
    assert value(X.extract_phone("c"), c="Tel: +49 (0)30 12/34 x") == "+49 (0)30 12/34"
    assert value(X.extract_fax("c"), c="no") is None
    assert value(X.looks_like_vat("c"), c="NL 123456789") and not value(X.looks_like_vat("c"), c="NL1234")
    r = value(X.parse_rating("c"), c='aria-label="Beoordeling: 4.5 van de 5 sterren op basis van 12 recensies"')
    assert (r["rating"], r["out_of"], r["count"]) == (4.5, 5.0, 12)
    r = value(X.parse_rating("c", F.lit(3.0), F.lit(7)), c="none")
    assert (r["rating"], r["out_of"], r["count"]) == (3.0, 5.0, 7)


def test_addresses(value):
    assert tuple(value(X.split_address_line("c"), c="12345 Bad City , LAND")) == ("12345", "Bad City", "LAND")
    assert tuple(value(X.split_address_line("c"), c="City, A, B")) == ("City,", "A", "B")
    assert tuple(value(X.split_address_line("c"), c="City")) == (None, "City", None)
    assert tuple(value(X.address_block("c"), c=["", "Main 1", "Phone: 3", "1000 X", "Land"])) == ("Main 1", "1000", "X", "Land")
    assert tuple(value(X.split_hall_booth("c"), c="Hall 10 / E40")) == ("10", "E40")
    assert tuple(value(X.split_hall_booth("c"), c="Hall 5, Stand A20")) == ("5", "A20")
    assert tuple(value(X.split_city_country("c"), c="Berlin, Germany")) == ("Berlin", "Germany")


def test_slug_and_size(value):
    assert value(X.slugify("c"), c="Ärzte & Co_ 2!") == "ärzte-co-2"
    assert value(X.slugify("c"), c="!!") == "untitled"
    assert value(X.org_size("c"), c="about 5,200+ Employees") == "Enterprise"
    assert value(X.org_size("c"), c="team of 250 people") == "Mid-Market"
    assert value(X.org_size("c"), c="99 staff") == ""


def test_flatten_json(value):
    doc = '{"id":1,"contact":{"email":"x@y.com","deep":{"a":null}},"tags":["a","b"],"odd":"{not json","same.x":"1","same":{"x":"2"}}'
    assert value(N.flatten_json("c"), c=doc) == {
        "id": "1", "contact.email": "x@y.com", "contact.deep.a": None, "tags": '["a","b"]', "odd": "{not json", "same.x": "2",
    }


def test_item_lists(value):
    assert value(N.json_path_items("c", "a.b"), c='{"a":{"b":[{"x":1},2,"{s}"]}}') == ['{"x":1}']
    assert value(N.json_path_items("c", "a"), c='{"a":{"b":1}}') == ['{"b":1}']
    assert value(N.json_path_items("c", "z"), c='{"a":1}') == []
    f = value(N.find_items_list("c"), c='{"foo":[{"a":1},{"a":2},{"a":3}],"results":[1]}')
    assert f["path"] == "foo" and len(f["items"]) == 3
    assert value(N.unwrap_api_items("c"), c='{"data":[]}') == ['{"data":[]}']


def test_maps(value):
    p = value(N.promote_aliases("m"), m={"name": " ", "Exhibitor_Name": "Acme", "email": "a@b.c", "contact.email": "other"})
    assert p["name"] == "Acme" and p["email"] == "a@b.c"
    assert value(N.extract_prefixed("m", "social_"), m={"social_x": " u ", "social_y": "NaN", "z": "1"}) == {"x": "u"}
    assert value(N.find_by_labels("m", ["City", "Ort"]), m={"Stadt / Ort:": "B", "CITY-": "A"}) == "A"
    assert value(N.find_by_labels("m", ["Ort"]), m={"Stadt / Ort:": "B"}) == "B"
    assert value(N.select_nonempty("m", ["a", "b"]), m={"a": "N/A", "b": "nan"}) is None
    assert value(N.drop_internal_fields("m"), m={"_a": "1", "b": "2"}) == {"b": "2"}


def test_urls(value):
    base = "https://h.example.com/a/b?x=1"
    for href, want in [("/z", "https://h.example.com/z"), ("c", "https://h.example.com/a/c"), ("../../c?q", "https://h.example.com/c?q"),
                       ("?p=2", "https://h.example.com/a/b?p=2"), ("", base), ("https://o/p", "https://o/p")]:
        assert value(U.resolve_url(F.lit(base), F.lit(href))) == want
    for u, ok in [("http://10.0.0.1/", False), ("http://172.32.0.1/", True), ("https://[fe80::1]/", False), ("ftp://a", False), ("https://a.b:99", True)]:
        assert value(U.url_allowed_scheme(F.lit(u))) is ok
    assert value(U.domain_key(F.lit("https://A.com/x/"))) == value(U.domain_key(F.lit("http://a.com/x?q=1")))
    assert value(U.id_from_href(F.lit("/floorplan?action=show&actionItem=3043124&_event=beauty2026"))) == "beauty2026.3043124"
    assert value(U.id_from_href(F.lit("/exhibitors/12345/profile"))) == "12345"
    assert value(U.id_from_href(F.lit("/about"))) is None
    assert value(U.clean_api_id(F.lit("profile=b.1"))) == "b.1"


def test_allowed_scheme_of_any_user_id(spark, tmp_path):
    # sf0.01 has no user beyond 149; 240 to 255 are reserved as first numbers of an address
    spark.range(0, 8 * 300).selectExpr("id AS event_id", "id DIV 8 AS user_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.user_id, r.event_id): r.ok for r in BUILDS["url3_url_allowed_scheme"](Tables(spark, str(tmp_path))).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == {(u, e): ok for u, e, ok in con.execute(SQL["url3_url_allowed_scheme"]).fetchall()}


def test_reserved_addresses_are_refused(value):
    for first, ok in [(239, True), (240, False), (255, False), (256, True)]:
        assert value(U.url_allowed_scheme(F.lit(f"http://{first}.1.1.1/"))) is ok


def test_headers(value):
    assert value(U.parse_link_header(F.lit('<https://a?p=2>; rel="next", <bad>, <https://a?p=9>; rel="last"'))) == {"next": "https://a?p=2", "last": "https://a?p=9"}
    f = value(U.response_facts("h"), h={"content-type": "Text/HTML; charset=x", "retry-after": "soon", "x-rate-limit-remaining": "5"})
    assert (f["content_type"], f["is_html"], f["is_json"], f["retry_after"], f["rate_limit_remaining"]) == ("text/html", True, False, None, 5)


def test_paging(value):
    urls = ["https://x/l?start=0&c=a", "https://x/l?start=20&c=a"]
    out = value(U.expand_pages(F.array(*[F.lit(u) for u in urls]), F.lit(65)))
    assert out == [*urls, "https://x/l?start=40&c=a", "https://x/l?start=60&c=a", "https://x/l?start=80&c=a"]
    assert value(U.expand_pages(F.array(*[F.lit(u) for u in urls]), F.lit(10))) == urls
    assert value(U.expand_pages(F.array(*[F.lit(u) for u in urls]), F.lit(10**9), 7))[-1].startswith("https://x/l?start=120")
