"""Seller rows from marketplace responses and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.nested import find_by_labels
from leadloom.functions.text import (
    clean_text, extract_emails, first_nonplaceholder, first_match, join_nonempty, parse_imprint, parse_rating, trim_ws,
)
from leadloom.operators.filters import not_found_page
from leadloom.operators.pages import dt_dd_pairs

# Address parts of a seller response, label texts per field.
ADDRESS_PARTS = ["street1", "street2", "city", "state", "postCode", "country"]
EMAIL_LABELS = ["E-mailadres", "Email address", "E-Mail-Adresse", "Email", "E-mail"]
COMPANY_LABELS = ["Officiële bedrijfsnaam", "Official company name", "Offizieller Firmenname", "Firmenname"]
ADDRESS_LABELS = ["Kantooradres", "Office address", "Geschäftsadresse", "Adresse"]
ZIP_LABELS = ["Postcode", "ZIP code", "Postleitzahl", "PLZ"]
CITY_LABELS = ["Plaats", "City", "Stadt", "Ort"]
KVK_LABELS = ["Kamer van Koophandel nummer", "Chamber of Commerce number", "Handelskammernummer"]
VAT_LABELS = ["BTW-nummer", "VAT number", "USt-IdNr", "Umsatzsteuer-Identifikationsnummer"]
SELLER_BLOCK_RE = (
    r'(?s)("__typename"\s*:\s*"GraphqlMarketplaceSeller"\s*,\s*"id"\s*:\s*"\d+"\s*,\s*"name"\s*:\s*"[^"]*".*?)'
    r'(?="optimizelyDataFile"|"__typename"\s*:\s*"(?!Graphql))'
)


def seller_from_api(raw: DataFrame, seller_id: str = "seller_id", body: str = "body", url: str = "url") -> DataFrame:
    """Seller API response (JSON text) -> seller row; placeholder corporate addresses give way to the contact address."""
    at = lambda path: F.coalesce(F.get_json_object(body, f"$.data.attributes.{path}"), F.lit(""))
    parts = lambda block: [at(f"{block}.{p}") for p in ADDRESS_PARTS]
    chosen = first_nonplaceholder(parts("corporateContactInformation"), parts("contactInformation"))
    name = F.coalesce(F.nullif(at("corporateName"), F.lit("")), at("sellerName"))
    return raw.select(
        F.col(seller_id), trim_ws(name).alias("business_name"), trim_ws(at("taxIdentificationNumber")).alias("vat_number"),
        join_nonempty([F.get(chosen, F.lit(i)) for i in range(len(ADDRESS_PARTS))]).alias("registered_address"),
        trim_ws(at("shippingCountry")).alias("shipped_from"), F.col(url).alias("source_url"),
    )


def _balanced_object(text: Column) -> Column:
    """Leading JSON object of a text that may have more behind it, in one pass over its braces, quotes and
    backslashes: braces inside JSON strings do not count."""
    zero = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(None).cast("int").alias("end")
    )

    def step(s: Column, piece: Column) -> Column:
        # a piece ends with the one character that counts; a backslash escapes it only if nothing stands between
        ch, i = F.right(piece, F.lit(1)), s["i"] + F.length(piece)
        plain, escaped = ~s["quoted"], s["escaped"] & (F.length(piece) == 1)
        depth = s["depth"] + F.when(plain & (ch == "{"), 1).when(plain & (ch == "}"), -1).otherwise(0)
        closed = F.when(plain & (ch == "}") & (depth == 0), i)
        return F.struct(
            i.alias("i"), depth.alias("depth"), F.when((ch == '"') & ~escaped, plain).otherwise(s["quoted"]).alias("quoted"),
            (s["quoted"] & ~escaped & (ch == "\\")).alias("escaped"), F.coalesce(s["end"], closed).alias("end"),
        )

    pieces = F.regexp_extract_all(text, F.lit(r'[^{}"\\]*+[{}"\\]'), F.lit(0))
    end = F.aggregate(pieces, zero, step, lambda s: s["end"])
    return F.when(end.isNotNull(), F.left(text, end))


def seller_from_page(pages: DataFrame, seller_id: str = "seller_id", html: str = "html", shop_emails: Sequence[str] = ()) -> DataFrame:
    """Seller page -> seller row: embedded JSON first, then definition lists and patterns.

    E-mail addresses that contain one of `shop_emails` belong to the shop and are passed over."""
    h = F.col(html)
    # most pages carry no embedded seller: the look-ahead search runs only where its name occurs
    block = F.when(F.contains(h, F.lit("GraphqlMarketplaceSeller")), F.regexp_extract(h, SELLER_BLOCK_RE, 1)).otherwise("")
    base = pages.select(seller_id, html).withColumn(
        "_json", F.when(block != "", _balanced_object(F.concat(F.lit("{"), block)))
    ).withColumn("_pairs", dt_dd_pairs(h))
    j = lambda path: F.get_json_object("_json", f"$.{path}")
    pairs = F.col("_pairs")
    name = F.coalesce(F.nullif(j("name"), F.lit("")), clean_text(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1)))
    label = lambda labels: F.nullif(find_by_labels(pairs, labels), F.lit(""))
    by_label = F.coalesce(*[
        F.when(F.contains(F.element_at(pairs, F.lit(x)), F.lit("@")), F.element_at(pairs, F.lit(x))) for x in EMAIL_LABELS
    ])
    email = F.coalesce(
        F.nullif(j("contactInfoForCustomers.email"), F.lit("")), by_label, F.get(extract_emails(h, list(shop_emails)), F.lit(0))
    )
    tel = first_match(h, r"""href=["']tel:([^"']+)["']""")
    phone = F.coalesce(
        F.nullif(j("contactInfoForCustomers.phone"), F.lit("")), F.when(~tel.isin("", "undefined", "null"), tel)
    )
    rating = parse_rating(h, j("rating").try_cast("double"), j("visibleReviewsCount").try_cast("bigint"))
    imprint = parse_imprint(j("legalInformation.imprint"))
    text = lambda c: F.coalesce(c, F.lit(""))
    # made by a generator: the filter cannot move below it, so that a row is worked out once and where it was dealt to
    rows = base.select(F.inline(F.array(F.struct(
        F.col(seller_id), name.alias("business_name"), text(email).alias("email"), text(phone).alias("phone"),
        rating["rating"].alias("rating"),
        F.when(rating["rating"].isNotNull() | F.col("_json").isNotNull(), rating["out_of"]).alias("rating_out_of"),
        rating["count"].alias("review_count"),
        text(label(COMPANY_LABELS)).alias("company_name"), text(label(ADDRESS_LABELS)).alias("address"),
        text(label(ZIP_LABELS)).alias("zip_code"), text(label(CITY_LABELS)).alias("city"),
        text(F.coalesce(label(KVK_LABELS), imprint["kvk"])).alias("kvk_number"),
        text(F.coalesce(label(VAT_LABELS), imprint["vat"])).alias("vat_number"),
        not_found_page(name, h).alias("_missing"),
    ))))
    return rows.filter(~F.col("_missing") & (F.col("business_name") != "")).drop("_missing")
