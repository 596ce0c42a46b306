"""Personal data: contract patterns, and terms that reveal a protected entity (information-theoretic).

A protected entity is the value of an e-mail, address, card or phone span. Over the whole corpus, every
term of a document that names an entity is weighed by point-wise mutual information: PMI(t; e) =
log2(c(t,e) N / (df(t) df(e))), with c the documents that hold both and df document counts. IC(e) =
log2(N / df(e)) is what naming the entity would disclose, so PMI / IC is the share that the term alone
discloses. Terms at or above `threshold` in at least `least_docs` documents become spans of kind `term`,
wherever they stand in the documents of their entity: a document without an entity is never touched. In
fewer documents the counts tell nothing: each word that occurs once would disclose all of an entity that
occurs once. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm import spans as S
from leadloom.llm.common import fresh, hex_sha256, id_and_text, own_columns, stored

#: Fixed values of the contract. Possessive runs and a look behind keep each scan linear: a run that fails at its
#: first character fails at all others, and `\G` lets a match start right behind the one before.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
KINDS = ("email", "ip", "card", "phone")
#: A run of letters and digits, possessive and of any length.
TERM = r"[\p{L}\p{N}]++"

LEAST_DOCS = 3
THRESHOLD = 0.6


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    back = F.reverse(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), step) % 10 == 0


def _tests() -> list[tuple[str, str, object]]:
    between = lambda x, low, high: F.length(_digits(x)).between(low, high)
    return [
        ("email", EMAIL, None),
        ("ip", IP, lambda x: x["value"].rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")),
        ("card", CARD, lambda x: F.when(between(x["value"], 13, 19), luhn(_digits(x["value"]))).otherwise(False)),
        ("phone", PHONE, lambda x: between(x["value"], 9, 15)),
    ]


def base_spans(text: Column) -> Column:
    """array<struct<kind, rank, start, stop, value>> of the contract's four kinds."""
    found = []
    for rank, (kind, pattern, test) in enumerate(_tests()):
        hits = S.matches(text, pattern)
        hits = F.filter(hits, test) if test else hits
        found.append(F.transform(hits, _with_value(kind, rank)))
    return F.concat(*found)


def _with_value(kind: str, rank: int):
    return lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"))


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One scan of the texts: doc_id, text_key and base spans of every row, and of rows with an entity the text
    outside them (`rest`, same places) with its terms, as a stored table."""
    rows = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text")).withColumn("base", base_spans(F.col("text")))
    named = rows.withColumn("rest", F.when(F.size("base") > 0, S.blanked(F.col("text"), F.col("base"))))
    return stored(named.select("doc_id", "text_key", "base", "rest", _terms(F.col("rest")).alias("near")), "personal-data")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _entities() -> Column:
    return F.array_distinct(F.transform("base", lambda x: F.lower(x["value"])))


def disclosing_terms(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, threshold: float = THRESHOLD
) -> DataFrame:
    """(entity, term, disclosure) of all terms that disclose at least `threshold` of an entity's information.

    Counts cover all rows: c, df(t), df(e) and N count rows of the table. Terms are letters and digits, lower case.
    """
    return _disclosing(docs, _scanned(docs, id_col, text_col), text_col, least_docs, threshold)


def _disclosing(docs: DataFrame, scanned: DataFrame, text_col: str, least_docs: int, threshold: float) -> DataFrame:
    n_docs = F.lit(scanned.count())
    # a document counts once for a pair: its repeats are taken out inside the document, without a shuffle
    df_term = docs.select(F.explode(_terms(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df_term"))
    holding = scanned.filter(F.size("base") > 0)
    named = holding.select("doc_id", "text_key", F.explode(_entities()).alias("entity"))
    df_entity = named.groupBy("entity").agg(F.count("*").alias("df_entity")).filter(F.col("df_entity") >= least_docs)
    # an entity in fewer rows reaches no pair in enough of them; what meets by entity is keys, what meets by row is terms
    known = named.join(df_entity.select("entity"), "entity").groupBy("doc_id", "text_key").agg(F.collect_set("entity").alias("entities"))
    near = _of_rows(holding.select("doc_id", "text_key", "near"), known)
    once = near.select(F.explode("entities").alias("entity"), "near").select("entity", F.explode("near").alias("term"))
    pairs = once.groupBy("entity", "term").agg(F.count("*").alias("both")).filter(F.col("both") >= least_docs)
    joined = pairs.join(df_entity, "entity").join(df_term, "term")
    information = F.log2(n_docs / F.col("df_entity"))
    pmi = F.log2(F.col("both") * n_docs / (F.col("df_term") * F.col("df_entity")))
    share = F.when(information > 0, pmi / information).otherwise(0.0)
    return joined.select("entity", "term", share.alias("disclosure")).filter(F.col("disclosure") >= threshold)


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, text_key, `base` spans and `terms` spans (array<struct<kind, rank, start, stop>>) per input row.

    Null text counts as empty; a null id stays null; rows that repeat id and text share their spans; an empty
    table gives an empty one; other columns are left out. Only texts of entities with disclosing terms are shuffled.
    """
    scanned = _scanned(docs, id_col, text_col)
    terms = _disclosing(docs, scanned, text_col, least_docs, threshold)
    told = terms.groupBy("entity").agg(F.collect_set("term").alias("told"))
    holding = scanned.filter(F.size("base") > 0)
    named = holding.select("doc_id", "text_key", F.explode(_entities()).alias("entity")).join(told, "entity")
    known = named.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_set("told"))).alias("told"))
    merged = _of_rows(holding.select("doc_id", "text_key", "rest"), known)
    # places of the words are running sums of the lengths of words and of what is between them
    pieces = F.arrays_zip(F.split("rest", TERM, -1).alias("piece"), F.regexp_extract_all("rest", F.lit(TERM), F.lit(0)).alias("value"))
    words = merged.select("doc_id", "text_key", F.posexplode(pieces).alias("at", "x")).select("doc_id", "text_key", "at", "x.*")
    stop = F.sum(F.length("piece") + F.coalesce(F.length("value"), F.lit(0))).over(Window.partitionBy("doc_id", "text_key").orderBy("at")).cast("int")
    placed = words.withColumn("stop", stop).filter("value is not null").withColumn("start", F.col("stop") - F.length("value")).withColumn("term", F.lower("value"))
    sought = merged.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_tk"), F.explode("told").alias("_term"))
    at = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_tk")) & (F.col("term") == F.col("_term"))
    span = F.struct(F.lit("term").alias("kind"), F.lit(len(KINDS)).alias("rank"), "start", "stop")
    grouped = placed.join(sought, at).groupBy("doc_id", "text_key").agg(F.collect_set(span).alias("terms"))
    left, right = scanned.drop("near", "rest").alias("a"), grouped.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    return left.join(right, same, "left").select("a.doc_id", "a.text_key", "a.base", F.coalesce("b.terms", S.no_spans()).alias("terms"))


def _of_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` (doc_id, text_key, ..) with what is known of their keys, one row for repeats of id and text."""
    one = rows.dropDuplicates(["doc_id", "text_key"])
    right = known.withColumnsRenamed({"doc_id": "_id", "text_key": "_tk"})
    return one.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_tk"))).drop("_id", "_tk")


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["rank"].alias("rank"), x["start"].alias("start"), x["stop"].alias("stop")))


def personal_data_report(docs: DataFrame, **options) -> DataFrame:
    """Counts per kind, the digest of the base spans, and all spans."""
    found = find_personal_data(docs, **options).withColumn("base", _plain(F.col("base")))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.concat("base", "terms")
    return found.select("doc_id", *[count(k) for k in KINDS], hex_sha256(S.joined_by_kind(F.col("base"))).alias("base_sha256"), S.joined_by_kind(every).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with the spans in its text column generalised to their kind in angle brackets; same columns.

    Only rows with an entity can change, so only they are shuffled to meet their term spans. Columns other than
    id and text may have any name and pass as they are.
    """
    key_text, base, own_id, own_key, terms = fresh(docs, "_key_text", "_base", "_id", "_tk", "_terms")
    keyed = docs.withColumns({key_text: F.coalesce(F.col(text_col), F.lit("")), base: base_spans(F.coalesce(F.col(text_col), F.lit("")))})
    clean, touched = keyed.filter(F.size(base) == 0), keyed.filter(F.size(base) > 0)
    found = find_personal_data(docs, id_col, text_col, **options).filter(F.size("terms") > 0).dropDuplicates(["doc_id", "text_key"])
    found = found.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), F.col("terms").alias(terms))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(key_text) == F.col(own_key))
    met = touched.join(found, same, "left")
    every = F.concat(_plain(F.col(base)), F.coalesce(terms, S.no_spans()))
    changed = met.withColumn(text_col, S.replaced(F.col(key_text), every))
    return clean.select(own_columns(docs)).unionByName(changed.select(own_columns(docs)))
