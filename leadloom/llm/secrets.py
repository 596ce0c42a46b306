"""Secret scans: trigram index over the documents, Boolean trigram queries from the rules, verification.

Each regex is turned into a Boolean query over trigrams that every match must hold. The index keeps, for
each document, the postings of all trigrams that some rule asks for, as one bit per trigram beside the
document; intersecting postings is a bitwise comparison with the masks of a query, in the same scan, so
that texts are never shuffled to meet a list of candidates. Only candidates are verified by the regex. A
rule without a mandatory trigram (plain hex runs) verifies every text. Everything is DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm import spans as S
from leadloom.llm.common import hex_sha256, id_and_text

try:
    from re import _parser as sre
except ImportError:  # pragma: no cover
    import sre_parse as sre


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `pattern` finds leftmost non-overlapping matches; `part` and `least` drop those whose
    capture group is shorter than `least` characters. `pattern` must keep its meaning in Java and Python."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 0


#: Fixed values of the contract. Runs that are too short hold no longer run inside, so their least length stands in the pattern.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Spans that the method adds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES
#: Alternatives that are spelled out before a run of literals is closed.
MAX_STRINGS = 32


def _grams(texts: set[str]) -> frozenset[frozenset[str]] | None:
    """Any of the alternatives, each a set of trigrams that must all be there; None: no demand."""
    alternatives = {frozenset(t[i : i + 3].lower() for i in range(len(t) - 2)) for t in texts}
    return None if frozenset() in alternatives else frozenset(alternatives)


def trigram_query(pattern: str) -> list[frozenset[frozenset[str]]]:
    """AND over the list of OR over alternatives of AND over lower-case trigrams; [] for no demand."""
    demands: list[frozenset[frozenset[str]]] = []

    def close(current: set[str]) -> set[str]:
        if (query := _grams(current)) is not None:
            demands.append(query)
        return {""}

    def fixed(node) -> set[str] | None:
        """All strings of a node that has few of them."""
        op, arg = node
        name = str(op)
        if name == "LITERAL":
            return {chr(arg)}
        if name == "SUBPATTERN":
            return strings(arg[-1])
        if name == "BRANCH":
            parts = [strings(x) for x in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if name == "MAX_REPEAT" and arg[:2] == (0, 1):
            inner = strings(arg[2])
            return None if inner is None else inner | {""}
        return None

    def strings(nodes) -> set[str] | None:
        found = {""}
        for node in nodes:
            more = fixed(node)
            if more is None or len(found) * len(more) > MAX_STRINGS:
                return None
            found = {a + b for a in found for b in more}
        return found

    current = {""}
    for node in sre.parse(pattern):
        more = fixed(node)
        if more is None or len(current) * len(more) > MAX_STRINGS:
            current = close(current)
            if more is not None and len(more) <= MAX_STRINGS:
                current = more
            continue
        current = {a + b for a in current for b in more}
    close(current)
    return demands


class TrigramIndex:
    """Postings of the rules' trigrams, one bit per trigram and document."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.queries = {r.kind: trigram_query(r.pattern) for r in rules}
        self.grams = sorted({g for q in self.queries.values() for either in q for every in either for g in every})
        if len(self.grams) > 63 * 64:
            raise ValueError("too many trigrams for one index")

    def postings(self, low: Column) -> Column:
        """array<long>: bit i of word i // 63 is set if the lower-case text holds trigram i."""
        words = []
        for at in range(0, len(self.grams), 63):
            bits = [F.when(F.contains(low, F.lit(g)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, g in enumerate(self.grams[at : at + 63])]
            words.append(sum(bits[1:], bits[0]))
        return F.array(*words) if words else F.array().cast("array<bigint>")

    def candidate(self, postings: Column, kind: str) -> Column:
        """Whether the document's postings satisfy the rule's trigram query."""
        def every(grams: frozenset[str]) -> Column:
            masks: dict[int, int] = {}
            for g in grams:
                i = self.grams.index(g)
                masks[i // 63] = masks.get(i // 63, 0) | 1 << i % 63
            tests = [F.get(postings, F.lit(w)).bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long") for w, m in sorted(masks.items())]
            return _all(tests)

        return _all([_any([every(g) for g in sorted(either, key=sorted)]) for either in self.queries[kind]])


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _long_enough(rule: Rule):
    return lambda x: F.length(F.regexp_extract(x["value"], rule.pattern, rule.part)) >= rule.least


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and `found`: array<struct<kind, rank, start, stop>> over the whole text, one row per input row.

    Null text counts as empty (no spans); a null id stays null; repeated rows are each scanned; an empty
    table gives an empty one; other columns are left out, whatever their names.
    """
    index = TrigramIndex(rules)
    rows = id_and_text(docs, id_col, text_col).withColumn("low", F.lower("text")).withColumn("postings", index.postings(F.col("low")))
    found = []
    for rank, rule in enumerate(rules):
        hits = S.matches(F.col("text"), rule.pattern)
        if rule.least:
            hits = F.filter(hits, _long_enough(rule))
        spans = S.tagged(hits, rule.kind, rank)
        found.append(F.when(index.candidate(F.col("postings"), rule.kind), spans).otherwise(S.no_spans()))
    return rows.select("doc_id", "text", F.concat(*found).alias("found"))


def redact_secrets(docs: DataFrame, **options) -> DataFrame:
    """doc_id and the text with every secret replaced by its kind in angle brackets."""
    found = find_secrets(docs, **options)
    return found.select("doc_id", S.replaced(F.col("text"), F.col("found")).alias("text"))


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans."""
    found = find_secrets(docs, rules)
    kinds = [r.kind for r in base]
    first = F.filter("found", lambda x: x["kind"].isin(kinds))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in kinds], hex_sha256(S.joined_by_start(first)).alias("base_sha256"), S.joined_by_start(F.col("found")).alias("spans"))


def check_pattern(rule: Rule) -> None:
    """Reject a pattern that can match nothing at all."""
    if re.compile(rule.pattern).match(""):
        raise ValueError(f"rule {rule.kind} matches the empty text")
