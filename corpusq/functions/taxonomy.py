"""The three-level taxonomy as rows, text and column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq import fixed_values as fv


ROWS = [(p, d, leaf) for p, d, leaves in fv.TAXONOMY for leaf in leaves]
PRIMARIES = list(dict.fromkeys(p for p, _, _ in ROWS))
DOMAINS = list(dict.fromkeys((p, d) for p, d, _ in ROWS))


def taxonomy_table(spark: SparkSession) -> DataFrame:
    """One row per sub-domain, with its place in the taxonomy."""
    rows = [(i, PRIMARIES.index(p), DOMAINS.index((p, d)), p, d, s)
            for i, (p, d, s) in enumerate(ROWS)]
    return spark.createDataFrame(
        rows, "ordinal int, primary_no int, domain_no int, "
              "primary_name string, domain string, sub_domain string")


def taxonomy_text() -> str:
    """`- primary: [domain, domain]` lines, as the classification prompt wants them."""
    return "\n".join(
        f"- {p}: [{', '.join(d for q, d in DOMAINS if q == p)}]" for p in PRIMARIES)


def _name_words(*names: str) -> list[str]:
    """Words of hyphenated names; words under three letters carry no signal."""
    parts = [w for n in names for w in n.split("-")]
    return sorted({w for w in parts if len(w) >= 3})


def domain_words(primary: str, domain: str) -> list[str]:
    return _name_words(domain, *[s for p, d, s in ROWS if (p, d) == (primary, domain)])


def primary_words(primary: str) -> list[str]:
    return _name_words(primary, *[n for p, d, s in ROWS if p == primary for n in (d, s)])


ALL_WORDS = sorted({w for p in PRIMARIES for w in primary_words(p)})


def _literal(values: list[str]) -> Column:
    """Constant array; the names hold no commas."""
    return F.split(F.lit(",".join(values)), ",")


_TREE_TYPE = ("array<struct<ordinal:int,name:string,words:array<string>,"
              "domains:array<struct<ordinal:int,name:string,words:array<string>>>>>")


def _tree() -> Column:
    """The classifiable part of the taxonomy with its words, as one constant."""
    return F.from_json(F.lit(json.dumps([
        {"ordinal": i, "name": p, "words": primary_words(p), "domains": [
            {"ordinal": j, "name": d, "words": domain_words(p, d)}
            for j, (q, d) in enumerate(DOMAINS) if q == p]}
        for i, p in enumerate(PRIMARIES) if p != fv.DEFAULT_COLLECTION])), _TREE_TYPE)


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def suggest_labels(tokens: Column) -> Column:
    """Best primary category and its two best domains by distinct shared words.

    `tokens` should already be cut down to ALL_WORDS (see `taxonomy_tokens`), so the
    comparisons below run on short arrays. Ties go to the earlier taxonomy entry.
    """
    def label(words: Column) -> Column:
        def rank(entry: Column) -> Column:
            return (-F.size(F.array_intersect(words, entry["words"]))).alias("rank")

        def named(best: Column) -> Column:
            domains = F.transform(best["domains"], lambda d: F.struct(
                rank(d), d["ordinal"].alias("ordinal"), d["name"].alias("name")))
            top = F.slice(F.array_sort(F.filter(domains, lambda d: d["rank"] < 0)), 1, 2)
            labels = F.concat(F.array(best["name"]), F.transform(top, lambda d: d["name"]))
            return F.when(best["rank"] < 0, labels).otherwise(other)

        scored = F.transform(_tree(), lambda p: F.struct(
            rank(p), p["ordinal"].alias("ordinal"), p["name"].alias("name"),
            p["domains"].alias("domains")))
        return F.when(F.size(words) == 0, other).otherwise(_bound(F.array_min(scored), named))

    other = F.array(F.lit(fv.DEFAULT_COLLECTION))
    return _bound(tokens, label)


def taxonomy_tokens(text: Column) -> Column:
    """Distinct taxonomy words that occur in a text."""
    found = F.split(F.lower(text), r"[^a-z]+")
    return F.array_intersect(found, _literal(ALL_WORDS))
