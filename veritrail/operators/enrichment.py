"""Enrichment of records from providers' JSON, retractions, full-text lookups, model-call reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import text

#: JSON paths of the common row, by provider.
PROVIDERS = {
    "openalex": {"doi": "$.doi", "title": "$.title", "year": "$.publication_year", "pmid": "$.ids.pmid", "abstract": None},
    "europepmc": {"doi": "$.doi", "title": "$.title", "year": "$.pubYear", "pmid": "$.pmid", "abstract": "$.abstractText"},
    "crossref": {"doi": "$.message.DOI", "title": "$.message.title[0]", "year": "$.message.issued['date-parts'][0][0]", "pmid": None, "abstract": "$.message.abstract"},
    "unpaywall": {"doi": "$.doi", "title": "$.title", "year": "$.year", "pmid": None, "abstract": None},
}


def works(raw: DataFrame, provider: str) -> DataFrame:
    """raw (key, body) as (key, provider, doi, pmid, title, year, abstract), identifiers in their plain forms."""
    at = lambda name: F.get_json_object("body", PROVIDERS[provider][name]) if PROVIDERS[provider][name] else F.lit(None).cast("string")
    return raw.select("key", F.lit(provider).alias("provider"), text.canonical_doi(at("doi")).alias("doi"), text.pmid(at("pmid")).alias("pmid"), text.strip_markup(at("title")).alias("title"), at("year").try_cast("int").alias("year"), text.strip_markup(at("abstract")).alias("abstract"))


LOCATIONS = "array<struct<url_for_pdf:string,url:string,host_type:string,license:string,version:string>>"


def locations(raw: DataFrame) -> DataFrame:
    """Open locations of a body with `oa_locations`: (key, rank, url, pdf, host, licence, version)."""
    own = raw.select("key", F.posexplode(F.from_json(F.get_json_object("body", "$.oa_locations"), LOCATIONS)).alias("rank", "l"))
    return own.select("key", "rank", F.col("l.url").alias("url"), F.col("l.url_for_pdf").isNotNull().alias("pdf"), F.col("l.host_type").alias("host"), F.col("l.license").alias("licence"), F.col("l.version").alias("version"))


def retracted(updates: Column, doi: Column) -> Column:
    """updates: array of struct(kind, target): a retraction of the work itself, not one that it announces."""
    return F.exists(updates, lambda u: F.lower(u["kind"]).isin("retraction", "withdrawal") & (text.canonical_doi(u["target"]) == doi))


def merged(records: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Fields from the first provider that has them; a work with another DOI or PMID than the record is refused."""
    fields = ["doi", "pmid", "title", "year", "abstract"]
    out = records
    for i, f in enumerate(found):
        out = out.join(f.select("key", *(F.col(c).alias(f"_{i}_{c}") for c in [*fields, "provider"])), "key", "left")
    usable = []
    for i in range(len(found)):
        clash = F.lit(False)
        for c in ("doi", "pmid"):
            clash = clash | F.coalesce(F.col(c) != F.col(f"_{i}_{c}"), F.lit(False))
        usable.append(~clash)
    new = {}
    for c in fields:
        values = [F.when(u, F.col(f"_{i}_{c}")) for i, u in enumerate(usable)]
        new[c] = F.coalesce(F.col(c), *values)
        new[f"{c}_from"] = F.when(F.col(c).isNotNull(), "record").otherwise(F.coalesce(*[F.when(v.isNotNull(), F.col(f"_{i}_provider")) for i, v in enumerate(values)]))
    new["refused"] = F.array_compact(F.array(*[F.when(~u, F.col(f"_{i}_provider")) for i, u in enumerate(usable)]))
    own = out.select("key", *(v.alias(k) for k, v in new.items()))
    return own


def lookups(records: DataFrame) -> DataFrame:
    """(key, source): full-text lookups that apply to a record, by its identifiers."""
    doi = F.coalesce("doi", F.lit(""))
    source = F.array_compact(
        F.array(
            F.when(F.col("pmcid").isNotNull(), "pmc"),
            F.when(doi.startswith("10.1101/"), "biorxiv"),
            F.when(doi.rlike(r"^10\.48550/arxiv\."), "arxiv"),
            F.when(doi != "", "semanticscholar"),
            F.when(doi != "", "core"),
        )
    )
    return records.select("key", F.explode(source).alias("source"))


def prompt_cards(calls: DataFrame) -> DataFrame:
    """One card per judge configuration, stage, scope and protocol version, in the order of first use."""
    keys = ["config_hash", "stage", "scope", "protocol_hash"]
    return calls.groupBy(*keys).agg(F.min("created_at").alias("first_used"), F.count(F.lit(1)).alias("requests"), F.min_by("prompt", "created_at").alias("prompt")).orderBy("first_used", *keys)


def disclosure(stages: DataFrame, readings: DataFrame) -> DataFrame:
    """Per stage and model: items read, exclusions proposed, decisions that agree with the reading."""
    own = readings.join(stages.select("stage", "item", "outcome"), ["stage", "item"], "left")
    known = F.col("outcome").isNotNull()
    return own.groupBy("stage", "model").agg(F.countDistinct("item").alias("items"), F.count_if(F.col("proposal") == "exclude").alias("excluded"), F.try_divide(F.count_if(known & (F.col("proposal") == F.col("outcome"))), F.count_if(known)).alias("agreement"))


def extracted_values(acceptances: DataFrame, anchors: DataFrame, cutoff: int) -> DataFrame:
    """The latest acceptance of each key up to a sequence, with the quotes it rests on."""
    own = acceptances.where(F.col("event_seq") <= cutoff)
    row = F.struct(*own.columns)
    last = own.groupBy("key").agg(F.max_by(row, F.col("event_seq")).alias("r")).select("r.*")
    quotes = last.select("key", F.explode("anchor_ids").alias("anchor_id")).join(anchors.select("anchor_id", "quote"), "anchor_id").groupBy("key").agg(F.array_sort(F.collect_set("quote")).alias("quotes"))
    return last.join(quotes, "key", "left")
