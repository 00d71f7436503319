"""Feed pages to review entries, on VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedfold.functions.json_text import allow_repeated_keys, document_fields, field_document, unmarked, written_json
from feedfold.sources.pages import has_next_page, page_hash

# An entry is a review when any of these keys exists.
REVIEW_KEYS = ("im:rating", "content", "author", "im:version")

# Output field and the path of its feed element.
LABELLED_FIELDS = {
    "id_raw": "$.id",
    "rating_raw": "$['im:rating']",
    "title_raw": "$.title",
    "body_raw": "$.content",
    "author_label_raw": "$.author.name",
    "author_uri_raw": "$.author.uri",
    "published_raw": "$.updated",
    "app_version_raw": "$['im:version']",
    "vote_count_raw": "$['im:voteCount']",
    "vote_sum_raw": "$['im:voteSum']",
}


def scalar_text(value: Column) -> Column:
    """Text of a variant: a number written with a fraction keeps one, so it is not read as an integer."""
    return spelled(F.schema_of_variant(value), unmarked(F.try_variant_get(value, "$", "string")))


def spelled(kind: Column, text: Column) -> Column:
    fractional = kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") & ~F.contains(text, F.lit("."))
    return F.when(fractional, F.concat(text, F.lit(".0"))).when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def label_text(entry: Column, path: str) -> Column:
    """``{"label": x}`` gives x; a bare value gives itself; an object without label gives its JSON."""
    return scalar_text(label_value(entry, path))


def label_value(entry: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(entry, f"{path}.label", "variant"), F.try_variant_get(entry, path, "variant"))


def attribute_text(entry: Column, field: str, attribute: str) -> Column:
    return unmarked(F.try_variant_get(entry, f"$.{field}.attributes.{attribute}", "string"))


def with_document(pages: DataFrame) -> DataFrame:
    """Add ``document``, whose numbers keep their spelling; of a repeated key the last one counts."""
    allow_repeated_keys(pages.sparkSession)
    fields = pages.withColumn("document_fields", document_fields("response_body"))
    return fields.withColumn("document", field_document(F.col("document_fields"))).drop("document_fields")


def entry_list(document: Column) -> Column:
    """``feed.entry`` as a list; a single object becomes a list of one, anything else is NULL."""
    path = "$.feed.entry"
    return F.coalesce(
        F.try_variant_get(document, path, "array<variant>"),
        F.when(is_single_object(document), F.array(F.try_variant_get(document, path, "variant"))))


def is_single_object(document: Column) -> Column:
    return F.coalesce(F.try_variant_get(document, "$.feed.entry", "map<string,variant>").isNotNull(), F.lit(False))


def is_review(entry: Column) -> Column:
    """True when a review key exists, even with a null value; non-objects have no keys."""
    found = F.lit(False)
    for key in REVIEW_KEYS:
        found = found | F.try_variant_get(entry, f"$['{key}']", "variant").isNotNull()
    return found


def explode_entries(pages: DataFrame) -> DataFrame:
    """One row per element of ``feed.entry`` with its position, reviews and other elements alike."""
    parsed = with_document(pages).withColumn("parser_fallback_used", is_single_object(F.col("document")))
    kept = [c for c in pages.columns if c != "response_body"]
    return parsed.select(*kept, "parser_fallback_used",
                         F.posexplode(entry_list(F.col("document"))).alias("entry_pos", "entry"))


def extract_entries(pages: DataFrame) -> DataFrame:
    """Review entries with raw text fields and their canonical JSON, one row each; no shuffle.

    Values, their kinds and texts, and the result are projections of their own, so every path is looked up once.
    """
    kept = [c for c in pages.columns if c != "response_body"]
    return _read(explode_entries(pages).filter(is_review(F.col("entry"))), kept)


def _read(exploded: DataFrame, kept: list[str]) -> DataFrame:
    entry = F.col("entry")
    values = exploded.select(
        *kept, "entry_pos", *[label_value(entry, path).alias(name) for name, path in LABELLED_FIELDS.items()],
        attribute_text(entry, "link", "href").alias("review_url_raw"), written_json(entry).alias("raw_record"), "parser_fallback_used")
    read = values.withColumns({
        **{f"{name}_kind": F.schema_of_variant(name) for name in LABELLED_FIELDS},
        **{name: unmarked(F.try_variant_get(name, "$", "string")) for name in LABELLED_FIELDS}})
    return read.select(
        *kept, "entry_pos", *[spelled(F.col(f"{name}_kind"), F.col(name)).alias(name) for name in LABELLED_FIELDS],
        "review_url_raw", "raw_record", "parser_fallback_used")


def extract_with_facts(pages: DataFrame) -> DataFrame:
    """``extract_entries`` and the page facts (without ``review_ids``) of the one parse.

    Every page has a row whose ``page`` holds its facts, that of its first element or one without an entry; ``is_entry`` tells the rows of review entries.
    """
    document, kept = F.col("document"), [c for c in pages.columns if c != "response_body"]
    parsed = with_document(pages).withColumns({"parser_fallback_used": is_single_object(document), "entries": entry_list(document)})
    facts = F.struct(page_hash().alias("response_hash"), *_counts(document, F.filter("entries", is_review)), has_next_page(document).alias("has_next"))
    listed = parsed.withColumn("page", facts)
    exploded = listed.select(*kept, "parser_fallback_used", "page", F.posexplode_outer("entries").alias("entry_pos", "entry")).withColumns({
        "is_entry": F.col("entry").isNotNull() & is_review(F.col("entry")), "page": F.when(F.coalesce("entry_pos", F.lit(0)) == 0, F.col("page"))})
    found = exploded.filter(F.col("is_entry") | F.col("page").isNotNull()).withColumn("entry", F.when(F.col("is_entry"), F.col("entry")))
    return _read(found, [*kept, "page", "is_entry"])


def _counts(document: Column, reviews: Column) -> list[Column]:
    return [document.isNotNull().alias("is_json"), F.coalesce(F.size(reviews), F.lit(0)).cast("bigint").alias("entry_count")]


def page_facts(pages: DataFrame) -> DataFrame:
    """Per page: hash, whether it parsed, its review entries and whether a next page is announced."""
    document = F.col("document")
    reviews = F.filter(entry_list(document), is_review)
    return with_document(pages).select(
        *[c for c in pages.columns if c != "response_body"],
        page_hash().alias("response_hash"),
        *_counts(document, reviews),
        F.filter(F.transform(reviews, lambda e: label_text(e, "$.id")),
                 lambda i: F.length(i) > 0).alias("review_ids"),
        has_next_page(document).alias("has_next"))
