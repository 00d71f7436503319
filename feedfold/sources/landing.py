"""The driver's tables seen as a review feed.

Every document is a review of one feed (app x storefront), enriched by the event with the same
number, and is observed in up to three ingestion runs. Each document takes part with its whole text,
in the body or, where the body is blank or short, in the title; a document's arrival class says which runs see it, so runs overlap like a moving feed window.
``entries`` yields parsed entries directly; ``raw_pages`` yields the same entries as landed JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedfold.functions import json_text
from feedfold.sources.lexicon import BROAD_TERMS, ISSUE_SIGNALS
from feedfold.sources.pages import page_rows

PLATFORM = "app_store"
RUNS = (1, 2, 3)
PAGE_ENTRIES = 250
ENDPOINT = "https://feed.example"
NO_EVENT_TIME = "2026-01-01 00:00:00"

# Sentences added per event type so that the issue terms occur, in known places.
EVENT_SENTENCES = {
    "error": " It crashes after the latest   version.",
    "purchase": " Charged twice, I want a REFUND.",
    "signup": " Cannot log  in to my account.",
    "click": " Too many ads; the menu is difficult to use.",
    "view": " Good service, order delivered.",
}
# Sentiment words added by doc_id % 7.
SENTIMENT_WORDS = {3: " A great one!", 5: " Simply (terrible).", 6: " great but awful"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    app_no = F.substring("source", 4, 10).cast("bigint") % 10
    lang_no = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), F.col("lang")), F.lit(0))
    # Events grow with the documents, so this is a sort-merge join at any size: it spills, and it
    # spreads the text work even when the documents arrive as one file. Events only enrich: a
    # document without one takes part with the defaults below.
    n_chars = F.coalesce("n_chars", F.char_length("text"), F.lit(0))
    return docs.join(events.hint("merge"), docs.doc_id == events.event_id, "left").select(
        "doc_id", "text", n_chars.alias("n_chars"), F.col("lang").alias("storefront"),
        app_no.alias("app_no"), lang_no.cast("bigint").alias("lang_no"),
        F.concat(F.lit("app-"), app_no).alias("source_app_id"),
        F.coalesce(F.col("ts").cast("timestamp"), F.lit(NO_EVENT_TIME).cast("timestamp")).alias("ts"),
        F.coalesce("user_id", "doc_id").alias("user_id"), F.coalesce("event_type", F.lit("none")).alias("event_type"),
        F.coalesce(F.floor("value"), F.lit(0)).alias("votes"),
        F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")).alias("k"),
        ((F.col("doc_id") * 31 + n_chars) % 10).alias("arrival"))


def _observed(docs: DataFrame) -> DataFrame:
    run = F.explode(F.filter(
        F.array(*[F.lit(r).cast("bigint") for r in RUNS]),
        lambda r: F.col("arrival").between(r - 1, 4 + 2 * r))).alias("run_id")
    seen = docs.select("*", run)
    single = F.col("doc_id") % 41 == 7
    return seen.withColumns({
        "app_order": F.col("app_no") * 8 + F.col("lang_no"),
        "parser_fallback_used": single,
        "page_number": F.when(single, 1_000_000 + F.col("doc_id")).otherwise(
            F.floor(F.col("doc_id") / PAGE_ENTRIES) + 1),
        "entry_pos": F.when(single, F.lit(0)).otherwise(F.col("doc_id") % PAGE_ENTRIES).cast("bigint"),
        "page_is_json": ~(single & (F.col("run_id") == 3) & (F.col("doc_id") % 5 == 3)),
        "fetched_at": F.timestamp_add("MINUTE", F.col("app_order"), F.timestamp_add(
            "DAY", F.col("run_id"), F.lit("2026-01-01").cast("timestamp"))),
    })


def _one_of(doc_mod: Column, values: dict[int, str]) -> Column:
    chosen = F.lit("")
    for remainder, text in values.items():
        chosen = F.when(doc_mod == remainder, F.lit(text)).otherwise(chosen)
    return chosen


def _raw_fields(observed: DataFrame) -> DataFrame:
    doc, run = F.col("doc_id"), F.col("run_id")
    defect, spacing, short = doc % 37, doc % 6, doc % 19 == 4
    rating = 1 + (doc * 7 + F.col("n_chars")) % 5
    rating = F.when((run >= 2) & (doc % 13 == 4), 1 + rating % 5).otherwise(rating).cast("string")
    padded = (F.when(spacing == 1, F.concat(F.lit("\t  "), F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("  \n")))
              .when(spacing == 2, F.replace("text", F.lit(". "), F.lit(".  \t")))
              .when(spacing == 3, F.replace("text", F.lit("\n"), F.lit("\n\n\n\n")))
              .otherwise(F.col("text")))
    sentence = F.lit("")
    for kind, text in EVENT_SENTENCES.items():
        sentence = F.when(F.col("event_type") == kind, F.lit(text)).otherwise(sentence)
    edited = F.when((run == 3) & (doc % 11 == 6), F.lit("\nedited later.")).otherwise(F.lit(""))
    body = (F.when(defect.isin(5, 31), F.lit(" \t\n "))
            .when(short, F.when(doc % 2 == 0, F.lit("Great!!")).otherwise(F.lit("terrible")))
            .otherwise(F.concat(padded, sentence, _one_of(doc % 7, SENTIMENT_WORDS), edited)))
    title = (F.when(short | defect.isin(5, 31), F.col("text")).when(doc % 23 == 9, F.lit(None).cast("string")).when(doc % 23 == 10, F.lit(""))
             .otherwise(F.left(F.substring_index("text", "\n", 1), F.lit(60))))
    title = F.when((run >= 2) & (doc % 5 == 2), F.concat(title, F.lit(" (edited)"))).otherwise(title)
    anonymous = defect == 29
    when = (F.when(defect == 17, F.lit("soon"))
            .when(doc % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
            .when(doc % 3 == 1, F.concat(F.date_format(F.timestamp_add("HOUR", F.lit(-7), F.col("ts")),
                                                       "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-07:00")))
            .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return observed.withColumns({
        "id_raw": F.when(defect != 23, F.concat(F.lit("r-"), doc)),
        "rating_raw": (F.when(defect == 11, F.lit("7")).when(defect == 31, F.lit("five"))
                       .when(doc % 4 == 1, F.concat(F.lit(" "), rating, F.lit(" "))).otherwise(rating)),
        "title_raw": title,
        "body_raw": body,
        "author_label_raw": F.when(~anonymous & (doc % 8 != 3), F.concat(F.lit("reader "), F.col("user_id"))),
        "author_uri_raw": F.when(~anonymous & (doc % 4 != 0), F.concat(F.lit(f"{ENDPOINT}/id"), F.col("user_id"))),
        "published_raw": when,
        "app_version_raw": F.when(doc % 17 != 3, F.concat_ws(".", F.lit("1"), F.col("k"), run)),
        "review_url_raw": F.when(spacing != 5, F.concat(F.lit(f"{ENDPOINT}/review?id="), doc)),
        "vote_count_raw": (F.when((run == 2) & (doc % 997 == 500), F.lit("-1"))
                           .when(doc % 29 != 8, (F.col("votes") + run).cast("string"))),
        "vote_sum_raw": F.floor(F.col("votes") / 2).cast("string"),
    })


def _labelled(value: str, *before: Column) -> Column:
    return F.when(F.col(value).isNotNull(), F.struct(*before, F.col(value).alias("label")))


def _entry_json() -> Column:
    """Canonical JSON (sorted keys, absent fields left out) of one feed entry."""
    known = F.col("author_label_raw").isNotNull() | F.col("author_uri_raw").isNotNull()
    return F.to_json(F.struct(
        F.when(known, F.struct(_labelled("author_label_raw").alias("name"), _labelled("author_uri_raw").alias("uri")))
        .alias("author"),
        _labelled("body_raw", F.struct(F.lit("text").alias("type")).alias("attributes")).alias("content"),
        _labelled("id_raw").alias("id"),
        _labelled("rating_raw").alias("im:rating"),
        _labelled("app_version_raw").alias("im:version"),
        _labelled("vote_count_raw").alias("im:voteCount"),
        _labelled("vote_sum_raw").alias("im:voteSum"),
        F.when(F.col("review_url_raw").isNotNull(), F.struct(F.struct(
            F.col("review_url_raw").alias("href"), F.lit("related").alias("rel")).alias("attributes"))).alias("link"),
        _labelled("title_raw").alias("title"),
        _labelled("published_raw").alias("updated")))


_PAGE_COLUMNS = ["run_id", "source_app_id", "storefront", "page_number", "app_order", "fetched_at"]
_RAW_COLUMNS = ["id_raw", "rating_raw", "title_raw", "body_raw", "author_label_raw", "author_uri_raw",
                "published_raw", "app_version_raw", "vote_count_raw", "vote_sum_raw", "review_url_raw"]


def _feed_columns() -> list[Column]:
    return [F.lit(PLATFORM).alias("source_platform"), _endpoint().alias("source_endpoint")]


def _endpoint() -> Column:
    return F.concat(F.lit(f"{ENDPOINT}/"), F.col("storefront"), F.lit("/page="), F.col("page_number"),
                    F.lit("/id="), F.col("source_app_id"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed entries of every readable page (what the entry parser yields from ``raw_pages``)."""
    seen = _raw_fields(_observed(_documents(spark, sf_dir))).filter("page_is_json")
    return seen.select(*_PAGE_COLUMNS, "entry_pos", *_feed_columns(), *_RAW_COLUMNS,
                       _entry_json().alias("raw_record"), "parser_fallback_used")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages without their bodies."""
    seen = _observed(_documents(spark, sf_dir))
    return (seen.groupBy(*_PAGE_COLUMNS, F.col("page_is_json").alias("is_json"))
            .agg(F.count("*").alias("document_count")).select("*", *_feed_columns()))


def raw_pages(spark: SparkSession, sf_dir: str, by_range: bool = True) -> DataFrame:
    """Landed pages as JSON text.

    A page covers a fixed range of PAGE_ENTRIES document numbers of one feed, so however large a feed
    grows no page holds more. Pages also carry a feed-metadata entry and an entry that is no object.
    The range goes to one task before a document becomes an entry of each run, so its text travels once and not once a run; unless
    ``by_range``, pages are spread over the tasks each by itself.
    """
    docs = _documents(spark, sf_dir).withColumn("block", F.floor(F.col("doc_id") / PAGE_ENTRIES))
    seen = _raw_fields(_observed(docs.repartition("block") if by_range else docs))
    key = [*_PAGE_COLUMNS, *(["block"] if by_range else []), "page_is_json", "parser_fallback_used"]
    grouped = seen.select(*key, F.struct("entry_pos", _entry_json().alias("json")).alias("item")).groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    joined = F.array_join(F.transform("items", lambda i: i["json"]), ",")
    meta = '{"id":{"label":"feed-meta"},"title":{"label":"Not a review"}},"note",'
    listed = F.when(F.col("parser_fallback_used"), joined).otherwise(
        F.concat(F.lit(f"[{meta}"), joined, F.lit("]")))
    self_link = F.concat(F.lit('{"attributes":{"rel":"self","href":"'), _endpoint(), F.lit('"}}'))
    next_href = F.when(F.col("page_number") % 3 != 0, F.concat(_endpoint(), F.lit("&next"))).otherwise(F.lit(""))
    next_link = F.when(F.col("page_number") % 6 == 0, F.lit("")).otherwise(
        F.concat(F.lit(',{"attributes":{"rel":"next","href":"'), next_href, F.lit('"}}')))
    links = F.when(F.col("parser_fallback_used"), self_link).otherwise(
        F.concat(F.lit("["), self_link, next_link, F.lit("]")))
    body = F.concat(F.lit('{"feed":{"author":{"name":{"label":"Store"}},"entry":'), listed, F.lit(',"link":'), links,
                    F.lit(',"title":{"label":"Customer reviews"}}}'))
    broken = F.substring(body, F.lit(1), F.length(body) - 2)  # the closing braces are lost
    return grouped.select(
        *_PAGE_COLUMNS, *_feed_columns(),
        F.when(F.col("page_is_json"), body).otherwise(broken).alias("response_body"),
        F.concat(F.lit("raw/app_"), F.col("source_app_id"), F.lit("_"), F.col("storefront"), F.lit("_page_"),
                 F.col("page_number"), F.lit("_"),
                 F.date_format("fetched_at", "yyyyMMdd'T'HHmmssSSSSSS'Z'"), F.lit(".json")).alias("raw_file_path"))


def feed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feed with its place in a run."""
    return _documents(spark, sf_dir).select("source_app_id", "storefront", (F.col("app_no") * 8 + F.col("lang_no")).alias("app_order")).distinct()


def landed_pages(files: DataFrame, feeds: DataFrame) -> DataFrame:
    """Pages from their files, with the columns of ``raw_pages``."""
    return page_rows(files, feeds, PLATFORM, _endpoint())


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows: one per feed found in the documents (reads two narrow columns)."""
    feeds = read_table(spark, sf_dir, "documents").select(
        (F.substring("source", 4, 10).cast("bigint") % 10).alias("app_no"), "lang").distinct()
    return feeds.select(
        F.concat(F.lit("app-"), F.col("app_no")).alias("app_id"),
        F.concat(F.lit("App "), F.col("app_no")).alias("app_name"),
        F.concat(F.lit("v"), F.col("app_no") % 6).alias("vertical"),
        F.upper("lang").alias("storefront"), F.upper("lang").alias("expected_language"),
        (~((F.col("app_no") == 9) & (F.col("lang") == "es"))).alias("enabled"),
        F.lit("from documents").alias("notes"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feed, asked for once per run."""
    feeds = read_table(spark, sf_dir, "documents").select(
        (F.substring("source", 4, 10).cast("bigint") % 10).alias("app_no"), F.col("lang").alias("storefront")).distinct()
    return feeds.select(
        F.explode(F.array(*[F.lit(r).cast("bigint") for r in RUNS])).alias("run_id"),
        F.concat(F.lit("app-"), F.col("app_no")).alias("source_app_id"), "storefront", "app_no")


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered requests (one per landed page) and failed ones."""
    answered = pages(spark, sf_dir).select(
        "run_id", "source_app_id", "storefront", "page_number", F.lit(200).cast("bigint").alias("http_status"),
        F.lit(None).cast("string").alias("error"))
    failed = requests(spark, sf_dir).filter(
        (F.col("app_no") * 7 + F.col("run_id") * 3 + F.length("storefront")) % 5 == 0).select(
        "run_id", "source_app_id", "storefront", F.lit(9_999_999).cast("bigint").alias("page_number"),
        F.lit(503).cast("bigint").alias("http_status"),
        F.concat(F.lit("HTTP 503 for "), F.col("source_app_id")).alias("error"))
    return answered.unionByName(failed)


def annotations(spark: SparkSession, sf_dir: str, manifest: DataFrame, recheck: bool = False) -> DataFrame:
    """Answers for every manifest row, spelled the many ways annotators do, taken from ``labels``.

    Rows without a label stay blank. ``recheck`` gives the second look, which differs on some rows.
    """
    labels = read_table(spark, sf_dir, "labels")
    rows = manifest.select("sample_id", "weak_label", "detected_language",
                           F.substring("source_review_id", 3, 20).cast("bigint").alias("doc_id"))
    rows = rows.join(labels, "doc_id", "left")
    doc, quality, toxic = F.col("doc_id"), F.col("quality"), F.col("toxic")
    changed = (doc % 10 == 3) if recheck else F.lit(False)

    def answer(second_look: str, value: Column) -> Column:
        return F.when(changed, F.lit(second_look)).otherwise(value)

    def relevance(number: int) -> Column:
        turn = (doc + number) % 4
        return answer("not_relevant", F.when(quality == 1, F.when(turn == 0, "not_relevant").otherwise("1"))
                      .when(quality == 0, F.when(turn < 2, "0").otherwise("Yes")).otherwise(""))

    return rows.select(
        "sample_id",
        answer("Mixed", F.when(quality == 1, F.upper("weak_label"))
               .when(quality == 0, F.when(doc % 3 == 0, "mixed").when(doc % 3 == 1, "neutral").otherwise(""))
               .otherwise(F.when(doc % 4 == 0, " unclear ").otherwise(F.col("weak_label")))).alias("apparent_sentiment"),
        answer("disagree", F.when(quality == 1, F.when(doc % 2 == 0, "1").otherwise("Yes")).when(quality == 0, "disagree")
               .otherwise("")).alias("rating_label_agreement"),
        answer("yes", F.when(toxic == 1, "1").when(toxic == 0, "no").otherwise("")).alias("mixed_sentiment"),
        F.when(F.col("detected_language") == "en", "YES").otherwise("0").alias("appears_english"),
        F.when(toxic == 1, "no").otherwise("1").alias("text_interpretable"),
        *[relevance(i).alias(f"issue_{s}_relevance") for i, s in enumerate(ISSUE_SIGNALS)],
        *[relevance(7 + i).alias(f"{t}_term_relevance") for i, t in enumerate(BROAD_TERMS)],
        F.lit("").alias("annotation_notes"))


def canonical_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of a payload per order line, as a sender that does not sort or spell alike would write it."""
    json_text.allow_repeated_keys(spark)
    price, discount = F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double")
    payload = F.concat(
        F.lit('{"tiny": [1.0], "nested": {"price": '), price.cast("string"), F.lit(', "discount": '), F.format_string("%.3E", discount),
        F.lit('},\n "huge": '), (price * 1e13).cast("string"), F.lit(', "tiny": ['), (price * 1e-9).cast("string"), F.lit(" , "),
        (-discount * 1e-9).cast("string"), F.lit('], "Big": 1'), F.col("l_orderkey").cast("string"), F.lit("00000000000000000000}"))
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", json_text.canonical_json(payload).alias("payload"))
