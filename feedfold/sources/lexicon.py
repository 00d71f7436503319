"""Keyword lexicons as parameters and as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Strong sentiment words.
POSITIVE_TERMS = ("amazing", "awesome", "excellent", "fantastic", "great", "love", "perfect", "wonderful")
NEGATIVE_TERMS = ("awful", "broken", "garbage", "hate", "horrible", "scam", "terrible", "trash", "worst")

# Issue signals in output order, and their version 1 terms in lexicon order.
LEXICON_VERSION = "issue_keywords_v1"
ISSUE_SIGNALS = (
    "performance_crash", "login_account", "payment_billing", "ads",
    "update_version", "delivery_service", "usability_navigation",
)
ISSUE_TERMS = {
    "performance_crash": ("crash", "crashes", "crashing", "froze", "frozen", "lag", "laggy", "slow", "performance"),
    "login_account": ("account", "log in", "login", "sign in", "password", "verification", "locked out"),
    "payment_billing": ("billing", "charged", "payment", "purchase", "refund", "subscription", "fee"),
    "ads": ("ad", "ads", "advertisement", "advertisements", "commercial", "commercials"),
    "update_version": ("update", "updated", "latest version", "new version", "version"),
    "delivery_service": ("delivery", "delivered", "driver", "order", "pickup", "ride", "service"),
    "usability_navigation": ("confusing", "difficult to use", "hard to find", "navigation", "interface",
                             "layout", "menu", "user experience"),
}

# Terms whose relevance is audited on its own.
BROAD_TERMS = ("service", "account", "version")

Lexicon = dict[str, tuple[str, ...]]


def check_lexicon(lexicon: Lexicon) -> Lexicon:
    """The lexicon must define exactly the known signals, each a list of strings."""
    unknown = sorted(set(lexicon) - set(ISSUE_SIGNALS))
    missing = sorted(set(ISSUE_SIGNALS) - set(lexicon))
    if unknown or missing:
        raise ValueError(f"lexicon must define the known signals; missing={missing}, unknown={unknown}")
    for signal, terms in lexicon.items():
        if isinstance(terms, str) or not all(isinstance(term, str) for term in terms):
            raise ValueError(f"signal {signal!r} must hold a list of strings")
    return lexicon


def lexicon_table(spark: SparkSession, lexicon: Lexicon = ISSUE_TERMS, version: str = LEXICON_VERSION) -> DataFrame:
    if not version:
        raise ValueError("a lexicon needs a version")
    rows = [(version, signal, term, place) for signal, terms in check_lexicon(lexicon).items()
            for place, term in enumerate(terms)]
    return spark.createDataFrame(rows, "version string, signal string, term string, position int")


def lexicon_from_table(table: DataFrame) -> Lexicon:
    """A lexicon table (a few hundred configuration rows) back as a parameter."""
    grouped: dict[str, list[str]] = {}
    for row in table.orderBy("signal", "position").select("signal", "term").toLocalIterator():
        grouped.setdefault(row.signal, []).append(row.term)
    return check_lexicon({signal: tuple(terms) for signal, terms in grouped.items()})
