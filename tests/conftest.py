import datetime
import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from feedfold.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("feedfold-tests", "local[4]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


def label(value):
    return {"label": value}


def review(number, rating="5", body="I love this app. It works perfectly!", **extra):
    entry = {"id": label(f"review-{number}"), "im:rating": label(rating), "title": label("Great update"),
             "content": {"label": body, "attributes": {"type": "text"}}, "im:version": label("1.2.3"),
             "author": {"name": label("Reader"), "uri": label("https://feed.test/id1")},
             "updated": label("2026-06-25T10:00:00-07:00"), "im:voteSum": label("3"), "im:voteCount": label("4"),
             "link": {"attributes": {"rel": "related", "href": "https://feed.test/r"}}}
    entry.update(extra)
    return {k: v for k, v in entry.items() if v is not None}


def page_body(entries, links=None):
    links = links if links is not None else [{"attributes": {"rel": "self", "href": "a"}},
                                             {"attributes": {"rel": "next", "href": "b"}}]
    return json.dumps({"feed": {"entry": entries, "link": links}})


@pytest.fixture(scope="session")
def make_pages(spark):
    """Pages from (run, app order, app, page, body) tuples."""
    def build(rows):
        day = datetime.datetime(2026, 1, 1)
        data = [(run, order, app, "us", page, day + datetime.timedelta(days=run), "store", f"https://feed.test/{app}/{page}", body)
                for run, order, app, page, body in rows]
        return spark.createDataFrame(data, """run_id long, app_order long, source_app_id string, storefront string,
            page_number long, fetched_at timestamp, source_platform string, source_endpoint string, response_body string""")
    return build
