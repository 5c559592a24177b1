"""The search source against a small server on this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from plenum.sources.web import records, web_search


class Service(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        given = parse_qs(urlparse(self.path).query)
        (q,) = given["q"]
        Service.asked.append(q)
        status, body = 200, {"items": [{"title": f"{q} {i}", "link": f"https://x/{i}", "pagemap": {"cse_image": [{"src": f"i{i}"}]}} for i in range(12)]}
        if q == "limit":
            status, body = 429, {"error": {"message": "quota"}}
        if q == "none":
            body = {}
        data = b"<html>" if q == "broken" else json.dumps(body).encode()
        self.send_response(500 if q == "down" else status)
        self.end_headers()
        self.wfile.write(b"" if q == "down" else data)

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}/search"
    server.shutdown()


def test_search(spark, service):
    asked = ["spark ü & co", " spark ü & co ", "x", "", "none", "limit", "broken", "down", "other"]
    rows = web_search(spark, service, asked, key="k", engine="e", requestsPerTask="2").collect()
    assert sorted(Service.asked) == sorted(["spark ü & co", "none", "limit", "broken", "down", "other"])
    good = sorted(r.place for r in rows if r.query == "spark ü & co")
    assert good == list(range(10)) and {r.thumbnail for r in rows if r.query == "other"} == {f"i{i}" for i in range(10)}
    errors = {r.query: r.error for r in rows if r.error}
    assert errors.keys() == {"limit", "broken", "down"} and errors["limit"] == "quota" and errors["down"] == "search failed (500)"
    assert web_search(spark, service, ["?"]).count() == 0


def test_an_unreachable_service(spark):
    (row,) = web_search(spark, "http://127.0.0.1:9/", ["query"], timeout="2").collect()
    assert row.error and row.place is None


def test_records():
    answer = {"items": [{"title": None, "pagemap": {"cse_thumbnail": [{"src": "t"}], "cse_image": [{"src": "i"}]}}, {"pagemap": {"cse_thumbnail": []}}]}
    assert list(records("q", answer)) == [("q", 0, "", "", "", "", "t", None), ("q", 1, "", "", "", "", None, None)]
    assert list(records("q", {"items": None})) == []
