"""The adjudicator's addresses and notice, and requests to a stub service."""

import json
import threading
import time
import warnings
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from leaksieve.operators import adjudicator, detect, route
from leaksieve.operators.adjudicator import Service
from leaksieve.sources.lines import snippet_lines


@pytest.fixture()
def service():
    asked = []

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = body["messages"][1]["content"]
            asked.append((self.path, self.headers.get("Authorization"), body.get("model"), text))
            if "slow" in text:
                time.sleep(3)
            answer = "  LEAK: it is" if "acme" in text else "clean." if "release" in text else "I can't say"
            data = b"{no json" if "broken" in text else json.dumps({"choices": [{"message": {"content": answer}}]}).encode()
            self.send_response(500 if "error" in text else 200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def findings(spark, *texts):
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, text string")
    return detect.rule_findings(snippet_lines(docs, "text", F.col("id"), "py"))


def test_addresses():
    cases = {
        "http://h:1": "http://h:1/v1/chat/completions", "http://h:1//": "http://h:1/v1/chat/completions", "http://h/completion": "http://h/v1/chat/completions", "http://h/completion/": "http://h/v1/chat/completions",
        "http://h/v1": "http://h/v1/v1/chat/completions", "https://h/x/v1/chat/completions": "https://h/x/v1/chat/completions", "h/completion/completion": "h/v1/chat/completions",
    }
    assert {e: adjudicator.completions_url(e) for e in cases} == cases
    hosts = {"http://u:p@h.x:8/y": "h.x", "[::1]:8/y": "[::1]", "127.0.0.1:9?q=1": "127.0.0.1", "localhost": "localhost", "https://h.x": "h.x"}
    assert {e: adjudicator.host_of(e) for e in hosts} == hosts
    remote = {"http://localhost:1": False, "http://LOCALHOST": False, "http://127.9.9.9/": False, "http://[::1]:8/": False, "http://127.0.0.1.evil.org": True, "http://10.0.0.1": True, "https://x.org": True, "http://localhost@x.org": True}
    assert {e: adjudicator.is_remote(e) for e in remote} == remote


def test_one_notice_a_host(monkeypatch):
    monkeypatch.setattr(adjudicator, "_told", set())
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        for endpoint in ("http://far.org/x", "http://far.org/x", "http://localhost:1", "http://other.org"):
            adjudicator.tell_once(Service(endpoint))
    assert [("far.org" in str(w.message), "other.org" in str(w.message)) for w in seen] == [(True, False), (False, True)]


def test_answers_route_findings(spark, service, monkeypatch):
    endpoint, asked = service
    monkeypatch.setenv("SOME_KEY", " k1 ")
    f = findings(spark, "'acme-internal'", "not for release", "proprietary", "proprietary broken", "proprietary error", "proprietary\nproprietary 2\nproprietary 3\nproprietary 4")
    got = adjudicator.adjudicated(f, Service(endpoint + "/completion", model="m", key_name="SOME_KEY")).collect()
    told = {(r.unit_id, r.line_no): (r.layer, r.confidence, r.ai_skipped) for r in got}
    assert told["0", 1] == ("semantic", 0.85, False) and ("1", 1) not in told
    assert all(told[u, 1][2] for u in "2345") and [told["5", n][2] for n in (2, 3, 4)] == [True, True, False]
    assert {a[:3] for a in asked} == {("/v1/chat/completions", "Bearer k1", "m")} and len(asked) == 8
    assert {r.unit_id for r in adjudicator.adjudicated(f, Service(endpoint), "clean").collect()} == {"0", "5"}


def test_slow_and_dead_services_give_no_answer(spark, service):
    endpoint, _ = service
    f = findings(spark, *["proprietary slow"] * 3)
    for s in (Service(endpoint, timeout=0.5), Service("http://127.0.0.1:9", timeout=0.5)):
        began = time.monotonic()
        assert {r.ai_skipped for r in adjudicator.adjudicated(f, s).collect()} == {True} and time.monotonic() - began < 30


def test_a_task_stops_asking_a_dead_service(spark, monkeypatch):
    f = findings(spark, *["proprietary"] * 60).coalesce(1)
    labels = adjudicator.labels_of(f, Service("http://127.0.0.1:9", timeout=0.2, patience=8))
    assert labels.count() == 60 and labels.where("label is not null").count() == 0
    assert set(route.KEY) < set(labels.columns)
