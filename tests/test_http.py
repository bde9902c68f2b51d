"""Providers against a local server that fails in every way: 429, 500, 400, bad JSON, empty replies and silence."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from memlake import http
from memlake.operators.tasks import retry_class
from memlake.providers import ProviderError, completed, embedded, retryable_status

SEEN, OPEN, LOCK = Counter(), Counter(), threading.Lock()


class Stub(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/v1/embeddings":
            rows = [{"index": i, "embedding": [len(t), 1]} for i, t in enumerate(body["input"])]
            return self._send(200, json.dumps({"data": rows[::-1] if "none" not in body["input"] else []}))
        text = body["messages"][0]["content"]
        with LOCK:
            SEEN[text] += 1
            OPEN["now"] += 1
            OPEN["most"] = max(OPEN["most"], OPEN["now"])
            n = SEEN[text]
        try:
            time.sleep(1.5 if text == "silent" else 0.02)
            if text.startswith("busy") and n < 3:
                return self._send(429 if n == 1 else 500, "{}")
            if text in ("down", "bad"):
                return self._send(503 if text == "down" else 400, "{}")
            if text in ("garbled", "empty"):
                return self._send(200, "no json" if text == "garbled" else '{"content": []}')
            self._send(200, json.dumps({"content": [{"type": "text", "text": "re: "}, {"type": "other"}, {"type": "text", "text": text}]}))
        finally:
            with LOCK:
                OPEN["now"] -= 1

    def _send(self, status, text):
        try:
            self.send_response(status)
            self.end_headers()
            self.wfile.write(text.encode())
        except OSError:
            pass


@pytest.fixture
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    SEEN.clear()
    OPEN.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_replies_are_kept_and_retried(spark, tmp_path, url):
    client = http.HttpCompleter(url, "m", {"x-key": "k"}, timeout=0.8)
    prompts = ["a", "a", "busy", "down", "bad", "garbled", "empty", "silent", None] + [f"p{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(prompts)), "i long, p string").repartition(3)
    ask = lambda: {r["i"]: (r["reply"], r["error"]) for r in http.answered(df, "p", lambda p: client.complete("s", p), f"file://{tmp_path}/replies", tasks=2, concurrency=3, tries=3, wait=0.05, slice_rows=15).collect()}
    got = ask()
    assert len(got) == len(prompts) and got[0] == got[1] == ("re: a", None) and got[2] == ("re: busy", None) and got[8] == (None, None) and got[20] == ("re: p11", None)
    assert got[3] == (None, "status 503") and got[4] == (None, "status 400") and got[5][1] == "reply is no JSON" and got[6][1] == "no text in the reply" and "timed out" in got[7][1]
    assert SEEN["a"] == 1 and SEEN["busy"] == 3 and SEEN["down"] == 3 and SEEN["bad"] == 1 and SEEN["silent"] == 3 and OPEN["most"] <= 2 * 3 + 3
    before = SEEN.copy()
    assert ask() == got  # only what may do better is asked again
    assert {p for p in SEEN if SEEN[p] > before[p]} == {"down", "silent"}


def test_embeddings(spark, url):
    client = http.HttpEmbedder(url, "m")
    assert client.embed(["abc", ""]) == [[3.0, 1.0], [0.0, 1.0]] and client.embed([]) == []
    with pytest.raises(ProviderError):
        client.embed(["none"])
    rows = spark.createDataFrame([("ab",), (None,)], "t string").select(embedded(F.col("t"), client).alias("v")).collect()
    assert sorted(r["v"] for r in rows) == [[0.0, 1.0], [2.0, 1.0]]


def test_completed_tries_again(spark, url):
    client = http.HttpCompleter(url, "m", timeout=2)
    df = completed(spark.createDataFrame([("busy1",), ("bad",), ("down",)], "p string"), "s", "p", "r", client, wait=0.01)
    assert {r["p"]: r["r"] for r in df.collect()} == {"busy1": "re: busy1", "bad": None, "down": None}


def test_statuses_agree(spark):
    rows = spark.range(100, 700).select("id", retry_class(F.col("id")).alias("c")).collect()
    assert all((r["c"] == "retryable") == retryable_status(r["id"]) for r in rows)
