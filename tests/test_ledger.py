"""The request ledger and a model's answers over loopback."""

import http.server
import json
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tonguemill.core.config import JobConfig
from tonguemill.operators import ledger, translation, translators
from tonguemill.operators.translation import RETRY
from tests.test_translation import segments


@pytest.fixture
def server():
    """Answers by what the prompt's list holds; counts requests, and how many are open at a time."""
    seen, state, lock = Counter(), {"open": 0, "most": 0, "keys": set()}, threading.Lock()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            with lock:
                state["open"] += 1
                state["most"] = max(state["most"], state["open"])
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = asked["input"]
            items = json.loads(prompt[prompt.index("\n\n[") : prompt.rindex("]") + 1])
            good = json.dumps([x.upper() for x in items])
            status, body = 200, json.dumps({"output": [{"content": [{"text": f"```json\n{good}\n```"}]}]})
            if "denied" in items:
                status, body = 401, json.dumps({"error": {"message": "no key"}})
            elif "broken" in items:
                status, body = 500, json.dumps({"error": "full"})
            elif "page" in items or "once" in items and not prompt.endswith(RETRY):
                body = "<html>not json"
            elif "short" in items:
                body = json.dumps({"output_text": "[]"})
            with lock:
                seen[prompt] += 1
                state["keys"].add(self.headers["Authorization"])
                state["open"] -= 1
                state["asked"] = {k: asked[k] for k in ("model", "temperature", "store")}
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}/v1", seen, state
    own.shutdown()
    own.server_close()


def test_model_over_loopback(spark, tmp_path, server):
    url, seen, state = server
    texts = {1: ["a", "b"], 2: ["a", "b"], 3: ["denied"], 4: ["broken"], 5: ["page"], 6: ["once"], 7: ["short"], 8: [f"t{i}" for i in range(100)]}
    book = ledger.RequestLedger(spark, str(tmp_path / "book"))
    call = translators.http_call(url, "m", "NO_SUCH_KEY", timeout=20)
    run = lambda b: translation.translate_segments(segments(spark, texts), ledger.asked_once(b, call, "m", tasks=3, in_flight=2), JobConfig("", ""))
    done, answers = run(book)
    rows = sorted(map(tuple, done.select("doc_id", "seg_idx", "text").collect()))
    told = {d: [t for own, _, t in rows if own == d] for d in texts}
    assert told == {d: ts if d in (3, 4, 5, 7) else [t.upper() for t in ts] for d, ts in texts.items()}
    status = {r.doc_id: r.error for r in translation.document_status(answers).collect()}
    assert status == {1: None, 2: None, 3: "no key", 4: "full", 5: "<html>not json", 6: None, 7: "Forventet 1 oversettelser, fikk 0.", 8: None}
    # 1 and 2 ask the same; what failed is asked once more, in other words
    assert set(seen.values()) == {1} and len(seen) == 1 + 2 * 5 + 4 and book.records().count() == len(seen)
    assert state["most"] <= 6 and state["keys"] == {None} and state["asked"] == {"model": "m", "temperature": 0.15, "store": False}
    # a restart asks nothing again, and gives the same
    again, _ = run(ledger.RequestLedger(spark, str(tmp_path / "book")))
    assert sorted(map(tuple, again.select("doc_id", "seg_idx", "text").collect())) == rows and set(seen.values()) == {1}
    # a new run asks what has no good answer: the status or body of 3, 4 and 5, both times, and 6 once
    run(ledger.RequestLedger(spark, str(tmp_path / "book"), run="second"))
    assert Counter(seen.values()) == {1: len(seen) - 7, 2: 7}


def test_key_of_the_executors_environment(server, monkeypatch):
    url, _, state = server
    monkeypatch.setenv("SOME_KEY", "k1")
    assert translators.http_call(url, "m", "SOME_KEY")("x\n\n[\"a\"]")[0] == 200 and state["keys"] == {"Bearer k1"}


class Dies(Exception):
    pass


def test_lost_tasks_ask_only_their_last_group_again(spark, tmp_path):
    calls, alive = tmp_path / "calls", tmp_path / "alive"
    calls.mkdir()

    def call(prompt):
        (calls / f"{prompt}-{len(list(calls.glob(prompt + '-*')))}").touch()
        if prompt == "p37" and not alive.exists():
            raise Dies
        return 200, json.dumps({"output_text": prompt})

    requests = spark.createDataFrame([(f"p{i:02}",) for i in range(60)] * 3, "prompt string").withColumn("key", ledger.request_key("m", F.col("prompt")))
    book = ledger.RequestLedger(spark, str(tmp_path / "book"), group=5)
    with pytest.raises(Exception, match="Dies"):
        book.ask(requests, call, tasks=2, in_flight=1)
    kept = book.records().count()
    alive.touch()
    book.ask(requests, call, tasks=2, in_flight=1)
    assert {r.key for r in book.answers().collect()} == {r.key for r in requests.collect()} and book.records().count() == 60
    asked = Counter(p.name.rsplit("-", 1)[0] for p in calls.iterdir())
    assert len(asked) == 60 and max(asked.values()) == 2 and sum(n > 1 for n in asked.values()) <= 2 * 5 and kept + sum(n > 1 for n in asked.values()) <= 60
    book.ask(requests, call, tasks=2, in_flight=1)
    assert sum(1 for _ in calls.iterdir()) == sum(asked.values())
