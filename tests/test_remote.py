"""The connector against a local server that fails, stalls, refuses and recovers."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from cellsight.sources.io import Scorer
from cellsight.sources.remote import HttpModel, Refused, answers, read_answers


@pytest.fixture()
def server():
    """Prompts name what happens to them before they are answered."""
    asked, down = Counter(), set()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["inputs"]
            asked[prompt] += 1
            first = asked[prompt] == 1
            status, body = 200, json.dumps([{"generated_text": f"to {prompt}"}])
            if prompt in down:
                status = 503
            elif prompt.startswith("refuse"):
                status = 400
            elif prompt.startswith("busy") and asked[prompt] < 3:
                status = 429
            elif prompt.startswith("broken") and first:
                body = "{"
            elif prompt.startswith("odd") and first:
                body = "[]"
            elif prompt.startswith("stall") and first:
                time.sleep(1.5)
            try:
                self.send_response(status)
                self.send_header("Retry-After", "0.01")
                self.end_headers()
                self.wfile.write(body.encode())
            except OSError:
                pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/generate", asked, down
    http.shutdown()
    http.server_close()


def _model(url, **more):
    return HttpModel(url, **({"attempts": 3, "timeout": 0.5, "pause": 0.01} | more))


@pytest.mark.parametrize("prompt, times", [("plain", 1), ("busy", 3), ("broken", 2), ("odd", 2), ("stall", 2)])
def test_passing_faults_are_asked_again(server, prompt, times):
    url, asked, _ = server
    assert _model(url)(prompt) == f"to {prompt}" and asked[prompt] == times


def test_refusals_are_not(server):
    url, asked, down = server
    with pytest.raises(Refused):
        _model(url)("refuse")
    assert asked["refuse"] == 1
    down.add("gone")
    with pytest.raises(OSError):
        _model(url)("gone")
    assert asked["gone"] == 3


def test_a_closed_port_falls_to_the_next_tier(server):
    url, _, _ = server
    assert Scorer(_model("http://127.0.0.1:9/", attempts=2), _model(url), attempts=1)("plain") == "to plain"


def test_answered_chunks_are_not_asked_again(spark, server, tmp_path):
    url, asked, down = server
    path = f"file://{tmp_path}/log"
    names = [f"{k}{i}" for i in range(4) for k in ("plain", "busy", "broken")] + ["late"]
    prompts = spark.createDataFrame([*enumerate(names), (99, None)], "chunk_no long, prompt string")
    down.add("late")
    first = {r["chunk_no"]: r for r in answers(prompts, Scorer(_model(url), attempts=1), path, slices=3).collect()}
    assert {k for k, r in first.items() if r["status"] == "failed"} == {12, 99} and first[1]["raw"] == "to busy0"
    before = Counter(asked)
    down.clear()
    second = {r["chunk_no"]: r for r in answers(prompts, Scorer(_model(url), attempts=1), path, slices=5).collect()}
    assert asked - before == Counter({"late": 1})
    assert [second[k]["raw"] for k in range(13)] == [f"to {n}" for n in names] and second[99]["status"] == "failed"


def test_a_run_that_breaks_off_keeps_its_slices(spark, server, tmp_path):
    url, asked, _ = server
    path = f"file://{tmp_path}/log"

    class Breaking(Scorer):
        def __call__(self, prompt):
            if prompt == "plain7":
                raise RuntimeError("the task dies")
            return super().__call__(prompt)

    prompts = spark.createDataFrame([(i, f"plain{i}") for i in range(12)], "chunk_no long, prompt string").coalesce(1)
    with pytest.raises(Exception, match="the task dies"):
        answers(prompts, Breaking(_model(url)), path, slices=4)
    kept = {r["chunk_no"] for r in read_answers(spark, path).collect()}
    before = Counter(asked)
    whole = answers(prompts, Scorer(_model(url)), path, slices=4)
    assert {r["raw"] for r in whole.collect()} == {f"to plain{i}" for i in range(12)}
    assert 7 not in kept and asked - before == Counter({f"plain{i}": 1 for i in range(12) if i not in kept})


def test_no_prompts(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_no long, prompt string")
    assert answers(none, Scorer(), f"file://{tmp_path}/log").count() == 0
