"""Runs and crawls, against a server in a thread."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from ledgerweave.operators import pointer
from ledgerweave.sources import crawl, runs

SCOPE = {"year": 2024}


def pages(spark, rows):
    return spark.createDataFrame([(k, f"http://x/{k}", bytearray(c)) for k, c in rows], "key string, url string, content binary")


def test_one_writer_at_a_time(spark, tmp_path):
    root = str(tmp_path)
    with runs.Run(spark, root, "c", "r", SCOPE) as first:
        with pytest.raises(FileExistsError):
            runs.Run(spark, root, "c", "r", SCOPE).__enter__()
        # a killed writer leaves its lock; who takes over goes on, and the other may not write any more
        with runs.Run(spark, root, "c", "r", SCOPE, take_over=True) as second:
            with pytest.raises(RuntimeError, match="taken this run over"):
                first._move(status="late")
            assert len(second.state["attempts"]) == 2
    with pytest.raises(ValueError, match="another scope"):
        runs.Run(spark, root, "c", "r", {"year": 2025}).__enter__()
    with pytest.raises(ValueError, match="not a name"):
        runs.Run(spark, root, "c", "../r", SCOPE)
    assert not pointer.exists(spark, f"{root}/c/runs/r/lock")


def test_content_is_kept_once_and_history_stays(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(OSError, match="broken"):
        with runs.Run(spark, root, "c", "r", SCOPE) as run:
            run.store(pages(spark, [("a", b"one"), ("b", b"one"), ("c", b"two")]))
            raise OSError("broken")
    with runs.Run(spark, root, "c", "r", SCOPE) as run:
        assert run.state["attempts"][0]["status"] == "failed" and run.state["step"] == 1
        run.store(pages(spark, [("lost", b"lost")]), step=0)  # was stored before the run broke
        run.store(pages(spark, [("a", b"three"), ("d", b"two")]))
        assert {r["key"]: bytes(r["content"]) for r in run.cached().collect()} == {"a": b"three", "b": b"one", "c": b"two", "d": b"two"}
        assert run.history().where("key = 'a'").count() == 2
        run.finish(True, items=4)
    assert runs.objects(spark, f"{root}/c").count() == 3
    with runs.Run(spark, root, "c", "later", SCOPE) as other:
        other.store(pages(spark, [("z", b"one")]))
        assert runs.objects(spark, f"{root}/c").count() == 3
    state = pointer.latest(spark, f"{root}/c/runs/r/state")
    assert state["status"] == "complete" and state["items"] == 4 and [a["status"] for a in state["attempts"]] == ["failed", "complete"]


class Server(BaseHTTPRequestHandler):
    def do_GET(self):
        s, at = self.server, urlparse(self.path)
        if at.path.endswith("/inventory"):
            body = {"rows": [{"id": r["id"], "updated_at": r["updated_at"]} for r in s.rows]}
        else:
            asked = {k: int(v[0]) for k, v in parse_qs(at.query).items()}
            if asked["offset"] == s.broken:
                return self.send_error(404)
            s.asked.append(asked["offset"])
            part = s.rows[asked["offset"] : asked["offset"] + asked["limit"]]
            body = {"rows": part, "count": len(part), "total_count": len(s.rows)}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    made = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    made.rows, made.asked, made.broken = [{"id": k, "updated_at": "1", "name": f"項目{k}"} for k in range(23)], [], None
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made
    made.shutdown()


def test_a_crawl_that_is_stopped_halfway_resumes(spark, tmp_path, server):
    url = f"http://127.0.0.1:{server.server_port}/list"
    server.broken = 15
    with pytest.raises(Exception):
        with runs.Run(spark, str(tmp_path), "c", "r", SCOPE) as run:
            crawl.crawl(run, url, page=5, pages_per_batch=2)
    before = sorted(server.asked)
    assert before[:2] == [0, 5]
    server.broken, server.asked = None, []
    with runs.Run(spark, str(tmp_path), "c", "r", SCOPE) as run:
        assert crawl.crawl(run, url, page=5, pages_per_batch=2)
        assert run.state["items"] == 23 and run.state["status"] == "complete"
        names = {r["row"] for r in crawl.items(run.cached()).collect()}
        assert len(names) == 23 and any("項目22" in n for n in names)
    assert 0 not in server.asked and 5 not in server.asked and 20 in server.asked


def test_a_list_that_changes_meanwhile_is_not_complete(spark, tmp_path, server):
    url = f"http://127.0.0.1:{server.server_port}/list"
    kept = runs.Run.store

    def change(run, batch, step=None):
        kept(run, batch, step)
        server.rows[3] = {"id": 3, "updated_at": "2", "name": "new"}

    with runs.Run(spark, str(tmp_path), "c", "r", SCOPE) as run:
        run.store = lambda batch, step=None: change(run, batch, step)
        assert not crawl.crawl(run, url, page=10)
        assert run.state["status"] == "partial"
