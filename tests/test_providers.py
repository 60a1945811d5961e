"""Providers as a data source, documents of a company, and remote embedding against a local server that misbehaves."""

import json
import sys
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from factloom.operators import remote
from factloom.sources import providers as P
from factloom.sources.commits import VersionedTable

FAKES = '''
import datetime, json, os
class Good:
    """Pages by company; every call for pages is written down."""
    path = os.environ.get("FAKE_PROVIDER_LOG", "")
    def pages(self, wanted):
        with open(self.path, "a") as f:
            f.write(json.dumps({k: str(v) for k, v in wanted.items()}) + "\\n")
        held = int(open(self.path + ".n").read()) if os.path.exists(self.path + ".n") else 3
        return [(c, i) for i in range(held) for c in ("a", "b") if wanted.get("company") in (None, c)]
    def fetch(self, page):
        return [{"company": page[0], "kind": "annual", "title": f"{page[0]}{page[1]}-{j}", "published": datetime.date(2020 + page[1], 1, 1)} for j in range(2)]
class Bad:
    def pages(self, wanted):
        return [("x", 0), ("x", 1)]
    def fetch(self, page):
        if page[1] == 0:
            raise RuntimeError("refused")
        return []
class Worse(Bad):
    def pages(self, wanted):
        raise OSError("down")
'''


@pytest.fixture
def fakes(spark, tmp_path, monkeypatch):
    """A module that driver and workers can import."""
    import os

    (tmp_path / "fake_providers.py").write_text(FAKES)
    log = str(tmp_path / "log")
    env = spark.sparkContext.environment
    before = dict(env)
    env["PYTHONPATH"] = os.pathsep.join([str(tmp_path), env.get("PYTHONPATH", "")])
    env["FAKE_PROVIDER_LOG"] = log
    monkeypatch.setenv("FAKE_PROVIDER_LOG", log)
    monkeypatch.setenv("PYTHONPATH", env["PYTHONPATH"])
    monkeypatch.syspath_prepend(str(tmp_path))
    yield tmp_path
    sys.modules.pop("fake_providers", None)
    env.clear()
    env.update(before)


def test_filters_reach_the_provider_and_failures_become_rows(spark, fakes):
    rows = P.disclosures(spark, ["fake_providers:Good", "fake_providers:Bad", "fake_providers:Worse"])
    wanted = rows.where("company = 'b' AND published >= DATE'2021-01-01'")
    assert {r["title"] for r in wanted.collect()} == {"b1-0", "b1-1", "b2-0", "b2-1"}
    pushed = [json.loads(line) for line in (fakes / "log").read_text().splitlines()]
    assert {"company": "b", "published": "2021-01-01"} in pushed
    assert "BatchScan disclosures" in wanted._jdf.queryExecution().executedPlan().toString()
    assert {r["provider"].split(":")[1] for r in P.failed(rows).collect()} == {"Bad", "Worse"}
    assert P.found(rows).count() == 12
    with pytest.raises(ValueError, match="refused"):
        P.found(P.disclosures(spark, ["fake_providers:Bad"]))


def test_a_stream_goes_on_where_it_stopped(spark, fakes, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for held in (1, 3):
        (fakes / "log.n").write_text(str(held))
        P.register(spark)
        stream = spark.readStream.format(P.NAME).option("providers", "fake_providers:Good").load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(processingTime="0 seconds").start(out)
        query.processAllAvailable()
        query.stop()
        titles = [r["title"] for r in spark.read.parquet(out).collect()]
        assert len(titles) == len(set(titles)) == 4 * held


def test_documents_of_a_company(spark, tmp_path):
    root = tmp_path / "docs"
    for path, text in {"Acme Co/a_b.md": "---\ntitle: T\n---\nbody", "acme_co/c.TXT": "plain", "acme_co/empty.txt": " \n", "top.md": "top", "other/x.md": "x", "top.pdf": "no"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    titles = lambda c: {r["title"] for r in P.company_documents(spark, f"file://{root}", c).collect()}
    assert titles("Acme Co") == {"T", "c"} and titles("unknown") == {"top"} and titles("  ") == {"top"}
    (root / "top.md").unlink()
    with pytest.raises(ValueError, match="unknown"):
        P.company_documents(spark, f"file://{root}", "unknown")
    with pytest.raises(ValueError, match="nowhere"):
        P.company_documents(spark, f"file://{root}/nowhere", "c")


class Server:
    """Answers out of order, fails every third request once, and counts texts and requests under way."""

    def __init__(self, status=503, drop=False):
        self.lock, self.texts, self.calls, self.now, self.most, self.fail, self.drop = threading.Lock(), Counter(), 0, 0, 0, {}, drop
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with outer.lock:
                    outer.calls += 1
                    outer.now += 1
                    outer.most = max(outer.most, outer.now)
                    bad = outer.calls % 3 == 0 and outer.fail.setdefault(tuple(body["input"]), 0) < 1
                    outer.fail[tuple(body["input"])] = outer.fail.get(tuple(body["input"]), 0) + 1
                    if not bad:
                        outer.texts.update(body["input"])
                threading.Event().wait(0.03)
                data = [{"index": i, "embedding": vector(t)} for i, t in enumerate(body["input"])][::-1]
                answer = json.dumps({"data": data[1:] if outer.drop else data}).encode()
                with outer.lock:
                    outer.now -= 1
                self.send_response(status if bad else 200)
                self.end_headers()
                self.wfile.write(b"" if bad else answer)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.post = remote.json_post(f"http://127.0.0.1:{self.server.server_port}/", "key", "m", 5)


def vector(text):
    return [float(len(text)), float(sum(map(ord, text)) % 97), 1.0]


def chunks(spark, n):
    return spark.range(n).select(F.col("id").alias("chunk_id"), F.concat(F.lit("Text "), (F.col("id") % 50).cast("string")).alias("text"))


def test_vectors_as_from_a_serial_run_with_bounded_requests(spark, tmp_path):
    server, store = Server(), VersionedTable(spark, f"file://{tmp_path}/v", remote.STORE, "embedding_id", "embedding")
    got = remote.embedded_remotely(chunks(spark, 120), store, server.post, "m", slices=2, in_flight=2, tasks=2, pause=0.01).collect()
    assert len(got) == 120 and all(r["embedding"] == vector(r["text"]) for r in got)
    assert server.most <= 4 and max(server.texts.values()) == 1 and len(server.texts) == 50
    calls = server.calls
    more = remote.embedded_remotely(chunks(spark, 120).unionByName(chunks(spark, 1).withColumn("text", F.lit("new"))), store, server.post, "m", slices=2, pause=0.01).collect()
    assert len(more) == 121 and server.calls - calls <= 2
    assert more[0]["embedding_id"].startswith("oae-ds-m") and len(more[0]["embedding_id"]) == 33


def test_finished_slices_stay_when_a_run_fails(spark, tmp_path):
    store = VersionedTable(spark, f"file://{tmp_path}/v", remote.STORE, "embedding_id", "embedding")
    server = Server(status=401)
    with pytest.raises(Exception, match="401"):
        remote.embedded_remotely(chunks(spark, 50), store, server.post, "m", slices=8, in_flight=1, tasks=1, pause=0.01)
    held = store.read().count()
    assert 0 < held < 50
    healthy = Server()
    assert remote.embedded_remotely(chunks(spark, 50), store, healthy.post, "m", slices=8, pause=0.01).where("embedding IS NULL").count() == 0
    assert sum(healthy.texts.values()) == 50 - held


def test_answers_are_checked(spark, tmp_path):
    with pytest.raises(remote.Upstream, match="2 texts, but 1"):
        remote.vectors_of({"data": [{"embedding": [1.0]}]}, 2)
    with pytest.raises(remote.Upstream, match="dimension"):
        remote.vectors_of({"data": [{"embedding": [1.0]}, {"embedding": [1.0, 2.0]}]}, 2)
    with pytest.raises(remote.Upstream, match="dimension"):
        remote.vectors_of({"data": [{"embedding": [1.0]}]}, 1, 3)
    with pytest.raises(remote.Upstream, match="numbers"):
        remote.vectors_of({"data": [{"embedding": ["x"]}]}, 1)
    assert remote.vectors_of({"data": [{"embedding": [2]}, {"embedding": [1]}]}, 2) == [[2.0], [1.0]]
    store = VersionedTable(spark, f"file://{tmp_path}/v", remote.STORE, "embedding_id", "embedding")
    with pytest.raises(Exception, match="texts, but"):
        remote.embedded_remotely(chunks(spark, 5), store, Server(drop=True).post, "m", pause=0.01)
