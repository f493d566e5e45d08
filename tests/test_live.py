"""The live table's data source against a small server in this process."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestamp.sources import live


class Server(ThreadingHTTPServer):
    """Tables of rows; pages by key; staged rows become visible when published."""

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.rows, self.staged, self.seen, self.posts, self.fail_after = [], {}, [], 0, None
        self.lock = threading.Lock()
        threading.Thread(target=self.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server_address[1]}"


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def answer(self, body=None, code=200):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(b"" if body is None else json.dumps(body).encode())

    def do_GET(self):
        query = urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query)
        asked, limit = dict(query)["select"].split(","), int(dict(query)["limit"])
        bounds = [v for k, v in query if k == "id"]
        fits = lambda r: all(r["id"] > int(v[3:]) if v.startswith("gt.") else r["id"] <= int(v[4:]) for v in bounds)
        with self.server.lock:
            self.server.seen.append((asked, limit))
            self.answer([{c: r.get(c) for c in asked} for r in sorted(self.server.rows, key=lambda r: r["id"]) if fits(r)][:limit])

    def do_POST(self):
        s, body = self.server, json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with s.lock:
            if self.path == "/rpc/publish":
                have = {r["serial"] for r in s.rows}
                for (run, _), r in sorted(s.staged.items()):
                    if run == body["run"] and r["serial"] not in have:
                        s.rows.append({"id": len(s.rows) + 1, **{k: v for k, v in r.items() if k not in ("run", "row")}})
                        have.add(r["serial"])
                s.staged = {k: r for k, r in s.staged.items() if k[0] != body["run"]}
                return self.answer()
            s.posts += 1
            if s.fail_after is not None and s.posts > s.fail_after:
                return self.answer(code=500)
            s.staged |= {(r["run"], r["row"]): r for r in body}
        self.answer()

    def do_DELETE(self):
        run = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))["run"].removeprefix("eq.")
        with self.server.lock:
            self.server.staged = {k: r for k, r in self.server.staged.items() if k[0] != run}
        self.answer()


@pytest.fixture
def server():
    s = Server()
    yield s
    s.shutdown()


def test_no_page_is_lost(spark, server):
    server.rows = [{"id": k, "numero_serie": f"S{k}", "marca": None if k % 3 else "x", "secret": "y"} for k in range(-40, 2500)]
    for partitions, upper in ((1, 0), (7, 1000), (4, 10**6)):  # bounds that are right and wrong
        got = live.read_table(spark, server.url, "cilindros", "numero_serie string, marca string", partitions, upper, page=100)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((r["numero_serie"], r["marca"]) for r in server.rows), key=str)
    assert {tuple(asked) for asked, _ in server.seen} == {("numero_serie", "marca", "id")} and {n for _, n in server.seen} == {100}
    server.rows = []
    assert live.read_table(spark, server.url, "cilindros", "id long").count() == 0


def test_insert_is_all_or_nothing_and_once(spark, server):
    rows = spark.range(50).select(F.col("id").alias("ord"), F.concat(F.lit("S"), (F.col("id") % 40).cast("string")).alias("serial")).repartition(3)
    with pytest.raises(ValueError):
        live.insert_rows(rows, server.url, "t", "r0", None, apply=True)
    live.insert_rows(rows, server.url, "t", "r0", None)
    assert server.rows == [] and server.staged == {}
    server.fail_after = 2  # some tasks have posted when one fails
    with pytest.raises(Exception):  # noqa: B017
        live.insert_rows(rows, server.url, "t", "r1", 5, apply=True, page=4)
    assert server.rows == [] and server.staged == {}
    server.fail_after = None
    for run in ("r2", "r2", "r3"):
        live.insert_rows(rows, server.url, "t", run, 5, apply=True, page=4)
        assert sorted((r["serial"], r["ord"], r["cliente_id"]) for r in server.rows) == sorted((f"S{k}", k, 5) for k in range(40))
