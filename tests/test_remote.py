"""Remote sources against a server on this machine that answers by page, fails now and then, and keeps a log."""

import json
import re
import threading
import urllib.error
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sibyl.sources import remote
from sibyl.sources.cache import ResultCache

TRIPLES = sorted({(f"http://x/s{i % 17:02d}", f"http://x/p{i % 3}", f'va"lue\n{i:03d}' if i % 2 else f"http://x/o{i}") for i in range(95)})


def binding(value):
    return {"type": "uri", "value": value} if value.startswith("http") else {"type": "literal", "value": value, "xml:lang": "en"}


def unquoted(text):
    return json.loads(text)


def graph(query):
    rows = TRIPLES
    for var, value in re.findall(r'FILTER\(STR\(\?(\w)\) = ("(?:[^"\\]|\\.)*")\)', query):
        rows = [r for r in rows if r["spo".index(var)] == unquoted(value)]
    for var, value in re.findall(r'FILTER\(STRSTARTS\(STR\(\?(\w)\), ("(?:[^"\\]|\\.)*")\)\)', query):
        rows = [r for r in rows if r["spo".index(var)].startswith(unquoted(value))]
    for var, values in re.findall(r"FILTER\(STR\(\?(\w)\) IN \((.*?)\)\)", query):
        rows = [r for r in rows if r["spo".index(var)] in json.loads(f"[{values}]")]
    if "COUNT(*)" in query:
        return [{"n": {"type": "literal", "value": str(len(rows))}}]
    limit, offset = map(int, re.search(r"LIMIT (\d+) OFFSET (\d+)", query).groups())
    assert "ORDER BY ?s ?p ?o" in query
    return [dict(zip("spo", map(binding, r), strict=True)) for r in rows[offset : offset + limit]]


@pytest.fixture
def server():
    log: list = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            path, _, rest = self.path.partition("?")
            params = dict(urllib.parse.parse_qsl(rest))
            with self.server.lock:
                log.append((path, params.get("query") or params.get("q")))
                seen = log.count(log[-1])
            if path == "/gone" or path == "/down":
                return self.send_error(404 if path == "/gone" else 503)
            if path == "/flaky" and seen == 1 and "OFFSET 30" in params["query"]:
                return self.send_error(503)
            if path == "/search":
                body = {"results": [{"title": f"{params['q']} {i}", "description": None, "url": f"u{i}"} for i in range(int(params["count"]))] if params["q"] != "nothing" else []}
            else:
                body = {"results": {"bindings": graph(params["query"])[: 4 if path == "/cut" else None]}}
            self.send_response(200)
            self.end_headers()
            # the second answer of a flaky page is cut in the middle
            self.wfile.write(json.dumps(body).encode()[: 20 if path == "/flaky" and seen == 2 and "OFFSET 30" in params["query"] else None])

        def log_message(self, *_):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    httpd.lock = threading.Lock()
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", log
    httpd.shutdown()
    httpd.server_close()


def rows(df):
    return sorted((r.s, r.p, r.o) for r in df.collect())


def test_pages_are_split_over_tasks_and_failing_ones_retried(spark, server):
    url, log = server
    df = remote.endpoint_triples(spark, f"{url}/flaky", pageSize=10, pagesPerTask=2, pause=0.01)
    assert df.rdd.getNumPartitions() == 5
    log.clear()
    got = df.collect()
    assert sorted((r.s, r.p, r.o) for r in got) == TRIPLES
    assert all((r.o_is_uri, r.lang) == ((True, None) if r.o.startswith("http") else (False, "en")) for r in got)
    pages = Counter(int(re.search(r"OFFSET (\d+)", q).group(1)) for _, q in log if "OFFSET" in q)
    assert pages == {o: 3 if o == 30 else 1 for o in range(0, 100, 10)}


def test_filters_reach_the_server(spark, server):
    url, log = server
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = remote.endpoint_triples(spark, f"{url}/graph", pageSize=10)
        odd = next(o for _, _, o in TRIPLES if not o.startswith("http"))
        for condition, want in [
            (F.col("p") == "http://x/p1", lambda t: t[1] == "http://x/p1"), (F.col("o") == odd, lambda t: t[2] == odd), (F.col("s").isin("http://x/s01", 'a"b'), lambda t: t[0] == "http://x/s01"),
            (F.col("o").startswith("va\"lue\n0") & (F.length("s") > 3), lambda t: t[2].startswith('va"lue\n0')), (F.col("s") == "none", lambda t: False),
        ]:
            log.clear()
            assert rows(df.filter(condition)) == [t for t in TRIPLES if want(t)]
            assert all("FILTER(" in q for _, q in log)
            asked = [q for _, q in log if "OFFSET" in q]
            assert len(asked) == sum(map(want, TRIPLES)) // 10 + 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    df = remote.endpoint_triples(spark, f"{url}/graph", pageSize=10)
    assert rows(df.filter("s = 'http://x/s01'")) == [t for t in TRIPLES if t[0] == "http://x/s01"]


def test_failures_end(spark, server):
    url, log = server
    with pytest.raises(urllib.error.HTTPError):
        remote.get_json(f"{url}/gone", {"query": "a"}, pause=0.01)
    assert len(log) == 1
    with pytest.raises(RuntimeError, match="3 tries"):
        remote.get_json(f"{url}/down", {"query": "b"}, tries=3, pause=0.01)
    assert len(log) == 4
    with pytest.raises(Exception, match="smaller ones"):  # a server that cuts pages must not lose rows in silence
        remote.endpoint_triples(spark, f"{url}/cut", pageSize=10, pagesPerTask=2, tries=1).collect()
    with pytest.raises(Exception, match="names of the pattern"):
        remote.graph_rows(spark, url, "?s ?p ?o", "s p o; drop").collect()


def test_web_search_asks_each_query_once(spark, server, tmp_path):
    url, log = server
    asked = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,), (" ",), ("nothing",)], "query string")
    got = remote.web_search(asked, f"{url}/search", k=2).collect()
    assert sorted((r.query, r.rank, r.title, r.url) for r in got) == [(q, i + 1, f"{q} {i}", f"u{i}") for q in ("a b", "c") for i in range(2)]
    log.clear()
    cache = ResultCache(spark, str(tmp_path / "cache"))
    search = lambda q: remote.web_search(q, f"{url}/search", k=2)
    first = sorted(remote.cached_search(asked, cache, search).collect())
    again = sorted(remote.cached_search(asked.unionByName(spark.createDataFrame([("d",)], "query string")), cache, search).collect())
    assert len(first) == 4 and [r for r in again if r.query != "d"] == first
    assert Counter(q for _, q in log) == {"a b": 1, "c": 1, "d": 1, "nothing": 2}
