"""Parser, settings, retrieval rules, and the life of an index over real folders."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from lodeseek import config
from lodeseek.functions import ids, text
from lodeseek.operators import chunking, retrieval
from lodeseek.plans import parse
from lodeseek.plans.session import CodeSearch
from lodeseek.sources.files import listing
from lodeseek.sources.store import Store
from lodeseek.streaming.ingest import ingest, upsert_batch

CPP = """#include <map>
// namespace hidden { void no(); }
namespace net::io {
enum class Mode { A, B };
class Socket;
/* { */
class Socket : public Base {
public:
    Socket(int fd) : fd_(fd), n_{0} { open(); }
    ~Socket();
    int read(char* to, int n) const {
        if (n > 0) { return poll("}{"); }
        return 0;
    }
    bool operator==(const Socket& o) const { return fd_ == o.fd_; }
private:
    int fd_ = make(3);
};
struct Pair {
    int a;
    int b;
};
template <typename T>
T twice(T x) {
    return x + x;
}
}
int net::io::Socket::size() {
    return 1;
}
void declared(int a,
              int b);
int table[] = {1, 2};
"""
CS = """using System;
namespace Shop.Core {
    public interface IStore { void Put(int k); }
    public enum Kind { A, B }
    public class Store<T> : IStore where T : new() {
        public int Count { get; set; }
        public Store(int n) : base(n) { Count = n; }
        public void Put(int k) {
            if (k > 0) { Log("{"); }
        }
        public int Twice(int x) => x * 2;
    }
    public record Item(string Name);
    public struct Point {
        public int X;
        public override string ToString() { return "p"; }
    }
}
"""


def test_parse_cpp():
    got = [(s.symbol_type, s.symbol_name, s.parent_class, s.namespace, s.start_line, s.end_line) for s in parse.parse(CPP, ".cpp")]
    ns = "net::io"
    for want in [
        ("class", "net::io::Socket", "", ns, 5, 5),
        ("class", "net::io::Socket", "", ns, 7, 18),
        ("method", "net::io::Socket::Socket", "Socket", ns, 9, 9),
        ("method", "net::io::Socket::~Socket", "Socket", ns, 10, 10),
        ("method", "net::io::Socket::read", "Socket", ns, 11, 14),
        ("struct", "net::io::Pair", "", ns, 19, 22),
        ("function", "net::io::twice", "", ns, 23, 26),
        ("method", "net::io::Socket::size", "Socket", "", 28, 30),
        ("function", "declared", "", "", 31, 32),
    ]:
        assert want in got, (want, got)
    names = {g[1] for g in got}
    assert not names & {"no", "net::io::Mode", "Mode", "table", "net::io::Socket::make", "net::io::Socket::open"} and len(got) == 10


def test_parse_cs():
    got = {(s.symbol_type, s.symbol_name, s.parent_class, s.start_line, s.end_line) for s in parse.parse(CS, ".cs")}
    for want in [
        ("interface", "Shop.Core.IStore", "", 3, 3),
        ("method", "Shop.Core.IStore.Put", "IStore", 3, 3),
        ("class", "Shop.Core.Store", "", 5, 12),
        ("method", "Shop.Core.Store.Store", "Store", 7, 7),
        ("method", "Shop.Core.Store.Put", "Store", 8, 10),
        ("method", "Shop.Core.Store.Twice", "Store", 11, 11),
        ("struct", "Shop.Core.Point", "", 14, 17),
        ("method", "Shop.Core.Point.ToString", "Point", 16, 16),
    ]:
        assert want in got, (want, got)
    assert not [g for g in got if "Kind" in g[1] or "Count" in g[1]]
    assert parse.parse("int main() {}", ".py") == []


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    p.write_bytes(b"\xef\xbb\xbf" + json.dumps({"indexer": {"chunk_min_lines": 2, "a": {"source_paths": ["x"], "extensions": [".h"]}}, "search": {"alpha": 0.9}}).encode())
    s = config.load(str(p))
    assert s.chunking == config.Chunking(2, 80, 10) and s.projects[0].name == "a" and s.search.alpha == 0.9 and s.search.top_k == 20
    assert config.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}, "d": {"x": 1}}) == {"a": {"b": 5, "c": 2}, "d": {"x": 1}}
    with pytest.raises(SystemExit):
        config.load(str(tmp_path / "none.json"))


def test_ids(spark):
    import hashlib
    import uuid

    r = spark.range(1).select(ids.chunk_id(F.lit("a/é.cpp"), F.lit(1), F.lit(20)).alias("c"), ids.point_id(F.lit("x")).alias("p")).first()
    assert r.c == str(uuid.uuid5(uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), "a/é.cpp:1:20"))
    assert int(r.p) == int.from_bytes(hashlib.md5(b"x").digest()[:8], "big")


def test_globs():
    import fnmatch
    import re

    for glob in ("*/build/*", "*.[ch]", "[!a]x", "a?c", "a.b", "*", "[]x]y", "[a", "src{1}"):
        for path in ("p/build/x", "x/y.c", "bx", "ax", "abc", "a.b", "aXb", "]y", "[a", "src{1}", ""):
            assert bool(re.match(text.glob_regex(glob), path)) == fnmatch.fnmatchcase(path, glob), (glob, path)


def test_windows_cover_all_lines(spark):
    c = config.Chunking(2, 10, 3)
    for n in (0, 1, 2, 9, 10, 11, 25, 31):
        body = "".join(f"l{i}\n" for i in range(n))
        df = spark.createDataFrame([("f", "en", "p", body)], "file_path string, language string, project_name string, content string")
        got = [(r.start_line, r.end_line) for r in chunking.sliding_chunks(df, c).collect()]
        want = [(i + 1, min(n, i + 10)) for i in range(0, n, 7) if min(n, i + 10) - i >= 2]
        assert sorted(got) == want


def test_bm25_rules(spark):
    rows = [("1", "alpha beta gamma", "N::Foo"), ("2", "beta alpha", ""), ("3", "alpha_beta alphabet", "bar"), ("4", "gamma", "alpha")]
    df = spark.createDataFrame(rows, "chunk_id string, content string, symbol_name string")
    ids_of = lambda q, mode="all": sorted(r.chunk_id for r in retrieval.bm25(df, q, mode).collect())
    assert ids_of("alpha beta") == ["1", "2", "3"] and ids_of('"alpha beta"') == ["1", "3"] and ids_of("alpha_beta") == ["1", "3"]
    assert ids_of("alphab*") == ["3"] and ids_of("gamma bar", "any") == ["1", "3", "4"] and ids_of("") == [] and ids_of("N::Foo") == ["1"]
    tf, dl, n, dfq = 1, 5, 4, 1
    avgdl = (5 + 2 + 4 + 2) / 4
    want = math.log((n - dfq + 0.5) / (dfq + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert abs(retrieval.bm25(df, "foo").first().score - want) < 1e-8
    posted = retrieval.postings(df)
    assert posted.count() == 13
    posted, lengths = retrieval.index_postings(df)
    for q in ("alpha gamma", '"alpha beta" gamma', "alpha_beta foo", "alph* beta", "N::Foo", "", "none", "alpha alpha"):
        for mode in ("all", "any"):
            a = {r.chunk_id: r.score for r in retrieval.bm25(df, q, mode).collect()}
            b = {r.chunk_id: r.score for r in retrieval.bm25_indexed(posted, lengths, q, mode).collect()}
            assert a == b, (q, mode)


def test_fusion_ties(spark):
    side = lambda ids_: spark.createDataFrame([(c, i + 1) for i, c in enumerate(ids_)], "chunk_id string, rank int")
    got = [(r.chunk_id, round(r.score, 6)) for r in retrieval.best_fused(retrieval.rrf(side("ab"), side("cb"), 0.5), 3).orderBy("rank").collect()]
    assert got == [("b", round(1 / 62, 6)), ("a", round(0.5 / 61, 6)), ("c", round(0.5 / 61, 6))]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    (root / "sub").mkdir(parents=True)
    (root / "build").mkdir()
    (root / "a.cpp").write_text(CPP)
    (root / "sub" / "b.cs").write_text(CS)
    (root / ".hid.h").write_text("\n".join(f"int g{i} = {i};" for i in range(12)))
    (root / "build" / "gen.cpp").write_text("void generated_thing() {\n  int x;\n}\n")
    (root / "note.txt").write_text("not source")
    (root / "bad.h").write_bytes(b"// \xff\xfe bytes\n" * 5)
    return root


def engine(spark, tmp_path, **projects):
    values = {"indexer": {"chunk_min_lines": 3, "chunk_max_lines": 80, "chunk_overlap_lines": 10, **projects}}
    return CodeSearch(spark, f"{tmp_path}/store", config.settings(values))


def test_life_of_an_index(spark, tmp_path, tree):
    one = {"source_paths": [str(tree)], "extensions": [".cpp", ".cs", ".h"], "exclude_patterns": ["*/build"]}
    e = engine(spark, tmp_path, one=one)
    assert {r.status: r.n for r in e.index().collect()} == {"new": 4}
    assert e.index().count() == 0  # nothing has changed
    hit = e.search("Socket read", top_k=5, project="one").collect()
    assert any("Socket::read" in r.symbol_name for r in hit) and e.search("Socket", language="cs").where("language <> 'cs'").count() == 0
    chunk = e.get_chunk(hit[0].chunk_id).first()
    assert chunk.content == hit[0].content and e.get_chunk("none").count() == 0
    assert [r.name for r in e.outline("b.cs").collect()][0].startswith("Shop.Core")
    assert e.search("generated_thing").where("file_path like '%build%'").count() == 0
    (tree / "a.cpp").write_text("void fresh_marker_fn() {\n  int a;\n  int b;\n}\n")
    os.utime(tree / "a.cpp", (1e9, 1e9))
    (tree / "sub" / "b.cs").unlink()
    assert {r.status: r.n for r in e.index().collect()} == {"modified": 1, "deleted": 1}
    assert "fresh_marker_fn" in e.search("fresh_marker_fn").first().content
    assert e.chunks().where("content like '%Socket%' or file_path like '%b.cs'").count() == 0
    assert e.stats().first().total_files == 3 and e.project_stats().first().files == 3
    assert e.vectors().count() == e.chunks().count() == e.lengths().count()
    s = e.status().first()
    assert s.total_vectors == s.total_chunks and s.entries > 0 and s.disk_mb > 0 and not s.size_mismatch
    batch = spark.createDataFrame([(0, "fresh marker", None), (1, "bytes", 1)], "query_id int, query string, top_k int")
    assert {r.query_id for r in e.query_batch(batch).collect()} >= {0}
    other = engine(spark, tmp_path, two={"source_paths": [str(tree / "build")], "extensions": [".cpp"]})
    other.index()  # project one is gone from the settings
    plan = other.search("generated").select("chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert "In(token" in plan or "EqualTo(token" in plan  # the postings of the query's tokens only
    assert {r.project_name for r in other.files().collect()} == {"two"} and other.chunks().where("project_name = 'one'").count() == 0
    before = other.cache().count()
    assert other.collect_cache().count() < before


def test_store_keeps_two_versions(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    for i in range(4):
        s.write("t", spark.range(i + 1))
    assert s.versions("t") == [3, 4] and s.read("t").count() == 4
    s.reset()
    assert not s.exists("t") and s.read("t", "id long").count() == 0


def test_streaming_ingest(spark, tmp_path):
    schema = "file_path string, mtime double, project_name string, content string, language string"
    source = tmp_path / "in"
    body = "void f{}() {{\n  int a;\n  int b;\n}}\n"
    e = CodeSearch(spark, f"{tmp_path}/store", config.settings({"indexer": {"chunk_min_lines": 2}}))
    for k, names in enumerate((["a", "b"], ["b"])):
        rows = [(f"{n}.cpp", float(k), "p", body.format(f"{n}{k}"), "cpp") for n in names]
        spark.createDataFrame(rows, schema).write.mode("append").json(str(source))
        ingest(spark.readStream.schema(schema).json(str(source)), e, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.symbol_name for r in e.chunks().collect()) == ["fa0", "fb1"]
    assert e.files().count() == 2 and e.vectors().count() == 2 and {r.token for r in e.postings().collect()} >= {"fa0", "fb1"}
    assert e.search("fb1").first().symbol_name == "fb1"


def test_an_update_reads_and_rewrites_what_changed(spark, tmp_path):
    root = tmp_path / "many"
    root.mkdir()
    for k in range(30):
        (root / f"f{k}.cpp").write_text(f"int g{k}(int x) {{\n  int a;\n  return {k};\n}}\n")
    e = engine(spark, tmp_path, one={"source_paths": [str(root)], "extensions": [".cpp"]})
    e.index()
    before = e.store.buckets("chunks")
    (root / "f3.cpp").write_text("int fresh(int x) {\n  int a;\n  return 3;\n}\n")
    os.utime(root / "f3.cpp", (2e9, 2e9))
    os.utime(root / "f4.cpp", (2e9, 2e9))  # touched only
    assert {r.status: r.n for r in e.index().collect()} == {"modified": 1}
    assert e.store.read("fresh").count() == 2  # no other file was read
    after = e.store.buckets("chunks")
    assert 1 <= sum(after[b] != before.get(b) for b in after) <= 2 and e.chunks().count() == 30
    assert e.search("fresh").first().symbol_name == "fresh" and e.search("g3").where("symbol_name = 'g3'").count() == 0
    e.index()
    assert e.store.read("fresh").count() == 0


def test_exclusion_is_tried_below_the_root(spark, tmp_path):
    root = tmp_path / "build" / "src"
    (root / "build").mkdir(parents=True)
    (root / "a.cpp").write_text("int a;")
    (root / "build" / "b.cpp").write_text("int b;")
    found = listing(spark, config.Project("p", [str(root)], [".CPP"], ["*/build"])).collect()
    assert [r.file_path for r in found] == [str(root / "a.cpp")]
    p = F.lit(f"{root}/a.cpp")
    assert not spark.range(1).select(text.excluded(p, ["*/build"], str(root))).first()[0] and spark.range(1).select(text.excluded(p, ["*/build"])).first()[0]


def test_line_ends(spark):
    c = config.Chunking(1, 2, 0)
    df = spark.createDataFrame([("f", "en", "p", "a\rb\rc\r")], "file_path string, language string, project_name string, content string")
    assert [(r.start_line, r.end_line, r.content) for r in chunking.sliding_chunks(df, c).orderBy("start_line").collect()] == [(1, 2, "a\nb\n"), (3, 3, "c\n")]
    for s in ("", "a", "a\n", "a\r\nb", "a\r\rb\n\n", "a\x0bb\x0cc\u2028d\x85e\x1c", "\n"):
        assert spark.range(1).select(text.split_lines(F.lit(s))).first()[0] == s.splitlines(), repr(s)


def test_upper_case_keeps_each_letter(spark, tmp_path):
    import duckdb

    from lodeseek.queries import ORACLE_SQL, QUERIES

    texts = ["", "straße", "ß", "ßß\nxß", "ŉa ﬁn ΐ ᾳ", "a\x00b", "été", None, "œuvre ÿ ẞ"]
    spark.createDataFrame([(k, t, "fr", "s") for k, t in enumerate(texts)] + [(99, "daß", "de", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = {(r.chunk_id, r.content) for r in QUERIES["upsert_chunks"](spark, str(tmp_path)).collect()}
    assert got == set(c.execute(ORACLE_SQL["upsert_chunks"]).fetchall()) and ("1", "STRAẞE") in got


def test_overlaps_of_all_kinds(spark):
    rows = [("f", k, 1, 10, t, p) for k, t, p in (("1", "function", ""), ("2", "namespace", ""), ("3", "code", ""))]
    rows += [("g", "4", 1, 10, "method", "K"), ("g", "5", 1, 10, "class", ""), ("g", "6", 1, 10, "namespace", "")]
    df = spark.createDataFrame(rows, "file_path string, chunk_id string, start_line int, end_line int, symbol_type string, parent_class string")
    assert sorted(r.chunk_id for r in chunking.dedupe_overlaps(df).collect()) == ["1", "4", "5"]


def test_rows_without_project_stay(spark, tmp_path):
    e = engine(spark, tmp_path, one={"source_paths": [str(tmp_path)], "extensions": [".none"]})
    rows = [("x.cpp", 1.0, "", "int f() {\n  int a;\n  return 1;\n}\n", "cpp"), ("y.cpp", 1.0, "old", "int f() {\n  int a;\n  return 1;\n}\n", "cpp")]
    upsert_batch(e, spark.createDataFrame(rows, "file_path string, mtime double, project_name string, content string, language string"))
    assert e.files().count() == 2
    assert {r.status: r.n for r in e.index().collect()} == {"deleted": 1}
    assert [r.file_path for r in e.files().collect()] == ["x.cpp"] and e.chunks().count() == 1


def test_tools(spark, tmp_path, tree):
    import http.client
    import io
    import threading

    from lodeseek import serve

    e = engine(spark, tmp_path, one={"source_paths": [str(tree)], "extensions": [".cpp", ".cs"]})
    e.index()
    serve.log_to(str(tmp_path / "log.txt"))
    ask = lambda i, m, **p: json.dumps({"jsonrpc": "2.0", "id": i, "method": m, "params": p})
    lines = [ask(1, "initialize"), '{"jsonrpc": "2.0", "method": "notifications/initialized"}', ask(2, "tools/list"), ask(3, "tools/call", name="search_code", arguments={"query": "Socket read", "top_k": 3})]
    lines += [ask(4, "tools/call", name="get_chunk", arguments={"chunk_id": "none"}), ask(5, "tools/call", name="search_code", arguments={"what": 1}), ask(6, "nothing"), "no json", ""]
    out = io.StringIO()
    serve.serve_lines(e, io.StringIO("\n".join(lines) + "\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5, 6, None]
    assert {x["name"] for x in got[1]["result"]["tools"]} == set(serve.TOOLS)
    rows = json.loads(got[2]["result"]["content"][0]["text"])
    assert 0 < len(rows) <= 3 and {"symbol_name", "file_path", "start_line", "score", "content"} <= set(rows[0])
    assert got[3]["result"] == {"content": [{"type": "text", "text": "null"}], "isError": False} and got[4]["result"]["isError"]
    assert got[5]["error"]["code"] == -32601 and got[6]["error"]["code"] == -32700
    assert "[INPUT] search_code" in (tmp_path / "log.txt").read_text()
    server = serve.http_server(e, 0)
    threading.Thread(target=server.handle_request, daemon=True).start()
    c = http.client.HTTPConnection(*server.server_address)
    c.request("POST", "/", ask(7, "tools/call", name="get_file_outline", arguments={"file_path": "b.cs"}))
    assert json.loads(json.loads(c.getresponse().read())["result"]["content"][0]["text"])[0]["name"].startswith("Shop.Core")
    server.server_close()


def test_command_line(spark, tmp_path, tree, capsys, monkeypatch):
    from lodeseek.__main__ import main, shortened

    assert shortened("x" * 45) == "x" * 45 and shortened("x" * 46) == "x" * 42 + "..."
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"indexer": {"chunk_min_lines": 3, "one": {"source_paths": [str(tree)], "extensions": [".cpp"]}}}))
    common = ["--settings", str(p), "--store", str(tmp_path / "st")]
    main([*common, "--index-only", "--status"])
    said = capsys.readouterr().out
    assert "total_vectors" in said and "..." in said or len(str(tree)) <= 45
    monkeypatch.setattr("builtins.input", lambda _: "n")
    with pytest.raises(SystemExit):
        main([*common, "--remove"])
    assert (tmp_path / "st").exists()
    monkeypatch.setattr("builtins.input", lambda _: "y")
    main([*common, "--remove"])
    assert not (tmp_path / "st").exists()
    with pytest.raises(SystemExit):
        main(["--no-such-flag"])


def test_recall_of_cells(spark, tmp_path):
    from lodeseek.operators import ann

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("cast(vec_id as string) chunk_id", "embedding as vector")
    store = Store(spark, f"{tmp_path}/cells")
    ann.build(store, rows)
    schema = "chunk_id string, vector array<float>"
    assert store.read_buckets("cells", schema).count() == rows.count()  # every row is in a cell
    asked = [r.vector for r in rows.where("cast(chunk_id as long) % 100 = 0").collect()][:20]
    found = 0
    for q in asked:
        want = {r.chunk_id for r in retrieval.top(retrieval.dense(rows, q), 10).collect()}
        found += len(want & {r.chunk_id for r in ann.search(store, q, 10, schema=schema).collect()})
    assert found >= 0.9 * 10 * len(asked), found
    ann.build(store, rows.limit(0))


def test_postings_are_built_without_a_shuffle(spark, monkeypatch):
    """In blocks of any size: as the postings by grouping all occurrences."""
    rows = [("1", "b a b", 0), ("2", None, 1), ("3", "", 1), ("4", "a A é b_b a", 2), ("5", "c " * 9 + "a", 2), ("6", "!", 3)]
    df = spark.createDataFrame(rows, "chunk_id string, content string, bucket int")
    for block in (1, 3, 100):
        monkeypatch.setattr(retrieval, "BLOCK_TOKENS", block)
        batch = df.select("chunk_id", "bucket", text.tokens(F.col("content")).alias("t")).toArrow().combine_chunks().to_batches()
        got = [r for b in retrieval._packed(iter(batch)) for r in b.to_pylist()]
        assert {(h["chunk_id"], h["dl"], h["bucket"]) for r in got if r["token"] == "" for h in r["held"]} == {("1", 3, 0), ("2", None, 1), ("3", 0, 1), ("4", 6, 2), ("5", 10, 2), ("6", 0, 3)}
        flat = {(r["token"], h["chunk_id"], h["tf"], tuple(p)) for r in got if r["token"] for h, p in zip(r["held"], r["positions"], strict=True)}
        assert all(r["df"] == len(r["held"]) and r["cf"] == sum(h["tf"] for h in r["held"]) for r in got)
        assert flat == {("a", "1", 1, (1,)), ("b", "1", 2, (0, 2)), ("a", "4", 3, (0, 1, 5)), ("b", "4", 2, (3, 4)), ("é", "4", 1, (2,)), ("c", "5", 9, tuple(range(9))), ("a", "5", 1, (9,))}
    packed = retrieval.packed_postings(df)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    posted, lengths = retrieval.unpacked(packed)
    assert sorted((r.token, r.chunk_id, r.tf) for r in posted.collect()) == sorted((r.token, r.chunk_id, r.tf) for r in retrieval.postings(df.drop("bucket")).collect())
    assert lengths.count() == len(rows)
    assert {(r.token, r.df, r.cf) for r in retrieval.term_stats(packed).collect()} == {("a", 3, 5), ("b", 2, 4), ("c", 1, 9), ("é", 1, 1)}


def test_batches_are_scored_in_place(spark, monkeypatch):
    """Against scores of all pairs, ties by id, in one pass and in several, from texts and from stored postings."""
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, range(30, 0, -1), k=rng.randint(1, 25))) for _ in range(60)]
    rows = [(str(i), t) for i, t in enumerate([*texts, *texts[:20], None, "", "!?"])]  # copies tie, three have no tokens
    chunks = spark.createDataFrame(rows, "chunk_id string, content string").repartition(3)
    asked = [(q, " ".join(rng.choices([*words, "none"], k=6)), None if q % 3 else q % 4) for q in range(12)] + [(20, "none", None), (21, "", 3), (22, None, 3)]
    queries = spark.createDataFrame(asked, "query_id long, query string, top_k int")
    bag = {c: t.split() for c, t in rows if t and t != "!?"}
    n, avg = len(bag), sum(map(len, bag.values())) / len(bag)
    want = set()
    for q, query, k in asked:
        scores = {}
        for w in set((query or "").split()):
            df = sum(w in t for t in bag.values())
            idf = max(math.log((n - df + 0.5) / (df + 0.5)), 0) or 1e-6
            for c, t in bag.items():
                if tf := t.count(w):
                    scores[c] = scores.get(c, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        best = sorted(scores, key=lambda c: (-round(scores[c], 9), c))[: 5 if k is None else k]
        want |= {(q, c, r + 1, round(scores[c], 6)) for r, c in enumerate(best)}
    bags = retrieval.bags(chunks)
    feeds = [(bags, retrieval.bag_figures(bags)), retrieval.bags_of_postings(*retrieval.index_postings(chunks), queries)]
    for feed, passes in ((0, 200_000), (0, 20), (1, 200_000)):
        monkeypatch.setattr(retrieval, "PASS_TOKENS", passes)
        got = retrieval.query_batch(*feeds[feed], queries, 5)
        assert {(r.query_id, r.chunk_id, r["rank"], round(r.score, 6)) for r in got.collect()} == want, (feed, passes)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan or feed  # no row for each query and posting


def test_evaluation_shuffles_no_texts(spark, sf_dir):
    from lodeseek.queries import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["retrieval_eval"](spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [x for x in plan.toString().splitlines() if "Join Inner" in x and "chunk_id" in x]
    assert len(joins) == 1 and "strategy=broadcast" in joins[0]


def test_terms_of_a_query_are_numbers_not_lists(spark):
    df = spark.createDataFrame([("1", "a b"), ("2", "b c"), ("3", "c")], "chunk_id string, content string")
    found = retrieval.bm25_indexed(*retrieval.index_postings(df), "a b c", "any")
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.chunk_id: r.score for r in found.collect()} == {r.chunk_id: r.score for r in retrieval.bm25(df, "a b c", "any").collect()}


def test_search_reads_the_blocks_of_its_tokens(spark, sf_dir):
    from lodeseek.queries import QUERIES

    plan = QUERIES["hybrid_sparse_only"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "/postings/" in x]
    assert scans and all("In(token, [the,worthless])" in x or "EqualTo(token,)" in x for x in scans)
    assert not any("positions" in x.split("ReadSchema")[1] for x in scans)


def test_search_builds_its_index_without_a_shuffle(spark, sf_dir, monkeypatch):
    from lodeseek import queries

    plans, write = [], queries.Store.write
    keep = lambda self, name, df, *more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(self, name, df, *more)
    monkeypatch.setattr(queries.Store, "write", keep)
    monkeypatch.setattr(queries, "_INDEX", {})
    for name in ("rerank", "hybrid_sparse_only"):
        queries._INDEX.clear()
        built = len(plans)
        queries.QUERIES[name](spark, sf_dir)
        assert len(plans) > built and not any("Exchange" in p for p in plans), name
