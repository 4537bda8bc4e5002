import html
import json
import os
import re
import shutil
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lanternfish.jobs import catalogue
from lanternfish.jobs.index import Index
from lanternfish.sources import listing
from lanternfish.streaming import watch

from .conftest import SMALL


def test_index_follows_files(spark, tmp_path):
    root, store = tmp_path / "src", tmp_path / "store"
    (root / "node_modules").mkdir(parents=True)
    (root / "pkg").mkdir()
    (root / "node_modules" / "x.js").write_text("function no() {}")
    (root / "notes.txt").write_text("no")
    (root / "pkg" / "auth.py").write_text("class Auth:\n    def login(self):\n        a = 1\n        b = 2\n        return a + b\n")
    (root / "web.ts").write_text("export class Web { go(): number { return 1; } }\n")
    index = Index(spark, str(root), str(store))
    assert index.build() == {"new": 2, "changed": 0, "deleted": 0, "same": 0, "files": 2, "symbols": 4, "errors": 0}
    status = {k: v for k, v in index.status().items() if k != "built_at"}
    assert status == {"state": "completed", "files": 2, "symbols": 4, "vectors": 3, "project_path": str(root)}  # the one-line method gets no vector
    assert index.build()["same"] == 2 and index.status() | status == index.status()
    assert index.symbols_named("Auth").first().symbol_id == "pkg/auth.py::Auth" == index.symbol("pkg/auth.py::Auth").first().symbol_id
    assert [r.path.rsplit("/", 1)[1] for r in index.find_files("*.ts").collect()] == ["web.ts"]
    body = index.symbol_body(str(root / "pkg" / "auth.py"), "login").first()
    assert body.tier == 3 and body.source.startswith("    def login")
    summary = index.file_summary(str(root / "pkg" / "auth.py")).first()
    assert [s.name for s in summary.symbols] == ["Auth", "Auth.login"]
    assert [(r.file, r.line) for r in index.search_code("LOGIN", case_sensitive=False).collect()] == [("pkg/auth.py", 2)]
    best = index.semantic_search("login").collect()
    assert best[0].file.endswith("auth.py")
    time.sleep(0.01)
    (root / "web.ts").unlink()
    (root / "pkg" / "auth.py").write_text("def other():\n    x = 1\n    y = 2\n    return x\n")
    done = index.build()
    assert done["deleted"] == 1 and done["changed"] == 1
    assert [r.name for r in index.symbols().collect()] == ["other"] and index.vectors().count() == 1


def test_index_keeps_itself(spark, tmp_path):
    """Files that aren't UTF-8, CRLF, single files, syncing, clearing, vectors put in."""
    root = tmp_path / "src"
    (root / ".git").mkdir(parents=True)
    (root / ".git" / "hook.py").write_text("x = 1")
    (root / "latin.py").write_bytes("# caf\xe9\r\ndef first():\r\n    a = 'na\xefve'\r\n    b = 2\r\n    return a\r\n".encode("latin-1"))
    (root / "feed.py").write_text("def one():\n    return 1\n\f\ndef two():\n    s = '\u2028'\n    return 2\n")
    index = Index(spark, str(root), str(tmp_path / "store"))
    assert index.build() | {"files": 2, "symbols": 3, "errors": 0} == index.build() | {"new": 2, "same": 0, "files": 2, "symbols": 3}
    assert index.symbol_body("latin.py", "first").first().source == "def first():\n    a = 'nave'\n    b = 2\n    return a"
    assert [(r.file, r.line) for r in index.search_code("return").collect()] == [("feed.py", 2), ("feed.py", 6), ("latin.py", 5)]
    assert {(r.name, r.line, r.end_line) for r in index.symbols().collect()} == {("first", 2, 5), ("one", 1, 2), ("two", 4, 6)}
    (root / "new.py").write_text("def three():\n    a = 1\n    b = 2\n    return 3\n")
    (root / "feed.py").unlink()
    assert index.sync()["deleted"] == 1 and index.file("new.py").count() == 0 and index.file("feed.py").count() == 0
    assert index.rebuild("./new.py")["new"] == 1 and index.symbol("new.py::three").count() == 1 and index.files().count() == 2
    (root / "latin.py").unlink()
    assert index.rebuild("latin.py")["deleted"] == 1 and [r.symbol_id for r in index.vectors().collect()] == ["new.py::three"]
    index.upsert_vectors(spark.createDataFrame([("new.py::three", "m", [1.0]), ("x::y", "m", [2.0])], "symbol_id string, model string, vector array<double>"))
    rows = {r.symbol_id: (r.vector, r.updated_at) for r in index.vectors().collect()}
    assert rows["new.py::three"][0] == [1.0] and len(rows) == 2 and len({at for _, at in rows.values()}) == 1
    index.store.set_meta(a="1", b="2")
    index.store.set_meta(b="3")
    assert (index.store.get_meta("a"), index.store.get_meta("b"), index.store.get_meta("c")) == ("1", "3", None)
    index.clear()
    assert index.status()["files"] == index.status()["symbols"] == index.status()["vectors"] == 0


def test_entry_without_the_corpus_side(tmp_path):
    """The rest works in a copy without the corpus package, its tests and the pipeline, or with an empty folder left."""
    home = Path(__file__).resolve().parent.parent
    shutil.copytree(home / "lanternfish", tmp_path / "lanternfish", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = set(e.queries()); assert set(e.oracle_sql()) <= q and 'hybrid_search' in q; print(len([n for n in q if n.startswith('op') or n == 'pipeline']))"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run().stdout.strip() == "0"
    (tmp_path / "lanternfish" / "llm").mkdir()
    assert run().stdout.strip() == "0"
    shutil.copy(home / "corpus_pipeline.py", tmp_path) if (home / "corpus_pipeline.py").exists() else None
    assert run().stdout.strip() == "0"


def test_html_symbols_equal_plain_patterns(spark):
    """Start tags by a pattern, attributes by another: the pages have no markup inside comments or scripts."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    found = {r.path: json.loads(r.symbols) for r in catalogue.html_symbols(spark, SMALL).collect()}
    assert len(found) == len(pages)
    for page in pages:
        text, want = page.html.replace("\r\n", "\n"), []
        bare = re.sub(r"(?s)<!--.*?-->|(?<=>)[^<]*(?=</(?:script|style)>)", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        for m in re.finditer(r"<([a-zA-Z][^\s/>]*)((?:\s+[^\s=>/]+(?:=(?:\"[^\"]*\"|'[^']*'|[^\s>]*))?)*)\s*(/?)>", bare):
            if not m[3]:
                a = {k.lower(): html.unescape(v.strip("\"'")) for k, v in re.findall(r"([^\s=>/]+)=(\"[^\"]*\"|'[^']*'|[^\s>]*)", m[2])}
                tag, line = m[1].lower(), text.count("\n", 0, m.start()) + 1
                want += [("element_id", a["id"], line)] if a.get("id") else []
                want += [("script_ref", a["src"], line)] if tag == "script" and a.get("src") else []
                want += [("style_ref", a["href"], line)] if tag == "link" and a.get("href") else []
                want += [("form_field", a.get("name") or a.get("id"), line)] if tag in ("input", "select", "textarea") and (a.get("name") or a.get("id")) else []
        assert [(s["type"], s["name"], s["line"]) for s in found[f"pages/{page.page_id}.html"]] == want


def test_states():
    index = Index.__new__(Index)
    index.state = "idle"
    index.move("queued")
    index.move("queued")
    with pytest.raises(ValueError):
        index.move("completed")


def test_listing_round_trip(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("x")
    (root / "b.htm").write_text("y")
    rows = listing.list_files(spark, str(root))
    listing.save_listing(rows, str(tmp_path / "out"))
    assert {(r.rel_path, r.language) for r in listing.load_listing(spark, str(tmp_path / "out")).collect()} == {("a.py", "python"), ("b.htm", "html")}
    assert {(r.language, r.n) for r in listing.breakdown(rows).collect()} == {("python", 1), ("html", 1), (None, 2)}


def test_watch(spark, tmp_path):
    events = spark.createDataFrame([("p", 0.0, "src/main.py", False), ("p", 0.2, "src/main.py", False), ("p", 0.3, ".git/HEAD", False), ("p", 0.4, "src/b.ts", False), ("p", 5.0, "c.dart", False), ("p", 5.1, "dir.py", True), ("p", 60.0, "d.py", False)], "project string, s double, src_path string, is_directory boolean")
    events = events.withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("long") + 1_700_000_000_000))
    runs = watch.debounced(watch.relevant(events), "project", "src_path").orderBy("window").collect()
    assert [r.paths for r in runs] == [["src/b.ts", "src/main.py"], ["c.dart"], ["d.py"]]
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    seen, heads = [], iter(["a", "a", "b", "b", "b", "b"])
    follow = watch.Watch(lambda: next(heads), lambda paths: seen.append(sorted(r.path for r in paths.collect())), lambda: seen.append("moved"))
    query = follow.start(watch.debounced(watch.relevant(stream), "project", "src_path"), str(tmp_path / "check"), availableNow=True)
    query.awaitTermination(120)
    assert seen == [["c.dart", "src/b.ts", "src/main.py"]]  # the last run waits for a later event
    assert follow.moved() and not follow.moved()


def test_every_query_has_sql_or_is_known():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in "orders lineitem part events documents embeddings pages benchmark labels conversations".split():
        connection.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    rows = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(rows.columns)
    result = duck.execute(catalogue.ORACLE_SQL[name])
    named = [d[0] for d in result.description]
    assert sorted(named) == columns
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    want = sorted((tuple(plain(r[named.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=str) == want


@pytest.mark.parametrize("name", ["html_start_tags", "html_symbols"])
def test_markup_equals_sql_on_pages_with_symbols(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    pages = [
        (1, '<html>\n<head><link rel=x href="s.css"><script src="a.js">if (a<b) "<p id=no>"</script>\r\n<body id="top" ID=\'last\'><p\nid=split class="a b">'),
        (2, '<form id=f><input name="q" id="i"><select id="s"><textarea name=t></textarea><input></form><!-- <p id="c"> --><br id="x"/><a href="é?x=1&amp;y">'),
        (3, None),
        (4, ""),
        (5, "no tags < here > at all\n\n"),
    ]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = catalogue.QUERIES[name](spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = connection.execute(catalogue.ORACLE_SQL[name]).fetchall()
    assert len(want) > 3
    columns = [d[0] for d in connection.description]
    assert sorted((tuple(r[c] for c in columns) for r in rows.collect()), key=str) == sorted(want, key=str)
