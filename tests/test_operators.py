import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lanternfish.operators import changes, languages, lookup, markup, parsing, ranking

SYMBOLS = [("auth::login", "/p/auth.py", "login", "login(user, pw)", "Auth", [1.0, 0.0]), ("auth::logout", "/p/auth.py", "logout", None, "Auth", [0.9, 0.1]), ("cache::get_cached", "/p/cache.py", "get_cached", None, "Cache", [0.0, 1.0]), ("db::query", "/p/db.py", "query", None, "DB", [0.6, 0.6])]


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame(SYMBOLS, "symbol_id string, path string, name string, signature string, parent string, vector array<double>")


@pytest.mark.parametrize(
    "vector,text,want",
    [
        ([1.0, 0.0], "", {"/p/auth.py": 0.7, "/p/db.py": 0.5975, "/p/cache.py": 0.35}),
        ([0.5, 0.5], "", {"/p/auth.py": 0.6233, "/p/db.py": 0.7, "/p/cache.py": 0.5975}),
        ([0.5, 0.5], "login", {"/p/auth.py": 0.8975, "/p/db.py": 0.7, "/p/cache.py": 0.5975}),
        ([0.0, 0.0], "login", {}),
    ],
)
def test_hybrid_search(spark, symbols, vector, text, want):
    query = spark.createDataFrame([(vector,)], "q array<double>")
    rows = ranking.hybrid_search(symbols, symbols.select("symbol_id", "vector"), query, text, "symbol_id", "path", "symbol_id", "vector", "name", "signature", "parent").collect()
    assert {r.file: r.score for r in rows} == want


def test_hybrid_search_keeps_five_of_a_file(spark):
    rows = spark.createDataFrame([(f"s{k}", "/f", [1.0, 0.1 * k], "n") for k in range(10)], "symbol_id string, path string, vector array<double>, name string")
    found = ranking.hybrid_search(rows, rows.select("symbol_id", "vector"), spark.createDataFrame([([1.0, 0.0],)], "q array<double>"), "", "symbol_id", "path", "symbol_id", "vector", "name").collect()
    assert [r.name for r in sorted(found, key=lambda r: r.rank)] == [f"s{k}" for k in range(5)]


def test_keyword_score(symbols):
    rows = ranking.keyword_search(symbols, "login", "symbol_id", "name", "signature", "parent").collect()
    assert [(r.symbol_id, round(r.score, 4)) for r in rows] == [("auth::login", 3.8326)]
    assert ranking.keyword_search(symbols, "-login", "symbol_id", "name").count() == 0


def test_postings_are_counted_in_rows(spark):
    """Rows with ids of their own need no shuffle; an id of several rows, null too, has the sum of them."""
    texts = [(1, "b a b", "A é"), (2, None, ""), (3, "  ", None), (4, "a.a", "x_1 B b")]

    def counts(rows):
        return Counter({(r.term, r.id): r.tf for r in rows.collect()})

    rows = ranking.postings(spark.createDataFrame(texts, "id int, text string, more string"), "id", "text", "more")
    assert counts(rows) == {("a", 1): 2, ("b", 1): 2, ("é", 1): 1, (".", 4): 1, ("a", 4): 2, ("x_1", 4): 1, ("b", 4): 2}
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    more = [(4, "b", None), (None, "b", "b"), (None, "b", "a")]
    rows = ranking.postings(spark.createDataFrame(texts + more, "id int, text string, more string"), "id", "text", "more")
    assert rows.count() == 9 and counts(rows)[("b", 4)] == 3 and counts(rows)[("b", None)] == 3 and counts(rows)[("a", None)] == 1
    long = spark.range(3).withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda x: x % 700), " "))
    assert {(r.n, r.tf) for r in ranking.postings(long, "id", "text").groupBy("id").agg(F.count("*").alias("n"), F.sum("tf").alias("tf")).collect()} == {(700, 60_000)}


def test_places_over_all_rows(spark):
    rows = ranking.place(spark.range(1000).withColumn("v", F.col("id") * 7 % 1000), F.floor(F.col("v") / 50), [F.col("v")]).collect()
    assert all(r.place == r.v + 1 for r in rows)


def test_tiers(spark):
    rows = spark.createDataFrame([("D.Get", "D.Get(int)"), ("Get", None), ("x", "Get"), ("x", "a.Get(b)"), ("no", "no()")], "name string, signature string")
    assert [r.t for r in rows.select(lookup.match_tier(F.col("name"), F.col("signature"), F.lit("Get")).alias("t")).collect()] == [3, 1, 2, 5, None]


def test_changes(spark):
    rows = spark.createDataFrame([(100.1234564, 100.12345649), (100.123456, 100.123457), (None, 1.0)], "a double, b double")
    assert [r.c for r in rows.select(changes.time_changed(F.col("a"), F.col("b")).alias("c")).collect()] == [False, True, True]
    table = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, "c")], "key string, at int, v string")
    assert {(r.key, r.v) for r in changes.keep_one(table, "key", ["at"], last=True).collect()} == {("k", "b"), ("m", "c")}
    assert {(r.key, r.v) for r in changes.keep_one(table, "key", ["at"], last=False).collect()} == {("k", "a"), ("m", "c")}
    parents, children = changes.delete_cascading(table.where("key = 'm'"), table, table.withColumnRenamed("key", "parent"), "key", "parent")
    assert parents.count() == children.count() == 2


def test_head_moves(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, "a"), (4, "b"), (5, None), (6, "b")], "t int, head string").withColumn("p", F.lit(1))
    found = changes.head_moves(rows, "p", ["t"], "head").orderBy("t").collect()
    assert [r.fired for r in found] == [False, False, False, True, False, False]


# ---- parsers


def found(parsed):
    return [(s.type, s.name, s.parent) for s in parsed.symbols]


def test_python():
    text = "import os, sys as s\nfrom ..a import b\n\nclass A(B):\n    @deco\n    def m(self, x: int = (1, 2)) -> str:\n        def hidden(): pass\n\n    class In:\n        pass\n\nif True:\n    async def f():\n        import late\n"
    parsed = languages.python(text)
    assert found(parsed) == [("class", "A", None), ("method", "A.m", "A"), ("class", "In", "A"), ("function", "f", None)]
    assert parsed.imports == ["os", "sys", "..a"]
    method = parsed.symbols[1]
    assert (method.line, method.end_line, method.signature) == (6, 7, "A.m(self, x: int = (1, 2))")
    broken = languages.python(text + "def g(:\n    pass\n")
    assert ("method", "A.m", "A") in found(broken) and broken.imports == ["os", "sys", "..a"]



def test_deep_text_that_does_not_parse_takes_linear_time():
    """20,000 nested lines, and ends as found by looking ahead from each line."""
    import random
    import time

    deep = "\n".join(" " * (k % 400) + f"class C{k}:" if k % 400 == 0 else " " * (k % 400) + f"x{k} = (" for k in range(20_000))
    began = time.time()
    parsed = languages.python(deep)
    assert len(parsed.symbols) == 50 and time.time() - began < 5
    r = random.Random(4)
    rows = [" " * r.randrange(5) + r.choice(["", "# note", "def f(:", "class A:", "x = 1"]) for _ in range(400)]
    for i, end in enumerate(languages._block_ends(rows)):
        if rows[i].strip():
            depth = len(rows[i]) - len(rows[i].lstrip())
            own = [i]
            for k in range(i + 1, len(rows)):
                if rows[k].strip() and len(rows[k]) - len(rows[k].lstrip()) <= depth:
                    break
                own += [k] if rows[k].strip() else []
            assert end == own[-1] + 1


def markup_of(spark, *texts):
    """Of each text its start tags and symbols."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    return rows.select("i", markup.start_tags(F.col("t")).alias("tags"), markup.symbols(F.col("t"), F.lit("a\\b.html")).alias("symbols")).orderBy("i").collect()


def test_html(spark):
    text = '<div id="a"><br id="no"/><script src="x.js">var id="q";</script><link href="s.css"><input name="n" id="i"><textarea id=t></textarea></div>'
    (row,) = markup_of(spark, text)
    assert [(s.type, s.name, s.parent) for s in row.symbols] == [("element_id", "a", None), ("script_ref", "x.js", None), ("style_ref", "s.css", None), ("element_id", "i", None), ("form_field", "n", None), ("element_id", "t", None), ("form_field", "t", None)]
    assert [s.symbol_id for s in row.symbols] == ["a/b.html::" + x for x in ("#a", "script:x.js", "link:s.css", "#i", "field:n", "#t", "field:t")]
    assert [s.signature for s in row.symbols] == ['id="a"', 'src="x.js"', 'href="s.css"', 'id="i"', "<input name='n'>", 'id="t"', "<textarea name='t'>"]


def test_html_tags_and_attributes(spark):
    tags = lambda row: [(t.tag, t.line, t.end_line, [tuple(a) for a in t.attributes]) for t in row.tags]
    rows = markup_of(
        spark,
        None,
        "",
        "a < b > c </p> <!-- <p id=c>\n --><p>",
        "<p\n id='a'\r\n class=b>\r<P ID=\"<x id='q'>\" id=''>\n<input id=\"it's\" id=k checked>",
        "<a id=1 <b id=2><SCRIPT>\n<p id=n></Script x><script/><i><STYLE><b></style><b id=last",
        "<a id='&amp;' title=it's x = \"y\">é<i id=ü href=a=b>\0<u>",
        "<a id=\"u\nv\">\n<!-- never ends <b>",
        "<input name=\"it's\"><input name='\"'><input name='a\\'>",
    )
    assert [tags(r) for r in rows] == [
        [],
        [],
        [("p", 2, 2, [])],
        [("p", 1, 3, [("id", "a"), ("class", "b")]), ("p", 4, 4, [("id", "<x id='q'>")]), ("input", 5, 5, [("id", "it's"), ("id", "k")])],
        [("b", 1, 1, [("id", "2")]), ("script", 1, 1, []), ("i", 2, 2, []), ("style", 2, 2, [])],
        [("a", 1, 1, [("id", "&amp;"), ("title", "it's"), ("x", "y")]), ("i", 1, 1, [("id", "ü"), ("href", "a=b")]), ("u", 1, 1, [])],
        [("a", 1, 2, [("id", "u\nv")])],
        [("input", 1, 1, [("name", "it's")]), ("input", 1, 1, [("name", '"')]), ("input", 1, 1, [("name", "a\\")])],
    ]
    assert [(s.name, s.line) for s in rows[3].symbols] == [("a", 1), ("<x id='q'>", 4), ("k", 5), ("k", 5)]
    assert [s.signature for s in rows[7].symbols] == [f"<input name={x!r}>" for x in ("it's", '"', "a\\")]


def test_html_in_linear_time(spark):
    """Marks that open without end, a quote in a quote, one long name, many tags: 1 MB each."""
    for text, n in (("<a b=\"<a b='\" " * 70000, 0), ('<a b="' * 150000, 0), ("<!--" * 250000, 0), ("<script>" * 120000, 1), ("<a " + "b" * 10**6, 0), ("<a>\n" * 250000, 250000)):
        began = time.time()
        rows = spark.createDataFrame([(text,)], "t string")
        assert rows.select(F.size(markup.start_tags(F.col("t")))).first()[0] == n
        assert time.time() - began < 60


def test_javascript():
    text = """import { a } from 'lib';
export class K { run(x) { if (x) { y(); } } }
export function top() { function inner() {} }
const arrow = (a, b) => { return a; };
const api = { get() { return 1; }, post: function () {}, deep: { put: () => 2 } };
Widget.prototype.draw = function () {};
app.controller('Main', function ($scope) { $scope.save = function () {}; });
"""
    parsed = languages.javascript(text)
    assert found(parsed) == [("class", "K", None), ("method", "run", "K"), ("function", "top", None), ("function", "arrow", None), ("method", "get", "api"), ("method", "post", "api"), ("method", "put", "deep"), ("method", "draw", "Widget"), ("method", "save", "Main")]
    assert parsed.imports == ["lib"] and parsed.exports == ["K", "top"]


def test_javascript_registrations_and_literals():
    text = """app.run(function () {});
angular.module('m', []).run('Start', function () { function go() {} });
app.module('No', function () { const f = () => 1; });
app.controller('Main', ['$scope', function ($scope) { $scope.save = function () {}; }]);
const r = /["'{]/g.test(x), s = a / b / c;
function after() { return /[/}]/.test(y); }
function last() {}
"""
    assert found(languages.javascript(text)) == [("function", "go", "Start"), ("function", "f", None), ("method", "save", "$scope"), ("function", "after", None), ("function", "last", None)]


@pytest.mark.parametrize("language", ["csharp", "dart"])
def test_scanners_are_linear(language):
    import time

    def seconds(n):
        text = "class A {\n" + "".join(f"  int m{k}(int x) {{\n    return x;\n  }}\n" for k in range(n)) + "}\n"
        began = time.process_time()
        assert len(languages.PARSERS[language](text).symbols) == n + 1
        return time.process_time() - began

    seconds(500)
    assert seconds(8000) < 10 * seconds(2000)


def test_typescript():
    text = "import x from './x';\nexport interface Shape { area(): number }\nexport type Id = string | number;\nenum Color { Red }\nexport class Sq implements Shape { area(): number { return 1; } }\n"
    parsed = languages.typescript(text)
    assert found(parsed) == [("interface", "Shape", None), ("type_alias", "Id", None), ("enum", "Color", None), ("class", "Sq", None), ("method", "area", "Sq")]
    assert parsed.exports == ["Shape", "Id", "Sq"]


def test_csharp():
    text = "using System;\nusing System.Text;\nnamespace N {\n  public class Doc {\n    private int f = 1;\n    public Doc(int x) { }\n    public string Get(int a, Foo b, List<int> c) { return Run(a); }\n    public void Go() => Run(1);\n  }\n  interface I { void M(); }\n}\n"
    parsed = languages.csharp(text)
    assert found(parsed) == [("class", "Doc", None), ("method", "Doc.Get", "Doc"), ("method", "Doc.Go", "Doc"), ("interface", "I", None), ("method", "I.M", "I")]
    assert parsed.symbols[1].signature == "Doc.Get(int,List<int>)" and parsed.imports == ["System", "System.Text"]


def test_dart():
    text = "import 'package:a/b.dart';\nclass W extends S {\n  int build(int x) {\n    return x;\n  }\n}\nmixin M { void go() {} }\nenum E { a, b }\nvoid main(List<String> args) { run(); }\n"
    parsed = languages.dart(text)
    assert found(parsed) == [("class", "W", None), ("method", "W.build", "W"), ("class", "M", None), ("method", "M.go", "M"), ("class", "E", None), ("function", "main", None)]
    assert parsed.imports == ["package:a/b.dart"] and parsed.symbols[1].end_line == 3


def test_parse_files(spark):
    rows = spark.createDataFrame([("a/x.py", b"class A:\r\n    pass\r\nclass A:\r\n    x = 1\r\n"), ("b.rb", b"x"), ("bin.py", b"a\0b"), ("late.py", b"#" * 9000 + b"\0")], "path string, content binary")
    parsed = {r.path: r for r in parsing.parse(rows).collect()}
    assert set(parsed) == {"a/x.py", "late.py"} and parsed["late.py"].error and parsed["a/x.py"].line_count == 5
    kept = parsing.symbols(parsing.parse(rows)).collect()
    assert [(r.symbol_id, r.line) for r in kept] == [("a/x.py::A", 3)]


def hot_events(spark):
    """Half of the events are of one user, a third of those at one time; users and times may be null."""
    import random

    r = random.Random(4)
    rows = []
    for k in range(600):
        user = 1 if k % 2 else r.choice([2, 3, None, 4])
        at = 500.0 if k % 6 == 1 else None if k % 97 == 0 else float(r.randrange(4000))
        rows.append((k, user, at, r.choice(["a", "b", None])))
    events = spark.createDataFrame(rows, "event_id long, user_id long, s double, head string")
    return rows, events.withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("long"))).drop("s")


@pytest.mark.parametrize("segments", [1, 7, 64])
def test_scans_of_hot_users(spark, segments):
    rows, events = hot_events(spark)
    key = lambda r: (r[2] is not None, r[2] or 0.0, r[0])
    want, runs = set(), []
    for user in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == user), key=key)
        for before, r in zip([None, *own], own):
            want.add((r[0], before is None, before and before[3], before and before[0]))
        run = []
        for at in sorted(r[2] for r in own if r[2] is not None):
            if run and at - run[-1] > 20:
                runs.append((user, run[0], run[-1], len(run)))
                run = []
            run.append(at)
        runs.append((user, run[0], run[-1], len(run)))
    found = changes.previous(events, "user_id", ["ts", "event_id"], {"head": "h", "event_id": "e"}, segments)
    assert {(r.event_id, r["__first"], r.h, r.e) for r in found.collect()} == want
    assert {tuple(r) for r in found.groupBy("__segment").count().where("count > 300").collect()} == ({(0, 600)} if segments == 1 else set())
    made = changes.sessions(events.where("ts is not null"), "user_id", "ts", 20, segments).collect()
    assert sorted((str(u), a, b, n) for u, a, b, n in runs) == sorted((str(r.user_id), r.first_ts.timestamp(), r.last_ts.timestamp(), r.n_events) for r in made)


def test_places_by_sort(spark, tmp_path):
    def keep(rows):
        rows.write.parquet(str(tmp_path / "kept"))
        return spark.read.parquet(str(tmp_path / "kept"))

    rows = ranking.place_sorted(spark.range(1000).withColumn("v", F.col("id") * 7 % 1000).repartition(5), [F.col("v")], keep).collect()
    assert len(rows) == 1000 and all(r.place == r.v + 1 for r in rows)
