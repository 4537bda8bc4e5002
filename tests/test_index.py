"""The index as a store that several writers share: postings, parts, versions, embedding, listing."""

import os
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lanternfish.jobs import index as jobs
from lanternfish.jobs.index import Index
from lanternfish.operators import ranking
from lanternfish.sources import listing
from lanternfish.sources.store import Change, Conflict, Store

BODY = "def {name}(request):\n    token = request.headers\n    result = lookup(token, {k})\n    return result\n"


def tree(root, n, first=0):
    root.mkdir(exist_ok=True)
    for k in range(first, first + n):
        (root / f"m{k}.py").write_text(BODY.format(name=f"handle_{k}", k=k))


def merged(index):
    return Counter({(r.term, r.symbol_id): r.tf for r in ranking.merged_postings(index.postings(), "symbol_id").collect()})


def anew(index):
    return Counter({(r.term, r.symbol_id): r.tf for r in ranking.postings(index.symbols(), "symbol_id", *jobs.TEXT).collect()})


def test_postings_follow_changes(spark, tmp_path):
    """Stored postings are those of all symbols, made anew, after each kind of change; only changed terms are added."""
    root = tmp_path / "src"
    tree(root, 6)
    index = Index(spark, str(root), str(tmp_path / "store"), parts=16)
    index.build()
    assert merged(index) == anew(index) and len(merged(index)) > 60
    first = index.store.latest()
    (root / "m1.py").write_text(BODY.format(name="handle_1", k=1).replace("token", "cookie"))
    (root / "m2.py").unlink()
    tree(root, 1, first=9)
    index.rebuild("m1.py", "m2.py", "m9.py")
    assert merged(index) == anew(index)
    added = spark.read.parquet(*{f"{tmp_path}/store/postings/{f}/part={k}" for k, fs in index.store.latest().tables["postings"].items() for f in fs if f not in first.folders("postings", k)})
    of_one = {(r.term, r.tf) for r in added.where("symbol_id like 'm1.py%'").collect()}
    assert of_one == {("token", -2), ("cookie", 2)}  # other terms of the file stay
    for query in ("token cookie lookup", "handle_9", "-token", "nothing at all", ""):
        want = {(r.symbol_id, r.score) for r in ranking.keyword_search(index.symbols(), query, "symbol_id", *jobs.TEXT).collect()}
        assert {(r.symbol_id, r.score) for r in index.keyword_search(query).collect()} == want
    assert index.compact(merge_from=2) > 0 and merged(index) == anew(index)
    assert max(len(f) for f in index.store.latest().tables["postings"].values()) == 1 and index.compact(merge_from=2) == 0
    read = index.postings(index.store.parts_of(spark.createDataFrame([("cookie",)], "term string"), F.col("term")))
    assert len(read.inputFiles()) < len(index.postings().inputFiles())


def test_a_change_writes_its_parts_alone(spark, tmp_path):
    root = tmp_path / "src"
    tree(root, 300)
    index = Index(spark, str(root), str(tmp_path / "store"), parts=64)
    index.build()
    before = index.store.latest()
    time.sleep(0.01)
    (root / "m7.py").write_text(BODY.format(name="handle_7", k=700))
    assert index.build()["changed"] == 1
    now = index.store.latest()
    for name in ("files", "symbols", "vectors"):
        parts = {k for k in before.tables[name] if before.folders(name, k) != now.folders(name, k)}
        assert len(parts) == 1 and len(before.tables[name]) > 50
    size = lambda version, name, k: sum(x.stat().st_size for f in version.folders(name, k) for x in (tmp_path / "store" / name / f / f"part={k}").iterdir() if x.suffix == ".parquet")
    written = sum(size(now, "symbols", k) for k in now.tables["symbols"] if before.folders("symbols", k) != now.folders("symbols", k))
    assert written * 20 < sum(size(now, "symbols", k) for k in now.tables["symbols"])
    # one symbol, one file: a part of the table is opened
    for found in (index.symbol("m7.py::handle_7"), index.file("m7.py")):
        assert found.count() == 1 and len(found.inputFiles()) <= 2
    assert index.symbols_named("handle_7").count() == 1 and index.symbol("no.py::no").count() == 0
    # names know the parts of their symbols: what is opened for one doesn't grow with the table
    bytes_read = lambda found: sum(os.path.getsize(f.removeprefix("file://")) for f in found.inputFiles())
    assert len(index.symbols_named("handle_7").inputFiles()) == 1 and bytes_read(index.symbols_named("handle_7")) * 20 < bytes_read(index.symbols())
    assert index.symbols_named("no such name").inputFiles() == []


def test_names_follow_changes(spark, tmp_path):
    """Symbols by name after files are changed, renamed and deleted, as in all symbols; also once deltas are merged."""
    root = tmp_path / "src"
    tree(root, 4)
    index = Index(spark, str(root), str(tmp_path / "store"), parts=8)
    index.build()
    (root / "m0.py").write_text(BODY.format(name="handle_1", k=5) + BODY.format(name="other", k=6))
    (root / "m2.py").unlink()
    index.rebuild("m0.py", "m2.py")

    def check():
        for name in ("handle_0", "handle_1", "handle_2", "handle_3", "other"):
            assert index.symbols_named(name).collect() == index.symbols().where(F.col("name") == name).orderBy("symbol_id").collect()
        assert [len(index.symbols_named(n).collect()) for n in ("handle_0", "handle_1", "handle_2", "other")] == [0, 2, 0, 1]

    check()
    index.compact(merge_from=2)
    assert max(len(f) for f in index.store.latest().tables["names"].values()) == 1
    check()
    index.clear()
    assert index.symbols_named("other").count() == 0


def test_old_versions_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), parts=4)
    rows = lambda n: spark.range(n).select(F.col("id").cast("string").alias("k"))
    for n in (10, 20, 30, 40):
        store.update(lambda base: Change(replaced=store.replacing(store.write("t", rows(n), F.col("k"), ["k"]), range(4))))
    store.write("t", rows(5), F.col("k"), ["k"])  # as of a writer that died
    assert store.vacuum(keep=2) == 0  # all folders are new
    assert [x.name for x in (tmp_path / "store" / "_versions").iterdir() if x.suffix == ".json"].__len__() == 2
    assert store.vacuum(keep=2, grace=-1) == 3 and store.read("t", "k string").count() == 40
    assert store.read("t", "k string", version=store.version(3)).count() == 30
    assert len(list((tmp_path / "store" / "t").iterdir())) == 2


def test_two_writers_lose_nothing(spark, tmp_path):
    """Sessions that write at once: other parts are added up, the same part is done anew, and readers see whole versions."""
    one, two = (Store(s, str(tmp_path / "store"), parts=8) for s in (spark, spark.newSession()))
    schema, errors = "k string, n bigint", []

    def count_up(store, keys):
        def work(base):
            session = store.spark
            table = session.createDataFrame([(k,) for k in keys], "k string")
            parts = store.parts_of(table, F.col("k"))
            old = store.read("t", schema, parts, base)
            new = old.join(table, "k", "left_anti").unionByName(table.join(old, "k", "left").select("k", (F.coalesce("n", F.lit(0)) + 1).alias("n")))
            return Change(replaced=store.replacing(store.write("t", new, F.col("k"), ["k"]), parts))

        try:
            for _ in range(4):
                store.update(work)
        except Exception as why:
            errors.append(why)

    threads = [threading.Thread(target=count_up, args=x) for x in ((one, ["a", "b"]), (two, ["b", "c"]))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and {r.k: r.n for r in one.read("t", schema).collect()} == {"a": 4, "b": 8, "c": 4}
    assert one.latest().number == 8


def test_commits_check_what_they_were_made_from(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    base = store.latest()
    store.commit(base, Change(replaced={"t": {"1": ["x"]}, "u": {"1": ["y"]}}, meta={"a": "1"}))
    store.commit(base, Change(replaced={"t": {"2": ["z"]}}, added={"u": {"1": ["w"]}}))
    assert store.latest().tables == {"t": {"1": ["x"], "2": ["z"]}, "u": {"1": ["y", "w"]}}
    for stale in (Change(replaced={"t": {"1": ["q"]}}), Change(same={"u": [1]}), Change(meta={"a": "2"}, guarded=["a"])):
        with pytest.raises(Conflict):
            store.commit(base, stale)
    second = store.version(1)
    with pytest.raises(Conflict):
        store.commit(second, Change(replaced={"u": {"1": ["m"]}}))
    assert store.commit(second, Change(replaced={"u": {"1": ["m"]}}, beside_added=True)).folders("u", 1) == ["m", "w"]
    store.set_meta(a=None)
    assert store.get_meta("a") is None


def test_leases(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.lease("build", "me", 60) and store.lease("build", "me", 60) and not store.lease("build", "you", 60)
    store.release("build", "you")
    assert not store.lease("build", "you", 60)
    store.release("build", "me")
    assert store.lease("build", "you", 0.01)
    time.sleep(0.05)
    assert store.lease("build", "me", 60)  # yours is over
    root = tmp_path / "src"
    tree(root, 1)
    index = Index(spark, str(root), str(tmp_path / "store"))
    assert index.build() == {"already_in_progress": 1} == index.sync() and index.rebuild("m0.py")["new"] == 1
    store.release("build", "me")
    assert index.build()["same"] == 1


def test_failed_batches_stay_pending(spark, tmp_path, monkeypatch):
    root, log = tmp_path / "src", tmp_path / "log"
    tree(root, 12)
    log.mkdir()

    def embedder(texts):
        if any("handle_5" in t for t in texts) and not os.path.exists(f"{log}/mended"):
            raise RuntimeError("no vector")
        if any("handle_8" in t for t in texts) and not os.path.exists(f"{log}/mended"):
            return [[1.0]]
        return [[1.0, 2.0]] * len(texts)

    monkeypatch.setattr(jobs.embedding.batched, "__defaults__", (3,))  # three texts a batch, two batches a wave
    index = Index(spark, str(root), str(tmp_path / "store"), embedder=embedder, wave_batches=2, parts=8)
    index.build()
    assert index.embedding == {"embedded": 6, "pending": 6, "failed_batches": 2} and index.vectors().count() == 6
    missing = {r.symbol_id for r in index.symbols().join(index.vectors(), "symbol_id", "left_anti").collect()}
    order = sorted(f"m{k}.py::handle_{k}" for k in range(12))
    assert missing == {s for k in range(4) for s in order[3 * k : 3 * k + 3] if any(b in order[3 * k : 3 * k + 3] for b in ("m5.py::handle_5", "m8.py::handle_8"))}
    (log / "mended").touch()
    assert index.build()["same"] == 12 and index.embedding == {"embedded": 6, "pending": 0, "failed_batches": 0}
    assert index.vectors().count() == 12


def test_waves_are_committed_one_by_one(spark, tmp_path, monkeypatch):
    """A job that dies in its second wave leaves the first; the next one goes on from there."""
    root = tmp_path / "src"
    tree(root, 6)
    monkeypatch.setattr(jobs.embedding.batched, "__defaults__", (2,))
    index = Index(spark, str(root), str(tmp_path / "store"), wave_batches=1, parts=8)
    commit, waves = index._commit_vectors, []

    def dies(found, rows):
        waves.append(1)
        if len(waves) == 2:
            raise KeyboardInterrupt
        return commit(found, rows)

    monkeypatch.setattr(index, "_commit_vectors", dies)
    with pytest.raises(KeyboardInterrupt):
        index.build()
    assert index.vectors().count() == 2 and index.symbols().count() == 6
    other = Index(spark, str(root), str(tmp_path / "store"), parts=8)
    assert other.build()["same"] == 6 and other.embedding["embedded"] == 4


def test_no_pruned_folder_is_listed(spark, tmp_path):
    root = tmp_path / "src"
    for place in ("a/b/node_modules/deep/x", "a/.hidden/y", "a/b/c", "node_modules/z", "a/dist"):
        (root / place).mkdir(parents=True)
        (root / place / "f.py").write_text("x = 1")
    (root / "a" / "loop").symlink_to(root / "a")
    (root / "a" / "[odd] {name}*.py").write_text("y = 2")
    rounds = []

    def keep(rows):
        rounds.append(rows.persist())
        return rounds[-1]

    found = listing.list_files(spark, str(root), keep)
    assert {r.rel_path for r in found.collect()} == {"a/b/c/f.py", "a/[odd] {name}*.py"}
    seen = {r.rel_path for rows in rounds for r in rows.collect()}
    assert "a/b/node_modules" in seen and not any(x.startswith(("a/b/node_modules/", "a/.hidden/", "node_modules/", "a/dist/", "a/loop")) for x in seen)
    assert len(rounds) == 4
    assert {r.rel_path: bytes(r.content) for r in listing.with_content(found, str(root)).collect()} == {"a/b/c/f.py": b"x = 1", "a/[odd] {name}*.py": b"y = 2"}
    few = listing.list_paths(spark, str(root), [f"{root}/a/b/c/f.py", f"{root}/gone.py", f"{root}/a/dist/f.py", f"{root}/../x.py"])
    assert [r.asDict() for r in few.collect()] == [r.asDict() for r in found.select(*few.columns).where("rel_path like '%f.py'").collect()]


def test_search_reads_candidates_alone(spark, tmp_path):
    root = tmp_path / "src"
    tree(root, 20)
    (root / "odd.py").write_text("x = 'Needle' + \"hay\"\ny = 'NEEDLE'\nz = needless\n")
    index = Index(spark, str(root), str(tmp_path / "store"), parts=4)
    index.build()
    assert [r.rel_path for r in index.search_candidates("Needle|hay[st]ack").collect()] == ["odd.py"]
    assert [(r.file, r.line) for r in index.search_code("Needle").collect()] == [("odd.py", 1)]
    assert [(r.file, r.line) for r in index.search_code("needle", case_sensitive=False).collect()] == [("odd.py", 1), ("odd.py", 2), ("odd.py", 3)]
    assert index.search_candidates("handle_1[0-9]").count() == 11 and index.search_code("handle_1[0-9]").count() == 10
    assert index.search_candidates(r"\bx|y\b").count() == 21  # too short to tell
    time.sleep(0.01)
    (root / "m3.py").write_text("needle = 1\n")
    (root / "new.py").write_text("a = needle\n")
    (root / "odd.py").unlink()
    assert [(r.file, r.line) for r in index.search_code("needle").collect()] == [("m3.py", 1), ("new.py", 1)]  # as files are now
    index.rebuild("m3.py", "new.py", "odd.py")
    assert sorted(r.rel_path for r in index.search_candidates("needle").collect()) == ["m3.py", "new.py"]


PATTERNS = ["needle", "nee(dle|t)", "(tion|ment)[ .,]", "abc|de", "(abc|def)ghi", "x[ab]yz", "x[a-z]yz", "a{3}bcd", "(abc)+d", "(abc)*d", "(abc)?def", "^abc$", r"\babc\d", "ab.cde", "(?i)ABC", "(?:ab)(?:cd)", r"a\.bc", "[^a]bcd", "abc(?=d)def", "abc(?!x)", "", "a", "(", r"\p{L}abc", "[a-c&&[b]]bcd", "[[ab]]cd", "abcd++e", "ab(?i)cd", "xyz|", "(abc|(de|fg)hi)jkl", "ab\nc", "[abc][abc][abc][abc]de"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_clauses_hold_for_all_that_matches(pattern):
    import random
    import re

    from lanternfish.operators import trigrams

    needed = trigrams.clauses(pattern)
    try:
        compiled = re.compile(pattern)
    except re.error:
        assert needed == []
        return
    r = random.Random(7)
    pieces = ["needle", "need", "tion", "ment", " ", ".", "abc", "ABC", "de", "def", "ghi", "x", "xa", "yz", "aaa", "bcd", "d", "1", "cde", "hi", "jkl", "fg", "\n", "ab", "cd"]
    matched = 0
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 6)))
        if compiled.search(text) and "\n" not in pattern:
            matched += 1
            low = text.lower()
            assert all(any(all(g in low for g in alternative) for alternative in clause) for clause in needed), text
    assert matched or pattern in ("a{3}bcd", "[[ab]]cd", "ab\nc", "[a-c&&[b]]bcd", "abcd++e", "(abc)+d", r"a\.bc")


def test_clauses_are_those_one_would_name():
    from lanternfish.operators import trigrams

    say = lambda pattern: [sorted("+".join(sorted(a)) for a in clause) for clause in trigrams.clauses(pattern)]
    assert say("(tion|ment)[ .,]") == [sorted(f"{a}+{b}+{c}" for w in ("tion", "ment") for x in " .," for a, b, c in [sorted([w[:3], w[1:], w[2:] + x])])]
    assert say("abc.*def") == [["abc"], ["def"]] and say("(abc|xyz.*)d") == [["abc", "xyz"]] and say("abc|d") == []
    assert say("(abc)+") == [["abc"]] and say("(abc)*") == [] and say(r"\p{L}abc") == [] and say("(?i)ABC") == [["abc"]]
