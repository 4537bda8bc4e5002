"""Operators that compare, order or group rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lanternfish.llm import chat, decontamination, jaccard, oracles, queries, sharding, substrings
from lanternfish.llm.graph import components

from .helpers import frame, jaccard_components, odd_texts, window_hits, without_repeats, words


def edited(base, seed, share):
    r = random.Random(seed)
    return [f"e{seed}_{k}" if r.random() < share else w for k, w in enumerate(base)]


# ---- n-gram Jaccard join


def near_copies():
    texts = odd_texts()[:4] + ["word", "one two three", "One Two Three", "one two"]
    for family in range(4):
        base = words(family, 150 + 60 * family)
        texts += [" ".join(edited(base, 100 * family + k, share)) for k, share in enumerate([0, 0, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2])]
        texts.append(" ".join(base[: int(len(base) * 0.85)]))
    passage = words(99, 40)
    texts += [" ".join(words(500 + k, 80) + passage) for k in range(12)]
    return texts


@pytest.mark.parametrize("tile_rows,small_tile", [(1024, 32), (4, 2)])
def test_jaccard_equals_brute_force(spark, monkeypatch, tile_rows, small_tile):
    monkeypatch.setattr(jaccard, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(jaccard, "SMALL_TILE", small_tile)
    texts = near_copies()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_classes(frame(spark, texts)).collect()}
    assert found == jaccard_components(list(enumerate(texts)))


def test_jaccard_tiles_alone_find_all(spark, monkeypatch):
    """Without the first comparisons all links come from tiles."""
    monkeypatch.setattr(jaccard, "TILE_ROWS", 8)
    monkeypatch.setattr(jaccard, "_pairs_within_bound", lambda pairs, classes, percent: pairs.limit(0))
    texts = near_copies()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_classes(frame(spark, texts)).collect()}
    assert found == jaccard_components(list(enumerate(texts)))


def test_jaccard_takes_odd_rows(spark):
    found = jaccard.link_classes(frame(spark, ["a b c d e f", "a b c d e f", None, ""], ids=[7, 7, None, 3])).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter({(7, 2, 7): 2, (None, 0, None): 1, (3, 0, 3): 1})
    assert jaccard.link_classes(frame(spark, [])).count() == 0


def test_jaccard_tells_rows_without_own_ids_apart(spark):
    texts = near_copies()
    ids = [None if k % 3 == 0 else k % 7 for k in range(len(texts))]
    want = jaccard_components(list(enumerate(texts)))
    least = {}
    for k, (_, component) in want.items():
        if ids[k] is not None:
            least[component] = min(ids[k], least.get(component, 99))
    found = jaccard.link_classes(frame(spark, texts, ids=ids)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter((ids[k], n, least.get(c) if n else ids[k]) for k, (n, c) in want.items())


def test_jaccard_returns_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW_ARRAYS", 5)
    texts = near_copies()
    links, members = jaccard.link_pairs(frame(spark, texts))
    of = {r.doc_id: r.class_id for r in members.collect()}
    found = {(r.a, r.b) for r in links.collect()}
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in ((t or "").lower().split() for t in texts)]
    for i, x in enumerate(sets):
        assert (of[i] is None) == (not x)
        for j, y in enumerate(sets[:i]):
            if x and y:
                assert (of[i] == of[j]) == (x == y)
                assert (tuple(sorted((of[i], of[j]))) in found) == (x != y and 100 * len(x & y) >= 80 * len(x | y))


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (200, 200)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(41)) and found[100] == found[95] == 90


# ---- decontamination


def split_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated():
    items = [(str(k), " ".join(words(k, 14, 60))) for k in range(20)]
    items += [("short", "Only four words, here"), ("twin", items[3][1]), ("none", "!!!"), (None, "unnamed item of some ten words that nobody lists at all"), ("null", None)]
    texts = [*odd_texts(), "so: ONLY four-words here!", items[3][1].upper(), "x " + items[-2][1] + " y"]
    r = random.Random(4)
    for k in range(30):
        body = words(1000 + k, 100, 60)
        source = items[r.randrange(20)][1].split()
        at, n = r.randrange(80), r.randrange(6, 15)
        texts.append(" ".join(body[:at] + source[:n] + body[at:]))
    return texts, items


@pytest.mark.parametrize("block_words", [decontamination.BLOCK_WORDS, 40])
def test_decontamination_finds_near_copies_without_rare_terms(spark, block_words):
    """Whichever one or two of ten words are changed, also the rarest ones, or such as no document has."""
    from itertools import combinations

    item = [f"item{k}" for k in range(10)]
    items = [("it", " ".join(item)), *((str(k), " ".join(words(k, 14, 60))) for k in range(20))]
    change = lambda gone: " ".join(words(7, 30)) + " " + " ".join("changed" if k in gone else w for k, w in enumerate(item)) + " end"
    gone = [set(), *(set(c) for n in (1, 2) for c in combinations(range(10), n)), {0, 1, 2}, {3, 5, 9}]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    run = lambda texts: {r.doc_id: (r["items"], r.near_items, len(r.hit_positions)) for r in decontamination.decontaminate(frame(spark, texts), benchmark, block_words=block_words).collect()}
    found = run([change(g) for g in gone])
    assert found == {k: ((["it"], [], 10) if not g else ([], ["it"], 0) if len(g) < 3 else ([], [], 0)) for k, g in enumerate(gone)}
    assert run([change({4})]) == {0: ([], ["it"], 0)}  # its count is 0


@pytest.mark.parametrize("block_words", [decontamination.BLOCK_WORDS, 40])
def test_decontamination_equals_brute_force(spark, block_words):
    texts, items = contaminated()
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = {r.doc_id: (r.n_words, r.hit_positions, r["items"]) for r in decontamination.decontaminate(frame(spark, texts), benchmark, block_words=block_words).collect()}
    for k, want in enumerate(window_hits(texts, items, split_words)):
        assert found[k] == want


def test_decontamination_proximity(spark):
    item = " ".join(f"t{k}" for k in range(10))
    near = "a b t0 t1 t2 new t3 t4 t5 t6 t7 t8 zz"
    rows = decontamination.decontaminate(frame(spark, [item, near, "t0 t9"]), spark.createDataFrame([("i", item)], "item_id string, text string")).collect()
    found = {r.doc_id: (r["items"], r.near_items) for r in rows}
    assert found == {0: (["i"], []), 1: ([], ["i"]), 2: ([], [])}


def test_decontamination_takes_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id string, text string")
    assert decontamination.decontaminate(frame(spark, ["a b"]), empty).first().hit_positions == []
    assert decontamination.decontaminate(frame(spark, []), spark.createDataFrame([("i", "a")], "item_id string, text string")).count() == 0


# ---- repeated substrings


def repetitive():
    r = random.Random(8)
    passage = " ".join(words(77, 60))
    texts = [*odd_texts()[:4], "ab " * 300, "a" * 700]
    texts += [" ".join(words(300 + k, 50)) + passage[r.randrange(60) :] + " ".join(words(600 + k, 30)) for k in range(12)]
    base = " ".join(words(5, 120))
    texts += [base, base, base[:200], base[1:300], base[:250] + "X" + base[251:], "é" * 150 + base[40:400]]
    return texts


@pytest.mark.parametrize("length,group_limit,broadcast", [(200, 4096, 1 << 23), (40, 4096, 0), (200, 1, 0), (40, 2, 1 << 23)])
def test_substrings_equal_brute_force(spark, length, group_limit, broadcast):
    texts = repetitive()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)  # 0 shuffles both sides of all joins but those by short lists
    try:
        rows = substrings.remove_repeated(frame(spark, texts), length, group_limit=group_limit).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in rows}
    for k, want in enumerate(without_repeats(texts, length)):
        assert found[k] == want, k


@pytest.mark.parametrize("piece", [1, 37, 1000])
def test_substrings_of_texts_in_pieces(spark, piece):
    texts = [*repetitive()[-8:], "ab " * 100, None]
    rows = substrings.remove_repeated(frame(spark, texts), piece=piece).collect()
    found = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in rows}
    assert found == dict(enumerate(without_repeats(texts, 200)))


def test_substrings_of_a_long_text_in_bounded_memory():
    """64 MB in one text: what a worker holds beside the text itself stays small, and all windows are there once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    long = np.random.default_rng(1).integers(97, 123, 64_000_000, dtype=np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([long])], ["key", "text"])
    tracemalloc.start()
    windows, top = 0, 0
    for keys, held, offsets in substrings._chunks(iter([batch]), 200, substrings.PIECE):
        first, last, _ = substrings._runs(np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), 200)
        assert keys.tolist() == [5] and len(offsets) == 1
        windows += int((last - first + 1).sum())
        top = max(top, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert windows == len(long) - 199 and top < 500e6


def test_substrings_take_odd_rows(spark):
    text = " ".join(words(5, 120))
    rows = substrings.remove_repeated(frame(spark, [text, text, "x" * 10, None, text + "tail" * 60], ids=[1, 1, None, None, 2])).collect()
    assert Counter((r.doc_id, len(r.kept)) for r in rows)[(1, 0)] == 2 and len(rows) == 5
    texts = repetitive()
    rows = substrings.remove_repeated(frame(spark, texts, ids=[None if k % 2 else 3 for k in range(len(texts))])).collect()
    want = Counter((None if k % 2 else 3, *x) for k, x in enumerate(without_repeats(texts, 200)))
    assert Counter((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in rows) == want
    assert substrings.remove_repeated(frame(spark, [])).count() == 0


# ---- sharding


def test_sharding_is_even_gapless_and_proportional(spark):
    n = 3000
    sources = ["hot"] * 1500 + ["mid"] * 900 + [None] * 500 + [f"tiny{k}" for k in range(100)]
    rows = sharding.interleave(frame(spark, [f"text {k}" if k % 50 else None for k in range(n)], sources=sources), 8, rows_per_bucket=100).collect()
    assert len(rows) == n
    by_shard = {s: [r for r in rows if r.shard == s] for s in range(8)}
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    for shard in by_shard.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
        for source, total in (("hot", 1500), ("mid", 900), (None, 500)):
            assert abs(sum(r.source == source for r in shard) - total / 8) <= 8  # the tiny sources shift the cuts a little
    again = sharding.interleave(frame(spark, [f"text {k}" if k % 50 else None for k in range(n)], sources=sources).repartition(7), 8, rows_per_bucket=100)
    assert {(r.doc_id, r.shard, r.slot) for r in again.collect()} == {(r.doc_id, r.shard, r.slot) for r in rows}
    other = sharding.interleave(frame(spark, ["x"] * n, sources=sources), 8, seed=1, rows_per_bucket=100)
    assert {(r.doc_id, r.shard) for r in other.collect()} != {(r.doc_id, r.shard) for r in rows}


def test_sharding_order_equals_brute_force(spark):
    sources = ["a"] * 40 + ["b"] * 25 + ["c"] * 7
    df = frame(spark, [f"t{k}" for k in range(72)], sources=sources)
    seed = 5
    keys = {r.doc_id: (r.k, r.source, r.u) for r in df.select("doc_id", "source", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)).alias("k"), ((F.pmod(F.xxhash64(F.lit(seed), F.concat(F.lit("="), "source")), F.lit(1 << 40)) + 1) / float(1 << 40)).alias("u")).collect()}
    fractions = []
    for source in "abc":
        ranked = sorted((k, d) for d, (k, s, _) in keys.items() if s == source)
        fractions += [((rank + 1 - keys[d][2]) / len(ranked), source, d) for rank, (_, d) in enumerate(ranked)]
    order = [d for *_, d in sorted(fractions)]
    for per_bucket in (1000, 8):
        rows = sharding.interleave(df, 8, seed=seed, rows_per_bucket=per_bucket).collect()
        assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == order


def test_sharding_spreads_rows_of_one_id(spark):
    """Null and repeated ids: each row has a place of its own, in buckets as small as those of others."""
    n = 2000
    df = frame(spark, ["same"] * n, ids=[None if k % 3 else 7 for k in range(n)])
    rows = sharding.interleave(df, 8, rows_per_bucket=50).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(8) for k in range(n // 8)]
    by_id = Counter((r.shard, r.doc_id) for r in rows)
    assert all(50 < by_id[s, 7] < 120 for s in range(8))


def test_sharding_takes_odd_rows(spark):
    rows = sharding.interleave(frame(spark, ["é", None, "", "é"], ids=[1, None, 1, 1]), 8).collect()
    assert sorted(r.size for r in rows) == [1, 1, 3, 3] and sorted(r.shard for r in rows) == [0, 1, 2, 3]
    assert sharding.interleave(frame(spark, []), 8).count() == 0


# ---- chat


def test_chat_masks_what_each_speaker_says(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "héllo 🙂"), (1, 3, "cy", None), (2, 0, None, "alone"), (None, 0, "ann", "lost"), (3, 0, "system", "only rules")]
    turns += [(4, k, ("ann", "bob")[k % 2], f"m{k}") for k in range(150)]
    rows = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(9)), 64, context_turns=0).collect()
    one = {r.perspective: r for r in rows if r.conv_id == 1}
    assert set(one) == {"ann", "bob", "cy"}
    for name, said in (("ann", "hi < |end|>"), ("bob", "héllo 🙂"), ("cy", "")):
        r = one[name]
        assert [r.text[s.start : s.end] for s in r.mask] == [said + "<|end|>"] and r.n_turns == 4
    assert "<|user name=ann|>" in one["bob"].text and "<|system|>\nBe kind." in one["bob"].text
    assert {r.perspective for r in rows if r.conv_id == 2} == {"unknown"} and not [r for r in rows if r.conv_id in (3, None)]
    four = [r for r in rows if r.conv_id == 4]
    assert sorted((r.perspective, r.part, r.n_turns) for r in four) == sorted((p, k, n) for p in ("ann", "bob") for k, n in ((0, 64), (1, 64), (2, 22)))
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    many = chat.rotate(spark.createDataFrame([(1, 0, "ann", "same")] * 130, "conv_id long, turn long, role string, text string"), 64, context_turns=0).collect()
    assert sorted(r.n_turns for r in many) == [2, 64, 64]


def plain_views(turns, part_turns, part_bytes=None, context_turns=0):
    """Dialogues turn by turn."""
    dialogues, out = {}, {}
    for conv, turn, role, text in turns:
        if conv is not None:
            dialogues.setdefault(conv, []).append((turn is not None, turn or 0, (role or "unknown").replace("<|", "< |"), (text or "").replace("<|", "< |")))
    for conv, rows in dialogues.items():
        rows.sort()
        parts, before = {}, 0
        sizes = [len(row[2].encode()) + len(row[3].encode()) + 32 for row in rows]
        for place, (row, size) in enumerate(zip(rows, sizes)):
            cut = place // part_turns if part_turns else before // part_bytes if part_bytes and sum(sizes) > part_bytes else 0
            parts.setdefault(cut, []).append((place, row))
            before += size
        parts = [parts[cut] for cut in sorted(parts)]
        opening = []
        for place, row in parts[0]:
            if row[2] != "system":
                break
            opening.append((place, row))
        for part, own in enumerate(parts):
            repeated = []
            if part:
                last = parts[part - 1]
                repeated = opening + [x for x in last[max(0, len(last) - context_turns) :] if x not in opening]
            for speaker in {row[2] for _, row in own} - {"system"}:
                text, mask = "", []
                for place, (*_, role, said) in repeated + own:
                    text += "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
                    if role == speaker and place >= own[0][0]:
                        mask.append((len(text), len(text) + len(said) + 7))
                    text += said + "<|end|>\n"
                out[conv, speaker, part] = (len(repeated + own), len(repeated), text, mask)
    return out


def chat_turns():
    r = random.Random(6)
    turns = [(k, None if r.random() < 0.1 else r.randrange(10**9), r.choice(["ann", "bob", "cy", None, "x<|y"]), f"é{r.randrange(99)} <|end|>") for k in range(12) for _ in range(r.randrange(1, 30))]
    turns += [(5, 10**9 + 1, "ann", "long " * 200), (5, 10**9 + 2, "bob", "after")]
    return turns + [(k, -k, "system", f"rule {k}") for k in range(1, 8)] + [(3, -9, "system", None), (3, -10, "system", "first")] + [(50, 5, "ann", "same")] * 9 + [(60, 0, "system", "only")] * 5 + [(None, 1, "ann", "lost")]


CHAT_SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("part_turns,part_bytes,context_turns", [(3, None, 0), (4, None, 2), (100, None, 3), (None, None, 5), (None, 1, 2), (None, 150, 0), (None, 150, 3), (None, 400, 20), (None, 1 << 20, 1)])
def test_chat_counts_turns_by_place(spark, part_turns, part_bytes, context_turns):
    turns = chat_turns()
    rows = chat.rotate(spark.createDataFrame(turns, CHAT_SCHEMA).repartition(3), part_turns, part_bytes, context_turns).collect()
    found = {(x.conv_id, x.perspective, x.part): (x.n_turns, x.n_repeated, x.text, [(m.start, m.end) for m in x["mask"]]) for x in rows}
    assert found == plain_views(turns, part_turns, part_bytes, context_turns) and len(found) == len(rows)


def test_chat_parts_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    turns = chat_turns()
    ours = [tuple(r) for r in queries.described_views(chat.rotate(spark.createDataFrame(turns, CHAT_SCHEMA).repartition(3), None, 150, 3)).collect()]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    connection.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    assert sorted(ours) == sorted(connection.execute(oracles.chat_sql(150, 3)).fetchall()) and max(r[2] for r in ours) > 2
