"""The pipeline against a brute-force version, stage by stage, and what it keeps."""

import hashlib
import random

import pytest

import corpus_pipeline
from lanternfish.llm import language, secrets

from .helpers import jaccard_components, window_hits
from .test_corpus_operators import split_words

public_tokenizers = pytest.importorskip("public_tokenizers")

SYLLABLES = {"aa": ["ba", "do", "gu", "lo", "ma"], "bb": ["shi", "tze", "kri", "pne", "vly"]}


def prose(seed, lang, n):
    r = random.Random(seed)
    return ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(2, 5))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    items = [(k, " ".join(prose(9000 + k, "aa", 20))) for k in range(5)]
    rows = []
    for k in range(60):
        lang = ("aa", "bb")[k % 2]
        rows.append((k, " ".join(prose(k, lang, 90)), lang, f"src{k % 3}"))
    base = prose(3, "bb", 90)
    rows += [(100, " ".join(base), "bb", "x"), (101, " ".join([*base[:88], "changed", "end"]), "bb", "x"), (102, " ".join(base[:60]), "bb", "x")]
    rows += [(103, " ".join(prose(103, "aa", 60)) + " " + items[2][1], "aa", "x"), (104, " ".join(prose(104, "aa", 60)) + ' token = "0123456789abcdef01234567" end', "aa", "x")]
    rows += [(105, None, None, None), (106, "", "aa", "x"), (107, "12345 678", "bb", "x")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_pipeline_equals_brute_force(spark, corpus):
    import tiktoken

    from lanternfish.llm.bpe import read_ranks

    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    classifier = language.Classifier(language.fit(docs.where(~language.held_out())))
    kept = [(i, t) for i, t, *_ in rows if classifier.predict((t or "").encode())[1] >= language.MIN_MARGIN]
    component = jaccard_components(kept)
    kept = [(i, t) for i, t in kept if component[i][1] == i]
    hits = window_hits([t for _, t in kept], [(str(i), t) for i, t in items], split_words)
    kept = [row for row, (_, hit, _) in zip(kept, hits) if not hit]
    kept = [(i, secrets.masked(t, secrets.scan(t))) for i, t in kept]
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {i: (oracle.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept}
    found = {r.doc_id: (list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    assert found == want
    assert {1, 2, 59, 104} <= set(found) and not {100, 101, 103, 105, 106, 107} & set(found) and 102 in found


def test_pipeline_tells_rows_without_own_ids_apart(spark, corpus, tmp_path):
    """Null and repeated ids with differing texts: unlinked clean rows stay, and contaminated ones take no other along."""
    from collections import Counter

    folder, _, items = corpus
    text = lambda seed, lang, n=90: " ".join(prose(seed, lang, n))
    rows = [(k, text(k, ("aa", "bb")[k % 2])) for k in range(40)]
    rows += [(None, text(300 + k, ("aa", "bb")[k % 2])) for k in range(8)] + [(50 + k // 4, text(400 + k, ("aa", "bb")[k % 2])) for k in range(8)]
    rows += [(None, text(500, "aa", 60) + " " + items[1][1]), (50, text(501, "aa", 60) + " " + items[3][1])]
    rows += [(None, text(7, "bb")), (None, text(302, "aa")), (None, text(302, "aa")), (51, text(404, "aa")), (50, text(5, "bb") + " end")]
    rows += [(None, None), (None, ""), (None, "12345")]
    frame = spark.createDataFrame([(i, t, ("aa", "bb")[k % 2], "x", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    classifier = language.Classifier(language.fit(docs.where(~language.held_out())))
    kept = [(k, t) for k, (_, t) in enumerate(rows) if classifier.predict((t or "").encode())[1] >= language.MIN_MARGIN]
    groups = {}
    for k, (_, component) in jaccard_components(kept).items():
        groups.setdefault(component, []).append(k)
    first = {min(ks, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)) for ks in groups.values()}
    kept = [(k, t) for k, t in kept if k in first]
    hits = window_hits([t for _, t in kept], [(str(i), t) for i, t in items], split_words)
    want = Counter((rows[k][0], hashlib.sha256(secrets.masked(t, secrets.scan(t)).encode()).hexdigest()) for (k, t), (_, hit, _) in zip(kept, hits) if not hit)
    found = Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert found == want
    assert sum(n for (i, _), n in want.items() if i is None) >= 6 and sum(n for (i, _), n in want.items() if i == 50) >= 3
    # a table that isn't read from files as it is
    assert corpus_pipeline.drop_near_duplicates(spark, frame, str(tmp_path)).count() == len(rows) - 5


def test_pipeline_bears_columns_named_like_its_own(spark, corpus, tmp_path):
    from pyspark.sql import functions as F

    folder, *_ = corpus
    names = ("score", "rejected", "lang_pred", "hit_positions", "items", "component_id", "row", "key", "n", "id", "spans", "decoded", "ids", "n_tokens")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.withColumns({c: F.lit("own") for c in names}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    wide = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, folder).columns == wide.columns
    plain, found = ({(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, where).collect()} for where in (folder, str(tmp_path)))
    assert found == plain and found


def test_stages_keep_the_columns(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_pipeline_of_no_documents(spark, corpus, tmp_path):
    folder, *_ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
