import fnmatch

import pytest
from pyspark.sql import functions as F

from lanternfish.functions import paths as P
from lanternfish.functions import tokens as T
from lanternfish.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("Ab_1 x²-é!"))) == ["ab_1", "x²", "-", "é", "!"]
    assert one(spark, T.query_terms(F.lit('-bad +bad "q the the cat.'))) == ["the", "cat", "."]
    assert one(spark, T.query_terms(F.lit(""))) == []


def test_tokens_are_those_of_unicode(spark):
    import re

    text = "a\u00a0b\u3000c\u2028d\x1ce\x85f\x0bg _1\u0663\u00bd \u2003x-\u20ac"
    assert one(spark, T.tokens(F.lit(text))) == re.findall(r"\w+|[^\w\s]", text.lower())
    assert one(spark, T.query_terms(F.lit("x\u3000-no\u00a0y"))) == ["x", "y"]
    assert one(spark, T.truncate(F.lit("\u3000a\u00a0b c"), 2)) == "\u3000a\u00a0b"


def test_embed_text(spark):
    some = lambda *parts: one(spark, T.embed_text(*(F.lit(x).cast("string") for x in parts), 3))
    assert some("p/a.cs", "csharp", "K", "M", "K.M(int)", "  one two three four ") == "p/a.cs [csharp] > K > M\nsignature: K.M(int)\none two three"
    assert some("a.py", None, "", "f", None, " ") == "a.py [] > f"


def test_truncate_and_slices(spark):
    text = " ".join(f"t{k}" for k in range(700))
    assert len(one(spark, T.truncate(F.lit(text))).split()) == 510
    assert one(spark, T.truncate(F.lit(text), 0)) == ""
    lines = F.lit("a\n  b \nc")
    assert one(spark, T.source_slice(lines, F.lit(2), F.lit(9))) == "  b \nc"
    assert one(spark, T.body_slice(lines, F.lit(2), F.lit(2))) == "b"
    assert one(spark, T.source_slice(lines, F.lit(4), F.lit(4))) is None
    assert one(spark, T.line_count(lines)) == 3


@pytest.mark.parametrize("glob", ["**/*.py", "*.py", "src/?ain.*", "[!s]*", "a[bc]*.ts", "x+(y).py", "*"])
def test_globs_are_shell_patterns(spark, glob):
    names = ["main.py", "src/main.py", "src/a/b.py", "ab.ts", "a-c.ts", "x+(y).py", "src/main.tsx"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").where(P.matches_glob(F.col("p"), glob)).collect()
    assert sorted(r.p for r in rows) == sorted(n for n in names if fnmatch.fnmatchcase(n, glob))


def test_paths(spark):
    assert one(spark, P.language(F.lit("a/B.PYW"))) == "python" and one(spark, P.language(F.lit("a/b.rb"))) is None
    assert one(spark, P.pruned_in_scan(F.lit("src/.git/x.py"))) and not one(spark, P.pruned_in_scan(F.lit("src/x.py")))
    assert one(spark, P.pruned_in_stream(F.lit("/w/build/x.py"))) and not one(spark, P.pruned_in_stream(F.lit("/w/.hidden/x.py")))
    assert one(spark, P.project_key(F.lit("/p"))) == one(spark, F.substring(F.md5(F.lit("/p").cast("binary")), 1, 12))


def test_vectors(spark):
    v = lambda *x: F.array(*(F.lit(float(k)) for k in x))
    assert one(spark, V.cosine(v(1, 0), v(1, 0))) == 1.0
    assert one(spark, V.cosine(v(1, 0), v(0, 0))) == 0.0 and one(spark, V.cosine(v(1, 0), v(1))) == 0.0
    assert round(one(spark, V.to_unit_range(V.cosine(v(1, 0), v(-1, 0)))), 6) == 0.0
