"""Registered queries of the retrieval operators, and the SQL that gives the same rows.

The tables stand for the relations of a code index: documents are symbols with their bodies, their source is the file and
lang the language; embeddings hold vectors by vec_id = doc_id; orders and lineitem are parents and children; events are
changes; pages have paths and HTML. All queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import progress
from ..functions import tokens as T
from ..functions import vectors as V
from ..operators import changes, lookup, markup, ranking, trigrams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: What the search queries look for, and the row whose vector is the query's.
SEARCH_TEXT, QUERY_VECTOR = "the +of that, with", 0
#: The same as terms of SQL.
_TERMS = "('the'), ('that'), (','), ('with')"
_LANGUAGE = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in P.LANGUAGES.items()) + " END"
_EXCLUDED = ", ".join(f"'{x}'" for x in P.EXCLUDED)


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{T.TOKEN}')"


def _head(text: str) -> str:
    """A text stripped and cut to its first tokens."""
    stripped = f"regexp_replace({text}, '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g')"
    return f"array_to_string((regexp_extract_all({stripped}, '[{T.SPACE}]*(?:{T.TOKEN})'))[1:{T.MAX_TOKENS}], '')"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- search

_KEYWORDS = rf"""
tok AS (SELECT doc_id, unnest({_tokens("text")}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT * FROM (VALUES {_TERMS}) v(t)) GROUP BY 1, 2),
idf AS (SELECT term, ln((1 + (SELECT greatest(count(*), 1) FROM documents)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY 1),
kw AS (SELECT doc_id, round(sum(tf * idf), 6) AS score FROM tf JOIN idf USING (term) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 200)"""
_COSINES = f"""
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {QUERY_VECTOR} LIMIT 1),
cs AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS cosine FROM embeddings, q)"""
_HYBRID = f"""{_KEYWORDS}, {_COSINES},
hy AS (SELECT cs.doc_id, d.source AS file, round(0.7 * least(greatest((cosine + 1) / 2, 0), 1) + 0.3 * coalesce(kw.score / (SELECT max(score) FROM kw), 0), 4) AS score
  FROM cs JOIN documents d USING (doc_id) LEFT JOIN kw USING (doc_id))"""


def _query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_VECTOR).select(F.col("embedding").cast("array<double>").alias("q"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    cosines = ranking.cosine_scores(vectors, _query_vector(spark, sf_dir), "doc_id", "embedding")
    scores = ranking.hybrid_scores(cosines, ranking.keyword_search(documents, SEARCH_TEXT, "doc_id", "text"), "doc_id")
    return scores.join(documents.select("doc_id", F.col("source").alias("file")), "doc_id")


@query(
    f"""WITH {_HYBRID},
files AS (SELECT file, max(score) AS score FROM hy GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
ranked AS (SELECT files.file, files.score, doc_id AS name, hy.score AS symbol_score, row_number() OVER (PARTITION BY files.file ORDER BY hy.score DESC, doc_id) AS rank FROM hy JOIN files ON hy.file = files.file)
SELECT * FROM ranked WHERE rank <= 5"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.hybrid_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), SEARCH_TEXT, "doc_id", "source", "vec_id", "embedding", "text")


@query(f"WITH {_HYBRID} SELECT doc_id, file, score FROM hy")
def hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "file", "score")


@query(f"WITH {_HYBRID}, r AS (SELECT file, doc_id, score, row_number() OVER (PARTITION BY file ORDER BY score DESC, doc_id) AS rank FROM hy) SELECT * FROM r WHERE rank <= 5")
def top5_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_in_group(_scored(spark, sf_dir), "file", [F.desc("score"), F.col("doc_id")], ranking.TOP_SYMBOLS).select("file", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_COSINES} SELECT doc_id AS vec_id, round(cosine, 4) AS cosine FROM cs ORDER BY 2 DESC, 1 LIMIT 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ranking.cosine_scores(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), "vec_id", "embedding")
    return scores.select("vec_id", F.round("cosine", V.DIGITS).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(ranking.TOP_FILES)


@query("SELECT vec_id, len(embedding) AS dims, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dims"), F.round(V.norm(v), V.DIGITS).alias("norm"))


@query(f"WITH {_KEYWORDS} SELECT doc_id, score FROM kw")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.keyword_search(table(spark, sf_dir, "documents"), SEARCH_TEXT, "doc_id", "text")


@query(
    f"""WITH w AS (SELECT item_id, unnest(string_split_regex(text, '[{T.SPACE}]+')) AS word FROM benchmark),
t AS (SELECT item_id, unnest({_tokens("word")}) AS term FROM w WHERE NOT regexp_matches(word, '^[-+^"*]'))
SELECT item_id, count(DISTINCT term) AS n_terms, md5(string_agg(DISTINCT term, ' ' ORDER BY term)) AS terms_md5 FROM t GROUP BY 1"""
)
def keyword_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "benchmark").select("item_id", T.query_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    return terms.select("item_id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join(F.array_sort("terms"), " ").cast("binary")).alias("terms_md5"))


@query(rf"WITH tok AS (SELECT doc_id, unnest({_tokens("text")}) AS term FROM documents) SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(rf"WITH tok AS (SELECT DISTINCT doc_id, unnest({_tokens("text")}) AS term FROM documents) SELECT term, count(*) AS df FROM tok GROUP BY 1")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.document_frequency(table(spark, sf_dir, "documents"), "text")


_BEFORE = "SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0"
_AFTER = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat_ws(' ', text, source) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0"


def _changed_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents before and after a change of some, and of both those that have changed, by their times."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    before, after = rows.where("doc_id % 7 <> 0").select("doc_id", "text"), rows.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat_ws(" ", "text", "source")).otherwise(F.col("text")).alias("text"))
    change = changes.diff(*_versions(spark, sf_dir), "doc_id", "mtime").where("change <> 'same'").select("doc_id")
    return before, after, before.join(change, "doc_id", "left_semi"), after.join(change, "doc_id", "left_semi")


@query(
    f"""WITH t AS (SELECT doc_id, unnest({_tokens("text")}) AS term, -1 AS n FROM ({_BEFORE}) UNION ALL SELECT doc_id, unnest({_tokens("text")}) AS term, 1 AS n FROM ({_AFTER}))
SELECT term, doc_id, sum(n)::BIGINT AS tf FROM t GROUP BY 1, 2 HAVING sum(n) <> 0"""
)
def posting_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of some documents adds to a stored keyword index."""
    *_, old, new = _changed_texts(spark, sf_dir)
    return ranking.posting_deltas(old, new, "doc_id", "text")


@query(f"WITH {_KEYWORDS.replace('FROM documents', f'FROM ({_AFTER})')} SELECT doc_id, score FROM kw")
def keyword_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search over the postings of the documents before a change and the deltas of it."""
    before, after, old, new = _changed_texts(spark, sf_dir)
    index = ranking.postings(before, "doc_id", "text").unionByName(ranking.posting_deltas(old, new, "doc_id", "text"))
    scores = ranking.indexed_keyword_scores(index, ranking.terms_of(spark, SEARCH_TEXT), after.count(), "doc_id")
    return scores.orderBy(F.desc("score"), "doc_id").limit(ranking.KEYWORD_CANDIDATES)


_LONG_TEXT = 500


@query(f"SELECT name, doc_id, count(*) AS n FROM (SELECT CASE WHEN length(text) > {_LONG_TEXT} THEN source ELSE lang END AS name, doc_id FROM documents) WHERE name IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2")
def names_after_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored names of documents, their languages, and the deltas by which long ones go by their sources, added up."""
    docs = table(spark, sf_dir, "documents")
    before = docs.select(F.col("lang").alias("name"), "doc_id")
    after = docs.select(F.when(F.length("text") > _LONG_TEXT, F.col("source")).otherwise(F.col("lang")).alias("name"), "doc_id")
    stored, deltas = changes.signed_deltas(before.limit(0), before, "name", "doc_id"), changes.signed_deltas(before, after, "name", "doc_id")
    return changes.merged_deltas(stored.unionByName(deltas), "name", "doc_id")


# ---- files and text

GREP, GREP_CAP, GREP_OF_FILE = r"(tion|ment)[ .,]", 50, 3


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '^http.*/en/.*[0-9]$')")
def find_files_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(P.matches_glob(F.col("url"), "http*/en/*[0-9]")).select("page_id", "url")


@query(rf"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '(\.[^./\\]+)$', 1)) AS ext FROM pages)
SELECT page_id, ext, {_LANGUAGE} AS language, ext IN ({", ".join(f"'{e}'" for e in P.LANGUAGES)}) AS supported FROM p""")
def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", P.extension(url).alias("ext"), P.language(url).alias("language"), P.supported(url).alias("supported"))


@query(rf"""WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS parts FROM pages)
SELECT page_id, len(list_filter(parts[1:len(parts) - 1], lambda x: x IN ({_EXCLUDED}, 'en') OR starts_with(x, '.'))) > 0 AS pruned, len(list_filter(parts, lambda x: x IN ({_EXCLUDED}))) > 0 AS pruned_stream FROM p""")
def dir_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    pruned = P.pruned_in_scan(path) | F.exists(P.directories(path), lambda d: d == "en")
    return table(spark, sf_dir, "pages").select("page_id", pruned.alias("pruned"), P.pruned_in_stream(path).alias("pruned_stream"))


_LINES = rf"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS match, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
m AS (SELECT doc_id, line::INT AS line, match FROM l WHERE regexp_matches(match, '{GREP}'))"""


def _grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.grep(table(spark, sf_dir, "documents"), "text", GREP, "doc_id")


@query(f"WITH {_LINES} SELECT * FROM m")
def grep_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grep(spark, sf_dir)


@query(f"WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM m) SELECT doc_id, line, match FROM r WHERE k <= {GREP_OF_FILE} ORDER BY doc_id, line LIMIT {GREP_CAP}")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_in_group(_grep(spark, sf_dir), "doc_id", [F.col("line")], GREP_OF_FILE).drop("rank").orderBy("doc_id", "line").limit(GREP_CAP)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return trigrams.candidates(documents.select("doc_id", F.explode(trigrams.grams(F.col("text"))).alias("gram")), "doc_id", trigrams.clauses(GREP))


_HELD = " OR ".join("(" + " AND ".join(f"contains(text, '{g}')" for g in (w[:3], w[1:], w[2:] + x)) + ")" for w in ("tion", "ment") for x in " .,")


@query(f"SELECT doc_id FROM (SELECT doc_id, lower(text) AS text FROM documents) WHERE {_HELD}")
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the trigrams that the searched pattern needs."""
    return _candidates(spark, sf_dir)


@query(f"WITH {_LINES} SELECT * FROM m")
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matching lines, from candidates by trigrams alone."""
    return lookup.grep(table(spark, sf_dir, "documents").join(_candidates(spark, sf_dir), "doc_id", "left_semi"), "text", GREP, "doc_id")


@query(
    f"""SELECT doc_id, concat_ws(chr(10), concat_ws(' > ', concat_ws('/', source, doc_id) || ' [' || coalesce(lang, '') || ']', nullif(source, ''), doc_id), 'signature: ' || n_chars,
  nullif({_head("text")}, '')) AS embed_text FROM documents"""
)
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("doc_id").cast("string")
    text = T.embed_text(F.concat_ws("/", "source", name), F.col("lang"), F.col("source"), name, F.col("n_chars").cast("string"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("embed_text"))


@query(rf"SELECT doc_id, array_to_string(({_tokens("text")})[1:{T.MAX_TOKENS}], ' ') AS head FROM documents")
def truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.tokens(T.truncate(F.col("text"))), " ").alias("head"))


@query(f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, len(l)::INT AS n_lines, array_to_string(l[2:4], chr(10)) AS source, {_head("array_to_string(l[2:4], chr(10))")} AS body FROM l WHERE len(l) >= 2""")
def body_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, first, last = F.col("text"), F.lit(2), F.lit(4)
    rows = table(spark, sf_dir, "documents").select("doc_id", T.line_count(text).alias("n_lines"), T.source_slice(text, first, last).alias("source"), T.body_slice(text, first, last).alias("body"))
    return rows.where("n_lines >= 2")


@query("SELECT page_id, substr(md5(url), 1, 12) AS cache_key, url || '::' || page_id AS symbol_id FROM pages")
def project_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.project_key(F.col("url")).alias("cache_key"), P.symbol_id(F.col("url"), F.col("page_id").cast("string")).alias("symbol_id"))


# ---- counts and lookups


@query("SELECT lang AS language, count(*) AS n FROM documents GROUP BY 1")
def lang_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.counts_by(table(spark, sf_dir, "documents"), F.col("lang"), "language")


@query("SELECT coalesce(nullif(event_type, ''), 'unknown') AS kind, count(*) AS n FROM events GROUP BY 1")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.counts_by(table(spark, sf_dir, "events"), lookup.known_kind(F.col("event_type")), "kind")


@query("SELECT (SELECT count(DISTINCT source) FROM documents) AS files, (SELECT count(*) FROM documents) AS symbols, (SELECT count(*) FROM embeddings) AS embeddings")
def deep_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return lookup.totals(files=(documents, F.count_distinct("source")), symbols=(documents, F.count("*")), embeddings=(vectors, F.count("*")))


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT coalesce(string_agg(lang || ': ' || n, ', ' ORDER BY lang), 'none') AS summary FROM c")
def lang_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.counts_text(table(spark, sf_dir, "documents"), "lang")


@query(
    """SELECT o_orderkey, o_orderpriority, count(*) AS n_items, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS items
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"""
)
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    rows = lookup.with_children(orders, items, "o_orderkey", [F.col("l_linenumber"), F.col("l_partkey")], "items")
    text = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return rows.select("o_orderkey", "o_orderpriority", F.size("items").cast("long").alias("n_items"), text.alias("items"))


@query("SELECT p_partkey, p_name, coalesce(n, 0) AS n_uses FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey WHERE p_name = 'red widget'")
def find_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    found = lookup.equal_to(table(spark, sf_dir, "part"), "p_name", "red widget").select("p_partkey", "p_name")
    return found.join(uses, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("n", F.lit(0)).alias("n_uses"))


@query(
    """WITH s AS (SELECT p_brand, p_partkey, replace(p_name, ' ', '.') AS short_name, p_type || '.' || split_part(p_name, ' ', 1) || '(' || p_size || ')' AS signature FROM part),
t AS (SELECT *, CASE WHEN short_name = 'widget' THEN 1 WHEN signature = 'widget' THEN 2 WHEN list_last(string_split(short_name, '.')) = 'widget' THEN 3
  WHEN split_part(signature, '(', 1) = 'widget' THEN 4 WHEN list_last(string_split(split_part(signature, '(', 1), '.')) = 'widget' THEN 5 END AS tier FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY tier, p_partkey) AS k FROM t WHERE tier IS NOT NULL)
SELECT p_brand, p_partkey, short_name, tier FROM r WHERE k = 1"""
)
def tiered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.replace("p_name", F.lit(" "), F.lit(".")).alias("short_name"), F.format_string("%s.%s(%d)", "p_type", F.substring_index("p_name", " ", 1), "p_size").alias("signature"))
    tiers = rows.withColumn("tier", lookup.match_tier(F.col("short_name"), F.col("signature"), F.lit("widget")))
    return lookup.first_by_tier(tiers, ["p_brand"], ["p_partkey"]).select("p_brand", "p_partkey", "short_name", "tier")


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return lookup.pending(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), vectors, "doc_id")


_KIND = "CASE doc_id % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'method' WHEN 2 THEN 'function' ELSE 'class' END"


@query(
    f"""WITH s AS (SELECT {_KIND} AS kind, len(string_split(text, chr(10))) AS n FROM documents)
SELECT CASE WHEN kind = 'import' THEN 'import' WHEN kind IN ('method', 'function') AND n - 1 <= 2 THEN 'trivial_method' ELSE 'kept' END AS reason, count(*) AS n FROM s GROUP BY 1"""
)
def skip_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = lookup.skip_reason(F.expr(_KIND), F.lit(1), T.line_count(F.col("text")))
    return lookup.counts_by(table(spark, sf_dir, "documents"), F.coalesce(reason, F.lit("kept")), "reason")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    return lookup.pending(table(spark, sf_dir, "embeddings").select("vec_id", "label"), known, "vec_id")


# ---- changes

_STORED = "SELECT doc_id, n_chars::DOUBLE AS mtime FROM documents WHERE doc_id % 7 <> 0"
_CURRENT = "SELECT doc_id, n_chars + CASE WHEN doc_id % 5 = 0 THEN 0.5 WHEN doc_id % 5 = 1 THEN 0.0000001 ELSE 0.0 END AS mtime FROM documents WHERE doc_id % 11 <> 0"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of one listing, made from documents: some keys are new, some gone, some of another time."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("mtime"))
    later = F.when(F.col("doc_id") % 5 == 0, 0.5).when(F.col("doc_id") % 5 == 1, 0.0000001).otherwise(0.0)
    return rows.where("doc_id % 7 <> 0"), rows.where("doc_id % 11 <> 0").withColumn("mtime", F.col("mtime") + later)


_DIFF = f"""d AS (SELECT coalesce(s.doc_id, c.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN c.doc_id IS NULL THEN 'deleted' WHEN round(s.mtime, 6) <> round(c.mtime, 6) THEN 'changed' ELSE 'same' END AS change
FROM ({_STORED}) s FULL JOIN ({_CURRENT}) c ON s.doc_id = c.doc_id)"""


@query(f"WITH {_DIFF} SELECT * FROM d")
def mtime_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.diff(*_versions(spark, sf_dir), "doc_id", "mtime")


@query(f"WITH {_DIFF} SELECT doc_id, CASE change WHEN 'deleted' THEN 'delete' ELSE 'rebuild' END AS action FROM d WHERE change IN ('deleted', 'changed')")
def startup_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.diff(*_versions(spark, sf_dir), "doc_id", "mtime").where(F.col("change").isin("deleted", "changed"))
    return rows.select("doc_id", F.when(F.col("change") == "deleted", "delete").otherwise("rebuild").alias("action"))


@query(f"SELECT c.doc_id, s.mtime IS NULL OR s.mtime <> c.mtime AS needs_rebuild FROM ({_CURRENT}) c LEFT JOIN ({_STORED}) s ON s.doc_id = c.doc_id")
def needs_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, current = _versions(spark, sf_dir)
    return changes.needs_rebuild(stored, current, "doc_id", "mtime")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    _, items = changes.delete_cascading(orders.where("o_orderstatus = 'P'"), orders, table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")
    return items.select("l_orderkey", "l_linenumber", "l_partkey")


_ONE = "WITH r AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts {0}, event_id {0}) AS k FROM events) SELECT user_id, event_id, event_type, value FROM r WHERE k = 1"


def _one_event(spark: SparkSession, sf_dir: str, last: bool) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return changes.keep_one(rows, "user_id", ["ts", "event_id"], last).select("user_id", "event_id", "event_type", "value")


@query(_ONE.format("DESC"))
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_event(spark, sf_dir, last=True)


@query(_ONE.format("ASC"))
def insert_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_event(spark, sf_dir, last=False)


@query(
    """WITH e AS (SELECT vec_id, label FROM embeddings), n AS (SELECT user_id AS vec_id, user_id % 10 AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT vec_id, label FROM e WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT vec_id, label FROM n WHERE k = 1"""
)
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.lit(None).cast("timestamp").alias("updated_at"))
    fresh = table(spark, sf_dir, "events").select(F.col("user_id").alias("vec_id"), (F.col("user_id") % 10).cast("long").alias("label"), "ts", "event_id")
    return changes.upsert(rows, fresh, "vec_id", ["ts", "event_id"]).select("vec_id", "label")


@query("SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END AS source FROM documents")
def replace_changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return changes.replace_rows(rows, rows.where("doc_id % 3 = 0").withColumn("source", F.upper("source")), "doc_id")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM s GROUP BY user_id, run"""
)
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = changes.sessions(events, "user_id", "ts", 30 * 60)
    return rows.select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n_events")


_HEAD = "CASE WHEN event_type = 'error' THEN NULL ELSE event_type END"


@query(
    f"""WITH h AS (SELECT user_id, event_id, {_HEAD} AS head, lag({_HEAD}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, coalesce(head <> before, false) AS fired FROM h"""
)
def head_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.expr(_HEAD).alias("head"))
    return changes.head_moves(events, "user_id", ["ts", "event_id"], "head").select("user_id", "event_id", "fired")


#: Event types that stand for states.
STATES = {"signup": "idle", "view": "queued", "click": "running", "purchase": "completed", "error": "failed"}
_STATE = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in STATES.items()) + " END"


@query(
    f"""WITH s AS (SELECT user_id, event_id, {_STATE} AS state, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT before, state, before = state OR (before, state) IN ({", ".join(f"('{a}', '{b}')" for a, found in progress.MOVES.items() for b in found)}) AS legal, count(*) AS n FROM s WHERE before IS NOT NULL GROUP BY 1, 2, 3"""
)
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.expr(_STATE)
    rows = changes.previous(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", state.alias("state")), "user_id", ["ts", "event_id"], {"state": "before"}).where("before IS NOT NULL")
    return rows.groupBy("before", "state", progress.legal(F.col("before"), F.col("state")).alias("legal")).agg(F.count("*").alias("n"))


# ---- batches and progress

BATCH, WAVE, WORKERS = 64, 4, 4


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) SELECT doc_id, floor(k / {BATCH})::BIGINT AS batch, floor(k / {BATCH * WAVE})::BIGINT AS wave FROM r")
def batch_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.place(table(spark, sf_dir, "documents").select("doc_id"), F.struct(F.col("doc_id").isNull().alias("unnamed"), F.floor(F.col("doc_id") / 4096).alias("range")), [F.col("doc_id")])
    return rows.select("doc_id", F.floor((F.col("place") - 1) / BATCH).alias("batch"), F.floor((F.col("place") - 1) / (BATCH * WAVE)).alias("wave"))


@query(f"SELECT doc_id, n_chars, (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) % {WORKERS} AS worker FROM documents")
def size_balanced_deal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.place(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.struct(F.col("n_chars").isNull().alias("none"), (-F.col("n_chars")).alias("size"), F.col("doc_id").isNull().alias("unnamed"), F.floor(F.col("doc_id") / 4096).alias("range")), [F.col("doc_id")])
    return rows.select("doc_id", "n_chars", ((F.col("place") - 1) % WORKERS).alias("worker"))


@query(
    """SELECT o_orderkey, CASE WHEN n > 0 THEN round(100.0 * done / n, 1) ELSE 100.0 END AS percent_done,
  CASE WHEN n > 0 AND done >= n THEN 0 WHEN n > 0 AND done > 0 THEN greatest(round_even((n - done) / (done / greatest(o_totalprice / 1000, 0.001)), 0), 0) END::BIGINT AS eta_seconds
FROM (SELECT o_orderkey, o_totalprice, o_orderkey % 7 AS done, o_orderkey % 5 AS n FROM orders)"""
)
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, n = F.col("o_orderkey") % 7, F.col("o_orderkey") % 5
    return table(spark, sf_dir, "orders").select("o_orderkey", progress.percent_done(done, n).alias("percent_done"), progress.eta_seconds(done, n, F.col("o_totalprice") / 1000).alias("eta_seconds"))


# ---- markup

_ATTRIBUTE = r"""[^\s"''<>/=\x01]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''<>\x01][^\s<>\x01]*))?"""
_INSIDE = rf"(?:{_ATTRIBUTE}|[^<>\x01])*"
_START = rf"(?is)^\x01\d+\x01<[a-z][^\s/<>\x01]*{_INSIDE}>"
#: Comments whole, scripts and styles up to what ends them, tags.
_PIECE = rf"(?is)\x01\d+\x01<(?:!--.*?-->|(?:script|style)(?:[\s/]{_INSIDE})?>(?:[^\x01]|\x01\d+\x01<(?:[^/]|/[^s]))*|[a-z][^\s/<>\x01]*{_INSIDE}>?)"
_VALUE = r"regexp_replace(a, '(?s)^[^=]*=\s*', '')"
_TAGS = rf"""marked AS (
  SELECT page_id, regexp_replace(html, '\r\n?', chr(10), 'g') AS text,
    array_to_string(list_transform(string_split(text, chr(10)), lambda r, i: replace(r, '<', chr(1) || i || chr(1) || '<')), chr(10)) AS html FROM pages WHERE html IS NOT NULL),
listed AS (SELECT page_id, regexp_extract_all(m.html, '{_PIECE}') AS pieces FROM marked m),
dealt AS (SELECT page_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS k FROM listed),
written AS (
  SELECT page_id, k, regexp_extract(piece, '^\x01(\d+)', 1)::INT AS line, regexp_replace(regexp_extract(piece, '{_START}'), '\x01\d+\x01', '', 'g') AS tag_text
  FROM dealt WHERE regexp_matches(piece, '{_START}') AND NOT ends_with(regexp_extract(piece, '{_START}'), '/>')),
tags AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS place, lower(regexp_extract(tag_text, '^<([^\s/<>]+)', 1)) AS tag, line,
    (line + length(tag_text) - length(replace(tag_text, chr(10), '')))::INT AS end_line,
    list_filter(list_transform(regexp_extract_all(regexp_replace(tag_text, '^<[^\s/<>]+', ''), '(?is){_ATTRIBUTE}'), lambda a: {{
      'name': lower(regexp_extract(a, '^[^\s=]+')),
      'value': CASE WHEN NOT contains(a, '=') THEN '' WHEN {_VALUE}[1] IN ('"', '''') THEN {_VALUE}[2:-2] ELSE {_VALUE} END}}), lambda a: a.value <> '') AS attributes
  FROM written)"""


def _page_path() -> Column:
    return F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))


@query(f"WITH {_TAGS} SELECT page_id, place, tag, line, end_line, array_to_string(list_transform(attributes, lambda a: a.name || '=' || a.value), chr(10)) AS attributes FROM tags")
def html_start_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(markup.start_tags(F.col("html"))).alias("at", "t"))
    written = F.array_join(F.transform("t.attributes", lambda a: F.concat(a["name"], F.lit("="), a["value"])), "\n")
    return rows.select("page_id", (F.col("at") + 1).cast("long").alias("place"), "t.tag", "t.line", "t.end_line", written.alias("attributes"))


@query(
    f"""WITH {_TAGS}, named AS (
  SELECT *, 'pages/' || page_id || '.html' AS path, list_filter(attributes, lambda a: a.name = 'id')[-1].value AS id, list_filter(attributes, lambda a: a.name = 'src')[-1].value AS src,
    list_filter(attributes, lambda a: a.name = 'href')[-1].value AS href, coalesce(list_filter(attributes, lambda a: a.name = 'name')[-1].value, id) AS field FROM tags),
found AS (
  SELECT *, 1 AS k, 'element_id' AS type, id AS name, '#' AS mark, 'id="' || id || '"' AS signature FROM named WHERE id IS NOT NULL
  UNION ALL SELECT *, 2, 'script_ref', src, 'script:', 'src="' || src || '"' FROM named WHERE tag = 'script' AND src IS NOT NULL
  UNION ALL SELECT *, 3, 'style_ref', href, 'link:', 'href="' || href || '"' FROM named WHERE tag = 'link' AND href IS NOT NULL
  UNION ALL SELECT *, 4, 'form_field', field, 'field:', '<' || tag || ' name=''' || field || '''>' FROM named WHERE tag IN ('input', 'select', 'textarea') AND field IS NOT NULL),
grouped AS (
  SELECT page_id, count(*) AS n, to_json(list({{'type': type, 'name': name, 'symbol_id': path || '::' || mark || name, 'line': line, 'end_line': end_line, 'signature': signature}} ORDER BY place, k)) AS symbols
  FROM found GROUP BY page_id)
SELECT 'pages/' || page_id || '.html' AS path, 'html' AS language, len(string_split(text, chr(10)))::INT AS line_count, coalesce(n, 0)::INT AS n_symbols, coalesce(symbols::VARCHAR, '[]') AS symbols
FROM marked LEFT JOIN grouped USING (page_id)"""
)
def html_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where("html is not null").select(_page_path().alias("path"), "html")
    found = pages.select("path", P.language(F.col("path")).alias("language"), F.size(markup.lines(F.col("html"))).alias("line_count"), markup.symbols(F.col("html"), F.col("path")).alias("symbols"))
    return found.select("path", "language", "line_count", F.size("symbols").alias("n_symbols"), F.to_json("symbols").alias("symbols"))
