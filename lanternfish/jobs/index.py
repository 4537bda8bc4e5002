"""Building and serving an index of a source tree: listing, changed files, symbols, postings, vectors, search."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import progress
from ..functions import tokens as T
from ..operators import changes, embedding, lookup, parsing, ranking, trigrams
from ..shipping import ship
from ..sources.listing import list_paths, list_files, with_content
from ..sources.store import PARTS, Change, Store, Version

FILES = "path string, rel_path string, language string, line_count int, mtime double, imports array<string>, exports array<string>, error string"
SYMBOLS = "path string, language string, symbol_id string, type string, name string, parent string, line int, end_line int, signature string, body_text string"
VECTORS = "symbol_id string, model string, vector array<double>, updated_at timestamp"
POSTINGS = "term string, symbol_id string, tf bigint"
TRIGRAMS = "gram string, path string"
NAMES = "name string, symbol_id string, n bigint"
#: What keyword search reads of a symbol.
TEXT = ("name", "parent", "signature", "body_text", "path")

#: Changed paths of one batch that are looked up by name; more are found by listing the tree.
FEW_FILES = 10_000
#: Batches of a wave: so many are embedded and committed together.
WAVE_BATCHES = 1024
#: Times that what is pending is gone through.
EMBED_ROUNDS = 2
#: Folders of a part of the postings or names from which they are merged into one.
MERGE_FROM = 16
#: Seconds that a build may hold its lease without renewing it.
LEASE_SECONDS = 3600.0

Embedder = embedding.Embedder


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def file_key(rel_path: Column) -> Column:
    """What files, their symbols and vectors are cut into parts by: so those of a file lie in parts of one number."""
    return F.substring_index(F.replace(rel_path, F.lit("\\"), F.lit("/")), "::", 1)


def _symbol_key() -> Column:
    return F.substring_index("symbol_id", "::", 1)


def hashed_embedder(texts: list[str], dims: int = 64) -> list[list[float]]:
    """A stand-in for a model: signed counts of hashed tokens. Same text, same vector, anywhere."""
    out = np.zeros((len(texts), dims))
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode("utf-8"), digest_size=8).digest(), "big")
            out[i, h % dims] += 1 if h >> 63 else -1
    return out.tolist()


class _Kept:
    """Writes tables of work and reads them again; knows which, to delete them."""

    def __init__(self, store: Store):
        self.store, self.tables = store, []

    def __call__(self, rows: DataFrame) -> DataFrame:
        self.tables.append(self.store.working(rows))
        return self.tables[-1]


class Index:
    def __init__(self, spark: SparkSession, root: str, store: str, embedder: Embedder = hashed_embedder, model: str = "hashed", parts: int = PARTS, wave_batches: int = WAVE_BATCHES):
        ship(spark)
        self.spark, self.root, self.store = spark, root, Store(spark, store, parts)
        self.embedder, self.model, self.state = embedder, model, "idle"
        self.wave_batches, self.owner = wave_batches, uuid.uuid4().hex
        #: What embed_pending() returned after the last change.
        self.embedding: dict[str, int] = {}
        self._kept = _Kept(self.store)

    def files(self, parts: list[int] | None = None, version: Version | None = None) -> DataFrame:
        return self.store.read("files", FILES, parts, version)

    def symbols(self, parts: list[int] | None = None, version: Version | None = None) -> DataFrame:
        return self.store.read("symbols", SYMBOLS, parts, version)

    def vectors(self, parts: list[int] | None = None, version: Version | None = None) -> DataFrame:
        return self.store.read("vectors", VECTORS, parts, version)

    def postings(self, parts: list[int] | None = None, version: Version | None = None) -> DataFrame:
        """Deltas as they were added; ranking.merged_postings() makes one row a term and symbol of them."""
        return self.store.read("postings", POSTINGS, parts, version)

    def trigrams(self, parts: list[int] | None = None, version: Version | None = None) -> DataFrame:
        return self.store.read("trigrams", TRIGRAMS, parts, version)

    def names(self, parts: list[int] | None = None, version: Version | None = None) -> DataFrame:
        """(name, symbol_id, n), deltas as they were added; changes.merged_deltas() adds them up."""
        return self.store.read("names", NAMES, parts, version)

    def move(self, state: str) -> None:
        if not progress.may_move(self.state, state):
            raise ValueError(f"a build can't go from {self.state} to {state}")
        self.state = state

    def _run(self, work: Callable[[], dict]) -> dict:
        """A second piece of work while one runs is refused, in this session or in another one that holds the store's lease."""
        if self.state in ("queued", "running") or not self.store.lease("build", self.owner, LEASE_SECONDS):
            return {"already_in_progress": 1}
        self.move("queued")
        self.move("running")
        try:
            done = work()
        except Exception:
            self.move("failed")
            raise
        finally:
            self.store.release("build", self.owner)
        self.move("completed")
        return done

    # ---- changes

    def build(self, force: bool = False) -> dict[str, int]:
        """Parses new and changed files, drops what is gone with its symbols and vectors, and embeds what has no vector.
        Returns how many files are new, changed, deleted and same, and of what was parsed files, symbols and errors."""
        return self._run(lambda: self._build(force))

    def rebuild(self, *paths: str) -> dict[str, int]:
        """The same for some files: gone from the index if they're missing, binary or unsupported. Writers of other files go
        on meanwhile."""
        return self._rebuild([P.normalised(path, self.root) for path in paths])

    def sync(self) -> dict[str, int]:
        """The same for the files that the index has: changed ones are parsed again, missing ones go. New ones aren't sought."""
        return self._run(lambda: self._apply(self._listed().join(self.files().select("path"), "path", "left_semi"), self._all_files))

    def _listed(self) -> DataFrame:
        return list_files(self.spark, self.root, self._kept)

    def _all_files(self, version: Version) -> DataFrame:
        return self.files(version=version)

    def follow(self, paths: list[str] | None, stream: str, number: int) -> dict[str, int]:
        """What a batch of a stream has changed: some paths, or anything (None). A batch takes effect once: its number is
        committed with its changes, and batches up to that number are passed over."""
        key = f"batch:{stream}"
        if int(self.store.get_meta(key) or -1) >= number:
            return {"already_done": 1}
        if paths is None or len(paths) > FEW_FILES:
            return self._apply(self._listed(), self._all_files, meta={key: str(number)})
        return self._rebuild([P.normalised(path, self.root) for path in paths], meta={key: str(number)})

    def _rebuild(self, paths: list[str], meta: dict[str, str] = {}) -> dict[str, int]:
        wanted = self.spark.createDataFrame([(p,) for p in paths], "path string")

        def known(version: Version) -> DataFrame:
            return self.files(self.store.parts_of(wanted, self._key_of_path()), version).join(F.broadcast(wanted), "path", "left_semi")

        return self._apply(list_paths(self.spark, self.root, paths), known, force=True, meta=meta)

    def _build(self, force: bool) -> dict[str, int]:
        meta = {"built_at": str(time.time()), "project_path": self.root, "project_key": hashlib.md5(self.root.encode()).hexdigest()[:12]}
        done = self._apply(self._listed(), self._all_files, force, meta)
        self.compact()
        self.store.vacuum()
        return done

    def _key_of_path(self) -> Column:
        return file_key(F.expr(f"substring(path, {len(self.root.rstrip('/')) + 2})"))

    def _apply(self, listing: DataFrame, known: Callable[[Version], DataFrame], force: bool = False, meta: dict[str, str] = {}) -> dict[str, int]:
        """Brings the index from the files known to those listed, in one version: parts that hold a changed file are replaced,
        of postings only what has changed is added. If another writer has replaced one of these parts meanwhile, all is done
        anew on what that left."""
        listing, keep, done = self.store.working(listing), _Kept(self.store), {}

        def work(base: Version) -> Change | None:
            nonlocal done
            if any(key.startswith("batch:") and int(base.meta.get(key) or -1) >= int(n) for key, n in meta.items()):
                return None
            change = changes.diff(known(base), listing, "path", "mtime")
            if force:
                change = change.withColumn("change", F.when(F.col("change") == "same", "changed").otherwise(F.col("change")))
            change = keep(change)
            counts = {r["change"]: r["n"] for r in lookup.counts_by(change, F.col("change"), "change").collect()}
            done = {name: counts.get(name, 0) for name in ("new", "changed", "deleted", "same")} | {"files": 0, "symbols": 0, "errors": 0}
            guarded = [key for key in meta if key.startswith("batch:")]
            if not counts.keys() - {"same"}:
                return Change(meta=meta, guarded=guarded) if meta else None
            gone = change.where("change <> 'same'").select("path")
            fresh = listing.join(change.where(F.col("change").isin("new", "changed")).select("path"), "path", "left_semi")
            parts = self.store.parts_of(gone, self._key_of_path())
            parsed = keep(parsing.parse(with_content(fresh.select("path", "rel_path"), self.root)))
            done |= parsing.totals(parsed).first().asDict()
            symbols = keep(parsing.symbols(parsed).select(*_columns(SYMBOLS)))
            files = self.files(parts, base).join(gone, "path", "left_anti").unionByName(parsed.join(listing.select("path", "rel_path", "mtime"), "path").select(*_columns(FILES)))
            before = self.symbols(parts, base)
            left = before.join(gone, "path", "left_anti")
            vectors = self.vectors(parts, base).join(left.select("symbol_id"), "symbol_id", "left_semi")
            grams = self.trigrams(parts, base).join(gone, "path", "left_anti").unionByName(parsed.select("path", F.explode(trigrams.grams(F.col("text"))).alias("gram")))
            old = before.join(gone, "path", "left_semi")
            added = self._postings_written(ranking.posting_deltas(old, symbols, "symbol_id", *TEXT)) | self._names_written(changes.signed_deltas(old, symbols, "name", "symbol_id"))
            replaced = {
                **self.store.replacing(self.store.write("files", files, file_key(F.col("rel_path")), ["path"], ["path"]), parts),
                **self._symbols_written(left.unionByName(symbols), parts),
                **self.store.replacing(self.store.write("vectors", vectors, _symbol_key(), ["symbol_id"], ["symbol_id"]), parts),
                **self.store.replacing(self.store.write("trigrams", grams, self._key_of_path(), ["gram", "path"], ["gram"]), parts),
            }
            return Change(replaced=replaced, added=added, meta=meta, guarded=guarded)

        self.store.update(work)
        self.store.done(listing, *keep.tables, *self._kept.tables)
        self._kept.tables.clear()
        self.embedding = self.embed_pending()
        return done

    def _symbols_written(self, rows: DataFrame, parts: list[int]) -> dict:
        return self.store.replacing(self.store.write("symbols", rows, _symbol_key(), ["path", "symbol_id"], ["path", "symbol_id", "name"]), parts)

    def _postings_written(self, rows: DataFrame) -> dict:
        return self.store.write("postings", rows, F.col("term"), ["term", "symbol_id"], ["term"])

    def _names_written(self, rows: DataFrame) -> dict:
        return self.store.write("names", rows, F.col("name"), ["name", "symbol_id"], ["name"])

    def compact(self, merge_from: int = MERGE_FROM) -> int:
        """Merges the postings and names of parts that many changes have added to. Returns how many parts."""
        merged = 0

        def work(base: Version) -> Change | None:
            nonlocal merged
            full = {name: [int(k) for k, folders in base.tables.get(name, {}).items() if len(folders) >= merge_from] for name in ("postings", "names")}
            merged, replaced = sum(map(len, full.values())), {}
            if parts := full["postings"]:
                replaced |= self.store.replacing(self._postings_written(ranking.merged_postings(self.postings(parts, base), "symbol_id")), parts)
            if parts := full["names"]:
                replaced |= self.store.replacing(self._names_written(changes.merged_deltas(self.names(parts, base), "name", "symbol_id")), parts)
            return Change(replaced=replaced, beside_added=True) if merged else None

        self.store.update(work)
        return merged

    def embed_pending(self) -> dict[str, int]:
        """Embeds symbols that need a vector and have none, wave by wave; each is committed before the next, so a job that dies
        loses one. Batches that fail don't hold up others and are tried once more at the end; what fails then stays pending,
        for the next call. Returns how many symbols were embedded, how many stay pending, and how many batches failed."""
        embedded = left = failed = 0
        for _ in range(EMBED_ROUNDS):
            done, left, failed = self._embed_waves()
            embedded += done
            if not failed:
                break
        return {"embedded": embedded, "pending": left, "failed_batches": failed}

    def _embed_waves(self) -> tuple[int, int, int]:
        version = self.store.latest()
        pending = lookup.pending(self.symbols(version=version), self.vectors(version=version), "symbol_id").where(lookup.skip_reason(F.col("type"), F.col("line"), F.col("end_line")).isNull())
        if pending.isEmpty():
            return 0, 0, 0
        texts = pending.join(self.files(version=version).select("path", "rel_path"), "path").select("symbol_id", self._embed_text().alias("text"))
        placed = embedding.batched(texts, "symbol_id", self.wave_batches, sorted_rows := _Kept(self.store))
        rows = self.store.working(placed, by="wave")
        counts = {r["wave"]: r["n"] for r in rows.groupBy("wave").agg(F.count("*").alias("n")).collect()}
        embedded = failed = 0
        for wave in sorted(counts):
            found = self.store.working(embedding.embedded(rows.where(F.col("wave") == wave), "symbol_id", "text", self.embedder))
            embedded += self._commit_vectors(found.where("error is null"), rows.where(F.col("wave") == wave))
            failed += found.where("error is not null").select("batch").distinct().count()
            self.store.done(found)
            if self.state == "running":
                self.store.lease("build", self.owner, LEASE_SECONDS)
        self.store.done(rows, *sorted_rows.tables)
        return embedded, sum(counts.values()) - embedded, failed

    def _embed_text(self) -> Column:
        return T.embed_text(*map(F.col, ("rel_path", "language", "parent", "name", "signature", "body_text")))

    def _commit_vectors(self, found: DataFrame, rows: DataFrame) -> int:
        """Adds vectors of symbols whose text is still the one embedded. Returns how many."""
        parts = self.store.parts_of(found, _symbol_key())
        if not parts:
            return 0
        n = 0

        def work(base: Version) -> Change:
            nonlocal n
            now = self.symbols(parts, base).join(self.files(parts, base).select("path", "rel_path"), "path").select("symbol_id", self._embed_text().alias("text"))
            valid = found.join(rows.select("symbol_id", "text"), "symbol_id").join(now, ["symbol_id", "text"], "left_semi")
            valid = valid.join(self.vectors(parts, base).select("symbol_id"), "symbol_id", "left_anti")
            fresh = self.store.working(valid.select("symbol_id", F.lit(self.model).alias("model"), "vector", F.current_timestamp().alias("updated_at")))
            n = fresh.count()
            added = self.store.write("vectors", fresh, _symbol_key(), ["symbol_id"], ["symbol_id"])
            self.store.done(fresh)
            return Change(added=added, same={"symbols": parts, "vectors": parts})

        self.store.update(work)
        return n

    def upsert_vectors(self, rows: DataFrame) -> None:
        """Puts vectors (symbol_id, model, vector) in by symbol, all with one time."""
        rows = rows.select("symbol_id", "model", "vector")

        def work(base: Version) -> Change:
            parts = self.store.parts_of(rows, _symbol_key())
            put = changes.upsert(self.vectors(parts, base), rows, "symbol_id", ["model", "vector"])
            return Change(replaced=self.store.replacing(self.store.write("vectors", put, _symbol_key(), ["symbol_id"], ["symbol_id"]), parts))

        self.store.update(work)

    def clear(self) -> None:
        """An index without files, symbols, postings, names, trigrams and vectors."""
        self.store.clear("files", "symbols", "postings", "names", "vectors", "trigrams")

    # ---- queries

    def find_files(self, glob: str) -> DataFrame:
        return self.files().where(P.matches_glob(F.col("rel_path"), glob)).select("path")

    def file(self, path: str) -> DataFrame:
        path = P.normalised(path, self.root)
        return lookup.equal_to(self.files(self._parts_of_path(path)), "path", path)

    def symbol(self, symbol_id: str) -> DataFrame:
        one = self.spark.createDataFrame([(symbol_id,)], "symbol_id string")
        return lookup.equal_to(self.symbols(self.store.parts_of(one, _symbol_key())), "symbol_id", symbol_id)

    def _parts_of_path(self, path: str) -> list[int]:
        """The part that holds a file, its symbols and vectors."""
        return self.store.parts_of(self.spark.createDataFrame([(path,)], "path string"), self._key_of_path())

    def symbols_named(self, name: str) -> DataFrame:
        """Symbols of a name, by id: the part of the names that holds it says which parts of the symbols to open."""
        version = self.store.latest()
        parts = self.store.parts_of(self.spark.createDataFrame([(name,)], "name string"), F.col("name"))
        ids = changes.merged_deltas(lookup.equal_to(self.names(parts, version), "name", name), "name", "symbol_id")
        return lookup.equal_to(self.symbols(self.store.parts_of(ids, _symbol_key()), version), "name", name, order="symbol_id")

    def file_summary(self, path: str) -> DataFrame:
        """One row: the file with its symbols in the order of their lines."""
        path = P.normalised(path, self.root)
        fields = [F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("end_line", F.lit(0)).alias("end_line"), *map(F.col, ("symbol_id", "type", "name", "signature", "parent"))]
        return lookup.with_children(self.file(path).select("path", "language", "line_count", "imports", "exports"), lookup.equal_to(self.symbols(self._parts_of_path(path)), "path", path), "path", fields, "symbols", how="left")

    def symbol_body(self, path: str, name: str) -> DataFrame:
        """The first symbol of the file that has the name, by tier, and its lines as the file has them now."""
        path = P.normalised(path, self.root)
        rows = lookup.equal_to(self.symbols(self._parts_of_path(path)), "path", path).withColumn("tier", lookup.match_tier(F.col("name"), F.col("signature"), F.lit(name)))
        found = lookup.first_by_tier(rows, ["path"], ["line", "end_line", "symbol_id"])
        now = with_content(list_paths(self.spark, self.root, [path]).select("path"), self.root).select("path", parsing.text_of(F.col("content")).alias("text"))
        return found.join(now, "path").select("symbol_id", "tier", T.source_slice(F.col("text"), F.col("line"), F.col("end_line")).alias("source"))

    def search_candidates(self, pattern: str, glob: str = "*") -> DataFrame:
        """(path, rel_path) of the files that may match: by their trigrams, and those that have changed since they were indexed."""
        listed = self.store.working(list_files(self.spark, self.root, self._kept).where(P.matches_glob(F.col("rel_path"), glob)))
        self.store.done(*self._kept.tables)
        self._kept.tables.clear()
        needed, version = trigrams.clauses(pattern), self.store.latest()
        if not needed:
            return listed.select("path", "rel_path")
        change = changes.diff(self.files(version=version), listed, "path", "mtime").where(F.col("change").isin("new", "changed")).select("path")
        return listed.join(trigrams.candidates(self.trigrams(version=version), "path", needed).union(change), "path", "left_semi").select("path", "rel_path")

    def search_code(self, pattern: str, glob: str = "*", limit: int = 50, case_sensitive: bool = True) -> DataFrame:
        """(file, line, match) of lines that match, as files are now; only candidates are read."""
        pattern = pattern if case_sensitive else f"(?i){pattern}"
        rows = with_content(self.search_candidates(pattern, glob), self.root).select(F.col("rel_path").alias("file"), parsing.text_of(F.col("content")).alias("text"))
        found = lookup.grep(rows, "text", pattern, "file")
        return ranking.top_in_group(found, "file", [F.col("line")], limit).drop("rank").orderBy("file", "line").limit(limit)

    def keyword_search(self, text: str, limit: int = ranking.KEYWORD_CANDIDATES) -> DataFrame:
        """(symbol_id, score), best first: ranking.keyword_search() of all symbols, from the postings of the query's terms."""
        version = self.store.latest()
        terms = ranking.terms_of(self.spark, text)
        parts = self.store.parts_of(self.spark.createDataFrame([(t,) for t in terms], "term string"), F.col("term"))
        scores = ranking.indexed_keyword_scores(self.postings(parts, version), terms, self.symbols(version=version).count(), "symbol_id")
        return scores.orderBy(F.desc("score"), "symbol_id").limit(limit)

    def semantic_search(self, text: str, top_k: int = ranking.TOP_FILES) -> DataFrame:
        query = self.spark.createDataFrame([(self.embedder([text])[0],)], "q array<double>")
        return ranking.hybrid_search(self.symbols(), self.vectors(), query, text, "symbol_id", "path", "symbol_id", "vector", *TEXT, top_k=top_k, keywords=self.keyword_search(text))

    def status(self) -> dict[str, int | str | None]:
        counts = lookup.totals(**{name: (table, F.count("*")) for name, table in (("files", self.files()), ("symbols", self.symbols()), ("vectors", self.vectors()))})
        return {"state": self.state} | counts.first().asDict() | {"built_at": self.store.get_meta("built_at"), "project_path": self.root}
