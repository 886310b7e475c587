"""The engine: one object for a source tree and its graph."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import certify, edges, region, search, snapshot, traverse
from tessera.operators.embed import Embedder, refreshed
from tessera.operators.extract import extract_files
from tessera.operators.merge import carry_forward, deps, merge_edges, sync
from tessera.policy import DIAGNOSTIC, TESTS, TraversalPolicy
from tessera.runtime import materialize
from tessera.schemas import EDGES, complete
from tessera.sources.scan import contents, oversized, walk
from tessera.sources.store import Store, changed_files, vanished_files


@dataclass
class Config:
    """Where the tree and the store are, which analyzers add edges of their own, and what semantic search goes by.

    Where native_languages are named only their analyzers run; those of native_disabled_languages never do. ``embeddings`` is 'tfidf' or 'static', which needs
    the files of a vocabulary and a matrix; where these can't be read the search is by TF-IDF.
    """

    root: str
    store: str | None = None
    native_analyzers: list = field(default_factory=list)
    native_languages: tuple[str, ...] = ()
    native_disabled_languages: tuple[str, ...] = ()
    embeddings: str = "tfidf"
    vocabulary: str | None = None
    matrix: str | None = None

    def resolved(self) -> Config:
        root = Path(self.root).resolve()
        if not root.is_dir():
            raise NotADirectoryError(str(root))
        if self.embeddings not in ("tfidf", "static"):
            raise ValueError(f"embeddings: {self.embeddings}")
        return replace(self, root=str(root), store=self.store or str(root / ".tessera"))

    def wants(self, languages) -> bool:
        """Whether an analyzer of these languages runs."""
        own = set(languages)
        return not own & set(self.native_disabled_languages) and (not self.native_languages or bool(own & set(self.native_languages)))

    def embedder(self) -> Embedder | None:
        if self.embeddings != "static" or not (self.vocabulary and self.matrix):
            return None
        try:
            return Embedder.load(self.vocabulary, self.matrix)
        except (OSError, ValueError):
            return None


class Engine:
    """Index a tree, then ask: symbols, query, deps, impact, tests, regions, conflicts, leases, snapshots, diffs, certification."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config.resolved()
        self.store = Store(spark, self.config.store)
        self.embedder = self.config.embedder()

    @classmethod
    def open(cls, spark: SparkSession, root: str, **more) -> Engine:
        return cls(spark, Config(root, **more))

    @property
    def root(self) -> str:
        return self.config.root

    def close(self) -> None:
        self.spark.catalog.clearCache()

    # writing

    def index(self, force: bool = False) -> dict:
        """Brings the store up to the tree: changed files are extracted anew, vanished ones pruned, edges rebuilt unless nothing changed."""
        # hashes and sizes are written, contents not: those of changed files are read again
        files = materialize(walk(self.spark, self.root).drop("content"), "walk")
        errors = [r.asDict() for r in oversized(files).collect()]
        current = files.withColumnRenamed("path", "file_path")
        stored = self.store.read("manifest")
        changed = (current.withColumn("state", F.lit("forced")) if force else changed_files(current, stored)).withColumnRenamed("file_path", "path")
        changed = materialize(changed, "changed")
        gone = materialize(vanished_files(current, stored), "gone")
        n_changed, n_gone, n_files = changed.count(), gone.count(), files.count()
        if n_changed or n_gone:
            new = materialize(extract_files(contents(changed.select("path", "language"), self.root)), "symbols")
            counts = new.groupBy("file_path").agg(F.count("*").cast("int").alias("symbol_count"))
            manifest = changed.select(F.col("path").alias("file_path"), "blob_sha", "language").join(counts, "file_path", "left").select("file_path", "blob_sha", "language", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), F.current_timestamp().alias("indexed_at"))
            symbols, manifest = self.store.upsert_files(new, manifest, gone)
            symbols = materialize(symbols, "all-symbols")
            built = edges.build(symbols)
            touched = {r.language for r in changed.select("language").unionByName(stored.join(gone, "file_path", "left_semi").select("language")).distinct().collect()}
            ran: set[str] = set()
            for analyzer in self.config.native_analyzers:
                # what an analyzer said of languages without a change is carried forward
                if self.config.wants(analyzer.languages()) and touched & set(analyzer.languages()) and analyzer.available(self.root):
                    built = built.unionByName(complete(analyzer.analyze(symbols, walk(self.spark, self.root)), EDGES))
                    ran |= set(analyzer.languages())
            untouched = [r.language for r in symbols.select("language").distinct().collect() if r.language not in touched | ran]
            built = materialize(merge_edges(built.unionByName(carry_forward(self.store.read("edges"), untouched, symbols))), "built")
            changes = {r.action: r.n for r in sync(self.store.read("edges"), built).groupBy("action").agg(F.count("*").alias("n")).collect()}
            index = search.tf_idf(search.term_counts(symbols, self._text())).withColumn("part", search.part_of(F.col("term"))).repartition("part")
            more = {"vectors": refreshed(symbols, self.store.read("vectors"), self.embedder)} if self.embedder else {}
            self.store.commit(symbols=symbols, manifest=manifest, edges=built, postings=index, **more)
        else:
            changes = {}
        return {"files": n_files, "indexed": n_changed, "skipped": n_files - n_changed, "pruned": n_gone, "edges": changes, "errors": errors} | {"symbols": self.symbols_table().count()}

    # reading

    def symbols_table(self) -> DataFrame:
        return self.store.read("symbols")

    def edges_table(self) -> DataFrame:
        return self.store.read("edges")

    def status(self) -> dict:
        return {"files": self.store.read("manifest").count(), "symbols": self.symbols_table().count(), "edges": self.edges_table().count()}

    def symbols(self, query: str, limit: int = 50) -> DataFrame:
        return search.lexical(self.symbols_table(), query, limit)

    @staticmethod
    def _text():
        return F.concat_ws(" ", "name", "qualified_name", "signature", "docstring", "parent_symbol")

    def semantic(self, query: str, limit: int = 20) -> DataFrame:
        """(id, score): by static embeddings where they are configured, else by TF-IDF over name, qualified name, signature, docstring and parent, from the stored index."""
        if self.embedder:
            return search.cosine_top(self.store.read("vectors"), self.embedder.embed(query).tolist(), limit)
        index = self.store.read("postings").filter(F.col("part").isin(search.parts_asked(self.spark, query)))
        return search.tf_idf_query(index, query, limit)

    def query(self, query: str, limit: int = 20) -> DataFrame:
        """Semantic hits, then lexical ones, ``limit`` in all."""
        hits = self.symbols(query, limit).select("id", "rank", F.concat_ws("|", "file_path", F.lpad(F.col("span.start").cast("string"), 9, "0")).alias("place"))
        return self.symbols_table().join(search.hybrid(self.semantic(query, limit), hits, limit), "id")

    def deps(self, path: str, include_inbound: bool = False) -> DataFrame:
        return deps(self.edges_table(), path, include_inbound)

    def impact(self, query: str, max_depth: int = 3, policy: TraversalPolicy = DIAGNOSTIC) -> DataFrame:
        return traverse.impact(self.symbols_table(), self.edges_table(), query, max_depth, policy)

    def tests(self, query: str, policy: TraversalPolicy = TESTS) -> DataFrame:
        return traverse.tests_for(self.symbols_table(), self.edges_table(), query, edges.is_test_symbol(), policy)

    def tests_with_evidence(self, query: str, policy: TraversalPolicy = TESTS) -> tuple[DataFrame, DataFrame]:
        seeds = traverse.seeds_of(self.symbols_table(), query)
        return self.tests(query, policy), traverse.skipped_in_closure(self.edges_table(), seeds, policy)

    def file_symbols(self, path: str) -> DataFrame:
        return self.symbols_table().filter(F.col("file_path") == path).orderBy("span.start", "id")

    def icr(self, intent: str) -> DataFrame:
        return region.isolated_region(self.symbols_table(), self.edges_table(), intent)

    def conflicts(self, a: str, b: str) -> DataFrame:
        return region.conflicts(self.icr(a), self.icr(b))

    # leases

    def lock(self, intent: str, ttl: timedelta = timedelta(minutes=30), now: datetime | None = None) -> bool:
        """Takes the leases of the intent's region, all or none."""
        keys = self.icr(intent).select(F.explode("lock_keys").alias("lock_key"))
        taken = region.acquire(self.store.read("leases"), keys, region.intent_id(intent), now or datetime.now(timezone.utc).replace(tzinfo=None), ttl)
        if taken is None:
            return False
        self.store.commit(leases=taken)
        return True

    def unlock(self, intent: str) -> int:
        """Gives back the intent's leases and returns how many they were."""
        held = self.store.read("leases")
        n = held.filter(F.col("intent_id") == region.intent_id(intent)).count()
        if n:
            self.store.commit(leases=region.release(held, region.intent_id(intent)))
        return n

    # snapshots

    def snapshot(self) -> DataFrame:
        """The symbols as they are now; later commits write elsewhere, so it stays as it is."""
        return self.symbols_table()

    def preview(self, path: str, content: str) -> DataFrame:
        """The symbols as they would be with this content of one file."""
        from tessera.functions.text import language_of

        one = self.spark.createDataFrame([(path, bytearray(content.encode()))], "path string, content binary").withColumn("language", language_of(F.col("path"))).filter("language IS NOT NULL")
        return self.symbols_table().filter(F.col("file_path") != path).unionByName(extract_files(one))

    def diff(self, before: DataFrame, after: DataFrame) -> DataFrame:
        return snapshot.with_renames(materialize(snapshot.diff(before, after), "changes"))

    def diff_since(self, before: DataFrame) -> DataFrame:
        return self.diff(before, self.symbols_table())

    def diff_against(self, path: str, content: str) -> DataFrame:
        return self.diff(self.file_symbols(path), self.preview(path, content).filter(F.col("file_path") == path))

    def certify(self, unified_diff: str, require_tests: bool = False) -> dict:
        current = walk(self.spark, self.root, content=False).select(F.col("path").alias("file_path"), "blob_sha")
        return certify.certify(unified_diff, self.symbols_table(), self.edges_table(), self.store.read("manifest"), current, edges.is_test_symbol(), require_tests)
