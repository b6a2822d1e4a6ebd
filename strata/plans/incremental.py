"""A graph kept current: after a change, only the files that changed are parsed and only those that refer to
what they offer are resolved again.

Facts of a version's new and changed files are a *segment*, written once and never rewritten until segments
are merged; ``live`` says for each path in which segment its facts are. ``asked`` lists, for each file, the
keys that its resolution looked up (import keys, the declarations of a file, names, SQL objects); what changed files offer before and after
the change is matched with it by a join. Edges across files are kept by their source and replaced for the files resolved
again; files that share a source id with one of those are resolved with it. Dedup over ids, folders and placeholders are
computed anew, since they are global. The result is that of ``analyze`` over all files.

A version is committed after all its tables are written; an update that is lost half-way leaves the last
version in place, and the next one starts from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.functions.ids import fold_dots, dir_name, resolve_rel
from strata.model import EDGE_SCHEMA, edges_like
from strata.plans import components, resolve
from strata.plans.analyze import AnalyzeConfig, Facts, assemble, first_pass, found_in_files, second_pass
from strata.plans.extract import cfamily, markup, sql, typescript
from strata.plans.extract.common import file_nodes, union_all
from strata.plans.graph import Graph
from strata.plans.registry import EXTRACTORS
from strata.session import scratch, written
from strata.sources.corpus import as_sources, read_files, scan_corpus
from strata.sources.store import GraphStore

LIVE = "path string, stamp string, language string, segment int"
SEGMENTS = 16  # beyond, an update first merges them into one
# Kinds of nodes that are never the source of an edge between files.
_NO_SOURCES = ["JSXAttribute", "JSXElement", "Parameter", "TailwindClass", "Variable"]


class LiveFacts(Facts):
    """Facts of the paths in ``live``, from the segments that hold them."""

    def __init__(self, spark: SparkSession, folder: str, live: DataFrame, work: str):
        super().__init__(live, work)
        self.folder, self.live = folder, live
        held = live.select("segment", "language").distinct().collect()  # at most segments x languages
        self.held = {(r["segment"], r["language"]) for r in held}

    def languages(self) -> set[str]:
        return {language for _, language in self.held}

    def _from(self, name: str, languages) -> DataFrame | None:
        """Rows of a table in the segments that hold a file of one of the languages."""
        segments = sorted({s for s, language in self.held if language in languages})
        parts = [self.spark.read.parquet(f"{self.folder}/facts/{s}/{name}").withColumn("segment", F.lit(s)) for s in segments]
        key = "file_path" if name == "files" else "path"
        own = self.live.select(F.col("path").alias(key), "segment")
        return union_all(parts).join(own, [key, "segment"], "left_semi").drop("segment") if parts else None

    def constructs(self, family: str) -> DataFrame:
        return self._from(family, EXTRACTORS[family].languages)

    def files(self) -> DataFrame:
        found = self._from("files", self.languages())
        return found if found is not None else file_nodes(as_sources(self.spark.createDataFrame([], "path string, text string")))

    def elements(self) -> DataFrame:
        return self._from("elements", ["TSX"])

    def components(self) -> DataFrame:
        return components.component_spans(self.constructs("typescript"), self.elements())


def asked(facts: Facts, nodes: DataFrame) -> DataFrame:
    """(path, key): what the resolution of each file in scope looks up in others."""
    found, out = facts.families(), []
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), c).alias("key")
    if "typescript" in found:
        ts = facts.scoped(facts.constructs("typescript"))
        files = facts.files().select(F.col("file_path").alias("path"))
        imports = typescript.import_rows(ts).select("path", "module").unionByName(
            typescript.export_rows(ts).where("module is not null").select("path", "module"))
        targets = resolve.resolve_imports(imports, files).where("target_path is not null")
        calls = typescript.call_sites(ts).where(~F.col("callee").contains(".")).select("path", F.col("callee").alias("name"))
        names = calls.unionByName(typescript.heritage_rows(ts).select("path", "name"))
        out += [imports.select("path", key("file", resolve_rel("path", "module"))), targets.select("path", key("declared", F.col("target_path"))),
                names.select("path", key("name", F.col("name")))]
    if "c" in found:
        includes = facts.scoped(resolve.include_rows(nodes)).where("not is_system")
        out += [includes.select("path", key("file", fold_dots(F.concat(dir_name("path"), F.lit("/"), F.col("include"))))),
                cfamily.heritage_rows(facts.scoped(facts.constructs("c"))).select("path", key("name", F.col("name")))]
    if "sql" in found:
        out.append(sql.reference_rows(facts.scoped(facts.constructs("sql"))).select("path", key("object", F.lower("object"))))
    empty = facts.spark.createDataFrame([], "path string, key string")
    return union_all([empty, *out]).where("key is not null").distinct()


def offered(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key): what others may have looked up in the changed files. ``changed``: (path, operation); ``nodes``: those of
    the files before and after."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), c).alias("key")
    listed = resolve.answers(changed.where("operation <> 'changed'").select("path"))
    objects = nodes.where(F.col("kind").isin("SQLTable", "SQLView", "SQLFunction", "SQLProcedure"))
    return (listed.select(key("file", F.col("key"))).unionByName(changed.select(key("declared", F.col("path"))))
            .unionByName(nodes.where(F.col("kind").isin("Function", "Class", "Interface", "CppClass")).select(key("name", F.col("name"))))
            .unionByName(objects.select(key("object", F.lower(F.coalesce(F.element_at("properties", "qualifiedName"), F.col("name"))))))
            .distinct())


class IncrementalGraph:
    """The state of a corpus' analysis under one folder. After ``update``, ``parsed`` and ``resolved`` say how many files were."""

    def __init__(self, spark: SparkSession, folder: str, config: AnalyzeConfig | None = None):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config or AnalyzeConfig()
        self.versions = GraphStore(spark, folder)
        self.parsed = self.resolved = 0

    def _table(self, name: str, version: int, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{version}") if version else self.spark.createDataFrame([], schema)

    def _put(self, df: DataFrame, name: str, version: int) -> DataFrame:
        path = f"{self.folder}/{name}/{version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def update_sources(self, sources: DataFrame) -> Graph:
        """Bring the graph to these sources (path, language, text). A text's digest tells whether it changed."""
        listing = sources.select("path", F.sha2("text", 256).alias("stamp"))
        return self.update(listing, lambda paths: sources.join(paths, "path", "left_semi"))

    def update_directory(self, root: str) -> Graph:
        """Bring the graph to the files below ``root``. Size and time of change tell whether a file changed; only files
        that did are opened."""
        c = self.config
        names = scan_corpus(self.spark, root, c.extensions, c.ignore, c.prune, c.on_error, texts=False)
        listing = names.select("path", F.concat_ws("-", F.col("size").cast("string"), F.unix_micros("mtime").cast("string")).alias("stamp"))
        return self.update(listing, lambda paths: as_sources(read_files(paths, root)))

    def update(self, listing: DataFrame, read: Callable[[DataFrame], DataFrame]) -> Graph:
        """``listing``: (path, stamp) of all files; ``read`` gives the sources of some paths."""
        old_version = self.versions.version()
        version = old_version + 1
        work = scratch(self.spark, "update")
        old = self._merged(self._table("live", old_version, LIVE), version, work)
        changed = self._changes(old, listing)
        fresh = written(read(changed.where("operation <> 'deleted'").select("path")).select("path", "language", "text"), "fresh")
        self.parsed = self._segment(fresh, version)
        # A file that could not be read this time is gone.
        kept = old.join(changed, "path", "left_anti")
        stamps = changed.where("stamp is not null").select("path", "stamp")
        live = self._put(kept.unionByName(fresh.join(stamps, "path").select("path", "stamp", "language", F.lit(version).alias("segment"))), "live", version)
        facts = LiveFacts(self.spark, self.folder, live, work)
        gone = LiveFacts(self.spark, self.folder, old.join(changed, "path", "left_semi"), f"{work}/gone")
        n1, e1 = first_pass(facts)
        nodes = facts.table("nodes", lambda: n1)
        ids_now, ids_before = self._ids(facts), self._ids(gone)
        affected = self._affected(changed, gone, facts, ids_now, ids_before, old_version)
        self.resolved = affected.count()
        facts.scope = affected
        again = second_pass(facts, nodes)
        touched = ids_now.join(affected, "path", "left_semi").select("id").union(ids_before.select("id")).distinct()
        before = self._table("resolved", old_version, EDGE_SCHEMA)
        second = self._put(before.join(touched, before.source_id == touched.id, "left_anti").unionByName(edges_like(again)), "resolved", version)
        stale = affected.union(changed.select("path"))
        self._put(self._table("asked", old_version, "path string, key string").join(stale, "path", "left_anti").unionByName(asked(facts, nodes)), "asked", version)
        graph = assemble(facts, nodes, e1, edges_like(second), self.config)
        self.versions.commit(version)
        return graph

    def _changes(self, old: DataFrame, listing: DataFrame) -> DataFrame:
        """(path, operation, stamp) of what differs from the last version."""
        both = old.select("path", F.col("stamp").alias("was")).join(listing, "path", "full")
        op = F.when(F.col("was").isNull(), "added").when(F.col("stamp").isNull(), "deleted").when(F.col("was") != F.col("stamp"), "changed")
        return written(both.select("path", op.alias("operation"), "stamp").where("operation is not null"), "changed")

    def _segment(self, fresh: DataFrame, version: int) -> int:
        """Parse the fresh files into the version's segment."""
        facts = Facts(fresh, f"{self.folder}/facts/{version}")
        for family in facts.families():
            facts.constructs(family)
        if "TSX" in facts.languages():
            facts.elements()
        return facts.files().count()

    def _ids(self, facts: LiveFacts) -> DataFrame:
        """(path, id) of the nodes that edges between files may come from, as each file has them."""
        if not facts.held:
            return self.spark.createDataFrame([], "path string, id string")
        nodes, _ = found_in_files(facts)
        return facts.table("ids", lambda: nodes.where(~F.col("kind").isin(_NO_SOURCES)).select(F.col("file_path").alias("path"), F.col("entity_id").alias("id")).distinct())

    def _affected(self, changed: DataFrame, gone: LiveFacts, facts: LiveFacts, ids_now: DataFrame, ids_before: DataFrame, old_version: int) -> DataFrame:
        """(path): the new and changed files, those that asked for what these offer, and those that share ids with one of them."""
        nodes = [found_in_files(f)[0].select("file_path", "kind", "name", "properties") for f in (gone, facts) if f.held]
        nodes = union_all(nodes).join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi") if nodes else None
        fresh = changed.where("operation <> 'deleted'").select("path")
        if nodes is None:
            return written(fresh, "affected")
        keys = offered(changed, nodes)
        known = self._table("asked", old_version, "path string, key string").join(keys, "key", "left_semi").select("path")
        paths = facts.live.select("path")
        affected = written(fresh.union(known).distinct().join(paths, "path", "left_semi"), "affected")
        size = affected.count()
        while True:
            shared = ids_now.join(affected, "path", "left_semi").select("id").union(ids_before.select("id")).distinct()
            affected = written(ids_now.join(shared, "id", "left_semi").select("path").union(affected).distinct(), "affected")
            grown = affected.count()
            if grown == size:
                return affected
            size = grown

    def _merged(self, live: DataFrame, version: int, work: str) -> DataFrame:
        """``live``, or with too many segments the same with all its facts in one, under a number that no version has."""
        facts = LiveFacts(self.spark, self.folder, live, f"{work}/merged")
        if len({s for s, _ in facts.held}) <= SEGMENTS:
            return live
        folder = f"{self.folder}/facts/{-version}"
        for family in facts.families():
            facts.constructs(family).write.mode("overwrite").parquet(f"{folder}/{family}")
        facts.files().write.mode("overwrite").parquet(f"{folder}/files")
        if "TSX" in facts.languages():
            facts.elements().write.mode("overwrite").parquet(f"{folder}/elements")
        return written(live.withColumn("segment", F.lit(-version)), "live")
