"""Questions over the archives of a scope, answered as DataFrames from its index."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as fn
from .functions.descriptors import display_type
from .operators import calls, cfg, diff, graph, logs, lookup, paging, policy, postings, symbols
from .operators.graph import checkpointed
from .schemas import GRAPH, RELATIONS
from .sources import archives, sink
from .sources.index import IndexStore

# How each build file begins, the form of a dependency in it, and how it ends.
BUILD_FILES = {
    "pom.xml": (
        '<project xmlns="http://maven.apache.org/POM/4.0.0">\n  <modelVersion>4.0.0</modelVersion>\n  <groupId>generated</groupId>\n  <artifactId>build-skeleton</artifactId>\n  <version>1</version>\n  <dependencies>',
        "    <dependency>\n      <groupId>{group_id}</groupId>\n      <artifactId>{artifact_id}</artifactId>\n      <version>{version}</version>\n    </dependency>",
        "  </dependencies>\n</project>\n",
    ),
    "build.gradle": ("plugins { id 'java' }\n\nrepositories { mavenCentral() }\n\ndependencies {", "    implementation '{group_id}:{artifact_id}:{version}'", "}\n"),
    "mvn_deploy.bat": ("@echo off", "mvn install:install-file -Dfile={file} -DgroupId={group_id} -DartifactId={artifact_id} -Dversion={version} -Dpackaging={packaging}", ""),
}


class Scope:
    """The archives at a path and their index. With ``build`` what is new or changed is indexed first; ``failures`` has what can't be read.

    Several scopes may share an index; each sees its own archives only.
    """

    def __init__(self, spark: SparkSession, path: str, index_path: str, recursive: bool = False, build: bool = True):
        self.spark, self.path, self.recursive, self.store = spark, fn.checked_path(path), recursive, IndexStore(spark, fn.checked_path(index_path))
        self.failures = self.store.refresh(self.path, recursive) if build else None
        self.archives = archives.scope_inputs(spark, self.path, recursive)

    def __getattr__(self, name: str) -> DataFrame:
        if name in RELATIONS:
            return self.store.read(name, self.archives)
        raise AttributeError(name)

    def search(self, query: str, kind: str = "all", mode: str = "plain", case_sensitive: bool = False, limit: int | None = 50, offset: int = 0, distinct: bool = False) -> DataFrame:
        """Hits (kind, archive_path, owner, name, descriptor, text) of all kinds in a fixed order, paged as one, with the total; all of them where ``limit`` is None."""
        hit = lambda c: fn.match(c, query, mode, case_sensitive)
        none = F.lit(None).cast("string")

        def rows(order: int, name, df: DataFrame, owner, member=none, desc=none, text=none) -> DataFrame:
            return df.select(F.lit(order).alias("kind_ord"), (F.lit(name) if isinstance(name, str) else name).alias("kind"), "archive_path", owner.alias("owner"), member.alias("name"), desc.alias("descriptor"), text.alias("text"))

        strings = self.texts_holding("strings_by_text", query, mode).where(hit("text"))
        if distinct:
            strings = paging.first_of_each(strings, ["text"], ["archive_path", "owner", F.coalesce("method_name", F.lit(""))])
        member_kind = F.when(F.col("name") == "<init>", "constructor").otherwise("method")
        line = fn.first_matching_line(F.col("text_content"), lambda x: hit(x))
        by_text = self.texts_holding("resources_by_text", query, mode).withColumn("_hit", line).where("_hit is not null").select("archive_path", "entry_path", "resource_type", "_hit")
        by_path = self.resources.select("archive_path", "entry_path", "resource_type").where(hit("entry_path")).join(by_text.select("archive_path", "entry_path"), ["archive_path", "entry_path"], "left_anti")
        resources = by_text.unionByName(by_path.withColumn("_hit", F.lit(None).cast(by_text.schema["_hit"].dataType)))
        every = [
            rows(0, "module", self.modules.where(hit("module_name")), F.col("module_name")), rows(1, "type", self.classes.where(hit("display_name") | hit("internal_name")), F.col("internal_name")),
            rows(2, "field", self.fields.where(hit("name")), F.col("owner"), F.col("name"), F.col("descriptor")),
            rows(3, member_kind, self.methods.where(hit("name")), F.col("owner"), F.col("name"), F.col("descriptor")),
            rows(4, "string", strings, F.col("owner"), F.col("method_name"), F.col("descriptor"), F.col("text")),
            rows(5, "resource", resources, F.col("entry_path"), F.col("resource_type"), F.col("_hit.line").cast("string"), F.col("_hit.snippet")),
        ]
        out = every[0]
        for df in every[1:]:
            out = out.unionByName(df)
        wanted = {"module": ["module"], "type": ["type"], "field": ["field"], "method": ["method", "constructor"], "constructor": ["constructor"], "string": ["string"], "resource": ["resource"]}.get(kind)
        out = out if wanted is None else out.where(F.col("kind").isin(wanted))
        order = ["kind_ord", "archive_path", "owner", "name", "descriptor", "text"]
        return paging.with_total(paging.page(out, order, offset, limit, limit is None), out).drop("kind_ord")

    def texts_holding(self, name: str, query: str, mode: str = "plain") -> DataFrame:
        """The rows of ``strings_by_text`` or ``resources_by_text`` that a pattern may match: those that hold its literal trigrams. Other texts are not read; a pattern without three literal characters together reads all."""
        table, wanted = self.store.read(name, self.archives), postings.literal_grams(query, mode)
        if not wanted:
            return table
        posted = self.store.read("trigrams", self.archives).where(F.col("bucket").isin([calls.bucket_of(F.lit(g)) for g in wanted]))
        ids = checkpointed(postings.holding(posted, wanted, "text_id"))
        return calls.near(table, "text_id", ids, "text_id")

    def search_to(self, folder: str, query: str, **options) -> DataFrame:
        """Write all hits of a search, whatever their number, as tab-separated text to ``folder``; returns the first twenty."""
        hits = self.search(query, **{**options, "limit": None, "offset": 0})
        line = F.concat_ws("\t", *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ") for c in hits.columns if c != "total"])
        hits.select(line.alias("value")).write.text(fn.checked_path(folder))
        return hits.limit(20)

    def type_lookup(self, query: str, mode: str = "plain", case_sensitive: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
        found = self.classes.where(fn.match("display_name", query, mode, case_sensitive) | fn.match("internal_name", query, mode, case_sensitive)).select("archive_path", "internal_name", "display_name")
        return paging.with_total(paging.page(found, ["archive_path", "internal_name"], offset, limit), found)

    def resolve_symbol(self, class_name: str, field: str | None = None, method: str | None = None, descriptor: str | None = None) -> DataFrame:
        """Types, fields and methods (kind, archive_path, owner, name, descriptor, outcome) that a name may mean, and why it is not one where it isn't."""
        owner, none = class_name.replace(".", "/"), F.lit(None).cast("string")
        types = self.classes.where(F.col("internal_name") == owner)
        n = types.agg(F.count("*").alias("_n"))
        out = n.join(types, F.lit(True), "left").select(F.lit("type").alias("kind"), "archive_path", F.lit(owner).alias("owner"), none.alias("name"), none.alias("descriptor"), F.when(F.col("_n") > 0, "resolved").otherwise("class_not_found").alias("outcome"))
        if field:
            out = out.unionByName(symbols.resolve(self.fields, self.classes, owner, field, descriptor, "field", one=False))
        if method:
            out = out.unionByName(symbols.resolve(self.methods, self.classes, owner, method, descriptor, "method"))
        return out

    def find_references(self, kind: str, owner: str, name: str | None = None, descriptor: str | None = None, max_nodes: int = 256) -> DataFrame:
        """Mentions of a type, callers of a method (and of its declaration in direct parents), or accesses of a field, in order, with one further row, flagged truncated, if there is one.

        A method or field is resolved first, with or without a descriptor. One that is not exactly one gives its candidates and the outcome, as
        :meth:`resolve_symbol` does, and no references.
        """
        owner = owner.replace(".", "/")
        if kind == "type":
            found, order = self.type_refs.where(F.col("target_type") == owner), ["archive_path", "source_owner", "source_member_name", "source_member_desc", "kind"]
            return graph.first_and_further(found.distinct(), order, max_nodes)
        if kind not in ("field", "method"):
            raise ValueError(f"unsupported kind: {kind}")
        named = symbols.resolve(self.fields if kind == "field" else self.methods, self.classes, owner, name, descriptor, kind)
        first = named.where("outcome = 'resolved'").first()
        if first is None:
            return named
        if kind == "field":
            found = self.field_refs.where((F.col("field_owner") == owner) & (F.col("field_name") == name) & (F.col("field_desc") == first.descriptor))
            order = ["archive_path", "source_owner", "source_name", "source_desc", "field_desc"]
        else:
            g = self.call_graph
            parents = g.by_child.where((F.col("child") == owner) & self._bucket(g.by_child, owner)).select("parent").distinct()
            above = checkpointed(parents.unionByName(self.spark.createDataFrame([(owner,)], "parent string")))
            found = symbols.callers(calls.near(g.by_target, "target_owner", above, "parent"), owner, name, first.descriptor, parents)
            order = ["ord", "archive_path", "source_owner", "source_name", "source_desc"]
        return graph.first_and_further(found.distinct(), order, max_nodes)

    @staticmethod
    def _bucket(table: DataFrame, owner: str):
        """The folder of a stored adjacency that a type is in."""
        return F.col("bucket") == calls.bucket_of(F.lit(owner)) if "bucket" in table.columns else F.lit(True)

    @property
    def call_graph(self) -> calls.CallGraph:
        """The stored adjacency of the scope's archives, as they are now."""
        current = checkpointed(self.store.current(self.archives))
        return calls.CallGraph(*[self.store.read(name, current=current) for name in GRAPH])

    def type_hierarchy(self, name: str, depth: int = 8, max_nodes: int = 256) -> DataFrame:
        return graph.type_hierarchy(self.classes, self.interfaces, name.replace(".", "/"), depth, max_nodes)

    def method_overrides(self, owner: str, name: str, descriptor: str | None = None, depth: int = 8, max_nodes: int = 256) -> DataFrame:
        """Declarations of a method in related types; without a descriptor the method must be one, else its candidates and the outcome are given."""
        owner = owner.replace(".", "/")
        named = symbols.resolve(self.methods, self.classes, owner, name, descriptor)
        first = named.where("outcome in ('resolved', 'source_ambiguous')").first()
        if first is None:
            return named
        return graph.method_overrides(self.classes, self.interfaces, self.methods, owner, name, first.descriptor, depth, max_nodes)

    def call_chain(self, owner: str, name: str, descriptor: str | None = None, direction: str = "both", depth: int = 3, max_nodes: int = 128) -> DataFrame:
        """Callees or callers by levels, or both, each with a budget of its own: (direction, node, archive_path, parent, depth, seq, truncated, outcome).

        Nodes are ``owner#name`` with the descriptor, and archive_path where they were found. The method is resolved first; if it is not exactly one, its candidates come with the outcome.
        """
        root = self.spark.createDataFrame([(0, owner.replace(".", "/"), name, descriptor)], "root int, owner string, name string, descriptor string")
        return self.call_chains(root, direction, depth, max_nodes).drop("root")

    def call_chains(self, wanted: DataFrame, direction: str = "both", depth: int = 3, max_nodes: int = 128) -> DataFrame:
        """:meth:`call_chain` of many methods at once, ``wanted`` (root, owner, name, descriptor or null), with their ``root``."""
        found = calls.chains(self.call_graph, wanted, self.classes, direction, depth, max_nodes)
        node = F.concat("owner", F.lit("#"), "name", F.coalesce("descriptor", F.lit("")))
        return found.select("root", "direction", node.alias("node"), "archive_path", "parent", "depth", "seq", "truncated", "outcome")

    def resolve_stacktrace(self, text: str | None = None, file: str | None = None, max_frames: int = 200) -> DataFrame:
        """Log lines by kind, of a text or else of a file; frames with their candidates: archives that hold the class, each with the methods of the name. Frames after ``max_frames`` are flagged skipped."""
        if text is None:
            lines = self.spark.read.text(fn.checked_path(file), wholetext=True).select(F.posexplode(F.split("value", r"\R")).alias("n", "line"))
        else:
            lines = self.spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], "n int, line string")
        entries = logs.parse_lines(lines)
        frames = entries.where("kind = 'frame'").select("n", "class_name", "method_name")
        first = paging.page(frames, ["n"], 0, max_frames)
        found = logs.frame_candidates(first, self.classes, self.methods, ["n"])
        out = entries.where("kind is not null").join(found.select("n", "candidates"), "n", "left")
        out = out.withColumn("skipped", (F.col("kind") == "frame") & F.col("candidates").isNull())
        return out.withColumn("archives", F.size("candidates")).withColumn("methods", F.aggregate("candidates", F.lit(0), lambda a, c: a + F.size(c["methods"]))).orderBy("n")

    def _facts(self, class_name: str) -> DataFrame:
        return self.store.read("facts", self.archives).where(F.col("owner") == class_name.replace(".", "/"))

    def class_metadata(self, class_name: str) -> DataFrame:
        """Name, parent, flags, version, interfaces, annotations, fields and methods of a class, for each archive that has it."""
        facts = self._facts(class_name)
        flags = lambda: fn.flag_names(F.col("access"))
        kind = lambda k: facts.where(F.col("kind") == k)
        head = kind("class").select("archive_path", F.col("owner").alias("internal_name"), fn.display_name(F.col("owner")).alias("display_name"), F.col("name").alias("super_name"), "access", flags().alias("access_flags"), F.col("seq").alias("bytecode_version"))
        marks = kind("annotation").groupBy("archive_path", "name", "descriptor").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda a: a["text"]).alias("annotations"))
        listed = lambda df, name, *cols: df.groupBy("archive_path").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        none = F.array().cast("array<string>")
        interfaces = kind("interface").groupBy("archive_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda i: fn.display_name(i["name"])).alias("interfaces"))
        typed = lambda k: kind(k).withColumn("type", display_type("descriptor"))
        fields = listed(typed("field"), "fields", "name", "descriptor", "type", flags().alias("access_flags"))
        methods = typed("method").join(marks, ["archive_path", "name", "descriptor"], "left").withColumn("annotations", F.coalesce("annotations", none))
        methods = listed(methods, "methods", "name", "descriptor", F.concat("name", "type").alias("signature"), flags().alias("access_flags"), "annotations")
        out = head.join(interfaces, "archive_path", "left").join(marks.where("name is null").select("archive_path", "annotations"), "archive_path", "left").join(fields, "archive_path", "left").join(methods, "archive_path", "left")
        kinds = dict(out.dtypes)
        return out.withColumns({c: F.coalesce(c, F.array().cast(kinds[c])) for c in ("interfaces", "annotations", "fields", "methods")})

    def show_bytecode(self, class_name: str) -> DataFrame:
        """A class's instructions in order: (archive_path, method, idx, opcode, instruction, operand, targets), instruction the opcode's name."""
        code = self._facts(class_name).where("kind = 'instruction'")
        member = F.concat(F.col("ref_owner"), F.when(F.col("ref_name").isNotNull(), F.concat(F.lit("#"), "ref_name", "ref_desc")).otherwise(""))
        operand = F.coalesce("text", F.when(F.col("ref_owner").isNotNull(), member).otherwise(F.concat("ref_name", "ref_desc")))
        return code.select("archive_path", F.concat("name", "descriptor").alias("method"), F.col("seq").alias("idx"), "opcode", cfg.opcode_name("opcode").alias("instruction"), operand.alias("operand"), "targets").orderBy("archive_path", "method", "idx")

    def show_cfg(self, class_name: str, method: str, descriptor: str | None = None, format: str = "mermaid") -> DataFrame:
        """(method, diagram) of the control flow of a class's methods of a name, as mermaid or plantuml or both; a method without code is empty."""
        facts = self._facts(class_name).where(F.col("name") == method)
        facts = facts.where(F.col("descriptor") == descriptor) if (descriptor or "").strip() else facts
        code, handlers = cfg.from_facts(facts)
        blocked = cfg.blocks(code)
        edges, label = cfg.all_edges(blocked, handlers), cfg.labels(blocked)
        made = [render(edges, label) for name, render in (("mermaid", cfg.mermaid), ("plantuml", cfg.plantuml)) if format in (name, "both")] or [cfg.mermaid(edges, label)]
        names = facts.where("kind = 'method'").select(F.concat("owner", F.lit("#"), "name", "descriptor").alias("method"))
        out = names
        for i, df in enumerate(made):
            out = out.join(df.withColumnRenamed("diagram", f"_{i}"), "method", "left")
        empty = {"plantuml": "@startuml\nstate Empty\n@enduml"}.get(format, 'graph TD\n  Empty["empty"]')
        return out.select("method", F.coalesce(F.array_join(F.array_compact(F.array(*[F.col(f"_{i}") for i in range(len(made))])), "\n\n"), F.lit("")).alias("diagram")).withColumn("diagram", F.when(F.col("diagram") == "", empty).otherwise(F.col("diagram")))

    def list_classes(self, package: str = "", include_inner: bool = False, limit: int = 200, offset: int = 0) -> DataFrame:
        found = self.classes.where(F.col("display_name").startswith(package))
        found = found if include_inner else found.where(~F.col("internal_name").contains("$"))
        return paging.page(found, ["archive_path", "internal_name"], offset, limit, zero_is_all=True)

    def analyze(self, pattern: str = "*") -> DataFrame:
        """(archive_path, kind, class_count, resource_count, size) of the archives whose name a glob matches, those without classes too, in order."""
        name = F.element_at(F.split("archive_path", "/"), -1)
        outer = F.regexp_replace("archive_path", r"!/.*", "").alias("archive_path")
        count = lambda df, c: df.groupBy(outer).agg(F.count("*").alias(c))
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", str(self.recursive).lower()).load(self.path).select(F.col("path").alias("archive_path"), F.col("length").alias("size"))
        out = self.archives.where(fn.glob(name, pattern)).join(files, "archive_path", "left")
        out = out.join(count(self.classes, "class_count"), "archive_path", "left").join(count(self.resources, "resource_count"), "archive_path", "left")
        return out.select("archive_path", "kind", F.coalesce("class_count", F.lit(0)).alias("class_count"), F.coalesce("resource_count", F.lit(0)).alias("resource_count"), "size").orderBy("archive_path")

    def list_dependencies(self, limit: int = 0, offset: int = 0) -> DataFrame:
        """Coordinates of the archives that state any, a page of them or all where ``limit`` is 0."""
        return paging.page(archives.coordinates(archives.read_archives(self.spark, self.path, self.recursive)[0]), ["archive_path"], offset, limit, zero_is_all=True)

    def dependencies_to(self, folder: str, limit: int = 0, offset: int = 0) -> None:
        """Write a page of the dependencies as text, one ``group:artifact:version`` a line."""
        self.list_dependencies(limit, offset).select(F.concat_ws(":", "group_id", "artifact_id", "version").alias("value")).coalesce(1).write.text(fn.checked_path(folder))

    def build_skeleton(self) -> DataFrame:
        """(archive_path, group_id, artifact_id, version, packaging) of all archives: what their pom.properties state, else what their names do."""
        given = archives.coordinates(archives.read_archives(self.spark, self.path, self.recursive)[0])
        name = fn.inferred_coordinates(F.element_at(F.split("archive_path", "/"), -1))
        every = self.archives.where("kind = 'archive'").select("archive_path", name.alias("c")).join(given, "archive_path", "left")
        return every.select("archive_path", *[F.coalesce(c, F.col(f"c.{c}")).alias(c) for c in ("group_id", "artifact_id", "version")], "c.packaging")

    def save_skeleton(self, folder: str) -> DataFrame:
        """Write pom.xml, build.gradle and mvn_deploy.bat with all archives of the scope, in order, to ``folder``; returns what was written."""
        plain = F.regexp_replace("archive_path", "^file:/*", "/")
        known = {"file": plain, **{c: F.col(c) for c in ("group_id", "artifact_id", "version", "packaging")}}
        # A form's texts and, in braces, the columns between them.
        line = lambda form: F.concat(*[known[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", form) if x])
        files = {name: (line(form), first, last) for name, (first, form, last) in BUILD_FILES.items()}
        listed = self.build_skeleton().agg(*[F.array_sort(F.collect_list(F.struct("archive_path", line.alias("line")))).alias(name.replace(".", "_")) for name, (line, _, _) in files.items()])
        text = lambda name, first, last: F.array_join(F.concat(F.array(F.lit(first)), F.transform(name.replace(".", "_"), lambda r: r["line"]), F.array(F.lit(last))), "\n")
        rows = F.array(*[F.struct(F.lit(name).alias("path"), text(name, first, last).cast("binary").alias("content")) for name, (_, first, last) in files.items()])
        return sink.write_files(listed.select(F.inline(rows)), fn.checked_path(folder))

    def save_sources(self, folder: str, metadata: bool = False) -> DataFrame:
        """Write a file for each source of the scope's archives, as the archives of sources beside them have them, and for each of their resources; returns (path, saved_to, size, error).

        Files stand below their archive's name where the scope has several. A resource gives way to a source of its path. With ``metadata`` each
        source has a ``.meta.json`` beside it.
        """
        name = lambda c: F.element_at(F.split(c, "/"), -1)
        every = archives.read_archives(self.spark, self.path if archives.is_folder(self.spark, self.path) else self.path.rsplit("/", 1)[0], self.recursive, nested=0)[0]
        own = self.archives.where("kind = 'archive'").select("archive_path").where(~F.col("archive_path").endswith("-sources.jar"))
        several = len(own.take(2)) > 1
        owners = own.select("archive_path", fn.sources_sibling(F.col("archive_path")).alias("_sources"))
        sources = every.withColumnRenamed("archive_path", "_sources").join(owners, "_sources").where("entry like '%.java' or entry like '%.kt' or entry like '%.groovy' or entry like '%.scala'")
        sources = sources.select("archive_path", "entry", "content", F.col("_sources").alias("origin"))
        resources = every.join(own, "archive_path", "left_semi").where(~F.col("entry").endswith(".class")).select("archive_path", "entry", "content", F.col("archive_path").alias("origin"))
        resources = resources.join(sources.select("archive_path", "entry"), ["archive_path", "entry"], "left_anti")
        path = F.concat(name(F.col("archive_path")), F.lit("/"), "entry") if several else F.col("entry")
        made = sources.unionByName(resources).select(path.alias("path"), "content")
        if metadata:
            about = F.to_json(F.struct("origin", "entry", F.length("content").alias("size"), F.sha2("content", 256).alias("sha256")))
            made = made.unionByName(sources.select(F.concat(path, F.lit(".meta.json")).alias("path"), about.cast("binary").alias("content")))
        return sink.write_files(made, fn.checked_path(folder))

    def source_lookup(self, class_name: str, given: str | None = None, repository: str | None = None, checksums: str | None = None, coordinates: tuple[str, str, str] | None = None) -> DataFrame:
        """(id: the archive, strategy, origin, entry, source) of a class, for each archive of the scope: from the archive ``given``, the one beside it, the ``repository``'s with its coordinates, or that with its checksum.

        Coordinates are ``coordinates`` or what the archive states, checksums those of the list ``checksums`` or the archive's own SHA-1.
        """
        folder = self.path if archives.is_folder(self.spark, self.path) else self.path.rsplit("/", 1)[0]
        own = self.archives.where("kind = 'archive'").select("archive_path").where(~F.col("archive_path").endswith("-sources.jar"))
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", str(self.recursive).lower()).load(self.path).select(F.col("path").alias("archive_path"), F.sha1("content").alias("_sha1"))
        if checksums:
            lines = self.spark.read.text(fn.checked_path(checksums)).select(fn.checksum_line(F.col("value")).alias("c")).select("c.*")
            listed = policy.checksum_of(own.select(F.col("archive_path").alias("path")), lines).select(F.col("path").alias("archive_path"), "checksum")
        else:
            listed = own.withColumn("checksum", F.lit(None).cast("string"))
        stated = archives.coordinates(archives.read_archives(self.spark, self.path, self.recursive)[0])
        wanted = own.join(files, "archive_path", "left").join(listed, "archive_path", "left").join(stated, "archive_path", "left")
        gav = dict(zip(("group_id", "artifact_id", "version"), coordinates or (None,) * 3))
        wanted = wanted.select(F.col("archive_path").alias("id"), F.lit(class_name).alias("class_name"), "archive_path", F.lit(archives.qualified(self.spark, given) if given else None).cast("string").alias("given"), *[F.coalesce(F.lit(v).cast("string"), F.col(c)).alias(c) for c, v in gav.items()], F.coalesce("checksum", "_sha1").alias("checksum"))
        good = lambda df: df.where("error_type is null").drop("error_type", "message")
        sources = good(archives.read_entries(self.spark, folder, self.recursive, nested=0, only="*-sources.jar"))
        if given:
            sources = sources.unionByName(good(archives.read_entries(self.spark, given, nested=0)))
        known = self.spark.createDataFrame([], "origin string, group_id string, artifact_id string, version string, checksum string")
        if repository:
            sources = sources.unionByName(good(archives.read_entries(self.spark, fn.checked_path(repository), True, nested=0, only="*-sources.jar")))
            known = archives.repository(self.spark, fn.checked_path(repository))
        return lookup.find_sources(wanted, sources.dropDuplicates(["archive_path", "entry", "ord"]), known, checkpointed)

    def resolve_types(self, named: DataFrame | None = None, platform: DataFrame | None = None) -> DataFrame:
        """(archive_path, target_type, container, level) of every type that the scope's archives refer to: the first container that has it, null where none has.

        The archive itself comes first, then those ``named`` (archive_path), those inside it, those of its folder and below, and those of the ``platform``.
        """
        stated = archives.coordinates(archives.read_archives(self.spark, self.path, self.recursive)[0])
        return lookup.resolve_types(self.type_refs.select("archive_path", "target_type").distinct(), self.classes, named, platform, stated)

    def match_methods(self, other: Scope) -> DataFrame:
        """(left, right, how) of this scope's methods and another version's: by owner, name and descriptor, or by these without packages where that tells them apart."""
        key = lambda scope: scope.methods.select(F.concat(F.lit("L"), "owner", F.lit(";"), "name", "descriptor").alias("key"))
        return lookup.relaxed_join(key(self), key(other), "key", fn.relaxed_key)

    def compare_lines(self, other: str, class_name: str) -> DataFrame:
        """Lines (line, left, right) in which a class's source differs between the archives of sources at this scope's path and at ``other``."""
        text = lambda path: archives.source_of(archives.read_archives(self.spark, path, self.recursive, nested=0)[0], class_name).agg(F.min_by("source", "archive_path").alias("text")).select(F.lit(class_name).alias("class_name"), F.coalesce("text", F.lit("")).alias("text"))
        return diff.compare_lines(text(self.path), text(fn.checked_path(other)), "class_name", "text")

    def compare(self, other: str) -> DataFrame:
        """Entries of this scope's archive against those of the archive at ``other``; in folders, of archives of the same name."""
        name = F.element_at(F.split("archive_path", "/"), -1)
        single = lambda path: self.spark.read.format("binaryFile").option("recursiveFileLookup", str(self.recursive).lower()).load(path).where(F.lower("path").rlike(fn.ARCHIVE)).select("path").limit(2).count() == 1
        alone = single(self.path) and single(other)
        side = lambda path: archives.read_archives(self.spark, path, self.recursive, nested=0)[0].select((F.lit("") if alone else name).alias("archive"), "entry", "size", "crc")
        return diff.compare_entries(side(self.path), side(other), ["archive", "entry"])
