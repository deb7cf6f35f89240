"""Symbol relations from facts, and their store: Parquet by generation with a manifest that is written last."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import QUALIFIED, object_types, resource_type, utf8_text
from ..operators.calls import bucket_of
from ..operators.graph import closure, type_edges
from ..operators.policy import class_entries, multi_release, refresh_plan
from ..operators.postings import postings
from ..schemas import ADJACENCY, FACTS, FAILURES, RELATIONS, SCHEMA_VERSION
from . import archives, classfile
from .xml_resources import xml_mentions

MAX_TEXT = 1_000_000
#: Files that a bucket of a stored adjacency is dealt out to at most, by types.
PARTS = 4
_TYPE_KINDS = {187: "new", 189: "anewarray", 192: "checkcast", 193: "instanceof", 197: "multi-anewarray"}


def visible_classes(entries: DataFrame, release: int) -> DataFrame:
    """The class entries that ``release`` reads, one for each class of an archive."""
    return multi_release(class_entries(entries), release, "ord").select("archive_path", "entry")


def entry_facts(entries: DataFrame, release: int = 25) -> DataFrame:
    """FACTS of the classes that ``release`` reads."""
    return classfile.class_facts(entries.join(visible_classes(entries, release), ["archive_path", "entry"], "left_semi"))


def relations(entries: DataFrame, release: int = 25) -> dict[str, DataFrame]:
    """The symbol relations of archive entries."""
    return relations_of(entry_facts(entries, release), resource_rows(entries))


def relations_of(facts: DataFrame, resources: DataFrame) -> dict[str, DataFrame]:
    """The symbol relations of facts and resources; ``facts`` are read many times and should be written before."""
    kind = lambda k: facts.where(F.col("kind") == k)
    code = kind("instruction")
    classes = kind("class").select("archive_path", F.col("owner").alias("internal_name"), F.translate("owner", "/", ".").alias("display_name"), F.col("name").alias("super_name"), F.col("access").alias("access_flags"), F.col("seq").alias("bytecode_version"))
    interfaces = kind("interface").select("archive_path", "owner", F.col("name").alias("interface_name"))
    member = ["archive_path", "owner", "name", "descriptor", F.col("access").alias("access_flags")]
    fields, methods = kind("field").select(*member), kind("method").select(*member)
    source = [F.col("owner").alias("source_owner"), F.col("name").alias("source_name"), F.col("descriptor").alias("source_desc")]
    target = [F.col("ref_owner").alias("target_owner"), F.col("ref_name").alias("target_name"), F.col("ref_desc").alias("target_desc")]
    invoked = code.where("opcode between 182 and 185")
    direct = invoked.select("archive_path", *source, *target).unionByName(kind("handle").select("archive_path", *source, *target))
    virtual = class_hierarchy_calls(invoked.where("opcode in (182, 185)").select("archive_path", *source, *target), classes, interfaces, methods)
    text = code.where("ref_owner = 'string' and opcode in (18, 19)").select("archive_path", "owner", F.col("name").alias("method_name"), "descriptor", "text").unionByName(kind("string").select("archive_path", "owner", F.col("name").alias("method_name"), "descriptor", "text"))
    accessed = code.where("opcode between 178 and 181").select("archive_path", F.col("ref_owner").alias("field_owner"), F.col("ref_name").alias("field_name"), F.col("ref_desc").alias("field_desc"), *source)
    declared = fields.select("archive_path", F.col("owner").alias("field_owner"), F.col("name").alias("field_name"), F.col("descriptor").alias("field_desc"))
    missed = kind("failure").select("archive_path", F.substring_index("text", ":", 1).alias("error_type"), F.concat_ws(": ", "entry", "text").alias("message"))
    return {
        "classes": classes, "interfaces": interfaces, "fields": fields, "methods": methods, "strings": text,
        "calls": direct.unionByName(virtual).distinct(),
        # A reference counts where its owner declares the field in the same archive.
        "field_refs": accessed.join(declared, ["archive_path", "field_owner", "field_name", "field_desc"], "left_semi"),
        "type_refs": type_references(facts, resources, virtual), "resources": resources,
        "modules": kind("module").select("archive_path", F.col("name").alias("module_name")), "failures": missed,
        "annotations": kind("annotation").select("archive_path", "owner", "name", "descriptor", "seq", F.col("text").alias("annotation")),
    }


def class_hierarchy_calls(virtual: DataFrame, classes: DataFrame, interfaces: DataFrame, methods: DataFrame, split: int = 1 << 16) -> DataFrame:
    """Calls that virtual calls may also reach: declarations of the method in all subtypes, within an archive.

    What meets the type graph are distinct signatures: declarations of a name and descriptor that are called at all take the supertypes of their owner, and
    those pairs whose supertype is called by that name and descriptor are what the calls are joined with. Calls are not multiplied by subtypes that declare
    nothing. A signature with more than ``split`` calls is cut into so many.
    """
    callee = ["archive_path", "target_owner", "target_name", "target_desc"]
    called = virtual.groupBy(*callee).agg(F.ceil(F.count("*") / split).cast("int").alias("cuts"))
    tag = lambda a, n: F.concat_ws("\0", a, n)
    up = type_edges(classes, interfaces)
    pairs = closure(up.select(tag("archive_path", "parent").alias("src"), tag("archive_path", "child").alias("dst")), called.select(tag("archive_path", "target_owner").alias("src")))
    part = lambda c, k: F.split(c, "\0")[k]
    pairs = pairs.select(part("src", 0).alias("archive_path"), part("src", 1).alias("target_owner"), part("dst", 1).alias("sub"))
    declared = methods.select("archive_path", F.col("owner").alias("sub"), F.col("name").alias("target_name"), F.col("descriptor").alias("target_desc")).distinct()
    declared = declared.join(called.select("archive_path", "target_name", "target_desc").distinct(), ["archive_path", "target_name", "target_desc"], "left_semi")
    reached = declared.join(pairs, ["archive_path", "sub"]).join(called, callee)
    reached = reached.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
    hot = called.where("cuts > 1")
    calls = virtual.join(hot, callee, "left").withColumn("cut", F.pmod(F.xxhash64("source_owner", "source_name", "source_desc"), F.coalesce("cuts", F.lit(1))).cast("int")).drop("cuts")
    found = calls.join(reached, [*callee, "cut"])
    return found.select("archive_path", "source_owner", "source_name", "source_desc", F.col("sub").alias("target_owner"), "target_name", "target_desc")


def adjacency(made: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The relations of ADJACENCY from the symbol relations, each with its rows' ``bucket``."""
    strings, resources = made["strings"].withColumn("text_id", F.xxhash64("text")), made["resources"].withColumn("text_id", F.xxhash64("text_content"))
    texts = strings.select("archive_path", "text_id", "text").unionByName(resources.where("text_content is not null").select("archive_path", "text_id", F.col("text_content").alias("text")))
    of = {
        "calls": made["calls"], "types": type_edges(made["classes"], made["interfaces"]).select("archive_path", "parent", "child").distinct(), "methods": made["methods"], "strings": strings, "resources": resources,
        # Texts of one id have their trigrams together, so that none is missed.
        "trigrams": postings(texts, "text_id", "text", "archive_path").distinct(),
    }
    return {name: of[name.split("_")[0]].select(*[c.split()[0] for c in schema.split(", ")], bucket_of(key).alias("bucket")) for name, (key, schema) in ADJACENCY.items()}


def type_references(facts: DataFrame, resources: DataFrame, virtual: DataFrame) -> DataFrame:
    """(archive_path, source_owner, source_member_name, source_member_desc, target_type, kind): every mention of a type."""
    def rows(where: str, kind, target, method: bool = True):
        named = [F.col("name"), F.col("descriptor")] if method else [F.lit(None).cast("string")] * 2
        return facts.where(where).select("archive_path", F.col("owner").alias("source_owner"), named[0].alias("source_member_name"), named[1].alias("source_member_desc"), target.alias("target_type"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))

    each = lambda c: F.explode(object_types(F.col(c)))
    call = "kind = 'instruction' and opcode between 182 and 185"
    field = "kind = 'instruction' and opcode between 178 and 181"
    by_opcode = F.create_map(*[x for k, v in _TYPE_KINDS.items() for x in (F.lit(k), F.lit(v))])
    parts = [
        rows("kind = 'class' and name is not null", "extends", F.col("name"), False), rows("kind = 'interface'", "implements", F.col("name"), False),
        rows("kind = 'field'", "field-type", each("descriptor")), rows("kind = 'method'", "method-signature", each("descriptor")), rows("kind = 'throws'", "throws", F.col("text")),
        rows(call, "method-owner", F.col("ref_owner")), rows(call, "method-descriptor", each("ref_desc")), rows(field, "field-owner", F.col("ref_owner")), rows(field, "field-descriptor", each("ref_desc")),
        rows("kind = 'instruction' and opcode in (187, 189, 192, 193, 197)", by_opcode[F.col("opcode")], F.col("ref_owner")),
        rows("kind = 'instruction' and opcode = 186", "invokedynamic", each("ref_desc")), rows("kind = 'handle'", "handle-owner", F.col("ref_owner")), rows("kind = 'handle'", "handle-descriptor", each("ref_desc")),
        rows("kind = 'instruction' and opcode in (18, 19) and ref_owner = 'class'", "type-constant", F.col("text")), rows("kind = 'constant'", "type-constant", F.col("text")),
        rows("kind = 'handler' and text is not null", "catch", F.col("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    cha = virtual.select("archive_path", "source_owner", F.col("source_name").alias("source_member_name"), F.col("source_desc").alias("source_member_desc"), F.col("target_owner").alias("target_type"), F.lit("cha-virtual").alias("kind"))
    # Services name their interface by their path and providers by their lines; other texts any qualified name. A blank resource refers to nothing.
    said = resources.where(F.trim(F.regexp_replace("text_content", r"\s+", " ")) != "").withColumn("source_owner", F.concat(F.lit("resource:"), "entry_path"))
    service = said.where("resource_type = 'service'")
    lines = service.select("archive_path", "source_owner", F.explode(F.split("text_content", r"\R")).alias("line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where("line <> '' and line not like '#%'")
    plain = said.where("resource_type not in ('service', 'xml')").select("archive_path", "source_owner", F.col("resource_type").alias("member"), F.concat(F.lit("resource-"), "resource_type").alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("text_content", F.lit(QUALIFIED), F.lit(0)))).alias("target"))
    xml = said.where("resource_type = 'xml'").select("archive_path", "source_owner", F.explode(xml_mentions("text_content")).alias("m")).select("archive_path", "source_owner", "m.*")
    interface = service.where(F.col("entry_path").rlike("^META-INF/services/.")).select("archive_path", "source_owner", F.lit("service-interface").alias("member"), F.regexp_replace("entry_path", "^META-INF/services/", "").alias("target"), F.lit("resource-service-interface").alias("kind"))
    provider = lines.select("archive_path", "source_owner", F.lit("service-provider").alias("member"), F.col("line").alias("target"), F.lit("resource-service-provider").alias("kind"))
    found = interface.unionByName(provider).unionByName(plain).unionByName(xml)
    return out.unionByName(cha).unionByName(found.select("archive_path", "source_owner", F.col("member").alias("source_member_name"), F.lit(None).cast("string").alias("source_member_desc"), F.translate("target", ".", "/").alias("target_type"), "kind"))


def resource_text() -> Column:
    """Text of up to a megabyte without a null byte, else null."""
    small = (F.length("content") <= MAX_TEXT) & (F.position(F.lit(b"\0"), F.col("content")) == 0)
    return F.when(small, utf8_text(F.col("content")))


def resource_rows(entries: DataFrame) -> DataFrame:
    """Resources of the kinds that are indexed, with their text."""
    kind = resource_type(F.col("entry"))
    return entries.where(~F.col("entry").endswith(".class") & kind.isNotNull()).select("archive_path", F.col("entry").alias("entry_path"), kind.alias("resource_type"), resource_text().alias("text_content"))


class IndexStore:
    """Symbol relations on disk: one folder for each relation and generation; the manifest names what is current.

    An attempt to index writes a generation of its own and names it in the manifest last. What an attempt leaves that ended before is in no
    manifest and never read, and the next attempt does not add to it; :meth:`vacuum` deletes it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> DataFrame:
        """(archive_path, fingerprint, generation) of the current archives; empty at first and after a change of schema."""
        schema = "archive_path string, fingerprint string, generation long, version int"
        try:
            every = self.spark.read.schema(schema).parquet(f"{self.path}/manifest")
            every.take(1)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            every = self.spark.createDataFrame([], schema)
        last = every.groupBy("archive_path").agg(F.max(F.struct("generation", "fingerprint", "version")).alias("m")).select("archive_path", "m.*")
        return last.where((F.col("version") == SCHEMA_VERSION) & F.col("fingerprint").isNotNull()).select("archive_path", "fingerprint", "generation")

    def _write(self, name: str, df: DataFrame, generation: int) -> DataFrame:
        rows = df.withColumn("generation", F.lit(generation).cast("long"))
        if name in ADJACENCY:
            key = ADJACENCY[name][0]
            # A folder for each bucket, in which rows stand by their type: few row groups hold what is asked for.
            rows.repartition("bucket", F.pmod(F.xxhash64(key, F.lit("part")), F.lit(PARTS))).sortWithinPartitions("bucket", key).write.mode("append").partitionBy("generation", "bucket").parquet(f"{self.path}/{name}")
            return df
        rows.write.mode("append").partitionBy("generation").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}").where(F.col("generation") == generation).drop("generation")

    def refresh(self, scope: str, recursive: bool = False, release: int = 25) -> DataFrame:
        """Index the archives of ``scope`` whose fingerprint is new or changed, and forget those that are gone; returns what can't be read.

        Only archives that are not current are opened. An archive that fails stays as it was in the index, and is tried again next time; a class
        that fails is left out of its archive and listed with the failures.
        """
        generation = max(time.time_ns(), (self.manifest().agg(F.max("generation")).first()[0] or 0) + 1)
        plan = refresh_plan(archives.fingerprints(self.spark, scope, recursive), self.manifest().select("archive_path", "fingerprint"))
        plan = self._write("plan", plan.where("state <> 'current'"), generation)
        folder, none = archives.qualified(self.spark, scope), F.lit(None).cast("string")
        gone = self.gone(scope, recursive).select("archive_path", none.alias("fingerprint"))
        if plan.isEmpty():
            self._name(gone, generation)
            return self.spark.createDataFrame([], FAILURES)
        own = F.col("archive_path") == folder
        every = None
        if archives.is_folder(self.spark, scope):
            if not plan.where(own).isEmpty():
                every = archives.read_class_folder(self.spark, scope).withColumns({"error_type": none, "message": none})
            plan_of = plan.where(~own)
        else:
            plan_of = plan
        if not plan_of.isEmpty():
            zipped = archives.read_named(self.spark, plan_of.select("archive_path"))
            every = zipped if every is None else every.unionByName(zipped)
        # Each archive is opened, unzipped and parsed once, by one task; what has been written is then sorted out.
        parsed = self._write("parsed", classfile.parsed(every, MAX_TEXT), generation)
        places = parsed.where("kind = 'entry'").select("archive_path", "entry", F.col("seq").alias("ord"))
        hidden = places.join(visible_classes(places, release), ["archive_path", "entry"], "left_anti").select("archive_path", "entry")
        names = [c.split()[0] for c in FACTS.split(", ")]
        facts = self._write("facts", parsed.where("kind not in ('entry', 'resource', 'unread')").select(*names).join(hidden, ["archive_path", "entry"], "left_anti").select(*names), generation)
        resources = self._write("others", parsed.where("kind = 'resource'").select("archive_path", F.col("entry").alias("entry_path"), resource_type(F.col("entry")).alias("resource_type"), utf8_text(F.col("content")).alias("text_content")).where("resource_type is not null"), generation)
        found = relations_of(facts, resources)
        made = {name: self._write(name, found[name].select(*[c.split()[0] for c in schema.split(", ")]), generation) for name, schema in RELATIONS.items()}
        for name, rows in adjacency(made).items():
            self._write(name, rows, generation)
        bad = parsed.where("kind = 'unread'").select("archive_path", "error_type", "message")
        done = plan.join(bad, "archive_path", "left_anti").select("archive_path", "fingerprint")
        self._name(done.unionByName(gone), generation)
        return bad.unionByName(made["failures"])

    def _name(self, rows: DataFrame, generation: int) -> None:
        """Add (archive_path, fingerprint) to the manifest; a null fingerprint says that the archive is gone."""
        rows.select("archive_path", "fingerprint", F.lit(generation).cast("long").alias("generation"), F.lit(SCHEMA_VERSION).alias("version")).write.mode("append").parquet(f"{self.path}/manifest")

    def gone(self, scope: str, recursive: bool = False) -> DataFrame:
        """Archives of the manifest that stood in a folder ``scope`` and do so no longer."""
        root = archives.qualified(self.spark, scope)
        below = F.col("archive_path").startswith(root + "/")
        if not recursive:
            below = below & ~F.substring("archive_path", len(root) + 2, 1 << 20).contains("/")
        now = archives.scope_inputs(self.spark, scope, recursive).select("archive_path")
        return self.manifest().where(below | (F.col("archive_path") == root)).select("archive_path").join(now, "archive_path", "left_anti")

    def current(self, scope: DataFrame | None = None) -> DataFrame:
        """(_outer, generation): the newest generation of each archive, or of those of ``scope`` (archive_path)."""
        current = self.manifest().select(F.col("archive_path").alias("_outer"), "generation")
        return current if scope is None else current.join(scope.select(F.col("archive_path").alias("_outer")).distinct(), "_outer", "left_semi")

    def read(self, name: str, scope: DataFrame | None = None, current: DataFrame | None = None) -> DataFrame:
        """A relation's current rows, of all archives or of those of ``scope`` (archive_path): what the newest generation of each archive has written. ``current`` may have what :meth:`current` gives, written."""
        current = self.current(scope) if current is None else current
        schema = f"{ADJACENCY[name][1]}, generation long, bucket int" if name in ADJACENCY else f"{FACTS if name == 'facts' else RELATIONS[name]}, generation long"
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}").withColumn("_outer", F.regexp_replace("archive_path", r"!/.*", ""))
        return rows.join(current, ["_outer", "generation"], "left_semi").drop("_outer", "generation")

    def vacuum(self) -> list[str]:
        """Delete the generations that no archive's newest rows are in; returns their folders. No other attempt may be under way."""
        kept = {f"generation={r.generation}" for r in self.manifest().select("generation").distinct().toLocalIterator()}
        jvm, removed = self.spark._jvm, []
        for name in (*RELATIONS, *ADJACENCY, "facts", "others", "parsed", "plan"):
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in system.listStatus(where) if system.exists(where) else []:
                if status.isDirectory() and status.getPath().getName() not in kept:
                    removed.append(status.getPath().toString())
                    system.delete(status.getPath(), True)
        return removed
