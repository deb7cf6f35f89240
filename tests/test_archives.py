"""Archives compiled at test time, read, indexed and queried."""

import base64
import random
import shutil
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.operators import graph, logs, symbols
from tessella.sources import archives
from tessella.sources.index import RELATIONS, IndexStore
from tessella.streaming.refresh import watch

pytestmark = pytest.mark.skipif(not shutil.which("javac"), reason="no javac")

SOURCES = {
    "demo/Dependency.java": 'package demo; public class Dependency { public static final String NAME = "constant"; public static String value() { return "worker"; } }',
    "demo/Base.java": "package demo; public class Base { protected int n; public int value() { return n; } }",
    "demo/Child.java": "package demo; public class Child extends Base implements Runnable { @Override public int value() { return 2; } public void run() { try { value(); } catch (IllegalStateException e) { throw e; } } }",
    "demo/Main.java": """package demo; public class Main {
        public static void run(Base b) { helper(); Dependency.value(); b.value(); Runnable r = Main::helper; r.run(); }
        static void helper() { int x = 3; switch (x) { case 1: x = 2; break; case 500: x = 4; break; default: x = 5; } new Child().run(); }
    }""",
}


EXTRA = {
    "META-INF/services/demo.Service": "# providers\n  demo.Child\t\n\ndemo.Odd # not a comment\n",
    "META-INF/services/demo.Blank": " \n\t\n",
    "config/app.properties": "main=demo.Main\n",
    "blob.txt": b"a\0b",
    "WEB-INF/web.xml": '<web-app xmlns="http://x.example/ns"><servlet><servlet-class> Plain </servlet-class><init a="demo.Base"/></servlet><note>uses demo.Child and demo.Child</note></web-app>',
    "broken.xml": "<a><b>demo.Main</a>",
    "META-INF/maven/g/a/pom.properties": "groupId=g\nartifactId=a\nversion=1.2\n",
}


def build(folder, name, sources, extra=None):
    src, out = folder / f"{name}-src", folder / f"{name}-out"
    for path, text in sources.items():
        (src / path).parent.mkdir(parents=True, exist_ok=True)
        (src / path).write_text(text)
    subprocess.run(["javac", "-d", str(out), *(str(src / p) for p in sources)], check=True)
    jar = folder / "jars" / f"{name}.jar"
    jar.parent.mkdir(exist_ok=True)
    with zipfile.ZipFile(jar, "w") as z:
        for p in sorted(out.rglob("*.class")):
            z.write(p, str(p.relative_to(out)))
        for entry, data in (extra or {}).items():
            z.writestr(entry, data)
    return jar


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("jars")
    build(folder, "demo", SOURCES, EXTRA)
    (folder / "jars" / "bad.apk").write_bytes(b"PK\x05\x06" + b"\0" * 18)
    (folder / "jars" / "note.txt").write_text("no archive")
    store = IndexStore(spark, str(folder / "index"))
    failures = store.refresh(str(folder / "jars")).collect()
    return folder, store, failures


def test_failures_do_not_stop_the_index(world):
    _, store, failures = world
    assert [(f.archive_path.rsplit("/", 1)[1], f.message) for f in failures] == [("bad.apk", "no classes.dex")]
    assert store.manifest().count() == 1
    assert all(store.read(name).columns for name in RELATIONS)


def test_symbols(world):
    _, store, _ = world
    classes = store.read("classes")
    assert {(r.internal_name, r.super_name) for r in classes.collect()} == {("demo/Dependency", "java/lang/Object"), ("demo/Base", "java/lang/Object"), ("demo/Child", "demo/Base"), ("demo/Main", "java/lang/Object")}
    assert [(r.owner, r.interface_name) for r in store.read("interfaces").collect()] == [("demo/Child", "java/lang/Runnable")]
    assert {(r.method_name, r.text) for r in store.read("strings").collect()} == {("NAME", "constant"), ("value", "worker")}
    assert {(r.owner, r.descriptor) for r in symbols.candidates(store.read("methods"), classes, "value").collect()} == {("demo/Dependency", "()Ljava/lang/String;"), ("demo/Base", "()I"), ("demo/Child", "()I")}
    assert {(r.field_owner, r.source_name) for r in store.read("field_refs").collect()} == {("demo/Base", "value")}


def test_calls_and_hierarchy(world):
    _, store, _ = world
    calls = store.read("calls").where("source_owner = 'demo/Main' and source_name = 'run'")
    assert {(r.target_owner, r.target_name) for r in calls.collect()} == {("demo/Main", "helper"), ("demo/Dependency", "value"), ("demo/Base", "value"), ("demo/Child", "value"), ("java/lang/Runnable", "run"), ("demo/Child", "run")}
    key = lambda side: F.concat_ws("#", f"{side}_owner", f"{side}_name")
    edges = store.read("calls").select(key("source").alias("src"), key("target").alias("dst"), F.lit(0).alias("ord"))
    chain = graph.bfs(edges, "demo/Main#run", 3, graph.Budget(128)).collect()
    assert {"demo/Main#helper", "demo/Dependency#value", "demo/Child#run"} <= {r.node for r in chain} and not any(r.truncated for r in chain)
    assert graph.bfs(edges, "demo/Main#run", 3, graph.Budget(1)).collect()[-1].truncated
    found = graph.method_overrides(store.read("classes"), store.read("interfaces"), store.read("methods"), "demo/Base", "value", "()I", depth=1).collect()
    assert {r.owner for r in found} == {"demo/Base", "demo/Child"}


def test_type_references(world):
    _, store, _ = world
    refs = {(r.source_owner, r.target_type, r.kind) for r in store.read("type_refs").collect()}
    assert {
        ("demo/Child", "demo/Base", "extends"), ("demo/Main", "demo/Child", "new"), ("demo/Child", "java/lang/IllegalStateException", "catch"), ("demo/Main", "demo/Child", "cha-virtual"),
        ("resource:META-INF/services/demo.Service", "demo/Service", "resource-service-interface"), ("resource:META-INF/services/demo.Service", "demo/Child", "resource-service-provider"),
        ("resource:WEB-INF/web.xml", "Plain", "resource-xml-path"), ("resource:WEB-INF/web.xml", "demo/Base", "resource-xml"), ("resource:broken.xml", "demo/Main", "resource-xml"),
        ("resource:config/app.properties", "demo/Main", "resource-properties"), ("demo/Main", "demo/Main", "handle-owner"),
    } <= refs
    services = [(r.source_member_name, r.target_type) for r in store.read("type_refs").where("source_owner like '%services/%'").collect()]
    assert sorted(services) == [("service-interface", "demo/Service"), ("service-provider", "demo/Child"), ("service-provider", "demo/Odd # not a comment")]
    places = {(r.source_member_name, r.target_type) for r in store.read("type_refs").where("source_owner like '%.xml'").collect()}
    assert places == {("web-app/servlet/servlet-class", "Plain"), ("web-app/servlet/init/@a", "demo/Base"), ("web-app/note", "demo/Child"), ("xml", "demo/Main")}
    assert [r.text_content for r in store.read("resources").where("entry_path = 'blob.txt'").collect()] == [None]


def test_refresh_skips_what_is_current(spark, world):
    folder, store, _ = world
    before = store.manifest().collect()
    store.refresh(str(folder / "jars"))
    assert store.manifest().collect() == before
    changed = dict(SOURCES, **{"demo/Dependency.java": SOURCES["demo/Dependency.java"].replace('"worker"', '"two"')})
    shutil.rmtree(folder / "demo-out")
    build(folder, "demo", changed, EXTRA)
    watch(spark, str(folder / "jars"), store, str(folder / "stream"), once=True).awaitTermination()
    assert {r.text for r in store.read("strings").collect()} == {"constant", "two"}
    assert store.read("classes").count() == 4


def test_coordinates_and_nested_libraries(spark, tmp_path):
    inner = build(tmp_path, "inner", {"x/In.java": "package x; class In {}"}, {"META-INF/maven/g/a/pom.properties": "groupId=g\nartifactId=a\nversion=1.2\n"})
    outer = tmp_path / "app.jar"
    with zipfile.ZipFile(outer, "w") as z:
        z.write(inner, "BOOT-INF/lib/inner.jar")
        z.writestr("BOOT-INF/lib/broken.jar", b"no zip")
    entries, failures = archives.read_archives(spark, str(outer))
    assert failures.count() == 0
    assert entries.where("archive_path like '%app.jar!/BOOT-INF/lib/inner.jar' and entry = 'x/In.class'").count() == 1
    assert [tuple(r)[1:] for r in archives.coordinates(entries).collect()] == [("g", "a", "1.2")]


def test_class_folder(spark, world):
    from tessella.sources.index import relations

    folder, _, _ = world
    entries = archives.read_class_folder(spark, str(folder / "demo-out"))
    assert {r.entry for r in entries.select("entry").collect()} == {f"demo/{n}.class" for n in ("Dependency", "Base", "Child", "Main")}
    assert relations(entries)["methods"].where("name = 'helper'").count() == 1


def test_log_kinds(spark):
    text = ["2024-05-05 10:00:00,123 ERROR [main] demo.Main - failed", "java.lang.IllegalStateException: boom", "\tat demo.Main.run(Main.java:5)", "\tat a.B.c(Native Method)", "Caused by: x.DeepError", "\tat a.B.d(Unknown Source)", "\t... 2 more", "prose"]
    rows = logs.parse_lines(spark.createDataFrame(list(enumerate(text)), "n int, line string")).orderBy("n").collect()
    assert [r.kind for r in rows] == ["log", "header", "frame", "frame", "causedBy", "frame", "omitted", None]
    assert (rows[2].class_name, rows[2].method_name, rows[2].file_name, rows[2].source_line) == ("demo.Main", "run", "Main.java", 5)
    assert rows[3].native_method and rows[5].unknown_source and rows[6].omitted == 2


def test_scope(spark, world):
    from tessella.api import Scope

    folder, store, _ = world
    scope = Scope(spark, str(folder / "jars"), store.path, build=False)
    hits = scope.search("value").collect()
    assert {"method", "string"} & {r.kind for r in hits} and all(r.total == len(hits) for r in hits)
    assert [(r.kind, r.owner) for r in scope.search("demo.main", kind="resource").collect()] == [("resource", "broken.xml"), ("resource", "config/app.properties")]
    assert scope.type_lookup("demo.ch*d", "wildcard").first().internal_name == "demo/Child"
    assert {r.source_name for r in scope.find_references("method", "demo.Child", "value", "()I").collect()} >= {"run"}
    assert {r.node for r in scope.type_hierarchy("demo.Child").collect()} == {"demo/Child", "demo/Base", "java/lang/Runnable", "java/lang/Object"}
    chain = scope.call_chain("demo.Main", "run", "(Ldemo/Base;)V").collect()
    assert {"demo/Main#helper()V", "demo/Child#run()V"} <= {r.node for r in chain} and all(r.archive_path.endswith("demo.jar") for r in chain if r.depth)
    callers = scope.call_chain("demo.Child", "value", "()I", "callers", depth=1).collect()
    assert {"demo/Child#run()V", "demo/Main#run(Ldemo/Base;)V"} <= {r.node for r in callers}
    assert {r.direction for r in scope.call_chain("demo.Child", "run", "()V", "both").collect()} == {"callers", "callees"}
    trace = scope.resolve_stacktrace("java.lang.IllegalStateException\n\tat demo.Child.run(Child.java:1)\n\tat no.Such.x(Native Method)\n\tat demo.Child.gone(Child.java:9)", max_frames=2).collect()
    assert [(r.kind, r.archives, r.methods, r.skipped) for r in trace] == [("header", None, None, False), ("frame", 1, 1, False), ("frame", 0, 0, False), ("frame", None, None, True)]
    assert trace[1].candidates[0].archive_path.endswith("demo.jar") and trace[1].candidates[0].methods == ["()V"]
    (folder / "trace.txt").write_text("x.BadError\r\n\tat demo.Main.helper(Main.java:4)\r\n")
    assert [r.methods for r in scope.resolve_stacktrace(file=str(folder / "trace.txt")).where("kind = 'frame'").collect()] == [1]
    assert scope.list_classes("demo.D").count() == 1
    assert {r.status for r in scope.compare(str(folder / "jars" / "demo.jar")).collect()} == {"unchanged"}


def test_searches_read_what_may_match(spark, world):
    from tessella.api import Scope
    from tessella.functions import text as fn

    folder, store, _ = world
    scope = Scope(spark, str(folder / "jars"), store.path, build=False)
    for query, mode in (("demo", "plain"), ("DEMO.main", "plain"), ("uses*chi", "wildcard"), (r"demo\.(Main|Child)", "regex"), (r"us+es demo\.Ch", "regex"), ("wor", "plain"), ("or", "plain"), ("nothing like it", "plain")):
        hit = fn.match("text", query, mode)
        want = sorted(map(str, scope.strings.where(hit).collect()))
        assert sorted(str(r) for r in scope.texts_holding("strings_by_text", query, mode).where(hit).select(*scope.strings.columns).collect()) == want
        line = fn.match("text_content", query, mode)
        want = {r.entry_path for r in scope.resources.where(line).collect()}
        found = scope.texts_holding("resources_by_text", query, mode)
        assert {r.entry_path for r in found.where(line).collect()} == want
    # One text holds it, and no other is read.
    assert scope.texts_holding("resources_by_text", "main=demo").count() == 1 < scope.resources.count() and scope.texts_holding("resources_by_text", "ma").count() == scope.resources.count()
    plan = scope.texts_holding("strings_by_text", "constant")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "strings_by_text" in x)
    assert "bucket" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0] and "text_id" in scan.split("PushedFilters:")[1]


def test_references_are_cut_in_order(spark, world):
    from tessella.api import Scope

    folder, store, _ = world
    scope = Scope(spark, str(folder / "jars"), store.path, build=False)
    every = scope.find_references("type", "demo.Child").collect()
    some = scope.find_references("type", "demo.Child", max_nodes=2).collect()
    assert len(every) > 3 and not any(r.truncated for r in every)
    assert [r.truncated for r in some] == [False, False, True] and [r[:-1] for r in some] == [r[:-1] for r in every[:3]]
    assert scope.find_references("field", "demo.Base", "n").count() == scope.find_references("field", "demo.Base", "n", "I").count() == 1
    assert [(r.descriptor, r.outcome) for r in scope.find_references("field", "demo.Base", "n", "J").collect()] == [("I", "descriptor_mismatch")]
    assert [r.outcome for r in scope.find_references("method", "demo.Base", "none").collect()] == ["method_not_found"]
    without, exact = (sorted((r.source_owner, r.source_name, r.ord) for r in scope.find_references("method", "demo.Child", "value", d).collect()) for d in (None, "()I"))
    assert without == exact == [("demo/Child", "run", 0), ("demo/Main", "run", 0)]


@pytest.fixture(scope="module")
def looped(spark, tmp_path_factory):
    """Methods that call each other, through an interface too, and one that two archives have."""
    folder = tmp_path_factory.mktemp("loops")
    build(folder, "loop", {
        "x/A.java": "package x; public class A implements Step { public void go() { B.go(); } public void step() { go(); } }",
        "x/B.java": "package x; public class B { static void go() { new A().go(); C.ask(new A()); } }",
        "x/C.java": "package x; public class C { static void ask(Step s) { s.step(); } static void ask(int n) { } }",
        "x/Step.java": "package x; public interface Step { void step(); }",
        "y/Twice.java": "package y; public class Twice implements x.Step { public void step() { } }",
    })
    build(folder, "more", {"y/Twice.java": "package y; public class Twice { public void step() { } }"})
    from tessella.api import Scope

    return folder, Scope(spark, str(folder / "jars"), str(folder / "index"))


def test_call_chains_with_cycles(spark, looped):
    _, scope = looped
    down = scope.call_chain("x.A", "go", direction="callee", depth=4).orderBy("seq").collect()
    assert [(r.node, r.depth) for r in down if "init" not in r.node] == [("x/A#go()V", 0), ("x/B#go()V", 1), ("x/C#ask(Lx/Step;)V", 2), ("x/A#step()V", 3), ("x/Step#step()V", 3), ("y/Twice#step()V", 3), ("y/Twice#step()V", 3)]
    assert len({(r.archive_path, r.node) for r in down}) == len(down) and {r.archive_path.rsplit("/", 1)[1] for r in down if "Twice" in r.node} == {"loop.jar", "more.jar"}
    assert all(r.archive_path for r in down) and not any(r.truncated for r in down)
    up = scope.call_chain("x.Step", "step", direction="callers").orderBy("seq").collect()
    assert [r.node for r in up] == ["x/Step#step()V", "x/C#ask(Lx/Step;)V", "x/B#go()V", "x/A#go()V"] and [r.parent for r in up[2:]] == ["x/C#ask(Lx/Step;)V", "x/B#go()V"]
    cut = scope.call_chain("x.A", "go", direction="callees", depth=9, max_nodes=2).collect()
    assert sorted((r.seq, r.truncated) for r in cut) == [(0, False), (1, True)]
    assert [(r.outcome, r.seq) for r in scope.call_chain("x.C", "ask").collect()] == [("overload_ambiguous", None)] * 2
    assert [r.outcome for r in scope.call_chain("x.C", "ask", "(J)V").collect()] == ["descriptor_mismatch"] * 2
    assert [r.outcome for r in scope.call_chain("y.Twice", "step", "()V").collect()] == ["source_ambiguous"] * 2
    assert [r.outcome for r in scope.method_overrides("x.C", "ask").collect()] == ["overload_ambiguous"] * 2


def test_many_chains_are_the_single_ones(spark, looped):
    _, scope = looped
    methods = [("x/A", "go", "()V"), ("x/Step", "step", "()V"), ("x/C", "ask", None)]
    wanted = spark.createDataFrame([(i, *r) for i, r in enumerate(methods)], "root int, owner string, name string, descriptor string")
    many = scope.call_chains(wanted, depth=2, max_nodes=4).collect()
    for i, r in enumerate(methods):
        one = {tuple(x) for x in scope.call_chain(*r, depth=2, max_nodes=4).collect()}
        assert {tuple(x)[1:] for x in many if x.root == i} == one, r


def test_a_level_reads_its_own_folders_alone(spark, looped):
    from tessella.operators import calls

    _, scope = looped
    every = scope.store.read("calls_by_source", scope.archives)
    frontier = spark.createDataFrame([("x/B",)], "owner string")
    some = calls.near(every, "source_owner", frontier, "owner")
    plan = some._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "calls_by_source" in x)
    assert "bucket" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0] and "EqualTo(source_owner,x/B)" in scan
    assert {r.source_owner for r in some.collect()} == {"x/B"} and some.count() == every.where("source_owner = 'x/B'").count() > 0
    same = lambda a, b: sorted(map(tuple, a.drop("bucket").collect())) == sorted(map(tuple, b.collect()))
    assert same(every, scope.calls) and same(scope.store.read("calls_by_target", scope.archives), scope.calls)


@pytest.mark.parametrize("split", [1 << 16, 2])
def test_class_hierarchy_calls_by_signature(spark, split):
    import random

    from tessella.sources.index import class_hierarchy_calls

    rng = random.Random(4)
    types = [f"T{i}" for i in range(12)]
    up = {(a, t, rng.choice(types[:i])) for a in "ab" for i, t in enumerate(types) if i for _ in range(2)}
    declared = {(rng.choice("ab"), rng.choice(types), rng.choice("fg"), "()V") for _ in range(30)}
    virtual = [(rng.choice("ab"), f"S{rng.randrange(4)}", "m", "()V", rng.choice(types), rng.choice("fg"), "()V") for _ in range(60)]
    below = set(up)
    while True:
        more = {(a, s, q) for a, s, p in below for b, t, q in up if a == b and t == p} | below
        if more == below:
            break
        below = more
    want = {(a, so, sn, sd, s, n, d) for a, so, sn, sd, t, n, d in virtual for b, s, p in below if a == b and p == t and (a, s, n, d) in declared}
    classes = spark.createDataFrame([(a, t, None) for a in "ab" for t in types], "archive_path string, internal_name string, super_name string")
    interfaces = spark.createDataFrame(sorted(up), "archive_path string, owner string, interface_name string")
    methods = spark.createDataFrame(sorted(declared), "archive_path string, owner string, name string, descriptor string")
    calls = spark.createDataFrame(virtual, "archive_path string, source_owner string, source_name string, source_desc string, target_owner string, target_name string, target_desc string")
    found = class_hierarchy_calls(calls, classes, interfaces, methods, split).collect()
    assert {tuple(r) for r in found} == want and len(found) == sum((a, so, sn, sd, t, n, d) in virtual and (b, s, p) in below and a == b and p == t and (a, s, n, d) in declared for a, so, sn, sd, t, n, d in virtual for b, s, p in below)


@pytest.fixture(scope="module")
def sourced(spark, tmp_path_factory):
    """Archives with their sources given, beside them, in a repository by coordinates and by checksum, or nowhere; and one inside another."""
    import hashlib

    folder = tmp_path_factory.mktemp("sourced")
    extra = {"note.txt": "read me"}
    for name in ("second-1.2", "third", "fourth", "second-1.10"):
        stem = name.split("-")[0]
        build(folder, name, {f"s/{stem.title()}.java": f"package s; public class {stem.title()} {{ }}"}, {**extra, **({"META-INF/maven/g/a/pom.properties": "groupId=g\nartifactId=third\nversion=3\n"} if stem == "third" else {})})
    build(folder, "first", {"s/First.java": "package s; public class First { Second other; }", "s/Second.java": "package s; public class Second { }"}, extra)
    with zipfile.ZipFile(folder / "jars" / "first.jar", "w") as z:  # without the class that it refers to
        z.write(folder / "first-out" / "s" / "First.class", "s/First.class")
        z.writestr("note.txt", "read me")
    jars, repo = folder / "jars", folder / "repo"
    repo.mkdir()
    zips = {jars / "first-sources.jar": {"s/First.java": "package s; public class First { }", "a/s/First.java": "far"}, repo / "third-3-sources.jar": {"src/s/Third.java": "third"}, repo / "fourth-4-sources.jar": {"s/Fourth.java": "fourth"}, folder / "given.jar": {"s/First.java": "given"}}
    for path, files in zips.items():
        with zipfile.ZipFile(path, "w") as z:
            for entry, text in files.items():
                z.writestr(entry, text)
    for name in ("third-3", "fourth-4"):
        shutil.copy(jars / f"{name.split('-')[0]}.jar", repo / f"{name}.jar")
    with zipfile.ZipFile(jars / "app.war", "w") as z:
        z.write(jars / "second-1.2.jar", "WEB-INF/lib/second-1.2.jar")
        z.write(jars / "second-1.10.jar", "WEB-INF/lib/second-1.10.jar")
        z.write(folder / "first-out" / "s" / "First.class", "WEB-INF/classes/s/First.class")
    from tessella.api import Scope

    return folder, Scope(spark, str(jars), str(folder / "index")), hashlib.sha1((jars / "fourth.jar").read_bytes()).hexdigest()


def test_sources_are_looked_up_in_turn(spark, sourced):
    folder, scope, checksum = sourced
    found = lambda name, **k: {r.id.rsplit("/", 1)[1]: (r.strategy, r.source) for r in scope.source_lookup(name, **k).collect()}
    assert found("s.First") == {"first.jar": ("sibling", "package s; public class First { }")}
    assert {v for v in found("s.First", given=str(folder / "given.jar")).values()} == {("given", "given")}
    assert found("s.Third") == {} and found("s.Third", repository=str(folder / "repo")) == {"third.jar": ("coordinates", "third")}
    assert set(found("s.Third", repository=str(folder / "repo"), coordinates=("g", "third", "3")).values()) == {("coordinates", "third")}
    assert found("s.Fourth", repository=str(folder / "repo")) == {"fourth.jar": ("checksum", "fourth")}
    (folder / "sums.txt").write_text(f"{checksum.upper()}  libs/second-1.2.jar\n")
    assert found("s.Fourth", repository=str(folder / "repo"), checksums=str(folder / "sums.txt")) == {"fourth.jar": ("checksum", "fourth"), "second-1.2.jar": ("checksum", "fourth")}


def test_types_are_found_in_the_first_container(spark, sourced):
    _, scope, _ = sourced
    last = lambda p: None if p is None else p.rsplit("/jars/", 1)[1]
    found = {(last(r.archive_path), r.target_type): (last(r.container), r.level) for r in scope.resolve_types().collect()}
    assert found["first.jar", "s/Second"] == ("second-1.10.jar", "folder") and found["app.war", "s/Second"] == ("app.war!/WEB-INF/lib/second-1.10.jar", "nested")
    assert found["first.jar", "s/First"] == ("first.jar", "own") if ("first.jar", "s/First") in found else True
    assert found["first.jar", "java/lang/Object"] == (None, None)
    named = scope.archives.where("archive_path like '%second-1.2.jar'").select("archive_path")
    again = {(last(r.archive_path), r.target_type): (last(r.container), r.level) for r in scope.resolve_types(named).collect()}
    assert again["app.war", "s/Second"] == ("second-1.2.jar", "named") and len(again) == len(found)


def test_a_file_for_each_source(spark, sourced, tmp_path):
    folder, scope, _ = sourced
    status = {r.path: r for r in scope.save_sources(str(tmp_path / "out"), metadata=True).collect()}
    assert (tmp_path / "out" / "first.jar" / "s" / "First.java").read_text() == "package s; public class First { }" and (tmp_path / "out" / "first.jar" / "note.txt").read_text() == "read me"
    assert '"entry":"s/First.java"' in (tmp_path / "out" / "first.jar" / "s" / "First.java.meta.json").read_text()
    assert all(r.error is None and r.size is not None for r in status.values()) and sum(p.endswith(".java") for p in status) == 2
    written = scope.save_skeleton(str(tmp_path / "build")).collect()
    assert sorted(r.path for r in written) == ["build.gradle", "mvn_deploy.bat", "pom.xml"] and all(r.error is None for r in written)
    pom = (tmp_path / "build" / "pom.xml").read_text()
    assert "      <groupId>g</groupId>\n      <artifactId>third</artifactId>\n      <version>3</version>\n" in pom and pom.endswith("  </dependencies>\n</project>\n")
    assert "    implementation 'local.inferred:second:1.10'\n" in (tmp_path / "build" / "build.gradle").read_text()
    assert f"-Dfile={folder}/jars/app.war -DgroupId=local.inferred -DartifactId=app -Dversion=0.0.0-local -Dpackaging=war\n" in (tmp_path / "build" / "mvn_deploy.bat").read_text()


def test_what_cannot_be_written_is_told(spark, tmp_path):
    from pyarrow import fs

    from tessella.sources import sink

    rows = [("a/b.txt", b"one"), ("a//b.txt", b"two"), ("../up.txt", b"x"), ("/abs.txt", b"x"), (None, b"x"), ("none.txt", None), ("empty.txt", b""), ("a", b"a folder by then, or not"), ("_status/x", b"x")]
    found = sink.write_files(spark.createDataFrame(rows, "path string, content binary").repartition(3), str(tmp_path / "out"))
    errors = {r.path: r.error for r in found.collect()}
    assert errors["empty.txt"] is None and (tmp_path / "out" / "empty.txt").read_bytes() == b""
    assert all(errors[p] for p in ("../up.txt", "/abs.txt", None, "none.txt", "_status/x")) and (errors["a/b.txt"] is None) != (errors["a//b.txt"] is None) or errors["a"] is None
    assert not (tmp_path / "out" / "_attempts").exists() and not (tmp_path / "up.txt").exists()

    class Killed(fs.LocalFileSystem):
        def move(self, a, b):
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        sink.place(Killed(), str(tmp_path / "cut"), "attempt", "x/y.txt", b"half")
    assert not (tmp_path / "cut" / "x" / "y.txt").exists() and (tmp_path / "cut" / "_attempts" / "attempt").exists()
    for _ in range(2):  # a task that is run again
        sink.place(fs.LocalFileSystem(), str(tmp_path / "cut"), "again", "x/y.txt", b"whole")
    assert (tmp_path / "cut" / "x" / "y.txt").read_bytes() == b"whole"


def test_methods_of_two_versions_are_matched(spark, tmp_path):
    from tessella.api import Scope

    for name, package in (("old", "p"), ("new", "q")):
        build(tmp_path / name, name, {f"{package}/T.java": f"package {package}; public class T {{}}", "m/A.java": f"package m; public class A {{ void f({package}.T t) {{}} void g(int n) {{}} {'void h() {}' if name == 'new' else ''} }}"}) if (tmp_path / name).mkdir() is None else None
    old, new = (Scope(spark, str(tmp_path / n / "jars"), str(tmp_path / f"{n}-index")) for n in ("old", "new"))
    found = {(r.left, r.right, r.how) for r in old.match_methods(new).collect()}
    assert found == {("Lm/A;f(Lp/T;)V", "Lm/A;f(Lq/T;)V", "relaxed"), ("Lm/A;g(I)V", "Lm/A;g(I)V", "exact"), ("Lm/A;<init>()V", "Lm/A;<init>()V", "exact"), ("Lp/T;<init>()V", "Lq/T;<init>()V", "relaxed"), (None, "Lm/A;h()V", None)}


def test_lines_of_a_class_in_two_archives(spark, sourced, tmp_path):
    folder, scope, _ = sourced
    with zipfile.ZipFile(tmp_path / "first-sources.jar", "w") as z:
        z.writestr("s/First.java", "package s; public class First { }\n// more")
    assert [(r.line, r.left, r.right) for r in scope.compare_lines(str(tmp_path), "s.First").collect()] == [(2, "", "// more")]


def test_archives_in_numbers(annotated):
    folder, scope = annotated
    found = {r.archive_path.rsplit("/", 1)[1]: (r.kind, r.class_count, r.size) for r in scope.analyze().collect()}
    assert found == {f"{n}.jar": ("archive", 2, (folder / "jars" / f"{n}.jar").stat().st_size) for n in ("left", "right")}
    assert scope.analyze("le*").count() == 1


def test_gutters_by_mode():
    from tessella.operators import policy

    with pytest.raises(ValueError):
        policy.gutter(None, "odd")
    assert policy.gutter("as it is", None) == policy.gutter("as it is", "none") == "as it is"


def test_whole_results_as_text(spark, world, tmp_path):
    from tessella.api import Scope

    folder, store, _ = world
    scope = Scope(spark, str(folder / "jars"), store.path, build=False)
    shown = scope.search_to(str(tmp_path / "hits"), "demo", limit=1)
    assert len(spark.read.text(str(tmp_path / "hits")).collect()) == scope.search("demo", limit=None).count() >= shown.count() > 1
    scope.dependencies_to(str(tmp_path / "deps"))
    assert [r.value for r in spark.read.text(str(tmp_path / "deps")).collect()] == ["g:a:1.2"]
    with pytest.raises(ValueError):
        scope.dependencies_to(f"{tmp_path}/../deps")


@pytest.fixture(scope="module")
def annotated(spark, tmp_path_factory):
    """Overloads, annotations, a module, the same class in two archives, and a class file that can't be read."""
    folder = tmp_path_factory.mktemp("two")
    worker = """package demo; @Deprecated public class Worker { int n; public void run() {} @Deprecated public int run(String s) { return s == null ? 1 : 2; }
        static Object type() throws Throwable { return String.class; } static int pick(int x) { switch (x) { case 1: return 5; case 2: return 6; default: return 7; } }
        void guarded() { try { run(); } catch (IllegalStateException e) { n = 1; } finally { n = 2; } } }"""
    build(folder, "left", {"module-info.java": "module demo.left { }", "demo/Worker.java": worker}, {"demo/Broken.class": b"\xca\xfe\xba\xbe\0\0\0\x34\0\x05\x63"})
    build(folder, "right", {"demo/Worker.java": "package demo; public class Worker { public void run() {} }", "demo/Other.java": "package demo; class Other extends Worker {}"})
    from tessella.api import Scope

    both = Scope(spark, str(folder / "jars"), str(folder / "index"))
    return folder, both


def test_symbols_resolve_or_say_why(annotated):
    _, scope = annotated
    outcomes = lambda *a, **k: sorted((r.kind, r.descriptor or "", r.outcome) for r in scope.resolve_symbol("demo.Worker", *a, **k).collect() if r.kind != "type")
    assert outcomes(method="run", descriptor="(Ljava/lang/String;)I") == [("method", "(Ljava/lang/String;)I", "resolved")]
    assert [o[2] for o in outcomes(method="run")] == ["overload_ambiguous"] * 3
    assert [o[2] for o in outcomes(method="run", descriptor="()V")] == ["source_ambiguous"] * 2
    assert [o[1:] for o in outcomes(method="run", descriptor="(J)V")] == [("()V", "descriptor_mismatch"), ("()V", "descriptor_mismatch"), ("(Ljava/lang/String;)I", "descriptor_mismatch")]
    assert outcomes(method="none") == [("method", "", "method_not_found")] and outcomes(method="none", descriptor="()V") == [("method", "", "descriptor_mismatch")]
    assert outcomes(field="n") == [("field", "I", "resolved")] and outcomes(field="x") == [("field", "", "field_not_found")] and outcomes(field="n", descriptor="J") == [("field", "I", "descriptor_mismatch")]
    assert [(r.kind, r.outcome) for r in scope.resolve_symbol("no.Such").collect()] == [("type", "class_not_found")]
    assert len(scope.resolve_symbol("demo.Worker").collect()) == 2


def test_class_metadata_and_modules(annotated):
    _, scope = annotated
    left = next(r for r in scope.class_metadata("demo.Worker").collect() if "left" in r.archive_path)
    assert left.super_name == "java/lang/Object" and left.annotations == ["Ljava/lang/Deprecated;"] and "public" in left.access_flags
    assert [(m.signature, m.annotations) for m in left.methods if m.name == "run"] == [("run(): void", []), ("run(java.lang.String): int", ["Ljava/lang/Deprecated;"])]
    assert [(f.name, f.type) for f in left.fields] == [("n", "int")]
    assert [r.module_name for r in scope.modules.collect()] == ["demo.left"]
    assert [(r.kind, r.owner) for r in scope.search("demo.left", kind="module").collect()] == [("module", "demo.left")]
    assert ("demo/Worker", "type", "java/lang/String") in {(r.source_owner, r.source_member_name, r.target_type) for r in scope.type_refs.where("kind = 'type-constant'").collect()}


def test_a_class_that_fails_is_told(annotated):
    _, scope = annotated
    assert [("left.jar" in r.archive_path, r.message.startswith("demo/Broken.class")) for r in scope.failures.collect()] == [(True, True)]
    assert scope.store.read("failures", scope.archives).count() == 1 and scope.classes.where("internal_name = 'demo/Worker'").count() == 2


def test_control_flow_of_real_code(annotated):
    _, scope = annotated
    chart = scope.show_cfg("demo.Worker", "pick").collect()
    assert len(chart) == 1 and chart[0].method == "demo/Worker#pick(I)I"
    assert chart[0].diagram.split("\n") == [
        "graph TD", '  B0["0: ILOAD\\n1: LOOKUPSWITCH"]', '  B1["2: ICONST_5\\n3: IRETURN"]', '  B2["4: BIPUSH\\n5: IRETURN"]', '  B3["6: BIPUSH\\n7: IRETURN"]',
        "  B0 -->|default| B3", "  B0 -->|case| B1", "  B0 -->|case| B2",
    ]
    guarded = scope.show_cfg("demo.Worker", "guarded", format="both").first().diagram
    kinds = [x.split("|")[1] for x in guarded.split("@startuml")[0].split("\n") if "-->" in x]
    # Edges of exceptions come after all others, in the order of their handlers.
    assert kinds.index("exception") < kinds.index("finally") and all(k in ("exception", "finally") for k in kinds[kinds.index("exception") :]) and "jump" in kinds
    assert 'B0["0: ALOAD\\n1: INVOKEVIRTUAL\\n2: ALOAD"]' in guarded
    assert "|exception|" in guarded and "|finally|" in guarded and "@startuml" in guarded and guarded.endswith("@enduml") and " : finally" in guarded
    code = scope.show_bytecode("demo.Worker").where("method = 'guarded()V'").collect()
    assert [r.idx for r in code[:3]] == [0, 1, 2] or len(code) > 5
    assert any((r.operand or "").startswith("demo/Worker#run") and r.instruction == "INVOKEVIRTUAL" for r in code)


def test_opcode_names():
    from tessella.operators.cfg import NAMES
    from tessella.sources.classfile import instructions

    assert sorted(NAMES) == list(range(202))
    some = {0: "NOP", 8: "ICONST_5", 20: "LDC", 25: "ALOAD", 26: "ILOAD", 45: "ALOAD", 46: "IALOAD", 53: "SALOAD", 58: "ASTORE", 78: "ASTORE", 83: "AASTORE", 86: "SASTORE", 95: "SWAP", 99: "DADD", 119: "DNEG", 131: "LXOR", 132: "IINC", 133: "I2L", 144: "D2F", 147: "I2S", 152: "DCMPG", 153: "IFEQ", 166: "IF_ACMPNE", 171: "LOOKUPSWITCH", 177: "RETURN", 178: "GETSTATIC", 181: "PUTFIELD", 186: "INVOKEDYNAMIC", 191: "ATHROW", 197: "MULTIANEWARRAY", 199: "IFNONNULL", 200: "GOTO"}
    assert {k: NAMES[k] for k in some} == some
    assert [(at, op) for at, op, *_ in instructions(bytes([196, 132, 1, 0, 0, 1, 196, 21, 1, 0, 172]))] == [(0, 132), (6, 21), (10, 172)]


def test_scopes_share_an_index_but_not_archives(spark, annotated):
    from tessella.api import Scope

    folder, both = annotated
    one = Scope(spark, str(folder / "jars" / "right.jar"), both.store.path)
    assert both.classes.count() == 4 and {r.internal_name for r in one.classes.collect()} == {"demo/Worker", "demo/Other"}
    assert one.failures.count() == 0


def test_a_crash_before_the_manifest_leaves_no_rows_twice(spark, tmp_path, monkeypatch):
    build(tmp_path, "x", {"x/A.java": "package x; class A { void f() {} }"})
    store = IndexStore(spark, str(tmp_path / "index"))
    named = IndexStore._name
    monkeypatch.setattr(IndexStore, "_name", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.refresh(str(tmp_path / "jars"))
    assert store.manifest().count() == 0 and store.read("classes").count() == 0
    monkeypatch.setattr(IndexStore, "_name", named)
    store.refresh(str(tmp_path / "jars"))
    assert store.read("classes").count() == 1 and store.read("methods").where("name = 'f'").count() == 1
    assert store.vacuum() and store.read("classes").count() == 1
    (tmp_path / "jars" / "x.jar").unlink()
    build(tmp_path, "y", {"y/B.java": "package y; class B {}"})
    store.refresh(str(tmp_path / "jars"))
    assert [r.internal_name for r in store.read("classes").collect()] == ["y/B"]


def test_inputs_by_kind(spark, world, tmp_path):
    folder, _, _ = world
    one = folder / "demo-out" / "demo" / "Base.class"
    assert archives.class_file_root(spark, str(one)).endswith("demo-out")
    assert archives.open_input(spark, str(one)).count() == archives.open_input(spark, str(folder / "demo-out")).count() == 4
    assert archives.open_input(spark, str(folder / "jars" / "demo.jar")).where("entry like '%.class'").count() == 4
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        archives.open_input(spark, str(tmp_path / "a.txt"))
    with pytest.raises(FileNotFoundError):
        archives.open_input(spark, str(tmp_path / "none.jar"))
    inner = folder / "jars" / "demo.jar"
    for name, entry in (("app.ear", "mods/inner.jar"), ("lib.aar", "classes.jar")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.write(inner, entry)
        from tessella.sources.index import visible_classes

        found = visible_classes(archives.open_input(spark, str(tmp_path / name)), 21).collect()
        assert {(r.archive_path.endswith(name), r.entry) for r in found} == {(True, f"{entry}!/demo/{c}.class") for c in ("Base", "Child", "Dependency", "Main")}


def test_folders_are_scopes_too(spark, world, tmp_path):
    from tessella.api import Scope

    folder, _, _ = world
    shutil.copytree(folder / "demo-out", tmp_path / "in" / "classes")
    shutil.copy(folder / "jars" / "demo.jar", tmp_path / "in")
    scope = Scope(spark, str(tmp_path / "in"), str(tmp_path / "index"))
    assert sorted(r.kind for r in scope.archives.collect()) == ["archive", "folder"]
    assert scope.classes.where("internal_name = 'demo/Base'").count() == 2
    before = {r.archive_path: r.fingerprint for r in archives.fingerprints(spark, str(tmp_path / "in")).collect()}
    (tmp_path / "in" / "classes" / "demo" / "Base.class").write_bytes((folder / "demo-out" / "demo" / "Child.class").read_bytes())
    after = {r.archive_path: r.fingerprint for r in archives.fingerprints(spark, str(tmp_path / "in")).collect()}
    assert {p.endswith("demo.jar") for p in before if before[p] == after[p]} == {True} and len(before) == 2
    skeleton = scope.build_skeleton().collect()
    assert [tuple(r)[1:] for r in skeleton] == [("g", "a", "1.2", "jar")]


def test_sources_and_names(spark):
    from tessella.functions import text as fn

    entries = spark.createDataFrame([("s.jar", "src/demo/A.java", 0, b"one"), ("s.jar", "x/demo/A.java", 1, b"two"), ("t.jar", "demo/A.java", 3, b"own"), ("t.jar", "a/demo/A.java", 0, b"far"), ("u.jar", "xdemo/A.java", 0, b"no")], "archive_path string, entry string, ord int, content binary")
    assert {r.archive_path: r.source for r in archives.source_of(entries, "demo.A").collect()} == {"s.jar": "one", "t.jar": "own"}
    names = spark.createDataFrame([("FF",), ("jd",), (None,), (" ",), ("other",)], "e string").select(fn.engine_name(F.col("e")).alias("n"))
    assert [r.n for r in names.collect()] == ["fernflower", "jd-core-v1", "auto", "auto", None]
    with pytest.raises(ValueError):
        fn.checked_path(" a/../b")
    assert fn.checked_path(" a/b ") == "a/b"


def test_descriptors():
    from tessella.functions.descriptors import readable

    assert readable("(I[[Ljava/lang/String;J)V") == "(int, java.lang.String[][], long): void"
    assert readable("(I[[Ljava/lang/String;J)V", short=True) == "(int, String[][], long): void"
    assert readable("[Z") == "boolean[]" and readable("(Q") == "(Q"


def test_property_files_as_java_reads_them(spark, tmp_path):
    from tessella.functions import text as fn

    rng = random.Random(9)
    parts = ["a", "b", "key", "=", ":", " ", "\t", "\f", "\\", "\\\\", "\n", "\r", "\r\n", "\\\n", "\\\r\n  ", "#", "!", "\\u0041", "\\ud83d\\ude00", "\\ud83d", "\\t", "\\n", "\\=", "\\:", "\\ ", "\\q", "\xe9"]
    texts = ["", "\\", "\\\n", "\\\n\\\n", "a", "=x", "a=b\\\n\nc", "#c\\\na=b", "a=1\na=2", "a=\\u00", "a\\=b=c\\\\", "a = b \n  !x\n\tb:c", "a=b\\\n   # no comment\n"] + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(1500)]
    (tmp_path / "Load.java").write_text("""
        import java.util.*; import java.io.*;
        public class Load { public static void main(String[] a) throws Exception {
            BufferedReader in = new BufferedReader(new InputStreamReader(System.in)); String line;
            while ((line = in.readLine()) != null) {
                Properties p = new Properties(); StringBuilder out = new StringBuilder("=");
                try { p.load(new ByteArrayInputStream(Base64.getDecoder().decode(line))); } catch (IllegalArgumentException e) { System.out.println("!"); continue; }
                for (String k : p.stringPropertyNames()) for (String s : new String[] {k, p.getProperty(k)}) out.append(Base64.getEncoder().encodeToString(s.getBytes("UTF-8"))).append(",");
                System.out.println(out);
            } } }""")
    subprocess.run(["javac", "-d", str(tmp_path), str(tmp_path / "Load.java")], check=True)
    lines = "\n".join(base64.b64encode(t.encode("latin-1")).decode() for t in texts) + "\n"
    read = subprocess.run(["java", "-cp", str(tmp_path), "Load"], input=lines, capture_output=True, text=True, check=True).stdout.splitlines()
    decoded = [[base64.b64decode(x).decode() for x in r[1:].split(",")[:-1]] for r in read]
    # Java writes half a surrogate pair as a question mark.
    half = lambda x: x.replace("\ufffd", "?")
    df = spark.createDataFrame(list(enumerate(bytearray(t.encode("latin-1")) for t in texts)), "n int, c binary").repartition(4)
    found = {r.n: r.p for r in df.select("n", fn.properties(F.decode("c", "ISO-8859-1")).alias("p")).collect()}
    differ = []
    for n, t in enumerate(texts):
        want = None if read[n] == "!" else dict(zip(decoded[n][::2], decoded[n][1::2]))
        got = None if found[n] is None else {half(p.key): half(p.value) for p in found[n]}
        differ += [] if got == want else [(t, got, want)]
    assert not differ
    long = spark.createDataFrame([("a=" + "\\:" * 300_000 + "\\\n" * 1000 + "end\n" + "b" * 500_000,)], "t string").select(fn.properties(F.col("t")).alias("p")).first().p
    assert len(long) == 2 and long[0].value == ":" * 300_000 + "end" and long[1].key == "b" * 500_000


def test_bytes_of_other_encodings_end_no_job(spark, tmp_path):
    from tessella.api import Scope

    odd = "caf\xe9 needle".encode("latin-1")
    build(tmp_path, "odd", {"o/Odd.java": "package o; public class Odd { }"}, {"conf/odd.txt": odd, "META-INF/maven/g/a/pom.properties": "# caf\xe9\ngroupId = g\\u0031\nartifactId:a\\\n  b\nversion 1.2\n".encode("latin-1")})
    with zipfile.ZipFile(tmp_path / "jars" / "odd-sources.jar", "w") as z:
        z.writestr("o/Odd.java", b"// caf\xe9\nclass Odd { }")
    scope = Scope(spark, str(tmp_path / "jars"), str(tmp_path / "index"))
    assert scope.failures.count() == 0
    assert [r.text for r in scope.search("needle", kind="resource").collect()] == ["caf\ufffd needle"]
    assert [r.source for r in scope.source_lookup("o.Odd").collect()] == ["// caf\ufffd\nclass Odd { }"]
    assert [tuple(r)[1:] for r in scope.list_dependencies().collect()] == [("g1", "ab", "1.2")]
