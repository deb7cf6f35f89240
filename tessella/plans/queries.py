"""Queries of the operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import calls, cfg, diff, graph, logs, lookup, paging, policy, postings, symbols
from . import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents")


# --- search: predicates, paging, totals -------------------------------------------------------------


@query("""WITH m AS (SELECT doc_id, source, lang, text FROM documents WHERE text ILIKE '%license%')
SELECT doc_id, source, lang, (SELECT count(*) FROM m) AS total FROM m ORDER BY source, doc_id LIMIT 50 OFFSET 5""")
def search_plain(spark, sf_dir):
    """F7 plain, L1, L2, A6: texts with a phrase, in any case; a page of 50 and the number of all."""
    hits = docs(spark, sf_dir).where(fn.match("text", "license")).select("doc_id", "source", "lang")
    return paging.with_total(paging.page(hits, ["source", "doc_id"], 5, 50), hits)


@query("""SELECT p.pattern, doc_id FROM documents, (VALUES ('lIcEnSe'), ('li*nse'), ('vers.on ?[0-9]+')) p(pattern) WHERE CASE pattern WHEN 'lIcEnSe' THEN text ILIKE '%license%' WHEN 'li*nse' THEN regexp_matches(text, '(?i)li.*nse') ELSE regexp_matches(text, '(?i)vers.on ?[0-9]+') END""")
def search_trigrams(spark, sf_dir):
    """Texts by patterns of each mode, read only where the trigrams that a pattern holds literally have been posted."""
    texts = docs(spark, sf_dir).select("doc_id", "text")
    posted = graph.checkpointed(postings.postings(texts, "doc_id", "text"))
    found = None
    for query_, mode in (("lIcEnSe", "plain"), ("li*nse", "wildcard"), ("vers.on ?[0-9]+", "regex")):
        ids = postings.holding(posted, postings.literal_grams(query_, mode), "doc_id")
        hits = texts.join(ids, "doc_id", "left_semi").where(fn.match("text", query_, mode)).select(F.lit(query_).alias("pattern"), "doc_id")
        found = hits if found is None else found.unionByName(hits)
    return found


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 200 OFFSET (SELECT CAST(count(*) * 3 // 5 AS BIGINT) FROM lineitem)""")
def deep_page(spark, sf_dir):
    """L2, L3: a page that begins three fifths down an order, of which its own ranges are sorted alone."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    line = b.table(spark, sf_dir, "lineitem").select(*order)
    return paging.deep_page(line, order, line.count() * 3 // 5, 200)


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(text, '(?i)vers.on ?\\d')")
def search_regex(spark, sf_dir):
    """F7 regex."""
    return docs(spark, sf_dir).where(fn.match("text", r"vers.on ?\d", "regex")).select("doc_id", "source")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE regexp_matches(p_name, '(?i)a.*e.') OR regexp_matches(p_type, '(?i)a.*e.')")
def search_wildcard(spark, sf_dir):
    """F7 wildcard over either of two columns (F8)."""
    return b.table(spark, sf_dir, "part").where(fn.match("p_name", "a*e?", "wildcard") | fn.match("p_type", "a*e?", "wildcard")).select("p_partkey", "p_name", "p_type")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
SELECT doc_id, min(n) AS line, trim(arg_min(line, n)) AS snippet FROM l WHERE line ILIKE '%license%' GROUP BY doc_id""")
def first_line(spark, sf_dir):
    """TX7: the first matching line and its text."""
    found = docs(spark, sf_dir).where(fn.match("text", "license")).select("doc_id", fn.first_matching_line(F.col("text"), lambda x: fn.match(x, "license")).alias("hit"))
    return found.where("hit is not null").select("doc_id", "hit.line", "hit.snippet")


@query("SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents WHERE text IS NOT NULL GROUP BY text")
def distinct_text(spark, sf_dir):
    """Of equal texts the first occurrence."""
    return paging.first_of_each(docs(spark, sf_dir).where("text is not null").select("text", "doc_id", "source"), ["text"], ["doc_id"]).select("text", "doc_id", "source")


@query("""WITH u AS (
  SELECT 0 AS kind_ord, 'module' AS kind, r_name AS name, '' AS owner FROM region WHERE r_name ILIKE '%a%'
  UNION ALL SELECT 1, 'type', n_name, CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_name ILIKE '%a%'
  UNION ALL SELECT 2, 'field', p_name, CAST(p_partkey AS VARCHAR) FROM part WHERE p_name ILIKE '%a%'
  UNION ALL SELECT 4, 'string', s_name, CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_name ILIKE '%1%')
SELECT kind, name, owner FROM u ORDER BY kind_ord, name, owner LIMIT 40 OFFSET 10""")
def search_all_kinds(spark, sf_dir):
    """Hits of several kinds in the fixed order of kinds, paged as one."""
    t = lambda name: b.table(spark, sf_dir, name)
    hits = (
        t("region").where(fn.match("r_name", "a")).select(F.lit(0).alias("kind_ord"), F.lit("module").alias("kind"), F.col("r_name").alias("name"), F.lit("").alias("owner"))
        .union(t("nation").where(fn.match("n_name", "a")).select(F.lit(1), F.lit("type"), "n_name", F.col("n_regionkey").cast("string")))
        .union(t("part").where(fn.match("p_name", "a")).select(F.lit(2), F.lit("field"), "p_name", F.col("p_partkey").cast("string")))
        .union(t("supplier").where(fn.match("s_name", "1")).select(F.lit(4), F.lit("string"), "s_name", F.col("s_suppkey").cast("string")))
    )
    return paging.page(hits, ["kind_ord", "name", "owner"], 10, 40).select("kind", "name", "owner")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority LIKE '1%'")
def scope_filter(spark, sf_dir):
    """a scope of few values, an optional predicate left out, one given."""
    return b.table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P") & F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT page_id, url FROM pages WHERE url ILIKE '%/EN/%'")
def path_like(spark, sf_dir):
    """a path pattern whatever the case."""
    return b.table(spark, sf_dir, "pages").where(F.col("url").ilike("%/EN/%")).select("page_id", "url")


@query("""WITH d AS (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS name FROM pages ORDER BY 2, 1 LIMIT 150 OFFSET 20)
SELECT CASE WHEN instr(name, '.') > 0 THEN regexp_replace(name, '\\.[^.]*$', '') ELSE '(default)' END AS package, count(*) AS n FROM d GROUP BY 1""")
def package_counts(spark, sf_dir):
    """Classes by package, of the page alone."""
    named = b.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]*)", 1).alias("name"))
    return paging.page(named, ["name", "page_id"], 20, 150, zero_is_all=True).groupBy(fn.package_of(F.col("name")).alias("package")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, (trim(text) <> '' AND NOT (lower(text) LIKE '%failed to decompile%' OR lower(text) LIKE '%unable to decompile%')) AS usable FROM documents WHERE text IS NOT NULL""")
def usable_output(spark, sf_dir):
    """output that is not blank and has no sign of failure."""
    return docs(spark, sf_dir).where("text is not null").select("doc_id", fn.usable(F.col("text")).alias("usable"))


@query("SELECT DISTINCT c_mktsegment AS module FROM customer WHERE c_mktsegment IS NOT NULL")
def modules(spark, sf_dir):
    """A7."""
    return b.table(spark, sf_dir, "customer").where("c_mktsegment is not null").select(F.col("c_mktsegment").alias("module")).distinct()


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def head_by_archive(spark, sf_dir):
    """The first few of each archive."""
    return paging.head_of_each(docs(spark, sf_dir).select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 3).select("source", "doc_id")


# --- symbols and joins -------------------------------------------------------------------------------


@query(b.with_relations("SELECT m.archive_path, m.owner, m.name, m.descriptor FROM methods m JOIN classes c ON c.archive_path = m.archive_path AND c.internal_name = m.owner WHERE m.name = '1-URGENT' AND m.descriptor = 'P'"))
def method_candidates(spark, sf_dir):
    """J1, J2 (fields are the same join)."""
    return symbols.candidates(b.methods(spark, sf_dir), b.classes(spark, sf_dir), "1-URGENT", descriptor="P")


@query(b.with_relations("""SELECT DISTINCT c.archive_path, c.internal_name FROM classes c LEFT JOIN interfaces i ON i.archive_path = c.archive_path AND i.owner = c.internal_name
WHERE c.super_name = 'M/BUILDING' OR i.interface_name = 'M/BUILDING'"""))
def direct_subtypes(spark, sf_dir):
    """J3."""
    return symbols.direct_subtypes(b.classes(spark, sf_dir), b.interfaces(spark, sf_dir), "M/BUILDING")


@query(b.with_relations("""SELECT archive_path, owner, name, descriptor FROM methods WHERE name = '2-HIGH' AND descriptor = 'O' AND owner IN (
SELECT c.internal_name FROM classes c LEFT JOIN interfaces i ON i.archive_path = c.archive_path AND i.owner = c.internal_name WHERE c.super_name = 'N/3' OR i.interface_name = 'N/3')"""))
def virtual_targets(spark, sf_dir):
    """J4."""
    return symbols.virtual_targets(b.methods(spark, sf_dir), b.classes(spark, sf_dir), b.interfaces(spark, sf_dir), "N/3", "2-HIGH", "O")


@query(b.with_relations("""SELECT c.archive_path, c.internal_name, c.super_name, coalesce(string_agg(i.interface_name, ',' ORDER BY i.interface_name), '') AS interfaces
FROM classes c LEFT JOIN interfaces i ON i.archive_path = c.archive_path AND i.owner = c.internal_name GROUP BY ALL"""))
def class_headers(spark, sf_dir):
    """Class headers with their interfaces by name."""
    return symbols.with_members(b.classes(spark, sf_dir), b.interfaces(spark, sf_dir))


@query(b.with_relations("""SELECT archive_path, source_owner, source_name, source_desc, min(ord) AS ord FROM (
SELECT *, 0 AS ord FROM calls WHERE target_owner = 'P/7'
UNION ALL SELECT *, 1 FROM calls WHERE target_owner IN (SELECT target_owner FROM calls WHERE source_owner = 'P/7')) WHERE target_name = 'run' AND target_desc = '()V' GROUP BY ALL"""))
def callers_with_parents(spark, sf_dir):
    """Exact callers, then those of the parents' method (here, a part's callees stand for parents)."""
    c = b.calls(spark, sf_dir)
    parents = c.where("source_owner = 'P/7'").select(F.col("target_owner").alias("parent")).distinct()
    return symbols.callers(c, "P/7", "run", "()V", parents)


@query(b.with_relations("""SELECT DISTINCT source_owner, source_name, source_desc, owner AS target_owner, name AS target_name, descriptor AS target_desc, via FROM (
SELECT source_owner, source_name, source_desc, target_owner AS owner, target_name AS name, target_desc AS descriptor, 'call' AS via FROM k
UNION ALL SELECT source_owner, source_name, source_desc, m.owner, m.name, m.descriptor, 'virtual' FROM k
JOIN (SELECT super_name AS parent, internal_name AS child FROM classes WHERE super_name IS NOT NULL UNION SELECT interface_name, owner FROM interfaces) s ON s.parent = k.target_owner
JOIN methods m ON m.owner = s.child AND m.name = k.target_name AND m.descriptor = k.target_desc)""").replace("WITH ", "WITH k AS (SELECT 'S/' || s_suppkey AS source_owner, 'run' AS source_name, '()V' AS source_desc, 'N/' || s_nationkey AS target_owner, '1-URGENT' AS target_name, 'P' AS target_desc FROM supplier),", 1))
def callees_expanded(spark, sf_dir):
    """Calls and the declarations in direct subtypes that they may reach."""
    k = b.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S/"), F.col("s_suppkey")).alias("source_owner"), F.lit("run").alias("source_name"), F.lit("()V").alias("source_desc"), F.concat(F.lit("N/"), F.col("s_nationkey")).alias("target_owner"), F.lit("1-URGENT").alias("target_name"), F.lit("P").alias("target_desc"))
    return symbols.callees(k, b.methods(spark, sf_dir), b.classes(spark, sf_dir), b.interfaces(spark, sf_dir))


@query(b.with_relations("""SELECT w.wanted, count(m.descriptor) AS candidates, count(DISTINCT m.archive_path) AS archives,
CASE WHEN count(m.descriptor) = 0 THEN 'method_not_found' WHEN count(m.descriptor) = 1 THEN 'resolved'
     WHEN count(DISTINCT m.archive_path) > 1 AND count(DISTINCT m.descriptor) = 1 THEN 'source_ambiguous' ELSE 'overload_ambiguous' END AS outcome
FROM (SELECT 'C/' || c_custkey AS wanted FROM customer) w LEFT JOIN methods m ON m.owner = w.wanted AND m.name = '1-URGENT' GROUP BY w.wanted"""))
def symbol_resolution(spark, sf_dir):
    """Whether a method name resolves, and if not, why."""
    wanted = b.table(spark, sf_dir, "customer").select(F.concat(F.lit("C/"), F.col("c_custkey")).alias("wanted"))
    m = b.methods(spark, sf_dir).where("name = '1-URGENT'")
    return symbols.resolution(wanted.join(m, F.col("wanted") == F.col("owner"), "left"), by_descriptor=False)


@query(b.with_relations("""SELECT w.wanted, count(f.descriptor) AS candidates, count(DISTINCT f.archive_path) AS archives,
CASE WHEN count(f.descriptor) = 0 THEN 'field_not_found' WHEN count(f.descriptor) = 1 THEN 'resolved'
     WHEN count(DISTINCT f.archive_path) > 1 AND count(DISTINCT f.descriptor) = 1 THEN 'source_ambiguous' ELSE 'field_ambiguous' END AS outcome
FROM (SELECT 'S/' || s_suppkey AS wanted FROM supplier) w LEFT JOIN fields f ON f.owner = w.wanted AND f.name = (SELECT min(p_brand) FROM part) GROUP BY w.wanted"""))
def field_resolution(spark, sf_dir):
    """Whether a field name resolves, and if not, why."""
    wanted = b.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S/"), F.col("s_suppkey")).alias("wanted"))
    least = b.table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    f = b.fields(spark, sf_dir).where(F.col("name") == least)
    return symbols.resolution(wanted.join(f, F.col("wanted") == F.col("owner"), "left"), by_descriptor=False, kind="field")


@query(b.with_relations("""SELECT m.archive_path, m.owner, m.name, m.descriptor, coalesce(string_agg(s.text, '|' ORDER BY s.text), '') AS strings FROM methods m
LEFT JOIN strings s ON s.archive_path = m.archive_path AND s.owner = m.owner AND s.method_name = m.name AND s.descriptor = m.descriptor GROUP BY ALL"""))
def method_strings(spark, sf_dir):
    """Methods with the strings in them."""
    found = symbols.method_strings(b.methods(spark, sf_dir), b.strings(spark, sf_dir))
    return found.select("archive_path", "owner", "name", "descriptor", F.array_join("strings", "|").alias("strings"))


@query(b.with_relations(""", ms AS (SELECT m.archive_path, m.owner, m.name, m.descriptor, count(s.text) AS n FROM methods m LEFT JOIN strings s ON s.owner = m.owner AND s.method_name = m.name AND s.descriptor = m.descriptor GROUP BY ALL)
SELECT c.archive_path, c.internal_name, coalesce((SELECT string_agg(interface_name, ',' ORDER BY interface_name) FROM interfaces i WHERE i.archive_path = c.archive_path AND i.owner = c.internal_name), '') AS interfaces,
coalesce((SELECT string_agg(name || ':' || descriptor, ',' ORDER BY name, descriptor) FROM fields f WHERE f.archive_path = c.archive_path AND f.owner = c.internal_name), '') AS fields,
coalesce((SELECT string_agg(name || descriptor || n, ',' ORDER BY name, descriptor) FROM ms WHERE ms.archive_path = c.archive_path AND ms.owner = c.internal_name), '') AS methods,
(SELECT count(*) FROM strings s WHERE s.archive_path = c.archive_path AND s.owner = c.internal_name) AS strings FROM classes c"""))
def class_records(spark, sf_dir):
    """Classes with all that belongs to them, nested and in order."""
    found = symbols.class_records(*[f(spark, sf_dir) for f in (b.classes, b.interfaces, b.fields, b.methods, b.strings)])
    line = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    return found.select(
        "archive_path", "internal_name", F.array_join("interfaces", ",").alias("interfaces"), line("fields", lambda x: F.concat(x["name"], F.lit(":"), x["descriptor"])),
        line("methods", lambda x: F.concat(x["name"], x["descriptor"], F.size(x["strings"]).cast("string"))), F.size("strings").cast("long").alias("strings"),
    )


# --- graphs ------------------------------------------------------------------------------------------


def _bfs_sql(edges: str, root: str, depth: int, budget: int, further: bool = False) -> str:
    """Breadth-first levels written out: rank new nodes of each level by their first parent, then by name.

    With ``further`` the root takes nothing of the budget, and one node beyond it is flagged.
    """
    out = f", e AS ({edges}), l0 AS (SELECT {root} AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, 0 AS seq)"
    seen = "SELECT node FROM l0"
    for d in range(1, depth + 1):
        out += f""", p{d} AS (SELECT e.dst, min(l.seq * 10 + e.ord) AS k FROM l{d - 1} l JOIN e ON e.src = l.node WHERE e.dst NOT IN ({seen}) GROUP BY e.dst),
        q{d} AS (SELECT dst, k, row_number() OVER (ORDER BY k, dst) + (SELECT max(seq) FROM l{d - 1}) AS seq FROM p{d}),
        l{d} AS (SELECT q.dst AS node, l.node AS parent, {d} AS depth, q.seq FROM q{d} q JOIN l{d - 1} l ON l.seq = q.k // 10 WHERE q.seq < {budget + 2 * further})"""
        seen += f" UNION ALL SELECT node FROM l{d}"
    every = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(depth + 1))
    flag = f"seq > {budget}" if further else f"seq = max(seq) OVER () AND count(*) OVER () >= {budget}"
    return out + f", a AS ({every}) SELECT node, parent, depth, CAST(seq AS INTEGER) AS seq, ({flag}) AS truncated FROM a WHERE seq <= {budget}" + " + 1" * further


def _emitted_sql(edges: str, root: str, depth: int, budget: int) -> str:
    """Levels in which every edge has a row; a node is searched from where it comes first."""
    out = f", e AS ({edges}), r0 AS (SELECT {root} AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, 0 AS seq), f0 AS (SELECT node, seq FROM r0)"
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM f{k}" for k in range(d))
        before = " UNION ALL ".join(f"SELECT seq FROM r{k}" for k in range(d))
        out += f""", r{d} AS (SELECT e.dst AS node, f.node AS parent, {d} AS depth, (SELECT max(seq) FROM ({before})) + row_number() OVER (ORDER BY f.seq, e.dst) AS seq FROM f{d - 1} f JOIN e ON e.src = f.node),
        f{d} AS (SELECT node, min(seq) AS seq FROM r{d} WHERE node NOT IN ({seen}) GROUP BY node)"""
    every = " UNION ALL ".join(f"SELECT * FROM r{d}" for d in range(depth + 1))
    return out + f", a AS ({every}) SELECT node, parent, depth, CAST(seq AS INTEGER) AS seq, seq > {budget} AS truncated FROM a WHERE seq <= {budget} + 1"


_MOST_CALLS = "(SELECT source_owner FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_MOST_CALLED = _MOST_CALLS.replace("source", "target")


def _most(edges: DataFrame) -> str:
    """The node with the most edges, by name among equals."""
    first = edges.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").first()
    return first.src if first else ""


@query(b.with_relations(_bfs_sql("SELECT source_owner AS src, target_owner AS dst, 0 AS ord FROM calls", _MOST_CALLS, 3, 128)))
def call_chain(spark, sf_dir):
    """Callees of a method by levels, each with its first caller."""
    e = b.calls(spark, sf_dir).select(F.col("source_owner").alias("src"), F.col("target_owner").alias("dst"), F.lit(0).alias("ord"))
    return graph.bfs(e, _most(e), 3, graph.Budget(128))


def _chains_sql(roots: str, step: str, depth: int, budget: int) -> str:
    """Levels of many searches at once: ``step`` gives (root, seq, k, archive_path, owner) of the frontier ``f``; k orders what one method leads to."""
    out = f", l0 AS (SELECT root, archive_path, owner, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, 0 AS seq FROM ({roots}))"
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT root, archive_path, owner, seq FROM l{k}" for k in range(d))
        out += f""", s{d} AS (SELECT root, archive_path, owner, seq FROM ({seen})), e{d} AS ({step.format(f=f"l{d - 1}")}),
        q{d} AS (SELECT e.root, e.archive_path, e.owner, min(struct_pack(seq := e.seq, k := e.k)) AS first FROM e{d} e ANTI JOIN s{d} s ON s.root = e.root AND s.archive_path = e.archive_path AND s.owner = e.owner GROUP BY ALL),
        n{d} AS (SELECT q.*, (SELECT max(seq) FROM s{d} s WHERE s.root = q.root) + row_number() OVER (PARTITION BY q.root ORDER BY q.first, q.archive_path, q.owner) AS seq FROM q{d} q),
        l{d} AS (SELECT n.root, n.archive_path, n.owner, p.owner || '#run()V' AS parent, {d} AS depth, n.seq FROM n{d} n JOIN l{d - 1} p ON p.root = n.root AND p.seq = n.first.seq WHERE n.seq < {budget})"""
    every = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(depth + 1))
    return out + f", chain AS (SELECT root, archive_path, owner, parent, depth, CAST(seq AS INTEGER) AS seq, seq = {budget} - 1 AS truncated FROM ({every}))"


#: Stored calls in order, each followed by the method's declarations in direct subtypes of its owner: parts call their brands every 20th part, and parts below a brand override.
_DOWN_CALLS = """SELECT f.root, f.seq, struct_pack(a := c.archive_path, t := c.target_owner, z := 0, x := '', o := '') AS k, c.archive_path, c.target_owner AS owner FROM {f} f JOIN every c ON c.source_owner = f.owner
UNION ALL SELECT f.root, f.seq, struct_pack(a := c.archive_path, t := c.target_owner, z := 1, x := m.archive_path, o := m.owner), m.archive_path, m.owner FROM {f} f JOIN every c ON c.source_owner = f.owner
JOIN (SELECT DISTINCT super_name, internal_name FROM part_classes WHERE super_name IS NOT NULL) k ON k.super_name = c.target_owner JOIN part_methods m ON m.owner = k.internal_name AND m.descriptor = '()V'"""
_UP_CALLS = """SELECT f.root, f.seq, struct_pack(l := 0, p := '', a := c.archive_path, o := c.source_owner) AS k, c.archive_path, c.source_owner AS owner FROM {f} f JOIN every c ON c.target_owner = f.owner
UNION ALL SELECT f.root, f.seq, struct_pack(l := 1, p := k.super_name, a := c.archive_path, o := c.source_owner), c.archive_path, c.source_owner FROM {f} f
JOIN (SELECT DISTINCT super_name, internal_name FROM part_classes WHERE super_name IS NOT NULL) k ON k.internal_name = f.owner JOIN every c ON c.target_owner = k.super_name"""
_EVERY_CALL = ", every AS (SELECT * FROM mutual UNION ALL SELECT 'parts', 'P/' || p_partkey, 'B/' || p_brand FROM part WHERE p_partkey % 20 = 1)"
_WANTED = """, resolved AS (SELECT 'P/' || p_partkey AS root, p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS one FROM part)"""


def _part_graph(spark, sf_dir, once: bool = False) -> calls.CallGraph:
    """Calls of parts both ways, calls of brands by every 20th part, and parts below brands; with ``once`` for a search that reads calls a single time."""
    part = b.table(spark, sf_dir, "part").where("p_partkey % 20 = 1")
    up = part.select(F.lit("parts").alias("archive_path"), *[x for side, name in (("source", F.concat(F.lit("P/"), "p_partkey")), ("target", F.concat(F.lit("B/"), "p_brand"))) for x in (name.alias(f"{side}_owner"), F.lit("run").alias(f"{side}_name"), F.lit("()V").alias(f"{side}_desc"))])
    every = b.mutual_calls(spark, sf_dir).unionByName(up)
    none = b.interfaces(spark, sf_dir).limit(0)
    made = calls.CallGraph.of(every, b.part_classes(spark, sf_dir), none, b.part_methods(spark, sf_dir))
    if once:
        return made
    # Calls are a join of line items here; a search reads them at every level, so that they are written once.
    kept = graph.checkpointed(made.by_source)
    return calls.CallGraph(kept, kept, made.by_parent, made.by_child, made.methods)


@query(b.with_relations(_EVERY_CALL + _chains_sql(f"SELECT 0 AS root, 'parts' AS archive_path, {_MOST_CALLS} AS owner", _DOWN_CALLS, 2, 64) + "SELECT archive_path, owner, parent, depth, seq, truncated FROM chain"))
def call_chain_by_frontier(spark, sf_dir):
    """Callees of a method that its callees call back: the root, which has its archive, does not come again."""
    g = _part_graph(spark, sf_dir)
    root = _most(b.calls(spark, sf_dir).select(F.col("source_owner").alias("src")))
    roots = spark.createDataFrame([(0, "parts", root, "run", "()V")], "root int, archive_path string, owner string, name string, descriptor string")
    return calls.search(lambda f, most: calls.callees(g, f, most), roots, 2, 64).select("archive_path", "owner", "parent", "depth", "seq", "truncated")


def _all_parts(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select(F.concat(F.lit("P/"), "p_partkey").alias("root"), F.concat(F.lit("P/"), "p_partkey").alias("owner"), F.lit("run").alias("name"), F.lit(None).cast("string").alias("descriptor"))


def _all_chains_sql(step: str, depth: int, budget: int) -> str:
    """Chains of the parts whose method is one, and the candidates of the others with the outcome."""
    body = _chains_sql("SELECT root, 'parts' AS archive_path, root AS owner FROM resolved WHERE one", step, depth, budget)
    return b.with_relations(_EVERY_CALL + _WANTED + body + """ SELECT root, archive_path, owner, '()V' AS descriptor, parent, depth, seq, truncated, 'resolved' AS outcome FROM chain
UNION ALL SELECT r.root, m.archive_path, m.owner, m.descriptor, NULL, NULL, NULL, false, 'overload_ambiguous' FROM resolved r JOIN part_methods m ON m.owner = r.root WHERE NOT r.one""")


@query(_all_chains_sql(_DOWN_CALLS, 2, 24))
def call_chains_of_all(spark, sf_dir):
    """Callees of every part's method at once, each search with known methods and a budget of its own; methods that are not one are told."""
    found = calls.chains(_part_graph(spark, sf_dir, once=True), _all_parts(spark, sf_dir), b.part_classes(spark, sf_dir), "callees", 2, 24)
    return found.select("root", "archive_path", "owner", "descriptor", "parent", "depth", "seq", "truncated", "outcome")


@query(_all_chains_sql(_UP_CALLS, 2, 16))
def caller_chains_of_all(spark, sf_dir):
    """Callers of every part's method at once, those of its brand's method after its own."""
    found = calls.chains(_part_graph(spark, sf_dir), _all_parts(spark, sf_dir), b.part_classes(spark, sf_dir), "callers", 2, 16)
    return found.select("root", "archive_path", "owner", "descriptor", "parent", "depth", "seq", "truncated", "outcome")


@query(b.with_relations(f"""SELECT source_owner, target_owner, r > 5 AS truncated FROM (SELECT *, row_number() OVER (ORDER BY source_owner) AS r FROM calls WHERE target_owner = {_MOST_CALLED}) WHERE r <= 6"""))
def references_cut(spark, sf_dir):
    """References in order, and one further row that says that there are more."""
    c = b.calls(spark, sf_dir)
    to = _most(c.select(F.col("target_owner").alias("src")))
    return graph.first_and_further(c.where(F.col("target_owner") == to).select("source_owner", "target_owner"), ["source_owner"], 5)


@query(b.with_relations(_bfs_sql("SELECT target_owner AS src, source_owner AS dst, 0 AS ord FROM calls", _MOST_CALLED, 4, 12)))
def call_chain_budget(spark, sf_dir):
    """Callers under a budget that ends the search."""
    e = b.calls(spark, sf_dir).select(F.col("target_owner").alias("src"), F.col("source_owner").alias("dst"), F.lit(0).alias("ord"))
    return graph.bfs(e, _most(e), 4, graph.Budget(12))


@query(b.with_relations(""", up AS (SELECT child, parent FROM (SELECT internal_name AS child, super_name AS parent FROM classes WHERE super_name IS NOT NULL UNION SELECT owner, interface_name FROM interfaces)),
r(src, dst) AS (SELECT child, parent FROM up UNION SELECT r.src, up.parent FROM r JOIN up ON up.child = r.dst) SELECT src, dst FROM r""", recursive=True))
def type_closure(spark, sf_dir):
    """All supertypes of all types."""
    e = graph.type_edges(b.classes(spark, sf_dir), b.interfaces(spark, sf_dir))
    return graph.closure(e.select(F.col("child").alias("src"), F.col("parent").alias("dst")))


@query(b.with_relations(_bfs_sql("SELECT internal_name AS src, super_name AS dst, 0 AS ord FROM classes WHERE super_name IS NOT NULL UNION SELECT owner, interface_name, 1 FROM interfaces", "'C/5'", 8, 3, True)))
def supertypes(spark, sf_dir):
    """The superclass, the interface and what they lead to, with a budget that just suffices."""
    return graph.supertypes(b.classes(spark, sf_dir), b.interfaces(spark, sf_dir), "C/5", budget=graph.Budget(3))


_DOWN = "SELECT super_name AS src, internal_name AS dst FROM classes WHERE super_name IS NOT NULL UNION ALL SELECT interface_name, owner FROM interfaces"


@query(b.with_relations(_emitted_sql(_DOWN, "'R/1'", 2, 40)))
def subtypes(spark, sf_dir):
    """One more than the budget is there, flagged."""
    return graph.subtypes(b.classes(spark, sf_dir), b.interfaces(spark, sf_dir), "R/1", 2, graph.Budget(40))


#: Types that two of their supertypes lead to: nations below regions, and below a root that regions have too.
_DIAMOND = f"""{_DOWN} UNION ALL SELECT 'T', 'R/' || r_regionkey FROM region UNION ALL SELECT 'T', 'N/' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'R/' || r_regionkey, 'R/' || (r_regionkey + 1) FROM region WHERE r_regionkey < 4"""


@query(b.with_relations(_emitted_sql(_DIAMOND, "'T'", 3, 60)))
def subtypes_of_diamonds(spark, sf_dir):
    """A type comes once for each edge that leads to it, and is searched from once."""
    none = F.lit("geo")
    region, nation = b.table(spark, sf_dir, "region"), b.table(spark, sf_dir, "nation")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    i = F.col("r_regionkey")
    also = (
        region.select(none.alias("archive_path"), name("R/", i).alias("owner"), F.lit("T").alias("interface_name"))
        .union(nation.where("n_nationkey % 2 = 0").select(none, name("N/", F.col("n_nationkey")), F.lit("T")))
        .union(region.where("r_regionkey < 4").select(none, name("R/", i + 1), name("R/", i)))
    )
    return graph.subtypes(b.classes(spark, sf_dir), b.interfaces(spark, sf_dir).unionByName(also), "T", 3, graph.Budget(60))


@query(b.with_relations(f""", z AS (SELECT 'N/3' AS node, 0 AS depth UNION SELECT dst, 1 FROM ({_DOWN}) WHERE src = 'N/3' UNION SELECT src, 1 FROM ({_DOWN}) WHERE dst = 'N/3'),
f AS (SELECT m.*, z.depth, row_number() OVER (ORDER BY z.depth, m.owner, m.archive_path, m.descriptor) AS r FROM methods m JOIN z ON z.node = m.owner WHERE m.name = '1-URGENT')
SELECT archive_path, owner, name, descriptor, depth, r > 8 AS truncated FROM f WHERE r <= 9"""))
def method_overrides(spark, sf_dir):
    """G10, G11, T12."""
    return graph.method_overrides(b.classes(spark, sf_dir), b.interfaces(spark, sf_dir), b.methods(spark, sf_dir), "N/3", "1-URGENT", depth=1, max_nodes=8)


# --- control flow ------------------------------------------------------------------------------------


@query(b.with_relations("SELECT method, idx, op, block FROM blocked"))
def cfg_blocks(spark, sf_dir):
    """G12, G13."""
    return cfg.blocks(b.instructions(spark, sf_dir)).select("method", "idx", "op", "block")


@query(b.with_relations("SELECT method, from_block, to_block, kind FROM flow"))
def cfg_edges(spark, sf_dir):
    """G14."""
    return cfg.edges(cfg.blocks(b.instructions(spark, sf_dir))).select("method", "from_block", "to_block", "kind")


@query(b.with_relations("""SELECT method, generate_series AS from_block, h AS to_block, 'exception' AS kind FROM (
SELECT s.method, s.block AS a, greatest(s.block, coalesce(e.block - 1, (SELECT max(block) FROM blocked m WHERE m.method = s.method), s.block)) AS z, t.block AS h
FROM blocked s JOIN blocked t ON t.method = s.method AND t.idx = 4 LEFT JOIN blocked e ON e.method = s.method AND e.idx = 7 WHERE s.idx = 1), generate_series(a, z)"""))
def cfg_exceptions(spark, sf_dir):
    """The blocks of a guarded range, or up to the method's last where its end is missing, to the handler's block."""
    blocked = cfg.blocks(b.instructions(spark, sf_dir))
    return cfg.exception_edges(blocked, _handlers(blocked, "x/E")).select("method", "from_block", "to_block", "kind")


def _handlers(blocked, caught):
    return blocked.select("method").distinct().select("method", F.lit(1).cast("long").alias("start"), F.lit(7).cast("long").alias("end"), F.lit(4).cast("long").alias("handler"), F.lit(caught).cast("string").alias("type"), F.lit(0).cast("long").alias("ord"))


_LABELS = """, lines AS (SELECT method, block, string_agg(idx || ': ' || op, '\\n' ORDER BY idx) FILTER (n <= 3) AS label FROM (SELECT *, row_number() OVER (PARTITION BY method, block ORDER BY idx) AS n FROM blocked) GROUP BY ALL)"""


@query(b.with_relations(_LABELS + "SELECT method, block, label FROM lines"))
def cfg_labels(spark, sf_dir):
    """TX21: a block's first three operations."""
    return cfg.labels(cfg.blocks(b.instructions(spark, sf_dir)))


_NODES, _ARROWS = "(SELECT string_agg({}, chr(10) ORDER BY block) FROM lines n WHERE n.method = m.method)", "coalesce((SELECT chr(10) || string_agg({}, chr(10) ORDER BY from_block, ord) FROM flow f WHERE f.method = m.method), '')"


@query(b.with_relations(_LABELS + "SELECT method, 'graph TD' || chr(10) || " + _NODES.format("""'  B' || block || '["' || label || '"]'""") + " || " + _ARROWS.format("'  B' || from_block || ' -->|' || kind || '| B' || to_block") + " AS diagram FROM (SELECT DISTINCT method FROM blocked) m"))
def cfg_mermaid(spark, sf_dir):
    """SK8, T20."""
    blocked = cfg.blocks(b.instructions(spark, sf_dir))
    return cfg.mermaid(cfg.edges(blocked), cfg.labels(blocked))


@query(b.with_relations(_LABELS + "SELECT method, '@startuml' || chr(10) || " + _NODES.format("""'state B' || block || ' as "' || label || '"'""") + " || " + _ARROWS.format("'B' || from_block || ' --> B' || to_block || ' : ' || kind") + " || chr(10) || '@enduml' AS diagram FROM (SELECT DISTINCT method FROM blocked) m"))
def cfg_plantuml(spark, sf_dir):
    """SK8, T20."""
    blocked = cfg.blocks(b.instructions(spark, sf_dir))
    return cfg.plantuml(cfg.edges(blocked), cfg.labels(blocked))


# --- differences -------------------------------------------------------------------------------------

_SIDES = """WITH l AS (SELECT l_partkey, l_suppkey, count(*) AS size, CAST(max(l_linenumber) AS BIGINT) AS crc FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
r AS (SELECT l_partkey, l_suppkey, count(*) AS size, CAST(max(l_linenumber) AS BIGINT) AS crc FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
d AS (SELECT l_partkey, l_suppkey, l.size AS left_size, l.crc AS left_crc, r.size AS right_size, r.crc AS right_crc,
  CASE WHEN l.size IS NULL THEN 'added' WHEN r.size IS NULL THEN 'removed' WHEN l.size = r.size AND l.crc = r.crc THEN 'unchanged' ELSE 'modified' END AS status
  FROM l FULL OUTER JOIN r USING (l_partkey, l_suppkey)) """


def _sides(spark, sf_dir):
    line = b.table(spark, sf_dir, "lineitem")
    side = lambda flag: line.where(F.col("l_returnflag") == flag).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("size"), F.max("l_linenumber").cast("long").alias("crc"))
    return diff.compare_entries(side("R"), side("A"), ["l_partkey", "l_suppkey"])


@query(_SIDES + "SELECT * FROM d")
def compare_archives(spark, sf_dir):
    """J8, U2, U3, T18."""
    return _sides(spark, sf_dir)


@query(_SIDES + "SELECT status, count(*) AS n FROM d GROUP BY status")
def compare_summary(spark, sf_dir):
    """A5."""
    return _sides(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT a.doc_id, regexp_split_to_array(a.text, '\\r\\n|[\\n\\x0B\\f\\r\\x{85}\\x{2028}\\x{2029}]') AS l, regexp_split_to_array(b.text, '\\r\\n|[\\n\\x0B\\f\\r\\x{85}\\x{2028}\\x{2029}]') AS r FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
x AS (SELECT doc_id, unnest(range(1, greatest(len(l), len(r)) + 1)) AS line, l, r FROM p)
SELECT doc_id, line, coalesce(l[line], '') AS "left", coalesce(r[line], '') AS "right" FROM x WHERE coalesce(l[line], '') <> coalesce(r[line], '')""")
def compare_lines(spark, sf_dir):
    """Each text against the next one, line by line."""
    d = docs(spark, sf_dir).select("doc_id", "text")
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), "text")
    ids = d.select("doc_id").join(nxt.select("doc_id"), "doc_id", "left_semi")
    return diff.compare_lines(d.join(ids, "doc_id", "left_semi"), nxt.join(ids, "doc_id", "left_semi"), "doc_id", "text")


# --- logs --------------------------------------------------------------------------------------------


def _log(spark, sf_dir):
    i = F.col("event_id")
    line = (
        F.when(i % 6 == 0, F.concat(F.lit("2024-01-02 03:04:05,678 ERROR [main] app.Main - event "), F.col("event_type")))
        .when(i % 6 == 1, F.concat(F.lit("java.lang.IllegalStateException: "), F.col("event_type")))
        .when(i % 6 == 2, F.concat(F.lit("\tat C."), F.col("user_id"), F.lit(".run(F.java:"), i, F.lit(")")))
        .when(i % 6 == 3, F.lit("\tat x.Y.z(Native Method)"))
        .when(i % 6 == 4, F.concat(F.lit("Caused by: x.DeepError: "), F.col("user_id")))
        .otherwise(F.concat(F.lit("... "), i % 50, F.lit(" more")))
    )
    return b.table(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query("""SELECT event_id,
CASE event_id % 6 WHEN 0 THEN 'log' WHEN 1 THEN 'header' WHEN 2 THEN 'frame' WHEN 3 THEN 'frame' WHEN 4 THEN 'causedBy' ELSE 'omitted' END AS kind,
CASE event_id % 6 WHEN 1 THEN 'java.lang.IllegalStateException' WHEN 4 THEN 'x.DeepError' END AS exception_type,
CASE event_id % 6 WHEN 0 THEN 'event ' || event_type WHEN 1 THEN event_type WHEN 4 THEN CAST(user_id AS VARCHAR) END AS message,
CASE WHEN event_id % 6 = 5 THEN event_id % 50 END AS omitted, CASE WHEN event_id % 6 = 0 THEN 'ERROR' END AS level, CASE WHEN event_id % 6 = 0 THEN 'app.Main' END AS logger,
CASE event_id % 6 WHEN 2 THEN 'C.' || user_id WHEN 3 THEN 'x.Y' END AS class_name, CASE event_id % 6 WHEN 2 THEN 'run' WHEN 3 THEN 'z' END AS method_name,
CASE WHEN event_id % 6 = 2 THEN event_id END AS source_line FROM events""")
def log_lines(spark, sf_dir):
    """TX8, TX10, T14: kinds of log lines and their parts."""
    parsed = logs.parse_lines(_log(spark, sf_dir))
    return parsed.select("event_id", "kind", "exception_type", "message", "omitted", "level", "logger", "class_name", "method_name", "source_line")


@query(b.with_relations("""SELECT e.event_id, 'C.' || user_id AS class_name, 'run' AS method_name, count(DISTINCT c.archive_path) AS archives, CAST(0 AS BIGINT) AS methods
FROM events e LEFT JOIN classes c ON c.internal_name = 'C/' || e.user_id WHERE event_id % 6 = 2 GROUP BY ALL
UNION ALL SELECT event_id, 'x.Y', 'z', 0, 0 FROM events WHERE event_id % 6 = 3"""))
def frames_resolved(spark, sf_dir):
    """Frames with their candidate classes and methods; frames without any stay."""
    frames = logs.parse_lines(_log(spark, sf_dir)).where("kind = 'frame'").select("event_id", "class_name", "method_name")
    return logs.resolve_frames(frames, b.classes(spark, sf_dir), b.methods(spark, sf_dir), ["event_id"])


@query(b.with_relations("""SELECT e.event_id, coalesce(string_agg(c.archive_path || '=' || c.methods, ';' ORDER BY c.archive_path), '') AS candidates FROM (
SELECT event_id, 'C/' || user_id AS name, ['1-URGENT', '2-HIGH', '3-MEDIUM', 'none'][event_id % 4 + 1] AS method FROM events) e LEFT JOIN (
SELECT c.archive_path, c.internal_name, w.method, coalesce(string_agg(m.descriptor, '+' ORDER BY m.descriptor), '') AS methods FROM classes c CROSS JOIN (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', 'none']) AS method) w
LEFT JOIN methods m ON m.archive_path = c.archive_path AND m.owner = c.internal_name AND m.name = w.method GROUP BY ALL) c ON c.internal_name = e.name AND c.method = e.method GROUP BY e.event_id"""))
def frame_candidates(spark, sf_dir):
    """Frames with the archives that hold their class, each with the descriptors of the methods of their name; frames without any stay."""
    method = F.element_at(F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "none"])), (F.col("event_id") % 4 + 1).cast("int"))
    frames = b.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("C."), F.col("user_id")).alias("class_name"), method.alias("method_name"))
    found = logs.frame_candidates(frames, b.classes(spark, sf_dir), b.methods(spark, sf_dir), ["event_id"])
    line = F.transform("candidates", lambda c: F.concat(c["archive_path"], F.lit("="), F.array_join(c["methods"], "+")))
    return found.select("event_id", F.array_join(line, ";").alias("candidates"))


# --- versions, policy, reports -----------------------------------------------------------------------


_VERSIONS = ["2.0", "1.2-rc1", "1.2", "alpha", "1.2.0.1", "1.2-beta", "10", "1.10", "1.2.0-SNAPSHOT", "1", "1.0-SNAPSHOT", "1.2.0.0.1", "2"]
#: The same in their order, as the rules give it by hand.
_ORDERED = ["alpha", "1.0-SNAPSHOT", "1", "1.2-beta", "1.2-rc1", "1.2.0-SNAPSHOT", "1.2", "1.2.0.0.1", "1.2.0.1", "1.10", "2", "2.0", "10"]


@query(f"""WITH v AS (SELECT p_brand AS artifact, p_partkey, [{', '.join(f"'{v}'" for v in _VERSIONS)}][p_partkey % 13 + 1] AS version FROM part)
SELECT artifact, arg_max(version, k) AS newest, arg_min(version, k) AS oldest, count(*) AS n FROM (SELECT *, list_position([{', '.join(f"'{v}'" for v in _ORDERED)}], version) AS k FROM v) GROUP BY artifact""")
def newest_versions(spark, sf_dir):
    """Of each artifact the newest and the oldest version; text, missing parts and numbers all take part."""
    version = F.element_at(F.array(*map(F.lit, _VERSIONS)), (F.col("p_partkey") % 13 + 1).cast("int"))
    files = b.table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("-"), version, F.lit(".jar")).alias("file"), "p_brand", version.alias("version"))
    key = fn.version_key(F.col("version"))
    return files.groupBy(F.col("p_brand").alias("artifact")).agg(F.max_by("version", key).alias("newest"), F.min_by("version", key).alias("oldest"), F.count("*").alias("n"))


@query("""SELECT d.source AS engine, count(*) AS total, count_if(l.quality = 1) AS success, count_if(l.toxic = 1) AS patched, count_if(l.quality = 0) AS failed
FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source""")
def quality_tallies(spark, sf_dir):
    """A3, A4, A14, T23."""
    o = b.table(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id", F.col("source").alias("engine")), "doc_id")
    return policy.tallies(o, ["engine"], {"success": F.col("quality") == 1, "patched": F.col("toxic") == 1, "failed": F.col("quality") == 0})


@query("""SELECT CASE WHEN m LIKE '%class not found%' THEN 'class_not_found' WHEN m LIKE '%unsupported%' THEN 'unsupported' WHEN m LIKE '%patch%' THEN 'patch' ELSE 'other' END AS category, count(*) AS n
FROM (SELECT CASE event_type WHEN 'click' THEN 'class not found: x' WHEN 'view' THEN 'unsupported format' WHEN 'purchase' THEN 'patch failed' ELSE 'odd' END AS m FROM events) GROUP BY 1""")
def failure_categories(spark, sf_dir):
    """TX11."""
    m = F.when(F.col("event_type") == "click", "Class not found: x").when(F.col("event_type") == "view", "unsupported format").when(F.col("event_type") == "purchase", "patch failed").otherwise("odd")
    return b.table(spark, sf_dir, "events").groupBy(fn.failure_category(m).alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, arg_min(o_orderkey, o_orderkey) FILTER (usable) AS chosen, count_if(NOT usable) AS failures
FROM (SELECT o_custkey, o_orderkey, o_orderstatus <> 'F' AS usable FROM orders) GROUP BY o_custkey""")
def engine_fallback(spark, sf_dir):
    """The first usable attempt by rank, with the number of failed ones."""
    a = b.table(spark, sf_dir, "orders").select(F.col("o_custkey"), F.col("o_orderkey").alias("rank"), F.col("o_orderkey").alias("output"), (F.col("o_orderstatus") != "F").alias("usable"))
    return policy.first_usable(a, ["o_custkey"]).select("o_custkey", F.col("output").alias("chosen"), "failures")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'META-INF/versions/' || (doc_id % 4 + 8) || '/' ELSE 'BOOT-INF/classes/' END || 'a/C' || doc_id // 10 || '.class' AS entry,
'a/C' || doc_id // 10 AS internal_name, CASE WHEN doc_id % 5 = 0 THEN doc_id % 4 + 8 END AS version FROM documents""")
def entry_paths(spark, sf_dir):
    """SC4, TX1: entry paths without the roots of archives, and their release."""
    return policy.class_entries(_entries(spark, sf_dir)).select("doc_id", "entry", "internal_name", "version")


def _entries(spark, sf_dir):
    i = F.col("doc_id")
    root = F.when(i % 5 == 0, F.concat(F.lit("META-INF/versions/"), (i % 4 + 8).cast("string"), F.lit("/"))).otherwise("BOOT-INF/classes/")
    return docs(spark, sf_dir).select("doc_id", F.lit("x.jar").alias("archive_path"), F.concat(root, F.lit("a/C"), F.floor(i / 10).cast("string"), F.lit(".class")).alias("entry"))


@query("""SELECT internal_name, arg_min(doc_id, k) AS doc_id FROM (SELECT doc_id, 'a/C' || doc_id // 10 AS internal_name, v,
CASE WHEN v IS NULL OR v <= 9 THEN 0 ELSE 1000000000 END + CASE WHEN v IS NULL THEN 500000000 ELSE (100 - v) * 1000000 END + doc_id AS k
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN doc_id % 4 + 8 END AS v FROM documents)) GROUP BY internal_name""")
def multi_release(spark, sf_dir):
    """SC5, SC6: the location of a class that a release reads."""
    return policy.multi_release(policy.class_entries(_entries(spark, sf_dir)), 9, "doc_id").select("internal_name", "doc_id")


@query("SELECT source AS archive_path, count(*) AS files, sum(strlen(coalesce(text, ''))) AS size FROM documents WHERE regexp_matches(source, '^src1[^/]*$') GROUP BY source")
def directory_totals(spark, sf_dir):
    """Files and bytes of the archives whose names a glob matches."""
    d = docs(spark, sf_dir).where(fn.glob(F.col("source"), "src1*"))
    return d.groupBy(F.col("source").alias("archive_path")).agg(F.count("*").alias("files"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).cast("long").alias("size"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS fingerprint FROM documents")
def fingerprints(spark, sf_dir):
    """SC16."""
    return docs(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"))


@query("""SELECT a.doc_id, CASE WHEN a.doc_id % 3 = 0 THEN 'new' WHEN a.doc_id % 3 = 1 THEN 'changed' ELSE 'current' END AS state FROM documents a""")
def refresh_plan(spark, sf_dir):
    """T2, SK2: archives that are new, changed or current by their fingerprints."""
    now = docs(spark, sf_dir).select(F.col("doc_id").alias("archive_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"))
    manifest = now.where("archive_path % 3 <> 0").select("archive_path", F.when(F.col("archive_path") % 3 == 1, "old").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return policy.refresh_plan(now, manifest).select(F.col("archive_path").alias("doc_id"), "state")


@query("""SELECT page_id, CASE WHEN e LIKE 'meta-inf/services/%' THEN 'service' WHEN e LIKE '%.xml' THEN 'xml' WHEN e LIKE '%.properties' THEN 'properties' WHEN e LIKE '%.yml' THEN 'yaml' WHEN e LIKE '%.md' THEN 'text' END AS resource_type
FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'meta-inf/services/a.b' WHEN 1 THEN 'x.xml' WHEN 2 THEN 'y.properties' WHEN 3 THEN 'z.yml' WHEN 4 THEN 'r.md' ELSE 'a.bin' END AS e FROM pages)""")
def resource_types(spark, sf_dir):
    """X19, X15, SC14."""
    names = F.array(*map(F.lit, ["META-INF/services/a.b", "x.XML", "y.properties", "z.yml", "r.md", "a.bin"]))
    return b.table(spark, sf_dir, "pages").select("page_id", fn.resource_type(F.element_at(names, (F.col("page_id") % 6 + 1).cast("int"))).alias("resource_type"))


@query("""SELECT o_orderkey, u.ord - 1 AS pos, u.t AS type FROM (SELECT o_orderkey, unnest(['b/Out', 'a/In' || (o_orderkey % 9), 'a/Key']) AS t, unnest([1, 2, 3]) AS ord FROM orders) u""")
def descriptor_types(spark, sf_dir):
    """Object types of a method descriptor, the return type first."""
    d = F.concat(F.lit("(La/In"), F.col("o_orderkey") % 9, F.lit(";I[[La/Key;J)[Lb/Out;"))
    return b.table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(fn.object_types(d)).alias("pos", "type"))


@query("SELECT p_partkey, trim(CASE WHEN p_size & 1 > 0 THEN 'public ' ELSE '' END || CASE WHEN p_size & 2 > 0 THEN 'private ' ELSE '' END || CASE WHEN p_size & 4 > 0 THEN 'protected ' ELSE '' END || CASE WHEN p_size & 8 > 0 THEN 'static ' ELSE '' END || CASE WHEN p_size & 16 > 0 THEN 'final ' ELSE '' END) AS flags FROM part")
def access_flags(spark, sf_dir):
    """TX4."""
    return b.table(spark, sf_dir, "part").select("p_partkey", F.array_join(fn.flag_names(F.col("p_size")), " ").alias("flags"))


def _gutter_sql(shown: str) -> str:
    return f"""SELECT doc_id, string_agg({shown}, chr(10) ORDER BY i) AS listing FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS l FROM (
SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)) GROUP BY doc_id"""


@query(_gutter_sql("printf('%4d | %s', i, l)"))
def line_gutter(spark, sf_dir):
    """TX16: lines with their numbers."""
    return docs(spark, sf_dir).where("text is not null").select("doc_id", policy.gutter(F.col("text")).alias("listing"))


@query(_gutter_sql("printf('%4d | %4s | %s', i, CASE i WHEN 1 THEN '7' WHEN 3 THEN '12345' ELSE '' END, l)"))
def line_gutter_both(spark, sf_dir):
    """TX16: lines with their numbers and those of the source, blank where there is none."""
    known = F.create_map(F.lit(1), F.lit(7), F.lit(3), F.lit(12345))
    return docs(spark, sf_dir).where("text is not null").select("doc_id", policy.gutter(F.col("text"), "both", known).alias("listing"))


@query(f"""WITH c AS (SELECT p_size AS owner, p_partkey, p_partkey % 4 AS priority, p_brand AS artifact, [{', '.join(f"'{v}'" for v in _VERSIONS)}][p_partkey % 13 + 1] AS version,
repeat('d/', CAST(p_partkey % 3 AS INTEGER)) || p_name AS name FROM part)
SELECT owner, p_partkey, row_number() OVER (PARTITION BY owner ORDER BY priority, artifact, list_position([{', '.join(f"'{v}'" for v in _ORDERED)}], version) DESC, len(string_split(name, '/')), name) AS rank FROM c""")
def container_ranks(spark, sf_dir):
    """The order in which containers are searched for a class."""
    version = F.element_at(F.array(*map(F.lit, _VERSIONS)), (F.col("p_partkey") % 13 + 1).cast("int"))
    name = F.concat(F.repeat(F.lit("d/"), (F.col("p_partkey") % 3).cast("int")), "p_name")
    c = b.table(spark, sf_dir, "part").select(F.col("p_size").alias("owner"), "p_partkey", (F.col("p_partkey") % 4).alias("priority"), F.col("p_brand").alias("artifact"), version.alias("version"), name.alias("name"))
    return policy.ranked_containers(c, ["owner"]).select("owner", "p_partkey", "rank")


@query("""SELECT p.page_id, CASE WHEN p.page_id % 3 > 0 THEN sha1(CAST(p.page_id // 2 AS VARCHAR)) END AS checksum FROM pages p""")
def checksum_lookup(spark, sf_dir):
    """J15, SC17: files' checksums from a list, by file name."""
    i = F.col("page_id")
    pages = b.table(spark, sf_dir, "pages").select("page_id")
    listed = pages.where("page_id % 3 > 0").select(fn.checksum_line(F.concat(F.sha1(F.floor(i / 2).cast("string").cast("binary")), F.lit("  libs/p"), i, F.lit(".jar"))).alias("c")).select("c.*")
    files = pages.select("page_id", F.concat(F.lit("/data/x/p"), i, F.lit(".jar")).alias("path"))
    return policy.checksum_of(files, listed).select("page_id", "checksum")


@query("""SELECT o_orderkey, u AS line, CASE WHEN u BETWEEN 3 AND 5 THEN 100 + least(u - 3, 1) ELSE u END AS source_line FROM (SELECT o_orderkey, unnest(range(1, 8)) AS u FROM orders)""")
def line_map(spark, sf_dir):
    """TX17: a line map in which a patched range takes the patch's lines, clamped to its span."""
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey")
    base = orders.select("o_orderkey", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("line")).withColumn("source_line", F.col("line"))
    patches = orders.select("o_orderkey", F.lit(3).alias("start"), F.lit(5).alias("end"), F.lit(100).alias("source_start"), F.lit(101).alias("source_end"))
    return policy.merge_line_map(base, patches, ["o_orderkey"])


@query("""SELECT source, string_agg(doc_id || ':' || lang, chr(10) ORDER BY doc_id) AS listing FROM (SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20) GROUP BY source""")
def skeleton(spark, sf_dir):
    """SK3, SK7, L9: a file's text from the first twenty rows of each archive, in order."""
    head = paging.head_of_each(docs(spark, sf_dir).select("source", "doc_id", "lang"), ["source"], ["doc_id"], 20)
    rows = F.array_sort(F.collect_list(F.struct("doc_id", F.concat("doc_id", F.lit(":"), "lang").alias("line"))))
    return head.groupBy("source").agg(F.concat_ws("\n", F.transform(rows, lambda r: r["line"])).alias("listing"))


@query("""SELECT page_id, 'local.inferred' AS group_id, CASE page_id % 4 WHEN 0 THEN 'art-' || chr(CAST(97 + page_id % 26 AS INTEGER)) ELSE 'art' END AS artifact_id,
CASE page_id % 4 WHEN 0 THEN '0.0.0-local' WHEN 1 THEN '1.' || page_id ELSE '2-beta' END AS version, CASE page_id % 3 WHEN 0 THEN 'jar' WHEN 1 THEN 'war' ELSE 'zip' END AS packaging FROM pages""")
def file_coordinates(spark, sf_dir):
    """TX12, TX13, T25, SC2, SC18: coordinates that a file name gives, a local version where it has none, and its packaging."""
    i = F.col("page_id")
    stem = F.when(i % 4 == 0, F.concat(F.lit("art-"), F.char(97 + i % 26))).when(i % 4 == 1, F.concat(F.lit("art-1."), i)).otherwise("art-2-beta")
    name = F.concat(stem, F.when(i % 3 == 0, ".jar").when(i % 3 == 1, ".WAR").otherwise(".zip"))
    pages = b.table(spark, sf_dir, "pages").select("page_id", name.alias("file")).where(F.lower("file").rlike(fn.ARCHIVE))
    return pages.select("page_id", fn.inferred_coordinates(F.col("file")).alias("c")).select("page_id", "c.*")


@query("SELECT doc_id, sha1(coalesce(text, '')) AS checksum, 'f' || doc_id || '.jar' AS file FROM documents")
def checksum_list(spark, sf_dir):
    """SC17, J15: a checksum list read back, in text and binary form."""
    i = F.col("doc_id")
    line = F.concat(F.sha1(F.coalesce("text", F.lit("")).cast("binary")), F.when(i % 2 == 0, "  ").otherwise(" *"), F.lit("f"), i.cast("string"), F.lit(".jar"))
    return docs(spark, sf_dir).select("doc_id", fn.checksum_line(line).alias("c")).select("doc_id", "c.checksum", "c.file")


@query("""SELECT o_orderkey, 'x = "' || o_orderpriority || '"; c = ''y''; n = (int) 3;' AS text, CAST(2 AS BIGINT) AS removed FROM orders""")
def literal_casts(spark, sf_dir):
    """TX19."""
    source = F.concat(F.lit('x = (String) "'), "o_orderpriority", F.lit("\"; c = (char)'y'; n = (int) 3;"))
    return b.table(spark, sf_dir, "orders").select("o_orderkey", fn.without_literal_casts(source).alias("r")).select("o_orderkey", "r.text", "r.removed")


@query("""SELECT l_partkey, l_suppkey, side FROM (
(SELECT l_partkey, l_suppkey, 'removed' AS side FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey, 'removed' FROM lineitem WHERE l_returnflag = 'A')
UNION ALL (SELECT l_partkey, l_suppkey, 'added' FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, l_suppkey, 'added' FROM lineitem WHERE l_returnflag = 'R'))""")
def entry_difference(spark, sf_dir):
    """Keys on one side alone."""
    line = b.table(spark, sf_dir, "lineitem")
    side = lambda flag: line.where(F.col("l_returnflag") == flag)
    return diff.keys_on_one_side(side("R"), side("A"), ["l_partkey", "l_suppkey"])


@query("""SELECT page_id, ['fernflower', 'jd-core-v1', 'vineflower', 'auto', 'auto', NULL, 'jd-core-v0'][page_id % 7 + 1] AS engine FROM pages""")
def engine_names(spark, sf_dir):
    """TX24: decompilers by any of their names."""
    asked = F.array(*map(F.lit, ["FF", "jdcore", "vf", "  ", None, "other", "V0"]))
    return b.table(spark, sf_dir, "pages").select("page_id", fn.engine_name(F.element_at(asked, (F.col("page_id") % 7 + 1).cast("int"))).alias("engine"))


_FILES = """, f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'given/g' || doc_id || '.jar' WHEN 2 THEN 'repo/r' || doc_id || '-sources.jar' WHEN 3 THEN 'repo/s' || doc_id || '-sources.jar' ELSE 'libs/l' || doc_id || '-sources.jar' END AS origin,
CASE doc_id % 6 WHEN 1 THEN 'src/main/p/C' WHEN 4 THEN 'xp/C' ELSE 'p/C' END || doc_id || '.java' AS entry, coalesce(text, '') AS source FROM documents),
w AS (SELECT doc_id, 'p/C' || doc_id || '.java' AS path, CASE WHEN doc_id % 6 IN (0, 5) THEN 'given/g' || doc_id || '.jar' END AS given, 'libs/l' || doc_id || '-sources.jar' AS sibling,
CASE WHEN doc_id % 6 IN (2, 4) THEN 'repo/r' || doc_id || '-sources.jar' END AS gav, CASE WHEN doc_id % 6 = 3 THEN 'repo/s' || doc_id || '-sources.jar' END AS checksum FROM documents),
o AS (UNPIVOT w ON given, sibling, gav, checksum INTO NAME how VALUE origin),
m AS (SELECT o.doc_id, o.how, f.origin, f.source, row_number() OVER (PARTITION BY o.doc_id ORDER BY list_position(['given', 'sibling', 'gav', 'checksum'], o.how)) AS r
  FROM o JOIN f ON f.origin = o.origin AND (f.entry = o.path OR f.entry LIKE '%/' || o.path))"""


@query("WITH one AS (SELECT 1)" + _FILES + """SELECT doc_id, CASE how WHEN 'gav' THEN 'coordinates' ELSE how END AS strategy, origin, sha256(source) AS source_sha256 FROM m WHERE r = 1""")
def source_lookup(spark, sf_dir):
    """T24, J15, TX14, TX15: sources of every class by the first strategy that finds them, each on what those before it have left."""
    d, i = docs(spark, sf_dir), F.col("doc_id")
    name = lambda before, after="": F.concat(F.lit(before), i.cast("string"), F.lit(after))
    kind = i % 6
    origin = F.when(kind == 0, name("given/g", ".jar")).when(kind == 2, name("repo/r", "-sources.jar")).when(kind == 3, name("repo/s", "-sources.jar")).otherwise(name("libs/l", "-sources.jar"))
    entry = F.when(kind == 1, name("src/main/p/C", ".java")).when(kind == 4, name("xp/C", ".java")).otherwise(name("p/C", ".java"))
    files = d.select(origin.alias("archive_path"), entry.alias("entry"), F.lit(0).alias("ord"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    has = kind.isin(2, 4)
    wanted = d.select(
        i.alias("id"), name("p.C").alias("class_name"), name("libs/l", ".war").alias("archive_path"), F.when(kind.isin(0, 5), name("given/g", ".jar")).alias("given"), F.when(has, "g").alias("group_id"),
        F.when(has, name("a")).alias("artifact_id"), F.lit("1").alias("version"), F.sha1(name("s")).alias("checksum"),
    )
    repository = d.where(kind.isin(2, 3)).select(origin.alias("origin"), F.when(kind == 2, "g").alias("group_id"), name("a").alias("artifact_id"), F.lit("1").alias("version"), F.when(kind == 3, F.upper(F.sha1(name("s")))).alias("checksum"))
    found = lookup.find_sources(wanted, files, repository, graph.checkpointed)
    return found.select(F.col("id").alias("doc_id"), "strategy", "origin", F.sha2("source", 256).alias("source_sha256"))


_NUMBERED = [v for v in _VERSIONS if v[0].isdigit()]


@query(f"""WITH c AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'lib/s' || p_partkey % 30 || '/app.jar!/in/' || f WHEN 1 THEN 'lib/s' || p_partkey % 30 || '/more/' || f WHEN 2 THEN 'lib/s' || p_partkey % 30 || '/app.jar' ELSE 'jdk/' || f END AS path,
  CASE p_partkey % 4 WHEN 2 THEN 'app' ELSE artifact END AS artifact, CASE p_partkey % 4 WHEN 2 THEN '' ELSE version END AS version, 'T/' || p_size AS type
  FROM (SELECT *, artifact || '-' || version || '.jar' AS f FROM (SELECT *, 'a' || p_partkey % 3 AS artifact, [{', '.join(f"'{v}'" for v in _NUMBERED)}][p_partkey % 12 + 1] AS version FROM part))),
w AS (SELECT DISTINCT 'lib/s' || l_suppkey % 30 || '/app.jar' AS archive, 'T/' || l_partkey % 60 AS type FROM lineitem),
m AS (SELECT w.*, c.path, k.level, row_number() OVER (PARTITION BY w.archive, w.type ORDER BY k.level, c.artifact, coalesce(list_position([{', '.join(f"'{v}'" for v in _ORDERED)}], c.version), 0) DESC, len(string_split(c.path, '/')), c.path) AS r
  FROM w LEFT JOIN (c CROSS JOIN (SELECT unnest(range(4)) AS level) k) ON c.type = w.type AND CASE k.level WHEN 0 THEN c.path = w.archive WHEN 1 THEN starts_with(c.path, w.archive || '!/')
    WHEN 2 THEN NOT contains(c.path, '!/') AND starts_with(c.path, regexp_extract(w.archive, '^(.*/)', 1)) ELSE starts_with(c.path, 'jdk/') END)
SELECT archive AS archive_path, type AS target_type, path AS container, ['own', 'nested', 'folder', 'platform'][level + 1] AS level FROM m WHERE r = 1""")
def types_resolved(spark, sf_dir):
    """The first container that has a type, for all references of all archives at once, and those that none has."""
    p, i = b.table(spark, sf_dir, "part"), F.col("p_partkey")
    version = F.element_at(F.array(*map(F.lit, _NUMBERED)), (i % 12 + 1).cast("int"))
    file = F.concat(F.lit("a"), i % 3, F.lit("-"), version, F.lit(".jar"))
    at = F.concat(F.lit("lib/s"), i % 30)
    path = F.when(i % 4 == 0, F.concat(at, F.lit("/app.jar!/in/"), file)).when(i % 4 == 1, F.concat(at, F.lit("/more/"), file)).when(i % 4 == 2, F.concat(at, F.lit("/app.jar"))).otherwise(F.concat(F.lit("jdk/"), file))
    classes = p.select(path.alias("archive_path"), F.concat(F.lit("T/"), "p_size").alias("internal_name"))
    wanted = b.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("lib/s"), F.col("l_suppkey") % 30, F.lit("/app.jar")).alias("archive_path"), F.concat(F.lit("T/"), F.col("l_partkey") % 60).alias("target_type")).distinct()
    return lookup.resolve_types(wanted, classes, platform=classes.where("archive_path like 'jdk/%'"))


@query("""WITH a AS (SELECT 'm' || p_partkey || '(La/b/T' || p_size || ';I)V' AS k, 'm' || p_partkey || '(LT' || p_size || ';I)V' AS r FROM part),
c AS (SELECT 'm' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '(La/b/T' WHEN 1 THEN '(LT' ELSE '(Lc/T' END || p_size || ';I)V' AS k, 'm' || p_partkey || '(LT' || p_size || ';I)V' AS r, p_partkey FROM part WHERE p_partkey % 4 < 3
  UNION ALL SELECT 'm' || p_partkey || '(Ld/T' || p_size || ';I)V', 'm' || p_partkey || '(LT' || p_size || ';I)V', p_partkey FROM part WHERE p_partkey % 8 = 2),
one AS (SELECT r FROM (SELECT r FROM c WHERE k NOT IN (SELECT k FROM a)) GROUP BY r HAVING count(*) = 1)
SELECT a.k AS "left", c.k AS "right", 'exact' AS how FROM a JOIN c ON a.k = c.k
UNION ALL SELECT a.k, c.k, 'relaxed' FROM a JOIN c ON a.r = c.r AND a.k <> c.k WHERE a.r IN (SELECT r FROM one)
UNION ALL SELECT a.k, NULL, NULL FROM a WHERE a.k NOT IN (SELECT k FROM c) AND a.r NOT IN (SELECT r FROM one)
UNION ALL SELECT NULL, c.k, NULL FROM c WHERE c.k NOT IN (SELECT k FROM a) AND c.r NOT IN (SELECT r FROM one)""")
def methods_matched(spark, sf_dir):
    """J13, TX22: methods of two versions by their exact key, and what is left by a key without packages where that tells them apart."""
    p, i = b.table(spark, sf_dir, "part"), F.col("p_partkey")
    key = lambda package: F.concat(F.lit("m"), i, F.lit("(L"), package, F.lit("T"), F.col("p_size"), F.lit(";I)V")).alias("key")
    before = p.select(key(F.lit("a/b/")))
    after = p.where("p_partkey % 4 < 3").select(key(F.when(i % 4 == 0, "a/b/").when(i % 4 == 1, "").otherwise("c/"))).union(p.where("p_partkey % 8 = 2").select(key(F.lit("d/"))))
    return lookup.relaxed_join(before, after, "key", fn.relaxed_key)


@query("""SELECT d.source, count(*) AS total, sum(len(string_split(d.text, chr(10)))) AS lines, max(len(string_split(d.text, chr(10)))) AS longest FROM documents d WHERE d.text IS NOT NULL GROUP BY d.source""")
def export_totals(spark, sf_dir):
    """Sums of array sizes and the largest line number, by archive."""
    lines = F.size(F.split("text", "\n", -1)).cast("long")
    return docs(spark, sf_dir).where("text is not null").groupBy("source").agg(F.count("*").alias("total"), F.sum(lines).alias("lines"), F.max(lines).alias("longest"))
