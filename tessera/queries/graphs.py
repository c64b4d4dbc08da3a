"""Call graphs over edges that consecutive events of a day make between users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import call_graph as G
from tessera.operators import import_graph
from tessera.operators.chunking import code_chunks
from tessera.plans.dealing import dealt
from tessera.plans.ranking import with_next
from tessera.plans.staging import staged
from tessera.queries import collector, table
from tessera.sources import code

QUERIES, ORACLES, query = collector()

EDGES = "edges AS (SELECT ord, day, head_id, 'User ' || head_id AS head_label, tail_id, 'User ' || tail_id AS tail_label FROM (SELECT event_id AS ord, CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS head_id, CAST(lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS VARCHAR) AS tail_id FROM events) WHERE tail_id IS NOT NULL)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), day.alias("day"), "ts", F.col("user_id").cast("string").alias("head_id"))
    e = with_next(e, ["day"], ["ts", "ord"], "head_id", "tail_id", F.hour("ts") * 6 + F.floor(F.minute("ts") / 10)).where("tail_id is not null").select("ord", "day", "head_id", "tail_id")
    return e.withColumn("head_label", F.concat(F.lit("User "), "head_id")).withColumn("tail_label", F.concat(F.lit("User "), "tail_id"))


def bfs_sql(level: int) -> str:
    steps = ["f0 AS (SELECT id, min(path) AS path FROM (SELECT head_id AS id, [ord * 2] AS path FROM edges WHERE contains(lower(head_label), 'user 14') UNION ALL SELECT tail_id, [ord * 2 + 1] FROM edges WHERE contains(lower(tail_label), 'user 14')) GROUP BY id)"]
    for k in range(1, level + 1):
        steps.append(f"m{k} AS (SELECT {k} AS level, list_append(path, ord) AS path, ord, head_id, tail_id FROM edges JOIN f{k - 1} ON head_id = id)")
        steps.append(f"f{k} AS (SELECT tail_id AS id, min(path) AS path FROM m{k} GROUP BY tail_id)")
    union = " UNION ALL ".join(f"SELECT level, ord, head_id, tail_id, list_aggregate(path, 'string_agg', '.') AS path FROM m{k}" for k in range(1, level + 1))
    return f"WITH {EDGES}, {', '.join(steps)} {union}"


def bfs(level: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = edges(spark, sf_dir)
        found = G.search_calls(staged(e, "edges") if level > 2 else e, "USER 14", level)  # each step reads them
        return found.select("level", "ord", "head_id", "tail_id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))

    return run


for _level in (1, 2, 3):
    query(f"bfs_calls_l{_level}", bfs_sql(_level))(bfs(_level))

HEAD = "'digraph G {' || chr(10) || 'rankdir=LR;node [\"fillcolor\"=\"#eeeeee\",\"style\"=\"filled,rounded\",\"shape\"=\"rect\",]' || chr(10)"


@query(
    "call_dot",
    f"""WITH {EDGES}, s AS (SELECT day, head_id AS id, head_label AS label, ord * 2 AS o FROM edges UNION ALL SELECT day, tail_id, tail_label, ord * 2 + 1 FROM edges),
 n AS (SELECT day, id, arg_min(label, o) AS label, min(o) AS o FROM s GROUP BY day, id), a AS (SELECT day, string_agg('"' || id || '" ["label"="' || label || '"]', chr(10) ORDER BY o) AS nodes FROM n GROUP BY day),
 b AS (SELECT day, string_agg('"' || head_id || '" -> "' || tail_id || '"', chr(10) ORDER BY ord) AS lines FROM edges GROUP BY day)
 SELECT CAST(a.day AS VARCHAR) AS day, {HEAD} || nodes || chr(10) || lines || chr(10) || '}}' AS dot FROM a JOIN b ON a.day = b.day""",
)
def call_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graph for each day."""
    return G.dot(edges(spark, sf_dir), ["ord"], ["day"]).withColumn("day", F.col("day").cast("string"))


@query("code_mapping", f"WITH {EDGES} SELECT id, arg_min(label, o) AS label FROM (SELECT head_id AS id, head_label AS label, ord * 2 AS o FROM edges UNION ALL SELECT tail_id, tail_label, ord * 2 + 1 FROM edges) GROUP BY id")
def code_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.code_mapping(edges(spark, sf_dir))


@query(
    "enclosing_interval",
    """WITH d AS (SELECT o_custkey AS file, 'o' || o_orderkey AS name, o_orderkey % 2000 AS start, o_orderkey % 2000 + 1 + o_orderkey % 700 AS stop FROM orders), c AS (SELECT o_custkey AS file, o_orderkey AS call_id, (o_orderkey * 7) % 2500 AS pos FROM orders),
 m AS (SELECT c.call_id, d.name, row_number() OVER (PARTITION BY c.call_id ORDER BY d.start DESC, d.stop, d.name DESC) AS k FROM c JOIN d ON c.file = d.file AND d.start <= c.pos AND c.pos < d.stop)
 SELECT c.call_id, m.name AS enclosing FROM c LEFT JOIN m ON c.call_id = m.call_id AND m.k = 1""",
)
def enclosing_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as definitions and calls of a file."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    defs = o.select(F.col("o_custkey").alias("file"), F.concat(F.lit("o"), key.cast("string")).alias("name"), (key % 2000).alias("start"), (key % 2000 + 1 + key % 700).alias("stop"))
    calls = o.select(F.col("o_custkey").alias("file"), key.alias("call_id"), ((key * 7) % 2500).alias("pos"))
    return G.enclosing(calls, defs).select("call_id", "enclosing")


FILES = [("src/a.ts",), ("src/a.js",), ("src/lib/b.js",), ("c.ts",)]
IMPORTS = [("src/x.ts", "./a"), ("src/x.ts", "./lib/b"), ("src/lib/y.ts", "../../c"), ("src/x.ts", "react"), ("src/x.ts", "./none")]


@query("module_resolve", "SELECT * FROM (VALUES ('src/x.ts', './a', 'src/a.ts'), ('src/x.ts', './lib/b', 'src/lib/b.js'), ('src/lib/y.ts', '../../c', 'c.ts'), ('src/x.ts', 'react', NULL), ('src/x.ts', './none', NULL)) t(file, module, resolved)")
def module_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolved_modules(spark.createDataFrame(IMPORTS, "file string, module string"), spark.createDataFrame(FILES, "path string"))


IMPORTED = "i AS (SELECT o_custkey AS file, o_orderkey // 10 AS target FROM orders)"


@query(
    "import_scope",
    f"""WITH RECURSIVE {IMPORTED}, r AS (SELECT min(file) AS file FROM i UNION SELECT target FROM r JOIN i ON r.file = i.file)
 SELECT r.file, count(i.target) AS imports FROM r LEFT JOIN i ON r.file = i.file GROUP BY r.file""",
)
def import_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files and their orders as imports, which make cycles: the files that the first one reaches, with their imports."""
    imports = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.floor(F.col("o_orderkey") / 10).alias("target"))
    scope = import_graph.reached(imports.agg(F.min("file").alias("entry")), imports)
    counted = import_graph.in_scope(imports, scope).groupBy("file").agg(F.count("target").alias("imports"))
    return scope.select("file").join(counted, "file", "left").select("file", F.coalesce("imports", F.lit(0)).alias("imports"))


PASSED = "CASE o_orderkey % 10 WHEN 0 THEN o_orderkey + 1 WHEN 1 THEN o_orderkey - 1 ELSE o_orderkey // 2 END"


@query(
    "passed_names",
    f"""WITH RECURSIVE o AS (SELECT o_orderkey AS file, o_orderstatus = 'F' AS own, {PASSED} AS target FROM orders),
 r AS (SELECT file, file AS at FROM o UNION SELECT r.file, o.target FROM r JOIN o ON r.at = o.file WHERE NOT own),
 d AS (SELECT r.file, r.at FROM r JOIN o ON r.at = o.file WHERE own)
 SELECT o.file, d.at AS def_file, CASE WHEN d.at IS NOT NULL THEN 'n' || d.at END AS def_name FROM o LEFT JOIN d ON o.file = d.file""",
)
def passed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files that export a name: finished ones define it, the others pass it on, some in circles."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("name"), "o_orderstatus", F.expr(PASSED.replace("o_orderkey // 2", "o_orderkey div 2")).alias("target"))
    passed = o.withColumn("target_name", F.concat(F.lit("n"), F.col("target").cast("string")))
    return import_graph.defined_at(passed.where("o_orderstatus <> 'F'"), o.where("o_orderstatus = 'F'")).select("file", "def_file", "def_name")


PYTHON = "class A:\n    def __init__(self):\n        self.b()\n\n    def b(self):\n        return f(1)\n\n\ndef f(x):\n    return x\n"
SCRIPT = "class B {\n  constructor(x) { this.go(); }\n  go() { g(1); }\n}\nfunction g(a) { return h(a); }\nconst h = (a) => { return a; };\n"


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a.py", ".py", PYTHON), ("b.ts", ".ts", SCRIPT), ("c.rb", ".rb", "def x; end"), ("n.py", ".py", None)], "source string, suffix string, content string")


@query("code_defs", "SELECT * FROM (VALUES ('a.py', 'Class', 'A', 1), ('a.py', 'Constructor', 'A.__init__', 2), ('a.py', 'Method', 'A.b', 5), ('a.py', 'Function', 'f', 9), ('b.ts', 'Class', 'B', 1), ('b.ts', 'Constructor', 'B.constructor', 2), ('b.ts', 'Method', 'B.go', 3), ('b.ts', 'Function', 'g', 5), ('b.ts', 'Function', 'h', 6), ('c.rb', 'Function', 'x', 1)) t(filepath, type, name, line)")
def code_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.code_definitions(sources(spark)).select("filepath", "type", "name", F.col("start.line").alias("line"))


@query("code_calls", "SELECT * FROM (VALUES ('a.py', 'A.__init__', 'A.b'), ('a.py', 'A.b', 'f'), ('b.ts', 'B.constructor', 'B.go'), ('b.ts', 'B.go', 'g'), ('b.ts', 'g', 'h')) t(filepath, head_label, tail_label)")
def code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.code_calls(sources(spark)).select("filepath", "head_label", "tail_label")


#: A file of each language for every part, by its key modulo their number: ~ stands for the key.
TEMPLATES = [
    (".py", "# part ~\nimport os\n\n@cache\ndef a~(x):\n    return b~(x)\n\n\nclass K~:\n    def m~(self):\n        return a~(1)\n\n\ndef b~(x):\n    return x\n"),
    (".js", "// part ~\nclass K~ {\n  static m~() { return a~('b~('); }\n}\nfunction a~(x = {y: 1}) { return b~(x); }\nconst b~ = (x) => x;\n"),
    (".ts", "import { z } from './z';\nexport class K~<T> {\n  m~(x: T): void { a~(x); }\n}\nexport function a~(x: {y: number}): number { return b~(x); }\nconst b~ = async (x: number): Promise<number> => { return z(x); };\n"),
    (".java", "package p;\npublic class K~ {\n  K~(int x) { a~(x); }\n  /* int no() { } */\n  int a~(int x) throws E { if (x > 0) { return b~(x); } return 0; }\n  static int b~(int x) { return x; }\n}\n"),
    (".cs", "#region x\nnamespace N {\n  class K~ : Q {\n    public K~(int x) : base(x) { a~(x); }\n    int a~(int x) { return b~(x); }\n    int b~(int x) { return x; }\n  }\n}\n"),
    (".cpp", "#include <p>\nint b~(int x) { return x; }\nint K~::m~(int x) const { return b~(x); }\nint a~(int x) { return b~(x); }\n"),
    (".go", "package p\n\ntype K~ struct {\n\tx int\n}\n\nfunc (k *K~) m~(x int) int { return a~(x) }\n\nfunc a~(x int) int {\n\treturn b~(x)\n}\n\nfunc b~(x int) int { return x }\n"),
    (".php", "<?php\n// part ~\nclass K~ {\n  public function m~($x) { return a~($x); }\n}\nfunction a~($x) { return b~($x); }\nfunction b~($x) { return $x; }\n"),
    (".rb", "# part ~\nclass K~\n  def m~(x)\n    if x\n      a~(x)\n    end\n  end\nend\ndef a~(x)\n  b~(x)\nend\ndef b~(x)\n  x\nend\n"),
]
#: What they define (kind, name, line), and the calls inside them.
DEFINED = [
    [("Function", "a~", 5), ("Class", "K~", 9), ("Method", "K~.m~", 10), ("Function", "b~", 14)],
    [("Class", "K~", 2), ("Method", "K~.static.m~", 3), ("Function", "a~", 5), ("Function", "b~", 6)],
    [("Class", "K~", 2), ("Method", "K~.m~", 3), ("Function", "a~", 5), ("Function", "b~", 6)],
    [("Class", "K~", 2), ("Constructor", "K~.K~", 3), ("Method", "K~.a~", 5), ("Method", "K~.b~", 6)],
    [("Class", "K~", 3), ("Constructor", "K~.K~", 4), ("Method", "K~.a~", 5), ("Method", "K~.b~", 6)],
    [("Function", "b~", 2), ("Method", "K~.m~", 3), ("Function", "a~", 4)],
    [("Class", "K~", 3), ("Method", "K~.m~", 7), ("Function", "a~", 9), ("Function", "b~", 13)],
    [("Class", "K~", 3), ("Method", "K~.m~", 4), ("Function", "a~", 6), ("Function", "b~", 7)],
    [("Class", "K~", 2), ("Method", "K~.m~", 3), ("Function", "a~", 9), ("Function", "b~", 12)],
]
CALLED = [
    [("a~", "b~"), ("K~.m~", "a~")], [("K~.static.m~", "a~"), ("a~", "b~")], [("K~.m~", "a~"), ("a~", "b~")], [("K~.K~", "K~.a~"), ("K~.a~", "K~.b~")], [("K~.K~", "K~.a~"), ("K~.a~", "K~.b~")],
    [("K~.m~", "b~"), ("a~", "b~")], [("K~.m~", "a~"), ("a~", "b~")], [("K~.m~", "a~"), ("a~", "b~")], [("K~.m~", "a~"), ("a~", "b~")],
]


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (source, suffix, content): one file for each part."""
    n, key = len(TEMPLATES), F.col("p_partkey").cast("string")
    pick = lambda i: F.element_at(F.array(*(F.lit(t[i]) for t in TEMPLATES)), (F.col("p_partkey") % n).cast("int") + 1)
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return parts.select(F.concat(F.lit("f"), key, pick(0)).alias("source"), pick(0).alias("suffix"), F.replace(pick(1), F.lit("~"), key).alias("content"))


def of_parts(rows: list[list[tuple]], columns: str, select: str) -> str:
    values = ", ".join(f"({k}, '{TEMPLATES[k][0]}', " + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for k, own in enumerate(rows) for r in own)
    return f"SELECT 'f' || p_partkey || suffix AS filepath, {select} FROM part JOIN (VALUES {values}) t(k, suffix, {columns}) ON p_partkey % {len(rows)} = k"


KEYED = "replace({0}, '~', CAST(p_partkey AS VARCHAR)) AS {0}"


@query("code_defs_by_language", of_parts(DEFINED, "type, name, line", f"type, {KEYED.format('name')}, CAST(line AS INT) AS line"))
def code_defs_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.code_definitions(generated(spark, sf_dir)).select("filepath", "type", "name", F.col("start.line").alias("line"))


@query("code_calls_by_language", of_parts(CALLED, "head_label, tail_label", f"{KEYED.format('head_label')}, {KEYED.format('tail_label')}"))
def code_calls_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.code_calls(generated(spark, sf_dir)).select("filepath", "head_label", "tail_label")


@query("code_places", of_parts([[d for d in own if d[0] != "Class"] for own in DEFINED], "type, label, line", f"{KEYED.format('label')}, CAST(line AS BIGINT) AS line"))
def code_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the nodes of a call graph stand."""
    return code.node_places(generated(spark, sf_dir)).select("filepath", "label", "line")


@query(
    "cross_file_calls",
    """SELECT 's' || s_suppkey || '/a.ts' AS filepath, 'go' AS head_label, unnest(['run', 'walk', 'rest']) AS tail_label, unnest(['s' || s_suppkey || '/lib/b.ts', 's' || s_suppkey || '/lib/b.ts', 's' || s_suppkey || '/c.js']) AS target FROM supplier""",
)
def cross_file_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files for each supplier: calls of an imported name, of one that has another name here, and behind a module's name."""
    contents = {
        "a.ts": "import { run, walk as stroll } from './lib/b';\nimport * as c from './c';\nimport { run as none } from 'react';\nfunction go() { run(1); stroll(2); c.rest(3); none(4); c.missing(5); own(6); }\nfunction own(x) { return x; }\n",
        "lib/b.ts": "export function run(x) { return x; }\nexport const walk = (x) => x;\nfunction own(x) { return x; }\n", "c.js": "export function rest(x) { return x; }\n",
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("content")) for k, v in contents.items())))
    rows = dealt(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", each.alias("f"))
    rows = rows.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("/"), F.col("f.name")).alias("source"), F.regexp_extract("f.name", r"(\.\w+)$", 1).alias("suffix"), F.col("f.content").alias("content"))
    found = code.cross_file_calls(rows)
    return found.select("filepath", "head_label", "tail_label", F.url_decode(F.regexp_extract("tail_id", "^([^/]*)/", 1)).alias("target"))


#: The top-level pieces of each file, comments included.
PIECES = [
    ["# part ~", "import os", "@cache\ndef a~(x):\n    return b~(x)", "class K~:\n    def m~(self):\n        return a~(1)", "def b~(x):\n    return x"],
    ["// part ~", "class K~ {\n  static m~() { return a~('b~('); }\n}", "function a~(x = {y: 1}) { return b~(x); }", "const b~ = (x) => x;"],
    ["import { z } from './z';", "export class K~<T> {\n  m~(x: T): void { a~(x); }\n}", "export function a~(x: {y: number}): number { return b~(x); }", "const b~ = async (x: number): Promise<number> => { return z(x); };"],
    ["package p;", "public class K~ {\n  K~(int x) { a~(x); }\n  /* int no() { } */\n  int a~(int x) throws E { if (x > 0) { return b~(x); } return 0; }\n  static int b~(int x) { return x; }\n}"],
    ["#region x", "namespace N {\n  class K~ : Q {\n    public K~(int x) : base(x) { a~(x); }\n    int a~(int x) { return b~(x); }\n    int b~(int x) { return x; }\n  }\n}"],
    ["#include <p>", "int b~(int x) { return x; }", "int K~::m~(int x) const { return b~(x); }", "int a~(int x) { return b~(x); }"],
    ["package p", "type K~ struct {\n\tx int\n}", "func (k *K~) m~(x int) int { return a~(x) }", "func a~(x int) int {\n\treturn b~(x)\n}", "func b~(x int) int { return x }"],
    ["<?php", "// part ~", "class K~ {\n  public function m~($x) { return a~($x); }\n}", "function a~($x) { return b~($x); }", "function b~($x) { return $x; }"],
    ["# part ~", "class K~\n  def m~(x)\n    if x\n      a~(x)\n    end\n  end\nend", "def a~(x)\n  b~(x)\nend", "def b~(x)\n  x\nend"],
]


@query("code_chunks", of_parts([[("\n" + "\n".join(own).replace("'", "''"),)] for own in PIECES], "page_content", f"CAST(0 AS INT) AS chunk_no, {KEYED.format('page_content')}").replace("AS filepath", "AS source"))
def code_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level pieces of files of all languages, each file small enough for one chunk."""
    return code_chunks(generated(spark, sf_dir), code.top_level_parts)
