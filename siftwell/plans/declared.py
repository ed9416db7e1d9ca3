"""Queries of the source-parsing family. Their inputs are small sources in every language,
written here with what a reader finds in them, so the SQL states that as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import parse

Q: dict = {}
SQL: dict[str, str] = {}

#: (path, source, [(kind, qualified name, first line, last line)])
SOURCES: list[tuple[str, str, list[tuple[str, str, int, int]]]] = [
    ("a.py", "import os\n\n\nclass Box:\n    def put(self, x):\n        return os.path.join(x)\n\n\nasync def run():\n    pass\n", [("class", "Box", 4, 6), ("function", "Box.put", 5, 6), ("function", "run", 9, 10)]),
    ("a.js", "// Adds up.\nexport default function add(a, b) {\n  return a + b;\n}\nconst twice = (x) => {\n  return 2 * x;\n};\nclass Cart {\n  get total() {\n    return 1;\n  }\n}\n",
     [("function", "add", 2, 4), ("function", "twice", 5, 7), ("class", "Cart", 8, 12), ("method", "Cart.total", 9, 11)]),
    ("a.ts", "export interface Shape {\n  area: number;\n}\nconst make = function (a: number) {\n  return a;\n};\nclass Disk {\n  constructor(\n    private r: number,\n  ) {\n    this.r = r;\n  }\n}\n",
     [("class", "Shape", 1, 3), ("function", "make", 4, 6), ("class", "Disk", 7, 13), ("method", "Disk.constructor", 8, 12)]),
    ("a.java", "public class Bank {\n  @Override\n  public int sum(int a) {\n    return a;\n  }\n  private static String name(\n      int a) {\n    return \"}\";\n  }\n}\n", [("class", "Bank", 1, 10), ("method", "Bank.sum", 3, 5), ("method", "Bank.name", 6, 9)]),
    ("a.go", "type T struct {\n\ta int\n}\n\nfunc (t *T) Do(a int) error {\n\treturn nil\n}\n\nvar h = func(a int) {\n}\n", [("class", "T", 1, 3), ("method", "Do", 5, 7), ("function", "h", 9, 10)]),
    ("a.rs", "pub struct P {\n  x: i32,\n}\nimpl P {\n  pub fn name(&self) -> &'static str {\n    \"{\"\n  }\n}\n", [("class", "P", 1, 3), ("function", "name", 5, 7)]),
    ("a.c", "struct node {\n  int a;\n};\nint add(int a, int b) {\n  return a + b;\n}\nint later(int a);\n", [("class", "node", 1, 3), ("function", "add", 4, 6)]),
    ("a.cpp", "class Shape {\n  ~Shape() {\n  }\n};\nint Shape::area(int a) const {\n  return a;\n}\n", [("class", "Shape", 1, 4), ("method", "Shape.~Shape", 2, 3), ("method", "area", 5, 7)]),
    ("a.cs", "public record struct R {\n  public async Task<string> Render(int a) {\n    return \"\";\n  }\n}\n", [("class", "R", 1, 5), ("method", "R.Render", 2, 4)]),
    ("a.rb", "class A\n  def b?\n    1\n  end\nend\n", [("class", "A", 1, 5), ("method", "A.b?", 2, 4)]),
    ("a.php", "<?php\nclass A {\n  public static function go($a) {\n    return 1;\n  }\n}\nfunction plain($x) {\n}\n", [("class", "A", 2, 6), ("method", "A.go", 3, 5), ("function", "plain", 7, 8)]),
    ("a.swift", "public struct P {\n  public init?(a: Int) {\n  }\n  var area: Int {\n    return 1\n  }\n  var stored: Int = 2\n}\n", [("class", "P", 1, 8), ("method", "P.init", 2, 3), ("method", "P.area", 4, 6)]),
    ("a.kt", "data class A(val x: Int)\nfun String.toId(a: Int): Int {\n  return 1\n}\n", [("class", "A", 1, 4), ("function", "A.toId", 2, 4)]),
    ("a.scala", "object B {\n  def go(x: Int): Int = {\n    x\n  }\n}\n", [("class", "B", 1, 5), ("function", "B.go", 2, 4)]),
    ("a.sh", "function deploy-all {\n  cat <<EOF\nfake() {\nEOF\n}\nmy.fn() {\n  echo\n}\n", [("function", "deploy-all", 1, 5), ("function", "my.fn", 6, 8)]),
    ("b.py", "from . import tools\nimport json\n\nif json:\n    def readLines(path, *, strict=False):\n        \"\"\"Reads   all\n        lines.\"\"\"\n        return tools.open(path).read().strip() or len(path)\n",
     [("function", "readLines", 5, 8)]),
    ("bad.py", "def (\n", []),
]


def _rows() -> str:
    rows = [f"('{p}', '{parse.LANGUAGES['.' + p.split('.')[1]]}', '{k}', '{n}', {a}, {z})" for p, _, found in SOURCES for k, n, a, z in found]
    return ", ".join(rows)


def _parsed(s):
    # each source ten times over, as files of ten folders, so that several tasks parse
    files = s.createDataFrame([(f"{i}/{p}", bytearray(t.encode())) for i in range(10) for p, t, _ in SOURCES], "path string, content binary")
    return parse.parse_files(files.repartition(4, "path"))


def parsed_declarations(s, d):
    u = parse.units_of(_parsed(s))
    return u.select("path", "language", "kind", "qualified_name", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


def parse_diagnostics(s, d):
    return parse.diagnostics_of(_parsed(s)).select("path", "code", F.col("line").cast("long").alias("line"))


Q["parsed_declarations"] = parsed_declarations
SQL["parsed_declarations"] = f"SELECT i || '/' || path AS path, language, kind, qualified_name, CAST(a AS BIGINT) AS start_line, CAST(z AS BIGINT) AS end_line FROM (VALUES {_rows()}) v(path, language, kind, qualified_name, a, z), range(10) r(i)"
Q["parse_diagnostics"] = parse_diagnostics
SQL["parse_diagnostics"] = "SELECT i || '/bad.py' AS path, 'syntax_error' AS code, CAST(1 AS BIGINT) AS line FROM range(10) r(i)"


#: What the Python sources are described by, with their signatures.
_SAID = [
    ("a.py", "Box", "class Box:", "This class box. and calls os.path.join. using os."),
    ("a.py", "Box.put", "def put(self, x):", "This method put. accepts self, x. and calls os.path.join. using os."),
    ("a.py", "run", "async def run():", "This method run. using os."),
    ("b.py", "readLines", "def readLines(path, *, strict=False):", "This method read lines. accepts path. and calls len, tools.open, tools.open(path).read, tools.open(path).read().strip. using json, tools. Documented intent: Reads all lines.."),
]


def python_descriptions(s, d):
    return parse.units_of(_parsed(s)).where("language = 'python'").select("path", "qualified_name", "signature", "description")


Q["python_descriptions"] = python_descriptions
SQL["python_descriptions"] = "SELECT i || '/' || path AS path, qualified_name, signature, description FROM (VALUES " + ", ".join(str(x) for x in _SAID) + ") v(path, qualified_name, signature, description), range(10) r(i)"


# where documentation would go, were each unit described: in Python the first line of the
# body, elsewhere the declaration; ``add`` of a.js has a comment already
_BODY = {"Box": 5, "Box.put": 6, "run": 10}
_DOCUMENTED = {("a.js", "add"), ("b.py", "readLines")}


def promotion_plan(s, d):
    from siftwell.operators import describe as W

    files = s.createDataFrame([(p, bytearray(t.encode())) for p, t, _ in SOURCES], "path string, content binary")
    units = W.keyed(parse.units_of(parse.parse_files(files)).withColumnRenamed("description", "generated"))
    entries = units.select("unit_id", "hash", "code_hash", "path", F.col("qualified_name").alias("name"), F.lit("Says what it does.").alias("text"))
    plan = W.insertions(units, entries, files)
    return plan.select("path", F.col("line").cast("long").alias("line"), F.trim(F.array_join("lines", "\n")).alias("first"), F.size("lines").cast("long").alias("n_lines"))


def _plan_rows() -> str:
    from siftwell.sources.patch import comment

    rows = []
    for p, _, found in SOURCES:
        language = parse.LANGUAGES["." + p.split(".")[1]]
        for _, name, line, _ in found:
            if (p, name) in _DOCUMENTED:
                continue
            if language == "python":
                rows.append((p, _BODY[name], '"""Says what it does."""', 1))
            else:
                said = comment("Says what it does.", "", language)
                rows.append((p, line, "BLOCK" if len(said) == 3 else said[0], len(said)))
    return ", ".join(f"('{p}', {line}, '{x}', {n})" for p, line, x, n in rows)


Q["promotion_plan"] = lambda s, d: promotion_plan(s, d).withColumn("first", F.when(F.col("n_lines") == 3, "BLOCK").otherwise(F.col("first")))
SQL["promotion_plan"] = f"SELECT path, CAST(line AS BIGINT) AS line, first, CAST(n AS BIGINT) AS n_lines FROM (VALUES {_plan_rows()}) v(path, line, first, n)"
