"""Source files made of the rows of supplier, eight languages in turn, and what must be found in them.

A row i is a file of language i % 8 in project i / 48. It imports the file of row i + 8, which is there or not, and names
from outside. Templates and expectations are texts in which {i}, {j}, {k} and {file} stand for i, i + 8, i + 16 and the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEP, APART = 8, 48

#: language, path, text
FILES = [
    ("python", "{folder}/m{i}.py", 'import os\nfrom pkg.m{j} import f{j}\nfrom .m{k} import g\n\n\nclass C{i}(Base):\n    """Holds {i}."""\n\n    def run(self, n: int) -> str:\n        return n\n\n\ndef f{i}(a, b=1):\n    # TODO: finish {i}\n    pass\n\n\ndef stub{i}():\n    raise NotImplementedError\n'),
    ("javascript", "web/m{i}.js", "import { a } from './m{j}';\nconst x = require('lib');\n\nexport class K{i} {\n  go(x) {\n    return x;\n  }\n}\n\nfunction f{i}(a, b) {\n  return a;\n}\n"),
    ("go", "cmd/m{i}.go", 'package main\n\nimport (\n\t"fmt"\n\t"cmd"\n)\n\ntype T{i} struct {\n\tx int\n}\n\nfunc (t *T{i}) Run(n int) Result {\n\treturn n\n}\n'),
    ("ruby", "lib/m{i}.rb", "require 'json'\nrequire_relative 'm{j}'\n\nmodule M{i}\n  class A\n    def go(x)\n      x\n    end\n  end\nend\n"),
    ("java", "src/main/java/a/M{i}.java", "package a;\n\nimport a.M{j};\nimport java.util.List;\n\npublic class M{i} extends Base {\n    int go(int x) {\n        return x;\n    }\n}\n"),
    ("rust", "src/m{i}.rs", "mod m{j};\n\npub struct S{i} {\n    x: i32,\n}\n\npub fn go{i}(x: i32) -> i32 {\n    x\n}\n"),
    ("elixir", "lib/app/m{i}.ex", "defmodule App.M{i} do\n  alias App.M{j}\n  alias Other.{A, B}\n\n  def go(x) do\n    x\n  end\nend\n"),
    ("hcl", "infra/m{i}/main.tf", 'module "next" {\n  source = "../m{j}"\n}\n\nvariable "v{i}" {\n  default = 1\n}\n'),
]
#: Of each language: chunk type, name, first line, last line, parent, sentence, description.
CHUNKS = [
    [
        ("module", "m{i}", 1, 20, "", "Module m{i} in file {file}. Language: python. Imports: import os, from pkg.m{j} import f{j}, from .m{k} import g.", None),
        ("class", "C{i}", 6, 10, "", "Class C{i}. Extends: Base. Holds {i}.", "Extends: Base"),
        ("function", "run", 9, 10, "C{i}", "Function run in C{i}. Parameters: self, n. Returns: str.", "implements run"),
        ("function", "f{i}", 13, 15, "", "Function f{i}. Parameters: a, b=1.  TODO: finish {i}", "TODO: finish {i}"),
        ("function", "stub{i}", 18, 19, "", "Function stub{i}.", "implements stub{i}"),
    ],
    [
        ("module", "m{i}", 1, 13, "", "Module m{i} in file {file}. Language: javascript. Imports: import { a } from './m{j}';.", None),
        ("class", "K{i}", 4, 8, "", "Class K{i}.", "implements K{i}"),
        ("method", "go", 5, 7, "K{i}", "Method go of class K{i}. Parameters: x.", "implements go"),
        ("function", "f{i}", 10, 12, "", "Function f{i}. Parameters: a, b.", "implements f{i}"),
    ],
    [
        ("module", "m{i}", 1, 15, "", "Module m{i} in file {file}. Language: go. Imports: import (.", None),
        ("class", "T{i}", 8, 10, "", "Class T{i}.", "implements T{i}"),
        ("method", "Run", 12, 14, "", "Method Run of class unknown class. Parameters: t *T{i}. Returns: Result.", "implements Run"),
    ],
    [
        ("module", "m{i}", 1, 11, "", "Module m{i} in file {file}. Language: ruby.", None),
        ("class", "M{i}", 4, 10, "", "Class M{i}.", "implements M{i}"),
        ("class", "A", 5, 9, "M{i}", "Class A.", "implements A"),
        ("method", "go", 6, 8, "A", "Method go of class A. Parameters: x.", "implements go"),
    ],
    [
        ("module", "M{i}", 1, 11, "", "Module M{i} in file {file}. Language: java. Imports: import a.M{j};, import java.util.List;.", None),
        ("class", "M{i}", 6, 10, "", "Class M{i}. Extends: Base.", "Extends: Base"),
        ("method", "go", 7, 9, "M{i}", "Method go of class M{i}. Parameters: int x.", "implements go"),
    ],
    [
        ("module", "m{i}", 1, 10, "", "Module m{i} in file {file}. Language: rust.", None),
        ("class", "S{i}", 3, 5, "", "Class S{i}.", "implements S{i}"),
        ("function", "go{i}", 7, 9, "", "Function go{i}. Parameters: x: i32. Returns: i32 {.", "implements go{i}"),
    ],
    [
        ("module", "m{i}", 1, 9, "", "Module m{i} in file {file}. Language: elixir.", None),
        ("class", "App.M{i}", 1, 8, "", "Class App.M{i}.", "M{i}"),
        ("function", "go", 5, 7, "App.M{i}", "Function go in App.M{i}. Parameters: x.", "M{i}"),
    ],
    [
        ("module", "main", 1, 8, "", "Module main in file {file}. Language: hcl.", None),
        ("class", "next", 1, 3, "", "Class next.", "implements next"),
        ("function", "v{i}", 5, 7, "", "Function v{i}.", "implements v{i}"),
    ],
]
#: Of each language: name, where it leads if the row of {j} ({k}) is there, and which row must be; no row: always.
IMPORTS = [
    [("os", None, None), ("pkg.m{j}", "pkg/m{j}.py", "j"), (".m{k}", "{folder}/m{k}.py", "k")],
    [("./m{j}", "web/m{j}.js", "j"), ("lib", None, None)],
    [("fmt", None, None), ("cmd", "cmd", "")],
    [("json", None, None), ("m{j}", "lib/m{j}.rb", "j")],
    [("a.M{j}", "src/main/java/a/M{j}.java", "j"), ("java.util.List", None, None)],
    [("m{j}", "src/m{j}.rs", "j")],
    [("App.M{j}", "lib/app/m{j}.ex", "j"), ("Other.A", None, None), ("Other.B", None, None)],
    [("../m{j}", "infra/m{j}", "j")],
]
#: Of each language the windows of four lines, one shared, in gaps of five lines or more between symbols.
GAPS = [[(1, 4), (4, 5)], [], [(1, 4), (4, 7)], [], [(1, 4), (4, 5)], [], [], []]


def filled(template: str, path: str = "file") -> Column:
    """The template as a column over i (and folder, file)."""
    out: Column = F.lit(template)
    for name, value in (("{i}", F.col("i")), ("{j}", F.col("i") + STEP), ("{k}", F.col("i") + 2 * STEP)):
        if name in template:
            out = F.replace(out, F.lit(name), value.cast("string"))
    return F.replace(out, F.lit("{folder}"), F.col("folder")) if "{folder}" in template else out


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """project, path, file_path, language, text."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("i"))
    s = s.withColumn("folder", F.when(F.col("i") % 16 == 0, "tests").otherwise("pkg")).withColumn("project", F.concat(F.lit("p"), F.floor(F.col("i") / APART).cast("string")))
    kinds = [F.struct(F.lit(lang).alias("language"), filled(path).alias("path"), filled(text).alias("text")) for lang, path, text in FILES]
    s = s.withColumn("x", F.element_at(F.array(*kinds), (F.col("i") % 8 + 1).cast("int"))).select("project", "x.*")
    return s.withColumn("file_path", F.concat_ws("/", F.lit(""), "project", "path"))


def _sql(template: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, value in (("{i}", "i"), ("{j}", f"(i + {STEP})"), ("{k}", f"(i + {2 * STEP})"), ("{folder}", "folder"), ("{file}", "file_path")):
        out = out.replace(name, f"' || {value} || '")
    return f"({out})"


_ROWS = f"s AS (SELECT s_suppkey AS i, CASE WHEN s_suppkey % 16 = 0 THEN 'tests' ELSE 'pkg' END AS folder, 'p' || CAST(floor(s_suppkey / {APART}) AS INTEGER) AS project FROM supplier)"


def _each(rows: list[list], make) -> str:
    """All rows of all languages as one union; make gives the columns of one."""
    parts = []
    for n, some in enumerate(rows):
        lang, path, _ = FILES[n]
        parts += [f"SELECT {make(lang, x)} FROM (SELECT *, '/' || project || '/' || {_sql(path)} AS file_path FROM s) WHERE i % 8 = {n}" for x in some]
    return " UNION ALL ".join(parts)


def chunks_sql() -> str:
    key = "CASE WHEN chunk_type = 'module' THEN '__module__::0' ELSE name || '::' || (start_line - 1) END"
    return f"WITH {_ROWS}, c AS ({_each(CHUNKS, lambda lang, x: f"file_path, '{lang}' AS language, '{x[0]}' AS chunk_type, {_sql(x[1])} AS name, {x[2]} AS start_line, {x[3]} AS end_line, {_sql(x[4])} AS parent_name, {_sql(x[5])} AS semantic_text")}) SELECT substr(sha256(file_path || '::' || {key}), 1, 16) AS id, * FROM c"


def descriptions_sql() -> str:
    rows = [[x for x in some if x[6]] for some in CHUNKS]
    return f"WITH {_ROWS} {_each(rows, lambda lang, x: f"file_path, {_sql(x[1])} AS name, {x[2]} AS start_line, {_sql(x[6])} AS description")}"


def imports_sql() -> str:
    def make(lang: str, x: tuple) -> str:
        name, to, row = x
        there = "false" if to is None else "true" if row == "" else f"EXISTS (SELECT 1 FROM s t WHERE t.i = o.i + {STEP if row == 'j' else 2 * STEP} AND t.project = o.project" + (" AND t.folder = 'pkg'" if name.startswith("pkg.") else "") + ")"
        return f"project, {_sql(FILES[[f[0] for f in FILES].index(lang)][1])} AS src, {_sql(name)} AS import_name, {there} AS resolved, CASE WHEN {there} THEN {_sql(to or name)} ELSE {_sql(name)} END AS dst"

    parts = [f"SELECT {make(FILES[n][0], x)} FROM s o WHERE i % 8 = {n}" for n, some in enumerate(IMPORTS) for x in some]
    return f"WITH {_ROWS} " + " UNION ALL ".join(parts)


def windows_sql() -> str:
    return f"WITH {_ROWS} {_each(GAPS, lambda lang, x: f"file_path, CAST({x[0]} AS INTEGER) AS start_line, CAST({x[1]} AS INTEGER) AS end_line")}"


def status_sql() -> str:
    """Three markers and one stub in each Python file; a file is a test's where it stands in tests/."""
    return f"WITH {_ROWS} SELECT project, CAST(3 * sum(CASE WHEN i % 8 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS todo_count, CAST(sum(CASE WHEN i % 8 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS stub_count, count(*) AS source_files, round(sum(CASE WHEN i % 16 = 0 THEN 1.0 ELSE 0.0 END) / count(*), 2) AS ratio, CASE WHEN 3 * sum(CASE WHEN i % 8 = 0 THEN 1 ELSE 0 END) > 20 OR sum(CASE WHEN i % 8 = 0 THEN 1 ELSE 0 END) > 5 THEN 'needs-attention' ELSE 'good' END AS health FROM s GROUP BY project"
