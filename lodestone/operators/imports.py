"""Import edges between source files: what files name, and the files that these names mean.

Names are taken by patterns, language by language. Each gives the places where its file may be, in order; places are
joined with the files there are, and the first that exists is the edge's end. A name that means none stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.parsing.symbols import Masked
from lodestone.session import ship

# The patterns of imports.
_PYTHON = r"(?m)^(?:from\s+([.\w]+)\s+import|import[ \t]+([\w.]+(?:[ \t]*,[ \t]*[\w.]+)*))"
_SCRIPT = r"(?s)(?:import\s+.*?\s+from\s+|require\s*\(\s*)['\"]([^'\"]+)['\"]"
_GO_BLOCK, _GO_ONE = r"import\s*\(([^)]+)\)", r'(?m)^import\s+"([^"]+)"'
_RUST, _JAVA = r"(?m)^mod\s+(\w+);", r"(?m)^import\s+([\w.]+);"
_RUBY = r"(?m)^\s*(require_relative|require)\s+['\"]([^'\"]+)['\"]"
_ELIXIR = r"(?m)^\s*(?:alias|import|require|use)\s+([\w.]+(?:\{[\w,\s]+\})?)"
_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")
SCRIPTS = ("javascript", "typescript", "tsx")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def snake(name: Column) -> Column:
    """Camel case as snake case."""
    return F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_"))


def without_comment_lines(text: Column, markers: str = "#") -> Column:
    """Lines that are comments as blanks of the same length."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(rf"^\s*(?:{markers})"), F.repeat(F.lit(" "), F.char_length(x))).otherwise(x)), "\n")


def specs(language: Column, text: Column) -> Column:
    """What a file imports, in order: an array of kind and spec. HCL has a function of its own, C and C++ have none."""
    plain = lambda found, kind="": F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("spec")))
    python = F.flatten(F.zip_with(_all(text, _PYTHON), _all(text, _PYTHON, 2), lambda a, b: F.when(a != "", F.array(a)).otherwise(F.transform(F.split(b, ","), lambda x: F.trim(x)))))
    go = F.concat(F.flatten(F.transform(_all(text, _GO_BLOCK), lambda b: _all(b, '"([^"]+)"'))), _all(text, _GO_ONE))
    ruby = F.zip_with(_all(text, _RUBY), _all(text, _RUBY, 2), lambda k, x: F.struct(k.alias("kind"), x.alias("spec")))
    said = _all(without_comment_lines(text), _ELIXIR)
    names = lambda x: F.transform(F.split(F.regexp_extract(x, r"\{([^}]*)\}", 1), ","), lambda n: F.concat(F.regexp_extract(x, r"^(.*)\.\{", 1), F.lit("."), F.trim(F.regexp_replace(n, r"\s+", " "))))
    elixir = F.flatten(F.transform(said, lambda x: F.when(x.contains(".{"), names(x)).otherwise(F.array(x))))
    none = F.array().cast("array<struct<kind:string,spec:string>>")
    return (
        F.when(language == "python", plain(python))
        .when(language.isin(*SCRIPTS), plain(_all(text, _SCRIPT)))
        .when(language == "go", plain(go))
        .when(language == "rust", plain(_all(text, _RUST)))
        .when(language == "java", plain(_all(text, _JAVA)))
        .when(language == "ruby", ruby)
        .when(language == "elixir", plain(elixir))
        .otherwise(none)
    )


def _module_sources(text: str) -> list[str]:
    """The sources of a Terraform file's modules: inside each module's braces the first line that sets one."""
    import re

    m = Masked(text, "hcl")
    lines = "".join(" " * len(x.rstrip("\n")) + x[len(x.rstrip("\n")) :] if x.lstrip().startswith(("#", "//")) else x for x in text.splitlines(keepends=True))
    out = []
    for x in re.finditer(r'module\s+"[^"]+"\s*\{', lines):
        body = x.end() - 1
        end = m.close.get(body, len(lines))
        if source := re.search(r'^\s*source\s*=\s*"([^"]+)"', lines[body + 1 : end], re.MULTILINE):
            out.append(source[1])
    return out


def import_specs(files: DataFrame) -> DataFrame:
    """project, src (path below the project), language, kind, spec: each import of files (project, path, language, text)."""
    rows = files.filter("text IS NOT NULL").select("project", F.col("path").alias("src"), "language", "text")
    got = rows.filter("language <> 'hcl'").select("project", "src", "language", F.explode(specs(F.col("language"), F.col("text"))).alias("x")).select("project", "src", "language", "x.kind", "x.spec")
    ship(files.sparkSession)
    schema = pa.schema([(n, pa.string()) for n in ("project", "src", "language", "kind", "spec")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, s, "hcl", "", x) for p, s, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for x in _module_sources(t)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], schema=schema)

    blocks = rows.filter("language = 'hcl'").select("project", "src", "text").mapInArrow(run, "project string, src string, language string, kind string, spec string")
    return got.unionByName(blocks)


def normal(path: Column) -> Column:
    """A path without empty, . and .. parts; null where it would leave the project."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.lit(None))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _candidates() -> Column:
    """The places where a spec's file may be, below the project, in order."""
    lang, spec, src = F.col("language"), F.col("spec"), F.col("src")
    here = F.regexp_replace(src, "[^/]*$", "")  # the folder, with its stroke
    dotted = F.regexp_replace(spec, r"\.", "/")
    dots = F.char_length(F.regexp_extract(spec, r"^(\.*)", 1))
    named = F.regexp_replace(F.regexp_replace(spec, r"^\.+", ""), r"\.", "/")
    base = F.concat(here, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))))
    relative = F.when(named == "", F.array(F.concat(base, F.lit("__init__.py")))).otherwise(F.array(F.concat(base, named, F.lit(".py")), F.concat(base, named, F.lit("/__init__.py"))))
    python = F.when(dots > 0, relative).otherwise(F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py"))))
    script = F.when(spec.startswith("."), F.array(*[F.concat(here, spec, F.lit(x)) for x in _SUFFIXES])).otherwise(F.array().cast("array<string>"))
    root = F.when(F.col("kind") == "require_relative", here).otherwise(F.lit(""))
    ruby = F.array(F.concat(root, F.regexp_replace(spec, r"(?<=[^/])\.[^./]+$", ""), F.lit(".rb")), F.concat(root, F.lit("lib/"), spec, F.lit(".rb")))
    module = F.concat(F.lit("lib/"), F.array_join(F.transform(F.split(spec, r"\."), snake), "/"), F.lit(".ex"))
    places = (
        F.when(lang == "python", python)
        .when(lang.isin(*SCRIPTS), script)
        .when(lang == "go", F.array(spec))
        .when(lang == "rust", F.array(F.concat(here, spec, F.lit(".rs")), F.concat(here, spec, F.lit("/mod.rs"))))
        .when(lang == "java", F.array(F.concat(F.lit("src/main/java/"), dotted, F.lit(".java"))))
        .when(lang == "ruby", ruby)
        .when(lang == "elixir", F.array(module, F.concat(F.lit("apps/*/"), module)))
        .when((lang == "hcl") & spec.startswith("."), F.array(F.concat(here, spec)))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.transform(places, lambda p: F.when(p.startswith("apps/*/"), p).otherwise(normal(p)))


def known_places(paths: DataFrame) -> DataFrame:
    """project, place, path: each file of paths (project, path) under its own path, the folders above it, and, of an umbrella's apps, under apps/*."""
    part = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(part) - 2), lambda i: F.array_join(F.slice(part, F.lit(1), i + 1), "/"))
    folders = paths.filter(F.size(part) > 1).select("project", F.explode(above).alias("path")).distinct()
    own = paths.select("project", "path").unionByName(folders).distinct().select("project", F.col("path").alias("place"), "path")
    apps = paths.filter(F.col("path").rlike("^apps/[^/]+/lib/")).select("project", F.regexp_replace("path", "^apps/[^/]+/", "apps/*/").alias("place"), "path")
    return own.unionByName(apps.groupBy("project", "place").agg(F.min("path").alias("path")))


def resolve(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges of imports (import_specs()) by the files there are, paths (project, path): project, src, dst, import_name, resolved.

    dst is a path below the project, or the name itself where it means no file or folder there is. Two equi-joins; the
    best of an import's few places is found by a partial minimum.
    """
    each = imports.select("project", "src", "language", "spec", "kind", F.posexplode_outer(_candidates()).alias("at", "place"))
    found = each.join(known_places(paths), ["project", "place"], "left")
    best = found.groupBy("project", "src", "language", "kind", "spec").agg(F.min(F.when(F.col("path").isNotNull(), F.struct("at", "path"))).alias("best"))
    return best.select("project", "src", F.coalesce("best.path", "spec").alias("dst"), F.col("spec").alias("import_name"), F.col("best").isNotNull().alias("resolved")).distinct()


def occurrence_edges(occurrences: DataFrame) -> DataFrame:
    """src, dst: references to the definitions of other files, from occurrences (file, symbol, role, nth). Bit 1 of role marks a definition; a symbol's last one counts."""
    defs = occurrences.filter(F.col("role").bitwiseAND(1) == 1).groupBy("symbol").agg(F.max_by("file", F.struct("nth", "file")).alias("dst"))
    refs = occurrences.filter(F.col("role").bitwiseAND(1) == 0).select(F.col("file").alias("src"), "symbol").distinct()
    return refs.join(defs, "symbol").filter("src <> dst").select("src", "dst").distinct()
