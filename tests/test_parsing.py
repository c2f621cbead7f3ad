"""Symbols, chunks, sentences and imports of small sources in all languages."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import semantic, text
from lodestone.operators import chunks, imports
from lodestone.parsing.symbols import symbols

PYTHON = 'import os\nclass A(Base):\n    """Doc of A."""\n    @dec\n    def f(self, x: int) -> str:\n        # first note\n        return x\n    async def g(self):\n        "g doc"\n        def inner(): pass\n'
JAVASCRIPT = 'export function foo(a) { /* note */ return a; }\nfunction* gen() { yield 1 }\nclass K extends L {\n  constructor(x) { super(x); if (x) { y(); } }\n  async run() { return () => 1; }\n  static get z() { return "}" }\n}\nconst add = (a, b) => a + b;\nconst id = x => x;\nconst h = function () { return 1 };\nmodule.exports = { go(x) { return x } };\nfor (let i = 0; i < 3; i++) { call(i); }\n'
TYPESCRIPT = 'interface Shape { area(): number; }\nexport class Auth {\n  constructor(private db: Db) { this.x = "a"; }\n  public async login(user: string, cb: (x: number) => void): Promise<string> { return user; }\n}\nexport async function hash(p: string): Promise<string> { return p; }\nabstract class Q { }\nconst f = async (a: number): Promise<void> => { await a; };\n'
GO = 'package main\ntype Server struct {\n\taddr string\n}\ntype ID int\nfunc (s *Server) Run(x int) error {\n\tfmt.Println("}")\n\treturn nil\n}\nfunc main() {\n\tf := func() { }\n\tf()\n}\n'
RUST = "pub struct P { x: i32 }\nstruct U;\npub trait Draw { fn draw(&self); fn twice(&self) { self.draw() } }\nimpl Draw for P {\n    // does it\n    fn draw(&self) { println!(\"{}\", 'a'); }\n}\nimpl<T> Holder<T> { pub fn new<'a>(x: &'a T) -> Self { Holder } }\n"
JAVA = "public class Foo extends Bar {\n    private int x = 3;\n    public Foo(int x) { this.x = x; }\n    @Override\n    public List<String> names(Map<String, Integer> m) throws IOException { if (x > 2) { call(m); } return null; }\n    interface In { void go(int a); }\n}\n"
C = '#define X(a) do { a; } while (0)\nstruct point { int x; };\nstatic int add(int a, struct point *p) {\n  if (a) { return 1; }\n  return 2;\n}\nchar *name(void) { return "x{"; }\nint decl(int);\n'
CPP = "class A : public B {\npublic:\n  A() : x(1) {}\n  int get() const { return x; }\n};\nvoid A::foo(int y) { for (;;) { } }\n"
RUBY = "module Billing\n  class Invoice\n    # note\n    def total\n      return 1 if x\n      items.each do |i|\n        i.go\n      end\n    end\n\n    def self.build(data)\n      if data\n        new\n      end\n    end\n    def one = 1\n  end\nend\n"
ELIXIR = 'defmodule Billing.Invoice do\n  @moduledoc "Invoice handling do"\n\n  defstruct [:id, :total]\n\n  def total(%__MODULE__{total: t}), do: t\n\n  def double(x) when is_integer(x), do: x * 2\n\n  defmacro shortcut(name) do\n    quote do\n      def generated, do: :ok\n      IO.puts(unquote(name))\n    end\n  end\n\n  def multi(a,\n            b) do\n    Enum.map(a, fn x -> x end)\n  end\nend\n'
HCL = 'variable "region" {\n  default = "us-east-1"\n}\n\nresource "aws_s3_bucket" "data" {\n  lifecycle {\n    prevent_destroy = true\n  }\n}\n# module "no" {\n# }\nlocals {\n  a = 1\n}\n'

CASES = {
    "python": (PYTHON, [("class", "A", 2, 10, None), ("function", "f", 5, 7, "A"), ("function", "g", 8, 10, "A"), ("function", "inner", 10, 10, "A")]),
    "javascript": (JAVASCRIPT, [("function", "foo", 1, 1, None), ("class", "K", 3, 7, None), ("method", "constructor", 4, 4, "K"), ("method", "run", 5, 5, "K"), ("function", "<anonymous>", 5, 5, "K"), ("method", "z", 6, 6, "K"), ("function", "<anonymous>", 8, 8, None), ("function", "x", 9, 9, None), ("function", "<anonymous>", 10, 10, None), ("method", "go", 11, 11, None)]),
    "typescript": (TYPESCRIPT, [("interface", "Shape", 1, 1, None), ("class", "Auth", 2, 5, None), ("method", "constructor", 3, 3, "Auth"), ("method", "login", 4, 4, "Auth"), ("function", "hash", 6, 6, None), ("function", "<anonymous>", 8, 8, None)]),
    "go": (GO, [("class", "Server", 2, 4, None), ("class", "ID", 5, 5, None), ("method", "Run", 6, 9, None), ("function", "main", 10, 13, None)]),
    "rust": (RUST, [("class", "P", 1, 1, None), ("class", "U", 2, 2, None), ("interface", "Draw", 3, 3, None), ("function", "twice", 3, 3, "Draw"), ("class", "Draw", 4, 7, None), ("function", "draw", 6, 6, "Draw"), ("class", "Holder", 8, 8, None), ("function", "new", 8, 8, "Holder")]),
    "java": (JAVA, [("class", "Foo", 1, 7, None), ("function", "Foo", 3, 3, "Foo"), ("method", "names", 4, 5, "Foo"), ("interface", "In", 6, 6, "Foo"), ("method", "go", 6, 6, "In")]),
    "c": (C, [("class", "point", 2, 2, None), ("function", "add", 3, 6, None), ("function", "name", 7, 7, None)]),
    "cpp": (CPP, [("class", "A", 1, 5, None), ("function", "A", 3, 3, "A"), ("function", "get", 4, 4, "A"), ("function", "A::foo", 6, 6, None)]),
    "ruby": (RUBY, [("class", "Billing", 1, 18, None), ("class", "Invoice", 2, 17, "Billing"), ("method", "total", 4, 9, "Invoice"), ("method", "build", 11, 15, "Invoice"), ("method", "one", 16, 16, "Invoice")]),
    "elixir": (ELIXIR, [("class", "Billing.Invoice", 1, 21, None), ("function", "total", 6, 6, "Billing.Invoice"), ("function", "double", 8, 8, "Billing.Invoice"), ("function", "shortcut", 10, 15, "Billing.Invoice"), ("function", "multi", 17, 20, "Billing.Invoice")]),
    "hcl": (HCL, [("function", "region", 1, 3, None), ("class", "aws_s3_bucket.data", 5, 9, None), ("function", "<anonymous>", 12, 14, None)]),
}


@pytest.mark.parametrize("language", CASES)
def test_symbols(language):
    source, want = CASES[language]
    line = lambda at: source.count("\n", 0, at) + 1
    assert [(s.kind, s.name, line(s.start), line(s.end), s.parent) for s in symbols(source, language)] == want
    for cut in range(0, len(source), 7):  # a file cut anywhere gives what is whole, never an error
        symbols(source[:cut], language)


def test_comments_and_odd_files():
    docs = {s.name: s.doc for s in symbols(PYTHON, "python")}
    assert docs == {"A": "Doc of A.", "f": "first note", "g": "g doc", "inner": None}
    assert {s.name: s.doc for s in symbols(RUST, "rust")}["Draw"] == "does it" and symbols(JAVASCRIPT, "javascript")[0].doc == "* note */"
    assert [s.name for s in symbols("class A:\n    def ok(self):\n        return 1\ndef broken(:\n", "python")] == ["A", "ok", "broken"]
    assert symbols("", "go") == [] and symbols("x", "cobol") == []


def test_chunk_rows(spark):
    files = spark.createDataFrame([("/p/a.py", "python", PYTHON), ("/p/b.py", "python", "x = 1\n" * 100), ("/p/c.py", "python", None), ("/p/d", None, "x")], "file_path string, language string, text string")
    rows = lambda *a: chunks.chunk_files(files, *a).collect()
    got = rows("ast")
    assert [r["name"] for r in got] == ["a", "A", "f", "g", "inner"] and got[0]["chunk_type"] == "module" and got[0]["end_line"] == 11
    assert len({r["id"] for r in got}) == 5 and got[2]["semantic_text"] == "Function f in A. Parameters: self, x. Returns: str. first note"
    assert [(r["start_line"], r["end_line"]) for r in rows("sliding") if r["file_path"] == "/p/b.py"] == [(1, 64), (49, 100)]
    assert [r["name"] for r in rows("hybrid") if r["chunk_type"] == "window"] == ["b:1-64", "b:49-100"]
    assert rows("sliding")[0]["semantic_text"].startswith("Code from /p/a.py lines 1-10. Language: python. import os")


def test_import_edges(spark):
    rows = [
        ("src/a.py", "python", "from . import x\nfrom ..top import y\nimport os, src.b\n  import not_this\nfrom .b import (\n  z)\n"),
        ("src/b.py", "python", ""), ("src/__init__.py", "python", ""), ("top.py", "python", ""),
        ("web/a.ts", "typescript", "import {\n a\n} from '../web/lib';\nconst y = require(\"./none\");\nimport z from 'pkg';\n"), ("web/lib/index.ts", "typescript", ""),
        ("apps/one/lib/my_app/user_store.ex", "elixir", ""), ("lib/x.ex", "elixir", "alias MyApp.UserStore\n# alias Not.This\n  import X.{Y, Z}\n"),
        ("infra/main.tf", "hcl", 'module "a" {\n  for = { x = 1 }\n  source = "./mod"\n}\n# module "b" { source = "./no" }\nmodule "c" {\n  source = "registry/x"\n}\n'), ("infra/mod/main.tf", "hcl", ""),
        ("lib/r.rb", "ruby", "require_relative '../lib/q'\n  require 'json'\n"), ("lib/q.rb", "ruby", ""), ("m.c", "c", '#include "x.h"\n'),
        ("src/main.rs", "rust", "mod cfg;\nuse std::io;\nmod inline { }\n"), ("src/cfg/mod.rs", "rust", ""),
    ]
    files = spark.createDataFrame([("p", *r) for r in rows], "project string, path string, language string, text string")
    got = {(r["src"], r["dst"], r["resolved"]) for r in imports.resolve(imports.import_specs(files), files).collect()}
    assert got == {
        ("src/a.py", "src/__init__.py", True), ("src/a.py", "top.py", True), ("src/a.py", "os", False), ("src/a.py", "src/b.py", True), ("web/a.ts", "web/lib", True),  # a folder is there, as a file would be
       
        ("web/a.ts", "./none", False), ("web/a.ts", "pkg", False), ("lib/x.ex", "apps/one/lib/my_app/user_store.ex", True), ("lib/x.ex", "X.Y", False), ("lib/x.ex", "X.Z", False),
        ("infra/main.tf", "infra/mod", True), ("infra/main.tf", "registry/x", False), ("lib/r.rb", "lib/q.rb", True), ("lib/r.rb", "json", False), ("src/main.rs", "src/cfg/mod.rs", True),
    }
    assert [r[0] for r in spark.createDataFrame([("HTTPServerName",), ("userID",)], "s string").select(imports.snake(F.col("s"))).collect()] == ["http_server_name", "user_id"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.code_tokens(F.lit("rrf__fuse DenseIndex v2X"))) == "rrf__fuse denseindex v2x rrf fuse denseindex v2x rrf fuse dense index v2 x rrf fuse dense index v 2 x"
    assert one(semantic.imports(F.lit("import a\n  from b import c\nusing x;\nimportant\n"))) == "import a, from b import c, using x;"
    assert one(semantic.return_type(F.lit("func (t *T) Run() Result {"))) == "Result" and one(semantic.return_type(F.lit("def f(): pass"))) == ""
    assert [tuple(x) for x in one(semantic.markers(F.lit("# TODO: a\n// fixme b\nTODOS")))] == [("TODO", "a"), ("FIXME", "b")]
    stub = lambda raw: one(semantic.is_stub(F.lit("function"), F.lit(raw)))
    assert stub("def f():\n    pass\n") and stub("def f():\n    raise NotImplementedError('x')") and not stub("def f():\n    return 1") and not stub("def f(): pass")
    assert one(semantic.without_prefix(F.lit("Function f. Checks it. More."))) == "Checks it"
