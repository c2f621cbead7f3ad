"""The tools over a small tree: indexing in runs, retrieval in scope, notes, project questions."""

import os
import shutil
import textwrap

import pytest

from lodestone.engine import Engine
from lodestone.memory import query_words
from lodestone.sources import tree

AUTH = '''\
import os
from .store import UserStore


class AuthService(Base):
    """Signs users in."""

    def authenticate_user(self, name: str, password: str) -> bool:
        """Check a user's password."""
        return self.store.check(name, password)

    def logout(self):
        pass


def hash_password(raw):
    # TODO: use a slow hash
    return raw
'''
STORE = '''\
class UserStore:
    """Keeps user records."""

    def check(self, name, password):
        raise NotImplementedError

    def parse_config(self, path):
        return path
'''
JS = """\
import { api } from './api';
export function renderLogin(form) { return api(form); }
"""


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("src") / "build" / "proj"  # an excluded name above the root doesn't count
    for name, text in {"pkg_a/auth.py": AUTH, "pkg_a/store.py": STORE, "web/login.js": JS, "web/api.js": "export const api = (x) => x;\n", "tests/test_auth.py": "def test_it():\n    assert True\n", "main.py": "from pkg_a.auth import AuthService\n\n\ndef main():\n    AuthService()\n", "vendor/skip.py": "def never(): pass\n", "README.md": "# Title\n\nSigns people\nin.\n\nMore.\n", "a build's/x.py": "def odd(): pass\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    engine = Engine(spark, str(tmp_path_factory.mktemp("index")))
    return engine, str(root), engine.index_codebase(str(root))


def test_first_run(made):
    engine, root, got = made
    assert got["status"] == "done" and got["error"] is None and got["total_files"] == got["indexed_files"] == 7
    assert engine.index_status(got["task_id"])["progress_pct"] == 100.0 and engine.index_status("none")["error"]
    names = {r["name"]: r for r in engine.store.symbols(root).collect()}
    assert {"AuthService", "authenticate_user", "hash_password", "renderLogin", "odd"} <= set(names) and "never" not in names
    assert engine.registry(root + "/pkg_a") == engine.registry(root) and engine.registry()[root]["files"] == 7
    edges = {(r["src"][len(root) + 1 :], r["dst"].replace(root + "/", "")) for r in engine.store.edges().collect()}
    assert {("pkg_a/auth.py", "pkg_a/store.py"), ("pkg_a/auth.py", "os"), ("main.py", "pkg_a/auth.py"), ("web/login.js", "web/api.js")} == edges


def test_tools(made):
    engine, root, _ = made
    got = engine.query_code("authenticate user password", k=3, project=root)
    assert got["results"][0]["name"] == "authenticate_user" and got["pipeline"]["sparse_hits"] and not got["pipeline"]["ppr_applied"]
    assert any(n.endswith("store.py") for n in got["results"][0]["neighbors"])
    assert {r["language"] for r in engine.query_code("login form", languages=["javascript"], project=root)["results"]} == {"javascript"}
    assert engine.query_code("  ") == {"error": "query is required"} and engine.query_code("x", project="/nowhere")["results"] == []
    assert engine.query_code("user password", k=2, rerank=True, project=root)["pipeline"]["reranked"]
    assert engine.get_symbol("hash_password", project=root)["results"][0]["type"] == "function"
    assert engine.get_symbol("nothing", project=root)["message"] and engine.get_symbol("hash password", fuzzy=True, project=root)["results"][0]["name"] == "hash_password"
    found = engine.find_existing("check a password of a user", project=root)
    assert found["total_found"] and found["existing_code"][0]["score"] <= 1 and all(x["chunk_type"] in ("function", "method", "class") for x in found["existing_code"])
    assert "Import/extend" in found["existing_code"][0]["reuse_hint"]
    files = [x["file"] for x in found["existing_code"]]
    assert all(files.count(f) <= 2 for f in files)
    assert engine.duplicate_names("def hash_password(x):\n    pass", root + "/other.py")[0]["file"].endswith("auth.py")


def test_projects(made):
    engine, root, _ = made
    said = engine.summarize_project(root)
    assert said["description"] == "Signs people in." and said["tech_stack"]["python"] > said["tech_stack"]["javascript"]
    assert said["entry_points"] == ["main.py"] and "AuthService" in said["public_api"] and said["indexed_files"] == 7
    plan = engine.get_architecture(root)
    assert plan["layers"]["pkg_a"] and plan["role_summary"]["leaf"] and {"from": "main.py", "to": "pkg_a/auth.py"} in plan["edges"]
    state = engine.project_status(root)
    assert state["todo_count"] >= 1 and state["todos"][0]["type"] == "TODO" and {s["name"] for s in state["stubs"]} >= {"logout", "check"}
    assert state["test_coverage"] == {"test_files": 1, "source_files": 7, "ratio": 0.14} and state["git"] == {"available": False}
    assert engine.ask_project("what is this about?", root)["source_tool"] == "summarize_project"
    assert engine.ask_project("hash password", root)["source_tool"] == "query_code"
    assert engine.project_status("/nowhere")["error"]


def test_runs_follow_the_tree(spark, tmp_path):
    root, data = tmp_path / "p", tmp_path / "index"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    return 1\n")
    (root / "b.py").write_text("import a\n\n\ndef two():\n    return 2\n")
    (root / "c.js").write_text("function three() { return 3 }\n")
    e = Engine(spark, str(data))
    names = lambda: {r["name"] for r in e.store.symbols(str(root)).collect()}
    run = lambda **x: {k: v for k, v in e.index_codebase(str(root), **x).items() if k in ("status", "indexed_files", "skipped_files", "orphans", "indexed_chunks")}
    assert run()["indexed_files"] == 3 and names() == {"one", "two", "three"}
    before = e.store.entry(str(root)).version
    assert run() == {"status": "done", "indexed_files": 0, "indexed_chunks": 0, "skipped_files": 3, "orphans": 0} and e.store.entry(str(root)).version == before
    (root / "a.py").write_text("def uno():\n    return 1\n")
    os.utime(root / "b.py", (1, 1))  # the time alone makes a file new
    (root / "c.js").unlink()
    assert run() == {"status": "done", "indexed_files": 2, "indexed_chunks": 4, "skipped_files": 0, "orphans": 1}
    assert names() == {"uno", "two"} and e.registry(str(root))["files"] == 2
    whole = Engine(spark, str(tmp_path / "index2"))
    whole.index_codebase(str(root))
    rows = lambda s: sorted(map(str, s.chunks(str(root)).drop("vector").collect()))
    assert rows(whole.store) == rows(e.store)  # runs add up to what one run makes
    e.store.compact(str(root))
    assert rows(whole.store) == rows(e.store) and len(e.store.entry(str(root)).segments) == 1
    # files of other languages than those asked for are no orphans
    (root / "d.go").write_text("package d\n\nfunc Four() int {\n\treturn 4\n}\n")
    assert run(languages=["go"])["orphans"] == 0 and names() == {"uno", "two", "Four"}
    # the list is there, the chunks are not: all is indexed anew
    for s in e.store.entry(str(root)).segments:
        shutil.rmtree(e.store._at(str(root), "chunks", s))
    assert run()["indexed_files"] == 3 and names() == {"uno", "two", "Four"}
    (root / tree.MARKER).write_text("")
    assert e.index_codebase(str(root))["status"] == "skipped" and e.index_codebase(str(root / "no"))["error"]


def test_notes(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert e.recall("x") == {"results": [], "count": 0} and e.remember(" ")["error"] == "content is required"
    a = e.remember("RRF fusion uses k 60", ["search"], "decision")["id"]
    e.remember("Parquet files are written last", ["store"], "odd")
    assert [r["id"] for r in e.recall("fusion of lists")["results"]] == [a]
    assert e.recall("files", category="decision")["count"] == 0 and e.recall("files", category="general")["count"] == 1
    assert e.recall("nothing", tags=["search"])["results"][0]["tags"] == ["search"]  # tags are more words
    assert e.memory.delete(a) and not e.memory.delete(a) and e.memory.get(a) is None and e.recall("fusion")["count"] == 0
    e.memory.compact()
    assert e.recall("parquet")["count"] == 1
    assert query_words("a-b  ?? c", ["d!"]) == ["ab", "c", "d"]


def test_order_and_marks(spark, tmp_path):
    df = spark.createDataFrame([("z.py", 5.0), ("x/main.py", 1.0), ("y.py", 9.0)], "path string, mtime double")
    assert [r["path"] for r in tree.in_order(df).collect()] == ["x/main.py", "y.py", "z.py"]
    (tmp_path / "README.rst").write_text(textwrap.dedent("""\
        ===
        Name
        ===

        Second.
        """))
    assert tree.readme(spark, str(tmp_path)) == "Name"
