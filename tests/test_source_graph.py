"""The graph that follows a tree's changes against one that is built from the tree as it is."""

import random

import pytest

from weftgraph.sources import code
from weftgraph.streaming.source_graph import CHANGES, SourceGraph

TREE = {
    "app/__init__.py": "",
    "app/base.py": "class Base:\n    def run(self):\n        return helper()\n    def stop(self):\n        pass\n\ndef helper():\n    return 1\n",
    "app/mid.py": "from .base import Base\nclass Mid(Base):\n    pass\n",
    "app/leaf.py": "from .mid import Mid\nLIMIT = 3\nclass Leaf(Mid):\n    def run(self):\n        x = Mid()\n        x.stop()\n        return only_here(LIMIT)\n",
    "app/other.py": "from app.base import helper\ndef only_here(n):\n    return helper()\n",
    "web/a.ts": "import { b } from './b';\nimport w from './widgets';\nexport class Shape { area() { return b(1); } }\nexport function draw(s: Shape) { return s.area(); }\n",
    "web/b.ts": "export const b = (n: number) => { return n; };\n",
    "web/widgets/index.ts": "export function w() { return 1; }\n",
    "j/Store.java": "package j;\npublic interface Store { void put(int a); }\n",
    "j/Memory.java": "package j;\npublic class Memory implements Store { public void put(int a) { } }\n",
    "j/User.java": "package j.user;\nimport j.*;\npublic class User {\n  private Store store;\n  @GetMapping(\"/u\")\n  public void go() { store.put(1); }\n}\n",
    "src/lib.rs": "mod shape;\nuse crate::shape::P;\npub fn make() -> P { P::new() }\n",
    "src/shape.rs": "pub struct P { x: i32 }\nimpl P { pub fn new() -> P { P { x: 1 } } }\n",
    "docs/a.md": "# A\n[b](b.md)\n## C\n",
    "docs/b.md": "# B\n",
}
LANGUAGE = {"py": "python", "ts": "typescript", "java": "java", "rs": "rust", "md": "markdown"}


def listing(spark, tree):
    return spark.createDataFrame([(p, LANGUAGE[p.rsplit(".", 1)[1]], t.encode()) for p, t in sorted(tree.items())], "path string, language string, content binary")


def same(spark, store, tree):
    nodes, edges = store.graph()
    want_nodes, want_edges = code.build_graph(code.symbols(listing(spark, tree)))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(edges) == rows(want_edges.select(edges.columns))
    assert rows(nodes) == rows(want_nodes.select(nodes.columns))


EDITS = [
    ("a method moves up the hierarchy", {"app/base.py": TREE["app/base.py"].replace("stop", "halt"), "app/mid.py": "from .base import Base\nclass Mid(Base):\n    def stop(self):\n        pass\n"}),
    ("the middle of a hierarchy gets another base", {"app/mid.py": "from .far import Far\nclass Mid(Far):\n    pass\n", "app/far.py": "class Far:\n    def stop(self):\n        pass\n"}),
    ("a name becomes ambiguous, a file is renamed", {"app/twin.py": "def only_here(n):\n    pass\n", "web/b.ts": None, "web/c.ts": TREE["web/b.ts"], "web/a.ts": TREE["web/a.ts"].replace("./b", "./c")}),
    ("another implementation, another route, a folder goes", {"j/Disk.java": "package j;\npublic class Disk implements Store { public void put(int a) { } }\n", "web/widgets/index.ts": None, "j/User.java": TREE["j/User.java"].replace('"/u"', '"/v"'), "docs/b.md": "# B2\n## D\n"}),
    ("a type goes, its members stay", {"src/shape.rs": "pub struct Q { x: i32 }\n", "src/more.rs": "impl P { pub fn new() -> P { P { x: 1 } } }\n"}),
    ("everything of a language goes", {p: None for p in TREE if p.endswith((".java", ".md"))}),
]


def test_edits_renames_and_deletions_equal_a_fresh_graph(spark, tmp_path):
    tree = dict(TREE)
    store = SourceGraph(spark, str(tmp_path / "g"), fan=4)
    assert store.update("first", listing(spark, tree))
    for n in range(0, len(EDITS), 3):
        edits = EDITS[n][1] | EDITS[n + 1][1] | EDITS[n + 2][1]
        tree = {p: t for p, t in (tree | edits).items() if t is not None}
        store = SourceGraph(spark, str(tmp_path / "g"), fan=1)
        assert store.update(EDITS[n][0], listing(spark, tree))
        same(spark, store, tree)
    assert len(store.manifest.state["parts"]) == 1  # merged on the way
    assert not store.update("first", listing(spark, {}))  # known by name


def test_only_touched_files_are_resolved(spark, tmp_path):
    store = SourceGraph(spark, str(tmp_path / "g"))
    store.update("first", listing(spark, TREE))
    body = TREE | {"web/b.ts": "export const b = (n: number) => { return n + 1; };\n// more\n"}
    store.update("edit", listing(spark, body))
    part = store.manifest.state["parts"][-1]
    read = lambda t: {r.path for r in spark.read.parquet(f"{store.path}/{part}/{t}").collect()}
    assert read("changed") == read("symbols") == read("affected") == {"web/b.ts"}  # nobody else sees the body of a function
    version = store.manifest.version
    assert store.update("nothing new", listing(spark, body))
    assert store.manifest.state["parts"][-1] == part and store.manifest.version == version + 1
    store.update("more", listing(spark, body | {"web/b.ts": "export const b = (n: number, m: number) => { return n; };\n"}))
    part = store.manifest.state["parts"][-1]
    assert read("changed") == {"web/b.ts"} and {"web/a.ts", "web/b.ts"} <= read("affected") <= {"web/a.ts", "web/b.ts", "docs/a.md"}


def test_a_stream_of_change_files(spark, tmp_path):
    tree, folder = dict(TREE), tmp_path / "changes"
    store = SourceGraph(spark, str(tmp_path / "g"))

    def say(number, changes):
        rows = [(p, LANGUAGE[p.rsplit(".", 1)[1]], None if t is None else t.encode(), t is None, v) for p, t, v in changes]
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(str(folder))
        store.follow(str(folder), str(tmp_path / "cp"), "s").awaitTermination()

    say(0, [(p, t, 1) for p, t in TREE.items()])
    say(1, [("app/base.py", "def helper():\n    pass\n", 1), ("app/base.py", None, 2), ("app/new.py", "def helper():\n    return 2\n", 1), ("app/absent.py", None, 1)])
    tree.pop("app/base.py")
    tree["app/new.py"] = "def helper():\n    return 2\n"
    same(spark, store, tree)
    with pytest.raises(ValueError):
        store.apply("bad", spark.createDataFrame([("x.py", "python", b"", False), ("x.py", "python", b"1", False)], "path string, language string, content binary, deleted boolean"))


def test_random_edits(spark, tmp_path):
    r = random.Random(8)
    names = [f"n{i}" for i in range(6)]

    def module():
        out = [f"from .m{r.randrange(6)} import {r.choice(names)}"]
        for _ in range(r.randint(1, 3)):
            a = r.choice(names)
            if r.random() < 0.5:
                out.append(f"class {a.upper()}({r.choice(names).upper()}):\n    def {r.choice(names)}(self):\n        {r.choice(names)}()\n        return self.{r.choice(names)}()")
            else:
                out.append(f"def {a}():\n    x = {r.choice(names).upper()}()\n    return x.{r.choice(names)}()")
        return "\n".join(out) + "\n"

    tree = {f"p/m{i}.py": module() for i in range(6)}
    store = SourceGraph(spark, str(tmp_path / "g"))
    store.update("0", listing(spark, tree))
    for k in range(1, 2):
        for _ in range(3):
            p = f"p/m{r.randrange(7)}.py"
            tree[p] = module()
        if r.random() < 0.6:
            tree.pop(r.choice(sorted(tree)))
        store.update(str(k), listing(spark, tree))
        same(spark, store, tree)
