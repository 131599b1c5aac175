import pytest

from weftgraph.functions import classify
from weftgraph.sources import code, tables

FILES = {
    "app/core.py": '"""Core."""\nimport os\nfrom .util import helper\nLIMIT = 3\n\nclass Base:\n    def run(self):\n        return helper(1)\n\nclass Child(Base):\n    def run(self):\n        if True:\n            for x in []:\n                pass\n        return local()\n\ndef local():\n    return Child()\n',
    "app/util.py": "def helper(x):\n    return x\n\ndef twin():\n    pass\n",
    "app/other.py": "def twin():\n    pass\n\ndef calls_twin():\n    twin()\n\ndef broken_call():\n    nowhere()\n",
    "app/far.py": "def far():\n    twin()\n",
    "app/bad.py": "def (:\n",
    "web/a.ts": "import { b } from './b';\nexport class Shape {\n  area() { return b(1); }\n}\nexport function draw(s: Shape) { return s.area(); }\n// function ghost() {}\n",
    "web/b.ts": "export const b = (n: number) => { return n; };\n",
    "src/lib.rs": "/// A greeting.\npub fn greet(name: &str) -> String { helper(name) }\nfn helper(n: &str) -> String { n.into() }\nstruct P { x: i32 }\nimpl P { fn new() -> P { P { x: 1 } } }\n",
    "J.java": "import java.util.List;\n/** Doc. */\npublic class J extends K implements L {\n  @GetMapping(\"/x\")\n  public void go(int a, int b) { stop(); }\n  void stop() { }\n}\n",
    "node_modules/x.js": "function no() {}\n",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return code.scan_files(spark, str(root), ignore=["**/far.py"])


def test_scan(tree):
    assert {r.path for r in tree.select("path").collect()} == set(FILES) - {"node_modules/x.js", "app/far.py"}


def test_graph(tree):
    nodes, edges = code.build_graph(code.symbols(tree))
    kinds = {r.id: r.node_type for r in nodes.collect()}
    assert kinds["class:app/core.py:Base"] == "Class" and kinds["variable:app/core.py:LIMIT"] == "Constant" and kinds["function:web/a.ts:Shape.area"] == "Function"
    assert kinds["function:src/lib.rs:P.new"] == "Function" and "function:web/a.ts:ghost" not in kinds
    got = {(r.source, r.target, r.edge_type) for r in edges.collect()}
    for e in [
        ("class:app/core.py:Base", "function:app/core.py:Base.run", "Contains"), ("class:app/core.py:Child", "class:app/core.py:Base", "Extends"), ("function:app/core.py:Base.run", "function:app/util.py:helper", "Calls"), ("function:app/core.py:Child.run", "function:app/core.py:local", "Calls"),
        ("function:app/core.py:local", "class:app/core.py:Child", "Instantiates"), ("function:app/core.py:Child.run", "function:app/core.py:Base.run", "Overrides"), ("file:app/core.py", "file:app/util.py", "Imports"), ("file:web/a.ts", "file:web/b.ts", "Imports"), ("file:app/core.py", "function:app/util.py:helper", "References"), ("function:web/a.ts:Shape.area", "function:web/b.ts:b", "Calls"), ("function:src/lib.rs:P.new", "class:src/lib.rs:P", "Instantiates"), ("file:web/a.ts", "class:web/a.ts:Shape", "Exports"), ("folder:app", "file:app/core.py", "Contains"), ("route:GET /x", "function:J.java:J.go", "References"),
        ("function:app/other.py:calls_twin", "function:app/other.py:twin", "Calls"), ("function:web/a.ts:draw", "function:web/a.ts:Shape.area", "Calls"), ("function:src/lib.rs:greet", "function:src/lib.rs:helper", "Calls"), ("function:J.java:J.go", "function:J.java:J.stop", "Calls"),
    ]:
        assert e in got, e
    assert not any("nowhere" in t for _, t, _ in got)
    facts = {r.id: r for r in nodes.collect()}
    assert facts["function:app/core.py:Child.run"].max_nesting == 2 and facts["function:J.java:J.go"].params == 2 and facts["class:J.java:J"].description == "Doc."


def test_ambiguous_names_make_no_edge(spark):
    files = spark.createDataFrame([("a.py", "python", b"def twin(): pass\n"), ("b.py", "python", b"def twin(): pass\n"), ("c.py", "python", b"def far():\n    twin()\n")], "path string, language string, content binary")
    assert code.build_graph(code.symbols(files))[1].where("edge_type = 'Calls'").count() == 0


def test_ids_survive_inserted_lines(spark):
    ids = lambda t: {r.id for r in code.with_ids(code.symbols(spark.createDataFrame([("a.py", "python", t)], "path string, language string, content binary"))).collect()}
    text = b"def f(): pass\ndef f(): pass\nclass C:\n    def f(self): pass\n"
    assert ids(text) == ids(b"# one\n\n" + text) and "function:a.py:f#2" in ids(text)


def test_markdown(spark):
    text = "# A\nintro\n## B\nbody b\n```\n# not a heading\n```\n### C\nbody c\n# D #\n[x](../z.md) [y](https://e.org) [w](#f)"
    files = spark.createDataFrame([("docs/a.md", text)], "path string, text string")
    got = sorted((r.start_line, r.level, r.title, r.end_line) for r in tables.markdown_headings(files).collect())
    assert got == [(1, 1, "A", 9), (3, 2, "B", 9), (8, 3, "C", 9), (10, 1, "D", 11)]
    assert [tuple(r) for r in tables.markdown_links(files).collect()] == [("docs/a.md", "z.md")]


def test_package_and_folders_and_code(spark):
    m = spark.createDataFrame([("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}')], "path string, text string")
    assert sorted(tuple(r)[1:] for r in tables.package_dependencies(m).collect()) == [("a", "1", False, False), ("b", "2", True, False)]
    f = spark.createDataFrame([("a/b/x.py", "python"), ("a/y.md", "markdown"), ("z.py", "python")], "path string, language string")
    assert {(r.folder, r.parent, r.depth, r.files, r.languages.get("python")) for r in tables.folders(f).collect()} == {("a", "", 1, 2, 1), ("a/b", "a", 2, 1, 1)}
    src = spark.createDataFrame([("x.py", "l1\nl2\nl3")], "path string, text string")
    n = spark.createDataFrame([("a", "x.py", 2, 9), ("b", "x.py", None, None), ("c", "x.py", 1, 1)], "id string, file string, start_line int, end_line int")
    assert {r.id: r.code for r in tables.capture_source(n, src).collect()} == {"a": "l2\nl3", "b": "l1\nl2\nl3", "c": "l1"}


def test_classes_of_files_and_folders(spark):
    paths = {"docs/components/a.md": "documentation", "a/Button.test.tsx": "test", "a/components/b.ts": "component", "a/useThing.ts": "hook", "a/orderService.ts": "service", "MAX_RETRIES.ts": "constant", "a/x.png": "asset", "src/test/java/FooTest.java": "test", "a/b.rs": None, "x/types/y.ts": "type", "x/webpack.config.js": "config"}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.k for r in df.select("path", classify.classify_file().alias("k")).collect()} == paths
    f = spark.createDataFrame([("a/tests", 1, {"python": 1}), ("a/x", 2, {"python": 2}), ("a/y", 2, {"markdown": 2}), ("a/z", 2, {"markdown": 1, "python": 1}), ("a/e", 0, {}), ("a/lib", 1, {})], "folder string, files int, languages map<string,int>")
    assert [r.k for r in f.select(classify.classify_folder().alias("k")).collect()] == ["tests", "source", "documentation", "mixed", None, "utils"]


def test_boundaries(spark):
    a, k = "array<struct<name:string,args:string>>", "array<struct<name:string,owner:string,arg:string>>"
    rows = [
        ("1", "python", "function", "home", None, None, [("app.route", "'/home', methods=['GET']")], [], []),
        ("2", "java", "class", "R", None, None, [], ["JpaRepository<Order, Long>"], []),
        ("3", "typescript", "function", "list", "C", None, [("Get", "path: 'all'")], [], [("fetch", None, "/api"), ("post", "axios", "/p")]),
        ("4", "typescript", "function", "list", "D", None, [("Get", "")], [], []),
        ("5", "rust", "function", "main", None, None, [], [], []),
        ("6", "java", "function", "q", "S", "GET /q", [("KafkaListener", 'topics = "t1"')], [], [("query", "JdbcTemplate", None)]),
        ("7", "python", "function", "plain", None, None, [], [], [("get", "cache", None)]),
    ]
    s = spark.createDataFrame(rows, f"id string, language string, kind string, name string, owner string, route string, annotations {a}, supertypes array<string>, calls {k}")
    owners = spark.createDataFrame([("C", [("Controller", "")]), ("D", [("Injectable", "")])], f"owner string, annotations {a}")
    got = sorted((r.id, r.source, r.detail) for r in classify.boundaries(s, owners).collect())
    assert got == [("1", "py.route", "/home"), ("2", "jpa.Repository", None), ("3", "nest.Get", "all"), ("3", "ts.axios", "/p"), ("3", "ts.fetch", "/api"), ("5", "rust.main", None), ("6", "http.route", "GET /q"), ("6", "kafka.KafkaListener", "t1"), ("6", "spring.JdbcTemplate", None)]
    assert len({r[1] for r in classify.BOUNDARY_RULES}) == len(classify.BOUNDARY_RULES) == 48


BIG = {
    "pom.xml": "<project/>",
    "target/gen/Gen.java": "class Gen {}",
    "src/main/java/com/acme/target/Keep.java": "package com.acme.target;\npublic class Keep {}\n",
    ".gitignore": "*.gen.py\n!keep.gen.py\n/secret/\nlogs/\n",
    "a.gen.py": "x = 1\n", "keep.gen.py": "x = 1\n", "secret/s.py": "x = 1\n", "sub/secret/s.py": "x = 1\n", "sub/logs/l.py": "x = 1\n", "sub/.gitignore": "!logs/\nbad.py\n", "sub/bad.py": "x = 1\n", ".hidden/h.py": "x = 1\n",
    "src/main/java/com/acme/Store.java": "package com.acme;\n/** Stores things. */\npublic interface Store {\n  void save(String key, int n);\n}\n",
    "src/main/java/com/acme/Disk.java": "package com.acme;\nimport org.springframework.jdbc.core.JdbcTemplate;\npublic class Disk implements Store {\n  private JdbcTemplate jdbc;\n  public static final int MAX_SIZE = 9;\n  public void save(String key, int n) { if (n > MAX_SIZE) { jdbc.update(\"x\"); } }\n  public void save(String key) { save(key, 1); }\n}\n",
    "src/main/java/com/acme/Memory.java": "package com.acme;\npublic class Memory extends Disk {\n  public void save(String key, int n) { }\n}\n",
    "src/main/java/com/acme/web/Api.java": "package com.acme.web;\nimport com.acme.*;\nimport com.acme.Store;\n@RestController\n@RequestMapping(\"/items\")\npublic class Api {\n  private final Store store;\n  public Api(Store store) { this.store = store; }\n  @GetMapping(\"/{id}\")\n  public String get(String id) { store.save(id, 2); Disk d = new Disk(); d.save(id); return id; }\n}\n",
    "src/test/java/com/acme/DiskTest.java": "package com.acme;\npublic class DiskTest {\n  @Test\n  public void saves() { Disk d = new Disk(); d.save(\"k\"); }\n}\n",
    "py/shop/__init__.py": "", "py/shop/base.py": "LIMIT_MAX = 3\n\nclass Base:\n    \"\"\"A base.\"\"\"\n\n    def go(self, n):\n        return n\n\n    def stop(self):\n        return LIMIT_MAX\n",
    "py/shop/car.py": "import requests\nfrom .base import Base\nfrom . import base\n\n\ndef handler(x):\n    return x\n\n\nclass Car(Base):\n    # the engine is made on first use\n    engine: Base\n\n    def __init__(self, spare: Base):\n        self.spare = spare\n\n    def go(self, n):\n        return super().go(n) + self.spare.stop() + self.engine.go(1)\n\n    def drive(self):\n        register(handler)\n        self.stop()\n        if base.LIMIT_MAX:\n            requests.get('http://x')\n        return self.go(2)\n",
    "ui/util.ts": "export type Id = string;\nexport const MAX_ITEMS = 5;\nexport function pad(x: Id) { return x; }\nexport default pad;\n",
    "ui/app.ts": "import { pad as p, MAX_ITEMS } from './util';\nimport axios from 'axios';\nimport merge from 'lodash/merge';\nexport class App {\n  run(items: string[]) {\n    if (items.length > MAX_ITEMS) { return axios.get('/api'); }\n    return items.map(p);\n  }\n}\nexport function start() { const a = new App(); return a.run([]); }\n",
    "rs/src/lib.rs": "mod db;\nuse crate::db::{Db, open as open_db};\npub fn start() -> Db { let d = open_db(3); d.put(1); crate::db::helper(); d }\n",
    "rs/src/db.rs": "pub const SIZE_MAX: u32 = 3;\npub trait Put { fn put(&self, n: u32); }\n/// A store.\npub struct Db { n: u32 }\nimpl Put for Db { fn put(&self, n: u32) { helper(); } }\npub fn open(n: u32) -> Db { if n > SIZE_MAX { panic!(\"x\") } Db { n } }\npub fn helper() {}\n",
    "docs/guide.md": "# Guide\nHow to.\n## Setup\nSee [the app](../ui/app.ts) and [notes](notes.md).\n### Deep\n# End\n", "docs/notes.md": "plain\n",
    "package.json": "{\"dependencies\": {\"axios\": \"1.0\", \"lodash\": \"4\"}}",
}


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("big")
    for name, text in BIG.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    manifest = spark.createDataFrame([("package.json", BIG["package.json"])], "path string, text string")
    files = code.scan_files(spark, str(root)).persist()
    syms = code.symbols(files).persist()
    nodes, edges, calls = code.build(syms, tables.package_dependencies(manifest))
    return files, syms, nodes.persist(), edges.persist(), calls


def test_ignored_and_built_files_are_left_out(big):
    want = {p for p in BIG if p.rsplit(".", 1)[-1] in ("java", "py", "ts", "rs", "md")} - {"target/gen/Gen.java", "a.gen.py", "secret/s.py", ".hidden/h.py", "sub/bad.py"}
    assert {r.path for r in big[0].select("path").collect()} == want
    totals = {r.language: (r.files, r.symbols) for r in code.index_totals(big[1]).collect()}
    assert totals["java"] == (6, 16) and totals["markdown"] == (2, 4)


def test_ignore_rules():
    hit = lambda text, path: [keeps for _, keeps, rule in code.ignore_rules(text) if __import__("re").search(rule, path)]
    assert hit("*.log\n# c\n\n!keep.log", "a/keep.log") == [False, True] and hit("/a/b", "x/a/b") == [] and hit("a/b", "a/b/c.py") == [False]
    assert hit("build/", "build") == [] and hit("build/", "x/build/y.py") == [False] and hit("a/**/z", "a/q/r/z") == [False] and hit("[ab].py", "a.py") == [False]


EDGES = [
    # containment
    ("folder:py", "folder:py/shop", "Contains"), ("folder:py/shop", "file:py/shop/car.py", "Contains"), ("file:py/shop/car.py", "class:py/shop/car.py:Car", "Contains"), ("class:py/shop/car.py:Car", "function:py/shop/car.py:Car.go", "Contains"), ("file:py/shop/car.py", "function:py/shop/car.py:Car.go", "Contains"),
    ("file:docs/guide.md", "heading:docs/guide.md:Guide", "Contains"), ("heading:docs/guide.md:Guide", "heading:docs/guide.md:Setup", "Contains"), ("heading:docs/guide.md:Setup", "heading:docs/guide.md:Deep", "Contains"), ("file:docs/guide.md", "heading:docs/guide.md:End", "Contains"),
    # hierarchies
    ("class:src/main/java/com/acme/Disk.java:Disk", "interface:src/main/java/com/acme/Store.java:Store", "Implements"), ("class:src/main/java/com/acme/Memory.java:Memory", "class:src/main/java/com/acme/Disk.java:Disk", "Extends"), ("class:rs/src/db.rs:Db", "interface:rs/src/db.rs:Put", "Implements"),
    ("function:src/main/java/com/acme/Memory.java:Memory.save", "function:src/main/java/com/acme/Disk.java:Disk.save", "Overrides"), ("function:src/main/java/com/acme/Disk.java:Disk.save", "function:src/main/java/com/acme/Store.java:Store.save", "Overrides"), ("function:py/shop/car.py:Car.go", "function:py/shop/base.py:Base.go", "Overrides"),
    # calls by type, with the implementations that may run, by arity, inherited, through fields and imports
    ("function:src/main/java/com/acme/web/Api.java:Api.get", "function:src/main/java/com/acme/Store.java:Store.save", "Calls"), ("function:src/main/java/com/acme/web/Api.java:Api.get", "function:src/main/java/com/acme/Memory.java:Memory.save", "Calls"),
    ("function:src/main/java/com/acme/web/Api.java:Api.get", "function:src/main/java/com/acme/Disk.java:Disk.save#2", "Calls"), ("function:src/main/java/com/acme/web/Api.java:Api.get", "class:src/main/java/com/acme/Disk.java:Disk", "Instantiates"),
    ("function:py/shop/car.py:Car.drive", "function:py/shop/base.py:Base.stop", "Calls"), ("function:py/shop/car.py:Car.go", "function:py/shop/base.py:Base.stop", "Calls"), ("function:py/shop/car.py:Car.go", "function:py/shop/base.py:Base.go", "Calls"), ("function:py/shop/car.py:Car.drive", "function:py/shop/car.py:Car.go", "Calls"),
    ("function:ui/app.ts:start", "class:ui/app.ts:App", "Instantiates"), ("function:ui/app.ts:start", "function:ui/app.ts:App.run", "Calls"),
    ("function:rs/src/lib.rs:start", "function:rs/src/db.rs:open", "Calls"), ("function:rs/src/lib.rs:start", "function:rs/src/db.rs:helper", "Calls"), ("function:rs/src/db.rs:open", "class:rs/src/db.rs:Db", "Instantiates"), ("function:rs/src/db.rs:Db.put", "function:rs/src/db.rs:helper", "Calls"),
    # constants, functions passed on
    ("function:py/shop/base.py:Base.stop", "variable:py/shop/base.py:LIMIT_MAX", "Uses"), ("function:py/shop/car.py:Car.drive", "variable:py/shop/base.py:LIMIT_MAX", "Uses"), ("function:ui/app.ts:App.run", "variable:ui/util.ts:MAX_ITEMS", "Uses"), ("function:rs/src/db.rs:open", "constant:rs/src/db.rs:SIZE_MAX", "Uses"),
    ("function:py/shop/car.py:Car.drive", "function:py/shop/car.py:handler", "References"), ("function:ui/app.ts:App.run", "function:ui/util.ts:pad", "References"), ("function:src/main/java/com/acme/Disk.java:Disk.save", "variable:src/main/java/com/acme/Disk.java:Disk.MAX_SIZE", "Uses"),
    # routes, imports, exports, packages
    ("file:src/main/java/com/acme/web/Api.java", "route:GET /items/{id}", "Contains"), ("route:GET /items/{id}", "function:src/main/java/com/acme/web/Api.java:Api.get", "References"), ("file:py/shop/car.py", "file:py/shop/base.py", "Imports"), ("file:py/shop/car.py", "class:py/shop/base.py:Base", "References"),
    ("file:src/main/java/com/acme/web/Api.java", "class:src/main/java/com/acme/Memory.java:Memory", "References"), ("file:src/main/java/com/acme/web/Api.java", "file:src/main/java/com/acme/Store.java", "Imports"), ("file:ui/app.ts", "file:ui/util.ts", "Imports"), ("file:ui/app.ts", "dep:axios", "DependsOn"), ("file:ui/app.ts", "dep:lodash", "DependsOn"),
    ("file:docs/guide.md", "file:ui/app.ts", "Imports"), ("file:docs/guide.md", "file:docs/notes.md", "Imports"), ("file:rs/src/lib.rs", "file:rs/src/db.rs", "Imports"), ("file:ui/app.ts", "class:ui/app.ts:App", "Exports"), ("file:ui/util.ts", "function:ui/util.ts:pad", "Exports"),
]


def test_a_full_graph(big):
    _, _, nodes, edges, _ = big
    got = {tuple(r) for r in edges.collect()}
    assert not [e for e in EDGES if e not in got], [e for e in EDGES if e not in got]
    assert len(got) == edges.count()
    ids = {r.id for r in nodes.collect()}
    assert not [e for e in got if not {e[0], e[1]} <= ids], "edges have both ends"
    assert not any(t == "function:py/shop/base.py:Base.go" and s == "function:py/shop/base.py:Base.go" for s, t, _ in got)


def test_how_calls_were_resolved(big):
    got = {}
    for r in big[4].collect():
        got.setdefault((r.source.rsplit(":")[-1], r.name), set()).add(r.strategy)
    assert got["Api.get", "save"] == {"typed", "dispatch"} and got["start", "open_db"] == {"qualified"} and got["Car.drive", "register"] == {None} and got["Car.drive", "get"] == {None}


def test_facts_of_a_parsed_tree_answer_every_preset(big):
    from weftgraph.plans import envelope
    from weftgraph.plans.presets import PRESETS, REQUIRED

    _, _, nodes, edges, _ = big
    n = {r.id: r for r in nodes.collect()}
    disk, api, car = n["class:src/main/java/com/acme/Disk.java:Disk"], n["function:src/main/java/com/acme/web/Api.java:Api.get"], n["class:py/shop/car.py:Car"]
    assert disk.members == 4 and n["class:rs/src/db.rs:Db"].members == 1 and disk.node_type == "Class" and disk.qualified_name == "com.acme.Disk"
    assert (api.route, api.boundary_in, api.boundary_kinds, api.boundary_detail, api.annotations) == ("GET /items/{id}", 1, "http.endpoint", "GET /items/{id}", "GetMapping")
    assert n["function:src/main/java/com/acme/Disk.java:Disk.save"].boundary_kinds == "db.access" and n["function:py/shop/car.py:Car.drive"].boundary_kinds == "http.client"
    assert (car.comment_lines, car.loc, car.has_comments, car.has_doc) == (1, 16, 1, 0) and n["class:py/shop/base.py:Base"].doc_lines == 1
    assert n["function:src/test/java/com/acme/DiskTest.java:DiskTest.saves"].is_test == 1 and n["file:src/test/java/com/acme/DiskTest.java"].classification == "test"
    assert n["dep:axios"].description == "version 1.0" and n["folder:docs"].classification == "documentation" and n["heading:docs/guide.md:Setup"].node_type == "Concept"
    assert n["function:py/shop/base.py:Base.stop"].in_degree == 2
    given = {"target": "src/main/java/com/acme/Disk.java", "files": ["py/shop/base.py"], "symbol": "function:src/main/java/com/acme/Disk.java:Disk.save", "from_prefix": "ui", "to_prefix": "ui"}
    for p in PRESETS.values():
        page = envelope.analyze(nodes, edges, name=p.name, **{k: given.get(k, v) for k, v in p.params.items() if k in given or v is not REQUIRED})
        assert not [x for x in page.caveats if "NOT" in x], (p.name, page.caveats)
    assert [r[0] for r in envelope.analyze(nodes, edges, name="retest_scope", target=given["target"]).rows] == ["src/test/java/com/acme/DiskTest.java"]


def test_another_language_can_be_registered(spark):
    from weftgraph.sources import languages

    languages.register("toy", "toy", lambda text, path: [dict(kind="file", name=""), *(dict(kind="function", name=x, start=k, end=k, qualified=f"{path}.{x}") for k, x in enumerate(text.split("\n"), 1) if x)])
    try:
        assert [s["name"] for s in languages.parse("f\ng\n", "toy", "a.toy")] == ["", "f", "g"] and languages.languages()["toy"] == "toy"
    finally:
        del languages.PARSERS["toy"], languages.ENDINGS["toy"]


def test_nearest_paths_against_all_pairs(spark):
    """The longest common beginning, the least path of several; never all pairs of a name."""
    import os
    import random

    r = random.Random(3)
    path = lambda: "/".join(r.choice(["a", "ab", "abc", "b", "lib"]) for _ in range(r.randint(1, 4)))
    have = sorted({(f"{path()}/{r.choice(['index.ts', 'x.ts'])}") for _ in range(60)})
    ask = [(f"k{i}", f"{path()}/m.ts", r.choice(["index.ts", "x.ts", "none.ts"])) for i in range(80)]
    named = spark.createDataFrame([(p, "id:" + p, p.rsplit("/", 1)[1]) for p in have], "target_path string, target string, file string")
    got = {x.key: x.target for x in code.nearest_paths(spark.createDataFrame(ask, "key string, path string, file string"), named).collect()}
    want = {}
    for key, p, f in ask:
        mine = [h for h in have if h.endswith("/" + f)]
        if mine:
            want[key] = "id:" + min(mine, key=lambda h: (-len(os.path.commonprefix([p, h])), h))
    assert got == want and len(want) > 40


def test_containers_stay_containers():
    from weftgraph.sources.languages.braces import base_type

    assert [base_type(x) for x in ("&mut Vec<Foo>", "Option<Db>", "Box<dyn Store>", "  Db  ", "Promise<Db>", "List<? extends Db>", "Db[]", "readonly Db")] == ["Vec", "Option", "Box", "Db", "Promise", "List", "Db", "Db"]
