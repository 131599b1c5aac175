"""Nothing is left out where names have many partners or lie far apart."""

from weftgraph.operators import retrieval as r
from weftgraph.sources import code
from weftgraph.streaming.source_graph import SourceGraph


def listing(spark, language, files):
    return spark.createDataFrame([(p, language, t.encode()) for p, t in files.items()], "path string, language string, content binary")


def test_all_related_names(spark):
    """F8: a node with more neighbours than the cap."""
    nodes = spark.createDataFrame([(f"n{k}", f"name{k:03}") for k in range(151)], "id string, name string")
    edges = spark.createDataFrame([("n0", f"n{k}") if k % 2 else (f"n{k}", "n0") for k in range(1, 151)], "source string, target string")
    found = {x.id: x.related for x in r.related_names(nodes, edges, cap=None).collect()}
    assert found["n0"] == [f"name{k:03}" for k in range(1, 151)] and found["n7"] == ["name000"]


def chain(n):
    """Files of classes that follow each other; the first and the last have the method."""
    files = {}
    for k in range(n):
        head, base = (f"from .f{k - 1} import C{k - 1}\n", f"(C{k - 1})") if k else ("", "")
        body = "    def stop(self):\n        pass\n" if k in (0, n - 1) else "    pass\n"
        files[f"a/f{k}.py"] = f"{head}class C{k}{base}:\n{body}"
    return files


def test_methods_far_above(spark, tmp_path):
    """what a method overrides may lie any number of levels above it, in a graph built at once and in one that follows changes."""
    files = listing(spark, "python", chain(12))
    want = [("function:a/f11.py:C11.stop", "function:a/f0.py:C0.stop")]
    edges = code.build_graph(code.symbols(files))[1].where("edge_type = 'Overrides'")
    assert [(x.source, x.target) for x in edges.collect()] == want
    store = SourceGraph(spark, str(tmp_path / "s"))
    for name, lost in (("before", "a/f0.py"), ("now", "")):
        store.update(name, files.where(f"path != '{lost}'"))
    assert [(x.source, x.target) for x in store.graph()[1].where("edge_type = 'Overrides'").collect()] == want


def test_hierarchy_with_a_ring_ends(spark):
    """a name that no type of a ring has is looked for once round."""
    ring = {f"a/f{k}.py": f"from .f{(k + 1) % 12} import C{(k + 1) % 12}\nclass C{k}(C{(k + 1) % 12}):\n" + ("    def go(self):\n        self.lost()\n" if k == 0 else "    pass\n") for k in range(12)}
    files = listing(spark, "python", ring | {"b.py": "class D:\n    def lost(self):\n        pass\n"})
    edges = code.build_graph(code.symbols(files))[1]
    assert edges.where("edge_type = 'Extends'").count() == 12 and edges.where("edge_type in ('Calls', 'Overrides')").isEmpty()


def test_all_implementations_are_called(spark):
    """a call of an interface's method leads to more than eight implementations, and to those far below."""
    files = {"a/Store.java": "package a;\npublic interface Store { void put(int a); }\n"}
    files |= {f"a/S{k:02}.java": f"package a;\npublic class S{k:02} implements Store {{ public void put(int a) {{ }} }}\n" for k in range(12)}
    files |= {f"a/T{k:02}.java": f"package a;\npublic class T{k:02} extends {f'T{k - 1:02}' if k else 'S00'} {{ " + ("public void put(int a) { } " if k == 11 else "") + "}\n" for k in range(12)}
    files["a/User.java"] = "package a;\npublic class User {\n  private Store store;\n  public void go() { store.put(1); }\n}\n"
    edges = code.build_graph(code.symbols(listing(spark, "java", files)))[1].where("edge_type = 'Calls'")
    want = {f"function:a/{x}.java:{x}.put" for x in ("Store", "T11", *(f"S{k:02}" for k in range(12)))}
    assert {x.target for x in edges.where("source = 'function:a/User.java:User.go'").collect()} == want


def test_all_of_a_package_is_imported(spark):
    """a wildcard import of a package of more than 64 classes."""
    files = {f"p/C{k:02}.java": f"package p;\npublic class C{k:02} {{ }}\n" for k in range(70)}
    files["q/User.java"] = "package q;\nimport p.*;\npublic class User { }\n"
    edges = code.build_graph(code.symbols(listing(spark, "java", files)))[1].where("source = 'file:q/User.java'")
    assert edges.where("edge_type = 'References'").count() == 70 and edges.where("edge_type = 'Imports'").count() == 70
