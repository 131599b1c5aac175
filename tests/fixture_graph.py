"""A small graph with known answers: an oven, a till and a check of the till."""

from weftgraph.schema import EDGES, NODES

OVEN, TILL, CHECK = "bakery/oven.py", "bakery/till.py", "checks/test_till.py"

_N = [
    # type, file, name, loc, code, comment, doc, is_test, members, boundary (kind, protocol, detail, inbound)
    ("Function", OVEN, "bake", 141, 103, 17, 1, 0, None, ("db.access", "jpa", "loaves", 0)),
    ("Function", OVEN, "knead", 33, 28, 0, 0, 0, None, None),
    ("Function", TILL, "charge", 71, 52, 9, 0, 0, None, ("http.endpoint", "http", "PUT /sale", 1)),
    ("Function", TILL, "idle", 12, 10, 0, 0, 0, None, None),
    ("Class", OVEN, "Tray", 210, 160, 25, 2, 0, 5, None),
    ("Interface", TILL, "Drawer", 51, 40, 3, 0, 0, 2, None),
    ("Function", CHECK, "test_charge", 27, 24, 1, 0, 1, None, None),
    ("File", OVEN, "", 430, 310, 70, 0, 0, None, None),
    ("File", TILL, "", 150, 120, 14, 0, 0, None, None),
    ("File", CHECK, "", 40, 35, 2, 0, 1, None, None),
]
_E = [
    ("charge", "bake", "Calls"), ("bake", "knead", "Calls"), ("idle", "knead", "Calls"), ("test_charge", "charge", "Calls"), ("Drawer", "charge", "References"), ("Tray", "bake", "References"), ("charge", "Tray", "References"),
    (TILL, OVEN, "Imports"), (CHECK, TILL, "Imports"),
]


def identity(kind: str, file: str, name: str) -> str:
    return f"{kind.lower()}:{file}" + (f":{name}" if name else "")


IDS = {name or file: identity(kind, file, name) for kind, file, name, *_ in _N}


def make(spark):
    rows = []
    for kind, file, name, loc, code, comment, doc, test, members, b in _N:
        own = IDS[name or file]
        users = sum(IDS[t] == own for _, t, _ in _E)
        v = dict(id=own, name=name or file, node_type=kind, file=file, start_line=1, end_line=loc, description=None, loc=loc, code_lines=code, comment_lines=comment, doc_lines=doc, params=2, max_nesting=3, members=members, has_doc=int(doc > 0), has_comments=int(comment + doc > 0), is_test=test)
        v |= dict(in_degree=users, out_degree=sum(IDS[s] == own for s, _, _ in _E), boundary=int(b is not None), boundary_in=b[3] if b else 0, boundary_out=1 - b[3] if b else 0, language="python", classification="test" if test else "service", folder=file.rsplit("/", 1)[0])
        v |= dict(boundary_kinds=b and b[0], boundary_protocols=b and b[1], boundary_detail=b and b[2])
        rows.append(tuple(v.get(c) for c in NODES.names))
    return spark.createDataFrame(rows, NODES), spark.createDataFrame([(IDS[s], IDS[t], k) for s, t, k in _E], EDGES)
