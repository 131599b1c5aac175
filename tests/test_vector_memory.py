"""Memory of a task of the exact vector search."""

import tracemalloc

import numpy as np
import pandas as pd

from weftgraph.operators import retrieval


class Vectors:
    """Stands for a table and keeps the function that its tasks would run."""

    dtypes = [("id", "bigint"), ("vector", "array<double>")]

    def select(self, *_):
        return self

    def mapInPandas(self, part, _):
        return part


class Query:
    def __init__(self, k, v):
        self.query_id, self.vector = k, v


def test_a_task_holds_the_best_of_each_query_and_a_small_block_of_scores():
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (6000, 8)).astype(float)  # many equal scores
    x[0] = 1
    queries = [Query(k, x[k]) for k in range(0, 6000, 4)]
    part = retrieval._block_search(Vectors(), queries, 5, "bigint")
    place = rng.permutation(6000)
    batches = [pd.DataFrame({"id": p, "vector": list(x[p])}) for p in np.split(place, 2)]
    tracemalloc.start()
    found = pd.concat(part(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1] >> 20
    tracemalloc.stop()
    assert peak < 60, peak
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for k in (0, 400, 5996):
        s = np.round(unit @ unit[k], 9)
        assert found[found.query_id == k].id.tolist() == np.lexsort((np.arange(6000), -s))[:5].tolist()
