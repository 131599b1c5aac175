"""Retrieval: exact vector search, BM25 over postings, rank fusion, diversity, context budgets.

Queries are a table, too: every operator takes a DataFrame of queries and ranks
within each, so that a batch of queries is one job.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import exploded_tokens
from ..session import cut
from .graph import personalized_pagerank
from .reach import bfs

c = F.col
K1, RRF_K, MAX_DIMS, NAME_WEIGHT, CODE_WEIGHT, MAX_QUERIES, MAX_TOKENS, MAX_SCORES, BLOCK_VECTORS = 1.2, 60, 512, 1.0, 0.35, 4096, 200_000, 500_000, 512


def _ranked(df: DataFrame, k: int, score: str = "score", by: str = "query_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), "id")
    return df.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10, keep=None) -> DataFrame:
    """(query_id, id, score, rank) by cosine. vectors: (id, vector); queries: (query_id, vector).

    The queries go through in blocks of ``MAX_QUERIES``, each of which is sent to every task and is one pass over the
    vectors. Each task keeps its own best k for each query, so that only those are shuffled. Vectors of another width
    or of length zero score 0.
    """
    if keep is not None:
        vectors = vectors.where(keep)
    found, block, width = None, [], None
    for r in queries.select("query_id", "vector").toLocalIterator():
        if block and (len(block) == MAX_QUERIES or len(r.vector) != width):
            part = _block_search(vectors, block, k, dict(queries.dtypes)["query_id"])
            found, block = part if found is None else found.unionByName(part), []
        block.append(r)
        width = len(r.vector)
    if block:
        part = _block_search(vectors, block, k, dict(queries.dtypes)["query_id"])
        found = part if found is None else found.unionByName(part)
    if found is None:
        kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["id"]
        found = vectors.sparkSession.createDataFrame([], "query_id {}, id {}, score double".format(*kinds))
    return _ranked(found, k)


def _block_search(vectors: DataFrame, rows: list, k: int, kind: str) -> DataFrame:
    ids = [r.query_id for r in rows]
    matrix = np.array([r.vector for r in rows], np.float64).reshape(len(rows), -1)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def part(batches):
        best_names, best_scores = None, None  # of each query the best k so far
        for batch in batches:
            good = batch["vector"].map(lambda v: v is not None and len(v) == matrix.shape[1])
            batch = batch[good].sort_values("id")
            for lo in range(0, len(batch), BLOCK_VECTORS):  # so that the scores of a block of queries stay small
                some = batch.iloc[lo : lo + BLOCK_VECTORS]
                x = np.stack(some["vector"].to_numpy()).astype(np.float64)
                s = np.round(matrix @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T, 9)  # so that copies tie exactly
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                names, scores = some["id"].to_numpy()[top], np.take_along_axis(s, top, 1)
                if best_names is not None:
                    names, scores = np.concatenate([best_names, names], 1), np.concatenate([best_scores, scores], 1)
                    for q in range(len(ids)):
                        order = np.lexsort((names[q], -scores[q]))
                        names[q], scores[q] = names[q][order], scores[q][order]
                best_names, best_scores = names[:, :k].copy(), scores[:, :k].copy()
        if best_names is not None:
            yield pd.DataFrame({"query_id": np.repeat(np.array(ids), best_names.shape[1]), "id": best_names.ravel(), "score": best_scores.ravel()})

    return vectors.select("id", "vector").mapInPandas(part, f"query_id {kind}, id {dict(vectors.dtypes)['id']}, score double")


def term_frequencies(docs: DataFrame, text: str = "text", weight: float = NAME_WEIGHT, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """(``by``, token, tf): weighted occurrences. Where the texts have been dealt by id, their tokens aren't shuffled."""
    return exploded_tokens(docs, text, *by).groupBy(*by, "token").agg((F.count("*") * weight).alias("tf"))


def postings(docs: DataFrame, text: str = "text", weight: float = NAME_WEIGHT) -> DataFrame:
    """(id, token, w): saturated term frequencies. Texts are dealt by id, not their tokens, which take more room."""
    return term_frequencies(docs.repartition("id"), text, weight).select("id", "token", (c("tf") * (K1 + 1) / (c("tf") + K1)).alias("w"))


def document_vectors(docs: DataFrame, name: str = "name_text", code: str = "code", cap: int = MAX_DIMS) -> DataFrame:
    """(id, token, w): what stands for each document in keyword search: its name text with weight 1, its code with 0.35, saturated, the ``cap`` tokens with the most weight times rarity.

    docs: (id, name_text, code).
    """
    part = lambda column, weight: exploded_tokens(docs.select("id", F.coalesce(column, F.lit("")).alias("t")), "t", "id").withColumn("x", F.lit(weight))
    tf = part(name, NAME_WEIGHT).unionByName(part(code, CODE_WEIGHT)).groupBy("id", "token").agg(F.sum("x").alias("tf"))
    post = cut(tf.select("id", "token", (c("tf") * (K1 + 1) / (c("tf") + K1)).alias("w")))
    return capped(post, document_frequency(post), docs.count(), cap)


def capped(post: DataFrame, df: DataFrame, n: int, cap: int = MAX_DIMS) -> DataFrame:
    rare = post.join(idf(df, n), "token")
    w = Window.partitionBy("id").orderBy(F.desc(c("w") * c("idf")), "token")
    return rare.withColumn("r", F.row_number().over(w)).where(c("r") <= cap).select("id", "token", "w")


def document_frequency(post: DataFrame) -> DataFrame:
    """(token, df). Postings have each token of a document once."""
    return post.groupBy("token").agg(F.count("*").alias("df"))


def idf(df: DataFrame, n: int) -> DataFrame:
    """(token, idf) from document frequencies and the number of documents."""
    return df.select("token", F.log(1 + (n - c("df") + 0.5) / (c("df") + 0.5)).alias("idf"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token, qtf)."""
    return exploded_tokens(queries, "text", "query_id").groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def bm25(post: DataFrame, queries: DataFrame, n: int, k: int = 10, df: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank). queries: (query_id, text). The document half is in the postings, rarity in the query.

    Only postings of the queries' tokens are counted and shuffled; ``df`` gives stored document frequencies. Up to
    ``MAX_TOKENS`` (query, token) pairs are sent to every task, so that a frequent token isn't one task's; more are joined.
    """
    q = cut(query_tokens(queries))
    few = F.broadcast if q.count() <= MAX_TOKENS else (lambda x: x)
    post = cut(post.join(few(q.select("token").distinct()), "token", "left_semi"))
    q = q.join(idf(document_frequency(post) if df is None else df, n), "token", "left")
    q = cut(q.select("query_id", "token", (c("qtf") * F.coalesce("idf", F.log(F.lit(1 + (n - 0.5) / 1.5)))).alias("qw")))
    scored = dealt(post, n, q).join(few(q), "token").groupBy("query_id", "id").agg(F.round(F.sum(c("qw") * c("w")), 9).alias("score"))  # rounded, so that copies tie exactly
    return _ranked(scored, k)


def dealt(post: DataFrame, n: int, q: DataFrame) -> DataFrame:
    """The postings of ``n`` documents dealt by document, to as many tasks as keep the scores of each in memory: those of a document for all queries are then summed where they arise.

    q: (query_id, ...), which was cut.
    """
    asked = q.select("query_id").distinct().count()
    least = min(post.sparkSession.sparkContext.defaultParallelism, n // 1000)
    return post.repartition(max(1, least, n * asked // MAX_SCORES), "id")


def hashed_words(width: int = 256):
    """The default embedder, which needs no model: words hashed into ``width`` places with a sign, scaled to length one."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(width)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % width] += 1 if h >> 63 else -1
            out.append((v / max(np.linalg.norm(v), 1e-12)).tolist())
        return out

    return embed


def embed(texts: DataFrame, embedder=None, width: int = 256, batch: int = 32, text: str = "text") -> DataFrame:
    """``texts`` with ``vector``: what ``embedder`` (a function from a list of texts to vectors in their order) gives, ``batch`` texts a call.

    A call that fails, or gives another number of vectors or another width, leaves empty vectors, which a later run
    finds by ``pending_vectors``; the job goes on.
    """
    made = embedder or hashed_words(width)

    def run(batches):
        for b in batches:
            vectors: list[list[float]] = []
            for at in range(0, len(b), batch):
                part = [x or "" for x in b[text].iloc[at : at + batch]]
                try:
                    got = [[float(y) for y in v] for v in made(part)]
                except Exception:  # the embedder's own errors, whatever they are
                    got = []
                good = len(got) == len(part) and all(len(v) == width for v in got)
                vectors += got if good else [[] for _ in part]
            yield b.assign(vector=vectors)

    return texts.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in texts.dtypes) + ", vector array<double>")


def pending_vectors(nodes: DataFrame) -> DataFrame:
    """The rows that still need a vector."""
    return nodes.where(c("vector").isNull() | (F.size("vector") == 0))


def storage_report(nodes: DataFrame, post: DataFrame) -> DataFrame:
    """(id, tokens, weight, has_vector): how much of each node keyword and vector search hold."""
    held = post.groupBy("id").agg(F.count("*").alias("tokens"), F.sum("w").alias("weight"))
    return nodes.join(held, "id", "left").select("id", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce(F.size("vector") > 0, F.lit(False)).alias("has_vector"))


def semantic_search(vectors: DataFrame, queries: DataFrame, k: int = 10, embedder=None, width: int = 256, types=None) -> DataFrame:
    """(query_id, id, score, rank): ``vector_search`` for queries (query_id, text). vectors: (id, vector, node_type); ``types``: only nodes of these."""
    asked = cut(embed(queries.select("query_id", "text"), embedder, width).where(F.size("vector") > 0))
    return vector_search(vectors, asked.select("query_id", "vector"), k, None if types is None else c("node_type").isin(*types))


def rrf(*channels: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) tables."""
    every = channels[0].select("query_id", "id", "rank")
    for ch in channels[1:]:
        every = every.unionByName(ch.select("query_id", "id", "rank"))
    return _ranked(every.groupBy("query_id", "id").agg(F.sum(1.0 / (RRF_K + c("rank"))).alias("score")), k)


def hybrid(vectors: DataFrame, post: DataFrame, query_vectors: DataFrame, query_texts: DataFrame, n: int, k: int = 10) -> DataFrame:
    """Dense and sparse search over a pool of max(4k, 20), fused."""
    pool = max(4 * k, 20)
    return rrf(vector_search(vectors, query_vectors, pool), bm25(post, query_texts, n, pool), k=k)


def mmr(candidates: DataFrame, query: list[float] | None = None, k: int = 10, trade: float = 0.5) -> DataFrame:
    """(query_id, id, pick): greedy choice of relevance minus likeness to what is chosen. candidates: (query_id, id, vector), one group a query.

    Without ``query`` the candidates' column ``query`` holds the vector of their query.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        q = np.array(pdf["query"].iloc[0] if query is None else query, np.float64)
        x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        gain, worst, left, out = unit @ (q / max(np.linalg.norm(q), 1e-12)), np.zeros(len(x)), np.ones(len(x), bool), []
        for _ in range(min(k, len(x))):
            best = int(np.argmax(np.where(left, trade * gain - (1 - trade) * worst, -np.inf)))
            out.append(best)
            left[best] = False
            worst = np.maximum(worst, unit @ unit[best])
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "id": pdf["id"].to_numpy()[out], "pick": range(1, len(out) + 1)})

    kinds = dict(candidates.dtypes)
    return candidates.groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, id {kinds['id']}, pick long")


def char_budget(ranked: DataFrame, budget: int, k: int, length: str = "chars") -> DataFrame:
    """Rows in rank order until their lengths go over the budget; always the first, never more than k."""
    w = Window.partitionBy("query_id").orderBy("rank")
    total = ranked.where(c("rank") <= k).withColumn("used", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return total.where((c("used") <= budget) | (c("rank") == 1))


def diversify(ranked: DataFrame, group: str = "file", cap: int = 2) -> DataFrame:
    """The first ``cap`` of each group before the others, ranks renumbered."""
    inner = F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))
    w = Window.partitionBy("query_id").orderBy(c("late"), c("rank"))
    out = ranked.withColumn("late", (inner > cap).cast("int")).withColumn("place", F.row_number().over(w))
    return out.drop("late")


def related_names(nodes: DataFrame, edges: DataFrame, cap: int | None = 128) -> DataFrame:
    """(id, related): sorted distinct names of the neighbours both ways, the first ``cap`` or, with None, all."""
    both = edges.select(c("source").alias("id"), c("target").alias("other")).unionByName(edges.select(c("target").alias("id"), c("source").alias("other"))).distinct()
    names = both.join(nodes.select(c("id").alias("other"), "name"), "other").select("id", "name").distinct()
    if cap is not None:
        w = Window.partitionBy("id").orderBy("name")
        names = names.withColumn("r", F.row_number().over(w)).where(c("r") <= cap)
    return names.groupBy("id").agg(F.sort_array(F.collect_list("name")).alias("related"))


def keyword_search(nodes: DataFrame, keyword: str, types=None) -> DataFrame:
    """Nodes with the keyword in name or description, in any letter case; an empty keyword matches all."""
    k = keyword.lower()
    hit = F.lower("name").contains(k) | F.coalesce(F.lower("description").contains(k), F.lit(False))
    return nodes.where(hit & (c("node_type").isin(*types) if types else F.lit(True)))


def name_search(nodes: DataFrame, text: str, k: int = 10, types=None) -> DataFrame:
    """(id, distance): names that hold the text as written, by id, the rank as distance."""
    hit = nodes.where(c("name").contains(text) & (c("node_type").isin(*types) if types else F.lit(True)))
    return hit.orderBy("id").limit(k).select("id", F.row_number().over(Window.orderBy("id")).cast("long").alias("distance"))


def search_kb(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10, budget: int = 60_000, expand: bool = True, iterations: int = 30) -> DataFrame:
    """(id, score, label, chars, rank): seeds (id, rank, dense 0/1) ranked by personalised PageRank from them, within the budget."""
    if not expand:
        ranked = seeds.select("id", (1.0 / (RRF_K + c("rank"))).alias("score"))
    else:
        ids = [r.id for r in seeds.orderBy("rank").limit(max(16, k)).select("id").collect()]
        ranked = personalized_pagerank(edges, ids, "both", None, 0.15, iterations, 4 * k)
    label = F.when(c("dense") == 1, "semantic").when(c("dense") == 0, "keyword").otherwise("graph")
    out = ranked.join(nodes.select("id", F.coalesce(F.length("description"), F.length("name")).alias("chars")), "id").join(seeds.select("id", "dense"), "id", "left")
    out = out.withColumn("query_id", F.lit(0)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return char_budget(out, budget, k).select("id", "score", label.alias("label"), "chars", "rank")


def search_kb_mmr(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, query: list[float], k: int = 10, budget: int = 60_000, hops: int = 1, trade: float = 0.5) -> DataFrame:
    """(id, label, chars, rank): seeds (id, rank, dense 0/1) and what lies within ``hops`` of them, chosen for likeness to the query and unlikeness to each other, within the budget.

    nodes: (id, name, description, vector). A node without a vector of the query's width isn't a candidate.
    """
    few = cut(seeds.orderBy("rank", "id").limit(max(16, k)))
    near = bfs(edges, few.select("id"), hops, None, "both").select("id")
    pool = nodes.join(near, "id", "left_semi").where(F.size("vector") == len(query))
    picked = mmr(pool.select(F.lit(0).alias("query_id"), "id", "vector"), query, k, trade)  # a few hundred candidates
    label = F.when(c("dense") == 1, "semantic").when(c("dense") == 0, "keyword").otherwise("graph")
    out = picked.join(nodes.select("id", F.coalesce(F.length("description"), F.length("name")).alias("chars")), "id").join(few.select("id", "dense"), "id", "left").withColumnRenamed("pick", "rank")
    return char_budget(out, budget, k).select("id", label.alias("label"), "chars", "rank")


def rag_context(hits: DataFrame, budget: int = 12_000) -> DataFrame:
    """(query_id, context, used): numbered blocks ``[#1] name (file:line)`` with their texts, in rank order until the next one doesn't fit; the first always.

    hits: (query_id, rank, name, file, start_line, text).
    """
    where = F.when(c("file").isNotNull(), F.concat(F.lit(" ("), "file", F.coalesce(F.concat(F.lit(":"), c("start_line").cast("string")), F.lit("")), F.lit(")"))).otherwise(F.lit(""))
    block = F.concat(F.lit("[#"), c("rank").cast("string"), F.lit("] "), "name", where, F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = hits.withColumn("block", block).withColumn("used", F.sum(F.length("block") + 2).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    over = F.min(F.when((c("used") > budget) & (c("rank") > 1), c("rank"))).over(Window.partitionBy("query_id"))
    kept = rows.withColumn("over", over).where(c("over").isNull() | (c("rank") < c("over")))
    packed = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return packed.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"), F.size("b").alias("used"))


def chat_messages(contexts: DataFrame, history: DataFrame, questions: DataFrame, system: str, budget: int = 2000) -> DataFrame:
    """(query_id, messages): system, context, the latest turns within the budget, and the question, as (role, text) structs.

    contexts: (query_id, context); history: (query_id, turn, role, text); questions: (query_id, text).
    """
    turns = rag_messages(history.withColumnRenamed("query_id", "conv_id"), budget).select(c("conv_id").alias("query_id"), "messages")
    said = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("text"))
    j = questions.join(contexts, "query_id", "left").join(turns, "query_id", "left")
    none = F.array().cast("array<struct<role:string,text:string>>")
    known = F.when(c("context").isNotNull(), F.array(said("system", F.concat(F.lit("Context:\n"), "context")))).otherwise(none)
    return j.select("query_id", F.concat(F.array(said("system", F.lit(system))), known, F.coalesce("messages", none), F.array(said("user", c("text")))).alias("messages"))


def rag_messages(turns: DataFrame, budget: int = 2000) -> DataFrame:
    """(conv_id, messages, chars): the latest turns of each conversation within the budget, at least one, oldest first, as role-text structs."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"))
    t = turns.withColumn("chars", F.length("text")).withColumn("used", F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("back", F.row_number().over(w))
    kept = t.where((c("used") <= budget) | (c("back") == 1))
    packed = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"), F.sum("chars").alias("chars"))
    return packed.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"), "chars")
