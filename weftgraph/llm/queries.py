"""The registered queries of this subpackage: each applies one operator, as it is meant to run, to its whole table."""

from __future__ import annotations

from . import centroids, decontam, divergence, gru_lm, jaccard, langid, linerules, pieces, pii, quality_nb, secret_scan, substring, token_counts
from .common import read_table


def _documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


QUERIES = {
    "op1_secret_scan": lambda spark, sf_dir: secret_scan.scan(_documents(spark, sf_dir)),
    "op2_token_counts": lambda spark, sf_dir: token_counts.count_tokens(_documents(spark, sf_dir)),
    "op3_substring_dedup": lambda spark, sf_dir: substring.dedup(_documents(spark, sf_dir)),
    "op4_pii_pseudonyms": lambda spark, sf_dir: pii.digest(_documents(spark, sf_dir)),
    "op5_jaccard_join": lambda spark, sf_dir: jaccard.links(_documents(spark, sf_dir)),
    "op6_quality_classifier": lambda spark, sf_dir: quality_nb.score(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels")),
    "op7_gru_lm": lambda spark, sf_dir: gru_lm.score(_documents(spark, sf_dir)),
    "op8_sentencepiece": lambda spark, sf_dir: pieces.digest(_documents(spark, sf_dir)),
    "op9_decontamination": lambda spark, sf_dir: decontam.matches(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark")),
    "op10_quality_rules": lambda spark, sf_dir: linerules.digest(_documents(spark, sf_dir)),
    "op11_centroid_clustering": lambda spark, sf_dir: centroids.cluster(read_table(spark, sf_dir, "embeddings")),
    "op12_source_divergence": lambda spark, sf_dir: divergence.audit(_documents(spark, sf_dir)),
    "op13_language_id": lambda spark, sf_dir: langid.identify(_documents(spark, sf_dir)),
}

_WORDS = r"words as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws, row_number() over () as row_id from documents)"

#: DuckDB SQL of the queries that SQL can express; the others are tested against brute-force versions
ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clustering": centroids.sql(),
    "op12_source_divergence": divergence.sql(),
    "op3_substring_dedup": f"""
        with {_WORDS},
        windows as materialized (select row_id, i, md5(array_to_string(ws[i : i + 34], ' ')) as w from (select row_id, ws, unnest(range(1, len(ws) - 33)) as i from words) t),
        hits as (select row_id, i from windows where w in (select w from windows group by w having count(*) > 1)),
        gone as materialized (select distinct row_id, i + k as at from hits, (select unnest(range(0, 35)) as k) t),
        kept as (select l.row_id, count(g.at) as n_removed, string_agg(case when g.at is null then l.word end, ' ' order by l.at) as text from (select row_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as at from words where row_id in (select row_id from gone)) l left join gone g on g.row_id = l.row_id and g.at = l.at group by 1)
        select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(case when n_removed is null then array_to_string(ws, ' ') else coalesce(text, '') end) as kept_sha256 from words left join kept using (row_id)""",
    "op5_jaccard_join": f"""
        with recursive {_WORDS},
        member as materialized (select doc_id, min(doc_id) over (partition by array_to_string(ws, ' ')) as id, ws from words where len(ws) > 0),
        classes as (select id, count(*) as copies from member group by 1),
        shingles as materialized (select distinct id, array_to_string(ws[i : i + 4], ' ') as g from (select id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from member where doc_id = id) t),
        sizes as (select id, count(*) as n from shingles group by 1),
        common as (select a.id as a, b.id as b, count(*) as c from shingles a join shingles b on a.g = b.g and a.id < b.id group by 1, 2),
        pairs as (select a, b from common join sizes x on x.id = a join sizes y on y.id = b where 10 * c >= 8 * (x.n + y.n - c)),
        links as materialized (select a, b from pairs union all select b, a from pairs),
        reach(id, other) as (select id, id from classes where id in (select a from links) union select r.id, l.b from reach r join links l on l.a = r.other),
        root as (select id, min(other) as class_id from reach group by 1),
        linked as (select a as id, sum(copies) as n from links join classes c on c.id = b group by 1)
        select w.doc_id, coalesce(m.id, w.doc_id) as exact_id, coalesce(r.class_id, m.id, w.doc_id) as class_id, coalesce(l.n, 0)::bigint + coalesce(c.copies - 1, 0) as n_links
        from words w left join member m on m.doc_id = w.doc_id left join classes c on c.id = m.id left join root r on r.id = m.id left join linked l on l.id = m.id""",
}
