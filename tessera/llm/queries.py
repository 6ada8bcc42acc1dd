"""The queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, divergence, embedding_dedup, jaccard_join, lm_scoring, packing, quality, substring_dedup, topk_search, toxicity, url_filter, warc, whitening

#: The rules that op7 is asked to apply.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.exact_top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(20)) == 0))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
    return coded.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def url_rule_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 takes from the rules alone."""
    judged = url_filter.ruled(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "ruled")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rank file and packing.ADDED hold the same vocabulary as byte_bpe_50k.json
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_exact_top_k_search": op1_exact_top_k_search,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_byte_level_bpe": op6_byte_level_bpe,
        "op7_url_filter": op7_url_filter,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_retrieval_packing": op10_retrieval_packing,
        "op11_warc": op11_warc,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_source_divergence_audit": op13_source_divergence_audit,
        "url_rule_columns": url_rule_columns,
    }


_VALID = "embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"

ORACLES = {
    "op1_exact_top_k_search": f"""
        with v as (
          select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as t
          from embeddings where {_VALID}
        ), s as (
          select q.vec_id as query_id, c.vec_id,
            cast(list_sum(list_transform(range(1, len(q.t) + 1), lambda i: q.t[i] * c.t[i])) as bigint) as score
          from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
        ), r as (
          select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank" from s
        )
        select query_id, "rank", vec_id, score from r where "rank" <= 20""",
    "op3_substring_dedup": r"""
        with d as (
          select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
          from documents
        ), win as (
          select doc_id, i, array_to_string(w[i:i + 12], ' ') as s
          from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)
        ), bad as (
          select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as least from win) where least < doc_id
        ), gone as (
          select doc_id, list(distinct i + k) as j from bad, range(13) as r(k) group by doc_id
        )
        select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(j), 0) as bigint) as n_removed,
          sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: not coalesce(list_contains(j, i), false)), lambda i: w[i]), ' '), '')) as kept_sha256
        from d left join gone using (doc_id)""",
    "op9_ngram_jaccard_join": r"""
        with recursive d as (
          select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
          from documents
        ), s as (
          select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as own from d
        ), member as (
          select doc_id, len(own) as n, unnest(own) as shingle from s
        ), pair as (
          select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as common
          from member a join member b on a.shingle = b.shingle and a.doc_id < b.doc_id
            and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all
        ), link as (
          select x, y from pair where 100 * common >= 80 * (nx + ny - common)
        ), way as (
          select x, y from link union all select y, x from link
        ), reach(doc_id, other) as (
          select x, x from way union select r.doc_id, b.y from reach r join way b on r.other = b.x
        ), least_of as (
          select doc_id, min(other) as component_id from reach group by doc_id
        )
        select s.doc_id, cast(len(own) as bigint) as n_shingles, coalesce(component_id, s.doc_id) as component_id
        from s left join least_of using (doc_id)""",
    "op11_warc": """
        with p as (
          select page_id, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as hex from pages
        ), d as (
          select page_id, payload, cast(octet_length(payload) as bigint) as payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
              1 + ((cast('0x' || substr(hex, 1 + 5 * (i // 4), 5) as integer) >> (15 - 5 * (i % 4))) & 31), 1)), '') as payload_digest
          from p
        ), t as (
          select *, max(page_id) over (partition by payload) as top from d
        )
        select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
          case when page_id <> top then top end as refers_to from t""",
    "op13_source_divergence_audit": r"""
        with d as (
          select row_number() over () as n, coalesce(lang, '') as lang, coalesce(source, '') as source,
            regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
        ), occ as (
          select n, lang, source, translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d
        ), kept as (
          select lang, term from occ group by all having count(distinct n) >= 10
        ), cnt as (
          select lang, source, term, count(*) as c from occ join kept using (lang, term) group by all
        ), grp as (
          select distinct lang, source from d
        ), v as (
          select lang, coalesce(n_terms, 0) as v from (select distinct lang from d) left join (select lang, count(*) as n_terms from kept group by lang) using (lang)
        ), tot as (
          select g.lang, g.source, coalesce(sum(c), 0) as t from grp g left join cnt using (lang, source) group by all
        ), share as (
          select g.lang, g.source, k.term, coalesce(c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c, 0) + 2)) // (t + 2 * v) as p
          from grp g join kept k using (lang) join tot using (lang, source) join v using (lang) left join cnt using (lang, source, term)
        ), lshare as (
          select lang, term, 1 + (1000000000::hugeint * (c + 2)) // (t + 2 * v) as q
          from (select lang, term, sum(c) as c from cnt group by all) join (select lang, sum(c) as t from cnt group by all) using (lang) join v using (lang)
        ), far as (
          select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
          from share a join share b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
        ), pair as (
          select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
          from grp a join grp b on a.lang = b.lang and a.source <> b.source left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source
        ), mark as (
          select lang, source, 'term' as part, term as item, cast(((p - q) * (p - q)) // (p + q) as bigint) as value
          from share join lshare using (lang, term) where c > 0 and p > q
        ), r as (
          select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as "rank" from (select * from pair union all select * from mark)
        )
        select lang, source, part, item, value, "rank" from r where part = 'pair' or "rank" <= 10""",
    "url_rule_columns": """
        with p as (
          select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
        ), h as (
          select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from p
        ), u as (
          select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h
        ), r(verdict, rule, on_host, tail) as (
          values """ + ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES) + """
        ), fit as (
          select page_id, max({'size': length(rule), 'rule': rule, 'verdict': verdict}) as best
          from u join r on (host = on_host or ends_with(host, '.' || on_host)) and starts_with(path, tail) group by page_id
        )
        select page_id, host, path, best.rule as rule, best.verdict as ruled from u left join fit using (page_id)""",
}
