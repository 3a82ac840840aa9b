"""The registered queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, lm_scoring, minhash_dedup, mixing, packing, phrase_mining, prefix_trie, sharding, substring_dedup, suffix_dedup, topk_search, url_filters
from .common import table

URL_ALLOW = ["example.com/en/7", "net/de/"]
#: Token budget of the mixture, in times all tokens, and how far its entropy lies on the way to equal shares.
MIXED, EVENED = 1.25, 0.5
URL_BLOCK = ["com/en/", "example.net/de/8", "org/es/"]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_ALLOW, URL_BLOCK)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.digest(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.digest(table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.digest(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.block_permutations(table(spark, sf_dir, "documents"), budget_share=MIXED, entropy_share=EVENED)
    return mixed.withColumn("weight", F.round("weight", 9))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.digest(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: One bit of a CRC-32 whose register is {0}.
_BIT = "xor({0}>>1, 3988292384*({0}&1))"
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], range(8*length(conv_id::VARCHAR))), lambda a, j: " + _BIT.format("(CASE WHEN j%8=0 THEN xor(a, ascii(substr(conv_id::VARCHAR, (j//8+1)::INT, 1))) ELSE a END)") + "), 4294967295)"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
SQL = {
    "op3_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text,'')")} AS ws FROM documents),
 win AS (SELECT doc_id, s, array_to_string(ws[s:s+19],' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws)-18)) AS s FROM w WHERE len(ws)>=20)),
 ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win),
 gone AS (SELECT DISTINCT doc_id, s+o AS p FROM ranked, range(20) t(o) WHERE r>1),
 pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1,len(ws)+1)) AS p FROM w),
 kept AS (SELECT pos.doc_id, count(gone.p) AS g, string_agg(word,' ' ORDER BY pos.p) FILTER (gone.p IS NULL) AS t FROM pos LEFT JOIN gone ON pos.doc_id=gone.doc_id AND pos.p=gone.p GROUP BY 1)
 SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(g,0)::BIGINT AS n_removed, sha256(coalesce(t,'')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op4_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024*x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(1024*x::DOUBLE)))=0),
 q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id%100=0 GROUP BY 1),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM q JOIN v c ON q.vec_id<>c.vec_id AND len(q.e)=len(c.e)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
 SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank<=10""",
    "op6_minhash_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3],' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws)-2,2))) AS i FROM w WHERE len(ws)>0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY 1,2),
 links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id=x JOIN n ny ON ny.doc_id=y WHERE 100*c>=80*(nx.n+ny.n-c)),
 edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
 reach AS (SELECT doc_id AS node, doc_id AS c FROM w UNION SELECT edges.y, reach.c FROM reach JOIN edges ON edges.x=reach.node WHERE reach.c<edges.y),
 least AS (SELECT node, min(c) AS c FROM reach GROUP BY 1)
 SELECT w.doc_id, coalesce(n.n,0)::BIGINT AS n_shingles, least.c AS component_id, least.c=w.doc_id AS kept FROM w JOIN least ON least.node=w.doc_id LEFT JOIN n ON n.doc_id=w.doc_id""",
    "op9_suffix_dedup": """WITH d AS (SELECT doc_id, encode(coalesce(text,'')) AS b, octet_length(encode(coalesce(text,''))) AS n FROM documents),
 win AS (SELECT doc_id, s, md5(b[s:s+399]) AS h FROM (SELECT doc_id, b, unnest(range(1, n-398)) AS s FROM d WHERE n>=400)),
 twice AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c>1),
 marked AS (SELECT doc_id, s, CASE WHEN s>lag(s) OVER (PARTITION BY doc_id ORDER BY s)+400 THEN 1 ELSE 0 END AS fresh FROM twice),
 spans AS (SELECT doc_id, min(s) AS lo, max(s)+399 AS hi FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM marked) GROUP BY doc_id, g),
 gaps AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo),0)+1 AS a, lo-1 AS z FROM spans UNION ALL SELECT doc_id, max(hi)+1, NULL FROM spans GROUP BY 1),
 kept AS (SELECT gaps.doc_id, list_reduce(list(b[a:coalesce(z,n)] ORDER BY a), lambda x, y: x||y) AS k FROM gaps JOIN d ON d.doc_id=gaps.doc_id WHERE coalesce(z,n)>=a GROUP BY gaps.doc_id),
 sums AS (SELECT doc_id, sum(hi-lo+1) AS gone, count(*) AS spans FROM spans GROUP BY 1)
 SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(gone,0)::BIGINT AS n_removed, coalesce(spans,0)::BIGINT AS n_spans, sha256(CASE WHEN gone IS NULL THEN b ELSE coalesce(k, encode('')) END) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_prefix_trie": f"""WITH t AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations WHERE conv_id IS NOT NULL),
 own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(length(role)||':'||role||text)) AS s, {_CRC}%6 AS h FROM t GROUP BY 1),
 full_ AS (SELECT own.conv_id, list_concat(coalesce(base.s,[])[1:own.h], own.s[own.h+1:]) AS s FROM own LEFT JOIN own base ON base.conv_id=own.conv_id-own.conv_id%100),
 pre AS (SELECT conv_id, d, s[1:d] AS p, len(s)=d AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s)+1)) AS d FROM full_)),
 node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS e FROM pre GROUP BY 1,2),
 kid AS (SELECT p[1:d-1] AS up, d-1 AS ud, count(*) AS k FROM node WHERE d>0 GROUP BY 1,2),
 known AS (SELECT node.*, coalesce(k,0) AS k, (n-1)*CASE WHEN d=0 THEN 0 ELSE length(p[d].text) END AS w FROM node LEFT JOIN kid ON up=p AND ud=d),
 sums AS (SELECT p[1:a] AS up, a, sum((k=0)::INT) AS leaves, sum(w) AS saved FROM (SELECT *, unnest(range(0, d+1)) AS a FROM known) GROUP BY 1,2)
 SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n AS n_convs, x.k AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(x.e) AS ends_sha256 FROM known x JOIN sums ON up=x.p AND a=x.d LEFT JOIN node y ON y.d=x.d-1 AND y.p=x.p[1:x.d-1]""",
    "op11_phrase_mining": """WITH d AS (SELECT coalesce(lang,'und') AS lang, translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS (SELECT lang, regexp_extract_all(s, '[^\\x20\\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS s FROM d)),
 f AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, array_to_string(ws[i:i+k-1],' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws)-k+2)) AS i FROM w, (VALUES (1),(2),(3)) t(k))) GROUP BY 1,2,3 HAVING count(*)>=10),
 totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
 c AS (SELECT *, string_split(phrase,' ') AS p FROM f WHERE k>1),
 cuts AS (SELECT c.lang, c.phrase, c.k, c.a, cut, x.a AS l, y.a AS r, (1000000::HUGEINT*c.a*c.a)//(x.a::HUGEINT*y.a) AS score FROM (SELECT *, unnest(range(1,k)) AS cut FROM c) c JOIN f x ON x.lang=c.lang AND x.phrase=array_to_string(p[1:cut],' ') JOIN f y ON y.lang=c.lang AND y.phrase=array_to_string(p[cut+1:],' ')),
 worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM cuts) WHERE o=1),
 held AS (SELECT lang, s, max(a) AS b FROM (SELECT lang, a, unnest([array_to_string(p[1:2],' '), array_to_string(p[2:3],' ')]) AS s FROM c WHERE k=3) GROUP BY 1,2)
 SELECT * FROM (SELECT worst.lang, row_number() OVER (PARTITION BY worst.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM worst LEFT JOIN held ON held.lang=worst.lang AND held.s=worst.phrase JOIN totals ON totals.lang=worst.lang WHERE b IS NULL OR 100*b<50*a) WHERE rank<=2000""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express in a few seconds on the correctness tables; the others are tested by brute force."""
    return dict(SQL)
