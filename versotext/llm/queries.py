"""Registered queries over the test tables, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versotext.llm import cover_tree, decontaminate, jaccard_join, language, licenses, quality, sentencepiece_scan, token_store, toxicity, warc
from versotext.llm.text import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_token_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_token_store(spark, path)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records' headers, with the block and the whole record."""
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document's pieces and of the text decoded from them: numbers and checksums."""
    import public_tokenizers

    return sentencepiece_scan.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_token_store, op3_decontamination, op4_quality, op5_license_scan, op6_toxicity, op7_exact_topk, op8_warc_derivatives, op9_sentencepiece, op10_language_id)}


OP1_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents where text is not null and doc_id is not null),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words),
classes as (select min(doc_id) as c, k from (select doc_id, list_sort(s) as k from sets where len(s) > 0) group by k),
member as (select s.doc_id, c.c from sets s join classes c on list_sort(s.s) = c.k),
item as (select c, len(k) as n, unnest(k) as g from classes),
pair as (select a.c as x, b.c as y from item a join item b on a.g = b.g and a.c < b.c and b.n * 100 >= a.n * 80 and a.n * 100 >= b.n * 80
  group by a.c, b.c, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edge as (select x, y from pair union all select y, x from pair),
reach as (select c as x, c as y from classes union select r.x, e.y from reach r join edge e on r.y = e.x),
part as (select x as c, min(y) as component from reach group by x)
select d.doc_id, coalesce(len(s.s), 0)::bigint as n_shingles, coalesce(p.component, d.doc_id) as component_id, coalesce(m.c, d.doc_id) as class_id
from documents d left join sets s using (doc_id) left join member m using (doc_id) left join part p on p.c = m.c
"""

OP3_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents where doc_id is not null and text is not null),
b as (select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from benchmark where item_id is not null and text is not null),
s as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) as g from b where len(w) > 0),
size as (select item_id, count(*) as n_item from s group by item_id),
t as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) as g from d where len(w) > 0)
select t.doc_id, s.item_id, count(*)::integer as n_common, any_value(z.n_item)::integer as n_item from t join s using (g) join size z using (item_id)
group by t.doc_id, s.item_id having count(*) * 100 >= any_value(z.n_item) * 80
"""

OP7_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings where embedding is not null and vec_id is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
  from v q, v c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_topk": OP7_SQL, "op1_jaccard_join": OP1_SQL, "op3_decontamination": OP3_SQL}
