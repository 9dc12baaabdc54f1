"""The subpackage's queries over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from datewright.llm import chat_format, exact_dedup, language_id, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("repeats")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup_digests(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.read_back(chat_format.chat_tree(chat_format.with_hostile(table(spark, sf_dir, "conversations"))))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digests(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_packing": op1_packing,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_quality_rules": op4_quality_rules,
        "op5_mixing": op5_mixing,
        "op6_language_id": op6_language_id,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_line_dedup": op9_line_dedup,
        "op10_near_dedup": op10_near_dedup,
    }


_OP2 = r"""
with t as (select doc_id, length(coalesce(text, '')) as points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256 order by points desc, doc_id)
"""

_OP9 = r"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
line as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from split),
keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from line),
common as (select key, max(doc_id) as largest from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
judged as (select k.doc_id, k.place, k.line, c.key is not null and k.doc_id <> c.largest as gone from keyed k left join common c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": _OP2, "op4_quality_rules": quality_rules.ORACLE_SQL, "op5_mixing": mixing.ORACLE_SQL, "op8_chat_formatting": chat_format.ORACLE_SQL, "op9_line_dedup": _OP9}
