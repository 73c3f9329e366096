"""Relations that queries start from: SQL that Spark and DuckDB both read. The tables' texts are clean, so faults are put in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.runtime import table

SQL = {
    "dirty": "select doc_id, concat(replace(replace(replace(replace(text,'fi','ﬁ'),'on','o­n'),' the ',' “the”  '),' in ','—in–'), chr(9), chr(1), ' ', chr(10), chr(10), chr(10), chr(10), 'tail') as x from {documents}",
    "paged": "select source, page_number, concat('REPORT ', upper(source), chr(10), text, chr(10), 'Page ', cast(page_number as varchar(20))) as page from (select source, text, cast(row_number() over (partition by source order by doc_id) as int) as page_number from {documents}) t",
    "hyphened": "select doc_id, replace(replace(text,'ation','a-' || chr(10) || 'tion'),'. ','.' || chr(10) || chr(10)) as x from {documents}",
    "wrapped": "select doc_id, replace(replace(text,', ',',' || chr(10)),' and ', chr(10) || '- ') as x from {documents}",
    "idx": "select vec_id, embedding, concat('c', lpad(cast(vec_id as varchar(20)),6,'0')) as chunk_id, concat('chunk ', cast(vec_id as varchar(20))) as text, concat('doc_', cast(label as varchar(20))) as document_id, cast(row_number() over (partition by label order by vec_id) - 1 as int) as chunk_index, concat('data/doc_', cast(label as varchar(20)), '.pdf') as source_file, cast(vec_id % 20 + 1 as int) as page_number, concat('Section ', cast(label % 3 as varchar(20))) as section, cast(vec_id % 100 as double) / 100 as quality_score, case vec_id % 3 when 0 then 'SemanticChunker' when 1 then 'SentenceSplitter' else 'SlidingWindowChunker' end as chunker_name from {embeddings}",
    "models": "select conv_id, turn, role, case role when 'user' then 'gpt-4-0613' when 'assistant' then 'gpt-4-turbo' else 'unknown-model' end as model, cast(length(text) as int) as input_tokens, cast(length(text) % 97 as int) as output_tokens from {conversations}",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SQL[name]
    source = sql[sql.index("{") + 1 : sql.index("}")]
    return spark.sql(sql, **{source: table(spark, sf_dir, source)})


def with_clause(*names: str) -> str:
    """The fixtures as common table expressions for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n].replace('{', '').replace('}', '')})" for n in names)
