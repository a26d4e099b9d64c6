"""The library's input tables derived from the driver's tables, in Spark and as SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

METADATA = """
select concat('P',cast(s_suppkey as {S})) participant_label, concat('S',cast(s_suppkey as {S})) specimen_label,
 case when s_suppkey%10 in (1,2,4,7) then 'CMV' when s_suppkey%10=9 then 'HIV' else 'Healthy/Background' end disease,
 cast(s_suppkey%3 as int) fold_id,
 case when s_suppkey%11=0 then null else cast(20+(s_suppkey*37)%60 as double) end age,
 case when s_suppkey%7=0 then null when s_suppkey%2=0 then 'F' else 'M' end sex,
 case when s_suppkey%13=0 then null else r_name end ancestry
 from {supplier} join {nation} on s_nationkey=n_nationkey join {region} on n_regionkey=r_regionkey
"""
REPERTOIRE = """
select concat('S',cast(l_suppkey as {S})) repertoire_id, cast(row_number() over (partition by l_suppkey order by l_orderkey,l_linenumber,l_partkey,l_quantity,l_extendedprice,l_discount,l_tax,l_shipdate)-1 as int) row_idx,
  translate(substr(md5(cast(pk as {S})),1,cast(10+pk%7 as int)),'0123456789abcdef','ACDEFGHIKLMNPQRS') cdr3_aa,
  concat('TRBV',cast(1+pk%30 as {S}),'-',cast(1+pk%3 as {S}),'*01') v_call,
  concat('TRBJ',cast(1+pk%2 as {S}),'-',cast(1+pk%7 as {S}),'*01') j_call,
  cast(l_quantity as int) duplicate_count
 from (select l_suppkey, l_orderkey, l_linenumber, l_quantity, l_partkey,l_extendedprice,l_discount,l_tax,l_shipdate,
  case when l_suppkey%10 in (1,2,4,7) and l_quantity>=47 then (l_orderkey+l_linenumber)%8 else l_partkey end pk from {lineitem}) k
"""
RAW = """
select repertoire_id, row_idx,
  case when row_idx%17=0 then 'Out' when row_idx%19=0 then 'Stop' else 'In' end frame_type,
  case when row_idx%23=0 then 'unresolved' when row_idx%29=0 then null when row_idx%31=0 then concat('C',cdr3_aa,'*F') else concat('C',cdr3_aa,'F') end amino_acid,
  case when row_idx%37=0 then 'TCRBV20-or9_2' when row_idx%41=0 then 'TCRBV04' when row_idx%43=0 then 'TCRBV03-01/03-02' when row_idx%47=0 then 'TCRBV12-04' when row_idx%53=0 then 'TCRBV13-01'
    else concat('TCRBV',lpad(cast(1+row_idx%30 as {S}),2,'0'),'-',lpad(cast(1+row_idx%9 as {S}),2,'0')) end v_gene,
  case when row_idx%59=0 then 'TCRBJ02' else concat('TCRBJ',lpad(cast(1+row_idx%2 as {S}),2,'0'),'-',lpad(cast(1+row_idx%7 as {S}),2,'0')) end j_gene,
  duplicate_count templates from {repertoire}
"""
_NAMES = {t: t for t in ("supplier", "nation", "region", "lineitem", "repertoire")}

#: Common table expressions for oracle queries.
CTE = ", ".join(f"{name} as materialized ({sql.format(S='varchar', **_NAMES)})" for name, sql in (("metadata", METADATA), ("repertoire", REPERTOIRE), ("raw", RAW)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(text.replace("{S}", "string"), **tables)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, METADATA, **{t: table(spark, sf_dir, t) for t in ("supplier", "nation", "region")})


def repertoire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, REPERTOIRE, lineitem=table(spark, sf_dir, "lineitem"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, RAW, repertoire=repertoire(spark, sf_dir))
