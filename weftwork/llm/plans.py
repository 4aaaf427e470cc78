"""Queries of the llm operators over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions.common import table
from weftwork.llm import credentials as CR
from weftwork.llm import docpairs as DP
from weftwork.llm import hidden_prose as HP
from weftwork.llm import mixing as MX
from weftwork.llm import packing as PK
from weftwork.llm import reading as RL
from weftwork.llm import shared_spans as SS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _bodies(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "code_functions").filter(F.col("language").isin("java", "rust", "swift") & F.col("body_source").isNotNull()).select(F.col("function_id").alias("rid"), F.col("body_source").alias("text"))


@query
def p2_found(s: SparkSession, d: str) -> DataFrame:
    return SS.shared_pairs(_bodies(s, d)).select(F.col("rid_a").alias("function_id_a"), F.col("rid_b").alias("function_id_b"))


@query
def p2_classes(s: SparkSession, d: str) -> DataFrame:
    return SS.span_classes(_bodies(s, d)).withColumnRenamed("rid", "function_id")


@query
def p2_shares(s: SparkSession, d: str) -> DataFrame:
    return SS.shared_share(_bodies(s, d)).withColumnRenamed("rid", "function_id")


@query
def p2_spans(s: SparkSession, d: str) -> DataFrame:
    return SS.shared_runs(_bodies(s, d)).withColumnRenamed("rid", "function_id")


@query
def p2_kept(s: SparkSession, d: str) -> DataFrame:
    return SS.without_repeats(_bodies(s, d)).select(F.col("rid").alias("function_id"), F.col("text").alias("body_source"))


def _packed(s: SparkSession, d: str) -> DataFrame:
    return PK.pack(table(s, d, "documents"), table(s, d, "pack_specs"))


@query
def p8_found(s: SparkSession, d: str) -> DataFrame:
    return _packed(s, d).filter("spec_name = 'standard' and piece_no = 1").select("doc_id")


@query
def p8_assigned(s: SparkSession, d: str) -> DataFrame:
    return _packed(s, d).select("spec_name", "doc_id", "piece_no", "first_token", "size", "container_id")


@query
def p8_containers(s: SparkSession, d: str) -> DataFrame:
    return PK.containers(_packed(s, d))


@query
def p8_bounds(s: SparkSession, d: str) -> DataFrame:
    return PK.bounds(_packed(s, d))


@query
def p9_mix(s: SparkSession, d: str) -> DataFrame:
    return MX.mix(table(s, d, "documents"), table(s, d, "mix_targets"))[0]


@query
def p9_shares(s: SparkSession, d: str) -> DataFrame:
    return MX.mix(table(s, d, "documents"), table(s, d, "mix_targets"))[1]


def _levels(s: SparkSession, d: str) -> DataFrame:
    return RL.reading_levels(table(s, d, "documents"), table(s, d, "reading_labels"))


@query
def p10_found(s: SparkSession, d: str) -> DataFrame:
    return RL.demanding(_levels(s, d))


@query
def p10_levels(s: SparkSession, d: str) -> DataFrame:
    return _levels(s, d).select("doc_id", "english_share", F.round("difficulty").cast("int").alias("reading_level"), "difficulty", "share_4")


@query
def p10_profile(s: SparkSession, d: str) -> DataFrame:
    return RL.profile(_levels(s, d))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    a = DP.pairs_of_functions(table(s, d, "code_functions")).withColumn("record_table", F.lit("code_functions"))
    return a.unionByName(DP.pairs_of_files(table(s, d, "source_files")).withColumn("record_table", F.lit("source_files")))


@query
def p6_found(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("record_table", "record_id", "function_name").distinct()


@query
def p6_pairs(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).dropDuplicates(["record_table", "record_id", "function_name", "start"]).select("record_table", "record_id", "function_name", "start", "stop", "code", "description")


SECRET_TEXTS = {
    "code_functions": ("function_id", "body_source", None), "sql_tables": ("table_id", "raw_ddl", None), "command_results": ("command_id", "stdout", None),
    "php_fields": ("field_id", "default_value", "field_name"), "source_files": ("file_id", "content", None),
}


def _over_texts(s: SparkSession, d: str, f) -> DataFrame:
    out = None
    for name, (key, col, ctx) in SECRET_TEXTS.items():
        one = f(table(s, d, name), F.col(key), F.col(col), F.col(ctx) if ctx else None).withColumn("record_table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def p7_found(s: SparkSession, d: str) -> DataFrame:
    return _over_texts(s, d, CR.credential_places).filter("begins").select("record_table", "record_id", "line_no").distinct()


@query
def p7_places(s: SparkSession, d: str) -> DataFrame:
    return _over_texts(s, d, CR.credential_places).select("record_table", "record_id", "line_no", "start", "stop").distinct()


@query
def p7_redacted(s: SparkSession, d: str) -> DataFrame:
    return _over_texts(s, d, CR.without_credentials).groupBy("record_table", "record_id").agg(F.max("text").alias("text"))


def _prose(s: SparkSession, d: str) -> DataFrame:
    c, g, f, z = (table(s, d, n) for n in ("java_classes", "graphql_types", "source_files", "code_functions"))
    texts = F.array_join(F.transform(F.filter("fields", lambda x: x["description"].isNotNull()), lambda x: x["description"]), "\n\n")
    parts = {"java_classes": HP.prose_of_docs(c, F.col("class_id"), F.col("doc")), "graphql_types": HP.prose_of_docs(g, F.col("type_id"), texts),
             "code_functions": HP.prose_of_docs(z.filter("language = 'zig' and doc is not null"), F.col("function_id"), F.col("doc")),
             "source_files": HP.prose_of_files(f, F.col("file_id"), F.col("language"), F.col("file_path"), F.col("content"))}
    out = None
    for name, df in parts.items():
        df = df.withColumn("record_table", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("record_table", "record_id", "nat_lang").agg(F.max("n_phrases").alias("n_phrases"), F.max("n_chars").alias("n_chars"), F.max("share").alias("share"))


@query
def p1_found(s: SparkSession, d: str) -> DataFrame:
    return _prose(s, d).select("record_table", "record_id", "nat_lang")


@query
def p1_shares(s: SparkSession, d: str) -> DataFrame:
    return _prose(s, d)


@query
def p1_languages(s: SparkSession, d: str) -> DataFrame:
    return _prose(s, d).groupBy("record_table", "nat_lang").agg(F.count("*").alias("n_records"), F.sum("n_phrases").alias("n_phrases"), F.sum("n_chars").alias("n_chars"))


_P2 = """WITH f AS (SELECT DISTINCT function_id, body_source AS t FROM code_functions WHERE language IN ('java', 'rust', 'swift') AND body_source IS NOT NULL),
w AS (SELECT function_id, i, substr(t, i, 150) AS g FROM (SELECT function_id, t, unnest(range(1, length(t) - 148)) AS i FROM f WHERE length(t) >= 150)),
s AS (SELECT g FROM w GROUP BY g HAVING count(DISTINCT function_id) > 1), m AS (SELECT w.* FROM w JOIN s USING (g)) """
SQL["p2_found"] = _P2 + "SELECT DISTINCT a.function_id AS function_id_a, b.function_id AS function_id_b FROM m a JOIN m b ON a.g = b.g AND a.function_id < b.function_id"
SQL["p2_spans"] = _P2 + """, p AS (SELECT DISTINCT function_id, i - 1 AS pos FROM m), n AS (SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY function_id ORDER BY pos) + 150 THEN 1 ELSE 0 END AS new FROM p),
k AS (SELECT *, sum(new) OVER (PARTITION BY function_id ORDER BY pos) AS k FROM n) SELECT function_id, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) + 150 AS INTEGER) AS stop FROM k GROUP BY function_id, k"""
SQL["p2_shares"] = _P2 + """, c AS (SELECT function_id, count(DISTINCT pos) AS n FROM (SELECT function_id, unnest(range(i, i + 150)) AS pos FROM m) GROUP BY 1)
SELECT f.function_id, max(length(t)) AS n_chars, coalesce(max(n), 0) AS shared_chars, CASE WHEN max(length(t)) > 0 THEN coalesce(max(n), 0) / max(length(t)) ELSE 0.0 END AS share FROM f LEFT JOIN c USING (function_id) GROUP BY 1"""
