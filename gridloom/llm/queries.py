"""Queries of the problems on text and matching, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import components, copies, encoding, lookalike, mixing, moderation, tokens
from gridloom.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_groups(table(spark, d, "geometry_nodes"), table(spark, d, "geometry_edges"))


def _statistics(spark: SparkSession, d: str) -> encoding.Statistics:
    """Of all drawing texts and layers."""
    audit = table(spark, d, "audit_entities")
    texts = audit.select(F.col("text").alias("t")).unionAll(audit.select("layer")).unionAll(table(spark, d, "cad_entities").select("layer"))
    return encoding.gather(texts)


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    stats = _statistics(spark, d)
    texts = table(spark, d, "audit_entities").select(F.lit("audit_entities").alias("table_name"), "row_id", F.col("text").alias("value"))
    layers = table(spark, d, "cad_entities").select(F.lit("cad_entities").alias("table_name"), "row_id", F.col("layer").alias("value"))
    return encoding.restore(texts.unionAll(layers), "value", stats)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("table_name", "row_id")


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d)


def p3_routes(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each way of finding them accounts for."""
    return _garbled(spark, d).groupBy("table_name", "how").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_whole").alias("n_whole"))


def _spelled(rows: DataFrame) -> DataFrame:
    return lookalike.spell_columns(rows, ["row_id"], ["text", "layer"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The fields that spelling finds odd, without the rows whose text p3's operator finds wrongly decoded."""
    audit = table(spark, d, "audit_entities").select("row_id", "text", "layer")
    rows = audit.where(F.coalesce(lookalike.odd_characters(F.col("text")), F.lit(False)) | F.coalesce(lookalike.odd_characters(F.col("layer")), F.lit(False)))
    odd = _spelled(rows).where("odd <> ''").select("row_id", "field_name")
    return odd.join(encoding.restore(rows.select("row_id", "text"), "text", _statistics(spark, d)).select("row_id"), "row_id", "left_anti")


def p4_spelled(spark: SparkSession, d: str) -> DataFrame:
    return _spelled(table(spark, d, "audit_entities"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "cad_entities"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(table(spark, d, "cad_entities").select("row_id", "project_id", "entity_type", "layer", "start_pt", "end_pt"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"), ["doc_id"])


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the ids stand for."""
    return tokens.texts_of(p7_ids(spark, d), ["doc_id"])


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counts = tokens.token_counts(table(spark, d, "documents"), ["doc_id", "source"])
    return mixing.mix(counts, table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_sequence(spark: SparkSession, d: str) -> DataFrame:
    return mixing.sequence(_mix(spark, d)[0])


def p8_use(spark: SparkSession, d: str) -> DataFrame:
    """Per target: the documents there are, whether any is used more often than allowed or
    counted with other sizes than the report says, and whether a target that is short is used up."""
    times, report = _mix(spark, d)
    most = times.groupBy("source_name").agg(F.max("times").alias("most"), F.sum(F.col("times") * F.col("n_tokens")).alias("sum"), F.count_distinct("doc_id").alias("k"))
    one = report.join(most, "source_name", "left").na.fill(0, ["most", "sum", "k"])
    capped = (F.col("most") <= F.col("max_repeats")) & (F.col("docs_used") <= F.col("n_docs")) & (F.col("k") == F.col("docs_used")) & (F.col("sum") == F.col("tokens_used"))
    goal = F.col("target_share") / F.sum(F.when(F.col("n_docs") > 0, F.col("target_share"))).over(Window.partitionBy())
    short = F.col("reached_share") < goal - 0.005
    full = F.col("tokens_used") == F.col("n_tokens") * F.col("max_repeats")
    return one.select("source_name", "n_docs", capped.alias("is_within_caps"), (~short | full).alias("is_near_or_used_up"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    net = moderation.fitted(docs, table(spark, d, "moderation_labels"))
    return moderation.score_documents(docs, net, ["doc_id", "source"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).where(F.col("score") >= moderation.THRESHOLD).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    abusive = F.count_if(F.col("score") >= moderation.THRESHOLD)
    return p9_scores(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), abusive.alias("n_abusive"), (abusive / F.count(F.lit(1))).alias("rate"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_restored": p3_restored, "p3_routes": p3_routes, "p4_found": p4_found, "p4_spelled": p4_spelled, "p6_found": p6_found, "p6_records": p6_records, "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_sequence": p8_sequence, "p8_use": p8_use, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}

_P2 = """
WITH RECURSIVE n AS (SELECT DISTINCT project_id, node_id FROM geometry_nodes WHERE node_id IS NOT NULL),
e AS (
  SELECT DISTINCT e.project_id, from_id AS a, to_id AS b FROM geometry_edges e
  JOIN n x ON x.project_id = e.project_id AND x.node_id = from_id JOIN n y ON y.project_id = e.project_id AND y.node_id = to_id),
b AS (SELECT project_id, a, b FROM e UNION SELECT project_id, b, a FROM e),
r AS (SELECT project_id, node_id AS a, node_id AS b FROM n UNION SELECT r.project_id, r.a, b.b FROM r JOIN b ON b.project_id = r.project_id AND b.a = r.b)
SELECT project_id, min(b) AS group_node_id, a AS node_id FROM r GROUP BY project_id, a
"""

_P6 = r"""
WITH rows AS (
  SELECT row_id, project_id, entity_type, layer, start_pt, end_pt FROM cad_entities
  WHERE layer IS NOT NULL AND start_pt IS NOT NULL AND end_pt IS NOT NULL),
pts AS (SELECT DISTINCT p FROM (SELECT start_pt AS p FROM rows UNION ALL SELECT end_pt FROM rows)),
parsed AS (
  SELECT p,
    CASE WHEN regexp_matches(p, '[xXyYzZ]["'']?\s*[:=]') THEN
      [regexp_extract(p, '[xX]["'']?\s*[:=]\s*([-+]?[0-9]+(?:[.,][0-9]+)?)', 1), regexp_extract(p, '[yY]["'']?\s*[:=]\s*([-+]?[0-9]+(?:[.,][0-9]+)?)', 1), regexp_extract(p, '[zZ]["'']?\s*[:=]\s*([-+]?[0-9]+(?:[.,][0-9]+)?)', 1)]
    ELSE regexp_extract_all(p, '[-+]?[0-9]+(?:\.[0-9]+)?') END AS a FROM pts),
nums AS (SELECT p, list_transform(list_filter(a, lambda v: v <> ''), lambda v: CAST(replace(v, ',', '.') AS DOUBLE)) AS k FROM parsed),
keyed AS (
  SELECT row_id, project_id, entity_type, s.k AS s, e.k AS e,
    replace(replace(replace(upper(lower(regexp_replace(layer, '[\s\pZ\pP$+<=>^`|~]', '', 'g'))), 'İ', 'I'), 'İ', 'I'), 'ı', 'I') AS l
  FROM rows JOIN nums s ON s.p = start_pt JOIN nums e ON e.p = end_pt),
firsts AS (SELECT *, min(row_id) OVER (PARTITION BY project_id, entity_type, l, s, e) AS first_id FROM keyed)
"""

ORACLES = {
    "p2_found": _P2,
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_use": "SELECT source_name, count(doc_id) AS n_docs, true AS is_within_caps, true AS is_near_or_used_up FROM mix_targets LEFT JOIN documents ON source = source_name AND text <> '' GROUP BY source_name",
    "p6_found": _P6 + "SELECT first_id, row_id AS copy_id FROM firsts WHERE row_id > first_id",
    "p6_records": _P6 + """, counted AS (SELECT first_id, count(*) AS n FROM firsts GROUP BY first_id)
SELECT c.row_id, c.project_id, c.entity_type, c.layer, c.start_pt, c.end_pt, coalesce(n, 1) AS n_copies
FROM cad_entities c LEFT JOIN counted ON counted.first_id = c.row_id WHERE c.row_id NOT IN (SELECT row_id FROM firsts WHERE row_id > first_id)""",
}
