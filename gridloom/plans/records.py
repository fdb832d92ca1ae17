"""Queries of problems 1 and 5 on the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import nested, orphans
from gridloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.model_children(table(spark, d, "bim_model")).select("record_id", "owner_kind", "owner_ord", "child_kind", "child_ord")


def p1_owners(spark: SparkSession, d: str) -> DataFrame:
    return nested.model_owners(table(spark, d, "bim_model"))


def p1_points(spark: SparkSession, d: str) -> DataFrame:
    return nested.model_points(table(spark, d, "bim_model"))


def p1_references(spark: SparkSession, d: str) -> DataFrame:
    return nested.model_references(table(spark, d, "bim_model"))


def p1_ancestry(spark: SparkSession, d: str) -> DataFrame:
    return nested.model_ancestry(table(spark, d, "bim_model"))


def p1_finishes(spark: SparkSession, d: str) -> DataFrame:
    return nested.model_finishes(table(spark, d, "bim_model"))


def p1_holes(spark: SparkSession, d: str) -> DataFrame:
    return nested.model_holes(table(spark, d, "bim_model"))


def p1_details(spark: SparkSession, d: str) -> DataFrame:
    return nested.model_details(table(spark, d, "bim_model"))


def _model(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("core_walls", "core_spaces", "core_openings")]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.model_orphans(*_model(spark, d)).select("field_name", "owner_uuid", "target_key")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(*_model(spark, d))


QUERIES = {"p1_found": p1_found, "p1_owners": p1_owners, "p1_points": p1_points, "p1_references": p1_references, "p1_ancestry": p1_ancestry, "p1_finishes": p1_finishes, "p1_holes": p1_holes, "p1_details": p1_details, "p5_found": p5_found, "p5_report": p5_report}

_P5 = """
WITH raw AS (
  SELECT 'related_walls' AS field_name, 'wall' AS kind, project_id, uuid, loaded_at, unnest(related_walls) AS r FROM core_spaces
  UNION ALL SELECT 'neighbors', 'space', project_id, uuid, loaded_at, unnest(neighbors) FROM core_spaces
  UNION ALL SELECT 'related_doors', 'door', project_id, uuid, loaded_at, unnest(related_doors) FROM core_spaces
  UNION ALL SELECT 'parent_wall', 'wall', project_id, uuid, loaded_at, parent_wall FROM core_openings WHERE category = 'WINDOW'),
loads AS (
  SELECT 'space' AS k, project_id, uuid, min(loaded_at) AS l FROM core_spaces GROUP BY ALL
  UNION ALL SELECT 'window', project_id, uuid, min(loaded_at) FROM core_openings WHERE category = 'WINDOW' GROUP BY ALL),
refs AS (
  SELECT DISTINCT field_name, kind, r.project_id, r.uuid AS owner_uuid, lower(trim(r.r, ' \t\n\r')) AS target_key, l
  FROM raw r JOIN loads ON loads.project_id = r.project_id AND loads.uuid = r.uuid AND (k = 'window') = (field_name = 'parent_wall')
  WHERE trim(coalesce(r.r, ''), ' \t\n\r') <> ''),
facts AS (
  SELECT kind, project_id, target_key, min(loaded_at) AS t, min(deleted_at) AS del FROM (
    SELECT 'wall' AS kind, project_id, lower(uuid) AS target_key, loaded_at, deleted_at FROM core_walls
    UNION ALL SELECT 'space', project_id, lower(uuid), loaded_at, deleted_at FROM core_spaces
    UNION ALL SELECT 'door', project_id, lower(uuid), loaded_at, deleted_at FROM core_openings WHERE category = 'DOOR') GROUP BY ALL),
gone AS (
  SELECT refs.* FROM refs LEFT JOIN facts USING (kind, project_id, target_key)
  WHERE t IS NULL OR del <= l OR t > l)
"""

_P1_PARTS = """
WITH src AS (
  SELECT record_id, 'wall' AS owner_kind, walls AS txt FROM bim_model
  UNION ALL SELECT record_id, 'space', spaces FROM bim_model),
ok AS (SELECT record_id, owner_kind, txt::JSON AS j FROM (SELECT * FROM src WHERE txt IS NOT NULL AND json_valid(txt) OFFSET 0)),
lists AS (SELECT record_id, owner_kind, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END AS items FROM ok),
owners AS (SELECT record_id, owner_kind, unnest(items) AS o, unnest(range(len(items))) AS owner_ord FROM lists),
places AS (
  SELECT *, 'point' AS child_kind, CASE owner_kind
      WHEN 'wall' THEN [json_extract(o, '$.points'), json_extract(o, '$.geometry.points')]
      ELSE [json_extract(o, '$.polygon'), json_extract(o, '$.boundary'), json_extract(o, '$.geometry.boundary')] END AS p FROM owners
  UNION ALL SELECT *, 'related_space', [json_extract(o, '$.related_spaces')] FROM owners WHERE owner_kind = 'wall'
  UNION ALL SELECT *, 'related_wall', [json_extract(o, '$.related_walls')] FROM owners WHERE owner_kind = 'space'
  UNION ALL SELECT *, 'neighbor', [json_extract(o, '$.neighbors')] FROM owners WHERE owner_kind = 'space'),
chosen AS (SELECT * EXCLUDE (p), list_filter(p, lambda x: x IS NOT NULL AND json_type(x) <> 'NULL')[1] AS v FROM places WHERE json_type(o) = 'OBJECT'),
kids AS (SELECT record_id, owner_kind, owner_ord, child_kind, json_extract(v, '$[*]') AS c FROM chosen WHERE json_type(v) = 'ARRAY'),
flat AS (SELECT record_id, owner_kind, owner_ord, child_kind, unnest(c) AS item, unnest(range(len(c))) AS child_ord FROM kids)
"""

_NUMBER = "CASE WHEN json_type({v}) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN ({v}->>'$')::DOUBLE END"
_AXIS = "CASE json_type(item) WHEN 'ARRAY' THEN " + _NUMBER.format(v="json_extract(item, '$[{k}]')") + " WHEN 'OBJECT' THEN " + _NUMBER.format(v="json_extract(item, '$.{n}')") + " END"
_TEXT = "CASE WHEN json_type(json_extract(o, '$.{n}')) NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN json_extract(o, '$.{n}')->>'$' END"
_VALUE = "CASE WHEN json_type({v}) NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN {v}->>'$' END"
_KEYS = "SELECT record_id, owner_kind, owner_ord::INT AS owner_ord, "
#: Items of a list below an object of an owner.
_BELOW = "SELECT record_id, owner_kind, owner_ord, unnest(json_extract(o, '{p}[*]')) AS item, unnest(range(len(json_extract(o, '{p}[*]')))) AS child_ord FROM owners WHERE json_type(json_extract(o, '{p}')) = 'ARRAY'"

ORACLES = {
    "p1_found": _P1_PARTS + "SELECT record_id, owner_kind, owner_ord::INT AS owner_ord, child_kind, child_ord::INT AS child_ord FROM flat WHERE json_type(item) <> 'NULL'",
    "p1_points": _P1_PARTS + "SELECT record_id, owner_kind, owner_ord::INT AS owner_ord, child_ord::INT AS child_ord, " + ", ".join(f"{_AXIS.format(k=k, n=n)} AS {n}" for k, n in enumerate("xyz")) + " FROM flat WHERE child_kind = 'point' AND json_type(item) <> 'NULL'",
    "p1_owners": _P1_PARTS + "SELECT record_id, owner_kind, owner_ord::INT AS owner_ord, " + ", ".join(f"{_TEXT.format(n=n)} AS {n}" for n in ("uuid", "type", "thickness", "area", "area_raw", "edge_id")) + " FROM owners WHERE json_type(o) = 'OBJECT'",
    "p1_references": _P1_PARTS + _KEYS + f"child_kind, child_ord::INT AS child_ord, {_VALUE.format(v='item')} AS value FROM flat WHERE child_kind <> 'point' AND json_type(item) <> 'NULL'",
    "p1_ancestry": _P1_PARTS + f", g AS ({_BELOW.format(p='$.source.ancestry')}) " + _KEYS + f"child_ord::INT AS child_ord, {_VALUE.format(v='item')} AS value FROM g WHERE json_type(item) <> 'NULL'",
    "p1_finishes": _P1_PARTS + f", g AS ({_BELOW.format(p='$.tags.finish')}) " + _KEYS + "child_ord::INT AS child_ord, " + ", ".join(_VALUE.format(v=f"json_extract(item, '$.{n}')") + f" AS {n}" for n in ("mat", "layer")) + " FROM g WHERE json_type(item) <> 'NULL'",
    "p1_holes": _P1_PARTS + f", r AS ({_BELOW.format(p='$.geometry.holes')}), g AS (SELECT record_id, owner_kind, owner_ord, child_ord AS hole_ord, unnest(json_extract(item, '$[*]')) AS item, unnest(range(len(json_extract(item, '$[*]')))) AS child_ord FROM r WHERE json_type(item) = 'ARRAY') " + _KEYS + "hole_ord::INT AS hole_ord, child_ord::INT AS child_ord, " + ", ".join(f"{_AXIS.format(k=k, n=n)} AS {n}" for k, n in enumerate("xyz")) + " FROM g WHERE json_type(item) <> 'NULL'",
    "p1_details": _P1_PARTS + _KEYS + ", ".join(_VALUE.format(v=f"json_extract(o, '$.{p}')") + f" AS {n}" for n, p in nested.DETAILS.items()) + " FROM owners WHERE json_type(o) = 'OBJECT'",
    "p5_found": _P5 + "SELECT field_name, owner_uuid, target_key FROM gone",
    "p5_report": _P5 + "SELECT field_name, strftime(l, '%Y-%m') AS period, count(*) AS n_orphans FROM gone GROUP BY ALL",
}
