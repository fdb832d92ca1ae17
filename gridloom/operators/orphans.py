"""References to records that don't exist, were deleted, or came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.skew import HEAVY_KEYS, HEAVY_ROWS, heavy_keys, lookup
from gridloom.session import Scratch

#: Blanks that count as outer ones.
OUTER_BLANKS = r"^[\s\p{Z}\x{FEFF}\x{200B}]+|[\s\p{Z}\x{FEFF}\x{200B}]+$"
#: List fields of a space and the kind of row each refers to.
SPACE_FIELDS = (("related_walls", "wall"), ("neighbors", "space"), ("related_doors", "door"))
KEY = ["target_kind", "project_id", "target_key"]


def reference_key(c: Column) -> Column:
    """Without outer blanks, in lower case; null where nothing is left."""
    k = F.lower(F.regexp_replace(c, OUTER_BLANKS, ""))
    return F.when(k != "", k)


def space_references(spaces: DataFrame) -> DataFrame:
    """One row per distinct reference of each delivery of a space; null lists and items give none."""
    lists = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(t).alias("target_kind"), F.col(f).alias("refs")) for f, t in SPACE_FIELDS])
    one = spaces.select("project_id", F.col("uuid").alias("owner_uuid"), "loaded_at", F.explode(lists).alias("l"))
    one = one.select("project_id", "owner_uuid", "loaded_at", "l.field_name", "l.target_kind", F.explode(F.array_distinct(F.transform("l.refs", reference_key))).alias("target_key"))
    return one.where(F.col("target_key").isNotNull())


def window_references(openings: DataFrame) -> DataFrame:
    one = openings.where(F.col("category") == "WINDOW").select("project_id", F.col("uuid").alias("owner_uuid"), "loaded_at", F.lit("parent_wall").alias("field_name"), F.lit("wall").alias("target_kind"), reference_key(F.col("parent_wall")).alias("target_key"))
    return one.where(F.col("target_key").isNotNull())


def targets(walls: DataFrame, spaces: DataFrame, openings: DataFrame) -> DataFrame:
    """One row for each key that a reference may name: its first load and its deletion (the earliest)."""
    def kind(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("target_kind"), "project_id", reference_key(F.col("uuid")).alias("target_key"), "loaded_at", "deleted_at")
    rows = kind(walls, "wall").unionByName(kind(spaces, "space")).unionByName(kind(openings.where(F.col("category") == "DOOR"), "door"))
    return rows.where(F.col("target_key").isNotNull()).groupBy(*KEY).agg(F.min("loaded_at").alias("target_load"), F.min("deleted_at").alias("deleted_at"))


def _gone(found: Column, load: Column) -> Column:
    """Whether a reference at this load is an orphan. An unknown load or deletion time decides nothing."""
    return found.isNull() | F.coalesce(F.col("deleted_at") <= load, F.lit(False)) | F.coalesce(F.col("target_load") > load, F.lit(False))


def _month(c: str) -> Column:
    return F.date_format(c, "yyyy-MM")


def key_counts(refs: DataFrame, scratch: Scratch) -> DataFrame:
    """References by field, key and month of the owner's load, partly aggregated before the shuffle."""
    return scratch.save(refs.withColumn("period", _month("owner_load")).groupBy("field_name", *KEY, "period").agg(F.count(F.lit(1)).alias("n")), "key-period")


def orphan_references(refs: DataFrame, facts: DataFrame, scratch: Scratch, heavy_rows: int = HEAVY_ROWS, max_heavy: int = HEAVY_KEYS) -> DataFrame:
    """field_name, owner_uuid, target_key, project_id, period of each orphan.

    refs: field_name, target_kind, project_id, owner_uuid, target_key, owner_load.
    Counts per key and month are made first; keys heavy in them are checked against a
    broadcast, all others by a shuffle join. Only a missing target makes a reference of
    unknown load an orphan. A null project is a project of its own."""
    heavy, n_heavy = heavy_keys(key_counts(refs, scratch), KEY, "n", heavy_rows, max_heavy)
    seen = lookup(refs.withColumn("period", _month("owner_load")), facts, KEY, heavy, n_heavy)
    return seen.where(_gone(F.col("_found"), F.col("owner_load"))).select("field_name", "owner_uuid", "target_key", "project_id", "period")


def orphan_counts(refs: DataFrame, facts: DataFrame, scratch: Scratch, heavy_rows: int = HEAVY_ROWS, max_heavy: int = HEAVY_KEYS) -> DataFrame:
    """field_name, period, n_orphans, from the counts per key and month.

    A key without a target, or in a month before its target's load or after its deletion, is an
    orphan with all its references, and one between them with none: such counts are
    checked and summed as they are, heavy keys by broadcast, the rest by shuffle join. Only in the
    very month of the load or deletion are single references looked at."""
    counts = key_counts(refs, scratch)
    heavy, n_heavy = heavy_keys(counts, KEY, "n", heavy_rows, max_heavy)
    checked = lookup(counts, facts, KEY, heavy, n_heavy)
    begun, ended = _month("target_load"), _month("deleted_at")
    period = F.col("period")
    wholly = F.col("_found").isNull() | F.coalesce(period < begun, F.lit(False)) | F.coalesce(period > ended, F.lit(False))
    split = ~wholly & (F.coalesce(period == begun, F.lit(False)) | F.coalesce(period == ended, F.lit(False)))
    checked = scratch.save(checked.withColumns({"wholly": wholly, "split": split}), "checked")
    few = checked.where("split").select("field_name", *KEY, "period", "target_load", "deleted_at", F.lit(True).alias("_found"))
    rows = refs.withColumn("period", _month("owner_load"))
    on = F.lit(True)
    for c in ("field_name", *KEY, "period"):
        on = on & rows[c].eqNullSafe(few[c])
    single = rows.join(few, on).where(_gone(F.col("_found"), F.col("owner_load"))).groupBy(rows["field_name"], rows["period"]).agg(F.count(F.lit(1)).alias("n"))
    both = checked.where("wholly").groupBy("field_name", "period").agg(F.sum("n").alias("n")).unionByName(single)
    return both.groupBy("field_name", "period").agg(F.sum("n").alias("n_orphans"))


def model_references(spaces: DataFrame, openings: DataFrame, scratch: Scratch) -> DataFrame:
    """The distinct references of the four fields, with the first load of their owner."""
    refs = space_references(spaces).unionByName(window_references(openings))
    refs = refs.groupBy("field_name", "target_kind", "project_id", "owner_uuid", "target_key").agg(F.min("loaded_at").alias("ref_load"))
    owners = spaces.select("project_id", "uuid", "loaded_at", F.lit(True).alias("is_space")).unionByName(openings.where(F.col("category") == "WINDOW").select("project_id", "uuid", "loaded_at", F.lit(False).alias("is_space")))
    loads = owners.groupBy(F.col("project_id").alias("_p"), F.col("uuid").alias("_u"), F.col("is_space").alias("_s")).agg(F.min("loaded_at").alias("owner_load"))
    on = refs["project_id"].eqNullSafe(loads["_p"]) & refs["owner_uuid"].eqNullSafe(loads["_u"]) & ((refs["field_name"] != "parent_wall") == loads["_s"])
    return scratch.save(refs.join(loads, on).drop("_p", "_u", "_s", "ref_load"), "refs")


def model_orphans(walls: DataFrame, spaces: DataFrame, openings: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Orphans of the flat model's four reference fields; deleted owners count too.

    Rows delivered twice count once. Empty tables give no rows; columns besides the
    named ones aren't read."""
    scratch = Scratch(spaces.sparkSession, "orphans")
    return orphan_references(model_references(spaces, openings, scratch), targets(walls, spaces, openings), scratch, heavy_rows)


def orphan_report(walls: DataFrame, spaces: DataFrame, openings: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Orphan references per field and month of the owner's load."""
    scratch = Scratch(spaces.sparkSession, "orphans")
    return orphan_counts(model_references(spaces, openings, scratch), targets(walls, spaces, openings), scratch, heavy_rows)
