"""Records that differ only in how they are written: progressive partition refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.skew import HEAVY_KEYS, HEAVY_ROWS, heavy_keys, lookup
from gridloom.session import Scratch

NUMBER = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
#: ASCII letters whose case forms are only each other (no dotted or long forms, no ligature).
PLAIN_LETTERS = ("bcd", "egm", "opruvxz")
#: Digits counted together: nearly as telling as each by itself, at half the cost.
DIGIT_GROUPS = ("12", "34", "56", "78", "9")
FORMATTING = r"[\s\p{Z}\p{P}$+<=>^`|~]"


def layer_key(c: Column) -> Column:
    """Without whitespace and punctuation, in one letter case; all four Turkish i are one letter."""
    bare = F.upper(F.lower(F.regexp_replace(c, FORMATTING, "")))
    return F.regexp_replace(F.regexp_replace(bare, "I\u0307", "I"), "İ", "I")


def _number(text: Column) -> Column:
    return (F.regexp_replace(text, ",", ".").try_cast("double") + F.lit(0.0)).cast("string")


def point_key(c: Column) -> Column:
    """'x|y|z' as numbers, z empty where absent, of a point in any notation; the text
    itself without blanks where it names no point.

    Named coordinates (JSON too) may stand in any order. In bare ones a comma between
    digits is a decimal mark where no decimal point occurs and something else separates
    the numbers, or where commas alone make two or three pairs."""
    axis = lambda a: F.regexp_extract(c, rf"(?i){a}[\"']?\s*[:=]\s*[\"']?([-+]?(?:[0-9]+(?:[.,][0-9]+)?|[.,][0-9]+)(?:e[-+]?[0-9]+)?)", 1)
    x, y, z = axis("x"), axis("y"), axis("z")
    named = F.concat_ws("|", _number(x), _number(y), F.when(z != "", _number(z)).otherwise(F.lit("")))
    tight = F.regexp_replace(c, r"^[\s\p{P}&&[^-+.]]+|[\s\p{P}&&[^-+.]]+$", "")
    decimal_comma = ~F.contains(tight, F.lit(".")) & (F.rlike(tight, F.lit(r"[0-9]\s*[;|/]|[0-9],?\s+[-+0-9]")) | F.rlike(tight, F.lit(r"^[-+]?[0-9]+,[0-9]+,[-+]?[0-9]+,[0-9]+(,[-+]?[0-9]+,[0-9]+)?$")))
    pairs = F.regexp_replace(tight, r"([0-9]),([0-9]+)", "$1.$2")
    numbers = F.regexp_extract_all(F.when(decimal_comma, pairs).otherwise(tight), F.lit(NUMBER), F.lit(0))
    values = F.transform(numbers, lambda n: (n.try_cast("double") + F.lit(0.0)).cast("string"))
    bare = F.concat_ws("|", values, F.when(F.size(numbers) == 2, F.lit("")))
    raw = F.concat(F.lit("?"), F.regexp_replace(c, r"[\s\p{Z}]", ""))
    is_named = F.rlike(c, F.lit(r"(?i)[xyz][\"']?\s*[:=]"))
    return F.when(is_named, F.when((x != "") & (y != ""), named).otherwise(raw)).when(F.size(numbers).isin(2, 3), bare).otherwise(raw)


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def cheap_class(scope: list[str], layer: Column, points: list[Column]) -> Column:
    """A hash of invariants that all ways of writing share: the scope, counts of
    plain letters in the layer, and the histogram of the digits 1 to 9 of each point. A point with an exponent, of which the digits may differ, counts by
    its number."""
    low = F.lower(layer)
    parts: list[Column] = [*map(F.col, scope), *[_count_of(low, letters) for letters in PLAIN_LETTERS]]
    for p in points:
        plain = F.when(F.rlike(p, F.lit("[0-9.][eE][-+0-9]")), _spelled(point_key(p))).otherwise(p)
        parts += [_count_of(plain, digits) for digits in DIGIT_GROUPS]
    return F.xxhash64(*parts)


def _spelled(key: Column) -> Column:
    """A point key with each number in plain digits."""
    return F.concat_ws("|", F.transform(F.split(key, r"\|"), lambda n: F.coalesce(n.try_cast("decimal(38,12)").cast("string"), n)))


def _with_key(df: DataFrame, scope: list[str], layer: str, points: list[str]) -> DataFrame:
    """The costly key as three parts, so that equal text can't arise from different parts."""
    return df.withColumn("key", F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(s).cast("string")), F.lit("")) for s in scope], layer_key(F.col(layer)), *[point_key(F.col(p)) for p in points])))


def copies(df: DataFrame, row_id: str = "row_id", scope: tuple[str, ...] = ("project_id", "entity_type"), layer: str = "layer", points: tuple[str, ...] = ("start_pt", "end_pt"), heavy_rows: int = HEAVY_ROWS, max_heavy: int = HEAVY_KEYS) -> DataFrame:
    """first_id, copy_id: the other members of each set of copies.

    1. Cheap classes are counted (partly aggregated; 16 bytes a class are shuffled).
    2. Rows of classes with several members get the costly key. They are shuffled by
       class once; a set of copies lies inside one class, so that no further shuffle follows.
    3. Rows of heavy classes (a bounded number) aren't gathered: their first ids come from
       partly aggregated groups, which are then looked up.
    A row with a null layer or point is never a copy; null scope values equal each
    other; repeated rows of one row_id count once. Extra columns aren't read."""
    scratch = Scratch(df.sparkSession, "copies")
    scope_, points_ = list(scope), list(points)
    rows = df.select(F.col(row_id).alias("row_id"), *scope_, layer, *points_).dropna(subset=["row_id", layer, *points_])
    rows = rows.withColumn("h", cheap_class(scope_, F.col(layer), [F.col(p) for p in points_]))
    classes = scratch.save(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "classes")
    heavy, n_heavy = heavy_keys(classes, ["h"], "n", heavy_rows, max_heavy)
    several = classes.select("h")
    usual = rows
    if n_heavy:
        hot_h = F.broadcast(heavy)
        usual = rows.join(hot_h, "h", "left_anti")
        several = several.join(hot_h, "h", "left_anti")
    usual = _with_key(usual.join(several, "h", "left_semi"), scope_, layer, points_).select("h", "key", "row_id")
    first = usual.withColumn("first_id", F.min("row_id").over(Window.partitionBy("h", "key")))
    out = first.where(F.col("row_id") > F.col("first_id")).groupBy("h", "key", "first_id", "row_id").agg(F.lit(1)).select("first_id", F.col("row_id").alias("copy_id"))
    if n_heavy:
        hot = _with_key(rows.join(hot_h, "h", "left_semi"), scope_, layer, points_).select("key", "row_id")
        hot = scratch.save(hot.groupBy("key", "row_id").agg(F.lit(1)).select("key", "row_id"), "hot")
        firsts = scratch.save(hot.groupBy("key").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "firsts")
        top, n_top = heavy_keys(firsts, ["key"], "n", heavy_rows, max_heavy)
        found = lookup(hot, firsts.select("key", "first_id"), ["key"], top, n_top)
        out = out.unionByName(found.where(F.col("row_id") > F.col("first_id")).select("first_id", F.col("row_id").alias("copy_id")))
    return out


def collapsed(df: DataFrame, row_id: str = "row_id", **how) -> DataFrame:
    """One record for each row that is no copy of an earlier one, with all its columns and n_copies (itself included)."""
    found = Scratch(df.sparkSession, "collapsed").save(copies(df, row_id, **how))
    counts = found.groupBy(F.col("first_id").alias(row_id)).agg((F.count(F.lit(1)) + 1).alias("n_copies"))
    kept = df.join(found.select(F.col("copy_id").alias(row_id)), row_id, "left_anti")
    return kept.join(counts, row_id, "left").withColumn("n_copies", F.coalesce("n_copies", F.lit(1)))
