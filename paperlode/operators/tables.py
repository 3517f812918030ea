"""Tables rebuilt from page fragments. Order within a document is a window; a decision for a page pair is an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import let
from ..functions.text import is_ditto
from .facts import classify

FIELDS = ["serial", "owner", "village", "area", "valuation"]
VERTICAL, COVERAGE = 0.7, 0.5


def field_sets(rows: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """doc_id, page_number, fields: the sorted names that hold something anywhere on the page."""
    # numbers, not names: these are summed up in a hash map, where strings would be sorted
    seen = [F.max(F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) != "", F.lit(1))).alias(f) for f in fields]
    out = rows.groupBy("doc_id", "page_number").agg(*seen)
    names = F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in fields])
    return out.select("doc_id", "page_number", F.array_sort(F.array_compact(names)).alias("fields"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def page_pairs(sets: DataFrame, schema_size: int = len(FIELDS)) -> DataFrame:
    """Consecutive pages: doc_id, page_number (the later), a, b, similarity, relation, shape_hash."""
    w = Window.partitionBy("doc_id").orderBy("page_number")
    pairs = sets.select("doc_id", "page_number", F.lag("fields").over(w).alias("a"), F.col("fields").alias("b")).filter("a is not null")
    cover = F.size(F.array_union("a", "b")) / schema_size
    s = jaccard(F.col("a"), F.col("b"))
    disjoint = F.size(F.array_intersect("a", "b")) == 0
    relation = F.when(F.size("b") == 0, "vertical").when(s >= VERTICAL, "vertical").when(disjoint & (cover >= COVERAGE), "horizontal").otherwise("ambiguous")
    shape = F.sha2(F.concat(F.array_join("a", ","), F.lit("|"), F.array_join("b", ",")), 256)
    return pairs.withColumns({"similarity": s, "relation": relation, "shape_hash": shape})


def segments(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, page_number, segment: a new one wherever the relation to the page before is not vertical."""
    w = Window.partitionBy("doc_id").orderBy("page_number")
    rows = sets.join(pairs.select("doc_id", "page_number", "relation"), ["doc_id", "page_number"], "left")
    breaks = F.when(F.col("relation").isNull() | (F.col("relation") != "vertical"), 1).otherwise(0)
    return rows.select("doc_id", "page_number", F.sum(breaks).over(w).alias("segment"))


def merge_continuations(rows: DataFrame, text_columns: list[str], carry: list[str] | None = None) -> DataFrame:
    """Rows with a blank serial add their text to the record before them; a segment that begins with one stays as it is.

    rows: doc_id, segment, page_number, pos, serial and the columns. source_index: page:pos of the rows that made it.
    carry: adds sources, an array of those rows with page_number, pos, the text columns and these columns.
    """
    w = Window.partitionBy("doc_id", "segment").orderBy("page_number", "pos")
    filled = F.trim(F.coalesce("serial", F.lit(""))) != ""
    rows = rows.withColumn("rec", F.sum(filled.cast("int")).over(w))
    rows = rows.withColumn("lead", F.min("rec").over(Window.partitionBy("doc_id", "segment")) == 0)
    key = F.when(F.col("lead"), F.struct("page_number", "pos")).otherwise(F.struct(F.lit(0).cast(rows.schema["page_number"].dataType).alias("page_number"), F.col("rec").cast(rows.schema["pos"].dataType).alias("pos")))
    lines = F.array_sort(F.collect_list(F.struct("page_number", "pos", "serial", *text_columns, *(carry or []))))
    out = rows.groupBy("doc_id", "segment", key.alias("k")).agg(lines.alias("x"), F.first("lead").alias("unmerged"))

    def text_of(c: str) -> Column:
        parts = F.transform("x", lambda r: F.trim(F.coalesce(r[c], F.lit(""))))
        return F.trim(F.array_join(F.filter(parts, lambda v: v != ""), " ")).alias(c)

    joined = [text_of(c) for c in text_columns]
    index = F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["page_number"].cast("string"), r["pos"].cast("string"))), ",").alias("source_index")
    return out.select("doc_id", "segment", F.col("x")[0]["page_number"].alias("page_number"), F.col("x")[0]["pos"].alias("pos"), F.col("x")[0]["serial"].alias("serial"), *joined, F.size("x").cast("long").alias("source_rows"), index, "unmerged", *([F.col("x").alias("sources")] if carry else []))


def facts_of(rows: DataFrame, fields: list[str], dittos: list[str]) -> DataFrame:
    """One fact for each record and field: doc_id, segment, page_number, pos (of the record), field, value, regions,
    confidence, is_handwritten, status, source_index.

    rows: doc_id, segment, page_number, pos, serial, the fields, confidence, is_handwritten, y0, y1 (null: no box). Ditto
    marks in `dittos` are filled first, continuation rows are merged, and what a record holds of a field comes from
    those of its rows whose cell is not blank: their boxes are the fact's regions, their mean confidence is its own, and
    it is handwritten if one of them is. A mark that nothing fills stays in the value, which says so, and sends the fact
    to review. A row that is given twice counts once; a fact without a box inside its page is not written.
    """
    # rows are dealt by segment once; then what repeats a place stands beside it, and one sort serves all windows
    w = Window.partitionBy("doc_id", "segment").orderBy("page_number", "pos")
    place = F.struct("page_number", "pos")
    once = rows.repartition("doc_id", "segment").withColumn("__again", F.lag(place).over(w).eqNullSafe(place)).filter("not __again").drop("__again")
    filled = expand_dittos(once, dittos)
    flags = [f"{c}_unresolved" for c in dittos]
    made = merge_continuations(filled, fields, ["confidence", "is_handwritten", "y0", "y1", *flags])

    def fact(field: str) -> Column:
        def of(own: Column) -> Column:
            boxed = F.filter(own, lambda r: (r["y0"] >= 0) & (r["y1"] > r["y0"]) & (r["y1"] <= 1))
            regions = F.transform(boxed, lambda r: F.struct(r["page_number"].alias("page_number"), r["y0"].cast("double").alias("y0"), r["y1"].cast("double").alias("y1")))
            sure = F.filter(F.transform(own, lambda r: r["confidence"].cast("double")), lambda c: c.isNotNull())
            mean = let(sure, lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, c: a + c) / F.size(x)))
            open_ = F.exists(own, lambda r: r[f"{field}_unresolved"]) if field in dittos else F.lit(False)
            return F.struct(F.lit(field).alias("field"), F.col(field).alias("text"), regions.alias("regions"), mean.alias("confidence"), F.exists(own, lambda r: r["is_handwritten"]).alias("is_handwritten"), open_.alias("unresolved"))

        return let(F.filter("sources", lambda r: F.trim(F.coalesce(r[field], F.lit(""))) != ""), of)

    out = made.select("doc_id", "segment", "page_number", "pos", "source_index", F.explode(F.array(*[fact(f) for f in fields])).alias("f")).select("doc_id", "segment", "page_number", "pos", "source_index", "f.*")
    out = out.filter((F.col("text") != "") & (F.size("regions") > 0))
    value = F.when(F.col("unresolved"), F.to_json(F.struct(F.col("text").alias("v"), F.lit(True).alias("unresolved_ditto")))).otherwise(F.to_json(F.struct(F.col("text").alias("v"))))
    status = F.when(F.col("unresolved"), "in_review").otherwise(classify(F.round("confidence", 9), F.col("is_handwritten")))
    return out.select("doc_id", "segment", "page_number", "pos", "field", value.alias("value"), "regions", "confidence", "is_handwritten", status.alias("status"), "source_index")


def expand_dittos(rows: DataFrame, columns: list[str], anchor: str | None = None) -> DataFrame:
    """Ditto marks take the value above them in their column, within a document and segment.

    A null or empty value is a value too and is inherited as such. With an anchor, a genuine change of the anchor
    column ends all chains, its own row included. Adds <column>_inherited and <column>_unresolved.
    """
    part = ["doc_id", "segment"]
    order = ["page_number", "pos"]
    if anchor:
        w = Window.partitionBy(*part).orderBy(*order)
        genuine = F.when((F.trim(F.coalesce(anchor, F.lit(""))) != "") & ~is_ditto(F.col(anchor)), F.col(anchor))
        before = F.last(genuine, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("__new", F.when(genuine.isNotNull() & before.isNotNull() & (genuine != before), 1).otherwise(0))
        rows = rows.withColumn("__era", F.sum("__new").over(w))
    # eras only grow in this order, so a value of another era ends the chain, and no second sort by era is needed
    era = F.col("__era") if anchor else F.lit(0)
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows
    for c in columns:
        mark = is_ditto(F.col(c))
        # the struct keeps nulls as values
        chain = F.last(F.when(~mark, F.struct(F.col(c).alias("v"), era.alias("era"))), ignorenulls=True).over(w)
        out = out.withColumn(f"__{c}", chain)
    if anchor:
        out = out.withColumns({f"__{c}": F.when(F.col(f"__{c}.era") == era, F.col(f"__{c}")) for c in columns})
    keep = [x for x in rows.columns if x not in columns and not x.startswith("__")]
    made = []
    for c in columns:
        mark, chain = is_ditto(F.col(c)), F.col(f"__{c}")
        made += [F.when(mark & chain.isNull(), F.col(c)).otherwise(chain["v"]).alias(c), (mark & chain.isNotNull()).alias(f"{c}_inherited"), (mark & chain.isNull()).alias(f"{c}_unresolved")]
    return out.select(*keep, *made)


def spread_join(left: DataFrame, right: DataFrame, key: list[str], serial: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Facing halves joined on serial where both hold the same serials: (merged rows, pairs that need review).

    A serial that repeats counts once, its last row by pos. The right side's values win where both have a column.
    """
    last = lambda df: df.groupBy(*key, serial).agg(F.max_by(F.struct(*[F.col(c) for c in columns]), "pos").alias("v"))
    both = last(left).withColumnRenamed("v", "l").join(last(right).withColumnRenamed("v", "r"), [*key, serial], "full_outer")
    names = lambda side: F.array_join(F.array_sort(F.collect_list(F.when(F.col(side).isNull(), F.col(serial)))), ",")
    sides = both.groupBy(*key).agg(names("r").alias("only_left"), names("l").alias("only_right"))
    bad = sides.filter("only_left <> '' or only_right <> ''")
    merged = both.join(bad.select(*key), key, "left_anti").select(*key, serial, *[F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}")).alias(c) for c in columns])
    return merged, bad


def match_by_key(left: DataFrame, right: DataFrame, pair: list[str], key: str) -> DataFrame:
    """pair, left_pos, right_pos: matches, and leftovers of each side with the other null. Blank keys are leftovers;
    of left rows with one key the last matches; right rows with one key all do."""
    held = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    last = left.filter(held(key)).groupBy(*pair, key).agg(F.max("pos").alias("left_pos"))
    rows = right.filter(held(key)).select(*pair, key, F.col("pos").alias("right_pos"))
    matched = last.join(rows, [*pair, key]).select(*pair, "left_pos", "right_pos")
    l_rest = left.filter(~held(key)).select(*pair, F.col("pos").alias("left_pos")).unionByName(last.join(rows.select(*pair, key), [*pair, key], "left_anti").select(*pair, "left_pos"))
    r_rest = right.filter(~held(key)).select(*pair, F.col("pos").alias("right_pos")).unionByName(rows.join(last.select(*pair, key), [*pair, key], "left_anti").select(*pair, "right_pos"))
    return matched.unionByName(l_rest, allowMissingColumns=True).unionByName(r_rest, allowMissingColumns=True)


def join_horizontally(left: DataFrame, right: DataFrame, pair: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(matches, outcomes) of facing pairs: pair, left_pos, right_pos; and pair, outcome, matched, placed.

    Rows meet by key; what is left over on both sides meets by position. Where both sides have keys and none meets the
    pair is a conflict and never joined by position. Without keys on a side rows meet by position, or not at all.
    left, right: pair, pos, key, y0, y1.
    """
    by_key = match_by_key(left, right, pair, key).filter("left_pos is not null and right_pos is not null")
    has = lambda df, name: df.groupBy(*pair).agg(F.max(F.trim(F.coalesce(key, F.lit(""))) != "").alias(name))
    matched = by_key.groupBy(*pair).agg(F.count("*").alias("matched"))
    state = has(left, "lk").join(has(right, "rk"), pair).join(matched, pair, "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    conflict = F.col("lk") & F.col("rk") & (F.col("matched") == 0)
    free = state.filter(~conflict).select(*pair)
    rest = lambda df, name: df.join(free, pair, "left_semi").join(by_key.select(*pair, F.col(name).alias("pos")), [*pair, "pos"], "left_anti")
    by_place = pair_by_position(rest(left, "left_pos"), rest(right, "right_pos"), pair)
    out = state.join(by_place.groupBy(*pair).agg(F.count("*").alias("placed")), pair, "left").withColumn("placed", F.coalesce("placed", F.lit(0)))
    outcome = F.when(conflict, "conflict").when(F.col("matched") > 0, "by_key").when(F.col("placed") > 0, "by_position").otherwise("vetoed")
    return by_key.unionByName(by_place), out.select(*pair, outcome.alias("outcome"), "matched", "placed")


def pair_by_position(left: DataFrame, right: DataFrame, pair: list[str]) -> DataFrame:
    """pair, left_pos, right_pos, by containment: the side with fewer rows holds the spans, and every other row's centre
    must lie in exactly one. A pair of pages with any row that does not, or with an empty side, gives nothing.

    left, right: pair, pos, y0, y1 (null where there is no box).
    """
    n = lambda df, name: df.groupBy(*pair).agg(F.count("*").alias(name), F.count_if(F.col("y0").isNull()).alias(name + "_bare"))
    sizes = n(left, "nl").join(n(right, "nr"), pair).filter("nl_bare = 0 and nr_bare = 0").withColumn("left_holds", F.col("nl") <= F.col("nr"))
    l, r = left.select(*pair, F.col("pos").alias("left_pos"), F.col("y0").alias("l0"), F.col("y1").alias("l1")), right.select(*pair, F.col("pos").alias("right_pos"), F.col("y0").alias("r0"), F.col("y1").alias("r1"))
    lc, rc = (F.col("l0") + F.col("l1")) / 2, (F.col("r0") + F.col("r1")) / 2
    inside = F.when(F.col("left_holds"), (rc >= F.col("l0")) & (rc <= F.col("l1"))).otherwise((lc >= F.col("r0")) & (lc <= F.col("r1")))
    met = sizes.join(l, pair).join(r, pair).filter(inside)
    other = F.when(F.col("left_holds"), F.col("right_pos")).otherwise(F.col("left_pos"))
    once = met.groupBy(*pair, other.alias("other"), "left_holds", "nl", "nr").agg(F.count("*").alias("c"))
    good = once.groupBy(*pair, "left_holds", "nl", "nr").agg(F.count_if(F.col("c") == 1).alias("ones"), F.count("*").alias("met"))
    good = good.filter((F.col("ones") == F.col("met")) & (F.col("met") == F.when(F.col("left_holds"), F.col("nr")).otherwise(F.col("nl"))))
    return met.join(good.select(*pair), pair, "left_semi").select(*pair, "left_pos", "right_pos")
