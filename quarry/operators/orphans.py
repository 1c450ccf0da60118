"""References to records that do not exist, or came later: problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import bloom


def orphan_references(refs: DataFrame, parents: DataFrame, log2_words: int | None = None) -> DataFrame:
    """(ref_table, ref_id, ref_month, ref_state) of the references without a timely parent.

    refs: (ref_table string, ref_id long, parent_id long, own_time timestamp); parents: (id long, seen timestamp).
    Other columns are ignored. A broadcast Bloom filter of the parent ids parts the references: those it denies are
    `missing` for certain and never meet the parent table; only the others are verified by an exact join on the
    parent's earliest `seen`. A parent_id not found there is `missing`, one whose earliest `seen` is after own_time is
    `late`. Null parent_id: no reference. Null own_time or `seen`: can be missing, not late; its month is null.
    Repeated (ref_table, ref_id) count once: equal verdicts are merged.

    The filters are sized by the number of distinct keys, up to 2**22 words (50 MB); a fuller one passes more references on to the
    exact join, which takes any number. log2_words fixes the size of both.

    Skew: the references are reduced to distinct keys before the exact join, so a parent named by a third of all
    references is looked up once. The parent side is pre-aggregated, on the map side first.
    """
    refs = refs.select("ref_table", "ref_id", "parent_id", "own_time").where(F.col("parent_id").isNotNull())
    size = lambda rows, key: log2_words or bloom.words_for(rows.agg(F.approx_count_distinct(key)).first()[0])
    of_parents, of_refs = size(parents, "id"), size(refs, "parent_id")
    tested = bloom.flag(refs, F.col("parent_id"), bloom.build(parents, "id", of_parents), "maybe", of_parents)
    month = F.date_format("own_time", "yyyy-MM")
    denied = tested.where(~F.col("maybe")).select("ref_table", "ref_id", month.alias("ref_month"), F.lit("missing").alias("ref_state"))
    open_refs = tested.where("maybe").drop("maybe")

    wanted = open_refs.select(F.col("parent_id").alias("id")).distinct()
    named = bloom.flag(parents.select("id", "seen"), F.col("id"), bloom.build(wanted, "id", of_refs), "named", of_refs)
    earliest = named.where("named").groupBy("id").agg(F.min("seen").alias("first_seen"), F.lit(True).alias("there"))
    looked_up = wanted.join(earliest, "id", "left").select(F.col("id").alias("parent_id"), "first_seen", F.coalesce("there", F.lit(False)).alias("there"))
    # few keys, many references: the hot key's rows are spread by a salt, its one lookup row is copied to each salt
    salts = 16
    salted = open_refs.withColumn("salt", F.pmod(F.xxhash64("ref_id"), F.lit(salts)).cast("int"))
    spread = looked_up.where("not there or first_seen is not null").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    state = F.when(~F.col("there"), "missing").when(F.col("first_seen") > F.col("own_time"), "late")
    verified = salted.join(spread, ["parent_id", "salt"]).select("ref_table", "ref_id", month.alias("ref_month"), state.alias("ref_state")).where("ref_state is not null")
    return denied.unionByName(verified).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month and state: (ref_table, ref_month, ref_state, n long)."""
    return orphans.groupBy("ref_table", "ref_month", "ref_state").agg(F.count(F.lit(1)).alias("n"))


def code_references(memories: DataFrame, routes: DataFrame) -> DataFrame:
    """The references of notes (own time created_at) and routes (own time indexed_at) in one shape."""
    notes = memories.select(F.lit("memories").alias("ref_table"), F.col("id").alias("ref_id"), F.col("symbol_id").alias("parent_id"), F.col("created_at").alias("own_time"))
    calls = routes.select(F.lit("routes").alias("ref_table"), F.col("id").alias("ref_id"), F.col("handler_symbol_id").alias("parent_id"), F.col("indexed_at").alias("own_time"))
    return notes.unionByName(calls)
