"""Index lines of books put into the subject index, in their order.

A line may create a subject, or an alias of one, that a later line then finds. Lines are not folded one by one: every line's outcome
is worked out from the outcomes of all lines in the round before, and rounds go on until none changes. As an outcome depends on earlier
lines only, the first lines are right after one round, those that hang on them after two, and so on; most batches take two.

Both sides of all joins grow with the index or the batch. They are read from files so small, packed, that Spark would pass one side whole
through the driver to broadcast it; the hints keep them to sorted merges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import normalize_label, normalize_search, slugify
from quire.operators.resolve import exact_subjects, resolved, subject_keys
from quire.session import materialize


def free_slugs(bases: DataFrame, taken: DataFrame) -> DataFrame:
    """(base, slug): for each base (base) itself or, where it is among the taken ids (id), it with the lowest number from 2 on that isn't."""
    bases = bases.select("base").distinct()
    number = F.regexp_extract("id", "^(.+)-([1-9][0-9]{0,8})$", 2).try_cast("int")
    stems = taken.select(F.regexp_extract("id", "^(.+)-([1-9][0-9]{0,8})$", 1).alias("base"), number.alias("k")).where("k > 1")
    used = stems.join(bases.hint("merge"), "base", "left_semi").groupBy("base").agg(F.array_sort(F.collect_set("k")).alias("used"))
    rows = bases.join(taken.select(F.col("id").alias("base"), F.lit(True).alias("there")).distinct().hint("merge"), "base", "left").join(used.hint("merge"), "base", "left")
    free = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), F.lit(2), lambda n, k: F.when(k == n, n + 1).otherwise(n))
    return rows.select("base", F.when(F.col("there"), F.concat("base", F.lit("-"), free.cast("string"))).otherwise(F.col("base")).alias("slug"))


def _ordered(subjects: DataFrame) -> DataFrame:
    """subjects with their place in the index, which is sorted by label."""
    return subjects.select("id", "label", "aliases", F.struct(normalize_label(F.coalesce("label", F.lit(""))).alias("k"), "id").alias("place"))


def _rank(new: bool, name: Column, at: Column, slug: Column) -> Column:
    return F.struct(F.lit(new).alias("new"), name.alias("name"), at.alias("at"), slug.alias("id"))


def _earlier(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(at, hit): for each line the first subject, in order, that got the line's key as an alias from an earlier line."""
    asked = lines.join(names.select("key").distinct().hint("merge"), "key", "left_semi").select("key", "at", F.lit(0).alias("kind"), F.lit(None).cast(names.schema["rank"].dataType).alias("rank"))
    told = names.select("key", "at", F.lit(1).alias("kind"), "rank")
    so_far = Window.partitionBy("key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return asked.unionByName(told).withColumn("hit", F.min("rank").over(so_far)).where("kind = 0 and hit is not null").select("at", "hit")


def _settled(lines: DataFrame, given: DataFrame) -> DataFrame:
    """(at, action, subject, created) of lines (at, key, own, slug, refers) that no subject of the index has, given the names (key, at, rank) that other lines add.

    A line whose slug an earlier line has created finds that subject, by its name or as another name of it; else it finds the
    subject that an earlier line gave its name to; else it creates one. `created` is the line that did.
    """
    names, before = given, None
    while True:
        hits = lines.join(_earlier(lines, names).hint("merge"), "at", "left")
        makers = hits.where("hit is null").groupBy("slug").agg(F.min(F.struct("at", "key")).alias("made"))
        rows = hits.join(makers.hint("merge"), "slug", "left")
        late, makes = F.coalesce(F.col("at") > F.col("made.at"), F.lit(False)), F.coalesce(F.col("at") == F.col("made.at"), F.lit(False))
        action = F.when(makes, "new").when(late & (F.col("key") != F.col("made.key")), "alias").otherwise("match")
        rows = rows.select("at", "own", "refers", action.alias("action"), F.when(late | makes, F.col("slug")).otherwise(F.col("hit.id")).alias("subject"), F.when(late | makes, F.col("made.at")).alias("created"))
        rows = materialize(rows)
        added = rows.where("action = 'alias' or (action = 'new' and refers)").select(F.col("own").alias("key"), "at", _rank(True, F.lit(""), F.col("created"), F.col("subject")).alias("rank"))
        state = added.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("key", "at", "rank.at", "rank.id"))).first()
        if state == before or (before is None and state[0] == 0):
            return rows.select("at", "action", "subject", "created")
        names, before = given.unionByName(added), state


def indexed_books(subjects: DataFrame, postings: DataFrame, raw: DataFrame, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subjects, postings, counts) after index lines are put in, in the order of raw_id.

    subjects: id (a slug), label, aliases array<string>; postings: subject, book, page; raw: book, raw_id (unique), label, pages
    array<int> and, optionally, alias_of, the name that the line refers to. decisions: raw_id, decision ("match", "alias", "new"),
    canonical, one a raw_id at most, taken before, perhaps against an older index; without them `resolved` decides.

    A decision for a subject that is still there stands. All other lines are looked up again, by alias_of or their label, among all
    labels and aliases there are by then, those of earlier lines included; what nobody has becomes a subject under a free slug.
    Lines of one slug but another name become aliases of it. "alias" lines, and new ones with alias_of, leave their label as an
    alias. Pages add to those there are, so the same lines put in again change nothing. counts: book, n_new, n_match, n_alias.
    A null label reads as empty; null pages and lines without pages add none. Empty tables are taken as such.
    """
    index = _ordered(subjects)
    of = F.col("alias_of") if "alias_of" in raw.columns else F.lit(None).cast("string")
    text = F.coalesce("label", F.lit(""))
    lines = raw.select("book", F.col("raw_id").alias("at"), text.alias("label"), of.alias("alias_of"), "pages", normalize_label(F.coalesce(of, text)).alias("key"), normalize_label(text).alias("own"))
    if decisions is None:
        decisions = resolved(raw.select("raw_id", text.alias("label"), of.alias("alias_of")), index, order="place")
    there = index.select(F.col("id").alias("canonical"), "place")
    said = decisions.where("decision <> 'new'").select(F.col("raw_id").alias("at"), "decision", "canonical")
    lines = materialize(lines.join(said.join(there.hint("merge"), "canonical", "left").hint("merge"), "at", "left"))
    stands = F.col("place").isNotNull()
    kept = lines.where(stands).select("at", F.col("decision").alias("action"), F.col("canonical").alias("subject"), F.lit(None).cast(lines.schema["at"].dataType).alias("created"))
    again = lines.where(~stands).select("at", "key", "own", "decision", F.col("alias_of").isNotNull().alias("refers")).join(exact_subjects(subject_keys(index, "place")).hint("merge"), "key", "left")
    again = materialize(again)
    found = again.where("canonical is not null")
    known = kept.unionByName(found.select("at", F.coalesce("decision", F.lit("match")).alias("action"), F.col("canonical").alias("subject"), F.lit(None).cast(lines.schema["at"].dataType).alias("created")))
    fresh = again.where("canonical is null").withColumn("base", slugify(F.col("key"), default="subject"))
    fresh = materialize(fresh.join(free_slugs(fresh, subjects).hint("merge"), "base").select("at", "key", "own", "refers", "slug"))
    aliased = known.where("action = 'alias'").join(lines.select("at", "own").hint("merge"), "at").join(index.select(F.col("id").alias("subject"), F.col("place.k").alias("k")).hint("merge"), "subject")
    given = aliased.select(F.col("own").alias("key"), "at", _rank(False, F.col("k"), F.lit(None).cast(lines.schema["at"].dataType), F.col("subject")).alias("rank"))
    given = materialize(given)
    settled = _settled(fresh, given)
    final = materialize(known.unionByName(settled).join(lines.select("at", "book", "label", "alias_of", "pages").hint("merge"), "at"))
    made = final.where("action = 'new'").select(F.col("subject").alias("id"), F.coalesce("alias_of", "label").alias("label"), F.array().cast("array<string>").alias("aliases"))
    names = final.where("action = 'alias' or (action = 'new' and alias_of is not null)").where("trim(label) <> ''")
    names = names.groupBy(F.col("subject").alias("id")).agg(F.collect_set("label").alias("more"))
    every = subjects.select("id", "label", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).unionByName(made).join(names.hint("merge"), "id", "left")
    added = F.filter(F.coalesce("more", F.array().cast("array<string>")), lambda a: F.trim(a) != F.trim("label"))
    both = F.array_distinct(F.concat("aliases", added))
    sorted_ = F.transform(F.array_sort(F.transform(both, lambda a: F.struct(normalize_search(a).alias("k"), a.alias("a")))), lambda x: x["a"])
    pages = final.select("subject", "book", F.explode("pages").alias("page")).where("page is not null")
    counts = final.groupBy("book").agg(*(F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("new", "match", "alias")))
    return every.select("id", "label", sorted_.alias("aliases")), postings.select("subject", "book", "page").unionByName(pages).distinct(), counts
