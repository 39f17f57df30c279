"""Entity resolution of raw labels against known subjects, as a cascade of set-wise stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import normalize_label, slugify
from quire.operators.labels import similar_labels
from quire.operators.similarity import token_sorted


def subject_keys(subjects: DataFrame, order: str = "id") -> DataFrame:
    """(id, key, place, is_alias): normalised labels and aliases of subjects (id, label, and alias or aliases array), but for blank ones."""
    aliases = F.col("aliases") if "aliases" in subjects.columns else F.array("alias")
    none = F.array().cast("array<string>")
    said = F.concat(F.array(F.struct(F.col("label").alias("text"), F.lit(False).alias("is_alias"))), F.transform(F.coalesce(aliases, none), lambda a: F.struct(a.alias("text"), F.lit(True).alias("is_alias"))))
    rows = subjects.select("id", F.col(order).alias("place"), F.explode(said).alias("x"))
    return rows.where("trim(x.text) <> ''").select("id", normalize_label(F.col("x.text")).alias("key"), "place", "x.is_alias")


def exact_subjects(keys: DataFrame) -> DataFrame:
    """(key, canonical, is_alias): of each key of `subject_keys` the first subject in order that has it as label or alias, and whether only as an alias."""
    return keys.groupBy("key").agg(F.min(F.struct("place", "id", "is_alias")).alias("x")).select("key", F.col("x.id").alias("canonical"), "x.is_alias")


def resolved(raw: DataFrame, subjects: DataFrame, accept: float = 0.9, order: str = "id") -> DataFrame:
    """(raw_id, decision, method, canonical), a row per row of raw.

    raw: raw_id, label and, if there is such a column, alias_of; subjects: id, label, alias or aliases. The first subject in `order`
    that has the label as its own or as an alias is taken: "match" in the first case, "alias" in the second. Else the subject whose
    label or alias is most similar by sorted words, from `accept` on, is a "match" too (ties: lowest id). Else the label is "new",
    with a null canonical. A row with alias_of is an "alias" of the subject that has that name exactly, or "new". method: label,
    alias, fuzzy or new. All decisions are taken against the same snapshot, so each stage is one join over what the stages before
    have left. Null labels are new; null labels and aliases of subjects match nothing; repeated raw rows are decided alike.
    Both tables may be long, so they meet by sorted merges: no side is broadcast, however small its packed file.
    """
    of = F.col("alias_of") if "alias_of" in raw.columns else F.lit(None).cast("string")
    keyed = raw.select("raw_id", normalize_label(F.coalesce(of, "label")).alias("key"), of.isNotNull().alias("refers"))
    keys = subject_keys(subjects, order)
    exact = keyed.join(exact_subjects(keys).hint("merge"), "key", "left")
    found = F.col("canonical").isNotNull()
    as_alias = F.col("refers") | F.col("is_alias")
    done = exact.where(found | F.col("refers")).select("raw_id", F.when(~found, "new").when(as_alias, "alias").otherwise("match").alias("decision"), F.when(~found, "new").when(as_alias, "alias").otherwise("label").alias("method"), "canonical")
    rest = exact.where(~(found | F.col("refers"))).select("raw_id", token_sorted(F.col("key")).alias("key"))
    known = keys.groupBy(token_sorted(F.col("key")).alias("right")).agg(F.min("id").alias("id"))
    scored = similar_labels(rest.select(F.col("key").alias("label")), known.select(F.col("right").alias("label")), accept).join(known.hint("merge"), "right")
    best = scored.groupBy(F.col("left").alias("key")).agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("x")).select("key", F.col("x.id").alias("canonical"))
    fuzzy = rest.join(best.hint("merge"), "key", "left")
    return done.unionByName(fuzzy.select("raw_id", F.when(found, "match").otherwise("new").alias("decision"), F.when(found, "fuzzy").otherwise("new").alias("method"), "canonical"))


def allocated_slugs(labels: DataFrame, taken: DataFrame) -> DataFrame:
    """(label, slug): unique slugs for new labels; of labels that share one, and where it is taken, later ones get -2, -3, ...

    A number is passed over if the slug with it is taken or is what another new label asks for. taken: label, of known subjects.
    """
    base = labels.select("label", slugify(F.col("label"), default="subject").alias("base")).distinct()
    used = taken.select(slugify(F.col("label"), default="subject").alias("base")).distinct().withColumn("used", F.lit(1))
    n = F.row_number().over(Window.partitionBy("base").orderBy("label"))
    shape = "^(.+)-([1-9][0-9]{0,8})$"
    numbered = used.select("base").union(base.select("base")).where(F.col("base").rlike(shape))
    numbered = numbered.select(F.regexp_extract("base", shape, 1).alias("base"), F.regexp_extract("base", shape, 2).try_cast("int").alias("k")).where("k > 1")
    blocked = numbered.groupBy("base").agg(F.array_sort(F.collect_set("k")).alias("blocked"))
    rows = base.withColumn("n", n).join(used, "base", "left").join(blocked, "base", "left")
    place = F.col("n") + F.coalesce("used", F.lit(0))
    free = F.aggregate(F.coalesce("blocked", F.array().cast("array<int>")), place, lambda k, b: F.when(b <= k, k + 1).otherwise(k))
    return rows.select("label", F.when(place == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), free.cast("string"))).alias("slug"))


def suggestion_clusters(pairs: DataFrame, dismissed: DataFrame, names: DataFrame) -> DataFrame:
    """(component, members, score, target): clusters of scored pairs (a, b, score) without any dismissed pair among their members.

    The suggested target is the member with the most books, then the shortest label, then the lowest id (names: id, label, n_books).
    """
    from quire.operators.graph import connected_components

    open_ = pairs.join(dismissed, ["a", "b"], "left_anti")
    part = connected_components(open_, "a", "b")
    side = lambda c: part.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    hidden = dismissed.join(side("a"), "a").join(side("b"), "b").where("ca = cb").select(F.col("ca").alias("component")).distinct()
    score = open_.join(side("a"), "a").groupBy(F.col("ca").alias("component")).agg(F.round(F.max("score"), 4).alias("score"))
    best = part.join(names, "id").groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.min_by("id", F.struct((-F.col("n_books")).alias("x"), F.length("label").alias("y"), "id")).alias("target"))
    return best.join(score, "component").join(hidden, "component", "left_anti").select("component", "members", "score", "target")
