"""Topic compilation: triggers, variants, phrases, passages and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.operators.sizes import small


def expand_variants(triggers: DataFrame, variants: DataFrame) -> DataFrame:
    """(topic, lang, token) with every variant of each trigger; the trigger itself stays."""
    more = triggers.join(small(variants.select(F.col("canonical").alias("token"), "variant")), "token").select("topic", "lang", F.col("variant").alias("token"))
    return triggers.select("topic", "lang", "token").unionAll(more).distinct()


def matches(postings: DataFrame, triggers: DataFrame) -> DataFrame:
    """(topic, doc) where any language's tokens hold a trigger of that language; `postings` has (lang, doc, token).

    Triggers are compared whole with single tokens, so one of several words never matches here; see `phrase_in`.
    """
    return postings.join(small(triggers.select("topic", "lang", "token").distinct()), ["lang", "token"]).select("topic", "doc").distinct()


def without_negatives(found: DataFrame, negatives: DataFrame) -> DataFrame:
    return found.join(negatives.select("topic", "doc").distinct(), ["topic", "doc"], "left_anti")


def phrase_in(seq: Column, phrase: Column, max_gap: int = 2, backtrack: bool = False) -> Column:
    """Whether the phrase's tokens occur in order, each at most max_gap tokens after the one before.

    Greedy: each token takes its first place after the previous one, and a place too far off fails the whole
    match. With `backtrack` all places are tried.
    """
    if not backtrack:
        def step(at: Column, token: Column) -> Column:
            rest = F.slice(seq, at + 1, F.greatest(F.size(seq) - at, F.lit(0)))
            ahead = F.array_position(rest, token).cast("int")
            return F.when(at < 0, at).when(ahead == 0, F.lit(-1)).when((at > 0) & (ahead > max_gap + 1), F.lit(-1)).otherwise(at + ahead)

        return (F.size(phrase) > 0) & (F.aggregate(phrase, F.lit(0), step) > 0)

    def places(ends: Column, token: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(1), F.greatest(F.size(seq), F.lit(1))), lambda i: F.get(seq, i - 1) == token)
        return F.filter(hits, lambda i: F.exists(ends, lambda e: (e == 0) | ((i > e) & (i - e <= max_gap + 1))))

    return (F.size(phrase) > 0) & (F.size(F.aggregate(phrase, F.array(F.lit(0)), places)) > 0)


def capped(rows: DataFrame, cap: int, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The first `cap` rows of each group: a report's own limit."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("bigint")).where(F.col(name) <= cap)


def build_topics(found: DataFrame, anchors: DataFrame, negatives: DataFrame, cap: int = 160) -> DataFrame:
    """(topic, major, minor, is_anchor): anchors always, then matches that no negative hits, in key order, up to the cap.

    Anchors are never cut, so they alone may exceed the cap.
    """
    fixed = anchors.select("topic", "major", "minor").distinct().withColumn("is_anchor", F.lit(True))
    rest = found.join(negatives, ["topic", "major", "minor"], "left_anti").join(fixed.select("topic", "major", "minor"), ["topic", "major", "minor"], "left_anti")
    both = fixed.unionByName(rest.select("topic", "major", "minor").distinct().withColumn("is_anchor", F.lit(False)))
    w = W.partitionBy("topic").orderBy(F.desc("is_anchor"), "major", "minor")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("is_anchor") | (F.col("place") <= cap)).drop("place")


def islands(keys: DataFrame, group: list[str], major: str, minor: str) -> DataFrame:
    """(group, major, first, last, n): runs of consecutive minor numbers."""
    at = F.row_number().over(W.partitionBy(*group, major).orderBy(minor))
    runs = keys.select(*group, major, minor).distinct().withColumn("island", F.col(minor) - at)
    return runs.groupBy(*group, major, "island").agg(F.min(minor).alias("first"), F.max(minor).alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


def passages_mentions(blocks: DataFrame, group: list[str], major: str, most: int = 6) -> DataFrame:
    """Blocks ranked by length, then first key; the top ones are passages, the rest mentions."""
    if not group:
        raise ValueError("blocks are ranked within groups; without one all would go to one task")
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("n"), major, "first"))
    return blocks.withColumn("rank", rank).withColumn("kind", F.when(F.col("rank") <= most, "passage").otherwise("mention"))


def mine_variants(seeds: DataFrame, surfaces: DataFrame, cap: int = 12, rules: bool = False) -> DataFrame:
    """(canonical, variant, ord): seed variants and surface forms with the canonical's normalized form, and with `rules` those of `rule_variants`.

    `seeds` has (canonical, variant), `surfaces` (norm, surface). The canonical itself and empty forms go.
    """
    names = seeds.select("canonical").distinct()
    mined = surfaces.join(small(names.withColumn("norm", F.lower("canonical"))), "norm").select("canonical", F.col("surface").alias("variant"))
    mined = mined.union(rule_variants(names)) if rules else mined
    both = seeds.select("canonical", "variant").union(mined).where("variant <> canonical and trim(variant) <> ''").distinct()
    return capped(both, cap, ["canonical"], [F.lower("variant"), F.col("variant")], "ord")


def corpus_variants(seeds: DataFrame, surfaces: DataFrame, cap: int = 16) -> DataFrame:
    """(canonical, variant, ord): seed variants that the corpus has, and its surface forms; of spellings that differ by case alone the first."""
    own = seeds.withColumn("norm", F.lower("variant")).join(surfaces.select("norm").distinct(), "norm", "left_semi").select("canonical", "variant")
    names = seeds.select("canonical").distinct()
    mined = surfaces.join(small(names.withColumn("norm", F.lower("canonical"))), "norm").select("canonical", F.col("surface").alias("variant"))
    both = own.union(mined).where("variant <> canonical").groupBy("canonical", F.lower("variant").alias("low")).agg(F.min("variant").alias("variant"))
    return capped(both, cap, ["canonical"], [F.col("low")], "ord").select("canonical", "variant", "ord")


def prune_triggers(triggers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Triggers that occur in their language's vocabulary; topics without one vanish."""
    asked = small(triggers.select("lang", "token").distinct())
    met = vocabulary.select("lang", "token").join(asked, ["lang", "token"], "left_semi").distinct()  # no more rows than triggers
    return triggers.join(met, ["lang", "token"], "left_semi")


def merge_triggers(base: DataFrame, localized: DataFrame, strict: bool = True) -> DataFrame:
    """Localized (topic, lang, token) rows added to the base; unknown topics raise, or are left out."""
    known = base.select("topic").distinct()
    if strict and localized.join(known, "topic", "left_anti").limit(1).count():
        raise ValueError("localized triggers name an unknown topic")
    return base.unionByName(localized.join(known, "topic", "left_semi")).distinct()


def templates(topics: DataFrame, groups: DataFrame) -> DataFrame:
    """(topic, sections): ordered structs (group, keys) of topics that have groups."""
    keys = F.sort_array(F.collect_set(F.struct("major", "minor")))
    by_group = groups.groupBy("topic", "group").agg(keys.alias("keys"))
    return by_group.join(topics.select("topic").distinct(), "topic", "left_semi").groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("group", "keys"))).alias("sections"))


def compile_topics(postings: DataFrame, triggers: DataFrame, negatives: DataFrame, kinds: DataFrame, phrases: DataFrame | None = None, narrow: tuple[str, ...] = ("ar", "tr")) -> DataFrame:
    """(topic, doc) of topics, entities and stories: entities and stories match only in the narrow languages.

    Positive triggers come variant-expanded, negative ones as they are; `phrases` adds (topic, lang, doc) matches.
    """
    wide = triggers.join(small(kinds), "topic").where((F.col("kind") == "topic") | F.col("lang").isin(*narrow))
    found = matches(postings, wide)
    if phrases is not None:
        more = phrases.join(small(kinds), "topic").where((F.col("kind") == "topic") | F.col("lang").isin(*narrow))
        found = found.union(more.select("topic", "doc")).distinct()
    return without_negatives(found, matches(postings, negatives))


def build_ontology(triggers: DataFrame, entities: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(topic, kind, lang, token): topics with their triggers, and an entity and a story of each of `entities` (entity, lang, token).

    Triggers that the corpus lacks in their language go, and topics without any vanish.
    """
    named = lambda kind: entities.select(F.concat(F.lit(f"{kind}_"), "entity").alias("topic"), F.lit(kind).alias("kind"), "lang", "token")
    every = triggers.select("topic", F.lit("topic").alias("kind"), "lang", "token").unionByName(named("entity")).unionByName(named("story"))
    return prune_triggers(every.distinct(), vocabulary).select("topic", "kind", "lang", "token")


def build_groups(found: DataFrame, anchors: DataFrame, cap: int = 40) -> DataFrame:
    """(topic, group, major, minor, is_anchor): a group's anchors always, then what its triggers match, in key order, up to the cap."""
    name = F.to_json(F.struct("topic", "group"))
    none = found.limit(0).select(F.lit("").alias("topic"), "major", "minor")
    got = build_topics(found.withColumn("topic", name), anchors.withColumn("topic", name), none, cap)
    key = F.from_json("topic", "topic string, group string")
    return got.select(key["topic"].alias("topic"), key["group"].alias("group"), "major", "minor", "is_anchor")


def fill_groups(groups: DataFrame, anchors: DataFrame, cap: int = 3) -> DataFrame:
    """(topic, group, major, minor): each group's own keys up to the cap; an empty group borrows its topic's anchors."""
    own = capped(groups.where("major is not null"), cap, ["topic", "group"], [F.col("major"), F.col("minor")]).select("topic", "group", "major", "minor")
    empty = groups.select("topic", "group").distinct().join(own, ["topic", "group"], "left_anti")
    lent = capped(empty.join(anchors, "topic"), cap, ["topic", "group"], [F.col("major"), F.col("minor")])
    return own.unionByName(lent.select("topic", "group", "major", "minor"))


#: Most first tokens of phrases that are sought in a sequence before it is copied for each.
MOST_FIRSTS = 10_000


def phrase_hits(phrases: DataFrame, sequences: DataFrame, on: list[str] | None = None, max_gap: int = 2) -> DataFrame:
    """Rows of `sequences` (seq, ...) joined with the phrases (phrase, ...) that they hold.

    They meet on each phrase's first token, among the distinct tokens of a sequence, so no sequence is tried for a phrase
    that it cannot hold; and a sequence is copied only for first tokens of some phrase.
    """
    on = on or []
    firsts = phrases.where(F.size("phrase") > 0).withColumn("_first", F.col("phrase")[0])
    names = [r[0] for r in firsts.where("_first is not null").select("_first").distinct().limit(MOST_FIRSTS + 1).collect()]
    known = F.lit(names).cast(sequences.schema["seq"].dataType)
    held = F.array_intersect("seq", known) if len(names) <= MOST_FIRSTS else F.array_distinct("seq")
    tokens = sequences.withColumn("_first", F.explode(held))
    return tokens.join(small(firsts), [*on, "_first"]).where(phrase_in(F.col("seq"), F.col("phrase"), max_gap)).drop("_first")


def prune_phrases(phrases: DataFrame, sequences: DataFrame) -> DataFrame:
    """Phrases (topic, lang, phrase) that some passage (lang, seq) of their language holds."""
    return phrase_hits(phrases, sequences, ["lang"]).select("topic", "lang", "phrase").distinct()


def rule_variants(names: DataFrame) -> DataFrame:
    """(canonical, variant) by spelling rules: doubled vowels, th/z/s, q/k and dh/z changes, hyphens and apostrophes."""
    c = F.col("canonical")
    rules = [F.replace(c, F.lit(a), F.lit(b)) for a, b in (("aa", "a"), ("ee", "i"), ("oo", "u"), ("q", "k"), ("dh", "z"), ("-", " "), ("'", ""))]
    return names.select("canonical", F.explode(F.array(*rules)).alias("variant")).where("variant <> canonical").distinct()
