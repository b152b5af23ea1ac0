"""Entity search: trigram word similarity with a phonetic fallback."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# The sound class of each letter A-Z (0: none), and request defaults.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SOUNDS = "01230120022455012623010202"
STRICTNESS, MAX_ENTRIES = 0.8, 10


def person_words(name: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_sound(word: Column) -> Column:
    """Soundex that compares a letter only with the one before: h and w end a run."""
    letters = F.upper(F.regexp_replace(word, "^[^A-Za-z]+", ""))
    # Letters beyond A-Z have no sound and end a run, as vowels do.
    sounds = F.regexp_replace(F.regexp_replace(F.translate(letters, _LETTERS, _SOUNDS), "[^0-6]", "0"), r"([0-6])\1+", "$1")
    rest = F.regexp_replace(F.substring(sounds, 2, 1000), "0", "")
    return F.when(letters == "", "").otherwise(F.concat(F.substring(letters, 1, 1), F.rpad(F.substring(rest, 1, 3), 3, "0")))


def sounds_of(name: Column) -> Column:
    return F.transform(person_words(name), word_sound)


def _trigrams(text: str) -> list[str]:
    """Trigrams of each word with two spaces before and one behind, in order."""
    parts = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return [p[i : i + 3] for p in (f"  {w} " for w in parts) for i in range(len(p) - 2)]


def word_similarity_of(query: str, text: str) -> float:
    """The best share that a run of the text's trigrams has in common with the query's."""
    own = set(_trigrams(query))
    line = _trigrams(text)
    hits = [i for i, t in enumerate(line) if t in own]
    best = 0.0
    for a in hits:
        seen: set[str] = set()
        common = 0
        at = a
        for b in hits:
            if b < a:
                continue
            for t in line[at : b + 1]:
                common += t in own and t not in seen
                seen.add(t)
            at = b + 1
            best = max(best, common / (len(own) + len(seen) - common))
    return float(np.float32(best))


def word_similarity(query: str, name: Column) -> Column:
    """float32 similarity; distinct names of a batch are computed once."""

    @F.pandas_udf("float")
    def similarity(names: pd.Series) -> pd.Series:
        known = {n: word_similarity_of(query, n) for n in names.dropna().unique()}
        return names.map(known).astype("float32")

    return similarity(name)


def may_match(query: str, name: Column, strictness: float) -> Column:
    """A bound on ``word_similarity`` without Python: enough of the query's trigrams are in the name.

    Similarity is at most the common trigrams over the query's, so a name that
    has fewer can't reach ``strictness``.
    """
    own = sorted(set(_trigrams(query)))
    need = math.ceil(float(np.float32(strictness)) * len(own) - 1e-6)
    if need <= 0:
        return F.lit(True)
    padded = F.concat(F.lit("  "), F.regexp_replace(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " ")), " ", "   "), F.lit(" "))
    found = [padded.contains(t).cast("int") for t in own]
    return sum(found[1:], found[0]) >= need


def check_request(term: str, max_entries: int = MAX_ENTRIES, strictness: float = STRICTNESS) -> str:
    """The trimmed term; errors for requests that the search does not serve."""
    text = term.strip()
    if len(text.encode()) < 3:
        raise ValueError("a term has three bytes at least")
    if max_entries < 1:
        raise ValueError("max_entries must be 1 at least")
    if not (math.isfinite(strictness) and 0 <= strictness <= 1):
        raise ValueError("strictness must be within 0 and 1")
    return text


def _at_least(similarity: Column, strictness: float) -> Column:
    return similarity >= F.lit(float(np.float32(strictness))).cast("float")


def similar(names: DataFrame, term: str, strictness: float, name: str = "name") -> DataFrame:
    """``names`` that are similar enough, with their float32 similarity; the bound is inclusive."""
    near = names.filter(F.col(name).isNotNull() & may_match(term, F.col(name), strictness))
    return near.withColumn("similarity", word_similarity(term, F.col(name))).filter(_at_least(F.col("similarity"), strictness))


def text_matches(names: DataFrame, term: str, strictness: float, limit: int) -> DataFrame:
    """Best name per group: rows (group_id, id, name, is_canonical, label).

    ``names`` has one row per spelling.  Similarity compares in float32,
    inclusive.  A group's best spelling: most similar, smallest id, canonical
    before aliases, then by code point.  The limit counts groups.
    """
    scored = similar(names, term, strictness)
    order = F.struct((-F.col("similarity")).alias("s"), "id", (~F.col("is_canonical")).alias("c"), "name")
    best = scored.groupBy("group_id").agg(F.min_by(F.struct(*names.columns, "similarity"), order).alias("best")).select("best.*")
    return best.orderBy(F.desc("similarity"), "group_id").limit(limit)


def member_text_matches(members: DataFrame, term: str, strictness: float = STRICTNESS, limit: int = MAX_ENTRIES) -> DataFrame:
    """(id, name, similarity) of members or Lords, most similar first."""
    return similar(members, term, strictness).orderBy(F.desc("similarity"), "id").limit(limit)


def _labelled(rows: DataFrame, funders: DataFrame, groups: DataFrame, group_names: DataFrame) -> DataFrame:
    """``rows`` (id, ...) with group_id, and the group's label and kind."""
    owner = groups.select(F.col("funder_id").alias("id"), "group_id")
    out = rows.join(owner, "id", "left").withColumn("group_id", F.coalesce("group_id", "id"))
    representative = funders.select(F.col("id").alias("group_id"), F.col("name").alias("_name"), F.col("kind").alias("group_kind"))
    preferred = group_names.select("group_id", "preferred_name")
    out = out.join(representative, "group_id").join(preferred, "group_id", "left")
    return out.withColumn("label", F.coalesce("preferred_name", "_name")).drop("_name", "preferred_name")


def qualified_funders(funders: DataFrame, aliases: DataFrame, group_names: DataFrame, term: str, strictness: float = STRICTNESS) -> DataFrame:
    """(id, name, kind, matched_alias, similarity) of funders by name or alias, and of groups by preferred name.

    The best alias (most similar, then smallest) counts only where it beats the name.
    """
    own = similar(funders.select("id", "name", "kind"), term, 0.0 if strictness <= 0 else strictness)
    known = aliases.select(F.col("funder_id").alias("id"), F.col("alias"))
    best = similar(known, term, strictness, "alias").groupBy("id").agg(
        F.max("similarity").alias("alias_score"), F.min_by("alias", F.struct((-F.col("similarity")).alias("s"), "alias")).alias("alias")
    )
    near = own.select("id", "similarity").join(best, "id", "full").join(funders.select("id", "name", "kind"), "id")
    by_alias = F.coalesce(F.col("alias_score") > F.col("similarity"), F.col("alias_score").isNotNull())
    found = near.select("id", "name", "kind", F.when(by_alias, F.col("alias")).alias("matched_alias"), F.greatest("similarity", "alias_score").alias("similarity"))
    preferred = similar(group_names.select(F.col("group_id").alias("id"), F.col("preferred_name").alias("name")), term, strictness)
    preferred = preferred.join(funders.select("id", "kind"), "id").select("id", "name", "kind", F.lit(None).cast("string").alias("matched_alias"), "similarity")
    return found.unionByName(preferred)


def funder_text_matches(
    funders: DataFrame, aliases: DataFrame, groups: DataFrame, group_names: DataFrame, term: str, strictness: float = STRICTNESS, limit: int = MAX_ENTRIES
) -> DataFrame:
    """(id, name, kind, matched_alias, similarity) per group, most similar first; the limit counts groups."""
    rows = _labelled(qualified_funders(funders, aliases, group_names, term, strictness), funders, groups, group_names)
    other = (F.col("id") != F.col("group_id")) | (F.col("name") != F.col("label"))
    rows = rows.withColumn("shown", F.coalesce("matched_alias", F.when(other, F.col("name"))))
    order = F.struct((-F.col("similarity")).alias("s"), "id", (F.col("name") != F.col("label")).alias("n"), F.col("matched_alias").isNotNull().alias("a"), "name")
    best = rows.groupBy(F.col("group_id").alias("id")).agg(
        F.min_by(F.struct(F.col("label").alias("name"), F.col("group_kind").alias("kind"), F.col("shown").alias("matched_alias"), "similarity"), order).alias("b")
    )
    return best.select("id", "b.*").orderBy(F.desc("similarity"), "id").limit(limit)


def has_individual(qualified: DataFrame) -> DataFrame:
    """One row: whether any qualified funder is an individual (false for none)."""
    return qualified.agg(F.coalesce(F.max(F.col("kind") == "Individual"), F.lit(False)).alias("has_individual"))


def phonetic_scores(names: DataFrame, term: str, strictness: float = 0.0) -> DataFrame:
    """``names`` in which every word of the term has one of like sound, one edit away at most.

    Adds ``corrected`` (the words chosen, in the term's order), ``distance`` and
    ``similarity`` of name and corrected words, which reaches ``strictness``.
    The term's words are a small list; the words of names meet them by an equi
    join on their sound.
    """
    spark = names.sparkSession
    asked = spark.range(1).select(F.posexplode(person_words(F.lit(term))).alias("place", "asked")).withColumn("sound", word_sound(F.col("asked")))
    wanted = [r["asked"] for r in asked.orderBy("place").collect()]  # the words of one request
    key = names.columns
    if not wanted or any(len(w) > 255 for w in wanted):
        extra = names.withColumn("corrected", F.lit("")).withColumn("distance", F.lit(0)).withColumn("similarity", F.lit(0.0).cast("float"))
        return extra.limit(0)
    spelled = names.withColumn("_w", F.explode(F.array_distinct(person_words(F.col("name")))))
    spelled = spelled.filter(F.length("_w") <= 255).withColumn("_s", word_sound(F.col("_w")))
    pairs = spelled.join(F.broadcast(asked), F.col("_s") == F.col("sound")).withColumn("_d", F.levenshtein("_w", "asked", 1)).filter("_d >= 0")
    chosen = pairs.groupBy(*key, "place").agg(F.min(F.struct("_d", "_w")).alias("m"))
    whole = chosen.groupBy(*key).agg(
        F.count("*").alias("found"), F.sum("m._d").cast("int").alias("distance"), F.array_sort(F.collect_list(F.struct("place", F.col("m._w").alias("w")))).alias("ws")
    ).filter(F.col("found") == len(wanted))
    whole = whole.withColumn("corrected", F.array_join(F.transform("ws", lambda x: x["w"]), " "))

    @F.pandas_udf("float")
    def similarity(corrected: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([word_similarity_of(a, b) for a, b in zip(corrected, name, strict=True)], dtype="float32")

    return whole.withColumn("similarity", similarity("corrected", "name")).drop("found", "ws").filter(_at_least(F.col("similarity"), strictness))


def phonetic_matches(names: DataFrame, term: str, strictness: float = 0.0, limit: int | None = None) -> DataFrame:
    """The best spelling per group of ``phonetic_scores``: by distance, similarity, id, canonical first and spelling.

    In that order by groups; the limit counts groups.
    """
    scored = phonetic_scores(names, term, strictness)
    order = F.struct("distance", (-F.col("similarity")).alias("s"), "id", (~F.col("is_canonical")).alias("c"), "name")
    best = scored.groupBy("group_id").agg(F.min_by(F.struct(*scored.columns), order).alias("best")).select("best.*")
    if limit is None:
        return best
    return best.orderBy("distance", F.desc("similarity"), "group_id").limit(limit)


def member_phonetic_matches(members: DataFrame, term: str, strictness: float = STRICTNESS, limit: int = MAX_ENTRIES) -> DataFrame:
    scored = phonetic_scores(members.select("id", "name"), term, strictness)
    return scored.orderBy("distance", F.desc("similarity"), "id").limit(limit)


def funder_phonetic_matches(
    funders: DataFrame, aliases: DataFrame, groups: DataFrame, group_names: DataFrame, term: str, strictness: float = STRICTNESS, limit: int = MAX_ENTRIES
) -> DataFrame:
    """(id, name, kind, matched_alias, distance, similarity) per group of individuals' names and aliases."""
    people = funders.filter("kind = 'Individual'").select("id", "name")
    also = aliases.select(F.col("funder_id").alias("id"), F.col("alias").alias("name")).join(people.select("id"), "id", "left_semi")
    names = people.withColumn("is_canonical", F.lit(True)).unionByName(also.withColumn("is_canonical", F.lit(False)))
    owner = groups.select(F.col("funder_id").alias("id"), "group_id")
    names = names.join(owner, "id", "left").withColumn("group_id", F.coalesce("group_id", "id"))
    best = phonetic_matches(names, term, strictness, limit).select(
        F.col("group_id").alias("id"), "name", "distance", "similarity", (~F.col("is_canonical") | (F.col("id") != F.col("group_id"))).alias("alias")
    )
    labels = funders.select("id", F.col("name").alias("_name"), "kind").join(group_names.select(F.col("group_id").alias("id"), "preferred_name"), "id", "left")
    out = best.join(labels, "id").withColumn("label", F.coalesce("preferred_name", "_name"))
    shown = F.when(F.col("alias") | (F.col("name") != F.col("label")), F.col("name"))
    out = out.select("id", F.col("label").alias("name"), "kind", shown.alias("matched_alias"), "distance", "similarity")
    return out.orderBy("distance", F.desc("similarity"), "id")


def merge_ranked(members: DataFrame, funders: DataFrame, lords: DataFrame | None = None) -> DataFrame:
    """Lists of (id, label, similarity) as one: by similarity; on ties members and
    funders take turns, and lords come last."""
    parts = []
    for kind, rows in ((0, members), (1, funders), (2, lords)):
        if rows is not None:
            turn = Window.partitionBy("similarity").orderBy("id")
            parts.append(rows.select("id", "label", "similarity").withColumn("kind", F.lit(kind)).withColumn("turn", F.row_number().over(turn)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # Three lists of some entries each: one task is enough.
    order = Window.orderBy(F.desc("similarity"), F.col("kind") == 2, "turn", "kind", "id")
    return out.withColumn("position", F.row_number().over(order).cast("long")).drop("turn")


def search_entities(
    members: DataFrame, lords: DataFrame, funders: DataFrame, aliases: DataFrame, groups: DataFrame, group_names: DataFrame,
    term: str, max_entries: int = MAX_ENTRIES, strictness: float = STRICTNESS,
) -> DataFrame:
    """(position, kind, id, label, matched_alias) of a whole search; kinds 0 member, 1 funder, 2 Lord.

    The merged text matches come first.  Names of like sound follow only where no
    member and no individual funder qualifies by text, even beyond the limit; of
    funders those not found yet, up to ``max_entries`` with the ones found.
    """
    text = check_request(term, max_entries, strictness)
    mps = member_text_matches(members, text, strictness, max_entries)
    found = funder_text_matches(funders, aliases, groups, group_names, text, strictness, max_entries)
    peers = member_text_matches(lords, text, strictness, max_entries)
    matched = found.select("id", "matched_alias")
    merged = merge_ranked(*(rows.select("id", F.col("name").alias("label"), "similarity") for rows in (mps, found, peers)))
    merged = merged.join(matched.withColumn("kind", F.lit(1)), ["kind", "id"], "left").select("position", "kind", "id", "label", "matched_alias")
    qualified = qualified_funders(funders, aliases, group_names, text, strictness)
    if not mps.isEmpty() or has_individual(qualified).first()[0]:
        return merged
    left = max(0, max_entries - found.count())
    more = funder_phonetic_matches(funders, aliases, groups, group_names, text, strictness, max_entries).join(matched.select("id"), "id", "left_anti")
    more = more.orderBy("distance", F.desc("similarity"), "id").limit(left).withColumn("kind", F.lit(1))
    sound = member_phonetic_matches(members, text, strictness, max_entries)
    sound = sound.select("id", "name", F.lit(None).cast("string").alias("matched_alias"), "distance", "similarity", F.lit(0).alias("kind"))
    both = sound.unionByName(more.drop("kind").withColumn("kind", F.lit(1)).select(sound.columns))
    order = Window.orderBy("distance", F.desc("similarity"), "kind", "id")
    after = merged.count()
    both = both.select((F.row_number().over(order) + after).cast("long").alias("position"), "kind", "id", F.col("name").alias("label"), "matched_alias")
    return merged.unionByName(both)


def at_limit(results: DataFrame, limit: int = MAX_ENTRIES) -> DataFrame:
    """One row: whether any kind fills its list."""
    return results.groupBy("kind").agg(F.count("*").alias("n")).agg(F.coalesce(F.max(F.col("n") >= limit), F.lit(False)).alias("at_limit"))
