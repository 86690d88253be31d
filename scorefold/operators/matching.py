"""Dictionary matching: codes against patterns, text against phrases, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorefold.functions.binding import let
from scorefold.functions.patterns import literal_prefixes
from scorefold.functions.scoring import match_category, position_of
from scorefold.functions.text import phrase_pattern, ranked_phrases, word_sequences, words


def first_disease_per_code(codes: DataFrame, diseases: DataFrame, group: str = "chief_complaint") -> DataFrame:
    """The first disease, in dictionary order, whose pattern matches the code's start.

    An index of literal beginnings: each pattern is filed under the texts its matches
    begin with, each distinct code meets the patterns filed under one of its own
    beginnings, and only these are tested. A pattern that begins with anything is filed
    under the empty text.
    """
    begins = F.udf(literal_prefixes, "array<string>", useArrow=False)
    dictionary = diseases.where("icd10_regex IS NOT NULL").select(
        group, "pos", "disease", F.concat(F.lit("^(?:"), "icd10_regex", F.lit(")")).alias("pattern"),
        F.explode(begins("icd10_regex")).alias("begin"),
    )
    # Lengths of beginnings: at most as many as a pattern has letters.
    lengths = sorted(r["n"] for r in dictionary.select(F.length("begin").alias("n")).distinct().collect())
    distinct = codes.select(group, "code").distinct()
    cut = F.array(*[F.when(F.length("code") >= n, F.substring("code", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    filed = distinct.select(group, "code", F.explode(F.array_compact(cut)).alias("begin"))
    return filed.join(dictionary, [group, "begin"]).where(F.rlike("code", "pattern")).groupBy(group, "code").agg(
        F.min_by("disease", "pos").alias("disease")
    )


def add_code_matches(df: DataFrame, diseases: DataFrame, keys: list[str], group: str = "chief_complaint",
                     codes: str = "ICD_CODES") -> DataFrame:
    """Matched diseases, their code positions and the first match of every row.

    Distinct codes are matched against the dictionary and joined back to the rows,
    whatever the size of either. ``keys`` and the group identify a row; a repeat
    stops the job. Without a match: ``[null]``, ``[-1]``, count 0, no disease and
    rank -1. A missing pattern matches nothing.
    """
    exploded = df.select(*keys, group, F.posexplode_outer(codes).alias("code_pos", "code"))
    found = exploded.join(first_disease_per_code(exploded.where("code IS NOT NULL"), diseases, group), [group, "code"], "left")
    hits = F.collect_list(F.when(F.col("disease").isNotNull(), F.struct("code_pos", "disease")))
    rows = F.count_if(F.coalesce(F.col("code_pos") == 0, F.lit(True)))
    per_row = found.groupBy(*keys, group).agg(F.sort_array(hits).alias("hits"), rows.alias("rows"))
    repeated = F.raise_error(F.concat(F.lit("rows are not identified by "), F.lit(", ".join([*keys, group]))))
    m = F.when(F.col("rows") > 1, repeated.cast("array<struct<code_pos:int,disease:string>>")).when(F.size("hits") > 0, F.col("hits"))
    matched = df.join(per_row.select(*keys, group, m.alias("m")), [*keys, group], "left")
    none = F.col("m").isNull()
    return matched.withColumns(
        {
            "diseases_by_icd_match": F.when(none, F.array(F.lit(None).cast("string"))).otherwise(F.col("m.disease")),
            "icd_codes_rank": F.when(none, F.array(F.lit(-1))).otherwise(F.col("m.code_pos")),
            "icd_codes_match_count": F.when(none, 0).otherwise(F.size("m")),
            "disease_by_icd_match": F.get(F.col("m.disease"), F.lit(0)),
            "disease_icd_rank": F.coalesce(F.get(F.col("m.code_pos"), F.lit(0)), F.lit(-1)),
        }
    ).drop("m")


def add_rank_columns(df: DataFrame, diseases: DataFrame, keys: list[str], group: str = "chief_complaint") -> DataFrame:
    """Code rank, similarity rank of the same disease, and the match category."""
    matched = add_code_matches(df, diseases, keys, group)
    ranked = matched.withColumn(
        "disease_cossim_rank", position_of(F.col("diseases"), F.col("disease_by_icd_match"))
    )
    return ranked.withColumn(
        "match_category", match_category(F.col("disease_icd_rank"), F.col("disease_cossim_rank"))
    )


def keep_known(df: DataFrame, codes: str, label_space: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct codes of a list column that are in ``label_space`` (code), in their order; a null list stays null.

    ``keys`` identify a row. The label space is joined, whatever its size.
    """
    exploded = df.select(*keys, F.posexplode(F.array_distinct(codes)).alias("_pos", "code"))
    known = exploded.join(label_space.select("code").distinct(), "code", "left_semi")
    lists = known.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_pos", "code")))["code"].alias("_known"))
    empty = F.when(F.col(codes).isNotNull(), F.array().cast("array<string>"))
    return df.join(lists, keys, "left").withColumn(codes, F.coalesce("_known", empty)).drop("_known")


def check_same_keys(synonyms: dict[str, list[str]], systems: dict[str, str]) -> None:
    """Both dictionaries must know the same complaints."""
    a, b = {k.lower() for k in synonyms}, {k.lower() for k in systems}
    if a != b:
        raise ValueError(
            f"complaints without system: {sorted(a - b)}; without synonyms: {sorted(b - a)}"
        )


def phrase_table(spark: SparkSession, synonyms: dict[str, list[str]], systems: dict[str, str]) -> DataFrame:
    """One row per phrase: its key and system, place (longest phrases first), pattern and the hash of its words.

    Every key is one of its own phrases.
    """
    lowered = {k.lower(): s for k, s in systems.items()}
    ranked = ranked_phrases(synonyms)
    rows = [(place, phrase, key, lowered.get(key), phrase_pattern(phrase)) for place, (phrase, key) in enumerate(ranked)]
    phrases = spark.createDataFrame(rows, "place int, phrase string, key string, system string, pattern string")
    found = words(F.col("phrase"))
    return phrases.select("place", "key", "system", "pattern", F.size(found).alias("n_words"), F.xxhash64(found).alias("gram"))


def add_complaints(df: DataFrame, synonyms: dict[str, list[str]], systems: dict[str, str],
                   text: str = "cc_string") -> DataFrame:
    """``cc_list`` and ``system_list`` of every row with at least one match.

    The phrases are indexed by the hash of their words. A text meets the phrases whose
    words it holds in a row, by an equi join on the hashes of its own word sequences of the
    lengths that occur, and only these patterns are tested on it. The plan is the same
    for any number of phrases. Equal texts are found together.
    """
    check_same_keys(synonyms, systems)
    missing = {text, "split"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    phrases = phrase_table(df.sparkSession, synonyms, systems)
    lengths = sorted(r["n_words"] for r in phrases.select("n_words").distinct().collect())  # at most the longest phrase
    body = F.coalesce(text, F.lit(""))
    marked = df.withColumn("_digest", F.sha2(body, 256))
    sequences = marked.select("_digest", F.explode(word_sequences(body, lengths)).alias("gram"))
    entry = F.struct("place", "key", "system", "pattern")
    possible = sequences.join(phrases, "gram").groupBy("_digest").agg(F.sort_array(F.collect_set(entry)).alias("_possible"))
    # A generator drops rows without a match and, unlike a filter, is never
    # evaluated a second time below the projection.
    hits = F.filter("_possible", lambda e: F.rlike(body, e["pattern"]))
    keys = let(hits, lambda h: F.array_distinct(F.transform(h, lambda e: F.struct(e["key"].alias("key"), e["system"].alias("system")))))
    matched = marked.join(possible, "_digest").select(
        *[f"`{c}`" for c in df.columns], F.explode(F.filter(F.array(keys), lambda k: F.size(k) > 0)).alias("_keys")
    )
    return matched.withColumns({"cc_list": F.col("_keys.key"), "system_list": F.col("_keys.system")}).drop("_keys")


def add_disease_vector(df: DataFrame, diseases: DataFrame, group: str = "chief_complaint") -> DataFrame:
    """Feature vector of the assigned disease of the row's group."""
    vectors = diseases.select(group, "disease", F.col("features").alias("disease_vector"))
    return df.join(vectors, [group, "disease"], "left")
