"""English stems of terms by the published Porter2 rules, as expressions over a table of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the published rules: vowels, pairs of letters, words with stems of their own, words that end after the
#: plural step, beginnings after which the first region starts, and the suffixes of three steps with what takes their place.
VOWELS, DOUBLES, SHORT = "aeiouy", "bb|dd|ff|gg|mm|nn|pp|rr|tt", "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = "inning outing canning herring earring proceed exceed succeed".split()
REGION, FIRST_REGION = "[^aeiouy]*[aeiouy]+[^aeiouy]", "gener|commun|arsen"
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less",
    "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
#: Letters of which one must stand before a suffix, and suffixes that must lie in the second region.
BEFORE, IN_SECOND = {"li": "cdeghkmnrt", "ogi": "l", "ion": "st"}, ["ative"]


def _without(n: int | Column) -> Column:
    return F.col("w").substr(F.lit(1), F.length("w") - n)


def _suffixes(rows: DataFrame, pattern: str) -> DataFrame:
    """The longest suffix of ``w`` as ``s``, empty where there is none, and what stands before it as ``head``."""
    return rows.withColumn("s", F.regexp_extract("w", f"({pattern})$", 1)).withColumn("head", _without(F.length("s")))


def _step(rows: DataFrame, rules: dict[str, str], region: str) -> DataFrame:
    """``w`` with its longest suffix replaced, where it lies in the region that begins at column ``region``."""
    fits = (F.col("s") != "") & (F.length("head") >= F.when(F.col("s").isin(IN_SECOND), F.col("p2")).otherwise(F.col(region)))
    for suffix in sorted(BEFORE.keys() & rules.keys()):
        fits &= (F.col("s") != suffix) | F.col("head").rlike(f"[{BEFORE[suffix]}]$")
    to = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    return _suffixes(rows, "|".join(rules)).withColumn("w", F.when(fits, F.concat("head", F.element_at(to, F.col("s")))).otherwise(F.col("w")))


def english_stems(terms: DataFrame, column: str = "term") -> DataFrame:
    """(column, stem) of every row of ``terms``; terms are in lower case, and those of one or two characters stay.

    A null term has a null stem. Letters other than a to z, digits and marks count as consonants. The rules refer to each other's
    results; a generator before the first and one after the last keep the optimizer from writing the rules out again in every
    filter on a stem or, for a literal, in every rule.
    """
    w = F.col("w")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(column, "^'", ""), "^y", "Y"), f"([{VOWELS}])y", "$1Y")
    rows = terms.select(column, F.explode(F.array(marked)).alias("w"))
    first = F.length(F.regexp_extract("w", f"^({FIRST_REGION}|{REGION})", 0))
    rows = rows.withColumn("p1", F.when(first > 0, first).otherwise(F.length("w")))
    second = F.length(F.regexp_extract(w.substr(F.col("p1") + 1, F.length("w")), f"^{REGION}", 0))
    rows = rows.withColumn("p2", F.when(second > 0, F.col("p1") + second).otherwise(F.length("w")))
    rows = _suffixes(rows.withColumn("w", F.regexp_replace("w", "('s'|'s|')$", "")), "sses|ied|ies|us|ss|s")
    s = F.col("s")
    plural = F.when(s == "sses", _without(2)).when(s.isin("ied", "ies"), F.when(F.length("w") > 4, _without(2)).otherwise(_without(1)))
    rows = rows.withColumn("w", plural.when((s == "s") & _without(2).rlike(f"[{VOWELS}]"), _without(1)).otherwise(w))
    rows = _suffixes(rows.withColumn("kept", F.when(w.isin(AFTER_PLURAL), w)), "eedly|ingly|edly|eed|ing|ed")
    with_eed = F.when(F.length("head") >= F.col("p1"), F.concat("head", F.lit("ee"))).otherwise(w)
    cut = (s != "") & ~s.isin("eed", "eedly") & F.col("head").rlike(f"[{VOWELS}]")
    short = (F.col("p1") >= F.length("w")) & w.rlike(SHORT)
    mended = F.when(w.rlike("(at|bl|iz)$") | short & ~w.rlike(f"({DOUBLES})$"), F.concat("w", F.lit("e"))).when(w.rlike(f"({DOUBLES})$"), _without(1)).otherwise(w)
    rows = rows.withColumn("cut", cut).withColumn("w", F.when(cut, F.col("head")).when(s.isin("eed", "eedly"), with_eed).otherwise(w))
    rows = rows.withColumn("w", F.when(F.col("cut"), mended).otherwise(w)).withColumn("w", F.regexp_replace("w", "^(.+[^aeiouy])[yY]$", "$1i"))
    rows = _step(_step(_step(rows, STEP_2, "p1"), STEP_3, "p1"), STEP_4, "p2")
    in_first, in_second = F.length("w") > F.col("p1"), F.length("w") > F.col("p2")
    ends = w.endswith("ll") & in_second | w.endswith("e") & (in_second | in_first & ~_without(1).rlike(SHORT))
    rows = rows.withColumn("w", F.lower(F.when(ends, _without(1)).otherwise(w)))
    special = F.element_at(F.create_map(*[F.lit(x) for pair in SPECIAL.items() for x in pair]), F.col(column))
    return rows.select(column, F.explode(F.array(F.coalesce(special, F.when(F.length(column) <= 2, F.col(column)), "kept", "w"))).alias("stem"))
