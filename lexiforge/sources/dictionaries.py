"""Term dictionaries: dictionary text files, pivots, and dictionaries derived from running text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import lowered, strip, unmarked, words

ENTRY = r"^(.+?)\s+(.+?)\s+\[([^\]]+)\]\s+/(.+)/$"
#: Pairs whose source reads the English dictionary.
SUPPORTED = {"English", "Greek", "Hebrew", "Latin"}
EMPTY = "term string, target string, pinyin string, ord long"
PIVOT = "greek STRING, latin STRING, hebrew ARRAY<STRING>, hebrew_pure ARRAY<STRING>, english ARRAY<STRING>, transliteration STRING, translitterations ARRAY<STRING>, proper_name BOOLEAN"


def definition_keys(definitions: Column) -> Column:
    """Search keys of an entry's definitions: lower case, without parentheses and what follows a comma, of letters, blanks and hyphens."""
    key = lambda d: F.trim(F.substring_index(F.trim(F.regexp_replace(lowered(strip(d)), r"\([^)]*\)", "")), ",", 1))
    return F.filter(F.transform(F.split(definitions, "/"), key), lambda k: (F.length(k) >= 2) & F.replace(F.replace(k, F.lit(" "), F.lit("")), F.lit("-"), F.lit("")).rlike(r"^\p{L}+$"))


def parse_entries(lines: DataFrame, order: str | None = None) -> DataFrame:
    """term, target, pinyin, ord of dictionary lines (``value``): the simplified form under each key; other lines drop out."""
    rows = lines.withColumn("line", strip(F.col("value"))).where("line <> '' AND NOT startswith(line, '#')").where(F.col("line").rlike(ENTRY))
    part = lambda i: F.regexp_extract("line", ENTRY, i)
    rows = rows.select((F.col(order) if order else F.monotonically_increasing_id()).cast("long").alias("ord"), part(2).alias("target"), part(3).alias("pinyin"), F.explode(definition_keys(part(4))).alias("term"))
    return rows.groupBy("term", "target").agg(F.min_by("pinyin", "ord").alias("pinyin"), F.min("ord").alias("ord")).select("term", "target", "pinyin", "ord")


def read_dictionary(spark: SparkSession, path: str, source: str = "English", target: str = "Chinese") -> DataFrame:
    """The dictionary of a language pair; an unsupported pair has an empty one."""
    if source not in SUPPORTED or target != "Chinese":
        return spark.createDataFrame([], EMPTY)
    return parse_entries(spark.read.text(path))


def read_pivot(spark: SparkSession, path: str) -> DataFrame | None:
    """A pivot dictionary's entries, or None without the file."""
    try:
        rows = spark.read.schema(PIVOT).option("multiLine", True).json(path)
        rows.isEmpty()
    except AnalysisException:
        return None
    return rows


def pivot_forms(pivot: DataFrame, language: str) -> DataFrame:
    """form, english of each entry: every pure form for Hebrew, the one form for Greek and Latin."""
    form = F.explode("hebrew_pure") if language == "Hebrew" else F.col(language.lower())
    return pivot.select(form.alias("form"), "english").where("form IS NOT NULL").select("form", F.explode("english").alias("english"))


def probes(term: Column) -> Column:
    """The forms under which a dictionary may have a term: in lower case, and as a verb's entry has it, after "to "."""
    return F.array(lowered(term), F.concat(F.lit("to "), lowered(term)))


def pivot_lookup(terms: DataFrame, forms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Entries of ancient terms by way of English: term, english, target, and what else the dictionary has of an entry."""
    found = terms.join(forms, terms["term"] == forms["form"]).select("term", "english", F.explode(probes(F.col("english"))).alias("k"))
    return found.join(dictionary.withColumnRenamed("term", "k"), "k").drop("k").distinct()


def transliterations(pivot: DataFrame, language: str, names: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """name, sound: the first Greek transliteration, the longest of each entry's first for Hebrew, else the fallback's or the name."""
    if language == "Hebrew":
        known = pivot.select(F.explode("hebrew_pure").alias("name"), F.get("translitterations", F.lit(0)).alias("t")).groupBy("name").agg(F.max_by("t", F.struct(F.length("t"), "t")).alias("sound"))
    else:
        known = pivot.select(F.col("greek").alias("name"), "transliteration", F.monotonically_increasing_id().alias("o")).groupBy("name").agg(F.min_by("transliteration", "o").alias("sound"))
    found = names.join(known, "name", "left")
    if fallback is not None:
        found = found.join(fallback.select("name", F.col("sound").alias("other")), "name", "left").withColumn("sound", F.coalesce("sound", "other"))
    return found.select("name", F.coalesce("sound", "name").alias("sound"))


def hebrew_pure_forms(pivot: DataFrame) -> DataFrame:
    """vocalized, pure: the shortest pure form of each proper name's vocalised forms."""
    rows = pivot.where("proper_name").select(F.explode("hebrew").alias("vocalized"), "hebrew_pure").select("vocalized", F.explode("hebrew_pure").alias("pure"))
    return rows.groupBy("vocalized").agg(F.min_by("pure", F.struct(F.length("pure"), "pure")).alias("pure"))


def name_forms(forms: DataFrame) -> DataFrame:
    """form, pure: the vocalised forms (vocalized, pure) and, for texts without vowels, what they are without marks; a form that is both goes by its vocalised entry."""
    rows = forms.select(F.col("vocalized").alias("form"), F.lit(0).alias("bare"), "pure").unionByName(forms.select(unmarked(F.col("vocalized")).alias("form"), F.lit(1).alias("bare"), "pure"))
    return rows.groupBy("form").agg(F.min_by("pure", F.struct("bare", F.length("pure"), "pure")).alias("pure"))


def hebrew_names(texts: DataFrame, keys: list[str], text: str, forms: DataFrame) -> DataFrame:
    """keys, term, occurrences: how often the names whose vocalised forms are given occur in Hebrew texts, under their pure forms."""
    found = texts.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(r"([֐-׿]+)"), F.lit(1))).alias("form"))
    return found.join(name_forms(forms), "form").groupBy(*keys, F.col("pure").alias("term")).agg(F.count("*").alias("occurrences"))


def hebrew_name_counts(texts: DataFrame, pivot: DataFrame) -> DataFrame:
    """pure, occurrences of the proper names in a column of Hebrew texts."""
    return hebrew_names(texts, [], "text", hebrew_pure_forms(pivot)).withColumnRenamed("term", "pure")


def from_sequences(texts: DataFrame, key: str = "item_id") -> DataFrame:
    """A dictionary made of running text: each word leads to the next one; term, target, ord of the first place."""
    rows = texts.select(F.col(key).alias("k"), F.transform(words(F.col("text")), lowered).alias("w")).select("k", F.posexplode(F.arrays_zip(F.col("w").alias("term"), F.slice("w", F.lit(2), F.greatest(F.lit(0), F.size("w") - 1)).alias("target"))))
    rows = rows.select((F.col("k") * 2**32 + F.col("pos")).alias("ord"), F.col("col.term").alias("term"), F.col("col.target").alias("target")).where("target IS NOT NULL")
    return rows.groupBy("term", "target").agg(F.min("ord").cast("long").alias("ord"))


def pinyin(words_: DataFrame, dictionary: DataFrame, syllables: DataFrame) -> DataFrame:
    """word, pinyin: the first entry that has the word, else the joined syllables of its characters, capitalised."""
    known = dictionary.groupBy("target").agg(F.min_by("pinyin", "ord").alias("known")).withColumnRenamed("target", "word")
    spelled = words_.select("word", F.posexplode(F.split("word", "")).alias("i", "c")).join(syllables.withColumnRenamed("character", "c"), "c", "left").groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("syllable", "c").alias("s")))), lambda x: x.s), " ").alias("spelled"))
    joined = words_.join(known, "word", "left").join(spelled, "word", "left")
    return joined.select("word", F.coalesce("known", F.concat(F.upper(F.substring("spelled", 1, 1)), F.expr("substring(spelled, 2)"))).alias("pinyin"))
