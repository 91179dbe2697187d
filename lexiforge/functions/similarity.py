"""Spelling and sound similarity. The sequence matcher has no built-in equal, so two pandas functions hold it."""

from __future__ import annotations

import difflib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..shipping import ship
from .text import length_factor, position_ratio

# Sounds and what stands for them, in the order in which they are tried.
SOUNDS = {
    "English": [
        ("br", "bo"), ("ham", "han"), ("a", "ya"), ("e", "yi"), ("j", "y"), ("c", "k"), ("ch", "ke"), ("ck", "ke"),
        ("x", "kesi"), ("th", "t"), ("ph", "f"), ("gr", "ge"), ("pr", "pu"), ("tr", "te"), ("dr", "de"), ("fr", "fu"),
        ("cr", "ke"), ("aa", "a"), ("ee", "i"), ("oo", "u"), ("ou", "ao"), ("ow", "ao"), ("ey", "ei"), ("ay", "ai"),
        ("oy", "ao"), ("v", "w"), ("bb", "b"), ("cc", "k"), ("dd", "d"), ("ff", "f"), ("gg", "g"), ("ll", "l"),
        ("mm", "m"), ("nn", "n"), ("pp", "p"), ("rr", "r"), ("ss", "s"), ("tt", "t"),
    ],
    "Hebrew": [
        ("sh", "s"), ("ch", "he"), ("kh", "he"), ("ts", "ci"), ("tz", "ci"), ("ph", "f"), ("ah", "a"), ("eh", "ai"),
        ("ih", "i"), ("oh", "ao"), ("uh", "u"), ("ai", "ai"), ("ei", "ai"), ("oi", "ao"), ("el", "ai"), ("al", "a"),
        ("im", "mu"), ("ot", "te"), ("et", "te"), ("it", "te"), ("h", ""), ("q", "ke"), ("w", "wo"), ("y", "ya"),
        ("bb", "b"), ("dd", "d"), ("gg", "g"), ("ll", "l"), ("mm", "m"), ("nn", "n"), ("pp", "p"), ("rr", "r"),
        ("tt", "t"),
    ],
    "Greek": [
        ("ch", "ke"), ("ph", "f"), ("th", "t"), ("ps", "s"), ("ks", "ke"), ("gh", "ge"), ("kh", "ke"), ("rh", "r"),
        ("ai", "ai"), ("ei", "ai"), ("oi", "ao"), ("au", "ao"), ("eu", "ao"), ("ou", "u"), ("ui", "wei"), ("os", "si"),
        ("es", "si"), ("is", "si"), ("as", "si"), ("ion", "ang"), ("tion", "xiong"), ("bb", "b"), ("dd", "d"), ("gg", "g"),
        ("ll", "l"), ("mm", "m"), ("nn", "n"), ("pp", "p"), ("rr", "r"), ("tt", "t"),
    ],
    "Latin": [
        ("qu", "kuo"), ("c", "k"), ("ph", "f"), ("th", "t"), ("ch", "ke"), ("x", "ke"), ("j", "ya"), ("ae", "ai"),
        ("oe", "ao"), ("au", "ao"), ("eu", "ao"), ("us", "si"), ("um", "mu"), ("is", "si"), ("es", "si"), ("ius", "si"),
        ("tion", "xiong"), ("tio", "xiao"), ("bb", "b"), ("cc", "k"), ("dd", "d"), ("ff", "f"), ("gg", "g"), ("ll", "l"),
        ("mm", "m"), ("nn", "n"), ("pp", "p"), ("rr", "r"), ("tt", "t"),
    ],
    "": [
        ("ch", "ke"), ("sh", "s"), ("th", "t"), ("ph", "f"), ("qu", "kuo"), ("x", "ke"), ("j", "ya"), ("w", "wo"),
        ("bb", "b"), ("cc", "k"), ("dd", "d"), ("ff", "f"), ("gg", "g"), ("ll", "l"), ("mm", "m"), ("nn", "n"),
        ("pp", "p"), ("rr", "r"), ("tt", "t"),
    ],
}
# Rules for the ends of names (pattern, what stands instead), tried in order.
ENDS = {
    "English": [
        ("^kn", ""), ("^ps", "s"), ("^wr", "r"), ("mb$", "m"), ("gn$", "n"), ("bt$", "t"),
    ],
    "Hebrew": [
        ("ah$", "a"), ("el$", "l"), ("^h", ""),
    ],
    "Greek": [
        ("os$", "s"), ("es$", "s"), ("^ps", "s"),
    ],
}
VARIANTS = 5


def variants(name: str, language: str) -> list[str]:
    """Ways to spell a name's sounds, the name itself first; at most five at any step."""
    for pattern, instead in ENDS.get(language, []):
        name = re.sub(pattern, instead, name)
    found = [name]
    for sound, instead in SOUNDS.get(language, SOUNDS[""]):
        if sound in name:
            spelled = ((v, v.replace(sound, instead)) for v in found)
            found = [x for old, new in spelled for x in ((old,) if old == new else (old, new))][:VARIANTS]
    return found


def _pieces(text: str) -> set[str]:
    return {text[i : i + n] for n in (2, 3) for i in range(len(text) - n + 1)}


def name_similarity(source: str, pinyin: str, language: str) -> float:
    """How alike a source name and a romanised target sound, from 0 to 1."""
    sound = re.sub(r"[\d ]", "", pinyin.lower())
    name = source.lower()
    if min(len(name), len(sound)) < 2:
        return 0.0
    spelled = variants(name, language)
    ratio = [difflib.SequenceMatcher(None, v, sound).ratio() for v in spelled]
    longer = [max(len(v), len(sound)) for v in spelled]
    even = [min(len(v), len(sound)) / n if n else 0.0 for v, n in zip(spelled, longer, strict=True)]
    if language != "English":
        return min(1.0, max(r + (0.1 if e > 0.7 else 0.0) for r, e in zip(ratio, even, strict=True)))
    own = _pieces(sound)
    shared = max(len(_pieces(v) & own) / len(_pieces(v) | own) if _pieces(v) | own else 0.0 for v in spelled)
    direct, near = max(ratio), max(even)
    most = max(direct, 1.2 * shared)
    if most < 0.25:
        return 0.0
    far = min(abs(len(v) - len(sound)) for v in spelled) > 3
    return min(1.0, (0.5 * direct + 0.3 * shared + 0.1 * near + 0.1 * most) * (0.5 if far else 1.0))


@lru_cache(1 << 16)
def _ratio(x: str, y: str) -> float:
    return difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio()


@F.pandas_udf(DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    """The matcher's ratio of two texts in lower case; the order of the arguments counts."""
    ship()
    return _sequence_ratio(a, b)


@F.pandas_udf(DoubleType())
def _name_score(source: pd.Series, pinyin: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([name_similarity(s, p, x) if s is not None and p is not None else None for s, p, x in zip(source, pinyin, language, strict=True)], dtype="float64")


def name_score(source: Column | str, pinyin: Column | str, language: Column | str) -> Column:
    """How alike source names and romanised targets sound (``name_similarity``)."""
    ship()
    return _name_score(source, pinyin, language)


def pieces(c: Column) -> Column:
    """The different runs of two and three characters of a text, as an array."""
    n = F.length(c)
    runs = lambda k: F.transform(F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(c, i, F.lit(k)))
    return F.array_distinct(F.concat(runs(2), runs(3)))


def shared_pieces(a: Column, b: Column) -> Column:
    """The share of two texts' pieces that both have; 0 without any."""
    x, y = pieces(a), pieces(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def combined(target: Column, translation: Column, ratio: Column) -> Column:
    """Characters in place, sound and length, weighed 0.4, 0.4 and 0.2."""
    return 0.4 * position_ratio(target, translation) + 0.4 * ratio + 0.2 * length_factor(target, translation)


#: Letters from rare to common, as most languages in this script have them; an order of search only, no result depends on it.
RARE_FIRST = "zqjxkvbpygfwmucldrhsnioate"


def _characters(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(c, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def numbered(sound: Column) -> Column:
    """A text's characters in lower case, each with how many alike stand before it (s, s1, ...), rare ones first: two texts have as many of them in common as a matcher can pair."""
    one = lambda ch, i, all_: F.struct((-F.size(F.filter(F.slice(all_, F.lit(1), i), lambda x: x == ch))).alias("o"), F.position(ch, F.lit(RARE_FIRST)).alias("r"), ch.alias("c"))
    chars = _characters(F.lower(sound))
    places = F.array_sort(F.transform(chars, lambda ch, i: one(ch, i, chars)))
    return F.transform(places, lambda x: F.concat(x["c"], F.when(x["o"] < 0, (-x["o"]).cast("string")).otherwise("")))


def bits(tokens: Column) -> Column:
    """A set of texts as two 64-bit masks of hashes, each with how many texts share another's bit there."""
    bit = lambda x, seed: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x, F.lit(seed)), F.lit(64)).cast("int"))
    mask = lambda seed: F.aggregate(tokens, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(bit(x, seed)))
    return F.struct(*[x for k, seed in (("a", 1), ("b", 2)) for x in (mask(seed).alias(k), (F.size(tokens) - F.bit_count(mask(seed))).alias(f"{k}_lost"))])


def most_in_common(x: Column, y: Column) -> Column:
    """At least as many as two sets of ``bits`` have in common: what they share keeps a common bit, but for texts that share one's own."""
    return F.least(*[F.bit_count(x[k].bitwiseAND(y[k])) + x[f"{k}_lost"] for k in "ab"])


def places(word: Column) -> Column:
    """A word's characters with its length and their places."""
    return F.transform(_characters(word), lambda ch, i: F.concat_ws(":", F.length(word), i, ch))


def might_pass(target: Column, translation: Column, target_bits: Column, bits_: Column, target_places: Column, places_: Column, n: Column, m: Column) -> Column:
    """All pairs that ``may_pass`` keeps, and some more, without a look at the characters; ``n`` and ``m``: lengths of the sounds."""
    ratio = F.when(n + m > 0, 2.0 * most_in_common(bits_, target_bits) / (n + m)).otherwise(1.0)
    place = F.when((F.length(target) == F.length(translation)) & (F.length(target) > 0), most_in_common(places_, target_places) / F.length(target)).otherwise(0.0)
    score = 0.4 * place + 0.4 * ratio + 0.2 * length_factor(target, translation)
    # Without a common place the ratio must be above three quarters; whole numbers tell that sooner.
    near = 8 * (F.bit_count(bits_["a"].bitwiseAND(target_bits["a"])) + bits_["a_lost"]) >= 3 * (n + m)
    agree = (places_["a"].bitwiseAND(target_places["a"]) != 0) & (F.length(target) == F.length(translation))
    return (near | agree) & (score > F.when(F.length(target) == 2, 0.7).otherwise(0.5) - 1e-9)


def may_pass(target: Column, translation: Column, target_sound: Column, sound: Column) -> Column:
    """Pairs that can pass, by the most that the matcher can pair of their ``numbered`` sounds."""
    length = F.size(target_sound) + F.size(sound)
    most = F.when(length > 0, 2.0 * F.size(F.array_intersect(target_sound, sound)) / length).otherwise(1.0)
    return combined(target, translation, most) > F.when(F.length(target) == 2, 0.7).otherwise(0.5)


def passes(target: Column, score: Column) -> Column:
    """Above 0.7 for two characters and above 0.5 for more, but not identical."""
    return (F.length(target) >= 2) & (score > F.when(F.length(target) == 2, 0.7).otherwise(0.5)) & (score != 1.0)
