"""Templates in texts ("42 comments" -> "{count} comments"), as native expressions.

A pattern replaces one number.  It is valid if the text has at least two words and some
word, without non-letters at its ends, is a unit of time, a countable thing, or one of
``INDICATORS``.  A replaced word is never such a word itself, and replacing changes no
other word, so the first number outside the text's only such word is the one that is
replaced.  That needs one look at each word, however many numbers there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a number may count, and other words that make a template.
TIME = "second seconds minute minutes hour hours day days week weeks month months year years".split()
COUNT = "comment comments reply replies like likes view views share shares point points upvote upvotes item items".split()
INDICATORS = "ago per of".split()
BEFORE = "page item".split()

FLOAT = r"(?U)\b\d+\.\d+\b"
NUMBER = r"(?U)\b\d+\b"
_WHITE = r"[\t-\r \x{85}\p{Z}]+"
_WORD = r"[^\t-\r \x{85}\p{Z}]+"
_EDGES = r"^\P{IsAlphabetic}+|\P{IsAlphabetic}+$"


def _allowed(places: Column, signs: Column) -> Column:
    """The first of the words with a number that isn't the text's only sign; null if there is none."""
    first = F.get(places, F.lit(0))
    return F.when((F.size(signs) > 1) | (first != F.get(signs, F.lit(0))), first).otherwise(F.get(places, F.lit(1)))


def with_templates(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with template_pattern, template_variable and template_type (Float or Number); null where there is no template.

    Null texts have no template.  Columns of these names, or starting with ``_tpl_``, are replaced.
    """
    c = F.col
    sign = lambda w: F.regexp_replace(F.lower(w), _EDGES, "").isin(*TIME, *COUNT, *INDICATORS)
    text = F.regexp_replace(c(content), f"^{_WHITE}|{_WHITE}$", "")
    # most texts have no number, and are done here
    d = df.withColumn("_tpl_text", F.when(c(content).rlike(r"(?U)\d"), text))
    d = d.withColumn("_tpl_words", F.split("_tpl_text", _WHITE)).withColumn("_tpl_gaps", F.split("_tpl_text", _WORD, -1))
    # lambdas use nothing but their own arguments: an outer column would be computed again for every word
    mark = lambda w, k: F.struct(k.alias("k"), sign(w).alias("sign"), w.rlike(FLOAT).alias("float"), w.rlike(NUMBER).alias("number"))
    d = d.withColumn("_tpl_marks", F.transform("_tpl_words", mark))
    where = lambda x: F.transform(F.filter("_tpl_marks", lambda m: m[x]), lambda m: m["k"])
    d = d.withColumn("_tpl_signs", where("sign")).withColumn("_tpl_floats", where("float")).withColumn("_tpl_numbers", where("number"))
    d = d.withColumn("_tpl_words", F.when((F.size("_tpl_words") > 1) & (F.size("_tpl_signs") > 0), c("_tpl_words")))
    found = lambda x: F.when(c("_tpl_words").isNotNull(), _allowed(c(x), c("_tpl_signs")))
    d = d.withColumn("_tpl_float", found("_tpl_floats")).withColumn("_tpl_at", F.coalesce("_tpl_float", found("_tpl_numbers")))
    is_float = c("_tpl_float").isNotNull()
    either = lambda f: F.when(is_float, f(FLOAT)).otherwise(f(NUMBER))
    d = d.withColumn("_tpl_word", F.get("_tpl_words", "_tpl_at"))
    before = F.slice(F.zip_with("_tpl_words", F.slice("_tpl_gaps", F.lit(2), F.size("_tpl_gaps")), lambda w, g: F.concat(w, g)), F.lit(1), c("_tpl_at"))
    d = d.withColumn("_tpl_before", F.when(c("_tpl_at").isNotNull(), F.array_join(before, "")))
    d = d.withColumn("_tpl_head", either(lambda rx: F.get(F.split("_tpl_word", rx, 2), F.lit(0))))
    d = d.withColumn("_tpl_number", either(lambda rx: F.regexp_extract("_tpl_word", rx, 0)))
    earlier = lambda rx: F.aggregate(F.slice("_tpl_words", F.lit(1), c("_tpl_at")), F.lit(0), lambda n, w: n + F.regexp_count(w, F.lit(rx)))
    d = d.withColumn("_tpl_nth", either(earlier))
    # the word whose neighbours name the number: found as if words were one byte apart
    target = F.octet_length("_tpl_before") + F.octet_length("_tpl_head")
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("k"), F.lit(-1).alias("hit"), target.alias("to"))
    step = lambda a, w: F.struct(
        (a["pos"] + F.octet_length(w) + 1).alias("pos"), (a["k"] + 1).alias("k"),
        F.when((a["hit"] < 0) & (a["pos"] <= a["to"]) & (a["to"] < a["pos"] + F.octet_length(w)), a["k"]).otherwise(a["hit"]).alias("hit"), a["to"].alias("to"),
    )
    d = d.withColumn("_tpl_hit", F.aggregate("_tpl_words", start, step)["hit"])
    near = lambda k: F.when((c("_tpl_hit") >= 0) & (c("_tpl_hit") + k >= 0), F.lower(F.get("_tpl_words", c("_tpl_hit") + k)))
    plain = F.concat(F.lit("value"), F.when(c("_tpl_nth") == 0, "").otherwise(c("_tpl_nth").cast("string")))
    name = F.when(is_float, plain).when(near(1).isin(TIME), "time").when(near(1).isin(COUNT), "count").when(near(2) == "ago", "time").when(near(-1).isin(BEFORE), "count").otherwise(plain)
    d = d.withColumn("template_variable", F.when(c("_tpl_at").isNotNull(), name))
    rest = F.substring("_tpl_text", F.length("_tpl_before") + F.length("_tpl_head") + F.length("_tpl_number") + 1, F.length("_tpl_text"))
    d = d.withColumn("template_pattern", F.concat("_tpl_before", "_tpl_head", F.lit("{"), "template_variable", F.lit("}"), rest))
    d = d.withColumn("template_type", F.when(c("_tpl_at").isNotNull(), F.when(is_float, "Float").otherwise("Number")))
    # as a generator's output the columns stay as they are: filters on them aren't pushed into what makes them
    three = ["template_pattern", "template_variable", "template_type"]
    return d.select(*[x for x in df.columns if x not in three and not x.startswith("_tpl_")], F.inline(F.array(F.struct(*three))))


def apply_templates(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with its texts turned into their patterns; texts without one stay as they are."""
    d = with_templates(df, content)
    return d.withColumn(content, F.coalesce("template_pattern", content)).drop("template_pattern", "template_variable", "template_type")
