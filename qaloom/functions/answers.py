"""Canonical forms of free-text answers, as expressions.

Class names are a column (``array<string>``), so that one plan serves any list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaloom.functions.text import folded

#: Fixed value: the ten class names of the public definitions file.
CLASS_NAMES = ("Sponge", "Clip", "Specimen Bag", "Silicone Loop", "External Drain", "Needle", "Gallstone", "Specimen", "Mesh", "Absorbable Hemostatic Agent")


def class_names(names: tuple[str, ...] = CLASS_NAMES) -> Column:
    return F.array(*(F.lit(n) for n in names))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def without_end_marks(text: Column) -> Column:
    """Closing marks removed; blanks before them stay, as in the outcome ``12 ``."""
    return F.regexp_replace(strip(text), r"(?U)[.!?;:]+\s*\z", "")


def items(text: Column) -> Column:
    """Non-empty trimmed items between commas."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def time_list(text: Column) -> Column:
    """Clock times joined by ``, ``; null unless every item is one."""
    a = items(text)
    sound = F.forall(a, lambda x: x.rlike(r"\A\d{2}:[0-5]\d:[0-5]\d\z"))
    return F.when((F.size(a) > 0) & sound, F.array_join(a, ", "))


def class_list(text: Column, names: Column) -> Column:
    """Known class names in their own spelling, each once, joined by ``, ``; ``none`` alone is kept; else null."""
    a = F.transform(items(text), folded)
    spelled = F.transform(a, lambda x: F.get(F.filter(names, lambda n: folded(n) == x), F.lit(0)))
    whole = (F.size(a) > 0) & F.forall(spelled, lambda x: x.isNotNull())
    return F.when((F.size(a) == 1) & (F.get(a, 0) == "none"), "none").when(whole, F.array_join(F.array_distinct(spelled), ", "))


def normalise(text: Column, names: Column) -> Column:
    """One of: yes/no, whole number, number or percentage, times, classes; else the trimmed text as it is."""
    c = without_end_marks(text)
    number = F.regexp_replace(c, r"(?U)\s+%", "%")
    found = F.when(c.rlike(r"(?i)\A(?:yes|no)\z"), F.lower(c)).when(c.rlike(r"\A\d+\z"), c).when(c.rlike(r"\A\d+(?:\.\d+)?\s*%?\z"), number)
    return F.when(strip(text) == "", "").otherwise(F.coalesce(found, time_list(c), class_list(c, names), strip(text)))


def kind(text: Column, names: Column) -> Column:
    """Form of an answer: blank, binary, count, percentage, time, none, classes or open."""
    c = without_end_marks(text)
    return (
        F.when(text.isNull() | (strip(text) == ""), "blank")
        .when(c.rlike(r"(?i)\A(?:yes|no)\z"), "binary")
        .when(c.rlike(r"\A\d+\z"), "count")
        .when(c.rlike(r"\A\d+(?:\.\d+)?\s*%?\z"), "percentage")
        .when(time_list(c).isNotNull(), "time")
        .when(class_list(c, names) == "none", "none")
        .when(class_list(c, names).isNotNull(), "classes")
        .otherwise("open")
    )


def headings(text: Column, hyphens: int = 3) -> Column:
    """Class headings: lines above a line of at least so many hyphens, each once, in order."""
    lines = F.transform(F.split(text, r"\r?\n"), strip)
    pairs = F.zip_with(lines, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    found = F.filter(pairs, lambda p: (p["a"] != "") & p["b"].rlike(rf"\A-{{{hyphens},}}\z"))
    return F.array_distinct(F.transform(found, lambda p: p["a"]))


def resolved_names(text: Column, fallback: Column, hyphens: int = 1) -> Column:
    """Names from the definitions, or else the fallback."""
    found = headings(F.coalesce(text, F.lit("")), hyphens)
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def format_valid(text: Column, form: Column, names: Column) -> Column:
    """Whether an answer can be read in its declared format; open formats take any text that isn't blank."""
    c = without_end_marks(text)
    k = kind(text, names)
    layout = c.rlike(r"(?i)\A(?:\d+\.\s*[a-z ]+:\s*(?:top|bottom)/(?:left|right)\s*)+\z")
    known = (
        F.when(form == "yesno", k == "binary")
        .when(form == "count", k == "count")
        .when(form == "percent", c.rlike(r"\A\d+(?:\.\d+)?\s*%\z"))
        .when(form == "time", k == "time")
        .when(form == "cls", (k == "none") | ((k == "classes") & (F.size(items(c)) == 1)))
        .when(form == "clslist", k.isin("none", "classes"))
        .when(form == "layout", layout)
    )
    return F.coalesce(known, k != "blank") & (k != "blank")


def format_name(given: Column, format_: Column) -> Column:
    """Name of an answer's format: the one given, else the type of its format, else ''."""
    return F.coalesce(given, format_["type"], F.lit(""))


def format_error(valid: Column, form: Column) -> Column:
    """What is wrong with an answer's format; '' if nothing."""
    return F.when(valid, "").otherwise(F.concat(F.lit("not in the format "), F.coalesce(form, F.lit("(none)"))))
