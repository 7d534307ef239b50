"""String rules of manifests, paths and case names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Territory families and their ids; anything else is UNKNOWN.
FAMILIES = {"ABAO": 0, "AO": 1, "CERE": 2, "CORO": 3, "PULM": 4, "PULMFON": 5, "PULMGLN": 6, "UNKNOWN": 7}
#: What counts as true and as false.
TRUE, FALSE = ("yes", "true", "t", "y", "1"), ("no", "false", "f", "n", "0")


def status_set(text: Column) -> Column:
    """A comma-separated list as a sorted array: trimmed, lower-cased, without blanks or repeats."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def path_key(path: Column) -> Column:
    """Forward slashes, and no dots or slashes at the front."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def safe_stem(name: Column) -> Column:
    """A file name without .nii or .nii.gz, odd characters as ``_``, no ``._-`` at the ends; ``case`` if nothing is left."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.nii(\.gz)?$", ""), r"[^A-Za-z0-9._=-]+", "_")
    return F.coalesce(F.nullif(F.btrim(stem, F.lit("._-")), F.lit("")), F.lit("case"))


def stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def territory_family(territory: Column) -> Column:
    prefix = F.split(territory, "_")[0]
    return F.when(prefix.isin(*FAMILIES), prefix).otherwise("UNKNOWN")


def family_norm(family: Column) -> Column:
    """A family's id over the largest id."""
    ids = F.create_map(*(x for k, v in FAMILIES.items() for x in (F.lit(k), F.lit(float(v)))))
    return ids[family] / max(FAMILIES.values())


def parse_bool(text: Column) -> Column:
    """True or false for the known spellings; any other text fails the query."""
    low = F.lower(text)
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False).when(low.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)))


def m_value(text: Column) -> Column:
    """``m=0.002`` or ``0.002`` as a number."""
    return F.regexp_replace(text, "^m=", "").try_cast("double")


def filter_words(text: Column) -> Column:
    """A filter of words parted by commas or spaces as an array; null (no filter) if it is empty or holds ``all``."""
    words = F.array_distinct(F.filter(F.split(F.replace(text, F.lit(","), F.lit(" ")), r"\s+"), lambda x: x != ""))
    return F.when((F.size(words) > 0) & ~F.exists(words, lambda x: F.lower(x) == "all"), words)


def numbered_case(name: Column, prefix: str = "aneumo") -> Column:
    """A case id: the part after ``prefix`` (in any case) of a stem parted by ``_``, or an all-digit stem; else null."""
    parts = F.split(name, "_")
    return F.when((F.size(parts) > 1) & (F.lower(parts[0]) == prefix), parts[1]).when(name.rlike(r"^[0-9]+$"), name)
