"""Text helpers as Column expressions: labels, numbers, intents, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning of their own for retrieval.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "was", "were", "what", "which", "with")
TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"


def numbers(text: Column) -> Column:
    """All numbers of a text, to two places, as strings."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), 0), lambda x: x.try_cast("decimal(38,2)").cast("string"))


def tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case words of ASCII letters and digits, with dots and hyphens inside, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)
    return F.filter(found, lambda x: ~x.isin(*stop))


def label(column: Column) -> Column:
    """``temperature_mean`` to ``mean temperature``."""
    return F.regexp_replace(column, "^([a-z]+)_([a-z]+)$", "$2 $1")


def url_clean(url: Column) -> Column:
    """Scheme, lower-case host and path; user info, query and fragment are left out."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1), "^[^@]*@", ""))
    scheme, path = F.lower(F.regexp_extract(url, "^([a-zA-Z]+)://", 1)), F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.concat(scheme, F.lit("://"), host, path)


# The name of a profile's file, and what stands before an identity made from it.
PROFILE_FILE, FILE_SOURCE = r"^(?:.*/)?[A-Z]{1,2}([0-9A-Za-z]+)_([0-9]{3,})(D?)\.nc$", "gdac"


def file_parts(name: Column) -> Column:
    """Struct platform, cycle, direction (A or D), identity of a profile file's name or path; null for other names."""
    part = lambda k: F.regexp_extract(name, PROFILE_FILE, k)
    cycle, direction = part(2).try_cast("long"), F.when(part(3) == "D", "D").otherwise("A")
    identity = F.concat(F.lit(f"{FILE_SOURCE}:"), part(1), F.lit("_"), cycle.cast("string"), direction)
    return F.when(name.rlike(PROFILE_FILE), F.struct(part(1).alias("platform"), cycle.alias("cycle"), direction.alias("direction"), identity.alias("identity")))
