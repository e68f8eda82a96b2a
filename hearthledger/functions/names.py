"""Names and labels: slugs, titles, accounts, aliases of stores, boxes of forms, file names. All column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthledger.functions.text import squeezed

#: Aliases are tried in this order and the first that is found is replaced once: (expression, name).
STORE_ALIASES = (
    (r"amzn\s*mktp\s*us|amazon\.com|amzn", "Amazon"),
    (r"wal-?mart(?:\s+supercenter)?|wm\s+supercenter", "Walmart"),
    (r"tgt|target\s+store", "Target"),
    (r"costco\s*whse|costco", "Costco"),
    (r"mcdonald'?s?", "McDonald's"),
    (r"sbux|starbucks(?:\s+store)?", "Starbucks"),
    (r"uber\s*\*?\s*eats", "Uber Eats"),
    (r"uber\s*\*?\s*trip|uber", "Uber"),
    (r"netflix(?:\.com)?", "Netflix"),
    (r"spotify(?:\s+usa)?", "Spotify"),
)


def store_alias(text: Column, aliases: Sequence[tuple[str, str]] = STORE_ALIASES) -> Column:
    """The first alias found, replaced once; the text as it is without one."""
    out = text
    for shape, name in reversed(list(aliases)):
        once = F.regexp_replace(text, rf"(?is)^(.*?)(?:{shape})", "$1" + name.replace("\\", "\\\\").replace("$", "\\$"))
        out = F.when(text.rlike(f"(?i)(?:{shape})"), once).otherwise(out)
    return out


def slug(text: Column, joint: str = "_", default: str = "unknown") -> Column:
    """Letters a-z and digits, all else one `joint`, none at the ends; `default` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", joint), rf"^{joint}+|{joint}+$", "")
    return F.when(bare == "", default).otherwise(bare)


def humanized(key: Column) -> Column:
    """`online_shopping` as `Online Shopping`."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def titled(text: Column) -> Column:
    """The first letter of each word upper-cased, the rest as it is."""
    words = F.split(text, " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def account_name(text: Column) -> Column:
    """White space collapsed; null if nothing is left, which callers reject."""
    bare = squeezed(text)
    return F.when(bare != "", bare)


def account_display(issuer: Column, account_type: Column, mask: Column) -> Column:
    """`Issuer type ...1234`, without the mask where there is none."""
    return F.concat(issuer, F.lit(" "), account_type, F.when(F.coalesce(mask, F.lit("")) != "", F.concat(F.lit(" ..."), mask)).otherwise(""))


def label(text: Column) -> Column:
    """A label for looking up: white space collapsed, lower case."""
    return F.lower(squeezed(text))


def box(text: Column) -> Column:
    """`Box 1A` as `1a`, `int : 1` as `INT:1`, `st` as `ST`."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"(?i)^box", "")
    name = F.regexp_extract(bare, r"([^:]*)$", 1)
    name = F.when(F.upper(name).isin("ST", "LT"), F.upper(name)).otherwise(F.lower(name))
    section = F.upper(F.regexp_extract(bare, r"^(.*):[^:]*$", 1))
    return F.when(bare.contains(":"), F.concat(section, F.lit(":"), name)).otherwise(name)


def file_name(path: Column, default: str = "statement.pdf") -> Column:
    """A name that was uploaded, without folders, of a small set of characters, 255 at most."""
    base = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.substring(F.regexp_replace(F.when(base.isin("", "."), default).otherwise(base), "[^A-Za-z0-9._ -]", "_"), 1, 255)
