r"""What must not be stored or shown: personal entries of users, taxpayer numbers, forbidden shapes.

Column expressions, but for NFKC, which Spark has no function for.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthledger.functions.columns import let
from hearthledger.functions.text import squeezed

# Shapes that a clean description must not have.
FORBIDDEN = {
    "long_digit_run": r"\d{6,}",
    "email": r"(?U)[\w.+-]+@[\w-]+\.\w+",
    "phone": r"\+?\d[\d\-\(\) ]{8,}\d",
    "currency_amount": r"\$\s?\d",
    "iso_date": r"\b\d{4}-\d{2}-\d{2}\b",
}
# Taxpayer numbers of persons and of employers.
SSN = r"(?<!\d)\d{3}[- ]?\d{2}[- ]?(\d{4})(?!\d)"
EIN = r"(?<!\d)\d{2}-?\d{3}(\d{4})(?!\d)"
#: A payer's name and a jurisdiction are cut at these lengths.
PAYER_CHARS, JURISDICTION_CHARS = 120, 32


def nfkc(text: Column) -> Column:
    """Compatibility characters as plain ones (`ﬁ` as `fi`, full-width digits as digits)."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return plain(text)


def printable(text: Column) -> Column:
    """White space collapsed, control and format characters out."""
    return squeezed(F.regexp_replace(F.regexp_replace(text, r"(?U)\s", " "), r"[\p{Cc}\p{Cf}]", ""))


def forbidden(clean: Column) -> Column:
    """The name of the first forbidden shape in a description, else null."""
    return F.coalesce(*[F.when(clean.rlike(shape), name) for name, shape in FORBIDDEN.items()])


def entries(*sources: Iterable) -> list[str]:
    """Entries of several lists, stripped, without blanks and later spellings of one."""
    every = [v.strip() for v in chain.from_iterable(sources) if isinstance(v, str) and v.strip()]
    first_at = {v.casefold(): i for i, v in reversed(list(enumerate(every)))}
    return [every[i] for i in sorted(first_at.values())]


#: A text as an array: runs of digits, runs of other word characters, and what stands between them.
_TOKENS = r"(?U)\d+|[\w&&[^\d]]+|\W+"
TOKENS_OF_ENTRIES = ("[PHONE]", "[NUMBER]", "[NAME]", "[REDACTED]")
#: Parts of a form other than a token as it stands: any white space and commas and full stops; one letter.
_GAP, _LETTER = "\x01", "\x02"


@dataclass(frozen=True)
class _Entry:
    """What stands for one entry: digits (written with any separators), or forms, each a sequence of tokens."""

    token: str
    digits: tuple[str, ...] = ()
    forms: tuple[tuple, ...] = ()


def _entry(text: str) -> _Entry | None:
    tokens = re.findall(r"\d+|[^\W\d]+|\W+", text.lower())
    words = [t for t in tokens if re.match(r"\w", t)]
    number = "".join(words)
    if len(number) >= 4 and number.isdecimal() and not set(text) - set(_SEPARATORS) - set(number):
        plain = number.removeprefix("1") if len(number) == 11 else number
        # A number of ten digits is the same with the country's 1 before it.
        return _Entry("[PHONE]" if len(number) in (10, 11) else "[NUMBER]", digits=(plain, "1" + plain) if len(plain) == 10 else (plain,))
    # Names part at white space, commas and full stops; what else stands between two words (O'Neil, A&B) must be there.
    names: list[list] = [[]]
    for t in tokens:
        if re.fullmatch(r"[\s,.]+", t):
            names.append([])
        else:
            names[-1].append(t)
    names = [n for n in names if any(re.match(r"\w", t) for t in n)]
    if not names:
        return None
    while not re.match(r"\w", names[0][0]):
        names[0].pop(0)
    while not re.match(r"\w", names[-1][-1]):
        names[-1].pop()

    def sequence(*parts) -> tuple:
        out: list = []
        for part in parts:
            out += [_GAP] * bool(out) + (part if isinstance(part, list) else [part])
        return tuple(out)

    if len(names) in (2, 3) and not any(t.isdecimal() or "&" in t or "_" in t for n in names for t in n):
        *first, last = names
        forms = [sequence(last, *first, _LETTER), sequence(last, *first), sequence(*names)]
        if len(first) == 1:
            forms.insert(0, sequence(*first, _LETTER, last))
        return _Entry("[NAME]", forms=tuple(forms))
    return _Entry("[REDACTED]", forms=(sequence(*names),))


_SEPARATORS = " .()+-/"


def personal(text: Column, own: Iterable[str]) -> Column:
    """A struct of the text with a user's entries replaced (`text`) and how often by each token (`counts`, a map).

    Text and entries are compared token by token, without case. The longest entry goes first, and what was replaced is not searched again. Entries of one
    character, and those without a letter or digit, do not count; signs around an entry are no part of it, but the brackets and the plus of a number go with it, and so does the
    full stop of an initial. Digits may stand next to letters; words may not go on.
    """
    known = [e for e in map(_entry, sorted((e for e in entries(own) if len(e) >= 2), key=len, reverse=True)) if e]
    none = F.create_map(*[x for t in TOKENS_OF_ENTRIES for x in (F.lit(t), F.lit(0))])
    if not known:
        return F.struct(text.alias("text"), none.alias("counts"))
    rows = [{"token": e.token, "number": number, "parts": list(parts)} for e in known for number, all_ in ((True, [(x,) for x in e.digits]), (False, e.forms)) for parts in all_]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<token: string, number: boolean, parts: array<string>>>")
    is_word = lambda t: F.coalesce(t.rlike(r"(?U)^\w"), F.lit(False))

    def fits(low: Column, i: Column, parts: Column) -> Column:
        """How many tokens from i on are these parts; 0 if they are not."""

        def wrong(part: Column, j: Column) -> Column:
            t = F.get(low, i + j)
            return ~F.coalesce(F.when(part == _GAP, t.rlike(r"^[\s,.]+$")).when(part == _LETTER, t.rlike(r"^\p{L}$")).otherwise(t == part), F.lit(False))

        alone = (parts[0].rlike(r"^\d") | ~is_word(F.get(low, i - 1))) & ~is_word(F.get(low, i + F.size(parts)))
        return F.when((F.get(low, i) == parts[0]) & alone & ~F.exists(F.transform(parts, wrong), lambda x: x), F.size(parts)).otherwise(0)

    def reach(low: Column, i: Column, digits: Column) -> Column:
        """How many tokens from i on are the digits, with separators between; 0 if they are not."""
        start = F.struct(F.lit("").alias("seen"), F.lit(0).alias("n"), F.lit(0).alias("hit"))

        def step(acc: Column, t: Column) -> Column:
            seen = F.when(t.rlike(r"^\d+$"), F.concat(acc["seen"], t)).when(t.rlike(r"^[\s().+\-/]+$"), acc["seen"])
            on = F.struct(seen.alias("seen"), (acc["n"] + 1).alias("n"), F.when(seen == digits, acc["n"] + 1).otherwise(0).alias("hit"))
            return F.when((acc["hit"] > 0) | acc["seen"].isNull(), acc).otherwise(on)

        begins = F.coalesce(digits.startswith(F.get(low, i)) & F.get(low, i).rlike(r"^\d"), F.lit(False))
        return F.when(begins, F.aggregate(F.slice(low, i + 1, F.length(digits) * 2), start, step)["hit"]).otherwise(0)

    def found(low: Column, i: Column) -> Column:
        def tried(row: Column) -> Column:
            n = F.when(row["number"], reach(low, i, row["parts"][0])).otherwise(fits(low, i, row["parts"]))
            return F.struct(i.alias("at"), n.alias("n"), row["token"].alias("token"), row["number"].alias("number"), (F.element_at(row["parts"], -1) == _LETTER).alias("dot"))

        begins = lambda row: F.when(row["number"], row["parts"][0].startswith(F.get(low, i))).otherwise(row["parts"][0] == F.get(low, i))
        return F.when(is_word(F.get(low, i)), F.get(F.filter(F.transform(F.filter(table, begins), tried), lambda m: m["n"] > 0), F.lit(0)))

    def replaced(pieces: Column) -> Column:
        matches = let(F.transform(pieces, F.lower), lambda low: F.array_compact(F.transform(low, lambda _, i: found(low, i))))
        begin = F.struct(F.lit(0).alias("end"), F.slice(matches, 1, 0).alias("kept"))
        ends = lambda m: m["at"] + m["n"]
        kept = F.aggregate(matches, begin, lambda acc, m: F.when(m["at"] >= acc["end"], F.struct(ends(m).alias("end"), F.concat(acc["kept"], F.array(m)).alias("kept"))).otherwise(acc))["kept"]

        def assembled(k: Column) -> Column:
            before = lambda i: F.coalesce(ends(F.get(k, i - 1)), F.lit(0))
            after_dot = lambda i, t: F.when(F.coalesce(F.get(k, i - 1)["dot"], F.lit(False)), F.regexp_replace(t, r"^\.", "")).otherwise(t)
            rest = lambda i, end: after_dot(i, F.array_join(F.slice(pieces, before(i) + 1, F.greatest(end - before(i), F.lit(0))), ""))
            opened = lambda m, t: F.when(m["number"], F.regexp_replace(t, r"(?:\+\s*)?\(?$", "")).otherwise(t)
            parts = F.transform(k, lambda m, i: F.concat(opened(m, rest(i, m["at"])), m["token"]))
            whole = F.concat(F.array_join(parts, ""), rest(F.size(k), F.size(pieces)))
            of = lambda token: F.size(F.filter(k, lambda m: m["token"] == token))
            counts = F.create_map(*[x for t in TOKENS_OF_ENTRIES for x in (F.lit(t), of(t))])
            return F.struct(F.when(text.isNotNull(), whole).alias("text"), counts.alias("counts"))

        return let(kept, assembled)

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKENS), F.lit(0)), replaced)


def _pieces(text: Column, shape: str) -> tuple[Column, Column]:
    """The text before the first match, and (found, rest) of each match and what follows it. Control characters 1 and 2 mark the matches."""
    parts = F.split(F.regexp_replace(F.translate(text, "\x01\x02", ""), shape, "\x01$0\x02"), "\x01", -1)
    others = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    pair = lambda p: F.struct(F.substring_index(p, "\x02", 1).alias("found"), F.substring_index(p, "\x02", -1).alias("rest"))
    return parts[0], F.transform(others, pair)


def _changed(text: Column, shape: str, change) -> Column:
    """The text with `change` of each match in its place."""
    first, pieces = _pieces(text, shape)
    return F.concat(first, F.array_join(F.transform(pieces, lambda p: F.concat(change(p["found"]), p["rest"])), ""))


def aliases(raw: Column) -> Column:
    """A user's entries from JSON; malformed text and anything but a list give none, and only texts count."""
    listed = F.coalesce(F.from_json(F.when(raw.rlike(r"^\s*\["), raw), "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))
    return F.array_compact(listed)


def last_four(raw: Column) -> Column:
    """The last four digits of a taxpayer number, however it is written; null with fewer."""
    digits = F.regexp_replace(raw, r"\D", "")
    return F.when(F.length(digits) >= 4, F.substring(digits, -4, 4))


def scrubbed(text: Column) -> Column:
    """Taxpayer numbers down to their last four digits."""
    return F.regexp_replace(F.regexp_replace(text, SSN, r"***-**-$1"), EIN, r"**-***$1")


def scrubbed_name(name: Column) -> Column:
    """scrubbed, and of any other run of six digits or more only the last four."""
    return _changed(scrubbed(name), r"\d{6,}", lambda run: F.concat(F.repeat(F.lit("*"), F.length(run) - 4), F.substring(run, -4, 4)))


def has_number(text: Column) -> Column:
    """Whether a warning would show a run of six digits or a taxpayer number; such a warning must not be stored."""
    return text.rlike(r"\d{6,}") | text.rlike(SSN) | text.rlike(EIN)


def payer_name(raw: Column) -> Column:
    """A payer's name as it may be stored; null if nothing is left or it is a person's number, or nine digits and no letter."""
    bare = squeezed(raw)
    number = bare.rlike(SSN) | (bare.rlike(r"(?:\d[\s-]*){9,}") & ~bare.rlike("[A-Za-z]"))
    clean = F.rtrim(F.substring(F.trim(scrubbed(bare)), 1, PAYER_CHARS))
    return F.when((bare != "") & ~number & (clean != ""), clean)


def jurisdiction(raw: Column) -> Column:
    """A state or locality as it may be stored; null without a letter."""
    clean = squeezed(scrubbed(raw))
    return F.when(clean.rlike("[A-Za-z]"), F.rtrim(F.substring(clean, 1, JURISDICTION_CHARS)))


# An address, and groups of three digits or more that belong together, in a page for a model.
MODEL_EMAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
MODEL_NUMBER = r"(?<![\d.,])(?<!\d[ -])\d{3,}(?:[ -]\d{3,})*(?!\d|\.\d)"


def for_model(text: Column, own: Iterable[str] = ()) -> Column:
    """A page for a model: addresses and a user's entries out; of numbers of eight digits or more the last four; amounts and dates stay."""
    bare = personal(F.regexp_replace(text, MODEL_EMAIL, "[email]"), own)["text"]

    def masked(found: Column) -> Column:
        digits = F.regexp_replace(found, r"\D", "")
        return F.when(F.length(digits) < 8, found).otherwise(F.concat(F.lit("XXXX"), F.substring(digits, -4, 4)))

    return _changed(bare, MODEL_NUMBER, masked)
