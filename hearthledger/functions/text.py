r"""Text of statements: search, redaction, merchant keys, kinds, money.

All are column expressions. `(?U)` makes Java's \w and \b know Unicode.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthledger.functions.columns import let

# Prefixes that processors put before a merchant's name.
PREFIXES = (
    "CHECKCARD", "DEBIT CARD PURCHASE", "PAYPAL *", "POS DEBIT", "PURCHASE AUTHORIZED ON", "RECURRING PAYMENT", "SP *", "SQ *", "TST*",
)
# Shapes of what must not leave the ledger, in the order of redaction.
REDACTIONS = (
    ("[EMAIL]", r"(?U)[\w.+-]+@[\w-]+\.\w+"),
    ("[AMOUNT]", r"\$\s?\d[\d,]*(?:\.\d+)?"),
    ("[CARD]", r"\d{12,19}"),
    ("[NUM]", r"\d{6,}"),
    ("[PHONE]", r"\+?\d[\d\-\(\) ]{8,}\d"),
)
# Fixed value: a reference at the end of a description.
TRAILING_REFERENCE = r"(?i)(?:^|\s)(?:REF#|AUTH|TRACE|ID:|INV)\S*\s*$"


def ascii_lower(col: Column) -> Column:
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def contains_literal(col: str, needle: str) -> Column:
    """Substring search that folds A-Z only and takes %, _ and quotes literally."""
    return F.contains(ascii_lower(F.col(col)), F.lit(needle.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))))


def squeezed(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def redacted(col: Column) -> Column:
    for token, shape in REDACTIONS:
        col = F.regexp_replace(col, shape, token)
    return F.rtrim(F.regexp_replace(col, TRAILING_REFERENCE, ""))


def redaction_counts(col: Column) -> Column:
    """How often each kind is replaced, in a map; each is counted in what the ones before left."""
    pairs: list[Column] = []
    for token, shape in REDACTIONS:
        pairs += [F.lit(token.strip("[]").lower()), F.regexp_count(col, F.lit(shape))]
        col = F.regexp_replace(col, shape, token)
    return F.create_map(*pairs)


def without_prefix(col: Column) -> Column:
    longest = sorted(PREFIXES, key=len, reverse=True)
    return F.trim(F.regexp_replace(col, r"(?i)^\s*(?:" + "|".join(p.replace("*", r"\*") for p in longest) + ")", ""))


def description(raw: Column) -> Column:
    """A raw description as it may be shown: control characters out, redacted, without prefix."""
    spaced = squeezed(F.regexp_replace(F.regexp_replace(raw, r"[\s]", " "), r"[\p{Cc}\p{Cf}]", ""))
    return squeezed(without_prefix(redacted(spaced)))


def merchant_key(clean: Column) -> Column:
    """A description's key: no store numbers, tokens or punctuation; what gets too short stays as it was."""
    lower = F.lower(clean)
    key = F.regexp_replace(lower, r"#\s*\d+", " ")
    key = squeezed(F.regexp_replace(key, r"(?U)\b(?:store|no\.?)\s*#?\d+", " "))
    key = F.when(key.rlike(r"(?U)^(?=.*[^\d\s]).*\S \d+$") & key.rlike(r"(?:^|\s)\S*\D\S*\s"), F.regexp_replace(key, r" \d+$", "")).otherwise(key)
    plain = lambda c: squeezed(F.regexp_replace(c, r"(?U)[^\w\s]", " "))
    short = plain(squeezed(F.regexp_replace(key, r"\[(?:email|amount|card|num|phone|name|redacted)\]", " ")))
    return F.when(F.length(F.replace(short, F.lit(" "), F.lit(""))) < 3, plain(lower)).otherwise(short)


# Words that decide the kind of a row.
PAYS = r"PAYMENT|AUTOPAY|PMT"
PAYS_CARD = r"AUTOPAY|CRD\s*PMT|CREDIT\s*CARD\s*PAYMENT|EPAY|PAYMENT|PMT"
#: How far an issuer's name may begin from the word of a payment, in characters, on either side.
NEAR_PAYMENT = 20


def kind(hint: Column, clean: Column, amount: Column, account_type: Column, issuer_terms: Sequence[str] = ()) -> Column:
    """The kind of a row: the hint if it has one, else by words, else by sign.

    On a checking or savings account a payment of a card is a transfer, before anything else is asked: the card's own statement has
    the spending.
    """
    says = lambda words: clean.rlike(rf"(?iU)\b(?:{words})\b")
    to_card = says(PAYS_CARD)
    if terms := [t.strip() for t in issuer_terms if t.strip()]:
        names = "|".join(f"\\Q{t}\\E" for t in terms)
        word, gap = r"\b(?:PAYMENT|PMT)\b", f".{{0,{NEAR_PAYMENT}}}"
        to_card = to_card | clean.rlike(f"(?iUs)(?=(?:{names})){gap}{word}") | clean.rlike(f"(?iUs)(?={word}){gap}(?:{names})")
    return (
        F.when(hint == "payment_or_refund", F.when(says(PAYS), "payment").otherwise("refund"))
        .when(hint.isNotNull(), hint)
        .when(account_type.isin("checking", "savings") & to_card, "transfer")
        .when(says("INTEREST"), "interest")
        .when(says("FEE"), "fee")
        .when(says("TRANSFER"), "transfer")
        .when(says(PAYS), "payment")
        .otherwise(F.when(amount >= 0, "purchase").otherwise("refund"))
    )


def is_spend(kind_col: Column) -> Column:
    return kind_col.isin("purchase", "fee", "interest")


#: An amount as printed: a sign, `(` or `$` before it, `)`, `-` or CR after it; thousands in threes or not at all, two decimals at most.
MONEY = r"(?i)^\s*(\(?)\s*(-?)\s*\$?\s*(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d{1,2}))?\s*(\)?)\s*(-?)\s*((?:CR)?)\s*$"


#: An amount as it is mostly printed, read without looking at its parts.
PLAIN_MONEY = r"^-?\d+\.\d\d$"


def money_minor(text: Column) -> Column:
    """`1,234.56`, `-x`, `(x)`, `x-`, `x CR`, `$x` to minor units; null for anything else."""

    def read(t: Column) -> Column:
        part = lambda k: F.regexp_extract(t, MONEY, k)
        value = F.concat(F.replace(part(3), F.lit(","), F.lit("")), F.rpad(part(4), 2, "0")).try_cast("bigint")
        negative = (part(1) != "") | (part(2) != "") | (part(6) != "") | (part(7) != "")
        balanced = part(1) == F.replace(part(5), F.lit(")"), F.lit("("))
        return F.when(t.rlike(PLAIN_MONEY), F.replace(t, F.lit("."), F.lit("")).try_cast("bigint")).when(t.rlike(MONEY) & balanced, F.when(negative, -value).otherwise(value))

    return let(text, read)


def money_magnitude(text: Column) -> Column:
    """money_minor without its sign: forms print withheld tax with or without one."""
    return F.abs(money_minor(text))


def decimal_minor(text: Column) -> Column:
    """A decimal of a model's answer to minor units: `$`, commas, blanks and outer parentheses do not count; null for no finite number."""
    bare = F.regexp_replace(F.trim(text), r"[$,\s()]", "")
    return F.round(F.when(bare.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), bare).try_cast("decimal(30,6)") * 100, 0).try_cast("bigint")


def money_text(minor: Column) -> Column:
    """`-$1,234.56`."""
    size = F.abs(minor)
    cents = size % 100
    return F.concat(F.when(minor < 0, "-").otherwise(""), F.lit("$"), F.format_number(((size - cents) / 100).cast("bigint"), 0), F.lit("."), F.lpad(cents.cast("string"), 2, "0"))


def money_plain(minor: Column) -> Column:
    """`-1234.56`."""
    size = F.abs(minor)
    cents = size % 100
    return F.concat(F.when(minor < 0, "-").otherwise(""), ((size - cents) / 100).cast("bigint").cast("string"), F.lit("."), F.lpad(cents.cast("string"), 2, "0"))
