"""Accounts and statements: lists with names, resolving, moving a statement, what came before, data checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.functions.names import account_display
from hearthledger.operators.ledger import hashed

ACCOUNT = ["user_id", "issuer_id", "mask", "account_type"]


def with_keys(txns: DataFrame, categories: DataFrame, subcategories: DataFrame) -> DataFrame:
    """txns with the keys of category and subcategory; null where unset."""
    cats = categories.select(F.col("id").alias("category_id"), F.col("key").alias("category"))
    subs = subcategories.select(F.col("id").alias("subcategory_id"), F.col("key").alias("subcategory"))
    return txns.join(cats, "category_id", "left").join(subs, "subcategory_id", "left")


def filtered(txns: DataFrame, categories: DataFrame, subcategories: DataFrame, category: str | None = None, subcategory: str | None = None, statement_id: int | None = None, unclassified: bool = False, user_id: int | None = None) -> DataFrame:
    """txns of a category and subcategory (by key), a statement, or without a category; what belongs to another user looks missing."""
    out = txns
    if user_id is not None:
        out = out.where(F.col("user_id") == user_id)
    if statement_id is not None:
        out = out.where(F.col("statement_id") == statement_id)
    if unclassified:
        out = out.where("category_id is null")
    if category is not None:
        out = out.join(categories.where(F.col("key") == category).select(F.col("id").alias("category_id")), "category_id", "left_semi")
    if subcategory is not None:
        out = out.join(subcategories.where(F.col("key") == subcategory).select(F.col("id").alias("subcategory_id")), "subcategory_id", "left_semi")
    return out


def statements_of(statements: DataFrame, accounts: DataFrame, user_id: int) -> DataFrame:
    """A user's statements, the latest first."""
    own = accounts.where(F.col("user_id") == user_id).select(F.col("id").alias("account_id"))
    return statements.join(own, "account_id", "left_semi").orderBy(F.desc("id"))


def resolved(parsed: DataFrame, accounts: DataFrame, issuers: DataFrame) -> DataFrame:
    """parsed (user_id, issuer_id, mask, account_type, currency) with the account's id, null where it is new, and its name."""
    rows = parsed.withColumn("mask", F.coalesce("mask", F.lit("")))
    known = accounts.groupBy(*ACCOUNT).agg(F.min("id").alias("account_id"))
    named = rows.join(known, ACCOUNT, "left").join(issuers.select(F.col("id").alias("issuer_id"), "name"), "issuer_id", "left")
    return named.withColumn("display_name", account_display(F.col("name"), F.col("account_type"), F.col("mask"))).drop("name")


def new_accounts(resolved_rows: DataFrame) -> DataFrame:
    """Accounts to add: one for each user, issuer, mask and type that none has."""
    return resolved_rows.where("account_id is null").groupBy(*ACCOUNT).agg(F.min("display_name").alias("display_name"), F.min("currency").alias("currency"))


def before(statements: DataFrame) -> DataFrame:
    """statements with the id and score of the one ingested before, of the same account and parsed."""
    w = Window.partitionBy("account_id", F.col("status") == "parsed").orderBy("ingested_at", "id")
    parsed = F.col("status") == "parsed"
    return statements.withColumns({"previous_id": F.when(parsed, F.lag("id").over(w)), "previous_score": F.when(parsed, F.lag("detect_score").over(w))})


def moved(txns: DataFrame, statement_id: int, user_id: int, account_id: int) -> DataFrame:
    """txns after a statement goes to another account: its rows are numbered and hashed anew, and those that the account has already go."""
    here = F.col("statement_id") == statement_id
    mine = txns.where(here).withColumns({"account_id": F.lit(account_id).cast("bigint"), "user_id": F.lit(user_id).cast("bigint"), "ordinal": F.col("id")})
    again = hashed(mine.drop("occurrence_index", "dedupe_hash"))
    others = txns.where(~here)
    taken = others.where(F.col("account_id") == account_id).select("account_id", "dedupe_hash")
    return others.unionByName(again.join(taken, ["account_id", "dedupe_hash"], "left_anti").select(*txns.columns))


def reparsed(txns: DataFrame, statement_id: int, parsed: DataFrame) -> DataFrame:
    """txns after a statement is read again: its own rows go, and of the new ones those that the account does not have come."""
    others = txns.where(F.col("statement_id") != statement_id)
    fresh = hashed(parsed).join(others.select("account_id", "dedupe_hash"), ["account_id", "dedupe_hash"], "left_anti")
    return others.unionByName(fresh.select(*txns.columns))


def confirmed(statements: DataFrame, statement_id: int) -> DataFrame:
    return statements.withColumn("status", F.when(F.col("id") == statement_id, "parsed").otherwise(F.col("status")))


def other_currencies(accounts: DataFrame, currency: str) -> DataFrame:
    return accounts.where((F.col("currency") != currency) & (F.col("currency") != "")).select("currency").distinct().orderBy("currency")


def page_total(txns: DataFrame) -> DataFrame:
    """One row: how many rows a list has over all its pages."""
    return txns.agg(F.count("*").alias("total"))


def versions(specs: DataFrame, issuer_id: int, account_type: str) -> DataFrame:
    """The approved layout of the highest version for an issuer; one for any account type counts too."""
    fits = specs.where(F.col("approved") & (F.col("issuer_id") == issuer_id) & (F.col("account_type").isNull() | (F.col("account_type") == account_type)))
    return fits.orderBy(F.desc("version"), F.desc("id")).limit(1)


def violations(txns: DataFrame, income: DataFrame, taxes: DataFrame, balances: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(check, rows): how many rows break each rule of the tables."""

    def broken(rows: DataFrame, check: str, bad: Column) -> DataFrame:
        return rows.where(bad).agg(F.count("*").alias("rows")).select(F.lit(check).alias("check"), "rows")

    signed = F.col("category").isin("short_term_capital_gain", "long_term_capital_gain")
    checks = [
        broken(txns, "kind", ~F.col("kind").isin(list(kinds))), broken(txns, "category pair", F.col("category_id").isNull() != F.col("subcategory_id").isNull()),
        broken(income, "income sign", (F.col("amount_minor") < 0) & ~signed), broken(taxes, "tax sign", F.col("amount_minor") < 0),
        broken(balances, "balance", (F.col("balance_minor") < 0) | ~F.col("month").between(1, 12) | ~F.col("year").between(1900, 2200) | (F.trim("account_name") == "")),
    ]
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out
