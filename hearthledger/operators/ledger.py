"""Ledger: occurrence numbers, hashes, idempotent inserts, reconciliation, transfer pairing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ["account_id", "posted_date", "amount_minor", "description_raw"]


def hashed(raw: DataFrame) -> DataFrame:
    """occurrence_index within a statement's equal rows, in statement order, and dedupe_hash."""
    w = Window.partitionBy("statement_id", *IDENTITY).orderBy("ordinal")
    out = raw.withColumn("occurrence_index", (F.row_number().over(w) - 1).cast("int"))
    parts = [F.col(c).cast("string") for c in (*IDENTITY, "occurrence_index")]
    return out.withColumn("dedupe_hash", F.sha2(F.concat_ws("|", *parts), 256))


def new_rows(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """What an idempotent insert would add: the first of equal incoming rows that the table does not have."""
    key = ["account_id", "dedupe_hash"]
    first = incoming.groupBy(*key).agg(F.min_by(F.struct(*[c for c in incoming.columns if c not in key]), F.struct("statement_id", "ordinal")).alias("_r"))
    return first.select(*key, "_r.*").join(existing.select(*key), key, "left_anti")


def reconciled(statements: DataFrame, txns: DataFrame) -> DataFrame:
    """delta_minor of each statement: the sum of its rows less what its balances, else its stated total, ask for."""
    sums = txns.groupBy("statement_id").agg(F.sum("amount_minor").alias("sum_minor"), F.count("*").alias("txn_count"))
    moved = F.col("closing_balance_minor") - F.col("opening_balance_minor")
    expected = F.coalesce(F.when(F.col("account_type") == "credit", moved).otherwise(-moved), F.col("stated_total_minor"))
    out = statements.join(sums, "statement_id", "left").withColumn("sum_minor", F.coalesce("sum_minor", F.lit(0)))
    return out.withColumn("delta_minor", F.col("sum_minor") - expected)


def section_gaps(printed: DataFrame, txns: DataFrame) -> DataFrame:
    """Printed section totals against the sums of their rows; a section without rows sums to 0."""
    sums = txns.groupBy("statement_id", "section").agg(F.sum("amount_minor").alias("sum_minor"))
    out = printed.join(sums, ["statement_id", "section"], "left")
    return out.withColumn("delta_minor", F.coalesce("sum_minor", F.lit(0)) - F.col("printed_minor"))


def drifted(statements: DataFrame) -> DataFrame:
    """Whether a statement's layout has drifted: warnings, a mismatch, or a score 0.15 off the previous one."""
    before = F.lag("detect_score").over(Window.partitionBy("account_id").orderBy("ingested_at", "statement_id"))
    off = F.abs(F.col("detect_score") - before) >= 0.15
    return statements.withColumn("drift", (F.size("warnings") > 0) | F.coalesce(F.col("delta_minor") != 0, F.lit(False)) | F.coalesce(off, F.lit(False)))


_MATCHES = "array<struct<t: int, p: int, t0: bigint, p0: bigint, n: bigint>>"


def paired(rows: DataFrame, days: int = 5) -> DataFrame:
    """(transfer_id, payment_id): transfers with payments of the same user, opposite amount, at most `days` apart.

    A mutual choice: each takes the nearest, then the earliest, then the smallest id; chosen ones leave, and the
    rest chooses again until no candidate is left. The outcome is worked out without rounds: rows of one user, amount
    and day differ by id only and are chosen in its order, so how many of a day go with how many of another follows
    from the counts of the days (`matched`), and then they pair rank by rank. Only those counts meet by user and
    amount, a row for each day; no candidate pairs are formed. Repeated rows of one id count once, and a row
    without id, user, amount or date has no partner.
    """
    key = ["user_id", "amount", "day"]

    def side(which: str, amount: Column, name: str) -> DataFrame:
        day = F.datediff("posted_date", F.lit("1970-01-01").cast("date"))
        out = rows.where(which).select(F.col("id").alias(name), "user_id", amount.alias("amount"), day.alias("day"))
        return out.dropna().distinct().withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(name)) - 1)

    left = side("kind = 'transfer' and account_type <> 'credit'", F.col("amount_minor"), "transfer_id")
    right = side("kind = 'payment' and account_type = 'credit'", -F.col("amount_minor"), "payment_id")
    none = F.lit(0).cast("long")
    counts = left.select(*key, F.lit(1).cast("long").alias("_t"), none.alias("_p")).unionByName(right.select(*key, none.alias("_t"), F.lit(1).cast("long").alias("_p")))
    counts = counts.groupBy(*key).agg(F.sum("_t").alias("_t"), F.sum("_p").alias("_p"))
    by_day = counts.groupBy("user_id", "amount").agg(F.sort_array(F.collect_list(F.struct("day", "_t", "_p"))).alias("_days"), F.sum("_t").alias("_t"), F.sum("_p").alias("_p"))

    def matched(by_day: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """(day of transfers, day of payments, ranks from which they pair, how many) of one user and amount, given (day, transfers, payments).

        Nearer days come first. Of days equally far apart each row prefers the one before its own, so days are taken in
        order: what is left of a day after the day before it goes with the day after it.
        """
        left = {d: [t, p] for d, t, p in by_day}
        used = {d: [0, 0] for d in left}
        out = []
        for gap in range(days + 1):
            for d in sorted(left):
                for t, p in [(d, d)] if not gap else [(d, d + gap), (d + gap, d)]:
                    if t in left and p in left and (n := min(left[t][0], left[p][1])) > 0:
                        out.append((t, p, used[t][0], used[p][1], n))
                        left[t][0] -= n
                        left[p][1] -= n
                        used[t][0] += n
                        used[p][1] += n
        return out

    @F.pandas_udf(_MATCHES)
    def matches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([[dict(zip(("t", "p", "t0", "p0", "n"), m)) for m in matched([(d["day"], d["_t"], d["_p"]) for d in some])] for some in part], dtype=object)

    found = by_day.where("_t > 0 and _p > 0").select("user_id", "amount", F.explode(matches("_days")).alias("_m")).select("user_id", "amount", "_m.*")
    ranks = found.select("*", F.explode(F.sequence(none, F.col("n") - 1)).alias("_k"))
    ranks = ranks.select("user_id", "amount", F.col("t").alias("day"), (F.col("t0") + F.col("_k")).alias("_rank"), "p", (F.col("p0") + F.col("_k")).alias("_nth"))
    chosen = ranks.join(left, [*key, "_rank"]).select("transfer_id", "user_id", "amount", F.col("p").alias("day"), F.col("_nth").alias("_rank"))
    return chosen.join(right, [*key, "_rank"]).select("transfer_id", "payment_id")
