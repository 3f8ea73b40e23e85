"""The mapping table between originals and surrogates."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incognita.functions.surrogates import TYPES, members, space, with_surrogates
from incognita.sources.shared import cut, delete_tables

ATTEMPTS = 64
#: Rounds from which on addresses and networks that are still open are offered surrogates of wider spaces (surrogates.WIDER).
WIDE_FROM = {1: 3, 2: 8}


#: Originals that are still open after a round, up to which the rounds that follow are offered at once, so many of them a job.
FEW_OPEN, BLOCK = 5_000, 8
#: Members of a space, and open originals, that one task numbers.
SHARE = 1 << 16


class ExhaustedError(RuntimeError):
    """A format has no free surrogate left for some original. The message names the type only."""


def mint(wanted: DataFrame, vault: DataFrame | None = None, engagement: str = "default", attempts: int = ATTEMPTS, checkpoint=None) -> DataFrame:
    """Vault rows (original, entity_type, surrogate) for the originals (value, entity_type) that the vault lacks.

    Round k offers each open original the surrogate of salt k ("" first, then #0, #1 ...). It wins one that no
    vault row and no earlier round has, and that is no original; of several, the smallest original wins. Rounds
    after the first run over the losers alone. Addresses and networks that are open after three rounds are offered those of
    198.18.0.0/15 (131,072, or as many for a prefix length), after eight those of 240.0.0.0/4. Where a small space is nearly full, offers seldom meet
    what is free: originals that are open after all ``attempts`` take what is left of their last round's space. ``checkpoint`` cuts lineage
    between rounds (a function of a DataFrame and a name); by default rounds are written to the shared folder, and what later
    rounds don't read is deleted.
    """
    keep = checkpoint or cut
    wanted = wanted.select(F.col("value").alias("original"), "entity_type")
    if vault is not None:
        wanted = wanted.join(vault.select("original"), "original", "left_anti")
    everyone = keep(wanted.groupBy("original").agg(F.min("entity_type").alias("entity_type")), "wanted")
    originals = everyone.select(F.col("original").alias("surrogate"))
    if vault is not None:
        originals = originals.unionAll(vault.select("original"))
    taken = vault.select("surrogate") if vault is not None else None
    open_, won, k = everyone, None, 0
    while k < attempts:
        n_open = open_.count()
        if not n_open and won is not None:
            return won
        if k and n_open <= FEW_OPEN:
            rounds = range(k, min(k + BLOCK, attempts))
            fresh, open_ = _few(open_, _offered(open_, rounds, engagement, originals, taken))
            k = rounds.stop
        else:
            # Pre-aggregated before the shuffle: in a small space very many originals meet in few surrogates.
            best = _offered(open_, range(k, k + 1), engagement, originals, taken).groupBy("surrogate").agg(F.min(F.struct("original", "entity_type")).alias("w"))
            fresh = keep(best.select("w.original", "w.entity_type", "surrogate"), f"round-{k}")
            before, open_ = open_, keep(open_.join(fresh.select("original"), "original", "left_anti"), f"open-{k}")
            if before is not everyone:
                delete_tables(before)
            k += 1
        won = fresh if won is None else won.unionAll(fresh)
        taken = fresh.select("surrogate") if taken is None else taken.unionAll(fresh.select("surrogate"))
    if open_.isEmpty():
        return won
    rest = _left_over(open_, originals if taken is None else originals.unionAll(taken), _wide(attempts - 1), keep)
    won, open_ = rest if won is None else won.unionAll(rest), open_.join(rest.select("original"), "original", "left_anti")
    if open_.isEmpty():
        return won
    kinds = [r["entity_type"] for r in open_.select("entity_type").distinct().orderBy("entity_type").limit(20).collect()]
    raise ExhaustedError(f"no free surrogate after {attempts} attempts for: {', '.join(kinds)}")


def _wide(k: int) -> int:
    """The wider space that round k offers (0: none)."""
    return max((wide for wide, first in WIDE_FROM.items() if k >= first), default=0)


def _offered(open_: DataFrame, rounds: range, engagement: str, originals: DataFrame, taken: DataFrame | None) -> DataFrame:
    """original, entity_type, surrogate and round: what the rounds offer the open originals, without surrogates that are gone before."""
    kinds = [r["kind"] for r in open_.select(F.upper("entity_type").alias("kind")).distinct().collect()] if rounds.start else TYPES
    free = None
    for k in rounds:
        offered = with_surrogates(open_, engagement, "" if k == 0 else f"#{k - 1}", kinds, _wide(k)).select("original", "entity_type", "surrogate", F.lit(k).alias("round"))
        free = offered if free is None else free.unionAll(offered)
    free = free.join(originals, "surrogate", "left_anti")
    return free if taken is None else free.join(taken, "surrogate", "left_anti")


def _few(open_: DataFrame, offered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What several rounds give to FEW_OPEN originals at most, and those that stay open. So few offers are settled on the driver."""
    wins: dict[str, tuple] = {}
    used: set[str] = set()
    for r in sorted(offered.collect(), key=lambda r: (r["round"], r["original"].encode())):
        if r["original"] not in wins and r["surrogate"] not in used:
            used.add(r["surrogate"])
            wins[r["original"]] = (r["original"], r["entity_type"], r["surrogate"])
    spark = open_.sparkSession
    left = [(r["original"], r["entity_type"]) for r in open_.select("original", "entity_type").collect() if r["original"] not in wins]
    return spark.createDataFrame([*wins.values()], "original string, entity_type string, surrogate string"), spark.createDataFrame(left, "original string, entity_type string")


def _left_over(open_: DataFrame, gone: DataFrame, wide: int, keep) -> DataFrame:
    """Open originals of small spaces with the surrogates there that are not ``gone``, one each, as far as these go."""
    named = open_.withColumn("_space", space(F.col("entity_type"), F.col("original"))).where("_space IS NOT NULL")
    n_gone, out = gone.count(), None
    for name, n_open in sorted((r["_space"], r["count"]) for r in named.groupBy("_space").count().collect()):
        size, member = members(name, wide)
        # No more than n_gone of them are gone, so that enough of these are free, if enough are at all.
        listed = open_.sparkSession.range(min(size, n_gone + n_open)).select(F.col("id").alias("_id"), member(F.col("id")).alias("surrogate"))
        free = keep(listed.join(gone, "surrogate", "left_anti"), "free")
        own = _numbered(named.where(F.col("_space") == name), F.pmod(F.xxhash64("original"), F.lit(1 + n_open // SHARE)), "original")
        placed = keep(own.join(_numbered(free, F.floor(F.col("_id") / SHARE), "_id"), "_n").select("original", "entity_type", "surrogate"), "rest")
        delete_tables(free)
        out = placed if out is None else out.unionAll(placed)
    return named.select("original", "entity_type", F.lit("").alias("surrogate")).limit(0) if out is None else out


def _numbered(rows: DataFrame, share: Column, order: str) -> DataFrame:
    """rows with _n, their number from 0 on by share and order. Shares are counted first and numbered each on its own."""
    sizes = sorted(tuple(r) for r in rows.groupBy(share.alias("_share")).count().collect())
    starts = [(s, start) for (s, _), start in zip(sizes, accumulate((n for _, n in sizes), initial=0))]
    begins = rows.sparkSession.createDataFrame(starts, "_share long, _start long")
    rank = F.row_number().over(Window.partitionBy("_share").orderBy(order))
    return rows.withColumn("_share", share).withColumn("_rank", rank).join(F.broadcast(begins), "_share").withColumn("_n", F.col("_start") + F.col("_rank") - 1).drop("_share", "_start", "_rank")


def as_rows(minted: DataFrame, engagement: str) -> DataFrame:
    """Vault rows with engagement, norm and time, ready to append."""
    return minted.select(F.lit(engagement).alias("engagement"), "original", F.lower("original").alias("norm"), "entity_type", "surrogate", F.current_timestamp().alias("created_at"))


def mappings(vault: DataFrame) -> DataFrame:
    """(surrogate, original), longest surrogate first."""
    return vault.select("surrogate", "original").orderBy(F.desc(F.length("surrogate")), "surrogate")


def known_originals(vault: DataFrame) -> DataFrame:
    return vault.select("original", "entity_type").orderBy(F.desc(F.length("original")), "original")


def look_up(values: DataFrame, vault: DataFrame, column: str = "value", by: str = "original") -> DataFrame:
    """Each value with its vault row's other side, null if there is none."""
    other = "surrogate" if by == "original" else "original"
    return values.join(vault.select(F.col(by).alias(column), other), column, "left")


def stats(vault: DataFrame) -> DataFrame:
    """Rows by type, and in all (null type)."""
    return vault.rollup("entity_type").agg(F.count("*").alias("n"))


def export(vault: DataFrame) -> DataFrame:
    order = ["created_at", "original"] if "created_at" in vault.columns else ["original"]
    return vault.orderBy(*order).select("original", "entity_type", "surrogate")
