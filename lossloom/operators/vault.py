"""The failure vault: a bounded top-k table per section with a status lifecycle.

A vault holds at most ``vault_size`` rows per section, so everything after the first top-k cut works
on small data. The heavy reads are the current round (candidates) and the last few rounds (refill);
both are cut to a few rows per section before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossloom import schemas
from lossloom.functions import text as tx
from lossloom.operators.ledger import generated_only, recent_generated
from lossloom.operators.ranking import top_n
from lossloom.params import DEFAULTS, Params

_LEDGER_COLS = ["section_id", "ledger_id", "tag", "token_length", "loss", "round_id"]


def vault_status(as_of: Column | str, p: Params = DEFAULTS) -> Column:
    """Status of a vault row as seen in round ``as_of``; the order of the tests matters."""
    now = F.col(as_of) if isinstance(as_of, str) else as_of
    return (
        F.when(F.col("recycle_count") >= p.max_recycle_count, "exhausted")
        .when(~F.col("active") | tx.blank_to_null("retired_reason").isNotNull(), "retired")
        .when(now - F.col("last_recycled_round") <= p.recycle_cooldown, "cooling_down")
        .otherwise("usable")
    )


def status_rank(status: Column) -> Column:
    return (
        F.when(status == "usable", 4)
        .when(status == "cooling_down", 3)
        .when(status == "exhausted", 1)
        .otherwise(0)
    )


def keep_priority(as_of: Column | str, p: Params = DEFAULTS) -> Column:
    """Orderable struct: status rank, loss, last seen round."""
    return F.struct(
        status_rank(vault_status(as_of, p)).alias("status_rank"),
        F.coalesce(tx.finite_or_null("loss"), F.lit(float("-inf"))).alias("loss"),
        F.coalesce("last_seen_round", F.lit(-1)).alias("seen"),
    )


def recyclable(vault: DataFrame, rounds: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return (
        vault.join(rounds.select("section_id", "current_round"), "section_id")
        .where(vault_status("current_round", p) == "usable")
        .drop("current_round")
    )


def prune_low_loss(vault: DataFrame, floor: float | None = None, p: Params = DEFAULTS) -> DataFrame:
    return vault.where(tx.finite_or_null("loss") >= (p.vault_entry_floor if floor is None else floor))


def mark_vault(vault: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Retire rows that became easy, unusable or exhausted; the first reason sticks."""
    loss = tx.finite_or_null("loss")
    reason = (
        F.when(loss.isNull(), "nonfinite_loss")
        .when(loss < p.vault_refill_floor, "low_loss")
        .when((F.col("recycle_count") > 0) & (loss <= p.vault_retire_loss), "low_loss_after_recycle")
        .when(F.col("recycle_count") >= p.max_recycle_count, "max_recycle_count")
    )
    kept = tx.blank_to_null("retired_reason")
    return vault.withColumns(
        {
            "active": F.col("active") & reason.isNull(),
            "retired_reason": F.when(reason.isNull(), F.col("retired_reason")).otherwise(
                F.coalesce(kept, reason)
            ),
        }
    )


def update_vault_scores(
    vault: DataFrame, evals: DataFrame, rounds: DataFrame, p: Params = DEFAULTS, order: str = "slot_id"
) -> DataFrame:
    """Fold this round's recycled evaluations into the vault rows they came from.

    Several evaluations of one row behave as if applied in slot order: the last one sets the
    values, the best loss is the minimum, and any easy one retires the row.
    """
    loss = tx.finite_or_null("loss")
    updates = (
        evals.where((F.col("source") == "recycled") & F.col("source_ledger_id").isNotNull())
        .withColumn("loss", loss)
        .where(F.col("loss").isNotNull())
        .groupBy("section_id", F.col("source_ledger_id").alias("ledger_id"))
        .agg(
            F.max_by(F.struct("loss", "token_length", "tag"), order).alias("_last"),
            F.min("loss").alias("_best"),
        )
    )
    hit = F.col("_last").isNotNull()
    exhausted = F.col("recycle_count") >= p.max_recycle_count
    easy_once = F.col("_best") <= p.vault_retire_loss
    easy_last = F.col("_last.loss") <= p.vault_retire_loss
    reason = (
        F.when(exhausted, F.when(easy_last, "low_loss_after_recycle").otherwise("max_recycle_count"))
        .when(easy_once, "low_loss_after_recycle")
    )
    joined = vault.join(updates, ["section_id", "ledger_id"], "left").join(
        rounds.select("section_id", "current_round"), "section_id", "left"
    )
    changed = {
        "retired_reason": F.coalesce(F.when(hit, reason), F.col("retired_reason")),
        "active": F.col("active") & ~F.coalesce(hit & reason.isNotNull(), F.lit(False)),
        "loss": F.coalesce("_last.loss", "loss"),
        "last_loss": F.coalesce("_last.loss", "last_loss"),
        "token_length": F.coalesce("_last.token_length", "token_length"),
        "tag": F.coalesce("_last.tag", "tag"),
        "last_seen_round": F.when(hit, F.col("current_round")).otherwise(F.col("last_seen_round")),
        "first_seen_round": F.when(
            hit, F.coalesce("first_seen_round", "current_round")
        ).otherwise(F.col("first_seen_round")),
        "best_recycle_loss": F.least("best_recycle_loss", "_best"),
    }
    return joined.withColumns(changed).select(*schemas.columns(schemas.VAULT))


def to_vault_items(rows: DataFrame, vault: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Vault rows for ledger rows; lifecycle fields carry over from a row already in the vault.

    Columns named in ``keep`` pass through.
    """
    life = [
        "recycle_count", "last_recycled_round", "active", "retired_reason", "best_recycle_loss",
    ]
    base = rows.select(*_LEDGER_COLS, *keep)
    if vault is None:
        old = {c: F.lit(None) for c in [*life, "first_seen_round", "pos"]}
    else:
        kept = vault.select(
            "section_id", "ledger_id", *[F.col(c).alias(f"_{c}") for c in [*life, "first_seen_round", "pos"]]
        )
        base = base.join(kept, ["section_id", "ledger_id"], "left")
        old = {c: F.col(f"_{c}") for c in [*life, "first_seen_round", "pos"]}
    return base.select(
        "section_id",
        old["pos"].cast("int").alias("pos"),
        "ledger_id",
        "tag",
        "token_length",
        "loss",
        F.coalesce(old["recycle_count"], F.lit(0)).cast("int").alias("recycle_count"),
        old["last_recycled_round"].cast("int").alias("last_recycled_round"),
        F.coalesce(old["active"], F.lit(True)).alias("active"),
        old["retired_reason"].cast("string").alias("retired_reason"),
        F.coalesce(old["first_seen_round"], F.col("round_id")).cast("int").alias("first_seen_round"),
        F.col("round_id").alias("last_seen_round"),
        F.col("loss").alias("last_loss"),
        old["best_recycle_loss"].cast("double").alias("best_recycle_loss"),
        *keep,
    )


def lowest_half_avg(vault: DataFrame) -> DataFrame:
    """Mean of the lower half (at least one) of each section's vault losses."""
    losses = (
        vault.withColumn("loss", tx.finite_or_null("loss"))
        .where(F.col("loss").isNotNull())
        .groupBy("section_id")
        .agg(F.sort_array(F.collect_list("loss")).alias("l"))  # at most vault_size values
    )
    half = F.greatest(F.lit(1), F.floor(F.size("l") / 2).cast("int"))
    total = F.aggregate(F.slice("l", F.lit(1), half), F.lit(0.0), lambda a, x: a + x)
    return losses.select("section_id", (total / half).alias("lowest_half_avg"))


def entry_threshold(
    records: DataFrame, vault: DataFrame, rounds: DataFrame, p: Params = DEFAULTS
) -> DataFrame:
    """Loss a new row must reach: the lower of round average and vault low half, above a floor."""
    round_avg = (
        records.withColumn("loss", tx.finite_or_null("loss"))
        .groupBy("section_id").agg(F.avg("loss").alias("round_avg"))
    )
    return (
        rounds.select("section_id")
        .join(round_avg, "section_id", "left")
        .join(lowest_half_avg(vault), "section_id", "left")
        .withColumn(
            "minimum_entry_loss",
            F.greatest(F.lit(p.vault_entry_floor), F.least("round_avg", "lowest_half_avg")),
        )
    )


def round_candidates(
    records: DataFrame, vault: DataFrame, thresholds: DataFrame, p: Params = DEFAULTS
) -> DataFrame:
    """Rows of the current round that may enter, best first, as vault rows with ``cand_rank``.

    The vault has at most ``k`` rows, so the first ``2k`` rows of a round hold its first ``k``
    rows that are new to the vault.
    """
    k = p.vault_size
    by_loss = [F.col("loss").desc(), F.col("ledger_id")]
    top = top_n(records.select(*_LEDGER_COLS), ["section_id"], by_loss, 2 * k, "_rn")
    exempt = (F.col("_rn") <= p.vault_min_round_candidates) & (F.col("loss") >= p.vault_entry_floor)
    allowed = top.join(thresholds.select("section_id", "minimum_entry_loss"), "section_id").where(
        (F.col("loss") >= F.col("minimum_entry_loss")) | exempt
    )
    items = to_vault_items(allowed, vault, keep=("_rn",)).withColumn("_known", F.col("pos").isNotNull())
    place = F.row_number().over(Window.partitionBy("section_id", "_known").orderBy("_rn"))
    return (
        items.withColumn("cand_rank", F.when(~F.col("_known"), place))
        .where(F.col("_known") | (F.col("cand_rank") <= k))
        .drop("_rn", "_known")
    )


def admit(vault: DataFrame, candidates: DataFrame, rounds: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Merge candidates into the vault; a candidate needs strictly higher priority to displace.

    Inserting one by one and evicting the lowest each time gives the top-k of both sets, because
    candidates come in falling priority. Ties keep the incumbent; among incumbents the later
    position stays. Rows leave with their ``keep_rank``.
    """
    none = F.lit(None).cast("int")
    both = vault.select(*schemas.columns(schemas.VAULT)).withColumns(
        {"cand_rank": none, "_old": F.lit(1)}
    ).unionByName(candidates.withColumn("_old", F.lit(0)))
    # a candidate already in the vault (no rank of its own) replaces its row there
    newest = Window.partitionBy("section_id", "ledger_id").orderBy("_old")
    pool = (
        both.join(rounds.select("section_id", (F.col("current_round") + 1).alias("_next")), "section_id")
        .withColumn("_copy", F.row_number().over(newest))
        .where(F.col("_copy") == 1)
        .withColumn("_prio", keep_priority("_next", p))
    )
    order = [
        F.col("_prio").desc(), F.col("cand_rank").asc_nulls_first(), F.col("pos").desc_nulls_last(),
    ]
    return top_n(pool, ["section_id"], order, p.vault_size, "keep_rank").drop(
        "_prio", "_next", "cand_rank", "_old", "_copy"
    )


def refill(
    admitted: DataFrame, ledger: DataFrame, rounds: DataFrame, p: Params = DEFAULTS
) -> DataFrame:
    """Top up a vault with too few usable rows from recent generated rows.

    Refill rows push out as many lowest-priority rows as overflow. A row pushed out is not taken
    back within the same pass.
    """
    order = [F.col("loss").desc(), F.col("round_id").desc(), F.col("ledger_id")]
    recent = top_n(
        recent_generated(ledger, rounds, p).select(*_LEDGER_COLS), ["section_id"], order,
        p.vault_size + p.vault_min_usable, "_rn",
    )
    section, same = Window.partitionBy("section_id"), Window.partitionBy("section_id", "ledger_id")
    held = F.col("keep_rank").isNotNull()
    pool = (
        admitted.withColumn("_rn", F.lit(None).cast("int"))
        .unionByName(to_vault_items(recent, keep=("_rn",)).withColumn("keep_rank", F.lit(None).cast("int")))
        .join(rounds.select("section_id", (F.col("current_round") + 1).alias("_next")), "section_id")
    )
    usable = F.count_if(held & (vault_status("_next", p) == "usable")).over(section)
    judged = pool.withColumns(
        {"_need": F.lit(p.vault_min_usable) - usable, "_spare": ~held & ~F.max(held).over(same)}
    )
    place = F.row_number().over(section.orderBy(F.col("_spare").desc(), F.col("_rn")))
    added = judged.withColumn("_added", F.col("_spare") & (place <= F.col("_need")))
    room = F.lit(p.vault_size) - F.count_if("_added").over(section)
    return added.withColumn("_room", room).where(
        F.col("_added") | (held & (F.col("keep_rank") <= F.col("_room")))
    ).select(*schemas.columns(schemas.VAULT))


def build_vault(
    ledger: DataFrame, evals: DataFrame, vault: DataFrame, rounds: DataFrame, p: Params = DEFAULTS
) -> DataFrame:
    """The vault after round ``current_round``: update, mark, admit, refill, mark, order.

    ``vault`` is the snapshot of the round before, so running the same round again gives the same
    result. Incumbents, candidates and refill rows are each cut to a few rows per section, put
    together and shuffled once by section; every later step is a window on that partitioning.
    Admission and refill follow :func:`admit` and :func:`refill`.
    """
    k = p.vault_size
    finite = ledger.where(tx.is_finite("loss"))
    records = generated_only(finite).join(
        rounds.select("section_id", F.col("current_round").alias("round_id")),
        ["section_id", "round_id"], "left_semi",
    )
    by_loss = [F.col("loss").desc(), F.col("ledger_id")]
    candidates = top_n(records.select(*_LEDGER_COLS), ["section_id"], by_loss, 2 * k, "rank")
    recent = top_n(
        recent_generated(finite, rounds, p).select(*_LEDGER_COLS), ["section_id"],
        [F.col("loss").desc(), F.col("round_id").desc(), F.col("ledger_id")],
        k + p.vault_min_usable, "rank",
    )
    incumbents = mark_vault(
        update_vault_scores(vault.where(tx.is_finite("loss")), evals, rounds, p), p
    )
    averages = records.groupBy("section_id").agg(F.avg("loss").alias("round_avg"))
    scalars = rounds.select(
        "section_id", "current_round", (F.col("current_round") + 1).alias("_next")
    ).join(averages, "section_id", "left")
    pool = (
        incumbents.withColumns({"role": F.lit(0), "rank": F.lit(None).cast("int")})
        .unionByName(to_vault_items(candidates, keep=("rank",)).withColumn("role", F.lit(1)))
        .unionByName(to_vault_items(recent, keep=("rank",)).withColumn("role", F.lit(2)))
        .join(scalars, "section_id")
    )

    section, same = Window.partitionBy("section_id"), Window.partitionBy("section_id", "ledger_id")
    c = F.col
    old = c("role") == 0
    half = F.greatest(F.lit(1), F.floor(F.count_if(old).over(section) / 2))
    rows = pool.withColumn(
        "_low", F.row_number().over(Window.partitionBy("section_id", "role").orderBy("loss"))
    ).withColumn("_half", half)
    threshold = F.greatest(
        F.lit(p.vault_entry_floor),
        F.least("round_avg", F.avg(F.when(old & (c("_low") <= c("_half")), c("loss"))).over(section)),
    )
    exempt = (c("rank") <= p.vault_min_round_candidates) & (c("loss") >= p.vault_entry_floor)
    rows = rows.withColumn("_threshold", threshold).withColumn(
        "_allowed", (c("role") == 1) & ((c("loss") >= c("_threshold")) | exempt)
    )
    # a candidate that is already in the vault refreshes its row there
    rows = rows.withColumns(
        {
            "_known": F.max(old).over(same),
            "_fresh": F.max(F.when(c("_allowed"), F.struct("loss", "token_length", "tag"))).over(same),
        }
    )
    renew = old & c("_fresh").isNotNull()
    rows = rows.withColumns(
        {
            "loss": F.when(renew, c("_fresh.loss")).otherwise(c("loss")),
            "last_loss": F.when(renew, c("_fresh.loss")).otherwise(c("last_loss")),
            "token_length": F.when(renew, c("_fresh.token_length")).otherwise(c("token_length")),
            "tag": F.when(renew, c("_fresh.tag")).otherwise(c("tag")),
            "last_seen_round": F.when(renew, c("current_round")).otherwise(c("last_seen_round")),
        }
    ).withColumn("_runs", old | (c("_allowed") & ~c("_known")))
    by_priority = section.orderBy(
        c("_runs").desc(), keep_priority("_next", p).desc(), c("role"), c("rank"), c("pos").desc_nulls_last()
    )
    rows = rows.withColumn("_keep_rank", F.row_number().over(by_priority)).withColumn(
        "_admitted", c("_runs") & (c("_keep_rank") <= k)
    )
    usable = F.count_if(c("_admitted") & (vault_status("_next", p) == "usable")).over(section)
    rows = rows.withColumns(
        {
            "_need": F.greatest(F.lit(0), F.lit(p.vault_min_usable) - usable),
            "_spare": (c("role") == 2) & ~F.max("_admitted").over(same),
        }
    )
    by_refill = section.orderBy(c("_spare").desc(), c("rank"))
    rows = rows.withColumn(
        "_added", c("_spare") & (F.row_number().over(by_refill) <= c("_need"))
    ).withColumn("_room", F.lit(k) - F.count_if("_added").over(section))
    kept = rows.where(c("_added") | (c("_admitted") & (c("_keep_rank") <= c("_room"))))
    final = mark_vault(kept, p).withColumn("_status", status_rank(vault_status("_next", p)))
    order = section.orderBy(c("_status").desc(), c("loss").desc(), c("ledger_id"))
    return final.withColumn("pos", F.row_number().over(order)).select(*schemas.columns(schemas.VAULT))


def vault_analytics(vault: DataFrame, rounds: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Status counts, averages and the most frequent tag; ``current_round`` is the reading round."""
    read = vault.join(rounds.select("section_id", "current_round"), "section_id").withColumn(
        "_status", vault_status("current_round", p)
    )
    modal = (
        vault.groupBy("section_id", "tag")
        .agg(F.count("*").alias("_n"), F.min("pos").alias("_first"))
        .groupBy("section_id")
        .agg(F.max_by("tag", F.struct("_n", -F.col("_first"))).alias("most_problematic_category"))
    )
    n = lambda s: F.count_if(F.col("_status") == s)
    return (
        read.groupBy("section_id")
        .agg(
            F.count("*").alias("total_failures_tracked"),
            (n("usable") + n("cooling_down")).alias("active_failures"),
            n("usable").alias("usable_failures"),
            n("cooling_down").alias("cooling_down_failures"),
            n("exhausted").alias("exhausted_failures"),
            n("retired").alias("retired_failures"),
            F.coalesce(F.avg(tx.finite_or_null("loss")), F.lit(0.0)).alias("avg_loss"),
            F.avg("token_length").alias("avg_token_length"),
        )
        .join(modal, "section_id")
    )


def vault_avg_loss(vault: DataFrame) -> DataFrame:
    return vault.groupBy("section_id").agg(F.avg("loss").alias("avg_loss"))


def mark_recycled(vault: DataFrame, recipe: DataFrame, rounds: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Count a recycle for every vault row the recipe uses; the last allowed one retires it."""
    used = recipe.where(F.col("command") == "recycle").select(
        "section_id", F.col("failure_ledger_id").alias("ledger_id"), F.lit(1).alias("_used")
    ).distinct()
    hit = F.col("_used").isNotNull()
    count = F.col("recycle_count") + F.coalesce("_used", F.lit(0))
    spent = count >= p.max_recycle_count
    kept = tx.blank_to_null("retired_reason")
    joined = vault.join(used, ["section_id", "ledger_id"], "left").join(
        rounds.select("section_id", "current_round"), "section_id"
    )
    return joined.withColumns(
        {
            "recycle_count": count,
            "last_recycled_round": F.when(hit, F.col("current_round")).otherwise(F.col("last_recycled_round")),
            "active": F.col("active") & ~spent,
            "retired_reason": F.when(hit & spent, F.lit("max_recycle_count"))
            .when(spent, F.coalesce(kept, F.lit("max_recycle_count")))
            .otherwise(F.col("retired_reason")),
        }
    ).select(*schemas.columns(schemas.VAULT))
