"""Attention: table updates over (atom_id, sti, lti, vlti).

Every update is one pass with map-side sums; the spread is synchronous (all
outflows from the state before), so the sum of short-term importance is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
DECAY, MAX_FOCUS, MIN_FOCUS = 0.9, 100, 0.0
SPREAD_SHARE, MAX_SPREAD = 0.1, 100.0
RENT, WAGE = 1.0, 5.0
FORGET_EVERY, FORGET_STI = 10, 10.0
RATE, MOST_CONFIDENT = 0.1, 0.99
PARTS = ["sti", "lti", "vlti"]
#: Active atoms of a block.
MOST_ACTIVE = 20_000


def zeros(df: DataFrame) -> DataFrame:
    return df.select("atom_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in PARTS))


def get(bank: DataFrame, ids: DataFrame) -> DataFrame:
    """Values of atoms; what isn't tracked is zero."""
    return zeros(ids.select("atom_id").join(bank, "atom_id", "left"))


def put(bank: DataFrame, values: DataFrame) -> DataFrame:
    """Values set; a component that is null or absent stays as it was."""
    cols = [c for c in PARTS if c in values.columns]
    new = values.select("atom_id", *(F.col(c).alias(f"n_{c}") for c in cols))
    rows = bank.join(new, "atom_id", "full")
    return zeros(rows.select("atom_id", *(F.coalesce(f"n_{c}", c).alias(c) if c in cols else F.col(c) for c in PARTS)))


def stimulate(bank: DataFrame, stimuli: DataFrame) -> DataFrame:
    """Adds amounts (atom_id, amount) to sti; new atoms are tracked."""
    rows = bank.select("atom_id", *PARTS).union(stimuli.select("atom_id", F.col("amount").cast("double"), F.lit(0.0), F.lit(0.0)))
    return rows.groupBy("atom_id").agg(*(F.sum(c).alias(c) for c in PARTS))


def remove(bank: DataFrame, ids: DataFrame) -> DataFrame:
    """Atoms no longer tracked."""
    return bank.join(ids.select("atom_id"), "atom_id", "left_anti")


def size(bank: DataFrame) -> int:
    return bank.count()


def decay(bank: DataFrame, factor: float = DECAY) -> DataFrame:
    return bank.withColumn("sti", F.col("sti") * factor)


def transfer(bank: DataFrame, flows: DataFrame) -> DataFrame:
    """Moves sti along (src, dst, amount); a source must be tracked and may go below zero."""
    sound = flows.join(bank.select(F.col("atom_id").alias("src")), "src", "left_semi")
    net = sound.select(F.col("src").alias("atom_id"), (-F.col("amount")).alias("amount")).union(sound.select("dst", "amount"))
    return stimulate(bank, net)


def above(bank: DataFrame, column: str, threshold: float) -> DataFrame:
    return bank.where(F.col(column) >= threshold)


def top(bank: DataFrame, n: int, column: str = "sti") -> DataFrame:
    return bank.orderBy(F.desc(column), "atom_id").limit(n)


def focus(bank: DataFrame, least: float = MIN_FOCUS, most: int = MAX_FOCUS) -> DataFrame:
    """The attentional focus: at most `most` atoms, so it may be broadcast."""
    return top(bank.where(F.col("sti") >= least), most)


def spread(bank: DataFrame, hebbian: DataFrame, threshold: float = 0.0, share: float = SPREAD_SHARE, most: float = MAX_SPREAD, least_focus: float = MIN_FOCUS, max_focus: int = MAX_FOCUS) -> DataFrame:
    """Focused atoms give a share of their sti to Hebbian neighbours by strength; (src, dst, tv_s) links go both ways."""
    both = hebbian.select("src", "dst", "tv_s").union(hebbian.select("dst", "src", "tv_s"))
    givers = focus(bank, least_focus, max_focus).where(F.col("sti") > threshold).select(F.col("atom_id").alias("src"), F.least(F.col("sti") * share, F.lit(most)).alias("give"))
    out = both.join(F.broadcast(givers), "src")
    total = out.groupBy("src").agg(F.sum("tv_s").alias("w")).where("w >= 1e-6")
    flows = out.join(F.broadcast(total), "src").select("src", "dst", (F.col("give") * F.col("tv_s") / F.col("w")).alias("amount"))
    return transfer(bank, flows)


def rent(bank: DataFrame, rate: float = RENT, **limits) -> DataFrame:
    """Focused atoms pay, down to zero."""
    paying = F.broadcast(focus(bank, **limits).select("atom_id", F.lit(True).alias("pays")))
    rows = bank.join(paying, "atom_id", "left")
    return rows.withColumn("sti", F.when(F.col("pays"), F.greatest(F.lit(0.0), F.col("sti") - rate)).otherwise(F.col("sti"))).drop("pays")


def wages(bank: DataFrame, ids: DataFrame, payments: Column | float = 1, wage: float = WAGE) -> DataFrame:
    return stimulate(bank, ids.select("atom_id", (F.lit(wage) * payments).alias("amount")))


def forget(bank: DataFrame, threshold: float = 0.0, **limits) -> DataFrame:
    """Without atoms of low long-term importance, low sti and outside the focus."""
    held = F.broadcast(focus(bank, **limits).select("atom_id"))
    gone = bank.where((F.col("lti") < threshold) & (F.col("sti") <= FORGET_STI)).join(held, "atom_id", "left_anti").select("atom_id")
    return bank.join(gone, "atom_id", "left_anti")


def from_scores(bank: DataFrame, scores: DataFrame, scale: float = 100.0) -> DataFrame:
    """Scores (atom_id, score) set sti; the other components stay."""
    return put(bank, scores.select("atom_id", (F.col("score") * scale).alias("sti")))


def bounded_blocks(active: DataFrame, block: str | None = None) -> None:
    """Refuses a block with more than `MOST_ACTIVE` atoms."""
    n = active.groupBy(*([block] if block else [])).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (n or 0) > MOST_ACTIVE:
        raise ValueError(f"{n} active atoms in a block")


def co_active_pairs(active: DataFrame, block: str | None = None, ident: str = "atom_id") -> DataFrame:
    """Unordered pairs (src < dst) of active atoms, within a block if one is named.

    A block may have `MOST_ACTIVE` atoms; one with more is refused, as its pairs are their square.
    """
    bounded_blocks(active, block)
    a = active.select(F.col(ident).alias("src"), *([block] if block else []))
    b = active.select(F.col(ident).alias("dst"), *([block] if block else []))
    joined = a.join(b, block) if block else a.join(b, F.col("src") < F.col("dst"))
    return joined.where("src < dst")


def link_update(hebbian: DataFrame, pairs: DataFrame) -> DataFrame:
    """Strengthens existing links of co-active pairs (src, dst); makes the others at (0.5, 0.1)."""
    p = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("hit", F.lit(True))
    rows = hebbian.select("src", "dst", "tv_s", "tv_c").join(p, ["src", "dst"], "full")
    grown = F.least(F.lit(1.0), F.col("tv_s") + RATE * (1 - F.col("tv_s")))
    sure = F.least(F.lit(MOST_CONFIDENT), F.col("tv_c") + RATE * (1 - F.col("tv_c")))
    new = F.col("tv_s").isNull()
    return rows.select(
        "src",
        "dst",
        F.when(new, 0.5).when(F.col("hit"), grown).otherwise(F.col("tv_s")).alias("tv_s"),
        F.when(new, 0.1).when(F.col("hit"), sure).otherwise(F.col("tv_c")).alias("tv_c"),
    )


def cycle(bank: DataFrame, hebbian: DataFrame, number: int, forget_below: float = 0.0, least: float = MIN_FOCUS, most: int = MAX_FOCUS) -> tuple[DataFrame, DataFrame]:
    """One economic cycle: Hebbian links of the focus, spread, rent; every tenth forgets."""
    hebbian = link_update(hebbian, co_active_pairs(focus(bank, least, most)))
    bank = rent(spread(bank, hebbian, least_focus=least, max_focus=most), least=least, most=most)
    if number % FORGET_EVERY == 0:
        bank = forget(bank, forget_below, least=least, most=most)
    return bank, hebbian
