"""Mixing sources to target weights by entropy balancing.

The mix takes every document at a rate ``r`` between 0 and ``cap``.  Among all rates
that meet each group's token constraint ``sum(size * r) = target`` it wants those of
least relative entropy to "take every document once".  The solution is an
exponential tilt of the documents, ``r = min(cap, exp(lambda * size))``, with one
multiplier ``lambda`` per group: the root of the gradient of the convex dual,
``sum(size * min(cap, exp(lambda * size))) - target``.

Newton steps find the multipliers.  Every step is one Spark aggregation over the
corpus's ``(group, size, count)`` table, for all groups at once; the multipliers
are a Spark table too, written after each step.  A step that leaves the bracket
of the root is replaced by the bracket's geometric middle.  The sums are taken in
fixed point, so they do not depend on the order of rows and reruns agree.

Rates are then rounded into copies so that each group's tokens come out near the
target.  A document is heavy if it holds at least 1 / ``HEAVY`` of its group's
tokens, so a group has at most ``HEAVY`` heavy (size, id) pairs, however large
it is.  These are taken from the largest down, each rounded with the error so far
carried over.  The light rest absorbs what remains: its rates are shifted by the
heavy error, and each document gets floor(rate) or one more copy by a hash of its
id.  The light error has a standard deviation below mass / (2 sqrt(HEAVY)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostscope.llm import common as C

HEAVY = 4_096
STEPS = 200  # each halves the logarithm of the bracket at least, so far fewer are taken
TOLERANCE = 1e-10
FIXED = float(1 << 40)  # fixed-point unit of the sums


def cyclic_weights(masses: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Add ``weight`` to ``(grp, mass)``: groups by code point, null last, take the
    weights in turn.  The window runs over one row per group."""
    order = Window.orderBy(F.col("grp").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    return masses.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))


def capped_targets(masses: DataFrame, cap: float = 3.0) -> DataFrame:
    """Add ``target`` to ``(grp, mass, weight)``: the total mass shared by weight,
    a group's target at most ``cap`` times its mass, the excess shared among the
    others until none is above.  Works on one row per group."""
    ratio = F.when(F.col("weight") > 0, F.col("mass") * cap / F.col("weight"))
    by_ratio = Window.orderBy(F.col("ratio").asc_nulls_last(), F.col("grp").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    levels = masses.withColumn("ratio", ratio).select(
        "*",
        # the level at which all groups before this one are full
        ((F.sum("mass").over(everyone) - F.coalesce(F.sum(F.col("mass") * cap).over(before), F.lit(0.0)))
         / F.nullif(F.sum("weight").over(after), F.lit(0.0))).alias("level"),
        F.row_number().over(by_ratio).alias("turn"),
    )
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("turn", "level"))).over(everyone)
    level = first["level"]
    return levels.select(
        "grp", "mass", "weight",
        F.when((F.col("weight") > 0) & (F.col("mass") > 0),
               F.when(level.isNull() | (F.col("ratio") <= level), F.col("mass") * cap)
               .otherwise(F.col("weight") * level))
        .otherwise(F.lit(0.0)).alias("target"),
    )


def tilt(lam: Column, size: Column, cap: float) -> Column:
    """The rate of a document; 0 without words."""
    return F.when(size > 0, F.least(F.exp(lam * size), F.lit(float(cap)))).otherwise(F.lit(0.0))


def _fixed_sum(tokens: Column, factor: Column) -> Column:
    """sum(tokens * factor) for whole tokens and factors from 0 to about 3, exact in
    units of 1 / ``FIXED`` and so the same in every order."""
    unit = F.floor(factor * FIXED).cast("decimal(14,0)")
    return F.sum(tokens.cast("decimal(20,0)") * unit).cast("double") / FIXED


def solve_dual(counts: DataFrame, targets: DataFrame, cap: float = 3.0) -> DataFrame:
    """``grp, mass, target, lam`` for every row of ``targets(grp, mass, target)``.

    ``counts(grp, size, n)`` says how many documents of a group have a size.
    ``lam`` is minus infinity where nothing is wanted or there is nothing, infinity
    where the target is ``cap`` times the mass or more.  Between them the root has
    the form ``log(target / mass) / v`` with ``v`` between the group's least and
    largest size; ``v`` is what the steps refine, from the first Newton step at
    ``lam = 0`` on.
    """
    counts = counts.where(F.col("size") > 0)
    tokens = (F.col("n") * F.col("size")).cast("decimal(20,0)")
    spread = counts.groupBy("grp").agg(
        F.min("size").cast("double").alias("lo"), F.max("size").cast("double").alias("hi"),
        F.max("size").cast("double").alias("largest"),
        F.sum(tokens * F.col("size").cast("decimal(14,0)")).cast("double").alias("squares"))
    t = targets.select(F.col("grp").alias("g"), F.col("mass").cast("double").alias("mass"),
                       F.col("target").cast("double").alias("target"))
    inner = (F.col("mass") > 0) & (F.col("target") > 0) & (F.col("target") < F.col("mass") * float(cap))
    log_ratio = F.when(inner, F.log(F.col("target") / F.col("mass")))
    state = C.stored(
        t.join(spread, F.col("g").eqNullSafe(F.col("grp")), "left").select(
            "g", "mass", "target", log_ratio.alias("log_ratio"), "largest", "lo", "hi",
            F.when(inner, F.greatest("lo", F.least("hi", F.col("squares") / F.col("mass")))).alias("v"),
            (~inner | (log_ratio == 0)).alias("done")), "dual")
    for _ in range(STEPS):
        if state.where(~F.col("done")).isEmpty():
            break
        state = C.stored(_newton_step(counts, state, cap), "dual")
    lam = (
        F.when((F.col("mass") > 0) & (F.col("target") >= F.col("mass") * float(cap)), F.lit(float("inf")))
        .when(F.col("v").isNull(), F.lit(float("-inf")))
        .otherwise(F.col("log_ratio") / F.col("v")))
    return state.select(F.col("g").alias("grp"), "mass", "target", lam.alias("lam"))


def _newton_step(counts: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """One step for every group that is not done, on log(sum) = log(target)."""
    lam, size = F.col("log_ratio") / F.col("v"), F.col("size")
    rate, tokens = F.exp(lam * size), F.col("n") * size
    open_groups = state.where(~F.col("done"))
    sums = counts.join(open_groups, F.col("grp").eqNullSafe(F.col("g"))).groupBy("g").agg(
        _fixed_sum(tokens, F.least(rate, F.lit(float(cap)))).alias("f"),
        (_fixed_sum(tokens, F.when(rate < float(cap), rate * size / F.col("largest")).otherwise(F.lit(0.0)))
         * F.first("largest")).alias("slope"),
    ).select(F.col("g").alias("sg"), "f", "slope")
    moved = lam + (F.log("target") - F.log("f")) * F.col("f") / F.nullif(F.col("slope"), F.lit(0.0))
    further = (F.col("f") < F.col("target")) == (F.col("log_ratio") > 0)  # lam must move away from 0
    lo, hi = F.when(further, F.col("lo")).otherwise(F.col("v")), F.when(further, F.col("v")).otherwise(F.col("hi"))
    out = state.join(sums, F.col("g").eqNullSafe(F.col("sg")), "left").select(
        "g", "mass", "target", "log_ratio", "largest", "v", "done", "f", lo.alias("new_lo"), hi.alias("new_hi"),
        (F.col("log_ratio") / F.nullif(moved, F.lit(0.0))).alias("newton"), "lo", "hi")
    near = F.abs(F.col("f") - F.col("target")) <= F.col("target") * TOLERANCE
    narrow = F.col("new_hi") - F.col("new_lo") <= F.col("new_hi") * 1e-15
    stay = F.col("done") | near | narrow
    inside = (F.col("newton") > F.col("new_lo")) & (F.col("newton") < F.col("new_hi"))
    return out.select(
        "g", "mass", "target", "log_ratio", "largest",
        F.when(F.col("done"), F.col("lo")).otherwise(F.col("new_lo")).alias("lo"),
        F.when(F.col("done"), F.col("hi")).otherwise(F.col("new_hi")).alias("hi"),
        F.when(stay, F.col("v")).when(inside, F.col("newton"))
        .otherwise(F.sqrt(F.col("new_lo") * F.col("new_hi"))).alias("v"),
        stay.alias("done"))


def entropy_balance(
    rows: DataFrame, targets: DataFrame, cap: int = 3, heavy: int = HEAVY
) -> DataFrame:
    """Copies for every row of ``rows(key, grp, size, ...)``.

    ``targets(grp, mass, target)`` has one row per group: the sum of its sizes and
    the tokens wanted, at most ``cap * mass``.  Adds ``mass``, ``target``,
    ``rate`` (the document's tilted rate before rounding) and ``copies`` (int, 0 to ``cap``).
    ``key`` may be null or repeated: rows with equal (grp, key, size) get equal
    copies.  Rows of size 0, and groups without a target, get no copies.  Groups
    may be null; sizes must not.  An empty table gives an empty result.
    """
    counts = C.stored(rows.groupBy("grp", "size").agg(F.count("*").alias("n")), "counts")
    groups = C.joinable(solve_dual(counts, targets, float(cap)).withColumnRenamed("grp", "g"), "tilts")
    tilted = rows.join(groups, F.col("grp").eqNullSafe(F.col("g")), "left").drop("g")
    tilted = tilted.withColumn("rate", tilt(F.col("lam"), F.col("size"), cap))

    is_heavy = (F.col("size") > 0) & (F.col("size") * F.lit(float(heavy)) >= F.col("mass"))
    distinct = (
        tilted.where(is_heavy).groupBy("grp", "key", "size")
        .agg(F.count("*").alias("n"), F.first("rate").alias("rate"))
    )
    # at most `heavy` entries a group, by the definition of heavy
    listed = distinct.groupBy("grp").agg(
        F.sort_array(F.collect_list(F.struct(
            "size", F.xxhash64("key").alias("draw"), "key", "n", "rate")), False).alias("items"))

    def carry(acc, item):
        want = item["rate"] * item["size"] * item["n"] + acc["error"]
        copies = F.least(F.greatest(F.round(want / (item["size"] * item["n"])), F.lit(0.0)), F.lit(float(cap)))
        return F.struct(
            (want - copies * item["size"] * item["n"]).alias("error"),
            F.concat(acc["copies"], F.array(copies.cast("int"))).alias("copies"),
        )

    start = F.struct(F.lit(0.0).alias("error"), F.expr("CAST(array() AS array<int>)").alias("copies"))
    rounded = C.stored(
        listed.withColumn("done", F.aggregate("items", start, carry))
        .select("grp", "items", F.col("done.error").alias("error"), F.col("done.copies").alias("copies")), "heavy")

    heavy_copies = rounded.select(
        "grp", F.explode(F.arrays_zip(F.col("items.key").alias("key"), F.col("items.size").alias("size"),
                                      F.col("copies").alias("copies"))).alias("x"),
    ).select(F.col("grp").alias("hg"), F.col("x.key").alias("hk"), F.col("x.size").alias("hs"),
             F.col("x.copies").alias("heavy_copies"))
    weighed = rounded.select(
        F.col("grp").alias("wg"), "error",
        F.aggregate("items", F.lit(0.0), lambda a, i: a + i["size"] * i["n"]).alias("heavy_mass"))

    lightened = groups.join(weighed, F.col("g").eqNullSafe(F.col("wg")), "left").select(
        F.col("g").alias("lg"),
        (F.col("mass") - F.coalesce("heavy_mass", F.lit(0.0))).alias("light_mass"),
        F.coalesce("error", F.lit(0.0)).alias("error"))
    shift = F.when(F.col("light_mass") > 0, F.col("error") / F.col("light_mass")).otherwise(F.lit(0.0))
    lightened = C.joinable(lightened.select("lg", shift.alias("shift")), "shifts")

    out = tilted.join(lightened, F.col("grp").eqNullSafe(F.col("lg")), "left").drop("lg")
    wanted = F.least(F.greatest(F.col("rate") + F.col("shift"), F.lit(0.0)), F.lit(float(cap)))
    out = out.withColumn("light_rate", F.when(F.col("size") > 0, wanted).otherwise(F.lit(0.0))).drop("shift", "lam")
    out = out.join(
        heavy_copies,
        F.col("grp").eqNullSafe(F.col("hg")) & F.col("key").eqNullSafe(F.col("hk")) & (F.col("size") == F.col("hs")),
        "left",
    ).drop("hg", "hk", "hs")
    draw = F.pmod(F.xxhash64("key", "size", F.lit(20_011)), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("light_rate")
    light = whole + F.when(draw < F.col("light_rate") - whole, 1).otherwise(0)
    copies = F.when(F.col("size") <= 0, 0).when(F.col("mass").isNull(), 0).otherwise(
        F.coalesce("heavy_copies", light))
    return out.withColumn("copies", copies.cast("int")).drop("light_rate", "heavy_copies")


def mix_plan(docs: DataFrame, cap: int = 3, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies`` for every row of
    ``documents``: all sources mixed to cyclic weights at the corpus's own size.

    Sizes are word counts (null text: 0); a null source is a source of its own;
    rows of equal id, source and size get equal copies.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    rows = C.stored(
        docs.select(F.col("doc_id").cast("long").alias("key"), F.col("source").cast("string").alias("grp"),
                    C.word_count(F.col("text").cast("string")).alias("size")), "sizes")
    masses = rows.groupBy("grp").agg(F.sum("size").alias("mass"))
    targets = C.stored(capped_targets(cyclic_weights(masses, weights), float(cap)), "targets")
    out = entropy_balance(rows, targets, cap)
    return out.select(
        F.col("key").alias("doc_id"), F.col("grp").alias("source"), "size",
        F.col("mass").cast("long").alias("source_size"), "target", "rate", "copies")


def mix_documents(docs: DataFrame, cap: int = 3, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """``docs`` with ``copies``, the times the mix takes the document; documents
    taken no time go.  Clashing columns: an existing ``copies`` is replaced."""
    plan = mix_plan(docs, cap, weights).where("copies > 0").groupBy("doc_id", "source", "size").agg(
        F.first("copies").alias("copies"))
    plan = plan.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
                       F.col("size").alias("__size"), F.col("copies").alias("__copies"))
    plan = C.joinable(plan, "plan")
    # the word count is part of the key: rows that share an id stay apart
    sized = docs.withColumn("__words", C.word_count(F.col("text").cast("string")))
    return (
        sized.join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
                   & F.col("source").cast("string").eqNullSafe(F.col("__source"))
                   & (F.col("__words") == F.col("__size")))
        .withColumn("copies", F.col("__copies")).drop("__id", "__source", "__size", "__copies", "__words")
    )
