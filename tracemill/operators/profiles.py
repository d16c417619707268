"""Task difficulty profiles: counts, merges, priors, selection rules and sampling weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import episode as E
from tracemill.functions import hashing as H
from tracemill.functions import stats as S


def task_profile(episodes: DataFrame) -> DataFrame:
    """Successes and trials per task over the episodes that train."""
    return episodes.where(E.trains(F.col("termination"))).groupBy("task_id").agg(
        F.sum(E.eval_reward(F.col("reward"), F.col("termination"))).cast("bigint").alias("successes"),
        F.count(F.lit(1)).alias("trials"))


def merge_add(prior: DataFrame, new: DataFrame, known_only: bool = False) -> DataFrame:
    """Sum of two profiles; a side without the task counts 0. ``known_only`` ignores new tasks."""
    if known_only:
        new = new.join(prior.select("task_id"), "task_id", "left_semi")
    return prior.select("task_id", "successes", "trials").unionByName(new.select("task_id", "successes", "trials")).groupBy(
        "task_id").agg(F.sum("successes").alias("successes"), F.sum("trials").alias("trials"))


def merge_overwrite(prior: DataFrame, new: DataFrame) -> DataFrame:
    """New counts replace old ones as a whole."""
    o = prior.select("task_id", F.struct("successes", "trials").alias("o"))
    n = new.select("task_id", F.struct("successes", "trials").alias("n"))
    return o.join(n, "task_id", "full").select("task_id", F.coalesce("n", "o").alias("p")).select("task_id", "p.*")


def inherit(pool: DataFrame, prior: DataFrame) -> DataFrame:
    """Variants (base_id set) without counts of their own take their base task's counts. Returns the
    extended prior of the pool with where each count came from; tasks with neither are 'to_profile'."""
    own = prior.select("task_id", F.struct("successes", "trials").alias("own"))
    base = prior.select(F.col("task_id").alias("base_id"), F.struct("successes", "trials").alias("base"))
    j = pool.join(own, "task_id", "left").join(base, "base_id", "left")
    return j.select("task_id", F.coalesce("base", "own").alias("p"),
                    F.when(F.col("base").isNotNull(), "base").when(F.col("own").isNotNull(), "own")
                    .otherwise("to_profile").alias("origin")).select("task_id", "origin", "p.*")


def recent_else_full(train: DataFrame, recent: DataFrame, full: DataFrame, recent_min: int = 4) -> DataFrame:
    """Prior and keep decision per task: recent counts when there are enough, the full history if not;
    only mixed tasks stay."""
    r = recent.select("task_id", F.struct("successes", "trials").alias("r"))
    f = full.select("task_id", F.struct("successes", "trials").alias("f"))
    j = train.select("task_id").join(r, "task_id", "left").join(f, "task_id", "left")
    use_recent = F.coalesce(F.col("r.trials") >= recent_min, F.lit(False))
    p = F.when(use_recent, F.col("r")).otherwise(F.col("f"))
    j = j.withColumn("use_recent", use_recent).withColumn("p", p)
    mixed = F.coalesce(S.is_mixed(F.col("p.successes"), F.col("p.trials")), F.lit(False))
    why = (F.when(F.col("use_recent"), F.when(mixed, "recent mixed").when(F.col("p.successes") > 0, "recent always").otherwise("recent never"))
           .otherwise(F.when(mixed, "full mixed (recent thin)").otherwise("full not mixed (recent thin)")))
    return j.select("task_id", mixed.alias("keep"), why.alias("why"), F.col("p.successes").alias("successes"), F.col("p.trials").alias("trials"))


def needs_profiling(train: DataFrame, prior: DataFrame, thin: int = 4) -> DataFrame:
    """Tasks never tried, or with few trials and no failure yet."""
    j = train.select("task_id").join(prior.select("task_id", "successes", "trials"), "task_id", "left")
    never = F.col("trials").isNull()
    return j.where(never | ((F.col("trials") < thin) & (F.col("successes") == F.col("trials")))).select(
        "task_id", F.when(never, "never tried").otherwise("thin and all-success").alias("reason"))


def pool_by_max(tasks: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Two count sources that overlap: take the larger of each count, not the sum."""
    aa = a.select("task_id", F.col("successes").alias("s1"), F.col("trials").alias("n1"))
    bb = b.select("task_id", F.col("successes").alias("s2"), F.col("trials").alias("n2"))

    def largest(x, y):
        return F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).cast("bigint")
    return tasks.join(aa, "task_id", "left").join(bb, "task_id", "left").select(
        *tasks.columns, largest(F.col("s1"), F.col("s2")).alias("successes"), largest(F.col("n1"), F.col("n2")).alias("trials"))


def never_solved(counts: DataFrame, keys: list[str], attempts: list[int]) -> DataFrame:
    """Tasks without a success after at least so many attempts, per attempt threshold."""
    hit = F.filter(F.array(*[F.when((F.col("successes") == 0) & (F.col("trials") >= a), F.lit(a)) for a in attempts]),
                   lambda x: x.isNotNull())
    return counts.select(*keys, F.explode(hit).alias("attempts")).groupBy(*keys, "attempts").agg(F.count(F.lit(1)).alias("tasks"))


def family_report(profile: DataFrame, family: str) -> DataFrame:
    p = F.col("successes") / F.col("trials")
    return profile.groupBy(family).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"),
        F.avg((F.col("successes") == F.col("trials")).cast("int")).alias("always"), F.avg((F.col("successes") == 0).cast("int")).alias("never"),
        F.avg(S.is_mixed(F.col("successes"), F.col("trials")).cast("int")).alias("mixed"))


def subset_rate(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Success over a set of tasks as a ratio of sums."""
    return profile.groupBy(*keys).agg(F.count(F.lit(1)).alias("tasks"), (F.sum("successes") / F.greatest(F.sum("trials"), F.lit(1))).alias("rate"))


# ------------------------------------------------------------------ empirical-Bayes prior

def beta_prior(profile: DataFrame) -> DataFrame:
    """One row (a0, b0): beta-binomial method of moments over tasks with more than one trial; (1, 1) for
    fewer than ten tasks or a fit outside (0, 1); never below 0.05."""
    p = F.col("successes") / F.col("trials")
    m = profile.where("trials > 1").agg(F.count(F.lit(1)).alias("rows"), F.avg("trials").alias("n"), F.avg(p).alias("m"),
                                        F.var_samp(p).alias("v"))
    rho = F.try_divide(F.try_divide(F.col("v") * F.col("n"), F.col("m") * (1 - F.col("m"))) - 1, F.col("n") - 1)
    usable = F.coalesce((F.col("rows") >= 10) & (F.col("m") > 0) & (F.col("m") < 1) & (F.col("rho") > 0) & (F.col("rho") < 1), F.lit(False))
    ab = 1 / F.col("rho") - 1
    return m.withColumn("rho", rho).select(
        F.when(usable, F.greatest(F.lit(0.05), F.col("m") * ab)).otherwise(1.0).alias("a0"),
        F.when(usable, F.greatest(F.lit(0.05), (1 - F.col("m")) * ab)).otherwise(1.0).alias("b0"))


def pool_rule(mode: str) -> Column:
    """Which pool tasks are drawn from; columns successes and trials are null for unprofiled tasks."""
    known = F.col("trials").isNotNull()
    if mode == "mixed":
        return known & S.is_mixed(F.col("successes"), F.col("trials"))
    if mode == "not_always":
        return ~known | (F.col("successes") < F.col("trials"))
    return F.lit(True)


def posterior(pool: DataFrame, profile: DataFrame) -> DataFrame:
    """Beta posterior (a, b) of each pool task under the fitted prior."""
    known = profile.join(pool.select("task_id"), "task_id", "left_semi")
    ab = beta_prior(known).select(F.struct("a0", "b0")).scalar()
    j = pool.join(profile.select("task_id", "successes", "trials"), "task_id", "left").withColumn("prior", ab)
    s, n = F.coalesce("successes", F.lit(0)), F.coalesce("trials", F.lit(0))
    return j.select(*pool.columns, "successes", "trials", F.col("prior.a0").alias("a0"), F.col("prior.b0").alias("b0"),
                    (F.col("prior.a0") + s).alias("a"), (F.col("prior.b0") + n - s).alias("b"))


def value_weight(a: Column, b: Column, group: int, mode: str = "mixed") -> Column:
    """Chance that a group of ``group`` rollouts is mixed; times the pass^4 gain per rollout in pass4 mode."""
    mixed = 1 - S.beta_moment(a, b, group) - S.beta_moment(b, a, group)
    return mixed if mode == "mixed" else mixed * 4 * S.beta_moment(a, b, 3) / group


# fixed values: the failure class each generated family practises
FAMILY_TARGETS = {"items_addr": "missed_write", "decoy_first": "wrong_target", "keep_options": "wrong_args", "pairing": "wrong_args"}


def base_of(task_id: Column) -> Column:
    """The task that a variant id <base>_r<k> was made from; an id without the mark is its own base."""
    return F.split_part(task_id, F.lit("_r"), F.lit(1))


def task_of_group(group_id: Column) -> Column:
    """The task id behind the second dash of a group id; it may have dashes itself. Null where there are fewer."""
    return F.get(F.split(group_id, "-", 3), 2)


def family_multiplier(family: Column, level: Column, current: Column, fail_share: Column, boost: float = 3.0) -> Column:
    """Half weight below the current level, more for families whose failure class dominates."""
    at = F.when(level == current, 1.0).otherwise(0.5)
    return F.when(family.isNull(), 1.0).otherwise(at * (1 + F.lit(boost) * F.coalesce(fail_share, F.lit(0.0))))


def draw_weighted(tasks: DataFrame, weight: str, n: int, seed: int, floor: float = 0.02) -> DataFrame:
    """n tasks without replacement, in proportion to weight (never below a share of the largest). Racing
    exponential clocks gives the same law as drawing one by one, in one pass and one top-n."""
    top = tasks.agg(F.max(weight)).scalar()
    w = F.greatest(F.col(weight), F.lit(floor) * top)
    u = H.uniform(seed, "race", F.col("task_id"))
    clock = -F.ln(F.greatest(u, F.lit(2.0 ** -33))) / w
    return tasks.withColumn("_clock", clock).orderBy("_clock", "task_id").limit(n).drop("_clock")


def retire(post: DataFrame, retire_n: int, retire_p: float) -> DataFrame:
    """Tasks with enough observations and a posterior mean above the bound."""
    obs = F.col("a") + F.col("b") - F.col("a0") - F.col("b0")
    return post.withColumn("retired", (obs >= retire_n) & (F.col("a") / (F.col("a") + F.col("b")) > retire_p))


def promote(episodes: DataFrame, levels: DataFrame, min_obs: int = 16, at: float = 0.85, top: int = 3) -> DataFrame:
    """Families whose success at their current level is high enough move up one level."""
    cur = episodes.join(levels, "family").where("level = current")
    s = cur.groupBy("family", "current").agg(F.count(F.lit(1)).alias("obs"), F.avg("reward").alias("rate"))
    up = (F.col("obs") >= min_obs) & (F.col("rate") >= at) & (F.col("current") < top)
    return s.select("family", "current", "obs", "rate", (F.col("current") + up.cast("int")).alias("next"))


def failure_share_ema(by_step: DataFrame, keys: list[str], alpha: float = 0.5) -> DataFrame:
    """Exponential mean over steps of each class's share of failures. Input: step, class, failures; a
    step without failures does not move the mean. Unrolled: share of the j-th last step weighs
    alpha*(1-alpha)^j, so a class absent from a step counts as share 0."""
    total = by_step.groupBy(*keys, "step").agg(F.sum("failures").alias("all")).where("all > 0")
    w = Window.partitionBy(*keys).orderBy(F.desc("step"))
    aged = total.withColumn("age", F.row_number().over(w) - 1)
    j = by_step.join(aged, keys + ["step"])
    return j.groupBy(*keys, "class").agg(F.sum(
        F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("age")) * F.col("failures") / F.col("all")).alias("ema"))
