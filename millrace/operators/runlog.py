"""Run-time summaries over ``experiment(id, suite, name)`` and
``experiment_run(experiment_id, run, time)``, times in milliseconds.

A profile never shuffles the runs as such: tasks reduce them to counts by experiment and digit before
any join, so one that holds a third of all runs is no hot key. Pending runs are found on words of
64 runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.scratch import remove, write_table

#: Bits of a time that one round of counting decides.
DIGIT = 12
#: Prefix of runs without a time; times have none below 0 in the rounds that look at prefixes.
NO_TIME = -1
WORD = 64
#: Words of one array while expected runs are written out.
CHUNK_WORDS = 4096
LOWEST = -(1 << 63)
GROUP = ["suite", "name"]


def _join(experiment: DataFrame, runs: DataFrame, suite: str | None) -> DataFrame:
    """Inner join on the experiment id.

    Spark broadcasts the experiments while their measured size allows it and otherwise sorts and
    merges, splitting an oversized experiment's runs (adaptive skew join).
    """
    known = _named(experiment, suite)
    return runs.join(known, runs["experiment_id"] == known["id"]).drop("id")


def _named(experiment: DataFrame, suite: str | None) -> DataFrame:
    known = experiment if suite is None else experiment.filter(F.col("suite") == suite)
    return known.select("id", *GROUP)


def _same_group() -> Column:
    """Condition between the aliases ``e`` (experiments) and ``g`` (groups); NULL names match."""
    suite, name = (F.col(f"e.{key}").eqNullSafe(F.col(f"g.{key}")) for key in GROUP)
    return suite & name


def _prefix(shift: int) -> Column:
    """The time without its low ``shift`` bits; in this form all times order as unsigned numbers."""
    return F.shiftrightunsigned(F.col("time").bitwiseXOR(F.lit(LOWEST)), shift)


def _shifts(run: DataFrame) -> list[int]:
    """Low bits that are still open after each round: the bits in which the times differ, DIGIT at a time."""
    least, most = run.agg(F.min("time"), F.max("time")).first()
    width = 0 if least is None else ((least - LOWEST) ^ (most - LOWEST)).bit_length()
    return [max(0, width - DIGIT * (i + 1)) for i in range(max(1, -(-width // DIGIT)))]


TOTALS = ["lo", "hi", "total", "timed", "runs"]


def profile(experiment: DataFrame, run: DataFrame, suite: str | None = None) -> DataFrame:
    """By (suite, name): ``lo, hi, total, median`` of the times, ``timed`` and ``runs`` counts.

    The exact median is found by radix selection. A first look at the least and the greatest time tells
    in which bits times differ at all. The first round counts by the upper DIGIT of them and gives the
    totals as well; in each group the running count tells which digits hold the two middle ranks. Every
    further round reads the runs again, keeps those that begin like a middle rank of their group, and
    counts them by the next digit. A running count passes over at most 2^DIGIT counts, whatever the number
    of runs and the width of their times; times that differ in 24 bits take two rounds, 64 bits six. From
    the third round on the groups are written in between, one row each, so that plans do not grow; the
    last of these tables stays in the shared folder.
    """
    timed = run.select("experiment_id", F.col("time").cast("bigint").alias("time"))
    first, *later = _shifts(timed)
    by_experiment = timed.groupBy("experiment_id", _prefix(first).alias("bin")).agg(
        F.min("time").alias("lo"),
        F.max("time").alias("hi"),
        F.sum("time").alias("total"),
        F.count("time").alias("c"),
        F.count(F.lit(1)).alias("runs"),
    )
    bins = _join(experiment, by_experiment, suite).groupBy(*GROUP, "bin").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(c).alias(c) for c in ("total", "c", "runs")]
    )
    whole = Window.partitionBy(*GROUP)
    totals = {"lo": F.min("lo"), "hi": F.max("hi"), "total": F.sum("total"), "timed": F.sum("c"), "runs": F.sum("runs")}
    ranked = bins.select(
        *GROUP, "bin", "c", F.sum("c").over(whole.orderBy("bin")).alias("upto"),
        *[total.over(whole).alias(name) for name, total in totals.items()],
    )
    # 0-based ranks of the two middle elements; equal for an odd count
    lower, upper = F.shiftright(F.col("timed") - 1, 1), F.shiftright("timed", 1)
    groups = _selected(ranked, lower, upper)
    path = None
    for i, (above, shift) in enumerate(zip([first, *later], later)):
        if i:
            written, now = write_table(groups, "medians")
            if path is not None:
                remove(run.sparkSession, path)
            groups, path = written, now
        groups = _narrowed(experiment, timed, groups, suite, above, shift)
    middle = [F.col(f"{m}.prefix").bitwiseXOR(F.lit(LOWEST)).cast("double") for m in ("lower", "upper")]
    return groups.select(*GROUP, *TOTALS, ((middle[0] + middle[1]) / 2).alias("median"))


def _selected(counted: DataFrame, lower: Column, upper: Column) -> DataFrame:
    """One row per group: totals, and for each rank the digits that hold it (``prefix``) and the rank among
    those, from counts ``c`` with running sums ``upto``. A group without times has neither."""
    before = F.col("upto") - F.col("c")

    def holds(rank: Column) -> Column:
        return (before <= rank) & (rank < F.col("upto"))

    def place(rank: Column, name: str) -> Column:
        return F.max(F.when(holds(rank), F.struct(F.col("bin").alias("prefix"), (rank - before).alias("rank")))).alias(name)

    wanted = holds(lower) | holds(upper) | (F.col("timed") == 0)
    return counted.filter(wanted).groupBy(*GROUP).agg(
        *[F.max(c).alias(c) for c in TOTALS], place(lower, "lower"), place(upper, "upper")
    )


def _narrowed(
    experiment: DataFrame, timed: DataFrame, groups: DataFrame, suite: str | None, above: int, shift: int
) -> DataFrame:
    """The groups with their middle ranks known down to ``shift``, from those known down to ``above``.

    What is known of a group goes to its experiments, and with them to the runs, which meet that table
    before they are counted. Runs and groups without a time have the prefix NO_TIME.
    """
    begun = F.array_distinct(F.array(*[F.coalesce(f"{m}.prefix", F.lit(NO_TIME)) for m in ("lower", "upper")]))
    wanted = groups.withColumn("prefix", F.explode(begun))
    ids = _named(experiment, suite).alias("e").join(wanted.alias("g"), _same_group()).select(
        F.col("e.id").alias("experiment_id"), *[f"e.{c}" for c in GROUP], "g.prefix",
        *[f"g.{c}" for c in (*TOTALS, "lower", "upper")],
    )
    runs = timed.select(
        "experiment_id", F.coalesce(_prefix(above), F.lit(NO_TIME)).alias("prefix"), _prefix(shift).alias("bin")
    )
    counted = runs.join(ids, ["experiment_id", "prefix"]).groupBy(*GROUP, "prefix", "bin").agg(
        F.count(F.lit(1)).alias("c"), *[F.max(c).alias(c) for c in (*TOTALS, "lower", "upper")]
    )
    upto = F.sum("c").over(Window.partitionBy(*GROUP, "prefix").orderBy("bin"))

    def rank(m: str) -> Column:
        return F.when(F.col("prefix") == F.col(f"{m}.prefix"), F.col(f"{m}.rank"))

    return _selected(counted.withColumn("upto", upto), rank("lower"), rank("upper"))


def summary(experiment: DataFrame, run: DataFrame, suite: str | None = None) -> DataFrame:
    """Shortest, longest and total-without-extremes time by (suite, name).

    ``sum_minus_extremes`` is the median of exactly three runs; ``median`` is one for any number.
    """
    return profile(experiment, run, suite).select(
        "suite",
        "name",
        F.col("lo").alias("min_time"),
        F.col("hi").alias("max_time"),
        (F.col("total") - F.col("lo") - F.col("hi")).alias("sum_minus_extremes"),
        "median",
    ).orderBy("suite", "name")


def stats(experiment: DataFrame, run: DataFrame, suite: str | None = None) -> DataFrame:
    """Average, median, maximum, minimum (seconds) and number of runs by (name, suite)."""
    mean = F.try_divide(F.col("total"), F.col("timed"))
    return profile(experiment, run, suite).select(
        "name",
        "suite",
        F.round(mean / 1000.0, 2).cast("decimal(18,2)").alias("average"),
        (F.col("median") / 1000.0).alias("median"),
        (F.col("hi") / 1000.0).alias("max"),
        (F.col("lo") / 1000.0).alias("min"),
        F.col("runs").alias("number_of_runs"),
    ).orderBy("name", "suite")


def listing(experiment: DataFrame, run: DataFrame, suite: str | None = None) -> DataFrame:
    """One row per run: name, suite, runtime, run."""
    picked = run.select("experiment_id", "run", "time")
    return _join(experiment, picked, suite).select(
        "name", "suite", F.col("time").alias("runtime"), "run"
    )


def _expected_words(expected: DataFrame) -> DataFrame:
    """``(experiment_id, word, bits)``: the expected runs, run r as bit (r - 1) % WORD of word (r - 1) / WORD."""
    runs = F.col("runs").cast("bigint")
    last = F.floor((runs - 1) / WORD)
    chunks = expected.filter(runs >= 1).select(
        "experiment_id", runs.alias("runs"), last.alias("last"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / CHUNK_WORDS))).alias("chunk"),
    )
    begin = F.col("chunk") * CHUNK_WORDS
    words = chunks.select(
        "experiment_id", "runs", F.explode(F.sequence(begin, F.least(begin + CHUNK_WORDS - 1, F.col("last")))).alias("word")
    )
    missing = F.greatest((F.col("word") + 1) * WORD - F.col("runs"), F.lit(0)).cast("int")
    full = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), missing)
    return words.select("experiment_id", "word", full.alias("bits"))


def _runs_of(words: DataFrame) -> DataFrame:
    """``(experiment_id, run)`` of the bits that are set."""
    places = F.filter(
        F.sequence(F.lit(0), F.lit(WORD - 1)),
        lambda i: F.call_function("shiftrightunsigned", F.col("bits"), i).bitwiseAND(F.lit(1)) == 1,
    )
    return words.filter("bits != 0").select(
        "experiment_id", F.explode(F.transform(places, lambda i: F.col("word") * WORD + i + 1)).alias("run")
    )


def expected_runs(expected: DataFrame) -> DataFrame:
    """``(experiment_id, run)`` with runs 1 … n from ``(experiment_id, runs)``."""
    return _runs_of(_expected_words(expected))


def pending_runs(
    expected: DataFrame, finished: DataFrame, force: bool = False
) -> DataFrame:
    """Runs still to do, as ``(experiment_id, run)``.

    ``expected`` is ``(experiment_id, runs)`` with runs numbered from 1; ``finished`` holds the
    ``(experiment_id, run)`` pairs that succeeded, possibly repeated. ``force`` asks for all.

    Finished runs become words of WORD bits, made within the tasks first, and are taken off the expected
    words; both sides move once, at most a row per 64 runs, and only open runs become rows, behind the join.
    """
    wanted = _expected_words(expected)
    if force:
        return _runs_of(wanted)
    run = F.col("run").cast("bigint") - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(run, F.lit(WORD)).cast("int"))
    done = (
        finished.filter(run >= 0)
        .select("experiment_id", F.floor(run / WORD).alias("word"), bit.alias("bit"))
        .groupBy("experiment_id", "word")
        .agg(F.bit_or("bit").alias("done"))
    )
    met = wanted.join(done, ["experiment_id", "word"], "left")
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("done", F.lit(0).cast("bigint"))))
    return _runs_of(met.select("experiment_id", "word", left.alias("bits")))


def pending_experiments(expected: DataFrame, finished: DataFrame, force: bool = False) -> DataFrame:
    """Experiments with at least one run to do."""
    return pending_runs(expected, finished, force).select("experiment_id").distinct()
