"""Operator 5: mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source has a target share of the mixture.  Its mean repetition rate is the share, times the rows
wanted, over the rows it has.  Every document draws a repetition count by inverting the Poisson
distribution of that mean at a number hashed from seed, id and text, is exploded by its count, and all
copies are dealt to partitions and ordered by a hash of the copy: a global shuffle.

Only counts per source are gathered.  They are broadcast when there are at most ``BROADCAST_SOURCES``
of them (a few dozen bytes each plus a bounded table of the distribution); beyond that the join is
salted, so one source with a third of all rows is still spread.

Cases: a null source is a source of its own; null and empty texts are documents like others; repeated
rows draw the same count; sources without a stated weight get weight 0 when weights are stated; an
empty table gives an empty table.  A Poisson count of a mean over ``LARGEST_MEAN`` is the sum of several
independent ones, each from a hash of its own, so that the table of the distribution stays short.  Input columns named like the added ones are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = "mix-1"
#: Target shares are proportional to rows ** ALPHA where no weights are stated.
ALPHA = 0.7
#: A draw has this mean at most; its table goes so far that what lies beyond has a chance of less than 2**-32.
LARGEST_MEAN = 32
TABLE = 120
BROADCAST_SOURCES = 20_000
SALTS = 64
ADDED = ("mix_rate", "mix_copy", "mix_key")


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, rows: int | None = None) -> DataFrame:
    """One row per source: _op_source, mix_rate, _op_draws (independent draws whose counts add up), _op_cdf (of each)."""
    counts = docs.groupBy(F.col("source").alias("_op_source")).agg(F.count(F.lit(1)).alias("_op_n"))
    if weights is None:
        counts = counts.withColumn("_op_w", F.pow(F.col("_op_n").cast("double"), F.lit(alpha)))
    else:
        stated = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_op_key string, _op_w double")
        counts = counts.join(stated, F.col("_op_source").eqNullSafe(F.col("_op_key")), "left").drop("_op_key").fillna(0.0, ["_op_w"])
    total = counts.agg(F.sum("_op_w").alias("_op_tw"), F.sum("_op_n").alias("_op_tn"))
    wanted = F.col("_op_tn") if rows is None else F.lit(rows)
    rate = F.when(F.col("_op_tw") > 0, F.col("_op_w") / F.col("_op_tw") * wanted / F.col("_op_n")).otherwise(F.lit(0.0))
    draws = F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / LARGEST_MEAN))
    # P(X <= k) for k = 0..TABLE, each term from the one before
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TABLE)),
        F.struct(F.exp(-F.col("_op_mean")).alias("p"), F.array(F.exp(-F.col("_op_mean"))).alias("c")),
        lambda acc, k: F.struct(
            (acc["p"] * F.col("_op_mean") / k).alias("p"),
            F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * F.col("_op_mean") / k)).alias("c"),
        ),
        lambda acc: acc["c"],
    )
    return (
        counts.crossJoin(F.broadcast(total))  # one row
        .withColumn("mix_rate", rate)
        .withColumn("_op_draws", draws.cast("int"))
        .withColumn("_op_mean", F.col("mix_rate") / F.col("_op_draws"))
        .withColumn("_op_cdf", cdf)
        .select("_op_source", "mix_rate", "_op_draws", "_op_cdf")
    )


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, rows: int | None = None, seed: str = SEED) -> DataFrame:
    """The mixture: the columns of ``docs`` and mix_rate double, mix_copy int (from 0), mix_key string.

    Rows come in the order of mix_key within partitions that are dealt by it."""
    docs = docs.drop(*ADDED)
    plan = common.materialise(rates(docs, weights, alpha, rows), "mix-rates")
    ident = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    left = docs.withColumn("_op_ident", ident)
    if plan.count() <= BROADCAST_SOURCES:
        joined = left.join(F.broadcast(plan), left["source"].eqNullSafe(plan["_op_source"]))
    else:
        salted = plan.withColumn("_op_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = left.withColumn("_op_salt", F.pmod(F.xxhash64("_op_ident"), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, left["source"].eqNullSafe(salted["_op_source"]) & (left["_op_salt"] == salted["_op_salt"])).drop("_op_salt")
    below = lambda u: F.size(F.filter("_op_cdf", lambda c: c <= u))
    more = F.sequence(F.lit(2), F.col("_op_draws"))  # the first draw takes the plain identity
    rest = F.aggregate(more, F.lit(0), lambda n, k: n + below(common.uniform(F.col("_op_ident"), k.cast("string"))))
    drawn = below(common.uniform(F.col("_op_ident"))) + F.when(F.col("_op_draws") > 1, rest).otherwise(0)
    return (
        joined.withColumn("_op_count", drawn)
        .where(F.col("_op_count") > 0)
        .drop("_op_cdf", "_op_source", "_op_draws")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("_op_count") - 1)))
        .withColumn("mix_key", F.md5(F.concat_ws("|", F.col("_op_ident"), F.col("mix_copy").cast("string")).cast("binary")))
        .drop("_op_ident", "_op_count")
        .repartition("mix_key")
        .sortWithinPartitions("mix_key")
    )


#: The same rows in another engine's SQL; {docs} is the relation to mix.
SQL = """
with recursive _docs as (select *, concat_ws('|', '{seed}', coalesce(cast(doc_id as varchar), ''), md5(coalesce(text, ''))) as ident from {docs}),
_counts as (select source, count(*) as n from _docs group by source),
_rates as (select source, pow(cast(n as double), {alpha}) / sum(pow(cast(n as double), {alpha})) over () * sum(n) over () / n as rate from _counts),
_means as (select source, rate, cast(greatest(1, ceil(rate / {largest})) as integer) as draws, rate / cast(greatest(1, ceil(rate / {largest})) as integer) as mean from _rates),
_cdf(source, mean, k, p, c) as (
  select source, mean, 0, exp(-mean), exp(-mean) from _means
  union all select source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from _cdf where k < {table}),
_steps as (select source, list(c) as cs from _cdf group by source),
_drawn as (select d.*, m.rate as mix_rate, list_sum(list_transform(range(1, m.draws + 1), lambda k: len(list_filter(s.cs, lambda c: c <= cast(('0x' || substr(md5(d.ident || case when k > 1 then '|' || k else '' end), 1, 8)) as bigint) / 4294967296.0))))::bigint as n_copies
  from _docs d join _means m on d.source is not distinct from m.source join _steps s on d.source is not distinct from s.source)
select * exclude (ident, n_copies, i), cast(i as integer) as mix_copy, md5(concat_ws('|', ident, cast(i as varchar))) as mix_key
from (select *, unnest(range(n_copies)) as i from _drawn)
"""


def sql(docs: str = "documents") -> str:
    return SQL.format(docs=docs, seed=SEED, alpha=ALPHA, largest=LARGEST_MEAN, table=TABLE)
