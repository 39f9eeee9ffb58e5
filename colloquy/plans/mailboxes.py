"""Mailboxes derived from the supplied tables, by rules that SQL can repeat.

Positions only need to be unique and in order, so they are computed from keys and no table is numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turn_id(turn: Column) -> Column:
    return F.concat(F.lit("<c"), F.col("conv_id").cast("string"), F.lit(".t"), turn.cast("string"), F.lit("@ex>"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation refers to all before it."""
    t = table(spark, sf_dir, "conversations")
    before = F.transform(F.filter(F.sequence(F.lit(0), F.col("turn").cast("int")), lambda k: k < F.col("turn")), lambda k: turn_id(k))
    return t.select((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("input_pos"), "conv_id", "turn", turn_id(F.col("turn")).alias("message_id"), before.alias("references"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only In-Reply-To, with a stray address behind the identifier."""
    m = chain(spark, sf_dir)
    to = F.when(F.col("turn") > 0, F.array(F.concat(turn_id(F.col("turn") - 1), F.lit(" <someone@else.ex>"))))
    return m.withColumn("in_reply_to", to).drop("references")


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain without first turns and some others: their identifiers are only referred to."""
    return chain(spark, sf_dir).where("turn <> 0 and (conv_id + turn) % 5 <> 0")


def doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with every tenth conversation sent twice."""
    m = chain(spark, sf_dir)
    return m.unionByName(m.where("conv_id % 10 = 0").withColumn("input_pos", F.col("input_pos") + 500))


def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with later turns arriving first."""
    return chain(spark, sf_dir).withColumn("input_pos", (1000 - F.col("turn")) * 100_000_000 + F.col("conv_id"))


def circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain whose first turns also refer to the last ones."""
    m = chain(spark, sf_dir)
    last = m.groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("last"))
    return m.join(last, m["conv_id"] == last["c"]).withColumn("references", F.when(F.col("turn") == 0, F.array(turn_id(F.col("last")))).otherwise(F.col("references"))).drop("c", "last")


def order_id(key: Column | str) -> Column:
    return F.concat(F.lit("<o"), (F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("@ex>"))


def forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of a customer reply to the first."""
    o = table(spark, sf_dir, "orders")
    first = o.groupBy(F.col("o_custkey").alias("c")).agg(F.min("o_orderkey").alias("first"))
    o = o.join(first, o["o_custkey"] == first["c"])
    return o.select(
        F.col("o_orderkey").alias("input_pos"), "first", order_id("o_orderkey").alias("message_id"), F.when(F.col("o_orderkey") > F.col("first"), F.array(order_id("first"))).alias("references"),
        F.date_format("o_orderdate", "d MMM yyyy '10:00:00 +0000'").alias("sent_date"),
    )


def rootless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forks without their first orders."""
    return forks(spark, sf_dir).where("input_pos > first")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without references, whose subjects dress up the user's."""
    e = table(spark, sf_dir, "events")
    topic = F.concat(F.lit("topic "), F.col("user_id").cast("string"))
    k = F.col("event_id") % 4
    dressed = F.when(k == 0, topic).when(k == 1, F.concat(F.lit("Re: "), topic)).when(k == 2, F.concat(F.lit("[x] Fwd: "), topic)).otherwise(F.concat(topic, F.lit(" (fwd)")))
    return e.select(F.col("event_id").alias("input_pos"), "event_id", "user_id", F.concat(F.lit("<e"), F.col("event_id").cast("string"), F.lit("@ex>")).alias("message_id"), dressed.alias("subject"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with header dates in five zones; every seventh is unusable and has an internal date."""
    e = table(spark, sf_dir, "events")
    zone = F.element_at(F.array(*[F.lit(z) for z in ("+0000", "-0800", "+0530", "+0100", "-0330")]), (F.col("event_id") % 5 + 1).cast("int"))
    text = F.concat(F.date_format("ts", "EEE', 'd MMM yyyy HH:mm:ss "), zone)
    odd = F.col("event_id") % 7 == 0
    return e.select(F.col("event_id").alias("input_pos"), "event_id", F.when(odd, F.lit("not a date")).otherwise(text).alias("sent_date"), F.when(odd, text).alias("internal_date"))


def selfish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain, each of whose messages refers to itself as well."""
    return chain(spark, sf_dir).withColumn("references", F.concat("references", F.array("message_id")))


def mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in pairs that refer to each other."""
    e = table(spark, sf_dir, "events")
    name = lambda c: F.concat(F.lit("<e"), c.cast("string"), F.lit("@ex>"))
    other = F.col("event_id") + 1 - 2 * (F.col("event_id") % 2)
    return e.select(F.col("event_id").alias("input_pos"), name(F.col("event_id")).alias("message_id"), F.array(name(other)).alias("references"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rootless forks, whose customers share a hundred subjects."""
    o = rootless(spark, sf_dir)
    customer = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return o.join(customer, o["input_pos"] == customer["k"]).withColumn("subject", F.concat(F.lit("[list] topic "), (F.col("c") % 100).cast("string"))).drop("k")


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders by threes: every second of three replies to the first order, the next two reply to that one."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("input_pos"))
    own = F.sort_array(F.collect_list("input_pos"))
    o = o.groupBy("o_custkey").agg(own.alias("all")).select("all", F.posexplode("all").alias("rank", "input_pos"))
    head = F.get("all", F.col("rank") - F.pmod(F.col("rank") - 1, F.lit(3)))
    first = order_id(F.get("all", F.lit(0)))
    refs = F.when(F.col("rank") == 0, F.lit(None)).when(F.col("rank") % 3 == 1, F.array(first)).otherwise(F.array(first, order_id(head)))
    return o.select("input_pos", order_id("input_pos").alias("message_id"), refs.alias("references"))


def odd_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with broken header dates of eight forms; those of the last have an internal date."""
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "d MMM yyyy")
    forms = [
        F.concat(day, F.lit(" 27:10:00 +0300")), day, F.concat(day, F.lit(" at noon EST")), F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +9930")),
        F.concat(day, F.date_format("ts", " HH:mm"), F.lit(":60 +0000")), F.concat(day, F.lit(" soon -0800")), F.concat(F.lit("  "), day, F.date_format("ts", " HH:mm:ss"), F.lit(" GMT ")), F.lit("32 Jul 2020 10:00:00 +0000"),
    ]
    k = (F.col("event_id") % 8 + 1).cast("int")
    return e.select(F.col("event_id").alias("input_pos"), "event_id", F.element_at(F.array(*forms), k).alias("sent_date"), F.when(k == 8, F.concat(day, F.lit(" 06:00:00 +0600"))).alias("internal_date"))
