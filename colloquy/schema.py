"""Schemas of mailboxes and forests, and how a table becomes a mailbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a mailbox table; only input_pos must be there and not null. Others may be absent, further ones are payload.
MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("mailbox_id", T.StringType()),
        T.StructField("input_pos", T.LongType(), False),
        T.StructField("message_id", T.StringType()),
        T.StructField("in_reply_to", T.ArrayType(T.StringType())),
        T.StructField("references", T.ArrayType(T.StringType())),
        T.StructField("subject", T.StringType()),
        T.StructField("sent_date", T.StringType()),
        T.StructField("sent_ts", T.TimestampType()),
        T.StructField("internal_date", T.StringType()),
        T.StructField("internal_ts", T.TimestampType()),
        T.StructField("sequence_number", T.LongType()),
        T.StructField("uid", T.LongType()),
    ]
)

#: Columns of a forest. A null input_pos marks a dummy; ordinals count from 1.
NODE_SCHEMA = T.StructType(
    [
        T.StructField("mailbox_id", T.StringType()),
        T.StructField("node_id", T.StringType(), False),
        T.StructField("input_pos", T.LongType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("root_id", T.StringType(), False),
        T.StructField("sibling_ord", T.IntegerType(), False),
        T.StructField("root_ord", T.IntegerType(), False),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("is_dummy", T.BooleanType(), False),
    ]
)

_TEXTS = ("in_reply_to", "references")


def as_mailbox(df: DataFrame, strict: bool = True) -> DataFrame:
    """The columns of ``MESSAGE_SCHEMA``, absent ones null; plain header strings become arrays of one.

    Numbers and dates of other types are refused; without ``strict``, where nothing is sorted by them, they are null.
    """
    there = {f.name: f.dataType for f in df.schema}
    if "input_pos" not in there:
        raise ValueError("a mailbox needs an explicit input_pos")
    for name in ("sequence_number", "uid"):
        if name in there and not isinstance(there[name], (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
            if strict:
                raise ValueError(f"{name} must be an integer column, not {there[name].simpleString()}")
            del there[name]
    for name in ("sent_date", "internal_date"):
        if name in there and not isinstance(there[name], (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType, T.NullType)):
            if strict:
                raise TypeError(f"{name} must be text or a timestamp, not {there[name].simpleString()}")
            del there[name]

    def column(f: T.StructField) -> Column:
        if f.name not in there:
            return F.lit(None).cast(f.dataType).alias(f.name)
        if f.name in _TEXTS and isinstance(there[f.name], T.StringType):
            return F.when(F.col(f.name).isNotNull(), F.array(f.name)).alias(f.name)
        return F.col(f.name).cast(f.dataType).alias(f.name)

    stamped = df
    for name in ("sent", "internal"):  # a timestamp under the name of the text takes its own column
        if isinstance(there.get(f"{name}_date"), (T.TimestampType, T.TimestampNTZType, T.DateType)):
            stamped = stamped.withColumn(f"{name}_ts", F.col(f"{name}_date").cast("timestamp")).withColumn(f"{name}_date", F.lit(None).cast("string"))
            there |= {f"{name}_ts": T.TimestampType(), f"{name}_date": T.StringType()}
    return stamped.select(*map(column, MESSAGE_SCHEMA))
