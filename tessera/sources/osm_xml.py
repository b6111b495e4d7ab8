"""Changesets (osmChange XML, gzip too) and replication state files as tables of changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import coords, ids

_TAGS = "tag array<struct<_k:string,_v:string>>"
_COMMON = f"_id bigint, _version int, _timestamp timestamp, {_TAGS}"


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(":".join(f.strip().split(" ", 1)) for f in fields.split(", ")) + ">"


_NODE = _struct(f"{_COMMON}, _lon string, _lat string")
_WAY = _struct(f"{_COMMON}, nd array<struct<_ref:bigint>>")
_RELATION = _struct(f"{_COMMON}, member array<struct<_type:string,_ref:bigint,_role:string>>")
_GROUP = f"array<struct<node:array<{_NODE}>,way:array<{_WAY}>,relation:array<{_RELATION}>>>"
SCHEMA = f"create {_GROUP}, modify {_GROUP}, delete {_GROUP}"


def sequence_of(path: Column) -> Column:
    """The number that a path of three groups of three digits stands for."""
    digits = F.regexp_extract(path, r"(\d{3})/(\d{3})/(\d{3})\.[^/]*$", 0)
    return F.regexp_replace(F.regexp_extract(digits, r"^[\d/]+", 0), "/", "").try_cast("long")


def sequence_path(sequence: Column, suffix: str) -> Column:
    return F.format_string("%03d/%03d/%03d" + suffix, F.floor(sequence / 1_000_000), F.floor(sequence / 1000) % 1000, sequence % 1000)


def changes(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, ord, op, type, id, version, ts, tags, refs, roles, x, y)`` of the changeset files under a path."""
    files = spark.read.format("xml").option("rowTag", "osmChange").schema(SCHEMA).load(path, recursiveFileLookup=True)
    files = files.withColumn("seq", sequence_of(F.input_file_name()))
    parts = []
    for o, op in enumerate(("create", "modify", "delete")):
        groups = files.select("seq", F.posexplode(op).alias("g", "group"))
        for t, name in enumerate(ids.TYPE_NAMES[:3]):
            e = groups.select("seq", "g", F.posexplode(F.col("group")[name]).alias("n", "e"))
            tags = F.map_from_entries(F.transform(F.coalesce("e.tag", F.array()), lambda x: F.struct(x["_k"], x["_v"])))
            refs, roles, x, y = F.array().cast("array<long>"), F.array().cast("array<string>"), F.lit(None).cast("int"), F.lit(None).cast("int")
            if name == "node":
                x, y = coords.parse(F.col("e._lon")), coords.parse(F.col("e._lat"))
            elif name == "way":
                refs = F.transform(F.coalesce("e.nd", F.array()), lambda n: n["_ref"])
            else:
                refs = F.transform(F.coalesce("e.member", F.array()), lambda m: ids.combined_id(ids.type_id(m["_type"]), m["_ref"]))
                roles = F.transform(F.coalesce("e.member", F.array()), lambda m: m["_role"])
            order = F.lit(o * 3 + t).cast("long") * (1 << 40) + F.col("g").cast("long") * (1 << 24) + F.col("n")
            parts.append(e.select("seq", order.alias("ord"), F.lit(op).alias("op"), F.lit(t).alias("type"), F.col("e._id").alias("id"), F.col("e._version").alias("version"), F.col("e._timestamp").alias("ts"), tags.alias("tags"), refs.alias("refs"), roles.alias("roles"), x.alias("x"), y.alias("y")))
    return reduce(DataFrame.union, parts)


def states(spark: SparkSession, path: str) -> DataFrame:
    """``(sequence, timestamp)`` of the state files under a path: key=value lines in which colons are escaped."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    time = F.regexp_replace(F.regexp_extract("value", r"(?m)^timestamp=(.*?)\s*$", 1), r"\\:", ":")
    return text.select(F.regexp_extract("value", r"(?m)^sequenceNumber=(\d+)", 1).try_cast("long").alias("sequence"), F.to_timestamp(time).alias("timestamp"))
