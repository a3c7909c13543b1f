"""Readers for flow tables in text form.

Rows that cannot be used are never dropped silently: parsers return the good rows and the rejected ones with a reason.
"""

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from biflux.functions.ip import ip_parse
from biflux.runtime import broadcast_if_small, durable, once
from biflux.schemas import PROFILE_COLUMNS, RAWFLOW, UNIFLOW, UNIFLOW_COLUMNS, FlowDataError

_INT64, _UINT64 = 2**63 - 1, 2**64 - 1
PROFILE_HEADER = [c.upper() for c in PROFILE_COLUMNS]


class Parsed(NamedTuple):
    rows: DataFrame
    rejected: DataFrame


def as_uniflow(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A path or a frame that has the uniflow columns already."""
    if isinstance(source, DataFrame):
        missing = set(UNIFLOW_COLUMNS) - set(source.columns)
        if missing:
            raise FlowDataError(f"columns {sorted(missing)} missing")
        return source
    return read_uniflow(spark, source)


def read_uniflow(spark: SparkSession, path: str, where: str | None = None, limit: int | None = None, numbered: bool = False) -> DataFrame:
    """Exported or expected flow CSV. Each file's own header gives its order of columns; empty ports are 0; a bad cell fails
    the read, and so does a file without one of the columns. ``numbered`` adds ``arrival_seq``, the place in the files."""
    lines = _content(spark, path, [f.name.upper() for f in UNIFLOW.fields])

    def parsed(name: str, kind: str) -> Column:
        cell = F.col(name)
        value = ip_parse(cell) if name.endswith("_IP") else cell.try_cast(kind)
        return F.when(F.coalesce(cell, F.lit("")) == "", 0).otherwise(value) if name.endswith("_PORT") else value

    def typed(name: str, kind: str) -> Column:
        reason = F.concat(F.lit(f"{name} unreadable in "), "file", F.lit(": "), "value")
        return F.when(F.col(name).isNull(), F.raise_error(reason)).otherwise(F.col(name)).cast(kind).alias(name.lower())

    place = ["arrival_seq"] if numbered else []
    kinds = {f.name.upper(): f.dataType.simpleString() for f in UNIFLOW.fields}
    # Spark copies costly columns into each reader: cells are taken once, then parsed once.
    cells = once(lines.select("file", "value", "cells", "header", *place), {n: _cell(n) for n in kinds})
    values = once(cells.drop("cells", "header"), {n: parsed(n, kind) for n, kind in kinds.items()})
    flows = values.select(*[typed(n, kind) for n, kind in kinds.items()], *place)
    return _narrowed(flows, where, limit)


def _narrowed(df: DataFrame, where: str | None, limit: int | None) -> DataFrame:
    df = df if where is None else df.where(where)
    return df if limit is None else df.limit(limit)


def _placed(text: DataFrame) -> DataFrame:
    """Lines with their file, the start of their block in it, and a number that rises inside the block."""
    return text.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))


def _is_content() -> Column:
    text = F.trim("value")
    return (text != "") & ~text.startswith("#")


def _blocks(placed: DataFrame) -> DataFrame:
    """Per block of a file: the number of lines before it in all files (by name, then place), its first ``at``, and block
    and ``at`` of the first line of its file that is neither blank nor a comment.

    One row per block, from one pass with sums per task; the running sum goes over blocks, not lines. It counts lines, so
    the numbers are the same however the files are cut and however often a task is repeated.
    """
    counted = placed.groupBy("_file", "_block").agg(F.count("*").alias("lines"), F.min("_at").alias("first"), F.min(F.when(_is_content(), F.col("_at"))).alias("content"))
    name = F.url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B")))
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("name", "_block").rowsBetween(Window.unboundedPreceding, -1)
    head = F.first(F.when(F.col("content").isNotNull(), F.struct("_block", "content")), ignorenulls=True).over(in_file)
    found = counted.withColumns({"name": name, "head": head})
    found = found.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    return durable(found.select("_file", "_block", "first", "before", F.col("head._block").alias("head_block"), F.col("head.content").alias("head_at")))


def with_arrival(lines: DataFrame) -> DataFrame:
    """Number the lines of text files by file name and place in the file, from 0 on without gaps."""
    placed = _placed(lines)
    numbered = placed.join(broadcast_if_small(_blocks(placed)), ["_file", "_block"])
    return numbered.select(*lines.columns, (F.col("before") + F.col("_at") - F.col("first")).alias("arrival_seq"))


def _content(spark: SparkSession, path: str, needed: list[str], known: list[str] | None = None) -> DataFrame:
    """Lines below the header of their file: ``value, cells, header`` (its names), ``file, arrival_seq``.

    The first line of a file that is neither blank nor a comment is its header. Files without one, or whose header lacks
    a needed column, has one twice or (with ``known``) one that is not known, are an error. Blank lines and comments are
    left out. The text is read three times: counts per block, headers, rows.
    """
    try:
        placed = _placed(spark.read.text(path))
        blocks = _blocks(placed)
    except Exception as err:
        raise FlowDataError(f"unable to read {path}") from err
    blocks = broadcast_if_small(blocks)
    own_head = (F.col("_block") == F.col("head_block")) & (F.col("_at") == F.col("head_at"))
    names = F.transform(F.split("value", ","), lambda c: F.trim(c))
    headers = durable(placed.join(blocks, ["_file", "_block"]).where(own_head).select("_file", names.alias("header")))
    wrong = {
        "no column " + n: ~F.array_contains("header", n) for n in needed} | {"a column twice": F.size("header") != F.size(F.array_distinct("header"))}
    if known is not None:
        wrong["an unknown column"] = F.size(F.array_except("header", F.array(*[F.lit(n) for n in known]))) > 0
    fault = F.coalesce(*[F.when(holds, F.lit(text)) for text, holds in wrong.items()])
    bad = headers.select(F.col("_file").alias("file"), fault.alias("fault")).where("fault IS NOT NULL").first()
    if bad is not None:
        raise FlowDataError(f"{bad.file} has {bad.fault}")
    lost = blocks.where("head_at IS NULL").first()
    if lost is not None or headers.isEmpty():
        raise FlowDataError(f"{lost["_file"] if lost else path} has no header")
    # Joined by block, not by file: a file of any size spreads.
    found = placed.join(broadcast_if_small(blocks.join(headers, "_file")), ["_file", "_block"])
    return found.where(_is_content() & ~own_head).select(
        F.trim("value").alias("value"), F.transform(F.split(F.trim("value"), ","), lambda c: F.trim(c)).alias("cells"), "header", F.col("_file").alias("file"),
        (F.col("before") + F.col("_at") - F.col("first")).alias("arrival_seq"))


def _cell(name: str) -> Column:
    """The cell below a name of the row's own header; null if either is missing."""
    return F.get("cells", (F.array_position("header", name) - 1).cast("int"))


def _number(text: Column, low: int, high: int) -> Column:
    value = text.try_cast("bigint" if high <= _INT64 else "decimal(20,0)")
    return F.when(text.rlike(r"^-?\d+$") & value.between(low, high if high <= _INT64 else F.lit(Decimal(high))), value)


# Address versions and transport protocols a profile may have (ICMP, TCP, UDP, ICMPv6).
L3, L4 = (4, 6), (1, 6, 17, 58)


def parse_profile(lines: DataFrame, header: list[str], skip_unknown: bool = False, wide: bool = False) -> Parsed:
    """Profile lines (``value``) -> typed rows. ``header`` gives the column order, SRC_IP and DST_IP are optional.

    Rejected lines carry ``error``; with ``skip_unknown`` a line with an unknown transport protocol is only skipped,
    which its ``skipped`` flag tells. Counters are 64-bit integers; with ``wide`` they are decimals and may go up to
    2**64 - 1.
    """
    known = [*PROFILE_HEADER, "SRC_IP", "DST_IP"]
    for name in header:
        if name not in known:
            raise FlowDataError(f"invalid component in header {name!r}")
    if len(set(header)) != len(header):
        raise FlowDataError("a header component appears twice")
    if set(PROFILE_HEADER) - set(header):
        raise FlowDataError(f"components {sorted(set(PROFILE_HEADER) - set(header))} missing in header")
    keep = [c for c in lines.columns if c != "value"]
    cells = lines.withColumns({"cells": F.transform(F.split("value", ","), lambda c: F.trim(c)), "header": F.array(*[F.lit(n) for n in header])})
    return _profile_rows(cells, keep, [n for n in ("SRC_IP", "DST_IP") if n in header], skip_unknown, wide)


def _profile_rows(cells: DataFrame, keep: list[str], addresses: list[str], skip_unknown: bool, wide: bool) -> Parsed:
    most = _UINT64 if wide else _INT64
    # Spark copies costly columns into each reader, the filter on errors too: cells are taken once, then parsed once.
    names = [*PROFILE_HEADER, *addresses]
    cells = once(cells, {"_fits": F.size("cells") == F.size("header"), **{f"_{n}": _cell(n) for n in names}})
    cell = {n: F.col(f"_{n}") for n in names}
    limits = {
        "START_TIME": (-_INT64, _INT64), "END_TIME": (-_INT64, _INT64), "L3_PROTO": (0, 255), "L4_PROTO": (0, 255),
        "SRC_PORT": (0, 65535), "DST_PORT": (0, 65535), **{c: (0, most) for c in PROFILE_HEADER[6:]},
    }
    values = {n: _number(F.when(cell[n] == "", "0").otherwise(cell[n]) if n.endswith("_PORT") else cell[n], *b) for n, b in limits.items()}
    typed = once(cells, {
        n.lower(): v.cast("int" if n.endswith(("PROTO", "PORT")) else "decimal(20,0)" if limits[n][1] > _INT64 else "long") for n, v in values.items()} | {
        n.lower(): F.when(cell[n] != "", ip_parse(cell[n])) for n in addresses})

    def unreadable(names: list[str]) -> list[tuple[str, str, Column]]:
        return [(n.lower(), "no number in range", F.col(n).isNull()) for n in names]

    # what a row may fail, as (column, reason, failed); the first that holds is told
    digits = F.when(F.col("l3_proto") == 4, 8).otherwise(32)
    checks = [
        ("line", "cells do not match the header", ~F.col("_fits")),
        *unreadable(PROFILE_HEADER[:3]), ("l3_proto", "not supported", ~F.col("l3_proto").isin(*L3)),
        *unreadable(["L4_PROTO"]), ("l4_proto", "not supported", ~F.col("l4_proto").isin(*L4)),
        *unreadable(PROFILE_HEADER[4:]),
        *[(n.lower(), "no address of this version", (cell[n] != "") & ~F.length(n.lower()).eqNullSafe(digits)) for n in addresses],
        ("end_time", "before the start", F.col("end_time") < F.col("start_time")),
    ]
    error = F.coalesce(*[F.when(failed, f"{column}: {reason}") for column, reason, failed in checks])
    judged = typed.withColumn("error", error)
    no_ports = F.col("l4_proto").isin(1, 58)
    good = judged.where(F.col("error").isNull()).withColumns(
        {c: F.when(no_ports, 0).otherwise(F.col(c)) for c in ("src_port", "dst_port")})
    skipped = F.lit(skip_unknown) & (F.col("error") == "l4_proto: not supported")
    return Parsed(
        good.select(*keep, *PROFILE_COLUMNS, *[n.lower() for n in addresses]),
        judged.where(F.col("error").isNotNull()).select(*keep, "value", "error", skipped.alias("skipped")))


def read_profile(spark: SparkSession, path: str, skip_unknown: bool = False, wide: bool = False) -> Parsed:
    """Profile CSV files, each with the columns in the order of its own header."""
    lines = _content(spark, path, PROFILE_HEADER, [*PROFILE_HEADER, "SRC_IP", "DST_IP"])
    named = lines.agg(*[F.coalesce(F.bool_or(F.array_contains("header", n)), F.lit(False)).alias(n) for n in ("SRC_IP", "DST_IP")]).first()
    return _profile_rows(lines, [], [n for n in ("SRC_IP", "DST_IP") if named[n]], skip_unknown, wide)


def strict_profile(parsed: DataFrame) -> Parsed:
    """The stricter rules of the sampler: something has to be transferred."""
    error = F.when(F.col("packets") + F.col("packets_rev") == 0, "no packets").when(
        F.col("bytes") + F.col("bytes_rev") == 0, "no bytes")
    judged = parsed.withColumn("error", error)
    return Parsed(judged.where(F.col("error").isNull()).drop("error"), judged.where(F.col("error").isNotNull()))


def parse_summary(parsed: Parsed) -> DataFrame:
    """Loaded and skipped records, packets and bytes."""
    loaded = parsed.rows.agg(
        F.count("*").alias("parsed"), F.coalesce(F.sum(F.col("packets") + F.col("packets_rev")), F.lit(0)).alias("packets"),
        F.coalesce(F.sum(F.col("bytes") + F.col("bytes_rev")), F.lit(0)).alias("bytes"))
    rest = parsed.rejected.agg(F.count_if("skipped").alias("skipped"), F.count_if(~F.col("skipped")).alias("failed"))
    return loaded.withColumn("_j", F.lit(1)).join(rest.withColumn("_j", F.lit(1)), "_j").drop("_j")


def _typed(rows: DataFrame, values: dict[str, Column], keep: list[str]) -> Parsed:
    """Cast cells; a row with a cell that does not fit is rejected."""
    types = {f.name: f.dataType.simpleString() for f in RAWFLOW.fields}
    cast = rows.select(*keep, "value", *[v.try_cast(types[n]).alias(n) for n, v in values.items()])
    bad = F.lit(False)
    for name in values:
        bad = bad | F.col(name).isNull()
    return Parsed(cast.where(~bad).drop("value"), cast.where(bad).select(*keep, "value"))


def read_rawflow(spark: SparkSession, path: str, where: str | None = None, limit: int | None = None) -> Parsed:
    """Raw flow CSV (start and duration in float seconds) with ``arrival_seq`` in file order; each file has its own header."""
    needed = [f.name.upper() for f in RAWFLOW.fields]
    parsed = _typed(_content(spark, path, needed), {n.lower(): _cell(n) for n in needed}, ["arrival_seq"])
    return Parsed(_narrowed(parsed.rows, where, limit), parsed.rejected)


def parse_flow_json(lines: DataFrame) -> Parsed:
    """One JSON object per line, brackets and trailing commas of a dumped array tolerated.

    Null ports are 0, null addresses and broken lines are rejected. Times are epoch ms.
    """
    text = F.regexp_replace(F.trim("value"), ",$", "")
    names = ["flowstart", "flowend", "proto", "srcip", "dstip", "srcport", "dstport", "pkts", "bytes"]
    body = lines.withColumn("_text", text).where(~F.col("_text").isin("[", "]", ""))
    record = F.from_json("_text", ", ".join(f"{n} string" for n in names), {"mode": "PERMISSIVE"})
    wide = body.withColumn("_r", record)
    keep = [c for c in lines.columns if c != "value"]
    typed = wide.select(
        *keep, "value",
        F.col("_r.flowstart").try_cast("long").alias("start_time"), F.col("_r.flowend").try_cast("long").alias("end_time"),
        F.col("_r.proto").try_cast("int").alias("proto"), F.col("_r.srcip").alias("src_ip"), F.col("_r.dstip").alias("dst_ip"),
        F.coalesce("_r.srcport", F.lit("0")).try_cast("int").alias("src_port"),
        F.coalesce("_r.dstport", F.lit("0")).try_cast("int").alias("dst_port"),
        F.col("_r.pkts").try_cast("long").alias("packets"), F.col("_r.bytes").try_cast("long").alias("bytes"))
    bad = F.lit(False)
    for c in typed.columns[len(keep) + 1:]:
        bad = bad | F.col(c).isNull()
    return Parsed(typed.where(~bad).drop("value"), typed.where(bad).select(*keep, "value"))


def read_flow_json(spark: SparkSession, path: str, where: str | None = None, limit: int | None = None) -> Parsed:
    parsed = parse_flow_json(with_arrival(spark.read.text(path)))
    return Parsed(_narrowed(parsed.rows, where, limit), parsed.rejected)


def parse_flow_text(lines: DataFrame, router: str | None = None, interface: int | None = None) -> Parsed:
    """Comma-separated text export: start ms, duration s, protocol, addresses, ports, packets, bytes
    and, if the export has them, router address and input interface to select by. ARP lines are left out."""
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c))
    at = {n: F.try_element_at(F.col("_cells"), F.lit(i + 1)) for i, n in enumerate(
        ["start_time", "duration", "proto", "src_ip", "dst_ip", "src_port", "dst_port", "packets", "bytes", "router", "interface"])}
    rows = lines.withColumn("_cells", cells).where((F.upper(at["proto"]) != "ARP") | at["proto"].isNull())
    if router is not None:
        rows = rows.where(at["router"] == router)
    if interface is not None:
        rows = rows.where(at["interface"].try_cast("int") == interface)
    keep = [c for c in lines.columns if c != "value"]
    start = at["start_time"].try_cast("long")
    typed = rows.select(
        *keep, "value", start.alias("start_time"), (start + (at["duration"].try_cast("double") * 1000).cast("long")).alias("end_time"),
        at["proto"].try_cast("int").alias("proto"), at["src_ip"].alias("src_ip"), at["dst_ip"].alias("dst_ip"),
        *[at[c].try_cast("int").alias(c) for c in ("src_port", "dst_port")],
        *[at[c].try_cast("long").alias(c) for c in ("packets", "bytes")])
    bad = F.lit(False)
    for c in typed.columns[len(keep) + 1:]:
        bad = bad | F.col(c).isNull()
    return Parsed(typed.where(~bad).drop("value"), typed.where(bad).select(*keep, "value"))


def read_flow_text(spark: SparkSession, path: str, router: str | None = None, interface: int | None = None,
                   where: str | None = None, limit: int | None = None) -> Parsed:
    parsed = parse_flow_text(with_arrival(spark.read.text(path)), router, interface)
    return Parsed(_narrowed(parsed.rows, where, limit), parsed.rejected)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Expected flows, one JSON object per line: ``{"test", "key"?, "at_least_one"?, "flow": {field: value, ...}}``.

    ``flow`` may hold ``_forward`` and ``_reverse`` sections; a list is a set of alternatives, or the items of a list
    field. Gives ``ref_id, test, key, at_least_one, fields, forward, reverse`` with all values as JSON text.
    """
    schema = "test string, key array<string>, at_least_one array<string>, flow map<string,string>"
    lines = with_arrival(spark.read.text(path)).where(F.trim("value") != "")
    parsed = lines.withColumn("_r", F.from_json("value", schema, {"mode": "FAILFAST"}))
    flow = F.col("_r.flow")

    def section(name: str) -> Column:
        return F.from_json(F.try_element_at(flow, F.lit(name)), "map<string,string>")

    return parsed.select(
        F.col("arrival_seq").alias("ref_id"), "_r.test", "_r.key", "_r.at_least_one",
        F.map_filter(flow, lambda k, v: ~k.startswith("_")).alias("fields"),
        section("_forward").alias("forward"), section("_reverse").alias("reverse"))


READERS = {"csv": read_rawflow, "json": read_flow_json, "text": read_flow_text, "profile": read_profile, "uniflow": read_uniflow}


def read(spark: SparkSession, kind: str, path: str, **options):
    """Reader by name; users may add their own to ``READERS``."""
    if kind not in READERS:
        raise FlowDataError(f"unknown reader {kind!r}")
    return READERS[kind](spark, path, **options)


def run_log_totals(lines: DataFrame, key: str = "file", order: str = "line_no") -> DataFrame:
    """Totals of replay logs: last ``N packets`` and ``N bytes``, first start and end (``ms since epoch``)."""
    def number(pattern: str) -> Column:
        found = F.regexp_extract_all("value", F.lit(pattern), 1)
        return F.when(F.size(found) > 0, F.element_at(found, -1)).cast("long")

    marks = lines.select(
        key, order, number(r"(\d+) packets").alias("packets"), number(r"(\d+) bytes").alias("bytes"),
        number(r"Start time:.*\[ms since epoch: (\d+)\]").alias("start_time"),
        number(r"End time:.*\[ms since epoch: (\d+)\]").alias("end_time"))
    return marks.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in ("packets", "bytes")],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in ("start_time", "end_time")])


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    lines = with_arrival(spark.read.text(path).withColumn("file", F.col("_metadata.file_path")))
    return run_log_totals(lines, "file", "arrival_seq")
