"""Small numeric helpers, each a Column expression."""

from pyspark.sql import Column, functions as F

PCAP_RECORD_HEADER = 16
ETHERNET_HEADER = 14


def rel_diff_truncated(value: Column, reference: Column) -> Column:
    """Both sides cut to integers, divided by the exact reference; NULL for a zero reference."""
    gap = F.abs(value.cast("long") - reference.cast("long"))
    return F.try_divide(gap.cast("double"), reference.cast("double"))


def rel_diff_percent(value: Column, reference: Column) -> Column:
    """Percent off the reference; 0 when both are 0, 100 when only the reference is."""
    return (
        F.when(reference != 0, F.abs(value - reference) * 100 / reference)
        .when(value == 0, F.lit(0.0))
        .otherwise(F.lit(100.0))
    )


def diff_ratio(target: Column, actual: Column) -> Column:
    """Share by which the actual value misses the target, 0 for a zero target."""
    target, actual = target.cast("double"), actual.cast("double")
    return F.when(target == 0, F.lit(0.0)).otherwise(F.abs(target - actual) / target)


def size_class(bytes_total: Column, packets_total: Column) -> Column:
    average = F.floor(bytes_total / packets_total)
    return (
        F.when(average <= 128, "small").when(average <= 512, "medium").when(average <= 1024, "large").otherwise("huge")
    )


def packets_between(low: Column, high: Column, start: Column, end: Column, packets: Column) -> Column:
    """Packets of a flow inside ``[low, high]`` when spread evenly; a flow without length counts whole."""
    inside = F.least(high, end) - F.greatest(low, start)
    return (
        F.when((high < start) | (low > end), F.lit(0.0))
        .when(start == end, packets.cast("double"))
        .otherwise(inside.cast("double") / (end - start) * packets)
    )


def metric_units(value: Column) -> Column:
    """Two decimals and a unit out of none, ``k M G T P``; a unit is used above (not at) its thousand."""
    number = value.cast("double")

    def fixed(value: Column, unit: str) -> Column:
        return F.concat(F.call_function("format_number", value, F.lit("0.00")), F.lit(f" {unit}"))

    text = fixed(number, "")
    for power, unit in enumerate("kMGTP", start=1):
        text = F.when(number > 1000.0**power, fixed(number / F.lit(1000.0**power), unit)).otherwise(text)
    return text


def disk_size(packets: Column, bytes_total: Column) -> Column:
    """Estimated capture size: bytes with 10 % reserve plus record and link headers per packet."""
    return F.floor(bytes_total * 1.1) + packets * (PCAP_RECORD_HEADER + ETHERNET_HEADER)


def scale_time(value: Column, multiplier: float) -> Column:
    return (value * F.lit(float(multiplier))).cast("long")


def mbps_to_bytes_per_second(mbps: Column | float) -> Column | float:
    return mbps * 125000


def speed_tokens(kind: Column, value: Column) -> Column:
    """Tokens per second of a replay speed: packets for ``pps``, bytes for ``mbps``, nanoseconds for ``multiplier``."""
    return (
        F.when(kind == "mbps", value * 125000).when(kind == "pps", value).when(kind == "multiplier", value * 10**9)
    ).cast("long")
