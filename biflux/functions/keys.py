"""Direction-free flow keys and direction changes."""

from pyspark.sql import Column, DataFrame, functions as F

CANON = ["a_ip", "b_ip", "a_port", "b_port"]
EPHEMERAL_PORT = 32768


def swapped(tie_on_port: bool = False, src="src_ip", dst="dst_ip", sport="src_port", dport="dst_port") -> Column:
    """True when source and destination have to change places to get the canonical order.

    With ``tie_on_port`` flows between equal addresses are ordered by port, otherwise both directions keep their own key.
    """
    swap = F.col(src) > F.col(dst)
    if tie_on_port:
        swap = swap | ((F.col(src) == F.col(dst)) & (F.col(sport) > F.col(dport)))
    return swap


def with_canonical_key(df: DataFrame, tie_on_port: bool = False) -> DataFrame:
    """Add ``swap`` and the canonical ``a_ip, b_ip, a_port, b_port``."""
    pairs = [("src_ip", "dst_ip", "a_ip"), ("dst_ip", "src_ip", "b_ip"),
             ("src_port", "dst_port", "a_port"), ("dst_port", "src_port", "b_port")]
    return df.withColumn("swap", swapped(tie_on_port)).withColumns({
        out: F.when(F.col("swap"), F.col(other)).otherwise(F.col(own)) for own, other, out in pairs
    })


def zero_ports(protocol: str, port: str) -> Column:
    """Ports exist for TCP (6) and UDP (17) only."""
    return F.when(F.col(protocol).isin(6, 17), F.col(port)).otherwise(0).cast("int")


def l3_from_text(address: Column) -> Column:
    return F.when(address.contains(":"), 6).otherwise(4).cast("int")


def flip_ephemeral(df: DataFrame) -> DataFrame:
    """Make the side with the ephemeral port the source: a low source port talking to a high destination port flips."""
    flip = (F.col("src_port") < EPHEMERAL_PORT) & (F.col("dst_port") >= EPHEMERAL_PORT)
    pairs = [("src_port", "dst_port"), ("packets", "packets_rev"), ("bytes", "bytes_rev")]
    pairs += [p for p in [("src_ip", "dst_ip")] if p[0] in df.columns]
    changes = {}
    for left, right in pairs:
        changes[left] = F.when(flip, F.col(right)).otherwise(F.col(left))
        changes[right] = F.when(flip, F.col(left)).otherwise(F.col(right))
    return df.withColumns(changes)
