"""IP addresses as canonical lowercase hex text: 8 digits for IPv4, 32 for IPv6.

At a fixed width text order is numeric order, so subnet tests are plain BETWEEN predicates that can be pushed to a scan.
"""

import ipaddress

from pyspark.sql import Column, functions as F

V4, V6 = 8, 32
_V4_PATTERN = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
_V6_PATTERN = r"^([0-9a-f]{1,4}:|:)+([0-9a-f]{1,4}|:)?$"
_DOTTED_TAIL = r"^(.*:)(\d+)\.(\d+)\.(\d+)\.(\d+)$"


def _hex(value: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), width, "0")


def _groups(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ":"), lambda x: x != ""), lambda x: F.lpad(x, 4, "0"))


def ip_parse(address: Column) -> Column:
    """Text address -> canonical hex; NULL when the text is no address."""
    text = F.lower(F.trim(address))
    v4 = F.array_join(F.transform(F.split(text, "[.]"), lambda x: _hex(x.cast("int"), 2)), "")

    def tail(group: int) -> Column:
        high, low = (F.regexp_extract(text, _DOTTED_TAIL, group + i).cast("int") for i in (0, 1))
        return F.lower(F.hex(high * 256 + low))

    plain = F.when(
        text.rlike(_DOTTED_TAIL),
        F.concat(F.regexp_extract(text, _DOTTED_TAIL, 1), tail(2), F.lit(":"), tail(4)),
    ).otherwise(text)
    left = _groups(F.split_part(plain, F.lit("::"), F.lit(1)))
    right = _groups(F.split_part(plain, F.lit("::"), F.lit(2)))
    gap = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
    v6 = F.when(
        plain.contains("::"),
        F.when(gap > 0, F.array_join(F.concat(left, F.array_repeat(F.lit("0000"), gap), right), "")),
    ).otherwise(F.array_join(_groups(plain), ""))
    valid = plain.rlike(_V6_PATTERN) & (F.size(F.split(plain, "::")) <= 2) & ~plain.contains(":::")
    return F.when(text.rlike(_V4_PATTERN), v4).when(valid & (F.length(v6) == V6), v6)


def ip_format(ip: Column) -> Column:
    """Canonical hex -> text, with the longest run of zero groups shortened for IPv6."""
    def number(i: int) -> Column:
        return F.conv(F.substring(ip, 2 * i + 1, 2), 16, 10)

    v4 = F.concat_ws(".", *[number(i) for i in range(4)])
    groups = F.concat_ws(":", *[F.lower(F.conv(F.substring(ip, 4 * i + 1, 4), 16, 16)) for i in range(8)])
    fenced = F.concat(F.lit(":"), groups, F.lit(":"))
    v6 = groups
    for run in range(2, 9):
        zeros = ":0" * run + ":"
        at = F.instr(fenced, zeros)
        head = F.rtrim(F.substring(fenced, F.lit(2), at - 2))
        rest = F.substring(fenced, at + len(zeros), F.length(fenced) - at - len(zeros))
        v6 = F.when(at > 0, F.concat(head, F.lit("::"), rest)).otherwise(v6)
    return F.when(F.length(ip) == V4, v4).when(F.length(ip) == V6, v6)


def ip_version(ip: Column) -> Column:
    return F.when(F.length(ip) == V4, 4).when(F.length(ip) == V6, 6).cast("int")


def ip_add(ip: Column, offset: Column | int) -> Column:
    """Add to the first 32 bits, wrapping: the whole of an IPv4 address, the top of an IPv6 address."""
    top = F.conv(F.substring(ip, 1, 8), 16, 10).cast("long")
    moved = F.pmod(top + (F.lit(offset) if isinstance(offset, int) else offset), F.lit(1 << 32))
    return F.concat(_hex(moved, 8), F.substring(ip, F.lit(9), F.length(ip)))


def network_bounds(cidr: str) -> tuple[str, str]:
    """First and last address of a subnet in canonical hex."""
    network = ipaddress.ip_network(cidr)
    width = V4 if network.version == 4 else V6
    return tuple(format(int(a), f"0{width}x") for a in (network[0], network[-1]))


def ip_in(ip: Column, cidr: str) -> Column:
    low, high = network_bounds(cidr)
    return (F.length(ip) == len(low)) & ip.between(low, high)


def net_add_offset(cidr: str, offset: int) -> str:
    """Move a subnet the way the replayer moves addresses; an impossible result leaves the subnet as it is."""
    network = ipaddress.ip_network(cidr)
    first = int(network.network_address)
    try:
        if network.version == 6:
            moved = ipaddress.IPv6Address((first + (offset << 96)) % (1 << 128))
        else:
            moved = network.network_address + offset
        return str(ipaddress.ip_network((moved, network.prefixlen)))
    except ValueError:
        return str(network)


def replicator_prefix(needed: int, default: int, *ranges: list[str] | str | None) -> int:
    """Prefix length left for replication units: the default one if the configured ranges allow it."""
    lengths = [32]
    for item in ranges:
        for cidr in [item] if isinstance(item, str) else item or []:
            lengths.append(int(cidr.split()[0].split("/")[1]))
    configured = min(lengths)
    if configured < needed:
        raise ValueError(f"ranges leave {configured} prefix bits, {needed} are needed")
    return default if needed <= default <= configured else needed
