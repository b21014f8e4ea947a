"""IP address helpers as column expressions (no join, no UDF)."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_RE = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_V4_TAIL = rf"^(.*:){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def is_ipv4(c: Column) -> Column:
    return F.coalesce(c.rlike(IPV4_RE), F.lit(False))


def once(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated once for each row, however often ``use`` names
    it: an expression that is written into another several times is evaluated as
    often, and a chain of such ones as often as the product."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def ipv6_hex(c: Column) -> Column:
    """IPv6 text in any spelling -> its 128 bits as 32 hex digits; NULL when it
    isn't a valid address. A zone (``%eth0``) is left out, a dotted-quad tail
    counts as two groups."""
    return once(c, lambda x: F.when(x.contains(":"), _hex_of_groups(x)))  # anything else needs no parsing


def _hex_of_groups(c: Column) -> Column:
    low = once(F.lower(F.regexp_replace(c, r"%[^%/]+$", "")), _without_quad)
    return once(F.split(low, "::"), _hex_of_sides)


def _without_quad(low: Column) -> Column:
    """A dotted-quad tail as two groups."""
    octet = [F.conv(F.regexp_extract(low, _V4_TAIL, k), 10, 16) for k in (2, 3, 4, 5)]
    quad = F.concat(octet[0], F.lpad(octet[1], 2, "0"), F.lit(":"), octet[2], F.lpad(octet[3], 2, "0"))
    return F.when(low.rlike(_V4_TAIL), F.concat(F.regexp_extract(low, _V4_TAIL, 1), F.lower(quad))).otherwise(low)


def _hex_of_sides(sides: Column) -> Column:
    """The texts before and after ``::`` (one text without it)."""
    def groups(side: Column) -> Column:
        return F.when(F.coalesce(side, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))

    left, right = groups(F.get(sides, 0)), groups(F.get(sides, 1))
    given, gap = F.size(left) + F.size(right), F.size(sides) == 2
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - given)), right)
    sized = (F.size(sides) <= 2) & F.when(gap, given <= 7).otherwise(given == 8)
    return F.when(sized, once(whole, lambda w: F.when(
        F.forall(w, lambda g: g.rlike("^[0-9a-f]{1,4}$")),
        F.array_join(F.transform(w, lambda g: F.lpad(g, 4, "0")), ""))))


def is_ipv6(c: Column) -> Column:
    return ipv6_hex(c).isNotNull()


def ipv4_to_long(c: Column) -> Column:
    """Dotted quad -> BIGINT (NULL when not a valid IPv4 address)."""
    p = F.split(c, r"\.")
    n = (p.getItem(0).cast("long") * 16777216 + p.getItem(1).cast("long") * 65536
         + p.getItem(2).cast("long") * 256 + p.getItem(3).cast("long"))
    return F.when(is_ipv4(c), n)


def address_hex(c: Column) -> Column:
    """An address as hex digits: 8 for IPv4, 32 for IPv6; NULL for anything else."""
    return F.coalesce(F.lower(F.lpad(F.hex(ipv4_to_long(c)), 8, "0")), ipv6_hex(c))


def prefix_key(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits of ``address_hex`` text, as a key that tells families
    and lengths apart."""
    whole = F.floor(bits / 4).cast("int")
    rest = (bits % 4).cast("int")
    nibble = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    part = F.when(rest > 0, F.call_function("shiftright", nibble, 4 - rest))
    return F.concat_ws("/", F.length(digits).cast("string"), bits.cast("string"),
                       F.substring(digits, F.lit(1), whole), part.cast("string"))


def cidr_bounds(cidr: str) -> tuple[int, int] | None:
    """IPv4 CIDR -> (lo, hi) as integers; None for IPv6 networks."""
    net, _, bits = cidr.partition("/")
    if ":" in net:
        return None
    a, b, c, d = (int(x) for x in net.split("."))
    base = (a << 24) | (b << 16) | (c << 8) | d
    size = 1 << (32 - int(bits or 32))
    lo = base & ~(size - 1) & 0xFFFFFFFF
    return lo, lo + size - 1


def in_ipv4_ranges(ipnum: Column, cidrs) -> Column:
    """OR of ``between`` terms over a fixed, small CIDR list."""
    cond = F.lit(False)
    for cidr in cidrs:
        b = cidr_bounds(cidr)
        if b is not None:
            cond = cond | ipnum.between(b[0], b[1])
    return cond


def in_ipv6_ranges(address: Column, cidrs) -> Column:
    """OR over a fixed, small list: the leading bits of ``ipv6_hex`` text are those
    of the network."""
    return once(address, lambda x: _in_ipv6_ranges(x, cidrs))


def _in_ipv6_ranges(address: Column, cidrs) -> Column:
    cond = F.lit(False)
    for cidr in cidrs:
        if ":" not in cidr:
            continue
        net = ipaddress.ip_network(cidr)
        digits = f"{int(net.network_address):032x}"
        whole, bits = divmod(net.prefixlen, 4)
        hit = F.substring(address, 1, whole) == digits[:whole] if whole else F.lit(True)
        if bits:
            nibble = F.conv(F.substring(address, whole + 1, 1), 16, 10).cast("int")
            hit = hit & (F.shiftright(nibble, 4 - bits) == int(digits[whole], 16) >> (4 - bits))
        cond = cond | hit
    return F.coalesce(cond, F.lit(False))


def host_ipv4_to_long(c: Column) -> Column:
    """IPv4 host of a URL as resolvers read it -> BIGINT: one to four numbers,
    decimal, octal (0...) or hex (0x...), the last filling the bytes that are left;
    NULL when it isn't one."""
    return once(F.split(F.lower(c), r"\."), _long_of_parts)


def _long_of_parts(parts: Column) -> Column:
    number = F.transform(parts, lambda p: F.when(p.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substr(p, F.lit(3)), 16, 10))
                         .when(p.rlike("^0[0-7]{1,11}$"), F.conv(p, 8, 10))
                         .when(p.rlike("^(0|[1-9][0-9]{0,9})$"), p).cast("long"))
    return F.when(F.size(parts) <= 4, once(number, _long_of_numbers))


def _long_of_numbers(number: Column) -> Column:
    n = F.size(number)
    last = F.element_at(number, -1)
    head = F.slice(number, 1, F.greatest(F.lit(0), n - 1))
    room = F.when(n == 1, 1 << 32).when(n == 2, 1 << 24).when(n == 3, 1 << 16).otherwise(1 << 8)
    fits = (F.forall(number, lambda x: x.isNotNull()) & F.forall(head, lambda x: x <= 255)
            & (last < room))
    lead = F.aggregate(head, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
    return F.when(fits, lead * room + last)
