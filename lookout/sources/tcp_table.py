"""Kernel TCP table text -> connection rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def hex_ipv4(h: Column) -> Column:
    """Little-endian 8-hex IPv4 -> dotted quad; bad -> 0.0.0.0; other lengths stay raw."""
    n = F.conv(h, 16, 10).cast("long")
    quad = F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (0, 8, 16, 24)])
    good = h.rlike(r"^[0-9A-Fa-f]{8}$")
    return F.when(good, quad).when(F.length(h) == 8, F.lit("0.0.0.0")).otherwise(h)


def hex_port(h: Column) -> Column:
    """Hex port; text that isn't hex -> 0; NULL above FFFF, which is no port."""
    return (F.when(h.rlike(r"^0*[0-9A-Fa-f]{1,4}$"), F.conv(F.right(h, F.lit(4)), 16, 10).cast("int"))
            .when(~h.rlike(r"^[0-9A-Fa-f]+$"), F.lit(0)))


def parse_connection_snapshot(lines: DataFrame, value: str = "value") -> DataFrame:
    """Split on whitespace, need >= 4 fields, decode ``hexip:hexport`` pairs
    and the state code. Bad lines are skipped, and so is the header, which has no
    such pairs: a text reader gives no line numbers to tell it by."""
    parts = F.split(F.trim(F.col(value)), r"\s+")
    states = F.create_map(*[F.lit(x) for kv in S.TCP_STATES.items() for x in kv])
    d = lines.withColumn("__p", parts).filter(F.size("__p") >= 4)
    loc = F.split(F.get(F.col("__p"), 1), ":")
    rem = F.split(F.get(F.col("__p"), 2), ":")
    d = d.filter((F.size(loc) == 2) & (F.size(rem) == 2)
                 & hex_port(F.get(loc, 1)).isNotNull() & hex_port(F.get(rem, 1)).isNotNull())
    keep = [c for c in lines.columns if c != value]
    return d.select(
        *keep,
        hex_ipv4(F.get(loc, 0)).alias("local_ip"), hex_port(F.get(loc, 1)).alias("local_port"),
        hex_ipv4(F.get(rem, 0)).alias("remote_ip"), hex_port(F.get(rem, 1)).alias("remote_port"),
        F.coalesce(states[F.upper(F.get(F.col("__p"), 3))], F.lit("UNKNOWN")).alias("state"))


def render_tcp_table(conns: DataFrame, snap_keys=("host", "snap")) -> DataFrame:
    """Inverse of S5 for building test input: connection rows -> table text lines
    (one header line per snapshot)."""
    def hexip(c):
        n = F.split(c, r"\.")
        v = (n[3].cast("long") * 16777216 + n[2].cast("long") * 65536
             + n[1].cast("long") * 256 + n[0].cast("long"))
        return F.lpad(F.upper(F.hex(v)), 8, "0")
    inv = {v: k for k, v in S.TCP_STATES.items()}
    st = F.create_map(*[F.lit(x) for kv in inv.items() for x in kv])
    body = conns.select(
        *snap_keys,
        F.concat_ws(" ", F.lit("0:"),
                    F.concat(hexip(F.col("local_ip")), F.lit(":"), F.lpad(F.upper(F.hex("local_port")), 4, "0")),
                    F.concat(hexip(F.col("remote_ip")), F.lit(":"), F.lpad(F.upper(F.hex("remote_port")), 4, "0")),
                    F.coalesce(st[F.col("state")], F.lit("00")), F.lit("00000000:00000000 00:00000000 00000000 0")
                    ).alias("value"))
    header = conns.select(*snap_keys).distinct().select(
        *snap_keys, F.lit("  sl  local_address rem_address   st tx_queue rx_queue").alias("value"))
    return header.unionByName(body)
