"""IP addresses as hex digits (8 for v4, 32 for v6), and address ranges looked up by prefix."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_QUAD = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}"
_V4 = f"^{_QUAD}$"
#: Groups of up to four digits; at most one "::", and no other empty group. How many there are is counted apart.
_V6 = (
    r"^(?=[0-9A-Fa-f:.]*$)(?!.*::.*::)(?!.*:::)(?!:[^:])(?!.*[^:]:$)"
    rf"(?:[0-9A-Fa-f]{{0,4}}:){{2,8}}(?:[0-9A-Fa-f]{{0,4}}|{_QUAD})$"
)
_LAST_QUAD = r"(?:^|:)([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})$"


def readable(ip: Column) -> Column:
    """Whether a text is an address: four numbers, or eight groups of digits, some of which ``::`` and a dotted quad can stand for."""
    groups = F.size(F.filter(F.split(ip, ":"), lambda g: g != "")) + F.contains(ip, F.lit(".")).cast("int")
    counted = F.when(F.contains(ip, F.lit("::")), groups <= 7).otherwise(groups == 8)
    return F.when(F.contains(ip, F.lit(":")), F.when(ip.rlike(_V6), counted).otherwise(False)).otherwise(ip.rlike(_V4))


def with_hex(df: DataFrame, ip: str, name: str) -> DataFrame:
    """Adds the digits of a readable address: ``::`` expanded, a trailing dotted quad folded in.

    Every intermediate is a column of its own, so nothing is parsed twice.
    """
    is_v6 = F.contains(F.col(ip), F.lit(":"))

    def octet(i: int) -> Column:
        return F.get("_octets", F.lit(i))

    def groups(side: str) -> Column:
        return F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")

    number = ((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3)
    pair = F.concat(
        F.regexp_extract(ip, "^(.*:)", 1),
        F.hex(octet(0) * 256 + octet(1)), F.lit(":"), F.hex(octet(2) * 256 + octet(3)),
    )
    missing = F.greatest(F.lit(8) - F.size("_left") - F.size("_right"), F.lit(0))
    return (
        df.withColumn("_tail", F.split(F.nullif(F.regexp_extract(ip, _LAST_QUAD, 1), F.lit("")), r"\."))
        .withColumn("_octets", F.col("_tail").cast("array<bigint>"))
        .withColumn("_text", F.when(is_v6, F.lower(F.when(F.col("_octets").isNotNull(), pair).otherwise(F.col(ip)))))
        .withColumn("_halves", F.split("_text", "::"))
        .withColumn("_before", F.get("_halves", F.lit(0)))
        .withColumn("_after", F.get("_halves", F.lit(1)))
        .withColumn("_left", groups("_before"))
        .withColumn("_right", groups("_after"))
        .withColumn("_all", F.concat("_left", F.array_repeat(F.lit("0"), missing), "_right"))
        # out of a generator, so that no later use works it out again
        .withColumn(name, F.explode_outer(F.array(
            F.when(is_v6, F.array_join(F.transform("_all", lambda g: F.lpad(g, 4, "0")), "")).otherwise(F.lower(F.lpad(F.hex(number), 8, "0")))
        )))
        .drop("_tail", "_octets", "_text", "_halves", "_before", "_after", "_left", "_right", "_all")
    )


def _prefix(digits: Column, bits: int) -> Column:
    """The first bits: whole digits, then the value of what is left of the next one."""
    whole = F.substring(digits, 1, bits // 4)
    if bits % 4 == 0:
        return whole
    next_digit = F.conv(F.substring(digits, bits // 4 + 1, 1), 16, 10).cast("int")
    return F.concat(whole, F.shiftright(next_digit, 4 - bits % 4).cast("string"))


def _listed(spark: SparkSession, cidrs: Sequence[str]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """digits, bits and prefix of ranges given as a list; a wrong one raises."""
    rows = []
    for net in map(ipaddress.ip_network, cidrs):
        digits = 8 if net.version == 4 else 32
        text, bits = format(int(net.network_address), f"0{digits}x"), net.prefixlen
        rest = str(int(text[bits // 4], 16) >> (4 - bits % 4)) if bits % 4 else ""
        rows.append((digits, bits, text[: bits // 4] + rest))
    return spark.createDataFrame(rows, "digits int, bits int, prefix string"), sorted({r[:2] for r in rows})


def _parsed(rules: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The same for a table with a column ``cidr`` (address/bits) of any size."""
    parts = rules.select("cidr", F.split("cidr", "/").alias("_p"))
    parts = parts.select("cidr", F.get("_p", F.lit(0)).alias("_net"), F.get("_p", F.lit(1)).try_cast("int").alias("bits"), F.size("_p").alias("_n"))
    known = F.coalesce(readable(F.col("_net")), F.lit(False))
    staged = with_hex(parts.withColumn("_net", F.when(known, F.col("_net"))), "_net", "_hex").withColumn("digits", F.length("_hex"))
    fits = F.coalesce((F.col("_n") == 2) & F.col("bits").between(0, F.col("digits") * 4), F.lit(False))
    kinds = staged.groupBy("digits", "bits", fits.alias("fits")).agg(F.min("cidr").alias("one")).collect()  # at most one row a length, and wrong ones
    wrong = [r.one for r in kinds if not r.fits]
    if wrong:
        raise ValueError(f"not an address range: {wrong[0]!r}")
    lengths = sorted((r.digits, r.bits) for r in kinds)
    prefix = F.coalesce(*(F.when((F.col("digits") == d) & (F.col("bits") == b), _prefix(F.col("_hex"), b)) for d, b in lengths), F.lit(None))
    return staged.select("digits", "bits", prefix.alias("prefix")), lengths


def with_blocked(df: DataFrame, ip: str, name: str, rules: DataFrame | Sequence[str]) -> DataFrame:
    """Adds whether the address lies in one of the ranges; null for no address.

    There is one hash join for each length of prefix that occurs, however many ranges have it.
    """
    table, lengths = _parsed(rules) if isinstance(rules, DataFrame) else _listed(df.sparkSession, rules)
    out, hits = with_hex(df, ip, "_hex"), []
    for digits, bits in lengths:
        found, key = f"_hit{digits}_{bits}", f"_key{digits}_{bits}"
        own = table.where((F.col("digits") == digits) & (F.col("bits") == bits)).select(F.col("prefix").alias(key), F.lit(True).alias(found))
        out = out.join(own.distinct(), F.when(F.length("_hex") == digits, _prefix(F.col("_hex"), bits)) == F.col(key), "left").drop(key)
        hits.append(F.coalesce(found, F.lit(False)))
    hit = F.lit(False)
    for h in hits:
        hit = hit | h
    return out.withColumn(name, F.when(F.col(ip).isNotNull(), hit)).drop("_hex", *(f"_hit{d}_{b}" for d, b in lengths))
