"""Where a URL may be sent, as a table operator: scheme and userinfo checks, and addresses met with ranges.

Every spelling of an address that a resolver takes (dotted, decimal, octal or hexadecimal parts, one to four of them;
version 6 with or without ::, with an embedded or mapped version 4) becomes one 128-bit number, version 4 in its
mapped form. Ranges are blocks of such numbers. A number meets its block by equality on the block's leading bits, one
key for each length that occurs among the blocks, so the join is never by inequality and no pair is tried in vain.

Names are not resolved here: what a name resolves to is checked when it is dialled, by the same ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINK_LOCAL, PRIVATE = "link_local", "private"

#: Blocks of addresses by kind. Link-local ones, where instance metadata lives, can't be opted into.
BLOCKS = [
    ("169.254.0.0/16", LINK_LOCAL), ("fe80::/10", LINK_LOCAL), ("224.0.0.0/24", LINK_LOCAL),
    *[(f"ff{flags:x}2::/16", LINK_LOCAL) for flags in range(16)],
    ("127.0.0.0/8", PRIVATE), ("::1/128", PRIVATE),
    ("10.0.0.0/8", PRIVATE), ("172.16.0.0/12", PRIVATE), ("192.168.0.0/16", PRIVATE), ("fc00::/7", PRIVATE),
    ("0.0.0.0/32", PRIVATE), ("::/128", PRIVATE),
]

#: Parts into which the URLs of one address are dealt, so that an address with most of the rows is no single key.
SALTS = 16

_BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED = rf"{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}"


def _hex(number: Column, width: int) -> Column:
    return F.lower(F.lpad(F.hex(number.cast("long")), width, "0"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, where value is one expression however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _part(text: Column) -> Column:
    """A part of a version 4 spelling as a number: 0x… hexadecimal, 0… octal, else decimal; null if it is none or too long."""
    base = F.when(text.rlike("^0[xX][0-9a-fA-F]*$"), 16).when(text.rlike("^0[0-7]*$"), 8).when(text.rlike("^[1-9][0-9]*$"), 10)
    digits = F.regexp_replace(text, "^0[xX]?0*", "")
    read = lambda d: F.when(d == "", F.lit(0).cast("long")).when(F.length(d) <= 12, F.coalesce(*[F.when(base == b, F.conv(d, b, 10).cast("long")) for b in (16, 8, 10)]))
    return F.when(base.isNotNull(), _let(digits, read))


def version4(host: Column) -> Column:
    """The 32-bit number of a spelling that a resolver takes; the last part fills the bytes that are left. Else null."""

    def number(parts: Column) -> Column:
        n = F.size(parts)
        front = F.aggregate(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), F.lit(0).cast("long"), lambda sum_, p: F.when(p.between(0, 255), sum_ * 256 + p))
        room, last = F.element_at(F.array(*[F.lit(256**i).cast("long") for i in (4, 3, 2, 1)]), n), F.element_at(parts, F.lit(-1))
        return F.when((n <= 4) & (last < room), front * room + last)

    found = _let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\.", -1), _part), lambda parts: F.when(F.size(parts) <= 4, number(parts)))
    return F.when(host.rlike("^[0-9a-fA-FxX.]+$"), found)


def version6(host: Column) -> Column:
    """The 32 hexadecimal digits of a version 6 spelling, a zone not read; else null."""

    def without_dots(plain: Column) -> Column:
        bytes_ = [F.regexp_extract(plain, f"^.*:{_DOTTED}$", i).cast("long") for i in range(1, 5)]
        tail = F.concat(_hex(bytes_[0] * 256 + bytes_[1], 4), F.lit(":"), _hex(bytes_[2] * 256 + bytes_[3], 4))
        return F.when(plain.rlike(f":{_DOTTED}$"), F.concat(F.regexp_replace(plain, f"{_DOTTED}$", ""), tail)).otherwise(plain)

    def joined(sides: Column) -> Column:
        """Of the texts before and after ::, or of the whole text."""
        groups = F.transform(sides, lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1)))
        return _let(groups, filled)

    def filled(groups: Column) -> Column:
        written = F.flatten(groups)
        missing = 8 - F.size(written)
        fits = F.when(F.size(groups) == 1, missing == 0).otherwise((F.size(groups) == 2) & (missing >= 1))
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        digits = F.array_join(F.transform(F.concat(F.get(groups, F.lit(0)), zeros, F.coalesce(F.get(groups, F.lit(1)), F.array().cast("array<string>"))), lambda g: F.lpad(g, 4, "0")), "")
        return F.when(fits & F.forall(written, lambda g: g.rlike("^[0-9a-f]{1,4}$")), digits)

    plain = F.lower(F.regexp_replace(host, "%.*$", ""))
    return F.when(host.contains(":"), _let(_let(plain, without_dots), lambda text: joined(F.split(text, "::", -1))))


def address(host: Column) -> Column:
    """The 32 hexadecimal digits of any spelling of an address; null for a name."""
    return F.coalesce(version6(host), F.concat(F.lit("0" * 20 + "ffff"), _hex(version4(host), 8)))


def canonical(host: Column) -> Column:
    """Whether an address's spelling is the plain one: four decimal parts, or version 6 without a zone."""
    return host.rlike(f"^{_DOTTED}$") | (host.contains(":") & ~host.contains("%"))


def _bits(digits: Column) -> Column:
    half = lambda at: F.lpad(F.conv(F.substring(digits, at, 16), 16, 2), 64, "0")
    return F.concat(half(1), half(17))


def plausible_name(host: Column) -> Column:
    """Labels of ASCII letters, digits, - and _, the last without digits, 253 characters at most."""
    return host.rlike(r"^([A-Za-z0-9_-]+\.)*[A-Za-z_-]+\.?$") & (F.length(host) <= 253)


def parts_of(url: Column) -> Column:
    """A URL's scheme, userinfo (whether there is any) and host, in lower case; readable is false where no host can be told."""

    def of_place(place: Column) -> Column:
        bracketed, port = place.rlike(r"^\[[^\]]*\](:[0-9]*)?$"), place.rlike(r"^[^\[\]]*:[0-9]*$")
        host = F.when(bracketed, F.regexp_replace(F.regexp_extract(place, r"^\[([^\]]*)\]", 1), "%25", "%")).when(port, F.regexp_replace(place, ":[0-9]*$", "")).otherwise(place)
        shut = F.when(bracketed, F.lit(True)).when(port, ~place.contains("%")).otherwise(~place.rlike(r"[:\[\]%]"))
        return F.struct(F.lower(host).alias("host"), (shut & ~place.rlike(r'[\x20<>"\\^`{|}]')).alias("shut"))

    def of_authority(authority: Column) -> Column:
        place = _let(F.regexp_replace(authority, "^.*@", ""), of_place)
        return F.struct(authority.contains("@").alias("userinfo"), place.alias("place"))

    def of_text(text: Column) -> Column:
        told = _let(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), of_authority)
        scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        return _let(told, lambda t: F.struct(scheme.alias("scheme"), t["userinfo"].alias("userinfo"), t["place"]["host"].alias("host"), (t["place"]["shut"] & ~text.rlike(r"[\x00-\x1F\x7F]")).alias("readable")))

    return _let(F.coalesce(url, F.lit("")), of_text)


def blocks(spark: SparkSession, rows: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """A table of blocks (block text in slash notation, kind) out of rows; the fixed ones by default."""
    return spark.createDataFrame(list(BLOCKS if rows is None else rows), "block string, kind string")


def kinds_of(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """addresses (column address) with the kind of the narrowest block that holds each; of equal ones the least kind.

    ranges may have any size: each address has one key for each length that occurs, at most 129."""
    base, slash = F.split_part("block", F.lit("/"), F.lit(1)), F.split_part("block", F.lit("/"), F.lit(2)).cast("int")
    keyed = ranges.select(address(base).alias("digits"), F.when(base.contains(":"), slash).otherwise(slash + 96).alias("bits"), "kind")
    keyed = keyed.select("bits", F.substring(_bits(F.col("digits")), F.lit(1), F.col("bits")).alias("prefix"), "kind")
    lengths = sorted(r["bits"] for r in keyed.select("bits").distinct().filter("bits is not null").collect())  # 129 at most
    keys = addresses.select("address").distinct().withColumn("all_bits", _bits(F.col("address"))).select("address", "all_bits", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("bits"))
    keys = keys.select("address", "bits", F.substring("all_bits", F.lit(1), F.col("bits")).alias("prefix"))
    met = keys.join(keyed, ["bits", "prefix"])
    return met.groupBy("address").agg(F.min(F.struct((-F.col("bits")).alias("wide"), "kind"))["kind"].alias("kind"))


def verdicts(urls: DataFrame, url: str = "url", ranges: DataFrame | None = None, *, allow_http: bool = False, allow_private: bool = False) -> DataFrame:
    """urls with host, address (32 hexadecimal digits; null for a name), kind (of the address's block) and refusal.

    refusal is null where a request may go, else the first that holds of: unreadable, userinfo, plain_http, scheme,
    no_host, spelling (neither a name nor an address in its plain form), link_local, private. A null URL is an empty
    one. urls may have columns of any names but host, address, kind, refusal, and repeated rows stay repeated."""
    rows = urls.withColumn("told_", parts_of(F.col(url))).withColumn("address", _let(F.col("told_.host"), address))
    # A name has no address and meets nothing: its rows are dealt by themselves, not to one null key.
    salt = F.pmod(F.xxhash64(F.coalesce(F.col(url), F.lit(""))), F.lit(SALTS)).cast("int")
    rows = rows.withColumn("salt_", salt).withColumn("key_", F.coalesce("address", F.concat(F.lit("name "), F.xxhash64(F.col("told_.host")).cast("string"))))
    known = kinds_of(rows.filter("address is not null"), blocks(urls.sparkSession) if ranges is None else ranges)
    known = known.select(F.col("address").alias("key_"), "kind", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_"))
    host, scheme = F.col("told_.host"), F.col("told_.scheme")
    refusal = F.when(~F.col("told_.readable"), "unreadable").when(F.col("told_.userinfo"), "userinfo")
    if not allow_http:
        refusal = refusal.when(scheme == "http", "plain_http")
    refusal = refusal.when(~scheme.isin("http", "https"), "scheme").when(host == "", "no_host")
    refusal = refusal.when(~F.when(F.col("address").isNull(), plausible_name(host)).otherwise(canonical(host)), "spelling").when(F.col("kind") == LINK_LOCAL, LINK_LOCAL)
    if not allow_private:
        refusal = refusal.when(F.col("kind") == PRIVATE, PRIVATE)
    joined = rows.join(known, ["key_", "salt_"], "left")
    return joined.select(*urls.columns, host.alias("host"), "address", "kind", refusal.alias("refusal"))
