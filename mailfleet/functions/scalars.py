"""Column expressions shared by the operators. Everything stays inside the JVM."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# The clock text each log format carries, and the sentinel dates of the schema.
LOG_TIME_FORMATS = {
    "access": "dd/MMM/yyyy:HH:mm:ss Z",
    "webmail": "dd-MMM-yyyy HH:mm:ss Z",
    "imap": "yyyy-MM-dd HH:mm:ss",
}
NEVER_EXPIRES = "2000-01-01 00:00:00"
OPEN_ENDED = "2100-01-01 00:00:00"
PRIVATE_RANGES = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")

DOMAIN_PATTERN = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$"
LOGIN_PATTERN = r"^[a-zA-Z0-9.\-_@+]+$"
_DOTTED_QUAD = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- addresses -----------------------------------------------------------------------------


def norm_addr(c: ColumnOrName) -> Column:
    """Trimmed and lower-cased: the key comparisons of the schema ignore case."""
    return F.lower(F.trim(col(c)))


def addr_domain(c: ColumnOrName) -> Column:
    return F.substring_index(norm_addr(c), "@", -1)


def addr_local(c: ColumnOrName) -> Column:
    """Local part without the ``+detail`` extension."""
    return F.substring_index(F.substring_index(norm_addr(c), "@", 1), "+", 1)


def split_addr(c: ColumnOrName) -> Column:
    user = F.substring_index(norm_addr(c), "@", 1)
    plus = F.instr(user, "+")
    detail = F.when(plus > 0, F.substring(user, plus + F.lit(1), F.length(user)))
    return F.struct(
        addr_local(c).alias("local"), detail.alias("detail"), addr_domain(c).alias("domain")
    )


def bare_addr(c: ColumnOrName) -> Column:
    """Lookup key of an address: lower case, extension removed."""
    return F.concat(addr_local(c), F.lit("@"), addr_domain(c))


def storage_home(user: ColumnOrName, root: str = "/var/vmail") -> Column:
    local = F.substring_index(norm_addr(user), "@", 1)
    return F.concat(F.lit(f"{root}/"), addr_domain(user), F.lit("/"), local)


def storage_path(
    user: ColumnOrName, root: str = "/var/vmail", index_root: str = "/var/vmail-index"
) -> Column:
    """Mail location of a user: store, index and control folders."""
    home, index = storage_home(user, root), storage_home(user, index_root)
    return F.concat(
        F.lit("maildir:"), home, F.lit("/Maildir:INDEX="), index, F.lit("/index:CONTROL="),
        index, F.lit("/control"),
    )


def is_domain(c: ColumnOrName) -> Column:
    return col(c).rlike(DOMAIN_PATTERN)


def is_login(c: ColumnOrName) -> Column:
    return col(c).rlike(LOGIN_PATTERN)


# -- host names and addresses ----------------------------------------------------------------


def norm_host(c: ColumnOrName) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(col(c), '"', ""), r"\.$", ""))


def rel_label(c: ColumnOrName, zone: ColumnOrName) -> Column:
    """Label relative to its zone; the zone itself is ``@``."""
    host, apex = norm_host(c), norm_host(zone)
    inside = F.endswith(host, F.concat(F.lit("."), apex))
    return (
        F.when((host == "") | (host == apex), F.lit("@"))
        .when(inside, F.substring(host, F.lit(1), F.length(host) - F.length(apex) - F.lit(1)))
        .otherwise(host)
    )


def _octets(c: ColumnOrName) -> Column:
    return F.transform(F.split(col(c), r"\."), lambda part: part.try_cast("int"))


def is_ipv4(c: ColumnOrName) -> Column:
    in_range = F.forall(_octets(c), lambda o: o.between(0, 255))
    return F.coalesce(col(c).rlike(_DOTTED_QUAD) & in_range, F.lit(False))


def ip_to_long(c: ColumnOrName) -> Column:
    """IPv4 text as a number, null when it is not a valid address."""
    parts = _octets(c)
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o)
    return F.when(is_ipv4(c), number)


def long_to_ip(c: ColumnOrName) -> Column:
    n = col(c)
    octet = [F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octet)


def cidr_range(c: ColumnOrName) -> Column:
    """First and last address of ``a.b.c.d/n``; a plain address is its own range."""
    text = col(c)
    bits = F.coalesce(F.regexp_extract(text, r"/([0-9]+)$", 1).try_cast("int"), F.lit(32))
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("long")
    base = ip_to_long(F.substring_index(text, "/", 1))
    lo = base - F.pmod(base, size)
    return F.struct(lo.alias("lo"), (lo + size - 1).alias("hi"))


def cidr_bounds(text: str) -> tuple[int, int]:
    """The same for a literal of a rule table."""
    address, _, bits = text.partition("/")
    number = 0
    for part in address.split("."):
        number = number * 256 + int(part)
    size = 2 ** (32 - int(bits or 32))
    lo = number - number % size
    return lo, lo + size - 1


def in_ranges(ip: ColumnOrName, ranges: Sequence[str]) -> Column:
    """Whether an IPv4 text lies in one of the listed literal ranges."""
    number, hit = ip_to_long(ip), F.lit(False)
    for lo, hi in map(cidr_bounds, ranges):
        hit = hit | number.between(lo, hi)
    return F.coalesce(hit, F.lit(False))


def ipv6_hex(c: ColumnOrName) -> Column:
    """An IPv6 text as 32 hex digits, so that addresses compare as text; null for other text."""
    text = F.lower(col(c))
    halves = F.split(text, "::", 2)

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    left = groups(F.get(halves, F.lit(0)))
    right = groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    missing = 8 - F.size(left) - F.size(right)
    zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
    whole = F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0"))
    good = text.rlike("^[0-9a-f:]*$") & F.when(F.size(halves) == 2, missing >= 0).otherwise(missing == 0)
    return F.when(good & text.contains(":"), F.array_join(whole, ""))


def in_ipv6_ranges(ip: ColumnOrName, ranges: Sequence[str]) -> Column:
    """Whether an IPv6 text lies in one of the listed literal subnets or is a listed address."""
    digits, hit = ipv6_hex(ip), F.lit(False)
    for text in ranges:
        network = ipaddress.IPv6Network(text, strict=False)
        lo, hi = (f"{int(a):032x}" for a in (network.network_address, network.broadcast_address))
        hit = hit | digits.between(lo, hi)
    return F.coalesce(hit, F.lit(False))


def is_private(c: ColumnOrName) -> Column:
    return in_ranges(c, PRIVATE_RANGES)


# -- numbers and time ------------------------------------------------------------------------


def parity(c: ColumnOrName, ring: int = 2) -> Column:
    return F.pmod(col(c), F.lit(ring))


def mib_to_bytes(c: ColumnOrName) -> Column:
    return col(c).cast("long") * 1048576


def pct(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Whole percent of ``a`` in ``b``; null when ``b`` is 0 (no limit)."""
    return F.when(col(b) > 0, F.floor(col(a) * 100 / col(b)))


def ns_to_ms(c: ColumnOrName) -> Column:
    return col(c) / 1000000


def epoch_s(c: ColumnOrName) -> Column:
    return F.unix_seconds(col(c).cast("timestamp"))


def epoch_us(c: ColumnOrName) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def days_left(end: ColumnOrName, as_of: ColumnOrName) -> Column:
    """Whole days until ``end``; the division truncates towards zero, as shell arithmetic does."""
    seconds = epoch_s(end) - epoch_s(as_of)
    return (F.signum(seconds) * F.floor(F.abs(seconds) / 86400)).cast("long")


def age_s(c: ColumnOrName, as_of: ColumnOrName) -> Column:
    return epoch_s(as_of) - epoch_s(c)


def parse_log_ts(c: ColumnOrName, kind: str) -> Column:
    return F.try_to_timestamp(col(c), F.lit(LOG_TIME_FORMATS[kind]))


def duration_s(c: ColumnOrName) -> Column:
    """``10m``, ``4h``, ``7d`` or plain seconds as a number of seconds."""
    amount = F.regexp_extract(col(c), r"^([0-9]+)\s*([smhdw]?)$", 1).try_cast("long")
    unit = F.regexp_extract(col(c), r"^([0-9]+)\s*([smhdw]?)$", 2)
    return amount * (
        F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
        .when(unit == "w", 604800).otherwise(1)
    )


def seconds_of(text: str) -> int:
    """The same for a literal of a rule table."""
    unit = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
    return int(text[:-1]) * unit[text[-1]] if text[-1] in unit else int(text)


# -- hashes, lists, tags, JSON ----------------------------------------------------------------


def row_hash(*cols: ColumnOrName) -> Column:
    """Content hash of a row; a null and an empty string differ."""
    return F.sha2(F.to_json(F.struct(*[col(c) for c in cols]), {"ignoreNullFields": "false"}), 256)


def content_sha256(c: ColumnOrName) -> Column:
    return F.sha2(col(c), 256)


def to_list(c: ColumnOrName, sep: str = ",") -> Column:
    """Trimmed, non-empty items of a separated list."""
    items = F.transform(F.split(col(c), sep), lambda item: F.trim(item))
    return F.filter(items, lambda x: x != "")


def list_diff(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.array_except(col(a), col(b))


def tag_map(c: ColumnOrName) -> Column:
    """``k=v; k=v`` as a map; the first of a repeated tag counts."""
    pairs = F.transform(
        to_list(c, ";"),
        lambda t: F.struct(
            F.lower(F.trim(F.substring_index(t, "=", 1))).alias("key"),
            F.trim(F.substring(t, F.instr(t, "=") + F.lit(1), F.length(t))).alias("value"),
        ),
    )
    keys = F.transform(pairs, lambda p: p["key"])
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.map_from_entries(first)


def tag(c: ColumnOrName, name: str) -> Column:
    return F.try_element_at(tag_map(c), F.lit(name))


API_SCHEMA = "struct<data:array<struct<id:bigint,type:string,name:string,target:string,ttl_sec:int>>>"


def from_api_json(c: ColumnOrName) -> Column:
    return F.from_json(col(c), API_SCHEMA)["data"]


def report_json(**cols: ColumnOrName) -> Column:
    return F.to_json(F.struct(*[col(c).alias(name) for name, c in cols.items()]))


def rewrite(c: ColumnOrName, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(col(c), pattern, replacement)


def band(c: ColumnOrName, warn: float, fail: float) -> Column:
    """Severity of a measure; a threshold itself is still fine."""
    return F.when(col(c) > fail, "error").when(col(c) > warn, "warn").otherwise("ok")
