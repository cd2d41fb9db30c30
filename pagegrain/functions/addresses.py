"""Internet addresses as text: which may be fetched from."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import address_blocked, ipv4

#: Fixed blocks of addresses that aren't fetched from, beside those of IPv4.
BLOCKED = ("::1/128", "fc00::/7", "fe80::/10")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: as a column it would be written out wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _plain(text: Column) -> Column:
    """Lower case, without a zone, a dotted quad at the end as two groups."""

    def grouped(quad: Column, text: Column) -> Column:
        number = ipv4(quad)
        return F.concat(F.regexp_replace(text, r"[0-9.]*\.[0-9.]*$", ""), F.lower(F.hex(F.shiftright(number, 16))), F.lit(":"), F.lower(F.hex(number.bitwiseAND(0xFFFF))))

    return let(F.lower(F.split(text, "%", 2)[0]), lambda t: let(F.regexp_extract(t, r":([0-9.]*\.[0-9.]*)$", 1), lambda q: F.when(q == "", t).otherwise(grouped(q, t))))


def ipv6(text: Column) -> Column:
    """An address of eight groups as struct<hi, lo>, else null: `::` stands for groups of zero, the last two may be
    a dotted quad, a zone behind % is left out."""
    groups = lambda half: F.when(F.length(half) > 0, F.split(half, ":")).otherwise(F.array().cast("array<string>"))
    number = lambda g, i: F.conv(F.get(g, F.lit(i)), 16, 10).cast("long")
    half = lambda g, start: F.shiftleft(number(g, start), 48) + F.shiftleft(number(g, start + 1), 32) + F.shiftleft(number(g, start + 2), 16) + number(g, start + 3)

    def joined(halves: Column, parts: Column) -> Column:
        """The eight groups, or null."""
        missing = 8 - F.size(parts["head"]) - F.size(parts["tail"])
        fits = (F.size(halves) == 1) & (missing == 0) | (F.size(halves) == 2) & (missing >= 1)
        return F.when(fits, F.concat(parts["head"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), parts["tail"]))

    ends = lambda h: F.struct(groups(F.get(h, F.lit(0))).alias("head"), groups(F.coalesce(F.get(h, F.lit(1)), F.lit(""))).alias("tail"))
    full = let(F.split(_plain(text), "::", -1), lambda h: let(ends(h), lambda p: joined(h, p)))
    good = lambda g: F.coalesce(F.contains(text, F.lit(":")) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.lit(False))
    return let(full, lambda g: F.when(good(g), F.struct(half(g, 0).alias("hi"), half(g, 4).alias("lo"))))


def in_block(address: Column, block: str) -> Column:
    """Whether the first bits of struct<hi, lo> are a block's."""
    net = ipaddress.IPv6Network(block)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    out = F.lit(True)
    for name, bits, value in (("hi", min(64, net.prefixlen), int(net.network_address) >> 64), ("lo", max(0, net.prefixlen - 64), int(net.network_address) & (1 << 64) - 1)):
        if bits:
            out = out & (F.shiftrightunsigned(address[name], 64 - bits) == signed(value) % (1 << 64) >> (64 - bits) if bits < 64 else address[name] == signed(value))
    return out


def blocked(text: Column) -> Column:
    """Whether an address may not be fetched from; null if the text is none, as numbers in other notations
    (hexadecimal, octal, a single number, fewer parts) are.  An IPv4 address within IPv6 is judged as what it is."""

    def judged(a: Column) -> Column:
        six = a["six"]
        inner = (six["hi"] == 0) & (F.shiftrightunsigned(six["lo"], 32) == 0xFFFF)
        wide = F.lit(False)
        for block in BLOCKED:
            wide = wide | in_block(six, block)
        four = F.coalesce(a["four"], F.when(inner, six["lo"].bitwiseAND(0xFFFFFFFF)))
        return let(four, lambda f: F.when(f.isNotNull(), address_blocked(f)).when(six.isNotNull(), wide))

    return let(F.struct(ipv4(text).alias("four"), ipv6(text).alias("six")), judged)


def refusal(url: Column, resolved: Column) -> Column:
    """Why a url isn't fetched, null if it may be: scheme, no host, not resolved, or an address that is blocked.
    resolved: what the host's name stands for, an array of addresses; it isn't looked at if the host is an address itself.
    All addresses must be open; texts in the array that are no address don't count."""
    form = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\\]*)"
    scheme, site = F.lower(F.regexp_extract(F.trim(url), form, 1)), F.regexp_replace(F.regexp_extract(F.trim(url), form, 2), "^.*@", "")
    host = let(site, lambda s: F.lower(F.when(s.startswith("["), F.regexp_extract(s, r"^\[([^\]]*)\](:[0-9]*)?$", 1)).otherwise(F.regexp_extract(s, r"^([^:]*)(:[0-9]*)?$", 1))))
    open_, there = F.lit(None).cast("string"), F.filter(F.coalesce(resolved, F.array().cast("array<string>")), lambda a: a.isNotNull())
    listed = F.when(F.size(there) == 0, "not resolved").when(F.exists(there, lambda a: F.coalesce(blocked(a), F.lit(False))), "blocked")

    def judged(h: Column) -> Column:
        return F.when(h == "", "no host").otherwise(let(blocked(h), lambda own: F.when(own, "blocked").when(own.isNotNull(), open_).otherwise(listed)))

    return F.when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), "scheme").otherwise(let(host, judged))
