"""Header, address and sender-IP helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarisk import fixed_values as fv
from tamarisk.functions.text import has_text, trim_space


def header_value(headers: Column, name: str) -> Column:
    """Value of the first header of that name, whatever its case."""
    wanted = name.lower()
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == wanted), F.lit(0))["value"]


def mailbox_address(header: Column) -> Column:
    """The text between ``<`` and ``>``, else the whole header; null if empty."""
    inner = F.regexp_extract(header, "<([^>]+)>", 1)
    return F.when(has_text(header), trim_space(F.when(inner != "", inner).otherwise(header)))


def mailbox_domain(header: Column) -> Column:
    """Lower-cased text after the first ``@`` of the address; null without one."""
    address = mailbox_address(header)
    at = F.instr(address, "@")
    after = F.substr(address, at + F.lit(1))
    return F.when(at > 0, F.regexp_replace(F.lower(trim_space(after)), '[>"]', ""))


def last_domain(header: Column) -> Column:
    """Lower-cased text after the last ``@`` of the address; null without one."""
    address = mailbox_address(header)
    after = F.lower(trim_space(F.substring_index(address, "@", -1)))
    return F.when(F.instr(address, "@") > 0, F.regexp_replace(after, '[>"]', ""))


# A phrase made of words and quoted strings; the characters left out would make
# a strict address parser see a list, a group or a broken address.
_PHRASE = r'(?:[^"<>,;:@()\[\]\\]|"(?:[^"\\]|\\.)*")'
_ANGLE = r"<\s*[^<>\s,;()\[\]]+\s*>"


def display_name_raw(header: Column) -> Column:
    """Name part of ``Name <a@b>``, ``"Name" <a@b>`` or ``a@b (Name)``.

    Empty for a bare address and for headers a strict parser rejects (an
    unquoted comma, an unquoted address before the brackets, stray brackets).
    """
    quoted = F.regexp_extract(header, r'(?s)^\s*"((?:[^"\\]|\\.)*)"\s*' + _ANGLE + r"\s*$", 1)
    phrase = F.regexp_extract(header, rf"(?s)^\s*({_PHRASE}+?)\s*{_ANGLE}\s*$", 1)
    noted = F.regexp_extract(
        header, rf"(?s)^\s*({_PHRASE}+?)\s*\(([^()]*)\)\s*{_ANGLE}\s*$", 1
    )
    note = F.regexp_extract(
        header, rf"(?s)^\s*({_PHRASE}+?)\s*\(([^()]*)\)\s*{_ANGLE}\s*$", 2
    )
    comment = F.regexp_extract(
        header, r'(?s)^\s*[^\s<>"(),;:@\[\]]+@[^\s<>"(),;:@\[\]]+\s*\(([^()]*)\)\s*$', 1
    )

    def plain(words: Column) -> Column:
        unquoted = F.regexp_replace(words, r'"((?:[^"\\]|\\.)*)"', " $1 ")
        return trim_space(F.regexp_replace(unquoted, r"\s+", " "))

    unescape = F.regexp_replace(quoted, r"\\(.)", "$1")
    name = (
        F.when(quoted != "", unescape)
        .when(phrase != "", plain(phrase))
        .when(noted != "", F.concat(plain(noted), F.lit(" ("), note, F.lit(")")))
        .otherwise(comment)
    )
    return F.coalesce(name, F.lit(""))


def display_name(header: Column) -> Column:
    return F.lower(trim_space(display_name_raw(header)))


def auth_results_block(raw_message: Column) -> Column:
    block = F.regexp_extract(raw_message, fv.AUTH_BLOCK_PATTERN, 0)
    return F.when(block != "", block)


def is_routable(ip: Column) -> Column:
    return has_text(ip) & ~F.coalesce(ip, F.lit("")).rlike(fv.NON_ROUTABLE_PATTERN)


def _ips(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(fv.IPV4_PATTERN), F.lit(0))


def sender_ip(auth_results: Column, received: Column | None = None, raw: Column | None = None) -> Column:
    """First public IPv4 address.

    Addresses of the authentication header come first, then those of the
    ``received`` headers (an array); ``raw`` counts only if both hold none.
    """
    found = _ips(auth_results)
    if received is not None:
        listed = F.coalesce(received, F.array().cast("array<string>"))
        found = F.concat(found, F.flatten(F.transform(listed, _ips)))
    if raw is not None:
        found = F.when(F.size(found) > 0, found).otherwise(_ips(raw))
    return F.get(F.filter(found, is_routable), F.lit(0))
