"""Reputation lookups: the keys of a message, the joins, the gathered record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk import schemas
from tamarisk.functions.address import sender_ip
from tamarisk.functions.text import has_text, text_or_empty
from tamarisk.operators.asof import asof_join, one_per_key
from tamarisk.operators.keys import join_on_message, message_key
from tamarisk.operators.lookup import lookup_join
from tamarisk.params import RiskParams


@dataclass(frozen=True)
class Snapshots:
    """Reputation tables; leave out what was not consulted.

    ``vt``: columns of ``schemas.VT_RESULT`` (any subset with ``kind``,
    ``target``); ``abuse``, ``safe_browsing``, ``malware_feed``, ``expansions``:
    columns of the schema of that name.  A table may hold several records of a key:
    with ``fetched_at``, a message sees the latest fetched by the time it was received
    (records without a time are always valid, but older than all others); without, one
    record of a key is taken for all messages.
    """

    vt: DataFrame | None = None
    abuse: DataFrame | None = None
    safe_browsing: DataFrame | None = None
    malware_feed: DataFrame | None = None
    expansions: DataFrame | None = None


FETCHED, ASKED = "fetched_at", "received_at"

# --- child rows ------------------------------------------------------------


def _named(messages: DataFrame) -> list[str]:
    """What a row keeps of its message: its key and, where it is known, the time."""
    return [*message_key(messages), *[c for c in (ASKED,) if c in messages.columns]]


def url_rows(messages: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """The first URLs of each message: its key, ``pos, url, domain``."""
    first, named = F.slice("urls", 1, params.max_urls), _named(messages)
    return messages.select(*named, F.posexplode(first).alias("pos", "u")).select(
        *named, "pos", F.col("u.url").alias("url"), F.col("u.domain").alias("domain")
    )


def hash_rows(messages: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """Hashes among the first attachments: key of the message, ``pos, sha256``.

    The list is cut first and filtered second, so a file without a hash still
    uses up one of the places.
    """
    first, named = F.slice("attachments", 1, params.max_hashes), _named(messages)
    return (
        messages.select(*named, F.posexplode(first).alias("pos", "a"))
        .select(*named, "pos", F.col("a.sha256").alias("sha256"))
        .filter(has_text(F.col("sha256")))
    )


def shortener_rows(messages: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """Those of the first URLs that go through a link shortener."""
    known = list(params.dictionaries.shorteners)
    return url_rows(messages, params).filter(F.lower(text_or_empty(F.col("domain"))).isin(known))


# --- single lookups --------------------------------------------------------


def _keyed(snapshot: DataFrame, key: str, on: str, name: str, ddl: str | None = None) -> DataFrame:
    """Snapshot as ``on, <name> struct`` and the time of each record, absent columns as nulls."""
    names = schemas.fields_of(ddl) if ddl else [c for c in snapshot.columns if c != FETCHED]
    record = F.struct(
        *[(F.col(n) if n in snapshot.columns else F.lit(None)).alias(n) for n in names]
    )
    when = [_valid_from(snapshot)] if FETCHED in snapshot.columns else []
    return snapshot.select(F.col(key).alias(on), (record.cast(ddl) if ddl else record).alias(name), *when)


def _valid_from(snapshot: DataFrame) -> Column:
    always = F.timestamp_seconds(F.lit(0))
    return (F.coalesce(FETCHED, always) if FETCHED in snapshot.columns else always).alias(FETCHED)


def _lookup(left: DataFrame, known: DataFrame, key: str, name: str, spread_by, params: RiskParams) -> DataFrame:
    """Every row of ``left`` with the record of its key: the one valid when it was received, if times are known."""
    if FETCHED in known.columns and ASKED in left.columns and not left.isStreaming:
        return asof_join(left, known.filter(F.col(key).isNotNull()), [key], ASKED, FETCHED, {name: F.col(name)})
    at = FETCHED if FETCHED in known.columns else None
    return lookup_join(left, one_per_key(known, [key], at).select(key, name), [key], list(spread_by), params)


def with_engines(
    left: DataFrame,
    vt: DataFrame,
    kind: str,
    key: str,
    spread_by=("message_id",),
    params: RiskParams = RiskParams(),
) -> DataFrame:
    """Add the engine record of a URL, file, domain or IP as struct ``vt``."""
    return _lookup(left, _keyed(vt.filter(F.col("kind") == kind), "target", key, "vt"), key, "vt", spread_by, params)


def with_abuse(left, abuse, key: str = "sender_ip", spread_by=("message_id",), params=RiskParams()):
    """Add the abuse record of an IP as struct ``abuse``."""
    return _lookup(left, _keyed(abuse, "ip", key, "abuse", schemas.ABUSE_RESULT), key, "abuse", spread_by, params)


def with_safe_browsing(left, snapshot, key: str = "url", spread_by=("message_id",), params=RiskParams()):
    """Add the safe-browsing record of a URL; a URL without match is clean."""
    joined = _lookup(left, _keyed(snapshot, "url", key, "gsb", schemas.SAFE_BROWSING), key, "gsb", spread_by, params)
    return joined.withColumn("gsb", checked_browsing(F.col("gsb"), F.col(key)))


def with_malware_feed(left, snapshot, key: str = "url", spread_by=("message_id",), params=RiskParams()):
    """Add the malware-feed record of a URL; a URL not listed is clean."""
    joined = _lookup(left, _keyed(snapshot, "url", key, "feed", schemas.MALWARE_FEED), key, "feed", spread_by, params)
    return joined.withColumn("feed", checked_feed(F.col("feed"), F.col(key)))


def with_expansion(left, expansions, key: str = "url", spread_by=("message_id",), params=RiskParams()):
    """Add the redirect expansion of a URL as struct ``expansion``."""
    known = _keyed(expansions, "original_url", key, "expansion", schemas.EXPANSION)
    return _lookup(left, known, key, "expansion", spread_by, params)


def checked_browsing(found: Column, url: Column) -> Column:
    clean = F.struct(
        url.alias("url"), F.lit(False).alias("is_threat"),
        F.array().cast("array<string>").alias("threat_types"),
        F.array().cast("array<string>").alias("platform_types"),
    )
    return F.coalesce(
        F.when(
            found.isNotNull(),
            F.struct(
                url.alias("url"), found["is_threat"], found["threat_types"], found["platform_types"]
            ),
        ),
        clean,
    ).cast(schemas.SAFE_BROWSING)


def checked_feed(found: Column, url: Column) -> Column:
    names = schemas.fields_of(schemas.MALWARE_FEED)[2:]
    return F.struct(
        url.alias("url"),
        F.coalesce(found["in_database"], F.lit(False)).alias("in_database"),
        *[found[n].alias(n) for n in names],
    ).cast(schemas.MALWARE_FEED)


# --- everything a message asks for, in one join ----------------------------


def _key(kind: str, pos: Column, key: Column, short: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), pos.cast("int").alias("pos"),
        key.alias("key"), short.alias("shortened"),
    )


def lookup_keys(messages: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """All lookup keys: key of the message, ``kind, pos, key, shortened``.

    At most ten narrow rows per message; caps apply before the explode.
    """
    shorteners = list(params.dictionaries.shorteners)
    no = F.lit(False)
    empty = F.array().cast("array<struct<kind:string,pos:int,key:string,shortened:boolean>>")
    urls = F.transform(
        F.slice("urls", 1, params.max_urls),
        lambda u, i: _key("url", i, u["url"], F.lower(text_or_empty(u["domain"])).isin(shorteners)),
    )
    files = F.transform(
        F.slice("attachments", 1, params.max_hashes), lambda a, i: _key("file", i, a["sha256"], no)
    )
    single = F.array(
        _key("domain", F.lit(0), F.col("from_domain"), no),
        _key("ip", F.lit(0), sender_ip(F.col("authentication_results")), no),
    )
    keys = F.filter(
        F.concat(F.coalesce(urls, empty), F.coalesce(files, empty), single),
        lambda k: has_text(k["key"]),
    )
    return messages.select(*_named(messages), F.inline(keys))


_PARTS = {
    "vt": schemas.VT_LOOKUP,
    "abuse": schemas.ABUSE_RESULT,
    "gsb": schemas.SAFE_BROWSING,
    "feed": schemas.MALWARE_FEED,
    "expansion": schemas.EXPANSION,
}


def reputation_records(snapshots: Snapshots) -> DataFrame | None:
    """All snapshots as one table ``kind, key, fetched_at, vt, abuse, gsb, feed, expansion``.

    Putting the sources side by side under one key lets a message's keys travel
    once instead of once per source.
    """

    def side(snapshot: DataFrame, kind: Column, key: str, part: str) -> DataFrame:
        keyed = _keyed(snapshot, key, "key", part, _PARTS[part])
        return keyed.select(
            kind.alias("kind"), "key", _valid_from(keyed),
            *[
                (F.col(p) if p == part else F.lit(None).cast(ddl)).alias(p)
                for p, ddl in _PARTS.items()
            ],
        )

    sides = []
    if snapshots.vt is not None:
        sides.append(side(snapshots.vt, F.col("vt.kind"), "target", "vt"))
    if snapshots.abuse is not None:
        sides.append(side(snapshots.abuse, F.lit("ip"), "ip", "abuse"))
    if snapshots.safe_browsing is not None:
        sides.append(side(snapshots.safe_browsing, F.lit("url"), "url", "gsb"))
    if snapshots.malware_feed is not None:
        sides.append(side(snapshots.malware_feed, F.lit("url"), "url", "feed"))
    if snapshots.expansions is not None:
        sides.append(side(snapshots.expansions, F.lit("url"), "original_url", "expansion"))
    if not sides:
        return None
    table = sides[0]
    for other in sides[1:]:
        table = table.unionByName(other)
    return table


def reputation_table(snapshots: Snapshots) -> DataFrame | None:
    """One row per key, of every source the latest record (of undated ones the greatest by JSON text)."""
    table = reputation_records(snapshots)
    if table is None:
        return None
    order = lambda p: F.when(F.col(p).isNotNull(), F.struct(FETCHED, F.to_json(p)))
    return table.groupBy("kind", "key").agg(*[F.max_by(p, order(p)).alias(p) for p in _PARTS])


def _dated(snapshots: Snapshots) -> bool:
    return any(s is not None and FETCHED in s.columns for s in vars(snapshots).values())


def gather(
    messages: DataFrame, snapshots: Snapshots, params: RiskParams = RiskParams()
) -> DataFrame:
    """Key of the message and ``intel``, for every message that asks for something.

    Results stand in list order of the message's URLs and files.
    """
    keys, named = lookup_keys(messages, params), message_key(messages)
    records = reputation_records(snapshots)
    if records is None:
        found = keys.select("*", *[F.lit(None).cast(d).alias(p) for p, d in _PARTS.items()])
    elif _dated(snapshots) and ASKED in keys.columns and not keys.isStreaming:
        # all sources in one look back
        found = asof_join(keys, records, ["kind", "key"], ASKED, FETCHED, {p: F.col(p) for p in _PARTS})
    else:
        found = lookup_join(keys, reputation_table(snapshots), ["kind", "key"], ["message_id", "pos"], params)
    # a set: a message that is given twice asks once
    listed = found.groupBy(*named).agg(
        F.sort_array(
            F.collect_set(F.struct("kind", "pos", "key", "shortened", *_sortable()))
        ).alias("r")
    )
    return listed.select(*named, _record(F.col("r"), snapshots).alias("intel"))


def _sortable():
    # a struct with a map cannot be sorted; the record is kept in an array of
    # entries and turned back into a map afterwards
    vt = F.col("vt")
    fields = [
        (F.map_entries(vt[n]) if n == "categories" else vt[n]).alias(n)
        for n in schemas.fields_of(schemas.VT_LOOKUP)
    ]
    packed = F.when(vt.isNotNull(), F.struct(*fields)).alias("vt")
    return [packed, "abuse", "gsb", "feed", "expansion"]


def _vt_list(r: Column, kind: str) -> Column:
    hits = F.filter(r, lambda x: (x["kind"] == kind) & x["vt"].isNotNull())

    def unpack(x: Column) -> Column:
        return F.struct(
            *[
                (F.map_from_entries(x["vt"][n]) if n == "categories" else x["vt"][n]).alias(n)
                for n in schemas.fields_of(schemas.VT_LOOKUP)
            ]
        )

    return F.transform(hits, unpack)


def _record(r: Column, snapshots: Snapshots) -> Column:
    urls = F.filter(r, lambda x: x["kind"] == "url")
    first = lambda xs: F.get(xs, F.lit(0))
    ips = F.filter(r, lambda x: x["kind"] == "ip")
    none_of = lambda ddl: F.array().cast(f"array<{ddl}>")
    browsing = (
        F.transform(urls, lambda x: checked_browsing(x["gsb"], x["key"]))
        if snapshots.safe_browsing is not None
        else none_of(schemas.SAFE_BROWSING)
    )
    feed = (
        F.transform(urls, lambda x: checked_feed(x["feed"], x["key"]))
        if snapshots.malware_feed is not None
        else none_of(schemas.MALWARE_FEED)
    )
    expansions = F.transform(
        F.filter(urls, lambda x: x["shortened"] & x["expansion"].isNotNull()),
        lambda x: x["expansion"],
    )
    return F.struct(
        _vt_list(r, "url").alias("url_results"),
        _vt_list(r, "file").alias("file_results"),
        _vt_list(r, "domain").alias("domain_results"),
        _vt_list(r, "ip").alias("ip_results"),
        first(ips)["abuse"].alias("abuse_result"),
        expansions.alias("url_expansions"),
        first(ips)["key"].alias("sender_ip"),
        browsing.alias("safe_browsing_results"),
        feed.alias("malware_feed_results"),
    ).cast(schemas.INTEL)


def empty_intel() -> Column:
    """The record of a message that asked for nothing."""
    arrays = [
        n for n in schemas.fields_of(schemas.INTEL) if n not in ("abuse_result", "sender_ip")
    ]
    return F.struct(
        *[
            (F.array() if n in arrays else F.lit(None)).alias(n)
            for n in schemas.fields_of(schemas.INTEL)
        ]
    ).cast(schemas.INTEL)


def with_intel(
    rows: DataFrame,
    snapshots: Snapshots,
    params: RiskParams = RiskParams(),
    messages: DataFrame | None = None,
) -> DataFrame:
    """Add the ``intel`` struct to every row.

    The rows are shuffled on the message key, so drop the bodies first.  Give the
    plain ``messages`` where ``rows`` is a longer plan: the keys are then read
    from them and nothing of that plan runs twice.
    """
    gathered = gather(rows if messages is None else messages, snapshots, params)
    joined = join_on_message(rows, gathered)
    return joined.withColumn("intel", F.coalesce("intel", empty_intel()))


# --- proven-malicious predicates -------------------------------------------


def proven_by_engines(malicious_count: Column, params: RiskParams = RiskParams()) -> Column:
    return F.coalesce(malicious_count >= params.proven_engines, F.lit(False))


def proven_by_abuse(confidence: Column, params: RiskParams = RiskParams()) -> Column:
    return F.coalesce(confidence >= params.proven_abuse_confidence, F.lit(False))
