"""DNS, certificate and signing-key posture of a fleet of zones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfleet.functions.rules import findings, first_match
from mailfleet.functions.scalars import (
    content_sha256, days_left, epoch_s, is_ipv4, norm_host, tag, to_list,
)
from mailfleet.plans.scan import following, id_chunk, running, time_chunk

# Certificate and key deadlines, record limits, delivery policy stages.
CERT_FAIL_DAYS = 10
CERT_WARN_DAYS = 21
FAILOVER_TTL = 300
MAX_TXT_STRING = 255
MAX_SPF_LOOKUPS = 10
SPF_LOOKUP_MECHANISMS = r"^[+?~-]?(include:|a$|a:|a/|mx$|mx:|mx/|ptr$|ptr:|exists:)"
KEY_OVERLAP_DAYS = 7
STAGE_DAYS = 14
STAGE_PCT = 25
SERVICES = ("mail", "webmail", "autoconfig", "autodiscover")
FAILOVER_SERVICES = ("mail", "webmail")
CERT_ISSUER = "letsencrypt.org"
SRV_PORTS = {"_imaps._tcp": 993, "_submission._tcp": 587, "_submissions._tcp": 465,
             "_sieve._tcp": 4190}
REFUSED_SRV = ("_pop3._tcp", "_pop3s._tcp")


@dataclass(frozen=True)
class DnsPolicy:
    """The two nodes, and the names that must lead to them.

    ``services`` lead to both nodes, ``failover`` are those a failover takes a node out of, and
    ``admin`` leads to the first node alone.
    """

    nodes: tuple[str, str]
    addresses: tuple[str, str]
    services: tuple[str, ...] = SERVICES
    failover: tuple[str, ...] = FAILOVER_SERVICES
    admin: str = "admin"
    ttl: int = FAILOVER_TTL


# -- comparing records -----------------------------------------------------------------------


def expected_records(zones: DataFrame, policy: DnsPolicy) -> DataFrame:
    """The address and exchanger records every zone should publish."""
    rows = [("@", "MX", n) for n in policy.nodes]
    rows += [(s, "A", a) for s in policy.services for a in policy.addresses]
    rows += [(policy.admin, "A", policy.addresses[0])]
    cells = [
        F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(v).alias("target"))
        for n, t, v in rows
    ]
    return zones.select("zone", F.inline(F.array(*cells)))


def dns_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Records that are missing or unexpected. Both lists are stacked and combined once."""
    key = ["zone", "name", "type", "target"]

    def side(df: DataFrame, label: str) -> DataFrame:
        return df.select(
            norm_host("zone").alias("zone"), F.lower("name").alias("name"), "type",
            norm_host("target").alias("target"), F.lit(label).alias("side"),
        )

    both = side(expected, "expected").unionByName(side(actual, "actual"))
    held = both.groupBy(*key).agg(
        F.bool_or(F.col("side") == "expected").alias("wanted"),
        F.bool_or(F.col("side") == "actual").alias("found"),
    )
    state = F.when(~F.col("found"), "missing").when(~F.col("wanted"), "unexpected")
    return held.select(*key, state.alias("state")).where("state is not null")


def fcrdns(ptr: DataFrame, forward: DataFrame) -> DataFrame:
    """Forward-confirmed reverse DNS of each address: none, mismatch, forward-mismatch or ok.

    A name may have several addresses; it is confirmed when one of them is the address.
    """
    names = ptr.select("ip", "expected", norm_host("ptr").alias("ptr"))
    backs = forward.select(norm_host("name").alias("__n"), F.col("address").alias("__a")).distinct()
    confirmed = names.join(
        backs, (F.col("ptr") == F.col("__n")) & (F.col("ip") == F.col("__a")), "left"
    )
    state = first_match(
        [
            (F.col("ptr").isNull() | (F.col("ptr") == ""), "none"),
            (F.col("ptr") != norm_host("expected"), "mismatch"),
            (F.col("__a").isNull(), "forward-mismatch"),
        ],
        "ok",
    )
    return confirmed.select("ip", "expected", "ptr", state.alias("state"))


def published_key(txt: Column | str) -> Column:
    """Key text of a signing record: strings joined, blanks out, everything after ``p=``."""
    text = F.regexp_replace(F.col(txt) if isinstance(txt, str) else txt, r'["\s]', "")
    return F.regexp_replace(text, r"^.*p=", "")


def dkim_match(local: DataFrame, txt: DataFrame) -> DataFrame:
    """Published signing key against the local one, per (zone, selector)."""
    there = txt.select(
        F.col("zone").alias("__z"), F.col("selector").alias("__s"),
        published_key("txt").alias("__p"),
    )
    on = (F.col("zone") == F.col("__z")) & (F.col("selector") == F.col("__s"))
    rows = local.join(there, on, "left")
    state = first_match(
        [
            (F.coalesce("__p", F.lit("")) == "", "missing"),
            (F.col("__p") == F.col("local_key"), "match"),
            (F.startswith("local_key", F.col("__p")), "truncated"),
        ],
        "mismatch",
    )
    return rows.select("zone", "selector", state.alias("state"))


def sni_map(hosts: DataFrame, names: DataFrame, host: str = "host") -> DataFrame:
    """Certificate lineage of each host name; the first lineage by name where several cover it."""
    cover = names.groupBy(F.col("san").alias("__san")).agg(F.min("lineage").alias("lineage"))
    return hosts.join(cover, norm_host(host) == F.col("__san"), "left").drop("__san")


def uncovered_hosts(hosts: DataFrame, names: DataFrame, host: str = "host") -> DataFrame:
    cover = names.select(F.col("san").alias("__san"))
    return hosts.join(cover, norm_host(host) == F.col("__san"), "left_anti")


# -- rule packs ------------------------------------------------------------------------------


def _finding_rows(df: DataFrame, keep: Sequence[str], rules) -> DataFrame:
    return df.select(*keep, F.explode(findings(rules)).alias("finding"))


def dns_posture(records: DataFrame, policy: DnsPolicy) -> DataFrame:
    """Findings per zone. All rules are conditional aggregates of one grouping, so a zone's
    records are combined on the map side and never gathered in a list."""
    rows = records.select(
        "zone", F.lower("name").alias("name"), "type", "prio", "ttl",
        norm_host("target").alias("target"),
    )
    cnames = rows.where(F.col("type") == "CNAME").select(
        F.when(F.col("name") == "@", F.col("zone"))
        .otherwise(F.concat("name", F.lit("."), "zone")).alias("__cname")
    ).distinct()
    rows = rows.join(
        cnames, (F.col("type") == "MX") & (F.col("target") == F.col("__cname")), "left"
    )
    is_mx, is_a = F.col("type") == "MX", F.col("type") == "A"
    failover = F.col("name").isin(*policy.services, policy.admin) & is_a

    def a_of(label: str) -> Column:
        return is_a & (F.col("name") == label)

    measures = [
        F.count_if(is_mx & (F.col("target") == policy.nodes[0])).alias("mx_a"),
        F.count_if(is_mx & (F.col("target") == policy.nodes[1])).alias("mx_b"),
        F.min(F.when(is_mx, F.col("prio"))).alias("prio_lo"),
        F.max(F.when(is_mx, F.col("prio"))).alias("prio_hi"),
        F.count_if(is_mx & is_ipv4("target")).alias("mx_ip"),
        F.count_if(is_mx & F.col("__cname").isNotNull()).alias("mx_cname"),
        F.count_if(a_of(policy.admin)).alias("admin_a"),
        F.max(F.when(failover, F.col("ttl"))).alias("ttl_hi"),
    ]
    rules = [
        ((F.col("mx_a") == 0) | (F.col("mx_b") == 0), "mx does not list both nodes"),
        (F.col("prio_lo") < F.col("prio_hi"), "mx priorities differ"),
        (F.col("mx_ip") > 0, "mx target is an address"),
        (F.col("mx_cname") > 0, "mx target is an alias name"),
        (F.col("admin_a") != 1, "admin name needs exactly one address"),
        (F.col("ttl_hi") > policy.ttl, "ttl of a failover name too long"),
    ]
    for node in policy.nodes:
        # A node's name must exist in its own zone; elsewhere the label may be absent.
        label, _, home = node.partition(".")
        count = F.col(f"node_{label}")
        measures.append(F.count_if(a_of(label)).alias(f"node_{label}"))
        rules.append((count > 1, f"node name {label} has several addresses"))
        rules.append(((norm_host("zone") == home) & (count == 0), f"node name {label} has no address"))
    for label in policy.services:
        for i, address in enumerate(policy.addresses):
            hit = a_of(label) & (F.col("target") == address)
            measures.append(F.count_if(hit).alias(f"svc_{label}_{i}"))
        both = (F.col(f"svc_{label}_0") > 0) & (F.col(f"svc_{label}_1") > 0)
        rules.append((~both, f"service name {label} lacks a node address"))
    return _finding_rows(rows.groupBy("zone").agg(*measures), ["zone"], rules)


def policy_records(records: DataFrame, issuer: str = CERT_ISSUER) -> DataFrame:
    """Findings on delivery policy, transport policy, reporting, issuers and service records."""
    name, kind, target = F.col("name"), F.col("type"), F.col("target")
    dmarc = (name == "_dmarc") & target.startswith("v=DMARC1")
    srv = F.split(F.trim(target), r"\s+")
    srv_host = F.when(F.size(srv) == 4, F.element_at(srv, -1)).otherwise(target)
    measures = [
        F.max(F.when(dmarc, F.lower(tag("target", "p")))).alias("stage"),
        F.count_if((name == "_mta-sts") & target.startswith("v=STSv1")).alias("sts"),
        F.count_if((name == "_smtp._tls") & target.startswith("v=TLSRPTv1")).alias("tlsrpt"),
        F.count_if(kind == "CAA").alias("caa"),
        F.count_if(
            (kind == "CAA") & target.contains(" issue ") & ~target.contains(f'"{issuer}"')
        ).alias("caa_other"),
        F.count_if(
            (kind == "SRV") & name.isin(*REFUSED_SRV) & (norm_host(srv_host) != "")
        ).alias("pop3"),
    ]
    for service, port in SRV_PORTS.items():
        wrong = (F.try_element_at(srv, F.lit(3)) != str(port)) | (
            norm_host(srv_host) != F.concat(F.lit("mail."), norm_host("zone"))
        )
        measures.append(
            F.count_if((kind == "SRV") & (name == service) & wrong).alias(f"srv_{port}")
        )
    rules = [
        (F.col("stage").isNull(), "no delivery policy"),
        (F.col("stage") == "none", "delivery policy only observes"),
        (F.col("sts") == 0, "no transport policy"),
        (F.col("tlsrpt") == 0, "no transport reporting"),
        (F.col("caa") == 0, "no issuer record"),
        (F.col("caa_other") > 0, "foreign issuer allowed"),
        (F.col("pop3") > 0, "pop3 not refused"),
    ]
    rules += [
        (F.col(f"srv_{port}") > 0, f"service record {service} is wrong")
        for service, port in SRV_PORTS.items()
    ]
    found = _finding_rows(records.groupBy("zone").agg(*measures), ["zone"], rules)

    # Every exchanger must be in the zone's transport policy: rows against rows, no lists.
    listed = records.where(kind == "STS").select(
        "zone", F.explode(F.split(target, "\n")).alias("line")
    )
    listed = listed.where(F.col("line").startswith("mx:")).select(
        F.col("zone").alias("__z"), norm_host(F.trim(F.substring_index("line", ":", -1))).alias("__h")
    )
    with_policy = records.where(kind == "STS").select("zone").distinct()
    exchangers = records.where(kind == "MX").select(
        "zone", norm_host("target").alias("host")
    ).distinct()
    omitted = exchangers.join(with_policy, "zone", "left_semi").join(
        listed, (F.col("zone") == F.col("__z")) & (F.col("host") == F.col("__h")), "left_anti"
    )
    return found.unionByName(omitted.select(
        "zone", F.concat(F.lit("transport policy omits "), "host").alias("finding")
    ))


def txt_strings(c: Column | str) -> Column:
    """The strings of a text record; a record without quotes is one string."""
    text = F.col(c) if isinstance(c, str) else c
    quoted = F.transform(F.regexp_extract_all(text, F.lit(r'"([^"]*)"'), F.lit(1)), lambda x: x)
    return F.when(F.size(quoted) > 0, quoted).otherwise(F.array(text))


def txt_segments(records: DataFrame, min_key: int) -> DataFrame:
    """Text records with a string over 255 characters, or a key shorter than it should be."""
    rows = records.where("txt is not null").withColumn("__s", txt_strings("txt"))
    rules = [
        (F.exists("__s", lambda s: F.length(s) > MAX_TXT_STRING), "string too long"),
        (F.length(published_key("txt")) < min_key, "key too short"),
    ]
    return _finding_rows(rows, ["zone", "selector"], rules)


def ipv6_complete(records: DataFrame) -> DataFrame:
    """Zones that publish an IPv6 address without authorising one to send."""
    spf6 = (
        (F.col("type") == "TXT") & F.col("target").startswith("v=spf1")
        & F.col("target").contains("ip6:")
    )
    zones = records.groupBy("zone").agg(
        F.count_if(F.col("type") == "AAAA").alias("aaaa"), F.count_if(spf6).alias("spf6")
    )
    return zones.where((F.col("aaaa") > 0) & (F.col("spf6") == 0)).select("zone", "aaaa")


def cert_posture(certs: DataFrame, as_of: Column) -> DataFrame:
    """Days left, severity, and whether key and certificate belong together."""
    days = days_left("not_after", as_of)
    status = first_match(
        [
            (F.col("days") < 0, "expired"),
            (F.col("days") < CERT_FAIL_DAYS, "fail"),
            (F.col("days") < CERT_WARN_DAYS, "warn"),
        ],
        "ok",
    )
    rows = certs.withColumn("days", days)
    return rows.select(
        "lineage", "serial", "days", status.alias("status"),
        (F.col("cert_hash") == F.col("key_hash")).cast("int").alias("key_matches"),
    )


def spf_rows(records: DataFrame) -> DataFrame:
    """One row per mechanism of each sender policy record."""
    spf = records.where((F.col("type") == "TXT") & F.col("target").startswith("v=spf1"))
    return spf.select(
        "zone", F.col("target").alias("record"),
        F.posexplode(F.split(F.trim("target"), r"\s+")).alias("position", "mechanism"),
    ).where(F.col("position") > 0)


def spf_audit(records: DataFrame, policy: DnsPolicy) -> DataFrame:
    """Per zone: number of records, node addresses authorised, mechanisms that cost a DNS lookup
    (worst record) and the qualifier at the end."""
    is_spf = F.coalesce(
        (F.col("type") == "TXT") & (F.col("name") == "@") & F.col("target").startswith("v=spf1"),
        F.lit(False),
    )
    m = F.split(F.trim(F.regexp_replace("target", '"', "")), r"\s+")
    last = F.element_at(m, -1)
    sign = F.regexp_extract(last, r"^([+?~-]?)all$", 1)
    ending = F.when(last.rlike(r"^[+?~-]?all$"), F.when(sign == "", "+").otherwise(sign))

    def most(of: Column) -> Column:
        return F.coalesce(F.max(F.when(is_spf, of)), F.lit(0))

    # Over all records of a zone, so that a zone without any such record is an error, not absent.
    per_zone = records.groupBy("zone").agg(
        F.count_if(is_spf).alias("records"),
        sum(most(F.array_contains(m, f"ip4:{a}").cast("int")) for a in policy.addresses)
        .alias("nodes_authorised"),
        most(F.size(F.filter(m, lambda x: x.rlike(SPF_LOOKUP_MECHANISMS)))).alias("lookups"),
        F.min(F.when(is_spf, ending)).alias("ending"),
    )
    bad = (
        (F.col("records") != 1) | (F.col("nodes_authorised") < len(policy.addresses))
        | (F.col("lookups") > MAX_SPF_LOOKUPS)
    )
    status = F.when(bad, "error").when(
        F.coalesce("ending", F.lit("")) != "-", "warn"
    ).otherwise("ok")
    return per_zone.withColumn("status", status)


def selector_coverage(reports: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Selectors that pass per domain; policy may be tightened only when all expected ones do."""
    seen = reports.where(F.col("pass") == 1).select("domain", "selector").distinct()
    wanted = F.col("selector").isin(*expected)
    rows = reports.select("domain").distinct().join(
        seen.groupBy("domain").agg(
            F.count(F.lit(1)).alias("selectors"), F.count_if(wanted).alias("__w")
        ),
        "domain", "left",
    ).na.fill(0, ["selectors", "__w"])
    return rows.select(
        "domain", "selectors", (F.col("__w") == len(expected)).cast("int").alias("may_tighten")
    )


def dmarc_stage(
    reports: DataFrame, expected: Sequence[str], min_pass_pct: int = 100,
    stage_days: int = STAGE_DAYS, quarantine_pct: int = STAGE_PCT,
) -> DataFrame:
    """How strict a domain's policy may be, by the span of its reports.

    A span of ``stage_days`` in which all expected selectors report and pass allows ``quarantine``
    for a share of the messages (``pct``), twice that span ``reject``; anything else is ``none``.
    """
    per_selector = reports.groupBy("domain", "selector").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pass").alias("passed"),
        F.min(epoch_s("ts")).alias("lo"), F.max(epoch_s("ts")).alias("hi"),
    )
    clean = F.col("passed") * 100 >= F.col("n") * min_pass_pct
    per_domain = per_selector.groupBy("domain").agg(
        F.floor((F.max("hi") - F.min("lo")) / 86400).alias("days"),
        F.count_if(F.col("selector").isin(*expected)).alias("selectors"),
        F.min(clean.cast("int")).alias("clean"),
    )
    ready = (F.col("clean") == 1) & (F.col("selectors") == len(expected))
    stage = (
        F.when(~ready | (F.col("days") < stage_days), "none")
        .when(F.col("days") < 2 * stage_days, "quarantine").otherwise("reject")
    )
    pct = F.when(F.col("stage") == "quarantine", quarantine_pct).otherwise(100)
    return per_domain.withColumn("stage", stage).withColumn("pct", pct)


# -- distinct counts that merge --------------------------------------------------------------


def distinct_sketches(
    rows: DataFrame, keys: Sequence[str], value: str, time: str, lg_k: int = 14
) -> DataFrame:
    """One sketch of the distinct values per key and day, to be stored and merged later.

    Null values are not counted. A sketch has at most about ``2**lg_k`` bytes whatever it has seen,
    and sketches are combined before the shuffle.
    """
    return rows.groupBy(*keys, F.to_date(time).alias("day")).agg(
        F.hll_sketch_agg(value, lg_k).alias("sketch")
    )


def merged_distinct(
    sketches: DataFrame, keys: Sequence[str], first_day: Column | None = None,
    last_day: Column | None = None,
) -> DataFrame:
    """Estimated distinct values per key over stored days, both ends included.

    A value seen on several days counts once. Rows of the days are not read again. Small counts are
    exact up to rounding, larger ones are off by ``sketch_error`` at most, but for rare cases.
    """
    kept = sketches
    if first_day is not None:
        kept = kept.where(F.col("day") >= first_day)
    if last_day is not None:
        kept = kept.where(F.col("day") <= last_day)
    return kept.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")
    )


def sketch_error(lg_k: int = 14) -> float:
    """Five standard deviations of a merged estimate, relative: 0.041 for the default size.

    Whatever the distribution, 96 of 100 estimates at least lie within. Three deviations would be
    too few: counts of some five times ``2**lg_k`` were seen four away.
    """
    return 5 * 1.04 / 2 ** (lg_k / 2)


# -- certificates and keys over time -------------------------------------------------------------


def san_rows(certs: DataFrame, col: str = "sans") -> DataFrame:
    return certs.select("lineage", F.explode(to_list(col)).alias("san")).distinct()


def guarded_offers(offers: DataFrame, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Offers with ``bundle_ok`` (their ``bundle`` came with a manifest and matches it whole) and
    ``key_ok`` (the private key belongs to the certificate). Absent facts count as not ok."""
    accepted = verify_manifest(files, manifest).groupBy(F.col("bundle").alias("__b")).agg(
        F.min("accepted").alias("__accepted")
    )
    rows = offers.join(accepted, F.col("bundle") == F.col("__b"), "left")
    return rows.select(
        *[F.col(c) for c in offers.columns],
        (F.coalesce("__accepted", F.lit(0)) == 1).alias("bundle_ok"),
        F.coalesce(F.col("cert_hash") == F.col("key_hash"), F.lit(False)).alias("key_ok"),
    )


def install_decisions(
    offers: DataFrame, seq: str = "seq", chunk_size: int = 10_000, forced: str | None = None,
    guards: Sequence[str] = (),
) -> DataFrame:
    """What a follower does with each offered certificate, in order: install, skip or refuse.

    The serial that is installed already is skipped and one that expires earlier is refused, so
    what is installed is always the offer with the latest expiry so far, the later one of equals.
    That makes the rule a running maximum. A forced offer is installed whatever it replaces, and
    begins a new run. ``guards`` are flags of the offers (``guarded_offers``): where one is not
    true, the offer is refused, forced or not, and changes nothing. With guards, ``reason`` names
    the first that failed, or ``expiry``.
    """
    passed = F.lit(True)
    for guard in guards:
        passed = passed & F.coalesce(F.col(guard).cast("boolean"), F.lit(False))
    rows = offers.withColumn("__passed", passed).withColumn(
        "__forced", (F.col(forced).cast("int") if forced else F.lit(0)) * passed.cast("int")
    )
    chunk = id_chunk(seq, chunk_size)
    keys = ["lineage"]
    if forced:
        rows = running(rows, keys, [seq], chunk, F.col("__forced"), "__run_no")
        keys = ["lineage", "__run_no"]
    current = F.when(F.col("__passed"), F.struct(F.col("not_after"), F.col(seq), F.col("serial")))
    rows = running(rows, keys, [seq], chunk, current, "__cur", how="max", before=True)
    decision = first_match(
        [
            (~F.col("__passed"), "refuse"),
            (F.col("__forced") == 1, "install"),
            (F.col("__cur").isNull(), "install"),
            (F.col("__cur.serial") == F.col("serial"), "skip"),
            (F.col("not_after") < F.col("__cur.not_after"), "refuse"),
        ],
        "install",
    )
    out = rows.select(
        *[F.col(c) for c in offers.columns], F.col("__cur.serial").alias("installed"),
        decision.alias("decision"),
    )
    if not guards:
        return out
    failed = [(~F.coalesce(F.col(g).cast("boolean"), F.lit(False)), g) for g in guards]
    reason = first_match([*failed, (F.col("decision") == "refuse", "expiry")])
    return out.withColumn("reason", reason)


def rotation_overlap(
    history: DataFrame, days: int = KEY_OVERLAP_DAYS, chunk_s: int = 30 * 86400
) -> DataFrame:
    """Keys withdrawn too early: less than a week, or their own TTL, after the next went live."""
    rows = following(
        history, ["zone", "node"], ["valid_from"], time_chunk("valid_from", chunk_s),
        F.col("valid_from"), "next_live",
    )
    overlap = epoch_s("removed_at") - epoch_s("next_live")
    needed = F.greatest(F.lit(days * 86400), F.col("ttl"))
    return rows.withColumn("overlap_s", overlap).where(F.col("overlap_s") < needed).select(
        "zone", "node", "selector", "overlap_s"
    )


# -- failover ------------------------------------------------------------------------------------


def failover_plan(
    probes: DataFrame, records: DataFrame, policy: DnsPolicy
) -> DataFrame:
    """Record changes that take the peer out of a zone, when both the tunnel and the public probe
    fail; a zone whose peer answers either is refused. Exchanger records are never touched."""
    own, peer = policy.addresses
    dead = (F.col("tunnel_ok") == 0) & (F.col("public_ok") == 0)
    verdicts = probes.select("zone", F.when(dead, "promote").otherwise("refuse").alias("verdict"))
    address = records.where(F.col("type") == "A")
    withdraw = F.col("name").isin(*policy.failover) & (F.col("target") == peer)
    steer = (F.col("name") == policy.admin) & (F.col("target") != own)
    action = first_match([(withdraw, "delete"), (steer, "repoint")])
    changes = address.select(
        F.col("zone").alias("__z"), "name", F.col("target").alias("old_target"),
        action.alias("action"),
    ).where("action is not null")
    on = (F.col("zone") == F.col("__z")) & (F.col("verdict") == "promote")
    rows = verdicts.join(changes, on, "left")
    return rows.select(
        "zone", "verdict", F.coalesce("action", F.lit("none")).alias("action"), "name",
        "old_target", F.when(F.col("action") == "repoint", own).alias("new_target"),
    )


def restore_plan(records: DataFrame, policy: DnsPolicy) -> DataFrame:
    """Address records to add so that both nodes serve every failover name again."""
    cells = [
        F.struct(F.lit(s).alias("name"), F.lit(a).alias("target"))
        for s in policy.failover for a in policy.addresses
    ]
    wanted = records.select("zone").distinct().select("zone", F.inline(F.array(*cells)))
    held = records.where(F.col("type") == "A").select("zone", "name", "target")
    missing = wanted.join(held, ["zone", "name", "target"], "left_anti")
    return missing.withColumn("action", F.lit("add")).withColumn("ttl", F.lit(policy.ttl))


# -- bundles -------------------------------------------------------------------------------------


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """State of each file of a bundle, and whether the bundle is accepted: only if all match.

    Contents are hashed where they are read; names and hashes are all that is shuffled.
    """
    have = files.select("bundle", "name", content_sha256("content").alias("have"))
    both = have.withColumn("listed", F.lit(None).cast("string")).unionByName(
        manifest.select("bundle", "name", F.lit(None).cast("string").alias("have"),
                        F.col("sha256").alias("listed"))
    )
    rows = both.groupBy("bundle", "name").agg(
        F.max("have").alias("have"), F.max("listed").alias("listed")
    )
    state = first_match(
        [
            (F.col("have").isNull(), "absent"),
            (F.col("listed").isNull(), "unlisted"),
            (F.col("have") != F.col("listed"), "differs"),
        ],
        "ok",
    )
    rows = rows.select("bundle", "name", state.alias("state"))
    accepted = rows.groupBy("bundle").agg(F.bool_and(F.col("state") == "ok").alias("accepted"))
    return rows.join(accepted, "bundle").withColumn("accepted", F.col("accepted").cast("int"))
