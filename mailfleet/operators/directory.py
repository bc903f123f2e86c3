"""Lookups in the mail directory: domains, mailboxes, aliases, senders, administrators.

A lookup table answers one key at a time; here whole key tables are answered with joins. Domain
rows number as many as domains, so Spark broadcasts them while they fit its size limit; address
tables are joined by shuffle, and hot addresses are taken out first by working on distinct keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfleet.functions.scalars import (
    NEVER_EXPIRES, addr_domain, addr_local, bare_addr, is_domain, is_login, norm_addr,
    storage_home, storage_path, to_list,
)
from mailfleet.plans.sizes import broadcast_if_small

Tables = Mapping[str, DataFrame]

# The marker row of the all-domains grant, the route names in map order, the role
# accounts of a domain, and the owner of the mail store.
ALL_DOMAINS = "ALL"
ROUTES = (
    "relay_denied", "alias", "ad_alias", "ad_catchall", "catchall", "mailbox", "ad_mailbox",
    "unlisted",
)
ROLE_ACCOUNTS = ("abuse", "hostmaster", "postmaster", "webmaster")
STORE_UID = STORE_GID = 5000


def _active(df: DataFrame) -> DataFrame:
    return df.where(F.col("active") == 1)


# -- domains ---------------------------------------------------------------------------------


def local_domains(domain: DataFrame) -> DataFrame:
    """Domains this fleet is the final destination of."""
    kept = _active(domain).where((F.col("backupmx") == 0) & (F.col("domain") != ALL_DOMAINS))
    return kept.select(F.lower("domain").alias("domain"))


def alias_domains(alias_domain: DataFrame) -> DataFrame:
    return _active(alias_domain).select(
        F.lower("alias_domain").alias("alias_domain"),
        F.lower("target_domain").alias("target_domain"),
    )


def domain_lookup(keys: DataFrame, listed: DataFrame, key: str = "domain") -> DataFrame:
    """Keys that the listed domains contain."""
    names = listed.select(F.col(listed.columns[0]).alias("__d"))
    return keys.join(names, F.lower(F.col(key)) == F.col("__d"), "left_semi")


def tls_policy(dest: DataFrame, policy: DataFrame, key: str = "domain") -> DataFrame:
    """Outbound transport policy per destination; ``may`` where none is listed."""
    listed = _active(policy).select(
        F.lower("domain").alias("__d"),
        F.trim(F.concat("policy", F.lit(" "), "params")).alias("__p"),
    )
    return dest.join(listed, F.lower(F.col(key)) == F.col("__d"), "left").select(
        *[F.col(c) for c in dest.columns], F.coalesce("__p", F.lit("may")).alias("tls")
    )


# -- mailboxes -------------------------------------------------------------------------------


def _by_user(keys: DataFrame, mailbox: DataFrame, key: str, how: str, *values: Column) -> DataFrame:
    box = mailbox.select(F.lower("username").alias("__u"), *values)
    return keys.join(box, norm_addr(key) == F.col("__u"), how).drop("__u")


def mailbox_lookup(keys: DataFrame, mailbox: DataFrame, key: str = "rcpt") -> DataFrame:
    """Keys with the ``maildir`` of their active mailbox, null where there is none."""
    return _by_user(keys, _active(mailbox), key, "left", F.col("maildir"))


def mailbox_limit(keys: DataFrame, mailbox: DataFrame, key: str = "rcpt") -> DataFrame:
    """Keys whose active mailbox has a size limit, with it in bytes."""
    limited = _active(mailbox).where(F.col("quota") > 0)
    return _by_user(keys, limited, key, "inner", F.col("quota"))


def _quota_rule() -> Column:
    return F.concat(F.lit("*:bytes="), F.col("quota").cast("string"))


def _may_login(as_of: Column) -> Column:
    never = F.lit(NEVER_EXPIRES).cast("timestamp")
    expiry = F.col("password_expiry")
    return (F.col("active") == 1) & ((expiry == never) | (expiry > as_of))


def auth_lookup(
    keys: DataFrame, mailbox: DataFrame, as_of: Column, key: str = "rcpt", **layout: str
) -> DataFrame:
    """Login eligibility: active and not expired, with the user's storage settings."""
    found = _by_user(
        keys, mailbox.where(_may_login(as_of)), key, "inner",
        F.lower("username").alias("user"), F.col("password"), _quota_rule().alias("quota_rule"),
    )
    return _with_storage(found, "user", layout)


def user_lookup(
    keys: DataFrame, mailbox: DataFrame, key: str = "rcpt", **layout: str
) -> DataFrame:
    """The same for delivery: no password, and an expired password does not matter."""
    found = _by_user(
        keys, _active(mailbox), key, "inner",
        F.lower("username").alias("user"), _quota_rule().alias("quota_rule"),
    )
    return _with_storage(found, "user", layout)


def _with_storage(df: DataFrame, user: str, layout: Mapping[str, str]) -> DataFrame:
    root = layout.get("root", "/var/vmail")
    return df.select(
        "*",
        storage_home(user, root).alias("home"),
        storage_path(user, root, layout.get("index_root", "/var/vmail-index")).alias("mail"),
        F.lit(STORE_UID).alias("uid"),
        F.lit(STORE_GID).alias("gid"),
    )


def iterate_users(mailbox: DataFrame) -> DataFrame:
    return _active(mailbox).select(F.lower("username").alias("user"))


def valid_tokens(mailbox: DataFrame, as_of: Column) -> DataFrame:
    """Reset tokens that can still be redeemed."""
    return mailbox.where((F.col("token") != "") & (F.col("token_validity") >= as_of)).select(
        "username", "token", "token_validity"
    )


def vacation_active(vacation: DataFrame, as_of: Column) -> DataFrame:
    return _active(vacation).where(as_of.between(F.col("activefrom"), F.col("activeuntil")))


# -- aliases ---------------------------------------------------------------------------------


def _alias_map(alias: DataFrame) -> DataFrame:
    return _active(alias).select(F.lower("address").alias("address"), "goto")


def _catchalls(alias: DataFrame, name: str) -> DataFrame:
    """One row per domain with a catch-all: at most as many rows as domains."""
    rows = _alias_map(alias).where(F.startswith("address", F.lit("@")))
    return rows.select(F.expr("substring(address, 2)").alias("__d"), F.col("goto").alias(name))


def _small_catchalls(alias: DataFrame, name: str) -> DataFrame:
    """For joins with rows by domain, where a busy domain would be a hot key."""
    return broadcast_if_small(_catchalls(alias, name))


def alias_lookup(keys: DataFrame, alias: DataFrame, key: str = "rcpt") -> DataFrame:
    """Alias of the full address; only on a miss the one of ``@domain``."""
    exact = _alias_map(alias).select(F.col("address").alias("__a"), F.col("goto").alias("__exact"))
    rows = keys.join(exact, bare_addr(key) == F.col("__a"), "left")
    rows = rows.join(_small_catchalls(alias, "__any"), addr_domain(key) == F.col("__d"), "left")
    return rows.select(
        *[F.col(c) for c in keys.columns],
        F.coalesce("__exact", "__any").alias("goto"),
        F.when(F.col("__exact").isNotNull(), "address")
        .when(F.col("__any").isNotNull(), "domain").alias("matched"),
    ).where("goto is not null")


def _at_target(keys: DataFrame, alias_domain: DataFrame, key: str) -> DataFrame:
    """Keys in an alias domain, with that domain's target."""
    pairs = alias_domains(alias_domain)
    return keys.join(pairs, addr_domain(key) == F.col("alias_domain")).drop("alias_domain")


def alias_domain_lookup(
    keys: DataFrame, alias: DataFrame, alias_domain: DataFrame, key: str = "rcpt"
) -> DataFrame:
    """``user@alias-domain`` through the alias of ``user@target``."""
    rows = _at_target(keys, alias_domain, key)
    wanted = F.concat(addr_local(key), F.lit("@"), "target_domain")
    book = _alias_map(alias)
    return rows.join(book, wanted == F.col("address")).drop("address")


def alias_domain_catchall(
    keys: DataFrame, alias: DataFrame, alias_domain: DataFrame, key: str = "rcpt"
) -> DataFrame:
    """Catch-all of the target domain."""
    rows = _at_target(keys, alias_domain, key)
    own = _small_catchalls(alias, "goto")
    return rows.join(own, F.col("target_domain") == F.col("__d")).drop("__d")


def alias_domain_mailbox(
    keys: DataFrame, mailbox: DataFrame, alias_domain: DataFrame, key: str = "rcpt"
) -> DataFrame:
    """Mailbox ``user@target`` reached through an alias domain."""
    rows = _at_target(keys, alias_domain, key)
    wanted = F.concat(addr_local(key), F.lit("@"), "target_domain")
    box = _active(mailbox).select(F.lower("username").alias("__u"), "maildir")
    return rows.join(box, wanted == F.col("__u")).drop("__u")


def _domain_facts(tables: Tables) -> DataFrame:
    """One row per domain: is it local, its target, its own and its target's catch-all."""
    own = local_domains(tables["domain"]).select(
        "domain", F.lit(True).alias("is_local"), F.lit(None).cast("string").alias("target")
    )
    aliased = alias_domains(tables["alias_domain"]).select(
        F.col("alias_domain").alias("domain"), F.lit(True).alias("is_local"),
        F.col("target_domain").alias("target"),
    )
    facts = own.unionByName(aliased).groupBy("domain").agg(
        F.max("is_local").alias("is_local"), F.max("target").alias("target")
    )
    any_own, any_target = _catchalls(tables["alias"], "catchall"), _catchalls(
        tables["alias"], "ad_catchall"
    )
    facts = facts.join(any_own, F.col("domain") == F.col("__d"), "left").drop("__d")
    return facts.join(any_target, F.col("target") == F.col("__d"), "left").drop("__d")


def _address_book(tables: Tables) -> DataFrame:
    """Active aliases and mailboxes side by side: one row per address."""
    aliases = _alias_map(tables["alias"]).select(
        "address", "goto", F.lit(None).cast("string").alias("maildir")
    )
    boxes = _active(tables["mailbox"]).select(
        F.lower("username").alias("address"), F.lit(None).cast("string").alias("goto"), "maildir"
    )
    return aliases.unionByName(boxes).groupBy("address").agg(
        F.max("goto").alias("goto"), F.max("maildir").alias("maildir")
    )


def resolve_addresses(keys: DataFrame, tables: Tables, mode: str = "strict") -> DataFrame:
    """Route of each row of ``keys`` (column ``key``: bare addresses, each once).

    The first map with an answer decides. ``strict`` follows the map order, in which a catch-all
    hides a mailbox without an alias of its own; ``mailbox_first`` asks the mailboxes before the
    catch-alls.
    """
    if mode not in ("strict", "mailbox_first"):
        raise ValueError(f"unknown mode {mode!r}")
    book = _address_book(tables)
    here = book.select(F.col("address").alias("__k1"), F.struct("goto", "maildir").alias("own"))
    there = book.select(F.col("address").alias("__k2"), F.struct("goto", "maildir").alias("ad"))
    rows = keys.withColumn("__dom", F.substring_index("key", "@", -1))
    facts = broadcast_if_small(_domain_facts(tables))
    rows = rows.join(facts, F.col("__dom") == F.col("domain"), "left").drop("domain")
    rows = rows.join(here, F.col("key") == F.col("__k1"), "left").drop("__k1")
    # A row outside alias domains asks for its own key again: a null key would pile up in a task.
    at_target = F.concat(F.substring_index("key", "@", 1), F.lit("@"), "target")
    rows = rows.withColumn("__want", F.coalesce(at_target, F.col("key")))
    rows = rows.join(there, F.col("__want") == F.col("__k2"), "left").drop("__k2", "__want")
    through = F.col("target").isNotNull()

    answers = {
        "alias": F.col("own.goto"),
        "ad_alias": F.when(through, F.col("ad.goto")),
        "ad_catchall": F.col("ad_catchall"),
        "catchall": F.col("catchall"),
        "mailbox": F.col("own.maildir"),
        "ad_mailbox": F.when(through, F.col("ad.maildir")),
    }
    order = ["alias", "ad_alias", "ad_catchall", "catchall", "mailbox", "ad_mailbox"]
    if mode == "mailbox_first":
        order = ["alias", "ad_alias", "mailbox", "ad_mailbox", "ad_catchall", "catchall"]
    local = F.coalesce("is_local", F.lit(False))
    route, target = F.when(~local, "relay_denied"), F.when(~local, F.lit(None).cast("string"))
    for name in order:
        hit = answers[name].isNotNull()
        route, target = route.when(hit, name), target.when(hit, answers[name])
    return rows.select(
        *[F.col(c) for c in keys.columns],
        route.otherwise("unlisted").alias("route"),
        target.alias("target"),
    )


def resolve_recipients(
    rcpts: DataFrame, tables: Tables, mode: str = "strict", key: str = "rcpt"
) -> DataFrame:
    """Each recipient with its route and target.

    Lookups run once per distinct address, so a busy recipient costs one row in every map join.
    """
    rows = rcpts.withColumn("key", bare_addr(key))
    routes = resolve_addresses(rows.select("key").distinct(), tables, mode)
    return rows.join(routes, "key", "left")


def route_counts(
    rcpts: DataFrame, tables: Tables, mode: str = "strict", key: str = "rcpt"
) -> DataFrame:
    """Recipients per route. Counts travel with the distinct addresses; nothing is joined back."""
    per_key = rcpts.groupBy(bare_addr(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    routes = resolve_addresses(per_key, tables, mode)
    return routes.groupBy("route").agg(
        F.sum("n").alias("recipients"), F.count(F.lit(1)).alias("addresses")
    )


def unlisted_recipients(rcpts: DataFrame, tables: Tables, key: str = "rcpt") -> DataFrame:
    """Recipients in a local domain that nothing resolves."""
    rows = rcpts.withColumn("key", bare_addr(key))
    routes = resolve_addresses(rows.select("key").distinct(), tables)
    bad = routes.where(F.col("route") == "unlisted").select("key")
    return rows.join(bad, "key", "left_semi")


def candidates(rcpts: DataFrame, tables: Tables, key: str = "rcpt") -> DataFrame:
    """All alias answers of each distinct address with their place in the map order."""
    keys = rcpts.select(bare_addr(key).alias("key")).distinct()
    alias, pairs = tables["alias"], tables["alias_domain"]

    def ranked(df: DataFrame, prio: int, name: str) -> DataFrame:
        return df.select("key", F.lit(prio).alias("prio"), F.lit(name).alias("map"), "goto")

    book = _alias_map(alias)
    exact = keys.join(book, F.col("key") == F.col("address"))
    here = F.substring_index("key", "@", -1) == F.col("__d")
    own = keys.join(_small_catchalls(alias, "goto"), here)
    return (
        ranked(exact, 1, "alias")
        .unionByName(ranked(alias_domain_lookup(keys, alias, pairs, "key"), 2, "ad_alias"))
        .unionByName(ranked(alias_domain_catchall(keys, alias, pairs, "key"), 3, "ad_catchall"))
        .unionByName(ranked(own, 4, "catchall"))
    )


def first_hit(cands: DataFrame, key: Sequence[str], prio: str) -> DataFrame:
    """The candidate with the lowest ``prio`` of each key. An aggregate, not a window: it
    combines on the map side and never holds the candidates of a key together."""
    rest = [c for c in cands.columns if c not in key and c != prio]
    best = F.min(F.struct(prio, *rest)).alias("best")
    return cands.groupBy(*key).agg(best).select(*key, F.col(f"best.{prio}"), *[
        F.col(f"best.{c}") for c in rest
    ])


def alias_rows(alias: DataFrame) -> DataFrame:
    """One row per alias target."""
    return alias.select(
        F.lower("address").alias("address"), F.explode(to_list(F.lower("goto"))).alias("target")
    )


# -- senders ---------------------------------------------------------------------------------


def allowed_logins(mailbox: DataFrame, alias: DataFrame) -> DataFrame:
    """Logins that may send as an address: its own mailbox and the targets of its alias."""
    own = iterate_users(mailbox).select(F.col("user").alias("address"), F.col("user").alias("login"))
    targets = alias_rows(_active(alias)).select("address", F.col("target").alias("login"))
    return own.union(targets).distinct()


def sender_authorised(
    sends: DataFrame, mailbox: DataFrame, alias: DataFrame, sender: str = "rcpt",
    login: str = "sasl_login", authorised: bool = True,
) -> DataFrame:
    """Sends whose login owns the sender address; with ``authorised=False`` the spoof attempts."""
    owners = allowed_logins(mailbox, alias)
    match = (bare_addr(sender) == F.col("address")) & (norm_addr(login) == F.col("login"))
    return sends.join(owners, match, "left_semi" if authorised else "left_anti")


# -- administration --------------------------------------------------------------------------


def admin_scope(requests: DataFrame, domain_admins: DataFrame) -> DataFrame:
    """Requests with the grant that covers them: ``all``, ``domain`` or ``none``.

    A grant for all domains stays one row instead of being multiplied by the domains: two
    equality lookups, no product of administrators and domains.
    """
    grants = _active(domain_admins)
    everywhere = grants.where(F.col("domain") == ALL_DOMAINS).select(
        F.lower("username").alias("__all")
    ).distinct()
    single = grants.where(F.col("domain") != ALL_DOMAINS).select(
        F.lower("username").alias("__u"), F.lower("domain").alias("__d")
    ).distinct()
    rows = requests.join(everywhere, F.lower("username") == F.col("__all"), "left")
    on = (F.lower("username") == F.col("__u")) & (F.lower("domain") == F.col("__d"))
    rows = rows.join(single, on, "left")
    scope = (
        F.when(F.col("__all").isNotNull(), "all").when(F.col("__u").isNotNull(), "domain")
        .otherwise("none")
    )
    return rows.select(*[F.col(c) for c in requests.columns], scope.alias("scope"))


def admin_domains(domain_admins: DataFrame, domain: DataFrame) -> DataFrame:
    """Number of domains each administrator may manage."""
    names = domain.where(F.col("domain") != ALL_DOMAINS).select(F.lower("domain").alias("domain"))
    total = names.count()
    grants = _active(domain_admins).select(
        F.lower("username").alias("username"),
        F.when(F.col("domain") == ALL_DOMAINS, F.col("domain")).otherwise(F.lower("domain"))
        .alias("domain"),
    )
    held = grants.join(names, "domain", "left_semi").groupBy("username").agg(
        F.count_distinct("domain").alias("held")
    )
    supers = grants.groupBy("username").agg(
        F.max((F.col("domain") == ALL_DOMAINS).cast("int")).alias("superadmin")
    )
    rows = supers.join(held, "username", "left")
    managed = F.when(F.col("superadmin") == 1, F.lit(total)).otherwise(
        F.coalesce("held", F.lit(0))
    )
    return rows.select("username", "superadmin", managed.cast("long").alias("domains"))


def domain_usage(domain: DataFrame, mailbox: DataFrame, alias: DataFrame) -> DataFrame:
    """Mailboxes and aliases per domain against its limits; 0 is no limit."""
    boxes = mailbox.groupBy(F.lower("domain").alias("domain")).agg(
        F.count(F.lit(1)).alias("n_mailboxes")
    )
    lists = alias.groupBy(F.lower("domain").alias("domain")).agg(
        F.count(F.lit(1)).alias("n_aliases")
    )
    kept = domain.where(F.col("domain") != ALL_DOMAINS).select(
        F.lower("domain").alias("domain"), F.col("mailboxes").alias("max_mailboxes"),
        F.col("aliases").alias("max_aliases"),
    )
    rows = kept.join(boxes, "domain", "left").join(lists, "domain", "left").na.fill(
        0, ["n_mailboxes", "n_aliases"]
    )

    def over(n: str, limit: str) -> Column:
        return ((F.col(limit) > 0) & (F.col(n) > F.col(limit))).cast("int")

    return rows.withColumn("over_mailboxes", over("n_mailboxes", "max_mailboxes")).withColumn(
        "over_aliases", over("n_aliases", "max_aliases")
    )


def address_rules(tables: Tables) -> DataFrame:
    """Address hygiene: findings as (finding, subject)."""
    boxes, aliases, domains = tables["mailbox"], tables["alias"], tables["domain"]
    names = boxes.select(F.lower("domain").alias("subject")).union(
        aliases.select(F.lower("domain").alias("subject"))
    ).distinct()
    bad_domain = names.where(~is_domain("subject")).select(
        F.lit("invalid domain name").alias("finding"), "subject"
    )
    bad_login = boxes.where(~is_login("username")).select(
        F.lit("invalid login characters").alias("finding"), F.lower("username").alias("subject")
    )
    listed = boxes.select(F.lower("username").alias("subject")).union(
        aliases.select(F.lower("address").alias("subject"))
    )
    wanted = local_domains(domains).select(
        F.explode(F.array(*[F.lit(r) for r in ROLE_ACCOUNTS])).alias("role"), "domain"
    ).select(F.concat("role", F.lit("@"), "domain").alias("subject"))
    no_role = wanted.join(listed, "subject", "left_anti").select(
        F.lit("role account missing").alias("finding"), "subject"
    )
    return bad_domain.unionByName(bad_login).unionByName(no_role)


def audit_summary(log: DataFrame) -> DataFrame:
    """Audit rows by domain, action and administrator, with subtotals.

    Counted once at the finest level; the subtotals are built from those few rows.
    """
    fine = log.groupBy("domain", "action", "username").agg(F.count(F.lit(1)).alias("n"))
    return fine.rollup("domain", "action", "username").agg(
        F.sum("n").alias("entries"), F.grouping_id().cast("int").alias("level")
    )
