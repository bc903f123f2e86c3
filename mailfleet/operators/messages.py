"""The message store: merging replicas, quotas, folders, routing, training."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfleet.functions.rules import first_match
from mailfleet.functions.scalars import age_s, epoch_s, norm_addr, pct, rewrite
from mailfleet.plans.fold import sequential
from mailfleet.plans.scan import balanced, per_second, running, segments, time_chunk
from mailfleet.sources.records import header_block, header_contains, header_is, header_list

# Days a folder keeps messages, folders outside the quota, special-use names.
RETENTION_DAYS = {"Junk": 30, "Trash": 60}
UNCOUNTED = ("Trash", "Junk")
SPECIAL_USE = {
    "Drafts": "Drafts",
    "Sent": "Sent",
    "Junk": "Junk",
    "Trash": "Trash",
    "Archive": "Archive",
    "Sent Messages": "Sent",
    "Sent Items": "Sent",
    "Deleted Items": "Trash",
    "Spam": "Junk",
}
QUOTA_STEPS = (80, 95, 100)
HIGH_SPAM_STARS = 10
MIN_LEARNS = 200
MIN_TOKENS = 11

# Headers taken out of submitted mail, and out of every message.
SUBMITTED_DROP = (
    r"^Received:.*with E?SMTPS?A[; ]",
    r"^X-Originating-IP:",
    r"^X-Enigmail-Version:",
    r"^X-Mailer:",
    r"^User-Agent:",
)
ALWAYS_DROP = (r"^Bcc:", r"^X-Mailer:\s*Postfix.*$")
MESSAGE_ID = r"(?i)^Message-ID:\s*<(.+)@[^>]+>.*$"


def _lookup(values: Mapping[str, object], key: str) -> Column:
    """A small literal table as an expression: no join."""
    return F.try_element_at(
        F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(key)
    )


# -- replicas of a store -----------------------------------------------------------------------


def merge_stores(a: DataFrame, b: DataFrame, key: Sequence[str] = ("username", "guid")) -> DataFrame:
    """Union merge of two stores on (user, message id): keeps mail unless a tombstone says not.

    A message on one side is copied; one that a side records as expunged goes on both; flags
    and folder come from the highest modification sequence. Both sides are stacked and combined
    by one aggregate, so the result does not depend on their order and a message occurs once.
    """
    cols = [*key, "folder", "vsize", "modseq", "flags", "expunged", "saved_at"]
    stacked = a.select(*cols, F.lit("A").alias("side")).unionByName(
        b.select(*cols, F.lit("B").alias("side"))
    )
    newest = F.struct("modseq", "flags", "folder")
    merged = stacked.groupBy(*key).agg(
        F.max(newest).alias("top"),
        F.max("vsize").alias("vsize"),
        F.min("saved_at").alias("saved_at"),
        F.max("expunged").alias("expunged"),
        F.count_if(F.col("side") == "A").alias("in_a"),
        F.count_if(F.col("side") == "B").alias("in_b"),
        F.max(F.when(F.col("side") == "A", F.struct("modseq", "flags", "folder"))).alias("at_a"),
        F.max(F.when(F.col("side") == "B", F.struct("modseq", "flags", "folder"))).alias("at_b"),
    )
    action = (
        F.when(F.col("expunged") == 1, "expunge").when(F.col("in_b") == 0, "copy_to_b")
        .when(F.col("in_a") == 0, "copy_to_a")
        .when(~F.col("at_a").eqNullSafe(F.col("at_b")), "update").otherwise("none")
    )
    return merged.select(
        *key, F.col("top.folder").alias("folder"), "vsize", F.col("top.modseq").alias("modseq"),
        F.col("top.flags").alias("flags"), "expunged", "saved_at", action.alias("action"),
    )


def at_resurrection_risk(merged: DataFrame, offline_since: Column, horizon_s: int, as_of: Column
                         ) -> DataFrame:
    """Messages a peer that was away longer than the tombstones are kept may bring back: present
    on one side only, and saved before the peer went away."""
    away = age_s(offline_since, as_of) > horizon_s
    one_sided = F.col("action").isin("copy_to_a", "copy_to_b")
    return merged.where(one_sided & away & (F.col("saved_at") < offline_since))


# -- folders and quota -------------------------------------------------------------------------


def mailbox_status(msgs: DataFrame) -> DataFrame:
    return msgs.groupBy("username", "folder").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("vsize").alias("vsize")
    )


def quota_usage(msgs: DataFrame, mailbox: DataFrame) -> DataFrame:
    """Bytes and messages that count, against the limit; 0 is no limit."""
    used = (
        msgs.where(~F.col("folder").isin(*UNCOUNTED))
        .groupBy(norm_addr("username").alias("username"))
        .agg(F.sum("vsize").alias("bytes"), F.count(F.lit(1)).alias("messages"))
    )
    limits = mailbox.select(F.lower("username").alias("username"), "quota")
    rows = limits.join(used, "username", "left").na.fill(0, ["bytes", "messages"])
    over = ((F.col("quota") > 0) & (F.col("bytes") > F.col("quota"))).cast("int")
    return rows.withColumn("percent", pct("bytes", "quota")).withColumn("over", over)


def quota_crossings(msgs: DataFrame, mailbox: DataFrame, chunk_s: int = 3600) -> DataFrame:
    """Warnings in arrival order: a message that takes a user past 80, 95 or 100 percent.

    Each user's running total is taken per hour and carried over, so a busy mailbox is not one
    task. A message that passes several steps names the highest.
    """
    counted = msgs.where(~F.col("folder").isin(*UNCOUNTED)).withColumn(
        "username", norm_addr("username")
    )
    order = ["saved_at", "doc_id"]
    cut = balanced(counted, ["username"], order, time_chunk("saved_at", chunk_s), "chunk")
    totals = running(cut, ["username"], order, F.col("chunk"), F.col("vsize"), "total")
    limits = mailbox.where(F.col("quota") > 0).select(F.lower("username").alias("__u"), "quota")
    rows = totals.join(limits, F.col("username") == F.col("__u"))

    def step(total: Column) -> Column:
        return F.greatest(
            *[F.when(total * 100 > F.col("quota") * s, s).otherwise(0) for s in QUOTA_STEPS]
        )

    now, before = step(F.col("total")), step(F.col("total") - F.col("vsize"))
    return rows.where(now > before).select(
        "username", "doc_id", "total", "quota", now.alias("step")
    )


def expired_messages(
    msgs: DataFrame, as_of: Column, policy: Mapping[str, int] = RETENTION_DAYS
) -> DataFrame:
    """Messages older than their folder's limit."""
    days = _lookup(policy, "folder")
    return msgs.where(days.isNotNull() & (age_s("saved_at", as_of) > days * 86400))


def special_use(folders: DataFrame) -> DataFrame:
    """Folders with the purpose their name stands for; null for the user's own folders."""
    return folders.withColumn("purpose", _lookup(SPECIAL_USE, "folder"))


def duplicate_folders(folders: DataFrame) -> DataFrame:
    """Users with more than one folder for a purpose."""
    known = special_use(folders).where("purpose is not null")
    return (
        known.groupBy("username", "purpose").agg(F.count_distinct("folder").alias("folders"))
        .where("folders > 1")
    )


# -- routing and headers -----------------------------------------------------------------------


def routing_rules(block: Column) -> list[tuple[Column, str]]:
    """Ordered delivery rules over the header text; the first that holds files the message."""
    return [
        (header_contains(block, "X-Spam", "Yes"), "Junk"),
        (header_contains(block, "X-Spam-Level", "*" * HIGH_SPAM_STARS), "Junk"),
        (
            header_contains(block, "Auto-Submitted", "auto-generated")
            | header_is(block, "X-Report-Type", "disposition-notification"),
            "Reports",
        ),
    ]


def route_messages(msgs: DataFrame, raw: str = "raw") -> DataFrame:
    """Folder and seen flag of each message. Depends on the message alone, so that every node
    decides alike."""
    out = msgs.withColumn("folder", first_match(routing_rules(header_block(raw)), "INBOX"))
    return out.withColumn("seen", (F.col("folder") == "Junk").cast("int"))


def clean_headers(
    msgs: DataFrame, domain: str, raw: str = "raw", submitted: str = "submitted"
) -> DataFrame:
    """Header block without private hops and client headers where the message was submitted, and
    without blind copies everywhere; a submitted message id gets our domain."""
    is_ours = F.col(submitted) == 1

    def dropped(line: Column) -> Column:
        always = F.lit(False)
        for p in ALWAYS_DROP:
            always = always | line.rlike(f"(?i){p}")
        ours = F.lit(False)
        for p in SUBMITTED_DROP:
            ours = ours | line.rlike(f"(?i){p}")
        return always | (is_ours & ours)

    lines = F.transform(
        header_list(raw), lambda h: F.concat(h["name"], F.lit(": "), h["value"])
    )
    kept = F.filter(lines, lambda line: ~dropped(line))
    rewritten = F.transform(
        kept,
        lambda line: F.when(is_ours, rewrite(line, MESSAGE_ID, f"Message-ID: <$1@{domain}>"))
        .otherwise(line),
    )
    return msgs.withColumn("clean", F.array_join(rewritten, "\n"))


def training_labels(moves: DataFrame) -> DataFrame:
    """Spam when moved into Junk, ham when moved out of it; out to Trash says nothing."""
    label = first_match([
        (F.col("to_folder") == "Junk", "spam"),
        ((F.col("from_folder") == "Junk") & (F.col("to_folder") != "Trash"), "ham"),
    ])
    return moves.withColumn("label", label).where("label is not null")


# -- classifier --------------------------------------------------------------------------------


def message_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct lower-case words of each message, from the whole text: runs of letters and digits of any script."""
    words = F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"))
    return docs.select(F.col(key), F.explode(F.array_remove(words, "")).alias("token"))


def bayes_train(tokens: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Messages per class in which each token occurs. The sum combines on the map side, so a
    word of every message costs one row per task."""
    classed = tokens.join(labels.select(key, "is_spam"), key)
    return classed.groupBy("token").agg(
        F.count_if(F.col("is_spam") == 1).alias("spam"),
        F.count_if(F.col("is_spam") == 0).alias("ham"),
    )


def bayes_score(
    tokens: DataFrame, model: DataFrame, labels: DataFrame, key: str = "doc_id",
    min_learns: int = MIN_LEARNS, min_tokens: int = MIN_TOKENS,
) -> DataFrame:
    """Log-odds of spam per message, with add-one smoothing.

    Null until both classes have ``min_learns`` messages, and for a message with fewer than
    ``min_tokens`` known tokens. ``model`` should be a stored table: its true size then decides
    between a broadcast, after which nothing but partial sums is shuffled, and a shuffled join,
    whose frequent words the adaptive planner splits.
    """
    classes = labels.agg(
        F.count_if(F.col("is_spam") == 1).alias("spam"),
        F.count_if(F.col("is_spam") == 0).alias("ham"),
    ).first()
    in_spam = (F.col("spam") + 1) / (classes.spam + 2)
    in_ham = (F.col("ham") + 1) / (classes.ham + 2)
    weighted = model.select("token", F.log(in_spam / in_ham).alias("weight"))
    per_msg = tokens.join(weighted, "token").groupBy(key).agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("weight").alias("log_odds")
    )
    learned = min(classes.spam, classes.ham) >= min_learns
    ready = F.lit(learned) & (F.col("tokens") >= min_tokens)
    return per_msg.select(key, "tokens", F.when(ready, F.col("log_odds")).alias("log_odds"))


# -- vacation ----------------------------------------------------------------------------------


def vacation_candidates(msgs: DataFrame, vacation: DataFrame, keep_end: bool = False) -> DataFrame:
    """Messages that arrive while their recipient is away, with the recipient's interval (and, on
    demand, the end of the absence)."""
    away = vacation.where(F.col("active") == 1).select(
        F.lower("email").alias("__e"), "activefrom", "activeuntil", "interval_time"
    )
    rows = msgs.withColumn("rcpt", norm_addr("rcpt")).withColumn("sender", norm_addr("sender"))
    in_time = F.col("ts").between(F.col("activefrom"), F.col("activeuntil"))
    joined = rows.join(away, (F.col("rcpt") == F.col("__e")) & in_time)
    return joined.drop("__e", "activefrom", *([] if keep_end else ["activeuntil"]))


def reply_once(interval_s: int, until: int | None, second: int) -> int | None:
    """New end of silence when a message at ``second`` is answered, else None. An interval of 0
    answers a sender once and never again."""
    if until is not None and second < until:
        return None
    return second + interval_s if interval_s > 0 else 2**62


def vacation_replies(msgs: DataFrame, vacation: DataFrame, notified: DataFrame) -> DataFrame:
    """Replies to send as (rcpt, sender, second): the recipient is away when the message arrives
    and the sender has had no reply within the recipient's interval.

    Recorded notifications are taken out by a join; what is left is one row per pair and second,
    and is walked in order because each reply silences the next messages.
    """
    rows = vacation_candidates(msgs, vacation)
    earlier = notified.groupBy(
        F.lower("on_vacation").alias("__o"), F.lower("notified").alias("__n")
    ).agg(F.max(epoch_s("notified_at")).alias("__at"))
    on = (F.col("rcpt") == F.col("__o")) & (F.col("sender") == F.col("__n"))
    second, interval = epoch_s("ts"), F.col("interval_time")
    silent = (second >= F.col("__at")) & (
        (interval == 0) | (second < F.col("__at") + interval)
    )
    rows = rows.join(earlier, on, "left").where(~F.coalesce(silent, F.lit(False)))
    seconds = rows.select(
        "rcpt", "sender", second.alias("second"), interval.cast("bigint").alias("interval_s")
    ).distinct()

    def fold(key, group):
        until = None
        for at, interval_s in group:
            after = reply_once(interval_s, until, at)
            if after is not None:
                until = after
                yield (at,)

    return sequential(
        seconds, ["rcpt", "sender"], ["second"], fold, "rcpt string, sender string, second bigint"
    )


# -- sessions ----------------------------------------------------------------------------------


def sessionize(
    events: DataFrame, gap_s: int = 1800, chunk_s: int = 3600, ts: str = "ts",
    named_gap_s: int | None = None,
) -> DataFrame:
    """Sessions per user: by session id where the line has one, else by a quiet gap.

    With ``named_gap_s`` a session with an id ends, too, when it has been quiet for so long; its id may
    then begin again. A stream needs that, because it cannot wait for ever.

    A busy user is cut by the hour and the session number is carried over. The gap scan looks at
    distinct seconds, summed on the map side.
    """
    named = F.col("session_id") != ""
    totals = [F.min("second").alias("start"), F.max("second").alias("end"), F.sum("n").alias("events")]

    def by_gap(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
        cut = segments(
            per_second(rows, keys, ts), keys, "second", F.floor(F.col("second") / chunk_s), F.lit(gap), "number")
        return cut.groupBy(*keys, "number").agg(*totals).drop("number")

    if named_gap_s is None:
        by_id = events.where(named).groupBy("username", "session_id").agg(
            F.min(epoch_s(ts)).alias("start"), F.max(epoch_s(ts)).alias("end"),
            F.count(F.lit(1)).alias("events"),
        )
    else:
        by_id = by_gap(events.where(named), ["username", "session_id"], named_gap_s)
    unnamed = by_gap(events.where(~named), ["username"], gap_s)
    return by_id.unionByName(unnamed.withColumn("session_id", F.lit("")))


# -- delivery ----------------------------------------------------------------------------------

# When a sender is warned and a message given up.
WARN_AFTER_S = 4 * 3600
EXPIRE_AFTER_S = 3 * 86400


def delivery_outcomes(queue: DataFrame) -> DataFrame:
    """Fate of each queued message: whether the sender was warned, delivered or bounced.

    ``delivered_after_s`` is null while a message cannot be delivered; one that takes longer than
    the lifetime bounces as well.
    """
    age = F.col("delivered_after_s")
    done = age.isNotNull() & (age < EXPIRE_AFTER_S)
    lived = F.when(done, age).otherwise(EXPIRE_AFTER_S)
    return queue.select(
        "queue_id",
        (lived >= WARN_AFTER_S).cast("int").alias("warned"),
        F.when(done, "delivered").otherwise("bounced").alias("outcome"),
    )
