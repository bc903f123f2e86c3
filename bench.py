"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from mailfleet.catalog import QUERIES
from mailfleet.plans.session import local_session

HEADLINE = (
    "join05_resolve_recipients", "join05_route_counts", "join06_expand_aliases",
    "join07_sender_authorised", "join09_replica_diff", "join12_merge_stores",
    "join14_dns_diff", "join18_requests_while_banned", "join20_vacation_replies",
    "join22_verify_manifest", "agg03_ordered_checksum", "agg06_quota_usage", "agg13_node_traffic",
    "agg14_bayes_train", "agg14_bayes_score", "agg15_audit_summary", "fil11_restriction_chain",
    "fil16_replica_problems", "rul01_dns_posture", "rul06_route_messages", "rul07_clean_headers",
    "src02_parse_access_log", "src03_parse_webmail_auth", "snk02_changed_only",
    "sort03_top_sources", "win02_transitions", "win03_install_decisions", "win05_ban_events",
    "win06_recidive", "win07_queue_trend", "str01_ban_ledger",
    "str01_ban_stream", "str03_watchdog_stream", "str04_alert_stream",
    "str07_message_state_stream",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "mailfleet-bench")
    # One small query first, so that starting the engine is not counted.
    QUERIES["join05_route_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
