"""HTTP policy: classification, delays, and the state machines as windows and grouped folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ranges import SO_FAR, crowded, in_ranges, over_ranges, place

# Limits of the retry policy, statuses that are retried, enums that mean a used-up quota.
BASE, CAP, MAX_ATTEMPTS, BREAKER = 1.0, 30.0, 4, 5
RETRYABLE = (408, 429, 500, 502, 503, 504, 529)
FATAL_ENUMS = ("insufficient_quota", "billing_hard_limit_reached", "billing_not_active", "access_terminated")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def classify(status: Column, enum: Column | None = None) -> Column:
    """ok, retry or fatal. Only 200 is ok; no status (transport failure) is retried; a used-up quota is fatal."""
    quota = F.coalesce(enum.isin(*FATAL_ENUMS), F.lit(False)) if enum is not None else F.lit(False)
    return (
        F.when(status.isNull(), "retry").when(status == 200, "ok").when(status.isin(*RETRYABLE) & ~quota, "retry").otherwise("fatal")
    )


def status_label(status: Column) -> Column:
    """A label made from the status alone."""
    s = status.cast("string")
    return (
        F.when(status.isNull(), "transport-error")
        .when(status == 401, "auth-failed-401 (check API key)")
        .when(status == 429, "rate-limited-429")
        .when(status == 408, "request-timeout-408")
        .when(status >= 500, F.concat(F.lit("server-error-"), s))
        .otherwise(F.concat(F.lit("http-"), s))
    )


def single_attempt(status: Column, enum: Column | None = None, retry_after: Column | None = None) -> Column:
    """(outcome, status, retry_after, error) of one attempt whose retries another decides.

    A fatal outcome is auth-fatal for 401 and 403, else request-fatal; a delay goes with retry alone, an error with all but ok.
    """
    kind, wait = classify(status, enum), F.lit(None).cast("double") if retry_after is None else retry_after
    return F.struct(
        F.when(kind != "fatal", kind).when(status.isin(401, 403), "auth-fatal").otherwise("request-fatal").alias("outcome"),
        status.alias("status"),
        F.when(kind == "retry", wait).alias("retry_after"),
        F.when(kind != "ok", status_label(status)).alias("error"),
    )


#: The error names that may be shown.
SHOWN_ENUMS = (
    "rate_limit_exceeded", "server_error", "tokens", "requests", "rate_limit_error", "overloaded_error", "api_error", "timeout", "RESOURCE_EXHAUSTED", "UNAVAILABLE",
    "INTERNAL", "DEADLINE_EXCEEDED",
)


def error_label(body: Column) -> Column:
    """The error names in a JSON body that may be shown, each once, joined by /; null if none."""
    names = F.array(*(F.get_json_object(body, f"$.error.{k}") for k in ("type", "code", "status")))
    shown = F.array_distinct(F.filter(names, lambda x: x.isin(*SHOWN_ENUMS)))
    return F.when(F.size(shown) > 0, F.array_join(shown, "/"))


def fatal_enum(body: Column) -> Column:
    """The first of the names in a JSON error body (type, code, status) that means a used-up quota; null if none does."""
    names = F.array(*(F.get_json_object(body, f"$.error.{k}") for k in ("type", "code", "status")))
    return F.get(F.filter(names, lambda x: x.isin(*FATAL_ENUMS)), F.lit(0))


def wait_of(dialect: Column, headers: Column, body: Column, now: Column) -> Column:
    """Seconds that an answer asks to wait: what its headers say, but in dialect c what its body says, if it says anything."""
    from_headers = retry_after(header(headers, "retry-after-ms"), header(headers, "Retry-After"), now)
    return F.coalesce(F.when(dialect == "c", google_retry_delay(body)), from_headers)


def next_delay(attempt: Column, status: Column, retry_after: Column) -> Column:
    """Seconds until the next attempt; null where there is none."""
    wait = F.when(retry_after.isNotNull(), F.when(retry_after <= CAP, retry_after)).otherwise(F.least(F.lit(CAP), BASE * F.pow(F.lit(2.0), attempt - 1)))
    return F.when(status.isin(*RETRYABLE) & (attempt < MAX_ATTEMPTS), wait)


def header(headers: Column, name: str) -> Column:
    """Value of the first header of a name, whatever its case; headers are (field, value) pairs."""
    return F.get(F.filter(headers, lambda h: F.lower(h["field"]) == name.lower()), F.lit(0))["value"]


def http_date_seconds(text: Column, now: Column) -> Column:
    """Seconds from ``now`` (Unix) to an RFC 1123 date in GMT or UTC, at least 0; null for anything else."""
    pattern = r"^\s*([A-Za-z]{3}),\s+(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+(\d{2}):(\d{2}):(\d{2})\s+([A-Za-z]+)\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(3))
    ok = text.rlike(pattern) & F.upper(part(8)).isin("GMT", "UTC") & (month > 0)
    # The parser refuses days and hours out of range, leap days included.
    stamp = F.concat_ws(" ", F.concat_ws("-", part(4), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0")), F.concat_ws(":", part(5), part(6), part(7)))
    at = F.unix_timestamp(F.try_to_timestamp(F.when(ok, stamp), F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.when(at.isNotNull(), F.greatest(F.lit(0.0), (at - now).cast("double")))


def retry_after(ms: Column, value: Column, now: Column) -> Column:
    """Seconds to wait: milliseconds first, else seconds, else a date; a negative number ends the search."""
    n_ms, n = ms.try_cast("double"), value.try_cast("double")
    later = F.when(n.isNotNull(), F.when(n >= 0, n)).otherwise(http_date_seconds(value, now))
    return F.when(n_ms.isNotNull(), F.when(n_ms >= 0, n_ms / 1000)).otherwise(later)


def duration(text: Column) -> Column:
    """Seconds of a duration such as 1.5s; null for anything else."""
    return F.when(text.rlike(r"^(\d+\.?\d*|\d*\.\d+)s$"), F.regexp_extract(text, r"^(.*)s$", 1).cast("double"))


def google_retry_delay(body: Column) -> Column:
    """Delay of the first RetryInfo entry among the details of a JSON error body."""
    kind = "struct<error:struct<details:array<struct<`@type`:string,retryDelay:string>>>>"
    details = F.from_json(body, kind)["error"]["details"]
    return duration(F.get(F.filter(details, lambda d: d["@type"].endswith("google.rpc.RetryInfo")), F.lit(0))["retryDelay"])


def terminal_attempt(attempts: DataFrame, item: str = "item") -> DataFrame:
    """Of each item the attempt that ends it: the first that is not retried, or the last allowed one."""
    kind = classify(F.col("status"))
    ends = attempts.filter(F.col("attempt") <= MAX_ATTEMPTS).withColumn("outcome", kind)
    w = Window.partitionBy(item).orderBy(F.when((F.col("outcome") != "retry") | (F.col("attempt") == MAX_ATTEMPTS), 0).otherwise(1), "attempt")
    last = ends.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return last.withColumn("outcome", F.when(F.col("outcome") == "retry", F.when(F.col("attempt") == MAX_ATTEMPTS, "exhausted").otherwise("pending")).otherwise(F.col("outcome")))


def degraded_items(attempts: DataFrame, run: str = "run_id", item: str = "item", seq: str = "seq", threshold: int = BREAKER) -> DataFrame:
    """(run, item, seq, outcome, calls) of each item under its run's breaker.

    ``attempts`` has (run, item, attempt, status) and the item's place in the run, ``seq``. An item whose breaker is open when
    it comes makes no call; it is degraded, as is one whose attempts are used up. As a breaker stays open, what would have been
    called behind it changes nothing.
    """
    ended = terminal_attempt(attempts, item).select(run, item, F.col(seq).alias("seq"), "attempt", "outcome")
    opened = breaker(ended, run, threshold).filter("open").groupBy(F.col(run).alias("_run")).agg(F.min("seq").alias("_opened"))
    joined = ended.join(opened, F.col(run).eqNullSafe(F.col("_run")), "left")
    called = F.col("_opened").isNull() | (F.col("seq") <= F.col("_opened"))
    outcome = F.when(called & (F.col("outcome") != "exhausted"), F.col("outcome")).otherwise("degraded")
    return joined.select(run, item, "seq", outcome.alias("outcome"), F.when(called, F.col("attempt")).otherwise(0).alias("calls"))


def breaker(events: DataFrame, run: str = "run_id", threshold: int = BREAKER, split: bool | None = None, before: DataFrame | None = None) -> DataFrame:
    """Adds ``consecutive`` and ``open`` after each event (run, seq, outcome): it opens, and stays open, after so many in a row.

    Runs too large for a task, or all with ``split``, are worked on in ranges. What a range does to the state that it is given, is
    to add what it began with to it, to open if that is enough, or to start anew: such steps are composed over one row for each range.
    ``before`` (run, consecutive, open) is the state that runs begin with; it enters as a first event of theirs.
    """
    bad = F.col("outcome") == "exhausted"
    rows = events.withColumn("_weight", F.when(bad, 1).otherwise(0).cast("long")).withColumn("_reset", ~F.coalesce(bad, F.lit(False))).withColumn("_forced", F.lit(False))
    rows = rows.withColumn("_given", F.lit(None).cast("boolean"))
    if before is not None:
        first = before.select(run, F.col("consecutive").cast("long").alias("_weight"), F.lit(False).alias("_reset"), F.col("open").alias("_forced"), F.lit(True).alias("_given"))
        rows = rows.unionByName(first, allowMissingColumns=True)
    names = [*events.columns, "consecutive", "open"]
    if not (crowded(events, [run]) if split is None else split):
        done = _counted(rows, Window.partitionBy(run), threshold)
    else:
        done = _stitched_runs(rows, run, threshold)
    return done.filter("_given IS NULL").select(*names)


def early_stop(broken: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, done, deferred) of a run's events with their breaker: the event that opens it is the last one done."""
    opened = F.count_if("open")
    deferred = F.when(opened > 0, opened - 1).otherwise(0)
    return broken.groupBy(run).agg((F.count("*") - deferred).alias("done"), deferred.cast("long").alias("deferred"))


def _by_seq() -> list[Column]:
    return [F.asc_nulls_first("seq"), F.asc_nulls_last("_given")]


def _counted(rows: DataFrame, group: WindowSpec, threshold: int) -> DataFrame:
    """Adds consecutive, open, and the sums of weights at the group's first reset so far, ``_prefix``, and at its last, ``_last``."""
    w = group.orderBy(*_by_seq()).rowsBetween(*SO_FAR)
    at_reset = F.when(F.col("_reset"), F.col("_sum"))
    summed = rows.withColumn("_sum", F.sum("_weight").over(w))
    summed = summed.withColumn("_prefix", F.min(at_reset).over(w)).withColumn("_last", F.max(at_reset).over(w))
    counted = summed.withColumn("consecutive", F.col("_sum") - F.coalesce("_last", F.lit(0)))
    return counted.withColumn("open", F.max((F.col("consecutive") >= threshold) | F.col("_forced")).over(w))


def _stitched_runs(rows: DataFrame, run: str, threshold: int) -> DataFrame:
    ranged = in_ranges(rows, [F.asc_nulls_last(run), *_by_seq()], "run-ranges")
    local = _counted(ranged, Window.partitionBy("_part", run), threshold)
    key = place(run)
    # What each range does to its last run, a row for each range; only its first and last run can be in other ranges too.
    ends = local.groupBy("_part", run).agg(
        F.max("_sum").alias("total"), F.min("_prefix").alias("prefix"), F.max("_last").alias("last"), F.max("open").alias("opened")
    )
    facts = F.struct("total", F.coalesce("prefix", "total").alias("prefix"), F.col("last").isNotNull().alias("resets"), (F.col("total") - F.coalesce("last", F.lit(0))).alias("trailing"), "opened")
    edges = ends.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("end"), F.max_by(facts, key).alias("f"))
    same = F.coalesce(F.lag("end").over(over_ranges()) == F.col("first"), F.lit(False))
    edges = edges.withColumn("same", same).withColumn("starts", ~F.col("same") | (F.col("first") != F.col("end")))
    island = edges.withColumn("_island", F.sum((F.col("starts") | F.col("f.resets")).cast("int")).over(over_ranges().rowsBetween(*SO_FAR)))
    island = island.withColumn("_runs", F.sum(F.col("starts").cast("int")).over(over_ranges().rowsBetween(*SO_FAR)))
    after = island.withColumn("_after", F.sum("f.trailing").over(Window.partitionBy("_island").orderBy("_part").rowsBetween(*SO_FAR)))
    given = after.withColumn("carry", F.when(F.col("same"), F.lag("_after").over(over_ranges())).otherwise(0))
    hit = F.col("f.opened") | (~F.col("starts") & (F.col("carry") + F.col("f.prefix") >= threshold))
    opened = given.withColumn("_open", F.max(hit).over(Window.partitionBy("_runs").orderBy("_part").rowsBetween(*SO_FAR)))
    edge = opened.select("_part", F.col("first").alias("_first"), F.col("carry").alias("_carry"), (F.col("same") & F.lag("_open").over(over_ranges())).alias("_was_open"))
    mine = key == F.col("_first")
    begun = F.coalesce("_prefix", "_sum") + F.col("_carry")  # in a row, counted with what came before the range, up to the first reset
    joined = local.join(F.broadcast(edge), "_part")
    is_open = F.col("open") | (mine & (F.coalesce("_was_open", F.lit(False)) | (begun >= threshold)))
    return joined.withColumn("open", is_open).withColumn("consecutive", F.col("consecutive") + F.when(mine & F.col("_last").isNull(), F.col("_carry")).otherwise(0))


def gate(canceled: Column, token: Column, is_open: Column, error: Column, response: Column) -> Column:
    """Status of a call: no token defers, a cancel wins over the breaker, an error without response is fatal."""
    return (
        F.when(~token, "deferred").when(canceled, "cancelled").when(is_open, "deferred").when(response.isNotNull(), "identified")
        .when(error.isNotNull(), "fatal").otherwise("deferred")
    )


def preview_verdict(canceled: Column, first_event: Column, elapsed_ms: Column, timeout_ms: int = 30_000) -> Column:
    """cancelled over ready over failed over timeout over pending; only the first callback counts."""
    return (
        F.when(canceled, "cancelled").when(first_event == "ready", "ready").when(first_event == "failed", "failed")
        .when(elapsed_ms >= timeout_ms, "timeout").otherwise("pending")
    )


def fold(events: DataFrame, key: str, order: str, step, start, schema: str) -> DataFrame:
    """A sequential fold over each key's rows in order, streamed partition by partition.

    ``step(state, row) -> (state, columns)``. Rows come sorted, so only one row and one state are held,
    whatever the size of a key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, names = None, None, [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if k != current:
                    current, state = k, start()
                state, made = step(state, row)
                out.append(made)
            yield pd.DataFrame(out, columns=names)

    return events.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def take_token(state: tuple, now: float, rate: float, capacity: float) -> tuple[tuple, bool, float]:
    """Lazy refill, then one token if there is one: (state, granted, wait). A clock that goes back adds nothing."""
    tokens, last = state
    if rate <= 0:
        return state, True, 0.0
    known = now == now
    if last is not None and known:
        tokens = min(capacity, tokens + max(0.0, now - last) * rate)
    last = now if known and (last is None or now > last) else last
    if tokens >= 1:
        return (tokens - 1, last), True, 0.0
    return (tokens, last), False, (1 - tokens) / rate


def token_bucket(events: DataFrame, rate: float, capacity: float = 1.0, run: str = "run_id") -> DataFrame:
    """(run_id, seq, granted, wait) of events (run, seq, now)."""

    def step(state, row):
        state, ok, wait = take_token(state, float(row.now), rate, capacity)
        return state, (row.run_id, row.seq, ok, wait)

    rows = events.select(F.col(run).alias("run_id"), "seq", F.col("now").cast("double").alias("now"))
    return fold(rows, "run_id", "seq", step, lambda: (capacity, None), "run_id long, seq long, granted boolean, wait double")


def record_key(slot: dict, outcome: str, now: float, wait: float | None) -> dict:
    """A slot's health after an outcome: ok clears, retire parks it for good, cooldown waits longer each time; any other changes nothing."""
    if outcome == "ok":
        return {"cool": 0.0, "retired": slot["retired"], "exhausted": False, "attempt": 0}
    if outcome == "retire":
        return slot | {"retired": True}
    if outcome != "cooldown":
        return slot
    attempt = slot["attempt"] + 1
    delay = None if attempt >= MAX_ATTEMPTS else wait if wait is not None else min(CAP, BASE * 2 ** (attempt - 1))
    if delay is None or delay > CAP:
        return slot | {"attempt": attempt, "exhausted": True}
    return slot | {"attempt": attempt, "cool": now + delay}


def keyring(events: DataFrame, slots: int = 3, run: str = "run_id") -> DataFrame:
    """(run_id, seq, selected, healthy): the first healthy slot at each event, whose outcome is then recorded; 0 if none."""

    def fresh():
        return [{"cool": 0.0, "retired": False, "exhausted": False, "attempt": 0} for _ in range(slots)]

    def step(state, row):
        healthy = [i for i, s in enumerate(state) if not s["retired"] and not s["exhausted"] and s["cool"] <= row.now]
        if healthy:
            state[healthy[0]] = record_key(state[healthy[0]], row.outcome, row.now, None)
        return state, (row.run_id, row.seq, healthy[0] + 1 if healthy else 0, len(healthy))

    rows = events.select(F.col(run).alias("run_id"), "seq", F.col("now").cast("double").alias("now"), "outcome")
    return fold(rows, "run_id", "seq", step, fresh, "run_id long, seq long, selected long, healthy long")


def failover(items: DataFrame, order: tuple[int, ...] = (1, 2, 3), run: str = "run_id") -> DataFrame:
    """(run_id, seq, outcome, slot, attempts, waited): each item tries slots in order until one answers.

    ``items`` (run, seq, now, answers): ``answers`` maps a slot to what its attempts at this item give, structs
    (outcome, status, retry_after) as of ``single_attempt``; beyond its end the last one repeats, and a slot
    without any gives retry. auth-fatal retires a slot, retry cools it, and the next healthy slot follows at
    once; request-fatal ends the item. A lone slot waits and tries again. With no healthy slot the item is
    deferred (slot 0), which alone counts as exhausted for the breaker. Health lasts for the run.
    """

    def fresh():
        return {s: {"cool": 0.0, "retired": False, "exhausted": False, "attempt": 0} for s in order}

    def step(slots, row):
        answers, tried, waited, forced = dict(row.answers or {}), dict.fromkeys(order, 0), 0.0, None
        while True:
            ready = [s for s in order if not slots[s]["retired"] and not slots[s]["exhausted"] and slots[s]["cool"] <= row.now]
            slot = forced or (ready[0] if ready else None)
            if slot is None:
                return slots, (row.run_id, row.seq, "defer", 0, sum(tried.values()), waited)
            given = answers.get(slot)
            got = given[min(tried[slot], len(given) - 1)] if given is not None and len(given) else {"outcome": "retry", "status": None, "retry_after": None}
            tried[slot] += 1
            forced = None
            if got["outcome"] == "ok":
                slots[slot] = record_key(slots[slot], "ok", row.now, None)
            elif got["outcome"] == "auth-fatal" or got["status"] in (401, 403):
                slots[slot] = record_key(slots[slot], "retire", row.now, None)
                continue
            elif got["outcome"] != "request-fatal":
                slots[slot] = record_key(slots[slot], "cooldown", row.now, got["retry_after"])
                cooled = slots[slot]
                if len(order) == 1 and not cooled["exhausted"] and cooled["cool"] > row.now:
                    waited, forced = waited + cooled["cool"] - row.now, slot
                continue
            return slots, (row.run_id, row.seq, got["outcome"], slot, sum(tried.values()), waited)

    rows = items.select(F.col(run).alias("run_id"), "seq", F.col("now").cast("double").alias("now"), "answers")
    return fold(rows, "run_id", "seq", step, fresh, "run_id long, seq long, outcome string, slot long, attempts long, waited double")
