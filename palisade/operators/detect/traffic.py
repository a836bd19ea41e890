"""Detectors over requests, responses, pages and transcripts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.coerce import JsonBody
from palisade.functions.text import decode_payload, entropy, host, path_template, url_decoded
from palisade.operators.automata import run_automaton
from palisade.operators.detect.rules import pack
from palisade.operators.joins import first_follower
from palisade.operators.ordered import int_bucket, ranged_sums
from palisade.operators.sketches import heavy_hitters
from palisade.operators.windows import burst
from palisade.session import cut_lineage


def sqli_class(query: Column) -> Column:
    """union, time, boolean, quote or NULL for a request's parameters."""
    p = {r.rule_id: r.pattern for r in pack("D6")}
    text = decode_payload(query)
    left, right = (F.regexp_extract(text, p["sqli.boolean"], i) for i in (2, 3))
    return (
        F.when(text.rlike(p["sqli.union"]), "union")
        .when(text.rlike(p["sqli.time"]), "time")
        .when((left != "") & (left == right), "boolean")
        .when(F.contains(text, F.lit("'")), "quote")
    )


def payload_flags(df: DataFrame, query: str, *keys: str) -> DataFrame:
    """Other request payload attacks as one row per (request, kind)."""
    text = url_decoded(query)
    p = {r.rule_id: r.pattern for r in pack("D7")}
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.split(x, "=", 2)[0])
    kinds = F.array_compact(F.array(
        F.when(text.rlike(p["path.traversal"]), F.lit("traversal")),
        F.when(text.rlike(p["ssrf.metadata"]), F.lit("ssrf")),
        F.when(text.rlike(r"(?i)(^|[?&])(next|url|redirect|return)=https?://"), F.lit("redirect")),
        F.when(text.rlike(r"(?i)(\r|\n|%0d|%0a)[A-Za-z-]+:"), F.lit("header_injection")),
        F.when(F.size(names) > F.size(F.array_distinct(names)), F.lit("parameter_pollution")),
        F.when(text.rlike(r"(?i)<!ENTITY"), F.lit("xml_entity")),
    ))
    return df.select(*keys, F.explode(kinds).alias("kind"))


def verb_tampering(requests: DataFrame, allowed: tuple[str, ...] = ("GET", "POST", "PUT", "DELETE")) -> DataFrame:
    return requests.where(~F.upper("method").isin(*allowed))


def error_rate(events: DataFrame, key: Column, name: str, failed: Column, floor: float) -> DataFrame:
    """Groups whose share of failures is at least ``floor``."""
    return events.groupBy(key.alias(name)).agg(
        F.count("*").alias("total"), F.sum(F.when(failed, 1).otherwise(0)).alias("errors")
    ).withColumn("rate", F.round(F.col("errors") / F.col("total"), 6)).where(F.col("rate") >= floor)


def foreign_access(requests: DataFrame, object_id: str, caller: str, objects: DataFrame, pk: str, owner: str) -> DataFrame:
    """Requests for objects of somebody else."""
    own = objects.select(F.col(pk).alias("_pk"), F.col(owner).alias("owner"))
    return requests.join(own, F.col(object_id) == F.col("_pk")).where(F.col(caller) != F.col("owner")).drop("_pk")


def cross_tenant(requests: DataFrame, object_id: str, caller: str, objects: DataFrame, pk: str, owner: str, members: DataFrame, member: str, tenant: str) -> DataFrame:
    """Requests for objects of another tenant: the caller's tenant and the owner's differ, both known."""
    of = lambda who, name: members.select(F.col(member).alias(who), F.col(tenant).alias(name))
    foreign = foreign_access(requests, object_id, caller, objects, pk, owner)
    return foreign.join(of("_m", "tenant"), F.col(caller) == F.col("_m")).drop("_m").join(
        of("_o", "owner_tenant"), F.col("owner") == F.col("_o")).drop("_o").where(F.col("tenant") != F.col("owner_tenant"))


def mass_assignment(requests: DataFrame, allowed: list[str], body: str, *keys: str) -> DataFrame:
    """Body keys outside the allowed list, one row each."""
    extra = F.array_except(JsonBody(body).keys(), F.array(*[F.lit(a) for a in allowed]).cast("array<string>"))
    return requests.select(*keys, F.explode(extra).alias("key"))


def bruteforce(events: DataFrame, n: int, delta_us: int) -> DataFrame:
    """Users with bursts of failures: bursts, widest burst, first alarm."""
    hits = burst(events.where(F.col("event_type") == "error"), "user_id", "ts", n, delta_us, "event_id")
    return hits.groupBy("user_id").agg(
        F.count("*").alias("alarms"), F.max("in_window").alias("peak"), F.min("event_id").alias("first_event")
    )


def spraying(events: DataFrame, source: Column, failed: Column, users: int) -> DataFrame:
    """Sources whose failures touch at least ``users`` different users."""
    return events.where(failed).groupBy(source.alias("source")).agg(
        F.count("*").alias("failures"), F.count_distinct("user_id").alias("users")
    ).where(F.col("users") >= users)


def stuffing(events: DataFrame, source: Column, failed: Column, share: float, users: int, per_user: float) -> DataFrame:
    """Sources with at least ``share`` of all failures, spread over at least ``users`` users with few tries each.

    The sources are found by a frequent-item sketch; only their events are read for the exact counts.
    """
    hot = heavy_hitters(events.where(failed), source.cast("string"), share).select(F.col("item").alias("source"))
    theirs = events.withColumn("source", source.cast("string")).join(F.broadcast(hot), "source")
    return theirs.groupBy("source").agg(
        F.sum(failed.cast("bigint")).alias("failures"), F.count_distinct(F.when(failed, F.col("user_id"))).alias("users"),
        F.count_distinct(F.when(~failed, F.col("user_id"))).alias("entered")).where(
        (F.col("users") >= users) & (F.col("failures") <= per_user * F.col("users")))


def periodicity(events: DataFrame, key: str, ts: str, bin_us: int, lags: int, first_lag: int = 3, width: int = 1024) -> DataFrame:
    """(key, events, lag, strength): the lag in bins at which a key's activity repeats most, by autocorrelation.

    An event counts 2 in its bin and 1 in each neighbour, so beats that come a little early or late still meet; a missed beat
    lowers the sum by one product. Lags run up to ``lags`` and a third of the key's span. A key's bins are cut into blocks of ``width``
    bins, each with the next bins that its lags reach; products are made within a block, and one row of sums per block moves on. So
    every counted bin moves once, those near a block's border twice, and a key of any size is spread over its blocks.
    """
    bin_ = int_bucket(F.unix_micros(F.col(ts).cast("timestamp")), bin_us)
    counts = events.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), bin_.alias("b")).agg(F.count("*").alias("n"))
    # Events without a time have no bin and lie in no block, but count among the key's events.
    blocks = F.sequence(int_bucket(F.col("b") - (lags + 1), width), int_bucket(F.col("b") + 1, width))
    dealt = counts.select("_key", F.explode_outer(blocks).alias("block"), "b", "n").groupBy("_key", "block").agg(F.collect_list(F.struct("b", "n")).alias("bins"))
    kind = events.schema[key].dataType.simpleString()
    parts = dealt.mapInArrow(_block_sums(first_lag, lags, width), f"_key {kind}, s bigint, q bigint, low bigint, high bigint, p array<bigint>")
    each = range(lags - first_lag + 1)
    sums = parts.groupBy("_key").agg(
        F.sum("s").alias("s"), F.sum("q").alias("q"), (F.max("high") - F.min("low") + 1).alias("n"), F.array(*[F.sum(F.col("p")[i]) for i in each]).alias("p"))
    mean = F.col("s") * F.col("s") / F.col("n")

    def scored(p: Column, i: Column) -> Column:
        lag = i + first_lag
        strength = F.round((p * F.col("n") / (F.col("n") - lag) - mean) / (F.col("q") - mean), 6)
        return F.when((p > 0) & (3 * lag <= F.col("n")) & (F.col("q") > mean), F.struct(strength.alias("strength"), (-lag).alias("less")))

    best = sums.select("_key", F.expr("s DIV 4").alias("events"), F.array_max(F.transform("p", scored)).alias("m")).where(F.col("m").isNotNull())
    return best.select(F.col("_key").alias(key), "events", (-F.col("m.less")).alias("lag"), F.col("m.strength").alias("strength"))


def _block_sums(first_lag: int, lags: int, width: int):
    """Per (key, block) of bins (b, n), in any order: sum, sum of squares, ends and products by lag of the spread counts of the block's own bins."""
    span = width + 2 * lags + 8  # of a block's places; bins of different rows are more than ``lags`` apart

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few enough rows at once that full blocks stay small.
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            groups, lists = batch.num_rows, batch.column("bins")
            bins = lists.flatten()
            row = np.repeat(np.arange(groups), np.asarray(pc.list_value_length(lists), dtype=np.int64))
            n = np.asarray(bins.field("n"), dtype=np.int64)
            start = np.asarray(pc.fill_null(batch.column("block"), 0), dtype=np.int64) * width
            dated = np.asarray(bins.field("b").is_valid(), dtype=bool)
            s, q = np.zeros(groups, np.int64), np.zeros(groups, np.int64)
            s[row[~dated]], q[row[~dated]] = 4 * n[~dated], 16 * n[~dated] ** 2
            row, n = row[dated], n[dated]
            place = np.asarray(bins.field("b").drop_null(), dtype=np.int64) - start[row] + 2
            # Sorted by row and place; a bin has what its events and those of its neighbours add to it.
            at, which = np.unique(np.concatenate([row * span + place + d for d in (-1, 0, 1)]), return_inverse=True)
            x = np.zeros(len(at), np.int64)
            np.add.at(x, which, np.concatenate([n, 2 * n, n]))
            row, place = np.divmod(at, span)
            i = np.flatnonzero((place >= 2) & (place < width + 2))
            np.add.at(s, row[i], x[i])
            np.add.at(q, row[i], x[i] * x[i])
            low, high = np.full(groups, span), np.full(groups, -1)
            np.minimum.at(low, row[i], place[i])
            np.maximum.at(high, row[i], place[i])
            products, k = np.zeros((groups, lags + 1), np.int64), 0
            while len(i):
                k += 1
                i = i[i + k < len(at)]
                lag = at[i + k] - at[i]
                near = lag <= lags
                i, lag = i[near], lag[near]
                np.add.at(products, (row[i], lag), x[i] * x[i + k])
            none, wide = high < 0, lags - first_lag + 1
            yield pa.RecordBatch.from_arrays([
                batch.column("_key"), pa.array(s), pa.array(q), pa.array(low + start - 2, mask=none), pa.array(high + start - 2, mask=none),
                pa.ListArray.from_arrays(pa.array(np.arange(groups + 1) * wide, pa.int32()), pa.array(products[:, first_lag:].ravel())),
            ], ["_key", "s", "q", "low", "high", "p"])

    return sums


def exfiltration(periodic: DataFrame, spikes: DataFrame, hosts: DataFrame, key: str) -> DataFrame:
    """(key, strength, spikes, entropy, score): one score from 0 to 100 of beat, unusual volumes and random-looking hosts.

    Half of it is the strength of the beat, 30 the number of volume outliers up to three, 20 the entropy of the host's longest
    label up to 4 bits.
    """
    volumes = spikes.groupBy(key).agg(F.count("*").alias("spikes"))
    joined = periodic.select(key, "strength").join(volumes, key, "left").join(hosts.select(key, "entropy"), key, "left").na.fill({"spikes": 0, "entropy": 0.0})
    score = 50 * F.greatest(F.col("strength"), F.lit(0.0)) + 10 * F.least(F.col("spikes"), F.lit(3)) + 5 * F.least(F.col("entropy"), F.lit(4.0))
    return joined.select(key, "strength", "spikes", "entropy", F.round(score, 5).alias("score"))


def takeovers(events: DataFrame, delta_us: int) -> DataFrame:
    """Failures followed by a purchase of the same user within delta: the first such purchase."""
    hits = first_follower(
        events.where(F.col("event_type") == "error"), events.where(F.col("event_type") == "purchase"),
        "user_id", "ts", "event_id", delta_us,
    )
    return hits.where(F.col("follower").isNotNull()).groupBy("user_id").agg(
        F.count("*").alias("failures"), F.min("gap_us").alias("fastest_us")
    )


def host_entropy(pages: DataFrame, url: str = "url") -> DataFrame:
    """Entropy of the longest label of each host, with its number of requests."""
    hosts = pages.groupBy(host(url).alias("host")).agg(F.count("*").alias("n"))
    labels = F.split("host", "[.]")
    longest = F.array_max(F.transform(labels, lambda x: F.struct(F.length(x).alias("n"), x.alias("v"))))["v"]
    return hosts.select("host", "n", longest.alias("label"), F.round(entropy(longest), 4).alias("entropy"))


def url_endpoints(pages: DataFrame, url: str = "url") -> DataFrame:
    """Path templates seen in traffic, with hits."""
    return pages.groupBy(path_template(url).alias("template")).agg(F.count("*").alias("hits"))


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Link edges host → target path."""
    return pages.select(
        F.col(key), host(url).alias("src"),
        F.explode(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))).alias("dst"),
        F.lit("link").alias("kind"),
    )


def page_risks(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: inline and third-party scripts, forms without a token, comments, inline handlers."""
    h = F.col(html)
    srcs = F.regexp_extract_all(h, F.lit(r'<script[^>]* src="([^"]*)"'), F.lit(1))
    page_host = host(url)
    third = F.filter(srcs, lambda s: (host(s) != "") & (host(s) != page_host))
    count = lambda p: F.size(F.regexp_extract_all(h, F.lit(p), F.lit(0)))
    forms = F.regexp_extract_all(h, F.lit(r"(?s)<form.*?</form>"), F.lit(0))
    return pages.select(
        key,
        (count("<script") - F.size(srcs)).alias("inline_scripts"),
        F.size(third).alias("third_party"),
        F.size(F.filter(forms, lambda f: ~F.contains(F.lower(f), F.lit("token")))).alias("open_forms"),
        count(r"(?s)<!--.*?-->").alias("comments"),
        count(r"(?i) on(click|load|error|mouseover)=").alias("handlers"),
    )


def transcript(messages: DataFrame, text: str = "text") -> DataFrame:
    """Classify agent messages: tool call, or text (other JSON counts as text)."""
    body = JsonBody(text)
    method = F.when(body.type("method") == "string", body.string("method"))
    is_call = F.coalesce(body.valid() & F.startswith(method, F.lit("tools.")), F.lit(False))
    return messages.withColumn("kind", F.when(is_call, "tool_call").otherwise("text")).withColumn(
        "tool", F.when(is_call, method)
    ).withColumn("tool_params", F.when(is_call, F.coalesce(F.get_json_object(text, "$.params"), F.lit("{}"))))


# States of a conversation with tools: nothing going on, a call without its result, a result, a failure.
IDLE, CALLED, ANSWERED, FAILED = range(4)
SYMBOLS = ("call", "ok", "failed", "other")
# From each of the states; a note leaves the state as it is.
STEPS = [
    [CALLED] * 4,
    [IDLE, ANSWERED, IDLE, IDLE],
    [IDLE, FAILED, IDLE, IDLE],
    [IDLE] * 4,
]
RESULT = r"^Tool '([^']*)' executed with result:\n"


def transcript_events(messages: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Messages with ``event``: call, ok, failed, other or note, and ``tool``, the tool called or answering.

    A result is the user's message that reports it; nothing, ``None`` or an object with ``error`` is a failure. What a system
    says is a note.
    """
    said = transcript(messages, text)
    body = F.regexp_replace(F.regexp_replace(F.col(text), RESULT, ""), r"(?s)\n\nContinue reasoning.*$", "")
    answer = JsonBody("_body")
    bad = F.trim("_body").isin("", "None", "null") | (answer.present("error") & (answer.type("error") != "null"))
    is_result = (F.col(role) == "user") & F.col(text).rlike(RESULT)
    event = (
        F.when((F.col("kind") == "tool_call") & (F.col(role) == "assistant"), "call")
        .when(is_result, F.when(F.coalesce(bad, F.lit(False)), "failed").otherwise("ok"))
        .when(F.col(role) == "system", "note").otherwise("other")
    )
    tool = F.when(F.col("event") == "call", F.col("tool")).when(F.col("event").isin("ok", "failed"), F.regexp_extract(text, RESULT, 1))
    return said.withColumn("_body", body).withColumn("event", event).select(*messages.columns, "event", tool.alias("tool"))


def tool_calls(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per tool call: its chain, its step there, and its outcome (ok, failed or unanswered).

    A call belongs to the chain of the call before if it follows that call's result or failure, notes aside. One automaton
    scans all conversations, a long one in parts.
    """
    events = transcript_events(messages.select(conv, turn, role, text), role, text).select(conv, turn, "event", "tool")
    code = F.coalesce(*[F.when(F.col("event") == s, F.lit(i)) for i, s in enumerate(SYMBOLS)])
    moved = run_automaton(events, [conv], [turn], code, STEPS, IDLE)
    is_call, answers = F.col("event") == "call", F.col("event").isin("ok", "failed") & (F.col("state_before") == CALLED)
    marked = moved.where(is_call | answers).select(
        conv, turn, "event", "tool", F.when(is_call, 1).otherwise(0).cast("bigint").alias("_call"),
        F.when(is_call & ~F.col("state_before").isin(ANSWERED, FAILED), 1).otherwise(0).cast("bigint").alias("_start"))
    counted = ranged_sums(marked, [conv], [turn], {"call_no": F.col("_call"), "chain": F.col("_start")})
    # A result's row has the number of the call it answers.
    mine = lambda c: F.max(F.when(F.col("_call") == 1, F.col(c)))
    calls = counted.groupBy(conv, "chain", "call_no").agg(
        mine(turn).alias(turn), mine("tool").alias("tool"),
        F.coalesce(F.max(F.when(F.col("_call") == 0, F.col("event"))), F.lit("unanswered")).alias("outcome"),
        F.max(F.when(F.col("_call") == 0, F.col(turn))).alias("answer_turn"))
    firsts = counted.where(F.col("_start") == 1).select(F.col(conv).alias("_conv"), F.col("chain").alias("_chain"), F.col("call_no").alias("_first"))
    return calls.join(firsts, calls[conv].eqNullSafe(F.col("_conv")) & (F.col("chain") == F.col("_chain"))).select(
        conv, "chain", (F.col("call_no") - F.col("_first") + 1).alias("step"), turn, "tool", "outcome", "answer_turn")


def call_chains(calls: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per chain of tool calls: its length, failures, its tools and first turn, and whether its last call failed."""
    failed = F.col("outcome") != "ok"
    return calls.groupBy(conv, "chain").agg(
        F.count("*").alias("steps"), F.sum(failed.cast("bigint")).alias("failures"), F.count_distinct("tool").alias("tools"),
        F.min(turn).alias("first_turn"), F.max("step").alias("last_step"),
        F.max(F.when(failed, F.col("step"))).alias("last_failure")).select(
        conv, "chain", "steps", "failures", "tools", "first_turn",
        F.coalesce(F.col("last_failure") == F.col("last_step"), F.lit(False)).alias("ends_in_failure"))
