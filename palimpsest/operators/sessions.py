"""Sessions of messages: normalization, fingerprints, decisions about them, transcripts, chunks and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.fixed import EPHEMERAL, FIRST_CONTACT, INJECTED, KEYWORD_CHARS, KEYWORDS
from palimpsest.functions.patterns import nfkc
from palimpsest.functions.semantics import first_of, one_shot_directive
from palimpsest.operators.folds import in_order

#: Messages in a merge of two windows.
WINDOW_MESSAGES = 512


def normalized(messages: DataFrame) -> DataFrame:
    """One row a session: its messages in order, actors and counters. messages: session_id, pos, role, text."""
    item = F.struct("pos", "role", "text")
    rows = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("events"))
    n = lambda role: F.size(F.filter("events", lambda e: e["role"] == role)).cast("long")
    return rows.withColumns(
        {
            "actors": F.array_sort(F.array_distinct(F.col("events")["role"])),
            "n_user": n("user"),
            "n_assistant": n("assistant"),
            "n_other": F.size(F.filter("events", lambda e: ~e["role"].isin("user", "assistant"))).cast("long"),
            "n_chars": F.aggregate("events", F.lit(0).cast("long"), lambda s, e: s + F.coalesce(F.length(e["text"]), F.lit(0))),
        }
    )


def fingerprinted(sessions: DataFrame) -> DataFrame:
    """sessions with a fingerprint of their messages in order."""
    line = F.transform("events", lambda e: F.concat_ws("\u001f", e["pos"].cast("string"), e["role"], e["text"]))
    return sessions.withColumn("fingerprint", F.sha2(F.array_join(line, "\u001e"), 256))


def differing(now: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """session_id, change: new, changed, unchanged or gone against a checkpoint of (session_id, fingerprint)."""
    old = checkpoint.select("session_id", F.col("fingerprint").alias("__old"))
    change = first_of([(F.col("__old").isNull(), "new"), (F.col("fingerprint").isNull(), "gone"), (F.col("fingerprint") == F.col("__old"), "unchanged")], "changed")
    return now.select("session_id", "fingerprint").join(old, "session_id", "full").select("session_id", change.alias("change"))


def migrated_prefix(runs: DataFrame) -> DataFrame:
    """Units (migration, pos, ok) up to the first that failed; the cursor is the last of them."""
    failed = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy("migration").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return runs.withColumn("__failed", failed).where("__failed = 0").drop("__failed")


def eligible(sessions: DataFrame, max_events: int, max_chars: int, direct_only: bool = False) -> DataFrame:
    """sessions (events, hidden) with eligible and reason; direct_only looks at what users wrote alone."""
    wanted = (lambda e: (F.trim(e["text"]) != "") & (e["role"] == "user")) if direct_only else (lambda e: F.trim(e["text"]) != "")
    texts = F.filter("events", lambda e: F.coalesce(F.trim(e["text"]), F.lit("")) != "")
    chosen = F.filter(texts, wanted)
    chars = F.aggregate(chosen, F.lit(0).cast("long"), lambda s, e: s + F.length(e["text"]))
    count = F.size(chosen) if direct_only else F.size("events")
    reason = first_of(
        [
            (F.col("hidden"), "hidden_session"),
            (F.size("events") == 0, "empty_session"),
            (F.size(texts) == 0, "no_textual_evidence"),
            (F.lit(direct_only) & (F.size(chosen) == 0), "no_user_text"),
            (count > max_events, "event_limit"),
            (chars > max_chars, "char_limit"),
        ],
        "eligible",
    )
    return sessions.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "eligible")


def decision(incomplete: Column, n_user: Column, modified_at: Column, now: Column, idle_seconds: int = 300) -> Column:
    """distill, source_only or defer, with the reason after a colon."""
    idle = F.unix_timestamp(now) - F.unix_timestamp(modified_at)
    return first_of(
        [
            (incomplete, "defer:journal_tail_incomplete"),
            (n_user < 1, "source_only:no_user_authored_text"),
            (modified_at.isNull(), "defer:missing_last_modified_time"),
            (idle < idle_seconds, "defer:session_not_idle"),
        ],
        "distill",
    )


def background(source: Column, session_id: Column, bridge_prefix: str) -> Column:
    """Whether a session is a machine's own: scheduled, or created by a bridge."""
    return F.coalesce((source == "cron") | ((source == "api_server") & session_id.startswith(bridge_prefix)), F.lit(False))


def transient_only(events: str = "events") -> Column:
    """Whether all that users wrote is greeting, thanks or a directive of the session, and no tool was used.

    events: array of struct(role, text, tool).
    """
    from palimpsest.functions.patterns import jvm

    users = F.transform(F.filter(events, lambda e: (e["role"] == "user") & (F.trim(e["text"]) != "")), lambda e: F.trim(e["text"]))
    first_contact = lambda t: (F.length(t) <= 160) & (t.rlike(jvm(FIRST_CONTACT[0])) | t.rlike(jvm(FIRST_CONTACT[1])))
    trivial = lambda t: t.rlike(jvm(EPHEMERAL)) | first_contact(t) | one_shot_directive(t, known=True)
    return ~F.exists(events, lambda e: F.coalesce(F.trim(e["tool"]), F.lit("")) != "") & (F.size(users) > 0) & F.forall(users, trivial)


def normalized_events(messages: DataFrame) -> DataFrame:
    """messages with NFKC text, for the rules above."""
    return messages.withColumn("text", nfkc(F.col("text")))


def keyword_scores(sessions: DataFrame, text: Column, count: Column, title: Column | None = None, keywords: dict[str, tuple[str, ...]] = KEYWORDS, most: int = KEYWORD_CHARS) -> DataFrame:
    """sessions with the hits of every keyword list (a word counts once for each time it is listed) and the technical score.

    The title is looked at before the text, both together up to `most` characters. Names of products are the caller's to add to the lists.
    """
    both = text if title is None else F.concat_ws("\n", title, text)
    lower = F.lower(F.substring(both, 1, most))
    hits = {f"{k}_hits": sum((F.contains(lower, F.lit(w)).cast("int") for w in words), F.lit(0)) for k, words in keywords.items()}
    out = sessions.withColumns(hits)
    return out.withColumn("technical_score", F.col("technical_hits") * 10 + F.least(count, F.lit(20)) / 20)


def own_input(parts: Column) -> Column:
    """The one part of a user's message that no host wrapped, or null if there are none or several."""
    from palimpsest.functions.patterns import jvm

    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda p: (p != "") & ~p.rlike(jvm(INJECTED)))
    return F.when(F.size(kept) == 1, kept[0])


def transcript(events: str = "events") -> Column:
    """Messages as "[role] text" paragraphs."""
    said = F.filter(events, lambda e: F.coalesce(F.trim(e["text"]), F.lit("")) != "")
    return F.array_join(F.transform(said, lambda e: F.concat(F.lit("["), e["role"], F.lit("] "), F.trim(e["text"]))), "\n\n")


def packed(sessions: DataFrame, max_chars: int, max_segments: int) -> DataFrame:
    """Chunks of sessions: segments in order, joined by a blank line, as many as fit. session_id, chunk, n_segments, n_chars.

    events: array of struct(pos, role, text). A segment longer than a chunk is cut.
    """
    pieces = F.flatten(
        F.transform(
            "events",
            lambda e: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(e["text"]) / max_chars).cast("int") - 1, F.lit(0))), lambda i: F.length(F.substring(e["text"], i * max_chars + 1, F.lit(max_chars)))),
        )
    )
    rows = sessions.select("session_id", F.posexplode(pieces).alias("pos", "size"))

    def step(row: dict | None, s: dict | None) -> tuple[dict | None, list[dict]]:
        if row is None:
            return None, [s]
        size = row["size"] or 0
        if s is None:
            return {"session_id": row["session_id"], "chunk": 0, "n_segments": 1, "n_chars": size}, []
        if s["n_chars"] + 2 + size > max_chars or s["n_segments"] >= max_segments:
            return {"session_id": s["session_id"], "chunk": s["chunk"] + 1, "n_segments": 1, "n_chars": size}, [s]
        return s | {"n_segments": s["n_segments"] + 1, "n_chars": s["n_chars"] + 2 + size}, []

    return in_order(rows, ["session_id"], ["pos"], step, "session_id long, chunk int, n_segments long, n_chars long")


def alignments(prior: list[tuple], incoming: list[tuple]) -> tuple[int, list[tuple[int, int]]]:
    """How many longest ordered alignments two lists have, and one of them as index pairs.

    One pass keeps, for each pair of beginnings, the longest length and the number of alignments that reach it: those that end with
    both messages, those that leave out one of the last, less those that leave out both, which are in both counts.
    """
    lengths, ways = [[0] * (len(incoming) + 1)], [1] * (len(incoming) + 1)
    for message in prior:
        above, length, way = lengths[-1], [0], [1]
        for j, other in enumerate(incoming):
            both = above[j] + (message == other)
            most = max(both, above[j + 1], length[j])
            n = ways[j] * (message == other and both == most) + ways[j + 1] * (above[j + 1] == most) + way[j] * (length[j] == most)
            length.append(most)
            way.append(n - ways[j] * (above[j] == most))
        lengths.append(length)
        ways = way
    pairs, i, j = [], len(prior), len(incoming)
    while lengths[i][j]:
        if lengths[i - 1][j] == lengths[i][j]:
            i -= 1
        elif lengths[i][j - 1] == lengths[i][j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return ways[-1], pairs[::-1]


def _prefixes(text: list) -> list[int]:
    """How much of its beginning a list has at each of its places."""
    out, low, high = [len(text)], 0, 0
    for i in range(1, len(text)):
        n = min(high - i, out[i - low]) if i < high else 0
        while i + n < len(text) and text[n] == text[i + n]:
            n += 1
        if i + n > high:
            low, high = i, i + n
        out.append(n)
    return out


def placements(prior: list[tuple], incoming: list[tuple]) -> list[int]:
    """Places in prior's count at which all of incoming that lies over it agrees with it: later places, the same, and earlier ones (below 0)."""
    n, m = len(prior), len(incoming)
    behind = _prefixes([*incoming, None, *prior])[m + 1 :]
    before = _prefixes([*prior, None, *incoming])[n + 1 :]
    return [-k for k in range(m - 1, 0, -1) if before[k] >= min(n, m - k)] + [k for k in range(n) if behind[k] >= min(m, n - k)]


def merged_windows(prior: list[tuple], incoming: list[tuple]) -> tuple[str, list[tuple]]:
    """(outcome, messages): initial, unchanged, merged, or disjoint, ambiguous or interleaved with the prior messages.

    Windows merge if they can be laid over each other at one place at most, have exactly one longest alignment, and never differ on both
    sides of the same gap. An incoming window that lies in the prior one changes nothing, unless it might as well go on beyond it.
    """
    if not prior or prior == incoming:
        return ("unchanged" if prior else "initial"), incoming
    laid = placements(prior, incoming)
    ways, pairs = alignments(prior, incoming)
    if len(laid) > 1 or pairs and ways > 1:
        return "ambiguous", prior
    if not pairs:
        return "disjoint", prior
    if len(pairs) == len(incoming):
        beyond = [k for k in laid if k < 0 or k + len(incoming) > len(prior)]
        return ("ambiguous" if beyond else "unchanged"), prior
    # Messages of either side between two pairs that follow each other, and before the first and after the last.
    ends = [*pairs, (len(prior), len(incoming))]
    gaps = [(range(a + 1, c), range(b + 1, d)) for (a, b), (c, d) in zip([(-1, -1), *pairs], ends)]
    if any(old and new for old, new in gaps):
        return "interleaved", prior
    put = {c: [incoming[j] for j in new] for (_, new), (c, _) in zip(gaps, ends)}
    return "merged", [x for i in range(len(prior) + 1) for x in (*put.get(i, ()), *prior[i : i + 1])]


def published(windows: DataFrame) -> DataFrame:
    """Merges of visible windows: session_id, outcome, n_messages. windows: session_id, side (0 prior, 1 incoming), pos, role, text.

    A window has at most WINDOW_MESSAGES messages; where one has more, that session's outcome is too_long and its prior messages stay.
    Messages beyond that many are counted and not kept, so a session is bounded.
    """

    def step(row: dict | None, s: dict | None) -> tuple[dict | None, list[dict]]:
        if row is None:
            if max(s["n"]) > WINDOW_MESSAGES:
                return None, [{"session_id": s["session_id"], "outcome": "too_long", "n_messages": s["n"][0]}]
            outcome, messages = merged_windows(*s["sides"])
            return None, [{"session_id": s["session_id"], "outcome": outcome, "n_messages": len(messages)}]
        s = s or {"session_id": row["session_id"], "n": [0, 0], "sides": ([], [])}
        s["n"][row["side"]] += 1
        if s["n"][row["side"]] <= WINDOW_MESSAGES:
            s["sides"][row["side"]].append((row["role"], row["text"]))
        return s, []

    return in_order(windows.select("session_id", "side", "pos", "role", "text"), ["session_id"], ["side", "pos"], step, "session_id long, outcome string, n_messages long")


def capture_outcomes(snapshots: DataFrame) -> DataFrame:
    """Outcome of every snapshot (conversation_id, pos, revision, updated_at, status, digest) put after those before it.

    A conflict leaves what was stored, so each is compared with the last one that was stored.
    """
    rank = {"active": 0, "completed": 1}

    def step(x: dict | None, at: dict | None) -> tuple[dict | None, list[dict]]:
        if x is None:
            return None, []
        if at is None:
            outcome = "created"
        elif at["digest"] == x["digest"]:
            outcome = "idempotent"
        elif x["updated_at"] < at["updated_at"]:
            outcome = "stale"
        elif x["updated_at"] == at["updated_at"] or x["revision"] == at["revision"]:
            outcome = "revision_conflict"
        else:
            outcome = "lifecycle_regression" if rank.get(x["status"], 2) < rank.get(at["status"], 2) else "updated"
        return x if outcome in ("created", "updated") else at, [{"conversation_id": x["conversation_id"], "pos": x["pos"], "outcome": outcome}]

    columns = ["pos", "revision", "updated_at", "status", "digest"]
    return in_order(snapshots.select("conversation_id", *columns), ["conversation_id"], columns, step, f"conversation_id {snapshots.schema['conversation_id'].dataType.simpleString()}, pos long, outcome string")


def pilot_problem(hidden: Column, n_messages: Column, archived: Column, ended_at: Column, last_at: Column, now: Column, idle_hours: int = 48) -> Column:
    """Why a session is not one for a pilot, or null: hidden, too short, or neither archived, ended nor idle for long."""
    idle = F.unix_timestamp(now) - F.unix_timestamp(last_at) >= 3600 * idle_hours
    complete = archived | ended_at.isNotNull() | F.coalesce(idle, F.lit(False))
    return F.when(hidden, "hidden").when(n_messages < 2, "too_short").when(~complete, "not_complete")


def recent(sessions: DataFrame, times: list[str], key: str, limit: int) -> DataFrame:
    """The latest sessions by the first of their times that is known, those without any last."""
    return sessions.orderBy(F.coalesce(*times).desc_nulls_last(), F.col(key)).limit(limit)
