"""Chat export parsing and conversation analytics (A-5 helpers, B-27, C-9,
D-22 .. D-26, H-1 .. H-5, H-10).

A chat export is a set of lines ``(chat, line_no, line)``. A header line
starts a message: ``YYYY-MM-DD HH:MM - user: text`` (a system line has no
``user:`` part); other lines continue the previous message. Everything is
expressed with regex column functions and windows partitioned by chat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The export line format and the phrases that mark system
# messages.
HEADER_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}) - (([A-Za-z0-9_]+): )?([\s\S]*)\z"
TS_FORMAT = "yyyy-MM-dd HH:mm"
SYSTEM_PHRASES = (
    "messages and calls are end-to-end encrypted",
    "created group",
    "added",
    "left",
    "removed",
    "changed the subject",
    "changed this group's icon",
    "joined using this group's invite link",
)
MEDIA_MARKER = "<Media omitted>"
URL_PATTERN = r"https?://[^ \t\n\r]+"
EMOJI_PATTERN = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
WS = r"[ \t\n\r]+"


def render_export(conv: DataFrame, chat: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text", ts: Column | None = None) -> DataFrame:
    """Turn message rows into export lines ``(chat, line_no, line)``: the
    first line of a message carries the header, further lines of a
    multi-line text follow as continuation lines. ``line_no`` orders lines
    within a chat (``turn * 1e6 + line within the message``)."""
    ts = ts if ts is not None else F.col("ts")
    who = F.when(F.col(role) == "system", F.lit("")).otherwise(F.concat(F.col(role), F.lit(": ")))
    head = F.concat(F.date_format(ts, TS_FORMAT), F.lit(" - "), who)
    parts = conv.select(F.col(chat).alias("chat"), F.col(turn).alias("_turn"), head.alias("_head"),
                        F.posexplode(F.split(F.col(text), "\n")).alias("_pos", "_part"))
    return parts.select(
        "chat", (F.col("_turn") * 1_000_000 + F.col("_pos")).cast("long").alias("line_no"),
        F.when(F.col("_pos") == 0, F.concat("_head", "_part")).otherwise(F.col("_part")).alias("line"))


def parse_chat(lines: DataFrame) -> DataFrame:
    """Per line: header flag, timestamp, user and body (H-1)."""
    is_head = F.col("line").rlike(HEADER_PATTERN)
    user = F.regexp_extract("line", HEADER_PATTERN, 3)
    return lines.select(
        "chat", "line_no", is_head.alias("is_header"),
        F.when(is_head, F.try_to_timestamp(F.regexp_extract("line", HEADER_PATTERN, 1), F.lit(TS_FORMAT))
               .cast("timestamp_ntz")).alias("ts"),
        F.when(is_head & (user != ""), user).alias("user"),
        F.when(is_head, F.regexp_extract("line", HEADER_PATTERN, 4)).otherwise(F.col("line")).alias("body"))


def rebuild_multiline(parsed: DataFrame, lines_per_bucket: int = 1_000_000_000) -> DataFrame:
    """Continuation lines appended to the previous message (H-2).

    Message number = running count of header lines in the chat; a message's
    text is its lines joined by newlines in line order. Lines before the
    first header belong to message 0. The running count is bucketed by
    blocks of ``lines_per_bucket`` line numbers, so one huge chat is spread
    over many tasks.
    """
    from tessera.operators import windows as WB
    p = parsed.withColumn("_h", F.col("is_header").cast("int"))
    p = WB.running(p, ["chat"], ["line_no"], "_h", F.floor(F.col("line_no") / F.lit(lines_per_bucket)), "msg_no")
    p = p.withColumn("msg_no", F.col("msg_no").cast("long")).drop("_h")
    return p.groupBy("chat", "msg_no").agg(
        F.min_by("ts", "line_no").alias("ts"),
        F.min_by("user", "line_no").alias("user"),
        F.min("line_no").alias("first_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))),
                                 lambda x: x["body"]), "\n").alias("text"))


def emoji_frequency(msgs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """The n most frequent emojis of all messages with their counts (D-24)."""
    e = msgs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(EMOJI_PATTERN), 0)).alias("emoji"))
    return e.groupBy("emoji").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "emoji").limit(n)


def flag_system(msgs: DataFrame, phrases: Sequence[str] = SYSTEM_PHRASES) -> DataFrame:
    """System message (H-3): a headed message without a ``user:`` part, or
    lines without any header that hold a system phrase. Phrases in what a user
    says mean nothing."""
    low = F.lower(F.col("text"))
    hit = F.lit(False)
    for p in phrases:
        hit = hit | low.contains(F.lit(p))
    return msgs.withColumn("is_system", F.col("user").isNull() & (F.col("ts").isNotNull() | hit))


def message_features(msgs: DataFrame) -> DataFrame:
    """Words, characters, emojis, URLs, media flag and time parts (H-4)."""
    body = F.regexp_replace(F.regexp_replace(F.col("text"), "^" + WS, ""), WS + "$", "")
    words = F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, WS)))
    return (msgs.withColumn("n_words", words)
            .withColumn("n_chars", F.char_length("text"))
            .withColumn("n_emojis", F.regexp_count("text", F.lit(EMOJI_PATTERN)))
            .withColumn("n_urls", F.regexp_count("text", F.lit(URL_PATTERN)))
            .withColumn("is_media", F.col("text") == MEDIA_MARKER)
            .withColumn("hour", F.hour("ts"))
            .withColumn("weekday", F.weekday("ts")))


def _day_bucket():
    return F.date_trunc("day", F.col("ts"))


def response_times(msgs: DataFrame) -> DataFrame:
    """Minutes since the previous message when the speaker changes (H-5).
    The previous message per chat comes from a day-bucketed shift."""
    from tessera.operators import windows as WB
    from tessera.functions.columns import epoch_micros
    m = msgs.withColumn("_tus", epoch_micros("ts"))
    m = WB.shift_many(m, ["chat"], ["ts", "msg_no"], _day_bucket(),
                      [("user", "_prev_user", "lag"), ("_tus", "_prev_tus", "lag")])
    minutes = (F.col("_tus") - F.col("_prev_tus")) / F.lit(60_000_000)
    prev_user = F.col("_prev_user")
    changed = prev_user.isNotNull() & F.col("user").isNotNull() & (prev_user != F.col("user"))
    return m.withColumn("response_minutes", F.when(changed, minutes)).drop("_tus", "_prev_user", "_prev_tus")


def chat_totals(feats: DataFrame, by: Sequence[str] = ("chat",)) -> DataFrame:
    """Messages, words, links, media, emojis (D-22)."""
    return feats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("messages"), F.sum("n_words").alias("words"),
        F.sum("n_urls").alias("links"), F.count_if("is_media").alias("media"),
        F.sum("n_emojis").alias("emojis"))


def active_participants(msgs: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Most active users with their share of messages (D-23)."""
    from tessera.operators.ranking import top_k_per_group
    g = msgs.filter(F.col("user").isNotNull()).groupBy(*by, "user").agg(F.count(F.lit(1)).alias("messages"))
    if by:
        w = Window.partitionBy(*by)
        g = g.withColumn("share", F.col("messages") / F.sum("messages").over(w))
        return top_k_per_group(g, list(by), "messages", k, tiebreak=["user"], salt_buckets=0)
    total = g.select(F.sum("messages")).scalar()
    return g.withColumn("share", F.col("messages") / total).orderBy(F.desc("messages"), "user").limit(k)


# Stop words removed before counting terms (en, de, fr, es).
STOP_WORDS = (
    "the", "and", "of", "to", "a", "in", "is", "it", "that", "for", "on", "with", "as", "was", "at", "by",
    "this", "be", "are", "or", "an", "from",
    "der", "die", "das", "und", "in", "zu", "den", "von", "ist", "nicht", "mit", "ein", "eine",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "qui", "pas",
    "el", "los", "las", "y", "que", "en", "un", "una", "por", "con", "se",
)
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(col: Column) -> Column:
    """Lower-cased letter/digit runs of a text."""
    return F.filter(F.split(F.lower(col), TOKEN_SPLIT), lambda t: t != "")


def top_terms(msgs: DataFrame, k: int, text: str = "text", stop_words: Sequence[str] = STOP_WORDS,
              min_len: int = 2) -> DataFrame:
    """Most frequent terms (D-24): tokens, stop words dropped, counted with
    a hash aggregate (map-side combine), top k by count then term."""
    stop = F.array(*[F.lit(w) for w in sorted(set(stop_words))])
    t = msgs.select(F.explode(tokens(F.col(text))).alias("term"))
    t = t.filter((F.char_length("term") >= min_len) & ~F.array_contains(stop, F.col("term")))
    return (t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "term").limit(k))


def activity_timeline(msgs: DataFrame, grain: str = "day") -> DataFrame:
    """Message counts per day or month (D-25)."""
    unit = {"day": "day", "month": "month"}[grain]
    return msgs.groupBy(F.date_trunc(unit, "ts").cast("date").alias("period")).agg(F.count(F.lit(1)).alias("messages"))


def activity_map(msgs: DataFrame) -> DataFrame:
    """Weekday x hour message counts (D-25): fixed pivot values 0..23 so
    Spark does not scan the data to discover them."""
    base = msgs.select(F.weekday("ts").alias("weekday"), F.hour("ts").alias("_h"))
    piv = base.groupBy("weekday").pivot("_h", list(range(24))).count()
    return piv.select("weekday", *[F.coalesce(F.col(str(h)), F.lit(0)).cast("long").alias(f"h{h:02d}")
                                   for h in range(24)])


def conversation_health(msgs: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3),
                        target_words: float = 20.0) -> DataFrame:
    """Composite health score per chat (D-26, definition chosen here):
    100 x weighted mean of answered share (user messages followed by
    another speaker), message richness (mean words / target, capped at 1)
    and share of non-system messages."""
    from tessera.operators import windows as WB
    m = WB.shift(msgs, ["chat"], ["ts", "msg_no"], "user", _day_bucket(), "_next_user", "lead")
    nxt = F.col("_next_user")
    m = m.withColumn("_answered", F.col("user").isNotNull() & nxt.isNotNull() & (nxt != F.col("user")))
    g = m.groupBy("chat").agg(
        F.count(F.lit(1)).alias("messages"),
        F.try_divide(F.count_if("_answered"), F.count_if(F.col("user").isNotNull())).alias("answered_share"),
        F.avg("n_words").alias("mean_words"),
        F.avg((~F.col("is_system")).cast("double")).alias("human_share"))
    a, r, h = weights
    score = (F.lit(a) * F.coalesce(F.col("answered_share"), F.lit(0.0))
             + F.lit(r) * F.least(F.col("mean_words") / target_words, F.lit(1.0))
             + F.lit(h) * F.col("human_share")) / F.lit(a + r + h) * 100
    return g.withColumn("health", score)


# Ordered intent rules (first match wins); image requests are
# separated first.
INTENT_RULES = (
    ("image_request", r"(?i)(image|photo|picture|bild|imagen)"),
    ("order_status", r"(?i)(order|delivery|status|commande|pedido|bestellung)"),
    ("pricing", r"(?i)(price|cost|how much|prix|precio|preis)"),
    ("greeting", r"(?i)^(hi|hello|hallo|bonjour|hola)"),
)


def intent_route(msgs: DataFrame, text: str = "text", rules=INTENT_RULES, default: str = "other") -> DataFrame:
    """Classify each message by the first matching rule (B-27)."""
    expr = None
    for name, pat in rules:
        cond = F.col(text).rlike(pat)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return msgs.withColumn("intent", expr.otherwise(F.lit(default)))


def _last_n(arr: Column, n: int) -> Column:
    return F.when(F.size(arr) > n, F.slice(arr, F.size(arr) - n + 1, n)).otherwise(arr)


def retrieve_memory(turns: DataFrame, chat: str, order: str, text: str, n: int,
                    query: Column | None = None, turns_per_bucket: int = 1000) -> DataFrame:
    """For each (query) turn: the previous n turns of the same chat, oldest
    first (C-9). At most n items are ever gathered per row.

    Bucketed by blocks of ``turns_per_bucket`` of ``order`` so a huge chat is
    spread over many tasks: inside a bucket a bounded frame gives the
    earlier turns; each bucket's last n turns are carried to the next n
    buckets (at most n items each) and joined in front, then cut to n.
    """
    b = turns.withColumn("_b", F.floor(F.col(order) / F.lit(turns_per_bucket)))
    w_in = Window.partitionBy(chat, "_b").orderBy(order)
    b = b.withColumn("_in", F.collect_list(text).over(w_in.rowsBetween(-n, -1)))
    tails = (b.withColumn("_rd", F.row_number().over(Window.partitionBy(chat, "_b").orderBy(F.col(order).desc())))
             .filter(F.col("_rd") <= n)
             .groupBy(chat, "_b").agg(
                 F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("_tail")))
    w_b = Window.partitionBy(chat).orderBy("_b").rowsBetween(-n, -1)
    carry = tails.withColumn("_carry", _last_n(F.flatten(F.collect_list("_tail").over(w_b)), n)).drop("_tail")
    from tessera.operators.windows import null_safe_join
    out = (null_safe_join(b, carry, [chat, "_b"])
           .withColumn("context", _last_n(F.concat(F.coalesce("_carry", F.array().cast("array<string>")), "_in"), n))
           .drop("_b", "_in", "_carry"))
    return out.filter(query) if query is not None else out


def session_memory(turns: DataFrame, chat: str, order: str, text: str, n: int) -> DataFrame:
    """The last n turns of every chat in order (H-10): top n per chat
    (two-stage, skew-safe), then an ordered list of at most n items."""
    from tessera.operators.ranking import top_k_per_group
    last = top_k_per_group(turns, [chat], order, n, desc=True, rank_name="_r")
    return last.groupBy(chat).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("memory"),
        F.count(F.lit(1)).alias("n_turns"))
