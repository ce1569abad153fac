"""Chat analytics over ``conversations`` rendered as an export file.

Binding (chosen here): a conversation is one chat; message time = 08:00 on
day ``conv_id % 3650`` after 2024-01-01 plus 3 minutes per turn; lines are
rendered with :func:`render_export` and parsed back with the regex parser.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import conversation as C
from tessera.plans import bindings as B
from tessera.plans.common import rounded, tables
from tessera.plans.registry import register
from tessera.sources import files
from tessera.sources.stage import new_folder

W = B.with_ctes
P = C.HEADER_PATTERN


def conv_ts():
    days = (F.col("conv_id") % 3650).cast("int")
    mins = (F.col("turn") * 3).cast("int")
    return (F.lit("2024-01-01 08:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(days, F.lit(0), mins, F.lit(0)))


def _conv(spark, sf_dir):
    """The conversations; some turns also say something with a link, with
    emojis, with system words, or are media, so that every rule meets rows."""
    k = (F.col("conv_id") + F.col("turn")) % 9
    text = (F.when(k == 1, F.concat("text", F.lit(" https://example.org/a?b=1 and http://x.example")))
            .when(k == 3, F.concat("text", F.lit(" \U0001F600\u2600"))).when(k == 5, F.lit(C.MEDIA_MARKER))
            .when(k == 7, F.concat(F.lit("I left my keys, they added salt. "), "text")).otherwise(F.col("text")))
    return tables(spark, sf_dir).conversations.withColumn("text", text)


def _lines(spark, sf_dir):
    return C.render_export(_conv(spark, sf_dir), ts=conv_ts())


def _msgs(spark, sf_dir):
    return C.flag_system(C.rebuild_multiline(C.parse_chat(_lines(spark, sf_dir))))


def _feats(spark, sf_dir):
    return C.message_features(_msgs(spark, sf_dir))


TEXT_SQL = """CASE (conv_id + turn) % 9 WHEN 1 THEN text || ' https://example.org/a?b=1 and http://x.example' WHEN 3 THEN text || ' \U0001F600\u2600'
  WHEN 5 THEN '<Media omitted>' WHEN 7 THEN 'I left my keys, they added salt. ' || text ELSE text END"""
LINES_CTE = """cts AS (SELECT conv_id, turn, role, {TEXT} AS text,
    TIMESTAMP '2024-01-01 08:00:00' + to_days(CAST(conv_id % 3650 AS INTEGER)) + to_minutes(CAST(turn * 3 AS BIGINT)) AS ts
  FROM conversations),
lines AS (SELECT conv_id AS chat, CAST(turn * 1000000 + pos - 1 AS BIGINT) AS line_no,
    CASE WHEN pos = 1 THEN strftime(ts, '%Y-%m-%d %H:%M') || ' - ' || CASE WHEN role = 'system' THEN '' ELSE role || ': ' END || part
         ELSE part END AS line
  FROM (SELECT conv_id, turn, role, ts, unnest(string_split(text, chr(10))) AS part,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM cts)),
parsed AS (SELECT chat, line_no, regexp_matches(line, '{P}') AS is_header,
    CASE WHEN regexp_matches(line, '{P}') THEN strptime(regexp_extract(line, '{P}', 1), '%Y-%m-%d %H:%M') END AS ts,
    CASE WHEN regexp_matches(line, '{P}') AND regexp_extract(line, '{P}', 3) <> '' THEN regexp_extract(line, '{P}', 3) END AS user,
    CASE WHEN regexp_matches(line, '{P}') THEN regexp_extract(line, '{P}', 4) ELSE line END AS body
  FROM lines),
numbered AS (SELECT *, sum(is_header::INT) OVER (PARTITION BY chat ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS msg_no
  FROM parsed),
msgs0 AS (SELECT chat, msg_no, arg_min(ts, line_no) AS ts, arg_min(user, line_no) AS user, min(line_no) AS first_line,
    string_agg(body, chr(10) ORDER BY line_no) AS text FROM numbered GROUP BY chat, msg_no),
msgs AS (SELECT *, user IS NULL AND (ts IS NOT NULL OR {SYS}) AS is_system FROM msgs0),
feats AS (SELECT *,
    CASE WHEN {BODY} = '' THEN 0 ELSE len(string_split_regex({BODY}, '[ \\t\\n\\r]+')) END AS n_words,
    length(text) AS n_chars, len(regexp_extract_all(text, '{EMO}')) AS n_emojis,
    len(regexp_extract_all(text, '{URL}')) AS n_urls, text = '{MEDIA}' AS is_media,
    hour(ts) AS hour, isodow(ts) - 1 AS weekday FROM msgs)""".format(
    P=P.replace("'", "''"), TEXT=TEXT_SQL,
    SYS=" OR ".join(f"contains(lower(text), '{p.replace(chr(39), chr(39) * 2)}')" for p in C.SYSTEM_PHRASES),
    BODY="regexp_replace(regexp_replace(text, '^[ \\t\\n\\r]+', ''), '[ \\t\\n\\r]+$', '')",
    EMO=C.EMOJI_PATTERN, URL=C.URL_PATTERN, MEDIA=C.MEDIA_MARKER)


@register("parse_chat", ops=("H-1", "A-5"), sql=W(LINES_CTE) + "SELECT * FROM parsed")
def parse_chat(spark, sf_dir):
    return C.parse_chat(_lines(spark, sf_dir))


#: Conversations of one export file.
EXPORT = 500


def _exports(spark, sf_dir):
    """Export files written from the conversations, in order: EXPORT of them a file."""
    lines = _lines(spark, sf_dir).withColumn("export", F.floor(F.col("chat") / EXPORT).cast("long"))
    path = new_folder(spark, "chat-exports")
    (lines.repartition("export").sortWithinPartitions("export", "chat", "line_no")
     .select("export", "line").write.partitionBy("export").text(path))
    return path


def _export_lines(spark, sf_dir):
    lines = files.read_chat_lines(spark, _exports(spark, sf_dir))
    return lines.withColumn("chat", F.regexp_extract("chat", "export=([0-9]+)", 1).cast("long"))


EXPORT_CTE = LINES_CTE.replace("parsed AS (SELECT chat,", """exports AS (SELECT CAST(chat // 500 AS BIGINT) AS chat, line,
    CAST(row_number() OVER (PARTITION BY chat // 500 ORDER BY chat, line_no) - 1 AS BIGINT) AS line_no FROM lines),
parsed AS (SELECT chat,""").replace("FROM lines),\nnumbered", "FROM exports),\nnumbered")


@register("read_chat_exports", ops=("A-5",), sql=W(EXPORT_CTE) + "SELECT * FROM parsed")
def read_chat_exports(spark, sf_dir):
    """Export files read in blocks, their lines numbered as in the file and parsed."""
    return C.parse_chat(_export_lines(spark, sf_dir))


@register("chat_export_messages", ops=("A-5", "H-2"), sql=W(EXPORT_CTE) + "SELECT chat, msg_no, ts, user, first_line, text FROM msgs0")
def chat_export_messages(spark, sf_dir):
    """Messages rebuilt from export files, counted in blocks of real line numbers."""
    return C.rebuild_multiline(C.parse_chat(_export_lines(spark, sf_dir)), lines_per_bucket=100_000)


@register("rebuild_multiline", ops=("H-2",), sql=W(LINES_CTE) + "SELECT chat, msg_no, ts, user, first_line, text FROM msgs0")
def rebuild_multiline(spark, sf_dir):
    return C.rebuild_multiline(C.parse_chat(_lines(spark, sf_dir)))


@register("chat_roundtrip_mismatches", ops=("H-2",), sql="SELECT 0 AS mismatches")
def chat_roundtrip_mismatches(spark, sf_dir):
    """Every rebuilt message must equal the original text: count of differences."""
    c = _conv(spark, sf_dir)
    m = C.rebuild_multiline(C.parse_chat(_lines(spark, sf_dir)))
    m = m.withColumn("turn", F.floor(F.col("first_line") / 1_000_000).cast("long"))
    j = c.join(m, (c.conv_id == m.chat) & (c.turn == m.turn), "full")
    return j.agg(F.count_if(~F.coalesce(c.text == m.text, F.lit(False))).cast("int").alias("mismatches"))


@register("flag_system", ops=("H-3",), sql=W(LINES_CTE) + "SELECT chat, msg_no, is_system FROM msgs")
def flag_system(spark, sf_dir):
    return _msgs(spark, sf_dir).select("chat", "msg_no", "is_system")


@register("message_features", ops=("H-4",), sql=W(LINES_CTE) + """
SELECT chat, msg_no, n_words, n_chars, n_emojis, n_urls, is_media, hour, weekday FROM feats""")
def message_features(spark, sf_dir):
    return _feats(spark, sf_dir).select("chat", "msg_no", "n_words", "n_chars", "n_emojis", "n_urls",
                                        "is_media", "hour", "weekday")


@register("response_times", ops=("H-5",), sql=W(LINES_CTE) + """
SELECT chat, msg_no, CASE WHEN lag(user) OVER w IS NOT NULL AND user IS NOT NULL AND lag(user) OVER w <> user
  THEN (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000 END AS response_minutes
FROM msgs WINDOW w AS (PARTITION BY chat ORDER BY ts, msg_no)""")
def response_times(spark, sf_dir):
    return rounded(C.response_times(_msgs(spark, sf_dir)).select("chat", "msg_no", "response_minutes"))


@register("chat_totals", ops=("D-22",), sql=W(LINES_CTE) + """
SELECT chat, count(*) AS messages, sum(n_words) AS words, sum(n_urls) AS links, count_if(is_media) AS media,
       sum(n_emojis) AS emojis FROM feats GROUP BY chat""")
def chat_totals(spark, sf_dir):
    return C.chat_totals(_feats(spark, sf_dir))


@register("active_participants", ops=("D-23",), sql=W(LINES_CTE) + """
SELECT chat, user, messages, round(share, 6) AS share, rank FROM (
  SELECT chat, user, messages, messages / sum(messages) OVER (PARTITION BY chat) AS share,
         row_number() OVER (PARTITION BY chat ORDER BY messages DESC, user) AS rank
  FROM (SELECT chat, user, count(*) AS messages FROM msgs WHERE user IS NOT NULL GROUP BY chat, user))
WHERE rank <= 1""")
def active_participants(spark, sf_dir):
    return rounded(C.active_participants(_msgs(spark, sf_dir), 1, by=["chat"]))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in sorted(set(C.STOP_WORDS))) + "]"
TOKENS_SQL = "list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


@register("top_terms", ops=("D-24",), sql=W(LINES_CTE) + f"""
SELECT term, count(*) AS n FROM (SELECT unnest({TOKENS_SQL.format(x='text')}) AS term FROM msgs)
WHERE length(term) >= 2 AND NOT list_contains({STOP_SQL}, term)
GROUP BY term ORDER BY n DESC, term LIMIT 20""")
def top_terms(spark, sf_dir):
    return C.top_terms(_msgs(spark, sf_dir), 20)


@register("emoji_frequency", ops=("D-24",), sql=W(LINES_CTE) + f"""
SELECT emoji, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{C.EMOJI_PATTERN}')) AS emoji FROM msgs)
GROUP BY emoji ORDER BY n DESC, emoji LIMIT 20""")
def emoji_frequency(spark, sf_dir):
    return C.emoji_frequency(_msgs(spark, sf_dir), 20)


@register("activity_timeline", ops=("D-25",), sql=W(LINES_CTE) + """
SELECT CAST(date_trunc('day', ts) AS DATE) AS period, count(*) AS messages FROM msgs GROUP BY 1""")
def activity_timeline(spark, sf_dir):
    return C.activity_timeline(_msgs(spark, sf_dir), "day")


@register("activity_timeline_month", ops=("D-25",), sql=W(LINES_CTE) + """
SELECT CAST(date_trunc('month', ts) AS DATE) AS period, count(*) AS messages FROM msgs GROUP BY 1""")
def activity_timeline_month(spark, sf_dir):
    return C.activity_timeline(_msgs(spark, sf_dir), "month")


@register("activity_map", ops=("D-25",), sql=W(LINES_CTE) + "SELECT isodow(ts) - 1 AS weekday, " + ", ".join(
    f"count_if(hour(ts) = {h}) AS h{h:02d}" for h in range(24)) + " FROM msgs GROUP BY 1")
def activity_map(spark, sf_dir):
    return C.activity_map(_msgs(spark, sf_dir))


@register("conversation_health", ops=("D-26",), sql=W(LINES_CTE) + """,
m AS (SELECT *, user IS NOT NULL AND lead(user) OVER w IS NOT NULL AND lead(user) OVER w <> user AS answered
      FROM feats WINDOW w AS (PARTITION BY chat ORDER BY ts, msg_no)),
g AS (SELECT chat, count(*) AS messages,
             CASE WHEN count_if(user IS NOT NULL) > 0 THEN count_if(answered) / count_if(user IS NOT NULL) END AS answered_share,
             avg(n_words) AS mean_words, avg((NOT is_system)::DOUBLE) AS human_share FROM m GROUP BY chat)
SELECT chat, messages, round(answered_share, 6) AS answered_share, round(mean_words, 6) AS mean_words,
       round(human_share, 6) AS human_share,
       round((0.4 * coalesce(answered_share, 0.0) + 0.3 * least(mean_words / 20.0, 1.0) + 0.3 * human_share) / 1.0 * 100, 6) AS health
FROM g""")
def conversation_health(spark, sf_dir):
    return rounded(C.conversation_health(_feats(spark, sf_dir)))


@register("intent_route", ops=("B-27",), sql="""
SELECT conv_id, turn, CASE """ + " ".join(
    f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in C.INTENT_RULES) + """ ELSE 'other' END AS intent
FROM (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'Hello, ' WHEN 1 THEN 'How much? ' WHEN 2 THEN 'Status of my order? '
        WHEN 3 THEN 'Send a photo: ' WHEN 4 THEN 'Oh hello ' ELSE '' END || text AS text FROM conversations WHERE role = 'user')""")
def intent_route(spark, sf_dir):
    # some turns open with words of each intent
    k = (F.col("conv_id") + F.col("turn")) % 6
    opening = (F.when(k == 0, "Hello, ").when(k == 1, "How much? ").when(k == 2, "Status of my order? ")
               .when(k == 3, "Send a photo: ").when(k == 4, "Oh hello ").otherwise(""))
    c = tables(spark, sf_dir).conversations.filter(F.col("role") == "user").withColumn("text", F.concat(opening, "text"))
    return C.intent_route(c).select("conv_id", "turn", "intent")


@register("retrieve_memory", ops=("C-9",), sql="""
SELECT conv_id, turn, context FROM (
  SELECT conv_id, turn, role,
         coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []::VARCHAR[]) AS context
  FROM conversations) WHERE role = 'user'""")
def retrieve_memory(spark, sf_dir):
    c = tables(spark, sf_dir).conversations
    r = C.retrieve_memory(c, "conv_id", "turn", "text", 3, query=F.col("role") == "user")
    return r.select("conv_id", "turn", "context")


@register("session_memory", ops=("H-10",), sql="""
SELECT conv_id, list(text ORDER BY turn) AS memory, count(*) AS n_turns FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4
GROUP BY conv_id""")
def session_memory(spark, sf_dir):
    c = tables(spark, sf_dir).conversations.select("conv_id", "turn", "text")
    return C.session_memory(c, "conv_id", "turn", "text", 4)
