"""Chat, bookkeeping and quota over conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Quota
from ..functions import text as T
from ..functions import token
from ..operators import chat, prompts, quota, store
from ..sources import pages as P
from .registry import BLANK_SQL, Registry, table, trim_sql

REGISTRY = Registry()
query = REGISTRY



def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query(
    f"""SELECT conv_id, turn, role, CASE WHEN text = '' THEN '(empty)' WHEN length(text) > 500 THEN regexp_replace(substring(text, 1, 500), '{BLANK_SQL}+$', '') || '...' ELSE text END AS text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 12"""
)
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.last_turns(_messages(spark, sf_dir))


@query(
    f"""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' ELSE 'model' END AS role, {trim_sql("coalesce(text, '')")} AS text FROM conversations c
  WHERE turn < (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id)),
f AS (SELECT conv_id, min(turn) AS first FROM t WHERE role = 'user' AND text <> '' GROUP BY conv_id)
SELECT t.conv_id, t.turn, t.role, t.text FROM t JOIN f ON t.conv_id = f.conv_id WHERE t.turn >= f.first AND t.text <> ''"""
)
def history_from_first_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.history(_messages(spark, sf_dir))


@query(
    f"""SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS history_md5 FROM (
  SELECT conv_id, turn, role, CASE WHEN text = '' THEN '(empty)' WHEN length(text) > 500 THEN regexp_replace(substring(text, 1, 500), '{BLANK_SQL}+$', '') || '...' ELSE text END AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 12) GROUP BY conv_id"""
)
def gate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered_history(_messages(spark, sf_dir)).select("conv_id", F.md5("history").alias("history_md5"))


@query("SELECT conv_id, coalesce(substring(arg_min(text, turn) FILTER (role = 'user'), 1, 160), 'New Conversation') AS title FROM conversations GROUP BY conv_id")
def title_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.promoted_titles(_messages(spark, sf_dir))


def _bookkeeping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations that are half named, and their messages with a clock that follows the turns."""
    rows = _messages(spark, sf_dir)
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("turn") * 60_000_000)
    messages = rows.select(F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"), at.alias("created_at"))
    named = F.when(F.max(F.col("role") == "system"), "Kept").otherwise(F.lit("New Conversation"))
    parents = rows.groupBy(F.col("conv_id").alias("id")).agg(named.alias("title")).withColumn("updated_at", F.timestamp_micros(F.lit(1_704_067_200_000_000)))
    return parents, messages


@query(
    """SELECT conv_id AS id, CASE WHEN bool_or(role = 'system') THEN 'Kept' ELSE coalesce(substring(arg_min(text, turn) FILTER (role = 'user'), 1, 160), 'New Conversation') END AS title, CAST(max(turn) * 60 AS BIGINT) AS seconds
FROM conversations GROUP BY conv_id"""
)
def append_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, messages = _bookkeeping(spark, sf_dir)
    done = store.append_message(parents, messages)
    return done.select("id", "title", (F.unix_micros("updated_at") / 1_000_000 - 1_704_067_200).cast("long").alias("seconds"))


@query("SELECT conv_id AS id, CASE WHEN bool_or(role = 'system') THEN 'Kept' ELSE 'Renamed' END AS title FROM conversations GROUP BY conv_id")
def rename_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, _ = _bookkeeping(spark, sf_dir)
    return store.update_where(parents, F.col("title") == "New Conversation", {"title": F.lit("Renamed")}).select("id", "title")


@query("SELECT conv_id, max(turn) AS last_turn, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 50")
def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"))
    return rows.orderBy(F.desc("last_turn"), "conv_id").limit(50)


@query(
    f"""SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'bad_role' WHEN {trim_sql("coalesce(text, '')")} = '' THEN 'empty' WHEN length({trim_sql("coalesce(text, '')")}) > 8000 THEN 'too_long' ELSE 'ok' END AS verdict FROM conversations"""
)
def message_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", "turn", chat.message_verdict(F.col("role"), F.col("text")).alias("verdict"))


_MARKED = "coalesce(text, '') || ' [' || turn || ', ' || (turn + 1) || '] and [' || turn || '][0,' || (turn + 3) || '] [x] [3 4]'"


def _marked() -> F.Column:
    n = F.col("turn")
    return F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), n, F.lit(", "), n + 1, F.lit("] and ["), n, F.lit("][0,"), n + 3, F.lit("] [x] [3 4]"))


@query(
    f"""WITH m AS (SELECT conv_id, turn, regexp_extract_all({_MARKED}, '\\[([0-9,\\s]+)\\]', 1) AS g FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(flatten(list_transform(g, lambda x: string_split(x, ','))), lambda x: regexp_matches(x, '^\\s*[0-9]')),
  lambda x: CAST(regexp_extract(x, '^\\s*([0-9]+)', 1) AS BIGINT)), lambda x: x > 0))), ',') AS cited FROM m"""
)
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", "turn", F.array_join(T.cited_indexes(_marked()).cast("array<string>"), ",").alias("cited"))


@query(
    f"""SELECT conv_id, turn, {trim_sql("regexp_replace(text || CASE role WHEN 'assistant' THEN chr(10) || chr(10) || '**References:**' || chr(10) || '[1] x' WHEN 'user' THEN chr(10) || 'references: [2]' ELSE '' END, '(?is)\\n+(\\*\\*references:\\*\\*|references:\\s*).*$', '')")} AS answer,
  contains(lower(text), 'eau') AS is_fallback FROM conversations"""
)
def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without their trailing references; the fallback phrase is a parameter."""
    tail = F.when(F.col("role") == "assistant", "\n\n**References:**\n[1] x").when(F.col("role") == "user", "\nreferences: [2]").otherwise("")
    return _messages(spark, sf_dir).select("conv_id", "turn", chat.clean_answer(F.concat("text", tail)).alias("answer"), T.is_fallback(F.col("text"), "eau").alias("is_fallback"))


@query(
    """WITH source AS (SELECT conv_id AS answer_id, turn + 1 AS position, role AS title, 'https://example.com/' || role AS url FROM conversations),
cited AS (SELECT DISTINCT conv_id AS answer_id, unnest([turn, turn + 1, turn + 3, 3]) AS number FROM conversations),
hit AS (SELECT c.answer_id, c.number, s.title, s.url FROM (SELECT DISTINCT * FROM cited WHERE number > 0) c JOIN source s ON s.answer_id = c.answer_id AND s.position = c.number)
SELECT answer_id, number, title, url FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, url ORDER BY number) AS place FROM hit) WHERE place = 1"""
)
def source_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited sources of each conversation, whose messages are the answer's paragraphs; one for each address."""
    rows = _messages(spark, sf_dir)
    n = F.col("turn")
    marks = F.concat(F.lit("["), n, F.lit(","), n + 1, F.lit(","), n + 3, F.lit(",3]"))
    answers = rows.select(F.col("conv_id").alias("answer_id"), marks.alias("text"))
    sources = rows.select(F.col("conv_id").alias("answer_id"), (n + 1).alias("position"), F.col("role").alias("title"), F.concat(F.lit("https://example.com/"), "role").alias("url"))
    return chat.cited_sources(answers, sources)


@query(
    """SELECT conv_id, md5(string_agg('[Source ' || n || '] (' || role || '):' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n)) AS context_md5
FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5)) GROUP BY conv_id"""
)
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of five sources: each conversation's newest messages."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = _messages(spark, sf_dir).withColumn("back", F.row_number().over(newest)).where("back <= 5").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("url"), F.col("text").alias("content")))).alias("chunks"))
    return rows.select("conv_id", F.md5(chat.context(F.col("chunks"))).alias("context_md5"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(a, '^[^@]+@[^@]+$') AND length(split_part(a, '@', 1)) > 2 THEN substring(a, 1, 2) || '***@' || split_part(a, '@', 2) WHEN regexp_matches(a, '^[^@]+@[^@]+$') THEN '**@' || split_part(a, '@', 2) ELSE 'redacted' END AS masked
FROM (SELECT doc_id, CASE lang WHEN 'en' THEN source || '@' || lang WHEN 'fr' THEN 'ab@' || source ELSE source END AS a FROM documents)"""
)
def masked_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("lang") == "en", F.concat("source", F.lit("@"), "lang")).when(F.col("lang") == "fr", F.concat(F.lit("ab@"), "source")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", T.mask_email(a).alias("masked"))


@query(
    """SELECT doc_id, regexp_matches(u, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') AS is_uuid
FROM (SELECT doc_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-4' || substring(h, 14, 3) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) AS u FROM (SELECT doc_id, md5(text) AS h FROM documents))"""
)
def uuid_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5("text")
    cut = lambda a, n: F.substring(h, a, n)
    u = F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-4"), cut(14, 3), F.lit("-"), cut(17, 4), F.lit("-"), cut(21, 12))
    return table(spark, sf_dir, "documents").select("doc_id", T.is_uuid(u).alias("is_uuid"))


@query(
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN '{"a": [' || turn || ']}' WHEN 'assistant' THEN '{"b": ' || turn || '}' END AS body, CASE WHEN turn > 0 THEN turn END AS retry_seconds FROM conversations"""
)
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON part of replies with fences and prose around it, and delays of the form 3.5s."""
    n = F.col("turn")
    reply = F.when(F.col("role") == "user", F.concat(F.lit('Sure:\n```json\n{"a": ['), n, F.lit("]}\n```\n"))).when(F.col("role") == "assistant", F.concat(F.lit('It is {"b": '), n, F.lit("} I think"))).otherwise("none")
    delay = F.when(n > 0, F.concat(n, F.lit(".25s"))).otherwise("soon")
    return _messages(spark, sf_dir).select("conv_id", "turn", T.json_body(reply).alias("body"), T.retry_seconds(delay).alias("retry_seconds"))


RPM, RPD = 1, 200


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.round(F.col("value") * 100).cast("long").alias("tokens"))


@query(f"SELECT event_id, row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY ts, event_id) <= {RPM} AS allowed FROM events")
def quota_rpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.by_requests(_requests(spark, sf_dir), RPM).select("event_id", "allowed")


@query(
    f"""WITH m AS (SELECT event_id, ts, row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY ts, event_id) AS place FROM events),
d AS (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS of_day FROM m WHERE place <= {RPM})
SELECT m.event_id, coalesce(d.of_day <= {RPD}, false) AS allowed FROM m LEFT JOIN d ON m.event_id = d.event_id"""
)
def quota_rpm_rpd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.by_requests_and_day(_requests(spark, sf_dir), RPM, RPD).select("event_id", "allowed")


_FOLD = Quota(rpm=3, tpm=9000, rpd=RPD, reserve=1024)


@query(
    f"""WITH RECURSIVE e AS (SELECT event_id, date_trunc('minute', ts) AS m, CAST(ts AS DATE) AS d, CAST(round(value * 100) AS BIGINT) + {_FOLD.reserve} AS cost, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events),
fold AS (
  SELECT d, n, event_id, m, CASE WHEN cost > {_FOLD.tpm} THEN 'tpm' END AS reason, CASE WHEN cost > {_FOLD.tpm} THEN 0 ELSE 1 END AS requests, CASE WHEN cost > {_FOLD.tpm} THEN 0 ELSE cost END AS tokens, CASE WHEN cost > {_FOLD.tpm} THEN 0 ELSE 1 END AS of_day FROM e WHERE n = 1
  UNION ALL
  SELECT d, n, event_id, m, reason, CASE WHEN reason IS NULL THEN r + 1 ELSE r END, CASE WHEN reason IS NULL THEN t + cost ELSE t END, CASE WHEN reason IS NULL THEN of_day + 1 ELSE of_day END FROM (
    SELECT *, CASE WHEN r + 1 > {_FOLD.rpm} THEN 'rpm' WHEN t + cost > {_FOLD.tpm} THEN 'tpm' WHEN of_day + 1 > {_FOLD.rpd} THEN 'rpd' END AS reason FROM (
      SELECT e.d, e.n, e.event_id, e.m, e.cost, CASE WHEN e.m = f.m THEN f.requests ELSE 0 END AS r, CASE WHEN e.m = f.m THEN f.tokens ELSE 0 END AS t, f.of_day FROM fold f JOIN e ON e.d = f.d AND e.n = f.n + 1)))
SELECT event_id, reason IS NULL AS allowed, reason FROM fold"""
)
def quota_tpm_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.fold(_requests(spark, sf_dir), _FOLD).select("event_id", "allowed", "reason")


@query(
    f"""WITH a AS (SELECT event_id, ts, CAST(round(value * 100) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY ts, event_id) <= {RPM} AS allowed FROM events)
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n_requests, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM a WHERE allowed GROUP BY 1"""
)
def quota_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = quota.usage(quota.by_requests(_requests(spark, sf_dir), RPM))
    return used.select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "n_requests", "n_tokens")


@query(
    "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(greatest(1, 60 - floor(second(ts))) AS INT) AS to_minute, CAST(greatest(1, 86400 - (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)))) AS INT) AS to_day FROM events"
)
def quota_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", quota.day_of(ts).alias("day"), quota.seconds_to_next_minute(ts).alias("to_minute"), quota.seconds_to_day_end(ts).alias("to_day"))


@query("SELECT event_id, user_id, ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 00:00:00' AS live FROM events")
def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", "user_id", chat.is_live(F.col("ts").cast("timestamp_ntz"), now).alias("live"))


_INNER, _OUTER = (p.hex() for p in token.pads(b"an example key"))
_BODY = "translate(rtrim(to_base64(encode('{\"sub\":' || user_id || ',\"exp\":' || event_id || '}')), '='), '+/', '-_')"


@query(
    f"""SELECT event_id, body || '.' || translate(rtrim(to_base64(unhex(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(body)))))), '='), '+/', '-_') AS token, event_id > 5000 AS is_valid
FROM (SELECT event_id, {_BODY} AS body FROM events)"""
)
def session_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signed token for each event, and whether it is still valid at second 5000."""
    payload = F.concat(F.lit('{"sub":'), "user_id", F.lit(',"exp":'), "event_id", F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_id", token.sign(payload, b"an example key").alias("token"))
    return rows.withColumn("is_valid", token.is_valid(F.col("token"), b"an example key", F.lit(5000)))


@query(
    """WITH old AS (SELECT 'person' || c_custkey || '@example.com' AS email, c_name AS name, 'member' AS role, c_custkey AS id FROM customer),
fresh AS (SELECT 'person' || s_suppkey * 10 || '@example.com' AS email, s_name AS name, 'new' AS role, 1000000 + s_suppkey AS id FROM supplier)
SELECT coalesce(o.email, f.email) AS email, coalesce(o.id, f.id) AS id, coalesce(f.name, o.name) AS name, coalesce(o.role, f.role) AS role FROM old o FULL JOIN fresh f ON o.email = f.email"""
)
def upsert_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ins merged into the known users: names change, roles and ids of known users stay."""
    old, new = _users(spark, sf_dir)
    return store.upsert(old, new, ["email"], ["name"]).select("email", "id", "name", "role")


@query(
    """WITH old AS (SELECT 'person' || c_custkey || '@example.com' AS email, c_name AS name, 'member' AS role, c_custkey AS id FROM customer),
fresh AS (SELECT 'person' || s_suppkey * 10 || '@example.com' AS email, s_name AS name, 'admin' AS role, 1000000 + s_suppkey AS id FROM supplier)
SELECT coalesce(o.email, f.email) AS email, coalesce(o.id, f.id) AS id, coalesce(f.name, o.name) AS name, coalesce(f.role, o.role) AS role FROM old o FULL JOIN fresh f ON o.email = f.email"""
)
def seed_admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, with the role taken from the seeds."""
    old, new = _users(spark, sf_dir)
    return store.upsert(old, new.withColumn("role", F.lit("admin")), ["email"], ["name", "role"]).select("email", "id", "name", "role")


def _users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def address(n: F.Column) -> F.Column:
        return F.concat(F.lit("person"), n, F.lit("@example.com")).alias("email")

    old = table(spark, sf_dir, "customer").select(address(F.col("c_custkey")), F.col("c_name").alias("name"), F.lit("member").alias("role"), F.col("c_custkey").cast("long").alias("id"))
    new = table(spark, sf_dir, "supplier").select(address(F.col("s_suppkey") * 10), F.col("s_name").alias("name"), F.lit("new").alias("role"), (F.col("s_suppkey") + 1_000_000).cast("long").alias("id"))
    return old, new


@query("SELECT user_id || '/' || event_type AS account, min(event_id) AS user_ref, max(event_id) AS last_seen FROM events GROUP BY 1")
def link_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts by (provider, account id): each event links its account anew; the first link's id stays."""
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    first = rows.groupBy("event_type", "user_id").agg(F.min("event_id").alias("id")).withColumn("last_seen", F.col("id"))
    new = rows.groupBy("event_type", "user_id").agg(F.max("event_id").alias("id")).withColumn("last_seen", F.col("id"))
    done = store.upsert(first, new, ["event_type", "user_id"], ["last_seen"])
    return done.select(F.concat("user_id", F.lit("/"), "event_type").alias("account"), F.col("id").alias("user_ref"), "last_seen")


@query(
    f"""SELECT conv_id, turn, md5('Is this message clear enough to search for? Reply with JSON: decision (proceed or clarify), clarificationQuestion.' || chr(10) || 'History:' || chr(10) || '(none)' || chr(10) || 'Message: ' || text) AS gate_md5,
  md5('[' || turn || '] ' || CASE WHEN length(text) > 1200 THEN regexp_replace(substring(text, 1, 1200), '{BLANK_SQL}+$', '') || '...' ELSE text END) AS candidate_md5 FROM conversations"""
)
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir)
    return rows.select("conv_id", "turn", F.md5(prompts.ambiguity(F.col("text"), F.lit(""))).alias("gate_md5"), F.md5(prompts.candidate(F.col("turn"), F.col("text"))).alias("candidate_md5"))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def ownership_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("conv_id"))
    return chat.owned(_messages(spark, sf_dir), owners, "conv_id").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, '{\"content\":\"' || md5(text) || '\",\"url\":\"' || role || '\",\"debug\":{\"turn\":' || turn || '}}' AS json FROM conversations")
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).select("conv_id", "turn", F.md5("text").alias("content"), F.col("role").alias("url"))
    return rows.select("conv_id", "turn", P.json_column(rows.columns, ["turn"]).alias("json"))
