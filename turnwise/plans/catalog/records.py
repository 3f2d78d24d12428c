"""Records, expressions, masks, sessions, audits, exports and streams over data derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import ids, masks, paths, roles, timekeys, tokens
from turnwise.functions.ordered import with_position
from turnwise.operators import atoms as atom_ops
from turnwise.operators import quality
from turnwise.operators import sessions as session_ops
from turnwise.operators import turns as turn_ops
from turnwise.operators import variants
from turnwise.plans.catalog.conversation import GROUPS_SQL, atoms_sql
from turnwise.plans.catalog.linking import ISO
from turnwise.plans.catalog.registry import query
from turnwise.plans.catalog.usage import EV, SESSIONS, TURNS
from turnwise.schemas import ATOM, RECORD, complete
from turnwise.session import materialize, work_dir
from turnwise.sources import bridge, files, ranges, sinks
from turnwise.sources.formats import fragments_of
from turnwise.sources.formats import parse_stage as parse_stage_of

# --- transcript records written from conversations -------------------------------------------------------------------


def _conversation_records(spark, sf_dir, platform, body):
    """Conversation rows as raw records of one format; ``body`` builds the JSON line."""
    rows = bridge.table(spark, sf_dir, "conversations")
    at = timekeys.from_millis(F.lit(bridge.EPOCH_MS) + F.col("conv_id") * bridge.HOUR_MS + F.col("turn") * bridge.MINUTE_MS)
    rows = rows.withColumn("at", at)
    return complete(
        rows.select(
            F.lit("conv").alias("source_id"),
            F.lit(platform).alias("source_platform"),
            F.concat(F.lit("b:"), F.col("conv_id")).alias("blob_id"),
            F.lit("/logs/a.jsonl").alias("origin_path"),
            F.concat(F.lit("sess:conv:"), F.col("conv_id")).alias("session_ref"),
            F.concat(F.lit("r:"), F.col("conv_id"), F.lit(":"), F.col("turn")).alias("record_id"),
            F.col("turn").alias("ordinal"),
            F.col("at").alias("observed_at"),
            body.alias("raw_json"),
        ),
        RECORD,
    )


def _json(**fields):
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def _turn_counts(spark, sf_dir, profile, platform, body):
    fragments, _ = fragments_of(_conversation_records(spark, sf_dir, platform, body), profile)
    tagged = materialize(turn_ops.tag_groups(atom_ops.atomize(fragments)), "tagged")
    groups = turn_ops.submission_groups(tagged)
    return groups.groupBy("session_ref").agg(
        F.count("*").alias("turns"), F.sum("atom_count").alias("messages"), F.count_if(~F.col("assistant_seen")).alias("unanswered")
    )


TURN_COUNTS = f"""WITH {atoms_sql()}, {GROUPS_SQL},
    g AS (SELECT session_ref, group_index, count(*) FILTER (is_user) AS atom_count, bool_or(is_reply) AS seen FROM tagged WHERE group_index >= 0 GROUP BY 1, 2)
    SELECT session_ref, count(*) AS turns, CAST(sum(atom_count) AS BIGINT) AS messages, count(*) FILTER (NOT seen) AS unanswered FROM g GROUP BY 1"""


@query("records_generic", TURN_COUNTS)
def records_generic(spark, sf_dir):
    return _turn_counts(spark, sf_dir, "generic", "lobechat", _json(role=F.col("role"), content=F.col("text")))


@query("records_message_blocks", TURN_COUNTS)
def records_message_blocks(spark, sf_dir):
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    return _turn_counts(spark, sf_dir, "message_blocks", "claude_code", _json(type=F.col("role"), message=F.struct(F.col("role").alias("role"), part.alias("content"))))


@query("records_event_log", TURN_COUNTS)
def records_event_log(spark, sf_dir):
    part = F.array(F.struct(F.lit("input_text").alias("type"), F.col("text").alias("text")))
    payload = F.struct(F.lit("message").alias("type"), F.col("role").alias("role"), part.alias("content"))
    return _turn_counts(spark, sf_dir, "event_log", "codex", _json(type=F.lit("response_item"), payload=payload))


@query("records_factory", TURN_COUNTS)
def records_factory(spark, sf_dir):
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    message = F.struct(F.col("role").alias("role"), part.alias("content"))
    return _turn_counts(spark, sf_dir, "factory", "factory_droid", _json(type=F.lit("message"), message=message))


@query("records_thread", TURN_COUNTS)
def records_thread(spark, sf_dir):
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    return _turn_counts(spark, sf_dir, "thread", "amp", _json(role=F.col("role"), content=part))


@query("records_multi_agent", TURN_COUNTS)
def records_multi_agent(spark, sf_dir):
    return _turn_counts(spark, sf_dir, "multi_agent", "accio", _json(role=F.col("role"), content=F.col("text")))


@query("records_chat_history", TURN_COUNTS)
def records_chat_history(spark, sf_dir):
    return _turn_counts(spark, sf_dir, "chat_history", "grok", _json(type=F.col("role"), content=F.col("text")))


@query("records_wire", TURN_COUNTS)
def records_wire(spark, sf_dir):
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    origin = F.when(F.col("role") == "system", F.struct(F.lit("hook").alias("kind")))
    event = F.when(F.col("role") == "assistant", F.struct(F.lit("content.part").alias("type"), part.alias("part")))
    kind = F.when(F.col("role") == "assistant", "context.append_loop_event").otherwise("turn.prompt")
    return _turn_counts(spark, sf_dir, "wire", "kimi", _json(type=kind, input=F.when(F.col("role") != "assistant", F.array(part)), origin=origin, event=event))


@query(
    "parse_gate",
    """SELECT 'r:' || conv_id || ':' || turn AS scope_ref, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'record_json_parse_failed' ELSE 'record_not_object' END AS diagnostic_code
    FROM conversations WHERE (conv_id + turn) % 5 < 2""",
)
def parse_gate(spark, sf_dir):
    line = _json(role=F.col("role"), content=F.col("text"))
    pick = (F.col("conv_id") + F.col("turn")) % 5
    body = F.when(pick == 0, F.concat(line, F.lit("}"))).when(pick == 1, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line)
    _, audits = fragments_of(_conversation_records(spark, sf_dir, "generic", body), "generic")
    return audits.select("scope_ref", "diagnostic_code")


@query(
    "parse_stage",
    """WITH g AS (SELECT (conv_id + turn) % 5 AS pick FROM conversations)
    SELECT 'records' AS name, count(*) AS counted, count(*) AS observed FROM g UNION ALL SELECT 'unparsed', count(*) FILTER (pick < 2), count(*) FILTER (pick < 2) FROM g
    UNION ALL SELECT 'fragments', count(*) FILTER (pick <> 2), count(*) FILTER (pick <> 2) FROM g UNION ALL SELECT 'audits', count(*) FILTER (pick < 2 OR pick = 3), count(*) FILTER (pick < 2 OR pick = 3) FROM g""",
)
def parse_stage(spark, sf_dir):
    """Counts of a stage as observed while it was written, and as counted afterwards: broken records, records of which nothing
    is left, records that are not understood, and messages."""
    line = _json(role=F.col("role"), content=F.col("text"))
    pick = (F.col("conv_id") + F.col("turn")) % 5
    body = (
        F.when(pick == 0, F.concat(line, F.lit("}"))).when(pick == 1, F.concat(F.lit("["), line, F.lit("]")))
        .when(pick == 2, '{"type":"turn_ended"}').when(pick == 3, '{"what":"?"}').otherwise(line)
    )
    records = _conversation_records(spark, sf_dir, "cursor", body)
    fragments, audits, observed = parse_stage_of(records, "generic")
    unparsed = audits.where(F.col("diagnostic_code").startswith("record_"))
    counted = {"records": records, "unparsed": unparsed, "fragments": fragments, "audits": audits}
    rows = [df.agg(F.lit(n).alias("name"), F.count("*").alias("counted"), F.lit(observed[n]).cast("bigint").alias("observed")) for n, df in counted.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(
    "impute_ordinal_time",
    f"""SELECT 'r:' || conv_id || ':' || turn AS record_id,
        CASE WHEN turn % 2 = 0 THEN strftime(epoch_ms(1704067200000 + conv_id * 3600000 + turn * 60000), {ISO}) ELSE strftime(epoch_ms(1704067200000 + turn), {ISO}) END AS observed_at FROM conversations""",
)
def impute_ordinal_time(spark, sf_dir):
    records = _conversation_records(spark, sf_dir, "generic", F.lit("{}")).withColumn("observed_at", F.when(F.col("ordinal") % 2 == 0, F.col("observed_at")))
    return files.impute_ordinal_time(records, F.lit("2024-01-01T00:00:00.000Z")).select("record_id", "observed_at")


@query(
    "impute_fill_time",
    f"""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN strftime(epoch_ms(1704067200000 + conv_id * 3600000 + turn * 60000), {ISO}) END AS t FROM conversations)
    SELECT 'r:' || conv_id || ':' || turn AS record_id, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn),
        first_value(t IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'none') AS observed_at FROM r""",
)
def impute_fill_time(spark, sf_dir):
    records = _conversation_records(spark, sf_dir, "generic", F.lit("{}")).withColumn("observed_at", F.when(F.col("ordinal") % 3 == 1, F.col("observed_at")))
    return files.impute_fill_time(records, "none").select("record_id", "observed_at")


@query(
    "content_max_timestamp",
    f"""WITH r AS (SELECT conv_id, strftime(epoch_ms(1704067200000 + conv_id * 3600000 + ((turn * 7) % 5) * 60000), {ISO}) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
    SELECT 'b:' || conv_id AS blob_id, max(t) AS content_max_timestamp FROM r WHERE n <= 5 GROUP BY 1""",
)
def content_max_timestamp(spark, sf_dir):
    at = timekeys.from_millis(F.lit(bridge.EPOCH_MS) + F.col("conv_id") * bridge.HOUR_MS + ((F.col("turn") * 7) % 5) * bridge.MINUTE_MS)
    return files.content_max_timestamp(_conversation_records(spark, sf_dir, "generic", _json(timestamp=at)))


# --- expressions -----------------------------------------------------------------------------------------------------


@query("stable_ids", "SELECT doc_id, sha1('fragment::' || source || '::' || doc_id) AS stable_id, 'candidate-' || regexp_replace(source || '-' || lang || '/' || doc_id, '[^a-zA-Z0-9._-]+', '-', 'g') AS composite FROM documents")
def stable_ids(spark, sf_dir):
    return bridge.table(spark, sf_dir, "documents").select(
        "doc_id",
        ids.stable_id("fragment", F.col("source"), F.col("doc_id")).alias("stable_id"),
        ids.composite_key("candidate", F.col("source"), F.concat("lang", F.lit("/"), F.col("doc_id"))).alias("composite"),
    )


@query(
    "path_identity",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages),
    c AS (SELECT page_id, rtrim(regexp_replace(path, '/+', '/', 'g'), '/') AS path FROM p)
    SELECT page_id, '/w' || path AS plain, '/w a' || path AS encoded, 'c:/w' || path AS drive, '//host/w' || path AS share, '/w' || path AS dotted FROM c""",
)
def path_identity(spark, sf_dir):
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    rows = bridge.table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    spelled = {
        "plain": F.concat(F.lit("file:///w"), "path"),
        "encoded": F.concat(F.lit("file:///w%20a/./b/../"), "path"),
        "drive": F.concat(F.lit("C:\\w"), F.translate("path", "/", "\\")),
        "share": F.concat(F.lit("\\\\host\\w"), F.translate("path", "/", "\\")),
        "dotted": F.concat(F.lit("/w/x/./..//"), "path"),
    }
    return rows.select("page_id", *[paths.path_identity(value).alias(name) for name, value in spelled.items()])


@query(
    "normalize_remote",
    """WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages)
    SELECT page_id, 'https://' || host || '/a' AS plain, 'ssh://git@' || host || '/team/a' AS scp, sha1('repo-remote:https://' || host || '/a') AS fingerprint FROM h""",
)
def normalize_remote(spark, sf_dir):
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    plain = paths.normalize_remote(F.concat(F.lit(" https://"), host, F.lit("/a.git")))
    return bridge.table(spark, sf_dir, "pages").select(
        "page_id",
        plain.alias("plain"),
        paths.normalize_remote(F.concat(F.lit("git@"), host, F.lit(":team/a//"))).alias("scp"),
        paths.remote_fingerprint(plain).alias("fingerprint"),
    )


@query(
    "roles_and_policies",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'system' THEN 'system' ELSE 'assistant' END AS actor_kind,
        CASE WHEN starts_with(text, '[cron:') THEN 'automation_trigger' ELSE 'user_authored' END AS origin_kind,
        CASE WHEN role = 'user' AND length(text) > 180 THEN 'collapse' ELSE 'show' END AS display_policy,
        CASE turn % 5 WHEN 0 THEN 'end_turn' WHEN 1 THEN 'tool_use' WHEN 2 THEN 'max_tokens' WHEN 3 THEN 'error' END AS stop_reason FROM conversations""",
)
def roles_and_policies(spark, sf_dir):
    spelled = F.element_at(F.array(*[F.lit(w) for w in (" Finished", "Tool-Calls", "token limit", "CANCELED", "other")]), (F.col("turn") % 5 + 1).cast("int"))
    policy = roles.display_policy(F.when(F.col("role") == "user", "injected_user_shaped").otherwise("source_instruction"), F.col("text"))
    return bridge.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        roles.map_role(F.col("role")).alias("actor_kind"),
        roles.classify_origin(F.lit("generic"), F.lit(None).cast("string"), F.col("text")).alias("origin_kind"),
        policy.alias("display_policy"),
        roles.normalize_stop_reason(spelled).alias("stop_reason"),
    )


# --- masks -----------------------------------------------------------------------------------------------------------

MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MAIL_RULE = (masks.MaskTemplate("mask-mail", "regex", MAIL, "Mail", 0, ("user_message",)),)


@query("mask_spans", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{MAIL}')) AS BIGINT) AS spans, array_to_string(regexp_extract_all(text, '{MAIL}'), '|') AS masked FROM documents")
def mask_spans(spark, sf_dir):
    docs = bridge.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("spans", masks.mask_spans(F.col("text"), masks.select_templates("user_message", MAIL_RULE)))
    cut = F.transform("spans", lambda s: F.substring(F.col("text"), s.start + 1, s.end - s.start))
    return found.select("doc_id", F.size("spans").cast("bigint").alias("spans"), F.array_join(cut, "|").alias("masked"))


@query(
    "canonical_text",
    rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '{MAIL}', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM documents""",
)
def canonical_text(spark, sf_dir):
    docs = bridge.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("spans", masks.mask_spans(F.col("text"), masks.select_templates("user_message", MAIL_RULE)))
    shown = found.withColumn("segments", masks.display_segments(F.col("text"), F.col("spans"), F.lit(False)))
    return shown.select("doc_id", F.md5(masks.canonical_text(F.col("segments"))).alias("digest"))


# The label, the allowed form (taken out first, since this SQL has no lookahead), and what must not be left.
LEAKS = (
    ("unexpected home path", "/Users/mock_user/", """/Users/[^/\\s"')]+/"""),
    ("unsanitized git forge host", None, r"\bgitea\.[A-Za-z0-9.-]+\b"),
    ("unsanitized temp root", "/var/folders/mock/", "/var/folders/"),
    ("unsanitized launchd socket", r"/private/tmp/com\.apple\.launchd\.mock/", r"/private/tmp/com\.apple\.launchd\."),
    ("unsanitized vscode git socket", r"vscode-git-mock\.sock", "vscode-git-[A-Za-z0-9]+"),
    ("email address", None, MAIL),
    ("GitHub token", None, r"\bghp_[A-Za-z0-9]{20,}\b"),
    ("OpenAI-style token", None, r"\bsk-[A-Za-z0-9]{20,}\b"),
    ("authorization header", None, r"Authorization:\s+Bearer [A-Za-z0-9._-]{16,}"),
    ("bearer token", None, "Bearer [A-Za-z0-9._-]{16,}"),
    ("unsanitized shell integration nonce", None, '"(?:shellIntegrationNonce|VSCODE_NONCE|nonce)":"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"'),
    ("real username", None, "ouea"),
    ("real GitHub path", None, r"github\.com/ouea"),
)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Documents hold mail addresses only, so one text in two gets a leak (or an allowed form) of another kind behind it.
LEAK_SAMPLES = (
    "see /Users/someone/x", "see /Users/mock_user/x", "host gitea.corp.example", "/private/var/folders/ab", "/var/folders/mock/x", "/private/tmp/com.apple.launchd.a1/L",
    "vscode-git-a1b2.sock", "vscode-git-mock.sock", "ghp_" + "a1" * 12, "sk-" + "b2" * 12, "Authorization:  Bearer " + "c" * 20, "Bearer ${token}",
    '"nonce":"01234567-89ab-cdef-0123-456789abcdef"', "https://github.com/ouea/x",
)
_SAMPLES_SQL = "[" + ", ".join(_quoted(x) for x in LEAK_SAMPLES) + "]"
LEAK_SQL = f"WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' ' || {_SAMPLES_SQL}[CAST(doc_id // 2 % {len(LEAK_SAMPLES)} AS INT) + 1] ELSE '' END AS text FROM documents) " + " UNION ALL ".join(
    f"SELECT doc_id, {_quoted(label)} AS label FROM d WHERE regexp_matches({f'regexp_replace(text, {_quoted(allowed)}, {_quoted(chr(32))}, {_quoted(chr(103))})' if allowed else 'text'}, {_quoted(pattern)})"
    for label, allowed, pattern in LEAKS
)


@query("leak_scan", LEAK_SQL)
def leak_scan(spark, sf_dir):
    samples = F.array(*[F.lit(x) for x in LEAK_SAMPLES])
    sample = F.get(samples, (F.floor(F.col("doc_id") / 2) % len(LEAK_SAMPLES)).cast("int"))
    docs = bridge.table(spark, sf_dir, "documents")
    leaking = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" "), sample)).otherwise(F.col("text")).alias("text"))
    return quality.leak_scan(leaking, "doc_id", "text", private_names=("ouea",))


# --- sessions --------------------------------------------------------------------------------------------------------


@query(
    "session_bounds",
    f"""SELECT 'sess:conv:' || conv_id AS session_ref, strftime(epoch_ms(1704067200000 + conv_id * 3600000 + min(turn) * 60000), {ISO}) AS created_at,
        strftime(epoch_ms(1704067200000 + conv_id * 3600000 + max(turn) * 60000), {ISO}) AS updated_at FROM conversations GROUP BY conv_id""",
)
def session_bounds(spark, sf_dir):
    return session_ops.session_bounds(bridge.conversation_atoms(spark, sf_dir)).select("session_ref", "created_at", "updated_at")


@query(
    "hydrate_sessions",
    r"""WITH t AS (SELECT conv_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS title, turn FROM conversations WHERE role = 'user'),
    f AS (SELECT conv_id, arg_min(title, turn) AS title FROM t WHERE title <> '' GROUP BY 1)
    SELECT 'sess:conv:' || conv_id AS session_ref, CASE WHEN length(title) <= 72 THEN title ELSE left(title, 71) || '...' END AS title
    FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN f USING (conv_id)""",
)
def hydrate_sessions(spark, sf_dir):
    return session_ops.hydrate_sessions(bridge.conversation_atoms(spark, sf_dir)).select("session_ref", "title")


def _drafts(spark, sf_dir):
    rows = bridge.events(spark, sf_dir)
    return rows.select(
        F.concat(F.lit("s:"), F.col("user_id")).alias("session_ref"),
        F.lit("ev").alias("source_id"),
        F.col("event_id").alias("arrival"),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("T"), F.col("k"))).alias("title"),
        timekeys.iso(F.col("ts")).alias("created_at"),
        timekeys.iso(F.col("ts")).alias("updated_at"),
    )


@query(
    "merge_sessions",
    f"""WITH {EV} SELECT 's:' || user_id AS session_ref, arg_min('T' || k, event_id) FILTER (k % 3 = 0) AS title, min(iso) AS created_at, max(iso) AS updated_at, count(*) AS files FROM ev GROUP BY user_id""",
)
def merge_sessions(spark, sf_dir):
    return session_ops.merge_sessions(_drafts(spark, sf_dir)).select("session_ref", "title", "created_at", "updated_at", "files")


@query(
    "suppress_overlap",
    f"""WITH {EV}, r AS (SELECT event_id, user_id AS s, k % 3 AS cap, k % 3 < 2 AS composer, event_type = 'signup' AS u, event_type = 'error' AS m FROM ev),
    c AS (SELECT s, cap, composer, count(*) FILTER (u AND NOT m) AS users FROM r GROUP BY ALL),
    b AS (SELECT s, arg_min(cap, (-users, cap)) FILTER (composer) AS best, max(users) FILTER (composer) AS best_users, count(*) FILTER (NOT composer) AS transcripts,
                 coalesce(sum(users) FILTER (NOT composer), 0) AS said FROM c GROUP BY s)
    SELECT event_id FROM r JOIN b USING (s) WHERE CASE WHEN composer THEN m OR (cap = best AND (transcripts = 0 OR best_users >= said))
        ELSE best IS NULL OR best_users < said END""",
)
def suppress_overlap(spark, sf_dir):
    return session_ops.suppress_overlap(_overlapping(spark, sf_dir)).select("event_id")


@query(
    "suppressed_bounds",
    f"""WITH {EV}, r AS (SELECT event_id, user_id AS s, k % 3 AS cap, k % 3 < 2 AS composer, event_type = 'signup' AS u, event_type = 'error' AS m, iso FROM ev),
    c AS (SELECT s, cap, composer, count(*) FILTER (u AND NOT m) AS users FROM r GROUP BY ALL),
    b AS (SELECT s, arg_min(cap, (-users, cap)) FILTER (composer) AS best, max(users) FILTER (composer) AS best_users, count(*) FILTER (NOT composer) AS transcripts,
                 coalesce(sum(users) FILTER (NOT composer), 0) AS said FROM c GROUP BY s),
    kept AS (SELECT r.* FROM r JOIN b USING (s) WHERE CASE WHEN composer THEN m OR (cap = best AND (transcripts = 0 OR best_users >= said)) ELSE best IS NULL OR best_users < said END)
    SELECT 's:' || s AS session_ref, min(iso) AS created_at, max(iso) AS updated_at,
           count(DISTINCT cap) AS captures, count(*) FILTER (u) AS user_records FROM kept GROUP BY s""",
)
def suppressed_bounds(spark, sf_dir):
    """Bounds of sessions after overlapping captures were dropped."""
    return session_ops.suppressed_bounds(_overlapping(spark, sf_dir))


def _overlapping(spark, sf_dir):
    kind = F.col("event_type")
    return bridge.events(spark, sf_dir).select(
        "event_id",
        F.concat(F.lit("s:"), F.col("user_id")).alias("session_ref"),
        (F.col("k") % 3).alias("capture_id"),
        F.when(F.col("k") % 3 < 2, "composer").otherwise("transcript").alias("capture_kind"),
        (F.col("k") % 3).alias("capture_order"),
        (kind == "signup").alias("is_user"),
        (kind == "error").alias("is_meta"),
        timekeys.iso(F.col("ts")).alias("observed_at"),
    )


COMMON = ", ".join(f"'{w}'" for w in sorted(variants.COMMON_WORDS))
COLLAPSE_SQL = rf"""WITH RECURSIVE src AS (
      SELECT conv_id, turn, role, CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN 'Please REVIEW the **parser** modules, and their ' || CASE turn % 4 WHEN 0 THEN 'tests' WHEN 2 THEN 'stories again' ELSE 'x' END
             WHEN role = 'user' AND conv_id % 3 = 1 AND turn > 0 THEN (SELECT text FROM conversations o WHERE o.conv_id = c.conv_id AND role = 'user' ORDER BY turn LIMIT 1) || CASE WHEN turn % 4 = 2 THEN ' and more of it' ELSE '' END
             ELSE text END AS text, role = 'assistant' AND conv_id % 5 <> 0 AS reply, (turn // 4) * 660000 + turn * 60000 AS ms FROM conversations c),
    m AS (SELECT *, sum(CASE WHEN reply THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS replies FROM src WHERE role = 'user' OR reply),
    u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, coalesce(abs(ms - lag(ms) OVER (PARTITION BY conv_id ORDER BY turn)) > 600000, true) AS paused FROM m WHERE role = 'user'),
    p AS (SELECT *, sum(paused::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS island, trim(regexp_replace(lower(replace(replace(text, '**', ''), '`', '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS plain FROM u),
    w AS (SELECT *, list_distinct(list_filter(list_transform(string_split(plain, ' '), lambda x: CASE
            WHEN regexp_full_match(x, '[a-z]{{3,}}') THEN CASE WHEN length(x) > 4 AND ends_with(x, 'ies') THEN left(x, length(x) - 3) || 'y' WHEN length(x) > 4 AND ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN left(x, length(x) - 1) ELSE x END
            WHEN length(x) >= CASE WHEN regexp_full_match(x, '[\x00-\x7F]*') THEN 3 ELSE 2 END THEN x END), lambda x: x IS NOT NULL AND x NOT IN ({COMMON}))) AS stems FROM p),
    walk AS (
      SELECT conv_id, n, turn, replies, island, ms AS kept_ms, plain AS kept, stems AS kept_stems, false AS dropped FROM w WHERE n = 1
      UNION ALL
      SELECT conv_id, n, turn, CASE WHEN d THEN r0 ELSE replies END, CASE WHEN d THEN i0 ELSE island END, CASE WHEN d THEN kept_ms ELSE ms END, CASE WHEN d THEN kept ELSE plain END, CASE WHEN d THEN kept_stems ELSE stems END, d
      FROM (SELECT w.*, k.kept_ms, k.kept, k.kept_stems, k.replies AS r0, k.island AS i0,
              k.replies = w.replies AND k.island = w.island AND abs(w.ms - k.kept_ms) <= 600000 AND k.kept <> '' AND w.plain <> '' AND (
                k.kept = w.plain OR (length(k.kept) <= length(w.plain) AND length(k.kept) >= 24 AND contains(w.plain, k.kept)) OR (length(w.plain) < length(k.kept) AND length(w.plain) >= 24 AND contains(k.kept, w.plain))
                OR (least(len(w.stems), len(k.kept_stems)) > 0 AND len(list_intersect(w.stems, k.kept_stems)) >= 4 AND len(list_intersect(w.stems, k.kept_stems)) / least(len(w.stems), len(k.kept_stems)) >= 0.6
                    AND len(list_intersect(w.stems, k.kept_stems)) / greatest(len(w.stems), len(k.kept_stems)) >= 0.45)) AS d
            FROM walk k JOIN w ON w.conv_id = k.conv_id AND w.n = k.n + 1))
    SELECT 'sess:conv:' || conv_id AS session_ref, turn AS pos, 'a:' || conv_id || ':' || turn AS atom_id FROM src WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM walk WHERE dropped)"""


@query("collapse_prompt_variants", COLLAPSE_SQL)
def collapse_prompt_variants(spark, sf_dir):
    """A third of the conversations repeat one prompt in other words, another third their first prompt; some replies are hidden."""
    rows = bridge.table(spark, sf_dir, "conversations")
    first = rows.where(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("_first"))
    turn, third, user = F.col("turn"), F.col("conv_id") % 3, F.col("role") == "user"
    words = F.when(turn % 4 == 0, "tests").when(turn % 4 == 2, "stories again").otherwise("x")
    said = (
        F.when(user & (third == 0), F.concat(F.lit("Please REVIEW the **parser** modules, and their "), words))
        .when(user & (third == 1) & (turn > 0), F.concat("_first", F.when(turn % 4 == 2, " and more of it").otherwise("")))
        .otherwise(F.col("text"))
    )
    atoms = rows.join(first, "conv_id", "left").select(
        F.lit("conv").alias("source_id"),
        F.concat(F.lit("sess:conv:"), "conv_id").alias("session_ref"),
        F.concat(F.lit("a:"), "conv_id", F.lit(":"), "turn").alias("atom_id"),
        turn.alias("pos"),
        F.col("role").alias("actor_kind"),
        F.lit("text").alias("content_kind"),
        F.when(user, "user_authored").otherwise("assistant_authored").alias("origin_kind"),
        F.when((F.col("role") == "assistant") & (F.col("conv_id") % 5 == 0), "hide").otherwise("show").alias("display_policy"),
        timekeys.from_millis(F.lit(bridge.EPOCH_MS) + F.floor(turn / 4) * 660_000 + turn * 60_000).alias("time_key"),
        said.alias("text"),
    )
    return variants.collapse_prompt_variants(complete(atoms, ATOM)).select("session_ref", "pos", "atom_id")


# --- audits ----------------------------------------------------------------------------------------------------------


@query(
    "audit",
    f"""WITH {TURNS}, {SESSIONS},
    proj AS (SELECT project_id, count(*) FILTER (link_state = 'committed') AS c, count(*) FILTER (link_state = 'candidate') AS d, count(DISTINCT session_ref) AS s FROM turns WHERE project_id IS NOT NULL AND project_id <> 'p6' GROUP BY 1)
    SELECT 'missing-source' AS code, 'turn' AS entity, turn_id AS id FROM turns WHERE source_id = 'signup'
    UNION ALL SELECT 'missing-project', 'turn', turn_id FROM turns WHERE project_id = 'p6'
    UNION ALL SELECT 'session-primary-project', 'session', session_ref FROM sess WHERE primary_project_id IN ('p0', 'p6')
    UNION ALL SELECT 'projected-unlinked-turn', 'turn', turn_id FROM turns WHERE project_id IS NOT NULL AND link_state = 'unlinked'
    UNION ALL SELECT 'session-turn-count', 'session', session_ref FROM sess WHERE user_id % 10 = 0
    UNION ALL SELECT 'turns-not-recency-ordered', 'snapshot', turn_id FROM (SELECT *, lag((-epoch_ms(CAST(submission_started_at AS TIMESTAMP)), turn_id)) OVER (ORDER BY CAST(turn_id[3:] AS BIGINT)) AS prev FROM turns)
        WHERE prev > (-epoch_ms(CAST(submission_started_at AS TIMESTAMP)), turn_id)""",
)
def audit(spark, sf_dir):
    turns = bridge.usage_turns(spark, sf_dir).withColumn("position", F.substring("turn_id", 3, 20).cast("bigint"))
    sessions = bridge.usage_sessions(spark, sf_dir)
    user = F.substring("session_ref", 9, 9).cast("int")
    sessions = sessions.withColumn("turn_count", F.col("turn_count") + F.when(user % 10 == 0, 1).otherwise(0))
    found = quality.audit(bridge.usage_sources(spark, sf_dir, known=False), bridge.usage_projects(spark, sf_dir, known=False), sessions, turns)
    return found.select("code", "entity", "id")


@query(
    "audit_counts",
    f"""WITH {TURNS}, {SESSIONS},
    t AS (SELECT *, CAST(turn_id[3:] AS BIGINT) AS id, CAST(session_ref[9:] AS INT) AS u FROM turns), t2 AS (SELECT * FROM t UNION ALL SELECT * FROM t WHERE id % 500 = 0),
    s2 AS (SELECT *, row_number() OVER (ORDER BY user_id) AS place FROM sess WHERE user_id % 17 <> 0),
    said AS (SELECT session_ref, max(last_context_activity_at) AS last FROM t2 GROUP BY 1),
    wanted AS (SELECT s2.session_ref, row_number() OVER (ORDER BY last IS NULL, coalesce(last, updated_at) DESC, created_at DESC, s2.session_ref) AS place FROM s2 LEFT JOIN said USING (session_ref)),
    p AS (SELECT project_id, CAST(project_id[2:] AS INT) AS n, count(*) FILTER (link_state = 'committed') AS c, count(*) FILTER (link_state = 'candidate') AS d FROM t WHERE project_id IS NOT NULL GROUP BY 1),
    now AS (SELECT project_id, count(*) FILTER (link_state = 'committed') AS c, count(*) FILTER (link_state = 'candidate') AS d FROM t2 WHERE project_id IS NOT NULL GROUP BY 1),
    counted AS (SELECT session_ref, count(*) AS n FROM t2 GROUP BY 1)
    SELECT 'duplicate-id' AS code, 'source' AS entity, 'view' AS id UNION ALL SELECT 'duplicate-id', 'project', 'p2' UNION ALL SELECT 'duplicate-id', 'turn', turn_id FROM t WHERE id % 500 = 0
    UNION ALL SELECT 'duplicate-id', 'context', turn_id FROM t WHERE id % 700 = 0
    UNION ALL SELECT 'missing-context-turn', 'context', 'gone' || turn_id FROM t WHERE id % 900 = 0
    UNION ALL SELECT 'missing-session', 'turn', turn_id FROM t2 WHERE u % 17 = 0
    UNION ALL SELECT 'session-primary-project', 'session', session_ref FROM s2 WHERE primary_project_id = 'p0'
    UNION ALL SELECT 'projected-unlinked-turn', 'turn', turn_id FROM t2 WHERE project_id IS NOT NULL AND link_state = 'unlinked'
    UNION ALL SELECT 'turn-usage-total-mismatch', 'turn', turn_id FROM t2 WHERE id % 100 = 3 AND has_usage
    UNION ALL SELECT 'session-turn-count', 'session', s2.session_ref FROM s2 JOIN counted USING (session_ref) WHERE s2.turn_count <> counted.n
    UNION ALL SELECT 'project-turn-count', 'project', project_id FROM (FROM p UNION ALL FROM p WHERE n = 2) q JOIN now USING (project_id) WHERE q.c + CASE WHEN q.n % 3 = 0 THEN 1 ELSE 0 END <> now.c OR q.d <> now.d
    UNION ALL SELECT 'project-session-count', 'project', project_id FROM p WHERE n % 3 = 1
    UNION ALL SELECT 'sessions-not-recency-ordered', 'snapshot', s2.session_ref FROM s2 JOIN wanted w USING (place) WHERE w.session_ref <> s2.session_ref""",
)
def audit_counts(spark, sf_dir):
    """Repeated ids, wrong counts and totals, missing sessions, loose contexts and a list in another order: the codes that ``audit`` has no case of."""
    turns = bridge.usage_turns(spark, sf_dir)
    number = F.substring("turn_id", 3, 20).cast("bigint")
    total = tokens.structured_total(F.col("token_usage"))
    turns = turns.withColumn("total_tokens", F.when(number % 100 == 3, total + 1).otherwise(F.col("total_tokens")))
    contexts = turns.select("turn_id").unionByName(turns.where(number % 700 == 0).select("turn_id")).unionByName(turns.where(number % 900 == 0).select(F.concat(F.lit("gone"), "turn_id").alias("turn_id")))
    turns = turns.unionByName(turns.where(number % 500 == 0))
    user = F.substring("session_ref", 9, 9).cast("int")
    sessions = with_position(bridge.usage_sessions(spark, sf_dir).where(user % 17 != 0).withColumn("user", user), [], ["user"], "position").drop("user")
    sources = bridge.usage_sources(spark, sf_dir)
    projects = bridge.usage_projects(spark, sf_dir)
    order = F.substring("project_id", 2, 9).cast("int")
    projects = projects.withColumns({
        "committed_turn_count": F.col("committed_turn_count") + F.when(order % 3 == 0, 1).otherwise(0),
        "session_count": F.col("session_count") + F.when(order % 3 == 1, 1).otherwise(0),
    })
    found = quality.audit(
        sources.unionByName(sources.where("source_id = 'view'")), projects.unionByName(projects.where("project_id = 'p2'")), sessions, turns, contexts
    )
    return found.select("code", "entity", "id")


def _audits(spark, sf_dir):
    rows = bridge.events(spark, sf_dir).where(F.col("event_type") == "error")
    return quality.loss_audits(
        rows.select(
            F.concat(F.lit("src"), F.col("k") % 3).alias("source_id"),
            F.element_at(F.array(*[F.lit(s) for s in quality.STAGES]), (F.col("k") % 8 + 1).cast("int")).alias("stage_kind"),
            F.when(F.col("k") % 2 == 0, "info").otherwise("warning").alias("severity"),
            F.lit("unknown_fragment").alias("loss_kind"),
            F.concat(F.lit("r:"), F.col("event_id")).alias("scope_ref"),
            F.lit("broken").alias("detail"),
        )
    )


STAGE_LIST = ", ".join(f"'{s}'" for s in quality.STAGES)


@query(
    "loss_by_stage",
    f"WITH {EV} SELECT 'src' || (k % 3) AS source_id, [{STAGE_LIST}][CAST(k % 8 + 1 AS INT)] AS stage_kind, count(*) FILTER (k % 2 <> 0) AS failures FROM ev WHERE event_type = 'error' GROUP BY 1, 2",
)
def loss_by_stage(spark, sf_dir):
    return quality.loss_by_stage(_audits(spark, sf_dir))


@query(
    "stage_runs",
    f"""WITH {EV}, n AS (SELECT 'src' || (k % 3) AS source_id, count(*) AS c FROM ev GROUP BY 1),
    f AS (SELECT 'src' || (k % 3) AS source_id, [{STAGE_LIST}][CAST(k % 8 + 1 AS INT)] AS stage_kind, count(*) FILTER (k % 2 <> 0) AS failures FROM ev WHERE event_type = 'error' GROUP BY 1, 2),
    s AS (SELECT source_id, unnest([{STAGE_LIST}]) AS stage_kind, unnest([1, c, c + 1, c + 2, c + 3, 2 * c + 1, c + 1, c + 1]) AS input_count, unnest([c, c + 1, c + 2, c + 3, 2 * c + 1, 2 * c + 1, c + 1, c + 1]) AS output_count FROM n)
    SELECT source_id, stage_kind, input_count, output_count, coalesce(failures, 0) AS failure_count FROM s LEFT JOIN f USING (source_id, stage_kind)""",
)
def stage_runs(spark, sf_dir):
    per_source = bridge.events(spark, sf_dir).groupBy(F.concat(F.lit("src"), F.col("k") % 3).alias("source_id")).agg(F.count("*").alias("c"))
    counts = per_source.select(
        "source_id", *[(F.col("c") + i).alias(n) for n, i in (("blobs", 0), ("records", 1), ("fragments", 2), ("atoms", 3), ("sessions", 0), ("turns", 1))]
    )
    return quality.stage_runs(counts, _audits(spark, sf_dir)).select("source_id", "stage_kind", "input_count", "output_count", "failure_count")


@query(
    "source_status",
    f"""WITH {TURNS}, {SESSIONS}, n AS (SELECT source_id, count(*) AS t FROM turns GROUP BY 1), s AS (SELECT source_id, count(*) AS c FROM sess GROUP BY 1)
    SELECT e.event_type AS source_id, 'healthy' AS sync_status, coalesce(c, 0) AS total_sessions, coalesce(t, 0) AS total_turns
    FROM (SELECT DISTINCT event_type FROM events) e LEFT JOIN n ON n.source_id = e.event_type LEFT JOIN s ON s.source_id = e.event_type
    UNION ALL SELECT 'unread', 'error', 0, 0 UNION ALL SELECT 'empty', 'stale', 0, 0""",
)
def source_status(spark, sf_dir):
    turns = bridge.usage_turns(spark, sf_dir)
    errors = bridge.events(spark, sf_dir).where(F.col("event_type") == "error")
    # Files of two sources could not be read; of one of them all turns came through all the same.
    failed = errors.select(F.explode(F.array(F.lit("error"), F.lit("unread"))).alias("source_id"), F.col("event_id").alias("file_order"), F.lit("cannot read").alias("detail"))
    sources = bridge.usage_sources(spark, sf_dir)
    more = [sources.limit(1).withColumn("source_id", F.lit(n)) for n in ("unread", "empty")]
    status = quality.source_status(sources.unionByName(more[0]).unionByName(more[1]), bridge.usage_sessions(spark, sf_dir), turns, failed)
    return status.select("source_id", "sync_status", "total_sessions", "total_turns")


# --- captures --------------------------------------------------------------------------------------------------------


def _captures(spark, sf_dir):
    return bridge.events(spark, sf_dir).select(
        F.concat(F.lit("b:"), F.col("event_id")).alias("blob_id"),
        F.lit("ev").alias("source_id"),
        F.concat(F.lit("/f/"), F.col("user_id")).alias("origin_path"),
        F.col("k").alias("size_bytes"),
        F.sha1(F.col("k").cast("string")).alias("checksum"),
        F.col("event_id").alias("captured_at"),
        timekeys.iso(F.col("ts")).alias("file_modified_at"),
    )


@query("tail_capture", f"WITH {EV} SELECT '/f/' || user_id AS origin_path, 'b:' || arg_min(event_id, (-k, event_id)) AS blob_id, max(k) AS size_bytes FROM ev GROUP BY user_id")
def tail_capture(spark, sf_dir):
    return files.tail_capture(_captures(spark, sf_dir)).select("origin_path", "blob_id", "size_bytes")


@query(
    "changed_files",
    f"""WITH {EV} SELECT 'b:' || event_id AS blob_id FROM ev a WHERE event_id % 2 = 0 AND iso >= '2024-01-18T00:00:00.000Z'
    AND NOT EXISTS (SELECT 1 FROM ev p WHERE p.event_id % 2 = 1 AND p.user_id = a.user_id AND p.k = a.k)""",
)
def changed_files(spark, sf_dir):
    captures = _captures(spark, sf_dir)
    odd = F.col("captured_at") % 2 == 1
    return files.changed_files(captures.where(~odd), captures.where(odd), since="2w", now="2024-02-01T00:00:00.000Z").select("blob_id")


# --- exports --------------------------------------------------------------------------------------


EXPORTED = f"""{TURNS}, {SESSIONS}, src AS (SELECT DISTINCT event_type AS source_id FROM events),
    every AS (
      SELECT 2 AS rank, 0 AS k1, source_id AS id, 'source' AS kind, 'slot-' || source_id AS said FROM src
      UNION ALL SELECT 4, -epoch_ms(CAST(updated_at AS TIMESTAMP)), session_ref, 'session', title FROM sess
      UNION ALL SELECT 6, -epoch_ms(CAST(submission_started_at AS TIMESTAMP)), turn_id, 'turn', 'said in ' || session_ref FROM turns
      UNION ALL SELECT 9, 0, 'audit:' || turn_id, 'loss_audit', 'broken' FROM turns WHERE source_id = 'error')"""


def _exported(spark, sf_dir):
    turns = bridge.usage_turns(spark, sf_dir)
    audits = turns.where("source_id = 'error'").select(F.concat(F.lit("audit:"), "turn_id").alias("audit_id"), F.lit("broken").alias("detail"))
    said = turns.withColumn("canonical_text", F.concat(F.lit("said in "), "session_ref"))
    return {"turn": said, "session": bridge.usage_sessions(spark, sf_dir), "loss_audit": audits, "source": bridge.usage_sources(spark, sf_dir)}


@query("export_jsonl", f"WITH {EXPORTED} SELECT row_number() OVER (ORDER BY rank, k1, id) - 1 AS place, kind, id, said FROM every")
def export_jsonl(spark, sf_dir):
    """Every line of an export of four kinds: its place over all files, and what it says."""
    target = work_dir(spark, "export")
    sinks.export_jsonl(_exported(spark, sf_dir), target)
    value = lambda *names: F.coalesce(*[F.get_json_object("line", f"$.value.{n}") for n in names])
    kind = F.get_json_object("line", "$.kind")
    said = F.when(kind == "source", value("slot_id")).when(kind == "session", value("title")).when(kind == "turn", value("canonical_text")).otherwise(value("detail"))
    key = F.when(kind == "session", value("session_ref")).otherwise(value("audit_id", "turn_id", "source_id"))
    return sinks.read_export(spark, target).select("place", kind.alias("kind"), key.alias("id"), said.alias("said"))


@query(
    "export_markdown",
    f"""WITH {EXPORTED}, c AS (SELECT kind, min(rank) AS rank, count(*) AS n FROM every GROUP BY kind),
    lines AS (SELECT -2 AS a, 0 AS k1, '' AS id, '# Transcript export' AS line UNION ALL SELECT rank, 0, '', '- ' || kind || ': ' || n FROM c UNION ALL SELECT 50, 0, '', '## Turns'
      UNION ALL SELECT 60, k1, id, '### ' || strftime(epoch_ms(-k1), {ISO}) || ' · ' || id FROM every WHERE kind = 'turn' UNION ALL SELECT 60, k1, id || chr(1), said FROM every WHERE kind = 'turn')
    SELECT row_number() OVER (ORDER BY a, k1, id) - 1 AS place, line FROM lines""",
)
def export_markdown(spark, sf_dir):
    """All lines of the text that are not blank, in order."""
    target = work_dir(spark, "markdown")
    sinks.export_markdown(_exported(spark, sf_dir), target)
    names = [p["name"] for p in sinks.read_manifest(target)["parts"]]
    listing = spark.createDataFrame([(f"{target}/{n}", n) for n in names], "uri string, origin_path string")
    sized = listing.join(ranges.listed(spark, target).select(F.element_at(F.split("origin_path", "/"), -1).alias("origin_path"), "length"), "origin_path")
    lines = ranges.numbered_lines(sized)
    return with_position(lines, [], ["origin_path", "ordinal"], "place").select("place", F.col("raw_json").alias("line"))


@query("compact_turns", f"WITH {TURNS} SELECT turn_id, session_ref, project_id, link_state, primary_model AS model, replies AS assistant_reply_count FROM turns")
def compact_turns(spark, sf_dir):
    return sinks.compact("turn", bridge.usage_turns(spark, sf_dir)).select("turn_id", "session_ref", "project_id", "link_state", "model", "assistant_reply_count")
