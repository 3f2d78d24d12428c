"""Search and read queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from turnwise.functions import text
from turnwise.operators import reads, relations, search, search_index
from turnwise.plans.catalog.registry import query
from turnwise.plans.catalog.usage import SESSIONS, TURNS
from turnwise.session import work_dir
from turnwise.sources import bridge

NOW_MS = 1_717_200_000_000  # 2024-06-01T00:00:00Z, so that relevance does not depend on the clock
QUERY = "the data"

DOCS = """docs AS (SELECT 't:' || lpad(CAST(d.doc_id AS VARCHAR), 9, '0') AS turn_id, 'sess:doc:' || (d.doc_id % 50) AS session_ref, d.source AS source_id,
        d.text, d.source || ' ' || d.lang AS path_text, CASE WHEN d.doc_id % 3 <> 0 THEN 'p' || (d.doc_id % 4) END AS project_id,
        CASE WHEN d.doc_id % 3 = 0 THEN 'unlinked' WHEN d.doc_id % 2 = 0 THEN 'committed' ELSE 'candidate' END AS link_state,
        CASE WHEN l.quality = 0 THEN 'archived' ELSE 'active' END AS value_axis,
        epoch_ms(1704067200000 + d.doc_id * 60000) AS said_at, strftime(epoch_ms(1704067200000 + d.doc_id * 60000), '%Y-%m-%dT%H:%M:%S.%gZ') AS submission_started_at
      FROM documents d LEFT JOIN labels l USING (doc_id))"""

# A bounded prefix in DuckDB: whole code points while their bytes fit. Every character of the cut is tested by its end offset.
BOUND = """bounded AS (SELECT * EXCLUDE (text), CASE WHEN octet_length(encode(text)) <= 16384 THEN text ELSE
        list_aggregate(list_transform(list_filter(list_zip(string_split(text, ''), range(1, length(text) + 1)),
          lambda z: octet_length(encode(left(text, CAST(z[2] AS BIGINT)))) <= 16370), lambda z: z[1]), 'string_agg', '') || '...[truncated]' END AS canonical_text FROM docs)"""

WHOLE = "bounded AS (SELECT * EXCLUDE (text), text AS canonical_text FROM docs)"


def candidates(spark, sf_dir):
    return search.search_candidates(bridge.document_turns(spark, sf_dir))


def _match(column: str, terms: list[str]) -> str:
    return "(" + " AND ".join(f"contains(lower({column}), '{t}')" for t in terms) + ")"


def _hits_sql(terms: list[str]) -> str:
    merged = " || ".join(
        f"""list_transform(list_filter(range(1, length(canonical_text) + 1), lambda i: substr(lower(canonical_text), CAST(i AS BIGINT), {len(t)}) = '{t}'),
            lambda i: [i - 1, i - 1 + {len(t)}])""" for t in terms
    )
    return f"""found AS (SELECT *, {merged} AS spans FROM bounded WHERE {_match('canonical_text', terms)} OR {_match('path_text', terms)}),
    -- A hit opens a merged span if no earlier-starting hit reaches it; terms do not overlap themselves.
    scored AS (SELECT * EXCLUDE (spans), len(list_filter(list_distinct(list_transform(spans, lambda s: s[1])),
                    lambda a: len(list_filter(spans, lambda o: o[1] < a AND o[2] >= a)) = 0)) AS highlight_count FROM found),
    hits AS (SELECT *, highlight_count * 10 + 5 * greatest(0, 1 - ln(1 + greatest(0, 1717200000000 - epoch_ms(said_at)) / 7776000000.0) / ln(101)) AS relevance_score FROM scored)"""


@query("search_text_bound", f"WITH {DOCS}, {BOUND} SELECT turn_id, octet_length(encode(canonical_text)) AS bytes, md5(canonical_text) AS digest FROM bounded")
def search_text_bound(spark, sf_dir):
    cut = bridge.document_turns(spark, sf_dir).select("turn_id", text.bound_text(F.col("canonical_text")).alias("cut"))
    return cut.select("turn_id", F.octet_length("cut").cast("bigint").alias("bytes"), F.md5("cut").alias("digest"))


@query(
    "search_match",
    f"WITH {DOCS}, {WHOLE} SELECT turn_id FROM bounded WHERE {_match('canonical_text', ['the', 'data'])} OR {_match('path_text', ['the', 'data'])}",
)
def search_match(spark, sf_dir):
    return candidates(spark, sf_dir).where(search.search_match(search.search_terms(" The  DATA the "))).select("turn_id")


@query("search_highlights", f"WITH {DOCS}, {WHOLE}, {_hits_sql(['data'])} SELECT turn_id, CAST(highlight_count AS BIGINT) AS highlight_count FROM hits")
def search_highlights(spark, sf_dir):
    hits = search.search_hits(candidates(spark, sf_dir), "data", NOW_MS)
    return hits.select("turn_id", F.size("highlights").cast("bigint").alias("highlight_count"))


#: Words of which some overlap others, so that spans touch, overlap and lie inside one another.
RANGE_TERMS = ["the", "he", "data", "at"]


@query(
    "highlight_ranges",
    f"""WITH {DOCS}, {WHOLE}, terms AS (SELECT unnest({RANGE_TERMS}) AS t),
    pieces AS (SELECT turn_id, t, string_split(lower(canonical_text), t) AS p FROM bounded, terms WHERE {_match('canonical_text', RANGE_TERMS)}),
    u AS (SELECT turn_id, t, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS n FROM pieces),
    ends AS (SELECT *, sum(length(piece)) OVER (PARTITION BY turn_id, t ORDER BY i) + (i - 1) * length(t) AS start FROM u),
    spans AS (SELECT turn_id, CAST(start AS BIGINT) AS s, CAST(start + length(t) AS BIGINT) AS e FROM ends WHERE i < n),
    opened AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY turn_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM spans),
    placed AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY turn_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS span FROM opened),
    merged AS (SELECT turn_id, span, min(s) AS s, max(e) AS e FROM placed GROUP BY 1, 2)
    SELECT turn_id, count(*) AS spans, md5(string_agg(s || '-' || e, ',' ORDER BY s)) AS ranges FROM merged GROUP BY 1""",
)
def highlight_ranges(spark, sf_dir):
    """Where all hits of several terms lie in the turns whose text has all of them."""
    turns = candidates(spark, sf_dir)
    lowered = F.lower("canonical_text")
    for term in RANGE_TERMS:
        turns = turns.where(lowered.contains(term))
    spans = search.highlights(F.col("canonical_text"), RANGE_TERMS)
    told = F.transform(F.col("spans"), lambda s: F.concat_ws("-", s["start"], s["end"]))
    return turns.select("turn_id", spans.alias("spans")).select("turn_id", F.size("spans").cast("bigint").alias("count"), F.md5(F.array_join(told, ",")).alias("ranges")).withColumnRenamed("count", "spans")


@query("search_relevance", f"WITH {DOCS}, {WHOLE}, {_hits_sql(['data'])} SELECT turn_id, round(relevance_score, 6) AS relevance_score FROM hits")
def search_relevance(spark, sf_dir):
    hits = search.search_hits(candidates(spark, sf_dir), "data", NOW_MS)
    return hits.select("turn_id", F.round("relevance_score", 6).alias("relevance_score"))


@query(
    "search_page",
    f"""WITH {DOCS}, {WHOLE}, {_hits_sql(['data'])}
    SELECT turn_id, round(relevance_score, 6) AS relevance_score FROM hits ORDER BY hits.relevance_score DESC, submission_started_at DESC, turn_id LIMIT 11 OFFSET 3""",
)
def search_page(spark, sf_dir):
    page, _ = search.search(candidates(spark, sf_dir), "data", NOW_MS, limit=11, offset=3)
    return page.select("turn_id", F.round("relevance_score", 6).alias("relevance_score"))


ASKED = ["data", "the data", "worthless", "th", "qqzx", "ing ted"]


@query(
    "search_indexed",
    f"WITH {DOCS}, {WHOLE} "
    + " UNION ALL ".join(
        f"SELECT '{q}' AS asked, turn_id FROM bounded WHERE {_match('canonical_text', q.split())} OR {_match('path_text', q.split())}" for q in ASKED
    ),
)
def search_indexed(spark, sf_dir):
    """Several queries through the index of letter triples: common, rare, unknown and too short ones."""
    turns = candidates(spark, sf_dir)
    index = search_index.write_index(turns, work_dir(spark, "triples"))
    found = [search.search_hits(search_index.narrowed(turns, index, q), q, NOW_MS).select(F.lit(q).alias("asked"), "turn_id") for q in ASKED]
    return reduce(lambda a, b: a.unionByName(b), found)


@query(
    "search_total",
    f"""WITH {DOCS}, {WHOLE} SELECT count(*) AS total FROM bounded WHERE ({_match('canonical_text', ['data'])} OR {_match('path_text', ['data'])})
    AND project_id = 'p1' AND link_state IN ('committed', 'candidate') AND value_axis = 'active'""",
)
def search_total(spark, sf_dir):
    filters = {"project_id": "p1", "link_states": ["committed", "candidate"], "value_axes": ["active"], "source_ids": []}
    return search.search(candidates(spark, sf_dir), "data", NOW_MS, **filters)[1]


def _document_projects(spark, sf_dir):
    turns = bridge.document_turns(spark, sf_dir).where(F.col("project_id").isNotNull() & (F.col("project_id") != "p3"))
    return turns.select("project_id").distinct().withColumn("display_name", F.concat(F.lit("Project "), F.col("project_id")))


@query(
    "search_groups",
    f"""WITH {DOCS}, {WHOLE}, {_hits_sql(['data'])}
    SELECT CASE WHEN project_id IS NULL OR project_id = 'p3' THEN '__unlinked__' ELSE project_id END AS project_key,
           CASE WHEN project_id IS NULL OR project_id = 'p3' THEN 'Unlinked' ELSE 'Project ' || project_id END AS project_name,
           count(*) AS hits, arg_max(turn_id, (highlight_count, said_at)) AS best_turn_id
    FROM hits GROUP BY 1, 2""",
)
def search_groups(spark, sf_dir):
    hits = search.search_hits(candidates(spark, sf_dir), "data", NOW_MS)
    # Rank by whole highlights and time only, which SQL can repeat without rounding questions.
    hits = hits.withColumn("relevance_score", F.size("highlights").cast("double"))
    return search.search_groups(hits, _document_projects(spark, sf_dir))


@query(
    "search_candidate_paths",
    f"""WITH {DOCS}, parts AS (
      SELECT 'sess:doc:' || (page_id % 60) AS session_ref, p AS part FROM pages, (VALUES (0), (1)) v(i),
             LATERAL (SELECT CASE i WHEN 0 THEN regexp_extract(url, '^[a-z]+://([^/]+)', 1) ELSE '/' || regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) END AS p)),
    seen AS (SELECT session_ref, string_agg(DISTINCT part, ' ' ORDER BY part) AS observed FROM parts GROUP BY 1)
    SELECT turn_id, d.path_text || ' /d/' || session_ref[10:] || coalesce(' ' || observed, '') AS path_text FROM docs d LEFT JOIN seen USING (session_ref)""",
)
def search_candidate_paths(spark, sf_dir):
    turns = bridge.document_turns(spark, sf_dir)
    sessions = turns.select("session_ref").distinct().withColumn(
        "working_directory", F.concat(F.lit("/d/"), F.substring("session_ref", 10, 9))
    )
    pages = bridge.table(spark, sf_dir, "pages")
    observations = pages.select(
        F.concat(F.lit("sess:doc:"), F.col("page_id") % 60).alias("session_ref"),
        F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("repo_remote"),
        F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]*)", 1)).alias("workspace_path"),
    )
    return search.search_candidates(turns, sessions, observations).select("turn_id", "path_text")


# --- lists, latest, trees --------------------------------------------------------------------------------------------

PROJECTS = f"""{TURNS}, {SESSIONS},
    proj AS (SELECT project_id, count(*) FILTER (link_state = 'committed') AS committed_turn_count, count(*) FILTER (link_state = 'candidate') AS candidate_turn_count,
             count(DISTINCT session_ref) AS session_count, max(last_context_activity_at) AS activity, 'Project ' || project_id[2:] AS display_name,
             '/work/app' || project_id[2:] AS primary_workspace_path, CASE WHEN CAST(project_id[2:] AS INT) < 4 THEN 'committed' ELSE 'candidate' END AS linkage_state
      FROM turns WHERE project_id IS NOT NULL GROUP BY project_id)"""


@query("list_sources", "SELECT event_type AS source_id, 'slot-' || event_type AS slot_id, count(*) AS total_turns FROM events GROUP BY 1")
def list_sources(spark, sf_dir):
    return reads.list_sources(bridge.usage_sources(spark, sf_dir)).select("source_id", "slot_id", "total_turns")


@query(
    "source_health",
    """SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'stale' ELSE 'healthy' END AS health, count(DISTINCT event_type) AS sources
    FROM events GROUP BY 1""",
)
def source_health(spark, sf_dir):
    return reads.source_health(bridge.usage_sources(spark, sf_dir))


@query(
    "list_projects",
    f"""WITH {PROJECTS} SELECT project_id, display_name, committed_turn_count, candidate_turn_count, session_count FROM proj
    ORDER BY committed_turn_count + candidate_turn_count DESC, session_count DESC, activity DESC, display_name, project_id LIMIT 3""",
)
def list_projects(spark, sf_dir):
    listed = reads.list_projects(bridge.usage_projects(spark, sf_dir), limit=3)
    return listed.select("project_id", "display_name", "committed_turn_count", "candidate_turn_count", "session_count")


@query(
    "order_sessions",
    f"""WITH {TURNS}, {SESSIONS}, last AS (SELECT session_ref, max(last_context_activity_at) AS last_message_at FROM turns GROUP BY 1),
    every AS (SELECT session_ref, created_at, updated_at FROM sess UNION ALL SELECT session_ref || ':opened', created_at, created_at FROM sess WHERE user_id % 8 = 3)
    SELECT session_ref, last_message_at, row_number() OVER (ORDER BY last_message_at IS NULL, coalesce(last_message_at, updated_at) DESC, created_at DESC, session_ref) AS place
    FROM every LEFT JOIN last USING (session_ref)""",
)
def order_sessions(spark, sf_dir):
    """All turns; some users have a second session that was only opened and has no turn."""
    sessions = bridge.usage_sessions(spark, sf_dir)
    opened = sessions.where(F.substring("session_ref", 9, 9).cast("int") % 8 == 3)
    opened = opened.withColumns({"session_ref": F.concat("session_ref", F.lit(":opened")), "updated_at": F.col("created_at"), "turn_count": F.lit(0).cast("bigint")})
    placed = reads.session_places(sessions.unionByName(opened), bridge.usage_turns(spark, sf_dir))
    return placed.select("session_ref", "last_message_at", "place")


def _related(spark, sf_dir):
    sessions = bridge.usage_sessions(spark, sf_dir)
    edges = relations.relation_edges(bridge.relation_fragments(spark, sf_dir), sessions)
    return relations.related_work(edges, sessions)


CHILDREN = """children AS (SELECT DISTINCT 'sess:ev:' || user_id AS session_ref FROM events
    WHERE (event_type = 'signup' OR (event_type = 'view' AND CAST(json_extract(props, '$.k') AS BIGINT) % 5 = 0)) AND user_id % 2 = 0)"""


@query("top_level_sessions", f"WITH {SESSIONS}, {CHILDREN} SELECT session_ref FROM sess ANTI JOIN children USING (session_ref)")
def top_level_sessions(spark, sf_dir):
    return reads.top_level_sessions(bridge.usage_sessions(spark, sf_dir), _related(spark, sf_dir)).select("session_ref")


@query(
    "latest_sessions",
    f"""WITH {TURNS}, {SESSIONS}, {CHILDREN},
    page AS (SELECT s.session_ref, model, max(last_context_activity_at) AS last_message_at, CAST(sum(total) AS BIGINT) AS total_tokens, any_value(created_at) AS created_at
             FROM sess s ANTI JOIN children USING (session_ref) JOIN resolved USING (session_ref) GROUP BY 1, 2
             ORDER BY last_message_at DESC, created_at DESC, s.session_ref LIMIT 20)
    SELECT session_ref, last_message_at, total_tokens FROM page""",
)
def latest_sessions(spark, sf_dir):
    latest = reads.latest_sessions(bridge.usage_sessions(spark, sf_dir), bridge.usage_turns(spark, sf_dir), _related(spark, sf_dir))
    return latest.select("session_ref", "last_message_at", "total_tokens")


@query("latest_turns", f"WITH {TURNS} SELECT turn_id, submission_started_at FROM turns ORDER BY submission_started_at DESC, turn_id LIMIT 20")
def latest_turns(spark, sf_dir):
    return reads.latest_turns(bridge.usage_turns(spark, sf_dir)).select("turn_id", "submission_started_at")


@query("session_turns", f"WITH {TURNS} SELECT turn_id, submission_started_at FROM turns WHERE session_ref = 'sess:ev:7'")
def session_turns(spark, sf_dir):
    return reads.session_turns(bridge.usage_turns(spark, sf_dir), "sess:ev:7").select("turn_id", "submission_started_at")


@query("project_turns", f"WITH {TURNS} SELECT turn_id, submission_started_at FROM turns WHERE project_id = 'p2'")
def project_turns(spark, sf_dir):
    return reads.project_turns(bridge.usage_turns(spark, sf_dir), "p2").select("turn_id", "submission_started_at")


IN_SCOPE = "(working_directory = '/work/app3' OR starts_with(working_directory, '/work/app3/'))"


@query("scope_sessions", f"WITH {SESSIONS} SELECT session_ref, working_directory FROM sess WHERE {IN_SCOPE}")
def scope_sessions(spark, sf_dir):
    return reads.scope_sessions(bridge.usage_sessions(spark, sf_dir), "/work/x/../app3/").select("session_ref", "working_directory")


@query("scope_turns", f"WITH {TURNS}, {SESSIONS} SELECT turn_id FROM turns SEMI JOIN (FROM sess WHERE {IN_SCOPE}) USING (session_ref)")
def scope_turns(spark, sf_dir):
    sessions = bridge.usage_sessions(spark, sf_dir)
    return reads.scope_turns(bridge.usage_turns(spark, sf_dir), sessions, "/WORK/App3", fold_case=True).select("turn_id")


@query(
    "scope_projects",
    f"""WITH {PROJECTS}, inside AS (SELECT session_ref, primary_project_id FROM sess WHERE working_directory = '/work/app5/sub1' OR starts_with(working_directory, '/work/app5/sub1/'))
    SELECT project_id FROM proj WHERE project_id IN (SELECT project_id FROM turns SEMI JOIN inside USING (session_ref) WHERE project_id IS NOT NULL
        UNION SELECT primary_project_id FROM inside WHERE primary_project_id IS NOT NULL)""",
)
def scope_projects(spark, sf_dir):
    projects, sessions, turns = (f(spark, sf_dir) for f in (bridge.usage_projects, bridge.usage_sessions, bridge.usage_turns))
    return reads.scope_projects(projects, sessions, turns, "/work/app5/sub1").select("project_id")


@query(
    "project_tree",
    f"""WITH {PROJECTS}, {CHILDREN}, top AS (SELECT * FROM sess ANTI JOIN children USING (session_ref)),
    edges AS (SELECT DISTINCT project_id, session_ref FROM turns SEMI JOIN top USING (session_ref) WHERE project_id IN (SELECT project_id FROM proj)
              UNION SELECT primary_project_id, session_ref FROM top WHERE primary_project_id IN (SELECT project_id FROM proj))
    SELECT e.project_id, e.session_ref, t.turn_id FROM edges e LEFT JOIN turns t ON t.project_id = e.project_id AND t.session_ref = e.session_ref
    UNION ALL SELECT NULL, s.session_ref, t.turn_id FROM top s LEFT JOIN turns t USING (session_ref) WHERE s.session_ref NOT IN (SELECT session_ref FROM edges)
    UNION ALL SELECT project_id, NULL, NULL FROM proj WHERE project_id NOT IN (SELECT project_id FROM edges)""",
)
def project_tree(spark, sf_dir):
    projects, sessions, turns = (f(spark, sf_dir) for f in (bridge.usage_projects, bridge.usage_sessions, bridge.usage_turns))
    return reads.project_tree(projects, sessions, turns, _related(spark, sf_dir))


@query(
    "project_entries",
    f"""WITH {PROJECTS}
    SELECT project_id AS key, display_name, linkage_state, primary_workspace_path AS workspace_path, session_count,
           committed_turn_count + candidate_turn_count AS turn_count, activity AS last_activity_at FROM proj
    UNION ALL SELECT '__unlinked__', 'Unlinked / candidate-only', 'unlinked', NULL, count(DISTINCT session_ref), count(*), arg_min(last_context_activity_at, submission_started_at)
    FROM turns WHERE project_id IS NULL""",
)
def project_entries(spark, sf_dir):
    return reads.project_entries(bridge.usage_projects(spark, sf_dir), bridge.usage_turns(spark, sf_dir))


@query(
    "show_session",
    f"""WITH {TURNS}, {SESSIONS} SELECT s.session_ref, s.title, s.working_directory, t.turn_id, t.project_id FROM sess s LEFT JOIN turns t USING (session_ref) WHERE s.session_ref = 'sess:ev:11'""",
)
def show_session(spark, sf_dir):
    shown = reads.show_session(bridge.usage_sessions(spark, sf_dir), bridge.usage_turns(spark, sf_dir), "sess:ev:11")
    return shown.select("session_ref", "title", "working_directory", "turn_id", "project_id")


@query(
    "show_turn",
    f"""WITH {PROJECTS}, c AS (SELECT 't:' || (event_id - event_id % 4) AS turn_id, event_id AS pos, event_type, 'out ' || k AS said FROM ev)
    SELECT t.turn_id, t.session_ref, s.title AS session_title, p.display_name AS project_name,
      (SELECT string_agg(said, '; ' ORDER BY pos) FROM c WHERE c.turn_id = t.turn_id AND event_type IN ('purchase', 'signup')) AS replies,
      (SELECT string_agg(said, '; ' ORDER BY pos) FROM c WHERE c.turn_id = t.turn_id AND event_type IN ('view', 'click')) AS tool_calls
    FROM turns t LEFT JOIN sess s USING (session_ref) LEFT JOIN proj p USING (project_id) WHERE t.turn_id = 't:40'""",
)
def show_turn(spark, sf_dir):
    """One turn with what was said and called in it: the events of four that follow one another."""
    turns, sessions, projects = (f(spark, sf_dir) for f in (bridge.usage_turns, bridge.usage_sessions, bridge.usage_projects))
    events = bridge.events(spark, sf_dir)
    said = events.select(F.concat(F.lit("t:"), F.col("event_id") - F.col("event_id") % 4).alias("turn_id"), F.col("event_id").alias("pos"), "event_type", F.concat(F.lit("out "), "k").alias("said"))
    context = {"replies": said.where(F.col("event_type").isin("purchase", "signup")), "tool_calls": said.where(F.col("event_type").isin("view", "click"))}
    shown = reads.show_turn(turns, sessions, projects, "t:40", {n: rows.drop("event_type") for n, rows in context.items()})
    told = lambda c: F.array_join(F.transform(c, lambda r: r["said"]), "; ").alias(c)
    return shown.select("turn_id", "session_ref", "session_title", "project_name", told("replies"), told("tool_calls"))


@query("show_project", f"WITH {PROJECTS} SELECT p.project_id, display_name, turn_id, session_ref FROM proj p LEFT JOIN turns USING (project_id) WHERE p.project_id = 'p4'")
def show_project(spark, sf_dir):
    shown = reads.show_project(bridge.usage_projects(spark, sf_dir), bridge.usage_turns(spark, sf_dir), "p4")
    return shown.select("project_id", "display_name", "turn_id", "session_ref")


# --- references ------------------------------------------------------------------------------------------------------


def _refs(spark, sf_dir):
    """References drawn from the sessions: exact ids, titles (shared or not), native ids, prefixes, blanks, unknown ones."""
    sessions = bridge.usage_sessions(spark, sf_dir)
    user = F.substring("session_ref", 9, 9)
    ref = (
        F.when(user.cast("int") % 6 == 0, F.col("session_ref"))
        .when(user.cast("int") % 6 == 1, F.upper("title"))
        .when(user.cast("int") % 6 == 2, F.upper("source_session_id"))
        .when(user.cast("int") % 6 == 3, F.concat(F.lit("N-"), F.substring(user, 1, 2)))
        .when(user.cast("int") % 6 == 4, F.lit("  "))
        .otherwise(F.concat(F.lit("nothing-"), user))
    )
    return sessions.select(F.coalesce(ref, F.lit("")).alias("ref")).distinct()


@query(
    "resolve_refs",
    f"""WITH {SESSIONS},
    refs AS (SELECT DISTINCT coalesce(CASE user_id % 6 WHEN 0 THEN session_ref WHEN 1 THEN upper(title) WHEN 2 THEN 'N-' || user_id
                    WHEN 3 THEN 'N-' || left(CAST(user_id AS VARCHAR), 2) WHEN 4 THEN '  ' ELSE 'nothing-' || user_id END, '') AS ref FROM sess),
    ask AS (SELECT ref, lower(trim(ref)) AS key FROM refs WHERE trim(ref) <> ''),
    e AS (SELECT session_ref AS id, 'n-' || user_id AS native, lower(title) AS title FROM sess),
    exact AS (SELECT ref, id FROM ask, e WHERE id = ref),
    alias AS (SELECT DISTINCT ref, id FROM ask, e WHERE id = ref OR native = key OR title = key),
    prefix AS (SELECT DISTINCT ref, id FROM ask, e WHERE starts_with(id, ref) OR starts_with(native, key)),
    n AS (SELECT ref, (SELECT count(*) FROM exact x WHERE x.ref = r.ref) AS n0, (SELECT count(*) FROM alias x WHERE x.ref = r.ref) AS n1,
                 (SELECT count(*) FROM prefix x WHERE x.ref = r.ref) AS n2,
                 coalesce((SELECT min(id) FROM exact x WHERE x.ref = r.ref), (SELECT min(id) FROM alias x WHERE x.ref = r.ref), (SELECT min(id) FROM prefix x WHERE x.ref = r.ref)) AS id
          FROM refs r),
    c AS (SELECT ref, id, CASE WHEN n0 > 0 THEN n0 WHEN n1 > 0 THEN n1 ELSE n2 END AS candidates FROM n)
    SELECT ref, CASE WHEN candidates = 1 THEN id END AS id, CASE WHEN candidates = 1 THEN 'resolved' WHEN candidates > 1 THEN 'ambiguous' ELSE 'not_found' END AS status, candidates FROM c""",
)
def resolve_refs(spark, sf_dir):
    entities = bridge.usage_sessions(spark, sf_dir).select(
        F.col("session_ref").alias("id"), "source_session_id", "title", "working_directory"
    )
    return reads.resolve_refs(_refs(spark, sf_dir), entities, ["source_session_id", "title", "working_directory"], ["source_session_id"])


@query(
    "display_refs",
    """WITH ids AS (SELECT sha1('turn::' || doc_id) AS id FROM documents UNION SELECT 'conv-' || conv_id FROM conversations UNION SELECT 'sess:claude_code:' || sha1(CAST(page_id AS VARCHAR)) FROM pages),
    near AS (SELECT id, lag(id) OVER (ORDER BY id) AS b, lead(id) OVER (ORDER BY id) AS a FROM ids),
    shared AS (SELECT id, coalesce(list_max(list_filter(range(0, length(id) + 1), lambda i: left(b, CAST(i AS BIGINT)) = left(id, CAST(i AS BIGINT)) AND length(b) >= i)), 0) AS sb,
                      coalesce(list_max(list_filter(range(0, length(id) + 1), lambda i: left(a, CAST(i AS BIGINT)) = left(id, CAST(i AS BIGINT)) AND length(a) >= i)), 0) AS sa FROM near)
    SELECT id, left(id, CAST(greatest(8, sb + 1, sa + 1) AS BIGINT)) AS display_ref FROM shared""",
)
def display_refs(spark, sf_dir):
    docs = bridge.table(spark, sf_dir, "documents").select(F.sha1(F.concat(F.lit("turn::"), F.col("doc_id"))).alias("id"))
    talks = bridge.table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("id")).distinct()
    pages = bridge.table(spark, sf_dir, "pages").select(F.concat(F.lit("sess:claude_code:"), F.sha1(F.col("page_id").cast("string"))).alias("id"))
    return reads.display_refs(docs.unionByName(talks).unionByName(pages))


@query(
    "session_labels",
    f"""WITH {SESSIONS}, b AS (SELECT session_ref, 'n-' || user_id AS native, coalesce(title, 'n-' || user_id) AS base FROM sess),
    peers AS (SELECT *, count(*) OVER (PARTITION BY lower(base)) AS n FROM b),
    len AS (SELECT p.session_ref, min(l.i) AS size FROM peers p, LATERAL (SELECT unnest(range(least(8, length(p.native)), length(p.native) + 1)) AS i) l
            WHERE p.n > 1 AND NOT EXISTS (SELECT 1 FROM b o WHERE lower(o.base) = lower(p.base) AND o.session_ref <> p.session_ref AND starts_with(o.native, left(p.native, l.i))) GROUP BY 1),
    own AS (SELECT p.session_ref, min(l.i) AS size FROM peers p, LATERAL (SELECT unnest(range(8, length(p.session_ref) + 1)) AS i) l
            WHERE p.n > 1 AND NOT EXISTS (SELECT 1 FROM b o WHERE lower(o.base) = lower(p.base) AND o.session_ref <> p.session_ref AND starts_with(o.session_ref, left(p.session_ref, l.i))) GROUP BY 1)
    SELECT p.session_ref, CASE WHEN n = 1 THEN base
        ELSE coalesce(left(native, len.size), left(p.session_ref, own.size), CASE WHEN CAST(p.session_ref[9:] AS INT) % 2 = 0 THEN 'codex' ELSE 'claude_code' END) || ' · ' || base END AS label
    FROM peers p LEFT JOIN len USING (session_ref) LEFT JOIN own USING (session_ref)""",
)
def session_labels(spark, sf_dir):
    return reads.session_labels(bridge.usage_sessions(spark, sf_dir))


@query(
    "session_runs",
    f"""WITH {TURNS}, o AS (SELECT *, row_number() OVER (ORDER BY submission_started_at DESC, turn_id) - 1 AS position,
             lag(session_ref) OVER (ORDER BY submission_started_at DESC, turn_id) AS prev FROM turns),
    r AS (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR prev <> session_ref THEN 1 ELSE 0 END) OVER (ORDER BY position) AS BIGINT) AS run FROM o),
    v AS (SELECT session_ref, count(*) AS visible_turns FROM turns GROUP BY 1)
    SELECT run, session_ref, min(position) AS first_index, count(*) AS run_length, any_value(visible_turns) AS visible_turns FROM r JOIN v USING (session_ref) GROUP BY 1, 2""",
)
def session_runs(spark, sf_dir):
    return reads.session_runs(bridge.usage_turns(spark, sf_dir)).select("run", "session_ref", "first_index", "run_length", "visible_turns")


@query(
    "subset_by_sessions",
    f"WITH {TURNS}, {SESSIONS} SELECT turn_id FROM turns SEMI JOIN (FROM sess WHERE user_id % 10 = 0) USING (session_ref)",
)
def subset_by_sessions(spark, sf_dir):
    sessions = bridge.usage_sessions(spark, sf_dir)
    refs = sessions.where(F.substring("session_ref", 9, 9).cast("int") % 10 == 0).select("session_ref")
    return reads.subset_by_sessions({"turns": bridge.usage_turns(spark, sf_dir)}, refs)["turns"].select("turn_id")


@query(
    "select_contexts",
    f"WITH {TURNS} SELECT turn_id, source_id FROM turns WHERE project_id = 'p1'",
)
def select_contexts(spark, sf_dir):
    turns = bridge.usage_turns(spark, sf_dir)
    contexts = turns.select("turn_id", "source_id")
    return reads.select_contexts(contexts, "matching", turns.where(F.col("project_id") == "p1"))


@query("truncated_previews", "SELECT doc_id, CASE WHEN length(text) <= 140 THEN text ELSE left(text, 139) || '...' END AS preview FROM documents")
def truncated_previews(spark, sf_dir):
    return bridge.table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 140).alias("preview"))
