"""Project linking and session relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.operators import projects as project_ops
from turnwise.operators import relations
from turnwise.plans.catalog.registry import query
from turnwise.plans.catalog.usage import SESSIONS
from turnwise.session import materialize
from turnwise.sources import bridge

ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"
OBSERVATIONS = f"""raw AS (SELECT page_id, page_id // 3 AS number, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
        regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS segment FROM pages),
    obs AS (SELECT 'o:' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS observation_id, 'sess:web:' || number AS session_ref, number, page_id,
        strftime(epoch_ms(1704067200000 + page_id * 60000), {ISO}) AS observed_at,
        'h' || (number % 2) AS host_id, CASE WHEN number % 3 = 0 THEN 'codex' ELSE 'grok' END AS platform,
        CASE WHEN page_id % 5 <> 3 THEN rtrim('/' || segment, '/') ELSE CASE WHEN number % 4 = 0 THEN '/home/u' || (number % 5) END END AS w0,
        CASE WHEN page_id % 7 = 2 THEN rtrim('/' || segment, '/') END AS r0,
        CASE WHEN page_id % 3 <> 1 THEN nullif(host, '') END AS remote,
        CASE WHEN page_id % 2 = 0 AND page_id % 3 <> 1 THEN sha1(host) END AS fingerprint,
        CASE WHEN page_id % 11 = 0 THEN 'native-' || (page_id % 4) END AS native FROM raw),
    hyd AS (SELECT * EXCLUDE (w0, r0), CASE WHEN w0 = '' THEN '/' ELSE w0 END AS workspace, CASE WHEN r0 = '' THEN '/' ELSE r0 END AS root FROM obs),
    h AS (SELECT *, CASE WHEN workspace = root THEN '.' END AS subpath FROM hyd),
    weak AS (SELECT *, lower(workspace) IN ('/root', '/tmp') OR starts_with(lower(workspace), '/tmp/')
                OR list_last(string_split(lower(workspace), '/')) IN ('tmp', 'temp', 'scratchpad') AS is_weak, coalesce(subpath, workspace) AS ident FROM h),
    crules AS (SELECT *, 'committed' AS scope, 'repo_fingerprint_match' AS reason, 1 AS prio, 0.95 AS conf, 'fingerprint:' || fingerprint || '|workspace:' || ident AS key FROM weak
      UNION ALL SELECT *, 'committed', 'repo_remote_match', 2, 0.85, 'host:' || host_id || '|remote:' || remote || '|workspace:' || ident FROM weak
      UNION ALL SELECT *, 'committed', 'repo_root_match', 3, 0.82, 'host:' || host_id || '|repo_root:' || root || '|workspace:' || ident FROM weak),
    cok AS (SELECT * FROM crules WHERE key IS NOT NULL),
    rest AS (SELECT * FROM weak ANTI JOIN cok USING (observation_id)),
    drules AS (SELECT *, 'candidate' AS scope, 'source_native_project' AS reason, 4 AS prio, 0.7 AS conf, 'host:' || host_id || '|native:' || native AS key FROM rest
      UNION ALL SELECT *, 'candidate', CASE WHEN is_weak THEN 'weak_path_hint' ELSE 'workspace_path_continuity' END, CASE WHEN is_weak THEN 6 ELSE 5 END,
             CASE WHEN is_weak THEN 0.42 ELSE 0.55 END, 'host:' || host_id || '|workspace:' || workspace FROM rest
      UNION ALL SELECT *, 'candidate', 'metadata_hint', 7, 0.6, 'host:' || host_id || '|remote_hint:' || remote FROM rest),
    rules AS (SELECT * FROM cok UNION ALL SELECT * FROM drules WHERE key IS NOT NULL)"""

# Components in SQL: reach every key from every key over observations, take the smallest.
COMPONENTS = f"""{OBSERVATIONS},
    links AS (SELECT DISTINCT a.scope || '|' || a.key AS a, b.scope || '|' || b.key AS b FROM rules a JOIN rules b USING (observation_id, scope)),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
    placed AS (SELECT r.*, c.component FROM rules r JOIN comp c ON c.node = r.scope || '|' || r.key),
    keyed AS (SELECT component, scope, key, reason, prio, conf, count(*) AS shared_by FROM placed GROUP BY ALL),
    prim AS (SELECT component, scope, key, reason, conf FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY shared_by <= 1, prio, conf DESC, key) AS n FROM keyed) WHERE n = 1),
    met AS (SELECT component, count(DISTINCT session_ref) AS s, count(DISTINCT platform) AS p, bool_or(root IS NOT NULL) AS r FROM placed GROUP BY 1),
    proj AS (SELECT component, 'project-' || left(sha1(key), 12) AS project_id, reason, s, p,
        CASE WHEN scope = 'committed' OR (reason = 'workspace_path_continuity' AND s >= 2) THEN 'committed' ELSE 'candidate' END AS linkage_state,
        round(CASE WHEN scope = 'committed' THEN conf
             WHEN reason = 'workspace_path_continuity' THEN least(0.88, 0.68 + CASE WHEN s >= 2 THEN 0.12 ELSE 0 END + CASE WHEN s >= 3 THEN 0.05 ELSE 0 END + CASE WHEN p >= 2 THEN 0.03 ELSE 0 END + CASE WHEN r THEN 0.03 ELSE 0 END)
             WHEN reason = 'source_native_project' THEN least(0.87, 0.72 + CASE WHEN s >= 2 THEN 0.08 ELSE 0 END + CASE WHEN s >= 3 THEN 0.04 ELSE 0 END + CASE WHEN p >= 2 THEN 0.03 ELSE 0 END)
             WHEN reason = 'metadata_hint' THEN least(0.78, 0.6 + CASE WHEN s >= 2 THEN 0.08 ELSE 0 END + CASE WHEN p >= 2 THEN 0.04 ELSE 0 END)
             ELSE least(0.6, 0.42 + CASE WHEN s >= 2 THEN 0.08 ELSE 0 END + CASE WHEN s >= 3 THEN 0.04 ELSE 0 END + CASE WHEN p >= 2 THEN 0.03 ELSE 0 END) END::DOUBLE, 2) AS confidence
      FROM prim JOIN met USING (component)),
    member AS (SELECT DISTINCT observation_id, session_ref, observed_at, page_id, platform, host_id, workspace, root, remote, fingerprint, native, subpath, component FROM placed)"""
COMPONENTS_WITH = "WITH RECURSIVE " + COMPONENTS

TURNS = f"""pt AS (SELECT 't:' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS turn_id, 'sess:web:' || (page_id // 3) AS session_ref, page_id,
        strftime(epoch_ms(1704067200000 + page_id * 60000), {ISO}) AS submission_started_at,
        strftime(epoch_ms(1704067200000 + page_id * 60000 + (page_id % 3 - 1) * 90000), {ISO}) AS active_at FROM pages),
    seen AS (SELECT m.session_ref, m.observed_at, m.observation_id, p.project_id, p.linkage_state, p.confidence FROM member m JOIN proj p USING (component)),
    before AS (SELECT t.turn_id, arg_max(s.project_id, (s.observed_at, s.observation_id)) AS pid FROM pt t JOIN seen s ON s.session_ref = t.session_ref AND s.observed_at <= t.active_at GROUP BY 1),
    earliest AS (SELECT session_ref, arg_min(project_id, (observed_at, observation_id)) AS pid FROM seen GROUP BY 1),
    linked AS (SELECT t.*, coalesce(b.pid, e.pid) AS project_id FROM pt t LEFT JOIN before b USING (turn_id) LEFT JOIN earliest e USING (session_ref)),
    lt AS (SELECT l.*, coalesce(p.linkage_state, 'unlinked') AS link_state, p.confidence AS project_confidence FROM linked l LEFT JOIN proj p USING (project_id))"""


def hydrated(spark, sf_dir):
    return project_ops.hydrate_observations(bridge.page_observations(spark, sf_dir), bridge.page_sessions(spark, sf_dir))


def components(spark, sf_dir):
    observations = materialize(hydrated(spark, sf_dir), "observations")
    return materialize(project_ops.link_components(project_ops.classify(observations)), "components")


def snapshot(spark, sf_dir, overrides=None):
    return project_ops.link_snapshot(
        bridge.page_sessions(spark, sf_dir), bridge.page_turns(spark, sf_dir), bridge.page_observations(spark, sf_dir), overrides
    )


@query(
    "hydrate_observations",
    f"""WITH {OBSERVATIONS} SELECT observation_id, session_ref, host_id, workspace AS workspace_path_normalized, root AS repo_root, remote AS repo_remote,
        fingerprint AS repo_fingerprint, native AS source_native_project_ref, subpath AS workspace_subpath FROM h""",
)
def hydrate_observations(spark, sf_dir):
    return hydrated(spark, sf_dir).select(
        "observation_id",
        "session_ref",
        "host_id",
        "workspace_path_normalized",
        "repo_root",
        "repo_remote",
        "repo_fingerprint",
        "source_native_project_ref",
        "workspace_subpath",
    )


@query("link_rules", f"WITH {OBSERVATIONS} SELECT observation_id, scope AS linkage_scope, reason, CAST(conf AS DOUBLE) AS confidence, key FROM rules")
def link_rules(spark, sf_dir):
    rules = project_ops.link_rules(hydrated(spark, sf_dir))
    return rules.select("observation_id", "linkage_scope", "reason", "confidence", "key")


@query("link_components", f"{COMPONENTS_WITH} SELECT observation_id, component FROM member")
def link_components(spark, sf_dir):
    return components(spark, sf_dir).select("observation_id", "component")


@query(
    "primary_rule",
    f"{COMPONENTS_WITH} SELECT component, reason, key, 'project-' || left(sha1(key), 12) AS project_id FROM prim",
)
def primary_rule(spark, sf_dir):
    return project_ops.primary_rule(components(spark, sf_dir)).select("component", "reason", "key", "project_id")


@query("project_confidence", f"{COMPONENTS_WITH} SELECT project_id, reason, linkage_state, confidence FROM proj")
def project_confidence(spark, sf_dir):
    found = components(spark, sf_dir)
    return project_ops.project_confidence(found, project_ops.primary_rule(found)).select("project_id", "reason", "linkage_state", "confidence")


def _common(column: str) -> str:
    return f"""(SELECT {column} FROM member m WHERE m.component = p.component AND {column} IS NOT NULL GROUP BY {column}
               ORDER BY count(*) DESC, min((observed_at, observation_id)) LIMIT 1)"""


@query(
    "project_identity",
    f"""{COMPONENTS_WITH},
    ids AS (SELECT p.*, {_common('workspace')} AS workspace, {_common('root')} AS root, {_common('remote')} AS remote, {_common('native')} AS native, {_common('subpath')} AS sub,
               (SELECT min(observed_at) FROM member m WHERE m.component = p.component) AS created_at, (SELECT max(observed_at) FROM member m WHERE m.component = p.component) AS updated_at,
               (SELECT string_agg(DISTINCT host_id, ',' ORDER BY host_id) FROM member m WHERE m.component = p.component) AS hosts FROM proj p),
    named AS (SELECT *, CASE WHEN workspace IS NOT NULL THEN coalesce(nullif(list_last(string_split(workspace, '/')), ''), workspace)
                    ELSE coalesce(list_last(string_split(rtrim(remote, '/'), '/')), native, 'project') END AS display_name FROM ids)
    SELECT project_id, display_name, coalesce(nullif(regexp_replace(regexp_replace(lower(display_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'project') || '-' || right(project_id, 6) AS slug,
           workspace AS primary_workspace_path, root AS repo_root, remote AS repo_remote, native AS source_native_project_ref, created_at, updated_at, hosts AS host_ids FROM named""",
)
def project_identity(spark, sf_dir):
    found = components(spark, sf_dir)
    confidence = project_ops.project_confidence(found, project_ops.primary_rule(found))
    identity = project_ops.project_identity(found, confidence)
    return identity.select(
        "project_id",
        "display_name",
        "slug",
        "primary_workspace_path",
        "repo_root",
        "repo_remote",
        "source_native_project_ref",
        "created_at",
        "updated_at",
        F.array_join("host_ids", ",").alias("host_ids"),
    )


@query(
    "link_turns",
    f"""{COMPONENTS_WITH}, {TURNS},
    opt AS (SELECT session_ref, string_agg(DISTINCT project_id, ',' ORDER BY project_id) AS options FROM seen GROUP BY 1)
    SELECT turn_id, project_id, link_state, project_confidence, CASE WHEN link_state = 'candidate' THEN options END AS candidate_project_ids FROM lt LEFT JOIN opt USING (session_ref)""",
)
def link_turns(spark, sf_dir):
    turns = snapshot(spark, sf_dir)["turns"]
    return turns.select(
        "turn_id", "project_id", "link_state", "project_confidence", F.array_join("candidate_project_ids", ",").alias("candidate_project_ids")
    )


@query(
    "project_counts",
    f"""{COMPONENTS_WITH}, {TURNS}
    SELECT project_id, count(*) FILTER (link_state = 'committed') AS committed_turn_count, count(*) FILTER (link_state = 'candidate') AS candidate_turn_count,
           count(DISTINCT session_ref) AS session_count, max(active_at) AS last_activity_at FROM lt WHERE project_id IS NOT NULL GROUP BY 1""",
)
def project_counts(spark, sf_dir):
    return project_ops.project_counts(snapshot(spark, sf_dir)["turns"])


@query(
    "session_primary_project",
    f"""{COMPONENTS_WITH}, {TURNS}
    SELECT session_ref, arg_min(project_id, (link_state <> 'committed', -page_id * 60000 - (page_id % 3 - 1) * 90000, turn_id)) AS primary_project_id FROM lt WHERE project_id IS NOT NULL GROUP BY 1""",
)
def session_primary_project(spark, sf_dir):
    return project_ops.session_primary_project(snapshot(spark, sf_dir)["turns"])


@query(
    "linking_review",
    f"""{COMPONENTS_WITH}, {TURNS}
    SELECT linkage_state || '_projects' AS list, project_id AS id FROM proj UNION ALL SELECT link_state || '_turns', turn_id FROM lt WHERE link_state <> 'committed'""",
)
def linking_review(spark, sf_dir):
    state = snapshot(spark, sf_dir)
    lists = project_ops.linking_review(state["projects"], state["turns"])
    rows = [df.select(F.lit(name).alias("list"), F.col("project_id" if "projects" in name else "turn_id").alias("id")) for name, df in lists.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def _overrides(spark, sf_dir):
    """Overrides drawn from the pages: some turns, some sessions and some observations go to named projects."""
    pages = bridge.table(spark, sf_dir, "pages").select("page_id").where(F.col("page_id") % 10 < 3)
    page = F.col("page_id")
    number = F.lpad(page.cast("string"), 9, "0")
    kind = F.when(page % 10 == 0, "turn").when(page % 10 == 1, "session").otherwise("observation")
    ref = (
        F.when(page % 10 == 0, F.concat(F.lit("t:"), number))
        .when(page % 10 == 1, F.concat(F.lit("sess:web:"), F.floor(page / 3)))
        .otherwise(F.concat(F.lit("o:"), number))
    )
    return pages.select(
        kind.alias("target_kind"),
        ref.alias("target_ref"),
        F.concat(F.lit("project-hand-"), page % 4).alias("project_id"),
        F.concat(F.lit("By Hand "), page % 4).alias("display_name"),
        bridge.minutes_after_start(page).alias("created_at"),
        bridge.minutes_after_start(page).alias("updated_at"),
    )


@query(
    "apply_overrides",
    f"""{COMPONENTS_WITH}, {TURNS},
    o AS (SELECT page_id % 10 AS kind, page_id, page_id // 3 AS number, 'project-hand-' || (page_id % 4) AS pid FROM pages WHERE page_id % 10 < 3),
    seen2 AS (SELECT h.session_ref, h.observed_at, h.observation_id, coalesce(a.pid, b.pid, s.project_id) AS pid FROM h
        LEFT JOIN o a ON a.kind = 2 AND a.page_id = h.page_id LEFT JOIN o b ON b.kind = 1 AND b.number = h.number LEFT JOIN seen s ON s.observation_id = h.observation_id),
    before2 AS (SELECT t.turn_id, arg_max(s.pid, (s.observed_at, s.observation_id)) AS pid FROM pt t JOIN seen2 s ON s.session_ref = t.session_ref AND s.observed_at <= t.active_at WHERE s.pid IS NOT NULL GROUP BY 1),
    earliest2 AS (SELECT session_ref, arg_min(pid, (observed_at, observation_id)) AS pid FROM seen2 WHERE pid IS NOT NULL GROUP BY 1)
    SELECT t.turn_id, coalesce(x.pid, y.pid, b.pid, e.pid) AS project_id,
           CASE WHEN coalesce(x.pid, y.pid) IS NOT NULL OR starts_with(coalesce(b.pid, e.pid), 'project-hand') THEN 'committed' ELSE coalesce(p.linkage_state, 'unlinked') END AS link_state
    FROM pt t LEFT JOIN o x ON x.kind = 0 AND x.page_id = t.page_id LEFT JOIN o y ON y.kind = 1 AND y.number = t.page_id // 3
    LEFT JOIN before2 b USING (turn_id) LEFT JOIN earliest2 e USING (session_ref) LEFT JOIN proj p ON p.project_id = coalesce(b.pid, e.pid)""",
)
def apply_overrides(spark, sf_dir):
    return snapshot(spark, sf_dir, _overrides(spark, sf_dir))["turns"].select("turn_id", "project_id", "link_state")


@query(
    "linked_path_text",
    f"""{COMPONENTS_WITH}, {TURNS},
    w AS (SELECT p.project_id, {_common('workspace')} AS workspace, {_common('root')} AS root, {_common('native')} AS native FROM proj p),
    parts AS (SELECT turn_id, list_filter(['src/' || (page_id % 10), CAST(page_id % 10 AS VARCHAR),
                CASE WHEN (page_id // 3) % 4 = 0 THEN '/home/u' || ((page_id // 3) % 5) END, CASE WHEN (page_id // 3) % 4 = 0 THEN 'u' || ((page_id // 3) % 5) END,
                workspace, nullif(list_last(string_split(workspace, '/')), ''), root, nullif(list_last(string_split(root, '/')), ''), native], lambda x: x IS NOT NULL) AS all_parts
              FROM lt LEFT JOIN w USING (project_id))
    SELECT turn_id, array_to_string(list_filter(all_parts, lambda x, i: list_position(all_parts, x) = i), ' ') AS path_text FROM parts""",
)
def linked_path_text(spark, sf_dir):
    return snapshot(spark, sf_dir)["turns"].select("turn_id", "path_text")


# --- relations -------------------------------------------------------------------------------------------------------

EDGES = f"""{SESSIONS},
    ev AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, {ISO}) AS iso FROM events),
    kinds AS (SELECT *, event_type = 'signup' OR (event_type = 'view' AND k % 5 = 0) AS delegates, event_type = 'purchase' OR (event_type = 'click' AND k % 5 = 1) AS runs FROM ev),
    edge AS (SELECT 'f:' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS fragment_id, 'sess:ev:' || user_id AS session_ref, iso AS time_key,
        CASE WHEN delegates THEN 'delegated_session' ELSE 'automation_run' END AS relation_kind,
        CASE WHEN delegates THEN CAST(k * 2 AS VARCHAR) WHEN k % 6 = 0 THEN CAST(k % 20 AS VARCHAR) END AS parent_ref,
        delegates AND value > 100 AS is_sidechain,
        CASE WHEN delegates AND k % 2 = 0 THEN 'agent-' || (k % 5) END AS agent, CASE WHEN delegates AND k % 3 = 0 THEN 'done' END AS status,
        CASE WHEN runs THEN 'job-' || k END AS job, CASE WHEN runs AND k % 4 = 0 THEN 'run-' || (k % 8) END AS run
      FROM kinds WHERE delegates OR runs),
    -- the references are bare user ids, which are unique aliases over all sessions
    ends AS (SELECT e.*, s.session_ref AS parent_session, s.title AS parent_title, own.source_id, own.source_platform, own.title AS own_title
             FROM edge e JOIN sess own USING (session_ref) LEFT JOIN sess s ON s.session_ref = 'sess:ev:' || e.parent_ref),
    del AS (SELECT *, coalesce(parent_session, parent_ref) AS p FROM ends WHERE relation_kind = 'delegated_session'),
    aut AS (SELECT *, coalesce(parent_session, parent_ref, session_ref) AS owner FROM ends WHERE relation_kind = 'automation_run'),
    rel AS (
      SELECT session_ref AS viewpoint, 'inbound' AS direction, 'delegated:' || p || ':' || session_ref || ':' || coalesce(agent, '') || ':inbound' AS key, p AS target, CASE WHEN is_sidechain THEN 0.95 ELSE 0.8 END AS conf,
             parent_title AS title, relation_kind, fragment_id, time_key, status FROM del
      UNION ALL SELECT parent_session, 'outbound', 'delegated:' || p || ':' || session_ref || ':' || coalesce(agent, '') || ':outbound', session_ref, CASE WHEN is_sidechain THEN 0.95 ELSE 0.8 END,
             own_title, relation_kind, fragment_id, time_key, status FROM del WHERE parent_session IS NOT NULL AND parent_session <> session_ref
      UNION ALL SELECT session_ref, 'self', 'automation:' || owner || ':' || session_ref || ':' || job || ':' || coalesce(run, fragment_id) || ':self', owner, 0.95, own_title, relation_kind, fragment_id, time_key, status FROM aut
      UNION ALL SELECT parent_session, 'outbound', 'automation:' || owner || ':' || session_ref || ':' || job || ':' || coalesce(run, fragment_id) || ':outbound', owner, 0.95, own_title, relation_kind, fragment_id, time_key, status
             FROM aut WHERE parent_session IS NOT NULL AND parent_session <> session_ref),
    r AS (SELECT 'session-related-work-' || regexp_replace(viewpoint || '-' || key, '[^a-zA-Z0-9._-]+', '-', 'g') AS id, * FROM rel)"""


def edges(spark, sf_dir):
    return relations.relation_edges(bridge.relation_fragments(spark, sf_dir), bridge.usage_sessions(spark, sf_dir))


@query(
    "relation_edges",
    f"WITH {EDGES} SELECT fragment_id, session_ref, relation_kind, parent_ref, is_sidechain, agent AS child_agent_key, job AS job_id, run AS session_key, status FROM edge",
)
def relation_edges(spark, sf_dir):
    return edges(spark, sf_dir).select(
        "fragment_id", "session_ref", "relation_kind", "parent_ref", "is_sidechain", "child_agent_key", "job_id", "session_key", "status"
    )


@query(
    "resolve_session_refs",
    f"""WITH {SESSIONS}, alias AS (SELECT session_ref, source_id, source_platform, unnest([session_ref, 'shared-' || (user_id % 40), CAST(user_id AS VARCHAR)]) AS ref FROM sess),
    ask AS (SELECT DISTINCT a.ref, s.source_id, s.source_platform FROM alias a, (SELECT DISTINCT source_id, source_platform FROM sess) s)
    SELECT ref, source_id, source_platform, coalesce(
      (SELECT CASE WHEN count(*) = 1 THEN min(session_ref) END FROM alias x WHERE x.ref = a.ref AND x.source_id = a.source_id),
      (SELECT CASE WHEN count(*) = 1 THEN min(session_ref) END FROM alias x WHERE x.ref = a.ref AND x.source_platform = a.source_platform),
      (SELECT CASE WHEN count(*) = 1 THEN min(session_ref) END FROM alias x WHERE x.ref = a.ref)) AS resolved FROM ask a""",
)
def resolve_session_refs(spark, sf_dir):
    sessions = bridge.usage_sessions(spark, sf_dir)
    user = F.substring("session_ref", 9, 9).cast("int")
    shared = sessions.withColumn("source_session_id", F.concat(F.lit("shared-"), user % 40))
    bare = F.regexp_replace("session_ref", "^sess:[^:]+:", "")
    aliases = shared.select(F.explode(F.array("session_ref", "source_session_id", bare)).alias("ref")).distinct()
    scopes = shared.groupBy("source_id", "source_platform").agg(F.first(F.lit(True)).alias("_"))
    # Every alias is asked from every kind of source: four kinds, attached as an array rather than by a join.
    kinds = [("view", "codex"), ("view", "claude_code"), ("click", "codex"), ("click", "claude_code")]
    asked = aliases.select(
        "ref", F.inline(F.array(*[F.struct(F.lit(s).alias("source_id"), F.lit(p).alias("source_platform")) for s, p in kinds]))
    ).join(scopes.drop("_"), ["source_id", "source_platform"], "left_semi")
    return relations.resolve_session_refs(asked, shared)


@query(
    "related_work",
    f"WITH {EDGES} SELECT id, viewpoint AS query_session_ref, direction, relation_kind, target AS target_session_ref, CAST(conf AS DOUBLE) AS evidence_confidence, title, fragment_id FROM r",
)
def related_work(spark, sf_dir):
    rows = relations.related_work(edges(spark, sf_dir), bridge.usage_sessions(spark, sf_dir))
    return rows.select("id", "query_session_ref", "direction", "relation_kind", "target_session_ref", "evidence_confidence", "title", "fragment_id")


@query(
    "merge_related",
    f"""WITH {EDGES} SELECT id, any_value(viewpoint) AS query_session_ref, min(time_key) AS created_at, max(time_key) AS updated_at, count(DISTINCT fragment_id) AS fragment_count,
        arg_max(status, (time_key, fragment_id)) FILTER (status IS NOT NULL) AS status FROM r GROUP BY id""",
)
def merge_related(spark, sf_dir):
    rows = relations.related_work(edges(spark, sf_dir), bridge.usage_sessions(spark, sf_dir))
    merged = relations.merge_related(rows)
    return merged.select("id", "query_session_ref", "created_at", "updated_at", "fragment_count", "status")
