"""Several reads over one snapshot, given as an ordered list of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators import reads, search


def last_folder(path: Column) -> Column:
    """Name of the last folder of a path."""
    return F.element_at(F.split(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]"), -1)


def _entities(tables: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, list[str], list[str]]]:
    """By kind of reference: the entities with their ids, the aliases they answer to, and those that may be shortened."""
    found = {
        "session": (
            tables["sessions"].withColumns({"id": F.col("session_ref"), "folder": last_folder(F.col("working_directory"))}),
            ["source_session_id", "title", "working_directory", "folder"],
            ["source_session_id"],
        ),
        "turn": (tables["turns"].withColumn("id", F.col("turn_id")), [], []),
    }
    if "projects" in tables:
        named = tables["projects"].withColumns({"id": F.col("project_id"), "folder": last_folder(F.col("primary_workspace_path"))})
        found["project"] = named, ["slug", "display_name", "primary_workspace_path", "folder"], []
    return found


def _references(op: dict) -> list[tuple[str, str]]:
    """(kind, reference) of everything an operation refers to."""
    kind = op["kind"]
    if kind == "search":
        return [("project", op["project"])] if op.get("project") is not None else []
    if kind == "replies":
        return [("turn", ref) for ref in op["turn_refs"]]
    if kind in ("session", "project"):
        return [(kind, ref) for ref in op["refs"]]
    raise ValueError(f"unknown operation {kind}")


def run_batch(operations: list[dict], tables: dict[str, DataFrame], now_ms: int) -> list[dict]:
    """Results in request order: ``{id, kind, ok, rows | error}``; a reference that does not resolve fails its operation only.

    Operations are ``search`` (query, limit, offset, project, filters), ``session`` and ``project`` (refs, limit, offset)
    and ``replies`` (turn_refs). A session answers to its id, its native id or a beginning of it, its title, its directory
    and that directory's name; a project to its id, slug, name, directory and that directory's name. All references of
    the request are resolved in one job per kind; only those, bounded by the request, reach the driver.
    """
    spark = tables["turns"].sparkSession
    entities = _entities(tables)
    asked: dict[str, list[str]] = {}
    for op in operations:
        try:
            for kind, ref in _references(op):
                asked.setdefault(kind, []).append(ref)
        except (KeyError, ValueError):
            continue  # told where the operation runs
    known = {}
    for kind, refs in asked.items():
        if kind in entities:
            rows = spark.createDataFrame([(r,) for r in dict.fromkeys(refs)], "ref string")
            known |= {(kind, r.ref): (r.id, r.status) for r in reads.resolve_refs(rows, *entities[kind]).collect()}

    def run(op: dict) -> dict:
        refs = _references(op)
        bad = [f"{ref}: {known.get((kind, ref), (None, 'not_found'))[1]}" for kind, ref in refs if not known.get((kind, ref), (None, ""))[0]]
        if bad:
            raise LookupError("; ".join(bad))
        found = [known[ref][0] for ref in refs]
        start, limit = op.get("offset", 0), op.get("limit", 50)
        if op["kind"] == "search":
            filters = dict(op.get("filters", {})) | ({"project_id": found[0]} if found else {})
            page, total = search.search(search.search_candidates(tables["turns"]), op.get("query", ""), now_ms, limit, start, **filters)
            return {"rows": page, "total": total}
        if op["kind"] == "replies":
            return {"rows": tables["replies"].where(F.col("turn_id").isin(found)).orderBy("turn_id", "pos")}
        key, order = ("session_ref", reads.turn_chronology()) if op["kind"] == "session" else ("project_id", reads.turn_recency())
        return {"rows": tables["turns"].where(F.col(key).isin(found)).orderBy(*order).offset(start).limit(limit)}

    results = []
    for op in operations:
        try:
            results.append({"id": op["id"], "kind": op["kind"], "ok": True, **run(op)})
        except (LookupError, KeyError, ValueError) as error:
            results.append({"id": op["id"], "kind": op["kind"], "ok": False, "error": str(error)})
    return results
