"""Path and remote identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.bind import bind
from turnwise.functions.text import optional


def decode_percent(text: Column) -> Column:
    """Percent-decoding where an escape occurs; ``+`` stays, undecodable text stays."""
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(text.rlike("(?i)%[0-9a-f]{2}"), F.coalesce(decoded, text)).otherwise(text)


def _resolve_dots(path: Column) -> Column:
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(acc: Column, part: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        pop = (F.size(acc) > 0) & (last != "..")
        return (
            F.when(part != "..", F.concat(acc, F.array(part)))
            .when(F.coalesce(pop, F.lit(False)), F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when(~absolute, F.concat(acc, F.array(F.lit(".."))))
            .otherwise(acc)
        )

    resolved = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    joined = F.concat(F.when(absolute, "/").otherwise(""), resolved)
    return F.when(joined == "", F.when(absolute, "/").otherwise(".")).otherwise(joined)


def _posix(path: Column) -> Column:
    return bind(
        F.regexp_replace(path, "/+", "/"),
        lambda plain: F.when((plain == "") | plain.rlike(r"(^|/)\.{1,2}(/|$)"), _resolve_dots(plain)).otherwise(plain),
    )


def _drop_trailing_slash(path: Column) -> Column:
    return bind(path, lambda p: F.when(p.isin("/", "//") | p.rlike("^[a-z]:/$"), p).otherwise(F.regexp_replace(p, "/+$", "")))


def _from_uri(raw: Column) -> Column:
    pattern = r"(?is)^file://([^/]*)(/.*)?$"
    authority, tail = F.regexp_extract(raw, pattern, 1), F.regexp_extract(raw, pattern, 2)
    return (
        F.when(~raw.rlike("(?i)^file://"), raw)
        .when(raw.rlike("(?i)^file://localhost/"), raw.substr(F.lit(17), F.length(raw)))
        .when(authority.rlike("^[A-Za-z]:$"), F.concat(authority, tail))
        .when(authority != "", F.concat(F.lit("//"), authority, tail))
        .otherwise(tail)
    )


def _spelled_out(raw: Column) -> Column:
    """Identity of a slash path that may be a UNC share, carry a drive letter, or neither."""
    flat = F.regexp_replace(raw, "/+", "/")
    share = raw.startswith("//") & ~raw.rlike("^//[A-Za-z]:")
    drive = flat.rlike("^[A-Za-z]:")
    head = F.when(share, "/").when(drive, F.concat(F.lower(F.substring(flat, 1, 1)), F.lit(":"))).otherwise("")
    body = (
        F.when(share, F.concat(F.lit("/"), raw.substr(F.lit(3), F.length(raw))))
        .when(drive, F.concat(F.lit("/"), flat.substr(F.lit(3), F.length(flat))))
        .otherwise(flat)
    )
    return F.concat(head, _drop_trailing_slash(_posix(body)))


# Most paths are already in their final spelling: absolute, no empty, dot or percent segments, no closing slash.
_CLEAN = r"^(/[^/\\%.:\s][^/\\%:\s]*)+$"


def path_identity(value: Column) -> Column:
    """One spelling per local path: file URIs, drive letters, UNC shares, dots and slashes resolved."""

    def spell(given: Column) -> Column:
        slashed = F.translate(_from_uri(given), "\\", "/")
        return bind(
            bind(slashed, lambda p: F.when(p.rlike("^/[A-Za-z]:"), p.substr(F.lit(2), F.length(p))).otherwise(p)), _spelled_out
        )

    return F.when(value.rlike(_CLEAN), value).otherwise(bind(bind(optional(value), decode_percent), spell))


def basename(path: Column) -> Column:
    """Last non-empty segment of a slash path, null if there is none."""
    return F.try_element_at(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(-1))


def scope_match(candidate: Column, scope: str | Column, fold_case: bool = False) -> Column:
    """True where the candidate directory is the scope or lies below it (by whole segments)."""
    root_of = path_identity(F.lit(scope) if isinstance(scope, str) else scope)

    def below(pair: Column) -> Column:
        path, root = pair.getField("path"), pair.getField("root")
        inside = (
            F.when(root == "/", path.startswith("/"))
            .when(root.rlike("^[a-z]:/$"), path.startswith(root))
            .otherwise(path.startswith(F.concat(root, F.lit("/"))))
        )
        return F.coalesce((path == root) | inside, F.lit(False))

    fold = F.lower if fold_case else (lambda c: c)
    return bind(F.struct(fold(path_identity(candidate)).alias("path"), fold(root_of).alias("root")), below)


def normalize_remote(value: Column) -> Column:
    """Repository remote without ``.git`` and trailing slashes; scp spelling becomes an ssh URL."""
    bare = F.regexp_replace(F.regexp_replace(optional(value), r"(?i)\.git$", ""), "/+$", "")
    return F.when(bare.rlike(r"^[^@]+@[^:]+:.+"), F.regexp_replace(bare, r"^([^@]+@[^:]+):", "ssh://$1/")).otherwise(bare)


def remote_fingerprint(remote: Column) -> Column:
    return F.sha1(F.concat(F.lit("repo-remote:"), remote))


def path_parts(value: Column) -> Column:
    """The path with forward slashes and its last segment, as an array (empty for no path)."""
    path = optional(F.translate(value, "\\", "/"))
    return F.array_distinct(F.array_compact(F.array(path, basename(path))))


def native_project_ref(platform: Column, base_dir: Column, file_path: Column) -> Column:
    """Project folder named by a source's own directory layout."""

    def from_layout(given: Column) -> Column:
        base, full = given.getField("base"), given.getField("full")
        below = full.startswith(F.concat(base, F.lit("/")))
        relative = F.when(below, full.substr(F.length(base) + 2, F.length(full)))
        return bind(F.filter(F.split(relative, "/"), lambda p: p != ""), lambda parts: from_parts(parts, full))

    def from_parts(parts: Column, full: Column) -> Column:
        store = F.nullif(F.regexp_extract(full, r"/\.cursor/chats/([^/]+)/[^/]+/store\.db$", 1), F.lit(""))
        transcripts = F.array_position(parts, "agent-transcripts").cast("int")
        history = F.array_position(parts, "chat_history.jsonl").cast("int")
        first, deep = F.get(parts, F.lit(0)), F.size(parts) >= 3
        return (
            F.when(
                platform.isin("cursor", "cursor_agent"),
                F.coalesce(F.when(parts.isNotNull(), store), F.when(transcripts > 1, F.get(parts, transcripts - 2))),
            )
            .when((platform == "grok") & (history >= 3), F.get(parts, history - 3))
            .when((platform == "antigravity") & (first == "brain") & deep, F.get(parts, F.lit(1)))
            .when((platform == "codebuddy") & (first == "projects") & deep, F.get(parts, F.lit(1)))
        )

    base = F.regexp_replace(path_identity(base_dir), "^/$", "")
    return bind(F.struct(base.alias("base"), path_identity(file_path).alias("full")), from_layout)
