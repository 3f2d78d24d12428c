"""Prompts that say again what the last kept prompt said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import timekeys
from turnwise.functions.bind import bind
from turnwise.functions.ordered import last_value, position_chunk, running_sum, with_position, with_running
from turnwise.session import discard, materialize

SESSION = ["source_id", "session_ref"]
# Words that do not count when two prompts are compared, and the longest time between two variants.
COMMON_WORDS = ("the", "and", "for", "with", "from", "that", "this", "into", "onto", "about", "following", "established", "project")
VARIANT_GAP_MS = 10 * 60 * 1000
# A text this long counts as said again inside a longer one; stems shared, and their share of either side's.
INSIDE_LENGTH, SHARED_STEMS, SHARE_OF_FEWER, SHARE_OF_MORE = 24, 4, 0.6, 0.45
#: Prompts of a chain that are gone through at once.
CHUNK_PROMPTS = 256

PROMPT = "struct<atom_id:string,plain:string,stems:array<string>,ms:bigint>"


def plain_prompt(text: Column) -> Column:
    """Lower-case words of a prompt, one blank between them, without emphasis and code marks."""
    bare = F.regexp_replace(F.lower(text), r"\*\*|`", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def word_stems(plain: Column) -> Column:
    """Distinct stems of the words that count: English plurals as singulars, no very short and no common words."""

    def stem(word: Column) -> Column:
        long = F.length(word) > 4
        singular = (
            F.when(long & word.endswith("ies"), F.concat(word.substr(F.lit(1), F.length(word) - 3), F.lit("y")))
            .when(long & word.endswith("s") & ~word.endswith("ss"), word.substr(F.lit(1), F.length(word) - 1))
            .otherwise(word)
        )
        least = F.when(word.rlike(r"^[\x00-\x7F]*$"), 3).otherwise(2)
        return F.when(word.rlike("^[a-z]{3,}$"), singular).when(F.length(word) >= least, word)

    return F.array_distinct(F.filter(F.transform(F.split(plain, " "), stem), lambda s: s.isNotNull() & ~s.isin(*COMMON_WORDS)))


def prompts_alike(a: Column, b: Column) -> Column:
    """Two prompts (plain, stems) say nearly the same: equal, one inside the other, or enough shared stems."""
    shorter, longer = F.when(F.length(a["plain"]) < F.length(b["plain"]), a["plain"]).otherwise(b["plain"]), F.when(F.length(a["plain"]) < F.length(b["plain"]), b["plain"]).otherwise(a["plain"])
    inside = (F.length(shorter) >= INSIDE_LENGTH) & F.contains(longer, shorter)
    fewer, more = F.least(F.size(a["stems"]), F.size(b["stems"])), F.greatest(F.size(a["stems"]), F.size(b["stems"]))
    shared = bind(F.size(F.array_intersect(a["stems"], b["stems"])), lambda n: (n >= SHARED_STEMS) & (n >= SHARE_OF_FEWER * fewer) & (n >= SHARE_OF_MORE * more))
    said = (F.length(a["plain"]) > 0) & (F.length(b["plain"]) > 0)
    return F.coalesce(said & ((a["plain"] == b["plain"]) | inside | shared), F.lit(False))


def _gone_through(prompts: Column, entry: Column) -> Column:
    """(kept, dropped): the prompt kept last behind a chunk that was entered with ``entry``, and the ids it drops."""

    def step(state: Column, prompt: Column) -> Column:
        near = F.coalesce(F.abs(prompt["ms"] - state["kept"]["ms"]) <= VARIANT_GAP_MS, F.lit(False))
        drop = near & prompts_alike(state["kept"], prompt)
        dropped = F.when(drop, F.concat(state["dropped"], F.array(prompt["atom_id"]))).otherwise(state["dropped"])
        return F.struct(F.when(drop, state["kept"]).otherwise(prompt).alias("kept"), dropped.alias("dropped")).cast(f"struct<kept:{PROMPT},dropped:array<string>>")

    start = F.struct(entry.cast(PROMPT).alias("kept"), F.array().cast("array<string>").alias("dropped")).cast(f"struct<kept:{PROMPT},dropped:array<string>>")
    return F.aggregate(prompts, start, step)


def dropped_variants(prompts: DataFrame, chain: list[str]) -> DataFrame:
    """(atom_id) of prompts that repeat the last kept one of their chain.

    ``prompts`` has the chain's columns, place (dense from 0), atom_id, text and ms. Whether a prompt is kept depends on
    the one kept last, so a chain has an order; but all that one chunk of it hands to the next is that prompt. Chunks are
    gone through at once, as if nothing came before them, and then again as long as the chunk before hands on something
    else than was assumed. Few do, since a prompt that is like nothing shortly before it is kept whatever came before.
    """
    plain = F.coalesce(plain_prompt(F.col("text")), F.lit(""))
    compared = prompts.select(*chain, "place", "atom_id", "ms", plain.alias("plain")).withColumn("stems", word_stems(F.col("plain")))
    prompt = F.struct("atom_id", "plain", "stems", F.col("ms").cast("bigint").alias("ms")).cast(PROMPT)
    key = [*chain, "chunk"]
    gathered = compared.groupBy(*chain, F.floor(F.col("place") / CHUNK_PROMPTS).cast("bigint").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("place", prompt.alias("p")))).alias("rows"))
    chunks = materialize(gathered.select(*key, F.transform("rows", lambda r: r["p"]).alias("prompts")), "prompt-chunks")
    told = lambda rows: rows.select(*key, F.col("entry.atom_id").alias("entered"), _gone_through(F.col("prompts"), F.col("entry")).alias("s")).select(*key, "entered", "s.*")
    state = materialize(told(chunks.withColumn("entry", F.lit(None).cast(PROMPT))), "prompt-states")
    while True:
        handed = state.select(*chain, (F.col("chunk") + 1).alias("chunk"), F.col("kept").alias("entry"))
        stale = state.join(handed, key).filter(~F.col("entered").eqNullSafe(F.col("entry.atom_id"))).select(*key, "entry")
        stale = materialize(stale, "stale-chunks")
        if stale.isEmpty():
            return state.select(F.explode("dropped").alias("atom_id"))
        again = materialize(state.join(stale, key, "left_anti").unionByName(told(chunks.join(stale, key))), "prompt-states")
        discard(state, stale)
        state = again


def collapse_prompt_variants(atoms: DataFrame) -> DataFrame:
    """Drop user prompts that repeat the last kept prompt within ten minutes with no assistant text between.

    A chain of prompts ends at an assistant text and at a pause of more than ten minutes.
    """
    reply = (F.col("actor_kind") == "assistant") & (F.col("content_kind") == "text") & (F.col("display_policy") != "hide")
    prompt = (
        (F.col("actor_kind") == "user")
        & (F.col("content_kind") == "text")
        & F.col("origin_kind").isin("user_authored", "injected_user_shaped")
    )
    marked = atoms.where(reply | prompt).select(*SESSION, "pos", "atom_id", "time_key", "text", prompt.alias("is_prompt"))
    millis = timekeys.millis(F.col("time_key"))
    at = F.when(F.col("is_prompt"), F.struct(F.coalesce(millis, F.lit(-1)).alias("ms")))
    chunk = [position_chunk("pos")]
    runs = with_running(
        marked, SESSION, ["pos"], chunk, replies=running_sum(F.when(F.col("is_prompt"), 0).otherwise(1)), before=last_value(at, inclusive=False)
    ).where("is_prompt")
    paused = F.coalesce(F.abs(millis - F.col("before.ms")) > VARIANT_GAP_MS, F.lit(True))
    timed = runs.withColumn("ms", millis).withColumn("paused", paused.cast("int")).drop("before")
    islands = with_running(timed, SESSION, ["pos"], chunk, island=running_sum(F.col("paused")))
    chain = [*SESSION, "replies", "island"]
    placed = with_position(islands.select(*chain, "pos", "atom_id", "text", "ms"), chain, ["pos"], "place")
    return atoms.join(dropped_variants(placed, chain), "atom_id", "left_anti").select(*atoms.columns)
