"""Joins and rules around an answering service: citations, boxes, permissions, broadcasts, tiers, retention, jobs, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Messages of a channel that go to a client together, as a mean; rows that a task makes of them, and tasks at most.
PACK, TASK_ROWS, MOST_TASKS = 128, 20_000_000, 10_000
#: Clients of a channel that get a pack together, as a mean, and rows that a task holds at a time.
GROUP, HELD = 1024, 1 << 17
#: Subscriptions that are broadcast.
BROADCAST_CLIENTS = 1_000_000

# citations and boxes


def cite(citations: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and doc_id: for each citation (keys, page, section), the document (doc_id, page, section) of its page.

    Of several, one whose section holds the cited one comes first, then the smaller id. A page's documents are few; citations of a page
    may be many, and meet them by the page.
    """
    d = docs.select(F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), F.coalesce("section", F.lit("")).alias("_section"))
    met = citations.join(d, F.col("page") == F.col("_page"))
    fits = F.coalesce((F.col("section") != "") & F.contains(F.col("_section"), F.col("section")), F.lit(False))
    best = F.min(F.struct((~fits).alias("not_fit"), F.col("_doc").alias("doc_id")))
    return met.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.doc_id")


def lines_of(words: DataFrame, page: str = "page", height: float = 8.0) -> DataFrame:
    """page, line, x, y, width, height, words: word boxes (page, x0, y0, x1, y1) whose tops round to one multiple of ``height`` as one box.

    Halves go to the even multiple. Lines without an area are left out.
    """
    line = F.rint(F.col("y0") / height) * height
    boxes = words.groupBy(page, line.alias("line")).agg(F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("_x1"), F.max("y1").alias("_y1"), F.count(F.lit(1)).alias("words"))
    return boxes.where("_x1 > x and _y1 > y").select(page, "line", "x", "y", (F.col("_x1") - F.col("x")).alias("width"), (F.col("_y1") - F.col("y")).alias("height"), "words")


def highlight_hits(found: DataFrame, keys: list[str], extracted: Column, expected: Column, least: float = 0.5) -> DataFrame:
    """keys, words, share, hit: whether more than ``least`` of the words, of three letters or more, read under a box occur in the text it stands for."""
    words = F.filter(F.split(F.trim(F.regexp_replace(extracted, r"\s+", " ")), " "), lambda w: F.length(w) > 2)
    there = F.lower(expected)
    held = F.size(F.filter(F.col("_w"), lambda w: F.contains(there, F.lower(w))))
    rows = found.withColumn("_w", F.coalesce(words, F.array().cast("array<string>")))
    share = F.when(F.size("_w") > 0, F.coalesce(held, F.lit(0)) / F.size("_w")).otherwise(F.lit(0.0))
    return rows.select(*keys, F.size("_w").alias("words"), F.round(share, 6).alias("share"), (share > least).alias("hit"))


# What marks a chunk as noise, and the beginning of references.
NOISE = ("index", "references", "bibliography", "doi:", "isbn")
REFERENCES = ("## references", "references\n---")


def tag_content(chunks: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """Adds is_reference, from the chunk on where references begin, and is_content, neither reference nor noise; a key is one document."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    within = lambda part, words: F.greatest(*[F.contains(part, F.lit(w)) for w in words])
    begins = within(F.substring(low, 1, 50), REFERENCES)
    noise = within(F.substring(low, 1, 100), NOISE) | (F.regexp_count(low, F.lit("doi:")) > 2) | (F.regexp_count(low, F.lit(",")) > 25)
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = chunks.withColumns({"_begins": begins, "_noise": noise}).withColumn("is_reference", F.max("_begins").over(upto))
    return marked.withColumn("is_content", ~(F.col("_noise") | F.col("is_reference"))).drop("_begins", "_noise")


# access


def permissions(users: DataFrame, roles: DataFrame, grants: DataFrame) -> DataFrame:
    """user_id, action, resource, resource_id: what each user's roles grant; an admin role grants all that any role has.

    users: user_id, role; roles: role, is_admin; grants: role, action, resource, resource_id (null: all of them).
    """
    held = users.join(roles, "role")
    some = held.where("not is_admin").join(grants, "role").select("user_id", "action", "resource", "resource_id")
    everything = grants.select("action", "resource", "resource_id").distinct().agg(F.collect_set(F.struct("action", "resource", "resource_id")).alias("_all"))  # kinds of grants
    all_ = held.where("is_admin").select("user_id").distinct().crossJoin(F.broadcast(everything)).select("user_id", F.explode("_all").alias("g")).select("user_id", "g.*")
    return some.unionByName(all_).distinct()


def check_access(requests: DataFrame, keys: list[str], users: DataFrame, memberships: DataFrame, roles: DataFrame, grants: DataFrame) -> DataFrame:
    """keys, allowed, reason of requests (keys, user_id, action, resource, resource_id); the reason is the first test that fails.

    users: user_id, is_active, is_locked; memberships: user_id, role.
    """
    known = users.select("user_id", "is_active", "is_locked", F.lit(True).alias("_known"))
    admins = memberships.join(roles.where("is_admin"), "role").select("user_id").distinct().withColumn("_admin", F.lit(True))
    rights = memberships.join(grants, "role").select("user_id", "action", "resource", F.col("resource_id").alias("_id")).distinct()
    rights = rights.withColumn("_held", F.lit(True))
    matches = F.col("_held") & (F.col("_id").isNull() | F.col("_id").eqNullSafe(F.col("resource_id")))
    asked = requests.join(known, "user_id", "left").join(admins, "user_id", "left").join(rights, ["user_id", "action", "resource"], "left")
    told = asked.groupBy(*keys).agg(F.max(F.coalesce("_known", F.lit(False))).alias("_known"), F.max("is_active").alias("_active"), F.max("is_locked").alias("_locked"), F.max(F.coalesce("_admin", F.lit(False)) | F.coalesce(matches, F.lit(False))).alias("_may"))
    reason = F.when(~F.col("_known"), "user_not_found").when(~F.coalesce("_active", F.lit(False)), "user_inactive").when(F.coalesce("_locked", F.lit(False)), "user_locked").when(~F.col("_may"), "no_permission")
    return told.select(*keys, reason.isNull().alias("allowed"), reason.alias("reason"))


def _dealt(values: pa.Array, deal: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    if pa.types.is_integer(values.type) and not values.null_count:
        return pa.array(deal(values.to_numpy()))
    return values.take(pa.array(deal(np.arange(len(values)))))


def broadcast_messages(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """message_id, client_id: every message (message_id, channel, sender) for each subscriber (client_id, channel) of its channel but its sender.

    The result has a row for each pair, so it grows with the product of both. Messages of a channel go in packs to groups of its clients, and each
    client gets a pack at a time: neighbouring rows then repeat ids of few messages, which columnar files hold in a fraction of a byte, and no row is
    shuffled once made. A task makes the rows of a pack and a group at a time, however many clients a channel has.
    """
    there = subscriptions.select("client_id", "channel").where("channel is not null").distinct()
    sizes = messages.groupBy("channel").agg(F.count(F.lit(1)).alias("_n"))  # a row a channel
    held = there.groupBy("channel").agg(F.count(F.lit(1)).alias("_k"))  # a row a channel
    clients, pairs = held.join(sizes, "channel", "left").agg(F.sum("_k"), F.coalesce(F.sum(F.col("_k") * F.col("_n")), F.lit(0))).first()
    part = lambda of, n, most: F.pmod(F.xxhash64(*of), F.ceil(F.col(n) / most)).cast("bigint")
    kind = dict(there.dtypes)["client_id"]
    packs = messages.join(sizes, "channel").groupBy("channel", part(("message_id", "sender"), "_n", PACK).alias("_pack")).agg(F.collect_list(F.struct("message_id", F.col("sender").cast(kind).alias("sender"))).alias("_m"))
    groups = there.join(held, "channel").groupBy("channel", part(("client_id",), "_k", GROUP).alias("_group")).agg(F.collect_list(F.struct("client_id")).alias("_c"))
    dealt = packs.repartition(int(min(MOST_TASKS, max(1, pairs // TASK_ROWS))), "channel", "_pack")
    met = dealt.join(F.broadcast(groups) if (clients or 0) <= BROADCAST_CLIENTS else groups, "channel").select("_m", "_c")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, c in zip(batch.column("_m"), batch.column("_c"), strict=True):
                ids, senders, to = (x.values.field(f) for x, f in ((m, "message_id"), (m, "sender"), (c, "client_id")))
                step = max(1, HELD // len(ids))
                for at in range(0, len(to), step):
                    some = to[at : at + step]
                    rows = pa.RecordBatch.from_arrays([_dealt(ids, lambda x: np.tile(x, len(some))), _dealt(some, lambda x: np.repeat(x, len(ids)))], ["message_id", "client_id"])  # noqa: B023
                    own = pc.index_in(senders, some)
                    if own.null_count < len(own):
                        sent = np.flatnonzero(own.is_valid().to_numpy(False))
                        keep = np.ones(rows.num_rows, bool)
                        keep[own.drop_null().to_numpy(False).astype(np.int64) * len(ids) + sent] = False
                        rows = rows.filter(pa.array(keep))
                    yield rows

    return met.mapInArrow(tell, f"message_id {dict(messages.dtypes)['message_id']}, client_id {kind}")


# tiers, retention, liveness


def tiered_lookup(asked: DataFrame, memory: DataFrame, similar: DataFrame, disk: DataFrame) -> DataFrame:
    """key, value, tier, promote: exact keys from memory, then from disk; keys asked by meaning from the table of similar answers only.

    asked: key, by_meaning; the tables: key, value. What comes from below memory is to be promoted to it.
    """
    named = lambda df, name: df.select("key", F.col("value").alias(name)).dropDuplicates(["key"])
    met = asked.join(named(memory, "_m"), "key", "left").join(named(similar, "_s"), "key", "left").join(named(disk, "_d"), "key", "left")
    exact = ~F.col("by_meaning")
    tier = F.when(exact & F.col("_m").isNotNull(), "memory").when(F.col("by_meaning") & F.col("_s").isNotNull(), "semantic").when(exact & F.col("_d").isNotNull(), "disk").otherwise("miss")
    value = F.when(F.col("tier") == "memory", F.col("_m")).when(F.col("tier") == "semantic", F.col("_s")).when(F.col("tier") == "disk", F.col("_d"))
    return met.withColumn("tier", tier).select("key", "by_meaning", value.alias("value"), "tier", F.col("tier").isin("semantic", "disk").alias("promote"))


def retention(records: DataFrame, artefacts: DataFrame, key: str, at: str, now: Column, days: int) -> DataFrame:
    """key, purge of both tables: records ``old``er than so many days, and artefacts that are ``old``, or ``orphan``, without a record that stays."""
    keep = records.where(F.col(at) >= now - F.make_dt_interval(F.lit(days)))
    old = records.where(F.col(at) < now - F.make_dt_interval(F.lit(days))).select(key, F.lit("record").alias("kind"), F.lit("old").alias("why"))
    lost = artefacts.join(keep.select(key).distinct(), key, "left_anti").join(records.select(key, F.lit(True).alias("_had")).distinct(), key, "left")
    return old.unionByName(lost.select(key, F.lit("artefact").alias("kind"), F.when(F.col("_had"), "old").otherwise("orphan").alias("why")))


def liveness(beats: DataFrame, key: str, at: str, now: Column, limits: dict[str, float]) -> DataFrame:
    """key, kind, silent seconds, expired: the last heartbeat of each client or node (a column kind) against the seconds its kind may be silent."""
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(s))) for k, s in limits.items()])
    last = beats.groupBy(key, "kind").agg(F.max(at).alias("_last"))
    silent = (F.unix_micros(now) - F.unix_micros("_last")) / F.lit(1e6)
    return last.select(key, "kind", silent.alias("silent"), F.coalesce(silent > limit, F.lit(False)).alias("expired"))


def retry_delay(attempt: Column, strategy: str, first: float = 1.0, base: float = 2.0, longest: float = 60.0, jitter_of: Column | None = None) -> Column:
    """Seconds before an attempt (from 0): exponential, linear, fixed or immediate, at most ``longest``; with jitter up to a tenth more, by a hash of a key."""
    plain = {"exponential": F.lit(first) * F.pow(F.lit(base), attempt), "linear": F.lit(first) * (attempt + 1), "fixed": F.lit(first), "immediate": F.lit(0.0)}[strategy]
    delay = F.least(plain, F.lit(longest))
    if jitter_of is None:
        return delay
    return delay * (1 + 0.1 * F.pmod(F.xxhash64(jitter_of, attempt), F.lit(1 << 20)) / F.lit(float(1 << 20)))


# jobs


def group_status(jobs: DataFrame) -> DataFrame:
    """group_id, jobs, completed, failed, complete, status of jobs (group_id, job_id, status): a group is complete when every job is."""
    n = lambda s: F.count_if(F.col("status") == s)
    told = jobs.groupBy("group_id").agg(F.count(F.lit(1)).alias("jobs"), n("completed").alias("completed"), n("failed").alias("failed"), n("pending").alias("_pending"))
    status = F.when(F.col("completed") == F.col("jobs"), "completed").when(F.col("failed") > 0, "failed").when(F.col("_pending") == F.col("jobs"), "pending").otherwise("processing")
    return told.select("group_id", "jobs", "completed", "failed", (F.col("completed") == F.col("jobs")).alias("complete"), status.alias("status"))


def cancelled(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The jobs (job_id, status, ...) with status after the wanted ones are cancelled, and refused for those that have ended before."""
    asked = jobs.join(wanted.select("job_id", F.lit(True).alias("_w")).distinct(), "job_id", "left")
    ended = F.col("status").isin("completed", "failed")
    hit = F.col("_w").isNotNull()
    return asked.withColumns({"refused": hit & ended, "status": F.when(hit & ~ended, "cancelled").otherwise(F.col("status"))}).drop("_w")


def expand(queries: DataFrame, expander: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """query_id, place, query, failed: the lines of each query's expansion; a query whose expansion is null stays as it is.

    ``expander`` adds a column expansion to query_id, text; empty lines and those that begin with a dash are no queries.
    """
    lines = F.filter(F.transform(F.split("expansion", "\n"), lambda l: F.trim(l)), lambda l: (l != "") & ~F.startswith(l, F.lit("-")))
    told = expander(queries).withColumn("_l", F.when(F.col("expansion").isNull(), F.array("text")).otherwise(lines))
    failed = F.coalesce(F.col("_l") == F.array("text"), F.lit(False))
    return told.select("query_id", failed.alias("failed"), F.posexplode("_l").alias("place", "query"))


def batch_rows(row_bytes: float, free_bytes: float, least: int = 16, most: int = 4096) -> int:
    """How many rows a batch of a model or of Arrow may have: the largest power of two that fits the memory that is free."""
    fit = max(1.0, free_bytes / max(row_bytes, 1.0))
    return int(min(most, max(least, 1 << int(fit).bit_length() - 1)))


# evaluation


def table_quality(chunks: DataFrame, keys: list[str], text: str = "text", tables: str = "table_count") -> DataFrame:
    """keys, tables, markers, quality: separators of Markdown tables for each table found, in hundredths, 100 at most; 0 without tables."""
    markers = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\|---\||\| --- \|"))
    told = chunks.groupBy(*keys).agg(F.coalesce(F.sum(tables), F.lit(0)).alias("tables"), F.sum(markers).alias("markers"))
    return told.select(*keys, "tables", "markers", F.when(F.col("tables") > 0, F.round(F.least(F.lit(100.0), 100 * F.col("markers") / F.col("tables")), 1)).otherwise(F.lit(0.0)).alias("quality"))


def accuracy(rows: DataFrame, keys: list[str], expected: Column, actual: Column) -> DataFrame:
    """keys, n, right, accuracy of what was expected and what came."""
    told = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(expected.eqNullSafe(actual)).alias("right"))
    return told.withColumn("accuracy", F.round(F.col("right") / F.col("n"), 6))


def question_set(pages: DataFrame, ask: Callable[[DataFrame], DataFrame], per_source: int = 2, least: int = 200, seed: int = 0) -> DataFrame:
    """page_id, question, answer: pairs that ``ask`` makes of some pages of each source, chosen by a hash, of those of enough characters.

    ``ask`` adds question and answer to page_id, source, text; pages of which it makes none are left out.
    """
    order = Window.partitionBy("source").orderBy(F.xxhash64("page_id", F.lit(seed)), "page_id")
    some = pages.where(F.length("text") >= least).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_source).drop("_k")
    return ask(some).where(F.col("question").isNotNull() & F.col("answer").isNotNull()).select("page_id", "question", "answer")


def saving(rows: DataFrame, keys: list[str], before: list[str], after: list[str]) -> DataFrame:
    """keys, before_bytes, after_bytes, saving: the rows as JSON with the columns they had and with those that stay."""
    size = lambda columns: F.sum(F.octet_length(F.to_json(F.struct(*columns))))
    told = rows.groupBy(*keys).agg(size(before).alias("before_bytes"), size(after).alias("after_bytes"))
    return told.withColumn("saving", F.round(1 - F.col("after_bytes") / F.col("before_bytes"), 6))
