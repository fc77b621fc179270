"""Registry, publications, retention and jobs in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.model import JOB_PHASES, KEYWORDS_MOST, RETENTION_DAYS, invalid
from quarrylight.plans.paging import byte_budget, json_size, page
from quarrylight.sources.tables import by_key


def phase_ordinal(phase: F.Column) -> F.Column:
    out = F.when(phase == JOB_PHASES[0], 0)
    for i, p in enumerate(JOB_PHASES[1:], 1):
        out = out.when(phase == p, min(i, 2))
    return out


def current_pointer(publications: DataFrame) -> DataFrame:
    """The latest publication of the default branch of each repository; explicit revisions never move it."""
    default = publications.where("is_default")
    return default.groupBy("repository_id").agg(F.max_by("revision", "seq").alias("revision"), F.max("seq").alias("seq"), F.max_by("published_at", "seq").alias("published_at"))


def retirements(publications: DataFrame) -> DataFrame:
    """(repository_id, revision, retired_at) of revisions that are not current.

    A revision retires when the default branch moves on from it, for the last time it does; one that
    never was current retires when it is first published.
    """
    w = Window.partitionBy("repository_id").orderBy("seq")
    default = publications.where("is_default").withColumn("until", F.lead("published_at").over(w))
    was = default.groupBy("repository_id", "revision").agg(F.max_by(F.struct("until"), "seq").alias("last"))
    never = publications.groupBy("repository_id", "revision").agg(F.min_by("published_at", "seq").alias("first"))
    both = never.join(was, ["repository_id", "revision"], "left")
    at = F.when(F.col("last").isNull(), F.col("first")).otherwise(F.col("last.until"))
    return both.select("repository_id", "revision", at.alias("retired_at")).where(F.col("retired_at").isNotNull())


def collectable(retired: DataFrame, now: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Retired revisions whose time of retention is over; the boundary is over."""
    return retired.where(F.lit(now).cast("timestamp") >= F.col("retired_at") + F.make_interval(days=F.lit(days)))


def obsolete_generations(generations: DataFrame, selected: DataFrame, published: DataFrame) -> DataFrame:
    """Generations of published revisions other than the selected one."""
    return generations.join(published, ["repository_id", "revision"], "left_semi").join(selected, ["repository_id", "revision", "generation"], "left_anti")


def latest_jobs(reports: DataFrame) -> DataFrame:
    """The state of each repository's newest job: phases only move on, and older jobs never overwrite newer ones."""
    rank = F.struct("job_seq", phase_ordinal(F.col("phase")), -F.col("event_id"))
    top = F.max_by(F.struct("job_seq", "phase"), rank)
    return reports.groupBy("repository_id").agg(top.alias("t")).select("repository_id", "t.job_seq", "t.phase")


def admitted(requests: DataFrame) -> DataFrame:
    """First request of each request_id; a reused id gets the job of the first one."""
    w = Window.partitionBy("request_id").orderBy("seq")
    return requests.select("request_id", "seq", "job_id", F.first("job_id").over(w).alias("admitted_job"), (F.row_number().over(w) == 1).alias("is_new"))


def one_active(events: DataFrame) -> DataFrame:
    """(repository_id, seq, admitted) of requests: a repository has one active job; the first request after its end begins the next.

    events: (repository_id, seq, is_request); the others tell that the active job has ended.
    """
    w = Window.partitionBy("repository_id").orderBy("seq")
    spell = events.withColumn("ended", F.count_if(~F.col("is_request")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.row_number().over(Window.partitionBy("repository_id", "ended", "is_request").orderBy("seq"))
    return spell.withColumn("n", first).where("is_request").select("repository_id", "seq", (F.col("n") == 1).alias("admitted"))


def dispatch_order(jobs: DataFrame) -> DataFrame:
    """Jobs (job_id, kind, seq) in the order of a dispatcher that takes the two kinds in turn, each first come, first served."""
    turn = F.row_number().over(Window.partitionBy("kind").orderBy("seq", "job_id"))
    return jobs.withColumn("turn", turn).select("job_id", "kind", "turn")


def index_requests(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Requests to index (request_id, repository_id, revision): only the current revision is taken."""
    own = current.select("repository_id", F.col("revision").alias("now"))
    outcome = F.when(F.col("now").isNull(), "SOURCE_NOT_READY").when(F.col("now") != F.col("revision"), "REVISION_NOT_CURRENT").otherwise("ACCEPTED")
    return requests.join(own, "repository_id", "left").select("request_id", "repository_id", "revision", outcome.alias("outcome"))


def get_job(jobs: DataFrame, repository_id: str, job_id: int | None = None, request_id: int | None = None) -> DataFrame:
    """A job of a repository by exactly one of its ids."""
    if (job_id is None) == (request_id is None):
        raise invalid("one of jobId and requestId")
    own = jobs.where(F.col("repository_id") == repository_id)
    return own.where(F.col("job_id") == job_id) if request_id is None else own.where(F.col("request_id") == request_id)


def unleased(collectable_: DataFrame, leases: DataFrame, now: str) -> DataFrame:
    """What may be collected now: revisions that no reader holds a lease on."""
    held = leases.where(F.col("until") > F.lit(now).cast("timestamp"))
    return collectable_.join(held, ["repository_id", "revision"], "left_anti")


def capacity_refusals(requests: DataFrame, most: int, least: int = 0) -> DataFrame:
    """(repository_id, seq, used, admitted) of requests (repository_id, seq, bytes, free): a fold over each repository's requests in order.

    A request is admitted if the bytes in use and its own stay within ``most``, the exact limit included, and if at least
    ``least`` bytes would stay free; what is refused takes no room.  ``used`` is what is in use after the request.  Rows come
    sorted by repository, so a task carries one number from row to row, however many requests a repository has.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repository, used = None, 0
        for batch in batches:
            out_used, admitted = [], []
            for own, size, free in zip(*(batch.column(c).to_pylist() for c in ("repository_id", "bytes", "free"))):
                if own != repository:
                    repository, used = own, 0
                fits = used + size <= most and (free is None or free - size >= least)
                used += size * fits
                out_used.append(used)
                admitted.append(fits)
            yield pa.RecordBatch.from_arrays([batch.column("repository_id"), batch.column("seq"), pa.array(out_used, pa.int64()), pa.array(admitted, pa.bool_())], ["repository_id", "seq", "used", "admitted"])

    rows = requests.select(F.col("repository_id").cast("string").alias("repository_id"), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("bytes"), F.lit(0)).cast("long").alias("bytes"), (F.col("free") if "free" in requests.columns else F.lit(None)).cast("long").alias("free"))
    return by_key(rows, "repository_id", "seq").mapInArrow(fold, "repository_id string, seq long, used long, admitted boolean")


def recovered(jobs: DataFrame, receipts: DataFrame) -> DataFrame:
    """RUNNING jobs after a restart: COMPLETE if their receipt was committed, else FAILED."""
    done = receipts.select("job_id", F.lit(True).alias("committed")).distinct()
    running = jobs.join(done, "job_id", "left")
    return running.select("job_id", F.when(F.col("phase") != "RUNNING", F.col("phase")).when(F.col("committed"), "COMPLETE").otherwise("FAILED").alias("phase"))


def managed_bytes(roots: DataFrame) -> DataFrame:
    """Bytes of managed roots (path, bytes) where a root below another counts once, with the outer one."""
    # every ancestor of a path, as rows: an equi join instead of a prefix comparison of all pairs
    up = roots.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))).alias("above"))
    nested = up.where(F.col("above") != F.col("path")).join(roots.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    return roots.join(nested, "path", "left_anti").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("managed_bytes"))


def list_repositories(registry: DataFrame, current: DataFrame, indexes: DataFrame, name: str | None = None, limit: int = 20, position: str | None = None, budget: int | None = None) -> DataFrame:
    """Registered repositories with their current revision and the state of its index."""
    rows = registry if name is None else registry.where(F.col("display_name").contains(name))
    out = page(rows.select("repository_id", "display_name"), ["repository_id"], limit, None if position is None else [position])
    out = out.join(current.select("repository_id", "revision"), "repository_id", "left").join(indexes.select("repository_id", "revision", "index_state"), ["repository_id", "revision"], "left")
    state = F.when(F.col("revision").isNull(), "UNAVAILABLE").otherwise(F.coalesce("index_state", F.lit("NOT_READY")))
    out = out.select("repository_id", "display_name", "revision", state.alias("index_state"), "has_more")
    return out if budget is None else byte_budget(out, ["repository_id"], json_size(out), budget)


def get_context(publications: DataFrame, repository_id: str, revision: str | None = None) -> DataFrame:
    """The current revision, or an explicit one that must be published: there is no fallback."""
    own = publications.where(F.col("repository_id") == repository_id)
    if revision is None:
        return current_pointer(own).select("repository_id", "revision", "published_at")
    return own.where(F.col("revision") == revision).groupBy("repository_id", "revision").agg(F.min_by("published_at", "seq").alias("published_at"))


def origin_conflicts(bindings: DataFrame) -> DataFrame:
    """Repositories bound to more than one origin fingerprint."""
    fp = F.sha2(F.concat(F.lit("source-origin-v1"), F.lit("\0"), F.col("origin")), 256)
    return bindings.withColumn("origin_fingerprint", fp).groupBy("repository_id").agg(F.countDistinct("origin_fingerprint").alias("n")).where(F.col("n") > 1)


def registry_faults(descriptors: DataFrame, each: int = 2048, total: int = 1 << 20) -> DataFrame:
    """(repository_id, bytes, fault) of descriptors: none may be larger than ``each``, nor all of them than ``total``."""
    size = F.octet_length(F.to_json(F.struct(*descriptors.columns))).cast("long")
    rows = descriptors.select("repository_id", size.alias("bytes"))
    # one row by all rows: a sum of sizes
    whole = rows.agg((F.coalesce(F.sum("bytes"), F.lit(0)) > total).alias("over"))
    fault = F.when(F.col("bytes") > each, "DESCRIPTOR").when(F.col("over"), "REGISTRY")
    return rows.crossJoin(F.broadcast(whole)).select("repository_id", "bytes", fault.alias("fault"))


def published_registry(descriptors: DataFrame) -> DataFrame:
    """Descriptors in id order; only approved hints stay, with at most twelve distinct keywords in their order."""
    hint = F.when(F.col("review_status") == "APPROVED", F.slice(F.array_distinct("keywords"), 1, KEYWORDS_MOST))
    return descriptors.select("repository_id", "display_name", hint.alias("keywords")).orderBy("repository_id")
