"""Evidence as of an instant: which sources stood behind a record when it was asked about.

The joins "what held at that time" are as-of joins of two event streams: both are
put into one, in order of time, and every question takes the running value of what
came before it. Nothing is compared with all the other rows of its key. Both streams
are dealt by their key, once: one task sorts the history of a key, on disk if it is
long. Keys with very many events can be spread by slices of time instead, for three
more shuffles: values run within a slice, and slices hand on what they end with.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import applicability, filters
from ..functions.temporal import temporal_status


def _all_known(columns: list[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def as_of_join(
    left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str, order: list[str], slices: str | None = None, keyless: bool = False
) -> DataFrame:
    """``left`` with ``found``: of the right rows of its key up to its instant, the one that is last in ``order``.

    ``found`` is a struct of the right columns without the key, null if there is none; right rows of
    the same instant count. ``order`` decides between right rows, whatever their
    instants are; rows without an instant or key are not found. ``slices`` is a unit of
    time in which a key's rows stay together (None: all of them). ``keyless`` spreads
    left rows without a key, which else meet in one task; what follows by the key is then dealt again.
    """
    rest = [c for c in right.columns if c not in order and c not in key]
    value = F.struct(*[F.col(c).alias(c) for c in [*order, *rest]])
    keys = [f"k{i}" for i in range(len(key))]
    named = [F.col(c).alias(k) for c, k in zip(key, keys)]
    asked = left.select(*named, F.col(left_at).cast("timestamp_ntz").alias("t"), F.lit(1).alias("side"), F.struct(*[c for c in left.columns if c not in key]).alias("l"))
    given = right.filter(_all_known([*key, right_at])).select(*named, F.col(right_at).cast("timestamp_ntz").alias("t"), F.lit(0).alias("side"), value.alias("r"))
    none = F.lit(None)
    both = asked.withColumn("r", none.cast(given.schema["r"].dataType)).unionByName(given.withColumn("l", none.cast(asked.schema["l"].dataType)))
    together = list(keys)
    if keyless:
        both = both.withColumn("apart", F.when(~_all_known(keys), F.xxhash64("t", "l")))
        together.append("apart")
    if slices:
        both = both.withColumn("slot", F.date_trunc(slices, F.col("t")).cast("timestamp_ntz"))
        together.append("slot")
        # What a key's earlier slices end with comes in front of each slice as a row of its own.
        ends = both.groupBy(*together).agg(F.max("r").alias("last"))
        before = F.max("last").over(W.partitionBy(*keys).orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
        handed = ends.select(*together, F.col("slot").alias("t"), before.alias("r")).filter("r is not null")
        both = both.unionByName(handed.withColumns({"side": F.lit(-1), "l": none.cast(asked.schema["l"].dataType)}))
    so_far = F.max("r").over(W.partitionBy(*together).orderBy("t", "side").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = both.withColumn("found", so_far).filter("side = 1")
    # Keys come from the columns that rows are dealt by, so that what follows by the same key is not dealt again.
    own = dict(zip(key, keys))
    columns = [F.col(own[c]).cast(left.schema[c].dataType) if c in own else F.col("l").getField(c) for c in left.columns]
    return rows.select(*[v.alias(c) for v, c in zip(columns, left.columns)], F.when(_all_known([*keys, "t"]), F.col("found")).alias("found"))


def reigns(rows: DataFrame, key: list[str], at: str, order: list[str]) -> DataFrame:
    """``rows`` with ``since, until``: when ``as_of_join`` would find each, until another of its key that is later in ``order`` comes.

    A null ``until`` is open; rows that are never found are left out. At any instant one row of a key reigns at most.
    """
    rest = [c for c in rows.columns if c not in order and c not in key]
    later = W.partitionBy(*key).orderBy(*[F.col(c).desc() for c in [*order, *rest]]).rowsBetween(W.unboundedPreceding, -1)
    timed = rows.filter(_all_known([*key, at])).withColumn("since", F.col(at).cast("timestamp_ntz"))
    return timed.withColumn("until", F.min("since").over(later)).filter("until is null or until > since")


def visible(known: Column, source_artifact: bool = False, ast: dict | None = None, metadata: Column | None = None, columns: dict[str, Column] | None = None,
            scope: dict | None = None, dimensions: dict[str, tuple[Column, Column]] | None = None, ontology_ids: list[str] | None = None) -> Column:
    """Whether a version may be shown: known by then and not superseded, not deleted, no audit row, and in scope.

    Of sources the exact version counts that was read, so being superseded does not hide it.
    """
    out = F.coalesce(F.col("recorded_at") <= known, F.lit(True)) & ~F.coalesce(F.col("deleted"), F.lit(False))
    if not source_artifact:
        out = out & F.coalesce(F.col("superseded_at") > known, F.lit(True))
    if ast is not None:
        out = out & filters.to_column(ast, metadata, columns)
    if scope is not None:
        out = out & applicability.scope_matches(dimensions or {}, scope)
    if ontology_ids is not None:
        out = out & F.coalesce(F.col("ontology_id").isin(ontology_ids), F.lit(False))
    return out


def standing_mappings(reads: DataFrame, mappings: DataFrame, events: DataFrame) -> DataFrame:
    """``read, record, known_at, valid_at, assertion, event``: the mappings that still stood when each read was made.

    ``reads``: read, record, known_at, valid_at; ``mappings``: record, assertion, event,
    created_at; ``events``: event, assertion, decision_version, created_at, to_status,
    record (null: not said). A mapping stands if the assertion's last decision
    by then is the very event it was made by, and accepted for the same record. A later
    withdrawal, acceptance or move to another record closes it, and one that
    is yet to come does not.
    """
    decided = events.select("assertion", "decision_version", "event", "to_status", F.col("record").alias("for_record"), "created_at")
    # From when until when an event is its assertion's last does not depend on reads, so events need not be dealt together with them.
    last = reigns(decided, ["assertion"], "created_at", ["decision_version"]).filter("to_status = 'accepted'").select("assertion", "event", "for_record", "since", "until")
    own = mappings.select("record", "assertion", "event", F.col("created_at").alias("mapped_at")).join(last, ["assertion", "event"])
    own = own.filter(F.coalesce(F.col("for_record") == F.col("record"), F.lit(True))).drop("for_record")
    at = F.col("known_at").cast("timestamp_ntz")
    stood = (F.col("mapped_at") <= F.col("known_at")) & (F.col("since") <= at) & F.coalesce(F.col("until") > at, F.lit(True))
    return reads.select("read", "record", "known_at", "valid_at").join(own, "record").filter(stood).select("read", "record", "known_at", "valid_at", "assertion", "event")


def occurrences(reads: DataFrame, mappings: DataFrame, events: DataFrame, assertions: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``read, record, assertion, chunk, document, status``: evidence of each read with its state in business time.

    ``assertions``: assertion, chunk, document, created_at; ``chunks``: chunk, document,
    recorded_at, valid_from, valid_until; ``documents``: versions as document, version,
    recorded_at, superseded_at, deleted, valid_from, valid_until. Text stays the
    frozen chunk; the document's authority is its last version by then, and a deleted
    or withdrawn one authorises nothing. The states of document and chunk are
    combined: both effective, or what the others agree on, or conflict.
    """
    rows = standing_mappings(reads, mappings, events)
    own = assertions.select("assertion", "chunk", "document", F.col("created_at").alias("asserted_at"))
    rows = rows.join(own, "assertion").filter(F.col("asserted_at") <= F.col("known_at")).drop("asserted_at")
    text = chunks.select("chunk", "document", F.col("recorded_at").alias("chunk_at"), F.struct("valid_from", "valid_until").alias("c"))
    rows = rows.join(text, ["chunk", "document"]).filter(F.coalesce(F.col("chunk_at") <= F.col("known_at"), F.lit(True)))
    authority = as_of_join(rows, documents.select("document", "version", "recorded_at", "superseded_at", "deleted", "valid_from", "valid_until"), ["document"], "known_at", "recorded_at", ["version"])
    stands = authority.filter(
        F.col("found").isNotNull() & ~F.coalesce(F.col("found.deleted"), F.lit(False)) & F.coalesce(F.col("found.superseded_at") > F.col("known_at"), F.lit(True))
    )
    state = lambda s: temporal_status(F.col(f"{s}.valid_from"), F.col(f"{s}.valid_until"), F.col("valid_at"))
    other = F.array_distinct(F.filter(F.array(state("found"), state("c")), lambda s: s != "effective"))
    status = F.when(F.size(other) == 0, "effective").when(F.size(other) == 1, F.get(other, 0)).otherwise("conflict")
    return stands.select("read", "record", "assertion", "chunk", "document", status.alias("status"))


def source_context(reads: DataFrame, mappings: DataFrame, events: DataFrame, assertions: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``read, record, chunk``: the chunks behind each read's record at its instant."""
    return occurrences(reads, mappings, events, assertions, chunks, documents).select("read", "record", "chunk").distinct()


def answer_validity(reads: DataFrame, records: DataFrame, found: DataFrame) -> DataFrame:
    """``read, status, usage, n_allowed``: what an answer may do with each record it read.

    ``records``: record, valid_from, valid_until; ``found``: ``occurrences``. A record
    that is effective or unknown by itself is judged by its sources: one effective
    occurrence is enough; otherwise it is what they agree on, conflict where
    they do not, and unknown without any. Only effective ones are a basis of an answer.
    """
    own = reads.join(records.select("record", F.col("valid_from").alias("f"), F.col("valid_until").alias("u")), "record")
    own = own.select("read", "record", temporal_status(F.col("f"), F.col("u"), F.col("valid_at")).alias("own"))
    counts = found.groupBy("read", "record").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "effective").alias("n_effective"),
        F.count_if(F.col("status") == "unknown").alias("n_unknown"), F.min("status").alias("least"), F.max("status").alias("most"),
    )
    rows = own.join(counts, ["read", "record"], "left").fillna(0, ["n", "n_effective", "n_unknown"])
    agreed = F.when(F.col("n") == 0, "unknown").when(F.col("least") == F.col("most"), F.col("least")).otherwise("conflict")
    by_source = F.col("own").isin("effective", "unknown") & (F.col("n_effective") == 0) & ((F.col("own") == "effective") | (F.col("n") > 0))
    rows = rows.withColumn("status", F.when(by_source, agreed).otherwise(F.col("own")))
    usage = F.when(F.col("status") == "effective", "effective_basis").otherwise("reference")
    allowed = F.when(F.col("status") == "effective", F.col("n_effective")).when(F.col("status") == "unknown", F.col("n_effective") + F.col("n_unknown")).otherwise(F.col("n"))
    return rows.select("read", "record", "status", usage.alias("usage"), allowed.cast("long").alias("n_allowed"))


def conflict_reads(reads: DataFrame, sets: DataFrame, members: DataFrame, events: DataFrame, assertions: DataFrame, documents: DataFrame) -> DataFrame:
    """``read, set, members, supports, active_supports``: the conflicts that were open when each read was made.

    ``reads``: read, entity, known_at; ``sets``: set, entity, created_at, resolved_at;
    ``members``: set, record, assertion; ``events``: assertion, decision_version,
    created_at, to_status; ``assertions``: assertion, document; ``documents``:
    document, version, recorded_at, superseded_at, deleted. A conflict is open from its
    making until it is resolved. A support is active if its assertion's last decision by
    then is ``contradicting`` and its source, if it has one, was there and in force.
    """
    known = reads.join(sets.select("set", "entity", "created_at", "resolved_at"), "entity")
    open_then = (F.col("created_at") <= F.col("known_at")) & F.coalesce(F.col("resolved_at") > F.col("known_at"), F.lit(True))
    rows = known.filter(open_then).select("read", "set", "known_at").join(members.select("set", "record", "assertion").distinct(), "set")
    # Only decisions that contradict go to the questions, with the instant at which another follows.
    spells = reigns(events.select("assertion", "decision_version", "created_at", "to_status"), ["assertion"], "created_at", ["decision_version"])
    spells = spells.filter("to_status = 'contradicting'").select("assertion", "decision_version", "since", "until")
    decided = as_of_join(rows, spells, ["assertion"], "known_at", "since", ["decision_version"])
    lasting = F.coalesce(F.col("found.until") > F.col("known_at").cast("timestamp_ntz"), F.lit(True))
    decided = decided.withColumn("contradicting", F.col("found").isNotNull() & lasting).drop("found")
    sourced = decided.join(assertions.select("assertion", "document"), "assertion", "left")
    versions = documents.select("document", "version", "recorded_at", "superseded_at", "deleted")
    judged = as_of_join(sourced, versions, ["document"], "known_at", "recorded_at", ["version"], keyless=True)
    there = F.col("found").isNotNull() & ~F.coalesce(F.col("found.deleted"), F.lit(False)) & F.coalesce(F.col("found.superseded_at") > F.col("known_at"), F.lit(True))
    active = F.col("contradicting") & (F.col("document").isNull() | there)
    return judged.groupBy("read", "set").agg(F.count_distinct("record").alias("members"), F.count(F.lit(1)).alias("supports"), F.count_if(active).alias("active_supports"))
