"""Graph sessions: a manifest of what a reader may see, and pages of it that end when the data move on.

A cursor is signed and belongs to one session and kind. Every page checks the outbox
sequence that the session was opened at; a later change makes its cursors invalid, so
nothing that was withdrawn is shown by an old one.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cursors
from .versions import keyset_page

#: Rows of a page at most, by kind (fixed values).
MOST = {"entities": 10_000, "relations": 10_000, "connected": 500}


class Stale(ValueError):
    """The data have changed since the session was opened."""


@dataclass(frozen=True)
class Session:
    scope: object
    owner: str | None
    watermark: int
    totals: dict[str, int]
    expires: datetime
    secret: bytes = field(default_factory=lambda: secrets.token_bytes(32), repr=False)

    def bound(self, kind: str) -> list:
        """What a cursor of this session is for."""
        return [cursors.scope_hash(self.scope), self.owner, self.watermark, kind]


def watermark(outbox: DataFrame, seq: str) -> int:
    """The last sequence number of an outbox; 0 if it is empty."""
    return outbox.agg(F.max(seq)).first()[0] or 0


def opened(entities: DataFrame, relations: DataFrame, at: int, scope: object, owner: str | None = None, seconds: int = 3600) -> Session:
    """A session over entities ``id`` and relations ``edge, src, dst`` that the caller has qualified, at an outbox sequence."""
    totals = {"entities": entities.count(), "relations": relations.count()}
    return Session(scope, owner, at, totals | {"connected": totals["relations"]}, datetime.now(timezone.utc) + timedelta(seconds=seconds))


def page(
    session: Session, kind: str, entities: DataFrame, relations: DataFrame, now_at: int, cursor: str | None = None, limit: int = 400, owner: str | None = None
) -> dict:
    """``records``, the ``entities`` at their ends (of connected pages), ``next_cursor`` (None: complete) and ``total``.

    ``now_at`` is the outbox sequence at the time of reading. Stale if it has moved, ValueError
    for cursors that are forged or of another session or kind, for ends that are not
    among the entities, and after the session's time; PermissionError for other owners.
    """
    if kind not in MOST or not 1 <= limit <= MOST[kind]:
        raise ValueError("no such page")
    if owner != session.owner:
        raise PermissionError("the session is another's")
    if datetime.now(timezone.utc) >= session.expires:
        raise ValueError("the session has ended")
    after = cursors.decode(session.bound(kind), cursor, session.secret) if cursor is not None else None
    if now_at != session.watermark:
        raise Stale("the data have changed; open the session again")
    rows, key = (entities, "id") if kind == "entities" else (relations, "edge")
    found = keyset_page(rows, [key], tuple(after) if after else None, limit + 1).collect()  # a page, not a table
    more, found = len(found) > limit, found[:limit]
    out = {"records": found, "total": session.totals[kind], "next_cursor": None}
    if more:
        out["next_cursor"] = cursors.encode(session.bound(kind), [found[-1][key]], session.secret)
    if kind == "connected":
        ends = {x for r in found for x in (r["src"], r["dst"])}
        if None in ends:
            raise ValueError("a relation lacks an end")
        out["entities"] = entities.filter(F.col("id").isin(list(ends))).collect() if ends else []
        if {e["id"] for e in out["entities"]} != ends:
            raise ValueError("a relation's end is not in the manifest")
    return out
