"""Dates that documents give themselves.

A document's own words are separated from what it quotes first, by one walk from
left to right. What is left is read for header lines, for clauses in which the
document names itself, and for a mark of expiry in its title; a date in doubt is
left to review.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels of document dates, nouns by which a document names itself, and what its clauses say (fixed values of the language).
DATE_LABELS = {
    "发布日期": "published_at", "发布时间": "published_at", "生效日期": "valid_from", "生效时间": "valid_from",
    "失效日期": "valid_until", "失效时间": "valid_until", "修订日期": "revised_at", "修订时间": "revised_at",
}
DATE_FIELDS = ("published_at", "valid_from", "valid_until", "revised_at")
OWN_NAMES = ("规则", "表", "规范", "办法", "细则", "制度", "公告", "通知", "规定", "指引", "协议", "标准", "说明")
NOTICE_WORDS, NOTICE_NAMES = ("通知", "公告", "公示"), ("公告", "通知")
_DAY = r"\d{4}(?:年\d{1,2}月\d{1,2}日|[-/]\d{1,2}[-/]\d{1,2})"
_CLOCK = r"(?:[T \t]?\d{1,2}[:：]\d{2}(?:[:：]\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?"
_DATE = f"(?:{_DAY}{_CLOCK})"
_ZONE = timezone(timedelta(hours=8))
#: ``(pattern, field, kind, whole day included)`` of the clauses about the document itself.
CLAUSES = [
    (re.compile(rf"有效至\s*(?P<d>{_DATE})"), "valid_until", "valid_through", True),
    (re.compile(rf"有效期[为自]?\s*(?P<d>{_DATE})"), "valid_from", "validity_range", False),
    (re.compile(rf"[于自]\s*(?P<d>{_DATE})\s*(?:起|开始)?\s*(?P<how>最新修订|最新|首次|正式)?(?:施行|实施|生效|执行|试行)"), "valid_from", "self_effective", False),
    (re.compile(rf"[于自]\s*(?P<d>{_DATE})\s*起?(?:正式)?(?:失效|废止|终止)"), "valid_until", "self_expiry", False),
    (re.compile(rf"[于自]\s*(?P<d>{_DATE})\s*(?:进行)?(?:修订|修正)"), "revised_at", "self_revision", False),
]
_RANGE_END = re.compile(rf"\s*[至到]\s*(?P<d>{_DATE})")
#: Marks around quoted words, a mark of code on one line and of code on several, and words that announce an example (fixed values).
QUOTES = {"“": "”", "‘": "’", '"': '"', "'": "'"}
CODE, FENCES = "`", ("```", "~~~")
EXAMPLE_WORDS = ("例如", "示例", "举例", "样例")
STATUS_LABEL, EXPIRED_WORDS, IN_FORCE = "是否生效", ("失效", "废止", "下线"), "生效中"
#: More candidates than these for a field are left to review (fixed value).
MOST_CANDIDATES = 40


def _end_of_line(text: str, at: int) -> int:
    stop = text.find("\n", at)
    return len(text) if stop < 0 else stop


def _aside(text: str, at: int) -> int:
    """Where a quotation or code that begins at a place ends; the place itself if none does."""
    mark = text[at : at + 3]
    if mark in FENCES and (line := text.find("\n", at)) >= 0:
        closed = text.find(mark, line + 1)
        return len(text) if closed < 0 else closed + 3
    c = text[at]
    if c == CODE:
        closed = text.find(CODE, at + 1, _end_of_line(text, at))
        return closed + 1 if closed >= 0 else at
    if c in QUOTES:
        again = text.find(c, at + 1) if c != QUOTES[c] else -1
        closed = text.find(QUOTES[c], at + 1, len(text) if again < 0 else again)
        return closed + 1 if closed >= 0 else at
    return at


def _is_aside_line(line: str) -> bool:
    """Whether a line is a quoted, an indented or an example line."""
    return line.lstrip(" \t").startswith(">") or line.startswith(("    ", "\t")) or any(w in line for w in EXAMPLE_WORDS)


def aside_spans(text: str) -> Iterator[tuple[int, int]]:
    """Spans that are quoted, code or an example, in order and apart from one another."""
    at, marks = 0, re.compile("[" + "".join(QUOTES) + CODE + "~\n]")
    while at < len(text):
        stop = _aside(text, at)
        if stop == at and (at == 0 or text[at - 1] == "\n") and _is_aside_line(text[at : _end_of_line(text, at)]):
            stop = _end_of_line(text, at)
        if stop > at:
            yield at, stop
            at = stop
        else:
            found = marks.search(text, at + (text[at] != "\n"))
            # Behind the end of a line a new one begins; other marks are looked at themselves.
            at = len(text) if found is None else found.start() + (text[found.start()] == "\n")


def own_words(text: str, excluded: Iterable[tuple[int, int]] = ()) -> str:
    """The text with spaces for what is excluded and for asides; offsets stay as they are."""
    for spans in (sorted(excluded), None):
        parts, at = [], 0
        for a, b in aside_spans(text) if spans is None else spans:
            a, b = max(a, at), min(b, len(text))
            if a < b:
                parts += [text[at:a], "\n".join(" " * len(x) for x in text[a:b].split("\n"))]
                at = b
        text = "".join(parts) + text[at:]
    return text


def _instant(raw: str, inclusive: bool = False) -> datetime | None:
    """UTC instant of a date, by the clock of UTC+8 unless it names a zone; a whole day that is included ends with it."""
    parts = re.fullmatch(r"(\d{4})\D(\d{1,2})\D(\d{1,2})日?[T \t]?(?:(\d{1,2})[:：](\d{2})(?:[:：](\d{2})(?:\.(\d{1,6}))?)?(Z|[+-]\d{2}:?\d{2})?)?", raw)
    if parts is None:
        return None
    *numbers, micro, zone = parts.groups()
    try:
        at = datetime(*(int(n or 0) for n in numbers), int((micro or "0").ljust(6, "0")), tzinfo=_ZONE)
        if zone:
            at = at.replace(tzinfo=timezone.utc if zone == "Z" else datetime.strptime(zone.replace(":", ""), "%z").tzinfo)
        return (at + timedelta(days=inclusive and numbers[3] is None)).astimezone(timezone.utc)
    except (ValueError, OverflowError):
        return None


@dataclass
class Dates:
    """What a document says: candidates ``(start, stop, kind, instant)`` by field, and whether it says it is in force."""

    candidates: dict[str, list[tuple[int, int, str, datetime | None]]]
    in_force: tuple[int, int, str] | None = None


@dataclass
class Resolved:
    """``fields``: ``(instant, place of the first evidence, status)`` by field; warnings by name."""

    fields: dict[str, tuple[datetime | None, int | None, str]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    in_force: str | None = None


def date_candidates(text: str, title: str = "", excluded: Iterable[tuple[int, int]] = ()) -> Dates:
    """Every dated statement of a document about itself.

    Header lines count within the first twenty lines (2000 characters) before a
    second-level heading, clauses anywhere after the document's own name, up to the
    end of the sentence or the title of another document.
    """
    plain = own_words(text, excluded)
    found: dict[str, dict[tuple[int, int], tuple]] = {name: {} for name in DATE_FIELDS}
    in_force = None

    def put(name: str, kind: str, start: int, stop: int, inclusive: bool = False) -> None:
        found[name].setdefault((start, stop), (start, stop, kind, _instant(text[start:stop], inclusive)))

    head, at = plain[:2000], 0
    label = re.compile(r"[ \t]*(?:[-*]\s+)?(?:\*\*)?(" + "|".join([*DATE_LABELS, STATUS_LABEL]) + r")(?:\*\*)?\s*[：:]\s*(?:\*\*)?")
    for line in head.splitlines(keepends=True)[:20]:
        if re.match(r"\s*##\s", line):
            break
        m = label.match(line)
        if m and m[1] == STATUS_LABEL:
            said = text[at + m.end() : at + len(line)]
            shown = said.strip().rstrip("*").rstrip()
            begin = at + m.end() + len(said) - len(said.lstrip())
            in_force = (begin, begin + len(shown), shown)
        elif m:
            for d in re.finditer(_DATE, line[m.end() :]):
                put(DATE_LABELS[m[1]], "header", at + m.end() + d.start(), at + m.end() + d.end())
        at += len(line)
    own_title = re.search(r"(?m)^#\s+([^\n]+)", head)
    names = NOTICE_NAMES if any(w in (own_title[1] if own_title else title) for w in NOTICE_WORDS) else OWN_NAMES
    for own in re.finditer(f"本(?:{'|'.join(names)})" + r"\s*的?\s*[将已]?\s*(?=[于自]|有效)", plain):
        at, stop = own.end(), own.end() + len(re.match(r"[^。；;\n《]{0,240}", plain[own.end() : own.end() + 240])[0])
        while hit := next(((m, *rest) for p, *rest in CLAUSES if (m := p.match(plain, at, stop))), None):
            m, name, kind, inclusive = hit
            how = m.groupdict().get("how") or ""
            put(name, {"首次": "first_effective"}.get(how, "latest_effective" if how.startswith("最新") else kind), *m.span("d"), inclusive)
            at = m.end()
            if kind == "validity_range" and (end := _RANGE_END.match(plain, at, stop)):
                put("valid_until", kind, *end.span("d"), True)
                at = end.end()
            # The next action of the document follows a comma.
            at += len(re.match(r"[^，,]*[，,]\s*|", plain[at:stop])[0])
    if own_title and (mark := re.search(rf"[\[【]({_DATE})\s*已失效[\]】]", own_title[1])):
        put("valid_until", "title_expiry", own_title.start(1) + mark.start(1), own_title.start(1) + mark.end(1))
    return Dates({name: sorted(x.values(), key=lambda c: c[:2]) for name, x in found.items()}, in_force)


def resolve(text: str, title: str = "", given: dict[str, datetime] | None = None, excluded: Iterable[tuple[int, int]] = ()) -> Resolved:
    """The dates of a document; ``given`` has values that a person set, which stand.

    A first coming into force counts only where no later one is named. The status is
    manual, extracted, or review (without an instant) where evidence differs, can not be
    read, is more than MOST_CANDIDATES, or ends before it begins. Fields that nothing
    dates are absent.
    """
    said, given = date_candidates(text, title, excluded), given or {}
    out = Resolved(in_force=said.in_force[2] if said.in_force else None)
    for name, every in said.candidates.items():
        used = [c for c in every if c[2] != "first_effective"] or every
        place = used[0][0] if used else None
        if len(every) > MOST_CANDIDATES:
            out.warnings.append(f"{name}_candidate_limit")
        if given.get(name) is not None:
            out.fields[name] = (given[name], place, "manual")
        elif used:
            values = {c[3] for c in used}
            sure = len(values) == 1 and None not in values and len(every) <= MOST_CANDIDATES
            out.fields[name] = (values.pop() if sure else None, place, "extracted" if sure else "review")
    a, b = out.fields.get("valid_from"), out.fields.get("valid_until")
    if a and b and a[0] and b[0] and a[0] >= b[0]:
        out.warnings.append("reversed_interval")
        for name, f in (("valid_from", a), ("valid_until", b)):
            if f[2] != "manual":
                out.fields[name] = (None, f[1], "review")
    end = out.fields.get("valid_until")
    if said.in_force:
        if any(w in said.in_force[2] for w in EXPIRED_WORDS) and not (end and end[0]):
            out.warnings.append("expired_status_without_date")
        if said.in_force[2] == IN_FORCE and any(c[2] == "title_expiry" for c in said.candidates["valid_until"]):
            out.warnings.append("title_status_conflict")
    return out


def document_dates(text: str, title: str = "") -> dict[str, tuple[datetime | None, int, str]]:
    return resolve(text, title).fields


def _naive(at: datetime | None) -> datetime | None:
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at is not None and at.tzinfo else at


def resolved(docs: DataFrame, id_col: str, text_col: str, title_col: str | None = None, given: dict[str, str] | None = None) -> DataFrame:
    """``id, in_force, warnings, fields``: the dates of each document.

    ``given``: columns with values that a person set, by field. Null texts date nothing.
    """
    kind = dict(docs.dtypes)[id_col]
    given = given or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                set_by_hand = {n: pd.Timestamp(r[f"given_{n}"]).to_pydatetime().replace(tzinfo=timezone.utc) for n in given if not pd.isna(r[f"given_{n}"])}
                found = resolve(r["text"] or "", r["title"] or "", set_by_hand)
                fields = [{"field": n, "value": _naive(at), "place": place, "status": status} for n, (at, place, status) in found.fields.items()]
                rows.append((r["id"], found.in_force, found.warnings, fields))
            yield pd.DataFrame(rows, columns=["id", "in_force", "warnings", "fields"])

    title = F.col(title_col) if title_col else F.lit("")
    taken = [F.col(c).cast("timestamp_ntz").alias(f"given_{n}") for n, c in given.items()]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), title.alias("title"), *taken).mapInPandas(
        run, f"id {kind}, in_force string, warnings array<string>, fields array<struct<field string, value timestamp_ntz, place int, status string>>"
    )


def dated(docs: DataFrame, id_col: str, text_col: str, title_col: str | None = None, given: dict[str, str] | None = None) -> DataFrame:
    """``id, field, value, place, status``: a row for each dated field of a document."""
    return resolved(docs, id_col, text_col, title_col, given).select("id", F.inline("fields"))
