"""Secret scan with multipart credential linking.

Three base kinds stand on their own: assign, access and hex. Beside them a credential
is often split up: an identifier here, a secret there, an endpoint next to it. Weak
parts of these roles are only reported where a complementary part lies near: within
each scope (a document) the parts' intervals, widened by a gap, are interval-joined
by one sweep over the sorted starts. A link names a weak part and its nearest partner,
so links grow with the parts, not with their pairs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewise.llm.common import over_texts, slices, small_batches, table

#: Characters that may lie between the parts of one credential.
GAP = 200
#: Bits a character that a value without a telling name must have to be a weak secret.
ENTROPY = 3.5

# The base kinds.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_CHARS, ACCESS_CHARS = 8, 16

#: Weak parts by role: what names an account, what may be a secret, where it is used.
WEAK = {
    "identifier": re.compile(r"""(?i:(?<![a-z0-9])(?:user(?:name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.ASCII),
    "candidate": re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"),
    "endpoint": re.compile(r"(?i:(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://)[^\s\"'<>]{3,}|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}:[0-9]{2,5}(?![0-9])", re.ASCII),
}
#: Order of kinds at one start.
KINDS = ("assign", "access", "hex", "identifier", "candidate", "endpoint")
#: What each kind is in a credential, and which roles complete it.
ROLE = {"assign": "secret", "hex": "secret", "candidate": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
COMPLETES = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base kinds in code points, leftmost and non-overlapping for each
    kind; matches that are too short use up their text and are dropped."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def weak_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts that overlap no base span."""
    found = []
    for kind, pattern in WEAK.items():
        for m in pattern.finditer(text):
            if kind != "candidate" or entropy(m[0]) >= ENTROPY:
                found.append((m.start(), m.end(), kind))
    found.sort()
    out, k = [], 0
    ends = [0]  # ends[j]: largest end of the first j base spans
    for _, end, _ in base:
        ends.append(max(ends[-1], end))
    starts = [s for s, _, _ in base]
    for start, end, kind in found:
        k = bisect_left(starts, end)
        if ends[k] <= start:
            out.append((start, end, kind))
    return out


def links(parts: list[tuple[int, int, str]], gap: int = GAP) -> list[tuple[int, int, int]]:
    """Interval join of one scope's parts, sorted by start: for each part and each role
    that completes its own, (part, nearest partner, distance) with at most gap between.

    One sweep in each direction keeps the part of each role that reaches furthest
    right (or starts soonest); a part that is further away is never nearer."""
    best: dict[tuple[int, str], tuple[int, int]] = {}
    furthest: dict[str, tuple[int, int]] = {}
    for i, (start, end, kind) in enumerate(parts):
        for role in COMPLETES[ROLE[kind]]:
            if role in furthest and (d := max(0, start - furthest[role][0])) <= gap:
                best[i, role] = (d, furthest[role][1])
        furthest[ROLE[kind]] = max(furthest.get(ROLE[kind], (-1, -1)), (end, i))
    soonest: dict[str, tuple[int, int]] = {}
    for i in range(len(parts) - 1, -1, -1):
        start, end, kind = parts[i]
        for role in COMPLETES[ROLE[kind]]:
            if role in soonest and (d := max(0, soonest[role][0] - end)) <= gap:
                best[i, role] = min(best.get((i, role), (gap + 1, 0)), (d, soonest[role][1]))
        soonest[ROLE[kind]] = (start, i)
    return sorted((i, j, d) for (i, _), (d, j) in best.items())


def scan_text(text: str, gap: int = GAP) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int]]]:
    """All reported spans of a text and the links among them (by place in the list)."""
    base = base_spans(text)
    weak = weak_spans(text, base)
    if not weak:
        return base, links(base, gap)
    parts = sorted(base + weak, key=lambda s: (s[0], KINDS.index(s[2])))
    joined = links(parts, gap)
    linked = {i for i, _, _ in joined} | {j for _, j, _ in joined}
    keep = [i for i, (_, _, kind) in enumerate(parts) if kind not in WEAK or i in linked]
    place = {i: k for k, i in enumerate(keep)}
    return [parts[i] for i in keep], [(place[i], place[j], d) for i, j, d in joined]


SPANS = "spans array<struct<kind: string, start: int, end: int>>, links array<struct<part: int, partner: int, distance: int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_LINK = pa.list_(pa.struct([("part", pa.int32()), ("partner", pa.int32()), ("distance", pa.int32())]))


def scan(docs: DataFrame, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, links) for every row, in one narrow pass over whole texts.

    Spans are in code points, ends exclusive, by start and then kind. A null text is
    empty: no spans. One row out per row in, repeated and null ids too; columns other
    than id and text are not read."""

    def work(texts):
        found = [scan_text(t.decode(), gap) if t else ([], []) for t in texts]
        return {
            "spans": pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in spans] for spans, _ in found], _SPAN),
            "links": pa.array([[{"part": i, "partner": j, "distance": d} for i, j, d in joined] for _, joined in found], _LINK),
        }

    return over_texts(docs, work, SPANS, id_col, text_col)


def joined_spans(kinds: tuple[str, ...] | None = None, spans: str = "spans"):
    """kind:start:end of the spans (of some kinds), comma-joined in their order."""
    own = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, overlapping ones together, replaced by its kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, gap: int = GAP, text_col: str = "text") -> DataFrame:
    """docs, every row and column kept, with reported spans in the text replaced. Where
    nothing is found the text stays as it is; null stays null."""
    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def run(batches):
        for part in slices(batches, at):
            texts = [t if t is None else redact_text(t, scan_text(t, gap)[0]) for t in part.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()) if k == at else part.column(k) for k in range(part.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined_spans(KINDS[:3]), 256).alias("base_sha256"), joined_spans().alias("spans"))
