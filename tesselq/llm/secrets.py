"""Secrets in texts: fixed patterns, and dictionary-primed zstandard novelty.

Novelty: a candidate is any run of token characters that begins shortly after a sensitive word or the
name that the word is part of; "=" ends a run, but for padding at a value's end. A candidate's
marginal cost is what zstandard needs for the surrounding text with the candidate, less what it needs
without, both primed with a dictionary of identifiers: common ones, and the parts of names that stand
around sensitive words in the corpus (``learn_identifiers``). Names and prose are cheap, as the
dictionary or the surroundings hold their parts; a key is not. Candidates whose marginal bytes exceed
``NOVELTY`` of their length are reported, unless a pattern's span already covers them.

Each text is walked once, so the time is linear in its length, whatever stands in it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, table, utf8

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    rb"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    rb"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
IS_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16

SENSITIVE = re.compile(rb"passw(?:or)?d|passphrase|pwd|secret|token|api[_ -]?key|credential|bearer|authorization|private[_ -]?key|access[_ -]?key|client[_ -]?key")
SENSITIVE_PARTS = (b"passw", b"passphrase", b"pwd", b"secret", b"token", b"api", b"credential", b"bearer", b"authorization", b"key")
#: Runs of token characters, padding included; CANDIDATE_MIN characters before the padding make a candidate.
RUN = re.compile(rb"([A-Za-z0-9+/_.~-]+)(?:={1,2}(?![A-Za-z0-9+/_.=~-]))?")
CANDIDATE_MIN = 16
MIXED = re.compile(rb"[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]")
#: Bytes between the sensitive word, or the name that it is part of, and the start of a candidate; bytes of surroundings on either side; share of incompressible bytes.
REACH, AROUND, NOVELTY = 32, 256, 0.7
#: Parts of names: words of letters between others' borders. Random strings hold few letters in a row.
PART = re.compile(rb"[A-Z]?[a-z]{3,24}|[A-Z]{4,24}")
#: Learned identifiers: how many go into the dictionary, and texts that must hold one.
LEARNED, LEARNED_TEXTS = 2000, 2
IDENTIFIERS = """
abstract access account action address admin alias allow amount api app application apply args argument array assert async
attribute auth authorization await base64 batch bearer begin boolean bucket buffer build bytes cache callback catch channel char
class client clone code collection column command commit config configuration connect connection console const constructor
container content context controller cookie count create credential current customer data database date debug decode default
define delete deploy description destination directory disable document domain double download driver element enable encode
encrypt endpoint entity environment error event exception execute export expression extends false field file filter final float
folder format from function generate get global group handler hash header hidden host http https identifier image import include
index info initialize input insert instance integer interface internal interval invalid item iterator java javascript json key
label language length level library license line link list listener load local location logger login long main manager map master
message metadata method model module name namespace network node null number object offset open operation option order output
package page parameter params parent parse parser passphrase password path payload permission plugin pointer policy port
position prefix primary print private process production profile project property protected protocol provider proxy public query
queue random read record reference region register release remote remove render report request require reset resource response
result return role root route runtime sample save schema scope script search secret select self sequence server service session
setting setup shared signature size socket source standard start state static status storage stream string struct submit success
super switch system table target template temp test text thread throw timeout timestamp title token transaction transform true
type undefined unique update upload url user username utf8 util valid validate value variable vector version view void warning
window worker write xml yaml
""".encode()  # fmt: skip


class Novelty:
    """share(text, start, end): marginal compressed bytes of the candidate by its length. ``learned``: identifiers besides the common ones, most frequent last."""

    def __init__(self, learned: bytes = b"") -> None:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS + learned, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.cost = zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False).compress

    def share(self, text: bytes, start: int, end: int) -> float:
        # In lower case, as the dictionary is; capitals would make names as dear as keys.
        around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).lower()
        return (len(self.cost(around + text[start:end].lower())) - len(self.cost(around))) / (end - start)


def is_sensitive(lower: bytes) -> bool:
    return any(x in lower for x in SENSITIVE_PARTS)


def learn_identifiers(docs: DataFrame) -> bytes:
    """The ``LEARNED`` most frequent parts of names around sensitive words, over all texts of ``docs``, blank-joined, most frequent last.

    A part counts once a text and must be in ``LEARNED_TEXTS`` texts. Counts are added up in the tasks, then by a shuffle;
    ties go by the part itself, so the dictionary is the same on every run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([x.decode() for x in count], pa.string()), "n": pa.array(list(count.values()), pa.int64())})

        for part in rows_of(batches, 4_000_000):
            for text in utf8(part.column("text")):
                lower = text.lower()
                if not is_sensitive(lower):
                    continue
                found: set[bytes] = set()
                at = 0
                for m in SENSITIVE.finditer(lower):
                    found.update(PART.findall(text, max(at, m.start() - AROUND), m.end() + AROUND))
                    at = m.end() + AROUND
                count.update(x.lower() for x in found)
            if len(count) > 200_000:
                yield out()
                count.clear()
        yield out()

    counts = docs.select("text").mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") >= LEARNED_TEXTS)
    rows = counts.orderBy(F.col("n").desc(), "part").limit(LEARNED).collect()
    return b" ".join([b"", *(r["part"].encode() for r in reversed(rows))])


def novel_spans(text: bytes, lower: bytes, known: list[tuple[int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Spans of kind 3; ``known`` are the patterns' spans, which hide candidates that they touch."""
    # Of overlapping spans in order of start, the greatest end so far tells whether any reaches beyond a place.
    starts, reach, far = [a for a, _ in known], [], 0
    for _, b in known:
        far = max(far, b)
        reach.append(far)
    found: list[tuple[int, int, int]] = []
    words = SENSITIVE.finditer(lower)
    word, name, at = next(words, None), None, 0
    while word or name is not None:
        if name is None:  # on to the run that the next word stands in
            at = max(at, text.rfind(b" ", at, word.start()) + 1)
        m = RUN.search(text, at)
        if not m:
            break
        (start, end), at = m.span(1), m.end()
        if name is not None and start > name + REACH:
            name = None
        # One case of letters is prose or a name.
        if name is not None and end - start >= CANDIDATE_MIN and MIXED.search(text, start, end):
            i = bisect_left(starts, at)
            if not (i and reach[i - 1] > start) and novelty.share(text, start, end) > NOVELTY:
                found.append((start, 3, at))
        # A run that holds a word, or goes on from one, ends its name.
        while word and word.end() <= end:
            name, word = end, next(words, None)
    return found


def spans_of(text: bytes, novelty: Novelty) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind, in code points of the UTF-8 ``text``."""
    found: list[tuple[int, int, int]] = []
    lower = text.lower()
    if any(x in lower for x in (b"passw", b"secret", b"token", b"api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    if b"x" * HEX_MIN in text.translate(IS_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_MIN]
    if is_sensitive(lower):
        found += novel_spans(text, lower, sorted((a, b) for a, _, b in found), novelty)
    found.sort()
    if found and not text.isascii():
        at = {0: 0}
        last = 0
        for b in sorted({x for a, _, e in found for x in (a, e)}):
            at[b] = at[last] + len(text[last:b].decode())
            last = b
        found = [(at[a], k, at[e]) for a, k, e in found]
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts by kind, base_sha256 and all spans.

    A span is kind:start:end in code points, end exclusive, of the whole match (of ``assign``, its name
    included). Null and empty texts have no spans. Repeated rows come out as often as they go in; null
    ids stay null; other columns are ignored; an empty table gives no rows.
    """

    learned = learn_identifiers(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(learned)
        for part in rows_of(batches, 4_000_000):
            found = [spans_of(t, novelty) for t in utf8(part.column("text"))]
            base = [[s for s in x if s[1] < 3] for x in found]
            count = lambda kind: pa.array([sum(s[1] == kind for s in x) for x in found], pa.int64())
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").combine_chunks(), "n_assign": count(0), "n_access": count(1), "n_hex": count(2),
                "base_sha256": pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()),
                "spans": pa.array([joined(x) for x in found], pa.string()), "n_novel": count(3),
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``, touching or overlapping spans by one; all rows and columns stay.

    n_chars, where there is one, becomes the new length of changed texts. Null texts stay null.
    """
    counted = "n_chars" in docs.columns

    learned = learn_identifiers(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(learned)
        for part in rows_of(batches, 4_000_000):
            texts = part.column("text").to_pylist()
            chars = part.column("n_chars").to_pylist() if counted else []
            for i, text in enumerate(texts):
                spans = spans_of(text.encode(), novelty) if text else []
                if not spans:
                    continue
                out, at = [], 0
                for a, _, b in spans:
                    if a > at or not out:
                        out += [text[at:a], mask]
                    at = max(at, b)
                texts[i] = "".join(out) + text[at:]
                if counted:
                    chars[i] = len(texts[i])
            new = part.set_column(part.column_names.index("text"), "text", pa.array(texts, pa.string()))
            if counted:
                k = part.column_names.index("n_chars")
                new = new.set_column(k, "n_chars", pa.array(chars, part.schema.field(k).type))
            yield from new.combine_chunks().to_batches()

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
