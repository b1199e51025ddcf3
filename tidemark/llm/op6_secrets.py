"""Secrets: three fixed patterns, and a token-efficiency test for random strings.

The test looks at maximal runs of ``[A-Za-z0-9+/_=-]`` of CANDIDATE_LENGTH characters or
more.  A byte-pair vocabulary learned from ordinary text covers words with long tokens,
while random strings fall apart, so a run with few characters per token is reported as
kind ``random``.  Known harmless forms are left out before: digests (all hexadecimal, of
the usual lengths), UUIDs, plain numbers, and identifiers (words, or words joined by
``_``, ``-`` or camel case, in which no part mixes letters with digits), if all parts of
an identifier are words for the vocabulary too.

In a run that passes as a whole, the parts between ``+/_=-`` are tested as well, since a
long path of words would hide a random string.  Parts that are no words are joined with
their neighbours of that kind, and stretches of CANDIDATE_LENGTH or more are tested.

Spans are in code points, the end exclusive.  Base spans always stay; of a run that they
overlap, what is left on both sides is tested like runs of its own.

Defined cases: a null or empty text has no spans, and the digest of an empty text; a very
long text is read whole, in time that grows with its length; spans that start together come
in the order of their kinds; equal texts have equal results, also of rows that repeat a
doc_id or have none; an empty table gives no rows; other columns don't matter, whatever
their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")  # order of spans that start together
# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

CANDIDATE_LENGTH = 20
MAX_CHARS_PER_TOKEN = 2.2
SEPARATORS = "+/_=-"
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
_HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NUMBER = re.compile(r"[0-9+/_=-]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_PIECE = re.compile(rf"(?<![A-Za-z0-9]){_UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+")
WORD, EITHER, STRANGE = range(3)
SHORT = 3  # letters of a part that says nothing alone


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # A maximal run below 24 characters can't hold a match, so looking for long ones at once is the same.
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def known_form(run: str) -> bool:
    """Numbers, UUIDs and digests."""
    if _NUMBER.fullmatch(run) or _UUID.fullmatch(run):
        return True
    return bool(_HEXADECIMAL.fullmatch(run)) and len(run) in DIGEST_LENGTHS


def identifier(run: str) -> bool:
    """Whether a run is spelled like words."""
    parts = [p for p in re.split(r"[+/_=-]+", run) if p]
    if all(p.isalpha() for p in parts) and all(len(x) >= 2 for p in parts for x in _PART.findall(p)[:-1]):
        return all(p.islower() or p.isupper() or len(_PART.findall(p)) <= max(2, len(p) // 4) for p in parts)
    return False


def harmless(run: str) -> bool:
    """Forms of known digests and identifiers."""
    return known_form(run) or identifier(run)


def load_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def scattered(run: str, encoding, limit: float) -> bool:
    """Whether the vocabulary needs many tokens for a run."""
    return len(run) < limit * len(encoding.encode_ordinary(run))


def part_kind(part: str, encoding, limit: float) -> int:
    """Whether a part between separators is a word for the vocabulary, which knows capitals less well, or can be either."""
    if part.isdigit():
        return EITHER
    if known_form(part):
        return WORD
    plain = part.lower() if part.isupper() else part
    if len(encoding.encode_ordinary(plain)) == 1:
        return EITHER if len(part) <= SHORT else WORD
    return STRANGE if scattered(plain, encoding, limit) else WORD


def random_parts(run: str, pieces: list[tuple[int, int, int]], encoding, limit: float) -> list[tuple[int, int]]:
    """(start, end) of random stretches of a run: from a strange part to a strange part with no word between."""
    found, stretch = [], None
    for a, b, kind in [*pieces, (0, 0, WORD)]:
        if kind == STRANGE:
            stretch = (stretch[0] if stretch else a, b)
        elif kind == WORD and stretch:
            own = run[stretch[0] : stretch[1]]
            if len(own) >= CANDIDATE_LENGTH and not known_form(own) and scattered(own, encoding, limit):
                found.append(stretch)
            stretch = None
    return found


def free_parts(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What ``taken``, in order, leave of a run; without the separators beside them."""
    out, at = [], start
    for a, b in [*taken, (end, end)]:
        if a > at:
            out.append((at, min(a, end)))
        at = max(at, b)
    return out


def random_runs(text: str, taken: list[tuple[int, int, int]], encoding, limit: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of random strings; ``taken`` are the base spans, in order."""
    found, seen, covered = [], 0, []
    for m in RUN.finditer(text):
        while seen < len(taken) and taken[seen][0] < m.end():
            covered.append((taken[seen][0], taken[seen][2]))
            seen += 1
        covered = [x for x in covered if x[1] > m.start()]  # a span may reach over several runs
        if not covered:
            found += judged(m[0], m.start(), encoding, limit)
            continue
        for a, b in free_parts(m.start(), m.end(), covered):
            part = text[a:b]
            if b < m.end():
                part = part.rstrip(SEPARATORS)
            if a > m.start():
                part, a = part.lstrip(SEPARATORS), a + len(part) - len(part.lstrip(SEPARATORS))
            if len(part) >= CANDIDATE_LENGTH:
                found += judged(part, a, encoding, limit)
    return found


def judged(run: str, start: int, encoding, limit: float) -> list[tuple[int, int, int]]:
    """The random spans of one run that begins at ``start``: the whole, or parts of it."""
    if known_form(run):
        return []
    pieces = [(p.start(), p.end(), part_kind(p[0], encoding, limit)) for p in _PIECE.finditer(run)]
    words = all(kind != STRANGE for _, _, kind in pieces)
    if scattered(run, encoding, limit) and not (words and identifier(run)):
        return [(start, 3, start + len(run))]
    return [] if words else [(start + a, 3, start + b) for a, b in random_parts(run, pieces, encoding, limit)]


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(documents: DataFrame, ranks_path: str | None = None, pattern: str | None = None, limit: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """doc_id, secrets: array of (kind, start, end, value), one row per document."""
    if ranks_path is None or pattern is None:
        import public_tokenizers as P

        ranks_path, pattern = ranks_path or P.path("byte_bpe_50k.tiktoken"), pattern or P.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks_path, pattern)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                spans = sorted(spans + random_runs(text, spans, encoding, limit))
                out.append([{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(kind))], ["doc_id", "secrets"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, secrets array<struct<kind: string, start: long, end: long, value: string>>")


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    found = find_secrets(table(spark, sf_dir, "documents"))
    spell_all = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spell_all(base).cast("binary"), 256).alias("base_sha256"), spell_all(F.col("secrets")).alias("spans"), count("random"))
