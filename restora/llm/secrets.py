"""Secret scanning: fixed patterns, and a token-efficiency test for random strings.

A tokenizer trained on ordinary text spells words with few tokens and random strings with many, so a
low number of characters per token exposes keys and passwords.  Candidates are runs of 16 or more key
characters.  Known digests are left out: strings that are given as known, UUIDs, and hexadecimal of a digest's
length behind a word that announces one (`sha256:`, `commit`).  So are identifiers: runs whose parts are each
words or numbers.  The ratio judges all the rest, letters alone and short runs more strictly (LIMITS); a single long
word of one case, which an identifier may be, counts as random only below the strictest of them.

Results for special cases: null or empty text has no spans; spans are in code points, end exclusive;
equal spans of different kinds are all listed, at one start in the order of KINDS.  A random span that a fixed pattern's
span contains is not listed again.  Equal rows each have their spans; texts of any length are read whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restora.llm.textkit import field, pieces

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Each text that has a span matches one of these; RE2 runs them over whole Arrow columns.
_SIEVE = (r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}", r"[A-Za-z0-9+/_=-]{16}")
_DIGEST = re.compile(r"([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})")
#: Words that announce a digest, and what may stand between; looked for in the ANNOUNCED characters before a run, or inside it ("sha256-...").
_ANNOUNCED = re.compile(r"(?:sha-?\d{1,3}|md5|commit|revision|checksum|digest|fingerprint|etag)[\"']?[\s:=(]{1,4}[\"']?$", re.IGNORECASE)
ANNOUNCED = 24
#: Characters per token below which a run is random: letters and digits, the same in under SHORT characters, letters alone, and one word of one case.
LIMITS, SHORT = {"mixed": 2.5, "short": 2.0, "letters": 2.0, "word": 1.4}, 20
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Every part is matched in one way only and never given back, so that the time is linear in the run's length.
_PART = r"(?:[A-Z]?[a-z]++(?:[A-Z][a-z]++)*+\d{0,4}+|[A-Z]++\d{0,4}+|\d++)"
_IDENTIFIER = re.compile(rf"[/_=+-]*+{_PART}(?:[/_=+-]++{_PART})*+[/_=+-]*+")

_ENCODERS: dict[str | None, object] = {}


def encoder(path: str | None):
    """tiktoken over a public rank file."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the fixed patterns find, sorted."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def kind_of_run(run: str) -> str | None:
    """The key in LIMITS that judges a run; None for what is never random: numbers, and identifiers of several parts or of under SHORT characters."""
    if not any(map(str.isalpha, run)):
        return None
    if _IDENTIFIER.fullmatch(run):
        one = run.isalpha() and (run.islower() or run.isupper())
        return "word" if one and len(run) >= SHORT else None
    if not any(map(str.isdigit, run)):
        return "letters"
    return "mixed" if len(run) >= SHORT else "short"


def known_digest(text: str, start: int, run: str, known: frozenset[str]) -> bool:
    """Whether a run is a digest that somebody announces or knows."""
    return run in known or _UUID.fullmatch(run) is not None or (_DIGEST.fullmatch(run) is not None and _ANNOUNCED.search(text[max(0, start - ANNOUNCED) : start]) is not None)


def random_spans(text: str, base: list[tuple[int, int, int]], limits: dict[str, float], path: str | None = None, known: frozenset[str] = frozenset()) -> list[tuple[int, int, int]]:
    """Spans of runs with fewer characters per token than their limit."""
    out = []
    of = [[(s, e) for s, k, e in base if k == kind] for kind in range(3)]  # those of one kind don't overlap
    for m in _RUN.finditer(text):
        run, start, end = m[0], m.start(), m.end()
        kind = kind_of_run(run)
        if kind is None or known_digest(text, start, run, known):
            continue
        before = [spans[i - 1] for spans in of if (i := bisect_right(spans, (start, len(text) + 1)))]
        if any(end <= e for _, e in before):
            continue
        if len(run) < limits[kind] * len(encoder(path).encode_ordinary(run)):
            out.append((start, 3, end))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """text with every span replaced by mark, but for digests that stand alone."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if k == 2 and _DIGEST.fullmatch(text[s:e]):
            continue
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def scanned(docs: DataFrame, limits: dict[str, float] = LIMITS, mark: str = "[SECRET]", vocabulary_path: str | None = None, redact: bool = False, known: frozenset[str] = frozenset()) -> DataFrame:
    """The columns of docs plus n_assign, n_access, n_hex, n_random, base_sha256 and spans; with redact, text has marks for secrets.

    known: digests and keys that are no secrets, a list of bounded size that goes to every task.
    """
    added = {"n_assign": "long", "n_access": "long", "n_hex": "long", "n_random": "long", "base_sha256": "string", "spans": "string"}
    docs = docs.drop(*added)
    names, none = docs.columns, hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            text = field(batch, "text")
            maybe = [False] * batch.num_rows
            for pattern in _SIEVE:
                maybe = [a or bool(b) for a, b in zip(maybe, pc.match_substring_regex(text, pattern).to_pylist(), strict=True)]
            rows, texts = [(0, 0, 0, 0, none, "")] * batch.num_rows, {}
            for i, may in enumerate(maybe):
                if may and (t := text[i].as_py()):
                    base = base_spans(t)
                    more = random_spans(t, base, limits, vocabulary_path, known)
                    n = [sum(k == j for _, k, _ in base) for j in range(3)]
                    rows[i] = (*n, len(more), hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + more)))
                    if redact and (base or more):
                        texts[i] = redacted(t, base + more, mark)
            columns = {n: field(batch, n) for n in names}
            if texts:
                columns["text"] = pa.array([texts.get(i, t) for i, t in enumerate(text.to_pylist())], text.type)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*columns.values(), *(pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds))], names=[*names, *added])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType() if k == "long" else T.StringType()) for n, k in added.items())]))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of the fixed patterns' spans, and all spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scanned(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")
