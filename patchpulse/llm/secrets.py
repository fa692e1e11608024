"""Secret scans: fixed patterns, and runs of characters that a public tokenizer can hardly shorten."""

from __future__ import annotations

import base64
import hashlib
import re

import tiktoken
from pyspark.sql import DataFrame

from .common import scan, texts_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual way of cutting text for this vocabulary; a fixed value.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fixed patterns of the three base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs of 20 characters and more
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "dense")

#: A run of at least this many characters with fewer characters a token than this is a random string.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CHARS_PER_TOKEN = 2.0
#: What is known not to be secret: hashes by their length, identifiers of records and numbers.
DIGEST = re.compile(r"(?:md5|sha1|sha256|sha384|sha512)[-_]?[A-Za-z0-9+/=]+|[0-9a-f]+|[0-9A-F]+")
DIGEST_CHARS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
JOINTS = re.compile(r"[+/_=-]+")
#: In names whose parts are all letters or all digits, parts of at least 2 letters are judged if they have 8 letters together.
PART_LETTERS, LEAST_LETTERS = 2, 8

SCHEMA = "doc_id: bigint, n_assign: bigint, n_access: bigint, n_hex: bigint, n_dense: bigint, base_sha256: string, spans: string"


def excluded(run: str) -> bool:
    if DIGEST.fullmatch(run) and (len(run) in DIGEST_CHARS or run[:3].lower() in ("md5", "sha")):
        return True
    return bool(UUID.fullmatch(run))


def is_dense(run: str, count, limit: float) -> bool:
    """Whether a run has fewer than ``limit`` characters a token. Names joined from words are judged by their words, as joints are tokens too."""
    if excluded(run):
        return False
    parts = [x for x in JOINTS.split(run) if x]
    if all(x.isalpha() or x.isdigit() for x in parts):
        words = [x for x in parts if len(x) >= PART_LETTERS and x.isalpha()]
        letters = sum(map(len, words))
        return letters >= LEAST_LETTERS and letters < limit * sum(map(count, words))
    return len(run) < limit * count(run)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def dense_spans(text: str, base: list[tuple[int, int, int]], count, limit: float) -> list[tuple[int, int, int]]:
    """Runs with few characters a token that no base span touches."""
    out, taken, at = [], sorted((a, b) for a, _, b in base), 0
    reached = 0  # the furthest end of base spans that start before the run's end
    for m in RUN.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reached = max(reached, taken[at][1])
            at += 1
        run = m.group()
        if reached <= m.start() and is_dense(run, count, limit):
            out.append((m.start(), 3, m.end()))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def token_counter(vocabulary: bytes):
    """A function from a text to its number of tokens."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    encoding = tiktoken.Encoding("secrets", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def secret_spans(docs: DataFrame, vocabulary_path: str = VOCABULARY, chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """Secrets in every whole text, as code point spans, end exclusive.

    Reads ``doc_id`` and ``text``; other columns are ignored. The base kinds are assignments to names such as ``password``, access
    keys and long hexadecimal runs, leftmost and non-overlapping for each kind. The kind ``dense`` adds runs of 20 and
    more key characters, outside base spans, that the tokenizer at ``vocabulary_path`` cuts into tokens of fewer than
    ``chars_per_token`` characters on average; digests of known lengths, record identifiers and numbers are left out. Where letters
    and digits do not mix between joints (``+/_=-``), the letters alone are judged, so that names made of words do not count. The driver reads the vocabulary (a fixed file of some hundred kilobytes) and broadcasts it.

    Null and empty texts have no spans. Spans that start together are ordered by kind. Repeated rows give repeated
    results; an empty table gives none.
    """
    with open(vocabulary_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def start():
        count = token_counter(sent.value)

        def work(batch):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_dense", "base_sha256", "spans")}
            for text in texts_of(batch):
                base = base_spans(text or "")
                dense = dense_spans(text or "", base, count, chars_per_token)
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(s[1] == k for s in base))
                out["n_dense"].append(len(dense))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(base + dense))
            yield {"doc_id": batch.column(0)} | out

        return work

    return scan(docs, ["doc_id", "text"], SCHEMA, start)
