"""Secret scans: fixed patterns plus a token-efficiency test.

Three patterns find assignments, access keys and long hexadecimal runs.  On top of them the method
looks at every run of key-like characters: a byte-level BPE vocabulary packs words of any language it
knows into few tokens, but spends about one token on every one or two characters of a random string.
Runs with a low characters-per-token ratio are spans of kind ``opaque``, after known digests
(hexadecimal of a digest's length, UUIDs) and identifiers (names joined by separators, URLs, plain
words, numbers) are excluded.  An identifier is only excused if its groups of letters pack as words do: several groups are
tested together, in lower case and without their separators.  Where a whole run passes, its parts between separators are tested alone, so that
a readable path or name cannot hide a random part.  Letters of one case are tested in lower case, as words pack well there.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from .common import VOCAB_DIR, map_texts, table
from .tokenizer import load_byte_bpe

KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
#: One of these is in every assignment, in lower case; a cheap test before the pattern.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
DIGEST_CHARS = frozenset({32, 40, 56, 64, 96, 128})
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
HEX_ANY = re.compile(r"[0-9a-fA-F]+")
#: Letters alone (a word), digits alone (a number), or such parts joined by separators (an identifier or a path).
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[_/=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[_/=+-]*")
#: What is tested alone where a run passes as a whole.
PART = re.compile(r"[A-Za-z0-9+]{16,}")
ONE_CASE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CAMEL = re.compile(r"[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})+[0-9]{0,4}")
#: Least letters of a group, and of all groups of an identifier, that say how it packs; shorter ones cost a token each in any language.
GROUP_LETTERS, IDENTIFIER_LETTERS = 3, 12

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The spans of the three fixed patterns, by start and then by kind as listed."""
    found: list[Span] = []
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def is_known_digest(run: str) -> bool:
    """A digest or a number."""
    if HEX_ANY.fullmatch(run):
        return len(run) in DIGEST_CHARS or run.isdigit()
    return bool(UUID.fullmatch(run))


def is_opaque(run: str, count_tokens, max_ratio: float) -> bool:
    """Whether a run has ``max_ratio`` or fewer characters a token: all of it, or the groups of letters of an identifier."""
    if is_known_digest(run):
        return False
    if not HEX_ANY.fullmatch(run) and (IDENTIFIER.fullmatch(run) or CAMEL.fullmatch(run)):
        groups = [g.lower() for g in ONE_CASE.findall(run) if len(g) >= GROUP_LETTERS]
        letters = sum(map(len, groups))
        return len(groups) > 1 and letters >= IDENTIFIER_LETTERS and letters <= max_ratio * sum(map(count_tokens, groups))
    return len(run) <= max_ratio * count_tokens(run)


def opaque_spans(text: str, count_tokens, max_ratio: float) -> list[Span]:
    """Runs of 16 or more key characters at ``max_ratio`` or fewer characters a token, else such parts of a run."""
    out = []
    for m in RUN.finditer(text):
        run, at = m[0], m.start()
        if is_opaque(run, count_tokens, max_ratio):
            out.append((at, m.end(), "opaque"))
            continue
        for p in PART.finditer(run):
            part = p[0]
            if ONE_CASE.fullmatch(part):
                opaque = len(part) <= max_ratio * count_tokens(part.lower())
            else:
                opaque = len(part) < len(run) and is_opaque(part, count_tokens, max_ratio)
            if opaque:
                out.append((at + p.start(), at + p.end(), "opaque"))
    return out


def _written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_chars_per_token: float = 2.0,
    vocabulary: str = "byte_bpe_50k.tiktoken",
    vocab_dir: str = VOCAB_DIR,
) -> DataFrame:
    """``id_col``, counts by kind, ``base_sha256`` and ``spans`` for every row.

    ``spans`` lists all spans as ``kind:start:end`` (code points, end exclusive) by start and then by
    kind (assign, access, hex, opaque).  Spans of different kinds may overlap; those of the fixed
    patterns always stay.  Null text counts as empty: no spans.  Repeated rows come back once each; an empty table
    gives an empty table; other columns are not read.
    """

    def make():
        encoder = load_byte_bpe(vocab_dir, vocabulary)

        def work(texts: list[str | None]) -> dict:
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_opaque", "base_sha256", "spans")}
            for text in texts:
                text = text or ""
                base = base_spans(text)
                more = opaque_spans(text, encoder.count, max_chars_per_token)
                spans = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(s[2] == kind for s in spans))
                out["base_sha256"].append(hashlib.sha256(_written(base).encode()).hexdigest())
                out["spans"].append(_written(spans))
            return out

        return work

    return map_texts(
        docs,
        id_col,
        text_col,
        make,
        "n_assign bigint, n_access bigint, n_hex bigint, n_opaque bigint, base_sha256 string, spans string",
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
