"""Loads public tokenizer vocabularies inside Python workers."""

from __future__ import annotations

import base64
import re

import numpy as np

from .common import BYTE_BPE_PATTERN, VOCAB_DIR


#: Characters that ``\\s`` matches in the split pattern (the Unicode property White_Space), as a class.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class ByteBpe:
    """A byte-level BPE encoder that takes texts of any length and shape.

    The split pattern looks ahead after white space, for which its engine needs stack in proportion to a run.  Runs of
    ``long_run`` and more are therefore cut where the pattern would: a run is one piece, but for its last
    character if more text follows.  The ids are those of the uncut text.
    """

    def __init__(self, encoding, long_run: int = 10_000) -> None:
        self.encoding, self.least = encoding, long_run
        self.runs = re.compile(f"[{WHITE_SPACE}]{{{long_run},}}")

    @property
    def largest_id(self) -> int:
        return self.encoding.max_token_value

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text; none for null."""
        if not text:
            return np.empty(0, np.uint32)
        if len(text) < self.least:
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        parts, at = [], 0
        for m in self.runs.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            parts += [self._plain(text[at : m.start()]), np.array(self.encoding._encode_single_piece(text[m.start() : end]), np.uint32)]
            at = end
        return np.concatenate([*parts, self._plain(text[at:])])

    def _plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids) -> str:
        return self.encoding.decode(list(ids))


def load_byte_bpe(vocab_dir: str = VOCAB_DIR, name: str = "byte_bpe_50k.tiktoken") -> ByteBpe:
    """A byte-level BPE encoder from a file of ``base64(token) rank`` lines."""
    import tiktoken

    with open(f"{vocab_dir}/{name}", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return ByteBpe(tiktoken.Encoding("public", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={}))


def load_pieces(vocab_dir: str = VOCAB_DIR, name: str = "piece_bpe_32k.model"):
    """A sentence-piece BPE processor with byte fallback."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=f"{vocab_dir}/{name}")
