"""Public tokenizers in tasks: token ids of texts, and the bytes that each token stands for."""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

# The fast pattern matcher gives up on runs of some million white characters; texts with such a run take the other path.
LONG_TEXT, LONG_RUN = 100_000, 50_000
_blank_run = re.compile(r"\s{%d}" % LONG_RUN).search


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of a byte-level BPE vocabulary in a tokenizer file.

    Where the file's merges make the ids in order, ids are the merges' ranks and texts are encoded from those; ids are the same
    either way. ``plain`` takes the special tokens' strings inside texts as ordinary text.
    """

    def __init__(self, path: str, plain: bool = False) -> None:
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        letters = byte_letters()
        spell = lambda piece: bytes(letters[c] for c in piece)
        ranks = {spell(piece): i for piece, i in model["vocab"].items() if piece not in special}
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        self.bytes = [b""] * (1 + max(model["vocab"].values()))
        for piece, i in ranks.items():
            self.bytes[i] = piece
        made = [model["vocab"][piece] for piece in joined]
        self.fast = None
        if made == sorted(set(made)) and len(made) == len(ranks) - 256:
            self.fast = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={} if plain else special)
        self.allowed = set() if plain else "all"

    def ids(self, text: str) -> np.ndarray:
        """Ids of the whole text, unsigned 32-bit."""
        if self.fast is None or len(text) > LONG_TEXT and _blank_run(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit."""
        return self.ids(text).astype("<u4", copy=False).tobytes()


class Pieces:
    """Token ids of a sentence-piece model with byte fallback, and the bytes of each of its pieces."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.uint32)


def decoded(text: bytes) -> str:
    """Text of UTF-8; what is not UTF-8 becomes the replacement character."""
    return text.decode("utf-8", "replace")
