"""Token ids by public vocabularies whose files are found by a path parameter."""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np

#: The splitting pattern looks ahead over white space step by step; longer runs than this go to the plain tokenizer.
LONG_SPACE = re.compile(r"\s{1000}")


class Encoder:
    """Ids of one byte-level BPE vocabulary, as the tokenizers library gives them.

    ``path`` names the library's ``.json`` file. ``ids`` are those of ``encode(text,
    add_special_tokens=False)``, so a special token's string in a text becomes its one id;
    ``ordinary_ids`` take such a string as plain text. Texts
    without such a string are split by tiktoken where the file of ranks lies beside the ``.json``:
    it gives the same ids in a quarter of the time. It cannot take very long runs of white space, which
    stay with the tokenizers library, as does every text where there is no file of ranks.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        whole, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        plain.encode_special_tokens = True
        self._whole = lambda text: whole.encode(text, add_special_tokens=False).ids
        self._slow = lambda text: plain.encode(text, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self._vocabulary: dict[str, int] = model["model"]["vocab"] | {x["content"]: x["id"] for x in model.get("added_tokens") or []}
        added = [x["content"] for x in model.get("added_tokens") or []]
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def _ids(self, text: str) -> list[int]:
        if self._added and self._added.search(text):
            return self._whole(text)
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        return self._slow(text) if self._fast is None or LONG_SPACE.search(text) else self._fast(text)

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self._ids(text), dtype=np.uint32)

    def ordinary_ids(self, text: str) -> np.ndarray:
        return np.asarray(self._plain(text), dtype=np.uint32)

    def count(self, text: str) -> int:
        return len(self._ids(text))

    def token_bytes(self) -> list[bytes]:
        """Every id's bytes, the byte-level alphabet decoded: printable bytes stand for themselves, the rest for U+0100 onwards."""
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        out = [b""] * (max(self._vocabulary.values()) + 1)
        for token, i in self._vocabulary.items():
            out[i] = bytes(byte_of[c] for c in token)
        return out


class Pieces:
    """Ids of one sentencepiece model, found by ``path``; the library puts a space before each text."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self._model.encode(text, num_threads=1), dtype=np.uint32)

    def token_bytes(self) -> list[bytes]:
        """Every id's bytes: the piece in UTF-8 with U+2581 as a space, or the one byte of ``<0xHH>``."""
        m = self._model
        return [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]
