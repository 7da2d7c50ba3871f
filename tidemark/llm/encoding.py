"""Fast exact encoding with BPE models of the tokenizers library.

A BPE model merges inside one piece of pre-tokenized text at a time, and equal
pieces always give equal ids. So a text is split at spaces, each distinct word
is encoded once by the library's model, and the ids of a text are the joined ids
of its words. Texts where a cut at a space could change the pieces (runs of
spaces, special tokens, control separators) go whole through the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import regex

from tidemark.llm.shared import remembered

#: The pattern by which byte-level pre-tokenization splits text (fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SEPARATORS = ["\x1c", "\x1d", "\x1e", "\x1f"]
_ODD_ASCII = [" " + c for c in " \t\n\v\f\r"]
_ODD_SPACE = re.compile(r" \s| $|^\s")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    bytes stand for themselves, the others for code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordEncoder:
    """Encodes texts to little-endian id bytes; keeps ids of the last ``most`` words,
    half as many pieces, and as many of both before them, from which those still in
    use come back (memory stays bounded)."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.odd = [*_SEPARATORS, *(t["content"] for t in spec.get("added_tokens", []))]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        parts = (spec.get("normalizer") or {}).get("normalizers") or []
        self.lowers = [p.get("type") for p in parts] == ["NFC", "Replace", "Lowercase"]  # on ASCII words: lower-casing alone
        self.most, self.words, self.pieces = most, {}, {}
        self.older_words, self.older_pieces = {}, {}
        self.letters = {chr(i): c for i, c in enumerate(_byte_letters())}
        self.pattern, self.keeps_space = self._splitter(spec)

    def _splitter(self, spec: dict):
        """The piece pattern, and whether a space belongs to the word after it.
        No pattern: an unknown kind of tokenizer, all texts go whole."""
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        if model.get("type") != "BPE" or spec.get("post_processor") and spec["post_processor"].get("type") != "ByteLevel":
            return None, False
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            return regex.compile(BYTE_LEVEL), True
        parts = pre.get("pretokenizers") or []
        if len(parts) == 2 and parts[0].get("type") == "Split" and parts[0].get("invert") and parts[0].get("behavior") == "Removed" and parts[1].get("type") == "ByteLevel" and not parts[1].get("use_regex", True) and not parts[1].get("add_prefix_space"):
            return regex.compile(parts[0]["pattern"]["Regex"]), False
        return None, False

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = self.older_pieces.get(piece) or self._tokens(piece)
        return ids

    def _tokens(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            mapped = piece.replace(" ", self.letters[" "])
        else:
            mapped = "".join(map(self.letters.__getitem__, piece.encode().decode("latin-1")))
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def _word(self, word: str, lead: str) -> bytes:
        """Ids of a word after ``lead`` (a space or nothing)."""
        if self.tokenizer.normalizer is not None:
            word = word.lower() if word.isascii() and self.lowers else self.tokenizer.normalizer.normalize_str(word)
        if word.isalpha():
            return self._piece(lead + word)
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return self._piece(lead + word[:-1]) + self._piece(word[-1])
        return b"".join(map(self._piece, self.pattern.findall(lead + word)))

    def _cuttable(self, text: str) -> bool:
        if self.pattern is None or any(s in text for s in self.odd):
            return False
        if not self.keeps_space:
            return True
        if not text.isascii():
            return not _ODD_SPACE.search(text)
        return text[-1] != " " and not text[0].isspace() and not any(s in text for s in _ODD_ASCII)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of ``dtype``; null: empty."""
        lead, out = " " if self.keeps_space else "", []
        for text in texts:
            if len(self.words) >= self.most:
                self.older_words, self.words = self.words, {}
            if 2 * len(self.pieces) >= self.most:
                self.older_pieces, self.pieces = self.pieces, {}
            if not text:
                out.append(b"")
            elif not self._cuttable(text):
                out.append(self._whole(text))
            elif self.keeps_space:
                first, *rest = text.split(" ")
                out.append(self._word(first, "") + self._joined(rest, lead))
            else:
                out.append(self._joined(text.split(), lead))
        return out

    def _joined(self, cut: list[str], lead: str) -> bytes:
        ids = list(map(self.words.get, cut))
        if None in ids:
            for i, x in enumerate(ids):
                if x is None:
                    w = cut[i]
                    old = self.older_words.get(w)
                    ids[i] = self.words[w] = self._word(w, lead) if old is None else old
        return b"".join(ids)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; reused by later tasks."""
    return remembered(path, lambda: WordEncoder(path))
