"""Tokenizer ids of whole texts, as the tokenizers library gives them for a .json file, without added special tokens."""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The split of byte-level pre-tokenizers.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The split of the word-level pre-tokenizer read here, and the same over `_PLAIN` texts in lower case.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: White space, printable ASCII and accented Latin letters: lower case and classes are plain there. Anything else is not.
_OTHER = re.compile("[^\\x09-\\x0d\\x20-\\x7eÀ-ÖØ-öø-ÿ]")
END_OF_WORD = "</w>"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=16)
def version_digest(path: str) -> str:
    """Digest of a tokenizer file and of the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranks(vocab: dict[str, int], suffix: str | None) -> dict[bytes, int]:
    """Vocabulary by bytes; the end of a word is written as a blank, which no word holds."""
    letters = byte_letters()
    out = {}
    for token, i in vocab.items():
        last = suffix is not None and token.endswith(suffix)
        raw = bytes(letters[c] for c in (token[: -len(suffix)] if last else token))
        out[raw + b" " if last else raw] = i
    return out


class Coder:
    """Encodes as the tokenizers library does, without added special tokens.

    A file whose merges are in the order of their ids is byte-pair encoding by the ranks of the ids, which a faster
    encoder does over the file's own vocabulary; a word's end counts as one more byte, which the ids of final letters bind
    first. Texts that hold an added token's string, or letters beyond those whose lower case is plain, are left to the
    library, and so are files of other kinds. Nothing is kept from one text to the next.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", []))
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model.get("merges", [])]
        vocab = model.get("vocab", {})
        order = [vocab.get(a + b, -1) for a, b in merges] if model.get("type") == "BPE" else [-1]
        plain = plain and order == sorted(set(order)) and order[:1] != [-1] and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        suffix, parts, normal = model.get("end_of_word_suffix"), pre.get("pretokenizers", []), (spec.get("normalizer") or {}).get("normalizers", [])
        bytes_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and not suffix
        words = (
            suffix == END_OF_WORD and [x.get("type") for x in parts] == ["Split", "ByteLevel"] and parts[0].get("pattern") == {"Regex": WORD_SPLIT} and parts[0].get("behavior") == "Removed"
            and parts[0].get("invert") and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space") and [x.get("type") for x in normal] == ["NFC", "Replace", "Lowercase"]
            and normal[1].get("pattern") == {"Regex": r"\s+"} and normal[1].get("content") == " "
        )
        self.words = bool(words)
        self.fast = None
        if plain and (bytes_level or words):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str="[^ ]+ " if words else BYTE_SPLIT, mergeable_ranks=_ranks(vocab, suffix), special_tokens={})
        self._lib = None

    @property
    def lib(self):
        if self._lib is None:
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_file(self.path)
            self._lib.no_padding()
            self._lib.no_truncation()
        return self._lib

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if self.fast and not any(x in text for x in self.added):
            ready = text
            if self.words:
                plain = not _OTHER.search(text) and unicodedata.is_normalized("NFC", text)
                ready = "".join([x + " " for x in _WORDS.findall(text.lower())]) if plain else None
            if ready is not None:
                try:
                    return self.fast.encode_to_numpy(ready).astype("<u4", copy=False).tobytes()
                except ValueError:  # a run too long for its expressions
                    pass
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids_many(self, texts: list[str]) -> list[bytes]:
        return [self.ids(t) for t in texts]


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One for each file in a worker; it holds vocabularies only."""
    return Coder(path)
