"""Pre-tokens of texts under a ``tokenizers`` file, split as the library splits them.

The library's own normaliser and splitter are exact but slow in Python.  For texts made only of
ASCII and the plain Latin letters below, and for a file with the usual split expression, one
compiled expression gives the same pieces; every other text goes through the library.
"""

from __future__ import annotations

import json
import os
import re

from tokenizers import Regex, Tokenizer, pre_tokenizers

#: Fixed value: the split expression for which the quick form below was written.
USUAL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Fixed value: the normalisers that are the identity, but for case and space, on plain texts.
USUAL_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

_NOT_PLAIN = re.compile("[^\t\n\x0b\x0c\r -~À-ÖØ-öø-įı-ž]")
_QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\sa-z0-9ß-öø-ž]+")


def default_path() -> str:
    """Place of the word vocabulary (tasks and driver resolve it on their own machine)."""
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


class PreTokens:
    """Splits texts into pre-tokens and counts or lists the pieces of one pre-token."""

    def __init__(self, path: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = path or default_path()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = next((p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
        if split is None or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("this tokenizer file does not split texts by one expression")
        pattern = split["pattern"]["Regex"]
        self._splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self._quick = pattern == USUAL_SPLIT and kinds == USUAL_NORMALIZERS
        rest = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] != "Split"]
        plain_bytes = [p["type"] for p in rest] == ["ByteLevel"] and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
        self._to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False) if plain_bytes else None
        self._model = self.library.model

    def split(self, text: str) -> tuple[list[str], list[int]]:
        """Pre-tokens in order, and the ids of added tokens written out in the text.

        With added tokens, the order between the two lists is lost; see ``ordered``.
        """
        if self._quick and "<|" not in text and not _NOT_PLAIN.search(text):
            return _QUICK.findall(text.lower()), []
        pre, added = [], []
        for is_special, part in self._parts(text):
            if is_special:
                added.append(self.special[part])
            else:
                pre += self._library_split(part)
        return pre, added

    def ordered(self, text: str) -> list[str | int]:
        """Pre-tokens, with the ids of added tokens at their places."""
        if self._quick and "<|" not in text and not _NOT_PLAIN.search(text):
            return _QUICK.findall(text.lower())
        out: list[str | int] = []
        for is_special, part in self._parts(text):
            out += [self.special[part]] if is_special else self._library_split(part)
        return out

    def _parts(self, text: str):
        if not self._special_split:
            yield False, text
            return
        for i, part in enumerate(self._special_split.split(text)):
            if part:
                yield bool(i % 2), part

    def _library_split(self, text: str) -> list[str]:
        text = self.library.normalizer.normalize_str(text)
        return [p for p, _ in self._splitter.pre_tokenize_str(text)]

    def ids(self, pre_token: str) -> list[int]:
        """Ids of one pre-token.  It needs no normalising or splitting again, so only the model is asked."""
        if self._to_bytes is not None:
            if not (pre_token.isascii() and pre_token.isprintable()):  # the byte alphabet keeps printable ASCII
                pre_token = "".join(part for part, _ in self._to_bytes.pre_tokenize_str(pre_token))
            return [t.id for t in self._model.tokenize(pre_token)]
        return self.library.encode(pre_token, add_special_tokens=False).ids

    def counts(self, pre_tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch(pre_tokens, add_special_tokens=False)]
