"""Public tokenizer files, read once on the driver and sent to the workers.

A file of a vocabulary has a fixed size that does not grow with the data; it is checked against
``MAX_FILE_BYTES`` before it is broadcast.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

MAX_FILE_BYTES = 64 << 20
_LOADED: dict[str, Tokenizer] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer_text(path: str) -> str:
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    with open(path, encoding="utf-8") as file:
        return file.read()


def shared(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(tokenizer_text(path))


def loaded(text: str) -> Tokenizer:
    """The tokenizer of a file's text, built once in each process; it neither cuts nor pads."""
    if text not in _LOADED:
        _LOADED.clear()
        tokenizer = Tokenizer.from_str(text)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[text] = tokenizer
    return _LOADED[text]


#: The splitting rules of ``word_bpe_49k.json``, for which ``Words`` has a short way.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Code points below this one are in composed form already, and their classes have long been fixed.
LATIN_END = 0x250


class Words:
    """Words of a run without white space, in the byte alphabet of the tokenizer.

    The tokenizer's own normaliser and splitter say what the words are. For printable Latin runs
    the same rules are applied by one regular expression, which takes a tenth of the time.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        self.tokenizer = loaded(text)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = "|".join(map(re.escape, self.special))
        self.specials = re.compile(f"({split})") if split else None
        self.latin = None
        if (spec["normalizer"], spec["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER):
            chars = [chr(i) for i in range(0x21, LATIN_END)]
            letters = "".join(c for c in chars if unicodedata.category(c)[0] == "L")
            digits = re.escape("".join(c for c in chars if unicodedata.category(c)[0] == "N"))
            self.latin = re.compile(
                f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{letters}{digits}]+"
            )
            self.alphabet = {
                i: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(i))[0][0]
                for i in (*range(0x21, 0x7F), *range(0xA1, LATIN_END))
            }

    _printable = re.compile("[!-~¡-ɏ]+").fullmatch

    def of(self, run: str) -> list[str]:
        if self.latin is not None and Words._printable(run):
            lower = run.lower()
            if lower.isascii():
                return self.latin.findall(lower)
            if Words._printable(lower):
                return [w.translate(self.alphabet) for w in self.latin.findall(lower)]
        normal = self.tokenizer.normalizer.normalize_str(run)
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def parts(self, run: str) -> list[str]:
        """The run cut around special tokens, which are matched before anything else."""
        if self.specials is None or not self.specials.search(run):
            return [run]
        return [p for p in self.specials.split(run) if p]
