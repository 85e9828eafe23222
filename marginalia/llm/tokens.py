"""Token ids of a public byte-level BPE file, each distinct run between white space encoded once."""

from __future__ import annotations

import gc
import os
import re
import threading
import time
import unicodedata

from .common import give_back

#: Python's split() also cuts at these four control characters; the tokenizer's white space lacks them.
CONTROLS = re.compile("[\x1c-\x1f]")
ASCII_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Runs of these characters go to the model piece by piece, any other run through the whole tokenizer.
LATIN = re.compile("[!-~\xa1-ɏ]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(0x100 + rest.index(b)) for b in range(256)]


class _Known(dict):
    """What find gives for a key, kept: looked up once, whether known or not."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, key):
        found = self[key] = self.find(key)
        return found


_SHARED: dict[str, "WordTokenizer"] = {}


def shared(path: str, idle: float = 5) -> "WordTokenizer":
    """One tokenizer for each process, so that a task begins with the runs that those before it in the same worker have met.

    Spark's workers go on to later stages and jobs; so what a tokenizer holds, some 200 MB at its limit, is given back once
    it hasn't been used for `idle` seconds.
    """
    found = _SHARED.get(path)
    if found is None:
        found = _SHARED[path] = WordTokenizer(path)
        threading.Thread(target=_expire, args=(path, idle), daemon=True).start()
    found.used = time.monotonic()
    return found


def _expire(path: str, idle: float) -> None:
    while (left := _SHARED[path].used + idle - time.monotonic()) > 0:
        time.sleep(left)
    del _SHARED[path]  # a task that still holds it goes on with it
    gc.collect()
    give_back()


class WordTokenizer:
    """Ids as unsigned 16-bit bytes, for tokenizers that fold case, drop white space and never look across it.

    limit: distinct runs kept before the memory starts afresh, so that it is bounded.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.latin_pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.limit, self.used = limit, time.monotonic()
        self.runs, self.pieces = _Known(self._run), _Known(self._piece)

    def encode_whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _piece(self, piece: str) -> bytes:
        import numpy as np

        if not piece.isascii():
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return np.array([t.id for t in self.model.tokenize(piece)], "<u2").tobytes()

    def _run(self, run: str) -> bytes:
        if run.isascii() and run.isprintable():
            own = ASCII_PIECES.findall(run.lower())
        elif LATIN.fullmatch(run):
            own = self.latin_pieces.findall("".join(map(str.lower, unicodedata.normalize("NFC", run))))
        else:
            return self.encode_whole(run)
        return self.pieces[own[0]] if len(own) == 1 else b"".join(map(self.pieces.__getitem__, own))

    def encode(self, texts: list[str]) -> list[bytes]:
        self.used = time.monotonic()
        if len(self.runs) > self.limit or len(self.pieces) > self.limit:
            self.runs, self.pieces = _Known(self._run), _Known(self._piece)
        runs, out = self.runs, []
        for text in texts:
            if CONTROLS.search(text):
                out.append(self.encode_whole(text))
                continue
            out.append(b"".join(map(runs.__getitem__, text.split())))
        return out
