"""Token ids of whole texts by a public tokenizer file, fast enough for whole corpora.

The 49k word tokenizer treats every maximal run of non-white-space on its own (its
normaliser composes, folds white space and lower-cases character by character; its
splitter never joins runs), so a text's ids are its words' ids one after another.
Each distinct word is encoded by the ``tokenizers`` library once per worker and kept
in a bounded table; the ids of a text are then joined from that table.
"""

from __future__ import annotations

import os
import re
import string

from tesserae.llm.common import claim, holds

#: Words of a generation; a worker keeps those of two, so memory stays bounded.
MAX_WORDS = 250_000
_SIGNS = string.punctuation.encode()
_LATIN = re.compile("[a-zß-öø-ÿ]+")
#: Byte-level BPE writes bytes as characters: printable ones as themselves, the others as those from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def _bytes(ids) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordTokenizer:
    """Little-endian unsigned 32-bit ids of texts given as UTF-8 bytes."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def learn(self, words) -> None:
        """Encode the words that aren't known yet.

        In a run of lower-case Latin letters there is nothing for the normaliser or the
        splitter to change, and ASCII signs after it are parted from it, so the library's BPE
        model alone encodes such words, some six times faster. All others pass through the
        whole tokenizer.
        """
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > MAX_WORDS:
            # Words that occur again move from one generation to the next; the others are forgotten.
            self.known, self.before = {}, self.known
            new = list(words)
        again = self.before
        self.known.update((w, again[w]) for w in new if w in again)
        new = [w for w in new if w not in again]
        if not new:
            return
        plain, need = [], set()
        for w in new:
            core = w.rstrip(_SIGNS)
            if _LATIN.fullmatch(core.decode()) and b"<|" not in w:
                plain.append((w, core, w[len(core) :]))
                if len(core) < len(w) and w[len(core) :] not in self.known:
                    need.add(w[len(core) :])
            else:
                need.add(w)
        need = list(need)
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in need], add_special_tokens=False)
        for w, e in zip(need, encoded, strict=True):
            self.known[w] = _bytes(e.ids)
        for w, core, signs in plain:
            ids = self.known.get(core) or again.get(core)
            if ids is None:
                ids = _bytes([x.id for x in self.model.tokenize(core.decode("latin-1").translate(_BYTE_CHARS))])
            self.known[w] = ids + self.known[signs] if signs else ids

    def ids(self, text: bytes) -> bytes:
        """Ids of one text; the words of very long texts are learnt piece by piece."""
        # Lower-casing ASCII early makes fewer distinct words; the markers of special
        # tokens are case-sensitive, so texts that may hold one stay as they are.
        words = (text if b"<|" in text else text.lower()).split()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            pass
        out = []
        for at in range(0, len(words), 200_000):
            part = words[at : at + 200_000]
            self.learn(set(part))
            out.append(b"".join(map(self.known.__getitem__, part)))
        return b"".join(out)


_held: dict[tuple[str, bool], WordTokenizer] = {}
holds("tokens", _held.clear)


def word_tokenizer(path: str, special_as_text: bool = False) -> WordTokenizer:
    """One table of words per worker process and tokenizer."""
    claim("tokens")
    key = (path, special_as_text)
    if key not in _held:
        _held[key] = WordTokenizer(path, special_as_text)
    return _held[key]
