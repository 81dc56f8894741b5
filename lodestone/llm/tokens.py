"""Token ids by a public tokenizer, word by word through a bounded cache."""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that the cache of words may take, about, and the longest word that it keeps.
CACHE_BYTES = 160 << 20
LONGEST = 40
#: What a cached word takes besides its characters and ids.
_ENTRY = 200
#: Words that the tokenizer gets at once; it needs some hundred bytes for each.
AT_ONCE = 10_000
#: Letters below this are composed as they are and have one lower-case form, whatever stands around them.
COMPLEX = "\u0130"
#: A full stop or comma beside another mark, with which it would be one piece. U+001C to U+001F are marks to the
#: tokenizer, but white space to ``\s``.
_MARK = r"[^\w\s]|[_\x1c-\x1f]"
_BESIDE = re.compile(rf"[.,](?:(?={_MARK})|(?<=[^\w\s].)|(?<=[_\x1c-\x1f].))")
#: Letters, then ASCII marks without an apostrophe, which could begin a piece with letters.
_MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


class WordTokenizer:
    """Gives the ids of whole texts as little-endian 32-bit bytes.

    For tokenizers that drop white space and whose pieces never cross it, so that a text's ids are its words'
    ids in order. Words are split at spaces and newlines only; whatever else a word holds is the tokenizer's
    own business. ``add_special_tokens`` is off.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        vocabulary = self.own.get_vocab()
        size = max(vocabulary.values()) + 1
        self.ends = np.zeros(size, bool)
        for piece, k in vocabulary.items():
            self.ends[k] = piece.endswith("</w>")
        # two generations: when the younger is full it becomes the elder, and what is looked up in the elder moves on
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes = 0

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.own.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of simple letters, encoded as one text and cut where a word ends."""
        ids = np.array(self.own.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or (len(cuts) and cuts[-1] != len(ids)):
            return self._encode(words)
        whole, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
        return [whole[a:b] for a, b in zip(at, at[1:])]

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. Letters with marks behind them are two pieces, each encoded by itself."""
        plain, rest, parts = set(), set(), {}
        for w in words:
            if w.isalpha() and max(w) < COMPLEX:
                plain.add(w)
            elif (cut := _MARKED.fullmatch(w)) and max(cut[1]) < COMPLEX:
                parts[w] = cut[1], cut[2]
                (plain if cut[1].isalpha() else rest).add(cut[1])
                rest.add(cut[2])
            else:
                rest.add(w)
        found: dict[str, bytes] = {}
        for kind, encode in ((list(plain), self._letters), (list(rest), self._encode)):
            for k in range(0, len(kind), AT_ONCE):
                found.update(zip(kind[k : k + AT_ONCE], encode(kind[k : k + AT_ONCE])))
        return [found[parts[w][0]] + found[parts[w][1]] if w in parts else found[w] for w in words]

    def known(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from the cache where it has them."""
        found = list(map(self.young.get, words))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            again = [words[k] for k in missing]
            ids = list(map(self.old.get, again))
            new = [k for k, x in enumerate(ids) if x is None]
            for k, x in zip(new, self.learn([again[k] for k in new]) if new else ()):
                ids[k] = x
            for k, x in zip(missing, ids):
                found[k] = x
            for k in range(0, len(again), AT_ONCE):
                pairs = [(w, x) for w, x in zip(again[k : k + AT_ONCE], ids[k : k + AT_ONCE]) if len(w) <= LONGEST]
                self.young.update(pairs)
                self.bytes += sum(_ENTRY + len(w) + len(x) for w, x in pairs)
                if 2 * self.bytes > CACHE_BYTES:
                    self.young, self.old, self.bytes = {}, self.young, 0
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. A batch's distinct words are looked up once; columns of numbers do the rest."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array([_spaced(t or "") for t in texts], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        found = self.known(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int32, len(found)) >> 2
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        pool = np.frombuffer(b"".join(found), "<u4")
        at = coded.indices.to_numpy()
        each = sizes[at]
        ends = np.zeros(len(at) + 1, np.int32)  # a batch has far fewer ids than 2**31
        np.cumsum(each, out=ends[1:])
        places = np.arange(ends[-1], dtype=np.int32)
        places += np.repeat(starts[at] - ends[:-1], each)
        ids = pool[places].tobytes()
        cuts = (ends[lists.offsets.to_numpy()].astype(np.int64) * 4).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def _spaced(text: str) -> str:
    """The text with newlines as spaces; where that changes no id, in lower case and with marks apart."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.replace("\n", " ")
    if not _BESIDE.search(text):
        text = text.replace(".", " . ").replace(",", " , ")
    return text.lower().replace("\n", " ")


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this process; a worker that runs many tasks loads it, and learns words, once."""
    kept = sys.modules.setdefault("_lodestone_tokenizers", types.ModuleType("_lodestone_tokenizers"))
    found = getattr(kept, "by_path", None)
    if found is None or path not in found:
        kept.by_path = found = {path: WordTokenizer(path)}
    return found[path]


def batches(texts: list[str | None], chars: int = 3 << 19):
    """Consecutive (from, to) ranges of about so many characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= chars:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)
