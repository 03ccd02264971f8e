"""Token ids by the installed tokenizer libraries, with a memory of words.

Texts are cut where white space follows another character, and where a mark follows a
letter or digit. Both kinds of ``.json`` tokenizer split their input there before any merge,
and none looks back, so the ids of a text are the ids of its parts. Parts repeat; each is
given to the library once and its ids are kept. Texts with rarer scripts, combining marks,
other than ASCII white space or strings of special tokens go to the library whole.
"""

from __future__ import annotations

import gc
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from faultline.llm.common import pieces, ragged

_SPACE = " \t\n\r\f\v"
_CUT = "\x00"  # no plain character
_RARE_SPACE = frozenset("\t\r\f\v")
WHOLE, BY_RUNS, PLAINLY = 0, 1, 2
# Characters on whose class every Unicode version agrees, but for white space and marks.
_PLAIN = frozenset(map(chr, (*range(9, 14), *range(32, 127), *range(161, 768), *range(0x400, 0x460), *range(0x3041, 0x3097), *range(0x4E00, 0x9FA6))))


def _plain_of(tokenizer) -> tuple[frozenset[str], bool]:
    """The plain characters of a file, and whether its normaliser lowers them.

    Left out are those that normalising turns into something with a combining mark, which would
    join what follows (the lower case of the dotted capital I is such a pair), and those that it
    lowers in another way than Python. The normaliser itself is asked about every character.
    """
    if tokenizer.normalizer is None:
        return _PLAIN, False
    seen = {c: tokenizer.normalizer.normalize_str(c) for c in _PLAIN if not c.isspace()}
    lowers = seen["A"] == "a"
    kept = {c for c, n in seen.items() if not any(unicodedata.category(x)[0] == "M" for x in n) and (not lowers or n == c.lower())}
    return frozenset(kept.union(_SPACE)), lowers


class Encoder:
    """Ids of many texts by one tokenizer file; ``.json`` or ``.model`` chooses the library."""

    MOST_PARTS, MOST_CHARS = 600_000, 1 << 24
    JOINED = 400  # unseen parts given to the library as one text
    BLOCK_CHARS = 1 << 23  # characters cut into parts together

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(path)
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
            self.by_parts = True
            self._plain, self._lowers = _plain_of(self._tokenizer)
            # White space is dropped, or kept with what follows it.
            self._drops_space = not self.whole([" "])[0]
            # The joining text has one id, that of a character that merges with nothing.
            self._between = " | " if self._drops_space else "\x01"
            self._between_ids = self.whole([self._between])[0]
            if not self._drops_space and sum(self._tokenizer.id_to_token(self._between_ids[0]) in t for t in self._tokenizer.get_vocab()) > 1:
                self._between_ids = []
        else:
            from sentencepiece import SentencePieceProcessor

            self._tokenizer = SentencePieceProcessor(model_file=path)
            self.by_parts = False
        self._forget()

    def _forget(self) -> None:
        self._numbers: dict[str, int] = {}
        self._chars = 0
        self._ids, self._held = np.empty(1 << 12, np.uint32), 0
        self._starts, self._lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        """The library's own answer."""
        if self.by_parts:
            return [e.ids for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]
        return self._tokenizer.encode(texts, add_bos=False, add_eos=False, num_threads=1)

    def _joins(self, part: str) -> bool:
        """Whether a part keeps its ids beside the joining text: it ends with no white space and begins with no apostrophe."""
        return bool(part) and part[-1] not in _SPACE and part[0] != "'" and (not self._drops_space or "|" not in part)

    def _joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and counts of parts encoded as one text, cut at the joining ids; None if they don't tell the parts."""
        if len(self._between_ids) != 1:
            return None
        ids = np.array(self.whole([self._between.join(parts)])[0], np.uint32)
        cuts = np.flatnonzero(ids == self._between_ids[0])
        if len(cuts) != len(parts) - 1:
            return None
        return np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1

    def _learn(self, unseen: list[str]) -> None:
        found = [(a, b, got) for a, b in _groups([self._joins(p) for p in unseen], self.JOINED) if (got := self._joined(unseen[a:b]))]
        done = np.zeros(len(unseen), bool)
        for a, b, _ in found:
            done[a:b] = True
        alone = np.flatnonzero(~done).tolist()
        ids = self.whole([unseen[i] for i in alone]) if alone else []
        lengths = np.zeros(len(unseen), np.int64)
        for a, b, (_, n) in found:
            lengths[a:b] = n
        lengths[alone] = [len(i) for i in ids]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        total = int(ends[-1])
        need = self._held + total
        if need > len(self._ids):
            self._ids = np.concatenate([self._ids[: self._held], np.empty(max(need, self._held), np.uint32)])
        flat = self._ids[self._held : need]
        for a, b, (joined, _) in found:
            flat[starts[a] : ends[b - 1]] = joined
        for i, own in zip(alone, ids):
            flat[starts[i] : ends[i]] = own
        first = len(self._numbers)
        self._numbers.update(zip(unseen, range(first, first + len(unseen))))
        self._starts = np.concatenate([self._starts, self._held + starts])
        self._lengths = np.concatenate([self._lengths, lengths])
        self._held = need
        self._chars += sum(map(len, unseen))

    def kind(self, text: str) -> int:
        """``WHOLE``, or how a text may be cut into parts: ``PLAINLY`` if every run of white space is one kind of character."""
        if not self.by_parts or "<|" in text or not self._plain.issuperset(text):
            return WHOLE
        if self._drops_space or not ("  " in text or " \n" in text or "\n " in text or not _RARE_SPACE.isdisjoint(text)):
            return PLAINLY
        return BY_RUNS

    def parts(self, texts: list[str], kind: int) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The independent parts of texts of one kind, one after another, and their number in each text."""
        text = pa.array([t.lower() for t in texts] if self._lowers else texts, pa.large_string())
        if kind == BY_RUNS:  # before each run of white space
            text = pc.replace_substring_regex(text, rf"([^{_SPACE}])([{_SPACE}])", rf"\1{_CUT}\2")
        elif self._drops_space:
            text = pc.replace_substring(pc.replace_substring(text, " ", _CUT), "\n", _CUT)
        else:
            text = pc.replace_substring(pc.replace_substring(text, " ", _CUT + " "), "\n", _CUT + "\n")
            while pc.any(pc.match_substring(text, f"\n{_CUT}\n")).as_py():  # empty lines stay together
                text = pc.replace_substring(text, f"\n{_CUT}\n", "\n\n")
        text = pc.replace_substring_regex(text, rf"([\pL\pN])([^\pL\pN{_SPACE}{_CUT}])", rf"\1{_CUT}\2")
        split = pc.split_pattern(text, _CUT)
        return split.values.dictionary_encode(), np.diff(split.offsets.to_numpy())

    def numbers(self, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each part and its count of ids."""
        if len(self._numbers) > self.MOST_PARTS or self._chars > self.MOST_CHARS:
            self._forget()
        kinds = coded.dictionary.to_pylist()
        unseen = [p for p in kinds if p not in self._numbers]
        if unseen:
            self._learn(unseen)
        at = np.fromiter(map(self._numbers.__getitem__, kinds), np.int64, len(kinds))[coded.indices.to_numpy(zero_copy_only=False)]
        return at, self._lengths[at]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each."""
        found: list[np.ndarray] = []
        counts = self._walk(texts, found)
        return np.concatenate(found) if found else np.empty(0, np.uint32), counts

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        return self._walk(texts, None)

    def _walk(self, texts: list[str], found: list[np.ndarray] | None) -> np.ndarray:
        # Many short-lived lists of parts and ids would set off the cycle collector again and again.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encoded(texts, found)
        finally:
            if collecting:
                gc.enable()

    def _encoded(self, texts: list[str], found: list[np.ndarray] | None) -> np.ndarray:
        counts = np.zeros(len(texts), np.int64)
        for a, b in pieces(texts, self.BLOCK_CHARS):
            for first, last, kind in _runs([self.kind(t) for t in texts[a:b]]):
                first, last = first + a, last + a
                if kind == WHOLE:
                    ids = np.array(self.whole([texts[first]])[0], np.uint32)
                    counts[first] = len(ids)
                    if found is not None:
                        found.append(ids)
                    continue
                coded, sizes = self.parts(texts[first:last], kind)
                at, lengths = self.numbers(coded)
                if found is not None:
                    found.append(self._ids[ragged(self._starts[at], lengths)])
                ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes)]
                counts[first:last] = np.diff(ends, prepend=0)
        return counts

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The library's ids with the first and last character position of each."""
        e = self._tokenizer.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2)
        return np.array(e.ids, np.uint32), at[:, 0], at[:, 1]


def _groups(joins: list[bool], most: int):
    """Consecutive ranges of at most ``most`` parts that all may be joined, two at least."""
    start = 0
    for i in range(len(joins) + 1):
        if i == len(joins) or not joins[i] or i - start == most:
            if i - start > 1:
                yield start, i
            start = i if i < len(joins) and joins[i] else i + 1


def _runs(kinds: list[int]):
    """Consecutive texts of a kind together, whole ones alone: ``(first, last + 1, kind)``."""
    start = 0
    for i in range(1, len(kinds) + 1):
        if i == len(kinds) or kinds[i] != kinds[i - 1] or kinds[i] == WHOLE:
            yield start, i, kinds[start]
            start = i


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def library_path(name: str) -> str:
    """Place of a public tokenizer's file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
