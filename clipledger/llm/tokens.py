"""Token ids of whole texts with a public byte-level BPE vocabulary of the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

#: Characters that regular expressions count as white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = re.compile(r"\s")
#: White space before a space, after which texts are not cut.
SPACED = re.compile(f"[{SPACES}] ")
#: A line's end and what opens the next line, if that is no white space in any version of Unicode.
NEW_LINE = re.compile(r"\n(?=[!-~\w])")
#: Marks that end a word and are tokens of their own, apart from its letters.
MARKS = ".,;:!?"
#: Letters below this code point are letters in every version of Unicode.
OLD_LETTERS = "\u0250"
#: Words in each of two generations: when the younger is full, the older is forgotten.
CACHED_WORDS = 300_000
#: Bytes of text encoded at once: looking a word up costs about as much as encoding it, so each is met few times.
ENCODED_BYTES = 1 << 22
SLAB = 2_000
#: Words whose ids are put in place at once.
GATHERED_WORDS = 1 << 13


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts; words seen before are looked up.

    A byte-level BPE never merges over the start of white space that follows something else, so a
    text may be cut before each such space. Texts with other white space before a space, or with
    the string of a special token, are encoded in one piece. The pattern of GPT-2 also ends a word before
    the last of several line ends, and that one before the next line, so such lines are words as well; they keep
    the line end that tells them from words behind a space. New words of plain letters, with marks
    behind them or not, go straight to the tokenizer's model, as its pattern would take them apart the
    same way; other new words go through the whole tokenizer, many at once. Words that are still met are never
    forgotten: they are taken over from the older of two generations.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark spreads the tasks; threads that wait for work cost time
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.opens[i] = token.startswith("Ġ")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        said = json.loads(self.tokenizer.to_str())
        cut = said["pre_tokenizer"] or {}
        self.model = self.tokenizer.model
        self.direct = (
            said["normalizer"] is None and said["model"]["type"] == "BPE"
            and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
        )
        self.code = "H" if self.width.itemsize == 2 else "I"
        self.letters = byte_letters()
        self.line_end = self._modelled(self.letters[10]) if self.direct else b""
        self.lines = len(self.line_end) == self.width.itemsize
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.width).tobytes() for x in got]

    def _modelled(self, letters: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _learn(self, words: Iterable[str]) -> None:
        """Ids of new words as they are behind a space, or behind the line end they begin with."""
        known, rest, odd, lines = self.words, [], [], []
        for word in words:
            line = self.lines and word[:1] == "\n" and NEW_LINE.match(word) is not None
            core = (word[1:] if line else word).rstrip(MARKS)
            if not self.direct or not core.isalpha() or (not core.isascii() and max(core) >= OLD_LETTERS):
                (lines if line else odd if not word or SPACE.search(word) else rest).append(word)
                continue
            spelled = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
            tail = word[line + len(core) :]
            if line:
                ids = self.line_end + self._modelled(spelled)
            elif not tail:
                ids = known.get(core) or self._modelled("Ġ" + spelled)
            else:
                ids = known.get(core) or self.older.get(core)
                if ids is None:
                    ids = known[core] = self._modelled("Ġ" + spelled)
            if tail:
                if tail not in self.marks and len(self.marks) < CACHED_WORDS:
                    self.marks[tail] = self._modelled(tail)
                ids += self.marks.get(tail) or self._modelled(tail)
            known[word] = ids
        self._learn_slabs(rest)
        known.update(zip(odd + lines, self._whole([" " + w for w in odd] + lines), strict=True))

    def _learn_slabs(self, words: list[str]) -> None:
        """Many words make one text each time; their ids are told apart by the space that opens a word."""
        for i in range(0, len(words), SLAB):
            slab = words[i : i + SLAB]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(slab)], add_special_tokens=False)[0].ids)
            starts = np.flatnonzero(self.opens[ids])
            raw, size = ids.astype(self.width).tobytes(), self.width.itemsize
            ends = [*starts[1:].tolist(), len(ids)]
            for word, a, b in zip(slab, starts.tolist(), ends, strict=True):
                self.words[word] = raw[a * size : b * size]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of different words, all of them looked up or learnt."""
        if len(self.words) > CACHED_WORDS:
            self.words, self.older = {}, self.words
        known, older = self.words, self.older
        found = list(map(known.get, words))
        missing = {w for w, ids in zip(words, found, strict=True) if ids is None}
        if missing:
            if older:
                again = [w for w in missing if w in older]
                known.update((w, older[w]) for w in again)
                self._learn(missing.difference(again))
            else:
                self._learn(missing)
            found = [known[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return found

    def _joined(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are words between spaces. Words are told apart and put together by Arrow and numpy, many at
        once; only different words are looked up."""
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends, words = split.offsets.to_numpy(), split.values.dictionary_encode()
        place, different = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self._ids_of(different)
        ids = np.frombuffer(b"".join(found), self.width)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.width.itemsize
        opens = np.cumsum(sizes) - sizes
        before = np.zeros(len(place) + 1, np.int64)  # ids before each word
        np.cumsum(sizes[place], out=before[1:])
        out = np.empty(int(before[-1]), self.width)
        for k in range(0, len(place), GATHERED_WORDS):
            part, at = place[k : k + GATHERED_WORDS], before[k : k + GATHERED_WORDS + 1]
            out[at[0] : at[-1]] = ids[np.repeat(opens[part] - at[:-1], np.diff(at)) + np.arange(at[0], at[-1])]
        bounds = before[ends].tolist()
        return [out[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        out: list[np.ndarray] = []
        cut: list[tuple[int, str]] = []
        opened: set[int] = set()  # of these, the first word has a line end that is not in the text
        whole: list[tuple[int, str]] = []
        none = np.zeros(0, self.width)
        for i, text in enumerate(texts):
            out.append(none)
            if not text:
                continue
            if SPACED.search(text) or any(s in text for s in self.specials):
                whole.append((i, text))
                continue
            if self.lines and "\n" in text:
                text = NEW_LINE.sub(" \n", text)
            if self.lines and NEW_LINE.match("\n" + text[:1]):
                opened.add(i)
                cut.append((i, "\n" + text))
                continue
            head, space, rest = text.partition(" ")
            if head:
                whole.append((i, head))
            if space:
                cut.append((i, rest))
        for (i, _), ids in zip(whole, self._whole([t for _, t in whole]), strict=True):
            out[i] = np.frombuffer(ids, self.width)
        if cut:
            for (i, _), ids in zip(cut, self._joined([t for _, t in cut]), strict=True):
                if i in opened:
                    out[i] = ids[1:]  # the line end is one id
                else:
                    out[i] = np.concatenate([out[i], ids]) if len(out[i]) else ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Gives back what this worker holds to encode, once it does other work."""
    _ENCODERS.clear()
