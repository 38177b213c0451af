"""Token ids of whole texts by the tokenizers library, with a memory of words seen before.

A text is cut where its tokenizer cuts it anyway: before a single space or line feed between two characters
that aren't white space. All pieces of many texts are cut and numbered at once by Arrow, every different one is looked up or encoded once,
and the texts' ids are gathered from those of the pieces. A stretch in which white space meets white space, or a special token
stands, is encoded by the library as it is. Ids are always those of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a generation. A worker remembers two: when one is full, the one before it is forgotten. Bounds memory, changes no result.
WORDS = 600_000
#: A longer piece is encoded each time.
LONGEST = 64
#: Characters of the texts that are worked on at once, and of a stretch of a longer text.
GROUP, STRETCH = 1 << 22, 1 << 18
#: Behind a letter these begin a token of their own, whatever follows.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Stands before the first piece of a text, which has no space before it.
FIRST = "\x1e"
LEADS = ("\n", FIRST)
#: A place where a text may be cut.
CUT = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """encode_all(texts) gives each text's ids as little-endian bytes of ``dtype``."""

    def __init__(self, file: str, words: int = WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        size, last = self.tokenizer.get_vocab_size(), self.tokenizer.model.end_of_word_suffix
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        #: Which tokens end a word; else which begin one with its space, and which are a line feed.
        self.ends = np.array([t.endswith(last) for t in tokens]) if last else None
        self.begins = {} if last else {" ": np.array([t.startswith("Ġ") for t in tokens]), "\n": np.array([t == "Ċ" for t in tokens])}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit, self.new, self.old = words, {}, {}
        self.marks: dict[str, bytes] = {"": b""}

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """A long text is worked on in stretches, so only one without any place to cut is held by the library as a whole."""
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, str, bool]] = []
        size = 0
        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                m = CUT.search(text, at + STRETCH) if len(text) > at + STRETCH else None
                end = m.start() if m else len(text)
                group.append((i, text[at:end], at == 0))
                size += end - at
                at = m.end() if m else end
                if size >= GROUP:
                    self._run(group, out)
                    group, size = [], 0
        self._run(group, out)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _run(self, group: list[tuple[int, str, bool]], out: list[list[bytes]]) -> None:
        if not group:
            return
        asis = [FIRST in t or any(s in t for s in self.special) for _, t, _ in group]
        if self.ends is None:
            cut = [FIRST + t if first else t for _, t, first in group]
            lists = pc.split_pattern(pc.replace_substring(pa.array(cut, pa.string()), "\n", " \n"), " ")
        else:  # white space is no part of any token
            lists = pc.split_pattern(pc.replace_substring(pa.array([t for _, t, _ in group], pa.string()), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        known = self.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        taken = pa.array(known, pa.binary()).take(coded.indices)
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int32)[lists.offsets.to_numpy()].tolist()
        data = memoryview(taken.buffers()[2])
        if taken.null_count:
            for i in np.flatnonzero(np.add.reduceat(taken.is_null().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1])).tolist():
                asis[i] = True
        for (i, text, first), a, b, whole in zip(group, ends, ends[1:], asis):
            out[i].append(self.whole(text if first else " " + text) if whole else bytes(data[a:b]))

    def of(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of each piece, None for one that can't stand for itself."""
        new, old = self.new, self.old
        got = list(map(new.get, pieces))
        todo = [i for i, x in enumerate(got) if x is None]
        at: list[int] = []
        cores: list[str] = []
        novel: dict[str, None] = {}
        for i in todo:
            x = core = pieces[i]
            if not x.isalpha():
                core = x.rstrip(MARKS)
                word = core[1:] if core[:1] in LEADS else core
                if not word or not (word.isalpha() and word[-1] < "ɐ" and word[-1] != "İ"):  # that one ends in a mark when in lower case
                    core, word = x, x[1:] if x[:1] in LEADS else x
                    if not word or word.split() != [word]:
                        continue
            at.append(i)
            cores.append(core)
            if core not in new:
                if (ids := old.get(core)) is not None:
                    new[core] = ids
                else:
                    novel[core] = None
        long = self.learn(list(novel)) if novel else {}
        for i, core in zip(at, cores):
            ids = new.get(core)
            if ids is None:
                ids = long[core]
            if marks := pieces[i][len(core) :]:
                if marks not in self.marks:
                    self.marks[marks] = self.whole(marks)
                ids += self.marks[marks]
            got[i] = ids
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        if len(self.marks) > 10_000:
            self.marks = {"": b""}
        return got

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Encodes new words; returns those that are too long to be remembered."""
        kinds: dict[str, list[str]] = {" ": [], "\n": [], "": []}
        for x in words:
            kinds["\n" if x[0] == "\n" and x[1:].isalpha() else " " if x.isalpha() else ""].append(x)
        for sep in (" ", "\n"):
            if kinds[sep] and not self._learn_words(kinds[sep], sep):
                kinds[""] += kinds[sep]
        rest = kinds[""]
        texts = [x[1:] if x[0] == FIRST else x if x[0] == "\n" else " " + x for x in rest]
        long = {}
        for x, e in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            (long if len(x) > LONGEST else self.new)[x] = self.packed(e.ids)
        return long

    def _learn_words(self, words: list[str], sep: str) -> bool:
        """Words of letters alone, encoded as one text; False if the tokenizer cuts it into other words, then nothing is learnt."""
        text = "".join(words) if sep == "\n" else " " + " ".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
        first = np.flatnonzero(self.begins[sep][ids]) if self.ends is None else np.concatenate([[0], np.flatnonzero(self.ends[ids])[:-1] + 1])
        if len(first) != len(words) or first[0] != 0:
            return False
        data, bounds = ids.tobytes(), (first * self.dtype.itemsize).tolist()
        self.new.update(zip(words, map(lambda a, b: data[a:b], bounds, [*bounds[1:], len(data)])))
        return True


@cache
def encoder(file: str) -> Encoder:
    """The worker's own, kept for its later tasks."""
    return Encoder(file)
