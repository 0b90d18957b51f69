"""Token ids of whole texts, as the tokenizers library gives them, with a memory for repeated words.

In the vocabularies used here no token reaches over white space: the normaliser turns it into a space and the splitter
drops it.  A text's ids are then those of its parts between ASCII white space, one after the other.  Whether that holds is
read from the tokenizer's own description; otherwise whole texts go to the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from beaconloom.llm.common import held, mixed, per_text, tokenizer_path, word_spans

#: Distinct parts whose ids a task remembers.  The frequent ones are met early, so those met later are not remembered;
#: once as many have been passed over, it starts over, as the texts may have changed.
REMEMBERED = 1_300_000
#: Parts of more bytes are looked up one by one, and those longer than LONG are not remembered.
SHORT, LONG = 16, 64

#: Parts that are one word of Latin letters, and how many of them the library gets at a time.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
TOGETHER = 500

#: Everything but ASCII white space.
PART_BYTES = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def short_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, 3): the first eight bytes, the next eight, and the length; all there is to words of up to 16 bytes."""
    padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    size = ends - starts
    out = np.empty((len(starts), 3), np.uint64)
    out[:, 0] = eight[starts] & _KEPT[np.minimum(size, 8)]
    out[:, 1] = eight[np.minimum(starts + 8, len(padded) - 8)] & _KEPT[np.clip(size - 8, 0, 8)]
    out[:, 2] = size
    return out


class WordTable:
    """A hash table from short words to numbers that looks up many at a time."""

    def __init__(self, most: int):
        self.slots, self.used = 1 << (most + most // 2).bit_length(), 0
        self.rows = np.zeros((self.slots, 4), np.uint64)  # a word's three numbers, and its value + 1

    def _home(self, words: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = words[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ mixed(words[:, 1] + words[:, 2])
        return (mixed(key) & np.uint64(self.slots - 1)).astype(np.int64)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The value of each word, or -1."""
        out = np.full(len(words), -1, np.int64)
        open_, slot = np.arange(len(words)), self._home(words)
        while len(open_):
            rows = self.rows[slot]
            hit = (rows[:, :3] == words[open_]).all(axis=1) & (rows[:, 3] > 0)
            out[open_[hit]] = rows[hit, 3].astype(np.int64) - 1
            on = ~hit & (rows[:, 3] > 0)
            open_, slot = open_[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def add(self, words: np.ndarray, values: np.ndarray) -> None:
        """Adds words that are not there yet, each once; a quarter of the slots stays free."""
        self.used += len(words)
        if 4 * self.used > 3 * self.slots:
            old = self.rows[self.rows[:, 3] > 0]
            words, values = np.concatenate([old[:, :3], words]), np.concatenate([old[:, 3].astype(np.int64) - 1, values])
            self.slots = 1 << (2 * self.used).bit_length()
            self.rows = np.zeros((self.slots, 4), np.uint64)
        open_, slot = np.arange(len(words)), self._home(words)
        while len(open_):
            free = self.rows[slot, 3] == 0
            at = slot[free]
            self.rows[at, :3], self.rows[at, 3] = words[open_[free]], values[open_[free]].astype(np.uint64) + np.uint64(1)
            mine = (self.rows[slot, 3] == values[open_].astype(np.uint64) + np.uint64(1)) & free  # of several for a slot, one got it
            open_, slot = open_[~mine], (slot[~mine] + 1) & (self.slots - 1)


class WordIds:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.remembered = remembered
        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        self.splits = self._splits(about)
        suffix = about["model"].get("end_of_word_suffix")
        vocabulary = self.library.get_vocab()
        #: Which ids end a word, if the vocabulary tells.
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.short = WordTable(self.remembered)
        self.long: dict[bytes, int] = {}
        self.ids = np.empty(1 << 20, np.uint32)
        self.start = np.empty(1 << 16, np.int64)
        self.count = np.empty(1 << 16, np.int64)
        self.used = self.known = self.passed = 0

    @staticmethod
    def _splits(about: dict) -> bool:
        """White space is folded to a space, and a removing splitter that matches no white space drops it; added
        tokens neither hold white space nor take any from around them."""
        steps = (about.get("normalizer") or {}).get("normalizers", [])
        folds = any(s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps)
        kinds = {"NFC", "Replace", "Lowercase"} >= {s["type"] for s in steps}
        first = next(iter((about.get("pre_tokenizer") or {}).get("pretokenizers", [])), {})
        drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
        pattern = str((first.get("pattern") or {}).get("Regex", ""))
        spaceless = not any(x in pattern.replace("[^\\s", "") for x in (" ", "\\s", ".", "\\W", "\\P"))
        added = about.get("added_tokens") or []
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"])) for t in added)
        return bool(folds and kinds and drops and spaceless and plain)

    def _encoded(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, each part by itself, and how many each has."""
        found = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        return np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found], np.int64)

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters: many in one text, which the ids that end a word cut up again."""
        texts = [b" ".join(words[i : i + TOGETHER]).decode() for i in range(0, len(words), TOGETHER)]
        found = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.empty(0, np.uint32)
        stops = np.flatnonzero(self.ending[ids]) + 1
        if len(stops) != len(words) or (len(stops) and stops[-1] != len(ids)):
            return self._encoded(words)
        return ids, np.diff(stops, prepend=0)

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        """Lets the library encode new parts; their numbers follow those known, in the order returned."""
        plain = [p for p in parts if _LETTERS.fullmatch(p)] if self.ending.any() else []
        chosen = set(plain)
        other = [p for p in parts if p not in chosen]
        for group, (ids, count) in ((plain, self._together(plain)), (other, self._encoded(other))):
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            while self.known + len(group) > len(self.start):
                self.start, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.count))
            self.ids[self.used : self.used + len(ids)] = ids
            here = slice(self.known, self.known + len(group))
            self.start[here], self.count[here] = self.used + np.cumsum(count) - count, count
            self.used, self.known = self.used + len(ids), self.known + len(group)
        return plain + other

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin."""
        first = np.zeros(len(texts) + 1, np.int64)
        if not self.splits:
            found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            np.cumsum([len(f) for f in found], out=first[1:])
            return np.array([i for f in found for i in f], np.uint32), first
        if self.passed > self.remembered:
            self._forget()
        raw = [t.encode() for t in texts]
        np.cumsum([len(r) for r in raw], out=first[1:])
        whole = b"".join(raw)
        data, offsets = np.frombuffer(whole, np.uint8), first.copy()
        starts, ends = word_spans(data, offsets, PART_BYTES)
        index = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(ends - starts <= SHORT)
        words = short_words(data, starts[short], ends[short])
        index[short] = self.short.find(words)
        missing = np.flatnonzero(index < 0)
        parts = [whole[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
        known = self.long
        before, used = self.known, self.used
        new = self._learn(list({p for p in parts if len(p) <= SHORT or p not in known}))
        number = dict(zip(new, range(before, self.known), strict=True))
        index[missing] = [number[p] if p in number else known[p] for p in parts]
        lengths = self.count[index]
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.ids[np.repeat(self.start[index] - stops + lengths, lengths) + np.arange(total)]
        first[:] = np.concatenate([[0], stops])[per_text(starts, offsets)]
        if before < self.remembered:
            known.update((p, n) for p, n in number.items() if SHORT < len(p) <= LONG)
            fresh = np.flatnonzero(index[short] >= before)
            _, once = np.unique(index[short[fresh]], return_index=True)
            self.short.add(words[fresh[once]], index[short[fresh[once]]])
        else:
            self.known, self.used, self.passed = before, used, self.passed + len(new)
        return ids, first


def encoder(name: str) -> WordIds:
    """The encoder of a vocabulary file, once in each worker process."""
    return held(("word ids", name), lambda: WordIds(tokenizer_path(name)))


def with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id behind every text."""
    texts = len(first) - 1
    return np.insert(ids, first[1:], np.uint32(end)), first + np.arange(texts + 1)
