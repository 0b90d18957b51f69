"""SentencePiece encoding with seeded merge-dropout, and decoding.

Plain encoding merges, again and again, the neighbouring symbols whose merged piece has the best score, the leftmost first.
Here an agenda holds the candidates, and one that comes up is skipped for good with a given chance.  Chance is a keyed hash of
the seed, the document, the word's place in it and the number of candidates that came up before, so every occurrence of a word
draws its own lots, and the same call gives the same ids on any machine, in any order, and after any retry.

What a word becomes depends only on which candidates are skipped.  A task therefore keeps a tree for each short word it has met:
the root is the word without skips, and a node's child number k is the node with candidate k skipped too.  An occurrence
draws lots until one skips, goes to that child, and ends where no further candidate is skipped; only nodes not yet there are worked
out.  Longer words keep their root alone, and occurrences with a skip are worked out one for one.

Words that a task has not met are worked on together: their symbols are the rows of a matrix, and in each step every row
takes the best candidate off its agenda, skips or merges it, and proposes the merged symbol's new pairs.

No piece holds a word mark behind another character (checked for each model), so words are encoded one by one.  Decoding
joins the bytes of the pieces and takes the mark off the front; any segmentation gives back the same text.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconloom.llm.common import Batches, held, mixed, over_slices, per_text, tokenizer_path
from beaconloom.llm.word_ids import SHORT, WordTable, short_words

MODEL = "piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 17
#: Nodes that a task remembers; when there are more, it starts over.
REMEMBERED = 1 << 20
#: Words of at most so many characters are worked on together, this many at a time.
WIDTHS, TOGETHER = (8, 16, 32, 64), 1 << 15
#: For numbers of words and of candidates, which are skipped.
Skipped = Callable[[np.ndarray, np.ndarray | int], np.ndarray]
MARK = "▁"
_LITERAL = MARK + "\0"  # a mark that stands in the text itself: in no piece, so it becomes its bytes
_M64 = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
#: What is kept of a node: its ids, how many candidates came up, its children, and its word and place in the tree.
START, COUNT, MET, CHILD, ROOT, PARENT, LAST = range(7)


def _mix(x: int) -> int:
    """SplitMix64's finaliser, for single numbers."""
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _M64
    return x ^ x >> 31


def lots(keys: np.ndarray, number: np.ndarray | int, limit: np.uint64) -> np.ndarray:
    """Whether the candidate with this number is skipped, for each key."""
    with np.errstate(over="ignore"):
        return mixed(keys + (np.asarray(number).astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP)) < limit


def first_skip(keys: np.ndarray, begin: np.ndarray, stop: np.ndarray, limit: np.uint64) -> np.ndarray:
    """The first candidate from ``begin`` on and before ``stop`` that each key skips, or -1."""
    out, row, number = np.full(len(keys), -1, np.int64), np.arange(len(keys)), begin
    while True:
        live = number < stop[row]
        row, number = row[live], number[live]
        if not len(row):
            return out
        skip = lots(keys[row], number, limit)
        out[row[skip]] = number[skip]
        row, number = row[~skip], number[~skip] + 1


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(size)]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_unused(i) for i in range(size)]
        byte = [library.is_byte(i) for i in range(size)]
        self.score = {n: (-library.get_score(i), i) for i, n in enumerate(names) if not special[i] and not byte[i]}
        self.of_byte = {int(names[i][3:5], 16): i for i in range(size) if byte[i]}
        if any(MARK in n.lstrip(MARK) for n in self.score) or len(self.of_byte) < 256:
            raise ValueError("the model's pieces reach over words, or it cannot encode every byte")
        raw = [bytes([int(n[3:5], 16)]) if byte[i] else b"" if special[i] else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.length = np.array([len(r) for r in raw], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self._pairs()
        self._forget()

    def _forget(self) -> None:
        self.short, self.long = WordTable(REMEMBERED + (1 << 18)), {}
        self.words: list[bytes] = []
        self.ids, self.children = np.empty(1 << 20, np.int32), np.empty(1 << 20, np.int32)
        self.nodes = np.empty((7, 1 << 16), np.int64)
        self.used = self.branches = self.known = 0

    def _pairs(self) -> None:
        """Which two symbols merge into which piece, as a hash table; symbols are pieces, and characters that only occur
        in longer pieces."""
        self.symbol = {n: i for n, (_, i) in self.score.items()}
        for name in list(self.symbol):
            for c in name:
                self.symbol.setdefault(c, len(self.length) + len(self.symbol))
        #: The symbol of every character: -2 if none merges with it; the word mark itself has none, as spaces stand for it.
        self.of_character = np.full(0x110000, -2, np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1 and c != MARK:
                self.of_character[ord(c)] = i
        self.of_character[0x20] = self.symbol[MARK]
        keys, merged = [], []
        for name, (_, i) in self.score.items():
            for cut in range(1, len(name)):
                a, b = self.symbol.get(name[:cut]), self.symbol.get(name[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(i)
        self.slots = 1 << (4 * max(len(keys), 1)).bit_length()
        self.keys, self.merged = np.full(self.slots, -1, np.int64), np.full(self.slots, -1, np.int64)
        open_, value = np.array(keys, np.int64), np.array(merged, np.int64)
        slot = self._home(open_)
        while len(open_):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.merged[slot[free]] = open_[free], value[free]
            rest = self.keys[slot] != open_
            self.merged[slot[~rest]] = value[~rest]
            open_, value, slot = open_[rest], value[rest], (slot[rest] + 1) & (self.slots - 1)
        ranks = np.unique([s for s, _ in self.score.values()])
        self.rank = np.full(len(self.length), 1 << 30, np.int32)
        for name_score, i in self.score.values():
            self.rank[i] = np.searchsorted(ranks, name_score)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) & np.uint64(self.slots - 1)).astype(np.int64)

    def _merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces that pairs of symbols merge into, or -1."""
        out = np.full(len(left), -1, np.int64)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[at] << 32 | right[at]
        slot = self._home(keys)
        while len(at):
            there = self.keys[slot]
            hit = there == keys
            out[at[hit]] = self.merged[slot[hit]]
            on = ~hit & (there >= 0)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def segment_all(self, words: list[str], skipped: Skipped) -> tuple[list[list[int]], np.ndarray]:
        """As ``segment`` for each word, many at a time; ``skipped`` takes numbers of words and of candidates."""
        out: list[list[int]] = [[]] * len(words)
        met = np.zeros(len(words), np.int64)
        size = np.array([len(w) for w in words], np.int64)
        low = -1
        for width in WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            for a in range(0, len(rows), TOGETHER):
                part = rows[a : a + TOGETHER]
                found, met[part] = self._rows([words[r] for r in part.tolist()], size[part], lambda row, k, part=part: skipped(part[row], k), width)
                for row, ids in zip(part.tolist(), found, strict=True):
                    out[row] = ids
        for row in np.flatnonzero(size > low).tolist():
            most = 3 * len(words[row])  # of n characters, n - 1 merges and two new candidates for each
            out[row], met[row] = self.segment(words[row], skipped(np.full(most, row), np.arange(most)).tolist())
        return out, met

    def _rows(self, words: list[str], size: np.ndarray, skipped: Skipped, width: int) -> tuple[list[list[int]], np.ndarray]:
        none = 1 << 30
        step = width + 1  # the last column of a row stands for "no neighbour"
        inside = (np.arange(step) < size[:, None]).ravel()
        symbols = np.full(len(words) * step, -3, np.int64)
        symbols[inside] = self.of_character[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        base = np.repeat(np.arange(len(words)) * step, step)
        column = np.tile(np.arange(step), len(words))
        end = base + width
        after = np.where(column + 1 < np.repeat(size, step), base + column + 1, end)
        before = np.where((column > 0) & (column < width), base + column - 1, end)
        merged, rank = np.full(len(symbols), -1, np.int64), np.full(len(symbols), none, np.int32)

        def propose(left: np.ndarray) -> None:
            found = self._merge(symbols[left], symbols[after[left]])
            merged[left] = found
            rank[left] = np.where(found >= 0, self.rank[found], none)

        propose(np.flatnonzero(inside))
        table, row = rank.reshape(-1, step), np.arange(len(words))
        met, number = np.zeros(len(words), np.int64), 0
        while len(row):
            left = (table if len(row) == len(table) else table[row]).argmin(axis=1)
            at = row * step + left
            more = rank[at] < none
            met[row[~more]] = number
            row, at = row[more], at[more]
            skip = skipped(row, number)
            number += 1
            rank[at[skip]] = none
            at = at[~skip]
            right = after[at]
            symbols[at] = merged[at]
            rank[right], symbols[right] = none, -3
            beyond = after[right]
            after[at] = beyond
            before[beyond] = at
            symbols[end[at]] = -3  # merges with nothing
            propose(at)
            left = before[at]
            propose(left[symbols[left] > -3])
        held = (symbols > -3).reshape(-1, step)
        counts = held.sum(axis=1)
        flat = symbols[held.ravel()]
        stops = np.cumsum(counts)
        every = flat.tolist()
        out = [every[a:b] for a, b in zip((stops - counts).tolist(), stops.tolist(), strict=True)]
        odd = np.add.reduceat((flat < 0) | (flat >= len(self.length)), stops - counts) if len(flat) else []
        for r in np.flatnonzero(odd).tolist():  # characters that are no piece become their bytes
            ids: list[int] = []
            for place, i in zip(np.flatnonzero(held[r]).tolist(), out[r], strict=True):
                ids += [i] if 0 <= i < len(self.length) else [self.of_byte[b] for b in words[r][place].encode()]
            out[r] = ids
        return out, met

    def segment(self, word: str, skipped: list[bool]) -> tuple[list[int], int]:
        """Ids of a run of characters, spaces being marks, and how many candidates came up; ``skipped`` tells of each whether
        it is skipped."""
        score, met = self.score, 0
        symbols: list[str | None] = [MARK if c == " " else _LITERAL if c == MARK else c for c in word]
        count = len(symbols)
        before, after = list(range(-1, count - 1)), [*range(1, count), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                merged = symbols[left] + symbols[right]  # type: ignore[operator]
                if merged in score:
                    heapq.heappush(agenda, (score[merged][0], left, right, merged))

        for i in range(count - 1):
            propose(i, i + 1)
        while agenda:
            _, left, right, merged = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right or len(merged) != len(symbols[left]) + len(symbols[right]):
                continue  # one of the two has been merged with another since
            met += 1
            if skipped[met - 1]:
                continue
            symbols[left], symbols[right] = merged, None
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            propose(before[left], left)
            propose(left, after[left])
        ids: list[int] = []
        for symbol in symbols:
            if symbol is not None:
                found = score.get(symbol)
                ids += [found[1]] if found else [self.of_byte[b] for b in (MARK if symbol == _LITERAL else symbol).encode()]
        return ids, met

    def _keep(self, found: list[list[int]], used: int) -> tuple[np.ndarray, np.ndarray]:
        """Puts ids into the memory from ``used`` on: where those of each word begin, and how many they are."""
        flat = [i for ids in found for i in ids]
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[used : used + len(flat)] = flat
        count = np.array([len(ids) for ids in found], np.int64)
        return used + np.cumsum(count) - count, count

    def _grow(self, roots: np.ndarray, parents: np.ndarray, last: np.ndarray) -> np.ndarray:
        """New nodes: of a word, with all that the parent skips and candidate ``last``; roots have no parent and -1."""
        first, rows, numbers = self.known, [], []
        row, above, number = np.arange(len(roots)), parents, last
        while len(row):
            real = number >= 0
            row, above, number = row[real], above[real], number[real]
            rows.append(row)
            numbers.append(number)
            above, number = self.nodes[PARENT, above], self.nodes[LAST, above]
        pairs = np.sort(np.concatenate(numbers or [row]) << 32 | np.concatenate(rows or [row]))

        def skipped(rows: np.ndarray, k: int) -> np.ndarray:
            flag = np.zeros(len(roots), bool)
            a, b = np.searchsorted(pairs, [k << 32, k + 1 << 32])
            flag[pairs[a:b] & 0xFFFFFFFF] = True
            return flag[rows]

        found, met = self.segment_all([self.words[r].decode() for r in roots.tolist()], skipped)
        start, count = self._keep(found, self.used)
        stops = np.cumsum(met) + self.branches
        while first + len(roots) > self.nodes.shape[1]:
            self.nodes = np.concatenate([self.nodes, np.empty_like(self.nodes)], axis=1)
        while stops[-1] > len(self.children):
            self.children = np.concatenate([self.children, np.empty_like(self.children)])
        self.children[self.branches : stops[-1]] = -1
        self.nodes[:, first : first + len(roots)] = start, count, met, stops - met, roots, parents, last
        self.used, self.branches, self.known = self.used + int(count.sum()), int(stops[-1]), first + len(roots)
        return np.arange(first, self.known)

    def _walk(self, node: np.ndarray, keys: np.ndarray, branching: np.ndarray, limit: np.uint64) -> None:
        """Moves every occurrence from its root to the node of its lots; to -1 if it skips and its word keeps a root alone."""
        at = np.flatnonzero(node >= 0)
        begin = np.zeros(len(at), np.int64)
        while len(at):
            number = first_skip(keys[at], begin, self.nodes[MET, node[at]], limit)
            node[at[(number >= 0) & ~branching[at]]] = -1
            on = (number >= 0) & branching[at]
            at, number = at[on], number[on]
            branch = self.nodes[CHILD, node[at]] + number
            lacking = np.flatnonzero(self.children[branch] < 0)
            if len(lacking):
                new, one = np.unique(branch[lacking], return_index=True)
                parents = node[at[lacking[one]]]
                grown = self._grow(self.nodes[ROOT, parents], parents, number[lacking[one]])
                self.children[new] = grown
            node[at], begin = self.children[branch], number + 1

    def encode(self, texts: list[str], keys: np.ndarray, chance: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin.  ``keys`` tell the documents apart.

        A text gets a space in front, and a word is a run of spaces with what follows them.
        """
        if self.known > REMEMBERED:
            self._forget()
        base = _mix(seed & _M64)
        raw = [b" " + t.encode() if t else b"" for t in texts]
        whole, offsets = b"".join(raw), np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(r) for r in raw], out=offsets[1:])
        data = np.frombuffer(whole, np.uint8)
        space = data == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]  # a word begins with the first space behind other characters, or of the text
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        word_first = per_text(starts, offsets)
        owner = np.repeat(np.arange(len(texts)), np.diff(word_first))
        place = (np.arange(len(starts)) - word_first[owner]).astype(np.uint64)
        with np.errstate(over="ignore"):
            own = mixed(place + mixed(keys ^ np.uint64(base))[owner])
        node = np.full(len(starts), -1, np.int64)
        brief = ends - starts <= SHORT
        short = np.flatnonzero(brief)
        rows = short_words(data, starts[short], ends[short])
        node[short] = self.short.find(rows)
        missing = np.flatnonzero(node < 0)
        words = [whole[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
        # Words beyond the last width are not remembered: in nearly every occurrence something is skipped.
        new = [w for w in dict.fromkeys(words) if w not in self.long and len(w.decode()) <= WIDTHS[-1]]
        if new:
            self.words += new
            none = np.full(len(new), -1)
            roots = self._grow(np.arange(len(self.words) - len(new), len(self.words)), none, none)
            number = dict(zip(new, roots.tolist(), strict=True))
            self.long.update((w, n) for w, n in number.items() if len(w) > SHORT)
            fresh = np.flatnonzero(node[short] < 0)
            node[missing] = [number[w] if w in number else self.long.get(w, -1) for w in words]
            _, once = np.unique(node[short[fresh]], return_index=True)
            self.short.add(rows[fresh[once]], node[short[fresh[once]]])
        else:
            node[missing] = [self.long.get(w, -1) for w in words]
        limit = np.uint64(min(int(chance * (1 << 64)), _M64))
        if chance:
            self._walk(node, own, brief, limit)
        alone = np.flatnonzero(node < 0)
        begin, lengths = self.nodes[START, node], self.nodes[COUNT, node]
        if len(alone):  # their ids go behind those that are remembered, for this call
            spans = zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)
            found, _ = self.segment_all([whole[a:b].decode() for a, b in spans], lambda row, k: lots(own[alone[row]], k, limit))
            begin[alone], lengths[alone] = self._keep(found, self.used)
        stops = np.cumsum(lengths)
        ids = self.ids[np.repeat(begin - stops + lengths, lengths) + np.arange(int(lengths.sum()))]
        return ids, np.concatenate([[0], stops])[word_first]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The bytes of each text."""
        lengths = self.length[ids]
        stops = np.cumsum(lengths)
        at = np.repeat(self.begin[ids] - stops + lengths, lengths) + np.arange(int(stops[-1]) if len(stops) else 0)
        whole = self.raw[at].tobytes()
        bounds = np.concatenate([[0], stops])[first].tolist()
        return [whole[a:b][1:] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def codec(name: str) -> PieceCodec:
    return held(("pieces", name), lambda: PieceCodec(tokenizer_path(name)))


def encode(docs: DataFrame, model: str = MODEL, chance: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id and ids of every row; other columns are left out.

    Null texts count as empty and have no ids.  Rows with the same doc_id and text have the same ids.  ``chance`` 0 gives the
    library's own encoding, but for literal word marks in a text: the library takes them for spaces, here they become their
    bytes, so that they are not lost.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        keys = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        ids, first = codec(model).encode(texts, keys, chance, seed)
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(over_slices(work), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, model: str = MODEL, chance: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, ids as ``encode`` gives them, and of the text that they decode to, n_bytes and sha256.

    Both ways are gone in the same task, so that neither ids nor texts travel between workers for the check.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        keys = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        ids, first = codec(model).encode(texts, keys, chance, seed)
        back = codec(model).decode(ids, first)
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
        sizes, digests = pa.array([len(t) for t in back], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, sizes, digests], names=["doc_id", "ids", "n_bytes", "sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(over_slices(work), "doc_id long, ids array<int>, n_bytes long, sha256 string")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids and the text of every row that ``encode`` gave; null ids give null text."""

    def work(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column("ids")
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(sizes)])
                texts = codec(model).decode(lists.flatten().to_numpy(zero_copy_only=False), first)
                valid = lists.is_valid().to_pylist()
                found = pa.array([t.decode(errors="replace") if v else None for t, v in zip(texts, valid, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, found], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids array<int>, text string")
