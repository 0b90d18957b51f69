"""Token counts with a whole-token shortcut, without building the tokens.

A SentencePiece BPE model merges neighbouring symbols into longer ones as long as the result is in its vocabulary.  Two
facts of a model, proved once from its file, make most of that work needless:

* **Boundaries.**  If no piece holds a word mark after another character, no merge reaches over the start of a word.
  A text then falls apart at its spaces, and its count is the sum over the parts.
* **Whole tokens.**  Every vocabulary string that starts a word is encoded alone; where that gives exactly one token,
  each occurrence of the word counts one.

Parts that are no whole token are merged by the library, each distinct one once for as long as it is remembered.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from beaconloom.llm.common import held, over_slices, tokenizer_path

MARK = "▁"
#: Distinct parts whose counts a task remembers; beyond, it starts over from the whole tokens.
REMEMBERED = 400_000
LIMIT = 4096


class TokenCounter:
    """Counts as the library gives them, for one model file."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.remembered = remembered
        self.splits = self._splits()
        self.whole = self._whole_tokens() if self.splits else {}
        self.counts = dict(self.whole)

    def _splits(self) -> bool:
        """Whether the start of a word is a boundary in every text: no piece has a mark behind another character, and
        spaces become marks one by one, with one more in front."""
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(MARK in name.lstrip(MARK) for name in names):
            return False
        probes = {" ": 2, "   ": 4, " a  a ": 6}
        shown = {p: "".join(self.library.encode(p, out_type=str)) for p in probes}
        return all(shown[p] == MARK + p.replace(" ", MARK) for p in probes)

    def _whole_tokens(self) -> dict[bytes, int]:
        words = []
        for i in range(self.library.get_piece_size()):
            name = self.library.id_to_piece(i)
            special = self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)
            if not special and len(name) > 1 and name[0] == MARK and MARK not in name[1:]:
                words.append((i, name[1:]))
        found = self.library.encode([w for _, w in words], num_threads=1)
        return {w.encode(): 1 for (i, w), ids in zip(words, found, strict=True) if ids == [i]}

    def _parts(self, text: bytes) -> list[bytes]:
        """The words of a text; runs of spaces stay with the word behind them."""
        if text.startswith(b" ") or text.endswith(b" ") or b"  " in text:
            return [part[1:] for part in re.findall(rb" +[^ ]*", b" " + text)]
        return text.split(b" ")

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        parted: list[tuple[int, list[bytes]]] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.splits or MARK in text:
                out[i] = len(self.library.encode(text, num_threads=1))
            else:
                parted.append((i, self._parts(text.encode())))
        counts = self.counts
        if len(counts) > self.remembered:
            counts = self.counts = dict(self.whole)
        new = set()
        for _, parts in parted:
            new.update(parts)
        new = [part for part in new if part not in counts]
        for part, ids in zip(new, self.library.encode([p.decode() for p in new], num_threads=1), strict=True):
            counts[part] = len(ids) or 1  # nothing behind the mark: the mark alone
        for i, parts in parted:
            out[i] = sum(map(counts.__getitem__, parts))
        return out


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; other columns are left out.

    Null and empty texts have no tokens.  Texts are whole, whatever their length.  Repeated rows stay repeated.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = held(("token counts", model), lambda: TokenCounter(tokenizer_path(model)))
        texts = [t or "" for t in batch.column("text").to_pylist()]
        counts = counter.count(texts)
        sizes = np.array([len(t.encode()) for t in texts], np.int64)
        columns = [batch.column("doc_id"), pa.array(sizes), pa.array(counts), pa.array(counts > limit)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(over_slices(work), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
