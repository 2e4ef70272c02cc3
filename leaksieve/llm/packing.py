"""Order-preserving packing of token streams into windows, by dynamic programming.

Each task packs the documents of its own input split in their order, so no row moves: at 100 TB as on a
laptop a task holds one block of tokens and the documents in it. Windows may end at document ends, and at
sentence ends for a small penalty. Inside a sentence they may not, unless it is longer than a window: there
they may end on a grid, for a large penalty. Over the cut points p of a block

    f(j) = penalty(j) + window - p(j) + min { f(i) + p(i) : p(j) - p(i) <= window },

whose minimum over a sliding range is kept in a monotone queue, so a block takes time linear in its cuts.
A block's last window counts no padding: it is carried into the next block. What is left at a split's end is cut into powers of
two, which need no padding.

Defined results: a null text counts as empty; every document, empty ones too, ends with the end id, so
has at least one token; repeated rows are packed apart; an empty table gives no rows. Other columns are
never looked at. Sequence ids are unique, not gapless: the split's number and a count.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, give_back, kept

WINDOW, END_ID = 2048, 1
#: Penalties of a cut, in tokens of padding: at a sentence's end, and inside a sentence.
AT_SENTENCE, IN_SENTENCE = 4, 32
#: Tokens of a block at least, and words whose ids a worker remembers.
BLOCK, REMEMBERED = 1 << 18, 900_000  # at about 150 bytes a word a worker's memo stays under 150 MB
#: Tokens between the places inside a sentence longer than a window where one may end.
GRID = 16
SENTENCE_ENDS = (".", "!", "?")
#: Characters that may part words in one text; the first that is one token does.
MARKS = ("¬", "§", "¶", "|")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Packed ids of texts, word by word.

    The tokenizer's own splitting never joins what white space parts, so a text's ids are those of its
    space-separated words, and those repeat.
    """

    def __init__(self, tokenizer_json: str):
        memo = kept(f"word_ids_{zlib.crc32(tokenizer_json.encode())}")
        if "tokenizer" not in memo:
            from tokenizers import Tokenizer

            memo["tokenizer"], memo["ids"] = Tokenizer.from_str(tokenizer_json), {}
            memo["mark"] = next(((c, i[0]) for c in MARKS if len(i := memo["tokenizer"].encode(c, add_special_tokens=False).ids) == 1), None)
        self.tokenizer, self.ids, self.mark = memo["tokenizer"], memo["ids"], memo["mark"]

    def _learn(self, words: list[bytes]) -> None:
        """Add the words' ids. Many words are one text for the tokenizer, parted by a mark that none of them holds."""
        plain = words
        if self.mark:
            char, mark_id = self.mark
            byte = char.encode()
            joined = [w for w in words if byte not in w]
            plain = [w for w in words if byte in w]
            groups = [joined[i : i + 256] for i in range(0, len(joined), 256)]
            texts = [f" {char} ".join(w.decode() for w in g) for g in groups]
            for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                packed, ends = ids.tobytes(), np.r_[np.flatnonzero(ids == mark_id), len(ids)].tolist()
                start = 0
                for w, end in zip(g, ends, strict=True):
                    self.ids[w] = packed[4 * start : 4 * end]
                    start = end + 1
        for w, e in zip(plain, self.tokenizer.encode_batch_fast([w.decode() for w in plain], add_special_tokens=False), strict=True):
            self.ids[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() for t in texts]
        ids = self.ids
        missing = set().union(*words).difference(ids)
        if missing:
            self._learn([*missing])
        out = [b"".join(map(ids.__getitem__, ws)) for ws in words]
        if len(ids) > REMEMBERED:  # the first words met are the frequent ones, and they stay
            for w in missing:
                del ids[w]
        return out


def cut_points(tokens: np.ndarray, doc_ends: np.ndarray, sentence_ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a block may be cut, with 0 first, and what each cut costs."""
    sentence = np.flatnonzero(np.isin(tokens, sentence_ids)) + 1
    ends = np.union1d(sentence, doc_ends)
    long = np.flatnonzero(np.diff(ends, prepend=0) > window)
    inside = [np.arange((ends[k - 1] if k else 0) + GRID, ends[k], GRID) for k in long]
    every = np.union1d(ends, np.concatenate(inside)) if inside else ends
    cost = np.where(np.isin(every, doc_ends, assume_unique=True), 0, np.where(np.isin(every, sentence, assume_unique=True), AT_SENTENCE, IN_SENTENCE))
    return np.r_[0, every], np.r_[0, cost]


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int, open_end: bool = False) -> list[int]:
    """The cuts of least padding plus penalties, first (0) and last included. With ``open_end`` the last window needs no padding."""
    p, c = at.tolist(), cost.tolist()
    f, back = [0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])
    value = [0] * len(p)  # f(i) + p(i)
    for j in range(1, len(p)):
        pj = p[j]
        while pj - p[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        back[j] = i
        f[j] = value[i] + c[j] + window - pj
        value[j] = v = f[j] + pj
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    if open_end and len(p) > 1:
        first = bisect_left(p, p[-1] - window)
        back[-1] = min(range(first, len(p) - 1), key=f.__getitem__)
    out, j = [p[-1]], len(p) - 1
    while j:
        j = back[j]
        out.append(p[j])
    return out[::-1]


class _Packer:
    """A split's stream: documents go in, pieces come out."""

    def __init__(self, sentence_ids: np.ndarray, window: int, first_sequence: int):
        self.sentence_ids, self.window, self.sequence = sentence_ids, window, first_sequence
        self.docs: list[list] = []  # id, packed ids still to place, tokens placed, tokens in all
        self.held = 0

    def add(self, doc_id, ids: bytes) -> None:
        self.docs.append([doc_id, ids, 0, len(ids) // 4])
        self.held += len(ids) // 4

    def place(self, last: bool) -> list[tuple]:
        """Pieces of the windows that are settled: all but the last one, unless nothing follows."""
        if not self.docs:
            return []
        sizes = np.array([len(d[1]) // 4 for d in self.docs])
        ends = np.cumsum(sizes)
        tokens = np.frombuffer(b"".join(d[1] for d in self.docs), "<u4")
        cuts = best_cuts(*cut_points(tokens, ends, self.sentence_ids, self.window), self.window, open_end=True)
        if last:
            cuts[-1:] = self._tail(cuts[-2], cuts[-1])
        else:
            cuts.pop()
        out, k = [], 0
        for start, end in zip(cuts, cuts[1:], strict=False):
            offset = 0
            while start + offset < end:
                while ends[k] <= start + offset:
                    k += 1
                doc = self.docs[k]
                n = int(min(ends[k], end)) - start - offset
                piece, doc[1] = doc[1][: 4 * n], doc[1][4 * n :] if n < 2 * self.window else memoryview(doc[1])[4 * n :]
                out.append((doc[0], doc[2], n, zlib.crc32(piece), doc[3], self.sequence, offset))
                doc[2] += n
                offset += n
            self.sequence += 1
        self.docs = [d for d in self.docs if len(d[1])]
        self.held -= cuts[-1]
        return out

    def _tail(self, start: int, end: int) -> list[int]:
        """Cuts after ``start`` that leave no padding: the window itself if full, else powers of two."""
        left, out = end - start, []
        if left == self.window:
            return [end]
        while left:
            start += 1 << (left.bit_length() - 1)
            left = end - start
            out.append(start)
        return out


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the corpus

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(shared.value)
        sentence_ids = np.unique([words.tokenizer.encode(x, add_special_tokens=False).ids[-1] for x in SENTENCE_ENDS])
        packer = _Packer(np.append(sentence_ids, end_id), window, TaskContext.get().partitionId() << 36)
        end = np.array([end_id], "<u4").tobytes()

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(0, len(ids), 256):
                part = [x.as_py() or b"" for x in texts[i : i + 256]]
                for doc_id, packed in zip(ids[i : i + 256].to_pylist(), words.encode(part), strict=True):
                    packer.add(doc_id, packed + end)
                if packer.held >= BLOCK:
                    yield rows(packer.place(last=False))
        yield rows(packer.place(last=True))
        give_back()

    source = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("binary").alias("text"))
    return source.mapInArrow(pack, PIECES)
