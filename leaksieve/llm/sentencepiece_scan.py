"""SentencePiece (BPE) encoding and decoding by a max-plus parallel scan.

A segmentation is the model's own exactly when each two neighbouring tokens are, that is when merging the
two's text alone gives those two tokens. So the encoding is the one path of finite weight through a
lattice whose steps weigh 0 (neighbours agree) or minus infinity (they don't): a max-plus problem, whose
chunks can be solved apart.

* A long text is cut into chunks at fixed code points. The state at a boundary is the token that covers or
  meets it, as (characters before, characters after) the boundary. A chunk's transfer matrix has the pairs
  of entry and exit states that a path through the chunk joins; the others weigh minus infinity.
* Matrices are combined by ``combine``, an associative max-plus product, in a tree: each round joins up to
  ``FAN`` neighbours, whatever text they're of, until a text has one matrix. On the way back each node, whose
  two outer states are known, tells its parts theirs.
* Each chunk is then traced back between its two states, apart from all others.

A short text is one chunk. Inside a chunk no token crosses from a letter to a following space mark, if the
vocabulary has none that does: a segment between such places has one entry and one exit state, so its path
is that of the model's merges, and as segments repeat a worker remembers theirs. The lattice is walked from
a boundary to the first such place, and through whole chunks that have none.

No task holds more than ``FAN`` matrices of a text; texts, ids and traces stay spread by chunk.

Models are BPE ones that leave texts as they are: spaces marked, one mark in front, nothing removed or
normalised, no pieces of the user's own. ``Pieces`` refuses all others, as their encoding is another one.

Defined results: a null text counts as empty and has no tokens; repeated rows are encoded apart; an empty
table gives no rows. Texts that hold the space mark U+2581 itself decode to spaces, as in any
SentencePiece model. Other columns are never looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, kept, sliced, stage

SPACE = "▁"
#: Code points of a chunk, and segments that a worker remembers.
CHUNK, REMEMBERED = 16_384, 400_000
#: Texts or chunks that a task holds together, and neighbours that a round of the tree combines.
AT_ONCE, FAN = 200, 16
State = tuple[int, int]
START: State = (0, 0)
NEVER = float("inf")


def _refuse_others(proto) -> None:
    trainer, norm = proto.trainer_spec, proto.normalizer_spec
    wrong = [
        what
        for what, found in {
            "isn't BPE": trainer.model_type != trainer.BPE,
            "normalises characters": bool(norm.precompiled_charsmap),
            "removes white space": norm.remove_extra_whitespaces,
            "doesn't mark a text's start": not norm.add_dummy_prefix,
            "doesn't mark spaces": not norm.escape_whitespaces,
            "marks spaces behind words": trainer.treat_whitespace_as_suffix,
            "has pieces of the user's own": any(p.type in (4, 5) for p in proto.pieces),
        }.items()
        if found
    ]
    if wrong:
        raise ValueError(f"a model that {', '.join(wrong)} can't be used here")


class Pieces:
    """A BPE model's pieces and what follows from them."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        _refuse_others(proto)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == 1}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.names = [chr(self.bytes_of[i]) if i in self.bytes_of else p.piece for i, p in enumerate(proto.pieces)]
        self.wide = np.array([self.bytes_of.get(i, 0) >= 128 for i in range(len(self.names))])
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == 2), 0)
        self.longest = max(map(len, self.ids))
        lone = "" if any("\n" in p for p in self.ids) else "\n"
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.segments = re.compile(r"(?s).+" if crossing else rf"{lone or '(?!)'}|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+")
        self.crossing = crossing
        self.agrees: dict[tuple[str, str], bool] = {}
        self.packed: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Lowest-ranked, then leftmost, merges until none is left."""
        parts, rank = list(text), self.rank
        ranks = [rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], NEVER)
        return parts

    def agree(self, a: str, b: str) -> bool:
        if len(self.agrees) > REMEMBERED:
            self.agrees.clear()
        found = self.agrees.get((a, b))
        if found is None:
            found = self.agrees[a, b] = self.merged(a + b) == [a, b]
        return found

    def is_token(self, text: str) -> bool:
        return len(text) == 1 or text in self.ids

    def walk(self, text: str, start: int, before: str | None, stop: int) -> dict[int, str]:
        """For each position up to ``stop`` that a path from ``start`` reaches, the token that ends there."""
        last: dict[int, str] = {start: before or ""}
        ids, agrees, reached = self.ids, self.agrees, last.get
        for p in range(start + 1, stop + 1):
            for q in range(max(start, p - self.longest), p):
                t = text[q:p]
                if t in ids or p - q == 1:
                    prior = reached(q)
                    if prior is None:
                        continue
                    fits = not prior or agrees.get((prior, t))
                    if fits is None:
                        fits = self.agree(prior, t)
                    if fits:
                        last[p] = t
                        break
        return last

    def ids_of(self, token: str) -> list[int]:
        found = self.ids.get(token)
        if found is not None:
            return [found]
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in token.encode("utf-8", "surrogatepass")]

    def trace(self, last: dict[int, str], end: int, start: int) -> list[int]:
        tokens = []
        while end > start:
            tokens.append(last[end])
            end -= len(tokens[-1])
        return [i for t in reversed(tokens) for i in self.ids_of(t)]

    def segment_ids(self, segment: str) -> bytes:
        found = self.packed.get(segment)
        if found is None:
            found = pack(f"<{len(ids)}I", *ids) if (ids := [i for t in self.merged(segment) for i in self.ids_of(t)]) else b""
            if len(self.packed) < REMEMBERED:  # the first segments met are the frequent ones
                self.packed[segment] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of text whose both ends no token crosses; the space marks are in place."""
        return np.frombuffer(b"".join(map(self.segment_ids, self.segments.findall(text))), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        if self.wide[ids].any():  # characters of several bytes
            out, held = [], bytearray()
            for i in ids.tolist():
                b = self.bytes_of.get(i)
                if b is not None:
                    held.append(b)
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(self.names[i])
            out.append(held.decode("utf-8", "replace"))
        else:
            out = map(self.names.__getitem__, ids.tolist())
        return "".join(out).replace(SPACE, " ")

    def first_break(self, text: str, start: int, stop: int) -> int | None:
        """The first place in start..stop where no token crosses, if the vocabulary has such places."""
        if self.crossing:
            return None
        m = re.compile(rf"[^{SPACE}](?={SPACE})|\n(?=.)", re.S).search(text, max(start - 1, 0), stop)
        return m.end() if m and start <= m.end() < stop else None


def marked(text: str) -> str:
    """The text as the model sees it: a space mark first, and for each space."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def states(pieces: Pieces, before: str, after: str) -> list[State]:
    """Tokens that cover or meet the boundary between the two texts."""
    longest = pieces.longest
    return [(j, k) for j in range(1, min(len(before), longest) + 1) for k in range(0, min(len(after), longest - j) + 1) if pieces.is_token(before[len(before) - j :] + after[:k])]


def transfer(pieces: Pieces, before: str, chunk: str, after: str) -> list[tuple[State, State]]:
    """The chunk's finite entries: pairs of an entry and an exit state. No ``before``: the text begins here; no ``after``: it ends."""
    entries = states(pieces, before, chunk) if before else [START]
    exits = states(pieces, chunk, after)
    size = len(chunk)
    exits = [(j, k) for j, k in exits if after or k == 0]
    cut = pieces.first_break(chunk, pieces.longest, size - pieces.longest)
    shared: dict[int, str] | None = None
    if cut is not None:  # from here on all entries see the same; only the end's states need a walk
        at = size - pieces.longest
        tail = max((m.end() for m in re.finditer(rf"[^{SPACE}](?={SPACE})|\n(?=.)", chunk[: at + 1], re.S) if m.end() <= at), default=cut)
        shared = pieces.walk(chunk, max(tail, cut), None, size)
    found = []
    for j, k in entries:
        entry = before[len(before) - j :] + chunk[:k] if j else None
        if shared is not None:
            if cut not in pieces.walk(chunk, k, entry, cut):
                continue
            last = shared
        else:
            last = pieces.walk(chunk, k, entry, size)
        for x, y in exits:
            q = size - x
            if q in last and (not last[q] or pieces.agree(last[q], chunk[q:] + after[:y])):
                found.append(((j, k), (x, y)))
    return found


def combine(one: list[tuple[State, State]], two: list[tuple[State, State]]) -> list[tuple[State, State]]:
    """The max-plus product of two neighbouring chunks' matrices: associative."""
    by_entry: dict[State, list[State]] = {}
    for a, b in two:
        by_entry.setdefault(a, []).append(b)
    return sorted({(a, c) for a, b in one for c in by_entry.get(b, ())})


def path_of_states(matrices: list[list[tuple[State, State]]], start: State = START, end: State | None = None) -> list[State]:
    """The states at the boundaries, the start's and the end's included, that lie on the one path between the two."""
    forward = [{start}]
    for m in matrices:
        forward.append({b for a, b in m if a in forward[-1]})
    state = min(forward[-1]) if end is None else end
    out = [state]
    for m, reached in zip(reversed(matrices), reversed(forward[:-1]), strict=True):
        state = next(a for a, b in m if b == state and a in reached)
        out.append(state)
    return out[::-1]


def packed_matrix(matrix: list[tuple[State, State]]) -> bytes:
    return np.array(matrix, np.uint8).reshape(-1, 4).tobytes()


def matrix_of(packed: bytes) -> list[tuple[State, State]]:
    return [((a, b), (c, d)) for a, b, c, d in np.frombuffer(packed, np.uint8).reshape(-1, 4).tolist()]


def _paths(chunks: DataFrame) -> DataFrame:
    """row, chunk_no, matrix of chunks to row, chunk_no and the states j, k before and x, y after each."""

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("parts"):
                one, *more = (matrix_of(p["matrix"]) for p in parts.as_py())
                for m in more:
                    one = combine(one, m)
                out.append(packed_matrix(one))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("no"), pa.array(out, pa.binary())], names=["row", "no", "matrix"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                path = path_of_states([matrix_of(p["matrix"]) for p in r["parts"]], (r["j"], r["k"]), (r["x"], r["y"]))
                out += [(r["row"], p["no"], *a, *b) for p, a, b in zip(r["parts"], path, path[1:], strict=False)]
            kinds = (pa.int64(), pa.int32(), *(pa.int32(),) * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)], names=["row", "no", "j", "k", "x", "y"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = [min(b for a, b in matrix_of(m.as_py()) if a == START) for m in batch.column("matrix")]
            zeros = pa.array([0] * len(batch), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("no"), zeros, zeros, pa.array([x for x, _ in last], pa.int32()), pa.array([y for _, y in last], pa.int32())], names=["row", "no", "j", "k", "x", "y"])

    STATES = "row long, no int, j int, k int, x int, y int"
    level = chunks.select("row", F.col("chunk_no").alias("no"), "matrix")
    most = (level.agg(F.max("no")).first()[0] or 0) + 1
    rounds = []
    while most > 1:
        part = F.struct("no", "matrix")
        groups = stage(level.groupBy("row", F.floor(F.col("no") / FAN).cast("int").alias("up")).agg(F.sort_array(F.collect_list(part)).alias("parts")).withColumnRenamed("up", "no"), "matrices")
        rounds.append(groups)
        level = groups.mapInArrow(combined, "row long, no int, matrix binary")
        most = -(-most // FAN)
    states = level.mapInArrow(ends, STATES)
    for groups in reversed(rounds):
        states = groups.join(states, ["row", "no"]).mapInArrow(told, STATES)
    return states.withColumnRenamed("no", "chunk_no")


def chunk_ids(pieces: Pieces, before: str, chunk: str, after: str, entry: State, leave: State) -> np.ndarray:
    """The ids of the tokens that begin in the chunk, between its two states. The token of ``leave`` begins in it."""
    j, k = entry
    size, token = len(chunk), before[len(before) - j :] + chunk[:k] if j else None
    q = size - leave[0]
    cut = pieces.first_break(chunk, pieces.longest, size - pieces.longest)
    if cut is None or cut > q:
        head = pieces.trace(pieces.walk(chunk, k, token, q), q, k)
        middle = np.zeros(0, "<u4")
    else:
        head = pieces.trace(pieces.walk(chunk, k, token, cut), cut, k)
        middle = pieces.encode(chunk[cut:q]) if q > cut else np.zeros(0, "<u4")
        # up to q the segments are whole or the last one is a token sequence that ends there by itself
    return np.concatenate([np.array(head, "<u4"), middle, np.array(pieces.ids_of(chunk[q:] + after[: leave[1]]), "<u4")])


def chunks_of(text: str, size: int, margin: int) -> list[tuple[str, str, str]]:
    """(before, chunk, after) of each chunk; the last takes the rest."""
    n = max(1, len(text) // size)
    cuts = [*range(0, n * size, size), len(text)]
    return [(text[max(0, a - margin) : a], text[a:b], text[b : b + margin]) for a, b in zip(cuts, cuts[1:], strict=False)]


def sums_of(ids: np.ndarray) -> tuple[int, int, int]:
    """Count, sum and position-weighted sum of ids: they add up over chunks."""
    x = ids.astype(np.int64)
    return len(x), int(x.sum()), int((x * np.arange(1, len(x) + 1)).sum())


def _pieces(model: bytes) -> Pieces:
    """The model's pieces, kept as long as the Python worker."""
    memo = kept(f"pieces_{zlib.crc32(model)}")
    if "pieces" not in memo:
        memo["pieces"] = Pieces(model)
    return memo["pieces"]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per chunk: doc_id, row (a text's own number), chunk_no, n_tokens, ids (packed), chunk text length and round_trip."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a model file, whatever the corpus

    FIRST = "doc_id long, row long, chunk_no int, before string, chunk string, after string, matrix binary, ids binary, same boolean"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, row = _pieces(shared.value), TaskContext.get().partitionId() << 36
        margin = pieces.longest
        assert chunk > 4 * margin
        names = [x.split()[0] for x in FIRST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.bool_()]
        for batch in sliced(batches, AT_ONCE, keep="pieces"):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text, row = text.as_py() or "", row + 1
                parts = chunks_of(marked(text), chunk, margin)
                if len(parts) == 1:
                    ids = pieces.encode(parts[0][1])
                    out.append((doc_id, row, 0, None, None, None, None, ids.tobytes(), pieces.decode(ids)[1:] == text))
                    continue
                for no, (before, part, after) in enumerate(parts):
                    out.append((doc_id, row, no, before, part, after, packed_matrix(transfer(pieces, before, part, after)), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 9, kinds, strict=True)], names=names)

    def retrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        for batch in sliced(batches, AT_ONCE, keep="pieces"):
            out = []
            for r in batch.to_pylist():
                entry, leave = (r["j"], r["k"]), (r["x"], r["y"])
                ids = chunk_ids(pieces, r["before"], r["chunk"], r["after"], entry, leave)
                whole = r["chunk"][entry[1] :] + r["after"][: leave[1]]
                out.append((r["doc_id"], r["row"], r["chunk_no"], ids.tobytes(), pieces.decode(ids) == whole.replace(SPACE, " ")))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 5, kinds, strict=True)], names=["doc_id", "row", "chunk_no", "ids", "same"])

    source = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    solved = stage(source.mapInArrow(solve, FIRST), "chunks")
    long = solved.where("matrix is not null")
    traced = long.drop("matrix", "ids", "same").join(_paths(long), ["row", "chunk_no"]).mapInArrow(retrace, "doc_id long, row long, chunk_no int, ids binary, same boolean")
    return solved.where("matrix is null").select("doc_id", "row", "chunk_no", "ids", "same").union(traced)


def summarise(encoded: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sum, ids_weighted (each id times its place from 1, mod 2^63), round_trip."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sums_of(np.frombuffer(x.as_py(), "<u4")) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "chunk_no", "same")), *(pa.array([s[i] for s in found], pa.int64()) for i in range(3))], names=["doc_id", "row", "chunk_no", "same", "n", "total", "weighted"])

    parts = encoded.mapInArrow(sums, "doc_id long, row long, chunk_no int, same boolean, n long, total long, weighted long")
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("row").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("weighted", F.col("weighted") + offset * F.col("total"))
    return placed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("total").alias("ids_sum"), F.sum("weighted").alias("ids_weighted"), F.min("same").alias("round_trip")).drop("row")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """Texts of encoded chunks: doc_id, row, chunk_no, text. A text is its chunks' texts in their order; the first loses the leading space."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        for batch in batches:
            texts = [pieces.decode(np.frombuffer(x.as_py(), "<u4"))[no == 0 :] for x, no in zip(batch.column("ids"), batch.column("chunk_no").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "chunk_no")), pa.array(texts, pa.string())], names=["doc_id", "row", "chunk_no", "text"])

    return encoded.select("doc_id", "row", "chunk_no", "ids").mapInArrow(decode, "doc_id long, row long, chunk_no int, text string")
