"""Chat formatting at the level of tokens: segments are encoded apart, and reserved ids spliced between them.

A template marks each turn with control strings, which have ids of their own behind the vocabulary: no text can
encode to them. Texts are encoded alone, so a turn's ids don't depend on its neighbours. Control strings that
occur in a text, a tokenizer's special tokens too, are escaped by a sign after their first character, and signs
that already stand there get one more; so the formatted text can be read back as well as the ids. Where a turn
begins in its conversation is a prefix sum over the turns before; the loss mask is one over +1 and -1 at the
ends of the learned segments.

Turns are dealt by conversation and block of ``BLOCK`` turn numbers, not by conversation: a conversation that
holds a third of all rows is many tasks' work, whose sums are then carried from block to block. Rows stream
through a task in order; it holds some hundred of them.

Defined results: a null text or role counts as empty; a null conversation is one of its own, and null turns come
first; rows of the same turn follow by role and text, and repeated rows are turns of their own. Roles other than
system, user and assistant keep their name. Only assistant texts are learned, without their control strings; an
empty one has no learned token. An empty table gives no rows. Other columns are never looked at. A text over
``LONG`` characters is encoded in parts cut where the tokenizer never joins, with the same ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, give_back, kept, sliced

#: Turn numbers of a block as a power of two, rows of an Arrow batch, and characters that are encoded at once.
BLOCK, ROWS, LONG = 12, 256, 1 << 16
#: Conversations of several blocks that are broadcast at most; more are joined by a shuffle.
LISTED = 100_000
ROLE = ("[ROLE]", "[/ROLE]")


@dataclass(frozen=True)
class Template:
    """Opening and closing control strings by role; those of ``""`` stand for any other role, whose name comes before, between ``ROLE``."""

    marks: tuple[tuple[str, str, str], ...] = (("system", "[SYS]", "[/SYS]"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"), ("", "[TURN]", "[/TURN]"))
    learned: tuple[str, ...] = ("assistant",)
    #: Strings that no text may hold either, such as the tokenizer's special tokens.
    reserved: tuple[str, ...] = ("<|endoftext|>",)
    sign: str = "\\"

    def __post_init__(self):
        starts = {c[:1] for c in (*self.controls, *self.reserved)}
        for c in (*self.controls, *self.reserved):
            if not c or self.sign in c or starts & set(c[1:]):
                raise ValueError(f"control string {c!r} can't be escaped")
        if len(set(self.controls)) != len(self.controls) or "" not in {m[0] for m in self.marks}:
            raise ValueError("control strings must differ, and other roles need some")

    @property
    def controls(self) -> tuple[str, ...]:
        """The control strings in the order of their ids."""
        return (*ROLE, *(c for m in self.marks for c in m[1:]))

    @cached_property
    def _patterns(self) -> tuple[re.Pattern, re.Pattern]:
        rests: dict[str, list[str]] = {}
        for c in (*self.controls, *self.reserved):
            rests.setdefault(c[0], []).append(re.escape(c[1:]))
        sign = re.escape(self.sign)
        some = lambda signs: "|".join(f"({re.escape(c)}){signs}(?={sign}*(?:{'|'.join(r)}))" for c, r in sorted(rests.items()))
        return re.compile(some("")), re.compile(some(sign))

    def escape(self, text: str) -> str:
        return self._patterns[0].sub(lambda m: m[0] + self.sign, text)

    def unescape(self, text: str) -> str:
        return self._patterns[1].sub(lambda m: m[0][0], text)


class Codec:
    """A tokenizer with the template's reserved ids behind its vocabulary."""

    def __init__(self, tokenizer_json: str, template: Template):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core's work
        memo = kept(f"chat_{hash(tokenizer_json)}")
        if "tokenizer" not in memo:
            from tokenizers import Tokenizer

            memo["tokenizer"] = Tokenizer.from_str(tokenizer_json)
            memo["tokenizer"].encode_special_tokens = True  # their strings are ordinary text
        self.tokenizer, self.template = memo["tokenizer"], template
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.strings = template.controls
        self.ids = {c: self.base + n for n, c in enumerate(self.strings)}
        self.opened = {m[1]: m for m in template.marks}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, escaped before."""
        parts, counts = [], []
        for t in texts:
            own = list(_parts(self.template.escape(t)))
            parts += own
            counts.append(len(own))
        ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        out, at = [], 0
        for n in counts:
            out.append(ids[at] if n == 1 else np.concatenate(ids[at : at + n]))
            at += n
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts as they stand between control strings, still escaped."""
        return self.tokenizer.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)

    def turns(self, roles: list[str], texts: list[str]) -> Iterator[tuple[np.ndarray, int, int]]:
        """Each turn's ids with control ids spliced in, and from where to where they are learned."""
        known = {m[0]: m for m in self.template.marks if m[0]}
        marks = [known.get(r, known.get("", next(m for m in self.template.marks if not m[0]))) for r in roles]
        named = [k for k, m in enumerate(marks) if not m[0]]
        segments = self.encode([*texts, *(roles[k] for k in named)])
        names = dict(zip(named, segments[len(texts) :], strict=True))
        for k, (m, text) in enumerate(zip(marks, segments, strict=False)):
            before = [self.ids[m[1]]] if k not in names else [self.ids[ROLE[0]], *names[k], self.ids[ROLE[1]], self.ids[m[1]]]
            ids = np.concatenate([np.array(before, np.int32), text, np.array([self.ids[m[2]]], np.int32)])
            learned = roles[k] in self.template.learned
            yield ids, len(before) if learned else 0, len(before) + len(text) if learned else 0

    def read(self, turns: list[np.ndarray], masks: list[np.ndarray]) -> Iterator[tuple[str, str, str, int]]:
        """role, text, learned text and formatted length of each turn, from ids and masks alone."""
        contents, shape = [], []
        for ids, mask in zip(turns, masks, strict=True):
            marks = np.flatnonzero(ids >= self.base)
            shape.append([(self.strings[ids[a] - self.base], len(contents) + n) for n, a in enumerate(marks)])
            contents += [ids[a + 1 : b] for a, b in zip(marks, [*marks[1:], len(ids)], strict=True)]
            contents.append(ids[mask])
        texts = self.decode(contents)
        plain = self.template.unescape
        end = 0
        for s in shape:
            end += len(s)
            role = plain(texts[s[0][1]]) if s[0][0] == ROLE[0] else self.opened[s[0][0]][0]
            (text,) = (texts[at] for c, at in s if c in self.opened)
            yield role, plain(text), plain(texts[end]), sum(len(c) + len(texts[at]) for c, at in s)
            end += 1


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about ``LONG`` characters, each but the first beginning with a lone space before a word: there no token crosses."""
    at = 0
    cut = re.compile(r"(?<=\S) (?=\S)")
    while len(text) - at > LONG:
        m = cut.search(text, at + LONG)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def masks(lengths: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The loss mask over all tokens of some turns, by a prefix sum of +1 at each learned segment's first token and -1 behind its last."""
    starts = np.cumsum(lengths) - lengths
    change = np.zeros(int(lengths.sum()) + 1, np.int32)
    np.add.at(change, starts + first, 1)
    np.add.at(change, starts + last, -1)
    return np.cumsum(change)[:-1] > 0


KEY = ("c", "x", "block")


def ordered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and the keys of a turn's block: c and x (the conversation, and whether it is null) and block."""
    own = column(conv_col)
    text = lambda c: F.coalesce(column(c), F.lit("")).alias
    d = rows.select(own.alias("conv_id"), column(turn_col).cast("long").alias("turn"), text(role_col)("role"), text(text_col)("text"))
    kind = dict(d.dtypes)["conv_id"]
    return d.withColumns({"c": F.coalesce("conv_id", F.lit("0").cast(kind)), "x": F.col("conv_id").isNull(), "block": F.shiftright("turn", BLOCK)})


def _streams(turns: DataFrame) -> DataFrame:
    return turns.repartition(*KEY).sortWithinPartitions(*KEY, "turn", "role", "text").select(*KEY, "conv_id", "role", "text")


def _pieces(codec: Callable[[], Codec]):
    """A task's sorted turns to pieces: c, x, block, conv_id, turn_no and start (both within the block), ids, loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, state = codec(), (None, 0, 0)
        for batch in sliced(batches, ROWS, keep="chat"):
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            turns = list(code.turns(batch.column(4).to_pylist(), batch.column(5).to_pylist()))
            numbers, starts = [], []
            for key, (ids, _, _) in zip(keys, turns, strict=True):
                if state[0] != key:
                    state = (key, 0, 0)
                numbers.append(state[1])
                starts.append(state[2])
                state = (key, state[1] + 1, state[2] + len(ids))
            lengths, first, last = (np.array(x, np.int64) for x in ([len(t[0]) for t in turns], [t[1] for t in turns], [t[2] for t in turns]))
            ends = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
            ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([t[0] for t in turns])))
            loss = pa.ListArray.from_arrays(ends, pa.array(masks(lengths, first, last)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), ids, loss], names=[*KEY, "conv_id", "turn_no", "start", "ids", "loss"])

    return run


def _read(codec: Callable[[], Codec]):
    """Pieces to turns as their ids and masks say: c, x, start, conv_id, role, text, loss_text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec()
        for batch in batches:
            for part in (batch.slice(k, ROWS) for k in range(0, len(batch), ROWS)):
                lists = lambda name: [x.values.to_numpy(zero_copy_only=False) for x in part.column(name)]  # noqa: E731, B023
                found = list(code.read(lists("ids"), lists("loss")))
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("c", "x", "start", "conv_id")), *columns], names=["c", "x", "start", "conv_id", "role", "text", "loss_text", "n_chars"])
        give_back()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order to one row a conversation. A digest is a chain: its conversation streams through, and only its state is held."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    key, held, done, kind = None, None, [], None

    def rows() -> pa.RecordBatch:
        out = [(c, n, t.hexdigest(), m, y.hexdigest(), f) for c, n, t, m, y, f in done]
        types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for c, x, conv, role, text, learned, chars in zip(*(batch.column(k).to_pylist() for k in ("c", "x", "conv_id", "role", "text", "loss_text", "n_chars")), strict=True):
            if held is None or key != (c, x):
                if held:
                    done.append(held)
                key, held = (c, x), [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            held[1] += 1
            held[2].update(f"{role}\n{text}\n".encode())
            held[3] += len(learned)
            held[4].update(learned.encode())
            held[5] += chars
        if done:
            yield rows()
            done = []
    if held:
        done = [held]
        yield rows()


def _codec(spark, tokenizer_path: str, template: Template) -> Callable[[], Codec]:
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the table
    return lambda: Codec(shared.value, template)


def _kind(turns: DataFrame) -> str:
    return dict(turns.dtypes)["conv_id"]


def _formatted(turns: DataFrame, codec: Callable[[], Codec]) -> DataFrame:
    kind = _kind(turns)
    return _streams(turns).mapInArrow(_pieces(codec), f"c {kind}, x boolean, block long, conv_id {kind}, turn_no long, start long, ids array<int>, loss array<boolean>")


def several_blocks(turns: DataFrame) -> DataFrame:
    """c, x of the conversations that lie in more than one block."""
    ends = turns.groupBy("c", "x").agg(F.min("block").alias("a"), F.max("block").alias("b"), F.max(F.col("block").isNull()).alias("n"))
    return ends.where("a < b or (n and b is not null)").select("c", "x")


def _carried(pieces: DataFrame, totals: DataFrame) -> DataFrame:
    """``pieces`` with turn_no and start counted from the conversation's first block; ``totals`` are those of conversations of several blocks."""
    from pyspark.sql import Window

    before = Window.partitionBy("c", "x").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.groupBy("c", "x", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("m"))
    sums = sums.select("c", "x", F.coalesce("block", F.lit(0)).alias("_b"), F.col("block").isNull().alias("_n"), F.sum("n").over(before).alias("n"), F.sum("m").over(before).alias("m"))
    d = pieces.withColumns({"_b": F.coalesce("block", F.lit(0)), "_n": F.col("block").isNull()}).join(sums, ["c", "x", "_b", "_n"], "left")
    return d.withColumns({"turn_no": F.col("turn_no") + F.coalesce("n", F.lit(0)), "start": F.col("start") + F.coalesce("m", F.lit(0))})


def format_turns(rows: DataFrame, tokenizer_path: str, template: Template = Template(), **columns) -> DataFrame:
    """conv_id, turn_no, start (its first token's place in the conversation), ids and loss, the mask, of every turn."""
    turns, codec = ordered(rows, **columns), _codec(rows.sparkSession, tokenizer_path, template)
    several = turns.join(several_blocks(turns), ["c", "x"], "left_semi")
    return _carried(_formatted(turns, codec), _formatted(several, codec)).select("conv_id", "turn_no", "start", "ids", "loss")


def read_back(rows: DataFrame, tokenizer_path: str, template: Template = Template(), **columns) -> DataFrame:
    """One row a conversation, as read back from its formatted turns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation within one block is read where its turns are formatted, so that rows are shuffled once; the turns
    of others move once more, to be put in order.
    """
    spark, turns = rows.sparkSession, ordered(rows, **columns)
    codec, kind = _codec(spark, tokenizer_path, template), _kind(turns)
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    several = several_blocks(turns)
    n = several.limit(LISTED + 1).count()
    here = turns if not n else turns.join(F.broadcast(several) if n <= LISTED else several, ["c", "x"], "left_anti")
    pieces, read = _pieces(codec), _read(codec)
    out = _streams(here).mapInArrow(lambda batches: _digests(read(pieces(batches))), schema)
    if not n:
        return out
    far = turns.join(F.broadcast(several) if n <= LISTED else several, ["c", "x"], "left_semi")
    parts = _formatted(far, codec)
    texts = _carried(parts, parts).select("c", "x", "start", "conv_id", "ids", "loss").mapInArrow(read, f"c {kind}, x boolean, start long, conv_id {kind}, role string, text string, loss_text string, n_chars long")
    return out.unionByName(texts.repartition("c", "x").sortWithinPartitions("c", "x", "start").mapInArrow(_digests, schema))
