"""Chat formatting: roles of a transcript's turns recovered by a hidden Markov model, then turns in canonical form.

Method: a turn's text falls into segments, a new one at every line that begins with a speaker marker. The states of
the model are all roles that labels or markers name, however many; a segment is observed by its marker and by line features (length, lines, a question, lists or
code, first of its conversation). Emissions and transitions are smoothed counts over all labelled turns, by grouped
aggregation; a marker's usual role adds MARKER_ROWS pseudo-counts, so that markers count where labels have none.
Viterbi finds the most likely roles; a label is never used to decode its own conversation's turns other than through
these counts.

A conversation may be of any length, and one may hold any share of all rows. Turns are dealt by ranges of conversation,
turn and text, with a row's number as the last resort, so nothing is too common to be split, and each range is cut into
blocks of BLOCK rows of one conversation. A block yields the best score of a path between any two states (a small
matrix); these are multiplied by GROUP blocks, the products of a conversation are chained to fix the states at their
ends, those of the blocks follow within each group, and each block is then decoded between its ends. The result is an
exact Viterbi path; no task holds more than one block, GROUP matrices, or a product for each GROUP * BLOCK rows and each
range that a conversation has. Transitions and starts are counted within blocks and across their edges.

A rendered turn is <|role|>, a line feed, the content and <|end|>. So that no content forges such marks, a < that stands
before backslashes (or none) and a | gets one backslash more; plain() takes it off again. What is not a letter, digit,
dot or hyphen in a role is rendered as an underscore.

Edge cases: a null text counts as empty and is one segment; null turns sort first; rows with a null conversation form
one conversation; equal turns are ordered by the hash of their text and role; a role that is null trains nothing;
without any label the roles are system, user and assistant, by markers alone; an empty table gives an empty result;
other columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keep, prepare

BLOCK, GROUP, MARKER_ROWS, SMOOTH = 512, 512, 200.0, 1.0
ROLES = ["system", "user", "assistant"]
#: Speaker markers and their roles. Fixed values.
MARKERS = {"system": "system", "instructions": "system", "user": "user", "human": "user", "question": "user", "q": "user", "customer": "user", "client": "user", "prompter": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant", "agent": "assistant", "gpt": "assistant", "model": "assistant", "response": "assistant"}
_NAMES = "|".join(sorted(MARKERS, key=len, reverse=True))
_MARKER = re.compile(rf"(?im)^[ \t]*(?:<\|(?:im_start\|>)?({_NAMES})(?:\|>)?[ \t]*\n?|\[({_NAMES})\][ \t]*:?|#{{2,4}}[ \t]*({_NAMES})[ \t]*:?[ \t]*$|\*\*({_NAMES})\*\*[ \t]*:|\*\*({_NAMES}):\*\*|({_NAMES})[ \t]*:)[ \t]*")
_KINDS = ("marker", "length", "lines", "ask", "form", "first")


def segments(text: str) -> list[tuple[str, str]]:
    """(marker's name or "", content) of each segment."""
    found = list(_MARKER.finditer(text))
    starts = [(0, 0, "")] if not found or text[: found[0].start()].strip() else []
    starts += [(m.start(), m.end(), next(g for g in m.groups() if g).lower()) for m in found]
    ends = [s[0] for s in starts[1:]] + [len(text)]
    return [(name, text[at:end].strip("\n \t")) for (_, at, name), end in zip(starts, ends, strict=True)]


def observe(marker: str, content: str, first: bool) -> tuple[str, ...]:
    """The value of each feature."""
    return (
        marker,
        str(len(content.split()).bit_length()),
        str(min(6, content.count("\n"))),
        "?" if content.rstrip().endswith("?") else "",
        "code" if "```" in content else "list" if re.search(r"(?m)^[ \t]*(?:[-*]|\d+\.)[ \t]", content) else "",
        "first" if first else "",
    )


_ROWS = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_BLOCK = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("opens", pa.string()), ("closes", pa.string()), ("rows", pa.list_(_ROWS))])


def _label(i: int, marker: str, role: str | None) -> str | None:
    """A label belongs to a turn's first segment; others, and those without one, go by their markers."""
    return MARKERS.get(marker, role) if i or role is None else role


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted turns, with the labels of their first and last segments."""
    from pyspark import TaskContext

    number, held, out, size = TaskContext.get().partitionId() << 32, [], [], 0

    def close() -> None:
        nonlocal number, held, size
        first, last = segments(held[0]["text"]), segments(held[-1]["text"])
        out.append((held[0]["conv"], number, _label(0, first[0][0], held[0]["role"]), _label(len(last) - 1, last[-1][0], held[-1]["role"]), [{k: r[k] for k in ("turn", "role", "text")} for r in held]))
        number, held = number + 1, []

    def ready() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(_BLOCK)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK, strict=True)], schema=_BLOCK)

    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["conv"] != held[0]["conv"] or len(held) >= BLOCK):
                close()
            held.append(row)
            size += len(row["text"])
        if size > 1 << 22:
            yield ready()
            out, size = [], 0
    if held:
        close()
    yield ready()


def blocks_of(rows: DataFrame, conv_id: str, turn: str, role: str | None, text: str) -> tuple[DataFrame, DataFrame]:
    """conv, block, opens, closes and rows of each block, written; and of each block how it follows the one before."""
    given = F.col(role).cast("string") if role else F.lit(None).cast("string")
    named = rows.select(F.col(conv_id).cast("string").alias("conv"), F.col(turn).cast("long").alias("turn"), given.alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["conv", "turn", "hash", "tie"]
    placed = named.withColumn("hash", F.xxhash64("text", "role")).withColumn("tie", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("hash", "tie")
    blocks = keep(dealt.mapInArrow(_cut, "conv string, block long, opens string, closes string, rows array<struct<turn:long,role:string,text:string>>"), "blocks")
    before = Window.partitionBy("conv").orderBy("block")
    return blocks, blocks.select("conv", "block", "opens", F.lag("closes").over(before).alias("last"), (F.row_number().over(before) == 1).alias("first"))


def _split(rows: list[dict], opening: bool = False) -> list[tuple[dict, int, str, tuple[str, ...], str]]:
    """Row, number in its row, marker, features and content of each segment of a block."""
    out = []
    for row in rows:
        for i, (marker, content) in enumerate(segments(row["text"])):
            out.append((row, i, marker, observe(marker, content, opening and not out), content))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str, str], int] = {}
    for batch in batches:
        for rows in batch.column("rows"):
            last = None
            for row, i, marker, features, _ in _split(rows.as_py()):
                role = _label(i, marker, row["role"])
                if role is not None:
                    for key in [*((k, v, role) for k, v in zip(_KINDS, features, strict=True)), *([("after", last, role)] if last is not None else [])]:
                        counts[key] = counts.get(key, 0) + 1
                last = role
    kind, value, role = zip(*counts, strict=True) if counts else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(value, pa.string()), pa.array(role, pa.string()), pa.array(counts.values(), pa.int64())], names=["kind", "value", "role", "n"])


class Model:
    """Log-probabilities of starts, transitions and features by role."""

    def __init__(self, counts: dict[tuple[str, str, str], float]):
        total: dict[str, float] = {}
        for (kind, _, role), n in counts.items():
            if kind == "marker":
                total[role] = total.get(role, 0) + n
        self.roles = sorted(total, key=lambda r: (-total[r], r)) or ROLES
        k = len(self.roles)
        at = {r: i for i, r in enumerate(self.roles)}
        self.start = np.full(k, SMOOTH)
        self.move = np.full((k, k), SMOOTH)
        self.emit: list[dict[str, np.ndarray]] = [{} for _ in _KINDS]
        rows = np.array([total.get(r, 0.0) for r in self.roles])
        for (kind, value, role), n in counts.items():
            if role not in at:
                continue
            if kind == "start":
                self.start[at[role]] += n
            elif kind == "after" and value in at:
                self.move[at[value], at[role]] += n
            elif kind in _KINDS:
                self.emit[_KINDS.index(kind)].setdefault(value, np.zeros(k))[at[role]] += n
        for marker, role in MARKERS.items():
            if role in at:
                self.emit[0].setdefault(marker, np.zeros(k))[at[role]] += MARKER_ROWS
        self.start = np.log(self.start / self.start.sum())
        self.move = np.log(self.move / self.move.sum(1, keepdims=True))
        self.other = []
        for i, table in enumerate(self.emit):
            size = rows + MARKER_ROWS * (i == 0) + SMOOTH * (len(table) + 1)
            self.other.append(np.log(SMOOTH / size))
            for value, n in table.items():
                table[value] = np.log((n + SMOOTH) / size)

    def scores(self, features: list[tuple[str, ...]]) -> np.ndarray:
        """Log-likelihood of each segment by role."""
        return np.array([sum(self.emit[k].get(v, self.other[k]) for k, v in enumerate(f)) for f in features]).reshape(len(features), len(self.roles))

    def between(self, emitted: np.ndarray) -> np.ndarray:
        """The best score of a path over these segments from each role to each role."""
        k = len(self.roles)
        best = np.where(np.eye(k, dtype=bool), emitted[0], -np.inf)
        for e in emitted[1:]:
            # a row at a time where roles are many, so that no more than two small matrices are held
            best = np.stack([(b[:, None] + self.move).max(0) for b in best]) + e if k > 16 else (best[:, :, None] + self.move[None]).max(1) + e
        return best

    def times(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The best scores over two stretches, one after the other."""
        enter = np.stack([(x[:, None] + self.move).max(0) for x in a])
        return np.stack([(x[:, None] + b).max(0) for x in enter])

    def ends(self, parts: list[np.ndarray], start: np.ndarray, end: int | None = None) -> list[tuple[int, int]]:
        """The first and last state of each stretch on the best path, from scores of starting and with the end given or free."""
        whole = start[:, None] + parts[0]
        firsts, back, best = [whole.argmax(0)], [None], whole.max(0)
        for part in parts[1:]:
            enter = best[:, None] + self.move
            back.append(enter.argmax(0))
            whole = enter.max(0)[:, None] + part
            firsts.append(whole.argmax(0))
            best = whole.max(0)
        state, out = int(best.argmax()) if end is None else end, []
        for i in range(len(parts) - 1, -1, -1):
            first = int(firsts[i][state])
            out.append((first, state))
            state = int(back[i][first]) if i else state
        return out[::-1]

    def path(self, emitted: np.ndarray, start: int | None = None, end: int | None = None) -> list[int]:
        """The most likely roles, with the first and last given or free."""
        best, back = emitted[0] + self.start, []
        if start is not None:
            best = np.where(np.arange(len(best)) == start, emitted[0], -np.inf)
        for e in emitted[1:]:
            step = best[:, None] + self.move
            back.append(step.argmax(0))
            best = step.max(0) + e
        out = [int(best.argmax()) if end is None else end]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def fit(blocks: DataFrame, links: DataFrame) -> Model:
    """Count features, starts and transitions of all labelled turns."""
    row = lambda kind, value, n=1: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.col("opens").alias("role"), F.lit(n).cast("long").alias("n"))
    opening = F.array(row("first", F.lit("first")), row("first", F.lit(""), -1), row("start", F.lit("")))
    edges = links.filter("opens is not null and (first or last is not null)").select(F.explode(F.when(F.col("first"), opening).otherwise(F.array(row("after", F.col("last"))))).alias("r")).select("r.*")
    counted = blocks.select("rows").mapInArrow(_count, "kind string, value string, role string, n long").unionByName(edges)
    rows = counted.groupBy("kind", "value", "role").agg(F.sum("n").alias("n")).filter("n > 0").collect()
    return Model({(r["kind"], r["value"], r["role"]): float(r["n"]) for r in rows})


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows of equal keys, as they come sorted."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _table(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))


def _batched(parts: Iterator[list[tuple]], names: tuple[str, ...], kinds: tuple[pa.DataType, ...], size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Rows that come in small lists, in batches of about size."""
    held: list[tuple] = []
    for part in parts:
        held += part
        if len(held) >= size:
            yield _table(held, names, kinds)
            held = []
    yield _table(held, names, kinds)


def block_ends(blocks: DataFrame, model: Model) -> DataFrame:
    """block, first and last: the states at the ends of each block on the best path of its conversation."""
    k = len(model.roles)
    square = lambda payload: np.frombuffer(payload).reshape(k, k)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, block, rows in zip(batch.column("conv").to_pylist(), batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                parts = _split(rows.as_py())
                # what it means for the first segment to be the conversation's first
                other = model.scores([observe(parts[0][2], parts[0][4], True), parts[0][3]])
                out.append((conv, block, model.between(model.scores([p[3] for p in parts])).tobytes(), (other[0] - other[1]).tobytes()))
            yield _table(out, ("conv", "block", "best", "opening"), (pa.string(), pa.int64(), pa.binary(), pa.binary()))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list[tuple]]:
            for held in _groups(batches, ("conv", "set")):
                whole = square(held[0]["best"])
                for h in held[1:]:
                    whole = model.times(whole, square(h["best"]))
                yield [(held[0]["conv"], held[0]["set"], whole.tobytes(), held[0]["opening"])]

        yield from _batched(rows(), ("conv", "set", "best", "opening"), (pa.string(), pa.int64(), pa.binary(), pa.binary()))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list[tuple]]:
            for held in _groups(batches, ("conv",)):
                found = model.ends([square(h["best"]) for h in held], model.start + np.frombuffer(held[0]["opening"]))
                yield [(held[0]["conv"], h["set"], a, b) for h, (a, b) in zip(held, found, strict=True)]

        yield from _batched(rows(), ("conv", "set", "first", "last"), (pa.string(), pa.int64(), pa.int32(), pa.int32()))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list[tuple]]:
            for held in _groups(batches, ("conv", "set")):
                start = np.where(np.arange(k) == held[0]["first"], 0.0, -np.inf)
                found = model.ends([square(h["best"]) for h in held], start, held[0]["last"])
                yield [(h["block"], a, b) for h, (a, b) in zip(held, found, strict=True)]

        yield from _batched(rows(), ("block", "first", "last"), (pa.int64(), pa.int32(), pa.int32()))

    best = blocks.select("conv", "block", "rows").mapInArrow(matrices, "conv string, block long, best binary, opening binary")
    best = keep(best.withColumn("set", F.floor(F.col("block") / GROUP)), "matrices")
    sets = best.repartition("conv", "set").sortWithinPartitions("conv", "set", "block").mapInArrow(product, "conv string, set long, best binary, opening binary")
    tops = sets.repartition("conv").sortWithinPartitions("conv", "set").mapInArrow(chain, "conv string, set long, first int, last int")
    a, b = best.alias("a"), tops.alias("b")
    joined = a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.set") == F.col("b.set"))).select("a.conv", "a.set", "block", "best", "first", "last")
    return joined.repartition("conv", "set").sortWithinPartitions("conv", "set", "block").mapInArrow(within, "block long, first int, last int")


def render(role: str, content: str) -> str:
    """A turn in canonical form; marks in the content are made harmless."""
    return f"<|{re.sub(r'[^\w.-]', '_', role)}|>\n{re.sub(r'<(?=\\*[|])', lambda m: m[0] + chr(92), content)}<|end|>"


def plain(rendered: str) -> str:
    """The content of a rendered turn."""
    return re.sub(r"<\\(?=\\*[|])", "<", rendered[rendered.index("\n") + 1 : -len("<|end|>")])


def parse(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", text: str = "text", role: str | None = "role") -> DataFrame:
    """A row for each segment: conv_id, turn, segment, role (recovered), content, rendered and labelled (the given role)."""
    prepare(rows.sparkSession)
    kind = rows.schema[conv_id].dataType
    blocks, links = blocks_of(rows, conv_id, turn, role, text)
    model = fit(blocks, links)
    ends = keep(block_ends(blocks, model), "ends")
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
    names = ("conv_id", "turn", "segment", "role", "content", "rendered", "labelled")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decoded(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
            for conv, first, last, rows in zip(*(batch.column(c).to_pylist() for c in ("conv", "first", "last")), batch.column("rows"), strict=True):
                parts = _split(rows.as_py())
                path = model.path(model.scores([p[3] for p in parts]), first, last)
                yield [(conv, row["turn"], i, model.roles[state], content, render(model.roles[state], content), row["role"]) for (row, i, _, _, content), state in zip(parts, path, strict=True)]

        for batch in batches:
            yield from _batched(decoded(batch), names, kinds)

    found = blocks.select("conv", "block", "rows").join(ends, "block").mapInArrow(decode, "conv_id string, turn long, segment int, role string, content string, rendered string, labelled string")
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Every segment of every conversation with its recovered role and canonical form."""
    return parse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
