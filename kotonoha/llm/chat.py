"""Chat formatting: records of many layouts, recognised by the fingerprint of their field paths, become canonical
turns, which are written by a template with a loss mask and can be read back."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kotonoha.llm.common import map_rows, quoted, ship

#: Characters of texts that one record or one written part holds, one turn at least.
PART = 1_000_000

#: Names that layouts use for roles, by the role.
ROLES = {"human": "user", "gpt": "assistant"}

TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


# Layouts

@dataclass(frozen=True)
class One:
    """A field at ``path`` is the text of a turn of ``role``; an absent or null field is no turn."""

    role: str
    path: str

    def paths(self) -> set[str]:
        return {self.path}

    def turns(self, record) -> Iterator[tuple[str, str]]:
        text = at(record, self.path)
        if text is not None:
            yield self.role, text


@dataclass(frozen=True)
class Joined:
    """Fields whose texts together are one turn, those present joined by blank lines."""

    role: str
    parts: tuple[str, ...]

    def paths(self) -> set[str]:
        return set(self.parts)

    def turns(self, record) -> Iterator[tuple[str, str]]:
        texts = [t for t in (at(record, p) for p in self.parts) if t]
        if texts:
            yield self.role, "\n\n".join(texts)


@dataclass(frozen=True)
class Each:
    """Every element of the list at ``path`` is a turn; a null role or text is ''."""

    path: str
    role: str
    text: str
    names: dict = field(default_factory=dict, hash=False)

    def paths(self) -> set[str]:
        return {f"{self.path}[].{self.role}", f"{self.path}[].{self.text}"}

    def turns(self, record) -> Iterator[tuple[str, str]]:
        for element in at(record, self.path):
            role = at(element, self.role) or ""
            yield self.names.get(role, role), at(element, self.text) or ""


@dataclass(frozen=True)
class Layout:
    """Which paths a record of this layout has and how they become turns, in order."""

    name: str
    rules: tuple
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> Iterator[int]:
        """Those of the required paths with any of the optional ones."""
        every = set().union(*[r.paths() for r in self.rules])
        for n in range(len(self.optional) + 1):
            for left in combinations(self.optional, n):
                yield fingerprint(every.difference(left))

    def turns(self, record) -> list[tuple[str, str]]:
        return [t for rule in self.rules for t in rule.turns(record)]


LAYOUTS = (
    Layout("prompt", (One("system", "system"), One("user", "prompt"), One("assistant", "response")), ("system",)),
    Layout("completion", (One("user", "prompt"), One("assistant", "completion"))),
    Layout("question", (One("system", "system"), One("user", "question"), One("assistant", "answer")), ("system",)),
    Layout("instruction", (One("system", "system"), Joined("user", ("instruction", "input")), One("assistant", "output")),
           ("system", "input")),
    Layout("messages", (Each("messages", "role", "content"),)),
    Layout("conversations", (One("system", "system"), Each("conversations", "from", "value", ROLES)), ("system",)),
    Layout("dialog", (Each("data.dialog", "speaker.role", "utterance.text"),)),
)


def at(record, path: str):
    """The value at a dotted path; null where a step is absent."""
    for step in path.split("."):
        record = record.get(step) if isinstance(record, dict) else None
    return record


def field_paths(value, head: str = "") -> set[str]:
    """Dotted paths of a record's leaves, ``[]`` for the elements of a list; an empty list or object is a leaf itself."""
    if isinstance(value, dict) and value:
        return set().union(*[field_paths(v, f"{head}.{k}" if head else k) for k, v in value.items()])
    if isinstance(value, list) and value:
        return set().union(*[field_paths(v, head + "[]") for v in value])
    return {head}


def fingerprint(paths: Iterable[str]) -> int:
    """64 bits of a set of paths, the same in every process."""
    return int.from_bytes(hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).digest(), "big", signed=True)


def mappings(layouts: Iterable[Layout] = LAYOUTS) -> dict[int, Layout]:
    """Layouts by fingerprint; two layouts of the same paths are an error."""
    out: dict[int, Layout] = {}
    for layout in layouts:
        for mark in layout.fingerprints():
            if out.setdefault(mark, layout) is not layout:
                raise ValueError(f"layouts {out[mark].name} and {layout.name} have the same paths")
    return out


def wellformed(text: str) -> str:
    """A text without lone surrogates, which JSON can spell and UTF-8 cannot."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def canonical(df: DataFrame, record_col: str = "record", keep: tuple[str, ...] = (),
              layouts: Iterable[Layout] = LAYOUTS) -> DataFrame:
    """The ``keep`` columns, fingerprint, layout and turns of every row's JSON record.

    The set of a record's field paths is hashed, and the layout of that
    fingerprint maps its fields to turns.  ``id``, ``part`` and names beginning with ``_`` at the top are
    not part of a layout.  Layout and turns are null where no layout has the
    fingerprint; all three are null where the record is null, no JSON or no object.  Texts that
    are no strings are written as JSON.
    """
    known = mappings(layouts)
    fields = [T.StructField("fingerprint", T.LongType()), T.StructField("layout", T.StringType()),
              T.StructField("turns", T.ArrayType(TURN))]

    def string(value) -> str:
        return wellformed(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))

    def row(raw):
        try:
            record = json.loads(raw) if raw is not None else None
        except (ValueError, RecursionError):
            record = None
        if not isinstance(record, dict):
            return None, None, None
        record = {k: v for k, v in record.items() if k not in ("id", "part") and not k.startswith("_")}
        mark = fingerprint(map(wellformed, field_paths(record)))
        layout = known.get(mark)
        if layout is None:
            return mark, None, None
        return mark, layout.name, [{"role": string(r), "text": string(t)} for r, t in layout.turns(record)]

    return map_rows(df, lambda: row, [record_col], list(keep), fields)


# Template

@dataclass(frozen=True)
class Template:
    """Marks around the turns of each role; a role without marks of its own is named in front of its text.

    A mark's string inside a text gets one backslash more in front of it than it
    had, so no text holds an unescaped mark, and reading takes one away.  Blanks
    part marks from texts, so none forms across them.
    """

    marks: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"),
                                                 "assistant": ("<s>", "</s>")}, hash=False)
    other: tuple[str, str] = ("<<TURN>>", "<</TURN>>")

    def controls(self) -> str:
        strings = sorted({m for pair in [*self.marks.values(), self.other] for m in pair}, key=lambda s: (-len(s), s))
        return "|".join(map(re.escape, strings))

    def writer(self) -> Callable[[str, str], tuple[str, int, int]]:
        """From role and text to the written turn and where its text begins and ends."""
        control = re.compile(rf"\\*(?:{self.controls()})")

        def escape(text: str) -> str:
            return control.sub(lambda m: "\\" + m[0], text)

        def write(role: str, text: str) -> tuple[str, int, int]:
            if role in self.marks:
                before, after = self.marks[role]
                head = before + " "
            else:
                before, after = self.other
                head = f"{before} {json.dumps(escape(role), ensure_ascii=False)} "
            body = escape(text)
            return f"{head}{body} {after}\n", len(head), len(head) + len(body)
        return write

    def reader(self) -> Callable[[str], Iterator[tuple[str, str, int, int]]]:
        """From written turns to role, text, and where the escaped text lies."""
        token = re.compile(rf"(\\*)({self.controls()})")
        opens = {pair[0]: (role, pair[1]) for role, pair in self.marks.items()} | {self.other[0]: (None, self.other[1])}
        decoder = json.JSONDecoder(strict=False)

        def plain(text: str) -> str:
            return token.sub(lambda m: m[1][1:] + m[2], text)

        def read(written: str) -> Iterator[tuple[str, str, int, int]]:
            where = 0
            while where < len(written):
                mark = token.match(written, where)
                role, after = opens[mark[2]]
                start = mark.end() + 1
                if role is None:
                    named, start = decoder.raw_decode(written, start)
                    role, start = plain(named), start + 1
                close = next(m for m in token.finditer(written, start) if not m[1])
                assert close[2] == after and written[close.start() - 1] == " "
                end = close.start() - 1
                yield role, plain(written[start:end]), start, end
                where = close.end() + 1
        return read


def write(df: DataFrame, turns_col: str = "turns", keep: tuple[str, ...] = (), template: Template = Template()) -> DataFrame:
    """The ``keep`` columns, formatted and loss of every row's turns.

    ``loss`` are the spans of the assistants' texts in ``formatted``, in code
    points, without marks and blanks.  Null turns give null; no turns give ''.
    """
    fields = [T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(SPAN))]

    def make():
        turn = template.writer()

        def row(turns):
            if turns is None:
                return None, None
            pieces, spans, size = [], [], 0
            for t in turns:
                role = t["role"] or ""
                piece, start, end = turn(role, t["text"] or "")
                if role == "assistant":
                    spans.append({"start": size + start, "end": size + end})
                pieces.append(piece)
                size += len(piece)
            return "".join(pieces), spans
        return row

    return map_rows(df, make, [turns_col], list(keep), fields)


def read(df: DataFrame, formatted_col: str = "formatted", loss_col: str = "loss", keep: tuple[str, ...] = (),
         template: Template = Template()) -> DataFrame:
    """The ``keep`` columns, turns and learned: the turns of every written row, and the unescaped texts under its mask."""
    fields = [T.StructField("turns", T.ArrayType(TURN)), T.StructField("learned", T.ArrayType(T.StringType())),
              T.StructField("formatted_chars", T.LongType())]

    def make():
        parse, token = template.reader(), re.compile(rf"(\\*)({template.controls()})")

        def row(written, spans):
            if written is None:
                return None, None, None
            turns = [{"role": r, "text": t} for r, t, _, _ in parse(written)]
            learned = [token.sub(lambda m: m[1][1:] + m[2], written[s["start"]:s["end"]]) for s in spans or ()]
            return turns, learned, len(written)
        return row

    return map_rows(df, make, [formatted_col, loss_col], list(keep), fields)


# Conversations that are stored by turn

def records(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text", part: int = PART) -> DataFrame:
    """conv_id, part, record: conversations of a table of turns as JSON records, in the layouts such data comes in.

    One question and answer, with or without a system text, is a prompt, question
    or instruction record; others are lists of messages of three kinds, by the
    conversation's id.  Turns stand in the order of ``turn`` (null first), then
    role and text; repeated rows are repeated turns.  A null role or text is '', a null id is one
    conversation.  The turns of a conversation are sorted outside the memory of
    a task and met one after another: a record ends when its texts reach
    ``part`` characters, and a longer conversation goes on in the next record.
    The rows of a conversation stand together, in order, in one partition.
    """
    ship(df.sparkSession.sparkContext)
    text = F.make_valid_utf8(F.coalesce(quoted(text_col), F.lit("")))
    rows = df.select(quoted(conv_col).cast("long").alias("conv"), quoted(turn_col).alias("turn"),
                     F.make_valid_utf8(F.coalesce(quoted(role_col).cast("string"), F.lit(""))).alias("role"), text.alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("part", T.LongType()),
                           T.StructField("record", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        now, number, size, out, made = None, 0, 0, [], 0

        def close(last: bool):
            nonlocal held, number, size, made
            raw = as_record(now, number, held, last)
            out.append((now, number, raw))
            made += len(raw)
            held, number, size = [], number + 1, 0

        def batch_of():
            nonlocal out, made
            done = pa.RecordBatch.from_arrays([pa.array(c, type=arrow.field(i).type) for i, c in enumerate(zip(*out))], schema=arrow)
            out, made = [], 0
            return done

        for batch in batches:
            for conv, role, said in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if held and conv != now:
                    close(True)
                if conv != now:
                    now, number = conv, 0
                elif size and size + len(said) > part:
                    close(False)
                held.append((role, said))
                size += len(said)
                if made > part or len(out) > 4096:
                    yield batch_of()
        if held:
            close(True)
        if out:
            yield batch_of()

    return rows.mapInArrow(run, schema)


def as_record(conv: int | None, number: int, turns: list[tuple[str, str]], last: bool) -> str:
    """One record of consecutive turns, in a layout that fits their roles."""
    roles, texts = [r for r, _ in turns], [t for _, t in turns]
    kind = (conv or 0) % 3
    body = dict(zip(roles, texts))
    if number == 0 and last and roles in (["user", "assistant"], ["system", "user", "assistant"]):
        ask, answer = [("prompt", "response"), ("question", "answer"), ("instruction", "output")][kind]
        if ask == "instruction" and not body["user"]:
            ask, answer = "prompt", "response"
        made = {k: body[r] for k, r in (("system", "system"), (ask, "user"), (answer, "assistant")) if r in body}
    elif kind == 0 and set(roles) <= {"system", "user", "assistant"}:
        names = {"user": "human", "assistant": "gpt"}
        made = {"conversations": [{"from": names.get(r, r), "value": t} for r, t in turns]}
    elif kind == 1:
        made = {"data": {"dialog": [{"speaker": {"role": r}, "utterance": {"text": t}} for r, t in turns]}}
    else:
        made = {"messages": [{"role": r, "content": t} for r, t in turns]}
    return json.dumps({"id": conv, "part": number, **made}, ensure_ascii=False)


def digests(df: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of conversations read back.

    ``df`` has conv_id, turns, learned, formatted_chars, the parts of a
    conversation one after another in one partition, as ``records`` leaves them.  One row's texts are held at a time.
    """
    ship(df.sparkSession.sparkContext)
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
                           T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                           T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, said, learned, counts = None, False, None, None, [0, 0, 0]

        def row():
            return now, counts[0], said.hexdigest(), counts[1], learned.hexdigest(), counts[2]

        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                conv = batch.column(0)[r].as_py()
                if not open_ or conv != now:
                    if open_:
                        out.append(row())
                    now, open_, said, learned, counts = conv, True, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                turns = batch.column(1)[r].as_py() or ()
                for t in turns:
                    said.update(f"{t['role']}\n{t['text']}\n".encode())
                for text in batch.column(2)[r].as_py() or ():
                    learned.update(text.encode())
                    counts[1] += len(text)
                counts[0] += len(turns)
                counts[2] += batch.column(3)[r].as_py() or 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=arrow.field(i).type) for i, c in enumerate(zip(*out))], schema=arrow)
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=arrow.field(i).type) for i, v in enumerate(row())], schema=arrow)

    return df.select("conv_id", "turns", "learned", "formatted_chars").mapInArrow(run, schema)


def round_trip(df: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of a table of turns after records, canonical turns, formatting and reading back.

    An empty table gives no rows; a conversation has one turn at least.  Further columns are left out.
    """
    turns = canonical(records(df), keep=("conv_id", "part"))
    written = write(turns, keep=("conv_id", "part"), template=template)
    return digests(read(written, keep=("conv_id", "part"), template=template))


def oracle(template: Template = Template()) -> str:
    """The same in SQL for the table of conversations and the planted conversation -1."""
    control = template.controls().replace("'", "''")
    head = "CASE " + " ".join(f"WHEN role = '{r}' THEN {len(a) + len(b) + 3}" for r, (a, b) in template.marks.items())
    named = "length(to_json(regexp_replace(role, '(\\\\*(?:" + control + "))', '\\\\\\1', 'g'))::VARCHAR)"
    return rf"""
WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, length(regexp_replace(t, '(\\*(?:{control}))', '\\\1', 'g'))
    + {head} ELSE {len(template.other[0]) + len(template.other[1]) + 4} + {named} END AS size FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id"""
