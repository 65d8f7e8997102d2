"""Secret scans: every rule of every text in one backward byte pass.

All rules are compiled, reversed, into one minimal automaton.  One pass over the
bytes of a text from its end marks where matches of which rules begin; matches
are then taken per rule from the left, each as long as possible, none overlapping
the one before it, and short ones are dropped.  Texts are scanned whole.

Defined cases.  A null text is empty and has no spans; repeated rows are scanned
alike; extra columns are ignored by ``find_secrets`` and kept by
``redact_secrets``; an empty table gives no rows.  Spans count code points, end
exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import automaton
from .tokens import tidy


@dataclass(frozen=True)
class Rule:
    """``head`` then one or more of ``body``; kept from ``least`` body bytes on.

    ``sure`` is how many body bytes the automaton itself asks for.  Above 1 it
    must not change which matches are found: true where a shorter match cannot
    overlap the start of a longer one.  ``rest`` is what must follow the body, as
    long as possible; the match reaches to its end.
    """

    kind: str
    head: str
    body: str
    least: int = 1
    sure: int = 1
    rest: str = ""


# The three base kinds, then kinds that this method adds.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24, 24),
)
# What follows a private key's banner: all up to the END line, or without one its
# header lines and base64 lines, with breaks as such or escaped.
_BREAK = r"([\x09\x0a\x0d\x20]|\\[nr])"
_TO_END = r"(-{0,4}[\x00-\x2c\x2e-\xff])*-----END [A-Z ]*PRIVATE KEY-----+"
_LINES = f"({_BREAK}+[A-Za-z][A-Za-z-]*:\\x20[\\x20-\\x7e]*)*({_BREAK}*[A-Za-z0-9+/=]{{16,}})+({_BREAK}+[A-Za-z0-9+/=]+)?"
MORE_RULES = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 8),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY----", "-", 1),
    Rule("key", "-----BEGIN [A-Z ]*PRIVATE KEY----", "-", 1, rest=f"{_TO_END}|{_LINES}"),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [automaton.parse(f"{r.head}{r.body}{{{r.sure},}}") for r in rules]
        self.back = automaton.compile_rules(trees, reverse=True, search=True)
        self.heads = [automaton.compile_rules([automaton.parse(r.head)]) if r.head else None for r in rules]
        self.rests = [automaton.compile_rules([automaton.parse(r.rest)]) if r.rest else None for r in rules]
        self.bodies = [bytes(b for b in range(256) if b in automaton.parse(r.body)[1][0][1]) for r in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and then rule."""
        table, first, state, marks = self.back.table, self.back.first_accepting, 0, []
        i = len(data)
        for c in data.translate(self.back.classes)[::-1]:
            i -= 1
            state = table[state + c]
            if state >= first:
                marks.append((i, state))
        found, free = [], [0] * len(self.rules)
        for i, state in reversed(marks):
            for k in self.back.rules[state]:
                if i < free[k]:
                    continue
                body = automaton.longest(self.heads[k], data, i) if self.heads[k] else i
                rest = data[body : body + 256]
                while len(tail := rest.lstrip(self.bodies[k])) == 0 and body + len(rest) < len(data):
                    rest = data[body : body + 4 * len(rest)]
                end = body + len(rest) - len(tail)
                free[k] = end
                if self.rests[k]:
                    stop = automaton.longest(self.rests[k], data, end)
                    if stop < 0:
                        continue
                    free[k] = end = stop
                if end - body >= self.rules[k].least:
                    found.append((i, k, end))
        return found


@lru_cache(maxsize=8)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def text_spans(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points."""
    data = text.encode("utf-8", "surrogatepass")
    found = scanner(rules).spans(data)
    if len(data) == len(text):
        return [(rules[k].kind, i, end) for i, k, end in found]
    out, at, points = [], 0, 0
    for i, k, end in found:
        points += len(data[at:i].decode("utf-8", "surrogatepass"))
        at = i
        out.append((rules[k].kind, points, points + end - i))
    return out


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The id and ``spans`` (array of kind, start, end) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in tidy(batches):
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in text_spans(t.as_py() or "", rules)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, type=kind)], names=["id", "spans"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, end: bigint>>"
    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_column)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, mask: str, rules: tuple[Rule, ...] = RULES) -> str:
    """The text with the union of all spans replaced, each stretch by one mask."""
    out, at = [], 0
    for _, start, end in text_spans(text, rules):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_column: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns, secrets replaced by ``mask``; null stays null."""
    names = docs.columns

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_column)
        for batch in tidy(batches):
            texts = [None if (t := x.as_py()) is None else masked(t, mask, rules) for x in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(redact, docs.schema)
