"""Chat formatting over typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor
flattens them into one string in which every attachment is an ordered
placeholder, and records the attachment's reference and its expanded token
count. The template is

    <|turn|>ROLE<|text|>CONTENT<|end|>\\n

Control strings inside roles and texts are broken by a backslash after their
first character, backslashes are doubled; so no control string survives inside
a text and escaping can be undone exactly. The loss mask covers the content of
assistant turns.

A conversation is a stream of turns: rows are dealt by conversation, sorted by
turn and formatted one turn at a time, so a very long conversation needs the
memory of one batch. Its digest is sequential by definition.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvane.llm._store import arrow_map, ship

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
KINDS = ("image", "audio", "document")
#: Strings that common chat templates treat as control.
CONTROL = (TURN, TEXT, "<|end|>", *(f"<|{k}|>" for k in KINDS), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")
_BREAK = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(set(CONTROL), key=len, reverse=True)))
_UNBREAK = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNBREAK.sub(r"\1", text)


@dataclass
class Part:
    """One content part. tokens: units that the attachment expands to (image
    tiles, audio frames, document pages times the visitor's rate)."""

    kind: str
    text: str = ""
    ref: str | None = None
    units: int = 1


@dataclass
class Flattened:
    text: str = ""
    refs: list[tuple[int, str, str | None, int]] = field(default_factory=list)
    tokens: int = 0


class Visitor:
    """Flattens parts in order. A text part is escaped; any other kind becomes
    `<|kind|>` and an entry (ordinal, kind, reference, tokens)."""

    rates = {"image": 576, "audio": 50, "document": 1024}

    def __init__(self, rates: dict[str, int] | None = None):
        self.rates = {**self.rates, **(rates or {})}

    def flatten(self, parts: Iterable[Part], first: int = 0) -> Flattened:
        out = Flattened()
        pieces = [getattr(self, "visit_" + p.kind, self.visit_unknown)(p, out, first) for p in parts]
        out.text = "".join(pieces)
        return out

    def visit_text(self, p: Part, out: Flattened, first: int) -> str:
        return escape(p.text or "")

    def _attach(self, p: Part, out: Flattened, first: int) -> str:
        tokens = self.rates[p.kind] * max(0, p.units)
        out.refs.append((first + len(out.refs), p.kind, p.ref, tokens))
        out.tokens += tokens
        return f"<|{p.kind}|>"

    visit_image = visit_audio = visit_document = _attach

    def visit_unknown(self, p: Part, out: Flattened, first: int) -> str:
        raise ValueError(f"unknown content part {p.kind!r}")


def format_turn(role: str, flat: Flattened) -> tuple[str, int, int]:
    """The turn's string and the span of its content in it."""
    head = TURN + escape(role) + TEXT
    return head + flat.text + END, len(head), len(head) + len(flat.text)


_PARTS = re.compile("|".join(re.escape(f"<|{k}|>") for k in KINDS))


def parse_turn(s: str) -> tuple[str, str, list[str]]:
    """Role, text (unescaped, placeholders taken out) and placeholder kinds."""
    if not (s.startswith(TURN) and s.endswith(END)):
        raise ValueError("not a formatted turn")
    role, sep, content = s[len(TURN) : -len(END)].partition(TEXT)
    if not sep:
        raise ValueError("a turn without content")
    kinds = [m[0][2:-2] for m in _PARTS.finditer(content)]
    return unescape(role), unescape(_PARTS.sub("", content)), kinds


PART_TYPE = "array<struct<kind:string,text:string,ref:string,units:int>>"
FORMAT_DDL = ("conv_id long, seq long, formatted string, loss_from long, loss_to long, n_attachments long, attachment_refs array<string>, "
              "attachment_tokens long, text_at long")
_FORMAT = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("formatted", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64()),
                     ("n_attachments", pa.int64()), ("attachment_refs", pa.list_(pa.string())), ("attachment_tokens", pa.int64()), ("text_at", pa.int64())])


def format_conversations(rows: DataFrame, rates: dict[str, int] | None = None) -> DataFrame:
    """One row per turn, in order inside each partition: conv_id, seq (from 0),
    formatted, loss span (offsets into the conversation's whole string; empty
    outside assistant turns), text_at (offset of the turn), attachment counts,
    references and tokens.

    rows: conv_id, turn, role, text and optionally parts (array of struct kind,
    text, ref, units), which precede the text. Null role or text: empty. Rows of
    null conv_id form one conversation. Equal turns are ordered by role, then
    text; repeated rows are repeated turns. Other columns are ignored."""
    ship(rows.sparkSession)
    parts = F.col("parts").cast(PART_TYPE) if "parts" in rows.columns else F.lit(None).cast(PART_TYPE)
    d = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), parts.alias("parts"))
    d = d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text", "parts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor, now, seq, at, seen = Visitor(rates), object(), 0, 0, 0
        for b in batches:
            out = []
            for c, role, text, ps in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if c != now:
                    now, seq, at, seen = c, 0, 0, 0
                own = [Part(p["kind"], p["text"] or "", p["ref"], 1 if p["units"] is None else p["units"]) for p in ps or () if p]
                flat = visitor.flatten([*own, *[Part("text", text)] * (text != "")], seen)
                s, lo, hi = format_turn(role, flat)
                if role != "assistant":
                    lo = hi = 0
                out.append((c, seq, s, at + lo, at + hi, len(flat.refs), [f"{n}:{k}:{r or ''}:{t}" for n, k, r, t in flat.refs], flat.tokens, at))
                seq, at, seen = seq + 1, at + len(s), seen + len(flat.refs)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), _FORMAT, strict=True)] if out else [pa.array([], t.type) for t in _FORMAT], schema=_FORMAT)

    return arrow_map(d, run, FORMAT_DDL)


READ_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted turns (as format_conversations deals and orders them) and
    return the digests of what they hold, one row per conversation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, any_yet = object(), False
        n = chars = loss_chars = 0
        turns = loss = None
        done = []
        for b in batches:
            for c, s, lo, hi, at in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if c != now or not any_yet:
                    if any_yet:
                        done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    now, any_yet, n, chars, loss_chars = c, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                role, text, _ = parse_turn(s)
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                masked = unescape(_PARTS.sub("", s[lo - at : hi - at])) if hi > lo else ""
                loss.update(masked.encode("utf-8", "surrogatepass"))
                n, chars, loss_chars = n + 1, chars + len(s), loss_chars + len(masked)
            if len(done) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*done, strict=True), _READ, strict=True)], schema=_READ)
                done = []
        if any_yet:
            done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*done, strict=True), _READ, strict=True)], schema=_READ)

    return arrow_map(formatted.select("conv_id", "formatted", "loss_from", "loss_to", "text_at"), run, READ_DDL)
