"""Chat formatting with loss masks aligned to tokens.

A conversation is rendered once as a whole; the render notes the character span of every text. The
render is encoded once, with offsets. A token is under the loss mask when its span meets the span
of an assistant's text; since both lists are sorted, binary search finds the first and last token
of each span.

Template: ``<|turn|>`` role newline text ``<|end|>`` newline, for each turn. Inside roles and
texts every ``<``, backslashes, ``|`` gets one more backslash, so no control string is left in them
and taking one away gives the text back. (Roles are escaped in the same way, and a newline or
backslash inside a role as ``\\n`` and ``\\\\``.)

Null text or role counts as empty. Turns are ordered by (turn, role, text), null turns first; each row
without a ``conv_id`` is a conversation of its own. Other columns are ignored; an empty table
gives an empty result. A conversation is one value by the nature of the task; nothing larger than
one conversation is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palisade.llm.batches import slices
from palisade.llm.vocabulary import loaded, shared

TURN, END = "<|turn|>", "<|end|>"
LEARNED_ROLE = "assistant"
SCHEMA = (
    "conv_id long, n_turns long, formatted string, spans array<struct<start:int,end:int,learned:boolean>>, "
    "ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"
)


def chat_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The formatted text, and (start, end, learned) of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape_role(role)}\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role == LEARNED_ROLE))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted text: the inverse of :func:`render`."""
    turns = []
    for piece in formatted.split(TURN)[1:]:
        role, _, rest = piece.partition("\n")
        turns.append((unescape_role(role), unescape(rest.removesuffix("\n").removesuffix(END))))
    return turns


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, bool]]) -> np.ndarray:
    """Which tokens meet a learned span; both token ends and starts are in order."""
    mask = np.zeros(len(starts), dtype=bool)
    for start, end, learned in spans:
        if learned and end > start:
            first = np.searchsorted(ends, start, side="right")
            mask[first : np.searchsorted(starts, end, side="left")] = True
    return mask


def masked_text(formatted: str, spans, starts, ends, mask) -> str:
    """Text under the mask: each learned span, as far as masked tokens cover it, unescaped."""
    out = []
    for start, end, learned in spans:
        if not learned or end <= start:
            continue
        first = np.searchsorted(ends, start, side="right")
        last = np.searchsorted(starts, end, side="left")
        at = start
        pieces = []
        for i in range(first, last):
            if mask[i] and ends[i] > at:
                pieces.append(formatted[max(at, starts[i]) : min(end, ends[i])])
                at = min(end, ends[i])
        out.append(unescape("".join(pieces)))
    return "".join(out)


def tokens(tokenizer: Tokenizer, texts: list[str]):
    tokenizer.encode_special_tokens = True
    return tokenizer.encode_batch(texts, add_special_tokens=False)


def format_conversations(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """One row per conversation: formatted text, text spans, token ids, offsets and loss mask."""
    vocabulary = shared(conversations.sparkSession, path or chat_vocabulary())
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    key = F.col("conv_id").cast("long").alias("conv_id")
    grouped = conversations.where(F.col("conv_id").isNotNull()).groupBy(key).agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    )
    alone = conversations.where(F.col("conv_id").isNull()).select(key, F.array(turn).alias("turns"))
    grouped = grouped.unionByName(alone)

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(vocabulary.value)
        for batch in slices(batches, 1 << 20):
            rendered = [
                render([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()
            ]
            found = tokens(tokenizer, [r[0] for r in rendered])
            rows = []
            for key, (text, spans), encoding in zip(batch.column(0).to_pylist(), rendered, found):
                offsets = np.array(encoding.offsets, dtype=np.int32).reshape(-1, 2)
                mask = token_mask(offsets[:, 0], offsets[:, 1], spans)
                rows.append(
                    {
                        "conv_id": key,
                        "n_turns": len(spans),
                        "formatted": text,
                        "spans": [dict(zip(("start", "end", "learned"), s)) for s in spans],
                        "ids": encoding.ids,
                        "starts": offsets[:, 0],
                        "ends": offsets[:, 1],
                        "mask": mask,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return grouped.mapInArrow(form, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars), all read back from the formatted rows.

    Turns are parsed from the text; the loss text is what stands under the token mask.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            keys, turns, losses, sizes = [], [], [], []
            for row in batch.to_pylist():
                spans = [(s["start"], s["end"], s["learned"]) for s in row["spans"]]
                starts, ends = np.array(row["starts"], np.int32), np.array(row["ends"], np.int32)
                keys.append(row["conv_id"])
                turns.append([{"role": r, "text": t} for r, t in parse(row["formatted"])])
                sizes.append(len(row["formatted"]))
                losses.append(masked_text(row["formatted"], spans, starts, ends, row["mask"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(turns, TURNS), pa.array(losses, pa.string()), pa.array(sizes, pa.int64())],
                ["conv_id", "turns", "loss_text", "formatted_chars"],
            )

    columns = formatted.select("conv_id", "formatted", "spans", "starts", "ends", "mask")
    return columns.mapInArrow(
        read, "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long"
    )


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("formatted", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("learned", pa.bool_())]))),
        ("ids", pa.list_(pa.int32())),
        ("starts", pa.list_(pa.int32())),
        ("ends", pa.list_(pa.int32())),
        ("mask", pa.list_(pa.bool_())),
    ]
)
