"""Chat formatting with prefix-target expansion.

Each assistant turn of a conversation becomes one example: all turns up to it, formatted, where only the text of that last
turn is trainable. Turns that no example would hold (those after the last assistant turn, or all of them where there is
none) make one more example without a trainable span, so that no turn is lost.

A turn is written as `<|im_start|>role\\ntext<|im_end|>\\n`. Inside texts and roles a backslash is doubled and `<|` becomes
`<\\|`; in roles a line feed becomes `\\n`. So marks stay unambiguous and `read_back` returns every turn as it was.

Conversations are dealt by conv_id, sorted by turn (ties by role and text; nulls first) and streamed: a task holds one formatted
conversation at a time, never a group of rows.

Nulls and edges: null roles and texts count as empty; a null conv_id is one conversation; a null turn sorts first; repeated
rows are turns of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
EXAMPLES = "conv_id string, example int, formatted string, loss_start int, loss_end int"
DIGESTS = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
BATCH_CHARS = 1 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text begins and ends."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted example."""
    return [(unescape(m[1]), unescape(m[2])) for m in re.finditer(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", formatted, re.S)]


def _text(x: object) -> str:
    return x if isinstance(x, str) else ""


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    here: object = ()  # no conversation yet
    prefix: list[str] = []
    length = n = pending = 0
    out: list[tuple] = []
    held = 0

    def flush() -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["conv_id", "example", "formatted", "loss_start", "loss_end"])
        frame = frame.astype({"loss_start": "Int32", "loss_end": "Int32"})
        out.clear()
        return frame

    for batch in batches:
        for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
            conv = conv if isinstance(conv, str) else None
            if conv != here:
                if pending:
                    out.append((here, n, "".join(prefix), None, None))
                    held += length
                here, prefix, length, n, pending = conv, [], 0, 0, 0
            turn, start, end = format_turn(_text(role), _text(text))
            prefix.append(turn)
            pending += 1
            if role == "assistant":
                out.append((conv, n, "".join(prefix), length + start, length + end))
                held += length
                n, pending = n + 1, 0
            length += len(turn)
            if held > BATCH_CHARS:
                held = 0
                yield flush()
    if pending:
        out.append((here, n, "".join(prefix), None, None))
    yield flush()


def _dealt(conversations: DataFrame) -> DataFrame:
    thin = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return thin.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def expand_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_end (code points of the trainable span; null: none)."""
    # Ids travel as text: pandas would turn a column of longs with a null into doubles.
    return _dealt(conversations).select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text").mapInPandas(_expand, EXAMPLES).withColumn("conv_id", F.col("conv_id").cast("long"))


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    here: object = ()
    last, loss, chars, loss_chars = "", hashlib.sha256(), 0, 0
    out: list[tuple] = []

    def close() -> None:
        turns = read_back(last)
        whole = hashlib.sha256()
        for role, text in turns:
            whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        out.append((here, len(turns), whole.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for batch in batches:
        for conv, text, start, end in zip(batch["conv_id"], batch["formatted"], batch["loss_start"], batch["loss_end"], strict=True):
            conv = conv if isinstance(conv, str) else None
            if conv != here:
                if here != ():
                    close()
                here, loss, chars, loss_chars = conv, hashlib.sha256(), 0, 0
            last = text
            chars += len(text)
            if not pd.isna(start):
                learnt = unescape(text[int(start) : int(end)])
                loss_chars += len(learnt)
                loss.update(learnt.encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DIGESTS.split(", ")])
        out.clear()
    if here != ():
        close()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DIGESTS.split(", ")])


def digest_examples(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from examples as `expand_turns` returns them (a conversation's rows stand together, in order)."""
    thin = examples.select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "loss_start", "loss_end")
    return thin.mapInPandas(_digest, DIGESTS).withColumn("conv_id", F.col("conv_id").cast("long"))
