"""Chat formatting by assembly of tokens.

The template of a turn is  <s> role [INST] text [/INST]  and a conversation ends with </s>. Roles and texts are encoded apart from each
other; the marks are reserved ids spliced between them, beyond the vocabulary, so no text can produce one. The rendered form is text, so
control strings inside a role or text are escaped: each backslash is doubled and a backslash follows the first character of each control
string. No control string then occurs in the content, and both forms are read back without loss. The loss mask covers the tokens of
assistant texts; it comes from prefix sums over the lengths of the segments.

Defined results: null roles and texts are empty; turns are ordered by turn (null first), role and text, so repeated rows and ties stay and
have a fixed order; a null conv_id is a conversation of its own. Only conv_id, turn, role and text are read. A conversation is the unit of
output and is assembled in one task.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks of the template and other strings that chat models treat as control; the first four have reserved ids, in this order.
CONTROL = ("<s>", "[INST]", "[/INST]", "</s>", "<<SYS>>", "<</SYS>>")
BEGIN, SAYS, DONE, END = range(4)
TRAINED_ROLE = "assistant"

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Formatted:
    ids: np.ndarray
    mask: np.ndarray


class Formatter:
    """Assembles conversations with one byte-level vocabulary, and reads them back."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        # one id after the vocabulary stays free, as models use it for the end of a text
        self.reserved = np.arange(len(CONTROL)) + max(table.values()) + 2

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(escape(text))

    def assemble(self, turns: list[tuple[str, str]]) -> Formatted:
        mark = [[int(r)] for r in self.reserved]
        segments, trained = [], []
        for role, text in turns:
            segments += [mark[BEGIN], self.encode(role), mark[SAYS], self.encode(text), mark[DONE]]
            trained += [False, False, False, role == TRAINED_ROLE, False]
        segments.append(mark[END])
        ends = np.cumsum([len(s) for s in segments])
        starts = ends - [len(s) for s in segments]
        edge = np.zeros(ends[-1] + 1, np.int8)
        trained = np.flatnonzero([*trained, False])
        np.add.at(edge, starts[trained], 1)
        np.add.at(edge, ends[trained], -1)
        return Formatted(np.fromiter((i for s in segments for i in s), np.int64, ends[-1]), np.cumsum(edge[:-1]).astype(bool))

    def pieces(self, ids: np.ndarray) -> list[int | str]:
        """Reserved marks by their place in CONTROL, and the decoded text between them."""
        at = np.flatnonzero(ids >= self.reserved[0])
        found, start = [], 0
        for i in at:
            found += [self.encoding.decode(ids[start:i].tolist()), int(ids[i] - self.reserved[0])]
            start = i + 1
        return [*found, self.encoding.decode(ids[start:].tolist())]

    def read(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """The turns of an assembled conversation."""
        parts, turns = self.pieces(ids), []
        for i, part in enumerate(parts):
            if part == BEGIN and isinstance(part, int):
                turns.append((unescape(parts[i + 1]), unescape(parts[i + 3])))
        return turns

    def rendered(self, ids: np.ndarray) -> str:
        return "".join(CONTROL[p] if isinstance(p, int) else p for p in self.pieces(ids))

    def loss_texts(self, formatted: Formatted) -> list[str]:
        """The unescaped text of each run under the mask."""
        edge = np.diff(formatted.mask.astype(np.int8), prepend=0, append=0)
        return [unescape(self.encoding.decode(formatted.ids[a:b].tolist())) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


FORMATTED = "conv_id long, ids array<int>, loss_mask array<boolean>, rendered string"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def grouped(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def formatted(conversations: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """For each conversation the ids, the loss mask and the rendered form."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        formatter = Formatter(ranks, pattern)
        for batch in batches:
            made = [formatter.assemble([(t["role"], t["text"]) for t in turns]) for turns in batch["turns"]]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "ids": [m.ids for m in made], "loss_mask": [m.mask for m in made],
                                "rendered": [formatter.rendered(m.ids) for m in made]})

    return grouped(conversations).mapInPandas(each, FORMATTED)


def read_back(output: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from the output of formatted."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        formatter = Formatter(ranks, pattern)
        for batch in batches:
            rows = []
            for conv_id, ids, mask, rendered in batch.itertuples(index=False):
                turns = formatter.read(np.asarray(ids, np.int64))
                loss = "".join(formatter.loss_texts(Formatted(np.asarray(ids, np.int64), np.asarray(mask, bool))))
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((conv_id, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(rendered)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return output.mapInPandas(each, DIGESTS)
