"""SentencePiece byte-pair encoding by a table of last tokens for every prefix, and decoding.

The byte-pair encoding of a text has this property: the encodings of its prefixes nest, so each prefix has one last token, and the encoding
of the text follows by walking those last tokens back from its end. The table is filled from left to right. An automaton over all pieces
gives the pieces that end at each character; of these, the last token is the one that is compatible with the last token of the prefix
before it. Two tokens are compatible if replaying the merges inside both, best score first and leftmost among equals, never prefers a merge
across their border. A text takes time in proportion to its length.

Pieces never hold a space after another character, and characters outside every piece become bytes, so a text falls into parts that are
encoded apart. Parts repeat, so tasks keep those they have met, up to a fixed number; what is kept changes no result.

Defined results: a null text is the empty text, which has the end id only. Repeated rows each give a row; only the text column is read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.common import pieces as slices, tidied, unused

#: SentencePiece's mark for a space, as its models have it.
SPACE = "▁"
#: Parts met last and borders kept by a task, and the length up to which a part is kept. Twice as many parts are held at most.
KEPT_PARTS, KEPT_BORDERS, KEPT_LENGTH = 100_000, 150_000, 40
#: Characters handled before results are sent on.
CHUNK = 500_000

DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                        T.StructField("decoded_sha256", T.StringType())])
WITH_IDS = T.StructType([*DIGESTS.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])


def merges(piece: str, score: dict[str, float]) -> list[tuple[float, str, str]] | None:
    """The merges that build the piece: score, then the first and the last symbol after it. None if they end elsewhere."""
    symbols, trace = list(piece), []
    while len(symbols) > 1:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            return None
        symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        trace.append((best, symbols[0], symbols[-1]))
    return trace


class PrefixTable:
    """Encoder and decoder for one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.end = lib.eos_id()
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(lib.get_piece_size()) if lib.is_byte(i)}
        self.text = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.digits = {i: str(i) for i in [*self.text, self.end]}
        # a piece that its own merges don't build is never the last token of a prefix; traces share equal symbols
        one = {p: p for p in self.ids}
        self.trace = {p: [(s, one.setdefault(a, a), one.setdefault(b, b)) for s, a, b in t] for p in self.ids if (t := merges(p, self.score)) is not None}
        self.automaton = ahocorasick.Automaton()
        for p in self.trace:
            self.automaton.add_word(p, (self.ids[p], len(p)))
        self.automaton.make_automaton()
        self.piece = {i: p for p, i in self.ids.items()}
        self.width = {i: len(p) for p, i in self.ids.items()}
        self.border: dict[int, bool] = {}
        # parts met last and before them, each with its ids as 4-byte integers
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.last = array("i", [self.end]).tobytes()
        self.cut = self.cutter()

    def cutter(self) -> re.Pattern:
        """The parts of a text: a part starts at a space after another character, and at and after a line feed. No piece holds the two
        characters at such a border side by side, so no merge crosses it; for a model where one does, the whole text is one part."""
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids):
            return re.compile("(?s).+")
        return re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")

    def compatible(self, left: int, right: int) -> bool:
        """Kept answers of replay."""
        if len(self.border) >= KEPT_BORDERS:
            self.border.clear()
        known = self.border[left << 20 | right] = self.replay(self.piece[left], self.piece[right])
        return known

    def replay(self, left: str, right: str) -> bool:
        """Whether the merges inside both always come before one across the border."""
        before, after = self.trace[left], self.trace[right]
        i = j = 0
        last, first = left[-1], right[0]
        while True:
            across = self.score.get(last + first)
            a = before[i][0] if i < len(before) else None
            b = after[j][0] if j < len(after) else None
            if across is not None and (a is None or across > a) and (b is None or across >= b):
                return False
            if a is not None and (b is None or a >= b):
                last, i = before[i][2], i + 1
            elif b is not None:
                first, j = after[j][1], j + 1
            else:
                return True

    def encode_part(self, part: str) -> list[int]:
        """Last tokens of all prefixes of the part, then the ids from the end backwards. -1 is a character outside all pieces."""
        table, border, compatible = [-1] * len(part), self.border, self.compatible
        for end, (piece, width) in self.automaton.iter(part):
            if table[end] < 0:
                start = end - width
                if start < 0:
                    table[end] = piece
                elif (before := table[start]) < 0:
                    # a prefix without a last token ends in a character that never merges
                    if part[start] not in self.trace:
                        table[end] = piece
                elif (fits := border.get(before << 20 | piece)) or fits is None and compatible(before, piece):
                    table[end] = piece
        ids, at = [], len(part) - 1
        while at >= 0:
            if (piece := table[at]) < 0:
                ids += [self.byte[b] for b in reversed(part[at].encode())]
                at -= 1
            else:
                ids.append(piece)
                at -= self.width[piece]
        return ids[::-1]

    def met(self, part: str) -> bytes:
        """The ids of a part that is not among those met last, where it is from now on if it is short."""
        found = self.older.get(part) or array("i", self.encode_part(part)).tobytes()
        if len(part) <= KEPT_LENGTH:
            if len(self.parts) >= KEPT_PARTS:
                self.parts, self.older = {}, self.parts
            self.parts[part] = found
        return found

    def tokens(self, text: str) -> np.ndarray:
        """The ids of a text with the end id."""
        parts = self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []
        return np.frombuffer(b"".join([self.parts.get(x) or self.met(x) for x in parts] + [self.last]), np.int32)

    def told(self, ids: np.ndarray) -> tuple[str, int, str]:
        """Ids that end with the end id, joined by spaces; their number; the decoded text."""
        listed = ids.tolist()
        return " ".join(map(self.digits.__getitem__, listed)), len(listed), self.shown(b"".join(map(self.text.__getitem__, listed[:-1])))

    def encode(self, text: str) -> tuple[str, int, str]:
        """The ids of a text with the end id, joined by spaces; their number; the decoded text."""
        return self.told(self.tokens(text))

    def decode(self, ids: list[int]) -> str:
        return self.shown(b"".join(self.text.get(i, b"") for i in ids))

    @staticmethod
    def shown(decoded: bytes) -> str:
        """Decoded bytes without the space that encoding put in front."""
        return decoded.removeprefix(b" ").decode(errors="replace")


def encoder(model: bytes, with_ids: bool = False):
    """A column function from text to n_tokens, ids_sha256 and decoded_sha256, and the ids if asked for."""
    @F.pandas_udf(WITH_IDS if with_ids else DIGESTS)
    @tidied
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = None  # of this task alone, so that all of it is given back at its end
        for batch in batches:
            table = table or PrefixTable(model)
            texts = batch.fillna("").tolist()
            for part in slices([len(x) for x in texts], CHUNK):
                rows = []
                for text in texts[part]:
                    ids = table.tokens(text)
                    shown, n, decoded = table.told(ids)
                    row = n, hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
                    rows.append((*row, ids) if with_ids else row)
                yield pd.DataFrame(rows, columns=[f.name for f in (WITH_IDS if with_ids else DIGESTS)])

    return encode


def tokenize(docs: DataFrame, model: bytes, with_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 in place of the text, and ids if asked for."""
    fields = [f.name for f in (WITH_IDS if with_ids else DIGESTS)]
    at = unused(docs, "_found")
    found = docs.withColumn(at, encoder(model, with_ids)(F.col("text")))
    return found.withColumns({c: F.col(at)[c] for c in fields}).drop(at, "text")


def model_bytes(path: str) -> bytes:
    """A model file of the driver; tasks get its content."""
    with open(path, "rb") as file:
        return file.read()
