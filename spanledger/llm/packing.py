"""Packing tokenised messages into training sequences of a fixed window.

Each task reads its messages in order and keeps a bounded number of open windows.
Whole windows are cut off a long message at once. What remains of a message goes
best-fit: into the open window that it leaves least room in. If none fits, the
fullest window is emitted, filled up with the head of the message where it would
otherwise waste more than ``slack`` tokens. Windows still open at the end of a task
are taken apart and merged over several tasks, largest piece first.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanledger.llm.rows import released, stored, texts

WINDOW = 2048
OPEN_WINDOWS = 64
SLACK = 16
#: Tasks whose leftover windows are merged together.
MERGED_TASKS = 16
END_ID = 1

#: Fixed value: how byte-level vocabularies cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Byte-level vocabularies write visible Latin-1 bytes as themselves, all others as
#: the characters from 256 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(x): x for x in _VISIBLE} | {
    chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in _VISIBLE)
}

PIECES = (
    "id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "part long, sequence long, offset long, whole boolean"
)
COLUMNS = [x.split()[0] for x in PIECES.split(", ")]


class Encoder:
    """Token ids as little-endian 32-bit numbers, from the file of a byte-level BPE.

    Texts in Latin-1 characters, where both agree on what a letter is, go through a
    faster encoder built from the same vocabulary; all others, and texts that spell a
    special token, through the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        special = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = list(special)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {self._bytes(x): i for x, i in vocabulary.items() if x not in special}
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _bytes(token: str) -> bytes:
        return bytes(_BYTE_OF[x] for x in token)

    def ids(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            plain = False
        else:
            plain = not any(x in text for x in self.special)
        if plain:
            return self.fast.encode_to_numpy(text).astype("<u4").tobytes()
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(x.to_bytes(4, "little") for x in found)


def _best_fit(used: list[tuple[int, int]], room: int) -> int | None:
    """Index in the sorted (fill, window) list of the fullest window with ``room`` left."""
    at = bisect_right(used, (room, 1 << 62)) - 1
    return at if at >= 0 else None


class Windows:
    """Open windows of one task or merge."""

    def __init__(self, window: int, open_windows: int | None):
        self.window, self.limit = window, open_windows
        self.used: list[tuple[int, int]] = []
        self.held: dict[int, list[tuple]] = {}
        self.count = 0

    def put(self, piece: tuple) -> bool:
        """Place a piece; false if no open window fits and no more may be opened."""
        at = _best_fit(self.used, self.window - piece[2])
        if at is None:
            if self.limit is not None and len(self.used) >= self.limit:
                return False
            fill, k = 0, self.count
            self.count += 1
            self.held[k] = []
        else:
            fill, k = self.used.pop(at)
        self.held[k].append((*piece, k, fill))
        insort(self.used, (fill + piece[2], k))
        return True

    def full(self) -> Iterator[list[tuple]]:
        while self.used and self.used[-1][0] == self.window:
            yield self.held.pop(self.used.pop()[1])

    def fullest(self) -> list[tuple]:
        return self.held.pop(self.used.pop()[1])

    def room(self) -> int:
        return self.window - self.used[-1][0]


def _pack(frames, path, window, open_windows, slack) -> Iterator[pd.DataFrame]:
    encoder, part = Encoder(path), TaskContext.get().partitionId()
    windows = Windows(window, open_windows)
    out: list[tuple] = []

    def emit(pieces: list[tuple], whole: bool) -> None:
        out.extend((*p[:5], part, p[5], p[6], whole) for p in pieces)

    def frame_of() -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=COLUMNS)
        frame["id"] = frame["id"].astype("Int64")
        out.clear()
        return frame

    for frame in frames:
        for item, text in zip(frame["id"], frame["content"], strict=True):
            ids = (encoder.ids(text) if text else b"") + END_ID.to_bytes(4, "little")
            total = len(ids) // 4
            item = None if pd.isna(item) else int(item)

            def piece(start, length, item=item, ids=ids, total=total):
                return item, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total

            start = 0
            while total - start >= window:
                emit([(*piece(start, window), windows.count, 0)], True)
                windows.count += 1
                start += window
            while start < total:
                if windows.put(piece(start, total - start)):
                    start = total
                else:
                    room = windows.room()
                    if room > slack:
                        windows.put(piece(start, room))
                        start += room
                    emit(windows.fullest(), True)
                for done in windows.full():
                    emit(done, True)
        yield frame_of()
    for pieces in windows.held.values():
        emit(pieces, False)
    yield frame_of()


def _merge(frame: pd.DataFrame, window: int) -> pd.DataFrame:
    """Leftover pieces of some tasks, best-fit with the largest first."""
    part = int(frame["part"].iloc[0])
    windows, rows = Windows(window, None), []
    pieces = frame.sort_values(["length", "part", "sequence", "offset"], ascending=[False, True, True, True])
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    for values in zip(*[pieces[x] for x in names], strict=True):
        windows.put(values)
        rows += [p for done in windows.full() for p in done]
    rows += [p for held in windows.held.values() for p in held]
    out = pd.DataFrame(rows, columns=[*names, "sequence", "offset"])
    out["id"] = out["id"].astype("Int64")
    out["part"], out["whole"] = part, False
    return out[COLUMNS]


def pack_messages(
    messages: DataFrame,
    tokenizer: str,
    id_column: str = "id",
    content: str = "content",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    slack: int = SLACK,
) -> DataFrame:
    """Pieces of tokenised messages and their places in sequences of ``window`` tokens.

    ``tokenizer`` is the path of a byte-level tokenizer file. A message is its token
    ids, without added special tokens, and the end id 1. Returns for each piece id,
    start (the message's ids before it), length, ids_crc32 (of the ids as unsigned
    little-endian 32-bit numbers), doc_tokens, sequence_id and offset (its place in
    the sequence, without gaps). Each id lies in exactly one piece; only the last
    sequence of ``MERGED_TASKS`` tasks may have much padding.

    A null or empty text has the end id alone; a null id is passed on; repeated rows
    are packed each; an empty table gives no rows.
    """
    docs = texts(messages, id_column, content)
    packed = docs.mapInPandas(released(lambda frames: _pack(frames, tokenizer, window, open_windows, slack)), PIECES)
    packed = stored(packed, "message-pieces")
    left = packed.where(~F.col("whole")).withColumn("part", F.floor(F.col("part") / MERGED_TASKS))
    merged = left.groupBy("part").applyInPandas(lambda frame: _merge(frame, window), PIECES)
    # Merged sequences are numbered apart from those that the tasks emitted.
    return packed.where("whole").unionByName(merged).select(
        "id", "start", "length", "ids_crc32", "doc_tokens",
        (F.shiftleft(F.col("part") * 2 + (~F.col("whole")).cast("long"), 32) + F.col("sequence")).alias("sequence_id"),
        "offset",
    )
