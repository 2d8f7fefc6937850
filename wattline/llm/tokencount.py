"""Offset-mapped token attribution (operator 1).

A whole document is encoded once.  Byte-level tokens spell out the text, so the
running sum of their byte lengths gives each token's span, and a running count of
lead bytes turns that into characters.  Token spans are interval-joined to the
document's sections, and a token that crosses a section's end is allocated by a
rule: to the section of its first character (``start``), to the section with most
of its characters, the earlier on a tie (``majority``), or by characters
(``fraction``).  Under each rule the sections' tokens sum to the document's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattline.llm.common import texts

OUT = ("doc_id long, section int, start long, end long, n_overlapping long, n_crossing long, "
       "tokens_start long, tokens_majority long, tokens_fraction double")


class ByteTokens:
    """An encoder of a rank file, and the byte length of each of its tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-end character of every token (a token may hold part of a character)."""
        n = self.length[np.array(self.encoding.encode_ordinary(text), np.int64)]
        end = np.cumsum(n)
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        return (char[end - n], char[end - 1] + 1) if len(n) else (end, end)


def line_sections(text: str) -> np.ndarray:
    """Starts of the lines (each with its line feed); a text without one, even empty, is one section."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10) + 1
    return np.concatenate([[0], at[at < len(text)]])


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray, n_chars: int):
    """Join token spans to the sections that begin at ``sections`` and cover the text.

    Per section: tokens that overlap it, those of them that cross one of its ends, and its tokens under each rule.
    """
    k = len(sections)
    bounds = np.append(sections, n_chars)
    lo = np.searchsorted(sections, start, "right") - 1
    hi = np.searchsorted(sections, end - 1, "right") - 1
    by_start = np.bincount(lo, minlength=k)
    inner = lo == hi
    majority = np.bincount(lo[inner], minlength=k)
    overlap, fraction, crossing = majority.copy(), majority.astype(np.float64), np.zeros(k, np.int64)
    for s, e, a, b in zip(start[~inner], end[~inner], lo[~inner], hi[~inner]):
        part = np.minimum(bounds[a + 1:b + 2], e) - np.maximum(bounds[a:b + 1], s)
        majority[a + int(np.argmax(part))] += 1
        overlap[a:b + 1] += part > 0
        crossing[a:b + 1] += part > 0
        fraction[a:b + 1] += part / (e - s)
    return overlap, crossing, by_start, majority, fraction


def attribute_tokens(docs: DataFrame, ranks: str, pattern: str, sections=line_sections) -> DataFrame:
    """One row per section of every document; ``sections(text)`` returns their starts, the first 0.

    Null and empty texts have one section without tokens; a null doc_id stays null;
    repeated rows give repeated rows; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens(ranks, pattern)
        for b in batches:
            ids, values = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a in range(0, len(ids), 512):
                cols: list[list] = [[] for _ in range(9)]
                owner: list[tuple] = []
                for doc, text in zip(ids[a:a + 512], values[a:a + 512]):
                    at = sections(text)
                    got = attribute(*tokens.spans(text), at, len(text))
                    owner.append((doc, len(at)))
                    for c, x in zip(cols[1:], (np.arange(len(at)), at, np.append(at[1:], len(text)), *got)):
                        c.append(x)
                doc_ids = pa.array([d for d, n in owner for _ in range(n)], pa.int64())
                arrays = [pa.array(np.concatenate(c)) for c in cols[1:]]
                arrays[0] = arrays[0].cast(pa.int32())
                yield pa.RecordBatch.from_arrays([doc_ids, *arrays], names=[
                    "doc_id", "section", "start", "end", "n_overlapping", "n_crossing", "tokens_start", "tokens_majority", "tokens_fraction"])

    return texts(docs).mapInArrow(run, OUT)
