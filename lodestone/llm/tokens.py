"""Token counts of a document's sections, from one encoding of the whole document.

A document is encoded once, as a tokenizer sees it, so tokens may reach over a section's border. The spans of tokens and of
sections both ascend, so their interval join is a merge: one binary search of all tokens' spans in the sections' borders. A token that
crosses borders goes to one section by an explicit rule: ``most`` (the section with most of its bytes; of equals the first), ``start``
or ``end`` (the section of its first or last byte). So the sections' counts sum up to the document's count.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import modest

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits texts before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("most", "start", "end")


def encoding(path: str):
    """The tokenizer of a file of ranks, and how many bytes each token has."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def borders(text: bytes) -> np.ndarray:
    """Where sections end, in bytes: each line, with its line feed, is one; so is a text without a line feed, if empty too."""
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return at if len(at) and at[-1] == len(text) else np.append(at, len(text))


def owners(ends: np.ndarray, spans: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token. ends: of sections; spans: of tokens; both ascend."""
    starts = np.concatenate([[0], spans[:-1]]) if len(spans) else spans
    first = np.searchsorted(ends, starts, "right")
    last = np.searchsorted(ends, spans, "left")
    if rule == "start":
        return first
    if rule == "end":
        return last
    out = first.copy()
    for k in np.flatnonzero(first != last).tolist():
        cuts = np.concatenate([[starts[k]], ends[first[k] : last[k]], [spans[k]]])
        out[k] = first[k] + int(np.argmax(np.diff(cuts)))
    return out


def section_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = TOKENIZER, rule: str = "most") -> DataFrame:
    """One row for each section of each document: doc_id, section (from 0), char_start, char_end, n_tokens, doc_tokens.

    A null or empty text is one section of no tokens. Null ids are carried; rows that repeat give rows that repeat. Spans are in
    code points.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {', '.join(RULES)}")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, sizes = encoding(path)
        for b in modest(batches, 256):
            parts: list[tuple] = []
            for value in b.column(1):
                whole = value.as_py() or ""
                raw = whole.encode()
                spans = np.cumsum(sizes[np.array(tokenizer.encode_ordinary(whole), np.int64)]) if raw else np.zeros(0, np.int64)
                ends = borders(raw)
                n = np.bincount(owners(ends, spans, rule), minlength=len(ends))
                chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                stop = chars[ends - 1] if raw else np.zeros(1, np.int64)
                parts.append((np.arange(len(ends)), np.concatenate([[0], stop[:-1]]), stop, n, np.full(len(ends), len(spans))))
            if parts:
                sections = [len(p[0]) for p in parts]
                ids = b.column(0).take(pa.array(np.repeat(np.arange(len(parts)), sections)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True))], names=["doc_id", "section", "char_start", "char_end", "n_tokens", "doc_tokens"])

    return rows.mapInArrow(run, "doc_id long, section long, char_start long, char_end long, n_tokens long, doc_tokens long")
