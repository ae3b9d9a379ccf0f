"""Exact token counts; huge texts are encoded in overlapping chunks.

A text of more than ``chunk_chars`` characters is encoded in chunks that
overlap.  Two neighbouring chunks are spliced where both start a new
pre-token at the same character.  Such a place is proven stable: the
pre-tokeniser scans from left to right and keeps no state between matches, so

* what a chunk that starts at a true boundary says up to ``MARGIN`` characters
  before its end is what the whole text says (no rule looks further ahead, and
  no special string is longer), and
* from a boundary onward every chunk says the same, wherever it began.

If no common boundary is found the overlap is doubled, and at last the left
chunk itself grows, so any text ends in an exact count.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More than the longest special string and any look-ahead of the splitter.
MARGIN = 32
SCHEMA = "n_bytes bigint, n_tokens bigint, over_limit boolean"


@lru_cache(maxsize=4)
def load_tokenizer(name: str):
    """The library's tokenizer for a file name of the public set or a path."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(name)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def stable_cuts(encoding, text: str, at: int) -> dict[int, int]:
    """Character positions in the whole text where a new pre-token starts, each
    with the number of the chunk's tokens before it.  ``at``: the chunk's start."""
    words, offsets, out = encoding.word_ids, encoding.offsets, {}
    for i in range(1, len(words)):
        if words[i] != words[i - 1]:
            end = offsets[i - 1][1]
            # offsets leave out blanks at a token's edge, so take only an end after a visible character
            if offsets[i][0] >= end > 0 and not text[at + end - 1].isspace():
                out[at + end] = i
    return out


def resync_count(encode: Callable, text: str, chunk_chars: int, overlap_chars: int) -> tuple[int, int]:
    """Tokens of ``text`` and the number of times an overlap had to be widened."""
    n, a0, a1 = len(text), 0, min(len(text), chunk_chars)
    left, since, total, widened = encode(text[a0:a1]), 0, 0, 0
    grow = chunk_chars
    while a1 < n:
        overlap = overlap_chars
        cuts = {p: i for p, i in stable_cuts(left, text, a0).items() if i > since and p <= a1 - MARGIN}
        while True:
            b0 = max(a0, a1 - overlap)
            b1 = min(n, max(b0 + chunk_chars, a1 + chunk_chars // 2 + 1))
            right = encode(text[b0:b1])
            if common := cuts.keys() & stable_cuts(right, text, b0).keys():
                break
            widened += 1
            if b0 > a0:
                overlap *= 2
                continue
            a1, grow = min(n, a1 + grow), 2 * grow
            left = encode(text[a0:a1])
            if a1 == n:
                return total + len(left.ids) - since, widened
            cuts = {p: i for p, i in stable_cuts(left, text, a0).items() if i > since and p <= a1 - MARGIN}
        p = max(common)
        total += cuts[p] - since
        left, since, a0, a1 = right, stable_cuts(right, text, b0)[p], b0, b1
        grow = chunk_chars
    return total + len(left.ids) - since, widened


def count_tokens(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 512,
    chunk_chars: int = 32_768,
    overlap_chars: int = 256,
    batch_chars: int = 1_000_000,
) -> DataFrame:
    """Per row: key, n_bytes, n_tokens, over_limit.

    No begin, end or added special tokens; special strings inside texts count
    as the library counts them by default.  A null or empty text has 0 bytes
    and 0 tokens.  Repeated rows are counted each; an empty table gives none.
    Other columns of ``df``, clashing names too, are ignored.  A worker holds
    the encodings of ``batch_chars`` characters, or of one chunk, at a time.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tok = load_tokenizer(tokenizer)

        def encode(piece: str):
            return tok.encode(piece, add_special_tokens=False)

        for batch in batches:
            texts = batch.column(1)
            sizes, counts = [], [0] * len(texts)
            waiting: list[tuple[int, str]] = []
            held = 0

            def flush() -> None:
                done = tok.encode_batch([t for _, t in waiting], add_special_tokens=False)
                for (i, _), e in zip(waiting, done, strict=True):
                    counts[i] = len(e)
                waiting.clear()

            for i, value in enumerate(texts):
                t = value.as_py() or ""
                sizes.append(len(t.encode()))
                if len(t) > chunk_chars:
                    counts[i] = resync_count(encode, t, chunk_chars, overlap_chars)[0]
                elif t:
                    waiting.append((i, t))
                    held += len(t)
                    if held >= batch_chars:
                        flush()
                        held = 0
            flush()
            over = [c > limit for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(over, pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = df.select(F.col(key), F.col(text))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
