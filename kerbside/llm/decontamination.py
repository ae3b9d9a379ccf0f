"""Benchmark items inside documents, by size-partitioned MinHash containment.

Items are partitioned by size; for items of up to s shingles a document is seen
through windows of two neighbouring blocks of s shingles, so that an item inside
a document of any length is a large part of some window.  Under every
permutation a window's minimum comes from the minima of its blocks, and blocks
of the next size from pairs of blocks, so a document is hashed once for all
sizes.  A window that has the minimum of an item under any permutation makes the
item a candidate; candidates are verified by exact shingle containment in the
whole document.  Items of up to four shingles, which need all of them, are looked
up by one of them instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.sharding import unit_hash

#: One value per band.  An item of five shingles, of which a window of 32 holds the
#: four that count, has a Jaccard similarity of 4/33 with it and escapes 128
#: permutations once in 10 million times; larger items fill their windows more.
PERMUTATIONS, SEED, SMALLEST = 128, 7_919, 16
#: Shingles of a stretch of a document, about; a power of two.
STRETCH = 1 << 17
HITS = "array<struct<item_id:bigint,n_shared:bigint,n_item:bigint>>"


def folded_hashes(text: bytes):
    """Hashes of the words in lower case, accented and non-Latin letters too; bytes that are no UTF-8 stay."""
    from kerbside.llm._shingles import word_hashes

    return word_hashes(text if text.isascii() else text.decode("utf-8", "surrogateescape").lower().encode("utf-8", "surrogateescape"))


def window_minima(hashes, sizes: Sequence[int]) -> Iterator[dict]:
    """The minima of all windows of two blocks, by block size and permutation, one stretch of a document at a time.

    Stretches overlap by two of the largest blocks and start where a block of
    every size starts, so no window is lost, and what is held does not grow with
    the document.
    """
    import numpy as np

    from kerbside.llm._shingles import permutations

    if not len(hashes) or not sizes:
        return
    a, b = permutations(PERMUTATIONS, SEED)
    largest = max(sizes)
    stride = max(STRETCH, largest)
    for begin in range(0, len(hashes), stride):
        part = hashes[begin : begin + stride + 2 * largest]
        if pad := -len(part) % SMALLEST:
            part = np.concatenate([part, np.repeat(part[-1:], pad)])
        # line j holds the j-th shingle of every block, so the minima grow along whole lines
        lines = np.ascontiguousarray(part.reshape(-1, SMALLEST).T)
        blocks, step = np.empty((PERMUTATIONS, lines.shape[1]), np.uint64), 256
        for at in range(0, lines.shape[1], step):
            least = blocks[:, at : at + step]
            value = np.empty(least.shape, np.uint64)
            for j, line in enumerate(lines[:, at : at + step]):
                np.multiply(line, a, out=value)
                np.add(value, b, out=value)
                if j == 0:
                    least[:] = value
                else:
                    np.minimum(least, value, out=least)
        size, out = SMALLEST, {}
        while True:
            if size in sizes:
                out[size] = np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks
            if size >= largest:
                break
            if blocks.shape[1] % 2:
                blocks = np.concatenate([blocks, blocks[:, -1:]], 1)
            blocks, size = np.minimum(blocks[:, ::2], blocks[:, 1::2]), size * 2
        yield out
        if begin + stride + 2 * largest >= len(hashes):
            return


@dataclass
class ItemIndex:
    """Items as (id, text); ``shingle`` words a shingle, ``percent`` of them needed."""

    items: Sequence[tuple[int | None, str | None]]
    shingle: int = 5
    percent: int = 80
    _built: dict = field(default_factory=dict, repr=False)

    def built(self) -> dict:
        """exact: sorted shingles by item; first: by length of the runs, the first run of each small item, sorted, and its
        number; classes: by size the minima of items, sorted by permutation, and their numbers."""
        if self._built:
            return self._built
        import numpy as np

        from kerbside.llm._shingles import permutations, runs

        a, b = permutations(PERMUTATIONS, SEED)
        exact, small, classes = [], {}, {}
        for number, (_, text) in enumerate(self.items):
            words = folded_hashes((text or "").encode("utf-8", "surrogateescape"))
            k = min(self.shingle, len(words))
            exact.append(np.unique(runs(words, k)))
            own = exact[-1]
            # with few shingles all of them are needed, so each of them finds the item
            if 0 < len(own) and 100 * (len(own) - 1) < self.percent * len(own):
                small.setdefault(k, []).append((own[0], number))
            elif len(own):
                size = max(SMALLEST, 1 << math.ceil(math.log2(1.25 * len(own))))
                classes.setdefault(size, []).append((number, (own[None, :] * a + b).min(1)))
        made = {}
        for size, rows in classes.items():
            numbers, minima = np.array([n for n, _ in rows]), np.stack([m for _, m in rows], 1)
            order = minima.argsort(1)
            made[size] = (np.take_along_axis(minima, order, 1), numbers[order])
        first = {}
        for k, rows in small.items():
            hashes, numbers = np.array([h for h, _ in rows], np.uint64), np.array([n for _, n in rows])
            order = hashes.argsort()
            first[k] = (hashes[order], numbers[order])
        self._built = {"exact": exact, "first": first, "classes": made}
        return self._built

    @cached_property
    def marks(self) -> dict:
        """By size and permutation, which values of 16 bits of a minimum any item has."""
        import numpy as np

        out = {}
        for size, (minima, _) in self.built()["classes"].items():
            out[size] = np.zeros((PERMUTATIONS, 1 << 16), bool)
            out[size][np.arange(PERMUTATIONS)[:, None], (minima >> np.uint64(20)).astype(np.int64) & 0xFFFF] = True
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "marks"}

    def candidates(self, windows: dict) -> set[int]:
        """Numbers of the items that some window shares a minimum with."""
        import numpy as np

        found, rows = set(), np.arange(PERMUTATIONS)[:, None]
        for size, (minima, numbers) in self.built()["classes"].items():
            window = windows[size]
            for p, w in np.argwhere(self.marks[size][rows, (window >> np.uint64(20)).astype(np.int64) & 0xFFFF]):
                lo, hi = (np.searchsorted(minima[p], window[p, w], s) for s in ("left", "right"))
                found.update(numbers[p, lo:hi].tolist())
        return found

    def contained(self, words, hashes, found: set[int]) -> list[tuple[int | None, int, int]]:
        """(item_id, shared shingles, item's shingles) of the items among ``found``, and of the small ones, that a document has."""
        import numpy as np

        from kerbside.llm._shingles import runs

        x, out, likely = self.built(), [], [(n, hashes) for n in sorted(found)]
        for k, (first, numbers) in x["first"].items():
            have = hashes if k == self.shingle else runs(words, k)
            lo, hi = np.searchsorted(first, have, "left"), np.searchsorted(first, have, "right")
            met = {n for a, b in zip(lo[lo < hi], hi[lo < hi], strict=True) for n in numbers[a:b].tolist()}
            likely += [(n, have) for n in sorted(met)]
        for n, have in likely:
            own = x["exact"][n]
            shared = int(np.isin(own, have).sum())
            if shared and 100 * shared >= self.percent * len(own):
                out.append((self.items[n][0], shared, len(own)))
        return out

    def search(self, text: bytes) -> list[tuple[int | None, int, int]]:
        """(item_id, shared shingles, item's shingles) of every item contained in the text."""
        from kerbside.llm._shingles import runs

        words = folded_hashes(text)
        hashes = runs(words, self.shingle)
        found = set().union(*(self.candidates(w) for w in window_minima(hashes, list(self.built()["classes"]))))
        return self.contained(words, hashes, found)


def search_all(texts: Sequence[bytes], parts: Sequence[Callable[[], ItemIndex]], sizes: Sequence[int], shingle: int) -> list[list]:
    """Per text the entries of all parts of an index, which are loaded one after the other.

    Every text is hashed once; the minima of about STRETCH shingles wait while
    the parts pass by.
    """
    from kerbside.llm._shingles import runs

    out: list[list] = [[] for _ in texts]
    found: dict[tuple[int, int], set] = {}
    waiting, held = [], 0

    def flush() -> None:
        for p, part in enumerate(parts if waiting else ()):
            index = part()
            for i, windows, words, hashes in waiting:
                if windows is not None:
                    found.setdefault((p, i), set()).update(index.candidates(windows))
                else:  # the end of a text
                    out[i] += index.contained(words, hashes, found.pop((p, i), set()))
        waiting.clear()

    for i, text in enumerate(texts):
        words = folded_hashes(text)
        hashes = runs(words, shingle)
        for windows in window_minima(hashes, sizes):
            waiting.append((i, windows, None, None))
            held += min(len(hashes), STRETCH)
            if held >= STRETCH:
                flush()
                held = 0
        waiting.append((i, None, words, hashes))
    flush()
    for entries in out:
        entries.sort(key=lambda e: (e[0] is not None, e))
    return out


def find_items(
    df: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shingle: int = 5,
    percent: int = 80,
    items_a_part: int = 5000,
) -> DataFrame:
    """Add ``contained``: the items of which a text holds ``percent`` of the shingles or more.

    All columns and rows of ``df`` stay, repeated rows too; a column of that
    name is replaced.  An entry has item_id, n_shared and n_item; entries are
    in the order of the ids.  Shingles are runs of ``shingle``
    words in lower case, of all letters, so that a passage in capitals is found;
    an item with fewer words counts as one run of all its words; an item without words is contained nowhere, and a null or empty
    text contains nothing.  Repeated items are reported each, as are items with a null id.  An empty table, or no item, gives no entry.

    The index is cut into parts of about ``items_a_part`` items by a hash; the
    driver builds one at a time and broadcasts it.  All parts are searched by
    one function, which hashes each text once and holds one part at a time (a
    single part stays loaded).  Long texts are read whole, in stretches, and
    only eight bytes a word are held of them.
    """
    total = items.count()
    count = max(1, -(-total // items_a_part))
    chosen = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    place = F.floor(unit_hash(F.concat_ws(":", F.col("i").cast("string"), F.col("t"))) * count)
    shared, sizes = [], set()
    for p in range(count):
        index = ItemIndex([(r["i"], r["t"]) for r in chosen.where(place == p).orderBy("i", "t").collect()], shingle, percent)
        sizes.update(index.built()["classes"])
        shared.append(df.sparkSession.sparkContext.broadcast(index))  # items_a_part items, about
    sizes = sorted(sizes)

    @F.pandas_udf(HITS)
    def look(texts):
        import pandas as pd

        def load(part):
            index = part.value
            if len(shared) > 1:
                part.__dict__.pop("_value", None)  # it comes from the worker's disk again
            return index

        found = search_all(list(texts), [lambda x=x: load(x) for x in shared], sizes, shingle)
        return pd.Series([[{"item_id": i, "n_shared": s, "n_item": n} for i, s, n in entries] for entries in found])

    # the UDF is not deterministic for the planner only, so that a filter on its result does not run it twice
    plain = df.drop("contained")
    return plain.withColumn("contained", look.asNondeterministic()(F.coalesce(F.col(text), F.lit("")).cast("binary")))
