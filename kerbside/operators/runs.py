"""Sequential work on runs of rows that share a key, without a task or a frame per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame


def map_run_batches(df: DataFrame, keys: Sequence[str], order: Sequence, fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn`` to many whole runs of rows with equal keys at once, in ``order`` within a run.

    ``fn`` gets a dictionary of numpy arrays by column and the places where runs
    begin, and returns one of sequences by column of ``schema``, or None.  Rows
    are dealt by the keys and sorted in their partition, and batches stream
    through; only the run at a batch's end is carried over.  So thousands of
    small keys cost one Arrow batch and one call, and a partition is never held
    whole.  A run itself has to fit.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        pieces: list = []  # of the run that is still open
        last = None

        def frame(parts: list, starts):
            made = fn(parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}, starts)
            return pd.DataFrame(made) if made else None

        for pdf in batches:
            if not len(pdf):
                continue
            # other keys than whole numbers and texts compare as text, so that nulls equal each other
            text = [pdf[k].to_numpy() if pdf[k].dtype.kind in "iuO" else pdf[k].astype("string").fillna("\0").to_numpy() for k in keys]
            arrays = {c: pdf[c].to_numpy() for c in pdf.columns}
            some = lambda a, b: {c: v[a:b] for c, v in arrays.items()}  # noqa: B023, E731
            change = np.zeros(len(pdf), bool)
            for v in text:
                change[1:] |= v[1:] != v[:-1]
            change[0] = bool(pieces) and last != [v[0] for v in text]
            last = [v[-1] for v in text]
            cuts = np.flatnonzero(change)
            if len(cuts):
                # all runs up to the last one's begin are whole; the first of them may have begun before
                before = sum(len(p[keys[0]]) for p in pieces)
                starts = np.unique(np.append(0, cuts[:-1] + before))
                out = frame(pieces + [some(0, cuts[-1])], starts)
                pieces = [some(cuts[-1], None)]
                if out is not None:
                    yield out
            else:
                pieces.append(some(0, None))
        if pieces and (out := frame(pieces, np.zeros(1, int))) is not None:
            yield out

    return dealt.mapInPandas(run, schema)


def map_runs(df: DataFrame, keys: Sequence[str], order: Sequence, fn: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """``map_run_batches`` for an ``fn`` that takes one run."""

    def each(rows: dict, starts) -> dict | None:
        import numpy as np

        ends = np.append(starts[1:], len(next(iter(rows.values()))))
        made = [m for a, b in zip(starts, ends, strict=True) if (m := fn({c: v[a:b] for c, v in rows.items()}))]
        names = {c for m in made for c in m}
        return {c: np.concatenate([np.asarray(m[c]) for m in made if c in m]) for c in names}

    return map_run_batches(df, keys, order, each, schema)


def portions(weights, most: int = 1_000_000):
    """Ranges of places whose weights sum to about ``most``, or which are one place."""
    import numpy as np

    share = (np.cumsum(weights) - weights) // most
    edges = np.append(np.flatnonzero(np.diff(share, prepend=-1)), len(weights))
    return list(zip(edges[:-1], edges[1:], strict=True))
