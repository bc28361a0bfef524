"""The rate limiter as one sequential fold per key: the yardstick of the parallel operator."""

import pandas as pd
from mealops.streaming.streams import RATE_SCHEMA, _rate_fold, _requests


def rate_limit_fold(events, *, key_col: str = "user_id", window_ms: int = 60_000,
                    limit: int = 10):
    """A key's window opens at its first request and resets on the first
    request after ``reset`` (start + window). Rows are hash-partitioned by
    key and sorted inside each partition; ``mapInPandas`` then walks them in
    order carrying one (count, reset) per key, so memory stays O(batch).
    """
    window_us = window_ms * 1000
    r = _requests(events, key_col).repartition("key").sortWithinPartitions("key", "_us", "event_id")

    def fold(batches):
        cur_key, state = None, None
        for b in batches:
            if b.empty:
                continue
            outs = []
            # Split the (sorted) batch into runs of one key.
            starts = [0] + [i for i in range(1, len(b)) if b["key"].iat[i] != b["key"].iat[i - 1]] + [len(b)]
            for s, e in zip(starts[:-1], starts[1:]):
                k = b["key"].iat[s]
                if k != cur_key:
                    cur_key, state = k, None
                res, state = _rate_fold(b.iloc[s:e], state, window_us, limit)
                outs.append(res)
            yield pd.concat(outs, ignore_index=True)

    return r.mapInPandas(fold, RATE_SCHEMA)
