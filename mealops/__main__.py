"""Run one catalogue query: ``python -m mealops <key> <data_dir> [out_path]``.

Without ``out_path`` the first rows are shown; with it the result is written
as parquet (overwrite). ``python -m mealops --list`` prints the keys.
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> int:
    from .plans.catalog import QUERIES
    if not argv or argv[0] in ("-h", "--help"):
        print(__doc__)
        return 0
    if argv[0] == "--list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if len(argv) < 2 or argv[0] not in QUERIES:
        print(f"unknown query or missing data dir: {argv}", file=sys.stderr)
        return 2
    from .session import get_session
    from .sources.bind import Bound
    spark = get_session()
    df = QUERIES[argv[0]](Bound(spark, argv[1]))
    if len(argv) > 2:
        df.write.mode("overwrite").parquet(argv[2])
    else:
        df.show(20, truncate=False)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
