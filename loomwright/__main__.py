"""Command line: chunk, report and query.

    python -m loomwright chunk INPUTS OUT [TOKENS_PER_CHUNK] [TARGET]
    python -m loomwright report INPUTS OUT.json
    python -m loomwright query NAME SF_DIR
"""

from __future__ import annotations

import json
import sys


def main(args: list[str]) -> int:
    from loomwright.plans import run
    from loomwright.plans.runtime import session

    if len(args) < 3 or args[0] not in ("chunk", "report", "query"):
        print(__doc__)
        return 2
    spark = session()
    if args[0] == "chunk":
        print(json.dumps(run.chunk_corpus(spark, args[1], args[2], *map(int, args[3:5]))))
    elif args[0] == "report":
        print(json.dumps(run.corpus_report(spark, args[1], args[2])))
    else:
        from loomwright.plans.registry import QUERIES

        QUERIES[args[1]](spark, args[2]).show(50, truncate=100)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
