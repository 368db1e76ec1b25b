"""python -m rankloom search TABLES TEXT [N] | site TABLES DOMAIN TEXT [N] | fetch TABLES URL [LENGTH] | status TABLES"""

from __future__ import annotations

import sys

from rankloom import tools
from rankloom.plans.session import local_session


def main(args: list[str]) -> int:
    texts = {"search": 2, "site": 3, "fetch": 2, "status": 1}
    name, *rest = args or [""]
    wanted = texts.get(name)
    if wanted is None or not wanted <= len(rest) <= wanted + 1 or len(rest) > wanted and not rest[wanted].isdigit():
        print(__doc__)
        return 2
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    number = [int(x) for x in rest[wanted:]]
    for row in getattr(tools, name)(spark, *rest[:wanted], *number).collect():  # at most MOST_ROWS rows, a page, or a row for each engine
        print(row.answer if name == "fetch" else "  ".join(str(x) for x in row if x is not None))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
