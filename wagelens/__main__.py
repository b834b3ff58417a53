"""python -m wagelens {ingest|report|stream} ...

  ingest SRC_GLOB TABLE [quotes|pairwise]
  report TABLE LOCATIONS_CSV OUT_DIR [--years=2011,2012]   (prints the run summary)
  stream LANDING TABLE CHECKPOINT [--continuous]
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in ("ingest", "report", "stream"):
        raise SystemExit(__doc__)
    if argv[0] == "stream":
        from wagelens.streaming.ingest import main as stream_main
        return stream_main(argv[1:])
    from wagelens.plans.jobs import main as jobs_main
    return jobs_main(argv)


def cli() -> int:
    return main(sys.argv[1:])


if __name__ == "__main__":
    sys.exit(cli())
