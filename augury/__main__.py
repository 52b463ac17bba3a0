"""Command line.

``python -m augury list`` names analyses and ingest jobs.
``python -m augury analyze NAME|all FOLDER OUT [FORMAT...]`` saves tables, charts and figures.
``python -m augury index NAME FOLDER URL`` runs an ingest job against a REST or JSON-RPC address.
``python -m augury package FOLDER ARCHIVE`` packs a folder, ``python -m augury fetch ARCHIVE|URL FOLDER`` unpacks an archive.
"""

from __future__ import annotations

import shutil
import sys
import tempfile
import urllib.parse
import urllib.request
from pathlib import Path

from augury.plans.analysis import ALIASES, DEFAULT_FORMATS, analyses
from augury.session import session
from augury.sources import archive, clients, ingest

NODE_JOBS = ("fills", "amm_trades", "blocks")


def _fetch(source: str, folder: str) -> None:
    """Unpacks an archive; one with a scheme is read from there first."""
    if "://" not in source:
        archive.unpack(source, folder)
        return
    with tempfile.TemporaryDirectory() as d, urllib.request.urlopen(source) as reply:  # noqa: S310
        path = Path(d) / Path(urllib.parse.urlparse(source).path).name
        with path.open("wb") as f:
            shutil.copyfileobj(reply, f)
        archive.unpack(path, folder)


def main(args: list[str]) -> int:
    known, jobs = analyses(), ingest.jobs()
    if args[:1] == ["list"]:
        for a in [*known.values(), *jobs.values()]:
            print(f"{a.name}: {a.description}")
        return 0
    if args[:1] == ["index"] and len(args) == 4 and args[1] in jobs:
        client = clients.Rpc(args[3]) if args[1] in NODE_JOBS else clients.Rest(args[3])
        jobs[args[1]].run(session("augury"), client, args[2])
        return 0
    if args[:1] == ["package"] and len(args) == 3:
        print(archive.pack(args[1], args[2]))
        return 0
    if args[:1] == ["fetch"] and len(args) == 3:
        _fetch(args[1], args[2])
        return 0
    if len(args) < 4 or args[0] != "analyze" or (args[1] != "all" and args[1] not in known):
        print(__doc__)
        return 2
    spark, failed = session("augury"), 0
    for a in [a for n, a in known.items() if n not in ALIASES] if args[1] == "all" else [known[args[1]]]:
        try:
            saved = a.save(spark, args[2], args[3], args[4:] or (*DEFAULT_FORMATS, "json"))
            print(f"{a.name}: {', '.join(map(str, saved.values()))}")
        except Exception as e:  # one analysis that fails does not stop the others
            failed += 1
            print(f"{a.name}: {e}", file=sys.stderr)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
