"""python -m tallyforge.cli: verify a folder of files against a manifest, list an archive or extract from it, load files into a store."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys
from collections.abc import Sequence

from tallyforge.sources.store import archive_members, extract_member, local_files


def digest(path: str) -> str:
    """SHA-256 of a local file, read in parts."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def inventory(folder: str, suffix: str) -> dict[str, str]:
    return {os.path.basename(p): digest(p) for p in local_files(folder, suffix)}


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyforge")
    commands = parser.add_subparsers(dest="command", required=True)
    discover = commands.add_parser("discover", help="list the members of an archive, or the files of a folder with their digests")
    discover.add_argument("path")
    discover.add_argument("--suffix", default=".tsv")
    fetch = commands.add_parser("fetch", help="extract one member of an archive into a folder")
    fetch.add_argument("archive")
    fetch.add_argument("member")
    fetch.add_argument("folder")
    verify = commands.add_parser("verify", help="compare a folder with an inventory that discover wrote")
    verify.add_argument("folder")
    verify.add_argument("inventory")
    verify.add_argument("--suffix", default=".tsv")
    load = commands.add_parser("load", help="load the files of a pattern that a store does not have yet")
    load.add_argument("pattern")
    load.add_argument("table")
    load.add_argument("store")
    load.add_argument("--source", default="state")
    a = parser.parse_args(argv)
    if a.command == "discover":
        found = archive_members(a.path, a.suffix) if os.path.isfile(a.path) else inventory(a.path, a.suffix)
        print(json.dumps(found, indent=1))
    elif a.command == "fetch":
        print(extract_member(a.archive, a.member, a.folder))
    elif a.command == "verify":
        with open(a.inventory) as f:
            want = json.load(f)
        have = inventory(a.folder, a.suffix)
        wrong = {n: "missing" if n not in have else "new" if n not in want else "changed" for n in {*want, *have} if want.get(n) != have.get(n)}
        print(json.dumps(wrong, indent=1, sort_keys=True))
        return 1 if wrong else 0
    else:
        from tallyforge.plans.loading import load_files
        from tallyforge.session import build_session
        from tallyforge.sources.store import Snapshots

        spark = build_session()
        print(json.dumps(load_files(spark, Snapshots(spark, a.store), a.pattern, None, a.table, a.source)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
