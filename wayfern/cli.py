"""Command line: ``python -m wayfern.cli ingest --fixture FILE --root DIR``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from .functions.ids import digest
from .session import session
from .sources import ledger
from .sources.versions import Versions


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wayfern")
    sub = parser.add_subparsers(dest="what", required=True)
    ingest = sub.add_parser("ingest", help="check and publish a ledger fixture")
    ingest.add_argument("--fixture", required=True)
    ingest.add_argument("--root", required=True)
    ingest.add_argument("--downloaded-at-ms", type=int, default=0)
    verify = sub.add_parser("verify", help="compare the active version with its digests")
    verify.add_argument("--root", required=True)
    backup = sub.add_parser("backup", help="copy the active version and check the copy")
    backup.add_argument("--root", required=True)
    backup.add_argument("--to", required=True)
    asked = parser.parse_args(args)
    spark = session()
    versions = Versions(asked.root)
    if asked.what == "ingest":
        pages = ledger.read_fixture(spark, asked.fixture)
        decoded = ledger.decode(pages)
        if errors := {r["error"]: r["n"] for r in ledger.page_errors(decoded).collect()}:  # a row a kind
            print(json.dumps({"errors": errors}))
            return 1
        basis = pages.agg(F.max("basisDate")).first()[0]
        source = {"basis_date": basis, "downloaded_at_ms": asked.downloaded_at_ms, "snapshot_id": "snapshot_" + digest([basis, ledger.pages_digest(pages)])[:24]}
        checked = ledger.check(ledger.rows(decoded), source["snapshot_id"])
        good = ledger.normalise(checked.where(F.col("reason_code").isNull()), source["snapshot_id"])
        entry = versions.publish({"ledger": checked, "candidates": good}, source)
        print(json.dumps(ledger.summary(checked).first().asDict() | {"version": entry["version"]}))
    elif asked.what == "verify":
        found = versions.verify(spark)
        print(json.dumps(found))
        return int(not all(found.values()))
    else:
        versions.backup(spark, asked.to)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
