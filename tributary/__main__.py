"""python -m tributary --sources FILE... [--config FILE] [--out FILE] [--show-canonical]

Exit codes: 0 fine; 1 the output has errors; 2 bad usage. A source that can't be read is a warning.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tributary.plans.service import answer


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tributary", description="One trusted profile from many sources")
    p.add_argument("--sources", nargs="+", required=True, help="files (.csv, .json, .pdf, .txt), the most trusted first")
    p.add_argument("--config", help="a projection config; the default output without")
    p.add_argument("--out", help="where the output goes, instead of to standard output")
    p.add_argument("--show-canonical", action="store_true", help="the canonical profile on standard error, too")
    o = p.parse_args(args)
    spark = spark or SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    found = answer(spark, o.sources, config_json=Path(o.config).read_text(encoding="utf-8") if o.config else None)
    for w in found["warnings"]:
        print(f"[warn] {w}", file=sys.stderr)
    if o.show_canonical:
        print("---- canonical profile ----", json.dumps(found["canonical"], indent=2, ensure_ascii=False), sep="\n", file=sys.stderr)
    if not found["ok"]:
        for e in found["validation_errors"]:
            print(f"[error] {e}", file=sys.stderr)
        return 1
    text = json.dumps(found["output"], indent=2, ensure_ascii=False) + "\n"
    if o.out:
        Path(o.out).write_text(text, encoding="utf-8")
        print(f"Wrote {o.out}", file=sys.stderr)
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
