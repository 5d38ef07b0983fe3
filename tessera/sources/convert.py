"""Tables between CSV, JSON lines and the text codec, also from a shell:
python -m tessera.sources.convert from.csv to.txt | from.txt to.json | from.json to.txt | profile from.csv"""

from __future__ import annotations

import csv
import json
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame

from . import files


def _plain(cell: str):
    if cell == "":
        return None
    for kind in (int, float):
        try:
            return kind(cell)
        except ValueError:
            pass
    return cell


def read(path: str) -> list[dict]:
    with open(path, encoding="utf-8", newline="") as f:
        if path.endswith(".csv"):
            return [{k: _plain(v) for k, v in r.items()} for r in csv.DictReader(f)]
        if path.endswith((".json", ".jsonl", ".ndjson")):
            text = f.read()
            return json.loads(text) if text.lstrip().startswith("[") else [json.loads(x) for x in text.splitlines() if x.strip()]
        return files.decode(f.read())


def write(records: list[dict], path: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        if path.endswith(".csv"):
            names = sorted({k for r in records for k in r})
            out = csv.DictWriter(f, names)
            out.writeheader()
            out.writerows(records)
        elif path.endswith((".json", ".jsonl", ".ndjson")):
            f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in records)
        else:
            f.write(files.encode(records))


def lines(df: DataFrame) -> Iterator[str]:
    """The rows of a result as JSON lines, a partition at a time."""
    for row in files.as_json(df).toLocalIterator(prefetchPartitions=True):
        yield row[0]


def main(args: list[str]) -> int:
    if len(args) == 2 and args[0] == "profile":
        records = read(args[1])
        for name in sorted({k for r in records for k in r}):
            values = [r.get(name) for r in records]
            print(f"{name}\t{len(values)}\t{sum(v is None for v in values)} missing\t{len(set(map(str, values)))} distinct")
        return 0
    if len(args) != 2:
        print(__doc__, file=sys.stderr)
        return 2
    write(read(args[0]), args[1])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
